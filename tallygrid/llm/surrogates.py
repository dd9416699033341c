"""Personal data replaced by surrogates, with DataFrame expressions only.

Entities (e-mail addresses, telephone numbers, network addresses, card numbers, social security numbers, names after a title) are found by
patterns. Each distinct entity, in a canonical form that ignores how it is written, gets one surrogate of its type, derived from
a secret key: letters stay letters, digits digits, separators and capitals stay where they are; network addresses stay valid,
card numbers keep their first digit and their check digit's validity; given names keep gender and script, surnames
script. The same entity has the same surrogate in all documents, whatever its spelling (coreference).

Collisions are checked over the whole corpus: a surrogate that is itself an entity found in the texts, or that another entity of
its type has taken, is drawn again with the next attempt, until all are distinct. Only the entities, not the texts, go through these
rounds; texts with entities are joined once with their replacements, all others pass untouched.

A null text stays null, an empty one empty. Rows with a null id are treated like others. Rows that repeat an id and a text get equal
results. Ties between entities that drew the same surrogate go to the one that sorts first. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, new_work_dir

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Fixed patterns, in the order in which they are tried at a place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
ADDRESS = rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)"
SOCIAL = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?![\w-])|(?<![\w+])\+\d{10,15}(?!\w)"
CARD = r"(?<![\w-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])"
# Fixed titles by gender.
FEMALE = r"(?:Mrs\.?|Ms\.?|Miss|Frau|Mme|Madame|Mlle|Sra\.|Señora|госпожа|Κυρία)"
MALE = r"(?:Mr\.?|Herr|Monsieur|Sr\.|Señor|господин|Κύριος)"
_NAME = r" \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?"
NAME = rf"(?<!\p{{L}})(?:{FEMALE}|{MALE}){_NAME}"
_ALL = "|".join((EMAIL, ADDRESS, SOCIAL, PHONE, CARD, NAME))
_HINT = rf"[0-9@]|(?:{FEMALE}|{MALE}) \p{{Lu}}"

# Fixed surrogate names by script and gender, and syllables of surrogate surnames by script.
GIVEN = {
    ("latin", "f"): ("Anna", "Clara", "Emma", "Helen", "Ida", "Julia", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sara", "Tina", "Vera", "Zoe"),
    ("latin", "m"): ("Adam", "Boris", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Max", "Oscar", "Paul", "Victor"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Лидия", "Мария"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Егор", "Иван", "Лев", "Павел"),
    ("greek", "f"): ("Άννα", "Ελένη", "Ζωή", "Ιωάννα", "Μαρία", "Σοφία", "Χλόη", "Δάφνη"),
    ("greek", "m"): ("Άρης", "Γιώργος", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος", "Φώτης"),
}
SYLLABLES = {
    "latin": ("ba", "den", "fal", "gor", "hal", "kin", "lo", "mar", "nel", "per", "ros", "sten", "tor", "ul", "ves", "win"),
    "cyrillic": ("ба", "вер", "гор", "дан", "ки", "лан", "мар", "но", "пет", "ро", "сан", "тол", "ул", "фе", "хо", "ши"),
    "greek": ("βα", "γορ", "δη", "θε", "κα", "λαμ", "μι", "νο", "πα", "ρι", "σο", "τα", "φω", "χα", "ψα", "ζα"),
}
_ENDINGS = {("latin", "f"): "a", ("latin", "m"): "n", ("cyrillic", "f"): "а", ("cyrillic", "m"): "н", ("greek", "f"): "α", ("greek", "m"): "ος"}


def _matches(pattern: str, column: Column) -> Column:
    return column.rlike(f"^(?:{pattern})$")


def _digits(column: Column) -> Column:
    return F.regexp_replace(column, r"\D", "")


def _part(place: Column, order: int, kind, raw: Column) -> Column:
    return F.struct(place.cast("int").alias("place"), F.lit(order).alias("part"), (kind if isinstance(kind, Column) else F.lit(kind)).cast("string").alias("kind"), raw.alias("raw"))


def _parts(match: Column, place: Column) -> Column:
    """The parts of a match in order: those of a kind are entities, the others stay."""
    kind = (
        F.when(_matches(EMAIL, match), "email").when(_matches(ADDRESS, match), "address").when(_matches(SOCIAL, match), "social")
        .when(_matches(PHONE, match), "phone").when(_matches(CARD, match), "card")
    )
    title = F.regexp_extract(match, rf"^(?:{FEMALE}|{MALE}) ", 0)
    names = F.split(F.substring(match, F.length(title) + 1, F.length(match)), " ")
    gender = F.when(match.rlike(f"^{FEMALE} "), "given_f").otherwise("given_m")
    surname = _part(place, 3, "surname", F.element_at(names, -1))
    full = F.array(_part(place, 0, None, title), _part(place, 1, gender, F.get(names, F.lit(0))), _part(place, 2, None, F.lit(" ")), surname)
    short = F.array(_part(place, 0, None, title), surname)
    return F.when(kind.isNotNull(), F.array(_part(place, 0, kind, match))).when(F.size(names) > 1, full).otherwise(short)


def _canonical(kind: Column, raw: Column) -> Column:
    digits = _digits(raw)
    return (
        F.when(kind.isin("card", "social"), digits)
        .when(kind == "phone", F.when(F.length(digits) > 10, F.substring(digits, F.length(digits) - 9, F.lit(10))).otherwise(digits))
        .when(kind == "address", raw).otherwise(F.lower(raw))
    )


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits ends in its check digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, b: a + b) % 10 == 0


def _surrogate(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """The canonical surrogate of an entity at an attempt."""

    def number(i) -> Column:
        own = F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string"), (i if isinstance(i, Column) else F.lit(i)).cast("string"), F.lit(key))
        return F.conv(F.substring(F.sha2(own, 256), 1, 12), 16, 10).cast("long")

    def digit(i: Column, low: int = 0) -> Column:
        return (F.lit(low) + number(i) % (10 - low)).cast("string")

    def drawn(text: Column, each) -> Column:
        return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), each), "")

    def picked(options: tuple[str, ...], i) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), (number(i) % len(options) + 1).cast("int"))

    phone = drawn(canonical, lambda c, i: F.when((i == 0) | (i == 3), digit(i, 2)).otherwise(digit(i)))
    social = drawn(canonical, lambda c, i: F.when(i == 0, (number(i) % 6).cast("string")).when(i == 2, digit(i, 7)).when((i == 4) | (i == 8), digit(i, 1)).otherwise(digit(i)))
    body = drawn(canonical, lambda c, i: F.when(i == 0, c).otherwise(digit(i)))
    stem = F.substring(body, F.lit(1), F.length(body) - 1)
    check = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(stem, d.cast("string"))), luhn_valid)
    card = F.when(luhn_valid(canonical), F.get(check, F.lit(0))).otherwise(body)
    address = F.concat_ws(".", (number(0) % 223 + 1).cast("string"), (number(1) % 256).cast("string"), (number(2) % 256).cast("string"), (number(3) % 254 + 1).cast("string"))
    top = F.regexp_extract(canonical, r"\.[a-z]+$", 0)
    before = F.substring(canonical, F.lit(1), F.length(canonical) - F.length(top))
    letter = lambda i: F.char((F.lit(97) + number(i) % 26).cast("int"))
    email = F.concat(drawn(before, lambda c, i: F.when(c.rlike("[a-z]"), letter(i)).when(c.rlike("[0-9]"), digit(i)).otherwise(c)), top)
    script = _script(canonical)

    def syllables(of: str, count: Column, start: int) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: picked(SYLLABLES[of], i + start)), "")

    def by_script(value) -> Column:
        return F.when(script == "cyrillic", value("cyrillic")).when(script == "greek", value("greek")).otherwise(value("latin"))

    longer = (F.lit(3) + F.floor(attempt / 8)).cast("int")
    surname = by_script(lambda s: syllables(s, longer, 0))

    def given(gender: str) -> Column:
        grown = lambda s: F.concat(F.lower(picked(GIVEN[s, gender], 0)), syllables(s, F.greatest(attempt - 2, F.lit(1)), 1), F.lit(_ENDINGS[s, gender]))
        return by_script(lambda s: F.when(attempt < 3, F.lower(picked(GIVEN[s, gender], 0))).otherwise(grown(s)))

    return (
        F.when(kind == "email", email).when(kind == "address", address).when(kind == "social", social).when(kind == "phone", phone)
        .when(kind == "card", card).when(kind == "surname", surname).when(kind == "given_f", given("f")).otherwise(given("m"))
    )


def _written(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the format in which the entity is written."""
    extra = F.length(_digits(raw)) - F.length(surrogate)  # a country code in front is kept
    signs = F.filter(F.split(raw, ""), lambda c: c != "")
    seen = lambda i: F.length(_digits(F.substring(raw, F.lit(1), i + 1))) - extra
    numbers = F.array_join(F.transform(signs, lambda c, i: F.when(c.rlike("[0-9]") & (seen(i) > 0), F.substring(surrogate, seen(i), F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(signs, lambda c, i: F.when(F.upper(c) == c, F.upper(F.substring(surrogate, i + 1, F.lit(1)))).otherwise(F.substring(surrogate, i + 1, F.lit(1)))), "")
    name = F.when((F.upper(raw) == raw) & (F.length(raw) > 1), F.upper(surrogate)).otherwise(F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate))))
    return F.when(kind.isin("phone", "card", "social"), numbers).when(kind == "address", surrogate).when(kind == "email", cased).otherwise(name)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """Distinct surrogates for distinct entities (``kind``, ``canonical``): adds ``surrogate``."""
    known = checkpointed(entities.select("kind", "canonical").distinct())
    pending = known.withColumn("attempt", F.lit(0))
    accepted = None
    while True:
        tried = checkpointed(pending.withColumn("surrogate", _surrogate(key, F.col("kind"), F.col("canonical"), F.col("attempt"))))
        if tried.isEmpty():
            return accepted if accepted is not None else tried.select("kind", "canonical", "surrogate")
        taken = known.select("kind", F.col("canonical").alias("surrogate"))
        if accepted is not None:
            taken = taken.unionByName(accepted.select("kind", "surrogate"))
        free = tried.join(taken, ["kind", "surrogate"], "left_anti")
        winners = free.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"))
        good = checkpointed(winners.select("kind", "canonical", "surrogate"))
        pending = tried.join(good, ["kind", "canonical"], "left_anti").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        accepted = good if accepted is None else checkpointed(accepted.unionByName(good))


def with_surrogates(docs: DataFrame, key: str = "tallygrid", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``n_entities`` and ``text`` with surrogates in place of all entities."""
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hinted = F.coalesce(F.col("text").rlike(_HINT), F.lit(False))
    matches = F.when(hinted, F.regexp_extract_all("text", F.lit(_ALL), F.lit(0)))
    rows = own.withColumn("matches", matches).withColumn("n_entities", F.greatest(F.size(F.coalesce("matches", F.array().cast("array<string>"))), F.lit(0)).cast("long"))
    path = new_work_dir(spark, "entities")
    parts = F.flatten(F.transform("matches", _parts))
    exploded = rows.filter("n_entities > 0").select("doc_id", F.xxhash64("text").alias("digest"), F.explode(parts).alias("p")).select("doc_id", "digest", "p.*")
    exploded.withColumn("canonical", _canonical(F.col("kind"), F.col("raw"))).write.parquet(path)
    found = spark.read.parquet(path)
    assigned = assign(found.filter("kind is not null"), key)
    placed = found.join(assigned, ["kind", "canonical"], "left")
    written = F.when(F.col("surrogate").isNull(), F.col("raw")).otherwise(_written(F.col("kind"), F.col("raw"), F.col("surrogate")))
    one = placed.groupBy("doc_id", "digest", "place").agg(F.array_sort(F.collect_set(F.struct("part", written.alias("written")))).alias("parts"))
    one = one.select("doc_id", "digest", "place", F.array_join(F.transform("parts", lambda p: p["written"]), "").alias("written"))
    replacements = one.groupBy(F.col("doc_id").alias("of"), F.col("digest").alias("of_digest")).agg(F.array_sort(F.collect_list(F.struct("place", "written"))).alias("replacements"))
    touched = rows.filter("n_entities > 0").withColumn("digest", F.xxhash64("text")).select("doc_id", "n_entities", "text", "digest")
    joined = touched.join(replacements, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")))
    pieces = F.split("text", _ALL, -1)
    text = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get("replacements", i)["written"], F.lit("")))), "")
    untouched = rows.filter("n_entities = 0").select("doc_id", "n_entities", "text")
    return untouched.unionByName(joined.select("doc_id", "n_entities", text.alias("text")))
