"""Documents that are awkward in every way the operators must bear, and brute-force counterparts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, topic string, spans int, slot int, block int"


def edge_rows(seed=1, count=40):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with names the operators use."""
    rng = random.Random(seed)
    vocabulary = ["the", "and", "Über", "naïve", "x", "of", "to", "in", "is", "it"] + [f"w{i}" for i in range(30)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(120))
    rows = []
    for i in range(count):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 20, 90]))]
        cut = rng.randrange(0, 60)
        text = " ".join(words) + rng.choice([" ", "\n", "\t\t"]) + " ".join(passage.split()[cut : cut + rng.randrange(0, 110)])
        rows.append((i * 3, text, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", None, "s1"]), len(text), "r", None, i, None, 7))
    copy = list(rows[5])
    copy[0] = 501
    rows += [
        (500, None, None, None, None, None, None, None, None, None),
        (502, "", "en", "s1", 0, None, None, 1, 1, 1),
        (503, "   \n\t ", "en", "s1", 0, None, None, 1, 1, 1),
        tuple(copy),
        (504, "ab" * 40_000, "en", "s0", 80_000, None, None, 1, 1, 1),
        (505, "long " * 20_000, "en", "s0", 100_000, None, None, 1, 1, 1),
        (506, "日本語 テキスト x y 😀 " * 30, "ja", "s2", 1, None, None, 1, 1, 1),
    ]
    return rows


def edge_docs(spark, **kwargs):
    return spark.createDataFrame(edge_rows(**kwargs), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def without_windows(texts, length):
    """``texts``: id to a sequence (bytes, or tuple of words). Per id: units, removed, runs, kept units."""
    first = {}
    for doc in sorted(texts):
        units = texts[doc]
        for i in range(len(units) - length + 1):
            first.setdefault(units[i : i + length], doc)
    found = {}
    for doc, units in texts.items():
        gone = [False] * len(units)
        for i in range(len(units) - length + 1):
            if first[units[i : i + length]] < doc:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        found[doc] = (len(units), sum(gone), runs, [u for u, g in zip(units, gone) if not g])
    return found


def classes(texts, similar):
    """The least id that each id reaches over pairs for which ``similar`` holds."""
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if similar(texts[a], texts[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: root(d) for d in ids}
