"""Language identification by unigram piece models that sum over all segmentations.

The pieces are a fixed public vocabulary. Per language, every piece has a probability; a word's probability is the sum over all
ways to cut it into pieces (forward algorithm), a text's the product over its words. The probabilities come from
expectation maximisation: the expected number of uses of each piece over all segmentations of the training words, with
the pooled use of all languages as prior.

Training reads a bounded sample of labelled rows: about ``train_rows`` per language, chosen by a hash of the id. Its word counts
are gathered by Spark; the model has one number per language and piece, whatever the input size. Prediction reads whole texts.

A null text, or one without a letter, is ``und`` with score 0; so is every text where nothing was there to learn from.
Ties go to the language that sorts first. Rows with a null label teach nothing; a null id is not held out. Repeated rows are
predicted each. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import new_work_dir
from .common import kept, let_go

UNKNOWN_LANGUAGE = "und"
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = "▁"
#: Words are scored in stretches of so many characters, so that no probability falls below what a double can hold.
_STRETCH = 32
_UNKNOWN_CHARACTER = 1e-7
_AROUND = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»„“”‘’…–—¡¿"
_MOST_WORDS = 400_000
_WORDS_AT_ONCE = 8192
_TEXTS_AT_ONCE = 256
_SPREAD = 1 << 20


class Model(NamedTuple):
    """Languages in order, the file of the vocabulary, and a row of probabilities per piece id."""

    languages: list[str]
    vocabulary: str
    probability: np.ndarray


def is_held_out(id_col: str) -> Column:
    """Rows that never teach: those whose id, as text, has a CRC of remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


_tries: dict[str, dict] = kept({})


def _trie(path: str) -> dict:
    """The vocabulary by characters; a piece's id is under the empty string. Loaded once per worker."""
    if path not in _tries:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        root: dict = {}
        for i in range(processor.get_piece_size()):
            if processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i):
                continue
            node = root
            for character in processor.id_to_piece(i):
                node = node.setdefault(character, {})
            node[""] = i
        _tries[path] = root
    return _tries[path]


def _size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def _arcs(word: str, trie: dict) -> list[int]:
    """All pieces in a word, by start, each as one number of start, end and id; an id of -1 is a character that is no piece."""
    found = []
    for start in range(len(word)):
        node, alone = trie, True
        for end, character in enumerate(word[start:], start + 1):
            node = node.get(character)
            if node is None:
                break
            if "" in node:
                found.append((node[""] << 16) + (start << 8) + end)
                alone = False
        if alone:
            found.append((-1 << 16) + (start << 8) + start + 1)
    return found


def canonical(word: str) -> str:
    """A word as it is scored: without punctuation around it, in lower case."""
    return word.strip(_AROUND).lower()


def _stretches(word: str) -> list[str]:
    marked = _SPACE + word
    return [marked[i : i + _STRETCH] for i in range(0, len(marked), _STRETCH)]


def log_likelihoods(words: list[str], trie: dict, probability: np.ndarray) -> np.ndarray:
    """The logarithm of each word's probability in each language, over all segmentations (forward sums, all words at once).

    ``probability`` has a row per piece and, last, one for characters that are no piece.
    """
    parts = [(i, part) for i, word in enumerate(words) for part in _stretches(word)]
    arcs = [_arcs(part, trie) for _, part in parts]
    codes = np.array([c for own in arcs for c in own], dtype=np.int64)
    part_of = np.repeat(np.arange(len(parts)), [len(own) for own in arcs])
    order = np.argsort(codes & 255, kind="stable")  # by end; parts stay in order within an end
    codes, part_of = codes[order], part_of[order]
    end, start, piece = codes & 255, (codes >> 8) & 255, codes >> 16
    forward = np.zeros((_STRETCH + 1, len(parts), probability.shape[1]))
    forward[0] = 1.0
    bounds = np.searchsorted(end, np.arange(_STRETCH + 2))
    for at in range(1, _STRETCH + 1):
        own = slice(bounds[at], bounds[at + 1])
        if own.start == own.stop:
            break
        to = part_of[own]
        first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        forward[at, to[first]] = np.add.reduceat(forward[start[own], to] * probability[piece[own]], first)
    lengths = np.array([len(part) for _, part in parts])
    final = np.log(forward[lengths, np.arange(len(parts))])
    first = np.flatnonzero(np.concatenate(([True], np.diff([i for i, _ in parts]) > 0)))
    return np.add.reduceat(final, first)


def _expected(trie: dict, word: str, row: np.ndarray, weight: float, out: dict) -> None:
    """Adds the expected uses of each piece over all segmentations of a word (forward and backward sums)."""
    for part in _stretches(word):
        arcs = [((c >> 8) & 255, c & 255, c >> 16, row[c >> 16] if c >= 0 else _UNKNOWN_CHARACTER) for c in _arcs(part, trie)]
        forward, backward = [1.0] + [0.0] * len(part), [0.0] * len(part) + [1.0]
        for a, b, _, p in arcs:
            forward[b] += forward[a] * p
        for a, b, _, p in reversed(arcs):
            backward[a] += backward[b] * p
        for a, b, i, p in arcs:
            if i >= 0:
                out[i] = out.get(i, 0.0) + weight * forward[a] * p * backward[b] / forward[-1]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        counts: dict[str, Counter] = {}
        for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.setdefault(language, Counter()).update((text or "").split())
        rows = [(language, canonical(word), n) for language, words in counts.items() for word, n in words.items()]
        rows = [row for row in rows if row[1]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])


def _expectations(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(model.vocabulary)
        place = {language: i for i, language in enumerate(model.languages)}
        columns = [model.probability[:, i].tolist() for i in range(len(model.languages))]
        found: list[dict] = [{} for _ in model.languages]
        for batch in batches:
            for language, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                own = place[language]
                _expected(trie, word, columns[own], n, found[own])
        rows = [(i, piece, n) for i, pieces in enumerate(found) for piece, n in pieces.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.int32(), pa.float64()))], names=["language", "piece", "n"])

    return run


def train(docs: DataFrame, vocabulary: str, train_rows: int = 1000, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the labelled rows that are not held out; of each language, about ``train_rows`` rows."""
    spark = docs.sparkSession
    own = docs.filter(~is_held_out(id_col)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    own = own.filter("lang is not null and text is not null")
    count = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    languages = sorted(count)
    size = _size(vocabulary)
    model = Model(languages, vocabulary, np.full((size, len(languages)), 1.0 / size))
    if not languages:
        return model
    share = F.create_map(*(F.lit(x) for language in languages for x in (language, min(1.0, train_rows / count[language]))))
    sample = own.filter(F.pmod(F.xxhash64("id"), F.lit(_SPREAD)) < share[F.col("lang")] * _SPREAD)
    path = new_work_dir(spark, "words")
    words = sample.select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words.write.parquet(path)
    words = spark.read.parquet(path).repartition("word")
    for _ in range(rounds):
        expected = words.select("lang", "word", "n").mapInArrow(_expectations(model), "language int, piece int, n double")
        found = expected.groupBy("language", "piece").agg(F.sum("n").alias("n")).toArrow()  # at most languages x pieces
        uses = np.zeros((size, len(languages)))
        uses[found.column("piece").to_numpy(), found.column("language").to_numpy()] = found.column("n").to_numpy()
        pooled = uses.sum(axis=1) + 0.5
        pooled /= pooled.sum()
        strength = 0.01 * uses.sum(axis=0) + 1.0
        model = model._replace(probability=(uses + pooled[:, None] * strength) / (uses.sum(axis=0) + strength))
    return model


class _Scorer:
    """Log-likelihoods of texts, with a bounded table of the words met so far."""

    def __init__(self, model: Model):
        self._trie = _trie(model.vocabulary)
        unknown = np.full((1, len(model.languages)), _UNKNOWN_CHARACTER)
        self._probability = np.concatenate([model.probability, unknown])
        self._clear()

    def _clear(self) -> None:
        self._place: dict[str, int] = {}  # written form to row
        self._scored: dict[str, int] = {"": 0}  # canonical form to row; nothing left of a word scores 0
        self._score = np.zeros((1, self._probability.shape[1]))

    def _learn(self, words: set[str]) -> None:
        if len(self._place) > _MOST_WORDS:
            self._clear()
        forms = {word: canonical(word) for word in words.difference(self._place)}
        new = sorted(set(forms.values()).difference(self._scored))
        for at in range(0, len(new), _WORDS_AT_ONCE):
            part = new[at : at + _WORDS_AT_ONCE]
            self._scored.update(zip(part, range(len(self._score), len(self._score) + len(part))))
            self._score = np.concatenate([self._score, log_likelihoods(part, self._trie, self._probability)])
        self._place.update((word, self._scored[form]) for word, form in forms.items())

    def __call__(self, texts: list[str]) -> np.ndarray:
        """The log-likelihood of each text in each language."""
        words = [text.split() for text in texts]
        self._learn(set().union(*words))
        get = self._place.__getitem__
        return np.array([self._score[np.fromiter(map(get, own), dtype=np.int64, count=len(own))].sum(axis=0) for own in words]).reshape(len(texts), -1)


_scorers: dict[bytes, _Scorer] = kept({})


def _scorer(model: Model) -> _Scorer:
    key = model.probability.tobytes()[:65536] + model.vocabulary.encode() + repr(model.languages).encode()
    if key not in _scorers:
        _scorers.clear()  # a worker that goes on to another model drops the old one
        _scorers[key] = _Scorer(model)
    return _scorers[key]


def _predictions(model: Model, text_of: str | None = None):
    """Judgements of the last column, a text, in its place; with ``text_of``, of that field of the rows in the only column, which stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            texts = (last if text_of is None else last.field(last.type.get_field_index(text_of))).cast(pa.string()).to_pylist()
            found, scores = [UNKNOWN_LANGUAGE] * len(texts), [0.0] * len(texts)
            known = [i for i, text in enumerate(texts) if text and model.languages and _LETTER.search(text)]
            for at in range(0, len(known), _TEXTS_AT_ONCE):
                own = known[at : at + _TEXTS_AT_ONCE]
                for i, likelihood in zip(own, scorer([texts[i] for i in own])):
                    best = int(np.argmax(likelihood))
                    found[i] = model.languages[best]
                    scores[i] = round(float(1.0 / np.exp(likelihood - likelihood[best]).sum()), 6)
            kept = batch.num_columns if text_of else batch.num_columns - 1
            columns = [*batch.columns[:kept], pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:kept], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (the posterior with equal priors)."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return own.mapInArrow(_predictions(model), "doc_id long, held_out boolean, lang_pred string, score double")


def judged(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as a struct ``row``, with ``lang_pred`` and ``score``: whatever the columns of ``docs`` are called, nothing clashes."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = StructType([packed.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return packed.mapInArrow(_predictions(model, text_col), schema)


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with a struct column ``language_found`` (``lang_pred``, ``score``); ``docs`` must not have one of that name (see :func:`judged`)."""
    return judged(docs, model, text_col).select("row.*", F.struct("lang_pred", "score").alias("language_found"))
