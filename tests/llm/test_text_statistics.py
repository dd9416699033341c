import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge_cases import edge_docs, edge_rows, no_docs
from tallygrid.llm import langid, mixing
from tallygrid.llm.queries import PIECES, public_file


def every_cut(word):
    for cuts in product([False, True], repeat=len(word) - 1):
        parts, at = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(word[at:i])
                at = i
        yield [*parts, word[at:]]


def test_forward_sums_all_segmentations():
    trie: dict = {}
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "abab"]
    for number, piece in enumerate(pieces):
        node = trie
        for character in piece:
            node = node.setdefault(character, {})
        node[""] = number
    rng = np.random.default_rng(1)
    probability = np.concatenate([rng.random((len(pieces), 3)), np.full((1, 3), 1e-7)])
    words = ["a", "abab", "bbaab", "xa", "ab" * 5]
    found = langid.log_likelihoods(words, trie, probability)
    for word, own in zip(words, found):
        total = np.zeros(3)
        for parts in every_cut("▁" + word):
            if all(p in pieces or p == "x" for p in parts):
                total += np.prod([probability[pieces.index(p)] if p in pieces else probability[-1] for p in parts], axis=0)
        assert np.allclose(own, np.log(total))


def test_long_words_do_not_underflow():
    trie = langid._trie(public_file(PIECES))
    size = langid._size(public_file(PIECES))
    probability = np.full((size + 1, 2), 1e-6)
    found = langid.log_likelihoods(["qz" * 5000, "\U0001f600" * 300], trie, probability)
    assert np.isfinite(found).all()


def corpus(spark, count=400):
    rng = random.Random(1)
    sounds = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "eit", "der"], "cc": ["eau", "oux", "tion", "que"]}
    rows = []
    for i in range(count):
        language = rng.choice(list(sounds))
        text = " ".join("".join(rng.choice(sounds[language]) for _ in range(rng.randrange(1, 4))) for _ in range(30))
        rows.append((i, text, language if rng.random() < 0.9 else None, language))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_held_out_documents_are_told_right(spark):
    docs = corpus(spark)
    model = langid.train(docs, public_file(PIECES), train_rows=50)
    assert model.languages == ["aa", "bb", "cc"] and np.allclose(model.probability.sum(axis=0), 1.0)
    found = langid.predict(docs, model).join(docs.select("doc_id", "truth"), "doc_id")
    told = found.filter("held_out").selectExpr("avg(cast(lang_pred = truth as int)) AS right", "count(*) AS n").first()
    assert told["right"] > 0.98 and told["n"] > 50
    assert found.filter("score < 0 or score > 1").count() == 0


def test_held_out_labels_teach_nothing(spark):
    docs = corpus(spark)
    changed = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 4 = 2, 'zz', lang) AS lang", "truth")
    one, other = (langid.train(d, public_file(PIECES), train_rows=10**6) for d in (docs, changed))
    assert one.languages == other.languages and np.allclose(one.probability, other.probability)


def test_languages_of_edge_cases(spark):
    docs = edge_docs(spark)
    model = langid.train(docs, public_file(PIECES))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert found[500] == found[502] == found[503] == ("und", 0.0) and found[504][0] in model.languages
    kept = langid.with_language(docs, model)
    assert kept.columns == [*docs.columns, "language_found"] and kept.count() == len(edge_rows())
    nothing = langid.train(no_docs(spark), public_file(PIECES))
    assert nothing.languages == [] and {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(no_docs(spark), model).count() == 0


def test_raking_meets_all_marginals():
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 1000, 60)
    places = [np.repeat(np.arange(3), 20), np.tile(np.arange(4), 15), rng.integers(0, 2, 60)]
    targets = [np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.6, 0.4])]
    mass = tokens * mixing.rake(tokens, places, targets)
    for place, target in zip(places, targets):
        assert np.allclose(np.bincount(place, weights=mass) / mass.sum(), target, atol=1e-6)


def test_probabilities_give_the_wanted_share():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.05, 0.5, 0.99, 1.0):
        tokens, factor = rng.integers(0, 1000, 50), rng.random(50) ** 3 * 9 + 1e-3
        found = mixing.probabilities(tokens, factor, share)
        assert ((found >= 0) & (found <= 1)).all() and tokens @ found == pytest.approx(share * tokens.sum())
        assert (np.diff(found[np.argsort(factor)]) >= -1e-12).all()


def test_samples_follow_the_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"word{rng.randrange(500)}" for _ in range(20)), rng.choice("aaab"), rng.choice(["x", None])) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    mix = mixing.Mix(docs, targets={"source": {"a": 0.5, "b": 0.5, "missing": 0.7}}, share=0.3)
    sample = mix.sample(docs)
    taken = {r["source"]: r["n"] for r in sample.groupBy("source").sum("n_tokens").withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert sum(taken.values()) == pytest.approx(0.3 * 80_000, rel=0.1)
    assert taken["a"] == pytest.approx(taken["b"], rel=0.15)
    assert sorted(r["doc_id"] for r in sample.select("row.doc_id").collect()) == sorted(r["doc_id"] for r in mix.sample(docs).select("row.doc_id").collect())


def many_sources(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"word{rng.randrange(500)}" for _ in range(5 if i % 300 > 280 else 10)), "other" if i % 300 == 299 else f"s{i % 300}", rng.choice(["x", "y", None])) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def shares(mix, docs):
    """Expected tokens and number of probabilities by source."""
    profile = mixing._profiled(docs.select(*(F.col(d) for d in ("source", "lang", "text"))), "text").withColumn("cell", mix._key())
    return {r["source"]: r["n"] for r in profile.join(mix._cells, "cell").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("n")).collect()}


def test_all_sources_meet_their_targets(spark):
    docs = many_sources(spark)
    names = [f"s{i}" for i in range(299)] + ["other"]
    target = {name: 1.0 + i % 2 for i, name in enumerate(names)}
    found = shares(mixing.Mix(docs, targets={"source": target}, share=0.1), docs)
    total = sum(found.values())
    assert len(found) == 300 and all(found[n] / total == pytest.approx(target[n] / sum(target.values()), rel=1e-6) for n in names)


def test_a_named_source_is_told_apart_from_the_rest(spark):
    docs = many_sources(spark)
    mix = mixing.Mix(docs, targets={"source": {"s290": 0.5, "other": 0.25, "other_": 0.25}}, share=0.0005, most_values=5)
    cells = {r["source"] for r in mix.sample(docs).collect()}
    assert {"s290", "other"} <= set(mix.values["source"]) and mix.other["source"] == "other_" and cells <= {"s290", "other", "other_"}
    known = mixing._profiled(docs.select("source", "lang", "text"), "text").select("n_tokens", *(mix._folded(d) for d in mixing.DIMENSIONS)).withColumn("cell", mix._key())
    found = {r["source"]: r["n"] for r in known.join(mix._cells, "cell").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("n")).collect()}
    total = sum(found.values())
    assert found["s290"] / total == pytest.approx(0.5, rel=1e-6) and found["other"] / total == pytest.approx(0.25, rel=1e-6)


@pytest.mark.parametrize("targets, share", [(None, 0.5), ({"source": {"s1": 0.5, "s290": 0.3, "other": 0.2, "missing": 1.0}, "lang": {"x": 0.7, None: 0.3}}, 0.01)])
def test_many_cells_are_raked_as_few(spark, monkeypatch, targets, share):
    docs = many_sources(spark).filter("doc_id % 300 in (1, 2, 3, 290, 299)").coalesce(1)
    monkeypatch.setattr(mixing, "ROUNDS", 3)
    few = {r["cell"]: (r["probability"], r["weight"]) for r in mixing.Mix(docs, targets, share)._cells.collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    many = {r["cell"]: (r["probability"], r["weight"]) for r in mixing.Mix(docs, targets, share)._cells.collect()}
    assert few.keys() == many.keys()
    assert all(many[c] == pytest.approx(few[c], rel=1e-6, abs=1e-9) for c in few)
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert {r["probability"] for r in mixing.Mix(blank, share=0.5)._cells.collect()} == {0.5}


def test_mixing_edge_cases(spark):
    docs = edge_docs(spark)
    everything = mixing.Mix(docs, share=1.0).sample(docs).select("row.*")
    assert everything.columns == docs.columns and everything.count() == len(edge_rows())
    few = mixing.Mix(docs, share=1.0, most_values=1)
    assert few.sample(docs).count() == len(edge_rows()) and {r["source"] for r in few.sample(docs).collect()} <= {"s0", "other", None}
    assert mixing.Mix(no_docs(spark)).sample(no_docs(spark)).count() == 0
    blank = spark.createDataFrame([(i, None, "s", "l") for i in range(400)], "doc_id long, text string, source string, lang string")
    assert 120 < mixing.Mix(blank, share=0.5).sample(blank).count() < 280
