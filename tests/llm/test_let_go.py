import pyarrow as pa

from tallygrid.llm import common, langid, tokens
from tallygrid.llm.queries import TOKENIZER, public_file


def test_learning_languages_lets_go_of_the_tokenizer():
    tokens.byte_bpe(public_file(TOKENIZER)).ids("some words of a text")
    assert tokens._loaded
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["One word, one"]})
    counted = pa.Table.from_batches(langid._word_counts(iter([batch])))
    assert not tokens._loaded
    assert sorted(zip(*counted.to_pydict().values())) == [("en", "one", 1), ("en", "one", 1), ("en", "word", 1)]


def test_letting_go_returns_memory_to_the_machine(monkeypatch):
    returned = []
    monkeypatch.setattr(common, "_trim", returned.append)
    common.let_go()
    assert returned == [0]


def test_loading_the_tokenizer_lets_go_of_the_language_model():
    tokens._loaded.clear()
    langid._scorers[b"model"] = "a scorer"
    tokens.byte_bpe(public_file(TOKENIZER))
    assert not langid._scorers and tokens._loaded
