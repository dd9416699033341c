"""Token ids of texts by a public byte-level BPE, exactly as the tokenizers library gives them for the whole text.

The pre-tokenizer of this vocabulary never joins a character to a following space, so a text falls into parts at single
spaces (each with the space before it) that can be encoded apart; encoded parts are kept in a bounded table. Texts
where white space runs into such a space from both sides, or that hold the string of an added token, are encoded whole. Null and empty texts
have no ids; texts of any length are encoded to the end.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from .common import kept, let_go

_RUN = re.compile(r"\s (?=\s|\Z)")
#: What the pre-tokenizer makes of printable ASCII without white space and apostrophes (those have rules of their own).
_PLAIN = re.compile(r"[!-&(-~]+")
_PIECES = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+")
_MOST = 300_000
_MOST_BARE = 100_000


def _byte_table() -> dict[int, str]:
    """Byte-level alphabets print the bytes that have a visible Latin-1 form as they are, and the rest from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


class _Alphabet(dict):
    """Characters by their code, as the byte-level alphabet prints them; made when first met."""

    def __init__(self):
        self._bytes = _byte_table()

    def __missing__(self, code: int) -> str:
        found = self[code] = "".join(self._bytes[b] for b in chr(code).encode())
        return found


class ByteBpe:
    """A byte-level BPE with a table of the parts it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        # The strings of added tokens stand for their tokens wherever they are; texts that hold one are encoded whole.
        self._added = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._model = self._whole.model
        self.size = self._whole.get_vocab_size()
        self.kind, self._code = (np.dtype("<u2"), "H") if self.size <= 1 << 16 else (np.dtype("<u4"), "I")
        self._alphabet = _Alphabet()
        self._lead = self._alphabet[ord(" ")]
        self._line_end = self._printed_ids(self._alphabet[ord("\n")])
        #: Parts by their text, each with the space before it, and parts without one.
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._bare: dict[str, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        return array(self._code, ids).tobytes()

    def _model_ids(self, lead: str, word: str) -> bytes:
        """The ids of what the pre-tokenizer keeps as one."""
        return self._printed_ids(lead + (word if word.isascii() else word.translate(self._alphabet)))

    def _printed_ids(self, text: str) -> bytes:
        return array(self._code, [t.id for t in self._model.tokenize(text)]).tobytes()

    def _piece(self, space: str, word: str) -> bytes:
        """The same from the tables, where it is kept."""
        if not space:
            found = self._bare.get(word)
            if found is None:
                if len(self._bare) > _MOST_BARE:
                    self._bare.clear()
                found = self._bare[word] = self._model_ids("", word)
            return found
        found = self._known.get(word) or self._older.get(word) or self._model_ids(self._lead, word)
        self._known[word] = found
        return found

    def _part(self, space: str, part: str) -> bytes:
        """The ids of a part without white space at its ends, or of any part by the whole tokenizer."""
        if part.isalpha():
            return self._model_ids(self._lead, part) if space else self._piece(space, part)
        if part[:-1].isalpha() and part[-1] in ",.":
            return self._piece(space, part[:-1]) + self._piece("", part[-1])
        if _PLAIN.fullmatch(part):
            first, *rest = _PIECES.findall(part)
            return self._piece(space, first) + b"".join([self._piece("", p) for p in rest])
        line, found, rest = part.partition("\n")
        if found and line and rest and not line[-1].isspace() and not rest[0].isspace():
            return self._part(space, line) + self._line_end + self._part("", rest)
        return self._packed(self._whole.encode(space + part, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        """The ids as packed numbers of type ``kind``."""
        if _RUN.search(text) or any(token in text for token in self._added):
            return self._packed(self._whole.encode(text, add_special_tokens=False).ids)
        first, *parts = text.split(" ")
        if len(self._known) > _MOST:
            # What has been in use since the last turn stays at hand, so common parts are never encoded again.
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        for part in set(parts).difference(known):
            known[part] = older.get(part) or self._part(" ", part)
        start = self._part("", first) if first else b""
        return start + b"".join(map(known.__getitem__, parts))


_loaded: dict[str, ByteBpe] = kept({})


def byte_bpe(path: str) -> ByteBpe:
    """The tokenizer of a file, once per worker."""
    if path not in _loaded:
        let_go()
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
