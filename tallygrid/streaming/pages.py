"""State of many keys per call, kept in pages.

Spark's Python state takes a round trip per entry that is read or written. A page holds some hundred entries as one entry of a map state, so a
call reads and writes the pages that its keys lie in. Pages divide as entries come, so they stay small however many entries a bucket holds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from ..session import by_value

by_value(__name__)

#: Entries of a page on average, before the pages of a bucket divide.
PAGE = 256


class Pages:
    """Entries by text key, as lists of what JSON holds. Every call opens the pages first and saves them last."""

    def __init__(self, handle: StatefulProcessorHandle, name: str) -> None:
        self._stored = handle.getMapState(name, "page bigint", "held string")
        self._size = handle.getValueState(f"{name}Size", "bits int, entries bigint")

    def open(self) -> None:
        size = self._size.get() if self._size.exists() else None
        self._known = size is not None
        self._bits, self._entries = (0, 0) if size is None else (int(size[0]), int(size[1]))
        self._before = self._bits, self._entries
        self._loaded: dict[int, dict[str, list]] = {}
        self._changed: set[int] = set()

    def _at(self, key: str) -> int:
        return crc32(key.encode()) & ((1 << self._bits) - 1)

    def _page(self, at: int) -> dict[str, list]:
        page = self._loaded.get(at)
        if page is None:
            stored = self._stored.getValue((at,)) if self._known else None
            page = {} if stored is None else {key: value for key, *value in json.loads(stored[0])}
            self._loaded[at] = page
        return page

    def get(self, key: str) -> list | None:
        return self._page(self._at(key)).get(key)

    def put(self, key: str, value: list | tuple) -> None:
        at = self._at(key)
        page = self._page(at)
        self._entries += key not in page
        page[key] = value
        self._changed.add(at)

    def remove(self, key: str) -> None:
        at = self._at(key)
        if self._page(at).pop(key, None) is not None:
            self._entries -= 1
            self._changed.add(at)

    def items(self) -> Iterator[tuple[str, list]]:
        for at in range(1 << self._bits):
            yield from list(self._page(at).items())

    def save(self) -> None:
        if self._entries > PAGE << self._bits:
            held = list(self.items())
            while self._entries > PAGE << self._bits:
                self._bits += 1
            self._loaded = {at: {} for at in range(1 << self._bits)}
            for key, value in held:
                self._loaded[self._at(key)][key] = value
            self._changed = set(self._loaded)
        for at in sorted(self._changed):
            self._stored.updateValue((at,), (json.dumps([(key, *value) for key, value in self._loaded[at].items()], separators=(",", ":")),))
        if not self._known or (self._bits, self._entries) != self._before:
            self._size.update((self._bits, self._entries))
        self._loaded, self._changed = {}, set()


def entries(held: Column) -> Column:
    """The entries of a stored page: an array of arrays of text, each with the key first."""
    return F.from_json(held, "array<array<string>>")
