"""Anchors: a few positions of a text, chosen by its content, so that equal windows have equal anchors."""

from __future__ import annotations

import numpy as np

from .hashing import MAX_RUN, Runs, combine, window_minima

_STRIDE = MAX_RUN - (1 << 12)


def anchors(symbols: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all windows of ``window`` symbols.

    The anchor of a window is the first of its runs of ``seed`` symbols with the least hash. Windows that follow one
    another and share an anchor form one range, so each window belongs to one range. Returns, per range: the hash of
    its anchor, a hash of all symbols its windows cover together with the anchor's place in them, the first window and
    the last window. Two ranges with equal second hash cover the same symbols.
    """
    parts = []
    n = len(symbols)
    at = 0
    while n - at >= window:
        part = symbols[at : at + _STRIDE + window - 1]
        hashes = Runs(part)
        runs = hashes.all(seed)
        chosen = window_minima(runs, window - seed + 1)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        last = np.concatenate((first[1:], [len(chosen)])) - 1
        place = chosen[first]
        shape = ((place - first) * 65536 + (last - first)).astype(np.uint64)
        parts.append((runs[place], combine(combine(hashes.at(first, window), hashes.at(last, window)), shape), first + at, last + at))
        at += _STRIDE
    if not parts:
        none = np.zeros(0, dtype=np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))
