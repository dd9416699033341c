"""Suffix arrays by Lyndon grouping, in linear time and without recursive renaming, for many short texts at once.

Phase 1 keeps the suffixes in groups by Lyndon prefix (the longest Lyndon word that a suffix starts with). It starts with
groups by first symbol and takes them in descending order. For each suffix of the group it follows previous-smaller
pointers to the nearest position to the left in a lower group; that position's Lyndon prefix grows by this group's, so it
moves to a new group right above its old one, further up the more members of the group point at it.

Phase 2 emits the order: going through the suffix array upwards, each suffix tells the positions whose Lyndon prefix ends
where it begins, and these take the next free places of their groups.

All texts advance together, each by one group or one rank per step, so that each step is a few array operations.
"""

from __future__ import annotations

import numpy as np

GUARD = -1
END = 0


def _firsts(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def _lengths(first: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(first, total))


def lyndon_groups(symbols: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1. Text t is ``symbols[base[t] + 1 : base[t] + size[t] + 1]``, ends in its only ``END``; ``symbols[base[t]]`` is ``GUARD``.

    Returns, per position: the start of its group in the order of all groups, the previous-smaller pointer, and the end
    of its Lyndon prefix.
    """
    n = len(symbols)
    text = np.repeat(np.arange(len(base), dtype=np.int32), size + 1)
    array = np.lexsort((symbols, text)).astype(np.int32)
    place = np.empty(n, dtype=np.int32)
    place[array] = np.arange(n, dtype=np.int32)
    new = _firsts(text[array], symbols[array])
    first = np.flatnonzero(new).astype(np.int32)
    group = np.empty(n, dtype=np.int32)
    group[array] = first[np.cumsum(new) - 1]
    members = np.zeros(n, dtype=np.int32)
    members[first] = _lengths(first, n)
    previous = np.arange(-1, n - 1, dtype=np.int32)
    end = np.arange(1, n + 1, dtype=np.int32)
    guard = symbols == GUARD
    moving = np.zeros(n, dtype=bool)
    low = base.astype(np.int32)
    top = (base + size).astype(np.int32)
    while len(top):
        start = group[array[top]]
        count = top - start + 1
        offset = np.cumsum(count) - count
        own = array[np.repeat(start - offset, count) + np.arange(offset[-1] + count[-1])]
        level = group[own]
        left = previous[own]
        todo = np.flatnonzero(group[left] >= level)
        while len(todo):
            further = previous[left[todo]]
            left[todo] = further
            previous[own[todo]] = further
            todo = todo[group[further] >= level[todo]]
        real = ~guard[left]
        own, left = own[real], left[real]
        top = start - 1
        going = top > low
        top, low = top[going], low[going]
        if not len(own):
            continue
        order = np.argsort(left.astype(np.int64) * n + own)
        own, left = own[order], left[order]
        first = np.flatnonzero(_firsts(left))
        times = _lengths(first, len(left))
        grown = left[first]
        end[grown] = end[own[first + times - 1]]
        was = group[grown]
        order = np.lexsort((times, was))
        grown, times, was = grown[order], times[order], was[order]
        first = np.flatnonzero(_firsts(was))
        moved = _lengths(first, len(was)).astype(np.int32)
        tail = was + members[was] - np.repeat(moved, moved)
        slot = tail + (np.arange(len(was)) - np.repeat(first, moved)).astype(np.int32)
        moving[grown] = True
        there = array[slot]
        displaced = there[~moving[there]]
        moving[grown] = False
        vacated = place[grown]
        vacated = vacated[vacated < tail]
        array[vacated] = displaced
        place[displaced] = vacated
        array[slot] = grown
        place[grown] = slot
        members[was[first]] -= moved
        runs = np.flatnonzero(_firsts(was, times))
        length = _lengths(runs, len(was))
        members[slot[runs]] = length
        group[grown] = np.repeat(slot[runs], length)
    return group, previous, end


def suffix_arrays(symbols: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All suffix arrays side by side: places ``base[t] + 1`` to ``base[t] + size[t]`` hold the positions of text t in order."""
    group, previous, end = lyndon_groups(symbols, base, size)
    free = np.arange(len(symbols), dtype=np.int32)
    out = np.full(len(symbols), -1, dtype=np.int32)
    guard = symbols == GUARD
    out[base] = base
    out[base + 1] = base + size
    rank = (base + 1).astype(np.int32)
    final = (base + size).astype(np.int32)
    while len(rank):
        suffix = out[rank]
        before = suffix - 1
        while True:
            fits = (end[before] == suffix) & ~guard[before]
            if not fits.any():
                break
            before, suffix = before[fits], suffix[fits]
            own = group[before]
            slot = free[own]
            out[slot] = before
            free[own] = slot + 1
            before = previous[before]
        going = rank < final
        rank, final = rank[going] + 1, final[going]
    return out
