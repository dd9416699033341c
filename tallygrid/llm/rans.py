"""Range asymmetric numeral system over token ids, with many interleaved lanes as numpy arrays.

A block of ids is dealt over ``lanes`` states: id i goes to lane i mod lanes, so one step handles as many ids as there are
lanes. States are 64-bit numbers kept at or above 2^31; a lane gives off or takes in 32 bits at a time. All blocks share one
static table of frequencies that add up to 2^20. Every ``every`` steps the states are stored (a checkpoint), so a
block can be decoded from any checkpoint on, in parallel with its other parts.
"""

from __future__ import annotations

import numpy as np

SCALE = 20
_LOW = np.uint64(1 << 31)
_BITS = np.uint64(32)
_SHIFT = np.uint64(SCALE)
_SLOT = np.uint64((1 << SCALE) - 1)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2^SCALE; every id that occurs keeps at least 1. At most 2^SCALE ids may occur."""
    total, scale = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), dtype=np.uint64)
    if np.count_nonzero(counts) > scale:
        raise ValueError("more distinct ids than the table has room for")
    exact = counts * (scale / total)
    found = np.where(counts > 0, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
    rest = scale - int(found.sum())
    order = np.argsort(found - exact, kind="stable")
    order = order[counts[order] > 0]
    if rest > 0:
        found += np.bincount(order[np.arange(rest) % len(order)], minlength=len(counts))
    while rest < 0:  # too many ids at 1: the most frequent ones pay, largest first
        largest = np.argsort(-found, kind="stable")
        largest = largest[found[largest] > 1][:-rest]
        found[largest] -= 1
        rest += len(largest)
    return found.astype(np.uint64)


class Table:
    """Frequencies with their running sums and the id of each slot."""

    def __init__(self, frequency: np.ndarray):
        self.frequency = frequency.astype(np.uint64)
        self.before = np.cumsum(self.frequency) - self.frequency
        self.symbol = np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency.astype(np.int64))


def encode(ids: np.ndarray, table: Table, lanes: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 32-bit words of a block, and per checkpoint the number of words before it and the states of all lanes."""
    steps = -(-len(ids) // lanes)
    frequency, before = table.frequency[ids], table.before[ids]
    limit = frequency << np.uint64(63 - SCALE)
    state = np.full(lanes, _LOW, dtype=np.uint64)
    words, at, states, given = [], [], [], 0
    for step in range(steps - 1, -1, -1):
        own = slice(step * lanes, min((step + 1) * lanes, len(ids)))
        x = state[: own.stop - own.start]
        full = x >= limit[own]
        if full.any():
            out = x[full]
            words.append(out.astype(np.uint32))
            given += len(out)
            x[full] = out >> _BITS
        whole = x // frequency[own]
        x[:] = (whole << _SHIFT) + (x - whole * frequency[own]) + before[own]
        if step % every == 0:
            at.append(given)
            states.append(state.copy())
    joined = np.concatenate(words[::-1]) if words else np.zeros(0, dtype=np.uint32)
    return joined, given - np.array(at[::-1], dtype=np.int64), np.array(states[::-1], dtype=np.uint64).reshape(-1, lanes)


def decode(words: np.ndarray, at: np.ndarray, states: np.ndarray, n: int, table: Table, every: int, checkpoint: int = 0, parts: int | None = None) -> np.ndarray:
    """The ids from a checkpoint on, of ``parts`` checkpoints (all that follow by default)."""
    lanes = states.shape[1]
    last = len(states) if parts is None else min(len(states), checkpoint + parts)
    first_id, end_id = checkpoint * every * lanes, min(n, last * every * lanes)
    out = np.empty(max(0, end_id - first_id), dtype=np.uint32)
    if not len(out):
        return out
    state, taken = states[checkpoint].copy(), int(at[checkpoint])
    for start in range(0, len(out), lanes):
        x = state[: min(lanes, len(out) - start)]
        slot = x & _SLOT
        symbol = table.symbol[slot]
        out[start : start + len(x)] = symbol
        x[:] = table.frequency[symbol] * (x >> _SHIFT) + slot - table.before[symbol]
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = (x[low] << _BITS) | words[taken : taken + len(low)]
            taken += len(low)
    return out
