"""Two-stage suffix sorting of a byte array: sort only suffixes smaller than their successors, induce the rest."""

from __future__ import annotations

import numpy as np


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    out = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        out |= padded[k : k + len(out)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """For each suffix: is it smaller than the one that starts a place later. The last is not."""
    n = len(data)
    if n == 0:
        return np.zeros(0, bool)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def needed_for(wanted: np.ndarray, small: np.ndarray) -> np.ndarray:
    """wanted, and after each wanted suffix those it is induced from, up to the first that is sorted directly."""
    n = len(wanted)
    places = np.arange(n)
    last = np.maximum.accumulate(np.where(wanted, places, -1))
    stop = np.maximum.accumulate(np.where(small, places, -1))
    before = np.concatenate([[-1], stop[:-1]])
    return wanted | ((last >= 0) & (before < last))


def sort_direct(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """places in the order of their suffixes' first depth bytes (rounded up to eight); equal ones in any order."""
    if not len(places):
        return places
    order = np.argsort(words[places], kind="stable")
    places = places[order]
    head = words[places]
    new = np.concatenate([[True], head[1:] != head[:-1]])
    for at in range(8, depth, 8):
        tied = ~(new & np.concatenate([new[1:], [True]]))
        if not tied.any():
            break
        sub = places[tied]
        group = np.cumsum(new)[tied]
        key = words[np.minimum(sub + at, len(words) - 1)]
        order = np.lexsort((key, group))
        sub, key, group = sub[order], key[order], group[order]
        places[tied] = sub
        new[tied] = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
    return places


def two_stage(data: np.ndarray, wanted: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """The wanted places in the order of their suffixes, as far as depth bytes tell.

    Suffixes smaller than their successors are sorted directly. In the bucket of a first byte the others come before
    them, in the order of their successors, which a scan of the buckets in ascending order already knows; those in a run
    of the same byte follow wave by wave, the run's last place first."""
    words = words_at(data) if words is None else words
    small = smaller_than_next(data)
    need = needed_for(wanted, small)
    direct = sort_direct(words, np.flatnonzero(need & small), depth)
    rest = np.flatnonzero(need & ~small)
    n_direct, n_rest = np.bincount(data[direct], minlength=256), np.bincount(data[rest], minlength=256)
    begin = np.concatenate([[0], np.cumsum(n_direct + n_rest)])
    rank = np.full(len(data) + 1, -1, np.int64)
    within = np.arange(len(direct)) - np.repeat(np.concatenate([[0], np.cumsum(n_direct)[:-1]]), n_direct)
    rank[direct] = begin[data[direct]] + n_rest[data[direct]] + within
    if len(rest):
        same = np.concatenate([data[1:] == data[:-1], [False]])
        ends = np.where(~same, np.arange(len(data)), len(data))
        wave = (np.minimum.accumulate(ends[::-1])[::-1] - np.arange(len(data)))[rest]
        order = np.lexsort((wave, data[rest]))
        rest, wave, first = rest[order], wave[order], data[rest[order]]
        cuts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (wave[1:] != wave[:-1])]))
        at = begin[first[cuts]] + cuts - np.concatenate([[0], np.cumsum(n_rest)])[first[cuts]]
        for b, e, r in zip(cuts, np.append(cuts[1:], len(rest)), at, strict=True):
            own = rest[b:e]
            rank[own[np.argsort(rank[own + 1], kind="stable")]] = np.arange(r, r + e - b)
    out = np.empty(begin[-1], np.int64)
    held = np.concatenate([direct, rest])
    out[rank[held]] = held
    return out[wanted[out]]


def adjacent_prefix(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order but the first: do at least depth first bytes agree with the one before it."""
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    last = len(words) - 1
    for at in range(0, depth - 7, 8):
        same &= words[np.minimum(a + at, last)] == words[np.minimum(b + at, last)]
    if depth % 8:
        at = depth - depth % 8
        shift = np.uint64(64 - 8 * (depth % 8))
        same &= (words[np.minimum(a + at, last)] >> shift) == (words[np.minimum(b + at, last)] >> shift)
    return same
