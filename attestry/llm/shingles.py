"""Word shingle sets of texts, as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .common import mix, prefix_hash, span_hash

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(9, 14)]] = True
M = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(parts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, cuts) of the texts' distinct k-word shingles; those of text i are hashes[cuts[i]:cuts[i + 1]], sorted.

    A-Z is lower-cased and words are runs without ASCII white space. With fewer than k words the whole sequence is one
    shingle; without words there is none."""
    data = np.frombuffer(b" " + b" ".join(x.lower() for x in parts) + b" ", np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in parts])]).astype(np.int64) + 1
    white = WHITE[data]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        word = span_hash(prefix_hash(data), begin, end)
        doc = np.searchsorted(starts, begin, side="right") - 1
        total = np.bincount(doc, minlength=len(parts))
        n = len(word) - k + 1
        if n > 0:
            held = word[:n].copy()
            for j in range(1, k):
                held = mix(held * M + word[j : n + j])
            ok = doc[:n] == doc[k - 1 :]
            held, of = held[ok], doc[:n][ok]
        else:
            held, of = word[:0], doc[:0]
        short = np.flatnonzero((total > 0) & (total < k))
        if len(short):
            first = np.concatenate([[0], np.cumsum(total)])
            extra = np.empty(len(short), np.uint64)
            for i, d in enumerate(short.tolist()):
                h = np.uint64(int(total[d]))
                for w in word[first[d] : first[d + 1]]:
                    h = mix(h * M + w)
                extra[i] = h
            held, of = np.concatenate([held, extra]), np.concatenate([of, short])
            order = np.argsort(of, kind="stable")
            held, of = held[order], of[order]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(parts)))])
    for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if e - b > 1:
            held[b:e].sort()
    if len(held):
        new = np.concatenate([[True], (held[1:] != held[:-1]) | (of[1:] != of[:-1])])
        held, of = held[new], of[new]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(parts)))])
    return held, cuts
