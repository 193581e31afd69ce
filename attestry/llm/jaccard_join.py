"""Jaccard self-join of shingle sets: groups of tokens select, an R-tree over count vectors bounds, sets verify.

Two sets x, y with Jaccard similarity of at least a/b differ in at most r = floor(min(|x|, |y|) (b - a) / a) tokens. So
of n groups of tokens that a set sends a key for, made of the group's tokens, linked sets share all but r. In any order
of all keys their first common key is therefore among the first r + 1 keys of both. The order is by frequency: keys of
passages that many documents hold come last and select nothing. D leaves room for groups that are empty or too light;
the few documents with more of them than that are dealt again and then share a key made for them. Size classes see to it
that both sides use the same D: a document sends keys for its own class and for the one below.

1. Groups of documents send each bucket their distinct keys; it answers with those of several documents and how many.
   Groups send those among a document's first r + 1 once more, with one leader each; buckets emit edges leader - least
   leader; members of a group are tied to their leader where they are.
2. Components of these edges are the candidates; only their members' texts are read again. Small ones are dealt to blocks
   together; one of more than PART members is dealt out over parts, each of which also gets HUBS of them.
3. Members first send count vectors (tokens per group, more groups for larger sets). In a block an R-tree over them leaves
   out subtrees whose summed coordinate minima cannot reach the overlap needed; what is left makes smaller components.
4. Members of those send their sets, and pairs are verified in blocks in the same way, unless already connected.
   Members of a large candidate component that its first hub doesn't reach, through other hubs and members of their
   part, are compared with all its other parts.
5. Components of the verified links are the result."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NULL_ID, UPPER, WHITE_CLASS, blob, column, exact_copies, group_count, light, mix, slices, stored
from .components import components
from .shingles import M, shingle_sets
from .suffix_dedup import _batches, bucket_of, split_by

SLICE = 1 << 20
WORD = r"[^\x20\x09-\x0D]"
PART = 2048
#: A component of more members is dealt out over parts; so many of its members go to all of them.
HUBS = 16
DIMS = 32
FANOUT = 16
SALT = np.uint64(0xD6E8FEB86659FD93)


#: Sets of a class from this size on send keys of groups with two tokens or more only.
TWO_FROM = 32
#: Members of candidate components are broadcast up to so many rows (32 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


#: Rounds of groups: a set with too many light groups is dealt again by another hash.
ROUNDS = 4
#: A set should have so many times the r + 1 keys that it needs, so that its most frequent ones select nothing.
SPARE = 1.75
#: Stands for r + 1 where a set's keys select by any one of them.
EVERY = 1 << 30


def too_light(l: int, r: int, d: int, need: int) -> float:
    """A bound of the share of sets of l tokens with more than d - r - 1 of d groups below need tokens."""
    s, load = d - r - 1, l / d
    light = math.exp(-load) * (1 + load * (need - 1))
    q = min(0.999, (s + 1) / d)
    bound = math.exp(-d * (q * math.log(q / light) + (1 - q) * math.log((1 - q) / (1 - light)))) if q > light else 1.0
    return min(bound, math.comb(d, s + 1) * (1 - (s + 1) / d) ** l) if need == 1 and d < 500 else bound


@lru_cache(8)
def classes(a: int, b: int, largest: int = 1 << 31) -> tuple[np.ndarray, np.ndarray]:
    """(smallest size; r, D, slack and least tokens of a group that sends a key) of each size class.

    Sizes that can be linked are in one class or in neighbouring ones. D is 0 where sets differ in so few tokens that
    they send keys of what is left without them instead."""

    def groups(l: int, u: int, r: int) -> tuple[int, int] | None:
        for spare in (SPARE, 0):
            for need, most in ((2, 0.6 * l), (1, 4 * u)) if l >= TWO_FROM else ((1, 4 * u),):
                d = r + 2
                while d < most and (too_light(l, r, d, need) > 0.02 or d * (1 - math.exp(-l / d) * (1 + l / d * (need - 1))) < spare * (r + 1)):
                    d += max(1, d // 64)
                if d < most:
                    return d, need
        return d, need

    low, rows = [1], []
    while low[-1] <= largest:
        l = low[-1]
        low.append(l * b // a + 1)
        u = low[-1] - 1
        r = u * (b - a) // a
        if r <= 1 or (r == 2 and u <= 12):
            rows.append((r, 0, 0, 0))
            continue
        d, need = groups(l, u, r)
        rows.append((r, d, d - r - 1, need))
    return np.array(low[:-1], np.int64), np.array(rows, np.int64).T


def keys_of(held: np.ndarray, cuts: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, section, most) of the keys of shingle sets.

    A section holds the keys that a document sends for one class in one round; the most rarest of them select."""
    low, (differ, groups, slack, least) = classes(a, b)
    size = np.diff(cuts)
    n = len(size)
    own = np.searchsorted(low, size, side="right") - 1
    of = np.repeat(np.arange(n), size)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def note(keys: np.ndarray, docs: np.ndarray, section: int, most: np.ndarray | None = None):
        out.append((keys, docs, section * n + docs, np.full(len(docs), EVERY) if most is None else most[docs]))

    with np.errstate(over="ignore"):
        mixed = mix(held ^ SALT)
        total = np.zeros(n, np.uint64)
        np.add.at(total, of, mixed)
        for back in (0, 1):
            cls = np.maximum(own - back, 0)
            use = (size > 0) & (own - back >= 0)
            most = np.minimum(differ[cls], size * (b - a) // a) + 1
            section = back * (ROUNDS + 1)
            tag = mix((cls.astype(np.uint64) << np.uint64(40)) + np.uint64(1))
            few = use & (groups[cls] == 0)
            at = np.flatnonzero(few)
            note(mix(total[at] ^ tag[at]), at, section)
            one = np.flatnonzero((few & (differ[cls] >= 1))[of])
            note(mix((total[of[one]] - mixed[one]) ^ tag[of[one]]), of[one], section)
            for d in np.flatnonzero(few & (differ[cls] == 2)):
                m = mixed[cuts[d] : cuts[d + 1]]
                i, j = np.triu_indices(len(m), 1)
                note(mix((total[d] - m[i] - m[j]) ^ tag[d]), np.full(len(i), d), section)
            rest = use & (groups[cls] > 0)
            for turn in range(ROUNDS):
                if not rest.any():
                    break
                d = np.where(rest, groups[cls], 0)
                first = np.concatenate([[0], np.cumsum(d)])
                at = np.flatnonzero(rest[of])
                h, o = mix(held[at] + np.uint64(turn) * M), of[at]
                index = first[o] + ((h >> np.uint64(32)) * d[o].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                sums, count = np.zeros(first[-1], np.uint64), np.bincount(index, minlength=first[-1])
                np.add.at(sums, index, mixed[at])
                doc = np.repeat(np.arange(n), d)
                nth = (np.arange(first[-1]) - first[doc] + 2).astype(np.uint64) + (np.uint64(turn) << np.uint64(36))
                full = count >= least[cls][doc]
                note(mix(sums[full] ^ mix((cls[doc[full]].astype(np.uint64) << np.uint64(40)) + nth[full])), doc[full], section + 1 + turn, most)
                rest = rest & (d - np.bincount(doc[full], minlength=n) > slack[cls])
            odd = np.flatnonzero(rest)
            note(mix(cls[odd].astype(np.uint64) + SALT), odd, section)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def packed(ids: np.ndarray) -> bytes:
    """Integers as a base and 32-bit differences where they fit."""
    base = int(ids.min())
    if int(ids.max()) - base < 1 << 32:
        return np.int64(base).tobytes() + b"\0" + (ids - base).astype(np.uint32).tobytes()
    return np.int64(base).tobytes() + b"\1" + ids.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[8]:
        return np.frombuffer(data[9:], np.int64)
    return np.frombuffer(data[9:], np.uint32).astype(np.int64) + np.frombuffer(data[:8], np.int64)[0]


class Documents:
    """The documents of a group, without whole-text copies unless asked for, with their shingle sets by slices."""

    def __init__(self, left: pa.Table, right: pa.Table, k: int):
        self.table, self.k = left, k
        self.ids = np.array(column(left, "did"), np.int64)
        kinds = column(right, "kind")
        copies = {(d, h) for d, h, kind in zip(column(right, "did"), column(right, "th"), kinds, strict=True) if kind == 0}
        self.copy = np.array([(d, h) in copies for d, h in zip(self.ids.tolist(), column(left, "th"), strict=True)], bool) if copies else np.zeros(len(self.ids), bool)

    def sets(self, which: np.ndarray):
        col = self.table.column("data")
        sizes = [len(col[int(i)].as_buffer()) if col[int(i)].is_valid else 0 for i in which]
        for b, e in slices(sizes, SLICE):
            own = which[b:e]
            yield own, *shingle_sets([col[int(i)].as_py() for i in own], self.k)


COUNTS = pa.schema([("b", pa.int64()), ("g", pa.int32()), ("keys", pa.binary()), ("places", pa.binary()), ("counts", pa.binary())])
SHARED = pa.schema([("g", pa.int32()), ("kind", pa.int32()), ("did", pa.int64()), ("th", pa.int64()), ("b", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
SHARED_DDL = "g int, kind int, did long, th long, b long, keys binary, counts binary"
KEYS = pa.schema([("b", pa.int64()), ("g", pa.int32()), ("keys", pa.binary()), ("least", pa.binary()), ("edges", pa.binary())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
LOW32 = np.uint64(0xFFFFFFFF)


def _count_keys(k: int, a: int, b: int, buckets: int):
    @light
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        docs = Documents(left, right, k)
        found = [np.zeros(0, np.uint64), *(keys_of(held, cuts, a, b)[0] for _, held, cuts in docs.sets(np.flatnonzero(~docs.copy)))]
        h, count = np.unique(np.concatenate(found), return_counts=True)
        rows = []
        for x, at in split_by(bucket_of(h, buckets)):
            many = np.flatnonzero(count[at] > 1)
            rows.append((x, key[0].as_py(), blob((h[at] & LOW32).astype(np.uint32)), blob(many.astype(np.uint32)), blob(count[at[many]].astype(np.uint32))))
        return _batches(rows, COUNTS)

    return run


@light
def _answer_keys(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The keys of several documents and how many, to each group that sent them."""
    parts = [np.frombuffer(x, np.uint32) for x in column(table, "keys")]
    counts = []
    for part, places, more in zip(parts, column(table, "places"), column(table, "counts"), strict=True):
        own = np.ones(len(part), np.uint32)
        own[np.frombuffer(places, np.uint32)] = np.frombuffer(more, np.uint32)
        counts.append(own)
    keys, count = np.concatenate(parts), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, count = keys[order], count[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.add.reduceat(count, cuts, dtype=np.int64)
    known, total = keys[cuts][total > 1], np.minimum(total[total > 1], (1 << 32) - 1).astype(np.uint32)
    rows = []
    for g, part in zip(column(table, "g"), parts, strict=True):
        if len(known):
            part = np.unique(part)
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            at = at[known[at] == part]
            if len(at):
                rows.append((g, 1, None, None, key[0].as_py(), blob(known[at]), blob(total[at])))
    return _batches(rows, SHARED)


def _send_keys(k: int, a: int, b: int, buckets: int):
    @light
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        known, count = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for kind, x, keys, counts in zip(*(column(right, c) for c in ("kind", "b", "keys", "counts")), strict=True):
            if kind == 1:
                known.append(np.uint64(x) << np.uint64(32) | np.frombuffer(keys, np.uint32).astype(np.uint64))
                count.append(np.frombuffer(counts, np.uint32))
        known, count = np.concatenate(known), np.concatenate(count)
        if not len(known):
            return _batches([], KEYS)
        order = np.argsort(known)
        known, count = known[order], count[order]
        docs = Documents(left, right, k)
        keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for own, held, cuts in docs.sets(np.flatnonzero(~docs.copy)):
            h, doc, section, most = keys_of(held, cuts, a, b)
            h = bucket_of(h, buckets).astype(np.uint64) << np.uint64(32) | h & LOW32
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            alone = np.bincount(section[~hit], minlength=int(section.max(initial=-1)) + 1)
            h, doc, section, most, often = h[hit], doc[hit], section[hit], most[hit], count[at[hit]]
            order = np.lexsort((h, often, section))
            first = np.searchsorted(section[order], section[order])
            use = order[alone[section[order]] + np.arange(len(order)) - first < most[order]]
            keys.append(h[use])
            ids.append(docs.ids[own[doc[use]]])
        h, d = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        if not len(h):
            return _batches([], KEYS)
        cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        least = np.minimum.reduceat(d, cuts)
        lead = np.repeat(least, np.diff(np.append(cuts, len(h))))
        local = np.unique(np.stack([d, lead], 1)[d != lead], axis=0)
        h = h[cuts]
        low = (h & LOW32).astype(np.uint32)
        rows = [(x, key[0].as_py(), blob(low[at]), packed(least[at]), b"") for x, at in split_by((h >> np.uint64(32)).astype(np.int64))]
        if len(local):
            rows[0] = (*rows[0][:4], blob(local))
        return _batches(rows, KEYS)

    return run


@light
def _link_keys(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in column(table, "keys")])
    least = np.concatenate([unpacked(x) for x in column(table, "least")])
    local = np.concatenate([np.frombuffer(x, np.int64) for x in column(table, "edges")]).reshape(-1, 2)
    order = np.argsort(keys, kind="stable")
    keys, least = keys[order], least[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    lead = np.repeat(np.minimum.reduceat(least, cuts), np.diff(np.append(cuts, len(keys))))
    links = np.unique(np.stack([least, lead], 1)[least != lead], axis=0)
    out = np.concatenate([local, links])
    return pa.Table.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], schema=EDGES)


# -- blocks -------------------------------------------------------------------


class RTree:
    """A bulk-loaded R-tree over count vectors; a node keeps the coordinate maxima and the least size below it."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*vectors.T[:2], sizes))
        high, low = vectors[self.order], sizes[self.order]
        self.levels = [(high, low)]
        while len(low) > 1:
            cuts = np.arange(0, len(low), FANOUT)
            high, low = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts)
            self.levels.append((high, low))

    def near(self, vector: np.ndarray, size: int, a: int, b: int) -> np.ndarray:
        """The points whose summed coordinate minima allow a Jaccard similarity of a/b, as a superset of the links."""
        at = np.arange(len(self.levels[-1][1]))
        for n, (high, low) in enumerate(reversed(self.levels)):
            bound = np.minimum(high[at], vector).sum(axis=1)
            at = at[(bound * (a + b) >= a * (size + low[at])) & (low[at] * a <= size * b)]
            if n + 1 < len(self.levels):
                below = len(self.levels[-2 - n][1])
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < below]
        return self.order[at]


class Block:
    """Sets that may be linked with each other; equal sets are one point."""

    def __init__(self, ids: list[int], sets: list[bytes]):
        point: dict[bytes, int] = {}
        self.ids = np.array(ids, np.int64)
        self.point = np.array([point.setdefault(x, len(point)) for x in sets], np.int64)
        arrays = [np.frombuffer(x, np.uint64) for x in point]
        self.sizes = np.array([len(x) for x in arrays], np.int64)
        self.cuts = np.concatenate([[0], np.cumsum(self.sizes)])
        flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
        group = ((flat & np.uint64(0xFFFFFF)) * np.uint64(DIMS) >> np.uint64(24)).astype(np.int64)
        owner = np.repeat(np.arange(len(arrays)), self.sizes)
        self.vectors = np.bincount(owner * DIMS + group, minlength=len(arrays) * DIMS).reshape(len(arrays), DIMS)
        self.tokens, self.flat = np.unique(flat, return_inverse=True)
        self.tree = RTree(self.vectors, self.sizes) if arrays else None
        self.root = np.arange(len(arrays))
        self.mark = np.zeros(len(self.tokens), bool)

    def tokens_of(self, x: int) -> np.ndarray:
        return self.flat[self.cuts[x] : self.cuts[x + 1]]

    def query(self, data: bytes, a: int, b: int) -> np.ndarray:
        """The points that a set from elsewhere is linked with."""
        tokens = np.frombuffer(data, np.uint64)
        group = ((tokens & np.uint64(0xFFFFFF)) * np.uint64(DIMS) >> np.uint64(24)).astype(np.int64)
        near = self.tree.near(np.bincount(group, minlength=DIMS), len(tokens), a, b)
        if not len(near):
            return near
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return self.linked(at[self.tokens[at] == tokens], len(tokens), near, a, b)

    def linked(self, tokens: np.ndarray, size: int, others: np.ndarray, a: int, b: int) -> np.ndarray:
        """Those of the points others that a set is linked with; tokens: its tokens that the block knows."""
        self.mark[tokens] = True
        common = np.array([np.count_nonzero(self.mark[self.flat[self.cuts[o] : self.cuts[o + 1]]]) for o in others.tolist()], np.int64)
        self.mark[tokens] = False
        return others[common * b >= a * (size + self.sizes[others] - common)]

    def join(self, a: int, b: int) -> np.ndarray:
        """The component of each row."""
        for x in range(len(self.sizes)):
            near = self.tree.near(self.vectors[x], int(self.sizes[x]), a, b)
            near = near[(near > x) & (self.root[near] != self.root[x])]
            if len(near):
                for y in self.linked(self.tokens_of(x), int(self.sizes[x]), near, a, b).tolist():
                    if self.root[y] != self.root[x]:
                        self.root[self.root == self.root[y]] = self.root[x]
        return self.root[self.point]


def dimensions(size: int) -> int:
    """Groups of a count vector: enough for chance differences to outgrow those that linked sets may have."""
    dims = DIMS
    while dims * 12 < size:
        dims *= 2
    return dims


def count_vector(tokens: np.ndarray) -> bytes:
    """The number of tokens, then the tokens in each group; groups of a longer vector lie in those of a shorter one."""
    dims = dimensions(len(tokens))
    group = (tokens >> np.uint64(64 - dims.bit_length() + 1)).astype(np.int64)
    return np.concatenate([[len(tokens)], np.bincount(group, minlength=dims)]).astype(np.uint32).tobytes()


def folded(vectors: np.ndarray, dims: int) -> np.ndarray:
    return vectors.reshape(*vectors.shape[:-1], dims, -1).sum(axis=-1)


class Points(Block):
    """Count vectors instead of sets: what their summed coordinate minima don't rule out counts as linked."""

    def __init__(self, ids: list[int], data: list[bytes]):
        point: dict[bytes, int] = {}
        self.ids = np.array(ids, np.int64)
        self.point = np.array([point.setdefault(x, len(point)) for x in data], np.int64)
        arrays = [np.frombuffer(x, np.uint32).astype(np.int64) for x in point]
        self.sizes = np.array([x[0] for x in arrays], np.int64)
        self.fine = [x[1:] for x in arrays]
        self.vectors = np.stack([folded(x, DIMS) for x in self.fine]) if arrays else np.zeros((0, DIMS), np.int64)
        self.tree = RTree(self.vectors, self.sizes) if arrays else None
        self.root = np.arange(len(arrays))
        self.dims = np.array([len(x) for x in self.fine], np.int64)
        self.row = np.zeros(len(arrays), np.int64)
        self.levels = {}
        for d in np.unique(self.dims).tolist():
            own = np.flatnonzero(self.dims == d)
            self.row[own] = np.arange(len(own))
            self.levels[d] = np.stack([self.fine[i] for i in own])

    def tokens_of(self, x: int) -> np.ndarray:
        return self.fine[x]

    def linked(self, vector: np.ndarray, size: int, others: np.ndarray, a: int, b: int) -> np.ndarray:
        out = []
        for d, matrix in self.levels.items():
            own = others[self.dims[others] == d]
            if len(own):
                dims = min(d, len(vector))
                common = np.minimum(folded(matrix[self.row[own]], dims), folded(vector, dims)).sum(axis=1)
                out.append(own[common * (a + b) >= a * (size + self.sizes[own])])
        return np.sort(np.concatenate(out)) if out else others[:0]

    def query(self, data: bytes, a: int, b: int) -> np.ndarray:
        x = np.frombuffer(data, np.uint32).astype(np.int64)
        near = self.tree.near(folded(x[1:], DIMS), int(x[0]), a, b)
        return self.linked(x[1:], int(x[0]), near, a, b) if len(near) else near


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("comp", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("data", pa.binary())])
LINK_DDL = "a long, b long, comp long, part int, parts int, data binary"


def _join_block(a: int, b: int, kind):
    @light
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, sets = column(table, "did"), column(table, "data")
        component = kind(ids, sets).join(a, b)
        rows = []
        least: dict[int, int] = {}
        for i, c in zip(ids, component.tolist(), strict=True):
            least[c] = min(least.get(c, i), i)
        for i, c in zip(ids, component.tolist(), strict=True):
            if i != least[c]:
                rows.append((i, least[c], None, None, None, None))
        reached = {c for c, first in zip(component.tolist(), column(table, "first"), strict=True) if first}
        for i, c, comp, part, parts, away, data in zip(ids, component.tolist(), *(column(table, x) for x in ("comp", "part", "parts", "away")), sets, strict=True):
            if parts > 1 and not away and c not in reached:
                rows.append((i, None, comp, part, parts, data))
        return _batches(rows, LINKS)

    return run


def _join_late(a: int, b: int, kind):
    @light
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _batches([], EDGES)
        ids = column(left, "did")
        block = kind(ids, column(left, "data"))
        first = {}
        for i, p in zip(ids, block.point.tolist(), strict=True):
            first.setdefault(p, i)
        rows = [(i, first[p]) for i, data in zip(column(right, "did"), column(right, "data"), strict=True) for p in block.query(data, a, b).tolist() if first[p] != i]
        return _batches(rows, EDGES)

    return run


SETS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("comp", pa.int64()), ("first", pa.bool_()), ("away", pa.bool_()), ("did", pa.int64()), ("data", pa.binary())])
SETS_DDL = "block long, part int, parts int, comp long, first boolean, away boolean, did long, data binary"


def _send_sets(k: int, blocks: int, kind):
    def run(batches):
        for batch in batches:
            col = batch.column("data")
            ids, comps, many, hubs, firsts = (batch.column(x).to_pylist() for x in ("did", "comp", "parts", "hub", "first"))
            for b, e in slices([len(x.as_buffer()) for x in col], SLICE):
                held, cuts = shingle_sets([col[i].as_py() for i in range(b, e)], k)
                rows = []
                for j, i in enumerate(range(b, e)):
                    did, comp, parts = ids[i], comps[i], many[i]
                    data = held[cuts[j] : cuts[j + 1]]
                    data = b"" if not len(data) else count_vector(data) if kind is Points else blob(data)
                    with np.errstate(over="ignore"):
                        own_part = int(mix(np.uint64([did & (1 << 64) - 1]))[0] % np.uint64(parts))
                        block = comp if parts > 1 else -1 - int(mix(np.uint64([comp & (1 << 64) - 1]))[0] % np.uint64(blocks))
                    if data:
                        rows += [(block, part, parts, comp, firsts[i], part != own_part, did, data) for part in (range(parts) if hubs[i] else [own_part])]
                if rows:
                    yield from _batches(rows, SETS).to_batches()

    return run


def n_shingles(text, k: int):
    """The number of distinct k-word shingles of a text Column, as shingle_sets() has them."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    words = F.filter(F.split(low, WHITE_CLASS + "+"), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(0), F.size("__words") - k), lambda i: F.xxhash64(*[F.col("__words")[i + j] for j in range(k)]))
    return words, F.when(F.size("__words") >= k, F.size(F.array_distinct(runs))).otherwise((F.size("__words") > 0).cast("int")).cast("long")


def compare(hashed: DataFrame, copies: DataFrame, edges: DataFrame, k: int, a: int, b: int, kind) -> DataFrame:
    """Links (a, b) among the members of each component of the candidate edges (a, b), by blocks of a kind."""
    candidates = stored(components(edges), "candidate-components")
    per = candidates.groupBy(F.col("component").alias("comp")).agg(F.count("*").alias("members"))
    parts = F.ceil(F.col("members") / PART).cast("int")
    degree = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("degree"))
    large = per.where(parts > 1)
    hubs = candidates.join(large, candidates["component"] == large["comp"]).join(degree, "node", "left").withColumn("rank", F.struct(F.coalesce("degree", F.lit(0)), -F.col("node")))
    hubs = hubs.groupBy("comp", F.pmod(F.xxhash64("node"), F.lit(HUBS)).alias("slot")).agg(F.max_by("node", "rank").alias("hub"), F.max("rank").alias("rank"))
    hubs = hubs.groupBy("comp").agg(F.collect_list("hub").alias("hubs"), F.max_by("hub", "rank").alias("hub"))  # at most HUBS rows each
    live = candidates.join(per, candidates["component"] == per["comp"]).join(hubs, "comp", "left")
    is_hub, is_first = F.array_contains("hubs", F.col("node")), F.col("hub") == F.col("node")
    live = live.select(F.col("node").alias("did"), "comp", parts.alias("parts"), F.coalesce(is_hub, F.lit(False)).alias("hub"), F.coalesce(is_first, F.lit(False)).alias("first"))
    live = stored(live, "members")
    count = live.count()
    told = F.broadcast(live) if count <= BROADCAST_ROWS else live
    reread = hashed.join(told, "did").join(copies.select("did", "th").withColumn("copy", F.lit(True)), ["did", "th"], "left").where("copy IS NULL")
    reread = reread.select("did", "comp", "parts", "hub", "first", "data")
    members = reread.mapInArrow(_send_sets(k, max(1, count // PART), kind), SETS_DDL)
    links = stored(members.groupBy("block", "part").applyInArrow(_join_block(a, b, kind), LINK_DDL), "links")
    found = links.where("b IS NOT NULL").select("a", "b")
    late = links.where("b IS NULL").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("`to` <> part")
    late = late.select(F.col("comp").alias("block"), F.col("to").alias("part"), F.col("a").alias("did"), "data")
    if not late.isEmpty():
        spread = reread.where("parts > 1").mapInArrow(_send_sets(k, 1, kind), SETS_DDL).select("block", "part", "did", "data")
        found = found.unionByName(spread.groupBy("block", "part").cogroup(late.groupBy("block", "part")).applyInArrow(_join_late(a, b, kind), "a long, b long"))
    return stored(found.distinct(), "found")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, th, n_shingles, component_id) for each row of docs; th: xxhash64 of its text.

    Sets hold the distinct k-word shingles, as 64-bit hashes; two rows are linked when intersection / union is at least
    similarity, given as (a, b) for a/b. component_id: the smallest doc_id reachable by links, itself included. Null,
    empty and blank texts have no shingles and are linked with nothing. Rows of one doc_id are one node. A null doc_id
    counts as one document after all others and stays null. Other columns are left behind. Empty table: empty result."""
    a, b = similarity
    g = math.gcd(a, b)
    a, b = a // g, b // g
    bare = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    groups = group_count(bare)
    place = F.pmod(F.xxhash64("did"), F.lit(groups)).cast("int").alias("g")
    copies = stored(exact_copies(bare.where(F.col("text").rlike(WORD))).withColumnRenamed("doc_id", "did"), "copies")
    none = F.lit(None)
    noted = copies.select(place, F.lit(0).alias("kind"), "did", "th", none.cast("long").alias("b"), none.cast("binary").alias("keys"), none.cast("binary").alias("counts"))
    hashed = bare.select(F.col("doc_id").alias("did"), F.xxhash64("text").alias("th"), F.encode("text", "UTF-8").alias("data"))
    dealt = hashed.select(place, "did", "th", "data")
    buckets = max(1, groups // 2)

    def meet(function, schema, right):
        return dealt.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(function, schema)

    counts = meet(_count_keys(k, a, b, buckets), "b long, g int, keys binary, places binary, counts binary", noted)
    shared = counts.groupBy("b").applyInArrow(_answer_keys, SHARED_DDL)
    keys = meet(_send_keys(k, a, b, buckets), "b long, g int, keys binary, least binary, edges binary", noted.unionByName(shared))
    edges = stored(keys.groupBy("b").applyInArrow(_link_keys, "a long, b long").distinct(), "candidates")
    near = compare(hashed, copies, edges, k, a, b, Points)
    links = compare(hashed, copies, near, k, a, b, Block)
    found = components(links.unionByName(copies.select(F.col("did").alias("a"), F.col("rep").alias("b"))))
    words, number = n_shingles(F.col("text"), k)
    rows = bare.select(F.col("doc_id").alias("did"), F.xxhash64("text").alias("th"), F.col("text").rlike(WORD).alias("said"), words.alias("__words")).withColumn("n", number).drop("__words")
    out = rows.join(found, rows["did"] == found["node"], "left")
    out = out.withColumn("component", F.when(F.col("said"), F.coalesce("component", "did")).otherwise(F.col("did")))
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(known("did").alias("doc_id"), "th", F.col("n").alias("n_shingles"), known("component").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table, texts

    return near_duplicates(texts(table(spark, sf_dir, "documents")), 3, (90, 100)).drop("th")


#: The same over small tables.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) BETWEEN 1 AND 2 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common WHERE 100 * c >= 90 * (nx + ny - c)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.r = links.x
)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
