"""Removal of byte strings that an earlier document holds, by suffix arrays of the places that may repeat.

Documents are dealt to groups by doc_id, once. Groups and buckets then exchange messages of packed arrays:

1. Each group cuts its texts into runs of windows with the same minimal hash (winnowing), so equal windows of two
   documents lie in runs with equal hashes, and sends each bucket the distinct hashes.
2. A bucket answers with the hashes of more than one document.
3. Groups send the distinct contexts (the bytes of a run's windows) of those hashes with their smallest doc_id.
4. A bucket sorts the suffixes of all its contexts in two stages, finds the equal windows by adjacent common prefixes,
   and answers with a bit for each window: whether a smaller doc_id than the group's own holds it.
5. Groups remove what those windows cover.

A context that a third of all documents hold is one entry for each group, not for each document. Buckets judge equality on
bytes; what a group merges before, equal contexts and whole-text copies, it merges by 128 bits of hash. A group sends each
bucket one row at most, and none without hashes, so there are never more rows than hashes, which grow with the input."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffix_array
from .common import NULL_ID, blob, column, exact_copies, group_count, light, mix, slices

GRAM = 24
SLICE = 1 << 20
#: A place takes 31 bits beside its hash: a binary cell of Arrow holds less than 2 GiB.
PLACE_BITS = np.uint64(31)
NEXT = np.uint64(0x2545F4914F6CDD1D)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place, by doubling."""
    m = np.uint64(0x9E3779B97F4A7C15)
    h1 = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))[data]
    h2 = h1[:-1] * m + h1[1:]
    h4 = h2[:-2] * (m * np.uint64(3)) + h2[2:]
    h8 = h4[:-4] * (m * np.uint64(5)) + h4[4:]
    h16 = h8[:-8] * (m * np.uint64(7)) + h8[8:]
    return mix(h16[:-8] * (m * np.uint64(11)) + h8[16:])


class Runs:
    """The runs of windows of some documents' concatenated bytes.

    begin, end: first and last window of a run; hash: of the run's minimal gram; doc: the document's number."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, width: int):
        ends = np.append(starts[1:], len(data))
        self.data = data
        empty = np.zeros(0, np.int64)
        self.begin, self.end, self.doc, self.hash = empty, empty, empty, np.zeros(0, np.uint64)
        if len(data) < width:
            return
        with np.errstate(over="ignore"):
            grams = gram_hashes(data)
            low = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
            span, at = width - GRAM + 1, 1
            while at * 2 <= span:
                low = np.minimum(low[:-at], low[at:])
                at *= 2
            if at < span:
                low = np.minimum(low[: len(low) - (span - at)], low[span - at :])
            place = (low & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
            valid = np.zeros(len(place) + 1, np.int8)
            long = ends - starts >= width
            np.add.at(valid, starts[long], 1)
            np.add.at(valid, ends[long] - width + 1, -1)
            valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
            first = valid & np.concatenate([[True], (place[1:] != place[:-1]) | ~valid[:-1]])
            self.begin = np.flatnonzero(first)
            if not len(self.begin):
                return
            doc = np.searchsorted(starts, np.arange(len(place))[self.begin], side="right") - 1
            stop = np.append(self.begin[1:], len(place)) - 1
            self.doc = doc
            self.end = np.minimum(stop, ends[doc] - width)
            self.hash = mix(grams[place[self.begin]] ^ NEXT)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Group:
    """The documents of a group, without whole-text copies, in slices that are made anew for each pass."""

    def __init__(self, left: pa.Table, right: pa.Table, width: int):
        self.table, self.width = left, width
        self.ids = np.array(column(left, "did"), np.int64)
        self.sizes = [len(x) if x is not None else 0 for x in (y.as_py() for y in left.column("data"))]
        kinds = np.array(column(right, "kind"), np.int64)
        copies = {(d, h) for d, h, k in zip(column(right, "did"), column(right, "th"), kinds, strict=True) if k == 0}
        self.copy = np.array([(d, h) in copies for d, h in zip(self.ids.tolist(), column(left, "th"), strict=True)], bool) if copies else np.zeros(len(self.ids), bool)
        self.answers = {kind: {b: x for b, x, k in zip(column(right, "b"), column(right, "data"), kinds, strict=True) if k == kind} for kind in (1, 2)}

    def runs(self):
        """(numbers of the documents, starts, Runs) of each slice."""
        alone = np.flatnonzero(~self.copy & (np.array(self.sizes, np.int64) >= self.width))
        col = self.table.column("data")
        for b, e in slices([self.sizes[i] for i in alone], SLICE):
            own = alone[b:e]
            parts = [col[int(i)].as_py() for i in own]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]]).astype(np.int64)
            yield own, starts, Runs(np.frombuffer(b"".join(parts), np.uint8), starts, self.width)

    def marked(self, runs: Runs, buckets: int) -> np.ndarray:
        """The runs whose hash a bucket answered to be of more than one document."""
        bucket = bucket_of(runs.hash, buckets)
        out = np.zeros(len(bucket), bool)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.unique(bucket))
        for i, j in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            if answer := self.answers[1].get(int(bucket[order[i]])):
                own = order[i:j]
                keys = (runs.hash[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                known = np.frombuffer(answer, np.uint32)
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out[own] = known[at] == keys
        return out

    def contexts(self, buckets: int, second: int):
        """The distinct contexts of the marked runs, in an order that only their bytes decide.

        Returns bucket, size, smallest doc_id and bytes of each, and for each run (slice, run, document, context)."""
        hashes, sums, sizes, docs, places, held = [], [], [], [], [], []
        for s, (own, starts, runs) in enumerate(self.runs()):
            at = np.flatnonzero(self.marked(runs, buckets))
            begin, size = runs.begin[at], runs.end[at] - runs.begin[at] + self.width
            most = int(size.max(initial=0))
            index = np.minimum(begin[:, None] + np.arange(most)[None, :], len(runs.data) - 1)
            chars = np.where(np.arange(most)[None, :] < size[:, None], runs.data[index], 0).astype(np.uint8)
            with np.errstate(over="ignore"):
                total = np.zeros(len(at), np.uint64)
                padded = np.zeros((len(at), -(-most // 8) * 8), np.uint8)
                padded[:, :most] = chars
                for k in range(padded.shape[1] // 8):
                    total = mix(total ^ padded[:, 8 * k : 8 * k + 8].copy().view(np.uint64)[:, 0] ^ np.uint64(k + 1)) + total
            hashes.append(runs.hash[at])
            sums.append(total ^ size.astype(np.uint64))
            sizes.append(size)
            docs.append(self.ids[own[runs.doc[at]]])
            places.append(np.stack([np.full(len(at), s), begin], 1).reshape(-1, 2))
            held.append(chars)
        if not hashes:
            return None
        hashes, sums, sizes, docs, places = (np.concatenate(x) for x in (hashes, sums, sizes, docs, places))
        order = np.lexsort((docs, sums, hashes))
        h, t = hashes[order], sums[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]) if len(h) else np.zeros(0, bool)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        head = order[new]
        return {"bucket": bucket_of(hashes[head], second), "size": sizes[head], "least": docs[head], "head": head, "of": of, "docs": docs, "sizes": sizes, "places": places, "held": held}


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


HASHES = pa.schema([("b", pa.int64()), ("g", pa.int32()), ("data", pa.binary()), ("many", pa.binary())])
CONTEXTS = pa.schema([("b", pa.int64()), ("g", pa.int32()), ("size", pa.binary()), ("least", pa.binary()), ("data", pa.binary())])
ANSWERS = pa.schema([("g", pa.int32()), ("kind", pa.int32()), ("did", pa.int64()), ("th", pa.int64()), ("b", pa.int64()), ("data", pa.binary())])
ANSWER_DDL = "g int, kind int, did long, th long, b long, data binary"


def split_by(bucket: np.ndarray):
    """(bucket, places) of each bucket; places keep their order."""
    order = np.argsort(bucket, kind="stable")
    found, cuts = np.unique(bucket[order], return_index=True)
    for b, i, j in zip(found.tolist(), cuts, np.append(cuts[1:], len(order)), strict=True):
        yield b, order[i:j]


def _send_hashes(width: int, buckets: int):
    @light
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left, right, width)
        hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for own, _, runs in group.runs():
            hashes.append(runs.hash)
            docs.append(group.ids[own[runs.doc]])
        h, d = np.concatenate(hashes), np.concatenate(docs)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(h))
        many = (d[cuts] != d[ends - 1]).astype(np.uint8) if len(cuts) else np.zeros(0, np.uint8)
        h = h[cuts]
        bucket, low = bucket_of(h, buckets), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return _batches([(b, key[0].as_py(), blob(low[at]), blob(many[at])) for b, at in split_by(bucket)], HASHES)

    return run


@light
def _answer_hashes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    groups = column(table, "g")
    parts = [np.frombuffer(x, np.uint32) for x in column(table, "data")]
    many = np.concatenate([np.frombuffer(x, np.uint8) for x in column(table, "many")])
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    again = np.concatenate([[False], k[1:] == k[:-1]])
    again |= np.append(again[1:], False) | (many[order] > 0)
    # a hash that is twice in one group stands for two documents there, and then for all its entries
    flagged = np.unique(k[again])
    rows, b = [], key[0].as_py()
    for g, part in zip(groups, parts, strict=True):
        at = np.minimum(np.searchsorted(flagged, part), max(0, len(flagged) - 1))
        hit = part[flagged[at] == part] if len(flagged) else part[:0]
        if len(hit):
            rows.append((g, 1, None, None, b, blob(np.unique(hit))))
    return _batches(rows, ANSWERS)


def _send_contexts(width: int, buckets: int, second: int):
    @light
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left, right, width)
        found = group.contexts(buckets, second)
        if found is None or not len(found["head"]):
            return _batches([], CONTEXTS)
        ends = np.cumsum([len(x) for x in found["held"]])
        rows = []
        for b, at in split_by(found["bucket"]):
            heads = found["head"][at]
            chunks = np.searchsorted(ends, heads, side="right")
            data = b"".join(found["held"][c][i - (ends[c - 1] if c else 0), :n].tobytes() for c, i, n in zip(chunks.tolist(), heads.tolist(), found["size"][at].tolist(), strict=True))
            rows.append((b, key[0].as_py(), blob(found["size"][at].astype(np.uint8)), blob(found["least"][at]), data))
        return _batches(rows, CONTEXTS)

    return run


def _answer_contexts(width: int):
    @light
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        groups, datas = column(table, "g"), column(table, "data")
        sizes = [np.frombuffer(x, np.uint8).astype(np.int64) for x in column(table, "size")]
        size, least = np.concatenate(sizes), np.concatenate([np.frombuffer(x, np.int64) for x in column(table, "least")])
        index: dict[bytes, int] = {}
        of = np.empty(len(size), np.int64)
        i = 0
        for data, own in zip(datas, sizes, strict=True):
            at = 0
            for n in own.tolist():
                of[i] = index.setdefault(data[at : at + n], len(index))
                at += n
                i += 1
        keys = list(index)
        del index
        n = np.array([len(x) for x in keys], np.int64)
        begin = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
        text = np.frombuffer(b"\0".join(keys) + b"\0\1", np.uint8)
        del keys
        holder = np.full(len(n), NULL_ID, np.int64)
        np.minimum.at(holder, of, least)
        windows = n - width + 1
        owner = np.repeat(np.arange(len(n)), windows)
        nth = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
        wanted = np.zeros(len(text), bool)
        number = np.zeros(len(text), np.int32)
        wanted[begin[owner] + nth] = True
        number[begin[owner] + nth] = np.arange(len(owner))
        words = suffix_array.words_at(text)
        order = suffix_array.two_stage(text, wanted, width, words)
        starts = np.flatnonzero(np.concatenate([[True], ~suffix_array.adjacent_prefix(words, order, width)]))
        window = number[order]
        lowest = np.minimum.reduceat(holder[owner[window]], starts)
        least_of = np.empty(len(owner), np.int64)
        least_of[window] = np.repeat(lowest, np.diff(np.append(starts, len(order))))
        most = int(windows.max())
        grid = np.full((len(n), most), NULL_ID, np.int64)
        grid[owner, nth] = least_of
        bits = np.zeros(len(of), np.uint64)
        for k in range(most):
            bits |= (grid[of, k] < least).astype(np.uint64) << np.uint64(k)
        rows, at, b = [], 0, key[0].as_py()
        for g, own in zip(groups, sizes, strict=True):
            rows.append((g, 2, None, None, b, blob(bits[at : at + len(own)])))
            at += len(own)
        return _batches(rows, ANSWERS)

    return run


def _remove(width: int, buckets: int, second: int, schema: pa.Schema, whole: bool):
    @light
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left, right, width)
        found = group.contexts(buckets, second)
        gone: dict[int, list] = {}
        if found is not None and len(found["head"]):
            bits = np.zeros(len(found["head"]), np.uint64)
            for b, at in split_by(found["bucket"]):
                bits[at] = np.frombuffer(group.answers[2][b], np.uint64)
            own, windows = bits[found["of"]], found["sizes"] - width + 1
            full = (np.uint64(1) << windows.astype(np.uint64)) - np.uint64(1)
            own = np.where(found["docs"] > found["least"][found["of"]], full, own)
            for k in range(int(windows.max())):
                hit = ((own >> np.uint64(k)) & np.uint64(1)) > 0
                for s in np.unique(found["places"][hit, 0]).tolist():
                    gone.setdefault(s, []).append(found["places"][hit & (found["places"][:, 0] == s), 1] + k)
        size = np.array(group.sizes, np.int64)
        removed, spans = np.where(group.copy & (size >= width), size, 0), (group.copy & (size >= width)).astype(np.int64)
        kept = [b"" if r else x.as_py() for r, x in zip(removed, left.column("data"), strict=True)]
        if gone:
            for s, (own, starts, runs) in enumerate(group.runs()):
                if s not in gone:
                    continue
                window = np.zeros(len(runs.data) + 1, np.int32)
                window[np.concatenate(gone[s])] = 1
                total = np.cumsum(window[:-1])
                covered = total > 0
                covered[width:] = total[width:] > total[:-width]
                for i, b, e in zip(own.tolist(), starts.tolist(), np.append(starts[1:], len(runs.data)).tolist(), strict=True):
                    c = covered[b:e]
                    if k := int(c.sum()):
                        removed[i], spans[i] = k, int(c[0]) + int((c[1:] & ~c[:-1]).sum())
                        kept[i] = runs.data[b:e][~c].tobytes()
        if whole:
            kept = [x.decode("utf-8", "ignore").encode("utf-8") if r else x for x, r in zip(kept, removed, strict=True)]
        columns = {"did": left.column("did"), "n_bytes": pa.array(size), "n_removed": pa.array(removed), "n_spans": pa.array(spans), "kept": pa.array(kept, pa.binary())}
        return pa.Table.from_arrays([columns[f.name] if f.name in columns else left.column(f.name) for f in schema], schema=schema)

    return run


def remove_repeats(docs: DataFrame, min_bytes: int = 50, whole_characters: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (the remaining bytes) beside rest, a struct of the other columns.

    Removes each byte covered by a min_bytes string that also starts in a document with a smaller doc_id, judged on the
    input. Null text: empty. Texts below min_bytes stay whole. A null doc_id comes after all others. Rows of one doc_id
    are one document: they remove nothing from each other. Empty table: empty result. whole_characters: kept lacks what is
    left of a character that lost some of its bytes, so that it is valid UTF-8."""
    if not GRAM < min_bytes <= GRAM + 63:
        raise ValueError("min_bytes out of range")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("string")
    bare = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), rest.alias("rest"))
    groups = group_count(bare)
    buckets, second = max(1, groups // 2), groups * 4
    place = F.pmod(F.xxhash64("did"), F.lit(groups)).cast("int").alias("g")
    copies = exact_copies(bare).withColumnRenamed("doc_id", "did")
    noted = copies.select(place, F.lit(0).alias("kind"), "did", "th", F.lit(None).cast("long").alias("b"), F.lit(None).cast("binary").alias("data"))
    dealt = bare.select(F.col("doc_id").alias("did"), F.xxhash64("text").alias("th"), F.encode("text", "UTF-8").alias("data"), "rest").select(place, "did", "th", "data", "rest")

    def meet(function, schema, *tables):
        return dealt.groupBy("g").cogroup(reduce(DataFrame.unionByName, tables).groupBy("g")).applyInArrow(function, schema)

    hashes = meet(_send_hashes(min_bytes, buckets), "b long, g int, data binary, many binary", noted)
    first = hashes.groupBy("b").applyInArrow(_answer_hashes, ANSWER_DDL)
    contexts = meet(_send_contexts(min_bytes, buckets, second), "b long, g int, size binary, least binary, data binary", noted, first)
    bits = contexts.groupBy("b").applyInArrow(_answer_contexts(min_bytes), ANSWER_DDL)
    rest_type = bare.schema["rest"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"did long, n_bytes long, n_removed long, n_spans long, kept binary, rest {rest_type}"
    out = meet(_remove(min_bytes, buckets, second, to_arrow_schema(StructType.fromDDL(ddl)), whole_characters), ddl, noted, first, bits)
    return out.withColumn("doc_id", F.when(F.col("did") != NULL_ID, F.col("did"))).drop("did")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table, texts

    out = remove_repeats(texts(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same over small tables.
SQL = r"""
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), parts AS (
  SELECT doc_id, k, substr(h, k * 2000 + 1, 2098) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2000 + 1)) AS k FROM bytes)
), starts AS (
  SELECT doc_id, part, k, unnest(range(0, least(1000, length(part) // 2 - 49))) AS j FROM parts
), windows AS (
  SELECT doc_id, k * 1000 + j AS pos, md5_number(substr(part, 2 * j + 1, 100)) AS s FROM starts
), least_holder AS (
  SELECT s, min(doc_id) AS holder FROM windows GROUP BY s
), hits AS (
  SELECT doc_id, pos FROM windows JOIN least_holder USING (s) WHERE holder < doc_id
), marked AS (
  SELECT doc_id, pos, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50, true) AS new FROM hits
), numbered AS (
  SELECT doc_id, pos, count(*) FILTER (WHERE new) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM marked
), spans AS (
  SELECT doc_id, span, min(pos) AS b, max(pos) + 50 AS e FROM numbered GROUP BY ALL
), cuts AS (
  SELECT doc_id, b, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS from_ FROM spans
  UNION ALL SELECT doc_id, length(h) // 2, NULL, coalesce((SELECT max(e) FROM spans s WHERE s.doc_id = d.doc_id), 0) FROM bytes d
)
SELECT d.doc_id, any_value(length(h)) // 2 AS n_bytes, coalesce(sum(e - b), 0)::BIGINT AS n_removed, count(e) AS n_spans,
  sha256(unhex(coalesce(string_agg(substr(h, 2 * from_ + 1, 2 * (b - from_)), '' ORDER BY b, from_), ''))) AS kept_sha256
FROM bytes d JOIN cuts c ON d.doc_id = c.doc_id GROUP BY d.doc_id
"""
