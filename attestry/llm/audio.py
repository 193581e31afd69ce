"""Chroma fingerprints of audio columns and their alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, light, stored
from .suffix_dedup import _batches

RATE = 4000
FRAME, HOP = 1024, 256
LOW, HIGH = 110.0, 1760.0
SPAN = 8
#: Levels that split a filter's response into four.
LEVELS = (-0.35, 0.0, 0.35)


def filters() -> list[tuple[int, int, int, int]]:
    """Sixteen (kind, first pitch class, classes, frames) by rule: kinds 0-3, heights 2-8, widths 2-SPAN."""
    return [(i % 4, (5 * i) % 12 if i % 3 else 0, 2 + 2 * (i % 4), (2, 4, 6, SPAN)[(i // 2) % 4]) for i in range(16)]


def chroma(pcm: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(frames, 12): the energy of each pitch class in overlapping windows, each frame scaled to length one."""
    if len(pcm) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float32), FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = (hertz >= LOW) & (hertz <= HIGH)
    pitch = np.round(12 * np.log2(hertz[use] / 440.0)).astype(int) % 12
    out = power[:, use] @ np.eye(12)[pitch]
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-6), 0.0)


def fingerprint(pcm: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Unsigned 32-bit integers, two bits of each of sixteen filters, one integer for each SPAN frames.

    The filters compare sums of rectangles of the chroma image, which an integral image gives in four look-ups."""
    image = chroma(pcm, rate)
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.hstack([image, image])  # pitch classes go round
    total = np.zeros((len(image) + 1, 25))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t: int, y: int, width: int, height: int) -> np.ndarray:
        return total[at + t + width, y + height] - total[at + t, y + height] - total[at + t + width, y] + total[at + t, y]

    out = np.zeros(n, np.uint32)
    for kind, y, height, width in filters():
        half_w, half_h = width // 2, height // 2
        if kind == 0:  # lower against upper classes
            a, b = area(0, y, width, half_h), area(0, y + half_h, width, half_h)
        elif kind == 1:  # earlier against later frames
            a, b = area(0, y, half_w, height), area(half_w, y, half_w, height)
        elif kind == 2:  # one diagonal against the other
            a = area(0, y, half_w, half_h) + area(half_w, y + half_h, half_w, half_h)
            b = area(half_w, y, half_w, half_h) + area(0, y + half_h, half_w, half_h)
        else:  # the rectangle against the rest of its frames
            a, b = area(0, y, width, height), area(0, 0, width, 12) - area(0, y % 12, width, min(height, 12 - y % 12))
        level = np.digitize(np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0)), LEVELS)
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return out


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """(share of different bits, integers compared) with a[i + offset] beside b[i]."""
    begin_a, begin_b = max(0, offset), max(0, -offset)
    n = min(len(a) - begin_a, len(b) - begin_b)
    if n <= 0:
        return 1.0, 0
    return float(np.bitwise_count(a[begin_a : begin_a + n] ^ b[begin_b : begin_b + n]).sum()) / (32 * n), n


def render(vector: list[float] | None, rate: int = RATE, seconds: float = 0.125) -> np.ndarray:
    """A recording of a vector: a note for each coordinate, its pitch the coordinate in 1/48 steps over two octaves.

    The tables have no audio; this gives the media operator a column whose near copies come from near vectors."""
    if not vector:
        return np.zeros(0, np.int16)
    pitch = 220.0 * 2 ** (np.round(np.clip(np.nan_to_num(np.array(vector, float)), -1, 1) * 48) / 24)
    step = np.repeat(2 * np.pi * pitch / rate, int(rate * seconds))
    return (np.sin(np.cumsum(step)) * 12000).astype(np.int16)


def fingerprints(media: DataFrame, id_col: str, column: str, rendered: bool = False) -> DataFrame:
    """(id, n_codes, codes): the fingerprint of each row's recording.

    column: binary of little-endian 16-bit samples at RATE, or a vector to render. Null and short recordings have no
    codes. Rows are independent; other columns are left behind."""

    def run(batches):
        for batch in batches:
            codes = [fingerprint(render(x.as_py()) if rendered else np.frombuffer(x.as_py() or b"", "<i2")) for x in batch.column("media")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in codes], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in codes], pa.binary())], ["id", "n_codes", "codes"])

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("media")).mapInArrow(run, "id long, n_codes long, codes binary")


#: Keys of each place, and bits of each key.
TABLES, KEY_BITS = 3, 32
#: A key takes bits from so many codes on; shorter recordings have no keys.
REACH = 16


def picked(table: int) -> list[tuple[int, int]]:
    """(codes on, bit) of a key's bits by rule: each filter's leading bit, in every other code up to REACH.

    A leading bit changes only where a filter's response changes sign, and distant codes share no frames."""
    return [(2 * ((3 * i + i // 16 + 2 * table) % (REACH // 2 + 1)), 1 + 2 * ((9 * i + 5 * table) % 16)) for i in range(KEY_BITS)]


def keys_at(codes: np.ndarray, table: int) -> np.ndarray:
    """The key of each place of a fingerprint, the table's number above its bits."""
    n = max(0, len(codes) - REACH)
    out = np.full(n, table, np.int64)
    for on, bit in picked(table):
        out = out << 1 | (codes[on : on + n] >> np.uint32(bit) & np.uint32(1)).astype(np.int64)
    return out


class Asked:
    """A block of queries: their codes, and an index from each key to the places that have it."""

    def __init__(self, ids: list[int], codes: list[bytes]):
        self.ids = ids
        self.codes = [np.frombuffer(x, "<u4") for x in codes]
        keys, owner, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for i, x in enumerate(self.codes):
            own, at = every_key(x)
            keys.append(own)
            owner.append(np.full(len(own), i, np.int32))
            place.append(at)
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.keys, self.owner, self.place = key[order], np.concatenate(owner)[order], np.concatenate(place)[order]

    def offsets(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The histogram of a recording: (query, offset, votes), a query's place less the recording's for equal keys."""
        key, at = every_key(codes)
        first, last = np.searchsorted(self.keys, key, side="left"), np.searchsorted(self.keys, key, side="right")
        n = last - first
        hit = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        voted = (self.owner[hit].astype(np.int64) << 32) + (self.place[hit].astype(np.int64) - np.repeat(at, n).astype(np.int64) + (1 << 31))
        found, votes = np.unique(voted, return_counts=True)
        return found >> 32, (found & ((1 << 32) - 1)) - (1 << 31), votes


def every_key(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of each key of each place; of a run of equal keys its first and its last place."""
    keys, places = [], []
    for table in range(TABLES):
        own = keys_at(codes, table)
        new = np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]
        at = np.flatnonzero(new | np.append(new[1:], True)[: len(own)])
        keys.append(own[at])
        places.append(at.astype(np.int32))
    return np.concatenate(keys), np.concatenate(places)


#: Bytes of codes of a part of the recordings and of a block of the queries; a block's index takes twelve times as much.
PART_BYTES = BLOCK_BYTES = 16 << 20
MATCHES = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("copies", pa.int64()), ("offset", pa.int32()), ("errors", pa.float64()), ("overlap", pa.int64())])


def _meet(errors: float, overlap: int):
    @light
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            asked = Asked(column(right, "q"), column(right, "q_codes"))
            for i, raw, copies in zip(column(left, "id"), left.column("codes"), column(left, "copies"), strict=True):
                codes = np.frombuffer(raw.as_py(), "<u4")
                best: dict[int, tuple] = {}
                for q, offset, _ in zip(*(x.tolist() for x in asked.offsets(codes)), strict=True):
                    if asked.ids[q] == i or min(len(asked.codes[q]) - max(0, offset), len(codes) - max(0, -offset)) < overlap:
                        continue
                    wrong, n = bit_errors(asked.codes[q], codes, offset)
                    if wrong <= errors:
                        best[q] = min(best.get(q, (2.0,)), (wrong, -n, offset))
                rows += [(asked.ids[q], i, copies, offset, wrong, -n) for q, (wrong, n, offset) in best.items()]
        return _batches(rows, MATCHES)

    return run


def align(prints: DataFrame, every: int = 20, errors: float = 0.2, overlap: int = 32) -> DataFrame:
    """prints with is_query, n_matches, best_match, best_offset and best_errors.

    Queries are the rows whose id is divisible by every; blocks of them meet all rows, part by part, so that all votes of
    two recordings meet in one task. Recordings with equal codes are one. Others are compared at each offset (of at least overlap codes in common) of the histogram of places with an equal key (of a
    run of equal keys, its ends): a match has at most errors different bits there, and counts at the offset of least
    errors, then the longest overlap, then the smaller offset. Matches that share no key at their offset are not found
    (README has the recall).
    n_matches counts all other recordings matched, copies included, repeated rows of an id once; best_match is that of
    least errors, then least id. Rows with a null id or no codes match nothing. Empty table: empty result."""
    whole = prints.withColumn("fp", F.sha2("codes", 256))
    known = whole.where("n_codes > 0 AND id IS NOT NULL").select("fp", "id").distinct()
    groups = known.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max((F.col("id") % every == 0).cast("int")).alias("asked"))
    second = known.join(groups.where("copies > 1"), "fp").where("id > rep").groupBy("fp").agg(F.min("id").alias("second"))
    groups = stored(groups.join(second, "fp", "left"), "groups")
    reps = stored(whole.join(groups.select("fp", "rep", "asked", "copies"), "fp").where("id = rep").dropDuplicates(["id"]).select("id", "codes", "asked", "copies"), "recordings")
    queries = reps.where("asked = 1")
    size = lambda df: df.agg(F.coalesce(F.sum(F.octet_length("codes").cast("long")), F.lit(0))).first()[0]
    parts = max(-(-size(reps) // PART_BYTES), reps.sparkSession.sparkContext.defaultParallelism)
    blocks = max(1, -(-size(queries) // BLOCK_BYTES))
    dealt = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = reps.select(dealt(parts, 1).alias("part"), each(blocks).alias("block"), "id", "codes", "copies")
    right = queries.select(each(parts).alias("part"), dealt(blocks, 2).alias("block"), F.col("id").alias("q"), F.col("codes").alias("q_codes"))
    meeting = left.groupBy("part", "block").cogroup(right.groupBy("part", "block"))
    matches = meeting.applyInArrow(_meet(errors, overlap), "q long, id long, copies long, offset int, errors double, overlap long")
    best = matches.groupBy(F.col("q").alias("rep")).agg(F.sum("copies").alias("others"), F.min_by(F.struct("id", "offset", "errors"), F.struct("errors", "id")).alias("near"))
    out = whole.join(groups.select("fp", "rep", "copies", "second"), "fp", "left").join(best, "rep", "left")
    query_row = (F.col("id") % every == 0) & F.col("rep").isNotNull()
    twin = F.when(F.col("rep") != F.col("id"), F.col("rep")).otherwise(F.col("second"))
    return out.select(
        "id", "n_codes", "fp", F.coalesce(query_row, F.lit(False)).alias("is_query"),
        F.when(query_row, F.coalesce("others", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long").alias("n_matches"),
        F.when(query_row, F.coalesce(twin, F.col("near.id"))).alias("best_match"),
        F.when(query_row, F.when(twin.isNotNull(), 0).otherwise(F.col("near.offset"))).cast("int").alias("best_offset"),
        F.when(query_row, F.when(twin.isNotNull(), 0.0).otherwise(F.col("near.errors"))).alias("best_errors"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    prints = stored(fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", rendered=True), "fingerprints")
    return align(prints).withColumnsRenamed({"id": "vec_id", "fp": "codes_sha256"})
