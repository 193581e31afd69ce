"""What the training-data operators share: reading tables, the shared folder, groups and blobs."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null doc_id is judged after every other; this stands for it inside the operators.
NULL_ID = (1 << 63) - 1
GROUP_BYTES = 4 << 20
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Unset, it is made in local mode only, where driver and executors are one machine; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints", "attestry")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, *partition_by: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, what)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of a documents table, null texts empty; other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def group_count(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> int:
    """As many groups as keep the mean group at group_bytes of text."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, -(-int(total) // group_bytes))


def grouped(docs: DataFrame, groups: int) -> DataFrame:
    """texts() with its group g: rows of one doc_id meet in a group, and no other key is used, so no key is hot."""
    return docs.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")).select("g", "doc_id", "text")


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, th, rep) of the rows whose whole text also belongs to the smaller doc_id rep.

    Texts meet by two 64-bit hashes and their length, counted on the map side first; only groups with more than one
    doc_id are joined back, a join whose large keys Spark splits."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), *text_hash("text"), F.octet_length("text").alias("size"))
    key = ["th", "th2", "size"]
    many = keyed.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last")
    return keyed.join(many, key).where("doc_id > rep").select("doc_id", "th", "rep").distinct()


def text_hash(col: str) -> list:
    return [F.xxhash64(col).alias("th"), F.xxhash64(F.lit(7), col).alias("th2")]


# -- arrays -----------------------------------------------------------------

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
POLY = 0x9E3779B97F4A7C15 | 1
POLY_INV = pow(POLY, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        held = np.empty(size, np.uint64)
        held[0], at = 1, 1
        while at < size:
            more = min(at, size - at)
            held[at : at + more] = held[:more] * np.uint64(pow(base, at, 1 << 64))
            at += more
        if size <= 1 << 21:
            _POWERS[base] = held
    return held[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums s with s[e] - s[b] = POLY**b * (polynomial hash of data[b:e])."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(POLY, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[begin:end], which do not depend on the place."""
    raw = (prefix[end] - prefix[begin]) * powers(POLY_INV, int(len(prefix)))[begin]
    return mix(raw ^ ((end - begin).astype(np.uint64) << np.uint64(48)))


def released() -> None:
    """Gives memory that a finished group used back to the system, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def light(function):
    """A group function of (key, table) or (key, left, right) that gives its memory back when done."""

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = function(key, table)
        released()
        return out

    def two(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = function(key, left, right)
        released()
        return out

    return one if function.__code__.co_argcount == 2 else two


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def slices(sizes: list[int], limit: int):
    """Ranges of neighbouring items whose sizes add up to at most limit; a larger item is alone."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
