"""Stages of a corpus pipeline: each takes and, but for the last, returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard_join, line_dedup, packing, quality, suffix_dedup
from .common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars that of the text as it is now."""
    return df.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def keep_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the others go. The weights are learned on docs as they come."""
    weights = quality.learn(docs.select("doc_id", "text"), quality.trusted_of(table(spark, sf_dir, "labels")))
    return _documents(quality.quality_rules(docs.select(*COLUMNS), weights).where("kept"))


def drop_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many documents share."""
    return _documents(line_dedup.dedup_lines(docs.select(*COLUMNS)))


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near duplicates: five words, a similarity of at least 0.8.

    Texts without words are in no group and stay; rows of one doc_id are one document."""
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text"))
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    gone = stored(gone, "near-copies")
    if gone.count() <= jaccard_join.BROADCAST_ROWS:
        gone = F.broadcast(gone)
    marked = docs.select(*COLUMNS).withColumn("__own", F.xxhash64(F.coalesce("text", F.lit(""))))
    return marked.join(gone, marked["doc_id"].eqNullSafe(gone["__id"]) & (marked["__own"] == gone["__th"]), "left_anti").select(*COLUMNS)


def drop_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the 50-byte strings that a smaller doc_id also holds; characters stay whole."""
    out = suffix_dedup.remove_repeats(docs.select(*COLUMNS), whole_characters=True)
    return _documents(out.select("doc_id", F.col("kept").cast("string").alias("text"), "rest.lang", "rest.source", "rest.n_chars"))


def pack_tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
