"""Drafts that arrive one after the other, parsed and verified as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.claims import parse_claims
from ..operators.retrieval import build_chunks
from ..plans.verify import verify


def draft_stream(spark, path: str, files: int = 100) -> DataFrame:
    """(draft_id, text) of the draft files that arrive below a folder, so many files a batch at most."""
    lines = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files).text(path)
    return lines.select(F.col("_metadata.file_path").alias("draft_id"), F.col("value").alias("text"))


def claim_stream(drafts: DataFrame) -> DataFrame:
    """The cited claims of a stream of drafts; parsing looks at one draft at a time, so it needs no state."""
    claims = parse_claims(drafts)
    return claims.select(F.xxhash64("draft_id", "claim_ord").alias("claim_id"), "draft_id", "claim_ord", "claim", "citation_keys")


def verify_stream(claims: DataFrame, sources: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Verdicts of a stream of claims against sources, a folder batch=n below path for each batch.

    A batch is verified by the plan for tables. A batch that is run again after a failure takes its own folder's place, so
    verdicts come once."""
    chunks = build_chunks(sources)

    def each(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            verify(batch.select("claim_id", "claim", "citation_keys"), chunks).write.mode("overwrite").parquet(f"{path}/batch={n}")

    writer = claims.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
