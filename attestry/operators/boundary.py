"""Cutting a plan's lineage by a table in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame, what: str) -> DataFrame:
    """df written below spark.checkpoint.dir and read again.

    What follows plans from a scan, and lost executors find the files; the write happens at once. Unset, the setting is
    made in local mode only, where driver and executors are one machine; on a cluster that is an error."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints", "attestry")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
