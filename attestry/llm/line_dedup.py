"""Line dedup by levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NULL_ID, UPPER, WHITE, scratch, stored, texts

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased. Spark's lower() is right for lines of ASCII only."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class LineRuns:
    """Sorted runs of line hashes in levels, as in a log-structured merge tree, which decide what lines go.

    A run is a bucketed table of (h1, h2, n_docs, keeper): for each hash the number of documents that hold it and the
    largest of their doc_ids. All runs have the same buckets, sorted by hash, so runs meet bucket by bucket without an
    exchange. add() merge-anti-joins a batch against the runs: hashes that no run holds become a run of level 0, so a hash
    is in one run only; the counts of hashes already held become repeats, a run beside them. Batches hold whole documents,
    so counts add up. When a level has fanout runs they are merged into one run of the next level."""

    def __init__(self, spark, fanout: int = 2, root: str | None = None, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.root = root or scratch(spark, "line-runs")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix = f"line_run_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.repeats: list[str] = []
        self.written = 0

    def _write(self, df: DataFrame) -> str:
        """The name of a run of df, which is dealt by hash already where it comes from an aggregate or another run."""
        self.written += 1
        name = f"{self.prefix}_{self.written}"
        df.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.root}/{self.written}").saveAsTable(name)
        return name

    def _runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _with(self, run: DataFrame, name: str, how: str) -> DataFrame:
        """A run joined with another by hash, bucket by bucket, their counts added up."""
        other = self.spark.table(name).withColumnsRenamed({"n_docs": "__n", "keeper": "__k"}).hint("merge")
        total = F.coalesce("n_docs", F.lit(0)) + F.coalesce("__n", F.lit(0))
        return run.join(other, KEY, how).select(*KEY, total.alias("n_docs"), F.greatest("keeper", "__k").alias("keeper"))

    def _merged(self, names: list[str]) -> str:
        """One run of several, written two by two."""
        out = names[0]
        for name in names[1:]:
            out = self._write(self._with(self.spark.table(out), name, "full_outer"))
        return out

    def novel(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose hash no run holds."""
        for name in self._runs():
            batch = batch.join(self.spark.table(name).select(*KEY).hint("merge"), KEY, "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, n_docs, keeper), a row for each hash."""
        if not self._runs():
            self._put(self._write(batch), 0)
            return
        whole = self._write(batch)
        fresh = self._write(self.novel(self.spark.table(whole)))
        again = self.spark.table(whole).join(self.spark.table(fresh).select(*KEY).hint("merge"), KEY, "left_anti")
        self.repeats.append(self._write(again))
        if len(self.repeats) >= 2 * self.fanout:
            self.repeats = [self._merged(self.repeats)]
        self._put(fresh, 0)

    def _put(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merged(self.levels[level])
            self.levels[level] = []
            self._put(merged, level + 1)

    def frequent(self, docs: int) -> DataFrame:
        """(h1, h2, keeper) of the hashes of at least that many documents.

        A repeat's hash is in one run, so each run meets the repeats by itself."""
        self.repeats = [self._merged(self.repeats)] if self.repeats else []
        parts = [reduce(lambda df, name: self._with(df, name, "left"), self.repeats, self.spark.table(run)) for run in self._runs()]
        return reduce(DataFrame.unionByName, parts).where(F.col("n_docs") >= docs).select(*KEY, "keeper")

    def forget(self) -> None:
        """Takes the runs' names out of the catalog; their files stay in the shared folder."""
        for n in range(1, self.written + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{n}")


def line_drops(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(doc_id, th, drops): the places of the lines that go, by document."""
    spark = docs.sparkSession
    lines = docs.select("did", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("did", "th", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    lines = lines.select("did", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), F.pmod(F.xxhash64("did"), F.lit(batches)).cast("int").alias("batch"))
    path = scratch(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        held = lines.where(F.col("batch") == b).groupBy(*KEY, "did").agg(F.lit(1).alias("one"))
        runs.add(held.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("did").alias("keeper")))
    frequent = stored(runs.frequent(min_docs), "frequent-lines")
    runs.forget()
    gone = lines.join(frequent, KEY).where(F.col("did") != F.col("keeper"))
    return gone.groupBy("did", "th").agg(F.collect_set("pos").alias("drops"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with columns n_lines, n_dropped and a text without the frequent lines.

    Keys (see line_key) of at least min_chars code points found in at least min_docs documents lose all their lines
    except in the largest doc_id that holds them. Null or empty text: one empty line, which stays; a null text stays
    null. A null doc_id is a document of its own before all others. Rows that share a doc_id are one document; each
    row is cut by its own lines. Other columns pass through. Empty table: empty result."""
    marked = docs.withColumns({"__did": F.coalesce(F.col("doc_id").cast("long"), F.lit(-NULL_ID - 1)), "__th": F.xxhash64(F.coalesce("text", F.lit("")))})
    bare = marked.select(F.col("__did").alias("did"), F.col("__th").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    drops = line_drops(bare, min_chars, min_docs, batches, fanout)
    drops = drops.select(F.col("did").alias("__did"), F.col("th").alias("__th"), F.col("drops").alias("__drops"))
    out = marked.join(drops, ["__did", "__th"], "left")
    lines = out.withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    lines = lines.withColumn("n_lines", F.size("__lines").cast("long"))
    lines = lines.withColumn("n_dropped", F.when(F.col("__drops").isNull(), F.lit(0).cast("long")).otherwise(F.size("__drops").cast("long")))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drops"))
    kept = F.array_join(F.transform(left, lambda i: F.element_at("__lines", i + 1)), "\n")
    return lines.withColumn("text", F.when(F.col("__drops").isNull(), F.col("text")).otherwise(kept)).drop("__did", "__th", "__drops", "__lines")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = dedup_lines(texts(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(f.keeper <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
