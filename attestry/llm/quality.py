"""Quality rules: base counts and a hashed n-gram log-likelihood ratio. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_CLASS

BUCKETS = 1 << 15
#: Kept: a mean log-likelihood ratio of at least this (see README, "Quality rules").
THRESHOLD = -0.5
SMOOTH = 1.0


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_CLASS + "+"), lambda w: w != "")


def ngrams(hashes: str, buckets: int) -> Column:
    """Buckets of the tokens and of the pairs of neighbours; hashes: 64-bit hashes of the tokens."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    two = F.when(F.size(hashes) > 1, F.transform(F.sequence(F.lit(0), F.size(hashes) - 2), lambda i: F.pmod(F.xxhash64(F.col(hashes)[i], F.col(hashes)[i + 1]), F.lit(buckets)).cast("int")))
    return F.concat(one, F.coalesce(two, F.array().cast("array<int>")))


def endings() -> Column:
    """The hash of each word's last three characters, the tokens of the model. There are few of them in any corpus, so
    their counts per bucket keep their meaning as the corpus grows, which those of whole rare words don't."""
    return F.transform("__words", lambda w: F.xxhash64(F.substring(w, -3, 3)))


def hashed(docs: DataFrame) -> DataFrame:
    """docs with __hs: the hashes that n-grams are made of."""
    return docs.withColumn("__words", words(F.col("text"))).withColumn("__hs", endings())


#: Trusted doc_ids are broadcast up to so many (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def learn(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Weights log(p_trusted / p_raw) of the buckets, add-one smoothed.

    docs is the raw corpus, all of it, counted where it is read; trusted has the doc_id of the trusted target's documents,
    which are counted once more. The result has a fixed length whatever the corpus."""
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    bare = docs.select("doc_id", "text")

    def counted(df: DataFrame, target: bool) -> DataFrame:
        return hashed(df).select(F.explode(ngrams("__hs", buckets)).alias("b")).groupBy("b").agg(F.count("*").alias("n")).withColumn("target", F.lit(target))

    rows = counted(bare, False).unionByName(counted(bare.join(ids, "doc_id", "left_semi"), True)).collect()  # two for each bucket
    raw, target = [SMOOTH] * buckets, [SMOOTH] * buckets
    for r in rows:
        (target if r["target"] else raw)[r["b"]] += r["n"]
    n_raw, n_target = sum(raw), sum(target)
    return [math.log(t / n_target) - math.log(r / n_raw) for t, r in zip(target, raw, strict=True)]


def base_counts(docs: DataFrame) -> DataFrame:
    """docs, which have __words, with the base columns.

    A word is in a repeated window if its 3-word window occurs elsewhere in the text. Windows are compared by 64-bit
    hashes; few repeated hashes are looked up one by one, many by a sort of (hash, place)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    out = docs.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(WHITE_CLASS))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "__lines": lines,
        "__win": F.when(F.size("__words") > 2, F.transform(F.sequence(F.lit(0), F.size("__words") - 3), lambda i: F.xxhash64(F.col("__words")[i], F.col("__words")[i + 1], F.col("__words")[i + 2]))),
    })
    out = out.withColumns({"n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), "__sorted": F.sort_array("__win")})
    out = out.withColumn("__twice", F.when(F.size("__win") > F.size(F.array_distinct("__win")), F.array_distinct(F.filter("__sorted", lambda h, i: h == F.get("__sorted", i + 1)))))
    few = F.filter(F.sequence(F.lit(0), F.size("__win") - 1), lambda i: F.array_contains("__twice", F.col("__win")[i]))
    out = out.withColumn("__places", F.when(F.size("__twice") > 16, F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    place = F.col("__places")
    many = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("__win") - 1), lambda j: (place[j]["h"] == F.get(place, j - 1)["h"]) | (place[j]["h"] == F.get(place, j + 1)["h"])),
        lambda j: place[j]["i"],
    )
    out = out.withColumn("__at", F.when(F.col("__places").isNotNull(), many).when(F.size("__twice") > 0, few))
    union = F.array_distinct(F.concat("__at", F.transform("__at", lambda i: i + 1), F.transform("__at", lambda i: i + 2)))
    out = out.withColumn("n_repeat_words", F.when(F.col("__at").isNull(), 0).otherwise(F.size(union)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.drop("__lines", "__win", "__sorted", "__twice", "__places", "__at")


def quality_rules(docs: DataFrame, weights: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base columns, score and kept.

    score: the weights of the document's tokens and pairs of tokens, added and divided by their number; 0 without words.
    kept: not base_failed and score >= threshold, so one document always gets the same verdict. Null text: no words, so
    base_failed. Rows are judged each; other columns pass through."""
    table = F.lit(weights)
    out = base_counts(docs.withColumn("__words", words(F.col("text"))))
    out = out.withColumn("__hs", endings())
    out = out.withColumn("__ng", ngrams("__hs", len(weights)))
    total = F.aggregate("__ng", F.lit(0.0), lambda s, b: s + F.element_at(table, b + 1))
    out = out.withColumn("score", F.when(F.size("__ng") > 0, total / F.size("__ng")).otherwise(F.lit(0.0)))
    # spark_partition_id() is not deterministic: it keeps a filter on kept from being pushed below, where the optimizer
    # would put the columns' whole expressions in place of their names and evaluate them for every element
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)) & (F.spark_partition_id() >= 0))
    return out.drop("__words", "__hs", "__ng")


def trusted_of(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table, texts

    docs = texts(table(spark, sf_dir, "documents"))
    weights = learn(docs, trusted_of(table(spark, sf_dir, "labels")))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return quality_rules(docs, weights).select(*names)
