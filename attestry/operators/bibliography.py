"""Bibliography integrity, source alignment and metadata matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, tokens
from .boundary import cut
from .claims import citation_keys

# fixed values: required fields, weights and thresholds
REQUIRED = {"article": ["author", "title", "journal", "year"], "book": ["author", "title", "publisher", "year"], "incollection": ["author", "title", "booktitle", "publisher", "year"], "inproceedings": ["author", "title", "booktitle", "year"], "phdthesis": ["author", "title", "school", "year"], "techreport": ["author", "title", "institution", "year"], "misc": ["title", "year"]}
TITLE_WEIGHT, YEAR_WEIGHT, AUTHOR_WEIGHT, DOI_WEIGHT = 0.68, 0.12, 0.10, 0.10
VERIFIED, MISMATCH, ALIGNED = 0.82, 0.55, 0.55
NO_HIT = "No external metadata hit found."


def tex_keys(texts: DataFrame, text: str = "text") -> DataFrame:
    """Citation keys of each line of a TeX text that isn't a comment, with their place: key, occurrence each."""
    keep = [c for c in texts.columns if c != text]
    lines = texts.select(*keep, F.explode(F.split(text, r"\r\n|\n|\r")).alias("__line")).where(~strip(F.col("__line")).startswith("%"))
    return lines.select(*keep, F.explode(citation_keys(F.col("__line"))).alias("key"))


def missing_keys(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct cited keys without an entry."""
    return cited.select("key").distinct().join(entries.select("key"), "key", "left_anti")


def unused_keys(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """Keys of entries that nothing cites."""
    return entries.select("key").distinct().join(cited.select("key"), "key", "left_anti")


def missing_fields(entry_type: Column, fields: Column) -> Column:
    """Required fields that are absent or empty, sorted."""
    known = F.create_map(*[x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    required = F.coalesce(F.try_element_at(known, entry_type), F.array(F.lit("title"), F.lit("year")))
    return F.array_sort(F.filter(required, lambda f: F.coalesce(F.try_element_at(fields, f), F.lit("")) == ""))


def incomplete(entries: DataFrame) -> DataFrame:
    return entries.select("key", missing_fields(F.col("entry_type"), F.col("fields")).alias("missing")).where(F.size("missing") > 0)


def bibliography_report(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: occurrences, distinct keys, and the sorted missing, unused and incomplete keys."""
    listed = lambda df: df.agg(F.array_sort(F.collect_set("key")).alias("keys"))
    counts = cited.agg(F.count("*").alias("occurrences"), F.count_distinct("key").alias("cited"))
    parts = incomplete(entries).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "missing")))).alias("incomplete"))
    out = counts.join(listed(missing_keys(cited, entries)).withColumnRenamed("keys", "missing")).join(listed(unused_keys(cited, entries)).withColumnRenamed("keys", "unused")).join(parts).join(entries.agg(F.count_distinct("key").alias("entries")))
    return out.withColumns({"errors": F.size("missing"), "warnings": F.size("unused") + F.coalesce(F.size("incomplete"), F.lit(0))})


def trusted_sources(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """Sources whose citation key is an entry with a title."""
    titled = entries.where(F.coalesce(F.try_element_at("fields", F.lit("title")), F.lit("")) != "").select(F.col("key").alias("citation_key"))
    return sources.join(titled, "citation_key", "left_semi")


def align_sources(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """sources with the citation key and title of the entry whose title they cover best, each entry used once.

    Candidates come from a join on title tokens. Sources choose in the order of path, each the best entry left, which
    is the one stable matching when every entry prefers the earlier source: in rounds, each source asks for its best
    entry, entries keep the earliest that asks, and the others lose that entry. No round gathers more than a key's rows."""
    titles = entries.select("key", "entry_ord", F.try_element_at("fields", F.lit("title")).alias("entry_title"))
    titles = titles.withColumn("t", F.array_distinct(tokens(F.col("entry_title")))).where(F.size("t") > 0)
    left = sources.select("source_id", F.explode(F.array_distinct(tokens(F.coalesce("title", "source_id")))).alias("token"))
    pairs = left.join(titles.select("key", F.size("t").alias("n"), F.explode("t").alias("token")), "token").groupBy("source_id", "key", "n").count()
    pairs = pairs.withColumn("score", F.col("count") / F.col("n")).where(F.col("score") >= ALIGNED)
    pairs = cut(pairs.join(sources.select("source_id", "path"), "source_id").join(titles.select("key", "entry_ord", "entry_title"), "key"), "alignable")
    while True:
        asks = pairs.groupBy("source_id").agg(F.max_by(F.struct("key", "path", "entry_title"), F.struct(F.col("score"), -F.col("entry_ord"))).alias("a")).select("source_id", "a.*")
        kept = asks.groupBy("key").agg(F.min(F.struct("path", "source_id")).alias("k")).select("key", F.col("k.source_id").alias("source_id"))
        lost = cut(asks.join(kept, ["source_id", "key"], "left_anti").select("source_id", "key"), "lost")
        if lost.isEmpty():
            break
        pairs = cut(pairs.join(lost, ["source_id", "key"], "left_anti"), "alignable")
    out = sources.join(asks.select("source_id", "key", "entry_title"), "source_id", "left")
    return out.withColumns({"citation_key": F.coalesce("key", "citation_key"), "title": F.coalesce("entry_title", "title")}).drop("key", "entry_title")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Twice the matching characters over all characters, matches found longest first; Spark has no such function."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(ratio, "double")(a, b)


def _norm(text: Column) -> Column:
    return F.array_join(tokens(F.coalesce(text, F.lit(""))), " ")


def _last_names(names: Column) -> Column:
    last = F.transform(names, lambda n: F.regexp_replace(F.element_at(F.split(F.lower(strip(F.when(n.contains(","), F.substring_index(n, ",", 1)).otherwise(n))), r"\s+"), -1), "[^a-z]", ""))
    return F.array_distinct(F.filter(last, lambda n: n != ""))


def score_metadata(pairs: DataFrame) -> DataFrame:
    """pairs of entries (fields) and records (record: title, year, authors, doi) with score and its four parts."""
    field = lambda n: F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit(""))
    rec = lambda n: F.coalesce(F.col("record")[n], F.lit(""))
    a, b = _norm(field("title")), _norm(rec("title"))
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    jaccard = F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    same = (a == "") | (b == "") | (jaccard >= 1)  # the ratio can't add to these
    title = F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(jaccard, sequence_ratio(F.when(~same, a), F.when(~same, b))))
    doi = lambda d: strip(F.replace(F.lower(d), F.lit("https://doi.org/"), F.lit("")))
    alike = lambda p, q, same: F.when((p == "") | (q == ""), F.lit(0.5)).when(same, F.lit(1.0)).otherwise(F.lit(0.0))
    ours, theirs = _last_names(F.split(field("author"), r"\s+and\s+")), _last_names(F.coalesce(F.col("record")["authors"], F.array().cast("array<string>")))
    author = F.when((F.size(ours) == 0) | (F.size(theirs) == 0), F.lit(0.5)).otherwise(F.size(F.array_intersect(ours, theirs)) / F.size(ours))
    out = pairs.withColumns({"title_score": title, "year_score": alike(field("year"), rec("year"), field("year") == rec("year")), "author_score": author, "doi_score": alike(field("doi"), rec("doi"), doi(field("doi")) == doi(rec("doi")))})
    score = TITLE_WEIGHT * F.col("title_score") + YEAR_WEIGHT * F.col("year_score") + AUTHOR_WEIGHT * F.col("author_score") + DOI_WEIGHT * F.col("doi_score")
    score = F.when(F.col("year_score") == 0.0, F.least(score, F.lit(0.81))).otherwise(score)
    return out.withColumn("score", F.when(F.col("doi_score") == 0.0, F.least(score, F.lit(0.54))).otherwise(score))


def verify_metadata(entries: DataFrame, records: DataFrame) -> DataFrame:
    """A status for each entry (key, fields) from records fetched for it: key, provider_ord, record_ord, provider, record.

    The best score counts, the earlier record on ties; an entry without title and DOI is skipped. Records may say error,
    with a null record where a service failed or had nothing: an entry that no record was found for is then in error if a
    service failed, and api_calls counts the services asked."""
    if "error" not in records.columns:
        records = records.withColumn("error", F.lit(None).cast("string"))
    scored = score_metadata(entries.select("key", "fields").join(records.where("record IS NOT NULL"), "key"))
    best = scored.groupBy("key").agg(F.max_by(F.struct("score", "provider", "record", "title_score", "year_score", "author_score", "doi_score"), F.struct(F.col("score"), -F.col("provider_ord"), -F.col("record_ord"))).alias("b"))
    failed = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("provider_ord", F.concat_ws(": ", "provider", "error").alias("said")))))
    asked = records.groupBy("key").agg(F.count_distinct("provider_ord").cast("int").alias("calls"), F.array_join(failed["said"], "; ").alias("failed"))
    field = lambda n: F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit(""))
    out = entries.select("key", "fields").join(best, "key", "left").join(asked, "key", "left")
    skip, s, failure = (field("title") == "") & (field("doi") == ""), F.col("b.score"), F.coalesce(F.col("failed"), F.lit("")) != ""
    status = F.when(skip, "skipped").when(s.isNull(), F.when(failure, "error").otherwise("not_found")).when(s >= VERIFIED, "verified").when(s >= MISMATCH, "mismatch").otherwise("not_found")
    nothing = F.when(failure, F.concat(F.lit(NO_HIT + " Provider errors: "), "failed")).otherwise(NO_HIT)
    reason = F.format_string("title=%.2f, year=%.2f, authors=%.2f, doi=%.2f", "b.title_score", "b.year_score", "b.author_score", "b.doi_score")
    reason = F.when(skip, "Entry has neither title nor DOI.").when(s.isNull(), nothing).otherwise(reason)
    calls = F.when(skip, 0).otherwise(F.coalesce("calls", F.lit(0))).alias("api_calls")
    return out.select("key", status.alias("status"), F.when(skip | s.isNull(), F.lit(0.0)).otherwise(F.bround(s, 3)).alias("confidence"), reason.alias("reason"), "b.provider", F.col("b.record.title").alias("matched_title"), F.col("b.record.year").alias("matched_year"), F.col("b.record.doi").alias("matched_doi"), calls)


def hallmark_labels(checks: DataFrame) -> DataFrame:
    """Predictions of made-up references from metadata checks."""
    s, c = F.col("status"), F.col("confidence")
    label = F.when(s == "verified", "VALID").when(s.isin("mismatch", "not_found"), "HALLUCINATED").otherwise("UNCERTAIN")
    sure = F.when(s == "verified", c).when(s == "mismatch", F.greatest(c, F.lit(0.65))).when(s == "not_found", F.lit(0.65)).otherwise(F.lit(0.5))
    return checks.select(F.col("key").alias("bibtex_key"), label.alias("label"), sure.alias("confidence"), "reason", F.col("provider").alias("source"))


def bind_blocks(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """Claims (claim_id, claim, citation_keys) bound to document blocks (block_ord, text) by key, text first.

    A block whose normalised text holds the claim wins over blocks that only share a key; the first one counts."""
    norm = lambda t: F.regexp_replace(F.lower(t), r"[^a-z0-9]+", " ")
    cited = blocks.withColumn("key", F.explode(citation_keys(F.col("text"))))
    met = claims.withColumn("key", F.explode("citation_keys")).join(cited, "key")
    inside = norm(F.col("text")).contains(strip(norm(F.col("claim"))))
    return met.groupBy("claim_id").agg(F.max_by("block_ord", F.struct(inside.cast("int"), -F.col("block_ord"))).alias("block_ord"), F.max(inside).alias("by_text"))


__all__ = ["align_sources", "bibliography_report", "bind_blocks", "hallmark_labels", "incomplete", "missing_keys", "score_metadata", "tex_keys", "trusted_sources", "unused_keys", "verify_metadata"]
