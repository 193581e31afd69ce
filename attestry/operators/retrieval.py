"""Claims to source chunks and sentence windows: joins on citation keys, scores and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunks, expanded_tokens, found, has, joined_capitals, likeness, tokens, windows
from .support import metric_support, survey_claim, survey_evidence, survey_support

# fixed values: bonuses, limits and cues of the ranking
ANCHOR_BONUS, SURVEY_BONUS = 0.25, 0.6
CONFLICT_RERANK, METRIC_RERANK, SURVEY_RERANK = 0.22, 0.3, 0.4
CHUNK_LIMIT, WINDOW_LIMIT, MIN_SCORE = 8, 5, 0.08
ANCHOR = r"\b(?:[A-Z]+[A-Za-z0-9.-]*\d+[A-Za-z0-9.-]*|[A-Z][A-Za-z]*[A-Z][A-Za-z0-9.]*|[A-Z][a-z]+[A-Z][A-Za-z0-9.]*|[A-Z]{3,}[A-Za-z0-9.-]*)\b"
CONFLICT_CUE = r"\b(unchanged|no\s+change|no\s+difference|no\s+improvement|no\s+reduction|does\s+not\s+improve|did\s+not\s+improve|failed\s+to\s+improve|not\s+statistically\s+significant|comparable\s+to|equivalent\s+to|worse\s+than)\b"
IDENTITY = r"^(.+?)\s+is\s+(?:an?|the)\s+.+\b(?:benchmark|collection|corpus|dataset)\b"


def build_chunks(sources: DataFrame) -> DataFrame:
    """sources (source_id, citation_key, title, text[, pages]) to chunks: chunk_ord, chunk_id, page, chunk.

    Pages that aren't blank are numbered from 1 and chunked each; a source without pages is chunked whole."""
    has_pages = "pages" in sources.columns
    pages = F.filter(F.col("pages"), lambda p: F.btrim(p, F.lit(" \t\n\r\x0b\x0c")) != "") if has_pages else F.lit(None).cast("array<string>")
    out = sources.withColumn("__pages", pages).withColumn("__paged", F.coalesce(F.size("__pages") > 0, F.lit(False)))
    out = out.select("source_id", "citation_key", "title", "__paged", F.posexplode(F.when(F.col("__paged"), F.col("__pages")).otherwise(F.array("text"))).alias("__p", "__text"))
    out = out.withColumn("__chunks", chunks(F.col("__text")))
    out = out.select("source_id", "citation_key", "title", "__paged", "__p", F.posexplode_outer("__chunks").alias("__i", "chunk")).where("chunk IS NOT NULL")
    page = F.when(F.col("__paged"), F.col("__p") + 1)
    name = F.when(F.col("__paged"), F.concat_ws(":", "source_id", F.concat(F.lit("p"), page), F.col("__i"))).otherwise(F.concat_ws(":", "source_id", F.col("__i")))
    return out.select("source_id", "citation_key", "title", page.alias("page"), name.alias("chunk_id"), (F.col("__p") * 1_000_000 + F.col("__i")).cast("long").alias("chunk_ord"), "chunk")


def anchors(claim: Column) -> Column:
    """Tokens of the claim's acronyms and names."""
    names = found(joined_capitals(claim), ANCHOR, ignore_case=False)
    return F.array_distinct(F.flatten(F.transform(names, expanded_tokens)))


def unresolved(claims: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """Claims (claim_id, citation_keys) with a key that no chunk has."""
    keys = claims.select("claim_id", F.explode("citation_keys").alias("citation_key"))
    return keys.join(chunk_rows.select("citation_key").distinct(), "citation_key", "left_anti").select("claim_id").distinct()


def rank_chunks(claims: DataFrame, chunk_rows: DataFrame, limit: int = CHUNK_LIMIT, words=expanded_tokens, bonuses: bool = True) -> DataFrame:
    """The best chunks of each claim: n_shared, n_claim, n_chunk, chunk_score, chunk_rank. Ties go to the earlier chunk.

    claims: claim_id, claim, citation_keys. An inverted index: claims meet chunks on words, and for the bonuses on the
    tokens of their names and on the survey rules that both sides meet; claims with keys meet their sources' chunks only.
    Words, names and rules are found once for each text. Chunks are dealt out by chunk_id first, so pairs are counted where
    they are made; explodes are outer ones because Spark would evaluate the others' arrays twice."""
    side = claims.select("claim_id", "citation_keys", words(F.col("claim")).alias("t"), anchors(F.col("claim")).alias("a"), survey_claim(F.col("claim")).alias("s"))
    rows = chunk_rows.select("chunk_id", "citation_key", "source_id", "chunk_ord", "chunk").repartition("chunk_id")
    rows = rows.select("chunk_id", "citation_key", "source_id", "chunk_ord", words(F.col("chunk")).alias("t"), survey_evidence(F.col("chunk")).alias("s"))
    chunk = ["chunk_id", "source_id", "chunk_ord", "n_chunk"]
    index = rows.withColumn("n_chunk", F.size("t")).select("citation_key", *chunk, F.explode_outer("t").alias("on"))
    rules = rows.withColumn("n_chunk", F.size("t")).select("citation_key", *chunk, F.explode_outer("s").alias("on"))
    keyed = side.where(F.size("citation_keys") > 0).withColumn("citation_key", F.explode(F.array_distinct("citation_keys")))
    free = side.where(F.size("citation_keys") == 0)
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def met(part, right, shared, names, survey):
        cols = ["claim_id", "n_claim", F.explode(part).alias("on")]
        counted = [shared.alias("n_shared"), names.alias("n_names"), survey.alias("n_survey")]
        pick = lambda df, on: df.withColumn("n_claim", F.size("t")).select(*cols, *[c for c in on if c != "on"]).join(right, on).select("claim_id", "n_claim", *chunk, *counted)
        return pick(keyed, ["citation_key", "on"]).unionByName(pick(free, ["on"]))

    pairs, counts = met("t", index, one, none, none), [F.sum("n_shared").alias("n_shared")]
    score = F.col("n_shared") / F.sqrt(F.col("n_claim").cast("double") * F.col("n_chunk"))
    if bonuses:
        pairs = pairs.unionByName(met("a", index, none, one, none)).unionByName(met("s", rules, none, none, one))
        counts += [F.sum("n_names").alias("n_names"), F.max("n_survey").alias("n_survey")]
        score = score + ANCHOR_BONUS * F.col("n_names") + SURVEY_BONUS * F.col("n_survey")
    scored = pairs.groupBy("claim_id", "n_claim", *chunk).agg(*counts).withColumn("chunk_score", F.bround(score, 4)).drop("n_names", "n_survey")
    order = Window.partitionBy("claim_id").orderBy(F.desc("chunk_score"), "source_id", "chunk_ord")
    best = scored.withColumn("chunk_rank", F.row_number().over(order)).where(F.col("chunk_rank") <= limit)
    return best.where("chunk_score > 0").drop("source_id", "chunk_ord")


def retrieve(claims: DataFrame, chunk_rows: DataFrame, limit: int = CHUNK_LIMIT) -> DataFrame:
    """The chunks of rank_chunks() with all columns of the chunk, and the claim; texts join only what is ranked."""
    best = rank_chunks(claims, chunk_rows, limit)
    return best.join(claims.select("claim_id", "claim"), "claim_id").join(chunk_rows, "chunk_id")


def identity_holds(claim: Column, window: Column) -> Column:
    """For "X is a ... dataset" the window must name X: each longer token of X, or a word that begins like it."""
    subject = F.regexp_extract(claim, "(?iU)" + IDENTITY, 1)
    groups = F.array(*[F.filter(tokens(s), lambda w: F.length(w) > 3) for s in (subject, F.regexp_replace(subject, "(?<=[a-z])(?=[A-Z])", " "))])
    groups = F.filter(groups, lambda g: F.size(g) > 0)
    words = expanded_tokens(window)
    known = lambda t: F.exists(words, lambda w: (w == t) | ((F.length(w) >= 4) & (w.startswith(t) | t.startswith(w))))
    return ~has(claim, IDENTITY) | (F.size(groups) == 0) | F.exists(groups, lambda g: F.forall(g, known))


def select_windows(atoms: DataFrame, limit: int = WINDOW_LIMIT, min_score: float = MIN_SCORE) -> DataFrame:
    """The best sentence windows of each atom: window, lexical_score, rerank_score, rank.

    atoms: claim_id, atom_ord, atom and the columns of retrieve(). Scores are compared as rounded to four places, ties
    go to the earlier chunk, then window."""
    rows = atoms.withColumn("__w", windows(F.col("chunk"))).select("*", F.posexplode("__w").alias("window_ord", "window")).drop("__w")
    rows = rows.where(identity_holds(F.col("atom"), F.col("window")))
    lexical = likeness(expanded_tokens(F.col("atom")), expanded_tokens(F.col("window")))
    bonus = F.when(metric_support(F.col("atom"), F.col("window")), F.lit(METRIC_RERANK)).otherwise(F.lit(0.0)) + F.when(survey_support(F.col("atom"), F.col("window")), F.lit(SURVEY_RERANK)).otherwise(F.lit(0.0))
    rows = rows.withColumn("__lexical", lexical).withColumn("__bonus", bonus)
    rows = rows.where((F.col("__lexical") >= min_score) | (F.col("__bonus") > 0))
    conflict = F.when(has(F.col("window"), CONFLICT_CUE), F.lit(CONFLICT_RERANK)).otherwise(F.lit(0.0))
    rows = rows.withColumn("rerank_score", F.bround(F.col("__lexical") + conflict + F.col("__bonus"), 4)).withColumn("lexical_score", F.bround("__lexical", 4))
    order = Window.partitionBy("claim_id", "atom_ord").orderBy(F.desc(F.when(F.col("rerank_score") != 0, F.col("rerank_score")).otherwise(F.col("lexical_score"))), F.desc("lexical_score"), "chunk_rank", "window_ord")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("__lexical", "__bonus")
