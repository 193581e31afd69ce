"""From claims and sources to verdicts with their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.boundary import cut
from ..operators.claims import atoms
from ..operators.judge import PRIORITY, adjudicate_pairs, combined, judgment, review_action
from ..operators.retrieval import retrieve, select_windows, unresolved


def relation(label: Column) -> Column:
    return F.when(label == "supported", "support").when(label == "contradicted", "contradict").when(label == "unsupported", "neutral").otherwise("undetermined")


def verify(claims: DataFrame, chunks: DataFrame, nli=None) -> DataFrame:
    """A verdict with its trace for each claim (claim_id, claim, citation_keys) against chunks (see build_chunks).

    A claim with a key that no chunk has is uncertain, one that retrieves nothing is unsupported; else its atoms are
    judged against their best windows, the weightiest verdict of an atom counts, and the atoms' verdicts are combined.
    Retrieved chunks, windows and verdicts are each written to the shared folder: the rules make a wide plan, which is so
    planned once, and a lost executor costs one of the three steps."""
    gate = unresolved(claims, chunks).withColumn("missing", F.lit(True))
    kept = cut(retrieve(claims.join(gate, "claim_id", "left_anti"), chunks), "retrieved")
    rows = kept.withColumn("__atoms", atoms(F.col("claim"))).select("*", F.posexplode("__atoms").alias("atom_ord", "atom")).drop("__atoms")
    windows = select_windows(rows).select("claim_id", "atom_ord", "atom", "rank", "window", "lexical_score", "source_id", "citation_key", "page")
    windows = cut(windows, "windows")
    key = ["claim_id", "atom_ord", "rank"]
    judged = adjudicate_pairs(windows.select(*key, F.col("atom").alias("claim"), F.col("window").alias("evidence")), key, nli)
    judged = windows.join(cut(judged, "verdicts"), key)
    weight = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    label = F.col("verdict")["label"]
    rationale = F.struct("rank", "source_id", "citation_key", "page", F.col("window").alias("text"), relation(label).alias("relation"), F.col("lexical_score").alias("score"))
    hits = lambda r: F.count_if(relation(label) == r)
    best = lambda r: F.min(F.when(relation(label) == r, F.col("rank")))
    per_atom = judged.groupBy("claim_id", "atom_ord").agg(
        F.max_by("verdict", F.struct(weight[label], F.col("verdict")["confidence"], -F.col("rank"))).alias("verdict"),
        F.array_sort(F.collect_list(rationale)).alias("rationales"), F.count("*").alias("candidates"),
        hits("support").alias("support_candidates"), hits("contradict").alias("contradiction_candidates"),
        best("support").alias("best_support_rank"), best("contradict").alias("best_contradiction_rank"),
    )
    every = kept.select("claim_id", "claim").distinct().withColumn("__atoms", atoms(F.col("claim"))).select("claim_id", F.posexplode("__atoms").alias("atom_ord", "atom"))
    per_atom = every.join(per_atom, ["claim_id", "atom_ord"], "left")
    nothing = judgment("unsupported", 0.3, "No rationale span was selected for this atom.", "no_rationale_span")
    v = F.coalesce("verdict", nothing)
    rounded = F.struct(v["label"].alias("label"), F.bround(v["confidence"], 3).alias("confidence"), v["reason"].alias("reason"), v["mode"].alias("mode"))
    atom = F.struct("atom_ord", "atom", rounded.alias("verdict"), "rationales", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("support_candidates", F.lit(0)).alias("support_candidates"), F.coalesce("contradiction_candidates", F.lit(0)).alias("contradiction_candidates"), "best_support_rank", "best_contradiction_rank")
    per_claim = per_atom.groupBy("claim_id").agg(F.array_sort(F.collect_list(atom)).alias("atoms"))
    out = claims.join(gate, "claim_id", "left").join(per_claim, "claim_id", "left")
    final = F.when(F.col("missing"), judgment("uncertain", 0.2, "At least one cited source key is missing from the loaded source set.", "source_not_resolved"))
    final = final.when(F.col("atoms").isNull(), judgment("unsupported", 0.3, "No overlapping evidence was retrieved from the cited source.", "weak_retrieval"))
    out = out.withColumn("final", final.otherwise(combined(F.transform("atoms", lambda a: a["verdict"]))))
    return out.select(
        "claim_id", "claim", "citation_keys", F.col("final.label").alias("label"), F.bround("final.confidence", 3).alias("confidence"),
        F.col("final.reason").alias("reason"), F.col("final.mode").alias("failure_mode"), F.when(F.col("missing"), "source_not_resolved").otherwise("passed").alias("source_gate"),
        review_action(F.col("final.mode")).alias("review_action"), "atoms",
    )


TOTALS = ["candidate_count", "support_candidate_count", "contradiction_candidate_count", "best_support_rank", "best_contradiction_rank"]


def trace_totals(results: DataFrame) -> DataFrame:
    """verify() output with the counts of its atoms added up and their best ranks."""
    total = lambda name: F.coalesce(F.aggregate(F.transform("atoms", lambda a: a[name].cast("long")), F.lit(0).cast("long"), lambda x, y: x + y), F.lit(0).cast("long"))
    best = lambda name: F.array_min(F.transform("atoms", lambda a: a[name]))
    values = [total("candidates"), total("support_candidates"), total("contradiction_candidates"), best("best_support_rank"), best("best_contradiction_rank")]
    return results.withColumns(dict(zip(TOTALS, values, strict=True)))
