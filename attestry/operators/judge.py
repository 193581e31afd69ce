"""Judging pairs of claim and evidence, and what the judgments of atoms make of a claim."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import coverage, expanded_tokens, found, has
from ..rules import lenses
from ..rules.quantities import quantities
from .claims import atoms
from .support import claims_resource, semantic_support, survey_support

# fixed values: polarity cues, confidences and the order in which findings name a failure mode
POSITIVE_CLAIM = r"\b(outperform|outperforms|improve|improves|improved|increase|increases|reduce|reduces|reduced|higher|better|superior|span|spans|cover|covers)\b"
GENERIC_NEGATION = r"\b(no statistically significant|not significant|does not improve(?!\s+f1 score)|did not improve(?!\s+f1 score)|failed to improve(?!\s+f1 score)|does not reduce|did not reduce|failed to reduce|no reduction|does not cover|did not cover|does not span|did not span|comparable to|similar to|no improvement|worse than|lower than)\b"
METRIC_NEGATION = r"\b(?:does not improve|did not improve|failed to improve)\s+(f1(?:\s+score)?|accuracy)\b|\bno\s+(f1(?:\s+score)?|accuracy)(?:\s+score)?\s+improvement\b|\bno\s+improvement\s+in\s+(f1(?:\s+score)?|accuracy)\b"
METRIC = r"\b(f1(?:\s+score)?|accuracy)\b"
NEGATIVE_CLAIM = r"\b(no improvement|does not improve|not significant|worse than|lower than|comparable to)\b"
POSITIVE_EVIDENCE = r"\b(significantly improves|outperforms|improves|improved|higher than|better than|superior to)\b"
UNIVERSAL_CLAIM = r"\b(all|always|any|every|universally)\b"
SCOPED_EVIDENCE = r"\b(five|some|subset|simulated|sparse-reward|weaker|limited|only|strongest)\b"
ENTITY_WORDS = ["modality", "task", "split", "language", "optimizer", "supervision", "study design", "summarization style", "agent setting", "complexity", "inference fidelity", "trainability", "reward density", "evaluation domain", "data sensitivity", "data origin", "memory representation", "trainable scope", "architecture family", "pretraining objective", "evaluation setting", "decoding strategy", "auroc averaging", "confidence interval", "f1 averaging", "summary statistic", "uncertainty statistic", "pairedness", "tail count", "test family", "adjustment status", "population group", "trial design", "benchmark version", "mapping"]
MODES = [
    (["year conflict"], "year_conflict"),
    (["numeric conflict", "numeric bound conflict", "p-value conflict", "ratio effect conflict", "exact effect value conflict", "endpoint window conflict", "metric value conflict", "training configuration value conflict"], "numeric_conflict"),
    (["unit conflict"], "unit_conflict"),
    (["comparison direction conflict"], "comparison_direction_conflict"),
    (["exclusivity conflict", "scope tension"], "scope_overstatement"),
    (["significance conflict", "state-of-the-art conflict", "requirement conflict", "descriptor conflict", "outcome status conflict", "lower-is-better outcome conflict", "release conflict"], "negation_conflict"),
    (["protocol conflict"], "entity_conflict"),
    (["measurement target tension"], "scope_overstatement"),
    (["negation conflict", "direction conflict", "contrast exclusion conflict", "overhead conflict", "component exclusion conflict"], "negation_conflict"),
    (["entity conflict", "role conflict"], "entity_conflict"),
    (["availability conflict"], "negation_conflict"),
    ([f"{w} conflict" for w in ENTITY_WORDS], "entity_conflict"),
]
REVIEW = {
    "source_not_resolved": "load cited source or fix citation key", "weak_retrieval": "find stronger evidence or remove citation",
    "no_rationale_span": "find exact supporting span or narrow the claim", "missing_atom_support": "rewrite unsupported atom or add a better citation",
    "numeric_conflict": "fix the numeric value or cite a matching source", "year_conflict": "fix the year or cite a matching source",
    "unit_conflict": "fix the unit or cite a matching source", "entity_conflict": "fix the entity or cite a matching source",
    "negation_conflict": "fix the result polarity or cite a matching source", "comparison_direction_conflict": "fix the comparison direction or cite a matching source",
    "hedged_evidence": "hedge the claim or cite stronger evidence", "scope_overstatement": "narrow the claim scope",
    "source_silence": "cite a source that states the claim or revise the claim", "model_disagreement": "manually inspect model disagreement",
}
PRIORITY = {"contradicted": 4, "supported": 3, "partially_supported": 2, "uncertain": 1, "unsupported": 0}

S, P, C, U, Q = "supported", "partially_supported", "contradicted", "unsupported", "uncertain"


def judgment(label: Column | str, confidence, reason, mode=None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(label).alias("label"), as_col(confidence).cast("double").alias("confidence"), as_col(reason).alias("reason"), as_col(mode).cast("string").alias("mode"))


def polarity_conflict(c: Column, e: Column) -> Column:
    name = lambda m: F.when(F.lower(m).startswith("f1"), "f1").otherwise(F.lower(m))
    said = F.transform(found(c, METRIC, 1), name)
    denied = F.transform(found(e, METRIC_NEGATION), lambda m: name(F.regexp_extract(m, "(?iU)" + METRIC, 1)))
    metric = (F.size(said) == 0) | F.arrays_overlap(said, denied)
    up = has(c, POSITIVE_CLAIM)
    rest = (up & has(e, GENERIC_NEGATION)) | (has(c, NEGATIVE_CLAIM) & has(e, POSITIVE_EVIDENCE))
    return F.when(up & (F.size(denied) > 0), metric).otherwise(rest)


def number_conflict(c: Column, e: Column) -> Column:
    a, b = quantities(c), quantities(e)
    x, y = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    one = (F.size(a) == 1) & (F.size(b) == 1)
    return F.when(one, (x["unit"] == y["unit"]) & (x["number"] != y["number"]) & ~lenses.compatible(c, e, x, y)).otherwise(F.lit(False))


def hedge_only(findings: Column) -> Column:
    return (F.size(findings) > 0) & F.forall(findings, lambda f: F.lower(f).rlike("hedged|inconclusive"))


def judge_pairs(pairs: DataFrame, claim: str = "claim", evidence: str = "evidence") -> DataFrame:
    """pairs with fact_label, findings and heuristic, a struct of label, confidence, reason and mode."""
    return _judging(claim, evidence, lenses.session_key()).on(pairs)


@lru_cache(8)
def _judging(claim: str, evidence: str, session: str) -> lenses.Recipe:
    c, e = F.col(claim), F.col(evidence)
    out = lenses.Recipe().withColumn("__ov", coverage(expanded_tokens(c), expanded_tokens(e)))
    out = out.withColumns({"__survey": survey_support(c, e), "__semantic": semantic_support(c, e, F.col("__ov")), "__resource": claims_resource(c), "__polarity": polarity_conflict(c, e), "__number": number_conflict(c, e), "__gap": has(c, UNIVERSAL_CLAIM) & has(e, SCOPED_EVIDENCE)})
    out = out.withColumn("__semantic", F.col("__semantic") | F.col("__survey"))
    out = lenses.inspect(out, claim, evidence)
    ov, said = F.col("__ov"), F.array_join("findings", "; ")
    partial = F.least(F.lit(0.78), 0.42 + ov / 2)
    ladder = (
        F.when((ov < 0.18) & ~F.col("__semantic"), judgment(U, 0.25, "Evidence has too little claim overlap."))
        .when(F.col("fact_label") == C, judgment(C, 0.82, said))
        .when((ov >= 0.45) & F.col("__number"), judgment(C, 0.82, "Claim and evidence share context but contain conflicting numeric values."))
        .when(F.col("__polarity"), judgment(C, 0.78, "Evidence uses an incompatible polarity for the claimed result."))
        .when((F.col("fact_label") == P) & ~(F.col("__survey") & hedge_only(F.col("findings"))), judgment(P, 0.68, said))
        .when((ov >= 0.38) & F.col("__gap"), judgment(P, 0.68, "Evidence supports a narrower claim than the draft states."))
        .when((ov >= 0.68) & ~F.col("__resource"), judgment(S, F.least(F.lit(0.95), 0.55 + ov / 2), "Strong lexical support."))
        .when(F.col("__semantic"), judgment(S, 0.74, "Anchored paraphrase support."))
        .when((ov >= 0.38) & F.col("__resource"), judgment(P, partial, "Evidence mentions the resource dimension but not the claimed reduction."))
        .when(ov >= 0.38, judgment(P, partial, "Evidence covers part of the claim but not all content."))
        .otherwise(judgment(U, 0.35, "Evidence is related but does not support the claim."))
    )
    return out.withColumns({"heuristic": ladder, "overlap": ov}).drop("__ov", "__semantic", "__resource", "__polarity", "__number", "__gap")


def failure_mode(findings: Column) -> Column:
    """The first rule of MODES that any finding meets."""
    text = F.lower(F.array_join(findings, " "))
    out = None
    for cues, mode in MODES:
        hit = reduce(lambda a, b: a | b, [text.contains(x) for x in cues])
        out = F.when(hit, mode) if out is None else out.when(hit, mode)
    return out.otherwise("conflicting_sources")


def _filled(j: Column, mode: Column) -> Column:
    """The judgment with a mode, if it has none and isn't supported."""
    return judgment(j["label"], j["confidence"], j["reason"], F.when(j["label"] == S, j["mode"]).otherwise(F.coalesce(j["mode"], mode)))


def adjudicate(judged: DataFrame, nli: str | None = None) -> DataFrame:
    """judge_pairs() output with verdict: facts before the heuristic before a model's opinion.

    nli: a column of structs like heuristic, from any model; null where it has no opinion."""
    h = F.col("heuristic")
    cleared = (F.col("fact_label") == P) & hedge_only(F.col("findings")) & F.col("__survey")
    fact = F.when(~F.coalesce(cleared, F.lit(False)), F.col("fact_label"))
    said = F.array_join("findings", "; ")
    hedge = F.exists("findings", lambda f: F.lower(f).rlike("hedged|inconclusive"))
    own = F.when(h["label"] == C, F.when(F.lower(h["reason"]).contains("polarity"), "negation_conflict").otherwise("conflicting_sources")).when(h["label"] == P, "scope_overstatement").otherwise("source_silence")
    ladder = F.when(fact == C, judgment(C, 0.9, said, failure_mode(F.col("findings")))).when((fact == P) & (h["label"] != U), judgment(P, 0.72, said, F.when(hedge, "hedged_evidence").otherwise("scope_overstatement")))
    if nli:
        n = F.col(nli)
        ladder = ladder.when((n["label"] == C) & (h["label"] == U), judgment(Q, F.least(n["confidence"], F.lit(0.65)), "NLI predicts contradiction, but retrieved evidence has weak claim overlap.", "model_disagreement"))
        ladder = ladder.when(n["label"] == C, _filled(n, F.lit("model_disagreement")))
        ladder = ladder.when((h["label"] == S) & (n["label"] == S), judgment(S, F.least(h["confidence"], n["confidence"]), "Verifier gates agree."))
        ladder = ladder.when((h["label"] == S) & n.isNotNull(), judgment(P, 0.68, "NLI did not confirm full support.", "model_disagreement"))
    ladder = ladder.when(h["label"] == S, judgment(S, h["confidence"], "Verifier gates agree.")).otherwise(_filled(h, own))
    return judged.withColumn("verdict", ladder).drop("__survey")


def combined(judgments: Column) -> Column:
    """What an ordered array of atom judgments makes of the claim; ties of confidence go to the earlier atom."""
    some = lambda *labels: F.exists(judgments, lambda j: j["label"].isin(*labels))

    def strongest(label):
        own = F.filter(judgments, lambda j: j["label"] == label)
        best = F.array_max(F.transform(own, lambda j: j["confidence"]))
        return F.get(F.filter(own, lambda j: j["confidence"] == best), F.lit(0))

    silent = strongest(U)
    rewritten = judgment(U, silent["confidence"], "No atomic subclaim is supported.", "no_rationale_span")
    return (
        F.when(F.size(judgments) == 0, judgment(Q, 0.2, "No atomic claims were produced.", "no_rationale_span"))
        .when(some(C) & some(S, P), judgment(P, 0.66, "Some atomic subclaims are supported, but at least one is contradicted.", "missing_atom_support"))
        .when(some(C), _filled(strongest(C), F.lit("conflicting_sources")))
        .when(F.forall(judgments, lambda j: j["label"] == S), judgment(S, F.array_min(F.transform(judgments, lambda j: j["confidence"])), "All atomic subclaims are supported."))
        .when(some(S, P) & some(U, Q), judgment(P, 0.66, "Only some atomic subclaims are supported by the retrieved evidence.", "missing_atom_support"))
        .when(some(P), _filled(strongest(P), F.lit("scope_overstatement")))
        .when(some(Q), _filled(strongest(Q), F.lit("source_silence")))
        .when(silent["mode"] == "no_rationale_span", rewritten)
        .otherwise(_filled(silent, F.lit("source_silence")))
    )


def adjudicate_pairs(pairs: DataFrame, key: list[str], nli=None) -> DataFrame:
    """(key, verdict) of pairs (key, claim, evidence): each claim's atoms are judged against its evidence and combined.

    nli: a function of a frame with claim and evidence that returns it with a column nli, or none."""
    rows = pairs.select(*key, "evidence", F.posexplode(atoms(F.col("claim"))).alias("__ord", "__atom"), "claim")
    rows = rows.withColumn("__many", F.size(atoms(F.col("claim"))) > 1).withColumn("claim", F.when(F.col("__many"), F.col("__atom")).otherwise(F.col("claim")))
    if nli:
        rows = nli(rows)
    judged = adjudicate(judge_pairs(rows), "nli" if nli else None)
    grouped = judged.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__ord", "verdict"))).alias("__v"))
    atomic = F.transform("__v", lambda x: x["verdict"])
    one = F.get(atomic, F.lit(0))
    return grouped.select(*key, F.when(F.size("__v") == 1, one).otherwise(combined(atomic)).alias("verdict"))


def review_action(mode: Column) -> Column:
    said = F.create_map(*[F.lit(x) for kv in REVIEW.items() for x in kv])
    return F.when(mode.isNull(), "none").otherwise(F.coalesce(F.try_element_at(said, mode), F.lit("manually inspect cited evidence")))
