"""Evaluation: baselines, metrics by any grouping, gates, rankings, and the making of benchmark rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import coverage, expanded_tokens, strip

# fixed values: labels, thresholds, gate names and label synonyms
LABELS = ["supported", "partially_supported", "contradicted", "unsupported", "uncertain"]
GATES = {"max_false_supported_rate": "false_supported_rate", "min_accuracy": "accuracy", "max_manual_review_rate": "manual_review_rate", "min_supported_precision": "supported_precision", "min_contradiction_recall": "contradiction_recall", "min_unsupported_recall": "unsupported_recall"}
SYNONYMS = {
    "supported": ["support", "supports", "supported", "true", "yes", "entails", "entailment"],
    "contradicted": ["contradict", "contradicts", "contradicted", "refute", "refutes", "refuted", "false", "no", "contradiction"],
    "partially_supported": ["partial", "partially_supported", "partially supported", "mixed"],
    "unsupported": ["nei", "not_enough_info", "not enough info", "unsupported", "unknown", "neutral"],
}
METRICS = ["accuracy", "macro_f1", "false_supported_rate", "supported_precision", "supported_recall", "unsupported_recall", "contradiction_recall", "manual_review_rate"]


def lexical_label(covered: Column) -> Column:
    """The lexical baseline's label of a claim-side coverage."""
    return F.when(covered >= 0.68, "supported").when(covered >= 0.38, "partially_supported").otherwise("unsupported")


def lexical_baseline(pairs: DataFrame) -> DataFrame:
    covered = coverage(expanded_tokens(F.col("claim")), expanded_tokens(F.col("evidence")))
    return pairs.withColumns({"coverage": covered, "predicted": lexical_label(covered)})


def case_results(cases: DataFrame) -> DataFrame:
    """cases (expected_label, expected_failure_mode, predicted, predicted_mode) with false_supported and pass."""
    mode = F.col("expected_failure_mode").isNull() | F.col("expected_failure_mode").eqNullSafe(F.col("predicted_mode"))
    return cases.withColumns({"false_supported": (F.col("predicted") == "supported") & (F.col("expected_label") != "supported"), "pass": (F.col("predicted") == F.col("expected_label")) & mode})


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _metrics(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics from one count for each pair of labels, in columns <expected>__<predicted>."""
    n = lambda e, p: F.col(f"{e}__{p}")
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    total = add([n(e, p) for e in LABELS for p in LABELS])
    precision = {x: _ratio(n(x, x), add([n(e, x) for e in LABELS])) for x in LABELS}
    recall = {x: _ratio(n(x, x), add([n(x, p) for p in LABELS])) for x in LABELS}
    f1 = [_ratio(2 * precision[x] * recall[x], precision[x] + recall[x]) for x in LABELS]
    values = {
        "accuracy": _ratio(add([n(x, x) for x in LABELS]), total),
        "macro_f1": add(f1) / len(LABELS),
        "false_supported_rate": _ratio(add([n(e, "supported") for e in LABELS[1:]]), total),
        "supported_precision": precision["supported"],
        "supported_recall": recall["supported"],
        "unsupported_recall": recall["unsupported"],
        "contradiction_recall": recall["contradicted"],
        "manual_review_rate": _ratio(add([n(e, p) for e in LABELS for p in ("partially_supported", "uncertain")]), total),
    }
    grid = F.create_map(*[x for e in LABELS for x in (F.lit(e), F.create_map(*[y for p in LABELS for y in (F.lit(p), n(e, p))]))])
    return counted.select(*keys, total.alias("total"), *[F.bround(v, 4).alias(k) for k, v in values.items()], grid.alias("confusion"))


def _cells() -> list[Column]:
    return [F.count_if((F.col("expected_label") == e) & (F.col("predicted") == p)).alias(f"{e}__{p}") for e in LABELS for p in LABELS]


def summarize(results: DataFrame, *keys: str) -> DataFrame:
    """Metrics of each group; one pass of counts, so that groups pool their cases."""
    return _metrics(results.groupBy(*keys).agg(*_cells()), list(keys))


def summarize_levels(results: DataFrame, layer: str, dataset: str) -> DataFrame:
    """Metrics by data set, by layer and in all, as one pass of grouping sets; null stands for all."""
    grouped = results.groupingSets([[F.col(layer), F.col(dataset)], [F.col(layer)], []], F.col(layer), F.col(dataset)).agg(*_cells())
    return _metrics(grouped, [layer, dataset])


def confusion(results: DataFrame, *keys: str) -> DataFrame:
    return results.groupBy(*keys, "expected_label", "predicted").agg(F.count("*").alias("n"))


def gate_results(summary: DataFrame, gates: DataFrame, *keys: str) -> DataFrame:
    """summary rows against gates (keys, gate, threshold): actual and pass. An unknown gate is an error."""
    value = F.create_map(*[x for g, m in GATES.items() for x in (F.lit(g), F.col(m))])
    met = gates.join(summary, list(keys)) if keys else gates.crossJoin(summary)
    known = F.col("gate").isin(list(GATES))
    actual = F.when(known, F.try_element_at(value, F.col("gate"))).otherwise(F.raise_error(F.concat(F.lit("Unsupported eval-suite gate: "), "gate")).cast("double"))
    passed = F.when(F.col("gate").startswith("max_"), actual <= F.col("threshold")).otherwise(actual >= F.col("threshold"))
    return met.select(*keys, "gate", actual.alias("actual"), "threshold", passed.alias("pass"))


def redacted(results: DataFrame) -> DataFrame:
    """Failures by data set: how many, and which unless the data set is locked."""
    failed = F.filter(F.array_sort(F.collect_list(F.when(~F.col("pass"), F.col("id")))), lambda x: x.isNotNull())
    out = results.groupBy("dataset", "locked").agg(failed.alias("failures"))
    return out.select("dataset", "locked", F.size("failures").alias("failure_count"), F.when(F.col("locked"), F.array().cast("array<string>")).otherwise(F.col("failures")).alias("failures"))


def rank_methods(summary: DataFrame, *keys: str) -> DataFrame:
    """Methods by accuracy, then by fewer false supports, within the keys."""
    order = Window.partitionBy(*keys).orderBy(F.desc("accuracy"), "false_supported_rate", "method")
    return summary.withColumn("rank", F.row_number().over(order))


def match_expected(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected cases with the one verified claim that contains their text; none or several is an error.

    Other columns of results come along. Expected cases are a hand-made list, so the substring join takes them as the
    broadcast side where they are small; what Spark estimates as larger it pairs in blocks."""
    rest = [c for c in results.columns if c not in ("claim", "label", "failure_mode", *expected.columns)]
    one = lambda c, name: F.first(F.col(c), ignorenulls=True).alias(name)
    met = expected.join(results, F.col("claim").contains(F.col("claim_contains")), "left")
    found = met.groupBy(*[expected[c] for c in expected.columns]).agg(F.count("claim").alias("__n"), one("claim", "claim"), one("label", "predicted"), one("failure_mode", "predicted_mode"), *[one(c, c) for c in rest])
    ok = F.when(F.col("__n") == 1, F.col("claim")).otherwise(F.raise_error(F.concat(F.lit("expected claim matches "), F.col("__n").cast("string"), F.lit(" claims: "), "claim_contains")).cast("string"))
    return found.withColumn("claim", ok).drop("__n")


def mutated(cases: DataFrame) -> DataFrame:
    """A case for each declared mutation, with what it doesn't say taken from its parent."""
    rows = cases.select(F.col("id").alias("parent_id"), F.col("claim").alias("c"), F.col("evidence").alias("e"), F.explode("mutations").alias("m"))
    kind = F.coalesce(F.nullif("m.kind", F.lit("")), F.lit("mutation"))
    return rows.select(F.coalesce(F.nullif("m.id", F.lit("")), F.concat_ws("::", "parent_id", kind)).alias("id"), "parent_id", kind.alias("mutation_kind"), F.coalesce("m.claim", "c").alias("claim"), F.coalesce("m.evidence", "e").alias("evidence"), "m.expected_label", "m.expected_failure_mode")


def normal_label(raw: Column, supported: Column) -> Column:
    """An external label as one of ours: the flag first, then synonyms; another label is an error."""
    known = F.create_map(*[F.lit(x) for label, names in SYNONYMS.items() for n in names for x in (n, label)])
    key = F.translate(F.lower(strip(F.coalesce(raw, F.lit("")))), "-", "_")
    bad = F.raise_error(F.concat(F.lit("Unsupported external benchmark label: "), F.coalesce(raw, F.lit("")))).cast("string")
    return F.when(supported.isNotNull(), F.when(supported, "supported").otherwise("unsupported")).otherwise(F.coalesce(F.try_element_at(known, key), bad))


def converted(records: DataFrame, source_format: str) -> DataFrame:
    """External records (see external_records) as claim-support cases."""
    if source_format not in ("scifact", "scitance", "factscore"):
        raise ValueError(f"Unsupported external benchmark format: {source_format}")
    filled = lambda *names: F.coalesce(*[F.nullif(strip(F.col(n)), F.lit("")) for n in names])
    joined = lambda n: F.nullif(F.array_join(F.filter(F.transform(F.coalesce(F.col(n), F.array().cast("array<string>")), strip), lambda x: x != ""), " "), F.lit(""))
    fact = source_format == "factscore"
    claim = filled("atom", "claim", "statement") if fact else filled("claim", "citation", "citation_text", "statement", "text")
    evidence = F.coalesce(filled("evidence", "abstract", "sentence", "passage", "source", "snippet"), joined("evidence_sentences"), joined("sentences"), joined("passages"))
    name = F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in (("id", "atom_id") if fact else ("id", "claim_id", "uid"))], F.lit(f"{source_format}-case"))
    need = lambda x, what: F.coalesce(x, F.raise_error(F.lit(f"External benchmark record has no {what} text")).cast("string"))
    raw = F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in ("expected_label", "label", "evidence_label", "verdict")])
    return records.select(name.alias("id"), need(claim, "claim").alias("claim"), need(evidence, "evidence").alias("evidence"), normal_label(raw, F.col("is_supported")).alias("expected_label"), F.lit(source_format).alias("external_format"))
