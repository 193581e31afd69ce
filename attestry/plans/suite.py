"""Evaluation suites, draft evaluation, method comparison and papers."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bibliography as bib
from ..operators import chat
from ..operators import evaluate as ev
from ..operators.claims import parse_claims
from ..operators.judge import adjudicate_pairs, judge_pairs
from ..operators.retrieval import build_chunks
from ..sources import readers
from .verify import trace_totals, verify


#: What each method is, and what it needs besides the cases.
METHODS = {
    "full": ("Atoms, deterministic gates and the ladder of verdicts, with a model's opinion where one is given.", []),
    "heuristic": ("The pair judge alone, without atoms.", []),
    "lexical": ("Token overlap alone.", []),
    "nli": ("A model's opinion alone.", ["nli"]),
    "raw-llm": ("A chat model's answer alone.", ["send, or the endpoint's key"]),
}


def predict(cases: DataFrame, method: str = "full", nli=None, send=None) -> DataFrame:
    """cases (id, claim, evidence) with predicted, confidence and predicted_mode by one of METHODS.

    nli: see adjudicate_pairs; send: see chat.classified."""
    none = F.lit(None).cast("string").alias("predicted_mode")
    if method == "nli":
        if nli is None:
            raise ValueError("the nli method needs a model")
        return nli(cases).select(*cases.columns, F.col("nli.label").alias("predicted"), F.col("nli.confidence").alias("confidence"), none)
    if method == "raw-llm":
        return chat.classified(cases, send).select(*cases.columns, "predicted", "confidence", none)
    if method == "lexical":
        out = ev.lexical_baseline(cases)
        sure = F.when(F.col("predicted") == "unsupported", F.lit(0.35)).otherwise(F.col("coverage"))
        return out.withColumns({"confidence": sure, "predicted_mode": F.lit(None).cast("string")}).drop("coverage")
    if method == "heuristic":
        out = judge_pairs(cases)
        return out.select(*cases.columns, F.col("heuristic.label").alias("predicted"), F.col("heuristic.confidence").alias("confidence"), F.col("heuristic.mode").alias("predicted_mode"))
    if method != "full":
        raise ValueError(f"Unknown method: {method}")
    verdicts = adjudicate_pairs(cases.select("id", "claim", "evidence"), ["id"], nli)
    return cases.join(verdicts, "id").select(*cases.columns, F.col("verdict.label").alias("predicted"), F.col("verdict.confidence").alias("confidence"), F.col("verdict.mode").alias("predicted_mode"))


def suite_cases(spark: SparkSession, manifest_path: str) -> tuple[dict, DataFrame]:
    """The manifest and the cases of all its data sets, with dataset, layer and locked."""
    manifest = readers.suite_manifest(manifest_path)
    folder = os.path.dirname(os.path.abspath(manifest_path))
    parts = []
    for d in manifest["datasets"]:
        path = d["path"] if os.path.isabs(d["path"]) else os.path.join(folder, d["path"])
        cases = readers.eval_cases(spark, path).drop("mutations")
        parts.append(cases.withColumns({"dataset": F.lit(d["name"]), "layer": F.lit(d["layer"]), "locked": F.lit(bool(d["locked"])), "id": F.concat_ws("/", F.lit(d["name"]), "id")}))
    return manifest, reduce(DataFrame.unionByName, parts)


def run_suite(spark: SparkSession, manifest_path: str, method: str = "full") -> dict[str, DataFrame]:
    """results, summaries (by data set, layer and in all), failures and gates of a suite."""
    manifest, cases = suite_cases(spark, manifest_path)
    results = ev.case_results(predict(cases, method))
    levels = ev.summarize_levels(results, "layer", "dataset")
    layers = levels.where("layer IS NOT NULL AND dataset IS NULL").drop("dataset")
    known = {d["layer"] for d in manifest["datasets"]}
    if unknown := set(manifest["layer_gates"]) - known:
        raise ValueError(f"layer_gates names unknown layers: {sorted(unknown)}")
    rows = [(layer, g, float(x)) for layer, gates in manifest["layer_gates"].items() for g, x in gates.items()]
    gates = ev.gate_results(layers, spark.createDataFrame(rows, "layer string, gate string, threshold double"), "layer")
    total = [(g, float(x)) for g, x in manifest["gates"].items()]
    if total:
        whole = ev.gate_results(levels.where("layer IS NULL AND dataset IS NULL").drop("layer", "dataset"), spark.createDataFrame(total, "gate string, threshold double"))
        gates = gates.unionByName(whole.withColumn("layer", F.lit(None).cast("string")))
    return {"results": results, "summaries": levels, "failures": ev.redacted(results), "gates": gates}


def compare_methods(cases: DataFrame, methods: tuple[str, ...] = ("full", "heuristic", "lexical"), *keys: str, nli=None, send=None) -> DataFrame:
    """Metrics and rank of each method over the same cases."""
    parts = [ev.summarize(predict(cases, m, nli, send), *keys).drop("confusion").withColumn("method", F.lit(m)) for m in methods]
    return ev.rank_methods(reduce(DataFrame.unionByName, parts), *keys)


def verify_drafts(drafts: DataFrame, sources: DataFrame, nli=None) -> DataFrame:
    """Verdicts of all cited claims of drafts (draft_id, text) against sources."""
    claims = parse_claims(drafts).withColumn("claim_id", F.col("claim_ord"))
    if "draft_id" in drafts.columns:
        claims = claims.withColumn("claim_id", F.xxhash64("draft_id", "claim_ord"))
    return verify(claims.select("claim_id", "claim", "citation_keys"), build_chunks(sources), nli)


def run_draft_eval(drafts: DataFrame, sources: DataFrame, expected: DataFrame, entries: DataFrame | None = None, nli=None) -> tuple[DataFrame, DataFrame]:
    """(cases, summary) of a draft's verdicts against expected labels, matched by text; cases have the totals of the
    verdicts' traces.

    entries: a bibliography. With it, only sources that carry the title of one of its entries count, under that entry's
    key, so that a claim that cites anything else is uncertain."""
    if entries is not None:
        sources = bib.trusted_sources(bib.align_sources(sources, entries), entries)
    matched = ev.match_expected(trace_totals(verify_drafts(drafts, sources, nli)), expected)
    results = ev.case_results(matched)
    return results, ev.summarize(results)


def verify_paper(tex: DataFrame, bibtex: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """A paper's bibliography report and the verdicts of its claims against sources that its bibliography lists.

    Sources take the citation key of the entry whose title they cover; those without a titled entry don't count."""
    entries = readers.bibtex_entries(bibtex)
    report = bib.bibliography_report(bib.tex_keys(tex), entries)
    trusted = bib.trusted_sources(bib.align_sources(sources, entries), entries)
    mapping = sources.agg(F.count("*").alias("loaded")).crossJoin(trusted.agg(F.count_distinct("citation_key").alias("mapped")))  # a row each
    return {"bibliography": report, "results": verify_drafts(tex, trusted), "sources": trusted, "mapping": mapping}
