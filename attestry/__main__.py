"""Command line: python -m attestry COMMAND ...; exit 0 if all is well, 2 with findings, 1 on errors."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="attestry")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str):
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        return p

    command("verify", "draft", "sources").add_argument("--out")
    command("verify-claim", "claim", "sources").add_argument("--cite", action="append", default=[])
    command("eval", "cases").add_argument("--method", default="full")
    command("verify-metadata", "bib", "--records", "--limit").add_argument("--provider", action="append", default=[])
    command("eval-suite", "manifest").add_argument("--method", default="full")
    command("eval-draft", "draft", "sources", "expected").add_argument("--bib")
    command("verify-bib", "tex", "bib")
    command("verify-paper", "tex", "bib", "sources", "--json").add_argument("--out")
    command("hallmark-predict", "rows", "records", "out")
    command("mutate-benchmark", "cases", "out")
    command("convert-external-benchmark", "records", "out").add_argument("--format", required=True)
    command("compare-benchmark", "cases")
    command("dashboard", "draft", "sources", "out")
    command("render", "draft", "sources", "out")
    command("methods")
    return out


def run(spark, a) -> bool:
    """Whether there are no findings."""
    from pyspark.sql import functions as F

    from .operators import bibliography as bib
    from .operators import evaluate as ev
    from .operators.boundary import cut
    from .operators.retrieval import build_chunks
    from .plans import suite
    from .plans.verify import verify
    from .sinks import report
    from .sources import providers, readers

    whole = lambda path: spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    supported = lambda df: df.where("label <> 'supported'").isEmpty()
    show = lambda df: [print(r["value"], end="\n\n") for r in df.toLocalIterator()]
    if a.command == "methods":
        for name, (what, needs) in suite.METHODS.items():
            print(f"{name}: {what}" + (f" Needs {', '.join(needs)}." if needs else ""))
        return True
    if a.command in ("verify", "dashboard", "render"):
        draft = whole(a.draft)
        results = cut(suite.verify_drafts(draft, readers.sources(spark, a.sources)), "results")
        if a.command == "dashboard":
            report.write_dashboard(results, a.out)
        elif a.command == "render":
            blocks = report.draft_blocks(draft)
            bound = bib.bind_blocks(results.select("claim_id", "claim", "citation_keys"), blocks)
            with open(a.out, "w", encoding="utf-8") as f:
                f.writelines(report.annotated_page(report.annotated(blocks, bound, results)))
        elif a.out:
            report.write_ledgers(results, a.out)
        else:
            show(report.ledger_markdown(results).select("value"))
        return supported(results)
    if a.command == "verify-metadata":
        entries = readers.bibtex_entries(whole(a.bib))
        if a.limit:
            entries = entries.orderBy("entry_ord").limit(int(a.limit))  # the command's own parameter
        if a.records:
            records = spark.read.schema(providers.SCHEMA).json(a.records)
        else:
            records = cut(providers.fetched_records(entries, a.provider or None), "records")
        checks = bib.verify_metadata(entries, records)
        show(checks.orderBy("key").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")))
        return checks.where("status NOT IN ('verified', 'skipped')").isEmpty()
    if a.command == "verify-claim":
        claim = spark.createDataFrame([(1, a.claim, a.cite)], "claim_id long, claim string, citation_keys array<string>")
        results = verify(claim, build_chunks(readers.sources(spark, a.sources)))
        show(report.ledger_markdown(results).select("value"))
        return supported(results)
    if a.command == "eval":
        results = ev.case_results(suite.predict(readers.eval_cases(spark, a.cases).drop("mutations"), a.method))
        print(report.summary_json(ev.summarize(results).first()))
        return results.where("NOT pass").isEmpty()
    if a.command == "eval-suite":
        parts = suite.run_suite(spark, a.manifest, a.method)
        for name in ("summaries", "failures", "gates"):
            parts[name].show(1000, False)
        return parts["gates"].where("NOT pass").isEmpty()
    if a.command == "eval-draft":
        entries = readers.bibtex_entries(whole(a.bib)) if a.bib else None
        results, summary = suite.run_draft_eval(whole(a.draft), readers.sources(spark, a.sources), readers.expected_claims(spark, a.expected), entries)
        print(report.summary_json(summary.first()))
        return results.where("NOT pass").isEmpty()
    if a.command == "verify-bib":
        found = bib.bibliography_report(bib.tex_keys(whole(a.tex)), readers.bibtex_entries(whole(a.bib)))
        print(report.bibliography_markdown(found).first()["value"])
        return found.where("errors > 0").isEmpty()
    if a.command == "verify-paper":
        parts = suite.verify_paper(whole(a.tex), whole(a.bib), readers.sources(spark, a.sources))
        parts["results"] = cut(parts["results"], "results")
        text = report.paper_markdown(parts["bibliography"], parts["results"], parts["mapping"]).orderBy("ord").select("value")
        text.write.mode("overwrite").text(a.out) if a.out else show(text)
        if a.json:
            report.paper_json(parts).select("value").write.mode("overwrite").text(a.json)
        return supported(parts["results"])
    if a.command == "hallmark-predict":
        entries = readers.hallmark_rows(spark, a.rows).select(F.col("bibtex_key").alias("key"), F.transform_keys("fields", lambda k, v: F.lower(k)).alias("fields"))
        records = spark.read.schema("key string, provider_ord int, record_ord int, provider string, record struct<title:string,year:string,authors:array<string>,doi:string>").json(a.records)
        bib.hallmark_labels(bib.verify_metadata(entries, records)).write.mode("overwrite").json(a.out)
        return True
    if a.command == "mutate-benchmark":
        ev.mutated(readers.eval_cases(spark, a.cases).where("mutations IS NOT NULL")).write.mode("overwrite").json(a.out)
        return True
    if a.command == "convert-external-benchmark":
        ev.converted(readers.external_records(spark, a.records), a.format).write.mode("overwrite").json(a.out)
        return True
    suite.compare_methods(readers.eval_cases(spark, a.cases).drop("mutations")).show(100, False)
    return True


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("attestry").getOrCreate()
    try:
        return 0 if run(spark, args) else 2
    except Exception as e:  # the command line's contract
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
