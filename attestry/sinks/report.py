"""JSON and Markdown ledgers, bibliography and paper reports, a dashboard page and annotated drafts.

Text is made by Columns, one row for each claim; files are written by Spark. Pages for people are small summaries that
are rendered from the rows they show."""

from __future__ import annotations

import html as escape
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.boundary import cut


def ledger_json(results: DataFrame) -> DataFrame:
    """A JSON object for each claim, null fields kept."""
    return results.select("claim_id", F.to_json(F.struct(*sorted(results.columns)), {"ignoreNullFields": "false"}).alias("value"))


def claim_markdown(row_number: Column) -> Column:
    """A claim's section: label, claim, confidence, citations, reason, failure mode, atoms and their evidence."""
    fact = lambda name, value: F.concat(F.lit(f"- {name}: "), value)
    rationale = lambda r: F.format_string("    - [%s] %s (%s, %.4f)", r["source_id"], r["text"], r["relation"], r["score"])
    atom = lambda a: F.array_join(F.concat(F.array(F.format_string("  - %s: %s", a["verdict"]["label"], a["atom"])), F.transform(F.coalesce(a["rationales"], F.array()), rationale)), "\n")
    lines = F.array(
        F.concat(F.lit("## "), row_number.cast("string"), F.lit(". "), F.upper("label")),
        F.lit(""),
        fact("Claim", F.col("claim")),
        fact("Confidence", F.format_string("%.3f", "confidence")),
        fact("Citations", F.when(F.size("citation_keys") > 0, F.array_join("citation_keys", ", ")).otherwise("none")),
        fact("Reason", F.col("reason")),
        fact("Failure mode", F.coalesce("failure_mode", F.lit("none"))),
        fact("Review", F.col("review_action")),
    )
    return F.array_join(F.concat(lines, F.transform(F.coalesce("atoms", F.array()), atom)), "\n")


def ledger_markdown(results: DataFrame) -> DataFrame:
    """A Markdown section for each claim, in the order of claim_id."""
    return numbered(results, "claim_id", "__n").select("claim_id", claim_markdown(F.col("__n")).alias("value")).orderBy("claim_id")


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows with their number in the order of a column: sorted by ranges, counted within a range, and the ranges' counts
    added up, which are one row for each partition."""
    from pyspark.sql import Window

    placed = cut(rows.orderBy(by).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("__range", F.shiftright("__at", 33))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__range", before.alias("__before"))
    out = placed.join(F.broadcast(sizes), "__range").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1)
    return out.drop("__at", "__range", "__before")


def write_ledgers(results: DataFrame, path: str) -> None:
    ledger_json(results).orderBy("claim_id").select("value").write.mode("overwrite").text(f"{path}/ledger.json")
    ledger_markdown(results).select("value").write.mode("overwrite").text(f"{path}/ledger.md")


def label_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("label").agg(F.count("*").alias("n"))


def bibliography_markdown(report: DataFrame) -> DataFrame:
    """The bibliography report's counts and sections as one text."""
    section = lambda title, items: F.concat(F.lit(f"\n\n## {title}\n\n"), F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- `"), x, F.lit("`"))), "\n")).otherwise("None."))
    parts = F.transform(F.map_entries(F.coalesce("incomplete", F.create_map().cast("map<string,array<string>>"))), lambda x: F.concat(x["key"], F.lit(": "), F.array_join(x["value"], ", ")))
    head = F.format_string("# Bibliography\n\n- Citations: %d\n- Cited keys: %d\n- Entries: %d\n- Errors: %d\n- Warnings: %d", "occurrences", "cited", "entries", "errors", "warnings")
    return report.select(F.concat(head, section("Missing", F.col("missing")), section("Unused", F.col("unused")), section("Incomplete", parts)).alias("value"))


def bibliography_json(report: DataFrame) -> DataFrame:
    """The bibliography report as a JSON object, null fields kept."""
    return report.select(F.to_json(F.struct(*sorted(report.columns)), {"ignoreNullFields": "false"}).alias("value"))


def paper_json(parts: dict[str, DataFrame]) -> DataFrame:
    """A paper's report (see verify_paper) as JSON lines: the mapping, the bibliography, the label counts, each claim."""
    whole = lambda df: F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    named = lambda df, part, at: df.select(F.lit(part).alias("part"), at.cast("long").alias("ord"), whole(df).alias("value"))
    counts = label_counts(parts["results"])
    out = named(parts["mapping"], "mapping", F.lit(0)).unionByName(named(parts["bibliography"], "bibliography", F.lit(0)))
    return out.unionByName(named(counts, "labels", F.lit(0))).unionByName(named(parts["results"], "claim", F.col("claim_id")))


def paper_markdown(report: DataFrame, results: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """A paper's source mapping, bibliography section, label histogram and claims as rows of text in order."""
    counts = label_counts(results).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("- %s: %d", "label", "n"))), "\n").alias("v")).select(F.lit(1).alias("ord"), F.concat(F.lit("# Labels\n\n"), "v").alias("value"))
    claims = ledger_markdown(results).select((F.col("claim_id") + 2).alias("ord"), "value")
    out = bibliography_markdown(report).select(F.lit(0).alias("ord"), "value").unionByName(counts).unionByName(claims)
    if mapping is None:
        return out
    said = F.format_string("# Sources\n\n- Loaded: %d\n- Mapped to bibliography keys: %d", "loaded", "mapped")
    return mapping.select(F.lit(-1).alias("ord"), said.alias("value")).unionByName(out)


def dashboard_parts(results: DataFrame, title: str = "Verdicts"):
    """The pieces of a self-contained page: counts by label, a filter, and every claim with its evidence.

    Claims come one partition at a time, so the driver never holds them all."""
    name = escape.escape(title)
    counts = sorted((r["label"], r["n"]) for r in label_counts(results).collect())
    bars = "".join(f"<button data-l='{escape.escape(k)}'>{escape.escape(k)}: {n}</button>" for k, n in counts)
    yield f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{name}</title><style>body{{font-family:sans-serif;max-width:60em;margin:auto}}li{{margin:.6em 0}}small{{color:#555}}</style></head>"
    yield f"<body><h1>{name}</h1><p><button data-l=''>all: {sum(n for _, n in counts)}</button>{bars}</p><ol id='c'></ol><script id='d' type='application/json'>["
    comma = ""
    for r in ledger_json(results).orderBy("claim_id").toLocalIterator():
        yield comma + r["value"].replace("</", "<\\/")
        comma = ","
    yield "]</script><script>"
    yield "const D=JSON.parse(document.getElementById('d').textContent),C=document.getElementById('c');"
    yield "function show(l){C.replaceChildren();for(const r of D){if(l&&r.label!==l)continue;const e=document.createElement('li'),s=document.createElement('small');"
    yield "e.textContent=r.label+': '+r.claim;const n=(r.atoms||[]).flatMap(a=>a.rationales||[]).map(x=>'['+x.source_id+'] '+x.text);"
    yield "s.textContent=[r.reason,...n].filter(Boolean).join(' | ');e.append(document.createElement('br'),s);C.append(e)}}"
    yield "for(const b of document.querySelectorAll('button'))b.onclick=()=>show(b.dataset.l);show('');</script></body></html>"


def dashboard(results: DataFrame, title: str = "Verdicts") -> str:
    """The page as one text; write_dashboard() doesn't hold it whole."""
    return "".join(dashboard_parts(results, title))


def write_dashboard(results: DataFrame, path: str, title: str = "Verdicts") -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(dashboard_parts(results, title))


def draft_blocks(drafts: DataFrame, text: str = "text") -> DataFrame:
    """A draft's paragraphs and headings in order: block_ord, heading, text."""
    keep = [c for c in drafts.columns if c != text]
    parts = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n\s*\n"), lambda x: F.trim(x) != "")
    out = drafts.select(*keep, F.posexplode(parts).alias("block_ord", "text"))
    return out.withColumn("heading", F.col("text").rlike(r"^\s*(?:#|\\(?:sub)*section)"))


def annotated(blocks: DataFrame, bound: DataFrame, results: DataFrame) -> DataFrame:
    """Blocks with the verdicts bound to them (see bind_blocks) as badges behind their text."""
    marks = bound.join(results.select("claim_id", "label"), "claim_id").groupBy("block_ord").agg(F.array_sort(F.collect_list(F.struct("claim_id", "label"))).alias("m"))
    badges = F.array_join(F.transform("m", lambda x: F.concat(F.lit("["), x["label"], F.lit("]"))), " ")
    return blocks.join(marks, "block_ord", "left").select("block_ord", "heading", "text", F.concat_ws(" ", "text", F.when(F.size("m") > 0, badges)).alias("annotated"))


def annotated_page(rows: DataFrame, title: str = "Draft"):
    """The pieces of a page that shows annotated() blocks in order, headings as such, verdicts as marks behind the text."""
    yield f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape.escape(title)}</title><style>mark{{font-size:80%;margin-left:.4em}}</style></head><body>"
    for r in rows.orderBy("block_ord").toLocalIterator():
        kind = "h2" if r["heading"] else "p"
        marks = (r["annotated"] or "")[len(r["text"] or "") :].strip()
        badges = "".join(f"<mark>{escape.escape(m.strip('[]'))}</mark>" for m in marks.split())
        yield f"<{kind}>{escape.escape(r['text'] or '')}{badges}</{kind}>"
    yield "</body></html>"


def summary_json(row) -> str:
    """One summary row as JSON, keys sorted."""
    return json.dumps(row.asDict(recursive=True), indent=2, sort_keys=True)
