"""Readers of drafts, sources, bibliographies, evaluation cases and manifests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze, strip

# fixed values: BibTeX syntax
ENTRY_START = r"@([A-Za-z]+)\s*\{\s*([^,\s]+)\s*,"
FIELD = r"([A-Za-z][\w-]*)\s*="


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def whole_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, text) of the files below path whose name ends as the pattern says, white space stripped, empty ones out."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("text")).where("text <> ''")


def text_sources(spark: SparkSession, path: str) -> DataFrame:
    """Sources of .txt and .md files: source_id, citation_key and title are the file's stem."""
    df = whole_texts(spark, path, "*.{txt,TXT,md,MD}")
    name = stem(F.col("path"))
    return df.select(name.alias("source_id"), name.alias("citation_key"), name.alias("title"), "text", "path")


def jsonl_sources(spark: SparkSession, path: str) -> DataFrame:
    """Sources of .jsonl files, a line each. A line without text is an error; ids fall back as described in the code."""
    schema = "text string, source_id string, citation_key string, title string"
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jsonl,JSONL}").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    lines = lines.withColumn("n", F.row_number().over(_by_place())).where(strip(F.col("value")) != "")
    row = F.from_json("value", schema)
    given = lambda name: F.nullif(row[name], F.lit(""))
    text = strip(F.coalesce(row["text"], F.lit("")))
    text = F.when(text == "", F.raise_error(F.concat(F.lit("Missing text in "), "path", F.lit(":"), F.col("n").cast("string"))).cast("string")).otherwise(text)
    source = F.coalesce(given("source_id"), given("citation_key"), F.concat_ws("-", stem(F.col("path")), F.col("n")))
    return lines.select(source.alias("source_id"), F.coalesce(given("citation_key"), source).alias("citation_key"), row["title"].alias("title"), text.alias("text"), "path")


def _by_place():
    from pyspark.sql import Window

    return Window.partitionBy("path").orderBy(F.monotonically_increasing_id())


def pdf_sources(spark: SparkSession, path: str) -> DataFrame:
    """Sources of .pdf files with pages, where pypdf is installed; a page's number counts pages that aren't blank."""
    import io

    import pyarrow as pa
    from pypdf import PdfReader

    def run(batches):
        for batch in batches:
            pages = [[t for t in ((p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(x)).pages) if t] for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(pages, pa.list_(pa.string()))], ["path", "pages"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{pdf,PDF}").load(path)
    read = files.select("path", "content").mapInArrow(run, "path string, pages array<string>").where(F.size("pages") > 0)
    name = stem(F.col("path"))
    return read.select(name.alias("source_id"), name.alias("citation_key"), name.alias("title"), F.array_join("pages", "\n\n").alias("text"), "path", "pages")


def sources(spark: SparkSession, path: str) -> DataFrame:
    """All text, JSONL and PDF sources below a folder, by path; an empty result is an error.

    PDF files need pypdf: without it, a folder that has some is an error too."""
    out = text_sources(spark, path).unionByName(jsonl_sources(spark, path)).withColumn("pages", F.lit(None).cast("array<string>"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{pdf,PDF}").load(path)
    if not files.select("path").isEmpty():
        out = out.unionByName(pdf_sources(spark, path))
    out = out.orderBy("path", "source_id")
    if out.isEmpty():
        raise ValueError(f"no sources in {path}")
    return out


def _ddl(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def _split_entries(batches):
    """The entries of each text; an entry ends where its braces balance, which no regular expression can tell."""
    import re

    import pyarrow as pa

    start, kind = re.compile(ENTRY_START), pa.list_(pa.struct([("kind", pa.string()), ("key", pa.string()), ("body", pa.string())]))
    brace = re.compile(r"[{}]")
    for batch in batches:
        found = []
        for text in batch.column("__text").to_pylist():
            own, at = [], 0
            while text and (m := start.search(text, at)):
                depth = 1
                for b in brace.finditer(text, m.end()):
                    depth += 1 if b[0] == "{" else -1
                    if not depth:
                        break
                if depth:
                    raise ValueError(f"Unclosed BibTeX entry: {m[2]}")
                own.append({"kind": m[1], "key": m[2], "body": text[m.end() : b.start()]})
                at = b.end()
            found.append(own)
        rest = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(found, kind)], [*rest, "__entries"])


def bibtex_entries(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts (with key columns) exploded to entries: key, entry_type, fields, entry_ord; of equal keys the last counts.

    An entry that isn't closed is an error. As in the data model, "name =" inside a value begins a field."""
    from pyspark.sql import Window

    keep = [c for c in texts.columns if c != text]
    parts = texts.select(*keep, F.col(text).alias("__text")).mapInArrow(_split_entries, _ddl(texts, keep) + "__entries array<struct<kind:string,key:string,body:string>>")
    rows = parts.select(*keep, F.posexplode("__entries").alias("entry_ord", "__e"))
    rows = rows.select(*keep, "entry_ord", F.col("__e.key").alias("key"), F.lower("__e.kind").alias("entry_type"), F.col("__e.body").alias("__body"))
    names = F.transform(F.regexp_extract_all("__body", F.lit(FIELD), F.lit(1)), F.lower)
    values = F.transform(F.slice(F.split("__body", FIELD), 2, 1 << 30), clean_value)
    rows = rows.withColumn("__f", F.arrays_zip(names.alias("name"), values.alias("value")))
    last = F.filter("__f", lambda f, i: ~F.exists(F.slice("__f", i + 2, F.size("__f") + 1), lambda g: g["name"] == f["name"]))
    rows = rows.select(*keep, "entry_ord", "key", "entry_type", F.map_from_entries(last).alias("fields"))
    order = Window.partitionBy(*keep, "key").orderBy(F.desc("entry_ord"))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def clean_value(raw: Column) -> Column:
    v = strip(F.rtrim(F.regexp_replace(raw, r"[ \n\t,]+$", "")))
    inner = F.substring(v, F.lit(2), F.length(v) - 2)
    framed = (v.startswith("{") & v.endswith("}")) | (v.startswith('"') & v.endswith('"'))
    return squeeze(F.when(framed & (F.length(v) > 1), inner).otherwise(v))


CASE_SCHEMA = "id string, claim string, evidence string, expected_label string, expected_failure_mode string, source_title string, source_domain string, source_url string, parent_id string, mutation_kind string"
MUTATIONS = "mutations array<struct<kind:string,id:string,claim:string,evidence:string,expected_label:string,expected_failure_mode:string>>"


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Claim-support cases of a JSONL file; id falls back to file name and line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")).withColumn("n", F.row_number().over(_by_place())).where(strip(F.col("value")) != "")
    rows = lines.select("path", "n", F.from_json("value", f"{CASE_SCHEMA}, {MUTATIONS}").alias("r")).select("path", "n", "r.*")
    return rows.withColumn("id", F.coalesce("id", F.concat_ws(":", F.regexp_extract("path", r"([^/]+)$", 1), F.col("n")))).drop("path", "n")


def expected_claims(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, claim_contains string, expected_label string, expected_failure_mode string").json(path)


def hallmark_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bibtex_key string, bibtex_type string, fields map<string,string>").json(path)


EXTERNAL = "id string, claim_id string, uid string, atom_id string, claim string, citation string, citation_text string, statement string, text string, atom string, evidence string, abstract string, sentence string, passage string, source string, snippet string, evidence_sentences array<string>, sentences array<string>, passages array<string>, is_supported boolean, expected_label string, label string, evidence_label string, verdict string"


def external_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of an external benchmark: JSON lines, a JSON list, or an object that holds one under a known name."""
    if path.endswith(".jsonl"):
        return spark.read.schema(EXTERNAL).json(path)
    whole = spark.read.text(path, wholetext=True)
    inner = f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in EXTERNAL.split(', '))}>>"
    lists = [F.from_json("value", f"{name} {inner}")[name] for name in ("data", "claims", "annotations", "examples")]
    lists.append(F.from_json("value", inner))
    found = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    return whole.select(F.explode(found).alias("r")).select("r.*")


def suite_manifest(path: str) -> dict:
    """A suite manifest, which is configuration: a small file read on the driver, checked and filled with defaults."""
    with open(path, encoding="utf-8") as f:
        out = json.load(f)
    if not isinstance(out.get("datasets"), list):
        raise ValueError("a manifest needs a list of datasets")
    for part in ("gates", "layer_gates", "benchmark_layers"):
        if not isinstance(out.setdefault(part, {}), dict):
            raise ValueError(f"{part} must be an object")
    out["datasets"] = [{"layer": "regression", "source_type": "synthetic", "locked": False} | d for d in out["datasets"]]
    return out
