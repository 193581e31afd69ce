"""Text functions, claim parsing, rules, judging, bibliography and evaluation on small inputs."""

import os

import pytest
from pyspark.sql import functions as F

from attestry import entries, fixtures
from attestry.functions import text as T
from attestry.operators import bibliography as bib
from attestry.operators import claims as C
from attestry.operators import evaluate as ev
from attestry.operators import judge
from attestry.operators.retrieval import build_chunks, retrieve
from attestry.rules import lenses
from attestry.rules.quantities import quantities
from attestry.sources import readers


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr).first()[0]


@pytest.mark.parametrize(("text", "want"), [("The Cat is at 3 Inns", ["cat", "3", "inns"]), ("", []), ("of the", [])])
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("B LEURT", "BLEURT"), ("AB C DE x", "ABCDE x"), ("AB C", "AB C"), ("A B", "A B"), ("Method X PPO", "Method XPPO")])
def test_joined_capitals(spark, text, want):
    assert one(spark, T.joined_capitals(F.col("t")), t=text) == want


def test_sentences_chunks_windows(spark):
    assert one(spark, T.sentences(F.col("t")), t="One. Two!  Three? ") == ["One.", "Two!", "Three?"]
    assert one(spark, T.windows(F.col("t")), t="A. B. C.") == ["A. B.", "A. B. C.", "B. C."]
    long = "x" * 800
    text = f"para one\n\npara two\n \n{long}\n\nlast"
    assert one(spark, T.chunks(F.col("t")), t=text) == ["para one para two", long, "last"]
    assert one(spark, T.chunks(F.col("t")), t="  ") == []


def test_claims(spark):
    keys = one(spark, C.citation_keys(F.col("t")), t=r"x \cite{a, b} y [@c; see @a] \citep*{d}")
    assert keys == ["a", "b", "d", "c"]
    assert one(spark, C.claim_text(F.col("t")), t=r"It works~\cite{a} {well} .") == "It works well."
    assert one(spark, C.clauses(F.col("t")), t=r"A uses x \cite{a}, while B uses y \cite{b}.") == [r"A uses x \cite{a}.", r"B uses y \cite{b}."]
    assert one(spark, C.clauses(F.col("t")), t=r"We use gloss \cite{a} for parsing of text.") == [r"We use gloss \cite{a}."]
    assert one(spark, C.clauses(F.col("t")), t=r"We test on a dialogue corpus (Wards~\cite{w}).") == [r"Wards is a dialogue corpus \cite{w}."]
    assert one(spark, C.atoms(F.col("t")), t="Alpha improves recall and reduces cost.") == ["Alpha improves recall.", "Alpha reduces cost."]
    assert one(spark, C.atoms(F.col("t")), t="Alpha  stays.") == ["Alpha stays."]
    nested = "\\emph{" * 9 + "deep" + "}" * 9
    assert one(spark, C.prepared(F.col("t")), t=f"A {nested} b") == "A deep b"
    draft = "# Head\nA is B \\cite{k}. % no \\cite{z}\n\\begin{table}C \\cite{q}.\\end{table} D has E."
    rows = C.parse_claims(spark.createDataFrame([("d", draft)], "id string, text string")).collect()
    assert [(r["claim"], r["citation_keys"]) for r in rows] == [("A is B.", ["k"])]


def test_quantities(spark):
    got = one(spark, quantities(F.col("t")), t="about 16k tokens, twenty five patients, a few hundred days, 3.5 % and 2,000 labeled samples of 5 cats")
    assert [(float(q["number"]), q["unit"]) for q in got] == [(16000, "token"), (25, "patient"), (300, "day"), (3.5, "%"), (2000, "sample")]


CASES = [
    ("numeric", "It needs 5 days.", "It needs 7 days.", "It needs 5 days."),
    ("unit", "It takes 5 days.", "It takes 5 weeks.", "It takes 5 days."),
    ("year", "Since 1999.", "Since 2001.", "Since 1999."),
    ("negation", "It uses a parser.", "It does not use a parser.", "It does not use a parser, but uses it. It uses a parser."),
    ("direction", "Heat increased in wards.", "Heat decreased in wards.", "Heat increased in wards."),
    ("numeric_bound", "Group A had more than 40 patients.", "Group A had 30 patients.", "Group A had 50 patients."),
    ("qualitative", "Only Alpha solves wards tasks.", "Alpha is among solves wards tasks.", "Alpha solves wards tasks."),
    ("attribute", "The tool reads English notes.", "The tool reads German notes.", "The tool reads English notes."),
    ("technical", "The retrieval system uses greedy search.", "The retrieval system uses beam search.", "The retrieval system uses greedy search."),
    ("statistical", "The mean delay in wards fell.", "The median delay in wards fell.", "The mean delay in wards fell."),
    ("protocol", "The blinded review of wards ended.", "The unblinded review of wards ended.", "The blinded review of wards ended."),
    ("release", "The team releases training code for wards.", "The team does not release training code for wards.", "The team releases training code for wards."),
    ("outcome", "The drug reduces mortality in wards.", "In wards with the drug, mortality was unchanged.", "The drug reduces mortality in wards."),
    ("role", "Alpha was trained on Wards notes.", "Alpha was evaluated on Wards notes.", "Alpha was trained on Wards notes."),
    ("component", "In wards the retrieval improves recall.", "In wards recall rose without retrieval.", "In wards the retrieval improves recall."),
    ("contrast", "Nurses use paper charts in wards.", "Nurses use screens in wards rather than paper charts.", "Nurses use paper charts in wards."),
    ("clinical", "In adults the drug worked on wards.", "In children the drug worked on wards.", "In adults the drug worked on wards."),
    ("measurement", "Alpha reached accuracy of 81.5 on wards.", "Alpha reached accuracy of 79 on wards.", "Alpha gained more than 2.0 accuracy on wards."),
    ("training_config", "Alpha used dropout 0.1.", "Alpha used dropout 0.3.", "Alpha used dropout 0.1."),
    ("mapping", "Code a=1 means stop.", "Code a=1 means go.", "Code a=1 means stop."),
    ("p_value", "The effect on wards had p < 0.01.", "The effect on wards had p = 0.04.", "The effect on wards had p = 0.001."),
    ("interval", "The effect on wards was statistically significant.", "The effect on wards had a 95% CI [-0.1, 0.4].", "The effect on wards had a 95% CI [0.1, 0.4]."),
    ("ratio_effect", "The hazard ratio was below 1.", "The hazard ratio was 1.4.", "The hazard ratio was 0.7."),
    ("strength", "Alpha gave large gains on wards.", "Alpha gave modest gains on wards.", "Alpha gave large gains on wards."),
    ("overstatement", "The drug causes sleep in wards.", "The drug was associated with sleep in wards.", "The drug causes sleep in wards."),
    ("assertion", "Alpha improves triage of wards.", "Alpha is designed to improves triage of wards.", "Alpha improves triage of wards."),
    ("mixed_outcome", "Alpha improves accuracy on wards.", "Alpha improved accuracy on wards but reduced accuracy on ships.", "Alpha improves accuracy on wards."),
    ("target", "The primary endpoint was sleep on wards.", "The secondary endpoint was sleep on wards.", "The primary endpoint was sleep on wards."),
    ("context", "Alpha improves sleep on wards.", "Alpha improves sleep on wards only if nurses agree.", "Alpha improves sleep on wards."),
    ("scope", "All wards improved sleep scores.", "Most wards improved sleep scores.", "All wards improved sleep scores."),
    ("bound_tension", "Group A had more than 40 patients.", "Group A had 40 patients.", "Group A had more than 40 patients."),
]


@pytest.fixture(scope="module")
def findings(spark):
    rows = [(n, i, c, e) for n, c, bad, good in CASES for i, e in enumerate((bad, good))]
    df = spark.createDataFrame(rows, "rule string, i int, claim string, evidence string")
    rules = lenses.CONFLICTS | lenses.TENSIONS
    names = sorted({n for n, *_ in CASES})
    out = df.select("rule", "i", *[rules[n](F.col("claim"), F.col("evidence")).alias(f"f_{n}") for n in names]).collect()
    return {(r["rule"], r["i"]): r[f"f_{r['rule']}"] for r in out}


@pytest.mark.parametrize("name", [c[0] for c in CASES])
def test_rule(findings, name):
    assert findings[(name, 0)], f"{name} finds nothing"
    assert not findings[(name, 1)], findings[(name, 1)]


def test_comparisons(spark):
    rows = [("NetA2 beats NetB2 on Wards.", "NetB2 beats NetA2 on Wards."), ("NetA2 beats NetB2.", "NetB2 is outperformed by NetA2."), ("NetA2 beats NetB2.", "NetA2 matches NetB2."), ("NetA2 beats NetB2 on Wards.", "NetA2 beats NetB2 on Ships.")]
    df = spark.createDataFrame(rows, "claim string, evidence string")
    df = lenses.comparisons(lenses.comparisons(df, "claim", "x_"), "evidence", "y_")
    conflict, tension = lenses.compared("x_", "y_")
    got = [(len(r[0]), [t.split(":")[0] for t in r[1]]) for r in df.select(conflict, tension).collect()]
    assert got == [(1, []), (0, []), (0, ["Comparison strength mismatch"]), (0, ["Comparison context mismatch"])]


def test_adjudication(spark):
    got = {r["pair_id"]: (r["label"], r["failure_mode"]) for r in entries.adjudicate_fixtures(spark, "").collect()}
    assert got == {p[0]: (p[3], p[4]) for p in fixtures.PAIRS}


def test_combination(spark):
    def j(label, conf, mode=None):
        return judge.judgment(label, conf, "r", mode)

    def final(*parts):
        return tuple(spark.range(1).select(judge.combined(F.array(*parts)).alias("j")).first()["j"])

    assert final(j("supported", 0.9), j("supported", 0.7))[:2] == ("supported", 0.7)
    assert final(j("supported", 0.9), j("contradicted", 0.7))[::3] == ("partially_supported", "missing_atom_support")
    assert final(j("contradicted", 0.8), j("unsupported", 0.7))[::3] == ("contradicted", "conflicting_sources")
    assert final(j("unsupported", 0.3, "no_rationale_span"))[2:] == ("No atomic subclaim is supported.", "no_rationale_span")
    assert final(j("uncertain", 0.3))[::3] == ("uncertain", "source_silence")


def test_model_opinion(spark):
    df = spark.createDataFrame([("The planner improves recall.", "The planner improves recall.", ("contradicted", 0.9, "m", None))], "claim string, evidence string, nli struct<label:string,confidence:double,reason:string,mode:string>")
    row = judge.adjudicate(judge.judge_pairs(df), "nli").first()["verdict"]
    assert (row["label"], row["mode"]) == ("contradicted", "model_disagreement")


def test_verify(spark):
    got = {r["claim"]: (r["label"], r["failure_mode"], r["source_gate"]) for r in entries.verify_drafts(spark, "").collect()}
    assert got == {
        "The planner improves recall on long dialogues.": ("supported", None, "passed"),
        "The survey began in 2011 across hospitals.": ("contradicted", "year_conflict", "passed"),
        "The parser reads wards.": ("uncertain", "source_not_resolved", "source_not_resolved"),
    }


def test_retrieve_ranks(spark):
    sources = spark.createDataFrame([("s1", "k", "s1", "cats sleep all day"), ("s2", "k", "s2", "dogs and cats run"), ("s3", "z", "s3", "cats sleep")], "source_id string, citation_key string, title string, text string")
    claims = spark.createDataFrame([(1, "cats sleep", ["k"]), (2, "cats sleep", [])], "claim_id long, claim string, citation_keys array<string>")
    got = {}
    for r in retrieve(claims, build_chunks(sources)).orderBy("claim_id", "chunk_rank").collect():
        got.setdefault(r["claim_id"], []).append((r["source_id"], r["chunk_score"]))
    assert [x[0] for x in got[1]] == ["s1", "s2"] and [x[0] for x in got[2]] == ["s3", "s1", "s2"]
    assert got[2][0][1] == 1.0


def test_bibliography(spark):
    row = entries.bibliography_report(spark, "").first()
    assert (row["occurrences"], row["cited"], row["missing"], row["unused"]) == (4, 3, "ghost", "spare")
    assert row["incomplete"] == '{"survey":["year"]}'
    found = readers.bibtex_entries(fixtures.frame(spark, "bibliographies")).where("key = 'plan'").first()
    assert found["fields"]["title"] == "Planning for {Long} Dialogues"
    deep = "@misc{d, title={a {b {c {d {e {f}}}}}}, year=2001}"
    assert readers.bibtex_entries(spark.createDataFrame([(deep,)], "text string")).first()["fields"] == {"title": "a {b {c {d {e {f}}}}}", "year": "2001"}
    with pytest.raises(Exception, match="Unclosed"):
        readers.bibtex_entries(spark.createDataFrame([("@misc{a, title={x}",)], "text string")).collect()


def test_metadata(spark):
    got = {r["bibtex_key"]: (r["status"], r["label"]) for r in entries.metadata_match(spark, "").collect()}
    assert got == {"plan": ("verified", "VALID"), "survey": ("not_found", "HALLUCINATED"), "spare": ("not_found", "HALLUCINATED")}


def test_alignment_is_greedy(spark):
    sources = spark.createDataFrame([("a", "a", "planning long dialogues", "t", "1"), ("b", "b", "planning long dialogues again", "t", "2")], "source_id string, citation_key string, title string, text string, path string")
    entries_ = spark.createDataFrame([("k1", 0, {"title": "Planning Long Dialogues"}), ("k2", 1, {"title": "Planning Long Walks"})], "key string, entry_ord int, fields map<string,string>")
    got = {r["source_id"]: r["citation_key"] for r in bib.align_sources(sources, entries_).collect()}
    assert got == {"a": "k1", "b": "k2"}
    chain = spark.createDataFrame([(f"s{i}", f"s{i}", "alpha beta gamma", "t", f"{i}") for i in range(4)], sources.schema)
    titles = spark.createDataFrame([(f"k{i}", i, {"title": " ".join(["alpha", "beta", "gamma"][: 3 - i])}) for i in range(3)], entries_.schema)
    assert {r["source_id"]: r["citation_key"] for r in bib.align_sources(chain, titles).collect()} == {"s0": "k0", "s1": "k1", "s2": "k2", "s3": "s3"}


def test_metrics(spark):
    rows = [("supported", "supported")] * 3 + [("unsupported", "supported"), ("contradicted", "contradicted")]
    s = ev.summarize(spark.createDataFrame(rows, "expected_label string, predicted string")).first()
    assert (s["total"], s["accuracy"], s["false_supported_rate"], s["supported_precision"]) == (5, 0.8, 0.2, 0.75)
    assert s["macro_f1"] == round((2 * 0.75 / 1.75 + 1) / 5, 4) and s["confusion"]["unsupported"]["supported"] == 1
    gates = spark.createDataFrame([("min_accuracy", 0.9), ("max_false_supported_rate", 0.2)], "gate string, threshold double")
    got = {r["gate"]: r["pass"] for r in ev.gate_results(ev.summarize(spark.createDataFrame(rows, "expected_label string, predicted string")), gates).collect()}
    assert got == {"min_accuracy": False, "max_false_supported_rate": True}


def test_labels_and_formats(spark):
    rows = [("x", "SUPPORTS", None), ("y", "not-enough-info", None), ("z", "refuted", None), ("w", None, True)]
    df = spark.createDataFrame(rows, "id string, raw string, flag boolean")
    got = [r[0] for r in df.select(ev.normal_label(F.col("raw"), F.col("flag"))).collect()]
    assert got == ["supported", "unsupported", "contradicted", "supported"]
    with pytest.raises(Exception, match="Unsupported external"):
        spark.createDataFrame([("odd",)], "raw string").select(ev.normal_label(F.col("raw"), F.lit(None).cast("boolean"))).collect()


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one \n")
    (tmp_path / "b.md").write_text("two")
    (tmp_path / "c.jsonl").write_text('{"text": "three", "source_id": "", "citation_key": "k"}\n\n{"text": "four"}\n')
    got = sorted((r["source_id"], r["citation_key"], r["text"]) for r in readers.sources(spark, str(tmp_path)).collect())
    assert got == [("a", "a", "one"), ("b", "b", "two"), ("c-3", "c-3", "four"), ("k", "k", "three")]
    (tmp_path / "d.jsonl").write_text('{"text": " "}\n')
    with pytest.raises(Exception, match="Missing text"):
        readers.jsonl_sources(spark, str(tmp_path)).collect()


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert set(entries.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in entries.oracle_sql()])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "pages", "nation", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(entries.oracle_sql()[name]).df()
    got = entries.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    rows = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
    assert sorted(got.columns) == cols and rows(got) == rows(want)


def test_retrieve_topk_sql_on_acronyms(spark, tmp_path):
    """Claims with names, split acronyms on both sides, camel case, equal scores and missing texts, against the SQL."""
    import duckdb

    con = duckdb.connect()
    con.sql("""CREATE TABLE documents AS SELECT * FROM (VALUES
      (1, 'Licensed under CC BY-NC 4.0. Cats sleep near the SS harbour.', 'a'), (2, 'Cats sleep near the harbour.', 'a'), (10, 'Cats sleep near the harbour.', 'b'),
      (11, 'The dataSet of iPhone photos, B LEURT and BLEURT.', 'b'), (12, NULL, 'a'), (13, '', 'a'), (14, 'the of', 'a'), (15, 'Nothing alike here', 'a')) t(doc_id, text, source)""")
    con.sql("""CREATE TABLE benchmark AS SELECT * FROM (VALUES
      (1, 'Licensed under CC BY-NC 4.0.'), (2, 'SS harbour cats'), (3, 'BLEURT and dataSet'), (4, 'B LEURT'), (5, NULL), (6, 'the of'), (7, 'Cats sleep near')) t(item_id, text)""")
    for t, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        con.sql(f"COPY (SELECT * REPLACE ({key}::BIGINT AS {key}) FROM {t}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    want = con.sql(entries.oracle_sql()["retrieve_topk"]).fetchall()
    got = [tuple(r) for r in entries.retrieve_topk(spark, str(tmp_path)).collect()]
    assert len(want) > 8 and sorted(got) == sorted(want)


def test_retrieve_keeps_bonuses(spark):
    sources = spark.createDataFrame([("s1", "k", "s1", "B LEURT scores"), ("s2", "k", "s2", "scores rise")], "source_id string, citation_key string, title string, text string")
    claims = spark.createDataFrame([(1, "BLEURT scores", ["k"])], "claim_id long, claim string, citation_keys array<string>")
    got = {r["source_id"]: (r["n_shared"], r["n_chunk"], r["chunk_score"]) for r in retrieve(claims, build_chunks(sources)).collect()}
    assert got == {"s1": (2, 4, 0.9571), "s2": (1, 2, 0.5)}
