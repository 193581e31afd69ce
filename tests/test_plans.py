"""Plans, sinks and the command line on small inputs."""

import json

import pytest

from attestry import __main__ as cli
from attestry import fixtures
from attestry.operators import bibliography as bib
from attestry.operators import evaluate as ev
from attestry.operators import chat, nli
from attestry.operators.judge import adjudicate_pairs
from attestry.plans import suite
from attestry.sinks import report
from attestry.sources import providers, readers
from attestry.streaming import drafts

CASE = {"claim": "The drug lowers pain in 40 patients.", "evidence": "The drug lowers pain in 55 patients.", "expected_label": "contradicted", "expected_failure_mode": "numeric_conflict"}
SAME = {"id": "s", "claim": "The drug lowers pain.", "evidence": "The drug lowers pain.", "expected_label": "supported"}


def test_suite(spark, tmp_path):
    (tmp_path / "cases.jsonl").write_text(json.dumps(CASE) + "\n" + json.dumps(SAME | {"mutations": [{"kind": "m", "claim": "The drug cures pain.", "expected_label": "unsupported"}]}) + "\n")
    (tmp_path / "suite.json").write_text(json.dumps({"datasets": [{"name": "d", "path": "cases.jsonl", "locked": True}], "layer_gates": {"regression": {"min_accuracy": 1.0}}, "gates": {"max_false_supported_rate": 0.0}}))
    parts = suite.run_suite(spark, str(tmp_path / "suite.json"))
    assert {(r["layer"], r["gate"], r["pass"]) for r in parts["gates"].collect()} == {("regression", "min_accuracy", True), (None, "max_false_supported_rate", True)}
    assert parts["failures"].first()["failure_count"] == 0
    cases = readers.eval_cases(spark, str(tmp_path / "cases.jsonl"))
    assert {r["id"] for r in cases.collect()} == {"cases.jsonl:1", "s"}
    assert [r["id"] for r in ev.mutated(cases.where("mutations IS NOT NULL")).collect()] == ["s::m"]
    lexical = {r["id"]: r["predicted"] for r in suite.predict(cases.drop("mutations"), "lexical").collect()}
    assert lexical["s"] == "supported"


def test_external(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text(json.dumps({"claim_id": "7", "claim": "c", "evidence": "e", "evidence_label": "SUPPORT"}) + "\n" + json.dumps({"uid": "u", "citation_text": "t", "sentences": ["a", " ", "b"], "label": "refutes"}) + "\n")
    got = [tuple(r) for r in ev.converted(readers.external_records(spark, str(tmp_path / "x.jsonl")), "scifact").collect()]
    assert got == [("7", "c", "e", "supported", "scifact"), ("u", "t", "a b", "contradicted", "scifact")]
    (tmp_path / "y.json").write_text(json.dumps({"annotations": [{"atom_id": "a1", "atom": "x", "passage": "p", "is_supported": False}]}))
    assert [tuple(r)[:4] for r in ev.converted(readers.external_records(spark, str(tmp_path / "y.json")), "factscore").collect()] == [("a1", "x", "p", "unsupported")]


def test_model_opinion(spark):
    attach = nli.opinion(lambda: lambda pairs: [("contradiction", 0.9) if "rain" in e else ("neutral", 0.2) for e, _ in pairs])
    pairs = spark.createDataFrame([(1, "The planner improves recall.", "The planner improves recall in rain."), (2, "The planner improves recall.", "The planner improves recall.")], "id long, claim string, evidence string")
    got = {r["id"]: (r["verdict"]["label"], r["verdict"]["mode"]) for r in adjudicate_pairs(pairs, ["id"], attach).collect()}
    assert got == {1: ("contradicted", "model_disagreement"), 2: ("partially_supported", "model_disagreement")}


def test_paper_and_reports(spark, tmp_path):
    tex = spark.createDataFrame([("The planner improves recall on long dialogues \\cite{plan}.",)], "text string")
    sources = spark.createDataFrame([("f1", "f1", "planning for long dialogues", "The planner improves recall on long dialogues.", "/f1")], "source_id string, citation_key string, title string, text string, path string")
    parts = suite.verify_paper(tex, fixtures.frame(spark, "bibliographies"), sources)
    results = parts["results"]
    row = results.first()
    assert (row["label"], row["citation_keys"]) == ("supported", ["plan"])
    text = "\n".join(r["value"] for r in report.paper_markdown(parts["bibliography"], results).orderBy("ord").collect())
    assert "- `spare`" in text and "- supported: 1" in text and "Confidence: 0.95" in text
    page = report.dashboard(results, "A </script>")
    assert page.count("</script>") == 2 and "supported: 1" in page and "A &lt;/script&gt;" in page
    report.write_dashboard(results, str(tmp_path / "page.html"), "A </script>")
    assert (tmp_path / "page.html").read_text() == page
    kept = {r["part"]: json.loads(r["value"]) for r in report.paper_json(parts).collect()}
    assert kept["mapping"] == {"loaded": 1, "mapped": 1} and kept["claim"]["label"] == "supported" and kept["bibliography"]["unused"] == ["spare", "survey"]
    assert "- Mapped to bibliography keys: 1" in report.paper_markdown(parts["bibliography"], results, parts["mapping"]).where("ord = -1").first()["value"]
    report.write_ledgers(results, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out" / "ledger.json")).first()[0])["label"] == "supported"
    blocks = report.draft_blocks(spark.createDataFrame([("# Head\n\nThe planner improves recall on long dialogues \\cite{plan}.\n\nOther \\cite{plan}.",)], "text string"))
    bound = bib.bind_blocks(results.select("claim_id", "claim", "citation_keys"), blocks)
    marked = {r["block_ord"]: r["annotated"] for r in report.annotated(blocks, bound, results).collect()}
    assert marked[1].endswith("[supported]") and not marked[2].endswith("]")
    shown = "".join(report.annotated_page(report.annotated(blocks, bound, results)))
    assert "<h2># Head</h2>" in shown and "<mark>supported</mark>" in shown


def test_draft_eval_is_gated(spark):
    """Without the bibliography a source that it doesn't list supports a claim; with it, the claim is uncertain."""
    drafts = spark.createDataFrame([("d", "The planner improves recall \\cite{plan}. The walker improves recall \\cite{made}.")], "draft_id string, text string")
    sources = spark.createDataFrame([("plan", "plan", "plan", "The planner improves recall.", "1"), ("made", "made", "made", "The walker improves recall.", "2")], "source_id string, citation_key string, title string, text string, path string")
    expected = spark.createDataFrame([("a", "planner", "supported", None), ("b", "walker", "uncertain", "source_not_resolved")], "id string, claim_contains string, expected_label string, expected_failure_mode string")
    listed = spark.createDataFrame([("plan", "misc", {"title": "Plan"}, 0)], "key string, entry_type string, fields map<string,string>, entry_ord int")
    _, open_ = suite.run_draft_eval(drafts, sources, expected)
    cases, gated = suite.run_draft_eval(drafts, sources, expected, listed)
    assert (open_.first()["false_supported_rate"], gated.first()["false_supported_rate"], gated.first()["accuracy"]) == (0.5, 0.0, 1.0)
    assert {r["id"]: (r["candidate_count"], r["best_support_rank"]) for r in cases.collect()} == {"a": (1, 1), "b": (0, None)}


def test_metadata_services(spark):
    crossref = {"message": {"title": ["Planning Dialogues"], "DOI": "10.1/x", "issued": {"date-parts": [[2020, 1]]}, "author": [{"given": "Ada", "family": "Stone"}], "container-title": ["J"]}}
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>Planning\n Dialogues</title><published>2020-02-03</published><author><name>Ada Stone</name></author><id>u</id></entry></feed>"

    def recorded(address: str) -> str:
        """Answers as the services give them; one of them is down."""
        if "crossref" in address:
            return json.dumps(crossref if "10.1%2Fx" in address else {"message": {"items": []}})
        if "openalex" in address:
            raise OSError("down")
        if "semanticscholar" in address:
            return json.dumps({"title": "Cooking", "year": 2001, "authors": [{"name": "Zed"}], "externalIds": {"DOI": "10.9/y"}})
        return atom if "Planning" in address else atom.replace("entry", "other")

    rows = [("p", {"title": "Planning Dialogues", "doi": "10.1/x", "year": "2020", "author": "Ada Stone"}), ("q", {"title": "Walking"}), ("r", {"year": "1999"})]
    entries_ = spark.createDataFrame(rows, "key string, fields map<string,string>")
    found = providers.fetched_records(entries_, fetch=recorded)
    got = {r["key"]: r for r in bib.verify_metadata(entries_, found).collect()}
    assert (got["p"]["status"], got["p"]["provider"], got["p"]["api_calls"]) == ("verified", "crossref", 4)
    assert got["q"]["status"] == "not_found" and got["q"]["matched_title"] == "Cooking"
    assert (got["r"]["status"], got["r"]["api_calls"]) == ("skipped", 0)
    only = providers.fetched_records(entries_, ["openalex"], recorded)
    bad = {r["key"]: (r["status"], r["reason"]) for r in bib.verify_metadata(entries_, only).collect()}
    assert bad["p"] == ("error", "No external metadata hit found. Provider errors: openalex: down")
    authors = {r["provider"]: r["record"]["authors"] for r in found.where("key = 'p' AND record IS NOT NULL").collect()}
    assert authors == {"crossref": ["Ada Stone"], "semanticscholar": ["Zed"], "arxiv": ["Ada Stone"]}
    assert [s.name for s in providers.services(["S2", "arxiv"])] == ["semanticscholar", "arxiv"]
    with pytest.raises(ValueError, match="Unknown metadata provider"):
        providers.services(["none"])


def test_methods(spark):
    cases = spark.createDataFrame([("1", "The planner improves recall.", "The planner improves recall in rain.", "supported", None)], "id string, claim string, evidence string, expected_label string, expected_failure_mode string")
    attach = nli.opinion(lambda: lambda pairs: [("contradiction", 0.9)] * len(pairs))
    send = lambda asked: {"choices": [{"message": {"content": 'Sure: {"label": "Refuted", "confidence": 7, "reason": "r"}' if "rain" in asked["messages"][1]["content"] else "{}"}}]}
    assert suite.predict(cases, "nli", attach).first()["predicted"] == "contradicted"
    row = suite.predict(cases, "raw-llm", send=send).first()
    assert (row["predicted"], row["confidence"]) == ("contradicted", 1.0)
    ranked = suite.compare_methods(cases, ("lexical", "nli", "raw-llm"), nli=attach, send=send).collect()
    assert [r["method"] for r in sorted(ranked, key=lambda r: r["rank"])][0] == "lexical" and set(suite.METHODS) >= {r["method"] for r in ranked}
    assert chat.reply("{}") == ("uncertain", 0.5, "") and chat.reply('{"label": "odd"}')[0] == "uncertain"
    with pytest.raises(ValueError):
        chat.reply("no object")


def test_streams(spark, tmp_path):
    folder = tmp_path / "drafts"
    folder.mkdir()
    (folder / "a.md").write_text("The planner improves recall \\cite{plan}. No claim here.")
    (folder / "b.md").write_text("The tagger reads notes [@plan].")
    claims = drafts.claim_stream(drafts.draft_stream(spark, str(folder), files=1))
    assert claims.isStreaming
    sources = spark.createDataFrame([("plan", "plan", "plan", "The planner improves recall.")], "source_id string, citation_key string, title string, text string")
    for _ in range(2):  # started again, it has nothing left to do
        drafts.verify_stream(claims, sources, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(240)
    got = {r["claim"]: r["label"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["The planner improves recall."] == "supported" and len(got) == 2


def test_numbered(spark):
    rows = spark.range(0, 5000, numPartitions=7).selectExpr("4999 - id AS id")
    assert [tuple(r) for r in report.numbered(rows, "id", "n").where("n <> id + 1").collect()] == []


def test_command_line(spark, tmp_path):
    (tmp_path / "p.tex").write_text("A is B \\cite{x}.")
    (tmp_path / "p.bib").write_text("@misc{x, title={T}, year={2000}}")
    assert cli.run(spark, cli.parser().parse_args(["verify-bib", str(tmp_path / "p.tex"), str(tmp_path / "p.bib")]))
    (tmp_path / "p.bib").write_text("@misc{y, title={T}, year={2000}}")
    assert not cli.run(spark, cli.parser().parse_args(["verify-bib", str(tmp_path / "p.tex"), str(tmp_path / "p.bib")]))
