"""Small inline inputs for operators that the driver's tables say nothing about, and the rows they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAIRS = [
    (1, "The drug lowers pain in 40 patients.", "The drug lowers pain in 55 patients.", "contradicted", "numeric_conflict"),
    (2, "The survey began in 2011 across hospitals.", "The survey began in 2014 across hospitals.", "contradicted", "year_conflict"),
    (3, "The parser handles images from clinics.", "The parser handles audio from clinics.", "contradicted", "entity_conflict"),
    (4, "The tagger uses gold labels.", "The tagger does not use gold labels.", "contradicted", "negation_conflict"),
    (5, "NetAlpha outperforms NetBeta on parsing.", "NetBeta outperforms NetAlpha on parsing.", "contradicted", "comparison_direction_conflict"),
    (6, "The planner improves recall on long dialogues.", "The planner improves recall on long dialogues.", "supported", None),
    (7, "The planner improves recall on long dialogues.", "Bananas ripen quickly in warm rooms.", "unsupported", "source_silence"),
    (8, "The planner improves recall on long dialogues.", "The planner may improve recall on long dialogues.", "partially_supported", "hedged_evidence"),
    (9, "The encoder was trained with a batch size of 32.", "The encoder was trained with a batch size of 64.", "contradicted", "numeric_conflict"),
    (10, "Results on the cohort were significant at p < 0.01.", "Results on the cohort were significant at p = 0.2.", "contradicted", "numeric_conflict"),
    (11, "The label x=1 means accept.", "The label x=1 means reject.", "contradicted", "entity_conflict"),
    (12, "The trial was a prospective audit of wards.", "The trial was a retrospective audit of wards.", "contradicted", "entity_conflict"),
]
DRAFTS = [("d1", "# Heading\nThe planner improves recall on long dialogues \\cite{plan}. We think so. % note\nThe survey began in 2011 across hospitals [@survey; @plan].\nThe \\emph{parser} reads wards~\\citep{ghost}.")]
SOURCES = [("plan", "plan", "plan", "The planner improves recall on long dialogues. It was tested in labs."), ("survey", "survey", "survey", "The survey began in 2014 across hospitals. Staff filled the forms.")]
BIBLIOGRAPHIES = [("b1", "@article{plan, author = {Ada Stone and Bo Reed}, title = {Planning for {Long} Dialogues}, journal = {J}, year = {2020}}\n@misc{survey, title = {A Survey of Hospitals}}\n@book{spare, author={C}, title=\"Spare Parts\", publisher={P}, year=1999}")]
RECORDS = [("plan", 0, 0, "index", ("Planning for Long Dialogues", "2020", ["Ada Stone", "Bo Reed"], None)), ("survey", 0, 0, "index", ("Cooking at Home", "2001", ["Zed"], None))]
EXPECTED = [("e1", "planner improves recall", "supported", None), ("e2", "survey began", "contradicted", "year_conflict"), ("e3", "parser reads", "uncertain", "source_not_resolved")]
CASES = [("c1", "The drug lowers pain.", "The drug lowers pain.", "supported", [("flip", None, None, "The drug raises pain.", "contradicted", None), (None, "own", "The drug cures pain.", None, "unsupported", None)])]

TABLES = {
    "pairs": (PAIRS, "pair_id long, claim string, evidence string, label string, failure_mode string"),
    "drafts": (DRAFTS, "draft_id string, text string"),
    "sources": (SOURCES, "source_id string, citation_key string, title string, text string"),
    "bibliographies": (BIBLIOGRAPHIES, "bib_id string, text string"),
    "records": (RECORDS, "key string, provider_ord int, record_ord int, provider string, record struct<title:string,year:string,authors:array<string>,doi:string>"),
    "expected": (EXPECTED, "id string, claim_contains string, expected_label string, expected_failure_mode string"),
    "cases": (CASES, "id string, claim string, evidence string, expected_label string, mutations array<struct<kind:string,id:string,claim:string,evidence:string,expected_label:string,expected_failure_mode:string>>"),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _text(x) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else "'" + str(x).replace("'", "''") + "'"


SQL = {
    "adjudicate_fixtures": "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_text(label)}, {_text(mode)})" for i, _, _, label, mode in PAIRS) + ") t(pair_id, label, failure_mode)",
    "parse_drafts": "SELECT * FROM (VALUES ('d1', 'The planner improves recall on long dialogues.', 'plan'), ('d1', 'The survey began in 2011 across hospitals.', 'survey,plan'), ('d1', 'The parser reads wards.', 'ghost')) t(draft_id, claim, keys)",
    "verify_drafts": "SELECT * FROM (VALUES ('The planner improves recall on long dialogues.', 'supported', CAST(NULL AS VARCHAR), 'passed'), ('The survey began in 2011 across hospitals.', 'contradicted', 'year_conflict', 'passed'), ('The parser reads wards.', 'uncertain', 'source_not_resolved', 'source_not_resolved')) t(claim, label, failure_mode, source_gate)",
    "eval_drafts": "SELECT * FROM (VALUES ('e1', 'supported', CAST(NULL AS VARCHAR), false, true, 1::BIGINT), ('e2', 'contradicted', 'year_conflict', false, true, 1), ('e3', 'uncertain', 'source_not_resolved', false, true, 0)) t(id, predicted, predicted_mode, false_supported, pass, candidate_count)",
    "mutated_cases": "SELECT * FROM (VALUES ('c1::flip', 'c1', 'flip', 'The drug lowers pain.', 'The drug raises pain.', 'contradicted'), ('own', 'c1', 'mutation', 'The drug cures pain.', 'The drug lowers pain.', 'unsupported')) t(id, parent_id, mutation_kind, claim, evidence, expected_label)",
    "bibliography_report": "SELECT 4::BIGINT AS occurrences, 3::BIGINT AS cited, 'ghost' AS missing, 'spare' AS unused, '{\"survey\":[\"year\"]}' AS incomplete",
    "metadata_match": "SELECT * FROM (VALUES ('plan', 'verified', 'VALID', 0.95::DOUBLE), ('spare', 'not_found', 'HALLUCINATED', 0.65::DOUBLE), ('survey', 'not_found', 'HALLUCINATED', 0.65::DOUBLE)) t(bibtex_key, status, label, confidence)",
}
