"""Cases that hold each rule against plain SQL: sentences with a slot, filled for claim and evidence from a table's rows.

A case is a rule, the two sentences, and the values of the slot; the claim takes the value that one column of a row picks,
the evidence that of another; a pair of values is one for each side. The SQL knows nothing of the rules: it says that a rule finds something where the picks
differ (or what else the case states), and nothing where they don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.judge import adjudicate_pairs
from .rules import lenses

DIFFER = "a <> b"
#: (case, rule, claim, evidence, values, when the rule finds something in terms of the picks a and b)
CASES: list[tuple[str, str, str, str, list, str]] = [
    ("modality", "attribute", "The parser handles {} from clinics.", "The parser handles {} from clinics.", ["images", "audio", "video"], DIFFER),
    ("task", "attribute", "The wards tool does {} of long notes.", "The wards tool does {} of long notes.", ["translation", "summarization", "segmentation"], DIFFER),
    ("language", "attribute", "The corpus holds {} notes of clinics.", "The corpus holds {} notes of clinics.", ["German", "French", "Spanish", "Chinese"], DIFFER),
    ("optimizer", "attribute", "The tagger was tuned with {} on notes.", "The tagger was tuned with {} on notes.", ["SGD", "RMSProp", "AdamW"], DIFFER),
    ("agents", "attribute", "The planner runs in a {} setting on dialogues.", "The planner runs in a {} setting on dialogues.", ["single-agent", "multi-agent"], DIFFER),
    ("complexity", "technical", "The sorting algorithm runs in {}.", "The sorting algorithm runs in {}.", ["linear time", "quadratic time", "constant time"], DIFFER),
    ("decoding", "technical", "The dialogue system answers with {}.", "The dialogue system answers with {}.", ["greedy search", "beam search"], DIFFER),
    ("shots", "technical", "The dialogue system was tested in a {} setting.", "The dialogue system was tested in a {} setting.", ["zero-shot", "one-shot", "few-shot"], DIFFER),
    ("summary statistic", "statistical", "The report lists the {} stay of wards.", "The report lists the {} stay of wards.", ["mean", "median"], DIFFER),
    ("tails", "statistical", "The wards were compared by a {} test.", "The wards were compared by a {} test.", ["one-tailed", "two-tailed"], DIFFER),
    ("blinding", "protocol", "The staff of the trial was {}.", "The staff of the trial was {}.", ["blinded", "unblinded"], DIFFER),
    ("temporality", "protocol", "The trial was a {} audit of wards.", "The trial was a {} audit of wards.", ["prospective", "retrospective"], DIFFER),
    ("correction", "protocol", "The wards report used the {} correction.", "The wards report used the {} correction.", ["Bonferroni", "Holm"], DIFFER),
    ("comparator", "protocol", "The drug was compared with {} in wards.", "The drug was compared with {} in wards.", ["placebo", "usual care", "sham"], DIFFER),
    ("dosing", "protocol", "The drug was given {} in wards.", "The drug was given {} in wards.", ["weekly", "monthly"], DIFFER),
    ("count", "numeric", "The drug lowers pain in {} patients.", "The drug lowers pain in {} patients.", ["12", "40", "55", "71"], DIFFER),
    ("share", "numeric", "The drug helps {} of the wards.", "The drug helps {} of the wards.", ["12%", "40%", "55%"], DIFFER),
    ("survey year", "year", "The survey began in {} across hospitals.", "The survey began in {} across hospitals.", ["1998", "2004", "2011", "2014"], DIFFER),
    ("negation", "negation", "The tagger uses gold labels.", "The tagger {} gold labels.", ["uses", "does not use"], "b = 1"),
    ("direction", "direction", "The drug causes {} pain in wards.", "The drug causes {} pain in wards.", ["increased", "reduced"], "a = 0 AND b = 1 OR a = 1 AND b = 0"),
    ("p value", "p_value", "Results on the cohort were significant at p {}.", "Results on the cohort were significant at p {}.", ["= 0.01", "= 0.2", "= 0.6"], DIFFER),
    ("batch size", "training_config", "The encoder was trained with a batch size of {}.", "The encoder was trained with a batch size of {}.", ["16", "32", "64"], DIFFER),
    ("dropout", "training_config", "The encoder was trained with dropout {}.", "The encoder was trained with dropout {}.", ["0.1", "0.3", "0.5"], DIFFER),
    ("mapping", "mapping", "The label x=1 means {}.", "The label x=1 means {}.", ["accept", "reject", "defer"], DIFFER),
    ("hedge", "hedged", "The planner improves recall on dialogues.", "The planner {} recall on dialogues.", ["improves", "may improve", "could improve"], "b > 0"),
    ("quantifier", "narrower", "The planner improves recall on all dialogues.", "The planner improves recall on {} dialogues.", ["all", "some", "few"], "b > 0"),
    ("lower bound", "numeric_bound", "The drug helps at least {} patients.", "The drug helps {} patients.", ["20", "50", "80"], "b < a"),
    ("hazard ratio", "ratio_effect", "The hazard ratio for death was {} 1.", "The hazard ratio for death was {}.", [("below", "0.70"), ("above", "1.40")], DIFFER),
    ("interval", "interval", "The confidence interval for pain {} zero.", "The pain confidence interval was [{}].", [("includes", "-0.2, 0.4"), ("excludes", "0.1, 0.4")], DIFFER),
    ("unit", "unit", "The audit took 40 {}.", "The audit took 40 {}.", ["patients", "days"], DIFFER),
    ("network", "qualitative", "The dialogue encoder is a {} network.", "The dialogue encoder is a {} network.", ["transformer", "convolutional"], DIFFER),
    ("significance", "qualitative", "The recall gain was significant on wards.", "The recall gain was {} on wards.", ["significant", "not significant"], "b = 1"),
    ("magnitude", "strength", "The wards audit found a {} effect on pain.", "The wards audit found a {} effect on pain.", ["large", "small"], "a = 0 AND b = 1"),
    ("overhead", "strength", "The tagger adds {} overhead to wards.", "The tagger adds {} overhead to wards.", ["no", "small"], "a = 0 AND b = 1"),
    ("unchanged", "outcome", "The drug reduces mortality in wards.", "The drug left wards and mortality in wards was {}.", ["lower", "unchanged"], "b = 1"),
    ("release", "release", "The authors release training code for the tagger.", "The authors {} training code for the tagger.", ["release", "do not release"], "b = 1"),
    ("use of notes", "role", "The tagger was {} on ward notes.", "The tagger was {} on ward notes.", ["trained", "evaluated"], DIFFER),
    ("license", "role", "The dataset is released under a {} license.", "The dataset is released under a {} license.", ["MIT", "non-commercial"], DIFFER),
    ("component", "component", "Reranking improves recall on ward dialogues.", "Recall on ward dialogues {} reranking.", ["improves with", "improves without"], "b = 1"),
    ("contrast", "contrast", "The tagger reads ward notes of nurses.", "The tagger reads lab reports {} ward notes.", ["and", "rather than"], "b = 1"),
    ("adjustment", "clinical", "The {} effect on pain was small.", "The {} effect on pain was small.", ["adjusted", "unadjusted"], DIFFER),
    ("population", "clinical", "The drug lowers pain in {}.", "The drug lowers pain in {}.", ["adults", "children"], DIFFER),
    ("metric value", "measurement", "The tagger reached accuracy of {} on notes.", "The tagger reached accuracy of {} on notes.", ["71", "80", "93"], DIFFER),
    ("strict bound", "bound_tension", "The drug helps more than {} patients.", "The drug helps {} patients.", ["20", "50"], "a = b"),
    ("scope", "scope", "The planner improves recall on all dialogues.", "The planner improves recall on {} dialogues.", ["all", "most", "some"], "b > 0"),
    ("cause", "overstatement", "The drug causes pain relief in wards.", "The drug {} pain relief in wards.", ["causes", "associated with"], "b = 1"),
    ("rank", "overstatement", "The tagger is the best system on notes.", "The tagger is a {} system on notes.", ["best", "competitive"], "b = 1"),
    ("status", "assertion", "The planner improves recall on dialogues.", "{} the planner improves recall on dialogues.", ["Tests say that", "We hypothesize that"], "b = 1"),
    ("mixed", "mixed_outcome", "The drug reduces mortality in wards.", "The drug reduces mortality in wards {}.", ["of hospitals", "but increased mortality in homes"], "b = 1"),
    ("endpoint", "target", "The trial reports the {} of the drug.", "The trial reports the {} of the drug.", ["primary endpoint", "secondary endpoint"], DIFFER),
    ("limit", "context", "The planner improves recall on dialogues.", "The planner improves recall on dialogues {}.", ["of wards", "only when prompted"], "b = 1"),
    ("name", "entity", "{} improves recall on dialogues.", "{} improves recall on dialogues.", ["NetAlpha", "NetBeta", "NetGamma"], DIFFER),
]


def rules() -> dict:
    return {**lenses.CONFLICTS, **lenses.TENSIONS, "entity": lenses.entity, "hedged": lenses.hedged, "narrower": lenses.narrower}


def filled(sentence: str, values: list, side: int, pick: Column) -> Column:
    """The sentence with the value that pick names."""
    slot = F.element_at(F.array(*[F.lit(x if isinstance(x, str) else x[side]) for x in values]), (pick + 1).cast("int"))
    return F.replace(F.lit(sentence), F.lit("{}"), slot)


def pairs(nations: DataFrame) -> DataFrame:
    """(case, rule, n_nationkey, claim, evidence): every case filled from every row."""
    made = []
    for name, rule, claim, evidence, values, _ in CASES:
        a, b = picks(len(values))
        made.append(F.struct(F.lit(name).alias("case"), F.lit(rule).alias("rule"), filled(claim, values, 0, a).alias("claim"), filled(evidence, values, 1, b).alias("evidence")))
    return nations.select("n_nationkey", F.inline(F.array(*made)))


def picks(n: int) -> tuple[Column, Column]:
    return F.col("n_nationkey") % n, F.floor(F.col("n_nationkey") / n) % n


def findings(rows: DataFrame) -> DataFrame:
    """rows of pairs() with fired: whether the row's rule finds anything."""
    c, e = F.col("claim"), F.col("evidence")
    known = rules()
    fired = F.lit(None).cast("boolean")
    for rule in sorted({x[1] for x in CASES}):
        fired = F.when(F.col("rule") == rule, F.size(known[rule](c, e)) > 0).otherwise(fired)
    return rows.withColumn("fired", fired)


def verdicts(rows: DataFrame) -> DataFrame:
    """(case, n_nationkey, label) of the rows of conflict rules whose sentences say the same but for the slot."""
    named = [c for c, rule, claim, evidence, _, when in CASES if rule in lenses.CONFLICTS and claim == evidence and when == DIFFER]
    judged = adjudicate_pairs(rows.where(F.col("case").isin(named)), ["case", "n_nationkey"])
    return judged.select("case", "n_nationkey", F.col("verdict.label").alias("label"))


def _picked(n: int) -> str:
    return f"(SELECT n_nationkey, n_nationkey % {n} AS a, (n_nationkey // {n}) % {n} AS b FROM nation)"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def findings_sql() -> str:
    parts = [f'SELECT {_quoted(name)} AS "case", {_quoted(rule)} AS rule, n_nationkey, ({when}) AS fired FROM {_picked(len(values))}' for name, rule, _, _, values, when in CASES]
    return "\nUNION ALL ".join(parts)


def verdicts_sql() -> str:
    """Equal sentences support each other; a slot of a conflict rule that differs contradicts."""
    conflicts = set(lenses.CONFLICTS)
    parts = [f'SELECT {_quoted(name)} AS "case", n_nationkey, CASE WHEN a <> b THEN \'contradicted\' ELSE \'supported\' END AS label FROM {_picked(len(values))}' for name, rule, claim, evidence, values, when in CASES if rule in conflicts and claim == evidence and when == DIFFER]
    return "\nUNION ALL ".join(parts)
