"""Predicates that a piece of evidence supports a claim beyond shared words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import academic_tokens, coverage, expanded_tokens, has, joined_capitals

# fixed values: cues of the support rules
CAUSAL = r"\b(?:causes?|caused|causal|causally|leads?\s+to|led\s+to|results?\s+in|resulted\s+in|drives?|drove)\b"
DESIGN = r"\b(?:randomi[sz]ed|randomi[sz]ation|randomly\s+assigned|controlled\s+(?:trial|experiment|intervention)|treatment\s+arm|control\s+(?:group|arm))\b"
AFFIRMED = r"\b(?:improves?|improved|increases?|increased|reduces?|reduced|lowers?|lowered|decreases?|decreased|raises?|raised|outperforms?|outperformed)\b"
NEGATED = r"\b(?:does\s+not|did\s+not|failed\s+to|no)\s+(?:improve|increase|reduce|lower|decrease|raise|outperform)\b"
REDUCTION = r"\b(reduce|reduces|reduced|lower|lowers|decrease|decreases)\b"
EFFICIENCY = r"\bsample\s+efficiency\b"
EFFICIENCY_UP = r"\b(improve|improves|improved|increase|increases|increased)\b"
LESS_TIME = r"\b(?:fewer|less|reduced|half\s+as\s+many)\s+(?:training\s+)?(?:hours?|minutes?|seconds?|time)\b|\b(?:reduc(?:e|es|ed|ing)|lowers?|decreas(?:e|es|ed|ing))\s+(?:training\s+)?(?:hours?|minutes?|seconds?|time)\b|\b(?:training\s+)?(?:hours?|minutes?|seconds?|time)\s+(?:were|was\s+)?(?:reduced|lower)\b|\bless\s+wall[- ]clock\s+time\b"
LESS_SAMPLES = r"\b(?:improves?|improved|increases?|increased)\s+sample\s+efficiency\b|\b(?:fewer|less|reduced)\s+(?:(?:environment\s+)?interactions?|(?:training\s+)?samples?|examples?)\b|\b(?:(?:environment\s+)?interactions?|(?:training\s+)?samples?|examples?)\s+(?:were|was\s+)?(?:reduced|lower)\b"
RESOURCE_NEGATION = r"\b(does\s+not|did\s+not|failed\s+to|no\s+reduction|no\s+fewer|no\s+less|without)\b"
TIME_TERM = r"\b(?:training\s+)?(?:hours?|minutes?|seconds?|time)\b|\bwall[- ]clock\b"
SAMPLE_TERM = r"\b(?:environment\s+)?interactions?\b|\b(?:training\s+)?samples?\b|\bexamples?\b"


def stem(words: Column, *stems: str) -> Column:
    """Whether some token begins with each of the stems."""
    return reduce(lambda a, b: a & b, [_begins(words, s) for s in stems])


def _begins(words: Column, start: str) -> Column:
    return F.exists(words, lambda w: w.startswith(start))


def every(words: Column, *wanted: str) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), words)) == 0


def dehyphenated(text: Column) -> Column:
    return F.lower(F.regexp_replace(joined_capitals(text), r"(?U)(?<=\w)-\s+(?=\w)", ""))


def _llm(w: Column, text: Column) -> Column:
    return stem(w, "llm") | text.contains("large language model") | every(w, "language", "models")


def _rules(*met: Column) -> Column:
    return F.filter(F.array(*[F.when(m, F.lit(f"rule {i}")) for i, m in enumerate(met)]), lambda x: x.isNotNull())


def survey_claim(claim: Column) -> Column:
    """The rules for compact related-work claims that a claim meets: on user models, on one named simulator, and on
    simulated against real users."""
    text = dehyphenated(claim)
    c = expanded_tokens(text)
    return _rules(stem(c, "action", "utterance", "predict"), F.array_contains(c, "gentus") & stem(c, "simulat", "task"), _llm(c, text) & stem(c, "simulat", "recommend", "convers"))


def survey_evidence(evidence: Column) -> Column:
    """The rules of survey_claim() that a piece of evidence meets."""
    text = dehyphenated(evidence)
    e = expanded_tokens(text)
    action = stem(e, "action", "utterance", "predict", "generat") & (stem(e, "goal") | stem(e, "dialogue"))
    intro = stem(e, "propos") | stem(e, "call") | stem(e, "introduc") | text.contains("gentus: simulating")
    apart = stem(e, "discrepanc") | stem(e, "deviation") | stem(e, "distortion")
    differ = F.when(apart, text.contains("real users") | text.contains("human behavior")).otherwise(text.contains("differ from real users"))
    return _rules(action, F.array_contains(e, "gentus") & stem(e, "simulat", "task", "oriented") & intro, _llm(e, text) & stem(e, "simulat", "recommend", "convers") & differ)


def survey_support(claim: Column, evidence: Column) -> Column:
    """Whether both meet one of the rules; the evidence is looked at only if the claim meets any."""
    return F.when(F.size(survey_claim(claim)) > 0, F.arrays_overlap(survey_claim(claim), survey_evidence(evidence))).otherwise(F.lit(False))


def metric_support(claim: Column, evidence: Column) -> Column:
    """Claims that define or judge well-known evaluation metrics."""
    c, e, text = expanded_tokens(claim), expanded_tokens(evidence), F.lower(joined_capitals(evidence))
    weak = every(c, "word", "overlap", "metrics", "correlate", "human", "dialogue") & every(e, "word", "overlap", "metrics", "human", "dialogue") & (text.contains("weak") | text.contains("small positive correlation"))
    bert = every(c, "bertscore") & every(e, "bertscore", "contextual") & stem(e, "embedding") & F.arrays_overlap(e, F.array(*map(F.lit, ["semantic", "surface", "exact", "matching"])))
    robust = text.contains("robust") | text.contains("distribution drift") | text.contains("out-of-domain")
    return weak | bert | (every(c, "bleurt") & every(e, "bleurt", "learned", "metric") & robust)


def causal_support(claim: Column, evidence: Column, covered: Column) -> Column:
    return (covered >= 0.5) & has(claim, CAUSAL) & has(evidence, DESIGN) & has(evidence, AFFIRMED) & ~has(evidence, NEGATED)


def claims_time(claim: Column) -> Column:
    low = F.lower(claim)
    return low.contains("training") & low.contains("time") & has(claim, REDUCTION)


def claims_samples(claim: Column) -> Column:
    return has(claim, EFFICIENCY) & (has(claim, EFFICIENCY_UP) | has(claim, REDUCTION))


def claims_resource(claim: Column) -> Column:
    return claims_time(claim) | claims_samples(claim)


def near(text: Column, left: str, right: str, gap: int) -> Column:
    """Whether a match of each begins within gap characters of the other, in either order.

    Java looks ahead from each start, so starts are compared, not ends."""
    within = lambda a, b: has(text, rf"(?s)(?=(?:{a})).{{0,{gap}}}?(?=(?:{b}))")
    return within(left, right) | within(right, left)


def resource_support(claim: Column, evidence: Column, covered: Column) -> Column:
    """Less time or fewer samples, said without a negation near the resource."""
    affirmed = lambda cue, term: has(evidence, cue) & ~near(evidence, RESOURCE_NEGATION, term, 80)
    return (covered >= 0.35) & F.when(claims_time(claim), affirmed(LESS_TIME, TIME_TERM)).when(claims_samples(claim), affirmed(LESS_SAMPLES, SAMPLE_TERM)).otherwise(F.lit(False))


def semantic_support(claim: Column, evidence: Column, covered: Column) -> Column:
    """Any support rule. A claim of resource reduction needs the rule for it."""
    academic = coverage(academic_tokens(claim), academic_tokens(evidence))
    c, e = F.lower(claim), F.lower(evidence)
    languages = c.contains("languages") & e.contains("languages") & (c.contains("spans") | c.contains("covers")) & (e.contains("covers") | e.contains("spans")) & (e.contains("multiple") | e.contains("diverse")) & (covered >= 0.35)
    other = causal_support(claim, evidence, covered) | metric_support(claim, evidence) | survey_support(claim, evidence) | ((covered >= 0.4) & (academic >= 0.68)) | ((covered >= 0.3) & (academic >= 0.75)) | languages
    return resource_support(claim, evidence, covered) | (~claims_resource(claim) & other)
