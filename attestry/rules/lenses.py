"""Rules that find conflicts and tensions between a claim and its evidence.

A rule is a Column of findings (array<string>) over the two texts. Rules of controlled vocabularies are compiled from
tables; rules of slots pair values of both sides with higher-order functions, so a pair of texts is one row throughout."""

from __future__ import annotations

from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import academic_tokens, coverage, expanded_tokens, found, has, joined_capitals, masked, overlap, squeeze, strip, tokens
from . import vocabulary as v
from .quantities import before, bound, quantities

NONE = "array<string>"


#: Columns that hold what several rules use, while a thread's inspect() builds them: (what, texts) -> Column.
_held: ContextVar[dict[tuple[str, ...], Column] | None] = ContextVar("held", default=None)


def held(what: str, build, *texts: Column) -> Column:
    """The column that holds build(*texts), or the expression itself where none does."""
    known = _held.get()
    key = (what, *map(str, texts)) if known else None
    return known[key] if known and key in known else build(*texts)


class Recipe:
    """Steps of columns that are built once and taken on any frame that has the texts' columns.

    A rule is hundreds of expressions, and each is a call into the JVM: building them costs more than planning them."""

    def __init__(self):
        self.steps: list[tuple[str, tuple]] = []

    def withColumns(self, columns: dict[str, Column]) -> Recipe:  # noqa: N802  as a frame has it
        self.steps.append(("withColumns", (columns,)))
        return self

    def withColumn(self, name: str, column: Column) -> Recipe:  # noqa: N802
        return self.withColumns({name: column})

    def drop(self, *names: str) -> Recipe:
        self.steps.append(("drop", names))
        return self

    def on(self, df: DataFrame) -> DataFrame:
        for step, args in self.steps:
            df = getattr(df, step)(*args)
        return df


def session_key() -> str:
    """Names the application whose JVM built columns belong to."""
    from pyspark import SparkContext

    return SparkContext.getOrCreate().applicationId


def none() -> Column:
    return F.array().cast(NONE)


def say(condition: Column, *message) -> Column:
    """One finding if the condition holds."""
    parts = [F.lit(m) if isinstance(m, str) else m for m in message]
    return F.when(condition, F.array(F.concat(*parts))).otherwise(none())


def together(*findings: Column) -> Column:
    return F.array_distinct(F.concat(*findings))


def pairs(claims: Column, evidences: Column, conflict, message) -> Column:
    """A finding for each pair of values in conflict."""
    return F.flatten(F.transform(claims, lambda c: F.transform(F.filter(evidences, lambda e: conflict(c, e)), lambda e: message(c, e))))


def words(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def masked_words(text: Column, mask: str) -> Column:
    return words(masked(text, mask))


def gate(c: Column, e: Column, mask: str, threshold: float, drop: Column | None = None) -> Column:
    a, b = masked_words(c, mask), masked_words(e, mask)
    if drop is not None:
        a, b = F.array_except(a, drop), F.array_except(b, drop)
    return overlap(a, b) >= threshold


# -- controlled vocabularies ----------------------------------------------------


def mentioned(text: Column, group: str, values: dict[str, list[str]]) -> Column:
    """The values of a group that a text names, sorted; some values drop others."""
    flags = {value: reduce(lambda a, b: a | b, [has(text, p) for p in patterns]) for value, patterns in values.items()}
    for name, wins, drops, pattern in v.OVERRIDES:
        if name == group:
            flags[drops] = flags[drops] & ~(flags[wins] & has(text, pattern) if pattern else flags[wins])
    named = [F.when(flags[value], F.lit(value)) for value in sorted(values)]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def disjoint(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def vocabulary_rule(c: Column, e: Column, groups: dict, open_gate: Column, template: str) -> Column:
    """template: with {group}; every value of the claim meets every value of the evidence."""
    out = []
    for group, values in groups.items():
        a, b = mentioned(c, group, values), mentioned(e, group, values)
        head = template.format(group=group)
        said = pairs(a, b, lambda x, y: F.lit(True), lambda x, y, head=head: F.concat(F.lit(head), x, F.lit(" while evidence says "), y, F.lit(".")))
        out.append(F.when(open_gate & disjoint(a, b), said).otherwise(none()))
    return together(*out)


def attribute_gate(c, e):
    return gate(c, e, v.ATTRIBUTE_MASK, 0.67)


def attribute(c, e):
    return vocabulary_rule(c, e, v.ATTRIBUTES, held("attribute_gate", attribute_gate, c, e), "{group} conflict: claim says ")


def technical_gate(c, e):
    subjects = lambda t: F.filter(words(t), lambda w: w.isin(v.SUBJECTS))
    side = lambda t: F.array_union(masked_words(t, v.TECHNICAL_MASK), subjects(t))
    return (overlap(side(c), side(e)) >= 0.67) | (F.size(F.array_intersect(subjects(c), subjects(e))) >= 2)


def technical(c, e):
    return vocabulary_rule(c, e, v.TECHNICAL, held("technical_gate", technical_gate, c, e), "{group} conflict: claim says ")


def statistical_gate(c, e):
    def side(t):
        terms = F.regexp_extract_all(F.lower(masked(t, v.STATISTICS_MASK)), F.lit("[a-z0-9]+"), F.lit(0))
        return F.array_distinct(F.filter(terms, lambda w: ~w.isin(v.STATISTICS_STOPWORDS) & ~w.rlike("^[0-9]+$")))

    return overlap(side(c), side(e)) >= 0.67


def statistical(c, e):
    return vocabulary_rule(c, e, v.STATISTICS, held("statistical_gate", statistical_gate, c, e), "{group} conflict: claim says ")


def protocol_gate(c, e):
    return gate(c, e, v.PROTOCOL_MASK, 0.5)


def protocol(c, e):
    return vocabulary_rule(c, e, v.PROTOCOLS, held("protocol_gate", protocol_gate, c, e), "Protocol conflict: {group} claim says ")


def release(c, e):
    return say(has(c, v.RELEASED) & has(e, v.NOT_RELEASED) & held("protocol_gate", protocol_gate, c, e), "Release conflict: claim says training code is released while evidence says it is not released.")


def target(c, e):
    return vocabulary_rule(c, e, v.TARGETS, held("protocol_gate", protocol_gate, c, e), "Measurement target tension: {group} claim says ")


# -- quality words ----------------------------------------------------------------


def quality_gate(c, e):
    return gate(c, e, v.QUALITY_MASK, 0.67)


def objects(text: Column, pattern: str, stop: str, group: int = 1) -> Column:
    """What a pattern's object group names, up to the first stop word."""
    raw = found(text, pattern, group)
    return F.transform(raw, lambda x: F.btrim(F.regexp_replace(x, "(?is)" + stop + ".*$", ""), F.lit(" .,:;()[]{}")))


def requirement(c, e):
    no = objects(c, r"\brequires?\s+no\s+" + v.OBJECT, v.REQUIRED_STOP)
    yes = lambda t: objects(t, r"\brequires?\s+(?!no\b)" + v.OBJECT, v.REQUIRED_STOP)
    not_needed = objects(e, r"\b([A-Za-z0-9][A-Za-z0-9 .-]{1,60}?)\s+(?:is|are|was|were)\s+not\s+necessary\b", v.REQUIRED_STOP)
    clash = lambda x, y: (overlap(words(x), words(y)) >= 0.67) & gate(c, e, v.QUALITY_MASK, 0.67, F.array_union(words(x), words(y)))
    first = pairs(no, yes(e), clash, lambda x, y: F.concat(F.lit("Requirement conflict: claim says no "), x, F.lit(" but evidence requires it.")))
    second = pairs(yes(c), not_needed, clash, lambda x, y: F.concat(F.lit("Requirement conflict: claim requires "), x, F.lit(" but evidence says it is not necessary.")))
    return F.slice(F.concat(first, second), 1, 1)


def qualitative(c, e):
    same = held("quality_gate", quality_gate, c, e)
    academic = held("academic", lambda x, y: coverage(academic_tokens(x), academic_tokens(y)), c, e)
    named = lambda t, w: has(t, rf"\b{w}\b")
    described = [say(named(c, a) & named(e, b) & same, f"Descriptor conflict: claim says {a} while evidence says {b}.") for x, y in v.DESCRIPTORS for a, b in ((x, y), (y, x))]
    return F.concat(
        say(has(c, r"\bonly\b") & has(e, r"\b(one\s+of|among|several|multiple|both)\b") & same, "Exclusivity conflict: evidence describes one of multiple cases."),
        say(has(c, r"\b(significant|significantly)\b") & ~has(c, v.NOT_SIGNIFICANT) & has(e, v.NOT_SIGNIFICANT) & same, "Significance conflict: evidence says the result is not statistically significant."),
        say(has(c, v.SOTA) & ~has(c, v.NOT_SOTA) & has(e, v.NOT_SOTA) & same, "State-of-the-art conflict: evidence negates the claim."),
        say(has(c, r"\bgood\s+indicator\b") & ~has(c, v.NOT_INDICATOR) & has(e, v.NOT_INDICATOR) & (academic >= 0.5), "Negation conflict: evidence says the measure is not a good indicator."),
        say(has(c, r"\b(?:tractable|tractably)\b") & has(e, v.INTRACTABLE) & (academic >= 0.45), "Negation conflict: evidence says the claimed tractable problem is intractable."),
        say(has(c, r"\b(?:sufficient|guaranteed)\b") & has(e, v.INSUFFICIENT) & (academic >= 0.4), "Negation conflict: evidence negates the claimed sufficiency or guarantee."),
        requirement(c, e),
        F.slice(F.concat(*described), 1, 1),
    )


def scope(c, e):
    return say(has(c, r"\b(all|every|universally)\b") & has(e, r"\b(most|many|some|subset|not\s+all|majority)\b") & held("quality_gate", quality_gate, c, e), "Scope tension: evidence is narrower than the universal claim.")


# -- outcomes -----------------------------------------------------------------------


def _named(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [has(text, p) for p in patterns])


def _around(text: Column, patterns: list[str], cue: str, n: int = 72) -> Column:
    """Whether the cue lies within n characters of one of the patterns."""
    return reduce(lambda a, b: a | b, [F.exists(found(text, rf"(?s).{{0,{n}}}{p}.{{0,{n}}}"), lambda w: has(w, cue)) for p in patterns])


def _unchanged(text: Column, patterns: list[str]) -> Column:
    change = r"(?:improvement|reduction|change|difference)"
    out = F.lit(False)
    for p in patterns:
        out = out | has(text, rf"(?:{p}).{{0,40}}\b(?:is|was|were|shows?|showed|remains?|remained)?\s*(?:unchanged|no\s+change|no\s+difference)\b")
        out = out | has(text, rf"\bno\s+(?:statistically\s+significant\s+)?{change}\s+(?:in|for)\s+(?:{p})")
        out = out | has(text, rf"\bno\s+(?:{p})\s+{change}\b") | has(text, rf"\b(?:does|did)\s+not\s+(?:improve|reduce|decrease)\s+(?:{p})")
    return out


def outcome_gate(c, e):
    return gate(c, e, v.OUTCOME_MASK, 0.5)


def outcome(c, e):
    out = []
    for name, patterns in sorted(v.OUTCOMES.items()):
        both = _named(c, patterns) & _named(e, patterns)
        out.append(say(both & _unchanged(e, patterns), f"Outcome status conflict: claim asserts a result for {name} while evidence says it is unchanged."))
        if name in v.LOWER_IS_BETTER:
            out.append(say(both & _around(e, patterns, v.HIGHER), f"Lower-is-better outcome conflict: evidence reports higher {name} against an improvement claim."))
    return F.when(has(c, v.OUTCOME_RESULT) & held("outcome_gate", outcome_gate, c, e), F.concat(*out)).otherwise(none())


def mixed_outcome(c, e):
    out = [say(_named(c, p) & _named(e, p) & _around(e, p, v.IMPROVE) & _around(e, p, v.WORSEN), f"Mixed outcome effect: evidence supports {name} in one setting but reports the opposite in another.") for name, p in sorted(v.OUTCOMES.items())]
    return F.when(has(c, v.OUTCOME_RESULT) & has(e, v.MIXED) & held("outcome_gate", outcome_gate, c, e), F.concat(*out)).otherwise(none())


# -- roles and provenance -----------------------------------------------------------


def normal(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def role(c, e):
    pattern = r"\b(?:was|were|is|are|been|be)?\s*(trained|training|pretrained|fine[- ]tuned|evaluated|tested)\s+on\s+" + v.LONG_OBJECT
    name = lambda x: F.when(x == "training", "trained").when(x == "tested", "evaluated").otherwise(x)
    bindings = lambda t: F.arrays_zip(F.transform(found(t, pattern, 1), lambda x: name(F.translate(F.lower(x), "-", " "))).alias("role"), objects(t, pattern, v.ROLE_STOP, 2).alias("object"))
    training = lambda r: r.isin("trained", "pretrained", "fine tuned")
    swapped = pairs(bindings(c), bindings(e), lambda x, y: (training(x["role"]) != training(y["role"])) & F.arrays_overlap(words(x["object"]), words(y["object"])), lambda x, y: F.concat(F.lit("Role conflict: claim assigns data to "), x["role"], F.lit(" while evidence assigns it to "), y["role"], F.lit(".")))
    made = r"\b([A-Z][A-Za-z0-9.-]*(?:\s+[A-Z][A-Za-z0-9.-]*)?|Human annotators?)\s+(?:generated|annotated)\s+" + v.LONG_OBJECT
    audit = r"\b([A-Z][A-Za-z0-9.-]*(?:\s+[A-Z][A-Za-z0-9.-]*)?)\s+(?:was|were)?\s*(?:used\s+to\s+)?(?:audit|audited|review|reviewed|evaluate|evaluated)\b"
    makers = F.arrays_zip(found(c, made, 1).alias("actor"), objects(c, made, v.ROLE_STOP, 2).alias("object"))
    auditors = F.transform(found(e, audit, 1), normal)
    audited = F.exists(makers, lambda m: F.exists(objects(e, made, v.ROLE_STOP, 2), lambda o: F.arrays_overlap(words(m["object"]), words(o))) & F.array_contains(auditors, normal(m["actor"])))
    filters = r"\bfilters?\s+(toxic\s+prompts|prompts|outputs?)\s+(before|after)\s+evaluation\b"
    one = lambda t, p, g=1: F.regexp_extract(t, "(?iU)" + p, g)
    staged = has(c, filters) & has(e, filters) & ((normal(one(c, filters)) != normal(one(e, filters))) | (F.lower(one(c, filters, 2)) != F.lower(one(e, filters, 2))))
    licensed = r"\bdataset\s+(?:is\s+)?(?:released|available)\s+under\s+(?:a\s+|an\s+)?(permissive\s+mit|mit|non[- ]commercial)\s+license\b"
    labels = r"\blearns?\s+from\s+(gold\s+human\s+labels|pseudo[- ]labels?)\b"
    passages = r"\b(?:retrieves?\s+passages\s+from|passages\s+retrieved\s+from)\s+([A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*)?)\b"
    plain = lambda x: F.translate(F.lower(x), "-", " ")
    differ = lambda p, f: has(c, p) & has(e, p) & (f(one(c, p)) != f(one(e, p)))
    return together(
        swapped,
        say(audited, "Role conflict: claim says an actor generated the artifact while evidence assigns that actor an audit role."),
        say(staged, "Role conflict: claim and evidence assign filtering to different objects or evaluation stages."),
        say(differ(licensed, lambda x: F.when(plain(x).contains("mit"), "mit").otherwise(plain(x))), "Role conflict: claim and evidence assign different licenses to the dataset."),
        say(differ(labels, lambda x: F.when(plain(x).startswith("pseudo"), "pseudo labels").otherwise(plain(x))), "Role conflict: claim and evidence assign different learning label sources."),
        say(differ(passages, normal), "Role conflict: claim and evidence assign different retrieval sources."),
    )


# -- context, components and contrast -----------------------------------------------


def context_gate(c, e, drop: Column | None = None):
    a, b = (academic_tokens(masked(t, v.CONTEXT_MASK)) for t in (c, e))
    if drop is not None:
        a, b = F.array_except(a, drop), F.array_except(b, drop)
    return 3 * F.size(F.array_intersect(a, b)) >= 2 * F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def component_excluded(c, e):
    excluded = lambda t, x: has(t, rf"\bno[- ]{x}\b|\bwithout\s+{x}\b|\b{x}\s+(?:removed|excluded|disabled|ablated)\b")
    credited = lambda x: has(c, rf"\b{x}\s+(?:improves?|improved|reduces?|reduced|increases?|increased|outperforms?)\b")
    any_of = reduce(lambda a, b: a | b, [credited(x) & ~excluded(c, x) & excluded(e, x) & context_gate(c, e, F.array(F.lit(x))) for x in v.COMPONENTS])
    return say(any_of, "Component exclusion conflict: evidence excludes the component credited by the claim.")


def context_limits(c, e):
    left_out = F.filter(objects(c, r"\b(?:excludes?|without|no)\s+([A-Za-z0-9][A-Za-z0-9 -]{2,60})", v.COMPONENT_STOP), lambda x: x != "")
    included = has(e, r"\b(combines?|includes?|uses?|with)\b") & F.exists(left_out, lambda x: (F.size(words(x)) > 0) & (coverage(words(x), words(e)) >= 0.67) & context_gate(c, e, words(x)))
    results = has(c, v.CONTEXT_RESULT) & has(e, v.CONTEXT_RESULT)
    limited = reduce(lambda a, b: a | b, [has(e, p) & ~has(c, p) for p in v.LIMITERS]) | (has(e, v.SIMULATION) & has(e, v.NOT_EVALUATED) & ~has(c, v.SIMULATION))
    other = (has(c, v.HUMAN) & (has(e, v.ANIMAL) | has(e, v.LIMITERS[4]))) | (has(c, r"\badults?\b") & has(e, v.CHILD)) | (has(c, v.HARDWARE) & has(e, v.SIMULATION)) | (has(e, v.SIMULATION) & has(e, v.HARDWARE) & ~has(c, v.HARDWARE))
    inclusion = say(included, "Component inclusion tension: evidence includes a component excluded by the claim.")
    narrower = say(limited, "Context limitation: evidence supports a narrower setting than the claim.")
    elsewhere = say(other, "Context limitation: evidence is from a different population or setting.")
    return F.when(~results, inclusion).when(context_gate(c, e), F.concat(inclusion, narrower, elsewhere)).otherwise(none())


def contrast(c, e):
    phrases = found(e, v.CONTRAST + r"\s+([^.;:,]+)", 1)
    cues = F.array(*map(F.lit, ["rather", "than", "instead", "opposed"]))
    excluded = lambda p: (F.size(words(p)) >= 2) & (coverage(words(p), words(c)) >= 0.67) & (overlap(F.array_except(words(c), words(p)), F.array_except(F.array_except(words(e), words(p)), cues)) >= 0.5)
    return say(~has(c, v.CONTRAST) & F.exists(phrases, excluded), "Contrast exclusion conflict: evidence explicitly excludes a phrase asserted by the claim.")


# -- strength and status --------------------------------------------------------------


def local(text: Column, pattern: str, left: int, right: int, ends: str) -> Column:
    """(value, window, after): each place where pattern begins a word, with the words around it up to the ends of its part.

    Parts are what lies between matches of ends, so a phrase across such an end isn't found."""
    word = "[A-Za-z0-9][A-Za-z0-9-]*"

    def of(part):
        ws = F.regexp_extract_all(part, F.lit(word), F.lit(0))
        rest = lambda i: F.array_join(F.slice(ws, i + 1, F.size(ws)), " ")
        at = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: rest(i).rlike(rf"(?iU)^(?:{pattern})\b"))
        at = F.when(F.size(ws) > 0, at).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(
            F.lower(F.regexp_extract(rest(i), rf"(?iU)^({pattern})\b", 0)).alias("value"),
            F.array_join(F.slice(ws, F.greatest(i - left, F.lit(0)) + 1, F.least(i, F.lit(left)) + right + 1), " ").alias("window"),
            F.regexp_replace(rest(i), rf"(?iU)^(?:{pattern})\b", "").alias("after"),
        ))

    return F.flatten(F.transform(F.split(text, ends), of))


def strength_places(text: Column, pattern: str) -> Column:
    return local(text, pattern, 5, 5, v.CLAUSE_END)


def near_words(window: Column) -> Column:
    return masked_words(F.regexp_replace(window, r"(?i)\bnon[- ]?zero\b", " "), v.STRENGTH_MASK)


def alike(x: Column, y: Column) -> Column:
    return overlap(near_words(x["window"]), near_words(y["window"])) >= 0.67


def strength(c, e):
    strong, weak = r"(?:large|substantial)" + v.MAGNITUDE, r"(?:small|modest)" + v.MAGNITUDE
    first = lambda x: F.regexp_extract(x["value"], r"^\S+", 0)
    claims, strong_e, weak_e = strength_places(c, strong), strength_places(e, strong), strength_places(e, weak)
    bold = F.filter(claims, lambda x: ~F.exists(strong_e, lambda y: alike(x, y)))
    size = pairs(bold, weak_e, alike, lambda x, y: F.concat(F.lit("Magnitude conflict: claim says "), first(x), F.lit(" while evidence says "), first(y), F.lit(".")))
    dimension = lambda x: words(F.regexp_replace(x["value"], r"(?i)^(?:no|small|some|non[- ]?zero)\b|\boverheads?$", " "))
    fits = lambda x, y: (F.size(dimension(x)) == 0) | (F.size(dimension(y)) == 0) | F.arrays_overlap(dimension(x), dimension(y))
    cost = pairs(strength_places(c, v.NO_OVERHEAD), strength_places(e, v.SOME_OVERHEAD), lambda x, y: fits(x, y) & alike(x, y), lambda x, y: F.concat(F.lit("Overhead conflict: claim says no overhead while evidence says "), first(y), F.lit(" overhead.")))
    return together(size, cost)


def overstatement(c, e):
    some = lambda a, b, more=None: F.exists(strength_places(c, a), lambda x: F.exists(strength_places(e, b), lambda y: alike(x, y) & (more(x, y) if more else F.lit(True))))
    following = lambda x: F.coalesce(F.get(tokens(x["after"]), F.lit(0)), F.lit(""))
    same_target = lambda x, y: (following(x) == "") | (following(y) == "") | (following(x) == following(y))
    recovered = lambda x, y: has(x["window"], v.RECOVERY) & has(y["window"], v.RECOVERY)
    return F.concat(
        say(some(v.CAUSAL, v.ASSOCIATION), "Causal overstatement tension: claim asserts causality while evidence is weaker."),
        say(some(v.TOP_RANK, v.GOOD_RANK, same_target), "Ranking overstatement tension: claim asserts top rank while evidence is weaker."),
        say(some(v.COMPLETE, v.PARTIAL, recovered), "Completeness overstatement tension: claim asserts full recovery while evidence is partial."),
    )


def assertion(c, e):
    planned = local(e, v.PLANNED, 6, 8, "[.!?]")
    weak = lambda x: ~has(x["window"], v.CONFIRMED) & has(x["window"], v.ASSERTED) & (overlap(masked_words(c, v.ASSERTION_MASK), masked_words(x["window"], v.ASSERTION_MASK)) >= 0.67)
    return say(has(c, v.ASSERTED) & F.exists(planned, weak), "Assertion status tension: evidence frames the claimed result as future, hypothetical, or intended rather than established.")


# -- negation and direction -------------------------------------------------------------


def object_words(text: Column) -> Column:
    return F.array_distinct(F.transform(tokens(text), lambda w: F.when(w == "labels", "label").when(w.isin("modeling", "modelling", "models"), "model").otherwise(w)))


USE = r"\b(?:uses?|used|using)\s+" + v.LONG_OBJECT
DEPEND = r"\b(?:requires?|depends?\s+on|relies?\s+on|applies?)\s+" + v.LONG_OBJECT
TRAIN = r"\b(?:trains?|training)\s+" + v.LONG_OBJECT
TUNED = r"\b(trained|pretrained|fine[- ]tuned)\s+on\s+" + v.LONG_OBJECT
DENIALS = [
    r"\b(?:does\s+not|did\s+not|not)\s+use\s+" + v.LONG_OBJECT,
    r"\b(?:was\s+not|were\s+not|not)\s+(?:trained|pretrained|fine[- ]tuned)\s+on\s+" + v.LONG_OBJECT,
    r"\bwithout\s+" + v.LONG_OBJECT,
    r"\b(?:avoids?|avoid(?:ing)?|eliminates?|no|not\s+necessary)\s+" + v.LONG_OBJECT,
    r"\b([A-Za-z0-9][A-Za-z0-9 .-]{1,80}?)\s+(?:is|are|was|were)\s+not\s+necessary\b",
]


def same_object(a: Column, b: Column) -> Column:
    return overlap(object_words(a), object_words(b)) >= 0.67


def denied(text: Column, pattern: str) -> Column:
    """Objects that a pattern denies, unless the text affirms their use further on."""

    def thing(m):
        return F.btrim(F.regexp_replace(F.regexp_extract(m, "(?iU)" + pattern, 1), "(?is)" + v.NEGATION_STOP + ".*$", ""), F.lit(" .,:;()[]{}"))

    def open_denial(m):
        at = F.length(F.call_function("substring_index", text, m, F.lit(1))) + F.length(m) + 1
        tail = F.substring(text, at, F.lit(1 << 30))
        affirmed = has(F.substring(tail, 1, 120), r"\bbut\s+uses?\b") | F.exists(objects(tail, USE, v.NEGATION_STOP), lambda o: same_object(thing(m), o))
        return ~affirmed & (thing(m) != "")

    return F.transform(F.filter(found(text, pattern), open_denial), thing)


def negation(c, e):
    def kind(name, pattern):
        return F.transform(objects(c, pattern, v.NEGATION_STOP), lambda o: F.struct(F.lit(name).alias("kind"), o.alias("object")))

    tuned = F.zip_with(found(c, TUNED, 1), objects(c, TUNED, v.NEGATION_STOP, 2), lambda k, o: F.struct(F.translate(F.lower(k), "-", " ").alias("kind"), o.alias("object")))
    named = F.concat(kind("use", USE), kind("dependency", DEPEND), kind("training", TRAIN), tuned)
    gone = F.concat(*[denied(e, p) for p in DENIALS])
    hit = F.filter(named, lambda x: (x["object"] != "") & F.exists(gone, lambda d: same_object(x["object"], d)))
    return F.transform(hit, lambda x: F.concat(F.lit("Negation conflict: evidence negates "), x["kind"], F.lit(" of "), x["object"]))


def direction(c, e):
    way = lambda t: F.when(has(t, v.UP) & ~has(t, v.DOWN), "increased").when(has(t, v.DOWN) & ~has(t, v.UP), "decreased")
    rest = lambda t: words(F.aggregate(held("quantities", quantities, t), masked(masked(t, v.UP), v.DOWN), lambda s, q: F.replace(s, q["text"], F.lit(" "))))
    return say((way(c) != way(e)) & (overlap(rest(c), rest(e)) >= 0.5), "Direction conflict: claim says ", way(c), " while evidence says ", way(e))


# -- numbers ----------------------------------------------------------------------------


def compatible(c, e, x, y) -> Column:
    """One quantity on each side: the evidence's exact number lies within the claim's bound."""
    bc, be = bound(before(c, x["text"])), bound(before(e, y["text"]))
    return (be == "exact") & (((bc == "lower") & (y["number"] >= x["number"])) | ((bc == "upper") & (y["number"] <= x["number"])))


def numeric(c, e):
    qc, qe = held("quantities", quantities, c), held("quantities", quantities, e)
    units = F.array_distinct(F.transform(qc, lambda q: q["unit"]))
    of = lambda qs, u: F.filter(qs, lambda q: q["unit"] == u)
    numbers = lambda qs: F.transform(qs, lambda q: q["number"])
    said = lambda qs: F.array_join(F.transform(qs, lambda q: q["text"]), ", ")

    def clash(u):
        a, b = of(qc, u), of(qe, u)
        fits = F.when((F.size(a) == 1) & (F.size(b) == 1), compatible(c, e, F.get(a, F.lit(0)), F.get(b, F.lit(0)))).otherwise(F.lit(False))
        return (F.size(b) > 0) & (F.size(F.array_except(numbers(a), numbers(b))) > 0) & ~fits

    return F.transform(F.filter(units, clash), lambda u: F.concat(F.lit("Numeric conflict for "), u, F.lit(": claim "), said(of(qc, u)), F.lit(" vs evidence "), said(of(qe, u))))


def plain_number(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def unit(c, e):
    qc, qe = held("quantities", quantities, c), held("quantities", quantities, e)
    numbers = F.array_distinct(F.transform(qc, lambda q: q["number"]))
    units = lambda qs, n: F.array_sort(F.array_distinct(F.transform(F.filter(qs, lambda q: q["number"] == n), lambda q: q["unit"])))
    exempt = F.array(*map(F.lit, v.EXEMPT_UNITS))
    clash = lambda n: disjoint(units(qc, n), units(qe, n)) & (F.size(F.array_except(F.array_union(units(qc, n), units(qe, n)), exempt)) > 0)
    listed = lambda us: F.concat(F.lit("['"), F.array_join(us, "', '"), F.lit("']"))
    return F.transform(F.filter(numbers, clash), lambda n: F.concat(F.lit("Unit conflict for "), plain_number(n), F.lit(": claim "), listed(units(qc, n)), F.lit(" vs evidence "), listed(units(qe, n))))


def year(c, e):
    years = lambda t: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(v.YEAR), F.lit(0))))
    listed = lambda ys: F.concat(F.lit("['"), F.array_join(ys, "', '"), F.lit("']"))
    return say((F.size(years(c)) > 0) & (F.size(years(e)) > 0) & (years(c) != years(e)), "Year conflict: claim ", listed(years(c)), " vs evidence ", listed(years(e)))


def bounds(text: Column) -> Column:
    """Quantities with their bound, whether it is strict, and the words around, the bound's own words aside."""

    def of(q):
        head = before(text, q["text"])
        rest = masked(F.replace(text, q["text"], F.lit(" ")), v.BOUND_MASK)
        letters = F.transform(F.regexp_extract_all(rest, F.lit(r"\b[A-Z]\b"), F.lit(0)), F.lower)
        kind = bound(head)
        strict = ((kind == "lower") & has(head, v.STRICT_LOWER)) | ((kind == "upper") & has(head, v.STRICT_UPPER))
        return F.struct(q["number"].alias("number"), q["unit"].alias("unit"), q["text"].alias("text"), kind.alias("kind"), strict.alias("strict"), F.array_union(words(rest), letters).alias("words"))

    return F.transform(held("quantities", quantities, text), of)


def _bound_rule(c, e, head: str, test) -> Column:
    near = lambda x, y: (x["unit"] == y["unit"]) & (overlap(x["words"], y["words"]) >= 0.75)
    return pairs(held("bounds", bounds, c), held("bounds", bounds, e), lambda x, y: near(x, y) & test(x, y), lambda x, y: F.concat(F.lit(head + " for "), x["unit"], F.lit(": claim "), x["text"], F.lit(" vs evidence "), y["text"]))


def bound_conflict(c, e):
    def empty(low, high):
        return (low["number"] > high["number"]) | ((low["number"] == high["number"]) & (low["strict"] | high["strict"]))

    def test(x, y):
        k, m = x["kind"], y["kind"]
        a, b = x["number"], y["number"]
        return (
            F.when((k == "lower") & (m == "upper"), empty(x, y)).when((k == "upper") & (m == "lower"), empty(y, x))
            .when((k == "lower") & (m == "exact"), b < a).when((k == "upper") & (m == "exact"), b > a)
            .when((k == "exact") & (m == "lower"), a < b).when((k == "exact") & (m == "upper"), a > b).otherwise(F.lit(False))
        )

    return _bound_rule(c, e, "Numeric bound conflict", test)


def bound_tension(c, e):
    return _bound_rule(c, e, "Numeric bound tension", lambda x, y: (x["number"] == y["number"]) & ((x["strict"] & (y["kind"] == "exact")) | (y["strict"] & (x["kind"] == "exact"))))


def _number(x: Column) -> Column:
    return x.cast("decimal(38,18)")


def p_values(text: Column) -> Column:
    part = lambda m, g: F.regexp_extract(m, "(?i)" + v.P_VALUE, g)
    relations = F.create_map(*[F.lit(x) for kv in v.P_RELATIONS.items() for x in kv])
    word = lambda m: squeeze(F.lower(F.concat(part(m, 1), part(m, 2))))
    row = lambda r, n, t: F.struct(r.alias("rel"), n.alias("number"), t.alias("text"))
    explicit = F.transform(F.regexp_extract_all(text, F.lit("(?i)" + v.P_VALUE), F.lit(0)), lambda m: row(F.coalesce(F.try_element_at(relations, word(m)), F.lit("eq")), _number(part(m, 3)), m))
    implied = lambda r, t: F.array(row(F.lit(r), _number(F.lit("0.05")), F.lit(t)))
    return F.when(F.size(explicit) > 0, explicit).when(has(text, r"\bnot\s+statistically\s+significant\b"), implied("ge", "not statistically significant")).when(has(text, r"\bstatistically\s+significant\b"), implied("lt", "statistically significant")).otherwise(explicit)


def p_value(c, e):
    def within(n, x):
        b = x["number"]
        return F.when(x["rel"] == "lt", n < b).when(x["rel"] == "le", n <= b).when(x["rel"] == "gt", n > b).when(x["rel"] == "ge", n >= b).otherwise(n == b)

    def clash(x, y):
        up = lambda r: r.isin("lt", "le")
        down = lambda r: r.isin("gt", "ge")
        apart = (up(x["rel"]) & down(y["rel"]) & (y["number"] >= x["number"])) | (down(x["rel"]) & up(y["rel"]) & (y["number"] <= x["number"]))
        return F.when(y["rel"] == "eq", ~within(y["number"], x)).when(x["rel"] == "eq", ~within(x["number"], y)).otherwise(apart)

    said = pairs(held("p_values", p_values, c), held("p_values", p_values, e), clash, lambda x, y: F.concat(F.lit("P-value conflict: claim says "), x["text"], F.lit(" while evidence says "), y["text"], F.lit(".")))
    return F.when(held("statistical_gate", statistical_gate, c, e), F.array_distinct(said)).otherwise(none())


def intervals(text: Column, pattern: str, null: float, names: tuple[str, str]) -> Column:
    part = lambda m, g: _number(F.regexp_extract(m, "(?i)" + pattern, g))
    inside = lambda m: (part(m, 1) <= null) & (part(m, 2) >= null)
    return F.transform(F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(0)), lambda m: F.struct(F.when(inside(m), names[0]).otherwise(names[1]).alias("rel"), m.alias("text")))


def interval(c, e):
    one = lambda r, t: F.array(F.struct(F.lit(r).alias("rel"), F.lit(t).alias("text")))
    claimed = F.when(has(c, r"\bincludes?\s+zero\b"), one("includes zero", "includes zero")).when(has(c, r"\bexcludes?\s+zero\b"), one("excludes zero", "excludes zero")).when(has(c, r"\bnot\s+statistically\s+significant\b"), one("includes zero", "not statistically significant")).when(has(c, r"\bstatistically\s+significant\b"), one("excludes zero", "statistically significant"))
    claimed = F.coalesce(claimed, F.array().cast("array<struct<rel:string,text:string>>"))
    said = pairs(claimed, intervals(e, v.CI_RANGE, 0, ("includes zero", "excludes zero")), lambda x, y: x["rel"] != y["rel"], lambda x, y: F.concat(F.lit("Confidence interval conflict: claim says "), x["text"], F.lit(" while evidence interval "), y["text"], F.lit(" "), y["rel"], F.lit(".")))
    return F.when(held("statistical_gate", statistical_gate, c, e), F.array_distinct(said)).otherwise(none())


def ratio_effect(c, e):
    tail = lambda n, p: rf"\b{v.RATIO}\b[^.;\n]{{0,{n}}}\b{p}"
    row = lambda cond, r, t: F.when(cond, F.struct(F.lit(r).alias("rel"), F.lit(t).alias("text")))
    known = lambda *rows: F.filter(F.array(*rows), lambda x: x.isNotNull())
    insignificant = has(c, tail(80, r"not\s+statistically\s+significant\b"))
    point = known(row(has(c, tail(60, r"(?:below|less\s+than|under)\s+1\b")), "below one", "ratio below 1"), row(has(c, tail(60, r"(?:above|greater\s+than|over)\s+1\b")), "above one", "ratio above 1"))
    null = known(
        row(has(c, tail(80, r"includes?\s+(?:the\s+)?null(?:\s+value)?\b")) | insignificant, "includes null", "ratio includes null"),
        row(has(c, tail(80, r"excludes?\s+(?:the\s+)?null(?:\s+value)?\b")) | (has(c, tail(80, r"statistically\s+significant\b")) & ~insignificant), "excludes null", "ratio excludes null"),
    )
    part = lambda m, g: F.regexp_extract(m, "(?i)" + v.RATIO_POINT, g)
    number = lambda m: _number(part(m, 3))
    points = F.filter(F.regexp_extract_all(e, F.lit("(?i)" + v.RATIO_POINT), F.lit(0)), lambda m: ~has(part(m, 2), r"\b(?:ci|confidence\s+interval)\b"))
    points = F.transform(points, lambda m: F.struct(F.when(number(m) < 1, "below one").when(number(m) == 1, "at null").otherwise("above one").alias("rel"), F.concat(part(m, 1), F.lit(" "), part(m, 3)).alias("text")))
    message = lambda x, y: F.concat(F.lit("Ratio effect conflict: claim says "), x["text"], F.lit(" while evidence says "), y["text"], F.lit("."))
    differ = lambda x, y: x["rel"] != y["rel"]
    metrics = lambda t: F.transform(found(t, v.RATIO), lambda m: squeeze(F.lower(m)))
    said = F.concat(pairs(point, points, differ, message), pairs(null, intervals(e, v.RATIO_CI, 1, ("includes null", "excludes null")), differ, message))
    return F.when(held("statistical_gate", statistical_gate, c, e) | F.arrays_overlap(metrics(c), metrics(e)), F.array_distinct(said)).otherwise(none())


def slots(text: Column, pattern: str, key, number: int) -> Column:
    """(key, number, text) of each match; key: a function of the match."""
    return F.transform(found(text, pattern), lambda m: F.struct(key(m).alias("key"), _number(F.regexp_extract(m, "(?iU)" + pattern, number)).alias("number"), strip(m).alias("text")))


def slot_rule(a: Column, b: Column, head: str) -> Column:
    return pairs(a, b, lambda x, y: (x["key"] == y["key"]) & (x["number"] != y["number"]), lambda x, y: F.concat(F.lit(head + ": claim says "), x["text"], F.lit(" while evidence says "), y["text"], F.lit(".")))


def clinical(c, e):
    part = lambda p, g: lambda m: squeeze(F.lower(F.regexp_extract(m, "(?iU)" + p, g)))
    single = lambda x: F.regexp_replace(x, "s+$", "")
    ratio = lambda t: slots(t, v.RATIO_VALUE, part(v.RATIO_VALUE, 1), 2)
    endpoint = lambda t: slots(t, v.ENDPOINT, lambda m: F.concat_ws("|", single(part(v.ENDPOINT, 3)(m)), single(part(v.ENDPOINT, 2)(m))), 1)
    status = lambda t: F.when(has(t, r"\bunadjusted\b|\bcrude\b"), "unadjusted").when(has(t, r"\badjusted\b"), "adjusted")
    named = lambda t, g, table: mentioned(t, g, table)
    every = together(
        slot_rule(ratio(c), ratio(e), "Exact effect value conflict"),
        say(status(c) != status(e), "Adjustment status conflict: claim and evidence use different adjusted/unadjusted estimates."),
        say(disjoint(named(c, "Population", v.POPULATIONS), named(e, "Population", v.POPULATIONS)), "Population group conflict: claim and evidence describe different populations."),
        slot_rule(endpoint(c), endpoint(e), "Endpoint window conflict"),
        say(disjoint(named(c, "Trial design", v.TRIALS), named(e, "Trial design", v.TRIALS)), "Trial design conflict: claim and evidence describe different trial designs."),
    )
    return F.when(gate(c, e, v.CLINICAL_MASK, 0.5), every).otherwise(none())


def measurement(c, e):
    ahead = rf"\b({v.METRIC})\b(?:\s+score)?\s*(?:of|=|was|is|achieved|reached|:)\s*(\d+(?:\.\d+)?)\b"
    behind = rf"\b((?:by|over|more\s+than|less\s+than|at\s+least)\s*)?\b(\d+(?:\.\d+)?)\s+({v.METRIC})\b"
    name = lambda x: F.when(x == "auc", "auroc").when(x.startswith("f1"), "f1").otherwise(x)
    plain = lambda x: name(F.regexp_replace(F.lower(x), " ", ""))
    key = lambda m: plain(F.regexp_extract(m, "(?iU)" + ahead, 1))
    part = lambda m, g: F.regexp_extract(m, "(?iU)" + behind, g)
    own = lambda t: F.filter(found(t, behind), lambda m: part(m, 1) == "")
    back = lambda t: F.transform(own(t), lambda m: F.struct(plain(part(m, 3)).alias("key"), _number(part(m, 2)).alias("number"), strip(m).alias("text")))
    values = lambda t: F.concat(slots(t, ahead, key, 2), back(t))

    def versions(t):
        marks = F.regexp_extract_all(t, F.lit(r"\b[A-Z][A-Z0-9]{2,}(?:-[A-Za-z0-9]+)?\b"), F.lit(0))
        rows = F.transform(marks, lambda m: F.struct(F.substring_index(m, "-", 1).alias("base"), F.when(m.contains("-"), F.regexp_replace(m, "^[^-]*-", "")).alias("variant")))
        rows = F.filter(rows, lambda r: ~r["base"].isin(v.METRIC_BASES) & (r["variant"].isNull() | r["variant"].rlike(r"^[A-Z]|\d")))
        rows = F.transform(rows, lambda r: F.struct(r["base"].alias("base"), F.lower(r["variant"]).alias("variant")))
        return F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, i + 2, F.size(rows) + 1), lambda later: later["base"] == r["base"]))

    label = lambda r: F.concat_ws("-", r["base"], r["variant"])
    version = pairs(versions(c), versions(e), lambda x, y: (x["base"] == y["base"]) & ~x["variant"].eqNullSafe(y["variant"]), lambda x, y: F.concat(F.lit("Benchmark version conflict: claim says "), label(x), F.lit(" while evidence says "), label(y), F.lit(".")))
    return F.when(gate(c, e, v.METRIC_MASK, 0.5), together(slot_rule(values(c), values(e), "Metric value conflict"), version)).otherwise(none())


def training_config(c, e):
    def values(t):
        out = []
        for slot, p in v.CONFIG_SLOTS.items():
            ahead = rf"\b{p}\b\s*(?:(?:=|:)\s*|(?:of|was|is|to|at|with|used)\s+)?({v.CONFIG_NUMBER})\b"
            behind = rf"\b({v.CONFIG_NUMBER})\s+{p}\b"
            out += [slots(t, q, lambda m, slot=slot: F.lit(slot), 1) for q in (ahead, behind)]
        return F.array_distinct(F.concat(*out))

    a, b = masked_words(c, v.CONFIG_MASK), masked_words(e, v.CONFIG_MASK)
    same = ((F.size(a) == 0) & (F.size(b) == 0)) | (overlap(a, b) >= 0.67)
    return F.when(same, F.array_distinct(slot_rule(values(c), values(e), "Training configuration value conflict"))).otherwise(none())


def mapping(c, e):
    alias = F.create_map(*[F.lit(x) for kv in v.MEANING_ALIASES.items() for x in kv])
    part = lambda t: lambda g: found(t, v.MAPPING, g)

    def rows(t):
        clean = lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s+", " "), F.lit(" ,.;:"))
        zipped = F.arrays_zip(part(t)(1).alias("key"), part(t)(2).alias("value"), F.transform(part(t)(3), clean).alias("meaning"))
        said = lambda x: F.array_distinct(F.transform(F.filter(tokens(x), lambda w: ~w.isin(v.MEANING_STOP)), lambda w: F.coalesce(F.try_element_at(alias, w), w)))
        full = F.transform(zipped, lambda r: F.struct(F.lower(r["key"]).alias("key"), F.lower(r["value"]).alias("value"), r["meaning"].alias("meaning"), said(r["meaning"]).alias("words")))
        return F.filter(full, lambda r: F.size(r["words"]) > 0)

    match = lambda x, y: overlap(x["words"], y["words"]) >= 0.5
    wait, reply = F.array(F.lit("wait")), F.array(*map(F.lit, ["answer", "reply", "respond", "response"]))
    any_of = lambda x, s: F.arrays_overlap(x["words"], s)
    swapped = lambda x, y: (any_of(x, wait) & any_of(y, reply)) | (any_of(x, reply) & any_of(y, wait))
    other = lambda x, y: ~match(x, y) & (swapped(x, y) | ~F.arrays_overlap(x["words"], y["words"]))
    meaning = pairs(rows(c), rows(e), lambda x, y: (x["key"] == y["key"]) & (x["value"] == y["value"]) & other(x, y), lambda x, y: F.concat(F.lit("Mapping conflict: claim "), x["key"], F.lit("="), x["value"], F.lit(" means "), x["meaning"], F.lit(" but evidence maps it to "), y["meaning"]))
    value = pairs(rows(c), rows(e), lambda x, y: (x["key"] == y["key"]) & (x["value"] != y["value"]) & match(x, y), lambda x, y: F.concat(F.lit("Mapping conflict: claim maps "), x["meaning"], F.lit(" to "), x["key"], F.lit("="), x["value"], F.lit(" but evidence maps it to "), y["key"], F.lit("="), y["value"]))
    return together(meaning, value)


# -- names and comparisons ----------------------------------------------------------------


def anchor_key(x: Column) -> Column:
    key = F.lower(F.regexp_replace(x, r"(?U)\s+", " "))
    return F.when(key.isin("lm", "lms", "llm", "llms"), "lm").otherwise(key)


def material(text: Column) -> Column:
    """Names in a text, in order, each once: acronyms, mixed-case words, and a capitalised word before a method noun."""
    whole = joined_capitals(text)
    raw = F.concat(F.regexp_extract_all(whole, F.lit(v.MATERIAL), F.lit(0)), F.regexp_extract_all(whole, F.lit(v.MATERIAL_PHRASE), F.lit(0)))
    named = F.transform(raw, lambda x: F.btrim(x, F.lit(".,;:()[]{}")))
    real = lambda x: (F.length(x) > 1) & ~F.substring_index(x, " ", 1).isin(v.GENERIC) & ~x.rlike("^[A-Z]{2}$") & x.rlike("[A-Z]")
    placed = F.array_sort(F.transform(F.filter(named, real), lambda x: F.struct(F.call_function("instr", whole, x).alias("at"), x.alias("name"))))
    names = F.transform(placed, lambda r: r["name"])
    keys = F.transform(names, anchor_key)
    return F.filter(names, lambda x, i: F.array_position(keys, anchor_key(x)) == i + 1)


def entity(c, e):
    covered = held("coverage", lambda x, y: coverage(expanded_tokens(x), expanded_tokens(y)), c, e)
    keys = lambda a: F.transform(a, anchor_key)
    a, b = held("material", material, c), held("material", material, e)
    missing = F.filter(a, lambda x: ~F.array_contains(keys(b), anchor_key(x)))
    rival = F.filter(b, lambda x: ~F.array_contains(keys(a), anchor_key(x)))
    hit = (covered >= 0.45) & (F.size(a) > 0) & (F.size(b) > 0) & (F.size(missing) > 0) & (F.size(rival) > 0)
    return say(hit, "Entity conflict: evidence is missing claim anchor(s) ", F.array_join(missing, ", "), " and contains competing anchor(s) ", F.array_join(rival, ", "))


COMPARED = ["left", "right", "relation", "context"]


def comparisons(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """df with the comparison that a text makes between two names as <prefix>left, right, relation and context.

    All null if it makes none. A leading "On X," or "the X benchmark shows" and a trailing "on X" are its context, "is
    outperformed by" is turned. Each step is a projection of its own, so that no expression is repeated in the next."""
    verbs = "|".join(k.replace(" ", r"\s") for k in v.RELATIONS)
    lead, shows = r"(?i)^\s*(?:on|in|for)\s+([^,]+),\s*(.+)$", r"(?i)^\s*(?:the\s+)?(.+?)\s+benchmark\s+shows\s+(.+)$"
    active, passive = rf"(?i)(.+?)\s+({verbs})\s+(.+?)(?:\.|$)", r"(?i)(.+?)\s+(?:be|been|being|is|are|was|were)\s+outperformed\s+by\s+(.+?)(?:\.|$)"
    suffix = r"(?i)^(.+?)\s+(?:on|in|for)\s+(.+)$"
    t, p = F.col(text), "__" + prefix
    pick = lambda g: F.when(t.rlike(lead), F.regexp_extract(t, lead, g)).when(t.rlike(shows), F.regexp_extract(t, shows, g))
    df = df.withColumns({p + "body": F.coalesce(pick(2), t), p + "setting": F.coalesce(pick(1), F.lit(""))})
    body = F.col(p + "body")
    turned = body.rlike(passive)
    relation = F.create_map(*[F.lit(x) for kv in v.RELATIONS.items() for x in kv])
    kind = F.try_element_at(relation, F.regexp_replace(F.lower(F.regexp_extract(body, active, 2)), r"\s", " "))
    df = df.withColumns({
        p + "a": F.when(turned, F.regexp_extract(body, passive, 2)).when(body.rlike(active), F.regexp_extract(body, active, 1)),
        p + "b": F.when(turned, F.regexp_extract(body, passive, 1)).when(body.rlike(active), F.regexp_extract(body, active, 3)),
        p + "turned": turned,
        p + "kind": F.when(turned, v.RELATIONS["outperformed"]).when(body.rlike(active), kind),
    })
    last = strip(F.when(F.col(p + "turned"), F.col(p + "a")).otherwise(F.col(p + "b")))
    head, tail = F.regexp_extract(last, suffix, 1), F.regexp_extract(last, suffix, 2)
    cut = lambda side, own: F.when(own & last.rlike(suffix), head).otherwise(F.col(p + side))
    df = df.withColumns({
        p + "a": cut("a", F.col(p + "turned")),
        p + "b": cut("b", ~F.col(p + "turned")),
        p + "context": F.filter(F.transform(F.array(F.col(p + "setting"), tail), lambda s: F.btrim(s, F.lit(" .,;:()[]{}"))), lambda s: s != ""),
    })
    df = df.withColumns({p + "an": material(F.col(p + "a")), p + "bn": material(F.col(p + "b"))})
    only = lambda side: F.when(F.size(p + side + "n") == 1, F.get(p + side + "n", F.lit(0))).otherwise(F.nullif(F.regexp_extract(p + side, v.PLACEHOLDER, 0), F.lit("")))
    df = df.withColumns({p + "a": only("a"), p + "b": only("b")})
    ok = F.col(p + "a").isNotNull() & F.col(p + "b").isNotNull() & (anchor_key(F.col(p + "a")) != anchor_key(F.col(p + "b")))
    made = {"left": "a", "right": "b", "relation": "kind", "context": "context"}
    df = df.withColumns({prefix + x: F.when(ok, F.col(p + y)) for x, y in made.items()})
    return df.drop(*[p + x for x in ("body", "setting", "a", "b", "turned", "kind", "context", "an", "bn")])


def compared(x: str, y: str) -> tuple[Column, Column]:
    """(conflict, tension) of the comparisons with the column prefixes x (claim) and y (evidence)."""
    of = lambda p: {k: F.col(p + k) for k in COMPARED}
    a, b = of(x), of(y)
    pair = lambda r: F.array_sort(F.array(anchor_key(r["left"]), anchor_key(r["right"])))
    same = F.coalesce((pair(a) == pair(b)) & a["relation"].isNotNull() & b["relation"].isNotNull(), F.lit(False))
    neutral = lambda r: r["relation"].startswith("neutral")
    keys = lambda r: F.transform(r["context"], anchor_key)
    strengths, kinds = neutral(a) != neutral(b), a["relation"] != b["relation"]
    elsewhere = (F.size(a["context"]) > 0) & (F.size(b["context"]) > 0) & ~F.arrays_overlap(keys(a), keys(b))
    labels = F.concat(F.lit("claim "), a["relation"], F.lit(" vs evidence "), b["relation"])
    tension = F.when(~same, none()).when(strengths, F.array(F.concat(F.lit("Comparison strength mismatch: "), labels))).when(kinds, F.array(F.concat(F.lit("Comparison dimension mismatch: "), labels)))
    tension = tension.when(elsewhere, F.array(F.concat(F.lit("Comparison context mismatch: claim "), F.array_join(a["context"], ", "), F.lit(" vs evidence "), F.array_join(b["context"], ", ")))).otherwise(none())
    turned = same & ~kinds & ~elsewhere & ~neutral(a) & (anchor_key(a["left"]) == anchor_key(b["right"])) & (anchor_key(a["right"]) == anchor_key(b["left"]))
    return say(F.coalesce(turned, F.lit(False)), "Comparison direction conflict: claim ", a["left"], " > ", a["right"], " vs evidence ", b["left"], " > ", b["right"]), tension


def hedged(c, e):
    return say(has(e, v.HEDGE) & ~has(c, v.HEDGE), "Evidence is hedged or inconclusive.")


def narrower(c, e):
    return say(has(c, v.UNIVERSAL) & has(e, v.NARROW), "Evidence is narrower than the claim.")


#: In the order in which findings are listed.
CONFLICTS = {"numeric": numeric, "unit": unit, "year": year, "negation": negation, "direction": direction, "numeric_bound": bound_conflict, "qualitative": qualitative, "attribute": attribute, "technical": technical, "p_value": p_value, "interval": interval, "ratio_effect": ratio_effect, "statistical": statistical, "strength": strength, "outcome": outcome, "release": release, "protocol": protocol, "role": role, "component": component_excluded, "contrast": contrast, "clinical": clinical, "measurement": measurement, "training_config": training_config, "mapping": mapping}
TENSIONS = {"bound_tension": bound_tension, "scope": scope, "overstatement": overstatement, "assertion": assertion, "mixed_outcome": mixed_outcome, "target": target, "context": context_limits}


def inspect(pairs_df: DataFrame, claim: str = "claim", evidence: str = "evidence") -> DataFrame:
    """pairs_df with fact_label (contradicted, partially_supported or null) and findings, one row for each pair."""
    c, e = F.col(claim), F.col(evidence)
    out = comparisons(comparisons(pairs_df, claim, "__cx_"), evidence, "__cy_")
    turned, tension = compared("__cx_", "__cy_")
    out = out.withColumns({"__turned": turned, "__mismatch": tension}).drop(*[p + k for p in ("__cx_", "__cy_") for k in COMPARED])
    names, kept = [f"__l_{n}" for n in CONFLICTS], []

    def hold(df: DataFrame, **columns) -> DataFrame:
        """df with what several rules use as columns; they find it under its name."""
        df = df.withColumns({f"__h_{k}": column for k, (column, _) in columns.items()})
        for k, (_, key) in columns.items():
            _held.get()[key] = F.col(f"__h_{k}")
            kept.append(f"__h_{k}")
        return df

    sides = (("c", c), ("e", e))
    per_text = lambda what, build: {f"{what}_{s}": (build(t), (what, str(t))) for s, t in sides}
    per_pair = lambda what, build: {what: (build(c, e), (what, str(c), str(e)))}
    before = _held.set({})
    try:
        out = hold(out, **per_text("quantities", quantities), **per_text("material", material), **per_text("p_values", p_values))
        gates = {"attribute_gate": attribute_gate, "technical_gate": technical_gate, "statistical_gate": statistical_gate, "protocol_gate": protocol_gate, "quality_gate": quality_gate, "outcome_gate": outcome_gate}
        gates |= {"coverage": lambda x, y: coverage(expanded_tokens(x), expanded_tokens(y)), "academic": lambda x, y: coverage(academic_tokens(x), academic_tokens(y))}
        parts: dict = {}
        for what, build in gates.items():
            parts |= per_pair(what, build)
        out = hold(out, **per_text("bounds", bounds), **parts)
        out = out.withColumns({f"__l_{n}": f(c, e) for n, f in CONFLICTS.items()} | {f"__t_{n}": f(c, e) for n, f in TENSIONS.items()} | {"__entity": entity(c, e), "__hedged": hedged(c, e), "__narrower": narrower(c, e)})
    finally:
        _held.reset(before)
    out = out.drop(*kept)
    out = out.withColumn("__l_direction", F.when(F.size("__mismatch") > 0, none()).otherwise(F.col("__l_direction")))
    out = out.withColumns({"__hard": F.concat(*names, "__turned"), "__soft": F.concat(*[f"__t_{n}" for n in TENSIONS])})
    some = lambda x: F.size(x) > 0
    partial = ("__soft", "__mismatch")
    label = F.when(some("__hard"), "contradicted").when(some(partial[0]) | some(partial[1]), "partially_supported").when(some("__entity"), "contradicted").when(some("__hedged") | some("__narrower"), "partially_supported")
    said = F.when(some("__hard"), F.col("__hard"))
    for x in (*partial, "__entity", "__hedged", "__narrower"):
        said = said.when(some(x), F.col(x))
    out = out.withColumns({"fact_label": label, "findings": said.otherwise(none())})
    return out.drop(*names, *[f"__t_{n}" for n in TENSIONS], "__turned", "__mismatch", "__hard", "__soft", "__entity", "__hedged", "__narrower")
