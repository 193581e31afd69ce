"""Text functions as Column builders: tokens, sentences, chunks, windows and the overlap measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"
CHUNK_CHARS = 700

# fixed values: the token rules of the data model
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "their", "this", "to", "was", "were", "with"]
DISCOURSE = ["argue", "argues", "conclude", "concludes", "paper"]
ALIASES = {
    "assistance": "assist", "assisted": "assist", "assistants": "assistant", "better": "stronger", "fed": "feed",
    "feeds": "feed", "generate": "generate", "generated": "generate", "generator": "generate",
    "llm": "language model", "llms": "language model", "lm": "language model", "lms": "language model",
    "make": "produce", "modeling": "model", "models": "model", "pomdps": "pomdp", "ppl": "perplexity",
    "provides": "provide", "reranking": "rerank", "reranks": "rerank", "retrieval": "retrieve",
    "retrieved": "retrieve", "robustness": "robust", "simulators": "simulator", "smaller": "small",
    "speech": "spoken", "training": "train",
}


def has(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whether the pattern occurs; \\s, \\w and \\b are Unicode's. The pattern is a literal, so Spark compiles it once."""
    return text.rlike(("(?iU)" if ignore_case else "(?U)") + pattern)


def found(text: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    """All matches of a group, in order."""
    return F.regexp_extract_all(text, F.lit(("(?iU)" if ignore_case else "(?U)") + pattern), F.lit(group))


def masked(text: Column, pattern: str) -> Column:
    """The text with a rule's own trigger words blanked."""
    return F.regexp_replace(text, "(?iU)" + pattern, " ")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(STOPWORDS))


def joined_capitals(text: Column) -> Column:
    """Acronyms that an extraction split: a word of capitals takes in the next ones up to the last of two letters or more.

    Said of a run of such words at once, this is what joining two neighbours again and again comes to."""
    return F.regexp_replace(text, r"\b([A-Z]+)\s+(?=(?:[A-Z]\s+)*[A-Z]{2,}\b)", "$1")


def expanded_tokens(text: Column) -> Column:
    """Distinct tokens of the text, then those that only its joined and camel-split form has."""
    return F.array_distinct(F.concat(tokens(text), tokens(F.regexp_replace(joined_capitals(text), "(?<=[a-z])(?=[A-Z])", " "))))


def camel_tokens(text: Column) -> Column:
    """As expanded_tokens, without joining split acronyms: a text without camel case is tokenised once."""
    split = F.concat(tokens(text), tokens(F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])", " ")))
    return F.array_distinct(F.when(text.rlike("[a-z][A-Z]"), split).otherwise(tokens(text)))


def academic_tokens(text: Column) -> Column:
    """Expanded tokens with paraphrases made alike; a set."""
    said = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    kept = F.filter(expanded_tokens(text), lambda w: ~w.isin(DISCOURSE))
    return F.array_distinct(F.flatten(F.transform(kept, lambda w: F.split(F.coalesce(F.try_element_at(said, w), w), " "))))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def coverage(claim_tokens: Column, evidence_tokens: Column) -> Column:
    """The share of the claim's tokens that the evidence has; 0 for none."""
    n = F.size(claim_tokens)
    return F.when(n > 0, shared(claim_tokens, evidence_tokens) / n).otherwise(F.lit(0.0))


def likeness(a: Column, b: Column) -> Column:
    """Ochiai's coefficient of two token sets."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared(a, b) / F.sqrt(F.size(a).cast("double") * F.size(b))).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, shared(a, b) / least).otherwise(F.lit(0.0))


def same_context(claim: Column, evidence: Column, mask: str, threshold: float) -> Column:
    """The gate of most rules: do both speak of the same, trigger words aside."""
    side = lambda t: expanded_tokens(masked(t, mask) if mask else t)
    return overlap(side(claim), side(evidence)) >= threshold


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def chunks(text: Column, most: int = CHUNK_CHARS) -> Column:
    """Paragraphs, long ones by sentences, packed in order into chunks of at most `most` characters.

    One sentence above that stays whole."""
    blocks = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda b: b != "")
    parts = F.flatten(F.transform(blocks, lambda b: F.when(F.length(b) > most, sentences(b)).otherwise(F.array(b))))

    def put(held, part):
        grown = F.concat(held["now"], F.lit(" "), part)
        fits = F.length(grown) <= most
        return F.when(held["now"] == "", F.struct(held["done"].alias("done"), part.alias("now"))).when(fits, F.struct(held["done"].alias("done"), grown.alias("now"))).otherwise(F.struct(F.concat(held["done"], F.array(held["now"])).alias("done"), part.alias("now")))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    return F.aggregate(parts, start, put, lambda held: F.when(held["now"] == "", held["done"]).otherwise(F.concat(held["done"], F.array(held["now"]))))


def windows(text: Column, radius: int = 1) -> Column:
    """Each sentence with its neighbours, equal windows once.

    The sentences are bound as a lambda's variable: inside another lambda an expression would be made again each time."""

    def near(s):
        first = lambda i: F.greatest(i - radius, F.lit(0))
        return F.transform(s, lambda _, i: F.array_join(F.slice(s, first(i) + 1, F.least(i + radius, F.size(s) - 1) - first(i) + 1), " "))

    return F.array_distinct(F.flatten(F.transform(F.array(sentences(text)), near)))
