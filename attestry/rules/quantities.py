"""Quantities in text: a number, its unit and the words that say it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as v

# fixed values: number words, units and scales
DIGITS = r"\d+(?:,\d{3})*(?:\.\d+)?"
ONES = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50}
SCALES = {"hundred": 100, "thousand": 1000, "million": 1_000_000, "billion": 1_000_000_000}
COMPACT = {"b": 1_000_000_000, "k": 1000, "m": 1_000_000}
WORD_NUMBER = r"(?:twenty|thirty|forty|fifty)(?:\s+(?:one|two|three|four|five|six|seven|eight|nine))?|a|an|one|two|three|four|five|six|seven|eight|nine|ten"
UNIT = r"percent|arms?|centers?|centres?|cohorts?|conversations?|days?|dialogues?|domains?|doses?|examples?|g|gpus?|groups?|heads?|hours?|kg|languages?|layers?|mg|minutes?|ml|months?|images?|masks?|papers?|parameters?|participants?|patients?|points?|samples?|seconds?|sites?|studies|subjects?|times?|trials?|turns?|tokens?|weeks?|years?"
BRIDGE = r"(?!(?:and|as|by|for|from|in|of|on|or|than|to|with|without)(?!-)\b)[A-Za-z][A-Za-z-]*"
BRIDGE_STOP = ["and", "as", "by", "for", "from", "few", "hundred", "in", "billion", "million", "of", "on", "or", "than", "thousand", "to", "with", "without"]
SCALE = "hundred|thousand|million|billion"
QUANTITY = (
    r"(?<![A-Za-z0-9])"
    rf"(?:((?:a\s+)?few)\s+({SCALE})|({DIGITS})\s+({SCALE})|({WORD_NUMBER})\s+({SCALE})|({DIGITS})([bBkKmM])|({DIGITS})|({WORD_NUMBER}))"
    rf"(?:\s*(%)|((?:\s+{BRIDGE}){{0,3}})\s+({UNIT})(?![A-Za-z-]))"
)
FIELDS = "struct<number:decimal(38,18),unit:string,text:string>"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(str(x)) for kv in values.items() for x in kv])


def _decimal(x: Column) -> Column:
    return F.regexp_replace(x, ",", "").cast("decimal(38,18)")


def _word_number(x: Column) -> Column:
    said = _map(ONES | TENS)
    return F.aggregate(F.split(F.lower(x), r"\s+"), F.lit(0).cast("int"), lambda s, w: s + F.coalesce(F.try_element_at(said, w).cast("int"), F.lit(0)))


def _number(m: Column) -> Column:
    part = lambda g: F.regexp_extract(m, "(?i)" + QUANTITY, g)
    scale = lambda g: F.try_element_at(_map(SCALES), F.lower(part(g))).cast("decimal(12,0)")
    big = lambda x: x.cast("decimal(38,18)")
    return (
        F.when(part(1) != "", big(scale(2) * 3))
        .when(part(3) != "", big(_decimal(part(3)).cast("decimal(20,8)") * scale(4)))
        .when(part(5) != "", big(_word_number(part(5)) * scale(6)))
        .when(part(7) != "", big(_decimal(part(7)).cast("decimal(20,8)") * F.try_element_at(_map(COMPACT), F.lower(part(8))).cast("decimal(12,0)")))
        .when(part(9) != "", _decimal(part(9)))
        .otherwise(big(_word_number(part(10))))
    )


def _unit(m: Column) -> Column:
    word = F.lower(F.regexp_extract(m, "(?i)" + QUANTITY, 13))
    return F.when((word == "") | (word == "percent"), "%").when(word == "studies", "study").when(word == "times", "time").otherwise(F.regexp_replace(word, "s+$", ""))


def quantities(text: Column) -> Column:
    """The quantities of a text in order, as structs of number, unit and text.

    A number of digits or words, perhaps scaled, then a per cent sign or, at most three words on, a unit."""
    matches = F.regexp_extract_all(text, F.lit("(?i)" + QUANTITY), F.lit(0))
    bridge = lambda m: F.regexp_extract_all(F.lower(F.regexp_extract(m, "(?i)" + QUANTITY, 12)), F.lit("[A-Za-z][A-Za-z-]*"), F.lit(0))
    valid = F.filter(matches, lambda m: ~F.exists(bridge(m), lambda w: w.isin(BRIDGE_STOP)))
    return F.transform(valid, lambda m: F.struct(_number(m).alias("number"), _unit(m).alias("unit"), m.alias("text")))


def bound(before: Column) -> Column:
    return F.when(before.rlike("(?iU)" + v.LOWER_BOUND), "lower").when(before.rlike("(?iU)" + v.UPPER_BOUND), "upper").otherwise("exact")


def before(text: Column, part: Column, n: int = 32) -> Column:
    """The n characters before the first place of part in the text."""
    return F.right(F.call_function("substring_index", text, part, F.lit(1)), F.lit(n))
