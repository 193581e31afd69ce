"""Drafts to claims and atomic sub-claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has, sentences, squeeze, strip

# fixed values: citation, clause and LaTeX syntax of drafts
CITE = r"\\cite[a-zA-Z*]*\{([^}]+)\}"
BRACKET = r"\[([^\]]*@[\w:.-]+[^\]]*)\]"
AT_KEY = r"@([\w:.-]+)"
SEMICOLON = r";\s+"
COMMA_MARKER = r",\s+(?:while|whereas|but|and)\s+"
SELF_METHOD = r"\bwe\s+(?:adopt|apply|employ|evaluate|investigate|leverage|study|use)\b"
SCOPE_SUFFIX = r"^[,;:]?\s*(?:across|for|in|of|on|to|under|with)\b"
NAMED_SOURCE = r"(\b(?:an?|the)\s+(?:[A-Za-z-]+\s+){0,4}(?:benchmark|collection|corpus|dataset))\s*\(\s*([^()\\]+?)\s*~?\s*(\\cite[a-zA-Z*]*\{[^}]+\})\s*\)"
PREDICATE = r"\b(?:achieves?|are|captures?|computes?|contains?|covers?|defines?|has|have|evaluate(?:d|s)?|improves?|increases?|introduce(?:d|s)?|is|outperforms?|predict(?:ed|s)?|provides?|reduces?|requires?|shows?|spans?|trains?|uses?|was|were)\b"
ENVIRONMENTS = ["abstract", "comment", "equation", "figure", "figure*", "IEEEkeywords", "table", "table*", "tabular", "tikzpicture"]
UNWRAP_HEAD = r"\\(?:emph|textbf|textit|texttt|underline)\{"
UNWRAP = UNWRAP_HEAD + r"([^{}]*)\}"
LATEX_NOISE = [
    r"\\documentclass(?:\[[^\]]*\])?\{[^}]+\}",
    r"\\usepackage(?:\[[^\]]*\])?\{[^}]+\}",
    r"\\(?:begin|end)\{document\}",
    r"\\(?:title|author|date|bibliography|bibliographystyle)\{[^}]*\}",
    r"\\maketitle\b",
    r"\\(?:section|subsection|subsubsection|caption|label|ref)\*?\{[^}]*\}",
    r"\\(?:begin|end)\{[^}]+\}",
    r"\\(?!cite)[A-Za-z]+\*?(?:\[[^\]]*\])?",
]
CHECKABLE = "captures?|computes?|contains?|decreases?|improves?|increases?|outperforms?|provides?|reduces?|solves?|spans?|trains?|uses?"


def prepared(text: Column) -> Column:
    """A draft without headings, comments, dropped environments and markup, white space squeezed.

    Formatting commands are unwrapped from within until none is left: no text needs more turns than it has commands."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    lines = F.filter(lines, lambda x: ~strip(x).startswith("#"))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, r"(?<!\\)((?:\\\\)*)%.*$", "$1"))
    out = F.array_join(lines, "\n")
    for name in ENVIRONMENTS:
        quoted = name.replace("*", r"\*")
        out = F.regexp_replace(out, rf"(?s)\\begin\{{{quoted}\}}.*?\\end\{{{quoted}\}}", " ")
    turns = F.sequence(F.lit(0), F.regexp_count(out, F.lit(UNWRAP_HEAD)))
    out = F.aggregate(turns, out, lambda t, _: F.when(t.rlike(UNWRAP), F.regexp_replace(t, UNWRAP, "$1")).otherwise(t))
    out = reduce(lambda t, p: F.regexp_replace(t, p, " "), LATEX_NOISE, out)
    return F.regexp_replace(out, r"(?U)\s+", " ")


def citation_keys(text: Column) -> Column:
    """Keys of LaTeX citations, then of bracketed ones, each once, in order."""
    latex = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CITE), F.lit(1)), lambda x: F.split(x, ",")))
    groups = F.regexp_extract_all(text, F.lit("(?U)" + BRACKET), F.lit(1))
    pandoc = F.flatten(F.transform(groups, lambda x: F.regexp_extract_all(x, F.lit("(?U)" + AT_KEY), F.lit(1))))
    return F.array_distinct(F.filter(F.transform(F.concat(latex, pandoc), strip), lambda k: k != ""))


def claim_text(text: Column) -> Column:
    """Text without its citations and braces."""
    out = F.regexp_replace(F.regexp_replace(text, CITE, ""), "(?U)" + BRACKET, "")
    out = squeeze(F.translate(out, "~{}", "   "))
    return F.regexp_replace(out, r"(?U)\s+([.!?,;:])", "$1")


def ended(piece: Column, sentence: Column) -> Column:
    """The piece with the sentence's last punctuation, if it has none."""
    last = F.right(F.rtrim(sentence), F.lit(1))
    marks = [".", "!", "?"]
    return F.when(~F.right(piece, F.lit(1)).isin(marks) & last.isin(marks), F.concat(piece, last)).otherwise(piece)


def clauses(sentence: Column) -> Column:
    """The sentence's clauses, by the first rule that holds.

    Data sets named in brackets beside their citation, if they hold all its keys; a cited method of one's own that is
    applied to something, cut after the citation; splits at semicolons and commas with a conjunction, if all of two or
    more pieces are cited and say something; else the sentence."""
    keys = citation_keys(sentence)
    one = lambda m, g: F.regexp_extract(m, "(?i)" + NAMED_SOURCE, g)
    named = F.regexp_extract_all(sentence, F.lit("(?i)" + NAMED_SOURCE), F.lit(0))
    named_keys = F.array_distinct(F.flatten(F.transform(named, lambda m: citation_keys(one(m, 3)))))
    by_source = F.transform(named, lambda m: F.concat(F.btrim(F.regexp_replace(F.translate(one(m, 2), "~", " "), r"\s+", " "), F.lit(" .;,")), F.lit(" is "), one(m, 1), F.lit(" "), one(m, 3), F.lit(".")))
    cited = F.size(F.regexp_extract_all(sentence, F.lit(CITE), F.lit(0)))
    head = strip(F.regexp_extract(sentence, r"(?s)^(.*?" + CITE.replace("([^}]+)", "[^}]+") + ")(.*)$", 1))
    tail = strip(F.regexp_extract(sentence, r"(?s)^(.*?" + CITE.replace("([^}]+)", "[^}]+") + ")(.*)$", 2))
    own_method = (cited == 1) & (tail != "") & has(tail, SCOPE_SUFFIX) & has(claim_text(head), SELF_METHOD)
    pieces = F.filter(F.transform(F.flatten(F.transform(F.split(sentence, SEMICOLON), lambda x: F.split(x, COMMA_MARKER))), strip), lambda x: x != "")
    good = (F.size(pieces) >= 2) & F.forall(pieces, lambda p: (F.size(citation_keys(p)) > 0) & has(claim_text(p), PREDICATE))
    same = (F.size(F.array_except(named_keys, keys)) == 0) & (F.size(F.array_except(keys, named_keys)) == 0)
    return F.when((F.size(named) > 0) & same, by_source).when(own_method, F.array(ended(head, sentence))).when(good, F.transform(pieces, lambda p: ended(p, sentence))).otherwise(F.array(sentence))


def parse_claims(drafts: DataFrame, text: str = "text", require_citation: bool = True) -> DataFrame:
    """drafts exploded to claims: claim_ord, claim, citation_keys. Null drafts have none."""
    keep = [c for c in drafts.columns if c != text]
    out = drafts.withColumn("__sentences", sentences(prepared(F.col(text))))
    out = out.select(*keep, F.posexplode("__sentences").alias("__s", "__sentence"))
    out = out.select(*keep, "__s", F.posexplode(clauses(F.col("__sentence"))).alias("__c", "__clause"))
    out = out.select(*keep, "__s", "__c", claim_text(F.col("__clause")).alias("claim"), citation_keys(F.col("__clause")).alias("citation_keys"))
    out = out.where(F.col("claim") != "")
    if require_citation:
        out = out.where(F.size("citation_keys") > 0)
    return out.withColumn("claim_ord", (F.col("__s") * 1000 + F.col("__c")).cast("long")).drop("__s", "__c")


def atoms(claim: Column) -> Column:
    """A claim of one subject and two verbs joined by "and" as two sentences, else the claim itself."""
    pattern = rf"^(.+?)\s+((?:{CHECKABLE})\b.+?)\s+and\s+((?:{CHECKABLE})\b.+)$"
    bare = F.regexp_replace(strip(claim), r"\.+$", "")
    part = lambda g: strip(F.regexp_extract(bare, pattern, g))
    both = F.array(*[squeeze(F.concat(F.regexp_extract(bare, pattern, 1), F.lit(" "), part(g), F.lit("."))) for g in (2, 3)])
    return F.when(bare.rlike(pattern), both).otherwise(F.array(squeeze(claim)))
