"""Toxicity: a lexicon trie met by Levenshtein automata, windows of context, and a small logistic model."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

TOKEN = regex.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*")
WINDOW = 8
#: Bound of the labelled sample that the model is fitted on.
SAMPLE_ROWS = 20_000
#: A misspelled hit counts this much less for each edit.
EDIT_DISCOUNT = 0.8
OPENING, CLOSING = "\"'“‘«„‹", "\"'”’»“›"
REPORTING = frozenset("quote quoted quotes quoting said says saying called calling calls word words term terms wrote writes phrase insult insults slur slurs zitat zitiert sagte wort mot terme dit citation palabra dijo".split())
ADDRESS = frozenset("you your yours yourself u ur are is du dich ihr tu vous eres".split())


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The Levenshtein automata of all terms, run over the trie of the terms and made deterministic as words need it.

    A state is the set of (trie node, edits so far); the automaton accepts a word at a term's node within its edits."""

    def __init__(self, terms: list[str], limit: int = 1 << 16):
        self.children, self.term, self.most = [{}], [None], [0]
        for t in terms:
            node, allowed = 0, edits_allowed(t)
            self.most[0] = max(self.most[0], allowed)
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
            self.term[node] = t
        self.limit = limit
        self._reset()

    def _reset(self):
        self.start = self._close({(0, 0)})
        self.steps: dict[frozenset, dict[str, frozenset]] = {}

    def _close(self, state) -> frozenset:
        """With characters of terms that the word lacks."""
        least: dict[int, int] = {}
        todo = list(state)
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or least.get(node, 99) <= e:
                continue
            least[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        return frozenset(least.items())

    def step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, e in state:
            out.add((node, e + 1))
            for x, child in self.children[node].items():
                out.add((child, e if x == c else e + 1))
        return self._close(out)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits, and the edits; ties go to the smaller term."""
        state = self.start
        for c in word:
            known = self.steps.get(state)
            if known is None:
                if len(self.steps) > self.limit:
                    self.steps.clear()
                known = self.steps[state] = {}
            after = known.get(c)
            if after is None:
                after = known[c] = self.step(state, c)
            state = after
            if not state:
                return None
        found = [(e, self.term[node]) for node, e in state if self.term[node] is not None and e <= edits_allowed(self.term[node])]
        if not found:
            return None
        e, t = min(found)
        return t, e


class _Matches(dict):
    """Matches of words seen lately; words of the ordinary vocabulary match nothing unless they are terms."""

    def __init__(self, terms: list[str], ordinary: frozenset[str]):
        super().__init__()
        self.automaton, self.ordinary = Automaton(terms), ordinary

    def __missing__(self, word: str):
        if len(self) > 1 << 18:
            self.clear()
        found = self.automaton.match(word)
        if found and found[1] and word in self.ordinary:
            found = None
        self[word] = found
        return found


def quoted(text: str, begin: int, end: int) -> bool:
    """Whether quotation marks enclose the place on its line, within 80 characters on each side."""
    left = text[max(text.rfind("\n", 0, begin) + 1, begin - 80) : begin]
    stop = text.find("\n", end)
    right = text[end : min(len(text) if stop < 0 else stop, end + 80)]
    opened = sum(left.count(c) for c in "\"“«„")
    return opened % 2 == 1 and any(c in right for c in "\"”»“")


FEATURES = 5


def features(text: str, matches: _Matches) -> list[float]:
    """Hits weighed by their windows as abusive and as quoted, their density, those near others, and whether any abuses.

    A misspelled hit counts in the same features as a whole one, discounted by its edits, so it has weights learned from
    both."""
    out = [0.0] * FEATURES
    lowered = text.lower()
    words = TOKEN.findall(lowered)
    if not words:
        return out
    hit = {w for w in set(words) if matches[w]}
    if not hit:
        return out
    abuses = quotes = near = amount = 0.0
    spans = [(m.start(), m.end()) for m in TOKEN.finditer(lowered)]
    at = [i for i, w in enumerate(words) if w in hit]
    places = np.array(at)
    for i in at:
        weight = EDIT_DISCOUNT ** matches[words[i]][1]
        window = words[max(0, i - WINDOW) : i + WINDOW + 1]
        told = sum(w in REPORTING for w in window)
        close = int(np.count_nonzero(np.abs(places[np.searchsorted(places, i - WINDOW) :][: 2 * WINDOW + 1] - i) <= WINDOW)) - 1
        inside = quoted(lowered, *spans[i])
        abuse = 1.0 / (1.0 + math.exp(2.0 * inside + 1.0 * min(told, 2) - 0.5 * min(close, 2) - 0.25 * any(w in ADDRESS for w in window) - 1.0))
        abuses += weight * abuse
        quotes += weight * (1.0 - abuse)
        amount += weight
        near += weight * (close > 0)
    return [math.log1p(abuses), math.log1p(quotes), math.log1p(100.0 * amount / len(words)), math.log1p(near), float(abuses > 0.3)]


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    ordinary: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    bias: float = -2.0

    def score(self, x: list[float]) -> float:
        z = self.bias + sum(a * b for a, b in zip(self.weights, x, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def remainder(col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % 5


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, toxic) of at most rows labelled documents outside the held-out fifth, those of least hash.

    A doc_id gives one row, of its rows' texts the one of least hash."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(remainder() != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # a feature: the documented bound
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The lexicon: words that say much of the label in the sample. The model: logistic weights of the features.

    A word enters with a log-likelihood ratio of at least 15 over the share of toxic rows and a share of its own of at
    least a half. Words near a term that are common in rows that are not toxic count as ordinary vocabulary."""
    known = sample(docs, labels, rows).select("doc_id", "text", (F.col("toxic") == 1).cast("int").alias("y"))
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    n, t = int(total["n"]), int(total["t"])
    if not t or t == n:
        return Model(bias=math.log((t + 1) / (n - t + 9)))
    base = t / n
    words = known.select("doc_id", "y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+(?:[@$!*][\p{L}\p{N}]+)*"), F.lit(0)))).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n"), F.sum("y").alias("t"))
    share = F.col("t") / F.col("n")
    gain = F.col("t") * F.log(share / F.lit(base)) + F.when(F.col("t") < F.col("n"), (F.col("n") - F.col("t")) * F.log((1 - share) / F.lit(1 - base))).otherwise(0.0)
    lexicon = [r["w"] for r in counts.where("t > 0").withColumn("gain", gain).where((F.col("gain") >= 15) & (share >= 0.5)).select("w").collect()]
    lexicon.sort()

    def near(batches):
        automaton = Automaton(lexicon)
        for batch in batches:
            keep = [bool((m := automaton.match(w)) and m[1]) for w in batch.column("w").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    common = counts.where((F.col("n") >= 3) & (F.col("t") < 0.5 * F.col("n"))).select("w")
    ordinary = sorted(r["w"] for r in common.mapInArrow(near, "w string").collect())

    def measure(batches):
        matches = _Matches(lexicon, frozenset(ordinary))
        for batch in batches:
            x = [features(text or "", matches) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    rows_of = known.select("y", "text").mapInArrow(measure, "y int, x array<double>").collect()
    weights, bias = fit(np.array([r["x"] for r in rows_of], float), np.array([r["y"] for r in rows_of], float))
    return Model(lexicon, ordinary, weights, bias)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[list[float], float]:
    """Logistic regression by Newton steps, ridge on all weights but the bias."""
    order = np.lexsort((*x.T, y))
    x, y = np.hstack([x[order], np.ones((len(x), 1))]), y[order]
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row.

    Null and empty texts get the score of a text without hits. Every row is scored by itself; a null doc_id counts as
    the empty text for held_out. Without labels of both kinds there is no lexicon and every score is the base rate."""

    def run(batches):
        matches = _Matches(model.terms, frozenset(model.ordinary))
        for batch in batches:
            scores = [model.score(features(x.as_py() or "", matches)) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    out = texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = texts(table(spark, sf_dir, "documents"))
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
