"""Main text of web pages: block structure first, then a suffix array over the token streams of each host."""

from __future__ import annotations

import math
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blob, column, light, mix, prefix_hash, span_hash, stored
from .suffix_dedup import _batches, bucket_of, split_by

PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements whose text is none.
RAW = frozenset("script style noscript template svg iframe object textarea title canvas audio video".split())
#: Elements that are not main text, whatever they hold.
ASIDE = frozenset("head nav header footer aside form button select dialog menu".split())
#: Those of them that stay apart when they hold an article or main.
TANGENT = ASIDE - {"form", "dialog"}
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that end when one of the same kind or their parent ends or opens.
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Words of class, id and role names that mark what surrounds the main text.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice popup promo promoted promotion related replies reply respond share sharing sidebar sidebars social sponsor sponsored subscribe toolbar widget widgets banner complementary contentinfo search".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def set_apart(name: str, attributes: str) -> bool:
    """Whether the element isn't main text by its kind, or by a class, id, role or label made of MARKS alone."""
    if name in ASIDE:
        return True
    if name in ("html", "body") or name in MAIN or not attributes:
        return False
    for m in NAMED.finditer(attributes):
        for one in (m[1] or m[2] or m[3] or "").split():
            words = WORD.findall(one)
            if words and all(w.lower() in MARKS for w in words):
                return True
    return bool(re.search(r"\shidden(?:\s|=|$)|display\s*:\s*none", attributes))


def blocks(html: str, everything: bool = False) -> list[tuple[str, bool]]:
    """(text, inside article or main) of the page's blocks in page order, without what is set apart.

    Character references are decoded, white space inside a block is one space. Unclosed elements end as HTML has it for
    paragraphs, items and cells. everything: keep what is set apart, for plain-text copies of whole pages."""
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, set apart, main
    apart = main = 0
    at = 0

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, main > 0))
            parts.clear()

    def pop():
        nonlocal apart, main
        name, a, m = stack.pop()
        apart -= a
        main -= m

    end = len(html)
    while at < end:
        m = PIECE.search(html, at)
        stop = m.start() if m else end
        if stop > at and not apart:
            parts.append(unescape(html[at:stop]))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                at = close.end() if close else end
            continue
        if name in BLOCK:
            flush()
        if closing:
            if any(x[0] == name for x in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name == "br" or name == "hr":
            parts.append(" ")
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            while stack and name in CLOSED_BY.get(stack[-1][0], ()):
                pop()
            a, is_main = (not everything) and set_apart(name, attributes), name in MAIN
            if is_main and apart and not main and not any(x[1] and x[0] in TANGENT for x in stack):
                stack = [(x[0], False, x[2]) for x in stack]  # what holds the main text isn't apart, whatever its name
                apart = 0
            stack.append((name, a, is_main))
            apart += a
            main += is_main
    flush()
    return out


def repeated(tokens: np.ndarray, page: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the number of distinct pages that hold the length tokens from it (0 where they cross pages).

    tokens: numbers of tokens, page: ascending numbers of pages. The suffix array is built by prefix doubling as far as
    length tokens; suffixes with a common prefix of that length are neighbours. Returns (count, order)."""
    n = len(tokens)
    rank = tokens.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    done = 1
    steps = []
    while done < length:
        steps.append(min(done, length - done))
        done += steps[-1]
    for step in steps:
        follow = np.full(n, -1, np.int64)
        follow[:-step] = rank[step:]
        cross = np.ones(n, bool)
        cross[:-step] = page[step:] != page[:-step]
        follow[cross] = -1
        order = np.lexsort((follow, rank))
        a, b = rank[order], follow[order]
        new = np.concatenate([[False], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
    whole = np.zeros(n, bool)
    if n >= length:
        whole[: n - length + 1] = page[length - 1 :] == page[: n - length + 1]
    order = np.lexsort((page, rank))
    r, p = rank[order], page[order]
    first = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])])
    pages = np.bincount(r[first], minlength=int(rank.max(initial=0)) + 1)
    return np.where(whole, pages[rank], 0), order


class Group:
    """The token streams of a group's pages as arrays: a hash of each token, of the run of length tokens from each place
    and of the run's least gram, in which the host takes part. Runs that cross pages have none."""

    def __init__(self, table: pa.Table, length: int):
        self.length = length
        self.texts, self.flags = column(table, "texts"), column(table, "inside")
        hosts = np.array(column(table, "hh"), np.int64).view(np.uint64)
        sizes = np.array([len(x) for x in self.texts], np.int64)
        held = [x.encode() for p in self.texts for x in p]
        data = np.frombuffer(b" ".join(held) + b" ", np.uint8) if held else np.zeros(0, np.uint8)
        end = np.flatnonzero(data == 32)
        begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in held])[:-1]]) if held else np.zeros(0, np.int64)
        self.block = np.searchsorted(starts, begin, side="right") - 1
        self.page = np.repeat(np.arange(len(sizes)), sizes)[self.block]
        self.inside = np.array([m for p in self.flags for m in p], bool)[self.block]
        host = hosts[self.page]
        self.tokens = mix(span_hash(prefix_hash(data), begin, end) ^ host)
        n, gram = len(self.tokens), max(1, length // 2)
        self.starts = np.flatnonzero(self.page[length - 1 :] == self.page[: n - length + 1]) if n >= length else np.zeros(0, np.int64)
        prefix = prefix_hash(self.tokens)
        self.hash = span_hash(prefix, self.starts, self.starts + length)
        if len(self.starts):
            at = np.arange(n - gram + 1)
            grams = span_hash(prefix, at, at + gram)
            low = np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1).min(axis=1)
            self.low = low[self.starts]
        else:
            self.low = self.hash

    def pages_of(self, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys of the runs at those places and how many pages have each."""
        page = self.page[self.starts[at]]
        order = np.lexsort((page, keys))
        k, p = keys[order], page[order]
        first = np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])])[: len(k)]
        return np.unique(k[first], return_counts=True)


def found_in(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among the sorted known ones, and where."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


def without(group: Group, common: np.ndarray) -> list[list[str]]:
    """The blocks of each page without the tokens of the common runs (one flag for each of group.starts).

    Runs that begin outside the main text leave it alone."""
    length, n = group.length, len(group.tokens)

    def cover(starts):
        mark = np.zeros(n + 1, np.int64)
        mark[starts] = 1
        mark[starts + length] -= 1
        return np.cumsum(mark[:-1]) > 0

    starts = group.starts[common]
    gone = np.where(group.inside, cover(starts[group.inside[starts]]), cover(starts))
    first = np.flatnonzero(np.concatenate([[True], group.block[1:] != group.block[:-1]])[:n])
    last = np.append(first[1:], n)
    touched = set(group.block[gone].tolist())
    out, block = [], 0
    for page in group.texts:
        kept = []
        for text in page:
            if block in touched:
                flags = gone[first[block] : last[block]].tolist()
                if not all(flags):
                    flags = long_runs(flags, length)
                text = " ".join(w for w, g in zip(text.split(" "), flags, strict=True) if not g)
            if text:
                kept.append(text)
            block += 1
        out.append(kept)
    return out


def long_runs(flags: list[bool], length: int) -> list[bool]:
    """flags without runs below length: a block that only begins or ends like its neighbours' boilerplate stays whole."""
    out, begin = list(flags), 0
    for i in range(len(flags) + 1):
        if i == len(flags) or flags[i] != flags[begin]:
            if flags[begin] and i - begin < length:
                out[begin:i] = [False] * (i - begin)
            begin = i
    return out


#: Hosts are broadcast up to so many; more are joined by a shuffle.
BROADCAST_HOSTS = 50_000
PARSED = "page_id long, url string, host string, texts array<string>, inside array<boolean>"


def parse(pages: DataFrame) -> DataFrame:
    """The blocks of each page: those of its article and main elements where it has any."""

    def run(batches):
        for batch in batches:
            texts, inside = [], []
            for x in batch.column("html"):
                found = blocks(x.as_py() or "")
                if any(m for _, m in found):
                    found = [b for b in found if b[1]]
                texts.append([t for t, _ in found])
                inside.append([m for _, m in found])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(texts, pa.list_(pa.string())), pa.array(inside, pa.list_(pa.bool_()))], ["page_id", "url", "host", "texts", "inside"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of().alias("host"), "html").mapInArrow(run, PARSED)


def host_of():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


ANSWER_DDL = "g long, kind int, keys binary, counts binary"
ANSWERS = pa.schema([("g", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
SENT_DDL = "b long, g long, keys binary, counts binary"
SENT = pa.schema([("b", pa.int64()), ("g", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def answers(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the answers of a kind, by ascending key."""
    rows = [(k, c) for k, c, x in zip(column(table, "keys"), column(table, "counts"), column(table, "kind"), strict=True) if x == kind]
    keys = np.frombuffer(b"".join(k for k, _ in rows), np.uint64)
    counts = np.frombuffer(b"".join(c for _, c in rows), np.uint32)
    order = np.argsort(keys, kind="stable")
    return keys[order], counts[order]


def _send(g: int, keys: np.ndarray, counts: np.ndarray, buckets: int, short: bool) -> pa.Table:
    """A row for each bucket; short: 32 bits of each key below those that name the bucket."""
    rows = []
    for b, at in split_by(bucket_of(keys, buckets)):
        rows.append((b, g, blob((keys[at] & LOW32).astype(np.uint32) if short else keys[at]), blob(np.minimum(counts[at], 65535).astype(np.uint16) if short else counts[at].astype(np.uint32))))
    return _batches(rows, SENT)


LOW32 = np.uint64(0xFFFFFFFF)


def _answer(kind: int, least: int, short: bool):
    """Sums the counts of each key over all parts; those of at least least pages go back to the parts that have them.

    Short keys go back as they came, above them the bucket's number."""

    @light
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32 if short else np.uint64) for x in column(table, "keys")]
        counts = np.concatenate([np.frombuffer(x, np.uint16 if short else np.uint32) for x in column(table, "counts")]).astype(np.int64)
        known, of = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(of, weights=counts, minlength=len(known)).astype(np.int64)
        enough = total >= min(least, 65535) if short else total >= least
        known, total = known[enough], total[enough]
        rows = []
        for g, part in zip(column(table, "g"), parts, strict=True):
            hit, at = found_in(part, known)
            if hit.any():
                keys = part[hit].astype(np.uint64)
                if short:
                    keys |= np.uint64(key[0].as_py()) << np.uint64(32)
                rows.append((g, kind, blob(keys), blob(total[at[hit]].astype(np.uint32))))
        return _batches(rows, ANSWERS)

    return run


def _send_grams(length: int, buckets: int):
    @light
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = Group(table, length)
        page = group.page[group.starts]
        new = np.flatnonzero(np.concatenate([[True], (group.low[1:] != group.low[:-1]) | (page[1:] != page[:-1])])[: len(page)])
        return _send(key[0].as_py(), *group.pages_of(group.low[new], new), buckets, True)

    return run


def _send_runs(length: int, buckets: int):
    @light
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left, length)
        known, _ = answers(right, 1)
        hit, _ = found_in(bucket_of(group.low, buckets).astype(np.uint64) << np.uint64(32) | group.low & LOW32, known)
        if not hit.any():
            return _batches([], SENT)
        _, numbers = np.unique(group.tokens, return_inverse=True)
        counts, _ = repeated(numbers, group.page, length)
        keys, first = np.unique(group.hash[hit], return_index=True)
        return _send(key[0].as_py(), keys, counts[group.starts[hit][first]], buckets, False)

    return run


def _remove(length: int, shared: int, many: int, share: float, outside: float):
    @light
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left, length)
        known, total = answers(right, 2)
        hit, at = found_in(group.hash, known)
        counts = np.where(hit, total[at], 0) if len(known) else np.zeros(len(hit), np.int64)
        held = np.array(column(left, "n"), np.int64)[group.page[group.starts]]
        common = np.where(group.inside[group.starts], (held >= many) & (counts >= share * held), (counts >= shared) & (counts >= outside * held)) & (counts >= 2)
        found = ["\n".join(x) for x in without(group, common)]
        return pa.Table.from_arrays([left.column("page_id"), left.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, length: int = 12, shared: int = 3, many: int = 20, share: float = 0.8, group: int = 256, outside: float = 0.05) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html).

    Hosts are counted, then dealt out: a host of more than group pages over several groups by page_id, small hosts
    together. Pages with an article or main element are those elements' text; on others all text that isn't set apart
    counts. A run of length tokens is boilerplate outside article and main if at least shared pages of the whole host
    hold it and they are a share of outside of its pages, and inside them if it is on at least a share of at least many pages: a passage that some articles quote
    stays. Null html: empty text; a null or odd url is a host of its own name ''. Repeated rows are pages of their own.
    Empty table: empty result.

    Groups count pages, buckets of hashes add the groups' counts up, so a run's count never depends on how a host is
    dealt. First the least gram of each run is counted, by which few runs are left; their 64-bit hashes follow."""
    host = host_of()
    per = pages.groupBy(host.alias("host")).agg(F.count("*").alias("n"))
    groups = max(1, pages.count() // group)
    per = stored(per.select("host", "n", F.ceil(F.col("n") / group).cast("int").alias("parts")), "hosts")
    if per.count() <= BROADCAST_HOSTS:
        per = F.broadcast(per)
    part = F.when(F.col("parts") > 1, F.xxhash64("host", F.pmod(F.xxhash64("page_id"), F.col("parts")))).otherwise(F.xxhash64("host"))
    dealt = parse(pages).join(per, "host").select(F.pmod(part, F.lit(groups)).alias("g"), "page_id", "url", F.xxhash64("host").alias("hh"), "n", "texts", "inside")
    least = max(2, min(shared, math.ceil(share * many)))
    grams = dealt.groupBy("g").applyInArrow(_send_grams(length, groups), SENT_DDL).groupBy("b").applyInArrow(_answer(1, least, True), ANSWER_DDL)

    def meet(function, schema, table):
        return dealt.groupBy("g").cogroup(table.groupBy("g")).applyInArrow(function, schema)

    runs = meet(_send_runs(length, groups), SENT_DDL, grams).groupBy("b").applyInArrow(_answer(2, least, False), ANSWER_DDL)
    return meet(_remove(length, shared, many, share, outside), "page_id long, url string, text string, n_chars long", runs)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return main_text(table(spark, sf_dir, "pages"))
