"""The training-data operators against brute force, round trips and held-out labels."""

import base64
import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import audio, bpe, html, jaccard_join, line_dedup, packing, quality, suffix_array, suffix_dedup, toxicity, warc
from attestry.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.01"
LONG = " ".join(f"w{i % 97}" for i in range(30_000))


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def odd_rows():
    """Nulls, empty and blank texts, repeated rows and ids, ties, one very long text."""
    return [(None, None), (None, "alpha beta"), (1, None), (1, ""), (2, " \n\t"), (3, "alpha beta"), (3, "alpha beta"), (4, "alpha beta"), (5, "x"), (6, LONG), (7, LONG + " tail"), (8, "é" * 70 + "z"), (9, "q" + "é" * 60)]


# -- suffix arrays -------------------------------------------------------------


def test_two_stage_sort():
    random.seed(3)
    for _ in range(150):
        n, letters = random.randint(2, 120), random.choice([2, 3, 20])
        data = np.array([random.randint(0, letters) for _ in range(n)] + [0, 1], np.uint8)
        wanted = np.zeros(len(data), bool)
        wanted[: n - 1] = np.random.rand(n - 1) < random.choice([0.2, 1])
        assert suffix_array.two_stage(data, wanted, 200).tolist() == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: bytes(data[i:]))


def brute_repeats(rows, width=50):
    data = [((1 << 63) - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in data:
        for i in range(len(b) - width + 1):
            s = b[i : i + width]
            first[s] = min(first.get(s, 1 << 63), d)
    out = []
    for (d, b), (raw, _) in zip(data, rows, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((raw, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(map(str, out))


@pytest.mark.parametrize("seed", [0, 1])
def test_suffix_dedup(spark, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdefg hij") for _ in range(rng.randint(40, 130))) for _ in range(12)]
    rows = [(rng.randint(0, 90), "".join(rng.choice([rng.choice(passages), "".join(rng.choice("xyz é") for _ in range(rng.randint(1, 60)))]) for _ in range(rng.randint(0, 6)))) for _ in range(100)]
    rows += [(1000, "a" * 300), (1001, "a" * 120 + "b" + "a" * 80), (1002, "\0" * 200), (1003, "\0" * 60 + "q"), *odd_rows()]
    got = suffix_dedup.remove_repeats(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert sorted(str((r[0], r[1], r[2], r[3], bytes(r[4]))) for r in got) == brute_repeats(rows)


def test_suffix_dedup_columns(spark):
    df = frame(spark, odd_rows()).withColumns({"g": F.lit(1), "did": F.lit("x"), "kept": F.lit(2)})
    out = suffix_dedup.remove_repeats(df, whole_characters=True)
    assert out.select("rest.g", "rest.did", "rest.kept").distinct().collect() == [(1, "x", 2)]
    for r in out.collect():
        bytes(r["kept"]).decode("utf-8")
    assert suffix_dedup.remove_repeats(frame(spark, [])).collect() == []


# -- Jaccard join ---------------------------------------------------------------


def shingles(text, k):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset() if not w else frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute_components(rows, k, a, b):
    sets = [(10**18 if d is None else d, shingles(t, k)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, (d, s) in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if b * n >= a * (len(s) + len(sets[j][1]) - n):
                x, y = find(d), find(sets[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted((str(raw), len(s), "-" if raw is None else str(find(d) if s else d)) for (d, s), (raw, _) in zip(sets, rows, strict=True))


@pytest.mark.parametrize(("k", "a", "b", "part"), [(3, 90, 100, 512), (5, 80, 100, 512), (2, 4, 5, 24)])
def test_jaccard_join(spark, monkeypatch, k, a, b, part):
    monkeypatch.setattr(jaccard_join, "PART", part)
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 12, 20, 40, 60, 150]))] for _ in range(40)]
    rows = list(odd_rows())
    for _ in range(400):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.sample(words, rng.randint(0, 2))
        s = rng.choice([" ", "  ", "\n"]).join(t)
        rows.append((rng.randint(0, 2000), rng.choice([s, s.upper(), s + " "])))
    got = jaccard_join.near_duplicates(frame(spark, rows), k, (a, b)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], "-" if r["doc_id"] is None else str(r["component_id"])) for r in got) == brute_components(rows, k, a, b)


def test_jaccard_join_long_chain(spark, monkeypatch):
    """One component whose members are linked with their neighbours alone, so that hubs reach few of them."""
    monkeypatch.setattr(jaccard_join, "PART", 64)
    rows = [(5000 - i, " ".join(f"w{j}" for j in range(2 * i, 2 * i + 60))) for i in range(1500)]
    rows += [(9000 + i, " ".join(f"v{j}" for j in range(40 * i, 40 * i + 60))) for i in range(50)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(frame(spark, rows), 3, (80, 100)).collect()}
    assert all(got[d] == 3501 for d, _ in rows[:1500]) and all(got[d] == d for d, _ in rows[1500:])


def test_keys_leave_frequent_ones_out():
    """Linked sets share one of the first keys of both in any order of the keys, here by how many sets have them."""
    rng = np.random.default_rng(6)
    passage = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    sets = []
    for _ in range(60):
        own = rng.integers(0, 1 << 63, int(rng.integers(20, 300)), dtype=np.uint64)
        base = np.concatenate([passage, own])
        sets += [base, np.concatenate([base[3:], rng.integers(0, 1 << 63, 3, dtype=np.uint64)])]
    sets = [np.unique(x) for x in sets]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    keys, doc, section, most = jaccard_join.keys_of(np.concatenate(sets), cuts, 4, 5)
    known, of, often = np.unique(keys, return_inverse=True, return_counts=True)
    chosen = [set() for _ in sets]
    for x in np.unique(section):
        at = np.flatnonzero(section == x)
        at = at[np.lexsort((keys[at], often[of[at]]))][: most[at[0]]]
        chosen[doc[at[0]]] |= set(keys[at].tolist())
    for i in range(0, len(sets), 2):
        x, y = sets[i], sets[i + 1]
        common = len(np.intersect1d(x, y))
        assert 5 * common < 4 * (len(x) + len(y) - common) or chosen[i] & chosen[i + 1]


def test_jaccard_join_empty(spark):
    assert jaccard_join.near_duplicates(frame(spark, [])).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    looped = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: label[x] for x in looped}


# -- lines, quality, toxicity -------------------------------------------------------


def test_line_dedup(spark):
    common = "This line is common to many of the documents here"
    rows = [(i, f"own {i}\n  {common.upper() if i % 2 else common}\t\nshort") for i in range(1, 7)] + [(7, common + "\n" + common), (8, "only\n" + common[:30]), *odd_rows()]
    got = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(frame(spark, rows).withColumn("th", F.lit(1))).collect()}
    assert got[(1, "own 1\nshort")] == (3, 1) and got[(7, common + "\n" + common)] == (2, 0) and got[(1, None)] == (1, 0)
    assert sum(d for _, d in got.values()) == 6
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []


def test_line_runs_compact(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, 2, str(tmp_path / "runs"))
    for i in range(6):
        rows = [(h, h, 2, i) for h in range(i, i + 3)]
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, n_docs long, keeper long"))
    assert [len(x) for x in runs.levels] == [0, 1, 1] and len(runs.repeats) < 4
    every = runs.novel(spark.createDataFrame([(h, h, 1, 1) for h in range(9)], "h1 long, h2 long, n_docs long, keeper long"))
    assert [r["h1"] for r in every.collect()] == [8]
    got = runs.frequent(6)
    assert sorted((r["h1"], r["keeper"]) for r in got.collect()) == [(h, h) for h in range(2, 6)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    runs.forget()


def base_row(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_base(spark):
    rng = random.Random(2)
    texts = [x for _, x in odd_rows()] + [" ".join(rng.choice("ab c# d* é").strip() or "z" for _ in range(rng.randint(0, 200))) + "\nline\nline\n \n" for _ in range(30)]
    rows = list(enumerate(texts))
    out = quality.quality_rules(frame(spark, rows).withColumn("th", F.lit(1)), [0.0] * 8, 0.0).collect()
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in out}
    assert got == {i: base_row(t) for i, t in rows}
    assert all(r["kept"] == (not r["base_failed"]) for r in out)


def test_quality_weights(spark):
    xxhash = pytest.importorskip("xxhash")
    rows = [(1, "good words here"), (2, "bad*** junk***"), (3, "good text")]
    got = quality.learn(frame(spark, rows), spark.createDataFrame([(1,), (3,), (None,)], "doc_id long"), 16)
    raw, target = np.ones(16), np.ones(16)
    for i, text in rows:
        h = [np.int64(np.uint64(xxhash.xxh64(w[-3:].encode(), seed=42).intdigest()).astype(np.int64)) for w in text.split()]
        pairs = [xxhash.xxh64(np.int64(b).tobytes(), seed=int(np.int64(xxhash.xxh64(np.int64(a).tobytes(), seed=42).intdigest() - (1 << 64) if xxhash.xxh64(np.int64(a).tobytes(), seed=42).intdigest() >> 63 else xxhash.xxh64(np.int64(a).tobytes(), seed=42).intdigest())) & (1 << 64) - 1).intdigest() for a, b in zip(h, h[1:], strict=False)]
        for x in [*(int(x) % 16 for x in h), *(p % 16 for p in pairs)]:
            raw[x] += 1
            target[x] += i != 2
    assert np.allclose(got, np.log(target / target.sum()) - np.log(raw / raw.sum()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality_held_out(spark):
    """Trusted documents outside a fifth by crc32 are the target; the fifth tells good from junk."""
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    weights = quality.learn(docs, quality.trusted_of(labels.where(toxicity.remainder() != 0)))
    held = quality.quality_rules(docs.select("doc_id", "text"), weights).join(labels.where(toxicity.remainder() == 0), "doc_id")
    out = held.where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")), F.count("*")).collect()
    kept = {q: share for q, share, _ in out}
    assert kept[1] > 0.98 and kept.get(0, 0.0) < 0.1


def test_quality_odd_rows(spark):
    weights = quality.learn(frame(spark, odd_rows()), spark.createDataFrame([(3,), (None,)], "doc_id long"), 64)
    out = quality.quality_rules(frame(spark, odd_rows()).withColumn("lang", F.lit("x")), weights).collect()
    assert len(out) == len(odd_rows()) and all(r["lang"] == "x" and r["kept"] is not None for r in out)
    assert quality.quality_rules(frame(spark, []), weights).collect() == []
    assert quality.learn(frame(spark, []), spark.createDataFrame([], "doc_id long"), 4) == [0.0] * 4


@pytest.mark.parametrize(("word", "want"), [("moron", ("moron", 0)), ("moran", ("moron", 1)), ("mooron", ("moron", 1)), ("scum", ("scum", 0)), ("scun", None), ("disgustng", ("disgusting", 1)), ("disgutsing", ("disgusting", 2)), ("pathetc", ("pathetic", 1)), ("other", None)])
def test_levenshtein(word, want):
    assert toxicity.Automaton(["moron", "scum", "disgusting", "pathetic"]).match(word) == want


def test_levenshtein_against_table():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(5)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 10))) for _ in range(12)]
    automaton = toxicity.Automaton(terms)
    for _ in range(600):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 11)))
        best = min(((d, t) for t in terms if (d := distance(w, t)) <= toxicity.edits_allowed(t)), default=None)
        assert automaton.match(w) == (None if best is None else (best[1], best[0]))


def test_quotation_counts_less():
    matches = toxicity._Matches(["moron"], frozenset())
    abuse, quote = toxicity.features("you are a moron", matches), toxicity.features('they said the word "moron" is an insult', matches)
    assert abuse[0] > 2 * quote[0] and quote[1] > abuse[1]


SF1 = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF1), reason="no test tables")
def test_toxicity_held_out(spark):
    """Toxic documents of the held-out fifth are found, and what is flagged is toxic; always saying 0 finds none."""
    out = toxicity.query(spark, SF1).join(spark.read.parquet(f"{SF1}/labels.parquet"), "doc_id").where("held_out").select("predicted", "toxic").collect()
    hit = sum(p == t == 1 for p, t in out)
    assert hit >= 0.85 * sum(t for _, t in out) and hit >= 0.95 * sum(p for p, _ in out) and hit > 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_toxicity_misspelled(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    clean = "The ward opened early and the staff read the notes of the day before lunch. "
    rows = [(1, clean * 2), (2, clean + "You are a mooron, you disgustng idoit, pathetc and worthles. " + clean), (3, clean + "They said the word \"moron\" is an insult. " * 1 + clean * 3), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in toxicity.score_documents(frame(spark, rows), model).collect()}
    assert [got[i]["predicted"] for i in (1, 2, 3, 4, 5)] == [0, 1, 0, 0, 0]
    exact = toxicity.Model(model.terms, model.ordinary, model.weights, model.bias)
    plain = toxicity._Matches(exact.terms, frozenset(exact.ordinary))
    for w in ("mooron", "disgustng", "idoit", "pathetc", "worthles"):
        plain[w] = None
    assert exact.score(toxicity.features(rows[1][1], plain)) < 0.5 < got[2]["score"]


def test_toxicity_odd_rows(spark):
    none = toxicity.score_documents(frame(spark, odd_rows()), toxicity.learn(frame(spark, odd_rows()), spark.createDataFrame([], "doc_id long, toxic int"))).collect()
    assert len(none) == len(odd_rows()) and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in none)
    rows = [(1, "you moron " * 30), (1, "calm " * 30), (6, "calm " * 30), (None, "x"), (7, None)]
    model = toxicity.learn(frame(spark, rows).withColumn("toxic", F.lit(3)), spark.createDataFrame([(1, 1), (6, 0), (7, 0), (None, 1)], "doc_id long, toxic int"))
    out = toxicity.score_documents(frame(spark, rows).withColumn("score", F.lit("x")), model)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 5
    assert toxicity.score_documents(frame(spark, []), model).collect() == []


# -- tokens ------------------------------------------------------------------------


def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


TEXTS = ["", "a" * 5000, "ab" * 3000, "=-" * 999, " " * 3000 + "x", "é" * 700, "日本語" * 300, "thein" * 4000, "I've  seen\n\n12345 things!!", LONG]


def test_bpe_round_trip(spark):
    tiktoken = pytest.importorskip("tiktoken")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    rows = [*enumerate(TEXTS), *((100 + i, t) for i, (_, t) in enumerate(odd_rows()))]
    out = bpe.encode_documents(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == known.encode_ordinary(text) and bytes(r["decoded"]).decode() == text and r["n_tokens"] * 4 == len(r["ids"])


def test_bpe_joins():
    rng = random.Random(4)
    code = bpe.bpe_of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for _ in range(200):
        piece = "".join(rng.choice("thearion") for _ in range(rng.randint(2, 200))).encode()
        at = rng.randint(1, len(piece) - 1)
        assert code.join(code.leaf(piece[:at]), code.leaf(piece[at:])) == code.leaf(piece)


def test_tokenizer_ids():
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    slow, fast = tokenizers.Tokenizer.from_file(path), packing.tokenizer_of(path)
    for text in [*TEXTS, "a<|endoftext|>b"]:
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("segments", [2, 64])
def test_packing(spark, segments):
    import zlib

    rng = random.Random(segments)
    rows = [(i, " ".join(rng.choice(["the", "tion", "zq", "12"]) for _ in range(rng.choice([0, 1, 3, 50, 400, 3000])))) for i in range(120)] + [(1000, None), (None, "x")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack(frame(spark, rows), path, segments=segments, pool=32).collect()
    encode, texts = packing.tokenizer_of(path), dict(rows)
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids, at = np.append(encode(texts[d] or ""), np.uint32(0)).astype("<u4"), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert len(pieces) <= segments and at & (at - 1) == 0 and at <= 1024


def test_packing_loss_limit():
    packer = packing.Packer(tokens=64, segments=8, loss=20, pool=16)
    rng = np.random.default_rng(1)
    placed = []
    for i in range(60):
        ids, mask = np.arange(n := int(rng.integers(1, 90)), dtype=np.uint32), rng.random(n) < 0.4
        placed += packer.add(packing.Piece(i, 0, ids, n, mask))
    placed += packer.finish()
    totals = {}
    for p, s, _ in placed:
        t = totals.setdefault(s, [0, 0, 0])
        t[0], t[1], t[2] = t[0] + len(p), t[1] + 1, t[2] + p.loss
    assert all(t[0] <= 64 and t[1] <= 8 and t[2] <= 20 for t in totals.values())


def test_packing_waiting_tails_are_small():
    """A piece that waits holds its own ids, not its document's."""
    packer = packing.Packer(pool=64)
    for i in range(40):
        list(packer.add(packing.Piece(i, 0, np.arange(200_001, dtype=np.uint32), 200_001)))
    held = sum((p.ids if p.ids.base is None else p.ids.base).nbytes for p in packer.pool)
    assert packer.pool and held <= 4 * sum(map(len, packer.pool))
    assert packing.Piece(1, 0, np.arange(9, dtype=np.uint32), 9).cut(4)[1].ids.base is None


def test_packing_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack(frame(spark, odd_rows()).withColumn("start", F.lit("x")), path).collect()
    assert sum(r["length"] for r in out) == sum(len(packing.tokenizer_of(path)(t or "")) + 1 for _, t in odd_rows())
    assert packing.pack(frame(spark, []), path).collect() == []


# -- pages and recordings ------------------------------------------------------------

PAGE = '<html lang=en><head><title>T &amp; x</title><style>p{}</style></head><body><nav><a href="/m">Menu</a></nav><div class="cookie-notice">We use cookies</div><article><h1>A &lt;B&gt;</h1><p>one <b>two</b><br>three<p>four<script>var a="</p>";</script> five</p><section id="comments"><p>first!</p></section></article><aside>side</aside><footer>end</footer></body></html>'


def test_blocks():
    assert html.blocks(PAGE) == [("A <B>", True), ("one two three", True), ("four five", True)]
    assert html.blocks("") == [] and html.blocks("plain  text") == [("plain text", False)]
    assert html.blocks("<p>a<!-- x > y --><p title='a>b'>c &nbsp; d") == [("a", False), ("c d", False)]
    assert ("Menu", False) in html.blocks(PAGE, everything=True)


def test_marked_wrappers_keep_articles():
    for mark in ('class="content-sidebar-wrap"', 'class="has-sidebar"', "class=no-sidebar", 'id="widget"'):
        assert html.blocks(f"<div {mark}><p>side</p><article><p>x <math><mi>y</mi></math></p></article></div>")[-1] == ("x y", True)
    assert html.blocks("<form><main>text</main></form>") == [("text", True)]
    assert html.blocks('<div class="sidebar cookie-notice">a</div><aside><article>b</article></aside><p>c') == [("c", False)]


def test_repeated_runs():
    tokens = [1, 2, 3, 9, 1, 2, 3, 8, 1, 2, 3, 7, 5, 6]
    counts, _ = html.repeated(np.array(tokens), np.array([0] * 4 + [1] * 4 + [2] * 6), 3)
    assert counts[[0, 4, 8]].tolist() == [3, 3, 3] and counts[[1, 9]].tolist() == [1, 1] and counts[-1] == 0


def test_host_boilerplate(spark):
    notice = "please read all of our many terms of use before going on to the rest"
    rows = [(i, f"http://h.example/{i}", f"<body><div>{notice}</div><div>story number {i} is about thing {i}</div></body>") for i in range(6)]
    rows += [(90, "http://other.example/", f"<body><div>{notice}</div></body>"), (91, None, None), (92, "odd", "<p>alone")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)), group=4).collect()}
    assert got[2] == ("story number 2 is about thing 2", 31) and got[90][0] == notice and got[91] == ("", 0) and got[92][0] == "alone"
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_large_host_counts_whole(spark):
    notice = "this notice is on only three pages of the host but it goes from all of them"
    rows = [(i, "http://h.example/", f"<div>story {i} " + " ".join(f"w{i}x{j}" for j in range(40)) + "</div>" + (f"<div>{notice}</div>" if i in (1, 20, 39) else "")) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    dealt, whole = (sorted(html.main_text(df, group=g).collect()) for g in (4, 256))
    assert dealt == whole and not any(notice in r["text"] for r in dealt) and all(f"story {r['page_id']} " in r["text"] for r in dealt)
    others = [(1000 + i, f"http://h{i % 40}.example/", f"<div>{' '.join(f'o{i}x{j}' for j in range(30))}</div>") for i in range(800)]
    more = html.main_text(df.unionByName(spark.createDataFrame(others, df.schema)), group=16).where("page_id < 1000").collect()
    assert sorted(more) == whole
    off = html.main_text(df, shared=10**6, many=10**6).collect()
    assert sum(notice in r["text"] for r in off) == 3


def test_few_copies_outside_articles_stay(spark):
    story = " ".join(f"word{j}" for j in range(40))
    rows = [(i, "http://h.example/", f"<div>{story if i < 3 else ' '.join(f'w{i}x{j}' for j in range(40))}</div>") for i in range(100)]
    out = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), group=16).collect()
    assert len(out) == 100 and all(r["text"] == story for r in out if r["page_id"] < 3)


def test_shared_passages_in_articles_stay(spark):
    passage = "a passage that several articles of one host quote word for word as it is"
    rows = [(i, "http://h.example/", f"<article><p>{passage}</p><p>own {i}</p></article>") for i in range(5)]
    out = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"{passage}\nown {r['page_id']}" for r in out)


def test_warc(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "u", ""), (1, "http://a.example/x", PAGE)]
    out = warc.derivatives(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1))).collect()
    assert len(out) == 12
    by = {(r["page_id"], r["record_type"]): r for r in out}
    for r in out:
        headers, block = warc.parse(bytes(r["record"]))
        assert headers["WARC-Type"] == r["record_type"] and warc.digest(block) == headers["WARC-Block-Digest"] and len(block) == r["content_length"]
        if r["record_type"] != "response":
            source, _ = warc.parse(bytes(by[(r["page_id"], "response")]["record"]))
            assert headers["WARC-Refers-To"] == source["WARC-Record-ID"] and headers["WARC-Source-Payload-Digest"] == source["WARC-Payload-Digest"] and headers["WARC-Refers-To-Date"] == source["WARC-Date"]
    _, text = warc.parse(bytes(by[(1, "conversion")]["record"]))
    _, fields = warc.parse(bytes(by[(1, "metadata")]["record"]))
    assert b"one two three\n" in text and b"title: T & x\r\n" in fields and b"outlink: /m\r\n" in fields and warc.digest(text).encode() in fields and b"http-content-type: text/html" in fields


def test_warc_files(spark, tmp_path):
    """Records of plain and compressed files give what their pages give; chunks, compression and charsets are undone."""
    import gzip
    import zlib

    rows = [(i, f"http://a.example/{i}", PAGE.replace("one", f"number{i}")) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = warc.derivatives(pages).collect()
    whole = [bytes(r["record"]) for r in made if r["record_type"] == "response"]
    (tmp_path / "a.warc").write_bytes(b"".join(whole[:10]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in whole[10:]))
    got = warc.derive_records(warc.read_records(spark, str(tmp_path))).collect()
    assert sorted(bytes(r["record"]) for r in got) == sorted(bytes(r["record"]) for r in made if r["record_type"] != "response")
    html = "<p>caf\u00e9 <!-- <a href=/no> --><a href=/yes>x</a><script>'<a href=/not>'</script>".encode("latin-1")
    body = zlib.compress(html)
    chunked = b"5\r\n" + body[:5] + b"\r\n" + f"{len(body) - 5:x}\r\n".encode() + body[5:] + b"\r\n0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nTransfer-Encoding: chunked\r\nContent-Encoding: deflate\r\n\r\n" + chunked
    record = warc.serialise([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("Content-Length", str(len(block)))], block)
    other = warc.serialise([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:2>"), ("Content-Length", "0")], b"")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.warc").write_bytes(other + record + other)
    out = {r["record_type"]: warc.parse(bytes(r["record"])) for r in warc.derive_records(warc.read_records(spark, str(tmp_path / "c"))).collect()}
    assert set(out) == {"metadata", "conversion"} and out["conversion"][1].decode() == "caf\u00e9 x"
    assert b"outlink: /yes" in out["metadata"][1] and b"/no" not in out["metadata"][1]
    assert warc.derive_records(spark.createDataFrame([(None,)], "record binary")).collect() == []
    assert warc.derivatives(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_audio_odd_rows(spark):
    codes = np.arange(60, dtype=np.uint32) * np.uint32(2654435761)
    rows = [(20, 60, codes.tobytes()), (21, 60, codes.tobytes()), (22, 60, codes.tobytes()), (22, 60, codes.tobytes()), (None, 60, codes.tobytes()), (40, 0, b""), (60, 3, codes[:3].tobytes())]
    got = {r["id"]: r for r in audio.align(spark.createDataFrame(rows, "id long, n_codes long, codes binary")).collect()}
    assert (got[20]["n_matches"], got[20]["best_match"]) == (2, 21) and got[60]["n_matches"] == 0 and got[40]["best_match"] is None
    assert audio.align(spark.createDataFrame([], "id long, n_codes long, codes binary")).collect() == []


def test_audio(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(0, 0.15, 64).tolist() for _ in range(41)]
    pcm = {i: audio.render(v) for i, v in enumerate(vectors)}
    pcm |= {50: (pcm[20] + rng.normal(0, 200, len(pcm[20]))).astype(np.int16), 51: pcm[40], 53: np.zeros(0, np.int16), 54: np.zeros(8000, np.int16), 60: pcm[20][audio.HOP * 20 :]}
    rows = [(i, x.astype("<i2").tobytes()) for i, x in pcm.items()] + [(None, None)]
    prints = audio.fingerprints(spark.createDataFrame(rows, "id long, sound binary").withColumn("codes", F.lit(1)), "id", "sound")
    got = {r["id"]: r for r in audio.align(prints).collect()}
    assert got[20]["n_matches"] == 2 and got[40]["best_match"] == 51 and got[40]["best_errors"] == 0.0
    assert got[60]["is_query"] and got[60]["n_matches"] >= 1 and got[60]["best_match"] == 20 and got[60]["best_offset"] == -20
    assert got[0]["n_matches"] == 0 and not got[7]["is_query"] and got[53]["n_codes"] == 0 and got[None]["n_matches"] == 0
    a = audio.fingerprint(pcm[1])
    assert audio.bit_errors(a, a, 0) == (0.0, len(a)) and audio.bit_errors(a, audio.fingerprint(pcm[2]), 0)[0] > 0.25
    rendered = audio.fingerprints(spark.createDataFrame([(1, vectors[1]), (2, None)], "id long, v array<double>"), "id", "v", rendered=True).collect()
    assert np.array_equal(np.frombuffer(bytes(rendered[0]["codes"]), "<u4"), a) and rendered[1]["n_codes"] == 0


def test_audio_recall(spark):
    """Against bit errors at every offset: a tenth of all bits differ, shifted; and the later copy of a passage."""
    rng = np.random.default_rng(8)
    prints = {}
    for i in range(20):
        a = rng.integers(0, 1 << 32, 160, dtype=np.uint32)
        flips = (rng.random((160, 32)) < 0.1) @ (1 << np.arange(32, dtype=np.uint64))
        prints[20 * i], prints[20 * i + 1] = a, (a ^ flips.astype(np.uint32))[7:]
    x, y, z = (rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (40, 30, 35))
    prints[1000], prints[1001] = np.concatenate([x, z]), np.concatenate([x, y, x, z])
    prints[1020], prints[1021] = np.full(50, 9, np.uint32), np.full(60, 9, np.uint32)
    rows = [(i, len(c), c.astype("<u4").tobytes()) for i, c in prints.items()]
    got = {r["id"]: r for r in audio.align(spark.createDataFrame(rows, "id long, n_codes long, codes binary")).collect()}
    true = set()
    for q in prints:
        for i in prints:
            a, b = prints[q], prints[i]
            if q % 20 == 0 and q != i and any(e <= 0.2 and n >= 32 for e, n in (audio.bit_errors(a, b, o) for o in range(32 - len(b), len(a) - 31))):
                true.add((q, i))
    found = {(q, r["best_match"]) for q, r in got.items() if r["best_match"] is not None}
    assert len(true) == 22 and found <= true and len(found) >= 0.9 * len(true)
    assert got[1000]["best_offset"] == -70 and got[1000]["best_errors"] == 0.0 and got[1020]["best_match"] == 1021


# -- pipeline --------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from attestry.llm.common import stored

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id", "text").collect()
        docs = stored(stage(spark, docs, SF), "test")
        after = docs.collect()
        if name == "n-gram Jaccard join":
            groups = {d: c for d, _, c in brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80, 100)}
            assert {str(r["doc_id"]) for r in after} == {d for d, c in groups.items() if d == c}
        if name == "suffix-array dedup":
            want = {r[0]: r for r in map(eval, brute_repeats([(r["doc_id"], r["text"]) for r in before]))}
            assert all(r["text"] == want[r["doc_id"]][4].decode("utf-8", "ignore") for r in after)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and all(r["n_chars"] == len(r["text"]) for r in after)
    assert hashlib.sha256(str(sorted(r["doc_id"] for r in after)).encode()).hexdigest()
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
