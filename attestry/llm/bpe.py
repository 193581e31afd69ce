"""Byte-level BPE as a monoid: encode halves, join neighbours at their boundary, decode up the tree."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts

LEAF = 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Bpe:
    """A byte-level BPE over given ranks and split pattern; cache: how many matches keep their ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 1 << 18):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pairs = lru_cache(1 << 16)(self._apart)
        self.held, self.limit = _Held(self), cache

    def leaf(self, piece: bytes) -> list[int]:
        """The definition: merge the neighbours of least rank, leftmost first, until none can merge."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        scores = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            least = min(scores)
            if least == 1 << 60:
                break
            i = scores.index(least)
            parts[i] += parts[i + 1]
            del parts[i + 1], scores[i]
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return [ranks[p] for p in parts]

    def _apart(self, a: int, b: int) -> bool:
        """Whether the tokens a, b stay as they are side by side: the encoding of both together is a, b."""
        return self.leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the concatenation, of the ids of its halves.

        A sequence of tokens is the encoding of its bytes exactly if every two neighbours stay apart. So tokens outside
        a re-encoded boundary window are final when the window's ends stay apart from them; else the window doubles."""
        if not left or not right:
            return left or right
        if self.pairs(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            ids = self.leaf(self.decode(left[i:] + right[:j]))
            if (i == 0 or self.pairs(left[i - 1], ids[0])) and (j == len(right) or self.pairs(ids[-1], right[j])):
                return left[:i] + ids + right[j:]
            k *= 2

    def encode_match(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        level = [self.leaf(piece[i : i + LEAF]) for i in range(0, len(piece), LEAF)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids. Surrogates cannot occur in Spark's strings."""
        if len(self.held) > self.limit:
            self.held.clear()
        return b"".join(map(self.held.__getitem__, self.split(text)))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the leaves, concatenated up the tree."""
        level = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + 4096])) for i in range(0, len(ids), 4096)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


class _Held(dict):
    """Ids of matches seen lately."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, match: str) -> bytes:
        ids = np.array(self.bpe.encode_match(match.encode("utf-8")), "<u4").tobytes()
        if len(match) <= 64:
            self[match] = ids
        return ids


@lru_cache(4)
def bpe_of(path: str, pattern: str) -> Bpe:
    return Bpe(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """For each row: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (binary).

    Null and empty text: no tokens. Rows are independent of each other, so repeated rows and null doc_id just pass."""

    def run(batches):
        bpe = bpe_of(ranks_path, pattern)
        for batch in batches:
            ids = [bpe.encode(x or "") for x in batch.column("text").to_pylist()]
            back = [bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encode_documents() with digests in place of ids and bytes, made beside them so that they stay in the worker."""

    def run(batches):
        bpe = bpe_of(ranks_path, pattern)
        for batch in batches:
            count, first, second = [], [], []
            for x in batch.column("text"):
                ids = bpe.encode(x.as_py() or "")
                count.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
