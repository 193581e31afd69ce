"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import texts

END_ID = 0


@lru_cache(2)
def tokenizer_of(path: str):
    """An encoder with the ids of the tokenizers library for a byte-level BPE file, special tokens of the text included.

    The file's vocabulary and split pattern run in tiktoken, which gives the same ids in a quarter of the time; files of
    another kind run in the tokenizers library."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = spec["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not spec["model"].get("ignore_merges")
    if not plain:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: np.asarray(fast.encode(text, allowed_special="all"), np.uint32)


@dataclass
class Piece:
    """A run of a document's ids that waits for a place. loss: how many of its tokens bear loss."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int
    mask: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def loss(self) -> int:
        return len(self.ids) if self.mask is None else int(self.mask.sum())

    def cut(self, at: int) -> tuple[Piece, Piece]:
        """Both pieces hold ids of their own, so that a waiting tail doesn't keep its document's."""
        mask = (None, None) if self.mask is None else (self.mask[:at].copy(), self.mask[at:].copy())
        return Piece(self.doc_id, self.start, self.ids[:at].copy(), self.doc_tokens, mask[0]), Piece(self.doc_id, self.start + at, self.ids[at:].copy(), self.doc_tokens, mask[1])


class Packer:
    """Fills one sequence at a time from a bounded pool of pieces; every piece leaves the pool in some sequence.

    The next piece is the one among those that fit whose demand (tokens, one segment, loss-bearing tokens, each as a
    share of its limit) has the largest dot product with what the sequence has left. When none fits, or one segment is
    left, a piece is cut to fill the sequence. A sequence that cannot be filled is closed at a power of two of tokens,
    where no padding is due, and the rest of its last pieces goes back to the pool."""

    def __init__(self, tokens: int = 1024, segments: int = 64, loss: int | None = None, pool: int = 4096):
        self.limits = np.array([tokens, segments, loss or tokens], float)
        self.tokens, self.segments, self.loss, self.most = tokens, segments, loss or tokens, pool
        self.pool: list[Piece] = []
        self.sequence = 0

    def add(self, piece: Piece):
        """The placed pieces (piece, sequence, offset) that this one sets free."""
        if len(piece) >= self.tokens and piece.mask is None:
            at = len(piece) // self.tokens * self.tokens
            whole, piece = piece.cut(at)
            for i in range(0, at, self.tokens):
                yield from self._close([Piece(whole.doc_id, whole.start + i, whole.ids[i : i + self.tokens], whole.doc_tokens)])
        if len(piece):
            self.pool.append(piece)
        while len(self.pool) >= self.most:
            yield from self._drain(self.most // 2)

    def finish(self):
        yield from self._drain(0)

    def _close(self, pieces: list[Piece]):
        at = 0
        for p in pieces:
            yield p, self.sequence, at
            at += len(p)
        self.sequence += 1

    def _drain(self, keep: int):
        pool = self.pool
        demand = np.array([[len(p), 1, p.loss] for p in pool], float).reshape(-1, 3)
        alive = np.ones(len(pool), bool)
        while alive.sum() > keep:
            left, chosen = self.limits.copy(), []

            def take(i: int, at: int | None = None):
                p = pool[i]
                if at is not None and at < len(p):
                    p, rest = p.cut(at)
                    pool[i], demand[i] = rest, (len(rest), 1, rest.loss)
                else:
                    alive[i] = False
                chosen.append(p)
                left[:] -= (len(p), 1, p.loss)

            while left[0] > 0 and left[1] > 0 and alive.any():
                last = left[1] == 1
                fits = alive & (demand <= left).all(axis=1)
                if last:
                    fits &= demand[:, 0] == left[0]
                if fits.any():
                    score = np.where(fits, (demand / self.limits) @ (left / self.limits), -1)
                    take(int(score.argmax()))
                    continue
                longer = alive & (demand[:, 0] >= (left[0] if last else 1))
                if last and not longer.any():
                    longer = alive
                i = int(np.where(longer, demand[:, 0], -1).argmax())
                at = self._room(pool[i], int(left[0]), int(left[2]))
                if not at:
                    break
                take(i, at)
            used = sum(map(len, chosen))
            if used < self.tokens:
                target = 1 << (used.bit_length() - 1)
                while used > target:
                    p = chosen.pop()
                    used -= len(p)
                    if used < target:
                        p, rest = p.cut(target - used)
                        chosen.append(p)
                        used = target
                    else:
                        rest = p
                    pool.append(rest)
                    demand = np.vstack([demand, [len(rest), 1, rest.loss]])
                    alive = np.append(alive, True)
            yield from self._close(chosen)
        self.pool = [p for p, a in zip(pool, alive, strict=True) if a]

    @staticmethod
    def _room(p: Piece, tokens: int, loss: int) -> int:
        """How many leading ids of p fit."""
        if p.mask is None:
            return min(len(p), tokens, loss)
        over = np.searchsorted(np.cumsum(p.mask), loss, side="right")
        return int(min(len(p), tokens, over))


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, tokens: int = 1024, segments: int = 64, loss: int | None = None, pool: int = 4096) -> DataFrame:
    """A row for each piece of each document; every token of plain documents bears loss.

    A document is the ids of its text, then id 0; null or empty text: that id alone. Each partition packs its own rows,
    holding at most pool pieces, so nothing is shuffled; sequence_id is partition << 32 + running number, the same again
    when a lost partition is read again. Repeated rows are packed each; a null doc_id is carried through. Extra columns
    are left behind. Empty table: no rows."""

    def run(batches):
        encode = tokenizer_of(tokenizer_path)
        packer = Packer(tokens, segments, loss, pool)
        base = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def note(placed):
            for p, sequence, at in placed:
                rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens, base + sequence, at))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID))
                note(packer.add(Piece(doc_id, 0, ids, len(ids))))
                if len(rows) >= 8192:
                    yield _rows(rows)
                    rows.clear()
        note(packer.finish())
        if rows:
            yield _rows(rows)

    return texts(docs).mapInArrow(run, SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
