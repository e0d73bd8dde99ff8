"""Byte-level BPE with a rank queue under a hierarchical bitmap.

A pre-token's bytes form a linked list. Every adjacent pair that the vocabulary
merges stands in the bucket of its rank, as the position of its left part. A
bitmap of two levels over the ranks says which buckets hold entries; the least
rank is two find-first-set steps away. A merge enters the two new pairs and
leaves the entries of pairs that are gone, which are skipped when they come up.
Within a bucket the leftmost position comes first, as in the reference
algorithm of such vocabularies. So a pre-token of n bytes takes O(n log n)
steps, also where it is a whole text without spaces.

Pre-tokens that are one token by themselves, and those met before by the same
worker (a memory of at most 2 * REMEMBERED pre-tokens, none over SHORT characters),
need no queue. That memory has two generations: when the younger one is full it
becomes the older one, and what is met again moves back.

Defined results: null and empty texts have no tokens. Special tokens are
ordinary text. Repeated documents each get a row. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerflow.llm import text as X

REMEMBERED, SHORT = 600_000, 64
#: The same where other work shares the executors' memory.
REMEMBERED_IN_STAGES = 100_000
#: A vocabulary file of more bytes is refused: it goes to every executor whole.
LARGEST_FILE = 256 << 20
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_SHIFT = 8


class _Memory(dict):
    """Tokens of pre-tokens, in two generations; those of a pre-token that is not there are made."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.older = encoder, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece) or tuple(self.encoder.piece(piece.encode("utf-8", "replace")))
        if len(piece) <= SHORT:
            if len(self) >= self.encoder.remembered:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, file: bytes, pattern: str, remembered: int | None = None):
        self.remembered = remembered or REMEMBERED
        self.ranks: dict[bytes, int] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"no tokens for the bytes {missing[:5]}")
        self.token = {v: k for k, v in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.width = max(self.token) + 1
        self.merge: dict[int, int] = {}
        for whole, rank in self.ranks.items():
            for k in range(1, len(whole)):
                left, right = self.ranks.get(whole[:k]), self.ranks.get(whole[k:])
                if left is not None and right is not None:
                    self.merge[left * self.width + right] = rank
        #: Ranks of the pairs of single bytes; -1 where there is none.
        self.first = [self.merge.get(a * self.width + b, -1) for a in self.single for b in self.single]
        self.split = regex.compile(pattern).findall
        self.words = [0] * ((self.width >> _SHIFT) + 1)
        self.seen = _Memory(self)

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        merge, width, words = self.merge.get, self.width, self.words
        n = len(data)
        ids = [self.single[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [-1] * n
        buckets: dict[int, list[int]] = {}
        top = 0
        first, left, at = self.first, data[0] << 8, 0
        for b in data[1:]:
            rank = first[left + b]
            left = b << 8
            if rank >= 0:
                rank_at[at] = rank
                if rank in buckets:
                    buckets[rank].append(at)  # positions ascend here, so the list is a heap
                else:
                    buckets[rank] = [at]
                    w = rank >> _SHIFT
                    words[w] |= 1 << (rank & 255)
                    top |= 1 << w
            at += 1
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            low = word & -word
            rank = (w << _SHIFT) + low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket.pop()
                words[w] = word ^ low
                if word == low:
                    top ^= 1 << w
            if rank_at[at] != rank:
                continue
            gone = after[at]
            ids[at] = rank
            rank_at[gone] = -2
            right = after[gone]
            after[at] = right
            rank_at[at] = -1
            if right < n:
                before[right] = at
                new = merge(rank * width + ids[right])
                if new is not None:
                    rank_at[at] = new
                    bucket = buckets.get(new)
                    if bucket:
                        heappush(bucket, at)
                    else:
                        buckets[new] = [at]
                        w = new >> _SHIFT
                        words[w] |= 1 << (new & 255)
                        top |= 1 << w
            left = before[at]
            if left >= 0:
                new = merge(ids[left] * width + rank)
                if new is None:
                    rank_at[left] = -1
                else:
                    rank_at[left] = new
                    bucket = buckets.get(new)
                    if bucket:
                        heappush(bucket, left)
                    else:
                        buckets[new] = [left]
                        w = new >> _SHIFT
                        words[w] |= 1 << (new & 255)
                        top |= 1 << w
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.seen.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        file = f.read(LARGEST_FILE + 1)
    if len(file) > LARGEST_FILE:
        raise ValueError(f"{path} has more than {LARGEST_FILE} bytes")
    return file


def _encoder(held, remembered: int | None = None) -> Encoder:
    """The encoder of a broadcast vocabulary, kept in a worker until it does something else."""
    return X.resident(held.id, lambda: Encoder(*held.value, remembered))


def _broadcast(spark: SparkSession, path: str | None, pattern: str | None):
    import public_tokenizers

    return _Held(spark.sparkContext.broadcast((read_vocabulary(path or public_tokenizers.path(VOCABULARY)), pattern or public_tokenizers.PATTERN)))


class _Held:
    def __init__(self, broadcast):
        import uuid

        self.broadcast, self.id = broadcast, uuid.uuid4().int

    @property
    def value(self):
        return self.broadcast.value


def tokenize(docs: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, ids (array of int) and decoded (the bytes that the ids stand for)."""
    held = _broadcast(docs.sparkSession, path, pattern)
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held)
        for batch in X.slices(batches, "text", owner=held.id):
            ids = [encoder.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            at = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(i) for i in ids], out=at[1:])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(at[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array([encoder.decode(i) for i in ids], pa.binary())], names=["key", "ids", "decoded"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, ids array<int>, decoded binary")


def append_ids(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", name: str = "token_ids") -> DataFrame:
    """The documents whose ids decode to their text again, with a further column of ids (called otherwise if the name is taken)."""
    held = _broadcast(docs.sparkSession, path, pattern)
    name = X.free_name(docs.columns, name)
    schema = X.fields(", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"{name} array<int>"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held, REMEMBERED_IN_STAGES)
        for batch in X.slices(batches, text, owner=held.id):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            ids = [encoder.encode(t) if t else [] for t in texts]
            same = [encoder.decode(i) == (t or "").encode("utf-8", "replace") for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, name]).filter(pa.array(same))

    return docs.mapInArrow(run, schema)


def op5_bitmap_rank_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tokenize(X.table(spark, sf_dir, "documents"))
    return done.select(
        F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
