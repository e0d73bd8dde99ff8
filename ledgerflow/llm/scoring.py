"""Language-model scores: stupid backoff over n-grams of words, up to pairs unless more is asked.

Three relations, all partitioned by hash and packed as arrays of sorted 64-bit
n-gram hashes, so that an n-gram costs a few bytes on the wire:

1. documents, dealt into blocks by a hash of key and text;
2. the n-grams of each block with their counts, exploded and dealt by n-gram
   hash: in each part the counts of all blocks add up to the count table, and
   the table is joined to the n-grams that each block asked for;
3. the joined counts, back by block, meet the block's documents again, and the
   logarithms are summed per document.

A document is scored by what the other documents say: its own occurrences are
taken off every count. With c' the count that is left and N' the words that are
left, S(w | u) is c'(uw) / c'(u) where the pair is left, else ALPHA c'(w) / N'
where the word is left, else ALPHA ** 2 / max(N', 1). The first word of a
document has no pair: c'(w) / N', or ALPHA / max(N', 1). With a higher order the
longest n-gram that is left counts, over its context, times ALPHA for each word
that the longest possible one has more. Each logarithm is rounded to millionths,
so sums do not depend on their order.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased.

Defined results: null texts and texts without words have 0 words, log
probability 0 and no perplexity. Repeated documents are other documents to each
other, and each gets a row. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerflow.llm import text as X
from ledgerflow.runtime import cut

ALPHA, ORDER = 0.4, 2
#: Rows with the same key and text from which they are dealt to several blocks.
REPEATED = 10_000
#: Bytes of text in a block on average; the least number of blocks; n-grams in a part on average; the least number of parts.
BLOCK, LEAST_BLOCKS = 6 << 20, 64
PART, LEAST_PARTS = 1_500_000, 64


class Grams:
    """The n-grams of one to `order` words of a block's texts."""

    def __init__(self, column: pa.Array, parts: int, order: int):
        hashes, counts = [], []
        for piece in X.slices([pa.RecordBatch.from_arrays([column], names=["text"])], "text"):
            words = X.Words(*X.utf8(piece.column(0)), X.LETTERS)
            hashes.append(words.hashes())
            counts.append(words.count)
        word = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.n = len(word)
        self.count = np.concatenate([*counts, np.zeros(0, np.int64)])
        self.first = np.cumsum(self.count) - self.count
        self.text = np.repeat(np.arange(len(self.count)), self.count)
        #: The place of each word in its text.
        self.place = np.arange(self.n) - self.first[self.text]
        #: For each order the words that end such an n-gram.
        self.ends = [np.flatnonzero(self.place >= k) for k in range(order)]
        levels, gram = [word], word
        for k in range(1, order):
            longer = np.zeros(self.n, np.uint64)
            longer[1:] = X.mix(gram[:-1] * np.uint64(0xD6E8FEB86659FD93) + word[1:])
            gram = longer
            levels.append(gram[self.ends[k]])
        grams, self.gram_of, self.times = np.unique(np.concatenate(levels), return_inverse=True, return_counts=True)
        part = (grams % np.uint64(parts)).astype(np.int64)
        #: Order by part and then hash, the order in which the n-grams are sent and counts come back.
        self.order = np.argsort(part, kind="stable")
        self.grams = grams
        #: The parts that hold n-grams of the block, and where each begins and ends in that order.
        self.parts, begin = np.unique(part[self.order], return_index=True)
        self.cut = np.append(begin, len(grams))

    def sent(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each part and its n-grams; parts without any are left out, so the rows are never more than the n-grams."""
        for k, part in enumerate(self.parts.tolist()):
            yield part, self.order[self.cut[k] : self.cut[k + 1]]

    def of_part(self, part: int) -> np.ndarray:
        k = int(np.searchsorted(self.parts, part))
        return self.order[self.cut[k] : self.cut[k + 1]]

    def by_order(self, values: np.ndarray) -> list[np.ndarray]:
        """Values of the n-grams in gram_of's order, as one array over all words for each order; 0 where none ends."""
        out, at = [], 0
        for ends in self.ends:
            level = np.zeros(self.n, values.dtype)
            level[ends] = values[at : at + len(ends)]
            out.append(level)
            at += len(ends)
        return out

    def own(self) -> np.ndarray:
        """For each place the count of its n-gram in its own text."""
        of, text = self.gram_of, np.concatenate([self.text[ends] for ends in self.ends])
        order = np.lexsort((of, text))
        g, t = of[order], text[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(g)))
        out = np.zeros(len(g), np.int64)
        out[order] = np.repeat(size, size)
        return out


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, in as few bytes as the largest needs, compressed."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(values) or int(values.max()) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(values.astype(kind).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"u{data[0]}").astype(np.int64)


def _pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences of as few bytes as the largest needs."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : data[0]] = raw
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _micro(x: np.ndarray) -> np.ndarray:
    return np.rint(np.log(x) * 1e6).astype(np.int64)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = ALPHA, order: int = ORDER) -> DataFrame:
    """Per document: key, n_words, n_backed_off (words whose n-gram of `order` words is not left) and log_prob (in millionths)."""
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    same = F.xxhash64("key", "text")
    if not source.groupBy(same.alias("same")).count().filter(F.col("count") > REPEATED).isEmpty():
        # rows that repeat key and text so often would fill one block; their numbers are written, so that they stay what they are
        source = cut(source.withColumn("row", F.monotonically_increasing_id()), "scoring-source")
        same = F.xxhash64("key", "text", "row")
    size, = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(LEAST_BLOCKS, -(-size // BLOCK))
    parts = max(LEAST_PARTS, size // 8 // PART)
    source = source.select("key", "text", F.pmod(same, F.lit(blocks)).cast("int").alias("block"))
    kind = source.schema["key"].dataType.simpleString()

    def explode(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        grams = Grams(table.column("text").combine_chunks(), parts, order)
        rows = [(p, block, _pack_sorted(grams.grams[o]), _pack(grams.times[o])) for p, o in grams.sent()]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int32()), "grams": pa.array([r[2] for r in rows], pa.binary()), "times": pa.array([r[3] for r in rows], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        grams = [_unpack_sorted(x) for x in table.column("grams").to_pylist()]
        times = [_unpack(x) for x in table.column("times").to_pylist()]
        _, at = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(at, np.concatenate(times)).astype(np.int64)[at]
        ends = np.cumsum([len(g) for g in grams])
        packed = [_pack(t) for t in np.split(total, ends[:-1])]
        return pa.table({"part": table.column("part").cast(pa.int32()), "block": table.column("block").cast(pa.int32()), "total": pa.array(packed, pa.binary())})

    asked = source.groupBy("block").applyInArrow(explode, "part int, block int, grams binary, times binary")
    known = asked.groupBy("part").applyInArrow(count, "part int, block int, total binary")

    def sum_up(key: tuple, table: pa.Table, counts: pa.Table) -> pa.Table:
        grams = Grams(table.column("text").combine_chunks(), parts, order)
        total = np.zeros(len(grams.grams), np.int64)
        for p, packed in zip(counts.column("part").to_pylist(), counts.column("total").to_pylist()):
            total[grams.of_part(p)] = _unpack(packed)
        left = grams.by_order(total[grams.gram_of] - grams.own())
        n = grams.n
        # the longest n-gram that could end at each word
        longest = np.minimum(grams.place + 1, order)
        floor = np.maximum((all_words - grams.count)[grams.text], 1).astype(float)
        weight = alpha ** (longest - 1.0)
        prob = np.where(left[0] > 0, weight * left[0] / floor, weight * alpha / floor)
        for k in range(1, order):
            context = np.ones(n, np.int64)
            context[1:] = np.maximum(left[k - 1][:-1], 1)
            prob = np.where(left[k] > 0, alpha ** (longest - 1.0 - k) * left[k] / context, prob)
        off = left[-1] <= 0
        if order > 1:
            off |= longest < order
        sums = np.zeros(n + 1, np.int64)
        np.cumsum(_micro(prob), out=sums[1:])
        backed = np.zeros(n + 1, np.int64)
        np.cumsum(off, out=backed[1:])
        a, b = grams.first, grams.first + grams.count
        return pa.table({"key": table.column("key"), "n_words": pa.array(grams.count, pa.int64()), "n_backed_off": pa.array(backed[b] - backed[a], pa.int64()), "log_prob": pa.array(sums[b] - sums[a], pa.int64())})

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in X.slices(batches, "text"):
            n += int(X.Words(*X.utf8(batch.column(0)), X.LETTERS).count.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    all_words = source.select("text").mapInArrow(count_words, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return source.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(sum_up, f"key {kind}, n_words long, n_backed_off long, log_prob long")


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(X.table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_backed_off", F.col("log_prob").alias("log_prob_micro"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (
  SELECT id, s, w[s] AS w, CASE WHEN s > 1 THEN w[s - 1] END AS u, len(w) AS n FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS s FROM d)
), total AS (SELECT count(*) AS n FROM t
), c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w
), o1 AS (SELECT id, w, count(*) AS c FROM t GROUP BY id, w
), c2 AS (SELECT u, w, count(*) AS c FROM t WHERE u IS NOT NULL GROUP BY u, w
), o2 AS (SELECT id, u, w, count(*) AS c FROM t WHERE u IS NOT NULL GROUP BY id, u, w
), l AS (
  SELECT t.id, t.u, c1.c - o1.c AS word, cu.c - ou.c AS context, coalesce(c2.c - o2.c, 0) AS pair, total.n - t.n AS rest
  FROM t JOIN c1 ON t.w = c1.w JOIN o1 ON t.id = o1.id AND t.w = o1.w
  LEFT JOIN c1 AS cu ON t.u = cu.w LEFT JOIN o1 AS ou ON t.id = ou.id AND t.u = ou.w
  LEFT JOIN c2 ON t.u = c2.u AND t.w = c2.w LEFT JOIN o2 ON t.id = o2.id AND t.u = o2.u AND t.w = o2.w, total
), s AS (
  SELECT id, count(*) AS n_words, sum(CASE WHEN pair > 0 THEN 0 ELSE 1 END) AS n_off,
    sum(CAST(round_even(ln(CASE WHEN pair > 0 THEN pair / context
      WHEN word > 0 THEN CASE WHEN u IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END * word / greatest(rest, 1)
      ELSE CASE WHEN u IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END * 0.4::DOUBLE / greatest(rest, 1) END) * 1e6, 0) AS BIGINT)) AS log_prob
  FROM l GROUP BY id
)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_off, 0) AS BIGINT) AS n_backed_off, CAST(coalesce(log_prob, 0) AS BIGINT) AS log_prob_micro
FROM d LEFT JOIN s USING (id)
"""
