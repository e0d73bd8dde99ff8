"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words. Patterns are the benchmark's windows: ten consecutive
words, or all words of a shorter item. For every pattern length there is a
shift table indexed by the hash of a block of two words (one for patterns of
one word): how far the block's last word stands, at least, from the end of any
pattern. Many lanes walk the words at once, each jumping by the shift of the
block it sees. A shift of zero leads to the bucket of the patterns that end in
that block; whole windows are compared there, first by word hashes and then
byte by byte.

The benchmark is cut into groups of at most GROUP windows by the executors, long
items into several. The driver hands each group on as bytes, in a broadcast of
its own, without looking into it. A worker holds the tables of one group at a
time: it gathers HELD bytes of texts, passes them through every group, and goes
on to the next texts. So a worker's memory does not grow with the benchmark. A
benchmark of more than LARGEST bytes is refused, as its groups lie on every
executor's disk; it can be given in parts.

Defined results: a null or empty text has no words and no hits. An item
without words or with a null text has no windows. Items with equal ids count
once. A null item id is written "null". Repeated documents each get a row.
Other columns of either table are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerflow.llm import text as X

WINDOW = 10
GROUP = 200_000
#: Bytes of benchmark text that are cut into groups at once, and of document texts that pass all groups at once.
GATHERED, HELD = 2 << 20, 8 << 20
LARGEST = 16 << 30
LANE = 256


def _block(last: np.ndarray, before: np.ndarray | None, bits: int) -> np.ndarray:
    key = last if before is None else last + before * np.uint64(0x9E3779B97F4A7C15)
    return (X.mix(key) >> np.uint64(64 - bits)).astype(np.int64)


class Group:
    """Some benchmark windows as places in the words of their items, as it travels."""

    def __init__(self, words: X.Words, hashes: np.ndarray, start: np.ndarray, size: np.ndarray, item: np.ndarray, ids: list[str]):
        first, last = int(start[0]), int((start + size).max())
        low, high = int(words.start[first]), int(words.end[last - 1])
        self.data = words.data[low:high].copy()
        self.begin, self.end = words.start[first:last] - low, words.end[first:last] - low
        self.hashes = hashes[first:last].copy()
        self.start, self.size = start - first, size
        used, self.item = np.unique(item, return_inverse=True)
        self.ids = [ids[k] for k in used]

    def matchers(self) -> list[Matcher]:
        return [Matcher(self, int(m), np.flatnonzero(self.size == m)) for m in np.unique(self.size)]


def _same_bytes(a, a_word: np.ndarray, b, b_word: np.ndarray, m: int) -> np.ndarray:
    """Whether the m words from a_word on in a are those from b_word on in b (data, begin, end each)."""
    if not len(a_word):
        return np.zeros(0, bool)
    (data1, begin1, end1), (data2, begin2, end2) = a, b
    one, two = a_word[:, None] + np.arange(m), b_word[:, None] + np.arange(m)
    length = end1[one] - begin1[one]
    same = (length == end2[two] - begin2[two]).all(axis=1)
    length = np.where(same[:, None], length, 0)
    flat = length.ravel()
    wrong = np.zeros(int(flat.sum()) + 1, np.int64)
    np.cumsum(data1[X.ragged(begin1[one].ravel(), flat)] != data2[X.ragged(begin2[two].ravel(), flat)], out=wrong[1:])
    size = length.sum(axis=1)
    stop = np.cumsum(size)
    return same & (wrong[stop] == wrong[stop - size])


class Matcher:
    """The windows of one length of a group, with their shift table and suffix buckets."""

    def __init__(self, group: Group, m: int, windows: np.ndarray):
        self.m, self.block = m, min(2, m)
        self.source = group.data, group.begin, group.end
        start, item = group.start[windows], group.item[windows]
        whole = X.mix(group.hashes)
        for k in range(1, m):
            whole = X.mix(whole[:-1] * np.uint64(0xD6E8FEB86659FD93) + group.hashes[k : k + len(whole) - 1])
        # windows that are the same, word by word, are one pattern
        order = np.lexsort((item, whole[start]))
        start, item, key = start[order], item[order], whole[start[order]]
        new = np.ones(len(start), bool)
        new[1:] = key[1:] != key[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(start)), 0))
        new |= ~_same_bytes(self.source, start, self.source, start[head], m)
        pattern = np.cumsum(new) - 1
        start = start[new]
        self.bits = max(12, int(len(start) * m).bit_length() + 2)
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.min_scalar_type(m + 1))
        self.hashes = group.hashes[start[:, None] + np.arange(m)]
        for end in range(self.block - 1, m):
            # what ends later, and so has the smaller shift, is written over the rest
            self.shift[self._of(end)] = m - 1 - end
        bucket = self._of(m - 1)
        by_bucket = np.argsort(bucket, kind="stable")
        self.bucket, self.hashes, self.start = bucket[by_bucket], self.hashes[by_bucket], start[by_bucket]
        place = np.empty_like(by_bucket)
        place[by_bucket] = np.arange(len(by_bucket))
        pairs = np.unique(place[pattern] * np.int64(len(group.ids)) + item)
        self.items = pairs % len(group.ids)
        #: Where each pattern's items begin.
        self.first = np.searchsorted(pairs // len(group.ids), np.arange(len(start) + 1))
        self.ids = group.ids

    def _of(self, end: int) -> np.ndarray:
        return _block(self.hashes[:, end], self.hashes[:, end - 1] if self.block == 2 else None, self.bits)

    def find(self, words: X.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start word and pattern of every occurrence."""
        none = np.zeros(0, np.int64)
        n = len(hashes)
        if n < self.m:
            return none, none
        keys = np.zeros(n, np.int64)
        keys[self.block - 1 :] = _block(hashes[self.block - 1 :], hashes[: n - 1] if self.block == 2 else None, self.bits)
        at = np.arange(self.m - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        found = []
        while len(at):
            shift = self.shift[keys[at]]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            open_ = at < stop
            at, stop = at[open_], stop[open_]
        ends = np.concatenate(found)
        text = np.searchsorted(words.first, ends, "right")
        ends = ends[text == np.searchsorted(words.first, ends - self.m + 1, "right")]
        low = np.searchsorted(self.bucket, keys[ends], "left")
        many = np.searchsorted(self.bucket, keys[ends], "right") - low
        starts, patterns = [none], [none]
        step = 50_000
        total = np.cumsum(many)
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + step, "right")))
            start = np.repeat(ends[first:last], many[first:last]) - self.m + 1
            pattern = X.ragged(low[first:last], many[first:last])
            for k in (0, *range(self.m - 1, 0, -1)):
                same = hashes[start + k] == self.hashes[pattern, k]
                start, pattern = start[same], pattern[same]
            same = _same_bytes((words.data, words.start, words.end), start, self.source, self.start[pattern], self.m)
            starts.append(start[same])
            patterns.append(pattern[same])
            first = last
        return np.concatenate(starts), np.concatenate(patterns)


def groups_of(table: pa.Table, window: int) -> Iterator[Group]:
    """The windows of the items (id as text, text), GROUP at a time."""
    words = X.Words(*X.utf8(table.column(1)), X.LETTERS)
    ids = ["null" if x is None else x for x in table.column(0).to_pylist()]
    size = np.minimum(window, words.count)
    many = np.where(size > 0, words.count - size + 1, 0)
    start, item = X.ragged(words.first[:-1], many), np.repeat(np.arange(len(ids)), many)
    hashes = words.hashes()
    for at in range(0, len(start), GROUP):
        part = slice(at, at + GROUP)
        yield Group(words, hashes, start[part], size[item[part]], item[part], ids)


def _gathered(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """The batches' rows, together until their texts come to `limit` bytes."""
    held, size = [], 0
    for piece in X.slices(batches, column, limit):
        held.append(piece)
        size += piece.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Patterns:
    """A benchmark's groups, each in a broadcast."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, item: str, text: str, window: int):
        source = benchmark.select(benchmark[item].cast("string").alias("item"), benchmark[text].alias("text"))
        size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        if size > LARGEST:
            raise ValueError(f"a benchmark of {size} bytes; at most {LARGEST} at once")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _gathered(batches, "text", GATHERED):
                for group in groups_of(table, window):
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(group, 5)], pa.binary())], names=["group"])

        made = source.coalesce(max(1, size // GATHERED)).mapInArrow(cut, "group binary")
        self.groups = [spark.sparkContext.broadcast(bytes(r["group"])) for r in made.toLocalIterator()]

    def matchers(self) -> Iterator[list[Matcher]]:
        """The matchers of each group; those of one group are kept if there are no others."""
        if len(self.groups) == 1:
            if "only" not in self.__dict__:
                self.only = pickle.loads(self.groups[0].value).matchers()
            yield self.only
            return
        for group in self.groups:
            yield pickle.loads(group.value).matchers()
            # the broadcast keeps what it has read, for each of them, and the worker outlives the task
            if getattr(group, "_path", None):
                group.__dict__.pop("_value", None)


def scan(column: pa.Array | pa.ChunkedArray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Per text: words, hit words, and the sorted ids of the items found."""
    words = X.Words(*X.utf8(column), X.LETTERS)
    hashes = words.hashes()
    change = np.zeros(len(hashes) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for matchers in patterns.matchers():
        for matcher in matchers:
            start, pattern = matcher.find(words, hashes)
            np.add.at(change, start, 1)
            np.add.at(change, start + matcher.m, -1)
            # the last text that begins at or before the word; empty texts share that first word
            text = np.searchsorted(words.first, start, "right") - 1
            for pair in np.unique(text * len(matcher.start) + pattern).tolist():
                k, p = divmod(pair, len(matcher.start))
                items.setdefault(k, set()).update(matcher.ids[i] for i in matcher.items[matcher.first[p] : matcher.first[p + 1]])
    hit = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(np.cumsum(change[:-1]) > 0, out=hit[1:])
    return words.count, hit[words.first[1:]] - hit[words.first[:-1]], [sorted(items.get(k, ())) for k in range(len(words.count))]


def _scanned(batches: Iterator[pa.RecordBatch], column: str, patterns: Patterns) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, list[list[str]]]]:
    """The rows in tables, with what scan() says of their texts."""
    # a single group stays loaded, so there is nothing to gather texts for
    limit = HELD if len(patterns.groups) > 1 else X.SLICE_BYTES
    for table in _gathered(batches, column, limit):
        yield table, *scan(table.column(column), patterns)


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: key, n_words, n_hit and item_ids (sorted strings)."""
    patterns = Patterns(docs.sparkSession, benchmark, item, item_text, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, count, hit, items in _scanned(batches, "text", patterns):
            out = pa.table([table.column(0), pa.array(count, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], names=["key", "n_words", "n_hit", "item_ids"])
            yield from out.combine_chunks().to_batches()

    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_words long, n_hit long, item_ids array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", most: float = 0.0, window: int = WINDOW) -> DataFrame:
    """The documents of which at most the share `most` of their words is inside benchmark windows."""
    patterns = Patterns(docs.sparkSession, benchmark, "item_id", "text", window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, count, hit, _ in _scanned(batches, text, patterns):
            yield from table.filter(pa.array(hit <= most * count)).to_batches()

    return docs.mapInArrow(run, docs.schema)


def op1_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(X.table(spark, sf_dir, "documents"), X.table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, w[s : s + least(10, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)
), q AS (
  SELECT doc_id, m, s, w[s : s + m - 1] AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)
), h AS (
  SELECT DISTINCT doc_id, item_id, s, q.m AS m FROM q JOIN p ON q.m = p.m AND q.win = p.win
), n AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + m)) AS x FROM h) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
