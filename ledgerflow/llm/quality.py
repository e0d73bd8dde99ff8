"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are computed from whole texts with numpy, and the trees, trained
on the driver, score them in the same pass. Training uses at most LABELS
labelled rows: those with the least hash of their doc_id, so the sample does not
depend on the data's layout.

Defined results: null and empty texts have statistics of zero and are scored.
Of labels that repeat a doc_id the least counts; labels that are null or without
a document are left out. Without labels of both classes the score is their
smoothed share of ones, 0.5 with none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerflow.llm import boosting, text as X

LABELS = 6000
#: Single bytes whose share of the text is a statistic of its own.
MARKS = b"!|#$%&*.,"

STATISTICS = ["log_bytes", "log_words", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "repeats", "distinct_triples", "upper", "digits", "symbols", "spaces", "wide", "lines", "mean_line", "distinct_lines", "title", *(f"mark_{m:02x}" for m in MARKS)]


def _counts(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _distinct(text: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct keys, and how often its most frequent one stands."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, text))
    t, k = text[order], keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(k)))
    top = np.zeros(n)
    np.maximum.at(top, t[at], runs)
    return np.bincount(t[at], minlength=n).astype(float), top


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text."""
    data, at = X.utf8(column)
    n = len(at) - 1
    words = X.Words(data, at, X.SPACED)
    hashes, text = words.hashes(), words.text
    length = words.end - words.start
    size, count = np.diff(at).astype(float), words.count.astype(float)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(count, 1)
    distinct, top = _distinct(text, hashes, n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    triple = X.windows(hashes, 3)
    inside = text[2:] == text[: len(triple)] if len(triple) else np.zeros(0, bool)
    triples, _ = _distinct(text[: len(triple)][inside], triple[inside], n)
    upper = (data >= 65) & (data <= 90)
    first = np.zeros(len(hashes), bool)
    if len(hashes):
        first = upper[words.start]
    line = np.ones(256, bool)
    line[0x0A] = line[0x0D] = False
    lines = X.Words(data, at, line)
    line_count = lines.count.astype(float)
    line_distinct, _ = _distinct(lines.text, lines.hashes(), n)
    symbol = ((data > 32) & (data < 48)) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 127))
    by_word = lambda v: np.bincount(text, v, n) * per_word
    columns = [
        np.log1p(size), np.log1p(count), by_word(length), by_word(length > 12), by_word(length <= 3), distinct * per_word, top * per_word, by_word(same),
        triples / np.maximum(count - 2, 1), _counts(upper, at) * per_byte, _counts((data >= 48) & (data <= 57), at) * per_byte, _counts(symbol, at) * per_byte,
        _counts(data <= 32, at) * per_byte, _counts(data >= 128, at) * per_byte, np.log1p(line_count), size / np.maximum(line_count, 1), line_distinct / np.maximum(line_count, 1), by_word(first),
        *(_counts(data == m, at) * per_byte for m in MARKS),
    ]
    return np.stack(columns, axis=1).astype(float)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = LABELS) -> boosting.Trees:
    """Trees from at most `most` labelled documents."""
    known = labels.filter(labels[key].isNotNull() & labels[label].isNotNull()).groupBy(labels[key].alias("key")).agg(F.min(labels[label]).alias("label"))
    sample = known.orderBy(F.xxhash64("key", F.lit("quality")), "key").limit(most)
    # at most `most` rows by the limit above
    own = docs.select(docs[key].alias("key"), docs[text].alias("text")).join(F.broadcast(sample), "key").select("key", "label", "text")
    kind = own.schema["key"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, "text"):
            values = statistics(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(list(values), pa.list_(pa.float64()))], names=["key", "label", "x"])

    # repeated documents with one id count once; which of them, their statistics decide
    rows = own.mapInArrow(measure, f"key {kind}, label int, x array<double>").groupBy("key").agg(F.min("label").alias("label"), F.min("x").alias("x")).orderBy("key").collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(STATISTICS))
    return boosting.train(x, np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, model: boosting.Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key and score (0 to 1)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.predict(statistics(batch.column(1))))], names=["key", "score"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, score double")


def op8_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = X.table(spark, sf_dir, "documents"), X.table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = fit(docs, labels.filter(fold != 1))
    scored = score(docs, model).withColumnRenamed("key", "doc_id")
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
