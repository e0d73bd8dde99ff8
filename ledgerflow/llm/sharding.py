"""Sharding of documents into shards of near-equal bytes by sampled splitters.

Records are ordered by the hash of their text, so equal texts are neighbours.
A size-weighted sample of keys gives quantile boundaries of many fine ranges;
ranges that turn out overfull are subdivided. Exact byte and row sums of the
ranges then place every record on one line of bytes, which is cut into equal
shards. Equal texts stay in one shard unless their group is larger than 1/GRAIN
of a shard; such a group is spread along the line.

The number of ranges grows with the rows, so that a range has about ROWS of them
however many there are. No task holds more than one range's rows, without their
texts; the driver holds SAMPLES keys and one sum for each range.

Defined results: a null text has size OVERHEAD and CRC 0. Repeated records are
records of their own. A table without rows gives none. Null keys are allowed.
Other columns are not read, whatever their names and types.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ledgerflow.llm import text as X
from ledgerflow.runtime import Scratch, cut

SHARDS = 24
OVERHEAD = 8
#: The least number of fine ranges for each shard, rows of a range on average, samples for each range, and groups of equal texts of a shard from which one is spread.
RANGES, ROWS, SAMPLES, GRAIN = 16, 500_000, 16, 100
SALT = (1 << 24) - 1


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", overhead: int = OVERHEAD, row: str | None = None) -> DataFrame:
    """Per record: key, uid (the column `row`, or the record's number in this run), size, text_crc32, shard and slot (gapless in the shard)."""
    with Scratch(docs.sparkSession) as held:
        return cut(_assigned(held, docs, shards, key, text, overhead, row), "shards")


def _assigned(held: Scratch, docs: DataFrame, shards: int, key: str, text: str, overhead: int, row: str | None) -> DataFrame:
    spark = docs.sparkSession
    uid = docs[row].cast("long") if row else F.monotonically_increasing_id()
    base = held.cut(docs.select(
        docs[key].alias("key"), uid.alias("uid"), (F.coalesce(F.octet_length(docs[text]), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(docs[text]), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(docs[text]).alias("hash"),
    ), "shard-base")
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not rows:
        return base.selectExpr("key", "uid", "size", "text_crc32", "0 AS shard", "0L AS slot")
    # at most shards * GRAIN groups can be as large as that
    large = [r[0] for r in base.groupBy("hash").agg(F.sum("size").alias("s")).filter(F.col("s") * (shards * GRAIN) > total).select("hash").collect()]
    spread = F.broadcast(spark.createDataFrame([(x,) for x in large], "hash long").withColumn("large", F.lit(True)))
    salted = F.col("hash").bitwiseAND(F.lit(~SALT)).bitwiseOR(F.xxhash64("key").bitwiseAND(F.lit(SALT)))
    line = base.join(spread, "hash", "left").withColumn("large", F.coalesce("large", F.lit(False))).withColumn("at", F.when(F.col("large"), salted).otherwise(F.col("hash")))

    ranges = max(shards * RANGES, -(-rows // ROWS))
    chance = F.col("size") * (ranges * SAMPLES / total)
    drawn = F.pmod(F.xxhash64("uid", "hash"), F.lit(1 << 52)) / float(1 << 52) < chance
    sample = line.filter(drawn).select("at", chance).collect()
    keys = np.array([r[0] for r in sample] or [0], np.int64)
    order = np.argsort(keys, kind="stable")
    weight = np.cumsum(np.array([max(1.0, r[1]) for r in sample] or [1.0])[order])
    cuts = np.unique(keys[order][np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges)])

    @F.pandas_udf("int")
    def range_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, at.to_numpy(), "right").astype(np.int32))

    line = line.withColumn("range", range_of("at"))
    filled = {r[0]: r[1] for r in line.groupBy("range").agg(F.sum("size")).collect()}
    even = total / ranges
    parts, first = {}, 0
    for r in range(len(cuts) + 1):
        many = int(-(-filled.get(r, 0) // even)) if filled.get(r, 0) > 2 * even else 1
        parts[r] = (first, many)
        first += many
    known = F.broadcast(spark.createDataFrame([(r, *p) for r, p in parts.items()], "range int, first int, many int"))
    sub = F.pmod(F.xxhash64("at", F.when(F.col("large"), F.col("uid")).otherwise(F.lit(0))), F.col("many")).cast("int")
    line = line.join(known, "range").withColumn("part", F.col("first") + sub)

    by_at = W.partitionBy("part").orderBy("at")
    by_row = W.partitionBy("part").orderBy("at", "key", "text_crc32", "size", "uid")
    ahead = F.coalesce(F.when(F.col("large"), F.sum("size").over(by_row.rowsBetween(W.unboundedPreceding, -1))).otherwise(F.sum("size").over(by_at.rangeBetween(W.unboundedPreceding, -1))), F.lit(0))
    line = line.select("key", "uid", "size", "text_crc32", "part", ahead.alias("ahead"), (F.row_number().over(by_row) - 1).cast("long").alias("nth"))
    line = held.cut(line, "shard-line")

    sums = line.groupBy("part").agg(F.sum("size"), F.count("*")).orderBy("part").collect()
    before, b, n = [], 0, 0
    for part, size, count in sums:
        before.append((part, b, n))
        b, n = b + size, n + count
    line = line.join(F.broadcast(spark.createDataFrame(before, "part int, bytes_before long, rows_before long")), "part")
    shard = F.least(F.lit(shards - 1), F.floor((F.col("bytes_before") + F.col("ahead")).cast("decimal(38,0)") * shards / total)).cast("int")
    line = line.select("key", "uid", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("nth")).alias("row"))
    firsts = F.broadcast(spark.createDataFrame(line.groupBy("shard").agg(F.min("row")).collect(), "shard int, first_row long"))
    return line.join(firsts, "shard").select("key", "uid", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> None:
    """Write the documents to path/shard=N/, with a column slot; record order within a shard is slot's. Columns named shard or slot are replaced."""
    own = docs.drop("shard", "slot")
    row = X.free_name(own.columns, "shard_row")
    with Scratch(docs.sparkSession) as held:
        own = held.cut(own.withColumn(row, F.monotonically_increasing_id()), "shard-docs")
        placed = assign(own, shards, key, text, row=row)
        held.frames.append(placed)
        found = own.join(placed.select(F.col("uid").alias(row), "shard", "slot"), row).drop(row)
        found.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(X.table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
