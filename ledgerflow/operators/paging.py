"""Reading the log and snapshots page by page, retention, and ordinals at scale."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerflow.runtime import cut

#: Defaults and limits of the protocol.
PULL_DEFAULT, PULL_MAX = 1000, 5000
ROWS_DEFAULT, ROWS_MAX = 1000, 5000
RETAINED, PRUNE_BATCH = 10_000, 1000
SESSION_SECONDS = 15 * 60


def page_size(requested: int | None, default: int, most: int) -> int:
    return min(requested if requested and requested > 0 else default, most)


class HistoryPruned(Exception):
    """The log no longer reaches back to what was asked for."""


def is_pruned(seq: Column, floor: Column) -> Column:
    return (seq > 0) & (seq <= floor)


@dataclass
class Page:
    rows: DataFrame
    has_more: bool
    next_after: int
    stable: int


def pull(log: DataFrame, scope, after: int, latest: int, floor: int = 0, limit: int | None = None, target: int = 0, strict_floor: bool = False) -> Page:
    """The next bundles of a scope after `after`, up to the ceiling of the first page (`target`, if given)."""
    stable = target if target > 0 else latest
    for seq in (after, target, stable):
        if 0 < seq <= floor or strict_floor and seq == 0 < floor:
            raise HistoryPruned(f"{seq} is at or below the floor {floor}")
    n = page_size(limit, PULL_DEFAULT, PULL_MAX)
    mine = log.filter((F.col("user_pk") == scope) & (F.col("bundle_seq") > max(after, floor)) & (F.col("bundle_seq") <= stable))
    if after >= stable:
        return Page(mine.limit(0), False, after, stable)
    # at most limit + 1 numbers reach the driver
    found = [r[0] for r in mine.select("bundle_seq").distinct().orderBy("bundle_seq").limit(n + 1).collect()]
    kept = found[:n]
    last = kept[-1] if kept else after
    return Page(mine.filter(F.col("bundle_seq") <= last).orderBy("bundle_seq", "row_ordinal"), len(found) > n, last, stable)


def pull_all(log: DataFrame, cursors: DataFrame, limit: int) -> DataFrame:
    """The page of every scope at once: cursors have user_pk, after, floor and stable.

    Bundle numbers are gapless, so the n-th bundle after the cursor is known
    without ranking anything.
    """
    low = F.greatest("after", "floor")
    found = log.join(cursors, "user_pk").filter(~is_pruned(F.col("after"), F.col("floor")) & (F.col("bundle_seq") > low) & (F.col("bundle_seq") <= F.least(F.col("stable"), low + limit)))
    return found.withColumn("has_more", F.col("stable") > low + limit).drop("after", "floor", "stable")


def floors(latest: DataFrame, window: int = RETAINED, batch: int = PRUNE_BATCH) -> DataFrame:
    """New floors for (user_pk, latest, floor): at most a batch further than before."""
    target = F.greatest(F.lit(0), F.col("latest") - window)
    return latest.withColumn("new_floor", F.when(target > F.col("floor"), F.least(target, F.col("floor") + batch)).otherwise(F.col("floor")))


def prune(log: DataFrame, new_floors: DataFrame) -> DataFrame:
    """The log without bundles at or below their scope's floor. Row state and source marks are kept elsewhere."""
    return log.join(new_floors.select("user_pk", "new_floor"), "user_pk", "left").filter(F.col("bundle_seq") > F.coalesce("new_floor", F.lit(0))).drop("new_floor")


def keyset_page(rows: DataFrame, ordinal: str, after: int, limit: int) -> DataFrame:
    """Rows with the next ordinals, one more than the limit, so that a caller sees whether more follow."""
    return rows.filter(F.col(ordinal) > after).orderBy(ordinal).limit(limit + 1)


def chunked(rows: DataFrame, ordinal: str, size: int) -> DataFrame:
    return rows.withColumn("chunk", F.floor((F.col(ordinal) - 1) / size).cast("long"))


def expired(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.filter(F.col("expires_at") <= now)


def ordinals(rows: DataFrame, by: str, order: list[str], name: str = "ordinal") -> DataFrame:
    """Gapless ordinals from 1 per `by`, in `order`, without bringing a scope's rows into one task.

    Rows are range-partitioned by scope and order and written; each range counts
    its own rows, and the counts before it (one number for each scope and range)
    are added.
    """
    ranged = cut(rows.repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id()), "ordinals")
    counts = ranged.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy(by, "_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(before, [by, "_range"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_range", "_before")


def increasing(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Per `by`: whether the values strictly increase, and the first that does not."""
    w = W.partitionBy(by).orderBy(order)
    found = rows.withColumn("prev", F.lag(value).over(w)).withColumn("bad", F.col("prev").isNotNull() & (F.col(value) <= F.col("prev")))
    return found.groupBy(by).agg((~F.bool_or("bad")).alias("increasing"), F.min(F.when(F.col("bad"), F.col(order))).alias("first_bad"))


def forwarded(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The rows whose value is above all before it: what a monotone hub passes on."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_top", F.max(value).over(w)).filter(F.col("_top").isNull() | (F.col(value) > F.col("_top"))).drop("_top")
