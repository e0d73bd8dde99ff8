"""Snapshots: live rows joined with live row state, complete on both sides, totally ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerflow.operators import paging
from ledgerflow.operators.bundles import ROW


def live_state(state: DataFrame) -> DataFrame:
    return state.filter(~F.col("deleted")).drop("deleted")


def matched(live_rows: DataFrame, state: DataFrame) -> DataFrame:
    """Live rows and live state side by side, with the error class of each key; null where both agree.

    Both sides are counted first, so duplicates are found and the join stays one to one.
    """
    rows = live_rows.groupBy(*ROW).agg(F.count("*").alias("n_rows"), F.max("payload").alias("payload"))
    known = live_state(state).groupBy(*ROW).agg(F.count("*").alias("n_state"), F.max("bundle_seq").alias("row_version"))
    both = rows.join(known, ROW, "full_outer")
    error = F.when(F.col("n_state").isNull(), "row_without_state").when(F.col("n_rows").isNull(), "state_without_row").when((F.col("n_rows") > 1) | (F.col("n_state") > 1), "duplicate")
    return both.withColumn("error", error)


def integrity_errors(live_rows: DataFrame, state: DataFrame) -> DataFrame:
    return matched(live_rows, state).filter("error IS NOT NULL").select(*ROW, "error")


def materialize(live_rows: DataFrame, state: DataFrame) -> DataFrame:
    """The rows of the snapshot with their ordinals (from 1) by table and key bytes, per scope."""
    whole = matched(live_rows, state).filter("error IS NULL").select(*ROW, "row_version", "payload")
    return paging.ordinals(whole.withColumn("key_bytes", F.encode("key_text", "UTF-8")), "user_pk", ["table_id", "key_bytes"], "snapshot_ordinal").drop("key_bytes")


class SnapshotTooLarge(Exception):
    """A snapshot is over the limit of rows or bytes."""


def within_limits(snapshot: DataFrame, max_rows: int = 0, max_bytes: int = 0) -> DataFrame:
    """Per scope the size of the snapshot; raises where it is over a limit (0: none)."""
    sizes = snapshot.groupBy("user_pk").agg(F.count("*").alias("row_count"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("byte_count"))
    over = sizes.filter(((F.col("row_count") > max_rows) & F.lit(max_rows > 0)) | ((F.col("byte_count") > max_bytes) & F.lit(max_bytes > 0)))
    if worst := over.orderBy("user_pk").first():
        raise SnapshotTooLarge(f"scope {worst['user_pk']}: {worst['row_count']} rows, {worst['byte_count']} bytes")
    return sizes


def set_difference(state: DataFrame, live_rows: DataFrame) -> DataFrame:
    """Keys of live state without a row (`missing`) and of rows without live state (`unexpected`)."""
    known, rows = live_state(state).select(*ROW), live_rows.select(*ROW)
    return known.exceptAll(rows).distinct().withColumn("kind", F.lit("missing")).union(rows.exceptAll(known).distinct().withColumn("kind", F.lit("unexpected")))
