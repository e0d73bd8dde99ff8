"""A follower: version-gated apply of pulled bundles, replay of its own, rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerflow.operators import bundles, conflicts
from ledgerflow.operators.bundles import DELETE, ROW


def newer(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """Incoming effects (with row_version) that the follower has not seen."""
    known = state.select(*ROW, F.col("bundle_seq").alias("local_version"))
    return incoming.join(known, ROW, "left").filter(F.col("local_version").isNull() | (F.col("row_version") > F.col("local_version"))).drop("local_version")


def latest_effects(log: DataFrame) -> DataFrame:
    """Of many bundles the last effect on each row: applying it alone gives the same tables as applying all in order."""
    last = log.groupBy(*ROW).agg(F.max("bundle_seq").alias("bundle_seq"))
    return log.join(last, [*ROW, "bundle_seq"]).select(*ROW, F.col("bundle_seq").alias("row_version"), "op_code", "payload")


def apply(state: DataFrame, log: DataFrame) -> DataFrame:
    """Follower rows (keys, bundle_seq, deleted, payload) after the bundles of `log`, whatever it has applied before."""
    fresh = newer(latest_effects(log), state)
    changed = fresh.select(*ROW, F.col("row_version").alias("bundle_seq"), (F.col("op_code") == DELETE).alias("deleted"), F.when(F.col("op_code") != DELETE, F.col("payload")).alias("payload"))
    kept = state.select(*ROW, "bundle_seq", "deleted", "payload").join(changed.select(*ROW), ROW, "left_anti")
    return kept.unionByName(changed)


def verified(received: DataFrame, announced: DataFrame, names: dict[int, tuple[str, str, str]] | None = None) -> DataFrame:
    """Announced bundles (user_pk, bundle_seq, row_count, announced hash) with what their received rows allow.

    `row_count_mismatch` if rows are missing or too many, `hash_mismatch` if they
    are not the rows that were committed, else `replayed`.
    """
    found = bundles.headers(received, names).select("user_pk", "bundle_seq", F.col("row_count").alias("_rows"), F.col("bundle_hash").alias("_hash"))
    outcome = F.when(~F.col("_rows").eqNullSafe(F.col("row_count")), "row_count_mismatch").when(F.col("_hash") != F.col("announced"), "hash_mismatch").otherwise("replayed")
    return announced.join(found, ["user_pk", "bundle_seq"], "left").withColumn("outcome", outcome).drop("_rows", "_hash")


def checkpoint(seen: DataFrame, log: DataFrame) -> DataFrame:
    """Per scope the last bundle number up to which no number is missing, from a checkpoint (user_pk, seq) on.

    Of distinct numbers above the checkpoint, the n-th belongs to the unbroken
    run as long as it is checkpoint + n.
    """
    from pyspark.sql import Window as W

    fresh = log.select("user_pk", "bundle_seq").distinct().join(seen, "user_pk").filter(F.col("bundle_seq") > F.col("seq"))
    nth = F.row_number().over(W.partitionBy("user_pk").orderBy("bundle_seq"))
    run = fresh.withColumn("nth", nth).filter(F.col("bundle_seq") == F.col("seq") + F.col("nth")).groupBy("user_pk").agg(F.max("bundle_seq").alias("reached"))
    return seen.join(run, "user_pk", "left").select("user_pk", F.coalesce("reached", "seq").alias("seq"))


def reconcile(uploaded: DataFrame, pending: DataFrame, live: DataFrame) -> DataFrame:
    """What to send again after a push was replayed: uploaded rows (op, payload, row_version) against pending edits and live rows.

    A requeued row takes the committed version as its base.
    """
    p = pending.select(*ROW, F.col("payload").alias("pending_payload"), F.lit(True).alias("is_pending"))
    v = live.select(*ROW, F.col("payload").alias("live_payload"), F.lit(True).alias("is_live"))
    found = uploaded.join(p, ROW, "left").join(v, ROW, "left")
    same_pending = F.col("is_pending").isNull() | F.col("pending_payload").eqNullSafe(F.col("payload"))
    same = same_pending & F.col("live_payload").eqNullSafe(F.col("payload"))
    op = conflicts.replay(F.col("op"), F.coalesce("is_live", F.lit(False)), same)
    return found.withColumn("requeue_op", op).filter("requeue_op IS NOT NULL").select(*ROW, F.col("requeue_op").cast("int").alias("op"), F.col("row_version").alias("base_row_version"), F.when(F.col("requeue_op") != DELETE, F.col("live_payload")).alias("payload"))


def rebuild(snapshot: DataFrame, outbox: DataFrame | None = None) -> DataFrame:
    """Follower rows from a snapshot; a kept outbox is laid over it again."""
    base = snapshot.select(*ROW, F.col("row_version").alias("bundle_seq"), F.lit(False).alias("deleted"), "payload")
    if outbox is None:
        return base
    over = outbox.select(*ROW, "op", F.col("payload").alias("own"))
    joined = base.join(over, ROW, "full_outer")
    return joined.select(*ROW, F.coalesce("bundle_seq", F.lit(0)).alias("bundle_seq"), F.coalesce(F.col("op") == DELETE, F.lit(False)).alias("deleted"), F.when(F.col("op").isNull(), F.col("payload")).when(F.col("op") != DELETE, F.col("own")).alias("payload"))
