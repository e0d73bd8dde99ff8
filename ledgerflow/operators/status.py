"""Operational figures: one-pass status, health, authority, timings and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def status(scopes: DataFrame, headers: DataFrame, state: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row of figures; each table is aggregated once."""
    a = scopes.agg(F.count("*").alias("scopes"), F.coalesce(F.max("floor"), F.lit(0)).alias("max_floor"), F.coalesce(F.max(F.greatest(F.col("latest") - F.col("floor"), F.lit(0))), F.lit(0)).alias("max_retained"), F.count_if(F.expr("floor > 0")).alias("pruned_scopes"))
    b = headers.agg(F.count("*").alias("bundles"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("effects"), F.coalesce(F.sum("byte_count"), F.lit(0)).alias("bytes"), F.coalesce(F.min("bundle_seq"), F.lit(0)).alias("oldest"), F.coalesce(F.max("bundle_seq"), F.lit(0)).alias("newest"))
    c = state.agg(F.count_if(F.expr("NOT deleted")).alias("live_rows"), F.count_if(F.expr("deleted")).alias("tombstones"))
    d = sessions.agg(F.count("*").alias("sessions"), F.count_if(F.expr("is_expired")).alias("expired_sessions"))
    one = F.lit(1).alias("_one")
    joined = a.select("*", one)
    for x in (b, c, d):
        joined = joined.join(x.select("*", one), "_one")
    return joined.drop("_one")


def health(running: Column, shutting_down: Column, errors: Column) -> Column:
    return F.when(shutting_down, "shutting_down").when(~running, "stopped").when(errors > 0, "degraded").otherwise("healthy")


def authority(initialized: Column, pending: Column, live: Column) -> Column:
    """What a follower's tables stand for."""
    return F.when(~initialized & (pending > 0), "pending_local_seed").when(~initialized | (live == 0), "authoritative_empty").otherwise("authoritative_materialized")


def detach_blocked(dirty: Column, outbox: Column) -> Column:
    return F.when(dirty + outbox > 0, F.lit("blocked_unsynced_data")).otherwise(F.lit("detached"))


def stage_timings(samples: DataFrame, top: int = 12) -> DataFrame:
    """The stages (stage, ms, failed, rows) that took most time together."""
    found = samples.groupBy("stage").agg(F.count("*").alias("samples"), F.sum("ms").alias("total"), F.max("ms").alias("most"), F.sum("items").alias("items"), F.count_if(F.expr("failed")).alias("errors"))
    return found.withColumn("average", F.col("total") / F.col("samples")).orderBy(F.desc("total"), "stage").limit(top)


def user_report(results: DataFrame) -> DataFrame:
    """Totals of a run over many users (user, ok, seconds, error) with the most common error."""
    errors = results.filter("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n"))
    common = errors.agg(F.max_by("error", F.struct("n", "error")).alias("common_error"), F.coalesce(F.sum("n"), F.lit(0)).alias("errors")).withColumn("_one", F.lit(1))
    total = results.agg(F.count("*").alias("users"), F.count_if(F.expr("ok")).alias("succeeded"), F.avg("seconds").alias("average_seconds"), F.max("seconds").alias("most_seconds")).withColumn("_one", F.lit(1))
    return total.join(common, "_one").drop("_one")


def source_counts(commits: DataFrame) -> DataFrame:
    """Per scope and source the next commit number."""
    return commits.groupBy("user_pk", "source_id").agg((F.coalesce(F.max("source_bundle_id"), F.lit(0)) + 1).alias("next_source_bundle_id"))
