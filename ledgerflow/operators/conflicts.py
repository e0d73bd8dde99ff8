"""Optimistic concurrency: validation of pushed rows, conflicts and their resolution."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerflow.operators.bundles import DELETE, INSERT, ROW, UPDATE

IDENTIFIER = r"^[a-z0-9_]+$"
CANONICAL_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def with_state(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Requested rows with the version and tombstone flag of their row state; null where there is none."""
    known = state.select(*ROW, F.col("bundle_seq").alias("state_version"), F.col("deleted").alias("state_deleted"))
    return requests.join(known, ROW, "left")


def verdict(op: Column, base: Column, version: Column, deleted: Column) -> Column:
    """`ok`, or why the row conflicts."""
    missing, live = version.isNull(), version.isNotNull() & ~deleted
    return (
        F.when((op == INSERT) & missing, F.when(base == 0, "ok").otherwise("version_mismatch"))
        .when((op == INSERT) & live, F.when(base == version, "already_exists").otherwise("version_mismatch"))
        .when(op == INSERT, F.when(base == version, "ok").otherwise("version_mismatch"))
        .when(~live, "does_not_exist")
        .when(base == version, "ok")
        .otherwise("version_mismatch")
    )


def judged(requests: DataFrame, state: DataFrame) -> DataFrame:
    found = with_state(requests, state)
    return found.withColumn("verdict", verdict(F.col("op"), F.col("base_row_version"), F.col("state_version"), F.coalesce("state_deleted", F.lit(False))))


def commit(requests: DataFrame, state: DataFrame, latest: DataFrame, planned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged pushes, one of each scope at most, against the state: what became of each, and the log rows of those committed.

    `planned` (user_pk, push_id, planned) says how many rows each push has to
    have; they are numbered from 0 without gaps. A push is `incomplete` if its
    rows are not these, a `conflict` if any row's verdict is not ok, and else
    `committed` as the bundle after the scope's latest (user_pk, latest; 0 if it
    has none). Advance the state by the log rows.
    """
    push = ["user_pk", "push_id"]
    sums = judged(requests, state).groupBy(*push).agg(F.count("*").alias("n_rows"), F.countDistinct("req_ordinal").alias("_n"), F.min("req_ordinal").alias("_low"), F.max("req_ordinal").alias("_high"), F.count_if(F.col("verdict") != "ok").alias("n_conflicts"))
    whole = (F.col("n_rows") == F.col("planned")) & (F.col("_n") == F.col("n_rows")) & (F.col("_low") == 0) & (F.col("_high") == F.col("n_rows") - 1)
    outcome = F.when(~F.coalesce(whole, F.lit(False)), "incomplete").when(F.col("n_conflicts") > 0, "conflict").otherwise("committed")
    number = F.when(F.col("outcome") == "committed", F.coalesce("latest", F.lit(0)) + 1).cast("long")
    told = planned.join(sums, push, "left").withColumn("outcome", outcome).join(latest, "user_pk", "left").select(*push, F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), F.coalesce("n_conflicts", F.lit(0)).cast("long").alias("n_conflicts"), "outcome", number.alias("bundle_seq"))
    done = told.filter("outcome = 'committed'").select(*push, "bundle_seq")
    log = requests.join(done, push).select("user_pk", "bundle_seq", (F.col("req_ordinal") + 1).alias("row_ordinal"), "table_id", "key_text", F.col("op").alias("op_code"), F.when(F.col("op") != DELETE, F.col("payload")).alias("payload"))
    return told, log


def first_conflicts(judged_rows: DataFrame, live: DataFrame, by: str = "push_id") -> DataFrame:
    """The first conflicting row of each push, which is rejected whole, with the server's row where that is live."""
    bad = judged_rows.filter("verdict <> 'ok'")
    first = bad.groupBy(by).agg(F.min("req_ordinal").alias("req_ordinal"))
    found = bad.join(first, [by, "req_ordinal"]).join(live.select(*ROW, F.col("payload").alias("server_row")), ROW, "left")
    alive = F.col("state_version").isNotNull() & ~F.col("state_deleted")
    return found.select(by, "req_ordinal", *ROW, "op", "base_row_version", F.coalesce("state_version", F.lit(0)).alias("server_row_version"), F.coalesce("state_deleted", F.lit(False)).alias("server_row_deleted"), F.when(alive, F.col("server_row")).alias("server_row"), "verdict")


def rejection(registered: Column, schema: Column, table: Column, op: Column, key: Column, payload: Column, repeated: Column, key_column: str = "id", uuid_key: Column | None = None, binary: Column | None = None) -> Column:
    """Why a normalised push row is refused, first reason first; null if it is fine.

    A null schema, table or op is as invalid as a wrong one. `uuid_key` says
    whether the table's keys are UUIDs, which must be spelled canonically;
    `binary` names the table's binary columns (an array), whose values must be
    null or base64 as an encoder spells it.
    """
    names = F.json_object_keys(payload)
    in_payload = F.get_json_object(payload, f"$.{key_column}")
    has = lambda c: F.exists(names, c)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    values = F.from_json(payload, "map<string,string>")
    encoded = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?$"
    unlike = F.exists(binary, lambda n: F.element_at(values, n).isNotNull() & ~F.element_at(values, n).rlike(encoded)) if binary is not None else F.lit(False)
    wrong_key = key.isNull() | (F.length(key) == 0)
    if uuid_key is not None:
        wrong_key = wrong_key | (F.coalesce(uuid_key, F.lit(False)) & ~key.rlike(CANONICAL_UUID))
    return (
        F.when(no(schema.rlike(IDENTIFIER)), "invalid_schema")
        .when(no(table.rlike(IDENTIFIER)), "invalid_table")
        .when(no(registered), "unregistered_table")
        .when(no(op.isin("INSERT", "UPDATE", "DELETE")), "invalid_op")
        .when(wrong_key, "invalid_key")
        .when(repeated, "duplicate_target")
        .when((op == "DELETE") & payload.isNotNull(), "delete_with_payload")
        .when((op != "DELETE") & payload.isNull(), "payload_missing")
        .when((op != "DELETE") & names.isNull(), "payload_not_object")
        .when((op != "DELETE") & has(lambda n: F.lower(n) == "_sync_scope_id"), "hidden_column")
        .when((op != "DELETE") & in_payload.isNotNull() & (in_payload != key), "key_mismatch")
        .when((op != "DELETE") & has(lambda n: ~n.rlike(IDENTIFIER)), "invalid_column")
        .when((op != "DELETE") & unlike, "invalid_binary")
    )


def normalized(rows: DataFrame) -> DataFrame:
    """Push rows with schema and table lower-cased and trimmed (schema `public` if empty) and op upper-cased."""
    return rows.withColumns({"schema": F.coalesce(F.nullif(F.lower(F.trim("schema")), F.lit("")), F.lit("public")), "table": F.lower(F.trim("table")), "op": F.upper(F.trim("op"))})


def repeated_targets(rows: DataFrame, by: list[str]) -> DataFrame:
    """Targets that stand more than once in a chunk or session."""
    return rows.groupBy(*by).agg(F.count("*").alias("times")).filter("times > 1")


def contiguous(rows: DataFrame, by: str, ordinal: str, planned: DataFrame) -> DataFrame:
    """Whether the ordinals of each upload are 0 to n - 1, n being what was planned."""
    found = rows.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct(ordinal).alias("distinct"), F.min(ordinal).alias("low"), F.max(ordinal).alias("high"))
    fine = (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("distinct") == F.col("n")) & (F.col("n") == F.col("planned"))
    return planned.join(found, by, "left").select(by, "planned", F.coalesce("n", F.lit(0)).alias("uploaded"), F.coalesce(fine, F.lit(False)).alias("complete"))


def replay(uploaded_op: Column, live: Column, same: Column) -> Column:
    """What has to be sent again after a push is replayed: an op, or null."""
    return F.when(uploaded_op == DELETE, F.when(live, INSERT)).when(~live, DELETE).when(~same, UPDATE)


def resolution(result: Column, op: Column, version: Column, deleted: Column) -> Column:
    """The plan for a conflict: what the resolver's answer means for the local op and the server's row."""
    live, gone, missing = version.isNotNull() & ~deleted, version.isNotNull() & deleted, version.isNull()
    local, merged = result == "keep_local", result == "keep_merged"
    return (
        F.when(result == "accept_server", F.when(live, "apply_server_row").when(gone, "apply_delete").otherwise("drop_local"))
        .when(local & (op == INSERT), F.when(live, "requeue_update").when(gone, "requeue_insert").otherwise("error"))
        .when(local & (op == UPDATE), F.when(live, "requeue_update").otherwise("invalid"))
        .when(local & (op == DELETE), F.when(live, "requeue_delete").when(gone, "keep_deleted").otherwise("drop_state"))
        .when(merged & (op == INSERT), F.when(live, "requeue_update_merged").when(gone, "requeue_insert_merged").otherwise("error"))
        .when(merged & (op == UPDATE) & live, "requeue_update_merged")
        .otherwise(F.when(missing & merged & (op == INSERT), "error").otherwise("invalid"))
    )


def resolve(conflicts: DataFrame, resolver: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Answers of a vectorised resolver (accept_server, keep_local or keep_merged for each row) and the plans they lead to."""

    def run(frames):
        for frame in frames:
            yield frame.assign(result=resolver(frame))

    from pyspark.sql import types as T

    answered = conflicts.mapInPandas(run, T.StructType([*conflicts.schema.fields, T.StructField("result", T.StringType())]))
    return answered.withColumn("plan", resolution(F.col("result"), F.col("op"), F.col("state_version"), F.coalesce("state_deleted", F.lit(False))))


def accept_server(frame: pd.DataFrame) -> pd.Series:
    return pd.Series("accept_server", frame.index)


def keep_local(frame: pd.DataFrame) -> pd.Series:
    return pd.Series("keep_local", frame.index)


def runs(rows: DataFrame, order: str, shape: list[str], by: list[str]) -> DataFrame:
    """Numbers the runs of neighbouring rows that have the same shape (from 1)."""
    w = W.partitionBy(*by).orderBy(order)
    differs = F.lit(False)
    for c in shape:
        differs = differs | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    return rows.withColumn("starts", (differs | (F.row_number().over(w) == 1)).cast("long")).withColumn("run", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("starts")
