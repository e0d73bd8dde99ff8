"""Capture without triggers: differences of table versions, and coalescing of local edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerflow.operators import paging
from ledgerflow.operators.bundles import DELETE, INSERT, ROW, UPDATE


def row_json(columns: list[str], frame: DataFrame) -> Column:
    """The row as JSON with nulls kept; binary columns as lower-case hex."""
    kinds = dict(frame.dtypes)
    return F.to_json(F.struct(*(F.lower(F.hex(c)).alias(c) if kinds[c] == "binary" else F.col(c) for c in columns)), {"ignoreNullFields": "false"})


def diff(old: DataFrame, new: DataFrame, key: str, scope: str | None = None) -> DataFrame:
    """Effects that lead from one version of a table to the next: key, op_code and the new payload.

    A changed key is a delete of the old one and an insert of the new one. A row
    that is written again unchanged leaves no effect, as versions cannot show it.
    """
    on = [key] + ([scope] if scope else [])
    columns = [c for c in new.columns if c != scope]
    a = old.select(*on, row_json(columns, old).alias("before"))
    b = new.select(*on, row_json(columns, new).alias("payload"))
    op = F.when(F.col("before").isNull(), INSERT).when(F.col("payload").isNull(), DELETE).when(F.col("before") != F.col("payload"), UPDATE)
    return a.join(b, on, "full_outer").select(*on, op.cast("int").alias("op_code"), "payload").filter("op_code IS NOT NULL")


def scope_guard(old: DataFrame, new: DataFrame, row: str, scope: str, actor: str | None) -> DataFrame:
    """What a writer acting for the scope `actor` did between two versions of a table, each write with the reason to refuse it.

    `row` names a column that tells rows apart whatever their scope. An inserted
    row without a scope (null or empty) becomes the actor's. Reasons: a write
    without an actor (`no_bundle_context`), a row of another scope
    (`scope_mismatch`), a row moved to another scope (`scope_mutation`); null if
    the write is allowed. Refused writes keep the scope they were written with.
    """
    columns = [c for c in new.columns if c != scope]
    a = old.select(row, F.col(scope).alias("_owner"), row_json(columns, old).alias("_before"))
    b = new.select(row, F.col(scope).alias("_given"), row_json(columns, new).alias("payload"))
    moved = ~F.col("_given").eqNullSafe(F.col("_owner"))
    op = F.when(F.col("_before").isNull(), INSERT).when(F.col("payload").isNull(), DELETE).when(moved | (F.col("_before") != F.col("payload")), UPDATE)
    found = a.join(b, row, "full_outer").withColumn("op_code", op.cast("int")).filter("op_code IS NOT NULL")
    if actor is None:
        return found.select(row, "op_code", F.coalesce("_given", "_owner").alias(scope), "payload", F.lit("no_bundle_context").alias("reason"))
    inserted = F.col("op_code") == INSERT
    given = F.when(inserted & (F.coalesce("_given", F.lit("")) == ""), actor).otherwise(F.coalesce("_given", "_owner"))
    foreign = ~F.when(inserted, given).otherwise(F.col("_owner")).eqNullSafe(F.lit(actor))
    reason = F.when(foreign, "scope_mismatch").when((F.col("op_code") == UPDATE) & moved, "scope_mutation")
    return found.select(row, "op_code", given.alias(scope), "payload", reason.alias("reason"))


def write_guard(writes: DataFrame) -> DataFrame:
    """Local writes with the reason to refuse them: while a transition is pending (`pending`), only the engine (`apply_mode` 1) writes."""
    return writes.withColumn("reason", F.when(F.coalesce("pending", F.lit(False)) & (F.coalesce("apply_mode", F.lit(0)) != 1), "transition_pending"))


def captured(writes: DataFrame) -> DataFrame:
    """Local writes (user_pk, table_id, old_key, new_key, payload, ord, apply_mode) as edits, in order.

    An insert has no old key and a delete no new one. A changed key deletes the
    old row first, then writes the new one. What the engine writes while it
    applies remote rows (`apply_mode` not 0) is no edit.
    """
    old, new = F.col("old_key"), F.col("new_key")
    both = F.col("ord") * 2
    gone = F.struct(both.alias("ord"), old.alias("key_text"), F.lit(DELETE).alias("op"), F.lit(None).cast("string").alias("payload"))
    kept = F.struct((both + 1).alias("ord"), new.alias("key_text"), F.when(old.isNull(), INSERT).otherwise(UPDATE).alias("op"), F.col("payload"))
    effects = F.filter(F.array(F.when(old.isNotNull() & ~old.eqNullSafe(new), gone), F.when(new.isNotNull(), kept)), lambda x: x.isNotNull())
    return writes.filter(F.coalesce("apply_mode", F.lit(0)) == 0).select("user_pk", "table_id", F.explode(effects).alias("e")).select("user_pk", "table_id", "e.*")


def fold_edits(edits: DataFrame, state: DataFrame) -> DataFrame:
    """Local edits per row: the ordinal of the first, the last payload, the op that follows from live state.

    The base is the row state's version, or 0. Nothing is ranked.
    """
    folded = edits.groupBy(*ROW).agg(F.min("ord").alias("first_ordinal"), F.max_by("op", "ord").alias("last_op"), F.max_by("payload", "ord").alias("payload"))
    known = state.select(*ROW, F.col("bundle_seq").alias("version"), "deleted")
    found = folded.join(known, ROW, "left")
    live = F.col("version").isNotNull() & ~F.coalesce("deleted", F.lit(False))
    op = F.when(F.col("last_op") == DELETE, DELETE).when(live, UPDATE).otherwise(INSERT)
    return found.select(*ROW, op.cast("int").alias("op"), F.coalesce("version", F.lit(0)).cast("long").alias("base_row_version"), F.when(F.col("last_op") != DELETE, F.col("payload")).alias("payload"), F.col("version").isNotNull().alias("state_exists"), F.coalesce("deleted", F.lit(False)).alias("state_deleted"), F.col("first_ordinal").cast("long").alias("first_ordinal"))


def coalesce_dirty(edits: DataFrame, state: DataFrame) -> DataFrame:
    """fold_edits() with ordinals from 1 per scope, by first touch. Several rows touched by one edit go by table and key."""
    return paging.ordinals(fold_edits(edits, state), "user_pk", ["first_ordinal", "table_id", "key_text"], "dirty_ordinal").drop("first_ordinal")


def accumulate_dirty(dirty: DataFrame, edits: DataFrame, state: DataFrame) -> DataFrame:
    """Dirty rows after further edits.

    A row that was dirty keeps its base version and ordinal, and takes op and
    payload of its last edit; without one it stays as it is. Other rows get the
    ordinals after the scope's greatest, by first touch.
    """
    more = fold_edits(edits, state).select(*ROW, *(F.col(c).alias(f"_{c}") for c in ("op", "base_row_version", "payload", "state_exists", "state_deleted")), "first_ordinal")
    held = dirty.select(*ROW, "op", "base_row_version", "payload", "state_exists", "state_deleted", "dirty_ordinal")
    touched = F.col("first_ordinal").isNotNull()
    last = lambda c: F.when(touched, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    kept = held.join(more, ROW, "left").select(*ROW, last("op"), "base_row_version", last("payload"), last("state_exists"), last("state_deleted"), "dirty_ordinal")
    fresh = paging.ordinals(more.join(held.select(*ROW), ROW, "left_anti"), "user_pk", ["first_ordinal", "table_id", "key_text"], "_place")
    reached = held.groupBy("user_pk").agg(F.max("dirty_ordinal").alias("_reached"))
    added = fresh.join(reached, "user_pk", "left").select(*ROW, *(F.col(f"_{c}").alias(c) for c in ("op", "base_row_version", "payload", "state_exists", "state_deleted")), (F.coalesce("_reached", F.lit(0)) + F.col("_place")).cast("long").alias("dirty_ordinal"))
    return kept.unionByName(added)


def without_noops(dirty: DataFrame) -> DataFrame:
    """Dirty rows that mean something: not a delete of what is not there."""
    return dirty.filter(~(F.col("payload").isNull() & (~F.col("state_exists") | F.col("state_deleted"))))


def existing_as_inserts(rows: DataFrame, key: str) -> DataFrame:
    """Rows that were there before capture began, as insert intents with base version 0."""
    return rows.select(F.col(key).cast("string").alias("key_text"), F.lit(INSERT).alias("op"), F.lit(0).cast("long").alias("base_row_version"), row_json(rows.columns, rows).alias("payload"))


def send_order(dirty: DataFrame, table_order: DataFrame, ordinal: str = "dirty_ordinal") -> DataFrame:
    """Dirty rows with their place in a foreign-key-safe order: upserts from parents to children, then deletes the other way.

    `ordinal` orders the rows of a table; places count from 1 in each scope,
    whose rows need not fit into one task.
    """
    ranked = dirty.join(F.broadcast(table_order), "table_id")
    deletes = F.col("op") == DELETE
    keyed = ranked.withColumns({"_deletes": deletes.cast("int"), "_rank": F.when(deletes, -F.col("table_rank")).otherwise(F.col("table_rank"))})
    return paging.ordinals(keyed, "user_pk", ["_deletes", "_rank", ordinal], "place").drop("_deletes", "_rank", "table_rank")
