"""DML on immutable tables, joins between replicated tables, and cascades of foreign keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerflow.operators.bundles import DELETE
from ledgerflow.runtime import cut


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The base with changed rows replaced, new ones added and deleted ones left out.

    Changes have op_code and the base's columns; each key stands once.
    """
    columns = base.columns
    kept = base.join(changes.select(*key), key, "left_anti").select(*columns)
    return kept.unionByName(changes.filter(F.col("op_code") != DELETE).select(*columns))


def update_columns(base: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Partial update: only the columns that a change names (array `columns_set`) get its values."""
    renamed = changes.select(*key, "columns_set", *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = base.join(renamed, key, "left")
    named = lambda c: F.coalesce(F.array_contains("columns_set", c), F.lit(False))
    return joined.select(*(F.when(named(c), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def replace_all(managed: DataFrame, snapshot: DataFrame, expected: int) -> DataFrame:
    """A follower's tables after a rebuild: the snapshot's rows in the managed schema, if they are as many as announced."""
    found = snapshot.count()
    if found != expected:
        raise ValueError(f"the snapshot has {found} rows, {expected} were announced")
    return snapshot.select(*managed.columns)


def column_mismatch(payload: Column, columns: list[str]) -> Column:
    """Columns that a payload has too many or too few, sorted; empty if it has exactly the table's."""
    names, wanted = F.json_object_keys(payload), F.array(*map(F.lit, columns))
    return F.array_sort(F.array_union(F.array_except(names, wanted), F.array_except(wanted, names)))


def orphans(child: DataFrame, parent: DataFrame, child_column: str, parent_column: str) -> DataFrame:
    """Child rows whose reference has no parent; null references have none to miss."""
    return child.filter(F.col(child_column).isNotNull()).join(parent.select(F.col(parent_column).alias(child_column)), child_column, "left_anti")


def existing(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on), on, "left_semi")


def compare_proof(outbox: DataFrame, committed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that an outbox and the committed bundle do not have equally often, with both counts."""
    sides = outbox.select(*columns, F.lit(1).alias("_sent"), F.lit(0).alias("_kept")).unionByName(committed.select(*columns, F.lit(0).alias("_sent"), F.lit(1).alias("_kept")))
    both = sides.groupBy(*columns).agg(F.sum("_sent").alias("sent"), F.sum("_kept").alias("kept"))
    return both.filter("sent <> kept")


def cascade(deleted: DataFrame, edges: list[tuple[str, str, str, str]], tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """Rows that go when the rows `deleted` (table_name, key_text) go, by foreign keys (child, child column, parent, action).

    Returns table_name, key_text, effect (`DELETE` or `SET NULL`) and depth. Each
    round follows all keys once; no round follows a set-null. It ends when a
    round finds no new row, so cycles are no trouble.
    """
    found = cut(deleted.select("table_name", F.col("key_text").cast("string").alias("key_text"), F.lit("DELETE").alias("effect"), F.lit(0).alias("depth")), "cascade")
    front, depth = found, 0
    while True:
        depth += 1
        steps = []
        for child, column, parent, action in edges:
            gone = front.filter((F.col("table_name") == parent) & (F.col("effect") == "DELETE")).select(F.col("key_text").alias("_parent"))
            hit = tables[child].join(gone, tables[child][column].cast("string") == gone["_parent"], "left_semi")
            steps.append(hit.select(F.lit(child).alias("table_name"), F.col(keys[child]).cast("string").alias("key_text"), F.lit("DELETE" if action == "CASCADE" else "SET NULL").alias("effect"), F.lit(depth).alias("depth")))
        if not steps:
            return found
        new = steps[0]
        for s in steps[1:]:
            new = new.union(s)
        front = cut(new.distinct().join(found.select("table_name", "key_text", "effect"), ["table_name", "key_text", "effect"], "left_anti").select("table_name", "key_text", "effect", "depth"), "cascade")
        if front.isEmpty():
            # a row that goes is not set null as well
            gone = found.filter("effect = 'DELETE'").select("table_name", "key_text", F.lit("SET NULL").alias("effect"))
            return found.join(gone, ["table_name", "key_text", "effect"], "left_anti").select("table_name", "key_text", "effect", "depth")
        found = cut(found.union(front), "cascade")


def cascade_updates(changed: DataFrame, edges: list[tuple[str, str, str, str]], tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """Columns that change when keys change (table_name, old_key, new_key), by foreign keys (child, child column, parent, action).

    Returns table_name, key_text (the key before), column, new_value and depth.
    `CASCADE` follows the parent's new key, `SET NULL` clears the column; other
    actions change nothing. A child whose key is the column that changed hands
    its own change on. Each key changes once, so cycles end.
    """
    spark = changed.sparkSession
    keyed = {(c, column): tables[c].schema[column].dataType.simpleString() == "string" for c, column, *_ in edges}
    front = cut(changed.select("table_name", F.col("old_key").cast("string").alias("old_key"), F.col("new_key").cast("string").alias("new_key")), "cascade")
    moved, found, depth = front, None, 0
    while not front.isEmpty():
        depth += 1
        steps = None
        for child, column, parent, action in edges:
            if action not in ("CASCADE", "SET NULL"):
                continue
            kind = tables[child].schema[column].dataType
            gone = front.filter(F.col("table_name") == parent).select((F.col("old_key") if keyed[child, column] else F.col("old_key").try_cast(kind)).alias("_old"), "new_key")
            hit = tables[child].join(gone, F.col(column) == F.col("_old"))
            value = F.col("new_key") if action == "CASCADE" else F.lit(None).cast("string")
            step = hit.select(F.lit(child).alias("table_name"), F.col(keys[child]).cast("string").alias("key_text"), F.lit(column).alias("column"), value.alias("new_value"), F.lit(depth).alias("depth"))
            steps = step if steps is None else steps.unionByName(step)
        if steps is None:
            break
        more = cut(steps if found is None else steps.join(found.select("table_name", "key_text", "column"), ["table_name", "key_text", "column"], "left_anti"), "cascade")
        key_column = F.coalesce(*(F.when(F.col("table_name") == t, F.lit(k)) for t, k in keys.items()))
        rekeyed = more.filter((F.col("column") == key_column) & F.col("new_value").isNotNull()).select("table_name", F.col("key_text").alias("old_key"), F.col("new_value").alias("new_key"))
        front = cut(rekeyed.join(moved.select("table_name", "old_key"), ["table_name", "old_key"], "left_anti"), "cascade")
        moved = moved.unionByName(front)
        found = more if found is None else found.unionByName(more)
    return spark.createDataFrame([], "table_name string, key_text string, column string, new_value string, depth int") if found is None else found
