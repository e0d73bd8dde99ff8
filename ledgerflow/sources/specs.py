"""Registered tables, their checks, and the catalog that goes with stored state."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

IDENTIFIER = re.compile(r"[a-z0-9_]+")
SCOPE = "_sync_scope_id"
ACTIONS = {"NO ACTION", "RESTRICT", "CASCADE", "SET NULL", "SET DEFAULT"}
#: Actions that change rows, and those that a bundle can carry as effects.
CARRIED = {"NO ACTION", "RESTRICT", "CASCADE", "SET NULL"}


class SpecError(ValueError):
    """A table or foreign key cannot be replicated as it is declared."""


@dataclass(frozen=True)
class ForeignKey:
    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    deferrable: bool = True
    match: str = "SIMPLE"


@dataclass(frozen=True)
class TableSpec:
    name: str
    key: str
    schema: T.StructType
    namespace: str = "public"
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = field(default=())

    @property
    def full_name(self) -> str:
        return f"{self.namespace}.{self.name}".lower()

    @property
    def key_kind(self) -> str:
        kind = self.schema[self.key].dataType
        if isinstance(kind, T.BinaryType):
            return "uuid"
        if isinstance(kind, T.StringType):
            return "text"
        raise SpecError(f"{self.full_name}: a key of type {kind.simpleString()} is not supported; uuid and text are")


def check(spec: TableSpec) -> TableSpec:
    for name in (spec.namespace, spec.name, *spec.schema.names):
        if not IDENTIFIER.fullmatch(name):
            raise SpecError(f"{spec.full_name}: {name!r} is not an identifier of [a-z0-9_]")
    if spec.key not in spec.schema.names:
        raise SpecError(f"{spec.full_name}: no column {spec.key}")
    spec.key_kind  # noqa: B018
    if SCOPE not in spec.schema.names:
        raise SpecError(f"{spec.full_name}: no column {SCOPE}")
    if spec.unique and (SCOPE, spec.key) not in {tuple(sorted(u, key=lambda c: c != SCOPE)) for u in spec.unique}:
        raise SpecError(f"{spec.full_name}: no unique constraint on {SCOPE} and {spec.key}")
    for u in spec.unique:
        if SCOPE not in u:
            raise SpecError(f"{spec.full_name}: the unique constraint {u} lacks {SCOPE}")
    return spec


def check_foreign_keys(specs: list[TableSpec]) -> list[str]:
    """What is wrong with the foreign keys among the tables, sorted."""
    names = {s.full_name: s for s in specs}
    wrong = []
    for spec in specs:
        for k in spec.foreign_keys:
            at = f"{spec.full_name}({','.join(k.columns)})"
            if k.parent not in names:
                wrong.append(f"{at}: {k.parent} is not registered")
                continue
            if len(k.columns) != 2 or k.columns[0] != SCOPE or len(k.parent_columns) != 2 or k.parent_columns[0] != SCOPE:
                wrong.append(f"{at}: the key must be {SCOPE} and one column")
            elif k.parent_columns[1] != names[k.parent].key:
                wrong.append(f"{at}: {k.parent_columns[1]} is not the key of {k.parent}")
            if k.match != "SIMPLE":
                wrong.append(f"{at}: MATCH {k.match} is not supported")
            if not k.deferrable:
                wrong.append(f"{at}: the constraint must be deferrable")
            wrong += [f"{at}: ON {what} {action} is not supported" for what, action in (("DELETE", k.on_delete), ("UPDATE", k.on_update)) if action not in CARRIED]
    return sorted(wrong)


def catalog(spark: SparkSession, specs: list[TableSpec]) -> DataFrame:
    """Tables by number: the rank of the lower-case full name, from 1."""
    ordered = sorted(specs, key=lambda s: s.full_name)
    return spark.createDataFrame([(k, s.full_name, s.key, s.key_kind) for k, s in enumerate(ordered, 1)], "table_id int, table_name string, key_column string, key_kind string")


def catalog_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Entries that two catalogs do not share; none if stored state fits the registered tables."""
    e = expected.select("table_id", *(F.col(c).alias(f"expected_{c}") for c in expected.columns if c != "table_id"))
    a = actual.select("table_id", *(F.col(c).alias(f"actual_{c}") for c in actual.columns if c != "table_id"))
    same = F.lit(True)
    for c in expected.columns:
        if c != "table_id":
            same = same & F.col(f"expected_{c}").eqNullSafe(F.col(f"actual_{c}"))
    return e.join(a, "table_id", "full_outer").filter(~same)


def foreign_key_columns(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Per foreign key its child and parent columns, the n-th of one side beside the n-th of the other.

    `child` has constraint_name, child, ordinal and child_column, `parent` the
    like; a constraint without a parent side is no foreign key.
    """
    met = child.join(parent, ["constraint_name", "ordinal"])
    spelled = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", c))), lambda x: x[c]), ",").alias(f"{c}s")
    # a key has as many columns as its table at most
    return met.groupBy("constraint_name", "child", "parent").agg(spelled("child_column"), spelled("parent_column"), F.count("*").alias("n"))


def columns_of(df: DataFrame) -> DataFrame:
    """Name, type, ordinal and nullability of each column."""
    return df.sparkSession.createDataFrame([(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(df.schema.fields, 1)], "ordinal int, column_name string, data_type string, nullable boolean")
