"""Change events to bundles: folding, numbering, headers and current state.

Events have user_pk (the scope), txid, ord, table_id, key_text, op (1 insert,
2 update, 3 delete) and payload (null for a delete). An effect is what a
transaction did to one row in the end; a bundle is the effects of a transaction.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerflow.functions.canonical import quoted, quoted_column

INSERT, UPDATE, DELETE = 1, 2, 3

ROW = ["user_pk", "table_id", "key_text"]


def fold(events: DataFrame, group: list[str] | None = None) -> DataFrame:
    """First op, last op, last payload and first ordinal of each row in each transaction.

    Ordinal and op travel as one number, so that one partial and one final
    aggregation give all of them.
    """
    packed = F.col("ord") * 4 + F.col("op")
    folded = events.groupBy(*(group or ["user_pk", "txid", "table_id", "key_text"])).agg(F.min(packed).alias("first"), F.max(packed).alias("last"), F.max_by("payload", "ord").alias("last_payload"))
    op = lambda c: F.col(c).bitwiseAND(F.lit(3)).cast("int")
    return folded.select(*folded.columns[:-3], F.shiftright("first", 2).alias("first_ordinal"), op("first").alias("first_op"), op("last").alias("last_op"), "last_payload")


def net(folded: DataFrame) -> DataFrame:
    """Net effects: an insert that is deleted again leaves none."""
    op = F.when(F.col("last_op") == DELETE, DELETE).when(F.col("first_op") == INSERT, INSERT).otherwise(UPDATE)
    return folded.filter((F.col("first_op") != INSERT) | (F.col("last_op") != DELETE)).select(
        *(c for c in folded.columns if c not in ("first_op", "last_op", "last_payload")),
        op.cast("int").alias("op_code"), F.when(F.col("last_op") != DELETE, F.col("last_payload")).alias("payload"),
    )


def commit_order(effects: DataFrame) -> DataFrame:
    """Per scope the transactions that have effects, numbered without gaps.

    Only one short row for each transaction is ordered, and retention bounds how
    many of them a scope keeps.
    """
    seq = F.row_number().over(W.partitionBy("user_pk").orderBy("txid"))
    return effects.select("user_pk", "txid").distinct().withColumn("bundle_seq", seq.cast("long"))


def number(effects: DataFrame) -> DataFrame:
    """Effects with bundle_seq and row_ordinal (from 1, by first ordinal, table and key)."""
    ordinal = F.row_number().over(W.partitionBy("user_pk", "txid").orderBy("first_ordinal", "table_id", F.encode("key_text", "UTF-8")))
    return effects.withColumn("row_ordinal", ordinal.cast("long")).join(commit_order(effects), ["user_pk", "txid"]).select("user_pk", "bundle_seq", "row_ordinal", "table_id", "key_text", "op_code", "payload")


def op_name(code: Column) -> Column:
    return F.when(code == INSERT, "INSERT").when(code == UPDATE, "UPDATE").when(code == DELETE, "DELETE")


def op_code(name: Column) -> Column:
    """The code of an operation's name in any case; null if there is none such."""
    word = F.upper(F.trim(name))
    return F.when(word == "INSERT", INSERT).when(word == "UPDATE", UPDATE).when(word == "DELETE", DELETE)


def _by_table(table: Column, names: dict[int, tuple[str, str, str]], part: int, unknown: Column) -> Column:
    """The canonical text of a table's namespace, name or key column."""
    found = F.coalesce(*(F.when(table == k, F.lit(quoted(own[part]))) for k, own in names.items()), unknown) if names else unknown
    return found


def logical_row(ordinal: Column, table: Column, key: Column, op: Column, version: Column, payload: Column, names: dict[int, tuple[str, str, str]]) -> Column:
    """One effect as canonical JSON, keys ascending; the ordinal counts from 0 here. Payloads are canonical JSON themselves.

    `names` has namespace, name and key column of each table; a table without an
    entry is public.table_N with the key id.
    """
    own = lambda part, unknown: _by_table(table, names, part, unknown)
    return F.concat(
        F.lit('{"key":{'), own(2, F.lit('"id"')), F.lit(":"), quoted_column(key), F.lit('},"op":"'), op_name(op), F.lit('","payload":'), F.coalesce(payload, F.lit("null")), F.lit(',"row_ordinal":'), (ordinal - 1).cast("string"),
        F.lit(',"row_version":'), version.cast("string"), F.lit(',"schema":'), own(0, F.lit('"public"')), F.lit(',"table":'), own(1, F.concat(F.lit('"table_'), table.cast("string"), F.lit('"'))), F.lit("}"),
    )


def headers(log: DataFrame, names: dict[int, tuple[str, str, str]] | None = None) -> DataFrame:
    """Row count, byte count and SHA-256 of each bundle's logical rows; a row's version is its bundle's number."""
    body = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_ordinal", "line"))), lambda r: r["line"]), ","), F.lit("]"))
    line = logical_row(F.col("row_ordinal"), F.col("table_id"), F.col("key_text"), F.col("op_code"), F.col("bundle_seq"), F.col("payload"), names or {})
    built = log.withColumn("line", line).groupBy("user_pk", "bundle_seq").agg(F.count("*").alias("row_count"), body.alias("body"))
    return built.select("user_pk", "bundle_seq", "row_count", F.octet_length("body").cast("long").alias("byte_count"), F.sha2("body", 256).alias("bundle_hash"))


def row_state(log: DataFrame) -> DataFrame:
    """The latest version of each row, and whether it is a tombstone; two numbers in one maximum."""
    last = F.max(F.col("bundle_seq") * 2 + (F.col("op_code") == DELETE).cast("long"))
    return log.groupBy(*ROW).agg(last.alias("last")).select(*ROW, F.shiftright("last", 1).alias("bundle_seq"), (F.col("last") % 2 == 1).alias("deleted"))


def advance(state: DataFrame, log: DataFrame) -> DataFrame:
    """A row state brought up to date by newer bundles only."""
    return state.unionByName(row_state(log)).groupBy(*ROW).agg(F.max(F.col("bundle_seq") * 2 + F.col("deleted").cast("long")).alias("last")).select(*ROW, F.shiftright("last", 1).alias("bundle_seq"), (F.col("last") % 2 == 1).alias("deleted"))


def bundle(events: DataFrame) -> DataFrame:
    """The numbered log of an event feed.

    Events are dealt once by transaction, which is bounded in size; the fold,
    the row ordinals and the join with the commit numbers all keep to that.
    """
    return number(net(fold(events.repartition("user_pk", "txid"))))


def committed(log: DataFrame) -> DataFrame:
    """Each bundle as one row, its effects an ordered array of structs."""
    effect = F.struct("row_ordinal", "table_id", "key_text", op_name(F.col("op_code")).alias("op"), "payload")
    return log.groupBy("user_pk", "bundle_seq").agg(F.array_sort(F.collect_list(effect)).alias("rows"))


def source_sequence(commits: DataFrame, pruned: int = 0) -> DataFrame:
    """Commits (user_pk, source_id, source_bundle_id, arrived) classified against the sequence each source must keep.

    Only the next expected number is accepted (`next`) and moves the sequence on.
    A greater one is `out_of_order`. A smaller one was accepted before: it is
    `already_committed`, or `history_pruned` where that commit is no longer kept
    (numbers up to `pruned`). Numbers below 1 and null ones are `invalid`.

    What is accepted depends on all that was before, so a source's commits pass
    one task in order of arrival; it holds one number for the source.
    """
    fields = ["user_pk", "source_id", "source_bundle_id", "arrived"]
    ordered = commits.select(*fields).repartition("user_pk", "source_id").sortWithinPartitions("user_pk", "source_id", "arrived", "source_bundle_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, reached = None, 0
        for frame in frames:
            expected, status = [], []
            for *own, number in zip(frame["user_pk"], frame["source_id"], frame["source_bundle_id"]):
                if own != source:
                    source, reached = own, 0
                expected.append(reached + 1)
                if number == reached + 1:
                    reached = int(number)
                    status.append("next")
                elif number > reached:
                    status.append("out_of_order")
                elif number >= 1:
                    status.append("history_pruned" if number <= pruned else "already_committed")
                else:
                    status.append("invalid")
            yield frame.assign(expected=expected, status=status)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema)
    return ordered.mapInPandas(run, f"{kinds}, expected long, status string")
