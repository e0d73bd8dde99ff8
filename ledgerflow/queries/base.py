"""Inputs that the queries derive from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerflow.operators import bundles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a change feed of 16 scopes."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS ord", "user_id % 16 AS user_pk", "event_id DIV 500 AS txid", "CAST(1 + event_id % 3 AS INT) AS table_id",
        "concat('k', CAST(floor(value) AS BIGINT) % 10) AS key_text",
        "CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 3 ELSE 2 END AS op",
        "CASE WHEN event_type <> 'error' THEN replace(props, ' ', '') END AS payload",
    )


FEED = """feed AS (
  SELECT event_id AS ord, user_id % 16 AS user_pk, event_id // 500 AS txid, CAST(1 + event_id % 3 AS INTEGER) AS table_id,
    'k' || CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR) AS key_text,
    CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 3 ELSE 2 END AS op,
    CASE WHEN event_type <> 'error' THEN replace(props, ' ', '') END AS payload
  FROM events)"""

FOLDED = FEED + """, folded AS (
  SELECT user_pk, txid, table_id, key_text, min(ord) AS first_ordinal, arg_min(op, ord) AS first_op, arg_max(op, ord) AS last_op, arg_max_null(payload, ord) AS last_payload
  FROM feed GROUP BY user_pk, txid, table_id, key_text)"""

NET = FOLDED + """, net AS (
  SELECT user_pk, txid, table_id, key_text, first_ordinal, CASE WHEN last_op = 3 THEN 3 WHEN first_op = 1 THEN 1 ELSE 2 END AS op_code,
    CASE WHEN last_op <> 3 THEN last_payload END AS payload
  FROM folded WHERE NOT (first_op = 1 AND last_op = 3))"""

LOG = NET + """, log AS (
  SELECT user_pk, dense_rank() OVER (PARTITION BY user_pk ORDER BY txid) AS bundle_seq,
    row_number() OVER (PARTITION BY user_pk, txid ORDER BY first_ordinal, table_id, key_text) AS row_ordinal, table_id, key_text, op_code, payload
  FROM net)"""

STATE = LOG + """, state AS (
  SELECT user_pk, table_id, key_text, max(bundle_seq) AS bundle_seq, arg_max(op_code, bundle_seq) = 3 AS deleted
  FROM log GROUP BY user_pk, table_id, key_text)"""

LIVE = STATE + """, live AS (
  SELECT s.user_pk, s.table_id, s.key_text, l.payload FROM state s JOIN log l USING (user_pk, table_id, key_text, bundle_seq) WHERE NOT s.deleted)"""

HALF = STATE.replace(" FROM events)", " FROM events WHERE event_id < (SELECT (max(event_id) // 1000 + 1) * 500 FROM events))")

#: Namespace, name and key column of the feed's tables.
NAMES = {1: ("public", "users", "id"), 2: ("public", "posts", "id"), 3: ("app", "files", "file_id")}

LINE = """'{"key":{"' || CASE table_id WHEN 3 THEN 'file_id' ELSE 'id' END || '":"' || key_text || '"},"op":"' || CASE op_code WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' ELSE 'DELETE' END || '","payload":' || coalesce(payload, 'null')
  || ',"row_ordinal":' || CAST(row_ordinal - 1 AS VARCHAR) || ',"row_version":' || CAST(bundle_seq AS VARCHAR) || ',"schema":"' || CASE table_id WHEN 3 THEN 'app' ELSE 'public' END || '","table":"' || CASE table_id WHEN 1 THEN 'users' WHEN 2 THEN 'posts' ELSE 'files' END || '"}'"""

HEADERS = LOG + f""", bodies AS (
  SELECT user_pk, bundle_seq, count(*) AS row_count, '[' || string_agg({LINE}, ',' ORDER BY row_ordinal) || ']' AS body FROM log GROUP BY user_pk, bundle_seq
), headers AS (
  SELECT user_pk, bundle_seq, row_count, CAST(octet_length(encode(body)) AS BIGINT) AS byte_count, sha256(body) AS bundle_hash FROM bodies)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.bundle(feed(spark, sf_dir))


def first_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's first half: what a follower has seen."""
    return feed(spark, sf_dir).filter(F.col("ord") < _middle(spark, sf_dir))


def _middle(spark: SparkSession, sf_dir: str) -> int:
    """The first event of the transaction after the middle one: a follower sees whole transactions."""
    return (table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] // 1000 + 1) * 500


def live(log_rows: DataFrame, state: DataFrame) -> DataFrame:
    """Live business rows as the log leaves them."""
    return state.filter("NOT deleted").join(log_rows, ["user_pk", "table_id", "key_text", "bundle_seq"]).select("user_pk", "table_id", "key_text", "payload")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushed rows out of the feed's second half: one for each key and transaction, with base versions of all kinds."""
    return feed(spark, sf_dir).filter(F.col("ord") >= _middle(spark, sf_dir)).selectExpr("user_pk", "txid AS push_id", "ord AS req_ordinal", "table_id", "key_text", "op", "ord % 7 AS base_row_version", "payload")


REQUESTS = """requests AS (
  SELECT user_id % 16 AS user_pk, event_id // 500 AS push_id, event_id AS req_ordinal, CAST(1 + event_id % 3 AS INTEGER) AS table_id,
    'k' || CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR) AS key_text,
    CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 3 ELSE 2 END AS op, event_id % 7 AS base_row_version,
    CASE WHEN event_type <> 'error' THEN replace(props, ' ', '') END AS payload
  FROM events WHERE event_id >= (SELECT (max(event_id) // 1000 + 1) * 500 FROM events))"""

VERDICT = """CASE WHEN op = 1 AND version IS NULL THEN CASE WHEN base_row_version = 0 THEN 'ok' ELSE 'version_mismatch' END
  WHEN op = 1 AND NOT deleted THEN CASE WHEN base_row_version = version THEN 'already_exists' ELSE 'version_mismatch' END
  WHEN op = 1 THEN CASE WHEN base_row_version = version THEN 'ok' ELSE 'version_mismatch' END
  WHEN version IS NULL OR deleted THEN 'does_not_exist' WHEN base_row_version = version THEN 'ok' ELSE 'version_mismatch' END"""

JUDGED = HALF + ", " + REQUESTS + f""", judged AS (
  SELECT *, {VERDICT} AS verdict FROM (
    SELECT r.*, s.bundle_seq AS version, coalesce(s.deleted, false) AS deleted FROM requests r LEFT JOIN state s USING (user_pk, table_id, key_text)))"""
