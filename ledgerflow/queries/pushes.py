"""Conflicts, validation, retention, pull, paging and follower queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.operators import bundles, conflicts, follower, paging, tables
from ledgerflow.queries import base as B, query


def judged(spark, d):
    return conflicts.judged(B.requests(spark, d), bundles.row_state(bundles.bundle(B.first_half(spark, d))))


@query("joi_01_requests_with_state", f"WITH {B.JUDGED} SELECT user_pk, push_id, req_ordinal, table_id, key_text, version AS state_version, CASE WHEN version IS NULL THEN NULL ELSE deleted END AS state_deleted FROM judged")
def requests_with_state(spark, d):
    return conflicts.with_state(B.requests(spark, d), bundles.row_state(bundles.bundle(B.first_half(spark, d)))).select("user_pk", "push_id", "req_ordinal", "table_id", "key_text", "state_version", "state_deleted")


@query("op_07_conflict_validation", f"WITH {B.JUDGED} SELECT user_pk, push_id, req_ordinal, verdict FROM judged")
def conflict_validation(spark, d):
    return judged(spark, d).select("user_pk", "push_id", "req_ordinal", "verdict")


@query(
    "op_08_conflict_report",
    f"WITH {B.JUDGED}, live AS (SELECT s.user_pk, s.table_id, s.key_text, l.payload AS server_row FROM state s JOIN log l USING (user_pk, table_id, key_text, bundle_seq) WHERE NOT s.deleted), f AS (SELECT push_id, min(req_ordinal) AS req_ordinal FROM judged WHERE verdict <> 'ok' GROUP BY push_id) SELECT j.push_id, j.req_ordinal, user_pk, table_id, key_text, op, base_row_version, coalesce(version, 0) AS server_row_version, deleted AS server_row_deleted, server_row, verdict FROM judged j JOIN f USING (push_id, req_ordinal) LEFT JOIN live USING (user_pk, table_id, key_text)",
)
def conflict_report(spark, d):
    log = bundles.bundle(B.first_half(spark, d))
    state = bundles.row_state(log)
    return conflicts.first_conflicts(conflicts.judged(B.requests(spark, d), state), B.live(log, state))


_RESOLUTION = """CASE WHEN result = 'accept_server' THEN CASE WHEN version IS NULL THEN 'drop_local' WHEN deleted THEN 'apply_delete' ELSE 'apply_server_row' END
 WHEN result = 'keep_local' AND op = 1 THEN CASE WHEN version IS NULL THEN 'error' WHEN deleted THEN 'requeue_insert' ELSE 'requeue_update' END
 WHEN result = 'keep_local' AND op = 2 THEN CASE WHEN version IS NULL OR deleted THEN 'invalid' ELSE 'requeue_update' END
 WHEN result = 'keep_local' THEN CASE WHEN version IS NULL THEN 'drop_state' WHEN deleted THEN 'keep_deleted' ELSE 'requeue_delete' END
 WHEN op = 1 THEN CASE WHEN version IS NULL THEN 'error' WHEN deleted THEN 'requeue_insert_merged' ELSE 'requeue_update_merged' END
 WHEN op = 2 AND version IS NOT NULL AND NOT deleted THEN 'requeue_update_merged' ELSE 'invalid' END"""


@query("op_18_conflict_resolution", f"WITH {B.JUDGED} SELECT req_ordinal, {_RESOLUTION} AS plan FROM (SELECT *, CASE req_ordinal % 3 WHEN 0 THEN 'accept_server' WHEN 1 THEN 'keep_local' ELSE 'keep_merged' END AS result FROM judged WHERE verdict <> 'ok')")
def conflict_resolution(spark, d):
    bad = judged(spark, d).filter("verdict <> 'ok'")
    result = F.when(F.col("req_ordinal") % 3 == 0, "accept_server").when(F.col("req_ordinal") % 3 == 1, "keep_local").otherwise("keep_merged")
    return bad.select("req_ordinal", conflicts.resolution(result, F.col("op"), F.col("state_version"), F.coalesce("state_deleted", F.lit(False))).alias("plan"))


@query("op_18b_resolver_callable", f"WITH {B.JUDGED} SELECT req_ordinal, result, {_RESOLUTION} AS plan FROM (SELECT *, 'keep_local' AS result FROM judged WHERE verdict <> 'ok')")
def resolver_callable(spark, d):
    return conflicts.resolve(judged(spark, d).filter("verdict <> 'ok'"), conflicts.keep_local).select("req_ordinal", "result", "plan")


_RAW = """raw AS (SELECT event_id AS ord, event_id // 50 AS chunk, CASE event_id % 11 WHEN 0 THEN 'Bad-Schema' WHEN 1 THEN '' ELSE ' Public ' END AS schema, CASE event_id % 13 WHEN 0 THEN 'no table' WHEN 1 THEN 'other' ELSE ' Events' END AS "table",
 CASE WHEN event_id % 17 = 0 THEN 'upsert' WHEN event_type = 'error' THEN ' delete' ELSE 'Update ' END AS op, CASE WHEN event_id % 19 = 0 THEN NULL ELSE 'u' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 40 AS VARCHAR) END AS key,
 CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '[1]' WHEN event_id % 31 = 0 THEN '{"_sync_scope_id":1}' WHEN event_id % 37 = 0 THEN '{"id":"zz"}' WHEN event_id % 41 = 0 THEN '{"Bad Col":1}' WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL ELSE props END AS payload FROM events)"""


def raw_rows(spark, d):
    B.table(spark, d, "events").createOrReplaceTempView("_raw_events")
    return spark.sql("""SELECT event_id AS ord, event_id DIV 50 AS chunk, CASE event_id % 11 WHEN 0 THEN 'Bad-Schema' WHEN 1 THEN '' ELSE ' Public ' END AS schema, CASE event_id % 13 WHEN 0 THEN 'no table' WHEN 1 THEN 'other' ELSE ' Events' END AS table,
 CASE WHEN event_id % 17 = 0 THEN 'upsert' WHEN event_type = 'error' THEN ' delete' ELSE 'Update ' END AS op, CASE WHEN event_id % 19 = 0 THEN NULL ELSE concat('u', user_id, '-', event_id % 40) END AS key,
 CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '[1]' WHEN event_id % 31 = 0 THEN '{"_sync_scope_id":1}' WHEN event_id % 37 = 0 THEN '{"id":"zz"}' WHEN event_id % 41 = 0 THEN '{"Bad Col":1}' WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL ELSE props END AS payload FROM _raw_events""")


_NORMAL = _RAW + """, rows AS (SELECT ord, chunk, coalesce(nullif(lower(trim(schema)), ''), 'public') AS schema, lower(trim("table")) AS "table", upper(trim(op)) AS op, key, payload FROM raw)"""


@query("prj_06_normalized_rows", f"WITH {_NORMAL} SELECT ord, schema, \"table\", op FROM rows")
def normalized_rows(spark, d):
    return conflicts.normalized(raw_rows(spark, d)).select("ord", "schema", "table", "op")


@query(
    "flt_02_push_validation",
    f"""WITH {_NORMAL}, dup AS (SELECT chunk, "table", key FROM rows GROUP BY chunk, "table", key HAVING count(*) > 1)
    SELECT ord, CASE WHEN NOT regexp_full_match(schema, '[a-z0-9_]+') THEN 'invalid_schema' WHEN NOT regexp_full_match("table", '[a-z0-9_]+') THEN 'invalid_table' WHEN "table" <> 'events' THEN 'unregistered_table'
      WHEN op NOT IN ('INSERT', 'UPDATE', 'DELETE') THEN 'invalid_op' WHEN key IS NULL THEN 'invalid_key' WHEN EXISTS (SELECT 1 FROM dup WHERE dup.chunk = rows.chunk AND dup."table" = rows."table" AND dup.key = rows.key) THEN 'duplicate_target'
      WHEN op = 'DELETE' AND payload IS NOT NULL THEN 'delete_with_payload' WHEN op <> 'DELETE' AND payload IS NULL THEN 'payload_missing' WHEN op <> 'DELETE' AND json_type(payload) <> 'OBJECT' THEN 'payload_not_object'
      WHEN op <> 'DELETE' AND list_contains(json_keys(payload), '_sync_scope_id') THEN 'hidden_column' WHEN op <> 'DELETE' AND json_extract_string(payload, '$.id') <> key THEN 'key_mismatch' WHEN op <> 'DELETE' AND list_contains(json_keys(payload), 'Bad Col') THEN 'invalid_column' END AS reason FROM rows""",
)
def push_validation(spark, d):
    rows = conflicts.normalized(raw_rows(spark, d))
    again = conflicts.repeated_targets(rows, ["chunk", "table", "key"]).filter("key IS NOT NULL")
    marked = rows.join(again, ["chunk", "table", "key"], "left")
    reason = conflicts.rejection(F.col("table") == "events", F.col("schema"), F.col("table"), F.col("op"), F.col("key"), F.col("payload"), F.col("times").isNotNull())
    return marked.select("ord", reason.alias("reason"))


@query("flt_01_identifiers", "SELECT DISTINCT event_type, regexp_full_match(event_type, '[a-z0-9_]+') AS valid, regexp_full_match(event_type || ' x', '[a-z0-9_]+') AS spaced FROM events")
def identifiers(spark, d):
    return B.table(spark, d, "events").select("event_type").distinct().select("event_type", F.col("event_type").rlike(conflicts.IDENTIFIER).alias("valid"), F.concat("event_type", F.lit(" x")).rlike(conflicts.IDENTIFIER).alias("spaced"))


@query("agg_13_duplicate_targets", "SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_targets(spark, d):
    return conflicts.repeated_targets(B.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "agg_14_contiguous_uploads",
    "WITH r AS (SELECT l_orderkey, l_linenumber - 1 AS ord FROM lineitem), p AS (SELECT DISTINCT l_orderkey, l_orderkey % 5 + 1 AS planned FROM lineitem), g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT ord) AS u, min(ord) AS lo, max(ord) AS hi FROM r GROUP BY l_orderkey) SELECT l_orderkey, planned, n AS uploaded, lo = 0 AND hi = n - 1 AND u = n AND n = planned AS complete FROM p JOIN g USING (l_orderkey)",
)
def contiguous_uploads(spark, d):
    rows = B.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber - 1 AS ord")
    return conflicts.contiguous(rows, "l_orderkey", "ord", rows.selectExpr("l_orderkey", "l_orderkey % 5 + 1 AS planned").distinct())


@query(
    "win_04_shape_runs",
    f"WITH {B.LOG}, x AS (SELECT user_pk, bundle_seq, row_ordinal, CASE WHEN row_number() OVER w = 1 OR lag(table_id) OVER w IS DISTINCT FROM table_id OR lag(op_code) OVER w IS DISTINCT FROM op_code THEN 1 ELSE 0 END AS starts FROM log WINDOW w AS (PARTITION BY user_pk, bundle_seq ORDER BY row_ordinal)) SELECT user_pk, bundle_seq, row_ordinal, CAST(sum(starts) OVER (PARTITION BY user_pk, bundle_seq ORDER BY row_ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM x",
)
def shape_runs(spark, d):
    return conflicts.runs(B.log(spark, d), "row_ordinal", ["table_id", "op_code"], ["user_pk", "bundle_seq"]).select("user_pk", "bundle_seq", "row_ordinal", "run")


@query("win_05_chunks", f"WITH {B.LOG} SELECT user_pk, bundle_seq, (row_ordinal - 1) // 7 AS chunk, count(*) AS n FROM log GROUP BY ALL")
def chunks(spark, d):
    return paging.chunked(B.log(spark, d), "row_ordinal", 7).groupBy("user_pk", "bundle_seq", "chunk").agg(F.count("*").alias("n"))


@query("win_06_increasing", "WITH x AS (SELECT user_id, event_id, event_id % 97 AS v, lag(event_id % 97) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, NOT coalesce(bool_or(p IS NOT NULL AND v <= p), false) AS increasing, min(event_id) FILTER (WHERE p IS NOT NULL AND v <= p) AS first_bad FROM x GROUP BY user_id")
def increasing(spark, d):
    return paging.increasing(B.table(spark, d, "events").selectExpr("user_id", "event_id", "event_id % 97 AS v"), "user_id", "event_id", "v")


for _name in ("win_08_forwarded", "str_03_hub_filter"):

    @query(_name, "WITH x AS (SELECT user_id, event_id, event_id % 97 AS seq, max(event_id % 97) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events) SELECT user_id, event_id, seq FROM x WHERE top IS NULL OR seq > top")
    def forwarded(spark, d):
        return paging.forwarded(B.table(spark, d, "events").selectExpr("user_id", "event_id", "event_id % 97 AS seq"), "user_id", "event_id", "seq")


_FLOORS = "floors AS (SELECT user_pk, latest, floor, CASE WHEN greatest(0, latest - 6) > floor THEN least(greatest(0, latest - 6), floor + 4) ELSE floor END AS new_floor FROM (SELECT user_pk, max(bundle_seq) AS latest, user_pk % 3 AS floor FROM log GROUP BY user_pk))"


def new_floors(spark, d):
    latest = B.log(spark, d).groupBy("user_pk").agg(F.max("bundle_seq").alias("latest")).withColumn("floor", F.col("user_pk") % 3)
    return paging.floors(latest, 6, 4)


@query("op_13_retention_floors", f"WITH {B.LOG}, {_FLOORS} SELECT * FROM floors")
def retention_floors(spark, d):
    return new_floors(spark, d)


for _name in ("dml_06_prune", "joi_13_delete_using", "joi_03_log_above_floor"):

    @query(_name, f"WITH {B.LOG}, {_FLOORS} SELECT log.* FROM log JOIN floors USING (user_pk) WHERE bundle_seq > new_floor")
    def prune(spark, d):
        return paging.prune(B.log(spark, d), new_floors(spark, d))


@query("flt_03_pruned", f"WITH {B.LOG} SELECT DISTINCT user_pk, bundle_seq, bundle_seq > 0 AND bundle_seq <= user_pk % 3 AS pruned FROM log")
def pruned(spark, d):
    return B.log(spark, d).select("user_pk", "bundle_seq").distinct().withColumn("pruned", paging.is_pruned(F.col("bundle_seq"), F.col("user_pk") % 3))


for _name in ("op_09_incremental_pull", "srt_01_pull_page"):

    @query(
        _name,
        f"WITH {B.LOG}, c AS (SELECT user_pk, user_pk % 5 AS after, user_pk % 3 AS floor, max(bundle_seq) - 1 AS stable FROM log GROUP BY user_pk) SELECT log.*, stable > greatest(after, floor) + 4 AS has_more FROM log JOIN c USING (user_pk) WHERE NOT (after > 0 AND after <= floor) AND bundle_seq > greatest(after, floor) AND bundle_seq <= least(stable, greatest(after, floor) + 4)",
    )
    def incremental_pull(spark, d):
        log = B.log(spark, d)
        cursors = log.groupBy("user_pk").agg((F.max("bundle_seq") - 1).alias("stable")).selectExpr("user_pk", "user_pk % 5 AS after", "user_pk % 3 AS floor", "stable")
        return paging.pull_all(log, cursors, 4)


@query("op_09b_pull_one_scope", f"WITH {B.LOG} SELECT * FROM log WHERE user_pk = 3 AND bundle_seq > 2 AND bundle_seq <= 6")
def pull_one(spark, d):
    log = B.log(spark, d)
    latest = log.filter("user_pk = 3").agg(F.coalesce(F.max("bundle_seq"), F.lit(0))).first()[0]
    return paging.pull(log, 3, after=2, latest=latest, limit=4).rows


for _name, _limit in (("flt_04_keyset_page", 25), ("srt_04_committed_rows_page", 10)):

    @query(_name, f"WITH {B.LOG} SELECT * FROM log WHERE user_pk = 5 AND bundle_seq = 2 AND row_ordinal > 4 ORDER BY row_ordinal LIMIT {_limit + 1}")
    def keyset(spark, d, n=_limit):
        return paging.keyset_page(B.log(spark, d).filter("user_pk = 5 AND bundle_seq = 2"), "row_ordinal", 4, n)


@query("flt_05_expired_sessions", "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-01'")
def expired(spark, d):
    sessions = B.table(spark, d, "orders").withColumnRenamed("o_orderdate", "expires_at")
    return paging.expired(sessions, F.lit("1995-06-01").cast("timestamp_ntz")).select("o_orderkey")


@query("srt_06_page_sizes", "SELECT event_id, least(CASE WHEN event_id % 6000 > 0 THEN event_id % 6000 ELSE 1000 END, 5000) AS size FROM events")
def page_sizes(spark, d):
    asked = F.col("event_id") % 6000
    return B.table(spark, d, "events").select("event_id", F.least(F.when(asked > 0, asked).otherwise(paging.PULL_DEFAULT), F.lit(paging.PULL_MAX)).alias("size"))


_FOLLOW = B.HALF + ", " + B.LOG.replace("feed AS", "feed2 AS", 1).replace("FROM feed ", "FROM feed2 ").replace("folded AS", "folded2 AS").replace("FROM folded ", "FROM folded2 ").replace("net AS", "net2 AS").replace("FROM net)", "FROM net2)").replace("log AS", "log2 AS")


def follower_state(spark, d):
    log = bundles.bundle(B.first_half(spark, d))
    return bundles.row_state(log).join(log.select("user_pk", "table_id", "key_text", "bundle_seq", "payload"), ["user_pk", "table_id", "key_text", "bundle_seq"])


@query(
    "flt_06_version_gate",
    f"WITH {_FOLLOW}, l AS (SELECT user_pk, table_id, key_text, max(bundle_seq) AS row_version, arg_max(op_code, bundle_seq) AS op_code, arg_max_null(payload, bundle_seq) AS payload FROM log2 GROUP BY ALL) SELECT l.* FROM l LEFT JOIN state s USING (user_pk, table_id, key_text) WHERE s.bundle_seq IS NULL OR l.row_version > s.bundle_seq".replace("GROUP BY ALL) SELECT", "GROUP BY user_pk, table_id, key_text) SELECT"),
)
def version_gate(spark, d):
    return follower.newer(follower.latest_effects(B.log(spark, d)), bundles.row_state(bundles.bundle(B.first_half(spark, d))))


for _name in ("op_14_follower_apply", "dml_04_authoritative_apply"):

    @query(_name, f"WITH {B.STATE} SELECT s.user_pk, s.table_id, s.key_text, s.bundle_seq, s.deleted, l.payload FROM state s JOIN log l USING (user_pk, table_id, key_text, bundle_seq)")
    def follower_apply(spark, d):
        return follower.apply(follower_state(spark, d), B.log(spark, d))


@query("str_08_checkpoint", f"WITH {B.LOG}, f AS (SELECT DISTINCT user_pk, bundle_seq FROM log WHERE bundle_seq % 7 <> 0 AND bundle_seq > 2), r AS (SELECT user_pk, max(bundle_seq) AS reached FROM (SELECT *, row_number() OVER (PARTITION BY user_pk ORDER BY bundle_seq) AS nth FROM f) WHERE bundle_seq = 2 + nth GROUP BY user_pk) SELECT s.user_pk, coalesce(reached, 2) AS seq FROM (SELECT DISTINCT user_pk FROM log) s LEFT JOIN r USING (user_pk)")
def checkpoint(spark, d):
    log = B.log(spark, d)
    return follower.checkpoint(log.select("user_pk").distinct().withColumn("seq", F.lit(2).cast("long")), log.filter("bundle_seq % 7 <> 0"))


_UPLOADED = "u AS (SELECT user_pk, table_id, key_text, arg_max(op, req_ordinal) AS op, CASE WHEN arg_max(op, req_ordinal) = 3 THEN NULL ELSE arg_max_null(payload, req_ordinal) END AS payload, max(push_id) AS row_version FROM requests GROUP BY user_pk, table_id, key_text)"


for _name in ("op_17_replay_reconcile", "joi_14_replay_decision"):

    @query(
        _name,
        f"""WITH {B.LIVE.replace(' FROM events)', ' FROM events WHERE event_id < (SELECT (max(event_id) // 1000 + 1) * 500 FROM events))')}, {B.REQUESTS}, {_UPLOADED}, pending AS (SELECT * FROM u WHERE CAST(substr(key_text, 2) AS INTEGER) % 2 = 0),
        j AS (SELECT u.*, p.key_text IS NOT NULL AS is_pending, p.payload AS pp, l.key_text IS NOT NULL AS is_live, l.payload AS lp FROM u LEFT JOIN (SELECT user_pk, table_id, key_text, '{{}}' AS payload FROM pending) p USING (user_pk, table_id, key_text) LEFT JOIN live l USING (user_pk, table_id, key_text)),
        q AS (SELECT *, CASE WHEN op = 3 THEN CASE WHEN is_live THEN 1 END WHEN NOT is_live THEN 3 WHEN NOT ((NOT is_pending OR pp IS NOT DISTINCT FROM payload) AND lp IS NOT DISTINCT FROM payload) THEN 2 END AS r FROM j)
        SELECT user_pk, table_id, key_text, CAST(r AS INTEGER) AS op, row_version AS base_row_version, CASE WHEN r <> 3 THEN lp END AS payload FROM q WHERE r IS NOT NULL""",
    )
    def reconcile(spark, d):
        log = bundles.bundle(B.first_half(spark, d))
        uploaded = B.requests(spark, d).groupBy(*bundles.ROW).agg(F.max_by("op", "req_ordinal").alias("op"), F.max_by("payload", "req_ordinal").alias("payload"), F.max("push_id").alias("row_version")).withColumn("payload", F.when(F.col("op") != 3, F.col("payload")))
        pending = uploaded.filter("CAST(substr(key_text, 2) AS INT) % 2 = 0").withColumn("payload", F.lit("{}"))
        return follower.reconcile(uploaded, pending, B.live(log, bundles.row_state(log)))


@query(
    "joi_07_committed_proof",
    f"WITH {B.LOG}, a AS (SELECT table_id, op_code, key_text, payload, count(*) AS sent FROM log GROUP BY ALL), b AS (SELECT table_id, op_code, key_text, payload, count(*) AS kept FROM log WHERE bundle_seq <> 2 GROUP BY ALL) SELECT a.table_id, a.op_code, a.key_text, a.payload, sent, coalesce(kept, 0) AS kept FROM a LEFT JOIN b ON a.table_id = b.table_id AND a.op_code = b.op_code AND a.key_text = b.key_text AND a.payload IS NOT DISTINCT FROM b.payload WHERE sent <> coalesce(kept, 0)",
)
def committed_proof(spark, d):
    log = B.log(spark, d)
    return tables.compare_proof(log, log.filter("bundle_seq <> 2"), ["table_id", "op_code", "key_text", "payload"])


@query("srt_07_proof_order", f"WITH {B.LOG} SELECT user_pk, bundle_seq, row_ordinal, row_number() OVER (PARTITION BY user_pk, bundle_seq ORDER BY table_id, op_code, key_text, payload NULLS FIRST, row_ordinal) AS place FROM log")
def proof_order(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_pk", "bundle_seq").orderBy("table_id", "op_code", "key_text", F.asc_nulls_first("payload"), "row_ordinal")
    return B.log(spark, d).select("user_pk", "bundle_seq", "row_ordinal", F.row_number().over(w).cast("long").alias("place"))
