"""Folding, numbering, state, headers, capture and figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.operators import bundles, capture, status
from ledgerflow.queries import base as B, query


@query("flagship_bundles", f"WITH {B.HEADERS} SELECT * FROM headers")
def flagship(spark, d):
    return bundles.headers(B.log(spark, d), B.NAMES)


@query("agg_01_net_effect", f"WITH {B.NET} SELECT * FROM net")
def net_effect(spark, d):
    return bundles.net(bundles.fold(B.feed(spark, d)))


@query("op_03_finalize_bundles", f"WITH {B.LOG} SELECT * FROM log")
def finalize(spark, d):
    return B.log(spark, d)


@query("win_01_commit_numbers", f"WITH {B.NET} SELECT user_pk, txid, dense_rank() OVER (PARTITION BY user_pk ORDER BY txid) AS bundle_seq FROM (SELECT DISTINCT user_pk, txid FROM net)")
def commit_numbers(spark, d):
    return bundles.commit_order(bundles.net(bundles.fold(B.feed(spark, d))))


@query("win_02_effect_ordinals", f"WITH {B.LOG} SELECT user_pk, bundle_seq, table_id, key_text, row_ordinal, row_ordinal - 1 AS logical_ordinal FROM log")
def effect_ordinals(spark, d):
    return B.log(spark, d).select("user_pk", "bundle_seq", "table_id", "key_text", "row_ordinal", (F.col("row_ordinal") - 1).alias("logical_ordinal"))


@query("agg_02_row_state", f"WITH {B.STATE} SELECT * FROM state")
def row_state(spark, d):
    return bundles.row_state(B.log(spark, d))


@query("agg_02b_row_state_advanced", f"WITH {B.STATE} SELECT * FROM state")
def row_state_advanced(spark, d):
    log = B.log(spark, d)
    return bundles.advance(bundles.row_state(log.filter("bundle_seq <= 5")), log.filter("bundle_seq > 5"))


@query("agg_03_bundle_headers", f"WITH {B.HEADERS} SELECT user_pk, bundle_seq, row_count, byte_count FROM headers")
def headers(spark, d):
    return bundles.headers(B.log(spark, d), B.NAMES).drop("bundle_hash")


@query("prj_14_bundle_hash", f"WITH {B.HEADERS} SELECT user_pk, bundle_seq, bundle_hash FROM headers")
def bundle_hash(spark, d):
    return bundles.headers(B.log(spark, d), B.NAMES).select("user_pk", "bundle_seq", "bundle_hash")


@query("prj_03_op_names", f"WITH {B.FEED} SELECT ord, CASE op WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' WHEN 3 THEN 'DELETE' END AS op_name, op AS op_code FROM feed")
def op_names(spark, d):
    name = bundles.op_name(F.col("op"))
    return B.feed(spark, d).select("ord", name.alias("op_name"), bundles.op_code(F.concat(F.lit(" "), F.lower(name))).alias("op_code"))


@query("agg_06_counts_by_op", f"WITH {B.LOG} SELECT op_code, count(*) AS n FROM log GROUP BY op_code")
def counts_by_op(spark, d):
    return B.log(spark, d).groupBy("op_code").agg(F.count("*").alias("n"))


@query(
    "agg_07_counts_by_scope",
    f"WITH {B.STATE} SELECT user_pk, n_effects, n_live, n_at_floor FROM (SELECT user_pk, count(*) AS n_effects, count(*) FILTER (WHERE bundle_seq <= 3) AS n_at_floor FROM log GROUP BY user_pk) JOIN (SELECT user_pk, count(*) FILTER (WHERE NOT deleted) AS n_live FROM state GROUP BY user_pk) USING (user_pk)",
)
def counts_by_scope(spark, d):
    log = B.log(spark, d)
    effects = log.groupBy("user_pk").agg(F.count("*").alias("n_effects"), F.count_if(F.expr("bundle_seq <= 3")).alias("n_at_floor"))
    return effects.join(bundles.row_state(log).groupBy("user_pk").agg(F.count_if(F.expr("NOT deleted")).alias("n_live")), "user_pk")


@query("agg_08_latest_seq", f"WITH {B.LOG} SELECT user_pk, max(bundle_seq) AS latest, max(bundle_seq) + 1 AS next_bundle_seq FROM log GROUP BY user_pk")
def latest_seq(spark, d):
    return B.log(spark, d).groupBy("user_pk").agg(F.max("bundle_seq").alias("latest")).withColumn("next_bundle_seq", F.col("latest") + 1)


#: Numbers that come in time, late and again.
_COMMITS = "commits AS (SELECT user_id % 16 AS user_pk, 's' || CAST(user_id % 3 AS VARCHAR) AS source_id, 1 + (event_id // 40 + event_id % 3) % 9 AS source_bundle_id, event_id AS arrived FROM events)"


def commits(spark, d):
    return B.table(spark, d, "events").selectExpr("user_id % 16 AS user_pk", "concat('s', user_id % 3) AS source_id", "1 + (event_id DIV 40 + event_id % 3) % 9 AS source_bundle_id", "event_id AS arrived")


@query("agg_09_next_source_bundle_id", f"WITH {_COMMITS} SELECT user_pk, source_id, max(source_bundle_id) + 1 AS next_source_bundle_id FROM commits GROUP BY user_pk, source_id")
def next_source(spark, d):
    return status.source_counts(commits(spark, d))


@query(
    "win_07_source_sequence",
    # number n + 1 is accepted where it first arrives after number n was
    f"""WITH RECURSIVE {_COMMITS}, accepted(user_pk, source_id, number, taken) AS (SELECT user_pk, source_id, CAST(1 AS BIGINT), min(arrived) FROM commits WHERE source_bundle_id = 1 GROUP BY user_pk, source_id
      UNION ALL SELECT a.user_pk, a.source_id, a.number + 1, min(c.arrived) FROM accepted a JOIN commits c ON c.user_pk = a.user_pk AND c.source_id = a.source_id AND c.source_bundle_id = a.number + 1 AND c.arrived > a.taken GROUP BY a.user_pk, a.source_id, a.number),
    g AS (SELECT c.user_pk, c.source_id, c.source_bundle_id, c.arrived, 1 + count(a.number) AS expected FROM commits c LEFT JOIN accepted a ON a.user_pk = c.user_pk AND a.source_id = c.source_id AND a.taken < c.arrived GROUP BY ALL)
    SELECT user_pk, source_id, source_bundle_id, arrived, expected, CASE WHEN source_bundle_id > expected THEN 'out_of_order' WHEN source_bundle_id = expected THEN 'next' WHEN source_bundle_id <= 2 THEN 'history_pruned' ELSE 'already_committed' END AS status FROM g""",
)
def source_sequence(spark, d):
    return bundles.source_sequence(commits(spark, d), pruned=2)


@query("str_10_fresh_commits", f"WITH {_COMMITS} SELECT DISTINCT user_pk, source_id, source_bundle_id FROM commits")
def fresh_commits(spark, d):
    from ledgerflow.streaming.watch import fresh_commits as fresh

    return fresh(commits(spark, d)).select("user_pk", "source_id", "source_bundle_id")


_DIRTY = B.HALF + """, edits AS (SELECT user_id % 16 AS user_pk, CAST(1 + event_id % 3 AS INTEGER) AS table_id, 'k' || CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR) AS key_text, event_id AS ord,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 3 ELSE 2 END AS op, CASE WHEN event_type <> 'error' THEN replace(props, ' ', '') END AS payload
  FROM events WHERE event_id >= (SELECT (max(event_id) // 1000 + 1) * 500 FROM events)), e AS (
  SELECT user_pk, table_id, key_text, min(ord) AS first_ordinal, arg_max(op, ord) AS last_op, arg_max_null(payload, ord) AS payload FROM edits GROUP BY user_pk, table_id, key_text
), dirty AS (
  SELECT e.user_pk, e.table_id, e.key_text, CASE WHEN last_op = 3 THEN 3 WHEN s.bundle_seq IS NOT NULL AND NOT s.deleted THEN 2 ELSE 1 END AS op, coalesce(s.bundle_seq, 0) AS base_row_version,
    CASE WHEN last_op <> 3 THEN e.payload END AS payload, s.bundle_seq IS NOT NULL AS state_exists, coalesce(s.deleted, false) AS state_deleted,
    dense_rank() OVER (PARTITION BY e.user_pk ORDER BY first_ordinal) AS dirty_ordinal
  FROM e LEFT JOIN state s USING (user_pk, table_id, key_text))"""


def edits(spark, d):
    return B.requests(spark, d).withColumnRenamed("req_ordinal", "ord")


def dirty(spark, d):
    return capture.coalesce_dirty(edits(spark, d), bundles.row_state(bundles.bundle(B.first_half(spark, d))))


query("agg_11_dirty_coalescing", f"WITH {_DIRTY} SELECT * FROM dirty")(dirty)


@query("joi_02_dirty_with_state", f"WITH {_DIRTY} SELECT user_pk, table_id, key_text, base_row_version, state_exists, state_deleted FROM dirty")
def dirty_with_state(spark, d):
    """Each dirty row beside the state of the row that it is based on."""
    return capture.fold_edits(edits(spark, d), bundles.row_state(bundles.bundle(B.first_half(spark, d)))).select(*bundles.ROW, "base_row_version", "state_exists", "state_deleted")


_LATER = f"""{_DIRTY}, whole AS (WITH {B.STATE} SELECT * FROM state), middle AS (SELECT max(event_id) * 3 // 4 AS m FROM events),
 e1 AS (SELECT user_pk, table_id, key_text, min(ord) AS first_ordinal FROM edits, middle WHERE ord < m GROUP BY ALL),
 held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_pk ORDER BY first_ordinal) AS dirty_ordinal FROM e1) WHERE key_text <> 'k3'),
 e2 AS (SELECT user_pk, table_id, key_text, min(ord) AS first_ordinal FROM edits, middle WHERE ord >= m GROUP BY ALL),
 top AS (SELECT user_pk, max(dirty_ordinal) AS reached FROM held GROUP BY user_pk),
 added AS (SELECT e2.*, coalesce(reached, 0) + row_number() OVER (PARTITION BY e2.user_pk ORDER BY e2.first_ordinal) AS dirty_ordinal FROM e2 ANTI JOIN held USING (user_pk, table_id, key_text) LEFT JOIN top USING (user_pk))"""


@query(
    "win_09_dirty_ordinals",
    f"WITH {_LATER} SELECT user_pk, table_id, key_text, coalesce(s.bundle_seq, 0) AS base_row_version, dirty_ordinal FROM held LEFT JOIN state s USING (user_pk, table_id, key_text) UNION ALL SELECT user_pk, table_id, key_text, coalesce(w.bundle_seq, 0), dirty_ordinal FROM added LEFT JOIN whole w USING (user_pk, table_id, key_text)",
)
def dirty_ordinals(spark, d):
    """Edits go on after some rows were settled and the state moved on: rows still dirty keep base and ordinal, others follow the greatest."""
    made = edits(spark, d)
    middle = B.table(spark, d, "events").agg(F.expr("max(event_id) * 3 DIV 4")).first()[0]
    held = capture.coalesce_dirty(made.filter(F.col("ord") < middle), bundles.row_state(bundles.bundle(B.first_half(spark, d)))).filter("key_text <> 'k3'")
    return capture.accumulate_dirty(held, made.filter(F.col("ord") >= middle), bundles.row_state(B.log(spark, d))).select(*bundles.ROW, "base_row_version", "dirty_ordinal")


_WRITES = """writes AS (SELECT user_id % 16 AS user_pk, CAST(1 + event_id % 3 AS INTEGER) AS table_id, CASE WHEN event_type <> 'signup' THEN 'k' || CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR) END AS old_key,
 CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'm' ELSE 'k' END || CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR) END AS new_key, CASE WHEN event_type <> 'error' THEN replace(props, ' ', '') END AS payload,
 event_id AS ord, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS apply_mode, event_id % 11 = 0 AS pending FROM events WHERE event_id >= (SELECT (max(event_id) // 1000 + 1) * 500 FROM events))"""


def writes(spark, d):
    """Statements on local tables: inserts, updates (some of keys) and deletes, some by the engine, some during a transition."""
    found = B.table(spark, d, "events").filter(F.col("event_id") >= B._middle(spark, d))
    return found.selectExpr(
        "user_id % 16 AS user_pk", "CAST(1 + event_id % 3 AS INT) AS table_id", "CASE WHEN event_type <> 'signup' THEN concat('k', CAST(floor(value) AS BIGINT) % 10) END AS old_key",
        "CASE WHEN event_type <> 'error' THEN concat(CASE WHEN event_id % 5 = 0 THEN 'm' ELSE 'k' END, CAST(floor(value) AS BIGINT) % 10) END AS new_key", "CASE WHEN event_type <> 'error' THEN replace(props, ' ', '') END AS payload",
        "event_id AS ord", "CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS apply_mode", "event_id % 11 = 0 AS pending",
    )


@query(
    "op_21_client_capture",
    f"""WITH {B.HALF}, {_WRITES}, allowed AS (SELECT * FROM writes WHERE apply_mode = 0 AND NOT pending),
    edits AS (SELECT user_pk, table_id, old_key AS key_text, 2 * ord AS ord, 3 AS op, NULL AS payload FROM allowed WHERE old_key IS NOT NULL AND old_key IS DISTINCT FROM new_key
      UNION ALL SELECT user_pk, table_id, new_key, 2 * ord + 1, 2, payload FROM allowed WHERE new_key IS NOT NULL),
    e AS (SELECT user_pk, table_id, key_text, min(ord) AS first_ordinal, arg_max(op, ord) AS last_op, arg_max_null(payload, ord) AS payload FROM edits GROUP BY user_pk, table_id, key_text)
    SELECT user_pk, table_id, key_text, CASE WHEN last_op = 3 THEN 3 WHEN NOT coalesce(s.deleted, true) THEN 2 ELSE 1 END AS op, coalesce(s.bundle_seq, 0) AS base_row_version, CASE WHEN last_op <> 3 THEN e.payload END AS payload,
      row_number() OVER (PARTITION BY user_pk ORDER BY first_ordinal) AS dirty_ordinal FROM e LEFT JOIN state s USING (user_pk, table_id, key_text)""",
)
def client_capture(spark, d):
    allowed = capture.write_guard(writes(spark, d)).filter("reason IS NULL")
    found = capture.coalesce_dirty(capture.captured(allowed), bundles.row_state(bundles.bundle(B.first_half(spark, d))))
    return found.select(*bundles.ROW, "op", "base_row_version", "payload", "dirty_ordinal")


@query("op_21b_write_guard", f"WITH {_WRITES} SELECT ord, CASE WHEN pending AND apply_mode <> 1 THEN 'transition_pending' END AS reason FROM writes")
def write_guard(spark, d):
    return capture.write_guard(writes(spark, d)).select("ord", "reason")


_RANKS = "(VALUES (1, 3), (2, 1), (3, 2)) AS t(table_id, table_rank)"


@query("flt_07_without_noops", f"WITH {_DIRTY} SELECT user_pk, table_id, key_text, op FROM dirty WHERE NOT (payload IS NULL AND (NOT state_exists OR state_deleted))")
def without_noops(spark, d):
    return capture.without_noops(dirty(spark, d)).select("user_pk", "table_id", "key_text", "op")


_SENT = f"SELECT user_pk, table_id, key_text, op, row_number() OVER (PARTITION BY user_pk ORDER BY CAST(op = 3 AS INTEGER), CASE WHEN op = 3 THEN -table_rank ELSE table_rank END, dirty_ordinal) AS place FROM dirty JOIN {_RANKS} USING (table_id)"


@query("srt_02_send_order", f"WITH {_DIRTY} {_SENT}")
def send_order(spark, d):
    return capture.send_order(dirty(spark, d), spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "table_id int, table_rank int")).select("user_pk", "table_id", "key_text", "op", "place")


@query("srt_03_server_order", f"WITH {_DIRTY} {_SENT}")
def server_order(spark, d):
    return send_order(spark, d)


@query("op_16_dirty_collection", f"WITH {_DIRTY}, kept AS (SELECT * FROM dirty WHERE NOT (payload IS NULL AND (NOT state_exists OR state_deleted))) " + _SENT.replace("FROM dirty", "FROM kept"))
def dirty_collection(spark, d):
    ranks = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "table_id int, table_rank int")
    return capture.send_order(capture.without_noops(dirty(spark, d)), ranks).select("user_pk", "table_id", "key_text", "op", "place")


@query(
    "agg_10_pending_counts",
    f"WITH {_DIRTY} SELECT user_pk, count(*) AS pending, CASE WHEN count(*) > 60 THEN 'blocked_unsynced_data' ELSE 'detached' END AS outcome FROM dirty GROUP BY user_pk",
)
def pending(spark, d):
    found = dirty(spark, d).groupBy("user_pk").agg(F.count("*").alias("pending"))
    return found.withColumn("outcome", status.detach_blocked(F.greatest(F.col("pending") - 60, F.lit(0)), F.lit(0)))


_VERSIONS = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders),
 n AS (SELECT CASE WHEN o_orderkey % 23 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 17 <> 0)"""


def versions(spark, d):
    old = B.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    new = old.filter("o_orderkey % 17 <> 0").selectExpr("CASE WHEN o_orderkey % 23 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey", "o_custkey", "CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus", "o_orderpriority")
    return old, new


@query(
    "op_01_table_diff",
    f"""WITH {_VERSIONS} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 1 WHEN n.o_orderkey IS NULL THEN 3 ELSE 2 END AS op_code,
    CASE WHEN n.o_orderkey IS NOT NULL THEN CAST(json_object('o_orderkey', n.o_orderkey, 'o_custkey', n.o_custkey, 'o_orderstatus', n.o_orderstatus, 'o_orderpriority', n.o_orderpriority) AS VARCHAR) END AS payload
    FROM o FULL OUTER JOIN n USING (o_orderkey) WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_custkey <> n.o_custkey OR o.o_orderstatus <> n.o_orderstatus OR o.o_orderpriority <> n.o_orderpriority""",
)
def table_diff(spark, d):
    return capture.diff(*versions(spark, d), key="o_orderkey")


@query(
    "op_01b_scope_guard",
    """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderkey % 3 AS VARCHAR) AS scope, o_orderstatus AS v FROM orders),
    n AS (SELECT id, CASE WHEN id % 19 = 0 THEN '2' ELSE scope END AS scope, CASE WHEN id % 5 = 0 THEN 'X' ELSE v END AS v FROM o WHERE id % 17 <> 0
      UNION ALL SELECT id + 100000000, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '1' ELSE '2' END, v FROM o WHERE id % 23 = 0),
    x AS (SELECT coalesce(o.id, n.id) AS id, o.id IS NULL AS born, n.id IS NULL AS gone, o.scope AS a, n.scope AS b, o.v AS va, n.v AS vb FROM o FULL OUTER JOIN n ON o.id = n.id)
    SELECT id, CAST(1 AS INTEGER) AS op_code, CASE WHEN coalesce(b, '') = '' THEN '1' ELSE b END AS scope, CASE WHEN coalesce(b, '') NOT IN ('', '1') THEN 'scope_mismatch' END AS reason FROM x WHERE born
    UNION ALL SELECT id, 3, a, CASE WHEN a <> '1' THEN 'scope_mismatch' END FROM x WHERE gone
    UNION ALL SELECT id, 2, b, CASE WHEN a <> '1' THEN 'scope_mismatch' WHEN a <> b THEN 'scope_mutation' END FROM x WHERE NOT born AND NOT gone AND (a <> b OR va <> vb)""",
)
def scope_guard(spark, d):
    """Writes of an actor for scope 1 to a table with rows of three scopes."""
    old = B.table(spark, d, "orders").selectExpr("o_orderkey AS id", "CAST(o_orderkey % 3 AS STRING) AS scope", "o_orderstatus AS v")
    kept = old.filter("id % 17 <> 0").selectExpr("id", "CASE WHEN id % 19 = 0 THEN '2' ELSE scope END AS scope", "CASE WHEN id % 5 = 0 THEN 'X' ELSE v END AS v")
    born = old.filter("id % 23 = 0").selectExpr("id + 100000000 AS id", "CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '1' ELSE '2' END AS scope", "v")
    return capture.scope_guard(old, kept.unionByName(born), "id", "scope", "1").select("id", "op_code", "scope", "reason")


@query("src_10_existing_rows", "SELECT CAST(n_nationkey AS VARCHAR) AS key_text, 1 AS op, CAST(0 AS BIGINT) AS base_row_version, CAST(json_object('n_nationkey', n_nationkey, 'n_name', n_name, 'n_regionkey', n_regionkey) AS VARCHAR) AS payload FROM nation")
def existing_rows(spark, d):
    return capture.existing_as_inserts(B.table(spark, d, "nation"), "n_nationkey")


for _name in ("src_03_live_rows_json", "src_09_serialize_rows"):

    @query(_name, "SELECT c_custkey % 16 AS scope_id, c_custkey, CAST(json_object('c_custkey', c_custkey, 'c_name', c_name, 'c_mktsegment', c_mktsegment) AS VARCHAR) AS row_json FROM customer")
    def live_rows_json(spark, d):
        rows = B.table(spark, d, "customer").selectExpr("c_custkey % 16 AS scope_id", "c_custkey", "c_name", "c_mktsegment")
        return rows.select("scope_id", "c_custkey", capture.row_json(["c_custkey", "c_name", "c_mktsegment"], rows).alias("row_json"))


@query(
    "agg_04_status",
    f"""WITH {B.HEADERS}, state AS (SELECT user_pk, table_id, key_text, arg_max(op_code, bundle_seq) = 3 AS deleted FROM log GROUP BY ALL),
    scopes AS (SELECT user_pk, max(bundle_seq) AS latest, CASE WHEN user_pk % 2 = 0 THEN 2 ELSE 0 END AS floor FROM log GROUP BY user_pk) """
    + """SELECT (SELECT count(*) FROM scopes) AS scopes, (SELECT CAST(max(floor) AS BIGINT) FROM scopes) AS max_floor, (SELECT CAST(max(latest - floor) AS BIGINT) FROM scopes) AS max_retained, (SELECT count(*) FROM scopes WHERE floor > 0) AS pruned_scopes,
    (SELECT count(*) FROM headers) AS bundles, (SELECT CAST(sum(row_count) AS BIGINT) FROM headers) AS effects, (SELECT CAST(sum(byte_count) AS BIGINT) FROM headers) AS bytes, (SELECT min(bundle_seq) FROM headers) AS oldest, (SELECT max(bundle_seq) FROM headers) AS newest,
    (SELECT count(*) FROM state WHERE NOT deleted) AS live_rows, (SELECT count(*) FROM state WHERE deleted) AS tombstones, (SELECT count(*) FROM orders) AS sessions, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS expired_sessions""",
)
def status_row(spark, d):
    log = B.log(spark, d)
    scopes = log.groupBy("user_pk").agg(F.max("bundle_seq").alias("latest")).withColumn("floor", F.when(F.col("user_pk") % 2 == 0, F.lit(2)).otherwise(F.lit(0)).cast("long"))
    sessions = B.table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("is_expired"))
    return status.status(scopes, bundles.headers(log, B.NAMES), bundles.row_state(log), sessions)


@query("agg_05_health", "SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'shutting_down' WHEN user_id % 7 = 0 THEN 'stopped' WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM events GROUP BY user_id")
def health(spark, d):
    found = B.table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.expr("event_type = 'error'")).alias("errors"))
    return found.select("user_id", status.health(F.col("user_id") % 7 != 0, F.col("user_id") % 5 == 0, F.col("errors")).alias("health"))


@query("agg_15_stage_timings", "SELECT stage, samples, total, most, items, errors, total / samples AS average FROM (SELECT event_type AS stage, count(*) AS samples, CAST(sum(event_id % 100) AS BIGINT) AS total, max(event_id % 100) AS most, CAST(sum(user_id % 5) AS BIGINT) AS items, count(*) FILTER (WHERE event_id % 9 = 0) AS errors FROM events GROUP BY event_type) ORDER BY total DESC, stage LIMIT 12")
def stage_timings(spark, d):
    samples = B.table(spark, d, "events").selectExpr("event_type AS stage", "event_id % 100 AS ms", "event_id % 9 = 0 AS failed", "user_id % 5 AS items")
    return status.stage_timings(samples)


@query(
    "agg_16_user_report",
    """WITH r AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') = 0 AS ok, CAST(count(*) AS DOUBLE) AS seconds, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'e' || CAST(user_id % 3 AS VARCHAR) END AS error FROM events GROUP BY user_id)
    SELECT count(*) AS users, count(*) FILTER (WHERE ok) AS succeeded, avg(seconds) AS average_seconds, max(seconds) AS most_seconds, (SELECT error FROM r WHERE error IS NOT NULL GROUP BY error ORDER BY count(*) DESC, error DESC LIMIT 1) AS common_error, (SELECT count(*) FROM r WHERE error IS NOT NULL) AS errors FROM r""",
)
def user_report(spark, d):
    results = B.table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.expr("event_type = 'error'")).alias("bad"), F.count("*").cast("double").alias("seconds"))
    return status.user_report(results.select("user_id", (F.col("bad") == 0).alias("ok"), "seconds", F.when(F.col("bad") > 0, F.concat(F.lit("e"), (F.col("user_id") % 3).cast("string"))).alias("error")))


@query(
    "agg_18_authority",
    f"WITH {_DIRTY}, p AS (SELECT user_pk, count(*) AS pending FROM dirty GROUP BY user_pk), l AS (SELECT user_pk, count(*) FILTER (WHERE NOT deleted) AS live FROM state GROUP BY user_pk) SELECT user_pk, CASE WHEN user_pk % 3 = 0 AND coalesce(pending, 0) > 0 THEN 'pending_local_seed' WHEN user_pk % 3 = 0 OR live = 0 THEN 'authoritative_empty' ELSE 'authoritative_materialized' END AS authority FROM l LEFT JOIN p USING (user_pk)",
)
def authority(spark, d):
    live = bundles.row_state(bundles.bundle(B.first_half(spark, d))).groupBy("user_pk").agg(F.count_if(F.expr("NOT deleted")).alias("live"))
    found = live.join(dirty(spark, d).groupBy("user_pk").agg(F.count("*").alias("pending")), "user_pk", "left")
    return found.select("user_pk", status.authority(F.col("user_pk") % 3 != 0, F.coalesce("pending", F.lit(0)), F.col("live")).alias("authority"))
