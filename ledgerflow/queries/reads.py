"""Scans, snapshots, joins, set operations and DML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.operators import bundles, conflicts, follower, paging, snapshots, tables
from ledgerflow.queries import base as B, query
from ledgerflow.runtime import cut


@query("src_01_staged_events", f"WITH {B.FEED} SELECT ord, table_id, key_text, op, payload FROM feed WHERE user_pk = 3 AND txid = 1 ORDER BY ord")
def staged_events(spark, d):
    return B.feed(spark, d).filter("user_pk = 3 AND txid = 1").select("ord", "table_id", "key_text", "op", "payload").orderBy("ord")


@query("src_02_point_lookup", f"WITH {B.STATE} SELECT * FROM state WHERE user_pk = 3 AND table_id = 2 AND key_text = 'k4'")
def point_lookup(spark, d):
    return bundles.row_state(B.log(spark, d).filter("user_pk = 3 AND table_id = 2 AND key_text = 'k4'"))


@query("src_04_live_state", f"WITH {B.STATE} SELECT user_pk, table_id, key_text, bundle_seq FROM state WHERE NOT deleted")
def live_state(spark, d):
    return snapshots.live_state(bundles.row_state(B.log(spark, d)))


@query(
    "src_05_committed_bundle",
    f"WITH {B.LOG} SELECT user_pk, bundle_seq, count(*) AS n, string_agg(CAST(row_ordinal AS VARCHAR) || ':' || key_text || ':' || CASE op_code WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' ELSE 'DELETE' END, ',' ORDER BY row_ordinal) AS effects FROM log GROUP BY user_pk, bundle_seq",
)
def committed_bundle(spark, d):
    found = bundles.committed(B.log(spark, d))
    spelled = F.transform("rows", lambda r: F.concat_ws(":", r["row_ordinal"].cast("string"), r["key_text"], r["op"]))
    return found.select("user_pk", "bundle_seq", F.size("rows").cast("long").alias("n"), F.array_join(spelled, ",").alias("effects"))


@query("src_08_table_scan_count", "SELECT count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM customer")
def scan_count(spark, d):
    return B.table(spark, d, "customer").agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("nations"))


def stored(df, by, name):
    """Written in folders of `by` and read back. Rows are not dealt by it first, so a large folder is many files of many tasks."""
    import uuid

    from ledgerflow.runtime import shared_folder

    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("snk_01_partitioned_log", f"WITH {B.LOG} SELECT * FROM log")
def partitioned_log(spark, d):
    return stored(B.log(spark, d), "user_pk", "log")


@query("snk_02_staged_chunks", f"WITH {B.REQUESTS}, n AS (SELECT *, row_number() OVER (PARTITION BY push_id, user_pk ORDER BY req_ordinal) AS row_ordinal FROM requests) SELECT push_id, user_pk, (row_ordinal - 1) // 7 AS chunk, row_ordinal - 1 AS push_ordinal, table_id, key_text, op, base_row_version, payload FROM n")
def staged_chunks(spark, d):
    """The rows of every push, numbered and staged chunk by chunk."""
    from pyspark.sql import Window as W

    # a push is bounded by the protocol
    numbered = B.requests(spark, d).withColumn("row_ordinal", F.row_number().over(W.partitionBy("push_id", "user_pk").orderBy("req_ordinal")).cast("long"))
    staged = paging.chunked(numbered, "row_ordinal", 7).select("push_id", "user_pk", "chunk", (F.col("row_ordinal") - 1).alias("push_ordinal"), "table_id", "key_text", "op", "base_row_version", "payload")
    return stored(staged, "chunk", "staged")


_LIVE_PARTS = B.LIVE + ", rows AS (SELECT * FROM live WHERE NOT (user_pk = 2 AND key_text = 'k3') UNION ALL SELECT user_pk, table_id, 'extra', payload FROM live WHERE key_text = 'k5')"


def damaged(spark, d):
    """Live rows of which some lack and some are too many."""
    log = B.log(spark, d)
    state = cut(bundles.row_state(log))
    live = cut(B.live(log, state))
    rows = live.filter("NOT (user_pk = 2 AND key_text = 'k3')").union(live.filter("key_text = 'k5'").withColumn("key_text", F.lit("extra")))
    return rows, state


for _name in ("joi_05_integrity_errors", "set_04_missing_unexpected"):

    @query(
        _name,
        f"WITH {_LIVE_PARTS}, l AS (SELECT * FROM state WHERE NOT deleted), r AS (SELECT user_pk, table_id, key_text, count(*) AS n FROM rows GROUP BY ALL) SELECT user_pk, table_id, key_text, CASE WHEN l.bundle_seq IS NULL THEN 'row_without_state' WHEN r.n IS NULL THEN 'state_without_row' ELSE 'duplicate' END AS error FROM r FULL OUTER JOIN l USING (user_pk, table_id, key_text) WHERE l.bundle_seq IS NULL OR r.n IS NULL OR r.n > 1",
    )
    def integrity(spark, d):
        return snapshots.integrity_errors(*damaged(spark, d))


@query("set_03_key_difference", f"WITH {_LIVE_PARTS}, l AS (SELECT user_pk, table_id, key_text FROM state WHERE NOT deleted), r AS (SELECT user_pk, table_id, key_text FROM rows) (SELECT *, 'missing' AS kind FROM (SELECT * FROM l EXCEPT SELECT * FROM r)) UNION ALL (SELECT *, 'unexpected' AS kind FROM (SELECT * FROM r EXCEPT SELECT * FROM l))")
def key_difference(spark, d):
    rows, state = damaged(spark, d)
    return snapshots.set_difference(state, rows)


_SNAPSHOT = B.LIVE + ", snap AS (SELECT user_pk, table_id, key_text, s.bundle_seq AS row_version, payload, row_number() OVER (PARTITION BY user_pk ORDER BY table_id, encode(key_text)) AS snapshot_ordinal FROM live JOIN state s USING (user_pk, table_id, key_text))"


def snapshot(spark, d):
    log = B.log(spark, d)
    state = bundles.row_state(log)
    return snapshots.materialize(B.live(log, state), state)


for _name in ("op_10_snapshot", "win_03_snapshot_ordinals"):
    query(_name, f"WITH {_SNAPSHOT} SELECT * FROM snap")(snapshot)


@query("snk_05_snapshot_rows", f"WITH {_SNAPSHOT} SELECT * FROM snap")
def snapshot_rows(spark, d):
    """A snapshot stored row by row, as a session keeps it for its chunks."""
    return stored(snapshot(spark, d), "user_pk", "snapshot")


@query("srt_05_snapshot_chunk", f"WITH {_SNAPSHOT} SELECT * FROM snap WHERE user_pk = 4 AND snapshot_ordinal > 5 ORDER BY snapshot_ordinal LIMIT 11")
def snapshot_chunk(spark, d):
    return paging.keyset_page(snapshot(spark, d).filter("user_pk = 4"), "snapshot_ordinal", 5, 10)


@query("op_10b_snapshot_sizes", f"WITH {_SNAPSHOT} SELECT user_pk, count(*) AS row_count, CAST(sum(octet_length(encode(payload))) AS BIGINT) AS byte_count FROM snap GROUP BY user_pk")
def snapshot_sizes(spark, d):
    return snapshots.within_limits(snapshot(spark, d), max_rows=10_000_000)


@query(
    "op_19_rebuild_with_outbox",
    f"WITH {_SNAPSHOT}, o AS (SELECT user_pk, table_id, key_text || CASE WHEN key_text = 'k1' THEN 'n' ELSE '' END AS key_text, CASE WHEN key_text = 'k2' THEN 3 ELSE 2 END AS op, '{{\"k\":0}}' AS own FROM snap WHERE key_text IN ('k1', 'k2', 'k3')) SELECT user_pk, table_id, key_text, coalesce(row_version, 0) AS bundle_seq, coalesce(op = 3, false) AS deleted, CASE WHEN op IS NULL THEN payload WHEN op <> 3 THEN own END AS payload FROM snap FULL OUTER JOIN o USING (user_pk, table_id, key_text)",
)
def rebuild_with_outbox(spark, d):
    snap = cut(snapshot(spark, d))
    outbox = snap.filter("key_text IN ('k1', 'k2', 'k3')").selectExpr("user_pk", "table_id", "concat(key_text, CASE WHEN key_text = 'k1' THEN 'n' ELSE '' END) AS key_text", "CASE WHEN key_text = 'k2' THEN 3 ELSE 2 END AS op", "'{\"k\":0}' AS payload")
    return follower.rebuild(snap, outbox)


@query("dml_05_replace_all", f"WITH {_SNAPSHOT} SELECT user_pk, table_id, key_text, payload FROM snap")
def replace_all(spark, d):
    snap = cut(snapshot(spark, d))
    managed = snap.select("user_pk", "table_id", "key_text", "payload")
    return tables.replace_all(managed, snap, snap.count())


@query("joi_04_session_owner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def session_owner(spark, d):
    sessions, users = B.table(spark, d, "orders").filter("o_orderstatus = 'P'"), B.table(spark, d, "customer")
    return sessions.join(users, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


_CHANGES = "chg AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey + 500000000 ELSE o_orderkey END AS o_orderkey, o_custkey, 'U' AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN 3 ELSE 2 END AS op_code FROM orders WHERE o_orderkey % 3 = 0)"


def changes(spark, d):
    base = B.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    found = base.filter("o_orderkey % 3 = 0").selectExpr("CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey + 500000000 ELSE o_orderkey END AS o_orderkey", "o_custkey", "'U' AS o_orderstatus", "CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN 3 ELSE 2 END AS op_code")
    return base, found


for _name in ("dml_01_apply_changes", "dml_03_full_row_upsert"):

    @query(_name, f"WITH {_CHANGES} SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM chg) UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM chg WHERE op_code <> 3")
    def apply_changes(spark, d):
        return tables.upsert(*changes(spark, d), ["o_orderkey"])


for _name in ("dml_02_partial_update", "joi_06_update_from"):

    @query(_name, "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders")
    def partial_update(spark, d):
        base = B.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        named = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("o_custkey"), F.lit("o_orderstatus"))).otherwise(F.array(F.lit("o_orderstatus")))
        change = base.filter("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.lit("Z").alias("o_orderstatus"), named.alias("columns_set"))
        return tables.update_columns(base, change, ["o_orderkey"], ["o_custkey", "o_orderstatus"])


@query("joi_08_orphans", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 17 <> 0) GROUP BY l_orderkey")
def orphans(spark, d):
    parents = B.table(spark, d, "orders").filter("o_orderkey % 17 <> 0")
    return tables.orphans(B.table(spark, d, "lineitem").select("l_orderkey"), parents, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("joi_09_live_counts", f"WITH {B.STATE}, cat AS (SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) AS t(table_id, table_name)) SELECT user_pk, table_name, count(*) AS n FROM state JOIN cat USING (table_id) WHERE NOT deleted GROUP BY user_pk, table_name")
def live_counts(spark, d):
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "table_id int, table_name string")
    return snapshots.live_state(bundles.row_state(B.log(spark, d))).join(F.broadcast(names), "table_id").groupBy("user_pk", "table_name").agg(F.count("*").alias("n"))


@query("joi_10_existing_keys", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def existing_keys(spark, d):
    keys = B.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return tables.existing(B.table(spark, d, "customer").select("c_custkey"), keys, ["c_custkey"])


@query("set_01_schema_names", "SELECT DISTINCT name FROM (SELECT event_type AS name FROM events UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT lang FROM documents) WHERE name IS NOT NULL")
def schema_names(spark, d):
    columns = [("events", "event_type"), ("region", "r_name"), ("nation", "n_name"), ("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("documents", "lang")]
    # each table gives its few names before they meet
    parts = [B.table(spark, d, t).select(F.col(c).alias("name")).distinct() for t, c in columns]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.filter("name IS NOT NULL").distinct()


query("agg_12_distinct_names", "SELECT DISTINCT name FROM (SELECT event_type AS name FROM events UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT lang FROM documents) WHERE name IS NOT NULL")(schema_names)


@query("set_02_existence_probe", "SELECT count(*) > 0 AS present FROM (SELECT 1 FROM region UNION ALL SELECT 1 FROM nation)")
def existence_probe(spark, d):
    found = B.table(spark, d, "region").select(F.lit(1)).union(B.table(spark, d, "nation").select(F.lit(1))).limit(1)
    return found.agg((F.count("*") > 0).alias("present"))


@query(
    "dml_07_cascade",
    """WITH r AS (SELECT 2 AS r_regionkey), n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM n)), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT * FROM n))
    SELECT 'region' AS table_name, '2' AS key_text, 'DELETE' AS effect, 0 AS depth UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'DELETE', 1 FROM n UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'DELETE', 2 FROM c UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'SET NULL', 2 FROM s
    UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'DELETE', 3 FROM orders WHERE o_custkey IN (SELECT * FROM c)""",
)
def cascade(spark, d):
    names = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey"}
    edges = [("nation", "n_regionkey", "region", "CASCADE"), ("customer", "c_nationkey", "nation", "CASCADE"), ("supplier", "s_nationkey", "nation", "SET NULL"), ("orders", "o_custkey", "customer", "CASCADE")]
    gone = spark.createDataFrame([("region", "2")], "table_name string, key_text string")
    return tables.cascade(gone, edges, {t: B.table(spark, d, t) for t in names}, names)


@query(
    "dml_07b_update_cascade",
    """WITH c AS (SELECT c_custkey AS k, c_custkey + 1000000000 AS n FROM customer WHERE c_custkey % 10 = 0), s AS (SELECT s_suppkey AS k, n FROM supplier JOIN c ON s_suppkey = c.k)
    SELECT 'orders' AS table_name, CAST(o_orderkey AS VARCHAR) AS key_text, 'o_custkey' AS "column", CAST(n AS VARCHAR) AS new_value, 1 AS depth FROM orders JOIN c ON o_custkey = k
    UNION ALL SELECT 'supplier', CAST(k AS VARCHAR), 's_suppkey', CAST(n AS VARCHAR), 1 FROM s
    UNION ALL SELECT 'lineitem', l_orderkey || '-' || l_linenumber, 'l_suppkey', NULL, 2 FROM lineitem JOIN s ON l_suppkey = k""",
)
def update_cascade(spark, d):
    """Customers get other keys; suppliers are customers by key, and line items lose their supplier."""
    names = {"customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "lineitem": "line"}
    edges = [("orders", "o_custkey", "customer", "CASCADE"), ("supplier", "s_suppkey", "customer", "CASCADE"), ("lineitem", "l_suppkey", "supplier", "SET NULL"), ("orders", "o_orderkey", "customer", "NO ACTION")]
    found = {t: B.table(spark, d, t) for t in ("customer", "supplier", "orders")}
    found["lineitem"] = B.table(spark, d, "lineitem").selectExpr("concat(l_orderkey, '-', l_linenumber) AS line", "l_suppkey")
    changed = found["customer"].filter("c_custkey % 10 = 0").selectExpr("'customer' AS table_name", "c_custkey AS old_key", "c_custkey + 1000000000 AS new_key")
    return tables.cascade_updates(changed, edges, found, names)


@query("flt_08_response_checks", f"WITH {B.LOG}, x AS (SELECT user_pk, bundle_seq, row_ordinal, op_code, payload, count(*) OVER (PARTITION BY user_pk, bundle_seq) AS n, max(row_ordinal) OVER (PARTITION BY user_pk, bundle_seq) AS top, dense_rank() OVER (PARTITION BY user_pk ORDER BY bundle_seq) AS place FROM log) SELECT user_pk, bool_and(n = top) AND bool_and(place = bundle_seq) AS ordered, bool_and(bundle_seq <= 1000) AS below_ceiling, bool_and((op_code = 3) = (payload IS NULL)) AS payloads_fit FROM x GROUP BY user_pk")
def response_checks(spark, d):
    """Bundles and their rows are numbered without gaps or repeats, below the ceiling, and deletes alone have no payload."""
    fits = (F.col("op_code") == 3) == F.col("payload").isNull()
    bundle = B.log(spark, d).groupBy("user_pk", "bundle_seq").agg(F.count("*").alias("n"), F.countDistinct("row_ordinal").alias("u"), F.min("row_ordinal").alias("low"), F.max("row_ordinal").alias("high"), F.bool_and(fits).alias("fits"))
    whole = (F.col("n") == F.col("u")) & (F.col("low") == 1) & (F.col("high") == F.col("n"))
    found = bundle.groupBy("user_pk").agg(F.bool_and(whole).alias("whole"), F.count("*").alias("n"), F.min("bundle_seq").alias("low"), F.max("bundle_seq").alias("high"), F.bool_and("fits").alias("payloads_fit"))
    return found.select("user_pk", (F.col("whole") & (F.col("low") == 1) & (F.col("high") == F.col("n"))).alias("ordered"), (F.col("high") <= 1000).alias("below_ceiling"), "payloads_fit")


@query("op_15_push_round_trip", f"WITH {B.HEADERS} SELECT user_pk, bundle_seq, row_count, bundle_hash AS announced, CASE WHEN bundle_seq % 5 = 0 AND row_count > 1 THEN 'hash_mismatch' WHEN bundle_seq % 7 = 0 THEN 'row_count_mismatch' ELSE 'replayed' END AS outcome FROM headers")
def push_round_trip(spark, d):
    """Committed bundles are written, fetched, and checked against what the commit announced.

    On the way, the first two rows of some bundles change places, and others lose their last row.
    """
    fetched = stored(B.log(spark, d), "user_pk", "round-trip")
    announced = bundles.headers(B.log(spark, d), B.NAMES).select("user_pk", "bundle_seq", "row_count", F.col("bundle_hash").alias("announced"))
    swapped = F.when((F.col("bundle_seq") % 5 == 0) & (F.col("row_count") > 1) & (F.col("row_ordinal") <= 2), 3 - F.col("row_ordinal")).otherwise(F.col("row_ordinal"))
    received = fetched.join(announced.select("user_pk", "bundle_seq", "row_count"), ["user_pk", "bundle_seq"]).withColumn("row_ordinal", swapped)
    received = received.filter((F.col("bundle_seq") % 7 != 0) | ((F.col("bundle_seq") % 5 == 0) & (F.col("row_count") > 1)) | (F.col("row_ordinal") < F.col("row_count"))).drop("row_count")
    return follower.verified(received, announced, B.NAMES).select("user_pk", "bundle_seq", "row_count", "announced", "outcome")


_PUSHES = f"""WITH {B.HALF}, {B.REQUESTS}, firsts AS (SELECT user_pk, min(push_id) AS push_id FROM requests GROUP BY user_pk),
 rows_ AS (SELECT user_pk, push_id, table_id, key_text, arg_max(op, req_ordinal) AS wanted, arg_max_null(payload, req_ordinal) AS payload, min(req_ordinal) AS first FROM requests JOIN firsts USING (user_pk, push_id) GROUP BY ALL),
 staged AS (SELECT r.user_pk, push_id, table_id, key_text, r.payload, CASE WHEN s.bundle_seq IS NULL OR s.deleted THEN 1 WHEN wanted = 1 THEN 2 ELSE wanted END AS op, coalesce(s.bundle_seq, 0) - CASE WHEN r.user_pk % 4 = 3 AND s.bundle_seq IS NOT NULL THEN 1 ELSE 0 END AS base_row_version,
   row_number() OVER (PARTITION BY r.user_pk ORDER BY first) - 1 AS req_ordinal, s.bundle_seq AS version, coalesce(s.deleted, false) AS deleted FROM rows_ r LEFT JOIN state s USING (user_pk, table_id, key_text)),
 told AS (SELECT user_pk, push_id, count(*) AS n_rows, count(*) FILTER (WHERE base_row_version <> coalesce(version, 0)) AS n_conflicts, user_pk % 4 = 2 AS short FROM staged GROUP BY ALL),
 latest AS (SELECT user_pk, max(bundle_seq) AS latest FROM log GROUP BY user_pk),
 ended AS (SELECT *, CASE WHEN short THEN 'incomplete' WHEN n_conflicts > 0 THEN 'conflict' ELSE 'committed' END AS outcome FROM told)"""


def staged(spark, d):
    """The first push of each scope: one row for each key, with stale bases in some scopes and a row too few in others."""
    log = bundles.bundle(B.first_half(spark, d))
    state = bundles.row_state(log)
    found = B.requests(spark, d)
    found = found.join(found.groupBy("user_pk").agg(F.min("push_id").alias("push_id")), ["user_pk", "push_id"])
    one = found.groupBy("user_pk", "push_id", "table_id", "key_text").agg(F.max_by("op", "req_ordinal").alias("wanted"), F.max_by("payload", "req_ordinal").alias("payload"), F.min("req_ordinal").alias("first"))
    known = one.join(state, bundles.ROW, "left")
    op = F.expr("CASE WHEN bundle_seq IS NULL OR deleted THEN 1 WHEN wanted = 1 THEN 2 ELSE wanted END")
    base = F.expr("coalesce(bundle_seq, 0) - CASE WHEN user_pk % 4 = 3 AND bundle_seq IS NOT NULL THEN 1 ELSE 0 END")
    rows = paging.ordinals(known.withColumns({"op": op, "base_row_version": base}), "user_pk", ["first"], "place")
    rows = rows.select("user_pk", "push_id", (F.col("place") - 1).alias("req_ordinal"), "table_id", "key_text", "op", "base_row_version", "payload")
    planned = rows.groupBy("user_pk", "push_id").agg((F.count("*") + F.expr("max(CASE WHEN user_pk % 4 = 2 THEN 1 ELSE 0 END)")).alias("planned"))
    return rows, state, log.groupBy("user_pk").agg(F.max("bundle_seq").alias("latest")), planned


@query("op_06_push_commit", f"{_PUSHES} SELECT user_pk, push_id, n_rows, n_conflicts, outcome, CASE WHEN outcome = 'committed' THEN latest + 1 END AS bundle_seq FROM ended JOIN latest USING (user_pk)")
def push_commit(spark, d):
    """A push is committed only if it is whole and none of its rows conflicts."""
    return conflicts.commit(*staged(spark, d))[0]


@query(
    "op_06b_state_after_push",
    f"{_PUSHES}, done AS (SELECT user_pk, table_id, key_text, latest + 1 AS bundle_seq, op = 3 AS deleted FROM staged JOIN ended USING (user_pk, push_id) JOIN latest USING (user_pk) WHERE outcome = 'committed') SELECT * FROM done UNION ALL SELECT user_pk, table_id, key_text, bundle_seq, deleted FROM state ANTI JOIN done USING (user_pk, table_id, key_text)",
)
def state_after_push(spark, d):
    """Committed pushes move the state on; the others leave it alone."""
    rows, state, latest, planned = staged(spark, d)
    return bundles.advance(state, conflicts.commit(rows, state, latest, planned)[1])


@query("op_02_server_bundle", f"WITH {_CHANGES} SELECT op_code, count(*) AS n FROM chg GROUP BY op_code")
def server_bundle(spark, d):
    """Effects of a server-side write, given as a function over a table, by comparing before and after."""
    from ledgerflow.operators import capture

    base, change = changes(spark, d)
    return capture.diff(base, tables.upsert(base, change, ["o_orderkey"]).withColumn("o_orderstatus", F.col("o_orderstatus")), "o_orderkey").groupBy("op_code").agg(F.count("*").alias("n"))
