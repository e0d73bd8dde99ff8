"""Catalogs, foreign keys, graphs and lifecycle decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.plans import graph, lifecycle
from ledgerflow.queries import base as B, query
from ledgerflow.sources import specs

#: The foreign keys of the test tables.
EDGES = [("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"), ("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier"), ("part", "p_partkey", "part")]
TABLES = ["region", "nation", "customer", "supplier", "orders", "lineitem", "part"]
_EDGES = "edges AS (SELECT * FROM (VALUES ('nation', 'region'), ('customer', 'nation'), ('supplier', 'nation'), ('orders', 'customer'), ('lineitem', 'orders'), ('lineitem', 'part'), ('lineitem', 'supplier'), ('part', 'part')) AS t(child, parent))"
_NODES = "nodes AS (SELECT * FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('orders'), ('lineitem'), ('part')) AS t(table_name))"


def edges(spark):
    return spark.createDataFrame(EDGES, "child string, child_col string, parent string")


def nodes(spark):
    return spark.createDataFrame([(t,) for t in TABLES], "table_name string")


def pairs(df):
    """Edges of a schema's graph, which has no more rows than the schema has foreign keys."""
    return [tuple(r) for r in df.select("child", "parent").collect()]


@query("grf_01_dependencies", f"WITH {_EDGES} SELECT DISTINCT child, parent FROM edges WHERE child <> parent")
def dependencies(spark, d):
    return graph.dependencies(edges(spark))


@query("grf_02_components", "SELECT * FROM (VALUES ('a', 0), ('b', 0), ('c', 0), ('d', 1), ('e', 2), ('f', 2)) AS t(node, component)")
def components(spark, d):
    groups = graph.strong_components("abcdef", [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "f"), ("f", "e"), ("e", "d")])
    return spark.createDataFrame([(n, k) for k, g in enumerate(groups) for n in g], "node string, component int")


@query("grf_03_parents_first", "SELECT * FROM (VALUES ('part', 0), ('region', 1), ('nation', 2), ('customer', 3), ('orders', 4), ('supplier', 5), ('lineitem', 6)) AS t(table_name, place)")
def parents_first(spark, d):
    return spark.createDataFrame(list(zip(graph.parents_first(TABLES, pairs(edges(spark))), range(7))), "table_name string, place int")


@query("grf_03b_levels", f"WITH RECURSIVE {_EDGES}, {_NODES}, reach(table_name, depth) AS (SELECT table_name, 0 FROM nodes UNION ALL SELECT e.child, depth + 1 FROM reach JOIN edges e ON e.parent = reach.table_name AND e.child <> e.parent) SELECT table_name, max(depth) AS level FROM reach GROUP BY table_name")
def levels(spark, d):
    return graph.levels(edges(spark), nodes(spark))


@query("grf_04_declared_order", "SELECT * FROM (VALUES ('region', 0), ('part', 1), ('nation', 2), ('supplier', 3), ('customer', 4), ('orders', 5), ('lineitem', 6)) AS t(table_name, place)")
def declared_order(spark, d):
    # parents before children; what is free goes in the order of declaration
    order = graph.declared_order(["lineitem", "orders", "region", "part", "nation", "supplier", "customer"], pairs(edges(spark)))
    return spark.createDataFrame(list(zip(order, range(7))), "table_name string, place int")


@query("grf_05_overrides", f"WITH {_EDGES} SELECT DISTINCT child, parent FROM (SELECT * FROM edges UNION ALL SELECT 'part', 'supplier') WHERE child <> parent")
def overrides(spark, d):
    return graph.with_overrides(edges(spark), {"part": ["supplier"]})


@query("grf_06_foreign_key_shapes", "SELECT 'public.c(_sync_scope_id,p_id): the constraint must be deferrable' AS problem UNION ALL SELECT 'public.c(_sync_scope_id,p_id): ON DELETE SET DEFAULT is not supported' UNION ALL SELECT 'public.c(p_id): the key must be _sync_scope_id and one column' UNION ALL SELECT 'public.c(x): public.q is not registered'")
def foreign_key_shapes(spark, d):
    from pyspark.sql import types as T

    schema = T.StructType().add("_sync_scope_id", "string").add("id", "string").add("p_id", "string")
    key = lambda columns, parent, parents, **k: specs.ForeignKey("public.c", columns, parent, parents, **k)
    two = ("_sync_scope_id", "p_id")
    parent = specs.TableSpec("p", "id", schema)
    child = specs.TableSpec("c", "id", schema, foreign_keys=(key(two, "public.p", ("_sync_scope_id", "id")), key(two, "public.p", ("_sync_scope_id", "id"), deferrable=False, on_delete="SET DEFAULT"), key(("p_id",), "public.p", ("id",)), key(("x",), "public.q", ("id",))))
    return spark.createDataFrame([(x,) for x in specs.check_foreign_keys([parent, child])], "problem string")


for _name in ("grf_07_closure", "agg_17_missing_parents"):

    @query(_name, f"WITH {_EDGES}, {_NODES} SELECT child, string_agg(DISTINCT parent, '; ' ORDER BY parent) AS missing FROM edges WHERE parent NOT IN (SELECT table_name FROM nodes WHERE table_name NOT IN ('part', 'supplier', 'region')) GROUP BY child")
    def closure(spark, d):
        return graph.missing_parents(edges(spark), nodes(spark).filter("table_name NOT IN ('part', 'supplier', 'region')"))


@query("joi_11_catalog_check", "SELECT * FROM (VALUES (2, 'public.b', NULL), (3, 'public.c', 'public.x')) AS t(table_id, expected_table_name, actual_table_name)")
def catalog_check(spark, d):
    expected = spark.createDataFrame([(1, "public.a"), (2, "public.b"), (3, "public.c")], "table_id int, table_name string")
    actual = spark.createDataFrame([(1, "public.a"), (3, "public.x")], "table_id int, table_name string")
    return specs.catalog_differences(expected, actual)


@query(
    "joi_12_foreign_key_columns",
    "SELECT * FROM (VALUES ('lineitem_part_fk', 'lineitem', 'part', '_sync_scope_id,l_partkey', '_sync_scope_id,p_partkey', CAST(2 AS BIGINT)), ('nation_region_fk', 'nation', 'region', '_sync_scope_id,n_regionkey', '_sync_scope_id,r_regionkey', 2), ('orders_customer_fk', 'orders', 'customer', 'o_custkey', 'c_custkey', 1)) AS t(constraint_name, child, parent, child_columns, parent_columns, n)",
)
def foreign_key_columns(spark, d):
    """Both sides list their columns in any order; ordinals bring them together."""
    child = spark.createDataFrame(
        [("lineitem_part_fk", "lineitem", 2, "l_partkey"), ("lineitem_part_fk", "lineitem", 1, "_sync_scope_id"), ("nation_region_fk", "nation", 1, "_sync_scope_id"), ("nation_region_fk", "nation", 2, "n_regionkey"), ("orders_customer_fk", "orders", 1, "o_custkey"), ("orders_pkey", "orders", 1, "o_orderkey")],
        "constraint_name string, child string, ordinal int, child_column string",
    )
    parent = spark.createDataFrame(
        [("lineitem_part_fk", "part", 1, "_sync_scope_id"), ("lineitem_part_fk", "part", 2, "p_partkey"), ("nation_region_fk", "region", 2, "r_regionkey"), ("nation_region_fk", "region", 1, "_sync_scope_id"), ("orders_customer_fk", "customer", 1, "c_custkey")],
        "constraint_name string, parent string, ordinal int, parent_column string",
    )
    return specs.foreign_key_columns(child, parent)


@query("src_07_introspection", "SELECT CAST(ordinal_position AS INTEGER) AS ordinal, column_name FROM (VALUES (1, 'c_custkey'), (2, 'c_name'), (3, 'c_nationkey'), (4, 'c_acctbal'), (5, 'c_mktsegment')) AS t(ordinal_position, column_name)")
def introspection(spark, d):
    return specs.columns_of(B.table(spark, d, "customer")).select("ordinal", "column_name")


_SCOPES = "SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'UNINITIALIZED' WHEN 1 THEN 'INITIALIZING' ELSE 'INITIALIZED' END AS state, user_id % 2 = 0 AS same_source, count(*) FILTER (WHERE event_type = 'error') > 10 AS has_rows FROM events GROUP BY user_id"


@query("op_05_connect", f"SELECT user_id, CASE WHEN state = 'INITIALIZED' THEN 'remote_authoritative' WHEN state = 'INITIALIZING' AND NOT same_source THEN 'retry_later' WHEN has_rows THEN 'initialize_local' ELSE 'initialize_empty' END AS resolution FROM ({_SCOPES})")
def connect(spark, d):
    found = B.table(spark, d, "events").groupBy("user_id").agg((F.count_if(F.expr("event_type = 'error'")) > 10).alias("has_rows"))
    state = F.when(F.col("user_id") % 3 == 0, "UNINITIALIZED").when(F.col("user_id") % 3 == 1, "INITIALIZING").otherwise("INITIALIZED")
    return found.select("user_id", lifecycle.connect_resolution(state, F.col("user_id") % 2 == 0, F.col("has_rows")).alias("resolution"))


_ROTATIONS = """(VALUES ('a', 'b', 'rotated', 'a:retired,b:reserved'), ('a', 'b', 'rotated', 'a:retired,b:reserved'), ('a', 'c', 'source_replacement_invalid', 'a:retired,b:reserved'),
 ('b', 'c', 'rotated', 'a:retired,b:retired,c:reserved'), ('b', 'c', 'rotated', 'a:retired,b:retired,c:reserved')) AS r(previous, replacement, outcome, states)"""


@query("op_11_source_rotation", f"SELECT CAST(scope AS INTEGER) AS scope, previous, replacement, outcome, states FROM range(4) AS s(scope), {_ROTATIONS}")
def source_rotation(spark, d):
    """Rotations of many scopes' sources through the state machine, in order of arrival."""
    out = []
    for scope in range(4):
        sources = lifecycle.Sources(state={"a": "active"})
        for previous, replacement in (("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("b", "c")):
            try:
                sources.rotate(previous, replacement, lifecycle.REASONS[scope])
                outcome = "rotated"
            except lifecycle.SyncError as e:
                outcome = e.code
            out.append((scope, previous, replacement, outcome, ",".join(f"{k}:{v}" for k, v in sorted(sources.state.items()))))
    return spark.createDataFrame(out, "scope int, previous string, replacement string, outcome string, states string")


@query(
    "op_12_scope_lease",
    """SELECT CAST(now AS DOUBLE) AS now, source, has_rows, resolution, state, CAST(retry_after AS INTEGER) AS retry_after FROM (VALUES (0, 'a', true, 'initialize_local', 'INITIALIZING', NULL), (10, 'b', true, 'retry_later', 'INITIALIZING', 890),
    (20, 'a', true, 'initialize_local', 'INITIALIZING', NULL), (2000, 'b', false, 'initialize_empty', 'INITIALIZED', NULL), (2001, 'a', true, 'remote_authoritative', 'INITIALIZED', NULL)) AS t(now, source, has_rows, resolution, state, retry_after)""",
)
def scope_lease(spark, d):
    out, scope = [], lifecycle.Scope()
    for now, source, rows in ((0.0, "a", True), (10.0, "b", True), (20.0, "a", True), (2000.0, "b", False), (2001.0, "a", True)):
        scope, said = lifecycle.connect(scope, source, rows, now, new_id=lambda: "i1")
        out.append((now, source, rows, said["resolution"], scope.state, said.get("retry_after_seconds")))
    return spark.createDataFrame(out, "now double, source string, has_rows boolean, resolution string, state string, retry_after int")


@query("op_20_follower_lifecycle", "SELECT * FROM (VALUES ('attach', 'started_empty'), ('attach', 'already_attached'), ('detach', 'blocked_unsynced_data'), ('detach', 'detached')) AS t(operation, outcome)")
def follower_lifecycle(spark, d):
    out, me = [], lifecycle.Follower()
    me, outcome = me.attach("u", "s", "initialize_empty")
    out.append(("attach", outcome))
    me, outcome = me.attach("u", "s", "initialize_empty")
    out.append(("attach", outcome))
    for dirty in (1, 0):
        from dataclasses import replace

        me, outcome = replace(me, dirty=dirty).detach()
        out.append(("detach", outcome))
    return spark.createDataFrame(out, "operation string, outcome string")


@query(
    "op_22_capabilities",
    """SELECT * FROM (VALUES ('protocol_version', 'v1'), ('features', '(''connect_lifecycle'', ''bundle_push'', ''bundle_pull'', ''snapshot_chunks'', ''bundle_change_watch'')'), ('max_rows_per_bundle', '0'), ('max_bytes_per_bundle', '0'),
    ('default_bundles_per_pull', '1000'), ('max_bundles_per_pull', '5000'), ('default_rows_per_chunk', '1000'), ('max_rows_per_chunk', '5000'), ('retained_bundles', '10000'), ('session_seconds', '900')) AS t(name, value)""",
)
def capabilities(spark, d):
    from dataclasses import asdict

    return spark.createDataFrame([(k, str(v)) for k, v in asdict(lifecycle.Capabilities()).items()], "name string, value string")
