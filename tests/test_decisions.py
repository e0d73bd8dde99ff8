"""Hand cases for each row of the decision tables, and small properties."""


import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerflow.functions import canonical, payload as P
from ledgerflow.operators import bundles, capture, conflicts, follower, paging, snapshots, tables
from ledgerflow.plans import graph, lifecycle as L
from ledgerflow.sources import specs
from ledgerflow.sources.store import StaleVersion, Store
from ledgerflow.streaming import watch

EVENT = "ord long, user_pk long, txid long, table_id int, key_text string, op int, payload string"


@pytest.mark.parametrize(
    "ops, want",
    [([1, 3], None), ([2, 3], (3, None)), ([3], (3, None)), ([1, 2], (1, "b")), ([2, 2], (2, "b")), ([3, 1], (2, "b")), ([1, 3, 1], (1, "c"))],
)
def test_net_effect(spark, ops, want):
    events = spark.createDataFrame([(k, 1, 1, 1, "x", op, None if op == 3 else "abc"[k]) for k, op in enumerate(ops)], EVENT)
    assert rows(bundles.net(bundles.fold(events)), "op_code", "payload") == ([want] if want else [])


def test_empty_transactions_take_no_number(spark):
    events = spark.createDataFrame([(1, 1, 1, 1, "x", 2, "a"), (2, 1, 2, 1, "y", 1, "b"), (3, 1, 2, 1, "y", 3, None), (4, 1, 3, 1, "z", 2, "c")], EVENT)
    assert rows(bundles.bundle(events), "bundle_seq", "key_text") == [(1, "x"), (2, "z")]


def test_hash_does_not_depend_on_layout(spark, sf_dir):
    from ledgerflow.queries import base

    events = base.feed(spark, sf_dir)
    a = rows(bundles.headers(bundles.bundle(events)))
    assert a == rows(bundles.headers(bundles.bundle(events.repartition(7, "ord").orderBy(F.rand(3)))))


CONFLICTS = [
    (1, 0, None, None, "ok"), (1, 2, None, None, "version_mismatch"), (1, 5, 5, True, "ok"), (1, 4, 5, True, "version_mismatch"),
    (1, 5, 5, False, "already_exists"), (1, 4, 5, False, "version_mismatch"), (2, 0, None, None, "does_not_exist"), (3, 5, 5, True, "does_not_exist"),
    (2, 5, 5, False, "ok"), (3, 5, 5, False, "ok"), (2, 4, 5, False, "version_mismatch"),
]


def test_conflict_table(spark):
    df = spark.createDataFrame(CONFLICTS, "op int, base long, version long, deleted boolean, want string")
    got = df.withColumn("got", conflicts.verdict(F.col("op"), F.col("base"), F.col("version"), F.coalesce("deleted", F.lit(False))))
    assert got.filter("got <> want").count() == 0


def test_resolution_table(spark):
    want = {
        ("accept_server", "live"): ["apply_server_row"] * 3, ("accept_server", "gone"): ["apply_delete"] * 3, ("accept_server", "missing"): ["drop_local"] * 3,
        ("keep_local", "live"): ["requeue_update", "requeue_update", "requeue_delete"], ("keep_local", "gone"): ["requeue_insert", "invalid", "keep_deleted"], ("keep_local", "missing"): ["error", "invalid", "drop_state"],
        ("keep_merged", "live"): ["requeue_update_merged", "requeue_update_merged", "invalid"], ("keep_merged", "gone"): ["requeue_insert_merged", "invalid", "invalid"], ("keep_merged", "missing"): ["error", "invalid", "invalid"],
    }
    server = {"live": (7, False), "gone": (7, True), "missing": (None, False)}
    cases = [(r, s, op, *server[s], plans[op - 1]) for (r, s), plans in want.items() for op in (1, 2, 3)]
    df = spark.createDataFrame(cases, "result string, server string, op int, version long, deleted boolean, want string")
    got = df.withColumn("got", conflicts.resolution(F.col("result"), F.col("op"), F.col("version"), F.col("deleted")))
    assert rows(got.filter("got <> want OR got IS NULL")) == []


def test_resolver_is_called_on_batches(spark):
    df = spark.createDataFrame([(1, 3, 7, False), (2, 1, None, None)], "id long, op int, state_version long, state_deleted boolean")
    pick = lambda f: pd.Series(["keep_local" if i == 1 else "accept_server" for i in f["id"]], f.index)
    assert rows(conflicts.resolve(df, pick), "id", "plan") == [(1, "requeue_delete"), (2, "drop_local")]


def test_replay_table(spark):
    cases = [(3, True, False, 1), (3, False, False, None), (2, False, False, 3), (1, True, False, 2), (1, True, True, None)]
    df = spark.createDataFrame(cases, "op int, live boolean, same boolean, want int").withColumn("got", conflicts.replay(F.col("op"), F.col("live"), F.col("same")))
    assert df.filter("NOT (got <=> want)").count() == 0


def test_validation_order(spark):
    cases = [
        ("Bad!", "t", "INSERT", "k", "{}", False, True, "invalid_schema"), ("s", "t t", "INSERT", "k", "{}", False, True, "invalid_table"), ("s", "t", "INSERT", "k", "{}", False, False, "unregistered_table"),
        ("s", "t", "MERGE", "k", "{}", False, True, "invalid_op"), ("s", "t", "INSERT", None, "{}", False, True, "invalid_key"), ("s", "t", "INSERT", "k", "{}", True, True, "duplicate_target"),
        ("s", "t", "DELETE", "k", "{}", False, True, "delete_with_payload"), ("s", "t", "UPDATE", "k", None, False, True, "payload_missing"), ("s", "t", "UPDATE", "k", "[]", False, True, "payload_not_object"),
        ("s", "t", "UPDATE", "k", '{"_SYNC_scope_id":1}', False, True, "hidden_column"), ("s", "t", "UPDATE", "k", '{"id":"x"}', False, True, "key_mismatch"), ("s", "t", "UPDATE", "k", '{"A b":1}', False, True, "invalid_column"),
        ("s", "t", "UPDATE", "k", '{"id":"k","a":1}', False, True, None), ("s", "t", "DELETE", "k", None, False, True, None),
    ]
    df = spark.createDataFrame(cases, "s string, t string, op string, k string, p string, again boolean, known boolean, want string")
    got = df.withColumn("got", conflicts.rejection(F.col("known"), F.col("s"), F.col("t"), F.col("op"), F.col("k"), F.col("p"), F.col("again")))
    assert rows(got.filter("NOT (got <=> want)")) == []


def test_connect_table():
    fresh, busy, done = L.Scope(), L.Scope("INITIALIZING", "a", "i", 100.0), L.Scope("INITIALIZED", "a")
    told = lambda scope, source, has_rows, now=0.0: L.connect(scope, source, has_rows, now, lambda: "new")
    assert told(done, "b", True)[1]["resolution"] == "remote_authoritative"
    assert told(fresh, "a", True) == (L.Scope("INITIALIZING", "a", "new", 900.0), {"resolution": "initialize_local", "initialization_id": "new", "lease_expires_at": 900.0})
    assert told(fresh, "a", False)[0].state == "INITIALIZED"
    assert told(busy, "a", False)[1]["resolution"] == "initialize_empty"
    assert told(busy, "a", True, 50.0)[0] == L.Scope("INITIALIZING", "a", "i", 950.0)
    assert told(busy, "b", True, 98.5)[1] == {"resolution": "retry_later", "retry_after_seconds": 1}
    assert told(busy, "b", True, 40.0)[1]["retry_after_seconds"] == 60
    assert told(busy, "b", True, 100.0)[1]["initialization_id"] == "new"
    with pytest.raises(L.SyncError, match="initialization_expired"):
        L.require_lease(busy, "i", 100.0)
    with pytest.raises(L.SyncError, match="initialization_stale"):
        L.require_lease(busy, "other", 1.0)


def test_sources():
    s = L.Sources()
    assert [s.commit("a", 1), s.commit("a", 2), s.commit("a", 2, {2})] == ["committed", "committed", "already_committed"]
    for n, code in ((1, "history_pruned"), (5, "source_sequence_out_of_order")):
        with pytest.raises(L.SyncError, match=code):
            s.commit("a", n)
    s.rotate("a", "b", "source_retired")
    s.rotate("a", "b", "source_retired")
    for bad in (("a", "c", "source_retired"), ("b", "a", "source_retired"), ("b", "c", "whim")):
        with pytest.raises(L.SyncError, match="source_replacement_invalid"):
            s.rotate(*bad)
    with pytest.raises(L.SyncError, match="source_retired"):
        s.commit("a", 3)
    assert s.commit("b", 1) == "committed"


def test_push_session_and_follower():
    row = lambda k: {"schema": "public", "table": "t", "key": k}
    p = L.PushSession("u", "s", 1, 3, 100.0)
    assert p.upload("u", 0, [row("a"), row("b")], 1.0) == 2
    for args, code in ((("v", 2, [row("c")], 1.0), "forbidden"), (("u", 1, [row("c")], 1.0), "out_of_order"), (("u", 2, [row("c")], 100.0), "expired"), (("u", 2, [], 1.0), "chunk_invalid"), (("u", 2, [row("c"), row("d")], 1.0), "chunk_invalid")):
        with pytest.raises(L.SyncError, match=code):
            p.upload(*args)
    with pytest.raises(L.SyncError, match="push_commit_invalid"):
        p.committable("u", 1.0)
    p.upload("u", 2, [row("a")], 1.0)
    with pytest.raises(L.SyncError, match="push_commit_invalid"):
        p.committable("u", 1.0)  # a target twice across chunks
    f, _ = L.Follower().attach("u", "s", "remote_authoritative")
    with pytest.raises(L.SyncError, match="rebuild_required"):
        f.may("pull")
    f = L.Follower(attached=True, last_seen=4, outbox=1)
    with pytest.raises(L.SyncError, match="pending_outbox"):
        f.may("pull")
    assert f.replayed(5).last_seen == 5 and f.replayed(7).last_seen == 4


def test_retry():
    seen, pauses = [], []

    @L.retrying(sleep=pauses.append, chance=lambda: 0.5)
    def flaky():
        seen.append(1)
        if len(seen) < 3:
            raise TimeoutError
        return "done"

    assert flaky() == "done" and pauses == [0.1, 0.2]
    with pytest.raises(ValueError):
        L.retrying(sleep=pauses.append)(lambda: (_ for _ in ()).throw(ValueError()))()


def test_retention_and_pull(spark):
    df = spark.createDataFrame([(1, 20, 0), (2, 5, 0), (3, 20, 19)], "user_pk long, latest long, floor long")
    assert [r["new_floor"] for r in paging.floors(df, window=10, batch=4).orderBy("user_pk").collect()] == [4, 0, 19]
    log = spark.createDataFrame([(1, s, r) for s in range(1, 8) for r in (1, 2)], "user_pk long, bundle_seq long, row_ordinal long")
    page = paging.pull(log, 1, after=2, latest=7, limit=2)
    assert (page.rows.count(), page.has_more, page.next_after, page.stable) == (4, True, 4, 7)
    assert paging.pull(log, 1, after=4, latest=7, target=5).rows.count() == 2
    assert paging.pull(log, 1, after=0, latest=7, floor=3).rows.agg(F.min("bundle_seq")).first()[0] == 4
    assert paging.pull(log, 1, after=7, latest=7).rows.count() == 0
    for k in ({"after": 3, "floor": 3}, {"after": 0, "floor": 3, "strict_floor": True}):
        with pytest.raises(paging.HistoryPruned):
            paging.pull(log, 1, latest=7, **k)


def test_ordinals_are_gapless(spark):
    df = spark.range(1000).selectExpr("id % 3 AS scope", "hash(id) AS v").repartition(5)
    got = paging.ordinals(df, "scope", ["v"]).toPandas().sort_values(["scope", "ordinal"])
    for _, g in got.groupby("scope"):
        assert list(g["ordinal"]) == list(range(1, len(g) + 1)) and g["v"].is_monotonic_increasing


def test_snapshot_limits_and_order(spark):
    state = spark.createDataFrame([(1, 1, k, 3, False) for k in ("é", "a", "Z", "\u007f")], "user_pk long, table_id int, key_text string, bundle_seq long, deleted boolean")
    live = state.select("user_pk", "table_id", "key_text", F.lit("{}").alias("payload"))
    snap = snapshots.materialize(live, state)
    assert [r["key_text"] for r in snap.orderBy("snapshot_ordinal").collect()] == ["Z", "a", "\u007f", "é"]
    with pytest.raises(snapshots.SnapshotTooLarge):
        snapshots.within_limits(snap, max_rows=3)


def test_random_edits_like_a_model(spark):
    """Bundles of random edits lead a follower, in any pages and repeated, to what a dictionary says."""
    import random

    for seed in range(1, 4):
        r, model, events, ordinal = random.Random(seed), {}, [], 0
        dead = set()
        for tx in range(1, 31):
            for _ in range(r.randint(1, 8)):
                ordinal += 1
                dice = r.random()
                if dice < 0.35 and model:
                    key, op = r.choice(sorted(model)), 2
                elif dice < 0.65 and model:
                    key, op = r.choice(sorted(model)), 3
                else:
                    key, op = (r.choice(sorted(dead)) if dead and r.random() < 0.25 else f"n{ordinal}"), 1
                value = f'{{"v":{ordinal}}}'
                if op == 3:
                    model.pop(key)
                    dead.add(key)
                else:
                    model[key] = value
                    dead.discard(key)
                events.append((ordinal, 1, tx, 1, key, op, None if op == 3 else value))
        log = bundles.bundle(spark.createDataFrame(events, EVENT))
        empty = spark.createDataFrame([], "user_pk long, table_id int, key_text string, bundle_seq long, deleted boolean, payload string")
        once = follower.apply(empty, log.filter("bundle_seq <= 17"))
        twice = follower.apply(follower.apply(once, log.filter("bundle_seq BETWEEN 10 AND 20")), log)
        assert dict(rows(twice.filter("NOT deleted"), "key_text", "payload")) == model


def test_diff_applied_gives_the_new_version(spark):
    old = spark.createDataFrame([(1, "a", b"\x01"), (2, None, None), (3, "c", None)], "id long, name string, data binary")
    new = spark.createDataFrame([(1, "a", b"\x02"), (3, "c", None), (4, "d", b"")], "id long, name string, data binary")
    effects = capture.diff(old, new, "id")
    assert rows(effects, "id", "op_code") == [(1, 2), (2, 3), (4, 1)]
    assert rows(tables.upsert(old, new.join(effects, "id").select("id", "name", "data", "op_code").unionByName(old.join(effects.filter("op_code = 3"), "id").select("id", "name", "data", "op_code")), ["id"])) == rows(new)


def test_cascade_in_a_cycle(spark):
    t = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "id long, next_id long")
    gone = tables.cascade(spark.createDataFrame([("t", "1")], "table_name string, key_text string"), [("t", "next_id", "t", "CASCADE")], {"t": t}, {"t": "id"})
    assert rows(gone, "key_text") == [("1",), ("2",), ("3",)]


def test_graph_orders():
    edges = [("a", "b"), ("b", "a"), ("c", "a"), ("d", "c"), ("e", "e")]
    assert graph.strong_components("abcde", edges) == [["a", "b"], ["c"], ["d"], ["e"]]
    assert graph.parents_first("abcde", edges) == ["a", "b", "c", "d", "e"]
    assert graph.declared_order(["d", "c", "b", "a", "e"], edges) == ["e", "d", "c", "b", "a"]


def test_specs():
    from pyspark.sql import types as T

    schema = T.StructType().add("_sync_scope_id", "string").add("id", "string").add("n", "long")
    assert specs.check(specs.TableSpec("t", "id", schema, unique=(("_sync_scope_id", "id"),))).key_kind == "text"
    for bad in (specs.TableSpec("T x", "id", schema), specs.TableSpec("t", "n", schema), specs.TableSpec("t", "id", schema, unique=(("id",),)), specs.TableSpec("t", "id", T.StructType().add("id", "string"))):
        with pytest.raises(specs.SpecError):
            specs.check(bad)


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"b":1,"a":2}', '{"a":2,"b":1}'), ("1e21", "1e+21"), ("100000000000000000000", "100000000000000000000"), ("9007199254740993", "9007199254740992"), ("0.000001", "0.000001"), ("0.0000001", "1e-7"),
        ("1.50", "1.5"), ("-0.0", "-0"), ('"<&> é\\u0001"', '"\\u003c\\u0026\\u003e\\u2028é\\u0001"'), ('{"a":1,"a":2}', '{"a":2}'), ("[true,null,{}]", "[true,null,{}]"), ("nope", None),
    ],
)
def test_canonical_json(text, want):
    assert canonical.canonical_text(text) == want


def test_equivalence():
    same = [('"2026-03-24T18:42:11Z"', '"2026-03-24T10:42:11-08:00"'), ("1", "1.0"), ('{"a":[1]}', '{"a":[1.0]}'), (None, None)]
    differ = [('"2026-03-24T18:42:11"', '"2026-03-24T18:42:11Z"'), ("1", "true"), ('{"a":1}', '{"a":1,"b":null}'), (None, "null"), ("[1,2]", "[2,1]")]
    assert all(canonical.equivalent_texts(*p) for p in same) and not any(canonical.equivalent_texts(*p) for p in differ)


def test_lenient_fields(spark):
    values = ['" 0x1F"', '"017"', '"-12abc"', '"abc"', '""', "3.99", "-3.99", "true", "null", '"1e3x"', '".5"']
    df = spark.createDataFrame([(k, f'{{"v":{v}}}') for k, v in enumerate(values)], "k int, p string")
    got = df.select("k", P.int64_field(F.col("p"), "v").alias("i"), P.float64_field(F.col("p"), "v").alias("f")).orderBy("k").collect()
    assert [r["i"] for r in got] == [31, 15, -12, None, None, 3, -3, None, None, 1, None]
    assert [r["f"] for r in got] == [0.0, 17.0, -12.0, None, None, 3.99, -3.99, None, None, 1000.0, 0.5]
    with pytest.raises(Exception, match="required field"):
        df.select(P.required(P.str_field(F.col("p"), "w"), "w")).collect()


def test_uuid_forms(spark):
    forms = ["6BA7B810-9DAD-11D1-80B4-00C04FD430C8", "urn:uuid:6ba7b810-9dad-11d1-80b4-00c04fd430c8", "{6ba7b810-9dad-11d1-80b4-00c04fd430c8}", "6ba7b8109dad11d180b400c04fd430c8", "6ba7b810"]
    got = spark.createDataFrame([(f,) for f in forms], "t string").select(P.as_uuid(F.col("t"))).collect()
    assert [r[0] for r in got] == ["6ba7b810-9dad-11d1-80b4-00c04fd430c8"] * 4 + [None]


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    empty = store.latest()
    one = store.commit(empty, append={"log": spark.range(3).toDF("id")}, marks={"u/s": 1})
    two = store.commit(one, append={"log": spark.range(3, 5).toDF("id")}, replace={"state": spark.range(1).toDF("id")}, marks={"u/s": 2})
    assert (store.read("log", one).count(), store.read("log").count(), store.latest().number) == (3, 5, 2)
    assert store.commit(two, append={"log": spark.range(9).toDF("id")}, marks={"u/s": 2}) is two
    with pytest.raises(StaleVersion):
        store.commit(one, replace={"state": spark.range(7).toDF("id")})
    three = store.commit(two, replace={"state": spark.range(2).toDF("id")})
    gone = store.vacuum(keep=1)
    assert len(gone) == 2 and store.read("state", three).count() == 2


def test_events_on_the_wire():
    text = ": hi\n\n" + watch.frame_event(7, "s", 3) + "event: other\ndata: x\n\nevent: bundle\ndata: a\ndata: b\n\n"
    assert list(watch.parse_events(text.splitlines())) == [("bundle", '{"bundle_seq":7,"source_id":"s","source_bundle_id":3}'), ("bundle", "a\nb")]
    assert [p for p, _ in zip(watch.backoff(), range(6))] == [0.1, 0.2, 0.4, 0.8, 1.6, 2.0]


def test_source_sequence(spark):
    """Only accepted numbers move the sequence: a refused one changes nothing."""
    commits = spark.createDataFrame([(1, "s", n, k) for k, n in enumerate([1, 2, 2, 5, 3, 5, 1, 0, 4, 5])] + [(1, "t", 2, 0), (1, "t", 1, 1), (2, "s", 1, 0)], "user_pk long, source_id string, source_bundle_id long, arrived long")
    got = bundles.source_sequence(commits, pruned=1).orderBy("user_pk", "source_id", "arrived").collect()
    assert [r["status"] for r in got] == ["next", "next", "already_committed", "out_of_order", "next", "out_of_order", "history_pruned", "invalid", "next", "next", "out_of_order", "next", "next"]
    assert [r["expected"] for r in got] == [1, 2, 3, 3, 3, 4, 4, 4, 4, 5, 1, 1, 1]


def test_bundle_hash_is_of_whole_logical_rows(spark):
    """The body written out by hand, with keys that need every kind of escape."""
    import hashlib
    import json

    keys = ['a<b>&"c"', "line\nbreak\\  \x01\x1f", "é", ""]
    log = spark.createDataFrame([(1, 7, k + 1, 3 if k == 3 else 2, x, 1 + k % 3, None if k == 2 else '{"n":1}') for k, x in enumerate(keys)], "user_pk long, bundle_seq long, row_ordinal long, table_id int, key_text string, op_code int, payload string")
    got = bundles.headers(log, {2: ("public", "users", "id")}).first()
    escaped = ['a\\u003cb\\u003e\\u0026\\"c\\"', "line\\nbreak\\\\ \\u2028\\u0001\\u001f", "é", ""]
    ops, tables_ = ["INSERT", "UPDATE", "DELETE", "INSERT"], ["users", "users", "users", "table_3"]
    body = "[" + ",".join(f'{{"key":{{"id":"{e}"}},"op":"{o}","payload":{"null" if k == 2 else chr(123) + chr(34) + "n" + chr(34) + ":1}"},"row_ordinal":{k},"row_version":7,"schema":"public","table":"{t}"}}' for k, (e, o, t) in enumerate(zip(escaped, ops, tables_))) + "]"
    assert [x["key"]["id"] for x in json.loads(body)] == keys
    assert (got["row_count"], got["byte_count"], got["bundle_hash"]) == (4, len(body.encode()), hashlib.sha256(body.encode()).hexdigest())


def test_validation_of_nulls_keys_and_binary_values(spark):
    good = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    cases = [
        (None, "t", "INSERT", good, "{}", "invalid_schema"), ("s", None, "INSERT", good, "{}", "invalid_table"), ("s", "t", None, good, "{}", "invalid_op"), ("s", "t", "INSERT", good.upper(), "{}", "invalid_key"), ("s", "t", "INSERT", "k", "{}", "invalid_key"),
        ("s", "t", "INSERT", good, '{"data":"aGk="}', None), ("s", "t", "INSERT", good, '{"data":null,"x":"?"}', None), ("s", "t", "INSERT", good, '{"data":"aGl="}', "invalid_binary"), ("s", "t", "INSERT", good, '{"data":"aGk"}', "invalid_binary"), ("s", "t", "DELETE", good, None, None),
    ]
    df = spark.createDataFrame(cases, "s string, t string, op string, k string, p string, want string")
    reason = conflicts.rejection(F.lit(True), F.col("s"), F.col("t"), F.col("op"), F.col("k"), F.col("p"), F.lit(False), uuid_key=F.lit(True), binary=F.array(F.lit("data")))
    assert rows(df.withColumn("got", reason).filter("NOT (got <=> want)")) == []


def test_a_field_of_its_own_is_set_null(spark):
    texts = [('{"a":"x\\"y","b":{"a":"z"}}', '{"a":null,"b":{"a":"z"}}'), ('{"b":1}', '{"b":1}'), (None, None)]
    df = spark.createDataFrame(texts, "p string, want string")
    assert rows(df.withColumn("got", canonical.with_null(F.col("p"), "a")).filter("NOT (got <=> want)")) == []


def test_scope_guard(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", "x"), (4, "b", "x"), (5, "a", "x"), (6, "b", "x")], "id int, scope string, v string")
    new = spark.createDataFrame([(1, "a", "y"), (2, "b", "y"), (3, "b", "x"), (5, "a", "x"), (6, "b", "x"), (7, None, "n"), (8, "", "n"), (9, "b", "n")], "id int, scope string, v string")
    found = capture.scope_guard(old, new, "id", "scope", "a")
    assert rows(found, "id", "op_code", "scope", "reason") == [
        (1, 2, "a", None), (2, 2, "b", "scope_mismatch"), (3, 2, "b", "scope_mutation"), (4, 3, "b", "scope_mismatch"), (7, 1, "a", None), (8, 1, "a", None), (9, 1, "b", "scope_mismatch"),
    ]
    assert {r["reason"] for r in capture.scope_guard(old, new, "id", "scope", None).collect()} == {"no_bundle_context"}


def test_captured_writes_go_on_a_dirty_set(spark):
    schema = "user_pk int, table_id int, old_key string, new_key string, payload string, ord long, apply_mode int, pending boolean"
    writes = spark.createDataFrame([(1, 1, "a", "b", "{1}", 1, 0, False), (1, 1, None, "c", "{2}", 2, 0, None), (1, 1, "d", None, None, 3, 0, False), (1, 1, "e", "e", "{3}", 4, 1, True), (1, 1, "f", "f", "{4}", 5, 0, True), (1, 1, "c", "c", "{5}", 6, None, False)], schema)
    assert [r["ord"] for r in capture.write_guard(writes).filter("reason IS NOT NULL").collect()] == [5]
    edits = capture.captured(capture.write_guard(writes).filter("reason IS NULL"))
    assert rows(edits, "ord", "key_text", "op", "payload") == [(13, "c", 2, "{5}"), (2, "a", 3, None), (3, "b", 2, "{1}"), (5, "c", 1, "{2}"), (6, "d", 3, None)]
    state = spark.createDataFrame([(1, 1, "a", 7, False), (1, 1, "d", 8, False), (1, 1, "c", 9, True)], "user_pk int, table_id int, key_text string, bundle_seq long, deleted boolean")
    held = capture.coalesce_dirty(edits, state).filter("key_text <> 'b'")
    assert rows(held, "dirty_ordinal", "key_text", "op", "base_row_version") == [(1, "a", 3, 7), (3, "c", 1, 9), (4, "d", 3, 8)]
    later = state.filter("key_text <> 'a'").unionByName(spark.createDataFrame([(1, 1, "a", 20, False), (1, 1, "z", 21, False)], state.schema))
    more = spark.createDataFrame([(1, 1, "a", 30, 2, "{6}"), (1, 1, "z", 31, 2, "{7}"), (1, 1, "b", 32, 1, "{8}")], "user_pk int, table_id int, key_text string, ord long, op int, payload string")
    found = capture.accumulate_dirty(held, more, later)
    assert rows(found, "dirty_ordinal", "key_text", "op", "base_row_version", "payload") == [(1, "a", 2, 7, "{6}"), (3, "c", 1, 9, "{5}"), (4, "d", 3, 8, None), (5, "z", 2, 21, "{7}"), (6, "b", 1, 0, "{8}")]


def test_key_changes_cascade_and_end_in_a_cycle(spark):
    a = spark.createDataFrame([("1", "9"), ("2", "1")], "id string, b_id string")
    b = spark.createDataFrame([(1, "1", "x"), (2, None, "x")], "id int, a_id string, other string")
    edges = [("a", "id", "b", "CASCADE"), ("b", "id", "a", "CASCADE"), ("b", "a_id", "a", "SET NULL"), ("a", "b_id", "b", "RESTRICT")]
    changed = spark.createDataFrame([("a", "1", "5")], "table_name string, old_key string, new_key string")
    found = tables.cascade_updates(changed, edges, {"a": a, "b": b}, {"a": "id", "b": "id"})
    assert rows(found, "depth", "table_name", "key_text", "column", "new_value") == [(1, "b", "1", "a_id", None), (1, "b", "1", "id", "5"), (2, "a", "1", "id", "5")]
    assert tables.cascade_updates(changed, edges[3:], {"a": a, "b": b}, {"a": "id", "b": "id"}).isEmpty()


def test_pushes_commit_whole_or_not_at_all(spark):
    state = spark.createDataFrame([(1, 1, "a", 4, False), (2, 1, "a", 4, False)], "user_pk int, table_id int, key_text string, bundle_seq long, deleted boolean")
    requests = spark.createDataFrame([(1, 7, 0, 1, "a", 2, 4, "{}"), (1, 7, 1, 1, "b", 1, 0, "{}"), (2, 8, 0, 1, "a", 3, 3, None), (3, 9, 1, 1, "a", 1, 0, "{}")], "user_pk int, push_id int, req_ordinal long, table_id int, key_text string, op int, base_row_version long, payload string")
    latest = spark.createDataFrame([(1, 4), (2, 4)], "user_pk int, latest long")
    planned = spark.createDataFrame([(1, 7, 2), (2, 8, 1), (3, 9, 1), (4, 10, 1)], "user_pk int, push_id int, planned int")
    told, log = conflicts.commit(requests, state, latest, planned)
    assert rows(told) == [(1, 7, 2, 0, "committed", 5), (2, 8, 1, 1, "conflict", None), (3, 9, 1, 0, "incomplete", None), (4, 10, 0, 0, "incomplete", None)]
    assert rows(bundles.advance(state, log)) == [(1, 1, "a", 5, False), (1, 1, "b", 5, False), (2, 1, "a", 4, False)]
