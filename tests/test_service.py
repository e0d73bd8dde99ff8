"""Followers and the service end to end."""

import threading
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F, types as T

from ledgerflow.client import Client, client_wins
from ledgerflow.plans.lifecycle import SyncError
from ledgerflow.service import EVENTS, Service
from ledgerflow.streaming import loops
from ledgerflow.sources.specs import SCOPE, ForeignKey, SpecError, TableSpec

USERS = TableSpec("users", "id", T.StructType().add(SCOPE, "string").add("id", "string").add("name", "string"))
POSTS = TableSpec(
    "posts", "id", T.StructType().add(SCOPE, "string").add("id", "string").add("author_id", "string").add("title", "string"),
    foreign_keys=(ForeignKey("public.posts", (SCOPE, "author_id"), "public.users", (SCOPE, "id"), on_delete="CASCADE"),),
)


@pytest.fixture
def world(spark, tmp_path):
    now = [0.0]
    service = Service(spark, f"file://{tmp_path}/server", [POSTS, USERS], clock=lambda: now[0], retained=3, prune_batch=2)
    make = lambda name, **k: Client(spark, service, f"file://{tmp_path}/{name}", source=name, chunk=2, **k)
    return service, make, now


def user(k, name="n"):
    return ("users", k, {"id": k, "name": name})


def post(k, author, title="t"):
    return ("posts", k, {"id": k, "author_id": author, "title": title})


def seen(client):
    return rows(client.rows(), "table_id", "key_text", "payload")


def test_two_followers_converge(world):
    service, make, _ = world
    a, b = make("a"), make("b")
    a.write([user("u1"), post("p1", "u1"), post("p2", "u1")])
    assert a.attach("me") == "seeded_from_local" and b.attach("me") == "retry_later"
    assert a.push_pending() == "pushed" and a.push_pending() == "nothing"
    assert b.attach("me") == "used_remote" and b.attach("me") == "already_attached"
    assert seen(a) == seen(b) and len(seen(a)) == 3
    b.write([post("p1", "u1", "new"), ("posts", "p2", None), post("p3", "u1")])
    assert b.pending_sync_status()["pending_row_count"] == 3 and b.detach() == "blocked_unsynced_data"
    with pytest.raises(SyncError, match="dirty_rows"):
        b.pull_to_stable()
    assert b.sync() == ("pushed", "up_to_date") and a.sync() == ("nothing", "pulled")
    assert seen(a) == seen(b) and a.get("posts", "p1")["title"] == "new" and a.get("posts", "p2") is None
    assert a.sync_status()["authority"] == "authoritative_materialized" and service.status("me")["latest_bundle_seq"] == 2
    assert service.watch("me", 1) == {"bundle_seq": 2} and service.watch("me", 2) is None


def test_conflicts(world):
    service, make, _ = world
    a = make("a")
    a.write([user("u1")])
    a.attach("me")
    a.push_pending()
    b, c = make("b", resolver=client_wins), make("c", resolver=lambda x: ("keep_merged", {"id": "u1", "name": "merged"}))
    for x in (b, c):
        x.attach("me")
    for x, name in ((a, "A"), (b, "B"), (c, "C")):
        x.write([user("u1", name)])
    assert a.push_pending() == "pushed"
    assert b.push_pending() == "pushed" and b.get("users", "u1")["name"] == "B"
    assert c.push_pending() == "pushed" and c.get("users", "u1")["name"] == "merged"
    a.write([user("u1", "late")])
    assert a.push_pending() == "nothing" and a.get("users", "u1")["name"] == "merged"
    a.pull_to_stable()
    assert seen(a) == seen(c)


def test_cascade_and_references(world, spark):
    service, make, _ = world
    a = make("a")
    a.write([user("u1"), user("u2"), post("p1", "u1"), post("p2", "u2")])
    a.attach("me")
    a.push_pending()
    b = make("b")
    b.attach("me")
    b.write([("users", "u1", None)])
    b.push_pending()
    a.pull_to_stable()
    assert [k for _, k, _ in seen(a)] == ["p2", "u2"] and seen(a) == seen(b)
    a.write([post("p9", "nobody")])
    with pytest.raises(SyncError, match="foreign_key_violation"):
        a.push_pending()


def test_pruned_history_leads_to_a_rebuild(world):
    service, make, _ = world
    a, b = make("a"), make("b")
    a.write([user("u1")])
    a.attach("me")
    a.push_pending()
    b.attach("me")
    for k in range(7):
        a.write([user(f"x{k}")])
        a.push_pending()
    assert service.status("me")["retained_floor"] > 1
    assert b.pull_to_stable() == "rebuilt" and seen(a) == seen(b)
    with pytest.raises(SyncError, match="history_pruned"):
        service.committed_bundle_rows("me", 1)
    old = b.source_info()["source_id"]
    b.rebuild(keep_edits=True, replace_source="b2")
    b.write([user("y")])
    assert b.push_pending() == "pushed"
    with pytest.raises(SyncError, match="source_retired"):
        service.create_push_session("me", old, 1, 1)


def test_push_sessions_are_checked(world):
    service, make, now = world
    service.connect("me", "s", False)
    row = {"schema": "", "table": " Users", "key": {"id": "k"}, "op": "insert", "base_row_version": 0, "payload": {"id": "k", "name": "x"}}
    push = service.create_push_session("me", "s", 1, 2)["push_id"]
    with pytest.raises(SyncError, match="push_chunk_invalid") as e:
        service.upload_push_chunk("me", push, 0, [row, row])
    assert e.value.details["reason"] == "duplicate_target"
    assert service.upload_push_chunk("me", push, 0, [row]) == 1
    with pytest.raises(SyncError, match="push_commit_invalid"):
        service.commit_push_session("me", push)
    service.upload_push_chunk("me", push, 1, [row | {"key": {"id": "l"}, "payload": {"id": "l", "name": "y"}}])
    done = service.commit_push_session("me", push)
    assert done["status"] == "committed" and done["row_count"] == 2
    assert service.create_push_session("me", "s", 1, 2) | {"status": 0} == done | {"status": 0}
    page = service.committed_bundle_rows("me", 1, max_rows=1)
    assert page["has_more"] and page["rows"][0]["key"] == {"id": "k"} and service.committed_bundle_rows("me", 1, page["next_row_ordinal"])["rows"][0]["key"] == {"id": "l"}
    for number, code in ((1, "already"), (3, "out_of_order")):
        if number == 3:
            with pytest.raises(SyncError, match=code):
                service.create_push_session("me", "s", number, 1)
    now[0] = 10_000.0
    push = service.create_push_session("me", "s", 2, 1)["push_id"]
    now[0] = 20_000.0
    with pytest.raises(SyncError, match="push_session_expired"):
        service.upload_push_chunk("me", push, 0, [row])
    for call, code in ((lambda: service.pull("nobody"), "scope_uninitialized"), (lambda: service.delete_push_session("you", push), "forbidden"), (lambda: service.snapshot_chunk("me", "x"), "not_found")):
        with pytest.raises(SyncError, match=code):
            call()


def test_server_writes_and_snapshots(world, spark):
    service, _, now = world
    insert = lambda current: spark.createDataFrame([(1, "me", 0, 2, "u", 1, '{"id":"u","name":"s"}')], EVENTS)
    assert service.exec_write("me", insert)["bundle_seq"] == 1
    rename = lambda current: current.filter("key_text = 'u'").select(F.lit(1).cast("long").alias("ord"), "user_pk", F.lit(0).cast("long").alias("txid"), "table_id", "key_text", F.lit(2).alias("op"), F.lit('{"id":"u","name":"t"}').alias("payload"))
    assert service.exec_write("me", rename)["bundle_seq"] == 2
    nothing = lambda current: spark.createDataFrame([(1, "me", 0, 2, "v", 1, "{}"), (2, "me", 0, 2, "v", 3, None)], EVENTS)
    assert service.exec_write("me", nothing)["status"] == "no_effects" and service.status("me")["latest_bundle_seq"] == 2
    assert service.within_bundle("me", "server", 2 + 1, rename)["bundle_seq"] == 3
    snap = service.create_snapshot_session("me")
    assert service.snapshot_chunk("me", snap["snapshot_id"])["rows"] == [{"schema": "public", "table": "users", "key": {"id": "u"}, "row_version": 3, "payload": {"id": "u", "name": "t"}}]
    with pytest.raises(SyncError, match="forbidden"):
        service.snapshot_chunk("you", snap["snapshot_id"])
    now[0] = 10_000.0
    with pytest.raises(SyncError, match="expired"):
        service.snapshot_chunk("me", snap["snapshot_id"])
    page = service.pull("me", after=1, max_bundles=1)
    assert [b["bundle_seq"] for b in page["bundles"]] == [2] and page["has_more"]
    service.stop()
    with pytest.raises(SyncError, match="service_unavailable"):
        service.pull("me")


def test_bad_tables_are_refused(spark, tmp_path):
    with pytest.raises(SpecError):
        Service(spark, f"file://{tmp_path}", [POSTS])


def test_paused_and_background_work(world):
    service, make, _ = world
    timings = []
    service.recorder = timings.append
    a, b = make("a"), make("b")
    a.write([user("u1"), post("p1", "u1"), post("p2", "u1")])
    a.attach("me")
    a.pause_uploads(), a.pause_downloads()
    assert a.sync() == ("skipped_paused", "skipped_paused") and a.pending_sync_status()["pending_row_count"] == 3
    a.resume_uploads(), a.resume_downloads()
    assert a.sync() == ("pushed", "up_to_date")
    assert a.transfer_diagnostics(reset=True) == {"push_sessions": 1, "push_chunks": 2, "committed_chunks": 2, "snapshot_sessions": 0}
    assert not any(a.transfer_diagnostics().values())
    assert {(t.operation, t.stage, t.error) for t in timings} == {("commit", x, False) for x in ("cascade", "fold", "references", "write")}
    assert b.attach("me") == "used_remote" and b.transfer_diagnostics()["snapshot_sessions"] == 1
    b.start(least=1.0, fallback=20.0)
    try:
        with pytest.raises(SyncError, match="already_started"):
            b.start()
        a.write([post("p3", "u1")])
        a.push_pending()
        until = time.monotonic() + 60
        while b.store.latest().info["me"]["last_seen"] < 2 and time.monotonic() < until:
            time.sleep(0.1)
        assert b.get("posts", "p3") == {"author_id": "u1", "id": "p3", "title": "t"}
        b.write([post("p4", "u1")])
        while service.status("me")["latest_bundle_seq"] < 3 and time.monotonic() < until:
            time.sleep(0.1)
    finally:
        b.stop()
    a.sync()
    assert seen(a) == seen(b) and a.get("posts", "p4")


def test_waits_of_loops():
    outcomes = iter([OSError(), OSError(), SyncError("not_attached"), True, False, OSError()])

    def step():
        x = next(outcomes)
        if isinstance(x, Exception):
            raise x
        return x

    loop = loops.Loop(step, threading.Event(), 1.0, 3.0)
    assert [loop.turn() for _ in range(6)] == [1.0, 2.0, 1.0, 0.0, 1.0, 1.0] and isinstance(loop.error, OSError)
    loop.paused.set()
    assert loop.turn() == loop.pause == 2.0 and loop.turns == 6
    assert loops.next_wait(OSError(), 50) == 60 and loops.next_wait(OSError(), 0.1) == 1


def test_listener_reconnects_and_catches_up():
    hub, stop, waited = loops.Hub(), threading.Event(), []
    one, other = hub.join("s", 4), hub.join("t")
    streams = iter([OSError(), OSError(), [("s", 6), ("s", 5), ("u", 9)], OSError(), [("t", 2)]])
    newest = {"s": 5, "t": 0}

    def connect():
        try:
            x = next(streams)
        except StopIteration:
            stop.set()
            return []
        if isinstance(x, Exception):
            newest["t"] = 1
            raise x
        return x

    def waits():
        for x in (0.01, 0.02, 0.04):
            waited.append(x)
            yield x

    assert loops.listen(connect, hub, newest.get, stop, waits) == 3
    assert waited == [0.01, 0.02, 0.01, 0.02, 0.01, 0.02][: len(waited)] and one.wait(0) == 6 and one.wait(0) is None
    assert other.wait(0) == 2 and hub.scopes() == ["s", "t"]
    one.close(), other.close()
    assert hub.scopes() == [] and one.wait() is None
