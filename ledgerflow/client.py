"""A follower: local edits over an authoritative copy, pushed, pulled, rebased and rebuilt.

The follower's store holds `state` (the last authoritative version of each row,
with tombstones) and `edits` (local changes in order). What a reader sees, what
is dirty, and on which version an edit is based, all follow from these two; so
rebasing is replacing state, and no edit is ever rewritten.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerflow.functions import canonical
from ledgerflow.operators import bundles, capture, conflicts, follower, status
from ledgerflow.plans import graph
from ledgerflow.plans.lifecycle import Follower, SyncError
from ledgerflow.runtime import cut
from ledgerflow.service import ROWS, Service, _floats
from ledgerflow.sources.store import Store
from ledgerflow.streaming import loops

EDITS = "ord long, user_pk string, table_id int, key_text string, op int, payload string"
Resolver = Callable[[dict], "str | tuple[str, dict]"]


def server_wins(conflict: dict) -> str:
    return "accept_server"


def client_wins(conflict: dict) -> str:
    return "keep_local"


def _alone(operation):
    """One operation of a client at a time, whichever thread it comes from."""

    @wraps(operation)
    def run(self, *a, **b):
        with self._lock:
            return operation(self, *a, **b)

    return run


class Client:
    def __init__(self, spark: SparkSession, service: Service, root: str, source: str | None = None, resolver: Resolver = server_wins, auto_retries: int = 2, chunk: int = 1000):
        self.spark, self.service, self.resolver, self.auto_retries, self.chunk = spark, service, resolver, auto_retries, chunk
        self.store = Store(spark, root)
        self._lock, self._stop = threading.RLock(), threading.Event()
        self.uploads_paused, self.downloads_paused = threading.Event(), threading.Event()
        self.transfers, self._threads, self._notices = Counter(), [], None
        if "me" not in self.store.latest().info:
            self._save(Follower(source=source or str(uuid.uuid4())), sent=0, next_source_bundle_id=1)
        order = graph.parents_first(service.table_ids, [(self.service.tables[c].full_name, self.service.tables[p].full_name) for c, p, _, _ in service._references()])
        self._ranks = [(service.table_ids[t], k) for k, t in enumerate(order)]

    # --- what is stored --------------------------------------------------------------------------------------------

    def _save(self, me: Follower | None = None, append=None, replace_=None, **info):
        version = self.store.latest()
        facts = ({"me": asdict(me)} if me else {}) | info
        return self.store.commit(version, append=append, replace=replace_, info=facts)

    @property
    def me(self) -> Follower:
        info = self.store.latest().info
        pending = self.pending().count() if info["me"]["attached"] else 0
        return replace(Follower(**info["me"]), dirty=pending)

    def _table(self, name: str, schema: str) -> DataFrame:
        found = self.store.read(name)
        return self.spark.createDataFrame([], schema) if found is None else found

    def state(self) -> DataFrame:
        return self._table("state", ROWS)

    def _edits(self, up_to: int | None = None) -> DataFrame:
        """Edits that no push has settled yet."""
        edits = self._table("edits", EDITS).filter(F.col("ord") > self.store.latest().info["sent"])
        return edits if up_to is None else edits.filter(F.col("ord") <= up_to)

    def pending(self, up_to: int | None = None) -> DataFrame:
        """Dirty rows: op and base version as they follow from the state."""
        return capture.without_noops(capture.fold_edits(self._edits(up_to), self.state()))

    def rows(self) -> DataFrame:
        """What a reader sees: the authoritative copy with local edits over it."""
        base = self.state().filter("NOT deleted").withColumnRenamed("bundle_seq", "row_version")
        return follower.rebuild(base, self.pending().select(*bundles.ROW, "op", "payload")).filter("NOT deleted").select("user_pk", "table_id", "key_text", "payload")

    def get(self, table: str, key: str) -> dict | None:
        found = self.rows().filter((F.col("table_id") == self._id(table)) & (F.col("key_text") == key)).first()
        return json.loads(found["payload"]) if found else None

    def _id(self, table: str) -> int:
        name = table if "." in table else f"public.{table}"
        if name not in self.service.table_ids:
            raise SyncError("unregistered_table", 400)
        return self.service.table_ids[name]

    # --- local edits -----------------------------------------------------------------------------------------------

    @_alone
    def write(self, changes: list[tuple[str, str, dict | None]]) -> None:
        """Local edits (table, key, payload; None deletes), in order, in one transaction."""
        version = self.store.latest()
        user, first = version.info["me"]["user"] or "", version.info.get("ord", 0) + 1
        plain = [(first + k, user, self._id(t), key, 3 if row is None else 2, None if row is None else canonical.render(_floats(row))) for k, (t, key, row) in enumerate(changes)]
        self.store.commit(version, append={"edits": self.spark.createDataFrame(plain, EDITS)}, info={"ord": first + len(changes) - 1})

    # --- lifecycle -------------------------------------------------------------------------------------------------

    @_alone
    def attach(self, user: str) -> str:
        me = Follower(**self.store.latest().info["me"])
        edits = self._table("edits", EDITS)
        told = self.service.connect(user, me.source, not edits.isEmpty())
        me, outcome = me.attach(user, me.source, told["resolution"])
        if outcome in ("already_attached", "retry_later"):
            return outcome
        # edits made before the user was known are the user's
        self._save(me, replace_={"edits": cut(edits.withColumn("user_pk", F.lit(user)), "edits")}, initialization_id=told.get("initialization_id"))
        if outcome == "used_remote":
            self.rebuild(keep_edits=True)
        return outcome

    @_alone
    def detach(self) -> str:
        me, outcome = self.me.detach()
        if outcome == "detached":
            empty = self.spark.createDataFrame([], ROWS)
            self._save(replace(me, source=str(uuid.uuid4())), replace_={"state": empty, "edits": self.spark.createDataFrame([], EDITS)}, sent=0, ord=0, next_source_bundle_id=1)
        return outcome

    @_alone
    def sync_then_detach(self) -> str:
        self.sync()
        return self.detach()

    @_alone
    def uninstall(self) -> None:
        if self.detach() != "detached":
            raise SyncError("blocked_unsynced_data")

    # --- push ------------------------------------------------------------------------------------------------------

    @_alone
    def push_pending(self) -> str:
        """Send all pending edits as one bundle: `nothing`, or `pushed`. Conflicts go to the resolver, a few times.

        `skipped_paused` while uploads are paused.
        """
        if self.uploads_paused.is_set():
            return "skipped_paused"
        for attempt in range(self.auto_retries + 1):
            me = self.me
            me.may("push")
            info = self.store.latest().info
            frozen = info.get("ord", 0)
            ranks = self.spark.createDataFrame(self._ranks, "table_id int, table_rank int")
            outbox = cut(capture.send_order(self.pending(frozen), ranks, "first_ordinal"), "outbox")
            total = outbox.count()
            if not total:
                return "nothing"
            number = info["next_source_bundle_id"]
            self.transfers["push_sessions"] += 1
            session = self.service.create_push_session(me.user, me.source, number, total, info.get("initialization_id"))
            try:
                header = session if session["status"] == "already_committed" else self._upload(me, session["push_id"], outbox, total)
            except SyncError as e:
                if e.code != "push_conflict" or attempt == self.auto_retries:
                    raise
                self._resolve(e.details["conflict"])
                continue
            self._replay(me, header, frozen, number)
            return "pushed"
        raise AssertionError

    def _upload(self, me: Follower, push_id: str, outbox: DataFrame, total: int) -> dict:
        for at in range(0, total, self.chunk):
            # one chunk at a time reaches the driver, as it would reach the wire
            part = outbox.filter((F.col("place") > at) & (F.col("place") <= at + self.chunk)).orderBy("place").collect()
            rows = []
            for r in part:
                spec = self.service.tables[r["table_id"]]
                rows.append({"schema": spec.namespace, "table": spec.name, "key": {spec.key: r["key_text"]}, "op": {1: "INSERT", 2: "UPDATE", 3: "DELETE"}[r["op"]], "base_row_version": r["base_row_version"], "payload": None if r["payload"] is None else json.loads(r["payload"])})
            self.transfers["push_chunks"] += 1
            self.service.upload_push_chunk(me.user, push_id, at, rows)
        return self.service.commit_push_session(me.user, push_id)

    def _frame(self, me: Follower, rows: list[dict]) -> DataFrame:
        """Wire rows as log rows."""
        plain = [(me.user, r["row_version"], n, self._id(f"{r['schema']}.{r['table']}"), next(iter(r["key"].values())), {"INSERT": 1, "UPDATE": 2, "DELETE": 3}[r["op"]], None if r["payload"] is None else canonical.render(_floats(r["payload"]))) for n, r in enumerate(rows, 1)]
        return self.spark.createDataFrame(plain, "user_pk string, bundle_seq long, row_ordinal long, table_id int, key_text string, op_code int, payload string")

    def _replay(self, me: Follower, header: dict, frozen: int, number: int) -> None:
        if header["status"] == "no_effects":
            self._save(sent=frozen, next_source_bundle_id=number)
            return
        rows, after, more = [], -1, True
        while more:
            self.transfers["committed_chunks"] += 1
            page = self.service.committed_bundle_rows(me.user, header["bundle_seq"], after, self.chunk)
            rows += page["rows"]
            after, more = page["next_row_ordinal"], page["has_more"]
        log = self._frame(me, rows)
        if bundles.headers(log, self.service.names()).first()["bundle_hash"] != header["bundle_hash"]:
            raise SyncError("committed_bundle_hash_mismatch")
        # edits made since the freeze stay edits; their base moves to the committed version by itself
        state = cut(follower.apply(self.state(), log), "state")
        self._save(replace(me.replayed(header["bundle_seq"]), dirty=0), replace_={"state": state}, sent=frozen, next_source_bundle_id=number + 1, initialization_id=None)

    def _resolve(self, conflict: dict) -> None:
        """One conflicting row: the server's version becomes the row's state; then its edit is dropped, kept or merged."""
        answer = self.resolver(conflict)
        result, merged = answer if isinstance(answer, tuple) else (answer, None)
        missing = conflict["server_row_version"] == 0
        one = self.spark.createDataFrame([(result, conflict["op"], None if missing else conflict["server_row_version"], conflict["server_row_deleted"])], "result string, op int, version long, deleted boolean")
        plan = one.select(conflicts.resolution(*map(F.col, ("result", "op", "version", "deleted")))).first()[0]
        if plan in ("error", "invalid"):
            raise SyncError("invalid_conflict_resolution", conflict=conflict, result=result)
        key = (F.col("table_id") == conflict["table_id"]) & (F.col("key_text") == conflict["key_text"])
        others = self.state().filter(~key)
        user = self.store.latest().info["me"]["user"]
        known = [] if missing else [(user, conflict["table_id"], conflict["key_text"], conflict["server_row_version"], conflict["server_row_deleted"], conflict["server_row"])]
        state = cut(others.unionByName(self.spark.createDataFrame(known, ROWS)), "state")
        edits = self._table("edits", EDITS)
        info = {}
        if plan in ("apply_server_row", "apply_delete", "drop_local", "drop_state", "keep_deleted"):
            edits = edits.filter(~key)
        elif plan.endswith("merged"):
            spec = self.service.tables[conflict["table_id"]]
            if merged is None or set(merged) != {c for c in spec.schema.names if c != "_sync_scope_id"}:
                raise SyncError("invalid_conflict_resolution", conflict=conflict, result=result)
            info["ord"] = self.store.latest().info.get("ord", 0) + 1
            edits = edits.unionByName(self.spark.createDataFrame([(info["ord"], user, conflict["table_id"], conflict["key_text"], 2, canonical.render(_floats(merged)))], EDITS))
        self._save(replace_={"state": state, "edits": cut(edits, "edits")}, **info)

    # --- pull ------------------------------------------------------------------------------------------------------

    @_alone
    def pull_to_stable(self, max_bundles: int | None = None) -> str:
        """Bundles up to the ceiling of the first page; `rebuilt` if the log no longer reaches back.

        `skipped_paused` while downloads are paused.
        """
        if self.downloads_paused.is_set():
            return "skipped_paused"
        me = self.me
        me.may("pull")
        target = 0
        while True:
            try:
                page = self.service.pull(me.user, me.last_seen, max_bundles, target)
            except SyncError as e:
                if e.code != "history_pruned":
                    raise
                return self.rebuild()
            target = page["stable_bundle_seq"]
            if not page["bundles"]:
                return "up_to_date"
            rows = [r for b in page["bundles"] for r in b["rows"]]
            numbers = [b["bundle_seq"] for b in page["bundles"]]
            if numbers != sorted(set(numbers)) or numbers[-1] > target or numbers[0] <= me.last_seen:
                raise SyncError("invalid_pull_response")
            state = cut(follower.apply(self.state(), self._frame(me, rows)), "state")
            me = replace(me, last_seen=numbers[-1], dirty=0)
            self._save(me, replace_={"state": state})
            if not page["has_more"]:
                return "pulled"

    @_alone
    def rebuild(self, keep_edits: bool = False, replace_source: str | None = None) -> str:
        """State from a snapshot. A rotated source (reason: its history is gone) starts a new sequence."""
        me = self.me
        if not keep_edits and not replace_source:
            me.may("rebuild")
        rotation = None if not replace_source else (me.source, replace_source, "history_pruned")
        self.transfers["snapshot_sessions"] += 1
        session = self.service.create_snapshot_session(me.user, replace_source=rotation)
        snap = self.service.snapshot_frame(me.user, session["snapshot_id"])
        found = snap.select("user_pk", "table_id", "key_text", F.col("row_version").alias("bundle_seq"), F.lit(False).alias("deleted"), "payload")
        if found.count() != session["row_count"]:
            raise SyncError("snapshot_row_count_mismatch")
        info = {"next_source_bundle_id": 1} if replace_source else {}
        self._save(replace(me, last_seen=session["snapshot_bundle_seq"], rebuild_required=False, recovery_required=False, dirty=0, source=replace_source or me.source), replace_={"state": found}, **info)
        self.service.delete_snapshot_session(me.user, session["snapshot_id"])
        return "rebuilt"

    @_alone
    def sync(self) -> tuple[str, str]:
        return self.push_pending(), self.pull_to_stable()

    # --- background ------------------------------------------------------------------------------------------------

    def pause_uploads(self) -> None:
        self.uploads_paused.set()

    def resume_uploads(self) -> None:
        self.uploads_paused.clear()

    def pause_downloads(self) -> None:
        self.downloads_paused.set()

    def resume_downloads(self) -> None:
        self.downloads_paused.clear()

    def _upload_step(self) -> bool:
        self.push_pending()
        return False

    def _download_step(self) -> bool:
        return self.pull_to_stable() in ("pulled", "rebuilt")

    def _watch_step(self, fallback: float) -> bool:
        """Wait for a notice, then pull; pull as well if none came in time, as notices may be lost."""
        if self._notices is None:
            me = Follower(**self.store.latest().info["me"])
            me.may("watch")
            self._notices = self.service.subscribe(me.user, me.last_seen)
        notice = self._notices.wait(fallback)
        if not self._stop.is_set():
            try:
                self.pull_to_stable()
            except Exception:
                # what was told is not there yet: the next subscription tells it again
                self._unsubscribe()
                raise
        return notice is not None

    def _unsubscribe(self) -> None:
        notices, self._notices = self._notices, None
        if notices:
            notices.close()

    def start(self, watch: bool = True, least: float = loops.LEAST, most: float = loops.MOST, fallback: float = loops.FALLBACK) -> None:
        """Push and pull in the background until stop(). With `watch`, pulls follow the service's notices."""
        if self._threads:
            raise SyncError("already_started")
        self._stop.clear()
        download = (lambda: self._watch_step(fallback)) if watch else self._download_step
        self.loops = {"upload": loops.Loop(self._upload_step, self.uploads_paused, least, most), "download": loops.Loop(download, self.downloads_paused, least, most)}
        self._threads = [threading.Thread(target=x.run, args=(self._stop,), name=name, daemon=True) for name, x in self.loops.items()]
        for thread in self._threads:
            thread.start()

    def stop(self) -> None:
        """Ends the loops after what they are at."""
        self._stop.set()
        self._unsubscribe()
        for thread in self._threads:
            thread.join()
        self._unsubscribe()
        self._threads = []

    # --- reports ---------------------------------------------------------------------------------------------------

    def pending_sync_status(self) -> dict:
        n = self.pending().count()
        return {"has_pending_sync_data": n > 0, "pending_row_count": n, "blocks_detach": n > 0}

    def sync_status(self) -> dict:
        me = self.me
        live = self.state().filter("NOT deleted").count()
        one = self.spark.range(1).select(status.authority(F.lit(me.last_seen > 0), F.lit(me.dirty), F.lit(live)))
        return {"authority": one.first()[0], "last_bundle_seq_seen": me.last_seen} | self.pending_sync_status()

    def transfer_diagnostics(self, reset: bool = False) -> dict:
        """How many sessions were created and chunks moved since the client was made, or since the last reset."""
        names = ("push_sessions", "push_chunks", "committed_chunks", "snapshot_sessions")
        found = {name: self.transfers[name] for name in names}
        if reset:
            self.transfers.clear()
        return found

    def source_info(self) -> dict:
        info = self.store.latest().info
        return {"source_id": info["me"]["source"], "next_source_bundle_id": info["next_source_bundle_id"], "rebuild_required": info["me"]["rebuild_required"]}
