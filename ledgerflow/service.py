"""The authority over scopes: sessions, commits, pull, snapshots and status on a versioned store.

One store for each scope, so that commits of a scope are serial (the manifest of
the next version can be written once) and scopes do not meet. A scope's store
holds its log, bundle headers and current rows; its manifest holds the latest
bundle number, the retention floor, the lifecycle state and the sources.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from copy import deepcopy
from dataclasses import asdict
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerflow import metrics
from ledgerflow.functions import canonical
from ledgerflow.operators import bundles, conflicts, follower, paging, snapshots
from ledgerflow.plans import lifecycle
from ledgerflow.plans.lifecycle import SyncError
from ledgerflow.runtime import cut
from ledgerflow.sources import specs
from ledgerflow.sources.store import Store, Version
from ledgerflow.streaming.loops import Hub, Subscription

LOG = "user_pk string, bundle_seq long, row_ordinal long, table_id int, key_text string, op_code int, payload string"
HEADERS = "user_pk string, bundle_seq long, row_count long, byte_count long, bundle_hash string, source_id string, source_bundle_id long"
ROWS = "user_pk string, table_id int, key_text string, bundle_seq long, deleted boolean, payload string"
EVENTS = "ord long, user_pk string, txid long, table_id int, key_text string, op int, payload string"


class Service:
    def __init__(self, spark: SparkSession, root: str, tables: list[specs.TableSpec], clock: Callable[[], float] = time.time, retained: int = paging.RETAINED, prune_batch: int = paging.PRUNE_BATCH, recorder: metrics.Recorder | None = None):
        for table in tables:
            specs.check(table)
        if wrong := specs.check_foreign_keys(tables):
            raise specs.SpecError("; ".join(wrong))
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.tables = {k: t for k, t in enumerate(sorted(tables, key=lambda t: t.full_name), 1)}
        self.table_ids = {t.full_name: k for k, t in self.tables.items()}
        self.capabilities = lifecycle.Capabilities(retained_bundles=retained)
        self.retained, self.prune_batch = retained, prune_batch
        self._pushes: dict[str, lifecycle.PushSession] = {}
        self._snapshots: dict[str, tuple[str, DataFrame, float]] = {}
        self.hub, self.recorder = Hub(), recorder
        self._running = True

    # --- state of a scope ------------------------------------------------------------------------------------------

    def _store(self, actor: str) -> Store:
        if not self._running:
            raise SyncError("service_unavailable", 503)
        if not actor:
            raise SyncError("unauthorized", 401)
        return Store(self.spark, f"{self.root}/{quote(actor, safe='')}")

    def _scope(self, version: Version) -> lifecycle.Scope:
        return lifecycle.expire(lifecycle.Scope(**version.info.get("scope", {})), self.clock())

    @staticmethod
    def _sources(version: Version) -> lifecycle.Sources:
        return lifecycle.Sources(**deepcopy(version.info.get("sources", {})))

    def _ready(self, actor: str) -> tuple[Store, Version]:
        store = self._store(actor)
        version = store.latest()
        state = self._scope(version).state
        if state != "INITIALIZED":
            raise SyncError(f"scope_{state.lower()}")
        return store, version

    def _read(self, store: Store, version: Version, table: str, schema: str) -> DataFrame:
        found = store.read(table, version)
        return self.spark.createDataFrame([], schema) if found is None else found

    def names(self) -> dict[int, tuple[str, str, str]]:
        """What hashes name the tables by."""
        return {k: (t.namespace, t.name, t.key) for k, t in self.tables.items()}

    def stop(self) -> None:
        self._running = False

    # --- connect ---------------------------------------------------------------------------------------------------

    def connect(self, actor: str, source: str, has_local_pending_rows: bool) -> dict:
        if not source:
            raise SyncError("connect_invalid", 400)
        store = self._store(actor)
        version = store.latest()
        before = self._scope(version)
        scope, told = lifecycle.connect(before, source, has_local_pending_rows, self.clock())
        if scope != lifecycle.Scope(**version.info.get("scope", {})):
            store.commit(version, info={"scope": asdict(scope)})
        return told

    # --- push ------------------------------------------------------------------------------------------------------

    def create_push_session(self, actor: str, source: str, source_bundle_id: int, planned_rows: int, initialization_id: str | None = None) -> dict:
        if planned_rows < 1 or source_bundle_id < 1:
            raise SyncError("push_session_invalid", 400)
        store = self._store(actor)
        version = store.latest()
        scope = self._scope(version)
        if scope.state == "INITIALIZING":
            lifecycle.require_lease(scope, initialization_id or "", self.clock())
        elif scope.state != "INITIALIZED":
            raise SyncError("scope_uninitialized")
        known = self._read(store, version, "headers", HEADERS).filter((F.col("source_id") == source) & (F.col("source_bundle_id") == source_bundle_id)).first()
        if known:
            return {"status": "already_committed"} | known.asDict()
        expected = self._sources(version).next_id(source)
        if source_bundle_id != expected:
            raise SyncError("history_pruned" if source_bundle_id < expected else "source_sequence_out_of_order", expected=expected)
        push_id = str(uuid.uuid4())
        self._pushes[push_id] = lifecycle.PushSession(actor, source, source_bundle_id, planned_rows, self.clock() + self.capabilities.session_seconds)
        return {"status": "staging", "push_id": push_id, "next_expected_row_ordinal": 0}

    def _push(self, push_id: str) -> lifecycle.PushSession:
        if push_id not in self._pushes:
            raise SyncError("push_session_not_found", 404)
        return self._pushes[push_id]

    def upload_push_chunk(self, actor: str, push_id: str, start: int, rows: list[dict]) -> int:
        session = self._push(push_id)
        if rows and len(rows) <= self.capabilities.max_rows_per_chunk:
            plain = [(k, r.get("schema"), r.get("table"), r.get("op"), next(iter((r.get("key") or {}).values()), None), None if r.get("payload") is None else canonical.render(_floats(r["payload"]))) for k, r in enumerate(rows)]
            staged = conflicts.normalized(self.spark.createDataFrame(plain, "ord int, schema string, table string, op string, key string, payload string"))
            again = conflicts.repeated_targets(staged, ["schema", "table", "key"])
            registered = F.concat_ws(".", "schema", "table").isin(*self.table_ids)
            kinds = {name: [f.name for f in self.tables[k].schema if isinstance(f.dataType, T.BinaryType)] for name, k in self.table_ids.items()}
            full = F.concat_ws(".", "schema", "table")
            uuids = full.isin(*(n for n, k in self.table_ids.items() if self.tables[k].key_kind == "uuid"))
            binary = F.coalesce(*(F.when(full == n, F.array(*map(F.lit, c)).cast("array<string>")) for n, c in kinds.items()))
            reason = conflicts.rejection(registered, F.col("schema"), F.col("table"), F.col("op"), F.col("key"), F.col("payload"), F.col("times").isNotNull(), uuid_key=uuids, binary=binary)
            checked = staged.join(again, ["schema", "table", "key"], "left").withColumn("reason", reason)
            if bad := checked.filter("reason IS NOT NULL").orderBy("ord").first():
                raise SyncError("push_chunk_invalid", 400, ordinal=start + bad["ord"], reason=bad["reason"])
            good = checked.orderBy("ord").collect()
            rows = [{"schema": g["schema"], "table": g["table"], "key": g["key"], "op": g["op"], "base_row_version": int(r.get("base_row_version") or 0), "payload": g["payload"]} for g, r in zip(good, rows)]
        return session.upload(actor, start, rows, self.clock(), self.capabilities.max_rows_per_chunk)

    def commit_push_session(self, actor: str, push_id: str) -> dict:
        session = self._push(push_id)
        staged = session.committable(actor, self.clock())
        store = self._store(actor)
        version = store.latest()
        if self._sources(version).next_id(session.source) != session.source_bundle_id:
            raise SyncError("source_sequence_changed")
        plain = [(actor, push_id, k, self.table_ids[f"{r['schema']}.{r['table']}"], r["key"], {"INSERT": 1, "UPDATE": 2, "DELETE": 3}[r["op"]], r["base_row_version"], r["payload"]) for k, r in enumerate(staged)]
        requests = self.spark.createDataFrame(plain, "user_pk string, push_id string, req_ordinal long, table_id int, key_text string, op int, base_row_version long, payload string")
        rows = self._read(store, version, "rows", ROWS)
        judged = conflicts.judged(requests, rows.drop("payload"))
        if not judged.filter("verdict <> 'ok'").isEmpty():
            first = conflicts.first_conflicts(judged, rows.filter("NOT deleted")).first().asDict()
            raise SyncError("push_conflict", conflict=first | {"table": self.tables[first["table_id"]].full_name})
        events = requests.selectExpr("req_ordinal AS ord", "user_pk", "0L AS txid", "table_id", "key_text", "op", "payload")
        done = self._commit(store, version, actor, events, session.source, session.source_bundle_id)
        del self._pushes[push_id]
        return done

    def delete_push_session(self, actor: str, push_id: str) -> None:
        if self._push(push_id).scope != actor:
            raise SyncError("push_session_forbidden", 403)
        del self._pushes[push_id]

    # --- commits ---------------------------------------------------------------------------------------------------

    def within_bundle(self, actor: str, source: str, source_bundle_id: int, write: Callable[[DataFrame], DataFrame]) -> dict:
        """A server-side write: `write` maps current rows to change events (EVENTS). Nothing changed takes no number."""
        store, version = self._ready(actor)
        if self._sources(version).commit(source, source_bundle_id) != "committed":
            return {"status": "already_committed"}
        return self._commit(store, version, actor, write(self._read(store, version, "rows", ROWS)), source, source_bundle_id)

    def exec_write(self, actor: str, write: Callable[[DataFrame], DataFrame], source: str = "server") -> dict:
        """within_bundle() that initializes the scope if need be and takes the source's next number."""
        store = self._store(actor)
        version = store.latest()
        if self._scope(version).state == "UNINITIALIZED":
            self.connect(actor, source, False)
            version = store.latest()
        return self.within_bundle(actor, source, self._sources(version).next_id(source), write)

    def _commit(self, store: Store, version: Version, actor: str, events: DataFrame, source: str, source_bundle_id: int) -> dict:
        rows = self._read(store, version, "rows", ROWS)
        # hashes are of canonical payloads
        with metrics.stage(self.recorder, "commit", "cascade"):
            events = self._with_cascades(events.withColumn("payload", canonical.canonical("payload")), rows, actor)
        latest, floor = version.marks.get("seq", 0), version.info.get("floor", 0)
        with metrics.stage(self.recorder, "commit", "fold") as timing:
            log = cut(bundles.number(bundles.net(bundles.fold(events))).withColumn("bundle_seq", F.col("bundle_seq") + latest), "commit")
            timing.count = log.count()
        if not timing.count:
            return {"status": "no_effects", "bundle_seq": latest}
        after = follower.apply(rows, log)
        with metrics.stage(self.recorder, "commit", "references"):
            self._check_references(after)
        header = bundles.headers(log, self.names()).withColumns({"source_id": F.lit(source), "source_bundle_id": F.lit(source_bundle_id).cast("long")})
        sources = self._sources(version)
        sources.commit(source, source_bundle_id)
        target = max(0, latest + 1 - self.retained)
        new_floor = min(target, floor + self.prune_batch) if target > floor else floor
        info = {"sources": asdict(sources), "scope": asdict(lifecycle.initialized(self._scope(version))), "floor": new_floor}
        kept = {}
        if new_floor > floor:
            keep = lambda name, schema, more: self._read(store, version, name, schema).filter(F.col("bundle_seq") > new_floor).unionByName(more)
            kept = {"log": keep("log", LOG, log), "headers": keep("headers", HEADERS, header)}
        with metrics.stage(self.recorder, "commit", "write") as written:
            written.count = timing.count
            done = store.commit(version, append={} if kept else {"log": log, "headers": header}, replace={"rows": after, **kept}, marks={"seq": latest + 1}, info=info)
        self.hub.publish(actor, latest + 1)
        return {"status": "committed"} | self._read(store, done, "headers", HEADERS).filter(F.col("bundle_seq") == latest + 1).first().asDict()

    def _references(self):
        for child_id, spec in self.tables.items():
            for key in spec.foreign_keys:
                yield child_id, self.table_ids[key.parent], key.columns[1], key.on_delete

    def _with_cascades(self, events: DataFrame, rows: DataFrame, actor: str) -> DataFrame:
        """Deletes bring the deletes, or nulls, of rows that refer to what they delete; round by round until none is new."""
        # staged payloads count as the rows' contents
        now = follower.apply(rows, bundles.number(bundles.net(bundles.fold(events))).withColumn("bundle_seq", F.lit(1 << 60)))
        last, front, step = events, cut(now.filter("deleted").select("table_id", F.col("key_text").alias("gone")).join(events.select("table_id", F.col("key_text").alias("gone")).distinct(), ["table_id", "gone"]), "cascade"), 0
        taken = front
        while not front.isEmpty():
            step += 1
            found = []
            for child, parent, column, action in self._references():
                if action not in ("CASCADE", "SET NULL"):
                    continue
                hit = now.filter((F.col("table_id") == child) & ~F.col("deleted")).join(front.filter(F.col("table_id") == parent).select("gone"), F.get_json_object("payload", f"$.{column}") == F.col("gone"), "left_semi")
                cleared = canonical.with_null(F.col("payload"), column)
                found.append(hit.select(F.lit((1 << 40) * step).cast("long").alias("ord"), F.lit(actor).alias("user_pk"), F.lit(0).cast("long").alias("txid"), "table_id", "key_text", F.lit(3 if action == "CASCADE" else 2).alias("op"), (F.lit(None).cast("string") if action == "CASCADE" else cleared).alias("payload")))
            if not found:
                break
            more = found[0]
            for x in found[1:]:
                more = more.unionByName(x)
            more = cut(more.join(taken.withColumnRenamed("gone", "key_text"), ["table_id", "key_text"], "left_anti").dropDuplicates(["table_id", "key_text", "op"]), "cascade")
            last = last.unionByName(more.select(*last.columns))
            front = more.filter("op = 3").select("table_id", F.col("key_text").alias("gone"))
            taken = cut(taken.union(front), "cascade")
        return last

    def _check_references(self, rows: DataFrame) -> None:
        """Foreign keys are looked at when the bundle is whole, as deferred constraints are."""
        live = rows.filter("NOT deleted")
        for child, parent, column, _ in self._references():
            reference = F.get_json_object("payload", f"$.{column}")
            open_ = live.filter((F.col("table_id") == child) & reference.isNotNull()).select("user_pk", reference.alias("parent_key")).join(live.filter(F.col("table_id") == parent).select("user_pk", F.col("key_text").alias("parent_key")), ["user_pk", "parent_key"], "left_anti")
            if bad := open_.first():
                raise SyncError("foreign_key_violation", table=self.tables[child].full_name, column=column, key=bad["parent_key"])

    # --- reading ---------------------------------------------------------------------------------------------------

    def _wire(self, rows: list) -> list[dict]:
        out = []
        for r in rows:
            spec = self.tables[r["table_id"]]
            out.append({"schema": spec.namespace, "table": spec.name, "key": {spec.key: r["key_text"]}, "op": {1: "INSERT", 2: "UPDATE", 3: "DELETE"}[r["op_code"]], "row_version": r["bundle_seq"], "payload": None if r["payload"] is None else json.loads(r["payload"])})
        return out

    def committed_bundle_rows(self, actor: str, bundle_seq: int, after: int = -1, max_rows: int | None = None) -> dict:
        """Rows of a bundle behind the logical ordinal `after` (ordinals count from 0 here)."""
        store, version = self._ready(actor)
        if 0 < bundle_seq <= version.info.get("floor", 0):
            raise SyncError("history_pruned")
        header = self._read(store, version, "headers", HEADERS).filter(F.col("bundle_seq") == bundle_seq).first()
        if not header:
            raise SyncError("committed_bundle_not_found", 404)
        n = paging.page_size(max_rows, paging.ROWS_DEFAULT, paging.ROWS_MAX)
        found = paging.keyset_page(self._read(store, version, "log", LOG).filter(F.col("bundle_seq") == bundle_seq), "row_ordinal", after + 1, n).collect()
        return header.asDict() | {"rows": self._wire(found[:n]), "next_row_ordinal": after + len(found[:n]), "has_more": len(found) > n}

    def pull(self, actor: str, after: int = 0, max_bundles: int | None = None, target: int = 0) -> dict:
        store, version = self._ready(actor)
        if after < 0 or target < 0:
            raise SyncError("invalid_request", 400)
        try:
            page = paging.pull(self._read(store, version, "log", LOG), actor, after, version.marks.get("seq", 0), version.info.get("floor", 0), max_bundles, target)
        except paging.HistoryPruned as e:
            raise SyncError("history_pruned", floor=version.info.get("floor", 0)) from e
        headers = {h["bundle_seq"]: h.asDict() for h in self._read(store, version, "headers", HEADERS).filter(F.col("bundle_seq").between(after + 1, page.next_after)).collect()}
        grouped: dict[int, list] = {}
        for r in page.rows.collect():
            grouped.setdefault(r["bundle_seq"], []).append(r)
        return {"stable_bundle_seq": page.stable, "bundles": [headers[s] | {"rows": self._wire(grouped[s])} for s in sorted(grouped)], "has_more": page.has_more}

    def watch(self, actor: str, after: int = 0) -> dict | None:
        """A notice if there is something newer than `after`."""
        _, version = self._ready(actor)
        latest = version.marks.get("seq", 0)
        return {"bundle_seq": latest} if latest > after else None

    def subscribe(self, actor: str, after: int = 0) -> Subscription:
        """Notices of bundles above `after`; those there are already come at once."""
        one = self.hub.join(actor, after)
        try:
            one.offer(self._ready(actor)[1].marks.get("seq", 0))
        except SyncError:
            one.close()
            raise
        return one

    def create_snapshot_session(self, actor: str, max_rows: int = 0, replace_source: tuple[str, str, str] | None = None) -> dict:
        store, version = self._ready(actor)
        if replace_source:
            sources = self._sources(version)
            sources.rotate(*replace_source)
            version = store.commit(version, info={"sources": asdict(sources)})
        rows = self._read(store, version, "rows", ROWS)
        with metrics.stage(self.recorder, "snapshot", "materialize"):
            snap = cut(snapshots.materialize(rows.filter("NOT deleted").select("user_pk", "table_id", "key_text", "payload"), rows.drop("payload")), "snapshot")
        sizes = snapshots.within_limits(snap, max_rows).first()
        snapshot_id = str(uuid.uuid4())
        self._snapshots[snapshot_id] = (actor, snap, self.clock() + self.capabilities.session_seconds)
        return {"snapshot_id": snapshot_id, "snapshot_bundle_seq": version.marks.get("seq", 0), "row_count": sizes["row_count"] if sizes else 0, "byte_count": sizes["byte_count"] if sizes else 0}

    def _snapshot(self, actor: str, snapshot_id: str) -> DataFrame:
        if snapshot_id not in self._snapshots:
            raise SyncError("snapshot_session_not_found", 404)
        owner, snap, until = self._snapshots[snapshot_id]
        if owner != actor:
            raise SyncError("snapshot_session_forbidden", 403)
        if self.clock() >= until:
            raise SyncError("snapshot_session_expired", 410)
        return snap

    def snapshot_frame(self, actor: str, snapshot_id: str) -> DataFrame:
        """The whole snapshot as a table, for followers that run on Spark."""
        return self._snapshot(actor, snapshot_id)

    def snapshot_chunk(self, actor: str, snapshot_id: str, after: int = 0, max_rows: int | None = None) -> dict:
        n = paging.page_size(max_rows, paging.ROWS_DEFAULT, paging.ROWS_MAX)
        found = paging.keyset_page(self._snapshot(actor, snapshot_id), "snapshot_ordinal", after, n).collect()
        rows = [{k: v for k, v in w.items() if k != "op"} for w in self._wire([r.asDict() | {"op_code": 1, "bundle_seq": r["row_version"]} for r in found[:n]])]
        return {"rows": rows, "next_row_ordinal": found[:n][-1]["snapshot_ordinal"] if found else after, "has_more": len(found) > n}

    def delete_snapshot_session(self, actor: str, snapshot_id: str) -> None:
        self._snapshot(actor, snapshot_id)
        del self._snapshots[snapshot_id]

    def status(self, actor: str) -> dict:
        store = self._store(actor)
        version = store.latest()
        rows = self._read(store, version, "rows", ROWS).agg(F.count_if(~F.col("deleted")).alias("live_rows"), F.count_if(F.col("deleted")).alias("tombstones")).first()
        return {"state": self._scope(version).state, "latest_bundle_seq": version.marks.get("seq", 0), "retained_floor": version.info.get("floor", 0)} | rows.asDict()


def _floats(value):
    """JSON numbers are doubles."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, dict):
        return {k: _floats(v) for k, v in value.items()}
    return [_floats(v) for v in value]
