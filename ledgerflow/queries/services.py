"""The service end to end, retries, and the event stream's wire form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from ledgerflow.plans import lifecycle
from ledgerflow.queries import base as B, query
from ledgerflow.runtime import shared_folder
from ledgerflow.service import Service
from ledgerflow.sources import specs
from ledgerflow.streaming import watch

_SCHEMA = T.StructType().add(specs.SCOPE, "string").add("id", "string").add("name", "string").add("region", "string")


def service(spark, d):
    """A service that holds the nations, written as one server-side bundle."""
    root = f"{shared_folder(spark).rstrip('/')}/service-{uuid.uuid4().hex}"
    found = Service(spark, root, [specs.TableSpec("nation", "id", _SCHEMA)], clock=lambda: 0.0)
    payload = F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region")))
    nations = B.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.lit("u").alias("user_pk"), F.lit(0).cast("long").alias("txid"), F.lit(1).alias("table_id"), F.col("n_nationkey").cast("string").alias("key_text"), F.lit(1).alias("op"), payload.alias("payload"))
    return found, found.exec_write("u", lambda current: nations)


@query("op_04_server_write", "SELECT 'committed' AS status, CAST(1 AS BIGINT) AS bundle_seq, count(*) AS row_count FROM nation")
def server_write(spark, d):
    _, done = service(spark, d)
    return spark.createDataFrame([(done["status"], done["bundle_seq"], done["row_count"])], "status string, bundle_seq long, row_count long")


@query("snk_03_api_pull", "SELECT CAST(n_nationkey AS VARCHAR) AS key_text, n_name AS name, CAST(1 AS BIGINT) AS row_version FROM nation")
def api_pull(spark, d):
    api, _ = service(spark, d)
    rows = [r for b in api.pull("u")["bundles"] for r in b["rows"]]
    return spark.createDataFrame([(r["key"]["id"], r["payload"]["name"], r["row_version"]) for r in rows], "key_text string, name string, row_version long")


@query("op_10c_snapshot_session", "SELECT CAST(n_nationkey AS VARCHAR) AS key_text, row_number() OVER (ORDER BY encode(CAST(n_nationkey AS VARCHAR))) AS place FROM nation")
def snapshot_session(spark, d):
    api, _ = service(spark, d)
    session, after, rows, more = api.create_snapshot_session("u"), 0, [], True
    while more:
        page = api.snapshot_chunk("u", session["snapshot_id"], after, 7)
        rows += page["rows"]
        after, more = page["next_row_ordinal"], page["has_more"]
    return spark.createDataFrame([(r["key"]["id"], n) for n, r in enumerate(rows, 1)], "key_text string, place long")


@query("op_23_bounded_retry", "SELECT * FROM (VALUES (1, 0.1), (2, 0.2), (3, 0.4)) AS t(attempt, pause)".replace("0.1", "0.1::DOUBLE").replace("0.2", "0.2::DOUBLE").replace("0.4", "0.4::DOUBLE"))
def bounded_retry(spark, d):
    pauses: list[float] = []

    @lifecycle.retrying(attempts=4, sleep=pauses.append, chance=lambda: 0.5)
    def busy():
        raise TimeoutError

    try:
        busy()
    except TimeoutError:
        pass
    return spark.createDataFrame(list(enumerate(pauses, 1)), "attempt int, pause double")


for _name in ("snk_04_change_feed", "str_05_event_frames", "str_06_event_parser"):

    @query(_name, f"WITH {B.LOG} SELECT user_pk, '{{\"bundle_seq\":' || max(bundle_seq) || ',\"source_id\":\"s\",\"source_bundle_id\":' || max(bundle_seq) || '}}' AS data FROM log GROUP BY user_pk")
    def change_feed(spark, d):
        """Notices framed and parsed again; one short row for each scope."""

        def run(frames):
            for f in frames:
                yield f.assign(data=[next(watch.parse_events((": beat\n\n" + watch.frame_event(int(s), "s", int(s))).splitlines()))[1] for s in f["bundle_seq"]])[["user_pk", "data"]]

        return watch.newest(B.log(spark, d)).mapInPandas(run, "user_pk long, data string")
