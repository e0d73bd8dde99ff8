"""The log as a stream: what a stream gives is what a batch gives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerflow.operators import bundles
from ledgerflow.queries import base as B, query
from ledgerflow.runtime import shared_folder
from ledgerflow.streaming import watch


def _streamed(spark, d, build, mode):
    """Writes the log, streams it file by file through `build`, and returns what the last state of the output is."""
    root = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    log = B.log(spark, d)
    log.withColumn("part", F.col("bundle_seq") % 3).write.partitionBy("part").parquet(f"{root}/log")
    source = watch.log_stream(spark, f"{root}/log", log.schema, files_per_trigger=4)
    outputs = []

    def keep(batch, number):
        # a repeated batch writes the same folder again
        batch.write.mode("overwrite").parquet(f"{root}/out/{number:06d}")
        outputs.append(number)

    running = build(source).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return root, outputs


@query("str_01_newest_per_scope", f"WITH {B.LOG} SELECT user_pk, max(bundle_seq) AS bundle_seq FROM log GROUP BY user_pk")
def newest_per_scope(spark, d):
    root, _ = _streamed(spark, d, watch.newest, "update")
    return spark.read.schema("user_pk long, bundle_seq long").parquet(f"{root}/out/*").groupBy("user_pk").agg(F.max("bundle_seq").alias("bundle_seq"))


@query("str_02_stream_state", f"WITH {B.STATE} SELECT * FROM state")
def stream_state(spark, d):
    root, outputs = _streamed(spark, d, watch.stream_state, "complete")
    return spark.read.parquet(f"{root}/out/{max(outputs):06d}")


@query("str_03_monotone_notices", f"WITH {B.LOG} SELECT user_pk, max(bundle_seq) AS last FROM log GROUP BY user_pk")
def monotone_notices(spark, d):
    root, _ = _streamed(spark, d, watch.monotone, "append")
    return spark.read.schema("user_pk long, bundle_seq long").parquet(f"{root}/out/*").groupBy("user_pk").agg(F.max("bundle_seq").alias("last"))


@query("str_04_subscribe", f"WITH {B.LOG}, k AS (SELECT user_pk, max(bundle_seq) AS bundle_seq FROM log GROUP BY user_pk) SELECT DISTINCT user_id AS subscriber, user_pk, bundle_seq FROM (SELECT DISTINCT user_id, user_id % 16 AS user_pk, user_id % 9 AS after FROM events) JOIN k USING (user_pk) WHERE bundle_seq > after")
def subscribe(spark, d):
    cursors = B.table(spark, d, "events").select("user_id").distinct().selectExpr("user_id AS subscriber", "user_id % 16 AS user_pk", "user_id % 9 AS after")
    return watch.subscribe(watch.newest(B.log(spark, d)), cursors)


@query("str_07_follow_stream", f"WITH {B.STATE} SELECT s.user_pk, s.table_id, s.key_text, s.bundle_seq, s.deleted, l.payload FROM state s JOIN log l USING (user_pk, table_id, key_text, bundle_seq)")
def follow_stream(spark, d):
    """A follower that applies each batch of the stream to its rows, a new version each time."""
    root = f"{shared_folder(spark).rstrip('/')}/follow-{uuid.uuid4().hex}"
    log = B.log(spark, d)
    log.withColumn("part", F.col("bundle_seq") % 3).write.partitionBy("part").parquet(f"{root}/log")
    at = [None]
    schema = "user_pk long, table_id int, key_text string, bundle_seq long, deleted boolean, payload string"

    def read():
        return spark.read.schema(schema).parquet(at[0]) if at[0] else spark.createDataFrame([], schema)

    def write(state, number):
        path = f"{root}/state/{number:06d}"
        state.write.mode("overwrite").parquet(path)
        at[0] = path

    source = watch.log_stream(spark, f"{root}/log", log.schema, files_per_trigger=4)
    source.writeStream.foreachBatch(watch.follow(source, read, write)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return read()


@query("str_09_late_bundles", f"WITH {B.STATE} SELECT s.user_pk, s.table_id, s.key_text, s.bundle_seq, s.deleted FROM state s")
def late_bundles(spark, d):
    """Bundles that arrive late or twice do not turn a row back."""
    log = B.log(spark, d)
    late = bundles.row_state(log.filter("bundle_seq > 3"))
    return bundles.advance(bundles.advance(late, log.filter("bundle_seq <= 3")), log)
