"""Streams over the append-only bundle log: change notices, catch-up, follower apply, and the event-stream wire form."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerflow.operators import bundles, follower


def log_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """The bundle log as a stream of its files; what was read is remembered by the query's checkpoint."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def newest(log: DataFrame) -> DataFrame:
    """Per scope the newest bundle number; slow readers see only the last of several (update mode)."""
    return log.groupBy("user_pk").agg(F.max("bundle_seq").alias("bundle_seq"))


def monotone(log: DataFrame) -> DataFrame:
    """Notices (user_pk, bundle_seq) of numbers above all that were sent, the last one of each batch and scope; state: the last number."""

    def notify(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent = state.get[0] if state.exists else 0
        top = max((int(f["bundle_seq"].max()) for f in frames if len(f)), default=0)
        if top > sent:
            state.update((top,))
            yield pd.DataFrame({"user_pk": [key[0]], "bundle_seq": [top]})

    return log.select("user_pk", "bundle_seq").groupBy("user_pk").applyInPandasWithState(notify, "user_pk long, bundle_seq long", "last long", "append", GroupStateTimeout.NoTimeout)


def subscribe(known: DataFrame, cursors: DataFrame) -> DataFrame:
    """Notices due at once to subscribers (subscriber, user_pk, after) that are behind."""
    return cursors.join(known, "user_pk").filter(F.col("bundle_seq") > F.col("after")).select("subscriber", "user_pk", "bundle_seq")


def follow(log: DataFrame, read_state: Callable[[], DataFrame], write_state: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that applies bundles to follower rows; a batch that is repeated changes nothing, as versions gate it."""

    def step(batch: DataFrame, number: int) -> None:
        write_state(follower.apply(read_state(), batch), number)

    return step


def fresh_commits(commits: DataFrame) -> DataFrame:
    """Each commit of a source once, however often it is delivered."""
    return commits.dropDuplicates(["user_pk", "source_id", "source_bundle_id"])


def stream_state(log: DataFrame) -> DataFrame:
    """Row state kept by a stream: the same as of a batch over all files read (complete mode)."""
    return bundles.row_state(log)


def frame_event(bundle_seq: int, source: str, source_bundle_id: int) -> str:
    """A notice as a server-sent event; it carries no rows."""
    return f'id: {bundle_seq}\nevent: bundle\ndata: {{"bundle_seq":{bundle_seq},"source_id":"{source}","source_bundle_id":{source_bundle_id}}}\n\n'


def parse_events(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(event, data) of a server-sent stream; comments are skipped, data lines joined; only `bundle` events come through."""
    event, data = "", []
    for line in lines:
        line = line.rstrip("\r\n")
        if not line:
            if event == "bundle" and data:
                yield event, "\n".join(data)
            event, data = "", []
        elif not line.startswith(":"):
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "event":
                event = value
            elif name == "data":
                data.append(value)


def backoff(first: float = 0.1, most: float = 2.0) -> Iterator[float]:
    pause = first
    while True:
        yield pause
        pause = min(most, 2 * pause)
