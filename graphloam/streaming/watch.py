"""Continuous indexing: act on a quiet period, never on a version that has been overtaken."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET = "300 milliseconds"


def bursts(events: DataFrame, keys: list[str], ts: str = "ts", quiet: str = QUIET, late: str | None = None) -> DataFrame:
    """keys, start, end, n: runs of events with no quiet period between. Batch and stream alike.

    The end is the last event plus the quiet period: when a build may start. On a stream give
    ``late``: a burst comes out once the watermark has passed its end.
    """
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if late else events
    return rows.groupBy(F.session_window(ts, quiet).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windows(events: DataFrame, keys: list[str], length: str, slide: str | None = None, ts: str = "ts", late: str | None = None) -> DataFrame:
    """keys, start, n over tumbling (or sliding) windows."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, length, slide or length).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def changed_inputs(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change between two snapshots of path, signature: metadata only."""
    from graphloam.operators.change import snapshot_diff

    return snapshot_diff(before, after, "path", "signature")


def latest_revision(attempts: DataFrame, group: str = "path", revision: str = "revision") -> DataFrame:
    """Only the attempt on the newest revision of each group is published; the others are superseded."""
    newest = attempts.groupBy(group).agg(F.max(revision).alias("_newest"))
    return attempts.join(newest, group).withColumn("superseded", F.col(revision) < F.col("_newest")).drop("_newest")


def watch(stream: DataFrame, build: Callable[[DataFrame, int], None], revision: Callable[[], object], checkpoint: str) -> StreamingQuery:
    """Run ``build`` on each micro-batch of changed paths, unless the inputs moved while the batch was made.

    ``revision`` tells the current revision of the inputs. A batch that was overtaken is left
    out: the change that overtook it comes with a later batch.
    """

    def attempt(batch: DataFrame, number: int) -> None:
        before = revision()
        paths = batch.select("path").distinct()
        if paths.isEmpty() or revision() != before:
            return
        build(paths, number)

    return stream.writeStream.foreachBatch(attempt).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_status(events: DataFrame) -> DataFrame:
    """path, commit, stale, errors by key over a stream of (path, kind, commit): kept in state across batches.

    kinds: changed makes stale, indexed sets the commit, failed counts an error.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        commit, stale, errors = state.get if state.exists else ("", True, 0)
        for pdf in frames:
            for kind, value in pdf.sort_values("ts")[["kind", "commit"]].itertuples(index=False):
                if kind == "changed":
                    stale = True
                elif kind == "indexed":
                    commit, stale = value, False
                else:
                    errors += 1
        state.update((commit, stale, errors))
        yield pd.DataFrame({"path": [key[0]], "commit": [commit], "stale": [stale], "errors": [errors]})

    schema = "path string, commit string, stale boolean, errors long"
    return events.groupBy("path").applyInPandasWithState(update, schema, "commit string, stale boolean, errors long", "update", GroupStateTimeout.NoTimeout)
