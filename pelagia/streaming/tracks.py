"""Tracks and slab means over streams, with bounded state and late rows cut by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ISLAND = "track long, first_ts timestamp, last_ts timestamp, n_rows long"


def islands(stream: DataFrame, gap_seconds: float, least: int = 1, late: str = "1 hour", track: str = "track", ts: str = "ts") -> DataFrame:
    """Islands of a stream's tracks: one row when an island ends, which is when a later row or the watermark passes its gap.

    The state of a track is its open island: first and last time and a count. Rows that come late but before the watermark
    join the open island if they are within the gap of it; older islands have been given out. Rows without track or time go.
    """
    gap = int(gap_seconds * 1e6)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed: list[tuple[int, int, int]] = []
        if state.hasTimedOut:
            closed.append(state.get)
            state.remove()
        else:
            first, last, n = state.getOption or (None, None, 0)
            times = sorted(int(t) for df in frames for t in df["us"])
            for t in times:
                if first is None:
                    first = last = t
                elif t - last > gap:
                    closed.append((first, last, n))
                    first, last, n = t, t, 0
                n, last, first = n + 1, max(last, t), min(first, t)
            state.update((first, last, n))
            # the timeout is a time after the watermark, or Spark refuses it
            state.setTimeoutTimestamp(max((last + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        rows = [(key[0], pd.Timestamp(a, unit="us", tz="UTC"), pd.Timestamp(b, unit="us", tz="UTC"), n) for a, b, n in closed if n >= least]
        if rows:
            yield pd.DataFrame(rows, columns=["track", "first_ts", "last_ts", "n_rows"])

    timed = stream.select(F.col(track).cast("long").alias("track"), F.col(ts).cast("timestamp").alias("ts")).where("track is not null and ts is not null")
    timed = timed.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("track").applyInPandasWithState(step, ISLAND, "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def slab_means(stream: DataFrame, level: str, value: str, every: str = "1 day", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Mean and number of values per level and time window, given out when the watermark passes the window's end."""
    timed = stream.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    out = timed.groupBy(F.window("__t", every).alias("w"), level).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.select(F.col("w.start").alias("start"), level, "mean", "n")


def advance(snapshots: DataFrame, until, ts: str = "ts") -> DataFrame:
    """The newest snapshot at or before a time: what a cursor that has been moved there shows."""
    newest = snapshots.where(F.col(ts) <= F.lit(until)).agg(F.max(ts).alias(ts))
    return snapshots.join(F.broadcast(newest), ts, "left_semi")  # one row


def drained(spark: SparkSession, frame: DataFrame, path: str) -> DataFrame:
    """Runs a stream over all that its source has now, into a folder, and reads it back.

    Windows and islands that the watermark has not passed at the end of the input stay in the checkpoint beside it,
    where :func:`open_islands` finds the latter.
    """
    query = frame.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)


def open_islands(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """The islands that a stream drained to ``path`` has not given out: with those it has, what a batch over the same rows gives.

    They are read from the stream's state as it is; a stream that goes on from there may still extend them.
    """
    state = spark.read.format("statestore").load(f"{path}-checkpoint")
    own = lambda c: F.col(f"value.groupState.{c}")
    time = lambda c: F.timestamp_micros(own(c))
    return state.where(own("n") >= least).select(F.col("key.track").alias("track"), time("first").alias("first_ts"), time("last").alias("last_ts"), own("n").alias("n_rows"))
