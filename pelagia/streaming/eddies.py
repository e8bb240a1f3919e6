"""Eddy tracks over a stream of snapshots.

The state is tables in the shared folder of the stream, not a group of one task: each micro-batch is put aside by snapshot, and snapshots that are
due are taken in order. One step detects the eddies of a snapshot, matches them with those of the one before by the batch operators, and
writes, each in a folder of its snapshot, the eddies with their tracks, the tracks that are alive, and all rows of the tracks that have died and
are long enough. A step that is repeated overwrites its folders with the same rows; its last one is the step's own row, which makes it count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import eddies as ed
from ..staging import discard, staged

_LIVE = "sign int, eddy long, lon double, lat double, amplitude double, radius_e double, track long, first int, last int, n long, fresh boolean"


@dataclass
class EddyStream:
    """Follows eddies from one snapshot (an integer) to the next; a missing snapshot ends all tracks.

    ``path`` is a folder that driver and executors share. ``detect`` makes eddies of a snapshot's rows, which are eddies already where it is left out. Snapshots are taken when one that is
    ``delay`` later has come, so that they may come out of order by so much; one that comes after its turn fails the query. Tracks of fewer than ``least`` rows are not given out.
    """

    spark: SparkSession
    path: str
    step_days: float
    detect: Callable[[DataFrame], DataFrame] | None = None
    least: int = 1
    delay: int = 0
    east_m: float = 150e3
    north_m: float = 150e3
    deformation_km: float | None = 40.0

    # -- tables
    def _read(self, name: str) -> DataFrame | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        return self.spark.read.option("basePath", f"{self.path}/{name.split('/')[0]}").parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str, snapshot: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/snapshot={snapshot}")

    def steps(self) -> DataFrame:
        """A row for each snapshot that has been taken: snapshot, batch, n_eddies, n_live, n_ended."""
        return self.spark.read.schema("batch long, n_eddies long, n_live long, n_ended long, snapshot int").parquet(f"{self.path}/steps")

    def _done(self) -> tuple[int | None, int]:
        """The last snapshot and the last micro-batch that were taken."""
        if self._read("steps") is None:
            return None, -1
        newest = self.steps().agg(F.max("snapshot"), F.max("batch")).first()
        return newest[0], newest[1]

    def rows(self) -> DataFrame | None:
        """All eddies so far with ``track``, ``n`` (from 0) and ``first``, the snapshot in which the track began."""
        return self._read("rows")

    def tracks(self) -> DataFrame | None:
        """All rows of the tracks that have ended, with ``length`` and ``ended``, the snapshot in which they were missed."""
        df = self._read("tracks")
        return df.withColumnRenamed("snapshot", "ended").withColumnRenamed("at", "snapshot") if df is not None else None

    # -- input
    def batch(self, df: DataFrame, batch_id: int) -> None:
        """One micro-batch (for ``foreachBatch``)."""
        put = f"{self.path}/pending/batch={batch_id}"
        df.where("snapshot is not null").withColumn("snapshot", F.col("snapshot").cast("int")).write.mode("overwrite").partitionBy("snapshot").parquet(put)
        done, done_batch = self._done()
        seen = [r[0] for r in df.select(F.col("snapshot").cast("int")).where("snapshot is not null").distinct().collect()]  # a few numbers
        late = [t for t in seen if done is not None and t <= done]
        if late and batch_id > done_batch:  # the last batch may come again after a failure
            raise ValueError(f"snapshot {min(late)} came after snapshot {done}")
        self._advance(batch_id, self.delay)

    def _advance(self, batch_id: int, delay: int) -> None:
        pending, (done, _) = self._read("pending"), self._done()
        if pending is None:
            return
        waiting = sorted(r[0] for r in pending.select("snapshot").distinct().collect() if done is None or r[0] > done)  # names of folders
        for t in waiting:
            if t <= waiting[-1] - delay:
                now = pending.where(F.col("snapshot") == t).drop("batch")
                self.step(t, self.detect(now) if self.detect else now, batch_id)

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Follows a stream; ``trigger`` as for ``DataStreamWriter.trigger``."""
        return stream.writeStream.option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).foreachBatch(self.batch).start()

    def finish(self) -> None:
        """Takes what still waits, and ends all tracks: for the end of the data."""
        _, batch_id = self._done()
        self._advance(batch_id, 0)
        done, _ = self._done()
        if done is None:
            return
        live = self._read(f"live/snapshot={done}")
        self._give_out(live.drop("snapshot"), done + 1)
        self._write(live.where("false").drop("snapshot"), "live", done)
        if self._read("pending") is not None:
            discard(self.spark, f"{self.path}/pending")

    # -- one snapshot
    def step(self, t: int, eddies: DataFrame, batch_id: int) -> None:
        """Takes the eddies (sign, eddy, lon, lat, amplitude, radius_e, ...) of snapshot ``t``, later than all before."""
        before, _ = self._done()
        now = staged(eddies.drop("snapshot").withColumns({"sign": F.col("sign").cast("int"), "eddy": F.col("eddy").cast("long")}).where("sign is not null and lat is not null and lon is not null"), "eddies")
        live = self._read(f"live/snapshot={before}").drop("snapshot") if before is not None else self.spark.createDataFrame([], _LIVE)
        old = live.where((F.col("last") == t - 1) & F.lit(before == t - 1))
        shape = ["sign", "eddy", "lon", "lat", "amplitude", "radius_e"]
        both = old.select(F.lit(t - 1).alias("snapshot"), *shape).union(now.select(F.lit(t).alias("snapshot"), *shape))
        links = ed.matches(both, self.step_days, self.east_m, self.north_m, self.deformation_km).select("sign", F.col("old").alias("was"), F.col("new").alias("eddy"))
        known = old.select("sign", F.col("eddy").alias("was"), "track", "first", F.col("n").alias("n_before"))
        born = F.xxhash64("sign", F.lit(t).cast("int"), "eddy")
        named = now.join(links.join(known, ["sign", "was"]), ["sign", "eddy"], "left").select(
            *now.columns, F.coalesce("track", born).alias("track"), F.coalesce("first", F.lit(t)).cast("int").alias("first"), F.coalesce(F.col("n_before") + 1, F.lit(0)).cast("long").alias("n")
        )
        self._write(named, "rows", t)
        named = self._read(f"rows/snapshot={t}").drop("snapshot")
        lost = live.join(named.select("track"), "track", "left_anti")
        alive = named.select(*shape, "track", "first", F.lit(t).alias("last"), "n", F.lit(before is None).alias("fresh"))
        # tracks of the first snapshot are not looked at before the second check
        alive = alive.union(lost.where("fresh").withColumn("fresh", F.lit(False)).select(alive.columns))
        self._write(alive, "live", t)
        n_ended = self._give_out(lost.where("not fresh"), t)
        counts = self.spark.createDataFrame([(batch_id, named.count(), self._read(f"live/snapshot={t}").count(), n_ended)], "batch long, n_eddies long, n_live long, n_ended long").coalesce(1)
        self._write(counts, "steps", t)
        for old_name in ("live",):
            if before is not None:
                discard(self.spark, f"{self.path}/{old_name}/snapshot={before}")

    def _give_out(self, ended: DataFrame, t: int) -> int:
        """Writes all rows of tracks that ended, once; only snapshots in which they lived are read."""
        ended = staged(ended.select("track", "first", "last", (F.col("n") + 1).alias("length")).where(F.col("length") >= self.least), "ended")
        first, last, many = ended.agg(F.min("first"), F.max("last"), F.count("*")).first()
        if many:
            own = self.rows().where(F.col("snapshot").between(first, last)).withColumnRenamed("snapshot", "at")
            self._write(own.join(ended.select("track", "length"), "track"), "tracks", t)
        return many


def follow_files(stream: EddyStream, files: list[str], read: Callable[[str], DataFrame], order: Callable[[str], object] = str, every: int = 1) -> EddyStream:
    """Files, a snapshot each, in the order of ``order`` (such as a date in the name), each ``every``-th one: the batch driver of dated files.

    ``read`` makes a file's field, to which ``stream.detect`` is applied. Files that have been taken are skipped, so a run that was stopped goes on; at the end all tracks are given out.
    """
    done, _ = stream._done()
    for t, file in enumerate(sorted(files, key=order)[::every]):
        if done is None or t > done:
            df = read(file)
            stream.step(t, stream.detect(df.withColumn("snapshot", F.lit(t))) if stream.detect else df, t)
    stream.finish()
    return stream
