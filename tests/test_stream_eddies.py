"""Tracks over a stream equal those over whole tables."""

import math

import pytest
from pyspark.sql import functions as F

from pelagia import units
from pelagia.operators import eddies as ed
from pelagia.plans.views import eddies
from pelagia.streaming.eddies import EddyStream, follow_files
from pelagia.streaming.tracks import advance


def copies(spark, n_bins):
    """The table's eddies in many regions far from each other."""
    e = eddies(spark, "/root/testdata/sf0.01").where("eddy % 41 < 3 and abs(lat) < 49")
    turn = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return turn.select("snapshot", "sign", (F.col("eddy") * 100 + F.col("k")).alias("eddy"), (F.col("lon") + 5 * F.col("k")).alias("lon"), "lat", "amplitude", "radius_e")


def test_stream_equals_batch_out_of_order_and_is_flushed(spark, tmp_path):
    """Snapshots 1, 0, 2, 4, 3, in a file each, and two lost in one: tracks are those of the whole table, given out when they end and at last."""
    e = copies(spark, 60)
    for t in (1, 0, 2, 4, 3):
        e.where(F.col("snapshot") == t).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    follower = EddyStream(spark, str(tmp_path / "state"), 7.0, delay=1, least=2)
    follower.start(stream).awaitTermination()
    assert [r["snapshot"] for r in follower.steps().orderBy("snapshot").collect()] == [0, 1, 2, 3]
    early = follower.tracks()
    early = early.select("track").distinct().count() if early is not None else 0
    follower.finish()
    batch = ed.track(e, ed.assign(ed.candidates(e, 7.0)))
    want = {(r["sign"], r["snapshot"], r["eddy"]): (r["n"], r["track"]) for r in batch.collect()}
    assert {(r["sign"], r["snapshot"], r["eddy"]): (r["n"], r["track"]) for r in follower.rows().collect()} == want
    long = {(r["track"], r["n"]): (r["snapshot"], r["eddy"], r["length"]) for r in batch.where("length >= 2").collect()}
    assert {(r["track"], r["n"]): (r["snapshot"], r["eddy"], r["length"]) for r in follower.tracks().collect()} == long
    assert long and 0 < early <= follower.tracks().select("track").distinct().count()


def test_steps_again_late_snapshots_and_gaps(spark, tmp_path):
    shape = "snapshot int, sign int, eddy long, lon double, lat double, amplitude double, radius_e double"
    at = lambda t, x=10.0: spark.createDataFrame([(t, 1, 7, x, 30.0, 5.0, 5e4), (t, -1, 7, x, 30.0, 5.0, 5e4), (t, 1, 8, None, 30.0, 5.0, 5e4)], shape)
    follower = EddyStream(spark, str(tmp_path / "s"), 7.0)
    follower.batch(at(0), 0)
    follower.batch(at(1), 1)
    follower.batch(at(1), 1)  # a batch that is given again after a failure
    assert follower.rows().count() == 4 and {r["n"] for r in follower.rows().where("snapshot = 1").collect()} == {1}
    with pytest.raises(ValueError, match="came after"):
        follower.batch(at(0), 2)
    follower.batch(at(3), 3)  # snapshot 2 is missing: all end
    assert follower.tracks().select("track", "length", "ended").distinct().count() == 2 and {r["ended"] for r in follower.tracks().collect()} == {3}
    assert {r["n"] for r in follower.rows().where("snapshot = 3").collect()} == {0}
    follower.finish()
    assert follower.tracks().count() == 6 and follower.steps().count() == 3


def test_dated_files_with_detection(spark, tmp_path):
    """Fields of one bump that moves: a file a day, detected one by one, one track; a run that is stopped goes on."""
    def field(day):
        rows = []
        for i in range(40):
            for j in range(30):
                d2 = (i - 15 - 0.5 * day) ** 2 + (j - 14) ** 2
                rows.append((i, j, i * 0.25, 30 + j * 0.25, 20 * math.exp(-d2 / 30), 1.0, 1.0))
        return spark.createDataFrame(rows, "i int, j int, lon double, lat double, sla double, speed double, eke double")

    for day in range(3):
        field(day).coalesce(1).write.parquet(str(tmp_path / f"sla_2020010{day + 1}"))
    limits = ed.Limits(levels=tuple(float(x) for x in range(-20, 21, 2)), least_amplitude=0.5)
    make = lambda: EddyStream(spark, str(tmp_path / "s"), 1.0, detect=lambda df: ed.detect(df, limits))
    files = [str(tmp_path / f"sla_2020010{k}") for k in (3, 1, 2)]
    first = make()
    df = spark.read.parquet(files[1])
    first.step(0, first.detect(df.withColumn("snapshot", F.lit(0))), 0)
    follower = follow_files(make(), files, spark.read.parquet)
    rows = follower.tracks().orderBy("n").collect()
    assert [(r["snapshot"], r["n"], r["sign"]) for r in rows] == [(0, 0, 1), (1, 1, 1), (2, 2, 1)] and len({r["track"] for r in rows}) == 1
    assert all(abs(b["lon"] - a["lon"] - 0.125) < 0.05 for a, b in zip(rows, rows[1:], strict=False))


def test_track_file(spark, tmp_path):
    rows = [(5, 1, 3, 1, 10.0, 20.0, 4.0, 5e4, 0.25, 0.5, 6e4), (5, 0, 2, 1, 10.1, 20.0, 4.0, 5e4, 0.25, 0.5, 6e4)]
    t = spark.createDataFrame(rows, "track long, n long, snapshot int, sign int, lon double, lat double, amplitude double, radius_s double, swirl double, teke double, radius_e double")
    ed.write_tracks(t, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    r = back.where("n = 1").first()
    assert (r["L"], r["U"], r["radius_e"], r["cyc"]) == (50.0, 25.0, 60.0, 1) and units.unit_of(back, "L") == units.km


def test_cursor(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (2, 2.0), (5, 3.0)], "ts int, v double")
    assert sorted(r["v"] for r in advance(df, 4).collect()) == [1.0, 2.0]
    assert advance(df, 0).count() == 0
    assert advance(df, 4).columns == ["ts", "v"]
