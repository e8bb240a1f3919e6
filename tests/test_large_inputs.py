"""Inputs whose parts depend on each other, read and joined in parallel."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pelagia.operators import tracks
from pelagia.sources import lines, meshes


def grid_file(path, elevation, flow):
    """A fort.14 file of one triangle and boundary segments [(nodes, code)]."""
    out = ["grid", "1 3", *(f"{k} {k} 0 1" for k in (1, 2, 3)), "1 3 1 2 3"]
    for segments in (elevation, flow):
        out += [f"{len(segments)} ! segments", str(sum(len(n) for n, _ in segments))]
        for nodes, code in segments:
            out += [f"{len(nodes)} {code}" if code is not None else str(len(nodes)), *map(str, nodes)]
    path.write_text("\n".join(out) + "\n")


def test_ten_thousand_segments(spark, tmp_path):
    elevation = [([(k * 7 + j) % 3 + 1 for j in range(k % 4 + 1)], None) for k in range(10_000)]
    flow = [([1, 2], 20), ([3], 22), ([], 0), ([2, 2, 2], 0)]
    grid_file(tmp_path / "g", elevation, flow)
    got = meshes.read_grid(spark, str(tmp_path / "g"))["boundaries"]
    want = {(kind, s, k, n - 1, code or 0) for kind, part in (("elevation", elevation), ("flow", flow)) for s, (nodes, code) in enumerate(part) for k, n in enumerate(nodes)}
    assert {tuple(r) for r in got.collect()} == want
    totals = meshes.boundary_totals(got).first()
    assert (totals["nvel"], totals["nflux"]) == (6, 1)


def test_broken_outlines(spark, tmp_path):
    grid_file(tmp_path / "g", [([1, 2], None)], [])
    text = (tmp_path / "g").read_text()
    (tmp_path / "bad").write_text(text.replace("1 ! segments\n2", "1 ! segments\n3"))
    with pytest.raises(ValueError, match="elevation boundaries have 2 nodes, not 3"):
        meshes.read_grid(spark, str(tmp_path / "bad"))
    (tmp_path / "none").write_text("\n".join(text.split("\n")[:6]) + "\n")
    assert meshes.read_grid(spark, str(tmp_path / "none"))["boundaries"].count() == 0


def test_lists_are_followed(spark):
    steps = [3, 7, 1, 9, 2, 4]
    nexts = spark.createDataFrame([*zip(steps, [*steps[1:], 5], strict=True), (8, 3)], "at long, next long")
    for n in (0, 1, 2, 5, 7):
        got = {r["rank"]: r["at"] for r in lines.followed(nexts, 3, n).collect()}
        assert got == dict(enumerate([*steps, 5][:n]))
    assert lines.followed(nexts, 3, 50).count() == 7 and lines.followed(nexts, 99, 3).count() == 1


def test_fields_of_storms_within_reach(spark):
    t0 = datetime(2020, 1, 1)
    rows = [(s, t0 + timedelta(hours=6 * k), lat + k, lon + k, 95000.0, 60.0, 40e3) for s, lat, lon in (("a", 20.0, -60.0), ("b", -15.0, 179.0)) for k in range(3)]
    track = spark.createDataFrame(rows, "track string, ts timestamp_ntz, lat double, lon double, mslp double, vmax double, mrd double")
    nodes = spark.range(0, 3600).select(F.col("id").cast("int").alias("node"), ((F.col("id") % 60) * 6.0 - 180).alias("lon"), (F.floor(F.col("id") / 60) * 3.0 - 89).alias("lat"))
    times = track.select("track", "ts")
    whole = {(r["track"], r["ts"], r["node"]): r for r in tracks.cyclone_field(track, nodes, times, block=4).collect()}
    assert len(whole) == 6 * 3600
    near = tracks.cyclone_field(track, nodes, times, reach_m=1.5e6).collect()
    assert 6 < len(near) < 600
    for r in near:
        full = whole[r["track"], r["ts"], r["node"]]
        assert r["pressure"] == full["pressure"] and r["wind_x"] == full["wind_x"]
    kept = {(r["track"], r["ts"], r["node"]) for r in near}
    assert all(r["pressure"] > 101_000 for k, r in whole.items() if k not in kept)
    assert {r["node"] for r in near if r["track"] == "b"} & {k for k in range(3600) if k % 60 == 0}  # beyond the date line


def test_fields_from_a_best_track_file(spark, tmp_path):
    row = "AL, 12, {d}, , BEST, 0, {lat}N, {lon}W, {v}, {p}, HU, 34, NEQ, 1, 1, 1, 1, 1012, 200, 20\n"
    (tmp_path / "b.dat").write_text("".join(row.format(d=f"20050828{6 * k:02d}", lat=240 + 5 * k, lon=870 + 5 * k, v=100, p=930) for k in range(3)))
    nodes = spark.createDataFrame([(1, 24.2, -87.1), (2, 60.0, 0.0)], "node int, lat double, lon double")
    got = tracks.storm_fields(spark, str(tmp_path / "b.dat"), nodes, "3 hours", reach_m=8e5).orderBy("ts").collect()
    assert len(got) == 5 and {r["node"] for r in got} == {1} and got[0]["pressure"] < 97_000 < got[-1]["pressure"]
