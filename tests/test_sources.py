"""Readers and writers on small files, mostly as round trips."""

import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia import units
from pelagia.operators import mesh
from pelagia.operators.projections import column_by_name, set_flags
from pelagia.sources import arrays, fields, lines, meshes, parameters, reanalysis, storms


def joined(path):
    """Text of the part files of a folder in order."""
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_numbered_lines_over_splits(spark, tmp_path):
    (tmp_path / "t.txt").write_text("".join(f"row {k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        out = lines.numbered_lines(spark, str(tmp_path / "t.txt"))
        assert out.count() == 5000 and out.where(F.col("value") != F.concat(F.lit("row "), F.col("line"))).count() == 0
        (tmp_path / "m.txt").write_text("\n".join(" ".join(str(k) for k in range(a, a + 7)) for a in range(0, 3500, 7)))
        m = lines.matrix(spark, str(tmp_path / "m.txt"), 50)
        assert m.count() == 3500 and m.where("value <> j * 50 + i").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_grid_round_trip(spark, tmp_path):
    nodes, elements, ring = mesh.square_domain(spark, 4.0, 2)
    nodes = nodes.withColumn("depth", F.col("x") * 0.25 + 3.048)
    b = ring.select(F.when(F.col("segment") == 0, "elevation").otherwise("flow").alias("kind"), F.when(F.col("segment") == 0, 0).otherwise(F.col("segment") - 1).alias("segment"), "seq", "node", F.when(F.col("segment") == 0, 0).otherwise(F.col("segment") * 10 + 2).alias("type"))
    meshes.write_grid(nodes, elements, b, str(tmp_path / "g"))
    (tmp_path / "fort.14").write_text(joined(tmp_path / "g"))
    back = meshes.read_grid(spark, str(tmp_path / "fort.14"))
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert rows(back["nodes"], "node", "x", "y", "depth") == rows(nodes, "node", "x", "y", "depth")
    assert rows(back["elements"], "elem", "n1", "n2", "n3") == rows(elements, "elem", "n1", "n2", "n3")
    cols = ("kind", "segment", "seq", "node", "type")
    assert rows(back["boundaries"], *cols) == rows(b, *cols)
    assert tuple(meshes.boundary_totals(back["boundaries"]).first()) == (3, 9, 6)
    meshes.write_density(nodes, [-1.0, 0.0], 10.0, str(tmp_path / "d"))
    assert joined(tmp_path / "d").splitlines()[2:5] == ["2 13", "1 1 10.0", "1 2 10.0"]


def test_triangle_files(spark, tmp_path):
    (tmp_path / "m.node").write_text("# a mesh\n4 2 0 1\n1 0 0 1\n2 1 0 1\n4 0 1 0\n3 1 1 1\n")
    (tmp_path / "m.ele").write_text("2 3 0\n2 1 3 4\n1 1 2 3\n")
    nodes, elements = meshes.read_triangle(spark, str(tmp_path / "m"))
    assert sorted(tuple(r) for r in nodes.collect()) == [(0, 0.0, 0.0, 1), (1, 1.0, 0.0, 1), (2, 1.0, 1.0, 1), (3, 0.0, 1.0, 0)]
    assert sorted(tuple(r) for r in elements.collect()) == [(0, 0, 1, 2), (1, 0, 2, 3)]


def test_parameters_round_trip(spark, tmp_path):
    p = {"RUNDES": "a run", "RUNID": "one"} | dict.fromkeys("NFOVER NABOUT NSCREEN IHOT IM NOLICA NOLICAT NCOR NTIP NWS NTIF".split(), 0) | {"ICS": 1, "NOLIBF": 2, "NOLIFA": 2, "NWP": 1, "AttrName": ["friction"], "NRAMP": 1}
    p |= {"G": 9.81, "TAU0": -5.0, "Tau0FullDomainMin": 0.1, "Tau0FullDomainMax": 0.2, "DTDP": 2.0, "STATIM": 0.0, "REFTIM": 0.0, "RNDAY": 5.0, "DRAMP": 2.0, "A00": 0.35, "B00": 0.3, "C00": 0.35}
    p |= {"H0": 1.0, "INTEGER1": 0.0, "INTEGER2": 0.0, "VELMIN": 0.05, "SLAM0": 0.0, "SFEA0": 0.0, "CF": 0.0025, "HBREAK": 1.0, "FTHETA": 10.0, "FGAMMA": 0.3, "ESLM": 0.0, "CORI": 0.0}
    p |= {"TIDES": {}, "BOUNDARY": {"M2": (1.4e-4, 1.0, 0.0)}, "FORCING": {"M2": [(0.3, 0.0), (0.4, 1.0)]}, "ANGINN": 110.0}
    parameters.write_parameters(spark, p, str(tmp_path / "p"))
    back = parameters.read_parameters(spark, str(tmp_path / "p") + "/part-*", boundary_nodes=2)
    assert back == p | {"NBFR": 1}
    (tmp_path / "n").write_text("&run\n dt = 3, name = 'x'\n/\n&grid\n n=4\n/\n")
    assert {tuple(r) for r in parameters.read_namelist(spark, str(tmp_path / "n")).collect()} == {("run", "dt", "3"), ("run", "name", "'x'"), ("grid", "n", "4")}


def test_whole_parameter_file_with_three_dimensions(spark, tmp_path):
    """Flux forcing, stations, harmonics, solver line and the 3-D block survive a round trip, with Fortran exponents and notes read on the way."""
    p = {"RUNDES": "deep", "RUNID": "two"} | dict.fromkeys("NFOVER NABOUT NSCREEN IHOT NOLICA NOLICAT NCOR NTIP NWP NTIF NOLIBF NOLIFA".split(), 0) | {"ICS": 1, "IM": 21, "IDEN": 4, "NWS": 5, "NRAMP": 1, "AttrName": []}
    p |= dict.fromkeys("G TAU0 DTDP STATIM REFTIM WTIMINC RNDAY DRAMP A00 B00 C00 H0 SLAM0 SFEA0 TAU ESLM CORI ANGINN".split(), 1.5)
    p |= {"TIDES": {}, "NBFR": 1, "BOUNDARY": {"M2": (1.4e-4, 1.0, 0.0)}, "FORCING": {"M2": [(0.3, 0.0), (0.4, 1.0)]}, "NFFR": 1, "FLUXES": {"K1": (7e-5, 1.0, 2.0)}, "FLUX_FORCING": {"K1": [(0.1, 0.0)] * 3}}
    for k, n in enumerate(("ELEVATION", "VELOCITY", "WEATHER", "DEEP_DENSITY", "DEEP_VELOCITY", "DEEP_TURBULENCE")):
        p |= {f"{n}_FORMAT": k, f"{n}_FROM": 0.0, f"{n}_TO": 5.0, f"{n}_EVERY": 60, f"{n}_N": k % 3, f"{n}_STATIONS": [f"{j}.0 {k}.5" for j in range(k % 3)]}
    for n in ("ALL_ELEVATION", "ALL_VELOCITY", "ALL_WEATHER", "ALL_DEEP_DENSITY", "ALL_DEEP_VELOCITY", "ALL_DEEP_TURBULENCE"):
        p |= {f"{n}_FORMAT": 1, f"{n}_FROM": 0.0, f"{n}_TO": 5.0, f"{n}_EVERY": 120}
    p |= {"NHARF": 2, "HARMONICS": {"M2": (1.4e-4, 1.0, 0.0), "S2": (1.45e-4, 1.0, 0.0)}, "THAS": 1.0, "THAF": 4.0, "NHAINC": 10, "FMV": 0.0, "NHASE": 1, "NHASV": 1, "NHAGE": 1, "NHAGV": 1, "NHSTAR": 0, "NHSINC": 1000}
    p |= {"ITITER": 1, "ISLDIA": 0, "CONVCR": 1e-9, "ITMAX": 25, "ISLIP": 3, "KP": 0.0025, "Z0S": 0.01, "Z0B": 0.02, "ALP1": 0.5, "ALP2": 0.5, "ALP3": 0.5, "IGC": 0, "NFEN": 11, "SIGMA": [round(-1 + 0.2 * k, 1) for k in range(11)]}
    p |= {"IEVC": 50, "EVMIN": 1e-6, "EVCON": 0.05, "THETA1": 1.0, "THETA2": 1.0, "RES_BC_FLAG": 4, "BCFLAG_LNM": 1, "BCFLAG_TEMP": 1}
    p |= dict.fromkeys("RBCTIMEINC SBCTIMEINC TBCTIMEINC BCSTATIM SBCSTATIM TBCSTATIM TTBCTIMEINC TTBCSTATIM SPONGEDIST EQNSTATE NLSD NVSD NLTD NVTD ALP4".split(), 2.5)
    parameters.write_parameters(spark, p, str(tmp_path / "p"))
    assert parameters.read_parameters(spark, str(tmp_path / "p") + "/part-*", 2, 3) == p
    text = "\n".join(parameters.parameter_lines(p)).replace("1e-09", "1.D-9").replace("25 ! ITITER", "25 note ! ITITER")
    (tmp_path / "fort.15").write_text(text)
    assert parameters.read_parameters(spark, str(tmp_path / "fort.15"), 2, 3) == p
    back = parameters.update_parameters(spark, str(tmp_path / "fort.15"), str(tmp_path / "q"), 2, 3, ITMAX=50)
    assert parameters.read_parameters(spark, str(tmp_path / "q") + "/part-*", 2, 3) == back == p | {"ITMAX": 50}
    with pytest.raises(KeyError, match="NONE"):
        parameters.update_parameters(spark, str(tmp_path / "fort.15"), str(tmp_path / "r"), 2, 3, NONE=1)
    with pytest.raises(ValueError, match="ends after"):
        (tmp_path / "cut").write_text("\n".join(text.split("\n")[:-3]))
        parameters.read_parameters(spark, str(tmp_path / "cut"), 2, 3)
    with pytest.raises(ValueError, match="density switch"):
        (tmp_path / "odd").write_text(text.replace("4 ! IDEN", "3 ! IDEN", 1))
        parameters.read_parameters(spark, str(tmp_path / "odd"), 2, 3)
    flat = {k: v for k, v in p.items()} | {"IM": 0, "NWS": 0}
    (tmp_path / "flat").write_text("\n".join(parameters.parameter_lines(flat)))
    got = parameters.read_parameters(spark, str(tmp_path / "flat"), 2, 3)
    assert got["ITMAX"] == 25 and "SIGMA" not in got and "WEATHER_N" not in got and got["FLUX_FORCING"] == p["FLUX_FORCING"]


def test_best_track(spark, tmp_path):
    row = "AL, 12, {d}, , BEST, 0, {lat}N, {lon}W, {v}, {p}, HU, 34, NEQ, 1, 1, 1, 1, 1012, {rrp}, 20\n"
    text = row.format(d="2005082806", lat=240, lon=870, v=100, p=930, rrp=200) + row.format(d="2005082806", lat=999, lon=1, v=1, p=1, rrp=1)
    text += row.format(d="2005082812", lat=250, lon=875, v=0, p=0, rrp="") + "AL, 12, 2005082818\n"
    (tmp_path / "b.dat").write_text(text)
    raw = storms.read_best_track(spark, str(tmp_path / "b.dat"))
    assert len(raw.columns) == 39 and raw.count() == 4
    out = storms.storm_track(raw).orderBy("ts").collect()
    assert [(r["lat"], r["lon"], r["mslp"], r["rrp"]) for r in out] == [(24.0, -87.0, 93000.0, 370400.0), (25.0, -87.5, 93000.0, 370400.0)]
    assert out[1]["vmax"] == pytest.approx(100 * 1852 / 3600)


def test_profile_round_trip(spark, tmp_path):
    (tmp_path / "prof").write_text("# title\n# zf(m) thl(K), qt(kg/kg)\n12.5 290.0 0.01\n37.5 291.0 0.009\n")
    df = fields.read_profile(spark, str(tmp_path / "prof"))
    assert df.columns == ["height", "thl", "qt"] and units.unit_of(df, "thl") == units.K
    assert [tuple(r) for r in df.orderBy("height").collect()] == [(12.5, 290.0, 0.01), (37.5, 291.0, 0.009)]
    fields.write_profile(parameters.with_defaults(df, {"u": 0.0}), ["height", "thl", "u"], str(tmp_path / "out"))
    assert joined(tmp_path / "out").splitlines()[1:3] == ["# height thl u", "1.2500e+01 2.9000e+02 0.0000e+00"]


def test_binary_grid_and_links(spark, tmp_path):
    a = np.arange(2 * 3 * 4, dtype=">f8").reshape(2, 3, 4)
    (tmp_path / "g.bin").write_bytes(a.tobytes())
    g = fields.read_binary_grid(spark, str(tmp_path / "g.bin"), 4, 3, ("lat", "lon"))
    assert g.count() == 12 and g.where("lat <> j * 4 + i or lon <> lat + 12").count() == 0
    records = np.array([(1, 2, 0.5, 0.0, 0.0), (3, 2, 0.5, 1.0, 2.0)], fields._LINK)
    (tmp_path / "l.bin").write_bytes(records.tobytes())
    links = fields.read_packed_links(spark, str(tmp_path / "l.bin"))
    assert tuple(fields.link_sizes(links).first()) == (2, 2, 1)
    fields.save_links(links, str(tmp_path / "links"))
    assert spark.read.parquet(str(tmp_path / "links")).count() == 2


def classic_file(records: int) -> bytes:
    """A small classic NetCDF file: t (record), y 2, x 3; h(t, y, x) double with a fill value, z(y, x) short scaled."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    attr = lambda name, kind, data, n: text(name) + struct.pack(">ii", kind, n) + data + b"\0" * (-len(data) % 4)
    dims = struct.pack(">ii", 10, 3) + text("t") + struct.pack(">i", 0) + text("y") + struct.pack(">i", 2) + text("x") + struct.pack(">i", 3)
    none = struct.pack(">ii", 0, 0)

    def variables(z_at: int, h_at: int) -> bytes:
        z = text("z") + struct.pack(">iii", 2, 1, 2) + struct.pack(">ii", 12, 1) + attr("scale_factor", 6, struct.pack(">d", 0.5), 1) + struct.pack(">iii", 3, 12, z_at)
        h = text("h") + struct.pack(">iiii", 3, 0, 1, 2) + struct.pack(">ii", 12, 1) + attr("_FillValue", 6, struct.pack(">d", -9.0), 1) + struct.pack(">iii", 6, 48, h_at)
        return struct.pack(">ii", 11, 2) + z + h

    head = b"CDF\x01" + struct.pack(">i", records) + dims + none
    at = len(head + variables(0, 0))
    z = np.arange(6, dtype=">i2").tobytes()
    h = np.arange(6 * records, dtype=">f8")
    h[1] = -9.0
    return head + variables(at, at + 12) + z + h.tobytes()


def test_classic_netcdf(spark, tmp_path):
    (tmp_path / "f.nc").write_bytes(classic_file(2))
    out = fields.read_netcdf(spark, str(tmp_path / "f.nc"), ["h"], ["x", "t", "y"])
    got = {(r["t"], r["y"], r["x"]): r["h"] for r in out.collect()}
    assert len(got) == 12 and got[0, 0, 1] is None and got[1, 1, 2] == 11.0
    z = {(r["y"], r["x"]): r["z"] for r in fields.read_netcdf(spark, str(tmp_path / "f.nc"), ["z"], ["y", "x"]).collect()}
    assert z[1, 2] == 2.5
    with pytest.raises(ValueError):
        arrays.parsed_header(b"GRIB", 4)


def test_snapshots(spark, tmp_path):
    t0 = datetime(2020, 1, 30)
    rows = [(t0 + timedelta(days=d), float(lat), float(lon), d + lat / 10) for d in range(4) for lat in (0, 1) for lon in (0, 1, 359)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, lat double, lon double, u10 double")
    fields.write_snapshots(df, str(tmp_path / "s"))
    out = fields.read_snapshots(spark, str(tmp_path / "s"), ["10m_u_component_of_wind"], datetime(2020, 2, 1), datetime(2020, 2, 1), (1.0, 0.0, 1.0, 10.0))
    assert [tuple(r)[3] for r in out.collect()] == [2.1, 2.1]
    assert "PartitionFilters: [isnotnull" in out._jdf.queryExecution().toString()
    assert fields.close_longitudes(df, 0.5).where("lon = 360").count() == 8
    assert {r["lon"] for r in fields.stitch_meridian(df, -2.0, 0.5).select("lon").distinct().collect()} == {-1.0, 0.0}
    with pytest.raises(KeyError):
        column_by_name(["a", "b"], "nothing")


def test_stream_islands(spark, tmp_path):
    from pelagia.streaming import tracks as streams

    t0 = datetime(2020, 1, 1)
    rows = [(1, t0), (1, t0 + timedelta(hours=1)), (1, t0 + timedelta(hours=9)), (2, t0), (None, t0), (9, t0 + timedelta(days=3))]
    spark.createDataFrame(rows[:4], "track long, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(rows[4:], "track long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("track long, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.drained(spark, streams.islands(stream, 7200.0), str(tmp_path / "out"))
    assert sorted((r["track"], r["n_rows"]) for r in out.collect()) == [(1, 1), (1, 2), (2, 1)]
    still = streams.open_islands(spark, str(tmp_path / "out")).collect()
    assert [(r["track"], r["first_ts"], r["last_ts"], r["n_rows"]) for r in still] == [(9, rows[-1][1], rows[-1][1], 1)]
    assert streams.open_islands(spark, str(tmp_path / "out"), 2).count() == 0
    means = streams.slab_means(stream.withColumn("v", F.lit(2.0)), "track", "v")
    got = streams.drained(spark, means, str(tmp_path / "means"))
    assert sorted((r["track"] or 0, r["mean"], r["n"]) for r in got.collect()) == [(0, 2.0, 1), (1, 2.0, 3), (2, 2.0, 1)]


def test_reanalysis_requests(spark, tmp_path):
    assert reanalysis.product_type() == "reanalysis" and reanalysis.product_type(period="monthly", synoptic=True) == "monthly_averaged_reanalysis_by_hour_of_day"
    assert reanalysis.product_type(True, statistics=True) == ["ensemble_members", "ensemble_mean", "ensemble_spread"]
    assert reanalysis.span(datetime(2020, 2, 3, 4), "month") == (datetime(2020, 2, 1), datetime(2020, 2, 29, 23), 696)
    t0 = datetime(2020, 1, 30)
    rows = [(t0 + timedelta(hours=h), lat, 0.0, float(h)) for h in range(30) for lat in (0.0, 0.25, 1.0)]
    store, cache = str(tmp_path / "s"), str(tmp_path / "cache")
    fields.write_snapshots(spark.createDataFrame(rows, "ts timestamp_ntz, lat double, lon double, u10 double"), store)
    day = reanalysis.dataset(spark, store, cache, "u10", t0, "day", grid=1.0)
    assert day.count() == 48 and {r["lat"] for r in day.collect()} == {0.0, 1.0}
    again = reanalysis.dataset(spark, str(tmp_path / "nothing"), cache, "u10", t0 + timedelta(hours=5), "day", grid=1.0)
    assert again.count() == 48  # from the cache
    assert [r["u10"] for r in reanalysis.dataset(spark, store, cache, "u10", t0 + timedelta(hours=3), area=(0.5, 0.0, 0.1, 1.0)).collect()] == [3.0]
    with pytest.raises(ValueError):
        reanalysis.dataset(spark, store, cache, "u10", t0 + timedelta(days=1), "day")
    with pytest.raises(ValueError):
        reanalysis.dataset(spark, store, cache, "u10", t0, grid=0.3)


def test_checked_requests_levels_and_history(spark, tmp_path):
    t0 = datetime(2020, 2, 3, 4)
    r = reanalysis.request("t", t0, "month", levels=[850, 500], area=(60.9, -10.5, 50.2, 5.7), grid=0.5)
    assert r.collection == "pressure-levels" and r.parameters["pressure_level"] == [500, 850] and r.parameters["area"] == [60, -10, 50, 5]
    assert len(r.parameters["day"]) == 29 and len(r.parameters["time"]) == 24 and r.parameters["variable"] == "temperature"
    monthly = reanalysis.request("sea_surface_temperature", t0, period="monthly", ensemble=True)
    assert monthly.collection == "single-levels-monthly-means" and monthly.parameters["product_type"] == "monthly_averaged_ensemble_members" and monthly.parameters["time"] == ["04:00"]
    for wrong, why in (({"variable": "none"}, "no such variable"), ({"variable": "t"}, "levels of"), ({"variable": "t", "levels": [851]}, "levels of"), ({"variable": "u10", "period": "monthly"}, "no monthly"), ({"variable": "u10", "grid": 0.3}, "spacing")):
        with pytest.raises(ValueError, match=why):
            reanalysis.request(**({"time": t0} | wrong))
    assert reanalysis.request("snow_depth", t0, known=["snow_depth"]).parameters["variable"] == "snow_depth"
    rows = [(t0 + timedelta(hours=h), lat, lon, level, level + lat) for h in range(2) for lat in (0.0, 1.0) for lon in (0.0, 1.0) for level in (500, 850)]
    store, cache = str(tmp_path / "s"), str(tmp_path / "c")
    fields.write_snapshots(spark.createDataFrame(rows, "ts timestamp_ntz, lat double, lon double, level int, t double"), store)
    got = reanalysis.dataset(spark, store, cache, "t", t0, level=850)
    assert sorted(r["t"] for r in got.collect()) == [850.0, 850.0, 851.0, 851.0]
    assert {r["t"] for r in reanalysis.dataset(spark, store, cache, "t", t0, level=500, area=(0.9, 0.0, -0.9, 1.0)).collect()} == {500.0}
    assert reanalysis.dataset(spark, str(tmp_path / "nothing"), cache, "t", t0, level=850).count() == 4
    assert sorted((r["variable"], r["level"], r["hours"], r["area"], r["rows"]) for r in reanalysis.history(spark, cache).collect()) == [("temperature", 500, 1, "0_0_0_1", 2), ("temperature", 850, 1, None, 4)]


def test_input_by_kind_and_flags(spark, tmp_path):
    (tmp_path / "f.nc").write_bytes(classic_file(1))
    assert fields.read_levels(spark, str(tmp_path / "f.nc"), ["z"], ["y", "x"]).count() == 6
    (tmp_path / "prof").write_text("# title\n# z thl\n10 290\n")
    assert fields.read_levels(spark, str(tmp_path / "prof")).columns == ["height", "thl"]
    df = set_flags(spark.range(6).withColumnRenamed("id", "i"), "on", {"i": slice(1, 5, 2)})
    df = set_flags(set_flags(df, "on", {"i": [0, 3]}), "on", {"i": 1}, False)
    assert sorted(r["i"] for r in df.where("on").collect()) == [0, 3] and df.where("on is null").count() == 0
