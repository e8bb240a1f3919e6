"""Operators against analytic cases, plain Python and their corner cases."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pelagia import catalog, units
from pelagia.grids import Grid
from pelagia.operators import channels, curves, eddies, linear, mesh, nearest, remap, stencils, tracks


def box(spark, n=9):
    """A unit field with a rim of zeros."""
    inside = F.col("i").between(1, n - 2) & F.col("j").between(1, n - 2)
    return spark.range(n * n).select((F.col("id") % n).cast("int").alias("i"), F.floor(F.col("id") / n).cast("int").alias("j")).withColumn("v", F.when(inside, 1.0).otherwise(0.0))


def test_box_samples(spark):
    mid = 4.0
    points = [(1, mid, mid, 0.5), (2, mid, mid, 1.0), (3, mid, mid, 2.0), (4, 0.5, mid, 1.0), (5, 0.5, 0.5, 1.0)]
    p = spark.createDataFrame(points, "dst int, x double, y double, d double")
    out = {r["dst"]: r["v"] for r in remap.box_samples(p, box(spark), 1.0, 1.0, 9, 9, ["v"]).collect()}
    assert out == pytest.approx({1: 1, 2: 1, 3: 1, 4: 0.5, 5: 0.25})


def test_conservative_links_keep_the_integral(spark):
    cells = [(i * 10 + j, float(i), i + 1.0, float(j), j + 1.0) for i in range(6) for j in range(6)]
    big = [(i * 10 + j, i * 2.0, i * 2 + 2.0, j * 3.0, j * 3 + 3.0) for i in range(3) for j in range(2)]
    schema = "id int, x1 double, x2 double, y1 double, y2 double"
    links = remap.box_links(spark.createDataFrame(cells, schema), spark.createDataFrame(big, schema), 2.5)
    totals = {r["dst"]: r["t"] for r in links.groupBy("dst").agg(F.sum("w1").alias("t")).collect()}
    assert totals == pytest.approx(dict.fromkeys([b[0] for b in big], 1.0))
    source = spark.createDataFrame([(c[0], float(c[0] % 7)) for c in cells], "src int, v double")
    out = remap.apply_links(source, links, None, ["v"]).agg(F.sum(F.col("v") * 6)).first()[0]
    assert out == pytest.approx(sum(c[0] % 7 for c in cells))


def test_remap_without_links(spark):
    target = spark.createDataFrame([(1,), (2,)], "dst int")
    links = spark.createDataFrame([], "src int, dst int, w1 double")
    source = spark.createDataFrame([(1, 5.0)], "src int, v double")
    assert {r["v"] for r in remap.apply_links(source, links, target, ["v"]).collect()} == {0.0}
    assert remap.unlinked(target, links).count() == 2


def test_k_nearest_against_all_pairs(spark):
    pts = [(k, float((k * 37) % 101), float((k * 53) % 89)) for k in range(60)] + [(100 + k, 5.0, 5.0) for k in range(30)]
    qs = [(k, float((k * 71) % 200 - 50), float((k * 29) % 150 - 30)) for k in range(40)] + [(40, 50_000.0, -3.0), (41, -9e5, 4e6), (500, None, 1.0), (501, float("nan"), 1.0)]
    q, p = spark.createDataFrame(qs, "q int, x double, y double"), spark.createDataFrame(pts, "p int, x double, y double")
    got = {}
    for r in nearest.k_nearest(q, p, 3).collect():
        got.setdefault(r["q"], []).append((r["d2"], r["p"]))
    for k, x, y in qs[:-2]:
        assert sorted(got[k]) == sorted(((a - x) ** 2 + (b - y) ** 2, i) for i, a, b in pts)[:3]
    assert 500 not in got and 501 not in got
    assert nearest.nearest(q, p.limit(0)).count() == 0


def test_channels(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "i int, v double")
    b = spark.createDataFrame([(1, 9.0), (2, 8.0), (3, 7.0)], "i int, v double")
    assert {tuple(r) for r in channels.copy(a, b, ["i"], ["v"]).collect()} == {(1, 1.0), (2, None), (3, 7.0)}
    assert {tuple(r) for r in channels.upsert(b, a.union(spark.createDataFrame([(4, 4.0)], a.schema)), ["i"]).collect()} == {(1, 1.0), (2, 8.0), (3, 7.0), (4, 4.0)}
    with pytest.raises(ValueError):
        channels.transform(a, b, ["i"], ["x", "y"], lambda v: [v], ["v"])


def test_grid(spark):
    g = Grid.regular(spark, (4, 3), (8.0, 3.0)).assign("t", F.col("x") + F.col("y"), units.K)
    assert g[1:3, 2].df.count() == 2 and g[F.col("x") > 4].df.count() == 6
    assert g.unit("t") == units.K and g.empty_copy().df.columns == ["i", "j"]
    assert g.copy_from(g, ["t"]).unit("t") == units.K
    assert tuple(g.extent("x").first()) == (1.0, 7.0)


def test_mesh_of_square(spark):
    nodes, elements, boundary = mesh.square_domain(spark, 4.0, 4)
    assert (nodes.count(), elements.count(), mesh.edges(elements).count()) == (41, 64, 104)
    area = mesh.with_areas(mesh.with_corners(elements, nodes))
    assert area.agg(F.sum("area"), F.min("area")).first()[:] == pytest.approx((16.0, 0.25))
    on = {r["node"] for r in mesh.boundary_nodes(elements).where("boundary").collect()}
    assert {r["node"] for r in boundary.collect()} == on and len(on) == 16
    # a constant field stays constant by all three ways to the nodes
    flat = area.withColumn("v", F.lit(2.5))
    for out in (mesh.nodes_from_elements(flat, "v"), mesh.nodes_from_elements(flat, "v", "area"), mesh.nodes_gathered(flat, "v", "area")):
        assert out.agg(F.min("v"), F.max("v"), F.count("*")).first()[:] == pytest.approx((2.5, 2.5, 41))


def test_gaussian_keeps_constants_and_mass(spark):
    f = box(spark, 12).withColumn("c", F.lit(3.0))
    assert stencils.gaussian(f, "c", 1.5, 2.0).agg(F.min("c"), F.max("c")).first()[:] == pytest.approx((3.0, 3.0))
    before = f.agg(F.sum("v")).first()[0]
    assert stencils.gaussian(f, "v", 1.5, 2.0).agg(F.sum("v")).first()[0] == pytest.approx(before)
    assert stencils.gaussian(f.limit(0), "v", 1.0, 1.0).count() == 0


def test_track_cleaning(spark):
    t0 = datetime(2020, 1, 1)
    rows = [(1, t0, 0.0), (1, t0 + timedelta(hours=1), 5.0), (1, t0 + timedelta(hours=1), 6.0), (1, t0 + timedelta(hours=2), 0.0), (2, t0, 0.0)]
    df = spark.createDataFrame(rows, "track int, ts timestamp_ntz, v double")
    out = tracks.fill_zeros(tracks.drop_repeats(df, order=["ts", "v"]), ["v"]).orderBy("track", "ts").collect()
    assert [(r["track"], r["v"]) for r in out] == [(1, None), (1, 5.0), (1, 5.0), (2, None)]
    assert tracks.add_velocity(df.limit(0).withColumns({"lat": F.lit(0.0), "lon": F.lit(0.0)})).count() == 0


def test_interpolation_is_held_at_the_ends(spark):
    known = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 5.0), ("a", 4.0, 1.0)], "track string, z double, v double")
    at = spark.createDataFrame([("a", x) for x in (-1.0, 0.5, 2.0, 3.0, 9.0)] + [("b", 1.0)], "track string, z double")
    out = {(r["track"], r["z"]): r["v"] for r in tracks.interpolate(known, at, ["v"], x="z").collect()}
    assert out == {("a", -1.0): 1.0, ("a", 0.5): 2.0, ("a", 2.0): 5.0, ("a", 3.0): 3.0, ("a", 9.0): 1.0, ("b", 1.0): None}


def test_cyclone(spark):
    t0 = datetime(2020, 1, 1)
    rows = [("s", t0 + timedelta(hours=6 * k), 20.0 + k, -60.0, 95000.0, 60.0, 40e3) for k in range(3)]
    track = spark.createDataFrame(rows, "track string, ts timestamp_ntz, lat double, lon double, mslp double, vmax double, mrd double")
    nodes = spark.createDataFrame([(1, 21.0, -60.0), (2, 21.0, -59.0), (3, 40.0, -20.0)], "node int, lat double, lon double")
    out = {r["node"]: r for r in tracks.cyclone_field(track, nodes, track.where("lat = 21").select("track", "ts")).collect()}
    assert out[1]["pressure"] == pytest.approx(95000.0)
    assert out[2]["wind_y"] > 20 and abs(out[3]["wind_x"]) < 5 and out[3]["pressure"] > 101000


def test_resample_equal_steps(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 1.0), (1, 2, 0.0, 4.0)], "track int, seq int, lat double, lon double")
    out = tracks.resample(line, 8).orderBy("seq").collect()
    assert [r["lon"] for r in out] == pytest.approx([0.5 * k for k in range(9)])


def circle_field(spark, n=41, sign=1.0):
    x, y = (F.col("id") % n).cast("int"), F.floor(F.col("id") / n).cast("int")
    r2 = (x - 20.0) * (x - 20.0) + (y - 18.0) * (y - 18.0)
    bump = sign * 20 * F.exp(-r2 / 60)
    return spark.range(n * n).select(F.lit(0).alias("snapshot"), x.alias("i"), y.alias("j"), (x * 0.25 + 10).alias("lon"), (y * 0.25 + 30).alias("lat"), bump.alias("sla"), F.sqrt(r2).alias("speed"), F.lit(1.0).alias("eke"))


def test_contour_of_a_bump(spark):
    f = circle_field(spark)
    ring = curves.rings(curves.contour_segments(f, [5.0, 10.0], "sla"))
    out = ring.groupBy("level", "ring").agg(curves.ring_area().alias("area")).orderBy("level").collect()
    wanted = [math.pi * 60 * math.log(20 / z) for z in (5.0, 10.0)]
    assert len(out) == 2 and [abs(r["area"]) for r in out] == pytest.approx(wanted, rel=0.01)
    count = curves.spans(ring, ["level"]).groupBy("level").agg(curves.inside_count().alias("n"))
    direct = {k: f.where(F.col("sla") >= z).count() for k, z in ((0, 5.0), (1, 10.0))}
    assert {r["level"]: r["n"] for r in count.collect()} == direct
    fit = curves.fit_circle(ring, ["level"], "px", "py").orderBy("level").first()
    assert (fit["xc"], fit["yc"], fit["radius"]) == pytest.approx((20, 18, math.sqrt(60 * math.log(4))), abs=0.05)


def test_open_contours_go(spark):
    f = spark.range(100).select((F.col("id") % 10).cast("int").alias("i"), F.floor(F.col("id") / 10).cast("int").alias("j")).withColumn("value", F.col("i").cast("double"))
    assert curves.rings(curves.contour_segments(f, [4.5])).count() == 0
    assert curves.rings(curves.contour_segments(f.limit(0), [4.5])).count() == 0


@pytest.mark.parametrize("sign", [1, -1])
def test_one_planted_eddy(spark, sign):
    limits = eddies.Limits(levels=tuple(float(z) for z in range(-20, 21)))
    (e,) = eddies.detect(circle_field(spark, sign=sign), limits).collect()
    assert e["sign"] == sign and (e["lon"], e["lat"]) == (pytest.approx(15.0, abs=0.02), pytest.approx(34.5, abs=0.02))
    assert 17 <= e["amplitude"] <= 20 and e["n_cells"] > 100 and e["radius_s"] <= e["radius_e"] * 1.001
    assert eddies.detect(circle_field(spark).limit(0), limits).count() == 0


def test_matching_equals_a_plain_loop(spark, sf_dir):
    from pelagia.plans.views import eddies as view

    e = view(spark, "/root/testdata/sf0.01")
    pairs = eddies.candidates(e, 7.0)
    links = {tuple(r) for r in eddies.assign(pairs).select("sign", "snapshot", "old", "new").collect()}
    wanted, taken = set(), set()
    by_old = {}
    for r in pairs.collect():
        by_old.setdefault((r["sign"], r["snapshot"], r["old"]), []).append((r["dx"], r["new"]))
    for (s, t, old), found in sorted(by_old.items()):
        for _, new in sorted(found):
            if (s, t, new) not in taken:
                taken.add((s, t, new))
                wanted.add((s, t, old, new))
                break
    assert links == wanted and links
    tracked = eddies.track(e, eddies.assign(pairs))
    assert tracked.count() == e.count()
    follows = {(s, t, new): old for s, t, old, new in links}
    rows = {(r["sign"], r["snapshot"], r["eddy"]): (r["track"], r["n"]) for r in tracked.collect()}
    for (s, t, new), old in follows.items():
        assert rows[s, t, new] == (rows[s, t - 1, old][0], rows[s, t - 1, old][1] + 1)
    assert eddies.births(e, eddies.assign(pairs)).count() == e.count() - len(links)


def test_linear_solvers(spark):
    n = 6
    cells = [(i, j, 2.0 if i == j else -1.0) for i in range(n) for j in range(n) if abs(i - j) <= 1]
    a = spark.createDataFrame(cells, "row int, col int, value double")
    b = spark.createDataFrame([(i, 1.0) for i in range(n)], "idx int, value double")
    x = linear.conjugate_gradient(lambda v: linear.multiply(a, v), b)
    assert linear.length(linear.combine(linear.multiply(a, x), b, 1.0, -1.0)) < 1e-8
    # x^2 = 2 by components
    square = lambda v: v.select("idx", (F.col("value") * F.col("value") - 2).alias("value"))
    solve = lambda v, f: v.join(f.withColumnRenamed("value", "f"), "idx").select("idx", (F.col("f") / (2 * F.col("value"))).alias("value"))
    root, size = linear.newton(square, solve, b)
    assert size < 1e-7 and root.first()["value"] == pytest.approx(2**0.5)


def test_catalog(spark):
    names = [(m, t) for m in catalog.TABLES for t in catalog.table_names(m)]
    assert all(catalog.schema(m, t).fields for m, t in names)
    assert units.Unit.read(catalog.schema("swan", "nodes")["depth"].metadata["unit"]) == units.m
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "node int, v double")
    assert [r["v"] for r in catalog.get(df, ["v"], node=2).collect()] == [3.0]
    done = catalog.put(df, spark.createDataFrame([(2, 9.0)], df.schema), ["node"])
    assert {tuple(r) for r in done.collect()} == {(1, 2.0), (2, 9.0)}
    assert catalog.outside(df, spark.createDataFrame([(5, 9.0), (2, 1.0)], df.schema), ["node"]).collect() == [(5, 9.0)]


def great_circle(p, q, radius):
    (x, y), (u, v) = ([math.radians(c) for c in r] for r in (p, q))
    return 2 * radius * math.asin(min(1.0, math.sqrt(math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2)))


@pytest.mark.parametrize("limit", [200.0, 1500.0, 9000.0])
def test_pairs_within_at_poles_and_date_line(spark, sf_dir, limit):
    from pelagia.functions.geo import EARTH_KM, haversine
    from pelagia.plans.views import stations

    odd = [(0, 90), (77, -90), (0, 89.5), (180, 89.5), (-90, 88), (179.9, 0), (-179.9, 0.1), (180, 70), (-180, 70), (359.9, 10), (0.1, 10), (-0.05, 10), (540, 70.5), (170, 64), (178.5, 64.2), (12, 75), (5, 75.1)]
    points = [(r["lon"], r["lat"]) for r in stations(spark, sf_dir).collect()] + [(float(x), float(y)) for x, y in odd]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "id long, x double, y double")
    a, b = (df.select(F.col("id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")) for n in "ab")
    got = [(r["a"], r["b"]) for r in nearest.pairs_within(a, b, haversine("ay", "ax", "by", "bx"), limit).collect()]
    wanted = {(m, n) for m, p in enumerate(points) for n, q in enumerate(points) if great_circle(p, q, EARTH_KM) <= limit}
    assert len(got) == len(set(got)) and set(got) == wanted


def test_sum_of_radii_at_poles_and_date_line(spark):
    from pelagia.operators import eddies

    pairs = [((179.8, 10), (-179.8, 10)), ((7.9, 80), (16.1, 80)), ((0, 89.5), (180, 89.5)), ((359.9, -40), (0.1, -40)), ((3.9, 0), (4.1, 0)), ((20, 0), (24, 0))]
    rows = [(t, 1, 10 * k + t, float(x), float(y), 90e3, 5.0) for k, pair in enumerate(pairs) for t, (x, y) in enumerate(pair)]
    rows += [(1, -1, 100, -179.8, 10.0, 90e3, 5.0), (2, 1, 101, -179.8, 10.0, 90e3, 5.0)]
    e = spark.createDataFrame(rows, "snapshot long, sign int, eddy long, lon double, lat double, radius_e double, amplitude double")
    got = sorted((r["sign"], r["snapshot"], r["old"], r["new"]) for r in eddies.sum_of_radii(e).collect())
    assert got == [(1, 1, 0, 1), (1, 1, 10, 11), (1, 1, 20, 21), (1, 1, 30, 31), (1, 1, 40, 41), (1, 2, 1, 101)]
