"""Queries over grids: reductions, index ranges, channels, remapping, stencils."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.physics import wind_stress
from ..grids import Axis, Grid
from ..operators import aggregates, channels, curves, nearest, projections, remap, stencils
from ..operators.components import components
from ..sources.fields import close_longitudes, stitch_meridian
from .views import cells, field, links, nodes, query, rounded, stations, table

# ---- reductions


@query("SELECT k, round(avg(q), 6) AS q, round(avg(price), 4) AS price FROM cells GROUP BY k", "cells")
def slab_mean(spark, sf_dir):
    return rounded(rounded(aggregates.slab_mean(cells(spark, sf_dir), "k", "q", "price"), 6, "q"), 4, "price")


@query("SELECT i, j, round(sum(q * (1 + k / 10)), 4) AS path FROM cells GROUP BY i, j", "cells")
def column_path(spark, sf_dir):
    return rounded(aggregates.column_path(cells(spark, sf_dir), ["i", "j"], "q", 1 + F.col("k") / 10), 4, "path")


@query("SELECT round(sum(price) / count(*), 4) AS mean FROM cells", "cells")
def domain_mean(spark, sf_dir):
    return rounded(aggregates.domain_mean(cells(spark, sf_dir), "price"), 4, "mean")


@query(
    """SELECT slab, avg(cloud) AS fraction FROM (SELECT CASE WHEN k < 3 THEN 0 WHEN k < 5 THEN 1 ELSE 2 END AS slab, i, j,
    max(CASE WHEN price > 104000 THEN 1 ELSE 0 END) AS cloud FROM cells WHERE k >= 1 AND k < 8 GROUP BY ALL) GROUP BY slab""",
    "cells",
)
def slab_fraction(spark, sf_dir):
    over = cells(spark, sf_dir).withColumn("over", F.col("price") - 104000)
    return aggregates.slab_fraction(over, ["i", "j"], "k", "over", [1, 3, 5, 8])


@query("SELECT CAST(count(*) AS BIGINT) AS n, sum(q) AS sum_q, min(q) AS min_q, max(q) AS max_q, round(avg(q), 8) AS mean_q, round(stddev_pop(q), 6) AS std_q FROM cells", "cells")
def field_summary(spark, sf_dir):
    return rounded(rounded(aggregates.summary(cells(spark, sf_dir), "q"), 8, "mean_q"), 6, "std_q")


@query("SELECT min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat FROM nodes", "nodes")
def grid_extent(spark, sf_dir):
    return Grid(nodes(spark, sf_dir), ("id",)).extent("lon", "lat")


@query("SELECT i, j, k FROM (SELECT i, j, k, abs(price * q) AS w FROM cells) ORDER BY w DESC, i, j, k LIMIT 1", "cells")
def argmax_level(spark, sf_dir):
    return aggregates.argmax(cells(spark, sf_dir), F.abs(F.col("price") * F.col("q")), ["i", "j", "k"])


@query("SELECT round(avg(d), 8) AS spacing FROM (SELECT abs(lead(v) OVER (PARTITION BY j ORDER BY i) - v) AS d FROM field) WHERE d > 0", "field")
def mean_spacing(spark, sf_dir):
    return rounded(aggregates.mean_spacing(field(spark, sf_dir), "j", "i", "v"), 8, "spacing")


@query(
    """SELECT min(psi) AS psi_min, max(psi) AS psi_max FROM (SELECT sum(t) OVER (PARTITION BY j ORDER BY k) AS psi
    FROM (SELECT j, k, sum(q - 25) AS t FROM cells GROUP BY j, k))""",
    "cells",
)
def overturning(spark, sf_dir):
    return aggregates.overturning(cells(spark, sf_dir), "i", "j", "k", F.col("q") - 25)


@query("SELECT dst, CAST(count(*) AS BIGINT) AS n_links, round(sum(w1), 6) AS total FROM links GROUP BY dst", "links")
def link_weight_totals(spark, sf_dir):
    return rounded(aggregates.weight_totals(links(spark, sf_dir), "dst"), 6, "total")


@query("SELECT round(sum(v * lat), 4) AS before, round(sum(v * lat) * 0.5, 4) AS after, CAST(0.5 AS DOUBLE) AS error FROM (SELECT v, abs(lat) AS lat FROM nodes)", "nodes")
def area_sum_error(spark, sf_dir):
    a = nodes(spark, sf_dir).select("v", F.abs("lat").alias("area"))
    out = aggregates.area_error(a, a.withColumn("v", F.col("v") * 0.5), "v", "area")
    return rounded(rounded(out, 4, "before", "after"), 9, "error")


@query(
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm,
    round(list_sum(list_transform(range(1, len(embedding) + 1), lambda k: CAST(embedding[k] AS DOUBLE) * CAST(embedding[len(embedding) + 1 - k] AS DOUBLE))), 5) AS dot FROM embeddings"""
)
def vector_norm_dot(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("back", F.reverse("embedding"))
    return v.select("vec_id", F.round(aggregates.array_norm("embedding"), 5).alias("norm"), F.round(aggregates.array_dot("embedding", "back"), 5).alias("dot"))


# ---- index ranges and updates


@query("SELECT i, j, k, q, price FROM cells WHERE i >= 3 AND i < 8 AND j = 2 AND k IN (1, 4)", "cells")
def subgrid_range(spark, sf_dir):
    return Grid(cells(spark, sf_dir), ("i", "j", "k"))[3:8, 2, [1, 4]].df


@query("SELECT i, j, v FROM field WHERE i >= 5 AND i < 35 AND (i - 5) % 3 = 0", "field")
def subgrid_stride(spark, sf_dir):
    return projections.block(field(spark, sf_dir), {"i": slice(5, 35, 3)})


@query("SELECT i, j, v FROM field WHERE i BETWEEN 8 AND 22 AND j BETWEEN 3 AND 12", "field")
def subgrid_halo(spark, sf_dir):
    return projections.with_halo(field(spark, sf_dir), "i", "j", (10, 5), (20, 10), 2)


_LONLAT = "g AS (SELECT i, j, i * 0.25 - 30 + j * 0.01 AS lon, j * 0.25 + 30 AS lat, v FROM field)"
_CORNERS = f"""{_LONLAT}, near AS (SELECT arg_min(i, ((lon + 27.1) * (lon + 27.1) + (lat - 32.5) * (lat - 32.5), j, i)) AS i0, arg_min(i, ((lon + 23.4) * (lon + 23.4) + (lat - 32.5) * (lat - 32.5), j, i)) AS i1,
    arg_min(j, ((lon + 25.25) * (lon + 25.25) + (lat - 31.1) * (lat - 31.1), j, i)) AS j0, arg_min(j, ((lon + 25.25) * (lon + 25.25) + (lat - 33.9) * (lat - 33.9), j, i)) AS j1 FROM g)"""


def _lonlat(spark, sf_dir):
    i, j = F.col("i"), F.col("j")
    return field(spark, sf_dir).select("i", "j", (i * 0.25 - 30 + j * 0.01).alias("lon"), (j * 0.25 + 30).alias("lat"), "v")


@query(f"WITH {_CORNERS} SELECT i0, i1, j0, j1 FROM near", "field")
def box_indices(spark, sf_dir):
    return projections.box_indices(_lonlat(spark, sf_dir), (-27.1, -23.4, 31.1, 33.9))


@query(f"WITH {_CORNERS} SELECT i, j, v FROM g, near WHERE i BETWEEN i0 - 2 AND i1 + 2 AND j BETWEEN j0 - 2 AND j1 + 2", "field")
def box_with_halo(spark, sf_dir):
    return projections.in_box(_lonlat(spark, sf_dir), (-27.1, -23.4, 31.1, 33.9), 2).select("i", "j", "v")


@query("SELECT CAST(row_number() OVER (ORDER BY dst, src, w1, w2, w3) - 1 AS BIGINT) AS link, src, dst, w1 FROM links", "links")
def link_by_ordinal(spark, sf_dir):
    return remap.numbered(links(spark, sf_dir)).select("link", "src", "dst", "w1")


@query(
    """WITH c AS (SELECT i * 100 + j AS col, k, avg(price) AS price FROM cells GROUP BY ALL), z AS (SELECT DISTINCT col, unnest([0.5, 2.3, 3.7, 6.9, 9.0])::DOUBLE AS height FROM c),
    a AS (SELECT z.col, z.height, max(lo.k) AS below, min(hi.k) AS above FROM z LEFT JOIN c lo ON lo.col = z.col AND lo.k <= z.height LEFT JOIN c hi ON hi.col = z.col AND hi.k >= z.height GROUP BY ALL),
    b AS (SELECT a.col, a.height, coalesce(below, above) AS below, coalesce(above, below) AS above FROM a)
    SELECT b.col, b.height, round(p.price + CASE WHEN above > below THEN (b.height - below) / (above - below) * (q.price - p.price) ELSE 0 END, 7) AS price FROM b JOIN c p ON p.col = b.col AND p.k = below JOIN c q ON q.col = b.col AND q.k = above""",
    "cells",
)
def profile_levels(spark, sf_dir):
    """Columns of cells brought to other heights."""
    c = cells(spark, sf_dir).groupBy((F.col("i") * 100 + F.col("j")).alias("col"), F.col("k").cast("double").alias("height")).agg(F.avg("price").alias("price"))
    return rounded(channels.on_levels(c, [0.5, 2.3, 3.7, 6.9, 9.0], ["price"], "col"), 7, "price")


@query("SELECT id, lon, lat, CASE WHEN lat > 0 THEN v * 2 ELSE v END AS v FROM nodes", "nodes")
def masked_update(spark, sf_dir):
    return Grid(nodes(spark, sf_dir), ("id",)).update_where(F.col("lat") > 0, v=F.col("v") * 2).df


@query("SELECT i, j, CAST(m * lead(m) OVER (PARTITION BY j ORDER BY i) AS INT) AS uv FROM (SELECT i, j, CASE WHEN v > 25 THEN 1 ELSE 0 END AS m FROM field)", "field")
def velocity_mask(spark, sf_dir):
    m = field(spark, sf_dir).select("i", "j", (F.col("v") > 25).cast("int").alias("m"))
    return projections.neighbour_mask(m, "m", "j", "i", "uv").drop("m")


@query(
    """SELECT i, j, CAST(l_linenumber AS BIGINT) AS k FROM (SELECT DISTINCT CAST(l_partkey % 20 AS INT) AS i, CAST(l_suppkey % 10 AS INT) AS j, l_linenumber FROM lineitem)
    WHERE l_linenumber IN (2, 4, 6)"""
)
def every_second_level(spark, sf_dir):
    c = cells(spark, sf_dir).select("i", "j", F.col("k").cast("long").alias("k")).distinct()
    return projections.every_nth(c, "k", 2, skip=1)


@query("SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(10 + (i + 0.5) * 0.5 AS DOUBLE) AS x, CAST((j + 0.5) * 0.25 AS DOUBLE) AS y FROM (SELECT unnest(range(count(*))) AS i FROM supplier) a, range(4) b(j)")
def regular_grid(spark, sf_dir):
    """A column of cells for each supplier."""
    n = table(spark, sf_dir, "supplier").count()
    return Grid.regular(spark, (n, 4), (n * 0.5, 1.0), (10.0, 0.0)).df


# ---- channels


@query("SELECT n.id, n.lon, n.lat, CASE WHEN s.id IS NOT NULL THEN s.v ELSE n.v END AS v FROM nodes n LEFT JOIN stations s ON n.id = s.id", "nodes", "stations")
def channel_copy(spark, sf_dir):
    return Grid(nodes(spark, sf_dir), ("id",)).copy_from(Grid(stations(spark, sf_dir), ("id",)), ["v"]).df


@query("SELECT id, lon, lat, v, round(1.5925e-3 * lon * sqrt(lon * lon + lat * lat), 9) AS tau_x, round(1.5925e-3 * lat * sqrt(lon * lon + lat * lat), 9) AS tau_y FROM nodes", "nodes")
def channel_transform_windstress(spark, sf_dir):
    grid = Grid(nodes(spark, sf_dir), ("id",), {"x": Axis()})
    out = grid.transform_from(grid, ["tau_x", "tau_y"], lambda vx, vy: wind_stress(vx, vy), ["lon", "lat"])
    return rounded(out.df, 9, "tau_x", "tau_y")


@query("SELECT coalesce(n.id, s.id) AS id, coalesce(s.lon, n.lon) AS lon, coalesce(s.lat, n.lat) AS lat, coalesce(s.v, n.v) AS v FROM nodes n FULL JOIN (SELECT id + 50 AS id, -lon AS lon, lat, v FROM stations) s ON n.id = s.id", "nodes", "stations")
def channel_upsert(spark, sf_dir):
    changes = stations(spark, sf_dir).withColumns({"id": F.col("id") + 50, "lon": -F.col("lon")})
    return channels.upsert(nodes(spark, sf_dir), changes, ["id"])


@query("SELECT id, CAST(unnest([0, 10, 50]) AS DOUBLE) AS level FROM stations", "stations")
def level_expansion(spark, sf_dir):
    return channels.at_levels(stations(spark, sf_dir).select("id"), [0.0, 10.0, 50.0])


# ---- remapping


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"), (F.col("p_size") * 0.5).alias("half"))


def _suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("dst"))


@query(
    """SELECT t.dst, coalesce(round(sum(w1 * p_retailprice), 3), 0.0) AS price, coalesce(round(sum(w1 * p_size), 4), 0.0) AS size
    FROM (SELECT s_suppkey * 2 AS dst FROM supplier) t LEFT JOIN (links JOIN part ON src = p_partkey) USING (dst) GROUP BY t.dst""",
    "links",
)
def remap_first_order(spark, sf_dir):
    out = remap.apply_links(_parts(spark, sf_dir), links(spark, sf_dir), _suppliers(spark, sf_dir), ["price", "size"])
    return rounded(rounded(out, 3, "price"), 4, "size")


@query("SELECT dst, round(sum(w1 * p_retailprice + w2 * p_size + w3 * p_size * 0.5), 3) AS price FROM links JOIN part ON src = p_partkey GROUP BY dst", "links")
def remap_second_order(spark, sf_dir):
    out = remap.apply_links(_parts(spark, sf_dir), links(spark, sf_dir), None, ["price"], {"price": ("size", "half")})
    return rounded(out, 3, "price")


@query("SELECT s_suppkey * 2 AS dst FROM supplier WHERE s_suppkey * 2 NOT IN (SELECT dst FROM links)", "links")
def remap_unlinked(spark, sf_dir):
    return remap.unlinked(_suppliers(spark, sf_dir), links(spark, sf_dir))


@query("SELECT dst, round(sum(w1 / total * p_retailprice), 4) AS price FROM links JOIN (SELECT dst, sum(w1) AS total FROM links GROUP BY dst) USING (dst) JOIN part ON src = p_partkey GROUP BY dst", "links")
def remap_normalised(spark, sf_dir):
    out = remap.apply_links(_parts(spark, sf_dir), remap.normalised(links(spark, sf_dir)), None, ["price"])
    return rounded(out, 4, "price")


@query(
    """SELECT f.i * 100 + f.j AS src, t.id AS dst,
    round(greatest(0, least(f.i + 1, t.x + 2.5) - greatest(f.i, t.x)) * greatest(0, least(f.j + 1, t.y + 1.5) - greatest(f.j, t.y)) / 3.75, 9) AS w1
    FROM field f, (SELECT id, (id % 37) + 0.25 AS x, (id % 23) + 0.5 AS y FROM stations) t
    WHERE least(f.i + 1, t.x + 2.5) > greatest(f.i, t.x) AND least(f.j + 1, t.y + 1.5) > greatest(f.j, t.y)""",
    "field", "stations",
)
def box_overlap_links(spark, sf_dir):
    i, j, k = F.col("i"), F.col("j"), F.col("id")
    source = field(spark, sf_dir).select((i * 100 + j).alias("id"), i.alias("x1"), (i + 1).alias("x2"), j.alias("y1"), (j + 1).alias("y2"))
    x, y = (k % 37) + 0.25, (k % 23) + 0.5
    target = stations(spark, sf_dir).select("id", x.alias("x1"), (x + 2.5).alias("x2"), y.alias("y1"), (y + 1.5).alias("y2"))
    return rounded(remap.box_links(source, target, 3.0), 9, "w1")


_SPOTS = "SELECT id AS dst, (id % 37) + 0.3 AS x, (id % 23) + 0.7 AS y, 1.5 + id % 3 AS d FROM stations"


def _spots(spark, sf_dir):
    k = F.col("id")
    return stations(spark, sf_dir).select(k.alias("dst"), ((k % 37) + 0.3).alias("x"), ((k % 23) + 0.7).alias("y"), (1.5 + k % 3).alias("d"))


@query(
    f"""SELECT dst, round(sum(ox * oy * v) / max(d * d), 6) AS v FROM (
    SELECT dst, d, v, least(x + d / 2, ci + 0.5) - greatest(x - d / 2, ci - 0.5) AS ox, least(y + d / 2, cj + 0.5) - greatest(y - d / 2, cj - 0.5) AS oy
    FROM ({_SPOTS}) p, range(-5, 50) a(ci), range(-5, 35) b(cj), field f
    WHERE f.i = greatest(0, least(39, ci)) AND f.j = greatest(0, least(24, cj)) AND ci BETWEEN x - 5 AND x + 5 AND cj BETWEEN y - 5 AND y + 5) WHERE ox > 0 AND oy > 0 GROUP BY dst""",
    "stations", "field",
)
def box_overlap_average(spark, sf_dir):
    return rounded(remap.box_samples(_spots(spark, sf_dir), field(spark, sf_dir), 1.0, 1.0, 40, 25, ["v"]), 6, "v")


@query(
    f"""SELECT dst, round(sum(ox * oy * v), 6) AS v FROM (
    SELECT dst, v, least(x + 0.5, ci + 0.5) - greatest(x - 0.5, ci - 0.5) AS ox, least(y + 0.5, cj + 0.5) - greatest(y - 0.5, cj - 0.5) AS oy
    FROM ({_SPOTS}) p, range(-5, 50) a(ci), range(-5, 35) b(cj), field f
    WHERE f.i = greatest(0, least(39, ci)) AND f.j = greatest(0, least(24, cj)) AND ci BETWEEN x - 2 AND x + 2 AND cj BETWEEN y - 2 AND y + 2) WHERE ox > 0 AND oy > 0 GROUP BY dst""",
    "stations", "field",
)
def refinement_boundary(spark, sf_dir):
    """A finer grid's points take means over the coarser grid's cell size."""
    return rounded(remap.from_parent(_spots(spark, sf_dir).select("dst", "x", "y"), field(spark, sf_dir), 0.25, 1.0, 1.0, 40, 25, ["v"]), 6, "v")


@query(
    f"""SELECT dst, round(sum(w * v), 6) AS v FROM (SELECT dst, v, (1 - abs(x - i)) * (1 - abs(y - j)) AS w FROM ({_SPOTS}) p JOIN field ON abs(x - i) < 1 AND abs(y - j) < 1) GROUP BY dst""",
    "stations", "field",
)
def bilinear_sample(spark, sf_dir):
    at = remap.bilinear_links(_spots(spark, sf_dir), 0.0, 0.0, 1.0, 1.0, 40, 25)
    return rounded(remap.sample(field(spark, sf_dir), at, ["v"]), 6, "v")


@query(
    """SELECT id, lon AS x, lat AS y, region FROM (SELECT n.id, n.lon, n.lat, r.region, row_number() OVER (PARTITION BY n.id ORDER BY priority, region) AS k
    FROM nodes n LEFT JOIN (SELECT n_nationkey AS region, (n_nationkey * 7) % 25 AS priority, (n_nationkey * 53) % 300 - 180 AS x1, (n_nationkey * 31) % 120 - 80 AS y1 FROM nation) r
    ON lon >= x1 AND lon < x1 + 60 AND lat >= y1 AND lat < y1 + 40) WHERE k = 1""",
    "nodes",
)
def region_priority(spark, sf_dir):
    k = F.col("n_nationkey")
    x1, y1 = (k * 53) % 300 - 180, (k * 31) % 120 - 80
    regions = table(spark, sf_dir, "nation").select(k.alias("region"), ((k * 7) % 25).alias("priority"), x1.alias("x1"), (x1 + 60).alias("x2"), y1.alias("y1"), (y1 + 40).alias("y2"))
    points = nodes(spark, sf_dir).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return remap.first_region(points, regions, 30.0)


# ---- neighbours


def _asked(spark, sf_dir):
    return nodes(spark, sf_dir).select(F.col("id").alias("q"), F.col("lon").alias("x"), F.col("lat").alias("y"))


def _known(spark, sf_dir):
    return stations(spark, sf_dir).select(F.col("id").alias("p"), F.col("lon").alias("x"), F.col("lat").alias("y"))


_NEAR = "SELECT n.id AS q, s.id AS p, (n.lon - s.lon) ** 2 + (n.lat - s.lat) ** 2 AS d2, s.v FROM nodes n, stations s"


@query(f"SELECT q, p, d2 FROM ({_NEAR}) QUALIFY row_number() OVER (PARTITION BY q ORDER BY d2, p) = 1", "nodes", "stations")
def nearest_station(spark, sf_dir):
    return nearest.nearest(_asked(spark, sf_dir), _known(spark, sf_dir))


@query(
    f"""SELECT q, round(coalesce(sum(sqrt(d2) * v) / nullif(sum(sqrt(d2)), 0), avg(v)), 4) AS v FROM
    (SELECT q, d2, v FROM ({_NEAR}) QUALIFY row_number() OVER (PARTITION BY q ORDER BY d2, p) <= 4) GROUP BY q""",
    "nodes", "stations",
)
def knn4_weighted(spark, sf_dir):
    near = nearest.k_nearest(_asked(spark, sf_dir), _known(spark, sf_dir), 4)
    values = stations(spark, sf_dir).select(F.col("id").alias("p"), "v")
    return rounded(nearest.distance_weighted(near, values, "v"), 4, "v")


@query(
    """cells4 AS (SELECT i * 1000 + j AS id, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y, CASE WHEN (i * 7 + j * 3) % 5 <> 0 THEN v END AS v FROM field),
    near AS (SELECT a.id, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2, b.v FROM cells4 a, cells4 b WHERE a.v IS NULL AND b.v IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) <= 4),
    made AS (SELECT id, avg(v) AS v FROM near n WHERE d2 = (SELECT min(d2) FROM near m WHERE m.id = n.id) GROUP BY id)
    SELECT c.id, c.x, c.y, round(coalesce(c.v, made.v), 6) AS v FROM cells4 c LEFT JOIN made USING (id)""".replace("cells4 AS", "WITH cells4 AS", 1),
    "field",
)
def fill_nearest(spark, sf_dir):
    i, j = F.col("i"), F.col("j")
    c = field(spark, sf_dir).select((i * 1000 + j).alias("id"), i.cast("double").alias("x"), j.cast("double").alias("y"), F.when((i * 7 + j * 3) % 5 != 0, F.col("v")).alias("v"))
    return rounded(nearest.fill_nearest(c, "v"), 6, "v")


_HAVERSINE = "2 * 6371.0088 * asin(sqrt(least(1, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)))"


@query(f"SELECT a.id AS a, b.id AS b, round({_HAVERSINE}, 6) AS distance FROM stations a, stations b WHERE a.id < b.id AND {_HAVERSINE} <= 1500", "stations")
def haversine_pairs_within(spark, sf_dir):
    from ..functions.geo import haversine

    s = stations(spark, sf_dir)
    a = s.select(F.col("id").alias("a"), F.col("lon").alias("ax"), F.col("lat").alias("ay"))
    b = s.select(F.col("id").alias("b"), F.col("lon").alias("bx"), F.col("lat").alias("by"))
    # of two places only one order has a distance: the other one gives the same pairs of stations
    distance = F.when(F.expr("ax < bx or (ax = bx and ay <= by)"), haversine("ay", "ax", "by", "bx"))
    found = nearest.pairs_within(a, b, distance, 1500.0).where("ax <> bx or ay <> by or a < b")
    return rounded(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance"), 6, "distance")


# ---- stencils


@query("SELECT i, j, v, (v + coalesce(lead(v) OVER (PARTITION BY j ORDER BY i), v)) / 2 AS vu FROM field", "field")
def half_points(spark, sf_dir):
    return stencils.to_edges(field(spark, sf_dir), "v", "i", "vu")


@query(
    """SELECT i, j, v, round((h + coalesce(lead(h) OVER (PARTITION BY i ORDER BY j), h)) / 2, 9) AS vp
    FROM (SELECT i, j, v, (v + coalesce(lead(v) OVER (PARTITION BY j ORDER BY i), v)) / 2 AS h FROM field)""",
    "field",
)
def four_point_mean(spark, sf_dir):
    return rounded(stencils.four_point(field(spark, sf_dir), "v", "vp"), 9, "vp")


@query(
    """WITH w AS (SELECT i, j, v, lag(v) OVER (PARTITION BY j ORDER BY i) AS a, lead(v) OVER (PARTITION BY j ORDER BY i) AS b FROM field)
    SELECT i, j, v, round(coalesce((v + a) / 2, 2 * v - (v + b) / 2, v), 9) AS lower, round(coalesce((v + b) / 2, 2 * v - (v + a) / 2, v), 9) AS upper FROM w""",
    "field",
)
def cell_bounds(spark, sf_dir):
    return rounded(stencils.cell_bounds(field(spark, sf_dir), "v", "i"), 9, "lower", "upper")


_PLACED = "SELECT i, j, v, i * 0.25 - 30 AS lon, j * 0.25 + 30 AS lat FROM field"


def _placed(spark, sf_dir):
    return field(spark, sf_dir).withColumns({"lon": F.col("i") * 0.25 - 30, "lat": F.col("j") * 0.25 + 30})


_R = 6371315.0
_SPAN = lambda a, b, c, d: f"2 * {_R} * asin(sqrt(least(1, sin(radians({c} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) ** 2)))"


@query(
    f"""WITH p AS ({_PLACED}), w AS (SELECT *, coalesce(lead(v) OVER a, v) - coalesce(lag(v) OVER a, v) AS di, coalesce(lead(v) OVER b, v) - coalesce(lag(v) OVER b, v) AS dj,
      nullif(CAST(lead(v) OVER a IS NOT NULL AS INT) + CAST(lag(v) OVER a IS NOT NULL AS INT), 0) AS ni, nullif(CAST(lead(v) OVER b IS NOT NULL AS INT) + CAST(lag(v) OVER b IS NOT NULL AS INT), 0) AS nj,
      coalesce(lag(lat) OVER a, lat) AS la0, coalesce(lag(lon) OVER a, lon) AS lo0, coalesce(lead(lat) OVER a, lat) AS la1, coalesce(lead(lon) OVER a, lon) AS lo1,
      coalesce(lag(lat) OVER b, lat) AS lb0, coalesce(lag(lon) OVER b, lon) AS mo0, coalesce(lead(lat) OVER b, lat) AS lb1, coalesce(lead(lon) OVER b, lon) AS mo1
      FROM p WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j)),
    g AS (SELECT i, j, 9.81 / (2 * 2 * pi() / 86164.0905 * sin(radians(lat))) AS gof, di / ni AS si, dj / nj AS sj, {_SPAN("la0", "lo0", "la1", "lo1")} / ni AS dx, {_SPAN("lb0", "mo0", "lb1", "mo1")} / nj AS dy FROM w)
    SELECT i, j, round(-gof * sj / dy, 6) AS u, round(gof * si / dx, 6) AS v, round((pow(gof * sj / dy, 2) + pow(gof * si / dx, 2)) / 2, 4) AS eke FROM g""",
    "field",
)
def geostrophic_eke(spark, sf_dir):
    out = stencils.geostrophic(_placed(spark, sf_dir).withColumnRenamed("v", "height"), "height").select("i", "j", "u", "v", "eke")
    return rounded(rounded(out, 6, "u", "v"), 4, "eke")


@query(
    """WITH g AS (SELECT i, j, v AS u, v * v AS w FROM field), d AS (SELECT i, j,
      (coalesce(lead(u) OVER a, u) - coalesce(lag(u) OVER a, u)) / nullif(coalesce(lead(i) OVER a, i) - coalesce(lag(i) OVER a, i), 0) AS ux,
      (coalesce(lead(w) OVER a, w) - coalesce(lag(w) OVER a, w)) / nullif(coalesce(lead(i) OVER a, i) - coalesce(lag(i) OVER a, i), 0) AS vx,
      (coalesce(lead(u) OVER b, u) - coalesce(lag(u) OVER b, u)) / nullif(coalesce(lead(j) OVER b, j) - coalesce(lag(j) OVER b, j), 0) AS uy,
      (coalesce(lead(w) OVER b, w) - coalesce(lag(w) OVER b, w)) / nullif(coalesce(lead(j) OVER b, j) - coalesce(lag(j) OVER b, j), 0) AS vy
      FROM g WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j))
    SELECT i, j, round(vx - uy, 6) AS vorticity, round((ux - vy) ** 2 + (vx + uy) ** 2 - (vx - uy) ** 2, 3) AS okubo_weiss FROM d""",
    "field",
)
def okubo_weiss(spark, sf_dir):
    f = field(spark, sf_dir).select("i", "j", F.col("v").alias("u"), (F.col("v") * F.col("v")).alias("v"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"))
    out = stencils.okubo_weiss(f).select("i", "j", "vorticity", "okubo_weiss")
    return rounded(rounded(out, 6, "vorticity"), 3, "okubo_weiss")


@query(
    """WITH n AS (SELECT i, j, v, [lag(v) OVER a, lead(v) OVER a, lag(v) OVER b, lead(v) OVER b] AS near FROM field
    WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j))
    SELECT i, j, round((coalesce(list_sum(near), 0) + (8 - len(list_filter(near, lambda x: x IS NOT NULL))) * v) / 8, 6) AS v FROM n""",
    "field",
)
def hann_smooth(spark, sf_dir):
    return rounded(stencils.hann(field(spark, sf_dir), "v"), 6, "v")


@query(
    """SELECT a.i, a.j, a.v FROM field a JOIN field b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.i, a.j, a.v HAVING min(b.v) = a.v AND max(b.v) > a.v""",
    "field",
)
def local_minima(spark, sf_dir):
    return stencils.local_minima(field(spark, sf_dir), "v")


@query("SELECT i, j, v, round(lead(v) OVER (PARTITION BY i ORDER BY j) - v, 9) AS dz FROM field", "field")
def layer_thickness(spark, sf_dir):
    return rounded(stencils.layer_thickness(field(spark, sf_dir), "v", ["i"], "j"), 9, "dz")


@query(
    """WITH k AS (SELECT unnest(range(-4, 5)) AS d), m AS (SELECT a.i, a.j, sum(exp(-d * d / 2.0) * b.v) / sum(exp(-d * d / 2.0)) AS v FROM field a, k, field b
      WHERE b.j = a.j AND b.i = CASE WHEN a.i + d < 0 THEN -1 - a.i - d WHEN a.i + d > 39 THEN 79 - a.i - d ELSE a.i + d END GROUP BY a.i, a.j)
    SELECT f.i, f.j, round(f.v - m.v, 6) AS v FROM field f JOIN m USING (i, j)""",
    "field",
)
def gaussian_high_pass(spark, sf_dir):
    return rounded(stencils.high_pass(field(spark, sf_dir), "v", 1.0, 0.0).select("i", "j", "v"), 6, "v")


@query(
    """WITH k AS (SELECT unnest(range(-3, 4)) AS d), e AS (SELECT max(j) AS n FROM field), m AS (SELECT a.i, a.j, sum(exp(-d * d / (2 * 0.75 * 0.75)) * b.v) / sum(exp(-d * d / (2 * 0.75 * 0.75))) AS v FROM field a, k, e, field b
      WHERE b.i = a.i AND b.j = CASE WHEN a.j + d < 0 THEN -1 - a.j - d WHEN a.j + d > n THEN 2 * n + 1 - a.j - d ELSE a.j + d END GROUP BY a.i, a.j)
    SELECT f.i, f.j, round(f.v - m.v, 6) AS v FROM field f JOIN m USING (i, j)""",
    "field",
)
def high_pass_waves(spark, sf_dir):
    """Meridional waves of up to 1.5 degrees on a grid of a quarter degree."""
    return rounded(stencils.high_pass_waves(field(spark, sf_dir), "v", 0.0, 1.5, 0.25).select("i", "j", "v"), 6, "v")


# ---- longitudes


@query("SELECT id, lon, lat, v FROM nodes UNION ALL SELECT id, lon + 360, lat, v FROM nodes WHERE lon < -170", "nodes")
def close_longitude(spark, sf_dir):
    shifted = nodes(spark, sf_dir)
    return close_longitudes(shifted.withColumn("lon", F.col("lon") + 180), 10.0).withColumn("lon", F.col("lon") - 180)


@query("SELECT id, CASE WHEN lon < 150 THEN lon + 360 ELSE lon END AS lon, lat, v FROM nodes WHERE lon >= 150 OR lon <= -150", "nodes")
def stitched_meridian(spark, sf_dir):
    return stitch_meridian(nodes(spark, sf_dir), 150.0, 210.0)


# ---- contours


@query()
def contour_rings(spark, sf_dir):
    """Closed contours of the smoothed field: level, area and number of points, without an order of rings."""
    smooth = stencils.hann(field(spark, sf_dir), "v", 3)
    ring = curves.rings(curves.contour_segments(smooth, [24.0, 25.0, 25.5, 26.0], "v"))
    return ring.groupBy("level", "ring").agg(F.round(curves.ring_area(), 9).alias("area"), F.count("*").alias("points"))


@query(
    """WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey * 3 AS b FROM customer WHERE c_custkey <> c_custkey * 3), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a)
    SELECT a AS u, min(least(a, b)) AS component FROM reach GROUP BY a"""
)
def graph_components(spark, sf_dir):
    k = F.col("c_custkey")
    return components(table(spark, sf_dir, "customer").select(k.alias("u"), (k * 3).alias("v")))
