"""Queries over unstructured meshes, polygons and circles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.geo import inside_polygon
from ..operators import curves, linear, mesh, remap
from .views import elements, links, mesh_nodes, nodes, query, rounded, table

_INC = "inc AS (SELECT elem, v, area, unnest([n1, n2, n3]) AS node, unnest([0, 1, 2]) AS corner FROM elements)"


@query(f"WITH {_INC} SELECT elem, CAST(corner AS INT) AS corner, node FROM inc", "elements")
def mesh_incidence(spark, sf_dir):
    return mesh.incidence(elements(spark, sf_dir))


_EDGES = "ed AS (SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM (SELECT unnest([n1, n2, n3]) AS p, unnest([n2, n3, n1]) AS q FROM elements))"


@query(f"WITH {_EDGES} SELECT a, b FROM ed", "elements")
def mesh_edges(spark, sf_dir):
    return mesh.edges(elements(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT node, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS neighbours FROM (SELECT a AS node, b AS other FROM ed UNION ALL SELECT b, a FROM ed) GROUP BY node", "elements")
def mesh_neighbours(spark, sf_dir):
    return mesh.neighbours(elements(spark, sf_dir)).select("node", F.array_join("neighbours", ",").alias("neighbours"))


_AROUND = f"""{_INC}, ends AS (SELECT a.elem, a.node, b.node AS other FROM inc a JOIN inc b ON a.elem = b.elem AND a.node <> b.node),
    met AS (SELECT p.node, p.elem, q.elem AS other FROM ends p JOIN ends q ON p.node = q.node AND p.other = q.other AND p.elem <> q.elem GROUP BY ALL HAVING count(*) = 1),
    around AS (SELECT i.node, i.elem, count(m.other) AS n, coalesce(sum(e.v), 0) AS s FROM inc i LEFT JOIN met m ON i.node = m.node AND i.elem = m.elem LEFT JOIN elements e ON e.elem = m.other GROUP BY ALL)"""


@query(f"WITH {_AROUND} SELECT node, min(n) < 2 AS boundary FROM around GROUP BY node", "elements")
def mesh_boundary_nodes(spark, sf_dir):
    return mesh.boundary_nodes(elements(spark, sf_dir))


@query(f"WITH {_INC} SELECT node, round(avg(v), 7) AS v FROM inc GROUP BY node", "elements")
def node_from_elem_mean(spark, sf_dir):
    return rounded(mesh.nodes_from_elements(elements(spark, sf_dir), "v"), 7, "v")


@query(f"WITH {_INC} SELECT node, round(sum(v * area / 3) / sum(area / 3), 7) AS v FROM inc GROUP BY node", "elements")
def node_from_elem_fracarea(spark, sf_dir):
    return rounded(mesh.nodes_from_elements(elements(spark, sf_dir), "v", "area"), 7, "v")


@query(f"WITH {_AROUND} SELECT node, round(sum(((1 + n / 2) * e.v - s / 2) * area) / sum(area), 7) AS v FROM around JOIN elements e USING (elem) GROUP BY node", "elements")
def node_from_elem_gather(spark, sf_dir):
    return rounded(mesh.nodes_gathered(elements(spark, sf_dir), "v", "area"), 7, "v")


@query(f"WITH {_INC} SELECT elem, round(avg(m.v), 6) AS v FROM inc JOIN mesh_nodes m USING (node) GROUP BY elem", "elements", "mesh_nodes")
def elem_from_node(spark, sf_dir):
    return rounded(mesh.elements_from_nodes(elements(spark, sf_dir), mesh_nodes(spark, sf_dir), "v"), 6, "v")


@query(
    """WITH c AS (SELECT elem, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, c.x AS x3, c.y AS y3 FROM elements JOIN mesh_nodes a ON n1 = a.node JOIN mesh_nodes b ON n2 = b.node JOIN mesh_nodes c ON n3 = c.node)
    SELECT elem, round((x1 + x2 + x3) / 3, 6) AS x, round((y1 + y2 + y3) / 3, 6) AS y, ((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2 AS area FROM c""",
    "elements", "mesh_nodes",
)
def elem_geometry(spark, sf_dir):
    c = mesh.with_areas(mesh.with_corners(elements(spark, sf_dir), mesh_nodes(spark, sf_dir)))
    return rounded(c.select("elem", "x", "y", "area"), 6, "x", "y")


@query(
    """WITH s AS (SELECT CAST(floor(sqrt(count(*))) AS INT) AS n FROM supplier), a AS (SELECT n, unnest(range(n + 1)) AS i FROM s)
    SELECT CAST(b.i * (a.n + 1) + a.i AS BIGINT) AS node, a.i * 0.5::DOUBLE AS x, b.i * 0.5::DOUBLE AS y FROM a, a b
    UNION ALL SELECT CAST((a.n + 1) * (a.n + 1) + b.i * a.n + a.i AS BIGINT), (a.i + 0.5::DOUBLE) * 0.5::DOUBLE, (b.i + 0.5::DOUBLE) * 0.5::DOUBLE FROM a, a b WHERE a.i < a.n AND b.i < b.n"""
)
def square_domain_nodes(spark, sf_dir):
    """A square of as many cells as there are suppliers, or a few less."""
    n = math.isqrt(table(spark, sf_dir, "supplier").count())
    return mesh.square_domain(spark, n * 0.5, n)[0]


@query(
    """WITH p AS (SELECT id % 50 AS ring, id, lon, lat FROM nodes), q AS (SELECT ring, lon, lat, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS lon2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS lat2
    FROM p WINDOW w AS (PARTITION BY ring ORDER BY id)) SELECT ring, abs(sum(lon * lat2 - lon2 * lat)) / 2 AS area FROM q GROUP BY ring""",
    "nodes",
)
def shoelace_area(spark, sf_dir):
    return curves.polygon_area(nodes(spark, sf_dir).withColumn("ring", F.col("id") % 50), "ring", "id", "lon", "lat")


@query(
    """WITH m AS (SELECT id % 50 AS ring, avg(lon) AS mx, avg(lat) AS my FROM nodes GROUP BY ALL), p AS (SELECT ring, mx, my, lon - mx AS u, lat - my AS w FROM nodes JOIN m ON ring = id % 50),
    s AS (SELECT ring, any_value(mx) AS mx, any_value(my) AS my, count(*) AS n, sum(u * u) AS uu, sum(w * w) AS vv, sum(u * w) AS uv, sum(u * (u * u + w * w)) AS a, sum(w * (u * u + w * w)) AS b FROM p GROUP BY ring),
    c AS (SELECT *, (a * vv - b * uv) / nullif(2 * (uu * vv - uv * uv), 0) AS x, (b * uu - a * uv) / nullif(2 * (uu * vv - uv * uv), 0) AS y FROM s)
    SELECT ring, round(mx + x, 5) AS xc, round(my + y, 5) AS yc, round(sqrt(x * x + y * y + (uu + vv) / n), 5) AS radius, n FROM c""",
    "nodes",
)
def circle_fit(spark, sf_dir):
    out = curves.fit_circle(nodes(spark, sf_dir).withColumn("ring", F.col("id") % 50), ["ring"], "lon", "lat")
    return rounded(out, 5, "xc", "yc", "radius")


_CIRCLES = """m AS (SELECT id % 50 AS ring, avg(lon) AS mx, avg(lat) AS my FROM nodes GROUP BY ALL), p AS (SELECT ring, mx, my, lon - mx AS u, lat - my AS w FROM nodes JOIN m ON ring = id % 50),
    s AS (SELECT ring, any_value(mx) AS mx, any_value(my) AS my, count(*) AS n, sum(u * u) AS uu, sum(w * w) AS vv, sum(u * w) AS uv, sum(u * (u * u + w * w)) AS a, sum(w * (u * u + w * w)) AS b FROM p GROUP BY ring),
    c AS (SELECT *, (a * vv - b * uv) / nullif(2 * (uu * vv - uv * uv), 0) AS x, (b * uu - a * uv) / nullif(2 * (uu * vv - uv * uv), 0) AS y FROM s),
    circles AS (SELECT ring, mx + x AS xc, my + y AS yc, sqrt(x * x + y * y + (uu + vv) / n) AS r FROM c)"""


@query(
    f"""WITH {_CIRCLES}, q AS (SELECT id % 50 AS ring, id, lon, lat FROM nodes),
    e AS (SELECT ring, lon - xc AS x1, lat - yc AS y1, coalesce(lead(lon) OVER w, first_value(lon) OVER w) - xc AS x2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) - yc AS y2, r FROM q JOIN circles USING (ring) WINDOW w AS (PARTITION BY ring ORDER BY id)),
    t AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy, (x2 - x1) ** 2 + (y2 - y1) ** 2 AS a, x1 * (x2 - x1) + y1 * (y2 - y1) AS b, x1 * x1 + y1 * y1 - r * r AS c FROM e),
    k AS (SELECT *, CASE WHEN a = 0 OR b * b <= a * c THEN 1 ELSE greatest(0, least(1, (-b - sqrt(b * b - a * c)) / a)) END AS t1, CASE WHEN a = 0 OR b * b <= a * c THEN 1 ELSE greatest(0, least(1, (-b + sqrt(b * b - a * c)) / a)) END AS t2 FROM t),
    f AS (SELECT ring, r, x1 * y2 - x2 * y1 AS own, r * r * (atan2(x1 * (y1 + t1 * dy) - y1 * (x1 + t1 * dx), x1 * (x1 + t1 * dx) + y1 * (y1 + t1 * dy)) + atan2((x1 + t2 * dx) * y2 - (y1 + t2 * dy) * x2, (x1 + t2 * dx) * x2 + (y1 + t2 * dy) * y2))
      + (x1 + t1 * dx) * (y1 + t2 * dy) - (y1 + t1 * dy) * (x1 + t2 * dx) AS shared FROM k)
    SELECT ring, round(100 * (pi() * any_value(r) ** 2 + abs(sum(own)) / 2 - abs(sum(shared))) / (pi() * any_value(r) ** 2), 5) AS error FROM f GROUP BY ring""",
    "nodes",
)
def circle_area_error(spark, sf_dir):
    n = nodes(spark, sf_dir).withColumn("ring", F.col("id") % 50)
    circles = curves.fit_circle(n, ["ring"], "lon", "lat")
    return rounded(curves.circle_error(curves.polygon_edges(n, "ring", "id", "lon", "lat"), circles, ["ring"]), 5, "error")


# Points on the outline: lower and left sides belong to the polygon, upper and right ones do not.
@query("SELECT id, (lat >= -20 AND lat < 10 AND lon >= -50 AND lon < 60) OR (lat >= 10 AND lat < 40 AND lon >= -50 AND lon < 0) AS inside FROM nodes", "nodes")
def point_in_polygon(spark, sf_dir):
    corners = [(-50, -20), (60, -20), (60, 10), (0, 10), (0, 40), (-50, 40), (-50, -20)]
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])
    return nodes(spark, sf_dir).select("id", inside_polygon("lon", "lat", ring).alias("inside"))


@query("SELECT dst AS idx, round(sum(w1 * p_size), 4) AS value FROM links JOIN part ON src = p_partkey GROUP BY dst", "links")
def sparse_multiply(spark, sf_dir):
    matrix = links(spark, sf_dir).select(F.col("dst").alias("row"), F.col("src").alias("col"), F.col("w1").alias("value"))
    v = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("double").alias("value"))
    return rounded(linear.multiply(matrix, v), 4, "value")


@query("SELECT coalesce(a.id, b.id) AS idx, round(2 * coalesce(a.v, 0) - coalesce(b.v, 0), 6) AS value FROM nodes a FULL JOIN stations b ON a.id = b.id", "nodes", "stations")
def vector_combine(spark, sf_dir):
    from .views import stations

    a, b = (f(spark, sf_dir).select(F.col("id").alias("idx"), F.col("v").alias("value")) for f in (nodes, stations))
    return rounded(linear.combine(a, b, 2.0, -1.0), 6, "value")


@query(
    f"""WITH {_INC}, side AS (SELECT elem, avg(m.v) AS v FROM inc JOIN mesh_nodes m USING (node) GROUP BY elem),
    moved AS (SELECT t.elem, coalesce(any_value(w.a), 0) AS a, coalesce(any_value(w.v), 0) AS v FROM elements t LEFT JOIN
      (SELECT dst, sum(w1 * e.area) AS a, sum(w1 * s.v) AS v FROM links JOIN elements e ON src = e.elem JOIN side s ON src = s.elem GROUP BY dst) w ON t.elem = w.dst GROUP BY t.elem)
    SELECT 'elem' AS kind, elem AS id, round(a, 5) AS value FROM moved UNION ALL SELECT 'node', node, round(avg(moved.v), 5) FROM inc JOIN moved USING (elem) GROUP BY node""",
    "elements", "mesh_nodes", "links",
)
def staggered_remap(spark, sf_dir):
    e = elements(spark, sf_dir)
    of_cells, of_nodes = remap.staggered(mesh_nodes(spark, sf_dir), e.drop("v"), e, links(spark, sf_dir), ["area", "v"])
    out = of_cells.select(F.lit("elem").alias("kind"), F.col("elem").alias("id"), F.col("area").alias("value"))
    return rounded(out.union(of_nodes.select(F.lit("node"), "node", "v")), 5, "value")
