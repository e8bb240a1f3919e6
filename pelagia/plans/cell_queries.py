"""Queries over cells of any convex shape: triangles of the mesh, and a curvilinear grid of quadrilaterals over the field's indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells
from .views import SQL_VIEWS, elements, field, mesh_nodes, query, rounded

SQL_VIEWS["tri"] = "SELECT elem AS id, any_value(v) AS v, list(x ORDER BY k) AS xs, list(y ORDER BY k) AS ys FROM (SELECT elem, v, unnest([n1, n2, n3]) AS node, unnest([1, 2, 3]) AS k FROM elements) JOIN (SELECT node, x, y FROM mesh_nodes) USING (node) GROUP BY elem"
_PLACES = "list_transform([[0, 0], [1, 0], [1, 1], [0, 1]], lambda p: {})"
_X, _Y = "2.4 * (i + p[1]) + 0.3 * (j + p[2]) + 0.01 * (i + p[1]) * (j + p[2])", "0.7 * (j + p[2]) + 0.05 * (i + p[1]) + 0.004 * (i + p[1]) * (j + p[2])"
SQL_VIEWS["quads"] = f"SELECT CAST(i * 100 + j AS BIGINT) AS id, CAST({_PLACES.format(_X)} AS DOUBLE[]) AS xs, CAST({_PLACES.format(_Y)} AS DOUBLE[]) AS ys FROM (SELECT DISTINCT i, j FROM field)"


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.of_mesh(mesh_nodes(spark, sf_dir), elements(spark, sf_dir))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (id, corners) whose corners are a smooth function of (i, j)."""
    i, j = F.col("i"), F.col("j")
    x = lambda a, b: 2.4 * (i + a) + 0.3 * (j + b) + 0.01 * (i + a) * (j + b)
    y = lambda a, b: 0.7 * (j + b) + 0.05 * (i + a) + 0.004 * (i + a) * (j + b)
    corners = F.array(*[F.struct(x(a, b).alias("x"), y(a, b).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    return field(spark, sf_dir).select((i.cast("long") * 100 + j).alias("id"), corners.alias("corners"))


def _inside(n: int, xs: str, ys: str) -> str:
    return f"list_min(list_transform(range(1, {n + 1}), lambda e: ({xs}[e % {n} + 1] - {xs}[e]) * (y - {ys}[e]) - ({ys}[e % {n} + 1] - {ys}[e]) * (x - {xs}[e]))) >= -1e-12"


#: Overlaps in SQL: corners of each inside the other and crossings of edges, in order about their middle.
_SHARED = f"""pairs AS (SELECT t.id AS src, q.id AS dst, t.xs AS tx, t.ys AS ty, q.xs AS qx, q.ys AS qy FROM tri t JOIN quads q
      ON list_min(t.xs) <= list_max(q.xs) AND list_min(q.xs) <= list_max(t.xs) AND list_min(t.ys) <= list_max(q.ys) AND list_min(q.ys) <= list_max(t.ys)),
    a AS (SELECT src, dst, unnest(tx) AS x, unnest(ty) AS y, qx, qy FROM pairs),
    b AS (SELECT src, dst, unnest(qx) AS x, unnest(qy) AS y, tx, ty FROM pairs),
    sides AS (SELECT *, unnest(range(1, 5)) AS f FROM (SELECT *, unnest(range(1, 4)) AS e FROM pairs)),
    ends AS (SELECT src, dst, tx[e] AS x1, ty[e] AS y1, tx[e % 3 + 1] - tx[e] AS dx, ty[e % 3 + 1] - ty[e] AS dy, qx[f] AS x2, qy[f] AS y2, qx[f % 4 + 1] - qx[f] AS ex, qy[f % 4 + 1] - qy[f] AS ey FROM sides),
    cuts AS (SELECT *, ((x2 - x1) * ey - (y2 - y1) * ex) / (dx * ey - dy * ex) AS t, ((x2 - x1) * dy - (y2 - y1) * dx) / (dx * ey - dy * ex) AS u FROM ends WHERE abs(dx * ey - dy * ex) > 1e-13),
    points AS (SELECT src, dst, x, y FROM a WHERE {_inside(4, 'qx', 'qy')} UNION ALL SELECT src, dst, x, y FROM b WHERE {_inside(3, 'tx', 'ty')}
      UNION ALL SELECT src, dst, x1 + t * dx, y1 + t * dy FROM cuts WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
    placed AS (SELECT *, avg(x) OVER (PARTITION BY src, dst) AS mx, avg(y) OVER (PARTITION BY src, dst) AS my FROM points),
    ring AS (SELECT src, dst, x - mx AS x, y - my AS y, mx, my, atan2(y - my, x - mx) AS turn FROM placed),
    round_it AS (SELECT *, coalesce(lead(x) OVER o, first_value(x) OVER o) AS nx, coalesce(lead(y) OVER o, first_value(y) OVER o) AS ny FROM ring WINDOW o AS (PARTITION BY src, dst ORDER BY turn)),
    shared AS (SELECT src, dst, sum(x * ny - nx * y) / 2 AS area, any_value(mx) * sum(x * ny - nx * y) / 2 + sum((x + nx) * (x * ny - nx * y)) / 6 AS sx, any_value(my) * sum(x * ny - nx * y) / 2 + sum((y + ny) * (x * ny - nx * y)) / 6 AS sy
      FROM round_it GROUP BY src, dst),
    whole AS (SELECT id, list_sum(list_transform(range(1, 5), lambda e: xs[e] * ys[e % 4 + 1] - xs[e % 4 + 1] * ys[e])) / 2 AS area FROM quads),
    over AS (SELECT src, dst, s.area / w.area AS w1, (sx - s.area * list_avg(t.xs)) / w.area AS w2, (sy - s.area * list_avg(t.ys)) / w.area AS w3
      FROM shared s JOIN whole w ON w.id = dst JOIN tri t ON t.id = src WHERE s.area / w.area > 1e-9)"""
_VIEWS = ("elements", "mesh_nodes", "field", "tri", "quads")


@query(f"WITH {_SHARED} SELECT src, dst, round(w1, 7) AS w1, round(w2, 7) AS w2, round(w3, 7) AS w3 FROM over", *_VIEWS)
def cell_overlap_links(spark, sf_dir):
    links = cells.overlap_links(triangles(spark, sf_dir), quads(spark, sf_dir), sphere=False).where("w1 > 1e-9")
    return rounded(links, 7, "w1", "w2", "w3")


@query(f"WITH {_SHARED} SELECT dst, round(sum(w1), 6) AS covered FROM over GROUP BY dst", *_VIEWS)
def cell_overlap_covered(spark, sf_dir):
    links = cells.overlap_links(triangles(spark, sf_dir), quads(spark, sf_dir), sphere=False).where("w1 > 1e-9")
    return rounded(links.groupBy("dst").agg(F.sum("w1").alias("covered")), 6, "covered")


@query(f"WITH {_SHARED}, parts AS (SELECT dst, src, w1 / sum(w1) OVER (PARTITION BY dst) AS w FROM over) SELECT q.id AS dst, round(coalesce(sum(w * v), 0), 4) AS v FROM quads q LEFT JOIN parts ON q.id = dst LEFT JOIN tri ON tri.id = src GROUP BY q.id", *_VIEWS)
def cell_overlap_remap(spark, sf_dir):
    values = elements(spark, sf_dir).select(F.col("elem").alias("id"), "v")
    return rounded(cells.remap(triangles(spark, sf_dir), values, quads(spark, sf_dir), ["v"], sphere=False, normalise="frac"), 4, "v")


#: Least-squares gradients over the triangles beyond each edge, shrunk so that half-way to each the field stays in their range.
_SLOPES = """rim AS (SELECT id, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT elem AS id, unnest([n1, n2, n3]) AS a, unnest([n2, n3, n1]) AS b FROM elements)),
    near AS (SELECT p.id, q.id AS other FROM rim p JOIN rim q ON p.a = q.a AND p.b = q.b AND p.id <> q.id),
    steps AS (SELECT near.id, list_avg(o.xs) - list_avg(s.xs) AS dx, list_avg(o.ys) - list_avg(s.ys) AS dy, o.v - s.v AS dv FROM near JOIN tri s ON s.id = near.id JOIN tri o ON o.id = other),
    sums AS (SELECT id, sum(dx * dx) AS xx, sum(dx * dy) AS xy, sum(dy * dy) AS yy, sum(dx * dv) AS xv, sum(dy * dv) AS yv, greatest(0, max(dv)) AS high, least(0, min(dv)) AS low FROM steps GROUP BY id),
    slopes AS (SELECT id, CASE WHEN xx * yy - xy * xy > 1e-12 * xx * yy THEN (yy * xv - xy * yv) / (xx * yy - xy * xy) ELSE 0 END AS gx,
      CASE WHEN xx * yy - xy * xy > 1e-12 * xx * yy THEN (xx * yv - xy * xv) / (xx * yy - xy * xy) ELSE 0 END AS gy, high, low FROM sums),
    shares AS (SELECT id, min(CASE WHEN (gx * dx + gy * dy) / 2 > high THEN high / ((gx * dx + gy * dy) / 2) WHEN (gx * dx + gy * dy) / 2 < low THEN low / ((gx * dx + gy * dy) / 2) ELSE 1 END) AS f FROM slopes JOIN steps USING (id) GROUP BY id),
    bent AS (SELECT tri.id, v, coalesce(gx * f, 0) AS gx, coalesce(gy * f, 0) AS gy FROM tri LEFT JOIN slopes USING (id) LEFT JOIN shares USING (id))"""


@query(f"WITH {_SLOPES} SELECT id, round(gx, 3) AS v_x, round(gy, 3) AS v_y FROM bent", "elements", "mesh_nodes", "tri")
def cell_gradients(spark, sf_dir):
    tri = triangles(spark, sf_dir)
    at = cells.areas(tri, sphere=False).select("id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    values = elements(spark, sf_dir).select(F.col("elem").alias("id"), "v").join(at, "id")
    return rounded(cells.gradients(values, cells.edge_neighbours(tri), ["v"]).select("id", "v_x", "v_y"), 3, "v_x", "v_y")


@query(f"WITH {_SHARED}, {_SLOPES} SELECT q.id AS dst, round(coalesce(sum(w1 * v + w2 * gx + w3 * gy), 0), 3) AS v FROM quads q LEFT JOIN over ON q.id = dst LEFT JOIN bent ON bent.id = src GROUP BY q.id", *_VIEWS)
def cell_remap_second_order(spark, sf_dir):
    values = elements(spark, sf_dir).select(F.col("elem").alias("id"), "v")
    return rounded(cells.remap(triangles(spark, sf_dir), values, quads(spark, sf_dir), ["v"], order=2, sphere=False), 3, "v")
