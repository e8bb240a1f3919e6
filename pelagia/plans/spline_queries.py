"""Queries over splines of the field; the SQL eliminates line by line with recursive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splines
from .views import SQL_VIEWS, field, nodes, query, rounded


def _grid(spark, sf_dir):
    i, j = F.col("i"), F.col("j")
    return field(spark, sf_dir).select("i", "j", (i + 0.15 * (i % 3)).cast("double").alias("x"), (j * 0.5 + 0.1 * (j % 2)).cast("double").alias("y"), F.col("v").alias("f"))


_GRID = f"field AS ({SQL_VIEWS['field']}), g AS (SELECT i, j, CAST(i + 0.15 * (i % 3) AS DOUBLE) AS x, CAST(j * 0.5 + 0.1 * (j % 2) AS DOUBLE) AS y, v AS f FROM field)"


def _solved(name: str, source: str, k: str, line: str, position: str, value: str) -> str:
    """Tables that end with ``name`` (line, k, s): slopes along an axis."""
    return f"""{name}_d AS (SELECT {line} AS line, {k} AS k, max({k}) OVER (PARTITION BY {line}) AS last, lead({position}) OVER w - {position} AS h, (lead({value}) OVER w - {value}) / (lead({position}) OVER w - {position}) AS d
        FROM {source} WINDOW w AS (PARTITION BY {line} ORDER BY {k})),
      {name}_e AS (SELECT *, lag(h) OVER w AS h1, lag(d) OVER w AS d1, lag(h, 2) OVER w AS h2, lag(d, 2) OVER w AS d2, lead(h) OVER w AS hn, lead(d) OVER w AS dn FROM {name}_d WINDOW w AS (PARTITION BY line ORDER BY k)),
      {name}_c AS (SELECT line, k, last,
        CASE WHEN k = 0 THEN 0 WHEN k = last THEN h1 + h2 ELSE h END AS low, CASE WHEN k = 0 THEN hn WHEN k = last THEN h2 ELSE 2 * (h1 + h) END AS mid, CASE WHEN k = 0 THEN h + hn WHEN k = last THEN 0 ELSE h1 END AS high,
        CASE WHEN k = 0 THEN ((h + 2 * (h + hn)) * hn * d + h * h * dn) / (h + hn) WHEN k = last THEN ((h1 + 2 * (h1 + h2)) * h2 * d1 + h1 * h1 * d2) / (h1 + h2) ELSE 3 * (h * d1 + h1 * d) END AS rhs FROM {name}_e),
      {name}_f AS (SELECT line, k, last, high / mid AS c, rhs / mid AS r FROM {name}_c WHERE k = 0
        UNION ALL SELECT n.line, n.k, n.last, n.high / (n.mid - n.low * p.c), (n.rhs - n.low * p.r) / (n.mid - n.low * p.c) FROM {name}_f p JOIN {name}_c n ON n.line = p.line AND n.k = p.k + 1),
      {name} AS (SELECT line, k, r AS s FROM {name}_f WHERE k = last UNION ALL SELECT f.line, f.k, f.r - f.c * p.s FROM {name} p JOIN {name}_f f ON f.line = p.line AND f.k = p.k - 1)"""


_SURFACE = f"""{_solved('sx', 'g', 'i', 'j', 'x', 'f')}, {_solved('sy', 'g', 'j', 'i', 'y', 'f')},
    gy AS (SELECT g.*, s AS fy FROM g JOIN sy ON sy.line = i AND sy.k = j), {_solved('sxy', 'gy', 'i', 'j', 'x', 'fy')},
    full_grid AS (SELECT gy.*, sx.s AS fx, sxy.s AS fxy FROM gy JOIN sx ON sx.line = j AND sx.k = i JOIN sxy ON sxy.line = j AND sxy.k = i)"""


@query(f"WITH RECURSIVE {_GRID}, {_SURFACE} SELECT i, j, round(fx, 7) AS fx, round(fy, 7) AS fy, round(fxy, 6) AS fxy FROM full_grid")
def spline_surface(spark, sf_dir):
    out = splines.surface(_grid(spark, sf_dir), "f").select("i", "j", "fx", "fy", "fxy")
    return rounded(rounded(out, 7, "fx", "fy"), 6, "fxy")


_EVALUATED = """asked AS (SELECT id, greatest(0, least((SELECT max(x) FROM g), (lon + 180) / 8)) AS x, greatest(0, least((SELECT max(y) FROM g), (lat + 80) / 12)) AS y FROM nodes),
    held AS (SELECT id, asked.x, asked.y, max(a.i) AS i, max(b.j) AS j FROM asked JOIN (SELECT DISTINCT i, x FROM g WHERE i < (SELECT max(i) FROM g)) a ON a.x <= asked.x JOIN (SELECT DISTINCT j, y FROM g WHERE j < (SELECT max(j) FROM g)) b ON b.y <= asked.y GROUP BY ALL),
    ends AS (SELECT id, o.x AS x0, o.y AS y0, p.x - o.x AS hx, p.y - o.y AS hy, (held.x - o.x) / (p.x - o.x) AS u, (held.y - o.y) / (p.y - o.y) AS v, held.i, held.j FROM held JOIN g o ON o.i = held.i AND o.j = held.j JOIN g p ON p.i = held.i + 1 AND p.j = held.j + 1),
    parts AS (SELECT id, hx, hy, a, b, CASE a WHEN 0 THEN 1 - 3 * u * u + 2 * u * u * u ELSE 3 * u * u - 2 * u * u * u END AS hu, CASE a WHEN 0 THEN u - 2 * u * u + u * u * u ELSE u * u * u - u * u END AS ku,
      CASE b WHEN 0 THEN 1 - 3 * v * v + 2 * v * v * v ELSE 3 * v * v - 2 * v * v * v END AS hv, CASE b WHEN 0 THEN v - 2 * v * v + v * v * v ELSE v * v * v - v * v END AS kv, i + a AS i, j + b AS j FROM ends, (VALUES (0), (1)) s(a), (VALUES (0), (1)) t(b))"""


@query(f"WITH RECURSIVE {_GRID}, nodes AS ({SQL_VIEWS['nodes']}), {_SURFACE}, {_EVALUATED} SELECT id, round(sum(hu * hv * f + ku * hx * hv * fx + hu * kv * hy * fy + ku * kv * hx * hy * fxy), 6) AS f FROM parts JOIN full_grid USING (i, j) GROUP BY id")
def spline_sample(spark, sf_dir):
    points = nodes(spark, sf_dir).select("id", ((F.col("lon") + 180) / 8).alias("x"), ((F.col("lat") + 80) / 12).alias("y"))
    return rounded(splines.spline_at(points, _grid(spark, sf_dir), "f"), 6, "f")
