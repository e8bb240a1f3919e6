"""Unstructured meshes: nodes (node, x, y) and triangles (elem, n1, n2, n3), indices from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import plane_triangle_area, sphere_triangle_area_points

_CORNERS = ("n1", "n2", "n3")


def incidence(elements: DataFrame) -> DataFrame:
    """Rows (elem, corner, node): which nodes a triangle has, in their order."""
    return elements.select("elem", F.posexplode(F.array(*_CORNERS)).alias("corner", "node"))


def edges(elements: DataFrame) -> DataFrame:
    """Distinct undirected edges (a, b), a < b."""
    pairs = F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("n1", "n2"), ("n2", "n3"), ("n1", "n3"))])
    return elements.select(F.explode(pairs).alias("e")).select("e.*").distinct()


def neighbours(elements: DataFrame) -> DataFrame:
    """Rows (node, neighbours): the sorted nodes that share an edge. A node's degree bounds the array."""
    e = edges(elements)
    both = e.select(F.col("a").alias("node"), F.col("b").alias("other")).union(e.select(F.col("b").alias("node"), F.col("a").alias("other")))
    return both.groupBy("node").agg(F.sort_array(F.collect_set("other")).alias("neighbours"))


def _around(elements: DataFrame, *carried: str) -> DataFrame:
    """Rows (node, elem, own, others): ``own`` is the struct (elem, *carried) of a triangle at the node, ``others`` those of the triangles there
    that share exactly one more node with it. One shuffle, by node; a node's degree bounds the arrays.

    A triangle that names a node twice is there once; null nodes and ends meet no other triangle.
    """
    corners = F.array(*_CORNERS)
    at = elements.select(F.explode(F.array_distinct(corners)).alias("node"), *_CORNERS, F.struct("elem", *carried).alias("own")).repartition("node")
    ends = at.select("node", "own", F.explode_outer(F.array_except(corners, F.array("node"))).alias("end"))
    met = ends.groupBy("node", "end").agg(F.collect_list("own").alias("all")).select("node", "end", "all", F.explode("all").alias("own"))
    shared = F.col("node").isNotNull() & F.col("end").isNotNull()
    met = met.select("node", "own", F.filter("all", lambda o: shared & (o["elem"] != F.col("own.elem"))).alias("others"))
    met = met.groupBy("node", F.col("own.elem").alias("elem")).agg(F.first("own").alias("own"), F.flatten(F.collect_list("others")).alias("all"))
    once = F.filter("all", lambda o: F.size(F.filter("all", lambda x: x["elem"] == o["elem"])) == 1)
    return met.select("node", "elem", "own", once.alias("others"))


def cell_neighbours(elements: DataFrame) -> DataFrame:
    """Rows (node, elem, other): triangles at one node that share exactly one more node; ``other`` is null for those that have none."""
    return _around(elements).select("node", "elem", F.explode_outer("others.elem").alias("other"))


def boundary_nodes(elements: DataFrame) -> DataFrame:
    """Rows (node, boundary): a node is on the boundary if a triangle there has fewer than two neighbours around it."""
    return _around(elements).groupBy("node").agg((F.min(F.size("others")) < 2).alias("boundary"))


def with_corners(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triangles with corner positions x1..y3 and centre (x, y): one shuffle of the corners, no three-way join."""
    c = incidence(elements).join(nodes.select("node", "x", "y"), "node")
    made = [F.max(F.when(F.col("corner") == k, F.col(v))).alias(f"{v}{k + 1}") for k in range(3) for v in "xy"]
    c = c.groupBy("elem").agg(*made, F.avg("x").alias("x"), F.avg("y").alias("y"))
    return elements.join(c, "elem")


def with_areas(corners: DataFrame) -> DataFrame:
    """Adds ``area`` (plane, signed) and ``sphere_area`` (km2; x is longitude, y latitude in degrees)."""
    plane = plane_triangle_area("x1", "y1", "x2", "y2", "x3", "y3")
    sphere = sphere_triangle_area_points(("y1", "x1"), ("y2", "x2"), ("y3", "x3"))
    return corners.withColumns({"area": plane, "sphere_area": sphere})


def nodes_from_elements(elements: DataFrame, value: str, area: str | None = None) -> DataFrame:
    """Rows (node, value): mean over the triangles at a node, weighted by a third of their areas if ``area`` is given."""
    kept = elements.select("elem", *_CORNERS, value, *([area] if area else []))
    inc = kept.select(F.explode(F.array(*_CORNERS)).alias("node"), value, *([(F.col(area) / 3).alias("__w")] if area else [F.lit(1.0).alias("__w")]))
    return inc.groupBy("node").agg((F.sum(F.col(value) * F.col("__w")) / F.nullif(F.sum("__w"), F.lit(0.0))).alias(value))


def nodes_gathered(elements: DataFrame, value: str, area: str) -> DataFrame:
    """Rows (node, value): area-weighted mean of values extrapolated into the corners of the triangles (Loubère & Shashkov
    2005): (1 + n/2) times a triangle's own value less half of each of its n neighbours around the node."""
    kept = elements.select("elem", *_CORNERS, F.col(value).cast("double").alias("__value"), F.col(area).cast("double").alias("__area"))
    total = F.aggregate("others", F.lit(0.0), lambda s, o: s + F.coalesce(o["__value"], F.lit(0.0)))
    v, w = (1 + F.size("others") / 2) * F.col("own.__value") - total / 2, F.col("own.__area")
    at = _around(kept, "__value", "__area").select("node", v.alias("v"), w.alias("w"))
    return at.groupBy("node").agg((F.sum(F.col("v") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).alias(value))


def elements_from_nodes(elements: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Rows (elem, value): mean of the three corners."""
    return incidence(elements).join(nodes.select("node", value), "node").groupBy("elem").agg(F.avg(value).alias(value))


def square_domain(spark: SparkSession, length: float, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, triangles and boundary of a square of n x n cells, each cut into four triangles about its centre.

    Corner nodes are numbered row by row, centres follow. Boundary rows are (segment, seq, node), counter-clockwise from the
    south; a segment's first node is the last one of the segment before it.
    """
    d, m = length / n, n + 1
    corner = spark.range(m * m).select(F.col("id").alias("node"), (F.col("id") % m * d).alias("x"), (F.floor(F.col("id") / m) * d).alias("y"))
    cells = spark.range(n * n).select("id", (F.col("id") % n).alias("i"), F.floor(F.col("id") / n).alias("j"))
    centre = cells.select((F.col("id") + m * m).alias("node"), ((F.col("i") + 0.5) * d).alias("x"), ((F.col("j") + 0.5) * d).alias("y"))
    sw = F.col("j") * m + F.col("i")
    ring = [sw, sw + 1, sw + m + 1, sw + m, sw]
    parts = F.array(*[F.struct(a.alias("n1"), b.alias("n2")) for a, b in zip(ring[:-1], ring[1:], strict=True)])
    tri = cells.select("id", F.posexplode(parts).alias("k", "p"))
    tri = tri.select((F.col("id") * 4 + F.col("k")).alias("elem"), "p.n1", "p.n2", (F.col("id") + m * m).alias("n3"))
    t = F.col("id") % m
    side = F.floor(F.col("id") / m)
    node = F.when(side == 0, t).when(side == 1, t * m + n).when(side == 2, F.lit(m * m - 1) - t).otherwise((F.lit(n) - t) * m)
    boundary = spark.range(4 * m).select(side.cast("int").alias("segment"), t.cast("int").alias("seq"), node.alias("node"))
    return corner.union(centre), tri, boundary
