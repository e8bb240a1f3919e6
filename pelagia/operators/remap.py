"""Remapping between grids as sparse joins: links (src, dst, w1[, w2, w3]) are built once and serve all attributes.

Destination cells of many links are summed map-side first. A source cell of many links is a skewed join key;
Spark's adaptive skew join splits it, since no operator above needs its rows together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import overlap
from ..staging import staged


def apply_links(source: DataFrame, links: DataFrame, target: DataFrame | None, names: Sequence[str], gradients: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Rows (dst, attributes): sum of w1 * value, plus w2 and w3 times the gradients where they are given.

    ``source`` has a row per ``src``. With ``target`` (rows ``dst``) every destination cell has a row, 0.0 where
    no link ends. Null values and links to absent cells add nothing.
    """
    grads = gradients or {}
    kept = source.select("src", *dict.fromkeys([*names, *[g for n in names for g in grads.get(n, ())]]))
    joined = links.join(kept, "src")

    def value(n: str) -> Column:
        out = F.col("w1") * F.col(n)
        if n in grads:
            x, y = grads[n]
            out = out + F.col("w2") * F.col(x) + F.col("w3") * F.col(y)
        return F.sum(out).alias(n)

    out = joined.groupBy("dst").agg(*[value(n) for n in names])
    if target is None:
        return out
    return target.select("dst").join(out, "dst", "left").select("dst", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def staggered(nodes: DataFrame, elements: DataFrame, target: DataFrame, links: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Attributes of a mesh remapped to another one over links of triangles: rows (elem, attributes) and (node, attributes).

    Names that triangles have are remapped as they are; the other ones are averaged into the source's triangles, remapped and
    averaged into the target's nodes. Null values are left out of these averages. Names that neither has raise KeyError.
    """
    corners = F.array("n1", "n2", "n3")
    own = [n for n in names if n in elements.columns]
    at_nodes = [n for n in names if n not in own]
    if missing := [n for n in at_nodes if n not in nodes.columns]:
        raise KeyError(f"no such attribute: {', '.join(missing)}")
    cells = target.select(F.col("elem").alias("dst"))
    of_cells = apply_links(elements.withColumnRenamed("elem", "src"), links, cells, own) if own else cells
    of_cells = of_cells.withColumnRenamed("dst", "elem")
    ends = target.select("elem", F.explode(corners).alias("node"))
    if not at_nodes:
        return of_cells, ends.select("node").distinct()
    inside = elements.select("elem", F.explode(corners).alias("node")).join(nodes.select("node", *at_nodes), "node")
    inside = inside.groupBy(F.col("elem").alias("src")).agg(*[F.avg(n).alias(n) for n in at_nodes])
    moved = apply_links(inside, links, cells, at_nodes).withColumnRenamed("dst", "elem")
    return of_cells, ends.join(moved, "elem").groupBy("node").agg(*[F.avg(n).alias(n) for n in at_nodes])


def unlinked(target: DataFrame, links: DataFrame) -> DataFrame:
    """Destination cells that no link ends in."""
    return target.join(links, "dst", "left_anti")


def normalised(links: DataFrame) -> DataFrame:
    """First-order links whose weights sum to 1 per destination; those that sum to 0 are left out."""
    total = links.groupBy("dst").agg(F.sum("w1").alias("total"))
    return links.join(total, "dst").where("total <> 0").withColumn("w1", F.col("w1") / F.col("total")).drop("total")


def box_links(source: DataFrame, target: DataFrame, cell: float, spherical: bool = False) -> DataFrame:
    """Conservative links of boxes: w1 = shared area over the destination's area.

    Both have (id, x1, x2, y1, y2); with ``spherical`` these are degrees and areas are proportional to
    dx * (sin y2 - sin y1). Boxes meet in bins of ``cell``; a pair is kept only in the bin of its lower left
    corner, so that boxes over several bins give one link. Choose ``cell`` near the larger boxes' size.
    """

    def binned(df: DataFrame, name: str) -> DataFrame:
        span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
        cols = [F.col(c).alias(f"{name}_{c}") for c in ("id", "x1", "x2", "y1", "y2")]
        return df.select(*cols, span("x1", "x2").alias("bx")).withColumn("by", span(f"{name}_y1", f"{name}_y2"))

    both = binned(source, "s").join(binned(target, "t"), ["bx", "by"])
    both = both.where((F.floor(F.greatest("s_x1", "t_x1") / cell) == F.col("bx")) & (F.floor(F.greatest("s_y1", "t_y1") / cell) == F.col("by")))
    height = lambda a, b: (F.sin(F.radians(b)) - F.sin(F.radians(a))) if spherical else b - a
    shared = overlap("s_x1", "s_x2", "t_x1", "t_x2") * F.greatest(F.lit(0.0), height(F.greatest("s_y1", "t_y1"), F.least("s_y2", "t_y2")))
    whole = (F.col("t_x2") - F.col("t_x1")) * height(F.col("t_y1"), F.col("t_y2"))
    return both.where(shared > 0).select(F.col("s_id").alias("src"), F.col("t_id").alias("dst"), (shared / whole).alias("w1"))


def bilinear_links(points: DataFrame, x0: float, y0: float, dx: float, dy: float, nx: int, ny: int) -> DataFrame:
    """Links (i, j, dst, w1) from grid points (x0 + i dx, y0 + j dy) to ``points`` (dst, x, y), clamped to the grid's edge."""
    fx = F.greatest(F.lit(0.0), F.least(F.lit(float(nx - 1)), (F.col("x") - x0) / dx))
    fy = F.greatest(F.lit(0.0), F.least(F.lit(float(ny - 1)), (F.col("y") - y0) / dy))
    i, j = F.least(F.floor("fx"), F.lit(max(nx - 2, 0))), F.least(F.floor("fy"), F.lit(max(ny - 2, 0)))
    p = points.select("dst", fx.alias("fx"), fy.alias("fy")).select("dst", i.alias("i"), j.alias("j"), (F.col("fx") - i).alias("a"), (F.col("fy") - j).alias("b"))
    corners = [(0, 0, (1 - F.col("a")) * (1 - F.col("b"))), (1, 0, F.col("a") * (1 - F.col("b"))), (0, 1, (1 - F.col("a")) * F.col("b")), (1, 1, F.col("a") * F.col("b"))]
    corner = F.explode(F.array(*[F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), w.alias("w1")) for di, dj, w in corners]))
    return p.select("dst", corner.alias("c")).select("dst", "c.*").where("w1 <> 0")


def sample(field: DataFrame, links: DataFrame, names: Sequence[str]) -> DataFrame:
    """Attributes of a grid (i, j, ...) at the points of :func:`bilinear_links`."""
    return links.join(field.select("i", "j", *names), ["i", "j"]).groupBy("dst").agg(*[F.sum(F.col("w1") * F.col(n)).alias(n) for n in names])


def box_samples(points: DataFrame, field: DataFrame, dx: float, dy: float, nx: int, ny: int, names: Sequence[str]) -> DataFrame:
    """Means of a grid over squares of side ``d`` about points (dst, x, y, d): rows (dst, attributes).

    Node (i, j) from 0 stands at (i dx, j dy) and owns the cell around it; squares over the edge use the edge's values.
    """
    first = lambda c, d: F.floor((F.col(c) - F.col("d") / 2) / d + 0.5)
    last = lambda c, d: F.floor((F.col(c) + F.col("d") / 2) / d + 0.5)
    cells = points.withColumn("ci", F.explode(F.sequence(first("x", dx), last("x", dx)))).withColumn("cj", F.explode(F.sequence(first("y", dy), last("y", dy))))
    half = F.col("d") / 2
    share = overlap(F.col("x") - half, F.col("x") + half, (F.col("ci") - 0.5) * dx, (F.col("ci") + 0.5) * dx)
    share = share * overlap(F.col("y") - half, F.col("y") + half, (F.col("cj") - 0.5) * dy, (F.col("cj") + 0.5) * dy)
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c)))
    cells = cells.select("dst", clamp("ci", nx).cast("int").alias("i"), clamp("cj", ny).cast("int").alias("j"), (share / (F.col("d") * F.col("d"))).alias("w1")).where("w1 > 0")
    return sample(field, cells, names)


def from_parent(points: DataFrame, parent: DataFrame, own_size: float, dx: float, dy: float, nx: int, ny: int, names: Sequence[str]) -> DataFrame:
    """A refinement's points (dst, x, y) from its parent grid: means over squares as large as the larger cells of both."""
    return box_samples(points.withColumn("d", F.lit(max(own_size, dx))), parent, dx, dy, nx, ny, names)


def numbered(links: DataFrame) -> DataFrame:
    """``links`` with ``link``, their number (from 0) in order of destination, source and weights.

    They are sorted across tasks; what comes before a task's first link is a sum over a row a task.
    """
    spark = links.sparkSession
    order = ["dst", "src", *[c for c in links.columns if c not in ("dst", "src")]]
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = links.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id())
    rows = staged(rows, "sorted_links").withColumns({"__part": F.shiftright("__row", 33), "__row": F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row a task
    return rows.join(F.broadcast(before), "__part").withColumn("link", F.col("__row") + F.col("__before")).select(*links.columns, "link")


def cell_corners(df: DataFrame, nx: int) -> DataFrame:
    """Adds ``corners`` (SW, SE, NE, NW structs of lon, lat) of cells (i, j) from the points at their NE corners.

    The grid is cyclic in i. Below row 0 the corners lie at the same longitudes just above the south pole (degrees).
    """
    south = -90.0 + 1e-12
    p = df.select("i", "j", F.struct("lon", "lat").alias("p"))
    west = p.select(((F.col("i") + 1) % nx).alias("i"), "j", F.col("p").alias("w"))
    below = p.select("i", (F.col("j") + 1).alias("j"), F.col("p").alias("s"))
    diagonal = p.select(((F.col("i") + 1) % nx).alias("i"), (F.col("j") + 1).alias("j"), F.col("p").alias("d"))
    joined = df.join(p, ["i", "j"]).join(west, ["i", "j"]).join(below, ["i", "j"], "left").join(diagonal, ["i", "j"], "left")
    mock = lambda c: F.struct(F.col(f"{c}.lon").alias("lon"), F.lit(south).alias("lat"))
    ring = F.array(F.coalesce("d", mock("w")), F.coalesce("s", mock("p")), F.col("p"), F.col("w"))
    return joined.withColumn("corners", ring).drop("p", "w", "s", "d")


def first_region(points: DataFrame, regions: DataFrame, cell: float) -> DataFrame:
    """Points (id, x, y) with the ``region`` of lowest ``priority`` that contains them, null outside all.

    Regions are boxes (region, priority, x1, x2, y1, y2), lower ends included; they meet points in bins of ``cell``.
    """
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    bins = regions.withColumn("bx", span("x1", "x2")).withColumn("by", span("y1", "y2"))
    p = points.withColumn("bx", F.floor(F.col("x") / cell)).withColumn("by", F.floor(F.col("y") / cell))
    hit = p.join(bins, ["bx", "by"]).where("x >= x1 and x < x2 and y >= y1 and y < y2")
    best = hit.groupBy("id").agg(F.min_by("region", F.struct("priority", "region")).alias("region"))
    return points.join(best, "id", "left")
