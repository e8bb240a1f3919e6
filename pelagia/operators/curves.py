"""Closed curves: iso-contours of gridded fields, their areas, circles and the cells inside, as joins and sums.

A contour is traced without walking along it. Marching squares gives each cell's oriented segments between points
on grid edges; segments that share such a point belong to one ring, found by distributed union-find. Area and circle
are sums over segments in any order. A ring meets grid row j in its points on that row; sorted and paired they
are the spans of cells inside.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from .components import components


def contour_segments(field: DataFrame, levels: Sequence[float], value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Oriented segments of all iso-contours of a grid (by..., i, j, value): (by, level, p, q, px, py, qx, qy) in index units.

    ``p`` and ``q`` name grid edges as strings; cells with a null corner have none. Values at a level count as above it, which lies to
    the left. Squares with two opposite corners above are cut by the mean of the corners. A level's number is its index.
    """
    wi = Window.partitionBy(*by, "j").orderBy("i")
    wj = Window.partitionBy(*by, "i").orderBy("j")
    right = F.when(F.lead("i").over(wi) == F.col("i") + 1, F.lead(value).over(wi))
    cells = field.select(*by, "i", "j", F.col(value).cast("double").alias("a")).withColumnRenamed("a", value).withColumn("b", right)
    up = lambda c: F.when(F.lead("j").over(wj) == F.col("j") + 1, F.lead(c).over(wj))
    cells = cells.withColumns({"d": up(value), "c": up("b")}).withColumnRenamed(value, "a").where("a + b + c + d is not null")
    low, high = F.least("a", "b", "c", "d"), F.greatest("a", "b", "c", "d")
    wanted = F.array(*[F.struct(F.lit(k).alias("n"), F.lit(float(z)).alias("z")) for k, z in enumerate(levels)])
    cells = cells.withColumn("lv", F.explode(F.filter(wanted, lambda x: (x["z"] > low) & (x["z"] <= high))))
    cells = cells.select(*by, "i", "j", "a", "b", "c", "d", F.col("lv.n").alias("level"), F.col("lv.z").alias("z"))
    # points on the four edges: south, east, north, west
    cut = lambda p, q: (F.col("z") - F.col(p)) / (F.col(q) - F.col(p))
    name = lambda kind, di, dj: F.concat(F.lit(kind), (F.col("i") + di).cast("string"), F.lit(","), (F.col("j") + dj).cast("string"))
    point = lambda kind, di, dj, x, y: F.struct(name(kind, di, dj).alias("e"), x.alias("x"), y.alias("y"))
    i, j = F.col("i").cast("double"), F.col("j").cast("double")
    s = point("h", 0, 0, i + cut("a", "b"), j)
    e = point("v", 1, 0, i + 1, j + cut("b", "c"))
    n = point("h", 0, 1, i + cut("d", "c"), j + 1)
    w = point("v", 0, 0, i, j + cut("a", "d"))
    case = sum(((F.col(x) >= F.col("z")).cast("int") * k for x, k in (("b", 2), ("c", 4), ("d", 8))), (F.col("a") >= F.col("z")).cast("int"))
    middle = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4 >= F.col("z")
    seg = lambda *ends: F.array(*[F.struct(p.alias("p"), q.alias("q")) for p, q in ends])
    # From where to where the line runs with the corners above it on its left, by case of corners above.
    table = {
        1: seg((s, w)), 2: seg((e, s)), 3: seg((e, w)), 4: seg((n, e)), 6: seg((n, s)), 7: seg((n, w)), 8: seg((w, n)), 9: seg((s, n)),
        11: seg((e, n)), 12: seg((w, e)), 13: seg((s, e)), 14: seg((w, s)),
    }
    chosen = F.when(F.col("case") == 5, F.when(F.col("middle"), seg((s, e), (n, w))).otherwise(seg((s, w), (n, e))))
    chosen = chosen.when(F.col("case") == 10, F.when(F.col("middle"), seg((w, s), (e, n))).otherwise(seg((e, s), (w, n))))
    for k, v in table.items():
        chosen = chosen.when(F.col("case") == k, v)
    out = cells.withColumns({"case": case, "middle": middle}).where("case > 0 and case < 15").withColumn("t", F.explode(chosen))
    return out.select(*by, "level", "z", F.col("t.p.e").alias("p"), F.col("t.q.e").alias("q"), F.col("t.p.x").alias("px"), F.col("t.p.y").alias("py"), F.col("t.q.x").alias("qx"), F.col("t.q.y").alias("qy"))


def rings(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Segments of closed contours with their ``ring`` (a number). Open lines go: one of their points begins or ends only one segment."""
    node = lambda e: F.xxhash64(*by, "level", e)
    named = staged(segments.withColumns({"u": node("p"), "v": node("q")}), "segments")
    root = components(named.select("u", "v"))
    named = named.join(root.withColumnRenamed("component", "ring"), "u")
    # ring by ring: closed if each point is left as often as it is reached
    ends = named.select("ring", F.col("u").alias("x"), F.lit(1).alias("d")).union(named.select("ring", F.col("v"), F.lit(-1)))
    open_rings = ends.groupBy("ring", "x").agg(F.sum("d").alias("d")).where("d <> 0").select("ring").distinct()
    return staged(named.join(open_rings, "ring", "left_anti").drop("u", "v"), "rings")


def ring_area(x1: str = "px", y1: str = "py", x2: str = "qx", y2: str = "qy") -> Column:
    """Signed area of the rows of a group: the shoelace sum over oriented segments in any order."""
    return F.sum(F.col(x1) * F.col(y2) - F.col(x2) * F.col(y1)) / 2


def polygon_area(df: DataFrame, ring: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """Rows (ring, area) of polygons given by ordered vertices; the last vertex joins the first."""
    w = Window.partitionBy(ring).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {f"__{c}": F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in (x, y)}
    return df.withColumns(nxt).groupBy(ring).agg(F.abs(F.sum(F.col(x) * F.col(f"__{y}") - F.col(f"__{x}") * F.col(y)) / 2).alias("area"))


def fit_circle(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rows (keys, xc, yc, radius, n): the least-squares circle through a group's points.

    Sums of products about the group's mean give the normal equations, solved by Cramer's rule; points on a line give null.
    """
    mean = df.groupBy(*keys).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    p = df.join(mean, list(keys)).withColumns({"__x": F.col(x) - F.col("__mx"), "__y": F.col(y) - F.col("__my")})
    u, v = F.col("__x"), F.col("__y")
    s = {"n": F.lit(1.0), "uu": u * u, "vv": v * v, "uv": u * v, "uuu": u * (u * u + v * v), "vvv": v * (u * u + v * v)}
    p = p.groupBy(*keys).agg(F.first("__mx").alias("mx"), F.first("__my").alias("my"), *[F.sum(c).alias(k) for k, c in s.items()])
    det = F.nullif(F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv"), F.lit(0.0)) * 2
    a = (F.col("uuu") * F.col("vv") - F.col("vvv") * F.col("uv")) / det
    b = (F.col("vvv") * F.col("uu") - F.col("uuu") * F.col("uv")) / det
    p = p.withColumns({"__a": a, "__b": b})
    radius = F.sqrt(F.col("__a") * F.col("__a") + F.col("__b") * F.col("__b") + (F.col("uu") + F.col("vv")) / F.col("n"))
    return p.select(*keys, (F.col("mx") + F.col("__a")).alias("xc"), (F.col("my") + F.col("__b")).alias("yc"), radius.alias("radius"), F.col("n").cast("long").alias("n"))


def disc_overlap(x1: Column, y1: Column, x2: Column, y2: Column, radius: Column) -> Column:
    """Signed area that the triangle of an edge and the origin shares with the disc of ``radius`` about the origin: the edge's parts outside count as sectors.

    The sum over a polygon's edges, in any order, is the area that the polygon shares with the disc.
    """
    dx, dy = x2 - x1, y2 - y1
    a, b, c = dx * dx + dy * dy, x1 * dx + y1 * dy, x1 * x1 + y1 * y1 - radius * radius
    root = F.sqrt(F.greatest(b * b - a * c, F.lit(0.0)))
    # where the edge enters and leaves the disc
    enter, leave = (F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) for t in ((-b - root) / F.nullif(a, F.lit(0.0)), (-b + root) / F.nullif(a, F.lit(0.0))))
    sector = lambda ax, ay, bx, by: radius * radius / 2 * F.atan2(ax * by - ay * bx, ax * bx + ay * by)
    ex, ey, lx, ly = x1 + enter * dx, y1 + enter * dy, x1 + leave * dx, y1 + leave * dy
    crossing = F.when(enter > 0, sector(x1, y1, ex, ey)).otherwise(0.0) + (ex * ly - ey * lx) / 2 + F.when(leave < 1, sector(lx, ly, x2, y2)).otherwise(0.0)
    outside = (b * b - a * c <= 0) | (enter >= leave)
    return F.when(a == 0, 0.0).when(outside, sector(x1, y1, x2, y2)).otherwise(crossing)


def circle_error(edges: DataFrame, circles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, error): how far a closed curve is from its circle, in per cent of the circle's area.

    The error is the part of the disc that the curve leaves out and the part of the curve outside the disc. ``edges`` are (keys, x1, y1, x2, y2) in
    any order, ``circles`` (keys, xc, yc, radius); circles that are null give null.
    """
    rows = edges.join(circles.select(*keys, "xc", "yc", "radius"), list(keys))
    x1, x2 = F.col("x1") - F.col("xc"), F.col("x2") - F.col("xc")
    y1, y2 = F.col("y1") - F.col("yc"), F.col("y2") - F.col("yc")
    sums = rows.groupBy(*keys).agg(F.abs(F.sum(x1 * y2 - x2 * y1) / 2).alias("own"), F.abs(F.sum(disc_overlap(x1, y1, x2, y2, F.col("radius")))).alias("shared"), F.max("radius").alias("radius"))
    disc = F.lit(math.pi) * F.col("radius") * F.col("radius")
    return sums.select(*keys, (100 * (disc + F.col("own") - 2 * F.col("shared")) / F.nullif(disc, F.lit(0.0))).alias("error"))


def polygon_edges(df: DataFrame, ring: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """Edges (ring, x1, y1, x2, y2) of polygons given by ordered vertices; the last vertex joins the first."""
    w = Window.partitionBy(ring).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = [F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(f"{n}2") for c, n in ((x, "x"), (y, "y"))]
    return df.select(ring, F.col(x).alias("x1"), F.col(y).alias("y1"), *nxt)


def spans(ring_segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, ring, j, x1, x2): the parts of grid rows inside each ring, from its points on horizontal grid edges."""
    on_row = ring_segments.where(F.col("p").startswith("h")).select(*keys, "ring", F.col("py").cast("int").alias("j"), F.col("px").alias("x"))
    w = Window.partitionBy("ring", "j").orderBy("x")
    paired = on_row.withColumns({"k": F.row_number().over(w), "x2": F.lead("x").over(w)})
    return paired.where("k % 2 = 1").select(*keys, "ring", "j", F.col("x").alias("x1"), "x2")


def inside_count() -> Column:
    """Cells of a group's spans: whole numbers in [x1, x2]."""
    return F.sum(F.floor("x2") - F.ceil("x1") + 1)
