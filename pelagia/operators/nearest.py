"""Nearest neighbours in the plane by a tree of boxes that follows the points' density: exact, without a cross join.

Points are sorted along a Z-order curve across all tasks; every ``LEAF`` of them in a row are a leaf, every ``FAN`` leaves a node, and so on, each with the
bounds of its points. Queries walk down from the top: at each level they are joined with the children of the nodes that they still
have, and keep those that can hold a neighbour: whose least distance is not over the smallest of largest distances to a node with
enough points. So each query meets a few leaves, wherever it lies and however uneven the points are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM
from ..staging import staged

#: Points of a leaf and children of a node, as powers of two.
LEAF_BITS, FAN_BITS = 4, 4
#: Bits of each coordinate in the order of points; bits of a row's number in :func:`pyspark.sql.functions.monotonically_increasing_id`.
CURVE_BITS, ROW_BITS = 31, 33
#: Nodes of a level that are broadcast at most (about 60 bytes each); larger levels are joined by shuffle.
BROADCAST_NODES = 200_000
#: Rows of one place that :func:`pairs_within` keeps in one list, and pairs of rows that it compares in a block, about.
PLACE_ROWS, BLOCK_PAIRS = 256, 1 << 21
#: Rows that a task of :func:`pairs_within` has on average at most, and the most tasks that it asks for.
TASK_ROWS, MOST_TASKS = 200_000, 1 << 14


def _apart(x: Column) -> Column:
    """The bits of a whole number of ``CURVE_BITS`` with a gap between each two."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _tree(points: DataFrame, most_of_a_place: int = 1 << 30) -> tuple[DataFrame, list[tuple[DataFrame, int]]]:
    """Points (p, px, py, leaf), and levels of nodes (node, x1, x2, y1, y2, n), each with the most nodes that it can have, from the top, of at most 2 ** ``FAN_BITS`` nodes, to the leaves.

    Ids of a level are those of the next one without their last ``FAN_BITS`` bits. Of points at one place at most ``most_of_a_place`` are kept.
    """
    x1, x2, y1, y2, n = points.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py"), F.count("*")).first()
    size = max((x2 or 0.0) - (x1 or 0.0), (y2 or 0.0) - (y1 or 0.0)) or 1.0
    at = lambda c, low: F.least(F.floor((F.col(c) - (low or 0.0)) / size * (1 << CURVE_BITS)), F.lit((1 << CURVE_BITS) - 1)).cast("long")
    curve = _apart(at("px", x1)).bitwiseOR(F.shiftleft(_apart(at("py", y1)), 1))
    tasks = max(1, min(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), n >> 12))
    if most_of_a_place < n:
        place = Window.partitionBy("px", "py").orderBy("p")
        points = points.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= most_of_a_place)
    rows = points.select("p", "px", "py", curve.alias("__z"))
    rows = (rows.repartitionByRange(tasks, "__z", "p") if tasks > 1 else rows.coalesce(1)).sortWithinPartitions("__z", "p")
    rows = staged(rows.select("p", "px", "py", F.monotonically_increasing_id().alias("row")), "curve")
    longest = rows.agg(F.max(F.col("row").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))).first()[0] or 0 if tasks > 1 else max(0, n - 1)
    # a leaf's number: its task's number, then its place among the task's leaves in as many bits as the longest has
    bits = max(0, longest >> LEAF_BITS).bit_length()
    place = F.shiftright(F.col("row").bitwiseAND(F.lit((1 << ROW_BITS) - 1)), LEAF_BITS)
    rows = rows.select("p", "px", "py", F.shiftleft(F.shiftright("row", ROW_BITS), bits).bitwiseOR(place).alias("leaf"))
    bounds = [F.min("px").alias("x1"), F.max("px").alias("x2"), F.min("py").alias("y1"), F.max("py").alias("y2"), F.count("*").alias("n")]
    leaves = rows.groupBy(F.col("leaf").alias("node")).agg(*bounds)
    height = max(0, -(-(bits + (tasks - 1).bit_length() - FAN_BITS) // FAN_BITS))
    leaves = staged(leaves, "leaves") if height > 1 else leaves
    above = [F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2"), F.sum("n").alias("n")]
    levels = [(leaves.groupBy(F.shiftright("node", FAN_BITS * k).alias("node")).agg(*above) if k else leaves, (n >> (LEAF_BITS + FAN_BITS * k)) + 2 * tasks) for k in range(height, -1, -1)]
    return rows, levels


def k_nearest(queries: DataFrame, points: DataFrame, k: int = 1) -> DataFrame:
    """Rows (q, p, d2, rank): the k nearest ``points`` (p, x, y) of each of ``queries`` (q, x, y) by squared distance, ties
    by smaller p. Queries have fewer rows only where there are fewer points. Null positions are left out; points and queries at one place are folded. Jobs over the points run while this is called.
    """
    usable = "x is not null and y is not null and not isnan(x) and not isnan(y)"
    # at most k points of a place can count
    points, levels = _tree(points.where(usable).select("p", F.col("x").alias("px"), F.col("y").alias("py")), k)
    asked = queries.where(usable).select("q", "x", "y")
    names = ("node", "x1", "x2", "y1", "y2", "n")
    top = [tuple(r) for r in levels[0][0].select(*names).collect()]  # at most 2 ** FAN_BITS rows
    first = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, r, strict=True)]) for r in top]) if top else F.array().cast("array<struct<node:bigint,x1:double,x2:double,y1:double,y2:double,n:bigint>>")
    met = asked.select("x", "y").distinct().withColumn("b", F.explode(first)).select("x", "y", "b.*")
    met = _able(met, k)
    for level, size in levels[1:]:
        children = level.withColumn("up", F.shiftright("node", FAN_BITS))
        children = F.broadcast(children) if size <= BROADCAST_NODES else children
        met = _able(met.withColumnRenamed("node", "up").join(children, "up").drop("up"), k)
    found = met.withColumnRenamed("node", "leaf").join(points, "leaf")
    d2 = (F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y"))
    order = Window.partitionBy("x", "y").orderBy("d2", "p")
    ranked = found.select("x", "y", "p", d2.alias("d2")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked.join(ranked, ["x", "y"]).select("q", "p", "d2", F.col("rank").cast("int").alias("rank"))


def _able(met: DataFrame, k: int) -> DataFrame:
    """Of (x, y, node, bounds, n) those nodes (x, y, node) that can hold one of the k nearest points of (x, y)."""
    beside = lambda c: F.greatest(F.col(f"{c}1") - F.col(c), F.col(c) - F.col(f"{c}2"), F.lit(0.0))
    beyond = lambda c: F.greatest(F.abs(F.col(f"{c}1") - F.col(c)), F.abs(F.col(f"{c}2") - F.col(c)))
    near, far = (f("x") * f("x") + f("y") * f("y") for f in (beside, beyond))
    if k == 1:  # each side of the bounds has a point: on the nearer side of one direction it is at most so far
        side = lambda c: F.least(F.abs(F.col(f"{c}1") - F.col(c)), F.abs(F.col(f"{c}2") - F.col(c)))
        far = F.least(side("x") * side("x") + beyond("y") * beyond("y"), beyond("x") * beyond("x") + side("y") * side("y"))
    least = F.min(F.when(F.col("n") >= k, far)).over(Window.partitionBy("x", "y"))
    met = met.withColumns({"near": near, "bound": least})
    return met.where("bound is null or near <= bound").select("x", "y", "node")


def nearest(queries: DataFrame, points: DataFrame) -> DataFrame:
    """Rows (q, p, d2): the nearest point of each query."""
    return k_nearest(queries, points, 1).drop("rank")


def distance_weighted(neighbours: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Rows (q, value): mean of the neighbours' values with weights that grow with the distance, as the eddy radius look-up
    defines it (equal weights where all distances are 0). ``values`` has (p, value)."""
    d = F.sqrt("d2")
    both = neighbours.join(values.select("p", value), "p")
    return both.groupBy("q").agg(F.coalesce(F.sum(d * F.col(value)) / F.nullif(F.sum(d), F.lit(0.0)), F.avg(value)).alias(value))


def fill_nearest(cells: DataFrame, value: str, k: int = 4) -> DataFrame:
    """Cells (id, x, y, value): null values become the mean of the equally nearest known ones among the ``k`` nearest."""
    good = cells.where(F.col(value).isNotNull()).select(F.col("id").alias("p"), "x", "y", value)
    bad = cells.where(F.col(value).isNull()).select(F.col("id").alias("q"), "x", "y")
    near = k_nearest(bad, good.drop(value), k)
    least = near.groupBy("q").agg(F.min("d2").alias("least"))
    made = near.join(least, "q").where("d2 = least").join(good.select("p", value), "p").groupBy(F.col("q").alias("id")).agg(F.avg(value).alias("__made"))
    return cells.join(made, "id", "left").withColumn(value, F.coalesce(value, "__made")).drop("__made")


def _at_places(df: DataFrame, place: Sequence[str], name: str) -> DataFrame:
    """``df`` with a row for each place and at most ``PLACE_ROWS`` of its rows: the other columns are a list of structs."""
    others = [c for c in df.columns if c not in place]
    number = F.row_number().over(Window.partitionBy(*place).orderBy(*place))
    rows = df.withColumn("__n", F.floor((number - 1) / PLACE_ROWS))
    return rows.groupBy(*place, "__n").agg(F.collect_list(F.struct(*others) if others else F.struct(F.lit(0).alias("__0"))).alias(name))


def pairs_within(a: DataFrame, b: DataFrame, distance: Column, limit: float, radius: float = EARTH_KM, keys: Sequence[str] = (), also: Column | None = None) -> DataFrame:
    """Pairs of rows (keys..., a_id, ax, ay) and (keys..., b_id, bx, by) of equal ``keys`` whose ``distance`` is at most ``limit``.

    x is a longitude of any turn and y a latitude, in degrees; ``distance`` and ``limit`` are on the sphere of ``radius``; ``distance`` and the condition
    ``also`` are of ax, ay, bx and by and are computed once for two places. Rows of bins are as high as the limit. Each has as many columns, cyclic, as are as wide as a pair can reach
    at the row's widest latitude, and one column if a pole may be in reach. Bins of many pairs are dealt into blocks; pairs are counted first, and there are as many tasks as
    these counts ask for, since bytes say little of the work. Neither side is broadcast. A job over both sides runs while this is called.
    """
    keys = list(keys)
    high = math.degrees(limit / radius) * (1 + 1e-6)
    top = lambda row: F.greatest(F.abs(row * high), F.abs((row + 1) * high))
    # longitudes differ by at most asin(sin(reach) / cos(lat)), if no pole is in reach of either end
    wide = lambda row: F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(min(high, 90.0))) / F.cos(F.radians(F.least(top(row), F.lit(89.0)))))))
    n_cols = lambda row: F.when(top(row) + high >= 89, F.lit(1)).otherwise(F.floor(360.0 / wide(row)))
    col = lambda x, row: F.least(F.floor(F.pmod(x, F.lit(360.0)) * n_cols(row) / 360.0), n_cols(row) - 1)
    near, row, bin_ = F.array(F.lit(-1), F.lit(0), F.lit(1)), F.col("__y"), [*keys, "__x", "__y"]
    rows_of = lambda df: df.withColumn("__y", F.explode(F.transform(near, lambda k: F.floor(F.col("ay") / high) + k)))
    left_bins = lambda df: rows_of(df).withColumn("__x", F.explode(F.array_distinct(F.transform(near, lambda k: F.pmod(col(F.col("ax"), row) + k, n_cols(row))))))
    right_bins = lambda df: df.withColumn("__y", F.floor(F.col("by") / high)).withColumn("__x", col(F.col("bx"), row))
    size = lambda df, place, bins, name: bins(df.groupBy(*keys, *place).agg(F.count("*").cast("double").alias("__n"))).groupBy(*bin_).agg(F.sum("__n").alias(name))
    sizes = size(a, ("ax", "ay"), left_bins, "__a_n").join(size(b, ("bx", "by"), right_bins, "__b_n").hint("merge"), bin_, "full").na.fill(0.0, ["__a_n", "__b_n"])
    sizes = staged(sizes.select(*bin_, (F.col("__a_n") + F.col("__b_n")).alias("__rows"), F.ceil(F.col("__a_n") * F.col("__b_n") / BLOCK_PAIRS).alias("__blocks"), (F.col("__a_n") * F.col("__b_n")).alias("__pairs")), "bins")
    pairs, rows = sizes.agg(F.sum("__pairs"), F.sum("__rows")).first()
    tasks = min(MOST_TASKS, max(1, math.ceil((pairs or 0.0) / BLOCK_PAIRS), math.ceil((rows or 0.0) / TASK_ROWS)))
    left, right = left_bins(_at_places(a, [*keys, "ax", "ay"], "__a")), right_bins(_at_places(b, [*keys, "bx", "by"], "__b"))
    # a bin with more than BLOCK_PAIRS pairs of rows: at most one for so many pairs, so these few are broadcast
    full = sizes.where("__blocks > 1").select(*bin_, "__blocks")
    dealt = lambda df: df.join(F.broadcast(full), bin_, "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    left = dealt(left).withColumn("__block", F.pmod(F.xxhash64("ax", "ay", "__n"), F.col("__blocks"))).drop("__blocks", "__n")
    right = dealt(right).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1))).drop("__blocks", "__n")
    left, right = (df.repartition(tasks, *bin_, "__block") for df in (left, right))
    met = left.join(right.hint("merge"), [*bin_, "__block"]).withColumn("distance", distance).where(F.col("distance") <= limit)
    met = met if also is None else met.where(also)
    place = [*keys, "ax", "ay", "bx", "by", "distance"]
    met = met.select(*place, "__b", F.explode("__a").alias("__a")).select(*place, "__a", F.explode("__b").alias("__b"))
    side = lambda df, name, own: [F.col(c) if c in own else F.col(f"{name}.{c}").alias(c) for c in df.columns if c not in keys]
    return met.select(*keys, *side(a, "__a", ("ax", "ay")), *side(b, "__b", ("bx", "by")), "distance")
