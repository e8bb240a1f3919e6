"""Finite differences and smoothing over grids (i, j): windows along grid lines, two per stencil, no self-joins.

A grid line is a window partition, so a grid of any number of lines spreads over tasks; extra leading keys (``by``,
such as a snapshot or a level) divide it further. Missing cells break a line: neighbours are the next cells that exist.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EDDY_EARTH_M, haversine
from ..functions.physics import coriolis


def _along(axis: str, by: Sequence[str]):
    return Window.partitionBy(*by, "j" if axis == "i" else "i").orderBy(axis)


def to_edges(df: DataFrame, value: str, axis: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of each cell and the next one along an axis; the last cell keeps its own."""
    nxt = F.lead(value).over(_along(axis, by))
    return df.withColumn(out, (F.col(value) + F.coalesce(nxt, F.col(value))) / 2)


def to_centres(df: DataFrame, value: str, axis: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of each cell and the one before it along an axis; the first cell keeps its own."""
    prev = F.lag(value).over(_along(axis, by))
    return df.withColumn(out, (F.col(value) + F.coalesce(prev, F.col(value))) / 2)


def four_point(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of a cell and its next neighbours along i, along j and across; edges repeat."""
    return to_edges(to_edges(df, value, "i", "__half", by), "__half", "j", out, by).drop("__half")


def cell_bounds(df: DataFrame, position: str, axis: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``lower`` and ``upper``: half way to the neighbours, extrapolated at the ends."""
    w = _along(axis, by)
    x = F.col(position)
    nxt, prev = F.lead(position).over(w), F.lag(position).over(w)
    upper, lower = (x + nxt) / 2, (x + prev) / 2
    return df.withColumns({"__u": upper, "__l": lower}).withColumns({
        "lower": F.coalesce("__l", 2 * x - F.col("__u"), x), "upper": F.coalesce("__u", 2 * x - F.col("__l"), x)
    }).drop("__u", "__l")


def difference(df: DataFrame, value: str, axis: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Next less own value; null at the end."""
    return df.withColumn(out, F.lead(value).over(_along(axis, by)) - F.col(value))


def gradient(df: DataFrame, value: str, position: str, axis: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Centred difference over positions, one-sided at the ends; null where there is no neighbour."""
    w = _along(axis, by)
    ends = [F.coalesce(f(c).over(w), F.col(c)) for c in (value, position) for f in (F.lead, F.lag)]
    return df.withColumn(out, (ends[0] - ends[1]) / F.nullif(ends[2] - ends[3], F.lit(0.0)))


def _ends(value: str, w) -> Column:
    """How many neighbours with a value a cell has along a line; null for none."""
    return F.nullif(F.lead(value).over(w).isNotNull().cast("int") + F.lag(value).over(w).isNotNull().cast("int"), F.lit(0))


def _across(axis: str, by: Sequence[str]) -> Column:
    """Distance (m) across a cell of (lon, lat) along an axis."""
    w = _along(axis, by)
    nxt = [F.coalesce(F.lead(c).over(w), F.col(c)) for c in ("lat", "lon")]
    prev = [F.coalesce(F.lag(c).over(w), F.col(c)) for c in ("lat", "lon")]
    return haversine(*prev, *nxt, EDDY_EARTH_M) / _ends("lat", w)


def _with_coriolis(df: DataFrame) -> DataFrame:
    f = coriolis("lat")
    return df.withColumns({"f": f, "gof": F.lit(9.81) / F.nullif(f, F.lit(0.0))})


def metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds f (Coriolis, 1/s), gof (g / f) and the distances dx and dy (m) across each cell of (i, j, lon, lat)."""
    return _with_coriolis(df.withColumn("dx", _across("i", by)).withColumn("dy", _across("j", by)))


def geostrophic(df: DataFrame, height: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds u, v and eke = (u2 + v2) / 2 from sea level (m); null next to missing cells and at the equator.

    What :func:`metrics` adds is taken from the grid, or added in the same windows where it isn't there: each axis takes one shuffle.
    """
    bare = "dx" not in df.columns
    for axis, out, slope in (("i", "dx", "__si"), ("j", "dy", "__sj")):
        w = _along(axis, by)
        step = F.coalesce(F.lead(height).over(w), F.col(height)) - F.coalesce(F.lag(height).over(w), F.col(height))
        df = df.withColumns({slope: step / _ends(height, w)} | ({out: _across(axis, by)} if bare else {}))
    if bare:
        df = _with_coriolis(df)
    u, v = -F.col("gof") * F.col("__sj") / F.col("dy"), F.col("gof") * F.col("__si") / F.col("dx")
    return df.withColumns({"u": u, "v": v}).drop("__si", "__sj").withColumn("eke", (F.col("u") * F.col("u") + F.col("v") * F.col("v")) / 2)


def okubo_weiss(df: DataFrame, x: str = "x", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Adds vorticity and okubo_weiss (strain squared less vorticity squared) of (u, v) on positions x, y."""
    for value, position, axis, out in (("u", x, "i", "__ux"), ("v", x, "i", "__vx"), ("u", y, "j", "__uy"), ("v", y, "j", "__vy")):
        df = gradient(df, value, position, axis, out, by)
    ux, vx, uy, vy = (F.col(c) for c in ("__ux", "__vx", "__uy", "__vy"))
    normal, shear, turn = ux - vy, vx + uy, vx - uy
    made = {"vorticity": turn, "okubo_weiss": normal * normal + shear * shear - turn * turn}
    return df.withColumns(made).drop("__ux", "__vx", "__uy", "__vy")


def hann(df: DataFrame, value: str, passes: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Smoothing by (sum of the n neighbours + (8 - n) own) / 8, ``passes`` times; null cells stay null and count as missing."""
    wi, wj = _along("i", by), _along("j", by)
    for _ in range(passes):
        near = [f(value).over(w) for w in (wi, wj) for f in (F.lag, F.lead)]
        total = sum((F.coalesce(c, F.lit(0.0)) for c in near), F.lit(0.0))
        count = sum((c.isNotNull().cast("int") for c in near), F.lit(0))
        df = df.withColumn(value, F.when(F.col(value).isNotNull(), (total + (8 - count) * F.col(value)) / 8))
    return df


def gaussian(df: DataFrame, value: str, sigma_i: float, sigma_j: float, by: Sequence[str] = ()) -> DataFrame:
    """Separable Gaussian low pass cut at 4 sigma, with edges mirrored (the edge cell twice). Indices must be gapless from 0."""
    for axis, sigma in (("i", sigma_i), ("j", sigma_j)):
        if sigma <= 0:
            continue
        n = int(4 * sigma + 0.5)
        other = "j" if axis == "i" else "i"
        line = Window.partitionBy(*by, other)
        size = df.withColumn("__n", F.max(axis).over(line) + 1)
        k = F.explode(F.sequence(F.lit(-n), F.lit(n)))
        sent = size.select(*by, other, F.col(axis).alias("__from"), "__n", F.col(value).alias("__v"), k.alias("__k"))
        # a cell gives its value to those within reach, and its mirror images beyond the edges do as well
        period = 2 * F.col("__n")
        spots = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(-(n // 2) - 2), F.lit(n // 2 + 2)), lambda t: F.array(F.col("__from") + t * period, t * period - 1 - F.col("__from")))))
        sent = sent.select(*by, other, "__n", "__v", "__k", F.explode(spots).alias("__at")).withColumn("__to", F.col("__at") + F.col("__k")).where("__to >= 0 and __to < __n")
        weight = F.exp(-(F.col("__k") * F.col("__k")) / (2.0 * sigma * sigma))
        made = sent.groupBy(*by, other, F.col("__to").cast(df.schema[axis].dataType).alias(axis)).agg((F.sum(weight * F.col("__v")) / F.sum(weight)).alias("__s"))
        df = df.join(made, [*by, "i", "j"], "left").withColumn(value, F.col("__s")).drop("__s")
    return df


def high_pass(df: DataFrame, value: str, sigma_i: float, sigma_j: float, by: Sequence[str] = ()) -> DataFrame:
    """The field less its Gaussian low pass."""
    low = gaussian(df.select(*by, "i", "j", F.col(value).alias("__low")), "__low", sigma_i, sigma_j, by)
    return df.join(low, [*by, "i", "j"]).withColumn(value, F.col(value) - F.col("__low")).drop("__low")


def sigma_of(wavelength: float, resolution: float) -> float:
    """Width (in cells) of the Gaussian whose high pass keeps waves up to a length; both in degrees."""
    return wavelength / 8 / resolution


def high_pass_waves(df: DataFrame, value: str, zonal_deg: float, meridional_deg: float, resolution_deg: float, by: Sequence[str] = ()) -> DataFrame:
    """:func:`high_pass` for waves of these lengths along i and along j."""
    return high_pass(df, value, sigma_of(zonal_deg, resolution_deg), sigma_of(meridional_deg, resolution_deg), by)


def local_minima(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Cells that no cell of their 3 x 3 square is below, in squares that aren't flat; minima by two passes of three cells."""
    ends = lambda w: w.rowsBetween(-1, 1)
    wi = ends(_along("i", by))
    wj = ends(_along("j", by))
    df = df.withColumns({"__a": F.min(value).over(wi), "__b": F.max(value).over(wi)})
    df = df.withColumns({"__a": F.min("__a").over(wj), "__b": F.max("__b").over(wj)})
    return df.where((F.col(value) == F.col("__a")) & (F.col("__b") > F.col("__a"))).drop("__a", "__b")


def extremum_in_square(df: DataFrame, value: str, out: str, kind: str = "min", by: Sequence[str] = ()) -> DataFrame:
    """Adds the 3 x 3 minimum or maximum of each cell."""
    f = {"min": F.min, "max": F.max}[kind]
    df = df.withColumn("__a", f(value).over(_along("i", by).rowsBetween(-1, 1)))
    return df.withColumn(out, f("__a").over(_along("j", by).rowsBetween(-1, 1))).drop("__a")


def layer_thickness(df: DataFrame, height: str, columns: Sequence[str], level: str = "k") -> DataFrame:
    """Adds ``dz``, the next level's height less a level's own; null at the top."""
    return df.withColumn("dz", F.lead(height).over(Window.partitionBy(*columns).orderBy(level)) - F.col(height))


def eddy_kinetic(u: str, v: str) -> Column:
    return (F.col(u) * F.col(u) + F.col(v) * F.col(v)) / 2
