"""Reductions over grids, links and vectors. Partial sums are made before any shuffle; no step gathers rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slab_mean(df: DataFrame, level: str, *names: str) -> DataFrame:
    """Mean of each attribute per level; nulls are left out."""
    return df.groupBy(level).agg(*[F.avg(n).alias(n) for n in names])


def column_path(df: DataFrame, columns: Sequence[str], value: str, weight: Column, out: str = "path") -> DataFrame:
    """Vertical integral per column of cells: sum of value * weight (density times thickness)."""
    return df.groupBy(*columns).agg(F.sum(F.col(value) * weight).alias(out))


def domain_mean(df: DataFrame, value: str, out: str = "mean") -> DataFrame:
    """Sum over all rows, divided by their number (nulls count as 0)."""
    return df.agg((F.sum(F.coalesce(value, F.lit(0.0))) / F.nullif(F.count("*"), F.lit(0))).alias(out))


def slab_fraction(df: DataFrame, columns: Sequence[str], level: str, value: str, bounds: Sequence[float], out: str = "fraction") -> DataFrame:
    """Per slab of levels [bounds[n], bounds[n + 1]): the share of columns that have a positive value in it."""
    slab = F.coalesce(*[F.when((F.col(level) >= a) & (F.col(level) < b), F.lit(n)) for n, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))])
    per_column = df.withColumn("slab", slab).where("slab is not null").groupBy("slab", *columns).agg(F.max((F.coalesce(value, F.lit(0)) > 0).cast("int")).alias("any"))
    return per_column.groupBy("slab").agg(F.avg("any").alias(out))


def summary(df: DataFrame, *names: str) -> DataFrame:
    """One row: sum, min, max, mean and population deviation of each attribute, and the number of rows."""
    kinds = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop}
    return df.agg(F.count("*").alias("n"), *[f(n).alias(f"{k}_{n}") for n in names for k, f in kinds.items()])


def weight_totals(links: DataFrame, side: str, weight: str = "w1") -> DataFrame:
    """Number of links and total weight per source or destination cell."""
    return links.groupBy(side).agg(F.count("*").alias("n_links"), F.sum(weight).alias("total"))


def area_error(before: DataFrame, after: DataFrame, value: str, area: str) -> DataFrame:
    """One row: area-weighted sums of two fields and their relative difference."""
    product = F.col(value) * F.col(area)
    parts = before.select(product.alias("b"), F.lit(0.0).alias("a")).unionAll(after.select(F.lit(0.0), product))
    both = parts.agg(F.sum("b").alias("before"), F.sum("a").alias("after"))
    return both.withColumn("error", (F.col("before") - F.col("after")) / F.nullif("before", F.lit(0.0)))


def argmax(df: DataFrame, value: Column, out: Sequence[str]) -> DataFrame:
    """The row of the largest value (smallest index first among equals): one row."""
    best = df.agg(F.max_by(F.struct(*out), F.struct(value.alias("v"), *[(-F.col(c)).alias(f"n{k}") for k, c in enumerate(out)])).alias("best"))
    return best.select("best.*")


def mean_spacing(df: DataFrame, line: str, along: str, position: str) -> DataFrame:
    """One row: mean distance of neighbours along an axis; equal positions are left out."""
    from pyspark.sql import Window

    w = Window.partitionBy(line).orderBy(along)
    steps = df.select(F.abs(F.lead(position).over(w) - F.col(position)).alias("d"))
    return steps.where("d > 0").agg(F.avg("d").alias("spacing"))


def overturning(df: DataFrame, x: str, y: str, z: str, transport: Column) -> DataFrame:
    """One row: least and largest value of the running vertical sum of the transport summed over x (per y)."""
    from pyspark.sql import Window

    slabs = df.groupBy(y, z).agg(F.sum(transport).alias("t"))
    run = F.sum("t").over(Window.partitionBy(y).orderBy(z))
    return slabs.select(run.alias("psi")).agg(F.min("psi").alias("psi_min"), F.max("psi").alias("psi_max"))


# ---- vectors: rows (idx, value), or array columns


def norm(df: DataFrame, value: str = "value") -> DataFrame:
    return df.agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"), F.count("*").alias("length"))


def dot(a: DataFrame, b: DataFrame, idx: str = "idx", value: str = "value") -> DataFrame:
    both = a.select(idx, F.col(value).alias("__a")).join(b.select(idx, F.col(value).alias("__b")), idx)
    return both.agg(F.sum(F.col("__a") * F.col("__b")).alias("dot"))


def array_norm(v: str) -> Column:
    """2-norm of an array column."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def array_dot(a: str, b: str) -> Column:
    """Inner product of two array columns of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
