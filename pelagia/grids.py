"""Grids as DataFrames: index columns, one column per attribute, units in the fields' metadata."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import units
from .operators import channels, projections


@dataclass(frozen=True)
class Axis:
    """Cell ``i`` of a uniform axis has its centre at offset + (i + 0.5) * spacing."""

    offset: float = 0.0
    spacing: float = 1.0


@dataclass(frozen=True)
class Grid:
    """A table whose rows are told apart by ``index``. Grids are never changed: each method gives a new one.

    Index tuples are unique and not null; attributes may be null. Extra columns of any name are attributes.
    """

    df: DataFrame
    index: tuple[str, ...]
    axes: dict[str, Axis] = field(default_factory=dict)
    attributes: dict[str, object] = field(default_factory=dict)

    @staticmethod
    def regular(spark: SparkSession, shape: Sequence[int], lengths: Sequence[float], offset: Sequence[float] | None = None, names: Sequence[str] = "xyz") -> Grid:
        """A grid of cells of equal size; positions are cell centres."""
        index = tuple("ijk"[: len(shape)])
        total = 1
        for n in shape:
            total *= n
        df, left = spark.range(total), F.col("id")
        columns = []
        for n, name in reversed(list(zip(shape, index, strict=True))):
            columns.append((left % n).cast("int").alias(name))
            left = F.floor(left / n)
        axes = {x: Axis(o, length / n) for x, o, length, n in zip(names, offset or [0.0] * len(shape), lengths, shape)}
        return Grid(df.select(*reversed(columns)), index, axes).with_positions()

    def with_positions(self) -> Grid:
        """Adds a column of cell centres for each axis, in the order of the index."""
        made = {x: F.lit(a.offset) + (F.col(i) + 0.5) * a.spacing for (x, a), i in zip(self.axes.items(), self.index)}
        return replace(self, df=self.df.withColumns(made))

    # -- reading
    def select(self, *names: str) -> Grid:
        return replace(self, df=self.df.select(*self.index, *names))

    def __getitem__(self, where) -> Grid:
        """``grid[1:5, 3]``: index ranges (ends excluded) and points; ``grid[mask]``: rows where a Column holds."""
        if isinstance(where, Column):
            return replace(self, df=self.df.where(where))
        return replace(self, df=projections.block(self.df, dict(zip(self.index, where if isinstance(where, tuple) else (where,)))))

    def extent(self, *names: str) -> DataFrame:
        """One row: smallest and largest position of each column."""
        return self.df.agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("min", F.min), ("max", F.max))])

    def unit(self, name: str) -> units.Unit:
        return units.unit_of(self.df, name)

    # -- new grids
    def assign(self, name: str, value: Column, unit: units.Unit | None = None) -> Grid:
        df = self.df.withColumn(name, value)
        return replace(self, df=units.with_unit(df, name, unit) if unit else df)

    def update_where(self, mask: Column, **values) -> Grid:
        """Attributes changed where ``mask`` is true; a null mask is false."""
        return replace(self, df=projections.update_where(self.df, mask, values))

    def empty_copy(self) -> Grid:
        return replace(self, df=self.df.select(*self.index))

    def copy_from(self, source: Grid, names: Sequence[str], source_names: Sequence[str] | None = None) -> Grid:
        """Attributes of ``source`` by index; cells that it lacks keep theirs (null for new attributes)."""
        return replace(self, df=channels.copy(source.df, self.df, self.index, names, source_names))

    def transform_from(self, source: Grid, targets: Sequence[str], function: Callable[..., Sequence[Column]], sources: Sequence[str]) -> Grid:
        """Attributes computed from columns of ``source`` by index."""
        return replace(self, df=channels.transform(source.df, self.df, self.index, targets, function, sources))

    def remap_from(self, source: Grid, links: DataFrame | Callable[[Grid, Grid], DataFrame], names: Sequence[str]) -> Grid:
        """Attributes remapped over links (src, dst, w1 ...), or over those that a remapper makes of both grids; both have one index column. All in one pass."""
        from .operators import remap

        made = links(source, self) if callable(links) else links
        out = remap.apply_links(source.df.withColumnRenamed(source.index[0], "src"), made, self.df.select(F.col(self.index[0]).alias("dst")), names)
        return self.copy_from(Grid(out.withColumnRenamed("dst", self.index[0]), self.index), names)

    def save(self, path: str) -> None:
        self.df.write.parquet(path)
