"""Index ranges, masks and conditional updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block(df: DataFrame, ranges: dict[str, int | slice | list[int]]) -> DataFrame:
    """Rows in all ranges: a slice (end excluded, open ends allowed), a list or a point per index column.

    Conditions are plain comparisons, so they reach the scan; a null index is in no range.
    """
    for name, r in ranges.items():
        c = F.col(name)
        if isinstance(r, slice):
            step = r.step or 1
            if r.start is not None:
                df = df.where(c >= r.start)
            if r.stop is not None:
                df = df.where(c < r.stop)
            if step != 1:
                df = df.where((c - (r.start or 0)) % step == 0)
        elif isinstance(r, list):
            df = df.where(c.isin(r))
        else:
            df = df.where(c == r)
    return df


def update_where(df: DataFrame, mask: Column, values: dict[str, Column | float]) -> DataFrame:
    """Columns set to new values where the mask is true; elsewhere, and where the mask is null, they stay."""
    return df.withColumns({n: F.when(mask, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(n)) for n, v in values.items()})


def set_flags(df: DataFrame, name: str, ranges: dict[str, int | slice | list[int]], value: bool = True) -> DataFrame:
    """Boolean column ``name`` set to ``value`` for rows in all ranges (see :func:`block`); others keep theirs, false where it is new or null."""
    inside = F.lit(True)
    for index, r in ranges.items():
        c = F.col(index)
        if isinstance(r, slice):
            first = r.start or 0
            inside = inside & (c >= first) & ((c - first) % (r.step or 1) == 0)
            if r.stop is not None:
                inside = inside & (c < r.stop)
        else:
            inside = inside & (c.isin(r) if isinstance(r, list) else c == r)
    before = F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)
    return df.withColumn(name, F.when(inside, F.lit(value)).otherwise(before))


def neighbour_mask(df: DataFrame, mask: str, line: str, along: str, out: str) -> DataFrame:
    """Adds the product of a 0/1 mask and that of the next cell along an axis (last cell: null)."""
    w = Window.partitionBy(line).orderBy(along)
    return df.withColumn(out, F.col(mask) * F.lead(mask).over(w))


def with_halo(df: DataFrame, i: str, j: str, first: tuple[int, int], last: tuple[int, int], pad: int) -> DataFrame:
    """The index box with ``pad`` more cells on each side."""
    return block(df, {i: slice(first[0] - pad, last[0] + pad + 1), j: slice(first[1] - pad, last[1] + pad + 1)})


def box_indices(df: DataFrame, box: tuple[float, float, float, float], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row (i0, i1, j0, j1): the index box of a grid (i, j, lon, lat) that reaches from the points nearest to a box's (west, east, south, north) sides' middles.

    Of equally near points the one of smaller j, then of smaller i counts. A partial aggregation, whatever the grid's shape.
    """
    west, east, south, north = box
    middle_lon, middle_lat = west + (east - west) / 2, south + (north - south) / 2

    def nearest(index: str, x: float, y: float) -> Column:
        d2 = (F.col(lon) - x) * (F.col(lon) - x) + (F.col(lat) - y) * (F.col(lat) - y)
        return F.min_by(index, F.struct(d2, "j", "i"))

    known = df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    return known.agg(nearest("i", west, middle_lat).alias("i0"), nearest("i", east, middle_lat).alias("i1"), nearest("j", middle_lon, south).alias("j0"), nearest("j", middle_lon, north).alias("j1"))


def in_box(df: DataFrame, box: tuple[float, float, float, float], pad: int = 0, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The index box of :func:`box_indices` with ``pad`` more cells on each side."""
    i0, i1, j0, j1 = box_indices(df, box, lon, lat).first()  # four numbers
    return with_halo(df, "i", "j", (i0, j0), (i1, j1), pad) if i0 is not None else df.limit(0)


def every_nth(df: DataFrame, order: str, n: int, skip: int = 0, skip_last: int = 0) -> DataFrame:
    """Every nth distinct value of ``order`` after ``skip`` and before the last ``skip_last``; rows of a value stay together.

    Ranks are dealt over the distinct values only (snapshots or files), never over the rows.
    """
    values = df.select(order).where(F.col(order).isNotNull()).distinct()
    w = Window.orderBy(order)
    values = values.withColumn("nth", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    kept = values.where((F.col("nth") >= skip) & (F.col("nth") < F.col("n") - skip_last) & ((F.col("nth") - skip) % n == 0))
    return df.join(kept.select(order), order, "left_semi")


def column_by_name(names: list[str], wanted: str, long_names: dict[str, str] | None = None) -> str:
    """A source's column for a variable: its short name, else the column whose long name fits, else the only one."""
    if wanted in names:
        return wanted
    for name, text in (long_names or {}).items():
        if text == wanted and name in names:
            return name
    if len(names) == 1:
        return names[0]
    raise KeyError(wanted)
