"""Gridded fields: profiles as text, binary grids, classic NetCDF files, remapping links, and a store of snapshots by time."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import units
from ..operators.projections import column_by_name
from . import arrays
from .lines import numbered_lines

# Variables of the reanalysis store: short name, long name, unit.
VARIABLES = (
    ("u10", "10m_u_component_of_wind", "m/s"), ("v10", "10m_v_component_of_wind", "m/s"), ("t2m", "2m_temperature", "K"), ("d2m", "2m_dewpoint_temperature", "K"),
    ("msl", "mean_sea_level_pressure", "Pa"), ("sp", "surface_pressure", "Pa"), ("sst", "sea_surface_temperature", "K"), ("swh", "significant_height_of_combined_wind_waves_and_swell", "m"),
    ("mwd", "mean_wave_direction", "degrees"), ("mwp", "mean_wave_period", "s"), ("tp", "total_precipitation", "m"), ("skt", "skin_temperature", "K"), ("z", "geopotential", "m**2/s**2"),
    ("t", "temperature", "K"), ("u", "u_component_of_wind", "m/s"), ("v", "v_component_of_wind", "m/s"), ("q", "specific_humidity", "kg/kg"), ("lsm", "land_sea_mask", "1"),
)
_PROFILE_HEIGHTS = ("z", "zf", "zc", "zm")


#: A name, an argument list that says it depends on height, and a unit in round or square brackets.
_COLUMN = re.compile(r"(?P<name>[^\s,#()\[\]]+)(?:\(z\))?(?:[(\[](?P<unit>[^)\]]*)[)\]])?")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """A profile text: names with units in brackets on the second line, numbers below; heights are named ``height``.

    Units that are known go to the columns' metadata.
    """
    lines = numbered_lines(spark, path)
    heads = list(_COLUMN.finditer(lines.where("line = 1").first()["value"]))
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where("line > 1 and trim(value) <> '' and not startswith(trim(value), '#')")
    columns = {("height" if m["name"] in _PROFILE_HEIGHTS else m["name"]): m["unit"] for m in heads}
    df = rows.select(*[F.get(f, F.lit(k)).try_cast("double").alias(c) for k, c in enumerate(columns)])
    for c, unit in columns.items():
        if unit in units.NAMED:
            df = units.with_unit(df, c, units.named(unit))
    return df


def write_profile(df: DataFrame, columns: list[str], path: str, title: str = "profile", order: str = "height") -> None:
    """Two header lines and a row of ``%.4e`` numbers a level, in order of height; part files are in order."""
    spark = df.sparkSession
    heads = spark.createDataFrame([(0, 0.0, f"# {title}"), (0, 1.0, "# " + " ".join(columns))], "part int, n double, value string")
    body = df.select(F.lit(1).alias("part"), F.col(order).cast("double").alias("n"), F.format_string(" ".join(["%.4e"] * len(columns)), *[F.col(c).cast("double") for c in columns]).alias("value"))
    heads.union(body).orderBy("part", "n").select("value").write.text(path)


def read_binary_grid(spark: SparkSession, path: str, nx: int, ny: int, names: tuple[str, ...] = ("lat", "lon", "htn", "hte", "hus", "huw", "angle"), wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Rows (i, j, names) of a big-endian file of double arrays (ny, nx), one after the other; tasks read ranges of rows, of ``wanted`` arrays only."""
    df = arrays.read_grid(spark, path, names, {"j": ny, "i": nx}, wanted)
    return df.select("i", "j", *[n for n in names if wanted is None or n in wanted])


_LINK = np.dtype([("src", "<i4"), ("dst", "<i4"), ("w1", "<f8"), ("w2", "<f8"), ("w3", "<f8")])
def save_links(links: DataFrame, path: str) -> None:
    """Links as Parquet rows, sorted by destination inside files so that a range of cells reads a part of them."""
    links.sortWithinPartitions("dst").write.parquet(path)


def read_packed_links(spark: SparkSession, path: str) -> DataFrame:
    """Links of files of packed records (two 32-bit indices, three doubles, little-endian); tasks read ranges of records."""
    return arrays.read_records(spark, path, _LINK).select(*_LINK.names)


def read_link_variables(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int | str]]:
    """Links (src, dst, w1, w2 ...) of a classic NetCDF file of remapping weights, cells from 0, and what its header says: sizes of both grids, title and normalisation.

    Fixed names of that format: variables src_address, dst_address (from 1) and remap_matrix on (num_links, num_wgts).
    """
    head = arrays.netcdf_header(path)
    one = arrays.read_netcdf(spark, path, ["src_address", "dst_address"], ["num_links"]).select(F.col("num_links").alias("k"), (F.col("src_address") - 1).alias("src"), (F.col("dst_address") - 1).alias("dst"))
    weights = arrays.read_netcdf(spark, path, ["remap_matrix"], ["num_links", "num_wgts"])
    n = head.dims["num_wgts"]
    wide = weights.groupBy(F.col("num_links").alias("k")).agg(*[F.max(F.when(F.col("num_wgts") == i, F.col("remap_matrix"))).alias(f"w{i + 1}") for i in range(n)])
    about = {"n_src": head.dims["src_grid_size"], "n_dst": head.dims["dst_grid_size"], **{k: str(head.attributes[k]) for k in ("title", "normalization", "map_method") if k in head.attributes}}
    return one.join(wide, "k").drop("k"), about


def read_grid_masks(spark: SparkSession, path: str, side: str = "src") -> DataFrame:
    """Cells (id, open) of one grid (``src`` or ``dst``) of a file of remapping weights: whether its mask lets the cell take part."""
    df = arrays.read_netcdf(spark, path, [f"{side}_grid_imask"], [f"{side}_grid_size"])
    return df.select(F.col(f"{side}_grid_size").alias("id"), (F.col(f"{side}_grid_imask") != 0).alias("open"))


def link_sizes(links: DataFrame) -> DataFrame:
    """One row: number of links and of different source and destination cells."""
    return links.agg(F.count("*").alias("n_links"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


# ---- NetCDF


def read_netcdf(spark: SparkSession, path: str, names: list[str], dims: list[str], ranges: dict[str, tuple[int, int]] | None = None, coordinates: Sequence[str] = ()) -> DataFrame:
    """Rows (file, an index per dimension, names) of variables of classic NetCDF files on one list of dimensions, whatever their order in the file.

    Tasks read ranges of records. ``ranges`` slices dimensions; ``coordinates`` are variables on one dimension, such as heights or times, given as ``name_at``.
    Fill values are null; units are in the columns' metadata.
    """
    return arrays.read_netcdf(spark, path, names, dims, ranges, coordinates)


def netcdf_attributes(path: str, name: str | None = None) -> dict[str, str | list]:
    """Attributes of a classic NetCDF file, or of one variable of it."""
    head = arrays.netcdf_header(path)
    return head.attributes if name is None else head.variables[name]


def read_sea_level(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, fill: bool = False) -> DataFrame:
    """Sea level anomalies in cm of gridded altimetry files: rows (file, i, j, lon, lat, sla), null on land.

    Files are of the newer layout (sla on time, lat, lon in m) or the older one (Grid_0001 on longitudes and latitudes in cm); each file's header tells. ``box`` (west, east, south, north) may cross
    the meridian where a file's longitudes begin: longitudes then rise through it. ``fill`` gives land the mean of its nearest sea points.
    """
    out = None
    for new in (True, False):
        files = [f for f, _ in arrays.found(path) if ("sla" in arrays.netcdf_header(f).arrays) == new]
        if not files:
            continue
        name, dims, coordinates, scale = ("sla", ["time", "lat", "lon"], ["lon", "lat"], 100.0) if new else ("Grid_0001", ["NbLongitudes", "NbLatitudes"], ["NbLongitudes", "NbLatitudes"], 1.0)
        layouts = [(f, [(head := arrays.netcdf_header(f).arrays)[name], *[head[c] for c in coordinates]]) for f in files]
        df = arrays.read_arrays(spark, layouts, dims, {"time": (0, 1)} if new else None, coordinates)
        part = df.select("file", F.col(dims[-1 if new else 0]).alias("i"), F.col(dims[-2 if new else 1]).alias("j"), F.col(f"{coordinates[0]}_at").alias("lon"), F.col(f"{coordinates[1]}_at").alias("lat"), (F.col(name) * scale).alias("sla"))
        out = part if out is None else out.unionByName(part)
    if box is not None:
        west, east, south, north = box
        out = stitch_meridian(out.where(F.col("lat").between(south, north)), west, east)
    if fill:
        from ..operators.nearest import fill_nearest

        named = out.withColumn("id", F.xxhash64("file", "i", "j"))
        filled = None
        for (file,) in out.select("file").distinct().collect():  # a snapshot each
            one = fill_nearest(named.where(F.col("file") == file).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), "sla"), "sla").select("id", F.col("sla").alias("made"))
            filled = one if filled is None else filled.union(one)
        out = named.join(filled, "id").select("file", "i", "j", "lon", "lat", F.col("made").alias("sla")) if filled is not None else out
    return units.with_unit(out, "sla", units.cm)


def read_ocean_model(spark: SparkSession, path: str, record: int, level: int | None = None) -> DataFrame:
    """One record of a regional ocean model's history file: rows (file, j, i, zeta), or with ``level`` rows (file, j, i, temp, salt, u, v) at that level.

    Fixed names of that model: zeta, temp, salt on rho points, u and v on their own. Velocities are brought to rho points by the mean of both
    neighbours along their direction; rows and columns at the rim, where one of them is missing, take the other one.
    """
    at = lambda n, dims: arrays.read_netcdf(spark, path, [n], dims, {"ocean_time": (record, record + 1)} | ({"s_rho": (level, level + 1)} if level is not None else {}))
    if level is None:
        return at("zeta", ["ocean_time", "eta_rho", "xi_rho"]).select("file", F.col("eta_rho").alias("j"), F.col("xi_rho").alias("i"), "zeta")
    named = lambda n, grid: at(n, ["ocean_time", "s_rho", f"eta_{grid}", f"xi_{grid}"]).select("file", F.col(f"eta_{grid}").alias("j"), F.col(f"xi_{grid}").alias("i"), n)
    df = named("temp", "rho").join(named("salt", "rho"), ["file", "j", "i"], "left")
    for n, along in (("u", "i"), ("v", "j")):
        own = named(n, n)
        ends = own.withColumn(along, F.explode(F.array(F.col(along), F.col(along) + 1)))
        df = df.join(ends.groupBy("file", "j", "i").agg(F.avg(n).alias(n)), ["file", "j", "i"], "left")
    return df


def read_levels(spark: SparkSession, path: str, names: list[str] | None = None, dims: list[str] | None = None) -> DataFrame:
    """A model's input by its kind: files ``.nc`` as :func:`read_netcdf` (``names`` on ``dims``), any other one as :func:`read_profile`."""
    return read_netcdf(spark, path, names or [], dims or []) if path.endswith(".nc") else read_profile(spark, path)


# ---- snapshots by time


def write_snapshots(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Snapshots partitioned by year and month, so that a time reads its month's files only."""
    df.withColumns({"year": F.year(ts), "month": F.month(ts)}).repartition("year", "month", F.dayofmonth(ts)).write.partitionBy("year", "month").parquet(path)


def read_snapshots(spark: SparkSession, path: str, variables: list[str], start=None, end=None, area: tuple[float, float, float, float] | None = None, grid: float | None = None, level: int | None = None) -> DataFrame:
    """Rows (ts, lat, lon, variables) with start <= ts <= end in an area (north, west, south, east).

    Variables are given by short or long name. ``grid`` keeps every point on multiples of a spacing. All conditions, and those on
    year and month that follow from the times, reach the scan.
    """
    df = spark.read.parquet(path)
    known = {short: long for short, long, _ in VARIABLES}
    free = [c for c in df.columns if c not in ("ts", "lat", "lon", "level", "year", "month")]
    columns = [column_by_name(free, v, known) for v in variables]
    ts = F.col("ts")
    for bound, holds in ((start, lambda a, b: a >= b), (end, lambda a, b: a <= b)):
        if bound is not None:
            month = F.col("year") * 12 + F.col("month")
            df = df.where(holds(ts, F.lit(bound)) & holds(month, F.lit(bound.year * 12 + bound.month)))
    if level is not None:
        df = df.where(F.col("level") == level)
    if area:
        north, west, south, east = area
        df = df.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    if grid:
        df = df.where(((F.col("lat") / grid) % 1 == 0) & ((F.col("lon") / grid) % 1 == 0))
    df = df.select("ts", "lat", "lon", *[F.col(c).alias(v) for c, v in zip(columns, variables, strict=True)])
    by_name = {short: u for short, _, u in VARIABLES} | {long: u for _, long, u in VARIABLES}
    for v in variables:
        df = units.with_unit(df, v, units.named(by_name.get(v, "1")))
    return df


def close_longitudes(df: DataFrame, spacing: float) -> DataFrame:
    """A global grid with its first column repeated 360 degrees further east."""
    first = df.where(F.col("lon") < spacing).withColumn("lon", F.col("lon") + 360.0)
    return df.unionByName(first)


def stitch_meridian(df: DataFrame, west: float, east: float) -> DataFrame:
    """Points of a range of longitudes that may cross 0 or 180, with longitudes that rise from ``west`` to ``east``."""
    lon = F.lit(west) + F.pmod(F.col("lon") - west, F.lit(360.0))
    return df.withColumn("lon", lon).where(F.col("lon") <= east)


def radius_table(spark: SparkSession, path: str, area: tuple[float, float, float, float], pad: float = 1.5) -> DataFrame:
    """Rows (lat, lon, radius) of a text of lat, lon, speed, radius, in an area (west, east, south, north) with a margin; longitudes follow the area's."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(*[F.get(f, F.lit(k)).try_cast("double").alias(n) for k, n in ((0, "lat"), (1, "lon"), (3, "radius"))])
    west, east, south, north = area
    return stitch_meridian(rows.where("lat is not null and radius is not null"), west - pad, east + pad).where(F.col("lat").between(south - pad, north + pad))


def masked(value: Column, mask: Column) -> Column:
    """The value where a mask is 1, else null."""
    return F.when(mask == 1, value)
