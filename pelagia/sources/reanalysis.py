"""Requests to a store of reanalysis snapshots, with a cache of what was asked for before."""

from __future__ import annotations

import calendar
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import discard
from .fields import VARIABLES, read_snapshots

#: Grid spacings (degrees) that can be asked for.
SPACINGS = (0.25, 0.5, 1.0)

# Names of the public store. Pressure levels in hPa.
LEVELS = (
    1, 2, 3, 5, 7, 10, 20, 30, 50, 70, 100, 125, 150, 175, 200, 225, 250, 300, 350, 400, 450, 500, 550, 600, 650, 700, 750, 775, 800, 825, 850, 875, 900, 925, 950, 975, 1000,
)
AT_LEVELS = (
    "divergence", "fraction_of_cloud_cover", "geopotential", "ozone_mass_mixing_ratio", "potential_vorticity", "relative_humidity", "specific_cloud_ice_water_content",
    "specific_cloud_liquid_water_content", "specific_humidity", "specific_rain_water_content", "specific_snow_water_content", "temperature", "u_component_of_wind",
    "v_component_of_wind", "vertical_velocity", "vorticity",
)
NOT_MONTHLY = (
    "10m_u_component_of_wind", "10m_v_component_of_wind", "10m_wind_gust_since_previous_post_processing", "altimeter_corrected_wave_height", "altimeter_range_relative_correction",
    "altimeter_wave_height", "eastward_turbulent_surface_stress", "maximum_2m_temperature_since_previous_post_processing", "maximum_total_precipitation_rate_since_previous_post_processing",
    "mean_eastward_turbulent_surface_stress", "mean_northward_turbulent_surface_stress", "minimum_2m_temperature_since_previous_post_processing",
    "minimum_total_precipitation_rate_since_previous_post_processing", "near_ir_albedo_for_diffuse_radiation", "near_ir_albedo_for_direct_radiation", "northward_turbulent_surface_stress",
    "uv_visible_albedo_for_diffuse_radiation", "uv_visible_albedo_for_direct_radiation", "wave_spectral_directional_width", "wave_spectral_directional_width_for_swell",
    "wave_spectral_directional_width_for_wind_waves", "wave_spectral_kurtosis", "wave_spectral_peakedness", "wave_spectral_skewness",
)


def product_type(ensemble: bool = False, period: str = "hourly", synoptic: bool = False, statistics: bool = False) -> str | list[str]:
    """Name of a product; hourly ensembles with statistics are three products."""
    base = "ensemble_members" if ensemble else "reanalysis"
    if period == "monthly":
        return f"monthly_averaged_{base}" + ("_by_hour_of_day" if synoptic else "")
    if period == "hourly" and ensemble and statistics:
        return [base, "ensemble_mean", "ensemble_spread"]
    return base


@dataclass(frozen=True)
class Request:
    """What is asked of the store: a collection and its parameters."""

    collection: str
    parameters: dict[str, object]


def request(
    variable: str, time: datetime, timespan: str | None = None, period: str = "hourly", ensemble: bool = False, synoptic: bool = False, statistics: bool = False,
    levels: Sequence[int] = (), area: Sequence[float] | None = None, grid: float | None = None, known: Sequence[str] = (),
) -> Request:
    """A checked request for the hour, day or month of a time. Names may be short or long; ``known`` are names of single-level variables besides those of ``fields.VARIABLES``.

    Raises ValueError for an unknown variable, for levels that aren't there (or none for a variable that has levels), for a spacing that isn't, and for a monthly mean that the store lacks. The area (north, west, south, east) is
    given in whole degrees towards zero, as the store wants it.
    """
    longs = {short: long for short, long, _ in VARIABLES}
    name = longs.get(variable, variable)
    deep = name in AT_LEVELS
    if not deep and name not in longs.values() and name not in known:
        raise ValueError(f"no such variable: {variable}")
    if deep and (not levels or any(x not in LEVELS for x in levels)):
        raise ValueError(f"levels of {name} are some of {', '.join(map(str, LEVELS))}")
    if grid is not None and grid not in SPACINGS:
        raise ValueError(f"no such grid spacing: {grid}")
    if period == "monthly" and name in NOT_MONTHLY:
        raise ValueError(f"{name} has no monthly means")
    first, _, hours = span(time, timespan)
    days = [f"{k + 1:02d}" for k in range(hours // 24)] if timespan == "month" else [f"{first:%d}"]
    times = [f"{k:02d}:00" for k in range(24)] if hours >= 24 else [f"{first:%H}:00"]
    collection = f"{'pressure' if deep else 'single'}-levels" + ("-monthly-means" if period == "monthly" else "")
    parameters: dict[str, object] = {"variable": name, "product_type": product_type(ensemble, period, synoptic, statistics), "year": f"{first:%Y}", "month": f"{first:%m}", "day": days, "time": times}
    if deep:
        parameters["pressure_level"] = sorted(levels)
    if area is not None:
        parameters["area"] = [int(x) for x in area]
    if grid is not None:
        parameters["grid"] = grid
    return Request(collection, parameters)


def history(spark: SparkSession, cache: str) -> DataFrame:
    """What was read from the store into a cache: key, variable, first, hours, level, area, grid, rows; a row a request, in no order."""
    return spark.read.schema(_HISTORY).parquet(f"{cache.rstrip('/')}/_history")


_HISTORY = "key string, variable string, first timestamp_ntz, hours int, level int, area string, grid double, rows long"


def span(time: datetime, timespan: str | None) -> tuple[datetime, datetime, int]:
    """First and last hour of the hour, day or month of a time, and how many hours these are."""
    day = datetime(time.year, time.month, time.day)
    if timespan == "month":
        first, hours = day.replace(day=1), 24 * calendar.monthrange(time.year, time.month)[1]
    elif timespan == "day":
        first, hours = day, 24
    else:
        first, hours = day + timedelta(hours=time.hour), 1
    return first, first + timedelta(hours=hours - 1), hours


def dataset(spark: SparkSession, store: str, cache: str, variable: str, time: datetime, timespan: str | None = None, area: tuple[float, float, float, float] | None = None, grid: float = 0.25, level: int | None = None, known: Sequence[str] = ()) -> DataFrame:
    """Rows (ts, lat, lon, variable) of an hour, day or month, from the cache if they were asked for before, else from ``store``.

    Requests are checked as :func:`request` does; the area is made whole degrees. A store of variables with levels has a column ``level``. A
    part of the cache that was not written to its end is written anew, and what is read is noted in its :func:`history`. Raises ValueError if
    the store lacks an hour of the time (24 a day). Both folders are in storage that all executors share. Jobs run while this is called.
    """
    asked = request(variable, time, timespan, levels=() if level is None else (level,), area=area, grid=grid, known=known)
    first, last, hours = span(time, timespan)
    whole = asked.parameters.get("area")
    box = "all" if whole is None else "_".join(map(str, whole))
    key = f"{asked.collection}-{asked.parameters['variable']}-{'' if level is None else level}-{first:%Y%m%d%H}-{hours}-{box}-{grid:g}"
    path = f"{cache.rstrip('/')}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        rows = read_snapshots(spark, store, [variable], first, last, None if whole is None else tuple(map(float, whole)), grid, level)
        rows.write.mode("overwrite").parquet(path)
        found, n = spark.read.parquet(path).agg(F.countDistinct("ts"), F.count("*")).first()
        if found != hours:
            discard(spark, path)  # so that a later call reads the store again
            raise ValueError(f"{found} of {hours} hours of {variable} are there")
        note = [(key, str(asked.parameters["variable"]), first, hours, level, None if whole is None else box, grid, n)]
        spark.createDataFrame(note, _HISTORY).coalesce(1).write.mode("append").parquet(f"{cache.rstrip('/')}/_history")
    return spark.read.parquet(path)
