"""Best-track files in the ATCF format: comma-separated text of up to 37 fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendars import hour_stamp, number_or_zero, tenths
from ..operators import tracks

# The fields in their order.
FIELDS = (
    "basin", "cy", "date", "technum", "tech", "tau", "lat", "lon", "vmax", "mslp", "ty", "rad", "windcode", "rad1", "rad2", "rad3", "rad4",
    "radp", "rrp", "mrd", "gusts", "eye", "subregion", "maxseas", "initials", "dir", "speed", "stormname", "depth", "seas", "seascode",
    "seas1", "seas2", "seas3", "seas4", "userdefined", "userdata",
)


def read_best_track(spark: SparkSession, path: str) -> DataFrame:
    """All 37 fields as trimmed text, with file and line; missing tail fields are empty."""
    from .lines import numbered_lines

    lines = numbered_lines(spark, path).where("trim(value) <> ''").withColumn("f", F.split("value", ","))
    return lines.select("file", "line", *[F.coalesce(F.trim(F.get("f", F.lit(k))), F.lit("")).alias(n) for k, n in enumerate(FIELDS)])


def storm_track(raw: DataFrame) -> DataFrame:
    """Rows (track, ts, lon, lat, rrp, vmax, mslp, mrd) of the best-track rows: m, m/s, Pa.

    Of rows with one time the first counts, before others than ``BEST`` go. Zeros take the last known value; a zero that nothing
    comes before is null. Rows whose time or position can't be read go.
    """
    df = raw.withColumns({"track": F.concat_ws("-", "file", "basin", "cy"), "ts": hour_stamp("date")})
    df = tracks.drop_repeats(df, "track", "ts", ["line"]).where(F.upper("tech") == "BEST")
    df = df.select("track", "line", "ts", tenths("lon").alias("lon"), tenths("lat").alias("lat"), *[number_or_zero(n).alias(n) for n in ("rrp", "vmax", "mslp", "mrd")])
    df = df.where("ts is not null and lon is not null and lat is not null")
    df = tracks.fill_zeros(df, ["rrp", "vmax", "mslp", "mrd"], "track", ["line"])
    # Nautical mile, knot, millibar.
    factors = {"rrp": 1852.0, "mrd": 1852.0, "vmax": 1852.0 / 3600.0, "mslp": 100.0}
    return df.withColumns({n: F.col(n) * f for n, f in factors.items()}).drop("line")


def track_index(df: DataFrame) -> DataFrame:
    """Adds ``seq``, the row's number in its track."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy("track").orderBy("ts")) - 1)
