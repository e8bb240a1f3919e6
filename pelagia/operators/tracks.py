"""Storm and particle tracks (track, ts, ...): cleaning, velocities and interpolation in time by windows per track.

A window partition is one track. A track with a large share of all rows is first cut at day starts where a function
says so (``by_day``); the others need a track's rows in order by their meaning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..functions.physics import EARTH_M, holland
from ..staging import staged
from .nearest import pairs_within


def _order(track: str, order: Sequence[str]):
    return Window.partitionBy(track).orderBy(*order)


def drop_repeats(df: DataFrame, track: str = "track", ts: str = "ts", order: Sequence[str] = ()) -> DataFrame:
    """Rows whose time differs from that of the row before; the first of a run stays. Null times are a run of their own."""
    before = F.lag(F.struct(ts)).over(_order(track, [*order] or [ts]))
    return df.withColumn("__b", before).where(F.col("__b").isNull() | ~F.col(ts).eqNullSafe(F.col(f"__b.{ts}"))).drop("__b")


def fill_zeros(df: DataFrame, names: Sequence[str], track: str = "track", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Zeros become the last value of the track that isn't zero; leading zeros become null."""
    w = _order(track, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: F.last(F.nullif(n, F.lit(0.0)), ignorenulls=True).over(w) for n in names})


def seconds(ts: str | Column) -> Column:
    """Seconds since 1970 of a timestamp without zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / 1e6


def since_first(df: DataFrame, track: str = "track", ts: str = "ts") -> DataFrame:
    """Adds ``t``: seconds since the first row of the track."""
    first = F.min(ts).over(Window.partitionBy(track))
    return df.withColumn("t", seconds(ts) - seconds(first))


def add_velocity(df: DataFrame, track: str = "track", ts: str = "ts", radius: float = EARTH_M) -> DataFrame:
    """Adds vx and vy (m/s): great-circle speed between the rows before and after (a track's ends use their own place),
    split by the angle of the coordinate differences. A track of one row has none (null)."""
    w = _order(track, [ts])
    at = lambda f, c: F.coalesce(f(c).over(w), F.col(c))
    df = df.withColumns({f"__{c}{k}": at(f, c) for c in ("lat", "lon", ts) for k, f in ((0, F.lag), (1, F.lead))})
    lat0, lat1, lon0, lon1 = (F.col(x) for x in ("__lat0", "__lat1", "__lon0", "__lon1"))
    dt = seconds(f"__{ts}1") - seconds(f"__{ts}0")
    speed = haversine(lat0, lon0, lat1, lon1, radius) / F.nullif(dt, F.lit(0.0))
    angle = F.atan2(F.radians(lat1 - lat0), F.radians(lon1 - lon0))
    out = df.withColumns({"vx": speed * F.cos(angle), "vy": speed * F.sin(angle)})
    return out.drop(*[f"__{c}{k}" for c in ("lat", "lon", ts) for k in (0, 1)])


def interpolate(df: DataFrame, at: DataFrame, names: Sequence[str], track: str = "track", x: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Rows of ``at`` (track, x) with ``names`` linear between the neighbouring rows of the track, held at its ends.

    Both sides are merged by one shuffle on the track and windows over it; no range join. Of rows with one x the last by the
    attributes counts. Tracks without rows give null. ``x`` is a number or a timestamp.
    """
    kind = df.schema[x].dataType.simpleString()
    value = seconds if kind.startswith("timestamp") else (lambda c: F.col(c).cast("double"))
    known = df.select(F.col(track), value(x).alias("__x"), F.struct(value(x).alias("x"), *names).alias("__row"))
    known = known.groupBy(track, "__x").agg(F.max("__row").alias("__row"))
    asked = at.select(F.col(track), value(x).alias("__x"), F.struct(*at.columns).alias("__at"))
    both = known.withColumn("__at", F.lit(None).cast(asked.schema["__at"].dataType)).unionByName(asked.withColumn("__row", F.lit(None).cast(known.schema["__row"].dataType)))
    w = Window.partitionBy(track).orderBy("__x").rangeBetween
    before = F.last("__row", ignorenulls=True).over(w(Window.unboundedPreceding, Window.currentRow))
    after = F.first("__row", ignorenulls=True).over(w(Window.currentRow, Window.unboundedFollowing))
    both = both.withColumns({"__p": before, "__n": after}).where("__at is not null")
    both = both.withColumns({"__p": F.coalesce("__p", "__n"), "__n": F.coalesce("__n", "__p")})
    w1 = F.coalesce((F.col("__x") - F.col("__p.x")) / F.nullif(F.col("__n.x") - F.col("__p.x"), F.lit(0.0)), F.lit(0.0))
    made = [((1 - w1) * F.col(f"__p.{n}") + w1 * F.col(f"__n.{n}")).alias(n) for n in names]
    return both.select("__at.*", *made)


_STORM = ("lat", "lon", "mslp", "vmax", "mrd", "vx", "vy")


def cyclone_field(track: DataFrame, nodes: DataFrame, times: DataFrame, reach_m: float | None = None, block: int = 10_000) -> DataFrame:
    """Pressure and wind at nodes (node, lat, lon) for each time (track, ts) of storm tracks with mslp (Pa), vmax (m/s), mrd (m).

    With ``reach_m`` nodes within that distance of the storm's centre have a row: they meet in bins of latitude and longitude, so that rows grow with what
    storms cover; elsewhere there is the pressure around and no wind. Without it every node has a row for every time, as the result asks for: states are small rows, counted and
    broadcast in blocks of ``block``.
    """
    state = staged(interpolate(add_velocity(track), times, _STORM), "storm").select("track", "ts", *[F.col(c).alias(f"__{c}") for c in _STORM])
    found = holland("lat", "lon", *[f"__{c}" for c in _STORM])
    values = ["track", "ts", "node", *[found[c].alias(c) for c in ("pressure", "wind_x", "wind_y")]]
    if reach_m is not None:
        centres = state.where("__lat is not null and __lon is not null").withColumns({"ax": F.col("__lon"), "ay": F.col("__lat")})
        places = nodes.where("lat is not null and lon is not null").select("node", "lat", "lon", F.col("lon").alias("bx"), F.col("lat").alias("by"))
        return pairs_within(centres, places, haversine("ay", "ax", "by", "bx", EARTH_M), reach_m, EARTH_M).select(*values)
    blocks = 1 + state.count() // block
    one = F.lit(1).alias("__all")
    out = None
    for b in range(blocks):
        part = state.where(F.pmod(F.xxhash64("track", "ts"), F.lit(blocks)) == b) if blocks > 1 else state
        each = nodes.select("*", one).join(F.broadcast(part.select("*", one)), "__all").select(*values)
        out = each if out is None else out.unionByName(each)
    return out


def storm_fields(spark: SparkSession, path: str, nodes: DataFrame, every: str = "1 hour", reach_m: float | None = None) -> DataFrame:
    """From a best-track file to fields: its storm's states from the first to the last time in steps of ``every``, and their pressure and wind at ``nodes``."""
    from ..sources.storms import read_best_track, storm_track

    known = storm_track(read_best_track(spark, path))
    known = known if "track" in known.columns else known.withColumn("track", F.lit(0).cast("long"))
    ends = known.groupBy("track").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    times = ends.select("track", F.explode(F.sequence("a", "b", F.expr(f"interval {every}"))).alias("ts"))
    return cyclone_field(known, nodes, times, reach_m)


def islands(df: DataFrame, gap_seconds: float, track: str = "track", ts: str = "ts", order: Sequence[str] = ()) -> DataFrame:
    """Adds ``island`` (from 0) and ``n`` (row within it, from 0): a track ends where the next row is over ``gap_seconds`` later."""
    w = _order(track, [ts, *order])
    gap = (seconds(ts) - seconds(F.lag(ts).over(w))) > gap_seconds
    df = df.withColumn("__new", F.coalesce(gap.cast("int"), F.lit(0)))
    df = df.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    return df.withColumn("n", F.row_number().over(Window.partitionBy(track, "island").orderBy(ts, *order)) - 1)


def long_islands(df: DataFrame, gap_seconds: float, least: int, track: str = "track", ts: str = "ts") -> DataFrame:
    """One row per island of at least ``least`` rows: first and last time and the number of rows."""
    found = islands(df, gap_seconds, track, ts).groupBy(track, "island").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_rows"))
    return found.where(F.col("n_rows") >= least)


def resample(df: DataFrame, steps: int, track: str = "track", order: str = "seq") -> DataFrame:
    """Each line (track, seq, lat, lon) as ``steps`` + 1 points at equal distances along it: (track, seq, lat, lon)."""
    w = _order(track, [order])
    d = haversine(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon", 1.0)
    df = df.withColumn("s", F.coalesce(d, F.lit(0.0))).withColumn("s", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    asked = df.groupBy(track).agg(F.max("s").alias("whole")).withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    asked = asked.select(track, "seq", (F.col("whole") * F.col("seq") / steps).alias("s"))
    return interpolate(df.select(track, "s", "lat", "lon"), asked, ["lat", "lon"], track, "s").select(track, "seq", "lat", "lon")
