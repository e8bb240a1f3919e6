"""Queries over tracks, storms, eddies and snapshots by time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendars
from ..functions.geo import wrap_180, wrap_360
from ..functions.physics import holland
from ..operators import eddies as ed
from ..operators import tracks
from ..staging import new_path
from ..streaming import tracks as streams
from .views import SQL_VIEWS, eddies, field, nodes, query, rounded, table, user_tracks


def _hourly(spark, sf_dir):
    return user_tracks(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))


@query("SELECT track, h AS ts, event_id, event_type, value FROM (SELECT *, date_trunc('hour', ts) AS h, lag(date_trunc('hour', ts)) OVER (PARTITION BY track ORDER BY date_trunc('hour', ts), event_id) AS before FROM events_by_user) WHERE before IS NULL OR before <> h", "events_by_user")
def track_dedupe(spark, sf_dir):
    return tracks.drop_repeats(_hourly(spark, sf_dir), order=["ts", "event_id"])


@query(
    """SELECT track, ts, event_id, last_value(CASE WHEN event_type IN ('error', 'click') OR value = 0 THEN NULL ELSE value END IGNORE NULLS) OVER (PARTITION BY track ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value
    FROM events_by_user""",
    "events_by_user",
)
def track_ffill(spark, sf_dir):
    t = user_tracks(spark, sf_dir).withColumn("value", F.when(F.col("event_type").isin("error", "click"), 0.0).otherwise(F.col("value")))
    return tracks.fill_zeros(t, ["value"], order=["ts", "event_id"]).drop("event_type")


_MOVING = "SELECT track, ts, CAST((event_id * 37) % 360 - 180 AS DOUBLE) / 4 AS lon, CAST((event_id * 17) % 161 - 80 AS DOUBLE) / 2 AS lat, value FROM events_by_user"


def _moving(spark, sf_dir):
    e = F.col("event_id")
    return user_tracks(spark, sf_dir).select("track", "ts", (((e * 37) % 360 - 180) / 4).alias("lon"), (((e * 17) % 161 - 80) / 2).alias("lat"), "value")


@query(
    f"""WITH p AS ({_MOVING}), w AS (SELECT track, ts, coalesce(lag(lat) OVER a, lat) AS lat0, coalesce(lead(lat) OVER a, lat) AS lat1, coalesce(lag(lon) OVER a, lon) AS lon0, coalesce(lead(lon) OVER a, lon) AS lon1,
      (epoch_us(coalesce(lead(ts) OVER a, ts)) - epoch_us(coalesce(lag(ts) OVER a, ts))) / 1e6 AS dt FROM p WINDOW a AS (PARTITION BY track ORDER BY ts)),
    d AS (SELECT *, sin(radians(lat1 - lat0) / 2) ** 2 + cos(radians(lat0)) * cos(radians(lat1)) * sin(radians(lon1 - lon0) / 2) ** 2 AS h, atan2(radians(lat1 - lat0), radians(lon1 - lon0)) AS angle FROM w)
    SELECT track, ts, round(2 * 6371008.8 * atan2(sqrt(h), sqrt(1 - h)) / nullif(dt, 0) * cos(angle), 3) AS vx, round(2 * 6371008.8 * atan2(sqrt(h), sqrt(1 - h)) / nullif(dt, 0) * sin(angle), 3) AS vy FROM d""",
    "events_by_user",
)
def track_velocity(spark, sf_dir):
    return rounded(tracks.add_velocity(_moving(spark, sf_dir)).select("track", "ts", "vx", "vy"), 3, "vx", "vy")


@query("SELECT track, ts, event_id, round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY track))) / 1e6, 6) AS t FROM events_by_user", "events_by_user")
def track_elapsed(spark, sf_dir):
    return rounded(tracks.since_first(user_tracks(spark, sf_dir)).select("track", "ts", "event_id", "t"), 6, "t")


@query(
    """WITH asked AS (SELECT DISTINCT track, unnest([6, 12, 200, 100000]) AS hours FROM events_by_user), asked_at AS (SELECT track, TIMESTAMP '2024-01-01' + to_hours(CAST(hours AS BIGINT)) AS ts FROM asked),
    p AS (SELECT a.track, a.ts, arg_max(e.ts, e.ts) AS t0, arg_max(e.value, e.ts) AS v0 FROM asked_at a LEFT JOIN events_by_user e ON e.track = a.track AND e.ts <= a.ts GROUP BY a.track, a.ts),
    n AS (SELECT a.track, a.ts, arg_min(e.ts, e.ts) AS t1, arg_min(e.value, e.ts) AS v1 FROM asked_at a LEFT JOIN events_by_user e ON e.track = a.track AND e.ts >= a.ts GROUP BY a.track, a.ts)
    SELECT track, ts, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)) END, 5) AS value FROM p JOIN n USING (track, ts)""",
    "events_by_user",
)
def track_asof_lerp(spark, sf_dir):
    t = user_tracks(spark, sf_dir)
    at = t.select("track").distinct().select("track", F.explode(F.array(*[F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + interval {h} hours") for h in (6, 12, 200, 100000)])).alias("ts"))
    return rounded(tracks.interpolate(t, at, ["value"]), 5, "value")


_ISLANDS = """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY track ORDER BY ts, event_id)) > 86400000000 THEN 1 ELSE 0 END AS new FROM events_by_user),
    s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY track ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM g)"""


@query(f"{_ISLANDS} SELECT track, ts, event_id, island, CAST(row_number() OVER (PARTITION BY track, island ORDER BY ts, event_id) - 1 AS INT) AS n FROM s", "events_by_user")
def track_islands(spark, sf_dir):
    out = tracks.islands(user_tracks(spark, sf_dir), 86400.0, order=["event_id"])
    return out.select("track", "ts", "event_id", "island", "n")


@query(f"{_ISLANDS} SELECT track, island, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows FROM s GROUP BY track, island HAVING count(*) >= 5", "events_by_user")
def track_long_islands(spark, sf_dir):
    return tracks.long_islands(user_tracks(spark, sf_dir), 86400.0, 5)


@query(f"{_ISLANDS} SELECT track, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows FROM s GROUP BY track, island HAVING count(*) >= 5", "events_by_user")
def track_islands_stream(spark, sf_dir):
    """The same by a stream over the events that is drained into the shared folder, with the islands that are open at its end."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumnRenamed("user_id", "track")
    path = new_path(spark, "islands")
    ended = streams.drained(spark, streams.islands(events, 86400.0, 5), path)
    out = ended.unionByName(streams.open_islands(spark, path, 5))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@query("SELECT CAST(l_linenumber AS BIGINT) AS k, date_trunc('month', l_shipdate) AS month, avg(l_quantity) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' GROUP BY ALL")
def snapshot_range_means(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1995-01-01' and l_shipdate < timestamp_ntz'1996-01-01'")
    return li.groupBy(F.col("l_linenumber").cast("long").alias("k"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")).agg(F.avg("l_quantity").alias("q"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate = (SELECT max(l_shipdate) FROM lineitem WHERE l_shipdate <= TIMESTAMP '1996-06-15')")
def snapshot_cursor(spark, sf_dir):
    from datetime import datetime

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return streams.advance(li, datetime(1996, 6, 15), "l_shipdate").select("l_orderkey", "l_linenumber", "l_shipdate")


# ---- text fields, calendars, longitudes


@query("SELECT o_orderkey, CAST((o_orderkey * 13) % 900 AS DOUBLE) / 10 * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS lat, CAST((o_orderkey * 29) % 1800 AS DOUBLE) / 10 * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS lon FROM orders")
def atcf_latlon(spark, sf_dir):
    k = F.col("o_orderkey")
    lat = F.concat(((k * 13) % 900).cast("string"), F.when(k % 2 == 0, "N").otherwise("S"))
    lon = F.concat(((k * 29) % 1800).cast("string"), F.when(k % 3 == 0, "W").otherwise("E"))
    return table(spark, sf_dir, "orders").select("o_orderkey", calendars.tenths(lat).alias("lat"), calendars.tenths(lon).alias("lon"))


@query("SELECT o_orderkey, lpad(CAST(d // 360 AS VARCHAR), 4, '0') || lpad(CAST(d % 360 // 30 + 1 AS VARCHAR), 2, '0') || lpad(CAST(d % 30 + 1 AS VARCHAR), 2, '0') AS ymd FROM (SELECT o_orderkey, o_orderkey * 7919 // 86400 * 31 AS d FROM orders)")
def calendar360(spark, sf_dir):
    days = F.floor(F.col("o_orderkey") * 7919 / 86400) * 31
    return table(spark, sf_dir, "orders").select("o_orderkey", calendars.calendar_360(days * 86400).alias("ymd"))


@query("SELECT o_orderkey, CAST(24 * (day(o_orderdate) - 1) + hour(o_orderdate) AS INT) AS idx, date_trunc('day', o_orderdate) + to_seconds(o_orderkey % 86400) AS start FROM orders")
def file_time_index(spark, sf_dir):
    date = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", calendars.hour_of_month("o_orderdate").alias("idx"), calendars.date_and_seconds(date, F.col("o_orderkey") % 86400).alias("start"))


@query("SELECT o_orderkey, sha1('grid|' || o_orderkey || '|' || o_orderstatus) AS key FROM orders")
def request_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", calendars.request_key("grid", "o_orderkey", "o_orderstatus").alias("key"))


@query("SELECT id, ((l % 360) + 360) % 360 AS lon360, (((l + 180) % 360) + 360) % 360 - 180 AS lon180 FROM (SELECT id, lon * 2 % 360 AS l FROM nodes)", "nodes")
def wrapped_longitudes(spark, sf_dir):
    l2 = (F.col("lon") * 2) % 360
    return nodes(spark, sf_dir).select("id", wrap_360(l2).alias("lon360"), wrap_180(l2).alias("lon180"))


# ---- storms


@query(
    """WITH c AS (SELECT id, 20.0 AS clat, -60.0 AS clon, 95000.0 AS mslp, (55.0 - 5.0) / 0.7 AS v0, 40000.0 AS mrd, 2 * (2 * pi() / 86164.0905) * sin(radians(20.0)) AS f, lat, lon FROM nodes),
    r AS (SELECT *, least(2.5, greatest(1.0, 1.15 * exp(1) * v0 * v0 / (101300.0 - mslp))) AS b, sin(radians(lat - clat) / 2) ** 2 + cos(radians(clat)) * cos(radians(lat)) * sin(radians(lon - clon) / 2) ** 2 AS h FROM c),
    x AS (SELECT *, CASE WHEN h = 0 THEN mrd * 2.220446049250313e-16 ELSE 2 * 6371008.8 * atan2(sqrt(h), sqrt(1 - h)) END AS d FROM r), y AS (SELECT *, pow(mrd / d, b) AS q FROM x),
    v AS (SELECT *, sqrt(q * exp(1 - q) * v0 * v0 + d * d * f * f / 4) - d * f / 2 AS w, atan2(radians(lat - clat), radians(lon - clon)) AS th FROM y)
    SELECT id, round(mslp + (101300.0 - mslp) * exp(-q), 3) AS pressure, round(-w * sin(th) * 0.616 + w / v0 * 3, 5) AS wind_x, round(w * cos(th) * 0.616 + w / v0 * 4, 5) AS wind_y FROM v""",
    "nodes",
)
def holland_profile(spark, sf_dir):
    f = lambda x: F.lit(float(x))
    found = holland("lat", "lon", f(20), f(-60), f(95000), f(55), f(40000), f(3), f(4))
    n = nodes(spark, sf_dir).select("id", *[found[c].alias(c) for c in ("pressure", "wind_x", "wind_y")])
    return rounded(rounded(n, 3, "pressure"), 5, "wind_x", "wind_y")


# ---- eddies


_PAIRS = """WITH pr AS (SELECT o.sign, CAST(o.snapshot + 1 AS INT) AS snapshot, o.eddy AS old, n.eddy AS new, o.radius_e AS r0, n.radius_e AS r1, o.amplitude AS a0, n.amplitude AS a1,
    2 * 6371315.0 * asin(sqrt(sin(radians(n.lat - o.lat) / 2) ** 2 + cos(radians(o.lat)) * cos(radians(n.lat)) * sin(radians(n.lon - o.lon) / 2) ** 2)) AS distance,
    radians(n.lon - o.lon) * 6371315.0 * cos(radians(o.lat)) AS ex, (ln(tan(pi() / 4 + radians(n.lat) / 2)) - ln(tan(pi() / 4 + radians(o.lat) / 2))) * 6371315.0 * cos(radians(o.lat)) AS ey,
    greatest(1750.0 * 7 * cos(radians(o.lat)) * (1458e-7 / 6371315.0) * 40e3 ** 2 * 86.4, 75e3) AS west
    FROM eddies o JOIN eddies n ON n.snapshot = o.snapshot + 1 AND n.sign = o.sign AND abs(n.lat - o.lat) < 4),
    near AS (SELECT *, sqrt(((pi() * r0 * r0 - pi() * r1 * r1) / (pi() * 60e3 ** 2)) ** 2 + ((a0 - a1) / 2) ** 2 + (distance / 25e3) ** 2) AS dx FROM pr
      WHERE distance <= 200e3 AND (ex / CASE WHEN ex < 0 THEN west ELSE 150e3 END) ** 2 + (ey / 150e3) ** 2 <= 1)"""


@query(f"{_PAIRS} SELECT sign, snapshot, old, new, round(distance, 2) AS distance, round(dx, 5) AS dx FROM near", "eddies")
def eddy_candidates(spark, sf_dir):
    return rounded(rounded(ed.candidates(eddies(spark, sf_dir), 7.0), 2, "distance"), 5, "dx")


@query(f"{_PAIRS} SELECT sign, snapshot, old, new, round(distance, 2) AS distance, round(dx, 5) AS dx FROM near QUALIFY row_number() OVER (PARTITION BY sign, snapshot, old ORDER BY dx, new) = 1", "eddies")
def similarity_best_match(spark, sf_dir):
    return rounded(rounded(ed.best_matches(eddies(spark, sf_dir), 7.0), 2, "distance"), 5, "dx")


#: Greedy matching in order of the old eddies, and tracks from their first eddy on.
_GREEDY = """opts AS (SELECT sign, snapshot, old, list(new ORDER BY dx, new) AS news, row_number() OVER (PARTITION BY sign, snapshot ORDER BY old) AS k FROM near GROUP BY sign, snapshot, old),
    taken AS (SELECT DISTINCT sign, snapshot, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS done, CAST(NULL AS BIGINT) AS old, CAST(NULL AS BIGINT) AS new FROM opts
      UNION ALL SELECT sign, snapshot, k, CASE WHEN pick IS NULL THEN done ELSE list_append(done, pick) END, old, pick
      FROM (SELECT t.sign, t.snapshot, o.k, t.done, o.old, list_filter(o.news, lambda n: NOT list_contains(t.done, n))[1] AS pick FROM taken t JOIN opts o ON o.sign = t.sign AND o.snapshot = t.snapshot AND o.k = t.k + 1)),
    links AS (SELECT sign, snapshot, old, new FROM taken WHERE new IS NOT NULL),
    chain AS (SELECT sign, snapshot, eddy, snapshot AS first_snapshot, eddy AS first_eddy, CAST(0 AS BIGINT) AS n FROM eddies e WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.sign = e.sign AND l.snapshot = e.snapshot AND l.new = e.eddy)
      UNION ALL SELECT c.sign, l.snapshot, l.new, first_snapshot, first_eddy, n + 1 FROM chain c JOIN links l ON l.sign = c.sign AND l.old = c.eddy AND l.snapshot = c.snapshot + 1),
    sized AS (SELECT *, count(*) OVER (PARTITION BY sign, first_snapshot, first_eddy) AS length FROM chain)"""


@query(f"WITH RECURSIVE eddies AS ({SQL_VIEWS['eddies']}), {_PAIRS[5:]}, {_GREEDY} SELECT sign, snapshot, eddy, first_snapshot, first_eddy, n, length FROM sized WHERE length >= 2")
def eddy_tracks(spark, sf_dir):
    """Eddies with the tracks that greedy matching gives, named by their first eddy."""
    e = eddies(spark, sf_dir)
    found = ed.track(e, ed.matches(e, 7.0), 2)
    first = F.min(F.struct("snapshot", "eddy")).over(Window.partitionBy("track"))
    return found.withColumn("first", first).select("sign", "snapshot", "eddy", F.col("first.snapshot").alias("first_snapshot"), F.col("first.eddy").alias("first_eddy"), "n", "length")


@query()
def eddy_detection(spark, sf_dir):
    """Eddies of a smoothed field; tests compare detection with planted bumps."""
    from ..operators.stencils import hann

    f = hann(field(spark, sf_dir), "v", 3)
    f = f.select(F.lit(0).alias("snapshot"), "i", "j", (F.col("i") * 0.25 - 30).alias("lon"), (F.col("j") * 0.25 + 30).alias("lat"), ((F.col("v") - 25.5) * 10).alias("sla"), F.lit(1.0).alias("speed"), F.lit(1.0).alias("eke"))
    found = ed.detect(f, ed.Limits(levels=tuple(float(x) for x in range(-40, 41, 2)), least_cells=4, least_amplitude=0.5))
    return rounded(found.select("snapshot", "sign", "level", "lon", "lat", "amplitude", "radius_e", "n_cells"), 6, "lon", "lat", "amplitude", "radius_e")
