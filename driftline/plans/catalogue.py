"""The registered queries of the trajectory operators, bound to the given tables, with their SQL counterparts.

``events`` stands for a sensor log: the user is the trip, seconds since 2024-01-01 are the time, ``value`` is the
signal and ``props.k`` a second measurement. A user has about two events a day, so durations are in hours here.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import angles, motion
from ..operators import alignment, benchmark, keyed, learning, matching, outages, roads, trips, validity
from ..sources import replays, tables, versions
from . import kernel_sql

FLAGSHIP = "q27_hold_last_value"
SIX_HOURS, HALF_DAY, DAY = 21600.0, 43200.0, 86400.0

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name with its SQL."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def r(c: Column | str, places: int = 6) -> Column:
    return F.round(c, places)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, trip, t, value, kind, k, i``; ``i`` numbers a trip's events from 0 in order of time."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("trip"), (micros / 1e6).alias("t"), "value", F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").cast("long").alias("k"), "ts",
    )
    nth = F.row_number().over(Window.partitionBy("trip").orderBy("t", "event_id")) - 1
    return rows.withColumn("i", nth.cast("long"))


EV = """ev AS (
  SELECT event_id, user_id AS trip, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t, value, event_type AS kind,
    CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS k, ts,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i
  FROM events)"""
TAU = "2*pi()"


def pmod(x: str, y: str) -> str:
    return f"(((({x}) % ({y})) + ({y})) % ({y}))"


def _turn(x: Column) -> Column:
    """The remainder by 360 as :func:`pmod` has it, to the last digit; half turns are decided by it."""
    return (x % 360.0 + 360.0) % 360.0


def wrap(x: str) -> str:
    return f"({pmod(f'({x}) + pi()', TAU)} - pi())"


@query(f"""WITH {EV}, x AS (SELECT *, lag(value) OVER (PARTITION BY trip ORDER BY event_id) AS b FROM ev)
SELECT trip, event_id, value FROM x WHERE b IS NULL OR value > b""")
def q01_monotonic_filter(spark, sf_dir):
    return alignment.monotonic_filter(events(spark, sf_dir), "trip", "event_id", "value").select("trip", "event_id", "value")


@query("""SELECT event_id, round(h * 3600 + m * 60 + s + ms / 1000.0, 3) AS sod, round_even((h * 3600 + m * 60 + s + ms / 1000.0) / 3600, 0) * 3600 AS hours
FROM (SELECT event_id, CAST(hour(ts) AS DOUBLE) AS h, minute(ts) AS m, epoch_us(ts) // 1000000 % 60 AS s, epoch_us(ts) // 1000 % 1000 AS ms FROM events)""")
def q02_time_of_day(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd HH-mm-ss_SSS")
    sod = angles.seconds_of_day(stamp)
    return table(spark, sf_dir, "events").select("event_id", r(sod, 3).alias("sod"), angles.whole_hours(sod).alias("hours"))


def _grid(ev: DataFrame) -> DataFrame:
    bounds = ev.groupBy("trip").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    return alignment.common_grid(bounds, "trip", "low", "high", SIX_HOURS)


def _gridded(ev: DataFrame) -> DataFrame:
    return alignment.interpolate(_grid(ev), ev.select("trip", "t", "value"), "trip", "t", ["value"])


GRID = f"""{EV}, p AS (
  SELECT trip, idx, idx * 21600.0 AS t FROM (
    SELECT trip, unnest(range(CAST(ceil(min(t) / 21600.0) AS BIGINT), CAST(ceil(max(t) / 21600.0) AS BIGINT))) AS idx FROM ev GROUP BY trip)),
gv AS (
  SELECT p.trip, p.idx, p.t, a.value + (b.value - a.value) * CASE WHEN b.t > a.t THEN (p.t - a.t) / (b.t - a.t) ELSE 0 END AS value
  FROM p ASOF JOIN ev a ON p.trip = a.trip AND p.t >= a.t ASOF JOIN ev b ON p.trip = b.trip AND p.t <= b.t)"""


@query(f"WITH {GRID} SELECT trip, idx, round(value, 6) AS value FROM gv")
def q03_grid_resample_linear(spark, sf_dir):
    return _gridded(events(spark, sf_dir)).select("trip", "idx", r("value").alias("value"))


@query(f"""WITH {EV} SELECT c.trip, c.event_id, round(v.t, 3) AS at, v.value AS view_value FROM (SELECT * FROM ev WHERE kind = 'click') c
ASOF LEFT JOIN (SELECT * FROM ev WHERE kind = 'view') v ON c.trip = v.trip AND c.t >= v.t""")
def q04_asof_backward(spark, sf_dir):
    ev = events(spark, sf_dir)
    probes, samples = ev.where("kind = 'click'").select("trip", "t", "event_id"), ev.where("kind = 'view'")
    out = alignment.asof_backward(probes, samples, "trip", "t", ["value"], bucket=5 * DAY)
    return out.select("trip", "event_id", r("at", 3).alias("at"), F.col("value").alias("view_value"))


@query(f"""WITH {GRID}, s AS (SELECT trip, t, coalesce(lead(t) OVER (PARTITION BY trip ORDER BY t) - t, t - lag(t) OVER (PARTITION BY trip ORDER BY t)) AS step FROM ev)
SELECT p.trip, p.idx, coalesce(s.step <= 43200.0, false) AS ok FROM p ASOF LEFT JOIN s ON p.trip = s.trip AND p.t >= s.t""")
def q05_gap_mask(spark, sf_dir):
    ev = events(spark, sf_dir)
    return alignment.gap_free(_grid(ev), ev.select("trip", "t"), "trip", "t", HALF_DAY).select("trip", "idx", "ok")


def _islands(ev: DataFrame) -> DataFrame:
    return validity.islands(ev.withColumn("valid", F.col("k") % 8 != 0), "trip", "i", "valid", width=32)


ISLANDS = f"""{EV}, b AS (SELECT *, k % 8 <> 0 AS valid, sum(CASE WHEN k % 8 <> 0 THEN 0 ELSE 1 END) OVER (PARTITION BY trip ORDER BY i) AS g FROM ev),
isl AS (SELECT *, CASE WHEN valid THEN min(CASE WHEN valid THEN i END) OVER (PARTITION BY trip, g) ELSE -1 END AS run_start FROM b)"""


@query(f"WITH {ISLANDS} SELECT trip, i, run_start FROM isl")
def q06_islands(spark, sf_dir):
    return _islands(events(spark, sf_dir)).select("trip", "i", "run_start")


@query(f"""WITH {EV}, x AS (SELECT trip, i, row_number() OVER w = 1 OR kind IS DISTINCT FROM lag(kind) OVER w OR (k // 25) IS DISTINCT FROM lag(k // 25) OVER w AS is_new FROM ev WINDOW w AS (PARTITION BY trip ORDER BY i))
SELECT trip, i, is_new, CAST(sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY trip ORDER BY i) AS BIGINT) AS change_id FROM x""")
def q07_change_ids(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("level", F.floor(F.col("k") / 25))
    return alignment.change_ids(ev, "trip", "i", ["kind", "level"], width=32).select("trip", "i", "is_new", "change_id")


@query(f"""WITH {EV}, a AS (SELECT trip, i, {pmod('value * 7', '360.0')} AS angle FROM ev),
s AS (SELECT *, angle - lag(angle) OVER (PARTITION BY trip ORDER BY i) AS step FROM a),
u AS (SELECT trip, i, angle + 360.0 * sum(coalesce(-floor((step + 180) / 360.0), 0)) OVER (PARTITION BY trip ORDER BY i) AS u FROM s)
SELECT trip, i, round(u, 6) AS unwrapped, round({pmod('u', '360.0')}, 6) AS wrapped FROM u""")
def q08_unwrap_angle(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("angle", _turn(F.col("value") * 7))
    out = alignment.unwrapped(ev, "trip", "i", "angle", width=32)
    return out.select("trip", "i", r("unwrapped").alias("unwrapped"), r(_turn(F.col("unwrapped"))).alias("wrapped"))


@query(f"""WITH {ISLANDS}, w AS (SELECT trip, i + 1 AS e, run_start, list(value) OVER (PARTITION BY trip ORDER BY i ROWS 7 PRECEDING) AS x FROM isl)
SELECT trip, e AS "end", x AS "window" FROM w WHERE len(x) = 8 AND run_start >= 0 AND e - 8 >= run_start AND (e - 8) % 3 = 0""")
def q09_sliding_windows(spark, sf_dir):
    return validity.sliding_windows(_islands(events(spark, sf_dir)), "trip", "i", F.col("value"), 8, 3)


BLOCKS = f"""{EV}, g AS (
  SELECT trip, i // 16 AS block, count(*) FILTER (value > 2) AS n, avg(value) FILTER (value > 2) AS ea, avg(CAST(k AS DOUBLE)) FILTER (value > 2) AS eb,
    avg(value * k) FILTER (value > 2) AS eab, stddev_pop(value) FILTER (value > 2) AS sa, stddev_pop(CAST(k AS DOUBLE)) FILTER (value > 2) AS sb FROM ev GROUP BY ALL),
bl AS (SELECT trip, block, n, CASE WHEN n > 6 AND sb > 0.02 THEN (eab - ea * eb) / nullif(sa * sb, 0) END AS r FROM g)"""


def _blocks(ev: DataFrame) -> DataFrame:
    return validity.block_agreement(ev.withColumn("kd", F.col("k").cast("double")), "trip", "i", "value", "kd", F.col("value") > 2, 16, 6, 0.02)


@query(f"""WITH {BLOCKS} SELECT bl.trip, bl.block, bl.n, round(bl.r, 6) AS r, m.median AS trip_median FROM bl
JOIN (SELECT trip, round(median(r), 6) AS median FROM bl GROUP BY trip) m USING (trip)""")
def q10_block_agreement(spark, sf_dir):
    blocks = _blocks(events(spark, sf_dir))
    medians = blocks.groupBy("trip").agg(r(F.percentile("r", 0.5)).alias("trip_median"))
    return blocks.join(medians, "trip").select("trip", "block", "n", r("r").alias("r"), "trip_median")


@query(f"""WITH {BLOCKS} SELECT ev.trip, count(*) AS samples, count(*) FILTER (bl.r IS NULL OR bl.r >= 0.1) AS valid
FROM ev JOIN bl ON ev.trip = bl.trip AND ev.i // 16 = bl.block GROUP BY ALL""")
def q10b_marked_blocks(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("valid", F.lit(True))
    marked = validity.mark_blocks(ev, _blocks(ev), "trip", "i", "valid", 16, 0.1)
    return marked.groupBy("trip").agg(F.count("*").alias("samples"), F.count(F.when(F.col("valid"), 1)).alias("valid"))


LAGS = f"""{EV}, h AS (SELECT CAST(floor(t / 3600) AS BIGINT) AS i, avg(value) FILTER (kind = 'view') AS a, avg(value) FILTER (kind = 'click') AS b FROM ev GROUP BY ALL),
hh AS (SELECT * FROM h WHERE a IS NOT NULL AND b IS NOT NULL),
z AS (SELECT i, (a - avg(a) OVER ()) / (stddev_pop(a) OVER () + 1e-9) AS za, (b - avg(b) OVER ()) / (stddev_pop(b) OVER () + 1e-9) AS zb FROM hh),
c AS (SELECT y.i - x.i AS lag, avg(x.za * y.zb) AS r FROM z x JOIN z y ON y.i - x.i BETWEEN -50 AND 50 GROUP BY ALL)"""


def _lags(spark, sf_dir) -> DataFrame:
    hours = events(spark, sf_dir).groupBy(F.floor(F.col("t") / 3600).alias("hour")).agg(
        F.avg(F.when(F.col("kind") == "view", F.col("value"))).alias("a"), F.avg(F.when(F.col("kind") == "click", F.col("value"))).alias("b")
    )
    return alignment.lag_correlation(hours.where("a IS NOT NULL AND b IS NOT NULL"), "hour", "a", "b", 50)


@query(f"WITH {LAGS} SELECT CAST(lag AS INTEGER) AS lag, round(r, 6) AS r FROM c")
def q11_lag_correlation(spark, sf_dir):
    return _lags(spark, sf_dir).select("lag", r("r").alias("r"))


@query(f"WITH {LAGS} SELECT CAST(lag AS INTEGER) AS lag, round(r, 6) AS r FROM c ORDER BY c.r DESC, c.lag LIMIT 1")
def q11b_best_lag(spark, sf_dir):
    return alignment.best_lag(_lags(spark, sf_dir)).select("lag", r("r").alias("r"))


def _corr_sql(a: str) -> str:
    return f"CASE WHEN count(*) > 20 THEN coalesce((avg({a} * target) - avg({a}) * avg(target)) / nullif(stddev_pop({a}) * stddev_pop(target), 0), 0) ELSE 0 END"


@query(f"""WITH {EV}, x AS (SELECT trip, value AS yaw, CAST(k AS DOUBLE) AS roll, value - k * 0.7 AS pitch, value * 0.3 + (event_id % 7) AS target FROM ev),
c AS (SELECT trip, {_corr_sql('yaw')} AS yaw, {_corr_sql('roll')} AS roll, {_corr_sql('pitch')} AS pitch FROM x GROUP BY trip)
SELECT trip, CASE WHEN abs(yaw) >= abs(roll) AND abs(yaw) >= abs(pitch) THEN 'yaw' WHEN abs(roll) >= abs(pitch) THEN 'roll' ELSE 'pitch' END AS axis,
  round(CASE WHEN abs(yaw) >= abs(roll) AND abs(yaw) >= abs(pitch) THEN yaw WHEN abs(roll) >= abs(pitch) THEN roll ELSE pitch END, 6) AS r FROM c""")
def q12_axis_pick(spark, sf_dir):
    v, k = F.col("value"), F.col("k").cast("double")
    ev = events(spark, sf_dir).select("trip", v.alias("yaw"), k.alias("roll"), (v - k * 0.7).alias("pitch"), (v * 0.3 + F.col("event_id") % 7).alias("target"))
    return alignment.pick_axis(ev, "trip", ["yaw", "roll", "pitch"], "target", 20).select("trip", "axis", r("r").alias("r"))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS channel, round(avg({c}), 4) AS mean, round(greatest(stddev_pop({c}), 1e-6), 4) AS std FROM lineitem" for c in _MEASURES))
def q13_normalisation(spark, sf_dir):
    return validity.channel_statistics(table(spark, sf_dir, "lineitem"), _MEASURES).select("channel", r("mean", 4).alias("mean"), r("std", 4).alias("std"))


@query(f"""WITH {EV} SELECT trip, count(*) AS samples, round((max(t) - min(t)) / 60, 4) AS duration_min, round(100 * avg(CASE WHEN k % 8 <> 0 THEN 1.0 ELSE 0.0 END), 4) AS valid_pct,
round(sum(CASE WHEN k % 8 <> 0 THEN value ELSE 0 END) * 0.1 / 1000, 6) AS distance_km FROM ev GROUP BY trip""")
def q14_trip_metadata(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("valid", F.col("k") % 8 != 0)
    m = validity.trip_metadata(ev, "trip", "t", "value", "valid", 0.1)
    return m.select("trip", "samples", r("duration_min", 4).alias("duration_min"), r("valid_pct", 4).alias("valid_pct"), r("distance_km").alias("distance_km"))


@query(f"""WITH {EV}, c AS (SELECT event_id, {pmod('value * 36.5', '360.0')} AS course FROM ev), p AS (SELECT *, {wrap('pi() / 2 - radians(course)')} AS psi FROM c)
SELECT event_id, round(psi, 9) AS psi, round({pmod('degrees(pi() / 2 - psi)', '360.0')}, 6) AS course, round(course / 3.6, 6) AS mps FROM p""")
def q15_compass_wrap(spark, sf_dir):
    ev = events(spark, sf_dir).select("event_id", F.pmod(F.col("value") * 36.5, F.lit(360.0)).alias("c"))
    ev = ev.withColumn("p", angles.compass_to_psi(F.col("c")))
    return ev.select("event_id", r("p", 9).alias("psi"), r(angles.psi_to_compass(F.col("p"))).alias("course"), r(angles.kmh_to_mps(F.col("c"))).alias("mps"))


LAT0, LON0 = 52.40, -1.50
A, E2 = angles.WGS84_A, angles.WGS84_E2


def _places(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    out = table(spark, sf_dir, "customer").select(key, (LAT0 + key % 1000 / 10000).alias("lat"), (LON0 + key % 777 / 7770).alias("lon"))
    east, north = angles.to_enu(F.col("lat"), F.col("lon"), F.lit(LAT0), F.lit(LON0))
    return out.withColumn("east", east).withColumn("north", north)


def _ecef_sql(lat: str, lon: str) -> tuple[str, str, str]:
    n = f"({A!r} / sqrt(1 - {E2!r} * sin(radians({lat})) * sin(radians({lat}))))"
    return f"{n} * cos(radians({lat})) * cos(radians({lon}))", f"{n} * cos(radians({lat})) * sin(radians({lon}))", f"{n} * {1 - E2!r} * sin(radians({lat}))"


def _enu_sql() -> str:
    d = [f"({a} - {b})" for a, b in zip(_ecef_sql("lat", "lon"), _ecef_sql(str(LAT0), str(LON0)), strict=True)]
    la, lo = math.radians(LAT0), math.radians(LON0)
    sl, cl, so, co = math.sin(la), math.cos(la), math.sin(lo), math.cos(lo)
    return f"({-so!r}) * {d[0]} + ({co!r}) * {d[1]} AS east, ({-sl * co!r}) * {d[0]} + ({-sl * so!r}) * {d[1]} + ({cl!r}) * {d[2]} AS north"


PLACES = f"pl AS (SELECT c_custkey, {LAT0} + c_custkey % 1000 / 10000.0 AS lat, {LON0} + c_custkey % 777 / 7770.0 AS lon FROM customer), en AS (SELECT *, {_enu_sql()} FROM pl)"


@query(f"WITH {PLACES} SELECT c_custkey, round(east, 4) AS east, round(north, 4) AS north FROM en")
def q16_geodetic_enu(spark, sf_dir):
    return _places(spark, sf_dir).select("c_custkey", r("east", 4).alias("east"), r("north", 4).alias("north"))


def _inverse_sql(source: str, rounds: int = 3) -> str:
    la, lo = math.radians(LAT0), math.radians(LON0)
    x0, y0, z0 = _ecef_sql(str(LAT0), str(LON0))
    x = f"{x0} - ({math.sin(lo)!r}) * east - ({math.sin(la) * math.cos(lo)!r}) * north"
    y = f"{y0} + ({math.cos(lo)!r}) * east - ({math.sin(la) * math.sin(lo)!r}) * north"
    q = f"SELECT *, atan2(z, p * {1 - E2!r}) AS phi FROM (SELECT *, sqrt(x * x + y * y) AS p FROM (SELECT *, {x} AS x, {y} AS y, {z0} + ({math.cos(la)!r}) * north AS z FROM {source}))"
    for _ in range(rounds):
        q = f"SELECT * REPLACE (atan2(z + {E2!r} * {A!r} / sqrt(1 - {E2!r} * sin(phi) * sin(phi)) * sin(phi), p) AS phi) FROM ({q})"
    return q


@query(f"WITH {PLACES} SELECT c_custkey, round(degrees(phi), 9) AS lat, round(degrees(atan2(y, x)), 9) AS lon, abs(degrees(phi) - lat) < 2e-6 AND abs(degrees(atan2(y, x)) - lon) < 2e-6 AS within FROM ({_inverse_sql('en')})")
def q17_enu_roundtrip(spark, sf_dir):
    """Coordinates brought back from the tangent plane, and whether they are within 2e-6 degrees of where they began.

    A point on the ellipsoid lies below the tangent plane, which moves it by its height's share.
    """
    p = _places(spark, sf_dir)
    lat, lon = angles.to_geodetic(F.col("east"), F.col("north"), F.lit(LAT0), F.lit(LON0))
    within = (F.abs(lat - F.col("lat")) < 2e-6) & (F.abs(lon - F.col("lon")) < 2e-6)
    return p.select("c_custkey", r(lat, 9).alias("lat"), r(lon, 9).alias("lon"), within.alias("within"))


def _samples(ev: DataFrame) -> DataFrame:
    k, i = F.col("k"), F.col("event_id")
    return ev.select(
        "event_id", "trip", "t", "i", ((k % 5 - 2) * 0.4).alias("ax"), ((i % 5 - 2) * 0.3).alias("ay"), (9.8 + (k % 7 - 3) * 0.5).alias("az"),
        ((i % 4) * 0.06).alias("gx"), ((k % 3) * 0.01).alias("gy"), ((k % 11) * 0.02).alias("gz"), (0.5 * (k % 3)).alias("dx"), (0.3 * (i % 4)).alias("dy"), F.lit(9.7).alias("dz"),
    )


SAMPLES = f"""{EV}, sm AS (SELECT event_id, trip, t, i, (k % 5 - 2) * 0.4::DOUBLE AS ax, (event_id % 5 - 2) * 0.3::DOUBLE AS ay, 9.8::DOUBLE + (k % 7 - 3) * 0.5::DOUBLE AS az,
(event_id % 4) * 0.06::DOUBLE AS gx, (k % 3) * 0.01::DOUBLE AS gy, (k % 11) * 0.02::DOUBLE AS gz, 0.5::DOUBLE * (k % 3) AS dx, 0.3::DOUBLE * (event_id % 4) AS dy, 9.7::DOUBLE AS dz FROM ev)"""
G = motion.G


@query(f"""WITH {SAMPLES}, z AS (SELECT *, dx / sqrt(dx*dx+dy*dy+dz*dz) AS zx, dy / sqrt(dx*dx+dy*dy+dz*dz) AS zy, dz / sqrt(dx*dx+dy*dy+dz*dz) AS zz FROM sm),
y AS (SELECT *, -zy*zx / sqrt(1-zy*zy) AS yx, (1-zy*zy) / sqrt(1-zy*zy) AS yy, -zy*zz / sqrt(1-zy*zy) AS yz FROM z),
x AS (SELECT *, yy*zz-yz*zy AS xx, yz*zx-yx*zz AS xy, yx*zy-yy*zx AS xz FROM y)
SELECT event_id, round(CAST(CAST(xx*ax+xy*ay+xz*az AS FLOAT) AS DOUBLE), 4) AS a1, round(CAST(CAST(yx*ax+yy*ay+yz*az AS FLOAT) AS DOUBLE), 4) AS a2, round(CAST(CAST(zx*ax+zy*ay+zz*az - {G} AS FLOAT) AS DOUBLE), 4) AS av, round(CAST(CAST(xx*gx+xy*gy+xz*gz AS FLOAT) AS DOUBLE), 4) AS w1,
round(CAST(CAST(yx*gx+yy*gy+yz*gz AS FLOAT) AS DOUBLE), 4) AS w2, round(CAST(CAST(zx*gx+zy*gy+zz*gz AS FLOAT) AS DOUBLE), 4) AS w_yaw, round(CAST(CAST(sqrt(ax*ax+ay*ay+az*az) - {G} AS FLOAT) AS DOUBLE), 4) AS a_excess,
round(CAST(CAST(sqrt(pow(xx*ax+xy*ay+xz*az, 2) + pow(yx*ax+yy*ay+yz*az, 2)) AS FLOAT) AS DOUBLE), 4) AS a_horizontal, round(CAST(CAST(sqrt(gx*gx+gy*gy+gz*gz) AS FLOAT) AS DOUBLE), 4) AS w_total FROM x""")
def q18_levelled_features(spark, sf_dir):
    s = _samples(events(spark, sf_dir))
    v = lambda *c: tuple(F.col(x) for x in c)
    return s.select("event_id", *[r(c.cast("double"), 4).alias(n) for n, c in motion.feature_channels(v("ax", "ay", "az"), v("gx", "gy", "gz"), v("dx", "dy", "dz")).items()])


@query(f"WITH {EV} SELECT trip, CAST(floor(t / 86400) AS BIGINT) AS bin, round(avg(value), 6) AS value, count(*) AS n, (floor(t / 86400) + 1) * 86400.0 AS t_end FROM ev GROUP BY ALL")
def q19_decimate_blocks(spark, sf_dir):
    out = validity.block_means(events(spark, sf_dir), "trip", "t", ["value"], DAY)
    return out.select("trip", "bin", r("value").alias("value"), "n", "t_end")


@query(f"""WITH {EV}, b AS (SELECT *, min(t) OVER (PARTITION BY trip) + 43200.0 AS first_end FROM ev),
g AS (SELECT trip, first_end, CASE WHEN t < first_end THEN 0 ELSE floor((t - first_end) / 86400.0) + 1 END AS bin, value, k FROM b),
m AS (SELECT trip, bin, first_end + bin * 86400.0 AS t_end, avg(value) AS v, avg(CAST(k AS DOUBLE)) AS kk, max(bin) OVER (PARTITION BY trip) AS last_bin FROM g GROUP BY trip, bin, first_end)
SELECT trip, round(t_end, 2) AS t_end, round(v, 6) AS value, round(kk, 6) AS k FROM m WHERE bin < last_bin""")
def q20_decimator_exact(spark, sf_dir):
    ev = events(spark, sf_dir).select("trip", "t", F.array("value", F.col("k").cast("double")).alias("values"))
    out = keyed.decimate(ev, "trip", DAY)
    return out.select("trip", r("t_end", 2).alias("t_end"), r(F.col("means")[0]).alias("value"), r(F.col("means")[1]).alias("k"))


@query(f"""WITH RECURSIVE {SAMPLES}, q AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) AS size, sqrt(gx*gx+gy*gy+gz*gz) AS turn FROM sm),
s AS (
  SELECT trip, i, CASE WHEN size > 0.8*{G} AND size < 1.2*{G} THEN [ax, ay, az] END AS g FROM q WHERE i = 0
  UNION ALL
  SELECT q.trip, q.i, CASE WHEN s.g IS NULL THEN CASE WHEN size > 0.8*{G} AND size < 1.2*{G} THEN [ax, ay, az] END
    WHEN size > 0.9*{G} AND size < 1.1*{G} AND turn < 0.2 THEN [s.g[1]+0.01*(ax-s.g[1]), s.g[2]+0.01*(ay-s.g[2]), s.g[3]+0.01*(az-s.g[3])] ELSE s.g END
  FROM s JOIN q ON q.trip = s.trip AND q.i = s.i + 1)
SELECT trip, i, round(CASE WHEN g IS NULL THEN 0.0 ELSE g[1]/sqrt(g[1]*g[1]+g[2]*g[2]+g[3]*g[3]) END, 6) AS down_x,
  round(CASE WHEN g IS NULL THEN 1.0 ELSE g[3]/sqrt(g[1]*g[1]+g[2]*g[2]+g[3]*g[3]) END, 6) AS down_z FROM s""")
def q21_gated_gravity(spark, sf_dir):
    s = _samples(events(spark, sf_dir))
    out = alignment.gravity_directions(s.select("trip", "i", "ax", "ay", "az", "gx", "gy", "gz"), "trip", "i", width=32)
    return out.select("trip", "i", r("down_x").alias("down_x"), r("down_z").alias("down_z"))


def _trips(ev: DataFrame) -> DataFrame:
    return ev.groupBy("trip").agg(F.count("*").alias("n"))


def _tiles(ev: DataFrame) -> DataFrame:
    return outages.tiled_outages(_trips(ev), "trip", "n", 4, 5, 3)


TILES = 'tl AS (SELECT trip, CAST((s - 4) / 8 AS INTEGER) AS outage, s AS start, s + 5 AS "end" FROM (SELECT trip, unnest(range(4, count(*) - 5, 8)) AS s FROM ev GROUP BY trip))'


@query(f"WITH {EV}, {TILES} SELECT * FROM tl")
def q22_tiled_outages(spark, sf_dir):
    return _tiles(events(spark, sf_dir))


def _distance_candidates(ev: DataFrame) -> DataFrame:
    speed = F.col("value") + 1.0
    before = Window.partitionBy("trip").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    cum = ev.select("trip", "i", (F.col("k") % 8 != 0).alias("valid"), F.coalesce(F.sum(speed).over(before), F.lit(0.0)).alias("cum"))
    probes = cum.select("trip", F.col("i").alias("start"), (F.col("cum") + 200.0).alias("cum"))
    # the first frame whose distance is at least the target is one that gets farther than all before; while a vehicle
    # stands or goes back, or a value lacks, none is
    peaks = cum.withColumn("peak", F.max("cum").over(before)).where(F.col("peak").isNull() | (F.col("cum") > F.col("peak")))
    met = alignment.asof_forward(probes, peaks, "trip", "cum", ["i"]).withColumnRenamed("i", "end")
    bad = F.sum(F.when(F.col("valid"), 0).otherwise(1)).over(Window.partitionBy("trip").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    bad = cum.select("trip", "i", F.coalesce(bad, F.lit(0)).alias("bad"))
    met = met.join(bad.withColumnsRenamed({"i": "start", "bad": "b1"}), ["trip", "start"]).join(bad.withColumnsRenamed({"i": "end", "bad": "b2"}), ["trip", "end"], "left")
    n = F.col("end") - F.col("start")
    fits = F.coalesce((n <= 12) & F.try_divide(F.lit(200.0), n).between(10.0, 100.0) & (F.col("b2") == F.col("b1")), F.lit(False))
    return met.select("trip", "start", "end", fits.alias("fits"))


@query(f"""WITH RECURSIVE {EV}, c AS (SELECT trip, i, coalesce(sum(value + 1.0) OVER (PARTITION BY trip ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum,
  coalesce(sum(CASE WHEN k % 8 <> 0 THEN 0 ELSE 1 END) OVER (PARTITION BY trip ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad FROM ev),
d AS (SELECT a.trip, a.i AS start, min(b.i) AS e FROM c a JOIN c b ON a.trip = b.trip AND b.cum >= a.cum + 200.0 GROUP BY ALL),
f AS (SELECT d.trip, d.start, d.e, (d.e - d.start <= 12 AND 200.0 / (d.e - d.start) BETWEEN 10 AND 100 AND y.bad = x.bad) AS fits
  FROM d JOIN c x ON x.trip = d.trip AND x.i = d.start JOIN c y ON y.trip = d.trip AND y.i = d.e),
p AS (SELECT trip, CAST(2 AS BIGINT) AS start FROM (SELECT DISTINCT trip FROM ev) UNION ALL SELECT p.trip, CASE WHEN fits THEN e + 3 ELSE p.start + 1 END FROM p JOIN f ON f.trip = p.trip AND f.start = p.start)
SELECT p.trip, p.start, f.e AS "end" FROM p JOIN f ON f.trip = p.trip AND f.start = p.start WHERE fits""")
def q23_distance_outages(spark, sf_dir):
    ev = events(spark, sf_dir)
    return outages.distance_outages(tables.shared_table(spark, _distance_candidates(ev), "candidates"), "trip", 2, 3, 1)


@query(f"""WITH {EV}, {TILES} SELECT ev.trip, ev.i, count(tl.start) > 0 AS in_outage FROM ev LEFT JOIN tl ON ev.trip = tl.trip AND ev.i >= tl.start AND ev.i < tl."end" GROUP BY ALL""")
def q24_outage_mask(spark, sf_dir):
    ev = events(spark, sf_dir)
    return outages.masked(ev.select("trip", "i"), _tiles(ev), "trip", "i")


def _estimates(ev: DataFrame) -> DataFrame:
    k, i = F.col("k"), F.col("i")
    mode = F.when(k % 3 == 0, outages.AIDED).when(k % 3 == 1, outages.DEAD_RECKONING).otherwise(outages.REACQUISITION)
    return ev.select(
        "trip", "i", (F.col("value") + 1.0).alias("speed"), (k % 40 != 0).alias("valid"), (i * 10.0).alias("e"), (i * 3.0).alias("n"),
        (i * 10.0 + k % 5).alias("est_e"), (i * 3.0 - k % 4).alias("est_n"), mode.alias("mode"),
    )


def _scores(ev: DataFrame) -> DataFrame:
    return outages.score_outages(_estimates(ev), _tiles(ev), "trip", "i", 0.5)


SCORES = f"""{EV}, {TILES}, es AS (SELECT trip, i, value + 1.0 AS speed, k % 40 <> 0 AS valid, sqrt(pow(k % 5, 2) + pow(k % 4, 2)) AS err, k % 3 <> 0 AS dr FROM ev),
so AS (
  SELECT tl.trip, tl.start, tl."end", 2.5::DOUBLE AS duration_s, sum(speed * 0.5::DOUBLE) FILTER (i >= start) AS distance_m, sum(speed * 0.5::DOUBLE) FILTER (i >= start) / 2.5::DOUBLE AS mean_speed_mps,
    bool_and(valid) FILTER (i >= start) AS valid, max(err) FILTER (i = start - 1) AS err_start_m, max(err) FILTER (i = "end" - 1) AS err_end_m, max(err) FILTER (i >= start) AS err_max_m,
    avg(CAST(dr AS INTEGER)) FILTER (i >= start) AS dr_fraction, (min(i) FILTER (dr AND i >= start) - start) * 0.5::DOUBLE AS switch_latency_s
  FROM tl JOIN es ON es.trip = tl.trip AND es.i >= tl.start - 1 AND es.i < tl."end" GROUP BY tl.trip, tl.start, tl."end"),
sc AS (SELECT *, 100 * err_end_m / distance_m AS drift_pct FROM so)"""
_SCORED = ["duration_s", "distance_m", "mean_speed_mps", "err_start_m", "err_end_m", "err_max_m", "drift_pct", "dr_fraction", "switch_latency_s"]


@query(f"""WITH {SCORES} SELECT trip, start, "end", valid, {', '.join(f'round({c}, 6) AS {c}' for c in _SCORED)} FROM sc""")
def q25_score_outages(spark, sf_dir):
    return _scores(events(spark, sf_dir)).select("trip", "start", "end", "valid", *[r(c).alias(c) for c in _SCORED])


def _summary_sql(by: str) -> str:
    return f"""SELECT {by}, count(*) AS n, round(quantile_cont(drift_pct, 0.5), 6) AS drift_pct_median, round(avg(drift_pct), 6) AS drift_pct_mean, round(quantile_cont(drift_pct, 0.9), 6) AS drift_pct_p90,
round(avg(CASE WHEN drift_pct < 10 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate_10pct, round(quantile_cont(err_end_m, 0.5), 6) AS err_end_m_median, round(quantile_cont(err_end_m, 0.9), 6) AS err_end_m_p90,
round(quantile_cont(distance_m, 0.5), 6) AS distance_m_median, round(quantile_cont(switch_latency_s, 0.5), 6) AS switch_latency_s_median"""


@query(f"WITH {SCORES} {_summary_sql('trip % 3 AS scenario')} FROM sc WHERE valid AND mean_speed_mps >= 3 GROUP BY trip % 3")
def q26_summary(spark, sf_dir):
    kept = outages.scored_only(_scores(events(spark, sf_dir))).withColumn("scenario", F.col("trip") % 3)
    s = outages.summarise(kept, ["scenario"])
    return s.select("scenario", "n", *[r(c).alias(c) for c in s.columns if c not in ("scenario", "n")])


HOLD = f"""{GRID}, fr AS (SELECT trip, idx - min(idx) OVER (PARTITION BY trip) AS i, value AS speed, value >= 1 AS valid FROM gv),
ho AS (SELECT trip, unnest(range(4, count(*) - 10, 6)) AS start FROM fr GROUP BY trip),
he AS (SELECT ho.trip, ho.start, sum(speed) FILTER (i >= start) AS s, max(speed) FILTER (i = start) AS held, bool_and(valid) AS valid
  FROM ho JOIN fr ON fr.trip = ho.trip AND fr.i >= ho.start - 4 AND fr.i < ho.start + 10 GROUP BY ALL),
hs AS (SELECT trip, start, s * 6.0 AS distance_m, 100 * abs(held * 10 - s) / s AS error_pct FROM he WHERE valid AND s / 10 >= 3)"""


def _held(spark, sf_dir) -> DataFrame:
    grid = _gridded(events(spark, sf_dir))
    first = F.min("idx").over(Window.partitionBy("trip"))
    frames = grid.select("trip", (F.col("idx") - first).alias("i"), F.col("value").alias("speed"), (F.col("value") >= 1).alias("valid"))
    return outages.hold_last_errors(frames, outages.outage_grid(frames, "trip", "i", 4, 10, 6), "trip", "i", 6.0)


@query(f"""WITH {HOLD} SELECT trip, count(*) AS n, round(quantile_cont(error_pct, 0.5), 6) AS median_pct, round(avg(error_pct), 6) AS mean_pct, round(quantile_cont(error_pct, 0.9), 6) AS p90_pct,
round(avg(CASE WHEN error_pct < 10 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(sum(distance_m), 4) AS distance_m FROM hs GROUP BY trip""")
def q27_hold_last_value(spark, sf_dir):
    """Scorecard of holding the last value through outages: grid, outages, errors, exact percentiles."""
    return _held(spark, sf_dir).groupBy("trip").agg(
        F.count("*").alias("n"), r(F.percentile("error_pct", 0.5)).alias("median_pct"), r(F.avg("error_pct")).alias("mean_pct"), r(F.percentile("error_pct", 0.9)).alias("p90_pct"),
        r(F.avg((F.col("error_pct") < 10).cast("double"))).alias("pass_rate"), r(F.sum("distance_m"), 4).alias("distance_m"),
    )


@query("""WITH x AS (SELECT l_quantity AS a, l_quantity * 0.97 + l_discount * 20 - l_tax * 3 AS p, l_linenumber % 2 = 0 AS ref FROM lineitem)
SELECT count(*) AS n, round(avg(abs(p - a)), 6) AS mae, round(sqrt(avg((p - a) * (p - a))), 6) AS rmse, round(avg(p - a), 6) AS bias,
round(avg(abs(p - a)) FILTER (a >= 0 AND a < 10), 6) AS mae_0_10, round(avg(abs(p - a)) FILTER (a >= 10 AND a < 30), 6) AS mae_10_30, round(avg(abs(p - a)) FILTER (a >= 30 AND a < 60), 6) AS mae_30_60,
round(stddev_pop(p - a), 6) AS err_std, round(avg(abs(a - (SELECT avg(a) FROM x))), 6) AS mae_of_mean FROM x""")
def q28_error_metrics(spark, sf_dir):
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(q.alias("a"), (q * 0.97 + F.col("l_discount") * 20 - F.col("l_tax") * 3).alias("p"))
    m = outages.error_metrics(rows, "p", "a", [(0, 10), (10, 30), (30, 60)])
    return m.select("n", *[r(c).alias(c) for c in m.columns if c != "n"])


@query("""WITH x AS (SELECT l_quantity AS a, l_quantity * 0.97 + l_discount * 20 - l_tax * 3 AS p, l_linenumber % 2 = 0 AS ref FROM lineitem)
SELECT ref, count(*) AS n, round(avg(abs(p - a)), 6) AS mae, round(2.0 * count(*) FILTER (p < 5 AND a < 5) / (count(*) FILTER (p < 5) + count(*) FILTER (a < 5)), 6) AS stationary_f1 FROM x GROUP BY ref""")
def q28b_errors_by_reference(spark, sf_dir):
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(q.alias("a"), (q * 0.97 + F.col("l_discount") * 20 - F.col("l_tax") * 3).alias("p"), (F.col("l_linenumber") % 2 == 0).alias("ref"))
    return rows.groupBy("ref").agg(F.count("*").alias("n"), r(F.avg(F.abs(F.col("p") - F.col("a")))).alias("mae"), r(outages.f1(F.col("p") < 5, F.col("a") < 5)).alias("stationary_f1"))


@query(f"""WITH {EV}, m AS (SELECT CASE k % 3 WHEN 0 THEN 'GNSS_AIDED' WHEN 1 THEN 'DEAD_RECKONING' ELSE 'REACQUISITION' END AS mode, sqrt(pow(k % 5, 2) + pow(k % 4, 2)) AS err FROM ev)
SELECT mode, count(*) AS n, round(count(*) / (SELECT count(*) FROM m), 6) AS share, round(median(err), 6) AS err_median FROM m GROUP BY mode""")
def q29_mode_histogram(spark, sf_dir):
    es = _estimates(events(spark, sf_dir))
    medians = es.groupBy("mode").agg(r(F.percentile(F.hypot(F.col("est_e") - F.col("e"), F.col("est_n") - F.col("n")), 0.5)).alias("err_median"))
    return outages.mode_shares(es).join(medians, "mode").select("mode", "n", r("share").alias("share"), "err_median")


class RuleDraws:
    """A fixed rule in place of random draws, so that SQL can draw the same."""

    def left(self, group, level, node, replicates, draws, n_left, n):
        return (draws * n_left + (replicates * 37 + level * 11 + node * 5) % n) // n

    def picks(self, group, bucket, replicate, slot, n):
        x = replicate * 7919 + slot * 104729 + replicate * slot
        return x - x // n * n  # numpy divides by one number much faster than it takes a remainder


_BUCKET = 256


def _bootstrap_sql(columns: str = "scenario") -> str:
    """CTEs and query of the robustness record over ``ru(scenario, outage, seed, drift)`` with the draws of :class:`RuleDraws`."""
    return f"""dc AS (SELECT DISTINCT scenario, outage FROM ru),
sz AS (SELECT scenario, count(*) AS n_outages, greatest(0, CAST(ceil(log2(count(*) / {_BUCKET}.0)) AS INTEGER)) AS levels FROM dc GROUP BY scenario),
bk AS (SELECT scenario, outage, levels, outage % (1 << levels) AS bucket FROM dc JOIN sz USING (scenario)),
cl AS (SELECT *, row_number() OVER (PARTITION BY scenario, bucket ORDER BY outage) - 1 AS number FROM bk),
nd AS (SELECT scenario, level, bucket >> level AS node, count(*) AS n FROM (SELECT *, unnest(range(0, levels + 1)) AS level FROM bk) GROUP BY ALL),
tr AS (
  SELECT scenario, replicate, CAST(levels AS BIGINT) AS level, CAST(0 AS BIGINT) AS node, n_outages AS m FROM sz, range(0, 2000) y(replicate)
  UNION ALL
  SELECT t.scenario, t.replicate, t.level - 1, c.node, CASE WHEN c.node % 2 = 0 THEN g ELSE t.m - g END FROM (
    SELECT tr.*, (tr.m * coalesce(l.n, 0) + (tr.replicate * 37 + tr.level * 11 + tr.node * 5) % p.n) // p.n AS g
    FROM tr JOIN nd p ON p.scenario = tr.scenario AND p.level = tr.level AND p.node = tr.node LEFT JOIN nd l ON l.scenario = tr.scenario AND l.level = tr.level - 1 AND l.node = 2 * tr.node WHERE tr.level > 0) t
  JOIN nd c ON c.scenario = t.scenario AND c.level = t.level - 1 AND c.node >> 1 = t.node),
dr AS (SELECT scenario, replicate, bucket, (replicate * 7919 + slot * 104729 + replicate * slot) % n AS number FROM (
  SELECT tr.scenario, tr.replicate, tr.node AS bucket, nd.n, unnest(range(0, tr.m)) AS slot FROM tr JOIN nd ON nd.scenario = tr.scenario AND nd.level = 0 AND nd.node = tr.node WHERE tr.level = 0)),
rp AS (SELECT dr.scenario, replicate, quantile_cont(drift, 0.5) AS m, avg(CASE WHEN drift < 10 THEN 1.0 ELSE 0.0 END) AS p FROM dr JOIN cl USING (scenario, bucket, number) JOIN ru USING (scenario, outage) GROUP BY dr.scenario, replicate),
ci AS (SELECT scenario, {', '.join(f'quantile_cont({c}, {q}) AS {name}_{end}' for c, name in (('m', 'median'), ('p', 'pass_rate')) for q, end in ((0.025, 'low'), (0.975, 'high')))} FROM rp GROUP BY scenario),
po AS (SELECT scenario, count(*) AS n_observations, count(DISTINCT seed) AS seeds, quantile_cont(drift, 0.5) AS median, avg(CASE WHEN drift < 10 THEN 1.0 ELSE 0.0 END) AS pass_rate, quantile_cont(drift, 0.9) AS p90 FROM ru GROUP BY scenario)
SELECT {columns}, n_observations, seeds, n_outages, {', '.join(f'round({c}, 6) AS {c}' for c in ('median', 'pass_rate', 'p90', 'median_low', 'median_high', 'pass_rate_low', 'pass_rate_high'))} FROM po JOIN sz USING (scenario) JOIN ci USING (scenario)"""


@query(f"""WITH RECURSIVE {HOLD}, ru AS (SELECT trip % 3 AS scenario, trip * 100000 + start AS outage, seed, error_pct * (1 + seed / 8.0) AS drift FROM hs, range(0, 3) x(seed) WHERE (start + seed) % 5 <> 0),
{_bootstrap_sql()}""")
def q30_bootstrap_ci(spark, sf_dir):
    """The robustness record: outages under three seeds, of which some runs lack some, 2,000 replicates."""
    runs = _held(spark, sf_dir).select((F.col("trip") % 3).alias("scenario"), (F.col("trip") * 100000 + F.col("start")).alias("outage"), "start", "error_pct", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seed"))
    runs = runs.where((F.col("start") + F.col("seed")) % 5 != 0).withColumn("drift", F.col("error_pct") * (1 + F.col("seed") / 8))
    runs = tables.shared_table(spark, runs, "runs")
    out = outages.robustness(runs, ["scenario"], "outage", "seed", "drift", 2000, RuleDraws(), spread=lambda c: c, bucket=_BUCKET)
    tables.drop_table(runs)
    return out.select(*[F.col(c) if c in ("scenario", "n_observations", "seeds", "n_outages") else r(c).alias(c) for c in out.columns])


def _lattice(spark, sf_dir) -> DataFrame:
    """Ten streets east and fifteen streets north, 100 m apart, one for each nation."""
    way, j = F.col("n_nationkey").cast("long"), F.col("position")
    v = table(spark, sf_dir, "nation").select("*", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("position")).withColumn("position", j.cast("long"))
    flat = way < 10
    v = v.select(way.alias("way"), "position", F.when(flat, j * 100.0).otherwise((way - 10) * 100.0).alias("x"), F.when(flat, way * 100.0).otherwise(j * 100.0).alias("y"), F.col("n_name").alias("name"))
    tag = F.when(F.col("way") % 5 == 0, "yes").when(F.col("way") % 5 == 1, "-1").when(F.col("way") % 5 == 2, "no")
    v = v.withColumn("oneway", roads.oneway_direction(tag, F.when(F.col("way") % 7 == 3, "motorway").otherwise("residential"), F.lit(None).cast("string")))
    s = roads.vertex_segments(v, "way", "position", "x", "y", roads.snapped_node(F.col("x"), F.col("y")), ["oneway"])
    return s.withColumn("seg", F.col("way") * 100 + F.col("part"))


LATTICE = """vx AS (SELECT CAST(n_nationkey AS BIGINT) AS way, p AS part, CASE WHEN n_nationkey < 10 THEN p * 100.0 ELSE (n_nationkey - 10) * 100.0 END::DOUBLE AS x, CASE WHEN n_nationkey < 10 THEN n_nationkey * 100.0 ELSE p * 100.0 END::DOUBLE AS y
  FROM nation, range(0, 11) a(p)),
sg AS (SELECT * FROM (SELECT way, part, way * 100 + part AS seg, x AS e1, y AS n1, lead(x) OVER w AS e2, lead(y) OVER w AS n2,
  CASE WHEN way % 5 = 0 THEN 1 WHEN way % 5 = 1 THEN -1 WHEN way % 5 = 2 THEN 0 WHEN way % 7 = 3 THEN 1 ELSE 0 END AS oneway FROM vx WINDOW w AS (PARTITION BY way ORDER BY part)) WHERE e2 IS NOT NULL),
lt AS (SELECT *, CAST(e1 * 2 AS BIGINT) || ':' || CAST(n1 * 2 AS BIGINT) AS node1, CAST(e2 * 2 AS BIGINT) || ':' || CAST(n2 * 2 AS BIGINT) AS node2, sqrt((e2-e1)*(e2-e1)+(n2-n1)*(n2-n1)) AS length, atan2(n2-n1, e2-e1) AS psi FROM sg)"""


@query(f"WITH {LATTICE} SELECT way, part, oneway, node1, node2, round(length, 6) AS length, round(psi, 6) AS psi FROM lt")
def q31_road_graph(spark, sf_dir):
    return _lattice(spark, sf_dir).select("way", "part", "oneway", "node1", "node2", r("length").alias("length"), r("psi").alias("psi"))


def _points(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key, (key * 37 % 1000 + key % 10 / 16).alias("e"), (key * 53 % 1000 + key % 7 / 16).alias("n"), (key % 63 / 10 - 3.1).alias("psi_v"), (key % 5).cast("double").alias("speed")
    )


POINTS = "pt AS (SELECT c_custkey, c_custkey * 37 % 1000 + c_custkey % 10 / 16.0::DOUBLE AS e, c_custkey * 53 % 1000 + c_custkey % 7 / 16.0::DOUBLE AS n, c_custkey % 63 / 10.0::DOUBLE - 3.1::DOUBLE AS psi_v, CAST(c_custkey % 5 AS DOUBLE) AS speed FROM customer)"
NEAR = f"""{LATTICE}, {POINTS}, pj AS (SELECT pt.*, lt.seg, lt.psi, lt.oneway, least(greatest(((e-e1)*(e2-e1)+(n-n1)*(n2-n1))/greatest((e2-e1)*(e2-e1)+(n2-n1)*(n2-n1), 1e-9), 0), 1) AS f, e1, n1, e2, n2 FROM pt, lt),
pf AS (SELECT *, e1 + f*(e2-e1) AS foot_e, n1 + f*(n2-n1) AS foot_n, sqrt(pow(e-(e1+f*(e2-e1)), 2)+pow(n-(n1+f*(n2-n1)), 2)) AS d FROM pj),
nr AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(d, 6), seg) AS rank FROM pf WHERE d <= 60)"""


def _near(spark, sf_dir) -> DataFrame:
    s = _lattice(spark, sf_dir).select("seg", "e1", "n1", "e2", "n2", "psi", "oneway")
    pairs = roads.nearby(_points(spark, sf_dir).withColumn("c_custkey", F.col("c_custkey")), s, "c_custkey", "seg", 60.0)
    return roads.nearest(pairs.withColumn("distance", F.round("distance", 6)), "c_custkey", "seg", 12)


@query(f"WITH {NEAR} SELECT c_custkey, seg, round(f, 6) AS fraction, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM nr WHERE rank <= 12")
def q32_nearby_segments(spark, sf_dir):
    return _near(spark, sf_dir).select("c_custkey", "seg", r("fraction").alias("fraction"), "distance", "rank")


@query(f"""WITH RECURSIVE {LATTICE}, ed AS (SELECT node1 AS a, node2 AS b, length FROM lt UNION ALL SELECT node2, node1, length FROM lt),
st AS (SELECT s_suppkey AS source, CAST(s_suppkey % 10 * 200 AS BIGINT) || ':' || CAST(s_suppkey % 7 * 200 AS BIGINT) AS node, s_suppkey % 4 * 10.0::DOUBLE AS d FROM supplier),
wk AS (SELECT source, node, d FROM st UNION SELECT wk.source, ed.b, wk.d + ed.length FROM wk JOIN ed ON ed.a = wk.node WHERE wk.d + ed.length <= 350)
SELECT source, node, round(min(d), 6) AS distance FROM wk GROUP BY ALL""")
def q33_bounded_shortest_path(spark, sf_dir):
    s, key = _lattice(spark, sf_dir), F.col("s_suppkey")
    node = F.concat_ws(":", (key % 10 * 200).cast("long"), (key % 7 * 200).cast("long"))
    starts = table(spark, sf_dir, "supplier").select(key.alias("source"), node.alias("node"), (key % 4 * 10.0).alias("distance"))
    found = roads.bounded_distances(starts, s.select(F.col("node1").alias("a"), F.col("node2").alias("b"), "length"), 350.0)
    return found.select("source", "node", r("distance").alias("distance"))


@query(_SQL["q33_bounded_shortest_path"])
def q53_bounded_shortest_path_all(spark, sf_dir):
    """As q33, which once started from some suppliers only."""
    return q33_bounded_shortest_path(spark, sf_dir)


@query(f"""WITH {NEAR}, hd AS (SELECT *, CASE WHEN oneway = 1 THEN psi WHEN oneway = -1 THEN {wrap('psi + pi()')} WHEN abs({wrap('psi_v - psi')}) <= abs({wrap(f"psi_v - {wrap('psi + pi()')}")}) THEN psi ELSE {wrap('psi + pi()')} END AS rp FROM nr WHERE rank <= 12),
sc AS (SELECT *, -0.5 * pow(round(d, 6) / 20.0, 2) - CASE WHEN speed > 2 THEN 0.5 * pow(abs({wrap('psi_v - rp')}) / radians(25.0), 2) ELSE 0 END AS score FROM hd),
po AS (SELECT *, exp(score - max(score) OVER w) AS x FROM sc WINDOW w AS (PARTITION BY c_custkey)),
pr AS (SELECT *, x / sum(x) OVER (PARTITION BY c_custkey) AS posterior FROM po)
SELECT c_custkey, seg, round(posterior, 6) AS posterior FROM pr""")
def q34_hmm_posterior(spark, sf_dir):
    pairs = _near(spark, sf_dir).withColumnsRenamed({"psi": "road", "psi_v": "psi"})
    out = roads.posterior(roads.emission_scores(pairs, F.lit(20.0)), "c_custkey", "seg")
    return out.select("c_custkey", "seg", r("posterior").alias("posterior"))


def _street_map() -> list[dict]:
    """The lattice as the bounded map of one area, for kernels."""
    out = []
    for way in range(25):
        for p in range(10):
            ends = [(q * 100.0, way * 100.0) if way < 10 else ((way - 10) * 100.0, q * 100.0) for q in (p, p + 1)]
            (e1, n1), (e2, n2) = ends
            out.append({"e1": e1, "n1": n1, "e2": e2, "n2": n2, "node1": ends[0], "node2": ends[1], "length": 100.0, "psi": math.atan2(n2 - n1, e2 - e1), "oneway": 0})
    return out


@query(f"""WITH RECURSIVE {EV}, {LATTICE}, mp AS (SELECT trip, i, i * 120.0 % 840 + 3.7 AS e, trip % 9 * 100.0 + k % 9 - 4 AS n FROM ev), {kernel_sql.street_matching('mp', 120.0)},
pq AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY trip, i) AS mass, first(fe) OVER w AS be, first(fn) OVER w AS bn, first(road) OVER w AS br, first(seg) OVER w AS bs FROM hm
  WINDOW w AS (PARTITION BY trip, i ORDER BY score DESC, d, seg ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT trip, CAST(i AS DOUBLE) AS t, CAST(first(bs) AS BIGINT) AS segment, round(first(be), 6) AS foot_e, round(first(bn), 6) AS foot_n,
  round(sum(CASE WHEN sqrt(pow(fe - be, 2) + pow(fn - bn, 2)) < 3 AND abs({wrap('road - br')}) < radians(20.0) THEN mass ELSE 0 END), 6) AS confidence FROM pq GROUP BY trip, i""")
def q35_hmm_match(spark, sf_dir):
    """Streets with one-way rules, 120 m from one point to the next, so that routes lead over several nodes."""
    i = F.col("i")
    p = events(spark, sf_dir).select("trip", i.cast("double").alias("t"), (i * 120.0 % 840 + 3.7).alias("e"), (F.col("trip") % 9 * 100.0 + F.col("k") % 9 - 4).alias("n"), F.lit(0.0).alias("psi"), F.lit(12.0).alias("speed"), F.lit(120.0).alias("travelled"), F.lit(5.0).alias("std"))
    out = matching.match(p, _lattice(spark, sf_dir).withColumnRenamed("seg", "segment"), "trip", "t")
    return out.select("trip", "t", "segment", *[r(c).alias(c) for c in ("foot_e", "foot_n", "confidence")])


@query(f"""WITH RECURSIVE {EV}, fx AS (SELECT trip, i, sum(CASE WHEN k % 13 = 0 THEN 40.0 WHEN k % 5 = 0 THEN 9.0 ELSE 1.0 END) OVER (PARTITION BY trip ORDER BY i)::DOUBLE AS t, i * 10.0 + CASE WHEN k % 10 = 7 THEN 300.0 ELSE 0.0 END AS e,
  CASE WHEN k % 17 <> 0 THEN 3.0 + k % 25 END AS accuracy, CASE WHEN k % 10 = 7 THEN 500.0 ELSE k % 15 * 1.0 END::DOUBLE AS surprise FROM ev),
fs AS (SELECT trip, i, t, surprise, 10.0::DOUBLE AS own, {{'t': t, 'e': e::DOUBLE, 'n': 0.0::DOUBLE, 'speed': 10.0::DOUBLE, 'accuracy': accuracy::DOUBLE}} AS fix FROM fx),
mo AS (SELECT trip, -1 AS i, 0.0::DOUBLE AS t, {kernel_sql.MONITOR_START} FROM (SELECT DISTINCT trip FROM ev) UNION ALL {kernel_sql.tick(kernel_sql.on_fix(kernel_sql.tick("SELECT f.trip, f.i, f.t, f.surprise, f.own, f.fix, " + ", ".join(f"s.{c}" for c in kernel_sql.MONITOR) + " FROM mo s JOIN fs f ON f.trip = s.trip AND f.i = s.i + 1", "trip, i, t, surprise, own, fix"), "trip, i, t"), "trip, i, t")})
SELECT trip, t, decision, mode, round(quality, 6) AS quality FROM mo WHERE i >= 0""")
def q36_gnss_monitor(spark, sf_dir):
    i, k = F.col("i"), F.col("k")
    t = F.sum(F.when(k % 13 == 0, 40.0).when(k % 5 == 0, 9.0).otherwise(1.0)).over(Window.partitionBy("trip").orderBy("i"))
    fixes = events(spark, sf_dir).select(
        "trip", t.alias("t"), (i * 10.0 + F.when(k % 10 == 7, 300.0).otherwise(0.0)).alias("e"), F.lit(0.0).alias("n"), F.lit(10.0).alias("speed"),
        F.when(k % 17 != 0, 3.0 + k % 25).alias("accuracy"), F.when(k % 10 == 7, 500.0).otherwise(F.col("k") % 15 * 1.0).alias("surprise"), F.lit(10.0).alias("own_speed"),
    )
    return keyed.monitor_fixes(fixes, "trip").withColumn("quality", r("quality"))


def _frames(ev: DataFrame, *keep: str) -> DataFrame:
    """Drives east at ten frames a second, a fix every tenth frame but for an outage, true speed at hand."""
    ev = ev.select("trip", "i", "k", *keep, F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j"))
    i = F.col("i") * 10 + F.col("j")
    fix = F.struct((i * 1.2).alias("e"), (F.col("k") % 5 - 2.0).alias("n"), F.lit(12.0).alias("speed"), F.lit(90.0).alias("heading"), F.lit(5.0).alias("accuracy"))
    return ev.select(
        "trip", *keep, (i * 0.1).alias("t"), ((F.col("k") % 3 - 1) * 0.1).alias("ax"), F.lit(0.0).alias("ay"), F.lit(9.8).alias("az"), F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"), ((F.col("k") % 7 - 3) * 0.001).alias("gz"),
        F.when((F.col("j") == 0) & ~F.col("i").between(20, 30), fix).alias("fix"), F.lit(12.0).alias("true_speed"),
    )


FRAMES = f"""{EV}, fm AS (SELECT trip, i * 10 + j AS f, (i * 10 + j) * 0.1::DOUBLE AS t, (k % 3 - 1) * 0.1::DOUBLE AS ax, 0.0::DOUBLE AS ay, 9.8::DOUBLE AS az, 0.0::DOUBLE AS gx, 0.0::DOUBLE AS gy, (k % 7 - 3) * 0.001::DOUBLE AS gz,
  CASE WHEN j = 0 AND i NOT BETWEEN 20 AND 30 THEN {{'t': (i * 10 + j) * 0.1::DOUBLE, 'e': (i * 10 + j) * 1.2::DOUBLE, 'n': (k % 5 - 2)::DOUBLE, 'speed': 12.0::DOUBLE, 'accuracy': 5.0::DOUBLE}} END AS fix FROM ev, range(0, 10) x(j))"""


@query(f"""WITH RECURSIVE {FRAMES}, {kernel_sql.navigation('fm')}
SELECT trip, t, round(x0, 4) AS east, round(x1, 4) AS north, round(x3, 5) AS speed, round(x2, 5) AS psi, mode, round(quality, 6) AS quality, round(sqrt(greatest(p00 + p11, 0)), 5) AS position_std FROM nv""")
def q37_filter_run(spark, sf_dir):
    out = keyed.navigate(_frames(events(spark, sf_dir)), "trip", use_model=False)
    return out.select("trip", "t", r("east", 4).alias("east"), r("north", 4).alias("north"), r("speed", 5).alias("speed"), r("psi", 5).alias("psi"), "mode", r("quality").alias("quality"), r("position_std", 5).alias("position_std"))


@query()
def q38_navigation(spark, sf_dir):
    return keyed.navigate(_frames(events(spark, sf_dir)), "trip", segments=_street_map())


@query(f"""WITH {EV}, s AS (SELECT trip, value, abs(value - lag(value) OVER (PARTITION BY trip ORDER BY i)) AS d FROM ev),
fn AS (SELECT trip, i, value - avg(value) OVER (PARTITION BY trip) AS x, count(*) OVER (PARTITION BY trip) AS n FROM ev),
fk AS (SELECT trip, n // 2 AS h, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * sin(2 * pi() * k * i / n)), 2)) AS size FROM (SELECT *, unnest(range(1, n // 2 + 1)) AS k FROM fn) GROUP BY trip, n, k),
fb AS (SELECT trip, size, CASE WHEN k - 1 < h % 4 * (h // 4 + 1) THEN (k - 1) // (h // 4 + 1) ELSE h % 4 + (k - 1 - h % 4 * (h // 4 + 1)) // (h // 4) END AS band FROM fk),
fa AS (SELECT trip, {', '.join(f'round(avg(size) FILTER (band = {j}), 6) AS band{j + 1}' for j in range(4))} FROM fb GROUP BY trip)
SELECT a.*, band1, band2, band3, band4 FROM (SELECT trip, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(avg(d), 6) AS mean_abs_diff, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95 FROM s GROUP BY trip) a LEFT JOIN fa USING (trip)""")
def q39_window_stats(spark, sf_dir):
    lists = events(spark, sf_dir).groupBy("trip").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("v"))
    s = learning.window_statistics(lists, {"v": "s"})
    names = [*[f"band{j}" for j in range(1, 5)], "mean", "std", "mean_abs_diff", "p05", "p95"]
    return s.select("trip", *[r(f"s.{c}").alias(c) for c in names])


@query(f"""WITH {EV}, c AS (SELECT event_id, (k % 12) * 0.06 AS b, CASE WHEN k % 9 = 0 THEN NULL ELSE (k % 20) * 1.0 END AS g FROM ev)
SELECT event_id, CASE WHEN g IS NULL THEN 'gravity is not finite' WHEN g NOT BETWEEN 5 AND 15 THEN 'gravity is out of range' WHEN NOT b < 0.5 THEN 'gyro bias is out of range' END AS problem FROM c""")
def q40_calibration_validate(spark, sf_dir):
    k = F.col("k")
    g = F.when(k % 9 != 0, k % 20 * 1.0)
    text = F.to_json(F.struct(
        F.struct(*[(k % 12 * 0.06 if n == "gx" else F.lit(0.0)).alias(n) for n in ("gx", "gy", "gz")]).alias("gyro_bias_rad_s"),
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), g.alias("z")).alias("resting_gravity_vector"),
    ))
    # a column of its own, so that a text is parsed once and not for each of the conditions
    parsed = events(spark, sf_dir).select("event_id", F.from_json(text, tables.CALIBRATION).alias("c"))
    return parsed.select("event_id", tables.calibration_problem(F.col("c")).alias("problem"))


@query(f"WITH {LATTICE} SELECT DISTINCT way FROM vx WHERE x BETWEEN 150 AND 350 AND y BETWEEN 450 AND 720")
def q41_bbox_clip(spark, sf_dir):
    s = _lattice(spark, sf_dir)
    ends = F.struct(F.col("e1").alias("e"), F.col("n1").alias("n")), F.struct(F.col("e2").alias("e"), F.col("n2").alias("n"))
    lines = s.groupBy("way").agg(F.flatten(F.collect_list(F.array(*ends))).alias("coords"))
    return roads.clip_lines(lines, "coords", 150.0, 350.0, 450.0, 720.0).select("way")


@query(f"""WITH {SCORES} SELECT trip, start, round(distance_m, 4) AS distance_m FROM sc WHERE valid ORDER BY sc.distance_m DESC, trip, start LIMIT 6""")
def q42_longest_outages(spark, sf_dir):
    return outages.longest(_scores(events(spark, sf_dir)), "trip").select("trip", "start", r("distance_m", 4).alias("distance_m"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate FROM orders), n AS (SELECT * FROM o WHERE o_orderkey % 3 = 0)
SELECT o_orderkey, o_totalprice AS price FROM o WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, -o_totalprice FROM n""")
def q42b_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return outages.upsert(o, o.where("o_orderkey % 3 = 0").withColumn("price", -F.col("price")), ["o_orderkey"])


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders) WHERE nth = 1""")
def q43_latest_by_key(spark, sf_dir):
    return outages.latest_by(table(spark, sf_dir, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey")


@query(f"""WITH {EV} SELECT trip, i, coalesce(last_value(CASE WHEN k % 4 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY trip ORDER BY i), 0.0) AS filled,
coalesce(lag(value, 3) OVER (PARTITION BY trip ORDER BY i), first_value(value) OVER (PARTITION BY trip ORDER BY i)) AS shifted FROM ev""")
def q44_fill_and_shift(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("course", F.when(F.col("k") % 4 == 0, F.col("value")))
    ev = alignment.forward_fill(ev, "trip", "i", "course", 0.0, "filled")
    return alignment.clamped_shift(ev, "trip", "i", "value", 3, "shifted").select("trip", "i", "filled", "shifted")


@query(f"""WITH {ISLANDS} SELECT a.trip, a.i, b.value AS reference FROM isl a JOIN isl b ON a.trip = b.trip AND b.i = greatest(a.i - 4, a.run_start) WHERE a.run_start >= 0""")
def q45_reference_lookback(spark, sf_dir):
    return validity.reference_lookback(_islands(events(spark, sf_dir)).where("run_start >= 0"), "trip", "i", "value", 4).select("trip", "i", "reference")


@query(f"""WITH {EV} SELECT trip, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM ev WHERE i < 18 GROUP BY trip""")
def q46_stationary_calibration(spark, sf_dir):
    return events(spark, sf_dir).where("i < 18").groupBy("trip").agg(r(F.avg("value")).alias("mean"), r(F.stddev_pop("value")).alias("std"), F.count("*").alias("n"))


@query("""SELECT round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, round(1000 / avg(value), 6) AS frames_per_s, round(1000 / 10.0 / avg(value), 6) AS realtime_factor FROM events""")
def q47_latency_statistics(spark, sf_dir):
    s = outages.latency_statistics(table(spark, sf_dir, "events"), "value", 10.0)
    return s.select(*[r(c).alias(c) for c in s.columns])


@query(f"""WITH {EV}, s AS (SELECT trip, avg(value) + 5 * avg(k) AS score, count(*) AS n FROM ev GROUP BY trip) SELECT trip AS best, round(score, 6) AS score, (SELECT max(abs(value - k)) FROM ev) AS max_abs_diff FROM s ORDER BY s.score, trip LIMIT 1""")
def q48_model_selection(spark, sf_dir):
    ev = events(spark, sf_dir)
    s = ev.groupBy("trip").agg((F.avg("value") + 5 * F.avg("k")).alias("score"))
    best = s.agg(F.min(F.struct("score", "trip")).alias("x")).select(F.col("x.trip").alias("best"), r("x.score").alias("score"))
    return best.crossJoin(ev.agg(F.max(F.abs(F.col("value") - F.col("k"))).alias("max_abs_diff")))  # one row each


@query(f"""WITH {EV}, lg AS (SELECT trip, min(t) AS lo, max(t) AS hi FROM ev WHERE kind = 'view' GROUP BY trip), rg AS (SELECT trip, min(t) AS lo, max(t) AS hi FROM ev WHERE kind = 'click' GROUP BY trip)
SELECT trip, count(*) AS n FROM (SELECT trip, unnest(range(CAST(ceil(greatest(lg.lo, rg.lo) / 21600.0) AS BIGINT), CAST(ceil(least(lg.hi, rg.hi) / 21600.0) AS BIGINT))) FROM lg JOIN rg USING (trip)) GROUP BY trip""")
def q49_series_overlap(spark, sf_dir):
    ev = events(spark, sf_dir)
    both = alignment.series_overlap(ev.where("kind = 'view'"), ev.where("kind = 'click'"), "trip", "t")
    return alignment.common_grid(both, "trip", "low", "high", SIX_HOURS).groupBy("trip").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {EV}, rt AS (SELECT trip, i, i * 10.0::DOUBLE AS e, k * 1.0::DOUBLE AS n FROM ev WHERE i % 2 = 0),
kp AS (SELECT trip, i, true AS kept, e, n FROM rt WHERE i = 0 UNION ALL
  SELECT rt.trip, rt.i, far, CASE WHEN far THEN rt.e ELSE ke END, CASE WHEN far THEN rt.n ELSE kn END FROM (SELECT rt.*, kp.e AS ke, kp.n AS kn, sqrt(pow(rt.e - kp.e, 2) + pow(rt.n - kp.n, 2)) >= 75 AS far FROM kp JOIN rt ON rt.trip = kp.trip AND rt.i = kp.i + 2) rt)
SELECT trip, i AS idx, e, n FROM kp WHERE kept""")
def q50_route_points(spark, sf_dir):
    ev = events(spark, sf_dir).select("trip", F.col("i").alias("idx"), (F.col("i") * 10.0).alias("e"), (F.col("k") * 1.0).alias("n"))
    return keyed.route_points(ev, "trip", 75.0, 2)


_PHI, _GROW = f"{math.exp(-1 / 30)!r}::DOUBLE", f"{2 * math.sqrt(1 - math.exp(-1 / 30) ** 2)!r}::DOUBLE"


def _normal(j: int) -> str:
    return f"((k * 7 + i * 3 + {5 * j}) % 11 - 5) / 4.0"


@query(f"""WITH RECURSIVE {EV}, nz AS (SELECT trip, i, {', '.join(f'({_normal(j)})::DOUBLE AS z{j}' for j in range(6))}, CASE WHEN k % 4 = 0 THEN 1.0 ELSE 12.0 END::DOUBLE AS v FROM ev),
ar AS (SELECT nz.*, {_GROW} * z0 AS ge, {_GROW} * z2 AS gn FROM nz WHERE i = 0
  UNION ALL SELECT nz.*, {_PHI} * ge + {_GROW} * nz.z0, {_PHI} * gn + {_GROW} * nz.z2 FROM ar JOIN nz ON nz.trip = ar.trip AND nz.i = ar.i + 1)
SELECT trip, CAST(i AS DOUBLE) AS t, round(i * 12.0 + ge + z1, 6) AS e, round(gn + z3, 6) AS n, round(greatest(v + 0.1::DOUBLE * z4, 0), 6) AS speed,
  round(CASE WHEN greatest(v + 0.1::DOUBLE * z4, 0) > 1 THEN {pmod('90 + z5', '360.0')} END, 6) AS heading, 3.0::DOUBLE AS accuracy FROM ar""")
def q51_synthetic_fixes(spark, sf_dir):
    """Numbers by a rule stand for the random ones, so that SQL can have the same; the noise is of first order in time."""
    normals = F.array(*[F.expr(_normal(j)).cast("double") for j in range(6)])
    speed = F.when(F.col("k") % 4 == 0, 1.0).otherwise(12.0)
    ev = events(spark, sf_dir).select("trip", F.col("i").alias("idx"), F.col("i").cast("double").alias("t"), (F.col("i") * 12.0).alias("e"), F.lit(0.0).alias("n"), speed.alias("speed"), F.lit(90.0).alias("heading"), normals.alias("normals"))
    out = keyed.synthetic_fixes(ev, "trip", seed=3)
    return out.select("trip", "t", *[r(c).alias(c) for c in ("e", "n", "speed", "heading")], "accuracy")


@query(f"""WITH {SCORES} SELECT trip, count(*) AS n_observations, count(DISTINCT start) AS n_outages, list(start ORDER BY start) AS starts FROM sc GROUP BY trip""")
def q52_distinct_clusters(spark, sf_dir):
    s = _scores(events(spark, sf_dir))
    return s.groupBy("trip").agg(F.count("*").alias("n_observations"), F.countDistinct("start").alias("n_outages"), F.array_sort(F.collect_list("start")).alias("starts"))


_PHONE = {
    "t": "7200 + i * 0.12D + (k % 5) * 0.01D - CASE WHEN k % 11 = 0 THEN 0.2D ELSE 0D END", "ax": "(k % 5 - 2) * 0.4D", "ay": "(i % 5 - 2) * 0.3D", "az": "9.8D",
    "g_yaw": "(k % 3) * 0.01D", "g_roll": "(i % 4) * 0.02D", "g_pitch": "(i % 7 - 3) * 0.1D + (k % 3) * 0.02D",
    "lat": "52.4D + (i div 9) * 0.0001D", "lon": "-1.5D + (i div 18) * 0.0002D", "kmh": "20D + i div 9", "accuracy": "3D + k % 9", "bearing": "(k * 7 % 360) * 1D",
}
_VEHICLE = {
    "t": "i * 0.11D + (k % 3) * 0.02D + CASE WHEN i > 40 THEN 0.7D ELSE 0D END", "yaw_deg": "(i % 7 - 3) * 6D + (k % 2) * 0.5D", "kmh": "5D + k % 60", "lat": "52.4D + i * 0.00001D", "lon": "-1.5D + i * 0.00002D", "heading": "(i * 17 % 360) * 1D",
}
_HOW = trips.Preparation(axis_least=10, lag_least=20, max_lag=5, block=20, block_least=6, block_r=0.2)


def _logs_sql(columns: dict[str, str]) -> str:
    double = {c: re.sub("([0-9.]+)D", lambda m: m[1] + "::DOUBLE", e.replace("div", "//")) for c, e in columns.items()}
    return ", ".join(f"({e})::DOUBLE AS {c}" for c, e in double.items())


def _on_grid(name: str, source: str, values: list[str], probes: str, keep: str) -> str:
    """A CTE of probes with values of a log interpolated; outside the log the nearest ones."""
    part = "CASE WHEN b.t > a.t THEN (p.t - a.t) / (b.t - a.t) ELSE 0 END"
    each = ", ".join(f"CASE WHEN a.t IS NULL THEN b.{v} WHEN b.t IS NULL THEN a.{v} ELSE a.{v} + (b.{v} - a.{v}) * {part} END AS {v}" for v in values)
    return f"{name} AS (SELECT {keep}, {each} FROM {probes} p ASOF LEFT JOIN {source} a ON p.trip = a.trip AND p.t >= a.t ASOF LEFT JOIN {source} b ON p.trip = b.trip AND p.t <= b.t)"


def _corr_of(a: str) -> str:
    return f"CASE WHEN count(*) FILTER (speed > 2) > {_HOW.axis_least} THEN coalesce((avg({a} * can_yaw) FILTER (speed > 2) - avg({a}) FILTER (speed > 2) * avg(can_yaw) FILTER (speed > 2)) / nullif(stddev_pop({a}) FILTER (speed > 2) * stddev_pop(can_yaw) FILTER (speed > 2), 0), 0) ELSE 0 END"


_G3 = list(trips.GYRO)
_STEPS = "CASE WHEN coalesce(s.step, f.step) <= 0.5 THEN true ELSE false END"
PREPARED = f"""{EV}, ph0 AS (SELECT trip, i AS row, {_logs_sql(_PHONE)} FROM ev), ve0 AS (SELECT trip, i AS row, {_logs_sql(_VEHICLE)} FROM ev),
of AS (SELECT trip, round_even((a.t - b.t) / 3600, 0) * 3600 AS hours FROM (SELECT trip, min_by(t, row) AS t FROM ph0 GROUP BY trip) a JOIN (SELECT trip, min_by(t, row) AS t FROM ve0 GROUP BY trip) b USING (trip)),
ph1 AS (SELECT ph0.* REPLACE (t - hours AS t) FROM ph0 JOIN of USING (trip)),
ph AS (SELECT * FROM ph1 QUALIFY coalesce(t > lag(t) OVER (PARTITION BY trip ORDER BY row), true)),
ve1 AS (SELECT * FROM ve0 QUALIFY coalesce(t > lag(t) OVER (PARTITION BY trip ORDER BY row), true)),
ve2 AS (SELECT *, coalesce(-floor((heading - lag(heading) OVER (PARTITION BY trip ORDER BY row) + 180) / 360), 0) AS turn FROM ve1),
ve AS (SELECT *, heading + 360 * sum(turn) OVER (PARTITION BY trip ORDER BY row) AS course FROM ve2),
bo AS (SELECT trip, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM (SELECT trip, min(t) AS lo, max(t) AS hi FROM ph GROUP BY trip) a JOIN (SELECT trip, min(t) AS lo, max(t) AS hi FROM ve GROUP BY trip) b USING (trip)),
gr AS (SELECT trip, idx, idx * 0.1::DOUBLE AS t FROM (SELECT trip, unnest(range(CAST(ceil(lo / 0.1::DOUBLE) AS BIGINT), CAST(ceil(hi / 0.1::DOUBLE) AS BIGINT))) AS idx FROM bo)),
{_on_grid('vg', 've', ['yaw_deg', 'kmh', 'lat', 'lon', 'course'], 'gr', 'p.*')},
fr0 AS (SELECT trip, idx, t, radians(yaw_deg) AS can_yaw, kmh / 3.6::DOUBLE AS speed, lat, lon, {pmod('course', '360.0')} AS course_deg FROM vg),
{_on_grid('tu', 'ph', _G3, 'fr0', 'p.*')},
co AS (SELECT trip, count(*) FILTER (speed > 2) AS n_moving, {', '.join(f'{_corr_of(c)} AS {c}' for c in _G3)} FROM tu GROUP BY trip),
cx AS (SELECT *, CASE WHEN abs(g_yaw) >= abs(g_roll) AND abs(g_yaw) >= abs(g_pitch) THEN 'g_yaw' WHEN abs(g_roll) >= abs(g_pitch) THEN 'g_roll' ELSE 'g_pitch' END AS axis FROM co),
zs AS (SELECT trip, idx, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-9) AS za, (can_yaw - avg(can_yaw) OVER w) / (stddev_pop(can_yaw) OVER w + 1e-9) AS zb
  FROM (SELECT tu.*, CASE axis WHEN 'g_yaw' THEN tu.g_yaw WHEN 'g_roll' THEN tu.g_roll ELSE tu.g_pitch END AS v FROM tu JOIN cx USING (trip) WHERE n_moving > {_HOW.lag_least}) WINDOW w AS (PARTITION BY trip)),
lc AS (SELECT x.trip, y.idx - x.idx AS lag, avg(x.za * y.zb) AS r FROM zs x JOIN zs y ON x.trip = y.trip AND y.idx - x.idx BETWEEN -{_HOW.max_lag} AND {_HOW.max_lag} GROUP BY ALL),
lb AS (SELECT * FROM lc QUALIFY row_number() OVER (PARTITION BY trip ORDER BY r DESC, lag) = 1),
td AS (SELECT cx.*, coalesce(lag * 0.1::DOUBLE, 0) AS lag_s, r AS lag_corr, hours FROM cx LEFT JOIN lb USING (trip) JOIN of USING (trip)),
ps AS (SELECT ph.* REPLACE (t + lag_s AS t) FROM ph JOIN td USING (trip)),
{_on_grid('im', 'ps', ['ax', 'ay', 'az', *_G3], 'fr0', 'p.*')},
{', '.join(f"{n}s AS (SELECT trip, t, coalesce(lead(t) OVER w - t, t - lag(t) OVER w) AS step FROM {s} WINDOW w AS (PARTITION BY trip ORDER BY t)), {n}f AS (SELECT trip, min_by(step, t) AS step FROM {n}s GROUP BY trip)" for n, s in (('vs', 've'), ('us', 'ps')))},
g1 AS (SELECT im.*, {_STEPS} AS ok1 FROM im ASOF LEFT JOIN vss s ON im.trip = s.trip AND im.t >= s.t LEFT JOIN vsf f ON im.trip = f.trip),
g2 AS (SELECT g1.*, ok1 AND {_STEPS} AS valid0 FROM g1 ASOF LEFT JOIN uss s ON g1.trip = s.trip AND g1.t >= s.t LEFT JOIN usf f ON g1.trip = f.trip),
fr1 AS (SELECT * REPLACE (idx - min(idx) OVER (PARTITION BY trip) AS idx) FROM g2),
bk AS (SELECT trip, idx // {_HOW.block} AS block, CASE WHEN count(*) FILTER (u) > {_HOW.block_least} AND stddev_pop(can_yaw) FILTER (u) > 0.02 THEN
  (avg(g_pitch * can_yaw) FILTER (u) - avg(g_pitch) FILTER (u) * avg(can_yaw) FILTER (u)) / nullif(stddev_pop(g_pitch) FILTER (u) * stddev_pop(can_yaw) FILTER (u), 0) END AS r FROM (SELECT *, speed > 2 AND valid0 AS u FROM fr1) GROUP BY ALL),
fr2 AS (SELECT fr1.*, valid0 AND coalesce(r >= {_HOW.block_r}, true) AS valid FROM fr1 JOIN bk ON fr1.trip = bk.trip AND fr1.idx // {_HOW.block} = bk.block),
ch AS (SELECT *, sum(CASE WHEN nw THEN 1 ELSE 0 END) OVER (PARTITION BY trip ORDER BY row) AS cid FROM (SELECT *, row_number() OVER w = 1 OR lat IS DISTINCT FROM lag(lat) OVER w OR lon IS DISTINCT FROM lag(lon) OVER w OR kmh IS DISTINCT FROM lag(kmh) OVER w AS nw FROM ps WINDOW w AS (PARTITION BY trip ORDER BY row))),
c1 AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY trip ORDER BY t) = 1),
fr3 AS (SELECT fr2.*, {', '.join(f'CASE WHEN c.t IS NULL THEN c1.{v} ELSE c.{v} END AS fix_{v}' for v in ('lat', 'lon', 'kmh', 'accuracy', 'bearing', 'cid'))} FROM fr2 ASOF LEFT JOIN ch c ON fr2.trip = c.trip AND fr2.t >= c.t JOIN c1 ON fr2.trip = c1.trip),
fr AS (SELECT *, fix_kmh / 3.6::DOUBLE AS fix_speed, coalesce(fix_cid > lag(fix_cid) OVER (PARTITION BY trip ORDER BY idx), true) AS fix_new FROM fr3)"""


def _prepared(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    ev = events(spark, sf_dir)
    phone, vehicle = (ev.selectExpr("trip", "i AS row", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in columns.items()]) for columns in (_PHONE, _VEHICLE))
    return trips.prepare(phone, vehicle, "trip", _HOW)


_FRAME = ("t", "can_yaw", "speed", "lat", "lon", "course_deg", "ax", "ay", "az", "fix_lat", "fix_lon", "fix_speed", "fix_accuracy", "fix_bearing")


@query(f"""WITH {PREPARED} SELECT trip, idx, valid, fix_new, {', '.join(f'round({c}, 6) AS {c}' for c in _FRAME)}, {', '.join(f'round({a}, 6) AS {b}' for a, b in zip(_G3, ('gx', 'gy', 'gz')))} FROM fr""")
def q54_prepared_trips(spark, sf_dir):
    """Two raw logs of each trip to aligned frames: clocks, grid, axis, lag, gaps, agreement, fixes."""
    return _prepared(spark, sf_dir)[0].select("trip", "idx", "valid", "fix_new", *[r(c).alias(c) for c in (*_FRAME, "gx", "gy", "gz")])


@query(f"""WITH {PREPARED}, m AS (SELECT trip, count(*) AS samples, round(count(*) * 0.1 / 60, 6) AS duration_min, round(100 * avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 6) AS valid_pct, round(sum(CASE WHEN valid THEN speed ELSE 0 END) * 0.1 / 1000, 8) AS distance_km FROM fr GROUP BY trip)
SELECT m.*, hours AS hour_offset_s, round(lag_s, 6) AS lag_s, round(lag_corr, 6) AS lag_corr, axis AS vertical_gyro_column, round(g_pitch, 6) AS corr_pitch, round(md, 6) AS segment_corr_median FROM m JOIN td USING (trip) LEFT JOIN (SELECT trip, median(r) AS md FROM bk GROUP BY trip) USING (trip)""")
def q55_trip_record(spark, sf_dir):
    """The metadata of prepared trips."""
    m = _prepared(spark, sf_dir)[1]
    return m.select(
        "trip", "samples", r("duration_min").alias("duration_min"), r("valid_pct").alias("valid_pct"), r("distance_km", 8).alias("distance_km"), "hour_offset_s", r("lag_s").alias("lag_s"),
        r("lag_corr").alias("lag_corr"), "vertical_gyro_column", r(F.col("gyro_corr")["g_pitch"]).alias("corr_pitch"), r("segment_corr_median").alias("segment_corr_median"),
    )


REPLAYED = f"""{PREPARED}, tl AS (SELECT trip, s AS start, s + 15 AS "end" FROM (SELECT trip, unnest(range(10, count(*) - 15, 25)) AS s FROM fr GROUP BY trip)),
rf AS (SELECT fr.*, t - first(t) OVER (PARTITION BY fr.trip ORDER BY idx) AS since, tl.start IS NOT NULL AS in_outage, fix_new AND tl.start IS NULL AS has FROM fr LEFT JOIN tl ON fr.trip = tl.trip AND fr.idx >= tl.start AND fr.idx < tl."end")"""


def _replayed(spark, sf_dir) -> DataFrame:
    frames = _prepared(spark, sf_dir)[0]
    planned = outages.tiled_outages(frames.groupBy("trip").agg(F.count("*").alias("n")), "trip", "n", 10, 15, 10)
    return trips.replay_frames(frames.withColumn("fix", trips.phone_fixes(frames)), planned)


@query(f"""WITH {REPLAYED} SELECT trip, idx, round(since, 6) AS t, in_outage, round(g_pitch, 6) AS gz, has AS has_fix, round(CASE WHEN has THEN fix_lat END, 6) AS lat, round(CASE WHEN has THEN fix_speed END, 6) AS speed,
round(CASE WHEN has AND fix_speed > 1 THEN fix_bearing END, 6) AS heading, round(CASE WHEN has THEN fix_accuracy END, 6) AS accuracy FROM rf""")
def q56_replay_frames(spark, sf_dir):
    """Frames with the phone's own new fixes, nulled inside planned outages."""
    f = _replayed(spark, sf_dir)
    return f.select("trip", "idx", r("t").alias("t"), "in_outage", r("gz").alias("gz"), F.col("fix").isNotNull().alias("has_fix"), *[r(f"fix.{c}").alias(c) for c in ("lat", "speed", "heading", "accuracy")])


_FIX_N = "CASE WHEN i = 0 THEN 0 ELSE k % 5 - 2 END"
GEO_FRAMES = f"""{EV}, gm AS (SELECT trip, i * 10 + j AS f, (i * 10 + j) * 0.1::DOUBLE AS t, (k % 3 - 1) * 0.1::DOUBLE AS ax, 0.0::DOUBLE AS ay, 9.8::DOUBLE AS az, 0.0::DOUBLE AS gx, 0.0::DOUBLE AS gy, (k % 7 - 3) * 0.001::DOUBLE AS gz,
  j = 0 AND i NOT BETWEEN 20 AND 30 AS has, {LAT0} + ({_FIX_N}) / 111000.0::DOUBLE AS lat, {LON0} + (i * 10 + j) * 1.2::DOUBLE / 68000.0::DOUBLE AS lon FROM ev, range(0, 10) x(j)),
fm AS (SELECT * EXCLUDE (east, north), CASE WHEN has THEN {{'t': t, 'e': east, 'n': north, 'speed': 12.0::DOUBLE, 'accuracy': 5.0::DOUBLE}} END AS fix FROM (SELECT *, {_enu_sql()} FROM gm))"""


@query(f"""WITH RECURSIVE {GEO_FRAMES}, {kernel_sql.navigation('fm')}, ou AS (SELECT *, x0 AS east, x1 AS north FROM nv)
SELECT trip, CAST(round_even(t * 1000, 0) AS BIGINT) AS timestamp, round(degrees(phi), 7) AS latitude, round(degrees(atan2(y, x)), 7) AS longitude, round(x0, 2) AS east, round(x1, 2) AS north, round(x3 * 3.6, 2) AS speed,
round({pmod('degrees(pi() / 2 - x2)', '360.0')}, 1) AS heading, mode, round(quality, 2) AS "gnssQuality", NULL::DOUBLE AS "aiSpeed", 0.0::DOUBLE AS "aiConfidence", 0.0::DOUBLE AS "mapConfidence", round(sqrt(greatest(p00 + p11, 0)), 2) AS "positionStdM" FROM ({_inverse_sql('ou')})""")
def q57_output_record(spark, sf_dir):
    """The estimator's output record for fixes in degrees; the first one is the origin."""
    frames = _frames(events(spark, sf_dir).withColumn("north", F.expr(_FIX_N)), "north")
    fix = F.struct((LAT0 + F.col("north") / 111000.0).alias("lat"), (LON0 + F.col("fix.e") / 68000.0).alias("lon"), *[F.col(f"fix.{c}").alias(c) for c in ("speed", "heading", "accuracy")])
    return keyed.navigate_places(frames.withColumn("fix", F.when(F.col("fix").isNotNull(), fix)).drop("north"), "trip", use_model=False)


_DRAWS = ("(a.k * 13 + a.i) % 20 / 20", "(a.k * 7 + a.i * 3) % 10 / 10", "(a.k * 5 + a.i * 11) % 16 / 16", "(a.k + a.i) % 9 / 4 - 1")


@query(f"""WITH {ISLANDS}, fe AS (SELECT *, value AS x0, k / 8.0::DOUBLE AS x1 FROM isl),
wi AS (SELECT a.trip, a.i AS last, a.run_start, a.value AS y, {', '.join(f'({d})::DOUBLE AS u{j}' for j, d in enumerate(_DRAWS))} FROM fe a WHERE a.run_start >= 0 AND a.i + 1 - 8 >= a.run_start AND (a.i + 1 - 8) % 3 = 0),
wd AS (SELECT *, CAST(round_even(u2 * CASE WHEN u1 < 0.2 THEN 2.0 ELSE 120.0 END * 10, 0) AS BIGINT) AS back FROM wi), wa AS (SELECT wd.*, greatest(last - back, run_start) AS ref FROM wd),
wx AS (SELECT wa.trip, wa.last, list([(fe.x0 - 2) / 3, (fe.x1 - 1) / 4] ORDER BY fe.i) AS x FROM wa JOIN fe ON fe.trip = wa.trip AND fe.i BETWEEN wa.last - 7 AND wa.last GROUP BY ALL)
SELECT wa.trip, wa.last + 1 AS "end", round(list_sum(flatten(x)), 6) AS x_sum, round(x[1][1], 6) AS x_first, round(y, 6) AS y, round(CASE WHEN u0 <= 0.75 THEN greatest(v.value + 0.1 * u3, 0) / 30 ELSE 0 END, 6) AS s_speed,
  round(CASE WHEN u0 <= 0.75 THEN (wa.last - ref) / 10.0::DOUBLE / 120 ELSE 0 END, 6) AS s_age, CASE WHEN u0 <= 0.75 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s_valid FROM wa JOIN wx USING (trip, last) JOIN fe v ON v.trip = wa.trip AND v.i = ref""")
def q58_window_dataset(spark, sf_dir):
    """Model windows with sampled references; numbers by a rule stand for the random ones."""
    ev = events(spark, sf_dir).withColumn("valid", F.col("k") % 8 != 0).withColumnsRenamed({"i": "idx", "value": "speed"})
    frames = ev.withColumn("channels", F.array(F.col("speed"), F.col("k") / 8.0))
    mean, std = (F.array(*[F.lit(float(x)) for x in xs]) for xs in ((2, 1), (3, 4)))
    # the measurement of a window's last row, back from its normalised channel
    k, i = F.round((F.element_at("window", -1)[1] * 4 + 1) * 8).cast("long"), F.col("end") - 1
    draws = ((k * 13 + i) % 20 / 20, (k * 7 + i * 3) % 10 / 10, (k * 5 + i * 11) % 16 / 16, (k + i) % 9 / 4 - 1)
    out = trips.window_dataset(frames, F.col("channels"), mean, std, "trip", 8, 3, draws=draws)
    return out.select(
        "trip", "end", r(F.aggregate(F.flatten("x"), F.lit(0.0), lambda a, b: a + b)).alias("x_sum"), r(F.col("x")[0][0]).alias("x_first"), r("y").alias("y"),
        r(F.col("s")[0]).alias("s_speed"), r(F.col("s")[1]).alias("s_age"), F.col("s")[2].alias("s_valid"),
    )


_SHUT = "k % 8 < 3"


@query(f"""WITH {EV}, fr AS (SELECT trip, i, {_SHUT} AS shut, CASE WHEN k % 11 <> 0 THEN i * 10.0::DOUBLE END AS e, i * 3.0::DOUBLE AS n, CASE WHEN i > 0 THEN i * 10.0::DOUBLE + k % 5 END AS est_e, i * 3.0::DOUBLE - k % 4 AS est_n FROM ev),
rn AS (SELECT *, count(*) FILTER (NOT shut) OVER (PARTITION BY trip ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM fr),
se AS (SELECT trip, run, min(i) FILTER (shut AND est_e IS NOT NULL) AS start, max(i) FILTER (NOT shut) AS "end" FROM rn GROUP BY ALL),
ou AS (SELECT rn.*, se.start, se."end" FROM rn JOIN se USING (trip, run) WHERE i >= se.start AND se."end" IS NOT NULL),
tk AS (SELECT trip, start, sum(d) AS distance_m FROM (SELECT trip, start, sqrt(pow(e - lag(e) OVER w, 2) + pow(n - lag(n) OVER w, 2)) AS d FROM ou WHERE (i = start OR i % 2 = 0) AND e IS NOT NULL WINDOW w AS (PARTITION BY trip, start ORDER BY i)) GROUP BY ALL)
SELECT ou.trip, ou.start, "end", round(("end" - ou.start) * 0.1::DOUBLE, 6) AS duration_s, round(distance_m, 6) AS distance_m, round(sqrt(pow(est_e - e, 2) + pow(est_n - n, 2)), 6) AS err_m,
  round(100 * sqrt(pow(est_e - e, 2) + pow(est_n - n, 2)) / distance_m, 6) AS drift_pct FROM ou JOIN tk ON tk.trip = ou.trip AND tk.start = ou.start WHERE i = "end" AND distance_m > 20 AND e IS NOT NULL""")
def q59_live_outage_log(spark, sf_dir):
    """Outages as they are logged while driving, those of more than 20 m."""
    out = outages.live_log(_shut_frames(events(spark, sf_dir)), "trip", "i", 0.1, every=2)
    return out.select("trip", "start", "end", *[r(c).alias(c) for c in ("duration_s", "distance_m", "err_m", "drift_pct")])


def _shut_frames(ev: DataFrame) -> DataFrame:
    k, i = F.col("k"), F.col("i")
    return ev.select(
        "trip", "i", F.expr(_SHUT).alias("blocked"), F.when(k % 11 != 0, i * 10.0).alias("e"), (i * 3.0).alias("n"),
        F.when(i > 0, i * 10.0 + k % 5).alias("est_e"), (i * 3.0 - k % 4).alias("est_n"),
    )


@query(f"""WITH {EV}, rn AS (SELECT trip, i, unnest(CASE WHEN i % 12 = 0 AND i > 0 THEN [i // 12 - 1, i // 12] ELSE [i // 12] END) AS chunk, printf('%.6f,%.6f', 26 + k / 64.0::DOUBLE, 91 + i / 64.0::DOUBLE) AS p FROM ev)
SELECT trip, chunk, min(i) AS first, count(*) AS n, string_agg(p, ',' ORDER BY i) AS line FROM rn GROUP BY ALL""")
def q60_route_chunks(spark, sf_dir):
    """Routes in stretches that share their end points."""
    ev = events(spark, sf_dir).select("trip", F.col("i").alias("idx"), (26 + F.col("k") / 64.0).alias("lat"), (91 + F.col("i") / 64.0).alias("lon"))
    return trips.route_chunks(ev, "trip", "idx", 12)


@query(f"""WITH {EV}, mo AS (SELECT *, CASE WHEN i % 3 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign, lag(t) OVER (PARTITION BY trip ORDER BY i) AS before FROM ev WHERE kind <> 'click'),
fx AS (SELECT trip, t, value, k FROM ev WHERE kind = 'click' AND k % 5 <> 0),
la AS (SELECT mo.trip, mo.i, arg_max(fx.value, fx.t) AS lat, arg_max(fx.k, fx.t) AS k FROM mo JOIN fx ON fx.trip = mo.trip AND fx.t <= mo.t AND (mo.before IS NULL OR fx.t > mo.before) GROUP BY ALL)
SELECT mo.trip, round(mo.t, 3) AS t, round(sign * value, 6) + 0.0::DOUBLE AS ax, round(sign * coalesce(CASE WHEN mo.k % 7 <> 0 THEN mo.k END, 0), 6) + 0.0::DOUBLE AS ay, round(radians(mo.k), 6) AS gx, round(radians(value), 6) AS gz, la.i IS NOT NULL AS has_fix, round(la.lat, 6) AS lat,
  CASE WHEN la.k % 4 <> 0 THEN la.k * 1.0::DOUBLE END AS speed FROM mo LEFT JOIN la ON la.trip = mo.trip AND la.i = mo.i""")
def q61_live_frames(spark, sf_dir):
    """Motion events and position fixes of a phone as frames, each fix taken once."""
    ev = events(spark, sf_dir).withColumn("stamp_ms", F.col("t") * 1000)
    k = F.col("k")
    moved = ev.where("kind <> 'click'").select(
        "trip", "stamp_ms", F.col("value").alias("ax"), F.when(k % 7 != 0, k).alias("ay"), F.lit(None).cast("double").alias("az"),
        F.col("value").alias("alpha"), k.alias("beta"), F.lit(0.0).alias("gamma"), (F.col("i") % 3 == 0).alias("flipped"),
    )
    fixes = ev.where("kind = 'click'").select(
        "trip", "stamp_ms", F.when(k % 5 != 0, F.col("value")).alias("lat"), F.lit(91.0).alias("lon"), F.when(k % 4 != 0, k.cast("double")).otherwise(F.lit(float("nan"))).alias("speed"),
        F.lit(None).cast("double").alias("heading"), F.lit(5.0).alias("accuracy"),
    )
    out = trips.live_frames(moved, fixes)
    return out.select("trip", r("t", 3).alias("t"), r("ax").alias("ax"), r("ay").alias("ay"), r("gx").alias("gx"), r("gz").alias("gz"), F.col("fix").isNotNull().alias("has_fix"), r("fix.lat").alias("lat"), "fix.speed")


@query(f"""WITH {ISLANDS}, w AS (SELECT trip, i + 1 AS e, run_start, list(value) OVER (PARTITION BY trip ORDER BY i ROWS 15 PRECEDING) AS x FROM isl),
ok AS (SELECT trip, e, x FROM w WHERE len(x) = 16 AND run_start >= 0 AND e - 16 >= run_start AND (e - 16) % 2 = 0),
el AS (SELECT trip, e, unnest(x) AS v, unnest(range(0, 16)) AS j FROM ok),
st AS (SELECT *, v - avg(v) OVER (PARTITION BY trip, e) AS c, abs(v - lag(v) OVER (PARTITION BY trip, e ORDER BY j)) AS d FROM el),
fk AS (SELECT trip, e, k, sqrt(pow(sum(c * cos(2 * pi() * k * j / 16)), 2) + pow(sum(c * sin(2 * pi() * k * j / 16)), 2)) AS size FROM st, range(1, 9) y(k) GROUP BY ALL),
fb AS (SELECT trip, e, {', '.join(f'round(avg(size) FILTER ((k - 1) // 2 = {j}), 6) AS band{j + 1}' for j in range(4))} FROM fk GROUP BY trip, e)
SELECT a.trip, a.e AS "end", mean, std, mean_abs_diff, p05, p95, band1, band2, band3, band4 FROM (SELECT trip, e, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(avg(d), 6) AS mean_abs_diff, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.95), 6) AS p95 FROM st GROUP BY trip, e) a
JOIN fb ON fb.trip = a.trip AND fb.e = a.e""")
def q62_window_spectra(spark, sf_dir):
    """Statistics and band energies of fixed windows of valid runs, by a real Fourier transform."""
    windows = validity.sliding_windows(_islands(events(spark, sf_dir)), "trip", "i", F.col("value"), 16, 2)
    s = learning.window_statistics(windows, {"window": "s"})
    return s.select("trip", "end", *[r(f"s.{c}").alias(c) for c in learning.STATISTICS])


@query(f"""WITH RECURSIVE {SCORES}, ru AS (SELECT 'S' || (trip % 3) AS scenario, trip * 100000 + start AS outage, seed, drift_pct * (1 + seed / 8.0) AS drift FROM sc, range(0, 3) x(seed) WHERE valid AND mean_speed_mps >= 3 AND (start + seed) % 5 <> 0 AND NOT (trip % 3 = 1 AND seed = 2)),
{_bootstrap_sql("scenario AS trip, '60s' AS scenario, 'full' AS config")}""")
def q63_robustness_of_reports(spark, sf_dir):
    """Scores to nested report files of three runs, back to rows, scored outages, and the robustness record of each trip.

    Runs lack some outages, one lacks a whole trip.
    """
    scores = _scores(events(spark, sf_dir)).crossJoin(F.broadcast(spark.range(3).withColumnRenamed("id", "seed")))  # three rows
    scores = scores.where(((F.col("start") + F.col("seed")) % 5 != 0) & ~((F.col("trip") % 3 == 1) & (F.col("seed") == 2)))
    rows = scores.select(
        F.concat_ws("/", "seed", F.concat(F.lit("S"), F.col("trip") % 3)).alias("trip"), F.lit("60s").alias("scenario"), F.lit("full").alias("config"),
        (F.col("trip") * 100000 + F.col("start")).alias("start"), "end", "mean_speed_mps", "valid", (F.col("drift_pct") * (1 + F.col("seed") / 8)).alias("drift_pct"),
    )
    # a report for each run and trip; the run is no part of the trip's name in it
    reports = tables.nested_report(rows).select(F.substring_index("trip", "/", 1).alias("run"), F.regexp_replace("report", '"[0-2]/(S[0-2])"', '"$1"').alias("report"))
    path = f"{tables.shared_root(spark)}/driftline/reports-{uuid.uuid4().hex}"
    tables.write_reports(reports, path)
    out = outages.robustness_of_reports(tables.read_reports(spark, path), 2000, RuleDraws(), spread=lambda c: c, bucket=_BUCKET)
    tables.drop_folder(spark, path)
    return out.select(*[F.col(c) if c in ("trip", "scenario", "config", "n_observations", "seeds", "n_outages") else r(c).alias(c) for c in out.columns])


def _driven(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Rows of which :func:`_truth_frames` makes frames with their truth, and outages of two lengths."""
    rows = events(spark, sf_dir).select("trip", "i", "k")
    ends = rows.groupBy("trip").agg((10 * F.count("*")).alias("n_frames"))
    tiles = [outages.tiled_outages(ends, "trip", "n_frames", first, length, 60).withColumn("scenario", F.lit(name)) for name, first, length in _OUTAGES]
    return rows, tiles[0].unionByName(tiles[1]).select("trip", "scenario", "start", "end")


def _truth_frames(rows: DataFrame) -> DataFrame:
    frames = _frames(rows, "i", "k", *[c for c in rows.columns if c.startswith("_")]).withColumn("idx", F.round(F.col("t") * 10).cast("long"))
    return frames.withColumns({"e": F.col("idx") * 1.2, "n": F.lit(0.0), "speed": F.lit(12.0), "valid": F.col("k") % 40 != 0})


def _benchmarked(spark, sf_dir) -> DataFrame:
    return benchmark.benchmark(*_driven(spark, sf_dir), "trip", 0.1, order=["i"], frames_of=_truth_frames, use_model=False)


_OUTAGES = (("5s", 100, 50), ("12s", 110, 120))
# a replay is a trip of its own: the scenario's place is its last digit
DRIVEN = f"""{FRAMES}, tl AS ({' UNION ALL '.join(f"""SELECT trip, {j} AS sc, s AS start, s + {length} AS "end" FROM (SELECT trip, unnest(range({first}, 10 * count(*) - {length}, {length + 60})) AS s FROM ev GROUP BY trip)""" for j, (_, first, length) in enumerate(_OUTAGES))}),
ry AS (SELECT fm.* REPLACE (fm.trip * 10 + sc AS trip, CASE WHEN EXISTS (SELECT 1 FROM tl WHERE tl.trip = fm.trip AND tl.sc = y.sc AND fm.f >= tl.start AND fm.f < tl."end") THEN NULL ELSE fix END AS fix) FROM fm JOIN (SELECT DISTINCT trip, sc FROM tl) y ON y.trip = fm.trip), {kernel_sql.navigation('ry')},
es AS (SELECT nv.trip // 10 AS trip, nv.trip % 10 AS sc, CAST(round(t * 10) AS BIGINT) AS f, sqrt(pow(x0 - 1.2 * round(t * 10), 2) + pow(x1, 2)) AS err, mode IN {kernel_sql.LOST} AS dr FROM nv),
so AS (SELECT tl.trip, tl.sc, start, "end", sum(1.2::DOUBLE) FILTER (f >= start) AS distance_m, bool_and(ev.k % 40 <> 0) FILTER (f >= start) AS valid, max(err) FILTER (f = start - 1) AS err_start_m, max(err) FILTER (f = "end" - 1) AS err_end_m,
  max(err) FILTER (f >= start) AS err_max_m, avg(CAST(dr AS INTEGER)) FILTER (f >= start) AS dr_fraction, (min(f) FILTER (dr AND f >= start) - start) * 0.1::DOUBLE AS switch_latency_s
  FROM tl JOIN es ON es.trip = tl.trip AND es.sc = tl.sc AND f >= start - 1 AND f < "end" JOIN ev ON ev.trip = tl.trip AND ev.i = f // 10 GROUP BY tl.trip, tl.sc, start, "end"),
bm AS (SELECT *, CASE sc {' '.join(f"WHEN {j} THEN '{name}'" for j, (name, _, _) in enumerate(_OUTAGES))} END AS scenario, 100 * err_end_m / distance_m AS drift_pct, ("end" - start) * 0.1::DOUBLE AS duration_s, distance_m / (("end" - start) * 0.1::DOUBLE) AS mean_speed_mps FROM so)"""


@query(f"""WITH RECURSIVE {DRIVEN} SELECT scenario, trip, start, "end", valid, {', '.join(f'round({c}, 4) AS {c}' for c in _SCORED)} FROM bm""")
def q64_benchmark_scores(spark, sf_dir):
    """Frames replayed without fixes inside planned outages of two lengths, estimated, and each outage scored."""
    s = _benchmarked(spark, sf_dir)
    return s.select("scenario", "trip", "start", "end", "valid", *[r(c, 4).alias(c) for c in _SCORED])


_ENDS = ("median_low", "median_high", "pass_rate_low", "pass_rate_high")


_ROBUST, _ROBUST_SELECT = _bootstrap_sql().rsplit("\nSELECT ", 1)


@query(f"""WITH RECURSIVE {DRIVEN}, kp AS (SELECT * FROM bm WHERE valid AND mean_speed_mps >= 3), ru AS (SELECT scenario, trip * 100000 + start AS outage, 0 AS seed, drift_pct AS drift FROM kp),
{_ROBUST}, rb AS (SELECT {_ROBUST_SELECT.replace(', 6)', ', 4)')}), sm AS ({_summary_sql('scenario').replace(', 6)', ', 4)')} FROM kp GROUP BY scenario)
SELECT sm.*, n_outages, {', '.join(_ENDS)} FROM sm JOIN rb USING (scenario)""")
def q65_benchmark_record(spark, sf_dir):
    """The benchmark from frames to the record of each scenario: summary and bootstrap intervals of 2,000 replicates."""
    scores = _benchmarked(spark, sf_dir)
    s = benchmark.record(scores, ["scenario"], F.col("trip") * 100000 + F.col("start"), draws=RuleDraws(), spread=lambda c: c, bucket=_BUCKET)
    return s.select("scenario", "n", "n_outages", *[r(c, 4).alias(c) for c in s.columns if c not in ("scenario", "n", "n_outages")])


_BANDS = ((0, 5), (5, 15), (15, 40), (40, 60))


@query(f"""WITH x AS (SELECT l_returnflag AS split, l_quantity AS a, l_quantity * 0.97 + l_discount * 20 - l_tax * 3 AS p, 0.25 + l_tax * 10 AS var, l_discount * 10 AS ps, l_linenumber % 3 <> 0 AS ref FROM lineitem)
SELECT split, count(*) AS n, round(avg(abs(p - a)), 6) AS mae, round(sqrt(avg((p - a) * (p - a))), 6) AS rmse, round(avg(p - a), 6) AS bias, {', '.join(f'round(avg(abs(p - a)) FILTER (a >= {lo} AND a < {hi}), 6) AS mae_{lo}_{hi}' for lo, hi in _BANDS)},
round(2.0 * count(*) FILTER (ps > 0.5 AND a < 4) / nullif(count(*) FILTER (ps > 0.5) + count(*) FILTER (a < 4), 0), 6) AS stationary_f1, round(stddev_pop((p - a) / sqrt(var)), 6) AS z_std, round(avg(abs(a - m)), 6) AS mae_of_mean,
round(avg(abs(p - a)) FILTER (ref), 6) AS mae_with_reference, round(avg(abs(p - a)) FILTER (NOT ref), 6) AS mae_without_reference FROM x JOIN (SELECT split, avg(a) AS m FROM x GROUP BY split) USING (split) GROUP BY split""")
def q66_model_record(spark, sf_dir):
    """What a model is worth, in one record for each split."""
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("split"), q.alias("actual"), (q * 0.97 + F.col("l_discount") * 20 - F.col("l_tax") * 3).alias("predicted"), (0.25 + F.col("l_tax") * 10).alias("variance"),
        (F.col("l_discount") * 10).alias("p_stationary"), (F.col("l_linenumber") % 3 != 0).alias("has_reference"),
    )
    m = outages.model_record(rows, ["split"], list(_BANDS), 4.0)
    return m.select("split", "n", *[r(c).alias(c) for c in m.columns if c not in ("split", "n")])


@query(f"""WITH {FRAMES}, sl AS (SELECT trip, f - 30 AS f, ax, gz, f * 1.2 AS e, fix FROM fm WHERE f BETWEEN 30 AND 629),
rp AS (SELECT trip, count(*) AS frames, round(count(*) / 600.0, 1)::DOUBLE AS minutes, count(fix) AS n_fixes, count(*) FILTER (f % 10 = 0) AS n_truth, round(sum(ax) + sum(gz) + 9.8 * count(*), 4)::DOUBLE AS imu_sum,
  round(sum(fix.e * 0.00001 + 9), 4)::DOUBLE AS fix_lon_sum, round(sum(CASE WHEN f % 10 = 0 THEN e * 0.00001 + 9 END), 4)::DOUBLE AS truth_lon_sum, min(e) - 150 AS lo, max(e) + 150 AS hi FROM sl GROUP BY trip),
vt AS (SELECT trip, i // 4 AS way, k % 50 * 40.0 AS e, (k % 7 - 3) * 200.0 AS n FROM ev),
wy AS (SELECT vt.trip, way, count(*) AS points FROM vt JOIN rp USING (trip) GROUP BY vt.trip, way HAVING bool_or(e > lo AND e < hi AND n > -150 AND n < 150) AND count(*) >= 2)
SELECT rp.trip, frames, minutes, n_fixes, n_truth, imu_sum, fix_lon_sum, truth_lon_sum, coalesce(n_roads, 0) AS n_roads, CAST(coalesce(n_points, 0) AS BIGINT) AS n_points
FROM rp LEFT JOIN (SELECT trip, count(*) AS n_roads, sum(points) AS n_points FROM wy GROUP BY trip) USING (trip)""")
def q67_replay_export(spark, sf_dir):
    """All drives exported, one minute from 3 s on, with the roads around, and counted as read back from what was written."""
    ev = events(spark, sf_dir)
    f = _frames(ev)
    number = F.round(F.col("t") * 10).cast("long")
    f = f.withColumns({"idx": number, "e": number * 1.2, "n": F.lit(0.0), "lat": F.lit(50.0), "lon": number * 1.2 * 0.00001 + 9, "fix_lat": F.when(F.col("fix").isNotNull(), F.col("fix.n") * 0.00001 + 50), "fix_lon": F.col("fix.e") * 0.00001 + 9, **{f"fix_{c}": F.col(f"fix.{c}") for c in ("speed", "heading", "accuracy")}})
    e, n = F.col("k") % 50 * 40.0, (F.col("k") % 7 - 3) * 200.0
    v = ev.select("trip", F.floor(F.col("i") / 4).alias("way"), (F.col("i") % 4).alias("position"), F.lit("service").alias("highway"), e.alias("e"), n.alias("n"), (e * 0.00001 + 9).alias("lon"), (n * 0.00001 + 50).alias("lat"))
    path = f"{tables.shared_root(spark)}/replay-export-{uuid.uuid4().hex}"
    tables.drop_at_exit(spark, path)
    index = replays.export(f, v, path, "trip", "idx", start_s=3.0, minutes=1.0, margin_m=150.0)
    text = F.from_json("replay", "frames bigint, imu array<double>, gnss array<array<double>>, gt array<array<double>>")
    summed = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    read = versions.read(spark, f"{path}/replays").select("trip", text.alias("x")).select(
        "trip", F.size("x.gnss").cast("long").alias("n_fixes"), F.size("x.gt").cast("long").alias("n_truth"), r(summed("x.imu"), 4).alias("imu_sum"),
        F.when(F.size("x.gnss") > 0, r(summed(F.transform("x.gnss", lambda p: p[2])), 4)).alias("fix_lon_sum"), r(summed(F.transform("x.gt", lambda p: p[2])), 4).alias("truth_lon_sum"),
    )
    features = F.from_json("geojson", "features array<struct<geometry: struct<coordinates: array<array<double>>>>>")["features"]
    points = F.aggregate(F.transform("x", lambda w: F.size(w["geometry"]["coordinates"])), F.lit(0), lambda a, x: a + x)
    maps = versions.read(spark, f"{path}/maps").select("trip", features.alias("x")).select("trip", F.size("x").cast("long").alias("n_roads"), points.cast("long").alias("n_points"))
    return index.join(read, "trip").join(maps, "trip").select("trip", "frames", "minutes", *read.columns[1:], "n_roads", "n_points")


_REPORT = f"""sm AS (SELECT CAST(trip % 3 AS VARCHAR) AS trip, CAST(trip % 2 AS VARCHAR) AS scenario, 'c' || start % 4 AS config, count(*) AS n, quantile_cont(drift_pct, 0.5) AS a, avg(drift_pct) AS b, quantile_cont(drift_pct, 0.9) AS c,
  avg(CASE WHEN drift_pct < 10 THEN 1.0 ELSE 0.0 END) AS d, quantile_cont(err_end_m, 0.5) AS e FROM sc WHERE valid AND mean_speed_mps >= 3 GROUP BY ALL)"""


@query(f"""WITH {SCORES}, {_REPORT}
SELECT trip, scenario, 0 AS position, '**' || trip || ' – ' || CASE scenario WHEN '0' THEN 'even trips' ELSE scenario END || '**' AS line FROM sm GROUP BY ALL
UNION ALL SELECT DISTINCT trip, scenario, 1, '| Engine | n | drift median | drift mean | drift p90 | pass < 10 % | end error median | ms/frame |' FROM sm
UNION ALL SELECT DISTINCT trip, scenario, 2, '|---|---:|---:|---:|---:|---:|---:|---:|' FROM sm
UNION ALL SELECT trip, scenario, CAST(2 + row_number() OVER (PARTITION BY trip, scenario ORDER BY config) AS INTEGER), printf('| %s | %d | %.1f %% | %.1f %% | %.1f %% | %.0f%% | %.1f m | – |', config, n, round(a, 1), round(b, 1), round(c, 1), round(100 * d, 0), round(e, 1)) FROM sm""")
def q68_report_tables(spark, sf_dir):
    """Scored outages as Markdown tables, one for each of three groups of trips and two scenarios."""
    kept = outages.scored_only(_scores(events(spark, sf_dir))).withColumn("scenario", F.col("trip") % 2).withColumn("trip", F.col("trip") % 3)
    s = outages.summarise(kept.withColumn("config", F.concat(F.lit("c"), F.col("start") % 4)), ["trip", "scenario", "config"])
    return tables.markdown_tables(s, scenarios={"0": "even trips"})


@query(f"""{_SQL["q34_hmm_posterior"].split("SELECT c_custkey, seg, round(posterior")[0].rstrip()},
bs AS (SELECT *, first(seg) OVER w AS bseg, first(foot_e) OVER w AS be, first(foot_n) OVER w AS bn, first(rp) OVER w AS br FROM pr WINDOW w AS (PARTITION BY c_custkey ORDER BY round(score, 9) DESC, seg ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT c_custkey, CAST(any_value(bseg) AS BIGINT) AS seg, round(sum(CASE WHEN sqrt(pow(foot_e - be, 2) + pow(foot_n - bn, 2)) < 3 AND abs({wrap('rp - br')}) < radians(20.0) THEN posterior ELSE 0 END), 6) AS confidence FROM bs GROUP BY c_custkey""")
def q69_road_confidence(spark, sf_dir):
    """The likeliest road of each point, and the mass of all candidates that are the same road."""
    pairs = _near(spark, sf_dir).withColumnsRenamed({"psi": "road", "psi_v": "psi"})
    scored = roads.emission_scores(pairs, F.lit(20.0)).withColumn("score", F.round("score", 9))
    out = roads.posterior(scored, "c_custkey", "seg")
    return out.where("is_best").select("c_custkey", "seg", r("confidence").alias("confidence"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
