"""From two raw logs of a drive to aligned frames, from frames to model windows, and replays as frames with fixes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import angles, motion
from ..functions.draws import normal, uniform
from ..sources.tables import shared_table
from . import alignment, outages, validity

#: The gyro columns of a phone log in the order of the axes x, y, z.
GYRO = ("g_yaw", "g_roll", "g_pitch")


@dataclass(frozen=True)
class Preparation:
    """Limits of the alignment; the defaults are those for logs of ten samples a second."""

    step: float = 0.1
    moving_speed: float = 2.0
    axis_least: int = 100
    lag_least: int = 600
    max_lag: int = 50
    gap: float = 0.5
    block: int = 600
    block_least: int = 100
    block_std: float = 0.02
    block_r: float = 0.5
    #: The gyro column that is about the vertical; another one in a trip of more than ``lag_least`` moving frames is an error.
    vertical: str | None = None


def _whole_hour_offset(phone: DataFrame, vehicle: DataFrame, key: str) -> DataFrame:
    first = [d.groupBy(key).agg(F.min_by("t", "row").alias(f"t_{n}")) for n, d in (("phone", phone), ("vehicle", vehicle))]
    return first[0].join(first[1], key).select(key, angles.whole_hours(F.col("t_phone") - F.col("t_vehicle")).alias("hour_offset_s"))


def _fixes(frames: DataFrame, phone: DataFrame, key: str) -> DataFrame:
    """The phone's latest fix at each frame, and whether it is another one than at the frame before."""
    values = ["lat", "lon", "kmh", "accuracy", "bearing"]
    known = alignment.change_ids(phone, key, "row", values[:3]).select(key, "row", "t", "change_id", *[F.col(v).alias(f"fix_{v}") for v in values])
    names = ["change_id", *[f"fix_{v}" for v in values]]
    out = alignment.asof_backward(frames, known, key, "t", names, ties="row").drop("at")
    # a frame before the first sample has that one's
    first = known.groupBy(key).agg(F.min_by(F.struct(*names), F.struct("t", "row")).alias("_first"))
    out = out.join(first, key).withColumns({n: F.when(F.col("change_id").isNull(), F.col(f"_first.{n}")).otherwise(F.col(n)) for n in names}).drop("_first")
    before = F.lag("change_id").over(Window.partitionBy(key).orderBy("idx"))
    return out.withColumn("fix_new", F.coalesce(F.col("change_id") > before, F.lit(True))).withColumn("fix_speed", angles.kmh_to_mps(F.col("fix_kmh"))).drop("change_id", "fix_kmh")


def prepare(phone: DataFrame, vehicle: DataFrame, key: str = "trip", how: Preparation = Preparation()) -> tuple[DataFrame, DataFrame]:
    """Aligned frames and one row of metadata for each trip that both logs have.

    ``phone`` has ``row, t, ax, ay, az, g_yaw, g_roll, g_pitch, lat, lon, kmh, accuracy, bearing`` and ``vehicle``
    has ``row, t, yaw_deg, kmh, lat, lon, heading``, with ``t`` in seconds of the day and ``row`` the place in the file.

    Clocks are brought together by whole hours, rows that go back in time are left out, both logs are interpolated on a
    grid over the time that both cover, and what lag is left is taken from the correlation of the phone's rotation with
    the vehicle's. Frames in a gap of either log, or in a block where the two rotations do not agree, are not valid.
    """
    offset = _whole_hour_offset(phone, vehicle, key)
    phone = phone.join(offset, key).withColumn("t", F.col("t") - F.col("hour_offset_s")).drop("hour_offset_s")
    phone = alignment.monotonic_filter(phone, key, "row", "t")
    vehicle = alignment.unwrapped(alignment.monotonic_filter(vehicle, key, "row", "t"), key, "row", "heading", out="course")
    grid = alignment.common_grid(alignment.series_overlap(phone, vehicle, key, "t"), key, "low", "high", how.step)

    frames = alignment.interpolate(grid, vehicle, key, "t", ["yaw_deg", "kmh", "lat", "lon", "course"])
    frames = frames.select(
        key, "idx", "t", F.radians("yaw_deg").alias("can_yaw"), angles.kmh_to_mps(F.col("kmh")).alias("speed"), "lat", "lon",
        F.pmod("course", F.lit(360.0)).alias("course_deg"),
    )
    # tables of their own where a result is read several times, so that it is made once
    spark = phone.sparkSession
    frames = shared_table(spark, frames, "vehicle-grid")
    phone = shared_table(spark, phone, "phone-log")
    moving = F.col("speed") > how.moving_speed
    turned = alignment.interpolate(frames.select(key, "idx", "t", "can_yaw", "speed"), phone, key, "t", list(GYRO), ties="row", last=True)
    sizes = turned.groupBy(key).agg(F.count(F.when(moving, 1)).alias("n_moving"))
    picked = alignment.pick_axis(turned.withColumns({c: F.when(moving, F.col(c)) for c in (*GYRO, "can_yaw")}), key, list(GYRO), "can_yaw", how.axis_least)
    axis = picked.select(key, "axis", F.create_map(*[x for c in GYRO for x in (F.lit(c), F.col(c))]).alias("gyro_corr")).join(sizes, key)
    if how.vertical:
        wrong = F.raise_error(F.concat(F.lit("the vertical gyro column of trip "), F.col(key).cast("string"), F.lit(" is "), F.col("axis")))
        axis = axis.withColumn("axis", F.when((F.col("n_moving") > how.lag_least) & (F.col("axis") != how.vertical), wrong).otherwise(F.col("axis")))
    vertical = F.coalesce(*[F.when(F.col("axis") == c, F.col(c)) for c in GYRO])
    series = turned.join(axis.where(F.col("n_moving") > how.lag_least).select(key, "axis"), key).withColumn("vertical", vertical)
    lags = alignment.best_lag_by_key(series, key, "idx", "vertical", "can_yaw", how.max_lag)
    told = axis.join(lags, key, "left").join(offset, key).withColumn("lag_s", F.coalesce(F.col("lag") * how.step, F.lit(0.0)))
    told = shared_table(spark, told, "trip-clocks")

    phone = phone.join(told.select(key, "lag_s"), key).withColumn("t", F.col("t") + F.col("lag_s"))
    # rows that go on from a row which was left out may have the time of an earlier one, or lie before it
    frames = alignment.interpolate(frames, phone, key, "t", ["ax", "ay", "az", *GYRO], ties="row")
    frames = alignment.gap_free(frames, vehicle, key, "t", how.gap).withColumnRenamed("ok", "_ok")
    frames = alignment.gap_free(frames, phone, key, "t", how.gap).withColumn("valid", F.col("_ok") & F.col("ok")).drop("_ok", "ok")
    frames = frames.withColumn("idx", F.col("idx") - F.min("idx").over(Window.partitionBy(key)))
    frames = shared_table(spark, frames, "aligned")
    blocks = validity.block_agreement(frames, key, "idx", "g_pitch", "can_yaw", moving & F.col("valid"), how.block, how.block_least, how.block_std)
    frames = validity.mark_blocks(frames, blocks, key, "idx", "valid", how.block, how.block_r)
    # before fixes and places are joined, which change no row's time, speed or validity
    meta = frames.groupBy(key).agg(
        F.count("*").alias("samples"), (F.count("*") * how.step / 60).alias("duration_min"), (100 * F.avg(F.col("valid").cast("double"))).alias("valid_pct"),
        (F.sum(F.when(F.col("valid"), F.col("speed")).otherwise(0.0)) * how.step / 1000).alias("distance_km"),
    )
    frames = _fixes(frames, phone, key)

    origin = frames.groupBy(key).agg(F.min_by(F.struct("lat", "lon"), "idx").alias("origin"))
    frames = frames.join(origin, key)
    east, north = angles.to_enu(F.col("lat"), F.col("lon"), F.col("origin.lat"), F.col("origin.lon"))
    frames = frames.withColumns({"east": east, "north": north}).withColumnsRenamed(dict(zip(GYRO, ("gx", "gy", "gz"), strict=True)))
    medians = blocks.groupBy(key).agg(F.percentile("r", 0.5).alias("segment_corr_median"))
    meta = meta.join(told.select(key, "hour_offset_s", "lag_s", F.col("r").alias("lag_corr"), F.col("axis").alias("vertical_gyro_column"), "gyro_corr"), key)
    return frames, meta.join(medians, key, "left")


def phone_fixes(frames: DataFrame) -> Column:
    """The phone's own fix of a frame as a struct where it is new, else null; missing numbers are null.

    The bearing counts above 1 m/s only.
    """
    def number(c: str) -> Column:
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))

    speed = number("fix_speed")
    fix = F.struct(
        F.col("fix_lat").alias("lat"), F.col("fix_lon").alias("lon"), speed.alias("speed"),
        F.when(speed > 1.0, number("fix_bearing")).alias("heading"), number("fix_accuracy").alias("accuracy"),
    )
    return F.when(F.col("fix_new") & number("fix_lat").isNotNull() & number("fix_lon").isNotNull(), fix)


def replay_frames(frames: DataFrame, planned: DataFrame, key: str = "trip", legacy_axes: bool = False) -> DataFrame:
    """Frames as the estimator takes them: seconds since the trip's start, and ``fix`` null inside planned outages.

    With ``legacy_axes`` the first and third gyro axis change places, as an older parser had read them.
    """
    marked = outages.masked(frames, planned, key, "idx")
    since = F.col("t") - F.first("t").over(Window.partitionBy(key).orderBy("idx"))
    gx, gz = ("gz", "gx") if legacy_axes else ("gx", "gz")
    return marked.withColumns({"t": since, "fix": F.when(~F.col("in_outage"), F.col("fix")), "gx": F.col(gx), "gz": F.col(gz)})


def located(frames: DataFrame, key: str = "trip") -> DataFrame:
    """Frames whose ``fix`` has ``lat, lon``, with ``e, n`` in it about the first fix of their key, and that ``origin``."""
    first = frames.where(F.col("fix.lat").isNotNull() & F.col("fix.lon").isNotNull()).groupBy(key).agg(F.min_by(F.struct("fix.lat", "fix.lon"), "t").alias("origin"))
    out = frames.join(first, key, "left")
    e, n = angles.to_enu(F.col("fix.lat"), F.col("fix.lon"), F.col("origin.lat"), F.col("origin.lon"))
    fix = F.struct(e.alias("e"), n.alias("n"), *[F.col(f"fix.{c}").alias(c) for c in ("speed", "heading", "accuracy")])
    return out.withColumn("fix", F.when(F.col("fix.lat").isNotNull() & F.col("fix.lon").isNotNull(), fix))


def output_record(states: DataFrame, key: str = "trip") -> DataFrame:
    """The record of each state with ``origin``: rounded, in km/h and compass degrees, with its coordinates.

    Before the first fix there are no coordinates.
    """
    lat, lon = angles.to_geodetic(F.col("east"), F.col("north"), F.col("origin.lat"), F.col("origin.lon"))
    kmh = lambda c: F.round(F.col(c) * 3.6, 2)
    return states.select(
        key, F.bround(F.col("t") * 1000).cast("long").alias("timestamp"), F.round(lat, 7).alias("latitude"), F.round(lon, 7).alias("longitude"),
        F.round("east", 2).alias("east"), F.round("north", 2).alias("north"), kmh("speed").alias("speed"), F.round(angles.psi_to_compass(F.col("psi")), 1).alias("heading"),
        "mode", F.round("quality", 2).alias("gnssQuality"), kmh("model_speed").alias("aiSpeed"), F.round("model_confidence", 2).alias("aiConfidence"),
        F.round("map_confidence", 2).alias("mapConfidence"), F.round("position_std", 2).alias("positionStdM"),
    )


def window_dataset(
    frames: DataFrame, channels: Column, mean: Column, std: Column, key: str = "trip", length: int = 40, step: int = 5, rate: float = 10.0,
    scale: tuple[float, float, float] = (30.0, 120.0, 1.0), draws: tuple[Column, Column, Column, Column] | None = None, seed: int = 0,
) -> DataFrame:
    """``key, end, x, s, y``: normalised windows within valid runs, their reference as scaled scalars, and the speed.

    ``draws`` are random numbers of a window: whether it has a reference (up to 0.75), whether that is a recent one (up
    to 0.2), its age as a share of 2 s or 120 s, and the normal noise of its speed in 0.1 m/s. The age is cut to the
    start of the valid run. Frames have ``idx, speed, valid``; ``channels`` is an array.
    """
    draws = draws or (*[uniform(seed, key, "end", draw=k) for k in range(3)], normal(seed, key, "end", draw=3))
    rows = validity.islands(frames.withColumn("_x", motion.normalise(channels, mean, std)), key, "idx", "valid")
    windows = validity.sliding_windows(rows, key, "idx", F.col("_x"), length, step).withColumn("last", F.col("end") - 1)
    # drawn in a projection of its own, so that each number is drawn once
    drawn = windows.withColumns({f"_u{k}": d for k, d in enumerate(draws)})
    age = F.col("_u2") * F.when(F.col("_u1") < 0.2, 2.0).otherwise(motion.REFERENCE_AGE_MAX)
    drawn = drawn.withColumn("back", F.bround(age * rate).cast("long"))
    at = rows.select(key, F.col("idx").alias("last"), "run_start", F.col("speed").alias("y"))
    drawn = drawn.join(at, [key, "last"]).withColumn("at", F.greatest(F.col("last") - F.col("back"), F.col("run_start")))
    drawn = drawn.join(rows.select(key, F.col("idx").alias("at"), F.col("speed").alias("v")), [key, "at"])
    has = F.col("_u0") <= 0.75
    scalars = [F.greatest(F.col("v") + 0.1 * F.col("_u3"), F.lit(0.0)), (F.col("last") - F.col("at")) / rate, F.lit(1.0)]
    s = F.array(*[F.when(has, c / k).otherwise(0.0) for c, k in zip(scalars, scale, strict=True)])
    return drawn.select(key, "end", F.col("window").alias("x"), s.alias("s"), "y")


def live_frames(motion_events: DataFrame, fixes: DataFrame, key: str = "trip") -> DataFrame:
    """Frames as the estimator takes them from a phone's motion events and position fixes.

    Motion events have ``stamp_ms``, accelerations ``ax, ay, az`` with gravity, rates ``alpha, beta, gamma`` in degrees
    a second about z, x and y, and ``flipped``, whether the phone tells accelerations with the opposite sign. Missing
    numbers count as 0. Fixes have ``stamp_ms, lat, lon, speed, heading, accuracy``; each goes to the first event at or
    after it and to no other, and where several wait for one event, the last counts.
    """
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    sign = F.when(F.coalesce(F.col("flipped"), F.lit(False)), -1.0).otherwise(1.0)
    moved = motion_events.select(
        key, "stamp_ms", F.lit(1).alias("part"), *[(sign * zero(c)).alias(c) for c in ("ax", "ay", "az")],
        *[F.radians(zero(c)).alias(g) for g, c in (("gx", "beta"), ("gy", "gamma"), ("gz", "alpha"))],
    )
    known = fixes.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    known = known.select(key, "stamp_ms", F.lit(0).alias("part"), F.struct("stamp_ms", "lat", "lon", finite("speed").alias("speed"), finite("heading").alias("heading"), "accuracy").alias("waiting"))
    rows = moved.unionByName(known, allowMissingColumns=True)
    # one sort gives the fix that waits and the event before, after which it came
    own = Window.partitionBy(key).orderBy("stamp_ms", "part")
    event = F.when(F.col("part") == 1, F.col("stamp_ms"))
    rows = rows.withColumns({
        "waiting": F.last("waiting", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)),
        "before": F.last(event, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)),
    })
    fresh = F.col("before").isNull() | (F.col("waiting.stamp_ms") > F.col("before"))
    fix = F.when(F.col("waiting").isNotNull() & fresh, F.struct(*[F.col(f"waiting.{c}").alias(c) for c in ("lat", "lon", "speed", "heading", "accuracy")]))
    return rows.where("part = 1").select(key, (F.col("stamp_ms") / 1000).alias("t"), "ax", "ay", "az", "gx", "gy", "gz", fix.alias("fix"))


def route_chunks(points: DataFrame, key: str = "trip", index: str = "idx", size: int = 120) -> DataFrame:
    """``key, chunk, first, n, line``: a route's points ``lat, lon`` in stretches that share their end points.

    A stretch has ``size`` points and the first one of the next. ``line`` lists them as latitude, longitude with six
    places, as a query for the roads along a route takes them.
    """
    at = F.row_number().over(Window.partitionBy(key).orderBy(index)) - 1
    rows = points.select(key, at.cast("long").alias("at"), "lat", "lon")
    own = (F.col("at") / size).cast("long")
    chunks = F.when((F.col("at") % size == 0) & (F.col("at") > 0), F.array(own - 1, own)).otherwise(F.array(own))
    rows = rows.select(key, F.explode(chunks).alias("chunk"), "at", F.format_string("%.6f,%.6f", "lat", "lon").alias("p"))
    listed = F.array_sort(F.collect_list(F.struct("at", "p")))
    return rows.groupBy(key, "chunk").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.array_join(F.transform(listed, lambda x: x["p"]), ",").alias("line"))
