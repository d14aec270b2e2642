"""Planning outages, masking frames, scoring estimates and summing up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import drop_table, report_rows, shared_table
from . import bootstrap, chains, quantiles

AIDED, DEGRADED, DEAD_RECKONING, REACQUISITION = "GNSS_AIDED", "DEGRADED", "DEAD_RECKONING", "REACQUISITION"
LEAST_SPEED = 3.0
PASS_PERCENT = 10.0


def tiled_outages(trips: DataFrame, key: str, n: str, first: int, length: int, recovery: int) -> DataFrame:
    """``key, outage, start, end``: outages of ``length`` frames from ``first`` on, with ``recovery`` frames between."""
    last = F.col(n) - length - 1
    starts = F.when(last >= first, F.sequence(F.lit(first).cast("long"), last.cast("long"), F.lit(length + recovery).cast("long"))).otherwise(F.array().cast("array<long>"))
    return trips.select(key, F.posexplode(starts).alias("outage", "start")).withColumn("end", F.col("start") + length)


def distance_outages(candidates: DataFrame, key: str, first: int, gap_hit: int, gap_miss: int) -> DataFrame:
    """``key, start, end``: a greedy choice among ``key, start, end, fits`` candidates, one for each start.

    The first candidate looked at starts at ``first``; after one that fits the next start is ``gap_hit`` past its end,
    after another one ``gap_miss`` past its start. The choice ends where no candidate has the start, or it has no end.
    """
    candidates = candidates.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    fits = F.coalesce("fits", F.lit(False))
    edges = candidates.select(key, F.col("start").alias("node"), F.when(fits, F.col("end") + gap_hit).otherwise(F.col("start") + gap_miss).alias("next"))
    starts = candidates.select(key, F.lit(first).cast("long").alias("node")).distinct()
    visited = chains.reached(edges, starts, key).withColumnRenamed("node", "start")
    return candidates.where(fits).join(visited, [key, "start"], "left_semi").select(key, "start", "end")


def never_broadcast(df: DataFrame) -> DataFrame:
    """For a side of a join that is large when run, though Spark takes it for small and would send it to the driver.

    Its guess has no share in what ``explode`` makes of a row, and goes by the bytes of a file in which repeated values
    take next to no room.
    """
    return df.hint("merge")


def masked(frames: DataFrame, outages: DataFrame, key: str, index: str) -> DataFrame:
    """Frames with ``in_outage``: intervals are unrolled to their indices, so the join is one of equal keys."""
    inside = outages.select(key, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias(index)).distinct()
    return frames.join(never_broadcast(inside.withColumn("in_outage", F.lit(True))), [key, index], "left").withColumn("in_outage", F.coalesce("in_outage", F.lit(False)))


def score_outages(frames: DataFrame, outages: DataFrame, key: str, index: str, dt: float) -> DataFrame:
    """Scores of each outage from frames ``speed, valid, est_e, est_n, e, n, mode``.

    The error before the outage is that of the frame before its start.
    """
    rows = frames.select(key, F.col(index).alias("i"), "speed", "valid", "est_e", "est_n", "e", "n", "mode")
    wanted = outages.select(key, "start", "end", F.explode(F.sequence(F.col("start") - 1, F.col("end") - 1)).alias("i"))
    return score_frames(never_broadcast(wanted).join(rows, [key, "i"]), [key], dt)


def score_frames(met: DataFrame, by: list[str], dt: float) -> DataFrame:
    """As :func:`score_outages`, from a row ``by, start, end, i`` for each outage and each frame of it and the one before."""
    error = F.hypot(F.col("est_e") - F.col("e"), F.col("est_n") - F.col("n"))
    met = met.withColumns({"err": error, "dr": F.col("mode").isin(DEAD_RECKONING, REACQUISITION)})
    inside = F.col("i") >= F.col("start")
    scored = met.groupBy(*by, "start", "end").agg(
        F.sum(F.when(inside, F.col("speed") * dt)).alias("distance_m"),
        F.max(F.when(F.col("i") == F.col("end") - 1, F.col("err"))).alias("err_end_m"),
        F.max(F.when(F.col("i") == F.col("start") - 1, F.col("err"))).alias("err_start_m"),
        F.max(F.when(inside, F.nanvl("err", F.lit(None)))).alias("err_max_m"),
        F.avg(F.when(inside, F.col("dr").cast("double"))).alias("dr_fraction"),
        F.bool_and(F.when(inside, F.col("valid"))).alias("valid"),
        F.min(F.when(inside & F.col("dr"), F.col("i"))).alias("_first"),
    )
    seconds = (F.col("end") - F.col("start")) * dt
    return scored.select(
        *by, "start", "end", seconds.alias("duration_s"), "distance_m", (F.col("distance_m") / seconds).alias("mean_speed_mps"), "valid",
        "err_start_m", "err_end_m", "err_max_m", F.when(F.col("distance_m") > 0, 100 * F.col("err_end_m") / F.col("distance_m")).alias("drift_pct"),
        "dr_fraction", ((F.col("_first") - F.col("start")) * dt).alias("switch_latency_s"),
    )


def live_log(frames: DataFrame, key: str, index: str, dt: float, every: int = 10, least_m: float = 20.0) -> DataFrame:
    """``key, start, end, duration_s, distance_m, err_m, drift_pct`` of each outage that came to its end.

    Frames are numbered and have ``blocked`` (reception is shut off), the estimate ``est_e, est_n`` (null before the
    first one) and the truth ``e, n``, which may be null. An outage opens at the first blocked frame with an estimate
    and closes at the next free one. Its distance is summed between the opening and every ``every``-th frame whose
    truth is known; at ``least_m`` or less it is not logged, nor where estimate or truth lack at its close.
    """
    own = Window.partitionBy(key).orderBy(index)
    blocked = F.coalesce(F.col("blocked"), F.lit(False))
    free_before = F.coalesce(F.sum(F.when(blocked, 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = frames.select(key, F.col(index).cast("long").alias("i"), blocked.alias("shut"), "e", "n", "est_e", "est_n", free_before.alias("run"))
    of_run = Window.partitionBy(key, "run")
    start = F.min(F.when(F.col("shut") & F.col("est_e").isNotNull() & F.col("est_n").isNotNull(), F.col("i"))).over(of_run)
    close = F.max(F.when(~F.col("shut"), F.col("i"))).over(of_run)
    rows = rows.withColumns({"start": start, "end": close}).where("start IS NOT NULL AND end IS NOT NULL AND i >= start")
    ticks = ((F.col("i") == F.col("start")) | (F.col("i") % every == 0)) & F.col("e").isNotNull() & F.col("n").isNotNull()
    seen = F.when(ticks, F.struct("e", "n"))
    before = F.last(seen, ignorenulls=True).over(of_run.orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"seen": seen, "before": before})
    step = F.hypot(F.col("seen.e") - F.col("before.e"), F.col("seen.n") - F.col("before.n"))
    closing = F.col("i") == F.col("end")
    told = rows.groupBy(key, "start", "end").agg(
        F.coalesce(F.sum(step), F.lit(0.0)).alias("distance_m"),
        F.max(F.when(closing, F.hypot(F.col("est_e") - F.col("e"), F.col("est_n") - F.col("n")))).alias("err_m"),
    ).where((F.col("distance_m") > least_m) & F.col("err_m").isNotNull())
    return told.select(key, "start", "end", ((F.col("end") - F.col("start")) * dt).alias("duration_s"), "distance_m", "err_m", (100 * F.col("err_m") / F.col("distance_m")).alias("drift_pct"))


def scored_only(outages: DataFrame, least_speed: float = LEAST_SPEED) -> DataFrame:
    return outages.where(F.col("valid") & (F.col("mean_speed_mps") >= least_speed))


def summarise(outages: DataFrame, by: list[str]) -> DataFrame:
    """Exact medians, means and 90th percentiles of scored outages and the share that passes."""
    exact = lambda c, q: F.percentile(c, q)
    return outages.groupBy(*by).agg(
        F.count("*").alias("n"),
        exact("drift_pct", 0.5).alias("drift_pct_median"), F.avg("drift_pct").alias("drift_pct_mean"), exact("drift_pct", 0.9).alias("drift_pct_p90"),
        F.avg((F.col("drift_pct") < PASS_PERCENT).cast("double")).alias("pass_rate_10pct"),
        exact("err_end_m", 0.5).alias("err_end_m_median"), exact("err_end_m", 0.9).alias("err_end_m_p90"),
        exact("distance_m", 0.5).alias("distance_m_median"), exact("switch_latency_s", 0.5).alias("switch_latency_s_median"),
    )


def longest(outages: DataFrame, key: str, n: int = 6) -> DataFrame:
    """The ``n`` valid outages of greatest distance; ties by key and start."""
    return outages.where("valid").orderBy(F.desc("distance_m"), key, "start").limit(n)


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key."""
    return old.join(new.select(*on).distinct(), on, "left_anti").unionByName(new)


def latest_by(df: DataFrame, on: list[str], order: Column) -> DataFrame:
    """Of rows with one key the last in ``order``."""
    nth = F.row_number().over(Window.partitionBy(*on).orderBy(order.desc()))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def error_metrics(df: DataFrame, predicted: str, actual: str, bands: list[tuple[float, float]]) -> DataFrame:
    """n, MAE, RMSE, bias, MAE in half-open bands of the actual value (null if empty), deviation of errors, and the
    MAE of predicting the mean."""
    e = F.col(predicted) - F.col(actual)
    mean = df.agg(F.avg(actual).alias("_mean"))
    parts = [F.avg(F.when((F.col(actual) >= lo) & (F.col(actual) < hi), F.abs(e))).alias(f"mae_{lo:g}_{hi:g}") for lo, hi in bands]
    return df.crossJoin(F.broadcast(mean)).agg(  # one row
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), *parts,
        F.stddev_pop(e).alias("err_std"), F.avg(F.abs(F.col(actual) - F.col("_mean"))).alias("mae_of_mean"),
    )


def model_record(df: DataFrame, by: list[str], bands: list[tuple[float, float]], standing_below: float = 0.3) -> DataFrame:
    """What a speed model is worth, a row for each group ``by``, such as a split.

    Rows have ``predicted, variance, p_stationary, actual, has_reference``. Beside :func:`error_metrics` the record has
    ``stationary_f1``, ``z_std``, the deviation of errors in units of the predicted one, and the MAE with and without a
    reference speed. Rows without a prediction or truth do not count; a variance that is not positive has no part in
    ``z_std``. Values of no rows are null.
    """
    rows = df.where(F.col("predicted").isNotNull() & F.col("actual").isNotNull())
    e, actual = F.col("predicted") - F.col("actual"), F.col("actual")
    # a row for each group, so that rows are not sorted by group
    means = rows.groupBy(*by).agg(F.avg("actual").alias("_mean"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    rows = rows.join(means.withColumnsRenamed({c: f"_{c}" for c in by}), same)
    parts = [F.avg(F.when((actual >= lo) & (actual < hi), F.abs(e))).alias(f"mae_{lo:g}_{hi:g}") for lo, hi in bands]
    has = F.coalesce("has_reference", F.lit(False))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), *parts,
        f1(F.coalesce(F.col("p_stationary") > 0.5, F.lit(False)), actual < standing_below).alias("stationary_f1"),
        F.stddev_pop(F.when(F.col("variance") > 0, e / F.sqrt("variance"))).alias("z_std"),
        F.avg(F.abs(actual - F.col("_mean"))).alias("mae_of_mean"),
        F.avg(F.when(has, F.abs(e))).alias("mae_with_reference"), F.avg(F.when(~has, F.abs(e))).alias("mae_without_reference"),
    )


def f1(predicted: Column, actual: Column) -> Column:
    """F1 of two boolean columns as an aggregate; null without positives."""
    both = F.sum((predicted & actual).cast("long"))
    return 2 * both / F.nullif(F.sum(predicted.cast("long")) + F.sum(actual.cast("long")), F.lit(0))


def outage_grid(frames: DataFrame, key: str, index: str, window: int, length: int, spacing: int, least_speed: float = LEAST_SPEED) -> DataFrame:
    """``key, start, end`` of outages of ``length`` frames that start every ``spacing`` frames from ``window`` on.

    All frames of an outage and the ``window`` frames before it are valid, and the mean speed is at least
    ``least_speed``. Frames have ``speed`` and ``valid`` and are numbered from 0.
    """
    last = F.max(index) + 1 - length - 1
    starts = frames.groupBy(key).agg(last.alias("last")).where(F.col("last") >= window)
    starts = starts.select(key, F.explode(F.sequence(F.lit(window).cast("long"), F.col("last").cast("long"), F.lit(spacing).cast("long"))).alias("start"))
    unrolled = starts.select(key, "start", F.explode(F.sequence(F.col("start") - window, F.col("start") + length - 1)).alias("i"))
    met = never_broadcast(unrolled).join(frames.select(key, F.col(index).alias("i"), "speed", "valid"), [key, "i"])
    told = met.groupBy(key, "start").agg(F.bool_and("valid").alias("valid"), F.count("*").alias("n"), F.avg(F.when(F.col("i") >= F.col("start"), F.col("speed"))).alias("mean"))
    return told.where(F.col("valid") & (F.col("n") == window + length) & (F.col("mean") >= least_speed)).select(key, "start", (F.col("start") + length).alias("end"))


def hold_last_errors(frames: DataFrame, outages: DataFrame, key: str, index: str, dt: float) -> DataFrame:
    """Distance error in percent of holding the speed of an outage's first frame all through it."""
    wanted = outages.select(key, "start", "end", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("i"))
    met = never_broadcast(wanted).join(frames.select(key, F.col(index).alias("i"), "speed"), [key, "i"])
    out = met.groupBy(key, "start", "end").agg(F.sum("speed").alias("sum"), F.max(F.when(F.col("i") == F.col("start"), F.col("speed"))).alias("held"))
    n = F.col("end") - F.col("start")
    return out.select(
        key, "start", "end", (F.col("sum") * dt).alias("distance_m"), (F.col("held") * n * dt).alias("held_m"),
        F.when(F.col("sum") > 0, 100 * F.abs(F.col("held") * n - F.col("sum")) / F.col("sum")).alias("error_pct"),
    )


def robustness(runs: DataFrame, by: list[str], cluster: str, seed: str, value: str, replicates: int = 2000, draws=None, **options) -> DataFrame:
    """Median, pass share and 90th percentile of ``value`` in each group, with bootstrap intervals over clusters.

    A cluster is an outage; the same outage under several seeds is resampled as a whole. ``draws`` are random with a
    fixed seed by default, see :mod:`.bootstrap`, which takes ``options`` too. Rows without a value do not count; a
    group without rows is not in the result.
    """
    g = F.to_json(F.struct(*by))
    runs = runs.where(F.col(value).isNotNull())
    reps = bootstrap.replicates_of(runs.select(g.alias("g"), F.col(cluster).alias("cluster"), F.col(value).alias("value")), PASS_PERCENT, replicates, draws, **options)
    # a row for each replicate
    ends = reps.groupBy("g").agg(*[F.percentile(c, q).alias(f"{name}_{end}") for c, name in (("median", "median"), ("share", "pass_rate")) for q, end in ((0.025, "low"), (0.975, "high"))])
    pooled = runs.groupBy(*by).agg(
        F.count("*").alias("n_observations"), F.countDistinct(seed).alias("seeds"), F.countDistinct(cluster).alias("n_outages"), F.avg((F.col(value) < PASS_PERCENT).cast("double")).alias("pass_rate")
    )
    exact = quantiles.exact_percentiles(runs, by, value, {"median": 0.5, "p90": 0.9})
    out = pooled.withColumn("g", g).join(ends, "g").join(exact.withColumn("g", g).drop(*by), "g")
    out = out.select(*by, "n_observations", "seeds", "n_outages", "median", "pass_rate", "p90", "median_low", "median_high", "pass_rate_low", "pass_rate_high")
    out = shared_table(runs.sparkSession, out, "robustness")  # a row for each group
    for t in (reps, exact):
        drop_table(t)
    return out


def robustness_of_reports(reports: DataFrame, replicates: int = 2000, draws=None, **options) -> DataFrame:
    """The robustness record of each trip, scenario and configuration over the reports ``run, report`` of several runs.

    Outages that are valid and fast enough count. A run that lacks a trip, a scenario, a configuration or an outage
    adds nothing there; outages are the same if they start at the same frame.
    """
    rows = scored_only(report_rows(reports, keep=("run",)))
    return robustness(rows, ["trip", "scenario", "config"], "start", "run", "drift_pct", replicates, draws, **options)


def mode_shares(frames: DataFrame) -> DataFrame:
    total = frames.agg(F.count("*").alias("all"))
    return frames.groupBy("mode").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("mode", "n", (F.col("n") / F.col("all")).alias("share"))


def latency_statistics(df: DataFrame, ms: str, rate_hz: float) -> DataFrame:
    """Mean and exact 99th percentile of a whole table, frames a second and the multiple of real time at ``rate_hz``."""
    p99 = quantiles.exact_percentiles(df, [], ms, {"p99_ms": 0.99})
    # one row each
    return df.agg(F.avg(ms).alias("mean_ms")).crossJoin(F.broadcast(p99)).select("mean_ms", "p99_ms", (1000 / F.col("mean_ms")).alias("frames_per_s"), (1000 / rate_hz / F.col("mean_ms")).alias("realtime_factor"))
