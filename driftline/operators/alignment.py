"""Aligning sensor logs: time filters, grids, as-of and interpolation joins, gaps, shifts and lag correlation.

Every function takes column names, so that one operator serves any keyed series ``(key, time, values...)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import motion
from . import scans


def monotonic_filter(df: DataFrame, key: str, order: str, time: str) -> DataFrame:
    """Rows whose time is later than that of the row before in file order; the first row of a key stays."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(time) > F.col("_before"))).drop("_before")


def common_grid(bounds: DataFrame, key: str, low: str, high: str, step: float, time: str = "t") -> DataFrame:
    """Times of a grid of ``step`` from the first multiple at or after ``low``, before ``high``."""
    first = F.ceil(F.col(low) / step).cast("long")
    last = F.ceil(F.col(high) / step).cast("long") - 1
    grid = bounds.where(first <= last).select(key, F.explode(F.sequence(first, last)).alias("_i"))
    return grid.select(key, F.col("_i").alias("idx"), (F.col("_i") * step).alias(time))


def series_overlap(left: DataFrame, right: DataFrame, key: str, time: str) -> DataFrame:
    """``key, low, high`` of the time that both logs of a key cover."""
    def span(d: DataFrame, s: str) -> DataFrame:
        return d.groupBy(key).agg(F.min(time).alias(f"low{s}"), F.max(time).alias(f"high{s}"))

    both = span(left, "1").join(span(right, "2"), key)
    return both.select(key, F.greatest("low1", "low2").alias("low"), F.least("high1", "high2").alias("high"))


def _latest(rows: DataFrame, key: str, time: str, side: Column, found: str, bucket: float | None, forward: bool, last: bool = False) -> DataFrame:
    """Adds to each row the nearest earlier (or later) non-null ``side`` of its key, the row's own included.

    With ``bucket``, windows are cut into stretches of that length, so that a key with a large share of the rows is
    spread over many tasks; what stands before a stretch comes from one row for each stretch.
    """
    rank = F.col("_rank") if forward else -F.col("_rank")
    time_order = F.col(time) if forward else F.col(time).desc()
    if bucket is None:
        tie = F.col("_sample._tie") if forward or last else F.col("_sample._tie").desc()
        w = Window.partitionBy(key).orderBy(time_order, rank, tie).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(found, F.last(side, ignorenulls=True).over(w))
    rows = rows.withColumn("_bucket", F.floor(F.col(time) / bucket))
    w = Window.partitionBy(key, "_bucket").orderBy(time_order, rank).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_near", F.last(side, ignorenulls=True).over(w))
    pick = (F.max_by if forward else F.min_by)(side, F.when(side.isNotNull(), F.col(time)))
    ends = rows.groupBy(key, "_bucket").agg(pick.alias("_end"))
    b = F.col("_bucket") if forward else F.col("_bucket").desc()
    earlier = Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    return rows.join(carried, [key, "_bucket"], "left").withColumn(found, F.coalesce("_near", "_carried")).drop("_bucket", "_near", "_carried")


def _union(probes: DataFrame, samples: DataFrame, key: str, time: str, values: list[str], ties: str | None = None) -> DataFrame:
    extra = [c for c in probes.columns if c not in (key, time)]
    sample = F.struct(F.col(time).alias("at"), *[F.col(v) for v in values], (F.col(ties) if ties else F.lit(0)).alias("_tie"))
    left = probes.select(key, time, F.struct(*extra).alias("_probe") if extra else F.struct(F.lit(1).alias("_one")).alias("_probe"), F.lit(1).alias("_rank"))
    right = samples.select(key, time, sample.alias("_sample"), F.lit(0).alias("_rank"))
    return left.unionByName(right, allowMissingColumns=True)


def asof_backward(probes: DataFrame, samples: DataFrame, key: str, time: str, values: list[str], prefix: str = "", bucket: float | None = None, ties: str | None = None) -> DataFrame:
    """Each probe with the ``values`` of its key's last sample at or before its time, and that time as ``at``; else null.

    Samples of one key and time should be unique, or, without ``bucket``, in the order of ``ties``. Probes and samples meet in one shuffle by key, without a join.
    """
    extra = [c for c in probes.columns if c not in (key, time)]
    rows = _latest(_union(probes, samples, key, time, values, ties), key, time, F.col("_sample"), "_found", bucket, True)
    rows = rows.where(F.col("_rank") == 1)
    return rows.select(key, time, *[F.col(f"_probe.{c}").alias(c) for c in extra], F.col("_found.at").alias(f"{prefix}at"), *[F.col(f"_found.{v}").alias(prefix + v) for v in values])


def asof_forward(probes: DataFrame, samples: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """Each probe with the ``values`` of its key's first sample at or after its time, and that time as ``at``; else null.

    Samples of one key and time should be unique. Probes and samples meet in one shuffle by key, without a join.
    """
    extra = [c for c in probes.columns if c not in (key, time)]
    # negated, so that a sample at the probe's own time comes before it
    rows = _union(probes, samples, key, time, values).withColumn("_rank", -F.col("_rank"))
    rows = _latest(rows, key, time, F.col("_sample"), "_found", None, False).where(F.col("_rank") == -1)
    return rows.select(key, time, *[F.col(f"_probe.{c}").alias(c) for c in extra], F.col("_found.at").alias("at"), *[F.col(f"_found.{v}").alias(v) for v in values])


def interpolate(probes: DataFrame, samples: DataFrame, key: str, time: str, values: list[str], bucket: float | None = None, ties: str | None = None, last: bool = False) -> DataFrame:
    """Each probe with ``values`` interpolated linearly between its neighbouring samples; outside them the nearest one.

    Samples of one key and time are in the order of ``ties``: the first counts before them, the last from there on; with
    ``last`` the last one on both sides.
    ``ties`` is not for use with ``bucket``.
    """
    extra = [c for c in probes.columns if c not in (key, time)]
    rows = _union(probes, samples, key, time, values, ties)
    rows = _latest(rows, key, time, F.col("_sample"), "_low", bucket, True)
    # a sample at the probe's own time is found by both passes
    rows = rows.withColumn("_rank", -F.col("_rank"))
    rows = _latest(rows, key, time, F.col("_sample"), "_high", bucket, False, last).where(F.col("_rank") == -1)
    low, high = F.coalesce("_low", "_high"), F.coalesce("_high", "_low")
    width = high["at"] - low["at"]
    part = F.when(width > 0, (F.col(time) - low["at"]) / width).otherwise(F.lit(0.0))
    return rows.select(key, time, *[F.col(f"_probe.{c}").alias(c) for c in extra], *[(low[v] + (high[v] - low[v]) * part).alias(v) for v in values])


def gap_free(probes: DataFrame, samples: DataFrame, key: str, time: str, limit: float) -> DataFrame:
    """Probes with ``ok``: whether the interval of samples around them is no longer than ``limit``.

    Before the first sample and from the last one on, the first and the last interval count. Of samples of one time the
    interval of the last one is that up to the next time.
    """
    w = Window.partitionBy(key).orderBy(time)
    step = F.coalesce(F.lead(time).over(w) - F.col(time), F.col(time) - F.lag(time).over(w))
    marked = samples.select(key, time, step.alias("step"), F.row_number().over(w).alias("_nth"))
    found = asof_backward(probes, marked, key, time, ["step"], ties="_nth").drop("at")
    first = marked.groupBy(key).agg(F.min_by("step", "_nth").alias("_first"))
    return found.join(first, key, "left").withColumn("ok", F.coalesce(F.coalesce("step", "_first") <= limit, F.lit(False))).drop("step", "_first")


def change_ids(df: DataFrame, key: str, order: str, watched: list[str], width: float | None = None) -> DataFrame:
    """``is_new``: whether a watched value differs from the row before (NaN always does), ``change_id``: their running count.

    With ``width``, a key's rows are cut into stretches of that length, see :mod:`.scans`.
    """
    kinds = dict(df.dtypes)
    if width is None:
        w = Window.partitionBy(key).orderBy(order)
        first, before = F.row_number().over(w) == 1, {c: F.lag(c).over(w) for c in watched}
    else:
        names = {c: f"_was_{k}" for k, c in enumerate(watched)}
        df = scans.Stretches(df, key, order, width).previous({**{names[c]: F.col(c) for c in watched}, "_was": F.lit(True)}).done()
        first, before = F.col("_was").isNull(), {c: F.col(n) for c, n in names.items()}
    changed = first
    for c in watched:
        changed = changed | ~F.col(c).eqNullSafe(before[c])
        if kinds[c] in ("double", "float"):
            changed = changed | F.isnan(c)
    df = df.withColumn("is_new", F.coalesce(changed, F.lit(True)))
    if width is None:
        return df.withColumn("change_id", F.sum(F.col("is_new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.drop("_was", *names.values())
    return scans.Stretches(df, key, order, width).running_sum(F.col("is_new").cast("long"), "change_id").done()


def unwrapped(df: DataFrame, key: str, order: str, angle: str, period: float = 360.0, out: str = "unwrapped", width: float | None = None) -> DataFrame:
    """The angle with turns of ``period`` added so that no step exceeds half of it; with ``width`` in stretches."""
    turns = lambda before: F.coalesce(-F.floor((F.col(angle) - before + period / 2) / period), F.lit(0))
    if width is None:
        w = Window.partitionBy(key).orderBy(order)
        df = df.withColumn("_turn", turns(F.lag(angle).over(w)))
        return df.withColumn(out, F.col(angle) + period * F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")
    cut = scans.Stretches(df, key, order, width).previous({"_angle": F.col(angle)}).running_sum(turns(F.col("_angle")), "_turns")
    return cut.done().withColumn(out, F.col(angle) + period * F.col("_turns")).drop("_angle", "_turns")


def forward_fill(df: DataFrame, key: str, order: str, column: str, initial: float, out: str, width: float | None = None) -> DataFrame:
    """The last non-null value so far, ``initial`` before the first; with ``width`` in stretches."""
    if width is not None:
        return scans.Stretches(df, key, order, width).latest(F.col(column), out).done().withColumn(out, F.coalesce(out, F.lit(initial)))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce(F.last(column, ignorenulls=True).over(w), F.lit(initial)))


def gravity_directions(df: DataFrame, key: str, order: str, alpha: float = 0.01, width: float = 1e6, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``down_x, down_y, down_z``, the direction of gravity, from accelerations ``ax, ay, az`` and turn rates ``gx, gy, gz``.

    It starts with a key's first sample whose size is within a fifth of one g, and is then moved by ``alpha`` towards
    each one within a tenth while the device hardly turns; before the start it is straight up. A sample with a null
    changes nothing.
    """
    acc, turn = ["ax", "ay", "az"], ["gx", "gy", "gz"]
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in acc), F.lit(0.0))) / motion.G
    still = F.sqrt(sum((F.col(c) * F.col(c) for c in turn), F.lit(0.0))) < 0.2
    fits = F.coalesce((size > 0.8) & (size < 1.2), F.lit(False))
    moves = F.coalesce((size > 0.9) & (size < 1.1) & still, F.lit(False))
    cut = scans.Stretches(df, key, order, width, ties).running_sum(fits.cast("long"), "_fitting")
    begins = fits & (F.col("_fitting") == 1)
    moves = moves & (F.col("_fitting") > 0)
    factor = F.when(begins, 0.0).when(moves, 1 - alpha).otherwise(1.0)
    cut = cut.affine(factor, {f"_g{c}": F.when(begins, F.col(c)).when(moves, alpha * F.col(c)).otherwise(0.0) for c in acc}, 1 - alpha)
    g = [F.col(f"_g{c}") for c in acc]
    length = F.sqrt(sum((c * c for c in g), F.lit(0.0)))
    known = F.col("_fitting") > 0
    down = {f"down_{n}": F.when(known, c / length).otherwise(float(n == "z")) for n, c in zip("xyz", g, strict=True)}
    return cut.done().withColumns(down).drop("_fitting", *[f"_g{c}" for c in acc])


def clamped_shift(df: DataFrame, key: str, index: str, column: str, lag: int, out: str) -> DataFrame:
    """The column's value ``lag`` rows before, at the start that of the first row."""
    w = Window.partitionBy(key).orderBy(index)
    return df.withColumn(out, F.coalesce(F.lag(column, lag).over(w), F.first(column).over(w.rowsBetween(Window.unboundedPreceding, 0))))


def lag_correlation(df: DataFrame, index: str, a: str, b: str, max_lag: int) -> DataFrame:
    """``lag, r`` for every lag: mean product of the z-scored series where ``b`` is read ``lag`` steps later."""
    stats = df.agg(*[f(c).alias(f"_{n}{c}") for c in (a, b) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = df.crossJoin(F.broadcast(stats)).select(  # one row of statistics
        F.col(index).alias("i"), *[((F.col(c) - F.col(f"_m{c}")) / (F.col(f"_s{c}") + 1e-9)).alias(n) for c, n in ((a, "za"), (b, "zb"))]
    )
    probes = z.select("i", "za", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")).withColumn("j", F.col("i") + F.col("lag"))
    met = probes.join(z.select(F.col("i").alias("j"), "zb"), "j")
    return met.groupBy("lag").agg(F.avg(F.col("za") * F.col("zb")).alias("r"))


def best_lag_by_key(df: DataFrame, key: str, index: str, a: str, b: str, max_lag: int) -> DataFrame:
    """``key, lag, r``: as :func:`lag_correlation` and :func:`best_lag` for each key's own series, in one shuffle."""
    own, w = Window.partitionBy(key), Window.partitionBy(key).orderBy(index)
    z = df.select(key, index, *[((F.col(c) - F.avg(c).over(own)) / (F.stddev_pop(c).over(own) + 1e-9)).alias(n) for c, n in ((a, "za"), (b, "zb"))])
    lags = range(-max_lag, max_lag + 1)
    products = z.select(key, *[(F.col("za") * F.lead("zb", k).over(w)).alias(f"p{k}") for k in lags])
    means = products.groupBy(key).agg(*[F.avg(f"p{k}").alias(f"p{k}") for k in lags])
    best = F.array_max(F.array(*[F.struct(F.col(f"p{k}").alias("r"), F.lit(-k).alias("minus")) for k in lags]))
    return means.select(key, (-best["minus"]).alias("lag"), best["r"].alias("r"))


def best_lag(correlations: DataFrame) -> DataFrame:
    """The lag of the greatest correlation, the least such lag."""
    return correlations.agg(F.max(F.struct("r", (-F.col("lag")).alias("minus"))).alias("x")).select((-F.col("x.minus")).alias("lag"), F.col("x.r").alias("r"))


def guarded_corr(a: Column, b: Column, least: int) -> Column:
    """Pearson correlation, zero for up to ``least`` pairs or a constant column."""
    fits = (F.count(F.when(a.isNotNull() & b.isNotNull(), 1)) > least) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    ea, eb, eab = F.avg(a), F.avg(b), F.avg(a * b)
    return F.when(fits, (eab - ea * eb) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))).otherwise(F.lit(0.0))


def pick_axis(df: DataFrame, key: str, axes: list[str], target: str, least: int) -> DataFrame:
    """The axis of greatest absolute correlation with the target, its correlation, and all of them as a map."""
    each = df.groupBy(key).agg(*[guarded_corr(F.col(c), F.col(target), least).alias(c) for c in axes])
    table = F.array(*[F.struct(F.abs(c).alias("size"), F.lit(-i).alias("at"), F.lit(c).alias("axis"), F.col(c).alias("r")) for i, c in enumerate(axes)])
    best = F.array_max(table)
    return each.select(key, best["axis"].alias("axis"), best["r"].alias("r"), *axes)
