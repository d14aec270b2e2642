"""Validity of aligned frames: islands, windows, block agreement, statistics and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans

def islands(df: DataFrame, key: str, index: str, valid: str, out: str = "run_start", width: float | None = None) -> DataFrame:
    """First index of the run of valid rows that a row is in; -1 for invalid rows.

    With ``width``, a key's rows are cut into stretches of that length, and a run that goes over their borders is one.
    """
    if width is not None:
        cut = scans.Stretches(df, key, index, width).previous({"_valid": F.col(valid)})
        begins = F.when(F.col(valid) & ~F.coalesce("_valid", F.lit(False)), F.col(index))
        cut = cut.latest(begins, "_start").done()
        return cut.withColumn(out, F.when(F.col(valid), F.col("_start")).otherwise(F.lit(-1).cast("long"))).drop("_valid", "_start")
    w = Window.partitionBy(key).orderBy(index)
    broken = F.sum(F.when(F.col(valid), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_island", broken)
    start = F.min(F.when(F.col(valid), F.col(index))).over(Window.partitionBy(key, "_island"))
    return df.withColumn(out, F.when(F.col(valid), start).otherwise(F.lit(-1).cast("long"))).drop("_island")


def sliding_windows(df: DataFrame, key: str, index: str, value: Column, length: int, step: int, run_start: str = "run_start") -> DataFrame:
    """Windows of ``length`` rows that end at every ``step``-th index and lie within one valid run: ``key, end, window``."""
    w = Window.partitionBy(key).orderBy(index).rowsBetween(-(length - 1), 0)
    ends = df.withColumn("window", F.collect_list(value).over(w)).withColumn("end", F.col(index) + 1)
    whole = (F.size("window") == length) & (F.col(run_start) >= 0) & (F.col("end") - length >= F.col(run_start))
    return ends.where(whole & (F.pmod(F.col("end") - length, F.lit(step)) == 0)).select(key, "end", "window")


def reference_lookback(df: DataFrame, key: str, index: str, value: str, back: int, run_start: str = "run_start", out: str = "reference") -> DataFrame:
    """The value ``back`` rows before, not beyond the start of the run."""
    at = F.greatest(F.col(index) - back, F.col(run_start))
    source = df.select(F.col(key).alias("_k"), F.col(index).alias("_i"), F.col(value).alias(out))
    return df.withColumn("_at", at).join(source, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_i")), "left").drop("_k", "_i", "_at")


def block_agreement(df: DataFrame, key: str, index: str, a: str, b: str, use: Column, block: int, least: int, least_std: float) -> DataFrame:
    """``key, block, n, r`` of blocks with more than ``least`` used rows and enough spread of ``b``; r null elsewhere."""
    x, y = F.when(use, F.col(a)), F.when(use, F.col(b))
    g = df.groupBy(key, F.floor(F.col(index) / block).alias("block")).agg(
        F.count(F.when(use, 1)).alias("n"),
        F.avg(x).alias("ea"), F.avg(y).alias("eb"), F.avg(x * y).alias("eab"), F.stddev_pop(x).alias("sa"), F.stddev_pop(y).alias("sb"),
    )
    r = (F.col("eab") - F.col("ea") * F.col("eb")) / F.nullif(F.col("sa") * F.col("sb"), F.lit(0.0))
    return g.select(key, "block", "n", F.when((F.col("n") > least) & (F.col("sb") > least_std), r).alias("r"))


def mark_blocks(df: DataFrame, blocks: DataFrame, key: str, index: str, valid: str, block: int, least_r: float) -> DataFrame:
    """``valid`` less all rows of blocks whose correlation is under ``least_r``."""
    bad = blocks.where(F.col("r") < least_r).select(key, F.col("block").alias("_b"), F.lit(True).alias("_bad"))
    df = df.withColumn("_b", F.floor(F.col(index) / block)).join(bad, [key, "_b"], "left")
    return df.withColumn(valid, F.col(valid) & F.col("_bad").isNull()).drop("_b", "_bad")


def channel_statistics(df: DataFrame, channels: list[str], least_std: float = 1e-6) -> DataFrame:
    """``channel, mean, std`` over all rows; population deviations, not under ``least_std``."""
    row = df.agg(*[F.struct(F.lit(c).alias("channel"), F.avg(c).alias("mean"), F.greatest(F.stddev_pop(c), F.lit(least_std)).alias("std")).alias(c) for c in channels])
    return row.select(F.explode(F.array(*channels)).alias("x")).select("x.*")


def trip_metadata(df: DataFrame, key: str, time: str, speed: str, valid: str, step: float) -> DataFrame:
    """Samples, minutes, valid share and valid distance of each trip."""
    return df.groupBy(key).agg(
        F.count("*").alias("samples"),
        ((F.max(time) - F.min(time)) / 60).alias("duration_min"),
        (100 * F.avg(F.col(valid).cast("double"))).alias("valid_pct"),
        (F.sum(F.when(F.col(valid), F.col(speed)).otherwise(0.0)) * step / 1000).alias("distance_km"),
    )


def block_means(df: DataFrame, key: str, time: str, values: list[str], period: float) -> DataFrame:
    """Means of the values in bins of ``period``, with the bin's end; bins without rows do not appear."""
    bins = F.floor(F.col(time) / period)
    return df.groupBy(key, bins.alias("bin")).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n")).withColumn("t_end", (F.col("bin") + 1) * period)
