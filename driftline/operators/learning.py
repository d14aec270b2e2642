"""Baselines for the speed model on window statistics, reference sampling, and errors of predicted distances."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import uniform
from .keyed import ship_package

#: The estimator's configurations: speed model, map, and whether the true speed takes the model's part.
CONFIGURATIONS = (("ekf_only", False, False, False), ("ekf_ai", True, False, False), ("ekf_ai_map", True, True, False), ("ekf_ai_map_oracle", True, True, True))


def configurations(spark, trips: DataFrame, maps: DataFrame, key: str = "trip") -> DataFrame:
    """Each trip with each configuration that it can run; one that needs a map only where ``maps`` has the trip."""
    table = spark.createDataFrame(CONFIGURATIONS, "config string, use_model boolean, use_map boolean, oracle boolean")
    known = maps.select(key).distinct().withColumn("_map", F.lit(True))
    rows = trips.select(key).distinct().join(known, key, "left").crossJoin(F.broadcast(table))  # four rows
    return rows.where(~F.col("use_map") | F.col("_map")).drop("_map")


STATISTICS = ("mean", "std", "mean_abs_diff", "p05", "p95", "band1", "band2", "band3", "band4")


def _statistics(x: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for each window of one length; a statistic that a length does not have is NaN."""
    n = x.shape[1]
    out = np.full((len(x), len(STATISTICS)), np.nan)
    if n == 0:
        return out
    # summed in the order of the values, by which a mean halfway between two rounded ones goes as in SQL
    out[:, 0], out[:, 1] = np.cumsum(x, axis=1)[:, -1] / n, x.std(1)
    if n > 1:
        out[:, 2] = np.cumsum(np.abs(np.diff(x, axis=1)), axis=1)[:, -1] / (n - 1)
    out[:, 3], out[:, 4] = np.percentile(x, [5, 95], axis=1)
    size = np.abs(np.fft.rfft(x - out[:, :1], axis=1))[:, 1:]
    for k, part in enumerate(np.array_split(np.arange(size.shape[1]), 4)):
        if len(part):
            out[:, 5 + k] = size[:, part].mean(1)
    return out


def window_statistics(windows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``windows`` with, for each array column named in ``columns``, a struct of ``STATISTICS`` under its value there.

    Mean, population deviation, mean absolute difference, 5th and 95th percentile, and the mean size of the Fourier
    components but the constant one in four bands from low to high, by a real transform over all windows of one length
    of a batch at once. A null array, one with a null in it, or an empty one has null statistics, and so has a
    statistic that a window is too short for.
    """
    ship_package(windows.sparkSession)
    own = T.StructType([T.StructField(n, T.DoubleType()) for n in STATISTICS])
    schema = T.StructType([*windows.schema.fields, *[T.StructField(out, own) for out in columns.values()]])
    wide = windows.select("*", *[F.col(c).cast("array<double>").alias(f"_w{k}") for k, c in enumerate(columns)])
    kept = len(windows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for at in range(kept, kept + len(columns)):
                lists = batch.column(at)
                begin = lists.offsets.to_numpy()[:-1]
                size, values = np.diff(lists.offsets.to_numpy()), lists.values
                lost = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
                fits = ~lists.is_null().to_numpy(zero_copy_only=False) & (size > 0) & (lost[begin + size] == lost[begin])
                flat, stats = values.to_numpy(zero_copy_only=False), np.full((batch.num_rows, len(STATISTICS)), np.nan)
                for n in np.unique(size[fits]):
                    rows = np.flatnonzero(fits & (size == n))
                    stats[rows] = _statistics(flat[begin[rows][:, None] + np.arange(n)])
                made.append(pa.StructArray.from_arrays([pa.array(c, pa.float64(), mask=~fits | np.isnan(c)) for c in stats.T], list(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *made], schema.names)

    return wide.mapInArrow(run, schema)


def window_features(windows: DataFrame, channels: int, window: str = "window") -> DataFrame:
    """``features``: nine statistics of each channel of windows of channel arrays, as a vector for ``pyspark.ml``."""
    from pyspark.ml.functions import array_to_vector

    def channel(c: int) -> Column:
        return F.transform(window, lambda row: row[c].cast("double"))

    names = {f"_channel{c}": f"_stats{c}" for c in range(channels)}
    split = windows.withColumns({f"_channel{c}": channel(c) for c in range(channels)})
    told = window_statistics(split, names)
    flat = F.array(*[F.col(f"_stats{c}.{n}") for c in range(channels) for n in STATISTICS])
    return told.withColumn("features", array_to_vector(flat)).drop(*names, *names.values())


def ridge_baseline(train: DataFrame, label: str, strength: float = 1.0):
    """A ridge regression on ``features``; its ``transform`` adds ``predicted``."""
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(featuresCol="features", labelCol=label, predictionCol="predicted", regParam=strength, elasticNetParam=0.0).fit(train)


def boosted_baseline(train: DataFrame, label: str, rounds: int = 50, depth: int = 5, seed: int = 0):
    """Gradient-boosted trees on ``features``."""
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol="features", labelCol=label, predictionCol="predicted", maxIter=rounds, maxDepth=depth, seed=seed).fit(train)


def sampled_reference_age(longest: float, none_share: float, seed: int, *keys: Column | str) -> Column:
    """A random age of the reference in seconds, null for a share of rows that have none; drawn by the row's ``keys``."""
    return F.when(uniform(seed, *keys) >= none_share, uniform(seed, *keys, draw=1) * longest)


def repeat_dropout(df: DataFrame, key: str, order: str, column: str, share: float, seed: int) -> DataFrame:
    """The column with a random share of its values replaced by the one before."""
    before = F.lag(column).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn(column, F.when(uniform(seed, key, order) < share, F.coalesce(before, F.col(column))).otherwise(F.col(column)))


def distance_errors(frames: DataFrame, outages: DataFrame, key: str, index: str, dt: float, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Distance error in percent of integrating predicted speeds over each outage.

    ``predict`` takes the frames inside outages and adds ``predicted``.
    """
    wanted = outages.select(key, "start", "end", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias(index))
    met = predict(wanted.join(frames, [key, index]))
    sums = met.groupBy(key, "start", "end").agg(F.sum("speed").alias("s"), F.sum("predicted").alias("p"))
    return sums.select(key, "start", "end", (F.col("s") * dt).alias("distance_m"), F.when(F.col("s") > 0, 100 * F.abs(F.col("p") - F.col("s")) / F.col("s")).alias("error_pct"))


def split_report(windows: DataFrame, split: str, speed: str, stationary: float = 0.5) -> DataFrame:
    """Windows, mean speed and share of standing ones of each split."""
    return windows.groupBy(split).agg(F.count("*").alias("windows"), F.avg(speed).alias("mean_speed"), (100 * F.avg((F.col(speed) < stationary).cast("double"))).alias("stationary_pct"))


_loaded: dict[str, Callable] = {}


def predict_speeds(windows: DataFrame, load: Callable[[], Callable], x: str = "x", s: str = "s") -> DataFrame:
    """Adds ``predicted, variance, p_stationary`` to windows of normalised channels ``x`` and scaled scalars ``s``.

    ``load()`` gives the model, once for each Python worker: a function of the windows (batch, channels, length) and the
    scalars (batch, scalars), both ``float32``, to speeds, logarithms of variances and logits of standing still. All
    windows have one shape; those where ``x`` or ``s`` is null get nulls. :func:`operators.trips.window_dataset` makes
    such windows.
    """
    from .keyed import ship_package

    ship_package(windows.sparkSession)
    name = uuid.uuid4().hex

    @F.pandas_udf("predicted double, variance double, p_stationary double")
    def predict(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from driftline.operators import learning

        if name not in learning._loaded:
            learning._loaded.clear()
            learning._loaded[name] = load()
        for xs, ss in parts:
            out = pd.DataFrame(np.nan, xs.index, ["predicted", "variance", "p_stationary"], dtype="float64")
            known = xs.notna() & ss.notna()
            if known.any():
                batch = np.stack([np.stack(v).astype(np.float32) for v in xs[known]])
                speed, log_variance, logit = learning._loaded[name](np.ascontiguousarray(batch.transpose(0, 2, 1)), np.stack(ss[known].to_list()).astype(np.float32))
                flat = [np.asarray(v, dtype=float).reshape(-1) for v in (speed, log_variance, logit)]
                out.loc[known] = np.column_stack([flat[0], np.exp(flat[1]), 1 / (1 + np.exp(-flat[2]))])
            yield out.astype(object).where(out.notna(), None)

    made = windows.withColumn("_made", predict(x, s))
    return made.select(*windows.columns, "_made.predicted", "_made.variance", "_made.p_stationary")
