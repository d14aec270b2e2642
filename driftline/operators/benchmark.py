"""The drive benchmark: frames are replayed without fixes inside planned outages, estimated, scored and summed up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_table
from . import keyed, outages


def replays(frames: DataFrame, planned: DataFrame, key: str, index: str = "idx") -> DataFrame:
    """The frames of each key once for each scenario that has an outage there, with ``scenario, run, in_outage``.

    ``planned`` has ``key, scenario, start, end``; ``run`` stands for scenario and key together, so that scenarios are
    estimated side by side. Inside the outages of its scenario a frame's ``fix`` is null.
    """
    run = F.to_json(F.struct("scenario", key))
    wanted = planned.select(key, "scenario").distinct().withColumn("run", run)
    marked = outages.masked(frames.join(outages.never_broadcast(wanted), key), planned.select(run.alias("run"), "start", "end"), "run", index)
    return marked.withColumn("fix", F.when(~F.col("in_outage"), F.col("fix")))


def estimated(frames: DataFrame, planned: DataFrame, key: str, index: str = "idx", **options) -> DataFrame:
    """Replayed frames with ``est_e, est_n, mode``; before the first fix of a replay there is no estimate.

    Frames have ``t``, unique in a key, sensor columns and ``fix`` with ``e, n``; ``options`` are those of
    :func:`.keyed.navigate`. The replays are a table of their own, as estimates are joined to them again.
    """
    rows = shared_table(frames.sparkSession, replays(frames, planned, key, index), "replays")
    states = keyed.navigate(rows, "run", **options).select("run", "t", F.col("east").alias("est_e"), F.col("north").alias("est_n"), "mode")
    started = F.min(F.when(F.col("fix").isNotNull(), F.col("t"))).over(Window.partitionBy("run"))
    known = F.col("t") >= F.col("started")
    out = outages.never_broadcast(rows.withColumn("started", started)).join(states, ["run", "t"])
    return out.withColumns({c: F.when(known, F.col(c)) for c in ("est_e", "est_n")}).drop("started")


def benchmark(frames: DataFrame, planned: DataFrame, key: str, dt: float, index: str = "idx", order: list[str] | None = None, frames_of: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """``scenario, key`` and the score columns of :func:`.outages.score_outages` for each planned outage.

    Frames have ``t``, unique in a key, sensor columns, ``fix`` with ``e, n``, the truth ``e, n, speed`` and ``valid``;
    ``options`` are those of :func:`.keyed.navigate`. An outage that reaches beyond the frames is scored by those that
    there are, and has no end error. Frames are replayed in the task that estimates them, and may be made there, too, of
    rows in ``order`` by ``frames_of``, see :func:`.keyed.replayed`; so they are neither shuffled nor stored.
    """
    met = keyed.replayed(frames, planned, key, index, order or ["t"], frames_of, **options)
    return outages.score_frames(met, ["scenario", key], dt)


def record(scores: DataFrame, by: list[str], outage: Column, replicates: int = 2000, draws=None, **options) -> DataFrame:
    """The summary of scored outages by group, with bootstrap intervals over outages, which ``outage`` tells apart.

    A group in which no outage is scored is not in the result.
    """
    # read by the summary and several times by the bootstrap
    kept = shared_table(scores.sparkSession, outages.scored_only(scores).withColumn("outage_", outage).withColumn("seed_", F.lit(0)), "scored")
    ends = outages.robustness(kept, by, "outage_", "seed_", "drift_pct", replicates, draws, **options)
    return outages.summarise(kept, by).join(ends.select(*by, "n_outages", "median_low", "median_high", "pass_rate_low", "pass_rate_high"), by)
