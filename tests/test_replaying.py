"""Findings of round 4, F5 and F6: replays are made in the task that estimates them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline.operators import benchmark, outages, replaying
from driftline.plans import catalogue


def _drives(spark):
    """Drives of several lengths; one has no fix at first, one never, one no outage, one outage has no drive."""
    rows = spark.range(4000).selectExpr("id % 5 AS trip", "id div 5 AS idx").where("idx < 900 - 150 * trip")
    east = F.col("idx") * 1.2
    known = (F.col("idx") % 10 == 0) & (F.col("trip") != 3) & ((F.col("trip") != 2) | (F.col("idx") > 230))
    fix = F.struct(east.alias("e"), (F.col("idx") % 3 - 1.0).alias("n"), F.lit(12.0).alias("speed"), F.lit(90.0).alias("heading"), F.lit(5.0).alias("accuracy"))
    frames = rows.select(
        F.when(F.col("trip") < 5, F.col("trip")).alias("trip"), "idx", (F.col("idx") * 0.1).alias("t"), F.lit(0.1).alias("ax"), F.lit(9.8).alias("az"), (F.col("idx") % 7 * 0.001).alias("gz"),
        F.when(known, fix).alias("fix"), east.alias("e"), F.lit(0.0).alias("n"), F.lit(12.0).alias("speed"), (F.col("idx") % 97 != 0).alias("valid"),
    )
    planned = [(t, s, a, a + n) for t in (0, 1, 2, 3, 9) for s, n, step in (("a", 40, 70), ("b", 120, 90)) for a in range(20, 880 - 150 * min(t, 4), step)]
    return frames, spark.createDataFrame([*planned, planned[0]], "trip long, scenario string, start long, end long")


def _told(df):
    rows = df.orderBy("scenario", "trip", "start").collect()
    return [tuple(r[c] for c in ("scenario", "trip", "start", "end", "valid", "switch_latency_s")) for r in rows], np.array([[np.nan if r[c] is None else r[c] for c in ("distance_m", "err_start_m", "err_end_m", "err_max_m", "drift_pct", "dr_fraction")] for r in rows])


@pytest.mark.parametrize("options", [{"use_model": False}, {"use_model": False, "inflation": 2.0}])
def test_scores_are_those_of_replays_that_are_stored(spark, options):
    """Outages of a scenario overlap, reach beyond the drive, and are told twice."""
    frames, planned = _drives(spark)
    run = F.to_json(F.struct("scenario", "trip"))
    slow = outages.score_outages(benchmark.estimated(frames, planned, "trip", **options), planned.select(run.alias("run"), "start", "end").distinct(), "run", "idx", 0.1)
    slow = slow.select("*", F.get_json_object("run", "$.scenario").alias("scenario"), F.get_json_object("run", "$.trip").cast("long").alias("trip"))
    want, got = _told(slow), _told(benchmark.benchmark(frames.repartition(3), planned, "trip", 0.1, **options))
    assert got[0] == want[0] and len(got[0]) > 50 and {r[1] for r in got[0]} == {0, 1, 2, 3}
    np.testing.assert_allclose(got[1], want[1], rtol=1e-9, atol=1e-9)


def _rows(n: int = 60):
    fix = {"e": 1.0, "n": 2.0, "speed": 12.0, "heading": 90.0, "accuracy": 5.0}
    out = []
    for k in "abc":
        for s, a, b in (("x", 5, 20), ("x", 15, 30), ("y", 40, 50)):
            out.append({"key": k, "_part": 0, "_scenario": s, "_start": a, "_end": b})
        for i in range(n):
            out.append({"key": k, "_part": 1, "idx": i, "t": i * 0.1, "fix": fix if i % 10 == 0 and i else None, "speed": 12.0, "valid": True, "e": i * 1.2, "n": 0.0, "az": 9.8})
    types = pa.schema([("key", "string"), ("_part", "int32"), ("_scenario", "string"), ("_start", "int64"), ("_end", "int64"), ("idx", "int64"), ("t", "float64"), ("fix", pa.struct([(c, "float64") for c in fix])), ("speed", "float64"), ("valid", "bool"), ("e", "float64"), ("n", "float64"), ("az", "float64")])
    return pa.Table.from_pylist(out, schema=types)


TOLD = pa.schema([("key", "string"), ("scenario", "string"), ("start", "int64"), ("end", "int64"), ("i", "int64"), ("speed", "float64"), ("valid", "bool"), ("e", "float64"), ("n", "float64"), ("est_e", "float64"), ("est_n", "float64"), ("mode", "string")])


def _frames(table, block, size):
    out = [r for b in replaying.outage_frames(iter(table.to_batches(max_chunksize=size)), "key", "idx", TOLD, None, False, block=block) for r in b.to_pylist()]
    return sorted(out, key=lambda r: (r["key"], r["scenario"], r["start"], r["i"]))


def test_blocks_may_cut_keys_anywhere():
    whole = _frames(_rows(), 1 << 17, 1000)
    assert len(whole) == 3 * (16 + 16 + 11) and [r["i"] for r in whole if r["key"] == "b" and r["scenario"] == "y"] == list(range(39, 50))
    # scenario x has no fix left at 10 and 20; before the one at 30 there is no estimate
    assert all((r["est_e"] is None) == (r["scenario"] == "x") for r in whole)
    for block in (1, 7, 64):
        cut = _frames(_rows(), block, 5)
        assert [{**r, "est_e": None, "est_n": None} for r in cut] == [{**r, "est_e": None, "est_n": None} for r in whole]
        assert all(a["est_e"] == b["est_e"] or abs(a["est_e"] - b["est_e"]) < 1e-9 for a, b in zip(cut, whole))


def test_frames_out_of_order_are_refused():
    table = _rows()
    with pytest.raises(ValueError, match="by key and time"):
        _frames(table.take(pa.array([*range(20), 30, *range(20, 30), *range(31, 63)])), 1 << 17, 1000)


def test_frames_of_the_benchmark_are_not_shuffled(spark, sf_dir):
    """Only rows of which frames are made, and sums of an outage, go through a shuffle; nothing is joined or stored."""
    plan = catalogue.q64_benchmark_scores(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    frames = plan[plan.index("MapInArrow") :].split("REPARTITION_BY_NUM")[0]
    assert "Join" not in plan and above.count("Exchange ") == 1 and "partial_sum" in above
    assert frames.count("Generate") == 1 and frames.count("Exchange ") == 1 and "replays" not in plan
