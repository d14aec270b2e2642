"""What grows with the tables is neither sent to the driver nor done row by row."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline.operators import alignment, benchmark, kernels, keyed, learning, lockstep, outages
from driftline.plans import catalogue


def _drive(seed: int, n: int) -> list[dict]:
    """A drive with gaps, jumps, outages, rejected fixes and missing values."""
    r = random.Random(seed)
    rows, t, e, n_, psi, v = [], r.random(), r.uniform(-50, 50), 0.0, r.uniform(-3, 3), r.uniform(0, 20)
    for i in range(n):
        t += r.choice([0.1, 0.1, 0.1, 0.02, 0.5, 0.0, 1.5 if r.random() < 0.05 else 0.1, 12.0 if r.random() < 0.02 else 0.1])
        turn = r.gauss(0, 0.1)
        psi, v = psi + turn * 0.1, max(0.0, v + r.gauss(0, 0.3))
        e, n_ = e + v * 0.1 * math.cos(psi), n_ + v * 0.1 * math.sin(psi)
        fix = None
        if r.random() < 0.15 and not n * 0.3 < i < n * 0.5:
            jump = 300.0 if r.random() < 0.1 else 0.0
            fix = {
                "e": e + r.gauss(0, 3) + jump, "n": n_ + r.gauss(0, 3), "speed": None if r.random() < 0.2 else v,
                "heading": None if r.random() < 0.3 else (90 - math.degrees(psi)) % 360, "accuracy": None if r.random() < 0.1 else r.uniform(1, 30),
            }
        missing = lambda x: None if r.random() < 0.05 else x
        rows.append({"key": f"k{seed}", "t": t, "ax": missing(r.gauss(0, 0.3)), "ay": r.gauss(0, 0.3), "az": missing(9.8 + r.gauss(0, 0.5)), "gx": r.gauss(0, 0.05), "gy": r.gauss(0, 0.05), "gz": turn, "fix": fix})
    return rows


@pytest.mark.parametrize("block", [1 << 17, 777])
def test_keys_side_by_side_give_the_states_of_each_alone(block):
    """Blocks of many keys, of few, and keys that go on in the next block."""
    drives = [_drive(s, random.Random(s).randint(1, 200)) for s in range(40)]
    rows, want = [x for d in drives for x in d], []
    for d in drives:
        nav = kernels.Navigator()
        want += [nav.update(x) for x in d]
    number = pa.float64()
    schema = pa.schema([("key", pa.string()), ("t", number), *[(c, number) for c in ("ax", "ay", "az", "gx", "gy", "gz")], ("fix", pa.struct([(c, number) for c in ("e", "n", "speed", "heading", "accuracy")]))])
    out = pa.schema([("key", pa.string()), *[(c, pa.string() if c == "mode" else number) for c in want[0]]])
    batches = (pa.RecordBatch.from_pylist(rows[k : k + 97], schema=schema) for k in range(0, len(rows), 97))
    got = [x for b in lockstep.estimated(batches, "key", out, block) for x in b.to_pylist()]
    assert [x["key"] for x in got] == [x["key"] for x in rows]
    assert {x["mode"] for x in want} == set(lockstep.MODES)
    for a, b in zip(want, got, strict=True):
        assert {c: b[c] for c in a} == pytest.approx(a, abs=1e-9)


def test_a_plain_run_is_followed_side_by_side(spark, sf_dir):
    """without map and model no row passes through a kernel of its own."""
    calls = keyed.run_by_key
    keyed.run_by_key = None
    try:
        frames = catalogue._frames(catalogue.events(spark, sf_dir))
        assert keyed.navigate(frames, "trip", use_model=False).count() == frames.count()
    finally:
        keyed.run_by_key = calls


def test_unrolled_outages_are_not_sent_to_the_driver(spark):
    """Spark takes a few outages for few rows, but each is unrolled to all its frames."""
    frames = spark.range(1000).select(F.floor(F.col("id") / 5000).alias("trip"), F.col("id").alias("i"), *[F.lit(5.0).alias(c) for c in ("speed", "est_e", "est_n", "e", "n")], F.lit(True).alias("valid"), F.lit("GNSS_AIDED").alias("mode"))
    planned = spark.createDataFrame([(0, "s", 10, 900)], "trip long, scenario string, start long, end long")
    grid = outages.outage_grid(frames, "trip", "i", 4, 10, 6)
    for df in (
        outages.masked(frames, planned, "trip", "i"), outages.score_outages(frames, planned, "trip", "i", 0.1), grid, outages.hold_last_errors(frames, planned, "trip", "i", 0.1),
        benchmark.replays(frames.withColumn("fix", F.lit(None).cast("struct<e:double>")), planned, "trip", "i"),
    ):
        assert df.count() > 0
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_half_turns_are_decided_as_in_sql(spark):
    """the remainder is that of the SQL to the last digit, by which a step of half a turn goes one way or the other."""
    import duckdb

    got = spark.range(20000).select("id", catalogue._turn(F.col("id") / 100 * 7).alias("a")).toPandas()["a"]
    want = duckdb.sql(f"SELECT {catalogue.pmod('x', '360.0')} FROM (SELECT i / 100 * 7 AS x, i FROM range(20000) t(i)) ORDER BY i").fetchall()
    assert got.tolist() == [x[0] for x in want]


def test_tied_samples_keep_their_order(spark):
    """of samples of one time the first counts before them and the last from there on."""
    samples = spark.createDataFrame([(1, 0.0, 0, 0.0), *[(1, 1.0, k, float(k)) for k in range(1, 30)], (1, 2.0, 30, 30.0)], "key int, t double, row int, v double").repartition(7)
    probes = spark.createDataFrame([(1, 0.5), (1, 1.0), (1, 1.5)], "key int, t double")
    rows = alignment.interpolate(probes, samples, "key", "t", ["v"], ties="row").orderBy("t").collect()
    assert [x.v for x in rows] == [0.5, 29.0, 29.5]
    rows = alignment.asof_backward(probes, samples, "key", "t", ["v"], ties="row").orderBy("t").collect()
    assert [x.v for x in rows] == [0.0, 29.0, 29.0]


def test_windows_of_any_length_are_transformed_and_summed_in_order():
    """F8: the mean is that of the values in their order, to the last digit."""
    r = random.Random(5)
    for n in (1, 7, 64, 200):
        v = [round(r.expovariate(0.02), 2) for _ in range(n)]
        total = 0.0
        for x in v:
            total += x
        assert learning._statistics(np.array([v]))[0, 0] == total / n


def test_a_calibration_is_parsed_once(spark, sf_dir):
    """the text is not parsed anew for each of the conditions."""
    plan = catalogue.q40_calibration_validate(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
