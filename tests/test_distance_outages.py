"""the greedy outages of q23 against their SQL where vehicles stand, go back, or a value lacks."""

import datetime

import duckdb
import numpy as np

from driftline.operators import alignment
from driftline.plans import catalogue

NAN, INF = float("nan"), float("inf")
# odd values of a kind of trip and their share
KINDS = [([0.0], 0.0), ([-1.0], 0.3), ([-31.0, -6.0], 0.3), ([None], 0.3), ([NAN], 0.02), ([INF, -INF], 0.02), ([-1.0, None, -6.0, NAN], 0.1)]


def test_distance_outages_of_odd_values(spark, tmp_path):
    """Whole values, of which every order of adding makes the same sum, and many of which come to exactly 200."""
    rng = np.random.default_rng(11)
    rows, start = [], datetime.datetime(2024, 1, 1)
    for trip in range(20 * len(KINDS)):
        odd, share = KINDS[trip % len(KINDS)]
        for i in range(90):
            value = odd[int(rng.integers(len(odd)))] if rng.random() < share else float(rng.choice([19.0, 39.0, 49.0, 24.0, 99.0]))
            props = None if rng.random() < 0.01 else f'{{"k": {int(rng.integers(100))}}}'
            rows.append((len(rows), start + datetime.timedelta(hours=i), None if trip == 7 and i % 9 == 0 else trip, "view", value, props))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(catalogue.oracle_sql()["q23_distance_outages"]).fetchall())
    got = sorted(map(tuple, catalogue.q23_distance_outages(spark, str(tmp_path)).select("trip", "start", "end").collect()))
    assert got == want and {trip % len(KINDS) for trip, _, _ in got} == set(range(len(KINDS)))


def test_first_sample_from_a_time_on(spark):
    """A sample at the probe's own time counts, NaN comes after all others, keys do not mix."""
    probes = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2), ("a", 3.5, 3), ("b", 0.0, 4), ("c", 9.0, 5), ("c", NAN, 6)], "key string, t double, p int")
    samples = spark.createDataFrame([("a", 1.0, 10), ("a", 3.0, 30), ("b", -1.0, 40), ("c", NAN, 50)], "key string, t double, v int")
    assert {r.p: r.v for r in alignment.asof_forward(probes, samples, "key", "t", ["v"]).collect()} == {1: 10, 2: 30, 3: None, 4: None, 5: 50, 6: 50}
