"""Findings of round 4, F2 to F4: rows of a phone's log that have the same time, or lie before the row that they follow."""

import math

import numpy as np

from driftline.operators import alignment, trips

HOW = trips.Preparation(axis_least=10, lag_least=20, max_lag=5, block=20, block_least=1000)


def _logs(spark, times: list[float]):
    """Logs of one trip."""
    phone = [(1, i, 7200.0 + t, *[math.sin(1.7 * i + c) for c in range(6)], 52.4, -1.5, 20.0, 3.0, 0.0) for i, t in enumerate(times)]
    vehicle = [(1, i, 0.11 * i, 20 * math.sin(1.3 * i), 40.0, 52.4, -1.5, 0.0) for i in range(90)]
    phone = spark.createDataFrame(phone, "trip long, row long, t double, ax double, ay double, az double, g_yaw double, g_roll double, g_pitch double, lat double, lon double, kmh double, accuracy double, bearing double")
    return phone, spark.createDataFrame(vehicle, "trip long, row long, t double, yaw_deg double, kmh double, lat double, lon double, heading double")


def test_equal_times_are_in_the_order_of_the_log(spark):
    """Row 23 follows one that is left out and has the time of row 20: for axis and lag row 23 counts on both sides."""
    times = [0.12 * i for i in range(80)]
    times[21:24] = times[20] + 0.05, times[20] - 0.01, times[20]
    told = trips.prepare(*_logs(spark, times), how=HOW)[1].first()
    kept = sorted((t, i) for i, t in enumerate(times) if i != 22)
    pitch, yaw = [], []
    for t in (0.1 * k for k in range(told.samples)):
        low, high = max(x for x in kept if x[0] <= t), min((x for x in kept if x[0] >= t), key=lambda x: (x[0], -x[1]))
        g = [math.sin(1.7 * i + 5) for i in (low[1], high[1])]
        pitch.append(g[0] + (g[1] - g[0]) * ((t - low[0]) / (high[0] - low[0]) if high[0] > low[0] else 0.0))
        yaw.append(np.interp(t, 0.11 * np.arange(90), 20 * np.sin(1.3 * np.arange(90))))
    assert abs(told.gyro_corr["g_pitch"] - np.corrcoef(pitch, yaw)[0, 1]) < 1e-9


def test_a_row_before_the_one_it_follows_shortens_the_gap(spark):
    """Row 23 lies in the middle of the 0.9 s between rows 20 and 21; it counts for values, and so for gaps."""
    times = [0.12 * i for i in range(20)]
    times += [times[19] + d for d in (0.1, 1.0, 0.5, 0.55)]
    times += [times[19] + 1.1 + 0.12 * i for i in range(57)]
    frames = trips.prepare(*_logs(spark, times), how=HOW)[0]
    assert frames.count() > 80 and frames.where("NOT valid").count() == 0


def test_gap_at_equal_times(spark):
    """The interval that counts at a time with two samples is the one up to the next time, not the empty one between them."""
    samples = spark.createDataFrame([("a", 0.0), ("a", 0.4), ("a", 0.4), ("a", 2.0), ("a", 2.1)], "key string, t double")
    probes = spark.createDataFrame([("a", x) for x in (0.1, 0.4, 1.0, 2.0)], "key string, t double")
    assert {r.t: r.ok for r in alignment.gap_free(probes, samples, "key", "t", 0.5).collect()} == {0.1: True, 0.4: False, 1.0: False, 2.0: True}
