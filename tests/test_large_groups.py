"""Operators that keep to bounded memory where one group has all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import draws
from driftline.operators import bootstrap, outages, quantiles


def test_draws_do_not_depend_on_partitions_and_have_the_right_moments(spark):
    rows = spark.range(40_000).withColumn("trip", F.col("id") % 7)
    told = [
        sorted(map(tuple, rows.repartition(n).select("id", draws.uniform(3, "trip", "id").alias("u"), draws.normal(3, "trip", "id", draw=1).alias("z"), draws.below(6, 3, "id").alias("k")).collect()))
        for n in (2, 7)
    ]
    assert told[0] == told[1]
    u, z, k = (np.array([r[c] for r in told[0]]) for c in (1, 2, 3))
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.002
    assert abs(z.mean()) < 0.02 and abs(z.var() - 1) < 0.03 and abs((z**3).mean()) < 0.08 and abs((z**4).mean() - 3) < 0.2
    assert np.abs(np.bincount(k) / len(k) - 1 / 6).max() < 0.01
    other = spark.range(40_000).select(draws.uniform(4, "id").alias("a"), draws.uniform(3, "id", draw=1).alias("b"), draws.uniform(3, "id").alias("c")).toPandas()
    assert np.abs(np.corrcoef(other.T.to_numpy()) - np.eye(3)).max() < 0.02
    assert spark.range(1).select(draws.uniform(1, F.lit(None).cast("long")).alias("u")).first().u is not None


def test_exact_percentiles_of_groups_of_all_kinds(spark):
    """Ties of a third of the rows, null keys, nulls and NaN, a group of one, a group without values."""
    rng = np.random.default_rng(2)
    rows = [("a", None if k % 50 == 0 else 7.0 if k % 3 == 0 else float(rng.normal())) for k in range(3000)] + [(None, float(k)) for k in range(11)]
    rows += [("one", 4.0), ("none", None), ("nan", float("nan")), ("nan", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(9)
    got = {r.k: (r.m, r.p) for r in quantiles.exact_percentiles(df, ["k"], "v", {"m": 0.5, "p": 0.9}).collect()}
    want = {}
    for k, v in rows:
        if v is not None and v == v:
            want.setdefault(k, []).append(v)
    assert got == {k: pytest.approx(tuple(np.percentile(v, [50, 90]))) for k, v in want.items()}
    whole = quantiles.exact_percentiles(df, [], "v", {"p99": 0.99}).collect()
    assert len(whole) == 1 and whole[0].p99 == pytest.approx(np.percentile([x for v in want.values() for x in v], 99))
    assert quantiles.exact_percentiles(df.where("false"), [], "v", {"m": 0.5}).collect() == []


def brute_replicates(rows, rule, replicates, size, limit):
    """Every draw as a row of its own."""
    by_group = {}
    for g, c, v in rows:
        by_group.setdefault(g, {}).setdefault(c, []).append(v)
    out = {}
    for g, clusters in by_group.items():
        levels = max(0, int(np.ceil(np.log2(len(clusters) / size))))
        buckets = {}
        for c in sorted(clusters):
            buckets.setdefault(c % 2**levels, []).append(c)

        def drawn(k, level, node, m, g=g, buckets=buckets):
            own = [b for b in buckets if b >> level == node]
            if not own:
                return []
            if level == 0:
                n = len(buckets[node])
                return [buckets[node][int(i)] for i in rule.picks(g, node, np.full(m, k), np.arange(m), n)]
            n, left = sum(len(buckets[b]) for b in own), sum(len(buckets[b]) for b in own if (b >> (level - 1)) % 2 == 0)
            m_left = int(rule.left(g, level, node, np.array([k]), np.array([m]), left, n)[0])
            return drawn(k, level - 1, 2 * node, m_left) + drawn(k, level - 1, 2 * node + 1, m - m_left)

        for k in range(replicates):
            values = [v for c in drawn(k, levels, 0, len(clusters)) for v in clusters[c]]
            out[g, k] = np.median(values), np.mean(np.array(values) < limit)
    return out


@pytest.mark.parametrize("most", [bootstrap.MOST_VALUES, 3])
def test_replicates_against_drawing_one_by_one(spark, most):
    """Several buckets, clusters of one to four values, ties, groups of one cluster; with ``most`` of 3 the ranges are cut up further."""
    from driftline.plans.catalogue import RuleDraws

    rng = np.random.default_rng(4)
    rows = [("a", int(c), float(np.round(rng.normal() * 10, 1))) for c in range(300) for _ in range(rng.integers(1, 5))]
    rows += [("b", int(c), float(c % 3)) for c in range(40)] + [("c", 5, 1.0), ("c", 5, 12.0)]
    df = spark.createDataFrame(rows, "g string, cluster long, value double")
    found = bootstrap.replicates_of(df, 10.0, 60, RuleDraws(), lambda c: c, 16, most)
    got = {(r.g, r.replicate): (r.median, r.share) for r in found.collect()}
    want = brute_replicates(rows, RuleDraws(), 60, 16, 10.0)
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)


def test_random_replicates_are_the_same_for_any_partitions_and_spread_as_they_should(spark):
    rng = np.random.default_rng(9)
    values = rng.exponential(8.0, 3000)
    df = spark.createDataFrame([("x", k, float(v)) for k, v in enumerate(values)], "g string, cluster long, value double")
    told = [sorted(map(tuple, bootstrap.replicates_of(df.repartition(n), 10.0, 400, bucket=256).collect())) for n in (2, 5)]
    assert told[0] == told[1] and len(told[0]) == 400
    own = np.array([[np.median(s), (s < 10).mean()] for s in (rng.choice(values, len(values)) for _ in range(400))])
    got = np.array([r[2:] for r in told[0]])
    assert np.abs(got.mean(0) - own.mean(0)).max() < 0.05 and np.abs(got.std(0) / own.std(0) - 1).max() < 0.2
    counts = bootstrap._counts(bootstrap.RandomDraws(1), {"g": "x", "bucket": 0, "n_clusters": 50, "path": [], "clusters": [{}] * 50}, np.arange(2000))
    # of a multinomial draw over 50 cells: one on average, variance 49/50, covariance -1/50
    assert (counts.sum(1) == 50).all() and abs(counts.var(0).mean() - 0.98) < 0.03 and abs(np.cov(counts.T)[~np.eye(50, dtype=bool)].mean() + 0.02) < 0.005


def test_robustness_of_no_rows(spark):
    none = spark.createDataFrame([], "config string, outage long, seed long, drift double")
    assert outages.robustness(none, ["config"], "outage", "seed", "drift", 10).collect() == []


@pytest.fixture(scope="module")
def walk(spark):
    """One key with almost all rows, a small one, a null one, gaps in the order, nulls and NaN among the values."""
    rng = np.random.default_rng(1)
    rows, at = [], 0
    for k in range(1500):
        at += int(rng.integers(1, 4)) if k % 200 else 500
        key = "hot" if k % 30 else ("small" if k % 60 else None)
        angle = None if k % 97 == 0 else float(rng.uniform(0, 360))
        rows.append((key, at, angle, bool(rng.random() < 0.8), float("nan") if k % 40 == 0 else float(rng.integers(0, 3)), None if rng.random() < 0.7 else float(k)))
    return spark.createDataFrame(rows, "key string, at long, angle double, ok boolean, level double, seldom double").repartition(5)


def test_scans_in_stretches_equal_those_of_one_window(spark, walk):
    from driftline.operators import alignment, validity

    for width in (7, 100, 1e6):
        for f, columns in (
            (lambda w: validity.islands(walk, "key", "at", "ok", width=w), ["run_start"]),
            (lambda w: alignment.change_ids(walk, "key", "at", ["level", "ok"], width=w), ["is_new", "change_id"]),
            (lambda w: alignment.unwrapped(walk.where("angle IS NOT NULL"), "key", "at", "angle", width=w), ["unwrapped"]),
            (lambda w: alignment.forward_fill(walk, "key", "at", "seldom", -1.0, "filled", width=w), ["filled"]),
        ):
            got, want = (sorted(map(str, f(w).select("key", "at", *[F.round(c, 6) if c == "unwrapped" else F.col(c) for c in columns]).collect())) for w in (width, None))
            assert got == want


def test_a_hot_key_is_spread_over_tasks(spark, walk):
    """No stretch, and so no task that one key is dealt to, has more than a few rows of it."""
    from driftline.operators import scans

    cut = scans.Stretches(walk, "key", "at", 50).running_sum(F.lit(1), "n")
    largest = cut.rows.groupBy(cut.key, cut.stretch).agg(F.count("*").alias("rows")).agg(F.max("rows")).first()[0]
    plan = cut.done()._jdf.queryExecution().optimizedPlan().toString()
    assert largest <= 50 and "windowspecdefinition(_scan_key#" in plan and cut.done().columns == [*walk.columns, "n"]
    assert cut.done().where("key = 'hot'").agg(F.max("n")).first()[0] == walk.where("key = 'hot'").count()


@pytest.mark.parametrize(("alpha", "width"), [(0.01, 40), (0.5, 1e6), (0.9, 300), (1.0, 25)])
def test_gravity_as_an_affine_scan(spark, alpha, width, monkeypatch):
    from driftline.operators import alignment, kernels, scans

    monkeypatch.setattr(scans, "MOST_BLOCK", 64)
    rng = np.random.default_rng(3)
    rows = []
    for key, n in (("hot", 2000), ("two", 2), (None, 40), ("never", 5)):
        for i in range(n):
            size = rng.choice([9.8, 9.0, 11.5, 3.0]) if key != "never" else 2.0
            v = rng.normal(size=3) * 0.2 + [0, 0, 1]
            rows.append((key, i, *map(float, v / np.linalg.norm(v) * size), *map(float, rng.normal(size=3) * rng.choice([0.02, 0.3]))))
    df = spark.createDataFrame(rows, "key string, i long, ax double, ay double, az double, gx double, gy double, gz double")
    found = alignment.gravity_directions(df.repartition(3), "key", "i", alpha, width)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and found.columns == [*df.columns, "down_x", "down_y", "down_z"]
    got, state = {(r.key, r.i): (r.down_x, r.down_y, r.down_z) for r in found.collect()}, {}
    for key, i, *v in rows:
        down = state.setdefault(key, kernels.Gravity(alpha)).update(v[:3], v[3:])
        assert got[key, i] == pytest.approx(down, abs=1e-9)


def test_greedy_outages_by_doubling(spark):
    """Chains of thousands of steps, gaps in the starts, an end that is missing, one key without the first start, null keys."""
    rng = np.random.default_rng(8)
    rows = [("long", k, k + int(rng.integers(1, 30)), bool(rng.random() < 0.4)) for k in range(6000)] + [("gap", k, k + 3, k % 5 == 0) for k in range(60) if k != 41]
    rows += [("late", k, k + 2, True) for k in range(5, 20)] + [("open", 2, None, True), ("open", 3, 4, True), ("null", 2, 5, None), ("null", 3, 6, True), (None, 2, 5, True)]
    df = spark.createDataFrame(rows, "trip string, start long, end long, fits boolean")
    got = sorted(map(tuple, outages.distance_outages(df.repartition(5), "trip", 2, 3, 1).collect()))
    want = []
    for trip in ("long", "gap", "late", "open", "null"):
        own, at = {s: (e, f) for t, s, e, f in rows if t == trip}, 2
        while at in own and own[at][0] is not None:
            end, fits = own[at]
            if fits:
                want.append((trip, at, end))
            at = end + 3 if fits else at + 1
    assert got == sorted(want) and len(got) > 200


@pytest.mark.parametrize("most", [100_000, 40])
def test_nearby_segments_against_all_pairs(spark, most):
    """Half of all points in one cell, points on borders and at one place, segments longer than a cell and of no length."""
    from driftline.operators import roads

    rng = np.random.default_rng(6)
    places = [(*rng.uniform(0, 40, 2),) for _ in range(200)] + [(*rng.uniform(-300, 600, 2),) for _ in range(150)] + [(50.0, 100.0)] * 20 + [(0.0, -50.0), (None, 3.0)]
    lines = [(*rng.uniform(-300, 600, 2), *rng.uniform(-300, 600, 2)) for _ in range(40)] + [(10.0, 10.0, 10.0, 10.0), (0.0, 0.0, 100.0, 0.0)]
    points = spark.createDataFrame([(k, None if e is None else float(e), float(n), "x") for k, (e, n) in enumerate(places)], "point long, e double, n double, kind string")
    segments = spark.createDataFrame([(k, *map(float, s)) for k, s in enumerate(lines)], "segment long, e1 double, n1 double, e2 double, n2 double")
    for radius in (30.0, 170.0):
        got = {(r.point, r.segment): r.distance for r in roads.nearby(points.repartition(3), segments, "point", "segment", radius, most=most).collect()}
        rows = roads.nearby(points, segments, "point", "segment", radius, most=most)
        want = {}
        for i, (e, n) in enumerate(places):
            for j, (a, b, c, d) in enumerate(lines):
                if e is None:
                    continue
                size = max((c - a) ** 2 + (d - b) ** 2, 1e-9)
                f = min(max(((e - a) * (c - a) + (n - b) * (d - b)) / size, 0), 1)
                far = float(np.hypot(e - a - f * (c - a), n - b - f * (d - b)))
                if far <= radius:
                    want[i, j] = far
        assert rows.count() == len(got) and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    assert set(rows.columns) == {*points.columns, *segments.columns, "fraction", "foot_e", "foot_n", "distance"}


def test_window_statistics_of_odd_windows(spark):
    """Against the column version: lengths of one to nine, nulls inside, null and empty arrays, two columns at once."""
    from driftline.functions import motion
    from driftline.operators import learning

    rng = np.random.default_rng(4)
    rows = [(k, [float(v) for v in rng.normal(size=n)], [1.0] * n) for k, n in enumerate([1, 2, 3, 5, 8, 9, 9, 20])] + [(100, None, [2.0]), (101, [1.0, None, 2.0], []), (102, [], None)]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>")
    got = {r.id: r for r in learning.window_statistics(df, {"a": "sa", "b": "sb"}).collect()}
    want = {r.id: r for r in df.where("id < 100").select("id", motion.window_stats(F.col("a")).alias("sa"), motion.window_stats(F.col("b")).alias("sb")).collect()}
    for k, r in got.items():
        for c in ("sa", "sb"):
            for n in learning.STATISTICS:
                assert r[c][n] == (None if k >= 100 and not (k == 100 and c == "sb") else pytest.approx(want[k][c][n], abs=1e-9)) if k in want else r[c][n] in (None, 2.0, 0.0)
    assert got[101].sa.mean is None and got[102].sb.mean is None and got[100].sb.mean == 2.0
