"""Map matching by blocks against a plain step-by-step Viterbi filter."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import matching
from driftline.operators.kernels import Matcher, RoadNet


def city(rng):
    """A lattice with one-way streets, gaps in it, and a road of its own that nothing leads to."""
    out = []
    for x in range(6):
        for y in range(6):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < 6 and y + dy < 6 and rng.random() < 0.85:
                    out.append((x * 80.0, y * 80.0, (x + dx) * 80.0, (y + dy) * 80.0, int(rng.integers(-1, 2))))
    out.append((1000.0, 1000.0, 1080.0, 1000.0, 0))
    name = lambda e, n: f"{e:g}:{n:g}"
    return [{"segment": k, "e1": a, "n1": b, "e2": c, "n2": d, "node1": name(a, b), "node2": name(c, d), "length": math.hypot(c - a, d - b), "psi": math.atan2(d - b, c - a), "oneway": o} for k, (a, b, c, d, o) in enumerate(out)]


def drives(rng):
    rows = []
    for trip, n in (("long", 90), ("short", 7), (None, 11), ("one", 1), ("far", 5)):
        e, psi = np.array([200.0, 200.0]), 0.0
        for i in range(n):
            far = trip == "far" or i % 23 == 11  # where no road is
            jump = i % 17 == 13  # where no route leads
            travelled = float(rng.choice([0.0, 5.0, 40.0, 150.0]))
            psi += rng.normal() * 0.6
            e = np.clip(e + travelled * np.array([math.cos(psi), math.sin(psi)]), 0, 400)
            at = (9000.0, 9000.0) if far else (1040.0, 1003.0) if jump else tuple(e + rng.normal(size=2) * 6)
            rows.append((trip, float(i), *map(float, at), float(psi), float(rng.choice([0.5, 12.0])), travelled, float(rng.choice([2.0, 9.0, 30.0, 80.0]))))
    return rows


@pytest.mark.parametrize("block", [1, 4, 128])
def test_blocks_against_step_by_step(spark, block, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", block)
    rng = np.random.default_rng(11)
    streets, rows = city(rng), drives(rng)
    points = spark.createDataFrame(rows, "trip string, t double, e double, n double, psi double, speed double, travelled double, std double")
    found = matching.match(points.repartition(4), spark.createDataFrame(streets), "trip", "t")
    got = {(r.trip, r.t): (r.segment, r.foot_e, r.foot_n, r.confidence) for r in found.collect()}
    plain, several = {}, 0
    for trip, t, e, n, psi, speed, travelled, std in rows:
        m = plain.setdefault(trip, Matcher(RoadNet(streets))).step(e, n, psi, speed, travelled, std)
        want = (None,) * 4 if m is None else (m.segment, m.e, m.n, m.confidence)
        several += travelled == 150.0 and m is not None
        assert got[trip, t][0] == want[0] and got[trip, t][1:] == (want[1:] if m is None else pytest.approx(want[1:], abs=1e-9)), (trip, t)
    assert len(got) == len(rows) and several > 10  # routes of 150 m lead over two or three nodes
    assert {got[k][0] for k in got if k[0] == "far"} == {None}


def test_a_block_is_one_map(spark):
    """A block's map applied to any scores gives what its steps give one after the other."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        before = int(rng.integers(0, 4))
        steps, last, scores = [], before, np.where(rng.random(before) < 0.3, -np.inf, rng.normal(size=before))
        for _ in range(int(rng.integers(1, 7))):
            n = int(rng.integers(0, 4))
            moves = [{"from_rank": a + 1, "rank": b + 1, "score": float(rng.normal())} for a in range(last) for b in range(n) if rng.random() < 0.4]
            steps.append({"cands": [{"emission": float(rng.normal())} for _ in range(n)] or None, "moves": moves or None})
            last = n
        want = scores
        for s in steps:
            want = matching.forward(want, s)
        b = matching.block_map(steps)
        got = matching.follow(scores, b["whole"].shape[0], b["whole"], b["dead"], b["anew"])
        assert got.shape == want.shape and (len(want) == 0 or got == pytest.approx(want))


def test_matching_of_no_points(spark):
    rng = np.random.default_rng(1)
    none = spark.createDataFrame([], "trip string, t double, e double, n double, psi double, speed double, travelled double, std double")
    assert matching.match(none, spark.createDataFrame(city(rng)), "trip", "t").collect() == []
    assert "Cartesian" not in matching.match(none.union(spark.createDataFrame([("a", 0.0, 1.0, 1.0, 0.0, 5.0, 0.0, 5.0)], none.schema)), spark.createDataFrame(city(rng)), "trip", "t").withColumn("x", F.lit(1))._jdf.queryExecution().executedPlan().toString()
