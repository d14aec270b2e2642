"""the estimator with speed model and road map follows many keys side by side, as it does without them."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from test_growth import _drive

from driftline.operators import kernels, keyed, lockstep
from driftline.plans import catalogue


def _map() -> list[dict]:
    """A lattice with gaps and one-way streets, on which the drives of ``_drive`` take place."""
    r, out = random.Random(4), []
    for x in range(-8, 9):
        for y in range(-8, 9):
            for dx, dy in ((1, 0), (0, 1)):
                if r.random() < 0.85:
                    a, b = (x * 45.0, y * 45.0), ((x + dx) * 45.0, (y + dy) * 45.0)
                    out.append({"e1": a[0], "n1": a[1], "e2": b[0], "n2": b[1], "node1": a, "node2": b, "length": math.dist(a, b), "psi": math.atan2(dy, dx), "oneway": r.choice([0, 0, 1, -1])})
    return out


@pytest.mark.parametrize("model,mapped,block", [(True, True, 1 << 17), (True, True, 777), (False, True, 1 << 17), (True, False, 777)])
def test_model_and_map_side_by_side_give_the_states_of_each_alone(model, mapped, block):
    rows, want, net = [], [], kernels.RoadNet(_map()) if mapped else None
    for s in range(40):
        nav, r, speed = kernels.Navigator(keyed.oracle_model if model else None, net), random.Random(s), 10.0
        for x in _drive(s, r.randint(1, 200)):
            speed = max(0.0, speed + r.gauss(-0.05, 0.6))
            rows.append({**x, "true_speed": None if r.random() < 0.1 else speed})
            want.append(nav.update(rows[-1]))
    number = pa.float64()
    schema = pa.schema([("key", pa.string()), *[(c, number) for c in ("t", "ax", "ay", "az", "gx", "gy", "gz", "true_speed")], ("fix", pa.struct([(c, number) for c in ("e", "n", "speed", "heading", "accuracy")]))])
    out = pa.schema([("key", pa.string()), *[(c, pa.string() if c == "mode" else number) for c in want[0]]])
    batches = (pa.RecordBatch.from_pylist(rows[k : k + 97], schema=schema) for k in range(0, len(rows), 97))
    got = [x for b in lockstep.estimated(batches, "key", out, block, model, net) for x in b.to_pylist()]
    assert [x["key"] for x in got] == [x["key"] for x in rows]
    assert not mapped or {x["map_confidence"] > 0.4 for x in want if x["mode"] == lockstep.K.DEAD_RECKONING} == {True, False}
    assert not model or any(x["model_speed"] == 0.0 for x in want) and any(x["model_speed"] is None for x in want)
    for a, b in zip(want, got, strict=True):
        assert {c: b[c] for c in a} == pytest.approx(a, abs=1e-7)


def test_chains_of_many_vehicles_are_those_of_each(monkeypatch):
    """Random steps over some nodes, and what is kept of the map cleared again and again."""
    from driftline.operators import streets

    monkeypatch.setattr(streets, "MOST_PAIRS", 50)
    monkeypatch.setattr(streets, "MOST_LISTED", 50)
    rng, net = np.random.default_rng(3), kernels.RoadNet(_map())
    plain, chains, many = [kernels.Matcher(net) for _ in range(30)], streets.Chains(30), streets.Streets(net)
    for _ in range(12):
        own = np.flatnonzero(rng.random(30) < 0.7)
        e, n, psi, speed = rng.uniform(-420, 420, 30), rng.uniform(-420, 420, 30), rng.uniform(-4, 4, 30), rng.choice([1.0, 9.0], 30)
        travelled, std = rng.choice([0.0, 20.0, 150.0], 30), rng.choice([1.0, 12.0, 60.0], 30)
        got = chains.step(many, own, *(c[own] for c in (e, n, psi, speed, travelled, std)))
        for j, k in enumerate(own):
            m = plain[k].step(*(float(c[k]) for c in (e, n, psi, speed, travelled, std)))
            assert (m is None) == (got[3][j] == 0)
            assert m is None or [c[j] for c in got] == pytest.approx([m.e, m.n, m.psi, m.confidence], abs=1e-9)
            assert {s: v[1] for s, v in chains.last(k).items()} == pytest.approx({s: v[1] for s, v in plain[k].last.items()}, rel=1e-9, abs=1e-9)


def test_navigation_is_followed_side_by_side(spark, sf_dir, monkeypatch):
    """No row passes through a kernel of its own."""
    monkeypatch.setattr(keyed, "run_by_key", None)
    assert catalogue.q38_navigation(spark, sf_dir).where("map_confidence > 0").count() > 0
