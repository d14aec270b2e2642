"""distances of a map are found for its pairs of segments, however many trips are on it."""

import numpy as np
import pyarrow as pa
import pytest
from test_matching import city, drives

from driftline.operators import matching


@pytest.mark.parametrize("most", [0, 10**6])
def test_distances_do_not_grow_with_trips(spark, monkeypatch, most):
    """Nor does the result change, broadcast or not. Each step had rows of its own before."""
    monkeypatch.setattr(matching, "MOST_PAIRS", most, raising=False)
    sizes, shared = [], matching.shared_table

    def counted(spark, df, name):
        out = shared(spark, df, name)
        if name.startswith("route-"):
            sizes[-1][name] = out.count()
        return out

    monkeypatch.setattr(matching, "shared_table", counted)
    rng = np.random.default_rng(11)
    streets, rows = spark.createDataFrame(city(rng)), [r for r in drives(rng) if r[0] == "long"][:40]
    found = []
    for copies in (1, 3):
        sizes.append({})
        points = spark.createDataFrame([(f"{r[0]}{k}", *r[1:]) for k in range(copies) for r in rows], "trip string, t double, e double, n double, psi double, speed double, travelled double, std double")
        found.append({(r.trip, r.t): tuple(r)[2:] for r in matching.match(points, streets, "trip", "t").collect()})
    assert sizes[0] == sizes[1] and sizes[0]
    assert all(found[1][f"long{k}", t] == found[0]["long0", t] for k in range(3) for _, t in found[0]) and len(found[1]) == 3 * len(rows)


def test_blocks_side_by_side_are_those_one_after_the_other():
    rng = np.random.default_rng(5)
    blocks, begins, want = [], [], []
    for _ in range(60):
        before = int(rng.integers(0, 5))
        scores = np.where(rng.random(before) < 0.3, -np.inf, rng.normal(size=before))
        begins.append(scores.tolist() if before else None)
        steps, last = [], before
        for i in range(int(rng.integers(1, 9))):
            n = int(rng.integers(0, 4))
            cands = [{"rank": k + 1, "segment": k, "foot_e": 0.0, "foot_n": 9.0 * k, "road_psi": 0.0, "emission": float(rng.normal())} for k in range(n)]
            moves = [{"from_rank": a + 1, "rank": b + 1, "score": float(rng.normal())} for a in range(last) for b in range(n) if rng.random() < 0.4]
            steps.append({"i": i, "at": float(i), "cands": cands or None, "moves": moves or None})
            scores = matching.forward(scores, steps[-1])
            want.append(scores)
            last = n
        blocks.append(steps)
    cand = pa.struct([("rank", pa.int32()), ("segment", pa.int64()), *[(c, pa.float64()) for c in ("foot_e", "foot_n", "road_psi", "emission")]])
    move = pa.struct([("from_rank", pa.int32()), ("rank", pa.int32()), ("score", pa.float64())])
    column = pa.array([[], *blocks], pa.list_(pa.struct([("i", pa.int64()), ("at", pa.float64()), ("cands", pa.list_(cand)), ("moves", pa.list_(move))])))
    steps = matching.Steps(column.slice(1))
    got = steps.followed(begins)
    assert len(got) == len(want)
    for a, b in zip(want, got, strict=True):
        assert b[: len(a)] == pytest.approx(a) and not np.isfinite(b[len(a) :]).any()
    segments, *_, confidence = steps.best(begins)
    assert [s.as_py() for s in segments] == [int(a.argmax()) if len(a) else None for a in want]
    assert [c.as_py() for c in confidence] == [pytest.approx(1 / np.exp(a).sum()) if len(a) else None for a in want]
    for k, b in enumerate(blocks):
        old, new = matching.block_map(b), matching.block_map(steps.of(k))
        assert old["whole"].shape == new["whole"].shape and (old["whole"] == new["whole"]).all() and (old["dead"] == new["dead"]).all() and list(old["anew"]) == list(new["anew"])
