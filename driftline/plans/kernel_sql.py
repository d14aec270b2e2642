"""The kernels' recursions as recursive SQL, for checking them: one step for each row, the state in its columns."""

from __future__ import annotations

import math

LOST = "('DEAD_RECKONING', 'REACQUISITION')"


def wrap(x: str) -> str:
    tau = "2*pi()"
    return f"(((((({x}) + pi()) % ({tau})) + ({tau})) % ({tau})) - pi())"


def consistent(a: str, b: str, own: str) -> str:
    """Whether two fixes, structs ``t, e, n, speed, accuracy``, fit one drive."""
    dt, moved = f"({b}.t - {a}.t)", f"sqrt(pow({b}.e - {a}.e, 2) + pow({b}.n - {a}.n, 2))"
    slack = f"3.0 * sqrt(pow({a}.accuracy, 2) + pow({b}.accuracy, 2))"
    near = f"abs({moved} - ({a}.speed + {b}.speed) / 2 * {dt}) < {slack} + 2.0 * {dt}"
    far = f"{moved} <= least(60.0, 1.5 * greatest({own}, {a}.speed, {b}.speed) + 3.0) * {dt} + {slack} + 10.0"
    return f"({dt} > 0 AND {dt} <= 60 AND CASE WHEN {dt} <= 5 THEN {near} ELSE {far} END)"


#: The monitor's state before its first row.
MONITOR_START = (
    "'GNSS_AIDED' AS mode, 1.0::DOUBLE AS gap, 0.0::DOUBLE AS quality, NULL::DOUBLE AS seen_at, NULL::STRUCT(t DOUBLE, e DOUBLE, n DOUBLE, speed DOUBLE, accuracy DOUBLE) AS seen, "
    "NULL::STRUCT(t DOUBLE, e DOUBLE, n DOUBLE, speed DOUBLE, accuracy DOUBLE) AS pending, 0 AS rejects, NULL::VARCHAR AS decision"
)
MONITOR = ("mode", "gap", "quality", "seen_at", "seen", "pending", "rejects", "decision")
_SILENT = "(seen_at IS NULL OR t - seen_at > 1.5 * greatest(gap, 0.1))"


def tick(source: str, others: str) -> str:
    """Silence for too long is dead reckoning."""
    return f"""SELECT {others}, CASE WHEN {_SILENT} THEN 'DEAD_RECKONING' ELSE mode END AS mode, gap, CASE WHEN {_SILENT} THEN 0.0 ELSE quality END AS quality, seen_at, seen, pending, rejects, decision FROM ({source})"""


def on_fix(source: str, others: str, fix: str = "fix") -> str:
    """The state machine's step where ``fix`` is not null, with columns ``t, surprise, own``."""
    agrees = "surprise <= 13.82"
    branch = f"""CASE WHEN {fix} IS NULL THEN 'none' WHEN {fix}.accuracy IS NULL OR {fix}.accuracy > 25 THEN 'bad' WHEN seen IS NULL AND pending IS NULL THEN 'first'
      WHEN mode IN {LOST} AND {agrees} THEN 'back' WHEN mode IN {LOST} AND pending IS NOT NULL AND {consistent('pending', fix, 'own')} THEN 'pair' WHEN mode IN {LOST} THEN 'wait'
      WHEN {agrees} THEN 'fits' WHEN rejects + 1 >= 3 AND {consistent('seen', fix, 'own')} THEN 'drifted' ELSE 'odd' END"""
    q = f"least(1.0, greatest(0.1, 1.0 - ({fix}.accuracy - 3.0) / 25.0))"
    heard = "branch NOT IN ('none', 'bad')"
    longest = "CASE WHEN gap > 3 THEN 15.0 ELSE 5.0 END"
    return f"""SELECT {others},
      CASE WHEN branch IN ('first', 'back', 'pair') THEN 'GNSS_AIDED' WHEN branch = 'wait' THEN 'REACQUISITION' WHEN branch = 'fits' THEN CASE WHEN {fix}.accuracy > 12 THEN 'DEGRADED' ELSE 'GNSS_AIDED' END ELSE mode END AS mode,
      CASE WHEN {heard} AND seen_at IS NOT NULL THEN gap + 0.2 * (least(greatest(t - seen_at, 0.1), {longest}) - gap) ELSE gap END AS gap,
      CASE WHEN branch IN ('first', 'back', 'pair', 'fits') THEN {q} WHEN branch = 'wait' THEN {q} / 2 WHEN branch IN ('odd', 'drifted') THEN greatest(0.0, {q} - 0.2 * (rejects + 1)) ELSE quality END AS quality,
      CASE WHEN {heard} THEN t ELSE seen_at END AS seen_at, CASE WHEN {heard} AND branch <> 'wait' THEN {fix} ELSE seen END AS seen,
      CASE WHEN branch IN ('back', 'pair') THEN NULL WHEN branch = 'wait' THEN {fix} ELSE pending END AS pending,
      CASE WHEN branch IN ('pair', 'fits', 'drifted') THEN 0 WHEN branch = 'odd' THEN rejects + 1 ELSE rejects END AS rejects,
      CASE branch WHEN 'none' THEN NULL WHEN 'first' THEN 'reanchor' WHEN 'pair' THEN 'reanchor' WHEN 'drifted' THEN 'reanchor' WHEN 'back' THEN 'fuse'
        WHEN 'fits' THEN CASE WHEN {fix}.accuracy > 12 THEN 'fuse_inflated' ELSE 'fuse' END ELSE 'reject' END AS decision
    FROM (SELECT *, {branch} AS branch FROM ({source}))"""


_PAIRS = [(a, b) for a in range(6) for b in range(a, 6)]
FILTER = [f"x{a}" for a in range(6)] + [f"p{a}{b}" for a, b in _PAIRS]


def _p(a: int, b: int) -> str:
    return f"p{min(a, b)}{max(a, b)}"


def _bounded(x: dict[int, str]) -> list[str]:
    x = {a: x.get(a, f"x{a}") for a in range(6)}
    x[2], x[3], x[5] = wrap(x[2]), f"greatest({x[3]}, 0.0)", f"least(greatest({x[5]}, -0.2), 0.2)"
    return [f"{x[a]} AS x{a}" for a in range(6)]


def filter_start() -> str:
    deviations = (5.0, 5.0, 0.5, 2.0, 0.01, 0.05)
    return ", ".join([f"0.0::DOUBLE AS x{a}" for a in range(6)] + [f"{deviations[a] ** 2 if a == b else 0.0!r}::DOUBLE AS p{a}{b}" for a, b in _PAIRS])


def predict(source: str, others: str) -> str:
    """One step of motion by ``dt`` and ``yaw``, where 0 < dt < 1."""
    growth = (0.05**2, 0.05**2, 0.005**2, 1.0, 3e-5**2, 1e-8)
    step = {(a, a): "1" for a in range(6)} | {
        (0, 2): "(-x3 * sin(x2) * dt)", (0, 3): "(cos(x2) * dt)", (1, 2): "(x3 * cos(x2) * dt)", (1, 3): "(sin(x2) * dt)", (2, 4): "(-(1 + x5) * dt)", (2, 5): "((yaw - x4) * dt)",
    }
    rows = {a: [(i, f) for (r, i), f in step.items() if r == a] for a in range(6)}
    cols = [f"CASE WHEN moves THEN x0 + x3 * cos(x2) * dt ELSE x0 END AS x0", "CASE WHEN moves THEN x1 + x3 * sin(x2) * dt ELSE x1 END AS x1"]
    cols += [f"CASE WHEN moves THEN {wrap('x2 + (1 + x5) * (yaw - x4) * dt')} ELSE x2 END AS x2", "x3", "x4", "x5"]
    for a, b in _PAIRS:
        terms = " + ".join(" * ".join(v for v in (f, _p(i, j), g) if v != "1") for i, f in rows[a] for j, g in rows[b])
        cols.append(f"CASE WHEN moves THEN {terms}{f' + {growth[a]!r} * dt' if a == b else ''} ELSE p{a}{b} END AS p{a}{b}")
    return f"SELECT {others}, {', '.join(cols)} FROM (SELECT *, coalesce(dt > 0 AND dt < 1, false) AS moves FROM ({source}))"


def observe(source: str, others: str, place: int, offset: str, noise: str, when: str, gate: float | None = None) -> str:
    """A measurement of one state where ``when`` holds and the gate lets it through."""
    s = f"({_p(place, place)} + {noise})"
    test = f"coalesce({when}, false)" + (f" AND pow({offset}, 2) / {s} <= {gate}" if gate else "")
    x = dict(zip(range(6), [f"x{a} + {_p(a, place)} / {s} * ({offset})" for a in range(6)], strict=True))
    cols = [f"CASE WHEN {test} THEN {new[: new.rindex(' AS ')]} ELSE x{a} END AS x{a}" for a, new in enumerate(_bounded(x))]
    cols += [f"CASE WHEN {test} THEN p{a}{b} - {_p(a, place)} * {_p(place, b)} / {s} ELSE p{a}{b} END AS p{a}{b}" for a, b in _PAIRS]
    return f"SELECT {others}, {', '.join(cols)} FROM ({source})"


_S = "((p00 + noise) * (p11 + noise) - p01 * p01)"
SURPRISE = "((p11 + noise) * pow(fix.e - x0, 2) - 2 * p01 * (fix.e - x0) * (fix.n - x1) + (p00 + noise) * pow(fix.n - x1, 2)) / det"


def observe_fix(source: str, others: str, noise: str, when: str) -> str:
    """A measurement of the position where ``when`` holds."""
    inner = f"SELECT *, {_S} AS det, coalesce({when}, false) AS does FROM (SELECT *, {noise} AS noise FROM ({source}))"
    k0 = lambda a: f"(({_p(a, 0)} * (p11 + noise) - {_p(a, 1)} * p01) / det)"
    k1 = lambda a: f"(({_p(a, 1)} * (p00 + noise) - {_p(a, 0)} * p01) / det)"
    new = _bounded({a: f"x{a} + {k0(a)} * (fix.e - x0) + {k1(a)} * (fix.n - x1)" for a in range(6)})
    cols = [f"CASE WHEN does THEN {v[: v.rindex(' AS ')]} ELSE x{a} END AS x{a}" for a, v in enumerate(new)]
    cols += [f"CASE WHEN does THEN p{a}{b} - {k0(a)} * {_p(0, b)} - {k1(a)} * {_p(1, b)} ELSE p{a}{b} END AS p{a}{b}" for a, b in _PAIRS]
    return f"SELECT {others}, {', '.join(cols)} FROM ({inner})"


def reanchor(source: str, others: str, values: dict[int, tuple[str, float]], when: str) -> str:
    """Sets states to values with deviations where ``when`` holds, unrelated to the rest."""
    cols = [f"CASE WHEN coalesce({when}, false) THEN {values[a][0]} ELSE x{a} END AS x{a}" if a in values else f"x{a}" for a in range(6)]
    for a, b in _PAIRS:
        touched = [k for k in (a, b) if k in values]
        cols.append(f"CASE WHEN coalesce({when}, false) THEN {repr(values[a][1] ** 2) if a == b else '0.0'}::DOUBLE ELSE p{a}{b} END AS p{a}{b}" if touched else f"p{a}{b}")
    return f"SELECT {others}, {', '.join(cols)} FROM ({source})"


def navigation(frames: str) -> str:
    """CTEs ``nv`` for the estimator without model and map over ``frames(trip, f, t, ax, ay, az, gx, gy, gz, fix)``.

    Frames are numbered from 0 and stand further apart than a decimation bin is long, so that each is a sample by
    itself, which the next frame closes. Fixes have a speed over 2 m/s and head east.
    """
    g = 9.80665
    carried = "trip, f, t, ax, ay, az, gx, gy, gz, fix, g"
    monitor, state = ", ".join(MONITOR), ", ".join(FILTER)
    size, turn = f"sqrt(s.ax*s.ax + s.ay*s.ay + s.az*s.az) / {g}", "sqrt(s.gx*s.gx + s.gy*s.gy + s.gz*s.gz)"
    acc = "[s.ax, s.ay, s.az]::DOUBLE[]"
    grown = f"CASE WHEN s.g IS NULL THEN CASE WHEN {size} > 0.8 AND {size} < 1.2 THEN {acc} END WHEN {size} > 0.9 AND {size} < 1.1 AND {turn} < 0.2 THEN [s.g[1] + 0.01*(s.ax - s.g[1]), s.g[2] + 0.01*(s.ay - s.g[2]), s.g[3] + 0.01*(s.az - s.g[3])] ELSE s.g END"
    yaw = "CASE WHEN s.g IS NULL THEN n.gz ELSE (s.g[1]*n.gx + s.g[2]*n.gy + s.g[3]*n.gz) / sqrt(s.g[1]*s.g[1] + s.g[2]*s.g[2] + s.g[3]*s.g[3]) END"
    first = f"SELECT trip, f, t, ax, ay, az, gx, gy, gz, fix, NULL::DOUBLE[] AS g, NULL::DOUBLE AS dt, 0.0::DOUBLE AS yaw, {MONITOR_START}, {filter_start()} FROM {frames} WHERE f = 0"
    after = f"SELECT n.trip, n.f, n.t, n.ax, n.ay, n.az, n.gx, n.gy, n.gz, n.fix, {grown} AS g, n.t - s.t AS dt, {yaw} AS yaw, {', '.join(f's.{c}' for c in (*MONITOR, *FILTER))} FROM nv s JOIN {frames} n ON n.trip = s.trip AND n.f = s.f + 1"

    def step(rows: str) -> str:
        q = predict(rows, f"{carried}, {monitor}")
        q = f"SELECT *, {_S} AS det FROM (SELECT *, pow(greatest(fix.accuracy, 1.0), 2) AS noise FROM ({q}))"
        q = f"SELECT {carried}, {monitor}, {state}, {SURPRISE} AS surprise, x3 AS own FROM ({q})"
        q = on_fix(q, f"{carried}, {state}")
        fused = "decision IN ('fuse', 'fuse_inflated')"
        keep = f"{carried}, {monitor}"
        q = reanchor(q, keep, {0: ("fix.e", 5.0), 1: ("fix.n", 5.0), 2: ("0.0", 0.1), 3: ("fix.speed", 0.5)}, "decision = 'reanchor'")
        q = observe_fix(q, keep, "pow(greatest(fix.accuracy * CASE decision WHEN 'fuse_inflated' THEN 2 ELSE 1 END, 1.0), 2)", fused)
        q = observe(q, keep, 3, "(fix.speed - x3)", "0.09", fused)
        q = observe(q, keep, 2, wrap("0 - x2"), "pow(0.02 + 0.5 / fix.speed, 2)", fused, gate=16.0)
        q = tick(q, f"{carried}, {state}")
        return f"SELECT {carried}, {monitor}, {state} FROM ({q})"

    return f"nv AS ({step(first)} UNION ALL {step(after)})"


def street_matching(points: str, travelled: float) -> str:
    """CTEs ``hm`` for matching ``points(trip, i, e, n)`` heading east at 12 m/s to the streets ``lt``, with one-way rules.

    The shortest way between two nodes of the lattice that has streets on all sides is that along its axes.
    """
    back = wrap("psi + pi()")
    turn = f"CASE WHEN oneway = 1 THEN psi WHEN oneway = -1 THEN {back} WHEN abs({wrap('0 - psi')}) <= abs({wrap('0 - ' + back)}) THEN psi ELSE {back} END"
    ends = []
    for e, n, rest in (("c.e1", "c.n1", "c.f * c.length"), ("c.e2", "c.n2", "(1 - c.f) * c.length")):
        for re, rn, off in (("r.e1", "r.n1", "r.f * r.length"), ("r.e2", "r.n2", "(1 - r.f) * r.length")):
            way = f"{off} + abs({e} - {re}) + abs({n} - {rn})"
            ends.append(f"CASE WHEN {way} <= {2 * travelled + 60!r} THEN {way} + {rest} END")
    route = f"CASE WHEN c.seg = r.seg THEN abs(c.f - r.f) * c.length ELSE least({', '.join(f'coalesce({e}, 1e300)' for e in ends)}) END"
    width = math.radians(25.0)
    return f"""cf AS (SELECT trip, i, seg, least(greatest(((e - e1) * (e2 - e1) + (n - n1) * (n2 - n1)) / (length * length), 0), 1) AS f, e, n, lt.* EXCLUDE (seg) FROM {points}, lt WHERE abs(e - (e1 + e2) / 2) < 80 AND abs(n - (n1 + n2) / 2) < 80),
cd AS (SELECT *, e1 + f * (e2 - e1) AS fe, n1 + f * (n2 - n1) AS fn, sqrt(pow(e - (e1 + f * (e2 - e1)), 2) + pow(n - (n1 + f * (n2 - n1)), 2)) AS d FROM cf),
ca AS (SELECT trip, i, seg, f, fe, fn, d, e1, n1, e2, n2, length, {turn} AS road FROM cd WHERE d <= 25 QUALIFY row_number() OVER (PARTITION BY trip, i ORDER BY d, seg) <= 12),
ce AS (SELECT *, -0.5 * pow(d / 5.0, 2) - 0.5 * pow({wrap('0 - road')} / {width!r}, 2) AS emission FROM ca),
hm AS (SELECT *, emission - max(emission) OVER (PARTITION BY trip) AS score FROM ce WHERE i = 0
  UNION ALL SELECT * EXCLUDE (total), total - max(total) OVER (PARTITION BY trip) AS score FROM (
    SELECT * EXCLUDE (reached), emission + CASE WHEN max(reached) OVER (PARTITION BY trip) > -5e8 THEN greatest(reached, -1e9) ELSE 0 END AS total FROM (
      SELECT c.trip, c.i, c.seg, c.f, c.fe, c.fn, c.d, c.e1, c.n1, c.e2, c.n2, c.length, c.road, c.emission, max(CASE WHEN {route} < 1e200 THEN r.score - abs({route} - {travelled!r}) / {8 + 0.25 * travelled!r} ELSE -1e300 END) AS reached
      FROM hm r JOIN ce c ON c.trip = r.trip AND c.i = r.i + 1 GROUP BY ALL)))"""
