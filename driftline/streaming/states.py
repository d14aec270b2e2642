"""What a stream keeps of a kernel between micro-batches: typed columns, no objects.

A :class:`Stored` names the columns and turns a kernel into their values and back. Parameters are not among them: they
come from the code that makes the kernel, so a checkpoint outlives changes of the classes. In a query started within
``stateful.growing_state`` a column may be added at the end; it is null in states that were written before it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Row

from ..operators.kernels import Fix, Match, Navigator, OutageTracker, SpeedEstimate


class Stored(NamedTuple):
    """Columns as DDL; ``taken`` gives their values of a kernel, ``put`` sets a new kernel to a row of them."""

    columns: str
    taken: Callable[[object], tuple]
    put: Callable[[object, Row], None]


def _floats(values) -> list[float] | None:
    return None if values is None else [float(v) for v in values]


def _numbers(record, *names: str) -> tuple | None:
    return None if record is None else tuple(float(getattr(record, n)) for n in names)


_FIX, _ESTIMATE, _MATCH = ("t", "e", "n", "speed", "accuracy"), ("speed", "variance", "p_stationary"), ("e", "n", "psi", "confidence", "distance")


def _doubles(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n}: double" for n in names)


def _navigator_taken(k: Navigator) -> tuple:
    sats, monitor, speeds, roads = k.satellites, k.satellites.monitor, k.speeds, k.roads
    match = None if roads.match is None else (*_numbers(roads.match, *_MATCH), int(roads.match.segment))
    last = {} if roads.matcher is None else roads.matcher.last
    return (
        k.last_t, _floats(k.filter.x), _floats(k.filter.p.ravel()),
        _floats(sats.reference), sats.started, sats.anchors,
        monitor.mode, float(monitor.quality), float(monitor.interval), _numbers(monitor.seen, *_FIX), monitor.seen_at, _numbers(monitor.pending, *_FIX), monitor.rejects,
        _floats(speeds.gravity.g), speeds.decimator.end, _floats(speeds.decimator.sums), speeds.decimator.count,
        [_floats(w) for w in speeds.window], _floats(speeds.yaws), _numbers(speeds.estimate, *_ESTIMATE), speeds.calls,
        match, roads.asked_at, float(roads.travelled), roads.anchors, [(int(s), float(f), float(score)) for s, (f, score) in last.items()],
    )


def _navigator_put(k: Navigator, r: Row) -> None:
    sats, monitor, speeds, roads = k.satellites, k.satellites.monitor, k.speeds, k.roads
    k.last_t = r.last_t
    k.filter.x, k.filter.p = np.array(r.x), np.array(r.p).reshape(len(r.x), -1)
    sats.reference, sats.started, sats.anchors = tuple(r.reference) if r.reference else None, r.started, r.anchors
    monitor.mode, monitor.quality, monitor.interval = r.mode, r.quality, r.interval
    monitor.seen, monitor.seen_at = Fix(*r.seen) if r.seen else None, r.seen_at
    monitor.pending, monitor.rejects = Fix(*r.pending) if r.pending else None, r.rejects
    speeds.gravity.g = tuple(r.gravity) if r.gravity else None
    speeds.decimator.end, speeds.decimator.sums, speeds.decimator.count = r.bin_end, list(r.bin_sums) if r.bin_sums is not None else None, r.bin_count
    speeds.window, speeds.yaws = [list(w) for w in r.window], list(r.yaws)
    speeds.estimate, speeds.calls = SpeedEstimate(*r.estimate) if r.estimate else None, r.model_calls
    roads.match = Match(r.match.e, r.match.n, r.match.psi, r.match.confidence, r.match.segment, r.match.distance) if r.match else None
    roads.asked_at, roads.travelled, roads.anchors = r.asked_at, r.travelled, r.map_anchors
    if roads.matcher is not None:
        roads.matcher.last = {c.segment: (c.fraction, c.score) for c in r.candidates}


#: Changes of mode are not kept: each state row has its mode, and the list would grow without end.
NAVIGATOR = Stored(
    "last_t double, x array<double>, p array<double>, reference array<double>, started boolean, anchors long, "
    f"mode string, quality double, interval double, seen struct<{_doubles(_FIX)}>, seen_at double, pending struct<{_doubles(_FIX)}>, rejects long, "
    "gravity array<double>, bin_end double, bin_sums array<double>, bin_count long, "
    f"window array<array<double>>, yaws array<double>, estimate struct<{_doubles(_ESTIMATE)}>, model_calls long, "
    f"match struct<{_doubles(_MATCH)}, segment: long>, asked_at double, travelled double, map_anchors long, "
    "candidates array<struct<segment: long, fraction: double, score: double>>",
    _navigator_taken,
    _navigator_put,
)


def _tracker_put(k: OutageTracker, r: Row) -> None:
    k.start, k.distance, k.at = r.start, r.distance, tuple(r.at) if r.at else None


OUTAGE = Stored("start long, distance double, at array<double>", lambda k: (k.start, float(k.distance), _floats(k.at)), _tracker_put)
