"""Replays of many keys within a task: the outages of a scenario hide the fixes of a key's frames, which are then estimated.

A frame reaches its task once, whatever the number of scenarios, and what leaves it are the frames that an outage's
score needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import lockstep

#: What is told of a frame beside its estimate.
TRUTH = ("speed", "valid", "e", "n")


class Followed:
    """The estimator of one scenario over blocks of frames; the key at a block's end goes on in the next."""

    def __init__(self, key: str, make: Callable[[], object] | None, speed_model: bool, streets):
        self.key, self.make, self.speed_model, self.streets = key, make, speed_model, streets
        self.before, self.kernel, self.started = None, None, False

    def states(self, frames: pa.Table, starts: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        """``east, north, mode`` of each frame, and whether it is at or after its key's first fix."""
        goes_on = self.before is not None and frames[self.key][0].as_py() == self.before[0]
        t, has_fix = (frames[c].combine_chunks() for c in ("t", "fix"))
        t, has_fix = t.cast(pa.float64()).to_numpy(zero_copy_only=False), has_fix.is_valid().to_numpy(zero_copy_only=False)
        first = np.minimum.reduceat(np.where(has_fix, t, np.inf), starts)
        if goes_on and self.started:
            first[0] = -np.inf
        self.started = bool(first[-1] < np.inf)
        names = ["east", "north", "mode"]
        if self.make is None:
            out, self.before = lockstep._block(frames, self.key, self.before, names, self.speed_model, self.streets)
        else:
            ends, told = set(starts[0 if not goes_on else 1 :].tolist()), []
            for k, row in enumerate(frames.to_pylist()):
                if k in ends:
                    self.kernel = self.make()
                told.append(self.kernel.update(row))
            out = pa.table({c: [x[c] for x in told] for c in names})
            self.before = (frames[self.key][frames.num_rows - 1].as_py(), None)
        return out, t >= np.repeat(first, np.diff(np.append(starts, len(t))))


def _inside(index: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a frame lies in an outage; they may overlap."""
    return np.searchsorted(np.sort(starts), index, "right") > np.searchsorted(np.sort(ends), index, "right")


def _members(index: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an outage and a frame in it, or the one before, by their places."""
    order = np.argsort(index, kind="stable")
    low, high = (np.searchsorted(index[order], x, "left") for x in (starts - 1, ends))
    n = np.maximum(high - low, 0)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return np.repeat(np.arange(len(starts)), n), order[at]


def outage_frames(batches: Iterator[pa.RecordBatch], key: str, index: str, schema: pa.Schema, make: Callable[[], object] | None, speed_model: bool, net=None, block: int = lockstep.BLOCK) -> Iterator[pa.RecordBatch]:
    """A row for each outage and each frame of it and the one before, as ``keyed.replayed`` tells.

    Rows come by key: first its outages, ``_part`` 0 with ``_scenario, _start, _end``, then its frames in order of time.
    """
    streets = lockstep.Streets(net) if net else None
    planned: dict[object, dict[object, set]] = {}
    scenarios: dict[object, Followed] = {}
    last: tuple | None = None

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal last
        part = rows["_part"].combine_chunks().to_numpy(zero_copy_only=False)
        for x in rows.select([key, "_scenario", "_start", "_end"]).filter(pa.array(part == 0)).to_pylist():
            planned.setdefault(x[key], {}).setdefault(x["_scenario"], set()).add((x["_start"], x["_end"]))
        frames = rows.filter(pa.array(part == 1)).drop_columns(["_part", "_scenario", "_start", "_end"]).combine_chunks()
        if not frames.num_rows:
            return
        codes = frames[key].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        begins = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
        keys = frames[key].take(pa.array(begins)).to_pylist()
        t = frames["t"].combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)
        back = t[1:] < t[:-1]
        back[begins[1:] - 1] = False
        if back.any() or len(set(keys)) < len(keys) or last is not None and keys[0] == last[0] and t[0] < last[1]:
            raise ValueError("frames do not come by key and time")
        last = keys[-1], t[-1]
        spans = list(zip(keys, begins.tolist(), [*begins[1:].tolist(), frames.num_rows], strict=True))
        idx = frames[index].combine_chunks().cast(pa.int64()).to_numpy(zero_copy_only=False)
        for name in dict.fromkeys(s for k in keys for s in planned.get(k, ())):
            own = [(a, b, np.array(sorted(planned[k][name]), dtype=np.int64)) for k, a, b in spans if name in planned.get(k, ())]
            picked = np.concatenate([np.arange(a, b) for a, b, _ in own])
            starts = np.concatenate([[0], np.cumsum([b - a for a, b, _ in own])[:-1]])
            hidden = np.concatenate([_inside(idx[a:b], o[:, 0], o[:, 1]) for a, b, o in own])
            mine = frames.take(pa.array(picked))
            fix = mine["fix"].combine_chunks()
            fix = pc.if_else(pa.array(hidden), pa.scalar(None, fix.type), fix)
            mine = mine.set_column(mine.column_names.index("fix"), "fix", fix)
            states, known = scenarios.setdefault(name, Followed(key, make, speed_model, streets)).states(mine, starts)
            met = [_members(idx[a:b], o[:, 0], o[:, 1]) for a, b, o in own]
            rows_at = np.concatenate([s + f for s, (_, f) in zip(starts, met, strict=True)])
            bounds = np.concatenate([o[w] for (_, _, o), (w, _) in zip(own, met, strict=True)])
            at, unknown = pa.array(rows_at), pa.array(~known[rows_at])
            estimate = {c: pc.if_else(unknown, pa.scalar(None, pa.float64()), states[s].combine_chunks().take(at)) for c, s in (("est_e", "east"), ("est_n", "north"))}
            out = {
                key: mine[key].take(at), "scenario": pa.array([name] * len(rows_at), schema.field("scenario").type), "start": bounds[:, 0], "end": bounds[:, 1], "i": idx[picked][rows_at],
                **{c: mine[c].take(at) for c in TRUTH}, **estimate, "mode": states["mode"].combine_chunks().take(at),
            }
            yield from pa.table([out[c] for c in schema.names], names=schema.names).cast(schema).to_batches(max_chunksize=1 << 14)
        # only the key of the last row may go on
        for k in planned.keys() - {rows[key][rows.num_rows - 1].as_py()}:
            del planned[k]

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= block:
            yield from told(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield from told(pa.Table.from_batches(held))
