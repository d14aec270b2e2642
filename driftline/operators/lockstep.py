"""The estimator for many keys side by side, with or without the speed model ``keyed.oracle_model`` and a road map.

A step takes one frame of each key of a block, so that a number of :class:`.kernels.Navigator` is an array over keys
here. What follows from a frame is the same. Blocks have a bounded number of rows; a key that goes on in the next block
takes its state along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.motion import G
from . import kernels as K
from .kernels import BIAS, EAST, HEADING, NORTH, SCALE, SPEED, wrap
from .keyed import ORACLE_STANDING, ORACLE_STD, oracle_model
from .streets import Chains, Streets

#: Rows of a block, and keys below which a step over arrays costs more than one key after the other.
BLOCK, LEAST_KEYS = 1 << 17, 8
MODES = (K.AIDED, K.DEGRADED, K.DEAD_RECKONING, K.REACQUISITION)
_AIDED, _DEGRADED, _DEAD_RECKONING, _REACQUISITION = range(4)
_SENSORS = {"ax": 0.0, "ay": 0.0, "az": 9.81, "gx": 0.0, "gy": 0.0, "gz": 0.0}
_FIX = ("e", "n", "speed", "heading", "accuracy")


class Fixes:
    """A fix of each key, ``t`` NaN where there is none."""

    def __init__(self, n: int):
        self.t, self.e, self.n, self.speed, self.accuracy = (np.full(n, np.nan) for _ in range(5))

    def of(self, k: int) -> K.Fix | None:
        return None if np.isnan(self.t[k]) else K.Fix(*(float(c[k]) for c in (self.t, self.e, self.n, self.speed, self.accuracy)))

    def keep(self, k: int, fix: K.Fix | None) -> None:
        self.t[k] = np.nan
        if fix is not None:
            self.put(k, fix.t, fix.e, fix.n, fix.speed, fix.accuracy)

    def put(self, at, t, e, n, speed, accuracy) -> None:
        self.t[at], self.e[at], self.n[at], self.speed[at], self.accuracy[at] = t, e, n, speed, accuracy

    def consistent(self, at: np.ndarray, t, e, n, speed, accuracy, own_speed, longest: float = 60.0) -> np.ndarray:
        """:func:`.kernels.consistent` with the fixes of the keys ``at``; false where there is none."""
        dt = t - self.t[at]
        moved, slack = np.hypot(e - self.e[at], n - self.n[at]), 3.0 * np.hypot(self.accuracy[at], accuracy)
        near = np.abs(moved - (self.speed[at] + speed) / 2 * dt) < slack + 2.0 * dt
        fastest = np.maximum(np.maximum(own_speed, self.speed[at]), speed)
        far = moved <= np.minimum(60.0, 1.5 * fastest + 3.0) * dt + slack + 10.0
        return (dt > 0) & (dt <= longest) & np.where(dt <= 5.0, near, far)


class States:
    """What :class:`.kernels.Navigator` holds of each key.

    ``speed_model`` says whether frames tell their true speed to the filter; ``streets`` is the road map, if there is one.
    """

    def __init__(self, n: int, speed_model: bool = False, streets: Streets | None = None):
        rules = K.FixMonitor()
        self.speed_model, self.streets = speed_model, streets
        self.x = np.zeros((6, n))
        self.p = np.repeat(np.diag(np.square(K.Filter.START))[:, :, None], n, axis=2)
        self.last_t, self.end, self.seen_at = (np.full(n, np.nan) for _ in range(3))
        self.sums, self.count = np.zeros((6, n)), np.zeros(n)
        self.g = np.full((3, n), np.nan)
        self.interval, self.quality = np.full(n, rules.interval), np.full(n, rules.quality)
        self.mode, self.rejects = np.full(n, MODES.index(rules.mode)), np.zeros(n, dtype=np.int64)
        self.seen, self.pending = Fixes(n), Fixes(n)
        # decimated samples up to a full window, and the sum and number of yaw rates since the last one
        self.window, self.yaw, self.yaws = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n, dtype=np.int64)
        self.estimated, self.estimate = np.zeros(n, dtype=bool), np.full(n, np.nan)
        self.started, self.asked_at, self.travelled, self.map_confidence = np.zeros(n, dtype=bool), np.full(n, np.nan), np.zeros(n), np.zeros(n)
        self.chains = Chains(n)

    def _arrays(self) -> Iterator[tuple[object, str]]:
        for owner in (self, self.seen, self.pending, self.chains):
            for name, value in vars(owner).items():
                if isinstance(value, np.ndarray):
                    yield owner, name

    def one(self, k: int) -> States:
        out = States(1, self.speed_model, self.streets)
        for (mine, name), (its, _) in zip(self._arrays(), out._arrays(), strict=True):
            setattr(its, name, getattr(mine, name)[..., k : k + 1].copy())
        return out

    def put(self, k: int, other: States) -> None:
        for (mine, name), (its, _) in zip(self._arrays(), other._arrays(), strict=True):
            getattr(mine, name)[..., k] = getattr(its, name)[..., 0]

    def navigator(self, k: int) -> K.Navigator:
        """A key's estimator of its own."""
        known = lambda v: None if np.isnan(v) else float(v)
        nav = K.Navigator(oracle_model if self.speed_model else None, self.streets.net if self.streets else None)
        nav.filter.x, nav.filter.p = self.x[:, k].copy(), self.p[:, :, k].copy()
        nav.last_t, bins, monitor = known(self.last_t[k]), nav.speeds.decimator, nav.satellites.monitor
        bins.end, bins.count = known(self.end[k]), int(self.count[k])
        bins.sums = self.sums[:, k].tolist() if bins.count else None
        nav.gravity.g = None if np.isnan(self.g[0, k]) else tuple(self.g[:, k].tolist())
        monitor.mode, monitor.interval, monitor.quality = MODES[self.mode[k]], float(self.interval[k]), float(self.quality[k])
        monitor.seen_at, monitor.rejects = known(self.seen_at[k]), int(self.rejects[k])
        monitor.seen, monitor.pending = self.seen.of(k), self.pending.of(k)
        # the model looks at how long the window is, and at nothing in it
        nav.speeds.window, nav.speeds.yaws = [[]] * int(self.window[k]), [float(self.yaw[k])] + [0.0] * int(self.yaws[k] - 1) if self.yaws[k] else []
        nav.speeds.estimate = oracle_model(None, None, {"true_speed": float(self.estimate[k])}) if self.estimated[k] else None
        nav.satellites.started, roads = bool(self.started[k]), nav.roads
        roads.asked_at, roads.travelled = known(self.asked_at[k]), float(self.travelled[k])
        roads.match = K.Match(0.0, 0.0, 0.0, float(self.map_confidence[k]), 0, 0.0) if self.map_confidence[k] else None
        if self.streets:
            roads.matcher.last = self.chains.last(k)
        return nav

    def keep(self, k: int, nav: K.Navigator) -> None:
        bins, monitor = nav.speeds.decimator, nav.satellites.monitor
        self.x[:, k], self.p[:, :, k] = nav.filter.x, nav.filter.p
        self.last_t[k], self.end[k], self.count[k] = nav.last_t, bins.end, bins.count
        self.sums[:, k] = bins.sums or 0.0
        self.g[:, k] = np.nan if nav.gravity.g is None else nav.gravity.g
        self.mode[k], self.interval[k], self.quality[k] = MODES.index(monitor.mode), monitor.interval, monitor.quality
        self.seen_at[k], self.rejects[k] = np.nan if monitor.seen_at is None else monitor.seen_at, monitor.rejects
        self.seen.keep(k, monitor.seen)
        self.pending.keep(k, monitor.pending)
        speeds, roads = nav.speeds, nav.roads
        self.window[k], self.yaw[k], self.yaws[k] = len(speeds.window), sum(speeds.yaws), len(speeds.yaws)
        self.estimated[k], self.estimate[k] = speeds.estimate is not None, np.nan if speeds.estimate is None else speeds.estimate.speed
        self.started[k], self.asked_at[k], self.travelled[k] = nav.satellites.started, np.nan if roads.asked_at is None else roads.asked_at, roads.travelled
        self.map_confidence[k] = roads.match.confidence if roads.match else 0.0
        if self.streets:
            self.chains.keep(k, roads.matcher.last)

    def down(self, n: int) -> np.ndarray:
        g = self.g[:, :n]
        out = g / np.sqrt(g[0] * g[0] + g[1] * g[1] + g[2] * g[2])
        return np.where(np.isnan(g[0]), np.array([[0.0], [0.0], [1.0]]), out)

    def predict(self, n: int, dt: np.ndarray, yaw: np.ndarray) -> None:
        x, p = self.x[:, :n], self.p[:, :, :n]
        psi, v, scale = x[HEADING].copy(), x[SPEED], x[SCALE]
        east, north, rate = np.cos(psi), np.sin(psi), yaw - x[BIAS]
        east_psi, north_psi, east_v, north_v = -v * north * dt, v * east * dt, east * dt, north * dt
        psi_bias, psi_scale = -(1 + scale) * dt, rate * dt
        x[EAST] += v * east * dt
        x[NORTH] += v * north * dt
        x[HEADING] = np.where(dt > 0, wrap(psi + (1 + scale) * rate * dt), psi)
        # the matrix of the step from both sides; it is one but for these places
        for m in (p, p.transpose(1, 0, 2)):
            m[EAST] += east_psi * m[HEADING] + east_v * m[SPEED]
            m[NORTH] += north_psi * m[HEADING] + north_v * m[SPEED]
            m[HEADING] += psi_bias * m[BIAS] + psi_scale * m[SCALE]
        for k in range(6):
            p[k, k] += K.Filter.GROWTH[k, k] * dt

    def decimate(self, n: int, t: np.ndarray, values: np.ndarray, yaw: np.ndarray, speed: np.ndarray, has_speed: np.ndarray, period: float = 0.1) -> None:
        """Means of samples in bins go on to gravity and, once a window is full, the frame's speed to the filter."""
        self.yaw[:n] += yaw
        self.yaws[:n] += 1
        end, sums, count = self.end[:n], self.sums[:, :n], self.count[:n]
        np.copyto(end, t + period / 2, where=np.isnan(end))
        done = np.flatnonzero((count > 0) & (t >= end))
        if len(done):
            self._gravity(done, sums[:, done] / count[done])
            sums[:, done] = 0.0
            count[done] = 0
            late = done
            while len(late):
                end[late] += period
                late = late[end[late] <= t[late]]
        sums += values
        count += 1
        if len(done):
            self._modelled(done, speed, has_speed)

    def _modelled(self, at: np.ndarray, speed: np.ndarray, has_speed: np.ndarray, size: int = 40, inflation: float = 4.0) -> None:
        yaw = self.yaw[at] / self.yaws[at]
        self.yaw[at], self.yaws[at], self.window[at] = 0.0, 0, np.minimum(self.window[at] + 1, size)
        if not self.speed_model:
            return
        asked = (self.window[at] == size) & has_speed[at]
        at, yaw = at[asked], yaw[asked]
        self.estimated[at], self.estimate[at] = True, speed[at]
        stands = speed[at] < ORACLE_STANDING
        moving, at, yaw = at[~stands], at[stands], yaw[stands]
        self._take(moving, SPEED, speed[moving], max(ORACLE_STD**2 * inflation, 1e-4))
        self._take(at, SPEED, np.zeros(len(at)), K.STANDING_SPEED)
        self._take(at, BIAS, yaw, K.STANDING_BIAS)

    def _gravity(self, at: np.ndarray, means: np.ndarray, rules=K.Gravity()) -> None:
        acc, gyro, g = means[:3], means[3:], self.g[:, at]
        new = np.isnan(g[0])
        size = np.sqrt(np.square(acc).sum(axis=0)) / G
        low, high = (np.where(new, first, later) for first, later in zip(rules.first, rules.later, strict=True))
        fits = (low < size) & (size < high)
        calm = np.sqrt(np.square(gyro).sum(axis=0)) < rules.calm
        self.g[:, at] = np.where(fits & new, acc, np.where(fits & calm & ~new, g + rules.alpha * (acc - g), g))

    def _settle(self, at: np.ndarray) -> None:
        x = self.x
        x[HEADING, at] = wrap(x[HEADING, at])
        x[SPEED, at] = np.maximum(x[SPEED, at], 0.0)
        x[SCALE, at] = np.clip(x[SCALE, at], -0.2, 0.2)

    def _take(self, at: np.ndarray, place: int, values: np.ndarray, noise, gate: float | None = None, circular: bool = False) -> None:
        """One state is told."""
        offset = values - self.x[place, at]
        if circular:
            offset = wrap(offset)
        size = self.p[place, place, at] + noise
        if gate is not None:
            told = ~(offset * offset / size > gate)
            at, offset, size, noise = at[told], offset[told], size[told], np.broadcast_to(noise, told.shape)[told]
        if not len(at):
            return
        p = self.p[:, :, at]
        gain = p[:, place] / size
        self.x[:, at] += gain * offset
        p -= gain[:, None] * p[place][None]
        p -= p[:, place][:, None] * gain[None]
        p += noise * gain[:, None] * gain[None]
        self.p[:, :, at] = p
        self._settle(at)

    def _take_line(self, at: np.ndarray, e: np.ndarray, n: np.ndarray, psi: np.ndarray, std: np.ndarray) -> None:
        """:func:`.kernels.road_told` of each key ``at``."""
        h_e, h_n, noise = -np.sin(psi), np.cos(psi), std * std
        offset = h_e * (e - self.x[EAST, at]) + h_n * (n - self.x[NORTH, at])
        p = self.p[:, :, at]
        cross = p[:, EAST] * h_e + p[:, NORTH] * h_n
        size = h_e * cross[EAST] + h_n * cross[NORTH] + noise
        told = ~(offset * offset / size > K.GATE)
        at, offset, noise, h_e, h_n = (c[told] for c in (at, offset, noise, h_e, h_n))
        if not len(at):
            return
        p, gain = p[:, :, told], cross[:, told] / size[told]
        self.x[:, at] += gain * offset
        p = p - gain[:, None] * (h_e * p[EAST] + h_n * p[NORTH])[None]
        p = p - (p[:, EAST] * h_e + p[:, NORTH] * h_n)[:, None] * gain[None]
        self.p[:, :, at] = p + noise * gain[:, None] * gain[None]
        self._settle(at)

    def mapped(self, n: int, t: np.ndarray, moved: np.ndarray, period: float = 0.5, least: float = 0.4) -> None:
        """The road map is asked where it is time; it counts while reception is lost and the match is sure enough."""
        self.travelled[:n] += moved
        at = np.flatnonzero(self.started[:n] & ~(t - self.asked_at[:n] < period))
        if not len(at):
            return
        x, p = self.x, self.p
        std = np.sqrt(np.maximum(p[EAST, EAST, at] + p[NORTH, NORTH, at], 0.0))
        e, north, psi, sure = self.chains.step(self.streets, at, x[EAST, at], x[NORTH, at], x[HEADING, at], x[SPEED, at], self.travelled[at], std)
        self.asked_at[at], self.travelled[at], self.map_confidence[at] = t[at], 0.0, sure
        lost = (self.mode[at] == _DEAD_RECKONING) | (self.mode[at] == _REACQUISITION)
        told = (sure >= least) & lost
        at, e, north, psi, sure = (c[told] for c in (at, e, north, psi, sure))
        if not len(at):
            return
        self._take_line(at, e, north, psi, 3.0 / sure)
        turned = (sure > 0.8) & (x[SPEED, at] > 3.0)
        self._take(at[turned], HEADING, psi[turned], np.square(math.radians(6.0) / sure[turned]), K.GATE, True)

    def _innovation(self, at: np.ndarray, e: np.ndarray, n: np.ndarray, noise: np.ndarray):
        """Residuals of a place, the inverse of their covariance and the normalised square."""
        de, dn = e - self.x[EAST, at], n - self.x[NORTH, at]
        a, b, c, d = (self.p[i, j, at] for i, j in ((EAST, EAST), (EAST, NORTH), (NORTH, EAST), (NORTH, NORTH)))
        a, d = a + noise, d + noise
        det = a * d - b * c
        inverse = np.array([[d / det, -b / det], [-c / det, a / det]])
        return np.stack([de, dn]), inverse, de * (inverse[0, 0] * de + inverse[0, 1] * dn) + dn * (inverse[1, 0] * de + inverse[1, 1] * dn)

    def _take_place(self, at: np.ndarray, e: np.ndarray, n: np.ndarray, std: np.ndarray) -> None:
        noise = np.maximum(std, 1.0) ** 2
        offset, inverse, _ = self._innovation(at, e, n, noise)
        p = self.p[:, :, at]
        cross = p[:, [EAST, NORTH]]
        gain = np.stack([cross[:, 0] * inverse[0, j] + cross[:, 1] * inverse[1, j] for j in range(2)], axis=1)
        self.x[:, at] += gain[:, 0] * offset[0] + gain[:, 1] * offset[1]
        p = p - gain[:, 0][:, None] * p[EAST][None] - gain[:, 1][:, None] * p[NORTH][None]
        p = p - p[:, EAST][:, None] * gain[:, 0][None] - p[:, NORTH][:, None] * gain[:, 1][None]
        self.p[:, :, at] = p + noise * (gain[:, 0][:, None] * gain[:, 0][None] + gain[:, 1][:, None] * gain[:, 1][None])
        self._settle(at)

    def _anchor(self, at: np.ndarray, e, n, course, speed) -> None:
        for place, value, deviation in ((EAST, e, K.ANCHOR_PLACE), (NORTH, n, K.ANCHOR_PLACE), (HEADING, course, K.ANCHOR_HEADING), (SPEED, speed, K.ANCHOR_SPEED)):
            known = ~np.isnan(value)
            own = at[known]
            self.x[place, own] = value[known]
            self.p[place, :, own] = self.p[:, place, own].T * 0.0
            self.p[:, place, own] = 0.0
            self.p[place, place, own] = deviation**2
        self._settle(at)

    def fixed(self, at: np.ndarray, t, e, n, speed, heading, accuracy) -> None:
        """A fix of each key ``at``; ``speed``, ``heading`` and ``accuracy`` are NaN where they are not told."""
        rules = K.FixMonitor()
        self.started[at] = True
        std = np.where(np.isnan(accuracy), 10.0, accuracy)
        moving = speed > 2.0
        course = np.where(moving, wrap(math.pi / 2 - np.radians(heading)), np.nan)
        good = ~(std > rules.worst_accuracy)
        if not good.all():
            at, t, e, n, speed, std, moving, course = (c[good] for c in (at, t, e, n, speed, std, moving, course))
        if not len(at):
            return
        surprise = self._innovation(at, e, n, np.maximum(std, 1.0) ** 2)[2]
        own = self.x[SPEED, at]
        mode, interval, seen_at = self.mode[at], self.interval[at], self.seen_at[at]
        longest = np.where(interval > 3.0, 15.0, 5.0)
        self.interval[at] = np.where(np.isnan(seen_at), interval, interval + 0.2 * (np.minimum(np.maximum(t - seen_at, 0.1), longest) - interval))
        self.seen_at[at] = t
        agrees = surprise <= rules.gate
        first = np.isnan(self.seen.t[at])
        aided = (mode == _AIDED) | (mode == _DEGRADED)
        rejects = self.rejects[at] + (~agrees & aided & ~first)
        fix = (t, e, n, np.where(np.isnan(speed), 0.0, speed), std)
        fits_pending, fits_seen = self.pending.consistent(at, *fix, own), self.seen.consistent(at, *fix, own)
        poor = std > rules.degraded_accuracy
        lost, aided = ~first & ~aided, ~first & aided
        again = aided & ~agrees & (rejects >= rules.most_rejects) & fits_seen
        waits = lost & ~agrees & ~fits_pending
        refused = waits | aided & ~agrees & ~again
        anchored = first | again | lost & ~agrees & fits_pending
        inflated = aided & agrees & poor
        mode = np.where(first | lost & ~waits | aided & agrees, _AIDED, mode)
        self.mode[at] = np.where(waits, _REACQUISITION, np.where(inflated, _DEGRADED, mode))
        told = np.minimum(1.0, np.maximum(0.1, 1.0 - (std - 3.0) / 25.0))
        self.quality[at] = np.maximum(0.0, told * np.where(waits, 0.5, 1.0) - np.where(aided & ~agrees, 0.2, 0.0) * rejects)
        self.rejects[at] = np.where(aided & agrees | again | lost & ~agrees & fits_pending, 0, rejects)
        self.pending.put(at[waits], *(c[waits] for c in fix))
        kept = ~waits
        self.seen.put(at[kept], *(c[kept] for c in fix))
        self.pending.t[at[kept]] = np.nan
        if anchored.any():
            self._anchor(at[anchored], e[anchored], n[anchored], course[anchored], speed[anchored])
            self.chains.segment[:, at[anchored]] = -1  # a jump is no route
        fused = ~anchored & ~refused
        if fused.any():
            at, e, n, std, speed, course, moving, inflated = (c[fused] for c in (at, e, n, std, speed, course, moving, inflated))
            self._take_place(at, e, n, std * np.where(inflated, 2.0, 1.0))
            psi = np.where(np.isnan(course), self.x[HEADING, at], course)
            has = ~np.isnan(speed)
            self._take(at[has], SPEED, speed[has], K.FIX_SPEED)
            spread = K.COURSE_STD + K.COURSE_STD_MPS / speed[moving]
            self._take(at[moving], HEADING, psi[moving], spread * spread, K.GATE, True)

    def tick(self, n: int, t: np.ndarray) -> None:
        rules = K.FixMonitor
        silent = np.isnan(self.seen_at[:n]) | (t - self.seen_at[:n] > rules.patience * np.maximum(self.interval[:n], 0.1))
        self.mode[:n][silent] = _DEAD_RECKONING
        self.quality[:n][silent] = 0.0


def follow(states: States, starts: np.ndarray, sizes: np.ndarray, t: np.ndarray, sensors: np.ndarray, has_fix: np.ndarray, fix: np.ndarray, speed: np.ndarray, has_speed: np.ndarray) -> dict[str, np.ndarray]:
    """The states after each row of a block; key ``k`` has ``sizes[k]`` rows from ``starts[k]`` on, longest keys first."""
    out = {c: np.empty(len(t)) for c in ("east", "north", "speed", "psi", "quality", "position_std", "model_speed", "model_confidence", "map_confidence")}
    confidence = K.SpeedEstimate(0.0, ORACLE_STD**2, 0.0).confidence()
    out["mode"] = np.empty(len(t), dtype=np.int8)
    for step in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -step, "left"))
        if n < LEAST_KEYS:
            for k in range(n):
                _alone(states, k, range(starts[k] + step, starts[k] + sizes[k]), t, sensors, has_fix, fix, speed, has_speed, out)
            break
        rows = starts[:n] + step
        now, seen = t[rows], sensors[:, rows]
        yaw = (states.down(n) * seen[3:]).sum(axis=0)
        dt = now - states.last_t[:n]
        dt = np.where((dt > 0) & (dt < 1), dt, 0.0)
        states.predict(n, dt, yaw)
        states.last_t[:n] = now
        moved = states.x[SPEED, :n] * dt
        states.decimate(n, now, seen, yaw, speed[rows], has_speed[rows])
        at = np.flatnonzero(has_fix[rows])
        if len(at):
            states.fixed(at, now[at], *fix[:, rows[at]])
        states.tick(n, now)
        if states.streets:
            states.mapped(n, now, moved)
        x, p = states.x[:, :n], states.p
        for name, values in (
            ("east", x[EAST]), ("north", x[NORTH]), ("speed", x[SPEED]), ("psi", x[HEADING]), ("quality", states.quality[:n]), ("mode", states.mode[:n]),
            ("model_speed", states.estimate[:n]), ("model_confidence", np.where(states.estimated[:n], confidence, 0.0)), ("map_confidence", states.map_confidence[:n]),
            ("position_std", np.sqrt(np.maximum(p[EAST, EAST, :n] + p[NORTH, NORTH, :n], 0.0))),
        ):
            out[name][rows] = values
    return out


def _alone(states: States, k: int, rows: range, t: np.ndarray, sensors: np.ndarray, has_fix: np.ndarray, fix: np.ndarray, speed: np.ndarray, has_speed: np.ndarray, out: dict[str, np.ndarray]) -> None:
    """One key's last rows in a block, by its own estimator."""
    nav = states.navigator(k)
    for row in rows:
        told = {c: None if np.isnan(v) else v for c, v in zip(_FIX, fix[:, row].tolist(), strict=True)} if has_fix[row] else None
        frame = {"t": t[row], "fix": told, "true_speed": float(speed[row]) if has_speed[row] else None}
        state = nav.update(frame | dict(zip(_SENSORS, sensors[:, row].tolist(), strict=True)))
        for c, values in out.items():
            values[row] = MODES.index(state[c]) if c == "mode" else np.nan if state[c] is None else state[c]
    states.keep(k, nav)


def _numbers(column, default: float = np.nan) -> np.ndarray:
    return pc.fill_null(column.cast(pa.float64()), default).to_numpy(zero_copy_only=False)


def _block(table: pa.Table, key: str, before: tuple | None, names: list[str], speed_model: bool, streets: Streets | None) -> tuple[pa.Table, tuple]:
    """The output of a block, and its last key with its state; ``before`` is that of the block before."""
    table = table.combine_chunks()
    column = lambda c: table[c].combine_chunks()
    if table["t"].null_count:
        raise TypeError("a frame has no time")
    rows = table.num_rows
    t = _numbers(column("t"))
    sensors = np.stack([_numbers(column(c), d) if c in table.column_names else np.full(rows, d) for c, d in _SENSORS.items()])
    has_fix, fix = np.zeros(rows, dtype=bool), np.full((len(_FIX), rows), np.nan)
    if "fix" in table.column_names and pa.types.is_struct(table["fix"].type):
        fixes = column("fix")
        has_fix = fixes.is_valid().to_numpy(zero_copy_only=False)
        for k, c in enumerate(_FIX):
            if fixes.type.get_field_index(c) >= 0:
                fix[k] = _numbers(pc.struct_field(fixes, c))
                if k < 2 and int(pc.sum(pc.struct_field(fixes, c).is_valid()).as_py() or 0) < has_fix.sum():
                    raise TypeError("a fix has no place")
    speed, has_speed = np.full(rows, np.nan), np.zeros(rows, dtype=bool)
    if "true_speed" in table.column_names:
        speed, has_speed = _numbers(column("true_speed")), column("true_speed").is_valid().to_numpy(zero_copy_only=False)
    codes = column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
    sizes = np.diff(np.append(starts, rows))
    order = np.argsort(-sizes, kind="stable")
    states = States(len(starts), speed_model, streets)
    first, last = (int(np.flatnonzero(order == k)[0]) for k in (0, len(starts) - 1))
    if before is not None and table[key][0].as_py() == before[0]:
        states.put(first, before[1])
    out = follow(states, starts[order], sizes[order], t, sensors, has_fix, fix, speed, has_speed)
    out["mode"] = pa.DictionaryArray.from_arrays(out["mode"], list(MODES)).cast(pa.string())
    out |= {"t": t, "model_speed": pa.array(out["model_speed"], mask=out["model_confidence"] == 0.0), key: column(key)}
    return pa.table([pa.array(out[c]) if isinstance(out[c], np.ndarray) else out[c] for c in names], names=names), (table[key][rows - 1].as_py(), states.one(last))


def estimated(batches: Iterator[pa.RecordBatch], key: str, schema: pa.Schema, block: int = BLOCK, speed_model: bool = False, net: K.RoadNet | None = None) -> Iterator[pa.RecordBatch]:
    """States for frames that come by key and time."""
    streets = Streets(net) if net else None
    held: list[pa.RecordBatch] = []
    before, n = None, 0

    def told() -> Iterator[pa.RecordBatch]:
        nonlocal before, n
        out, before = _block(pa.Table.from_batches(held), key, before, schema.names, speed_model, streets)
        held.clear()
        n = 0
        yield from out.cast(schema).to_batches(max_chunksize=1 << 14)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= block:
            yield from told()
    if n:
        yield from told()
