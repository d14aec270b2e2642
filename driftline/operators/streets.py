"""A road map asked for many vehicles at once, for :mod:`.lockstep`.

What follows for a vehicle is what :class:`.kernels.Matcher` finds. Candidates of all vehicles are rows of flat arrays,
in order of vehicle and distance. Distances between nodes are found once, by node, and kept up to a bound.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

from .kernels import _UNREACHED, RoadNet, wrap

#: Bounds of what is kept: numbers of segments in lists of cells, and pairs of nodes.
MOST_LISTED, MOST_PAIRS = 1 << 22, 1 << 20
#: Fixed values, as those of :class:`.kernels.Matcher`: candidates, deviation of headings, least deviation of a place.
MOST, HEADING_RAD, LEAST_SIGMA = 12, math.radians(25.0), 4.0


class Streets:
    def __init__(self, net: RoadNet):
        self.net = net
        self._listed: dict[tuple[int, int, int], np.ndarray] = {}
        self._size = 0
        self._pairs: dict[int, float] = {}
        self._reach: dict[int, float] = {}

    def _around(self, place: tuple[int, int, int]) -> np.ndarray:
        """Segments in the cells around one, in order."""
        found = self._listed.get(place)
        if found is None:
            x, y, reach = place
            cells = [self.net.by_cell.get((a, b), ()) for a in range(x - reach, x + reach + 1) for b in range(y - reach, y + reach + 1)]
            found = np.array(sorted({i for c in cells for i in c}), dtype=int)
            if self._size > MOST_LISTED:
                self._listed, self._size = {}, 0
            self._listed[place] = found
            self._size += len(found) + 1
        return found

    def near(self, e: np.ndarray, n: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, ...]:
        """:meth:`.kernels.RoadNet.near` of many places: place, rank from 0, segment, distance, fraction and foot."""
        net = self.net
        cells = (np.floor_divide(e, net.cell), np.floor_divide(n, net.cell), np.ceil(radius / net.cell))
        lists = [self._around(c) for c in zip(*(c.astype(int).tolist() for c in cells), strict=True)]
        at = np.repeat(np.arange(len(e)), [len(x) for x in lists])
        found = np.concatenate(lists)
        here = np.stack([e, n], axis=1)[at]
        f = np.clip(((here - net.start[found]) * net.along[found]).sum(axis=1) / net.size[found], 0.0, 1.0)
        feet = net.start[found] + f[:, None] * net.along[found]
        d = np.hypot(*(here - feet).T)
        kept = np.flatnonzero(d <= radius[at])
        kept = kept[np.lexsort((found[kept], d[kept], at[kept]))]
        at = at[kept]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        few = rank < MOST
        kept = kept[few]
        return at[few], rank[few], found[kept], d[kept], f[kept], feet[kept]

    def _follow(self, node: int, cutoff: float) -> None:
        """Keeps the distances from a node to all nodes within the cutoff."""
        nodes = len(self.net.edges)
        known, heap = {node: 0.0}, [(0.0, node)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > known[a]:
                continue
            for b, more in self.net.edges[a]:
                if d + more <= cutoff and d + more < known.get(b, math.inf):
                    known[b] = d + more
                    heapq.heappush(heap, (d + more, b))
        self._reach[node] = cutoff
        self._pairs.update((node * nodes + b, d) for b, d in known.items())

    def between(self, a: np.ndarray, b: np.ndarray, cutoff: np.ndarray) -> np.ndarray:
        """Driving distances between nodes, exact where at most the cutoff. One-way rules are not looked at."""
        if len(self._pairs) > MOST_PAIRS:
            self._pairs, self._reach = {}, {}
        order = np.lexsort((-cutoff, a))
        first = order[np.flatnonzero(np.diff(a[order], prepend=-1))]
        for node, most in zip(a[first].tolist(), cutoff[first].tolist(), strict=True):
            if self._reach.get(node, -1.0) < most:
                self._follow(node, 2.0 ** math.ceil(math.log2(max(most, 1.0))))
        get = self._pairs.get
        return np.array([get(k, math.inf) for k in (a * len(self.net.edges) + b).tolist()])

    def routes(self, before: np.ndarray, at: np.ndarray, segments: np.ndarray, fractions: np.ndarray, cutoff: np.ndarray) -> np.ndarray:
        """Driving distances from places on segments to others; infinite where a node of the latter is beyond the cutoff."""
        net = self.net
        out = np.where(segments == before, np.abs(fractions - at) * net.length[segments], math.inf)
        for i, off in enumerate((at * net.length[before], (1 - at) * net.length[before])):
            rows = np.flatnonzero((segments != before) & (off <= cutoff))
            if not len(rows):
                continue
            ends = net.nodes[segments[rows]]
            start = np.repeat(net.nodes[before[rows], i], 2)
            left = np.repeat(cutoff[rows], 2)
            way = (np.repeat(off[rows], 2) + self.between(start, ends.ravel(), left)).reshape(-1, 2)
            way[way > cutoff[rows][:, None]] = math.inf
            rest = np.stack([fractions[rows], 1 - fractions[rows]], axis=1) * net.length[segments[rows]][:, None]
            out[rows] = np.minimum(out[rows], (way + rest).min(axis=1))
        return out


class Chains:
    """What :class:`.kernels.Matcher` holds of each of ``n`` vehicles: the last candidates, with -1 for none."""

    def __init__(self, n: int):
        self.segment, self.fraction, self.score = np.full((MOST, n), -1), np.zeros((MOST, n)), np.zeros((MOST, n))

    def last(self, k: int) -> dict[int, tuple[float, float]]:
        has = self.segment[:, k] >= 0
        told = zip(self.fraction[has, k].tolist(), self.score[has, k].tolist(), strict=True)
        return dict(zip(self.segment[has, k].tolist(), told, strict=True))

    def keep(self, k: int, last: dict[int, tuple[float, float]]) -> None:
        self.segment[:, k] = -1
        if last:
            self.segment[: len(last), k] = list(last)
            self.fraction[: len(last), k], self.score[: len(last), k] = np.array(list(last.values())).T

    def step(self, streets: Streets, own: np.ndarray, e, n, psi, speed, travelled, std) -> tuple[np.ndarray, ...]:
        """:meth:`.kernels.Matcher.step` of the vehicles ``own``: place, heading and confidence, which is 0 without a road."""
        net, sigma = streets.net, np.maximum(LEAST_SIGMA, std)
        at, rank, segments, distances, fractions, feet = streets.near(e, n, np.minimum(np.maximum(3 * sigma, 25.0), 120.0))
        out = np.zeros((4, len(own)))
        if not len(at):
            self.segment[:, own] = -1
            return tuple(out)
        begins = np.flatnonzero(rank == 0)
        whole = np.diff(np.append(begins, len(at)))
        places = at[begins]
        along, oneway = net.psi[segments], net.oneway[segments]
        back = wrap(along + math.pi)
        nearer = np.abs(wrap(psi[at] - along)) <= np.abs(wrap(psi[at] - back))
        roads = np.where((oneway == 1) | ((oneway == 0) & nearer), along, back)
        scores = -0.5 * np.square(distances / sigma[at])
        scores = np.where(speed[at] > 2.0, scores - 0.5 * np.square(wrap(psi[at] - roads) / HEADING_RAD), scores)
        came = self._came(streets, own, at, segments, fractions, travelled)
        led = np.repeat(np.maximum.reduceat(came, begins) > _UNREACHED / 2, whole)
        scores = np.where(led, scores + np.maximum(came, _UNREACHED), scores)
        scores -= np.repeat(np.maximum.reduceat(scores, begins), whole)
        table = np.full((len(own), MOST), -np.inf)
        table[at, rank] = scores
        best = begins + table[places].argmax(axis=1)
        of = np.repeat(best, whole)
        same = (np.hypot(*(feet - feet[of]).T) < 3.0) & (np.abs(wrap(roads - roads[of])) < math.radians(20.0))
        mass = np.exp(scores)
        self.segment[:, own] = -1
        self.segment[rank, own[at]], self.fraction[rank, own[at]], self.score[rank, own[at]] = segments, fractions, scores
        out[:, places] = *feet[best].T, roads[best], np.add.reduceat(np.where(same, mass, 0.0), begins) / np.add.reduceat(mass, begins)
        return tuple(out)

    def _came(self, streets: Streets, own: np.ndarray, at: np.ndarray, segments: np.ndarray, fractions: np.ndarray, travelled: np.ndarray) -> np.ndarray:
        """Best log score of coming to each candidate from the last ones, minus infinity where no route leads."""
        count = (self.segment[:, own] >= 0).sum(axis=0)[at]
        came = np.full(len(at), -np.inf)
        pairs = np.repeat(np.arange(len(at)), count)
        if not len(pairs):
            return came
        first = np.cumsum(count) - count
        j, k, told = np.arange(len(pairs)) - first[pairs], own[at[pairs]], travelled[at[pairs]]
        routes = streets.routes(self.segment[j, k], self.fraction[j, k], segments[pairs], fractions[pairs], 2 * told + 60)
        has = np.flatnonzero(count)
        came[has] = np.maximum.reduceat(self.score[j, k] - np.abs(routes - told) / (8 + 0.25 * told), first[has])
        return came
