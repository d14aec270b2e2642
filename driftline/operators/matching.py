"""Map matching by a hidden Markov model over whole trips, as (max, +) products of score matrices.

A step's candidates are the nearest segments. From one step to the next each pair of candidates has a score by how far
the shortest route between them is from the distance travelled. The matrices of a block of steps are multiplied in
(max, +) arithmetic on their own, which gives for each candidate before the block the best score of coming to each one
at its end, and the step at which the last route from it ends. A scan over the blocks, one small row each, gives the
scores that every block begins with; then each block finds its own steps' posteriors, many blocks side by side. A trip
of one block needs the latter only. Candidates and routes are made by joins; a trip of any length spreads over as many
tasks as it has blocks.

Where no candidate of a step can be reached, or a step or the one before it has none, the chain starts anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import wrap_pi
from ..sources.tables import drop_table, shared_table
from . import roads, scans
from .keyed import run_by_key, ship_package

#: Steps of a block, candidates of a step, blocks that are followed side by side, pairs of segments that are broadcast.
BLOCK, MOST_CANDIDATES, SIDE_BY_SIDE, MOST_PAIRS = 128, 12, 2048, 200_000
#: Least deviation of a position, bounds of the search radius, deviation of headings, least speed that has one.
LEAST_SIGMA, LEAST_RADIUS, MOST_RADIUS, SIGMA_HEADING_DEG, LEAST_SPEED = 4.0, 25.0, 120.0, 25.0, 2.0
SAME_ROAD_M, SAME_ROAD_DEG = 3.0, 20.0


def _sigma() -> Column:
    return F.greatest(F.coalesce(F.col("std"), F.lit(0.0)), F.lit(LEAST_SIGMA))


def candidates(points: DataFrame, segments: DataFrame) -> DataFrame:
    """``point, rank, segment, fraction, foot_e, foot_n, road_psi, emission`` of each point's nearest segments.

    ``points`` has ``point, e, n, psi, speed, std``; ``segments`` has ``segment, e1, n1, e2, n2, psi, oneway``.
    """
    lines = segments.select("segment", "e1", "n1", "e2", "n2", F.col("psi").alias("road"), "oneway")
    radius = F.least(F.greatest(3 * _sigma(), F.lit(LEAST_RADIUS)), F.lit(MOST_RADIUS))
    # cells are looked up as far around as the least certain point needs
    near = roads.nearby(points, lines, "point", "segment", points.agg(F.max(radius)).first()[0] or LEAST_RADIUS)
    near = roads.nearest(near.where(F.col("distance") <= radius), "point", "segment", MOST_CANDIDATES)
    scored = roads.emission_scores(near, _sigma(), SIGMA_HEADING_DEG, LEAST_SPEED)
    return scored.select("point", "rank", "segment", "fraction", "foot_e", "foot_n", "road_psi", F.col("score").alias("emission"))


def segment_distances(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """``scale, from_segment, segment, from_length, length`` and ``d11, d12, d21, d22`` of pairs of segments.

    ``d12`` is the driving distance from the earlier segment's first node to the later one's second node, where it is at
    most 2 to the power of ``scale``, and null otherwise. One-way rules are not looked at. The rows are bounded by the
    map, not by the trips on it. ``pairs`` has ``scale, from_segment, segment``, each once; ``segment`` is unique in
    ``segments``.
    """
    spark, names = pairs.sparkSession, ["scale", "from_segment", "segment"]
    lines = segments.select("segment", "node1", "node2", "length")
    pairs = pairs.join(lines.select(*[F.col(c).alias(f"from_{c}") for c in lines.columns]), "from_segment").join(lines, "segment")
    pairs = shared_table(spark, pairs, "route-pairs")
    end = lambda c: F.explode(F.array(*[F.struct(F.lit(k).alias("end"), F.col(f"{c}{k}").alias("node")) for k in (1, 2)]))
    ends = pairs.where("segment <> from_segment").select(*names, end("from_node").alias("a"), "node1", "node2").select(*names, "a", end("node").alias("b"))
    ends = ends.select(*names, F.concat_ws("|", "scale", "a.node").alias("source"), F.col("a.node").alias("start"), F.col("b.node").alias("node"), F.concat(F.lit("d"), "a.end", "b.end").alias("d"))
    starts = ends.select("source", F.col("start").alias("node"), F.lit(0.0).alias("distance"), F.pow(F.lit(2.0), F.col("scale")).alias("cutoff")).distinct()
    known = roads.bounded_distances(starts, segments.select(F.col("node1").alias("a"), F.col("node2").alias("b"), "length"), "cutoff")
    told = [F.min(F.when(F.col("d") == d, F.col("distance"))).alias(d) for d in ("d11", "d12", "d21", "d22")]
    met = ends.join(known, ["source", "node"]).groupBy(*names).agg(*told)
    out = shared_table(spark, pairs.select(*names, "from_length", "length").join(met, names, "left"), "route-distances")
    drop_table(pairs)
    return out


def routes(moves: DataFrame, segments: DataFrame) -> DataFrame:
    """``point, from_rank, rank, travelled, route`` from pairs of candidates of consecutive steps, where a route is short enough.

    ``moves`` has ``point, travelled`` and the candidates of a step and the one before, ``cands`` and ``before``, each
    with ``rank, segment, fraction``. The way to a node of the later segment is at most twice the distance travelled and
    60 m. Distances between nodes are found once for all steps whose bound is of one power of two.
    """
    cutoff = 2 * F.col("travelled") + 60
    scale = F.ceil(F.log2(F.greatest(cutoff, F.lit(1.0)))).cast("int")
    both = moves.select("point", "travelled", scale.alias("scale"), "cands", F.explode("before").alias("b")).select("point", "travelled", "scale", "b", F.explode("cands").alias("c"))
    both = both.select("point", "travelled", "scale", F.col("b.rank").alias("from_rank"), F.col("b.segment").alias("from_segment"), F.col("b.fraction").alias("from_fraction"), "c.rank", "c.segment", "c.fraction")
    known = segment_distances(both.select("scale", "from_segment", "segment").distinct(), segments)
    known = F.broadcast(known) if known.count() <= MOST_PAIRS else known.hint("merge")
    off = {"1": F.col("from_fraction") * F.col("from_length"), "2": (1 - F.col("from_fraction")) * F.col("from_length")}
    rest = {"1": F.col("fraction") * F.col("length"), "2": (1 - F.col("fraction")) * F.col("length")}
    ways = [F.when(off[a] + F.col(f"d{a}{b}") <= cutoff, off[a] + F.col(f"d{a}{b}") + rest[b]) for a in "12" for b in "12"]
    same = F.abs(F.col("fraction") - F.col("from_fraction")) * F.col("length")
    route = F.when(F.col("segment") == F.col("from_segment"), same).otherwise(F.least(*ways))
    met = both.join(known, ["scale", "from_segment", "segment"])
    return met.select("point", "from_rank", "rank", "travelled", route.alias("route")).where(F.col("route").isNotNull())


def _steps(points: DataFrame, segments: DataFrame, key: str, order: str) -> DataFrame:
    """A row for each block of steps: ``key, block, steps``, each with its candidates and moves in flat arrays."""
    spark = points.sparkSession
    cut = scans.Stretches(points, key, order).running_sum(F.lit(1).cast("long"), "_i")
    rows = cut.done().select(key, order, (F.col("_i") - 1).alias("i"), "e", "n", "psi", "speed", "travelled", "std").withColumn("point", F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\0")), "i"))
    rows = shared_table(spark, rows, "match-points")
    item = F.struct("rank", "segment", "fraction", "foot_e", "foot_n", "road_psi", "emission")
    has = candidates(rows, segments).groupBy("point").agg(F.sort_array(F.collect_list(item)).alias("cands"))
    step = shared_table(spark, rows.join(has, "point", "left").select(key, order, "i", "point", "travelled", "cands"), "match-steps")
    place = F.transform("cands", lambda c: F.struct(c["rank"].alias("rank"), c["segment"].alias("segment"), c["fraction"].alias("fraction")))
    placed = step.where(F.col("cands").isNotNull()).select(key, "i", "point", "travelled", place.alias("cands"))
    earlier = placed.select(F.col(key).alias("_key"), (F.col("i") + 1).alias("_i"), F.col("cands").alias("before"))
    moves = placed.join(earlier, F.col(key).eqNullSafe(F.col("_key")) & (F.col("i") == F.col("_i"))).select("point", "travelled", "cands", "before")
    moves = shared_table(spark, moves, "match-moves")
    score = -F.abs(F.col("route") - F.col("travelled")) / (8 + 0.25 * F.col("travelled"))
    of_step = routes(moves, segments).groupBy("point").agg(F.collect_list(F.struct("from_rank", "rank", score.alias("score"))).alias("moves"))
    told = F.transform("cands", lambda c: c.dropFields("fraction"))
    step_ = step.join(of_step, "point", "left").select(key, order, "i", told.alias("cands"), "moves")
    out = step_.groupBy(key, F.floor(F.col("i") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", F.col(order).alias("at"), "cands", "moves"))).alias("steps"))
    out = shared_table(spark, out, "match-blocks")
    for t in (rows, step, moves):
        drop_table(t)
    return out


class Steps:
    """The steps of some blocks, from a column of lists, as flat arrays; candidates and moves in the order of steps."""

    def __init__(self, column: pa.Array):
        numbers = lambda a, c: pc.struct_field(a, c).to_numpy(zero_copy_only=False)
        self.sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        self.first = np.cumsum(self.sizes) - self.sizes
        steps = pc.list_flatten(column)
        self.at = pc.struct_field(steps, "at")
        cands, moves = pc.struct_field(steps, "cands"), pc.struct_field(steps, "moves")
        self.step, found = pc.list_parent_indices(cands).to_numpy(), pc.list_flatten(cands)
        self.rank, self.segment = numbers(found, "rank") - 1, pc.struct_field(found, "segment").cast(pa.int64())
        self.foot_e, self.foot_n, self.road, self.emission = (numbers(found, c) for c in ("foot_e", "foot_n", "road_psi", "emission"))
        self.cands = np.bincount(self.step, minlength=len(steps))
        self.move, found = pc.list_parent_indices(moves).to_numpy(), pc.list_flatten(moves)
        self.from_rank, self.to_rank, self.score = numbers(found, "from_rank") - 1, numbers(found, "rank") - 1, numbers(found, "score")

    def of(self, block: int) -> list[dict]:
        """A block's steps for :func:`block_map`."""
        out, width = [], None
        for t in range(self.first[block], self.first[block] + self.sizes[block]):
            found, went = (slice(*np.searchsorted(c, (t, t + 1))) for c in (self.step, self.move))
            if width is None:
                width = self.from_rank[went].max(initial=-1) + 1
            m = np.full((width, self.cands[t]), -np.inf)
            m[self.from_rank[went], self.to_rank[went]] = self.score[went]
            out.append({"emissions": self.emission[found], "matrix": m})
            width = self.cands[t]
        return out

    def followed(self, begins: list[list[float] | None]) -> np.ndarray:
        """Scores of each step's candidates, as :func:`forward` gives them, from those before each block; a row for each step."""
        width = int(max(self.cands.max(initial=1), self.from_rank.max(initial=0) + 1))
        out = np.full((len(self.cands), width), -np.inf)
        order = np.argsort(-self.sizes, kind="stable")
        sizes, first = self.sizes[order], self.first[order]
        scores = np.full((len(order), width), -np.inf)
        for j, block in enumerate(order.tolist()):
            told = (begins[block] or [])[:width]
            scores[j, : len(told)] = told
        emissions = np.full((len(self.cands), width), -np.inf)
        emissions[self.step, self.rank] = self.emission
        for t in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes, -t, "left"))
            at = first[:n] + t
            # moves of the n steps, as rows of one table
            low, high = np.searchsorted(self.move, at), np.searchsorted(self.move, at + 1)
            own = np.repeat(np.arange(n), high - low)
            went = np.arange(len(own)) + np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low)
            m = np.full((n, width, width), -np.inf)
            m[own, self.from_rank[went], self.to_rank[went]] = self.score[went]
            reached = _went(scores[:n], m)
            e = emissions[at]
            new = np.where(np.isfinite(reached).any(axis=1)[:, None], e + reached, e)
            new -= np.where(self.cands[at] > 0, new.max(axis=1), 0.0)[:, None]
            out[at] = scores[:n] = new
        return out

    def best(self, begins: list[list[float] | None]) -> tuple[pa.Array, ...]:
        """Segment, foot and confidence of each step, null where it has no candidate."""
        scores = self.followed(begins)
        some = np.flatnonzero(self.cands)
        best = (np.cumsum(self.cands) - self.cands)[some] + scores[some].argmax(axis=1)
        of = np.repeat(best, self.cands[some])
        turned = np.abs((self.road - self.road[of] + math.pi) % (2 * math.pi) - math.pi)
        same = (np.hypot(self.foot_e - self.foot_e[of], self.foot_n - self.foot_n[of]) < SAME_ROAD_M) & (turned < math.radians(SAME_ROAD_DEG))
        mass = np.exp(scores[self.step, self.rank])
        share = np.bincount(self.step, np.where(same, mass, 0.0), len(self.cands))[some] / np.bincount(self.step, mass, len(self.cands))[some]
        place = np.zeros(len(self.cands), dtype=np.int64)
        place[some] = np.arange(len(some))
        rows = pa.array(place, mask=self.cands == 0)
        return tuple(c.take(rows) for c in (self.segment.take(pa.array(best)), pa.array(self.foot_e[best]), pa.array(self.foot_n[best]), pa.array(share)))


def _matrix(step: dict, before: int) -> np.ndarray:
    if "matrix" in step:
        return step["matrix"]
    m = np.full((before, len(step["cands"] or ())), -np.inf)
    for move in step["moves"] or ():
        m[move["from_rank"] - 1, move["rank"] - 1] = move["score"]
    return m


def _emissions(step: dict) -> np.ndarray:
    return step["emissions"] if "emissions" in step else np.array([c["emission"] for c in step["cands"] or ()])


def _went(scores: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(max, +) product of scores, one state in each row, with a matrix, or with one for each row; minus infinity where nothing leads."""
    if not m.shape[-2] or not m.shape[-1]:
        return np.full((*scores.shape[:-1], m.shape[-1]), -np.inf)
    return (scores[..., :, None] + m).max(axis=-2)


def forward(scores: np.ndarray, step: dict) -> np.ndarray:
    """Scores of a step's candidates from those before, the greatest one 0; without a route there the emissions alone."""
    e = _emissions(step)
    reached = _went(scores, _matrix(step, len(scores)))
    out = e + reached if np.isfinite(reached).any() else e
    return out - out.max() if len(out) else out


def block_map(steps: list[dict]) -> dict:
    """What a block does to the scores before it.

    ``width`` is the number of candidates before it that its first step knows; ``whole`` the best scores from each of
    them to each last one; ``dead`` the step at which the last route from each ends, or -1; ``anew`` the final scores of
    a chain that starts at a step, for each step at which one may.
    """
    width = len(steps[0]["matrix"]) if "matrix" in steps[0] else max([m["from_rank"] for m in steps[0]["moves"] or ()], default=0)
    whole = np.where(np.eye(width, dtype=bool), 0.0, -np.inf)
    dead = np.full(width, -1)
    anew: dict[int, np.ndarray] = {}
    for t, step in enumerate(steps):
        m = _matrix(step, whole.shape[1])
        anew = {k: forward(v, step) for k, v in anew.items()}
        whole = _went(whole, m) + _emissions(step)
        ended = (dead < 0) & ~np.isfinite(whole).any(axis=1)
        dead[ended] = t
        if t == 0 or ended.any():
            e = _emissions(step)
            anew[t] = e - e.max() if len(e) else e
    return {"whole": whole, "dead": dead, "anew": anew}


def follow(scores: np.ndarray, width: int, whole: np.ndarray, dead: np.ndarray, anew: dict[int, np.ndarray]) -> np.ndarray:
    """The scores at a block's end from those before it. Candidates beyond ``width`` lead nowhere."""
    live = np.flatnonzero(np.isfinite(scores[:width]))
    lasting = live[dead[live] < 0]
    if not len(lasting):
        return anew[max([int(dead[k]) for k in live], default=0)]
    out = (scores[lasting][:, None] + whole[lasting]).max(axis=0)
    return out - out.max()


def match(points: DataFrame, segments: DataFrame, key: str, order: str) -> DataFrame:
    """``key, order, segment, foot_e, foot_n, confidence`` for each point; null where no segment is near.

    Points have ``e, n, psi, speed, travelled, std``, in metres, radians and metres a second; ``travelled`` is the
    distance since the point before. ``order`` must be unique in a trip. The best candidate is the one of greatest
    score, the nearest of equal ones; ``confidence`` is the share of the candidates on its road. An empty table gives an
    empty result.
    """
    spark = points.sparkSession
    ship_package(spark)
    kind, at = (points.schema[c].dataType.simpleString() for c in (key, order))
    blocks = _steps(points, segments, key, order)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = Steps(batch.column(2))
            for k in range(batch.num_rows):
                row, b = batch.slice(k, 1), block_map(steps.of(k))
                told = [b["whole"].shape[0], b["whole"].shape[1], b["whole"].tobytes(), b["dead"].tolist(), list(b["anew"]), [v.tolist() for v in b["anew"].values()]]
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.float64()))]
                columns = [row.column(0), row.column(1), *[pa.array([v], t) for v, t in zip(told, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, [key, "block", "width", "ends", "whole", "dead", "anew_at", "anew"])

    # only blocks that others may follow, which are full
    maps = blocks.where(F.size("steps") == BLOCK).select(key, "block", "steps").mapInArrow(summed, f"`{key}` {kind}, block long, width int, ends int, whole binary, dead array<int>, anew_at array<int>, anew array<array<double>>")

    class Trip:
        scores = np.empty(0)

    def step(trip: Trip, row: dict) -> dict:
        whole = np.frombuffer(row["whole"], dtype=float).reshape(row["width"], row["ends"])
        trip.scores = follow(trip.scores, row["width"], whole, np.array(row["dead"]), {k: np.array(v) for k, v in zip(row["anew_at"], row["anew"], strict=True)})
        return {"block": row["block"] + 1, "begins": trip.scores.tolist()}

    # a row for each full block of steps, for the block after it; a trip's blocks pass through one task as a stream
    begins = shared_table(spark, run_by_key(maps, key, ["block"], Trip, step, "block long, begins array<double>"), "match-begins")

    def posterior(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, SIDE_BY_SIDE):
                batch = whole.slice(k, SIDE_BY_SIDE)
                steps = Steps(batch.column(2))
                own = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), steps.sizes)))
                yield pa.RecordBatch.from_arrays([own, steps.at, *steps.best(batch.column(1).to_pylist())], [key, order, "segment", "foot_e", "foot_n", "confidence"])

    met = blocks.join(begins.select(F.col(key).alias("_key"), F.col("block").alias("_block"), "begins"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block")), "left")
    return met.select(key, "begins", "steps").mapInArrow(posterior, f"`{key}` {kind}, `{order}` {at}, segment long, foot_e double, foot_n double, confidence double")
