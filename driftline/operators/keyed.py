"""Running a kernel over each key's rows in time order.

Rows are dealt by key and sorted in Spark; a task then reads them as a stream with one kernel's state at a time, so a
key with very many rows needs no more memory than one with few.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver found it by its own working folder."""
    sc = spark.sparkContext
    if getattr(sc, "_driftline_package", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="driftline-zip-"), "driftline_core.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(target)
    sc._driftline_package = True


def tie(df: DataFrame) -> Column:
    """A hash of a row's values, to put rows of equal time in an order that does not depend on partitions. Maps have none."""
    return F.xxhash64(*["`" + f.name.replace("`", "``") + "`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def run_by_key(df: DataFrame, key: str, order: list[str], make: Callable[[], object], step: Callable[[object, dict], dict | None], schema: str, finish: Callable[[object], Iterator[dict]] | None = None) -> DataFrame:
    """For each key a new kernel from ``make``; ``step(kernel, row)`` gives an output row or None for each row.

    Rows that are equal in ``order`` come by a hash of all their values. ``schema`` lists the output columns after the
    key. ``finish(kernel)`` may give more rows at the end of a key.
    """
    out_schema = _with_key(df, key, schema)
    names = [f.name for f in out_schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        held: list[dict] = []
        current, kernel = object(), None

        def ended() -> Iterator[dict]:
            if kernel is not None and finish is not None:
                for x in finish(kernel):
                    yield {key: current, **x}

        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                for row in batch.slice(k, 2048).to_pylist():
                    if kernel is None or row[key] != current:
                        held += ended()
                        current, kernel = row[key], make()
                    out = step(kernel, row)
                    if out is not None:
                        held.append({key: current, **out})
                if len(held) >= 2048:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in held], schema=arrow)
                    held = []
        held += ended()
        if held:
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in held], schema=arrow)

    return _dealt(df, key, order).mapInArrow(run, out_schema)


def _with_key(df: DataFrame, key: str, schema: str) -> T.StructType:
    return T.StructType([T.StructField(key, df.schema[key].dataType), *T.StructType.fromDDL(schema).fields])


def _dealt(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows dealt by key, in order in each task; tasks can import this package."""
    ship_package(df.sparkSession)
    # a given number of partitions: adaptive execution would merge them by their bytes, but the work is in the kernels.
    # By the key itself, the shuffle would be left out where a window before it has dealt the rows by key, and that one
    # is merged to few tasks.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, F.xxhash64(key)).sortWithinPartitions(key, *order, tie(df))


#: Segments of a map that is broadcast: some 200 bytes each. Larger areas are cut up, by trip or by region.
MOST_SEGMENTS = 500_000
_nets: dict[str, object] = {}


def shared_map(spark: SparkSession, segments: list[dict]) -> Callable[[], object]:
    """A function that gives a task the road map, whose index a worker builds once."""
    if len(segments) > MOST_SEGMENTS:
        raise ValueError(f"{len(segments)} segments are too many to broadcast; give the map of one area, at most {MOST_SEGMENTS}")
    shared, name = spark.sparkContext.broadcast(segments), uuid.uuid4().hex

    def net():
        from . import keyed, kernels

        if name not in keyed._nets:
            keyed._nets.clear()
            keyed._nets[name] = kernels.RoadNet(shared.value)
        return keyed._nets[name]

    return net


def _decimate(kernel, row):
    done = kernel.update(row["t"], row["values"])
    return None if done is None else {"t_end": done[0], "means": done[1]}


def decimate(df: DataFrame, key: str, period: float) -> DataFrame:
    """``key, t_end, means`` of exact decimation of ``t, values``."""
    from .kernels import Decimator

    return run_by_key(df, key, ["t"], lambda: Decimator(period), _decimate, "t_end double, means array<double>")


def monitor_fixes(df: DataFrame, key: str) -> DataFrame:
    """``key, t, decision, mode, quality`` of each fix ``t, e, n, speed, accuracy, surprise, own_speed``, ticked after it."""
    from .kernels import Fix, FixMonitor

    def step(kernel, r):
        kernel.tick(r["t"])
        fix = Fix(r["t"], r["e"], r["n"], r["speed"] or 0.0, r["accuracy"])
        decision = kernel.on_fix(fix, r["surprise"], r["own_speed"] or 0.0)
        return {"t": r["t"], "decision": decision, "mode": kernel.tick(r["t"]), "quality": kernel.quality}

    return run_by_key(df, key, ["t"], FixMonitor, step, "t double, decision string, mode string, quality double")


def mode_transitions(states: DataFrame, key: str, time: str = "t") -> DataFrame:
    """Rows where the mode differs from the one before: ``key, time, before, mode``."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    before = F.lag("mode").over(Window.partitionBy(key).orderBy(time))
    return states.withColumn("before", before).where(F.col("before") != F.col("mode")).select(key, time, "before", "mode")


NAV_SCHEMA = (
    "t double, east double, north double, speed double, psi double, mode string, quality double, model_speed double, "
    "model_confidence double, map_confidence double, position_std double"
)


#: Deviation of the speed that :func:`oracle_model` tells, and the speed below which a vehicle stands.
ORACLE_STD, ORACLE_STANDING = 0.05, 0.3


def oracle_model(window, scalars, frame):
    """A speed model that passes the frame's true speed through; for tests and upper bounds."""
    from .kernels import SpeedEstimate

    v = frame.get("true_speed")
    return None if v is None else SpeedEstimate(float(v), ORACLE_STD**2, 1.0 if v < ORACLE_STANDING else 0.0)


def navigate(frames: DataFrame, key: str, segments: list[dict] | None = None, use_model: bool = True, **options) -> DataFrame:
    """The estimator over each key's frames ``t, ax..gz, fix, true_speed``: one state for each frame.

    ``segments`` is the road map of one area, of at most ``MOST_SEGMENTS`` segments. Without options many keys are followed
    side by side.
    """
    from .kernels import Navigator

    road_net = shared_map(frames.sparkSession, segments) if segments else None
    if not options:
        schema = _with_key(frames, key, NAV_SCHEMA)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            from . import lockstep

            yield from lockstep.estimated(batches, key, to_arrow_schema(schema), speed_model=use_model, net=road_net() if road_net else None)

        return _dealt(frames, key, ["t"]).mapInArrow(run, schema)

    def make():
        return Navigator(oracle_model if use_model else None, road_net() if road_net else None, **options)

    return run_by_key(frames, key, ["t"], make, lambda kernel, r: kernel.update(r), NAV_SCHEMA)


def replayed(
    rows: DataFrame, planned: DataFrame, key: str, index: str, order: list[str], frames_of: Callable[[DataFrame], DataFrame] | None = None,
    segments: list[dict] | None = None, use_model: bool = True, **options,
) -> DataFrame:
    """``key, scenario, start, end, i`` and ``speed, valid, e, n, est_e, est_n, mode`` of each frame of each planned outage and the one before.

    Frames are as for :func:`navigate`, numbered by ``index``, with the truth ``speed, valid, e, n``. They are estimated
    once for each ``scenario`` that ``planned`` has an outage of in their key, without the fixes inside its outages;
    before the first fix that is left there is no estimate. ``rows`` are dealt by key and put in ``order``; where frames
    are made of rows, ``frames_of`` does that in the task, so that only rows are shuffled and sorted. It gives the
    frames of a row after those of the row before, and keeps the columns that begin with an underscore.
    """
    from .kernels import Navigator
    from .lockstep import _SENSORS
    from .replaying import TRUTH, outage_frames

    road_net = shared_map(rows.sparkSession, segments) if segments else None
    make = (lambda: Navigator(oracle_model if use_model else None, road_net() if road_net else None, **options)) if options else None
    own = planned.select(key, F.lit(0).alias("_part"), F.col("scenario").alias("_scenario"), *[F.col(c).cast("long").alias(f"_{c}") for c in ("start", "end")])
    both = rows.withColumn("_part", F.lit(1)).unionByName(own, allowMissingColumns=True).where(F.col(key).isNotNull())
    frames = _dealt(both, key, ["_part", *order])
    frames = frames_of(frames) if frames_of else frames
    told = [key, "_part", "_scenario", "_start", "_end", index, "t", "fix", *TRUTH, *[c for c in (*_SENSORS, "true_speed") if c in frames.columns]]
    schema = _with_key(frames, key, f"scenario {planned.schema['scenario'].dataType.simpleString()}, start long, end long, i long, speed double, valid boolean, e double, n double, est_e double, est_n double, mode string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from outage_frames(batches, key, index, to_arrow_schema(schema), make, use_model, road_net() if road_net else None)

    return frames.select(*dict.fromkeys(told)).mapInArrow(run, schema)


def navigate_places(frames: DataFrame, key: str, **options) -> DataFrame:
    """The estimator's output record for frames whose fixes are in degrees; the first fix of a key is its origin."""
    from .trips import located, output_record

    placed = located(frames, key)
    states = navigate(placed, key, **options)
    return output_record(states.join(placed.select(key, "origin").dropDuplicates([key]), key), key)


def navigate_with_area_maps(frames: DataFrame, key: str, segments: DataFrame, use_model: bool = True, **options) -> DataFrame:
    """As :func:`navigate`, with a map of its own for each key, such as the roads near a trip.

    ``segments`` has the key and ``e1, n1, e2, n2, node1, node2, length, psi, oneway``. A key's segments reach its task
    before its frames, so that no map has to be broadcast.
    """
    from .kernels import Navigator, RoadNet

    class Area:
        def __init__(self):
            self.segments, self.kernel = [], None

    def step(area, row):
        if row["segment_"] is not None:
            area.segments.append(row["segment_"])
            return None
        if area.kernel is None:
            area.kernel = Navigator(oracle_model if use_model else None, RoadNet(area.segments) if area.segments else None, **options)
        return area.kernel.update(row)

    parts = segments.select(key, F.struct("e1", "n1", "e2", "n2", "node1", "node2", "length", "psi", "oneway").alias("segment_"), F.lit(0).alias("part_"))
    rows = frames.withColumn("part_", F.lit(1)).unionByName(parts, allowMissingColumns=True)
    return run_by_key(rows, key, ["part_", "t"], Area, step, NAV_SCHEMA)


def route_points(df: DataFrame, key: str, least: float, every: int) -> DataFrame:
    """Points of a route thinned to at least ``least`` apart, of every ``every``-th sample ``idx, e, n``."""
    import math

    class Thin:
        kept: tuple[float, float] | None = None

    def step(kernel, r):
        if r["idx"] % every or (kernel.kept is not None and math.dist(kernel.kept, (r["e"], r["n"])) < least):
            return None
        kernel.kept = (r["e"], r["n"])
        return {"idx": r["idx"], "e": r["e"], "n": r["n"]}

    return run_by_key(df, key, ["idx"], Thin, step, "idx long, e double, n double")


def synthetic_fixes(truth: DataFrame, key: str, seed: int, white: float = 1.0, slow: float = 2.0, tau: float = 30.0, dt: float = 1.0, lag: int = 0) -> DataFrame:
    """Fixes from true positions ``idx, t, e, n, speed, heading``: delayed truth with slow and white noise.

    Each key has its own generator, seeded by the seed and the key, so the result does not depend on partitions. Where
    ``truth`` has a column ``normals``, an array of six numbers a row, these are taken in place of random ones.
    """
    import random

    from .kernels import Ar1

    class Source:
        def __init__(self):
            self.rng, self.past = None, []
            self.noise = (Ar1(slow, tau, dt), Ar1(slow, tau, dt))

        def gauss(self, mean, deviation):
            return mean + deviation * self.given.pop(0) if self.given else self.rng.gauss(mean, deviation)

    def step(kernel, r):
        if kernel.rng is None:
            kernel.rng = random.Random(f"{seed}:{r[key]}")
        kernel.given = list(r.get("normals") or [])
        kernel.past = [*kernel.past, (r["e"], r["n"], r["speed"], r["heading"])][-(lag + 1) :]
        e, n, speed, heading = kernel.past[0]
        g = kernel.gauss
        de, dn = (a.update(g(0, 1)) + white * g(0, 1) for a in kernel.noise)
        seen = max(speed + 0.1 * g(0, 1), 0.0)
        return {"t": r["t"], "e": e + de, "n": n + dn, "speed": seen, "heading": (heading + g(0, 1)) % 360 if seen > 1 else None, "accuracy": 3.0}

    return run_by_key(truth, key, ["idx"], Source, step, "t double, e double, n double, speed double, heading double, accuracy double")
