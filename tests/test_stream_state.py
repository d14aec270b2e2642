"""State of streams is typed: it is whole, outlives its classes, may get columns, and ends."""

import math
import os
import random
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators import keyed, kernels
from driftline.streaming import stateful, states

FRAME = "trip string, t double, ax double, ay double, az double, gx double, gy double, gz double, fix struct<t:double,e:double,n:double,speed:double,heading:double,accuracy:double>"


def drive(seed, n=600):
    """A drive of 10 Hz with noise, fixes each second but for an outage, some of them poor, off or without speed."""
    rng = random.Random(seed)
    for i in range(n):
        t, psi = i / 10, 0.004 * i
        fix = None
        if i % 10 == 3 and not 200 < i < 320:
            off = 80.0 if i % 70 == 3 else 0.0
            fix = {"t": t, "e": 0.9 * i + off, "n": 0.1 * i, "speed": None if i % 50 == 3 else 9.0, "heading": math.degrees(math.pi / 2 - psi) % 360, "accuracy": rng.choice([3.0, 8.0, 20.0, 40.0, None])}
        yield {"t": t, "ax": rng.gauss(0, 0.3), "ay": rng.gauss(0, 0.3), "az": 9.81 + rng.gauss(0, 0.3), "gx": rng.gauss(0, 0.02), "gy": 0.0, "gz": 0.04, "fix": fix}


def street():
    node = lambda k: f"n{k}"
    return kernels.RoadNet([{"e1": 50.0 * k, "n1": 5.0 * k, "e2": 50.0 * (k + 1), "n2": 5.0 * (k + 1), "length": math.hypot(50, 5), "psi": math.atan2(5, 50), "oneway": 0, "node1": node(k), "node2": node(k + 1)} for k in range(20)])


def model(window, scalars, frame):
    return kernels.SpeedEstimate(8.0 + 0.1 * window[-1][0] + 0.01 * scalars[0], 0.5, 0.1)


@pytest.mark.parametrize("every", [1, 7])
@pytest.mark.parametrize("use_map", [False, True])
def test_a_stored_navigator_goes_on_as_if_it_had_stayed(spark, every, use_map):
    net = street() if use_map else None
    fields = T.StructType.fromDDL(states.NAVIGATOR.columns)
    cell = lambda v, kind: v if v is None else [cell(x, kind.elementType) for x in v] if isinstance(kind, T.ArrayType) else record(v, kind) if isinstance(kind, T.StructType) else v
    record = lambda v, kind: Row(**{f.name: cell(x, f.dataType) for x, f in zip(v, kind, strict=True)})
    stayed, stored = kernels.Navigator(model, net), kernels.Navigator(model, net)
    told = set()
    for i, frame in enumerate(drive(5)):
        want = stayed.update(frame)
        assert stored.update(frame) == want, i
        told.add(want["mode"])
        if i % every == 0:
            values = states.NAVIGATOR.taken(stored)
            T._make_type_verifier(fields)(values)
            stored = kernels.Navigator(model, net)
            states.NAVIGATOR.put(stored, record(values, fields))
    assert len(told) >= 3


def parts(spark, path, *tables, schema):
    """One file for each table, read in this order."""
    for k, rows in enumerate(tables):
        had = set(os.listdir(path)) if os.path.exists(path) else set()
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for f in set(os.listdir(path)) - had:
            if f.endswith(".parquet"):
                os.utime(f"{path}/{f}", (1_000_000 + k + len(had), 1_000_000 + k + len(had)))


@pytest.fixture
def by_value():
    """Workers need not find this module."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    yield
    cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def run(df, path):
    writer = df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    with stateful.growing_state(df.sparkSession):
        q = writer.start()
    q.awaitTermination()
    assert df.sparkSession.conf.get("spark.sql.streaming.stateStore.encodingFormat") != "avro"
    return df.sparkSession.read.parquet(f"{path}/out")


class Renamed(kernels.Navigator):
    """Stands for the estimator of a later version: another class with an attribute more."""

    def __init__(self, *args, **kwargs):
        super().__init__(*args, **kwargs)
        self.frames = 0

    def update(self, frame):
        self.frames += 1
        return super().update(frame)


def test_a_restart_takes_another_class_and_a_new_column(spark, tmp_path, by_value):
    """The first half with one class, the second, from its checkpoint, with another that keeps one column more."""
    rows = [(d, *[f[c] for c in ("t", "ax", "ay", "az", "gx", "gy", "gz")], f["fix"] and tuple(f["fix"].values())) for d, seed in (("a", 1), ("b", 2)) for f in drive(seed, 120)]
    first, second = [r for r in rows if r[1] < 6], [r for r in rows if r[1] >= 6]
    src = str(tmp_path / "in")
    parts(spark, src, first, schema=FRAME)
    stream = lambda: spark.readStream.schema(FRAME).parquet(src)
    run(stateful.run_stream(stream(), "trip", "t", kernels.Navigator, lambda k, r: k.update(r), keyed.NAV_SCHEMA, states.NAVIGATOR), tmp_path)
    parts(spark, src, second, schema=FRAME)

    def put(kernel, row):
        states.NAVIGATOR.put(kernel, row)
        kernel.frames = row.frames or 0

    more = states.Stored(states.NAVIGATOR.columns + ", frames long", lambda k: (*states.NAVIGATOR.taken(k), k.frames), put)
    got = run(stateful.run_stream(stream(), "trip", "t", Renamed, lambda k, r: k.update(r), keyed.NAV_SCHEMA, more), tmp_path)
    whole = spark.createDataFrame(rows, FRAME)
    want = keyed.run_by_key(whole, "trip", ["t"], kernels.Navigator, lambda k, r: k.update(r), keyed.NAV_SCHEMA)
    assert sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, want.collect()))
    assert got.agg(F.max("late")).first()[0] == 0


class Sum:
    def __init__(self):
        self.total = 0.0

    def update(self, row):
        self.total += row["v"]
        return {"t": row["t"], "total": self.total}


def test_late_rows_ties_nulls_and_a_null_key(spark, tmp_path, by_value):
    """Of equal times one row counts, whichever file order; rows before the last one and rows without time are late."""
    schema, src = "k string, t double, v double", str(tmp_path / "in")
    parts(spark, src, [("a", 1.0, 5.0), ("a", 1.0, 6.0), ("a", None, 7.0), (None, 1.0, 1.0)], [("a", 0.5, 9.0), ("a", 2.0, 3.0), (None, 2.0, 1.0)], schema=schema)
    sums = states.Stored("total double", lambda k: (k.total,), lambda k, r: setattr(k, "total", r.total))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = run(stateful.run_stream(stream, "k", "t", Sum, lambda k, r: k.update(r), "t double, total double", sums), tmp_path)
    h = {r.v: r.h for r in spark.createDataFrame([("a", 1.0, 5.0), ("a", 1.0, 6.0)], schema).select("v", F.xxhash64("k", "t", "v").alias("h")).collect()}
    one = min(h, key=h.get)
    # late: the row without a time is counted before the first row out, the other of time 1 after it
    assert sorted(map(tuple, got.where("k = 'a'").collect())) == [("a", 1.0, one, 1), ("a", 2.0, one + 3.0, 3)]
    assert sorted(map(tuple, got.where("k is null").select("t", "total", "late").collect())) == [(1.0, 1.0, 0), (2.0, 2.0, 0)]


def test_a_silent_key_ends_and_starts_anew(spark, tmp_path):
    """Key a is silent from 10 s on: told at its timer, ended by the next one, and counted from 0 when it is back."""
    schema, src = "k string, at double", str(tmp_path / "in")
    parts(spark, src, [("a", 10.0), ("b", 10.0)], [("b", 50.0)], [("b", 90.0)], [("b", 95.0), ("a", 96.0)], schema=schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("stamp", F.timestamp_seconds("at")).withWatermark("stamp", "1 second")
    got = run(stateful.watch_reception(stream, "k", "stamp", 5_000), tmp_path)
    # once all is read a batch without rows moves the watermark to 94 s, before the timers of 100 and 101 s
    assert sorted((r.fixes, r.lost) for r in got.where("k = 'a'").collect()) == [(1, False), (1, False), (1, True)]
    assert sorted((r.fixes, r.lost) for r in got.where("k = 'b'").collect())[-1] != (0, True)


@pytest.mark.parametrize(("ttl_ms", "total"), [(3_600_000, 8.0), (1, 3.0)])
def test_time_to_live(spark, tmp_path, by_value, ttl_ms, total):
    """Without event time a state that nobody changed for ``ttl_ms`` is gone in the next micro-batch."""
    schema, src = "k string, t double, v double", str(tmp_path / "in")
    parts(spark, src, [("a", 1.0, 5.0)], [("a", 2.0, 3.0)], schema=schema)
    sums = states.Stored("total double", lambda k: (k.total,), lambda k, r: setattr(k, "total", r.total))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    df = stateful.run_stream(stream, "k", "t", Sum, lambda k, r: k.update(r), "t double, total double", sums, ttl_ms=ttl_ms)
    name = f"lived_{ttl_ms}"
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(processingTime="1 second").start()
    until = time.time() + 25
    while spark.table(name).count() < 2 and time.time() < until and q.isActive:
        time.sleep(0.5)
    q.stop()
    assert sorted(map(tuple, spark.table(name).select("t", "total").collect())) == [(1.0, 5.0), (2.0, total)]
