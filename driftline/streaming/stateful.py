"""The kernels on Structured Streaming: typed state by key, late rows counted, loss of reception noticed by timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.keyed import NAV_SCHEMA, ship_package, tie
from . import states

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _use_rocksdb(spark: SparkSession) -> None:
    """Timers and typed state need this store. A query that goes on from a checkpoint keeps the one it was started with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


@contextmanager
def growing_state(spark: SparkSession) -> Iterator[None]:
    """Queries started in here, ``with growing_state(spark): query = out.writeStream...start()``, may get more columns later.

    Their state is written as Avro. It is set only while they start, since Spark refuses it for streaming aggregations.
    """
    name = "spark.sql.streaming.stateStore.encodingFormat"
    before = spark.conf.get(name)
    spark.conf.set(name, "avro")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _stamped(df: DataFrame, stamp: str) -> DataFrame:
    """Adds ``stamp_ms_``, so that no time zone plays a part in the task."""
    return df.withColumn("stamp_ms_", F.unix_millis(F.col(stamp).cast("timestamp")))


class _Timer:
    """One timer for each key: setting it takes the one before back, whose time the caller keeps in its state."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle

    def set(self, before: int | None, at: int) -> int:
        if before != at:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
        return at


def _latest(rows: list[Row], watermark_ms: int) -> int:
    return max([watermark_ms, *[r["stamp_ms_"] for r in rows if r["stamp_ms_"] is not None]])


class _Kernels(StatefulProcessor):
    """A kernel for each key. Two states: the kernel's own columns, and what is known of the key's rows."""

    def __init__(self, key: str, time: str, time_type: str, names: list[str], make, step, stored: states.Stored, idle, idle_ms: int, forget_ms: int, stamped: bool, ttl_ms: int | None):
        self.key, self.time, self.time_type, self.names = key, time, time_type, names
        self.make, self.step, self.stored, self.idle = make, step, stored, idle
        self.columns = T.StructType.fromDDL(stored.columns)  # here, as only the driver can read DDL
        self.idle_ms, self.forget_ms, self.stamped, self.ttl_ms = max(idle_ms, 1), max(forget_ms, 1), stamped, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timer = _Timer(handle)
        self.kernels = handle.getValueState("kernel", self.columns, self.ttl_ms)
        self.seen = handle.getValueState("seen", f"last {self.time_type}, late long, told boolean, timer long", self.ttl_ms)

    def close(self) -> None:
        pass

    def _kernel(self) -> object:
        kernel = self.make()
        if self.kernels.exists():
            self.stored.put(kernel, Row(**dict(zip(self.columns.names, self.kernels.get(), strict=True))))
        return kernel

    def _row(self, key: tuple, made: dict, late: int) -> Row:
        row = {self.key: key[0], **made, "late": late}
        return Row(**{n: row.get(n) for n in self.names})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kernel = self._kernel()
        last, late, _, timer = self.seen.get() if self.seen.exists() else (None, 0, False, None)
        rows = list(rows)
        timed = [r for r in rows if r[self.time] is not None]
        late += len(rows) - len(timed)
        for r in sorted(timed, key=lambda r: (r[self.time], r["tie_"])):
            if last is not None and r[self.time] <= last:
                late += 1
                continue
            last = r[self.time]
            made = self.step(kernel, r.asDict(recursive=True))
            if made is not None:
                yield self._row(key, made, late)
        self.kernels.update(self.stored.taken(kernel))
        if self.stamped:
            timer = self.timer.set(timer, _latest(rows, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        self.seen.update((last, late, False, timer))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, late, told, _ = self.seen.get()
        if told:
            self.kernels.clear()
            self.seen.clear()
            return
        if self.idle is not None and last is not None:
            kernel = self._kernel()
            made = self.idle(kernel, last)
            self.kernels.update(self.stored.taken(kernel))
            if made is not None:
                yield self._row(key, made, late)
        at = self.timer.set(None, timerValues.getCurrentWatermarkInMs() + self.forget_ms)
        self.seen.update((last, late, True, at))


def run_stream(
    frames: DataFrame, key: str, time: str, make: Callable[[], object], step: Callable[[object, dict], dict | None], schema: str, stored: states.Stored,
    watermark: str | None = "2 seconds", stamp: str | None = None, idle: Callable[[object, float], dict | None] | None = None, idle_ms: int = 2_000,
    forget_ms: int = 3_600_000, ttl_ms: int | None = None,
) -> DataFrame:
    """Output rows of a kernel for each key of a stream, in the order of ``time`` within each micro-batch.

    The kernel is kept between micro-batches as the columns of ``stored``, so a checkpoint outlives its class, and with
    :func:`growing_state` also new columns. Rows not later than the last one of their
    key, of rows of equal time all but the one of least hash, and rows without a time are late: they are left out and
    counted in ``late``. A null key is a key. With ``stamp``, an event-time column, Spark leaves out rows behind the
    watermark too, and a key is idle once no row of it came for ``idle_ms`` of event time; then ``idle(kernel, last)``
    may give one row more. After ``forget_ms`` more its state ends, and a later row starts anew. Without ``stamp``
    a state ends ``ttl_ms`` of the clock after its last change, or, if that is None, never. With ``ttl_ms`` give the
    query a processing-time trigger: with ``availableNow`` it was not seen to end.
    """
    spark = frames.sparkSession
    ship_package(spark)
    _use_rocksdb(spark)
    if stamp:
        frames = _stamped(frames.withWatermark(stamp, watermark or "0 seconds"), stamp)
    out_schema = T.StructType([T.StructField(key, frames.schema[key].dataType), *T.StructType.fromDDL(schema).fields, T.StructField("late", T.LongType())])
    mode = "EventTime" if stamp else "ProcessingTime" if ttl_ms else "None"
    processor = _Kernels(
        key, time, frames.schema[time].dataType.simpleString(), out_schema.names, make, step, stored, idle, idle_ms, forget_ms, bool(stamp), None if stamp else ttl_ms
    )
    return frames.withColumn("tie_", tie(frames)).groupBy(key).transformWithState(processor, out_schema, "append", mode)


def navigate_stream(frames: DataFrame, key: str, use_model: bool = True, stamp: str | None = None, watermark: str | None = "2 seconds", idle_ms: int = 2_000, **options) -> DataFrame:
    """The estimator on a stream of frames, equal to the batch form on the same rows.

    With ``stamp``, a device that sends nothing for ``idle_ms`` gets one more state, ``idle_ms`` after its last one,
    with the mode that its monitor then tells.
    """
    from ..operators.kernels import Navigator
    from ..operators.keyed import oracle_model

    def idle(kernel: Navigator, last: float) -> dict:
        return kernel.silent(last + idle_ms / 1000)

    return run_stream(
        frames, key, "t", lambda: Navigator(oracle_model if use_model else None, **options), lambda kernel, r: kernel.update(r), NAV_SCHEMA,
        states.NAVIGATOR, watermark, stamp, idle, idle_ms,
    )


def track_outages(frames: DataFrame, key: str, dt: float, every: int = 10, least_m: float = 20.0) -> DataFrame:
    """:func:`operators.outages.live_log` of a stream of frames numbered by ``i``: a row once an outage closes."""
    from ..operators.kernels import OutageTracker

    schema = "start long, end long, duration_s double, distance_m double, err_m double, drift_pct double"
    return run_stream(frames, key, "i", lambda: OutageTracker(dt, every, least_m), lambda kernel, r: kernel.update(r), schema, states.OUTAGE)


class _Reception(StatefulProcessor):
    def __init__(self, key: str, wait_ms: int):
        self.key, self.wait_ms = key, max(wait_ms, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timer = _Timer(handle)
        self.seen = handle.getValueState("seen", "fixes long, timer long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fixes, timer = self.seen.get() if self.seen.exists() else (0, None)
        latest = timerValues.getCurrentWatermarkInMs()
        for r in rows:
            fixes, latest = fixes + 1, max(latest, r["stamp_ms_"] or latest)
        self.seen.update((fixes, self.timer.set(timer, latest + self.wait_ms)))
        yield Row(**{self.key: key[0], "fixes": fixes, "lost": False})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        fixes = self.seen.get()[0]
        self.seen.clear()
        yield Row(**{self.key: key[0], "fixes": fixes, "lost": True})


def watch_reception(fixes: DataFrame, key: str, stamp: str, wait_ms: int) -> DataFrame:
    """``key, fixes, lost``: fixes seen so far of each key, and whether none came for ``wait_ms`` of event time.

    ``fixes`` has a watermark on ``stamp``. A key that was lost is counted from 0 when it comes back.
    """
    ship_package(fixes.sparkSession)
    _use_rocksdb(fixes.sparkSession)
    out_schema = T.StructType([T.StructField(key, fixes.schema[key].dataType), T.StructField("fixes", T.LongType()), T.StructField("lost", T.BooleanType())])
    return _stamped(fixes, stamp).select(key, stamp, "stamp_ms_").groupBy(key).transformWithState(_Reception(key, wait_ms), out_schema, "append", "EventTime")


def decimated_stream(frames: DataFrame, stamp: str, key: str, period: str, values: list[str], watermark: str = "2 seconds") -> DataFrame:
    """Window means of a stream, the approximate form of decimation that needs no kernel."""
    w = F.window(stamp, period)
    out = frames.withWatermark(stamp, watermark).groupBy(key, w.alias("w")).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n"))
    return out.select(key, F.col("w.end").alias("t_end"), *values, "n")
