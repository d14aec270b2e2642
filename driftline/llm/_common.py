"""Helpers shared by the training-data operators: input columns, shared-folder tables, worker imports."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word definition ``[^\x20\x09-\x0D]+``.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; a null text becomes empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`id_and_text`, with the text as UTF-8 bytes for Arrow tasks."""
    return id_and_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a new temporary folder in local mode, and else a folder in the warehouse, which is shared too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.split("[")[0] == "local":
        found = f"file://{tempfile.mkdtemp(prefix='driftline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir')}/_driftline").rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system interface."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to this folder to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _drop_written() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return


def drop_at_exit(spark: SparkSession, path: str) -> None:
    _written.append((spark, path))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage, survives the loss of executors, and is removed when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._driftline_path = path
    return out


def bounded(df: DataFrame, name: str, rows: int) -> DataFrame:
    """As :func:`materialize`, marked for broadcast if it has at most ``rows`` rows."""
    out = materialize(df, name)
    if out.count() > rows:
        return out
    small = F.broadcast(out)
    small._driftline_path = out._driftline_path
    return small


def never_broadcast(df: DataFrame) -> DataFrame:
    """For a side of a join that is large when run, though Spark takes it for small and would send it to the driver.

    Its guess goes by the bytes of a file and has no share in what ``explode`` makes of a row.
    """
    return df.hint("merge")


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries now.

    It does so once the driver's garbage collector has found that nothing refers to them, which on a driver with memory
    to spare may be long after the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more, and the shuffle files behind them."""
    for df in tables:
        path = getattr(df, "_driftline_path", None)
        if path:
            drop_path(df.sparkSession, path)
            _written[:] = [(s, p) for s, p in _written if p != path]
    forget(tables[0].sparkSession)


#: Bytes of an Arrow batch where the session has Spark's default of 64 MB: rows are whole documents, and each task
#: holds a batch in the JVM and in Python.
BATCH_BYTES = 4 << 20


def trim() -> None:
    """Give freed memory back at the end of a task, since its Python worker serves other operators next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver found it by its own working folder.

    Also lowers the session's Arrow batch size to ``BATCH_BYTES`` unless it was set to something else than the default.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    # asked for without a default of ours, an unset entry gives Spark's default; with None it would give None
    if spark.conf.get(name).lower().rstrip("b") == str(64 << 20):
        spark.conf.set(name, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_driftline_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="driftline-zip-"), "driftline.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(target)
    sc._driftline_shipped = True


