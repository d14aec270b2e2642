"""Tables in parts that change by versions: rows are staged beside the table, then a manifest publishes what changed.

A table is a folder with ``data/<run>/part_=<name>`` and ``manifests/<number>.json``. A manifest names the folder, rows
and digest of each part, so a version is read from its manifest alone. Until the new manifest stands, readers see the
version before; a run that is killed leaves nothing but a staged folder, which :func:`clean` deletes. Of two runs that
publish the same number one fails. Parts that come out as they were keep their folder, and if all do there is no new
version, so a repeated run changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import drop_folder

#: Parts of a table: the manifest is made on the driver, a line for each.
MOST_PARTS = 10_000


class Conflict(RuntimeError):
    """Another run published a version meanwhile; the caller may run again."""


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list[str]:
    target, fs = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the table's versions, in order; an absent table has none."""
    return sorted(int(n[:-5]) for n in _listed(spark, f"{path}/manifests") if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version, by default of the last one; None for an absent table."""
    known = versions(spark, path)
    if version is None and not known:
        return None
    number = known[-1] if version is None else version
    if number not in known:
        raise KeyError(f"{path} has no version {number}")
    return json.loads(spark.read.option("wholetext", True).text(f"{path}/manifests/{number}.json").first()[0])


def _publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Puts the manifest in place by a rename that fails if it is there."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    staged, fs = _at(spark, f"{path}/manifests/.{number}-{uuid.uuid4().hex}")
    out = fs.create(staged)
    out.write(json.dumps(content, sort_keys=True).encode())
    out.close()
    target, _ = _at(spark, f"{path}/manifests/{number}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(staged), fs.makeQualified(target), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Exception as e:
        fs.delete(staged, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {number} of {path} is there") from e
        raise


def _read(spark: SparkSession, path: str, content: dict, parts: list[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(content["schema"])
    folders = [f"{path}/{p['folder']}" for name, p in sorted(content["parts"].items()) if parts is None or name in parts]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default of the last one; an absent table is a ``KeyError``."""
    content = manifest(spark, path, version)
    if content is None:
        raise KeyError(f"{path} has no version")
    return _read(spark, path, content)


def _checked(rows: DataFrame, old: dict | None, layout: str) -> None:
    if "part_" in rows.columns:
        raise ValueError("part_ is the name of the parts")
    if old is not None and old["layout"] != layout:
        raise ValueError(f"the table is laid out by {old['layout']}, not by {layout}")
    if old is not None and sorted(rows.columns) != sorted(f["name"] for f in old["schema"]["fields"]):
        raise ValueError("the rows have other columns than the table")


def _stage(spark: SparkSession, path: str, rows: DataFrame, old: dict | None, layout: str) -> int:
    """Writes ``rows`` with ``part_`` and publishes the parts that differ; the number of the version that now holds."""
    run = f"data/{uuid.uuid4().hex}"
    # by part, so that a part has few files, but split where one is very large
    rows.hint("rebalance", "part_").write.partitionBy("part_").parquet(f"{path}/{run}")
    columns = [c for c in rows.columns if c != "part_"]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema if f.name != "part_"])
    staged = spark.read.schema(T.StructType([*schema.fields, T.StructField("part_", T.StringType())])).parquet(f"{path}/{run}")
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})
    # two sums of hashes: the order of rows does not count, repeated rows do
    digest = F.concat_ws(":", *[F.sum(F.xxhash64(F.lit(k), line).cast("decimal(38,0)")).cast("string") for k in (0, 1)])
    made = staged.groupBy("part_").agg(F.count("*").alias("rows"), digest.alias("digest")).limit(MOST_PARTS + 1).collect()
    parts = dict(old["parts"]) if old else {}
    changed = [r for r in made if r["part_"] not in parts or (parts[r["part_"]]["rows"], parts[r["part_"]]["digest"]) != (r["rows"], r["digest"])]
    for r in made:
        if r not in changed:
            drop_folder(spark, f"{path}/{run}/part_={r['part_']}")
    number = old["version"] if old else 0
    if old and not changed:
        drop_folder(spark, f"{path}/{run}")
        return number
    parts |= {r["part_"]: {"folder": f"{run}/part_={r['part_']}", "rows": r["rows"], "digest": r["digest"]} for r in changed}
    if len(parts) > MOST_PARTS:
        drop_folder(spark, f"{path}/{run}")
        raise ValueError(f"more than {MOST_PARTS} parts")
    _publish(spark, path, number + 1, {"version": number + 1, "layout": layout, "schema": json.loads((old and T.StructType.fromJson(old["schema"]) or schema).json()), "parts": parts})
    return number + 1


def replace_parts(rows: DataFrame, path: str, by: str) -> int:
    """Puts ``rows`` in place of the parts that they have, by the values of ``by``; the version that then holds.

    Other parts stay as they are. A null value is a part of its own.
    """
    spark, layout = rows.sparkSession, f"values of {by}"
    old = manifest(spark, path)
    _checked(rows, old, layout)
    name = F.coalesce(F.concat(F.lit("v"), F.lower(F.lpad(F.hex(F.xxhash64(F.col(by).cast("string"))), 16, "0"))), F.lit("vnull"))
    return _stage(spark, path, rows.withColumn("part_", name), old, layout)


def upsert(rows: DataFrame, path: str, on: list[str], buckets: int = 64) -> int:
    """Puts ``rows`` in place of those with the same key; the version that then holds.

    Only the buckets of the key's hash that have new rows are read and written. Of new rows with one key the one of
    least hash, then text, counts. Nulls in a key are equal. The number of buckets is that of the table's first version.
    """
    spark = rows.sparkSession
    old = manifest(spark, path)
    if old is not None:
        buckets = int(old["layout"].rsplit(" ", 1)[1])
    layout = f"keys {', '.join(on)} in buckets {buckets}"
    _checked(rows, old, layout)
    if buckets > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} buckets")
    part = F.concat(F.lit("b"), F.pmod(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in on]), F.lit(buckets)).cast("string"))
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    # one row for each key by an aggregate that is summed before the shuffle
    new = rows.groupBy(*[F.col(c).alias(f"key_{i}_") for i, c in enumerate(on)]).agg(F.min_by(whole, F.struct(F.xxhash64(line), line)).alias("row_")).select("row_.*")
    if old is not None:
        touched = [r[0] for r in new.select(part.alias("part_")).distinct().collect()]  # at most ``buckets``
        known = _read(spark, path, old, touched).select(*rows.columns)
        keys = new.select(*[F.col(c).alias(f"key_{i}_") for i, c in enumerate(on)])
        same = [F.col(c).eqNullSafe(F.col(f"key_{i}_")) for i, c in enumerate(on)]
        new = known.join(keys, same, "left_anti").unionByName(new)
    return _stage(spark, path, new.withColumn("part_", part), old, layout)


def clean(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes what the last ``keep`` versions do not read; the number of folders that went.

    Staged folders of runs that are still at work go too, so nothing else may write meanwhile.
    """
    known = versions(spark, path)
    used: set[str] = set()
    for v in known[-keep:]:
        used |= {p["folder"] for p in manifest(spark, path, v)["parts"].values()}
    for v in known[:-keep]:
        drop_folder(spark, f"{path}/manifests/{v}.json")
    gone = 0
    for run in _listed(spark, f"{path}/data"):
        for part in _listed(spark, f"{path}/data/{run}"):
            if part.startswith("part_=") and f"data/{run}/{part}" not in used:
                drop_folder(spark, f"{path}/data/{run}/{part}")
                gone += 1
        if not any(f.startswith(f"data/{run}/") for f in used):
            drop_folder(spark, f"{path}/data/{run}")
    return gone
