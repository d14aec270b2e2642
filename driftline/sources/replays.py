"""Drives exported for replay: a slice of frames with its fixes and true track, the roads around it, and an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import roads
from . import tables, versions

NO_ROADS = '{"type":"FeatureCollection","features":[]}'


def _slice(start_s: float, minutes: float, rate: int) -> tuple[int, int]:
    low = int(start_s * rate)
    return low, low + int(minutes * 60 * rate)


def replay_texts(frames: DataFrame, key: str, index: str, start_s: float = 600.0, minutes: float = 30.0, rate: int = 10) -> DataFrame:
    """``key, frames, replay``: for each drive with frames in the slice its replay as the text of one JSON file.

    Frames are numbered by ``index`` from 0, ``rate`` of them a second, with ``ax..gz, lat, lon`` and, where there is a
    fix, ``fix_lat`` and ``fix_lon, fix_speed, fix_heading, fix_accuracy``. A slice has at most ``minutes`` of frames,
    which bounds a file; one that begins after the end of a drive gives no row, one that ends after it is shorter.
    Numbers in it count from the slice's first frame. A null is a null in the file.
    """
    low, high = _slice(start_s, minutes, rate)
    b = tables.replay_bundle(frames, key, index, low, high, rate).withColumn("frames", F.floor(F.size("imu") / 6))
    place = lambda p, *more: F.array(p["_i"].cast("double"), *more)
    fixes = F.transform("gnss", lambda f: place(f, F.round(f["fix_lat"], 7), F.round(f["fix_lon"], 7), F.round(f["fix_speed"], 2), F.round(f["fix_heading"], 1), f["fix_accuracy"].cast("double")))
    truth = F.transform("gt", lambda p: place(p, F.round(p["lat"], 7), F.round(p["lon"], 7)))
    head = F.col(key).cast("string").alias("trip"), F.lit(rate).alias("rate_hz"), F.lit(float(start_s)).alias("start_s"), "frames"
    return b.select(key, "frames", F.to_json(F.struct(*head, "imu", fixes.alias("gnss"), truth.alias("gt"))).alias("replay"))


def roads_around(frames: DataFrame, vertices: DataFrame, key: str, index: str, start_s: float = 600.0, minutes: float = 30.0, margin_m: float = 400.0, rate: int = 10) -> DataFrame:
    """The vertices ``key, way, e, n`` of whole ways that have one less than ``margin_m`` outside the slice's box.

    Frames and vertices have places ``e, n`` in the same plane; those without one count for nothing. A way's vertices
    are dealt by drive and way, so one large map is many tasks.
    """
    low, high = _slice(start_s, minutes, rate)
    box = frames.where(F.col(index).between(low, high - 1)).groupBy(key).agg(*[f(c).alias(f"{c}_{n}_") for c in ("e", "n") for f, n in ((F.min, "low"), (F.max, "high"))])
    near = lambda c: (F.col(c) > F.col(f"{c}_low_") - margin_m) & (F.col(c) < F.col(f"{c}_high_") + margin_m)
    marked = vertices.join(box, key).withColumn("near_", F.coalesce(near("e") & near("n"), F.lit(False)))
    return marked.withColumn("near_", F.max("near_").over(Window.partitionBy(key, "way"))).where("near_").select(*vertices.columns)


def export(frames: DataFrame, vertices: DataFrame, path: str, key: str, index: str, start_s: float = 600.0, minutes: float = 30.0, margin_m: float = 400.0, rate: int = 10) -> DataFrame:
    """Writes the replays and clipped maps of all drives of ``frames`` and puts them in the index, which is returned.

    ``path`` has three tables that change by versions: ``replays`` (key, replay), ``maps`` (key, geojson) and ``index``
    (key, frames, minutes). A drive exported before is replaced in each, others stay; the index is published last, so
    it names nothing that is not there. A drive without roads nearby, or with a null key, has an empty map. Vertices are as
    ``roads.feature_collections`` takes them, with ``e, n``.
    """
    spark = frames.sparkSession
    texts = tables.shared_table(spark, replay_texts(frames, key, index, start_s, minutes, rate), "replays")
    maps = roads.feature_collections(roads_around(frames, vertices, key, index, start_s, minutes, margin_m, rate), key)
    maps = texts.select(key).join(maps, key, "left").withColumn("geojson", F.coalesce("geojson", F.lit(NO_ROADS)))
    versions.upsert(texts.select(key, "replay"), f"{path}/replays", [key])
    versions.upsert(maps, f"{path}/maps", [key])
    versions.upsert(texts.select(key, "frames", F.round(F.col("frames") / (60 * rate), 1).alias("minutes")), f"{path}/index", [key])
    tables.drop_table(texts)
    return versions.read(spark, f"{path}/index")
