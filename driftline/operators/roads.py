"""Road graphs: segments from vertices or coordinates, cells, nearby segments, shortest paths, one matching step."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.angles import wrap_pi

#: The road classes that vehicles use.
HIGHWAY_CLASSES = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link",
    "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "road",
)
CELL_M = 50.0
#: Points of a cell that one task meets with the cell's segments.
MOST_IN_CELL = 100_000


def oneway_direction(oneway: Column, highway: Column, junction: Column) -> Column:
    """1 along the way, -1 against it, 0 both: the tag, or what roundabouts and motorways imply unless it says no."""
    tag = F.lower(F.coalesce(oneway.cast("string"), F.lit("")))
    implied = F.lower(F.coalesce(junction, F.lit(""))).isin("roundabout", "circular") | F.coalesce(highway, F.lit("")).isin("motorway", "motorway_link")
    return (
        F.when(tag.isin("-1", "reverse"), -1).when(tag.isin("yes", "true", "1"), 1)
        .when(tag.isin("no", "false", "0"), 0).when(implied, 1).otherwise(0)
    )


def vertex_segments(vertices: DataFrame, way: str, position: str, e: str, n: str, node: Column, keep: list[str]) -> DataFrame:
    """Segments between consecutive vertices of each way, without those that start and end at one node."""
    w = Window.partitionBy(way).orderBy(position)
    rows = vertices.withColumn("_node", node).select(
        way, *keep, F.col(e).alias("e1"), F.col(n).alias("n1"), F.col("_node").alias("node1"),
        F.lead(e).over(w).alias("e2"), F.lead(n).over(w).alias("n2"), F.lead("_node").over(w).alias("node2"), F.col(position).alias("part"),
    )
    rows = rows.where(F.col("node2").isNotNull() & (F.col("node1") != F.col("node2")))
    return with_geometry(rows)


def with_geometry(segments: DataFrame) -> DataFrame:
    """Adds length and heading of segments ``e1, n1, e2, n2``."""
    de, dn = F.col("e2") - F.col("e1"), F.col("n2") - F.col("n1")
    return segments.withColumn("length", F.hypot(de, dn)).withColumn("psi", F.atan2(dn, de))


def snapped_node(e: Column, n: Column, lattice: float = 0.5) -> Column:
    """A node key shared by points that round to one place of the lattice."""
    return F.concat_ws(":", F.bround(e / lattice).cast("long"), F.bround(n / lattice).cast("long"))


def rounded_node(lon: Column, lat: Column, places: int = 7) -> Column:
    return F.concat_ws(":", F.round(lon * 10**places).cast("long"), F.round(lat * 10**places).cast("long"))


_PROPERTIES = "struct<id:string,highway:string,name:string,oneway:string,junction:string>"
_FEATURE = f"struct<properties:{_PROPERTIES},geometry:struct<type:string,coordinates:string>>"


def _vertices(features: DataFrame) -> DataFrame:
    """The vertices of ``file, feature, f``: parsed features and what tells them apart."""
    single = F.array(F.from_json("f.geometry.coordinates", "array<array<double>>"))
    lines = F.when(F.col("f.geometry.type") == "LineString", single).when(F.col("f.geometry.type") == "MultiLineString", F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    ways = features.select("file", "feature", "f.properties.*", F.posexplode(lines).alias("line", "coords")).where(F.size("coords") >= 2)
    ways = ways.select(F.concat_ws("/", "file", "feature", "line").alias("way"), "id", "highway", "oneway", "junction", F.posexplode("coords").alias("position", "xy"))
    return ways.select("way", "id", "highway", "oneway", "junction", "position", F.col("xy")[0].alias("lon"), F.col("xy")[1].alias("lat"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Vertices ``way, id, highway, oneway, junction, position, lon, lat`` of the lines of a GeoJSON file.

    ``way`` is the file's name with the places of the feature and of the line in it, so features need no ``id``. A file
    is one row in one task; :func:`read_large_geojson` reads a large one by many.
    """
    features = spark.read.schema(f"features array<{_FEATURE}>").option("multiLine", True).json(path)
    return _vertices(features.select(F.col("_metadata.file_name").alias("file"), F.posexplode("features").alias("feature", "f")))


def read_large_geojson(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_geojson`, of files that many tasks share: a file is cut where a feature says that it is one.

    Each feature must begin with its ``type``, as map tools write them; another file, or one that is cut off, is an
    error and never a part of the map. Features are told apart by a hash of their text, so features of one file that
    are equal in text count once.
    """
    pieces = spark.read.option("lineSep", '"Feature"').text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    begins = r',\s*\{\s*"type"\s*:\s*$'  # the next feature's type
    head = F.rlike("value", F.lit(r"^\s*\{"))
    if_first = F.rlike("value", F.lit(r'\[\s*\{\s*"type"\s*:\s*$')) | F.rlike("value", F.lit(r'"features"\s*:\s*\[\s*\]'))
    ends = F.rlike("value", F.lit(begins)) | F.rlike("value", F.lit(r"(?s)\}\s*\]\s*(,.*)?\}\s*$"))
    text = F.concat(F.lit('{"type":"Feature"'), F.regexp_replace("value", begins, ""))
    parsed = F.from_json(text, _FEATURE)
    wrong = F.concat(F.lit("features do not begin with their type in "), F.col("file"))
    good = F.when(head, if_first).otherwise(ends & F.rlike("value", F.lit(r"^\s*[,}]")) & parsed.isNotNull())
    checked = F.when(good, text).otherwise(F.raise_error(wrong))
    told = pieces.select("file", F.when(head, F.when(if_first, F.lit(None).cast("string")).otherwise(F.raise_error(wrong))).otherwise(checked).alias("text"))
    told = told.where(F.col("text").isNotNull()).withColumn("feature", F.hex(F.xxhash64("text")))
    return _vertices(told.dropDuplicates(["file", "feature"]).select("file", "feature", F.from_json("text", _FEATURE).alias("f")))


def feature_collections(vertices: DataFrame, key: str) -> DataFrame:
    """``key, geojson``: the ways of each key, an area of bounded size, as the text of one GeoJSON file.

    Vertices are those of :func:`read_geojson` with the key. A way of one vertex is left out.
    """
    point = F.struct("position", F.array(F.round("lon", 7), F.round("lat", 7)).alias("xy"))
    properties = [c for c in ("id", "highway", "name", "oneway", "junction") if c in vertices.columns]
    ways = vertices.groupBy(key, "way").agg(F.array_sort(F.collect_list(point)).alias("points"), *[F.first(c, ignorenulls=True).alias(c) for c in properties])
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("points", lambda p: p["xy"]).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))
    listed = ways.where(F.size("points") >= 2).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("way", feature.alias("feature")))).alias("ways"))
    return listed.select(key, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("ways", lambda w: w["feature"]).alias("features"))).alias("geojson"))


def drivable(ways: DataFrame, highway: str = "highway") -> DataFrame:
    return ways.where(F.col(highway).isin(*HIGHWAY_CLASSES))


def clip_lines(lines: DataFrame, coords: str, low_e: float, high_e: float, low_n: float, high_n: float) -> DataFrame:
    """Lines with a vertex inside the box; vertices are structs with ``e`` and ``n``."""
    return lines.where(F.exists(coords, lambda p: p["e"].between(low_e, high_e) & p["n"].between(low_n, high_n)))


def segment_cells(segments: DataFrame, segment: str, cell: float = CELL_M) -> DataFrame:
    """``cx, cy, segment`` of every cell in a segment's bounding box."""
    at = lambda f, a, b: F.floor(f(a, b) / cell).cast("long")
    xs = F.sequence(at(F.least, "e1", "e2"), at(F.greatest, "e1", "e2"))
    ys = F.sequence(at(F.least, "n1", "n2"), at(F.greatest, "n1", "n2"))
    return segments.select(segment, F.explode(xs).alias("cx"), ys.alias("_ys")).select(segment, "cx", F.explode("_ys").alias("cy"))


def _projection(e: Column, n: Column) -> tuple[Column, Column, Column, Column]:
    de, dn = F.col("e2") - F.col("e1"), F.col("n2") - F.col("n1")
    t = ((e - F.col("e1")) * de + (n - F.col("n1")) * dn) / F.greatest(de * de + dn * dn, F.lit(1e-9))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    foot_e, foot_n = F.col("e1") + t * de, F.col("n1") + t * dn
    return t, foot_e, foot_n, F.hypot(e - foot_e, n - foot_n)


def nearby(points: DataFrame, segments: DataFrame, point: str, segment: str, radius: float, cell: float = CELL_M, most: int = MOST_IN_CELL) -> DataFrame:
    """Pairs of points ``e, n`` and segments within ``radius``: fraction, foot point and distance.

    A segment is in all cells that its box and ``radius`` around it touch, a point in the one it stands in. So points
    are shuffled once, as they are, and each pair meets once. A cell with more than ``most`` points is split in parts,
    to which its points are dealt by a hash, and its segments go to every part. Points without a place match nothing.
    """
    size = max(cell, radius / 2)
    at = lambda c: F.floor(c / size).cast("long")
    here = points.where(F.col("e").isNotNull() & F.col("n").isNotNull()).withColumns({"_cx": at(F.col("e")), "_cy": at(F.col("n"))})
    # full cells only: at most a row for each ``most`` points
    full = here.groupBy("_cx", "_cy").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("_cx", "_cy", F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    here = here.join(F.broadcast(full), ["_cx", "_cy"], "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(point, "e", "n"), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    span = lambda a, b: F.sequence(at(F.least(a, b) - radius), at(F.greatest(a, b) + radius))
    there = segments.withColumn("_cx", F.explode(span(F.col("e1"), F.col("e2")))).withColumn("_cy", F.explode(span(F.col("n1"), F.col("n2"))))
    there = there.join(F.broadcast(full), ["_cx", "_cy"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    t, foot_e, foot_n, distance = _projection(F.col("e"), F.col("n"))
    met = here.join(there, ["_cx", "_cy", "_part"]).drop("_cx", "_cy", "_part")
    return met.withColumns({"fraction": t, "foot_e": foot_e, "foot_n": foot_n, "distance": distance}).where(F.col("distance") <= radius)


def nearest(pairs: DataFrame, point: str, segment: str, n: int = 12) -> DataFrame:
    """The ``n`` nearest segments of each point, ties by segment, with their rank."""
    nth = F.row_number().over(Window.partitionBy(point).orderBy("distance", segment))
    return pairs.withColumn("rank", nth).where(F.col("rank") <= n)


def travel_heading(psi: Column, road: Column, oneway: Column) -> Column:
    """The road's direction of travel: fixed on one-way roads, else the one closer to ``psi``; a tie goes forward."""
    back = wrap_pi(road + math.pi)
    closer = F.abs(wrap_pi(psi - road)) <= F.abs(wrap_pi(psi - back))
    return F.when(oneway == 1, road).when(oneway == -1, back).when(closer, road).otherwise(back)


def emission_scores(pairs: DataFrame, sigma: Column, sigma_heading_deg: float = 25.0, least_speed: float = 2.0) -> DataFrame:
    """Adds ``road_psi`` and the log ``score`` of standing on a segment, from columns ``psi, speed, oneway, distance``."""
    pairs = pairs.withColumn("road_psi", travel_heading(F.col("psi"), F.col("road"), F.col("oneway")))
    turn = F.abs(wrap_pi(F.col("psi") - F.col("road_psi"))) / math.radians(sigma_heading_deg)
    along = -0.5 * F.pow(F.col("distance") / sigma, 2)
    return pairs.withColumn("score", F.when(F.col("speed") > least_speed, along - 0.5 * turn * turn).otherwise(along))


def posterior(scored: DataFrame, point: str, segment: str, near_m: float = 3.0, near_deg: float = 20.0) -> DataFrame:
    """Soft-max over a point's candidates and ``confidence``: the mass of those on the same road as the best."""
    own = Window.partitionBy(point)
    out = scored.withColumn("_x", F.exp(F.col("score") - F.max("score").over(own)))
    out = out.withColumn("posterior", F.col("_x") / F.sum("_x").over(own)).drop("_x")
    first = own.orderBy(F.desc("score"), segment).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.first(F.struct(F.col(segment).alias("seg"), "foot_e", "foot_n", "road_psi")).over(first)
    out = out.withColumn("_b", best)
    same = (F.hypot(F.col("foot_e") - F.col("_b.foot_e"), F.col("foot_n") - F.col("_b.foot_n")) < near_m) & (
        F.abs(wrap_pi(F.col("road_psi") - F.col("_b.road_psi"))) < math.radians(near_deg)
    )
    out = out.withColumn("is_best", F.col(segment) == F.col("_b.seg"))
    return out.withColumn("confidence", F.sum(F.when(same, F.col("posterior")).otherwise(0.0)).over(own)).drop("_b")


def bounded_distances(starts: DataFrame, edges: DataFrame, cutoff: float | str) -> DataFrame:
    """``source, node, distance`` of nodes within ``cutoff`` over undirected ``edges(a, b, length)``.

    ``starts(source, node, distance)`` are the nodes first reached; ``cutoff`` is a number or the column of ``starts``
    that has each source's own. Each round sends improved distances one edge on; a round's result is written to the
    shared folder, and the last one improves nothing.
    """
    spark = starts.sparkSession
    from ..sources.tables import drop_table, shared_table

    both = edges.select("a", "b", "length").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "length")).groupBy("a", "b").agg(F.min("length").alias("length"))
    both = shared_table(spark, both, "edges")
    limit = F.col(cutoff) if isinstance(cutoff, str) else F.lit(float(cutoff))
    known = starts.select("source", "node", "distance", limit.alias("cutoff")).where("distance <= cutoff").groupBy("source", "node", "cutoff").agg(F.min("distance").alias("distance"))
    known = shared_table(spark, known.withColumn("new", F.lit(True)), "distances")
    while True:
        sent = known.where("new").join(both, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), "cutoff", (F.col("distance") + F.col("length")).alias("distance"))
        sent = sent.where("distance <= cutoff").withColumn("old", F.lit(False))
        every = known.select("source", "node", "cutoff", "distance", F.lit(True).alias("old")).unionByName(sent)
        after = every.groupBy("source", "node", "cutoff").agg(F.min("distance").alias("distance"), F.min(F.when(F.col("old"), F.col("distance"))).alias("before"))
        after = after.select("source", "node", "cutoff", "distance", (F.col("before").isNull() | (F.col("distance") < F.col("before"))).alias("new"))
        before, known = known, shared_table(spark, after, "distances")
        drop_table(before)
        if known.where("new").isEmpty():
            drop_table(both)
            return known.select("source", "node", "distance")
