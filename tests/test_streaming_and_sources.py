"""Streams give what batches give; sources and sinks read back what they write."""

import json
import math

import pytest
from pyspark.sql import functions as F

from driftline.functions import angles, motion
from driftline.operators import alignment, keyed, outages, roads
from driftline.plans import catalogue
from driftline.sources import tables
from driftline.streaming import stateful


def finished(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


@pytest.fixture(scope="module")
def frames(spark, sf_dir, tmp_path_factory):
    frames = catalogue._frames(catalogue.events(spark, sf_dir)).where("trip < 4")
    path = str(tmp_path_factory.mktemp("frames"))
    cut = frames.select(F.percentile("t", 0.5)).first()[0]
    frames.where(F.col("t") < cut).coalesce(1).write.mode("append").parquet(path)
    frames.where(F.col("t") >= cut).coalesce(1).write.mode("append").parquet(path)
    return path


def test_stream_equals_batch(spark, frames):
    """In order of files the second half of each trip comes in a later micro-batch."""
    batch = spark.read.parquet(frames)
    import os

    files = sorted((f for f in os.listdir(frames) if f.endswith(".parquet")), key=lambda f: spark.read.parquet(f"{frames}/{f}").agg(F.min("t")).first()[0])
    for k, f in enumerate(files):
        os.utime(f"{frames}/{f}", (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(frames)
    got = finished(stateful.navigate_stream(stream, "trip"), "nav")
    want = keyed.navigate(batch, "trip")
    pick = lambda df: sorted((r.trip, round(r.t, 6), round(r.east, 6), round(r.speed, 6), r.mode) for r in df.collect())
    assert pick(got) == pick(want)
    assert got.agg(F.max("late")).first()[0] == 0


def test_windowed_means_stream(spark, sf_dir, tmp_path):
    ev = catalogue.events(spark, sf_dir).select("trip", F.col("ts").cast("timestamp").alias("stamp"), "value")
    ev.coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/ev")
    got = finished(stateful.decimated_stream(stream, "stamp", "trip", "1 day", ["value"]), "means")
    assert got.count() > 0 and got.agg(F.min("n")).first()[0] >= 1


def test_reception_is_watched(spark, sf_dir, tmp_path):
    ev = catalogue.events(spark, sf_dir).select("trip", F.col("ts").cast("timestamp").alias("stamp"))
    ev.coalesce(1).write.parquet(f"{tmp_path}/fx")
    stream = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/fx").withWatermark("stamp", "1 hour")
    got = finished(stateful.watch_reception(stream, "trip", "stamp", 3_600_000), "watched")
    assert got.where("not lost").agg(F.sum("fixes")).first()[0] == ev.count()


def test_trip_logs(spark, tmp_path):
    for d, names in (("Driver A/S1", ["S-1.csv", "V-1.csv"]), ("Driver B", ["S-2.csv", "V-2.csv"]), ("S3", ["S-3.csv"])):
        (tmp_path / d).mkdir(parents=True)
        for n in names:
            (tmp_path / d / n).write_bytes(" GPS SPEED (Kmh) , X° \n36,1\n".encode("latin-1"))
    log = tables.read_log(spark, str(tmp_path / "S3/S-3.csv"))
    assert log.columns == ["GPS SPEED (Kmh)", "X°"] and tables.column_starting(log, "GPS SP") == "GPS SPEED (Kmh)"
    with pytest.raises(KeyError):
        tables.column_starting(log, "none")
    assert [r.trip for r in tables.trip_folders(spark, str(tmp_path)).collect()] == ["S1", "M"]


def test_trips_partitioned(spark, sf_dir, tmp_path):
    tables.write_trips(catalogue.events(spark, sf_dir).select("trip", "t", "value"), f"{tmp_path}/t")
    one = tables.read_trips(spark, f"{tmp_path}/t", 3)
    assert one.count() > 0 and "PartitionFilters: [isnotnull(trip" in one._jdf.queryExecution().executedPlan().toString()


def test_geojson(spark, tmp_path):
    line = {"type": "Feature", "properties": {"id": 1, "highway": "residential"}, "geometry": {"type": "LineString", "coordinates": [[91.736, 26.144], [91.736, 26.145], [91.737, 26.145]]}}
    multi = {"type": "Feature", "properties": {"id": 2, "highway": "footway"}, "geometry": {"type": "MultiLineString", "coordinates": [[[91.0, 26.0], [91.1, 26.0]], [[91.2, 26.0]]]}}
    (tmp_path / "m.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [line, multi]}))
    v = tables_vertices = roads.read_geojson(spark, str(tmp_path / "m.geojson"))
    assert {r.way for r in v.collect()} == {"m.geojson/0/0", "m.geojson/1/0"} and {r.id for r in roads.drivable(tables_vertices).collect()} == {"1"}
    e, n = angles.to_enu(F.col("lat"), F.col("lon"), F.lit(26.144), F.lit(91.736))
    s = roads.vertex_segments(roads.drivable(v).withColumn("e", e).withColumn("n", n), "way", "position", "e", "n", roads.rounded_node(F.col("lon"), F.col("lat")), [])
    got = s.orderBy("part").collect()
    assert abs(got[0].length - 110.7) < 1 and abs(got[1].length - 100.0) < 0.5 and got[0].node2 == got[1].node1


def test_geojson_without_ids(spark, tmp_path):
    """Two streets that share an end and have no id stay two ways of one segment each."""
    street = lambda *xy: {"type": "Feature", "properties": {"highway": "residential"}, "geometry": {"type": "LineString", "coordinates": list(xy)}}
    (tmp_path / "n.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [street([10.0, 50.0], [10.001, 50.0]), street([10.001, 50.0], [10.001, 50.002])]}))
    v = roads.read_geojson(spark, str(tmp_path / "n.geojson"))
    e, n = angles.to_enu(F.col("lat"), F.col("lon"), F.lit(50.0), F.lit(10.0))
    s = roads.vertex_segments(v.withColumn("e", e).withColumn("n", n), "way", "position", "e", "n", roads.rounded_node(F.col("lon"), F.col("lat")), []).orderBy("way").collect()
    assert len(s) == 2 and s[0].node2 == s[1].node1
    # a degree of latitude is 111.2 km here, one of longitude 71.7 km
    assert abs(s[0].length - 71.7) < 0.2 and abs(s[1].length - 222.5) < 0.3


@pytest.mark.parametrize("compact", [True, False])
def test_large_geojson_is_read_by_many_tasks(spark, tmp_path, compact):
    """The same vertices as the whole-file reader, with texts that look like borders, an id or none, and a member after the features."""
    import random

    rng, features = random.Random(2), []
    for k in range(700):
        xy = lambda: [[round(rng.uniform(0, 9), 7), round(rng.uniform(0, 9), 7)] for _ in range(rng.randint(1, 6))]
        multi = k % 9 == 0
        names = ["Straße \"x\"", "Features", "}, {", "FeatureCollection", None]
        features.append({"type": "Feature", "properties": {"id": k if k % 3 else None, "highway": "road", "name": names[k % 5]}, "geometry": {"type": "MultiLineString" if multi else "LineString", "coordinates": [xy(), xy()] if multi else xy()}})
    text = json.dumps({"type": "FeatureCollection", "features": features, "crs": {"type": "name"}}, ensure_ascii=False, **({"separators": (",", ":")} if compact else {"indent": 1}))
    (tmp_path / "m.geojson").write_text(text, encoding="utf-8")
    path, before = str(tmp_path / "m.geojson"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    pick = lambda d: sorted(((r.id, r.highway, r.position, r.lon, r.lat) for r in d.collect()), key=str)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        got = roads.read_large_geojson(spark, path)
        assert spark.read.option("lineSep", '"Feature"').text(path).rdd.getNumPartitions() > 5
        assert pick(got) == pick(roads.read_geojson(spark, path)) and got.select("way").distinct().count() == roads.read_geojson(spark, path).select("way").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_large_geojson_refuses_other_orders(spark, tmp_path):
    good = {"type": "Feature", "properties": {"id": 1}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}
    late = {"properties": {"id": 1}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, "type": "Feature"}
    odd = {"type": "Feature", "properties": {"name": "Feature"}, "geometry": good["geometry"]}
    for k, features in enumerate(([late, late], [good, late], [good, odd, good])):
        (tmp_path / f"{k}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
        with pytest.raises(Exception, match="do not begin with their type"):
            roads.read_large_geojson(spark, str(tmp_path / f"{k}.geojson")).collect()
    (tmp_path / "cut.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [good, good]})[:-30])
    with pytest.raises(Exception, match="do not begin with their type"):
        roads.read_large_geojson(spark, str(tmp_path / "cut.geojson")).collect()
    (tmp_path / "none.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    assert roads.read_large_geojson(spark, str(tmp_path / "none.geojson")).count() == 0


def test_report_round_trip(spark, sf_dir):
    rows = catalogue._scores(catalogue.events(spark, sf_dir)).select(F.col("trip").cast("string").alias("trip"), F.lit("60s").alias("scenario"), F.lit("full").alias("config"), "start", "end", "distance_m", "drift_pct", "valid")
    back = tables.report_rows(tables.nested_report(rows))
    pick = lambda d: sorted((r.trip, r.start, r.end, round(r.distance_m, 6), r.valid) for r in d.collect())
    assert pick(back) == pick(rows)


def test_replay_round_trip(spark):
    rows = [("a", i, 0.1 * i, 0.0, 9.8, 0.0, 0.0, 0.01, *((50.0, 1.0, 3.0, 90.0, 5.0) if i % 10 == 0 else (None,) * 5), 50.0, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "trip string, idx long, ax double, ay double, az double, gx double, gy double, gz double, fix_lat double, fix_lon double, fix_speed double, fix_heading double, fix_accuracy double, lat double, lon double")
    back = tables.bundle_frames(tables.replay_bundle(df, "trip", "idx", 10, 30), "trip").orderBy("idx").collect()
    assert len(back) == 20 and back[3].ax == pytest.approx(1.3) and back[0].fix_lat == 50.0 and back[1].fix_lat is None


def test_calibration_problems(spark):
    good = {"gyro_bias_rad_s": {"gx": 0.005, "gy": -0.002, "gz": 0.015}, "resting_gravity_vector": {"x": 0.1, "y": 6.9, "z": 6.9}}
    bad = [dict(good, gyro_bias_rad_s={"gx": 1.0, "gy": 0, "gz": 0}), dict(good, resting_gravity_vector={"x": 0, "y": 0, "z": 1}), {"gyro_bias_rad_s": None}]
    df = spark.createDataFrame([(json.dumps(x),) for x in [good, *bad]], "j string").select(F.from_json("j", tables.CALIBRATION).alias("c"))
    got = df.select(tables.calibration_problem(F.col("c")).alias("p"), tables.vertical_bias(F.col("c")).alias("b")).collect()
    assert got[0].p is None and got[0].b == pytest.approx((0.1 * 0.005 + 6.9 * 0.013) / (0.01 + 2 * 6.9**2) ** 0.5) and all(r.p for r in got[1:])


def test_salted_asof_equals_plain(spark, sf_dir):
    ev = catalogue.events(spark, sf_dir)
    a, b = ev.where("kind = 'click'").select("trip", "t", "event_id"), ev.where("kind = 'view'")
    pick = lambda d: sorted(map(str, d.collect()))
    assert pick(alignment.asof_backward(a, b, "trip", "t", ["value"])) == pick(alignment.asof_backward(a, b, "trip", "t", ["value"], bucket=86400.0))
    assert pick(alignment.interpolate(a, b, "trip", "t", ["value"])) == pick(alignment.interpolate(a, b, "trip", "t", ["value"], bucket=86400.0))


def test_lag_recovery(spark):
    import math
    import random

    rng = random.Random(1)
    noise = [rng.gauss(0, 1) for _ in range(420)]
    smooth = [sum(noise[i : i + 10]) for i in range(400)]
    df = spark.createDataFrame([(i, smooth[i + 7] if i + 7 < 400 else 0.0, smooth[i]) for i in range(393)], "i long, a double, b double")
    best = alignment.best_lag(alignment.lag_correlation(df, "i", "a", "b", 50)).first()
    assert best.lag == 7 and best.r > 0.97 and not math.isnan(best.r)


def test_compass_and_scalars(spark):
    row = spark.range(1).select(*[angles.compass_to_psi(F.lit(float(c))).alias(f"c{c}") for c in (0, 90, 180, 270)], motion.confidence(F.lit(1.0)).alias("conf"), motion.fix_quality(F.lit(30.0)).alias("q"), motion.reference_scalars(F.lit(5.0), F.lit(300.0), F.lit(True)).alias("s")).first()
    import math

    assert [round(row[f"c{c}"], 6) for c in (0, 90, 180, 270)] == [round(v, 6) for v in (math.pi / 2, 0, -math.pi / 2, -math.pi)]
    assert row.conf == 0.5 and row.q == pytest.approx(0.1) and row.s == [5.0, 120.0, 1.0]


def test_robustness_of_random_draws(spark):
    rows = [("a", k, s, float((k * 7 + s) % 20)) for k in range(40) for s in range(3) if (k + s) % 4] + [("b", 0, 0, 4.0), ("b", 0, 1, 12.0)]
    df = spark.createDataFrame(rows, "config string, outage long, seed long, drift double")
    got = {r.config: r for r in outages.robustness(df, ["config"], "outage", "seed", "drift", 300).collect()}
    a, b = got["a"], got["b"]
    values = sorted(r[3] for r in rows if r[0] == "a")
    assert (a.n_outages, a.n_observations, a.seeds) == (40, 90, 3) and (b.n_outages, b.n_observations, b.seeds) == (1, 2, 2)
    assert a.median == (values[44] + values[45]) / 2 and a.pass_rate == pytest.approx(sum(v < 10 for v in values) / 90)
    # the spread of a share of 90 values in 40 clusters is near sqrt(1 / 4 / 40); one cluster alone has no spread
    assert a.median_low < a.median < a.median_high and 0.15 < a.pass_rate_high - a.pass_rate_low < 0.45
    assert (b.median_low, b.median_high, b.pass_rate_low, b.pass_rate_high) == (8.0, 8.0, 0.5, 0.5)


def test_parsed_logs(spark, tmp_path):
    """Logs on disk, with padded names and a clock an hour ahead, to aligned frames."""
    from driftline.operators import trips

    folder = tmp_path / "S9"
    folder.mkdir()
    names = ["DATE (YYYY-MO-DD HH-MI-SS_SSS)", *[f"ACCELEROMETER {c} (m/s)" for c in "XYZ"], *[f"GYROSCOPE {c} (rad/s)" for c in ("Yaw", "Roll", "Pitch")], "GPS LATITUDE (degrees)", "GPS LONGITUDE (degrees)", "GPS SPEED (Kmh)", "GPS ACCURACY (m)", "GPS ORIENTATION (degrees)"]
    stamp = lambda s: f"2019-05-01 {int(s // 3600):02d}-{int(s % 3600 // 60):02d}-{int(s % 60):02d}_{round(s % 1 * 1000):03d}"
    turn = lambda t: 0.3 * math.sin(t)
    phone = [",".join(f" {n} " for n in names)] + [",".join([stamp(10800.0 + 0.1 * k), "0.1", "0.2", "9.8", "0", "0", str(turn(0.1 * k)), str(50 + k // 10 * 1e-5), "8.0", "36", "5", "90"]) for k in range(400)]
    vehicle = ["Time Since Start of Day (seconds),Yaw Rate (deg/sec),Velocity (km/hr),Latitude (degrees),Longitude (degrees),Heading (degrees)"]
    vehicle += [f"{7200 + 0.1 * k},{math.degrees(turn(0.1 * k))},36,{50 + k * 1e-6},8.0,{350 + k % 20}" for k in range(400)]
    (folder / "S-S9.csv").write_text("\n".join(phone), encoding="latin-1")
    (folder / "V-S9.csv").write_text("\n".join(vehicle))
    frames, meta = trips.prepare(*tables.parse_logs(spark, str(tmp_path)), how=trips.Preparation(lag_least=200))
    m = meta.first()
    assert m.trip == "S9" and m.hour_offset_s == 3600 and m.lag_s == 0 and m.lag_corr > 0.99 and m.vertical_gyro_column == "g_pitch" and m.valid_pct == 100
    rows = frames.orderBy("idx").collect()
    assert len(rows) == m.samples == 399 and abs(rows[50].speed - 10) < 1e-9 and abs(rows[50].gz - rows[50].can_yaw) < 1e-6
    assert [r.idx for r in rows if r.fix_new][:3] == [0, 10, 20]
    with pytest.raises(Exception, match="vertical gyro column of trip S9 is g_pitch"):
        trips.prepare(*tables.parse_logs(spark, str(tmp_path)), how=trips.Preparation(lag_least=200, vertical="g_roll"))
    tables.write_metadata(meta, str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).count() == 1


def test_silent_device_loses_reception(spark, tmp_path):
    """Device a sends no more after 10 s; once b has moved the watermark on, a gets one state with the mode changed."""
    import os

    def rows(device, times):
        fix = lambda t: (t, 3.0 * t, 0.0, 3.0, 90.0, 4.0)
        return [(device, float(t), 0.0, 0.0, 9.81, 0.0, 0.0, 0.0, fix(float(t)), 1_700_000_000.0 + t) for t in times]

    schema = "trip string, t double, ax double, ay double, az double, gx double, gy double, gz double, fix struct<t:double,e:double,n:double,speed:double,heading:double,accuracy:double>, at double"
    for k, part in enumerate([rows("a", range(11)) + rows("b", range(11)), rows("b", range(100, 103)), rows("b", [103])]):
        spark.createDataFrame(part, schema).withColumn("stamp", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
        new = [f for f in os.listdir(tmp_path / "f") if f.endswith(".parquet") and os.stat(tmp_path / "f" / f).st_mtime > 2_000_000]
        os.utime(tmp_path / "f" / new[0], (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "f")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f"))
    got = finished(stateful.navigate_stream(stream, "trip", use_model=False, stamp="stamp"), "silence").where("trip = 'a'").orderBy("t").collect()
    assert [r.t for r in got] == [*map(float, range(11)), 12.0]
    assert got[10].mode == outages.AIDED and got[11].mode == outages.DEAD_RECKONING and got[11].quality == 0


def test_tracked_outages_of_a_stream(spark, sf_dir, tmp_path):
    frames = catalogue._shut_frames(catalogue.events(spark, sf_dir))
    frames.coalesce(1).write.parquet(str(tmp_path / "f"))
    frames = spark.read.parquet(str(tmp_path / "f"))
    got = finished(stateful.track_outages(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "f")), "trip", 0.1, every=2), "tracked")
    pick = lambda df: sorted((r.trip, r.start, r.end, round(r.distance_m, 6), round(r.err_m, 6), round(r.drift_pct, 6)) for r in df.collect())
    want = pick(outages.live_log(frames, "trip", "i", 0.1, every=2))
    assert want and pick(got) == want


def test_outage_log_by_hand(spark):
    """Open at frame 2, free at 5: 3 x 10 m east; a second one of 10 m is not logged, a third does not end."""
    rows = [("a", i, i in (2, 3, 4, 7, 11, 12), 10.0 * i, 0.0, 10.0 * i, 3.0) for i in range(13)]
    df = spark.createDataFrame(rows, "trip string, i long, blocked boolean, e double, n double, est_e double, est_n double")
    r = outages.live_log(df, "trip", "i", 0.1, every=1).collect()
    assert [(x.start, x.end, x.distance_m, x.err_m, x.drift_pct) for x in r] == [(2, 5, 30.0, 3.0, 10.0)] and r[0].duration_s == pytest.approx(0.3)


def test_fix_is_taken_once(spark):
    from driftline.operators import trips

    moved = spark.createDataFrame([("a", 100.0 * k, 1.0, -2.0, 9.8, 180.0, 90.0, None, k == 3) for k in range(5)], "trip string, stamp_ms double, ax double, ay double, az double, alpha double, beta double, gamma double, flipped boolean")
    fixes = spark.createDataFrame([("a", 50.0, 1.0, 2.0, float("nan"), 90.0, 5.0), ("a", 210.0, 3.0, 4.0, 5.0, None, 5.0), ("a", 300.0, 5.0, 6.0, 7.0, None, 5.0), ("a", 999.0, 7.0, 8.0, 9.0, None, 5.0)], "trip string, stamp_ms double, lat double, lon double, speed double, heading double, accuracy double")
    got = trips.live_frames(moved, fixes).orderBy("t").collect()
    assert [r.fix and r.fix.lat for r in got] == [None, 1.0, None, 5.0, None] and got[1].fix.speed is None
    assert (got[3].ax, got[3].ay, got[3].az) == (-1.0, 2.0, -9.8) and got[0].gx == pytest.approx(math.pi / 2) and got[0].gz == pytest.approx(math.pi) and got[0].gy == 0


def test_feature_collections_read_back(spark, tmp_path):
    rows = [("t", "w1", "7", "primary", 1, 9.2, 50.1), ("t", "w1", "7", "primary", 0, 9.1, 50.0), ("t", "w2", None, "service", 0, 9.3, 50.0), ("t", "w2", None, "service", 1, 9.4, 50.2), ("t", "w3", "8", "service", 0, 9.4, 50.2)]
    v = spark.createDataFrame(rows, "trip string, way string, id string, highway string, position int, lon double, lat double")
    (tmp_path / "m.geojson").write_text(roads.feature_collections(v, "trip").first().geojson)
    back = roads.read_geojson(spark, str(tmp_path / "m.geojson")).orderBy("way", "position").collect()
    assert [(r.id, r.highway, r.lon, r.lat) for r in back] == [("7", "primary", 9.1, 50.0), ("7", "primary", 9.2, 50.1), (None, "service", 9.3, 50.0), (None, "service", 9.4, 50.2)]
