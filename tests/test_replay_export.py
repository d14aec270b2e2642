"""Drives exported for replay, report tables and the confidence in a road, by hand."""

import json

from pyspark.sql import functions as F

from driftline.operators import roads
from driftline.sources import replays, tables, versions

FRAME = "trip string, idx long, ax double, ay double, az double, gx double, gy double, gz double, e double, n double, lat double, lon double, fix_lat double, fix_lon double, fix_speed double, fix_heading double, fix_accuracy double"
VERTEX = "trip string, way string, position long, highway string, e double, n double, lat double, lon double"


def frames(spark, trips, count=45):
    fix = lambda i: (50.0, 9.000000049 + i, 3.456, None if i == 20 else 90.06, 4.0) if i % 10 == 0 else (None,) * 5
    return spark.createDataFrame([(t, i, 0.123456, 0.0, 9.8, 0.0, 0.0, None if i == 21 else 0.5, 10.0 * i, 0.0, 50.0, 9.0 + i, *fix(i)) for t in trips for i in range(count)], FRAME)


def test_replays_by_hand(spark):
    """From 2 s on, two seconds of ten frames: frames 20 to 39; a drive that ended before has no file, nulls stay nulls."""
    df = frames(spark, ["a"]).unionByName(frames(spark, ["short"], 20)).unionByName(frames(spark, ["cut"], 25))
    got = {r.trip: r for r in replays.replay_texts(df, "trip", "idx", 2.0, 2 / 60, 10).collect()}
    assert set(got) == {"a", "cut"} and got["a"].frames == 20 and got["cut"].frames == 5
    x = json.loads(got["a"].replay)
    assert (x["trip"], x["rate_hz"], x["start_s"], x["frames"]) == ("a", 10, 2.0, 20)
    assert len(x["imu"]) == 120 and x["imu"][:6] == [0.1235, 0.0, 9.8, 0.0, 0.0, 0.5] and x["imu"][11] is None
    assert x["gnss"] == [[0, 50.0, 29.0, 3.46, None, 4.0], [10, 50.0, 39.0, 3.46, 90.1, 4.0]]
    assert x["gt"] == [[0, 50.0, 29.0], [10, 50.0, 39.0]]


def test_exports_replace_and_stay(spark, tmp_path):
    """Ways within 100 m of the slice stay whole, one at exactly 100 m goes; a second export changes only its own drives."""
    way = lambda trip, name, *places: [(trip, name, k, "service", e, n, 50.0 + n / 1e5, 9.0 + (e or 0.0) / 1e5) for k, (e, n) in enumerate(places)]
    v = spark.createDataFrame([*way("a", "in", (250.0, 99.0), (250.0, 5000.0)), *way("a", "edge", (250.0, 100.0), (250.0, 200.0)), *way("a", "far", (900.0, 0.0), (950.0, 0.0)), *way("a", "point", (250.0, 0.0)), *way("a", "none", (None, 0.0), (900.0, 0.0)), *way("c", "in", (300.0, 0.0), (310.0, 0.0))], "trip string, way string, position long, highway string, e double, n double, lat double, lon double")
    path, how = str(tmp_path / "x"), {"key": "trip", "index": "idx", "start_s": 2.0, "minutes": 2 / 60, "margin_m": 100.0}
    first = replays.export(frames(spark, ["a", "b"]), v, path, **how)
    assert sorted(map(tuple, first.select("trip", "frames", "minutes").collect())) == [("a", 20, 0.0), ("b", 20, 0.0)]
    maps = {r.trip: json.loads(r.geojson)["features"] for r in versions.read(spark, f"{path}/maps").collect()}
    assert [len(maps["a"]), maps["b"]] == [1, []] and maps["a"][0]["geometry"]["coordinates"] == [[9.0025, 50.00099], [9.0025, 50.05]]
    before = {r.trip: r.replay for r in versions.read(spark, f"{path}/replays").collect()}
    again = replays.export(frames(spark, ["a", "c"], 30).withColumn("ax", F.lit(1.0)), v, path, **how)
    assert sorted(map(tuple, again.select("trip", "frames").collect())) == [("a", 10), ("b", 20), ("c", 10)]
    after = {r.trip: r.replay for r in versions.read(spark, f"{path}/replays").collect()}
    assert set(after) == {"a", "b", "c"} and after["b"] == before["b"] and after["a"] != before["a"] and json.loads(after["a"])["imu"][0] == 1.0
    assert len(json.loads(versions.read(spark, f"{path}/maps").where("trip = 'c'").first().geojson)["features"]) == 1


def test_export_of_nothing(spark, tmp_path):
    none = replays.export(frames(spark, ["a"], 1), spark.createDataFrame([], VERTEX), str(tmp_path / "x"), "trip", "idx", start_s=2.0)
    assert none.count() == 0


def test_report_tables_by_hand(spark):
    schema = "trip string, scenario string, config string, n long, drift_pct_median double, drift_pct_mean double, drift_pct_p90 double, pass_rate_10pct double, err_end_m_median double, frame_latency_ms_mean double"
    s = spark.createDataFrame([("S1", "x", "b", 3, 1.25, 2.0, 3.0, 0.667, 4.04, 0.126), ("S1", "x", "a", 0, None, None, None, None, None, None), ("S1", "x", None, 1, None, 1.0, 1.0, 1.0, 1.0, None), ("S2", "y", "a", 2, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0)], schema)
    got = tables.markdown_tables(s, {"b": "**All**"}, {"x": "Long"})
    lines = [r.line for r in got.where("trip = 'S1'").orderBy("position").collect()]
    assert lines[0] == "**S1 – Long**" and lines[2] == "|---|" + "---:|" * 7 and lines[1].count("|") == 9
    assert lines[3:] == ["| – | 1 | – % | 1.0 % | 1.0 % | 100% | 1.0 m | – |", "| a | 0 | – | – | – | – | – | – |", "| **All** | 3 | 1.3 % | 2.0 % | 3.0 % | 67% | 4.0 m | 0.13 |"]
    assert [r.line for r in got.where("trip = 'S2' and position in (0, 3)").orderBy("position").collect()] == ["**S2 – y**", "| a | 2 | 1.0 % | 1.0 % | 1.0 % | 0% | 1.0 m | 1.00 |"]
    assert tables.markdown_tables(s.drop("frame_latency_ms_mean")).where("line like '%| – |'").count() == 4


def test_two_pieces_of_one_road_count_together(spark):
    """Pieces that meet at a node are one hypothesis; a parallel road 8 m off, or one at right angles, is another."""
    rows = [(1, 1, 0.0, 0.0, 0.0, 0.0), (1, 2, 1.0, 0.0, 0.1, 0.0), (1, 3, 0.0, 8.0, 0.0, 0.0), (1, 4, 0.0, 0.5, 1.57, 0.0)]
    df = spark.createDataFrame(rows, "p long, seg long, foot_e double, foot_n double, road_psi double, score double")
    got = roads.posterior(df, "p", "seg").where("is_best").collect()
    assert [(r.seg, round(r.posterior, 9), round(r.confidence, 9)) for r in got] == [(1, 0.25, 0.5)]
