"""Tables in parts: what is replaced, what stays, and what a killed or repeated run leaves."""

import random

import pytest

from driftline.sources import versions

SCHEMA = "trip string, chunk long, value double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upserts_against_a_dictionary(spark, tmp_path):
    """Random upserts with repeated keys and nulls; every version stays what it was."""
    rng, path, held, seen = random.Random(5), str(tmp_path / "t"), {}, {}
    for _ in range(4):
        new = {(rng.choice(["a", "b", None]), rng.randrange(12)): rng.choice([None, rng.random()]) for _ in range(9)}
        held |= new
        data = [(*k, v) for k, v in new.items()]
        version = versions.upsert(spark.createDataFrame(data + data[:3], SCHEMA), path, ["trip", "chunk"], buckets=7)
        seen[version] = sorted(((*k, v) for k, v in held.items()), key=str)
        assert rows(versions.read(spark, path)) == seen[version]
    assert [rows(versions.read(spark, path, v)) for v in versions.versions(spark, path)] == list(seen.values())


def test_only_touched_buckets_are_written_and_a_repeated_run_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", k, float(k)) for k in range(200)], SCHEMA)
    assert versions.upsert(first, path, ["trip", "chunk"], buckets=16) == 1
    before = versions.manifest(spark, path)["parts"]
    one = spark.createDataFrame([("a", 3, -1.0)], SCHEMA)
    assert versions.upsert(one, path, ["trip", "chunk"]) == 2 and versions.upsert(one, path, ["trip", "chunk"]) == 2
    after = versions.manifest(spark, path)["parts"]
    assert sum(before[p] != after[p] for p in before) == 1 and len(after) == len(before)
    assert versions.read(spark, path).where("value = -1").count() == 1 and versions.read(spark, path).count() == 200
    assert versions.upsert(one.limit(0), path, ["trip", "chunk"]) == 2


def test_parts_by_value(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert versions.replace_parts(make(("train", 1, 1.0), ("train", 2, 2.0), ("a/b=c d", 1, 3.0), (None, 1, 4.0)), path, "trip") == 1
    assert versions.replace_parts(make(("train", 9, 9.0)), path, "trip") == 2
    assert rows(versions.read(spark, path)) == sorted([("train", 9, 9.0), ("a/b=c d", 1, 3.0), (None, 1, 4.0)], key=str)
    with pytest.raises(ValueError):
        versions.upsert(make(("train", 9, 9.0)), path, ["trip"])
    with pytest.raises(ValueError):
        versions.replace_parts(make(("train", 9, 9.0)).drop("value"), path, "trip")


def test_a_killed_run_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(KeyError):
        versions.read(spark, path)
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], SCHEMA)
    versions.replace_parts(old, path, "trip")
    new = spark.createDataFrame([("a", 1, 5.0)], SCHEMA)

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            versions.replace_parts(new, path, "trip")
    assert rows(versions.read(spark, path)) == rows(old)
    assert versions.clean(spark, path) == 1 and rows(versions.read(spark, path)) == rows(old)
    assert versions.replace_parts(new, path, "trip") == 2 and rows(versions.read(spark, path)) == [("a", 1, 5.0), ("b", 1, 2.0)]
    assert versions.clean(spark, path, keep=1) == 1 and versions.versions(spark, path) == [2]
    assert rows(versions.read(spark, path)) == [("a", 1, 5.0), ("b", 1, 2.0)]


def test_of_two_runs_one_publishes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1, 1.0)], SCHEMA)
    versions.replace_parts(df, path, "trip")
    with pytest.raises(versions.Conflict):
        versions._publish(spark, path, 1, {})
    assert rows(versions.read(spark, path)) == [("a", 1, 1.0)]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.upsert(spark.createDataFrame([], SCHEMA), path, ["trip"]) == 1
    assert versions.read(spark, path).count() == 0 and versions.read(spark, path).columns == ["trip", "chunk", "value"]
