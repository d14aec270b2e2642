"""Findings of round 3: what grows with the tables stays off the driver, is made once, and needs no more memory."""

from driftline.llm import _common as C
from driftline.llm import ctw
from driftline.operators import bootstrap
from driftline.plans import catalogue


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_of_new_keys_are_not_sent_to_the_driver(spark):
    """Spark takes few keys for few rows, but each has a row for every bit and depth."""
    grams = spark.createDataFrame([(0x6161 + k, 1) for k in range(50)], "key long, n long")
    tree = ctw.context_tree(grams, 1)
    new = ctw.new_logs(C.materialize(spark.createDataFrame([(0x6261 + k,) for k in range(9)], "key long"), "new"), tree)
    assert new.count() == 9
    # the join of steps with nodes of the tree
    assert "SortMergeJoin [d#" in _plan(new)


def test_metadata_is_made_without_the_fixes(spark, sf_dir):
    """the record of a trip needs no fix of its frames; with their joins it scanned nine tables."""
    assert _plan(catalogue.q55_trip_record(spark, sf_dir)).count("FileScan") == 4


def test_buckets_are_dealt_to_all_tasks(spark):
    """few bytes, but thousands of replicates each; Spark would merge them to one task."""
    buckets = spark.createDataFrame([("g", 1, 0, [(1, [1.0])], None)], "g string, n_clusters long, bucket long, clusters array<struct<cluster:long,v:array<double>>>, path array<struct<level:int>>")
    splits = spark.createDataFrame([("g", [0.5])], "g string, splits array<double>")
    assert "REPARTITION_BY_NUM" in _plan(bootstrap._histograms(buckets, splits, catalogue.RuleDraws(), 10, 1.0))


def test_a_replicate_meets_few_weights_at_once(spark, monkeypatch):
    """F16: the weights of a value are for few replicates, and those of equal values in many buckets are added up."""
    seen = spark.range(600).selectExpr("'g' AS g", "id AS cluster", "CAST(id % 3 AS DOUBLE) AS value")
    monkeypatch.setattr(bootstrap, "PART", 7)
    parts = bootstrap.replicates_of(seen, 1.0, 60, catalogue.RuleDraws(), spread=lambda c: c, bucket=16).orderBy("replicate").collect()
    monkeypatch.setattr(bootstrap, "PART", 250)
    whole = bootstrap.replicates_of(seen, 1.0, 60, catalogue.RuleDraws(), spread=lambda c: c, bucket=16).orderBy("replicate").collect()
    assert parts == whole and len(parts) == 60 and {x.median for x in parts} <= {0.0, 0.5, 1.0, 1.5, 2.0}
