"""Connected components of an edge table as alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``edges(a, b)``: the least id that it is linked with over any links.

    Nodes only ever send and receive their neighbourhood's least id, which Spark sums up before the shuffle, so one
    node with very many links is no burden for a task.
    """
    now = C.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        # large star: each node links its greater neighbours to the least of its neighbourhood
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node links itself and its lesser neighbours to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        after = C.materialize(small.where("u <> v").distinct(), "edges")
        C.release(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots).groupBy("id").agg(F.min("component").alias("component"))
    out._driftline_path = now._driftline_path  # lets the caller release what is read
    return out
