"""Chains of rows in which each names the next, followed by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import drop_table, shared_table


def reached(edges: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """``key, node`` of all nodes on the chains that begin at ``starts(key, node)``, over ``edges(key, node, next)``.

    A node has one edge at most, and ``next`` is greater than ``node``; a chain ends before a node without an edge. Each
    round joins pointers of a length with themselves, so a chain of n nodes takes log2(n) rounds; then the nodes that
    are marked double from the longest pointers to the shortest. All joins are by key and node, so that one key's chain
    spreads over all tasks. Null keys or nodes are on no chain.
    """
    spark = edges.sparkSession
    nodes = edges.select(key, F.col("node"), F.col("next")).where(F.col(key).isNotNull() & F.col("node").isNotNull() & (F.col("next") > F.col("node")))
    pointers = [shared_table(spark, nodes, "pointers")]
    # only pointers that lead to a node with an edge of its own go on
    to = lambda d: d.select(key, F.col("node").alias("next"), F.col("next").alias("after"))
    while True:
        last = pointers[-1]
        longer = shared_table(spark, last.join(to(last), [key, "next"]).select(key, "node", F.col("after").alias("next")), "pointers")
        if longer.isEmpty():
            drop_table(longer)
            break
        pointers.append(longer)
    own = pointers[0].select(key, "node")
    marked = shared_table(spark, starts.select(key, "node").distinct().join(own, [key, "node"], "left_semi"), "marked")
    for table in reversed(pointers):
        found = table.join(marked, [key, "node"], "left_semi").select(key, F.col("next").alias("node")).join(own, [key, "node"], "left_semi")
        before, marked = marked, shared_table(spark, marked.unionByName(found).distinct(), "marked")
        drop_table(before)
    for table in pointers:
        drop_table(table)
    return marked
