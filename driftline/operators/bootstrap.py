"""Cluster bootstrap of a median and a share for groups of any size.

Clusters are dealt into buckets by a hash. How many of a replicate's draws fall into a bucket is found by halving: of
the draws of a node of a binary tree over the buckets a binomial number goes to its left half, down to the bucket, whose
draws then pick among its clusters. That is one multinomial draw over all clusters of a group, yet each bucket finds its
own share without the others, from a generator keyed by seed, group and node. No row is made for a replicate and a draw.

Medians of all replicates lie close to each other. A first pass counts the drawn weight in few ranges of values; only
values in the ranges that hold some replicate's median, some multiples of the root of the group's size, meet their
weights one by one in the second pass. A range that still holds too many values is cut up by another pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import drop_table, shared_table
from .keyed import ship_package

BUCKET = 2048
#: Ranges of values in a pass, replicates that are handled together, values that meet their weights one by one.
RANGES, CHUNK, MOST_VALUES = 32, 250, 200_000
#: Replicates whose weights of all values in reach meet in one task; a part of ``CHUNK``.
PART = 25


class RandomDraws:
    """Draws from Philox generators, each keyed by the seed and the place where it is used."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def _generator(self, *place) -> np.random.Generator:
        key = hashlib.blake2b(repr((self.seed, *place)).encode(), digest_size=16).digest()
        return np.random.Generator(np.random.Philox(key=int.from_bytes(key, "little")))

    def left(self, group: str, level: int, node: int, replicates: np.ndarray, draws: np.ndarray, n_left: int, n: int) -> np.ndarray:
        """How many of each replicate's ``draws`` in a node of ``n`` clusters go to its left half of ``n_left``."""
        return self._generator(group, level, node, int(replicates[0])).binomial(draws, n_left / n)

    def picks(self, group: str, bucket: int, replicate: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """The cluster, from 0 to below ``n``, that each draw of a bucket picks."""
        return self._generator(group, "bucket", bucket, int(replicate[0]) if len(replicate) else 0).integers(0, n, len(slot))


def _counts(draws, row: dict, replicates: np.ndarray) -> np.ndarray:
    """How often each replicate has each cluster of a bucket: a row for each replicate."""
    m = np.full(len(replicates), row["n_clusters"], dtype=np.int64)
    for step in row["path"] or ():
        to_left = draws.left(row["g"], step["level"], step["node"], replicates, m, step["n_left"], step["n"])
        m = to_left if step["is_left"] else m - to_left
    n, ends = len(row["clusters"]), np.cumsum(m)
    at = np.repeat(np.arange(len(replicates)), m)
    picked = draws.picks(row["g"], row["bucket"], replicates[at], np.arange(ends[-1]) - np.repeat(ends - m, m), n)
    return np.bincount(at * n + picked, minlength=len(replicates) * n).reshape(len(replicates), n).astype(float)


def _observations(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Values of a bucket and the place of each one's cluster in it."""
    held = [c["v"] for c in row["clusters"]]
    return np.concatenate(held), np.repeat(np.arange(len(held)), [len(v) for v in held])


def _buckets(clusters: DataFrame, spread: Callable[[Column], Column], size: int) -> DataFrame:
    """``g, n_clusters, bucket, clusters, path`` from ``g, cluster, v``; a bucket has about ``size`` clusters at most."""
    sizes = clusters.groupBy("g").agg(F.count("*").alias("n_clusters"))
    levels = F.greatest(F.ceil(F.log2(F.col("n_clusters") / size)), F.lit(0)).cast("int")
    dealt = clusters.join(sizes.withColumn("levels", levels), "g")
    dealt = dealt.withColumn("bucket", F.pmod(spread(F.col("cluster")), F.expr("shiftleft(1L, levels)")))
    held = dealt.groupBy("g", "n_clusters", "levels", "bucket").agg(F.sort_array(F.collect_list(F.struct("cluster", "v"))).alias("clusters"))
    held = shared_table(clusters.sparkSession, held.select("*", F.size("clusters").cast("long").alias("n")), "bootstrap-buckets")
    # the nodes above each bucket, of which a level has half as many as the one below
    up = held.where("levels > 0").select("g", "bucket", "n", F.explode(F.expr("sequence(1, levels)")).alias("level"))
    up = up.select("g", "bucket", "n", "level", F.expr("shiftright(bucket, level)").alias("node"), F.expr("shiftright(bucket, level - 1) % 2 = 0").alias("is_left"))
    nodes = up.groupBy("g", "level", "node").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("is_left"), F.col("n"))), F.lit(0)).alias("n_left"))
    step = F.struct((-F.col("level")).alias("minus"), "level", "node", "n_left", nodes["n"].alias("n"), "is_left")
    paths = up.drop("n").join(nodes, ["g", "level", "node"]).groupBy("g", "bucket").agg(F.sort_array(F.collect_list(step)).alias("path"))
    out = shared_table(clusters.sparkSession, held.join(paths, ["g", "bucket"], "left").select("g", "n_clusters", "bucket", "clusters", "path"), "bootstrap-paths")
    drop_table(held)
    return out


def _dealt(buckets: DataFrame) -> DataFrame:
    """Buckets on as many tasks as a shuffle has: they are small in bytes, by which Spark would merge them, but not in work."""
    return buckets.repartition(int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("g", "bucket"))


def _histograms(buckets: DataFrame, splits: DataFrame, draws, replicates: int, limit: float) -> DataFrame:
    """``g, replicate, bin, w``: weight in each range, and as the last bin that of values below ``limit``.

    Range ``b`` has the values above split ``b - 1`` and up to split ``b``.
    """
    schema = "g string, replicate long, bin int, w long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (g, first), h in held.items():
                at, bins = np.nonzero(h)
                columns = [pa.array([g] * len(at), pa.string()), pa.array(first + at), pa.array(bins.astype(np.int32)), pa.array(h[at, bins].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["g", "replicate", "bin", "w"])
            held.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                values, owner = _observations(row)
                member = np.zeros((len(row["clusters"]), len(row["splits"]) + 2))
                np.add.at(member, (owner, np.searchsorted(row["splits"], values, "left")), 1)
                np.add.at(member, (owner[values < limit], member.shape[1] - 1), 1)
                for first in range(0, replicates, CHUNK):
                    h = _counts(draws, row, np.arange(first, min(first + CHUNK, replicates))) @ member
                    held[row["g"], first] = held[row["g"], first] + h if (row["g"], first) in held else h
                if len(held) > 64:
                    yield from told()
        yield from told()

    met = _dealt(buckets).join(F.broadcast(splits), "g").select("g", "n_clusters", "bucket", "clusters", "path", "splits")
    return met.mapInArrow(run, schema).groupBy("g", "replicate", "bin").agg(F.sum("w").alias("w"))


def _in_reach(hist: DataFrame) -> DataFrame:
    """``g, replicate, total, passes, at, low, high``: each replicate's weight, the place of its median and the ranges around it."""
    own = Window.partitionBy("g", "replicate")
    last = F.col("bin") == F.col("top") + 1
    rows = hist.withColumn("total", F.sum(F.when(~last, F.col("w"))).over(own)).withColumn("passes", F.coalesce(F.sum(F.when(last, F.col("w"))).over(own), F.lit(0))).where(~last)
    upto = F.sum("w").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).withColumn("at", (F.col("total") - 1) * 0.5)
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("bin")))
    return rows.groupBy("g", "replicate", "total", "passes", "at").agg(first(F.floor("at")).alias("low"), first(F.ceil("at")).alias("high"))


def replicates_of(observations: DataFrame, limit: float, replicates: int = 2000, draws=None, spread: Callable[[Column], Column] = F.xxhash64, bucket: int = BUCKET, most: int = MOST_VALUES) -> DataFrame:
    """``g, replicate, median, share`` of each bootstrap replicate of ``g, cluster, value``; ``share`` is that below ``limit``.

    A replicate draws as many clusters of a group as it has, with replacement, and takes all values of each. The result
    does not depend on how rows are partitioned. Null values do not count, nor do clusters without others.
    """
    spark = observations.sparkSession
    ship_package(spark)
    draws = draws or RandomDraws()
    seen = observations.where(F.col("value").isNotNull()).select("g", "cluster", F.col("value").cast("double").alias("value"))
    clusters = shared_table(spark, seen.groupBy("g", "cluster").agg(F.sort_array(F.collect_list("value")).alias("v")), "bootstrap-clusters")
    buckets = _buckets(clusters, spread, bucket)
    values = clusters.select("g", F.explode("v").alias("value"))
    low, high, before = None, None, None
    while True:
        # splits need not be exact quantiles, only the same for all; the ends of the last reach are kept among them
        inside = values if low is None else values.join(F.broadcast(low), "g").where((F.col("value") > F.col("from")) & (F.col("value") <= F.col("to")))
        ends = [] if low is None else [F.first("from"), F.first("to")]
        marks = F.percentile_approx("value", [(k + 1) / RANGES for k in range(RANGES - 1)], 2000)
        splits = inside.groupBy("g").agg(marks.alias("marks"), *[e.alias(f"end{k}") for k, e in enumerate(ends)])
        # one row of some ranges for each group
        splits = shared_table(spark, splits.select("g", F.array_sort(F.array_distinct(F.concat("marks", F.array(*[f"end{k}" for k in range(len(ends))]).cast("array<double>")))).alias("splits")), "bootstrap-splits")
        hist = shared_table(spark, _histograms(buckets, splits, draws, replicates, limit).join(F.broadcast(splits.select("g", F.size("splits").alias("top"))), "g"), "bootstrap-ranges")
        reach = shared_table(spark, _in_reach(hist), "bootstrap-reach")
        of_group = reach.groupBy("g").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        # without an end below or above, all values count on that side
        bounds = of_group.join(splits, "g").select(
            "g", F.coalesce(F.when(F.col("low") > 0, F.get("splits", F.col("low") - 1)), F.lit(float("-inf"))).alias("from"),
            F.coalesce(F.get("splits", F.col("high")), F.lit(float("inf"))).alias("to"), "low",
        )
        bounds = shared_table(spark, bounds, "bootstrap-bounds")
        within = values.join(F.broadcast(bounds), "g").where((F.col("value") > F.col("from")) & (F.col("value") <= F.col("to")))
        held = within.groupBy("g").agg(F.countDistinct("value").alias("n")).agg(F.max("n")).first()[0] or 0
        drop_table(splits)
        if low is not None:
            drop_table(low)
        if held <= most or before is not None and held > before / 2:
            break
        low, before = bounds, held
        drop_table(hist)
        drop_table(reach)
    below = hist.join(F.broadcast(bounds.select("g", F.col("low").alias("least"))), "g").where("bin < least AND bin <= top").groupBy("g", "replicate").agg(F.sum("w").alias("below"))
    chunk = (F.floor(F.col("replicate") / PART) * PART).alias("chunk")
    told = reach.join(below, ["g", "replicate"], "left").select("g", "replicate", chunk, "total", "passes", "at", F.coalesce("below", F.lit(0)).alias("below"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                values, owner = _observations(row)
                use = (values > row["from"]) & (values <= row["to"])
                if not use.any():
                    continue
                kinds, at = np.unique(values[use], return_inverse=True)
                member = np.zeros((len(row["clusters"]), len(kinds)))  # floating point, which BLAS multiplies; counts are exact in it
                np.add.at(member, (owner[use], at), 1)
                for first in range(0, replicates, CHUNK):
                    w = (_counts(draws, row, np.arange(first, min(first + CHUNK, replicates))) @ member).astype("<i4").T
                    for k in range(0, w.shape[1], PART):
                        part = np.ascontiguousarray(w[:, k : k + PART])
                        ends = np.arange(len(kinds) + 1, dtype=np.int32) * (4 * part.shape[1])
                        weights = pa.Array.from_buffers(pa.binary(), len(kinds), [None, pa.py_buffer(ends), pa.py_buffer(part)])
                        columns = [pa.array([row["g"]] * len(kinds), pa.string()), pa.array(np.full(len(kinds), first + k)), pa.array(kinds), weights]
                        yield pa.RecordBatch.from_arrays(columns, ["g", "chunk", "value", "weights"])

    near = _dealt(buckets).join(F.broadcast(bounds), "g").select("g", "n_clusters", "bucket", "clusters", "path", "from", "to").mapInArrow(weigh, "g string, chunk long, value double, weights binary")

    def medians(of: pa.Table, near: pa.Table) -> pa.Table:
        v, held = near["value"].to_numpy(), near["weights"].combine_chunks()
        ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(v) + 1]
        w = np.frombuffer(held.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<i4").reshape(len(v), -1)
        order = np.argsort(v, kind="stable")
        v, w = v[order], w[order]
        # a value that many buckets have counts once
        new = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        v, w = v[new], np.add.reduceat(w, new, axis=0, dtype=np.int64)
        replicate, chunk, total, passes, place, below = (of[c].to_numpy() for c in ("replicate", "chunk", "total", "passes", "at", "below"))
        upto = below[None, :] + np.cumsum(w[:, replicate - chunk], axis=0)
        found = [v[np.argmax(upto > rank[None, :], axis=0)] for rank in (np.floor(place), np.ceil(place))]
        return pa.table({"g": of["g"], "replicate": of["replicate"], "median": found[0] + (found[1] - found[0]) * (place - np.floor(place)), "share": passes / total})

    # a group has a chunk of replicates and the values in reach
    out = told.groupBy("g", "chunk").cogroup(near.groupBy("g", "chunk")).applyInArrow(medians, "g string, replicate long, median double, share double")
    out = shared_table(spark, out, "bootstrap-replicates")
    for t in (clusters, buckets, hist, reach, bounds):
        drop_table(t)
    return out
