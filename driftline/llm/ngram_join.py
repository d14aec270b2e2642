"""N-gram Jaccard join (operator 5) by prefix filters under several global orders.

A document's set holds its distinct shingles; two documents link when 100 * |intersection| >= ``percent`` * |union|.
Equal sets are one class from the start. Two sets of a link share a shingle among the first
``n - ceil(percent * n / 100) + 1`` of each under every order of all shingles, and with prefixes made longer by a tenth
of ``n`` they share that many more. Only sets that share as much under the first order *and* under the second are
candidates. Both orders put frequent shingles last, so that a passage that many documents share leads to no candidates.

The shingles that two prefixes share also bound the intersection from above: beyond the prefix that ends first, at
most the rest of that set can be common. Pairs of sets that share shingles in at most ``LISTED`` sets are counted
and must pass this bound under both orders. Sets with enough more frequent shingles to link by these alone are
candidates too, but their pairs are never listed: they are filtered as pairs of blocks, under both orders. All
candidates are gathered in clusters, and large clusters in blocks of ``BLOCK_SETS`` sets. Clusters and pairs of blocks
are verified by counting common shingles as products of incidence matrices, which needs no row for a pair. Only a
spanning forest of the links leaves a task, with each set's number of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C
from ._components import connected_components
from ._words import mix, shingle_sets

WORDS = 5
PERCENT = 80
BLOCK_SETS = 64
#: Shingles of a block, so that few sets of very long texts do not meet in one task.
BLOCK_SHINGLES = 1 << 20
#: Sets of a very large cluster that are put in order together.
ORDERED_SETS = 1 << 18
#: Shingles that a task verifies at once, about.
PACK_SHINGLES = 1 << 18
#: Shingles of up to so many sets are listed: pairs of their sets are counted one by one.
LISTED = 96
#: A shingle is frequent if it is in this share of the documents (at least in ``LEAST_FREQUENT``).
#: At most (shingles a document) / share of them exist, so the table of them has a bound that the corpus cannot raise.
#: It only sets the order of shingles: another table gives the same links.
FREQUENT_SHARE = 1 / 1000
LEAST_FREQUENT = 64
MOST_FREQUENT = 1 << 19
#: Ids up to which a side may be broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000
#: What a shingle's hash is combined with before it is scrambled, for each order.
ORDER_KEYS = (0, 0xA0761D6478BD642F)
_COLUMNS = 1 << 14
#: Shingles that a task counts at once.
_HELD = 3_000_000


def extension(n: int) -> int:
    """By how many shingles a prefix is longer than it must be."""
    return n // 10


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """Shingles of a prefix: two linked sets share ``extension(n) + 1`` of them, n being the smaller set's size.

    A set of a link has at most ``n - ceil(percent * n / 100)`` shingles that the other lacks, so the shared ones that
    come first in the order, as many as the extension and one more, are in both prefixes.
    """
    return n - (percent * n + 99) // 100 + 1 + extension(n)


class Orders:
    """Prefixes of a set under the global orders: rarer classes first, then by a scrambled hash."""

    def __init__(self, hashes: np.ndarray, classes: np.ndarray, percent: int):
        at = np.argsort(hashes)
        self.hashes, self.classes, self.percent = hashes[at], classes[at], percent

    def prefix(self, shingles: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The prefix of a set, which of it is frequent, and the rank of its last; ranks of a few may be equal."""
        n = prefix_size(len(shingles), self.percent)
        key = ORDER_KEYS[order]
        rank = (shingles if key == 0 else mix(shingles ^ np.uint64(key))) >> np.uint64(7)
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
            rank = rank | (np.where(self.hashes[place] == shingles, self.classes[place], 0).astype(np.uint64) << np.uint64(57))
        at = np.argsort(rank, kind="stable")[:n]
        return shingles[at], rank[at] >= np.uint64(1 << 57), int(rank[at[-1]])


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit identity of a set."""
    total = mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def _texts(part: pa.RecordBatch, column: int = 1) -> list[bytes]:
    return [v.as_py() or b"" for v in part.column(column)]


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """Rows ``doc_id, key, n`` of documents, and rows ``h, n`` of shingles found often in a part of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(docs_, keys, hs, ns):
            return pa.RecordBatch.from_arrays(
                [pa.array(docs_, pa.int64()), pa.array(keys, pa.int64()), pa.array(hs, pa.int64()), pa.array(ns, pa.int64())], ["doc_id", "key", "h", "n"]
            )

        def often() -> pa.RecordBatch | None:
            own = held[:size]
            own.sort()
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            counts = np.diff(np.append(starts, size))
            found = counts >= 4
            m = int(found.sum())
            return emit([None] * m, [None] * m, own[starts[found]].view(np.int64), counts[found]) if m else None

        held, size = np.empty(_HELD, dtype=np.uint64), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                keys, ns = [], []
                for s in shingle_sets(_texts(part), k):
                    keys.append(set_key(s) if len(s) else None)
                    ns.append(len(s))
                    for low in range(0, len(s), _HELD):
                        some = s[low : low + _HELD]
                        if size + len(some) > _HELD:
                            if (out := often()) is not None:
                                yield out
                            size = 0
                        held[size : size + len(some)] = some
                        size += len(some)
                yield emit(part.column(0).to_pylist(), keys, [None] * len(ns), ns)
        if size and (out := often()) is not None:
            yield out
        del held
        C.trim()

    return docs.mapInArrow(run, "doc_id long, key long, h long, n long")


def _orders(profile: DataFrame, n_docs: int, percent: int):
    least = max(LEAST_FREQUENT, int(n_docs * FREQUENT_SHARE))
    often = profile.where("h is not null").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = often.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toPandas()
    classes = np.array([int(math.log2(n)) for n in found["n"]], dtype=np.int64)
    return profile.sparkSession.sparkContext.broadcast((found["h"].to_numpy(dtype=np.int64).view(np.uint64), classes, percent))


#: ``g`` is what a row meets its like by: the shingle, or for a frequent one a key of the row itself, and then ``h`` is
#: the shingle. ``x`` packs the set's size, the last rank of its prefix and the mark of a frequent shingle.
_ROWS = "g long, h long, s long, x long"
_LAST_BITS = 20


def _prefix_rows(by: Orders, order: int, sets: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
    found = [by.prefix(x, order) for x in sets]
    sizes = [len(h) for h, _, _ in found]
    h = np.concatenate([h for h, _, _ in found])
    often = np.concatenate([f for _, f, _ in found])
    s = np.repeat(np.array(keys, dtype=np.int64), sizes)
    # a coarser rank never puts two ranks in the wrong order; where it makes them equal the bound is the looser one
    tail = [(len(x) << (_LAST_BITS + 1)) | ((last >> (64 - _LAST_BITS)) << 1) for x, (_, _, last) in zip(sets, found, strict=True)]
    g = np.where(often, mix(h ^ mix(s.view(np.uint64))), h)
    cols = [pa.array(g.view(np.int64)), pa.array(h.view(np.int64), mask=~often), pa.array(s), pa.array(np.repeat(np.array(tail, dtype=np.int64), sizes) | often)]
    return pa.RecordBatch.from_arrays(cols, ["g", "h", "s", "x"])


def _size(x: Column) -> Column:
    return F.shiftright(x, _LAST_BITS + 1)


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """``h, sets, listed``: of shingles that several sets have in their prefixes the sets ``(s, x)``.

    A listed shingle, one in at most ``LISTED`` sets, is one row with all of its sets. Others have a row for each set.
    All of it is one shuffle by shingle. Frequent shingles are known before, are never listed and are dealt out by
    shingle and set, so that a shingle of very many sets does not meet in one task.
    """
    of = Window.partitionBy("g")
    often = F.col("x").bitwiseAND(1) == 1
    rows = rows.withColumns({"least": F.min("s").over(of), "most": F.max("s").over(of)}).where(often | (F.col("least") != F.col("most")))
    # a class of copies in several tasks comes from each of them
    rows = rows.groupBy("g", "s").agg(F.first("x").alias("x"), F.first("h").alias("h"))
    rows = rows.withColumn("listed", ~often & (F.count("*").over(of) <= LISTED))
    rows = rows.groupBy("g", "listed", F.when(~F.col("listed"), F.col("s")).alias("own")).agg(F.collect_list(F.struct("s", "x")).alias("sets"), F.first("h").alias("h"))
    return C.materialize(rows.select(F.coalesce("h", "g").alias("h"), "sets", "listed"), name)


def _first_prefixes(docs: DataFrame, orders, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, done = Orders(*orders.value), set()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                sets, keys = [], []
                for s in shingle_sets(_texts(batch.slice(a, 256)), k):
                    key = set_key(s) if len(s) else None
                    if key is not None and key not in done:
                        done.add(key)
                        sets.append(s)
                        keys.append(key)
                if sets:
                    yield _prefix_rows(by, 0, sets, keys)
        C.trim()

    return docs.mapInArrow(run, _ROWS)


def _prefix_column(n: Column, percent: int) -> Column:
    return n - F.floor((percent * n + 99) / 100) + 1 + F.floor(n / 10)


def _needed(n: Column, percent: int) -> Column:
    """Shingles that the prefix of a set of ``n`` shares with that of any set it links with."""
    return F.floor(F.floor((percent * n + 99) / 100) / 10) + 1


def _unlisted(shared: DataFrame) -> DataFrame:
    """``h, s, x`` of the shingles that are not listed."""
    return shared.where("not listed").select("h", F.col("sets")[0]["s"].alias("s"), F.col("sets")[0]["x"].alias("x"))


def _counts(unlisted: DataFrame, name: str) -> DataFrame:
    """``s, u, n``: how many unlisted shingles are in a set's prefix, and its size."""
    return C.bounded(unlisted.groupBy("s").agg(F.count("*").cast("int").alias("u"), _size(F.first("x")).cast("int").alias("n")), name, BROADCAST_ROWS)


def _candidates(shared: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of sets that share listed shingles and by these, their unlisted ones and their sizes can link.

    The shingles that two prefixes share are at least a tenth of the smaller set and one more. Beyond the prefix that
    ends first, at most the rest of that set can be common.
    """

    def pair(a: Column, b: Column) -> Column:
        n_a, n_b = _size(a["x"]), _size(b["x"])
        end_a, end_b = a["x"].bitwiseAND((1 << (_LAST_BITS + 1)) - 2), b["x"].bitwiseAND((1 << (_LAST_BITS + 1)) - 2)
        rest_a, rest_b = n_a - _prefix_column(n_a, percent), n_b - _prefix_column(n_b, percent)
        rest = F.when(end_a < end_b, rest_a).when(end_a > end_b, rest_b).otherwise(F.greatest(rest_a, rest_b))
        least = F.greatest(F.ceil(percent * (n_a + n_b) / (100 + percent)) - rest, F.floor(F.least(n_a, n_b) / 10) + 1)
        return F.struct(a["s"].alias("a"), b["s"].alias("b"), least.cast("int").alias("least"))

    def fits(a: Column, b: Column) -> Column:
        n_a, n_b = _size(a["x"]), _size(b["x"])
        return (a["s"] < b["s"]) & (percent * F.greatest(n_a, n_b) <= 100 * F.least(n_a, n_b))

    # at most LISTED sets are in a row, so the pairs of a row are bounded
    met = F.flatten(F.transform("sets", lambda a: F.transform(F.filter("sets", lambda b: fits(a, b)), lambda b: pair(a, b))))
    met = shared.where("listed").select(F.explode(met).alias("m")).select("m.*")
    met = met.groupBy("a", "b").agg(F.count("*").cast("int").alias("c"), F.max("least").alias("least"))
    met = met.join(counts.select(F.col("s").alias("a"), F.col("u").alias("u_a")), "a", "left").join(counts.select(F.col("s").alias("b"), F.col("u").alias("u_b")), "b", "left")
    return met.where(F.col("c") + F.least(F.coalesce("u_a", F.lit(0)), F.coalesce("u_b", F.lit(0))) >= F.col("least")).select("a", "b", "c")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``s, n_docs, n, near, shingles`` (packed) of the wanted classes, made from the text of one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                keep, packed, sizes, near = [], [], [], []
                keys = part.column(1).to_pylist()
                for i, s in enumerate(shingle_sets(_texts(part, 0), k)):
                    if len(s) and set_key(s) == keys[i]:
                        keep.append(i)
                        packed.append(s.tobytes())
                        sizes.append(len(s))
                        near.append(int(s[:1].view(np.int64)[0]))
                if keep:
                    at = pa.array(keep)
                    cols = [part.column(1).take(at), part.column(2).take(at), pa.array(sizes, pa.int64()), pa.array(near, pa.int64()), pa.array(packed, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["s", "n_docs", "n", "near", "shingles"])
        C.trim()

    found = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["rep"])).select("text", "s", "n_docs")
    # a repeated document id may bring a class twice; both rows are equal
    return found.mapInArrow(run, "s long, n_docs long, n long, near long, shingles binary")


def _second_prefixes(sets: DataFrame, orders) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Orders(*orders.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield _prefix_rows(by, 1, [np.frombuffer(v.as_py(), np.uint64) for v in part.column(1)], part.column(0).to_pylist())
        C.trim()

    return sets.select("s", "shingles").mapInArrow(run, _ROWS)


def _surviving(first: DataFrame, second: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``first`` that also pass the bound of the second order."""
    out = first.select("a", "b").join(_candidates(second, counts, percent).select("a", "b", F.lit(True).alias("passes")), ["a", "b"], "left")
    # pairs that pass by no listed shingle of the second order can only do so by unlisted ones
    enough = counts.where(F.col("u") >= _needed(F.col("n"), percent)).select("s")
    out = out.join(enough.select(F.col("s").alias("a"), F.lit(True).alias("u_a")), "a", "left").join(enough.select(F.col("s").alias("b"), F.lit(True).alias("u_b")), "b", "left")
    return out.where("passes or (u_a and u_b)").select("a", "b")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from incidence matrices of a bounded number of shingles at a time."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.argsort(flat, kind="stable")
    flat, owner = flat[at], owner[at]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1  # what one set alone has is in no intersection
    keep = often[column]
    column, owner = (np.cumsum(often) - 1)[column[keep]], owner[keep]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for low in range(0, int(often.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        m = np.zeros((len(sets), min(_COLUMNS, int(often.sum()) - low)), dtype=np.float32)
        m[owner[a:b], column[a:b] - low] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _verify(rows: DataFrame, percent: int) -> DataFrame:
    """Links among rows ``pack, pair, side, s, n_docs, shingles``: ``s, root, n_links`` of each set with a link."""

    def check(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        order = np.argsort(group["pair"].to_numpy(), kind="stable")
        pair, side = group["pair"].to_numpy()[order], group["side"].to_numpy()[order]
        s, n_docs = group["s"].to_numpy()[order], group["n_docs"].to_numpy()[order]
        packed = group["shingles"].take(pa.array(order))
        out: list[tuple[int, int, int]] = []
        cuts = np.flatnonzero(np.diff(pair)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(pair)], strict=True):
            _, first = np.unique(s[a:b], return_index=True)  # repeated ids may bring a class twice
            at = a + first
            if len(at) < 2:
                continue
            sets = [np.frombuffer(packed[int(i)].as_py(), np.uint64) for i in at]
            n = np.array([len(x) for x in sets])
            common = common_counts(sets)
            linked = (100 + percent) * common >= percent * (n[:, None] + n[None, :])
            np.fill_diagonal(linked, False)
            one, other = side[at] == 0, side[at] == 1
            if other.any():  # two blocks: pairs within one of them belong to that block alone
                linked &= (one[:, None] & other[None, :]) | (other[:, None] & one[None, :])
            links = linked @ n_docs[at]
            root = np.arange(len(at))
            while True:  # the least of the neighbours' roots, until nothing changes
                least = np.minimum(root, np.where(linked, root[None, :], len(at)).min(1))
                if (least == root).all():
                    break
                root = least
            out += [(int(s[at[i]]), int(s[at[root[i]]]), int(links[i])) for i in np.flatnonzero(links)]
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["s", "root", "n_links"])

    return rows.groupBy("pack").applyInArrow(check, "s long, root long, n_links long")


def _blocks(pairs: DataFrame, sets: DataFrame, frequent: DataFrame) -> DataFrame:
    """``s, n, block, whole`` of each set with a candidate; ``whole`` marks blocks that are a cluster of their own.

    A block has at most ``BLOCK_SETS`` sets, and at most ``BLOCK_SHINGLES`` shingles besides those of its last set.
    """
    # a shingle is a node of its own here, so that no task has to see all of its sets
    stars = frequent.select("s", F.xxhash64("h", F.lit("shingle")).alias("h"))
    clusters = connected_components(pairs.select("a", "b").unionAll(stars))
    sets = C.materialize(clusters.select(F.col("id").alias("s"), F.col("component").alias("cluster")).join(sets.select("s", "n", "near").distinct(), "s"), "clusters")
    large = sets.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).where((F.col("size") > BLOCK_SETS) | (F.col("weight") > BLOCK_SHINGLES))
    sets_ = sets.join(large, "cluster", "left")
    small = sets_.where(F.col("size").isNull()).select("s", "n", F.col("cluster").alias("block"), F.lit(True).alias("whole"))
    # sets whose least shingles are close go together; the salt splits the order of a very large cluster
    salt = F.pmod(F.xxhash64("near"), 1 + F.floor(F.col("size") / ORDERED_SETS))
    share = F.greatest(F.lit(1 / BLOCK_SETS), F.col("n") / BLOCK_SHINGLES)
    so_far = Window.partitionBy("cluster", "salt").orderBy("near", "s").rowsBetween(Window.unboundedPreceding, -1)
    nth = F.floor(F.coalesce(F.sum("share").over(so_far), F.lit(0.0)) + 1e-9)
    parts = sets_.where(F.col("size").isNotNull()).withColumn("salt", salt).withColumn("share", share).withColumn("nth", nth)
    out = C.materialize(small.unionByName(parts.select("s", "n", F.xxhash64("cluster", "salt", "nth").alias("block"), F.lit(False).alias("whole"))), "blocks")
    C.release(sets)
    return out


def _meetings(rows: DataFrame, large: DataFrame) -> DataFrame:
    """``a, b``: pairs of different blocks of which a set each has the same shingle."""
    met = C.materialize(rows.join(large, "s").select("h", "block").distinct(), "met")
    return met.withColumnRenamed("block", "a").join(met.withColumnRenamed("block", "b"), "h").where("a < b").select("a", "b").distinct()


def _block_pairs(pairs: DataFrame, frequent: DataFrame, second: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs of different blocks with a candidate pair: a listed one, or sets that share unlisted shingles.

    The latter must also share a shingle under the second order.
    """
    large = blocks.where("not whole").select("s", "block")
    listed = pairs.join(large.select(F.col("s").alias("a"), F.col("block").alias("x")), "a").join(large.select(F.col("s").alias("b"), F.col("block").alias("y")), "b").where("x <> y")
    listed = listed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    again = second.select("h", F.explode("sets").alias("x")).select("h", F.col("x.s").alias("s"))
    unlisted = _meetings(frequent.select("h", "s"), large).join(_meetings(again.join(frequent.select("s").distinct(), "s", "left_semi"), large), ["a", "b"], "left_semi")
    return listed.unionAll(unlisted).distinct()


def jaccard_join(docs: DataFrame, percent: int = PERCENT, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for each row of ``docs``.

    ``component_id`` is the least id reachable by links, the document itself included; ``n_links`` counts the rows
    that the document is linked with. A null, empty or blank text has no shingles and links with nothing, equal ones
    included; with fewer than ``k`` words the whole sequence is the one shingle. Repeated rows are documents of their
    own that link with each other. A null id never is a component's id unless all of its ids are null. Further columns
    are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    C.ship(spark)
    docs = C.id_and_bytes(docs, id_col, text_col)
    profile = C.materialize(_profile(docs, k), "shingle-profile")
    of_docs = profile.where("h is null").select("doc_id", "key", "n")
    orders = _orders(profile, of_docs.count(), percent)

    first = _shared(_first_prefixes(docs, orders, k), "prefixes-1")
    C.forget(spark)
    counts_1 = _counts(_unlisted(first), "unlisted-1")
    pairs = C.materialize(_candidates(first, counts_1, percent).select("a", "b"), "pairs-1")
    # rows of unlisted shingles of sets that have enough of them to link without a listed one
    frequent = C.materialize(_unlisted(first).join(counts_1.where(F.col("u") >= _needed(F.col("n"), percent)).select("s"), "s", "left_semi").select("h", "s"), "frequent")
    C.release(first, counts_1)
    used = pairs.select(F.explode(F.array("a", "b")).alias("s")).unionAll(frequent.select("s")).distinct()
    classes = of_docs.where("key is not null").groupBy(F.col("key").alias("s")).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_docs"))
    wanted = C.bounded(classes.join(used, "s"), "wanted", BROADCAST_ROWS)
    sets = C.materialize(_sets(docs, wanted, k), "sets")
    C.release(wanted)
    second = _shared(_second_prefixes(sets, orders), "prefixes-2")
    counts_2 = _counts(_unlisted(second), "unlisted-2")
    both = C.materialize(_surviving(pairs, second, counts_2, percent), "pairs-2")
    C.release(pairs, counts_2)
    blocks = _blocks(both, sets, frequent)
    crossing = C.materialize(_block_pairs(both, frequent, second, blocks), "block-pairs")
    C.release(both, frequent, second)

    # packs of about the same number of shingles
    packs = 1 + int((blocks.agg(F.sum("n")).first()[0] or 0) // PACK_SHINGLES)
    own = blocks.select("s", F.col("block").alias("pair"), F.lit(0).alias("side"), F.pmod(F.xxhash64("block"), F.lit(packs)).alias("pack"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b").alias("block"), F.lit(1).alias("side"))))
    across = crossing.select(F.xxhash64("a", "b").alias("pair"), sides.alias("x")).select("pair", "x.*").join(blocks.select("s", "block"), "block")
    across = across.select("s", "pair", "side", F.col("pair").alias("pack"))
    found = C.materialize(_verify(own.unionByName(across).join(sets.select("s", "n_docs", "shingles"), "s"), percent), "links")
    C.release(sets, crossing, blocks)

    components = connected_components(found.select(F.col("s").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("s").agg(F.sum("n_links").alias("links"))
    roots = components.withColumnRenamed("id", "s")
    classes = classes.join(roots, "s", "left").join(links, "s", "left").withColumn("component", F.coalesce("component", "s"))
    classes = C.materialize(classes, "classes")
    C.release(found, components)
    least = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    # classes of a component are few rows of numbers; a component of very many classes is split by Spark's skew join
    classes = classes.join(least, "component").select(F.col("s").alias("key"), "component_id", (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return of_docs.join(classes, "key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
