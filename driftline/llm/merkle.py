"""A Merkle tree over each source and over the sources: subroots, root, and a proof for each row.

Leaves are numbered in order by a range partitioning and one row for each partition and tree. Then children arrive at
their parents as events, as in ``combineByKey``: a partial parent holds the digests that came so far by their place; when
it has as many as the tree's size says, it is a node, and an event for its own parent. What a task cannot complete is
its frontier, a few partial parents at either end of its stretch; frontiers are shuffled to a common ancestor, merged
and completed in the same way. Every parent keeps its children's digests; these links, read from the root down in
stretches of some levels, give each leaf its siblings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

ARITY = 3
#: Levels of links that meet in one group on the way down: 3^7 leaves and half as many parents.
STRETCH = 7
#: Partial parents that meet in one group on the way up.
FRONTIER = 20_000
#: Rows of partitions and trees, or of sources, up to which their table is broadcast.
BROADCAST_ROWS = 500_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: A node whose ``digest`` is null is a partial parent; ``children`` are digests of 32 bytes, ``held`` says which are there.
NODES = "tree string, size long, level int, idx long, held int, children binary, digest binary"
_NODE_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
_NODE_NAMES = [c.split()[0] for c in NODES.split(", ")]
POWERS = [ARITY**k for k in range(39)]


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 in hex of the columns: ``-`` for null, else the bytes' number, a colon and the value."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def _height(size: Column) -> Column:
    """Levels above the leaves."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in POWERS]), lambda p: p < size))


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (with ``tree``) as a table with ``idx``, the place in its tree by ``order``, and the tree's ``size``.

    Rows equal in ``order`` should be equal. Partitions are ranges, so a large tree spreads over many of them.
    """
    sorted_ = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = C.materialize(sorted_.withColumn("_pos", F.monotonically_increasing_id()), "leaves").withColumn("_part", F.shiftright("_pos", 33))
    runs = rows.groupBy("_part", "tree").agg(F.count("*").alias("n"), F.min("_pos").alias("_first"))  # a row for each partition and tree in it
    own = Window.partitionBy("tree")
    before = F.sum("n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_part", F.col("tree").alias("_tree"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("n").over(own).alias("size"))
    runs = C.bounded(runs, "leaf-runs", BROADCAST_ROWS)
    met = rows.join(runs.withColumnRenamed("_part", "_of"), (F.col("_part") == F.col("_of")) & F.col("tree").eqNullSafe(F.col("_tree")))
    out = met.select(*leaves.columns, (F.col("_pos") + F.col("_shift")).alias("idx"), "size")
    out._driftline_tables = (rows, runs)
    return out


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lets leaves and partial parents arrive; gives completed parents as they come and partial ones at the end."""
    waiting: dict[tuple, dict[int, bytes]] = {}
    sizes: dict[str | None, int] = {}
    out: list[tuple] = []

    def done(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _NODE_TYPES, strict=True)], _NODE_NAMES)

    def arrive(tree: str | None, size: int, parent_level: int, parent: int, came: dict[int, bytes]) -> None:
        while True:
            below = -(-size // POWERS[parent_level - 1])  # nodes of the children's level
            if below == 1:
                return  # the child was the root
            held = waiting.setdefault((tree, parent_level, parent), {})
            held.update(came)
            arity = min(ARITY, below - parent * ARITY)
            if len(held) < arity:
                return
            del waiting[tree, parent_level, parent]
            children = [held[k] for k in range(arity)]
            digest = hashlib.sha256("".join(c.hex() for c in children).encode()).digest()
            out.append((tree, size, parent_level, parent, arity, b"".join(children), digest))
            came, parent, parent_level = {parent % ARITY: digest}, parent // ARITY, parent_level + 1

    for batch in batches:
        for tree, size, level, idx, held, children, digest in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
            sizes[tree] = size
            if digest is not None:
                arrive(tree, size, level + 1, idx // ARITY, {idx % ARITY: digest})
            else:
                places = [k for k in range(ARITY) if held >> k & 1]
                arrive(tree, size, level, idx, {p: children[32 * k : 32 * k + 32] for k, p in enumerate(places)})
            if len(out) >= 4096:
                yield done(out)
                out.clear()
    for (tree, level, idx), held in waiting.items():
        out.append((tree, sizes[tree], level, idx, sum(1 << k for k in held), b"".join(held[k] for k in sorted(held)), None))
    if out:
        yield done(out)


def parents(leaves: DataFrame) -> list[DataFrame]:
    """Tables of all completed parents of numbered leaves (``tree, idx, size, leaf``); partial ones may be among them."""
    C.ship(leaves.sparkSession)
    events = leaves.select("tree", "size", F.lit(0).alias("level"), "idx", F.lit(0).alias("held"), F.lit(None).cast("binary").alias("children"), F.col("leaf").alias("digest"))
    tables = [C.materialize(events.mapInArrow(_climb, NODES), "nodes-0")]
    while open_ := tables[-1].where("digest IS NULL").count():
        frontier = tables[-1].where("digest IS NULL")
        # ancestors so far below the root that about FRONTIER partial parents share one; near the root all meet
        drop = 0
        while POWERS[drop] * FRONTIER < open_:
            drop += 1
        level = F.greatest("level", _height(F.col("size")) - drop) if drop else _height(F.col("size"))
        ancestor = F.floor(F.col("idx") / F.element_at(F.array(*[F.lit(float(p)) for p in POWERS]), (level - F.col("level") + 1).cast("int")))
        met = frontier.withColumn("_at", ancestor).repartition("tree", "_at").drop("_at")
        tables.append(C.materialize(met.mapInArrow(_climb, NODES), f"nodes-{len(tables)}"))
    return tables


def _completed(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.where("digest IS NOT NULL")


def roots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tree, size, digest`` of each tree; that of a lone leaf is the leaf."""
    top = nodes.where(F.col("level") == _height(F.col("size"))).select("tree", "size", "digest")
    return top.unionByName(leaves.where("size = 1").select("tree", "size", F.col("leaf").alias("digest")))


#: What meets in a group on the way down: the way up from its top, then its parents, then its leaves.
_DOWN = "tree string, block long, kind int, level int, idx long, children binary, path string, root binary, leaf binary, changed binary, doc_id long"
PATHS = "tree string, idx long, path string, root binary"
PROOFS = "doc_id long, tree string, leaf string, subroot string, path string, proof_sha256 string, folded_root string"


def _steps(path: str) -> list[tuple[str, str]]:
    return [tuple(s.split(",")) for s in path.split(";")] if path else []


def fold(leaf: str, path: str) -> str:
    """The root that a leaf's digest and its siblings give; a path's steps are ``before,after`` in hex with ``;`` between."""
    for before, after in _steps(path):
        leaf = hashlib.sha256((before + leaf + after).encode()).hexdigest()
    return leaf


def _descend(bottom: int, last: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ways up from nodes of level ``bottom``, or, with ``last``, proofs of the leaves, group by group."""
    group, path, root = None, "", b""
    children: dict[tuple[int, int], bytes] = {}
    known: dict[tuple[int, int], str] = {}
    out: list[tuple] = []
    names, types = ([c.split()[0] for c in s.split(", ")] for s in (PROOFS, PROOFS)) if last else ([c.split()[0] for c in s.split(", ")] for s in (PATHS, PATHS))
    types = [pa.int64(), *[pa.string()] * 6] if last else [pa.string(), pa.int64(), pa.string(), pa.binary()]

    def way(level: int, idx: int) -> str:
        """The steps from a node up to the root; groups are bounded, so all of them are remembered."""
        if (level, idx) not in known:
            own = children.get((level + 1, idx // ARITY))
            if own is None:
                return path  # the top of the group
            at = 32 * (idx % ARITY)
            above = way(level + 1, idx // ARITY)
            known[level, idx] = f"{own[:at].hex()},{own[at + 32 :].hex()}" + (";" + above if above else "")
        return known[level, idx]

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def nodes_of(level: int) -> Iterator[int]:
        for (above, idx), own in children.items():
            if above == level + 1:
                yield from range(idx * ARITY, idx * ARITY + len(own) // 32)

    def closed() -> None:
        if group is not None and not last:
            out.extend((group[0], idx, way(bottom, idx), root) for idx in nodes_of(bottom))

    for batch in batches:
        for tree, block, kind, level, idx, own, above, top, leaf, changed, doc_id in zip(*[batch.column(k).to_pylist() for k in range(11)], strict=True):
            if group != (tree, block):
                closed()
                group, path, root = (tree, block), "", b""
                children.clear()
                known.clear()
            if kind == 0:
                path, root = above, top
            elif kind == 1:
                children[level, idx] = own
            else:
                steps = way(0, idx)
                digest = hashlib.sha256(steps.replace(",", "").replace(";", "").encode()).hexdigest()
                out.append((doc_id, tree, leaf.hex(), root.hex(), steps, digest, fold((changed or leaf).hex(), steps)))
            if len(out) >= 1024:
                yield done()
                out.clear()
    closed()
    if out:
        yield done()


def _down(leaves: DataFrame, nodes: DataFrame, tops: DataFrame, height: int) -> DataFrame:
    """``PROOFS`` of numbered leaves (``doc_id, tree, idx, size, leaf, changed``), whose trees' ways up begin with ``tops``.

    ``tops`` has ``tree, size, path, digest``. Each stretch of levels is one shuffle; all but the last are small.
    """
    spark, paths = leaves.sparkSession, None
    tops = tops.select("tree", F.ceil(F.greatest(_height(F.col("size")), F.lit(1)) / STRETCH).cast("int").alias("stretches"), "path", F.col("digest").alias("root"))
    for s in reversed(range(max(1, -(-height // STRETCH)))):
        low, high = STRETCH * s, STRETCH * (s + 1)
        empty = {c.split()[0]: F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _DOWN.split(", ")}

        def row(**given: Column | str) -> list[Column]:
            return [(F.col(v) if isinstance(v, str) else v).cast(kind).alias(c) if (v := given.get(c)) is not None else empty[c] for c, kind in (x.split() for x in _DOWN.split(", "))]

        met = tops.where(F.col("stretches") == s + 1).select(*row(tree="tree", block=F.lit(0), kind=F.lit(0), path="path", root="root"))
        if paths is not None:
            met = met.unionByName(paths.select(*row(tree="tree", block="idx", kind=F.lit(0), path="path", root="root")))
        within = nodes.where((F.col("level") > low) & (F.col("level") <= high))
        power = F.element_at(F.array(*[F.lit(float(p)) for p in POWERS[: STRETCH + 1]]), (F.lit(high + 1) - F.col("level")).cast("int"))
        met = met.unionByName(within.select(*row(tree="tree", block=F.floor(F.col("idx") / power), kind=F.lit(1), level="level", idx="idx", children="children")))
        if s == 0:
            met = met.unionByName(leaves.select(*row(tree="tree", block=F.floor(F.col("idx") / POWERS[STRETCH]), kind=F.lit(2), idx="idx", leaf="leaf", changed="changed", doc_id="doc_id")))
        met = met.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind")
        C.ship(spark)
        found = met.mapInArrow(lambda batches, low=low, last=s == 0: _descend(low, last, batches), PROOFS if s == 0 else PATHS)
        paths = found if s == 0 else C.materialize(found, "paths")
    return paths


def _grown(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Completed parents, roots and the greatest height of numbered leaves."""
    nodes = _completed(parents(leaves))
    top = C.materialize(roots(leaves, nodes), "roots")
    height = top.agg(F.max(_height(F.col("size")))).collect()[0][0] or 0
    return nodes, top, height


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "source", changed: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified`` of each row.

    Each value of ``tree_col`` is a tree of its own whose leaves ascend by id; null is a tree too, the first one, and
    null ids come first. Rows of one id are in the order of their digests. ``proof`` has the siblings as
    ``before,after`` of each level from the leaf up, in hex with ``;`` between. With ``changed`` (columns in place of
    ``fields``), ``folded_root`` folds the digest of the changed row instead. A row that is a whole table by itself is
    root, subroot and leaf, with an empty proof. An empty table has no rows; columns that are not ``fields`` are ignored.
    """
    columns = [F.col(f"`{c}`") for c in fields]
    leaf = leaf_digest(columns)
    other = leaf_digest([(changed or {}).get(c, F.col(f"`{c}`")) for c in fields])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(tree_col).cast("string").alias("tree"), F.unhex(leaf).alias("leaf"), other.alias("_other"), leaf.alias("_leaf"))
    rows = rows.select("doc_id", "tree", "leaf", F.when(F.col("_other") != F.col("_leaf"), F.unhex("_other")).alias("changed"))
    rows = C.materialize(rows, "digests")  # ranges are found by sampling, which would hash all texts once more
    leaves = numbered(rows, ["doc_id", "leaf", "changed"])
    nodes, subroots, height = _grown(leaves)
    # the sources are the leaves of one more tree
    outer = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("size").alias("rows"), F.col("digest").alias("leaf")), ["name"])
    over, top, above = _grown(outer)
    found = top.collect()  # one row
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean")
    root = bytes(found[0].digest).hex()
    # an outer leaf's id is its place, by which its name is found again
    ways = _down(outer.select(F.col("idx").alias("doc_id"), "tree", "idx", "size", "leaf", F.lit(None).cast("binary").alias("changed")), over, top.withColumn("path", F.lit("")), above)
    ways = ways.select(F.col("doc_id").alias("_idx"), "path").join(outer.select(F.col("idx").alias("_idx"), F.col("name").alias("tree"), F.col("rows").alias("size"), F.col("leaf").alias("digest")), "_idx")
    ways = C.materialize(ways.select("tree", "size", "path", "digest"), "ways")
    told = _down(leaves, nodes, ways, height)
    return told.select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"), F.col("path").alias("proof"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )
