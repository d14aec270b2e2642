"""LM scoring (operator 6): context-tree weighting over binary-decomposed bytes.

Texts are lower-cased (A-Z) byte strings followed by an end byte 0; a NUL byte inside a text is the same symbol. Each
byte is eight binary decisions, one for every node of a byte's bit tree; each node has a context tree over the
preceding ``depth`` bytes. A context's counts of zeros and ones give a Krichevsky-Trofimov estimate, and weighting by
one half at every context mixes the estimates of all depths: P_w = 1/2 P_kt + 1/2 prod P_w(children). Counts are sums
over all training documents; block probabilities are built by grouped sums from the deepest contexts up, and the
predictions by joins from the root down. A text's score is the log10 probability of its bytes under the frozen tree.

The model stays a table. Its most frequent entries, a bounded number, are broadcast; what a document has beside them
goes as sums of ``(document, context and byte)`` to a join with the table. What was never seen in training is worked
out from the tree's own nodes, the deepest that know a decision.

The word unigram base is computed beside it. Words are known by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C
from ._words import LOWER, blocks, mix, word_hashes

#: Bytes of a context, at most 7: with the byte itself they make a 64-bit key.
DEPTH = 5
FOLDS, HELD_OUT_FOLD = 5, 1
#: Words and contexts with a byte that are broadcast, the most frequent ones; others come by a join.
FREQUENT_WORDS, FREQUENT_GRAMS = 1 << 18, 1 << 21
#: Rows of the tree that a task turns into predictions of bytes at once, about.
GROUP_ROWS = 1 << 20
END_WORD = -7046029254386353131
_FLUSH_WORDS, _FLUSH_BYTES = 3_000_000, 12_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT_FOLD, F.lit(False))


def gram_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte of every place of the texts, ends included, as 64-bit keys; where each text ends."""
    gap = bytes(depth)
    data = LOWER[np.frombuffer(gap + gap.join(texts) + b"\0", dtype=np.uint8)]
    sizes = np.array([len(t) for t in texts], dtype=np.int64) + 1
    keys = np.zeros(len(data) - depth, dtype=np.uint64)
    for k in range(depth + 1):
        keys <<= np.uint64(8)
        keys |= data[k : len(data) - depth + k]
    ends = np.cumsum(sizes)
    if len(texts) == 1 or depth == 1:
        return keys, ends
    place = np.arange(ends[-1]) + np.repeat(np.arange(len(texts)) * (depth - 1), sizes)
    return keys[place], ends


def _count(docs: DataFrame, depth: int) -> DataFrame:
    """``kind, key, n``: words (0) and contexts with a byte (1) of a part of a task, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(kind: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for k in range(0, len(keys), 1 << 18):
                some = keys[k : k + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some.view(np.int64)), pa.array(n[k : k + (1 << 18)].astype(np.int64))], ["kind", "key", "n"])

        words, grams, n_words, n_grams, docs_ = [], [], 0, 0, 0
        for batch in batches:
            texts = [v.as_py() for v in batch.column(1)]
            docs_ += len(texts)
            for a, b in blocks(texts):
                hashes, _ = word_hashes(texts[a:b])
                keys, _ = gram_keys(texts[a:b], depth)
                words.append(hashes)
                grams.append(keys)
                n_words, n_grams = n_words + len(hashes), n_grams + len(keys)
                if n_words >= _FLUSH_WORDS:
                    yield from emit(0, words)
                    n_words = 0
                if n_grams >= _FLUSH_BYTES:
                    yield from emit(1, grams)
                    n_grams = 0
        if words:
            yield from emit(0, words)
        if grams:
            yield from emit(1, grams)
        if docs_:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([END_WORD]), pa.array([docs_])], ["kind", "key", "n"])
        C.trim()

    return docs.mapInArrow(run, "kind int, key long, n long")


def _ln_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1/2: Stirling's series at x + 7."""
    z = x + 7
    steps = x
    for k in range(1, 7):
        steps = steps * (x + k)
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    return series - F.log(steps)


def _kt(counts: DataFrame) -> DataFrame:
    """Adds the KT block probability and the KT prediction of a one to counts ``a`` of zeros and ``b`` of ones."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    return counts.withColumns({"kt": _ln_gamma(a + 0.5) + _ln_gamma(b + 0.5) - _ln_gamma(a + b + 1) - math.log(math.pi), "one": (b + 0.5) / (a + b + 1)})


def _suffix(ctx: Column, d: int) -> Column:
    return ctx.bitwiseAND((1 << (8 * d)) - 1)


def _path(byte: Column) -> list[Column]:
    """The eight nodes of a byte and the bits taken there."""
    return [
        F.struct((F.lit(1 << k) + F.shiftright(byte, 8 - k)).cast("int").alias("node"), F.shiftright(byte, 7 - k).bitwiseAND(1).cast("int").alias("bit"))
        for k in range(8)
    ]


def context_tree(grams: DataFrame, depth: int) -> list[DataFrame]:
    """For each depth from 0: ``ctx, node, s, r``, the mixture down to this depth and the weight left for deeper ones.

    Where a deeper context is new, it predicts a one with probability one half.
    """
    ctx, byte = F.shiftrightunsigned("key", 8), F.col("key").bitwiseAND(255)
    # dealt by context, so that the nodes of a context are counted where its bytes are
    spread = grams.select(ctx.alias("ctx"), byte.alias("byte"), "n").repartition("ctx")
    nodes = spread.select("ctx", "n", F.explode(F.array(*_path(F.col("byte")))).alias("x")).select("ctx", "n", "x.*")
    zeros, ones = (F.sum(F.when(F.col("bit") == k, F.col("n")).otherwise(0)) for k in (0, 1))
    levels = [C.materialize(nodes.groupBy("ctx", "node").agg(zeros.alias("a"), ones.alias("b")), f"ctw-{depth}")]
    for d in range(depth - 1, -1, -1):
        below = _kt(levels[0]).withColumn("pw", F.col("kt")) if d == depth - 1 else levels[0]
        up = below.groupBy(_suffix(F.col("ctx"), d).alias("ctx"), "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("pw").alias("child"))
        high = F.greatest("kt", "child")
        pw = math.log(0.5) + high + F.log(F.exp(F.col("kt") - high) + F.exp(F.col("child") - high))
        up = _kt(up).withColumn("pw", pw).select("ctx", "node", "a", "b", "pw", F.exp(math.log(0.5) + F.col("kt") - F.col("pw")).alias("w"), "one")
        levels.insert(0, C.materialize(up, f"ctw-{d}"))
    w, one = F.col("w"), F.col("one")
    out = [C.materialize(levels[0].select("ctx", "node", (w * one).alias("s"), (1 - w).alias("r")), "tree-0")]
    for d in range(1, depth + 1):
        here = _kt(levels[d]).withColumn("w", F.lit(1.0)) if d == depth else levels[d]
        here = here.select("ctx", "node", "w", "one", _suffix(F.col("ctx"), d - 1).alias("up"))
        above = out[-1].select(F.col("ctx").alias("up"), "node", "s", "r")
        # contexts of no byte or one have 65,280 nodes at most; how many deeper ones have grows with the corpus
        above = above if d <= 2 else C.never_broadcast(above)
        here = here.join(above, ["up", "node"]).select("ctx", "node", (F.col("s") + F.col("r") * w * one).alias("s"), (F.col("r") * (1 - w)).alias("r"))
        out.append(C.materialize(here, f"tree-{d}"))
    C.release(*levels)
    return out


_PATH_NODES = np.array([[(1 << k) | (x >> (8 - k)) for k in range(8)] for x in range(256)])
_PATH_BITS = np.array([[(x >> (7 - k)) & 1 for k in range(8)] for x in range(256)], dtype=bool)
_PREDICTED = "s + r * 0.5D AS p"


def byte_logs(grams: DataFrame, deepest: DataFrame, rows: int) -> DataFrame:
    """``key, n, logs``: the log10 probability of each byte after each context that training has seen it in."""

    def build(group: pa.Table) -> pa.Table:
        ctx, node, byte, p, n = (group[c].to_numpy() for c in ("ctx", "node", "byte", "p", "n"))
        own = byte < 0
        known = (ctx[own].view(np.uint64) << np.uint64(8)) | node[own].astype(np.uint64)
        at = np.argsort(known)
        known, p = known[at], p[own][at]
        ctx, byte = ctx[~own].view(np.uint64) << np.uint64(8), byte[~own]
        logs = np.zeros(len(ctx))
        for k in range(8):
            q = p[np.searchsorted(known, ctx | _PATH_NODES[byte, k].astype(np.uint64))]
            logs += np.log10(np.where(_PATH_BITS[byte, k], q, 1 - q))
        return pa.table([pa.array((ctx | byte.astype(np.uint64)).view(np.int64)), pa.array(n[~own]), pa.array(logs.astype(np.float32))], names=["key", "n", "logs"])

    both = deepest.selectExpr("ctx", "node", "-1 AS byte", _PREDICTED, "0L AS n").unionAll(
        grams.select(F.shiftrightunsigned("key", 8), F.lit(0), F.col("key").bitwiseAND(255).cast("int"), F.lit(0.0), "n")
    )
    # as many groups as rows need; each has all rows of its contexts
    part = F.pmod(F.xxhash64("ctx"), F.lit(1 + rows // GROUP_ROWS))
    return both.groupBy(part.alias("part")).applyInArrow(build, "key long, n long, logs float")


def new_logs(keys: DataFrame, tree: list[DataFrame]) -> DataFrame:
    """As :func:`byte_logs` for keys that training has not seen: each decision by the deepest context that knows it."""
    ctx, byte = F.shiftrightunsigned("key", 8), F.col("key").bitwiseAND(255)
    steps = keys.select("key", ctx.alias("c"), F.explode(F.array(*_path(byte))).alias("x"))
    steps = steps.select("key", "x.*", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), _suffix(F.col("c"), d).alias("ctx")) for d in range(len(tree))])).alias("y")).select("key", "node", "bit", "y.*")
    nodes = tree[0].withColumn("d", F.lit(0))
    for d, level in enumerate(tree[1:], 1):
        nodes = nodes.unionAll(level.withColumn("d", F.lit(d)))
    # a key has 8 * (depth + 1) steps
    found = C.never_broadcast(steps).join(nodes.selectExpr("d", "ctx", "node", _PREDICTED), ["d", "ctx", "node"])
    found = found.groupBy("key", "node", "bit").agg(F.max(F.struct("d", "p"))["p"].alias("p"))
    found = found.groupBy("key").agg(F.sum(F.log10(F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p")))).alias("known"), F.count("*").alias("n"))
    logs = F.coalesce("known", F.lit(0.0)) + (8 - F.coalesce("n", F.lit(0))) * math.log10(0.5)
    return keys.join(found, "key", "left").select("key", logs.cast("float").alias("logs"))


class Lookup:
    """Values of 64-bit keys in hash tables: keys whose place is taken go to the next, smaller one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables: list[tuple[np.ndarray, np.ndarray, np.uint64]] = []
        while len(keys):
            bits = max(4, len(keys).bit_length())
            at = mix(keys + np.uint64(len(self.tables))) >> np.uint64(64 - bits)
            own = np.full(1 << bits, keys[0], dtype=np.uint64)  # an empty place has a key that belongs to another one
            held = np.zeros(1 << bits, dtype=values.dtype)
            own[at], held[at] = keys, values
            stays = own[at] == keys
            self.tables.append((own, held, np.uint64(64 - bits)))
            keys, values = keys[~stays], values[~stays]

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, and which keys are known."""
        out, known = np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
        left = np.arange(len(keys))
        for k, (own, held, shift) in enumerate(self.tables):
            at = (mix(keys + np.uint64(k)) >> shift).astype(np.int64)
            hit = own[at] == keys
            out[left[hit]], known[left[hit]] = held[at[hit]], True
            left, keys = left[~hit], keys[~hit]
            if not len(keys):
                break
        return out, known


_lookups: dict[str, Lookup] = {}


def _lookup(name: str, shared) -> Lookup:
    """The table of a broadcast, built once in a worker."""
    if name not in _lookups:
        _lookups.clear()
        _lookups[name] = Lookup(*shared.value)
    return _lookups[name]


def most_frequent(counts: DataFrame, most: int) -> Column:
    """Which rows of ``counts`` are among the most frequent, at most ``most`` in all."""
    step = F.floor(F.log2("n") * 8)
    least, room = 1 << 62, most
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("m")).orderBy(F.desc("step")).collect():  # a few hundred steps whatever the corpus
        room -= r["m"]
        if room < 0:
            break
        least = r["step"]
    return step >= least


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte`` for each row.

    Trained on the rows whose fold is not held out, all of them. A null text counts as empty and has its end alone. A
    null id is no held-out row. Repeated rows train as often as they occur and are scored alike. Without training rows
    every bit has probability one half. Further columns are ignored. An empty table gives an empty result.
    """
    if not 1 <= depth <= 7:
        raise ValueError("depth is 1 to 7")
    spark = docs.sparkSession
    C.ship(spark)
    docs = C.id_and_bytes(docs, id_col, text_col)
    counted = _count(docs.where(~held_out(F.col("doc_id"))), depth).groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = C.materialize(counted, "lm-counts")
    C.forget(spark)
    words, grams = counted.where("kind = 0").select("key", "n"), counted.where("kind = 1").select("key", "n")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_train, distinct = int(total["n"] or 0), int(total["v"])
    floor = n_train + 0.5 * (distinct + 1)
    ends = words.where(F.col("key") == END_WORD).first()
    n_ends = int(ends["n"]) if ends else 0
    end_log = math.log10((n_ends + 0.5) / floor)

    tree = context_tree(grams, depth)
    logs = C.materialize(byte_logs(grams, tree[-1], tree[-1].count() + grams.count()), "byte-logs")
    C.forget(spark)

    def sent(rows: DataFrame, value: Column):
        got = rows.select("key", value.alias("v")).toArrow()
        return spark.sparkContext.broadcast((got["key"].to_numpy().view(np.uint64), got["v"].to_numpy()))

    word_log = F.log10((F.col("n") + 0.5) / F.lit(floor))
    frequent = [sent(words.where(most_frequent(words, FREQUENT_WORDS)), word_log), sent(logs.where(most_frequent(logs, FREQUENT_GRAMS)), F.col("logs"))]
    name = uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_of = Lookup(*frequent[0].value)
        gram_of = _lookup(name, frequent[1])
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [v.as_py() for v in part.column(2)]
                cols: list[list] = [[] for _ in range(8)]
                for a, b in blocks(texts):
                    hashes, starts = word_hashes(texts[a:b])
                    keys, stops = gram_keys(texts[a:b], depth)
                    for base, of, all_keys, at in ((0, word_of, hashes, starts), (4, gram_of, keys, np.concatenate([[0], stops]))):
                        value, known = of(all_keys)
                        sums = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])[at]
                        cols[base] += np.diff(sums).tolist()
                        cols[base + 1] += np.diff(np.concatenate([[0], np.cumsum(known)])[at]).tolist()
                        owner = np.repeat(np.arange(b - a), np.diff(at))[~known]
                        rare = all_keys[~known]
                        order = np.lexsort((rare, owner))
                        rare, owner = rare[order], owner[order]
                        new = np.ones(len(rare), dtype=bool)
                        new[1:] = (rare[1:] != rare[:-1]) | (owner[1:] != owner[:-1])
                        first = np.flatnonzero(new)
                        m = np.diff(np.append(first, len(rare)))
                        cut = np.searchsorted(owner[first], np.arange(b - a + 1))
                        values = rare[first].view(np.int64)
                        cols[base + 2] += [values[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
                        cols[base + 3] += [m[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
                kinds = (pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                n_words = [int(c + m.sum()) + 1 for c, m in zip(cols[1], cols[3], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_words, pa.int64()), *[pa.array(c, t) for c, t in zip(cols, kinds * 2, strict=True)]],
                    ["doc_id", "held_out", "n_bytes", "n_tokens", *[f"{c}_{kind}" for kind in "wg" for c in ("sum", "n", "rare", "m")]],
                )
        C.trim()

    lists = ", ".join(f"sum_{k} double, n_{k} long, rare_{k} array<long>, m_{k} array<long>" for k in "wg")
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score, f"doc_id long, held_out boolean, n_bytes long, n_tokens long, {lists}")
    # the number of a row is fixed when the table is written
    scored = C.materialize(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scores")

    def rare(kind: str) -> DataFrame:
        return scored.select("row", F.explode(F.arrays_zip(F.col(f"rare_{kind}").alias("key"), F.col(f"m_{kind}").alias("m"))).alias("x")).select("row", "x.*")

    new = C.materialize(rare("g").select("key").distinct().join(logs, "key", "left_anti"), "new-grams")
    known = C.materialize(new_logs(new, tree), "new-logs")
    by_grams = rare("g").join(logs.select("key", "logs").unionAll(known), "key").groupBy("row").agg(F.sum(F.col("m") * F.col("logs")).alias("score"))
    by_words = rare("w").join(words, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_words = by_words.groupBy("row").agg(F.sum(F.col("m") * word_log).alias("base"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("known"))
    both = C.materialize(by_grams.join(by_words, "row", "full"), "rare-sums")
    C.release(*tree, logs, new, known)
    nothing = F.lit(0.0)
    out = scored.select("row", "doc_id", "held_out", "n_bytes", "n_tokens", "sum_w", "n_w", "sum_g").join(both, "row", "left")
    total_log = F.col("sum_g") + F.coalesce("score", nothing)
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_w") + F.coalesce("known", F.lit(0)) + F.lit(int(n_ends > 0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("sum_w") + F.coalesce("base", nothing) + F.lit(end_log)).alias("base_score"),
        total_log.alias("score"), "n_bytes",
        (-total_log * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
