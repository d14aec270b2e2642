"""Whitening, manifest and packing against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from driftline.llm import merkle, packing, queries, whitening

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def whitened_by_numpy(rows):
    kept = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: np.floor(256 * v).astype(np.int64) for i, v in kept}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, sums = len(fit), fit.sum(0)
    off = fit - sums / n
    values, axes = np.linalg.eigh(off.T @ off / n)
    out = {}
    for i, v in x.items():
        for k in [k for k in range(1, 5) if k <= len(values) and values[-k] > 1e-9 * values.sum()]:
            out[i, k] = n, int(((n * v - sums) ** 2).sum()), abs((v - sums / n) @ axes[:, -k]) / math.sqrt(values[-k]), values[-k] / values.sum()
    return out


def test_whitening_against_numpy(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = whitened_by_numpy(rows)
    got = {(r.vec_id, r.component): r for r in queries.op11_whitening(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and len({r.identity_error for r in got.values()}) == 1
    for key, (n, deviation, size, share) in want.items():
        r = got[key]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - size) < 1e-6 and abs(r.explained / share - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_of_odd_rows(spark):
    """Nulls, numbers that are not finite, copies, other lengths, clashing names; vectors all alike and no vectors."""
    rows = [(1, [1.0, 2.0, 0.5]), (2, [0.25, -1.0, 3.0]), (2, [0.25, -1.0, 3.0]), (3, None), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("-inf"), 1.0, 1.0]), (7, []), (8, [1.0]), (None, [0.0, 0.0, -0.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").selectExpr("*", "'a' AS whitening_", "'b' AS x_", "'c' AS `c_0.1`")
    got = whitening.whiten(df, "v").collect()
    want = whitened_by_numpy([(k, v) for k, v in rows if v is None or len(v) == 3])
    assert len(got) == 4 * 2  # three distinct vectors span two dimensions
    for r in got:
        told = r["whitening__"]
        assert r["whitening_"] == "a" and abs(abs(told.whitened) - want[r.vec_id, told.component][2]) < 1e-9 and told.identity_error < 1e-9
    alike = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(alike).collect() == []
    assert whitening.whiten(alike.where("false")).select("whitening_.*").columns == ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_pairs_are_one_aggregation_without_python(spark, sf_dir):
    df = queries.op11_whitening(spark, sf_dir)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    large = spark.createDataFrame([(1, [1e15]), (2, [-1e15]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert {r.whitening_.deviation for r in whitening.whiten(large).collect()} == {None, 0}


def manifest_by_hand(rows, tampered):
    """``rows`` of the five fields; gives a set of result rows."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def tree(digests):
        """The root and the siblings of each leaf, level by level."""
        ways, at, level = [[] for _ in digests], list(range(len(digests))), digests
        while len(level) > 1:
            for k, way in enumerate(ways):
                run = at[k] // 3 * 3
                way.append((level[run : at[k]], level[at[k] + 1 : run + 3]))
            level = [h(*level[k : k + 3]) for k in range(0, len(level), 3)]
            at = [a // 3 for a in at]
        return level[0], ways

    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    root, upper = tree([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper, strict=True):
        for row, way in zip(groups[s], trees[s][1], strict=True):
            steps = way + above
            folded = leaf((*row[:4], tampered(row)))
            for before, after in steps:
                folded = h(*before, folded, *after)
            out.append((row[0], leaf(row), trees[s][0], root, h(*[d for step in steps for d in (*step[0], *step[1])]), folded, folded == root))
    return sorted(out, key=str)


def without_line_feeds(row):
    even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
    return row[4].replace("\n", "") if even and row[4] is not None else row[4]


def test_manifest_of_the_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*merkle.FIELDS).collect()]
    df = queries.op12_merkle(spark, sf_dir)
    got = sorted([tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)
    assert got == manifest_by_hand(rows, without_line_feeds) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("frontier", [merkle.FRONTIER, 2])
def test_manifest_over_several_stretches(spark, frontier, monkeypatch):
    """A tree of nine levels, small ones, lone leaves, null names, ids and texts, and frontiers of several rounds."""
    monkeypatch.setattr(merkle, "FRONTIER", frontier)
    rng = random.Random(5)
    rows = [(k, "hot", "en", k, f"text {k}\n") for k in range(6600)]
    rows += [(10_000 + k, rng.choice(["a", "b", "é", None, "z" * 30]), None, None, rng.choice([None, "", "x\ny", "日本"])) for k in range(300)]
    rows += [(None, "hot", None, None, "no id"), (None, "lone", "en", 1, "x" * 100_000)] + [(77, "twice", "en", 3, "same")] * 5 + [(77, "twice", "en", 3, "other")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 AS tree", "2 AS idx", "3 AS size", "4 AS leaf")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = merkle.merkle_manifest(df.repartition(7), changed={"text": tampered}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found], key=str)
    assert got == manifest_by_hand(rows, without_line_feeds)
    assert all(merkle.fold(r.leaf, r.proof) == r.root for r in found)


def test_manifest_of_one_row_and_of_none(spark, docs):
    one = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    r = merkle.merkle_manifest(one).collect()[0]
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof == "" and r.verified and r.proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert merkle.merkle_manifest(one.where("false")).count() == 0


def packed_one_by_one(sizes, capacity):
    """Bins of best-two-fit, each filled for itself."""
    left, bins = sorted(sizes, reverse=True), []
    while left:
        bin_, room = [], capacity
        for n in list(left):
            if n <= room:
                bin_.append(n)
                left.remove(n)
                room -= n
        if room and len(bin_) > 1:
            least = bin_[-1]
            best = max(((a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= room + least), default=(0,))
            if best[0] > least:
                bin_.pop()
                for n in best[1:]:
                    left.remove(n)
                    bin_.append(n)
                left = sorted([*left, least], reverse=True)
        bins.append(sorted(bin_, reverse=True))
    return bins


@pytest.mark.parametrize("seed", range(60))
def test_kinds_of_bins_are_those_of_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([5, 12, 30, 100])
    most = rng.choice([3, capacity // 2, capacity])
    sizes = [rng.randint(1, max(1, most)) for _ in range(rng.randint(0, 120))] + [capacity] * rng.randint(0, 3)
    kinds = packing.best_two_fit({n: sizes.count(n) for n in set(sizes)}, capacity)
    bins = [sorted([n for n, t in pieces for _ in range(t)], reverse=True) for count, pieces in kinds for _ in range(count)]
    assert bins == packed_one_by_one(sizes, capacity)


def test_lengths_out_of_range():
    with pytest.raises(ValueError):
        packing.best_two_fit({9: 1}, 8)


def library_ids(text):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE_BPE)
    lib.no_truncation()
    lib.no_padding()
    return lib.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_of_odd_rows(spark, docs, rows, capacity):
    """Null, empty and very long texts, null and repeated ids, clashing names; whole ids come back from the sequences."""
    packed = packing.pack_documents(docs.repartition(3), BYTE_BPE, capacity)
    found = packed.collect()
    whole = defaultdict(dict)
    for r in found:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        whole[r.doc_id].setdefault(r.piece, set()).add((r.start, bytes(r.ids)))
    for i, text, *_ in rows:
        ids = [*library_ids(text), 0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        assert whole[i] == {k: {(a, np.array(ids[a:b], "<u4").tobytes())} for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    sizes = [r.length for r in found]
    assert len(bins) == len(packed_one_by_one(sizes, capacity)) and max(bins) == len(bins) - 1
    joined = {r.sequence_id: r for r in packing.sequences(packing.pack_documents(docs, BYTE_BPE, capacity)).collect()}
    assert sum(r.n_tokens for r in joined.values()) == sum(sizes) and all(len(r.ids) == 4 * r.n_tokens for r in joined.values())


def test_packing_fills_the_sequences(spark, sf_dir):
    found = queries.op13_packing(spark, sf_dir)
    r = found.agg(F.countDistinct("sequence_id").alias("bins"), F.sum("length").alias("tokens"), F.countDistinct("doc_id").alias("docs")).collect()[0]
    assert r.docs == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and r.bins <= math.ceil(r.tokens / 2048) + 1


def test_packing_of_no_rows(spark, no_docs):
    assert packing.pack_documents(no_docs, BYTE_BPE).collect() == []
