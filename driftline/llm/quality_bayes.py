"""Quality classifier (operator 3): hierarchical empirical Bayes over documents, paths and hosts.

1. Every document gets shares of character classes, its length, mean word length and how well it packs.
2. A ridge logistic regression, fitted on a bounded sample of labelled rows, turns them into evidence: the log-odds of
   good quality less the log-odds of the training rows, a log likelihood ratio.
3. Expected good documents are summed by host and by path within host, over all documents. Rates of sparse hosts are
   shrunk towards the global rate and rates of sparse paths towards their host's; the strength of both priors comes
   from the spread of the rates by the method of moments.
4. A document's posterior adds its evidence to the log-odds of its path's rate, its own share in that rate left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

#: Labelled rows that the regression is fitted on at most, those of the least id hashes.
TRAIN_ROWS = 20_000
RIDGE = 1.0
#: Sites up to which the site table is broadcast; beyond it Spark joins by shuffling.
BROADCAST_ROWS = 500_000
#: Bounds of a prior's strength in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 10_000.0
KEEP_AT = 0.5

CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\x0b\x0c\r", "#", "$", "%", "&", "*", "|", "!", "?", ".", ",", ";:", "<>", "[](){}", "=+/\\^~`", "@", "\"'", "-_")
N_CLASSES = len(CLASSES) + 3
N_FEATURES = N_CLASSES + 3


def _class_table() -> np.ndarray:
    out = np.full(256, len(CLASSES), dtype=np.int64)
    for k, chars in enumerate(CLASSES):
        out[list(chars.encode())] = k
    out[128:192] = len(CLASSES) + 1
    out[192:] = len(CLASSES) + 2
    return out


def features(texts: list[bytes]) -> np.ndarray:
    """A row of ``N_FEATURES`` for each text."""
    table = _class_table()
    out = np.zeros((len(texts), N_FEATURES), dtype=np.float32)
    for i, t in enumerate(texts):
        if not t:
            continue
        counts, words, previous = np.zeros(N_CLASSES), 0, True
        packer, packed = zlib.compressobj(1), 0
        for k in range(0, len(t), 1 << 22):
            data = np.frombuffer(t, np.uint8, min(1 << 22, len(t) - k), k)
            counts += np.bincount(table[data], minlength=N_CLASSES)
            space = (data == 32) | ((data >= 9) & (data <= 13))
            words += int(np.count_nonzero(~space[1:] & space[:-1])) + int(previous and not space[0])
            previous = bool(space[-1])
            packed += len(packer.compress(t[k : k + (1 << 22)]))
        packed += len(packer.flush())
        out[i, :N_CLASSES] = np.sqrt(counts / len(t))
        out[i, N_CLASSES] = np.log1p(words) / 10
        out[i, N_CLASSES + 1] = min(len(t) / max(words, 1), 100) / 10
        # how little is left of repeated text; the constant is what packing costs a short text
        out[i, N_CLASSES + 2] = np.log(packed / (len(t) + 20))
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression by Newton's method; zeros for one class only."""
    w = np.zeros(x.shape[1] + 1)
    if len(y) == 0 or y.min() == y.max():
        return w
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))]).astype(float)
    penalty = np.diag([ridge] * x.shape[1] + [1e-9])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    out = np.append(w[:-1] / scale, w[-1] - (w[:-1] / scale) @ centre)
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    out[-1] -= np.log(rate / (1 - rate))
    return out


def site_columns(docs: DataFrame) -> tuple[Column, Column]:
    """Host and path of a document: from ``source``, and where that names no path, its language."""
    source = F.lower(F.coalesce(F.col("source").cast("string"), F.lit(""))) if "source" in docs.columns else F.lit("")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    bare = F.regexp_replace(source, r"^[a-z]+://", "")
    path = F.regexp_extract(bare, r"^[^/]*/([^/?#]+)", 1)
    return F.regexp_extract(bare, r"^([^/?#]*)", 1), F.when(path != "", path).otherwise(lang)


def with_evidence(docs: DataFrame, weights: np.ndarray | None = None, column: str = "evidence", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and its features, or with ``weights`` its evidence, in ``column``."""
    C.ship(docs.sparkSession)
    kind = T.ArrayType(T.FloatType()) if weights is None else T.DoubleType()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                x = features([(v.as_py() or "").encode("utf-8", "replace") for v in part.column(at)])
                if weights is None:
                    made = pa.array([r.tolist() for r in x], pa.list_(pa.float32()))
                else:
                    # row by row: a matrix product may add in an order that depends on the number of rows
                    made = pa.array((x * weights[:-1]).sum(1) + weights[-1], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, kind)]))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and marks of up to ``rows`` labelled documents.

    Repeated labels of a document count once, as the greatest; of the rows of one id the text of least hash counts.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") > 0).cast("int")).alias("good"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = C.id_and_text(docs).join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows
    one = found.groupBy("doc_id", "good").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    found = with_evidence(one, column="x").select("doc_id", "good", "x").toPandas().sort_values("doc_id")
    return np.array(found["x"].tolist(), dtype=float).reshape(len(found), N_FEATURES), found["good"].to_numpy(dtype=float)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Weights fitted on the training rows and the share of good ones among them; one half without any."""
    x, good = training_rows(docs, labels, rows)
    return fit(x, good), float(good.mean()) if len(good) else 0.5


def _exact(c: Column) -> Column:
    """A sum that does not depend on the order of the rows: whole multiples of 10^-15 are added."""
    return F.sum(c.cast("decimal(38,15)")).cast("double")


def _strength(rows: DataFrame, rate: Column, centre: Column, n: Column) -> float:
    """Strength of a beta prior by the method of moments: the spread of rates beyond what sampling explains."""
    noise = centre * (1 - centre)
    r = rows.agg(
        _exact(n * F.pow(rate - centre, 2)).alias("spread"), _exact(noise).alias("noise"), F.sum(n).alias("n"), _exact(n * noise).alias("base")
    ).first()
    if not r["n"] or not r["base"]:
        return MOST_STRENGTH
    between = max((r["spread"] - r["noise"]) / r["n"], 0.0)
    within = r["base"] / r["n"]
    return float(np.clip(within / between - 1, LEAST_STRENGTH, MOST_STRENGTH)) if between > 0 else MOST_STRENGTH


def sites(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """``host, path, n, good, host_n, host_good`` summed over all documents, the global rate and both strengths."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), _exact(F.col("p")).alias("good"))
    paths = C.materialize(paths, "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), _exact(F.col("good")).alias("host_good"))
    table = paths.join(hosts, "host")
    total = hosts.agg(F.sum("host_n").alias("n"), _exact(F.col("host_good")).alias("good")).first()
    rate = float(np.clip(total["good"] / total["n"], 1e-6, 1 - 1e-6)) if total["n"] else 0.5
    k_host = _strength(hosts, F.col("host_good") / F.col("host_n"), F.lit(rate), F.col("host_n"))
    host_rate = (F.col("host_good") + k_host * rate) / (F.col("host_n") + k_host)
    k_path = _strength(table, F.col("good") / F.col("n"), host_rate, F.col("n"))
    if paths.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    return table, rate, k_host, k_path


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, rows: int = TRAIN_ROWS, column: str = "quality_") -> DataFrame:
    """All columns of ``docs`` with a struct ``column`` of host, path, evidence, site rate, posterior and ``kept``.

    Null texts count as empty and get the evidence of an empty text; null sources and languages are sites of their
    own; repeated rows are scored alike. The result does not depend on how rows are partitioned. Without labels of both classes there is no evidence and everything is kept.
    Further columns pass through whatever their names; one named like ``column`` is replaced. Empty tables give empty
    results.
    """
    weights, base = train(docs, labels, rows)
    base = float(np.clip(base, 1e-3, 1 - 1e-3))
    host, path = site_columns(docs)
    prior = float(np.log(base / (1 - base)))
    slim = docs.select(F.col("text"), host.alias("host"), path.alias("path"))
    slim = with_evidence(slim, weights).select("host", "path", (1 / (1 + F.exp(-(F.col("evidence") + prior)))).alias("p"))
    table, rate, k_host, k_path = sites(slim)
    table = table.withColumnsRenamed({"host": "of_host", "path": "of_path"})
    # the document's own columns travel as one struct, so that no name of theirs can clash
    others = [c for c in docs.columns if c != column]
    full = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("doc"), F.col("text"), host.alias("host"), path.alias("path"))
    full = with_evidence(full, weights).drop("text")
    joined = full.join(table, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")))
    own = 1 / (1 + F.exp(-(F.col("evidence") + prior)))
    host_rate = (F.col("host_good") - own + k_host * rate) / (F.col("host_n") - 1 + k_host)
    path_rate = (F.col("good") - own + k_path * host_rate) / (F.col("n") - 1 + k_path)
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + _odds(path_rate))))
    keep = posterior >= keep_at if np.any(weights) else F.lit(True)
    return joined.select(
        *[F.col(f"doc.`{c}`") for c in others],
        F.struct("host", "path", "evidence", path_rate.alias("site_rate"), posterior.alias("posterior"), keep.alias("kept")).alias(column),
    )

