"""Whitening of embeddings from column aggregates over the upper triangle of the covariance.

Vectors are quantised to whole numbers. The fit list has each distinct quantised vector once. One aggregation gives its
size and the sums by dimension; one more has a generated expression for each pair of dimensions, the sum of products of
centred values. The covariance is put together on the driver (its size is that of the dimensions, not of the rows) and
decomposed by LAPACK. The projection is again generated expressions, so all rows are handled by Spark alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Pairs of dimensions in one aggregation; more dimensions than 90 take several.
MOST_PAIRS = 4096
#: A component of less than this share of the variance is none: dividing by its root would only enlarge rounding errors.
LEAST_SHARE = 1e-12
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """A fitted model: size and sums of the fit list, variances by component, one component in each row of ``axes``."""

    n: int
    sums: list[int]
    variances: np.ndarray
    axes: np.ndarray
    total: float

    def centred(self, x: str) -> list[str]:
        """SQL expressions of the entries less their means."""
        return [f"CAST({x}[{i}] AS double) - {_number(s / self.n)}" for i, s in enumerate(self.sums)]

    def whitened(self, values: list[str]) -> list[str]:
        """SQL expressions of the components from columns of centred values."""
        return [f"{_added([f'{c} * {_number(w)}' for c, w in zip(values, axis, strict=True)])} / {_number(np.sqrt(v))}" for axis, v in zip(self.axes, self.variances, strict=True)]


def _number(v: float) -> str:
    return f"({float(v)!r}D)"


def _added(terms: list[str]) -> str:
    """The sum as a balanced tree, which is shallow whatever the number of terms."""
    while len(terms) > 1:
        terms = [f"({terms[k]} + {terms[k + 1]})" if k + 1 < len(terms) else terms[k] for k in range(0, len(terms), 2)]
    return terms[0]


def quantised(rows: DataFrame, vector: str, out: str) -> DataFrame:
    """Rows whose vector is not null and holds finite numbers only, with ``out``: ``floor(256 * c)`` of its entries."""
    ok = F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return rows.where(F.coalesce(ok, F.lit(False))).withColumn(out, F.transform(vector, lambda c: F.floor(256 * c.cast("double")).cast("long")))


def fit(vectors: DataFrame, x: str, most: int) -> Whitening | None:
    """The model of at most ``most`` components from distinct vectors of one length; None without any."""
    size = vectors.select(F.size(x).alias("d")).limit(1).collect()
    if not size:
        return None
    d = size[0].d
    n, *sums = vectors.selectExpr("count(*)", *[f"sum({x}[{i}])" for i in range(d)]).collect()[0]
    model = Whitening(n, sums, np.empty(0), np.empty((0, d)), 0.0)
    centred = vectors.selectExpr(*[f"{c} AS c{i}" for i, c in enumerate(model.centred(x))])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    v = np.zeros((d, d))
    for k in range(0, len(pairs), MOST_PAIRS):
        some = pairs[k : k + MOST_PAIRS]
        found = centred.selectExpr(*[f"sum(c{i} * c{j}) AS p{i}_{j}" for i, j in some]).collect()[0]
        for (i, j), total in zip(some, found, strict=True):
            v[i, j] = v[j, i] = total / n
    values, axes = np.linalg.eigh(v)
    model.total = float(np.trace(v))
    keep = [k for k in reversed(range(d)) if values[k] > LEAST_SHARE * model.total][:most]
    model.variances, model.axes = values[keep], axes[:, keep].T
    return model


def whiten(rows: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = 4, out: str = "whitening_") -> DataFrame:
    """All columns of ``rows`` and a struct ``out``: ``component, n, deviation, whitened, explained, identity_error``.

    One row for each input row and component, in falling order of variance. Left out are rows whose vector is null,
    empty, holds null or a number that is not finite, or is not of the commonest length (of equally common ones the
    least). A component without variance does not exist, so vectors that are all alike give no row, as does an empty
    table. ``deviation`` is null where it goes over 64 bits. Repeated rows and null ids are rows as others. Where
    ``rows`` has a column of the name ``out`` already, an underscore is added to it.
    """
    out = C.fresh(rows, out)
    x, at = C.fresh(rows, "x_"), C.fresh(rows, "c_")
    found = quantised(rows, vector, x)
    kind = found.schema[x].dataType.simpleString()
    lengths = found.where(F.size(x) > 0).groupBy(F.size(x).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d = lengths[0].d if lengths else 0
    found = found.where(F.size(x) == d) if d else found.where("false")
    distinct = C.materialize(found.select(F.col(x).alias("x")).distinct(), "distinct-vectors")
    model = fit(distinct, "x", components)
    assert kind == "array<bigint>", kind
    if model is None or not len(model.variances):
        C.release(distinct)
        return found.where("false").drop(x).withColumn(out, F.lit(None).cast(f"struct<{RESULT.replace(' ', ':').replace(',:', ',')}>"))
    names = [f"{at}{i}" for i in range(d)]
    fitted = distinct.selectExpr(*[f"{c} AS {n}" for c, n in zip(model.centred("x"), names, strict=True)])
    fitted = fitted.selectExpr(*[f"{c} AS w{k}" for k, c in enumerate(model.whitened(names))])
    k = len(model.variances)
    around = fitted.agg(*[F.covar_pop(f"w{a}", f"w{b}") for a in range(k) for b in range(a, k)]).collect()[0]
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    error = max(abs(c - (a == b)) for (a, b), c in zip(pairs, around, strict=True))
    C.release(distinct)
    rough = _added([f"({c}) * ({c})" for c in (f"{_number(model.n)} * {x}[{i}] - {_number(s)}" for i, s in enumerate(model.sums))])
    exact = _added([f"({c}) * ({c})" for c in (f"{model.n}L * {x}[{i}] - ({s}L)" for i, s in enumerate(model.sums))])
    kept = [F.col(f"`{c}`") for c in rows.columns]
    centred = [F.expr(c).alias(n) for c, n in zip(model.centred(x), names, strict=True)]
    wide = found.select(*kept, F.expr(f"CASE WHEN {rough} < 9.2e18D THEN {exact} END").alias(x), *centred)
    each = F.array(*[
        F.struct(
            F.lit(i + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col(x).alias("deviation"), F.expr(w).alias("whitened"),
            F.lit(float(model.variances[i] / model.total)).alias("explained"), F.lit(float(error)).alias("identity_error"),
        )
        for i, w in enumerate(model.whitened(names))
    ])
    return wide.select(*kept, F.explode(each).alias(out))
