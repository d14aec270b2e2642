"""Scans along a key's rows that spread one key with very many rows over many tasks.

Rows are cut into stretches of their order, by default of a million units. A first window works inside each stretch, a
second one over one row for each stretch, and what stands before a stretch is joined back to its rows. All windows of
one stretch have few rows, whatever the key; rows are shuffled once, by key and stretch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Rows of a block of :func:`affine`, whose composed factor must stay far from the least floating point number.
MOST_BLOCK, LEAST_FACTOR = 4096, 1e-100


def _free(df: DataFrame, *names: str) -> list[str]:
    """Names that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Stretches:
    """``df`` cut into stretches of ``width`` along ``order`` within ``key``; ties are in the order of ``ties``.

    Rows of null order are one stretch, before all others; a null key is a key. Equal rows in ``order`` and ``ties``
    may come in any order, which is then the same for all that one call adds.
    """

    def __init__(self, df: DataFrame, key: str, order: str, width: float = 1e6, ties: tuple[str, ...] = ()):
        self.order, self.ties = order, ties
        self.key, self.stretch = _free(df, "_scan_key", "_stretch")
        # never null, so that plain equality joins them and their partitioning serves all steps
        name = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n"))
        at = F.coalesce(F.floor(F.col(order) / width).cast("long"), F.lit(-(2**63)))
        self.rows = df.withColumns({self.key: name, self.stretch: at})

    def inside(self, *by: str) -> WindowSpec:
        return Window.partitionBy(self.key, self.stretch).orderBy(*(by or (self.order, *self.ties)))

    def _carried(self, parts: list[Column], over: dict[str, Column]) -> None:
        """Adds columns of ``over``, which look at the earlier stretches' ``parts``, one row for each stretch."""
        own = self.rows.groupBy(self.key, self.stretch).agg(*parts)
        self.rows = self.rows.join(own.select(self.key, self.stretch, *[c.alias(n) for n, c in over.items()]), [self.key, self.stretch])

    def _earlier(self) -> WindowSpec:
        return Window.partitionBy(self.key).orderBy(self.stretch).rowsBetween(Window.unboundedPreceding, -1)

    def running_sum(self, value: Column, out: str, with_own: bool = True) -> Stretches:
        """``out``: the sum of ``value`` over the rows up to this one, or before it. Nulls count as nothing, no row as 0."""
        (x, before) = _free(self.rows, "_x", "_before")
        self.rows = self.rows.withColumn(x, value)
        zero = F.lit(0)
        self._carried([F.sum(x).alias("_s")], {before: F.coalesce(F.sum("_s").over(self._earlier()), zero)})
        frame = self.inside().rowsBetween(Window.unboundedPreceding, 0 if with_own else -1)
        self.rows = self.rows.withColumn(out, F.col(before) + F.coalesce(F.sum(x).over(frame), zero)).drop(x, before)
        return self

    def previous(self, values: dict[str, Column]) -> Stretches:
        """The columns of the row before, under the names in ``values``; null at a key's first row."""
        (x, before, n) = _free(self.rows, "_x", "_before", "_n")
        self.rows = self.rows.withColumn(x, F.struct(*[c.alias(k) for k, c in values.items()])).withColumn(n, F.row_number().over(self.inside()))
        self._carried([F.max_by(x, n).alias("_l")], {before: F.last("_l").over(self._earlier())})
        was = F.when(F.col(n) > 1, F.lag(x).over(self.inside(n))).otherwise(F.col(before))
        self.rows = self.rows.withColumn(x, was).withColumns({k: F.col(f"{x}.{k}") for k in values}).drop(x, before, n)
        return self

    def latest(self, value: Column, out: str, with_own: bool = True) -> Stretches:
        """``out``: the last non-null ``value`` of the rows up to this one, or before it."""
        (x, before, n) = _free(self.rows, "_x", "_before", "_n")
        self.rows = self.rows.withColumn(x, value).withColumn(n, F.row_number().over(self.inside()))
        self._carried([F.max_by(x, F.when(F.col(x).isNotNull(), F.col(n))).alias("_l")], {before: F.last("_l", ignorenulls=True).over(self._earlier())})
        frame = self.inside(n).rowsBetween(Window.unboundedPreceding, 0 if with_own else -1)
        self.rows = self.rows.withColumn(out, F.coalesce(F.last(x, ignorenulls=True).over(frame), F.col(before))).drop(x, before, n)
        return self

    def affine(self, factor: Column, terms: dict[str, Column], least: float) -> Stretches:
        """For each ``out`` of ``terms`` the value of ``y = factor * y + term`` up to this row, from 0 on.

        ``factor`` is 1 (with term 0: the row changes nothing), 0 (``y`` starts anew at the term) or at least ``least``,
        which is at most 1. A row composes the maps since its block began; a block's whole map is carried
        on like a sum. Within a run without a new start the map of a block is its product of factors and a sum of terms
        divided by the product so far, so blocks are short enough for that product to stay far from 0.
        """
        size = MOST_BLOCK if not 0 < least < 1 else max(1, min(MOST_BLOCK, int(math.log(LEAST_FACTOR) / math.log(least))))
        (f, nth, block, part, a, base) = _free(self.rows, "_f", "_nth", "_block", "_part", "_a", "_base")
        x = {out: f"_term{k}" for k, out in enumerate(terms)}
        rows = self.rows.withColumns({f: factor, **{x[o]: t for o, t in terms.items()}})
        rows = rows.withColumn(nth, F.row_number().over(self.inside())).withColumn(block, F.floor((F.col(nth) - 1) / size))
        in_block = Window.partitionBy(self.key, self.stretch, block).orderBy(nth).rowsBetween(Window.unboundedPreceding, 0)
        # a part is what follows a new start; its rows have no tie to what was before
        rows = rows.withColumn(part, F.sum((F.col(f) == 0).cast("int")).over(in_block))
        own = Window.partitionBy(self.key, self.stretch, block, part).orderBy(nth).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(a, F.exp(F.sum(F.when(F.col(f) > 0, F.log(f)).otherwise(0.0)).over(own)))
        composed = {o: F.col(a) * F.sum(F.col(x[o]) / F.col(a)).over(own) for o in terms}
        rows = rows.withColumns(composed).drop(f, *x.values())
        # factors are at most 1, so the least product of a block is that of all its rows
        ends = rows.groupBy(self.key, self.stretch, block).agg(F.when(F.max(part) > 0, 0.0).otherwise(F.min(a)).alias("_f"), *[F.max_by(o, nth).alias(o) for o in terms])
        before = _composed(ends, self.key, [self.stretch, block], list(terms))
        rows = rows.join(before.select(self.key, self.stretch, block, *[F.col(o).alias(f"{base}{k}") for k, o in enumerate(terms)]), [self.key, self.stretch, block])
        keep = F.when(F.col(part) == 0, F.col(a)).otherwise(0.0)
        rows = rows.withColumns({o: F.col(o) + keep * F.col(f"{base}{k}") for k, o in enumerate(terms)})
        self.rows = rows.drop(nth, block, part, a, *[f"{base}{k}" for k in range(len(terms))])
        return self

    def done(self) -> DataFrame:
        return self.rows.drop(self.key, self.stretch)


def _composed(maps: DataFrame, key: str, order: list[str], terms: list[str]) -> DataFrame:
    """``key, order, terms``: the values that the maps ``y = _f * y + term`` before each one give, from 0 on.

    There is one map for a block of rows. They are composed one after the other in arrays of a key's maps, which hold
    as many as the key has blocks: some thousand for ten million rows.
    """
    item = F.struct(*order, F.col("_f").alias("_f"), *terms)
    listed = maps.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("maps"))
    # runs of the root of the number of maps: the whole map of each run, then what is before it, then its own maps
    n = F.greatest(F.ceil(F.sqrt(F.size("maps").cast("double"))).cast("int"), F.lit(1))
    runs = listed.select(key, F.transform(F.sequence(F.lit(0), F.ceil(F.size("maps") / n).cast("int") - 1), lambda k: F.slice("maps", k * n + 1, n)).alias("runs"))

    def follow(y: Column, m: Column) -> Column:
        return F.struct(*[(m["_f"] * y[t] + m[t]).alias(t) for t in terms])

    def whole(y: Column, m: Column) -> Column:
        return F.struct((m["_f"] * y["_f"]).alias("_f"), *[(m["_f"] * y[t] + m[t]).alias(t) for t in terms])

    zero = F.struct(*[F.lit(0.0).alias(t) for t in terms])
    one = F.struct(F.lit(1.0).alias("_f"), *[F.lit(0.0).alias(t) for t in terms])
    runs = runs.select(key, "runs", F.transform("runs", lambda r: F.aggregate(r, one, whole)).alias("totals"))
    each = runs.select(key, "totals", F.posexplode("runs").alias("nth", "run"))
    each = each.select(key, "run", F.aggregate(F.slice("totals", 1, F.col("nth")), zero, follow).alias("start"))
    each = each.select(key, "run", "start", F.posexplode("run").alias("at", "map"))
    value = F.aggregate(F.slice("run", 1, F.col("at")), F.col("start"), follow)
    return each.select(key, *[F.col(f"map.{c}").alias(c) for c in order], value.alias("y")).select(key, *order, *[F.col(f"y.{t}").alias(t) for t in terms])
