"""Exact percentiles of groups of any size.

``percentile`` keeps all different values of a group in one buffer. Here values are counted, put in order over all
partitions by ranges, and a percentile is looked up in the one partition that holds its rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import drop_table, shared_table


def exact_percentiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """``by`` and a column for each name in ``wanted``, with the percentile interpolated between its neighbours.

    Null and NaN values do not count; a group without others has no row, and without ``by`` an empty table has none.
    A value that many rows share is counted before it is shuffled.
    """
    spark = df.sparkSession
    rows = df.select(*[F.col(c).alias(f"b{k}") for k, c in enumerate(by)], F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    keys = [f"b{k}" for k in range(len(by))]
    # one text for all columns of a group, in which nulls are equal
    rows = rows.withColumn("g", F.to_json(F.struct(*keys)) if keys else F.lit(""))
    counts = rows.groupBy("g", *keys, "v").agg(F.count("*").alias("n"))
    ordered = counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id())
    table = shared_table(spark, ordered, "ordered-values")  # a partition's number holds from here on
    own = Window.partitionBy("g")
    parts = table.groupBy("g", *keys, "part").agg(F.sum("n").alias("n"))  # a row for each partition and group in it
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"base": before, "total": F.sum("n").over(own)})
    places = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("total") - 1) * float(q)).alias("at")) for name, q in wanted.items()])
    ranks = parts.select("g", *keys, "part", "base", "n", F.explode(places).alias("x")).select("g", *keys, "part", "base", "n", "x.*")
    ranks = ranks.select("g", *keys, "part", "base", "n", "name", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    ranks = ranks.where((F.col("rank") >= F.col("base")) & (F.col("rank") < F.col("base") + F.col("n"))).select("g", *keys, "part", "name", "at", "rank", (F.col("rank") - F.col("base")).alias("inner"))
    held = table.join(F.broadcast(ranks.select("g", "part").distinct()), ["g", "part"], "left_semi")  # at most two partitions for each percentile
    upto = F.sum("n").over(Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    held = held.select("g", "part", "v", "n", upto.alias("upto"))
    met = ranks.join(held, ["g", "part"]).where((F.col("inner") < F.col("upto")) & (F.col("inner") >= F.col("upto") - F.col("n")))
    found = met.groupBy("g", *keys, "name", "at").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    found = found.select("g", *keys, "name", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("v"))
    wide = found.groupBy("g", *keys).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in wanted])
    out = shared_table(spark, wide.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *wanted), "percentiles")
    drop_table(table)
    return out
