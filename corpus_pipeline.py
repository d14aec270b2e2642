"""From raw documents to token ids: quality, near duplicates, benchmark leaks, personal data, BPE.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the last return the
columns of ``docs``. :func:`run` writes each stage's result as Parquet in the shared folder and reads it again. Rows
are judged one by one: a row is known by a 64-bit hash of its id and text, so that rows of one id do not share a fate.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm import _common as C
from driftline.llm import bpe, decontam, ngram_join, pii, quality_bayes

#: Rows up to which a list of rows to drop is broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000


def _row(docs: DataFrame) -> Column:
    """What a row is known by; rows of equal id and text are equal."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_row(docs).alias("doc_id"), "text")


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` less the listed rows."""
    rows = C.bounded(rows.distinct(), "dropped", BROADCAST_ROWS)
    return docs.join(rows, _row(docs) == rows["row"], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the hierarchical classifier rejects."""
    verdict = C.fresh(docs, "quality_")
    found = quality_bayes.classify(docs, C.table(spark, sf_dir, "labels"), column=verdict)
    return found.where(f"{verdict}.kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked rows one row of the least id. Rows without words are in no group."""
    groups = ngram_join.jaccard_join(_keyed(docs)).where("n_shingles > 0").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    groups = C.materialize(groups, "groups")
    members = groups.distinct().join(docs.select(_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id")).distinct(), "row")
    least = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))["row"].alias("first"))
    kept = _without(docs, members.join(least, "component").where("row <> first").select("row"))
    # rows equal in id and text are one member; of those that stay only the one of least hash of all columns does
    again = C.bounded(groups.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"), "repeated", BROADCAST_ROWS)
    if again.isEmpty():
        return kept
    nth = C.fresh(docs, "nth")
    on = _row(kept) == again["row"]
    repeated = kept.join(again, on, "left_semi")
    once = repeated.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))).where(F.col(nth) == 1).drop(nth)
    return kept.join(again, on, "left_anti").unionByName(once)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, verbatim or with other values."""
    found = decontam.contaminated(_keyed(docs), C.table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select(F.col("doc_id").alias("row")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL cannot express the stages; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages on the documents of ``sf_dir``.

    With ``folder``, stages are written there under their names and stay; a run that was cut off takes up after the
    last stage that was written to its end. Without it, a stage's table goes once the next one is written.
    """
    docs = C.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        if folder:
            if not C.is_written(spark, path):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
        else:
            before, docs = docs, C.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            C.release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
