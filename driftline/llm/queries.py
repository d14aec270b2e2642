"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import bpe, chat, ctw, decontam, merkle, ngram_join, packing, pii, quality_bayes, rules, token_count, token_file, whitening

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(C.table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), with_ids=False)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_bayes.classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return found.select("doc_id", "quality_.*")


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{C.shared_dir(spark)}/driftline/token-file-{uuid.uuid4().hex}"
    token_file.write_token_file(C.table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), path)
    C.drop_at_exit(spark, path)
    return token_file.digest_token_file(spark, path)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(C.table(spark, sf_dir, "documents"))


def op6_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(C.table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts are control strings, formatted and read back.

    A table that has a conversation -1 itself gives one conversation with the turns of both, in the order of ``turn``,
    then of role and text, as rows of one id always do.
    """
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_conversations(C.materialize(chat.format_conversations(turns), "chat-parts"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(C.table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(C.table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(C.table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "whitening_.*")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the crc32 of the id is even, the folded leaf is that of the row without its line feeds."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.merkle_manifest(C.table(spark, sf_dir, "documents"), changed={"text": tampered}).drop("proof")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(C.table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), with_ids=False)


_QUERIES = (
    op1_decontaminate, op2_bpe, op3_quality, op4_token_file, op5_jaccard_join,
    op6_ctw, op7_chat, op8_quality_rules, op9_token_counts, op10_personal_data,
    op11_whitening, op12_merkle, op13_packing,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op8_quality_rules": rules.oracle()}
