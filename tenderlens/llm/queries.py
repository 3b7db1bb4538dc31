"""Registered queries of the subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, contamination, hard_negatives, language_id, language_model, line_quality, near_dup, personal_data, secret_scan, templates, token_files
from .common import read_table, stage_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"
#: Closes each document in token files.
END_ID = 2


def remainder(key: str, by: int):
    return F.crc32(F.col(key).cast("string").cast("binary")) % by


def vocabulary(name: str = VOCABULARY) -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(remainder("doc_id", 3) != 1))
    return language_id.predict_languages(docs, model).withColumn("held_out", remainder("doc_id", 3) == 1)


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("train", remainder("doc_id", 5) != 1)
    return language_model.score_documents(docs).withColumn("held_out", remainder("doc_id", 5) == 1)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.list_personal_data(*personal_data.find_personal_data(read_table(spark, sf_dir, "documents")))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract_pages(read_table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), *vocabulary())


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), size=4)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"), *vocabulary())


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return line_quality.judge_documents(docs, line_quality.fit_field(docs, read_table(spark, sf_dir, "labels")))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2 k and 2 k + 1 are a pair; the even one is the chosen one."""
    turns = read_table(spark, sf_dir, "conversations")
    return chat.format_preferences(turns, F.expr("conv_id DIV 2"), F.expr("conv_id % 2 = 0"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(WORD_VOCABULARY), encoding="utf-8") as f:
        definition = f.read()
    path = stage_path(spark, "tokens")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path, definition, END_ID)
    return token_files.read_token_files(spark, path)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 100th row is an anchor; every 7th row has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_lm_scores": op2_lm_scores,
    "op3_personal_data": op3_personal_data,
    "op4_main_text": op4_main_text,
    "op5_bpe": op5_bpe,
    "op6_near_dup": op6_near_dup,
    "op7_secrets": op7_secrets,
    "op8_contamination": op8_contamination,
    "op9_quality": op9_quality,
    "op10_preferences": op10_preferences,
    "op11_token_files": op11_token_files,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {"op10_preferences": chat.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_collocations": collocations.ORACLE}
