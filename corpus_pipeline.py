"""From raw documents to token ids: quality rules, near duplicates, contamination, personal data, byte-level BPE."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.llm import bpe, contamination, line_quality, near_dup, personal_data
from tenderlens.llm.common import delete_paths, key_filter, may_hold, owning, read_table, stage
from tenderlens.llm.queries import vocabulary


#: Folders of the stage that ran last; its result is written when the next stage begins.
_LEFT: list[str] = []


def _owner(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage owns what it stages: as its result is written and reread before the next stage begins, that one deletes it."""

    @functools.wraps(step)
    def owned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_paths(spark, _LEFT)
        with owning(_LEFT):
            return step(spark, docs, sf_dir)

    return owned


def _whole_rows(docs: DataFrame) -> DataFrame:
    """Each row as one value beside its text, so that a verdict comes back with the row and nothing is joined."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


@_owner
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    field = line_quality.fit_field(docs, read_table(spark, sf_dir, "labels"))
    return line_quality.judge_documents(_whole_rows(docs), field, key="row").where("kept").select("row.*")


@_owner
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: the one with the smallest id, of rows without an id only if no other has one.

    Rows are told apart by their places in the files of `docs` (written first if they are in none), so rows that repeat an id or
    have none are judged one by one, and of equal rows the first stays. All columns stay as they are; none of theirs clashes with
    one of this stage, as a row is one value here. Only rows that may go are moved.
    """
    numbered = _placed(docs)
    if numbered is None:
        numbered = _placed(stage(docs, "rows"))
    keyed = numbered.select(F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("doc_id"), "number").alias("key"), F.col("row.text").alias("text"))
    gone = stage(near_dup.near_duplicates(keyed, key="key").where("NOT kept").select("key.number"), "gone")
    may_go = may_hold(key_filter(gone, "number"), "number")
    return numbered.where(~may_go).union(numbered.where(may_go).join(gone, "number", "left_anti").select(*numbered.columns)).select("row.*")


def _placed(docs: DataFrame) -> DataFrame | None:
    """Each row as one value with its place in its file; None if the rows come from no files."""
    try:
        file = docs.metadataColumn("_metadata")
        number = F.struct(F.xxhash64(file["file_path"]).alias("file"), file["row_index"].alias("place"))
        return docs.select(F.struct(*docs.columns).alias("row"), number.alias("number"))
    except AnalysisException:
        return None


@_owner
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no more of the benchmark than the contract allows."""
    found = contamination.find_contamination(_whole_rows(docs), read_table(spark, sf_dir, "benchmark"), key="row")
    return found.where("NOT contaminated").select("row.*")


@_owner
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced in their texts, n_chars that of the new text."""
    return personal_data.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


@_owner
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, *vocabulary())


STAGES = [("quality", quality), ("near_dup", deduplicate), ("decontaminate", decontaminate), ("personal_data", redact), ("bpe", encode)]

#: Neither Viterbi decoding nor byte-level BPE can be put in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)  # not the stage's own: the next one reads it
    return STAGES[-1][1](spark, docs, sf_dir)
