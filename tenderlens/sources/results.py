"""Stored review results and knowledge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.operators import retrieval as rt

REVIEW = (
    "item_no string, route_type string, result string, is_target boolean, confidence double, evidence_pages array<int>, "
    "evidence_text array<string>, reason string, recommendation string, needs_human_review boolean, source string, warnings array<string>, used_llm boolean"
)
FINAL = (
    "item_no string, final_status string, final_result string, is_target boolean, confidence double, evidence_pages array<int>, evidence_text array<string>, "
    f"reason string, recommendation string, warnings array<string>, reviews array<struct<{', '.join(f.replace(' ', ':', 1) for f in REVIEW.split(', '))}>>"
)
HIT = "item_no string, source_type string, source_name string, title string, category string, snippet string, page_or_row string, score double"


def _struct(fields: str) -> str:
    out, depth, current = [], 0, ""
    for ch in fields:
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            out.append(current.strip())
            current = ""
        else:
            current += ch
    return "struct<" + ",".join(f.replace(" ", ":", 1) for f in [*out, current.strip()]) + ">"


#: What each result of scan_review_results reads of a payload; the parser passes by all other keys.
FINALS = f"document_id bigint, `group` string, merged_final_reviews array<{_struct(FINAL[: FINAL.index(', reviews')])}>"
REVIEWS = f"document_id bigint, merged_final_reviews array<struct<{FINAL[FINAL.index('reviews') :].replace(' ', ':', 1)}>>"
HITS = f"document_id bigint, item_results array<struct<item_no:string,rag_hits:array<{_struct(HIT)}>>>, merged_final_reviews array<struct<item_no:string>>"
ROUTES = "document_id bigint, item_results array<struct<item_no:string,route:string>>, merged_final_reviews array<struct<item_no:string>>"


def scan_review_results(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nested result files -> (final rows, review rows, hits, routes).  Unknown keys are dropped.

    Only payloads with a final-review list count.  Item 2 inherits hits and route of 2-1 when it has none.
    """

    def raw(schema: str) -> DataFrame:
        read = spark.read.schema(schema).option("multiLine", multi_line).json(path).withColumn("source_file", F.col("_metadata.file_name"))
        return read.filter("merged_final_reviews is not null").withColumn("document_id", F.coalesce("document_id", F.xxhash64("source_file")))

    def items(schema: str) -> DataFrame:
        return raw(schema).select("source_file", "document_id", F.explode("item_results").alias("i")).filter("i.item_no <> ''")

    final = raw(FINALS).select("source_file", "document_id", "group", F.posexplode("merged_final_reviews").alias("row_seq", "f")).select("source_file", "document_id", "group", "row_seq", "f.*")
    f = raw(REVIEWS).select("document_id", "source_file", F.explode("merged_final_reviews").alias("f"))
    reviews = f.select("document_id", "source_file", F.posexplode("f.reviews").alias("seq", "r")).select("document_id", "source_file", F.col("seq").cast("long").alias("seq"), "r.*")
    routes = items(ROUTES).select("source_file", "document_id", F.col("i.item_no").alias("item_no"), F.coalesce("i.route", F.lit("")).alias("route"))
    hits = items(HITS).select("source_file", "document_id", F.col("i.item_no").alias("query_item"), F.posexplode("i.rag_hits").alias("rank", "h")).select(
        "source_file", "document_id", "query_item", "rank", "h.*")
    return final, reviews, inherit_sub_item(hits, "query_item"), inherit_sub_item(routes, "item_no")


def inherit_sub_item(rows: DataFrame, column: str) -> DataFrame:
    """Rows of 2-1 stand in for item 2 where a file has none."""
    key = ["source_file", "document_id"]
    own = rows.filter(F.col(column) == "2").select(*key).distinct()
    return rows.unionByName(rows.filter(F.col(column) == "2-1").join(own, key, "left_anti").withColumn(column, F.lit("2")))


def result_payloads(final: DataFrame, hits: DataFrame, routes: DataFrame) -> DataFrame:
    """One nested JSON line per document, the stored form of a batch run.  A document has at most one row per item.

    Lines of documents with the same items stand together, so that a compressed file holds the hits they repeat about once.
    """
    fields = ["item_no", "final_status", "final_result", "is_target", "confidence", "evidence_pages", "evidence_text", "reason", "recommendation", "warnings"]
    packed = final.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("item_no", F.struct(*fields).alias("f")))).alias("_f"))
    hit_fields = ["item_no", "source_type", "source_name", "title", "category", "snippet", F.col("location").alias("page_or_row"), "score"]
    by_item = hits.filter("query_item is not null").groupBy("query_item").agg(F.array_sort(F.collect_list(F.struct("rank_group", "rank", F.struct(*hit_fields).alias("h")))).alias("_h"))
    # hits are of the rule book: they meet the items of a document in its own row and are not shuffled with it
    of_item = by_item.select(F.map_from_entries(F.collect_list(F.struct("query_item", F.transform("_h", lambda h: h["h"]))))).scalar()
    listed = routes.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("item_no", "route"))).alias("_i"))

    def with_hits(x: Column) -> Column:
        return tx.let(F.try_element_at("_of_item", x["item_no"]), lambda h: F.struct(
            x["item_no"].alias("item_no"), x["route"].alias("route"), F.size(h).alias("rag_hit_count"), h.alias("rag_hits")))

    joined = packed.join(listed, "document_id", "left").sortWithinPartitions("_i").withColumn("_of_item", of_item)
    return joined.select(
        "document_id", F.to_json(F.struct("document_id", F.lit("all").alias("group"), F.transform("_i", with_hits).alias("item_results"), F.transform("_f", lambda x: x["f"]).alias("merged_final_reviews"))).alias("line"))


def seed_knowledge(spark: SparkSession, rows: DataFrame, path: str) -> int:
    """Replace the knowledge table by `rows` and return how many there are."""
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).count()
