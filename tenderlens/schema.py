"""Schemas of the tables that operators exchange."""

from pyspark.sql import types as T

PAGE_FLAGS = ["has_table", "has_attachment", "has_eval_table", "has_toc", "has_blind", "has_commercial_sw"]

PAGE = T.StructType(
    [
        T.StructField("document_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("page_text", T.StringType()),
        T.StructField("text_length", T.IntegerType()),
        T.StructField("printed_page_no", T.IntegerType()),
        *[T.StructField(flag, T.BooleanType()) for flag in PAGE_FLAGS],
        T.StructField("parser_warning", T.StringType()),
    ]
)

DOCUMENT = T.StructType(
    [
        T.StructField("document_id", T.LongType()),
        T.StructField("document_name", T.StringType()),
        T.StructField("total_pages", T.IntegerType()),
    ]
)

AUDIT_WARNING = T.StructType(
    [
        T.StructField("document_id", T.LongType()),
        T.StructField("phase", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("kind_no", T.IntegerType()),
        T.StructField("warning_type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("severity", T.StringType()),
        T.StructField("related_item_nos", T.ArrayType(T.StringType())),
    ]
)

REVIEW = T.StructType(
    [
        T.StructField("document_id", T.LongType()),
        T.StructField("item_no", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("route_type", T.StringType()),
        T.StructField("result", T.StringType()),
        T.StructField("is_target", T.BooleanType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("evidence_pages", T.ArrayType(T.IntegerType())),
        T.StructField("evidence_text", T.ArrayType(T.StringType())),
        T.StructField("reason", T.StringType()),
        T.StructField("recommendation", T.StringType()),
        T.StructField("needs_human_review", T.BooleanType()),
        T.StructField("source", T.StringType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("used_llm", T.BooleanType()),
    ]
)

FINAL_REVIEW = T.StructType(
    [
        T.StructField("document_id", T.LongType()),
        T.StructField("item_no", T.StringType()),
        T.StructField("final_status", T.StringType()),
        T.StructField("final_result", T.StringType()),
        T.StructField("is_target", T.BooleanType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("evidence_pages", T.ArrayType(T.IntegerType())),
        T.StructField("evidence_text", T.ArrayType(T.StringType())),
        T.StructField("reason", T.StringType()),
        T.StructField("recommendation", T.StringType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)

HIT = T.StructType(
    [
        T.StructField("query_item", T.StringType()),
        T.StructField("rank_group", T.IntegerType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("item_no", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)
