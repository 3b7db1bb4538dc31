"""Page sources and sinks: stored tables, JSON lines, raw extraction responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.operators import classify, pages
from tenderlens.operators.external import outer_object
from tenderlens.schema import PAGE_FLAGS

PARSER_VERSION = "page-table-v1"
# Flag names in exchanged JSON.
JSON_FLAGS = {
    "has_table": "has_table_candidate", "has_attachment": "has_attachment_candidate", "has_eval_table": "has_eval_table_candidate",
    "has_toc": "has_toc_candidate", "has_blind": "has_blind_candidate", "has_commercial_sw": "has_commercial_sw_candidate",
}
LINE = "document_id bigint, page_no int, page_text string, text_length int, rfp_printed_page_no string, parser_warning string, " + ", ".join(
    f"{name} boolean" for name in JSON_FLAGS.values()
)
TABLE_MARK = "\n\n[표 추출]\n"


#: What a page row is found by; a document's pages are spread over the buckets of a page store by it.
STORE_KEY = ["document_id", "page_no", "seq"]


def store_pages(page: DataFrame, table: str, path: str, buckets: int = 200) -> DataFrame:
    """Write pages as a table in buckets of their key and read it again.

    Narrow rows that are joined to it by page (STORE_KEY) are dealt like its buckets; the page rows, with their text, stay where they are.
    No document lies in one bucket, however many pages it has.  state.store_by_bucket is the store to read some documents of.
    """
    page.write.format("parquet").mode("overwrite").option("path", path).bucketBy(buckets, *STORE_KEY).saveAsTable(table)
    return page.sparkSession.table(table)


def scan_pages(page: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of the wanted documents, and the wanted ids that have no page."""
    ids = wanted.select("document_id").distinct()
    return page.join(ids, "document_id", "left_semi"), ids.join(page.select("document_id"), "document_id", "left_anti")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows in {what}")
    return df


def scan_candidate_jsonl(spark: SparkSession, path: str, keep_length: bool = True) -> DataFrame:
    """One JSON page per line: byte-order mark and blank lines tolerated, defaults for missing keys.

    Lines without a document id belong to a document named by their file.  Missing printed numbers are filled.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\\uFEFF", "").alias("line"), F.col("_metadata.file_path").alias("file"))
    rows = require_rows(lines.filter(tx.strip(F.col("line")) != ""), path).select("file", "line", F.from_json("line", LINE).alias("p"))
    text = F.coalesce("p.page_text", F.lit(""))
    # A JSON number is taken as it is, a text by its first run of digits.
    number = F.regexp_extract("line", '(?<!\\\\)"rfp_printed_page_no"\\s*:\\s*(-?[0-9]+)\\s*[,}]', 1).try_cast("int")
    printed = F.coalesce(number, tx.first_int(F.col("p.rfp_printed_page_no")))
    counted = F.coalesce(F.nullif("p.text_length", F.lit(0)), tx.text_length(text))
    page = rows.select(
        F.coalesce("p.document_id", F.xxhash64("file")).alias("document_id"), F.col("p.page_no").cast("long").alias("seq"), F.col("p.page_no").alias("page_no"), text.alias("page_text"),
        (F.coalesce("p.text_length", F.lit(0)) if keep_length else counted).alias("text_length"), printed.alias("printed_page_no"),
        *[F.coalesce(f"p.{name}", F.lit(False)).alias(flag) for flag, name in JSON_FLAGS.items()], F.col("p.parser_warning").alias("parser_warning"),
    )
    return pages.fill_printed_page_no(page)


def page_lines(page: DataFrame) -> DataFrame:
    """(document_id, line): each page as one JSON line."""
    fields = [
        "document_id", "page_no", "page_text", "text_length", F.col("printed_page_no").alias("rfp_printed_page_no"), "parser_warning",
        *[F.col(flag).alias(name) for flag, name in JSON_FLAGS.items()],
    ]
    return page.select("document_id", F.to_json(F.struct(*fields)).alias("line"))


def export_pages(page: DataFrame, document: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page rows with source and requirement-table flag, one meta row per document)."""
    c = tx.compact(F.col("page_text"))
    rows = page.join(sources.select("document_id", "page_no", "source"), ["document_id", "page_no"], "left").withColumn(
        "source", F.coalesce("source", F.lit(""))).withColumn("has_requirement_table", classify.requirement_table(c))
    return rows, document.select("document_id", "document_name", "total_pages", F.lit(PARSER_VERSION).alias("parser_version"))


def write_bundle(page: DataFrame, document: DataFrame, sources: DataFrame, path: str) -> None:
    """Pages as JSON lines and the meta table, under one folder."""
    rows, meta = export_pages(page, document, sources)
    page_lines(rows).select("line").write.mode("overwrite").text(f"{path}/pages")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


ITEM = (
    "array<struct<pdf_page_no:string,page_no:string,page_text:string,tables_markdown:string,rfp_printed_page_no:string,parser_warning:string,"
    + ",".join(f"{n}:boolean" for n in JSON_FLAGS.values()) + ">>"
)
BODY = f"pages {ITEM}, output_schema struct<pages:{ITEM}>, result struct<pages:{ITEM}>"


def scan_page_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw responses (document_id, response_id, requested array<int>, output_text) -> (pages, parse errors).

    Items come as `pages`, `output_schema.pages` or `result.pages`; page numbers are reconciled with the request.
    """
    # exploded as arrays of one, so that no filter takes the parsing along and a response is parsed once
    cut = responses.select("document_id", "response_id", "requested", F.explode(F.array(outer_object(F.col("output_text")))).alias("_body"))
    body = F.col("_body")
    parsed = cut.select("*", F.explode(F.array(F.from_json(body, BODY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))).alias("_b"))
    valid = (body != "") & F.col("_b").isNotNull() & F.try_parse_json(body).isNotNull()
    errors = parsed.filter(~valid).select("document_id", "response_id", F.lit("json_parse_failed").alias("error"))
    items = F.coalesce("_b.pages", "_b.output_schema.pages", "_b.result.pages")
    good = parsed.filter(valid).withColumn("_items", items).filter(F.size("_items") > 0)
    told = F.transform("_items", lambda i: F.coalesce(i["pdf_page_no"], i["page_no"]))
    numbered = good.withColumn("_no", pages.reconcile_page_no(F.col("requested"), told))
    one = numbered.select("document_id", "response_id", F.posexplode(F.arrays_zip("_items", "_no")).alias("k", "z"))
    i = F.col("z._items")
    text, table = tx.strip(i["page_text"]), tx.strip(i["tables_markdown"])
    joined = F.when(table != "", tx.strip(F.concat(text, F.lit(TABLE_MARK), table))).otherwise(text)
    rows = one.select(
        "document_id", (F.shiftleft(F.col("response_id").cast("long"), 32) + F.col("k")).alias("seq"), F.col("z._no").alias("page_no"), joined.alias("page_text"),
        tx.first_int(i["rfp_printed_page_no"]).alias("printed_page_no"), *[F.coalesce(i[n], F.lit(False)).alias(f) for f, n in JSON_FLAGS.items()], i["parser_warning"].alias("parser_warning"),
    )
    return rows.withColumn("text_length", tx.text_length(F.col("page_text"))), errors
