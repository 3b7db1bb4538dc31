"""Page normalisation: numbering, de-duplication, replacement, page selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.operators import blocks, classify
from tenderlens.schema import PAGE_FLAGS
from tenderlens.session import cut_lineage

KEY = ["document_id"]
PAGE_KEY = ["document_id", "page_no"]


def fill_printed_page_no(page: DataFrame) -> DataFrame:
    """Missing printed numbers follow the anchor offset of least size that keeps the number positive.

    Page numbers start at 1, so of all the offsets of a document only two can ever be chosen: the smallest that
    is not negative and the negative one nearest to zero.  Both are plain minima.
    """
    anchors = page.filter(F.col("printed_page_no").isNotNull()).groupBy(*PAGE_KEY).agg(
        F.min("seq").alias("seq"), F.max_by("printed_page_no", "seq").alias("printed")
    )
    off = (F.col("printed") - F.col("page_no")).alias("off")
    best = (
        anchors.select("document_id", "seq", off)
        .groupBy("document_id")
        .agg(
            F.min(F.when(F.col("off") >= 0, F.struct(F.abs("off").alias("size"), "seq", "off"))).alias("_up"),
            F.min(F.when(F.col("off") < 0, F.struct(F.abs("off").alias("size"), "seq", "off"))).alias("_down"),
        )
    )
    usable_down = F.when(F.col("page_no") + F.col("_down.off") > 0, F.col("_down"))
    chosen = F.least(F.col("_up"), usable_down)
    return (
        page.join(best, "document_id", "left")
        .withColumn("printed_page_no", F.coalesce("printed_page_no", F.col("page_no") + chosen["off"]))
        .drop("_up", "_down")
    )


def page_quality() -> Column:
    return F.struct(
        F.coalesce(F.length("parser_warning") == 0, F.lit(True)).cast("int").alias("clean"),
        F.col("has_table").cast("int").alias("table"),
        (F.col("has_attachment") | F.col("has_eval_table")).cast("int").alias("form"),
        F.col("text_length").alias("length"),
        (-F.col("seq")).alias("early"),
    )


def dedupe_pages(page: DataFrame) -> DataFrame:
    """Best row per page, the first on ties.

    Page text is not shuffled for it: the winners of repeated pages are found on narrow columns, and the page
    rows are joined only against those.
    """
    repeated = (
        page.groupBy(*PAGE_KEY)
        .agg(F.count(F.lit(1)).alias("_n"), F.max(page_quality()).alias("_best"))
        .filter(F.col("_n") > 1)
        .select(*PAGE_KEY, (-F.col("_best.early")).alias("_keep"))
    )
    return (
        page.join(repeated, PAGE_KEY, "left")
        .filter(F.col("_keep").isNull() | (F.col("_keep") == F.col("seq")))
        .drop("_keep")
    )


def normalise_for_store(page: DataFrame) -> DataFrame:
    """Stored form of a page: no leading page number in the text, length recomputed."""
    return page.withColumn(
        "page_text", tx.strip_leading_page_no(F.col("page_text"), F.col("printed_page_no"))
    ).withColumn("text_length", tx.text_length(F.col("page_text")))


def document_status(page: DataFrame) -> DataFrame:
    """Warning count and status of each document after import or replacement."""
    has_warning = F.coalesce(F.length("parser_warning") > 0, F.lit(False))
    return (
        page.groupBy("document_id")
        .agg(F.count(F.lit(1)).alias("page_count"), F.count_if(has_warning).alias("parse_warning_count"))
        .withColumn("parse_status", F.when(F.col("parse_warning_count") > 0, "warning").otherwise("ok"))
    )


def import_pages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coerced rows -> (documents, pages) in stored form."""
    filled = fill_printed_page_no(raw)
    page = normalise_for_store(classify.infer_table_pages(filled))
    return document_status(page), page


def replace_pages(page: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overwrite the given pages of known documents -> (pages, documents, rejected replacement rows)."""
    repeated = new.groupBy(*PAGE_KEY).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    known = page.select("document_id").distinct()
    unknown = new.join(known, "document_id", "left_anti").withColumn("reject_reason", F.lit("unknown_document"))
    twice = new.join(repeated, PAGE_KEY, "left_semi").join(known, "document_id", "left_semi").withColumn(
        "reject_reason", F.lit("duplicate_page")
    )
    valid = cut_lineage(new.join(repeated, PAGE_KEY, "left_anti").join(known, "document_id", "left_semi"))  # read several times
    valid = normalise_for_store(classify.infer_table_pages(valid)).select(*page.columns)
    touched = page.join(valid.select(*PAGE_KEY), PAGE_KEY, "left_anti").unionByName(valid)
    return touched, document_status(touched), unknown.unionByName(twice)


def merge_repaired_pages(page: DataFrame, repaired: DataFrame) -> DataFrame:
    """Repaired rows stand in for the originals by page number, new ones are added, best row per page."""
    old_keys = page.select(*PAGE_KEY).distinct()
    latest = repaired.groupBy(*PAGE_KEY).agg(F.max("seq").alias("_last"))
    replacing = repaired.join(old_keys, PAGE_KEY, "left_semi").join(latest, PAGE_KEY)
    replacing = replacing.filter(F.col("seq") == F.col("_last")).drop("_last")
    added = repaired.join(old_keys, PAGE_KEY, "left_anti")
    kept = page.join(repaired.select(*PAGE_KEY), PAGE_KEY, "left_anti")
    return dedupe_pages(kept.unionByName(replacing.select(*page.columns)).unionByName(added.select(*page.columns)))


# --- page selections ------------------------------------------------------------------------------


def _ranges(df: DataFrame, spec: str) -> DataFrame:
    parts = df.select("*", F.posexplode(F.split(F.col(spec), ",")).alias("part_no", "_part"))
    parts = parts.withColumn("_part", tx.strip(F.col("_part"))).filter("_part <> ''")
    pair = F.split("_part", "-", 2)
    return parts.withColumn("_from", F.trim(pair[0]).try_cast("int")).withColumn(
        "_to", F.coalesce(F.trim(F.try_element_at(pair, F.lit(2))).try_cast("int"), F.col("_from"))
    )


def expand_page_spec(df: DataFrame, spec: str = "page_spec") -> DataFrame:
    """"5-3,12" -> rows in written order, descending ranges kept."""
    rows = _ranges(df, spec).select(
        *df.columns, "part_no", F.posexplode(F.sequence("_from", "_to")).alias("offset", "page_no")
    )
    return rows


def expand_page_set(df: DataFrame, spec: str = "page_spec") -> DataFrame:
    """Sorted-set variant: descending ranges are empty, every page once."""
    rows = _ranges(df, spec).filter(F.col("_from") <= F.col("_to"))
    return rows.select(*df.columns, F.explode(F.sequence("_from", "_to")).alias("page_no")).distinct()


SPAN = 65536


def all_pages(df: DataFrame, total: str = "total_pages") -> DataFrame:
    """One row per page of each document, generated in spans so that no huge array is built."""
    spans = df.withColumn(
        "_start",
        F.explode(F.when(F.col(total) > 0, F.sequence(F.lit(1), F.col(total).cast("int"), F.lit(SPAN))).otherwise(
            F.array().cast("array<int>"))),
    )
    return spans.withColumn(
        "page_no", F.explode(F.sequence("_start", F.least(F.col("_start") + (SPAN - 1), F.col(total).cast("int"))))
    ).drop("_start")


def normalize_page_selection(jobs: DataFrame) -> DataFrame:
    """Stored JSON selection -> in-range distinct pages; all pages when empty or without a valid member."""
    listed = (
        jobs.select("job_id", "total_pages", F.explode(F.from_json("selected_pages", "array<int>")).alias("page_no"))
        .filter("page_no between 1 and total_pages")
        .select("job_id", "page_no")
        .distinct()
    )
    unlisted = jobs.join(listed, "job_id", "left_anti").select("job_id", "total_pages")
    return listed.unionByName(all_pages(unlisted).select("job_id", "page_no"))


def chunk_pages(selected: DataFrame, size: int, key: str = "document_id") -> DataFrame:
    """Chunk number of each requested page: groups of `size` pages in page order."""
    placed = blocks.position_in_document(selected, [key], "page_no", ["page_no"])
    return placed.withColumn("chunk_no", F.floor((F.col("position") - 1) / F.lit(size)).cast("long"))


def reconcile_page_no(requested: Column, reported: Column) -> Column:
    """Array of effective page numbers for the items of one response.

    `requested` and `reported` are arrays of one call, whose size the caller bounds; a reported number that was
    not requested or was already used gives way to the requested number at the same place, or the last one.
    """
    count = F.size(requested)
    state = F.struct(F.lit(0).alias("i"), F.array().cast("array<int>").alias("used"))

    def step(acc: Column, raw: Column) -> Column:
        own = F.element_at(requested, F.least(acc["i"] + 1, count))
        asked = tx.strict_int(raw)
        valid = F.array_contains(requested, asked) & ~F.array_contains(acc["used"], asked)
        page = F.when(asked.isNotNull() & valid, asked).otherwise(own)
        return F.struct((acc["i"] + 1).alias("i"), F.array_append(acc["used"], page).alias("used"))

    return F.aggregate(reported, state, step, lambda acc: acc["used"])


def missing_pages(requested: DataFrame, returned: DataFrame, key: str = "document_id") -> DataFrame:
    return requested.select(key, "page_no").distinct().join(returned.select(key, "page_no"), [key, "page_no"], "left_anti")


def effective_pages(responses: DataFrame) -> DataFrame:
    """Page of each response item: the request list, else the reported numbers if distinct, else the file name.

    Input: response_id, file_name, requested array<string>, reported array<string>.
    """
    as_ints = lambda c: F.transform(c, lambda v: tx.strict_int(v))
    whole = lambda c: F.when(c.isNotNull() & F.forall(c, lambda v: v.isNotNull()), c)
    asked = whole(as_ints(F.col("requested")))
    told = whole(as_ints(F.col("reported")))
    told = F.when((F.size(told) > 0) & (F.size(F.array_distinct(told)) == F.size(told)), told)
    numbers = F.regexp_extract_all("file_name", F.lit("([0-9]+)(?=[_.])"), F.lit(1))
    start = F.try_element_at(numbers, F.lit(1)).cast("int")
    stop = F.element_at(numbers, F.size(numbers)).cast("int")
    from_name = F.when((start > 0) & (stop >= start), F.sequence(start, stop)).otherwise(F.array().cast("array<int>"))
    pages = responses.withColumn("_pages", F.coalesce(asked, told, F.when(F.size(numbers) > 0, from_name)))
    items = pages.select("response_id", "_pages", F.posexplode("reported").alias("item_index", "reported_page_no"))
    effective = F.try_element_at("_pages", F.least(F.col("item_index") + 1, F.size("_pages")))
    return items.select(
        "response_id", "item_index", "reported_page_no",
        F.when(F.size("_pages") > 0, effective).alias("effective_page_no"),
    )
