"""Page classification: what kind of page a text is, and which pages need the costly extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.operators import blocks
from tenderlens.rules import pack
from tenderlens.schema import PAGE_FLAGS


def table_block(text: Column) -> Column:
    return text.contains(pack.TABLE_MARKER) | text.rlike(f"(?m)^[{tx.SPACE}]*\\|.+\\|[{tx.SPACE}]*$")


def table_like(compact: Column) -> Column:
    return reduce(lambda a, b: a | b, [tx.contains_all(compact, group) for group in pack.TABLE_LIKE])


def table_continuation(text: Column, compact: Column) -> Column:
    labels = F.regexp_count(text, F.lit(f"(?m)^[{tx.SPACE}]*[가-힣]{{1,4}}[{tx.SPACE}]*$"))
    return (labels >= 2) & (tx.count_terms(compact, pack.CONTINUATION_TERMS) >= 3)


def infer_table_pages(page: DataFrame) -> DataFrame:
    """Carry the table flag over following continuation pages until a page breaks the run.

    Only continuation pages depend on their neighbours; they are settled on narrow rows and joined back.
    """
    text = tx.text_or_empty(F.col("page_text"))
    compact = tx.compact(F.col("page_text"))
    seed = F.col("has_table") | table_block(text) | table_like(compact)
    narrow = page.select(
        "document_id", "page_no", "seq", seed.alias("_seed"), table_continuation(text, compact).alias("_cont")
    )
    place = F.struct("page_no", "seq")
    state = blocks.running_max(
        narrow,
        ["document_id"],
        "page_no",
        ["page_no", "seq"],
        {
            "_last_seed": F.when(F.col("_seed"), place),
            "_last_break": F.when(~F.col("_seed") & ~F.col("_cont"), place),
        },
    )
    carried = state.filter(
        ~F.col("_seed")
        & F.col("_cont")
        & F.col("_last_seed").isNotNull()
        & (F.col("_last_break").isNull() | (F.col("_last_seed") > F.col("_last_break")))
    ).select("document_id", "page_no", "seq", F.lit(True).alias("_carried"))
    return (
        page.join(carried, ["document_id", "page_no", "seq"], "left")
        .withColumn("has_table", seed | F.coalesce("_carried", F.lit(False)))
        .drop("_carried")
        .select(*page.columns)
    )


# --- prescan ------------------------------------------------------------------------------------------


def clean_lines(text: Column) -> Column:
    """Lines trimmed, blank lines dropped."""
    lines = F.transform(F.split(tx.text_or_empty(text), "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"), tx.strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def requirement_table(compact: Column) -> Column:
    return tx.count_terms(compact, pack.REQUIREMENT_HEADERS) >= 2


def eval_table(compact: Column) -> Column:
    return tx.contains_any(compact, pack.EVAL_HEADERS)


def layout_table(text: Column, compact: Column) -> Column:
    return (
        (F.length(text) - F.length(F.translate(text, "|", "")) >= 4)
        | (F.regexp_count(text, F.lit(f"[{tx.SPACE}]{{2,}}")) >= 12)
        | tx.contains_any(compact, pack.PRESCAN_TABLE_TERMS)
    )


def navigation_page(compact: Column) -> Column:
    return (F.length(compact) <= 80) & (
        tx.contains_any(compact, pack.SECTION_TITLES) | compact.rlike(pack.NAVIGATION_NUMBER)
    )


def noise_ratio(compact: Column) -> Column:
    return (F.length(compact) - F.length(F.translate(compact, "?�", ""))) / F.greatest(F.length(compact), F.lit(1))


def noisy(compact: Column) -> Column:
    return (F.length(compact) == 0) | (noise_ratio(compact) > 0.03)


def review_relevant(compact: Column) -> Column:
    return tx.contains_any(compact, pack.REVIEW_TERMS)


def legal_or_security(compact: Column) -> Column:
    return tx.contains_any(compact, pack.LEGAL_TERMS)


def dense_layout(text: Column, compact: Column) -> Column:
    groups = reduce(lambda a, b: a | b, [tx.contains_all(compact, group) for group in pack.DENSE_GROUPS])
    return groups | (F.regexp_count(text, F.lit(pack.EMAIL)) >= 2)


def prescan(page: DataFrame) -> DataFrame:
    """Cleaned text with the flags that plain text alone supports."""
    cleaned = page.withColumn("page_text", clean_lines(F.col("page_text"))).withColumn(
        "_compact", tx.compact(F.col("page_text"))
    )
    compact, text = F.col("_compact"), F.col("page_text")
    evaluation = eval_table(compact)
    return (
        cleaned.withColumn("text_length", F.length(compact))
        .withColumn("has_requirement_table", requirement_table(compact))
        .withColumn("has_eval_table", evaluation)
        .withColumn("has_table", F.col("has_requirement_table") | F.col("has_eval_table") | layout_table(text, compact))
        .withColumn("has_attachment", tx.contains_any(compact, pack.ATTACHMENT_MARKERS))
        .withColumn("has_toc", tx.contains_any(compact, pack.TOC_MARKERS))
    )


def hard_page_reason() -> Column:
    """Why a prescanned page needs the costly extraction; null when its text is good enough."""
    compact, text = F.col("_compact"), F.col("page_text")
    return (
        F.when(navigation_page(compact), F.lit(None).cast("string"))
        .when(F.col("text_length") < 120, "short_or_image_heavy_page")
        .when(noisy(compact), "suspicious_text_noise")
        .when(review_relevant(compact), "review_relevant_keyword_page")
        .when(F.col("has_table"), "table_or_requirement_page")
        .when(dense_layout(text, compact), "dense_layout_table_candidate")
        .when(legal_or_security(compact), "legal_or_security_keyword_page")
    )


def triage_pages(page: DataFrame) -> DataFrame:
    """Prescanned pages with `needs_extraction`, `triage_reason` and the matching parser warning."""
    scanned = prescan(page).withColumn("_reason", hard_page_reason())
    return (
        scanned.withColumn("needs_extraction", F.col("_reason").isNotNull())
        .withColumn("triage_reason", F.coalesce("_reason", F.lit("python_text_good_enough")))
        .withColumn("parser_warning", F.concat(F.lit("python_prescan_needs_gpt: "), F.col("_reason")))
        .drop("_reason", "_compact")
    )


# --- audit predicates ----------------------------------------------------------------------------------


def index_page(text: Column, compact: Column) -> Column:
    numbered = F.regexp_count(text, F.lit(f"(?:별첨|붙임|서식)[{tx.SPACE}]*[0-9]+"))
    marker = tx.contains_any(compact, pack.ATTACHMENT_MARKERS)
    return marker & ((numbered >= 2) | compact.contains("목차"))


def script_noise(text: Column) -> Column:
    found = F.regexp_count(text, F.lit(pack.SCRIPT_NOISE))
    return (found >= 2) | ((found > 0) & (found / F.greatest(F.length(text), F.lit(1)) >= 0.005))


def apply_flag_overrides(page: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides: document_id, page_no, seq and three nullable flags; the last given value wins."""
    names = ["has_table", "has_eval_table", "has_attachment"]
    latest = overrides.groupBy("document_id", "page_no").agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("seq"))).alias(f"_{n}") for n in names]
    )
    joined = page.join(latest, ["document_id", "page_no"], "left")
    for n in names:
        joined = joined.withColumn(n, F.coalesce(f"_{n}", n))
    return joined.drop(*[f"_{n}" for n in names]).select(*page.columns)


def flag_counts(page: DataFrame) -> DataFrame:
    """Counts per document; the page lists themselves are rows of `flagged_pages`."""
    warned = F.coalesce(F.length("parser_warning") > 0, F.lit(False))
    return page.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        *[F.count_if(F.col(f)).alias(f"{f}_pages") for f in PAGE_FLAGS[:4]],
        F.count_if(F.col("text_length") < 30).alias("low_text_pages"),
        F.count_if(warned).alias("parser_warning_pages"),
    )


def flagged_pages(page: DataFrame) -> DataFrame:
    """Pages behind the counts, one row per (document, kind, page)."""
    kinds = {f: F.col(f) for f in PAGE_FLAGS[:4]}
    kinds["low_text"] = F.col("text_length") < 30
    kinds["parser_warning"] = F.coalesce(F.length("parser_warning") > 0, F.lit(False))
    tagged = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in kinds.items()]))
    return page.select("document_id", "page_no", F.explode(tagged).alias("kind"))
