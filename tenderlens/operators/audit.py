"""Extraction audit: warnings, score and status of every document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.operators import blocks, classify, pages
from tenderlens.rules import pack
from tenderlens.session import cut_lineage

SECTION, PAGE, ABSENCE = 1, 2, 3


def _labelled(mapping: dict, key: Column, default) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def _warning_columns(df: DataFrame, phase, seq, kind_no, kind, message, page_no, severity, related) -> DataFrame:
    return df.select(
        "document_id",
        F.lit(phase).alias("phase"),
        seq.cast("long").alias("seq"),
        kind_no.cast("int").alias("kind_no"),
        kind.alias("warning_type"),
        message.alias("message"),
        page_no.cast("int").alias("page_no"),
        severity.alias("severity"),
        related.cast("array<string>").alias("related_item_nos"),
    )


def _pair_regex(first: str, second: str | None) -> str:
    return first if second is None else f"{first}[{tx.SPACE}]*{second}"


SECTION_PAIRS = [(no, a, b) for no, pairs in enumerate(pack.REQUIRED_SECTIONS.values()) for a, b in pairs if b]


def audit_facts(page: DataFrame) -> DataFrame:
    """What the audit asks of each page, without its text: sections, edges, warnings, flags.

    One row a page, so that facts of repaired pages take the place of those of the old ones (pages.merge_repaired_pages) and the text of the
    others is not read again.
    """
    text, compact, stripped = tx.text_or_empty(F.col("page_text")), tx.compact(F.col("page_text")), tx.strip(tx.text_or_empty(F.col("page_text")))
    sections = F.array(*[text.rlike("|".join(_pair_regex(a, b) for a, b in pairs)) for pairs in pack.REQUIRED_SECTIONS.values()])

    def warning(no: int, cond: Column, kind: str, message: Column, severity: str) -> Column:
        return F.when(cond, F.struct(
            F.lit(no).alias("no"), F.lit(kind).alias("kind"), message.alias("message"), F.lit(severity).alias("severity")
        ))

    found = F.array_compact(F.array(
        warning(0, F.length("parser_warning") > 0, "parser_warning", F.col("parser_warning"), "medium"),
        warning(1, F.col("text_length") == 0, "empty_page", F.lit(pack.MSG_EMPTY), "high"),
        warning(2, (F.col("text_length") != 0) & (F.col("text_length") < 30), "low_text_density", F.lit(pack.MSG_LOW), "low"),
        warning(3, classify.script_noise(text), "suspicious_unicode_noise", F.lit(pack.MSG_NOISE), "medium"),
    ))
    return page.select(
        "document_id", "page_no", "seq", "text_length", "parser_warning", "has_table", "has_attachment", "has_eval_table",
        classify.index_page(text, compact).alias("is_index"), sections.alias("sections"), found.alias("told"),
        F.substring(stripped, 1, max(len(b) for _, _, b in SECTION_PAIRS)).alias("head"),
        F.when(F.length(stripped) > 0, F.right(stripped, F.lit(max(len(a) for _, a, _ in SECTION_PAIRS)))).alias("tail"),
    )


def as_facts(page: DataFrame) -> DataFrame:
    """Facts of a page table; facts stay as they are."""
    return page if "told" in page.columns else audit_facts(page)


def section_presence(facts: DataFrame) -> DataFrame:
    """One row per document with one boolean per required section.

    A two-part heading may be split by a page break; that is found on the stripped edges of neighbouring
    pages, which are a few characters wide, not on joined document text.
    """
    names = list(pack.REQUIRED_SECTIONS)
    inside = facts.groupBy("document_id").agg(
        F.max("page_no").alias("max_page"), F.count_distinct("page_no").alias("parsed_pages"), *[F.bool_or(F.get("sections", F.lit(no))).alias(name) for no, name in enumerate(names)]
    )
    edge = facts.select("document_id", "page_no", "seq", "head", "tail").filter("tail is not null")
    joined = blocks.following_value(edge, ["document_id"], "page_no", ["page_no", "seq"], "head", "_next")
    met = {name: [F.col("tail").endswith(a) & F.col("_next").startswith(b) for n, a, b in SECTION_PAIRS if n == no] for no, name in enumerate(names)}
    across = joined.groupBy("document_id").agg(*[
        F.coalesce(F.bool_or(reduce(lambda x, y: x | y, conds, F.lit(False))), F.lit(False)).alias(f"_x_{name}") for name, conds in met.items()
    ])
    return inside.join(across, "document_id", "left").select(
        "document_id", "max_page", "parsed_pages", *[(F.col(n) | F.coalesce(f"_x_{n}", F.lit(False))).alias(n) for n in names]
    )


def missing_sections(page: DataFrame, document: DataFrame) -> DataFrame:
    """Warnings for required sections that are expected and absent."""
    state = document.select("document_id", "total_pages").join(section_presence(as_facts(page)), "document_id", "left")
    partial = F.coalesce("parsed_pages", F.lit(0)) < F.col("total_pages")
    flags = []
    for no, name in enumerate(pack.REQUIRED_SECTIONS):
        from_page = pack.SECTION_FROM_PAGE[name]
        when_empty = F.lit(no == 0)
        expected = F.when(F.col("max_page").isNull(), when_empty).otherwise(~partial | (F.col("max_page") >= from_page))
        flags.append(F.when(expected & ~F.coalesce(name, F.lit(False)), F.struct(F.lit(no).alias("no"), F.lit(name).alias("name"))))
    rows = state.withColumn("_s", F.explode(F.array_compact(F.array(*flags))))
    return _warning_columns(
        rows, SECTION, F.lit(0), F.col("_s.no"), F.lit("required_section_missing"),
        F.concat(F.lit(pack.MSG_SECTION), F.col("_s.name")), F.lit(None), F.lit("medium"), F.array(),
    )


def page_warnings(page: DataFrame) -> DataFrame:
    rows = as_facts(page).filter("not is_index").select("document_id", "page_no", "seq", F.explode("told").alias("_w"))
    return _warning_columns(
        rows, PAGE, F.col("seq"), F.col("_w.no"), F.col("_w.kind"), F.col("_w.message"), F.col("page_no"),
        F.col("_w.severity"), F.array(),
    )


def absence_warnings(page: DataFrame, document: DataFrame) -> DataFrame:
    """Complete extractions only: no page with an evaluation table, no page with an attachment."""
    seen = as_facts(page).groupBy("document_id").agg(
        F.count_distinct("page_no").alias("_parsed"),
        F.bool_or("has_eval_table").alias("_eval"),
        F.bool_or("has_attachment").alias("_attachment"),
    )
    state = document.select("document_id", "total_pages").join(seen, "document_id", "left").filter(
        F.coalesce("_parsed", F.lit(0)) >= F.col("total_pages")
    )

    def absent(no, cond, kind, message, items):
        return F.when(~F.coalesce(cond, F.lit(False)), F.struct(
            F.lit(no).alias("no"), F.lit(kind).alias("kind"), F.lit(message).alias("message"),
            F.array(*[F.lit(i) for i in items]).alias("items"),
        ))

    rows = state.withColumn("_w", F.explode(F.array_compact(F.array(
        absent(0, F.col("_eval"), "eval_table_not_found", pack.MSG_NO_EVAL, ["4", "11", "12"]),
        absent(1, F.col("_attachment"), "attachment_not_found", pack.MSG_NO_ATTACHMENT, ["2", "15", "17"]),
    ))))
    return _warning_columns(
        rows, ABSENCE, F.lit(0), F.col("_w.no"), F.col("_w.kind"), F.col("_w.message"), F.lit(None),
        F.lit("medium"), F.col("_w.items"),
    )


def filter_index_warnings(warnings: DataFrame, page: DataFrame) -> DataFrame:
    """Drop the warning types that an attachment index page brings about by its nature."""
    index = as_facts(page).filter("is_index").select("document_id", "page_no").distinct()
    expected = F.col("warning_type").isin(pack.INDEX_FILTERED_TYPES)
    kept = warnings.filter(~expected | F.col("page_no").isNull())
    return kept.unionByName(
        warnings.filter(expected & F.col("page_no").isNotNull()).join(index, ["document_id", "page_no"], "left_anti")
        .select(*warnings.columns)
    )


def audit_quality(warnings: DataFrame, document: DataFrame) -> DataFrame:
    given = F.lower(tx.strip(F.coalesce(F.when(F.length("severity") > 0, F.col("severity")), F.lit("medium"))))
    severity = F.when(given.isin(list(pack.SEVERITY_RANK)), given).otherwise("medium")
    ranked = warnings.select("document_id", "page_no", severity.alias("severity")).withColumn(
        "rank", _labelled(pack.SEVERITY_RANK, F.col("severity"), 2)
    )
    worst = ranked.groupBy("document_id", "page_no").agg(
        F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"),
        F.sum(_labelled(pack.PAGE_PENALTY, F.col("severity"), 4)).alias("total"),
    )
    by_rank = {pack.SEVERITY_RANK[k]: v for k, v in pack.PAGE_PENALTY.items()}
    on_page = F.col("page_no").isNotNull() & (F.col("rank") > 0)
    penalty = F.when(F.col("page_no").isNull(), F.col("total")).otherwise(_labelled(by_rank, F.col("rank"), 4))
    sums = worst.groupBy("document_id").agg(
        F.sum("n").alias("audit_warning_count"),
        F.count_if(on_page & (F.col("rank") != 1)).alias("affected_page_count"),
        F.count_if(on_page).alias("all_affected_page_count"),
        F.count_if(on_page & (F.col("rank") >= 3)).alias("critical_page_count"),
        F.sum(penalty).alias("_penalty"),
    )
    counts = ["audit_warning_count", "affected_page_count", "all_affected_page_count", "critical_page_count"]
    joined = document.join(sums, "document_id", "left").fillna(0, [*counts, "_penalty"])
    ratio = F.when(F.col("total_pages") > 0, F.col("affected_page_count") / F.col("total_pages")).otherwise(0.0)
    return joined.withColumn("affected_ratio", ratio).withColumn(
        "audit_score", F.greatest(F.lit(0), 100 - F.col("_penalty")).cast("int")
    ).drop("_penalty")


def parse_status() -> Column:
    failed = (F.col("critical_page_count") >= 5) | (F.col("affected_ratio") >= 0.15)
    return F.when(F.col("audit_warning_count") == 0, "ok").when(failed, "fail").otherwise("warning")


def score_documents(warnings: DataFrame, document: DataFrame) -> DataFrame:
    return audit_quality(warnings, document).withColumn("parse_status", parse_status())


def pages_to_reparse(warnings: DataFrame, scored: DataFrame, threshold: int = 70, zero_counts_as_full: bool = True) -> DataFrame:
    """Warned pages of low-scored documents.  By default a score of 0 counts as 100, as it always did."""
    score = F.col("audit_score")
    if zero_counts_as_full:
        score = F.when(score == 0, 100).otherwise(score)
    low = scored.filter(score < threshold).select("document_id")
    return warnings.filter("page_no > 0").join(low, "document_id", "left_semi").select("document_id", "page_no").distinct()


def repair_required(message: Column) -> Column:
    return F.coalesce(tx.contains_any(F.lower(message), [k.lower() for k in pack.REPAIR_KEYWORDS]), F.lit(False))


def repair_pages(page: DataFrame, warnings: DataFrame) -> DataFrame:
    from_pages = page.filter((F.col("text_length") == 0) | repair_required(F.col("parser_warning")))
    typed = F.col("warning_type").isin(pack.REPAIR_WARNING_TYPES)
    told = (F.col("warning_type") == "parser_warning") & repair_required(F.col("message"))
    from_warnings = warnings.filter((F.col("page_no") > 0) & (typed | told))
    return from_pages.select("document_id", "page_no").union(from_warnings.select("document_id", "page_no")).distinct()


def parse_fail_reviews(warnings: DataFrame, scored: DataFrame, items: DataFrame) -> DataFrame:
    """Held judgements of failed documents: at most ten problem pages and ten messages each."""
    failed = scored.filter("parse_status = 'fail'").select("document_id")
    own = warnings.join(failed, "document_id", "left_semi")
    problem = own.filter("page_no > 0").select("document_id", "page_no").distinct()
    problem = blocks.first_rows(problem, ["document_id"], [F.col("page_no")], 10).groupBy("document_id").agg(
        F.array_sort(F.collect_list("page_no")).alias("evidence_pages")
    )
    said = F.concat_ws("", F.when(F.col("page_no") > 0, F.format_string("p.%d: ", "page_no")), F.col("warning_type"), F.lit(" - "), F.col("message"))
    first = blocks.first_rows(own, ["document_id"], [F.col("phase"), F.col("seq"), F.col("kind_no")], 10)
    messages = first.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", said.alias("text")))).alias("_m")
    )
    held = failed.join(problem, "document_id", "left").join(messages, "document_id", "left")
    item_list = [F.lit(str(r)) for r in items] if isinstance(items, list) else None
    spread = held.withColumn("item_no", F.explode(F.array(*item_list)))
    return spread.select(
        "document_id", "item_no",
        F.lit(pack.STATUS_PARSE_HOLD).alias("final_status"), F.lit(pack.ON_HOLD).alias("final_result"),
        F.lit(None).cast("boolean").alias("is_target"), F.lit(0.0).alias("confidence"),
        F.coalesce("evidence_pages", F.array().cast("array<int>")).alias("evidence_pages"),
        F.array().cast("array<string>").alias("evidence_text"),
        F.lit(pack.HOLD_REASON).alias("reason"), F.lit(pack.HOLD_RECOMMENDATION).alias("recommendation"),
        F.coalesce(F.transform("_m", lambda m: m["text"]), F.array().cast("array<string>")).alias("warnings"),
    )


def needs_confirmation() -> Column:
    return (F.col("parse_status") != "ok") | (F.coalesce("audit_score", F.lit(0)) < 80) | (F.col("audit_warning_count") > 0)


def all_warnings(facts: DataFrame, document: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Warnings of every kind.  `extra` holds warnings from stored audit responses; only those can fall on
    index pages, because the page checks skip such pages."""
    found = missing_sections(facts, document).unionByName(page_warnings(facts)).unionByName(absence_warnings(facts, document))
    return found if extra is None else found.unionByName(filter_index_warnings(extra, facts))


def audit_by_facts(facts: DataFrame, document: DataFrame, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with score and status, warnings) from the (staged) facts of the pages."""
    warnings = all_warnings(facts, document, extra)
    return score_documents(warnings, document), warnings


def audit_documents(page: DataFrame, document: DataFrame, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with score and status, warnings).  The page table is read once."""
    return audit_by_facts(cut_lineage(audit_facts(page)), document, extra)


def repair_round(page: DataFrame, document: DataFrame, supplied: DataFrame, rounds: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bounded repair: bad pages take the rows supplied for them, then the audit runs again.

    A round reads the text of the pages it takes in; for all others the facts of the first audit stand.  The page table itself is put
    together once, at the end.
    """
    facts = cut_lineage(audit_facts(page))
    scored, warnings = audit_by_facts(facts, document)
    taken: list[DataFrame] = []
    for _ in range(rounds):
        bad = cut_lineage(repair_pages(facts, warnings))
        taken.append(bad)
        repaired = supplied.join(bad, ["document_id", "page_no"], "left_semi")
        facts = cut_lineage(pages.merge_repaired_pages(facts, cut_lineage(audit_facts(repaired))))
        scored, warnings = audit_by_facts(facts, document)
    if taken:
        keys = reduce(lambda a, b: a.union(b), taken).distinct()
        page = cut_lineage(pages.merge_repaired_pages(page, supplied.join(keys, ["document_id", "page_no"], "left_semi")))
    return page, scored, warnings
