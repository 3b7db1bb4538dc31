"""Reviewer feedback over final rows, and the measures taken from corrected results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.functions import labels as lb
from tenderlens.functions import text as tx
from tenderlens.operators import verify as vf
from tenderlens.operators import wording as wd
from tenderlens.rules import pack
from tenderlens.session import cut_lineage

# Fixed values.
COMMENT_LEAD = "\n\n사용자 수정 의견: "
DEFAULT_ADVICE = "해당 법제도 준수 항목을 반영하여 제안요청서를 보완하시기 바랍니다."
SHOWN_COLUMNS = ["document_id", "item_no", "law_name", "normalized_result", "compliance_content", "recommendation", "reason", "needs_user_attention"]
FEEDBACK_COLUMNS = ["comment", "corrected_result", "manual_content", "manual_edited", "resolved"]


def _filled(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit(""))) > 0


def apply_feedback(final: DataFrame, feedback: DataFrame, key: Sequence[str] = ("document_id", "item_no")) -> DataFrame:
    """Corrections over final rows.

    feedback: key, comment, corrected_result, manual_content, manual_edited, resolved and, optionally,
    corrected_pairs array<struct<page,text>>.
    """
    key = list(key)
    given = feedback.select(*key, *[F.col(c).alias(f"_f_{c}") for c in feedback.columns if c not in key])
    j = final.join(given, key, "left")
    comment, corrected = F.coalesce("_f_comment", F.lit("")), tx.strip(F.col("_f_corrected_result"))
    manual = tx.strip(F.col("_f_manual_content"))
    edited = F.coalesce("_f_manual_edited", F.lit(False)) & (manual != "")
    advice = F.when(edited, manual).otherwise(F.coalesce("recommendation", F.lit("")))
    lacking = corrected.isin(pack.NON_COMPLIANT, pack.SUPPLEMENT) & (tx.strip(advice) == "")
    spoken = F.when(tx.strip(comment) != "", tx.strip(comment)).otherwise(DEFAULT_ADVICE)
    target = F.when(corrected == pack.NOT_APPLICABLE, F.lit(False)).when(corrected.isin(pack.COMPLIANT, pack.NON_COMPLIANT, pack.SUPPLEMENT), F.lit(True)).otherwise(F.col("is_target"))
    new = {
        "final_status": F.when(_filled(F.col("final_status")), F.col("final_status")).otherwise(pack.STATUS_USER_DONE),
        "final_result": F.when(corrected != "", corrected).otherwise(F.col("final_result")), "is_target": target,
        "reason": F.when(comment != "", tx.strip(F.concat(F.coalesce("reason", F.lit("")), F.lit(COMMENT_LEAD), comment))).otherwise(F.col("reason")),
        "recommendation": F.when(lacking, spoken).otherwise(advice),
        "warnings": F.when(comment != "", F.array(F.lit("user_feedback_applied"))).otherwise(F.expr("cast(array() as array<string>)")),
    }
    if "corrected_pairs" in feedback.columns:
        pairs = F.when(F.size("_f_corrected_pairs") > 0, F.col("_f_corrected_pairs"))
        kept = F.filter(pairs, lambda p: p["page"].isNotNull())
        new["evidence_pages"] = F.coalesce(F.transform(kept, lambda p: p["page"]), F.col("evidence_pages"))
        new["evidence_text"] = F.coalesce(F.transform(pairs, lambda p: p["text"]), F.col("evidence_text"))
    out = j.select(*[new.get(c, F.col(c)).alias(c) for c in final.columns], (~F.coalesce("_f_resolved", F.lit(False))).alias("needs_human_review"))
    return out


def apply_row_overrides(rows: DataFrame, overrides: DataFrame, key: Sequence[str] = ("document_id", "item_no")) -> DataFrame:
    """Rubric rows with the statuses that reviewers set.  overrides: key, row_status map<row_no,status>."""
    set_ = overrides.select(*key, F.explode("row_status").alias("row_no", "_status"))
    return rows.join(set_, [*key, "row_no"], "left").withColumn("explicit_status", F.coalesce("_status", "explicit_status")).drop("_status").select(*rows.columns)


def reassess(rows: DataFrame, overrides: DataFrame, final: DataFrame, key: Sequence[str] = ("document_id", "item_no")) -> DataFrame:
    """Result, reason and statement of the assessed items after overrides."""
    result = wd.assessment_result(apply_row_overrides(rows, overrides, key), key, edited=True)
    return result.join(final.select(*key, "evidence_pages"), list(key)).select(
        *key, "final_result", "assessment_reason", "assessment_recommendation", wd.assessment_sentence(F.col("evidence_pages")).alias("compliance_text")
    )


def apply_manual_content(content: DataFrame, feedback: DataFrame, key: Sequence[str] = ("document_id", "item_no")) -> DataFrame:
    """Wording entered by a person replaces the generated one, with all cited pages."""
    key = list(key)
    typed = feedback.filter(F.col("manual_edited") & (tx.strip(F.col("manual_content")) != "")).select(*key, tx.strip(F.col("manual_content")).alias("_manual"))
    j = content.join(typed, key, "left")
    has = F.col("_manual").isNotNull()
    return (
        j.withColumn("content_type", F.when(has, "user_entered_compliance_content").otherwise("compliance_statement"))
        .withColumn("compliance_content", F.coalesce("_manual", "compliance_content"))
        .withColumn("content_pages", F.when(has, F.col("evidence_pages")).otherwise(F.col("content_pages")))
        .withColumn("content_warnings", F.when(has, F.array(F.lit("user_entered"))).otherwise(F.col("content_warnings")))
        .drop("_manual")
    )


def regenerate(final: DataFrame, feedback: DataFrame, hits: DataFrame, criteria: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feedback over (document, item) rows -> (wide rows, opinion per document, workflow per document)."""
    corrected = apply_feedback(final, feedback).drop("needs_human_review").withColumn("seq", vf_position(F.col("item_no")))
    merged = vf.merge_subitem(corrected)
    worded = apply_manual_content(wd.compliance_content(merged, hits), feedback)
    wide = wd.review_output(worded, criteria)
    if "row_status" in feedback.columns:
        wide = overridden(wide, merged, feedback)
    shown = cut_lineage(wide.select(*SHOWN_COLUMNS))  # both summaries read it
    opinion = wd.opinion_summary(shown.withColumn("position", vf_position(F.col("item_no"))))
    return wide, opinion, wd.workflow_gate(shown)


def overridden(wide: DataFrame, final: DataFrame, feedback: DataFrame) -> DataFrame:
    """Wide rows with the outcome of overridden rubric rows."""
    marked = feedback.filter(F.size("row_status") > 0).select("document_id", "item_no", "row_status")
    done = reassess(wd.assess_rows(final), marked, final).join(marked.select("document_id", "item_no"), ["document_id", "item_no"], "left_semi")
    j = wide.join(done.select("document_id", "item_no", F.col("final_result").alias("_r"), F.col("assessment_reason").alias("_why"), F.col("compliance_text").alias("_text")), ["document_id", "item_no"], "left")
    for column, source in [("normalized_result", "_r"), ("review_result", "_r"), ("reason", "_why"), ("compliance_content", "_text")]:
        j = j.withColumn(column, F.coalesce(source, column))
    return j.drop("_r", "_why", "_text")


def vf_position(item: Column) -> Column:
    """Place of an item in the usual order, 2-1 right after 2."""
    main = F.split(item, "-")[0].try_cast("int")
    return (F.coalesce(main, F.lit(9999)) * 10 + item.contains("-").cast("int")).cast("long")


def accuracy(predicted: DataFrame, gold: DataFrame, key: Sequence[str] = ("document_id", "item_no")) -> tuple[DataFrame, DataFrame]:
    """(row-wise correctness, totals with accuracy) over the items that both sides have."""
    key = list(key)
    p = predicted.select(*key, lb.accuracy_label(F.col("result")).alias("predicted")).filter("predicted <> ''")
    g = gold.select(*key, lb.accuracy_label(F.col("result")).alias("answer")).filter("answer <> ''")
    rows = p.join(g, key).withColumn("correct", F.col("predicted") == F.col("answer"))
    n, ok = F.count(F.lit(1)), F.count_if("correct")
    totals = rows.agg(n.alias("item_count"), ok.alias("correct_count"), F.when(n > 0, F.bround(ok / n, 4)).otherwise(0.0).alias("accuracy"))
    return rows, totals


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("predicted", "answer").agg(F.count(F.lit(1)).alias("n"))


def page_failure_summary(failed: DataFrame, retried: DataFrame, still_failed: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages still failed, totals): failed pages that were not retried, and those that failed again."""
    ids = ["document_id", "page_no"]
    remaining = failed.select(*ids).distinct().join(retried.select(*ids), ids, "left_anti").union(still_failed.select(*ids)).distinct()
    counts = remaining.groupBy("document_id").agg(F.count(F.lit(1)).alias("failed_pages"))
    totals = documents.join(counts, "document_id", "left").fillna(0, ["failed_pages"])
    return remaining, totals.select("document_id", "total_pages", "failed_pages", (F.col("total_pages") - F.col("failed_pages")).alias("successful_pages"))
