"""The whole review of a page table: audit, gate, judge, verify, post-process, merge, wording."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.operators import audit
from tenderlens.operators import classify
from tenderlens.operators import evidence as ev
from tenderlens.operators import feedback as fb
from tenderlens.operators import judgements as jd
from tenderlens.operators import retrieval as rt
from tenderlens.operators import signals as sg
from tenderlens.operators import verify as vf
from tenderlens.operators import wording as wd
from tenderlens.plans.store import ReviewStore
from tenderlens.rules import pack
from tenderlens.schema import REVIEW
from tenderlens.session import checkpoint_dir, cut_lineage, delete_paths, owning

ALL_ITEMS = ["1", "2", "2-1", *[str(n) for n in range(3, 19)]]
JUDGED_OUTSIDE = ["5", "8", "9", "10", "13"]


@dataclass
class Reviewed:
    documents: DataFrame  # with score and status
    warnings: DataFrame
    reviews: DataFrame  # primary reviews
    final: DataFrame  # final rows with wording


def candidate_pages(page: DataFrame, flag) -> DataFrame:
    """Flagged pages of a document, or all its pages when none is flagged."""
    marked = page.filter(flag).select("document_id").distinct()
    return page.filter(flag).unionByName(page.join(marked, "document_id", "left_anti"))


def overlaps(page: DataFrame, hits: DataFrame, items: list[str]) -> DataFrame:
    """Accepted criteria overlaps for each item over the pages its route looks at."""
    routes = {
        "rule": page,
        "table": candidate_pages(page, F.col("has_eval_table") | F.col("has_table")),
        "attachment": candidate_pages(page, F.col("has_attachment") | F.col("has_blind") | F.col("has_commercial_sw")),
    }
    found = []
    for route, pages_ in routes.items():
        own = [i for i in items if i in pack.ROUTES[route]]
        if own:
            found.append(ev.overlap_evidence(ev.accepted_overlap(ev.page_words(pages_), hits.filter(F.col("query_item").isin(own))), page))
    return reduce(lambda a, b: a.unionByName(b), found)


def primary_reviews(page: DataFrame, documents: DataFrame, hits: DataFrame, items: list[str], external: DataFrame | None = None, store: ReviewStore | None = None) -> DataFrame:
    """One primary review per document and item.

    Page text is read once for all signals; the judgements then work on the staged signal table.  Every item is
    written to the review store on its own, so that no plan holds all items at once, and what a store holds already is not judged again.
    """
    spark = page.sparkSession
    store = store or ReviewStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/tenderlens-reviews-{uuid.uuid4().hex}")
    signals = cut_lineage(sg.page_signals(page, items))
    amount = cut_lineage(ev.project_amount(page))
    near = cut_lineage(overlaps(page, hits, items))

    def judged_outside(item: str, docs: DataFrame) -> DataFrame:
        if external is None:
            return jd.undecided_item(docs, item)
        own = external.filter(F.col("item_no") == item).join(docs.select("document_id"), "document_id", "left_semi")
        return own.select(*REVIEW.fieldNames()).unionByName(jd.undecided_item(docs, item, external))

    build = {
        "2": lambda d: jd.item_2(signals, d, page), "2-1": lambda d: jd.item_2_1(signals, d, page, near), "3": lambda d: jd.item_3(signals, d, amount, near),
        "4": lambda d: jd.item_4(signals, d), "6": lambda d: jd.item_6(signals, d), "11": lambda d: jd.item_11(signals, d, near),
        "12": lambda d: jd.item_12(signals, d, page, near), "14": lambda d: jd.item_14(signals, d, near), "15": lambda d: jd.item_15(signals, d),
        "16": lambda d: jd.item_16(signals, d), "17": lambda d: jd.item_17(signals, d, near), "18": lambda d: jd.item_18(signals, d, near),
        "1": lambda d: jd.item_keyword(signals, d, "1", near), "7": lambda d: jd.item_keyword(signals, d, "7", near),
    }
    return store.fill(documents, {i: build.get(i, lambda d, i=i: judged_outside(i, d)) for i in items})


def review_documents(
    page: DataFrame, document: DataFrame, criteria: tuple[DataFrame, DataFrame, DataFrame, DataFrame], items: list[str] | None = None,
    external: DataFrame | None = None, audit_warnings: DataFrame | None = None, flag_overrides: DataFrame | None = None, escalated: DataFrame | None = None,
    store: ReviewStore | None = None,
) -> Reviewed:
    """criteria: legal items, requirements, examples, tacit knowledge.  external: ingested judgement rows.

    Stored answers may go in: `flag_overrides` and `audit_warnings` as `external.ingest_audit` gives them, `escalated` as
    verdicts of a higher judge for conflicting reviews, in the columns of a review row.  With a `store` of an earlier run, only what it
    lacks is judged.
    """
    items = items or ALL_ITEMS
    legal, requirements, examples, tacit = criteria
    if flag_overrides is not None:
        page = cut_lineage(classify.apply_flag_overrides(page, flag_overrides))
    scored, warnings = audit.audit_documents(page, document, audit_warnings)
    scored, warnings = cut_lineage(scored), cut_lineage(warnings)
    open_documents = scored.filter("parse_status <> 'fail'").select("document_id", "parse_status")
    own = page.join(open_documents.select("document_id"), "document_id", "left_semi")
    docs = cut_lineage(rt.criteria_table(legal, requirements, examples))
    wanted = page.sparkSession.createDataFrame([(i,) for i in items], "item_no string")
    hits = cut_lineage(rt.context_for_items(wanted, docs, tacit))
    reviews = primary_reviews(own, open_documents, hits, items, external, store)
    # each step reads its rows several times: a step left in the plan would run again for every reading of the steps after it
    paged = cut_lineage(ev.normalize_evidence_pages(reviews, own, ["document_id", "item_no"]).select(*REVIEW.fieldNames()))
    verified = cut_lineage(vf.verify(paged, scored, escalated))
    gated = cut_lineage(vf.manual_attachment_gate(vf.target_basis(verified, ev.project_amount(own)), own))
    held = audit.parse_fail_reviews(warnings, scored, items)
    merged = cut_lineage(vf.merge_subitem(gated.withColumn("seq", fb.vf_position(F.col("item_no")))).drop("seq"))
    worded = wd.compliance_content(merged, hits)
    return Reviewed(scored, warnings, reviews, worded.unionByName(held.select(*gated.columns), allowMissingColumns=True))


def run_review(path: str, page: DataFrame, document: DataFrame, criteria: tuple[DataFrame, DataFrame, DataFrame, DataFrame], items: list[str] | None = None, **options) -> Reviewed:
    """review_documents() with its results under `path`; a run that was stopped goes on with the items and buckets it lacks.

    Results: path/documents, warnings, reviews (a ReviewStore), final.  Tables staged on the way are deleted at the end, those of a
    failed run too.
    """
    spark, path, staged = page.sparkSession, path.rstrip("/"), []
    store = ReviewStore(spark, path)
    try:
        with owning(staged):
            done = review_documents(page, document, criteria, items, store=store, **options)
            for name in ("documents", "warnings", "final"):
                getattr(done, name).write.mode("overwrite").parquet(f"{path}/{name}")
    finally:
        delete_paths(spark, staged)
    return Reviewed(*[spark.read.parquet(f"{path}/{name}") for name in ("documents", "warnings")], store.reviews(), spark.read.parquet(f"{path}/final"))


def item_rows(reviewed: Reviewed, hits: DataFrame) -> DataFrame:
    """One row per document and item: route, its hits as references (rank_group, rank), the primary judgement, the final row.

    A hit's text stands in the table of hits once, by query_item, rank_group and rank, not once a document.
    """
    told = hits.groupBy(F.col("query_item").alias("item_no")).agg(
        F.array_sort(F.collect_list(F.struct("rank_group", "rank", "source_type"))).alias("hits"))  # of the rule book
    judgement = F.struct("result", "is_target", "confidence", "evidence_pages", "reason", "source").alias("judgement")
    rows = vf.route_items(reviewed.reviews.select("document_id", "item_no", judgement)).join(told, "item_no", "left")
    final = reviewed.final.select("document_id", "item_no", F.struct("final_status", "final_result", "is_target", "confidence", "evidence_pages", "compliance_content").alias("final"))
    empty = F.expr("cast(array() as array<struct<rank_group:int,rank:int,source_type:string>>)")
    return rows.join(final, ["document_id", "item_no"], "left").select("document_id", "item_no", "route", F.coalesce("hits", empty).alias("hits"), "judgement", "final")


def review_state(reviewed: Reviewed, page: DataFrame, hits: DataFrame, requested: list[str]) -> tuple[DataFrame, DataFrame]:
    """(item rows with route and hit count, document rows with counts and completed and remaining items)."""
    counts = hits.groupBy("query_item").agg(F.count(F.lit(1)).alias("hit_count"))
    rows = vf.route_items(reviewed.reviews.select("document_id", "item_no", "result", "source", "confidence"))
    rows = rows.join(counts, F.col("item_no") == F.col("query_item"), "left").drop("query_item").fillna(0, ["hit_count"])
    done = reviewed.reviews.groupBy("document_id").agg(F.array_sort(F.collect_set("item_no")).alias("completed_items"))
    asked = F.array(*[F.lit(i) for i in requested])
    reparse = audit.pages_to_reparse(reviewed.warnings, reviewed.documents).groupBy("document_id").agg(F.count(F.lit(1)).alias("pages_to_reparse"))
    state = reviewed.documents.select("document_id", "parse_status", "audit_score").join(done, "document_id", "left").join(
        classify.flag_counts(page), "document_id", "left").join(reparse, "document_id", "left").fillna(0, ["pages_to_reparse"])
    return rows, state.withColumn("remaining_items", F.array_except(asked, F.coalesce("completed_items", F.array().cast("array<string>"))))
