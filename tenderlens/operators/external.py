"""Exchange with external judges as tables: request rows out, response rows in.  The call itself is outside."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.functions import labels as lb
from tenderlens.functions import text as tx
from tenderlens.operators import blocks
from tenderlens.operators import evidence as ev
from tenderlens.operators import verify as vf
from tenderlens.rules import pack
from tenderlens.schema import REVIEW
from tenderlens.session import cut_lineage

KEY = ["document_id", "item_no"]
JUDGEMENT = (
    "result string, is_target boolean, confidence double, evidence_pages array<string>, evidence_text array<string>, "
    "reason string, recommendation string, needs_human_review boolean, warnings array<string>"
)
AUDIT = (
    "page_overrides array<struct<page_no:string,has_table_candidate:boolean,has_eval_table_candidate:boolean,has_attachment_candidate:boolean>>, "
    "warnings array<struct<warning_type:string,page_no:string,severity:string,message:string,related_item_nos:array<string>>>"
)
FINDINGS = (
    "findings array<struct<finding_type:string,severity:string,message:string,atomic_requirement_id:string,"
    "evidence_observed:array<string>,suggested_action:string>>"
)
NO_INTS, NO_TEXTS = "cast(array() as array<int>)", "cast(array() as array<string>)"


def outer_object(text: Column) -> Column:
    """JSON between the first and the last brace, whatever fence surrounds it."""
    return F.regexp_extract(tx.text_or_empty(text), "(?s)\\{.*\\}", 0)


# --- requests ---------------------------------------------------------------------------------------------


def _payload(body: Column, answer: dict) -> Column:
    """JSON of a request: its own fields, empty ones too, and what the answer has to look like."""
    own = F.to_json(body, {"ignoreNullFields": "false"})
    shape = json.dumps(answer, ensure_ascii=False, separators=(",", ":"))
    return F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(f',"output_schema":{shape}}}'))


def request_rows(page: DataFrame, items: DataFrame, hits: DataFrame, max_hits: int = 10, max_chars: int = 1800) -> DataFrame:
    """One JSON payload per (document, item): role, at most ten criteria hits, the selected pages with flags, the shape of the answer."""
    chosen = ev.select_prompt_pages(page, items, hits)
    role = F.col("route")
    top = blocks.first_rows(hits, ["query_item"], [F.col("rank_group"), F.col("rank")], max_hits, "_k")
    fields = [*["item_no", "source_type", "source_name", "title", "category", "snippet"], F.col("location").alias("page_or_row"), "score"]
    criteria = top.groupBy(F.col("query_item")).agg(F.array_sort(F.collect_list(F.struct("_k", F.struct(*fields).alias("hit")))).alias("_h")).select(
        F.col("query_item").alias("item_no"), F.transform("_h", lambda h: h["hit"]).alias("rag_criteria"))
    flags = ["table", "eval_table", "attachment", "blind", "commercial_sw"]
    shown = F.struct(
        F.col("page_no").alias("document_page_index"), F.coalesce("printed_page_no", tx.footer_page_no(F.col("page_text"))).alias("rfp_printed_page_no"),
        ev.prompt_text(F.col("page_text"), max_chars).alias("page_text"),
        F.struct(*[F.col(f"has_{f}").alias(f) for f in flags], "parser_warning").alias("flags"),
    )
    pages = chosen.join(page, ev.PAGE_ID).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("p")))).alias("_p")).select(
        *KEY, F.transform("_p", lambda p: p["p"]).alias("rfp_pages"))
    joined = vf.route_items(pages.join(criteria, "item_no", "left")).withColumn("role", F.when(role == "llm", "general").otherwise(role))
    found = F.coalesce("rag_criteria", F.array().cast(criteria.schema["rag_criteria"].dataType)).alias("rag_criteria")
    return joined.select(*KEY, "role", F.size("rfp_pages").alias("page_count"), _payload(F.struct("item_no", F.col("role").alias("agent_type"), found, "rfp_pages"), pack.JUDGEMENT_ANSWER).alias("payload"))


def audit_request_rows(page: DataFrame, document: DataFrame, first: int = 20, max_chars: int = 1800) -> DataFrame:
    """One JSON payload per document: its page numbers, samples of its first pages, the shape of the answer."""
    top = blocks.first_rows(page, ["document_id"], [F.col("page_no"), F.col("seq")], first)
    flags = ["table", "eval_table", "attachment", "toc", "blind", "commercial_sw"]
    sample = F.struct(
        "page_no", "text_length", tx.head(F.col("page_text"), max_chars).alias("page_text_sample"),
        F.struct(*[F.col(f"has_{f}").alias(f"has_{f}_candidate") for f in flags], "parser_warning").alias("flags"),
    )
    packed = top.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("rank", sample.alias("s")))).alias("_s"))
    numbers = page.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "seq"))).alias("_n"))  # numbers only
    joined = document.join(packed, "document_id").join(numbers, "document_id")
    body = F.struct("document_name", "total_pages", F.transform("_n", lambda n: n["page_no"]).alias("parsed_pages"), F.transform("_s", lambda s: s["s"]).alias("pages"))
    return joined.select("document_id", F.size("_n").cast("long").alias("parsed_pages"), F.size("_s").alias("sampled_pages"), _payload(body, pack.AUDIT_ANSWER).alias("payload"))


# --- responses -----------------------------------------------------------------------------------------------


def parse_judgements(responses: DataFrame) -> DataFrame:
    """Responses (document_id, item_no, role, route_type, response) -> review rows before any page repair."""
    r = responses.withColumn("_j", F.from_json(outer_object(F.col("response")), JUDGEMENT))
    j = F.col("_j")
    digits = F.filter(F.transform(F.coalesce(j["evidence_pages"], F.expr(NO_TEXTS)), tx.strip), lambda v: v.rlike("^[0-9]+$"))
    parsed = r.filter(j.isNotNull() & (outer_object(F.col("response")) != "")).select(
        "document_id", "item_no", F.lit(0).cast("long").alias("seq"), "route_type", lb.judgement_label(j["result"]).alias("result"), j["is_target"].alias("is_target"),
        F.coalesce(j["confidence"], F.lit(0.65)).alias("confidence"), F.transform(digits, lambda v: v.cast("int")).alias("evidence_pages"),
        F.coalesce(j["evidence_text"], F.expr(NO_TEXTS)).alias("evidence_text"), F.coalesce(j["reason"], F.lit("")).alias("reason"),
        F.coalesce(j["recommendation"], F.lit("")).alias("recommendation"), F.coalesce(j["needs_human_review"], F.lit(False)).alias("needs_human_review"),
        F.concat(F.lit("external_"), "role").alias("source"), F.coalesce(j["warnings"], F.expr(NO_TEXTS)).alias("warnings"), F.lit(True).alias("used_llm"),
    )
    return parsed.select(*REVIEW.fieldNames())


def ingest_judgements(responses: DataFrame, page: DataFrame, hits: DataFrame) -> DataFrame:
    """Judgement responses -> review rows: page numbers repaired, contents pages dropped, direct evidence kept."""
    parsed = cut_lineage(parse_judgements(responses))  # every step reads its rows several times
    paged = cut_lineage(ev.distinct_evidence_pages(parsed, page, KEY).select(*REVIEW.fieldNames()))
    return direct_evidence(cut_lineage(ev.drop_toc_evidence(paged, page, KEY).select(*REVIEW.fieldNames())), page, hits)


def ingest_audit(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audit responses (document_id, response) -> (flag overrides, warnings)."""
    r = responses.select("document_id", F.from_json(outer_object(F.col("response")), AUDIT).alias("j"))
    o = r.select("document_id", F.posexplode("j.page_overrides").alias("seq", "o"))
    overrides = o.select(
        "document_id", tx.strict_int(F.col("o.page_no")).alias("page_no"), F.col("seq").cast("long").alias("seq"), F.col("o.has_table_candidate").alias("has_table"),
        F.col("o.has_eval_table_candidate").alias("has_eval_table"), F.col("o.has_attachment_candidate").alias("has_attachment"),
    ).filter("page_no is not null")
    w = r.select("document_id", F.posexplode("j.warnings").alias("k", "w"))
    warnings = w.select(
        "document_id", F.lit(4).alias("phase"), F.col("k").cast("long").alias("seq"), F.lit(0).alias("kind_no"), F.coalesce("w.warning_type", F.lit("gpt_parse_audit")).alias("warning_type"),
        F.coalesce("w.message", F.lit("")).alias("message"), tx.strict_int(F.col("w.page_no")).alias("page_no"), F.coalesce("w.severity", F.lit("medium")).alias("severity"),
        F.coalesce("w.related_item_nos", F.expr(NO_TEXTS)).alias("related_item_nos"),
    )
    return overrides, warnings


def ingest_findings(responses: DataFrame) -> DataFrame:
    """Verification responses (document_id, item_no, response) -> finding rows with defaults."""
    r = responses.select(*KEY, F.posexplode(F.from_json(outer_object(F.col("response")), FINDINGS)["findings"]).alias("k", "f"))
    return r.select(
        *KEY, "k", F.coalesce("f.finding_type", F.lit("schema_or_consistency_error")).alias("finding_type"), F.coalesce("f.severity", F.lit("medium")).alias("severity"),
        F.coalesce("f.message", F.lit("")).alias("message"), F.col("f.atomic_requirement_id").alias("requirement_id"),
        F.coalesce("f.evidence_observed", F.expr(NO_TEXTS)).alias("evidence_observed"), F.coalesce("f.suggested_action", F.lit("")).alias("suggested_action"),
    )


# --- direct evidence of the judged items ---------------------------------------------------------------------------

# Words quoted for an item, in order of preference.
QUOTE_WORDS = {
    "5": ["작업장소", "원격지", "보안요구사항", "사업예산 내 계상"],
    "8": ["하자담보", "하자보수", "책임기간"],
    "10": ["사업자 선정 방법", "낙찰자 결정방법", "협상에 의한 계약", "협상에 의한 계약체결"],
    "13": pack.COMPENSATION_TERMS,
}
COMMON_STATEMENT = (
    "「(계약예규) 용역계약일반조건」 제58조 제2항과 제3항에 따라, 정한 기한내에 하자가 발생하여 "
    "발주기관이 하자보수를 계약상대자에게 요청한 경우 하자를 조치하여야 함, 단 제58조 제2항 각 호의 경우는 "
    "유상 유지보수 또는 재개발로 봄, 또한 계약상대자는 제58조 제3항에 각호의 어느 하나의 사유로 인하여 "
    "발생한 하자에는 하자보수의 책임이 없음"
)


def direct_5(t: Column, c: Column) -> Column:
    return tx.contains_any(c, pack.PLACE_TERMS) & tx.contains_any(c, pack.PLACE_DETAILS)


def direct_8(t: Column, c: Column) -> Column:
    codes = F.size(F.array_distinct(F.regexp_extract_all(c, F.lit("(?i)([A-Z]{2,5}-[0-9]{3})"), F.lit(1))))
    overview = c.contains("하자보수") & ((codes >= 3) | c.contains("요구사항총괄표"))
    bidder = c.contains("하자보수계획") & tx.contains_any(c, pack.WARRANTY_BIDDER)
    blank = tx.contains_any(c, pack.WARRANTY_FORMS) & (tx.count_terms(c, pack.WARRANTY_FORM_LABELS) >= 3)
    joint = (tx.count_terms(c, pack.JOINT_TERMS) >= 2) & tx.contains_all(c, pack.JOINT_WARRANTY)
    topic = tx.contains_any(c, pack.WARRANTY_TOPICS) & tx.contains_any(c, pack.WARRANTY_DETAILS)
    return topic & ~(overview | bidder | blank | joint)


def direct_9(t: Column, c: Column) -> Column:
    return tx.contains_any(c, pack.BRAND_TERMS) & tx.contains_any(c, pack.BRAND_BANS)


def direct_10(t: Column, c: Column) -> Column:
    chosen = tx.contains_any(c, pack.AWARD_METHODS)
    basis = tx.contains_any(c, pack.AWARD_ARTICLES) & tx.contains_any(c, pack.AWARD_APPLIED)
    return c.contains("협상에의한계약") & (chosen | basis)


def direct_13(t: Column, c: Column) -> Column:
    return tx.contains_any(t, pack.COMPENSATION_TERMS)


PREDICATES = {"5": direct_5, "8": direct_8, "9": direct_9, "10": direct_10, "13": direct_13}


def direct_pages(page: DataFrame, hits: DataFrame, items: Sequence[str]) -> DataFrame:
    """Pages with a printed number that bear on an item directly: (document_id, item_no, place, page, text)."""
    printed = F.coalesce("printed_page_no", tx.footer_page_no(F.col("page_text")))
    base = page.withColumn("_printed", printed).filter("_printed is not null").withColumn("_c", tx.compact(F.col("page_text")))
    t, c = F.col("page_text"), F.col("_c")
    place = F.struct("page_no", "seq").alias("place")
    own = [i for i in items if i in PREDICATES]
    found = []
    if own:
        rows = F.array_compact(F.array(*[F.when(PREDICATES[i](t, c), F.struct(F.lit(i).alias("item_no"), tx.exact_window(t, QUOTE_WORDS.get(i, []), 360).alias("text"))) for i in own]))
        found.append(base.select("document_id", place, F.col("_printed").alias("page"), F.explode(rows).alias("r")).select("document_id", "r.item_no", "place", "page", "r.text"))
    rest = [i for i in items if i not in PREDICATES and i != "16"]
    if rest:
        terms = ev.direct_terms(hits).filter(F.col("item_no").isin(rest))
        body = base.filter(~F.col("has_toc") & ~ev.target_only(c))
        told = ev.direct_requirement_signal(body, terms).select(*ev.PAGE_ID, "item_no")
        quoted = body.select(*ev.PAGE_ID, F.col("_printed").alias("page"), tx.exact_window(t, [], 360).alias("text"))
        found.append(quoted.join(told, ev.PAGE_ID).select("document_id", "item_no", place, "page", "text"))
    rows = reduce(lambda a, b: a.unionByName(b), found)
    if "10" not in own:
        return rows
    ten = rows.filter("item_no = '10'").withColumn("_weak", (~direct_10(F.col("text"), tx.compact(F.col("text")))).cast("int"))
    one = ten.groupBy("document_id", "item_no").agg(F.min_by(F.struct("place", "page", "text"), F.struct("_weak", "place")).alias("r")).select("document_id", "item_no", "r.*")
    return rows.filter("item_no <> '10'").unionByName(one)


def direct_evidence(review: DataFrame, page: DataFrame, hits: DataFrame) -> DataFrame:
    """Evidence of external judgements replaced by the pages that bear on the item, or reduced to such pairs."""
    items = [i for i in [*pack.DEFAULT_ITEMS, "2-1"] if i != "16"]
    scanned = direct_pages(page, hits, items).join(review.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("place", "page", "text"))).alias("_s"))
    texts = ev.evidence_pairs(review, [*KEY, "seq"]).filter("page is not null")
    texts = texts.join(review.select(*KEY, "seq", F.size("evidence_text").alias("_nt")), [*KEY, "seq"]).filter("pos < _nt").drop("_nt")
    pair = F.to_json(F.struct(*KEY, "seq", "pos"))
    as_pages = texts.select(pair.alias("document_id"), F.lit(0).alias("page_no"), F.lit(0).cast("long").alias("seq"), F.col("text").alias("page_text"))
    signal = ev.substring_hits(as_pages, ev.direct_terms(hits), lower=False).filter("hits >= 2").select(F.col("document_id").alias("_pair"), F.col("item_no").alias("_item"))
    marked = texts.withColumn("_pair", pair).join(signal.withColumn("_direct", F.lit(True)).withColumnRenamed("_item", "item_no"), ["_pair", "item_no"], "left")
    c, t = tx.compact(F.col("text")), F.col("text")
    by_item = F.lit(None).cast("boolean")
    for i, p in PREDICATES.items():
        by_item = F.when(F.col("item_no") == i, p(t, c)).otherwise(by_item)
    keep = F.coalesce(by_item, ~ev.target_only(c) | F.coalesce("_direct", F.lit(False)))
    kept = marked.filter(keep).groupBy(*KEY, "seq").agg(F.array_sort(F.collect_list(F.struct("pos", "page", "text"))).alias("_k"))
    j = review.join(scanned, KEY, "left").join(kept, [*KEY, "seq"], "left")
    k = F.when(F.col("item_no") == "10", F.slice("_k", 1, 1)).otherwise(F.col("_k"))
    has_scan, has_kept = F.size(F.coalesce("_s", F.array())) > 0, F.size(F.coalesce("_k", F.array())) > 0
    off, sixteen = tx.strip(F.col("result")) == pack.NOT_APPLICABLE, F.col("item_no") == "16"
    nine = (F.col("item_no") == "9") & ~has_kept

    def side(name: str, empty: str) -> Column:
        current = F.col("evidence_pages" if name == "page" else "evidence_text")
        return (
            F.when(sixteen, current).when(has_scan, F.transform("_s", lambda s: s[name])).when(off, current)
            .when(has_kept, F.transform(k, lambda s: s[name])).when(nine, F.expr(empty)).otherwise(current)
        )

    changed = ~sixteen & (has_scan | (~off & has_kept))
    out = j.withColumn("_changed", changed).withColumn("_p", side("page", NO_INTS)).withColumn("_t", side("text", NO_TEXTS))
    out = out.withColumn("evidence_pages", F.col("_p")).withColumn("evidence_text", F.col("_t"))
    out = out.withColumn("result", F.when(sixteen, F.when(F.coalesce("is_target", F.lit(True)), pack.SUPPLEMENT).otherwise(pack.NOT_APPLICABLE)).otherwise(F.col("result")))
    out = out.withColumn("recommendation", F.when(sixteen, "").otherwise(F.col("recommendation")))
    return missing_item_5_8(out, F.col("_changed")).select(*REVIEW.fieldNames())


def gaps_5(c: Column) -> list[Column]:
    """Missing parts of item 5: workplace and cost, supplier proposal, remote security."""
    place = c.contains("작업장소")
    agreed = place & tx.contains_any(c, pack.PLACE_AGREED)
    cost = place & tx.contains_any(c, pack.PLACE_COSTS)
    proposed = tx.contains_any(c, pack.SUPPLIER_TERMS) & tx.contains_any(c, pack.SUPPLIER_PROPOSALS)
    secure = tx.contains_any(c, pack.REMOTE_TERMS) & tx.contains_any(c, pack.REMOTE_RISKS)
    return [~(agreed & cost), ~proposed, ~secure]


def gaps_8(c: Column) -> list[Column]:
    """Missing parts of item 8: warranty period, common statement."""
    period = tx.contains_any(c, pack.PERIOD_TERMS) & tx.contains_any(c, pack.PERIOD_LENGTHS)
    statement = (
        tx.contains_any(c, pack.STATEMENT_ARTICLES) & tx.contains_any(c, pack.STATEMENT_REQUESTS)
        & tx.contains_any(c, pack.STATEMENT_PAID) & tx.contains_any(c, pack.STATEMENT_EXEMPT)
    )
    return [~period, ~statement]


# Advice, reasons and warning names of items 5 and 8.
PARTS_5 = [
    "작업장소 상호협의 또는 제공여부와 작업장소 관련 비용 계상 여부를 명시",
    "공급자가 작업장소를 제시할 수 있는 절차와 발주기관의 검토절차를 명시",
    "원격개발에 따른 보안사고 등 위험요인 식별 및 대응방안 제시 요구사항을 명시",
]
PARTS_8 = ["SW 하자담보 책임기간을 ‘1년’ 또는 ‘1년 이내’로 명시", f"{COMMON_STATEMENT}을 명시"]
REASON_8_PERIOD = "하자담보 책임 관련 내용은 확인되나, 하자담보 책임기간이 미작성되어 있습니다."
REASON_8_STATEMENT = "하자담보 책임기간은 확인되나, 용역계약일반조건 제58조 제2항·제3항에 따른 하자보수 조치 및 책임 범위에 관한 공통명시 내용이 미작성되어 있습니다."
REASON_8_BOTH = "하자담보 책임 관련 내용은 일부 확인되나, 하자담보 책임기간 및 용역계약일반조건 제58조 제2항·제3항에 따른 공통명시 내용이 미작성되어 있습니다."
WARN_8 = ["item_8_missing_valid_warranty_period", "item_8_missing_common_statement"]


def missing_item_5_8(review: DataFrame, due: Column | None = None) -> DataFrame:
    """Missing parts of items 5 and 8 from the joined evidence: rewritten advice, item 8 downgraded."""
    base = review.withColumn("_due", F.lit(True) if due is None else due).withColumn("_c", tx.compact(F.array_join("evidence_text", " ")))
    c = F.col("_c")
    g5, g8 = gaps_5(c), gaps_8(c)
    some5, some8 = g5[0] | g5[1] | g5[2], g8[0] | g8[1]
    is5 = F.col("_due") & (F.col("item_no") == "5") & (tx.strip(F.col("result")) != pack.COMPLIANT) & some5
    is8 = F.col("_due") & (F.col("item_no") == "8") & (tx.strip(F.col("result")) == pack.COMPLIANT) & some8
    advice5 = F.concat(F.lit("제안요청서에 "), F.concat_ws("하고, ", *[F.when(g, p) for g, p in zip(g5, PARTS_5)]), F.lit("하시기 바랍니다."))
    advice8 = F.concat(F.concat_ws(" 및 ", *[F.when(g, p) for g, p in zip(g8, PARTS_8)]), F.lit("하시기 바랍니다."))
    reason8 = F.when(g8[0] & g8[1], REASON_8_BOTH).when(g8[0], REASON_8_PERIOD).otherwise(REASON_8_STATEMENT)
    more = F.filter(F.array_compact(F.array(*[F.when(g, w) for g, w in zip(g8, WARN_8)])), lambda w: ~F.array_contains(F.col("warnings"), w))
    flagged = base.withColumn("_5", is5).withColumn("_8", is8)
    return (
        flagged.withColumn("recommendation", F.when(F.col("_5"), advice5).when(F.col("_8"), advice8).otherwise(F.col("recommendation")))
        .withColumn("reason", F.when(F.col("_8"), reason8).otherwise(F.col("reason")))
        .withColumn("warnings", F.when(F.col("_8"), F.concat("warnings", more)).otherwise(F.col("warnings")))
        .withColumn("result", F.when(F.col("_8"), pack.SUPPLEMENT).otherwise(F.col("result")))
        .drop("_due", "_c", "_5", "_8")
    )
