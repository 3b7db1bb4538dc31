"""Report wording: internal assessments, compliance statements, report relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.functions import labels as lb
from tenderlens.functions import text as tx
from tenderlens.operators import blocks
from tenderlens.operators import evidence as ev
from tenderlens.rules import pack, rubric

KEY = ("document_id", "item_no")
W = tx.SPACE


# --- internal assessment ------------------------------------------------------------------------------------


def rubric_table(spark: SparkSession) -> DataFrame:
    rows = [(i, n, t, c, [[x.lower() for x in g] for g in req], [" ".join(g) for g in req], full, act) for i, n, t, c, req, full, act in rubric.ROWS]
    return spark.createDataFrame(
        rows, "item_no string, row_no string, title string, content string, terms array<array<string>>, labels array<string>, full_match int, missing_action string"
    )


def assess_rows(final: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row per rubric row: which requirements some evidence text states, and the quoted pairs."""
    key = list(key)
    lows = F.transform("evidence_text", tx.compact_lower)
    assessed = final.filter(F.col("item_no").isin(sorted({r[0] for r in rubric.ROWS})))  # told by the item alone, before any text is made
    base = assessed.select(*key, "evidence_pages", "evidence_text", lows.alias("_lows")).join(rubric_table(final.sparkSession), "item_no")

    def first_text(group: Column) -> Column:
        return F.array_position(F.transform("_lows", lambda t: F.forall(group, lambda x: F.contains(t, x))), F.lit(True)).cast("int")

    placed = base.withColumn("_at", F.transform("terms", first_text))
    matched = F.transform(F.filter(F.arrays_zip("labels", "_at"), lambda z: z["_at"] > 0), lambda z: z["labels"])

    def pair(at: Column) -> Column:
        return F.struct(F.try_element_at("evidence_pages", at).alias("page"), tx.ellipsis(F.element_at("evidence_text", at), 240).alias("text"))

    pairs = F.slice(F.array_distinct(F.transform(F.filter("_at", lambda a: a > 0), pair)), 1, 5)
    n = F.size("matched_requirements")
    return placed.withColumn("matched_requirements", matched).select(
        *key, "row_no", "title", "content",
        F.when(n >= F.col("full_match"), rubric.STATED).when(n > 0, rubric.PARTLY).otherwise(rubric.UNSTATED).alias("explicit_status"),
        "matched_requirements", "missing_action", pairs.alias("evidence_pairs"),
    )


def assessment_result(rows: DataFrame, key: Sequence[str] = KEY, edited: bool = False) -> DataFrame:
    """Result, reason and distinct actions of each assessed item."""
    key = list(key)
    stated = F.col("explicit_status") == rubric.STATED
    some = F.col("explicit_status").isin(rubric.STATED, rubric.PARTLY)
    lacking = F.concat("row_no", F.lit(". "), "title", F.lit("("), "explicit_status", F.lit(")"))
    place = F.col("row_no").cast("int").alias("n")
    grouped = rows.groupBy(*key).agg(
        F.bool_and(stated).alias("_all"), F.bool_or(some).alias("_some"),
        F.array_sort(F.collect_list(F.when(~stated, F.struct(place, lacking.alias("t"))))).alias("_l"),
        F.array_sort(F.collect_list(F.when(~stated, F.struct(place, F.col("missing_action").alias("t"))))).alias("_m"),
        F.array_sort(F.collect_list(F.struct(place, "row_no", "title", "content", "explicit_status"))).alias("assessment_rows"),
    )
    done = F.lit(rubric.R_ALL_EDITED if edited else rubric.R_ALL)
    return grouped.select(
        *key, F.when(F.col("_all"), pack.COMPLIANT).when(F.col("_some"), pack.SUPPLEMENT).otherwise(pack.NON_COMPLIANT).alias("final_result"),
        F.when(F.col("_all"), done).otherwise(F.concat(F.lit(rubric.R_MISSING), F.array_join(F.transform("_l", lambda x: x["t"]), ", "))).alias("assessment_reason"),
        F.array_join(F.array_distinct(F.transform("_m", lambda x: x["t"])), "\n").alias("assessment_recommendation"), "assessment_rows",
    )


def assessment_sentence(pages: Column) -> Column:
    shown = lb.format_pages(pages)
    fine = F.when(shown == "", "관련 문구 명시").otherwise(F.concat(F.lit("제안요청서 "), shown, F.lit(" 명시")))
    rest = F.coalesce(F.nullif("assessment_recommendation", F.lit("")), F.nullif("assessment_reason", F.lit("")), F.lit(rubric.EDIT_DEFAULT))
    return F.when(F.col("final_result") == pack.COMPLIANT, fine).otherwise(tx.strip(rest))


def assessment_copy_text(title: Column) -> Column:
    """Tab-separated text of the assessment table."""
    rows = F.transform("assessment_rows", lambda r: F.concat(r["row_no"], F.lit("\t"), r["title"], F.lit("\n"), r["content"], F.lit("\t"), r["explicit_status"]))
    lines = F.concat(
        F.array(F.concat("item_no", F.lit(". "), title), F.lit(""), F.lit(rubric.COLUMNS)), rows,
        F.array(F.lit(""), F.concat(F.lit("최종 판단\t"), "final_result"), F.concat(F.lit("판단 근거\t"), "assessment_reason")),
    )
    return tx.strip(F.array_join(lines, "\n"))


def assessment_title(item: Column) -> Column:
    out = F.lit("")
    for k, v in rubric.TITLES.items():
        out = F.when(item == k, v).otherwise(out)
    return out


def assessment_text(final: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    result = assessment_result(assess_rows(final, key), key).join(final.select(*key, "evidence_pages"), list(key))
    return result.select(
        *key, "final_result", "assessment_reason", "assessment_recommendation", assessment_sentence(F.col("evidence_pages")).alias("compliance_text"),
        assessment_copy_text(assessment_title(F.col("item_no"))).alias("copy_text"),
    )


# --- evidence that bears on the rule itself ----------------------------------------------------------------------


def _pairs() -> Column:
    zipped = F.arrays_zip(F.col("evidence_pages").alias("page"), F.col("evidence_text").alias("text"))
    return F.filter(zipped, lambda p: p["page"].isNotNull())


def direct_pairs() -> Column:
    return F.filter(_pairs(), lambda p: ~ev.context_only(F.coalesce(p["text"], F.lit(""))))


def direct_pages(pairs: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["page"])))


# --- recommendations -------------------------------------------------------------------------------------------------

# Patterns of page references, lead-ins, examples and generic advice.
PAGE_REFERENCE = f"^[{W}]*제안요청서[{W}]+(?:p{{1,2}}\\.[{W}]*\\d+(?:[{W}]*[-~][{W}]*\\d+)?(?:[{W}]*,[{W}]*)?)+(?:에|에는|의|에서)?[{W}]*"
LEAD = f"^[{W}]*제안요청서에[{W}]*"
LEAD_ETC = f"^[{W}]*제안요청서[{W}]+등에[{W}]*"
QUOTED_LEAD_ETC = f"([‘'\"])[{W}]*제안요청서[{W}]+등에[{W}]*"
EXAMPLE = f"(?s)[{W}]*(?:예를[{W}]*들어|예시(?:로|:)?|예컨대).*"
EXAMPLE_SIGNS = ["예를", "예시", "예컨대"]
EXCEPTION = f"(?s)[{W}]*(?:※|단,|다만,).*"
GENERIC = ["관련문구", "필수문구", "누락된", "누락", "모두명시", "보완하시기", "준수로판단"]
IMPACT_ACTION = "SW사업 영향평가 결과서를 작성하여 첨부하시기 바랍니다."


def after_arrow(text: Column) -> Column:
    return tx.let(tx.strip(text), lambda clean: F.when(clean.contains("->"), tx.strip(F.element_at(F.split(clean, "->", 2), -1))).otherwise(clean))


def strip_references(text: Column) -> Column:
    """Advice without the page numbers of an example document."""

    def without(said: Column) -> Column:
        t = tx.strip(F.regexp_replace(said, PAGE_REFERENCE, ""))
        t = tx.strip(F.regexp_replace(t, LEAD, "제안요청서에 "))
        t = tx.strip(F.regexp_replace(t, LEAD_ETC, "제안요청서에 "))
        # every pattern names the document
        return F.when(said.contains("제안요청서"), F.regexp_replace(t, QUOTED_LEAD_ETC, "$1")).otherwise(said)

    return tx.let(after_arrow(text), without)


def is_generic(text: Column) -> Column:
    return tx.let(tx.compact_lower(text), lambda low: tx.count_terms(low, GENERIC) >= 2)


def partial_action(recommendation: Column) -> Column:
    def judge(action: Column) -> Column:
        impact = tx.let(tx.compact_lower(action), lambda low: tx.contains_any(low, ["소프트웨어사업영향평가", "sw사업영향평가"]) & low.contains("결과서"))
        return F.when(impact, IMPACT_ACTION).otherwise(action)

    def without_example(said: Column) -> Column:
        return tx.strip(F.when(tx.contains_any(said, EXAMPLE_SIGNS), F.regexp_replace(said, EXAMPLE, "")).otherwise(said))

    return tx.let(tx.let(strip_references(recommendation), without_example), judge)


def cleanup_requirement(text: Column) -> Column:
    t = tx.strip(F.regexp_replace(tx.collapse(text), EXCEPTION, ""))
    for pattern in [f"^제안요청서[{W}]*등에[{W}]*", f"^제안요청서에[{W}]*", f"^(ㅁ|ㅇ|-)[{W}]*", f"(을|를)?[{W}]*명시[{W}]*$"]:
        t = tx.strip(F.regexp_replace(t, pattern, ""))
    return t


def tagged_value(text: Column, name: str) -> Column:
    pattern = f"(?ms)^[{W}]*{name}[{W}]*:[{W}]*(.+?)(?=\\n[{W}]*[A-Za-z_]+_?text[{W}]*:|\\n[{W}]*\\[[A-Z ]+\\]|\\z)"
    return tx.strip(F.regexp_extract(text, pattern, 1))


def missing_requirements(hits: DataFrame) -> DataFrame:
    """Requirement text of each item's first criteria hit that carries one: core text first, then the full text."""
    rows = hits.filter("source_type <> 'tacit_knowledge'")
    found = rows.select(
        F.col("query_item").alias("item_no"), "rank_group", "rank",
        F.posexplode(F.array(tagged_value(F.col("snippet"), "core_requirement_text"), tagged_value(F.col("snippet"), "requirement_text"))).alias("k", "v"),
    ).filter("v <> ''")
    return found.groupBy("item_no").agg(F.min_by("v", F.struct("k", "rank_group", "rank")).alias("_v")).select(
        "item_no", cleanup_requirement(F.col("_v")).alias("requirement")
    )


def concrete_recommendation(item: Column, recommendation: Column, reason: Column, requirement: Column) -> Column:
    asked = F.concat(F.lit("제안요청서에 ‘"), requirement, F.lit("’에 관하여 명시하시기 바랍니다."))
    named = F.coalesce(F.length(requirement) > 0, F.lit(False))

    def judge(base: Column) -> Column:
        low = tx.compact_lower(base)
        impact = (item == "17") & low.contains("영향평가") & low.contains("결과서")
        kept = ~named | ((base != "") & ~is_generic(base))
        return F.when(impact, IMPACT_ACTION).when(F.coalesce(kept, F.lit(False)), strip_references(base)).otherwise(asked)

    return tx.let(tx.strip(F.coalesce(F.nullif(recommendation, F.lit("")), reason)), judge)


# --- compliance statements -----------------------------------------------------------------------------------------------

# Signs of empty and of partial attachments in a reason.
EMPTY_SIGNS = ["제목만", "빈문서", "실제산정내용이없는", "실제검토내용이없는", "실제검토내용이확인되지"]
PARTIAL_SIGNS = ["일부", "있으나", "확인되나", "제목만", "미흡", "부족"]


def compliance_content(final: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Statement text with its pages and warnings, for every final row.  Added columns only."""
    if hits is not None:
        final = final.join(missing_requirements(hits), "item_no", "left")
    else:
        final = final.withColumn("requirement", F.lit(None).cast("string"))
    label = lb.wording_label(F.col("final_result"), F.col("is_target"))
    item, lab, shown, rec = F.coalesce("item_no", F.lit("")), F.col("_label"), F.col("_shown"), F.col("_rec")
    gap = [pack.SUPPLEMENT, pack.NON_COMPLIANT]
    ok, off = lab == pack.COMPLIANT, lab == pack.NOT_APPLICABLE
    fourteen, sixteen, nine = (item == "14") & ok, item == "16", (item == "9") & ok
    # texts are judged and advice is made only for the rows whose statement, pages or warning ask for them
    paged, advised = ~off & (sixteen | (ok & ~fourteen & ~nine) | lab.isin(gap)), lab.isin(gap) & ~sixteen
    base = final.withColumn("_label", label).withColumn("_direct", F.when(paged, direct_pairs()))
    base = base.withColumn("_pages", direct_pages(F.col("_direct")))
    base = base.withColumn("_shown", lb.format_pages(F.col("_pages"))).withColumn(
        "_rec", F.when(advised, concrete_recommendation(F.col("item_no"), F.col("recommendation"), F.col("reason"), F.col("requirement"))))
    has = shown != ""
    texts = F.filter(F.transform("_direct", lambda p: F.coalesce(p["text"], F.lit(""))), lambda t: t != "")
    context = tx.compact_lower(F.concat_ws(" ", F.coalesce("reason", F.lit("")), F.array_join(texts, " ")))
    partial = tx.let(context, lambda c: ~tx.contains_any(c, EMPTY_SIGNS) & tx.contains_any(c, PARTIAL_SIGNS))
    base = base.withColumn("_action", F.when(advised & has, partial_action(rec))).withColumn(
        "_partial", F.when(advised & has & (lab == pack.NON_COMPLIANT) & (rec != ""), partial))
    own = tx.strip(F.coalesce("recommendation", F.lit("")))
    doc = F.lit("제안요청서 ")
    first = F.array_min("evidence_pages")
    from_first = F.when(F.size("evidence_pages") > 0, F.concat(F.lit("제안요청서 p."), first.cast("string"), F.lit(" 이하 명시"))).otherwise("")
    staff = F.when((own != "") & lab.isin(gap), F.concat(F.when(has, F.concat(doc, shown, F.lit("에 투입인력 요구사항이 확인됩니다.\n"))).otherwise(""), F.lit("-> "), own))
    staff = staff.when(F.coalesce("is_target", F.lit(False)), F.when(has, F.concat(doc, shown, F.lit(" 기준 대상 사업으로 판단"))).otherwise("대상 사업으로 판단"))
    staff = staff.otherwise("대상여부 확인필요")
    stated = F.when(has, F.concat(doc, shown, F.lit(" 명시"))).otherwise("")
    after = tx.strip(F.regexp_replace(F.col("_action"), f"^[{W}]*제안요청서에[{W}]*", ""))
    particle = F.when(F.ltrim(after).rlike("^(?:제안서|제안요청서|평가항목|배점표)"), "").otherwise("에")
    joined = F.concat(doc, shown, particle, F.lit(" "), after)
    partly = F.concat(doc, shown, F.lit(" 일부 명시\n→ "), F.col("_action"))
    advice = F.when(rec == "", "").when(~has, F.when(lab == pack.NON_COMPLIANT, rec).otherwise("")).when(
        (lab == pack.SUPPLEMENT) | F.col("_partial"), partly).otherwise(joined)
    content = (
        F.when(off, pack.NOT_APPLICABLE).when(fourteen, from_first).when(sixteen, staff).when(nine, "특정규격 명시 없음").when(ok, stated)
        .when(lab.isin(gap), advice).otherwise("")
    )
    none = F.expr("cast(array() as array<int>)")
    used = (
        F.when(off | nine, none).when(fourteen, F.when(F.size("evidence_pages") > 0, F.array(first)).otherwise(none)).when(sixteen | ok, F.col("_pages"))
        .when(lab.isin(gap) & (rec != "") & has, F.col("_pages")).otherwise(none)
    )
    warn = (
        F.when(off | sixteen | nine, F.lit(None)).when(fourteen | ok, F.when(F.col("_content") == "", "missing_evidence_pages"))
        .when(lab.isin(gap), F.when(rec == "", "missing_recommendation").when(~has & (lab == pack.SUPPLEMENT), "missing_direct_evidence_pages"))
        .otherwise("unknown_result")
    )
    out = base.withColumn("_content", content).withColumn("content_pages", used)
    out = out.withColumn("content_warnings", F.array_compact(F.array(warn.cast("string")))).withColumnRenamed("_content", "compliance_content")
    return out.drop("_label", "_direct", "_pages", "_shown", "_rec", "_action", "_partial", "requirement")


# --- report -------------------------------------------------------------------------------------------------------------------


def item_label(item: Column) -> Column:
    name = F.lit("검토항목")
    for k, v in pack.ITEM_NAMES.items():
        name = F.when(item == k, v).otherwise(name)
    return F.concat(item, F.lit(". "), name)


def reportable_pairs() -> Column:
    """Pairs for the report: scope-only texts left out unless the item does not apply."""
    label = lb.report_label(F.col("item_no"), F.col("final_result"), F.col("is_target"), F.col("final_status"))
    every = (label == pack.NOT_APPLICABLE) | (F.col("item_no") == "16")
    keep = F.filter(_pairs(), lambda p: F.coalesce(p["text"] == "", F.lit(True)) | ~ev.target_only(tx.compact(p["text"])))
    return F.when(every, _pairs()).otherwise(keep)


BASIS_9 = (
    "판단근거: 특정규격 명시 없음. RFP 본문에서 특정 상표, 모델명, 특정 제품에 종속된 기술용어가 확인되지 않아 "
    "해당 기준을 충족하는 것으로 판단됩니다."
)


def compliance_report(final: DataFrame) -> DataFrame:
    """Label, basis text and recheck flag of every final row.  Added columns only."""
    base = final.withColumn("report_label", lb.report_label(F.col("item_no"), F.col("final_result"), F.col("is_target"), F.col("final_status"))).withColumn("_p", reportable_pairs())

    def line(p: Column) -> Column:
        said = F.concat(F.lit("p."), p["page"].cast("string"), F.lit(" "))
        return tx.let(tx.ellipsis(p["text"], 260), lambda snippet: F.when(snippet != "", F.concat(said, snippet)))

    bare = F.array_join(F.transform(F.slice("_p", 1, 5), lambda p: F.concat(F.lit("p."), p["page"].cast("string"))), ", ")
    trigger = tx.let(
        F.array_compact(F.transform(F.slice("_p", 1, 5), line)), lambda lines: F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(bare)
    )
    part = lambda head, c: F.when(F.length(c) > 0, F.concat(F.lit(head), c))
    parts = F.concat_ws("\n", part("개선권고: ", F.col("recommendation")), part("판단근거: ", F.col("reason")), part("RFP 트리거: ", F.col("_trigger")))
    nine = (F.col("item_no") == "9") & (F.col("report_label") == pack.COMPLIANT)
    auto = (F.col("final_status") == pack.STATUS_AUTO) & (F.size("warnings") == 0)
    return (
        base.withColumn("_trigger", trigger)
        .withColumn("basis_text", F.when(nine, BASIS_9).when(parts == "", "근거 확인 필요").otherwise(parts))
        .withColumn("human_recheck", F.when(auto, "아니오").otherwise("예"))
        .withColumn("item_label", item_label(F.col("item_no")))
        .drop("_p", "_trigger")
    )


# Coverage rows of the detail comments of items 5 and 6 (description, term lists that must all be met).
DETAIL_5 = [
    ("작업장소 상호협의 또는 제공여부 및 관련 비용 계상여부", [["작업장소 등은 상호 협의", "작업장소 상호협의", "사업예산 내 계상", "관련 비용을 포함"]]),
    ("공급자에 의한 작업장소 제시 및 발주기관의 검토절차", [["작업장소를 제시", "공급자 제시", "제시된 작업장소", "개발방법 등에 대한 구체적인 방안"]]),
    ("작업장소 관련 보안요구사항", [["원격지 보안관리", "보안요구사항", "보안사고", "출입보안", "출입통제"]]),
]
DETAIL_6 = [
    ("제안요청서 등에 지식재산의 공동귀속 적용 여부", [["지식재산권 귀속", "지식재산 공동귀속", "공동으로 소유", "용역계약일반조건"]]),
    ("SW산출물 반출 요청절차", [["산출물의 반출", "산출물 반출", "반출을 요청"]]),
    ("누출금지정보 삭제 및 확약서 제출", [["누출금지정보", "누출금지 정보"], ["확약서", "삭제"]]),
    ("제3자 제공 시 발주기관 사전승인", [["제3자", "제 3자", "제3자에게"], ["사전승인", "사전 승인"]]),
    ("무단 유출/누출금지정보 미삭제 시 입찰참가자격 제한", [["무단 유출", "무단으로 유출", "누출되는 경우"], ["입찰 참가 자격", "입찰참가자격", "입찰 참가 자격을 제한"]]),
]


def _coverage_comment(rows: list, evidence: Column) -> Column:
    def absent(c: Column) -> Column:
        missing = []
        for description, groups in rows:
            met = F.lit(True)
            for g in groups:
                met = met & tx.contains_any(c, sorted({tx.squeeze(t) for t in g}))
            missing.append(F.when(~met, F.lit(description)))
        return F.array_join(F.array_compact(F.array(*missing)), ", ")

    gaps = tx.let(tx.compact(evidence), absent)
    shown = lb.format_pages_report(F.col("evidence_pages"))
    return tx.let(
        F.struct(gaps.alias("g"), shown.alias("p")),
        lambda s: F.when(s["g"] == "", F.when(s["p"] == "", "관련 문구 명시").otherwise(F.concat(F.lit("제안요청서 "), s["p"], F.lit(" 명시"))))
        .when(s["p"] == "", F.concat(F.lit("일부 미명시 - "), s["g"]))
        .otherwise(F.concat(F.lit("제안요청서 "), s["p"], F.lit(" 일부 미명시 - "), s["g"])),
    )


def detail_comments(final: DataFrame) -> DataFrame:
    """Copy-ready comment of every final row.  Needs `report_label`; uses `compliance_content` when present."""
    if "report_label" not in final.columns:
        final = compliance_report(final)
    given = F.col("compliance_content") if "compliance_content" in final.columns else F.lit("")
    base = final.withColumn("_rp", reportable_pairs())
    base = base.withColumn("_shown", lb.format_pages_report(F.transform("_rp", lambda p: p["page"]))).withColumn(
        "_joined", F.array_join(F.transform("_rp", lambda p: F.coalesce(p["text"], F.lit(""))), " "))
    shown, lab, item = F.col("_shown"), F.col("report_label"), F.col("item_no")
    has, doc = shown != "", F.lit("제안요청서 ")
    ok = lab == pack.COMPLIANT

    def judged(word: str) -> Column:
        return F.when(has, F.concat(doc, shown, F.lit(f" 기준 {word} 사업으로 판단"))).otherwise(f"{word} 사업으로 판단")

    staff = F.when(F.col("is_target").isNull(), "대상여부 확인필요").when(F.col("is_target"), judged("대상")).otherwise(judged("비대상"))
    fine = (
        F.when(item == "5", _coverage_comment(DETAIL_5, F.col("_joined"))).when(item == "6", _coverage_comment(DETAIL_6, F.col("_joined")))
        .when(item == "9", "특정규격 명시 없음")
        .when((item == "14") & (F.size("evidence_pages") > 0), F.concat(F.lit("제안요청서 p."), F.array_min("evidence_pages").cast("string"), F.lit(" 이하 명시")))
        .when(has, F.concat(doc, shown, F.lit(" 명시"))).otherwise("관련 문구 명시")
    )
    own, why = F.nullif("recommendation", F.lit("")), F.nullif("reason", F.lit(""))
    advice = F.coalesce(own, why, F.lit("관련 법령 기준에 맞게 보완하시기 바랍니다."))
    gap = F.when(item.isin("12", "15", "17") & own.isNotNull(), own).when(has, F.concat(doc, shown, F.lit(" 일부 명시\n→ "), advice)).otherwise(advice)
    comment = (
        F.when(ok & (F.length(F.coalesce(given, F.lit(""))) > 0), given).when(item == "16", staff).when(ok, fine).when(lab == pack.NOT_APPLICABLE, pack.NOT_APPLICABLE)
        .when(lab.isin(pack.NON_COMPLIANT, pack.SUPPLEMENT), gap).otherwise(F.concat(F.lit("확인필요 - "), F.coalesce(why, F.lit("자동 판정 근거가 부족합니다."))))
    )
    return base.withColumn("detail_comment", comment).drop("_rp", "_shown", "_joined")


# --- opinion -----------------------------------------------------------------------------------------------------------------------

PAGE_LIST = f"p{{1,2}}\\.[{W}]*\\d+(?:[{W}]*[-~][{W}]*\\d+)?(?:[{W}]*,[{W}]*)*"
COMMON_8 = [
    f"\\(계약예규\\)[{W}]*용역계약일반조건[{W}]*제58조[{W}]*제2항과[{W}]*제3항에[{W}]*따라",
    f"용역계약일반조건[{W}]*제58조[{W}]*제2항[·ㆍ, ]*제3항(?:에[{W}]*따라)?",
]
SHORTENED = [
    ("제안요청서에 ", ""), ("제안요청서 내 ", ""), ("제안요청서 ", ""), ("작성하여 첨부하시기 바랍니다.", "첨부 필요"), ("첨부하시기 바랍니다.", "첨부 필요"),
    ("명시하시기 바랍니다.", "명시 필요"), ("하시기 바랍니다.", "필요"), ("하여야 합니다.", "필요"),
]


def concise(text: Column, limit: int = 90) -> Column:
    """Leading clauses that fit in `limit` characters."""
    flat = tx.collapse(text)

    def cut(c: Column) -> Column:
        parts = F.filter(F.transform(F.split(c, "(?:,| 및 | 또한 | 그리고 |\\.|\\n)"), tx.strip), lambda p: p != "")
        state = F.struct(F.lit("").alias("kept"), F.lit(True).alias("open"))

        def step(acc: Column, p: Column) -> Column:
            longer = F.when(acc["kept"] == "", p).otherwise(F.concat(acc["kept"], F.lit(", "), p))
            fits = acc["open"] & (F.length(longer) <= limit)
            return F.struct(F.when(fits, longer).otherwise(acc["kept"]).alias("kept"), fits.alias("open"))

        kept = F.aggregate(parts, state, step, lambda a: a["kept"])
        return F.when(F.length(c) <= limit, c).otherwise(tx.let(kept, lambda k: F.when(k != "", k).otherwise(F.regexp_replace(tx.head(c, limit), f"[{W}]+$", ""))))

    return tx.let(flat, cut)


def opinion_line(item: Column, content: Column) -> Column:
    def named(t: Column) -> Column:
        eight = t
        for p in COMMON_8:
            eight = F.regexp_replace(eight, p, "공통명시문장 추가 필요")
        return F.when(item == "8", eight).otherwise(t)

    t = tx.let(tx.collapse(content), named)
    t = F.replace(t, F.lit("→"), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, f"제안요청서[{W}]*{PAGE_LIST}", ""), PAGE_LIST, "")
    for old, new in SHORTENED:
        t = F.replace(t, F.lit(old), F.lit(new))
    t = tx.strip(F.regexp_replace(t, f"^[{W}]*(일부[{W}]*)?명시[{W}]*", ""))

    def judge(t: Column) -> Column:
        impact = (item == "17") & t.contains("영향평가") & t.contains("결과서")
        return F.when(impact, "SW사업 영향평가 결과서 첨부 필요").otherwise(tx.let(concise(t), lambda c: F.when(c == "", "보완 필요").otherwise(c)))

    return tx.let(t, judge)


def opinion_summary(output: DataFrame) -> DataFrame:
    """Opinion text per document over its items.

    Input: document_id, item_no, position, law_name, normalized_result, compliance_content, recommendation, reason.
    """
    text = F.coalesce(*[F.nullif(c, F.lit("")) for c in ["compliance_content", "recommendation", "reason"]], F.lit(""))
    title = F.coalesce(F.nullif("law_name", F.lit("")), F.concat("item_no", F.lit("번 항목")))
    lines = F.concat("item_no", F.lit(". "), title, F.lit("\n  - "), opinion_line(F.col("item_no"), text))
    bad, gap = F.col("normalized_result") == pack.NON_COMPLIANT, F.col("normalized_result") == pack.SUPPLEMENT
    listed = F.when(bad | gap, F.struct(F.when(bad, 0).otherwise(1).alias("g"), "position", lines.alias("t")))
    doc = output.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(bad).alias("non_compliant_count"), F.count_if(gap).alias("needs_revision_count"), F.array_sort(F.collect_list(listed)).alias("_l")
    )
    head = F.concat(F.lit("ㅇ 총 "), F.col("total_count").cast("string"), F.lit("개 항목 중 "), F.col("non_compliant_count").cast("string"), F.lit("개 항목 미준수"))
    head = F.when(F.col("needs_revision_count") > 0, F.concat(head, F.lit(", "), F.col("needs_revision_count").cast("string"), F.lit("개 항목 보완필요"))).otherwise(head)
    body = F.concat(F.array(head), F.transform("_l", lambda x: x["t"]))
    return doc.withColumn("copy_text", F.regexp_replace(F.array_join(body, "\n"), f"[{W}]+$", "")).drop("_l")


# --- review screen ---------------------------------------------------------------------------------------------------------------------

LOW_CONFIDENCE = 0.75


def review_output(final: DataFrame, criteria: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Wide review row: criteria, internal assessment, attention flag and reasons.

    Needs `compliance_content`; `requires_adjudication` is used when present.
    """
    key = list(key)
    assessed = assessment_result(assess_rows(final, key), key).withColumnRenamed("final_result", "_a")
    joined = final.join(assessed, key, "left").join(criteria.select("item_no", F.col("title").alias("law_name"), F.col("target_text"), "requirement_texts"), "item_no", "left")
    has = F.col("_a").isNotNull()
    adjudicate = F.coalesce("requires_adjudication", F.lit(False)) if "requires_adjudication" in final.columns else F.lit(False)
    reasons = F.array_compact(F.array(
        F.when(F.col("confidence") < LOW_CONFIDENCE, "confidence_low"), F.when((F.size("evidence_pages") <= 0) | (F.size("evidence_text") <= 0), "evidence_missing"),
        F.when(F.size("warnings") > 0, "review_warnings"), F.when(adjudicate, "verification_requires_adjudication"),
    ))
    label = F.when(has, F.col("_a")).otherwise(lb.service_label(F.col("final_result")))
    shown = joined.withColumn("normalized_result", label).withColumn("review_result", F.when(has, F.col("_a")).otherwise(F.col("final_result")))
    sentence = assessment_sentence(F.col("evidence_pages"))
    plain = shown.withColumn("_saved", F.col("final_result")).withColumn("final_result", F.coalesce("_a", "final_result"))
    plain = plain.withColumn("compliance_content", F.when(has, sentence).otherwise(F.coalesce("compliance_content", F.lit(""))))
    return (
        plain.withColumn("final_result", F.col("_saved"))
        .withColumn("reason", F.when(has, F.col("assessment_reason")).otherwise(F.col("reason")))
        .withColumn("attention_reasons", reasons)
        .withColumn("needs_user_attention", F.size("attention_reasons") > 0)
        .drop("_a", "_saved", "assessment_rows", "assessment_reason", "assessment_recommendation")
    )


def workflow_gate(output: DataFrame) -> DataFrame:
    """Per document: actions still due, whether recommendations may be generated, whether every item is complete."""
    return output.groupBy("document_id").agg(
        F.count_if("needs_user_attention").alias("user_action_required_count"),
        F.bool_and((F.length("normalized_result") > 0) & (F.length("compliance_content") > 0)).alias("all_items_complete"),
    ).withColumn("can_generate_recommendations", F.col("user_action_required_count") == 0)


def content_report(rows: DataFrame) -> DataFrame:
    """Best row per item over result files, in natural item order.

    Input: source_file, item_no, generated_content, selected_pages, confidence and any payload.
    """
    f = F.col("source_file")
    rank = F.when(f.contains("rule_no_api"), 4).when(f.contains("type3"), 3).when(f.contains("type2"), 2).when(f.contains("type1"), 1).otherwise(0)
    order = F.struct(
        (-F.lower(f).contains("patch").cast("int")).alias("a"), (-(tx.strip(F.col("generated_content")) != "").cast("int")).alias("b"),
        (-(tx.strip(F.col("selected_pages")) != "").cast("int")).alias("c"), (-F.coalesce("confidence", F.lit(0.0))).alias("d"), (-rank).alias("e"), f.alias("f"), F.col("row_seq").alias("g"),
    )
    rest = [c for c in rows.columns if c != "item_no"]
    best = rows.filter(F.length("item_no") > 0).groupBy("item_no").agg(F.min_by(F.struct(*rest), order).alias("r")).select("item_no", "r.*")
    main = F.coalesce(F.regexp_extract("item_no", f"^[{W}]*(\\d+)(?:-(\\d+))?[{W}]*$", 1).try_cast("int"), F.lit(9999))
    sub = F.when(main == 9999, 9999).otherwise(F.coalesce(F.regexp_extract("item_no", "-(\\d+)", 1).try_cast("int"), F.lit(0)))
    return best.withColumn("main_no", main).withColumn("sub_no", sub).withColumn("recommendation", after_arrow(F.col("recommendation"))).orderBy("main_no", "sub_no", "item_no")


def report_tables(final: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three relations of the report: compliance, detail, opinion lines."""
    reported = detail_comments(compliance_report(final))
    compliance = reported.select("document_id", "item_no", "item_label", "report_label", "basis_text", "human_recheck")
    detail = reported.select("document_id", "item_no", F.concat(F.lit("["), "report_label", F.lit("] "), "item_label").alias("heading"), "detail_comment")
    text = F.coalesce(F.nullif("recommendation", F.lit("")), F.nullif("reason", F.lit("")), F.lit("관련 기준에 맞게 보완 필요"))
    opinion = reported.filter(F.col("report_label").isin(pack.NON_COMPLIANT, pack.SUPPLEMENT)).select(
        "document_id", "item_no", F.when(F.col("report_label") == pack.NON_COMPLIANT, 0).otherwise(1).alias("section"), "item_label", F.concat(F.lit(" - "), text).alias("line")
    )
    return compliance, detail, opinion
