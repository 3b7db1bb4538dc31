"""One scan of the pages that yields every narrow row the item judgements need.

Each page gives at most one row per signal kind; judgements then aggregate these rows by document and never read
page text again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.operators import evidence as ev
from tenderlens.operators import requirements as rq
from tenderlens.rules import pack


@dataclass(frozen=True)
class Signal:
    kind: str
    when: Column
    text: Column
    score: Column
    mask: Column


def _signal(kind: str, when: Column, text: Column | None = None, score: Column | None = None, mask: Column | None = None) -> Signal:
    return Signal(
        kind, when, F.lit("") if text is None else text, F.lit(0) if score is None else score, F.lit(0) if mask is None else mask
    )


# Fixed values of the item rules.
DENIED = [
    "(?:본사업|본과업|해당사업)(?:은|는)[^.;。]{0,100}하도급(?:은|을|이)?(?:원칙적으로)?(?:불허|허용하지않)",
    "(?:본사업|본과업|해당사업)의하도급(?:은|을|이)?(?:원칙적으로)?(?:불허|허용하지않)",
]
SMALL_SW_TERMS = ["중소소프트웨어사업자", "중소SW사업자", "대기업", "중견기업", "입찰", "20억원", "40억원"]
CHECKLIST = [
    ("prior_approval", "하도급 사전 승인 안내"),
    ("ratio_limit", "하도급 비율 50% 초과 금지 안내"),
    ("resubcontract_ban", "재하도급 원칙적 불허 안내"),
    ("plan_submission", "하도급 계획서 제출 안내"),
    ("adequacy_confirmation", '"소프트웨어사업 하도급 계획 적정성 확인서" 제출 안내'),
    ("contract_criteria", "하도급 계약의 적정성 판단기준 사전 안내"),
]
SUMMARY_TERMS = [
    "기능 요구사항", "성능 요구사항", "데이터 요구사항", "보안 요구사항", "품질 요구사항", "제약사항",
    "프로젝트관리 요구사항", "프로젝트지원 요구사항",
]
WORKFORCE_TRIGGERS = [
    "투입인력", "투입 인력", "인력현황", "인력 현황", "이력사항", "이력 사항", "전문 인력", "전문인력", "업무분장", "업무 분장",
]
FUNCTION_SIGNALS = ["기능요구사항", "기능요구", "요구사항분류기능", "FUR-", "SFR-"]
TIE_RULE = "원점수기준의순위별점수차가차등점수보다큰경우"
SAME_SCORE = "동점인경우"


def subcontract_denied(c: Column) -> Column:
    plain = c.contains("하도급") & tx.contains_any(c, ["불허", "허용하지"])
    return plain & (c.rlike(DENIED[0]) | c.rlike(DENIED[1]))


def checklist_rules(c: Column) -> dict[str, Column]:
    sub = c.contains("하도급")
    return {
        "prior_approval": sub & c.contains("사전승인"),
        "ratio_limit": sub & tx.contains_all(c, ["50", "초과할수없"]),
        "resubcontract_ban": sub & c.contains("원칙적으로불허"),
        "plan_submission": sub & tx.contains_all(c, ["계획서", "제출"]),
        "adequacy_confirmation": c.contains("하도급계획적정성확인서")
        | (sub & tx.contains_all(c, ["적정성", "평가항목"]))
        | (c.contains("하도급계약") & tx.contains_all(c, ["적정성", "세부기준"])),
        "contract_criteria": sub & tx.contains_all(c, ["적정성", "판단"]),
    }


def small_sw_restricted(c: Column) -> Column:
    barred = c.contains("참여할수없음") | tx.contains_all(c, ["참여", "없음"])
    return tx.contains_all(c, ["20", "미만", "대기업", "중견기업", "입찰"]) & barred


def period_title(c: Column) -> Column:
    return tx.contains_all(c, ["소프트웨어개발사업", "적정사업기간", "종합산정서"])


def period_declared(b: Column) -> Column:
    return (
        b.contains("적정사업기간") & tx.contains_any(b, ["소프트웨어개발사업", "SW사업"])
        & tx.contains_any(b, ["본사업", "해당사업"]) & tx.contains_any(b, ["산정기준에따른사업", "제10조", "별지제4호서식"])
    )


def impact_title(c: Column) -> Column:
    return tx.contains_any(c, ["소프트웨어사업영향평가검토결과서", "소프트웨어사업영향평가결과서"])


def impact_declared(b: Column) -> Column:
    conducted = tx.contains_any(b, ["미리실시한사업", "실시한사업", "영향평가를실시"])
    attached = tx.contains_any(b, ["결과서첨부", "결과서를첨부", "별지제1호서식", "검토결과서첨부"])
    return tx.contains_any(b, ["소프트웨어사업영향평가", "SW사업영향평가"]) & (conducted | attached)


def score_table(t: Column) -> Column:
    return (
        (t.contains("평가항목") & t.contains("배점"))
        | t.contains("소프트웨어기술성평가기준")
        | tx.contains_all(t, ["하자보수", "비상 대책"])
    )


def _first_window(t: Column, low: Column, words: Sequence[str], radius: int, otherwise: Column) -> Column:
    return F.coalesce(tx.first_keyword_window(t, low, words, radius), otherwise)


def _reuse_quote(t: Column, low: Column, mask: Column) -> Column:
    """Window of the first satisfied requirement whose word occurs on the page."""
    found = [
        F.when((mask.bitwiseAND(1 << i) != 0) & tx.loose_any(low, [w]), tx.around(t, tx.loose_regex(w), 420))
        for i, w in enumerate(rq.REUSE_QUOTES)
    ]
    return F.coalesce(*found, tx.head(tx.collapse(t), 180))


def _prepared() -> tuple[Column, Column, Column, Column]:
    return F.col("page_text"), F.col("_c"), F.col("_low"), F.col("_b")


def _keyword(item: str, words: Sequence[str], mask: Column | None = None) -> Signal:
    t, _, low, _ = _prepared()
    return _signal(f"{item}:keyword", ~F.col("has_toc") & tx.loose_any(low, words), tx.first_keyword_window(t, low, words, 80), mask=mask)


def _rule_keyword(item: str) -> list[Signal]:
    return [_keyword(item, pack.RULE_KEYWORDS[item])]


def _item_2() -> list[Signal]:
    return [_signal("2:signal", ~F.col("has_toc") & ev.page_purchase_signal(F.col("_c")))]


def _item_3() -> list[Signal]:
    t, c, _, _ = _prepared()
    body = ~F.col("has_toc")
    known = tx.count_terms(c, SMALL_SW_TERMS)
    return _rule_keyword("3") + [
        _signal("3:full", body & small_sw_restricted(c), tx.evidence_window(t, "20", 420)),
        _signal("3:part", body & (known > 0), tx.evidence_window(t, "중소", 260), known),
    ]


def _item_4() -> list[Signal]:
    t, c, _, _ = _prepared()
    allowed = ev.allowed_evidence_page(c)
    window = tx.evidence_window(t, "하도급", 260)
    check, part = F.col("_check"), F.col("_part")
    return [
        _signal("4:deny", ~F.col("has_toc") & subcontract_denied(c), tx.evidence_window(t, "하도급", 160)),
        _signal("4:check", allowed & (check != 0), window, mask=check),
        _signal("4:part", allowed & (part != 0), window, F.bit_count(part)),
    ]


def _item_6() -> list[Signal]:
    t, c, low, _ = _prepared()
    reuse = F.col("_reuse")
    section = F.when(rq.reuse_section_signal(c, reuse), 128).otherwise(0)
    return [_signal("6:reuse", ~F.col("has_toc") & (reuse != 0), _reuse_quote(t, low, reuse), rq.reuse_score(c, reuse), reuse.bitwiseOR(section))]


def _table_pages(item: str) -> list[Signal]:
    candidate = F.col("has_eval_table") | F.col("has_table")
    quoted = tx.head(F.col("page_text"), 180)
    return [
        _signal(f"{item}:candidate", candidate, quoted),
        _signal(f"{item}:any", F.lit(True), quoted),
        _keyword(item, pack.TABLE_KEYWORDS[item], candidate.cast("int")),
    ]


def _item_11() -> list[Signal]:
    t, _, low, _ = _prepared()
    split = t.rlike(f"90[{tx.SPACE}]*(?:점|%)") & t.rlike(f"10[{tx.SPACE}]*(?:점|%)")
    quoted = _first_window(t, low, ["기술능력평가점수", "기술능력평가", "평가원칙"], 120, tx.head(t, 220))
    return [_signal("11:score", tx.contains_all(low, ["기술능력평가", "가격평가"]) & split, quoted)] + _table_pages("11")


def _item_12() -> list[Signal]:
    t, c, low, _ = _prepared()
    signal = low.contains("차등점수제") | tx.contains_all(low, ["순위간", "점수차"])
    plan = ev.subcontract_plan_score(t, low)
    rule_text = _first_window(t, low, ["차등점수", "순위간"], 220, tx.head(t, 260))
    rule_text = F.when(low.contains("미적용"), tx.evidence_window(t, "차등점수", 220)).otherwise(rule_text)
    table_text = F.when(plan, tx.evidence_window(t, "하도급", 180)).otherwise(
        _first_window(t, low, ["평가항목", "배점"], 180, tx.head(t, 260)))
    return [
        _signal("12:signal", signal, rule_text),
        _signal("12:off", tx.contains_all(low, ["차등점수제", "미적용"]), rule_text),
        _signal("12:deny", subcontract_denied(c), tx.evidence_window(t, "하도급", 180)),
        _signal("12:table", score_table(t), table_text, mask=plan.cast("int")),
    ] + _table_pages("12")


def _item_14() -> list[Signal]:
    t, _, low, _ = _prepared()
    body = ~F.col("has_toc")
    detail = tx.loose_count(low, ev.DETAIL_TERMS) >= 4
    summary = t.contains("요구사항 총괄표") & (tx.loose_count(low, SUMMARY_TERMS) >= 4)
    heading = F.when(t.contains("요구사항 상세 내역"), tx.evidence_window(t, "요구사항 상세 내역", 80))
    return _rule_keyword("14") + [
        _signal("14:detail", body & detail, heading.otherwise(tx.evidence_window(t, "요구사항 고유번호", 80))),
        _signal("14:summary", body & ~detail & summary, tx.evidence_window(t, "요구사항 총괄표", 80)),
    ]


def _attachment(item: str, title: Column, declared: Column, hint: str) -> list[Signal]:
    t, _, _, bare = _prepared()
    quoted = tx.head(t, 220)
    body, refers = ~F.col("has_toc"), ev.reference_only(bare, hint)
    return [
        _signal(f"{item}:declared", body & declared, quoted),
        _signal(f"{item}:title", body & title & ~refers, quoted, mask=F.when(title, ev.attachment_has_body(t, F.lit(hint)).cast("int"))),
        _signal(f"{item}:reference", body & title & refers, quoted),
        _signal(f"{item}:listed", F.col("has_toc") & title, quoted),
    ]


def _form_pages(item: str) -> list[Signal]:
    t, c, _, _ = _prepared()
    form = F.col("has_attachment") | F.col("has_blind") | F.col("has_commercial_sw")
    known = ev.known_title(c, item)
    bodied = F.when(known & ev.attachment_has_body(t, ev.best_title_hint(c, item)), 2).otherwise(0)
    return [
        _signal(f"{item}:candidate", form, tx.head(t, 180)),
        _signal(f"{item}:any", F.lit(True), tx.head(t, 180)),
        _keyword(item, pack.ATTACHMENT_KEYWORDS[item], form.cast("int")),
        _signal(f"{item}:known", ~F.col("has_toc") & known, tx.head(t, 260), mask=form.cast("int") + bodied),
    ]


def _item_15() -> list[Signal]:
    _, c, _, bare = _prepared()
    return _attachment("15", period_title(c), period_declared(bare), "소프트웨어 개발사업")


def _item_16() -> list[Signal]:
    t, c, _, _ = _prepared()
    body = ~F.col("has_toc")
    return [
        _signal("16:trigger", body & tx.contains_any(c, sorted({tx.squeeze(w) for w in WORKFORCE_TRIGGERS})), tx.evidence_window(t, "인력", 220)),
        _signal("16:function", body & tx.contains_any(c, FUNCTION_SIGNALS)),
    ]


def _item_17() -> list[Signal]:
    _, c, _, bare = _prepared()
    return _attachment("17", impact_title(c), impact_declared(bare), "소프트웨어사업 영향평가") + _form_pages("17")


def _item_18() -> list[Signal]:
    t, c, _, _ = _prepared()
    submission = tx.contains_any(c, ["제출", "작성및제출", "데이터작성"])
    method = tx.contains_any(c, ["www.spir.kr", "SPIR", "SW사업정보저장소", "제출방법"])
    told = F.when(submission, 1).otherwise(0) + F.when(method, 2).otherwise(0)
    mention = ~F.col("has_toc") & tx.contains_any(c, ["SW사업정보", "소프트웨어사업정보"])
    return _rule_keyword("18") + [_signal("18:mention", mention, tx.evidence_window(t, "SW사업정보", 260), mask=told)]


BY_ITEM = {
    "1": lambda: _rule_keyword("1"), "2": _item_2, "2-1": lambda: _form_pages("2-1"), "3": _item_3, "4": _item_4, "6": _item_6,
    "7": lambda: _rule_keyword("7"), "11": _item_11, "12": _item_12, "14": _item_14, "15": _item_15, "16": _item_16, "17": _item_17,
    "18": _item_18,
}


def page_signals(page: DataFrame, items: Sequence[str] | None = None) -> DataFrame:
    """(document_id, page_no, seq, display_no, kind, score, mask, text) for the wanted items."""
    prepared = page.withColumn("_c", tx.compact(F.col("page_text"))).withColumn("_b", tx.compact_attachment(F.col("page_text")))
    prepared = prepared.withColumn("_low", F.lower("_c"))
    c = F.col("_c")
    if items is None or "4" in items:
        prepared = prepared.withColumn("_check", ev.requirement_mask(checklist_rules(c))).withColumn(
            "_part", ev.requirement_mask(rq.subcontract_requirements(c)))
    if items is None or "6" in items:
        prepared = prepared.withColumn("_reuse", ev.requirement_mask(rq.reuse_requirements(c)))
    wanted = [s for item, build in BY_ITEM.items() if items is None or item in items for s in build()]
    found = [
        F.when(
            s.when,
            F.struct(F.lit(s.kind).alias("kind"), s.score.cast("int").alias("score"), s.mask.cast("int").alias("mask"), s.text.alias("text")),
        )
        for s in wanted
    ]
    return prepared.select(
        "document_id", "page_no", "seq", ev.shown_no().alias("display_no"), F.explode(F.array_compact(F.array(*found))).alias("s")
    ).select("document_id", "page_no", "seq", "display_no", "s.kind", "s.score", "s.mask", "s.text")
