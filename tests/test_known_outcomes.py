"""Small cases with outcomes worked out by hand."""

from pyspark.sql import functions as F

from tenderlens.functions import labels as lb
from tenderlens.functions import text as tx
from tenderlens.operators import audit, classify, evidence, external, feedback, judgements, pages, signals, verify, wording
from tenderlens.rules import pack
from tenderlens.schema import REVIEW
from tests.conftest import page_row

REVIEW_DEFAULT = {
    "document_id": 1, "item_no": "4", "seq": 1, "route_type": "rule_review", "result": "준수", "is_target": True, "confidence": 0.8,
    "evidence_pages": [1], "evidence_text": ["근거"], "reason": "", "recommendation": "", "needs_human_review": False, "source": "python_rule",
    "warnings": [], "used_llm": False,
}


def reviews(spark, *rows):
    return spark.createDataFrame([tuple({**REVIEW_DEFAULT, **r}[f] for f in REVIEW.fieldNames()) for r in rows], REVIEW)


def statuses(spark, status="ok"):
    return spark.createDataFrame([(1, status)], "document_id bigint, parse_status string")


def documents(spark, total=5):
    return spark.createDataFrame([(1, "d", total)], "document_id bigint, document_name string, total_pages int")


def item(spark, make_pages, rows, item_no, judge):
    page = make_pages(rows)
    return judge(signals.page_signals(page, [item_no]), documents(spark), page).collect()[0]


def test_fill_printed_numbers(make_pages):
    rows = pages.fill_printed_page_no(make_pages([page_row(60, printed=57), page_row(61), page_row(62, printed=99)])).orderBy("page_no").collect()
    assert [r.printed_page_no for r in rows] == [57, 58, 99]


def test_dedupe_keeps_the_clean_page(make_pages):
    rows = pages.dedupe_pages(make_pages([
        page_row(56, "", warning="OCR empty", seq=1), page_row(57, "다음 쪽", seq=2), page_row(56, "표가 있는 본문 서른다섯 글자", seq=3, has_table=True)]))
    got = rows.orderBy("page_no").collect()
    assert [(r.page_no, r.seq) for r in got] == [(56, 3), (57, 2)]


def test_replace_pages(spark, make_pages):
    old = make_pages([page_row(1, "a"), page_row(2, "", warning="failed"), page_row(3, "", warning="failed")])
    new = make_pages([page_row(2, "새 본문")])
    after, status, rejected = pages.replace_pages(old, new)
    got = {r.page_no: (r.page_text, r.parser_warning) for r in after.collect()}
    assert got[2] == ("새 본문", None) and got[3] == ("", "failed")
    assert status.collect()[0].parse_status == "warning"
    assert rejected.count() == 0
    both = make_pages([page_row(2, "x"), page_row(2, "y", seq=9), page_row(1, "z", doc=7)])
    _, _, refused = pages.replace_pages(old, both)
    assert sorted(r.reject_reason for r in refused.collect()) == ["duplicate_page", "duplicate_page", "unknown_document"]


def test_reconcile_page_numbers(spark):
    df = spark.createDataFrame([([4, 5, 6], ["3", "3", "6"])], "a array<int>, b array<string>")
    assert df.select(pages.reconcile_page_no(F.col("a"), F.col("b")).alias("p")).collect()[0].p == [4, 5, 6]


def test_index_page_has_no_page_warning(make_pages):
    page = make_pages([page_row(1, "붙임 1 서약서\n붙임 2 확인서\n서식 3", warning="layout")])
    assert audit.page_warnings(page).count() == 0


def test_partial_extraction_has_no_absence_warning(spark, make_pages):
    page = make_pages([page_row(1, "사업 개요"), page_row(2, "본문")])
    assert audit.absence_warnings(page, documents(spark, 76)).count() == 0
    assert audit.missing_sections(page, documents(spark, 76)).count() == 0


def test_section_split_by_a_page_break(spark, make_pages):
    page = make_pages([page_row(1, "제1장 사업 "), page_row(2, "  "), page_row(3, "개요 및 요구"), page_row(4, "사항, 배점")])
    assert audit.missing_sections(page, documents(spark, 4)).count() == 0


def test_audit_score(spark):
    rows = [(1, 26, "medium"), (1, 26, "high"), (1, 17, "low"), (1, 17, "medium")]
    w = spark.createDataFrame(rows, "document_id bigint, page_no int, severity string")
    got = audit.score_documents(w, documents(spark, 139)).collect()[0]
    assert (got.audit_warning_count, got.affected_page_count, got.critical_page_count, got.audit_score, got.parse_status) == (4, 2, 1, 86, "warning")


def test_score_of_zero_counts_as_full(spark):
    w = spark.createDataFrame([(1, p, "critical") for p in range(1, 9)], "document_id bigint, page_no int, severity string")
    scored = audit.score_documents(w, documents(spark, 20))
    assert audit.pages_to_reparse(w, scored).count() == 0
    assert audit.pages_to_reparse(w, scored, zero_counts_as_full=False).count() == 8


def test_loose_window_finds_a_broken_keyword(spark):
    text = "머리말 " * 40 + "공동\n활용 할 계획이 있음을 밝힘"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(tx.evidence_window(F.col("t"), "공동활용 할 계획", 20).alias("w")).collect()[0].w
    assert "공동 활용 할 계획이" in got and len(got) < 60


def test_amounts(spark):
    df = spark.createDataFrame([("5억원",), ("2,500백만원",), ("3천만원",), ("120만원",), ("990원",), ("많음",)], "t string")
    assert [r[0] for r in df.select(tx.parse_amount(F.col("t"))).collect()] == [500000000, 2500000000, 30000000, 1200000, 990, 0]
    won = spark.createDataFrame([(500000000,), (2550000000,), (25000000,), (75000000,)], "w bigint")
    assert [r[0] for r in won.select(tx.format_amount(F.col("w"))).collect()] == ["5억 원", f"{25.5:.1f}억 원", f"{0.25:.1f}억 원", f"{0.75:.1f}억 원"]


def test_amounts_are_not_summed(make_pages):
    page = make_pages([page_row(1, "총 사업금액 20억 5천만원 입니다")])
    assert evidence.project_amount(page).collect()[0].amount_won == 2000000000


def test_subcontract_amount_is_no_budget(make_pages):
    page = make_pages([page_row(1, "하도급 금액 4억원 및 사업 예산 별도")])
    assert evidence.project_amount(page).count() == 0


def test_purchase_advice(spark, make_pages):
    rows = [page_row(1, "총 사업금액 4억원"), page_row(2, "상용SW 직접구매 계획")]
    got = item(spark, make_pages, rows, "2", judgements.item_2)
    assert got.result == "보완필요" and "4억 원" in got.reason and got.evidence_pages == [1]
    none = item(spark, make_pages, [page_row(1, "총 사업금액 4억원"), page_row(2, "상용SW 구매 내용은 없음")], "2", judgements.item_2)
    assert (none.result, none.is_target) == ("해당없음", False)


def test_purchase_terms_across_a_page_break(spark, make_pages):
    rows = [page_row(1, "사업예산 9억원, 납품하는 상용"), page_row(2, "SW 는 분리"), page_row(3, "발주 한다")]
    assert item(spark, make_pages, rows, "2", judgements.item_2).is_target is True
    rows[2] = page_row(3, "발주 한다. 직접구매 "), page_row(4, "해당 없음")
    assert item(spark, make_pages, [*rows[:2], *rows[2]], "2", judgements.item_2).is_target is False


def test_subcontract_checklist_skips_forms(spark, make_pages):
    rows = [page_row(1, "서식 하도급 사전승인 신청"), page_row(2, "하도급은 사전승인을 받아야 하며 하도급 계획서를 제출")]
    got = item(spark, make_pages, rows, "4", lambda s, d, p: judgements.item_4(s, d))
    assert got.result == "보완필요" and got.evidence_pages == [2] and "☑ 하도급 사전 승인 안내 명시 (p.2)" in got.reason


def test_dense_page_wins(spark, make_pages):
    full = (
        "SW사업 산출물 활용 보장: 지식재산권은 공동으로 소유하고 SW산출물의 반출을 요청할 수 있음. 누출금지정보를 삭제하고 "
        "대표자 명의 확약서를 제출하며 제3자에게 제공할 때 사전승인을 받음. 무단유출 시 입찰참가자격을 제한함. 계약상대자"
    )
    rows = [page_row(40, "SW산출물 반출 절차"), page_row(102, full), page_row(110, "확약서 제출 대표자 명의 계약상대자")]
    got = item(spark, make_pages, rows, "6", lambda s, d, p: judgements.item_6(s, d))
    assert got.result == "준수" and got.evidence_pages == [102]


def test_differential_score_tree(spark, make_pages):
    table = "평가항목 배점 하도급 계획 적정성 5점"
    judge = judgements.item_12
    got = item(spark, make_pages, [page_row(1, "차등점수제 적용"), page_row(2, "평가항목 배점 기술 30점")], "12", judge)
    assert got.source == "python_table_subcontract_plan_score_missing"
    got = item(spark, make_pages, [page_row(1, "차등점수제 미적용"), page_row(2, table)], "12", judge)
    assert got.source == "python_table_differential_score_not_applied" and got.evidence_pages == [1, 2]
    rule = [page_row(1, "차등점수제 적용"), page_row(2, table), page_row(3, "원점수 기준의 순위별 점수차가 차등"), page_row(4, "점수보다 큰 경우, 동점인"), page_row(5, "경우")]
    assert item(spark, make_pages, rule, "12", judge).source == "python_table_differential_score"
    assert item(spark, make_pages, rule[:3], "12", judge).source == "python_table_differential_score_missing"


BODY = "\n".join([
    "소프트웨어 개발사업 적정 사업기간 종합산정서", "검토 결과 적정 사업기간은 기능점수와 보정계수를 반영하여 산정하였으며 10개월이 타당한 것으로 분석됨",
    "투입 공수와 구축 범위를 함께 검토하여 사업 기간을 정하였고 이견이 없음을 확인하였다", "위원 검토를 거쳐 개선 사항까지 결과에 반영함",
])


def test_project_period_attachment(spark, make_pages):
    judge = lambda s, d, p: judgements.item_15(s, d)
    declared = page_row(3, "본 사업은 소프트웨어 개발사업의 적정 사업기간 산정 기준에 따른 사업임 (제10조)")
    assert item(spark, make_pages, [declared, page_row(9, BODY)], "15", judge).result == "준수"
    assert item(spark, make_pages, [page_row(9, BODY)], "15", judge).source.endswith("missing_declaration")
    title = page_row(9, "소프트웨어 개발사업 적정 사업기간 종합산정서")
    assert item(spark, make_pages, [declared, title], "15", judge).source.endswith("_empty")
    assert item(spark, make_pages, [declared], "15", judge).source.endswith("missing_attachment")
    assert item(spark, make_pages, [page_row(1, "본문")], "15", judge).source.endswith("missing_all")
    listed = page_row(2, "목차 소프트웨어 개발사업 적정 사업기간 종합산정서", has_toc=True)
    assert item(spark, make_pages, [listed], "15", judge).confidence == 0.8


def test_impact_assessment_attachment(spark, make_pages):
    judge = lambda s, d, p: judgements.item_17(s, d)
    declared = page_row(3, "본 사업은 소프트웨어사업 영향평가를 실시한 사업임")
    body = BODY.replace("소프트웨어 개발사업 적정 사업기간 종합산정서", "소프트웨어사업 영향평가 검토결과서")
    assert item(spark, make_pages, [declared, page_row(9, body)], "17", judge).result == "준수"
    refers = page_row(4, "소프트웨어사업 영향평가 결과서는 별첨 참조")
    assert item(spark, make_pages, [refers], "17", judge).confidence == 0.84


def test_workforce_item(spark, make_pages):
    rows = [page_row(5, "투입 인력 현황을 제시"), page_row(6, "기능 요구사항 SFR-001")]
    got = item(spark, make_pages, rows, "16", lambda s, d, p: judgements.item_16(s, d))
    assert got.result == "보완필요" and "5쪽" in got.recommendation and got.reason.startswith("기능 요구사항이")


def test_overlap_threshold(spark, make_pages):
    hits = spark.createDataFrame([("1", 0, 1, "", "alpha beta gamma delta epsilon")], "query_item string, rank_group int, rank int, title string, snippet string")
    page = make_pages([page_row(1, "alpha beta gamma delta 그리고 다른 말"), page_row(2, "alpha beta")])
    best = evidence.criteria_overlap(page, hits)
    assert best.collect()[0].coverage == 0.8
    got = evidence.overlap_evidence(best, page).collect()[0]
    assert got.display_no == 1 and "alpha" in got.evidence


def test_ungrounded_and_conflicting_votes(spark):
    bare = verify.verify(reviews(spark, {"evidence_pages": [], "evidence_text": []}, {"seq": 2, "evidence_pages": [], "evidence_text": []}), statuses(spark)).collect()[0]
    assert bare.final_status == "근거 부족" and bare.confidence == 0.69
    clash = verify.verify(reviews(spark, {}, {"seq": 2, "result": "미준수"}), statuses(spark)).collect()[0]
    assert clash.final_status == "검토 결과 불일치"
    held = verify.verify(reviews(spark, {}), statuses(spark, "fail")).collect()[0]
    assert held.final_status == "파싱 문제로 판단 보류"
    one = verify.verify(reviews(spark, {}), statuses(spark)).collect()[0]
    assert (one.final_status, one.confidence) == ("자동 확정 가능", 0.8)
    idle = verify.verify(reviews(spark, {"source": "llm_disabled"}), statuses(spark)).collect()[0]
    assert idle.final_status == "사람 확인 필요" and idle.warnings == [pack.WARN_NO_ACTIVE]


def test_escalated_row_takes_matching_evidence(spark):
    rows = reviews(spark, {"evidence_pages": [3], "evidence_text": ["셋째 쪽"]}, {"seq": 2, "result": "미준수", "evidence_pages": [7], "evidence_text": ["일곱째"]})
    raised = reviews(spark, {"seq": 9, "confidence": 0.9, "evidence_pages": [99], "evidence_text": ["없음"], "source": "external_escalation"})
    got = verify.verify(rows, statuses(spark), raised).collect()[0]
    assert got.final_status == "상위 GPT 최종 판정" and got.evidence_pages == [3]


def test_missing_requirement_finding(spark):
    need = spark.createDataFrame([("4", "a", "하도급 사전승인"), ("4", "b", "계획서 제출"), ("4", "c", "85점 이상")], "item_no string, requirement_id string, requirement_text string")
    rows = reviews(spark, {"evidence_text": ["하도급은 사전승인, 계획서는 제출"]})
    found = verify.audit_findings(rows, requirements=need)
    kinds = {(r.finding_type, r.requirement_id) for r in found.collect()}
    assert ("missing_required_requirement", "c") in kinds and ("overstated_judgement_strength", None) in kinds
    assert verify.audit_summary(found, rows).collect()[0].requires_adjudication is True


def test_sub_items_merge_evidence(spark):
    schema = "document_id bigint, item_no string, seq bigint, final_status string, final_result string, is_target boolean, confidence double, evidence_pages array<int>, evidence_text array<string>, reason string, recommendation string, warnings array<string>"
    rows = [
        (1, "2", 1, "s", "보완필요", True, 0.8, [101], ["뒤쪽"], "첫째", "", []),
        (1, "2-1", 2, "s", "미준수", True, 0.7, [22], ["앞쪽"], "둘째", "고침", ["w"]),
    ]
    got = verify.merge_subitem(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1 and got[0].item_no == "2" and got[0].final_result == "미준수"
    assert (got[0].evidence_pages, got[0].evidence_text) == ([22, 101], ["앞쪽", "뒤쪽"]) and got[0].reason == "둘째\n첫째"


def test_resume(spark):
    wanted = spark.createDataFrame([(1, i) for i in ("5", "8", "10")], "document_id bigint, item_no string")
    done = spark.createDataFrame([(1, "5")], "document_id bigint, item_no string")
    assert {r.item_no for r in verify.resume_remaining(wanted, done).collect()} == {"8", "10"}


def test_joint_ownership_assessment(spark):
    df = spark.createDataFrame([(1, "6", [12], ["지식재산권은 공동 소유로 한다"])], "document_id bigint, item_no string, evidence_pages array<int>, evidence_text array<string>")
    rows = {r.row_no: r.explicit_status for r in wording.assess_rows(df).collect()}
    assert rows == {"1": "명시", "2": "미명시"}
    assert wording.assessment_result(wording.assess_rows(df)).collect()[0].final_result == "보완필요"


def test_page_notation(spark):
    df = spark.createDataFrame([([7, 3, 5, 6, 5],), ([4],), ([],)], "p array<int>")
    assert [r[0] for r in df.select(lb.format_pages(F.col("p"))).collect()] == ["p.3, pp.5-7", "p.4", ""]
    assert [r[0] for r in df.select(lb.format_pages_report(F.col("p"))).collect()] == ["pp.3, 5-7", "p.4", ""]


def test_feedback_correction(spark):
    final = spark.createDataFrame([(1, "4", "", "준수", True, 0.8, [1], ["t"], "r", "", [])], "document_id bigint, item_no string, final_status string, final_result string, is_target boolean, confidence double, evidence_pages array<int>, evidence_text array<string>, reason string, recommendation string, warnings array<string>")
    told = spark.createDataFrame([(1, "4", "다시 봄", "해당없음", "", False, True)], "document_id bigint, item_no string, comment string, corrected_result string, manual_content string, manual_edited boolean, resolved boolean")
    got = feedback.apply_feedback(final, told).collect()[0]
    assert (got.final_result, got.is_target, got.final_status, got.warnings) == ("해당없음", False, "사용자 확인 완료", ["user_feedback_applied"])
    assert got.reason.endswith("사용자 수정 의견: 다시 봄") and got.needs_human_review is False


def test_fenced_judgement_response(spark):
    raw = '```json\n{"result": "적합", "evidence_pages": ["3", "x"], "evidence_text": ["본문"]}\n```'
    df = spark.createDataFrame([(1, "5", "general", "llm_review", raw), (2, "5", "general", "llm_review", "no answer")], "document_id bigint, item_no string, role string, route_type string, response string")
    got = external.parse_judgements(df).collect()
    assert len(got) == 1 and (got[0].result, got[0].confidence, got[0].evidence_pages) == ("준수", 0.65, [3])


def test_table_runs_break(make_pages):
    cont = "현황분석\n가나\n개선과제\n다라\n정보화 설계"
    rows = [page_row(1, "부서명 역할"), page_row(2, cont), page_row(3, "끊김"), page_row(4, cont)]
    got = classify.infer_table_pages(make_pages(rows)).orderBy("page_no").collect()
    assert [r.has_table for r in got] == [True, True, False, False]


def test_progress_rounds_half_even(spark):
    from tenderlens.streaming import ingest

    state = spark.createDataFrame([(1, p, "succeeded" if p == 1 else "failed", "gpt", "", p) for p in range(1, 9)], ingest.EVENT)
    jobs = spark.createDataFrame([(1, 8, 8)], "job_id bigint, selected_pages int, total_pages int")
    assert ingest.job_progress(state, jobs).collect()[0].progress_percent == 12
