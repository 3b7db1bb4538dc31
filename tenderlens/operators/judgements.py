"""Item judgements: one review row per document and item, from page signals.

Every function takes signals (see `signals`) plus the documents, and returns rows of the review schema.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.operators import blocks
from tenderlens.operators import evidence as ev
from tenderlens.operators import requirements as rq
from tenderlens.operators.signals import CHECKLIST, SAME_SCORE, TIE_RULE
from tenderlens.rules import pack
from tenderlens.schema import REVIEW
from tenderlens.session import cut_lineage

NO_PAGES = "cast(array() as array<int>)"
NO_TEXTS = "cast(array() as array<string>)"


def _order(*first: Column) -> list[Column]:
    return [*first, F.col("page_no"), F.col("seq")]


def of_kind(signals: DataFrame, *kinds: str) -> DataFrame:
    return signals.filter(F.col("kind").isin(list(kinds)))


def gather(ranked: DataFrame, pages: str = "pages", texts: str = "texts", text: str = "text") -> DataFrame:
    """Ranked rows (at most a handful per document) -> two parallel arrays."""
    rows = ranked.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("rank", "display_no", text))).alias("_e"))
    return rows.select(
        "document_id", F.transform("_e", lambda e: e["display_no"]).alias(pages), F.transform("_e", lambda e: e[text]).alias(texts)
    )


def first_of(signals: DataFrame, kind: str, n: int, order: Sequence[Column] | None = None) -> DataFrame:
    return gather(blocks.first_rows(of_kind(signals, kind), ["document_id"], order or _order(), n))


def review(
    df: DataFrame, item_no, route: str, result, target, confidence, source, reason, recommendation="", pages="pages", texts="texts",
    human=False, warnings: Sequence[str] = (),
) -> DataFrame:
    """Project a document-level frame onto the review schema."""

    def lit(v, kind: str | None = None) -> Column:
        c = v if isinstance(v, Column) else F.lit(v)
        return c.cast(kind) if kind else c

    return df.select(
        "document_id", lit(item_no, "string").alias("item_no"), F.lit(0).cast("long").alias("seq"), F.lit(route).alias("route_type"),
        lit(result, "string").alias("result"), lit(target, "boolean").alias("is_target"), lit(confidence, "double").alias("confidence"),
        F.coalesce(F.col(pages), F.expr(NO_PAGES)).cast("array<int>").alias("evidence_pages") if pages else F.expr(NO_PAGES).alias("evidence_pages"),
        F.coalesce(F.col(texts), F.expr(NO_TEXTS)).alias("evidence_text") if texts else F.expr(NO_TEXTS).alias("evidence_text"),
        lit(reason, "string").alias("reason"), lit(recommendation, "string").alias("recommendation"), lit(human, "boolean").alias("needs_human_review"),
        lit(source, "string").alias("source"),
        (F.array(*[F.lit(w) for w in warnings]) if warnings else F.expr(NO_TEXTS)).alias("warnings"), F.lit(False).alias("used_llm"),
    ).select(*REVIEW.fieldNames())


def prefer(documents: DataFrame, *branches: DataFrame) -> DataFrame:
    """First branch that has a row for a document.  Every branch holds at most one row per document."""
    tagged = reduce(lambda a, b: a.unionByName(b), [b.withColumn("_p", F.lit(i)) for i, b in enumerate(branches)])
    rest = [c for c in tagged.columns if c not in ("document_id", "_p")]
    best = tagged.groupBy("document_id").agg(F.min_by(F.struct(*rest), "_p").alias("_r"))
    return documents.select("document_id").join(best, "document_id").select("document_id", *[F.col(f"_r.{c}").alias(c) for c in rest])


RULE, TABLE, FORM, GENERAL = "rule_review", "table_review", "attachment_review", "llm_review"

# Reasons and recommendations.
R_RULE_OK = "규칙 기반 핵심 근거가 RFP 본문에서 확인되었습니다."
R_RULE_MISSING = "필수 법제도 검토기준 중 일부가 RFP 본문에서 모두 확인되지 않았습니다."
C_RULE_MISSING = "관련 문구를 모두 명시해야 준수로 판단됩니다. 누락된 필수 문구를 제안요청서에 보완하시기 바랍니다."
R_RULE_OPEN = "규칙 기반 키워드와 DB 기준문구 70% 커버리지 조건을 충족하지 못했습니다."
C_RULE_OPEN = "해당 검토항목의 필수 문구 반영 여부를 수동 확인하세요."
R_DETAIL = "요구사항 총괄표와 상세 요구사항 작성 구조가 RFP 본문에서 확인되었습니다."
R_DENIED = "본 사업의 하도급 불허가 직접 명시되어 있어 하도급 허용 사업에 적용되는 세부 기준은 case에 해당하지 않습니다."
C_CHECKLIST = "문서 내 하도급 제도 안내 중 다음 항목을 보완하시기 바랍니다: "
R_SMALL_TAIL = "사업금액 구간에 맞는 중소 SW사업자 참여 지원 필수 문구가 모두 확인되지 않았습니다."
C_SMALL = "제안요청서에 다음 필수 문구 취지를 추가하시기 바랍니다: "
SENTENCE_2B = "본 사업은 20억원 미만 사업으로 대기업 및 중견기업인 소프트웨어사업자는 입찰에 참여할 수 없습니다."
SENTENCE_4B = "본 사업은 40억원 미만 사업으로 대기업인 소프트웨어사업자는 입찰에 참여할 수 없습니다."
SENTENCE_OTHER = "중소 소프트웨어사업자의 사업 참여 지원에 관한 지침에 따른 참여 제한 대상 여부와 금액 구간별 필수 문구를 명시해야 합니다."
R_SW_INFO = "SW사업정보 관련 문구가 확인되나 검토의견서 작성예시 수준의 제출 여부 및 제출방법 안내와 상이합니다."
R_SCORE_90 = "기술능력평가 90점과 가격평가 10점이 확인되어 기술능력평가 비중 90% 기준을 충족합니다."
R_PLAN_MISSING = "제안서 기술평가항목 및 배점표에서 하도급계획 적정성 평가항목이 5점 이상 배점으로 명확히 확인되지 않습니다."
C_PLAN_MISSING = "제안서 기술평가항목 및 배점표에 하도급계획 적정성 평가항목을 5점 이상으로 명시해주시기 바랍니다."
R_NOT_APPLIED = "차등점수제 미적용 사업임이 명시되어 있고, 평가항목 및 배점한도도 확인됩니다."
R_DIFFERENTIAL = "차등점수제 적용 여부와 평가항목 및 배점한도가 확인되고, 원점수차 및 동점 처리 기준도 명시되어 있습니다."
C_DIFFERENTIAL = (
    "차등점수제 적용 시 원점수 기준의 순위별 점수차가 차등점수보다 큰 경우에는 "
    "원점수 기준 점수차를 적용하고, 동점인 경우 처리 기준을 명시하시기 바랍니다."
)
R_TABLE_WEAK = "평가표 후보와 관련 키워드를 찾았지만 DB 기준문구 70% 커버리지는 충족하지 못했습니다."
C_TABLE_WEAK = "표의 세부 배점과 법제도 검토 기준을 대조하세요."
R_TABLE_NONE = "평가표 후보 또는 관련 키워드가 부족합니다."
C_TABLE_NONE = "파싱 결과의 표 추출 상태를 먼저 확인하세요."
R_FORM_WEAK = "붙임/별첨 본문 후보에서 관련 문구를 찾았지만 DB 기준문구 70% 커버리지는 충족하지 못했습니다."
C_FORM_WEAK = "첨부 본문의 원문 문구와 검토 기준을 대조하세요."
R_FORM_NONE = "붙임/별첨 또는 관련 키워드가 충분하지 않습니다."
C_FORM_NONE = "붙임 파일 또는 별첨 본문 누락 여부를 확인하세요."
R_TITLE_ONLY = "첨부 제목은 있으나 실제 검토·산정·확인 내용이 없는 빈 문서로 확인됩니다."
C_TITLE_ONLY = "제목만 있는 붙임이 아니라 실제 검토·산정·확인 내용이 포함된 첨부문서를 제안요청서에 포함하여야 합니다."
R_PURCHASE_NO = "RFP 본문에서 총사업금액 3억원 이상이면서 직접구매 대상 상용SW를 구매하는 사업으로 볼 근거가 모두 확인되지 않았습니다."
C_PURCHASE = "발주기관에서 해당 여부를 확인 후 상용SW 직접구매 계획표 작성을 권고합니다."
R_BMT_NO = "RFP 본문에서 경쟁입찰, 직접구매 대상 상용SW 1억원 이상, 품질성능 평가시험 지침 별표3의 34종 SW 해당, 조달청 종합쇼핑몰 미등록 조건이 모두 확인되지 않았습니다."
C_PERIOD = (
    "제안요청서에 위원명 및 서명을 제외한(블라인드 처리) 상태로 스캔한 "
    '"소프트웨어 개발사업의 적정 사업기간 종합 산정서"를 작성하여 첨부하시기 바랍니다.'
)
R_PERIOD = {
    "no_declaration": "소프트웨어 개발사업 적정 사업기간 종합산정서 첨부 본문은 있으나, RFP 본문에서 적정 사업기간 산정 기준 적용 명시가 확인되지 않았습니다.",
    "complete": "소프트웨어 개발사업 적정 사업기간 산정 기준 적용 명시와 종합산정서 첨부 본문이 함께 확인되었습니다.",
    "empty": "소프트웨어 개발사업 적정 사업기간 산정 기준 적용 명시는 있으나, 종합산정서 제목만 있고 실제 산정 내용이 없는 빈 문서로 확인됩니다.",
    "listed": "붙임 목차에는 소프트웨어 개발사업 적정 사업기간 종합산정서가 표시되어 있으나 실제 첨부 본문이 확인되지 않았습니다.",
    "no_attachment": "소프트웨어 개발사업의 적정 사업기간 종합 산정서 첨부가 확인되지 않았습니다.",
    "nothing": "소프트웨어 개발사업의 적정 사업기간 종합 산정서 첨부 또는 적정 사업기간 산정 기준 적용 명시가 확인되지 않았습니다.",
}
R_IMPACT = {
    "no_declaration": "소프트웨어사업 영향평가 결과서 첨부 본문은 있으나, RFP 본문에서 영향평가 실시 및 첨부 명시가 확인되지 않았습니다.",
    "complete": "소프트웨어사업 영향평가 실시 명시와 영향평가 검토 결과서 첨부 본문이 함께 확인되었습니다.",
    "empty": "소프트웨어사업 영향평가 실시 명시는 있으나, 영향평가 결과서 제목만 있고 실제 검토 내용이 없는 빈 문서로 확인됩니다.",
    "reference": "소프트웨어사업 영향평가 결과서를 첨부한다고 명시되어 있으나, 실제 별첨 본문은 확인되지 않았습니다.",
    "listed": "목차 및 붙임 목록에는 소프트웨어사업 영향평가 검토 결과서가 표시되어 있으나 실제 첨부 본문이 확인되지 않았습니다.",
}
IMPACT_MISSING = '"소프트웨어사업 영향평가 결과서"가 작성되지 않음.\n-> 기관장 직인이 날인된 영향평가 결과서를 작성하여 첨부하시기 바랍니다.'
R_WORKFORCE_FP = "기능 요구사항이 확인되어 FP(Function Point) 방식 사업대가 산정 가능성이 있으나, "
R_WORKFORCE = "제안요청서 내용만으로 FP 방식 또는 SLA 방식 적용 여부를 명확히 확정하기 어렵습니다. 발주기관이 해당 방식 적용 여부를 직접 판단해야 합니다."
C_WORKFORCE = (
    "에 명시한 투입인력 요구 및 관리 관련 내용(인력현황, 이력사항, 전문인력, 업무분장, 투입인력 수·경력·수행조직 등)을 모두 삭제하시기 바랍니다. "
    "다만 제안요청서만으로 FP 방식 또는 SLA 방식 적용 여부가 명확하지 않은 경우 발주기관에서 해당 여부를 먼저 판단하시기 바랍니다."
)
R_UNDECIDED = "외부 판단기가 설정되어 있지 않아 일반 검토를 건너뜁니다."
C_UNDECIDED = "외부 판단기 설정 후 다시 실행하세요."
W_UNDECIDED = "external judge missing"


def rule_success(df: DataFrame, item_no: str, reason=R_RULE_OK) -> DataFrame:
    return review(df, item_no, RULE, pack.COMPLIANT, True, 0.88, "python_rule", reason)


def rule_noncompliant(df: DataFrame, item_no: str) -> DataFrame:
    return review(df, item_no, RULE, pack.NON_COMPLIANT, True, 0.82, "python_rule", R_RULE_MISSING, C_RULE_MISSING)


def overlap_review(
    overlaps: DataFrame, item_no: str, route: str, cap: float, base: float, source: str, place: str
) -> DataFrame:
    """Accepted criteria overlaps (document_id, item_no, coverage, display_no, evidence) of one item."""
    own = overlaps.filter(F.col("item_no") == item_no).select(
        "document_id", "coverage", F.array("display_no").alias("pages"), F.array("evidence").alias("texts")
    )
    percent = F.concat(F.bround(F.col("coverage") * 100, 0).cast("int").cast("string"), F.lit("%"))
    reason = F.concat(F.lit("DB 기준문구 핵심 키워드의 "), percent, F.lit(f"가 {place} 확인되어 70% 기준을 충족했습니다."))
    confidence = tx.round_thousandths(F.least(F.lit(cap), F.lit(base) + F.col("coverage") * 0.5))
    return review(own, item_no, route, pack.COMPLIANT, True, confidence, source, reason)


def item_keyword(signals: DataFrame, documents: DataFrame, item_no: str, overlaps: DataFrame | None = None) -> DataFrame:
    """Keyword evidence, else criteria overlap, else left open."""
    branches = [rule_success(first_of(signals, f"{item_no}:keyword", 3), item_no)]
    if overlaps is not None:
        branches.append(overlap_review(overlaps, item_no, RULE, 0.9, 0.45, "python_rule_rag_overlap", "RFP 후보 페이지에서"))
    branches.append(review(documents, item_no, RULE, pack.NEEDS_CHECK, True, 0.52, "python_rule", R_RULE_OPEN, C_RULE_OPEN, None, None, True))
    return prefer(documents, *branches)


# --- 2 and 2-1 -----------------------------------------------------------------------------------------------


#: Offsets that meet in one bucket, and compact characters of one cell of page edges.
REACH_BUCKET, EDGE_CELL = 256, 2048


def buckets_of(start: Column, stop: Column) -> Column:
    """Buckets that the offsets from `start` to `stop` lie in."""
    return F.sequence(F.floor(F.greatest(start, F.lit(0)) / F.lit(REACH_BUCKET)), F.floor(F.greatest(stop, F.lit(0)) / F.lit(REACH_BUCKET)))


# Purchase wording, and the notation that may be cut by a page break between number and unit.
PURCHASE_WORDS = [*pack.COMMERCIAL_SW, *pack.PURCHASE_ACTIONS]
OPEN_AMOUNT = f"([\\d,]+(?:\\.\\d+)?)[{tx.SPACE}]*$"
UNIT_FIRST = f"^([{tx.SPACE}]*(?:억원|억|천만원|천만|백만원|백만|만원|원))"


def offset_index(page: DataFrame) -> DataFrame:
    """Purchase words, negations and amounts of the pages outside the contents, by offset in the text of the document.

    Rows: document_id, kind ("word", "negation", "amount"), start, stop, won.  The text of a document is its pages joined by
    blanks; a page's offset is the sum of the lengths before it, by block.  Words and negations hold no blank, so each lies in one
    page; an amount whose number ends a page takes its unit from the next page that is not blank.  Page text is read once and never
    moved.
    """
    source = tx.text_or_empty(F.col("page_text"))
    terms = "|".join([*PURCHASE_WORDS, *[n for n in pack.NEGATIONS if " " not in n]])
    digits, unit = F.regexp_extract(source, OPEN_AMOUNT, 1), F.regexp_extract(source, UNIT_FIRST, 1)
    marks = page.filter("not has_toc").select(
        *ev.PAGE_ID, F.length(source).alias("_length"), tx.match_spans(source, terms).alias("_terms"), tx.match_spans(source, tx.AMOUNT_REGEX).alias("_amounts"),
        digits.alias("_digits"), F.length(F.regexp_replace(source, OPEN_AMOUNT, "")).alias("_digits_at"), unit.alias("_unit"), (tx.strip(source) == "").alias("_blank"),
    )
    placed = blocks.total_before(marks.withColumn("_own", F.col("_length") + 1), ["document_id"], "page_no", ["page_no", "seq"], "_own", "_base")
    placed = cut_lineage(placed.drop("_own"))
    base = F.col("_base")
    inside = placed.select("document_id", "_base", F.explode(F.concat(
        F.transform("_terms", lambda s: F.struct(F.when(s["value"].isin(PURCHASE_WORDS), "word").otherwise("negation").alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(None).cast("long").alias("won"))),
        F.transform("_amounts", lambda s: F.struct(F.lit("amount").alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), tx.parse_amount(s["value"]).alias("won"))),
    )).alias("s")).select("document_id", "s.kind", (base + F.col("s.start")).alias("start"), (base + F.col("s.stop")).alias("stop"), "s.won")
    told = placed.filter("not _blank").withColumn("_head", F.struct("_unit", (base + F.length("_unit")).alias("stop")))
    told = blocks.following_value(told, ["document_id"], "page_no", ["page_no", "seq"], "_head", "_next").filter("_digits <> '' and _next._unit <> ''")
    broken = told.select("document_id", F.lit("amount").alias("kind"), (base + F.col("_digits_at")).alias("start"), F.col("_next.stop").alias("stop"), tx.parse_amount(F.concat("_digits", "_next._unit")).alias("won"))
    return inside.unionByName(broken)


def compact_pieces(page: DataFrame, chars: int) -> DataFrame:
    """(document_id, c): compact text of every page, and what `chars` characters can make of it across page breaks.

    Only the edges of pages move: they are put together by cells of compact offsets, with a blank, which compact text does not
    hold, where edges do not touch.  Whatever `chars` characters the joined compact pages of a document hold in a row is in a row.
    """
    body = page.select(*ev.PAGE_ID, tx.compact(F.col("page_text")).alias("c")).filter("c <> ''")
    part = lambda at, text: F.struct(F.lit(at).cast("long").alias("at") if isinstance(at, int) else at.cast("long").alias("at"), text.alias("text"))
    edges = F.when(F.length("c") <= 2 * chars, F.array(part(0, F.col("c")))).otherwise(F.array(part(0, tx.head(F.col("c"), chars)), part(F.length("c") - chars, F.right("c", F.lit(chars)))))
    narrow = body.select(*ev.PAGE_ID, F.length("c").alias("_length"), edges.alias("_edges"))
    placed = blocks.total_before(narrow, ["document_id"], "page_no", ["page_no", "seq"], "_length", "_base")
    slices = placed.select("document_id", "_base", F.explode("_edges").alias("e")).select("document_id", (F.col("_base") + F.col("e.at")).alias("start"), F.col("e.text").alias("text"))
    slices = slices.withColumn("stop", F.col("start") + F.length("text"))
    cells = F.sequence(F.floor(F.greatest(F.col("start") - chars, F.lit(0)) / F.lit(EDGE_CELL)), F.floor((F.col("stop") - 1) / F.lit(EDGE_CELL)))
    gathered = slices.withColumn("cell", F.explode(cells)).groupBy("document_id", "cell").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "text"))).alias("_s"))
    touching = lambda s, i: (i > 0) & (F.get("_s", i - 1)["stop"] == s["start"])
    joined = F.array_join(F.transform("_s", lambda s, i: F.when(touching(s, i), s["text"]).otherwise(F.concat(F.lit(" "), s["text"]))), "")
    return body.select("document_id", "c").unionByName(gathered.filter(F.size("_s") > 1).select("document_id", joined.alias("c")))


def purchase_facts(page: DataFrame) -> DataFrame:
    """Per document: whether purchase wording occurs, whether it is negated, the amounts and trial terms near it."""
    marks = cut_lineage(offset_index(page))
    word = marks.filter("kind = 'word'").select("document_id", F.col("start").alias("w_start"), F.col("stop").alias("w_stop"))
    behind = word.withColumn("_bucket", F.explode(buckets_of(F.col("w_stop"), F.col("w_stop") + pack.NEGATION_REACH)))
    denial = marks.filter("kind = 'negation'").select("document_id", "start", "stop", F.floor(F.col("start") / F.lit(REACH_BUCKET)).alias("_bucket"))
    # from the end of the word to the end of the negation
    negated = behind.join(denial, ["document_id", "_bucket"]).filter((F.col("start") >= F.col("w_stop")) & (F.col("stop") - F.col("w_stop") <= pack.NEGATION_REACH))
    amount = marks.filter("kind = 'amount'").select("document_id", "start", "stop", "won").withColumn("_bucket", F.explode(buckets_of(F.col("start") - 80, F.col("stop") + 80)))
    at_word = word.withColumn("_bucket", F.floor(F.col("w_start") / F.lit(REACH_BUCKET)))
    near = amount.join(at_word, ["document_id", "_bucket"]).filter((F.col("w_start") >= F.col("start") - 80) & (F.col("w_stop") <= F.col("stop") + 80))
    facts = negated.select("document_id", F.lit(True).alias("negated"), F.lit(0).cast("long").alias("sw_amount")).unionByName(near.select("document_id", F.lit(False).alias("negated"), F.col("won").alias("sw_amount")))
    every = page.filter("not has_toc").select("document_id", F.lit(False).alias("negated"), F.lit(0).cast("long").alias("sw_amount"))
    by_page = every.unionByName(facts).groupBy("document_id").agg(F.bool_or("negated").alias("negated"), F.max("sw_amount").alias("sw_amount"))
    tests = {
        "has_sw": tx.contains_any(F.col("c"), pack.COMMERCIAL_SW),
        "has_purchase": tx.contains_any(F.col("c"), pack.PURCHASE_ACTIONS),
        "competitive": tx.contains_any(F.col("c"), ["경쟁입찰", "일반경쟁", "제한경쟁"]),
        "annex": F.col("c").contains("별표3"),
        "kinds": F.col("c").contains("34종"),
        "trial": F.col("c").contains("품질성능평가시험"),
        "bmt": F.col("c").contains("BMT"),
        "not_listed": tx.contains_any(F.col("c"), ["조달청종합쇼핑몰미등록", "종합쇼핑몰등록제품이아닌"]),
        "mall": F.col("c").contains("종합쇼핑몰"),
        "unregistered": F.col("c").contains("미등록"),
        "listed_item": F.col("c").contains("등록제품"),
        "will_not": F.col("c").contains("아닐"),
    }
    compact = compact_pieces(page.filter("not has_toc"), 24)
    found = compact.groupBy("document_id").agg(*[F.bool_or(v).alias(k) for k, v in tests.items()])
    return by_page.join(found, "document_id", "left").fillna(False, list(tests))


def item_2(signals: DataFrame, documents: DataFrame, page: DataFrame) -> DataFrame:
    """Target of direct purchase: a budget of 300 million won or more and purchase wording."""
    facts = purchase_facts(page).withColumn("_direct", F.col("has_sw") & F.col("has_purchase") & ~F.col("negated")).select("document_id", "_direct")
    told = of_kind(signals, "2:signal").select("document_id").distinct().withColumn("_signal", F.lit(True))
    budget = ev.project_amount(page, 300_000_000)
    state = documents.select("document_id").join(budget, "document_id", "left").join(facts, "document_id", "left").join(told, "document_id", "left")
    target = F.col("amount_won").isNotNull() & (F.coalesce("_direct", F.lit(False)) | F.coalesce("_signal", F.lit(False)))
    state = state.withColumn("_t", target).withColumn("pages", F.when(F.col("_t"), F.array("amount_page"))).withColumn("texts", F.when(F.col("_t"), F.array("context")))
    t = F.col("_t")
    advice = F.concat(F.lit("총 사업금액 "), tx.format_amount(F.col("amount_won")), F.lit(" 및 상용SW 구매 가능성이 확인되어 상용SW 직접구매 대상 여부 확인이 필요합니다."))
    return review(
        state, "2", FORM, F.when(t, pack.SUPPLEMENT).otherwise(pack.NOT_APPLICABLE), t, F.when(t, 0.82).otherwise(0.78),
        F.when(t, "python_attachment_direct_purchase_target_advisory").otherwise("python_attachment_direct_purchase_not_target"),
        F.when(t, advice).otherwise(R_PURCHASE_NO), F.when(t, C_PURCHASE).otherwise(""), human=t,
    )


def bmt_targets(page: DataFrame) -> DataFrame:
    """Documents for which all four conditions of the performance test hold."""
    f = purchase_facts(page)
    trial = (F.col("annex") & F.col("kinds")) | (sum(F.col(x).cast("int") for x in ["annex", "kinds", "trial", "bmt"]) >= 2)
    open_market = F.col("not_listed") | (F.col("mall") & F.col("unregistered")) | (F.col("mall") & F.col("listed_item") & F.col("will_not"))
    return f.filter(F.col("competitive") & (F.col("sw_amount") >= 100_000_000) & trial & open_market).select("document_id")


def item_2_1(signals: DataFrame, documents: DataFrame, page: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    targets = bmt_targets(page)
    rest = documents.join(targets, "document_id", "left_anti")
    no = review(rest, "2-1", FORM, pack.NOT_APPLICABLE, False, 0.78, "python_attachment_bmt_not_target", R_BMT_NO, "", None, None)
    return no.unionByName(item_attachment_fallback(signals, targets, "2-1", overlaps))


# --- 3 ------------------------------------------------------------------------------------------------------------


def item_3(signals: DataFrame, documents: DataFrame, amount: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    full = first_of(signals, "3:full", 1).join(amount, "document_id", "left")
    known = F.concat(
        F.lit("p."), F.col("amount_page").cast("string"), F.lit("에 근거하여 총 사업금액 "), tx.format_amount(F.col("amount_won")),
        F.lit("임이 확인되었고, 해당 금액 구간에 필요한 중소 SW사업자 참여 제한 문구가 확인되었습니다."),
    )
    ok = rule_success(full, "3", F.coalesce(known, F.lit(R_RULE_OK)))
    partial = first_of(signals, "3:part", 3, [F.col("score").desc(), F.col("display_no"), F.col("page_no"), F.col("seq")])
    short = amount.join(partial, "document_id", "left")
    sentence = F.when(F.col("amount_won") < 2_000_000_000, SENTENCE_2B).when(F.col("amount_won") < 4_000_000_000, SENTENCE_4B).otherwise(SENTENCE_OTHER)
    reason = F.concat(F.lit("p."), F.col("amount_page").cast("string"), F.lit(" 총 사업금액 "), tx.format_amount(F.col("amount_won")), F.lit(f" 기준으로 {R_SMALL_TAIL}"))
    missing = review(short, "3", RULE, pack.SUPPLEMENT, True, 0.8, "python_rule_small_sw_missing_required_sentence", reason, F.concat(F.lit(C_SMALL), sentence))
    return prefer(documents, ok, missing, item_keyword(signals, documents, "3", overlaps))


# --- 4 ------------------------------------------------------------------------------------------------------------


def item_4_disallowed(signals: DataFrame) -> DataFrame:
    return review(first_of(signals, "4:deny", 1), "4", RULE, pack.COMPLIANT, True, 0.88, "python_rule_subcontract_disallowed", R_DENIED)


def item_4_checklist(signals: DataFrame) -> DataFrame:
    """First page of each check.  Pages are distinct and sorted, texts keep the order in which checks were met."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(len(CHECKLIST) - 1)), lambda i: F.getbit(F.col("mask"), i) == 1)
    rows = of_kind(signals, "4:check").select("document_id", "page_no", "seq", "display_no", "text", F.explode(bits).alias("bit"))
    place = F.struct("page_no", "seq")
    met = rows.groupBy("document_id", "bit").agg(F.min(place).alias("place"), F.min_by(F.struct("display_no", "text"), place).alias("hit"))
    doc = met.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("place", "bit", "hit"))).alias("m"))
    by_bit = F.map_from_entries(F.transform("m", lambda m: F.struct(m["bit"], m["hit"]["display_no"])))
    doc = doc.withColumn("_by", by_bit)
    lines, missing = [], []
    for i, (_, label) in enumerate(CHECKLIST):
        page = F.try_element_at("_by", F.lit(i))
        lines.append(F.when(page.isNull(), F.lit(f"☐ {label} 미명시")).otherwise(F.concat(F.lit(f"☑ {label} 명시 (p."), page.cast("string"), F.lit(")"))))
        missing.append(F.when(page.isNull(), F.lit(label)))
    absent = F.array_compact(F.array(*missing))
    doc = (
        doc.withColumn("_absent", absent)
        .withColumn("pages", F.slice(F.array_sort(F.array_distinct(F.transform("m", lambda m: m["hit"]["display_no"]))), 1, 6))
        .withColumn("texts", F.slice(F.filter(F.transform("m", lambda m: m["hit"]["text"]), lambda t: t != ""), 1, 6))
    )
    done = F.size("_absent") == 0
    return review(
        doc, "4", RULE, F.when(done, pack.COMPLIANT).otherwise(pack.SUPPLEMENT), True, F.when(done, 0.88).otherwise(0.76),
        "python_rule_subcontract_checklist", F.concat_ws("\n", *lines), F.when(done, "").otherwise(F.concat(F.lit(C_CHECKLIST), F.array_join("_absent", ", "))),
    )


def item_4_partial(signals: DataFrame, documents: DataFrame) -> DataFrame:
    best = first_of(signals, "4:part", 3, [F.col("score").desc(), F.col("display_no"), F.col("page_no"), F.col("seq")])
    return rule_noncompliant(documents.select("document_id").join(best, "document_id", "left"), "4")


def item_4(signals: DataFrame, documents: DataFrame) -> DataFrame:
    return prefer(documents, item_4_disallowed(signals), item_4_checklist(signals), item_4_partial(signals, documents))


# --- 6 ------------------------------------------------------------------------------------------------------------


def dense_page_first(signals: DataFrame) -> DataFrame:
    """One complete page of the right section, else the greedy cover with dense pages first, in page order."""
    rows = of_kind(signals, "6:reuse").select("document_id", "page_no", "seq", "display_no", "score", F.col("mask").bitwiseAND(128).alias("section"), F.col("mask").bitwiseAND(127).alias("mask"), "text")
    dense = (F.bit_count("mask") >= 4) & (F.col("section") != 0)
    rows = rows.withColumn("sparse", (~dense).cast("int")).withColumn("down", -F.col("score")).drop("section", "score")
    complete = rows.filter((F.col("sparse") == 0) & (F.col("mask") == rq.REUSE_ALL))
    single = blocks.first_rows(complete, ["document_id"], _order(F.col("down")), 1).select("document_id", "rank", "display_no", "text")
    rest = rows.join(single.select("document_id"), "document_id", "left_anti").withColumn("at", F.col("page_no")).withColumn("tie", F.col("seq"))
    cover = ev.greedy_cover(rest, rq.REUSE_ALL, ["sparse", "down", "at", "tie"])
    several = cover.select("document_id", F.col("page_no").alias("rank"), "display_no", "text")
    return single.unionByName(several)


def item_6(signals: DataFrame, documents: DataFrame) -> DataFrame:
    ok = rule_success(gather(dense_page_first(signals)), "6")
    rows = of_kind(signals, "6:reuse").filter((F.bit_count(F.col("mask").bitwiseAND(127)) >= 3) & (F.col("mask").bitwiseAND(128) != 0))
    partial = gather(blocks.first_rows(rows, ["document_id"], _order(F.col("score").desc()), 1))
    return prefer(documents, ok, rule_noncompliant(documents.select("document_id").join(partial, "document_id", "left"), "6"))


# --- 11 and 12 ----------------------------------------------------------------------------------------------------


def item_table_fallback(signals: DataFrame, documents: DataFrame, item_no: str, overlaps: DataFrame | None = None) -> DataFrame:
    branches = []
    if overlaps is not None:
        branches.append(overlap_review(overlaps, item_no, TABLE, 0.88, 0.43, "python_table_rag_overlap", "평가표 후보 페이지에서"))
    weak, none = _candidate_evidence(signals, documents, item_no)
    branches.append(review(weak, item_no, TABLE, pack.SUPPLEMENT, True, 0.7, "python_table", R_TABLE_WEAK, C_TABLE_WEAK, human=True))
    branches.append(review(none, item_no, TABLE, pack.NEEDS_CHECK, None, 0.36, "python_table", R_TABLE_NONE, C_TABLE_NONE, human=True))
    return prefer(documents, *branches)


def _candidate_evidence(signals: DataFrame, documents: DataFrame, item_no: str) -> tuple[DataFrame, DataFrame]:
    """(keyword pages, first pages) among a document's candidate pages, or all its pages when it has none."""
    marked = of_kind(signals, f"{item_no}:candidate").select("document_id").distinct().withColumn("_marked", F.lit(True))
    words = of_kind(signals, f"{item_no}:keyword").join(marked, "document_id", "left").filter(F.col("_marked").isNull() | (F.col("mask") == 1))
    weak = gather(blocks.first_rows(words, ["document_id"], _order(), 5))
    first = first_of(signals, f"{item_no}:candidate", 3)
    every = first_of(signals, f"{item_no}:any", 3).join(marked, "document_id", "left_anti")
    return weak, documents.select("document_id").join(first.unionByName(every), "document_id", "left")


def item_11(signals: DataFrame, documents: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    ok = review(first_of(signals, "11:score", 3), "11", TABLE, pack.COMPLIANT, True, 0.9, "python_table_score_90", R_SCORE_90)
    return prefer(documents, ok, item_table_fallback(signals, documents, "11", overlaps))


def merged_by_page(groups: Sequence[DataFrame]) -> DataFrame:
    """Evidence of several groups by displayed page, ascending; further texts of a page are appended when new."""
    tagged = reduce(lambda a, b: a.unionByName(b), [g.select("document_id", F.lit(i).alias("grp"), "rank", "display_no", "text") for i, g in enumerate(groups)])
    rows = tagged.groupBy("document_id", "display_no").agg(F.array_sort(F.collect_list(F.struct("grp", "rank", "text"))).alias("_t"))
    first = F.lit("")

    def add(acc: Column, t: Column) -> Column:
        fresh = (t["text"] != "") & ~F.contains(acc["text"], t["text"])
        joined = F.when(fresh, F.concat(acc["text"], F.lit("\n"), t["text"])).otherwise(acc["text"])
        return F.struct(F.lit(True).alias("seen"), F.when(~acc["seen"], t["text"]).otherwise(joined).alias("text"))

    folded = F.aggregate("_t", F.struct(F.lit(False).alias("seen"), first.alias("text")), add, lambda a: a["text"])
    pages = rows.select("document_id", "display_no", folded.alias("text")).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("display_no", "text"))).alias("_e"))
    return pages.select("document_id", F.transform("_e", lambda e: e["display_no"]).alias("pages"), F.transform("_e", lambda e: e["text"]).alias("texts"))


def item_12(signals: DataFrame, documents: DataFrame, page: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    """Decision tree over score rules, their table and the subcontract clauses."""
    def top(kind: str, n: int, only: Column | None = None) -> DataFrame:
        rows = of_kind(signals, kind)
        rows = rows if only is None else rows.filter(only)
        return blocks.first_rows(rows, ["document_id"], _order(), n).select("document_id", "rank", "display_no", "text")

    signal, off, deny = top("12:signal", 1), top("12:off", 1), top("12:deny", 1)
    table, plan = top("12:table", 3), top("12:table", 3, F.col("mask") == 1)
    # The two statements are sought in the text of the whole document, so across page breaks as well.
    stated = compact_pieces(page, len(TIE_RULE)).groupBy("document_id").agg(
        (F.bool_or(F.col("c").contains(TIE_RULE)) & F.bool_or(F.col("c").contains(SAME_SCORE))).alias("_stated")
    )
    flags = documents.select("document_id")
    for name, df in [("_signal", signal), ("_off", off), ("_deny", deny), ("_table", table), ("_plan", plan)]:
        flags = flags.join(df.select("document_id").distinct().withColumn(name, F.lit(True)), "document_id", "left")
    flags = flags.fillna(False, ["_signal", "_off", "_deny", "_table", "_plan"]).join(stated, "document_id", "left")
    flags = flags.filter(F.col("_signal") | F.col("_off") | F.col("_table"))
    no_score = flags.filter(F.col("_table") & ~F.col("_deny") & ~F.col("_plan")).select("document_id", "_signal")
    others = flags.join(no_score, "document_id", "left_anti")
    not_applied = others.filter("_off").select("document_id", "_plan")
    applied = others.filter("not _off").select("document_id", "_plan", "_stated")

    def evidence(docs: DataFrame, *groups: DataFrame) -> DataFrame:
        own = [g.join(docs.select("document_id"), "document_id", "left_semi") for g in groups]
        return docs.join(merged_by_page(own), "document_id", "left")

    has_plan = plan.select("document_id").distinct()
    lead = signal.unionByName(off.join(signal, "document_id", "left_anti"))
    tables = plan.unionByName(table.join(has_plan, "document_id", "left_anti"))
    one = review(evidence(no_score, lead, table), "12", TABLE, pack.NON_COMPLIANT, True, 0.86, "python_table_subcontract_plan_score_missing", R_PLAN_MISSING, C_PLAN_MISSING)
    two = review(evidence(not_applied, off, tables, deny), "12", TABLE, pack.COMPLIANT, True, 0.86, "python_table_differential_score_not_applied", R_NOT_APPLIED)
    third = evidence(applied, signal, tables, deny)
    yes = F.coalesce("_stated", F.lit(False))
    three = review(
        third, "12", TABLE, F.when(yes, pack.COMPLIANT).otherwise(pack.SUPPLEMENT), True, F.when(yes, 0.86).otherwise(0.84),
        F.when(yes, "python_table_differential_score").otherwise("python_table_differential_score_missing"),
        F.when(yes, R_DIFFERENTIAL).otherwise(""), F.when(yes, "").otherwise(C_DIFFERENTIAL),
    )
    return prefer(documents, one.unionByName(two).unionByName(three), item_table_fallback(signals, documents, "12", overlaps))


# --- 14, 16, 18 ----------------------------------------------------------------------------------------------------


def item_14(signals: DataFrame, documents: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    def ok(kind: str) -> DataFrame:
        return review(first_of(signals, kind, 5), "14", RULE, pack.COMPLIANT, True, 0.88, "python_rule_requirement_structure", R_DETAIL)

    return prefer(documents, ok("14:detail"), ok("14:summary"), item_keyword(signals, documents, "14", overlaps))


def item_16(signals: DataFrame, documents: DataFrame) -> DataFrame:
    found = first_of(signals, "16:trigger", 5)
    function = of_kind(signals, "16:function").select("document_id").distinct().withColumn("_fp", F.lit(True))
    state = found.join(function, "document_id", "left")
    listed = F.array_join(F.transform("pages", lambda p: F.concat(p.cast("string"), F.lit("쪽"))), ", ")
    hit = review(
        state, "16", GENERAL, pack.SUPPLEMENT, True, 0.78, "python_llm_item_16_workforce_trigger",
        F.concat(F.when(F.col("_fp"), R_WORKFORCE_FP).otherwise(""), F.lit(R_WORKFORCE)), F.concat(F.lit("제안요청서("), listed, F.lit(f"){C_WORKFORCE}")), human=True,
    )
    return prefer(documents, hit, undecided_item(documents, "16"))


def item_18(signals: DataFrame, documents: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    rows = of_kind(signals, "18:mention")
    found = first_of(signals, "18:mention", 3).join(rows.groupBy("document_id").agg(F.bit_or("mask").alias("_m")), "document_id")
    full = rule_success(found.filter("_m = 3"), "18")
    gaps = F.concat_ws(
        ", ", F.when(F.col("_m").bitwiseAND(1) == 0, "SW사업정보 제출 여부 명시"), F.when(F.col("_m").bitwiseAND(2) == 0, "SW사업정보 제출 방법 안내")
    )
    partial = review(
        found.filter("_m <> 3"), "18", RULE, pack.SUPPLEMENT, True, 0.78, "python_rule_sw_business_info_example_gap", R_SW_INFO,
        F.concat(F.lit("검토의견서 작성예시를 참고하여 "), gaps, F.lit("를 보완하시기 바랍니다.")),
    )
    return prefer(documents, full, partial, item_keyword(signals, documents, "18", overlaps))


# --- 15 and 17 -----------------------------------------------------------------------------------------------------


def _attachment_branch(
    signals: DataFrame, docs: DataFrame, item_no: str, first: str | None, second: str | None, complete_only: bool = False
) -> DataFrame:
    """Documents of a branch with the combined evidence of up to two page groups."""
    groups = []
    for kind in [first, second]:
        if kind:
            rows = of_kind(signals, f"{item_no}:{kind}").join(docs.select("document_id"), "document_id", "left_semi")
            if complete_only and kind == "title":
                rows = rows.filter("mask = 1")
            groups.append(rows.withColumn("evidence", F.col("text")))
    combined = ev.combine_pages(groups, 5) if groups else None
    return docs.join(gather(combined, text="evidence"), "document_id", "left")


def _attachment_state(signals: DataFrame, documents: DataFrame, item_no: str) -> DataFrame:
    own = signals.filter(F.col("kind").startswith(f"{item_no}:"))
    kind = F.col("kind")
    facts = own.groupBy("document_id").agg(
        F.bool_or(kind == f"{item_no}:declared").alias("declared"), F.bool_or(kind == f"{item_no}:title").alias("title"),
        F.bool_or((kind == f"{item_no}:title") & (F.col("mask") == 1)).alias("complete"),
        F.bool_or(kind == f"{item_no}:reference").alias("reference"), F.bool_or(kind == f"{item_no}:listed").alias("listed"),
        F.min(F.when(kind == f"{item_no}:declared", F.struct("page_no", "seq", "display_no"))).alias("_d"),
    )
    names = ["declared", "title", "complete", "reference", "listed"]
    return documents.select("document_id").join(facts, "document_id", "left").fillna(False, names).withColumn("declared_at", F.col("_d.display_no")).drop("_d")


def item_15(signals: DataFrame, documents: DataFrame) -> DataFrame:
    state = _attachment_state(signals, documents, "15").select("document_id", "declared", "title", "complete", "listed")
    src = "python_attachment_project_period"

    def no(docs, confidence, source, reason):
        return review(docs, "15", FORM, pack.NON_COMPLIANT, True, confidence, source, reason, C_PERIOD)

    def branch(cond: str, first, second, complete_only=False):
        return _attachment_branch(signals, state.filter(cond), "15", first, second, complete_only)

    undeclared = no(branch("complete and not declared", "title", None, True), 0.82, f"{src}_missing_declaration", R_PERIOD["no_declaration"])
    ok = review(branch("complete and declared", "declared", "title", True), "15", FORM, pack.COMPLIANT, True, 0.86, src, R_PERIOD["complete"])
    empty = no(branch("title and not complete", "declared", "title"), 0.82, f"{src}_empty", R_PERIOD["empty"])
    listed = no(branch("not title and listed", "declared", "listed"), 0.8, f"{src}_missing", R_PERIOD["listed"])
    d = F.col("declared")
    rest = no(
        branch("not title and not listed", "declared", None), 0.82,
        F.when(d, f"{src}_missing_attachment").otherwise(f"{src}_missing_all"), F.when(d, R_PERIOD["no_attachment"]).otherwise(R_PERIOD["nothing"]),
    )
    return reduce(lambda a, b: a.unionByName(b), [undeclared, ok, empty, listed, rest])


def impact_branches(signals: DataFrame, documents: DataFrame) -> DataFrame:
    """Judgements of the documents that name the impact assessment."""
    state = _attachment_state(signals, documents, "17")
    src = "python_attachment_sw_impact"
    basis = F.when(F.col("declared_at").isNotNull(), F.concat(F.lit("제안요청서 p."), F.col("declared_at").cast("string"), F.lit("에 영향평가 실시 사업임을 명시하였으나, "))).otherwise("")
    advice = F.concat(basis, F.lit(IMPACT_MISSING))

    def no(cond, first, second, confidence, source, reason, complete_only=False):
        return review(_attachment_branch(signals, state.filter(cond), "17", first, second, complete_only), "17", FORM, pack.NON_COMPLIANT, True, confidence, source, reason, advice)

    undeclared = no("complete and not declared", "title", None, 0.82, f"{src}_missing_declaration", R_IMPACT["no_declaration"], True)
    ok = review(_attachment_branch(signals, state.filter("complete and declared"), "17", "declared", "title", True), "17", FORM, pack.COMPLIANT, True, 0.88, src, R_IMPACT["complete"])
    empty = no("title and not complete", "declared", "title", 0.82, f"{src}_empty", R_IMPACT["empty"])
    refers = no("not title and reference", "declared", "reference", 0.84, f"{src}_missing", R_IMPACT["reference"])
    listed = no("not title and not reference and listed", "declared", "listed", 0.82, f"{src}_missing", R_IMPACT["listed"])
    return reduce(lambda a, b: a.unionByName(b), [undeclared, ok, empty, refers, listed])


def item_17(signals: DataFrame, documents: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    return prefer(documents, impact_branches(signals, documents), item_attachment_fallback(signals, documents, "17", overlaps))


def item_attachment_fallback(signals: DataFrame, documents: DataFrame, item_no: str, overlaps: DataFrame | None = None) -> DataFrame:
    """Title-only guard, criteria overlap, keyword pages, first candidate pages."""
    marked = of_kind(signals, f"{item_no}:candidate").select("document_id").distinct().withColumn("_marked", F.lit(True))
    known = of_kind(signals, f"{item_no}:known").join(marked, "document_id", "left").filter(F.col("_marked").isNull() | (F.col("mask").bitwiseAND(1) == 1))
    bodied = known.filter(F.col("mask").bitwiseAND(2) != 0).select("document_id").distinct()
    empty = gather(blocks.first_rows(known.join(bodied, "document_id", "left_anti"), ["document_id"], _order(), 3))
    branches = [review(empty, item_no, FORM, pack.NON_COMPLIANT, True, 0.78, "python_attachment_title_only", R_TITLE_ONLY, C_TITLE_ONLY)]
    if overlaps is not None:
        branches.append(overlap_review(overlaps, item_no, FORM, 0.88, 0.43, "python_attachment_rag_overlap", "첨부/별첨 후보 페이지에서"))
    weak, none = _candidate_evidence(signals, documents, item_no)
    branches.append(review(weak, item_no, FORM, pack.SUPPLEMENT, True, 0.68, "python_attachment", R_FORM_WEAK, C_FORM_WEAK, human=True))
    branches.append(review(none, item_no, FORM, pack.NEEDS_CHECK, None, 0.34, "python_attachment", R_FORM_NONE, C_FORM_NONE, human=True))
    return prefer(documents, *branches)


# --- items left to an external judge ------------------------------------------------------------------------------------


def undecided_item(documents: DataFrame, item_no: str, judged: DataFrame | None = None) -> DataFrame:
    """Documents without an external judgement of the item."""
    left = documents if judged is None else documents.join(judged.filter(F.col("item_no") == item_no).select("document_id"), "document_id", "left_anti")
    return review(left, item_no, GENERAL, pack.SUPPLEMENT, None, 0.4, "llm_disabled", R_UNDECIDED, C_UNDECIDED, None, None, True, [W_UNDECIDED])


def attachment_guard(external: DataFrame, signals: DataFrame, documents: DataFrame) -> DataFrame:
    """A compliant external judgement of 15 or 17 gives way when no complete attachment exists."""
    kept = ev.keep_attachment_evidence(external)
    out = [kept.filter(~F.col("item_no").isin("15", "17"))]
    for item, rows in [("15", item_15(signals, documents)), ("17", impact_branches(signals, documents))]:
        state = _attachment_state(signals, documents, item)
        incomplete = state.filter("not (complete and declared)").select("document_id")
        verdict = rows.filter(F.col("result") == pack.NON_COMPLIANT).join(incomplete, "document_id", "left_semi")
        own = kept.filter(F.col("item_no") == item)
        swapped = own.filter(F.trim("result") == pack.COMPLIANT).join(verdict.select("document_id"), "document_id", "left_semi")
        out.append(own.join(swapped.select("document_id"), "document_id", "left_anti"))
        out.append(verdict.join(swapped.select("document_id"), "document_id", "left_semi").select(*external.columns))
    return reduce(lambda a, b: a.unionByName(b), out)
