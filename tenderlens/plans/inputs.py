"""Input relations that Spark derives from the given tables, for the registered queries.

The tables hold invented prose in Latin script, the rule pack speaks Korean.  A codebook therefore turns every
word of five or more letters into a domain phrase chosen by a hash of the word; shorter words stay.  The same
word always gives the same phrase, so repeated and embedded passages stay repeated and embedded.  Lines of a
document are its pages.  The row counts and text volumes are those of the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.rules import pack

# The codebook, in hash order.
CODEBOOK = [
    "하도급 사전승인", "하도급 계획서 제출", "하도급 적정성 판단", "하도급계획 적정성 확인서", "원칙적으로 불허",
    "하도급", "100분의 50을 초과할 수 없음", "50을 초과할 수 없음", "시정 요구", "관리 감독",
    "85점 이상 승인", "10% 공동수급체", "상세 요구사항", "기타사항", "본 사업은 하도급을 허용하지 않음",
    "지식재산권은 공동으로 소유", "계약목적물", "계약상대자", "SW 산출물", "반출을 요청할 수",
    "반출 절차 검토", "누출금지정보를 삭제하고", "대표자 명의 확약서 제출", "제3자에게 제공 시 사전승인", "입찰참가자격 제한",
    "무단유출", "SW사업 산출물 활용 보장", "산출물 활용", "제재요건", "공급자",
    "과업심의위원회", "공동 활용할 계획", "대기업 및 중견기업", "20억원 미만", "입찰에 참여할 수 없음",
    "중소 소프트웨어사업자", "총 사업금액 5억원", "사업예산 35억 원", "추정가격 1억2천만원", "하도급금액 3억원",
    "계약금액 9억원", "사업 예산 2,500백만원", "배점 30점", "평가항목", "평가 기준",
    "기술능력평가 90점", "가격평가 10점", "차등점수제 적용", "차등점수제 미적용", "순위간 점수차",
    "하자보수 비상 대책", "동점인 경우", "원점수 기준의 순위별 점수차가 차등점수보다 큰 경우", "하도급 계획 적정성 5점", "요구사항 총괄표",
    "요구사항 고유번호", "요구사항 명칭", "상세 세부내용", "산출정보", "정의",
    "기능 요구사항", "성능 요구사항", "보안 요구사항", "품질 요구사항", "SW사업정보",
    "데이터 작성 및 제출", "SW 사업정보 저장소", "www.spir.kr", "투입인력", "업무분장",
    "SFR-001", "적정 사업기간", "소프트웨어 개발사업", "종합산정서", "본 사업",
    "제10조", "별지 제4호서식", "소프트웨어사업 영향평가", "소프트웨어사업 영향평가 결과서", "영향평가를 실시",
    "결과서 첨부", "별첨 1 참조", "붙임", "서식", "사업명",
    "위원명", "산정기준", "산정결과", "종합의견", "추후 제출",
    "상용SW", "상용소프트웨어 직접구매", "직접구매", "해당 없음", "BMT",
    "별표3 34종", "경쟁입찰", "종합쇼핑몰 미등록", "하자담보 책임기간 1년", "용역계약일반조건 제58조",
    "하자보수를 요청", "유상 유지보수", "책임이 없음", "작업장소 상호협의", "원격지 개발",
    "보안대책", "관련 비용 계상", "특정규격 금지", "모델명", "협상에 의한 계약",
    "낙찰자 결정방법", "제안서 보상", "사업 개요", "제안 요청", "현황분석",
    "개선과제", "정보화", "설계", "부서명", "담당",
]
SLOTS = 160
TOC_SLOTS = 1200
MIN_LETTERS = 5


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table == "documents" else df


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a scan yields fewer splits than there are cores, as one small file does.

    Only then: a table of many files is left as it was read, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def encode(text: Column) -> Column:
    """Codebook form of a text, word by word."""
    book = F.array(*[F.lit(p) for p in CODEBOOK])

    def word(w: Column) -> Column:
        def coded(slot: Column) -> Column:
            return F.when(slot % TOC_SLOTS == 7, F.lit("목차")).otherwise(F.coalesce(F.try_element_at(book, slot % SLOTS + 1), w))

        slot = F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int")
        return F.when(F.length(w) < MIN_LETTERS, w).otherwise(tx.let(slot, coded))

    return F.array_join(F.transform(F.split(text, " "), word), " ")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, page_no, page_text in the tables' own words."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return docs.select(
        F.col("doc_id").alias("document_id"), F.posexplode("lines").alias("_pos", "page_text")
    ).select("document_id", (F.col("_pos") + 1).alias("page_no"), "page_text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table of the stand-in corpus."""
    lines = raw_lines(spark, sf_dir).withColumn("page_text", encode(F.col("page_text")))
    lines = lines.withColumn("_c", tx.compact(F.col("page_text")))
    c, n = F.col("_c"), tx.text_length(F.col("page_text"))
    anchored = n % 3 == 0
    return lines.select(
        "document_id",
        F.col("page_no").cast("long").alias("seq"),
        "page_no",
        "page_text",
        n.alias("text_length"),
        F.when(anchored, (F.col("page_no") + F.col("document_id") % 7 - 3).cast("int")).alias("printed_page_no"),
        c.contains("요구사항총괄표").alias("has_table"),
        tx.contains_any(c, pack.ATTACHMENT_MARKERS).alias("has_attachment"),
        tx.contains_any(c, ["평가항목", "평가기준"]).alias("has_eval_table"),
        c.contains("목차").alias("has_toc"),
        c.contains("위원명").alias("has_blind"),
        tx.contains_any(c, pack.COMMERCIAL_SW).alias("has_commercial_sw"),
        F.when(n < 4, "OCR empty").when(n % 31 == 0, "layout check").alias("parser_warning"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents; every fifth has one page more than was extracted."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.concat(F.col("source"), F.lit("-"), F.col("lang")).alias("document_name"),
        (F.size(F.split("text", "\n")) + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("total_pages"),
    )


def repeated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages numbered so that every second number occurs twice, with different text."""
    return pages(spark, sf_dir).withColumn("page_no", F.floor((F.col("page_no") + 2) / 3).cast("int"))


def first_line(text: str = "text") -> Column:
    return F.substring_index(text, "\n", 1)


def legal_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seventeen items; the target text of an item joins all its rows, every third item has none."""
    row = F.struct("item_id", encode(F.col("text")).alias("text"), encode(first_line()).alias("line"))
    items = read(spark, sf_dir, "benchmark").groupBy((F.col("item_id") % 17).alias("k")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return items.select(
        (F.col("k") + 1).cast("string").alias("item_no"),
        F.element_at("rows", 1)["line"].alias("title"),
        F.when(F.col("k") % 3 > 0, F.array_join(F.transform("rows", lambda r: r["text"]), "\n")).alias("target_text"),
    )


def legal_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    whole = encode(F.col("text"))
    return b.select(
        F.col("item_id").alias("row_id"),
        F.when(F.col("item_id") % 20 == 19, "2-1").otherwise((F.col("item_id") % 18 + 1).cast("string")).alias("item_no"),
        F.when(F.col("item_id") % 4 > 0, F.concat(F.lit("category "), (F.col("item_id") % 4).cast("string"))).alias("category"),
        whole.alias("requirement_text"),
        F.when(F.col("item_id") % 2 == 0, encode(first_line())).alias("example_sentence"),
        F.when(F.col("item_id") % 5 == 0, whole).alias("case_text"),
    )


def legal_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("row_id"),
        F.when(F.col("item_id") % 3 == 0, "14").otherwise((F.col("item_id") % 18 + 1).cast("string")).alias("item_no"),
        F.when(F.col("item_id") % 4 == 1, "table").alias("reference_type"),
        F.when(F.col("item_id") % 7 > 2, "summary").alias("reference_subtype"),
        encode(F.col("text")).alias("content"),
    )


def tacit_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("row_id"),
        F.when(F.col("item_id") % 12 == 0, pack.COMMON_ITEM).otherwise((F.col("item_id") % 18 + 1).cast("string")).alias("item_no"),
        encode(first_line()).alias("title"),
        encode(F.col("text")).alias("content"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order = (document, item), order lines = its primary reviews."""
    li = read(spark, sf_dir, "lineitem")
    seq = F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey")
    page = F.col("l_linenumber")
    cited = F.when(F.col("l_quantity") > 45, F.array().cast("array<int>")).otherwise(
        F.array(page, (page + F.col("l_suppkey") % 3).cast("int"))
    )
    quoted = F.transform(cited, lambda p: F.concat(F.lit("line "), p.cast("string"), F.lit(" part "), (F.col("l_partkey") % 10).cast("string")))
    return li.select(
        F.col("l_orderkey").alias("document_id"),
        (F.col("l_orderkey") % 18 + 1).cast("string").alias("item_no"),
        seq.alias("seq"),
        F.when(F.col("l_suppkey") % 2 == 0, "rule_review").otherwise("table_review").alias("route_type"),
        F.when(F.col("l_returnflag") == "A", pack.COMPLIANT).when(F.col("l_returnflag") == "N", pack.NON_COMPLIANT)
        .otherwise(pack.SUPPLEMENT).alias("result"),
        F.when(F.col("l_tax") < 0.01, F.lit(False)).when(F.col("l_linestatus") == "O", F.lit(True)).alias("is_target"),
        F.round(0.95 - F.col("l_discount") * 4, 3).alias("confidence"),
        cited.alias("evidence_pages"),
        quoted.alias("evidence_text"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" shipped")).alias("reason"),
        F.when(F.col("l_returnflag") != "A", F.concat(F.lit("check part "), F.col("l_partkey").cast("string"))).otherwise("").alias("recommendation"),
        (F.col("l_tax") > 0.06).alias("needs_human_review"),
        F.when(F.col("l_quantity") < 4, "llm_disabled").otherwise("python_rule").alias("source"),
        F.array().cast("array<string>").alias("warnings"),
        F.lit(False).alias("used_llm"),
    )


def parse_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"),
        F.when(F.col("o_orderpriority").startswith("1"), "fail").otherwise("ok").alias("parse_status"),
    )


RESULT_CYCLE = ["준수", "미준수", "보완필요", "해당없음", "확인필요", "준수", "비대상", "확인 필요"]


def finals(spark: SparkSession, sf_dir: str, page: DataFrame | None = None) -> DataFrame:
    """One final review per page of the corpus (`page`, if it is there already), carrying that page's text, in halves and whole, as evidence."""
    p = pages(spark, sf_dir) if page is None else page
    n, length = F.col("page_no"), F.col("text_length")
    t = F.col("page_text")
    half, rest = F.expr("substring(page_text, 1, floor(length(page_text) / 2))"), F.expr("substring(page_text, floor(length(page_text) / 2) + 1)")
    cited = F.when(length % 6 == 0, F.array().cast("array<int>")).otherwise(
        F.array(n, (n + 1).cast("int"), (n + 1 + length % 3).cast("int"))
    )
    quoted = F.when(length % 6 == 0, F.array().cast("array<string>")).otherwise(
        F.array(half, rest, t)
    )
    return p.select(
        "document_id",
        (n % 18 + 1).cast("string").alias("item_no"),
        "page_no",
        F.when(length % 4 == 0, pack.STATUS_AUTO).otherwise(pack.STATUS_HUMAN).alias("final_status"),
        F.element_at(F.array(*[F.lit(r) for r in RESULT_CYCLE]), (length % 8 + 1).cast("int")).alias("final_result"),
        F.when(length % 7 == 0, F.lit(False)).when(length % 7 < 5, F.lit(True)).alias("is_target"),
        (F.lit(0.4) + (length % 60) / 100).alias("confidence"),
        cited.alias("evidence_pages"),
        quoted.alias("evidence_text"),
        rest.alias("reason"),
        F.when(length % 5 == 0, "").when(
            length % 5 == 1, F.concat(F.lit("제안요청서 p."), n.cast("string"), F.lit("에 "), t, F.lit(" 명시하시기 바랍니다."))
        ).when(length % 5 == 2, F.concat(F.lit("누락된 필수 문구를 보완하시기 바랍니다. "), t))
        .when(length % 5 == 3, F.concat(half, F.lit(" -> 제안요청서에 "), rest, F.lit(" 예를 들어 "), half))
        .otherwise(F.concat(F.lit("제안서 "), t)).alias("recommendation"),
        F.when(length % 9 == 0, F.array(F.lit("low"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


FINAL_PAGE = ["document_id", "page_no", "page_text", "text_length"]


def first_finals(spark: SparkSession, sf_dir: str, page: DataFrame | None = None) -> DataFrame:
    """The final review of each document's and item's first page; the page is chosen before its evidence is made."""
    p = pages(spark, sf_dir) if page is None else page
    first = p.groupBy("document_id", (F.col("page_no") % 18).alias("_k")).agg(F.min_by(F.struct(*FINAL_PAGE[1:]), "page_no").alias("p"))
    return finals(spark, sf_dir, first.select("document_id", "p.*"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer feedback: one row per conversation turn, addressed to a document and a page's item."""
    c = read(spark, sf_dir, "conversations")
    k = F.col("conv_id") + F.col("turn")
    return c.select(
        F.col("conv_id").alias("document_id"),
        (F.col("turn") + 1).cast("int").alias("page_no"),
        F.when(k % 3 == 0, F.col("text")).otherwise("").alias("comment"),
        F.element_at(F.array(F.lit(""), F.lit("준수"), F.lit("미준수"), F.lit("보완필요"), F.lit("해당없음")), (k % 5 + 1).cast("int")).alias("corrected_result"),
        F.when(k % 4 == 0, F.col("text")).otherwise("").alias("manual_content"),
        (k % 2 == 0).alias("manual_edited"),
        (F.col("role") == "assistant").alias("resolved"),
    )


def parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("job_id"),
        (F.col("event_id") % 50 + 1).cast("int").alias("page_no"),
        F.when(kind == "purchase", "succeeded").when(kind == "error", "failed").when(kind == "view", "running")
        .otherwise("queued").alias("status"),
        F.when(kind == "purchase", F.when(F.col("value") > 15, "gpt").otherwise("python_prescan")).otherwise("").alias("source"),
        F.when(kind == "error", F.concat(F.lit("value "), F.col("value").cast("string"))).otherwise("").alias("error"),
        F.col("event_id").alias("version"),
    )


def criteria_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as searchable criteria rows, so that search runs over a table that grows."""
    d = read(spark, sf_dir, "documents")
    kinds = F.array(F.lit("criteria_db"), F.lit("requirement_db"), F.lit("reference_example_db"), F.lit("criteria_excel"))
    return d.select(
        F.col("doc_id"), (F.col("doc_id") % 18 + 1).cast("string").alias("item_no"),
        F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("source_type"),
        F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("row_no"),
        first_line().alias("title"), F.col("lang").alias("category"), F.col("text").alias("content"),
    )


def criteria_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 20 == 19, "2-1").otherwise((F.col("item_id") % 18 + 1).cast("string")).alias("item_no"),
        F.col("text").alias("query"),
    )


def item_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items named by the criteria table, with the sub-item."""
    return legal_requirements(spark, sf_dir).select("item_no").union(legal_items(spark, sf_dir).select("item_no")).distinct()


def escalated_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored verdicts of a higher judge for some orders."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.filter("o_orderstatus = 'F'").select(
        k.alias("document_id"), (k % 18 + 1).cast("string").alias("item_no"), F.lit(0).cast("long").alias("seq"), F.lit("verification_escalation").alias("route_type"),
        F.when(k % 2 == 0, pack.COMPLIANT).otherwise(pack.NON_COMPLIANT).alias("result"), F.lit(True).alias("is_target"), F.lit(0.8).alias("confidence"),
        F.array(F.lit(99)).alias("evidence_pages"), F.array(F.lit("cited")).alias("evidence_text"), F.lit("escalated").alias("reason"), F.lit("").alias("recommendation"),
        F.lit(False).alias("needs_human_review"), F.lit("external_escalation").alias("source"), F.array().cast("array<string>").alias("warnings"), F.lit(True).alias("used_llm"),
    )


def sub_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two final rows per order at most: its first odd and its first even line, as item 2 and 2-1 or twice item 4."""
    r = reviews(spark, sf_dir).withColumn("_sub", F.floor(F.col("seq") / 1_000_000_000_000).cast("int") % 2)
    names = ["result", "is_target", "confidence", "evidence_pages", "evidence_text", "reason", "recommendation", "source"]
    one = r.groupBy("document_id", "_sub").agg(F.min_by(F.struct(*names), "seq").alias("r"))
    item = F.when(F.col("document_id") % 2 == 1, "4").when(F.col("_sub") == 1, "2").otherwise("2-1")
    return one.select(
        "document_id", item.alias("item_no"), (2 - F.col("_sub")).cast("long").alias("seq"), F.col("r.source").alias("final_status"), F.col("r.result").alias("final_result"),
        "r.is_target", "r.confidence", "r.evidence_pages", "r.evidence_text", "r.reason", "r.recommendation", F.array(F.col("r.source")).alias("warnings"),
    )
