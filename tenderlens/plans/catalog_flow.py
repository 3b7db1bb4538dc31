"""Registered queries: sources and sinks, external exchange, streaming, whole reviews."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.operators import evidence as ev
from tenderlens.operators import external as ex
from tenderlens.operators import judgements as jd
from tenderlens.operators import signals as sg
from tenderlens.operators import verify as vf
from tenderlens.operators import wording as wd
from tenderlens.plans import catalog_evidence as ce
from tenderlens.plans import catalog_judgements as cj
from tenderlens.plans import catalog_pages as cp
from tenderlens.plans import catalog_retrieval as cr
from tenderlens.plans import catalog_verify as cv
from tenderlens.plans import inputs as inp
from tenderlens.plans import oracle_views as ov
from tenderlens.plans import review as rv
from tenderlens.plans.registry import query
from tenderlens.rules import pack
from tenderlens.session import checkpoint_dir, cut_lineage
from tenderlens.sources import pages as sp
from tenderlens.sources import results as sr
from tenderlens.streaming import ingest as st
from tenderlens.streaming.state import store_by_bucket

FLAGS = "has_table, has_attachment, has_eval_table, has_toc, has_blind, has_commercial_sw"


def folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ----------------------------------------------------------------------------------------


@query("scan_pages", f"""
WITH {ov.PAGES}, wanted AS (SELECT doc_id AS document_id FROM labels UNION ALL SELECT doc_id + 10000000000 FROM labels WHERE toxic = 1)
SELECT document_id, page_no, md5(page_text) AS text_md5, 'found' AS state FROM page WHERE document_id IN (SELECT document_id FROM wanted)
UNION ALL SELECT DISTINCT document_id, NULL, NULL, 'missing' FROM wanted WHERE document_id NOT IN (SELECT document_id FROM page)""")
def scan_pages(spark, sf):
    labels = inp.read(spark, sf, "labels")
    wanted = labels.select(F.col("doc_id").alias("document_id")).union(labels.filter("toxic = 1").select(F.col("doc_id") + 10_000_000_000))
    found, missing = sp.scan_pages(inp.pages(spark, sf), wanted)
    none = F.lit(None)
    return found.select("document_id", "page_no", F.md5("page_text").alias("text_md5"), F.lit("found").alias("state")).union(
        missing.select("document_id", none.cast("int"), none.cast("string"), F.lit("missing")))


@query("scan_candidate_jsonl", f"WITH {ov.PAGES}, {cp.FILLED} SELECT document_id, page_no, text_length, printed_page_no, md5(page_text) AS text_md5, {FLAGS}, parser_warning FROM filled")
def scan_candidate_jsonl(spark, sf):
    """Pages written as JSON lines and read back."""
    path = folder(spark, "lines")
    sp.page_lines(inp.pages(spark, sf)).select("line").write.text(path)
    page = sp.scan_candidate_jsonl(spark, path)
    return page.select("document_id", "page_no", "text_length", "printed_page_no", F.md5("page_text").alias("text_md5"), *FLAGS.split(", "), "parser_warning")


@query("import_pages", f"""
WITH {ov.PAGES}, {cp.FILLED} SELECT document_id, count(*) AS page_count, count(parser_warning) AS parse_warning_count, CASE WHEN count(parser_warning) > 0 THEN 'warning' ELSE 'ok' END AS parse_status FROM filled GROUP BY 1""")
def import_pages(spark, sf):
    from tenderlens.operators import pages

    return pages.import_pages(inp.pages(spark, sf))[0]


@query("export_pages", f"""
WITH {ov.PAGES}, src AS (SELECT user_id AS document_id, (event_id % 50 + 1)::INT AS page_no, arg_max(CASE WHEN value > 15 THEN 'gpt' ELSE 'python_prescan' END, event_id) AS source FROM events GROUP BY ALL)
SELECT document_id, page_no, coalesce(source, '') AS source, {ov.count_of('c', pack.REQUIREMENT_HEADERS)} >= 2 AS has_requirement_table, document_name, total_pages
FROM page LEFT JOIN src USING (document_id, page_no) JOIN (SELECT doc_id AS document_id, source || '-' || lang AS document_name, (len(string_split(text, chr(10))) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END)::INT AS total_pages FROM documents) d USING (document_id)""")
def export_pages(spark, sf):
    e = inp.read(spark, sf, "events").select(F.col("user_id").alias("document_id"), (F.col("event_id") % 50 + 1).cast("int").alias("page_no"), "event_id", F.when(F.col("value") > 15, "gpt").otherwise("python_prescan").alias("source"))
    sources = e.groupBy("document_id", "page_no").agg(F.max_by("source", "event_id").alias("source"))
    rows, meta = sp.export_pages(inp.pages(spark, sf), inp.documents(spark, sf), sources)
    return rows.join(meta, "document_id").select("document_id", "page_no", "source", "has_requirement_table", "document_name", "total_pages")


def raw_responses(spark, sf):
    """Extraction responses of one page each, in the three nestings, fenced or broken."""
    p = inp.pages(spark, sf)
    n = F.col("text_length")
    item = F.struct(F.col("page_no").cast("string").alias("pdf_page_no"), F.col("page_text"), F.when(n % 2 == 0, "|a|b|").otherwise("").alias("tables_markdown"),
                    F.concat(F.lit("- "), F.col("page_no").cast("string"), F.lit(" -")).alias("rfp_printed_page_no"), F.col("has_table").alias("has_table_candidate"), "parser_warning")
    body = F.to_json(F.struct(F.array(item).alias("pages")))
    nested = F.to_json(F.struct(F.struct(F.array(item).alias("pages")).alias("result")))
    text = F.when(n % 11 == 0, "no json here").when(n % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n % 3 == 1, nested).otherwise(body)
    return p.select("document_id", F.col("page_no").cast("long").alias("response_id"), F.array("page_no").alias("requested"), text.alias("output_text"))


@query("scan_page_responses", f"""
WITH {ov.PAGES}, joined AS (SELECT document_id, page_no, text_length AS n, has_table, CASE WHEN text_length % 2 = 0 THEN {ov.strip('page_text')} || chr(10) || chr(10) || '[표 추출]' || chr(10) || '|a|b|' ELSE {ov.strip('page_text')} END AS t FROM page)
SELECT document_id, page_no, page_no AS printed_page_no, md5({ov.strip('t')}) AS text_md5, {ov.text_length(ov.strip('t'))}::INT AS text_length, has_table, 'ok' AS state FROM joined WHERE n % 11 <> 0
UNION ALL SELECT document_id, page_no, NULL, NULL, NULL, NULL, 'json_parse_failed' FROM joined WHERE n % 11 = 0""")
def scan_page_responses(spark, sf):
    pages_, errors = sp.scan_page_responses(raw_responses(spark, sf))
    good = pages_.select("document_id", "page_no", "printed_page_no", F.md5("page_text").alias("text_md5"), "text_length", "has_table", F.lit("ok").alias("state"))
    none = F.lit(None)
    bad = errors.select("document_id", F.col("response_id").cast("int"), none.cast("int"), none.cast("string"), none.cast("int"), none.cast("boolean"), F.col("error"))
    return good.union(bad)


def stored_results(spark, sf):
    """Verified rows of the orders written as nested result lines."""
    final = cut_lineage(vf.verify(inp.reviews(spark, sf), inp.parse_statuses(spark, sf)))
    routes = vf.route_items(final.select("document_id", F.when((F.col("item_no") == "2") & (F.col("document_id") % 4 == 1), "2-1").otherwise(F.col("item_no")).alias("item_no")))
    path = folder(spark, "results")
    sr.result_payloads(final, cr.criteria_hits(spark, sf), routes).select("line").write.option("compression", "gzip").text(path)
    return sr.scan_review_results(spark, path)


@query("scan_review_results", cv.verify_sql(False).split("SELECT document_id, item_no, final_status, result AS final_result")[0] + """, route AS (
  SELECT document_id, item_no, CASE WHEN item_no IN ('1','3','4','6','7','14','18') THEN 'rule' WHEN item_no IN ('11','12') THEN 'table' WHEN item_no IN ('2','15','17') THEN 'attachment' ELSE 'llm' END AS route FROM picked)
SELECT document_id, p.item_no, final_status, result AS final_result, array_to_string(evidence_pages, ',') AS pages, route FROM picked p JOIN route USING (document_id)""".replace(", route AS (", ", route AS (", 1))
def scan_review_results(spark, sf):
    final, _, _, routes = stored_results(spark, sf)
    joined = final.join(routes.select("document_id", "item_no", "route"), ["document_id", "item_no"])
    return joined.select("document_id", "item_no", "final_status", "final_result", tx.join_ints(F.col("evidence_pages")).alias("pages"), "route")


@query("scan_review_hits", f"""
WITH {cr.LEGAL}, {cr.CRITERIA}, {cr.ITEMS}, {cr.ITEM_GROUP}, {cr.AUTHORITATIVE}, n AS (SELECT query_item, count(*) AS hits FROM authoritative GROUP BY 1),
stored AS (SELECT DISTINCT l_orderkey AS document_id, CASE WHEN l_orderkey % 18 = 1 AND l_orderkey % 4 = 1 THEN '2-1' ELSE (l_orderkey % 18 + 1)::VARCHAR END AS query_item FROM lineitem),
listed AS (SELECT document_id, query_item, hits FROM stored JOIN n USING (query_item)),
whole AS (SELECT * FROM listed UNION ALL SELECT document_id, '2', hits FROM listed WHERE query_item = '2-1')
SELECT query_item, sum(hits)::BIGINT AS hits, count(DISTINCT document_id) AS documents FROM whole GROUP BY 1""")
def scan_review_hits(spark, sf):
    _, _, hits, _ = stored_results(spark, sf)
    return hits.groupBy("query_item").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("document_id").alias("documents"))


@query("seed_knowledge", "SELECT count(*) AS row_count FROM benchmark")
def seed_knowledge(spark, sf):
    path = folder(spark, "knowledge")
    sr.seed_knowledge(spark, inp.tacit_knowledge(spark, sf), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"))


# --- external exchange -------------------------------------------------------------------------------------------


@query("request_rows")
def request_rows(spark, sf):
    items = inp.legal_requirements(spark, sf).select("item_no").distinct()
    hits = ce.requirement_hits(spark, sf).withColumn("item_no", F.col("query_item")).withColumns({
        "source_type": F.lit("criteria_db"), "source_name": F.lit("legal_requirement"), "location": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    done = ex.request_rows(cut_lineage(inp.pages(spark, sf)), items, cut_lineage(hits))
    return done.select("document_id", "item_no", "role", "page_count", F.md5("payload").alias("payload_md5"))


@query("audit_request_rows", f"""
WITH {ov.PAGES} SELECT document_id, count(*) AS parsed_pages, least(count(*), 20)::INT AS sampled_pages FROM page GROUP BY 1""")
def audit_request_rows(spark, sf):
    return ex.audit_request_rows(inp.pages(spark, sf), inp.documents(spark, sf)).select("document_id", "parsed_pages", "sampled_pages")


ITEM_NO = "(['5', '8', '9', '10', '13', '7', '16', '1'][(page_no % 8) + 1])"


def judgement_responses(spark, sf):
    """Responses for one page in each document and item, fenced or bare, with aliases and gaps."""
    p = inp.pages(spark, sf)
    n = F.col("text_length")
    items = F.array(*[F.lit(i) for i in ["5", "8", "9", "10", "13", "7", "16", "1"]])
    labels = F.array(*[F.lit(x) for x in ["적합", "준수", "미준수", "비대상", "부분준수", "확인 필요", "해당없음"]])
    body = F.to_json(F.struct(
        F.element_at(labels, (n % 7 + 1).cast("int")).alias("result"), F.when(n % 3 == 0, F.lit(True)).alias("is_target"), F.when(n % 4 > 0, (F.lit(0.5) + (n % 5) / 10)).alias("confidence"),
        F.array(F.col("page_no").cast("string"), F.lit("x")).alias("evidence_pages"), F.array("page_text").alias("evidence_text"), F.col("page_text").alias("reason"),
        F.when(n % 2 == 0, "고치시기 바랍니다.").alias("recommendation"), (n % 6 == 0).alias("needs_human_review")))
    one = p.select(
        "document_id", F.element_at(items, (F.col("page_no") % 8 + 1).cast("int")).alias("item_no"), "page_no",
        F.when(n % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("response"))
    first = one.groupBy("document_id", "item_no").agg(F.min_by("response", "page_no").alias("response"))
    return first.withColumn("role", F.lit("general")).withColumn("route_type", F.lit("llm_review"))


RESPONSES = f"""first_page AS (SELECT * FROM (SELECT *, {ITEM_NO} AS item_no FROM page) QUALIFY row_number() OVER (PARTITION BY document_id, item_no ORDER BY page_no) = 1)"""


@query("parse_judgements", f"""
WITH {ov.PAGES}, {RESPONSES}
SELECT document_id, item_no, ['준수', '준수', '미준수', '해당없음', '보완필요', '보완필요', '해당없음'][text_length % 7 + 1] AS result, CASE WHEN text_length % 3 = 0 THEN true END AS is_target,
  round(CASE WHEN text_length % 4 > 0 THEN 0.5 + (text_length % 5) / 10.0::DOUBLE ELSE 0.65 END, 6) AS confidence, page_no::VARCHAR AS pages, page_text AS texts, page_text AS reason,
  CASE WHEN text_length % 2 = 0 THEN '고치시기 바랍니다.' ELSE '' END AS recommendation, text_length % 6 = 0 AS needs_human_review FROM first_page""")
def parse_judgements(spark, sf):
    p = ex.parse_judgements(judgement_responses(spark, sf))
    return p.select("document_id", "item_no", "result", "is_target", F.round("confidence", 6).alias("confidence"), tx.join_ints(F.col("evidence_pages")).alias("pages"), F.array_join("evidence_text", "|").alias("texts"), "reason", "recommendation", "needs_human_review")


def ingested(spark, sf):
    responses = cut_lineage(judgement_responses(spark, sf))
    return ex.ingest_judgements(responses, cut_lineage(inp.pages(spark, sf)), cut_lineage(ce.requirement_hits(spark, sf)))


@query("ingest_judgements")
def ingest_judgements(spark, sf):
    return cj.shown(ingested(spark, sf))


P5 = f"({ov.any_of('c', ['작업장소', '원격지'])} AND {ov.any_of('c', ['상호협의', '사업예산내계상', '관련비용', '제안가격', '원격지개발', '개발방법', '구체적인방안', '발주기관의검토', '보안요구사항', '보안관리', '보안대책', '출입보안', '출입통제'])})"
P9 = f"({ov.any_of('c', ['특정규격', '특정상표', '특정모델', '특정제품', '특정회사', '모델명'])} AND {ov.any_of('c', ['금지', '명시금지', '지정하여', '동등이상', '입찰에부치는경우'])})"
P13 = ov.any_of("page_text", ["제안서 보상", "보상대상"])
P8 = f"""({ov.any_of('c', ['하자담보', '하자보수', '용역계약일반조건'])} AND {ov.any_of('c', ['책임기간', '책임', '기간', '제58조'])}
  AND NOT (contains(c, '하자보수') AND (len(list_distinct(regexp_extract_all(c, '(?i)[A-Z]{{2,5}}-[0-9]{{3}}'))) >= 3 OR contains(c, '요구사항총괄표')))
  AND NOT (contains(c, '하자보수계획') AND {ov.any_of('c', ['제시하여야', '제시하였는지', '제안서', '기술평가', '평가한다', '적정성', '평가항목'])})
  AND NOT ({ov.any_of('c', ['서식', '별지', '자기평가표', '210mm×297mm', '백상지'])} AND {ov.count_of('c', ['사업명', '계약기간', '계약금액', '하도급', '하자담보책임기간'])} >= 3)
  AND NOT ({ov.count_of('c', ['공동수급체', '공동수급협정', '출자비율', '구성원'])} >= 2 AND {ov.all_of('c', ['하자담보책임', '공사'])}))"""


def p10(c):
    """Item 10 of a compact text."""
    chosen, basis, applied = ["사업자선정방법", "낙찰자결정방법", "협상적격자", "계약체결기준", "계약체결방법"], ["제49조", "시행령제44조", "제44조제1항"], ["방법을적용", "적용한다", "체결방법"]
    return f"(contains({c}, '협상에의한계약') AND ({ov.any_of(c, chosen)} OR ({ov.any_of(c, basis)} AND {ov.any_of(c, applied)})))"


def _exact(words):
    cases = " ".join(f"WHEN contains(page_text, '{w}') THEN {ov.window('page_text', w, 360, exact=True)}" for w in words)
    return f"CASE {cases} ELSE substr({ov.collapse('page_text')}, 1, 500) END" if words else f"substr({ov.collapse('page_text')}, 1, 500)"


@query("direct_evidence", f"""
WITH {ov.PAGES}, {ce.PRINTED.replace('printed AS', 'numbered AS')}, own AS (SELECT page.*, printed FROM page JOIN numbered USING (document_id, page_no) WHERE printed IS NOT NULL)
{' UNION ALL '.join(f"SELECT document_id, '{i}' AS item_no, page_no, printed AS page, {_exact(ex.QUOTE_WORDS.get(i, []))} AS text FROM own WHERE {cond}" for i, cond in [('5', P5), ('8', P8), ('9', P9), ('13', P13)])}
UNION ALL (SELECT document_id, item_no, page_no, page, text FROM (SELECT *, {ov.compact('text')} AS tc FROM (
    SELECT document_id, '10' AS item_no, page_no, printed AS page, {_exact(ex.QUOTE_WORDS['10'])} AS text FROM own WHERE {p10('c')}))
  QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN {p10('tc')} THEN 0 ELSE 1 END, page_no) = 1)""")
def direct_evidence(spark, sf):
    """All items that have a rule of their own; of item 10 a document keeps one page."""
    rows = ex.direct_pages(inp.pages(spark, sf), ce.requirement_hits(spark, sf), list(ex.PREDICATES))
    return rows.select("document_id", "item_no", F.col("place.page_no").alias("page_no"), "page", "text")


TERM_ITEMS = [i for i in [*pack.DEFAULT_ITEMS, "2-1"] if i not in ex.PREDICATES and i != "16"]


@query("direct_evidence_by_terms", f"""
WITH {ov.PAGES}, {ov.LEGAL_REQUIREMENTS}, {ce.REQUIREMENT_HIT}, {ce.DIRECT}, {ce.PRINTED.replace('printed AS', 'numbered AS')},
own AS (SELECT page.*, printed FROM page JOIN numbered USING (document_id, page_no) WHERE printed IS NOT NULL AND NOT has_toc AND NOT ({ov.any_of('c', pack.TARGET_MARKERS)} AND NOT {ov.any_of('c', pack.DIRECT_MARKERS)}))
SELECT document_id, item_no, page_no, any_value(printed) AS page FROM own JOIN term ON contains(page_text, term) WHERE list_contains({ov.sql_list(TERM_ITEMS)}, item_no) GROUP BY ALL HAVING count(*) >= 2""")
def direct_evidence_by_terms(spark, sf):
    rows = ex.direct_pages(inp.pages(spark, sf), ce.requirement_hits(spark, sf), TERM_ITEMS)
    return rows.select("document_id", "item_no", F.col("place.page_no").alias("page_no"), "page")


def five_and_eight(spark, sf):
    """Every page as one review of item 5 and one of item 8, its text as the evidence."""
    p = inp.pages(spark, sf)
    both = F.explode(F.array(F.lit("5"), F.lit("8"))).alias("item_no")
    return p.select(
        "document_id", both, "seq", "page_no", F.when(F.col("text_length") % 2 == 0, pack.COMPLIANT).otherwise(pack.SUPPLEMENT).alias("result"), F.array("page_text").alias("evidence_text"),
        F.lit("").alias("reason"), F.lit("own").alias("recommendation"), F.array().cast("array<string>").alias("warnings"))


G5 = [
    f"NOT (contains(c, '작업장소') AND {ov.any_of('c', ['협의', '상호협의', '결정'])} AND {ov.any_of('c', ['비용', '사업예산', '계상', '제안가격', '제안사가부담'])})",
    f"NOT ({ov.any_of('c', ['공급자', '계약상대자', '제안사'])} AND {ov.any_of('c', ['작업장소를제시', '작업장소제시', '제시된작업장소', '우선검토', '검토절차'])})",
    f"NOT ({ov.any_of('c', ['원격개발', '원격지'])} AND {ov.any_of('c', ['보안사고', '위험요인', '대응방안', '보안요구사항'])})",
]
G8 = [
    f"NOT ({ov.any_of('c', ['책임기간', '하자담보책임기간', '하자보수기간'])} AND {ov.any_of('c', ['1년이내', '1년', '12개월'])})",
    f"NOT ({ov.any_of('c', ['제58조', '용역계약일반조건'])} AND {ov.any_of('c', ['하자보수를요청', '하자보수요청', '하자를조치'])} AND {ov.any_of('c', ['유상유지보수', '유상유지관리', '재개발'])} AND {ov.any_of('c', ['하자보수의책임이없', '하자보수책임이없', '책임이없', '책임없'])})",
]


@query("missing_item_5_8", f"""
WITH {ov.PAGES}, v AS (SELECT document_id, page_no, CASE WHEN text_length % 2 = 0 THEN '준수' ELSE '보완필요' END AS result, {', '.join(f'{g} AS a{i}' for i, g in enumerate(G5))}, {', '.join(f'{g} AS b{i}' for i, g in enumerate(G8))} FROM page)
SELECT document_id, page_no, '5' AS item_no, result, CASE WHEN result <> '준수' AND (a0 OR a1 OR a2) THEN '제안요청서에 ' || concat_ws('하고, ', {', '.join(f"CASE WHEN a{i} THEN {ov.quote(p)} END" for i, p in enumerate(ex.PARTS_5))}) || '하시기 바랍니다.' ELSE 'own' END AS recommendation, '' AS reason, '' AS warnings FROM v
UNION ALL SELECT document_id, page_no, '8', CASE WHEN result = '준수' AND (b0 OR b1) THEN '보완필요' ELSE result END, CASE WHEN result = '준수' AND (b0 OR b1) THEN concat_ws(' 및 ', {', '.join(f"CASE WHEN b{i} THEN {ov.quote(p)} END" for i, p in enumerate(ex.PARTS_8))}) || '하시기 바랍니다.' ELSE 'own' END,
  CASE WHEN result = '준수' AND b0 AND b1 THEN {ov.quote(ex.REASON_8_BOTH)} WHEN result = '준수' AND b0 THEN {ov.quote(ex.REASON_8_PERIOD)} WHEN result = '준수' AND b1 THEN {ov.quote(ex.REASON_8_STATEMENT)} ELSE '' END,
  CASE WHEN result = '준수' THEN concat_ws(',', CASE WHEN b0 THEN '{ex.WARN_8[0]}' END, CASE WHEN b1 THEN '{ex.WARN_8[1]}' END) ELSE '' END FROM v""")
def missing_item_5_8(spark, sf):
    done = ex.missing_item_5_8(five_and_eight(spark, sf))
    return done.select("document_id", "page_no", "item_no", "result", "recommendation", "reason", F.array_join("warnings", ",").alias("warnings"))


@query("attachment_guard")
def attachment_guard(spark, sf):
    page = cut_lineage(ce.broken_pages(spark, sf))
    signals = cut_lineage(sg.page_signals(page, ["15", "17"]))
    documents = inp.documents(spark, sf)
    judged = documents.withColumn("item_no", F.explode(F.array(F.lit("15"), F.lit("17"), F.lit("5"))))
    told = page.groupBy("document_id").agg(F.min_by("page_text", "page_no").alias("t"), F.min("page_no").alias("p"))
    external = judged.join(told, "document_id").select(
        "document_id", "item_no", F.lit(0).cast("long").alias("seq"), F.lit("attachment_review").alias("route_type"), F.lit(pack.COMPLIANT).alias("result"), F.lit(True).alias("is_target"), F.lit(0.9).alias("confidence"),
        F.array("p").alias("evidence_pages"), F.array("t").alias("evidence_text"), F.lit("external").alias("reason"), F.lit("").alias("recommendation"), F.lit(False).alias("needs_human_review"), F.lit("external_attachment").alias("source"),
        F.array().cast("array<string>").alias("warnings"), F.lit(True).alias("used_llm"))
    return cj.shown(jd.attachment_guard(external, signals, documents))


def audit_responses(spark, sf):
    e = inp.read(spark, sf, "events")
    one = F.struct(F.array(F.struct((F.col("event_id") % 30 + 1).cast("string").alias("page_no"), (F.col("value") > 10).alias("has_table_candidate"))).alias("page_overrides"),
                   F.array(F.struct(F.when(F.col("value") > 20, "layout_error").alias("warning_type"), (F.col("event_id") % 30 + 1).cast("string").alias("page_no"), F.col("event_type").alias("message"))).alias("warnings"))
    return e.select(F.col("event_id").alias("document_id"), F.concat(F.lit("```"), F.to_json(one), F.lit("```")).alias("response"))


@query("ingest_audit", """
SELECT event_id AS document_id, (event_id % 30 + 1)::INT AS page_no, CASE WHEN value > 20 THEN 'layout_error' ELSE 'gpt_parse_audit' END AS warning_type, event_type AS message, 'medium' AS severity, value > 10 AS has_table FROM events""")
def ingest_audit(spark, sf):
    overrides, warnings = ex.ingest_audit(audit_responses(spark, sf))
    return warnings.join(overrides.select("document_id", "page_no", "has_table"), ["document_id", "page_no"]).select("document_id", "page_no", "warning_type", "message", "severity", "has_table")


@query("ingest_findings", """
SELECT event_id AS document_id, 'x' AS item_no, 0 AS k, CASE WHEN value > 20 THEN 'invalid_routing' ELSE 'schema_or_consistency_error' END AS finding_type, CASE WHEN value > 10 THEN 'high' ELSE 'medium' END AS severity, event_type AS message FROM events""")
def ingest_findings(spark, sf):
    e = inp.read(spark, sf, "events")
    one = F.struct(F.array(F.struct(F.when(F.col("value") > 20, "invalid_routing").alias("finding_type"), F.when(F.col("value") > 10, "high").alias("severity"), F.col("event_type").alias("message"))).alias("findings"))
    done = ex.ingest_findings(e.select(F.col("event_id").alias("document_id"), F.lit("x").alias("item_no"), F.to_json(one).alias("response")))
    return done.select("document_id", "item_no", "k", "finding_type", "severity", "message")


# --- streaming -----------------------------------------------------------------------------------------------------

LATEST = f"{ov.EVENTS}, latest AS MATERIALIZED (SELECT * FROM parse_event QUALIFY row_number() OVER (PARTITION BY job_id, page_no ORDER BY version DESC) = 1)"


def event_stream(spark, sf):
    """The events table as a file stream."""
    schema = inp.read(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    kind = F.col("event_type")
    return raw.select(
        F.col("user_id").alias("job_id"), (F.col("event_id") % 50 + 1).cast("int").alias("page_no"),
        F.when(kind == "purchase", "succeeded").when(kind == "error", "failed").when(kind == "view", "running").otherwise("queued").alias("status"),
        F.when(kind == "purchase", F.when(F.col("value") > 15, "gpt").otherwise("python_prescan")).otherwise("").alias("source"),
        F.when(kind == "error", F.concat(F.lit("value "), F.col("value").cast("string"))).otherwise("").alias("error"), F.col("event_id").alias("version"))


@query("page_ingest_stream", f"WITH {LATEST} SELECT job_id, page_no, status, source, version FROM latest")
def page_ingest_stream(spark, sf):
    log = folder(spark, "log")
    st.page_ingest_stream(event_stream(spark, sf), log, folder(spark, "commits")).awaitTermination()
    return st.latest_state(st.read_log(spark, log)).select("job_id", "page_no", "status", "source", "version")


def jobs(spark, sf):
    e = inp.parse_events(spark, sf)
    return e.groupBy("job_id").agg(F.count_distinct("page_no").alias("selected_pages")).withColumn("total_pages", F.lit(50))


def selected(spark, sf):
    return inp.parse_events(spark, sf).select("job_id", "page_no").distinct()


@query("job_progress", f"""
WITH {LATEST}, job AS (SELECT job_id, count(DISTINCT page_no) AS selected_pages FROM parse_event GROUP BY 1),
n AS (SELECT job_id, count(*) FILTER (status = 'succeeded') AS processed_pages, count(*) FILTER (status = 'failed') AS failed_pages, count(*) FILTER (status = 'succeeded' AND source = 'python_prescan') AS python_pages, count(*) FILTER (status = 'succeeded' AND source = 'gpt') AS gpt_pages FROM latest GROUP BY 1)
SELECT job_id, selected_pages, processed_pages, failed_pages, python_pages, gpt_pages, round_even(processed_pages / selected_pages::DOUBLE * 100, 0)::INT AS progress_percent FROM job JOIN n USING (job_id)""")
def job_progress(spark, sf):
    return st.job_progress(st.latest_state(inp.parse_events(spark, sf)), jobs(spark, sf)).drop("total_pages")


@query("progress_stream", f"""
WITH {LATEST}, job AS (SELECT job_id, count(DISTINCT page_no) AS selected_pages FROM parse_event GROUP BY 1),
n AS (SELECT job_id, count(*) FILTER (status = 'succeeded') AS processed_pages, count(*) FILTER (status = 'failed') AS failed_pages, count(*) FILTER (status = 'succeeded' AND source = 'gpt') AS gpt_pages FROM latest GROUP BY 1)
SELECT job_id, selected_pages, processed_pages, failed_pages, gpt_pages, round_even(processed_pages / selected_pages::DOUBLE * 100, 0)::INT AS progress_percent FROM job JOIN n USING (job_id)""")
def progress_stream(spark, sf):
    out = folder(spark, "progress")
    st.progress_stream(event_stream(spark, sf), cut_lineage(jobs(spark, sf)), folder(spark, "state"), out, folder(spark, "commits")).awaitTermination()
    return st.current_progress(spark, out).select("job_id", "selected_pages", "processed_pages", "failed_pages", "gpt_pages", "progress_percent")


@query("pending_pages", f"WITH {LATEST} SELECT DISTINCT job_id, page_no FROM parse_event EXCEPT SELECT job_id, page_no FROM latest WHERE status = 'succeeded'")
def pending_pages(spark, sf):
    return st.pending_pages(selected(spark, sf), st.latest_state(inp.parse_events(spark, sf)))


@query("fail_running", f"""
WITH {LATEST}, bad AS (SELECT job_id, arg_max(error, version) AS error FROM parse_event WHERE status = 'failed' GROUP BY 1)
SELECT job_id, page_no, 'failed' AS status, bad.error AS error, version + 1 AS version FROM latest JOIN bad USING (job_id) WHERE status = 'running' AND job_id % 4 > 0""")
def fail_running(spark, sf):
    e = inp.parse_events(spark, sf)
    failures = e.filter("status = 'failed'").groupBy("job_id").agg(F.max_by("error", "version").alias("error"))
    state = e.select("job_id").distinct().withColumn("status", F.when(F.col("job_id") % 4 == 0, "succeeded").otherwise("running"))
    return st.fail_running(st.latest_state(e), failures, state).select("job_id", "page_no", "status", "error", "version")


@query("finished_jobs", f"""
WITH {ov.EVENTS} SELECT version // 5 AS job_id FROM parse_event GROUP BY 1 HAVING bool_and(status <> 'queued')""")
def finished_jobs(spark, sf):
    """Five consecutive events are a job here; every outcome but a queued page counts as a success."""
    e = inp.parse_events(spark, sf).withColumn("job_id", F.expr("version DIV 5"))
    state = st.latest_state(e).withColumn("status", F.when(F.col("status") == "queued", "queued").otherwise("succeeded"))
    return st.finished_jobs(e.select("job_id", "page_no"), state)


@query("finalize_documents")
def finalize_documents(spark, sf):
    page, documents = cut_lineage(inp.pages(spark, sf)), cut_lineage(inp.documents(spark, sf))
    status, _ = st.finalize_documents(page, documents, documents.select("document_id"))
    return status.select("document_id", "parse_status", "audit_score", "audit_warning_count", "parse_warning_count")


@query("finalize_stream")
def finalize_stream(spark, sf):
    """Events end pages; documents whose pages all succeeded are finalised from within the stream."""
    e = inp.parse_events(spark, sf)
    wanted = e.filter("status = 'succeeded'").select("job_id", "page_no").distinct()
    stored = []
    for df, key in ((inp.pages(spark, sf), "document_id"), (inp.documents(spark, sf), "document_id"), (wanted, "job_id")):
        path = folder(spark, "store")
        store_by_bucket(df, key, path)
        stored.append(spark.read.parquet(path))
    out = folder(spark, "final")
    st.finalize_stream(event_stream(spark, sf).filter("status = 'succeeded'"), *stored, folder(spark, "state"), out, folder(spark, "commits")).awaitTermination()
    return spark.read.parquet(out).select("document_id", "parse_status", "audit_score", "parse_warning_count")


@query("hybrid_route_stream", f"""
WITH {ov.PAGES}, {cp.PRESCAN} SELECT document_id, page_no, NOT nav AND (n < 120 OR n = 0 OR noise > 0.03 OR relevant OR req OR ev OR layout OR dense OR legal) AS needs_extraction FROM flagged""")
def hybrid_route_stream(spark, sf):
    staged = folder(spark, "pages")
    inp.pages(spark, sf).write.parquet(staged)
    stream = spark.readStream.schema(spark.read.parquet(staged).schema).parquet(staged)
    easy, hard = folder(spark, "accepted"), folder(spark, "queue")
    st.hybrid_route_stream(stream, easy, hard, folder(spark, "commits")).awaitTermination()
    return spark.read.parquet(f"{easy}/batch=*", f"{hard}/batch=*").select("document_id", "page_no", "needs_extraction")


# --- whole reviews ---------------------------------------------------------------------------------------------------


def reviewed(spark, sf, items):
    page = cut_lineage(inp.pages(spark, sf))
    criteria = (*cr.tables(spark, sf), inp.tacit_knowledge(spark, sf))
    return page, rv.review_documents(page, inp.documents(spark, sf), criteria, items)


@query("review_documents")
def review_documents(spark, sf):
    _, done = reviewed(spark, sf, rv.ALL_ITEMS)
    f = done.final
    return f.select("document_id", "item_no", "final_status", "final_result", "is_target", "confidence", tx.join_ints(F.col("evidence_pages")).alias("pages"), "compliance_content")


@query("review_state")
def review_state(spark, sf):
    items = rv.ALL_ITEMS
    page, done = reviewed(spark, sf, items)
    hits = cr.criteria_hits(spark, sf)
    _, state = rv.review_state(done, page, hits, items)
    return state.select("document_id", "parse_status", "audit_score", F.array_join("completed_items", ",").alias("completed"), F.array_join("remaining_items", ",").alias("remaining"), "pages_to_reparse")


@query("review_rows")
def review_rows(spark, sf):
    """Item rows of a whole review, with hits by reference, judgement and final row."""
    _, done = reviewed(spark, sf, rv.ALL_ITEMS)
    rows = rv.item_rows(done, cr.criteria_hits(spark, sf))
    shown = F.transform("hits", lambda h: F.concat_ws("/", h["rank_group"].cast("string"), h["rank"].cast("string"), h["source_type"]))
    return rows.select("document_id", "item_no", "route", F.array_join(shown, ",").alias("hits"), "judgement.result", "judgement.source", "final.final_status", "final.final_result")
