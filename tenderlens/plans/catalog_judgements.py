"""Registered queries: item judgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.operators import evidence as ev
from tenderlens.operators import judgements as jd
from tenderlens.operators import requirements as rq
from tenderlens.operators import signals as sg
from tenderlens.plans import catalog_evidence as ce
from tenderlens.plans import inputs as inp
from tenderlens.plans import oracle_views as ov
from tenderlens.plans.registry import ORACLES, query
from tenderlens.rules import pack
from tenderlens.session import cut_lineage

COLUMNS = "document_id, item_no, result, is_target, confidence, pages, texts_md5, reason, recommendation, source"


def shown(rv):
    return rv.select(
        "document_id", "item_no", "result", "is_target", "confidence", tx.join_ints(F.col("evidence_pages")).alias("pages"),
        F.md5(F.array_join("evidence_text", "|")).alias("texts_md5"), "reason", "recommendation", "source",
    )


def corpus(spark, sf, *items):
    page = cut_lineage(inp.pages(spark, sf))
    return page, cut_lineage(sg.page_signals(page, list(items))), inp.documents(spark, sf)


BASE = f"""{ov.PAGES}, shown AS MATERIALIZED (SELECT document_id, page_no, page_text AS t, page_text, c, lower(c) AS low, has_toc, has_table, has_eval_table,
    has_attachment, has_blind, has_commercial_sw, printed_page_no, {ce.SHOWN} AS display_no, NOT has_toc AS body FROM page),
doc AS (SELECT doc_id AS document_id FROM documents)"""


def take(name, source, n, order="page_no"):
    return f"""{name} AS (SELECT document_id, string_agg(display_no, ',' ORDER BY k) AS pages, string_agg(text, '|' ORDER BY k) AS texts, count(*) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY {order}) AS k FROM {source}) WHERE k <= {n} GROUP BY 1)"""


def row(item, result, target, confidence, pages, texts, reason, recommendation, source):
    q = lambda v: v if v.startswith(("CASE", "(", "coalesce", "b.", "a.")) else ov.quote(v)
    return (
        f"document_id, '{item}' AS item_no, {q(result)} AS result, {target}::BOOLEAN AS is_target, {confidence}::DOUBLE AS confidence, coalesce({pages}, '') AS pages, "
        f"md5(coalesce({texts}, '')) AS texts_md5, {q(reason)} AS reason, {q(recommendation)} AS recommendation, {q(source)} AS source"
    )


def keyword_cte(item, name="kw"):
    words = pack.RULE_KEYWORDS[item]
    return f"{name}_row AS (SELECT document_id, page_no, display_no, {ov.first_window('t', 'low', words, 80)} AS text FROM shown WHERE body AND {ov.any_of('low', [tx.squeeze(w).lower() for w in words])}), {take(name, f'{name}_row', 3)}"


OPEN = lambda item: f"SELECT {row(item, pack.NEEDS_CHECK, 'true', 0.52, 'NULL', 'NULL', jd.R_RULE_OPEN, jd.C_RULE_OPEN, 'python_rule')}"


def keyword_branches(item, without):
    """Keyword evidence, else open, for the documents that no earlier branch holds."""
    skip = " AND ".join(f"document_id NOT IN (SELECT document_id FROM {w})" for w in without) or "true"
    return (
        f"SELECT {row(item, pack.COMPLIANT, 'true', 0.88, 'pages', 'texts', jd.R_RULE_OK, '', 'python_rule')} FROM kw WHERE {skip}\n"
        f"UNION ALL {OPEN(item)} FROM doc WHERE {skip} AND document_id NOT IN (SELECT document_id FROM kw)"
    )


def overlaps(spark, sf, page):
    return ev.overlap_evidence(ev.accepted_overlap(ev.page_words(page), ce.requirement_hits(spark, sf)), page)


OVERLAP = f"""{ov.LEGAL_REQUIREMENTS}, {ce.REQUIREMENT_HIT}, {ce.OVERLAP_HITS}, overlap AS (
  SELECT b.document_id, query_item AS item_no, coverage, display_no::VARCHAR AS pages, {ov.collapse("substr(t, greatest(at0 - 80, 0) + 1, least(at0 + w + 80, length(t)) - greatest(at0 - 80, 0))")} AS texts FROM (
    SELECT b.*, display_no, t, instr(lower(t), keyword) - 1 AS at0, length(keyword) AS w FROM best b JOIN shown s ON s.document_id = b.document_id AND s.page_no = b.page_no WHERE coverage >= 0.7) b)"""


@query("item_keyword", f"""
WITH {BASE}, {keyword_cte('1')}, {OVERLAP}, near AS (SELECT * FROM overlap WHERE item_no = '1' AND document_id NOT IN (SELECT document_id FROM kw))
SELECT {row('1', pack.COMPLIANT, 'true', 0.88, 'pages', 'texts', jd.R_RULE_OK, '', 'python_rule')} FROM kw
UNION ALL SELECT {row('1', pack.COMPLIANT, 'true', ov.round_thousandths('least(0.9, 0.45 + coverage * 0.5)'), 'pages', 'texts', "('DB 기준문구 핵심 키워드의 ' || printf('%.0f', coverage * 100) || '%가 RFP 후보 페이지에서 확인되어 70% 기준을 충족했습니다.')", '', 'python_rule_rag_overlap')} FROM near
UNION ALL {OPEN('1')} FROM doc WHERE document_id NOT IN (SELECT document_id FROM kw) AND document_id NOT IN (SELECT document_id FROM near)""")
def item_keyword(spark, sf):
    page, signals, documents = corpus(spark, sf, "1")
    return shown(jd.item_keyword(signals, documents, "1", overlaps(spark, sf, page)))


@query("item_7", f"WITH {BASE}, {keyword_cte('7')} {keyword_branches('7', [])}")
def item_7(spark, sf):
    _, signals, documents = corpus(spark, sf, "7")
    return shown(jd.item_keyword(signals, documents, "7"))


AMOUNT_TEXT = "CASE WHEN amount_won % 100000000 = 0 THEN (amount_won // 100000000)::VARCHAR ELSE regexp_replace(printf('%.1f', amount_won / 100000000.0::DOUBLE), '\\.?0+$', '') END || '억 원'"
TARGETS = f"""src AS (SELECT document_id, string_agg(t, ' ' ORDER BY page_no) AS s, {ov.compact("string_agg(t, ' ' ORDER BY page_no)")} AS cs FROM shown WHERE body GROUP BY 1),
direct AS (SELECT document_id FROM src WHERE {ov.any_of('cs', pack.COMMERCIAL_SW)} AND {ov.any_of('cs', pack.PURCHASE_ACTIONS)}
  AND NOT ({' OR '.join(f"regexp_matches(s, '(?s){w}.{{0,{pack.NEGATION_REACH - len(n)}}}{n}')" for w in [*pack.COMMERCIAL_SW, *pack.PURCHASE_ACTIONS] for n in pack.NEGATIONS)})),
signal AS (SELECT DISTINCT document_id FROM shown WHERE body AND {ce.SIGNAL}),
big AS (SELECT * FROM amount WHERE amount_won >= 300000000 AND (document_id IN (SELECT document_id FROM direct) OR document_id IN (SELECT document_id FROM signal)))"""


@query("item_2", f"""
WITH {BASE}, {ce.AMOUNTS}, {TARGETS}
SELECT {row('2', pack.SUPPLEMENT, 'true', 0.82, 'amount_page::VARCHAR', 'context', f"('총 사업금액 ' || {AMOUNT_TEXT} || ' 및 상용SW 구매 가능성이 확인되어 상용SW 직접구매 대상 여부 확인이 필요합니다.')", jd.C_PURCHASE, 'python_attachment_direct_purchase_target_advisory')} FROM big
UNION ALL SELECT {row('2', pack.NOT_APPLICABLE, 'false', 0.78, 'NULL', 'NULL', jd.R_PURCHASE_NO, '', 'python_attachment_direct_purchase_not_target')} FROM doc WHERE document_id NOT IN (SELECT document_id FROM big)""")
def item_2(spark, sf):
    page, signals, documents = corpus(spark, sf, "2")
    return shown(jd.item_2(signals, documents, page))


JOINED = ov.spans("src", "s", ov.AMOUNT, "document_id, cs", "near_span")
NEAR = "substr(t, greatest(start - 80, 0) + 1, least(start + length(value) + 80, length(t)) - greatest(start - 80, 0))"


@query("bmt_targets", f"""
WITH {BASE}, src AS (SELECT document_id, string_agg(t, ' ' ORDER BY page_no) AS s, {ov.compact("string_agg(t, ' ' ORDER BY page_no)")} AS cs FROM shown WHERE body GROUP BY 1),
{JOINED}, won AS (SELECT document_id, max({ov.amount('value')}) AS a FROM near_span WHERE {ov.any_of(NEAR, [*pack.COMMERCIAL_SW, *pack.PURCHASE_ACTIONS])} GROUP BY 1)
SELECT document_id FROM src JOIN won USING (document_id) WHERE a >= 100000000 AND {ov.any_of('cs', ['경쟁입찰', '일반경쟁', '제한경쟁'])}
  AND ({ov.all_of('cs', ['별표3', '34종'])} OR {ov.count_of('cs', ['별표3', '34종', '품질성능평가시험', 'BMT'])} >= 2)
  AND ({ov.any_of('cs', ['조달청종합쇼핑몰미등록', '종합쇼핑몰등록제품이아닌'])} OR {ov.all_of('cs', ['종합쇼핑몰', '미등록'])} OR {ov.all_of('cs', ['종합쇼핑몰', '등록제품', '아닐'])})""")
def bmt_targets(spark, sf):
    return jd.bmt_targets(inp.pages(spark, sf))


FULL = f"({ov.all_of('c', ['20', '미만', '대기업', '중견기업', '입찰'])} AND (contains(c, '참여할수없음') OR {ov.all_of('c', ['참여', '없음'])}))"


@query("item_3", f"""
WITH {BASE}, {ce.AMOUNTS}, full_row AS (SELECT document_id, page_no, display_no, {ov.window('t', '20', 420)} AS text FROM shown WHERE body AND {FULL}), {take('full_hit', 'full_row', 1)},
part_row AS (SELECT document_id, page_no, display_no, {ov.window('t', '중소', 260)} AS text, {ov.count_of('c', sg.SMALL_SW_TERMS)} AS score FROM shown WHERE body AND {ov.any_of('c', sg.SMALL_SW_TERMS)}),
{take('part', 'part_row', 3, 'score DESC, display_no, page_no')}, {keyword_cte('3')},
ok AS (SELECT f.*, amount_won, amount_page FROM full_hit f LEFT JOIN amount USING (document_id)),
short AS (SELECT a.document_id, amount_won, amount_page, pages, texts FROM amount a LEFT JOIN part USING (document_id) WHERE document_id NOT IN (SELECT document_id FROM full_hit))
SELECT {row('3', pack.COMPLIANT, 'true', 0.88, 'pages', 'texts', f"coalesce('p.' || amount_page || '에 근거하여 총 사업금액 ' || {AMOUNT_TEXT} || '임이 확인되었고, 해당 금액 구간에 필요한 중소 SW사업자 참여 제한 문구가 확인되었습니다.', {ov.quote(jd.R_RULE_OK)})", '', 'python_rule')} FROM ok
UNION ALL SELECT {row('3', pack.SUPPLEMENT, 'true', 0.8, 'pages', 'texts', f"('p.' || amount_page || ' 총 사업금액 ' || {AMOUNT_TEXT} || ' 기준으로 {jd.R_SMALL_TAIL}')", f"('{jd.C_SMALL}' || CASE WHEN amount_won < 2000000000 THEN {ov.quote(jd.SENTENCE_2B)} WHEN amount_won < 4000000000 THEN {ov.quote(jd.SENTENCE_4B)} ELSE {ov.quote(jd.SENTENCE_OTHER)} END)", 'python_rule_small_sw_missing_required_sentence')} FROM short
UNION ALL {keyword_branches('3', ['full_hit', 'amount'])}""")
def item_3(spark, sf):
    page, signals, documents = corpus(spark, sf, "3")
    return shown(jd.item_3(signals, documents, ev.project_amount(page)))


DENY = f"(contains(c, '하도급') AND {ov.any_of('c', ['불허', '허용하지'])} AND (regexp_matches(c, '{sg.DENIED[0]}') OR regexp_matches(c, '{sg.DENIED[1]}')))"


@query("item_4_disallowed", f"""
WITH {BASE}, deny_row AS (SELECT document_id, page_no, display_no, {ov.window('t', '하도급', 160)} AS text FROM shown WHERE body AND {DENY}), {take('deny', 'deny_row', 1)}
SELECT {row('4', pack.COMPLIANT, 'true', 0.88, 'pages', 'texts', jd.R_DENIED, '', 'python_rule_subcontract_disallowed')} FROM deny""")
def item_4_disallowed(spark, sf):
    _, signals, _ = corpus(spark, sf, "4")
    return shown(jd.item_4_disallowed(signals))


CHECKS = [
    ce.has("하도급", "사전승인"), ce.has("하도급", "50", "초과할수없"), ce.has("하도급", "원칙적으로불허"), ce.has("하도급", "계획서", "제출"),
    f"(contains(c, '하도급계획적정성확인서') OR {ce.has('하도급', '적정성', '평가항목')} OR {ce.has('하도급계약', '적정성', '세부기준')})", ce.has("하도급", "적정성", "판단"),
]
LINES_4 = " || chr(10) || ".join(
    f"coalesce('☑ ' || {ov.quote(label)} || ' 명시 (p.' || max(display_no) FILTER (bit = {i}) || ')', '☐ ' || {ov.quote(label)} || ' 미명시')" for i, (_, label) in enumerate(sg.CHECKLIST)
)
ABSENT_4 = "concat_ws(', ', " + ", ".join(f"CASE WHEN count(*) FILTER (bit = {i}) = 0 THEN {ov.quote(label)} END" for i, (_, label) in enumerate(sg.CHECKLIST)) + ")"


@query("item_4_checklist", f"""
WITH {BASE}, check_row AS ({' UNION ALL '.join(f"SELECT document_id, page_no, display_no, {ov.window('t', '하도급', 260)} AS text, {i} AS bit FROM shown WHERE {ce.ALLOWED} AND {cond}" for i, cond in enumerate(CHECKS))}),
met AS (SELECT * FROM check_row QUALIFY row_number() OVER (PARTITION BY document_id, bit ORDER BY page_no) = 1),
told AS (SELECT document_id, array_to_string(list_sort(list(DISTINCT display_no)), ',') AS pages, string_agg(text, '|' ORDER BY page_no, bit) AS texts, {LINES_4} AS lines, {ABSENT_4} AS absent FROM met GROUP BY 1)
SELECT {row('4', "CASE WHEN absent = '' THEN '준수' ELSE '보완필요' END", 'true', "CASE WHEN absent = '' THEN 0.88 ELSE 0.76 END", 'pages', 'texts', '(lines)', f"CASE WHEN absent = '' THEN '' ELSE {ov.quote(jd.C_CHECKLIST)} || absent END", 'python_rule_subcontract_checklist')} FROM told""")
def item_4_checklist(spark, sf):
    _, signals, _ = corpus(spark, sf, "4")
    return shown(jd.item_4_checklist(signals))


@query("item_4_partial", f"""
WITH {BASE}, part_row AS (SELECT document_id, page_no, display_no, {ov.window('t', '하도급', 260)} AS text, bit_count(({ce.mask_sql(ce.SUBCONTRACT_SQL)})::INT) AS score FROM shown WHERE {ce.ALLOWED}),
some_row AS (SELECT * FROM part_row WHERE score > 0), {take('part', 'some_row', 3, 'score DESC, display_no, page_no')}
SELECT {row('4', pack.NON_COMPLIANT, 'true', 0.82, 'pages', 'texts', jd.R_RULE_MISSING, jd.C_RULE_MISSING, 'python_rule')} FROM doc LEFT JOIN part USING (document_id)""")
def item_4_partial(spark, sf):
    _, signals, documents = corpus(spark, sf, "4")
    return shown(jd.item_4_partial(signals, documents))


def preferred(*names):
    """SQL of the first of several queries that has a row for a document."""
    parts = []
    for i, name in enumerate(names):
        skip = "".join(f" AND document_id NOT IN (SELECT document_id FROM branch{k})" for k in range(i))
        parts.append(f"SELECT {COLUMNS} FROM branch{i} WHERE true{skip}")
    return f"WITH {', '.join(f'branch{i} AS MATERIALIZED ({ORACLES[n]})' for i, n in enumerate(names))} " + " UNION ALL ".join(parts)


@query("item_4", preferred("item_4_disallowed", "item_4_checklist", "item_4_partial"))
def item_4(spark, sf):
    _, signals, documents = corpus(spark, sf, "4")
    return shown(jd.item_4(signals, documents))


SECTION = f"(contains(c, 'SW사업산출물활용보장') OR {ov.all_of('c', ['산출물활용', '지식재산권'])} OR (mask & 3 = 3 AND {ov.any_of('c', ['계약목적물', '계약산출물', '계약상대자', '공급자'])}))"
REUSE_QUOTE = "CASE " + " ".join(f"WHEN (mask & {1 << i}) <> 0 AND contains(low, '{w.lower()}') THEN {ov.window('t', w, 420)}" for i, w in enumerate(rq.REUSE_QUOTES)) + f" ELSE substr({ov.collapse('t')}, 1, 180) END"
REUSE = f"""masked AS (SELECT *, ({ce.mask_sql(ce.REUSE_SQL)})::INT AS mask FROM shown WHERE body),
reused AS MATERIALIZED (SELECT *, {SECTION} AS section, bit_count(mask) * 10 + CASE WHEN contains(c, 'SW사업산출물활용보장') THEN 20 ELSE 0 END + CASE WHEN contains(c, '산출물활용') THEN 8 ELSE 0 END
    + CASE WHEN {ov.any_of('c', ['계약목적물', '계약산출물'])} THEN 6 ELSE 0 END + CASE WHEN contains(c, '제재요건') THEN 4 ELSE 0 END AS score, {REUSE_QUOTE} AS text FROM masked WHERE mask <> 0),
ordered AS (SELECT *, bit_count(mask) >= 4 AND section AS dense, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN bit_count(mask) >= 4 AND section THEN 0 ELSE 1 END, score DESC, page_no) AS k FROM reused),
single AS (SELECT document_id, page_no FROM ordered WHERE dense AND mask = 127 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY score DESC, page_no) = 1),
cand AS (SELECT document_id, page_no, mask, k FROM ordered WHERE document_id NOT IN (SELECT document_id FROM single)),
walk AS (SELECT document_id, 0::BIGINT AS k, 0 AS covered, []::INT[] AS kept FROM (SELECT DISTINCT document_id FROM cand)
  UNION ALL SELECT w.document_id, c.k, CASE WHEN w.covered <> 127 AND (c.mask & ~w.covered) <> 0 THEN w.covered | c.mask ELSE w.covered END,
    CASE WHEN w.covered <> 127 AND (c.mask & ~w.covered) <> 0 THEN list_append(w.kept, c.page_no) ELSE w.kept END FROM walk w JOIN cand c ON c.document_id = w.document_id AND c.k = w.k + 1),
kept AS (SELECT document_id, unnest(kept) AS page_no FROM (SELECT * FROM walk WHERE covered = 127 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY k) = 1) UNION ALL SELECT * FROM single),
ok_row AS (SELECT r.* FROM kept JOIN reused r ON r.document_id = kept.document_id AND r.page_no = kept.page_no), {take('ok', 'ok_row', 100)},
part_row AS (SELECT * FROM reused WHERE bit_count(mask) >= 3 AND section), {take('part', 'part_row', 1, 'score DESC, page_no')}"""


@query("dense_page_first", f"""
WITH RECURSIVE {BASE}, {REUSE} SELECT document_id, display_no, md5(text) AS text_md5 FROM ok_row""")
def dense_page_first(spark, sf):
    _, signals, _ = corpus(spark, sf, "6")
    return jd.dense_page_first(signals).select("document_id", "display_no", F.md5("text").alias("text_md5"))


@query("item_6", f"""
WITH RECURSIVE {BASE}, {REUSE}
SELECT {row('6', pack.COMPLIANT, 'true', 0.88, 'pages', 'texts', jd.R_RULE_OK, '', 'python_rule')} FROM ok
UNION ALL SELECT {row('6', pack.NON_COMPLIANT, 'true', 0.82, 'pages', 'texts', jd.R_RULE_MISSING, jd.C_RULE_MISSING, 'python_rule')} FROM doc LEFT JOIN part USING (document_id) WHERE document_id NOT IN (SELECT document_id FROM ok)""")
def item_6(spark, sf):
    _, signals, documents = corpus(spark, sf, "6")
    return shown(jd.item_6(signals, documents))


def fallback_cte(item, words, candidate):
    return f"""marked AS (SELECT DISTINCT document_id FROM shown WHERE {candidate}),
own AS (SELECT * FROM shown WHERE document_id NOT IN (SELECT document_id FROM marked) OR {candidate}),
weak_row AS (SELECT document_id, page_no, display_no, {ov.first_window('t', 'low', words, 80)} AS text FROM own WHERE body AND {ov.any_of('low', [tx.squeeze(w).lower() for w in words])}), {take('weak', 'weak_row', 5)},
first_row AS (SELECT document_id, page_no, display_no, substr(t, 1, 180) AS text FROM own), {take('firsts', 'first_row', 3)}"""


def table_branches(item, without):
    skip = " AND ".join(f"document_id NOT IN (SELECT document_id FROM {w})" for w in without) or "true"
    return (
        f"SELECT {row(item, pack.SUPPLEMENT, 'true', 0.7, 'pages', 'texts', jd.R_TABLE_WEAK, jd.C_TABLE_WEAK, 'python_table')} FROM weak WHERE {skip}\n"
        f"UNION ALL SELECT {row(item, pack.NEEDS_CHECK, 'NULL', 0.36, 'pages', 'texts', jd.R_TABLE_NONE, jd.C_TABLE_NONE, 'python_table')} FROM doc LEFT JOIN firsts USING (document_id) WHERE {skip} AND document_id NOT IN (SELECT document_id FROM weak)"
    )


SCORE_11 = f"CASE WHEN contains(low, '기술능력평가점수') THEN {ov.window('t', '기술능력평가점수', 120)} WHEN contains(low, '기술능력평가') THEN {ov.window('t', '기술능력평가', 120)} ELSE substr(t, 1, 220) END"


@query("item_11", f"""
WITH {BASE}, score_row AS (SELECT document_id, page_no, display_no, {SCORE_11} AS text FROM shown WHERE {ov.all_of('low', ['기술능력평가', '가격평가'])} AND regexp_matches(t, '90{ov.WS}*(?:점|%)') AND regexp_matches(t, '10{ov.WS}*(?:점|%)')), {take('score', 'score_row', 3)},
{fallback_cte('11', pack.TABLE_KEYWORDS['11'], '(has_eval_table OR has_table)')}
SELECT {row('11', pack.COMPLIANT, 'true', 0.9, 'pages', 'texts', jd.R_SCORE_90, '', 'python_table_score_90')} FROM score
UNION ALL {table_branches('11', ['score'])}""")
def item_11(spark, sf):
    _, signals, documents = corpus(spark, sf, "11")
    return shown(jd.item_11(signals, documents))


@query("item_table_fallback", f"WITH {BASE}, {fallback_cte('12', pack.TABLE_KEYWORDS['12'], '(has_eval_table OR has_table)')} {table_branches('12', [])}")
def item_table_fallback(spark, sf):
    _, signals, documents = corpus(spark, sf, "12")
    return shown(jd.item_table_fallback(signals, documents, "12"))


@query("item_12")
def item_12(spark, sf):
    page, signals, documents = corpus(spark, sf, "12")
    return shown(jd.item_12(signals, documents, page))


DETAIL_4 = f"{ov.count_of('low', [tx.squeeze(w).lower() for w in ev.DETAIL_TERMS])} >= 4"


@query("item_14", f"""
WITH {BASE}, detail_row AS (SELECT document_id, page_no, display_no, {ov.window('t', '요구사항 고유번호', 80)} AS text FROM shown WHERE body AND {DETAIL_4}), {take('detail', 'detail_row', 5)},
summary_row AS (SELECT document_id, page_no, display_no, {ov.window('t', '요구사항 총괄표', 80)} AS text FROM shown WHERE body AND NOT ({DETAIL_4}) AND contains(t, '요구사항 총괄표') AND {ov.count_of('low', [tx.squeeze(w) for w in sg.SUMMARY_TERMS])} >= 4), {take('summary', 'summary_row', 5)},
{keyword_cte('14')}
SELECT {row('14', pack.COMPLIANT, 'true', 0.88, 'pages', 'texts', jd.R_DETAIL, '', 'python_rule_requirement_structure')} FROM detail
UNION ALL SELECT {row('14', pack.COMPLIANT, 'true', 0.88, 'pages', 'texts', jd.R_DETAIL, '', 'python_rule_requirement_structure')} FROM summary WHERE document_id NOT IN (SELECT document_id FROM detail)
UNION ALL {keyword_branches('14', ['detail', 'summary'])}""")
def item_14(spark, sf):
    _, signals, documents = corpus(spark, sf, "14")
    return shown(jd.item_14(signals, documents))


@query("item_16", f"""
WITH {BASE}, trigger_row AS (SELECT document_id, page_no, display_no, {ov.window('t', '인력', 220)} AS text FROM shown WHERE body AND {ov.any_of('c', sorted({tx.squeeze(w) for w in sg.WORKFORCE_TRIGGERS}))}), {take('found', 'trigger_row', 5)},
fp AS (SELECT DISTINCT document_id FROM shown WHERE body AND {ov.any_of('c', sg.FUNCTION_SIGNALS)})
SELECT {row('16', pack.SUPPLEMENT, 'true', 0.78, 'pages', 'texts', f"(CASE WHEN document_id IN (SELECT document_id FROM fp) THEN {ov.quote(jd.R_WORKFORCE_FP)} ELSE '' END || {ov.quote(jd.R_WORKFORCE)})", f"('제안요청서(' || replace(pages, ',', '쪽, ') || '쪽)' || {ov.quote(jd.C_WORKFORCE)})", 'python_llm_item_16_workforce_trigger')} FROM found
UNION ALL SELECT {row('16', pack.SUPPLEMENT, 'NULL', 0.4, 'NULL', 'NULL', jd.R_UNDECIDED, jd.C_UNDECIDED, 'llm_disabled')} FROM doc WHERE document_id NOT IN (SELECT document_id FROM found)""")
def item_16(spark, sf):
    _, signals, documents = corpus(spark, sf, "16")
    return shown(jd.item_16(signals, documents))


@query("item_18", f"""
WITH {BASE}, mention AS (SELECT document_id, page_no, display_no, {ov.window('t', 'SW사업정보', 260)} AS text, {ov.any_of('c', ['제출', '작성및제출', '데이터작성'])} AS s, {ov.any_of('c', ['www.spir.kr', 'SPIR', 'SW사업정보저장소', '제출방법'])} AS m
  FROM shown WHERE body AND {ov.any_of('c', ['SW사업정보', '소프트웨어사업정보'])}), {take('found', 'mention', 3)},
state AS (SELECT f.*, s, m FROM found f JOIN (SELECT document_id, bool_or(s) AS s, bool_or(m) AS m FROM mention GROUP BY 1) USING (document_id)), {keyword_cte('18')}
SELECT {row('18', pack.COMPLIANT, 'true', 0.88, 'pages', 'texts', jd.R_RULE_OK, '', 'python_rule')} FROM state WHERE s AND m
UNION ALL SELECT {row('18', pack.SUPPLEMENT, 'true', 0.78, 'pages', 'texts', jd.R_SW_INFO, "('검토의견서 작성예시를 참고하여 ' || concat_ws(', ', CASE WHEN NOT s THEN 'SW사업정보 제출 여부 명시' END, CASE WHEN NOT m THEN 'SW사업정보 제출 방법 안내' END) || '를 보완하시기 바랍니다.')", 'python_rule_sw_business_info_example_gap')} FROM state WHERE NOT (s AND m)
UNION ALL {keyword_branches('18', ['state'])}""")
def item_18(spark, sf):
    _, signals, documents = corpus(spark, sf, "18")
    return shown(jd.item_18(signals, documents))


@query("item_15")
def item_15(spark, sf):
    page = ce.broken_pages(spark, sf)
    return shown(jd.item_15(cut_lineage(sg.page_signals(page, ["15"])), inp.documents(spark, sf)))


@query("item_17")
def item_17(spark, sf):
    page = ce.broken_pages(spark, sf)
    return shown(jd.item_17(cut_lineage(sg.page_signals(page, ["17"])), inp.documents(spark, sf)))


def form_fallback(item, base, docs="doc"):
    """SQL of item_attachment_fallback() without criteria overlaps, for the documents of a relation."""
    hints = pack.ATTACHMENT_TITLE_HINTS[item]
    hint = "CASE " + " ".join(f"WHEN contains({ov.compact('t')}, '{tx.squeeze(h)}') THEN {ov.quote(h)}" for h in hints) + " END"
    return f"""{base}, {fallback_cte(item, pack.ATTACHMENT_KEYWORDS[item], '(has_attachment OR has_blind OR has_commercial_sw)')},
titled AS (SELECT *, {hint} AS hint FROM own WHERE body AND {ov.any_of('c', [tx.squeeze(h) for h in hints])}), bodied AS (SELECT *, {ce.body_sql('t', 'hint')} AS bodytext FROM titled),
judged AS (SELECT *, {ce.has_body_sql('bodytext', 't')} AS has_body, substr(t, 1, 260) AS text FROM bodied),
empty_row AS (SELECT * FROM judged j WHERE NOT EXISTS (SELECT 1 FROM judged k WHERE k.document_id = j.document_id AND k.has_body)), {take('hollow', 'empty_row', 3)}""", f"""
SELECT {row(item, pack.NON_COMPLIANT, 'true', 0.78, 'pages', 'texts', jd.R_TITLE_ONLY, jd.C_TITLE_ONLY, 'python_attachment_title_only')} FROM hollow WHERE document_id IN (SELECT document_id FROM {docs})
UNION ALL SELECT {row(item, pack.SUPPLEMENT, 'true', 0.68, 'pages', 'texts', jd.R_FORM_WEAK, jd.C_FORM_WEAK, 'python_attachment')} FROM weak WHERE document_id IN (SELECT document_id FROM {docs}) AND document_id NOT IN (SELECT document_id FROM hollow)
UNION ALL SELECT {row(item, pack.NEEDS_CHECK, 'NULL', 0.34, 'pages', 'texts', jd.R_FORM_NONE, jd.C_FORM_NONE, 'python_attachment')} FROM {docs} LEFT JOIN firsts USING (document_id)
  WHERE document_id NOT IN (SELECT document_id FROM hollow) AND document_id NOT IN (SELECT document_id FROM weak)"""


@query("item_2_1", f"""
WITH target AS MATERIALIZED ({ORACLES['bmt_targets']}), {form_fallback('2-1', BASE, 'target')[0]}
SELECT {row('2-1', pack.NOT_APPLICABLE, 'false', 0.78, 'NULL', 'NULL', jd.R_BMT_NO, '', 'python_attachment_bmt_not_target')} FROM doc WHERE document_id NOT IN (SELECT document_id FROM target)
UNION ALL {form_fallback('2-1', BASE, 'target')[1]}""")
def item_2_1(spark, sf):
    page, signals, documents = corpus(spark, sf, "2-1")
    return shown(jd.item_2_1(signals, documents, page))


BROKEN_BASE = BASE.replace("page_text AS t, page_text", f"{ce.BROKEN} AS t, {ce.BROKEN} AS page_text")


@query("item_attachment_fallback", "WITH {} {}".format(*form_fallback("17", BROKEN_BASE)))
def item_attachment_fallback(spark, sf):
    page = ce.broken_pages(spark, sf)
    return shown(jd.item_attachment_fallback(cut_lineage(sg.page_signals(page, ["17"])), inp.documents(spark, sf), "17"))


@query("undecided_item", f"""
WITH judged AS (SELECT doc_id FROM labels WHERE quality = 1)
SELECT {row('8', pack.SUPPLEMENT, 'NULL', 0.4, 'NULL', 'NULL', jd.R_UNDECIDED, jd.C_UNDECIDED, 'llm_disabled')} FROM (SELECT doc_id AS document_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM judged))""")
def undecided_item(spark, sf):
    judged = inp.read(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("document_id"), F.lit("8").alias("item_no"))
    return shown(jd.undecided_item(inp.documents(spark, sf), "8", judged))
