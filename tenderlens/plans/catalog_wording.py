"""Registered queries: assessment, wording, report, feedback and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlens.functions import labels as lb
from tenderlens.functions import text as tx
from tenderlens.operators import feedback as fb
from tenderlens.operators import retrieval as rt
from tenderlens.operators import wording as wd
from tenderlens.plans import catalog_evidence as ce
from tenderlens.plans import catalog_retrieval as cr
from tenderlens.plans import inputs as inp
from tenderlens.plans import oracle_views as ov
from tenderlens.plans.registry import query
from tenderlens.rules import pack, rubric
from tenderlens.session import cut_lineage

K3 = ["document_id", "item_no", "page_no"]


def _list2(groups):
    return "[" + ", ".join(ov.sql_list([x.lower() for x in g]) for g in groups) + "]"


RUBRIC = "rubric AS (SELECT * FROM (VALUES " + ", ".join(
    f"({ov.quote(i)}, {ov.quote(n)}, {ov.quote(t)}, {ov.quote(c)}, {_list2(r)}, {ov.sql_list([' '.join(g) for g in r])}, {f}, {ov.quote(a)})" for i, n, t, c, r, f, a in rubric.ROWS
) + ") AS v(item_no, row_no, title, content, terms, labels, full_match, missing_action))"
ASSESSED = f"""{RUBRIC}, low AS (SELECT document_id, item_no, page_no, evidence_pages, evidence_text, list_transform(evidence_text, lambda t: lower({ov.compact('t')})) AS lows FROM final),
at_ AS (SELECT l.*, row_no, title, content, labels, full_match, missing_action, list_transform(terms, lambda g: coalesce(list_position(list_transform(lows, lambda t: list_bool_and(list_transform(g, lambda x: contains(t, x)))), true), 0)) AS ats FROM low l JOIN rubric USING (item_no)),
assessed AS MATERIALIZED (SELECT *, list_filter(list_transform(range(1, len(labels) + 1), lambda i: CASE WHEN ats[i] > 0 THEN labels[i] END), lambda x: x IS NOT NULL) AS matched FROM at_),
assess AS MATERIALIZED (SELECT *, CASE WHEN len(matched) >= full_match THEN '명시' WHEN len(matched) > 0 THEN '일부명시' ELSE '미명시' END AS explicit_status FROM assessed)"""


@query("assess_rows", f"""
WITH {ov.FINALS}, {ASSESSED} SELECT document_id, item_no, page_no, row_no, explicit_status, array_to_string(matched, ', ') AS matched FROM assess""")
def assess_rows(spark, sf):
    rows = wd.assess_rows(inp.finals(spark, sf), K3)
    return rows.select(*K3, "row_no", "explicit_status", F.array_join("matched_requirements", ", ").alias("matched"))


RESULT = f"""result AS (SELECT document_id, item_no, page_no, CASE WHEN bool_and(explicit_status = '명시') THEN '준수' WHEN bool_or(explicit_status <> '미명시') THEN '보완필요' ELSE '미준수' END AS final_result,
  string_agg(row_no || '. ' || title || '(' || explicit_status || ')', ', ' ORDER BY row_no) FILTER (explicit_status <> '명시') AS lack, string_agg(missing_action, chr(10) ORDER BY row_no) FILTER (explicit_status <> '명시') AS act FROM assess GROUP BY ALL)"""


@query("assessment_result", f"""
WITH {ov.FINALS}, {ASSESSED}, {RESULT}
SELECT document_id, item_no, page_no, final_result, CASE WHEN final_result = '준수' THEN '{rubric.R_ALL}' ELSE '{rubric.R_MISSING}' || lack END AS assessment_reason, coalesce(act, '') AS assessment_recommendation FROM result""")
def assessment_result(spark, sf):
    return wd.assessment_result(wd.assess_rows(inp.finals(spark, sf), K3), K3).drop("assessment_rows")


RUNS = """run AS (SELECT document_id, item_no, page_no, min(p) AS a, max(p) AS b FROM (SELECT document_id, item_no, page_no, p, p - row_number() OVER (PARTITION BY document_id, item_no, page_no ORDER BY p) AS g
    FROM (SELECT DISTINCT document_id, item_no, page_no, unnest({src}) AS p FROM {table})) GROUP BY document_id, item_no, page_no, g),
{name} AS (SELECT document_id, item_no, page_no, string_agg(CASE WHEN a = b THEN 'p.' || a ELSE 'pp.' || a || '-' || b END, ', ' ORDER BY a) AS plain,
    CASE WHEN count(*) = 1 AND min(a) = max(b) THEN 'p.' || min(a) ELSE 'pp.' || array_to_string(list(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END ORDER BY a)[1:5], ', ') END AS report FROM run GROUP BY ALL)"""


@query("assessment_text", f"""
WITH {ov.FINALS}, {ASSESSED}, {RESULT}, {RUNS.format(src='evidence_pages', table='final', name='shown')},
lines AS (SELECT document_id, item_no, page_no, string_agg(row_no || chr(9) || title || chr(10) || content || chr(9) || explicit_status, chr(10) ORDER BY row_no) AS body FROM assess GROUP BY ALL)
SELECT r.document_id, r.item_no, r.page_no, final_result, CASE WHEN final_result = '준수' THEN coalesce('제안요청서 ' || plain || ' 명시', '관련 문구 명시') ELSE act END AS compliance_text,
  r.item_no || '. ' || CASE r.item_no WHEN '4' THEN '{rubric.TITLES['4']}' WHEN '5' THEN '{rubric.TITLES['5']}' ELSE '{rubric.TITLES['6']}' END || chr(10) || chr(10) || '구분' || chr(9) || '내용' || chr(9) || '명시 여부' || chr(10) || body || chr(10) || chr(10) || '최종 판단' || chr(9) || final_result
    || chr(10) || '판단 근거' || chr(9) || CASE WHEN final_result = '준수' THEN '{rubric.R_ALL}' ELSE '{rubric.R_MISSING}' || lack END AS copy_text
FROM result r JOIN lines USING (document_id, item_no, page_no) LEFT JOIN shown USING (document_id, item_no, page_no)""")
def assessment_text(spark, sf):
    return wd.assessment_text(inp.finals(spark, sf), K3).select(*K3, "final_result", "compliance_text", "copy_text")


@query("format_pages", f"""
WITH final AS (SELECT l_orderkey AS document_id, 'x' AS item_no, 0 AS page_no, list(l_linenumber + l_suppkey % 3) AS evidence_pages FROM lineitem GROUP BY 1), {RUNS.format(src='evidence_pages', table='final', name='shown')}
SELECT document_id, plain, report FROM shown""")
def format_pages(spark, sf):
    li = inp.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.collect_list((F.col("l_linenumber") + F.col("l_suppkey") % 3).cast("int")).alias("p"))
    return li.select("document_id", lb.format_pages(F.col("p")).alias("plain"), lb.format_pages_report(F.col("p")).alias("report"))


RAW = ["준수", " 미준수 ", "보완 권고", "해당 없음", "확인 필요", "비대상", "以준", "蹂댁", "근거부족", "적합", "non-compliant", "n/a", ""]
REPORT_LABEL = "CASE WHEN item_no = '16' THEN CASE WHEN is_target IS NULL THEN '대상여부 확인필요' WHEN is_target THEN '대상' ELSE '비대상' END WHEN trim({r}) IN ('준수', '미준수', '보완필요') THEN trim({r}) WHEN trim({r}) IN ('비대상', '해당없음') OR is_target = false THEN '해당없음' WHEN {s} = '자동 확정 가능' AND trim({r}) <> '' THEN trim({r}) ELSE '보완필요' END"
WORDING_LABEL = "CASE WHEN is_target = false THEN '해당없음' WHEN trim({r}) IN ('준수', '미준수', '보완필요', '해당없음') THEN trim({r}) WHEN regexp_matches(trim({r}), '^(以|餓)') THEN '준수' WHEN regexp_matches(trim({r}), '^(誘|미)') THEN '미준수' WHEN regexp_matches(trim({r}), '^(蹂|보완)') THEN '보완필요' WHEN regexp_matches(trim({r}), '^(\\?대떦|해당|鍮)') THEN '해당없음' ELSE trim({r}) END"
SERVICE_LABEL = "CASE WHEN contains({r}, '미준수') THEN '미준수' WHEN contains({r}, '보완') THEN '보완필요' WHEN contains({r}, '확인요망') OR contains({r}, '확인 필요') THEN '확인요망' WHEN contains({r}, '해당없음') OR contains({r}, '해당 없음') THEN '해당없음' WHEN contains({r}, '준수') THEN '준수' ELSE trim({r}) END"


@query("result_label", f"""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, {ov.sql_list(RAW)}[l_partkey % 13 + 1] AS r, (l_linenumber + 12)::VARCHAR AS item_no, CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_target, CASE WHEN l_tax > 0.04 THEN '자동 확정 가능' ELSE '사람 확인 필요' END AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {WORDING_LABEL.format(r='r')} AS wording, {REPORT_LABEL.format(r='r', s='s')} AS report, {SERVICE_LABEL.format(r='r')} AS service,
  CASE WHEN trim(r) IN ('준수', '미준수', '보완필요', '해당없음') THEN trim(r) ELSE CASE trim(r) WHEN '적합' THEN '준수' WHEN '충족' THEN '준수' WHEN '비대상' THEN '해당없음' WHEN '해당 없음' THEN '해당없음' WHEN '불충족' THEN '미준수' ELSE '보완필요' END END AS judgement,
  CASE trim(r) WHEN '비대상' THEN '해당없음' WHEN '근거부족' THEN '확인필요' ELSE trim(r) END AS accuracy,
  CASE WHEN trim(r) = '' THEN 'unknown' WHEN is_target = false THEN 'na' WHEN regexp_matches(r, '(?i)미준수|위반|non[-_ ]?compliant|noncompliant') THEN 'noncompliant' WHEN regexp_matches(r, '(?i)보완|수정|revision') THEN 'revision'
    WHEN regexp_matches(r, '(?i)해당\\s*없음|not[-_ ]?applicable|n/?a') THEN 'na' WHEN regexp_matches(r, '(?i)준수|적합|compliant|pass') THEN 'compliant' ELSE 'unknown' END AS screen FROM v""")
def result_label(spark, sf):
    li = inp.read(spark, sf, "lineitem")
    r = F.element_at(F.array(*[F.lit(x) for x in RAW]), (F.col("l_partkey") % 13 + 1).cast("int"))
    v = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", r.alias("r"), (F.col("l_linenumber") + 12).cast("string").alias("item_no"),
        F.when(F.col("l_suppkey") % 3 == 0, True).when(F.col("l_suppkey") % 3 == 1, False).alias("t"), F.when(F.col("l_tax") > 0.04, pack.STATUS_AUTO).otherwise(pack.STATUS_HUMAN).alias("s"),
    )
    r, t = F.col("r"), F.col("t")
    return v.select(
        "l_orderkey", "l_linenumber", "l_partkey", lb.wording_label(r, t).alias("wording"), lb.report_label(F.col("item_no"), r, t, F.col("s")).alias("report"), lb.service_label(r).alias("service"),
        lb.judgement_label(r).alias("judgement"), lb.accuracy_label(r).alias("accuracy"), lb.screen_status(r, t).alias("screen"),
    )


DIRECT = f"""pair AS (SELECT document_id, item_no, page_no, unnest(range(0, len(evidence_pages))) AS pos, unnest(evidence_pages) AS p, unnest(evidence_text) AS txt FROM final),
judged AS (SELECT *, lower({ov.compact('txt')}) AS low FROM pair),
direct AS MATERIALIZED (SELECT * FROM judged WHERE NOT {ce.CONTEXT_ONLY}),
direct_list AS (SELECT document_id, item_no, page_no, list_sort(list(DISTINCT p)) AS dp, string_agg(txt, ' ' ORDER BY pos) FILTER (txt <> '') AS dt FROM direct GROUP BY ALL)"""


@query("direct_pages", f"""
WITH {ov.FINALS}, {DIRECT} SELECT document_id, item_no, page_no, coalesce(array_to_string(dp, ','), '') AS pages FROM final LEFT JOIN direct_list USING (document_id, item_no, page_no)""")
def direct_pages(spark, sf):
    return inp.finals(spark, sf).select(*K3, tx.join_ints(wd.direct_pages(wd.direct_pairs())).alias("pages"))


S = ov.WS
ARROW = f"CASE WHEN contains({{c}}, '->') THEN {ov.strip('substr({c}, instr({c}, chr(45) || chr(62)) + 2)')} ELSE {ov.strip('{c}')} END"
PAGE_REF = f"^{S}*제안요청서{S}+(?:p{{1,2}}\\.{S}*[0-9]+(?:{S}*[-~]{S}*[0-9]+)?(?:{S}*,{S}*)?)+(?:에|에는|의|에서)?{S}*"


def strip_refs(c):
    t = ARROW.replace("{c}", c)
    t = ov.strip(f"regexp_replace({t}, '{PAGE_REF}', '')")
    t = ov.strip(f"regexp_replace({t}, '^{S}*제안요청서에{S}*', '제안요청서에 ')")
    t = ov.strip(f"regexp_replace({t}, '^{S}*제안요청서{S}+등에{S}*', '제안요청서에 ')")
    return f"regexp_replace({t}, '([‘''\"]){S}*제안요청서{S}+등에{S}*', '\\1', 'g')"


ADVICE = f"""spoken AS (SELECT *, {ov.strip("coalesce(nullif(recommendation, ''), reason)")} AS base FROM final),
generic AS (SELECT *, lower({ov.compact('base')}) AS blow FROM spoken),
concrete AS MATERIALIZED (SELECT *, CASE WHEN item_no = '17' AND contains(blow, '영향평가') AND contains(blow, '결과서') THEN '{wd.IMPACT_ACTION}' ELSE {strip_refs('base')} END AS own,
    base <> '' AND {ov.count_of('blow', wd.GENERIC)} < 2 AS specific FROM generic)"""


@query("clean_recommendation", f"""
WITH {ov.FINALS}, {ADVICE}, acted AS (SELECT *, {ov.strip(f"regexp_replace(own, '(?s){S}*(?:예를{S}*들어|예시(?:로|:)?|예컨대).*', '')")} AS a FROM concrete)
SELECT document_id, item_no, page_no, own AS cleaned, NOT specific AND base <> '' AS is_generic, CASE WHEN {ov.any_of(f"lower({ov.compact('a')})", ['소프트웨어사업영향평가', 'sw사업영향평가'])} AND contains(lower({ov.compact('a')}), '결과서') THEN '{wd.IMPACT_ACTION}' ELSE a END AS action FROM acted""")
def clean_recommendation(spark, sf):
    f = inp.finals(spark, sf)
    base = tx.strip(F.coalesce(F.nullif("recommendation", F.lit("")), F.col("reason")))
    none = F.lit(None).cast("string")
    own = wd.concrete_recommendation(F.col("item_no"), F.col("recommendation"), F.col("reason"), none)
    return f.select(*K3, base.alias("b"), own.alias("cleaned")).select(*K3, "cleaned", ((F.col("b") != "") & wd.is_generic(F.col("b"))).alias("is_generic"), wd.partial_action(F.col("cleaned")).alias("action"))


CONTENT = f"""{DIRECT}, {RUNS.format(src='dp', table='direct_list', name='shown')}, {ADVICE},
ready AS (SELECT c.*, {WORDING_LABEL.format(r='final_result')} AS label, coalesce(plain, '') AS shown, dt, dp FROM concrete c LEFT JOIN direct_list USING (document_id, item_no, page_no) LEFT JOIN shown USING (document_id, item_no, page_no)),
acted AS (SELECT *, {ov.strip(f"regexp_replace({strip_refs('own')}, '(?s){S}*(?:예를{S}*들어|예시(?:로|:)?|예컨대).*', '')")} AS a0, lower({ov.compact("concat_ws(' ', reason, coalesce(dt, ''))")}) AS ctx FROM ready),
action AS (SELECT *, CASE WHEN {ov.any_of(f"lower({ov.compact('a0')})", ['소프트웨어사업영향평가', 'sw사업영향평가'])} AND contains(lower({ov.compact('a0')}), '결과서') THEN '{wd.IMPACT_ACTION}' ELSE a0 END AS a,
    NOT {ov.any_of('ctx', wd.EMPTY_SIGNS)} AND {ov.any_of('ctx', wd.PARTIAL_SIGNS)} AS partial FROM acted),
worded AS MATERIALIZED (SELECT *, CASE WHEN label = '해당없음' THEN '해당없음'
  WHEN item_no = '14' AND label = '준수' THEN CASE WHEN len(evidence_pages) > 0 THEN '제안요청서 p.' || list_min(evidence_pages) || ' 이하 명시' ELSE '' END
  WHEN item_no = '16' THEN CASE WHEN {ov.strip('recommendation')} <> '' AND label IN ('보완필요', '미준수') THEN CASE WHEN shown <> '' THEN '제안요청서 ' || shown || '에 투입인력 요구사항이 확인됩니다.' || chr(10) ELSE '' END || '-> ' || {ov.strip('recommendation')}
      WHEN is_target THEN CASE WHEN shown <> '' THEN '제안요청서 ' || shown || ' 기준 대상 사업으로 판단' ELSE '대상 사업으로 판단' END ELSE '대상여부 확인필요' END
  WHEN item_no = '9' AND label = '준수' THEN '특정규격 명시 없음'
  WHEN label = '준수' THEN CASE WHEN shown <> '' THEN '제안요청서 ' || shown || ' 명시' ELSE '' END
  WHEN label IN ('보완필요', '미준수') THEN CASE WHEN own = '' THEN '' WHEN shown = '' THEN CASE WHEN label = '미준수' THEN own ELSE '' END
      WHEN label = '보완필요' OR partial THEN '제안요청서 ' || shown || ' 일부 명시' || chr(10) || '→ ' || a
      ELSE '제안요청서 ' || shown || CASE WHEN regexp_matches({ov.strip(f"regexp_replace(a, '^{S}*제안요청서에{S}*', '')")}, '^(?:제안서|제안요청서|평가항목|배점표)') THEN '' ELSE '에' END || ' ' || {ov.strip(f"regexp_replace(a, '^{S}*제안요청서에{S}*', '')")} END
  ELSE '' END AS content FROM action)"""


@query("compliance_content", f"""
WITH {ov.FINALS}, {CONTENT}
SELECT document_id, item_no, page_no, content AS compliance_content,
  CASE WHEN label = '해당없음' OR item_no = '16' OR (item_no = '9' AND label = '준수') THEN '' WHEN label = '준수' THEN CASE WHEN content = '' THEN 'missing_evidence_pages' ELSE '' END
    WHEN label IN ('보완필요', '미준수') THEN CASE WHEN own = '' THEN 'missing_recommendation' WHEN shown = '' AND label = '보완필요' THEN 'missing_direct_evidence_pages' ELSE '' END ELSE 'unknown_result' END AS content_warnings FROM worded""")
def compliance_content(spark, sf):
    done = wd.compliance_content(inp.finals(spark, sf))
    return done.select(*K3, "compliance_content", F.array_join("content_warnings", ",").alias("content_warnings"))


@query("compliance_content_with_criteria")
def compliance_content_with_criteria(spark, sf):
    done = wd.compliance_content(inp.finals(spark, sf), cr.criteria_hits(spark, sf))
    return done.select(*K3, "compliance_content", F.array_join("content_warnings", ",").alias("content_warnings"), tx.join_ints(F.col("content_pages")).alias("content_pages"))


REPORT_PAIRS = f"""labelled AS (SELECT *, {REPORT_LABEL.format(r='final_result', s='final_status')} AS report_label FROM final),
rpair AS (SELECT document_id, item_no, page_no, report_label, unnest(range(0, len(evidence_pages))) AS pos, unnest(evidence_pages) AS p, unnest(evidence_text) AS txt FROM labelled),
rc AS (SELECT *, {ov.compact('txt')} AS c FROM rpair),
kept AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY document_id, item_no, page_no ORDER BY pos) AS k FROM rc WHERE report_label = '해당없음' OR item_no = '16' OR txt = '' OR NOT ({ov.any_of('c', pack.TARGET_MARKERS)} AND NOT {ov.any_of('c', pack.DIRECT_MARKERS)}))"""
NAMES = "CASE item_no " + " ".join(f"WHEN '{k}' THEN {ov.quote(v)}" for k, v in pack.ITEM_NAMES.items()) + " ELSE '검토항목' END"


@query("compliance_report", f"""
WITH {ov.FINALS}, {REPORT_PAIRS},
line AS (SELECT document_id, item_no, page_no, string_agg('p.' || p || ' ' || CASE WHEN length({ov.collapse('txt')}) <= 260 THEN {ov.collapse('txt')} ELSE rtrim(substr({ov.collapse('txt')}, 1, 257)) || '...' END, chr(10) ORDER BY k) FILTER ({ov.collapse('txt')} <> '') AS lines, string_agg('p.' || p, ', ' ORDER BY k) AS bare FROM kept WHERE k <= 5 GROUP BY ALL)
SELECT f.document_id, f.item_no, f.page_no, report_label, CASE WHEN f.item_no = '9' AND report_label = '준수' THEN {ov.quote(wd.BASIS_9)} ELSE coalesce(nullif(concat_ws(chr(10), CASE WHEN recommendation <> '' THEN '개선권고: ' || recommendation END, CASE WHEN reason <> '' THEN '판단근거: ' || reason END, 'RFP 트리거: ' || coalesce(lines, bare)), ''), '근거 확인 필요') END AS basis_text,
  CASE WHEN final_status = '{pack.STATUS_AUTO}' AND len(warnings) = 0 THEN '아니오' ELSE '예' END AS human_recheck, f.item_no || '. ' || {NAMES.replace('item_no', 'f.item_no')} AS item_label
FROM labelled f LEFT JOIN line l ON l.document_id = f.document_id AND l.item_no = f.item_no AND l.page_no = f.page_no""")
def compliance_report(spark, sf):
    return wd.compliance_report(inp.finals(spark, sf)).select(*K3, "report_label", "basis_text", "human_recheck", "item_label")


def _gaps(rows):
    parts = []
    for description, groups in rows:
        met = " AND ".join(ov.any_of("jc", sorted({tx.squeeze(t) for t in g})) for g in groups)
        parts.append(f"CASE WHEN NOT ({met}) THEN {ov.quote(description)} END")
    return "concat_ws(', ', " + ", ".join(parts) + ")"


def _coverage(rows):
    g = _gaps(rows)
    return f"CASE WHEN {g} = '' THEN CASE WHEN own_pages IS NULL THEN '관련 문구 명시' ELSE '제안요청서 ' || own_pages || ' 명시' END WHEN own_pages IS NULL THEN '일부 미명시 - ' || {g} ELSE '제안요청서 ' || own_pages || ' 일부 미명시 - ' || {g} END"


DETAIL = f"""{REPORT_PAIRS}, kept_list AS (SELECT document_id, item_no, page_no, list(p) AS kp, {ov.compact("string_agg(txt, ' ' ORDER BY k)")} AS jc FROM kept GROUP BY ALL),
{RUNS.format(src='kp', table='kept_list', name='rshown')}, {RUNS.format(src='evidence_pages', table='final', name='oshown').replace('run AS', 'orun AS').replace('FROM run', 'FROM orun')},
comment AS (SELECT f.*, coalesce(r.report, '') AS shown, o.report AS own_pages, coalesce(jc, '') AS jc FROM labelled f LEFT JOIN rshown r USING (document_id, item_no, page_no) LEFT JOIN oshown o USING (document_id, item_no, page_no) LEFT JOIN kept_list USING (document_id, item_no, page_no))"""


@query("detail_comments", f"""
WITH {ov.FINALS}, {DETAIL}
SELECT document_id, item_no, page_no, CASE WHEN item_no = '16' THEN CASE WHEN is_target IS NULL THEN '대상여부 확인필요' ELSE CASE WHEN shown <> '' THEN '제안요청서 ' || shown || ' 기준 ' ELSE '' END || CASE WHEN is_target THEN '대상' ELSE '비대상' END || ' 사업으로 판단' END
  WHEN report_label = '준수' THEN CASE WHEN item_no = '5' THEN {_coverage(wd.DETAIL_5)} WHEN item_no = '6' THEN {_coverage(wd.DETAIL_6)} WHEN item_no = '9' THEN '특정규격 명시 없음'
    WHEN item_no = '14' AND len(evidence_pages) > 0 THEN '제안요청서 p.' || list_min(evidence_pages) || ' 이하 명시' WHEN shown <> '' THEN '제안요청서 ' || shown || ' 명시' ELSE '관련 문구 명시' END
  WHEN report_label = '해당없음' THEN '해당없음' WHEN report_label IN ('미준수', '보완필요') THEN CASE WHEN item_no IN ('12', '15', '17') AND recommendation <> '' THEN recommendation
    WHEN shown <> '' THEN '제안요청서 ' || shown || ' 일부 명시' || chr(10) || '→ ' || coalesce(nullif(recommendation, ''), nullif(reason, ''), '관련 법령 기준에 맞게 보완하시기 바랍니다.') ELSE coalesce(nullif(recommendation, ''), nullif(reason, ''), '관련 법령 기준에 맞게 보완하시기 바랍니다.') END
  ELSE '확인필요 - ' || coalesce(nullif(reason, ''), '자동 판정 근거가 부족합니다.') END AS detail_comment FROM comment""")
def detail_comments(spark, sf):
    return wd.detail_comments(wd.compliance_report(inp.finals(spark, sf))).select(*K3, "detail_comment")


@query("report_tables", f"""
WITH {ov.FINALS}, labelled AS (SELECT *, {REPORT_LABEL.format(r='final_result', s='final_status')} AS report_label FROM final)
SELECT document_id, item_no, CASE WHEN report_label = '미준수' THEN 0 ELSE 1 END AS section, item_no || '. ' || {NAMES} AS item_label, ' - ' || coalesce(nullif(recommendation, ''), nullif(reason, ''), '관련 기준에 맞게 보완 필요') AS line FROM labelled WHERE report_label IN ('미준수', '보완필요')""")
def report_tables(spark, sf):
    return wd.report_tables(inp.finals(spark, sf))[2]


def _output(spark, sf):
    f = inp.finals(spark, sf).withColumn("requires_adjudication", F.col("page_no") % 13 == 0)
    return wd.review_output(wd.compliance_content(f), rt.load_criteria(inp.legal_items(spark, sf), inp.legal_requirements(spark, sf)), K3)


OUTPUT = f"""{ov.LEGAL_ITEMS}, {ov.LEGAL_REQUIREMENTS}, {CONTENT}, {ASSESSED}, {RESULT}, {RUNS.format(src='evidence_pages', table='final', name='all_shown').replace('run AS', 'orun AS').replace('FROM run', 'FROM orun')},
output AS MATERIALIZED (SELECT w.document_id, w.item_no, w.page_no, coalesce(i.title, CASE WHEN w.item_no IN (SELECT item_no FROM legal_requirement) THEN '' END) AS law_name, coalesce(r.final_result, {SERVICE_LABEL.format(r='w.final_result')}) AS normalized_result,
    CASE WHEN r.final_result IS NULL THEN content WHEN r.final_result = '준수' THEN coalesce('제안요청서 ' || plain || ' 명시', '관련 문구 명시') ELSE act END AS compliance_content,
    CASE WHEN r.final_result IS NULL THEN reason WHEN r.final_result = '준수' THEN '{rubric.R_ALL}' ELSE '{rubric.R_MISSING}' || lack END AS reason,
    concat_ws(',', CASE WHEN confidence < 0.75 THEN 'confidence_low' END, CASE WHEN len(evidence_pages) = 0 OR len(evidence_text) = 0 THEN 'evidence_missing' END, CASE WHEN len(warnings) > 0 THEN 'review_warnings' END, CASE WHEN w.page_no % 13 = 0 THEN 'verification_requires_adjudication' END) AS attention_reasons, recommendation
  FROM worded w LEFT JOIN result r USING (document_id, item_no, page_no) LEFT JOIN all_shown USING (document_id, item_no, page_no) LEFT JOIN legal_item i ON i.item_no = w.item_no)"""


@query("review_output", f"WITH {ov.FINALS}, {OUTPUT} SELECT document_id, item_no, page_no, law_name, normalized_result, compliance_content, reason, attention_reasons FROM output")
def review_output(spark, sf):
    return _output(spark, sf).select(*K3, "law_name", "normalized_result", "compliance_content", "reason", F.array_join("attention_reasons", ",").alias("attention_reasons"))


@query("workflow_gate", f"""
WITH {ov.FINALS}, {OUTPUT} SELECT document_id, count(*) FILTER (attention_reasons <> '') AS user_action_required_count, bool_and(length(normalized_result) > 0 AND length(compliance_content) > 0) AS all_items_complete,
  count(*) FILTER (attention_reasons <> '') = 0 AS can_generate_recommendations FROM output GROUP BY 1""")
def workflow_gate(spark, sf):
    return wd.workflow_gate(_output(spark, sf))


@query("opinion_summary")
def opinion_summary(spark, sf):
    return wd.opinion_summary(_output(spark, sf).withColumn("position", F.col("page_no")))


@query("opinion_counts", f"""
WITH {ov.FINALS}, {OUTPUT} SELECT document_id, count(*) AS total_count, count(*) FILTER (normalized_result = '미준수') AS non_compliant_count, count(*) FILTER (normalized_result = '보완필요') AS needs_revision_count FROM output GROUP BY 1""")
def opinion_counts(spark, sf):
    return wd.opinion_summary(_output(spark, sf).withColumn("position", F.col("page_no"))).drop("copy_text")


def _report_rows(spark, sf):
    li = inp.read(spark, sf, "lineitem")
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ["second_review_type1", "second_review_type2", "second_review_Patch", "second_review_rule_no_api"]]), (F.col("l_suppkey") % 4 + 1).cast("int")), F.lit(".json"))
    return li.select(
        name.alias("source_file"), F.concat((F.col("l_partkey") % 300).cast("string"), F.when(F.col("l_partkey") % 5 == 0, "-1").otherwise("")).alias("item_no"),
        F.when(F.col("l_tax") > 0.03, "text").otherwise("").alias("generated_content"), F.when(F.col("l_linestatus") == "O", "1, 2").otherwise("").alias("selected_pages"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.concat(F.lit("x -> do "), F.col("l_orderkey").cast("string")).alias("recommendation"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("row_seq"),
    )


@query("content_report", """
WITH r AS (SELECT ['second_review_type1', 'second_review_type2', 'second_review_Patch', 'second_review_rule_no_api'][l_suppkey % 4 + 1] || '.json' AS source_file, l_partkey % 300 || CASE WHEN l_partkey % 5 = 0 THEN '-1' ELSE '' END AS item_no,
    l_tax > 0.03 AS has_text, l_linestatus = 'O' AS has_pages, round(1 - l_discount, 2) AS confidence, 'do ' || l_orderkey AS recommendation, l_orderkey * 1000 + l_linenumber AS row_seq FROM lineitem),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY item_no ORDER BY contains(lower(source_file), 'patch') DESC, has_text DESC, has_pages DESC, confidence DESC, CASE WHEN contains(source_file, 'rule_no_api') THEN 4 WHEN contains(source_file, 'type2') THEN 2 WHEN contains(source_file, 'type1') THEN 1 ELSE 0 END DESC, source_file, row_seq) = 1)
SELECT item_no, source_file, confidence, split_part(item_no, '-', 1)::INT AS main_no, CASE WHEN contains(item_no, '-') THEN 1 ELSE 0 END AS sub_no FROM best""")
def content_report(spark, sf):
    return wd.content_report(_report_rows(spark, sf)).select("item_no", "source_file", "confidence", "main_no", "sub_no")


# --- feedback ----------------------------------------------------------------------------------------------------------------


KP = ["document_id", "page_no"]
CORRECTED = f"""corrected AS MATERIALIZED (SELECT f.* REPLACE (CASE WHEN b.corrected_result <> '' THEN b.corrected_result ELSE final_result END AS final_result,
    CASE WHEN b.corrected_result = '해당없음' THEN false WHEN b.corrected_result <> '' THEN true ELSE is_target END AS is_target,
    CASE WHEN b.comment <> '' THEN {ov.strip("reason || chr(10) || chr(10) || '사용자 수정 의견: ' || b.comment")} ELSE reason END AS reason,
    CASE WHEN b.corrected_result IN ('미준수', '보완필요') AND {ov.strip("CASE WHEN b.manual_edited AND " + ov.strip('b.manual_content') + " <> '' THEN " + ov.strip('b.manual_content') + " ELSE recommendation END")} = ''
      THEN coalesce(nullif({ov.strip('b.comment')}, ''), '{fb.DEFAULT_ADVICE}') WHEN b.manual_edited AND {ov.strip('b.manual_content')} <> '' THEN {ov.strip('b.manual_content')} ELSE recommendation END AS recommendation,
    CASE WHEN b.comment <> '' THEN ['user_feedback_applied'] ELSE []::VARCHAR[] END AS warnings), NOT coalesce(b.resolved, false) AS needs_human_review
  FROM final f LEFT JOIN feedback b ON b.document_id = f.document_id AND b.page_no = f.page_no)"""


@query("apply_feedback", f"""
WITH {ov.FINALS}, {ov.FEEDBACK}, {CORRECTED} SELECT document_id, item_no, page_no, final_result, is_target, reason, recommendation, array_to_string(warnings, ',') AS warnings, needs_human_review FROM corrected""")
def apply_feedback(spark, sf):
    done = fb.apply_feedback(inp.finals(spark, sf), inp.feedback(spark, sf), KP)
    return done.select(*K3, "final_result", "is_target", "reason", "recommendation", F.array_join("warnings", ",").alias("warnings"), "needs_human_review")


def _overrides(spark, sf):
    f = inp.feedback(spark, sf)
    status = F.when(F.col("corrected_result") == "준수", rubric.STATED).when(F.col("corrected_result") == "미준수", rubric.UNSTATED).otherwise(rubric.PARTLY)
    rows = F.create_map(F.lit("1"), status, F.lit("3"), F.lit(rubric.STATED))
    return f.filter("corrected_result <> ''").select("document_id", "page_no", (F.col("page_no") % 18 + 1).cast("string").alias("item_no"), rows.alias("row_status"))


@query("apply_row_overrides", f"""
WITH {ov.FINALS}, {ov.FEEDBACK}, {ASSESSED}, told AS (SELECT document_id, page_no, CASE corrected_result WHEN '준수' THEN '명시' WHEN '미준수' THEN '미명시' ELSE '일부명시' END AS s FROM feedback WHERE corrected_result <> ''),
edited AS (SELECT a.* REPLACE (CASE WHEN t.s IS NULL THEN explicit_status WHEN row_no = '1' THEN t.s WHEN row_no = '3' THEN '명시' ELSE explicit_status END AS explicit_status) FROM assess a LEFT JOIN told t ON t.document_id = a.document_id AND t.page_no = a.page_no),
{RESULT.replace('FROM assess ', 'FROM edited ')}
SELECT document_id, item_no, page_no, final_result, CASE WHEN final_result = '준수' THEN '{rubric.R_ALL_EDITED}' ELSE '{rubric.R_MISSING}' || lack END AS assessment_reason FROM result""")
def apply_row_overrides(spark, sf):
    f = inp.finals(spark, sf)
    return fb.reassess(wd.assess_rows(f, K3), _overrides(spark, sf), f, K3).select(*K3, "final_result", "assessment_reason")


@query("apply_manual_content", f"""
WITH {ov.FINALS}, {ov.FEEDBACK}, {CONTENT}
SELECT w.document_id, w.item_no, w.page_no, CASE WHEN b.document_id IS NOT NULL THEN 'user_entered_compliance_content' ELSE 'compliance_statement' END AS content_type, coalesce({ov.strip('b.manual_content')}, content) AS compliance_content
FROM worded w LEFT JOIN (SELECT * FROM feedback WHERE manual_edited AND {ov.strip('manual_content')} <> '') b ON b.document_id = w.document_id AND b.page_no = w.page_no""")
def apply_manual_content(spark, sf):
    done = fb.apply_manual_content(wd.compliance_content(inp.finals(spark, sf)), inp.feedback(spark, sf), KP)
    return done.select(*K3, "content_type", "compliance_content")


GOLD = "gold AS (SELECT doc_id, CASE WHEN quality = 1 THEN '준수' ELSE '비대상' END AS g FROM labels), pred AS (SELECT doc_id, ['준수', '해당없음', '미준수'][n_chars % 3 + 1] AS p FROM documents), pair AS (SELECT doc_id AS document_id, p AS predicted, CASE g WHEN '비대상' THEN '해당없음' ELSE g END AS answer FROM pred JOIN gold USING (doc_id))"


def _accuracy(spark, sf):
    labels = inp.read(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "준수").otherwise("비대상").alias("result"))
    d = inp.read(spark, sf, "documents")
    kinds = F.array(*[F.lit(x) for x in ["준수", "해당없음", "미준수"]])
    predicted = d.select(F.col("doc_id").alias("document_id"), F.element_at(kinds, (F.col("n_chars") % 3 + 1).cast("int")).alias("result"))
    return fb.accuracy(predicted, labels, ["document_id"])


@query("accuracy", f"WITH {GOLD} SELECT count(*) AS item_count, count(*) FILTER (predicted = answer) AS correct_count, round(count(*) FILTER (predicted = answer) / count(*)::DOUBLE, 4) AS accuracy FROM pair")
def accuracy(spark, sf):
    return _accuracy(spark, sf)[1]


@query("accuracy_rows", f"WITH {GOLD} SELECT document_id, predicted, answer, predicted = answer AS correct FROM pair")
def accuracy_rows(spark, sf):
    return _accuracy(spark, sf)[0]


@query("confusion", f"WITH {GOLD} SELECT predicted, answer, count(*) AS n FROM pair GROUP BY ALL")
def confusion(spark, sf):
    return fb.confusion(_accuracy(spark, sf)[0])


@query("page_failure_summary", f"""
WITH {ov.EVENTS}, still AS (SELECT job_id, page_no FROM parse_event WHERE status = 'failed' EXCEPT SELECT job_id, page_no FROM parse_event WHERE status = 'running' UNION SELECT job_id, page_no FROM parse_event WHERE status = 'queued' AND version % 2 = 0),
n AS (SELECT job_id AS document_id, count(*) AS failed_pages FROM still GROUP BY 1), jobs AS (SELECT DISTINCT job_id AS document_id FROM parse_event)
SELECT document_id, 50 AS total_pages, coalesce(failed_pages, 0) AS failed_pages, 50 - coalesce(failed_pages, 0) AS successful_pages FROM jobs LEFT JOIN n USING (document_id)""")
def page_failure_summary(spark, sf):
    e = inp.parse_events(spark, sf).withColumnRenamed("job_id", "document_id")
    jobs = e.select("document_id").distinct().withColumn("total_pages", F.lit(50))
    return fb.page_failure_summary(e.filter("status = 'failed'"), e.filter("status = 'running'"), e.filter("status = 'queued' and version % 2 = 0"), jobs)[1]


@query("regenerate")
def regenerate(spark, sf):
    """Feedback, merge, wording and opinion over one row per (document, item)."""
    page = cut_lineage(inp.pages(spark, sf).select(*inp.FINAL_PAGE))  # assessment and wording both start from it
    one = inp.first_finals(spark, sf, page).drop("page_no")
    g = inp.feedback(spark, sf).withColumn("item_no", (F.col("page_no") % 18 + 1).cast("string"))
    back = g.groupBy("document_id", "item_no").agg(F.min_by(F.struct(*fb.FEEDBACK_COLUMNS), "page_no").alias("r")).select("document_id", "item_no", "r.*")
    _, opinion, gate = fb.regenerate(one, back, cr.criteria_hits(spark, sf), rt.load_criteria(inp.legal_items(spark, sf), inp.legal_requirements(spark, sf)))
    return opinion.join(gate, "document_id")
