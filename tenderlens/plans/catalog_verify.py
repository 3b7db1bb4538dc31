"""Registered queries: verification, votes, merging, resume and post-processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.operators import evidence as ev
from tenderlens.operators import verify as vf
from tenderlens.plans import catalog_evidence as ce
from tenderlens.plans import catalog_judgements as cj
from tenderlens.plans import inputs as inp
from tenderlens.plans import oracle_views as ov
from tenderlens.plans.registry import query
from tenderlens.rules import pack
from tenderlens.session import cut_lineage

ROUTE_SQL = "CASE " + " ".join(f"WHEN trim({{c}}) IN ({', '.join(ov.quote(i) for i in items)}) THEN '{r}'" for r, items in pack.ROUTES.items()) + " ELSE 'llm' END"
GROUNDED = "source <> 'llm_disabled' AND len(evidence_pages) > 0 AND len(evidence_text) > 0"


@query("route_items", f"SELECT o_orderkey, (o_orderkey % 20)::VARCHAR AS item_no, {ROUTE_SQL.format(c='(o_orderkey % 20)::VARCHAR')} AS route FROM orders")
def route_items(spark, sf):
    return vf.route_items(inp.read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 20).cast("string").alias("item_no")))


GROUP_SQL = "CASE g " + " ".join(f"WHEN '{g}' THEN {ov.sql_list(i)}" for g, i in pack.ITEM_GROUPS.items()) + " END"


@query("expand_items", f"""
WITH req AS (SELECT o_orderkey AS request_id, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 18 + 1) || ', 2,,' || (o_orderkey % 5 + 1) WHEN 1 THEN '' END AS items,
    CASE o_orderkey % 4 WHEN 2 THEN ['rule_no_api', 'type1', 'type2', 'type3'][o_orderkey % 3 + 1] END AS g FROM orders),
chosen AS (SELECT request_id, CASE WHEN g IS NOT NULL THEN {GROUP_SQL} WHEN length(items) > 0 THEN list_filter(list_transform(string_split(items, ','), lambda x: trim(x)), lambda x: x <> '') ELSE {ov.sql_list(pack.DEFAULT_ITEMS)} END AS l FROM req),
both_ AS (SELECT request_id, flatten(list_transform(l, lambda x: CASE WHEN x = '2' THEN ['2', '2-1'] ELSE [x] END)) AS l FROM chosen),
pos AS (SELECT request_id, unnest(range(0, len(l))) AS k, unnest(l) AS item_no FROM both_), firsts AS (SELECT request_id, item_no, min(k) AS k FROM pos GROUP BY ALL)
SELECT request_id, (row_number() OVER (PARTITION BY request_id ORDER BY k) - 1)::INT AS position, item_no FROM firsts""")
def expand_items(spark, sf):
    k = F.col("o_orderkey")
    req = inp.read(spark, sf, "orders").select(
        k.alias("request_id"),
        F.when(k % 4 == 0, F.concat((k % 18 + 1).cast("string"), F.lit(", 2,,"), (k % 5 + 1).cast("string"))).when(k % 4 == 1, "").alias("items"),
        F.when(k % 4 == 2, F.element_at(F.array(*[F.lit(g) for g in pack.ITEM_GROUPS]), (k % 3 + 1).cast("int"))).alias("group_name"),
    )
    return vf.expand_items(req)


@query("vote", f"""
WITH {ov.REVIEWS}, n AS (SELECT document_id, item_no, result, is_target, count(*) AS votes, min(seq) AS first_seq FROM review WHERE {GROUNDED} GROUP BY ALL)
SELECT document_id, item_no, result, is_target, votes, count(*) OVER (PARTITION BY document_id, item_no) AS distinct_votes FROM n
QUALIFY row_number() OVER (PARTITION BY document_id, item_no ORDER BY votes DESC, first_seq) = 1""")
def vote(spark, sf):
    return vf.vote(inp.reviews(spark, sf))


FINAL_SHOWN = "document_id, item_no, final_status, final_result, is_target, confidence, pages, texts, reason, recommendation, warnings"


def final_shown(df):
    return df.select(
        "document_id", "item_no", "final_status", "final_result", "is_target", "confidence", tx.join_ints(F.col("evidence_pages")).alias("pages"),
        F.array_join("evidence_text", "|").alias("texts"), "reason", "recommendation", F.array_join("warnings", "|").alias("warnings"),
    )


FINAL_CONFIDENCE = ov.round_thousandths(f"CASE WHEN final_status IN ('{pack.STATUS_AUTO}', '{pack.STATUS_ESCALATED}') THEN confidence ELSE least(confidence, 0.69) END")


def verify_sql(escalated: bool) -> str:
    esc = """esc AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 2 = 0 THEN '준수' ELSE '미준수' END AS result, true AS is_target FROM orders WHERE o_orderstatus = 'F'),
matching AS (SELECT r.*, r.result = e.result AND r.is_target IS NOT DISTINCT FROM e.is_target AS agrees FROM g r JOIN esc e ON e.document_id = r.document_id),
mpair AS (SELECT document_id, agrees, seq, unnest(range(0, len(evidence_pages))) AS pos, unnest(evidence_pages) AS page, unnest(evidence_text) AS txt FROM matching),
mfirst AS (SELECT * FROM mpair QUALIFY row_number() OVER (PARTITION BY document_id, agrees, page ORDER BY seq, pos) = 1),
mlist AS (SELECT document_id, agrees, list(page ORDER BY page) AS ps, list(txt ORDER BY page) AS ts FROM mfirst GROUP BY ALL),
mbest AS (SELECT document_id, arg_max(ps, agrees::INT) AS ps, arg_max(ts, agrees::INT) AS ts FROM mlist GROUP BY 1),
erow AS (SELECT e.document_id, (e.document_id % 18 + 1)::VARCHAR AS item_no, 4611686018427387904 AS seq, e.result, e.is_target, 0.8 AS confidence, ps AS evidence_pages, ts AS evidence_text, 'escalated' AS reason, '' AS recommendation
  FROM esc e JOIN mbest USING (document_id)),
""" if escalated else ""
    raised = "WHEN conflicts >= 2 AND document_id IN (SELECT document_id FROM erow) THEN 'esc'" if escalated else ""
    extra = f"UNION ALL SELECT s.document_id, s.item_no, k, e.seq, e.result, e.is_target, e.confidence, e.evidence_pages, e.evidence_text, e.reason, e.recommendation FROM stated s JOIN erow e ON e.document_id = s.document_id AND s.k = 'esc'" if escalated else ""
    return f"""WITH {ov.REVIEWS}, {ov.STATUSES},
r AS (SELECT review.*, parse_status, source <> 'llm_disabled' AS active, {GROUNDED} AS grounded, source <> 'llm_disabled' AND (coalesce(is_target, true) = false OR result = '해당없음') AS off FROM review LEFT JOIN parse_state USING (document_id)),
g AS (SELECT * FROM r WHERE grounded), {esc}
lead AS (SELECT * FROM (SELECT document_id, item_no, result AS lr, is_target AS lt, count(*) AS n, min(seq) AS f, bool_or(needs_human_review) AS human FROM g GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY document_id, item_no ORDER BY n DESC, f) = 1),
tot AS (SELECT document_id, item_no, any_value(parse_status) AS parse_status, count(*) FILTER (active) AS na, count(*) FILTER (off) AS no, count(*) FILTER (grounded) AS ng,
    count(DISTINCT result || coalesce(is_target::VARCHAR, '-')) FILTER (grounded) AS conflicts, arg_max(needs_human_review, [confidence, -seq]) FILTER (off) AS calm_human, max(confidence) FILTER (off) AS calm_conf,
    max(confidence) FILTER (grounded) AS only_conf FROM r GROUP BY 1, 2),
stated AS (SELECT t.*, lr, lt, CASE WHEN na = 0 THEN 'none' WHEN parse_status = 'fail' THEN 'fail' WHEN no = na AND NOT calm_human AND calm_conf >= 0.7 THEN 'off' WHEN ng = 0 THEN 'bare' {raised}
    WHEN ng = 1 AND NOT human AND only_conf >= 0.7 THEN 'single' WHEN ng = 1 THEN 'alone' WHEN n >= 2 AND NOT human THEN 'most' WHEN conflicts > 1 THEN 'clash' ELSE 'rest' END AS k FROM tot t LEFT JOIN lead USING (document_id, item_no)),
pool AS (SELECT s.document_id, s.item_no, k, seq, result, is_target, confidence, evidence_pages, evidence_text, reason, recommendation FROM stated s JOIN r USING (document_id, item_no)
  WHERE CASE WHEN k = 'none' THEN true WHEN k IN ('fail', 'bare', 'esc') THEN active WHEN k = 'off' THEN off WHEN k = 'most' THEN grounded AND result = lr AND is_target IS NOT DISTINCT FROM lt ELSE grounded END {extra}),
picked AS (SELECT *, CASE k WHEN 'none' THEN '{pack.STATUS_HUMAN}' WHEN 'fail' THEN '{pack.STATUS_PARSE_HOLD}' WHEN 'off' THEN '{pack.STATUS_AUTO}' WHEN 'bare' THEN '{pack.STATUS_NO_EVIDENCE}' WHEN 'esc' THEN '{pack.STATUS_ESCALATED}'
    WHEN 'single' THEN '{pack.STATUS_AUTO}' WHEN 'most' THEN '{pack.STATUS_AUTO}' WHEN 'clash' THEN '{pack.STATUS_CONFLICT}' ELSE '{pack.STATUS_HUMAN}' END AS final_status
  FROM pool QUALIFY row_number() OVER (PARTITION BY document_id, item_no ORDER BY CASE WHEN k = 'off' THEN 0 ELSE (len(evidence_pages) = 0)::INT END, confidence DESC, seq) = 1)
SELECT document_id, item_no, final_status, result AS final_result, is_target, {FINAL_CONFIDENCE} AS confidence,
  array_to_string(evidence_pages, ',') AS pages, array_to_string(evidence_text, '|') AS texts, reason, recommendation,
  CASE k WHEN 'none' THEN '{pack.WARN_NO_ACTIVE}' WHEN 'fail' THEN '{pack.WARN_PARSE_FAIL}' WHEN 'bare' THEN '{pack.WARN_UNGROUNDED}' WHEN 'clash' THEN '{pack.WARN_CONFLICT}' ELSE '' END AS warnings FROM picked"""


@query("verify", verify_sql(False))
def verify(spark, sf):
    return final_shown(vf.verify(inp.reviews(spark, sf), inp.parse_statuses(spark, sf)))


@query("verify_escalated", verify_sql(True))
def verify_escalated(spark, sf):
    return final_shown(vf.verify(inp.reviews(spark, sf), inp.parse_statuses(spark, sf), inp.escalated_reviews(spark, sf)))


@query("choose_final", f"""
WITH {ov.REVIEWS} SELECT document_id, item_no, result AS final_result, {ov.round_thousandths('least(confidence, 0.69)')} AS confidence, reason FROM review
QUALIFY row_number() OVER (PARTITION BY document_id, item_no ORDER BY len(evidence_pages) = 0, confidence DESC, seq) = 1""")
def choose_final(spark, sf):
    r = inp.reviews(spark, sf)
    best = r.groupBy(*vf.KEY).agg(F.min_by(vf._payload(), vf._place()).alias("c"))
    done = vf.choose_final(best, F.lit(pack.STATUS_HUMAN), F.array().cast("array<string>"))
    return done.select("document_id", "item_no", "final_result", "confidence", "reason")


@query("attach_grounded_evidence", verify_sql(True).split("lead AS (")[0].rstrip().rstrip(",") + """
SELECT document_id, item_no, array_to_string(evidence_pages, ',') AS pages, array_to_string(evidence_text, '|') AS texts FROM erow
UNION ALL SELECT o_orderkey, (o_orderkey % 18 + 1)::VARCHAR, '', '' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT document_id FROM erow)""")
def attach_grounded_evidence(spark, sf):
    done = vf.attach_grounded_evidence(inp.escalated_reviews(spark, sf), inp.reviews(spark, sf))
    return done.select("document_id", "item_no", tx.join_ints(F.col("evidence_pages")).alias("pages"), F.array_join("evidence_text", "|").alias("texts"))


# --- findings over page-sized reviews -----------------------------------------------------------------------------


def primary(spark, sf, page=None):
    """Final rows as primary reviews; every seventh loses a text, every fifth is from another route."""
    f = inp.finals(spark, sf, page)
    n = F.size("evidence_text")
    length = F.length("reason")
    return f.select(
        "document_id", "item_no", F.col("page_no").cast("long").alias("seq"), F.when(F.col("page_no") % 5 == 0, "table_review").otherwise("rule_review").alias("route_type"),
        F.col("final_result").alias("result"), "is_target", "confidence", "evidence_pages", F.when((F.col("page_no") % 7 == 0) & (n > 0), F.slice("evidence_text", 1, 2)).otherwise(F.col("evidence_text")).alias("evidence_text"),
        "reason", "recommendation", F.lit(False).alias("needs_human_review"), F.lit("python_rule").alias("source"),
    )


PRIMARY = f"""{ov.FINALS}, prim AS MATERIALIZED (SELECT document_id, item_no, page_no::BIGINT AS seq, CASE WHEN page_no % 5 = 0 THEN 'table_review' ELSE 'rule_review' END AS route_type, final_result AS result, evidence_pages,
    CASE WHEN page_no % 7 = 0 THEN evidence_text[1:2] ELSE evidence_text END AS evidence_text, reason, confidence FROM final),
prim2 AS MATERIALIZED (SELECT *, array_to_string(evidence_text, ' ') AS e, lower({ov.compact("array_to_string(evidence_text, ' ')")}) AS ec FROM prim)"""


def routes(spark, sf):
    items = inp.read(spark, sf, "orders").select((F.col("o_orderkey") % 18 + 1).cast("string").alias("item_no")).distinct()
    return vf.route_items(items).withColumnRenamed("route", "expected_route")


def atomic(spark, sf):
    return inp.legal_requirements(spark, sf).select("item_no", F.concat(F.lit("r"), F.col("row_id").cast("string")).alias("requirement_id"), "requirement_text")


ATOMIC = f"atomic AS (SELECT item_no, 'r' || row_id AS requirement_id, requirement_text FROM legal_requirement)"
IMPORTANT = f"list_filter(regexp_extract_all({{c}}, '[0-9A-Za-z가-힣]{{{{2,}}}}'), lambda t: NOT list_contains({ov.sql_list(pack.IMPORTANT_STOPWORDS)}, t))"
SUPPORT = f"""asked AS (SELECT p.*, requirement_id, requirement_text, {IMPORTANT.format(c='requirement_text')} AS ts FROM prim2 p JOIN atomic USING (item_no) WHERE requirement_text <> ''),
support AS MATERIALIZED (SELECT *, CASE WHEN len(ts) = 0 THEN true WHEN len(ts) = 1 THEN contains(ec, lower(ts[1])) ELSE len(list_filter(ts, lambda t: contains(ec, lower(t)))) >= greatest(1, floor(len(ts) * 0.7::DOUBLE + 0.5::DOUBLE)) END AS ok FROM asked)"""


@query("requirement_supported", f"""
WITH {PRIMARY}, {ov.LEGAL_REQUIREMENTS}, {ATOMIC}, {SUPPORT} SELECT document_id, item_no, seq, requirement_id, ok AS supported FROM support""")
def requirement_supported(spark, sf):
    asked = atomic(spark, sf).filter("requirement_text <> ''").withColumn("terms", vf.lowered_terms(F.col("requirement_text")))
    p = primary(spark, sf).select("document_id", "item_no", "seq", tx.compact_lower(F.array_join("evidence_text", " ")).alias("low")).join(asked, "item_no")
    return p.select("document_id", "item_no", "seq", "requirement_id", vf.terms_supported(F.col("terms"), F.col("low")).alias("supported"))


COMPLIANT = "(trim(result) = '준수' OR starts_with(trim(result), '以'))"
FINDINGS = f"""{PRIMARY}, {ov.LEGAL_REQUIREMENTS}, {ATOMIC}, {SUPPORT},
num AS (SELECT document_id, number, c AS pc FROM (SELECT document_id, page_no, c, unnest([page_no, printed_page_no]) AS number FROM page) WHERE number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, number ORDER BY page_no DESC) = 1),
cited AS (SELECT document_id, item_no, seq, result, unnest(evidence_pages[1:len(evidence_text)]) AS number, unnest(evidence_text[1:len(evidence_pages)]) AS txt FROM prim),
wrong AS (SELECT c.* FROM cited c JOIN num n ON n.document_id = c.document_id AND n.number = c.number WHERE txt <> '' AND pc <> '' AND NOT contains(lower(pc), substr(lower({ov.compact('txt')}), 1, 80))),
unseen AS (SELECT *, list_filter({IMPORTANT.format(c='reason')}, lambda t: NOT list_contains({IMPORTANT.format(c='e')}, t)) AS u FROM prim2 WHERE reason <> '' AND e <> ''),
finding AS (
  SELECT document_id, item_no, seq, result, 'schema_or_consistency_error' AS finding_type, 'medium' AS severity, '{vf.M_ALIGN}' AS message, NULL AS requirement_id FROM prim WHERE len(evidence_pages) <> len(evidence_text)
  UNION ALL SELECT document_id, item_no, seq, result, 'invalid_routing', 'high', 'Expected ' || x || ' route, but primary review route was ' || route_type || '.', NULL FROM (SELECT *, {ROUTE_SQL.format(c='item_no')} AS x FROM prim) WHERE NOT (route_type = x OR starts_with(route_type, x) OR contains(route_type, x || '_'))
  UNION ALL SELECT document_id, item_no, seq, result, 'invalid_evidence_page', 'high', '{vf.M_PAGE}' || number || '.', NULL FROM wrong
  UNION ALL SELECT document_id, item_no, seq, result, 'missing_required_requirement', CASE WHEN {COMPLIANT} THEN 'high' ELSE 'medium' END, '{vf.M_REQUIREMENT}' || requirement_text, requirement_id FROM support WHERE NOT ok
  UNION ALL SELECT document_id, item_no, seq, result, 'evidence_reason_mismatch', 'medium', '{vf.M_REASON}', NULL FROM unseen WHERE len(u) >= 2),
findings AS MATERIALIZED (SELECT * FROM finding UNION ALL SELECT DISTINCT document_id, item_no, seq, result, 'overstated_judgement_strength', 'high', '{vf.M_STRENGTH}', NULL FROM finding WHERE finding_type IN ('missing_required_requirement', 'invalid_evidence_page') AND {COMPLIANT})"""


def findings(spark, sf):
    return vf.audit_findings(cut_lineage(primary(spark, sf)), inp.pages(spark, sf), routes(spark, sf), atomic(spark, sf))


@query("audit_findings", f"WITH {FINDINGS} SELECT document_id, item_no, seq, finding_type, severity, message, requirement_id FROM findings")
def audit_findings(spark, sf):
    return findings(spark, sf).drop("evidence_observed")


@query("audit_summary", f"""
WITH {FINDINGS}, t AS (SELECT document_id, item_no, seq, finding_type, count(*) AS n, bool_or(severity = 'high') AS h, bool_or(severity = 'medium') AS m FROM findings GROUP BY ALL),
s AS (SELECT document_id, item_no, seq, string_agg(finding_type || ': ' || n, ', ' ORDER BY finding_type) AS txt, bool_or(h) AS h, bool_or(m) AS m FROM t GROUP BY ALL)
SELECT p.document_id, p.item_no, p.seq, NOT coalesce(h OR m, false) AS can_auto_accept, coalesce(h, false) AS requires_adjudication, coalesce(txt, 'No audit findings.') AS audit_summary
FROM prim p LEFT JOIN s USING (document_id, item_no, seq)""")
def audit_summary(spark, sf):
    done = vf.audit_summary(findings(spark, sf), primary(spark, sf))
    return done.select("document_id", "item_no", "seq", "can_auto_accept", "requires_adjudication", "audit_summary")


@query("fallback_adjudication", f"""
WITH {PRIMARY}, {ov.LEGAL_REQUIREMENTS}, {ATOMIC}, {SUPPORT}
SELECT document_id, item_no, seq, result AS final_result, requirement_id, CASE WHEN ok THEN 'met' ELSE 'not_found' END AS status, CASE WHEN ok THEN array_to_string(evidence_pages, ',') ELSE '' END AS pages FROM support""")
def fallback_adjudication(spark, sf):
    done = vf.fallback_adjudication(primary(spark, sf), atomic(spark, sf).filter("requirement_text <> ''"))
    return done.select("document_id", "item_no", "seq", "final_result", "requirement_id", "status", tx.join_ints(F.col("evidence_pages")).alias("pages"))


@query("adjudication_gaps", """
SELECT DISTINCT l_orderkey AS document_id, (l_orderkey % 18 + 1)::VARCHAR AS item_no, 'r' || l_partkey AS requirement_id FROM lineitem
EXCEPT SELECT l_orderkey, (l_orderkey % 18 + 1)::VARCHAR, 'r' || l_partkey FROM lineitem WHERE l_returnflag = 'A'""")
def adjudication_gaps(spark, sf):
    li = inp.read(spark, sf, "lineitem")
    ids = li.select(F.col("l_orderkey").alias("document_id"), (F.col("l_orderkey") % 18 + 1).cast("string").alias("item_no"), F.concat(F.lit("r"), F.col("l_partkey").cast("string")).alias("requirement_id"), "l_returnflag")
    return vf.adjudication_gaps(ids, ids.filter("l_returnflag = 'A'"))


@query("resume_remaining", """
WITH wanted AS (SELECT o_orderkey AS document_id, unnest(['5', '8', '10']) AS item_no FROM orders)
SELECT document_id, item_no FROM wanted EXCEPT SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN '5' WHEN 'N' THEN '8' ELSE '10' END FROM lineitem""")
def resume_remaining(spark, sf):
    wanted = inp.read(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.explode(F.array(*[F.lit(i) for i in ["5", "8", "10"]])).alias("item_no"))
    done = inp.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_returnflag") == "A", "5").when(F.col("l_returnflag") == "N", "8").otherwise("10").alias("item_no"))
    return vf.resume_remaining(wanted, done)


# --- merging -----------------------------------------------------------------------------------------------------------

RANK = "CASE {c} WHEN '미준수' THEN 4 WHEN '보완필요' THEN 3 WHEN '확인필요' THEN 2 WHEN '해당없음' THEN 0 ELSE 1 END"
JOIN2 = "CASE WHEN {a} = '' THEN {b} WHEN {b} = '' OR {a} = {b} THEN {a} ELSE {a} || chr(10) || {b} END"
SUBS = f"""{ov.REVIEWS},
sub AS MATERIALIZED (SELECT *, (seq // 1000000000000)::INT % 2 AS s FROM review QUALIFY row_number() OVER (PARTITION BY document_id, (seq // 1000000000000)::INT % 2 ORDER BY seq) = 1),
two AS (SELECT a.document_id, CASE WHEN a.document_id % 2 = 1 THEN '4' ELSE '2' END AS item_no, a.result AS ar, b.result AS br, a.is_target AS ta, b.is_target AS tb, a.confidence AS ac, b.confidence AS bc, a.evidence_pages AS ap, b.evidence_pages AS bp,
    a.evidence_text AS ax, b.evidence_text AS bx, a.reason AS aw, b.reason AS bw, a.recommendation AS am, b.recommendation AS bm, a.source AS asrc, b.source AS bsrc FROM sub a JOIN sub b ON b.document_id = a.document_id AND a.s = 1 AND b.s = 0),
lone AS (SELECT * FROM sub WHERE document_id NOT IN (SELECT document_id FROM two))"""
TA, TB = "coalesce(ta, false)", "coalesce(tb, false)"
BY_RANK = f"({RANK.format(c='ar')}, ac) >= ({RANK.format(c='br')}, bc)"


@query("merge_subitem", f"""
WITH {SUBS},
chosen AS (SELECT *, item_no = '2' AND NOT {TA} AND NOT {TB} AS none, CASE WHEN item_no = '2' AND NOT {TA} AND NOT {TB} THEN ac >= bc WHEN item_no = '2' AND {TA} AND NOT {TB} THEN true WHEN item_no = '2' AND {TB} AND NOT {TA} THEN false ELSE {BY_RANK} END AS l FROM two),
pair AS (SELECT document_id, page, list(txt ORDER BY k) AS ts FROM (SELECT document_id, unnest(list_concat(ap, bp)) AS page, unnest(list_concat(ax, bx)) AS txt, unnest(range(0, len(ap) + len(bp))) AS k FROM two) GROUP BY ALL),
ev AS (SELECT document_id, string_agg(page, ',' ORDER BY page) AS pages, string_agg(list_reduce(ts, lambda acc, x: CASE WHEN x <> '' AND NOT contains(acc, x) THEN acc || chr(10) || x ELSE acc END), '|' ORDER BY page) AS texts FROM pair GROUP BY 1)
SELECT c.document_id, item_no, CASE WHEN l THEN asrc ELSE bsrc END AS final_status, CASE WHEN l THEN ar ELSE br END AS final_result, CASE WHEN l THEN ta ELSE tb END AS is_target, CASE WHEN l THEN ac ELSE bc END AS confidence,
  CASE WHEN none THEN array_to_string(CASE WHEN l THEN ap ELSE bp END, ',') ELSE coalesce(pages, '') END AS pages, CASE WHEN none THEN array_to_string(CASE WHEN l THEN ax ELSE bx END, '|') ELSE coalesce(texts, '') END AS texts,
  CASE WHEN none THEN CASE WHEN l THEN aw ELSE bw END WHEN item_no = '2' AND NOT l THEN {JOIN2.format(a='bw', b='aw')} ELSE {JOIN2.format(a='aw', b='bw')} END AS reason,
  CASE WHEN none THEN CASE WHEN l THEN am ELSE bm END WHEN item_no = '2' AND NOT l THEN {JOIN2.format(a='bm', b='am')} ELSE {JOIN2.format(a='am', b='bm')} END AS recommendation,
  CASE WHEN asrc = bsrc THEN asrc ELSE asrc || '|' || bsrc END AS warnings FROM chosen c LEFT JOIN ev USING (document_id)
UNION ALL SELECT document_id, CASE WHEN document_id % 2 = 1 THEN '4' ELSE '2' END, source, result, is_target, confidence, array_to_string(evidence_pages, ','), array_to_string(evidence_text, '|'), reason, recommendation, source FROM lone""")
def merge_subitem(spark, sf):
    return final_shown(vf.merge_subitem(inp.sub_finals(spark, sf)))


@query("merge_subitem_flat", f"""
WITH {SUBS}, chosen AS (SELECT *, {BY_RANK} AS l FROM two)
SELECT document_id, item_no, CASE WHEN l THEN asrc ELSE bsrc END AS final_status, CASE WHEN l THEN ar ELSE br END AS final_result, CASE WHEN l THEN ta ELSE tb END AS is_target, CASE WHEN l THEN ac ELSE bc END AS confidence,
  array_to_string(list_sort(list_distinct(list_concat(ap, bp))), ',') AS pages, array_to_string(list_concat(ax, list_filter(bx, lambda x: NOT list_contains(ax, x))), '|') AS texts,
  CASE WHEN l THEN {JOIN2.format(a='aw', b='bw')} ELSE {JOIN2.format(a='bw', b='aw')} END AS reason, CASE WHEN l THEN {JOIN2.format(a='am', b='bm')} ELSE {JOIN2.format(a='bm', b='am')} END AS recommendation,
  CASE WHEN asrc = bsrc THEN asrc ELSE asrc || '|' || bsrc END AS warnings FROM chosen
UNION ALL SELECT document_id, CASE WHEN document_id % 2 = 1 THEN '4' ELSE '2' END, source, result, is_target, confidence, array_to_string(evidence_pages, ','), array_to_string(evidence_text, '|'), reason, recommendation, source FROM lone""")
def merge_subitem_flat(spark, sf):
    return final_shown(vf.merge_subitem_flat(inp.sub_finals(spark, sf)))


@query("merge_evidence", f"""
WITH {ov.FINALS}, pair AS (SELECT document_id, item_no, seqno, cited, list(txt ORDER BY k) AS ts FROM (
  SELECT document_id, item_no, page_no AS seqno, unnest(list_concat(evidence_pages, [page_no, page_no])) AS cited, unnest(list_concat(evidence_text, [page_text, substr(page_text, 41)])) AS txt, unnest(range(0, len(evidence_pages) + 2)) AS k FROM final) GROUP BY ALL),
folded AS (SELECT document_id, item_no, seqno, cited, list_reduce(ts, lambda acc, x: CASE WHEN x <> '' AND NOT contains(acc, x) THEN CASE WHEN {ov.strip('acc')} = '' THEN {ov.strip('x')} WHEN {ov.strip('x')} = '' OR {ov.strip('x')} = {ov.strip('acc')} THEN {ov.strip('acc')} ELSE {ov.strip('acc')} || chr(10) || {ov.strip('x')} END ELSE acc END) AS t FROM pair)
SELECT document_id, item_no, seqno AS page_no, string_agg(cited, ',' ORDER BY cited) AS pages, md5(string_agg(t, '|' ORDER BY cited)) AS texts_md5 FROM folded GROUP BY ALL""")
def merge_evidence(spark, sf):
    p = inp.pages(spark, sf).select("document_id", "page_no", "page_text")
    f = inp.finals(spark, sf).select("document_id", "item_no", "page_no", "evidence_pages", "evidence_text").join(p, ["document_id", "page_no"])
    more = F.array(F.struct(F.col("page_no").alias("page"), F.col("page_text").alias("text")), F.struct(F.col("page_no").alias("page"), F.expr("substring(page_text, 41)").alias("text")))
    merged = f.withColumn("m", vf.merge_evidence(F.concat(vf.pairs_of(F.col("evidence_pages"), F.col("evidence_text")), more)))
    return merged.select("document_id", "item_no", "page_no", tx.join_ints(F.transform("m", lambda m: m["page"])).alias("pages"), F.md5(F.array_join(F.transform("m", lambda m: m["text"]), "|")).alias("texts_md5"))


@query("validate_reviews", f"""
WITH {PRIMARY}, best AS (SELECT * FROM prim2 QUALIFY row_number() OVER (PARTITION BY document_id, item_no ORDER BY len(evidence_pages) = 0, confidence DESC, seq) = 1),
finding AS (
  SELECT document_id, item_no, 'schema_or_consistency_error' AS kind FROM best WHERE len(evidence_pages) <> len(evidence_text)
  UNION ALL SELECT document_id, item_no, 'invalid_routing' FROM (SELECT *, {ROUTE_SQL.format(c='item_no')} AS x FROM best) WHERE NOT (route_type = x OR starts_with(route_type, x) OR contains(route_type, x || '_'))
  UNION ALL SELECT document_id, item_no, 'evidence_reason_mismatch' FROM best WHERE reason <> '' AND e <> '' AND len(list_filter({IMPORTANT.format(c='reason')}, lambda t: NOT list_contains({IMPORTANT.format(c='e')}, t))) >= 2),
told AS (SELECT document_id, item_no, string_agg(kind || ': 1', ', ' ORDER BY kind) AS txt, bool_or(kind = 'invalid_routing') AS high FROM finding GROUP BY ALL),
single AS (SELECT * FROM final QUALIFY row_number() OVER (PARTITION BY document_id, item_no ORDER BY page_no) = 1)
SELECT s.document_id, s.item_no, CASE WHEN coalesce(high, false) THEN b.result ELSE s.final_result END AS final_result, CASE WHEN coalesce(high, false) THEN b.confidence ELSE s.confidence END AS confidence,
  txt IS NULL AS can_auto_accept, coalesce(high, false) AS requires_adjudication, coalesce(txt, 'No audit findings.') AS audit_summary, array_to_string(CASE WHEN coalesce(high, false) THEN b.evidence_pages ELSE s.evidence_pages END, ',') AS pages
FROM single s JOIN best b USING (document_id, item_no) LEFT JOIN told USING (document_id, item_no)""")
def validate_reviews(spark, sf):
    page = cut_lineage(inp.pages(spark, sf).select(*inp.FINAL_PAGE))
    done = vf.validate_reviews(inp.first_finals(spark, sf, page), primary(spark, sf, page), routes(spark, sf), adjudicate=True)
    return done.select("document_id", "item_no", "final_result", "confidence", "can_auto_accept", "requires_adjudication", "audit_summary", tx.join_ints(F.col("evidence_pages")).alias("pages"))


# --- post-processing -------------------------------------------------------------------------------------------------------

BASIS = "CASE item_no " + " ".join(f"WHEN '{i}' THEN {ov.quote(t)}" for i, t in vf.BASIS_END.items()) + " END"


@query("target_basis", f"""
WITH {ov.FINALS}, {ce.AMOUNTS}, s AS (SELECT f.*, '대상: p.' || amount_page || '에 근거하여 총 사업금액 ' || {cj.AMOUNT_TEXT} || '임이 확인되어, ' || {BASIS} AS s FROM final f LEFT JOIN amount USING (document_id))
SELECT document_id, item_no, page_no, CASE WHEN is_target AND s IS NOT NULL AND NOT contains(reason, s) THEN {ov.strip("s || chr(10) || reason")} ELSE reason END AS reason FROM s""")
def target_basis(spark, sf):
    return vf.target_basis(inp.finals(spark, sf), ev.project_amount(inp.pages(spark, sf))).select("document_id", "item_no", "page_no", "reason")


HITS = " UNION ALL ".join(
    f"SELECT document_id, page_no, '{i}' AS item_no, coalesce(nullif(printed_page_no, 0), page_no) AS display_no, substr(page_text, 1, 260) AS text FROM page WHERE (has_attachment OR {ov.any_of('c', ['붙임', '별첨', '서식'])}) AND {ov.any_of('c', terms)}"
    for i, terms in vf.GATE_TERMS.items()
)
GATE_END = "CASE item_no " + " ".join(f"WHEN '{i}' THEN {ov.quote(t)}" for i, t in vf.GATE_TEXT.items()) + " END"


@query("manual_attachment_gate", f"""
WITH {ov.FINALS}, hit AS ({HITS}), top AS (SELECT *, row_number() OVER (PARTITION BY document_id, item_no ORDER BY page_no) AS k FROM hit QUALIFY k <= 3),
held AS (SELECT document_id, item_no, string_agg(display_no, ',' ORDER BY k) AS pages, string_agg(text, '|' ORDER BY k) AS texts, 'p.' || min(display_no) FILTER (k = 1) || any_value({GATE_END}) AS told FROM top GROUP BY ALL),
j AS (SELECT f.*, h.pages, h.texts, told, told IS NOT NULL AND (f.item_no = '2' OR trim(final_result) = '준수') AS due FROM final f LEFT JOIN held h USING (document_id, item_no))
SELECT document_id, item_no, page_no, CASE WHEN due THEN '{pack.STATUS_HUMAN}' ELSE final_status END AS final_status, CASE WHEN due THEN '{pack.CONFIRM}' ELSE final_result END AS final_result,
  CASE WHEN due THEN coalesce(is_target, true) ELSE is_target END AS is_target, CASE WHEN due THEN pages ELSE array_to_string(evidence_pages, ',') END AS pages, md5(CASE WHEN due THEN texts ELSE array_to_string(evidence_text, '|') END) AS texts_md5,
  CASE WHEN due THEN {ov.strip("reason || chr(10) || told")} ELSE reason END AS reason, CASE WHEN due THEN told ELSE recommendation END AS recommendation,
  CASE WHEN due THEN array_to_string(list_append(warnings, '{vf.GATE_WARNING}'), '|') ELSE array_to_string(warnings, '|') END AS warnings FROM j""")
def manual_attachment_gate(spark, sf):
    done = vf.manual_attachment_gate(inp.finals(spark, sf), inp.pages(spark, sf))
    return done.select(
        "document_id", "item_no", "page_no", "final_status", "final_result", "is_target", tx.join_ints(F.col("evidence_pages")).alias("pages"),
        F.md5(F.array_join("evidence_text", "|")).alias("texts_md5"), "reason", "recommendation", F.array_join("warnings", "|").alias("warnings"),
    )
