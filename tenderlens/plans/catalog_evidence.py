"""Registered queries: evidence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.operators import evidence as ev
from tenderlens.operators import requirements as rq
from tenderlens.plans import catalog_retrieval as cr
from tenderlens.plans import inputs as inp
from tenderlens.plans import oracle_views as ov
from tenderlens.plans.registry import query
from tenderlens.rules import pack
from tenderlens.session import cut_lineage

def body_text():
    return F.col("page_text")

SHOWN = f"coalesce(printed_page_no, TRY_CAST(nullif(regexp_extract(page_text, '(?:^|\\n){ov.WS}*-{ov.WS}*([0-9]{{1,4}}){ov.WS}*-{ov.WS}*$', 1), '') AS INT), page_no)"


@query("loose_match", f"""
WITH {ov.PAGES}, m AS (SELECT document_id, page_no, page_text AS t, regexp_extract(page_text, '{ov.loose('요구 사항')}', 0) AS v FROM page)
SELECT document_id, page_no, v <> '' AS found, CASE WHEN v <> '' THEN (instr(t, v) - 1)::INT END AS start, CASE WHEN v <> '' THEN (instr(t, v) - 1 + length(v))::INT END AS stop FROM m""")
def loose_match(spark, sf):
    parts = F.split(body_text(), tx.loose_regex("요구 사항"), 2)
    found = F.size(parts) == 2
    return inp.pages(spark, sf).select(
        "document_id", "page_no", found.alias("found"), F.when(found, F.length(parts[0])).alias("start"),
        F.when(found, F.length(body_text()) - F.length(parts[1])).alias("stop"),
    )


@query("evidence_window", f"WITH {ov.PAGES} SELECT document_id, page_no, {ov.window('page_text', '하도급', 80)} AS evidence FROM page")
def evidence_window(spark, sf):
    return inp.pages(spark, sf).select("document_id", "page_no", tx.evidence_window(body_text(), "하도급", 80).alias("evidence"))


EXACT = ["하자담보", "하자보수", "책임기간"]


@query("exact_window", f"""
WITH {ov.PAGES} SELECT document_id, page_no, CASE {' '.join(f"WHEN contains(page_text, '{k}') THEN {ov.window('page_text', k, 360, exact=True)}" for k in EXACT)}
  ELSE substr({ov.collapse('page_text')}, 1, 500) END AS evidence FROM page""")
def exact_window(spark, sf):
    return inp.pages(spark, sf).select("document_id", "page_no", tx.exact_window(body_text(), EXACT, 360).alias("evidence"))


KEYS = pack.RULE_KEYWORDS["4"]


@query("keyword_evidence", f"""
WITH {ov.PAGES} SELECT document_id, page_no, {SHOWN} AS display_no, {ov.first_window('page_text', 'lower(c)', KEYS, 80)} AS evidence
FROM page WHERE NOT has_toc AND {ov.any_of('lower(c)', [tx.squeeze(k).lower() for k in KEYS])}""")
def keyword_evidence(spark, sf):
    return ev.keyword_evidence(inp.pages(spark, sf), KEYS).select("document_id", "page_no", "display_no", "evidence")


DETAIL = ["요구사항 고유번호", "요구사항 명칭", "정의", "상세 세부내용", "산출정보"]


@query("count_present", f"WITH {ov.PAGES} SELECT document_id, page_no, {ov.count_of('lower(c)', [tx.squeeze(k) for k in DETAIL])}::INT AS present FROM page")
def count_present(spark, sf):
    return inp.pages(spark, sf).select("document_id", "page_no", tx.loose_count(tx.compact_lower(body_text()), DETAIL).alias("present"))


def has(*terms):
    return ov.all_of("c", terms)


SUBCONTRACT_SQL = {
    "oversight_correction": has("하도급", "관리", "감독", "시정", "요구"),
    "prior_approval": has("하도급", "사전승인"),
    "ratio_limit": f"({has('하도급', '초과할수없')} AND {ov.any_of('c', ['100분의50', '50%'])})",
    "plan_submission": f"({has('하도급', '계획서')} AND {ov.any_of('c', ['제출', '계약체결'])})",
    "approval_criteria": f"({has('하도급', '적정성', '85점')} AND {ov.any_of('c', ['승인', '판단'])})",
    "joint_consortium": f"({has('하도급', '공동수급체')} AND {ov.any_of('c', ['10%', '10퍼센트'])})",
}
OUTPUT = ov.any_of("replace(c, 'S/W', 'SW')", ["SW산출물", "소프트웨어산출물", "계약산출물"])
CONTEXT = f"({OUTPUT} OR {ov.any_of('c', ['SW사업산출물활용보장', '계약목적물', '계약산출물', '지식재산권', '계약상대자', '공급자', '활용승인'])})"
REUSE_SQL = {
    "ip_ownership": f"({ov.any_of('c', ['지식재산권', '계약목적물'])} AND ({ov.any_of('c', ['공동소유', '공동으로소유', '공동귀속'])} OR (contains(c, '공동') AND {ov.any_of('c', ['활용', '소유', '귀속'])}) OR (contains(c, '귀속') AND {ov.any_of('c', ['발주기관', '주관기관', '계약상대자'])})))",
    "export_allowed": f"({OUTPUT} AND contains(c, '반출') AND {ov.any_of('c', ['요청할수', '가능', '제공', '반출할수'])})",
    "export_request": f"({OUTPUT} AND contains(c, '반출') AND {ov.any_of('c', ['요청', '절차', '검토', '통보'])})",
    "secret_removal": f"({CONTEXT} AND contains(c, '누출금지정보') AND {ov.any_of('c', ['삭제하고', '삭제후', '삭제한후', '삭제하여', '삭제해야', '삭제하여야', '제거하고', '제거하여'])})",
    "confirmation_letter": f"({CONTEXT} AND contains(c, '확약서') AND {ov.any_of('c', ['제출', '제시'])} AND ({ov.any_of('c', ['대표명의', '대표자명의'])} OR (contains(c, '공급자') AND {ov.any_of('c', ['명의', '대표'])})))",
    "third_party_approval": f"({CONTEXT} AND contains(c, '제3자') AND {ov.any_of('c', ['사전승인', '사전승낙', '발주기관의승인'])})",
    "bid_restriction": f"({CONTEXT} AND {has('입찰참가자격', '제한')} AND {OUTPUT} AND {ov.any_of('c', ['무단유출', '무단으로유출', '누출되는경우', '누출금지정보를삭제하지', '삭제하지않고활용'])})",
}


def mask_sql(rules):
    return " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(rules.values()))


REUSE_MASKS = f"reuse AS (SELECT document_id, page_no, page_text, printed_page_no, has_toc, c, ({mask_sql(REUSE_SQL)})::INT AS mask FROM page)"


@query("term_rules", f"""
WITH {ov.PAGES} SELECT document_id, page_no, ({mask_sql(SUBCONTRACT_SQL)})::INT AS subcontract_mask, ({mask_sql(REUSE_SQL)})::INT AS reuse_mask FROM page""")
def term_rules(spark, sf):
    p = inp.pages(spark, sf).select("document_id", "page_no", tx.compact(body_text()).alias("c"))
    return p.select(
        "document_id", "page_no", ev.requirement_mask(rq.subcontract_requirements(F.col("c"))).alias("subcontract_mask"),
        ev.requirement_mask(rq.reuse_requirements(F.col("c"))).alias("reuse_mask"),
    )


def reuse_masks(spark, sf):
    p = inp.pages(spark, sf).filter("not has_toc").withColumn("c", tx.compact(body_text()))
    return p.select("document_id", "page_no", "seq", "c", ev.requirement_mask(rq.reuse_requirements(F.col("c"))).alias("mask")).filter("mask <> 0")


@query("document_coverage", f"""
WITH {ov.PAGES}, {REUSE_MASKS} SELECT document_id, bit_or(mask) AS mask, bit_or(mask) = 127 AS complete FROM reuse WHERE NOT has_toc AND mask <> 0 GROUP BY 1""")
def document_coverage(spark, sf):
    return ev.document_coverage(reuse_masks(spark, sf).select("document_id", "mask"), ev.full_mask(7))


@query("greedy_cover", f"""
WITH RECURSIVE {ov.PAGES}, {REUSE_MASKS},
cand AS (SELECT document_id, page_no, mask & 127 AS mask, row_number() OVER (PARTITION BY document_id ORDER BY bit_count(mask & 127) DESC, page_no) AS k
  FROM reuse WHERE NOT has_toc AND mask & 127 <> 0),
walk AS (
  SELECT document_id, 0::BIGINT AS k, 0 AS covered, []::INT[] AS kept FROM (SELECT DISTINCT document_id FROM cand)
  UNION ALL
  SELECT w.document_id, c.k, CASE WHEN w.covered <> 127 AND (c.mask & ~w.covered) <> 0 THEN w.covered | c.mask ELSE w.covered END,
    CASE WHEN w.covered <> 127 AND (c.mask & ~w.covered) <> 0 THEN list_append(w.kept, c.page_no) ELSE w.kept END
  FROM walk w JOIN cand c ON c.document_id = w.document_id AND c.k = w.k + 1)
SELECT document_id, array_to_string(kept, ',') AS pages FROM walk WHERE covered = 127 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY k DESC) = 1""")
def greedy_cover(spark, sf):
    masks = reuse_masks(spark, sf).withColumn("mask", F.col("mask").bitwiseAND(127)).filter("mask <> 0")
    masks = masks.withColumn("fewer", -F.bit_count("mask")).withColumn("at", F.col("page_no")).withColumn("tie", F.col("seq")).drop("c")
    cover = ev.greedy_cover(masks, 127, ["fewer", "at", "tie"])
    listed = cover.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("step", "page_no"))).alias("s"))
    return listed.select("document_id", F.array_join(F.transform("s", lambda s: s["page_no"].cast("string")), ",").alias("pages"))


TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({t}), '[0-9A-Za-z가-힣]{{2,}}'), lambda t: NOT list_contains({s}, t)))"
OVERLAP_HITS = f"""crit AS (SELECT query_item, rank_group, rank, unnest(ts) AS token, len(ts) AS size FROM (
    SELECT query_item, rank_group, rank, {TOKENS.format(t="concat_ws(' ', nullif(title, ''), nullif(snippet, ''))", s=ov.sql_list(pack.OVERLAP_STOPWORDS))} AS ts,
      len(list_filter(regexp_extract_all(lower(concat_ws(' ', title, snippet)), '[0-9A-Za-z가-힣]{{2,}}'), lambda t: NOT list_contains({ov.sql_list(pack.OVERLAP_STOPWORDS)}, t))) AS n FROM hit) WHERE n >= 3),
word AS (SELECT document_id, page_no, unnest({TOKENS.format(t='page_text', s=ov.sql_list(pack.OVERLAP_STOPWORDS))}) AS token FROM page WHERE NOT has_toc),
pair AS (SELECT document_id, page_no, query_item, rank_group, rank, count(*) / any_value(size)::DOUBLE AS coverage, min(token) AS keyword FROM word JOIN crit USING (token) GROUP BY ALL),
best AS MATERIALIZED (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY document_id, query_item ORDER BY coverage DESC, rank_group, rank, page_no) = 1)"""


def requirement_hits(spark, sf):
    """Each requirement as a criterion of its item, so that embedded passages are found."""
    r = inp.legal_requirements(spark, sf)
    return r.select(
        F.col("item_no").alias("query_item"), F.lit(1).alias("rank_group"), F.col("row_id").cast("int").alias("rank"),
        F.coalesce("category", F.lit("")).alias("title"), F.col("category"), F.col("requirement_text").alias("snippet"),
    )


REQUIREMENT_HIT = "hit AS (SELECT item_no AS query_item, 1 AS rank_group, row_id::INT AS rank, coalesce(category, '') AS title, category, requirement_text AS snippet FROM legal_requirement)"


@query("criteria_overlap", f"""
WITH {ov.PAGES}, {ov.LEGAL_REQUIREMENTS}, {REQUIREMENT_HIT}, {OVERLAP_HITS}
SELECT document_id, query_item AS item_no, round(coverage, 6) AS coverage, page_no, keyword FROM best""")
def criteria_overlap(spark, sf):
    best = ev.criteria_overlap(inp.pages(spark, sf), requirement_hits(spark, sf))
    return best.select("document_id", "item_no", F.round("coverage", 6).alias("coverage"), "page_no", "keyword")


@query("overlap_evidence", f"""
WITH {ov.PAGES}, {ov.LEGAL_REQUIREMENTS}, {REQUIREMENT_HIT}, {OVERLAP_HITS}, accepted AS (
  SELECT b.document_id, query_item, coverage, {SHOWN.replace('page_no', 'p.page_no').replace('printed_p.page_no', 'p.printed_page_no')} AS display_no, page_text AS t, instr(lower(page_text), keyword) - 1 AS at0, length(keyword) AS w
  FROM best b JOIN page p ON p.document_id = b.document_id AND p.page_no = b.page_no WHERE coverage >= 0.7)
SELECT document_id, query_item AS item_no, round(coverage, 6) AS coverage, display_no,
  {ov.collapse('substr(t, greatest(at0 - 80, 0) + 1, least(at0 + w + 80, length(t)) - greatest(at0 - 80, 0))')} AS evidence FROM accepted""")
def overlap_evidence(spark, sf):
    p = cut_lineage(inp.pages(spark, sf))
    found = ev.overlap_evidence(ev.accepted_overlap(cut_lineage(ev.page_words(p)), requirement_hits(spark, sf)), p)
    return found.withColumn("coverage", F.round("coverage", 6))


AMOUNT_SPANS = ov.spans("page", "page_text", ov.AMOUNT, "document_id, page_no, seq, printed_page_no, has_toc", "span")


@query("match_spans", f"WITH {ov.PAGES}, {AMOUNT_SPANS} SELECT document_id, page_no, k, start::INT AS start, (start + length(value))::INT AS stop, value FROM span")
def match_spans(spark, sf):
    s = inp.pages(spark, sf).select("document_id", "page_no", F.posexplode(tx.match_spans(body_text(), tx.AMOUNT_REGEX)).alias("k", "s"))
    return s.select("document_id", "page_no", (F.col("k") + 1).alias("k"), "s.start", "s.stop", "s.value")


CTX = "substr(t, greatest(start - 90, 0) + 1, least(start + length(value) + 90, length(t)) - greatest(start - 90, 0))"
AMOUNTS = f"""{AMOUNT_SPANS},
budget AS (SELECT document_id, page_no, coalesce(nullif(printed_page_no, 0), page_no) AS amount_page, start, trim(value) AS raw_text, {ov.amount('value')} AS amount_won, {ov.collapse(CTX)} AS context, {ov.compact(CTX)} AS cc
  FROM span WHERE NOT has_toc),
amount AS MATERIALIZED (SELECT document_id, amount_page, amount_won, raw_text, context FROM budget WHERE {ov.any_of('cc', pack.BUDGET_TERMS)} AND NOT {ov.any_of('cc', pack.BUDGET_NEGATIVE_TERMS)}
  QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY amount_won DESC, page_no, start) = 1)"""


@query("project_amount", f"WITH {ov.PAGES}, {AMOUNTS} SELECT * FROM amount")
def project_amount(spark, sf):
    return ev.project_amount(inp.pages(spark, sf))


WON = "['', '원', '만원', '백만원', '천만 원', '억', '억원'][(l_linenumber + l_partkey) % 7 + 1]"


@query("parse_amount", f"""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey || ',' || lpad((l_suppkey % 1000)::VARCHAR, 3, '0') ELSE l_quantity::INT || '.5' END || {WON} AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber, raw, {ov.amount('raw')} AS amount_won, CASE WHEN {ov.amount('raw')} % 100000000 = 0 THEN ({ov.amount('raw')} // 100000000)::VARCHAR
  ELSE regexp_replace(printf('%.1f', {ov.amount('raw')} / 100000000.0::DOUBLE), '\\.?0+$', '') END || '억 원' AS shown FROM v""")
def parse_amount(spark, sf):
    li = inp.read(spark, sf, "lineitem")
    units = F.array(*[F.lit(u) for u in ["", "원", "만원", "백만원", "천만 원", "억", "억원"]])
    raw = F.concat(
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.col("l_partkey").cast("string"), F.lit(","), F.lpad((F.col("l_suppkey") % 1000).cast("string"), 3, "0")))
        .otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".5"))),
        F.element_at(units, ((F.col("l_linenumber") + F.col("l_partkey")) % 7 + 1).cast("int")),
    )
    v = li.select("l_orderkey", "l_linenumber", raw.alias("raw")).withColumn("amount_won", tx.parse_amount(F.col("raw")))
    return v.withColumn("shown", tx.format_amount(F.col("amount_won")))


NEAR = ["상용SW", "상용소프트웨어", "직접구매", "분리발주"]
NEAR_CTX = "substr(t, greatest(start - 80, 0) + 1, least(start + length(value) + 80, length(t)) - greatest(start - 80, 0))"


@query("amount_near_terms", f"""
WITH {ov.PAGES}, {AMOUNT_SPANS}, near AS (SELECT document_id, page_no, max({ov.amount('value')}) AS amount_won FROM span WHERE {ov.any_of(NEAR_CTX, NEAR)} GROUP BY ALL)
SELECT document_id, page_no, coalesce(amount_won, 0) AS amount_won FROM page LEFT JOIN near USING (document_id, page_no)""")
def amount_near_terms(spark, sf):
    return inp.pages(spark, sf).select("document_id", "page_no", tx.max_amount_near(body_text(), NEAR).alias("amount_won"))


@query("max_score", f"""
WITH {ov.PAGES} SELECT document_id, page_no,
  coalesce(list_max(list_transform(list_concat(regexp_extract_all(page_text, '([0-9]+(?:\\.[0-9]+)?){ov.WS}*점', 1), regexp_extract_all(page_text, '([0-9]+(?:\\.[0-9]+)?){ov.WS}*$', 1)), lambda v: v::DOUBLE)), 0.0)::DOUBLE AS best,
  CASE WHEN contains(c, '하도급') AND contains(c, '계획') AND contains(c, '적정성') THEN true ELSE false END AS names_plan FROM page""")
def max_score(spark, sf):
    return inp.pages(spark, sf).select(
        "document_id", "page_no", tx.max_score(body_text()).alias("best"), tx.contains_all(tx.compact(body_text()), ["하도급", "계획", "적정성"]).alias("names_plan")
    )


def score_sql(c):
    number = "([0-9]+(?:\\.[0-9]+)?)"
    found = f"list_concat(regexp_extract_all({c}, '{number}{ov.WS}*점', 1), regexp_extract_all({c}, '{number}{ov.WS}*$', 1))"
    return f"coalesce(list_max(list_transform({found}, lambda v: v::DOUBLE)), 0.0)"


PLAN_CTX = "substr(t, greatest(start - 40, 0) + 1, least(start + length(value) + 80, length(t)) - greatest(start - 40, 0))"


@query("plan_score", f"""
WITH {ov.PAGES}, named AS (SELECT document_id, page_no, c, page_text FROM page WHERE {ov.all_of('c', ['하도급', '계획', '적정성'])}), {ov.spans('named', 'c', '하도급', 'document_id, page_no', 'span')},
scored AS (SELECT document_id, page_no FROM named WHERE {score_sql('page_text')} >= 5
  UNION SELECT document_id, page_no FROM (SELECT document_id, page_no, {PLAN_CTX} AS w FROM span) WHERE {ov.all_of('w', ['계획', '적정성'])} AND {score_sql('w')} >= 5)
SELECT document_id, page_no, s.page_no IS NOT NULL AS has_plan_score FROM page LEFT JOIN (SELECT document_id, page_no FROM scored) s USING (document_id, page_no)""")
def plan_score(spark, sf):
    return inp.pages(spark, sf).select("document_id", "page_no", ev.subcontract_plan_score(body_text(), tx.compact_lower(body_text())).alias("has_plan_score"))


DIRECT = f"""top AS (SELECT *, row_number() OVER (PARTITION BY query_item ORDER BY rank_group, rank) AS k FROM hit QUALIFY k <= 5),
term AS MATERIALIZED (SELECT DISTINCT query_item AS item_no, t AS term FROM (SELECT query_item, unnest(regexp_extract_all(concat_ws(' ', title, CASE WHEN contains(snippet, '[REQUIRED_CRITERIA]')
    THEN substr(snippet, instr(snippet, '[REQUIRED_CRITERIA]') + 19) ELSE snippet END), '[0-9A-Za-z가-힣]{{2,}}')) AS t FROM top) WHERE NOT list_contains({ov.sql_list(pack.DIRECT_STOPWORDS)}, t))"""


@query("direct_requirement_signal", f"""
WITH {ov.PAGES}, {ov.LEGAL_REQUIREMENTS}, {REQUIREMENT_HIT}, {DIRECT}
SELECT document_id, page_no, item_no, count(*) AS hits FROM page JOIN term ON contains(page_text, term) GROUP BY ALL HAVING count(*) >= 2""")
def direct_requirement_signal(spark, sf):
    return ev.direct_requirement_signal(cut_lineage(inp.pages(spark, sf)), ev.direct_terms(requirement_hits(spark, sf))).select("document_id", "page_no", "item_no", "hits")


CODES = "len(list_distinct(regexp_extract_all(low, '[a-z]{2,5}-[0-9]{3}'))) >= 3"
NON_SUBSTANTIVE = f"""(low = '' OR (contains(low, '요구사항총괄표') AND {ov.any_of('low', ['목록', '리스트', '일람'])}) OR ({CODES} AND {ov.any_of('low', ['요구사항', '분류', '고유번호'])})
  OR (length({ov.collapse('txt')}) <= 80 AND regexp_matches(low, '^(별첨|별지|붙임)') AND NOT {ov.any_of('low', ['작성하여첨부', '제출하여야', '명시하여야', '하여야함', '○', '□'])})
  OR {ov.any_of('low', ['빈서식', '빈양식', '작성서식', '작성양식'])} OR ({ov.any_of('low', ['서식', '양식'])} AND NOT {ov.any_of('low', ['명시', '제출', '첨부', '작성하여첨부', '평가', '계약', '보안', '하자', '산출물'])}))"""
CONTEXT_ONLY = f"({NON_SUBSTANTIVE} OR ({ov.any_of('low', pack.WORDING_CONTEXT_TERMS)} AND NOT {ov.any_of('low', pack.WORDING_DIRECT_TERMS)}))"


@query("target_only_text", f"""
WITH {ov.PAGES}, v AS (SELECT document_id, page_no, c, lower(c) AS low, page_text AS txt FROM page)
SELECT document_id, page_no, {ov.any_of('c', pack.TARGET_MARKERS)} AND NOT {ov.any_of('c', pack.DIRECT_MARKERS)} AS target_only, {CONTEXT_ONLY} AS context_only FROM v""")
def target_only_text(spark, sf):
    return inp.pages(spark, sf).select("document_id", "page_no", ev.target_only(tx.compact(body_text())).alias("target_only"), ev.context_only(body_text()).alias("context_only"))


def quotes(page):
    """Quotes from the middle of pages, some altered after the first hundred characters, some too short."""
    n = F.col("text_length")
    body = F.expr("substring(page_text, floor(length(page_text) / 3) + 1, 260)")
    altered = F.concat(F.expr("substring(page_text, floor(length(page_text) / 3) + 1, 140)"), F.lit(" changed ending of the quote"))
    return page.select(
        "document_id", F.col("page_no").cast("string").alias("quote_id"), F.when(n % 3 == 0, altered).otherwise(body).alias("quote")
    )


@query("locate_evidence", f"""
WITH {ov.PAGES}, q AS (SELECT document_id, page_no::VARCHAR AS quote_id, {ov.compact("CASE WHEN text_length % 3 = 0 THEN substr(page_text, (length(page_text) // 3 + 1)::BIGINT, 140) || ' changed ending of the quote' ELSE substr(page_text, (length(page_text) // 3 + 1)::BIGINT, 260) END")} AS q FROM page),
long AS (SELECT *, CASE WHEN length(q) > 80 THEN list_transform(range(0, least(8, ceil((length(q) - 80) / 80.0)::INT)), lambda i: substr(q, (i * 80 + 1)::BIGINT, 80)) ELSE []::VARCHAR[] END AS chunks FROM q WHERE length(q) >= 20),
met AS (SELECT l.document_id, quote_id, p.page_no, contains(p.c, substr(q, 1, 180)) AS whole, len(list_filter(chunks, lambda x: contains(p.c, x))) AS score FROM long l JOIN page p ON p.document_id = l.document_id)
SELECT document_id, quote_id, page_no FROM met WHERE whole OR score > 0
QUALIFY row_number() OVER (PARTITION BY document_id, quote_id ORDER BY whole DESC, CASE WHEN whole THEN 0 ELSE -score END, page_no) = 1""")
def locate_evidence(spark, sf):
    page = cut_lineage(inp.pages(spark, sf))
    return ev.locate_evidence(quotes(page), page).select("document_id", "quote_id", "page_no")


KEY = ["document_id", "item_no", "page_no"]


def cited_reviews(spark, sf):
    """(reviews, pages): the page table is derived once, all readings start from it."""
    page = cut_lineage(inp.pages(spark, sf))
    return inp.finals(spark, sf, page).withColumnRenamed("final_result", "result"), page


PRINTED = f"printed AS (SELECT document_id, page_no, coalesce(printed_page_no, TRY_CAST(nullif(regexp_extract(page_text, '(?:^|\\n){ov.WS}*-{ov.WS}*([0-9]{{1,4}}){ov.WS}*-{ov.WS}*$', 1), '') AS INT)) AS printed FROM page)"


@query("normalize_cited_pages", f"""
WITH {ov.FINALS}, {PRINTED}, pair AS (SELECT document_id, item_no, page_no, unnest(range(0, len(evidence_pages))) AS pos, unnest(evidence_pages) AS cited FROM final),
settled AS (SELECT r.document_id, r.item_no, r.page_no, pos, CASE WHEN EXISTS (SELECT 1 FROM printed k WHERE k.document_id = r.document_id AND k.printed = r.cited) THEN r.cited ELSE coalesce(i.printed, r.cited) END AS no
  FROM pair r LEFT JOIN printed i ON i.document_id = r.document_id AND i.page_no = r.cited)
SELECT f.document_id, f.item_no, f.page_no, coalesce(string_agg(no, ',' ORDER BY pos), '') AS pages FROM final f LEFT JOIN settled s ON s.document_id = f.document_id AND s.item_no = f.item_no AND s.page_no = f.page_no GROUP BY ALL""")
def normalize_cited_pages(spark, sf):
    done = ev.normalize_evidence_pages(*cited_reviews(spark, sf), KEY, locate=False)
    return done.select(*KEY, tx.join_ints(F.col("evidence_pages")).alias("pages"))


LOCATED = f"""quote AS (SELECT document_id, item_no, page_no, pos, {ov.compact('txt')} AS q FROM (SELECT document_id, item_no, page_no, unnest(range(0, len(evidence_text))) AS pos, unnest(evidence_text) AS txt FROM final)),
long AS (SELECT *, CASE WHEN length(q) > 80 THEN list_transform(range(0, least(8, ceil((length(q) - 80) / 80.0)::INT)), lambda i: substr(q, (i * 80 + 1)::BIGINT, 80)) ELSE []::VARCHAR[] END AS chunks FROM quote WHERE length(q) >= 20),
met AS (SELECT l.document_id, l.item_no, l.page_no, pos, p.page_no AS found, contains(p.c, substr(q, 1, 180)) AS whole, len(list_filter(chunks, lambda x: contains(p.c, x))) AS score FROM long l JOIN page p ON p.document_id = l.document_id),
located AS (SELECT m.document_id, item_no, m.page_no, pos, printed FROM met m JOIN printed k ON k.document_id = m.document_id AND k.page_no = found WHERE whole OR score > 0
  QUALIFY row_number() OVER (PARTITION BY m.document_id, item_no, m.page_no, pos ORDER BY whole DESC, CASE WHEN whole THEN 0 ELSE -score END, found) = 1)"""


@query("normalize_evidence_pages", f"""
WITH {ov.FINALS}, {PRINTED}, {LOCATED}, pair AS (SELECT document_id, item_no, page_no, unnest(range(0, len(evidence_pages))) AS pos, unnest(evidence_pages) AS cited FROM final),
settled AS (SELECT r.document_id, r.item_no, r.page_no, r.pos, coalesce(l.printed, CASE WHEN EXISTS (SELECT 1 FROM printed k WHERE k.document_id = r.document_id AND k.printed = r.cited) THEN r.cited ELSE coalesce(i.printed, r.cited) END) AS no
  FROM pair r LEFT JOIN located l ON l.document_id = r.document_id AND l.item_no = r.item_no AND l.page_no = r.page_no AND l.pos = r.pos LEFT JOIN printed i ON i.document_id = r.document_id AND i.page_no = r.cited)
SELECT f.document_id, f.item_no, f.page_no, coalesce(string_agg(no, ',' ORDER BY pos), '') AS pages FROM final f LEFT JOIN settled s ON s.document_id = f.document_id AND s.item_no = f.item_no AND s.page_no = f.page_no GROUP BY ALL""")
def normalize_evidence_pages(spark, sf):
    done = ev.normalize_evidence_pages(*cited_reviews(spark, sf), KEY)
    return done.select(*KEY, tx.join_ints(F.col("evidence_pages")).alias("pages"))


@query("distinct_evidence_pages", f"""
WITH {ov.FINALS}, {PRINTED}, {LOCATED}, pair AS (SELECT document_id, item_no, page_no, unnest(range(0, len(evidence_pages))) AS pos, unnest(evidence_pages) AS cited FROM final),
place AS (SELECT document_id, item_no, page_no, 0 AS src, pos, printed AS no FROM located WHERE printed IS NOT NULL
  UNION ALL SELECT r.document_id, r.item_no, r.page_no, 1, r.pos, CASE WHEN EXISTS (SELECT 1 FROM printed k WHERE k.document_id = r.document_id AND k.printed = r.cited) THEN r.cited ELSE coalesce(i.printed, r.cited) END
  FROM pair r LEFT JOIN printed i ON i.document_id = r.document_id AND i.page_no = r.cited),
once AS (SELECT document_id, item_no, page_no, no, min(src * 1000000 + pos) AS ord FROM place GROUP BY ALL)
SELECT f.document_id, f.item_no, f.page_no, coalesce(string_agg(no, ',' ORDER BY ord), '') AS pages FROM final f LEFT JOIN once o ON o.document_id = f.document_id AND o.item_no = f.item_no AND o.page_no = f.page_no GROUP BY ALL""")
def distinct_evidence_pages(spark, sf):
    done = ev.distinct_evidence_pages(*cited_reviews(spark, sf), KEY)
    return done.select(*KEY, tx.join_ints(F.col("evidence_pages")).alias("pages"))


@query("drop_toc_evidence", f"""
WITH {ov.FINALS}, {PRINTED}, toc AS (SELECT document_id, page_no AS n FROM page WHERE has_toc UNION SELECT document_id, printed FROM printed JOIN page USING (document_id, page_no) WHERE has_toc AND printed IS NOT NULL),
pair AS (SELECT document_id, item_no, page_no, final_result, unnest(range(0, len(evidence_pages))) AS pos, unnest(evidence_pages) AS cited, unnest(evidence_text) AS txt FROM final),
kept AS (SELECT * FROM pair p WHERE trim(final_result) = '해당없음' OR NOT EXISTS (SELECT 1 FROM toc t WHERE t.document_id = p.document_id AND t.n = p.cited))
SELECT f.document_id, f.item_no, f.page_no, coalesce(string_agg(cited, ',' ORDER BY pos), '') AS pages, md5(coalesce(string_agg(txt, '|' ORDER BY pos), '')) AS text_md5
FROM final f LEFT JOIN kept k ON k.document_id = f.document_id AND k.item_no = f.item_no AND k.page_no = f.page_no GROUP BY ALL""")
def drop_toc_evidence(spark, sf):
    done = ev.drop_toc_evidence(*cited_reviews(spark, sf), KEY)
    return done.select(*KEY, tx.join_ints(F.col("evidence_pages")).alias("pages"), F.md5(F.array_join("evidence_text", "|")).alias("text_md5"))


def pts(cond, n):
    return f"CASE WHEN {cond} THEN {n} ELSE 0 END"


T = "page_text"
SPECIAL = {
    "11": pts(f"contains({T}, '기술능력평가') AND {ov.any_of(T, ['가격평가', '입찰가격평가'])} AND {ov.any_of(T, ['90점', '90%'])} AND {ov.any_of(T, ['10점', '10%'])}", 50),
    "12": " + ".join([pts(f"contains({T}, '차등점수제') OR {ov.all_of(T, ['순위간', '점수차'])}", 50), pts(f"contains({T}, '평가항목') AND {ov.any_of(T, ['배점', '배점한도'])}", 35),
                      pts(f"contains({T}, '소프트웨어기술성평가기준') OR {ov.all_of(T, ['하자보수', '비상 대책'])}", 30)]),
    "13": " + ".join([pts(ov.any_of(T, ["제안서 보상", "보상대상"]), 60), pts(ov.any_of(T, ["20억원", "20억"]), 35), pts(ov.any_of(T, ["사업 예산", "사업예산", "총사업금액"]), 25), pts(ov.all_of(T, ["소프트웨어 진흥법", "제52조"]), 30)]),
    "14": pts(f"contains({T}, '요구사항 총괄표')", 30) + " + " + pts(f"{ov.count_of(T, ev.DETAIL_TERMS)} >= 4", 15),
    "15": pts(ov.all_of("c", ["소프트웨어개발사업", "적정사업기간", "종합산정서"]), 60),
    "16": " + ".join(pts(f"contains({T}, '{x}')", 12) for x in ev.WORKFORCE_TERMS) + " + " + pts(ov.any_of(T, ["기능점수", "FP", "서비스수준협약"]), 35) + " + " + pts(ov.any_of(T, ev.WORKFORCE_STRONG), 45)
    + " - " + pts(f"{ov.any_of(T, ev.WORKFORCE_OFF)} AND NOT {ov.any_of(T, ev.WORKFORCE_KEEP)}", 60),
    "17": pts(ov.any_of("c", ["소프트웨어사업영향평가검토결과서", "소프트웨어사업영향평가결과서"]), 60),
}


def term_sql(stop):
    f = f"list_filter(regexp_extract_all(lower({{}}), '[0-9A-Za-z가-힣]{{{{2,}}}}'), lambda t: NOT list_contains({ov.sql_list(stop)}, t))[1:12]" if stop else "list_transform(regexp_extract_all({}, '[0-9A-Za-z가-힣]{{2,}}')[1:12], lambda t: lower(t))"
    one = lambda c: f.format(c).replace("{{", "{").replace("}}", "}")
    return f"""top AS (SELECT *, row_number() OVER (PARTITION BY query_item ORDER BY rank_group, rank) AS k FROM hit QUALIFY k <= 5),
term AS MATERIALIZED (SELECT DISTINCT query_item AS item_no, unnest(list_concat({one('title')}, coalesce({one('category')}, []), {one('snippet')})) AS term FROM top
  UNION SELECT query_item, query_item FROM hit)"""


ITEMS = "item AS (SELECT DISTINCT item_no FROM legal_requirement)"
RANKED = f"""{term_sql(pack.RANK_STOPWORDS)}, {ITEMS},
by_term AS (SELECT document_id, page_no, item_no, count(*) AS n FROM page JOIN term ON contains(lower(page_text), term) GROUP BY ALL),
special AS (SELECT document_id, page_no, k AS item_no, CASE WHEN has_toc THEN 0 ELSE v END AS v FROM (
  SELECT document_id, page_no, has_toc, unnest({ov.sql_list(SPECIAL)}) AS k, unnest([{', '.join(SPECIAL.values())}]) AS v FROM page)),
scored AS (SELECT p.document_id, p.page_no, i.item_no, coalesce(n, 0) + coalesce(v, 0) + CASE WHEN contains(lower(page_text), i.item_no) THEN 3 ELSE 0 END - CASE WHEN parser_warning IS NOT NULL THEN 1 ELSE 0 END AS score
  FROM page p, item i LEFT JOIN by_term b ON b.document_id = p.document_id AND b.page_no = p.page_no AND b.item_no = i.item_no
  LEFT JOIN special s ON s.document_id = p.document_id AND s.page_no = p.page_no AND s.item_no = i.item_no),
best AS (SELECT document_id, item_no, page_no, score::BIGINT AS score, row_number() OVER (PARTITION BY document_id, item_no ORDER BY score DESC, page_no) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 10)
SELECT document_id, item_no, rank::INT AS rank, page_no, score FROM best
UNION ALL SELECT document_id, item_no, rank::INT, page_no, 0 FROM (SELECT document_id, page_no, row_number() OVER (PARTITION BY document_id ORDER BY page_no) AS rank FROM page QUALIFY rank <= 10) f, item
  WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.document_id = f.document_id AND b.item_no = item.item_no)"""


@query("rank_evidence_pages", f"WITH {ov.PAGES}, {ov.LEGAL_REQUIREMENTS}, {REQUIREMENT_HIT}, {RANKED}")
def rank_evidence_pages(spark, sf):
    items = inp.legal_requirements(spark, sf).select("item_no").distinct()
    return ev.rank_evidence_pages(cut_lineage(inp.pages(spark, sf)), items, cut_lineage(requirement_hits(spark, sf))).select("document_id", "item_no", "rank", "page_no", "score")


@query("select_prompt_pages", f"""
WITH {ov.PAGES}, {ov.LEGAL_REQUIREMENTS}, {REQUIREMENT_HIT}, {term_sql([])}, {ITEMS},
sized_doc AS (SELECT document_id, count(*) AS n_pages FROM page GROUP BY 1),
big AS (SELECT page.*, lower(page_text) AS low FROM page JOIN sized_doc USING (document_id) WHERE n_pages > 12),
by_term AS (SELECT document_id, page_no, item_no, count(*) AS n FROM big JOIN term ON contains(low, term) GROUP BY ALL),
scored AS (SELECT p.document_id, p.page_no, i.item_no, coalesce(n, 0) - CASE WHEN has_toc THEN 2 ELSE 0 END - CASE WHEN parser_warning IS NOT NULL THEN 1 ELSE 0 END
    + CASE WHEN i.item_no IN ('11', '12') AND (has_eval_table OR has_table) THEN 8 WHEN i.item_no IN ('2', '2-1', '15', '17') AND (has_attachment OR has_blind OR has_commercial_sw) THEN 8 ELSE 0 END AS score
  FROM big p, item i LEFT JOIN by_term b ON b.document_id = p.document_id AND b.page_no = p.page_no AND b.item_no = i.item_no),
best AS (SELECT document_id, item_no, page_no, score::BIGINT AS score, row_number() OVER (PARTITION BY document_id, item_no ORDER BY score DESC, page_no) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 12)
SELECT document_id, item_no, rank::INT AS rank, page_no, score FROM best
UNION ALL SELECT document_id, item_no, rank::INT, page_no, 0 FROM (SELECT document_id, page_no, row_number() OVER (PARTITION BY document_id ORDER BY page_no) AS rank FROM page QUALIFY rank <= 12) f, item
  WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.document_id = f.document_id AND b.item_no = item.item_no)""")
def select_prompt_pages(spark, sf):
    items = inp.legal_requirements(spark, sf).select("item_no").distinct()
    return ev.select_prompt_pages(cut_lineage(inp.pages(spark, sf)), items, cut_lineage(requirement_hits(spark, sf))).select("document_id", "item_no", "rank", "page_no", "score")


NEG = " OR ".join(f"regexp_matches(page_text, '(?s)직접구매.{{0,{pack.NEGATION_REACH - len(n)}}}{n}')" for n in pack.NEGATIONS)
SIGNAL = f"(NOT {ov.any_of('c', pack.NO_PURCHASE_PHRASES)} AND {ov.any_of('c', pack.COMMERCIAL_SW)} AND {ov.any_of('c', pack.PURCHASE_SIGNALS)} AND NOT {ov.any_of('c', pack.NO_PURCHASE_MARKS)})"


@query("negated_mention", f"WITH {ov.PAGES} SELECT document_id, page_no, {NEG} AS negated, {SIGNAL} AS purchase_signal FROM page")
def negated_mention(spark, sf):
    return inp.pages(spark, sf).select(
        "document_id", "page_no", ev.negated_near(body_text(), "직접구매", pack.NEGATIONS, pack.NEGATION_REACH).alias("negated"), ev.page_purchase_signal(tx.compact(body_text())).alias("purchase_signal")
    )


BROKEN = "replace(replace(page_text, '. ', '.' || chr(10)), ', ', chr(10))"


def broken_pages(spark, sf):
    """Pages set in short lines, as attachment forms are."""
    return inp.pages(spark, sf).withColumn("page_text", F.replace(F.replace(body_text(), F.lit(". "), F.lit(".\n")), F.lit(", "), F.lit("\n")))


BARE_CLASS = f"(?:{ov.WS}|[:：,，.ㆍ·_/()\\[\\]{{}}<>「」『』-])+"


def bare(c):
    return f"regexp_replace({c}, '{BARE_CLASS}', '', 'g')"


def body_sql(t, hint):
    line_bare = bare("x")
    return f"""array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: {ov.strip('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '^(\\[붙임|【붙임|-)')
    AND NOT contains(x, {hint}) AND NOT {ov.all_of('x', ['영향평가', '결과서'])} AND NOT {ov.all_of('x', ['적정 사업기간', '산정서'])}
    AND NOT ({line_bare} = '' OR list_contains({ov.sql_list(pack.LABEL_TERMS)}, {line_bare}) OR (length({line_bare}) <= 24 AND regexp_matches({line_bare}, '(?:{'|'.join(pack.LABEL_TERMS)})$')))
    AND NOT {ov.any_of(line_bare, pack.INSTRUCTION_TERMS)}), ' ')"""


def has_body_sql(body, t):
    return f"(NOT {ov.any_of(bare(t), pack.MISSING_SIGNALS)} AND length({body}) >= 80 AND {ov.count_of(bare(body), pack.SUBSTANCE_SIGNALS)} >= 2)"


@query("attachment_has_body", f"""
WITH {ov.PAGES}, lined AS (SELECT document_id, page_no, {BROKEN} AS t FROM page), bodied AS (SELECT *, {body_sql('t', ov.quote('소프트웨어사업 영향평가'))} AS body FROM lined)
SELECT document_id, page_no, md5(body) AS body_md5, {has_body_sql('body', 't')} AS has_body FROM bodied""")
def attachment_has_body(spark, sf):
    hint = F.lit("소프트웨어사업 영향평가")
    return broken_pages(spark, sf).select(
        "document_id", "page_no", F.md5(ev.attachment_body(body_text(), hint)).alias("body_md5"), ev.attachment_has_body(body_text(), hint).alias("has_body")
    )


REFERENCE = f"({{names}} AND {{signals}} AND {ov.count_of('b', pack.REFERENCE_BODY_SIGNALS)} < 3)"


def reference_sql(b, hint=None):
    names = f"contains({b}, {ov.quote(hint)})" if hint else "true"
    return f"({names} AND {ov.any_of(b, pack.REFERENCE_SIGNALS)} AND {ov.count_of(b, pack.REFERENCE_BODY_SIGNALS)} < 3)"


@query("reference_only", f"""
WITH {ov.PAGES}, v AS (SELECT document_id, page_no, {bare('page_text')} AS b FROM page)
SELECT document_id, page_no, {reference_sql('b')} AS any_reference, {reference_sql('b', '소프트웨어사업영향평가')} AS impact_reference FROM v""")
def reference_only(spark, sf):
    b = tx.compact_attachment(body_text())
    return inp.pages(spark, sf).select("document_id", "page_no", ev.reference_only(b).alias("any_reference"), ev.reference_only(b, "소프트웨어사업 영향평가").alias("impact_reference"))


HINTS = pack.ATTACHMENT_TITLE_HINTS["17"]
HINT_SQL = "CASE " + " ".join(f"WHEN contains({ov.compact('t')}, '{tx.squeeze(h)}') THEN {ov.quote(h)}" for h in HINTS) + " END"
TITLED = f"""lined AS (SELECT document_id, page_no, seq, printed_page_no, {BROKEN} AS page_text, {BROKEN} AS t FROM page WHERE NOT has_toc),
titled AS (SELECT *, {HINT_SQL} AS hint FROM lined WHERE {ov.any_of(ov.compact('t'), [tx.squeeze(h) for h in HINTS])}),
bodied AS (SELECT *, {body_sql('t', 'hint')} AS body FROM titled), judged AS (SELECT *, {has_body_sql('body', 't')} AS has_body FROM bodied)"""


@query("attachment_titles", f"""
WITH {ov.PAGES}, {TITLED}
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_no)::INT AS rank, page_no, {SHOWN} AS display_no, substr(page_text, 1, 260) AS evidence
FROM judged j WHERE NOT EXISTS (SELECT 1 FROM judged k WHERE k.document_id = j.document_id AND k.has_body) QUALIFY rank <= 3""")
def attachment_titles(spark, sf):
    return ev.titles_without_body(broken_pages(spark, sf), "17").select("document_id", "rank", "page_no", "display_no", "evidence")


@query("combine_pages", f"""
WITH {ov.PAGES}, tagged AS (
  SELECT document_id, 0 AS g, page_no, {SHOWN} AS display_no, substr(page_text, 1, 220) AS evidence FROM page WHERE has_commercial_sw
  UNION ALL SELECT document_id, 1, page_no, {SHOWN}, substr(page_text, 1, 220) FROM page WHERE has_attachment),
once AS (SELECT * FROM tagged QUALIFY row_number() OVER (PARTITION BY document_id, display_no ORDER BY g, page_no) = 1)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY g, page_no)::INT AS rank, display_no, evidence FROM once QUALIFY rank <= 5""")
def combine_pages(spark, sf):
    p = inp.pages(spark, sf).withColumn("display_no", ev.shown_no()).withColumn("evidence", tx.head(body_text(), 220))
    return ev.combine_pages([p.filter("has_commercial_sw"), p.filter("has_attachment")], 5)


ALLOWED = f"(NOT has_toc AND (NOT {ov.any_of('c', ['서식', '별지', '붙임'])} OR {ov.any_of('c', ['상세요구사항', '기타사항', '사업요구사항', '제안안내사항', '제안안내'])}))"


@query("allowed_evidence_page", f"WITH {ov.PAGES} SELECT document_id, page_no, {ALLOWED} AS allowed FROM page")
def allowed_evidence_page(spark, sf):
    return inp.pages(spark, sf).select("document_id", "page_no", ev.allowed_evidence_page(tx.compact(body_text())).alias("allowed"))


def _bare_words(item):
    return [ev._bare(w) for w in ev.KEEP_KEYWORDS[item]]


@query("keep_attachment_evidence", f"""
WITH {ov.FINALS}, pair AS (SELECT document_id, item_no, page_no, unnest(range(0, len(evidence_pages))) AS pos, unnest(evidence_pages) AS cited, unnest(evidence_text) AS txt FROM final),
kept AS (SELECT * FROM pair WHERE CASE item_no WHEN '15' THEN {ov.any_of(bare('txt'), _bare_words('15'))} WHEN '17' THEN {ov.any_of(bare('txt'), _bare_words('17'))} ELSE true END)
SELECT f.document_id, f.item_no, f.page_no, coalesce(string_agg(cited, ',' ORDER BY pos), '') AS pages, md5(coalesce(string_agg(txt, '|' ORDER BY pos), '')) AS text_md5
FROM final f LEFT JOIN kept k ON k.document_id = f.document_id AND k.item_no = f.item_no AND k.page_no = f.page_no GROUP BY ALL""")
def keep_attachment_evidence(spark, sf):
    done = ev.keep_attachment_evidence(inp.finals(spark, sf))
    return done.select(*KEY, tx.join_ints(F.col("evidence_pages")).alias("pages"), F.md5(F.array_join("evidence_text", "|")).alias("text_md5"))
