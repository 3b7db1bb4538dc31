"""Registered queries: extraction audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlens.operators import audit
from tenderlens.plans import catalog_pages as cp
from tenderlens.plans import inputs as inp
from tenderlens.plans import oracle_views as ov
from tenderlens.plans.registry import query
from tenderlens.rules import pack
from tenderlens.session import cut_lineage

SECTION_CASES = " UNION ALL ".join(
    f"SELECT document_id, {no} AS kind_no, '{name}' AS name, {first} AS from_page, regexp_matches(t, '{'|'.join(a if b is None else f'{a}{ov.WS}*{b}' for a, b in pairs)}') AS present FROM whole"
    for no, ((name, pairs), first) in enumerate(zip(pack.REQUIRED_SECTIONS.items(), pack.SECTION_FROM_PAGE.values()))
)

WARNINGS = f"""whole AS (SELECT document_id, string_agg(page_text, chr(10) ORDER BY page_no) AS t, max(page_no) AS max_page,
    count(DISTINCT page_no) AS parsed, bool_or(has_eval_table) AS ev, bool_or(has_attachment) AS att FROM page GROUP BY 1),
section AS ({SECTION_CASES}),
section_warning AS (
  SELECT s.document_id, 1 AS phase, 0::BIGINT AS seq, kind_no, 'required_section_missing' AS warning_type,
    '{pack.MSG_SECTION}' || name AS message, NULL::INT AS page_no, 'medium' AS severity, '' AS items
  FROM section s JOIN whole w USING (document_id) JOIN document d USING (document_id)
  WHERE NOT present AND (parsed >= total_pages OR max_page >= from_page)),
checked AS (SELECT * FROM page WHERE NOT {cp.INDEX}),
page_warning AS (
  SELECT document_id, 2 AS phase, seq, 0 AS kind_no, 'parser_warning' AS warning_type, parser_warning AS message, page_no, 'medium' AS severity, '' AS items FROM checked WHERE length(parser_warning) > 0
  UNION ALL SELECT document_id, 2, seq, 1, 'empty_page', '{pack.MSG_EMPTY}', page_no, 'high', '' FROM checked WHERE text_length = 0
  UNION ALL SELECT document_id, 2, seq, 2, 'low_text_density', '{pack.MSG_LOW}', page_no, 'low', '' FROM checked WHERE text_length BETWEEN 1 AND 29
  UNION ALL SELECT document_id, 2, seq, 3, 'suspicious_unicode_noise', '{pack.MSG_NOISE}', page_no, 'medium', '' FROM checked
    WHERE length(page_text) - length(regexp_replace(page_text, '[\\x{{0900}}-\\x{{097F}}\\x{{0980}}-\\x{{09FF}}\\x{{0C00}}-\\x{{0C7F}}\\x{{FFFD}}]', '', 'g')) >= 2),
absence_warning AS (
  SELECT document_id, 3 AS phase, 0::BIGINT AS seq, 0 AS kind_no, 'eval_table_not_found' AS warning_type, '{pack.MSG_NO_EVAL}' AS message, NULL::INT AS page_no, 'medium' AS severity, '4,11,12' AS items
    FROM whole JOIN document USING (document_id) WHERE parsed >= total_pages AND NOT ev
  UNION ALL SELECT document_id, 3, 0, 1, 'attachment_not_found', '{pack.MSG_NO_ATTACHMENT}', NULL, 'medium', '2,15,17'
    FROM whole JOIN document USING (document_id) WHERE parsed >= total_pages AND NOT att),
warning AS (SELECT * FROM section_warning UNION ALL SELECT * FROM page_warning UNION ALL SELECT * FROM absence_warning)"""

BASE = f"WITH {ov.PAGES}, {ov.DOCUMENTS}, {WARNINGS}"
SHOWN = "document_id, phase, seq, kind_no, warning_type, message, page_no, severity, items"


def _shown(warnings):
    return warnings.select(
        "document_id", "phase", "seq", "kind_no", "warning_type", "message", "page_no", "severity",
        F.array_join("related_item_nos", ",").alias("items"),
    )


@query("missing_sections", f"{BASE} SELECT {SHOWN} FROM section_warning")
def missing_sections(spark, sf):
    return _shown(audit.missing_sections(inp.pages(spark, sf), inp.documents(spark, sf)))


@query("page_warnings", f"{BASE} SELECT {SHOWN} FROM page_warning")
def page_warnings(spark, sf):
    return _shown(audit.page_warnings(inp.pages(spark, sf)))


@query("absence_warnings", f"{BASE} SELECT {SHOWN} FROM absence_warning")
def absence_warnings(spark, sf):
    return _shown(audit.absence_warnings(inp.pages(spark, sf), inp.documents(spark, sf)))


def stored_warnings(spark, sf):
    """Warnings of every type and grade, one per event, some without a page."""
    e = inp.read(spark, sf, "events")
    kinds = [*pack.INDEX_FILTERED_TYPES, "empty_page", "missing_page"]
    k = F.col("event_id")
    return e.select(
        F.col("user_id").alias("document_id"), F.lit(2).alias("phase"), k.alias("seq"), F.lit(0).alias("kind_no"),
        F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % 7 + 1).cast("int")).alias("warning_type"),
        F.when(k % 3 == 0, "OCR needed").otherwise("seen").alias("message"),
        F.when(k % 11 > 0, (k % 30 + 1).cast("int")).alias("page_no"),
        F.element_at(F.array(*[F.lit(x) for x in ["info", "low", "Medium ", "high", "critical", "odd", "low", "info", "info", "low"]]), (k % 10 + 1).cast("int")).alias("severity"),
        F.array().cast("array<string>").alias("related_item_nos"),
    )


STORED = """stored AS (
  SELECT user_id AS document_id, event_id AS seq,
    ['parser_warning', 'low_text_density', 'layout_error', 'meaningless_text', 'gpt_parse_audit', 'empty_page', 'missing_page'][event_id % 7 + 1] AS warning_type,
    CASE WHEN event_id % 3 = 0 THEN 'OCR needed' ELSE 'seen' END AS message,
    CASE WHEN event_id % 11 > 0 THEN (event_id % 30 + 1)::INT END AS page_no,
    ['info', 'low', 'Medium ', 'high', 'critical', 'odd', 'low', 'info', 'info', 'low'][event_id % 10 + 1] AS severity FROM events)"""

GRADED = """graded AS (SELECT *, CASE lower(trim(severity)) WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 2 END AS rank FROM stored),
worst AS (SELECT document_id, page_no, max(rank) AS rank, sum([0, 1, 4, 10, 20][rank + 1]) AS total, count(*) AS n FROM graded GROUP BY ALL),
sums AS (SELECT document_id, sum(n)::BIGINT AS warning_count,
    count(*) FILTER (page_no IS NOT NULL AND rank >= 2) AS affected, count(*) FILTER (page_no IS NOT NULL AND rank >= 1) AS all_affected,
    count(*) FILTER (page_no IS NOT NULL AND rank >= 3) AS critical,
    sum(CASE WHEN page_no IS NULL THEN total ELSE [0, 1, 4, 10, 20][rank + 1] END) AS penalty FROM worst GROUP BY 1),
scored AS (SELECT document_id, total_pages, coalesce(warning_count, 0) AS audit_warning_count, coalesce(affected, 0) AS affected_page_count,
    coalesce(all_affected, 0) AS all_affected_page_count, coalesce(critical, 0) AS critical_page_count,
    coalesce(affected, 0) / total_pages::DOUBLE AS affected_ratio, greatest(0, 100 - coalesce(penalty, 0))::INT AS audit_score
  FROM document LEFT JOIN sums USING (document_id)),
stated AS (SELECT *, CASE WHEN audit_warning_count = 0 THEN 'ok' WHEN critical_page_count >= 5 OR affected_ratio >= 0.15 THEN 'fail' ELSE 'warning' END AS parse_status FROM scored)"""


def own_documents(spark, sf):
    """Documents of the stored warnings, long enough for their page numbers."""
    return inp.documents(spark, sf).withColumn("total_pages", F.col("total_pages") + F.when(F.col("document_id") % 2 == 0, 400).otherwise(40))


OWN_DOCUMENTS = ov.DOCUMENTS + ", own AS (SELECT * REPLACE ((total_pages + CASE WHEN document_id % 2 = 0 THEN 400 ELSE 40 END)::INT AS total_pages) FROM document)"
GRADED_OWN = GRADED.replace("FROM document LEFT JOIN", "FROM own LEFT JOIN")


@query("filter_index_warnings", f"""
WITH {ov.PAGES}, {STORED}, index_pages AS (SELECT document_id, page_no FROM page WHERE {cp.INDEX})
SELECT document_id, seq, warning_type, page_no FROM stored s
WHERE page_no IS NULL OR warning_type IN ('empty_page', 'missing_page')
  OR NOT EXISTS (SELECT 1 FROM index_pages i WHERE i.document_id = s.document_id AND i.page_no = s.page_no)""")
def filter_index_warnings(spark, sf):
    return audit.filter_index_warnings(stored_warnings(spark, sf), inp.pages(spark, sf)).select("document_id", "seq", "warning_type", "page_no")


SCORE_COLUMNS = "document_id, audit_warning_count, affected_page_count, all_affected_page_count, critical_page_count, affected_ratio, audit_score, parse_status"


@query("audit_quality", f"WITH {OWN_DOCUMENTS}, {STORED}, {GRADED_OWN} SELECT {SCORE_COLUMNS} FROM stated")
def audit_quality(spark, sf):
    return audit.score_documents(stored_warnings(spark, sf), own_documents(spark, sf)).select(*SCORE_COLUMNS.split(", "))


@query("parse_status", f"WITH {OWN_DOCUMENTS}, {STORED}, {GRADED_OWN} SELECT parse_status, count(*) AS documents, min(audit_score) AS lowest, max(audit_score) AS highest FROM stated GROUP BY 1")
def parse_status(spark, sf):
    scored = audit.score_documents(stored_warnings(spark, sf), own_documents(spark, sf))
    return scored.groupBy("parse_status").agg(F.count(F.lit(1)).alias("documents"), F.min("audit_score").alias("lowest"), F.max("audit_score").alias("highest"))


@query("pages_to_reparse", f"""
WITH {OWN_DOCUMENTS}, {STORED}, {GRADED_OWN}
SELECT DISTINCT document_id, page_no FROM stored JOIN stated USING (document_id) WHERE page_no > 0 AND audit_score BETWEEN 1 AND 69""")
def pages_to_reparse(spark, sf):
    warnings = stored_warnings(spark, sf)
    return audit.pages_to_reparse(warnings, audit.score_documents(warnings, own_documents(spark, sf)))


REPAIR_SQL = """SELECT document_id, page_no FROM page WHERE text_length = 0 OR contains(lower(parser_warning), 'ocr') OR contains(lower(parser_warning), 'empty')
UNION SELECT document_id, page_no FROM {w} WHERE page_no IS NOT NULL AND (warning_type IN ('empty_page', 'missing_page') OR (warning_type = 'parser_warning' AND (contains(lower(message), 'ocr') OR contains(lower(message), 'empty'))))"""


@query("repair_pages", f"WITH {ov.PAGES}, {STORED} {REPAIR_SQL.format(w='stored')}")
def repair_pages(spark, sf):
    return audit.repair_pages(inp.pages(spark, sf), stored_warnings(spark, sf))


@query("parse_fail_reviews", f"""
WITH {OWN_DOCUMENTS}, {STORED}, {GRADED_OWN},
failed AS (SELECT document_id FROM stated WHERE parse_status = 'fail'),
problem AS (SELECT document_id, string_agg(page_no, ',' ORDER BY page_no) AS pages FROM (
  SELECT DISTINCT document_id, page_no, dense_rank() OVER (PARTITION BY document_id ORDER BY page_no) AS k FROM stored WHERE page_no IS NOT NULL) WHERE k <= 10 GROUP BY 1),
said AS (SELECT document_id, string_agg(CASE WHEN page_no IS NULL THEN '' ELSE 'p.' || page_no || ': ' END || warning_type || ' - ' || message, ' / ' ORDER BY seq) AS warnings FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS k FROM stored) WHERE k <= 10 GROUP BY 1)
SELECT document_id, unnest({ov.sql_list(pack.DEFAULT_ITEMS)}) AS item_no, '{pack.ON_HOLD}' AS final_result, coalesce(pages, '') AS pages, coalesce(warnings, '') AS warnings
FROM failed LEFT JOIN problem USING (document_id) LEFT JOIN said USING (document_id)""")
def parse_fail_reviews(spark, sf):
    warnings = stored_warnings(spark, sf)
    held = audit.parse_fail_reviews(warnings, audit.score_documents(warnings, own_documents(spark, sf)), pack.DEFAULT_ITEMS)
    return held.select("document_id", "item_no", "final_result", F.array_join("evidence_pages", ",").alias("pages"), F.array_join("warnings", " / ").alias("warnings"))


AUDITED = GRADED.replace("FROM stored", "FROM warning")


@query("needs_confirmation", f"""
{BASE}, {AUDITED} SELECT document_id, parse_status <> 'ok' OR audit_score < 80 OR audit_warning_count > 0 AS needs_confirmation FROM stated""")
def needs_confirmation(spark, sf):
    scored, _ = audit.audit_documents(cut_lineage(inp.pages(spark, sf)), inp.documents(spark, sf))
    return scored.select("document_id", audit.needs_confirmation().alias("needs_confirmation"))


@query("audit_documents", f"{BASE}, {AUDITED} SELECT {SCORE_COLUMNS} FROM stated")
def audit_documents(spark, sf):
    scored, _ = audit.audit_documents(cut_lineage(inp.pages(spark, sf)), inp.documents(spark, sf))
    return scored.select(*SCORE_COLUMNS.split(", "))


def supplied_rows(page):
    """What a second extraction would return: every page with some more text."""
    more = F.concat("page_text", F.lit(" second extraction of the page with readable text"))
    return page.withColumn("page_text", more).withColumn("parser_warning", F.lit(None).cast("string")).withColumn("text_length", F.col("text_length") + 43)


@query("repair_round", f"""
WITH {ov.PAGES.replace('page AS MATERIALIZED', 'first_page AS MATERIALIZED')}, {ov.DOCUMENTS}, bad AS (
  SELECT document_id, page_no FROM first_page WHERE text_length = 0 OR contains(lower(parser_warning), 'ocr')
  UNION SELECT document_id, page_no FROM first_page WHERE text_length = 0),
page AS MATERIALIZED (
  SELECT * FROM first_page p WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.document_id = p.document_id AND b.page_no = p.page_no)
  UNION ALL SELECT p.* REPLACE (page_text || ' second extraction of the page with readable text' AS page_text, text_length + 43 AS text_length, NULL::VARCHAR AS parser_warning)
  FROM first_page p JOIN bad b ON b.document_id = p.document_id AND b.page_no = p.page_no),
{WARNINGS}, {AUDITED} SELECT {SCORE_COLUMNS} FROM stated""")
def repair_round(spark, sf):
    page = cut_lineage(inp.pages(spark, sf))
    _, scored, _ = audit.repair_round(page, inp.documents(spark, sf), supplied_rows(page))
    return scored.select(*SCORE_COLUMNS.split(", "))
