"""Registered queries: page normalisation and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.operators import classify, pages
from tenderlens.plans import inputs as inp
from tenderlens.plans import oracle_views as ov
from tenderlens.plans.registry import query
from tenderlens.rules import pack
from tenderlens.schema import PAGE_FLAGS
from tenderlens.session import cut_lineage

FLAGS = ", ".join(PAGE_FLAGS)
SPACE_LINE = r"[ \t\r\x{0b}\x{0c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"


@query("compact_text", f"""
WITH {ov.PAGES}
SELECT document_id, page_no, md5(c) AS compact_md5, md5(lower(c)) AS lowered_md5,
  md5(regexp_replace(page_text, '(?:{ov.WS}|[:：,，.ㆍ·_/()\\[\\]{{}}<>「」『』-])+', '', 'g')) AS bare_md5,
  md5({ov.collapse('page_text')}) AS collapsed_md5
FROM page""")
def compact_text(spark, sf):
    t = F.col("page_text")
    return inp.pages(spark, sf).select(
        "document_id", "page_no", F.md5(tx.compact(t)).alias("compact_md5"), F.md5(tx.compact_lower(t)).alias("lowered_md5"),
        F.md5(tx.compact_attachment(t)).alias("bare_md5"), F.md5(tx.collapse(t)).alias("collapsed_md5"),
    )


@query("text_length", """
SELECT doc_id AS document_id, length(replace(replace(text, ' ', ''), chr(10), ''))::INT AS text_length FROM documents""")
def text_length(spark, sf):
    return inp.read(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), tx.text_length(F.col("text")).alias("text_length")
    )


@query("parse_optional_int", """
SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '[0-9]{1,4}', 0), '') AS INT) AS first_int,
  CASE WHEN regexp_full_match(split_part(url, '/', -1), '[+-]?[0-9]+') THEN TRY_CAST(split_part(url, '/', -1) AS INT) END AS strict_int
FROM pages""")
def parse_optional_int(spark, sf):
    return inp.read(spark, sf, "pages").select(
        "page_id", tx.first_int(F.col("url")).alias("first_int"),
        tx.strict_int(F.element_at(F.split("url", "/"), -1)).alias("strict_int"),
    )


NUMBERED = "CASE WHEN text_length % 2 = 0 THEN '- ' || page_no || ' -' || chr(10) || '  ' || page_text ELSE page_text END"


@query("strip_leading_page_no", f"""
WITH {ov.PAGES}, numbered AS (SELECT document_id, page_no, {NUMBERED} AS t FROM page)
SELECT document_id, page_no,
  md5(regexp_replace(regexp_replace(t, '^{ov.WS}*[-–—]?{ov.WS}*' || page_no || '{ov.WS}*[-–—]?{ov.WS}*(?:\\r?\\n)+', ''), '^{ov.WS}+', '')) AS text_md5,
  {ov.text_length(f"regexp_replace(regexp_replace(t, '^{ov.WS}*[-–—]?{ov.WS}*' || page_no || '{ov.WS}*[-–—]?{ov.WS}*(?:\\r?\\n)+', ''), '^{ov.WS}+', '')")}::INT AS text_length
FROM numbered""")
def strip_leading_page_no(spark, sf):
    p = inp.pages(spark, sf)
    numbered = F.concat(F.lit("- "), F.col("page_no").cast("string"), F.lit(" -\n  "), F.col("page_text"))
    p = p.withColumn("page_text", F.when(F.col("text_length") % 2 == 0, numbered).otherwise(F.col("page_text")))
    done = pages.normalise_for_store(p.withColumn("printed_page_no", F.col("page_no")))
    return done.select("document_id", "page_no", F.md5("page_text").alias("text_md5"), "text_length")


FOOTED = "CASE WHEN text_length % 4 = 0 THEN page_text || chr(10) || ' - ' || (page_no + 40) || ' - ' ELSE page_text END"


@query("display_page_no", f"""
WITH {ov.PAGES}, footed AS (SELECT document_id, page_no, printed_page_no, {FOOTED} AS t FROM page)
SELECT document_id, page_no,
  coalesce(printed_page_no, TRY_CAST(nullif(regexp_extract(t, '(?:^|\\n){ov.WS}*-{ov.WS}*([0-9]{{1,4}}){ov.WS}*-{ov.WS}*$', 1), '') AS INT), page_no) AS display_no,
  coalesce(nullif(printed_page_no, 0), page_no) AS simple_no
FROM footed""")
def display_page_no(spark, sf):
    p = inp.pages(spark, sf)
    footed = F.concat(F.col("page_text"), F.lit("\n - "), (F.col("page_no") + 40).cast("string"), F.lit(" - "))
    p = p.withColumn("page_text", F.when(F.col("text_length") % 4 == 0, footed).otherwise(F.col("page_text")))
    return p.select(
        "document_id", "page_no",
        tx.display_page_no(F.col("printed_page_no"), F.col("page_text"), F.col("page_no")).alias("display_no"),
        tx.display_page_no_simple(F.col("printed_page_no"), F.col("page_no")).alias("simple_no"),
    )


FILLED = """anchor AS (SELECT document_id, page_no, printed_page_no - page_no AS off, seq FROM page WHERE printed_page_no IS NOT NULL),
fill AS (
  SELECT p.document_id, p.page_no, arg_min(p.page_no + a.off, [abs(a.off), a.seq]) AS value
  FROM page p JOIN anchor a ON a.document_id = p.document_id AND p.page_no + a.off > 0
  WHERE p.printed_page_no IS NULL GROUP BY ALL),
filled AS (SELECT p.* REPLACE (coalesce(p.printed_page_no, f.value)::INT AS printed_page_no)
  FROM page p LEFT JOIN fill f ON f.document_id = p.document_id AND f.page_no = p.page_no)"""


@query("fill_printed_page_no", f"WITH {ov.PAGES}, {FILLED} SELECT document_id, page_no, printed_page_no FROM filled")
def fill_printed_page_no(spark, sf):
    return pages.fill_printed_page_no(inp.pages(spark, sf)).select("document_id", "page_no", "printed_page_no")


BEST = """row_number() OVER (PARTITION BY document_id, page_no ORDER BY (coalesce(length(parser_warning), 0) = 0) DESC,
    has_table DESC, (has_attachment OR has_eval_table) DESC, text_length DESC, seq)"""


@query("dedupe_pages", f"""
WITH {ov.REPEATED}
SELECT document_id, page_no, seq, text_length, md5(page_text) AS text_md5 FROM repeated QUALIFY {BEST} = 1""")
def dedupe_pages(spark, sf):
    best = pages.dedupe_pages(inp.repeated_pages(spark, sf))
    return best.select("document_id", "page_no", "seq", "text_length", F.md5("page_text").alias("text_md5"))


def replacement_rows(page):
    """New rows for every page whose warning asks for another extraction, some of them twice or unknown."""
    p = page.filter("parser_warning is not null or text_length % 17 = 0")
    doc = F.when(F.col("text_length") % 5 == 0, F.col("document_id") + 10_000_000_000).otherwise(F.col("document_id"))
    new = p.withColumn("document_id", doc).withColumn("parser_warning", F.when(F.col("text_length") % 2 == 1, "again"))
    return new.unionByName(new.filter("text_length % 34 = 0"))


REPLACED = """pick AS (SELECT CASE WHEN text_length % 5 = 0 THEN document_id + 10000000000 ELSE document_id END AS document_id,
    page_no, seq, page_text, text_length, printed_page_no, CASE WHEN text_length % 2 = 1 THEN 'again' END AS parser_warning
  FROM page WHERE parser_warning IS NOT NULL OR text_length % 17 = 0),
given AS (SELECT * FROM pick UNION ALL SELECT * FROM pick WHERE text_length % 34 = 0),
known AS (SELECT *, count(*) OVER (PARTITION BY document_id, page_no) AS times,
    document_id IN (SELECT document_id FROM page) AS is_known FROM given)"""


@query("replace_pages", f"""
WITH {ov.PAGES}, {REPLACED},
valid AS (SELECT * FROM known WHERE is_known AND times = 1),
after AS (
  SELECT document_id, parser_warning FROM page p WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.document_id = p.document_id AND v.page_no = p.page_no)
  UNION ALL SELECT document_id, parser_warning FROM valid),
status AS (SELECT document_id, count(*) AS page_count, count(parser_warning) AS parse_warning_count FROM after GROUP BY 1),
refused AS (SELECT document_id, count(*) AS n FROM known WHERE NOT is_known OR times > 1 GROUP BY 1)
SELECT coalesce(s.document_id, r.document_id) AS document_id, coalesce(page_count, 0) AS page_count,
  coalesce(parse_warning_count, 0) AS parse_warning_count,
  CASE WHEN s.document_id IS NULL THEN 'unknown' WHEN parse_warning_count > 0 THEN 'warning' ELSE 'ok' END AS parse_status,
  coalesce(n, 0) AS rejected_rows
FROM status s FULL JOIN refused r ON r.document_id = s.document_id""")
def replace_pages(spark, sf):
    page = cut_lineage(inp.pages(spark, sf))
    _, status, rejected = pages.replace_pages(page, cut_lineage(replacement_rows(page)))
    refused = rejected.groupBy("document_id").agg(F.count(F.lit(1)).alias("rejected_rows"))
    both = status.join(refused, "document_id", "full").fillna(0).fillna({"parse_status": "unknown"})
    return both.select("document_id", "page_count", "parse_warning_count", "parse_status", "rejected_rows")


def repaired_rows(page):
    """Second extraction: every third page again, marked, and one page past the end."""
    p = page.withColumn("parser_warning", F.lit(None).cast("string"))
    again = p.filter("text_length % 3 = 1").withColumn("page_text", F.concat("page_text", F.lit("*")))
    later = again.filter("text_length % 2 = 0").withColumn("seq", F.col("seq") + 1_000_000).withColumn(
        "page_text", F.concat("page_text", F.lit("!"))
    )
    past = p.filter("page_no = 1").withColumn("page_no", F.col("page_no") + 100_000)
    return again.unionByName(later).unionByName(past)


@query("merge_repaired_pages", f"""
WITH {ov.PAGES},
again AS (SELECT * REPLACE (page_text || '*' AS page_text, NULL::VARCHAR AS parser_warning) FROM page WHERE text_length % 3 = 1),
repaired AS (
  SELECT * FROM again
  UNION ALL SELECT * REPLACE (seq + 1000000 AS seq, page_text || '!' AS page_text) FROM again WHERE text_length % 2 = 0),
merged AS (
  SELECT * FROM page p WHERE NOT EXISTS (SELECT 1 FROM repaired r WHERE r.document_id = p.document_id AND r.page_no = p.page_no)
  UNION ALL SELECT * FROM repaired QUALIFY row_number() OVER (PARTITION BY document_id, page_no ORDER BY seq DESC) = 1
  UNION ALL SELECT * REPLACE (page_no + 100000 AS page_no, NULL::VARCHAR AS parser_warning) FROM page WHERE page_no = 1)
SELECT document_id, page_no, md5(page_text) AS text_md5, coalesce(parser_warning, '') AS parser_warning FROM merged""")
def merge_repaired_pages(spark, sf):
    page = cut_lineage(inp.pages(spark, sf))
    merged = pages.merge_repaired_pages(page, cut_lineage(repaired_rows(page)))
    return merged.select("document_id", "page_no", F.md5("page_text").alias("text_md5"), F.coalesce("parser_warning", F.lit("")).alias("parser_warning"))


SPEC_SQL = "(o_orderkey % 7 + 1) || '-' || (o_orderkey % 5 + 3) || ', ' || (o_orderkey % 11 + 1) || ',,' || (o_orderkey % 3 + 2)"


def _specs(spark, sf):
    k = F.col("o_orderkey")
    return inp.read(spark, sf, "orders").select(
        k.alias("job_id"),
        F.concat((k % 7 + 1).cast("string"), F.lit("-"), (k % 5 + 3).cast("string"), F.lit(", "), (k % 11 + 1).cast("string"),
                 F.lit(",,"), (k % 3 + 2).cast("string")).alias("page_spec"),
    )


@query("expand_page_spec", f"""
WITH part AS (
  SELECT o_orderkey AS job_id, unnest(range(0, 4)) AS part_no, trim(unnest(string_split({SPEC_SQL}, ','))) AS p FROM orders),
bounds AS (
  SELECT job_id, part_no, split_part(p, '-', 1)::INT AS a,
    CASE WHEN contains(p, '-') THEN split_part(p, '-', 2) ELSE p END::INT AS b FROM part WHERE p <> ''),
listed AS (SELECT job_id, part_no, CASE WHEN a <= b THEN generate_series(a, b) ELSE generate_series(a, b, -1) END AS pages FROM bounds)
SELECT job_id, part_no::INT AS part_no, unnest(range(0, len(pages)))::INT AS offset, unnest(pages)::INT AS page_no FROM listed""")
def expand_page_spec(spark, sf):
    return pages.expand_page_spec(_specs(spark, sf)).select("job_id", "part_no", "offset", "page_no")


@query("expand_page_set", f"""
WITH part AS (SELECT o_orderkey AS job_id, trim(unnest(string_split({SPEC_SQL}, ','))) AS p FROM orders),
bounds AS (
  SELECT job_id, split_part(p, '-', 1)::INT AS a,
    CASE WHEN contains(p, '-') THEN split_part(p, '-', 2) ELSE p END::INT AS b FROM part WHERE p <> '')
SELECT DISTINCT job_id, unnest(generate_series(a, b))::INT AS page_no FROM bounds WHERE a <= b""")
def expand_page_set(spark, sf):
    return pages.expand_page_set(_specs(spark, sf)).select("job_id", "page_no")


@query("normalize_page_selection", """
WITH job AS (
  SELECT o_orderkey AS job_id, (o_orderkey % 9 + 1)::INT AS total_pages,
    CASE WHEN o_orderkey % 4 = 0 THEN [] WHEN o_orderkey % 4 = 1 THEN [50, 60]
      ELSE [o_orderkey % 12, o_orderkey % 5, 3, 3] END AS selected FROM orders),
listed AS (SELECT DISTINCT job_id, page_no FROM (SELECT job_id, total_pages, unnest(selected)::INT AS page_no FROM job)
  WHERE page_no BETWEEN 1 AND total_pages)
SELECT job_id, page_no FROM listed
UNION ALL
SELECT job_id, unnest(generate_series(1, total_pages))::INT AS page_no FROM job WHERE job_id NOT IN (SELECT job_id FROM listed)""")
def normalize_page_selection(spark, sf):
    k = F.col("o_orderkey")
    jobs = inp.read(spark, sf, "orders").select(
        k.alias("job_id"), (k % 9 + 1).cast("int").alias("total_pages"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "[50, 60]").otherwise(
            F.format_string("[%d, %d, 3, 3]", k % 12, k % 5)).alias("selected_pages"),
    )
    return pages.normalize_page_selection(jobs)


@query("chunk_pages", """
WITH wanted AS (SELECT DISTINCT l_suppkey AS document_id, l_partkey::INT AS page_no FROM lineitem)
SELECT document_id, page_no, row_number() OVER w AS position, ((row_number() OVER w - 1) // 3)::BIGINT AS chunk_no
FROM wanted WINDOW w AS (PARTITION BY document_id ORDER BY page_no)""")
def chunk_pages(spark, sf):
    wanted = inp.read(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("document_id"), F.col("l_partkey").cast("int").alias("page_no")
    ).distinct()
    return pages.chunk_pages(wanted, 3)


def _calls(spark, sf):
    """One extraction call per order: requested pages, and what came back for them."""
    k = F.col("o_orderkey")
    return inp.read(spark, sf, "orders").select(
        k.alias("call_id"),
        F.array(*[(k % 5 + i).cast("int") for i in (1, 2, 3)]).alias("requested"),
        F.array((k % 5 + k % 3).cast("string"), (k % 5 + 1 + k % 4).cast("string"), F.when(k % 6 == 0, "x").otherwise((k % 5 + 3).cast("string"))).alias("reported"),
    )


@query("reconcile_page_no", """
WITH call AS (
  SELECT o_orderkey AS call_id, o_orderkey % 5 AS b, (o_orderkey % 5 + o_orderkey % 3) AS r1,
    (o_orderkey % 5 + 1 + o_orderkey % 4) AS r2, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 5 + 3 END AS r3 FROM orders),
one AS (SELECT *, CASE WHEN r1 BETWEEN b + 1 AND b + 3 THEN r1 ELSE b + 1 END AS p1 FROM call),
two AS (SELECT *, CASE WHEN r2 BETWEEN b + 1 AND b + 3 AND r2 <> p1 THEN r2 ELSE b + 2 END AS p2 FROM one),
three AS (SELECT *, CASE WHEN r3 BETWEEN b + 1 AND b + 3 AND r3 <> p1 AND r3 <> p2 THEN r3 ELSE b + 3 END AS p3 FROM two)
SELECT call_id, p1 || ',' || p2 || ',' || p3 AS pages FROM three""")
def reconcile_page_no(spark, sf):
    return _calls(spark, sf).select("call_id", tx.join_ints(pages.reconcile_page_no(F.col("requested"), F.col("reported"))).alias("pages"))


@query("missing_pages", """
WITH call AS (SELECT o_orderkey AS call_id, o_orderkey % 5 AS b, o_orderkey AS k FROM orders),
asked AS (SELECT call_id, unnest([b + 1, b + 2, b + 3])::INT AS page_no FROM call),
got AS (SELECT call_id, unnest([b + k % 3, b + 1 + k % 4, CASE WHEN k % 6 = 0 THEN NULL ELSE b + 3 END])::INT AS page_no FROM call)
SELECT call_id, page_no FROM asked EXCEPT SELECT call_id, page_no FROM got""")
def missing_pages(spark, sf):
    calls = _calls(spark, sf)
    asked = calls.select("call_id", F.explode("requested").alias("page_no"))
    got = calls.select("call_id", F.explode(F.transform("reported", lambda v: v.try_cast("int"))).alias("page_no"))
    return pages.missing_pages(asked, got, "call_id")


@query("effective_pages", """
WITH call AS (
  SELECT o_orderkey AS k, o_orderkey % 5 AS b, [o_orderkey % 5 + o_orderkey % 3, o_orderkey % 5 + 1 + o_orderkey % 4, CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 5 + 3 END] AS told FROM orders),
chosen AS (SELECT k, told, CASE WHEN k % 3 > 0 AND told[3] IS NOT NULL AND len(list_distinct(told)) = 3 THEN told ELSE [b + 1, b + 2, b + 3] END AS numbers FROM call)
SELECT k AS response_id, (i - 1)::INT AS item_index, coalesce(told[i]::VARCHAR, 'x') AS reported_page_no, numbers[i]::INT AS effective_page_no FROM (SELECT *, unnest([1, 2, 3]) AS i FROM chosen)""")
def effective_pages(spark, sf):
    calls = _calls(spark, sf)
    k = F.col("call_id")
    return pages.effective_pages(calls.select(
        k.alias("response_id"),
        F.concat(F.lit("pages_"), (k % 5 + 1).cast("string"), F.lit("_"), (k % 5 + 3).cast("string"), F.lit(".json")).alias("file_name"),
        F.when(k % 3 == 0, F.col("requested").cast("array<string>")).alias("requested"), "reported",
    ))


# --- classification ---------------------------------------------------------------------------------


@query("table_block", f"""
WITH {ov.LINES}
SELECT document_id, page_no,
  contains(line, '[표 추출]') OR regexp_matches(line, '(?m)^{ov.WS}*\\|.+\\|{ov.WS}*$') AS is_table_block
FROM raw_line""")
def table_block(spark, sf):
    return inp.raw_lines(spark, sf).select("document_id", "page_no", classify.table_block(F.col("page_text")).alias("is_table_block"))


@query("table_like", f"""
WITH {ov.PAGES}
SELECT document_id, page_no, contains(c, '항목추진내용') OR {ov.all_of('c', ['요구사항분류', '요구사항명칭'])} OR {ov.all_of('c', ['부서명', '역할'])} AS is_table_like,
  {ov.all_of('c', ['부서명', '담당'])} AS has_department
FROM page""")
def table_like(spark, sf):
    return inp.pages(spark, sf).select("document_id", "page_no", tx.compact(F.col("page_text")).alias("c")).select(
        "document_id", "page_no", classify.table_like(F.col("c")).alias("is_table_like"),
        tx.contains_all(F.col("c"), ["부서명", "담당"]).alias("has_department"),
    )


LABELLED = "replace(page_text, ' 설계 ', chr(10) || '설계' || chr(10) || '담당' || chr(10))"


def _labelled(spark, sf):
    """Pages with some phrases set on lines of their own, so that short label lines occur."""
    return inp.pages(spark, sf).withColumn("page_text", F.replace(F.col("page_text"), F.lit(" 설계 "), F.lit("\n설계\n담당\n")))


LABEL_COUNT = "len(list_filter(string_split(t, chr(10)), lambda x: regexp_full_match(trim(x), '[가-힣]{1,4}')))"


@query("table_continuation", f"""
WITH {ov.PAGES}, labelled AS (SELECT document_id, page_no, {LABELLED} AS t, c FROM page)
SELECT document_id, page_no, {LABEL_COUNT} >= 2 AND {ov.count_of('c', pack.CONTINUATION_TERMS)} >= 3 AS is_continuation FROM labelled""")
def table_continuation(spark, sf):
    p = _labelled(spark, sf).select("document_id", "page_no", "page_text", tx.compact(F.col("page_text")).alias("c"))
    return p.select("document_id", "page_no", classify.table_continuation(F.col("page_text"), F.col("c")).alias("is_continuation"))


INFERRED = f"""labelled AS (
  SELECT document_id, page_no, seq, {LABELLED} AS t, c, has_table, {LABELLED} AS page_text FROM page),
kind AS (
  SELECT document_id, page_no,
    has_table OR regexp_matches(t, '(?m)^{ov.WS}*\\|.+\\|{ov.WS}*$') OR contains(c, '항목추진내용')
      OR {ov.all_of('c', ['요구사항분류', '요구사항명칭'])} OR {ov.all_of('c', ['부서명', '역할'])} AS seed,
    {LABEL_COUNT} >= 2 AND {ov.count_of('c', pack.CONTINUATION_TERMS)} >= 3 AS cont FROM labelled),
mark AS (SELECT *, max(CASE WHEN seed THEN page_no END) OVER w AS last_seed,
    max(CASE WHEN NOT seed AND NOT cont THEN page_no END) OVER w AS last_break
  FROM kind WINDOW w AS (PARTITION BY document_id ORDER BY page_no)),
inferred AS (SELECT document_id, page_no, seed, cont,
    seed OR (cont AND coalesce(last_seed, 0) > coalesce(last_break, 0)) AS has_table FROM mark)"""


@query("infer_table_pages", f"WITH {ov.PAGES}, {INFERRED} SELECT document_id, page_no, has_table FROM inferred")
def infer_table_pages(spark, sf):
    return classify.infer_table_pages(_labelled(spark, sf)).select("document_id", "page_no", "has_table")


PRESCAN = f"""cleaned AS (
  SELECT document_id, page_no, array_to_string(list_filter(list_transform(string_split(page_text, chr(10)), lambda x: {ov.strip('x')}), lambda x: x <> ''), chr(10)) AS t, c FROM page),
flagged AS (
  SELECT document_id, page_no, t, c, length(c)::INT AS n, {ov.count_of('c', pack.REQUIREMENT_HEADERS)} >= 2 AS req,
    {ov.any_of('c', pack.EVAL_HEADERS)} AS ev,
    (length(t) - length(replace(t, '|', '')) >= 4 OR len(regexp_extract_all(t, '{ov.WS}{{2,}}')) >= 12 OR {ov.any_of('c', pack.PRESCAN_TABLE_TERMS)}) AS layout,
    {ov.any_of('c', pack.ATTACHMENT_MARKERS)} AS att, {ov.any_of('c', pack.TOC_MARKERS)} AS toc,
    length(c) <= 80 AND ({ov.any_of('c', pack.SECTION_TITLES)} OR regexp_full_match(c, '[0-9]{{1,3}}[ⅠⅡⅢⅣⅤⅥⅦⅧ]?.{{0,30}}')) AS nav,
    CASE WHEN length(c) = 0 THEN 0.0 ELSE (length(c) - length(replace(replace(c, '?', ''), '�', ''))) / length(c)::DOUBLE END AS noise,
    {ov.any_of('c', pack.REVIEW_TERMS)} AS relevant, {ov.any_of('c', pack.LEGAL_TERMS)} AS legal,
    ({' OR '.join(ov.all_of('c', g) for g in pack.DENSE_GROUPS)} OR len(regexp_extract_all(t, '{pack.EMAIL}')) >= 2) AS dense
  FROM cleaned)"""


@query("prescan_flags", f"""
WITH {ov.PAGES}, {PRESCAN}
SELECT document_id, page_no, n AS text_length, req AS has_requirement_table, ev AS has_eval_table, req OR ev OR layout AS has_table,
  att AS has_attachment, toc AS has_toc, md5(t) AS text_md5 FROM flagged""")
def prescan_flags(spark, sf):
    return classify.prescan(inp.pages(spark, sf)).select(
        "document_id", "page_no", "text_length", "has_requirement_table", "has_eval_table", "has_table", "has_attachment",
        "has_toc", F.md5("page_text").alias("text_md5"),
    )


def _predicate(name, column, build):
    @query(name, f"WITH {ov.PAGES}, {PRESCAN} SELECT document_id, page_no, {column} AS {name} FROM flagged")
    def run(spark, sf):
        p = classify.prescan(inp.pages(spark, sf)).withColumn("_compact", tx.compact(F.col("page_text")))
        return p.select("document_id", "page_no", build().alias(name))

    return run


navigation_page = _predicate("navigation_page", "nav", lambda: classify.navigation_page(F.col("_compact")))
noise_ratio = _predicate("noise_ratio", "noise", lambda: classify.noise_ratio(F.col("_compact")))
review_relevant = _predicate("review_relevant", "relevant", lambda: classify.review_relevant(F.col("_compact")))
legal_or_security = _predicate("legal_or_security", "legal", lambda: classify.legal_or_security(F.col("_compact")))
dense_layout = _predicate("dense_layout", "dense", lambda: classify.dense_layout(F.col("page_text"), F.col("_compact")))


@query("triage_pages", f"""
WITH {ov.PAGES}, {PRESCAN},
reasoned AS (SELECT document_id, page_no, CASE WHEN nav THEN NULL WHEN n < 120 THEN 'short_or_image_heavy_page'
    WHEN n = 0 OR noise > 0.03 THEN 'suspicious_text_noise' WHEN relevant THEN 'review_relevant_keyword_page'
    WHEN req OR ev OR layout THEN 'table_or_requirement_page' WHEN dense THEN 'dense_layout_table_candidate'
    WHEN legal THEN 'legal_or_security_keyword_page' END AS reason FROM flagged)
SELECT document_id, page_no, reason IS NOT NULL AS needs_extraction, coalesce(reason, 'python_text_good_enough') AS triage_reason,
  'python_prescan_needs_gpt: ' || reason AS parser_warning FROM reasoned""")
def triage_pages(spark, sf):
    return classify.triage_pages(inp.pages(spark, sf)).select("document_id", "page_no", "needs_extraction", "triage_reason", "parser_warning")


INDEX = f"""({ov.any_of('c', pack.ATTACHMENT_MARKERS)} AND (len(regexp_extract_all(page_text, '(?:별첨|붙임|서식){ov.WS}*[0-9]+')) >= 2 OR contains(c, '목차')))"""


@query("index_page", f"WITH {ov.PAGES} SELECT document_id, page_no, {INDEX} AS is_index_page FROM page")
def index_page(spark, sf):
    p = inp.pages(spark, sf).select("document_id", "page_no", "page_text", tx.compact(F.col("page_text")).alias("c"))
    return p.select("document_id", "page_no", classify.index_page(F.col("page_text"), F.col("c")).alias("is_index_page"))


@query("script_noise", f"""
WITH {ov.LINES}, spoiled AS (SELECT document_id, page_no, replace(replace(line, '%', chr(2309)), '#', chr(65533)) AS t FROM raw_line),
found AS (SELECT *, length(t) - length(regexp_replace(t, '[\\x{{0900}}-\\x{{097F}}\\x{{0980}}-\\x{{09FF}}\\x{{0C00}}-\\x{{0C7F}}\\x{{FFFD}}]', '', 'g')) AS k FROM spoiled)
SELECT document_id, page_no, k >= 2 OR (k > 0 AND k / greatest(length(t), 1)::DOUBLE >= 0.005) AS is_noisy FROM found""")
def script_noise(spark, sf):
    spoiled = F.translate("page_text", "%#", "अ�")
    return inp.raw_lines(spark, sf).select("document_id", "page_no", classify.script_noise(spoiled).alias("is_noisy"))


def flag_override_rows(spark, sf):
    """Overrides by reviewers' events; later ones win, a missing flag leaves the page's own."""
    e = inp.read(spark, sf, "events")
    v = F.floor("value").cast("int")
    return e.select(
        F.col("user_id").alias("document_id"), (F.col("event_id") % 12 + 1).cast("int").alias("page_no"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "click", v % 2 == 0).alias("has_table"),
        F.when(F.col("event_type") == "view", v % 2 == 0).alias("has_eval_table"),
        F.when(F.col("event_type") == "error", v % 2 == 0).alias("has_attachment"),
    )


@query("apply_flag_overrides", f"""
WITH {ov.PAGES},
given AS (SELECT user_id AS document_id, (event_id % 12 + 1)::INT AS page_no, event_id AS seq, event_type AS k, floor(value)::INT % 2 = 0 AS v FROM events),
latest AS (SELECT document_id, page_no, arg_max(v, seq) FILTER (k = 'click') AS t, arg_max(v, seq) FILTER (k = 'view') AS e,
    arg_max(v, seq) FILTER (k = 'error') AS a FROM given GROUP BY ALL)
SELECT p.document_id, p.page_no, coalesce(t, has_table) AS has_table, coalesce(e, has_eval_table) AS has_eval_table,
  coalesce(a, has_attachment) AS has_attachment
FROM page p LEFT JOIN latest l ON l.document_id = p.document_id AND l.page_no = p.page_no""")
def apply_flag_overrides(spark, sf):
    done = classify.apply_flag_overrides(inp.pages(spark, sf), flag_override_rows(spark, sf))
    return done.select("document_id", "page_no", "has_table", "has_eval_table", "has_attachment")


@query("flag_counts", f"""
WITH {ov.PAGES}
SELECT document_id, count(*) AS page_count, count_if(has_table) AS has_table_pages, count_if(has_attachment) AS has_attachment_pages,
  count_if(has_eval_table) AS has_eval_table_pages, count_if(has_toc) AS has_toc_pages, count_if(text_length < 30) AS low_text_pages,
  count(parser_warning) AS parser_warning_pages FROM page GROUP BY 1""".replace("count_if(", "count(*) FILTER ("))
def flag_counts(spark, sf):
    return classify.flag_counts(inp.pages(spark, sf))


@query("flagged_pages", f"""
WITH {ov.PAGES}
SELECT document_id, page_no, 'has_table' AS kind FROM page WHERE has_table
UNION ALL SELECT document_id, page_no, 'has_attachment' FROM page WHERE has_attachment
UNION ALL SELECT document_id, page_no, 'has_eval_table' FROM page WHERE has_eval_table
UNION ALL SELECT document_id, page_no, 'has_toc' FROM page WHERE has_toc
UNION ALL SELECT document_id, page_no, 'low_text' FROM page WHERE text_length < 30
UNION ALL SELECT document_id, page_no, 'parser_warning' FROM page WHERE parser_warning IS NOT NULL""")
def flagged_pages(spark, sf):
    return classify.flagged_pages(inp.pages(spark, sf))
