"""Registered queries: criteria documents and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.operators import retrieval as rt
from tenderlens.plans import inputs as inp
from tenderlens.plans import oracle_views as ov
from tenderlens.plans.registry import query
from tenderlens.rules import pack
from tenderlens.session import cut_lineage

LEGAL = f"{ov.LEGAL_ITEMS}, {ov.LEGAL_REQUIREMENTS}, {ov.LEGAL_EXAMPLES}, {ov.TACIT}"


def tables(spark, sf):
    return inp.legal_items(spark, sf), inp.legal_requirements(spark, sf), inp.legal_examples(spark, sf)


@query("tokenize", f"""
WITH {ov.PAGES}, w AS (SELECT document_id, page_no, regexp_extract_all(page_text, '[0-9A-Za-z가-힣]{{2,}}') AS raw,
  regexp_extract_all(lower(page_text), '[0-9A-Za-z가-힣]{{2,}}') AS low FROM page)
SELECT document_id, page_no, len(raw)::INT AS words, array_to_string(raw[1:12], ' ') AS first_12,
  array_to_string(raw[1:5], ' ') AS first_5,
  md5(array_to_string(list_filter(low, lambda t: NOT list_contains({ov.sql_list(pack.OVERLAP_STOPWORDS)}, t)), ' ')) AS content_md5,
  array_to_string(list_filter(low, lambda t: NOT list_contains({ov.sql_list(pack.RANK_STOPWORDS)}, t))[1:12], ' ') AS ranked_12
FROM w""")
def tokenize(spark, sf):
    t = F.col("page_text")
    return inp.pages(spark, sf).select(
        "document_id", "page_no", F.size(tx.words(t)).alias("words"), F.array_join(rt.query_tokens(t), " ").alias("first_12"),
        F.array_join(F.slice(tx.words(t), 1, 5), " ").alias("first_5"),
        F.md5(F.array_join(tx.content_tokens(t, pack.OVERLAP_STOPWORDS), " ")).alias("content_md5"),
        F.array_join(F.slice(tx.content_tokens(t, pack.RANK_STOPWORDS), 1, 12), " ").alias("ranked_12"),
    )


@query("load_criteria", f"""
WITH {ov.LEGAL_ITEMS}, {ov.LEGAL_REQUIREMENTS}, r AS (
  SELECT item_no, string_agg(requirement_text, ' // ' ORDER BY row_id) FILTER (requirement_text <> '') AS texts, count(*) FILTER (requirement_text <> '') AS n FROM legal_requirement GROUP BY 1)
SELECT coalesce(i.item_no, r.item_no) AS item_no, coalesce(title, '') AS title, coalesce(target_text, '') AS target_text,
  coalesce(texts, '') AS texts, coalesce(n, 0)::INT AS requirement_count FROM legal_item i FULL JOIN r ON r.item_no = i.item_no""")
def load_criteria(spark, sf):
    items, reqs, _ = tables(spark, sf)
    c = rt.load_criteria(items, reqs)
    return c.select("item_no", "title", "target_text", F.array_join("requirement_texts", " // ").alias("texts"), F.size("requirement_texts").alias("requirement_count"))


@query("criteria_from_cells", """
SELECT 'part' AS source_name, p_brand AS sheet_name, p_partkey AS row_no,
  coalesce(nullif(regexp_extract(p_name, '(?:^|[^0-9])([0-9]{1,2}(?:-[0-9]{1,2})?)(?:[^0-9]|$)', 1), ''),
           nullif(regexp_extract(p_type, '(?:^|[^0-9])([0-9]{1,2}(?:-[0-9]{1,2})?)(?:[^0-9]|$)', 1), ''), CASE WHEN p_size % 3 > 0 THEN p_size::VARCHAR END) AS item_no,
  trim(p_name)[1:120] AS title,
  '1: ' || trim(p_name) || chr(10) || '3: ' || trim(p_type) || CASE WHEN p_size % 3 > 0 THEN chr(10) || '4: ' || p_size ELSE '' END AS content
FROM part""")
def criteria_from_cells(spark, sf):
    p = inp.read(spark, sf, "part")
    cells = p.select(
        F.lit("part").alias("file_name"), F.col("p_brand").alias("sheet_name"), F.col("p_partkey").alias("row_no"),
        F.posexplode(F.array("p_name", F.lit("  "), F.col("p_type"), F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("string")))).alias("_c", "value"),
    ).withColumn("col_no", F.col("_c") + 1)
    lock = cells.withColumn("file_name", F.lit("~$part"))
    return rt.criteria_from_cells(cells.unionByName(lock)).select("source_name", "sheet_name", "row_no", "item_no", "title", "content")


@query("extract_item_no", """
SELECT page_id, nullif(regexp_extract(url, '(?:^|[^0-9])([0-9]{1,2}(?:-[0-9]{1,2})?)(?:[^0-9]|$)', 1), '') AS item_no FROM pages""")
def extract_item_no(spark, sf):
    return inp.read(spark, sf, "pages").select("page_id", rt.extract_item_no(F.col("url")).alias("item_no"))


CORE = f"""CASE WHEN {ov.collapse("coalesce(example_sentence, '')")} <> '' AND contains({ov.collapse('requirement_text')}, {ov.collapse("coalesce(example_sentence, '')")})
  THEN {ov.collapse(f"replace({ov.collapse('requirement_text')}, {ov.collapse(chr(39).join(['coalesce(example_sentence, ', '', ')']))}, ' ')")}
  ELSE {ov.strip('requirement_text')} END"""

CRITERIA = f"""core AS (SELECT *, {CORE} AS core, row_number() OVER (PARTITION BY item_no ORDER BY row_id) AS k FROM legal_requirement),
req_block AS (SELECT item_no, string_agg('[CRITERION ' || k || ']' || chr(10) || 'category: ' || coalesce(category, 'criteria') || chr(10) || 'core_requirement_text: ' || core
    || chr(10) || 'requirement_text: ' || requirement_text
    || CASE WHEN coalesce(example_sentence, '') <> '' THEN chr(10) || '{rt.EXAMPLE_NOTE}' || chr(10) || 'example_sentence: ' || example_sentence ELSE '' END
    || CASE WHEN coalesce(case_text, '') <> '' THEN chr(10) || '{rt.CASE_NOTE}' || chr(10) || 'case_text: ' || case_text ELSE '' END, chr(10) ORDER BY row_id) AS block FROM core GROUP BY 1),
ex_block AS (SELECT item_no, string_agg('[REFERENCE_EXAMPLE ' || k || ']' || chr(10) || 'reference_type: ' || coalesce(reference_type, 'reference_example')
    || CASE WHEN reference_subtype IS NOT NULL THEN chr(10) || 'reference_subtype: ' || reference_subtype ELSE '' END || chr(10) || 'content: ' || content, chr(10) ORDER BY row_id) AS block
  FROM (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY row_id) AS k FROM legal_example) GROUP BY 1),
criteria_doc AS (
  SELECT 'criteria_db' AS source_type, CASE WHEN e.block IS NOT NULL THEN 'legal_item+legal_requirement+legal_reference_example' ELSE 'legal_item+legal_requirement' END AS source_name,
    NULL::BIGINT AS row_no, i.item_no, title, 'legal_review_criteria' AS category,
    '[TARGET]' || chr(10) || 'item_no: ' || i.item_no || chr(10) || 'legal_title: ' || title
      || CASE WHEN coalesce(target_text, '') <> '' THEN chr(10) || 'target_text: ' || target_text ELSE '' END || chr(10) || '[REQUIRED_CRITERIA]' || chr(10)
      || coalesce(r.block, 'no legal_requirement rows')
      || CASE WHEN i.item_no = '14' AND e.block IS NOT NULL THEN chr(10) || '[REFERENCE_EXAMPLES_FOR_ITEM_14]' || chr(10) || e.block ELSE '' END AS content
  FROM legal_item i LEFT JOIN req_block r ON r.item_no = i.item_no LEFT JOIN ex_block e ON e.item_no = i.item_no),
requirement_doc AS (
  SELECT 'requirement_db' AS source_type, 'legal_requirement' AS source_name, k AS row_no, c.item_no,
    coalesce(nullif(i.title, ''), c.item_no || ' legal item') || ' - ' || coalesce(c.category, 'criteria') || ': ' || substr({ov.collapse("split_part(requirement_text, chr(10), 1)")}, 1, 80) AS title,
    coalesce(c.category, 'criteria') AS category,
    CASE WHEN c.category IS NOT NULL THEN 'category: ' || c.category || chr(10) ELSE '' END || CASE WHEN core <> '' THEN 'core_requirement_text: ' || core || chr(10) ELSE '' END
      || 'requirement_text: ' || requirement_text
      || CASE WHEN coalesce(example_sentence, '') <> '' THEN chr(10) || 'example_sentence: ' || example_sentence ELSE '' END
      || CASE WHEN coalesce(case_text, '') <> '' THEN chr(10) || 'case_text: ' || case_text ELSE '' END AS content
  FROM core c LEFT JOIN legal_item i ON i.item_no = c.item_no),
reference_doc AS (
  SELECT 'reference_example_db' AS source_type, 'legal_reference_example' AS source_name, row_number() OVER (ORDER BY row_id) AS row_no, item_no,
    coalesce(reference_type, item_no || ' reference example') AS title, coalesce(reference_subtype, 'reference_example') AS category, content FROM legal_example),
doc AS (SELECT *, 1 AS g FROM criteria_doc UNION ALL SELECT *, 2 FROM requirement_doc UNION ALL SELECT *, 3 FROM reference_doc),
doc_with_id AS MATERIALIZED (SELECT *, g || ':' || lpad(item_no, 6, '0') || ':' || lpad(coalesce(row_no, 0)::VARCHAR, 12, '0') AS doc_id FROM doc)"""

DOC_SHOWN = "source_type, source_name, row_no, item_no, title, category, content"


@query("criteria_docs", f"WITH {LEGAL}, {CRITERIA} SELECT {DOC_SHOWN} FROM criteria_doc")
def criteria_docs(spark, sf):
    return rt.criteria_docs(*tables(spark, sf)).select(*DOC_SHOWN.split(", "))


@query("requirement_docs", f"WITH {LEGAL}, {CRITERIA} SELECT {DOC_SHOWN} FROM requirement_doc")
def requirement_docs(spark, sf):
    items, reqs, _ = tables(spark, sf)
    return rt.requirement_docs(items, reqs).select(*DOC_SHOWN.split(", "))


@query("reference_docs", f"WITH {LEGAL}, {CRITERIA} SELECT {DOC_SHOWN} FROM reference_doc")
def reference_docs(spark, sf):
    return rt.reference_docs(inp.legal_examples(spark, sf)).select(*DOC_SHOWN.split(", "))


TITLE_10 = ov.quote(pack.TITLE_CORRECTIONS["10"])


@query("rebuild_criteria", f"""
WITH {ov.LEGAL_ITEMS}, {ov.LEGAL_REQUIREMENTS}, {ov.LEGAL_EXAMPLES}, {ov.TACIT}, n AS (
  SELECT 'legal_item' AS table_name, (SELECT count(*) FROM legal_item) AS row_count
  UNION ALL SELECT 'legal_requirement', (SELECT count(*) FROM legal_requirement)
  UNION ALL SELECT 'legal_reference_example', (SELECT count(*) FROM legal_example)
  UNION ALL SELECT 'legal_tacit_knowledge', (SELECT count(*) FROM tacit)
  UNION ALL SELECT 'rag_document', (SELECT count(*) FROM legal_item) + (SELECT count(*) FROM legal_requirement) + (SELECT count(*) FROM legal_example))
SELECT table_name, row_count, (SELECT CASE WHEN item_no = '10' THEN {TITLE_10} END FROM legal_item WHERE item_no = '10') AS corrected_title FROM n""")
def rebuild_criteria(spark, sf):
    fixed, _, counts = rt.rebuild_criteria(*tables(spark, sf), inp.tacit_knowledge(spark, sf))
    title = fixed.filter("item_no = '10'").agg(F.max("title").alias("t"))
    return counts.withColumn("corrected_title", title.scalar())


INDEX_TERMS = r"regexp_extract_all(strip_accents(lower(concat_ws(' ', title, category, content))), '[\p{L}\p{N}]+')"
CORPUS = """corpus AS (SELECT doc_id, (doc_id % 18 + 1)::VARCHAR AS item_no,
    ['criteria_db', 'requirement_db', 'reference_example_db', 'criteria_excel'][doc_id % 4 + 1] AS source_type,
    CASE WHEN doc_id % 3 > 0 THEN doc_id END AS row_no, split_part(text, chr(10), 1) AS title, lang AS category, text AS content FROM documents),
asked AS (SELECT item_id AS query_id, CASE WHEN item_id % 20 = 19 THEN '2-1' ELSE (item_id % 18 + 1)::VARCHAR END AS item_no, text AS query FROM benchmark)"""


def bm25(docs: str, queries: str) -> str:
    return f"""sized AS MATERIALIZED (SELECT doc_id, item_no, source_type, {INDEX_TERMS} AS terms FROM {docs}),
posting AS MATERIALIZED (SELECT doc_id, item_no, source_type, len(terms) AS doc_len, term, count(*) AS tf FROM (SELECT *, unnest(terms) AS term FROM sized) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM posting GROUP BY 1),
stat AS (SELECT count(*) AS n, avg(len(terms)) AS avg_len FROM sized),
wanted AS (SELECT query_id, strip_accents(lower(t)) AS term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(query, '[0-9A-Za-z가-힣]{{2,}}')[1:12]) AS t FROM {queries}) GROUP BY ALL),
grp AS (SELECT query_id, unnest(CASE WHEN item_no IN ('2', '2-1') THEN ['2', '2-1'] ELSE [item_no] END) AS item_no FROM {queries}),
scored_hit AS (SELECT query_id, doc_id, item_no, source_type,
    round(sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score
  FROM wanted JOIN posting USING (term) JOIN freq USING (term) JOIN grp USING (query_id, item_no), stat GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE source_type WHEN 'criteria_db' THEN 1 WHEN 'requirement_db' THEN 2 WHEN 'reference_example_db' THEN 3 ELSE 4 END, score DESC, doc_id) AS rank
  FROM scored_hit QUALIFY rank <= 8)"""


@query("build_postings", f"WITH {CORPUS} SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({INDEX_TERMS}) AS term FROM corpus) GROUP BY ALL")
def build_postings(spark, sf):
    return rt.build_postings(inp.criteria_corpus(spark, sf))


@query("bm25_search", f"WITH {CORPUS}, {bm25('corpus', 'asked')} SELECT query_id, rank::INT AS rank, doc_id, score FROM ranked")
def bm25_search(spark, sf):
    return rt.bm25_search(inp.criteria_corpus(spark, sf), inp.criteria_queries(spark, sf)).select("query_id", "rank", "doc_id", "score")


GROUPED = "grp AS (SELECT query_id, query, unnest(CASE WHEN item_no IN ('2', '2-1') THEN ['2', '2-1'] ELSE [item_no] END) AS item_no FROM asked)"


@query("like_search", f"""
WITH {CORPUS}, {GROUPED}, tok AS (SELECT query_id, item_no, unnest(regexp_extract_all(lower(query), '[0-9A-Za-z가-힣]{{2,}}')[1:5]) AS t FROM grp),
found AS (SELECT DISTINCT query_id, doc_id, source_type, row_no FROM tok JOIN corpus USING (item_no)
  WHERE contains(lower(title), t) OR contains(lower(category), t) OR contains(lower(content), t))
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE source_type WHEN 'criteria_db' THEN 1 WHEN 'requirement_db' THEN 2 WHEN 'reference_example_db' THEN 3 ELSE 4 END, row_no NULLS FIRST, doc_id)::INT AS rank
FROM found QUALIFY rank <= 8""")
def like_search(spark, sf):
    return rt.like_search(inp.criteria_corpus(spark, sf), inp.criteria_queries(spark, sf)).select("query_id", "doc_id", "rank")


@query("item_fallback", f"""
WITH {CORPUS}, {GROUPED}
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE source_type WHEN 'requirement_db' THEN 1 WHEN 'criteria_db' THEN 2 WHEN 'reference_example_db' THEN 3 ELSE 4 END, row_no NULLS FIRST, doc_id)::INT AS rank
FROM grp JOIN corpus USING (item_no) QUALIFY rank <= 8""")
def item_fallback(spark, sf):
    return rt.item_fallback(inp.criteria_corpus(spark, sf), inp.criteria_queries(spark, sf)).select("query_id", "doc_id", "rank")


@query("item_alias", """
SELECT o_orderkey AS k, unnest(CASE WHEN o_orderkey % 9 = 1 THEN ['2', '2-1'] ELSE [(o_orderkey % 18 + 1)::VARCHAR] END) AS alias_no FROM orders""")
def item_alias(spark, sf):
    k = F.col("o_orderkey")
    no = F.when(k % 18 == 10, "2-1").otherwise((k % 18 + 1).cast("string"))
    return rt.item_alias(inp.read(spark, sf, "orders").select(k.alias("k"), no.alias("item_no"))).select("k", "alias_no")


HIT_SHOWN = "query_item, rank_group, rank, item_no, source_type, title, snippet"
ITEMS = "item AS (SELECT item_no FROM legal_requirement UNION SELECT item_no FROM legal_item)"
ITEM_GROUP = "member AS (SELECT item_no AS query_item, unnest(CASE WHEN item_no IN ('2', '2-1') THEN ['2', '2-1'] ELSE [item_no] END) AS item_no FROM item)"
AUTHORITATIVE = """authoritative AS (SELECT query_item, 0 AS rank_group, CASE WHEN item_no = '2-1' THEN 2 ELSE 1 END AS rank, item_no, 'authoritative_criteria_db' AS source_type, title, content AS snippet
  FROM criteria_doc JOIN member USING (item_no))"""
TACIT_HIT = f"""tacit_hit AS (SELECT query_item, 2 AS rank_group, row_id::INT AS rank, item_no, 'tacit_knowledge' AS source_type, title, content AS snippet
  FROM tacit JOIN (SELECT * FROM member UNION ALL SELECT item_no, '{pack.COMMON_ITEM}' FROM item) m USING (item_no))"""


@query("authoritative_hits", f"WITH {LEGAL}, {CRITERIA}, {ITEMS}, {ITEM_GROUP}, {AUTHORITATIVE} SELECT {HIT_SHOWN} FROM authoritative")
def authoritative_hits(spark, sf):
    return rt.authoritative_hits(inp.item_list(spark, sf), rt.criteria_docs(*tables(spark, sf))).select(*HIT_SHOWN.split(", "))


@query("tacit_hits", f"WITH {LEGAL}, {ITEMS}, {ITEM_GROUP}, {TACIT_HIT} SELECT {HIT_SHOWN} FROM tacit_hit")
def tacit_hits(spark, sf):
    return rt.tacit_hits(inp.item_list(spark, sf), inp.tacit_knowledge(spark, sf)).select(*HIT_SHOWN.split(", "))


@query("merge_hits", """
WITH hit AS (SELECT l_suppkey % 50 AS query_item, (l_quantity::INT % 3)::INT AS rank_group, l_partkey::INT AS rank, (l_partkey % 9)::VARCHAR AS item_no,
    l_returnflag AS source_type, 'part ' || l_partkey % 20 AS title, repeat('x', 155) || (l_partkey % 40) AS snippet, l_orderkey AS k FROM lineitem)
SELECT query_item::VARCHAR AS query_item, item_no, source_type, title, substr(snippet, 1, 160) AS shown, min(rank_group * 1000000 + rank) AS first_place FROM hit GROUP BY ALL""")
def merge_hits(spark, sf):
    li = inp.read(spark, sf, "lineitem")
    hits = li.select(
        (F.col("l_suppkey") % 50).cast("string").alias("query_item"), (F.col("l_quantity").cast("int") % 3).alias("rank_group"), F.col("l_partkey").cast("int").alias("rank"),
        (F.col("l_partkey") % 9).cast("string").alias("item_no"), F.col("l_returnflag").alias("source_type"),
        F.concat(F.lit("part "), (F.col("l_partkey") % 20).cast("string")).alias("title"), F.concat(F.repeat(F.lit("x"), 155), (F.col("l_partkey") % 40).cast("string")).alias("snippet"),
    )
    m = rt.merge_hits(hits)
    return m.select("query_item", "item_no", "source_type", "title", tx.head(F.col("snippet"), 160).alias("shown"), (F.col("rank_group") * 1000000 + F.col("rank")).alias("first_place"))


def criteria_hits(spark, sf):
    """Authoritative hits of every item, staged because several steps read this small table."""
    return cut_lineage(rt.authoritative_hits(inp.item_list(spark, sf), rt.criteria_docs(*tables(spark, sf))))


def context(spark, sf):
    items, reqs, examples = tables(spark, sf)
    docs = cut_lineage(rt.criteria_table(items, reqs, examples))  # the cascade reads this small table several times
    return rt.context_for_items(inp.item_list(spark, sf), docs, inp.tacit_knowledge(spark, sf))


CONTEXT = f"""{ITEMS}, {ITEM_GROUP}, {AUTHORITATIVE}, {TACIT_HIT},
asked AS (SELECT item_no AS query_id, item_no, CASE WHEN item_no IN ('2', '2-1') THEN '2 2-1' ELSE item_no END || ' legal criteria requirement review' AS query FROM item),
{bm25('doc_with_id', 'asked')},
fallback AS (SELECT query_item AS query_id, doc_id, row_number() OVER (PARTITION BY query_item ORDER BY CASE source_type WHEN 'requirement_db' THEN 1 WHEN 'criteria_db' THEN 2 WHEN 'reference_example_db' THEN 3 ELSE 4 END, row_no NULLS FIRST, doc_id) AS rank
  FROM member JOIN doc_with_id USING (item_no) WHERE query_item NOT IN (SELECT query_id FROM ranked)),
picked AS (SELECT query_id, doc_id, rank FROM ranked UNION ALL SELECT query_id, doc_id, rank FROM fallback),
searched AS (SELECT query_id AS query_item, 1 AS rank_group, rank::INT AS rank, d.item_no, source_type, title, content AS snippet
  FROM picked JOIN doc_with_id d USING (doc_id) WHERE rank <= CASE WHEN query_id IN ('2', '2-1') THEN 2 ELSE 1 END),
hit AS MATERIALIZED (SELECT * FROM (SELECT * FROM authoritative UNION ALL SELECT * FROM searched)
  QUALIFY row_number() OVER (PARTITION BY query_item, item_no, source_type, title, substr(snippet, 1, 160) ORDER BY rank_group, rank) = 1
  UNION ALL SELECT * FROM tacit_hit)"""


@query("context_for_items", f"WITH {LEGAL}, {CRITERIA}, {CONTEXT} SELECT {HIT_SHOWN} FROM hit")
def context_for_items(spark, sf):
    return context(spark, sf).select(*HIT_SHOWN.split(", "))


SEARCH = "요구사항"


@query("search_pages", f"""
WITH {ov.PAGES}, found AS (
  SELECT document_id, page_no, coalesce(nullif(printed_page_no, 0), page_no) AS page, page_text AS t, instr(lower(page_text), '{SEARCH}') - 1 AS pos,
    row_number() OVER (PARTITION BY document_id ORDER BY page_no) AS rank FROM page WHERE contains(lower(page_text), '{SEARCH}') QUALIFY rank <= 25)
SELECT document_id, rank::INT AS rank, page, page_no AS pdf_page,
  CASE WHEN pos > 160 THEN '...' ELSE '' END || substr(t, greatest(pos - 160, 0) + 1, least(pos + {len(SEARCH)} + 160, length(t)) - greatest(pos - 160, 0))
    || CASE WHEN pos + {len(SEARCH)} + 160 < length(t) THEN '...' ELSE '' END AS snippet FROM found""")
def search_pages(spark, sf):
    return rt.search_pages(inp.pages(spark, sf), SEARCH)


@query("coverage_report", f"""
WITH {LEGAL}, {CRITERIA}, {CONTEXT},
named AS (SELECT h.*, CASE source_type WHEN 'tacit_knowledge' THEN 'legal_tacit_knowledge' WHEN 'requirement_db' THEN 'legal_requirement' WHEN 'reference_example_db' THEN 'legal_reference_example'
    ELSE (SELECT c.source_name FROM criteria_doc c WHERE c.item_no = h.item_no) END AS source_name FROM hit h)
SELECT i.item_no AS query_item, count(h.query_item) AS hit_count, coalesce(array_to_string(list_sort(list(DISTINCT h.item_no) FILTER (h.item_no IS NOT NULL)), ','), '') AS hit_item_nos,
  coalesce(array_to_string(list_sort(list(DISTINCT source_name) FILTER (source_name IS NOT NULL)), ','), '') AS sources, count(h.query_item) > 0 AS ok
FROM item i LEFT JOIN named h ON h.query_item = i.item_no GROUP BY 1""")
def coverage_report(spark, sf):
    r = rt.coverage_report(inp.item_list(spark, sf), context(spark, sf))
    empty = F.lit("")
    return r.select("query_item", "hit_count", F.coalesce(F.array_join("hit_item_nos", ","), empty).alias("hit_item_nos"), F.coalesce(F.array_join("sources", ","), empty).alias("sources"), "ok")
