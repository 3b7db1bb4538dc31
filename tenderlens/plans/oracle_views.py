"""DuckDB relations equal to those of `inputs`, as common table expressions for the oracle SQL."""

from tenderlens.plans import inputs
from tenderlens.rules import pack


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def any_of(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, {quote(t)})" for t in terms) + ")"


def all_of(column: str, terms) -> str:
    return "(" + " AND ".join(f"contains({column}, {quote(t)})" for t in terms) + ")"


def count_of(column: str, terms) -> str:
    return "(" + " + ".join(f"contains({column}, {quote(t)})::INT" for t in terms) + ")"


WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]"


def compact(c: str) -> str:
    return f"regexp_replace({c}, '{WS}+', '', 'g')"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def text_length(c: str) -> str:
    return f"length(replace(replace({c}, ' ', ''), chr(10), ''))"


def encoded(source: str, columns: str, text: str, name: str) -> str:
    """CTE `name` with the columns of `source` and the codebook form of `text` as `coded`."""
    slot = "('0x' || substr(md5(w), 1, 4))::INT"
    return f"""{name} AS (
  SELECT {columns}, array_to_string(list_transform(string_split({text}, ' '), lambda w:
    CASE WHEN length(w) < {inputs.MIN_LETTERS} THEN w
         WHEN {slot} % {inputs.TOC_SLOTS} = 7 THEN '목차'
         ELSE coalesce({sql_list(inputs.CODEBOOK)}[{slot} % {inputs.SLOTS} + 1], w) END), ' ') AS coded
  FROM {source})"""


LINES = """raw_line AS (
  SELECT doc_id AS document_id, unnest(range(1, len(l) + 1))::INT AS page_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""

PAGES = f"""{LINES},
{encoded('raw_line', 'document_id, page_no', 'line', 'coded_line')},
sized AS (
  SELECT document_id, page_no, coded AS page_text, {compact('coded')} AS c, {text_length('coded')} AS n FROM coded_line),
page AS MATERIALIZED (
  SELECT document_id, page_no::BIGINT AS seq, page_no, page_text, n::INT AS text_length,
    CASE WHEN n % 3 = 0 THEN (page_no + document_id % 7 - 3)::INT END AS printed_page_no,
    contains(c, '요구사항총괄표') AS has_table,
    {any_of('c', pack.ATTACHMENT_MARKERS)} AS has_attachment,
    {any_of('c', ['평가항목', '평가기준'])} AS has_eval_table,
    contains(c, '목차') AS has_toc,
    contains(c, '위원명') AS has_blind,
    {any_of('c', pack.COMMERCIAL_SW)} AS has_commercial_sw,
    CASE WHEN n < 4 THEN 'OCR empty' WHEN n % 31 = 0 THEN 'layout check' END AS parser_warning,
    c
  FROM sized)"""

REPEATED = f"""{PAGES},
repeated AS (
  SELECT * REPLACE (floor((page_no + 2) / 3)::INT AS page_no) FROM page)"""

DOCUMENTS = """document AS (
  SELECT doc_id AS document_id, source || '-' || lang AS document_name,
    (len(string_split(text, chr(10))) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END)::INT AS total_pages
  FROM documents)"""

BENCHMARK = "(SELECT item_id, text, split_part(text, chr(10), 1) AS line1 FROM benchmark)"


def _coded(c: str) -> str:
    slot = "('0x' || substr(md5(w), 1, 4))::INT"
    return (
        f"array_to_string(list_transform(string_split({c}, ' '), lambda w: CASE WHEN length(w) < {inputs.MIN_LETTERS} THEN w "
        f"WHEN {slot} % {inputs.TOC_SLOTS} = 7 THEN '목차' ELSE coalesce({sql_list(inputs.CODEBOOK)}[{slot} % {inputs.SLOTS} + 1], w) END), ' ')"
    )


LEGAL_ITEMS = f"""legal_item AS (
  SELECT (item_id % 17 + 1)::VARCHAR AS item_no, arg_min({_coded('line1')}, item_id) AS title,
    CASE WHEN item_id % 17 % 3 > 0 THEN string_agg({_coded('text')}, chr(10) ORDER BY item_id) END AS target_text
  FROM {BENCHMARK} GROUP BY item_id % 17)"""

LEGAL_REQUIREMENTS = f"""legal_requirement AS (
  SELECT item_id AS row_id, CASE WHEN item_id % 20 = 19 THEN '2-1' ELSE (item_id % 18 + 1)::VARCHAR END AS item_no,
    CASE WHEN item_id % 4 > 0 THEN 'category ' || (item_id % 4)::VARCHAR END AS category,
    {_coded('text')} AS requirement_text,
    CASE WHEN item_id % 2 = 0 THEN {_coded('line1')} END AS example_sentence,
    CASE WHEN item_id % 5 = 0 THEN {_coded('text')} END AS case_text
  FROM {BENCHMARK})"""

LEGAL_EXAMPLES = f"""legal_example AS (
  SELECT item_id AS row_id, CASE WHEN item_id % 3 = 0 THEN '14' ELSE (item_id % 18 + 1)::VARCHAR END AS item_no,
    CASE WHEN item_id % 4 = 1 THEN 'table' END AS reference_type,
    CASE WHEN item_id % 7 > 2 THEN 'summary' END AS reference_subtype,
    {_coded('text')} AS content
  FROM {BENCHMARK})"""

TACIT = f"""tacit AS (
  SELECT item_id AS row_id, CASE WHEN item_id % 12 = 0 THEN '{pack.COMMON_ITEM}' ELSE (item_id % 18 + 1)::VARCHAR END AS item_no,
    {_coded('line1')} AS title, {_coded('text')} AS content
  FROM {BENCHMARK})"""

REVIEWS = """review AS MATERIALIZED (
  SELECT l_orderkey AS document_id, (l_orderkey % 18 + 1)::VARCHAR AS item_no,
    l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + l_suppkey AS seq,
    CASE WHEN l_suppkey % 2 = 0 THEN 'rule_review' ELSE 'table_review' END AS route_type,
    CASE l_returnflag WHEN 'A' THEN '준수' WHEN 'N' THEN '미준수' ELSE '보완필요' END AS result,
    CASE WHEN l_tax < 0.01 THEN false WHEN l_linestatus = 'O' THEN true END AS is_target,
    round(0.95 - l_discount * 4, 3) AS confidence,
    CASE WHEN l_quantity > 45 THEN []::INT[] ELSE [l_linenumber, (l_linenumber + l_suppkey % 3)::INT] END AS evidence_pages,
    CASE WHEN l_quantity > 45 THEN []::VARCHAR[] ELSE
      ['line ' || l_linenumber || ' part ' || (l_partkey % 10), 'line ' || (l_linenumber + l_suppkey % 3) || ' part ' || (l_partkey % 10)] END AS evidence_text,
    'part ' || l_partkey || ' shipped' AS reason,
    CASE WHEN l_returnflag <> 'A' THEN 'check part ' || l_partkey ELSE '' END AS recommendation,
    l_tax > 0.06 AS needs_human_review,
    CASE WHEN l_quantity < 4 THEN 'llm_disabled' ELSE 'python_rule' END AS source
  FROM lineitem)"""

STATUSES = """parse_state AS (
  SELECT o_orderkey AS document_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'fail' ELSE 'ok' END AS parse_status FROM orders)"""

FINALS = f"""{PAGES},
final AS MATERIALIZED (
  SELECT document_id, (page_no % 18 + 1)::VARCHAR AS item_no, page_no,
    CASE WHEN text_length % 4 = 0 THEN '{pack.STATUS_AUTO}' ELSE '{pack.STATUS_HUMAN}' END AS final_status,
    {sql_list(inputs.RESULT_CYCLE)}[text_length % 8 + 1] AS final_result,
    CASE WHEN text_length % 7 = 0 THEN false WHEN text_length % 7 < 5 THEN true END AS is_target,
    0.4 + (text_length % 60) / 100.0::DOUBLE AS confidence,
    CASE WHEN text_length % 6 = 0 THEN []::INT[] ELSE [page_no, page_no + 1, (page_no + 1 + text_length % 3)::INT] END AS evidence_pages,
    CASE WHEN text_length % 6 = 0 THEN []::VARCHAR[] ELSE [substr(page_text, 1, length(page_text) // 2), substr(page_text, length(page_text) // 2 + 1), page_text] END AS evidence_text,
    substr(page_text, length(page_text) // 2 + 1) AS reason,
    CASE text_length % 5 WHEN 0 THEN ''
      WHEN 1 THEN '제안요청서 p.' || page_no || '에 ' || page_text || ' 명시하시기 바랍니다.'
      WHEN 2 THEN '누락된 필수 문구를 보완하시기 바랍니다. ' || page_text
      WHEN 3 THEN substr(page_text, 1, length(page_text) // 2) || ' -> 제안요청서에 ' || substr(page_text, length(page_text) // 2 + 1) || ' 예를 들어 ' || substr(page_text, 1, length(page_text) // 2)
      ELSE '제안서 ' || page_text END AS recommendation,
    CASE WHEN text_length % 9 = 0 THEN ['low'] ELSE []::VARCHAR[] END AS warnings,
    text_length, page_text
  FROM page)"""

FEEDBACK = """feedback AS (
  SELECT conv_id AS document_id, (turn + 1)::INT AS page_no,
    CASE WHEN (conv_id + turn) % 3 = 0 THEN text ELSE '' END AS comment,
    ['', '준수', '미준수', '보완필요', '해당없음'][(conv_id + turn) % 5 + 1] AS corrected_result,
    CASE WHEN (conv_id + turn) % 4 = 0 THEN text ELSE '' END AS manual_content,
    (conv_id + turn) % 2 = 0 AS manual_edited,
    role = 'assistant' AS resolved
  FROM conversations)"""

EVENTS = """parse_event AS MATERIALIZED (
  SELECT user_id AS job_id, (event_id % 50 + 1)::INT AS page_no,
    CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'queued' END AS status,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN value > 15 THEN 'gpt' ELSE 'python_prescan' END ELSE '' END AS source,
    CASE WHEN event_type = 'error' THEN 'value ' || value ELSE '' END AS error,
    event_id AS version
  FROM events)"""


def loose(keyword: str) -> str:
    import re

    return "(?i)" + f"{WS}*".join(re.escape(ch) for ch in "".join(keyword.split()))


def window(t: str, keyword: str, radius: int, fallback: str | None = None, exact: bool = False) -> str:
    """Window around the first loose (or exact) occurrence of a keyword."""
    m = quote(keyword) if exact else f"regexp_extract({t}, '{loose(keyword)}', 0)"
    hit = f"contains({t}, {m})" if exact else f"{m} <> ''"
    p = f"(instr({t}, {m}) - 1)"
    start = f"greatest({p} - {radius}, 0)"
    stop = f"least({p} + length({m}) + {radius}, length({t}))"
    cut = collapse(f"substr({t}, {start} + 1, {stop} - {start})")
    other = fallback or f"substr({collapse(t)}, 1, 180)"
    return f"CASE WHEN {hit} THEN {cut} ELSE {other} END"


def first_window(t: str, low: str, keywords, radius: int) -> str:
    cases = " ".join(
        f"WHEN contains({low}, {quote(''.join(k.split()).lower())}) THEN {window(t, k, radius)}" for k in keywords
    )
    return f"CASE {cases} END"


AMOUNT = f"[0-9,]+(?:\\.[0-9]+)?{WS}*(?:억원|억|천만원|천만|백만원|백만|만원|원)"


def amount(v: str) -> str:
    plain = f"replace(replace({v}, ',', ''), ' ', '')"
    number = f"TRY_CAST(regexp_extract({plain}, '[0-9]+(?:\\.[0-9]+)?', 0) AS DOUBLE)"
    return (
        f"CASE WHEN {number} IS NULL THEN 0 WHEN contains({plain}, '억') THEN trunc({number} * 100000000) WHEN contains({plain}, '천만') THEN trunc({number} * 10000000) "
        f"WHEN contains({plain}, '백만') THEN trunc({number} * 1000000) WHEN contains({plain}, '만원') THEN trunc({number} * 10000) WHEN contains({plain}, '원') THEN trunc({number}) ELSE 0 END::BIGINT"
    )


def spans(source: str, text: str, regex: str, columns: str, name: str) -> str:
    """CTE `name`: one row per match with k, value and the zero-based start, by cumulative lengths."""
    return f"""{name}_part AS (
  SELECT {columns}, {text} AS t, regexp_extract_all({text}, '{regex}') AS ms, regexp_split_to_array({text}, '{regex}') AS gaps FROM {source}),
{name} AS (
  SELECT {columns}, t, k::INT AS k, ms[k] AS value,
    (list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda m: length(m))), 0))::BIGINT AS start
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM {name}_part))"""


def round_thousandths(value: str) -> str:
    """SQL that rounds a DOUBLE from 0 to below 2 to three places by its exact binary value."""
    m = f"((({value})::DOUBLE * pow(2, 62))::HUGEINT * 1000)"
    whole, rest = f"({m} // 4611686018427387904::HUGEINT)", f"({m} % 4611686018427387904::HUGEINT)"
    return f"(({whole} + CASE WHEN {rest} > 2305843009213693952::HUGEINT OR ({rest} = 2305843009213693952::HUGEINT AND {whole} % 2 = 1) THEN 1 ELSE 0 END) / 1000.0::DOUBLE)"
