"""Column functions over page text.  All run inside the JVM; none is a Python UDF."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Unicode counts as white space, as a Java character class.
SPACE = "\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The same characters one by one.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = "[0-9A-Za-z가-힣]{2,}"
FOOTER = f"(?:^|\\n)[{SPACE}]*-[{SPACE}]*(\\d{{1,4}})[{SPACE}]*-[{SPACE}]*$"
ATTACHMENT_DROP = SPACES + ":：,，.ㆍ·-_/()[]{}<>「」『』"


def let(value: Column, body) -> Column:
    """Bind `value` once and use it several times in `body`."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def compact(c: Column) -> Column:
    return F.translate(text_or_empty(c), SPACES, "")


def compact_lower(c: Column) -> Column:
    return F.lower(compact(c))


def compact_attachment(c: Column) -> Column:
    return F.translate(text_or_empty(c), ATTACHMENT_DROP, "")


def collapse(c: Column) -> Column:
    def single(t: Column) -> Column:
        return F.trim(F.when(t.contains("  "), F.regexp_replace(t, "  +", " ")).otherwise(t))

    return let(F.translate(text_or_empty(c), SPACES, " " * len(SPACES)), single)


def strip(c: Column) -> Column:
    return F.btrim(text_or_empty(c), F.lit(SPACES))


def text_length(c: Column) -> Column:
    """Code points other than blank and newline."""
    return F.length(F.translate(text_or_empty(c), " \n", ""))


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def first_int(c: Column) -> Column:
    """First run of one to four digits, or null."""
    return F.nullif(F.regexp_extract(c.cast("string"), "[0-9]{1,4}", 0), F.lit("")).cast("int")


def strict_int(c: Column) -> Column:
    """Integer only when the whole value is one."""
    return F.when(strip(c.cast("string")).rlike("^[+-]?[0-9]+$"), strip(c.cast("string")).try_cast("int"))


def footer_page_no(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text_or_empty(text), FOOTER, 1), F.lit("")).cast("int")


def display_page_no(printed: Column, text: Column, page_no: Column) -> Column:
    return F.coalesce(printed, footer_page_no(text), page_no)


def display_page_no_simple(printed: Column, page_no: Column) -> Column:
    return F.coalesce(F.nullif(printed, F.lit(0)), page_no)


def strip_leading_page_no(text: Column, printed: Column) -> Column:
    """Drop a first line that repeats the printed number, and the white space after it."""
    source = text_or_empty(text)
    pattern = F.concat(
        F.lit(f"^[{SPACE}]*[-–—]?[{SPACE}]*"),
        printed.cast("string"),
        F.lit(f"[{SPACE}]*[-–—]?[{SPACE}]*(?:\\r?\\n)+"),
    )
    cut = F.regexp_replace(F.regexp_replace(source, pattern, F.lit("")), F.lit(f"^[{SPACE}]+"), F.lit(""))
    return F.when(printed.isNull(), source).otherwise(cut)


# --- term predicates -------------------------------------------------------------------------


def _plain_name(c: Column) -> str | None:
    """Name of a plain column reference, null for any other expression.

    Long term lists on a plain column go to the JVM as one SQL text instead of one call per term; the plan is
    the same chain of `contains` either way.
    """
    found = re.fullmatch(r"Column<'([A-Za-z]\w*|_[a-z]\w*)'>", repr(c))
    name = found.group(1) if found else None
    return None if name is None or re.fullmatch(r"[xyz]_\d+|namedlambdavariable", name) else name


def _sql_terms(name: str, terms: Sequence[str], glue: str, shape: str = "contains({c}, {t})") -> Column:
    quoted = ["'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in terms]
    return F.expr(glue.join(shape.format(c=f"`{name}`", t=q) for q in quoted))


def _bound(c: Column, terms: Sequence[str], body) -> Column:
    """`body` of `c`; inside a lambda, where Spark shares no common expression, a computed `c` is bound first."""
    variable = r"(?:[xyz]_\d+|namedlambdavariable\(\))"
    shown = repr(c)
    computed = re.search(rf"\b{variable}", shown) and not re.fullmatch(f"Column<'{variable}'>", shown)
    return let(c, body) if computed and len(terms) > 1 else body(c)


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    name = _plain_name(c)
    if name and terms:
        return _sql_terms(name, terms, " OR ")
    return _bound(c, terms, lambda x: reduce(lambda a, b: a | b, [x.contains(t) for t in terms], F.lit(False)))


def contains_all(c: Column, terms: Sequence[str]) -> Column:
    name = _plain_name(c)
    if name and terms:
        return _sql_terms(name, terms, " AND ")
    return _bound(c, terms, lambda x: reduce(lambda a, b: a & b, [x.contains(t) for t in terms], F.lit(True)))


def count_terms(c: Column, terms: Sequence[str]) -> Column:
    name = _plain_name(c)
    if name and terms:
        return _sql_terms(name, terms, " + ", "cast(contains({c}, {t}) as int)")
    return _bound(c, terms, lambda x: reduce(lambda a, b: a + b, [x.contains(t).cast("int") for t in terms], F.lit(0)))


def squeeze(keyword: str) -> str:
    return "".join(keyword.split())


def loose_any(lowered_compact: Column, keywords: Sequence[str]) -> Column:
    """White-space and case insensitive containment, on a text already compacted and lowered."""
    return contains_any(lowered_compact, [squeeze(k).lower() for k in keywords])


def loose_count(lowered_compact: Column, keywords: Sequence[str]) -> Column:
    return count_terms(lowered_compact, [squeeze(k).lower() for k in keywords])


# --- windows around a match -------------------------------------------------------------------


def loose_regex(keyword: str) -> str:
    return "(?iu)" + f"[{SPACE}]*".join(re.escape(ch) for ch in squeeze(keyword))


def exact_regex(keyword: str) -> str:
    return re.escape(keyword)


def around(text: Column, regex: str, radius: int) -> Column:
    """Text within `radius` code points of the first match of `regex`, white space collapsed; null on a miss."""

    def window(parts: Column) -> Column:
        before = F.length(parts[0])
        after = F.length(parts[1])
        start = F.greatest(before - radius, F.lit(0))
        stop = F.length(text) - F.greatest(after - radius, F.lit(0))
        return F.when(F.size(parts) == 2, collapse(F.substring(text, start + 1, stop - start)))

    return let(F.split(text, regex, 2), window)


def evidence_window(text: Column, keyword: str, radius: int = 80) -> Column:
    """Loose search; the first 180 collapsed characters when the keyword is absent."""
    source = text_or_empty(text)
    fallback = head(collapse(source), 180)
    if not squeeze(keyword):
        return fallback
    return F.coalesce(around(source, loose_regex(keyword), radius), fallback)


def exact_window(text: Column, keywords: Sequence[str], radius: int = 360) -> Column:
    """Window of the first keyword, in order, that occurs exactly; otherwise the first 500 characters."""
    source = text_or_empty(text)
    found = [F.when(source.contains(k), around(source, exact_regex(k), radius)) for k in keywords]
    return F.coalesce(*found, head(collapse(source), 500))


def first_keyword_window(text: Column, lowered_compact: Column, keywords: Sequence[str], radius: int) -> Column:
    """Window of the first keyword, in order, that occurs loosely; null when none does."""
    source = text_or_empty(text)
    hits = [F.when(loose_any(lowered_compact, [k]), around(source, loose_regex(k), radius)) for k in keywords]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def match_spans(text: Column, regex: str) -> Column:
    """All matches as array<struct<start, stop, value>>, with zero-based code-point offsets."""
    source = text_or_empty(text)

    def build(gaps: Column) -> Column:
        values = F.regexp_extract_all(source, F.lit(f"({regex})"), F.lit(1))
        empty = F.expr("cast(array() as array<struct<start:int,stop:int,value:string>>)")
        state = F.struct(F.lit(0).alias("offset"), empty.alias("spans"))
        pairs = F.arrays_zip(gaps.alias("gap"), values.alias("value"))

        def step(acc: Column, pair: Column) -> Column:
            start = acc["offset"] + F.length(pair["gap"])
            stop = start + F.length(F.coalesce(pair["value"], F.lit("")))
            span = F.struct(start.alias("start"), stop.alias("stop"), pair["value"].alias("value"))
            return F.struct(stop.alias("offset"), F.array_append(acc["spans"], span).alias("spans"))

        return F.aggregate(F.filter(pairs, lambda p: p["value"].isNotNull()), state, step, lambda acc: acc["spans"])

    return let(F.split(source, regex, -1), build)


def context(text: Column, span: Column, before: int, after: int) -> Column:
    start = F.greatest(span["start"] - before, F.lit(0))
    stop = F.least(span["stop"] + after, F.length(text))
    return F.substring(text, start + 1, stop - start)


# --- amounts and scores ------------------------------------------------------------------------

# The amount notation of the documents.
AMOUNT_UNITS = [("억", 100_000_000), ("천만", 10_000_000), ("백만", 1_000_000), ("만원", 10_000), ("원", 1)]
AMOUNT_REGEX = f"[\\d,]+(?:\\.\\d+)?[{SPACE}]*(?:억원|억|천만원|천만|백만원|백만|만원|원)"


def parse_amount(value: Column) -> Column:
    """Won, truncated; 0 when there is neither a number nor a unit."""
    plain = F.translate(text_or_empty(value), ", ", "")
    number = F.regexp_extract(plain, "\\d+(?:\\.\\d+)?", 0).try_cast("double")
    amount = reduce(
        lambda acc, unit: acc.when(plain.contains(unit[0]), (number * unit[1]).cast("long")),
        AMOUNT_UNITS,
        F.when(number.isNull(), F.lit(0).cast("long")),
    )
    return amount.otherwise(F.lit(0).cast("long"))


def format_amount(won: Column) -> Column:
    """Hundred-millions with at most one decimal, rounded as the binary quotient rounds.

    Half a tenth is settled by the exact distance of the double quotient from the tie, in 58-bit fractions.
    """
    unit, tenth, bits = 100_000_000, 10_000_000, 1 << 58
    whole, rest = F.floor(won / F.lit(unit)).cast("long"), won % unit
    digit, below = F.floor(rest / F.lit(tenth)).cast("long"), rest % tenth
    quotient = won / F.lit(float(unit))
    fraction = ((quotient - F.floor(quotient)) * F.lit(float(bits))).cast("long")
    gap = fraction * 20 - (digit * 2 + 1) * F.lit(bits)
    tie_up = (gap > 0) | ((gap == 0) & (digit % 2 == 1))
    up = (below > tenth // 2) | ((below == tenth // 2) & tie_up)
    tenths = whole * 10 + digit + up.cast("long")
    head_, tail = F.floor(tenths / F.lit(10)).cast("long").cast("string"), tenths % 10
    return F.concat(head_, F.when(tail > 0, F.concat(F.lit("."), tail.cast("string"))).otherwise(""), F.lit("억 원"))


def max_amount_near(text: Column, keywords: Sequence[str], radius: int = 80) -> Column:
    source = text_or_empty(text)
    near = F.filter(
        match_spans(source, AMOUNT_REGEX), lambda s: contains_any(context(source, s, radius, radius), keywords)
    )
    return F.coalesce(F.array_max(F.transform(near, lambda s: parse_amount(s["value"]))), F.lit(0).cast("long"))


def max_score(text: Column) -> Column:
    """Largest number that is followed by the score unit or ends the text."""
    found = F.regexp_extract_all(
        text_or_empty(text), F.lit(f"(?<!\\d)(\\d+(?:\\.\\d+)?)(?=[{SPACE}]*(?:점|$))"), F.lit(1)
    )
    return F.coalesce(F.array_max(F.transform(found, lambda v: v.cast("double"))), F.lit(0.0))


# --- tokens ------------------------------------------------------------------------------------


def words(text: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(f"({WORD})"), F.lit(1))


def content_tokens(text: Column, stopwords: Sequence[str], lower: bool = True) -> Column:
    tokens = words(F.lower(text_or_empty(text)) if lower else text)
    return F.filter(tokens, lambda t: ~t.isin(list(stopwords)))


def combine_text(*values: Column) -> Column:
    """Distinct non-blank texts joined by newline, first occurrence first."""
    parts = F.filter(F.array(*[strip(v) for v in values]), lambda v: v != "")
    return F.array_join(F.array_distinct(parts), "\n")


def ellipsis(text: Column, limit: int) -> Column:
    """Collapsed text, or its first limit - 3 characters and dots when it is longer than `limit`.

    Four times `limit` characters nearly always hold enough; the whole text is collapsed only where they do not.
    """
    def cut(flat: Column) -> Column:
        return F.concat(F.rtrim(head(flat, limit - 3), F.lit(SPACES)), F.lit("..."))

    def whole(flat: Column) -> Column:
        return F.when(F.length(flat) <= limit, flat).otherwise(cut(flat))

    return let(collapse(head(text, 4 * limit)), lambda start: F.when(F.length(start) > limit, cut(start)).otherwise(let(collapse(text), whole)))


def join_ints(values: Column, separator: str = ",") -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), separator, "null")


def round_thousandths(value: Column) -> Column:
    """A share from 0 to below 2 rounded to three places by its exact binary value; only an exact tie goes to the even digit.

    Rounding the shortest decimal form would send 0.8875, which is stored as a little less, up instead of down.
    """
    one = F.lit(1 << 62).cast("decimal(20,0)")
    thousands = (value * F.lit(float(1 << 62))).cast("bigint").cast("decimal(20,0)") * F.lit(1000).cast("decimal(4,0)")
    rest = thousands % one
    whole = ((thousands - rest) / one).cast("bigint")
    half = F.lit(1 << 61).cast("decimal(20,0)")
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    return (whole + up.cast("bigint")) / F.lit(1000.0)
