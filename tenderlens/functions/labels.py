"""Result labels and page-number notation as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.rules import pack

FOUR = [pack.COMPLIANT, pack.NON_COMPLIANT, pack.SUPPLEMENT, pack.NOT_APPLICABLE]


def wording_label(result: Column, target: Column) -> Column:
    """Label for report wording; garbled legacy prefixes are understood."""
    t = tx.strip(result)

    def starts(prefixes):
        return F.lit(False) if not prefixes else t.rlike("^(?:" + "|".join(tx.re.escape(p) for p in prefixes) + ")")

    return (
        F.when(~F.coalesce(target, F.lit(True)), pack.NOT_APPLICABLE)
        .when(t.isin(FOUR), t)
        .when(starts(pack.LEGACY_COMPLIANT), pack.COMPLIANT)
        .when(starts(pack.LEGACY_NON_COMPLIANT), pack.NON_COMPLIANT)
        .when(starts(pack.LEGACY_SUPPLEMENT), pack.SUPPLEMENT)
        .when(starts(pack.LEGACY_NOT_APPLICABLE), pack.NOT_APPLICABLE)
        .otherwise(t)
    )


def report_label(item: Column, result: Column, target: Column, status: Column) -> Column:
    t = F.trim(F.coalesce(result, F.lit("")))
    sixteen = F.when(target.isNull(), "대상여부 확인필요").when(target, "대상").otherwise("비대상")
    return (
        F.when(item == "16", sixteen)
        .when(t.isin(FOUR[:3]), t)
        .when(t.isin("비대상", pack.NOT_APPLICABLE) | ~F.coalesce(target, F.lit(True)), pack.NOT_APPLICABLE)
        .when((status == pack.STATUS_AUTO) & (t != ""), t)
        .otherwise(pack.SUPPLEMENT)
    )


def service_label(result: Column) -> Column:
    """Label by the first sign found in a free result text."""
    t = tx.strip(result)
    return (
        F.when(t.contains("미준수"), pack.NON_COMPLIANT)
        .when(t.contains("보완"), pack.SUPPLEMENT)
        .when(t.contains("확인요망") | t.contains("확인 필요"), pack.CONFIRM)
        .when(t.contains("해당없음") | t.contains("해당 없음"), pack.NOT_APPLICABLE)
        .when(t.contains("준수"), pack.COMPLIANT)
        .otherwise(t)
    )


def screen_status(raw: Column, target: Column) -> Column:
    """Status key shown on the review screen."""
    t = tx.strip(raw)
    return (
        F.when(t == "", "unknown")
        .when(~F.coalesce(target, F.lit(True)), "na")
        .when(t.rlike("(?i)미준수|위반|non[-_ ]?compliant|noncompliant"), "noncompliant")
        .when(t.rlike("(?i)보완|수정|revision|needs?[-_ ]?revision"), "revision")
        .when(t.rlike("(?i)해당\\s*없음|해당없음|not[-_ ]?applicable|n/?a"), "na")
        .when(t.rlike("(?i)준수|적합|compliant|pass"), "compliant")
        .otherwise("unknown")
    )


def aliased(value: Column, aliases: dict[str, str]) -> Column:
    t = tx.strip(value)
    out = t
    for k, v in aliases.items():
        out = F.when(t == k, v).otherwise(out)
    return out


def judgement_label(value: Column) -> Column:
    """Label of an external judgement: one of four, aliases understood, anything else needs supplement."""
    t = tx.strip(value)
    out = F.when(t.isin(FOUR), t)
    for k, v in pack.JUDGEMENT_ALIASES.items():
        out = out.when(t == k, v)
    return out.otherwise(pack.SUPPLEMENT)


def accuracy_label(value: Column) -> Column:
    return aliased(value, pack.ACCURACY_ALIASES)


# --- page notation ---------------------------------------------------------------------------------


def page_ranges(pages: Column) -> Column:
    """Runs of consecutive numbers as array<struct<a,b>> of the sorted distinct pages."""
    ordered = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull())))
    empty = F.expr("cast(array() as array<struct<a:int,b:int>>)")

    def step(acc: Column, p: Column) -> Column:
        n = F.size(acc)
        last = F.try_element_at(acc, n)
        one = F.struct(p.alias("a"), p.alias("b"))
        grown = F.concat(F.slice(acc, 1, n - 1), F.array(F.struct(last["a"].alias("a"), p.alias("b"))))
        return F.when(n == 0, F.array(one)).when(last["b"] + 1 == p, grown).otherwise(F.array_append(acc, one))

    return F.aggregate(ordered, empty, step)


def format_pages(pages: Column) -> Column:
    """`p.3, pp.5-7`."""

    def one(r: Column) -> Column:
        run = F.concat(F.lit("pp."), r["a"].cast("string"), F.lit("-"), r["b"].cast("string"))
        return F.when(r["a"] == r["b"], F.concat(F.lit("p."), r["a"].cast("string"))).otherwise(run)

    return F.array_join(F.transform(page_ranges(pages), one), ", ")


def format_pages_report(pages: Column) -> Column:
    """`p.3` for a single page, else `pp.` and at most five ranges."""

    def one(r: Column) -> Column:
        return F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat(r["a"].cast("string"), F.lit("-"), r["b"].cast("string")))

    def shape(ranges: Column) -> Column:
        single = (F.size(ranges) == 1) & (ranges[0]["a"] == ranges[0]["b"])
        listed = F.concat(F.lit("pp."), F.array_join(F.slice(F.transform(ranges, one), 1, 5), ", "))
        return F.when(F.size(ranges) == 0, "").when(single, F.concat(F.lit("p."), ranges[0]["a"].cast("string"))).otherwise(listed)

    return tx.let(page_ranges(pages), shape)
