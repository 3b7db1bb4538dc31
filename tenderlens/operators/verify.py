"""Verification of review rows: votes, status, audit findings, merging of sub-items, resume."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.operators import blocks
from tenderlens.operators import evidence as ev
from tenderlens.rules import pack
from tenderlens.schema import FINAL_REVIEW
from tenderlens.session import cut_lineage

KEY = ["document_id", "item_no"]
NO_TEXTS = "cast(array() as array<string>)"


# --- routes and items --------------------------------------------------------------------------------------


def route_of(item: Column) -> Column:
    route = F.lit("llm")
    for name, items in pack.ROUTES.items():
        route = F.when(F.trim(item).isin(items), name).otherwise(route)
    return route


def route_items(rows: DataFrame) -> DataFrame:
    return rows.withColumn("route", route_of(F.col("item_no")))


def expand_items(requests: DataFrame) -> DataFrame:
    """Requests (request_id, items, group_name) -> items in order, each once; 2 brings 2-1; default 1 to 18."""
    named = F.lit(None).cast("array<string>")
    for group, items in pack.ITEM_GROUPS.items():
        named = F.when(F.col("group_name") == group, F.array(*[F.lit(i) for i in items])).otherwise(named)
    given = F.filter(F.transform(F.split(F.coalesce("items", F.lit("")), ","), tx.strip), lambda i: i != "")
    default = F.array(*[F.lit(i) for i in pack.DEFAULT_ITEMS])
    chosen = F.coalesce(named, F.when(F.length("items") > 0, given), default)
    both = F.transform(chosen, lambda i: F.when(i == "2", F.array(F.lit("2"), F.lit("2-1"))).otherwise(F.array(i)))
    return requests.select("request_id", F.posexplode(F.array_distinct(F.flatten(both))).alias("position", "item_no"))


# --- votes and status -------------------------------------------------------------------------------------------


def is_active() -> Column:
    return ~F.col("source").isin(pack.IGNORED_SOURCES)


def is_grounded() -> Column:
    return is_active() & (F.size("evidence_pages") > 0) & (F.size("evidence_text") > 0)


def vote(review: DataFrame) -> DataFrame:
    """Leading (result, is_target) of the grounded reviews, the first seen on ties, and how many pairs there are."""
    counted = review.filter(is_grounded()).groupBy(*KEY, "result", "is_target").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")
    )
    lead = F.min_by(F.struct("result", "is_target", "n"), F.struct((-F.col("n")).alias("n"), "first_seq"))
    return counted.groupBy(*KEY).agg(lead.alias("v"), F.count(F.lit(1)).alias("distinct_votes")).select(
        *KEY, "v.result", "v.is_target", F.col("v.n").alias("votes"), "distinct_votes"
    )


def _payload() -> Column:
    names = ["result", "is_target", "confidence", "evidence_pages", "evidence_text", "reason", "recommendation"]
    return F.struct(*names)


def _place() -> Column:
    """Order of preference: with pages, confident, early."""
    return F.struct((F.size("evidence_pages") <= 0).cast("int").alias("a"), (-F.col("confidence")).alias("b"), "seq")


def _best(when: Column) -> list[Column]:
    return [F.min_by(_payload(), F.when(when, _place())), F.min(F.when(when, _place()))]


def choose_final(chosen: DataFrame, status: Column, warnings: Column) -> DataFrame:
    """Final rows from the chosen review `c`; confidence is capped unless the status is automatic."""
    free = status.isin(pack.STATUS_AUTO, pack.STATUS_ESCALATED)
    confidence = F.when(free, F.col("c.confidence")).otherwise(F.least(F.col("c.confidence"), F.lit(0.69)))
    return chosen.select(
        *KEY, status.alias("final_status"), F.col("c.result").alias("final_result"), F.col("c.is_target").alias("is_target"),
        tx.round_thousandths(confidence).alias("confidence"), F.col("c.evidence_pages").alias("evidence_pages"), F.col("c.evidence_text").alias("evidence_text"),
        F.col("c.reason").alias("reason"), F.col("c.recommendation").alias("recommendation"), warnings.alias("warnings"),
    ).select(*FINAL_REVIEW.fieldNames())


def verify(review: DataFrame, documents: DataFrame, escalated: DataFrame | None = None, conflict_threshold: int = 2) -> DataFrame:
    """One final row per (document, item).

    All that the status tree asks of a group is combined by (key, vote) first and by key second, so a group of any
    size is reduced in the map tasks and no review row is joined back.  `documents` gives parse_status.
    """
    active, grounded = is_active(), is_grounded()
    off = active & (~F.coalesce("is_target", F.lit(True)) | (tx.strip(F.col("result")) == pack.NOT_APPLICABLE))
    best = {"all": F.lit(True), "active": active, "grounded": grounded, "off": off}
    calm = F.struct((-F.col("confidence")).alias("b"), "seq")
    votes = review.groupBy(*KEY, "result", "is_target").agg(
        F.count_if(active).alias("n_active"), F.count_if(off).alias("n_off"), F.count_if(grounded).alias("n_grounded"),
        F.min(F.when(grounded, F.col("seq"))).alias("first_seq"), F.bool_or(F.when(grounded, F.col("needs_human_review"))).alias("human"),
        F.min_by(F.struct("needs_human_review", "confidence", _payload().alias("p")), F.when(off, calm)).alias("calm"), F.min(F.when(off, calm)).alias("calm_at"),
        *[c.alias(f"{side}_{name}") for name, when in best.items() for side, c in zip(("row", "at"), _best(when))],
    )
    lead_place = F.when(F.col("n_grounded") > 0, F.struct((-F.col("n_grounded")).alias("n"), "first_seq"))
    state = votes.groupBy(*KEY).agg(
        F.sum("n_active").alias("n_active"), F.sum("n_off").alias("n_off"), F.sum("n_grounded").alias("n_grounded"),
        F.count_if(F.col("n_grounded") > 0).alias("conflicts"),
        F.min_by(F.struct("result", "n_grounded", "human", F.col("row_grounded").alias("p")), lead_place).alias("lead"),
        F.min_by("calm", "calm_at").alias("calm"),
        *[F.min_by(f"row_{n}", f"at_{n}").alias(f"row_{n}") for n in best],
        *[F.min(f"at_{n}").alias(f"at_{n}") for n in ("active",)],
    )
    state = state.join(documents.select("document_id", "parse_status"), "document_id", "left")
    auto = F.col("lead.result").isin(pack.AUTO_FINAL_RESULTS)
    only = F.col("row_grounded")
    unanimous = (F.col("n_off") == F.col("n_active")) & (F.col("n_off") > 0) & ~F.col("calm.needs_human_review") & (F.col("calm.confidence") >= 0.7)
    single_ok = auto & ~F.coalesce(F.col("lead.human"), F.lit(False)) & (only["confidence"] >= 0.7)
    majority = (F.col("lead.n_grounded") >= 2) & auto & ~F.coalesce(F.col("lead.human"), F.lit(False))
    held = F.coalesce(F.col("parse_status") == "fail", F.lit(False))
    none, ungrounded, one = F.col("n_active") == 0, F.col("n_grounded") == 0, F.col("n_grounded") == 1
    if escalated is not None:
        settled = attach_grounded_evidence(escalated, review)
        state = state.join(settled.select(*KEY, F.struct(*[F.col(n) for n in ["result", "is_target", "confidence", "evidence_pages", "evidence_text", "reason", "recommendation"]]).alias("esc")), KEY, "left")
        lifted = F.col("esc").isNotNull() & (F.col("conflicts") >= conflict_threshold)
        esc_place = F.struct((F.size("esc.evidence_pages") <= 0).cast("int").alias("a"), (-F.col("esc.confidence")).alias("b"), F.lit(1 << 62).cast("long").alias("seq"))
        esc_row = F.when(esc_place < F.col("at_active"), F.col("esc")).otherwise(F.col("row_active"))
    else:
        lifted, esc_row = F.lit(False), F.col("row_active")

    def pick(values: list) -> Column:
        no_one, fail, agreed, bare, raised, alone_ok, alone, most, clash, rest = [v if isinstance(v, Column) else F.lit(v) for v in values]
        return (
            F.when(none, no_one).when(held, fail).when(unanimous, agreed).when(ungrounded, bare).when(lifted, raised)
            .when(one & single_ok, alone_ok).when(one, alone).when(majority, most).when(F.col("conflicts") > 1, clash).otherwise(rest)
        )

    status = pick([
        pack.STATUS_HUMAN, pack.STATUS_PARSE_HOLD, pack.STATUS_AUTO, pack.STATUS_NO_EVIDENCE, pack.STATUS_ESCALATED, pack.STATUS_AUTO,
        pack.STATUS_HUMAN, pack.STATUS_AUTO, pack.STATUS_CONFLICT, pack.STATUS_HUMAN,
    ])
    g = F.col("row_grounded")
    row = pick([F.col("row_all"), F.col("row_active"), F.col("calm.p"), F.col("row_active"), esc_row, g, g, F.col("lead.p"), g, g])
    empty = F.expr(NO_TEXTS)

    def said(text: str) -> Column:
        return F.array(F.lit(text))

    warnings = pick([said(pack.WARN_NO_ACTIVE), said(pack.WARN_PARSE_FAIL), empty, said(pack.WARN_UNGROUNDED), empty, empty, empty, empty, said(pack.WARN_CONFLICT), empty])
    settled_rows = state.select(*KEY, status.alias("_s"), row.alias("c"), warnings.alias("_w"))
    return choose_final(settled_rows, F.col("_s"), F.col("_w"))


def attach_grounded_evidence(escalated: DataFrame, review: DataFrame) -> DataFrame:
    """Evidence of an escalated row = pairs of the grounded reviews that agree with it, else of all grounded ones.

    The first text of each page is kept, pages ascending.
    """
    verdict = escalated.select(*KEY, F.col("result").alias("_r"), F.col("is_target").alias("_t"))
    grounded = review.filter(is_grounded()).select(*KEY, "seq", "result", "is_target", "evidence_pages", "evidence_text").join(verdict, KEY)
    agrees = (F.col("result") == F.col("_r")) & F.col("is_target").eqNullSafe(F.col("_t"))
    pairs = ev.evidence_pairs(grounded.withColumn("agrees", agrees), [*KEY, "seq", "agrees"])
    first = pairs.groupBy(*KEY, "agrees", "page").agg(F.min_by("text", F.struct("seq", "pos")).alias("text"))
    listed = first.groupBy(*KEY, "agrees").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("e"))
    best = listed.groupBy(*KEY).agg(F.max_by("e", F.col("agrees").cast("int")).alias("e"))
    return escalated.join(best, KEY, "left").withColumn(
        "evidence_pages", F.coalesce(F.transform("e", lambda p: p["page"]), F.expr("cast(array() as array<int>)"))
    ).withColumn("evidence_text", F.coalesce(F.transform("e", lambda p: p["text"]), F.expr(NO_TEXTS))).drop("e")


# --- audit findings ---------------------------------------------------------------------------------------------------


def important_terms(text: Column) -> Column:
    return F.filter(tx.words(text), lambda t: ~t.isin(pack.IMPORTANT_STOPWORDS))


def requirement_supported(requirement: Column, evidence: Column) -> Column:
    """At least 70% (half up, one at least) of the requirement's terms occur in the evidence."""
    return terms_supported(lowered_terms(requirement), tx.compact_lower(evidence))


def lowered_terms(requirement: Column) -> Column:
    return F.transform(important_terms(requirement), F.lower)


def terms_supported(terms: Column, lowered: Column) -> Column:
    """`requirement_supported` of prepared sides: terms settled once a requirement, text once a review, before they are paired."""

    def judge(b: Column) -> Column:
        found = F.size(F.filter(b["terms"], lambda t: F.contains(b["text"], t)))
        n = F.size(b["terms"])
        need = F.greatest(F.lit(1), F.floor(n * F.lit(0.7) + F.lit(0.5)).cast("int"))
        return F.when(n == 0, F.lit(True)).when(n == 1, found > 0).otherwise(found >= need)

    return tx.let(F.struct(terms.alias("terms"), lowered.alias("text")), judge)


def is_compliant(result: Column) -> Column:
    return (tx.strip(result) == pack.COMPLIANT) | tx.strip(result).startswith("以")


def route_matches(expected: Column, actual: Column) -> Column:
    want, got = F.trim(expected), F.trim(actual)
    return (want == "") | (got == want) | got.startswith(want) | got.contains(F.concat(want, F.lit("_")))


# Messages of the findings.
M_ALIGN = "evidence_pages and evidence_text counts are not aligned."
M_PAGE = "Evidence text was not found on page "
M_REQUIREMENT = "Required atomic requirement is not supported by evidence_text: "
M_REASON = "Reason contains important claims that are not visible in evidence_text."
M_STRENGTH = "Primary result is compliant, but required support is missing or invalid."


def page_by_number(page: DataFrame) -> DataFrame:
    """Page row that a cited number means: physical or printed, the later page on clashes."""
    numbers = page.select(
        "document_id", "page_no", "seq",
        F.explode(F.array_compact(F.array("page_no", "printed_page_no"))).alias("number"),
    )
    return numbers.groupBy("document_id", "number").agg(F.max(F.struct("page_no", "seq")).alias("p")).select(
        "document_id", "number", "p.page_no", "p.seq"
    )


def first_unseen(told: Column, seen: Column, n: int) -> Column:
    """First n of the told terms, repeats included, that are not among the seen ones.

    They are among the first n distinct ones, which are found by hashing; a search of all seen terms for each told one would grow
    with the square of a text.
    """

    def among(new: Column) -> Column:
        return F.when(F.size(new) > 0, F.slice(F.filter(told, lambda t: F.array_contains(new, t)), 1, n)).otherwise(F.expr(NO_TEXTS))

    return tx.let(F.slice(F.array_except(told, seen), 1, n), among)


def audit_findings(
    review: DataFrame, page: DataFrame | None = None, routes: DataFrame | None = None, requirements: DataFrame | None = None,
    key: Sequence[str] = ("document_id", "item_no", "seq"),
) -> DataFrame:
    """Defects of primary reviews, one row each.

    routes: item_no, expected_route.  requirements: item_no, requirement_id, requirement_text.
    """
    key = list(key)
    evidence = F.array_join(F.transform("evidence_text", lambda t: F.coalesce(t, F.lit(""))), " ")
    base = review.select(*key, "route_type", "result", "reason", "evidence_pages", "evidence_text", evidence.alias("_evidence"))

    def finding(df: DataFrame, kind: str, severity, message, requirement=None, observed=None) -> DataFrame:
        sev = severity if isinstance(severity, Column) else F.lit(severity)
        msg = message if isinstance(message, Column) else F.lit(message)
        return df.select(
            *key, "result", F.lit(kind).alias("finding_type"), sev.alias("severity"), msg.alias("message"),
            (F.lit(None).cast("string") if requirement is None else requirement).alias("requirement_id"),
            (F.expr(NO_TEXTS) if observed is None else observed).alias("evidence_observed"),
        )

    out = [finding(base.filter(F.size("evidence_pages") != F.size("evidence_text")), "schema_or_consistency_error", "medium", M_ALIGN)]
    if routes is not None:
        routed = base.join(routes, "item_no").filter(~route_matches(F.col("expected_route"), F.col("route_type")))
        text = F.concat(F.lit("Expected "), F.col("expected_route"), F.lit(" route, but primary review route was "), F.col("route_type"), F.lit("."))
        out.append(finding(routed, "invalid_routing", "high", text))
    if page is not None:
        zipped = base.select(*key, "result", F.explode(F.arrays_zip(F.col("evidence_pages").alias("page"), F.col("evidence_text").alias("text"))).alias("p"))
        cited = zipped.filter("p.page is not null and length(p.text) > 0").select(*key, "result", F.col("p.page").alias("number"), F.col("p.text").alias("text"))
        placed = cited.join(page_by_number(page), ["document_id", "number"]).withColumnRenamed("seq", "_page_seq") if "seq" not in key else cited.join(
            page_by_number(page).withColumnRenamed("seq", "_page_seq"), ["document_id", "number"])
        texts = page.select("document_id", "page_no", F.col("seq").alias("_page_seq"), tx.compact_lower(F.col("page_text")).alias("_t")).filter("_t <> ''")
        probe = tx.head(tx.compact_lower(F.col("text")), 80)
        wrong = placed.join(texts, ["document_id", "page_no", "_page_seq"]).filter(~F.contains(F.col("_t"), probe))
        out.append(finding(wrong, "invalid_evidence_page", "high", F.concat(F.lit(M_PAGE), F.col("number").cast("string"), F.lit(".")), None, F.array("text")))
    if requirements is not None:
        told = requirements.filter(F.length("requirement_text") > 0).withColumn("_terms", lowered_terms(F.col("requirement_text")))
        asked = base.withColumn("_low", tx.compact_lower(F.col("_evidence"))).join(told, "item_no")
        missing = asked.filter(~terms_supported(F.col("_terms"), F.col("_low")))
        out.append(finding(
            missing, "missing_required_requirement", F.when(is_compliant(F.col("result")), "high").otherwise("medium"),
            F.concat(F.lit(M_REQUIREMENT), F.col("requirement_text")), F.nullif("requirement_id", F.lit("")), F.col("evidence_text"),
        ))
    terms = base.filter((F.length("reason") > 0) & (F.length("_evidence") > 0)).withColumn("_told", important_terms(F.col("reason")))
    unseen = terms.withColumn("_unseen", first_unseen(F.col("_told"), important_terms(F.col("_evidence")), 5))
    out.append(finding(unseen.filter(F.size("_unseen") >= 2), "evidence_reason_mismatch", "medium", M_REASON, None, F.col("_unseen")))
    found = reduce(lambda a, b: a.unionByName(b), out)
    weak = found.filter(F.col("finding_type").isin("missing_required_requirement", "invalid_evidence_page") & is_compliant(F.col("result")))
    overstated = finding(weak.select(*key, "result").distinct(), "overstated_judgement_strength", "high", M_STRENGTH)
    return found.unionByName(overstated).drop("result")


def audit_summary(findings: DataFrame, review: DataFrame, key: Sequence[str] = ("document_id", "item_no", "seq")) -> DataFrame:
    key = list(key)
    by_type = findings.groupBy(*key, "finding_type").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("severity") == "high").cast("int")).alias("h"), F.max((F.col("severity") == "medium").cast("int")).alias("m"))
    told = by_type.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("finding_type", "n"))).alias("t"), F.max("h").alias("h"), F.max("m").alias("m"), F.sum("n").alias("finding_count")
    )
    text = F.array_join(F.transform("t", lambda x: F.concat(x["finding_type"], F.lit(": "), x["n"].cast("string"))), ", ")
    joined = review.select(*key, "source").join(told, key, "left")
    return joined.select(
        *key, F.col("source").alias("audited_review_source"), (F.coalesce("h", F.lit(0)) + F.coalesce("m", F.lit(0)) == 0).alias("can_auto_accept"),
        (F.coalesce("h", F.lit(0)) == 1).alias("requires_adjudication"), F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
        F.coalesce(text, F.lit("No audit findings.")).alias("audit_summary"),
    )


def fallback_adjudication(review: DataFrame, requirements: DataFrame, key: Sequence[str] = ("document_id", "item_no", "seq")) -> DataFrame:
    """Requirement table of a review from its own evidence; the result itself stays."""
    key = list(key)
    evidence = F.array_join("evidence_text", " ")
    asked = review.select(*key, "result", "confidence", "evidence_pages", tx.compact_lower(evidence).alias("_e"))
    asked = asked.join(requirements.withColumn("_terms", lowered_terms(F.col("requirement_text"))), "item_no")
    met = terms_supported(F.col("_terms"), F.col("_e"))
    return asked.select(
        *key, F.col("result").alias("final_result"), "confidence", "requirement_id", F.when(met, "met").otherwise("not_found").alias("status"),
        F.when(met, F.col("evidence_pages")).otherwise(F.expr("cast(array() as array<int>)")).alias("evidence_pages"),
        F.when(met, "Supported by primary evidence.").otherwise("Not found in primary evidence.").alias("reason"),
    )


def adjudication_gaps(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """Requested requirement ids that an adjudication left out."""
    ids = [*KEY, "requirement_id"]
    return requested.filter(F.length("requirement_id") > 0).select(*ids).distinct().join(returned.select(*ids), ids, "left_anti")


# --- merging sub-items ------------------------------------------------------------------------------------------------------


def result_rank(result: Column) -> Column:
    rank = F.lit(1)
    for label, n in pack.RESULT_RANK.items():
        rank = F.when(tx.strip(result) == label, n).otherwise(rank)
    return rank


def pairs_of(pages: Column, texts: Column) -> Column:
    """Evidence pairs of the pages; a page without text gets an empty one."""
    zipped = F.arrays_zip(pages.alias("page"), texts.alias("text"))
    kept = F.filter(zipped, lambda p: p["page"].isNotNull())
    return F.transform(kept, lambda p: F.struct(p["page"].alias("page"), F.coalesce(p["text"], F.lit("")).alias("text")))


def merge_evidence(pairs: Column) -> Column:
    """Pairs by page, ascending: further texts of a page are added when it does not contain them."""
    empty = F.expr("cast(array() as array<struct<page:int,text:string>>)")

    def step(acc: Column, p: Column) -> Column:
        def grow(e: Column) -> Column:
            fresh = (p["text"] != "") & ~F.contains(e["text"], p["text"])
            joined = F.when(fresh, tx.combine_text(e["text"], p["text"])).otherwise(e["text"])
            return F.struct(e["page"].alias("page"), F.when(e["page"] == p["page"], joined).otherwise(e["text"]).alias("text"))

        known = F.exists(acc, lambda e: e["page"] == p["page"])
        return F.when(known, F.transform(acc, grow)).otherwise(F.array_append(acc, p))

    return F.array_sort(F.aggregate(pairs, empty, step))


_FIELDS = ["final_status", "final_result", "is_target", "confidence", "evidence_pages", "evidence_text", "reason", "recommendation", "warnings"]


def _merge(df: DataFrame, merged_item, fold) -> DataFrame:
    """Fold the rows of each (document, merged item) in order of `seq`; single rows pass unchanged.

    A group holds an item and its sub-item, a few rows at most.
    """
    named = df.withColumn("_item", merged_item)
    rows = named.groupBy("document_id", "_item").agg(F.array_sort(F.collect_list(F.struct("seq", *_FIELDS))).alias("_r"), F.min("seq").alias("seq"))
    first = F.struct(*[rows["_r"][0][f].alias(f) for f in _FIELDS])
    merged = F.aggregate(F.slice("_r", F.lit(2), F.size("_r")), first, lambda acc, r: fold(F.col("_item"), acc, r))
    done = rows.withColumn("_m", merged)
    return done.select("document_id", F.col("_item").alias("item_no"), "seq", *[F.col(f"_m.{f}").alias(f) for f in _FIELDS])


def _pick(take_left: Column, a: Column, b: Column, f: str) -> Column:
    return F.when(take_left, a[f]).otherwise(b[f])


def _sub_item(item: Column) -> Column:
    return F.when(item == "2-1", "2").otherwise(item)


def _more(a: Column, b: Column) -> Column:
    return F.concat(a, F.filter(b, lambda w: ~F.array_contains(a, w)))


def merge_subitem(final: DataFrame) -> DataFrame:
    """Rows of one item merge, 2-1 counting as 2.

    Best by (rank of result, confidence).  For item 2 only target rows compete, and without any the more confident
    row stays as it is.
    """

    def fold(item: Column, a: Column, b: Column) -> Column:
        def target(x: Column) -> Column:
            return F.coalesce(x["is_target"], F.lit(False)) & (tx.strip(x["final_result"]) != pack.NOT_APPLICABLE)

        def key(x: Column) -> Column:
            return F.struct(result_rank(x["final_result"]).alias("r"), x["confidence"].alias("c"))

        two = item == "2"
        no_target = two & ~target(a) & ~target(b)
        by_rank = key(a) >= key(b)
        left = F.when(no_target, a["confidence"] >= b["confidence"]).when(two & target(a) & ~target(b), True).when(
            two & target(b) & ~target(a), False).otherwise(by_rank)
        pairs = merge_evidence(F.concat(pairs_of(a["evidence_pages"], a["evidence_text"]), pairs_of(b["evidence_pages"], b["evidence_text"])))
        pages_ = F.when(no_target, _pick(left, a, b, "evidence_pages")).otherwise(F.transform(pairs, lambda p: p["page"]))
        texts_ = F.when(no_target, _pick(left, a, b, "evidence_text")).otherwise(F.transform(pairs, lambda p: p["text"]))

        def words(f: str) -> Column:
            chosen_first = F.when(left, tx.combine_text(a[f], b[f])).otherwise(tx.combine_text(b[f], a[f]))
            return F.when(no_target, _pick(left, a, b, f)).when(two, chosen_first).otherwise(tx.combine_text(a[f], b[f]))

        return F.struct(
            *[_pick(left, a, b, f).alias(f) for f in ["final_status", "final_result", "is_target", "confidence"]],
            pages_.alias("evidence_pages"), texts_.alias("evidence_text"), words("reason").alias("reason"),
            words("recommendation").alias("recommendation"), _more(a["warnings"], b["warnings"]).alias("warnings"),
        )

    return _merge(final, _sub_item(F.col("item_no")), fold)


def merge_subitem_flat(final: DataFrame) -> DataFrame:
    """Batch variant: best by (rank, confidence), pages as a sorted union, texts in order without repeats."""

    def fold(item: Column, a: Column, b: Column) -> Column:
        def key(x: Column) -> Column:
            return F.struct(result_rank(x["final_result"]).alias("r"), x["confidence"].alias("c"))

        left = key(a) >= key(b)

        def words(f: str) -> Column:
            return F.when(left, tx.combine_text(a[f], b[f])).otherwise(tx.combine_text(b[f], a[f]))

        return F.struct(
            *[_pick(left, a, b, f).alias(f) for f in ["final_status", "final_result", "is_target", "confidence"]],
            F.array_sort(F.array_union(a["evidence_pages"], b["evidence_pages"])).alias("evidence_pages"),
            _more(a["evidence_text"], b["evidence_text"]).alias("evidence_text"), words("reason").alias("reason"),
            words("recommendation").alias("recommendation"), _more(a["warnings"], b["warnings"]).alias("warnings"),
        )

    return _merge(final, _sub_item(F.col("item_no")), fold)


# --- stored results -------------------------------------------------------------------------------------------------------------


def primary_review(final: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review that stands behind a stored final row: its best review, else the row itself."""
    best = reviews.groupBy(*KEY).agg(F.min_by(F.struct("route_type", *[f for f in ["result", "is_target", "confidence", "evidence_pages", "evidence_text", "reason", "recommendation", "source"]]), _place()).alias("c"))
    joined = final.join(best, KEY, "left")
    own = F.struct(
        F.lit("final_review").alias("route_type"), F.col("final_result").alias("result"), final["is_target"].alias("is_target"), final["confidence"].alias("confidence"),
        final["evidence_pages"].alias("evidence_pages"), final["evidence_text"].alias("evidence_text"), final["reason"].alias("reason"), final["recommendation"].alias("recommendation"),
        F.lit("merged_final_review").alias("source"),
    )
    chosen = joined.select(*KEY, F.coalesce(F.col("c"), own).alias("p"))
    return chosen.select(*KEY, F.lit(0).cast("long").alias("seq"), "p.*")


def validate_reviews(final: DataFrame, reviews: DataFrame, routes: DataFrame, adjudicate: bool = False) -> DataFrame:
    """Audit of stored results; on request the fields of rows that need adjudication fall back to the primary review."""
    primary = cut_lineage(primary_review(final, reviews))  # every kind of finding reads it
    summary = audit_summary(audit_findings(primary, routes=routes), primary).drop("seq")
    out = final.join(summary, KEY)
    if not adjudicate:
        return out
    names = ["result", "reason", "recommendation", "evidence_pages", "evidence_text", "confidence"]
    given = primary.select(*KEY, F.struct(*names).alias("_p"))
    out = out.join(given, KEY)
    for target, name in zip(["final_result", *names[1:]], names):
        out = out.withColumn(target, F.when(F.col("requires_adjudication"), F.col(f"_p.{name}")).otherwise(F.col(target)))
    return out.drop("_p")


def resume_remaining(requested: DataFrame, completed: DataFrame) -> DataFrame:
    """Requested items without a stored final row."""
    return requested.join(completed.select(*KEY), KEY, "left_anti")


# --- post-processing -------------------------------------------------------------------------------------------------------------

# Sentences that state the budget basis, by item.
BASIS_END = {
    "2": "총 사업금액 3억원 이상이면서 직접구매 대상 상용SW를 구매하는 사업으로 볼 근거가 확인되었습니다.",
    "3": "대상 여부 판단에 필요한 사업금액 근거가 확인되었습니다.",
    "13": "제안서 보상 대상 여부 판단에 필요한 사업금액 근거가 확인되었습니다.",
    "18": "SW사업정보 제출 대상 여부 판단에 필요한 사업예산 근거가 확인되었습니다.",
}
GATE_TERMS = {
    "2": ["직접구매대상상용소프트웨어구매계획", "상용소프트웨어구매계획", "상용SW직접구매"],
    "15": ["적정사업기간종합산정서", "사업기간종합산정서"],
    "17": ["소프트웨어사업영향평가", "SW사업영향평가", "영향평가검토결과서"],
}
GATE_TEXT = {
    "2": "의 직접구매 대상 상용소프트웨어 구매계획 첨부파일을 확인 후 검토의견을 수정해주세요.",
    "15": "의 적정 사업기간 종합산정서 첨부파일에서 서명 블라인드 처리 여부를 확인 후 검토의견을 수정해주세요.",
    "17": "의 소프트웨어사업 영향평가 검토결과서 첨부파일에서 기관장 날인 여부를 확인 후 검토의견을 수정해주세요.",
}
GATE_WARNING = "attachment_manual_review_required"


def target_basis(final: DataFrame, amount: DataFrame) -> DataFrame:
    """Put the budget sentence before the reason of target rows of items 2, 3, 13 and 18."""
    end = F.lit(None).cast("string")
    for item, text in BASIS_END.items():
        end = F.when(F.col("item_no") == item, text).otherwise(end)
    sentence = F.concat(
        F.lit("대상: p."), F.col("amount_page").cast("string"), F.lit("에 근거하여 총 사업금액 "), tx.format_amount(F.col("amount_won")), F.lit("임이 확인되어, "), end
    )
    joined = final.join(amount.select("document_id", "amount_page", "amount_won"), "document_id", "left").withColumn("_s", sentence)
    due = F.coalesce("is_target", F.lit(False)) & F.col("_s").isNotNull() & ~F.contains(F.coalesce("reason", F.lit("")), F.col("_s"))
    return joined.withColumn("reason", F.when(due, tx.strip(F.concat("_s", F.lit("\n"), F.coalesce("reason", F.lit(""))))).otherwise(F.col("reason"))).select(*final.columns)


def attachment_hits(page: DataFrame) -> DataFrame:
    """First three attachment pages per document and gated item."""
    narrowed = page.withColumn("_c", tx.compact(F.col("page_text")))
    form = F.col("has_attachment") | tx.contains_any(F.col("_c"), ["붙임", "별첨", "서식"])
    tags = F.array_compact(F.array(*[F.when(tx.contains_any(F.col("_c"), terms), F.lit(item)) for item, terms in GATE_TERMS.items()]))
    hits = narrowed.filter(form).select(
        *ev.PAGE_ID, tx.display_page_no_simple(F.col("printed_page_no"), F.col("page_no")).alias("display_no"), tx.head(F.col("page_text"), 260).alias("text"),
        F.explode(tags).alias("item_no"),
    )
    top = blocks.first_rows(hits, KEY, [F.col("page_no"), F.col("seq")], 3)
    rows = top.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "display_no", "text"))).alias("_h"))
    return rows.select(*KEY, F.transform("_h", lambda h: h["display_no"]).alias("_pages"), F.transform("_h", lambda h: h["text"]).alias("_texts"))


def manual_attachment_gate(final: DataFrame, page: DataFrame) -> DataFrame:
    """Items 2, 15 and 17 with attachment pages wait for a person; 15 and 17 only when compliant."""
    joined = final.join(attachment_hits(page), KEY, "left")
    due = F.col("_pages").isNotNull() & ((F.col("item_no") == "2") | (tx.strip(F.col("final_result")) == pack.COMPLIANT))
    end = F.lit("")
    for item, text in GATE_TEXT.items():
        end = F.when(F.col("item_no") == item, text).otherwise(end)
    told = F.concat(F.lit("p."), F.col("_pages")[0].cast("string"), end)
    noted = F.when(F.array_contains("warnings", GATE_WARNING), F.col("warnings")).otherwise(F.array_append("warnings", F.lit(GATE_WARNING)))
    new = {
        "final_status": F.lit(pack.STATUS_HUMAN), "is_target": F.coalesce("is_target", F.lit(True)), "evidence_pages": F.col("_pages"), "evidence_text": F.col("_texts"),
        "reason": tx.strip(F.concat(F.coalesce("reason", F.lit("")), F.lit("\n"), told)), "recommendation": told, "warnings": noted, "final_result": F.lit(pack.CONFIRM),
    }
    marked = joined.withColumn("_due", F.coalesce(due, F.lit(False)))
    return marked.select(*[F.when(F.col("_due"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in final.columns])
