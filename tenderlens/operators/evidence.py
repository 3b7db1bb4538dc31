"""Evidence operators: find, quote, rank and repair the passages that support a judgement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.functions import patterns as pt
from tenderlens.functions import text as tx
from tenderlens.operators import blocks
from tenderlens.rules import pack
from tenderlens.session import cut_lineage

PAGE_ID = ["document_id", "page_no", "seq"]


def shown_no() -> Column:
    return tx.display_page_no(F.col("printed_page_no"), F.col("page_text"), F.col("page_no"))


# --- keyword evidence ---------------------------------------------------------------------------------------


def keyword_evidence(page: DataFrame, keywords: Sequence[str], radius: int = 80) -> DataFrame:
    """Per page outside the contents: the window of the first keyword, in list order, that occurs loosely."""
    lowered = page.filter(~F.col("has_toc")).withColumn("_low", tx.compact_lower(F.col("page_text")))
    hits = lowered.filter(tx.loose_any(F.col("_low"), keywords))
    return hits.select(
        *PAGE_ID, shown_no().alias("display_no"),
        tx.first_keyword_window(F.col("page_text"), F.col("_low"), keywords, radius).alias("evidence"),
    )


# --- requirement masks --------------------------------------------------------------------------------------


def requirement_mask(rules: dict[str, Column]) -> Column:
    """One bit per satisfied requirement, in the order of `rules`."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(rules.values())])


def full_mask(n: int) -> int:
    return (1 << n) - 1


def document_coverage(masks: DataFrame, required: int) -> DataFrame:
    """Union of the satisfied requirements of a document's pages, and whether it is complete."""
    return masks.groupBy("document_id").agg(F.bit_or("mask").alias("mask")).withColumn(
        "complete", F.col("mask").bitwiseAND(required) == required
    )


def greedy_cover(candidates: DataFrame, required: int, order: Sequence[str]) -> DataFrame:
    """Pages in order, each kept if it adds a requirement, until all are covered; nothing when they never are.

    Of the pages with one mask only the first can ever be kept, so each document shrinks to at most one row per
    distinct mask before its rows are gathered.  `order` names columns that end in a unique one.
    """
    carried = ["page_no", "seq", *[c for c in candidates.columns if c not in {"document_id", "page_no", "seq", "mask", *order}]]
    place = F.struct(*order)
    first = candidates.groupBy("document_id", "mask").agg(F.min_by(F.struct(*carried), place).alias("row"), F.min(place).alias("place"))
    gathered = first.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("place", "mask", "row"))).alias("rows"))
    kept_type = gathered.select("rows").schema[0].dataType.simpleString()
    state = F.struct(F.lit(0).alias("covered"), F.expr(f"cast(array() as {kept_type})").alias("kept"))

    def step(acc: Column, r: Column) -> Column:
        adds = r["mask"].bitwiseAND(F.bitwise_not(acc["covered"])) != 0
        open_ = acc["covered"].bitwiseAND(required) != required
        take = adds & open_
        return F.struct(
            F.when(take, acc["covered"].bitwiseOR(r["mask"])).otherwise(acc["covered"]).alias("covered"),
            F.when(take, F.array_append(acc["kept"], r)).otherwise(acc["kept"]).alias("kept"),
        )

    folded = gathered.withColumn("_f", F.aggregate("rows", state, step)).filter(F.col("_f.covered").bitwiseAND(required) == required)
    return folded.select("document_id", F.posexplode("_f.kept").alias("step", "_k")).select(
        "document_id", "step", F.col("_k.mask").alias("mask"), "_k.row.*"
    )


# --- criteria overlap ----------------------------------------------------------------------------------------


CRITERION = ["query_item", "rank_group", "rank"]


def _criterion_tokens(hits: DataFrame, tokens_needed: int) -> DataFrame:
    joined = F.concat_ws(" ", F.when(F.length("title") > 0, F.col("title")), F.when(F.length("snippet") > 0, F.col("snippet")))
    crit = hits.withColumn("_tokens", tx.content_tokens(joined, pack.OVERLAP_STOPWORDS)).filter(F.size("_tokens") >= tokens_needed)
    crit = crit.select(*CRITERION, F.array_distinct("_tokens").alias("_tokens"))
    return crit.select(*CRITERION, F.size("_tokens").alias("_size"), F.explode("_tokens").alias("token"))


def page_words(page: DataFrame) -> DataFrame:
    """Distinct content words of the pages without a table of contents, one row per page."""
    return page.filter(~F.col("has_toc")).select(*PAGE_ID, F.array_distinct(tx.content_tokens(F.col("page_text"), pack.OVERLAP_STOPWORDS)).alias("words"))


def _best_overlap(counted: DataFrame) -> DataFrame:
    """Best (criterion, page) of every document and item, the first on ties."""
    place = F.struct((-F.col("shared") / F.col("_size")).alias("neg"), "rank_group", "rank", "page_no", "seq", "keyword")
    best = counted.groupBy("document_id", "query_item").agg(F.min(place).alias("_b"))
    return best.select(
        "document_id", F.col("query_item").alias("item_no"), (-F.col("_b.neg")).alias("coverage"), F.col("_b.page_no").alias("page_no"),
        F.col("_b.seq").alias("seq"), F.col("_b.keyword").alias("keyword"),
    )


#: A token on more than one in so many pages is common; at most that many times the mean number of words of a page are.
COMMON_ONE_IN = 8


def criteria_overlap(page: DataFrame, hits: DataFrame, tokens_needed: int = 3) -> DataFrame:
    """Best (criterion, page) of every document and item by the share of criterion tokens on the page.

    Columns of `hits`: query_item, rank_group, rank, title, snippet.  Pages and criteria meet on rare tokens only; counts are
    combined before the shuffle.  What common tokens add is counted from the set of common tokens of a page.  Pages that share only
    common tokens with a criterion differ by that set alone, so of a document and a set the first page stands for all, and each
    distinct set is held against the criteria once.
    """
    crit = cut_lineage(_criterion_tokens(hits, tokens_needed))
    words = cut_lineage(page_words(page))
    held = words.select(*PAGE_ID, F.explode("words").alias("token"))
    frequency = cut_lineage(held.join(crit.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("_df")))
    common = [r.token for r in frequency.filter(F.col("_df") * COMMON_ONE_IN > words.count()).select("token").collect()]
    rare = crit.filter(~F.col("token").isin(common)) if common else crit
    # tokens of the criteria by number, in their order: a least number is kept by a hash aggregate, a least string needs a sort
    number = cut_lineage(crit.select("token").distinct().withColumn("_no", F.row_number().over(Window.orderBy("token"))))
    numbered = F.broadcast(rare.join(number, "token"))
    met = held.join(numbered, "token").groupBy(*PAGE_ID, *CRITERION, "_size").agg(F.count(F.lit(1)).alias("shared"), F.min("_no").alias("_no"))
    met = met.join(F.broadcast(number.withColumnRenamed("token", "keyword")), "_no").drop("_no")
    if not common:
        return _best_overlap(met)
    shared = crit.filter(F.col("token").isin(common)).groupBy(*CRITERION, "_size").agg(F.array_sort(F.collect_list("token")).alias("_common"))
    sets = cut_lineage(words.select(*PAGE_ID, F.array_sort(F.filter("words", lambda w: w.isin(common))).alias("_set")).filter(F.size("_set") > 0))
    both = F.array_intersect("_set", "_common")
    more = met.join(sets, PAGE_ID, "left").join(shared.drop("_size"), CRITERION, "left").withColumn("_both", F.coalesce(both, F.expr("cast(array() as array<string>)")))
    found = more.select(*PAGE_ID, *CRITERION, "_size", (F.col("shared") + F.size("_both")).alias("shared"), F.least("keyword", F.array_min("_both")).alias("keyword"))
    first = sets.groupBy("document_id", "_set").agg(F.min(F.struct("page_no", "seq")).alias("_p"))
    # distinct sets and criteria meet on the tokens of the sets, which are no pages
    tokens = sets.select("_set").distinct().select("_set", F.explode("_set").alias("token"))
    told = tokens.join(crit, "token").groupBy("_set", *CRITERION, "_size").agg(F.count(F.lit(1)).alias("shared"), F.min("token").alias("keyword"))
    place = F.struct((-F.col("shared") / F.col("_size")).alias("neg"), "rank_group", "rank")
    of_set = told.groupBy("_set", "query_item").agg(F.min_by(F.struct("rank_group", "rank", "_size", "shared", "keyword"), place).alias("_b"))
    plain = first.join(of_set, "_set").select("document_id", "_p.*", "query_item", "_b.*")
    return _best_overlap(found.unionByName(plain.select(*found.columns)))


def accepted_overlap(words: DataFrame, hits: DataFrame, threshold: float = 0.7, tokens_needed: int = 3) -> DataFrame:
    """The rows of `criteria_overlap` whose coverage reaches the threshold, without pairing on common tokens.

    `words`: a (staged) result of `page_words`.  A page that holds the wanted number of a criterion's n tokens holds at
    least k of any n - wanted + k of them.  With a quarter of the wanted number for k and each criterion's rarest tokens
    for those, few pages become candidates; what they share is then counted from the two arrays, without another row per
    token.  Criteria tokens and probes, both of the rule book's size, are staged so that Spark joins them by their real size.
    """
    crit = cut_lineage(_criterion_tokens(hits, tokens_needed))
    held = words.select(*PAGE_ID, F.explode("words").alias("token"))
    frequency = held.join(crit.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    wanted = F.ceil(F.col("_size") * F.lit(threshold) - F.lit(1e-9))
    least = F.ceil(wanted / 4)
    rarest = Window.partitionBy(*CRITERION).orderBy("_df", "token")
    ranked = crit.join(frequency, "token", "left").withColumn("_df", F.coalesce("_df", F.lit(0))).withColumn("_k", F.row_number().over(rarest))
    number = F.dense_rank().over(Window.orderBy(*CRITERION, least)).alias("_no")  # of the rule book; pairs are counted by it in narrow rows
    probes = cut_lineage(ranked.filter(F.col("_k") <= F.col("_size") - wanted + least).select(*CRITERION, "token", least.cast("int").alias("_least"), number))
    met = held.join(probes.select("token", "_no"), "token").groupBy(*PAGE_ID, "_no").agg(F.count(F.lit(1)).alias("_met"))
    candidates = met.join(F.broadcast(probes.select(*CRITERION, "_least", "_no").distinct()), "_no").filter(F.col("_met") >= F.col("_least")).drop("_met", "_least", "_no")
    sets = crit.groupBy(*CRITERION, "_size").agg(F.collect_list("token").alias("_tokens"))
    both = candidates.join(words, PAGE_ID).join(sets, CRITERION).withColumn("_both", F.array_intersect("words", "_tokens"))
    counted = both.select(*PAGE_ID, *CRITERION, "_size", F.size("_both").alias("shared"), F.array_min("_both").alias("keyword"))
    return _best_overlap(counted.filter(F.col("shared") >= wanted)).filter(F.col("coverage") >= threshold)


def overlap_evidence(chosen: DataFrame, page: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Page number and quoted window of the accepted overlaps."""
    accepted = chosen.filter(F.col("coverage") >= threshold)
    pattern = F.concat(F.lit("(?iu)"), F.regexp_replace("keyword", "(.)(?=.)", f"$1[{tx.SPACE.replace(chr(92), chr(92) * 2)}]*"))
    with_text = accepted.join(page.select(*PAGE_ID, "printed_page_no", "page_text"), PAGE_ID)
    return with_text.select(
        "document_id", "item_no", "coverage", shown_no().alias("display_no"),
        F.coalesce(_around_column(F.col("page_text"), pattern, 80), tx.head(tx.collapse(F.col("page_text")), 180)).alias("evidence"),
    )


def _around_column(text: Column, pattern: Column, radius: int) -> Column:
    def window(parts: Column) -> Column:
        start = F.greatest(F.length(parts[0]) - radius, F.lit(0))
        stop = F.length(text) - F.greatest(F.length(parts[1]) - radius, F.lit(0))
        return F.when(F.size(parts) == 2, tx.collapse(F.substring(text, start + 1, stop - start)))

    return tx.let(F.split(text, pattern, 2), window)


# --- amounts ---------------------------------------------------------------------------------------------------


def budget_context(context: Column) -> Column:
    compact = tx.compact(context)
    return tx.contains_any(compact, pack.BUDGET_TERMS) & ~tx.contains_any(compact, pack.BUDGET_NEGATIVE_TERMS)


def amount_candidates(page: DataFrame) -> DataFrame:
    """Every amount outside the contents whose surroundings speak of a budget."""
    source = page.filter(~F.col("has_toc") & F.col("page_text").rlike(tx.AMOUNT_REGEX))
    spans = source.select(
        *PAGE_ID, tx.display_page_no_simple(F.col("printed_page_no"), F.col("page_no")).alias("display_no"), "page_text",
        F.explode(tx.match_spans(F.col("page_text"), tx.AMOUNT_REGEX)).alias("s"),
    )
    with_context = spans.select(
        *PAGE_ID, "display_no", F.col("s.start").alias("start"), tx.strip(F.col("s.value")).alias("raw_text"),
        tx.parse_amount(F.col("s.value")).alias("amount_won"), tx.context(F.col("page_text"), F.col("s"), 90, 90).alias("_ctx"),
    )
    return with_context.filter(budget_context(F.col("_ctx"))).withColumn("context", tx.collapse(F.col("_ctx"))).drop("_ctx")


def project_amount(page: DataFrame, threshold: int = 0) -> DataFrame:
    """Largest budget amount of each document, the first on ties."""
    candidates = amount_candidates(page).filter(F.col("amount_won") >= threshold)
    value = F.struct("display_no", "amount_won", "raw_text", "context")
    best = candidates.groupBy("document_id").agg(
        F.min_by(value, F.struct((-F.col("amount_won")).alias("a"), "page_no", "seq", "start")).alias("_a")
    )
    return best.select("document_id", F.col("_a.display_no").alias("amount_page"), "_a.amount_won", "_a.raw_text", "_a.context")


# --- scores -----------------------------------------------------------------------------------------------------


def subcontract_plan_score(text: Column, lowered: Column, minimum: float = 5.0) -> Column:
    """A plan-adequacy criterion scored at least `minimum`, on one line or near the subcontract term."""
    terms = ["하도급", "계획", "적정성"]
    lines = F.split(tx.text_or_empty(text), "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")
    on_line = F.exists(lines, lambda line: tx.contains_all(tx.compact(line), terms) & (tx.max_score(line) >= minimum))

    def near(compact: Column) -> Column:
        def one(s: Column) -> Column:
            w = tx.context(compact, s, 40, 80)
            return w.contains("계획") & w.contains("적정성") & (tx.max_score(w) >= minimum)

        return F.exists(tx.match_spans(compact, "하도급"), one)

    return tx.contains_all(lowered, terms) & (on_line | tx.let(tx.compact(text), near))


# --- substring search of many terms -----------------------------------------------------------------------------


def term_starts(terms: DataFrame) -> tuple[DataFrame, str | None]:
    """(longest, item_no, term): for each term of (item_no, term) the terms that begin like it; and one pattern for all terms.

    Terms come from the rule book, so their number follows it and not the pages.
    """
    asked = cut_lineage(terms.select("item_no", "term").filter("term <> ''").distinct())
    listed = [r.term for r in asked.select("term").distinct().collect()]
    heads = asked.select(F.col("term").alias("longest")).distinct().select(
        "longest", F.explode(F.transform(F.sequence(F.lit(1), F.length("longest")), lambda n: F.substring(F.col("longest"), F.lit(1), n))).alias("term")
    )
    return heads.join(asked, "term").select("longest", "item_no", "term"), pt.trie_regex(listed) if listed else None


def held_terms(text: Column, regex: str | None) -> Column:
    """Distinct beginnings of the longest terms in a text; all terms that the text holds are among them."""
    heads = F.transform(longest_or_none(text, regex), lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda n: F.substring(t, F.lit(1), n)))
    return F.array_distinct(F.flatten(heads))


def asked_terms(terms: DataFrame) -> tuple[DataFrame, str | None, int]:
    """(item_no, term, _word, _bit), staged so that Spark joins them by their real size; one pattern for all terms; number of words.

    A term is a bit in one of the words of its item, so that distinct terms, also those of rows that share a page key, are united by
    a hash aggregate before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy("item_no").orderBy("term")) - 1
    numbered = terms.select("item_no", "term").filter("term <> ''").distinct().withColumn("_n", place)
    asked = cut_lineage(numbered.select("item_no", "term", F.floor(F.col("_n") / 64).cast("int").alias("_word"), F.expr("shiftleft(1L, _n % 64)").alias("_bit")))
    listed = [r.term for r in asked.select("term").distinct().collect()]
    return asked, pt.trie_regex(listed) if listed else None, 1 + (asked.agg(F.max("_word")).first()[0] or 0)


def term_words(n: int) -> list[Column]:
    """Aggregates over the rows of asked terms: the distinct ones as bits."""
    return [F.bit_or(F.when(F.col("_word") == k, F.col("_bit"))).alias(f"_w{k}") for k in range(n)]


def term_count(n: int) -> Column:
    """Number of distinct terms behind `term_words`."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.bit_count(f"_w{k}"), F.lit(0)) for k in range(n)]).cast("long")


def longest_or_none(text: Column, regex: str | None) -> Column:
    return pt.longest_terms(text, regex) if regex else F.expr("cast(array() as array<string>)")


def substring_hits(page: DataFrame, terms: DataFrame, lower: bool) -> DataFrame:
    """Number of distinct terms of each item (item_no, term) that occur in each page, as substrings.

    A page is searched once, at every place, for the longest term that begins there.  Its terms are made distinct in its own row,
    so that they are counted before the shuffle, which moves one row for a page and an item.
    """
    asked, regex, n = asked_terms(terms)
    text = F.lower("page_text") if lower else F.col("page_text")
    found = page.select(*PAGE_ID, F.explode(held_terms(text, regex)).alias("term")).join(F.broadcast(asked), "term")
    return found.groupBy(*PAGE_ID, "item_no").agg(*term_words(n)).select(*PAGE_ID, "item_no", term_count(n).alias("hits"))


def direct_terms(hits: DataFrame) -> DataFrame:
    """Distinct terms behind the required-criteria mark of an item's first five hits."""
    top = blocks.first_rows(hits, ["query_item"], [F.col("rank_group"), F.col("rank")], 5, "_k")
    after = F.when(
        F.col("snippet").contains("[REQUIRED_CRITERIA]"),
        F.element_at(F.split("snippet", "\\[REQUIRED_CRITERIA\\]", 2), 2),
    ).otherwise(F.col("snippet"))
    words = tx.content_tokens(F.concat_ws(" ", "title", after), pack.DIRECT_STOPWORDS, lower=False)
    return top.select(F.col("query_item").alias("item_no"), F.explode(words).alias("term")).distinct()


def direct_requirement_signal(page: DataFrame, terms: DataFrame) -> DataFrame:
    """(page, item) pairs with at least two of the item's direct terms."""
    return substring_hits(page, terms, lower=False).filter("hits >= 2")


def target_only(compact: Column) -> Column:
    return tx.contains_any(compact, pack.TARGET_MARKERS) & ~tx.contains_any(compact, pack.DIRECT_MARKERS)


# --- wording-side context test ------------------------------------------------------------------------------------


def non_substantive(text: Column) -> Column:
    return tx.let(tx.compact_lower(text), lambda low: _non_substantive(text, low))


def _non_substantive(text: Column, low: Column) -> Column:
    codes = F.size(F.array_distinct(F.regexp_extract_all(low, F.lit("([a-z]{2,5}-[0-9]{3})"), F.lit(1))))
    overview = tx.contains_any(low, ["요구사항", "분류", "고유번호"]) & (codes >= 3)  # the cheap test first
    title_only = (
        (low.startswith("별첨") | low.startswith("별지") | low.startswith("붙임"))
        & (F.length(tx.collapse(text)) <= 80)
        & ~tx.contains_any(low, ["작성하여첨부", "제출하여야", "명시하여야", "하여야함", "○", "□"])
    )
    substantive = ["명시", "제출", "첨부", "작성하여첨부", "평가", "계약", "보안", "하자", "산출물"]
    return (
        (low == "")
        | (low.contains("요구사항총괄표") & tx.contains_any(low, ["목록", "리스트", "일람"]))
        | overview
        | title_only
        | tx.contains_any(low, ["빈서식", "빈양식", "작성서식", "작성양식"])
        | (tx.contains_any(low, ["서식", "양식"]) & ~tx.contains_any(low, substantive))
    )


def context_only(text: Column) -> Column:
    def judge(low: Column) -> Column:
        return _non_substantive(text, low) | (tx.contains_any(low, pack.WORDING_CONTEXT_TERMS) & ~tx.contains_any(low, pack.WORDING_DIRECT_TERMS))

    return tx.let(tx.compact_lower(text), judge)


# --- locating quotes -----------------------------------------------------------------------------------------------

QUOTE_HEAD = 180
CHUNK = 80
MAX_CHUNKS = 8


def page_fingerprints(page: DataFrame) -> DataFrame:
    """(page, probe): fingerprints of compact page text, at most a fifth as many as it has characters."""
    return page.select(*PAGE_ID, F.explode(pt.fingerprints(tx.compact(F.col("page_text")))).alias("probe"))


def locate_evidence(quotes: DataFrame, page: DataFrame) -> DataFrame:
    """Page that holds each quote (document_id, quote_id, quote): its head, else most of its chunks.

    Quotes and pages of a document meet on the fingerprint of a piece's first window, which every page that holds the piece has,
    and what met is compared in full.  Quotes shorter than a window are not located.
    """
    compact = tx.compact(F.col("quote"))
    q = quotes.select("document_id", "quote_id", compact.alias("_q")).filter(F.length("_q") >= pt.SURE)
    head_probe = F.array(F.struct(F.lit(-1).alias("part"), tx.head(F.col("_q"), QUOTE_HEAD).alias("piece")))
    n_chunks = F.least(F.lit(MAX_CHUNKS), F.ceil((F.length("_q") - CHUNK) / F.lit(float(CHUNK))).cast("int"))
    chunk_list = F.when(
        F.length("_q") > CHUNK,
        F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda i: F.struct(i.alias("part"), F.substring(F.col("_q"), i * CHUNK + 1, F.lit(CHUNK)).alias("piece"))),
    ).otherwise(F.expr("cast(array() as array<struct<part:int,piece:string>>)"))
    pieces = q.select("document_id", "quote_id", F.explode(F.concat(head_probe, chunk_list)).alias("_p")).select(
        "document_id", "quote_id", F.col("_p.part").alias("part"), F.col("_p.piece").alias("piece"), pt.first_fingerprint(F.col("_p.piece")).alias("probe")
    )
    met = pieces.join(page_fingerprints(page), ["document_id", "probe"])
    text = page.select(*PAGE_ID, tx.compact(F.col("page_text")).alias("_text"))
    held = met.join(text, PAGE_ID).filter(F.contains(F.col("_text"), F.col("piece")))
    found = held.groupBy("document_id", "quote_id", "page_no", "seq").agg(
        F.max((F.col("part") == -1).cast("int")).alias("whole"), F.count_if(F.col("part") >= 0).alias("score")
    ).filter("whole = 1 or score > 0")
    order = F.struct((-F.col("whole")).alias("w"), F.when(F.col("whole") == 1, 0).otherwise(-F.col("score")).alias("s"), "page_no", "seq")
    return found.groupBy("document_id", "quote_id").agg(F.min(order).alias("_o")).select(
        "document_id", "quote_id", F.col("_o.page_no").alias("page_no"), F.col("_o.seq").alias("seq")
    )


# --- evidence page numbers -------------------------------------------------------------------------------------------


def printed_map(page: DataFrame) -> DataFrame:
    printed = F.coalesce("printed_page_no", tx.footer_page_no(F.col("page_text")))
    return page.select("document_id", "page_no", "seq", printed.alias("printed")).filter("printed is not null")


def evidence_pairs(review: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per evidence page with the text at the same place."""
    return review.select(
        *key, F.posexplode(F.arrays_zip(F.col("evidence_pages").alias("page"), F.col("evidence_text").alias("text"))).alias("pos", "_p")
    ).select(*key, "pos", F.col("_p.page").alias("page"), F.coalesce("_p.text", F.lit("")).alias("text"))


def normalize_evidence_pages(review: DataFrame, page: DataFrame, key: Sequence[str], locate: bool = True) -> DataFrame:
    """Cited numbers as printed numbers: by the quoted text, else if already printed, else by the physical page."""
    key = list(key)
    pairs = evidence_pairs(review, key).filter("page is not null").withColumn("quote_id", F.concat_ws("|", *key, "pos"))
    numbers = printed_map(page)
    if locate:
        where = locate_evidence(pairs.select("document_id", "quote_id", F.col("text").alias("quote")), page)
        where = where.join(numbers, ["document_id", "page_no", "seq"]).select("document_id", "quote_id", F.col("printed").alias("_by_text"))
        pairs = pairs.join(where, ["document_id", "quote_id"], "left")
    else:
        pairs = pairs.withColumn("_by_text", F.lit(None).cast("int"))
    known = numbers.select("document_id", F.col("printed").alias("page")).distinct().withColumn("_known", F.lit(True))
    index = numbers.groupBy("document_id", F.col("page_no").alias("page")).agg(F.max_by("printed", "seq").alias("_by_index"))
    settled = (
        pairs.join(known, ["document_id", "page"], "left")
        .join(index, ["document_id", "page"], "left")
        .withColumn("page", F.coalesce("_by_text", F.when(F.col("_known"), F.col("page")), "_by_index", "page"))
    )
    rebuilt = settled.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "page"))).alias("_e"))
    return review.join(rebuilt, key, "left").withColumn(
        "evidence_pages", F.coalesce(F.transform("_e", lambda e: e["page"]), "evidence_pages")
    ).drop("_e")


def distinct_evidence_pages(review: DataFrame, page: DataFrame, key: Sequence[str]) -> DataFrame:
    """Judgement-response variant: pages of located quotes first, then the cited numbers, each number once."""
    key = list(key)
    numbers = printed_map(page)
    texts = review.select(*key, F.posexplode("evidence_text").alias("pos", "quote")).withColumn("quote_id", F.concat_ws("|", *key, "pos"))
    where = locate_evidence(texts.select("document_id", "quote_id", "quote"), page).join(numbers, ["document_id", "page_no", "seq"])
    by_text = texts.join(where.select("document_id", "quote_id", "printed"), ["document_id", "quote_id"]).select(*key, F.lit(0).alias("src"), "pos", F.col("printed").alias("page"))
    cited = review.select(*key, F.posexplode("evidence_pages").alias("pos", "page"))
    known = numbers.select("document_id", F.col("printed").alias("page")).distinct().withColumn("_known", F.lit(True))
    index = numbers.groupBy("document_id", F.col("page_no").alias("page")).agg(F.max_by("printed", "seq").alias("_by_index"))
    by_no = cited.join(known, ["document_id", "page"], "left").join(index, ["document_id", "page"], "left").select(
        *key, F.lit(1).alias("src"), "pos", F.coalesce(F.when(F.col("_known"), F.col("page")), "_by_index", "page").alias("page")
    )
    rebuilt = by_text.unionByName(by_no).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("src", "pos", "page"))).alias("_e"))
    return review.join(rebuilt, key, "left").withColumn(
        "evidence_pages", F.coalesce(F.array_distinct(F.transform("_e", lambda e: e["page"])), F.array().cast("array<int>"))
    ).drop("_e")


def drop_toc_evidence(review: DataFrame, page: DataFrame, key: Sequence[str]) -> DataFrame:
    """Remove evidence that lies on contents pages, unless the item does not apply."""
    key = list(key)
    toc = page.filter("has_toc").select("document_id", F.explode(F.array_compact(F.array("page_no", F.coalesce("printed_page_no", tx.footer_page_no(F.col("page_text")))))).alias("page"))
    has_toc = toc.select("document_id").distinct().withColumn("_has_toc", F.lit(True))
    pairs = evidence_pairs(review, key).filter("page is not null").join(toc.distinct(), ["document_id", "page"], "left_anti")
    kept = pairs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "page", "text"))).alias("_k"))
    joined = review.join(has_toc, "document_id", "left").join(kept, key, "left")
    touch = F.coalesce("_has_toc", F.lit(False)) & (F.trim("result") != pack.NOT_APPLICABLE)
    pages_ = F.coalesce(F.transform("_k", lambda k: k["page"]), F.array().cast("array<int>"))
    texts_ = F.coalesce(F.transform("_k", lambda k: k["text"]), F.array().cast("array<string>"))
    return (
        joined.withColumn("evidence_pages", F.when(touch, pages_).otherwise(F.col("evidence_pages")))
        .withColumn("evidence_text", F.when(touch, texts_).otherwise(F.col("evidence_text")))
        .drop("_k", "_has_toc")
    )


# --- ranking pages for an item ------------------------------------------------------------------------------------------


def query_terms(hits: DataFrame, stopwords: Sequence[str]) -> DataFrame:
    """Distinct lower-case tokens of the title, category and snippet of an item's first five hits, twelve of each."""
    top = blocks.first_rows(hits, ["query_item"], [F.col("rank_group"), F.col("rank")], 5, "_k")

    def tokens(c: str) -> Column:
        if stopwords:
            return F.slice(tx.content_tokens(F.col(c), stopwords), 1, 12)
        return F.transform(F.slice(tx.words(F.col(c)), 1, 12), F.lower)

    rows = top.select(F.col("query_item").alias("item_no"), F.explode(F.concat(tokens("title"), tokens("category"), tokens("snippet"))).alias("term"))
    return rows.distinct()


def _points(cond: Column, n: int) -> Column:
    return F.when(cond, n).otherwise(0)


# Item-specific page signals and their points.
WORKFORCE_TERMS = [
    "투입인력", "투입 인력", "사업수행조직", "수행조직", "인력현황", "인원 현황", "M/M", "투입률", "투입계획", "교체",
    "발주기관의 승인", "기능점수", "FP", "서비스수준협약",
]
WORKFORCE_STRONG = ["투입인력", "투입 인력", "사업수행조직", "인력현황", "M/M", "투입률"]
WORKFORCE_OFF = ["개인정보", "누출금지", "보안약점", "암호화"]
WORKFORCE_KEEP = ["투입인력", "투입 인력", "인력", "M/M", "기능점수", "FP"]
DETAIL_TERMS = ["요구사항 고유번호", "요구사항 명칭", "정의", "상세 세부내용", "산출정보"]


def special_item_score(t: Column, compact: Column) -> dict[str, Column]:
    """Bonus points of a page for the items that have characteristic pages."""
    has = t.contains
    workforce = reduce(lambda a, b: a + b, [_points(has(x), 12) for x in WORKFORCE_TERMS])
    return {
        "11": _points(has("기술능력평가") & (has("가격평가") | has("입찰가격평가")) & (has("90점") | has("90%")) & (has("10점") | has("10%")), 50),
        "12": _points(has("차등점수제") | (has("순위간") & has("점수차")), 50)
        + _points(has("평가항목") & (has("배점") | has("배점한도")), 35)
        + _points(has("소프트웨어기술성평가기준") | (has("하자보수") & has("비상 대책")), 30),
        "13": _points(has("제안서 보상") | has("보상대상"), 60)
        + _points(has("20억원") | has("20억"), 35)
        + _points(has("사업 예산") | has("사업예산") | has("총사업금액"), 25)
        + _points(has("소프트웨어 진흥법") & has("제52조"), 30),
        "14": _points(has("요구사항 총괄표"), 30) + _points(tx.count_terms(t, DETAIL_TERMS) >= 4, 15),
        "15": _points(tx.contains_all(compact, ["소프트웨어개발사업", "적정사업기간", "종합산정서"]), 60),
        "16": workforce
        + _points(has("기능점수") | has("FP") | has("서비스수준협약"), 35)
        + _points(tx.contains_any(t, WORKFORCE_STRONG), 45)
        - _points(tx.contains_any(t, WORKFORCE_OFF) & ~tx.contains_any(t, WORKFORCE_KEEP), 60),
        "17": _points(tx.contains_any(compact, ["소프트웨어사업영향평가검토결과서", "소프트웨어사업영향평가결과서"]), 60),
    }


def _with_fallback(top: DataFrame, pages: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """Add the first of `pages`, narrow rows, for the items of a document that no page scored for."""
    first = blocks.first_rows(pages.select(*PAGE_ID), ["document_id"], [F.col("page_no"), F.col("seq")], limit)
    first = first.groupBy("document_id").agg(F.collect_list(F.struct("rank", "page_no", "seq")).alias("_first"))
    every = items.select(F.collect_set("item_no")).scalar()
    scored = top.groupBy("document_id").agg(F.collect_set("item_no").alias("_scored"))
    open_ = first.join(scored, "document_id", "left").select("document_id", "_first", F.explode(F.array_except(every, F.coalesce("_scored", F.expr("cast(array() as array<string>)")))).alias("item_no"))
    rest = open_.select("document_id", "item_no", F.explode("_first").alias("_f"))
    return top.unionByName(rest.select("document_id", "item_no", "_f.rank", "_f.page_no", "_f.seq", F.lit(0).cast("long").alias("score")))


NO_ENTRIES = "array<struct<item_no:string,term:string,points:bigint>>"


def _entry(item_no: Column, term: Column, points: Column) -> Column:
    return F.struct(item_no.cast("string").alias("item_no"), term.cast("string").alias("term"), points.cast("long").alias("points"))


def _page_points(page: DataFrame, terms: DataFrame, items: DataFrame, mention: int, mention_own: int, more: Column, carried: list[Column]) -> DataFrame:
    """(page, item_no, score, carried): one search of each page for all terms and item numbers, besides the entries of `more`.

    An item number in the text gives `mention` points, or `mention_own` if it is a query term of its item as well; each distinct
    term gives one.
    """
    asked, regex, n = asked_terms(terms)
    own = [r[0] for r in terms.filter("term = item_no").select("item_no").distinct().collect()]  # of the rule book
    every = items.select(F.array_sort(F.collect_set("item_no"))).scalar()
    null = F.lit(None)
    low = page.withColumn("_low", F.lower("page_text")).withColumn("_every", every)
    named = F.transform(F.filter("_every", lambda n: F.contains(F.col("_low"), n)), lambda n: _entry(n, null, F.when(n.isin(own), mention_own).otherwise(mention) if own else F.lit(mention)))
    matched = F.transform(held_terms(F.col("_low"), regex), lambda t: _entry(null, t, F.lit(0)))
    rows = low.select(*PAGE_ID, *carried, F.explode(F.concat(F.coalesce(named, F.array().cast(NO_ENTRIES)), F.coalesce(matched, F.array().cast(NO_ENTRIES)), more)).alias("_e"))
    told = rows.select(*PAGE_ID, *[c for c in rows.columns if c not in (*PAGE_ID, "_e")], "_e.*").join(F.broadcast(asked.withColumnRenamed("item_no", "_item")), "term", "left")
    told = told.withColumn("item_no", F.coalesce("item_no", "_item")).join(F.broadcast(items.select("item_no").distinct()), "item_no", "left_semi")
    kept = [c for c in rows.columns if c not in (*PAGE_ID, "_e")]
    grouped = told.groupBy(*PAGE_ID, "item_no").agg(F.sum("points").alias("_points"), *term_words(n), *[F.first(c).alias(c) for c in kept])
    return grouped.select(*PAGE_ID, "item_no", (F.col("_points") + term_count(n)).alias("score"), *kept)


def rank_evidence_pages(page: DataFrame, items: DataFrame, hits: DataFrame, limit: int = 10) -> DataFrame:
    """Best pages per document and item: query-term hits, characteristic signals, the item number, no warning."""
    bonus = special_item_score(F.col("page_text"), F.col("_compact"))
    entries = F.filter(F.array(*[_entry(F.lit(k), F.lit(None), v) for k, v in bonus.items()]), lambda e: e["points"] != 0)
    special = F.when(F.col("has_toc"), F.array().cast(NO_ENTRIES)).otherwise(entries)
    warned = (F.length("parser_warning") > 0).alias("_warned")
    told = _page_points(page.withColumn("_compact", tx.compact(F.col("page_text"))), query_terms(hits, pack.RANK_STOPWORDS), items, 4, 3, F.coalesce(special, F.array().cast(NO_ENTRIES)), [warned])
    scored = told.withColumn("score", F.col("score") - F.coalesce(F.col("_warned").cast("int"), F.lit(0))).filter("score > 0")
    top = blocks.first_rows(scored.select(*PAGE_ID, "item_no", "score"), ["document_id", "item_no"], [F.col("score").desc(), F.col("page_no"), F.col("seq")], limit)
    return _with_fallback(cut_lineage(top.select("document_id", "item_no", "rank", "page_no", "seq", "score")), page, items, limit)


def select_prompt_pages(page: DataFrame, items: DataFrame, hits: DataFrame, max_pages: int = 12) -> DataFrame:
    """Pages shown to the external judge: all of a short document, else the best by terms and role."""
    narrow = page.select(*PAGE_ID)
    short = narrow.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= max_pages).select("document_id")
    roles = [(F.col("has_eval_table") | F.col("has_table"), pack.ROUTES["table"]), (F.col("has_attachment") | F.col("has_blind") | F.col("has_commercial_sw"), pack.ROUTES["attachment"])]
    role = F.concat(*[F.when(flag, F.array(*[_entry(F.lit(i), F.lit(None), F.lit(8)) for i in own])).otherwise(F.array().cast(NO_ENTRIES)) for flag, own in roles])
    minus = (2 * F.col("has_toc").cast("int") + F.coalesce((F.length("parser_warning") > 0).cast("int"), F.lit(0))).alias("_minus")
    told = _page_points(page, query_terms(hits, []), items, 1, 0, role, [minus]).join(short, "document_id", "left_anti")
    scored = told.withColumn("score", F.col("score") - F.col("_minus")).filter("score > 0")
    top = blocks.first_rows(scored.select(*PAGE_ID, "item_no", "score"), ["document_id", "item_no"], [F.col("score").desc(), F.col("page_no"), F.col("seq")], max_pages)
    picked = _with_fallback(cut_lineage(top.select("document_id", "item_no", "rank", "page_no", "seq", "score")), narrow.join(short, "document_id", "left_anti"), items, max_pages)
    few = blocks.first_rows(narrow.join(short, "document_id", "left_semi"), ["document_id"], [F.col("page_no"), F.col("seq")], max_pages)
    every = items.select(F.collect_set("item_no").alias("_items"))
    few = few.withColumn("item_no", F.explode(every.scalar())).select("document_id", "item_no", "rank", "page_no", "seq", F.lit(0).cast("long").alias("score"))
    return picked.unionByName(few)


def prompt_text(text: Column, limit: int = 1800) -> Column:
    clean = tx.strip(text)
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(tx.head(clean, limit), F.lit("\n[TRUNCATED]")))


# --- purchase wording -----------------------------------------------------------------------------------------------------


def negated_near(text: Column, keyword: str, negations: Sequence[str], reach: int) -> Column:
    """A negation that ends within `reach` characters after the keyword."""
    tests = [text.rlike(f"(?s){keyword}.{{0,{reach - len(n)}}}{n}") for n in negations]
    return reduce(lambda a, b: a | b, tests)


def page_purchase_signal(compact: Column) -> Column:
    return (
        ~tx.contains_any(compact, pack.NO_PURCHASE_PHRASES)
        & tx.contains_any(compact, pack.COMMERCIAL_SW)
        & tx.contains_any(compact, pack.PURCHASE_SIGNALS)
        & ~tx.contains_any(compact, pack.NO_PURCHASE_MARKS)
    )


# --- attachments -------------------------------------------------------------------------------------------------------------


def missing_signal(bare: Column) -> Column:
    return tx.contains_any(bare, pack.MISSING_SIGNALS)


def _label_only(line: Column) -> Column:
    def judge(bare: Column) -> Column:
        ends = bare.rlike(f"(?:{'|'.join(pack.LABEL_TERMS)})$")
        return (bare == "") | bare.isin(pack.LABEL_TERMS) | ((F.length(bare) <= 24) & ends)

    return tx.let(F.regexp_replace(tx.compact_attachment(line), "^[:\\-ㆍ·\\[\\]()]+|[:\\-ㆍ·\\[\\]()]+$", ""), judge)


def attachment_body(text: Column, title_hint: Column) -> Column:
    """Lines that are neither title, label, instruction nor list mark, joined by blanks."""
    lines = F.transform(F.split(tx.text_or_empty(text), "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"), tx.strip)

    def body_line(line: Column) -> Column:
        return (
            (line != "")
            & ~line.rlike("^(\\[붙임|【붙임|-)")
            & ~F.contains(line, title_hint)
            & ~(line.contains("영향평가") & line.contains("결과서"))
            & ~(line.contains("적정 사업기간") & line.contains("산정서"))
            & ~_label_only(line)
            & ~tx.contains_any(tx.compact_attachment(line), pack.INSTRUCTION_TERMS)
        )

    return F.array_join(F.filter(lines, body_line), " ")


def attachment_has_body(text: Column, title_hint: Column) -> Column:
    def judge(body: Column) -> Column:
        return (F.length(body) >= 80) & (tx.count_terms(tx.compact_attachment(body), pack.SUBSTANCE_SIGNALS) >= 2)

    return ~missing_signal(tx.compact_attachment(text)) & tx.let(attachment_body(text, title_hint), judge)


def reference_only(bare: Column, title_hint: str = "") -> Column:
    """Refers to an attachment without carrying three signs of its body."""
    names = bare.contains(_bare(title_hint)) if title_hint else F.lit(True)
    return names & tx.contains_any(bare, pack.REFERENCE_SIGNALS) & (tx.count_terms(bare, pack.REFERENCE_BODY_SIGNALS) < 3)


def _bare(literal: str) -> str:
    return "".join(ch for ch in literal if not ch.isspace() and ch not in ":：,，.ㆍ·-_/()[]{}<>「」『』")


def known_title(compact: Column, item_no: str) -> Column:
    return tx.contains_any(compact, [tx.squeeze(h) for h in pack.ATTACHMENT_TITLE_HINTS.get(item_no, [])])


def best_title_hint(compact: Column, item_no: str) -> Column:
    hints = pack.ATTACHMENT_TITLE_HINTS.get(item_no, [])
    found = [F.when(compact.contains(tx.squeeze(h)), F.lit(h)) for h in hints]
    return F.coalesce(*found, F.lit(""))


def titles_without_body(page: DataFrame, item_no: str) -> DataFrame:
    """Documents whose pages name the attachment and none carries its body: first three title pages."""
    c = page.filter("not has_toc").withColumn("_c", tx.compact(F.col("page_text"))).filter(known_title(F.col("_c"), item_no))
    titled = c.select(
        *PAGE_ID, shown_no().alias("display_no"), tx.head(F.col("page_text"), 260).alias("evidence"),
        attachment_has_body(F.col("page_text"), best_title_hint(F.col("_c"), item_no)).alias("has_body"),
    )
    bodied = titled.filter("has_body").select("document_id").distinct()
    empty = titled.join(bodied, "document_id", "left_anti")
    return blocks.first_rows(empty, ["document_id"], [F.col("page_no"), F.col("seq")], 3).select(
        "document_id", "rank", "page_no", "seq", "display_no", "evidence"
    )


def combine_pages(groups: Sequence[DataFrame], limit: int = 5) -> DataFrame:
    """Page groups in order, each displayed number once, the first `limit` of a document.

    Each group: document_id, page_no, seq, display_no, evidence.
    """
    tagged = reduce(
        lambda a, b: a.unionByName(b),
        [g.select("document_id", F.lit(i).alias("grp"), "page_no", "seq", "display_no", "evidence") for i, g in enumerate(groups)],
    )
    once = tagged.groupBy("document_id", "display_no").agg(
        F.min(F.struct("grp", "page_no", "seq")).alias("_o"), F.min_by("evidence", F.struct("grp", "page_no", "seq")).alias("evidence")
    )
    order = [F.col("_o.grp"), F.col("_o.page_no"), F.col("_o.seq")]
    return blocks.first_rows(once, ["document_id"], order, limit).select("document_id", "rank", "display_no", "evidence")


def allowed_evidence_page(compact: Column) -> Column:
    """Not in the contents; form and attachment pages only when they name an allowed section."""
    form = tx.contains_any(compact, ["서식", "별지", "붙임"])
    allowed = tx.contains_any(compact, ["상세요구사항", "기타사항", "사업요구사항", "제안안내사항", "제안안내"])
    return ~F.col("has_toc") & (~form | allowed)


KEEP_KEYWORDS = {
    "15": ["소프트웨어 개발사업", "적정 사업기간", "적정사업기간", "종합 산정서", "종합산정서", "별지 제4호", "별지제4호"],
    "17": ["소프트웨어사업 영향평가", "SW사업 영향평가", "영향평가 결과서", "영향평가 검토결과서", "별지 제1호", "별지제1호"],
}


def keep_attachment_evidence(review: DataFrame) -> DataFrame:
    """Items 15 and 17 keep only the pairs whose text names their attachment."""
    pairs = F.arrays_zip(F.col("evidence_pages").alias("page"), F.col("evidence_text").alias("text"))

    def keeps(words: Sequence[str]):
        bare_words = [_bare(w) for w in words]
        return lambda p: p["page"].isNotNull() & tx.contains_any(tx.compact_attachment(p["text"]), bare_words)

    kept = F.when(F.col("item_no") == "15", F.filter(pairs, keeps(KEEP_KEYWORDS["15"]))).when(
        F.col("item_no") == "17", F.filter(pairs, keeps(KEEP_KEYWORDS["17"]))
    )
    pages_ = F.transform("_kept", lambda p: p["page"])
    texts_ = F.transform("_kept", lambda p: F.coalesce(p["text"], F.lit("")))
    return (
        review.withColumn("_kept", kept)
        .withColumn("evidence_pages", F.when(F.col("_kept").isNotNull(), pages_).otherwise(F.col("evidence_pages")))
        .withColumn("evidence_text", F.when(F.col("_kept").isNotNull(), texts_).otherwise(F.col("evidence_text")))
        .drop("_kept")
    )
