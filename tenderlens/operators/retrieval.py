"""Criteria tables as documents, and the search that picks the ones that apply to an item.

Criteria tables are a rule book: their size does not grow with the page corpus.  Nothing here broadcasts them by
hint; Spark decides from their measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.functions import text as tx
from tenderlens.operators import blocks
from tenderlens.operators import evidence as ev
from tenderlens.rules import pack
from tenderlens.session import cut_lineage

DOC_COLUMNS = ["source_type", "source_name", "sheet_name", "row_no", "item_no", "title", "category", "content"]


def _filled(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit(""))) > 0


def _line(label: str, c: Column) -> Column:
    """`label: value`, or null for an empty value, so that joins skip it."""
    return F.when(_filled(c), F.concat(F.lit(f"{label}: "), c))


# --- criteria documents ----------------------------------------------------------------------------------


def load_criteria(items: DataFrame, requirements: DataFrame) -> DataFrame:
    """One row per item with its ordered requirement texts; requirements without an item make one."""
    texts = (
        requirements.groupBy("item_no")
        .agg(F.array_sort(F.collect_list(F.when(_filled(F.col("requirement_text")), F.struct("row_id", "requirement_text")))).alias("_r"))
        .select("item_no", F.transform("_r", lambda r: r["requirement_text"]).alias("requirement_texts"))
    )
    both = items.select("item_no", "title", "target_text").join(texts, "item_no", "full")
    return both.select(
        "item_no", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("target_text", F.lit("")).alias("target_text"),
        F.coalesce("requirement_texts", F.array().cast("array<string>")).alias("requirement_texts"),
    )


def core_requirement(requirement: Column, example: Column) -> Column:
    """Requirement without the example sentence it quotes."""
    text = tx.strip(requirement)
    flat, quoted = tx.collapse(text), tx.collapse(example)
    without = tx.collapse(F.replace(flat, quoted, F.lit(" ")))
    return F.when((quoted != "") & flat.contains(quoted), without).otherwise(text)


# Section marks and field names of an enriched criteria text.
TARGET_MARK = "[TARGET]"
REQUIRED_MARK = "[REQUIRED_CRITERIA]"
EXAMPLES_MARK = "[REFERENCE_EXAMPLES_FOR_ITEM_14]"
NO_REQUIREMENTS = "no legal_requirement rows"
EXAMPLE_NOTE = "example_sentence_note: reference example only; exact wording is not mandatory"
CASE_NOTE = "case_text_note: conditional criterion; apply only if this RFP matches the case"
EXAMPLES_ITEM = "14"


def _requirement_block(r: Column, i: Column) -> Column:
    example = _filled(r["example_sentence"])
    case = _filled(r["case_text"])
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[CRITERION "), (i + 1).cast("string"), F.lit("]")),
        F.concat(F.lit("category: "), F.when(_filled(r["category"]), r["category"]).otherwise("criteria")),
        F.concat(F.lit("core_requirement_text: "), core_requirement(r["requirement_text"], r["example_sentence"])),
        F.concat(F.lit("requirement_text: "), r["requirement_text"]),
        F.when(example, F.lit(EXAMPLE_NOTE)),
        F.when(example, F.concat(F.lit("example_sentence: "), r["example_sentence"])),
        F.when(case, F.lit(CASE_NOTE)),
        F.when(case, F.concat(F.lit("case_text: "), r["case_text"])),
    )


def _example_block(e: Column, i: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[REFERENCE_EXAMPLE "), (i + 1).cast("string"), F.lit("]")),
        F.concat(F.lit("reference_type: "), F.when(_filled(e["reference_type"]), e["reference_type"]).otherwise("reference_example")),
        _line("reference_subtype", e["reference_subtype"]),
        F.concat(F.lit("content: "), F.coalesce(e["content"], F.lit(""))),
    )


def _ordered(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    filled = [F.coalesce(c, F.lit("")).alias(c) for c in columns]
    return df.groupBy("item_no").agg(F.array_sort(F.collect_list(F.struct("row_id", *filled))).alias(name))


def criteria_docs(items: DataFrame, requirements: DataFrame, examples: DataFrame) -> DataFrame:
    """One enriched document per item."""
    reqs = _ordered(requirements, ["category", "requirement_text", "example_sentence", "case_text"], "_reqs")
    exs = _ordered(examples, ["reference_type", "reference_subtype", "content"], "_exs")
    joined = items.join(reqs, "item_no", "left").join(exs, "item_no", "left")
    has_reqs, has_exs = F.size("_reqs") > 0, F.size("_exs") > 0
    examples_part = F.when(
        has_exs & (F.col("item_no") == EXAMPLES_ITEM),
        F.concat(F.lit(f"{EXAMPLES_MARK}\n"), F.array_join(F.transform("_exs", _example_block), "\n")),
    )
    content = F.concat_ws(
        "\n",
        F.lit(TARGET_MARK),
        F.concat(F.lit("item_no: "), F.col("item_no")),
        F.concat(F.lit("legal_title: "), F.coalesce("title", F.lit("None"))),
        _line("target_text", F.col("target_text")),
        F.lit(REQUIRED_MARK),
        F.when(has_reqs, F.array_join(F.transform("_reqs", _requirement_block), "\n")).otherwise(NO_REQUIREMENTS),
        examples_part,
    )
    return joined.select(
        F.lit("criteria_db").alias("source_type"),
        F.when(has_exs, "legal_item+legal_requirement+legal_reference_example").otherwise("legal_item+legal_requirement").alias("source_name"),
        F.lit(None).cast("string").alias("sheet_name"), F.lit(None).cast("long").alias("row_no"),
        "item_no", "title", F.lit("legal_review_criteria").alias("category"), content.alias("content"),
    )


def requirement_docs(items: DataFrame, requirements: DataFrame) -> DataFrame:
    """One document per requirement, numbered within its item."""
    numbered = blocks.position_in_document(requirements, ["item_no"], "row_id", ["row_id"], "row_no")
    joined = numbered.join(items.select("item_no", F.col("title").alias("_title")), "item_no", "left")
    first_line = tx.collapse(F.split(F.coalesce("requirement_text", F.lit("")), "\\r\\n|[\\n\\r]")[0])
    first_line = F.regexp_replace(first_line, "^ㅁ ", "")
    base = F.when(_filled(F.col("_title")), F.col("_title")).otherwise(F.concat("item_no", F.lit(" legal item")))
    category = F.when(_filled(F.col("category")), F.col("category"))
    core = core_requirement(F.col("requirement_text"), F.col("example_sentence"))
    content = F.concat_ws(
        "\n",
        _line("category", F.col("category")),
        _line("core_requirement_text", core),
        F.concat(F.lit("requirement_text: "), F.coalesce("requirement_text", F.lit(""))),
        _line("example_sentence", F.col("example_sentence")),
        _line("case_text", F.col("case_text")),
    )
    return joined.select(
        F.lit("requirement_db").alias("source_type"), F.lit("legal_requirement").alias("source_name"),
        F.lit(None).cast("string").alias("sheet_name"), "row_no", "item_no",
        F.concat(base, F.lit(" - "), F.coalesce(category, F.lit("criteria")), F.lit(": "), tx.head(first_line, 80)).alias("title"),
        F.coalesce(category, F.lit("criteria")).alias("category"), content.alias("content"),
    )


def reference_docs(examples: DataFrame) -> DataFrame:
    """One document per reference example, with a running row number over the whole table."""
    numbered = blocks.position_in_document(examples.withColumn("_all", F.lit(0)), ["_all"], "row_id", ["row_id"], "row_no")
    return numbered.select(
        F.lit("reference_example_db").alias("source_type"), F.lit("legal_reference_example").alias("source_name"),
        F.lit(None).cast("string").alias("sheet_name"), "row_no", "item_no",
        F.when(_filled(F.col("reference_type")), F.col("reference_type")).otherwise(F.concat("item_no", F.lit(" reference example"))).alias("title"),
        F.when(_filled(F.col("reference_subtype")), F.col("reference_subtype")).otherwise("reference_example").alias("category"),
        F.coalesce("content", F.lit("")).alias("content"),
    )


def criteria_table(items: DataFrame, requirements: DataFrame, examples: DataFrame) -> DataFrame:
    """All criteria documents with ids in insertion order."""
    docs = (
        criteria_docs(items, requirements, examples).withColumn("_g", F.lit(1))
        .unionByName(requirement_docs(items, requirements).withColumn("_g", F.lit(2)))
        .unionByName(reference_docs(examples).withColumn("_g", F.lit(3)))
    )
    # Ids follow (kind, item, row); they only serve as the last tie-break of the searches.
    return docs.withColumn("doc_id", F.concat_ws(":", "_g", F.lpad("item_no", 6, "0"), F.lpad(F.coalesce("row_no", F.lit(0)).cast("string"), 12, "0"))).drop("_g")


# --- cells ------------------------------------------------------------------------------------------------

ITEM_IN_CELL = "(?<![0-9])([0-9]{1,2}(?:-[0-9]{1,2})?)(?![0-9])"


def extract_item_no(cell: Column) -> Column:
    return F.nullif(F.regexp_extract(tx.text_or_empty(cell), ITEM_IN_CELL, 1), F.lit(""))


def criteria_from_cells(cells: DataFrame) -> DataFrame:
    """Cells (file_name, sheet_name, row_no, col_no from 1, value) -> one document per non-empty row."""
    clean = cells.filter(~F.col("file_name").startswith("~$")).withColumn("value", tx.collapse(F.col("value"))).filter("value <> ''")
    item = F.when(F.col("col_no") <= 5, extract_item_no(F.col("value")))
    rows = clean.withColumn("_item", item).groupBy("file_name", "sheet_name", "row_no").agg(
        F.min_by("value", "col_no").alias("_first"),
        F.min_by("_item", F.when(F.col("_item").isNotNull(), F.col("col_no"))).alias("item_no"),
        F.array_sort(F.collect_list(F.struct("col_no", "value"))).alias("_cells"),
    )
    return rows.select(
        F.lit("criteria_excel").alias("source_type"), F.col("file_name").alias("source_name"), "sheet_name", "row_no", "item_no",
        tx.head(F.col("_first"), 120).alias("title"), F.lit("criteria_excel").alias("category"),
        F.array_join(F.transform("_cells", lambda c: F.concat(c["col_no"].cast("string"), F.lit(": "), c["value"])), "\n").alias("content"),
    )


# --- terms and postings ----------------------------------------------------------------------------------

# Letters whose marks the search ignores.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def index_terms(*columns: Column) -> Column:
    """Runs of letters and digits, lower case, marks dropped."""
    joined = F.translate(F.lower(F.concat_ws(" ", *columns)), MARKED, PLAIN)
    return F.regexp_extract_all(joined, F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))


def query_tokens(query: Column, n: int = 12) -> Column:
    return F.slice(tx.words(query), 1, n)


def build_postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf) over title, category and content."""
    terms = docs.select("doc_id", F.explode(index_terms(F.col("title"), F.col("category"), F.col("content"))).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def item_alias(df: DataFrame, column: str = "item_no") -> DataFrame:
    """Adds `alias_no`: an item expands to its alias group."""
    group = F.when(F.col(column).isin("2", "2-1"), F.array(F.lit("2"), F.lit("2-1"))).otherwise(F.array(F.col(column)))
    return df.withColumn("alias_no", F.explode(group))


def _priority(mapping: dict[str, int]) -> Column:
    order = F.lit(4)
    for source, rank in mapping.items():
        order = F.when(F.col("source_type") == source, rank).otherwise(order)
    return order


#: Documents of one item and source that share a block of postings.
BLOCK_DOCS = 32


def wanted_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, item_no, times): the terms of each query (query_id, item_no, query), for each item of its group."""
    repeats = queries.select("query_id", F.explode(query_tokens(F.col("query"))).alias("_t")).groupBy(
        "query_id", F.translate(F.lower("_t"), MARKED, PLAIN).alias("term")).agg(F.count(F.lit(1)).alias("times"))
    return repeats.join(item_alias(queries.select("query_id", "item_no")).select("query_id", F.col("alias_no").alias("item_no")).distinct(), "query_id")


def impact_postings(docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(term, item_no, source_type, block, top, entries): the weight of a term in each document of a block, and the greatest of them.

    `asked` (term) restricts it to terms that are asked for.  Weights hold what concerns the whole table, so a stored result is read by
    (term, item_no) alone.
    """
    sized = docs.select("doc_id", "item_no", "source_type", index_terms(F.col("title"), F.col("category"), F.col("content")).alias("_terms"))
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_terms")).alias("avg_len"))
    rows = sized.select("doc_id", "item_no", "source_type", F.size("_terms").alias("doc_len"), F.explode("_terms").alias("term"))
    if asked is not None:
        rows = rows.join(asked.select("term").distinct(), "term", "left_semi")
    tf = rows.groupBy("term", "doc_id", "item_no", "source_type", "doc_len").agg(F.count(F.lit(1)).alias("tf"))
    block = F.floor(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) % F.greatest(F.lit(1), F.col("_docs") / BLOCK_DOCS).cast("long")).cast("int")
    sizes = docs.groupBy("item_no", "source_type").agg(F.count(F.lit(1)).alias("_docs"))
    blocked = tf.join(sizes, ["item_no", "source_type"]).withColumn("block", block)
    gathered = blocked.groupBy("term", "item_no", "source_type", "block").agg(F.collect_list(F.struct("doc_id", "doc_len", "tf")).alias("_e"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, avg_len = stats.select("n").scalar(), stats.select("avg_len").scalar()
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(pack.BM25_MIN_IDF))
    weighed = gathered.join(df.withColumn("idf", idf), "term").withColumn("_avg", avg_len)
    entries = F.transform("_e", lambda e: F.struct(e["doc_id"].alias("doc_id"), (
        F.col("idf") * e["tf"] * (pack.BM25_K1 + 1) / (e["tf"] + pack.BM25_K1 * (1 - pack.BM25_B + pack.BM25_B * e["doc_len"] / F.col("_avg")))
    ).alias("w")))
    return weighed.select("term", "item_no", "source_type", "block", entries.alias("entries")).withColumn("top", F.array_max(F.transform("entries", lambda e: e["w"])))


def block_bounds(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, item_no, source_type, block, bound): no document of the block scores higher for the query."""
    met = postings.select("term", "item_no", "source_type", "block", "top").join(wanted, ["term", "item_no"])
    return met.groupBy("query_id", "item_no", "source_type", "block").agg(F.sum(F.col("top") * F.col("times")).alias("bound"))


def _score_blocks(postings: DataFrame, wanted: DataFrame, chosen: DataFrame) -> DataFrame:
    place = ["item_no", "source_type", "block"]
    needed = chosen.select("query_id", *place).join(wanted, ["query_id", "item_no"])
    rows = needed.join(postings, ["term", *place]).select("query_id", "item_no", "source_type", "times", F.explode("entries").alias("e"))
    hits = rows.groupBy("query_id", F.col("e.doc_id").alias("doc_id"), "item_no", "source_type").agg(F.sum(F.col("e.w") * F.col("times")).alias("score"))
    return hits.withColumn("score", F.round("score", 6))


def open_blocks(bounds: DataFrame, probed: DataFrame, limit: int) -> DataFrame:
    """Blocks whose bound reaches the last of the `limit` best of the probed documents of a query, or any if those are fewer."""
    order = [_priority(pack.SOURCE_PRIORITY), F.col("score").desc(), F.col("doc_id")]
    last = blocks.first_rows(probed, ["query_id"], order, limit).filter(F.col("rank") == limit).select("query_id", _priority(pack.SOURCE_PRIORITY).alias("_p"), F.col("score").alias("_s"))
    held = bounds.join(last, "query_id", "left")
    own = _priority(pack.SOURCE_PRIORITY)
    # the slack covers rounding to six places and the order of sums
    return held.filter(F.col("_p").isNull() | (own < F.col("_p")) | ((own == F.col("_p")) & (F.col("bound") + 1e-5 >= F.col("_s")))).drop("_p", "_s")


def search_postings(postings: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """Best documents per query over stored postings (impact_postings): by source priority, then relevance.

    Every block in question holds a document that counts.  The first `limit` blocks of a query by priority and bound are scored; of
    the others only those that can still reach its best `limit` documents are, the rest are skipped.
    """
    wanted = cut_lineage(wanted_terms(queries))
    bounds = cut_lineage(block_bounds(postings, wanted))
    first = [_priority(pack.SOURCE_PRIORITY), F.col("bound").desc(), F.col("item_no"), F.col("block")]
    ranked = bounds.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(*first)))
    probed = cut_lineage(_score_blocks(postings, wanted, blocks.first_rows(bounds, ["query_id"], first, limit, "_n").drop("_n")))
    more = _score_blocks(postings, wanted, open_blocks(ranked.filter(F.col("_n") > limit).drop("_n"), probed, limit))
    order = [_priority(pack.SOURCE_PRIORITY), F.col("score").desc(), F.col("doc_id")]
    return blocks.first_rows(probed.unionByName(more), ["query_id"], order, limit)


def bm25_search(docs: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """Best documents per query (query_id, item_no, query): by source priority, then relevance.

    Postings hold the terms that some query asks for; they are staged, and queries meet them by term and item.
    """
    return search_postings(cut_lineage(impact_postings(docs, wanted_terms(queries))), queries, limit)


def _row_order(priority: dict[str, int]) -> list[Column]:
    return [_priority(priority), F.col("row_no").asc_nulls_first(), F.col("doc_id")]


def like_search(docs: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """Documents of the query's item group that contain one of its first five tokens, ASCII case ignored.

    Texts are searched once for all tokens by one pattern; the best documents of each (item, token) are kept before queries meet
    them, so no text and no pair of document and query moves.  A query without tokens takes the first documents of its items.
    """
    order = _row_order(pack.SOURCE_PRIORITY)
    asked = item_alias(queries).select("query_id", F.col("alias_no").alias("item_no"), F.slice(tx.words(F.lower("query")), 1, 5).alias("_tokens")).distinct()
    told = cut_lineage(asked.select("query_id", "item_no", F.explode("_tokens").alias("term")).distinct())
    starts, regex = ev.term_starts(told.select("item_no", "term"))
    text = F.lower(F.concat_ws("\n", "title", "category", "content"))
    found = docs.select("doc_id", "item_no", "source_type", "row_no", F.explode(ev.longest_or_none(text, regex)).alias("longest"))
    met = found.join(starts, ["longest", "item_no"]).select("doc_id", "item_no", "source_type", "row_no", "term").distinct()
    best = blocks.first_rows(met, ["item_no", "term"], order, limit, "_n").drop("_n")
    by_token = best.join(told, ["item_no", "term"]).select("query_id", "doc_id", "item_no", "source_type", "row_no").distinct()
    open_ = asked.filter(F.size("_tokens") == 0).select("query_id", "item_no")
    by_item = _first_of_items(docs, order, limit).join(open_, "item_no").select("query_id", "doc_id", "item_no", "source_type", "row_no")
    return blocks.first_rows(by_token.unionByName(by_item), ["query_id"], order, limit)


def _first_of_items(docs: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return blocks.first_rows(docs.select("doc_id", "item_no", "source_type", "row_no"), ["item_no"], order, limit, "_n").drop("_n")


def item_fallback(docs: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """First documents of the query's item group; those of each item are settled before queries meet them."""
    order = _row_order(pack.FALLBACK_PRIORITY)
    asked = item_alias(queries).select("query_id", F.col("alias_no").alias("item_no")).distinct()
    found = _first_of_items(docs, order, limit).join(asked, "item_no").select("query_id", "doc_id", "item_no", "source_type", "row_no")
    return blocks.first_rows(found, ["query_id"], order, limit)


def default_queries(items: DataFrame) -> DataFrame:
    """Query of each item: its alias group and four fixed words."""
    group = F.when(F.col("item_no").isin("2", "2-1"), "2 2-1").otherwise(F.col("item_no"))
    return items.select(
        F.col("item_no").alias("query_id"), "item_no", F.concat_ws(" ", group, *[F.lit(w) for w in pack.DEFAULT_QUERY_WORDS]).alias("query")
    )


# --- context -----------------------------------------------------------------------------------------------


def authoritative_hits(items: DataFrame, fresh: DataFrame) -> DataFrame:
    """Criteria documents of the item's group, ahead of whatever a search finds."""
    asked = item_alias(items.select("item_no")).select(F.col("item_no").alias("query_item"), F.col("alias_no").alias("item_no"))
    docs = fresh.filter("source_type = 'criteria_db'").join(asked, "item_no")
    return docs.select(
        "query_item", F.lit(0).alias("rank_group"), F.when(F.col("item_no") == "2-1", 2).otherwise(1).alias("rank"), "item_no",
        F.lit("authoritative_criteria_db").alias("source_type"), "source_name", F.coalesce("title", F.lit("")).alias("title"),
        "category", F.col("content").alias("snippet"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("double").alias("score"),
    )


def tacit_hits(items: DataFrame, tacit: DataFrame) -> DataFrame:
    """Knowledge rows of the item's group and the common ones, in insertion order."""
    asked = item_alias(items.select("item_no")).select(F.col("item_no").alias("query_item"), "alias_no")
    common = items.select(F.col("item_no").alias("query_item"), F.lit(pack.COMMON_ITEM).alias("alias_no"))
    rows = tacit.join(asked.unionByName(common).withColumnRenamed("alias_no", "item_no"), "item_no")
    return rows.select(
        "query_item", F.lit(2).alias("rank_group"), F.col("row_id").cast("int").alias("rank"), "item_no",
        F.lit("tacit_knowledge").alias("source_type"), F.lit("legal_tacit_knowledge").alias("source_name"),
        F.coalesce("title", F.lit("")).alias("title"), F.lit("operational_tacit_knowledge").alias("category"),
        F.coalesce("content", F.lit("")).alias("snippet"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("double").alias("score"),
    )


def merge_hits(hits: DataFrame) -> DataFrame:
    """First of the hits that share item, source type, title and the first 160 characters of the snippet."""
    key = ["query_item", "item_no", "source_type", "title", tx.head(F.col("snippet"), 160).alias("_s")]
    rest = [c for c in hits.columns if c not in ("query_item", "item_no", "source_type", "title")]
    first = hits.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("rank_group", "rank")).alias("_h"))
    return first.select("query_item", "item_no", "source_type", "title", *[F.col(f"_h.{c}").alias(c) for c in rest]).select(*hits.columns)


def context_for_items(items: DataFrame, docs: DataFrame, tacit: DataFrame, limit: int = 8) -> DataFrame:
    """Ordered hits per item: fresh criteria, then what the search cascade keeps, then tacit knowledge."""
    queries = default_queries(items)
    ranked = bm25_search(docs, queries, limit).select("query_id", "doc_id", "rank", F.col("score"))
    open1 = queries.join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    liked = like_search(docs, open1, limit).select("query_id", "doc_id", "rank", F.lit(0.0).alias("score"))
    open2 = open1.join(liked.select("query_id").distinct(), "query_id", "left_anti")
    last = item_fallback(docs, open2, limit).select("query_id", "doc_id", "rank", F.lit(0.0).alias("score"))
    kept = F.when(F.col("query_id").isin("2", "2-1"), 2).otherwise(1)
    found = ranked.unionByName(liked).unionByName(last).filter(F.col("rank") <= kept)
    location = F.nullif(F.concat_ws(" / ", "sheet_name", F.when(F.col("row_no") > 0, F.concat(F.lit("row "), F.col("row_no").cast("string")))), F.lit(""))
    searched = found.join(docs, "doc_id").select(
        F.col("query_id").alias("query_item"), F.lit(1).alias("rank_group"), F.col("rank").cast("int").alias("rank"), "item_no", "source_type", "source_name",
        F.coalesce("title", F.lit("")).alias("title"), "category", F.col("content").alias("snippet"), location.alias("location"), (-F.col("score")).alias("score"),
    )
    merged = merge_hits(authoritative_hits(items, docs).unionByName(searched))
    return merged.unionByName(tacit_hits(items, tacit))


def coverage_report(items: DataFrame, hits: DataFrame) -> DataFrame:
    """Per item: hits, item numbers, sources, sample titles, and whether a source is contaminated."""
    bad = tx.contains_any(F.col("source_name"), pack.CONTAMINATION_MARKERS)
    found = hits.groupBy("query_item").agg(
        F.count(F.lit(1)).alias("hit_count"),
        F.array_sort(F.collect_set("item_no")).alias("hit_item_nos"),
        F.array_sort(F.collect_set("source_name")).alias("sources"),
        F.count_if(bad).alias("contaminated_hits"),
    )
    samples = blocks.first_rows(hits, ["query_item"], [F.col("rank_group"), F.col("rank")], 3, "_k").groupBy("query_item").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_k", "title"))), lambda s: s["title"]).alias("sample_titles")
    )
    joined = items.select(F.col("item_no").alias("query_item")).join(found, "query_item", "left").join(samples, "query_item", "left")
    return joined.fillna(0, ["hit_count", "contaminated_hits"]).withColumn("ok", F.col("hit_count") > 0)


# --- page search --------------------------------------------------------------------------------------------


def snippet(text: Column, query: str, radius: int = 160) -> Column:
    source = tx.text_or_empty(text)
    at = F.locate(query.lower(), F.lower(source)) - 1
    start = F.greatest(at - radius, F.lit(0))
    stop = F.least(at + len(query) + radius, F.length(source))
    cut = F.concat(
        F.when(start > 0, "...").otherwise(""), F.substring(source, start + 1, stop - start), F.when(stop < F.length(source), "...").otherwise("")
    )
    if not query:
        return tx.head(source, radius * 2)
    return F.when(at < 0, tx.head(source, radius * 2)).otherwise(cut)


def search_pages(page: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """Substring search in every document: at most `limit` pages each, in page order, with snippets.

    `%` and `_` of the query keep their wildcard meaning.
    """
    found = page.filter(F.col("page_text").ilike(f"%{query}%"))
    narrow = found.select("document_id", "page_no", "seq", "printed_page_no", snippet(F.col("page_text"), query).alias("snippet"))
    top = blocks.first_rows(narrow, ["document_id"], [F.col("page_no"), F.col("seq")], limit)
    return top.select(
        "document_id", "rank", tx.display_page_no_simple(F.col("printed_page_no"), F.col("page_no")).alias("page"), F.col("page_no").alias("pdf_page"), "snippet"
    )


def rebuild_criteria(items: DataFrame, requirements: DataFrame, examples: DataFrame, tacit: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corrected items, criteria documents derived from them, and the row count of each table."""
    fixed = items
    for item_no, title in pack.TITLE_CORRECTIONS.items():
        fixed = fixed.withColumn("title", F.when(F.col("item_no") == item_no, title).otherwise(F.col("title")))
    docs = criteria_table(fixed, requirements, examples)
    tables = {"legal_item": fixed, "legal_requirement": requirements, "legal_reference_example": examples, "legal_tacit_knowledge": tacit, "rag_document": docs}
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    return fixed, docs, counts
