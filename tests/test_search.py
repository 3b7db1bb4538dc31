"""Search over blocks of postings against a score of every document; substring search and fall-back against nested loops."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from tenderlens.operators import retrieval as rt
from tenderlens.rules import pack

KINDS = ["criteria_db", "requirement_db", "reference_example_db", "other"]
DOC = "doc_id bigint, item_no string, source_type string, row_no bigint, title string, category string, content string"


def corpus(seed, n, items=("1", "2", "2-1", "3")):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    return [(i, rng.choice(items), rng.choice(KINDS), rng.choice([None, i % 17]), rng.choice(words), rng.choice([None, "cat"]), " ".join(rng.choices(words, weights, k=rng.randrange(1, 30)))) for i in range(n)]


def group(item):
    return ["2", "2-1"] if item in ("2", "2-1") else [item]


def priority(order, kind):
    return order.get(kind, 4)


def scored(docs, queries, limit):
    terms = {d[0]: re.findall(r"[^\W_]+", " ".join(x for x in d[4:7] if x is not None).lower()) for d in docs}
    n, avg = len(docs), sum(map(len, terms.values())) / len(docs)
    df = Counter(t for own in terms.values() for t in set(own))
    out = {}
    for q, item, text in queries:
        asked = Counter(t.lower() for t in re.findall(r"[0-9A-Za-z가-힣]{2,}", text)[:12])
        rows = []
        for d in docs:
            if d[1] not in group(item):
                continue
            tf = Counter(terms[d[0]])
            s = sum(k * max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), pack.BM25_MIN_IDF) * tf[t] * (pack.BM25_K1 + 1) / (tf[t] + pack.BM25_K1 * (1 - pack.BM25_B + pack.BM25_B * len(terms[d[0]]) / avg)) for t, k in asked.items() if t in tf)
            if any(t in tf for t in asked):
                rows.append((priority(pack.SOURCE_PRIORITY, d[2]), -round(s, 6), d[0]))
        out[q] = sorted(rows)[:limit]
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs = corpus(1, 900)
    queries = [(1, "1", "w1 w2 w30"), (2, "2", "w0 w0 w5"), (3, "2-1", "w39"), (4, "3", "nothing here"), (5, "3", "w3 w4 w5 w6")]
    return docs, queries, spark.createDataFrame(docs, DOC), spark.createDataFrame(queries, "query_id bigint, item_no string, query string")


def test_search_equals_a_score_of_every_document(tables):
    docs, queries, docs_df, queries_df = tables
    want = scored(docs, queries, 8)
    got = {}
    for r in rt.bm25_search(docs_df, queries_df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 5)))
    for q, rows in want.items():
        assert [(d, round(-s, 5)) for _, s, d in rows] == [(d, pytest.approx(s, abs=2e-5)) for d, s in got.get(q, [])]


def test_blocks_that_cannot_count_are_skipped(tables):
    _, _, docs_df, queries_df = tables
    wanted = rt.wanted_terms(queries_df)
    postings = rt.impact_postings(docs_df)
    assert {"term", "item_no"} <= set(postings.columns)
    bounds = rt.block_bounds(postings, wanted)
    everything = rt._score_blocks(postings, wanted, bounds)
    assert everything.join(bounds, ["query_id", "item_no", "source_type"]).groupBy("query_id").count().count() == 4
    left = rt.open_blocks(bounds, everything, 8)
    assert 0 < left.count() < bounds.count() / 2


def test_token_search_equals_a_nested_loop(tables, spark):
    docs, _, docs_df, _ = tables
    queries = [(1, "1", "W1 w2"), (2, "2", "w39 w38 w37 w36 w35 w0"), (3, "3", "!"), (4, "2-1", "w1w"), (5, "1", "")]
    got = {}
    for r in rt.like_search(docs_df, spark.createDataFrame(queries, "query_id bigint, item_no string, query string")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    for q, item, text in queries:
        tokens = re.findall(r"[0-9A-Za-z가-힣]{2,}", text.lower())[:5]
        rows = [
            (priority(pack.SOURCE_PRIORITY, d[2]), d[3] is not None, d[3] or 0, d[0])
            for d in docs if d[1] in group(item) and (not tokens or any(t in "\n".join(x for x in d[4:7] if x is not None).lower() for t in tokens))
        ]
        assert got.get(q, []) == [r[-1] for r in sorted(rows)[:8]]


def test_fallback_equals_a_nested_loop(tables):
    docs, queries, docs_df, queries_df = tables
    got = {}
    for r in rt.item_fallback(docs_df, queries_df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    for q, item, _ in queries:
        rows = [(priority(pack.FALLBACK_PRIORITY, d[2]), d[3] is not None, d[3] or 0, d[0]) for d in docs if d[1] in group(item)]
        assert got[q] == [r[-1] for r in sorted(rows)[:8]]


def test_no_text_in_joins(tables):
    _, _, docs_df, queries_df = tables
    for found in (rt.like_search(docs_df, queries_df), rt.item_fallback(docs_df, queries_df)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.split("\n") if "Join" in line]
        assert joins and "content" not in "".join(joins)
