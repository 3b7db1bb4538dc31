"""Term tries against a nested loop, fingerprints against their promise."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tenderlens.functions import patterns as pt
from tenderlens.operators import evidence
from tests.conftest import page_row


def test_longest_terms_of_every_place(spark):
    rng = random.Random(1)
    letters = "abcdeABC가나다라123.*()[]\\"
    terms = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(300)})
    texts = ["".join(rng.choice(letters + " \n") for _ in range(200)) for _ in range(20)] + ["", "zzz"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pt.longest_terms(F.col("t"), pt.trie_regex(terms)).alias("f")).collect()
    for r in got:
        want = {max((x for x in terms if r.t.startswith(x, i)), key=len, default=None) for i in range(len(r.t))} - {None}
        assert set(r.f) == want and len(r.f) == len(want)


def test_hits_count_terms_that_begin_alike(spark, make_pages):
    rng = random.Random(2)
    words = ["가나", "가나다", "가나다라", "나다", "다라마", "abc", "ab", "bcd", "cd12"]
    texts = ["".join(rng.choice([*words, " ", "x"]) for _ in range(12)) for _ in range(40)]
    terms = [(i, w) for i in ("a", "b", "c") for w in rng.sample(words, 6)]
    found = evidence.substring_hits(make_pages([page_row(n, t) for n, t in enumerate(texts, 1)]), spark.createDataFrame(terms, "item_no string, term string"), False)
    got = {(r.page_no, r.item_no): r.hits for r in found.collect()}
    want = {(n, i): k for n, t in enumerate(texts, 1) for i in "abc" if (k := sum(w in t for j, w in terms if j == i))}
    assert got == want


def test_no_terms_no_hits(spark, make_pages):
    none = spark.createDataFrame([], "item_no string, term string")
    assert evidence.substring_hits(make_pages([page_row(1, "text")]), none, False).collect() == []


def test_shared_text_shares_a_fingerprint(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        core = "".join(rng.choice("abc가나") for _ in range(rng.randrange(pt.SURE, 60)))
        rows.append((core, "".join(rng.choice("abc가나") for _ in range(rng.randrange(80))) + core + "".join(rng.choice("abc가나") for _ in range(rng.randrange(80)))))
    rows += [("a" * 30, "b" + "a" * 50), ("ab" * 15, "ab" * 40)]
    df = spark.createDataFrame(rows, "core string, page string").select(pt.first_fingerprint(F.col("core")).alias("p"), pt.fingerprints(F.col("page")).alias("f"))
    assert all(r.p in r.f for r in df.collect())
    short = spark.createDataFrame([("x" * (pt.SURE - 1),), ("",)], "t string").select(pt.first_fingerprint(F.col("t")), pt.fingerprints(F.col("t"))).collect()
    assert [tuple(r) for r in short] == [(None, []), (None, [])]


@pytest.mark.parametrize("letters", ["abcdefghijklmnop가나다라마바사", "ab"])
def test_fingerprints_are_a_fifth_of_the_characters_at_most(spark, make_pages, letters):
    rng = random.Random(4)
    pages = make_pages([page_row(n, "".join(rng.choice(letters) for _ in range(1500))) for n in range(1, 20)])
    assert evidence.page_fingerprints(pages).count() <= 19 * 1500 / 5


def test_located_quotes_equal_a_search_of_all_pages(spark, make_pages):
    rng = random.Random(5)
    texts = {(d, p): "".join(rng.choice("abcd ") for _ in range(rng.randrange(10, 400))) for d in range(3) for p in range(1, 8)}
    texts[0, 9] = texts[0, 3]  # a repeated page
    quotes = []
    for i in range(200):
        d, p = rng.choice(list(texts))
        a = rng.randrange(len(texts[d, p]))
        quotes.append((d, str(i), texts[d, p][a : a + rng.randrange(5, 300)] + ("changed at its end" if i % 3 == 0 else "")))
    compact = {k: "".join(t.split()) for k, t in texts.items()}
    want = {}
    for d, i, quote in quotes:
        q = "".join(quote.split())
        if len(q) < 20:
            continue
        chunks = [q[80 * k : 80 * k + 80] for k in range(min(8, -(-(len(q) - 80) // 80)))] if len(q) > 80 else []
        best = min(((not (w := q[:180] in t), 0 if w else -sum(c in t for c in chunks), p) for (own, p), t in compact.items() if own == d), default=None)
        if best and (not best[0] or best[1] < 0):
            want[d, i] = best[2]
    pages = make_pages([page_row(p, t, doc=d) for (d, p), t in texts.items()])
    got = evidence.locate_evidence(spark.createDataFrame(quotes, "document_id bigint, quote_id string, quote string"), pages).collect()
    assert {(r.document_id, r.quote_id): r.page_no for r in got} == want
