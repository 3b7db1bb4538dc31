"""Words, amounts and phrases across page breaks against the joined text of a document."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.operators import judgements
from tenderlens.rules import pack
from tests.conftest import page_row

PARTS = ["상용SW", "상용소프트웨어", "직접구매", "분리발주", "없음", "해당 없음", "제외", "3억원", "2,000만원", "5", "1.5", "억원", " 만원", "가", "나다라 " * 4, "\n", " ", "" , "경쟁입찰", "별표", "3", "34", "종", "미등", "록"]


def joined(rows, doc):
    return " ".join(r[3] for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])) if r[0] == doc and not r[9])


def won(value):
    plain = value.replace(",", "").replace(" ", "")
    number = float(re.search(r"\d+(?:\.\d+)?", plain).group()) if re.search(r"\d", plain) else None
    for unit, size in tx.AMOUNT_UNITS:
        if unit in plain:
            return int(number * size) if number is not None else 0
    return 0


def plain(text):
    words = [*pack.COMMERCIAL_SW, *pack.PURCHASE_ACTIONS]
    negated = any(re.search(f"(?s){w}.{{0,{pack.NEGATION_REACH - len(n)}}}{n}", text) for w in words for n in pack.NEGATIONS)
    amount = 0
    for m in re.finditer(tx.AMOUNT_REGEX, text):
        near = text[max(0, m.start() - 80) : m.end() + 80]
        if any(w in near for w in words):
            amount = max(amount, won(m.group()))
    return negated, amount


def documents(seed, n):
    rng = random.Random(seed)
    rows = []
    for doc in range(n):
        for page in range(1, rng.randrange(2, 40)):
            text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(6)))
            rows.append(page_row(page, text, doc=doc, has_toc=rng.random() < 0.1))
    return rows


def test_facts_equal_those_of_the_joined_text(spark, make_pages):
    rows = documents(1, 80)
    got = {r.document_id: r for r in judgements.purchase_facts(make_pages(rows)).collect()}
    seen = set()
    for doc in {r[0] for r in rows if not r[9]}:
        text = joined(rows, doc)
        compact = "".join(text.split())
        negated, amount = plain(text)
        assert (got[doc].negated, got[doc].sw_amount) == (negated, amount), text
        assert got[doc].has_sw == any(w in compact for w in pack.COMMERCIAL_SW)
        assert got[doc].annex == ("별표3" in compact) and got[doc].kinds == ("34종" in compact) and got[doc].unregistered == ("미등록" in compact)
        seen.add((negated, amount > 0))
    assert len(seen) == 4 and len(got) == len({r[0] for r in rows if not r[9]})


def test_phrases_across_breaks(spark, make_pages, monkeypatch):
    monkeypatch.setattr(judgements, "EDGE_CELL", 32)
    rng = random.Random(2)
    rows = [page_row(p, "".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 5, 60]))), doc=d) for d in range(20) for p in range(1, 30)]
    pieces = judgements.compact_pieces(make_pages(rows), 10).collect()
    for doc in range(20):
        text = "".join(r[3] for r in sorted((r for r in rows if r[0] == doc), key=lambda r: r[2]))
        own = [r.c for r in pieces if r.document_id == doc]
        want = {text[i : i + 10] for i in range(len(text) - 9)}
        have = {part[i : i + 10] for c in own for part in c.split(" ") for i in range(len(part) - 9)}
        assert have == want


def test_no_text_is_windowed(spark, make_pages):
    plan = judgements.offset_index(make_pages(documents(3, 3))).groupBy("document_id").agg(F.count(F.lit(1)))
    text = plan._jdf.queryExecution().toString()
    assert "collect_list" not in text
