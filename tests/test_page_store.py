"""Joins by page leave the text of a page store where it is."""

from __future__ import annotations

import re

import pytest

from tenderlens.operators import evidence, external
from tenderlens.sources import pages as source_pages
from tests.conftest import page_row


@pytest.fixture
def store(spark, make_pages, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = [page_row(p, f"쪽 {p} 문서 {d} 하자보수 책임 기간은 {p}년으로 하며 {'내용 ' * 20}", doc=d, seq=p) for d in range(5) for p in range(1, 20)]
    page = make_pages(rows)
    yield page, source_pages.store_pages(page, "page_store_test", str(tmp_path / "store"), 8)
    spark.sql("DROP TABLE page_store_test")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def moved(df):
    """Columns of every exchange of the plan, as far as the plan names them."""
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    lines = text.split("\n")
    below = [re.sub(r"#\d+L?", "", lines[i + 1]) for i, line in enumerate(lines[:-1]) if "Exchange hashpartitioning" in line]
    return below


def test_located_quotes_do_not_move_text(spark, store):
    page, stored = store
    quotes = page.selectExpr("document_id", "cast(page_no as string) as quote_id", "substring(page_text, 5, 60) as quote")
    found = evidence.locate_evidence(quotes, stored)
    assert not any("_text" in line for line in moved(found))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in evidence.locate_evidence(quotes, page).collect()}
    assert any("_text" in line for line in moved(evidence.locate_evidence(quotes, page)))  # as it does without the store


def test_a_page_store_holds_all_pages(spark, store):
    page, stored = store
    assert {tuple(r) for r in stored.select(*page.columns).collect()} == {tuple(r) for r in page.collect()}
    both, missing = source_pages.scan_pages(stored, spark.createDataFrame([(1,), (99,)], "document_id bigint"))
    assert both.count() == 19 and [r.document_id for r in missing.collect()] == [99]
    items = spark.createDataFrame([("8",)], "item_no string")
    hits = spark.createDataFrame([("8", 0, 0, "8", "criteria_db", "n", "하자보수", None, "책임 기간", None, None)], "query_item string, rank_group int, rank int, item_no string, source_type string, source_name string, title string, category string, snippet string, location string, score double")
    assert external.request_rows(stored, items, hits).count() == external.request_rows(page, items, hits).count() == 5
