"""Staged tables are packed tightly, and pairs of pages and criteria are counted in narrow rows."""

import re

from tenderlens.operators import evidence
from tenderlens.session import cut_lineage
from tests.conftest import page_row

HIT = "query_item string, rank_group int, rank int, title string, category string, snippet string"


def test_staged_tables_are_packed(spark):
    assert all(f.endswith(".zstd.parquet") for f in cut_lineage(spark.range(5)).inputFiles())


def test_pairs_are_counted_by_number(spark, make_pages):
    words = cut_lineage(evidence.page_words(make_pages([page_row(1, "alpha bravo charlie delta"), page_row(2, "alpha bravo"), page_row(2, "charlie delta")])))
    hits = spark.createDataFrame([("x", 1, 1, "", "", "alpha bravo charlie delta"), ("y", 1, 1, "", "", "alpha bravo echo foxtrot"), ("x", 1, 2, "", "", "bravo charlie golf")], HIT)
    found = evidence.accepted_overlap(words, hits, 0.5)
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
    assert any("page_no" in d and "_no#" in d.replace("page_no#", "") for d in dealt) and not any("page_no" in d and "query_item" in d for d in dealt)
    assert {(r.item_no, r.coverage, r.page_no, r.keyword) for r in found.collect()} == {("x", 1.0, 1, "alpha"), ("y", 0.5, 1, "alpha")}
