"""Tables that several steps read are derived once: later plans start from the staged rows, not from their source."""

import json

import pytest

from tenderlens.operators import external, pages
from tenderlens.plans import review as rv
from tenderlens.plans.catalog import QUERIES
from tests.conftest import page_row
from tests.test_resume import ITEMS, inputs  # noqa: F401


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    texts = ["alpha bravo charlie delta\nechoes foxtrot golfing hotels india\n- 3 -", "juliet kilos limas\n\nmikes novembers oscars papas quebec romeo", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["locate_evidence", "normalize_cited_pages", "normalize_evidence_pages", "distinct_evidence_pages", "drop_toc_evidence", "replace_pages", "merge_repaired_pages"])
def test_pages_are_derived_once(spark, folder, name):
    df = QUERIES[name](spark, folder)
    df.collect()
    assert not [f for f in df.inputFiles() if "documents.parquet" in f]


def test_replacements_are_settled_once(spark, make_pages, tmp_path):
    make_pages([page_row(1, "old"), page_row(2, "kept")]).write.parquet(str(tmp_path / "page"))
    make_pages([page_row(1, "new", warning="w"), page_row(1, "x", doc=9), page_row(3, "a"), page_row(3, "b")]).write.parquet(str(tmp_path / "new"))
    page, status, rejected = pages.replace_pages(spark.read.parquet(str(tmp_path / "page")), spark.read.parquet(str(tmp_path / "new")))
    assert {(r.page_no, r.page_text) for r in page.collect()} == {(1, "new"), (2, "kept")}
    assert status.first().parse_status == "warning" and sorted(r.reject_reason for r in rejected.collect()) == ["duplicate_page", "duplicate_page", "unknown_document"]
    assert not [f for f in status.inputFiles() if "/new/" in f]


def test_judgement_responses_are_read_once(spark, make_pages, tmp_path):
    page = make_pages([page_row(1, "하자보수 책임 기간은 1년이며 용역계약일반조건 제58조에 따른다", printed=7), page_row(2, "그 밖의 사항")])
    body = json.dumps({"result": "준수", "evidence_pages": ["1"], "evidence_text": ["하자보수 책임 기간은 1년이며 용역계약일반조건 제58조"]}, ensure_ascii=False)
    spark.createDataFrame([(1, "8", body, "general", "llm_review")], "document_id bigint, item_no string, response string, role string, route_type string").write.parquet(str(tmp_path / "told"))
    shape = "query_item string, rank_group int, rank int, item_no string, source_type string, source_name string, title string, category string, snippet string, location string, score double"
    df = external.ingest_judgements(spark.read.parquet(str(tmp_path / "told")), page, spark.createDataFrame([], shape))
    assert [(r.document_id, r.item_no, r.evidence_pages) for r in df.collect()] == [(1, "8", [7])]
    assert not [f for f in df.inputFiles() if "/told/" in f]


def test_a_review_goes_on_from_staged_steps(spark, inputs):  # noqa: F811
    done = rv.review_documents(*inputs, ITEMS)
    assert not [f for f in done.final.inputFiles() if "/reviews/" in f]
