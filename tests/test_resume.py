"""A review that stopped goes on where it stopped and gives what one run gives."""

from __future__ import annotations

import glob
import os

import pytest

from tenderlens.operators import judgements as jd
from tenderlens.plans import review as rv
from tenderlens.plans.store import ReviewStore
from tenderlens.schema import DOCUMENT, REVIEW
from tests.conftest import page_row

ITEMS = ["1", "7", "16"]


@pytest.fixture(scope="module")
def inputs(spark):
    from tenderlens.schema import PAGE

    texts = ["제안요청서 사업개요 요구사항 총괄표", "투입인력 M/M 인력현황 사업수행조직", "하자보수 책임 기간은 1년", "평가항목 배점"]
    pages = spark.createDataFrame([page_row(p, texts[(d + p) % 4] + " 일반 사항 " * 12, doc=d) for d in range(6) for p in range(1, 5)], PAGE)
    documents = spark.createDataFrame([tuple({"document_id": d, "total_pages": 4}.get(f.name) for f in DOCUMENT.fields) for d in range(6)], DOCUMENT)
    items = spark.createDataFrame([("1", "t", "x")], "item_no string, title string, target_text string")
    requirements = spark.createDataFrame([(1, "1", "c", "하자보수 책임 기간", None, None)], "row_id bigint, item_no string, category string, requirement_text string, example_sentence string, case_text string")
    examples = spark.createDataFrame([], "row_id bigint, item_no string, reference_type string, reference_subtype string, content string")
    tacit = spark.createDataFrame([], "row_id bigint, item_no string, title string, content string")
    return pages, documents, (items, requirements, examples, tacit)


def shown(df):
    return sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())


def test_stopped_review_resumes(spark, inputs, tmp_path, monkeypatch):
    pages, documents, criteria = inputs
    whole = rv.review_documents(pages, documents, criteria, ITEMS)
    want = shown(whole.final), shown(whole.reviews)
    calls, item_16, keyword = [], jd.item_16, jd.item_keyword

    def stop(*_):
        raise RuntimeError("stopped")

    monkeypatch.setattr(jd, "item_keyword", lambda s, d, i, n: calls.append(i) or keyword(s, d, i, n))
    monkeypatch.setattr(jd, "item_16", stop)
    path = str(tmp_path / "review")
    with pytest.raises(RuntimeError):
        rv.run_review(path, pages, documents, criteria, ITEMS)
    assert calls == ["1", "7"] and {i for i, _ in ReviewStore(spark, path).complete()} == {"1", "7"}
    monkeypatch.setattr(jd, "item_16", item_16)
    done = rv.run_review(path, pages, documents, criteria, ITEMS)
    assert calls == ["1", "7"]  # not judged again
    assert (shown(done.final), shown(done.reviews)) == want
    rows = rv.item_rows(done, spark.createDataFrame([("1", 0, 1, "criteria_db")], "query_item string, rank_group int, rank int, source_type string")).collect()
    assert len(rows) == 18 and all(r.final.final_result is not None for r in rows) and {len(r.hits) for r in rows if r.item_no == "1"} == {1}


def reviews_of(docs, result):
    return docs.selectExpr("document_id", "'1' AS item_no", "0L AS seq", "'r' AS route_type", f"'{result}' AS result", *[f"cast(null as {f.dataType.simpleString()}) AS {f.name}" for f in REVIEW.fields[5:]])


def test_changed_documents_are_judged_again(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "store"), 4)
    documents = spark.range(20).withColumnRenamed("id", "document_id")
    first = store.fill(documents, {"1": lambda d: reviews_of(d, "first")})
    assert first.count() == 20
    assert store.fill(documents, {"1": lambda d: pytest.fail("judged again")}).count() == 20
    changed = store.reopen(documents.filter("document_id in (1, 2)"))
    assert store.reviews().count() < 20
    rows = store.fill(documents, {"1": lambda d: reviews_of(d, "second")}).collect()
    assert len(rows) == 20 and {r.result for r in rows} == {"first", "second"}
    again = {r.document_id for r in rows if r.result == "second"}
    assert {1, 2} <= again < set(range(20)) and len({*glob.glob(f"{tmp_path}/store/reviews/item=1/bucket=*")}) == 4 and changed


def test_rows_of_an_interrupted_write_do_not_count(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "store"), 2)
    documents = spark.range(6).withColumnRenamed("id", "document_id")
    store.fill(documents, {"1": lambda d: reviews_of(d, "kept")})
    store.reopen(documents.filter("document_id = 0"))
    assert os.path.isdir(f"{tmp_path}/store/reviews") and store.reviews().count() < 6  # the rows are still there
    assert store.fill(documents, {"1": lambda d: reviews_of(d, "kept")}).count() == 6
