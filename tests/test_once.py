"""What a plan computes once: text inside lambdas, terms of a page, parsed responses, sides of a pairing."""

from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.operators import evidence, verify
from tenderlens.operators import wording as wd
from tenderlens.sources import pages as source_pages
from tenderlens.sources import results as source_results
from tests.conftest import page_row


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_direct_pairs_compact_a_text_once(spark):
    # one for white space, one for the title's length
    df = spark.createDataFrame([([1], ["별지 제4호 서식"])], "evidence_pages array<int>, evidence_text array<string>")
    assert plan(df.select(wd.direct_pairs().alias("p"))).count("regexp_replace") <= 2


def test_reportable_pairs_compact_a_text_once(spark):
    df = spark.createDataFrame([("1", [1], ["본 사업"], "준수", True, "s")], "item_no string, evidence_pages array<int>, evidence_text array<string>, final_result string, is_target boolean, final_status string")
    assert plan(df.select(wd.reportable_pairs().alias("p"))).count("regexp_replace") <= 2


def test_partial_action_strips_references_once(spark):
    text = "제안요청서 p.3에 보안대책을 명시 예를 들어 출입통제"
    df = spark.createDataFrame([(text,), ("  그대로 　",), (None,), ("a -> 제안요청서 등에 b 예시: c",)], "t string")
    done = df.select(wd.partial_action(F.col("t")).alias("a"))
    assert plan(done).count("등에") <= 2
    assert [r.a for r in done.collect()] == ["보안대책을 명시", "그대로", "", "제안요청서에 b"]


def test_strip_takes_every_white_space(spark):
    white = "".join(chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
    row = spark.createDataFrame([(f"{white}a{white}b{white}",)], "t string").select(tx.strip(F.col("t")).alias("s"), tx.strip(F.lit(None).cast("string")).alias("n")).first()
    assert (row.s, row.n) == (f"a{white}b", "")


def test_terms_of_a_page_are_counted_before_the_shuffle(spark, make_pages):
    page = make_pages([page_row(1, "ab abc abd"), page_row(2, "x")])
    terms = spark.createDataFrame([("1", "ab"), ("1", "abc"), ("2", "abd"), ("2", "zz")], "item_no string, term string")
    hits = evidence.substring_hits(page, terms, False)
    assert {(r.page_no, r.item_no, r.hits) for r in hits.collect()} == {(1, "1", 2), (1, "2", 1)}
    assert "count(distinct" not in plan(hits)


def test_rows_of_one_page_key_share_their_terms(spark, make_pages):
    page = make_pages([page_row(1, "t000 t070"), page_row(1, "t070 t099")])
    terms = spark.createDataFrame([("1", f"t{k:03}") for k in range(100)], "item_no string, term string")
    assert [r.hits for r in evidence.substring_hits(page, terms, False).collect()] == [3]
    items = spark.createDataFrame([("x",)], "item_no string")
    hits = spark.createDataFrame([("x", 1, 1, "alpha beta", "", "")], "query_item string, rank_group int, rank int, title string, category string, snippet string")
    twice = make_pages([page_row(1, "alpha"), page_row(1, "alpha beta")])
    assert [(r.page_no, r.score) for r in evidence.rank_evidence_pages(twice, items, hits).collect()] == [(1, 2)]


def test_a_response_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, 1, [1], '{"pages": [{"pdf_page_no": "1", "page_text": "t"}]}'), (1, 2, [2], "none")], "document_id bigint, response_id bigint, requested array<int>, output_text string")
    found, errors = source_pages.scan_page_responses(rows)
    assert plan(found).count("from_json") == 1
    assert ([r.page_text for r in found.collect()], [r.response_id for r in errors.collect()]) == (["t"], [2])


def test_requirements_are_settled_before_they_are_paired(spark):
    schema = "document_id bigint, item_no string, seq bigint, result string, confidence double, evidence_pages array<int>, evidence_text array<string>"
    review = spark.createDataFrame([(1, "1", 1, "준수", 0.5, [3], ["Alpha  BETA"]), (1, "1", 2, "준수", 0.5, [4], ["gamma"])], schema)
    asked = spark.createDataFrame([("1", "r1", "alpha Beta")], "item_no string, requirement_id string, requirement_text string")
    done = verify.fallback_adjudication(review, asked)
    top = plan(done).split("Join")[0]
    assert "regexp" not in top
    assert {(r.seq, r.status) for r in done.collect()} == {(1, "met"), (2, "not_found")}


def test_hits_are_not_shuffled_with_documents(spark):
    final = spark.createDataFrame([(1, "3", "s", "준수", True, 0.5, [1], ["t"], "r", "", [])], "document_id bigint, item_no string, final_status string, final_result string, is_target boolean, confidence double, evidence_pages array<int>, evidence_text array<string>, reason string, recommendation string, warnings array<string>")
    hits = spark.createDataFrame([("3", 1, k, "3", "a", "b", f"title{k}", "c", "d", "e", 1.0) for k in (2, 1)], "query_item string, rank_group int, rank int, item_no string, source_type string, source_name string, title string, category string, snippet string, location string, score double")
    routes = spark.createDataFrame([(1, "3", "llm"), (1, "4", "rule")], "document_id bigint, item_no string, route string")
    done = source_results.result_payloads(final, hits, routes)
    assert plan(done).count("Join") == 1
    line = done.first().line
    assert line.index("title1") < line.index("title2") and '{"item_no":"4","route":"rule"}' in line.replace(',"rag_hit_count":-1', "")
