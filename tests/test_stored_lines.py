"""Stored result lines: repeated hits cost a compressed file little, and a reader passes by what it does not give."""

import os
import random

from pyspark.sql import functions as F

from tenderlens.sources import results as sr

FINAL_ROW = "document_id bigint, item_no string, final_status string, final_result string, is_target boolean, confidence double, evidence_pages array<int>, evidence_text array<string>, reason string, recommendation string, warnings array<string>"
HIT_ROW = "query_item string, rank_group int, rank int, item_no string, source_type string, source_name string, title string, category string, snippet string, location string, score double"
ITEMS = ["1", "2-1", "3", "4", "5", "6"]


def stored(spark, path, n=600):
    draw = random.Random(5)
    final = [(i, ITEMS[i % 6], "ok", "준수", True, 0.5, [1], ["t"], "why", "", []) for i in range(n)]
    hits = [(item, 1, k, item, "criteria_db", "s", f"title {k}", "c", "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=2000)), None, None) for item in ITEMS for k in range(4)]
    finals = spark.createDataFrame(final, FINAL_ROW)
    lines = sr.result_payloads(finals, spark.createDataFrame(hits, HIT_ROW), finals.select("document_id", "item_no", F.lit("rule").alias("route")))
    lines.select("line").write.option("compression", "gzip").text(path)
    return sr.scan_review_results(spark, path)


def test_lines_with_the_same_hits_stand_together(spark, tmp_path):
    path = str(tmp_path / "lines")
    final, _, hits, routes = stored(spark, path)
    size = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".gz"))
    assert size < 400_000  # 600 times 8 KB of hits, of which six are different; 5.3 KB each where they do not stand together
    assert final.count() == 600 and routes.filter("route = 'rule'").count() == 700
    assert hits.filter("query_item = '2'").count() == 400 and hits.count() == 2800
    assert {r.n for r in hits.groupBy("document_id", "query_item").agg(F.count_distinct("snippet").alias("n")).collect()} == {4}


def test_readers_pass_by_other_keys(spark, tmp_path):
    final, reviews, hits, routes = stored(spark, str(tmp_path / "lines"), 12)

    def asked(df):
        return df._jdf.queryExecution().executedPlan().toString()

    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        assert "item_no:string,route:string" in asked(routes)
        assert "snippet" not in asked(final.select("document_id", "final_result")) + asked(routes) and "evidence_text" not in asked(hits) + asked(routes)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert reviews.count() == 0
