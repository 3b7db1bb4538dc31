"""Regeneration words its rows once for the opinion and the workflow."""

from pyspark.sql import functions as F

from tenderlens.operators import feedback as fb
from tenderlens.operators import wording as wd
from tenderlens.rules import pack


def test_both_summaries_read_the_same_worded_rows(spark):
    final = spark.createDataFrame([
        (1, "3", "done", pack.SUPPLEMENT, True, 0.9, [1], ["text"], "why", "do"), (1, "4", "done", pack.COMPLIANT, True, 0.5, [2], ["text"], "why", ""),
        (2, "3", "done", pack.NON_COMPLIANT, True, 0.9, [1], ["text"], "why", "do"),
    ], "document_id long, item_no string, final_status string, final_result string, is_target boolean, confidence double, evidence_pages array<int>, evidence_text array<string>, reason string, recommendation string")
    final = final.withColumn("warnings", F.array().cast("array<string>"))
    feedback = spark.createDataFrame([(1, "4", "", "", "", False, True)], "document_id long, item_no string, comment string, corrected_result string, manual_content string, manual_edited boolean, resolved boolean")
    hits = spark.createDataFrame([], "query_item string, rank_group int, rank int, source_type string, snippet string")
    criteria = spark.createDataFrame([("3", "title", "target", ["text"])], "item_no string, title string, target_text string, requirement_texts array<string>")
    wide, opinion, gate = fb.regenerate(final, feedback, hits, criteria)
    for df in (opinion, gate):
        assert "final_status" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" not in df._jdf.queryExecution().optimizedPlan().toString()
    plain = wd.opinion_summary(wide.withColumn("position", fb.vf_position(F.col("item_no"))))
    assert sorted(map(str, opinion.collect())) == sorted(map(str, plain.collect()))
    assert sorted(map(str, gate.collect())) == sorted(map(str, wd.workflow_gate(wide).collect()))
    assert {r["document_id"]: r["total_count"] for r in opinion.collect()} == {1: 2, 2: 1}
