"""The internal assessment makes the texts of assessed items alone."""

from tenderlens.operators import wording as wd


def test_only_assessed_items_are_read(spark):
    final = spark.createDataFrame([(1, str(n), [3], ["하도급"]) for n in [*range(1, 19)]] + [(1, None, [3], ["하도급"])], "document_id long, item_no string, evidence_pages array<int>, evidence_text array<string>")
    done = wd.assess_rows(final.repartition(2))
    assert "IN (4,5,6)" in done._jdf.queryExecution().optimizedPlan().toString()
    assert {r["item_no"] for r in done.collect()} == {"4", "5", "6"}
