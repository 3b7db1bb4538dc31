"""Rounding by exact binary values, text far apart over short pages, and documents finalised once."""

from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.operators import judgements
from tenderlens.streaming import ingest


def test_shares_round_as_binary_values(spark):
    shares = sorted({min(cap, base + k / n * 0.5) for n in range(1, 60) for k in range(n + 1) if k / n >= 0.7 for cap, base in ((0.9, 0.45), (0.88, 0.42), (1.0, 0.5))} | {0.0, 0.0005, 0.8875, 0.8625, 0.5625, 1.0})
    got = spark.createDataFrame([(x,) for x in shares], "x double").select("x", tx.round_thousandths(F.col("x")).alias("r")).collect()
    assert [(r.x, r.r) for r in got if r.r != round(r.x, 3)] == []
    assert spark.createDataFrame([(None,)], "x double").select(tx.round_thousandths(F.col("x"))).first()[0] is None


def test_amount_is_found_over_many_short_pages(spark, make_pages):
    from tests.conftest import page_row

    pages = make_pages([page_row(1, "상용SW 구매"), *[page_row(k, "가") for k in range(2, 22)], page_row(22, "2억원")])
    assert judgements.purchase_facts(pages).first().sw_amount == 200_000_000
    far = make_pages([page_row(1, "상용SW 구매"), *[page_row(k, "가") for k in range(2, 80)], page_row(80, "2억원")])
    assert judgements.purchase_facts(far).first().sw_amount == 0


def test_a_document_is_finalised_once(spark, make_pages, tmp_path):
    from tests.conftest import page_row
    from tenderlens.schema import DOCUMENT

    pages = make_pages([page_row(1, "제안요청서", doc=1), page_row(1, "제안요청서", doc=2)])
    documents = spark.createDataFrame([tuple({"document_id": d}.get(f.name) for f in DOCUMENT.fields) for d in (1, 2)], DOCUMENT)
    wanted = spark.createDataFrame([(1, 1), (2, 1)], "job_id bigint, page_no int")
    jobs = spark.createDataFrame([(1, "running"), (2, "canceled")], "job_id bigint, status string")
    for version in (1, 2):
        spark.createDataFrame([(d, 1, "succeeded", "gpt", "", version) for d in (1, 2)], ingest.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ingest.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ingest.finalize_stream(stream, pages, documents, wanted, f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/commits", jobs).awaitTermination()
    assert [r.document_id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [1]
