"""A stopped and restarted ingest equals one uninterrupted run."""

import random

from tenderlens.streaming import ingest, state


def rows(start, stop):
    kinds = ["queued", "running", "succeeded", "failed"]
    return [(v % 5, v % 7 + 1, kinds[v % 4], "gpt", "", v) for v in range(start, stop)]


def run(spark, folder, parts):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, ingest.EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(ingest.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        ingest.page_ingest_stream(stream, f"{folder}/log", f"{folder}/commits").awaitTermination()
    return {tuple(r) for r in ingest.latest_state(ingest.read_log(spark, f"{folder}/log")).collect()}


def test_restart_equals_one_run(spark, tmp_path):
    whole = run(spark, str(tmp_path / "a"), [rows(0, 90)])
    parts = run(spark, str(tmp_path / "b"), [rows(0, 31), rows(31, 60), rows(60, 90)])
    assert whole == parts and len(whole) == 35


def test_pending_and_failed_pages(spark):
    state = spark.createDataFrame([(1, 1, "succeeded", "gpt", "", 1), (1, 2, "running", "gpt", "", 2), (2, 1, "running", "gpt", "", 3)], ingest.EVENT)
    wanted = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "job_id bigint, page_no int")
    assert {(r.job_id, r.page_no) for r in ingest.pending_pages(wanted, state).collect()} == {(1, 2), (1, 3), (2, 1)}
    failures = spark.createDataFrame([(1, "no answer"), (2, "late")], "job_id bigint, error string")
    jobs = spark.createDataFrame([(1, "running"), (2, "succeeded")], "job_id bigint, status string")
    got = ingest.fail_running(state, failures, jobs).collect()
    assert [(r.job_id, r.page_no, r.status, r.error, r.version) for r in got] == [(1, 2, "failed", "no answer", 3)]


def progress(spark, folder, parts, jobs):
    for part in parts:
        spark.createDataFrame(part, ingest.EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(ingest.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        ingest.progress_stream(stream, jobs, f"{folder}/state", f"{folder}/out", f"{folder}/commits", 4).awaitTermination()
    return {tuple(r) for r in ingest.current_progress(spark, f"{folder}/out").collect()}


def test_progress_on_the_stream_equals_its_batch_twin(spark, tmp_path):
    jobs = spark.createDataFrame([(i, 7, 9) for i in range(5)], "job_id bigint, selected_pages int, total_pages int")
    every = rows(0, 90)
    late = [(1, 2, "failed", "gpt", "late", 3), (2, 2, "queued", "", "", 1)]  # older versions that come last
    want = {tuple(r) for r in ingest.job_progress(ingest.latest_state(spark.createDataFrame(every + late, ingest.EVENT)), jobs).collect()}
    got = progress(spark, str(tmp_path / "a"), [every[:40], every[40:70], every[70:], late], jobs)
    assert got == want and len(got) == 5
    assert progress(spark, str(tmp_path / "b"), [every[45:], late, every[:45]], jobs) == want


def test_state_reads_the_newest_snapshot_of_touched_buckets(spark, tmp_path):
    store = state.BucketState(spark, str(tmp_path / "s"), ingest.EVENT, "job_id", 4)

    def frame(*jobs, status="running"):
        return spark.createDataFrame([(j, 1, status, "", "", 1) for j in jobs], ingest.EVENT)

    all_four = state.touched_buckets(frame(*range(12)), "job_id", 4)
    assert all_four == [0, 1, 2, 3] and store.now(all_four).count() == 0
    store.replace(frame(*range(12)), 0, all_four)
    some = state.touched_buckets(frame(1, 2), "job_id", 4)
    for batch in (1, 2, 3):
        again = store.replace(state.pruned(frame(*range(12), status=f"s{batch}"), "job_id", some, 4), batch, some)
        assert {r.status for r in again.collect()} == {f"s{batch}"}
    rows_ = {r.job_id: r.status for r in store.now(all_four).collect()}
    own = {r.job_id for r in state.pruned(frame(*range(12)), "job_id", some, 4).collect()}
    assert {j for j, s in rows_.items() if s == "s3"} == own and len(rows_) == 12
    assert {r.status for r in store.before(3, some).collect()} == {"s2"}  # what a batch reads that runs again
    assert {b for b, bucket, _ in store._folders() if bucket in some} <= {2, 3}


def test_bitmaps_tell_complete_jobs(spark):
    wanted = spark.createDataFrame([(1, 1), (1, 40000), (2, 1), (2, 2), (3, 5), (4, None)], "job_id bigint, page_no int")
    done = [(1, 1), (1, 40000), (1, 7), (2, 1), (4, 1), (9, 1)]
    got = ingest.finished_jobs(wanted, spark.createDataFrame([(j, p, "succeeded", "", "", 1) for j, p in done] + [(3, 5, "failed", "", "", 1)], ingest.EVENT))
    assert [r.job_id for r in got.collect()] == [1]


def test_finished_jobs_cost_a_narrow_row_a_page(spark):
    rng = random.Random(5)
    wanted = [(rng.randrange(200), rng.choice([None, 0, -1, *range(1, 40000, 3999)] if k % 9 == 0 else range(1, 4))) for k in range(900)]
    done = [(rng.randrange(200), rng.choice([None, 0, -1, *range(1, 40000, 3999), 1, 2, 3, 1, 2, 3, 1, 2, 3])) for _ in range(4000)] + [(None, 1)]
    jobs = spark.createDataFrame([*wanted, (None, 1)], "job_id bigint, page_no int")
    got = ingest.finished_jobs(jobs, spark.createDataFrame([(j, p, "succeeded", "", "", 1) for j, p in done], ingest.EVENT))
    known = {x for x in done if x[1] is not None}
    expect = sorted({j for j, _ in wanted} - {x[0] for x in wanted if x not in known})
    assert 10 < len(expect) < 190 and sorted(r.job_id for r in got.collect()) == expect
    assert "bitmap" not in got._jdf.queryExecution().optimizedPlan().toString()  # 4 KB a job and span before, however few its pages


def test_tables_stored_by_bucket_are_read_in_part(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "document_id")
    state.store_by_bucket(df, "document_id", str(tmp_path / "t"), 8)
    part = state.pruned(spark.read.parquet(str(tmp_path / "t")), "document_id", [1, 5], 8)
    assert "PartitionFilters: [isnotnull(bucket" in part._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in part._jdf.queryExecution().toString()
    assert {r[0] for r in part.collect()} == {r[0] for r in state.pruned(df, "document_id", [1, 5], 8).collect()}
