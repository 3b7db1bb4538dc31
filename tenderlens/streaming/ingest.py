"""Page ingest as a stream: durable per-page events, latest state, progress, resume, finalisation.

Events go to an append-only log, one folder per micro-batch.  A replayed batch overwrites its own folder, so a
restart from the checkpoint neither loses nor doubles events.  What is derived while the stream runs (progress, finished jobs) is
kept by bucket of the job (state.py), so that a micro-batch reads what it touches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tenderlens.operators import audit, classify, pages
from tenderlens.streaming import state as kept

EVENT = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("version", T.LongType()),
    ]
)
TERMINAL = ["succeeded", "failed", "canceled"]


def page_ingest_stream(events: DataFrame, log_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append every micro-batch of `events` to the log."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")

    writer = events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_log(spark: SparkSession, log_path: str, schema: T.StructType = EVENT) -> DataFrame:
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(with_batch).parquet(log_path).drop("batch")


def latest_state(log: DataFrame) -> DataFrame:
    """Last write per (job, page)."""
    rest = [c for c in log.columns if c not in ("job_id", "page_no", "version")]
    last = log.groupBy("job_id", "page_no").agg(F.max_by(F.struct(*rest), "version").alias("s"), F.max("version").alias("version"))
    return last.select("job_id", "page_no", "s.*", "version")


def job_progress(state: DataFrame, jobs: DataFrame) -> DataFrame:
    """Processed, failed and by-source counts and percent per job.  jobs: job_id, selected_pages (how many), total_pages."""
    ok = F.col("status") == "succeeded"
    counts = state.groupBy("job_id").agg(
        F.count_if(ok).alias("processed_pages"), F.count_if(F.col("status") == "failed").alias("failed_pages"),
        F.count_if(ok & (F.col("source") == "python_prescan")).alias("python_pages"), F.count_if(ok & (F.col("source") == "gpt")).alias("gpt_pages"),
    )
    names = ["processed_pages", "failed_pages", "python_pages", "gpt_pages"]
    joined = jobs.join(counts, "job_id", "left").fillna(0, names)
    wanted = F.coalesce(F.nullif("selected_pages", F.lit(0)), "total_pages")
    percent = F.when(wanted > 0, F.bround(F.col("processed_pages") / wanted * 100, 0).cast("int")).otherwise(0)
    return joined.withColumn("progress_percent", percent)


def pending_pages(selected: DataFrame, state: DataFrame) -> DataFrame:
    """Selected pages without a success: where a run resumes."""
    done = state.filter("status = 'succeeded'").select("job_id", "page_no")
    return selected.select("job_id", "page_no").distinct().join(done, ["job_id", "page_no"], "left_anti")


def fail_running(state: DataFrame, failures: DataFrame, jobs: DataFrame) -> DataFrame:
    """Transition events: running pages of jobs that failed become failed with the job's error.

    failures: job_id, error.  jobs: job_id, status; terminal jobs are left alone.
    """
    open_jobs = jobs.filter(~F.col("status").isin(TERMINAL)).select("job_id")
    hit = state.filter("status = 'running'").select("job_id", "page_no", "source", "version")
    hit = hit.join(open_jobs, "job_id", "left_semi").join(failures.select("job_id", F.col("error").alias("_e")), "job_id")
    return hit.select("job_id", "page_no", F.lit("failed").alias("status"), "source", F.col("_e").alias("error"), (F.col("version") + 1).alias("version"))


def progress_stream(events: DataFrame, jobs: DataFrame, state_path: str, out_path: str, checkpoint: str, buckets: int = kept.BUCKETS) -> StreamingQuery:
    """job_progress() while events come in.

    The stream keeps the last version of each (job, page) and hands on what changed; a version that comes late changes nothing.
    Changes go into the snapshot of their buckets, and the jobs of a micro-batch get a new row each in `out_path`
    (current_progress).
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select("job_id", "page_no", "s.*", "version").select(*EVENT.fieldNames())
        touched = kept.touched_buckets(changed, "job_id", buckets)
        if not touched:
            return
        store = kept.BucketState(batch.sparkSession, state_path, EVENT, "job_id", buckets)
        rows = store.replace(latest_state(store.before(batch_id, touched).unionByName(changed)), batch_id, touched)
        active = changed.select("job_id").distinct()
        own = kept.pruned(jobs, "job_id", touched, buckets).join(active, "job_id", "left_semi")
        job_progress(rows.join(active, "job_id", "left_semi"), own).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    last = events.groupBy("job_id", "page_no").agg(F.max_by(F.struct("status", "source", "error"), "version").alias("s"), F.max("version").alias("version"))
    return last.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_progress(spark: SparkSession, out_path: str) -> DataFrame:
    """Newest row of each job that progress_stream() has written."""
    rows = spark.read.parquet(out_path)
    rest = [c for c in rows.columns if c not in ("job_id", "batch")]
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select("job_id", "_r.*")


def finished_jobs(selected: DataFrame, state: DataFrame) -> DataFrame:
    """Jobs none of whose selected pages is pending.

    A page is one narrow row, settled by (job, page) and then by job, so memory follows the pages and a job of any size is spread
    over tasks.
    """
    wanted = selected.select("job_id", "page_no", F.lit(True).alias("_wanted"), F.lit(False).alias("_done"))
    done = state.filter("status = 'succeeded'").select("job_id", "page_no", F.lit(False).alias("_wanted"), F.col("page_no").isNotNull().alias("_done"))
    page = wanted.unionByName(done).filter("job_id is not null").groupBy("job_id", "page_no").agg(F.max("_wanted").alias("_wanted"), F.max("_done").alias("_done"))
    return page.groupBy("job_id").agg(F.max("_wanted").alias("_asked"), F.min(~F.col("_wanted") | F.col("_done")).alias("_all")).filter("_asked and _all").select("job_id")


def finalize_documents(page: DataFrame, document: DataFrame, finished: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Finished documents: printed numbers, table runs, audit, status and warning count."""
    own = page.join(finished.select("document_id"), "document_id", "left_semi")
    stored = pages.normalise_for_store(classify.infer_table_pages(pages.fill_printed_page_no(own)))
    scored, _ = audit.audit_documents(stored, document.join(finished.select("document_id"), "document_id", "left_semi"))
    told = stored.groupBy("document_id").agg(F.count_if(F.coalesce(F.length("parser_warning") > 0, F.lit(False))).alias("_own"))
    status = scored.join(told, "document_id", "left").withColumn("parse_warning_count", F.col("audit_warning_count") + F.coalesce("_own", F.lit(0))).drop("_own")
    return status, stored


def _written(spark: SparkSession, out_path: str, batch_id: int) -> DataFrame | None:
    """Documents that other batches have written; a batch that runs again replaces its own folder."""
    try:
        found = spark.read.parquet(out_path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return found.filter(F.col("batch") != batch_id).select("document_id", "bucket")


def finalize_stream(
    events: DataFrame, page: DataFrame, document: DataFrame, selected: DataFrame, state_path: str, out_path: str, checkpoint: str, jobs: DataFrame | None = None,
    buckets: int = kept.BUCKETS,
) -> StreamingQuery:
    """After every micro-batch, documents whose pages are all in are finalised and written.

    Wanted and done pages of the touched jobs are compared by page. State, pages, documents, wanted pages and what is written are
    taken from the touched buckets; tables stored by bucket (state.store_by_bucket) are read in those alone. The result of a batch is its own
    folder. A document that another batch has written is not written again, however often its pages are delivered; nor is one
    whose job (job_id, status in `jobs`) is over.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = kept.touched_buckets(batch, "job_id", buckets)
        if not touched:
            return
        store = kept.BucketState(spark, state_path, EVENT, "job_id", buckets)
        rows = store.replace(latest_state(store.before(batch_id, touched).unionByName(batch.select(*EVENT.fieldNames()))), batch_id, touched)
        active = batch.select("job_id").distinct()
        wanted = kept.pruned(selected, "job_id", touched, buckets).join(active, "job_id", "left_semi")
        done = finished_jobs(wanted, rows.join(active, "job_id", "left_semi")).withColumnRenamed("job_id", "document_id")
        if jobs is not None:
            over = kept.pruned(jobs, "job_id", touched, buckets).filter(F.col("status").isin(TERMINAL))
            done = done.join(over.select(F.col("job_id").alias("document_id")), "document_id", "left_anti")
        earlier = _written(spark, out_path, batch_id)
        if earlier is not None:
            done = done.join(kept.pruned(earlier, "document_id", touched, buckets).select("document_id").distinct(), "document_id", "left_anti")
        own = kept.pruned(page, "document_id", touched, buckets)
        status, _ = finalize_documents(own, kept.pruned(document, "document_id", touched, buckets), done)
        status.withColumn("bucket", kept.bucket_of("document_id", buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{out_path}/batch={batch_id}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hybrid_route_stream(page: DataFrame, accepted_path: str, queue_path: str, checkpoint: str) -> StreamingQuery:
    """Cheap pages are accepted as they are, hard ones queued for extraction."""

    def route(batch: DataFrame, batch_id: int) -> None:
        triaged = classify.triage_pages(batch)
        triaged.filter(~F.col("needs_extraction")).write.mode("overwrite").parquet(f"{accepted_path}/batch={batch_id}")
        triaged.filter("needs_extraction").write.mode("overwrite").parquet(f"{queue_path}/batch={batch_id}")

    return page.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
