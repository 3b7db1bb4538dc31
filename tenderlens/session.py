"""Session set-up and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int | None = None, memory: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName("tenderlens")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_OWN_FOLDERS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the session's own setting, a temporary one only in local mode."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="tenderlens-checkpoint-")
    return _OWN_FOLDERS[app]


_OWNERS: list[list[str]] = []


@contextlib.contextmanager
def owning(paths: list[str]) -> Iterator[None]:
    """Paths of the tables that are staged meanwhile are added to `paths`."""
    _OWNERS.append(paths)
    try:
        yield
    finally:
        _OWNERS.pop()


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders by Spark's own file systems; the list is empty afterwards."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared checkpoint folder and go on from that table.

    Later stages then neither recompute it nor depend on the executors that did, read only the columns they
    need, and let Spark choose joins by the table's real size.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tenderlens-{uuid.uuid4().hex}"
    if _OWNERS:
        _OWNERS[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
