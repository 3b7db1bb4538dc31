"""What several operators share: staged tables, Arrow batches, compact number and word lists."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.session import checkpoint_dir

#: A-Z to a-z in a byte string; other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Who owns what is staged now, the innermost last.
_OWNERS: list[list[str]] = []


@contextlib.contextmanager
def owning(paths: list[str]) -> Iterator[None]:
    """Paths of what is staged meanwhile are added to `paths`."""
    _OWNERS.append(paths)
    try:
        yield
    finally:
        _OWNERS.pop()


def own_table(name: str) -> None:
    """The owner of what is staged now also drops this table."""
    if _OWNERS:
        _OWNERS[-1].append(f"table {name}")


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged folders by Spark's own file systems, and drop owned tables; the list is empty afterwards."""
    while paths:
        what = paths.pop()
        if what.startswith("table "):
            spark.sql(f"DROP TABLE IF EXISTS {what[6:]}")
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(what)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder of `spark.checkpoint.dir`."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"
    if _OWNERS:
        _OWNERS[-1].append(path)
    return path


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write `df` once to the shared folder and go on from there: later steps neither repeat the work nor need the executors that did it."""
    path = stage_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, what: str, by: str) -> DataFrame:
    """Like stage(), as a table bucketed by a column: rows met by that column later do not move again."""
    spark, name = df.sparkSession, f"llm_{what}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", stage_path(spark, what)).bucketBy(partitions(spark), by).saveAsTable(name)
    own_table(name)
    return spark.table(name)


#: Bits of a key filter for each key, and at most: 16 MB.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 27


def key_filter(keys: DataFrame, key: str) -> np.ndarray:
    """Which of its places the hashes of the keys take: every key is found again, of other keys few.

    The filter stays within MOST_FILTER_BITS; beyond eight million keys it lets more others pass, and what is done with them
    is exact anyway.
    """
    bits = 1 << 16
    n = keys.count()
    while bits < min(FILTER_BITS * n, MOST_FILTER_BITS):
        bits *= 2
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    size = 4096  # bytes of one bitmap of Spark
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        own = np.frombuffer(r["bits"], np.uint8)
        out[(r["n"] - 1) * size : r["n"] * size] = own[: len(out) - (r["n"] - 1) * size]
    return out


def may_hold(filter_: np.ndarray, key: str) -> Column:
    """False for a key that is not in the filter's keys. Only the keys' hashes pass through Python."""

    @F.arrow_udf("boolean")
    def held(h: pa.Array) -> pa.Array:
        place = h.to_numpy() % (len(filter_) * 8)
        return pa.array(filter_[place >> 3] >> (place & 7) & 1 == 1)

    return held(F.xxhash64(key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(n).to_pylist() for n in names]


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `size` rows; a batch also ends when its strings and binaries pass `most_bytes`."""
    held: list[tuple] = []
    weight = 0
    wide = [i for i, f in enumerate(schema) if f.type in (pa.string(), pa.binary())]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        for i in wide:
            weight += len(row[i] or "")
        if len(held) >= size or weight >= most_bytes:
            yield out()
            held, weight = [], 0
    if held:
        yield out()


#: Long arrays are worked on in slices of so many values, so that a step's temporary arrays stay small beside them.
SLICE = 1 << 19


def pack(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Unsigned numbers in seven-bit groups, low first, and where each one ends."""
    parts, ends, before = [], np.empty(len(values), np.int64), 0
    for a in range(0, len(values), SLICE):
        data, own = _pack(values[a : a + SLICE])
        ends[a : a + SLICE] = own + before
        before += len(data)
        parts.append(data)
    return b"".join(parts), ends


def _pack(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    v = values.astype(np.uint64)
    n = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = v >= np.uint64(1) << np.uint64(7 * k) if 7 * k < 64 else np.zeros(len(v), bool)
        if not more.any():
            break
        n += more
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    first = ends - n
    for k in range(int(n.max()) if len(v) else 0):
        at = n > k
        part = (v[at] >> np.uint64(7 * k)) & np.uint64(127)
        out[first[at] + k] = part.astype(np.uint8) | ((n[at] > k + 1).astype(np.uint8) << 7)
    return out.tobytes(), ends


def tally(values: np.ndarray, n: int, where: np.ndarray | None = None) -> np.ndarray:
    """How often each number below n occurs (where `where` is true)."""
    total = np.zeros(n, np.int64)
    for a in range(0, len(values), SLICE):
        part = values[a : a + SLICE]
        total += np.bincount(part if where is None else part[where[a : a + SLICE]], minlength=n)
    return total


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    first = np.concatenate(([0], ends[:-1] + 1))
    n = ends - first + 1
    out = np.zeros(len(ends), np.uint64)
    for k in range(int(n.max())):
        at = n > k
        out[at] |= (b[first[at] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def squeeze(values: np.ndarray) -> bytes:
    return zstandard.compress(pack(values)[0], 3)


def expand(data: bytes) -> np.ndarray:
    return unpack(zstandard.decompress(data))


def squeeze_words(words: list[bytes]) -> bytes:
    lengths = pack(np.fromiter(map(len, words), np.int64, len(words)))[0]
    return zstandard.compress(len(lengths).to_bytes(4, "little") + lengths + b"".join(words), 3)


def expand_words(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    at = 4 + int.from_bytes(raw[:4], "little")
    ends = np.cumsum(unpack(raw[4:at])) + at
    return [raw[a:b] for a, b in zip([at, *ends[:-1].tolist()], ends.tolist(), strict=False)] if len(ends) else []


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
