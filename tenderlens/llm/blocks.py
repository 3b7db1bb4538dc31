"""Documents as positions in small dictionaries, so that only distinct words travel.

A task cuts its documents into blocks, gives the words of a block numbers by frequency and writes each document as these
numbers, in order. The distinct words of a block go out in buckets of a hash, many to a row. Whatever is asked of a word
is then settled once where all rows of its bucket meet, and comes back to its block by number. A word that every document
holds costs one entry a block.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, batches_of, columns, pack, partitions, squeeze, squeeze_words, stage_by, tally

#: A block is closed when it holds so many words; this bounds a task's memory, documents stay whole.
BLOCK_WORDS = 8_000_000


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _block(keys: list, codes: list[np.ndarray], flags: list[bool], words: list[bytes], buckets: int) -> Iterator[tuple]:
    lengths = np.fromiter(map(len, codes), np.int64, len(codes))
    flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    codes.clear()  # a block's numbers are held once
    order = np.argsort(-tally(flat, len(words)), kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    for a in range(0, len(flat), SLICE):
        flat[a : a + SLICE] = rank[flat[a : a + SLICE]]
    flagged = tally(flat, len(words), np.repeat(np.array(flags, bool), lengths))
    data, ends = pack(flat)
    del flat
    stop = np.cumsum(lengths)
    cuts = [0, *(ends[stop - 1] * (stop > 0)).tolist()] if len(ends) else [0] * (len(lengths) + 1)
    del ends
    block = uuid.uuid4().bytes
    for key, a, b, flag in zip(keys, cuts[:-1], cuts[1:], flags, strict=True):
        yield block, key, data[a:b], None, None, None, b"" if flag else None
    listed = [words[i] for i in order.tolist()]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in listed), np.int64, len(listed))
    by = np.argsort(bucket, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
        yield block, None, None, int(bucket[part[0]]), squeeze_words([listed[i] for i in part.tolist()]), squeeze(np.diff(part, prepend=0)), squeeze(flagged[part])


def n_buckets(spark: SparkSession) -> int:
    return 4 * partitions(spark)


def make_blocks(docs: DataFrame, key: str, text: str, splitter: Callable[[], Callable[[str], list]], flag: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Two views of one staged table: documents (block, key, codes) and dictionaries (block, bucket, words, codes, flagged).

    `splitter()` is called once in each task and gives text -> list of words, str or bytes; null is the empty text. `codes` of a
    document are its words' numbers (common.unpack); a dictionary row holds words, the steps between their ascending numbers, and
    how often each occurs in rows where `flag` is true. The table is bucketed by block, so that the documents never move again.
    """
    spark = docs.sparkSession
    buckets, kind = n_buckets(spark), docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(flag) if flag else F.lit(False)).alias("flag"))
    schema = pa.schema([("block", pa.binary()), ("key", _arrow(kind)), ("doc", pa.binary()), ("bucket", pa.int32()), ("words", pa.binary()), ("codes", pa.binary()), ("flagged", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        split, numbers = splitter(), _Numbers()
        keys, codes, flags, size = [], [], [], 0

        def closed() -> Iterator[tuple]:
            words = [w if isinstance(w, bytes) else w.encode() for w in numbers]
            return _block(keys, codes, flags, words, buckets)

        for batch in batches:
            for k, t, f in zip(*columns(batch, "key", "text", "flag"), strict=True):
                words = split(t or "")
                keys.append(k)
                flags.append(bool(f))
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                size += len(words)
                if size >= BLOCK_WORDS:
                    yield from closed()
                    numbers = _Numbers()
                    keys, codes, flags, size = [], [], [], 0
        if keys:
            yield from closed()

    made = picked.mapInArrow(lambda batches: batches_of(rows(batches), schema), f"block binary, key {kind}, doc binary, bucket int, words binary, codes binary, flagged binary")
    table = stage_by(made, "blocks", "block")
    flagged = [F.col("flagged").isNotNull().alias("flag")] if flag else []
    return (table.where("bucket IS NULL").select("block", "key", F.col("doc").alias("codes"), *flagged), table.where("bucket IS NOT NULL").select("block", "bucket", "words", "codes", "flagged"))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
