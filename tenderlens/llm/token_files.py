"""Token ids in compressed, checksummed files: written in the order of the documents, read back block by block."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, columns, pack, partitions, ragged, unpack
from .range_coder import BLOCK_IDS, decode_blocks, encode_blocks

#: Blocks that a task codes side by side; they bound its memory.
LANES = 1536
#: Words whose ids a Python worker keeps, from task to task.
KEPT_WORDS = 700_000
_HEAD = struct.Struct("<4sBBHIIIII")
_MAGIC, _VERSION = b"TIDB", 1


class WordCoder:
    """Ids of texts under a tokenizers vocabulary; every distinct word, a run of bytes without white space, is encoded once.

    This holds for tokenizers that never join what white space parts, as those do that cut at it or drop it. `by_words=False`
    hands over whole texts instead.
    """

    def __init__(self, definition: str, by_words: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_str(definition), by_words
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.start, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list) -> None:
        made = [e.ids for e in self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)]
        n = np.fromiter(map(len, made), np.int64, len(made))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.start, self.n = np.concatenate((self.start, len(self.flat) + np.cumsum(n) - n)), np.concatenate((self.n, n))
        self.flat = np.concatenate((self.flat, np.fromiter((i for ids in made for i in ids), np.uint32, int(n.sum()))))

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, `end` after each text, and how many each text has."""
        if not self.by_words:
            made = [[*e.ids, end] for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            n = np.fromiter(map(len, made), np.int64, len(made))
            return np.fromiter((i for ids in made for i in ids), np.uint32, int(n.sum())), n
        if len(self.known) > KEPT_WORDS:
            self._clear()
        lists = [(t or "").encode().split() for t in texts]
        words = [w for own in lists for w in own]
        if fresh := list(dict.fromkeys(w for w in words if w not in self.known)):
            self._learn(fresh)
        code = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        sums = np.concatenate(([0], np.cumsum(self.n[code])))
        n = np.diff(sums[np.concatenate(([0], ends))]) + 1
        ids = self.flat[ragged(self.start[code], self.n[code])]
        return np.insert(ids, sums[ends], np.uint32(end)), n


_CODERS: dict[tuple[int, int, bool], WordCoder] = {}


def _coder(definition: str, by_words: bool) -> WordCoder:
    """The worker's coder of a vocabulary; it keeps the words of earlier tasks."""
    key = (len(definition), zlib.crc32(definition.encode()), by_words)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = WordCoder(definition, by_words)
    return _CODERS[key]


def make_frame(ids: np.ndarray, distinct: np.ndarray, code: bytes, pieces: list[tuple]) -> bytes:
    """One block as a part of a file: head, documents, distinct ids, code. Frames follow one another in a file without anything between.

    `pieces` are (key, ordinal of the document in its file, ids of it before this block, ids in this block). Head: `TIDB`, version,
    bytes of a distinct id, two spare bytes, number of ids, of bytes of documents, of distinct ids, CRC-32 of the ids as
    little-endian 32-bit numbers, CRC-32 of what follows the head; then the number of bytes of the code.
    """
    width = 2 if not len(distinct) or int(distinct.max()) < 1 << 16 else 4
    numbers = pack(np.array([[p[1] - pieces[0][1], p[2], p[3]] for p in pieces], np.int64).reshape(-1))[0] if pieces else b""
    listed = zstandard.compress(json.dumps([[p[0] for p in pieces], pieces[0][1] if pieces else 0]).encode(), 3)
    docs = struct.pack("<I", len(listed)) + listed + numbers
    rest = struct.pack("<I", len(code)) + docs + distinct.astype(f"<u{width}").tobytes() + code
    return _HEAD.pack(_MAGIC, _VERSION, width, 0, len(ids), len(docs), len(distinct), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(rest)) + rest


def read_frames(data: bytes | memoryview) -> Iterator[tuple[list[tuple], int, int, np.ndarray, bytes]]:
    """(pieces, number of ids, their CRC-32, distinct ids, code) of every frame of a file; damaged ones raise ValueError."""
    at, data = 0, memoryview(data)
    while at < len(data):
        if len(data) - at < _HEAD.size + 4:
            raise ValueError("a frame ends early")
        magic, version, width, _, n, docs, distinct, crc, check = _HEAD.unpack_from(data, at)
        if magic != _MAGIC or version != _VERSION:
            raise ValueError("not a frame of token ids")
        begin = at + _HEAD.size
        stop = begin + 4 + docs + distinct * width + struct.unpack_from("<I", data, begin)[0]
        if stop > len(data) or zlib.crc32(data[begin:stop]) != check:
            raise ValueError("a frame is damaged")
        listed = struct.unpack_from("<I", data, begin + 4)[0]
        keys, first = json.loads(zstandard.decompress(bytes(data[begin + 8 : begin + 8 + listed])))
        numbers = unpack(bytes(data[begin + 8 + listed : begin + 4 + docs])).reshape(-1, 3).tolist()
        place = begin + 4 + docs
        yield [(k, first + a, b, c) for k, (a, b, c) in zip(keys, numbers, strict=True)], n, crc, np.frombuffer(data[place : place + distinct * width], f"<u{width}").astype(np.uint32), bytes(data[place + distinct * width : stop])
        at = stop


def decode_frames(frames: list) -> Iterator[tuple[list[tuple], np.ndarray]]:
    """(pieces, ids) of frames as read_frames gives them; ids that do not have their CRC-32 raise ValueError."""
    for (pieces, _, crc, _, _), ids in zip(frames, decode_blocks([(n, distinct, code) for _, n, _, distinct, code in frames]), strict=True):
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("ids are not those that were written")
        yield pieces, ids


def _frames(batches: Iterator[pa.RecordBatch], definition: str, end: int, by_words: bool) -> Iterator[tuple]:
    """(part, first, n, frame): the ids of a partition in blocks, first counted within the partition."""
    coder = _coder(definition, by_words)
    ids, keys, sizes, held = [], [], [], 0
    part = first = ordinal = taken = 0  # `taken`: ids of the first held document that are written

    def out(final: bool) -> Iterator[tuple]:
        nonlocal ids, keys, sizes, held, first, ordinal, taken
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        whole = len(flat) if final else len(flat) // BLOCK_IDS * BLOCK_IDS
        blocks = [flat[a : min(a + BLOCK_IDS, whole)] for a in range(0, whole, BLOCK_IDS)]
        doc = 0
        for block, (distinct, code) in zip(blocks, encode_blocks(blocks), strict=True):
            pieces, room = [], len(block)
            while room:
                n = min(room, sizes[doc] - taken)
                pieces.append((keys[doc], ordinal + doc, taken, n))
                room, taken = room - n, taken + n
                if taken == sizes[doc]:
                    doc, taken = doc + 1, 0
            yield part, first, len(block), make_frame(block, distinct, code, pieces)
            first += len(block)
        ids, keys, sizes, held, ordinal = [flat[whole:]], keys[doc:], sizes[doc:], len(flat) - whole, ordinal + doc

    for batch in batches:
        if batch.num_rows:
            part = batch.column("part")[0].as_py()
        texts, own = batch.column("text").to_pylist(), batch.column("key").to_pylist()
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and size < 4 << 20:
                size += len(texts[b] or "")
                b += 1
            got, n = coder.encode(texts[a:b], end)
            ids.append(got)
            keys += own[a:b]
            sizes += n.tolist()
            held += len(got)
            a = b
            if held >= LANES * BLOCK_IDS:
                yield from out(False)
    yield from out(True)


def write_token_files(docs: DataFrame, path: str, definition: str, end: int, key: str = "doc_id", text: str = "text", by_words: bool = True) -> None:
    """Write the ids of all texts, `end` after each, in ascending order of `key`, to files under `path`.

    `definition` is the JSON of a tokenizers vocabulary. Texts are dealt to partitions by ranges of the key, rows that repeat a key
    by ranges of a row number as well, so that no key is too large for one; each partition becomes one file or more, in frames of at
    most BLOCK_IDS ids that start from nothing and carry checksums (make_frame). Spark's own Parquet writer holds the frames as
    binary rows (part, first, n, frame), so that files of lost tasks never count.

    Null keys come first; rows with equal keys stand in the order of their texts' hashes, which equal texts share. A null text is
    the empty one: only `end`. Keys can be integers or strings. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    order = ["key", "hash", "row"]
    numbered = picked.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("key", "text", F.spark_partition_id().alias("part"))
    schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("frame", pa.binary())])
    made = dealt.mapInArrow(lambda b: batches_of(_frames(b, definition, end, by_words), schema), "part int, first bigint, n bigint, frame binary")
    made.write.option("compression", "uncompressed").parquet(path)  # the frames are compressed


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(part, ordinal, key, before, at, n, crc): pieces of documents in decoded frames."""
    held: list[tuple[int, int, tuple]] = []

    def out() -> Iterator[tuple]:
        for (part, first, _), (pieces, ids) in zip(held, decode_frames([h[2] for h in held]), strict=True):
            data, at = memoryview(ids.astype("<u4").tobytes()), 0
            for key, ordinal, before, n in pieces:
                yield part, ordinal, key, before, first + at, n, zlib.crc32(data[4 * at : 4 * (at + n)])
                at += n
        held.clear()

    for batch in batches:
        for part, first, frame in zip(*columns(batch, "part", "first", "frame"), strict=True):
            held += [(part, first, f) for f in read_frames(frame)]
            if len(held) >= LANES:
                yield from out()
    yield from out()


def _zeros_after(bits: int) -> list[int]:
    """What 2 ** bits zero bytes do to each bit of a CRC-32."""
    if bits == 0:
        rows = [(0xEDB88320 if bit == 0 else 1 << bit - 1) for bit in range(32)]
        for _ in range(3):
            rows = [_apply(rows, r) for r in rows]
        return rows
    rows = _zeros_after(bits - 1)
    return [_apply(rows, r) for r in rows]


def _apply(rows: list[int], crc: int) -> int:
    out = 0
    while crc:
        low = crc & -crc
        out ^= rows[low.bit_length() - 1]
        crc ^= low
    return out


class CrcJoiner:
    """CRC-32 of two runs of bytes from those of each."""

    def __init__(self):
        self.zeros: list[list[int]] = []

    def __call__(self, crc: int, after: int, n: int) -> int:
        bit = 0
        while n:
            if bit == len(self.zeros):
                self.zeros.append([_apply(self.zeros[-1], r) for r in self.zeros[-1]] if bit else _zeros_after(0))
            if n & 1:
                crc = _apply(self.zeros[bit], crc)
            n >>= 1
            bit += 1
        return crc ^ after


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    join = CrcJoiner()
    for batch in batches:
        for part, key, first, pieces in zip(*columns(batch, "part", "key", "first", "pieces"), strict=True):
            total, crc = 0, 0
            for p in pieces:
                if p["before"] != total:
                    raise ValueError("a piece of a document is missing")
                total += p["n"]
                crc = join(crc, p["crc"], 4 * p["n"])
            yield part, key, first, total, crc


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """One row per document of the files: `key`, start (ids of all documents before it), n_tokens, ids_crc32, all from the files alone.

    Damaged files raise an error. `kind` is the type of the keys.
    """
    files = spark.read.schema("part int, first bigint, n bigint, frame binary").parquet(path)
    arrow = pa.int64() if kind in ("bigint", "int") else pa.string()
    schema = pa.schema([("part", pa.int32()), ("ordinal", pa.int64()), ("key", arrow), ("before", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])
    shape = "string" if arrow == pa.string() else "bigint"
    pieces = files.select("part", "first", "frame").mapInArrow(lambda b: batches_of(_pieces(b), schema, 20_000), f"part int, ordinal bigint, key {shape}, before bigint, at bigint, n bigint, crc bigint")
    # as many pieces as a document has blocks
    grouped = pieces.groupBy("part", "ordinal").agg(F.first("key").alias("key"), F.min("at").alias("first"), F.sort_array(F.collect_list(F.struct("before", "n", "crc"))).alias("pieces"))
    joined = pa.schema([("part", pa.int32()), ("key", arrow), ("first", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])
    whole = grouped.mapInArrow(lambda b: batches_of(_whole(b), joined, 20_000), f"part int, key {shape}, first bigint, n bigint, crc bigint")
    # one row a partition that was written
    sizes = files.groupBy("part").agg(F.sum("n").alias("ids")).withColumn("base", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return whole.join(sizes, "part").select(F.col("key").cast(kind).alias(key), (F.col("first") + F.col("base")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
