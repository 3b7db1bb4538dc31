"""Byte-level BPE over a whole corpus: each distinct pre-token is encoded once, wherever it occurs."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import make_blocks
from .common import batches_of, columns, expand, expand_words, ragged, squeeze, unpack


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a ranks file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Encode every text by byte-level BPE and decode the ids again.

    Matches of `pattern` are pre-tokens. Tasks number the pre-tokens of their documents (positions), the distinct ones are
    shuffled by hash and encoded once each, the ids are joined back by block and put in place by position. Decoding looks every
    id of a document up in the token-byte table, which has one row for each id of the vocabulary.

    One row per input row, repeated rows included: `key`, n_tokens, ids_sha256 (hex of the decimal ids joined by commas),
    decoded_sha256 (hex of the decoded bytes), and `ids` array<int> if asked for. Null or empty text has no tokens. Other columns
    of `docs` are ignored, whatever their names. Nothing is collected; the vocabulary is the only thing broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ranks, pattern))
    parts, dictionaries = make_blocks(docs, key, text, lambda: _splitter(shared))
    encoded = dictionaries.repartition("bucket").select("block", "words", "codes").mapInArrow(lambda batches: _encode(batches, shared), "block binary, codes binary, n_ids binary, ids binary")
    kind = parts.schema["key"].dataType.simpleString()
    out = parts.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(lambda left, right: _reassemble(left, right, shared, ids), f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
    return out.withColumnRenamed("key", key)


def decode_ids(rows: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`key`, decoded (binary) of every row's id array, each id looked up in the broadcast token-byte table, for ids from elsewhere.

    The table has one row for each id of the vocabulary. Null and empty arrays decode to empty binary; a row with an id
    outside the vocabulary decodes to null. One row per input row, nothing is shuffled.
    """
    shared = rows.sparkSession.sparkContext.broadcast({i: b for b, i in ranks.items()})
    kind = rows.schema[key].dataType.simpleString()
    picked = rows.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            found = [[table.get(i) for i in got or []] for got in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([None if None in x else b"".join(x) for x in found], pa.binary())], names=["key", "decoded"])

    return picked.mapInArrow(look_up, f"key {kind}, decoded binary").withColumnRenamed("key", key)


def _splitter(shared):
    import regex

    found = regex.compile(shared.value[1]).findall
    return found


def _encode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    import tiktoken

    ranks, pattern = shared.value
    one = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    schema = pa.schema([("block", pa.binary()), ("codes", pa.binary()), ("n_ids", pa.binary()), ("ids", pa.binary())])
    known: dict[bytes, list[int]] = {}

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for block, words, codes in zip(*columns(batch, "block", "words", "codes"), strict=True):
                found = []
                for w in expand_words(words):
                    if (got := known.get(w)) is None:
                        known[w] = got = one(w)
                    found.append(got)
                n = np.fromiter(map(len, found), np.int64, len(found))
                yield block, codes, squeeze(n), squeeze(np.fromiter((i for got in found for i in got), np.int64, int(n.sum())))

    return batches_of(rows(), schema)


def _reassemble(left: pa.Table, right: pa.Table, shared, ids: bool) -> pa.Table:
    ranks = shared.value[0]
    table: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
    for b, i in ranks.items():
        table[i] = b
    code = np.concatenate([np.cumsum(expand(c)) for c in right.column("codes").to_pylist()] or [np.zeros(0, np.int64)])
    n_ids = np.concatenate([expand(c) for c in right.column("n_ids").to_pylist()] or [np.zeros(0, np.int64)])
    flat = np.concatenate([expand(c) for c in right.column("ids").to_pylist()] or [np.zeros(0, np.int64)])
    width, first = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    width[code], first[code] = n_ids, np.cumsum(n_ids) - n_ids
    listed = flat.tolist()
    shown = [",".join(map(str, listed[a : a + n])) for a, n in zip(first.tolist(), width.tolist(), strict=True)]
    n_tokens, digests, decoded, kept = [], [], [], []
    for data in left.column("codes").to_pylist():
        codes = unpack(data)
        got = flat[ragged(first[codes], width[codes])]
        n_tokens.append(len(got))
        digests.append(hashlib.sha256(",".join([shown[c] for c in codes.tolist()]).encode()).hexdigest())
        decoded.append(hashlib.sha256(b"".join([table[i] for i in got.tolist()])).hexdigest())
        if ids:
            kept.append(got)
    made = {"key": left.column("key"), "n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
    return pa.table(made | ({"ids": pa.array(kept, pa.list_(pa.int32()))} if ids else {}))
