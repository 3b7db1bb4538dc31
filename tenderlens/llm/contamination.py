"""Benchmark decontamination by suffix arrays over shards of the corpus."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, columns

#: Words of a shard; a shard holds whole documents and is closed once it has so many, which bounds a task's memory.
SHARD_WORDS = 1_500_000
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is searched in several blocks, one after another.
BLOCK_BYTES = 32 << 20
#: Word bytes: digits, letters in lower case, everything beyond ASCII; the rest becomes a blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `ids` (0 between documents) in the order of the `depth` numbers that follow each, by prefix doubling from three."""
    n = len(ids)
    wide = int(ids.max(initial=0)) + 1
    padded = np.concatenate((ids, np.zeros(2, ids.dtype))).astype(np.int64)
    key = (padded[:n] * wide + padded[1 : n + 1]) * wide + padded[2:] if wide < 2_000_000 else padded[:n]
    k = 3 if wide < 2_000_000 else 1
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate(([True], key[order][1:] != key[order][:-1])) if n else np.zeros(0, bool)
    while k < depth and n:
        start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank = np.zeros(n + k, np.int64)
        rank[order] = start + 1
        alone = fresh & np.concatenate((fresh[1:], [True]))
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        at = order[tied]
        key = rank[at] * (n + 1) + rank[np.minimum(at + k, n + k - 1)]
        by = np.argsort(key, kind="stable")
        order[tied] = at[by]
        key = key[by]
        fresh[tied[1:]] |= key[1:] != key[:-1]
        k *= 2
    return order


class Queries:
    """All suffixes of all benchmark items, as one flat list of words."""

    def __init__(self, items: list[tuple], window: int):
        split = [(str(i), words_of(t)) for i, t in items if i is not None]
        split = [(i, w) for i, w in split if w]
        self.names = [i for i, _ in split]
        self.words = [x for _, w in split for x in w]
        n = np.array([len(w) for _, w in split], np.int64)
        first = np.cumsum(n) - n
        self.item = np.repeat(np.arange(len(split)), n)
        self.length = np.repeat(first + n, n) - np.arange(len(self.words))
        self.need = np.minimum(window, n)[self.item] if len(split) else np.zeros(0, np.int64)
        self.depth = int(n.max(initial=0))


def search(ids: np.ndarray, asked: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, position, length) of every occurrence, in a shard, of a test suffix with at least its window; `asked` are the query words' numbers."""
    order = suffix_array(ids, q.depth)
    padded = np.concatenate((ids, np.zeros(q.depth + 1, ids.dtype)))
    lo, hi = np.zeros(len(asked), np.int64), np.full(len(asked), len(order))
    at = np.flatnonzero(q.length >= q.need)
    for j in range(int(q.need.max(initial=0))):
        at = at[(q.need[at] > j) & (hi[at] > lo[at])]
        if not len(at):
            break
        want = asked[at + j]
        bounds = []
        for least in (0, 1):  # first entry not below the word, then first entry above it
            a, b = lo[at].copy(), hi[at].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                below = padded[order[np.minimum(mid, len(order) - 1)] + j] < want + least
                a = np.where(open_ & below, mid + 1, a)
                b = np.where(open_ & ~below, mid, b)
            bounds.append(a)
        lo[at], hi[at] = bounds
    found = np.flatnonzero((q.length >= q.need) & (hi > lo))
    n = hi[found] - lo[found]
    query = np.repeat(found, n)
    place = order[np.repeat(lo[found] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    length = q.need[query].copy()
    grow = np.arange(len(query))
    while len(grow := grow[length[grow] < q.length[query[grow]]]):
        same = padded[place[grow] + length[grow]] == asked[query[grow] + length[grow]]
        grow = grow[same]
        length[grow] += 1
    return query, place, length


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """Longest verbatim matches of every benchmark suffix in every document.

    Each task lays its documents out in shards, builds a shard's suffix array over words, and finds all test suffixes in it by
    binary search, word by word; nothing is shuffled. One row per input row: `key`, n_words, n_hit (words inside an occurrence
    of a window of `window` item words, or of a whole shorter item), n_items and items_sha256 (ids of items with occurrences,
    sorted as strings, joined by commas), contaminated (n_hit > 0 and share * n_hit >= n_words), longest (words of the longest
    match), spans (start:end word ranges hit, joined by commas). Null text has no words; an item without words, or without id,
    is never found; rows with an id twice are separate rows, items with an id twice count once. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_key).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    kind = docs.schema[key].dataType.simpleString()
    state = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<bigint>").alias("cuts"), F.lit(0).cast("bigint").alias("longest"))
    for b in range(blocks):
        of_block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else items
        shared = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in of_block.toArrow().to_pylist()])
        last = b == blocks - 1
        out = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest bigint, spans string" if last else "text string, items array<string>, cuts array<bigint>, longest bigint"
        state = state.mapInArrow(lambda batches, shared=shared, last=last: _pass(batches, shared, last, window, share), f"key {kind}, {out}")
    return state.withColumnRenamed("key", key)


def _pass(batches: Iterator[pa.RecordBatch], shared, last: bool, window: int, share: int) -> Iterator[pa.RecordBatch]:
    q = Queries(shared.value, window)
    held: list[tuple] = []
    kinds: dict[str, pa.DataType] = {}

    def rows() -> Iterator[tuple]:
        numbers: dict[bytes, int] = {}
        docs: list[tuple] = []
        flat: list[np.ndarray] = []
        size = 0
        for batch in batches:
            kinds["key"] = batch.column("key").type
            for row in zip(*columns(batch, "key", "text", "items", "cuts", "longest"), strict=True):
                words = words_of(row[1])
                for w in words:
                    if w not in numbers:
                        numbers[w] = len(numbers) + 1
                flat.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                docs.append(row)
                size += len(words)
                if size >= SHARD_WORDS:
                    yield from _shard(docs, flat, numbers, q, last, share)
                    numbers, docs, flat, size = {}, [], [], 0
        if docs:
            yield from _shard(docs, flat, numbers, q, last, share)

    made = rows()
    for first in made:  # the key's type is known with the first row
        held.append(first)
        break
    if not held:
        return
    fields = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest", pa.int64()), ("spans", pa.string())] if last else [("text", pa.string()), ("items", pa.list_(pa.string())), ("cuts", pa.list_(pa.int64())), ("longest", pa.int64())]

    def again() -> Iterator[tuple]:
        yield from held
        yield from made

    yield from batches_of(again(), pa.schema([("key", kinds["key"]), *fields]))


def _shard(docs: list[tuple], flat: list[np.ndarray], numbers: dict[bytes, int], q: Queries, last: bool, share: int) -> Iterator[tuple]:
    n = np.array([len(x) for x in flat], np.int64)
    first = np.cumsum(n + 1) - (n + 1)
    zero = np.zeros(1, np.int32)
    ids = np.concatenate([x for y in flat for x in (y, zero)])
    asked = np.fromiter((numbers.get(w, -1) for w in q.words), np.int64, len(q.words))
    query, place, length = search(ids, asked, q) if len(asked) and n.sum() else (np.zeros(0, np.int64),) * 3
    doc = np.searchsorted(first, place, side="right") - 1
    by = np.argsort(doc, kind="stable")
    query, place, length, doc = query[by], place[by], length[by], doc[by]
    cuts = np.searchsorted(doc, np.arange(len(docs) + 1))
    for k, (key, text, items, old, longest) in enumerate(docs):
        a, b = int(cuts[k]), int(cuts[k + 1])
        if a == b and not old:
            ranges, names = [], items or []
        else:
            here = place[a:b] - first[k]
            pairs = np.stack((here, here + q.need[query[a:b]]), 1).tolist() + (np.array(old or [], np.int64).reshape(-1, 2).tolist())
            ranges = []
            for x, y in sorted(pairs):
                if ranges and x <= ranges[-1][1]:
                    ranges[-1][1] = max(ranges[-1][1], y)
                else:
                    ranges.append([x, y])
            names = sorted({q.names[i] for i in np.unique(q.item[query[a:b]]).tolist()} | set(items or []))
            longest = max(longest, int(length[a:b].max(initial=0)))
        if last:
            hit = sum(y - x for x, y in ranges)
            yield key, int(n[k]), hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and share * hit >= int(n[k]), longest, ",".join(f"{x}:{y}" for x, y in ranges)
        else:
            yield key, text, names, [z for r in ranges for z in r], longest
