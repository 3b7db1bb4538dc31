"""Near duplicates by fast similarity sketching, bands and exact comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, batches_of, columns, key_filter, may_hold, ragged, stage
from .components import components

#: Bands and coordinates of one: two sets of similarity 0.8 share no band with a probability of (1 - 0.8 ** 6) ** 40 = 5e-6.
BANDS, ROWS = 40, 6
#: Shingles that one task compares; larger clusters are compared block by block.
BLOCK_SHINGLES = 1_000_000
_EMPTY = np.uint64(2**64 - 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, each computed once in a task as long as there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:  # some 80 MB
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of `size`-word shingles; with fewer words, of the whole sequence; without words, none."""
    words = text.encode().translate(LOWER).split() if text else ()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches: round i < t throws every element into a random coordinate, round t + j into coordinate j, with value i plus a random fraction; the least value stays.

    A set takes part until all its coordinates are filled, at the latest after 2 t rounds.
    """
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    first = np.cumsum(n) - n
    out = np.full((len(sets), t), _EMPTY)
    active = np.flatnonzero(n)
    elements, owner = flat, np.repeat(np.arange(len(sets)), n)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(active):
                break
            h = _mix(elements + np.uint64(i + 1) * np.uint64(0xD1B54A32D192ED03))
            place = (h >> np.uint64(40)) % np.uint64(t) if i < t else np.full(len(h), i - t, np.uint64)
            np.minimum.at(out.reshape(-1), owner * t + place.astype(np.int64), np.uint64(i) << np.uint64(40) | h & np.uint64((1 << 40) - 1))
            left = active[(out[active] == _EMPTY).any(1)]
            if len(left) < len(active):
                active = left
                elements, owner = flat[ragged(first[active], n[active])], np.repeat(active, n[active])
    return out


def band_hashes(sketch: np.ndarray, bands: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, -1)
    out = np.zeros(parts.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(parts.shape[2]):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sketch(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows_: int) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        keys, texts = columns(batch, "key", "text")
        a = 0
        while a < len(keys):
            sets: list[np.ndarray] = []
            held = 0
            while a + len(sets) < len(keys) and held < 1_000_000:
                sets.append(shingles(texts[a + len(sets)], size, known))
                held += len(sets[-1])
            hashes = band_hashes(sketches(sets, bands * rows_), bands)
            b = a + len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([h if len(s) else None for s, h in zip(sets, hashes, strict=True)], pa.list_(pa.int64()))],
                names=["key", "n", "digest", "bands"],
            )
            a = b


def _places(batches: Iterator[pa.RecordBatch], links: bool) -> Iterator[pa.RecordBatch]:
    """Buckets of a task's classes, by chunks: each bucket's least node once, (place, node), or else the links (a, b) of the others to it.

    So a bucket that holds a third of all classes is shuffled as one row a chunk.
    """

    def chunk(nodes: np.ndarray, bands: np.ndarray) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            place = _mix(bands + np.arange(bands.shape[1], dtype=np.uint64)).reshape(-1).view(np.int64)
        node = np.repeat(nodes, bands.shape[1])
        order = np.lexsort((node, place))
        place, node = place[order], node[order]
        fresh = np.concatenate(([True], place[1:] != place[:-1]))
        if not links:
            return pa.RecordBatch.from_arrays([pa.array(place[fresh]), pa.array(node[fresh])], names=["place", "node"])
        least = node[np.maximum.accumulate(np.where(fresh, np.arange(len(node)), 0))]
        pairs = np.unique(np.stack((node[~fresh], least[~fresh]), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("bands").flatten().to_numpy().view(np.uint64)
            held.append((batch.column("node").to_numpy(), flat.reshape(batch.num_rows, -1)))
        if sum(len(n) for n, _ in held) >= 50_000:
            yield chunk(*map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield chunk(*map(np.concatenate, zip(*held, strict=True)))


def _sets(batches: Iterator[pa.RecordBatch], size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    known = WordHashes()

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for cluster, blocks, digest, text in zip(*columns(batch, "cluster", "blocks", "digest", "text"), strict=True):
                s = shingles(text, size, known)
                if _digest(s) == digest:  # an id can have rows with different texts
                    yield cluster, blocks, digest, s.tobytes()

    return batches_of(rows(), schema, most_bytes=8 << 20)


def _verify(key: tuple, table: pa.Table, share: int) -> pa.Table:
    """Links (a, b) that join the sets of one group of sets, no more than there are sets: 100 * common >= share * union."""
    held = dict(zip(table.column("digest").to_pylist(), table.column("members").to_pylist(), strict=True))
    digests = sorted(held)
    sets = [np.frombuffer(held[d], np.uint64) for d in digests]
    n = np.array([len(s) for s in sets], np.int64)
    value, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    posting = owner[np.argsort(code, kind="stable")]
    length = np.bincount(code, minlength=len(value))
    first = np.cumsum(length) - length
    cuts = np.cumsum(n) - n
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    for i in range(len(sets)):
        own = code[cuts[i] : cuts[i] + n[i]]
        common = np.bincount(posting[ragged(first[own], length[own])], minlength=len(sets))[:i]
        for j in np.flatnonzero(100 * common >= share * (n[i] + n[:i] - common)).tolist():
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(digests[i])
                b.append(digests[j])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, share: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of `size`-word shingle sets of `share` percent or more.

    One row per input row: `key`, n_shingles, component_id (smallest key that can be reached, itself included), kept (key =
    component_id). Rows with equal sets are one class before anything is compared, so any number of copies costs one row a
    task. Classes that share a band are gathered into clusters through one star a bucket, not in pairs, and a bucket is
    shuffled as its least members only. Within a cluster every
    two sets are compared in full, in tasks of BLOCK_SHINGLES shingles a side, so no link between members is missed whatever
    their number; only links that join something new are written. Text without words, and null, is linked with nothing: its
    component is its own key. Rows that repeat a key are rows of their own; a null key leads no component: its row has its
    class's component if another row has a key, else null, and is kept only in the latter case.
    """
    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sketched = stage(picked.mapInArrow(lambda batches: _sketch(batches, size, bands, rows), f"key {kind}, n bigint, digest binary, bands array<bigint>"), "sketches")
    classes = stage(sketched.where("digest IS NOT NULL").groupBy("digest").agg(F.min("key").alias("first"), F.min("n").alias("n"), F.first("bands").alias("bands")), "classes")
    # nodes of candidate clusters are hashes: two classes that share one are only compared for nothing
    nodes = classes.where("first IS NOT NULL").select(F.xxhash64("digest").alias("node"), "bands")
    shared = Window.partitionBy("place")
    met = nodes.mapInArrow(lambda batches: _places(batches, False), "place bigint, node bigint").select("node", F.min("node").over(shared).alias("least")).where("node <> least")
    candidates = nodes.mapInArrow(lambda batches: _places(batches, True), "a bigint, b bigint").union(met)
    clusters = components(candidates)
    clustered = classes.where("first IS NOT NULL").select("digest", "first", "n", F.xxhash64("digest").alias("node"))
    members = stage(clustered.join(clusters, "node").select("digest", "first", "n", F.col("component").alias("cluster")), "members")
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    asked = members.join(sizes, "cluster").select("digest", "cluster", "blocks", F.col("first").alias("key"))
    schema = pa.schema([("cluster", pa.int64()), ("blocks", pa.int32()), ("digest", pa.binary()), ("members", pa.binary())])
    asked = stage(asked, "asked")
    # only texts that may be asked for move; shuffled whatever the sizes: the copies' ids grow with the corpus
    sets = picked.where(may_hold(key_filter(asked, "key"), "key")).join(asked.hint("merge"), "key").select("cluster", "blocks", "digest", "text").mapInArrow(lambda batches: _sets(batches, size, schema), "cluster bigint, blocks int, digest binary, members binary")
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(block, x).alias("i"), F.greatest(block, x).alias("j")))
    dealt = sets.select("cluster", F.explode(pairs).alias("pair"), "digest", "members").select("cluster", "pair.i", "pair.j", "digest", "members")
    links = dealt.groupBy("cluster", "i", "j").applyInArrow(lambda group, table: _verify(group, table, share), "a binary, b binary")
    linked = components(links)
    lead = linked.join(classes.select(F.col("digest").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("lead"))
    led = linked.join(lead, "component").select(F.col("node").alias("digest"), "lead")
    of_class = stage(classes.select("digest", "first").join(led, "digest", "left").select("digest", F.coalesce("lead", "first").alias("lead")), "leads")
    # the copies of one class can be a third of all rows; Spark splits such a partition, both sides being plain tables
    out = sketched.select("key", "n", "digest").join(of_class, "digest", "left")
    component = F.coalesce("lead", "key")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, component.isNull()).alias("kept"))
