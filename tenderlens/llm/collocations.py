"""Collocations by prefix-free parsing: phrases are counted in distinct chunks, weighted by how often a chunk occurs."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, batches_of, columns, expand, pack, partitions, squeeze, stage, unpack

#: One in so many windows of words ends a chunk.
PERIOD = 16
#: Bytes of text cut at once, bytes of chunks a task holds before it hands them on, and words of a block of chunks.
CUT_BYTES, HELD_BYTES, BLOCK_WORDS = 2 << 20, 48 << 20, 1_500_000
#: Phrases that meet in one bucket, on average.
BUCKET_PHRASES = 2_000_000
#: Bits of a phrase's hash. Equal hashes only let phrases through that the exact count drops.
HASH_BITS = 48
#: Between pieces and between documents or chunks; neither byte occurs in UTF-8.
_PIECE, _END = b"\xff", b"\xfe"
_SPLIT = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b in b"\x20\x09" else LOWER[b] for b in range(256))
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def cut_words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, with a mark between pieces."""
    return (text or "").encode().translate(_SPLIT).replace(b"\n", b" " + _PIECE + b" ").split()


class _Numbers(dict):
    """Numbers of words; 0 and 1 are the two marks. `hashes` and `lengths` are those of the words, by number."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []
        self._hashes, self._lengths = np.zeros(1024, np.uint64), np.zeros(1024, np.int64)
        for mark in (_END, _PIECE):
            self[mark]

    def __missing__(self, word: bytes) -> int:
        n = len(self.words)
        if n == len(self._hashes):
            self._hashes, self._lengths = np.resize(self._hashes, 2 * n), np.resize(self._lengths, 2 * n)
        self._hashes[n], self._lengths[n] = xxhash.xxh3_64_intdigest(word), len(word)
        self.words.append(word)
        self[word] = n
        return n

    def code(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    @property
    def hashes(self) -> np.ndarray:
        return self._hashes[: len(self.words)]

    @property
    def lengths(self) -> np.ndarray:
        return self._lengths[: len(self.words)]


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each position on."""
    n = max(0, len(h) - size + 1)
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = _mix(out * _STEP + h[k : n + k])
    return out


def cut_chunks(words: list[bytes], numbers: _Numbers, overlap: int, period: int = PERIOD) -> tuple[list[bytes], np.ndarray]:
    """Chunks of documents whose words follow one another, each document closed by the end mark; and which chunks end a document.

    A chunk begins with a document or with a window of `overlap` words whose hash is 0 modulo `period`, and goes on to the end of
    the next such window or of the document. So every run of overlap + 1 words lies within the chunk in which it begins, if that
    chunk is the last one whose beginning is not behind it; what begins in the last `overlap` words belongs to the next chunk.
    """
    codes = numbers.code(words)
    ends = np.flatnonzero(codes == 0)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    marks = np.zeros(len(codes) + 1, bool)
    whole = np.cumsum(np.concatenate(([0], codes == 0)))
    w = _windows(numbers.hashes[codes], overlap)
    inside = whole[overlap : overlap + len(w)] == whole[: len(w)]  # no end mark within the window
    marks[: len(w)] = (w % np.uint64(period) == 0) & inside
    marks[starts] = True
    marks[ends] = False
    marks[starts[starts == ends]] = False  # documents without words
    begin = np.flatnonzero(marks)
    of = np.searchsorted(ends, begin)
    after = np.append(begin[1:], len(codes))
    last = after > ends[of] if len(begin) else np.zeros(0, bool)
    stop = np.where(last, ends[of] if len(begin) else 0, after + overlap)
    at = np.concatenate(([0], np.cumsum(numbers.lengths[codes] + 1)))
    joined = b" ".join(words)
    return [joined[a : b - 1] for a, b in zip(at[begin].tolist(), at[stop].tolist(), strict=True)], last


def _parse(batches: Iterator[pa.RecordBatch], overlap: int, period: int) -> Iterator[tuple]:
    """(lang, last, chunk, times) of a task, repeated when the task holds too many chunks."""
    numbers, held, size = _Numbers(), Counter(), 0
    waiting: dict[str, list[bytes]] = {}
    bytes_of: Counter = Counter()

    def cut(lang: str) -> int:
        nonlocal numbers
        chunks, last = cut_chunks(waiting.pop(lang), numbers, overlap, period)
        bytes_of.pop(lang)
        held.update(zip([lang] * len(chunks), last.tolist(), chunks, strict=True))
        if len(numbers) > 1_000_000:
            numbers = _Numbers()
        return sum(map(len, chunks))

    def out() -> Iterator[tuple]:
        for (lang, last, chunk), n in held.items():
            yield lang, last, chunk, n
        held.clear()

    for batch in batches:
        for lang, text in zip(*columns(batch, "lang", "text"), strict=True):
            words = waiting.setdefault(lang, [])
            words += cut_words(text)
            words.append(_END)
            bytes_of[lang] += len(text or "") + 1
            if bytes_of[lang] >= CUT_BYTES or len(bytes_of) > 64 and bytes_of.total() >= 8 * CUT_BYTES:
                size += cut(lang)
                if size >= HELD_BYTES:
                    yield from out()
                    size = 0
    for lang in list(waiting):
        size += cut(lang)
        if size >= HELD_BYTES:
            yield from out()
            size = 0
    yield from out()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block, lang, words, data): distinct chunks of one language, packed."""
    held: dict[str, list] = {}

    def out(lang: str) -> tuple:
        size, chunks, last, times = held.pop(lang)
        head = pack(np.array(times) * 2 + np.array(last))[0]
        data = len(head).to_bytes(4, "little") + head + (b" " + _END + b" ").join(chunks)
        return uuid.uuid4().bytes, lang, size, zstandard.compress(data, 3)

    for batch in batches:
        for lang, last, chunk, times in zip(*columns(batch, "lang", "last", "chunk", "times"), strict=True):
            own = held.setdefault(lang, [0, [], [], []])
            own[0] += chunk.count(b" ") + 1
            own[1].append(chunk)
            own[2].append(last)
            own[3].append(times)
            if own[0] >= BLOCK_WORDS or len(held) > 64 and sum(x[0] for x in held.values()) >= BLOCK_WORDS:
                yield out(lang)
    for lang in list(held):
        yield out(lang)


class _Block:
    """Words of a block by number, and for each position the weight of the phrases that begin there; 0 where they belong to another chunk."""

    def __init__(self, lang: str, data: bytes, overlap: int):
        raw = zstandard.decompress(data)
        at = 4 + int.from_bytes(raw[:4], "little")
        head = unpack(raw[4:at])
        self.numbers = _Numbers()
        self.codes = self.numbers.code(raw[at:].split(b" ")) if len(head) else np.zeros(0, np.int64)
        ends = np.append(np.flatnonzero(self.codes == 0), len(self.codes))[: len(head)]
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(head)]
        times, last = head >> 1, head & 1
        self.weight = np.zeros(len(self.codes), np.int64)
        stops = np.where(last == 1, ends, np.maximum(starts, ends - overlap))
        steps = np.zeros(len(self.codes) + 1, np.int64)
        np.add.at(steps, starts, times)
        np.add.at(steps, stops, -times)
        self.weight[:] = np.cumsum(steps)[:-1]
        self.weight[self.codes < 2] = 0
        self.seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))

    def phrases(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which a phrase of `size` words begins that counts here, and the phrases' hashes."""
        marks = np.cumsum(np.concatenate(([0], self.codes < 2)))
        n = max(0, len(self.codes) - size + 1)
        at = np.flatnonzero((self.weight[:n] > 0) & (marks[size : size + n] == marks[:n]))
        with np.errstate(over="ignore"):
            h = _mix(_windows(self.numbers.hashes[self.codes], size)[at] ^ self.seed)
        return at, h >> np.uint64(64 - HASH_BITS)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so that sorted hashes stay together."""
    return ((h >> np.uint64(HASH_BITS - 31)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], most: int, buckets: int) -> Iterator[tuple]:
    """(bucket, block, hashes, counts) of each block's phrases of 2 to `most` words."""
    for batch in batches:
        for block, lang, data in zip(*columns(batch, "block", "lang", "data"), strict=True):
            b = _Block(lang, data, most - 1)
            found = [b.phrases(k) for k in range(2, most + 1)]
            h, weight = np.concatenate([x[1] for x in found]), b.weight[np.concatenate([x[0] for x in found])]
            order = np.argsort(h)  # equal hashes in any order, their weights are added up
            h, weight = h[order], weight[order]
            fresh = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            h, counts = h[fresh], np.add.reduceat(weight, fresh) if len(fresh) else weight
            bucket = _bucket(h, buckets)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for own, n in zip(np.split(h, cuts), np.split(counts, cuts), strict=True):
                if len(own):
                    yield int(_bucket(own[:1], buckets)[0]), block, squeeze(np.diff(own.astype(np.int64), prepend=0)), squeeze(n)


def _frequent(table: pa.Table, least: int) -> Iterator[tuple]:
    """(block, hashes): of one bucket, what each block holds of the phrases that occur often enough in all blocks."""
    own = [np.cumsum(expand(h)) for h in table.column("hashes").to_pylist()]
    counts = [expand(n) for n in table.column("counts").to_pylist()]
    value, code = np.unique(np.concatenate(own), return_inverse=True)
    total = np.zeros(len(value), np.int64)
    np.add.at(total, code, np.concatenate(counts))
    often = np.split((total >= least)[code], np.cumsum([len(h) for h in own])[:-1])
    for block, h, kept in zip(table.column("block").to_pylist(), own, often, strict=True):
        if kept.any():
            yield block, squeeze(np.diff(h[kept], prepend=0))


def _spell(blocks: pa.Table, kept: pa.Table, most: int, schema: pa.Schema) -> pa.Table:
    """(lang, size, phrase, times) of one block: all its words, and the phrases with kept hashes. Made by columns, as most rows are words."""
    hashes = np.sort(np.concatenate([np.zeros(0, np.int64), *[np.cumsum(expand(h)) for h in kept.column("hashes").to_pylist()]]))
    made: list[pa.Table] = []

    def add(lang: str, size: int, phrases: list[bytes], times: np.ndarray) -> None:
        text = pa.array(phrases, pa.binary()).cast(pa.string())
        made.append(pa.table([pa.repeat(pa.scalar(lang, pa.string()), len(text)), pa.repeat(pa.scalar(size, pa.int32()), len(text)), text, pa.array(times, pa.int64())], schema=schema))

    for lang, data in zip(blocks.column("lang").to_pylist(), blocks.column("data").to_pylist(), strict=True):
        b = _Block(lang, data, most - 1)
        words, many = b.numbers.words, len(b.numbers.words)
        times = np.zeros(many, np.int64)
        np.add.at(times, b.codes, b.weight)
        found = np.flatnonzero(times)
        add(lang, 1, [words[c] for c in found.tolist()], times[found])
        for size in range(2, most + 1):
            at, h = b.phrases(size)
            place = np.searchsorted(hashes, h.astype(np.int64))
            at = at[(place < len(hashes)) & (hashes[np.minimum(place, len(hashes) - 1)] == h.astype(np.int64))] if len(hashes) else at[:0]
            code, first = b.codes[at], np.arange(len(at))
            for k in range(1, size):
                _, first, code = np.unique(code * many + b.codes[at + k], return_index=True, return_inverse=True)
            times = np.zeros(len(first), np.int64)
            np.add.at(times, code, b.weight[at])
            spelled = [[words[c] for c in b.codes[at[first] + k].tolist()] for k in range(size)]
            add(lang, size, list(map(b" ".join, zip(*spelled, strict=True))), times)
    return pa.concat_tables(made) if made else schema.empty_table()


def count_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = 3, least: int = 10, period: int = PERIOD) -> DataFrame:
    """(lang, size, phrase, times): all words of each language, and its phrases of 2 to `most` words that occur `least` times or more.

    Every task parses its texts into chunks that end where the words say so; equal chunks of all tasks become one row with their
    number. Phrases are counted in these distinct chunks: hashes first, by buckets whose number follows the data, then the phrases
    with a frequent hash by their words, so that collisions change nothing.
    """
    overlap, spark = most - 1, docs.sparkSession
    picked = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    cut = pa.schema([("lang", pa.string()), ("last", pa.bool_()), ("chunk", pa.binary()), ("times", pa.int64())])
    chunks = picked.mapInArrow(lambda b: batches_of(_parse(b, overlap, period), cut, 20_000), "lang string, last boolean, chunk binary, times bigint")
    distinct = chunks.groupBy("lang", "last", "chunk").agg(F.sum("times").alias("times"))
    packed = pa.schema([("block", pa.binary()), ("lang", pa.string()), ("words", pa.int64()), ("data", pa.binary())])
    blocks = stage(distinct.mapInArrow(lambda b: batches_of(_blocks(b), packed), "block binary, lang string, words bigint, data binary"), "chunks")
    words = blocks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    buckets = max(partitions(spark), -(-words * (most - 1) // BUCKET_PHRASES))
    dealt = pa.schema([("bucket", pa.int64()), ("block", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())])
    counted = blocks.mapInArrow(lambda b: batches_of(_count(b, most, buckets), dealt), "bucket bigint, block binary, hashes binary, counts binary")
    often = pa.schema([("block", pa.binary()), ("hashes", pa.binary())])
    spelled = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("times", pa.int64())])

    def table(rows: Iterator[tuple], schema: pa.Schema) -> pa.Table:
        return pa.Table.from_batches(batches_of(rows, schema, 100_000), schema)

    kept = counted.groupBy("bucket").applyInArrow(lambda t: table(_frequent(t, least), often), "block binary, hashes binary")
    found = blocks.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(lambda a, b: _spell(a, b, most, spelled), "lang string, size int, phrase string, times bigint")
    summed = found.groupBy("lang", "size", "phrase").agg(F.sum("times").alias("times"))
    return summed.where((F.col("size") == 1) | (F.col("times") >= least))


def _joined(words, start: int, n: int):
    return F.array_join(F.slice(words, start, n), " ")


def rank_phrases(counts: DataFrame, most: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """The `top` phrases of each language of `counts` (count_phrases), see mine_collocations."""
    frequent = counts.where(F.col("times") >= least)
    phrases = frequent.where("size > 1").withColumn("words", F.split("phrase", " "))
    part = lambda name: frequent.select("lang", F.col("phrase").alias(name), F.col("times").alias(name[0]))
    cuts = phrases.select("lang", "phrase", F.col("times").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("left"), F.expr("array_join(slice(words, k + 1, size(words)), ' ')").alias("right"))
    both = cuts.join(part("left"), ["lang", "left"]).join(part("right"), ["lang", "right"])
    number = lambda c: F.col(c).cast("decimal(18,0)")
    ratio = both.withColumn("over", number("a") * number("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("under", number("l") * number("r"))
    scored = ratio.withColumn("score", F.expr("over DIV under").cast("bigint"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = [F.when(F.col("size") == size, _joined(F.col("words"), i + 1, n)) for size in range(3, most + 1) for n in range(2, size) for i in range(size - n + 1)]
    if spans:
        inside = phrases.where("size > 2").select("lang", F.explode(F.array(*spans)).alias("phrase"), F.col("times").alias("longer")).where("phrase IS NOT NULL")
        longest = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        lowest = lowest.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("size = 1").groupBy("lang").agg(F.sum("times").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def mine_collocations(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are cut at `.,;:!?` and line ends into pieces, those at spaces and tabs into words, A-Z in lower case. A phrase is 2 to
    `most` words of one piece with a occurrences, `least` or more, overlaps included; n is the number of all words of the language.
    A cut into two parts with l and r occurrences scores floor(1,000,000 a a / (l r)); the lowest-scoring cut counts, the first of
    equal ones. A phrase is dropped if a longer one that holds it has `share` percent of its occurrences. Order: score and a
    descending, phrase ascending by its bytes. All counts are exact up to 10 ** 16.

    A null text has no words, a null language is `und`, as is one of that name. Repeated rows and ids count once each; empty texts
    and an empty table give nothing; other columns, whatever their names, are ignored. Texts of any length are parsed whole.
    """
    counts = stage(count_phrases(docs, lang, text, most, least), "phrases")
    return rank_phrases(counts, most, least, share, top)


#: The same rows, from every phrase of every text.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), phrases AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM lists
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM lists
), f AS (
  SELECT lang, size, phrase, count(*) AS times FROM phrases GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(times) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, times AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND times >= 10
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.times AS l, y.times AS r, CAST(1000000::HUGEINT * c.a * c.a // (x.times::HUGEINT * y.times) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE size = 3) GROUP BY ALL
), kept AS (
  SELECT x.* FROM lowest x LEFT JOIN longer y ON y.lang = x.lang AND y.phrase = x.phrase WHERE y.a IS NULL OR 100 * y.a < 50 * x.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
