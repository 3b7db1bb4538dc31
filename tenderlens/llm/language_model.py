"""Hierarchical Pitman-Yor language model: restaurants of preceding words over a word restaurant over spelling restaurants, seated by Gibbs sampling.

A token is drawn from the restaurant of the word before it (of the end token, before a text's first word). The parent of all
these is one word restaurant: each table there is one of its customers. The word restaurant's parent is a spelling model:
restaurants for the two preceding bytes of a word, whose parents are those for one byte, whose parent has no context, whose
parent is uniform over the 256 bytes and the word's end. So every word has a probability after every other, seen or not, and
contexts with little data lean on the parent they share. A table of the word restaurant is one customer of the spelling model.

Words and pairs of words (they grow with the corpus) stay in Spark, in buckets of the later word; buckets are dealt to as many
parts as there are shuffle partitions. A pair seen once has one table and never moves again; of the others, each part tells the
tables it has for each earlier word to the part of that word, and hears how many that word's restaurant has. Words travel as
numbers: place in the bucket's list (frequent words first) times the number of buckets, plus the bucket. The spelling
restaurants are a table of at most 257 ** 3 (context, symbol) counts whatever the corpus, are summed in Spark and seated on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import make_blocks, n_buckets
from .common import LOWER, SLICE, batches_of, columns, expand, expand_words, partitions, squeeze, squeeze_words, stage, stage_by, unpack

END, START = 256, 256  # the word's end as a symbol; before its first byte as a context
CANDIDATES = 3


def words_with_end(text: str) -> list[bytes]:
    """Lower-case (A-Z) words between ASCII white space, then the end token, written as the empty word."""
    return [*text.encode().translate(LOWER).split(), b""]


def seat(c: np.ndarray, g: np.ndarray, others: np.ndarray, theta: float, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn anew given all other dishes: c customers, parent probability g, `others` tables of other dishes.

    Customers sit down one after another (the first 32 one by one, later ones in groups of a sixteenth of those seated, whose
    new tables are binomial). CANDIDATES such seatings are drawn and one is kept by its importance weight, the seating's
    probability in the whole restaurant over that of having drawn it.
    """
    order = np.argsort(-c, kind="stable")
    drawn = np.repeat(order, CANDIDATES)  # the seatings of a dish stand side by side
    c, g, others = c[drawn].astype(np.float64), np.maximum(g[drawn], 1e-300), others[drawn].astype(np.float64)
    t, log = np.ones(len(c)), np.zeros(len(c))
    base = theta + d * others
    strength = base * g
    i, n = 1.0, int(np.searchsorted(-c, -1.0))  # dishes with more than i customers come first
    while n:
        step = max(1.0, i // 16)
        m = np.minimum(step, c[:n] - i) if step > 1 else 1.0
        both = i + (m - 1) / 2 - d * t[:n] + strength[:n]
        new = rng.binomial(m.astype(np.int64), strength[:n] / both) if step > 1 else rng.random(n) * both < strength[:n]
        log[:n] += m * np.log(both)
        at = np.flatnonzero(new)
        more = new[at].astype(np.float64)
        log[at] += more * np.log1p(d * (t[at] + (more - 1) / 2) / base[at])
        t[at] += more
        i += step
        n = int(np.searchsorted(-c, -i))
    log += rng.gumbel(size=len(c))  # the largest of weight plus Gumbel noise is a draw by weight
    best = log.reshape(-1, CANDIDATES).argmax(axis=1)
    out = np.empty(len(order))
    out[order] = t.reshape(-1, CANDIDATES)[np.arange(len(order)), best]
    return out


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys ((two preceding bytes) * 257 + symbol) of all words' symbols, and how many each word has."""
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    flat = np.full(int(n.sum()), END, np.int64)
    ends = np.cumsum(n) - 1
    inside = np.ones(len(flat), bool)
    inside[ends] = False
    flat[inside] = np.frombuffer(b"".join(words), np.uint8)
    first = ends - n + 1
    one = np.concatenate(([START], flat[:-1])) if len(flat) else flat
    one[first] = START
    two = np.concatenate(([START], one[:-1])) if len(flat) else flat.copy()
    two[first] = START
    return (two * 257 + one) * 257 + flat, n


@dataclass
class Spelling:
    """Predictive probabilities of the spelling restaurants: by full key, and where a context lacks the symbol, by its parent."""

    keys: np.ndarray
    p: np.ndarray
    contexts: np.ndarray
    back: np.ndarray  # of each known context: weight of the parent
    one: np.ndarray  # 257 * 257: by one byte of context

    def log_p(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        key, n = spelled(words)
        return np.add.reduceat(np.log(self.p_of(key)), np.cumsum(n) - n)

    def p_of(self, key: np.ndarray) -> np.ndarray:
        p = self.one[key % (257 * 257)]
        if len(self.contexts):
            context = key // 257
            at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            p = np.where(self.contexts[at] == context, self.back[at], 1.0) * p
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            p = np.where(self.keys[at] == key, self.p[at], p)
        return p


UNIFORM = Spelling(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.full(257 * 257, 1 / 257))


def spell(keys: np.ndarray, customers: np.ndarray, theta: float, d: float, last: Spelling, rng: np.random.Generator) -> Spelling:
    """Seat the spelling restaurants from the longest context down, given the last state's parents, then predict from the top."""

    def level(k: np.ndarray, n: np.ndarray, g: np.ndarray, tables: np.ndarray | None = None):
        """Tables of each (context, symbol); per context: customers and tables."""
        contexts, at = np.unique(k // 257, return_inverse=True)
        total = np.bincount(at, n, len(contexts))
        shown = np.bincount(at, minlength=len(contexts))
        t = seat(n, g, (shown - 1)[at], theta, d, rng)
        t = seat(n, g, np.bincount(at, t, len(contexts))[at] - t, theta, d, rng)
        return contexts, at, total, t, np.bincount(at, t, len(contexts))

    two = level(keys, customers, last.one[keys % (257 * 257)])
    k1, at1 = np.unique(keys % (257 * 257), return_inverse=True)
    c1 = np.bincount(at1, two[3], len(k1))
    zero = np.bincount(k1 % 257, minlength=257) + 1.0
    one = level(k1, c1, (zero / zero.sum())[k1 % 257])
    c0 = np.bincount(k1 % 257, one[3], 257)
    shown = np.flatnonzero(c0)
    root = level(shown, c0[shown], np.full(len(shown), 1 / 257))

    def predict(kept, k, n, parent):
        contexts, at, total, t, tables = kept
        back = (theta + d * tables) / (theta + total)
        return (n - d * t) / (theta + total[at]) + back[at] * parent, contexts, back

    p0 = np.full(257, 1 / 257)
    if len(shown):
        got, _, back = predict(root, shown, c0[shown], 1 / 257)
        p0 = p0 * back[0]
        p0[shown] = got
    p1 = np.tile(p0, 257)
    if len(k1):
        got, contexts, back = predict(one, k1, c1, p0[k1 % 257])
        weight = np.ones(257)
        weight[contexts] = back
        p1 = (weight[:, None] * p0[None, :]).ravel()
        p1[k1] = got
    got, contexts, back = predict(two, keys, customers, p1[keys % (257 * 257)])
    return Spelling(keys, got, contexts, back, p1)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", train: str = "train", sweeps: int = 4, burn_in: int = 1, theta: float = 1.0, seed: int = 7) -> DataFrame:
    """log10 probability of every whole text under the model learnt from the rows where `train` is true.

    One row per input row: `key`, n_tokens (words and one end), n_known (tokens that occur in training), train_tokens,
    base_score (unigram with 0.5 added to each count), score (mean over sampled seatings of each token's probability after the
    token before it, logarithm summed over tokens), spelled_score, perplexity (10 ** (-score / n_tokens)). score knows the events
    that base_score knows, each training word and "any other word", whose probability is what the model leaves to all words not
    seen in training; spelled_score asks for the very spelling of those too. Null text is the empty text: one token, its end.
    Repeated rows count as often as they occur and are scored alike. With no training row at all, words are spelled uniformly. A
    level's discount is n1 / (n1 + 2 n2), n1 and n2 the numbers of its customers' kinds (pairs of words; words, counted by the
    different words before them) that come once and twice, kept within 0.1 to 0.9.
    """
    spark = docs.sparkSession
    buckets, n_parts = n_buckets(spark), partitions(spark)
    parts, dictionaries = make_blocks(docs, key, text, lambda: words_with_end, train)
    part = F.pmod("bucket", F.lit(n_parts)).alias("part")
    counted = stage(dictionaries.repartition("bucket").select("block", "bucket", "words", "codes", "flagged").mapInArrow(_count, "bucket int, words binary, counts binary, n bigint, v bigint, block binary, codes binary, places binary"), "vocabulary")
    ids = counted.where("block IS NOT NULL").select("block", "bucket", "codes", "places")
    total = counted.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "v"))).first()
    n, v = total.n, total.v
    pairs = parts.select("block", "codes", "flag").groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(lambda left, right: _pairs(left, right, buckets), "block binary, bucket int, words binary, lengths binary, before binary, flagged binary")
    vocabulary = counted.where("block IS NULL").select(part, "bucket", "words", "counts")
    met = pairs.select(part, "*").groupBy("part").cogroup(vocabulary.groupBy("part")).applyInArrow(lambda left, right: _merge(left, right, n_parts), _schema(MET))
    met = stage_by(met, "pairs", "part")
    once = met.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("pairs", "once", "twice", "word_once", "word_twice"))).first()
    d_pair, d_word = _discount(once.once, once.twice), _discount(once.word_once, once.word_twice)
    first = met.where("to IS NOT NULL").select("part", "to", "wanted", "wanted_n", "other", "other_n")
    told = stage(first.groupBy("to").applyInArrow(_first_exchange, _schema(TOLD)), "contexts")
    contexts = told.where("at IS NOT NULL OR numbers IS NOT NULL").select("part", "to", "at", "numbers", "totals")
    still = met.where("counts IS NOT NULL").select("part", "bucket", "words", "counts", "single", "places", "lengths", "at", "seen")
    seats, rng = None, np.random.default_rng(seed)
    customers, tables, model = once.pairs, v, UNIFORM
    kept_seats, kept_totals, unknown = [], [], []
    for sweep in range(sweeps + 1):
        # a pass adds the state of the sweep before to what is averaged and then seats pairs and words again
        keep, again = sweep > burn_in or sweep == sweeps, sweep < sweeps
        job = (customers, tables, theta, d_word, d_pair, spark.sparkContext.broadcast(model), keep, again, seed * 1000 + sweep)
        heard = told.where("at IS NULL AND to IS NOT NULL").select("part", "to", "totals", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("tables"), F.lit(None).cast("binary").alias("seats"))
        if seats is not None:
            heard = heard.unionByName(seats.where("tables IS NOT NULL").select("part", F.lit(None).cast("int").alias("to"), F.lit(None).cast("binary").alias("totals"), "bucket", "tables", "seats"))
        if keep:
            kept_totals.append(told.where("to IS NULL AND numbers IS NULL").select("part", F.lit(len(kept_seats)).alias("sweep"), "totals"))
        before = seats
        seats = stage(still.groupBy("part").cogroup(heard.groupBy("part")).applyInArrow(_swept(job), _schema(SWEPT)), "seating")
        if keep:
            unknown.append(max(1e-12, 1 - seats.agg(F.coalesce(F.sum("mass"), F.lit(0.0))).first()[0]))
            kept_seats.append((before, seats))
        if again:
            customers, tables = seats.agg(F.coalesce(F.sum("n_customers"), F.lit(0.0)), F.coalesce(F.sum("n_tables"), F.lit(0.0))).first()
            summed = seats.where("spelled IS NOT NULL").select("spelled", "customers").mapInArrow(_customers, "spelled bigint, customers double").groupBy("spelled").agg(F.sum("customers").alias("customers"))
            held = summed.toArrow()  # at most 257 ** 3 rows
            keys, counts = held.column("spelled").to_numpy(), held.column("customers").to_numpy()
            order = np.argsort(keys)
            model = spell(keys[order], counts[order], theta, 0.5, model, rng)
            sent = seats.where("to IS NOT NULL").select("to", F.col("part").alias("sender"), "more")
            own = contexts.select(F.col("part").alias("to"), F.col("to").alias("sender"), "at", "numbers", "totals")
            told = stage(sent.groupBy("to").cogroup(own.groupBy("to")).applyInArrow(_exchange, _schema(TOLD)), "contexts")
    asked = ids.select(part, "bucket", "block", "codes", "places")
    for i, (before, swept) in enumerate(kept_seats):
        if before is not None:
            asked = asked.unionByName(before.where("tables IS NOT NULL").select("part", "bucket", F.lit(i).alias("sweep"), "seats"), allowMissingColumns=True)
        asked = asked.unionByName(swept.where("probabilities IS NOT NULL").select("part", "bucket", F.lit(i).alias("sweep"), "probabilities"), allowMissingColumns=True)
        asked = asked.unionByName(kept_totals[i], allowMissingColumns=True)
    asked = asked.unionByName(contexts.where("numbers IS NOT NULL").select("part", "numbers"), allowMissingColumns=True)
    known = met.where("counts IS NOT NULL OR block IS NOT NULL").select("part", "bucket", "block", "counts", "seen", "kinds", "at")
    kept = len(kept_seats)
    answers = known.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(lambda left, right: _answer(left, right, kept, buckets), "block binary, bucket int, codes binary, places binary, counts binary, probabilities binary, totals binary, kinds binary, seen binary, tables binary")
    kind, last = parts.schema["key"].dataType.simpleString(), (n, v, theta, d_pair, unknown, buckets)
    out = parts.select("block", "key", "codes").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda left, right: _add_up(left, right, last), f"key {kind}, n_tokens bigint, n_known bigint, base_score double, score double, spelled_score double")
    return out.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score", "spelled_score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


KINDS = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
#: Pairs by part: a bucket's words and its pairs seen more than once (counts given), what a block's pairs are (block given), and what is told to the part of the earlier words (to given).
MET = {"part": "int", "bucket": "int", "to": "int", "block": "binary"} | {x: "binary" for x in ("words", "counts", "single", "places", "lengths", "at", "seen", "kinds", "wanted", "wanted_n", "other", "other_n")} | {x: "bigint" for x in ("pairs", "once", "twice", "word_once", "word_twice")}
#: Tables of the earlier words' restaurants: a part's own (to not given), which of them another part asks for (at), the answer to it (else).
TOLD = {"part": "int", "to": "int", "at": "binary", "numbers": "binary", "totals": "binary"}
SWEPT = {"part": "int", "bucket": "int", "to": "int"} | {x: "binary" for x in ("tables", "seats", "probabilities", "spelled", "customers", "more")} | {x: "double" for x in ("n_customers", "n_tables", "mass")}


def _schema(names: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in names.items())


def _table(rows: list[dict], names: dict[str, str]) -> pa.Table:
    return pa.table({name: pa.array([r.get(name) for r in rows], KINDS[kind]) for name, kind in names.items()})


def _discount(once: int, twice: int) -> float:
    return min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5


def _joined(arrays: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _steps(sorted_: np.ndarray) -> bytes:
    return squeeze(np.diff(sorted_, prepend=0))


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in their order, with their sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values[:0]


def _pack_pairs(place: np.ndarray, number: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Pairs in the order of (place, number): steps from place to place, how many pairs each has, steps between their numbers."""
    first = np.flatnonzero(np.diff(place, prepend=-1))
    step = np.diff(number, prepend=0)
    step[first] = number[first]
    return _steps(place[first]), squeeze(np.diff(first, append=len(place))), squeeze(step)


def _unpack_pairs(places: bytes, lengths: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, step = expand(lengths), expand(steps)
    total, first = np.cumsum(step), np.cumsum(n) - n
    return np.repeat(np.cumsum(expand(places)), n), total - np.repeat(total[first] - step[first], n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each bucket with their training counts, and their places in that list for each block; all rows of a bucket are in one partition."""
    schema = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("block", pa.binary()), ("codes", pa.binary()), ("places", pa.binary())])
    held: dict[int, tuple[dict[bytes, int], list]] = {}
    for batch in batches:
        for block, bucket, words, codes, flagged in zip(*columns(batch, "block", "bucket", "words", "codes", "flagged"), strict=True):
            of, rows_ = held.setdefault(bucket, ({}, []))
            at = np.fromiter((of.setdefault(w, len(of)) for w in expand_words(words)), np.int32)
            rows_.append((block, codes, at, expand(flagged)))

    def rows() -> Iterator[tuple]:
        for bucket, (of, rows_) in held.items():
            c = np.zeros(len(of), np.int64)
            for _, _, at, flagged in rows_:
                c[at] += flagged  # a row has a word once
            words = sorted(of)
            at = np.fromiter((of[w] for w in words), np.int64, len(words))
            order = np.argsort(-c[at], kind="stable")
            at = at[order]
            place = np.empty(len(at), np.int64)
            place[at] = np.arange(len(at))
            yield bucket, squeeze_words([words[i] for i in order.tolist()]), squeeze(c[at]), int(c.sum()), int((c > 0).sum()), None, None, None
            for block, codes, own, _ in rows_:
                yield bucket, None, None, None, None, block, codes, squeeze(place[own])

    return batches_of(rows(), schema)


@dataclass
class _Words:
    """A block's words, in the order of (bucket, place) as later words and of their number as earlier ones."""

    bucket: np.ndarray  # of the later words, in their order
    place: np.ndarray
    number: np.ndarray  # of the earlier words, in their order
    later: np.ndarray  # by code
    earlier: np.ndarray

    @classmethod
    def of(cls, right: pa.Table, buckets: int) -> _Words:
        codes = [np.cumsum(expand(c)) for c in right.column("codes").to_pylist()]
        code = _joined(codes)
        bucket, place = np.empty(len(code), np.int64), np.empty(len(code), np.int64)
        bucket[code] = np.repeat(np.array(right.column("bucket").to_pylist(), np.int64), [len(c) for c in codes])
        place[code] = _joined([expand(p) for p in right.column("places").to_pylist()])
        number = place * buckets + bucket
        by_place, by_number = np.lexsort((place, bucket)), np.argsort(number)
        later, earlier = np.empty_like(code), np.empty_like(code)
        later[by_place] = earlier[by_number] = np.arange(len(code))
        return cls(bucket[by_place], place[by_place], number[by_number], later, earlier)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """Each token of whole texts with the one before it; a text's last token is the end, which also stands before its first."""
        return self.later[codes] * len(self.later) + self.earlier[np.concatenate((codes[-1:], codes[:-1]))]


def _texts(column: pa.ChunkedArray | list) -> Iterator[np.ndarray]:
    """The numbers of whole texts, one after another, some SLICE of them at a time."""
    held, size = [], 0
    for data in column:
        held.append(data if isinstance(data, bytes) else data.as_py())
        size += len(held[-1])
        if size >= SLICE:
            yield unpack(b"".join(held))
            held, size = [], 0
    if held:
        yield unpack(b"".join(held))


def _distinct_pairs(words: _Words, codes: pa.ChunkedArray, flags: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Pair keys of a block in their order, and how often each occurs in flagged texts."""
    found = []
    if flags is None:
        for flat in _texts(codes):
            found.append(words.keys(flat))
        keys = _joined(found)
        found.clear()
        keys.sort()
        return keys[np.diff(keys, prepend=-1) > 0], None
    listed = codes.to_pylist()
    for flag in (True, False):
        for flat in _texts([c for c, f in zip(listed, flags, strict=True) if f == flag]):
            found.append(words.keys(flat) * 2 + flag)
    keys = _joined(found)
    found.clear()
    keys.sort()
    first = np.flatnonzero(np.diff(keys >> 1, prepend=-1))
    return keys[first] >> 1, np.add.reduceat(keys & 1, first) if len(first) else keys


def _pairs(left: pa.Table, right: pa.Table, buckets: int) -> pa.Table:
    """A block's distinct pairs of words with their training counts, by bucket of the later word."""
    words = _Words.of(right, buckets)
    keys, flagged = _distinct_pairs(words, left.column("codes"), left.column("flag").to_pylist())
    later, before = np.divmod(keys, max(1, len(words.later)))
    bucket = words.bucket[later]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
    block, rows = left.column("block")[0].as_py() if left.num_rows else None, []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows.append((block, int(bucket[a]), *_pack_pairs(words.place[later[a:b]], words.number[before[a:b]]), squeeze(flagged[a:b])))
    kinds = (pa.binary(), pa.int32(), *[pa.binary()] * 4)
    return pa.table([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=["block", "bucket", "words", "lengths", "before", "flagged"])


def _merge(left: pa.Table, right: pa.Table, n_parts: int) -> pa.Table:
    """A part's pairs of all blocks: counts summed, those seen more than once kept by word, and what each block's pairs are."""
    part, out = right.column("part")[0].as_py() if right.num_rows else None, []
    rows: dict[int, list[tuple]] = {}
    for block, bucket, *packed, flagged in zip(*(left.column(x).to_pylist() for x in ("block", "bucket", "words", "lengths", "before", "flagged")), strict=True):
        rows.setdefault(bucket, []).append((block, packed, flagged))
    kept = []
    for bucket, words, counts in zip(*(right.column(x).to_pylist() for x in ("bucket", "words", "counts")), strict=True):
        of, n_words = [(block, *_unpack_pairs(*packed), expand(flagged)) for block, packed, flagged in rows.pop(bucket, [])], len(expand(counts))
        span = max((int(number.max()) + 1 for _, _, number, _ in of if len(number)), default=1)
        keys, seen = _sums(_joined([place * span + number for _, place, number, _ in of]), _joined([flagged for *_, flagged in of]))
        keys, seen = keys[seen > 0], seen[seen > 0]
        many, (place, number) = seen > 1, np.divmod(keys, span)
        nth = np.cumsum(many) - 1
        for block, own_place, own_number, _ in of:
            at = np.minimum(np.searchsorted(keys, own := own_place * span + own_number), max(0, len(keys) - 1))
            found = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            kinds = np.where(found, 1 + many[at], 0) if len(keys) else np.zeros(len(own), np.int64)
            out.append({"part": part, "bucket": bucket, "block": block, "kinds": squeeze(kinds), "at": _steps(nth[at[kinds == 2]])})
        in_all = np.bincount(place, minlength=n_words)
        kept.append((bucket, words, counts, np.bincount(place[~many], minlength=n_words), place[many], number[many], seen[many], number[~many], in_all, int((seen == 2).sum())))
    # what is told to the parts of the earlier words: numbers by (part, number), those of pairs seen more than once first
    wanted, wanted_n = _sums(_joined([x[5] for x in kept]), _joined([np.ones_like(x[5]) for x in kept]))
    other, other_n = _sums(_joined([x[7] for x in kept]), _joined([np.ones_like(x[7]) for x in kept]))
    asked = np.lexsort((wanted, wanted % n_parts))
    wanted, wanted_n = wanted[asked], wanted_n[asked]
    by_number = np.argsort(wanted)
    for bucket, words, counts, single, place, number, seen, _, in_all, twice in kept:
        places, lengths, _ = _pack_pairs(place, number)
        at = by_number[np.searchsorted(wanted[by_number], number)] if len(number) else number
        once = {"pairs": int(single.sum()) + len(seen), "once": int(single.sum()), "twice": twice, "word_once": int((in_all == 1).sum()), "word_twice": int((in_all == 2).sum())}
        out.append({"part": part, "bucket": bucket, "words": words, "counts": counts, "single": squeeze(single), "places": places, "lengths": lengths, "at": squeeze(at), "seen": squeeze(seen)} | once)
    for to in np.unique(np.concatenate((wanted, other)) % n_parts).tolist():
        w, o = wanted % n_parts == to, other % n_parts == to
        out.append({"part": part, "to": to, "wanted": _steps(wanted[w]), "wanted_n": squeeze(wanted_n[w]), "other": _steps(other[o]), "other_n": squeeze(other_n[o])})
    return _table(out, MET)


def _first_exchange(rows: pa.Table) -> pa.Table:
    """Of a part's words, how many different words follow each: as many tables its restaurant has at first. What each other part asks for is answered."""
    part = rows.column("to")[0].as_py()
    asked = [(sender, *(expand(x) for x in packed)) for sender, *packed in zip(*(rows.column(x).to_pylist() for x in ("part", "wanted", "wanted_n", "other", "other_n")), strict=True)]
    asked = [(sender, np.cumsum(w), wn, np.cumsum(o), on) for sender, w, wn, o, on in asked]
    numbers, totals = _sums(_joined([y for _, w, _, o, _ in asked for y in (w, o)]), _joined([y for _, _, wn, _, on in asked for y in (wn, on)]))
    out = [{"part": part, "numbers": _steps(numbers), "totals": squeeze(totals)}, {"part": part, "totals": squeeze(totals)}]
    for sender, wanted, *_ in asked:
        at = np.searchsorted(numbers, wanted)
        out += [{"part": part, "to": sender, "at": _steps(at)}, {"part": sender, "to": part, "totals": squeeze(totals[at])}]
    return _table(out, TOLD)


def _exchange(left: pa.Table, right: pa.Table) -> pa.Table:
    """The same after a sweep: the tables beyond one for each pair are added up."""
    if not right.num_rows:
        return _table([], TOLD)
    part, at, totals = right.column("to")[0].as_py(), {}, np.zeros(0, np.int64)
    for sender, steps, numbers, own in zip(*(right.column(x).to_pylist() for x in ("sender", "at", "numbers", "totals")), strict=True):
        if numbers is not None:
            totals = expand(own)
        else:
            at[sender] = np.cumsum(expand(steps))
    for sender, more in zip(*(left.column(x).to_pylist() for x in ("sender", "more")), strict=True):
        totals[at[sender]] += expand(more)
    out = [{"part": part, "totals": squeeze(totals)}]
    return _table(out + [{"part": sender, "to": part, "totals": squeeze(totals[own])} for sender, own in at.items()], TOLD)


def _swept(job: tuple) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda left, right: _sweep(left, right, job)  # a third argument would be the key


def _sweep(left: pa.Table, right: pa.Table, job: tuple) -> pa.Table:
    all_customers, all_tables, theta, d_word, d_pair, shared, keep, again, seed = job
    if not left.num_rows:
        return _table([], SWEPT)
    part, out = left.column("part")[0].as_py(), []
    heard, state = {}, {}
    for to, totals, bucket, tables, seats in zip(*(right.column(x).to_pylist() for x in ("to", "totals", "bucket", "tables", "seats")), strict=True):
        if tables is None:
            heard[to] = expand(totals)
        else:
            state[bucket] = expand(tables).astype(np.float64), expand(seats).astype(np.float64)
    totals = _joined([heard[to] for to in sorted(heard)])
    more, held = np.zeros(len(totals), np.int64), []
    for bucket, packed, counts, single, places, lengths, at, seen in zip(*(left.column(x).to_pylist() for x in ("bucket", "words", "counts", "single", "places", "lengths", "at", "seen")), strict=True):
        words, c, single, at, seen = expand_words(packed), expand(counts), expand(single), expand(at), expand(seen)
        place = np.repeat(np.cumsum(expand(places)), expand(lengths))
        t, s = state[bucket] if bucket in state else (np.minimum(c, 1).astype(np.float64), np.ones(len(seen)))
        k = single + np.bincount(place, s, len(words))  # customers of the word restaurant
        log_g = shared.value.log_p(words)
        g, back = np.exp(log_g), (theta + d_word * all_tables) / (theta + all_customers)
        p = (k - d_word * t) / (theta + all_customers) + back * g
        row = {"part": part, "bucket": bucket}
        if keep:
            log_p = np.where(c > 0, np.log(np.where(c > 0, p, 1)), np.log(back) + log_g)  # of a long unseen word, too small for p
            row |= {"probabilities": log_p.astype(np.float32).tobytes(), "mass": float(p[c > 0].sum())}
        out.append(row)
        held.append((row, words, c, single, place, at, seen, t, s, g, p))
    if again and held:
        draw = np.random.default_rng([seed, part])
        held.sort(key=lambda x: x[0]["bucket"])
        split = lambda flat, sizes: np.split(flat, np.cumsum(sizes)[:-1])
        at = _joined([x[5] for x in held])
        seats = seat(_joined([x[6] for x in held]), _joined([x[10][x[4]] for x in held]), totals[at] - _joined([x[8] for x in held]), theta, d_pair, draw)
        more += np.bincount(at, seats - 1, len(more)).astype(np.int64)
        seats = split(seats, [len(x[8]) for x in held])
        k = [x[3] + np.bincount(x[4], s, len(x[1])) for x, s in zip(held, seats, strict=True)]
        own = [np.flatnonzero(x > 1) for x in k]
        drawn = seat(_joined([x[i] for x, i in zip(k, own, strict=True)]), _joined([x[9][i] for x, i in zip(held, own, strict=True)]), all_tables - _joined([x[7][i] for x, i in zip(held, own, strict=True)]), theta, d_word, draw)
        for (row, words, c, *_), s, k_, i, new in zip(held, seats, k, own, split(drawn, [len(i) for i in own]), strict=True):
            t = np.minimum(c, 1).astype(np.float64)
            t[i] = new
            keys, length = spelled(words)
            found, index = np.unique(keys, return_inverse=True)
            customers = np.bincount(index, np.repeat(t, length), len(found)).astype(np.int64)
            row |= {"tables": squeeze(t), "seats": squeeze(s), "n_customers": float(k_.sum()), "n_tables": float(t.sum()), "spelled": _steps(found[customers > 0]), "customers": squeeze(customers[customers > 0])}
    if again:
        cuts = np.cumsum([0, *(len(heard[to]) for to in sorted(heard))]).tolist()
        out += [{"part": part, "to": to, "more": squeeze(more[a:b])} for to, a, b in zip(sorted(heard), cuts[:-1], cuts[1:], strict=True)]
    return _table(out, SWEPT)


def _customers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spelling counts of a task's buckets, added up before they are shuffled."""
    total: dict[int, float] = {}
    for batch in batches:
        for keys, n in zip(*columns(batch, "spelled", "customers"), strict=True):
            for k, x in zip(np.cumsum(expand(keys)).tolist(), expand(n).tolist(), strict=True):
                total[k] = total.get(k, 0.0) + x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.float64())], names=["spelled", "customers"])


def _answer(left: pa.Table, right: pa.Table, kept: int, buckets: int) -> pa.Table:
    """For every block: of its words, training count, probabilities and followers' tables by kept sweep; of its pairs, training count and tables of all kept sweeps."""
    counts, seen, tables, log_p, totals, numbers = {}, {}, {}, {}, {}, np.zeros(0, np.int64)
    for bucket, block, c, n in zip(*(left.column(x).to_pylist() for x in ("bucket", "block", "counts", "seen")), strict=True):
        if block is None:
            counts[bucket], seen[bucket] = expand(c), expand(n)
            tables[bucket] = kept * np.ones(len(seen[bucket]), np.int64)
    asked = right.to_pylist()
    for r in asked:
        if r.get("seats") is not None:
            tables[r["bucket"]] += expand(r["seats"]) - 1
        elif r["probabilities"] is not None:
            log_p[r["bucket"], r["sweep"]] = np.frombuffer(r["probabilities"], np.float32)
        elif r["totals"] is not None:
            totals[r["sweep"]] = expand(r["totals"])
        elif r["numbers"] is not None:
            numbers = np.cumsum(expand(r["numbers"]))
    names = ("block", "bucket", "codes", "places", "counts", "probabilities", "totals", "kinds", "seen", "tables")
    out: list[tuple] = []
    for r in asked:
        if r["block"] is not None:
            bucket, place = r["bucket"], expand(r["places"])
            number = place * buckets + bucket
            at = np.minimum(np.searchsorted(numbers, number), max(0, len(numbers) - 1))
            followed = numbers[at] == number if len(numbers) else np.zeros(len(number), bool)
            own = [np.where(followed, totals[s][at], 0) if len(numbers) else np.zeros(len(number), np.int64) for s in range(kept)]
            out.append((r["block"], bucket, r["codes"], r["places"], squeeze(counts[bucket][place]), np.concatenate([log_p[bucket, s][place] for s in range(kept)]).tobytes(), squeeze(np.concatenate(own)), None, None, None))
    for bucket, block, kinds, at in zip(*(left.column(x).to_pylist() for x in ("bucket", "block", "kinds", "at")), strict=True):
        if block is not None:
            own = np.cumsum(expand(at))
            out.append((block, bucket, None, None, None, None, None, kinds, squeeze(seen[bucket][own]), squeeze(tables[bucket][own])))
    return pa.table([pa.array(list(x), pa.int32() if name == "bucket" else pa.binary()) for x, name in zip(zip(*out, strict=True) if out else [[]] * len(names), names, strict=True)], names=list(names))


def _add_up(left: pa.Table, right: pa.Table, job: tuple) -> pa.Table:
    n, v, theta, d_pair, unknown, buckets = job
    right, kept = right.sort_by("bucket"), len(unknown)
    of_words, of_pairs = right.filter(pc.is_valid(right.column("codes"))), right.filter(pc.is_valid(right.column("kinds")))
    words = _Words.of(of_words, buckets)
    code = _joined([np.cumsum(expand(c)) for c in of_words.column("codes").to_pylist()])
    c, log_p, tables = np.zeros(len(code), np.int64), np.zeros((kept, len(code))), np.zeros((kept, len(code)))
    c[code] = _joined([expand(x) for x in of_words.column("counts").to_pylist()])
    for into, rows in ((log_p, [np.frombuffer(x, np.float32) for x in of_words.column("probabilities").to_pylist()]), (tables, [expand(x) for x in of_words.column("totals").to_pylist()])):
        into[:, code] = np.concatenate([x.reshape(kept, -1) for x in rows] or [into], axis=1)
    base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    most = log_p.max(axis=0)  # of a long word, too small for a probability
    p = np.exp(log_p - most)
    back = (theta + d_pair * tables) / (theta + c) / kept  # weight of the word restaurant after a word
    later, earlier = np.argsort(words.later), np.argsort(words.earlier)  # codes by rank
    keys, _ = _distinct_pairs(words, left.column("codes"))
    kinds = _joined([expand(x) for x in of_pairs.column("kinds").to_pylist()])
    own = np.where(kinds == 1, 1 - d_pair, 0.0)  # customers of the pair's tables less the discounts
    own[kinds == 2] = _joined([expand(x) for x in of_pairs.column("seen").to_pylist()]) - d_pair * _joined([expand(x) for x in of_pairs.column("tables").to_pylist()]) / kept
    score, spelled_ = np.empty(len(keys)), np.empty(len(keys))
    for a in range(0, len(keys), SLICE):
        at = slice(a, a + SLICE)
        word, before = np.divmod(keys[at], len(code))
        word, before = later[word], earlier[before]
        mean = sum(back[s][before] * p[s][word] for s in range(kept))
        held = own[at] / (theta + c[before])
        spelled_[at] = np.where(held > 0, np.log10(held + np.exp(most[word]) * mean), most[word] / np.log(10) + np.log10(mean))
        score[at] = spelled_[at]
        new = np.flatnonzero(c[word] == 0)
        score[a + new] = np.log10(sum(back[s][before[new]] * unknown[s] for s in range(kept)))
    found: dict[str, list[np.ndarray]] = {x: [] for x in ("n_tokens", "n_known", "base_score", "score", "spelled_score")}
    for flat in _texts(left.column("codes")):
        pairs, index = np.unique(words.keys(flat), return_inverse=True)
        at = np.searchsorted(keys, pairs)[index]
        ends = np.flatnonzero(flat == flat[-1])
        first = np.concatenate(([0], ends[:-1] + 1))
        found["n_tokens"].append(ends - first + 1)
        for name, values in (("n_known", (c[flat] > 0).astype(np.int64)), ("base_score", base[flat]), ("score", score[at]), ("spelled_score", spelled_[at])):
            found[name].append(np.add.reduceat(values, first))
    return pa.table({"key": left.column("key")} | {name: pa.array(_joined(x, np.int64 if name.startswith("n_") else np.float64)) for name, x in found.items()})
