"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, columns

#: Hash buckets of n-grams of one to three characters, and most languages: the learnt table has at most their product of rows.
BUCKETS, LANGUAGES = 1 << 15, 256


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: its lower-case form (0 if it is no letter), and is it a letter."""
    letters = np.zeros(0x110000, bool)
    lower = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letters[i] = True
            small = c.lower()
            lower[i] = ord(small) if len(small) == 1 else i
    return lower, letters


def grams(text: str, lower: np.ndarray) -> np.ndarray:
    """Buckets of the text's n-grams of lower-case letters; other characters count as one blank, and so do both ends."""
    points = lower[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    points = np.concatenate((np.zeros(1, np.uint64), points, np.zeros(1, np.uint64)))
    keep = points > 0
    keep[1:] |= points[:-1] > 0
    keep[0] = True
    c = points[keep]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    one = c * np.uint64(0x9E3779B97F4A7C15)
    two = (c[:-1] * np.uint64(0x9E3779B1) + c[1:] + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
    three = ((c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:] + np.uint64(13)) * np.uint64(0x165667B19E3779F9)
    return (np.concatenate((one[c > 0], two, three)) >> np.uint64(49)).astype(np.int64)


def code_words(n: int) -> np.ndarray:
    """+1/-1, a row for each of n languages: every split into two sides for up to seven, else the best of 50 random codes by least distance."""
    if n <= 7:
        bits = [[1] + [1 if x >> i & 1 else -1 for i in range(n - 1)] for x in range(2 ** (n - 1) - 1)]
        return np.array(bits, float).reshape(-1, n).T
    rng = np.random.default_rng(17)
    wide = int(np.ceil(10 * np.log2(n)))
    codes = [rng.choice((-1.0, 1.0), (n, wide)) for _ in range(50)]
    codes = [c for c in codes if (np.abs(c.sum(0)) < n).all()]
    return max(codes, key=lambda c: ((c @ c.T) - 2 * wide * np.eye(n)).max() * -1)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # language x bit
    weights: np.ndarray  # bucket x bit: log odds of the bit's two sides
    scale: np.ndarray  # bit: usual size of a margin
    trust: np.ndarray  # language x bit: how well the bit tells this language, rows add up to one

    def decode(self, margins: np.ndarray, n: int) -> tuple[str, float, bool]:
        """Nearest code word by weighted logistic loss: language, share of belief, and is the runner-up within 0.2 of it."""
        z = margins / self.scale * (n / (n + 20))
        loss = (self.trust * np.logaddexp(0, -3 * self.codes * z)).sum(1)
        belief = np.exp(4 * (loss.min() - loss))
        belief /= belief.sum()
        best = int(np.argmax(belief))  # of equals, the first in order
        rest = np.delete(belief, best).max() if len(belief) > 1 else 0.0
        return self.languages[best], float(belief[best]), bool(belief[best] - rest < 0.2)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """n-gram counts of each language over all given rows with a language, and from them one binary classifier for each bit.

    Counts are added up in each task, then by Spark; the result has at most LANGUAGES * BUCKETS rows. None if nothing can be learnt.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, _ = letter_tables()
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, of in zip(*columns(batch, "text", "lang"), strict=True):
                got = grams(t, lower)
                if len(got):
                    held.setdefault(of, np.zeros(BUCKETS, np.int64))
                    held[of] += np.bincount(got, minlength=BUCKETS)
        for of, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([of] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    picked = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    summed = picked.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    held = summed.limit(LANGUAGES * BUCKETS + 1).toArrow()
    languages = sorted(set(held.column("lang").to_pylist()))
    if not languages:
        return None
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    table = np.zeros((len(languages), BUCKETS))
    row = {x: i for i, x in enumerate(languages)}
    table[[row[x] for x in held.column("lang").to_pylist()], held.column("bucket").to_numpy()] = held.column("n").to_numpy()
    share = (table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * BUCKETS)
    if len(languages) == 1:
        return Model(languages, np.ones((1, 1)), np.zeros((BUCKETS, 1)), np.ones(1), np.ones((1, 1)))
    codes = code_words(len(languages))
    yes, no = (codes.T > 0).astype(float), (codes.T < 0).astype(float)
    weights = np.log(yes @ share / yes.sum(1, keepdims=True)) - np.log(no @ share / no.sum(1, keepdims=True))
    expected = share @ weights.T  # language x bit: mean margin of the language's own n-grams
    scale = np.abs(expected).mean(0)
    trust = np.maximum(codes * expected / scale, 0.05)
    return Model(languages, codes, weights.T.copy(), scale, trust / trust.sum(1, keepdims=True))


def predict_languages(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, lang_pred, score (0 to 1), ambiguous: the language of every whole text, in one pass without a shuffle.

    One row per input row. A text that is null or has no letter is `und` with score 0 and not ambiguous; so is every text if
    there is no model. Equal beliefs go to the language first in alphabetical order, and are ambiguous.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        lower, letters = letter_tables()
        for batch in batches:
            schema = pa.schema([("key", batch.schema.field("key").type), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

            def rows(batch=batch) -> Iterator[tuple]:
                for k, t in zip(*columns(batch, "key", "text"), strict=True):
                    got = grams(t, lower) if t and known else ()
                    if not len(got):
                        yield k, "und", 0.0, False
                        continue
                    n = len(got)
                    margins = (np.bincount(got, minlength=BUCKETS) @ known.weights if n > 4000 else known.weights[got].sum(0)) / n
                    yield k, *known.decode(margins, n)

            yield from batches_of(rows(), schema)

    return picked.mapInArrow(predict, f"key {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("key", key)
