"""Quality by lines: a linear-chain conditional random field marks content and boilerplate."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, columns

#: Most labelled documents, and lines of one of them, that the field is fitted on.
FIT_DOCS, FIT_LINES = 3000, 400
_BLANK = str.maketrans("", "", "\t\n\x0b\x0c\r ")
_PLAIN = str.maketrans("", "", "#*$%&|<>")
_WORD_CHARS = re.compile("[^\x20\x09-\x0d]")
FEATURES = 24


def line_features(lines: list[str]) -> np.ndarray:
    """0/1 features of the lines with a word, in order."""
    out = np.zeros((len(lines), FEATURES))
    seen: set[str] = set()
    for k, (line, row) in enumerate(zip(lines, out, strict=True)):
        words = line.split()
        n = max(1, len(words))
        chars = sum(map(len, words))
        symbols = len(line) - len(line.translate(_PLAIN))
        row[0] = 1
        row[1 + (n > 1) + (n > 3) + (n > 8) + (n > 20) + (n > 60)] = 1  # 1..6
        mean = chars / n
        row[7 + (mean > 3) + (mean > 4.5) + (mean > 6) + (mean > 9)] = 1  # 7..11
        row[12] = line.rstrip().endswith((".", "!", "?", ";", ":"))
        row[13] = line.isupper()
        row[14] = symbols > 0
        row[15] = symbols > 0.05 * chars
        row[16] = symbols > 0.3 * n
        row[17] = line.count("!") > 0.3 * n
        row[18] = any("0" <= c <= "9" for c in line)
        row[19] = line in seen
        row[20] = len(set(words)) < 0.5 * n
        row[21] = line.count("|") > 0.2 * n
        row[22] = k == 0
        row[23] = len(words) > 1 and not any(c in line for c in ".!?")
        seen.add(line)
    return out


class Field:
    """Two labels, 0 boilerplate and 1 content: feature weights for content against boilerplate, and transition scores."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros(FEATURES) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves

    def fit(self, sequences: list[np.ndarray], labels: list[int], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Field:
        """Maximise the mean log likelihood of whole label sequences by Adam; forward-backward runs over all sequences at once, line by line."""
        pairs = sorted(((x, y) for x, y in zip(sequences, labels, strict=True) if len(x)), key=lambda p: -len(p[0]))
        if not pairs:
            return self
        n = np.array([len(x) for x, _ in pairs])
        gold = np.array([y for _, y in pairs])
        steps = int(n[0])
        active = [int(np.searchsorted(-n, -t)) for t in range(steps)]  # sequences with more than t lines
        x = [np.stack([s[t] for s, _ in pairs[: active[t]]]) for t in range(steps)]
        total = float(n.sum())
        theta, first, second = np.concatenate((self.weights, self.moves.ravel())), 0.0, 0.0
        for it in range(1, rounds + 1):
            w, m = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
            unary = [np.stack((np.zeros(len(f)), f @ w), 1) for f in x]
            ahead = [unary[0]]
            for t in range(1, steps):
                a = active[t]
                ahead.append(np.logaddexp.reduce(ahead[-1][:a, :, None] + m[None], axis=1) + unary[t])
            behind = [np.zeros((active[t], 2)) for t in range(steps)]
            for t in range(steps - 2, -1, -1):
                a = active[t + 1]
                behind[t][:a] = np.logaddexp.reduce(m[None] + (unary[t + 1] + behind[t + 1])[:, None, :], axis=2)
            log_z = np.logaddexp.reduce(ahead[0] + behind[0], axis=1)
            grad_w, grad_m = np.zeros(FEATURES), np.zeros((2, 2))
            for t in range(steps):
                a = active[t]
                p = np.exp(ahead[t][:, 1] + behind[t][:, 1] - log_z[:a])
                grad_w += x[t].T @ (gold[:a] - p)
                if t:
                    both = np.exp(ahead[t - 1][:a, :, None] + m[None] + (unary[t] + behind[t])[:, None, :] - log_z[:a, None, None])
                    grad_m -= both.sum(0)
                    grad_m[0, 0] += (gold[:a] == 0).sum()
                    grad_m[1, 1] += (gold[:a] == 1).sum()
            grad = np.concatenate((grad_w, grad_m.ravel())) / total - decay * theta
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            theta = theta + rate * (first / (1 - 0.9**it)) / (np.sqrt(second / (1 - 0.999**it)) + 1e-8)
        return Field(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The likeliest labels; of two equally likely ones, content."""
        n = len(features)
        scores = (features @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        back = np.zeros((n, 2), np.int8)
        a, b = 0.0, scores[0] if n else 0.0
        for t in range(1, n):
            back[t, 0], back[t, 1] = b + m10 >= a + m00, b + m11 >= a + m01
            a, b = max(a + m00, b + m10), max(a + m01, b + m11) + scores[t]
        out = np.zeros(n, np.int8)
        if n:
            out[-1] = b >= a
            for t in range(n - 1, 0, -1):
                out[t - 1] = back[t, out[t]]
        return out


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if _WORD_CHARS.search(line):
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(set(windows)) < len(windows):
        first: dict[tuple, int] = {}
        covered = np.zeros(len(words), bool)
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                covered[j : j + 3] = True
                covered[i : i + 3] = True
        repeat = int(covered.sum())
    return len(words), len(text.translate(_BLANK)), len(text) - len(text.translate(_PLAIN)), dup, repeat


def lines_with_words(text: str) -> list[str]:
    return [x for x in text.split("\n") if _WORD_CHARS.search(x)]


def fit_field(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = FIT_DOCS, most_lines: int = FIT_LINES) -> Field:
    """Fit the field on at most `most` labelled documents (the first by a hash of the key), of each its first `most_lines` lines.

    Only fitting is bounded so. A document labelled 1 is taken as content throughout, one labelled 0 as boilerplate; of several
    labels of a key the lowest counts; null keys and labels are left out. Without labels the field keeps everything.
    """
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("_y")).orderBy(F.xxhash64(key), key).limit(most)
    picked = docs.select(key, text).join(F.broadcast(chosen), key).select(F.col(text).alias("text"), F.col("_y").alias("y"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [line_features(lines_with_words(t or "")[:most_lines]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([np.packbits(x.astype(bool), axis=1).tobytes() for x in got], pa.binary())], names=["y", "x"])

    held = picked.mapInArrow(features, "y int, x binary").limit(2 * most).toArrow()  # a repeated document is repeated here
    found = sorted(zip(held.column("x").to_pylist(), held.column("y").to_pylist(), strict=True))
    wide = FEATURES // 8
    sequences = [np.unpackbits(np.frombuffer(x, np.uint8).reshape(-1, wide), axis=1).astype(float) for x, _ in found]
    return Field().fit(sequences, [y for _, y in found])


def judge_documents(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text", share: float = 0.5, least_words: int = 50) -> DataFrame:
    """Counts and verdict of every whole text, in one pass without a shuffle.

    One row per input row: `key`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (n_words below
    `least_words`, or 100 * n_repeat_words > 50 * n_words), content_share (words on lines that Viterbi decoding marks as content,
    over all words; 0 without words), kept (not base_failed and content_share >= `share`). Null text has no words, so it fails.
    """
    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("key", batch.schema.field("key").type), *((x, pa.int64()) for x in names), ("base_failed", pa.bool_()), ("content_share", pa.float64()), ("kept", pa.bool_())])

            def rows(batch=batch) -> Iterator[tuple]:
                for k, t in zip(*columns(batch, "key", "text"), strict=True):
                    got = counts(t or "")
                    failed = got[0] < least_words or 100 * got[4] > 50 * got[0]
                    lines = lines_with_words(t or "")
                    marks = field.viterbi(line_features(lines)).tolist()
                    n = [len(x.encode().split()) for x in lines]
                    content = sum(x for x, y in zip(n, marks, strict=True) if y) / max(1, got[0])
                    yield k, *got, failed, content, not failed and content >= share

            yield from batches_of(rows(), schema)

    return picked.mapInArrow(judge, f"key {kind}, {', '.join(f'{x} bigint' for x in names)}, base_failed boolean, content_share double, kept boolean").withColumnRenamed("key", key)
