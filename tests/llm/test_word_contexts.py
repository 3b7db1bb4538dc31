"""op2: a word is scored after the word before it, and the first seating against a plain version."""

from __future__ import annotations

import random
from collections import Counter
from math import isclose, log10

import pytest

from tenderlens.llm import language_model


def plain(rows, theta=1.0):
    """spelled_score and score of every text when each pair and word has one table and words are spelled uniformly."""
    split = {i: [*(t or "").lower().split(), ""] for i, t, _ in rows}
    pairs = Counter(p for i, _, train in rows if train for p in zip(["", *split[i][:-1]], split[i], strict=True))
    first, follow, words = Counter(), Counter(), Counter()
    for (u, w), n in pairs.items():
        first[u] += n
        follow[u] += 1
        words[w] += 1

    def discount(counts):
        n1, n2 = (sum(c == k for c in counts.values()) for k in (1, 2))
        return min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5

    d2, d1, k, v = discount(pairs), discount(words), len(pairs), len(words)

    def one(w):
        return max(0, words[w] - d1 * (w in words)) / (theta + k) + (theta + d1 * v) / (theta + k) * 257.0 ** -(len(w.encode()) + 1)

    unknown = 1 - sum(one(w) for w in words)

    def after(u, w, p):
        return max(0, pairs[u, w] - d2 * ((u, w) in pairs)) / (theta + first[u]) + (theta + d2 * follow[u]) / (theta + first[u]) * p

    out = {}
    for i, t in split.items():
        steps = [*zip(["", *t[:-1]], t, strict=True)]
        out[i] = [sum(log10(after(u, w, p(w))) for u, w in steps) for p in (one, lambda w: one(w) if w in words else unknown)]
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    texts = [" ".join(draw.choices("the old mill by a river bank stands still and waits".split(), k=draw.randint(0, 30))) for _ in range(60)]
    texts += [None, "", "  ", "unheard words follow the river", "x" * 40, "old mill " * 30]
    return [(i, t, i % 4 != 1) for i, t in enumerate(texts)]


def test_first_seating_equals_a_plain_version(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id int, text string, train boolean")
    expected = plain(rows)
    got = language_model.score_documents(docs, sweeps=0, burn_in=0).collect()
    assert len(got) == len(rows)
    for r in got:
        assert isclose(r.spelled_score, expected[r.doc_id][0], abs_tol=1e-3), r
        assert isclose(r.score, expected[r.doc_id][1], abs_tol=1e-3), r


def test_order_of_words_counts(spark, rows):
    """The same words in two orders: the order seen in training is likelier."""
    seen = "the tender names the buyer and the buyer names a price"
    held = [(1000, seen, False), (1001, " ".join(reversed(seen.split())), False)]
    docs = spark.createDataFrame([*rows, *[(100 + i, seen, True) for i in range(20)], *held], "doc_id int, text string, train boolean").repartition(3)
    got = {r.doc_id: r for r in language_model.score_documents(docs, sweeps=2).collect()}
    assert got[1000].n_tokens == got[1001].n_tokens and isclose(got[1000].base_score, got[1001].base_score)
    assert got[1000].score > got[1001].score + 5
