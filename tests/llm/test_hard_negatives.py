"""Hard negatives against every anchor compared with every row, and odd rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlens.llm import hard_negatives
from tenderlens.llm.hard_negatives import SharedList, fit_centres, mine_hard_negatives

SHAPE = "vec_id bigint, embedding array<float>, label int, uid string, block int, list int, cluster string, score double"


def plain(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    kept = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((key, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = []
    for i, (a, va, la) in enumerate(kept):
        if not is_anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), k, lab) for j, (k, v, lab) in enumerate(kept) if j != i]
        for ps, p, _ in sorted(s for s in scored if s[2] == la)[:positives]:
            fit = sorted((s, k) for s, k, lab in scored if lab != la and low * -ps <= 100 * -s <= high * -ps)[:negatives]
            out += [(a, p, n, k, -ps, -s) for n, (s, k) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "u", 1, 2, "c", 0.5) for r in rows], SHAPE)
    return sorted(map(tuple, mine_hard_negatives(df, F.col("vec_id") % 10 == 0, **options).collect()))


def around(seed, n, dims=8, centres=4, spread=0.3):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, [m + rng.gauss(0, spread) for m in rng.choice(middle)], rng.randrange(3)) for i in range(n)]


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 30)
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 10)
    monkeypatch.setattr(hard_negatives, "LIST_ANCHORS", 3)
    rows = around(1, 200)
    expected = plain(rows, lambda k: k % 10 == 0)
    assert len(expected) > 100
    assert mined(spark, rows) == expected
    assert mined(spark, rows, positives=2, negatives=3, low=10, high=60, clusters=2) == plain(rows, lambda k: k % 10 == 0, 2, 3, 10, 60)


def test_odd_rows(spark):
    rows = around(2, 60)
    rows += [(100, None, 1), (101, [1.0] * 8, None), (None, [1.0] * 8, 1), (102, [float("nan")] * 8, 1), (103, [float("inf")] + [0.0] * 7, 1), (104, [None] + [0.0] * 7, 1)]
    rows += [(110, [], 1), (111, [0.5, 0.25], 1), (120, [0.0] * 8, 2)]  # empty, short and zero vectors
    rows += [(130 + k, [1.0] * 8, k % 2) for k in range(20)]  # ties
    rows += [(10, rows[10][1], rows[10][2])] * 2  # repeated rows
    assert mined(spark, rows) == plain(rows, lambda k: k % 10 == 0)


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.uniform(0.5, 1) * 1e5)) for _ in range(3)], i % 2) for i in range(40)]
    rows[7] = (7, [3e6, 1e6, 2e6], 1)
    assert mined(spark, rows) == plain(rows, lambda k: k % 10 == 0)


def test_empty_table(spark):
    assert mined(spark, []) == []


def test_a_list_ends_early_only_when_no_later_row_can_count():
    rng = np.random.default_rng(5)
    rows = np.floor(rng.normal(0, 200, (4000, 4)))
    members = np.floor(rows[:20] * 0 + [300, 10, 5, 1] + rng.normal(0, 4, (20, 4)))
    centre = fit_centres(members, 1)[0]
    shared = SharedList(members, centre, rows)
    products = members @ rows.T
    for seen in (1, 100, 1000, 3999):
        rest = products[:, shared.order[seen:]].max(1)
        assert all(shared.at_most(i, seen) >= rest[i] for i in range(20))
    assert sum(shared.at_most(i, 2000) < np.sort(products[i])[-10] for i in range(20)) == 20  # half of the list is enough here


@pytest.mark.parametrize("clusters", [1, 3, 50])
def test_centres(clusters):
    sample = np.random.default_rng(1).normal(0, 1, (40, 6))
    centres = fit_centres(sample, clusters)
    assert centres.shape == (min(clusters, 40), 6)
    assert np.allclose((centres**2).sum(1), 1)
