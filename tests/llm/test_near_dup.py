"""Near duplicates against all pairs, and the parts they are made of."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tenderlens.llm import near_dup
from tenderlens.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain(rows, size, share=80):
    """component of each row by comparing all pairs of sets."""
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= share * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        lead = min(keys) if keys else None
        out.append((key, len(sets[i]), lead, lead is None or key == lead))
    return out


def got(frame):
    return sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in frame.collect())))


@pytest.mark.parametrize("small", [False, True])
def test_equals_all_pairs(spark, odd, documents, monkeypatch, small):
    if small:  # clusters in several blocks
        monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 150)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    made = []
    for k in range(40):  # a group of copies with up to a fifth of the words changed, so that links meet the threshold from both sides
        w = words[:]
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(500)}"
        made.append((1000 + k, " ".join(w)))
    docs = odd.select("doc_id", "text").union(documents.select("doc_id", "text")).union(spark.createDataFrame(made, "doc_id bigint, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(near_dup.near_duplicates(docs, size=4)) == sorted(map(repr, plain(rows, 4)))


def test_nothing_and_only_empty_rows(odd, none):
    assert near_dup.near_duplicates(none).count() == 0
    blank = odd.where("doc_id in (2, 3, 4)")
    assert {(r.doc_id, r.component_id, r.n_shingles, r.kept) for r in near_dup.near_duplicates(blank).collect()} == {(i, i, 0, True) for i in (2, 3, 4)}


def test_sketches_fill_and_agree_like_the_sets():
    rng = np.random.default_rng(8)
    for n in (1, 2, 30, 5000):
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = max(1, int(len(base) * 0.9))
        s = near_dup.sketches([base, base[:keep]], 2048)
        assert (s != near_dup._EMPTY).all()
        assert abs((s[0] == s[1]).mean() - keep / len(base)) < 0.05


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (201, 201), (300, 300), (None, 7)]
    found = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
