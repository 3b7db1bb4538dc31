"""Collocations against a count of every phrase of every text, chunks against their definition, odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tenderlens.llm import collocations
from tenderlens.llm.collocations import _Numbers, cut_chunks, cut_words, mine_collocations, rank_phrases
from tenderlens.llm.common import squeeze

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, most):
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, most + 1):
                for i in range(len(words) - size + 1):
                    f[lang or ("und" if lang is None else lang), tuple(words[i : i + size])] += 1
    return f


def plain(rows, most=3, least=10, share=50, top=2000):
    f = plain_counts(rows, most)
    n = Counter()
    for (lang, p), a in f.items():
        n[lang] += a * (len(p) == 1)
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for lang in sorted({x[0] for x in candidates}):
        found = []
        for (own, p), a in candidates.items():
            if own != lang:
                continue
            longer = (q for (l2, q) in candidates if l2 == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(100 * candidates[lang, q] >= share * a for q in longer):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(lang, text, 1, "w", 2, "x") for lang, text in rows], "lang string, text string, size int, words string, times int, chunk string")
    return sorted(map(tuple, mine_collocations(df, **options).collect()))


def invented(seed, docs, vocabulary=30, words=120):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    return [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(names) + rng.choice(["", "", "", ",", ".", "\n", "!?"]) for _ in range(rng.randrange(words)))) for _ in range(docs)]


def test_equals_all_phrases(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 300)
    monkeypatch.setattr(collocations, "BUCKET_PHRASES", 200)
    monkeypatch.setattr(collocations, "HELD_BYTES", 2000)
    rows = invented(1, 150, 12)
    rows += rows[:20] * 5  # copies
    expected = plain(rows)
    assert len(expected) > 200
    assert mined(spark, rows) == expected
    assert mined(spark, rows, most=4, least=3, share=70, top=50) == plain(rows, 4, 3, 70, 50)


def test_colliding_hashes_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HASH_BITS", 33)
    rows = invented(2, 60)
    assert mined(spark, rows, least=4) == plain(rows, least=4)


def test_odd_rows(spark, odd):
    rows = [(r["lang"], r["text"]) for r in odd.collect()] + [(None, "nul\x00 word ﻿ x\x1fy Ünï İ " * 12), ("en", "A.B,,C  D\t\tE " * 15), ("en", None), ("en", "...")]
    assert mined(spark, rows) == plain(rows)


def test_empty(spark, none):
    assert mine_collocations(none).collect() == []
    assert mined(spark, [("en", None), ("de", "")]) == []


def test_chunks_hold_every_phrase_once():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "c", "d.", "e\n"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    for overlap in (1, 2, 3):
        words = [w for t in texts for w in [*cut_words(t), b"\xfe"]]
        chunks, last = cut_chunks(words, _Numbers(), overlap, period=4)
        found = Counter()
        for chunk, is_last in zip(chunks, last.tolist(), strict=True):
            own = chunk.split(b" ")
            for i in range(len(own) if is_last else len(own) - overlap):
                if b"\xff" not in own[i : i + overlap + 1]:
                    found[tuple(own[i : i + overlap + 1])] += 1
        assert sum(last) == sum(bool(cut_words(t)) for t in texts)
        every = plain_counts([("x", t) for t in texts], overlap + 1)
        for (_, p), n in every.items():
            if len(p) == overlap + 1:
                assert found[tuple(w.encode() for w in p)] == n


def test_copies_share_their_chunks():
    rng = random.Random(4)
    text = " ".join(rng.choice(["a", "b", "c", "d", "e"]) for _ in range(400))
    other = "some words before " + text + " and after"
    one, _ = cut_chunks([*cut_words(text), b"\xfe"], _Numbers(), 2)
    two, _ = cut_chunks([*cut_words(other), b"\xfe"], _Numbers(), 2)
    assert len(set(one) - set(two)) <= 2 < len(one)


def test_scores_beyond_64_bits_are_exact(spark):
    a, left, right = 2_999_999_999_999, 3_000_000_000_017, 5_000_000_000_123
    rows = [("en", 1, "x", left), ("en", 1, "y", right), ("en", 2, "x y", a)]
    got = rank_phrases(spark.createDataFrame(rows, "lang string, size int, phrase string, times bigint")).collect()
    assert [tuple(r) for r in got] == [("en", 1, "x y", a, left, right, left + right, 1_000_000 * a * a // (left * right))]


def test_words_of_a_block_leave_as_columns():
    cut = [("x", False, b"a b a b c", 2), ("x", True, b"b c \xff a", 3)]
    data = [row[3] for row in collocations._blocks(iter([pa.RecordBatch.from_pylist([dict(zip(("lang", "last", "chunk", "times"), row, strict=True)) for row in cut])]))]
    block = collocations._Block("x", data[0], 2)
    hashes = sorted(set(block.phrases(2)[1].tolist()))
    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("times", pa.int64())])
    got = collocations._spell(pa.table({"lang": ["x"], "data": data}), pa.table({"hashes": [squeeze(np.diff(np.array(hashes, np.int64), prepend=0))]}), 3, schema)
    assert got.schema == schema
    assert {(r["size"], r["phrase"]): r["times"] for r in got.to_pylist()} == {(1, "a"): 7, (1, "b"): 5, (1, "c"): 3, (2, "a b"): 4, (2, "b a"): 2, (2, "b c"): 3}
