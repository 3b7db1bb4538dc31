"""Key filters find every key again; what is staged has an owner."""

from __future__ import annotations

import os
import tracemalloc

import numpy as np

from tenderlens.llm import blocks, common
from tenderlens.llm.common import delete_paths, key_filter, may_hold, owning, stage


def test_every_key_is_found_again(spark):
    keys = spark.range(0, 3000, 3).selectExpr("struct(id, cast(id as string) as s) as k")
    every = spark.range(30000).selectExpr("id", "struct(id, cast(id as string) as s) as k")
    kept = {r.id for r in every.where(may_hold(key_filter(keys, "k"), "k")).select("id").collect()}
    assert kept >= set(range(0, 3000, 3)) and len(kept) < 5000
    assert every.where(may_hold(key_filter(keys.where("1 = 0"), "k"), "k")).count() == 0


def test_owned_folders_go(spark):
    paths: list[str] = []
    with owning(paths):
        df = stage(spark.range(5), "owned")
    other = stage(spark.range(6), "other")
    assert df.count() == 5 and len(paths) == 1
    folder = paths[0].removeprefix("file:")
    assert os.path.isdir(folder)
    delete_paths(spark, paths)
    assert not os.path.exists(folder) and paths == [] and other.count() == 6


def test_a_long_block_takes_little_beside_its_numbers():
    rng = np.random.default_rng(3)
    words = [b"%d" % i for i in range(3000)]
    codes = [rng.integers(0, 3000, n).astype(np.uint32) for n in (0, 1_500_000, 0, 700, 1_500_000, 0)]
    flags, keys, held = [True, True, False, False, True, True], list(range(6)), [c.copy() for c in codes]
    tracemalloc.start()
    made = list(blocks._block(keys, codes, flags, words, 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * 3_000_700  # 58 bytes a word before
    listed, numbers, counts = {}, [], {}
    for _, key, doc, bucket, packed, steps, flagged in made:
        if bucket is None:
            numbers.append((key, common.unpack(doc)))
            continue
        for w, c, n in zip(common.expand_words(packed), np.cumsum(common.expand(steps)), common.expand(flagged), strict=True):
            listed[int(c)], counts[w] = w, int(n)
    assert [k for k, _ in numbers] == keys
    for (_, got), own in zip(numbers, held, strict=True):
        assert [listed[c] for c in got[:2000].tolist()] == [words[c] for c in own[:2000].tolist()] and len(got) == len(own)
    asked = np.bincount(np.concatenate([held[i] for i in (0, 1, 4, 5)]), minlength=3000)
    assert [counts[w] for w in words] == asked.tolist()
