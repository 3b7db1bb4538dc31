"""The pipeline's near-duplicate stage on rows that repeat an id or have none."""

from __future__ import annotations

from collections import Counter

import numpy as np

import corpus_pipeline


def test_one_row_of_each_component_stays(spark):
    rng = np.random.default_rng(5)
    prose = lambda: " ".join(f"w{x}" for x in rng.integers(0, 9000, 90))
    repeated, twin, clean, lost, mixed, wordless = prose(), prose(), prose(), prose(), prose(), " \n"
    rows = [(1, repeated, 0)] * 5 + [(1, repeated + " end", 0)]
    rows += [(2, twin, 0), (3, twin, 0), (3, clean, 0)]  # id 3 has a copy and a clean text
    rows += [(None, lost, 0)] * 3 + [(None, lost + " end", 0)]
    rows += [(None, mixed, 0), (9, mixed, 0), (8, mixed + " end", 0)]
    rows += [(None, wordless, 0), (None, wordless, 0), (4, None, 0), (4, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, number int").repartition(3)
    out = corpus_pipeline.deduplicate(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    for key, text in ((1, repeated), (None, lost)):
        assert sum(got.pop((key, t), 0) for t in (text, text + " end")) == 1
    assert got == {(2, twin): 1, (3, clean): 1, (8, mixed + " end"): 1, (None, wordless): 2, (4, None): 2}
