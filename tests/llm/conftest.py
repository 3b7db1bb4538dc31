"""Odd rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import pytest

LONG = "das lange wort ist und bleibt hier . " * 6000
ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (None, "A row without an id, but with a text of some words"),
    (5, LONG),
    (6, "x" * 30000),
    (7, "ſecret Kelvin \U0001f600 emoji line\x1cseparator\xa0nbsp İstanbul"),
    (8, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (8, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (9, "1.2.3.4.5 a@b.c_x@y.z +1 (200) 555-0100 4111 1111 1111 1111 999.1.1.1 " * 3),
]


@pytest.fixture(scope="session")
def odd(spark):
    """doc_id, text and columns named like those the operators use inside."""
    rows = [(i, t, "k", "b", 1, "en") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string, block string, codes int, lang string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
