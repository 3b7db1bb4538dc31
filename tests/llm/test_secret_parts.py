"""Random strings that look like names, or stand at the end of a path."""

from __future__ import annotations

import pytest
import tiktoken

from tenderlens.llm import secret_scan
from tenderlens.llm.queries import vocabulary

LETTERS = "qzXvKpLwRtYbNmGhJcDfSaQePoIuZx"
WORDS = "documents/projects/information/government/education/international/development/"
MIXED = "Zx9Qw3Rt7Yp1Lk5Mn8Bv2"


@pytest.fixture(scope="module")
def ask():
    ranks, pattern = vocabulary()
    encode = tiktoken.Encoding("parts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: [text[a:b] for a, b, _ in secret_scan.random_spans(text, [], lambda s: len(encode(s)), 2.2)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (f"key {LETTERS} end", [LETTERS]),
        (f"ghp_{LETTERS}0123", [f"ghp_{LETTERS}0123"]),
        (WORDS + WORDS + MIXED, [MIXED]),
        (f"{WORDS}Zx9Qw3Rt7Yp1+Lk5Mn8Bv2/Wd4Fg6Hj/{WORDS}{WORDS}", ["Zx9Qw3Rt7Yp1+Lk5Mn8Bv2/Wd4Fg6Hj"]),
        (f"{WORDS}{WORDS}{MIXED}/{WORDS}{WORDS}{LETTERS}", [MIXED, LETTERS]),
    ],
)
def test_random_strings_in_the_form_of_names(ask, text, expected):
    assert ask(text) == expected


@pytest.mark.parametrize("text", ["get_user_by_id_and_name", "MAX_RETRY_COUNT_DEFAULT", "path/to/some/ordinary/words/in/a/folder", "/usr/local/share/doc/python3", "2024-01-02-12-30-45-00", "=" * 40, "AbstractSingletonProxyFactoryBean", WORDS + "550e8400-e29b-41d4-a716-446655440000", WORDS * 2 + "D41D8CD98F00B204E9800998ECF8427E", "counterrevolutionaries"])
def test_names_and_known_forms_are_none(ask, text):
    assert ask(text) == []
