"""Many terms as one regular expression, and fingerprints of text that survive where it is cut."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlens.functions import text as tx

#: Alternatives that are tried one after another; more are first halved by the code point that follows.
FEW = 3


def _point(char: str) -> str:
    return f"\\x{{{ord(char):x}}}"


def _branch(parts: list[tuple[str, str]]) -> str:
    if len(parts) <= FEW:
        return "|".join(p for _, p in parts)
    half = len(parts) // 2
    low = f"(?=[{_point(parts[0][0])}-{_point(parts[half - 1][0])}])(?:{_branch(parts[:half])})"
    return f"{low}|{_branch(parts[half:])}"


def trie_regex(terms: Iterable[str]) -> str:
    """Regular expression that matches, at a place, the longest of the terms that begin there.

    The terms form a trie, so a place is left at the first character that no term has; wide nodes are searched by halves. All
    terms that begin at a place are beginnings of the longest one.
    """
    root: dict = {}
    for term in terms:
        node = root
        for char in term:
            node = node.setdefault(char, {})
        node[""] = {}

    def body(node: dict) -> str:
        parts = [(c, _point(c) + body(n)) for c, n in sorted(node.items()) if c]
        if not parts:
            return ""
        if "" in node:
            return f"(?:{_branch(parts)})?"
        return _branch(parts) if len(parts) == 1 else f"(?:{_branch(parts)})"

    return body(root)


def longest_terms(text: Column, regex: str) -> Column:
    """Distinct longest terms that begin at any place of the text; every place is searched, so overlapping terms are found."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({regex}))"), F.lit(1)))


# --- fingerprints ---------------------------------------------------------------------------------

#: Characters of one hash, and hashes of one window.  Common text of GRAM + WINDOW - 1 characters shares a window.
GRAM, WINDOW = 8, 13
SURE = GRAM + WINDOW - 1


def _hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)), lambda g: F.xxhash64(g))


def _least(values: Column, shift: int) -> Column:
    return tx.let(values, lambda v: F.zip_with(v, F.slice(v, shift + 1, F.size(v)), lambda a, b: F.least(a, b)))


def fingerprints(text: Column) -> Column:
    """Distinct least hashes of all windows of a text, about one for seven characters.

    Two texts that share SURE characters in a row share the fingerprint of that window wherever it stands in either.
    """

    def windows(h: Column) -> Column:
        eight = _least(_least(_least(h, 1), 2), 4)
        least = _least(eight, WINDOW - 8)
        return F.array_distinct(F.slice(least, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))))

    return tx.let(_hashes(text), windows)


def first_fingerprint(text: Column) -> Column:
    """Fingerprint of the first window; null for texts shorter than SURE."""
    return F.when(F.length(text) >= SURE, F.array_min(_hashes(F.substring(text, 1, SURE))))
