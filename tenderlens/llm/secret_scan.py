"""Secrets: fixed patterns, and strings for which a tokenizer's vocabulary has only short pieces."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, columns

# The base patterns, in the order in which ties are listed; a match that fails its least length is dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")  # as long as a run of these characters is, it is one match
_KEYS = re.compile("password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)

#: Strings that the vocabulary is asked about.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Lengths in hex digits of common digests, and the form of a UUID: known, not secret.
DIGESTS = (32, 40, 56, 64, 96, 128)
_HEX_ONLY = re.compile("[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_UUID_INSIDE = re.compile(f"(?<![0-9A-Za-z]){_UUID.pattern}(?![0-9A-Za-z])")
_PART = re.compile("[A-Za-z0-9]+")
_LETTER = re.compile("[A-Za-z]")
_STRETCH = re.compile(r"(.)\1{3,}")
#: The form of names and paths, which are asked without their separators: parts of letters (with digits at the end only) or of digits, joined by - _ / = +.
_NAME = re.compile(r"[-_/=+]*([A-Za-z]+[0-9]{0,4}|[0-9]+)([-_/=+]+([A-Za-z]+[0-9]{0,4}|[0-9]+))*[-_/=+]*")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then assign, access, hex."""
    found = []
    if _KEYS.search(text):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, ("assign", "access", "hex")[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _excess(s: str, count, ratio: float) -> list[tuple[int, int, float]]:
    """Start, end and `ratio` * tokens - characters of each part between separators; no excess for numbers, none ever for known forms.

    A part in capitals is also asked in small letters, which a vocabulary knows better: it is a word if either is.
    A stretch of one character says no more than three of it.
    """
    known = [m.span() for m in _UUID_INSIDE.finditer(s)]
    found = []
    for m in _PART.finditer(s):
        a, b = m.span()
        p = m.group()
        if any(x <= a and b <= y for x, y in known) or _HEX_ONLY.fullmatch(p) and len(p) in DIGESTS:
            found.append((a, b, float("-inf")))
        elif p.isdigit():
            found.append((a, b, 0.0))
        else:
            q = _STRETCH.sub(r"\1\1\1", p)
            found.append((a, b, ratio * (min(count(q), count(q.lower())) if q.isalpha() and q.isupper() else count(q)) - len(p)))
    return found


def _segments(parts: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Start and end of the maximal runs of parts with an excess above 0 (Ruzzo and Tompa)."""
    held: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    out: list[tuple[int, int]] = []
    total = 0.0
    for a, b, w in parts:
        if w == float("-inf"):
            out += [(x[0], x[1]) for x in held]
            held, total = [], 0.0
            continue
        before, total = total, total + w
        if w <= 0:
            continue
        new = (a, b, before, total)
        while True:
            k = next((k for k in range(len(held) - 1, -1, -1) if held[k][2] < new[2]), -1)
            if k < 0 or held[k][3] >= new[3]:
                break
            new = (held[k][0], new[1], held[k][2], new[3])
            del held[k:]
        held.append(new)
    return out + [(x[0], x[1]) for x in held]


def random_spans(text: str, taken: list[tuple[int, int, str]], count, ratio: float) -> list[tuple[int, int, str]]:
    """Candidates outside `taken` with fewer than `ratio` characters a token, else their parts that have; `count` gives a string's tokens."""
    found = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        s = m.group()
        if any(x < b and a < y for x, y, _ in taken) or _UUID.fullmatch(s) or not _LETTER.search(s):
            continue
        if _HEX_ONLY.fullmatch(s) and len(s) in DIGESTS:
            continue
        parts = _excess(s, count, ratio)
        if len(s) < ratio * count(s) and (not _NAME.fullmatch(s) or sum(w for _, _, w in parts) > 0):
            found.append((a, b, "random"))
        else:
            found += [(a + x, a + y, "random") for x, y in _segments(parts) if y - x >= 20]
    return found


def scan_secrets(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", ratio: float = 2.2) -> DataFrame:
    """Secrets of every whole text, in one pass without a shuffle.

    One row per input row: `key`, n_assign, n_access, n_hex (base matches), base_sha256 (hex of kind:start:end of the base
    matches by start, then assign, access, hex, joined by commas), spans (those and the added kind `random`, ordered alike),
    n_random. A run of 20 or more characters of [A-Za-z0-9+/_=-] outside the base matches is `random` if it has fewer than
    `ratio` characters for each token of the vocabulary; if it has the form of a name, its parts between separators must have
    so too. Else those neighbouring parts in it are, 20 characters or more, that have fewer in all, as at the end of a path.
    Common digests, UUIDs and what holds no letter are not asked for. Offsets are code points, ends exclusive. Null and empty
    texts have no span.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        made, given = shared.value
        encode = tiktoken.Encoding("ranks", pat_str=given, mergeable_ranks=made, special_tokens={}).encode_ordinary
        for batch in batches:
            schema = pa.schema([("key", batch.schema.field("key").type), *((x, pa.int64()) for x in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64())])

            def rows(batch=batch) -> Iterator[tuple]:
                for k, t in zip(*columns(batch, "key", "text"), strict=True):
                    base = base_spans(t or "")
                    more = random_spans(t or "", base, lambda s: len(encode(s)), ratio)
                    shown = [f"{x}:{a}:{b}" for a, b, x in base]
                    every = shown if not more else [f"{x}:{a}:{b}" for a, b, x in sorted(base + more, key=lambda y: (y[0], ("assign", "access", "hex", "random").index(y[2])))]
                    n = [sum(x == name for _, _, x in base) for name in ("assign", "access", "hex")]
                    yield k, *n, hashlib.sha256(",".join(shown).encode()).hexdigest(), ",".join(every), len(more)

            yield from batches_of(rows(), schema)

    return picked.mapInArrow(scan, f"key {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint").withColumnRenamed("key", key)
