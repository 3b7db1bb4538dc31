"""The whole pipeline against a plain version of its stages."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from test_near_dup import plain as plain_components
from test_personal_data import plain as plain_spans
from test_text_operators import plain_contamination

import corpus_pipeline
from tenderlens.llm import line_quality, personal_data
from tenderlens.llm.queries import vocabulary

WORD = re.compile("[^\x20\x09-\x0d]+")
KINDS = personal_data.KINDS


def plain_quality(text: str | None, field) -> bool:
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return False
    lines = [x for x in text.split("\n") if WORD.search(x)]
    scores = line_quality.line_features(lines) @ field.weights
    best = {0: (0.0, [0]), 1: (scores[0], [1])}
    for s in scores[1:]:
        step = {}
        for y in (0, 1):
            came = max((1, 0), key=lambda x, y=y, best=best: best[x][0] + field.moves[x, y])
            step[y] = (best[came][0] + field.moves[came, y] + s * y, [*best[came][1], y])
        best = step
    marks = best[1][1] if best[1][0] >= best[0][0] else best[0][1]
    return sum(len(WORD.findall(x)) for x, y in zip(lines, marks, strict=True) if y) >= 0.5 * len(words)


def plain_contexts(texts: list[str], rounds: int = 3, confidence: float = 0.8, support: int = 5) -> list[list[tuple[int, int, str]]]:
    """Spans of every text: base matches, and strings after the words that seeds follow."""
    base = [[(a, b, kind) for kind, a, b in plain_spans(t)] for t in texts]
    seen = []  # text, start, stop, kind, value, pattern

    def word_before(t: str, at: int, last: int) -> str:
        found = regex.search(r"[^\p{L}]([\p{L}]+)[^\p{L}\p{N}@]*$", " " + t[max(last, at - 80) : at])
        return found.group(1).lower() if found else ""

    for n, t in enumerate(texts):
        for kind, pattern in personal_data.PATTERNS.items():
            last = 0
            for m in re.finditer(pattern.replace(r"|\G", ""), t) if kind != "email" else re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t):
                if (m.start(), m.end(), kind) in base[n]:
                    seen.append((n, m.start(), m.end(), kind, m.group(), word_before(t, m.start(), last)))
                last = m.end()
        last = 0
        for m in re.finditer(r"[^ \t\n\x0b\f\r]*[0-9@][^ \t\n\x0b\f\r]*", t):
            inner = regex.search(r"^[^\p{L}\p{N}@]*([\p{L}\p{N}@](?:.*[\p{L}\p{N}])?)", m.group())
            if inner and len(inner.group(1)) > 1:
                a = m.start() + inner.start(1)
                b = a + len(inner.group(1))
                if not any(x < b and a < y for x, y, _ in base[n]):
                    seen.append((n, a, b, "other", inner.group(1), word_before(t, m.start(), last)))
            last = m.end()
    edges = {(p, kind, v) for _, _, _, kind, v, p in seen if p}
    size, seeds = defaultdict(int), defaultdict(int)
    for p, kind, _ in edges:
        size[p] += 1
        seeds[p, kind] += kind != "other"
    score = {k: s / size[k[0]] for k, s in seeds.items() if s}
    of_string, of_pattern = defaultdict(set), defaultdict(set)
    for p, kind, v in edges:
        if kind == "other":
            of_string[v].add(p)
            of_pattern[p].add(v)
    for _ in range(rounds):
        string = {(v, kind): sum(score.get((p, kind), 0) for p in ps) / len(ps) for v, ps in of_string.items() for kind in KINDS}
        score = {(p, kind): (seeds[p, kind] + sum(string[v, kind] for v in of_pattern[p])) / size[p] for p, kind in score}
    sure = {}
    for p, kind in score:
        if seeds[p, kind] >= support and score[p, kind] >= confidence:
            sure[p] = max(sure.get(p, (0.0, 0, "")), (score[p, kind], seeds[p, kind], kind))
    for n, a, b, kind, _, p in seen:
        if kind == "other" and p in sure:
            base[n].append((a, b, sure[p][2]))
    return base


def plain_redact(t: str, spans: list[tuple[int, int, str]]) -> str:
    out, stop = "", 0
    for a, b, kind in sorted(spans):
        if a >= stop or not out and not stop:
            out += t[stop:a] + f"[{kind.upper()}]"
        stop = max(stop, b)
    return out + t[stop:]


def plain_pipeline(docs: list, items: list, field) -> list[tuple]:
    docs = [d for d in docs if plain_quality(d[1], field)]
    gone = {k for k, _, _, kept in plain_components(docs, 5) if not kept and k is not None}
    docs = [d for d in docs if d[0] not in gone]
    docs = [d for d, verdict in zip(docs, plain_contamination(docs, items), strict=True) if not verdict[-1]]
    texts = [plain_redact(t, s) for (_, t), s in zip(docs, plain_contexts([t for _, t in docs]), strict=True)]
    ranks, pattern = vocabulary()
    encoding = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = []
    for (key, _), t in zip(docs, texts, strict=True):
        ids = encoding.encode_ordinary(t)
        out.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def tables(spark, odd, documents, tmp_path_factory):
    """The smallest tables, odd rows, rows that each stage decides on, and columns with clashing names."""
    root = tmp_path_factory.mktemp("tables")
    word = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "ra", "se", "ti") for b in ("lo", "na", "ru", "vis")]
    rng = np.random.default_rng(11)
    prose = lambda n: " ".join(rng.choice(word, n)).capitalize() + "."
    seeds = [(3000 + i, f"{prose(70)} Reach: user{i}x@mail{i}.example.com now", None) for i in range(12)]
    more = [(3100, f"{prose(70)} Then reach jane9(at)mail.example, today", "en"), (3101, None, "en"), (3102, prose(30), None)]
    twin = prose(120)
    more += [(3200, twin, None), (3201, twin, None), (3202, twin + " and one more end", None)]
    extra = spark.createDataFrame(seeds + more, "doc_id bigint, text string, lang string")
    docs = documents.unionByName(odd.drop("lang"), allowMissingColumns=True).unionByName(extra, allowMissingColumns=True)
    docs.withColumn("row", F.lit(7)).withColumn("kept", F.lit(False)).write.parquet(f"{root}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_pipeline_equals_its_plain_version(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    field = line_quality.fit_field(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    expected = plain_pipeline([(r.doc_id, r.text) for r in docs.collect()], items, field)
    got = corpus_pipeline.run(spark, tables).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(repr(tuple(r)) for r in got) == expected
    keys = {r.doc_id for r in got}
    assert 3100 in keys and 3200 in keys and not keys & {3101, 3102, 3201, 3202}


def test_every_stage_keeps_columns_and_takes_an_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("1 = 0")
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, tables)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() == 0
