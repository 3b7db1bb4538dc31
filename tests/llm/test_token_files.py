"""Token files against the tokenizers library, exact round trips, damage, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tenderlens.llm import token_files
from tenderlens.llm.queries import END_ID, WORD_VOCABULARY, op11_token_files
from tenderlens.llm.range_coder import BLOCK_IDS, decode_blocks, encode_blocks
from tenderlens.llm.token_files import CrcJoiner, WordCoder, decode_frames, make_frame, read_frames, read_token_files, write_token_files

with open(public_tokenizers.path(WORD_VOCABULARY), encoding="utf-8") as f:
    DEFINITION = f.read()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_str(DEFINITION)


def round_trip(blocks):
    coded = encode_blocks(blocks)
    back = decode_blocks([(len(b), distinct, code) for b, (distinct, code) in zip(blocks, coded, strict=True)])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))
    for k in (1, 3):  # whatever other blocks are coded beside them
        for a in range(0, len(blocks), k):
            some = decode_blocks([(len(b), *c) for b, c in zip(blocks[a : a + k], coded[a : a + k], strict=True)])
            assert all(np.array_equal(x, y) for x, y in zip(blocks[a : a + k], some, strict=True))
    return sum(len(c) + 2 * len(d) for d, c in coded)


def test_ids_come_back():
    rng = np.random.default_rng(1)
    ids = lambda n, top: rng.integers(0, top, n).astype(np.uint32)
    blocks = [ids(rng.integers(0, 700), 50) for _ in range(20)]
    blocks += [ids(BLOCK_IDS, 60000), ids(BLOCK_IDS, 3), np.zeros(BLOCK_IDS, np.uint32), ids(1, 9), ids(0, 9)]
    blocks += [np.arange(BLOCK_IDS, dtype=np.uint32), np.array([2**32 - 1, 0, 2**32 - 1, 7], np.uint32), ids(900, 2**32 - 1)]
    round_trip(blocks)
    assert encode_blocks([]) == [] and decode_blocks([]) == []
    with pytest.raises(ValueError):
        encode_blocks([ids(BLOCK_IDS + 1, 9)])


def test_repetition_is_found():
    rng = np.random.default_rng(2)
    phrase = rng.integers(0, 40000, 60).astype(np.uint32)
    assert round_trip([np.tile(phrase, 60)]) < 500  # 7,200 bytes as 16-bit numbers
    skewed = np.minimum(rng.zipf(1.3, BLOCK_IDS), 60000).astype(np.uint32)
    assert round_trip([skewed] * 3) < 3 * 2 * BLOCK_IDS * 0.75


def test_words_encode_as_whole_texts_do(tokenizer):
    rng = random.Random(3)
    odd = [chr(c) for c in range(0, 33)] + list("\x7f\x85\xa0     　​́̊ͅİΣßﬁẞÅ's'llA1!-<|>") + ["<|endoftext|>", "<|startoftext|>", "é", "\U0001f600", "word", "don't", "ΣΑΣ"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(400)] + [None, "", " ", "\n"]
    coder = WordCoder(DEFINITION)
    for part in (texts[:150], texts[150:]):
        ids, n = coder.encode(part, END_ID)
        expected = [tokenizer.encode(t or "", add_special_tokens=False).ids + [END_ID] for t in part]
        assert n.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [i for e in expected for i in e]
    whole, n = WordCoder(DEFINITION, by_words=False).encode(texts, END_ID)
    assert whole.tolist() == [i for t in texts for i in tokenizer.encode(t or "", add_special_tokens=False).ids + [END_ID]]


def test_checksums_join():
    rng, join = random.Random(4), CrcJoiner()
    for n, m in ((0, 0), (1, 0), (0, 5), (1, 1), (1000, 3), (3, 70001)):
        a, b = rng.randbytes(n), rng.randbytes(m)
        assert join(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)


def test_frames_stand_alone_and_show_damage():
    blocks = [np.arange(300, dtype=np.uint32) % 7, np.array([70000, 1], np.uint32)]
    coded = encode_blocks(blocks)
    frames = [make_frame(b, d, c, [("k", i, 0, len(b))]) for i, (b, (d, c)) in enumerate(zip(blocks, coded, strict=True))]
    data = b"".join(frames)
    read = list(decode_frames(list(read_frames(data))))
    assert [(p, ids.tolist()) for p, ids in read] == [([("k", i, 0, len(b))], b.tolist()) for i, b in enumerate(blocks)]
    assert list(decode_frames(list(read_frames(frames[1]))))[0][1].tolist() == [70000, 1]
    for at in (0, 5, 9, 30, len(frames[0]) - 1):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(Exception):  # noqa: B017
            list(decode_frames(list(read_frames(bytes(bad)))))
    with pytest.raises(ValueError):
        list(read_frames(data[:-3]))


def plain(tokenizer, rows):
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [END_ID]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out, start


def test_given_documents(spark, documents, tokenizer):
    got = sorted(map(tuple, op11_token_files(spark, "/root/testdata/sf0.001").select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == plain(tokenizer, [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()])[0]


def test_odd_rows(spark, odd, none, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "LANES", 2)
    write_token_files(odd, str(tmp_path / "odd"), DEFINITION, END_ID)
    got = read_token_files(spark, str(tmp_path / "odd")).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    expected, total = plain(tokenizer, rows)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted(((r[0], r[2], r[3]) for r in expected), key=str)
    assert sorted(r[1] for r in got) == sorted(r[1] for r in expected)
    assert [r[0] for r in sorted(map(tuple, got), key=lambda r: r[1])] == [r[0] for r in sorted(expected, key=key)]
    assert sum(r[2] for r in got) == total
    write_token_files(none, str(tmp_path / "none"), DEFINITION, END_ID)
    assert read_token_files(spark, str(tmp_path / "none")).collect() == []


def test_keys_can_be_strings(spark, tokenizer, tmp_path):
    rows = [("b", "two words"), ("a", "one"), (None, "x")]
    write_token_files(spark.createDataFrame(rows, "name string, body string"), str(tmp_path / "s"), DEFINITION, END_ID, "name", "body")
    got = sorted(map(tuple, read_token_files(spark, str(tmp_path / "s"), "name", "string").collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, "a", "b"]
    assert [r[2] for r in got] == [len(tokenizer.encode(t).ids) + 1 for t in ("x", "one", "two words")]
