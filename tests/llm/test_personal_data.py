"""Personal data against a plain version of the base patterns, and what contexts add."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from tenderlens.llm import personal_data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(s):
    d = [int(c) for c in s if c in "0123456789"][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def plain(t):
    found = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, t or ""):
            s = m.group()
            n = sum(c in "0123456789" for c in s)
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 13 <= n <= 19 and luhn(s), "phone": 9 <= n <= 15}[kind]
            if ok:
                found.append((kind, m.start(), m.end()))
    return found


TRICKY = [
    (30, "a@b.com_x@y.z q@w..e %@1.2 x.y+z@é.com é@a.b 😀 me@x-y.co.uk,"),
    (31, "1.2.3.4.5.6.7.8 0000255.1.1.1 256.1.1.1 1.2.3. 4.5.6.7 ١.2.3.4"),
    (32, "4111 1111-1111 1111 4111111111111112 4111  1111 1111 1111 0000000000000000000 00000000000000000000 4222222222222"),
    (33, "+1 (200) 555-0100 +1+1 (200) 555-0100. ++44 20 7946 0958 12 +1 23456789 +12 345 678 9012 3456 78"),
    (34, "z" * 5000 + "@" + "b.c" * 3000),
    (35, "9" * 20000),
]


def test_base_matches_equal_plain_regular_expressions(spark, odd, documents):
    docs = odd.select("doc_id", "text").union(documents.select("doc_id", "text")).union(spark.createDataFrame(TRICKY, "doc_id bigint, text string"))
    got = personal_data.list_personal_data(*personal_data.find_personal_data(docs)).collect()
    expected = []
    for r in docs.collect():
        found = plain(r.text)
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        expected.append((r.doc_id, *(sum(k == x for k, _, _ in found) for x, _ in BASE), hashlib.sha256(shown.encode()).hexdigest()))
    assert sorted(map(repr, ((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got))) == sorted(map(repr, expected))


def test_contexts_of_seeds_find_other_forms(spark):
    seeds = [(i, f"Some words here. Reach: user{i}x@mail{i}.example.com now") for i in range(30)]
    odd_ones = [(100, "Then reach jane9(at)mail.example, today"), (101, "about 9b at all"), (102, "again about 7c at last")]
    docs = spark.createDataFrame(seeds + odd_ones, "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in personal_data.list_personal_data(*personal_data.find_personal_data(docs)).collect()}
    assert got[100] == "email:11:32" and got[101] == got[102] == ""
    text = {r.doc_id: r.text for r in personal_data.redact(docs).collect()}
    assert text[100] == "Then reach [EMAIL], today" and text[0] == "Some words here. Reach: [EMAIL] now" and text[101] == "about 9b at all"


def test_redaction_keeps_rows_columns_and_nulls(odd, none):
    got = personal_data.redact(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[2] is None and by[3] == "" and by[9].startswith("[IP].5 [EMAIL][EMAIL] +1 (200)")
    four = odd.where("doc_id = 1").withColumn("text", F.lit("é 1.2.3.4, +1 (200) 555-0100; 4111 1111 1111 1111 x@y.z!"))
    assert personal_data.redact(four).first().text == "é [IP], [PHONE]; [CARD] [EMAIL]!"
    assert personal_data.redact(none).count() == 0
    assert personal_data.list_personal_data(*personal_data.find_personal_data(none)).count() == 0


def test_no_python_in_the_plan(odd):
    plan = personal_data.list_personal_data(*personal_data.find_personal_data(odd.withColumn("x", F.lit(1))))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
