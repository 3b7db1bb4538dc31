"""Audit from facts of pages: read once, and only repaired pages again."""

from __future__ import annotations

import random

from tenderlens.operators import audit, pages
from tests.conftest import page_row
from tenderlens.schema import DOCUMENT


def documents(spark, ids, total):
    return spark.createDataFrame([tuple({"document_id": d, "total_pages": total}.get(f.name) for f in DOCUMENT.fields) for d in ids], DOCUMENT)


def corpus(make_pages, seed=1):
    rng = random.Random(seed)
    words = ["사업개요", "제안", "요청", "평가", "배점", "별첨", "목록", "일반 사항", "보안 요구사항", "x" * 40]
    rows, seq = [], 0
    for d in range(6):
        for p in range(1, 15):
            seq += 1
            text = "" if rng.random() < 0.2 else " ".join(rng.choices(words, k=rng.randrange(1, 8)))
            rows.append(page_row(p, text, doc=d, seq=seq, warning="text extraction failed" if rng.random() < 0.1 else None, has_eval_table=rng.random() < 0.1))
    rows.append(page_row(3, "", doc=0, seq=900))  # a page twice
    supplied = [page_row(p, f"사업개요 제안요청 {'본문 ' * 20}", doc=d, seq=1000 + 20 * d + p) for d in range(6) for p in range(1, 15) if rng.random() < 0.7]
    supplied += [page_row(2, "", doc=1, seq=5000)]  # repaired to nothing
    return make_pages(rows), make_pages(supplied)


def step_by_step(page, document, supplied, rounds):
    """Every round over the whole page table."""
    scored, warnings = audit.audit_documents(page, document)
    for _ in range(rounds):
        bad = audit.repair_pages(page, warnings)
        page = pages.merge_repaired_pages(page, supplied.join(bad, ["document_id", "page_no"], "left_semi"))
        scored, warnings = audit.audit_documents(page, document)
    return page, scored, warnings


def shown(df):
    return sorted((tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()))


def test_rounds_equal_whole_audits(spark, make_pages):
    page, supplied = corpus(make_pages)
    document = documents(spark, range(6), 14)
    for rounds in (0, 1, 2):
        got = audit.repair_round(page, document, supplied, rounds)
        want = step_by_step(page, document, supplied, rounds)
        for a, b in zip(got, want, strict=True):
            assert shown(a) == shown(b)


def test_a_round_reads_repaired_pages_only(spark, make_pages, monkeypatch):
    page, supplied = corpus(make_pages)
    read = []
    plain = audit.audit_facts
    monkeypatch.setattr(audit, "audit_facts", lambda df: read.append(df) or plain(df))
    audit.repair_round(page, documents(spark, range(6), 14), supplied, 2)
    assert read[0] is page and len(read) == 3
    assert 0 < read[1].count() <= supplied.count()
    assert all(r.seq >= 1000 for df in read[1:] for r in df.collect())  # none of the page table


def test_an_audit_reads_the_page_table_once(spark, make_pages, tmp_path):
    page, _ = corpus(make_pages)
    page.write.parquet(str(tmp_path / "pages"))
    stored = spark.read.parquet(str(tmp_path / "pages"))
    scored, warnings = audit.audit_documents(stored, documents(spark, range(6), 14))
    for df in (scored, warnings):
        assert str(tmp_path) not in df._jdf.queryExecution().toString()  # from the staged facts alone
