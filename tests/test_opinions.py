"""Opinion texts against a plain version, line by line."""

from __future__ import annotations

import random
import re

from tenderlens.operators import wording as wd
from tenderlens.rules import pack

PARTS = [
    "제안요청서 p.12, ", "제안요청서에 ", "일부 명시\n→ ", "하자보수 책임 기간을 명시하시기 바랍니다.", "영향평가 결과서를 ", "작성하여 첨부하시기 바랍니다.", " 및 ", " 또한 ", "(계약예규) 용역계약일반조건 제58조 제2항과 제3항에 따라 ",
    "용역계약일반조건 제58조 제2항·제3항 ", "보안요구사항", "pp. 3-5 ", ", ", "작업장소 상호협의 결정 비용", "하여야 합니다.", "긴문장" * 12, " ", "\n",
]


def collapse(t):
    return re.sub(f"[{wd.W}]+", " ", t).strip()


def concise(t, limit=90):
    t = collapse(t)
    if len(t) <= limit:
        return t
    kept = ""
    for part in (p.strip() for p in re.split("(?:,| 및 | 또한 | 그리고 |\\.|\\n)", t)):
        if part:
            longer = f"{kept}, {part}" if kept else part
            if len(longer) > limit:
                break
            kept = longer
    return kept or t[:limit].rstrip()


def line(item, content):
    t = collapse(content)
    if item == "8":
        for p in wd.COMMON_8:
            t = re.sub(p, "공통명시문장 추가 필요", t)
    t = t.replace("→", " ")
    t = re.sub(wd.PAGE_LIST, "", re.sub(f"제안요청서[{wd.W}]*{wd.PAGE_LIST}", "", t))
    for old, new in wd.SHORTENED:
        t = t.replace(old, new)
    t = re.sub(f"^[{wd.W}]*(일부[{wd.W}]*)?명시[{wd.W}]*", "", t).strip()
    if item == "17" and "영향평가" in t and "결과서" in t:
        return "SW사업 영향평가 결과서 첨부 필요"
    return concise(t) or "보완 필요"


def plain(rows):
    out = {}
    for doc in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == doc]
        bad = sorted(r for r in own if r[4] == pack.NON_COMPLIANT)
        gap = sorted(r for r in own if r[4] == pack.SUPPLEMENT)
        text = f"ㅇ 총 {len(own)}개 항목 중 {len(bad)}개 항목 미준수" + (f", {len(gap)}개 항목 보완필요" if gap else "")
        for r in sorted(bad, key=lambda r: r[2]) + sorted(gap, key=lambda r: r[2]):
            text += f"\n{r[1]}. {r[3] or r[1] + '번 항목'}\n  - {line(r[1], r[5] or r[6] or r[7] or '')}"
        out[doc] = (len(own), len(bad), len(gap), text.rstrip())
    return out


def test_opinions_equal_the_plain_version(spark):
    rng = random.Random(1)
    rows = []
    for doc in range(40):
        for k, item in enumerate(["5", "8", "17", "12", "2-1"]):
            said = lambda: rng.choice(["", "".join(rng.choices(PARTS, k=rng.randrange(1, 9)))])
            rows.append((doc, item, k, rng.choice(["", f"법령 {item}"]), rng.choice([pack.NON_COMPLIANT, pack.SUPPLEMENT, pack.COMPLIANT]), said(), said(), said()))
    df = spark.createDataFrame(rows, "document_id bigint, item_no string, position int, law_name string, normalized_result string, compliance_content string, recommendation string, reason string")
    got = {r.document_id: (r.total_count, r.non_compliant_count, r.needs_revision_count, r.copy_text) for r in wd.opinion_summary(df).collect()}
    assert got == plain(rows)


def test_no_rows_no_opinion(spark):
    df = spark.createDataFrame([], "document_id bigint, item_no string, position int, law_name string, normalized_result string, compliance_content string, recommendation string, reason string")
    assert wd.opinion_summary(df).collect() == []
