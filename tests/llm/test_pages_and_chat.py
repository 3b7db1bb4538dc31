"""Page templates on pages whose main text is known, preference segments against a plain version."""

from __future__ import annotations

import html
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tenderlens.llm import chat, templates

SHELL = "<html><head><title>T</title><script>var t='</p>';</script></head><body><header>Top</header><nav><ul><li>Home<li>More</ul></nav><div class='cookie-notice'>We use</div>{}<section id=comments><p>A reader</p></section><footer>&copy; x</footer></body></html>"


def test_pages_of_the_given_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in templates.extract_pages(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"</?(p|h1|br)\b[^>]*>", " ", article).replace("<b>", "").replace("</b>", "")).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)


def test_template_without_an_article_and_odd_rows(spark):
    made = [(i, f"http://h.example/{i}", SHELL.format(f"<div class=box><h2>Head {i}</h2><p>Body <b>bold</b>ly {i} &amp;\n more</p><p>And {i} again</div><div class=side-bar><p>Aside</p></div>")) for i in range(5)]
    made += [(10, None, None), (11, "nonsense", ""), (12, "http://one.example/", "<p>alone <i>here"), (13, "http://h.example/x", "plain < text & no tags"), (0, made[0][1], made[0][2]), (14, "http://one.example/", "<" * 50 + '<div class="x' + "<!--")]
    pages = spark.createDataFrame([(*r, "k") for r in made], "page_id bigint, url string, html string, host string")
    rows = templates.extract_pages(pages).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert len(rows) == len(made)
    for i in range(5):
        assert set(got[i]) == {f"Head {i} Body boldly {i} & more And {i} again"}
    assert got[10] == got[11] == [""] and got[12] == ["alone here"] and got[13] == ["plain < text & no tags"]
    assert templates.extract_pages(pages.where("1 = 0")).count() == 0


def plain(turns):
    """Segments of each pair as sets of turns."""
    pairs = defaultdict(lambda: (defaultdict(set), defaultdict(set)))
    for conv, turn, role, text in turns:
        if conv is not None:
            pairs[conv // 2][conv % 2][turn if turn is not None else -(2**63)].add((turn, role, text))
    out = set()
    for pair, (chosen, rejected) in pairs.items():
        bad = [t for t in {*chosen, *rejected} if chosen.get(t) != rejected.get(t)]
        first = min(bad) if bad else None
        for part, side in (("chosen", chosen), ("rejected", rejected)):
            for t, rows in side.items():
                for turn, role, text in rows:
                    shared = first is None or t < first
                    out.add((pair, "prompt" if shared else part, turn, role, f"<|im_start|>{role or ''}\n{text or ''}<|im_end|>\n", not shared and role == "assistant", bool(chosen) and bool(rejected)))
    return out


def test_preferences_equal_a_plain_version(spark):
    turns = [(0, 0, "user", "q"), (1, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "x"), (2, 0, "user", "x"), (3, 0, "user", "x"), (4, 0, "user", "alone"), (6, None, "system", None), (7, None, "system", None), (6, 1, None, "m"), (7, 2, "assistant", "m"), (None, 0, "user", "lost"), (8, 0, "user", "y"), (8, 0, "assistant", "z"), (9, 0, "assistant", "z"), (9, 0, "user", "y"), (9, 1, "assistant", "end")]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").withColumn("conv_id", F.col("conv_id") + 1000)
    both = frame.union(given)
    got = chat.format_preferences(both.withColumn("first", F.lit("clash")).withColumn("pair_id", F.lit(9)), F.expr("conv_id DIV 2"), F.expr("conv_id % 2 = 0")).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == plain([tuple(r) for r in both.collect()])
    assert chat.format_preferences(frame.where("1 = 0"), F.expr("conv_id DIV 2"), F.expr("conv_id % 2 = 0")).count() == 0
