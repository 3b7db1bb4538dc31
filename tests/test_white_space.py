"""White space leaves texts without a pattern, and long texts are cut without reading all of them."""

import re

from pyspark.sql import functions as F

from tenderlens.functions import text as tx

TEXTS = [
    None, "", " ", "a", f"{tx.SPACES}a{tx.SPACES}b  c{tx.SPACES}", "a\u200bb \u180e\ufeff", "가\u3000나\t\t다\x85라", "𝒂 \U0001f600\xa0b",
    "x" * 260, "x" * 261, "x" * 256 + "  y z", " " * 1500 + "y" * 300, "a" + "\n" * 1200 + "b", ("a" + " " * 9) * 400, "붙임 1. (가) [나]{다}<라>「마」『바』 : ，ㆍ·-_/",
]
GAP = re.compile("[" + re.escape(tx.SPACES) + "]+")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_same_text_as_by_pattern(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    t = F.col("t")
    got = rows.select("t", tx.compact(t).alias("c"), tx.collapse(t).alias("l"), tx.ellipsis(t, 260).alias("e"), tx.compact_attachment(t).alias("a")).collect()
    for r in got:
        said = r["t"] or ""
        flat = GAP.sub(" ", said).strip(" ")
        assert r["c"] == GAP.sub("", said)
        assert r["l"] == flat
        assert r["e"] == (flat if len(flat) <= 260 else flat[:257].rstrip(tx.SPACES) + "...")
        assert r["a"] == "".join(x for x in said if x not in tx.SPACES and x not in ":：,，.ㆍ·-_/()[]{}<>「」『』")


def test_compact_asks_no_pattern(spark):
    rows = spark.createDataFrame([("a b",)], "t string").filter("length(t) < 9")
    assert "regexp" not in plan(rows.repartition(1).select(tx.compact(F.col("t")), tx.compact_attachment(F.col("t"))))
