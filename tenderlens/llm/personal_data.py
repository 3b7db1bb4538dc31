"""Personal data by bootstrapped contextual extraction, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

KINDS = ("email", "ip", "card", "phone")
# The base patterns. A match can only begin where a run of its first characters does, or where the match before it
# ended, and its last group gives nothing back; both leave the matches as they are and keep a search over one long run linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Other strings that can identify: between white space, with a digit or an @.
OTHER = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Characters before a match that its context is taken from.
CONTEXT = 80


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.transform(F.reverse(F.split(_digits(value), "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.expr("0") + d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(digits, F.lit(0), lambda s, d: s + d) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    n = F.length(_digits(value))
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(kind == "card", F.when(n.between(13, 19), _luhn(value)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(False)
    )


def _hits(text: Column, kind: str, pattern: str, needed: Column) -> Column:
    """The matches in order: characters between this and the one before, the match, and what stands before it."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = F.zip_with(pieces, found, lambda p, m: F.struct(F.lit(kind).alias("kind"), F.length(p).alias("gap"), m.alias("value"), F.right(p, F.lit(CONTEXT)).alias("before")))
    kept = F.filter(each, lambda h: h["value"].isNotNull())
    return F.when(needed, kept).otherwise(F.array().cast("array<struct<kind:string,gap:int,value:string,before:string>>"))


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 3, confidence: float = 0.8, support: int = 5, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Base matches of every whole text, and what high-confidence contexts add to them.

    Returns (rows, spans). rows: one per input row, `row` (its number here), `key`, and the columns named in `keep`; spans: `row`,
    kind, start, stop (code points, stop exclusive), base (found by the patterns, else by context). The base matches are seeds.
    A lexical pattern is the word before a string. Patterns and strings form a graph; in each of `rounds` rounds a pattern's
    score for a kind is the mean score of its strings (a seed has 1 for its kind, any other string the mean of its patterns).
    A pattern with `support` different seeds of a kind and a score of `confidence` makes every other string after it, with a
    digit or an @ and outside the base matches, a span of that kind. Null text has no span; repeated rows are found alike.
    Scores are added up by Spark before rows are exchanged; nothing is collected.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    digit = t.rlike("[0-9]")
    tests = {k: (F.contains(t, F.lit(n)) if n else F.lit(True)) & (digit if k != "email" else F.lit(True)) for k, n in NEEDED.items()}
    hits = F.concat(*(_hits(t, k, PATTERNS[k], tests[k]) for k in KINDS), _hits(t, "other", OTHER, digit | F.contains(t, F.lit("@"))))
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), *[F.col(c).alias(f"keep_{c}") for c in keep or []], hits.alias("hits")), "hits")
    hit = rows.where(F.size("hits") > 0).select("row", F.posexplode("hits").alias("at", "hit")).select("row", "at", "hit.*")
    # where a match begins is what lies before it in its own text: gaps and matches up to here, in one pass over a row's matches
    order = Window.partitionBy("row", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.length("value")).over(order)
    placed = hit.withColumn("stop", end.cast("int")).withColumn("start", (F.col("stop") - F.length("value")).cast("int"))
    trimmed = F.regexp_extract("value", r"^[^\p{L}\p{N}@]*([\p{L}\p{N}@](?:.*[\p{L}\p{N}])?)", 1)
    lead = F.length(F.regexp_extract("value", r"^[^\p{L}\p{N}@]*", 0))
    other = F.col("kind") == "other"
    cut = placed.select(
        "row", "kind", F.when(other, F.col("start") + lead).otherwise(F.col("start")).alias("start"), F.when(other, F.col("start") + lead + F.length(trimmed)).otherwise(F.col("stop")).alias("stop"), F.when(other, trimmed).otherwise(F.col("value")).alias("value"),
        F.lower(F.regexp_extract(F.concat(F.lit(" "), "before"), r"[^\p{L}]([\p{L}]+)[^\p{L}\p{N}@]*$", 1)).alias("pattern"),
    )
    good = cut.where(F.when(other, F.length("value") > 1).otherwise(_valid(F.col("kind"), F.col("value"))))
    # strings that overlap a base match are those matches, or parts of them
    nearby = Window.partitionBy("row").orderBy("start", "stop", "kind")
    base_end, base_start = F.when(~other, F.col("stop")), F.when(~other, F.col("start"))
    free = good.withColumn("over", F.greatest(F.coalesce(F.max(base_end).over(nearby.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start"), F.lit(False)), F.coalesce(F.min(base_start).over(nearby.rowsBetween(1, Window.unboundedFollowing)) < F.col("stop"), F.lit(False))))
    entities = stage(free.where(~(other & F.col("over"))).select("row", "kind", "start", "stop", "value", "pattern"), "entities")
    confident = _patterns(entities, rounds, confidence, support)
    found = entities.where(other).join(confident, "pattern").select("row", F.col("to").alias("kind"), "start", "stop", F.lit(False).alias("base"))
    spans = entities.where(~other).select("row", "kind", "start", "stop", F.lit(True).alias("base")).union(found)
    return rows.drop("hits"), spans


def _patterns(entities: DataFrame, rounds: int, confidence: float, support: int) -> DataFrame:
    """(pattern, to): the patterns that are sure of a kind."""
    edges = stage(entities.where("pattern <> ''").groupBy("pattern", "kind", "value").agg(F.count(F.lit(1)).alias("times")), "graph")
    seeds = edges.where("kind <> 'other'")
    seeded = seeds.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    scores = seeded.join(sizes, "pattern").select("pattern", F.col("kind").alias("to"), "seeds", "n", (F.col("seeds") / F.col("n")).alias("score"))
    unseen = edges.where("kind = 'other'").select("pattern", "value")
    for _ in range(rounds):
        # a string's score for a kind is the mean over all its patterns, those without a score for the kind counting as none
        degree = unseen.groupBy("value").agg(F.count(F.lit(1)).alias("patterns"))
        strings = unseen.join(scores.select("pattern", "to", "score"), "pattern").groupBy("value", "to").agg(F.sum("score").alias("s")).join(degree, "value").select("value", "to", (F.col("s") / F.col("patterns")).alias("s"))
        gained = unseen.join(strings, "value").groupBy("pattern", "to").agg(F.sum("s").alias("gained"))
        scores = stage(scores.select("pattern", "to", "seeds", "n").join(gained, ["pattern", "to"], "left").withColumn("score", (F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / F.col("n")).select("pattern", "to", "seeds", "n", "score"), "scores")
    best = scores.where((F.col("seeds") >= support) & (F.col("score") >= confidence))
    return best.groupBy("pattern").agg(F.max(F.struct("score", "seeds", "to")).alias("b")).select("pattern", F.col("b.to").alias("to"))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def _of(kind: str):
    return lambda span: span["kind"] == kind


def list_personal_data(rows: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per row of `rows`: `key`, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (all, by kind, then start)."""
    one = F.struct(_rank(F.col("kind")).alias("rank"), "start", "stop", "kind", "base")
    listed = spans.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("all"))  # a row's own spans
    shown = lambda spans_: F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    every = F.coalesce("all", F.array().cast("array<struct<rank:bigint,start:int,stop:int,kind:string,base:boolean>>"))
    base = F.filter(every, lambda s: s["base"])
    n = [F.size(F.filter(base, _of(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return rows.join(listed, "row", "left").select(F.col("key").alias(key), *n, F.sha2(shown(base), 256).alias("base_sha256"), shown(every).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with every span of its text replaced by its kind in brackets, as [EMAIL]; overlapping spans become one, named after the first.

    All columns and rows stay, whatever the names; null text stays null, and repeated rows are redacted alike. A text without a digit
    and without an @ has no candidate: its row passes by, and neither it nor its text is staged or exchanged.
    """
    names = docs.columns
    candidate = F.coalesce(F.col(text), F.lit("")).rlike("[0-9@]")
    rows, spans = find_personal_data(docs.where(candidate), key, text, keep=names, **options)
    order = Window.partitionBy("row").orderBy("start", "stop", "kind")
    fresh = F.coalesce(F.col("start") >= F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    merged = spans.withColumn("g", F.sum(fresh.cast("int")).over(order)).groupBy("row", "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min(F.struct("start", "stop", "kind"))["kind"].alias("kind"))
    # each span carries where the one before it ended, so that a text is put together from its pieces in one step
    chained = merged.withColumn("from", F.coalesce(F.lag("stop").over(Window.partitionBy("row").orderBy("start")), F.lit(0)))
    listed = chained.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "from", "stop", "kind"))).alias("cuts"))
    old = F.col(f"keep_{text}")
    pieces = F.transform("cuts", lambda c: F.concat(F.substring(old, c["from"] + 1, c["start"] - c["from"]), F.lit("["), F.upper(c["kind"]), F.lit("]")))
    rest = F.substring(old, F.element_at("cuts", -1)["stop"] + 1, F.length(old))
    new = F.when(F.col("cuts").isNull(), old).otherwise(F.concat(F.array_join(pieces, ""), rest))
    redacted = rows.join(listed, "row", "left").select(*[(new if c == text else F.col(f"keep_{c}")).alias(c) for c in names])
    return docs.where(~candidate).select(*[F.col(c) for c in names]).union(redacted)
