"""Hard negatives from exact inner-product search over shared lists, one for each cluster of anchors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stage

#: Anchors that share a list, lists that meet a block of rows at once, and rows of a block: they bound what a task holds.
LIST_ANCHORS, LISTS, BLOCK_ROWS = 1024, 8, 8192
#: Rows of a block at least, however many partitions there are: each block names its own best rows.
LEAST_ROWS = 512
#: Anchors from which the centres of the clusters are fitted.
FIT_ANCHORS = 4096
#: Rows of a list that are looked at in one step.
STEP = 512
#: Integers below are exact as doubles.
_EXACT = 2.0**53


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """One row of doubles for each packed vector; missing components are 0."""
    rows = [np.frombuffer(v, np.float64) for v in column.to_pylist()]
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _units(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.abs(m).max(1, initial=0)
        scaled = m / np.where(top > 0, top, 1)[:, None]
        n = np.sqrt((scaled**2).sum(1))
        return scaled / np.where(n > 0, n, 1)[:, None]


def fit_centres(sample: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Unit centres by spherical k-means; they start from rows that lie far from each other."""
    units = _units(sample)
    if not len(units):
        return np.zeros((1, sample.shape[1]))
    picked = [0]
    near = units @ units[0]
    while len(picked) < min(clusters, len(units)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, units @ units[picked[-1]])
    centres = units[picked]
    for _ in range(rounds):
        own = (units @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        centres = np.where(np.abs(sums).sum(1, keepdims=True) > 0, _units(sums), centres)
    return centres


class SharedList:
    """Rows in the order of the highest inner product that any anchor of a cluster can have with them.

    An anchor within the angle `spread` of the centre and a row at the angle t from it are at least t - spread apart, so that
    their product is at most |anchor| |row| cos(max(0, t - spread)).
    """

    def __init__(self, members: np.ndarray, centre: np.ndarray, rows: np.ndarray):
        self.members, self.rows = members, rows
        top = np.abs(members).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
        #: Beyond that the products are taken in whole Python numbers and every list is walked to its end.
        self.exact = top < _EXACT
        if not self.exact:
            self.order, self.bound, self.norms = np.arange(len(rows)), None, None
            return
        angles = lambda m: np.arccos(np.clip(_units(m) @ centre, -1, 1))
        spread = angles(members).max(initial=0)
        norms = np.sqrt((rows**2).sum(1))
        # the slack covers the rounding of the angles
        limit = norms * np.minimum(1, np.cos(np.maximum(0, angles(rows) - spread)) + 1e-7)
        self.order = np.argsort(-limit, kind="stable")
        self.bound = limit[self.order]
        self.norms = np.sqrt((members**2).sum(1)) * (1 + 1e-12)

    def steps(self, active: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, active members, products as members x rows) step by step; the caller may clear `active`, a mask, on the way."""
        for a in range(0, len(self.order), STEP):
            who = np.flatnonzero(active)
            if not len(who):
                return
            at = self.order[a : a + STEP]
            if self.exact:
                yield at, who, (self.members[who] @ self.rows[at].T).astype(np.int64)
            else:
                whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(len(m), m.shape[1])
                yield at, who, whole(self.members[who]).dot(whole(self.rows[at]).T) if self.rows.shape[1] else np.zeros((len(who), len(at)), np.int64)

    def at_most(self, member: int, seen: int) -> float:
        """No row after the first `seen` of the list has a higher product with the member."""
        if not self.exact:
            return float("inf")
        return self.norms[member] * self.bound[seen] + 1e-6 if seen < len(self.bound) else -float("inf")


def _best(held: list, fresh: Iterator[tuple], k: int) -> list:
    """The first k of (-score, key, row) in ascending order."""
    return heapq.nsmallest(k, [*held, *fresh])


def _cells(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def _positives(anchors: pa.Table, rows: pa.Table, centres: np.ndarray, k: int) -> Iterator[tuple]:
    """(anchor row, label, key and row of a positive, score): of one block, the first k of each anchor."""
    keys, uids, labels = _cells(rows, "key"), _cells(rows, "uid"), np.array(_cells(rows, "label"), object)
    for part, own, shared in _lists(anchors, rows, centres):
        mine, kinds = _cells(part, "uid"), _cells(part, "label")
        best: list[list] = [[] for _ in mine]
        active, seen = np.ones(len(mine), bool), 0
        same = {kind: labels == kind for kind in set(kinds)}
        for at, who, products in shared.steps(active):
            seen += len(at)
            for i, scores in zip(who.tolist(), products, strict=True):
                open_ = same[kinds[i]][at] & (scores >= -best[i][-1][0] if len(best[i]) == k else True)
                fresh = np.flatnonzero(open_).tolist()
                if fresh:
                    best[i] = _best(best[i], ((-int(scores[j]), keys[at[j]], uids[at[j]]) for j in fresh if uids[at[j]] != mine[i]), k)
                active[i] = len(best[i]) < k or -best[i][-1][0] <= shared.at_most(i, seen)
        for i, found in enumerate(best):
            for score, key, uid in found:
                yield mine[i], key, uid, -score


def _negatives(anchors: pa.Table, rows: pa.Table, centres: np.ndarray, k: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor row, positive row, key and row of a negative, score): of one block, the first k within each positive's range."""
    keys, uids, labels = _cells(rows, "key"), _cells(rows, "uid"), np.array(_cells(rows, "label"), object)
    for part, own, shared in _lists(anchors, rows, centres):
        mine, kinds = _cells(part, "uid"), _cells(part, "label")
        ranges = [[(p["uid"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in found] for found in _cells(part, "positives")]
        best: list[list[list]] = [[[] for _ in r] for r in ranges]
        active, seen = np.array([bool(r) for r in ranges], bool), 0
        other = {kind: labels != kind for kind in set(kinds)}
        for at, who, products in shared.steps(active):
            seen += len(at)
            for i, scores in zip(who.tolist(), products, strict=True):
                limit, going = shared.at_most(i, seen), False
                for held, (_, least, most) in zip(best[i], ranges[i], strict=True):
                    floor = max(least, -held[-1][0]) if len(held) == k else least
                    fresh = np.flatnonzero(other[kinds[i]][at] & (scores >= floor) & (scores <= most)).tolist()
                    if fresh:
                        held[:] = _best(held, ((-int(scores[j]), keys[at[j]], uids[at[j]]) for j in fresh), k)
                    going |= least <= most and limit >= (-held[-1][0] if len(held) == k else least)
                active[i] = going
        for i, found in enumerate(best):
            for (positive, _, _), held in zip(ranges[i], found, strict=True):
                for score, key, uid in held:
                    yield mine[i], positive, key, uid, -score


def _lists(anchors: pa.Table, rows: pa.Table, centres: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray, SharedList]]:
    """The anchors of each list with the list over the rows of a block."""
    width = max([centres.shape[1], *(len(v) // 8 for t in (anchors, rows) for v in _cells(t, "vector"))])
    all_rows = _matrix(rows.column("vector"), width)
    wide = np.pad(centres, ((0, 0), (0, width - centres.shape[1])))
    number = np.array(_cells(anchors, "list"), np.int64)
    for n in np.unique(number).tolist():
        part = anchors.filter(pa.array(number == n))
        own = _matrix(part.column("vector"), width)
        yield part, own, SharedList(own, wide[_cells(part, "cluster")[0]], all_rows)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.floor(np.array(v, np.float64) * 256.0).tobytes() for v in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("uid", "key", "label", "anchor")] + [pa.array(packed, pa.binary())], names=["uid", "key", "label", "anchor", "vector"])


def _cluster(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = []
        for v in batch.column("vector").to_pylist():
            unit = _units(np.frombuffer(v, np.float64)[None, :])[0]
            n = min(len(unit), centres.shape[1])
            own.append(int((centres[:, :n] @ unit[:n]).argmax()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=[*batch.schema.names, "cluster"])


def mine_hard_negatives(
    rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, clusters: int = 8,
) -> DataFrame:
    """For each anchor row and each of its `positives` best rows of the same label, the `negatives` best rows of another label whose score lies between `low` and `high` percent of the positive's.

    A score is the inner product of floor(256 * component); higher comes first, ties by smaller `key`. `anchor` is a condition on
    the columns of `rows`, `label` a column or an expression. Rows: anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score.

    Anchors are clustered by angle (centres from at most FIT_ANCHORS of them); for a cluster, the rows of a block are sorted once by
    the highest product any member can have with them, and each member walks that list until no later row can change its result.
    Blocks of rows meet batches of anchors; each pair of them yields at most `positives` (`negatives` for each positive) rows of an
    anchor, and the best of all blocks are the result, exactly.

    Rows with a null key, label or vector, or a component that is null or not finite (256-fold too), take no part; a label that
    compares as null is no label. Of vectors of unequal lengths the missing components are 0; an empty vector scores 0. Rows that
    repeat a key or a vector are rows of their own: another row with the anchor's key can be its positive. Components of any size
    are exact; a score that passes 64 bits is reported as the nearest 64-bit number. An anchor without a positive, or a positive
    without a negative, gives no row; an empty table gives none. Other columns, whatever their names, are ignored.
    """
    spark = rows.sparkSession
    kind, label_kind = rows.schema[key].dataType.simpleString(), rows.select((F.col(label) if isinstance(label, str) else label).alias("l")).schema["l"].dataType.simpleString()
    value = F.col(label) if isinstance(label, str) else label
    finite = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double") * 256) < float("inf"), F.lit(False)))
    picked = rows.where(F.col(key).isNotNull() & value.isNotNull() & F.col(vector).isNotNull() & finite)
    picked = picked.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), value.alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("vector"))
    shape = f"uid bigint, key {kind}, label {label_kind}, anchor boolean, vector binary"
    packed = stage(picked.mapInArrow(_pack, shape), "vectors")
    total, width = packed.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("vector")), F.lit(0))).first()
    sample = [r[0] for r in packed.where("anchor").orderBy(F.xxhash64("key", "uid"), "uid").limit(FIT_ANCHORS).select("vector").collect()]
    centres = fit_centres(_matrix(pa.chunked_array([pa.array(sample, pa.binary())]), width // 8), clusters)
    asked = stage(packed.where("anchor").drop("anchor").mapInArrow(lambda b: _cluster(b, centres), f"uid bigint, key {kind}, label {label_kind}, vector binary, cluster int"), "anchors")
    counts = sorted((r[0], r[1]) for r in asked.groupBy("cluster").count().collect())  # as many rows as centres
    lists, first, said = 0, F.lit(0), F.lit(1)
    for cluster, n in counts:
        own = -(-n // LIST_ANCHORS)
        first, said = F.when(F.col("cluster") == cluster, lists).otherwise(first), F.when(F.col("cluster") == cluster, own).otherwise(said)
        lists += own
    asked = asked.withColumn("list", (first + F.pmod(F.xxhash64("uid"), said)).cast("int"))
    batches, blocks = max(1, -(-lists // LISTS)), max(1, min(partitions(spark), -(-total // LEAST_ROWS)), -(-total // BLOCK_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = packed.drop("anchor").withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")).select("*", every(batches).alias("batch"))

    def search(queries: DataFrame, found, schema: pa.Schema, result: str) -> DataFrame:
        dealt = queries.withColumn("batch", F.expr(f"list DIV {LISTS}").cast("int")).select("*", every(blocks).alias("block"))

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            made = list(found(left, right)) if left.num_rows and right.num_rows else []
            return pa.table([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)] if made else [pa.array([], f.type) for f in schema], schema=schema)

        return dealt.groupBy("batch", "block").cogroup(held.groupBy("batch", "block")).applyInArrow(cell, result)

    arrow_key = packed.limit(0).toArrow().schema.field("key").type
    big = lambda made, at: (tuple(min(max(v, -(2**63)), 2**63 - 1) if i == at else v for i, v in enumerate(r)) for r in made)
    near = search(
        asked, lambda a, b: big(_positives(a, b, centres, positives), 3),
        pa.schema([("uid", pa.int64()), ("p_key", arrow_key), ("p_uid", pa.int64()), ("score", pa.int64())]), f"uid bigint, p_key {kind}, p_uid bigint, score bigint",
    )
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "p_key", "p_uid")
    chosen = stage(near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).drop("n"), "positives")
    # at most `positives` rows an anchor
    listed = chosen.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("p_uid", "score"))).alias("p")).select("uid", F.transform("p", lambda x: F.struct(x["p_uid"].alias("uid"), x["score"].alias("score"))).alias("positives"))
    far = search(
        asked.join(listed, "uid"), lambda a, b: big(_negatives(a, b, centres, negatives, low, high), 4),
        pa.schema([("uid", pa.int64()), ("p_uid", pa.int64()), ("n_key", arrow_key), ("n_uid", pa.int64()), ("n_score", pa.int64())]), f"uid bigint, p_uid bigint, n_key {kind}, n_uid bigint, n_score bigint",
    )
    order = Window.partitionBy("uid", "p_uid").orderBy(F.desc("n_score"), "n_key", "n_uid")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = ranked.join(chosen, ["uid", "p_uid"]).join(asked.select("uid", F.col("key").alias("anchor_id")), "uid")
    return out.select("anchor_id", F.col("p_key").alias("positive_id"), "rank", F.col("n_key").alias("negative_id"), F.col("score").alias("positive_score"), F.col("n_score").alias("negative_score"))


#: The same rows, every anchor against all rows.
ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), found AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS place, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE place <= 10
"""
