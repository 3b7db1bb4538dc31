"""Order-dependent steps inside one document, without putting a whole document in one task.

A document is cut into blocks of consecutive page numbers.  Row-level windows run per (document, block);
only one summary row per block is carried across blocks, so a document that holds a third of all pages is
spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SIZE = 4096


def block_of(page_no: Column, size: int = BLOCK_SIZE) -> Column:
    return F.floor(page_no / F.lit(size)).cast("long")


def position_in_document(
    df: DataFrame, key: Sequence[str], page_col: str, order: Sequence[str], name: str = "position",
    size: int = BLOCK_SIZE,
) -> DataFrame:
    """One-based row number over `key` ordered by `order`, whose first member must be `page_col`."""
    key = list(key)
    df = df.withColumn("_block", block_of(F.col(page_col), size))
    counts = df.groupBy(*key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*key, "_block").orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*key, "_block"])
        .withColumn(name, (F.col("_offset") + F.col("_rn")).cast("long"))
        .drop("_block", "_rn", "_offset")
    )


def running_max(
    df: DataFrame, key: Sequence[str], page_col: str, order: Sequence[str], columns: dict[str, Column],
    size: int = BLOCK_SIZE,
) -> DataFrame:
    """Running maximum, current row included, of each expression over `key` in page order."""
    key = list(key)
    df = df.withColumn("_block", block_of(F.col(page_col), size))
    for name, expr in columns.items():
        df = df.withColumn(f"_v_{name}", expr)
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*key, "_block").agg(*[F.max(f"_v_{n}").alias(f"_b_{n}") for n in columns])
    carry = totals.select(*key, "_block", *[F.max(f"_b_{n}").over(before).alias(f"_c_{n}") for n in columns])
    inside = Window.partitionBy(*key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for name in columns:
        df = df.withColumn(f"_i_{name}", F.max(f"_v_{name}").over(inside))
    df = df.join(carry, [*key, "_block"])
    for name in columns:
        df = df.withColumn(name, F.greatest(f"_i_{name}", f"_c_{name}"))
    return df.drop("_block", *[f"_{p}_{n}" for n in columns for p in ("v", "i", "c")])


def following_value(
    df: DataFrame, key: Sequence[str], page_col: str, order: Sequence[str], value: str, name: str,
    size: int = BLOCK_SIZE,
) -> DataFrame:
    """`value` of the next row of the same `key`, in page order; null on the last row."""
    key = list(key)
    df = df.withColumn("_block", block_of(F.col(page_col), size))
    first = df.groupBy(*key, "_block").agg(F.min_by(value, F.struct(*order)).alias("_first"))
    across = Window.partitionBy(*key).orderBy("_block")
    heads = first.select(*key, "_block", F.lead("_first").over(across).alias("_next_head"))
    inside = Window.partitionBy(*key, "_block").orderBy(*order)
    return (
        df.withColumn("_lead", F.lead(value).over(inside))
        .withColumn("_last", F.lead(F.lit(1)).over(inside).isNull())
        .join(heads, [*key, "_block"])
        .withColumn(name, F.when(F.col("_last"), F.col("_next_head")).otherwise(F.col("_lead")))
        .drop("_block", "_lead", "_last", "_next_head")
    )


def first_rows(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First `n` rows of each key.  Spark keeps at most `n` rows per key in every map task before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def total_before(
    df: DataFrame, key: Sequence[str], page_col: str, order: Sequence[str], value: str, name: str, size: int = BLOCK_SIZE
) -> DataFrame:
    """Sum of `value` over the earlier rows of the same `key`, in page order; 0 on the first row."""
    key = list(key)
    df = df.withColumn("_block", block_of(F.col(page_col), size))
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*key, "_block").agg(F.sum(value).alias("_sum"))
    carry = sums.select(*key, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(carry, [*key, "_block"])
        .withColumn(name, (F.col("_carry") + F.col("_inside")).cast("long"))
        .drop("_block", "_inside", "_carry")
    )
