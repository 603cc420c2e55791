"""Hash-based train and eval splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chars import as_col

RANGES = 1024


def stable_fraction(key: str | Column, salt: str = "") -> Column:
    """Position of a key in [0, 1), the same on every engine: the first 32 bits of md5(salt + key)."""
    digest = F.md5(F.concat(F.lit(salt), as_col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def capped_split(df: DataFrame, key_col: str, category_col: str, order_col: str, fraction: float, cap: int, salt: str = "split:") -> DataFrame:
    """df with ``split_name``: eval below the fraction, for the first ``cap`` candidates of a category in order; else train.

    Only candidates are ranked, and only until the cap: each range of the order key is counted first, so a category of
    any size is ranked in pieces.
    """
    marked = df.withColumn("_cand", stable_fraction(key_col, salt) < fraction)
    ranked = rank_within(marked.where("_cand").select(order_col, category_col), category_col, order_col)
    chosen = ranked.where(F.col("rank") <= cap).select(order_col, F.lit(True).alias("_eval"))
    joined = marked.join(chosen, order_col, "left")
    return joined.withColumn("split_name", F.when(F.col("_eval"), "eval").otherwise("train")).drop("_cand", "_eval")


def rank_within(df: DataFrame, group_col: str, order_col: str) -> DataFrame:
    """df with ``rank``: 1-based position in the group by the order column; groups are spread over order ranges."""
    bounds = df.agg(F.min(order_col).cast("double").alias("lo"), F.max(order_col).cast("double").alias("hi")).first()
    lo, hi = bounds.lo or 0.0, bounds.hi or 0.0
    width = max((hi - lo) / RANGES, 1e-9)
    cut = df.withColumn("_r", F.floor((F.col(order_col).cast("double") - lo) / width))
    sizes = cut.groupBy(group_col, "_r").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("n").over(Window.partitionBy(group_col).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = cut.withColumnRenamed(group_col, "_g").join(before.withColumnRenamed("_r", "_r2"), F.col("_g").eqNullSafe(F.col(group_col)) & (F.col("_r") == F.col("_r2")))
    inside = F.row_number().over(Window.partitionBy("_g", "_r").orderBy(order_col))
    return placed.withColumn("rank", inside + F.col("_b")).drop("_g", "_r", "_r2", "_b")


def fraction_split(df: DataFrame, key: str | Column, fraction: float, salt: str = "split:") -> DataFrame:
    return df.withColumn("split_name", F.when(stable_fraction(key, salt) < fraction, "eval").otherwise("train"))


def with_fallback(df: DataFrame, order_col: str, share: float) -> tuple[DataFrame, DataFrame]:
    """(train, eval); without eval rows the first ``share`` of the training rows serve, and stay in training."""
    train, held = df.where("split_name = 'train'"), df.where("split_name = 'eval'")
    if held.limit(1).count():
        return train, held
    return train, train.orderBy(order_col).limit(max(1, int(train.count() * share)))


def seeded_order(key: str | Column, seed: int) -> Column:
    """Sort key of a reproducible shuffle that does not depend on partitions."""
    return F.md5(F.concat(F.lit(f"{seed}:"), as_col(key).cast("string")))


def seeded_sample(df: DataFrame, key_col: str, seed: int, n: int) -> DataFrame:
    """The first n rows of the seeded shuffle: a sampling operator, computed as a distributed top-n."""
    return df.orderBy(seeded_order(key_col, seed), key_col).limit(n)
