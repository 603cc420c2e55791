"""Token-weighted mixtures: plan, selection, sample budgets."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .split import seeded_order

RANGES = 1 << 12


def token_totals(df: DataFrame, category_col: str, tokens_col: str) -> DataFrame:
    return df.groupBy(category_col).agg(F.sum(tokens_col).cast("bigint").alias("available_tokens"), F.count("*").alias("docs"))


def compute_plan(available: Mapping[str, int], weights: Mapping[str, float], budget: int | None = None, anchor: str | None = None, anchor_epochs: float = 1.0, max_epochs: Mapping[str, float] | float = 4.0) -> dict[str, dict[str, float]]:
    """Per category: normalised weight, available and target tokens, epochs.

    Categories without weight or tokens are dropped and the rest renormalised; none left raises.  Without a budget the
    anchor (default: the largest weight) is used ``anchor_epochs`` times and sets it.  A target never exceeds the
    category's cap on epochs.  Rounding is half to even.
    """
    live = {c: w for c, w in weights.items() if w > 0 and available.get(c, 0) > 0}
    if not live:
        raise ValueError("no category has both weight and tokens")
    total = sum(live.values())
    shares = {c: w / total for c, w in live.items()}
    if budget is None:
        anchor = anchor or max(shares, key=lambda c: shares[c])
        if anchor not in shares:
            raise ValueError(f"anchor {anchor!r} has no tokens or weight")
        budget = round(available[anchor] * anchor_epochs / shares[anchor])
    cap = (lambda c: max_epochs.get(c, 4.0)) if isinstance(max_epochs, Mapping) else (lambda c: max_epochs)
    plan = {}
    for c, w in shares.items():
        target = min(round(w * budget), round(available[c] * cap(c)))
        plan[c] = {"weight": w, "available_tokens": available[c], "target_tokens": target, "epochs": target / available[c]}
    return plan


def plan_table(totals: DataFrame, weights: Mapping[str, float], max_epochs: float = 4.0, anchor_epochs: float = 1.0) -> DataFrame:
    """The same plan as a DataFrame, for totals with any number of categories; the anchor is the largest weight."""
    spark = totals.sparkSession
    w = spark.createDataFrame([(c, float(x)) for c, x in weights.items() if x > 0], "category string, w double")
    live = totals.join(F.broadcast(w), "category").where("available_tokens > 0")  # w: one row per configured category
    shares = live.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0))))
    anchor = shares.agg(F.max_by(F.struct("available_tokens", "weight"), F.struct("w", F.col("category"))).alias("a")).select(F.bround(F.col("a.available_tokens") * F.lit(anchor_epochs) / F.col("a.weight"), 0).alias("budget"))
    both = shares.crossJoin(F.broadcast(anchor))  # one row
    target = F.least(F.bround(F.col("weight") * F.col("budget"), 0), F.bround(F.col("available_tokens") * F.lit(max_epochs), 0)).cast("bigint")
    return both.select("category", "weight", "available_tokens", target.alias("target_tokens"))


def running_before(df: DataFrame, group_col: str, order_cols: list[str], value_col: str, hash_col: str) -> DataFrame:
    """df with ``before``: sum of the values of earlier rows of the group, rows ordered by (hash_col, *order_cols).

    hash_col is a hex digest.  Sums are taken in two phases, over ranges of the digest and inside a range, so a group of
    any size is spread over many tasks.
    """
    cut = df.withColumn("_r", F.substring(hash_col, 1, 3))
    totals = cut.groupBy(group_col, "_r").agg(F.sum(value_col).alias("_t"))
    ahead = F.sum("_t").over(Window.partitionBy(group_col).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(group_col, "_r", F.coalesce(ahead, F.lit(0)).alias("_o"))
    inside = F.sum(value_col).over(Window.partitionBy(group_col, "_r").orderBy(hash_col, *order_cols).rowsBetween(Window.unboundedPreceding, -1))
    placed = cut.withColumn("_i", F.coalesce(inside, F.lit(0)))
    return placed.join(offsets, [group_col, "_r"]).withColumn("before", (F.col("_o") + F.col("_i")).cast("bigint")).drop("_r", "_o", "_i")


def select_documents(df: DataFrame, plan: DataFrame, key_col: str, category_col: str, tokens_col: str, seed: int = 1) -> DataFrame:
    """Rows (key, category, tokens, copies): whole passes over a category, plus one more copy of the shuffled prefix up
    to and including the document whose running sum reaches the rest of the target."""
    totals = token_totals(df, category_col, tokens_col).select(F.col(category_col).alias("category"), F.col("available_tokens").alias("_total"))
    goal = plan.select("category", F.col("target_tokens").alias("_target")).join(totals, "category")
    hashed = df.select(F.col(key_col), F.col(category_col).alias("category"), F.col(tokens_col)).withColumn("_h", seeded_order(key_col, seed))
    run = running_before(hashed, "category", [key_col], tokens_col, "_h").join(goal, "category")
    whole = F.floor(F.col("_target") / F.col("_total"))
    rest = F.col("_target") - whole * F.col("_total")
    copies = (whole + F.when(F.col("before") < rest, 1).otherwise(0)).cast("int")
    return run.select(key_col, "category", tokens_col, copies.alias("copies")).where("copies > 0")


def repeat_rows(df: DataFrame, copies_col: str) -> DataFrame:
    """Each row as often as its copies say, numbered from 0."""
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col(copies_col) - 1))).drop(copies_col)


def char_budget_lines(df: DataFrame, category_col: str, order_col: str, text_col: str, weights: Mapping[str, float], total_chars: int, max_line_chars: int, seed: int = 1) -> DataFrame:
    """Lines for tokenizer training: per category whole documents in seeded order until its share of ``total_chars`` is
    reached (counted in what is put out), as stripped non-empty lines cut to ``max_line_chars``; weights are renormalised over present categories."""
    from ..functions.chars import strip

    spark = df.sparkSession
    w = spark.createDataFrame([(c, float(x)) for c, x in weights.items() if x > 0], "category string, w double")
    docs = df.select(F.col(order_col), F.col(category_col).alias("category"), F.coalesce(text_col, F.lit("")).alias("text"))
    present = docs.select("category").distinct().join(F.broadcast(w), "category")  # one row per configured category
    budgets = present.select("category", F.floor(F.lit(total_chars) * F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0)))).alias("budget"))
    sized = docs.withColumn("n", F.aggregate(F.split("text", "\n", -1), F.lit(0), lambda a, x: a + F.length(F.substring(strip(x), 1, max_line_chars)))).withColumn("_h", seeded_order(order_col, seed))
    kept = running_before(sized, "category", [order_col], "n", "_h").join(F.broadcast(budgets), "category").where("before < budget")
    exploded = kept.select(order_col, "category", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return exploded.select(order_col, "category", "line_no", F.substring(strip("line"), 1, max_line_chars).alias("line")).where("line <> ''")
