"""Human judgements of models: validation, win rates, head to head, criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
WINNERS = ("a", "b", "tie", "both_bad")
CRITERIA = ("correctness", "fluency", "helpfulness")


def valid_scores(scores: Column) -> Column:
    """Known criteria with whole numbers from 1 to 5; no scores are fine."""
    ok = F.forall(F.map_entries(scores), lambda e: F.coalesce(e.key.isin(*CRITERIA) & e.value.between(1, 5), F.lit(False)))
    return F.coalesce(ok, F.lit(True))


def valid(mode: str = "mode") -> Column:
    """Whether a rating is well formed: mode, winner, models and scores."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    compare = F.col("winner").isin(*WINNERS) & there("model_a") & there("model_b") & valid_scores(F.col("scores.a")) & valid_scores(F.col("scores.b"))
    chat = there("model") & valid_scores(F.col("chat_scores"))
    return F.coalesce(F.when(F.col(mode) == "compare", compare).when(F.col(mode) == "chat", chat), F.lit(False))


def sides(ratings: DataFrame) -> DataFrame:
    """One row per judged model: (model, category, seq, outcome, scores); outcome null in chats.

    Winners other than a, b and tie count as both_bad; a null category is 'custom'.
    """
    w = F.col("winner")
    outcome = lambda me, other: F.when(w == me, "win").when(w == other, "loss").when(w == "tie", "tie").otherwise("both_bad")
    row = lambda model, out, scores: F.struct(F.col(model).alias("model"), out.alias("outcome"), scores.alias("scores"))
    compare = F.array(row("model_a", outcome("a", "b"), F.col("scores.a")), row("model_b", outcome("b", "a"), F.col("scores.b")))
    chat = F.array(row("model", F.lit(None).cast("string"), F.col("chat_scores")))
    each = ratings.select(F.coalesce("category", F.lit("custom")).alias("category"), F.explode(F.when(F.col("mode") == "compare", compare).otherwise(chat)).alias("x"))
    return each.select("category", "x.*").where("model is not null")


def win_rate(n: Column, wins: Column, half: Column) -> Column:
    """(wins + half of ties and both_bad) / n; null without comparisons."""
    return F.when(n > 0, (wins + 0.5 * half) / n)


def summary(ratings: DataFrame) -> DataFrame:
    """Per model, overall (category null) and per category: comparisons, outcomes, win rate.

    Models judged only in chats are listed with no comparisons.
    """
    s = sides(ratings)
    c = lambda v: F.count_if(F.coalesce(F.col("outcome") == v, F.lit(False)))
    agg = s.groupingSets([["model"], ["model", "category"]], "model", "category").agg(
        F.count("outcome").alias("n"), c("win").alias("wins"), c("loss").alias("losses"), c("tie").alias("ties"), c("both_bad").alias("both_bad")
    )
    return agg.withColumn("win_rate", win_rate(F.col("n"), F.col("wins"), F.col("ties") + F.col("both_bad")))


def criterion_means(ratings: DataFrame) -> DataFrame:
    """(model, criterion, n, total, mean to 2 places); entries without a value don't count."""
    e = sides(ratings).select("model", F.explode("scores").alias("criterion", "score")).where("score is not null")
    return e.groupBy("model", "criterion").agg(F.count("*").alias("n"), F.sum("score").alias("total")).withColumn("mean", F.round(F.col("total") / F.col("n"), 2))


def ranking(ratings: DataFrame, first_seen: str) -> DataFrame:
    """Models by win rate, nulls last; ties in the order in which the models first appeared."""
    overall = summary(ratings).where("category is null")
    seen = ratings.select(F.col(first_seen).alias("seq"), F.explode(F.array("model_a", "model_b", "model")).alias("model")).where("model is not null").groupBy("model").agg(F.min("seq").alias("first_seq"))
    order = Window.orderBy(F.desc_nulls_last("win_rate"), F.asc_nulls_last("first_seq"), "model")  # one row per model
    return overall.join(seen, "model", "left").withColumn("rank_no", F.row_number().over(order)).select("rank_no", "model", "n", "wins", "losses", "ties", "both_bad", "win_rate")


def head_to_head(ratings: DataFrame) -> DataFrame:
    """Per unordered pair x < y: wins of each, and ties (tie and both_bad)."""
    c = ratings.where("mode = 'compare'")
    x, y = F.least("model_a", "model_b"), F.greatest("model_a", "model_b")
    winner = F.when(F.col("winner") == "a", F.col("model_a")).when(F.col("winner") == "b", F.col("model_b"))
    s = c.select(x.alias("x"), y.alias("y"), winner.alias("w"))
    eq = lambda k: F.count_if(F.coalesce(F.col("w") == F.col(k), F.lit(False)))
    return s.groupBy("x", "y").agg(eq("x").alias("x_wins"), eq("y").alias("y_wins"), F.count_if(F.col("w").isNull()).alias("ties"))


def counts(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.count("*").alias("total"), F.count_if(F.col("mode") == "compare").alias("compare"), F.count_if(F.col("mode") == "chat").alias("chat"))


def to_markdown(rows: list, columns: list[str]) -> str:
    """A small collected result as a Markdown table."""
    cell = lambda v: "–" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows])
