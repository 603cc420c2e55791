"""Rewards of a completion; null where a reward does not apply."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import as_col, bind, ratio, words
from ..functions.normalize import reward_tokens
from ..functions.script import script_stats
from .quality import grams, total_length


def occurrences(tokens: Column) -> Column:
    """Tokens numbered by their count so far: a multiset as a set."""
    return bind(F.array_sort(tokens), lambda s: F.transform(s, lambda x, i: F.concat_ws("\0", x, (i - F.array_position(s, x) + 1).cast("string"))))


def token_f1(pred: Column, gold: Column) -> Column:
    """Multiset overlap F1 of two token arrays; 0 where they share nothing."""
    common = F.size(F.array_intersect(occurrences(pred), occurrences(gold)))
    p, r = ratio(common, F.size(pred)), ratio(common, F.size(gold))
    return F.when(common == 0, 0.0).otherwise(2 * p * r / (p + r))


def with_tokens(df: DataFrame, **texts: str) -> DataFrame:
    """df with a token column for each named text column, for the rewards below."""
    return df.select("*", *[reward_tokens(c).alias(name) for name, c in texts.items()])


def given(reference: str | Column) -> Column:
    return F.coalesce(F.length(as_col(reference)), F.lit(0)) > 0


def reference_f1(pred: Column, gold: Column, reference: str | Column) -> Column:
    """Token F1 against the reference's tokens; null without a reference."""
    return F.when(given(reference), token_f1(pred, gold))


def contains_answer(pred: Column, gold: Column, reference: str | Column) -> Column:
    """1 if the reference's tokens, joined, are inside the completion's; null without a reference."""
    have, want = F.array_join(pred, " "), F.array_join(gold, " ")
    return F.when(given(reference), ((want != "") & F.contains(have, want)).cast("double"))


def tamil_script(completion: str | Column, prompt: str | Column) -> Column:
    """Share of Tamil letters, for prompts that are at least half Tamil."""
    return F.when(script_stats(prompt).tamil_ratio >= 0.5, script_stats(completion).tamil_ratio)


def no_repetition(w: Column, n: int = 4) -> Column:
    """1 minus the share of characters in tokens of repeated n-grams; 1 for fewer than n tokens."""

    def repeated(g: Column) -> Column:
        """Places of grams that occur more than once: sorted with their places, equal grams are neighbours."""
        placed = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        like = lambda s, e, i: F.coalesce(F.get(s, i + 1).x == e.x, F.lit(False)) | ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0))).x == e.x))
        return bind(placed, lambda s: F.transform(F.filter(s, lambda e, i: like(s, e, i)), lambda e: e.i))

    covered = F.array_distinct(F.flatten(F.transform(bind(grams(w, n), repeated), lambda at: F.sequence(at, at + n - 1))))
    chars = F.aggregate(covered, F.lit(0), lambda a, at: a + F.length(F.get(w, at)))
    return F.when(F.size(w) < n, 1.0).otherwise(1.0 - ratio(chars, total_length(w)))


def length(completion: str | Column, low: int = 2, high: int = 120) -> Column:
    """Words up to ``low`` count in proportion; beyond ``high`` the reward falls to 0 at twice that."""
    n = F.size(words(completion)).cast("double")
    return F.when(n < low, n / low).when(n > high, F.greatest(F.lit(0.0), 1.0 - (n - high) / high)).otherwise(1.0)


REWARDS = ("reference_f1", "contains_answer", "tamil_script", "no_repetition", "length")


def combined(df: DataFrame, weights: Mapping[str, float], completion: str, prompt: str, reference: str) -> DataFrame:
    """df with ``reward``, the weighted sum of the rewards that apply, and ``parts``, the map of them.

    A reward of weight 0 is skipped, an unknown name raises.
    """
    for name in weights:
        if name not in REWARDS:
            raise KeyError(f"unknown reward {name!r}")
    pred, gold = F.col("_pred"), F.col("_gold")
    made = {
        "reference_f1": lambda: reference_f1(pred, gold, reference), "contains_answer": lambda: contains_answer(pred, gold, reference),
        "tamil_script": lambda: tamil_script(completion, prompt), "no_repetition": lambda: no_repetition(pred), "length": lambda: length(completion),
    }
    live = {k: made[k]() for k, w in weights.items() if w}
    tokens = with_tokens(df, _pred=completion, _gold=reference)
    parts = F.map_filter(F.create_map(*[x for k, v in live.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull()) if live else F.create_map().cast("map<string,double>")
    scored = tokens.withColumn("parts", parts).drop("_pred", "_gold")
    total = sum((F.coalesce(F.try_element_at("parts", F.lit(k)) * float(weights[k]), F.lit(0.0)) for k in live), F.lit(0.0))
    return scored.withColumn("reward", total)
