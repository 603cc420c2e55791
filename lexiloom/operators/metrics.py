"""Aggregated metrics of tokenizers, language models, benchmarks and training steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chars import sub
from ..functions.script import graphemes


def tokenizer_metrics(encoded: DataFrame, vocab_size: int | None = None) -> DataFrame:
    """encoded: (tokenizer, text_set, text, pieces array<string>, decoded).  One row per tokenizer and set.

    Counts come along with the ratios; denominators are at least 1.  Vocabulary use is a distinct count over exploded
    pieces, joined to the sums, so no plan expands all columns for the distinct.
    """
    from ..functions.chars import words

    sized = encoded.select(
        "tokenizer", "text_set", F.size("pieces").alias("tokens"), F.size(words("text")).alias("words"), F.length("text").alias("chars"),
        F.octet_length("text").alias("bytes"), graphemes("text").alias("graphemes"),
        F.size(F.filter("pieces", lambda p: p.rlike("^<0x[0-9A-Fa-f]{2}>$"))).alias("byte_tokens"), F.size(F.filter("pieces", lambda p: p == "<unk>")).alias("unk_tokens"),
        F.coalesce((F.col("decoded") == F.col("text")).cast("int"), F.lit(0)).alias("same"),
    )
    sums = sized.groupBy("tokenizer", "text_set").agg(F.count("*").alias("docs"), *[F.sum(c).alias(c) for c in ("tokens", "words", "chars", "bytes", "graphemes", "byte_tokens", "unk_tokens", "same")])
    used = encoded.select("tokenizer", "text_set", F.explode("pieces").alias("p")).groupBy("tokenizer", "text_set", "p").count().groupBy("tokenizer", "text_set").agg(F.count("*").alias("used"))
    r = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    out = sums.join(used, ["tokenizer", "text_set"], "left").withColumns({
        "used": F.coalesce("used", F.lit(0)), "fertility": r("tokens", "words"), "chars_per_token": r("chars", "tokens"), "bytes_per_token": r("bytes", "tokens"),
        "tokens_per_grapheme": r("tokens", "graphemes"), "byte_fallback_rate": r("byte_tokens", "tokens"), "unk_rate": r("unk_tokens", "tokens"), "round_trip_rate": r("same", "docs"),
    })
    return out.withColumn("vocab_use", F.col("used") / F.lit(vocab_size)) if vocab_size else out


def continued_words(encoded_words: DataFrame) -> DataFrame:
    """encoded_words: (tokenizer, text_set, word, n, tokens): words counted once; share of word occurrences in 2 or more tokens."""
    split = F.sum(F.when(F.col("tokens") >= 2, F.col("n")).otherwise(0))
    return encoded_words.groupBy("tokenizer", "text_set").agg(split.alias("continued"), F.sum("n").alias("words")).withColumn("continued_ratio", F.col("continued") / F.greatest("words", F.lit(1)))


def encoding_comparison(df: DataFrame, base: str, new: str, round_trip: str | None = None) -> DataFrame:
    """Token totals of two encodings (array columns), the reduction, and how often they are identical."""
    out = df.agg(
        F.sum(F.size(base)).alias("base_tokens"), F.sum(F.size(new)).alias("new_tokens"), F.count("*").alias("docs"),
        F.count_if(F.col(base) == F.col(new)).alias("identical"), *([F.count_if(F.col(round_trip)).alias("round_trips")] if round_trip else []),
    )
    return out.withColumn("reduction", 1 - F.col("new_tokens") / F.greatest("base_tokens", F.lit(1))).withColumn("identical_rate", F.col("identical") / F.greatest("docs", F.lit(1)))


def agreement(df: DataFrame, a: str, b: str, decoded: str, text: str) -> DataFrame:
    """Validation of a tokenizer against another: equal encodings, round trips, byte-fallback share."""
    fall = F.sum(F.size(F.filter(b, lambda p: p.rlike("^<0x[0-9A-Fa-f]{2}>$"))))
    n = F.greatest(F.count("*"), F.lit(1))
    return df.agg(F.count("*").alias("n_texts"), (F.count_if(F.col(a) == F.col(b)) / n).alias("agreement"), (F.count_if(F.col(decoded) == F.col(text)) / n).alias("round_trip"), (fall / F.greatest(F.sum(F.size(b)), F.lit(1))).alias("byte_fallback_rate"))


def likelihood_metrics(df: DataFrame, group_col: str, nll: str = "nll", tokens: str = "tokens", nbytes: str = "bytes", chars: str = "chars", words: str = "words") -> DataFrame:
    """Bits per byte and character, token and word perplexity (exponent at most 50) from summed negative log likelihoods."""
    s = df.groupBy(group_col).agg(F.count("*").alias("docs"), *[F.sum(c).alias(n) for c, n in ((nll, "nll"), (tokens, "tokens"), (nbytes, "bytes"), (chars, "chars"), (words, "words"))])
    ln2 = F.log(F.lit(2.0))
    per = lambda c: F.col("nll") / F.greatest(F.col(c), F.lit(1))
    return s.withColumns({"bits_per_byte": per("bytes") / ln2, "bits_per_char": per("chars") / ln2, "token_perplexity": F.exp(F.least(per("tokens"), F.lit(50.0))), "word_perplexity": F.exp(F.least(per("words"), F.lit(50.0)))})


def choice_accuracy(scores: DataFrame, item_col: str = "item_id", category_col: str = "category") -> DataFrame:
    """scores: (item, category, choice, label, logprob, bytes), one row per choice.

    The best choice by log probability, and by log probability per byte; the first wins ties.  One row per category and
    one for all (category null stands for items without one; ``total`` tells the overall row apart).
    """
    norm = F.col("logprob") / F.greatest(F.col("bytes"), F.lit(1))
    best = scores.groupBy(item_col).agg(
        F.first(category_col).alias("category"), F.first("label").alias("label"),
        F.max_by("choice", F.struct("logprob", -F.col("choice"))).alias("pick"), F.max_by("choice", F.struct(norm, -F.col("choice"))).alias("pick_norm"),
    )
    hits = best.select("category", (F.col("pick") == F.col("label")).cast("int").alias("hit"), (F.col("pick_norm") == F.col("label")).cast("int").alias("hit_norm"))
    out = hits.rollup("category").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.sum("hit_norm").alias("hits_norm"), F.grouping("category").alias("total"))
    return out.where("total = 1 or category is not null").withColumn("acc", F.col("hits") / F.col("n")).withColumn("acc_norm", F.col("hits_norm") / F.col("n"))


def group_advantages(df: DataFrame, group_col: str, reward_col: str, epsilon: float = 1e-4, least: float = 1e-6) -> DataFrame:
    """df with mean, population std, advantage = (reward - mean) / (std + epsilon), and whether the group is skipped as flat.

    Moments are merged sums of squares about the mean, combined before the shuffle; rows of a hot group meet its one row
    of moments in a join that can be split.  A null group is a group.
    """
    stats = df.groupBy(F.col(group_col).alias("_g")).agg(F.avg(reward_col).alias("group_mean"), F.stddev_pop(reward_col).alias("group_std"))
    out = df.join(stats, F.col(group_col).eqNullSafe(F.col("_g")), "left").drop("_g")
    return out.withColumn("skipped", F.col("group_std") < least).withColumn("advantage", (F.col(reward_col) - F.col("group_mean")) / (F.col("group_std") + epsilon))


def step_means(df: DataFrame, step_col: str, metric_col: str, value_col: str) -> DataFrame:
    return df.groupBy(step_col, metric_col).agg(F.count(value_col).alias("n"), F.avg(value_col).alias("mean"))


def cloze_items(df: DataFrame, context: str = "context", choices: str = "choices", label: str = "label", category: str = "category") -> DataFrame:
    return df.select(F.col(context).alias("context"), F.col(choices).alias("choices"), F.col(label).alias("label"), F.col(category).alias("category"))


def copa_items(df: DataFrame, cause: str = " ஏனென்றால்", effect: str = " எனவே") -> DataFrame:
    """(context, choices, label, category) from premise, question, choice1, choice2, label."""
    bare = sub("premise", r"[\x{964}. ]+$")
    link = F.when(F.col("question") == "cause", F.lit(cause)).otherwise(F.lit(effect))
    return df.select(F.concat(bare, link).alias("context"), F.array(F.concat(F.lit(" "), "choice1"), F.concat(F.lit(" "), "choice2")).alias("choices"), F.col("label").cast("int").alias("label"), F.col("question").alias("category"))


def sentiment_items(df: DataFrame, text: str, label: str, labels: dict[str, str], prompt: str = "{text}\nஇந்த விமர்சனம்") -> DataFrame:
    """Rows with an unknown label are dropped; the label is its place in the map."""
    names = F.array(*[F.lit(k) for k in labels])
    before, after = prompt.split("{text}", 1)
    rows = df.where(F.col(label).isin(*labels))
    return rows.select(F.concat(F.lit(before), F.col(text), F.lit(after)).alias("context"), F.array(*[F.lit(v) for v in labels.values()]).alias("choices"), (F.array_position(names, F.col(label)) - 1).cast("int").alias("label"), F.lit(None).cast("string").alias("category"))


def text_sets(df: DataFrame, set_of: dict[str, list[str]], category_col: str, order_col: str, text_col: str, max_chars: int, max_docs: int) -> DataFrame:
    """Named evaluation sets of categories: texts cut to max_chars, the first max_docs of a set in order (a sampling operator)."""
    pairs = df.sparkSession.createDataFrame([(s, c) for s, cs in set_of.items() for c in cs], "text_set string, _c string")
    rows = df.join(F.broadcast(pairs), F.col(category_col) == F.col("_c")).select("text_set", F.col(order_col), F.substring(text_col, 1, max_chars).alias("text"))
    n = F.row_number().over(Window.partitionBy("text_set").orderBy(order_col))
    return rows.withColumn("_n", n).where(F.col("_n") <= max_docs).drop("_n")


def sample_texts(df: DataFrame, category_col: str, split_col: str, order_col: str, text_col: str, n: int, max_chars: int = 3000) -> DataFrame:
    """First n texts of each category from its eval split, from train where it has none."""
    held = df.where(F.col(split_col) == "eval")
    rest = df.where(F.col(split_col) == "train").join(held.select(category_col).distinct(), category_col, "left_anti")
    rows = held.unionByName(rest.select(*held.columns)).select(F.col(category_col), F.col(order_col), F.substring(text_col, 1, max_chars).alias("text"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(category_col).orderBy(order_col))).where(F.col("_n") <= n).drop("_n")


