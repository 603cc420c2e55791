"""Token streams cut into blocks of one length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import as_col
from .mixture import running_before
from .split import seeded_order

BOS, EOS = 256, 257


def byte_tokens(c: str | Column) -> Column:
    """UTF-8 bytes of a text as token ids: the tokenizer that needs no vocabulary."""

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: list((t or "").encode("utf-8")))

    return run(as_col(c))


def byte_count(c: str | Column) -> Column:
    return F.octet_length(F.coalesce(as_col(c), F.lit("")))


def tokenized(df: DataFrame, key_col: str, text_col: str, bos: bool = False, eos: bool = True, tokenizer=byte_tokens) -> DataFrame:
    """(key, input_ids, n_tokens); any function from a text column to an array of ids is a tokenizer."""
    ids = tokenizer(text_col)
    if bos:
        ids = F.concat(F.array(F.lit(BOS)), ids)
    if eos:
        ids = F.concat(ids, F.array(F.lit(EOS)))
    return df.select(key_col, ids.alias("input_ids")).withColumn("n_tokens", F.size("input_ids"))


def block_spans(df: DataFrame, key_col: str, tokens_col: str, seq_len: int, seed: int = 1) -> DataFrame:
    """(block, key, from_token, n, at): which part of each document goes where in which full block.

    Documents follow each other in seeded order; offsets come from two-phase prefix sums; the unfilled last block is
    dropped.  Spans say all about the packing without moving one token.
    """
    base = df.select(F.col(key_col), F.col(tokens_col).cast("bigint").alias("n"), F.lit(0).alias("_g")).where("n > 0").withColumn("_h", seeded_order(key_col, seed))
    placed = running_before(base, "_g", [key_col], "n", "_h").select(key_col, "n", F.col("before").alias("start"))
    last = F.floor((F.col("start") + F.col("n") - 1) / seq_len)
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / seq_len), last)))
    lo = F.greatest(F.col("start"), F.col("block") * seq_len)
    hi = F.least(F.col("start") + F.col("n"), (F.col("block") + 1) * seq_len)
    spans = cut.select("block", key_col, (lo - F.col("start")).alias("from_token"), (hi - lo).alias("n"), (lo - F.col("block") * seq_len).alias("at"))
    whole = placed.agg(F.floor(F.coalesce(F.sum("n"), F.lit(0)) / seq_len).alias("_blocks"))
    return spans.crossJoin(F.broadcast(whole)).where("block < _blocks").drop("_blocks")  # one row


def pack(tokens: DataFrame, key_col: str, seq_len: int, seed: int = 1) -> DataFrame:
    """(block, input_ids): every block has exactly seq_len ids."""
    return gathered(block_spans(tokens, key_col, "n_tokens", seq_len, seed), tokens, key_col)


def gathered(spans: DataFrame, tokens: DataFrame, key_col: str) -> DataFrame:
    """(block, input_ids) of the spans."""
    parts = spans.join(tokens.select(key_col, "input_ids"), key_col).select("block", "at", F.slice("input_ids", F.col("from_token").cast("int") + 1, F.col("n").cast("int")).alias("part"))
    # A block gathers at most seq_len ids.
    joined = parts.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p"))
    return joined.select("block", F.flatten(F.transform("p", lambda x: x.part)).alias("input_ids"))


def shuffled_blocks(blocks: DataFrame, id_col: str = "block", seed: int = 1) -> DataFrame:
    return blocks.orderBy(seeded_order(id_col, seed), id_col)


def eval_blocks(blocks: DataFrame, max_blocks: int, seed: int = 1, id_col: str = "block") -> DataFrame:
    """A seeded sample of at most max_blocks blocks."""
    return shuffled_blocks(blocks, id_col, seed).limit(max_blocks)


def eval_sets(tokens: DataFrame, sets: dict[str, list[str]], key_col: str, category_col: str, seq_len: int, max_blocks: int = 500, seed: int = 1, log=print) -> dict[str, DataFrame]:
    """Named sets of packed blocks, each from the union of its categories: (block, input_ids), at most ``max_blocks`` by
    seeded sample.  A set without documents, or shorter than one block, is reported and left out.
    tokens: (key, category, input_ids, n_tokens)."""
    out = {}
    for name, categories in sets.items():
        own = tokens.where(F.col(category_col).isin(*categories))
        spans = block_spans(own, key_col, "n_tokens", seq_len, seed)
        chosen = eval_blocks(spans.select("block").distinct(), max_blocks, seed).select("block")
        if not chosen.limit(1).count():
            log(f"set {name} is shorter than one block of {seq_len}")
            continue
        out[name] = gathered(spans.join(chosen, "block", "left_semi"), own, key_col)
    return out


def sliding_spans(n_tokens: str | Column, max_len: int, stride: int) -> Column:
    """Windows over a token sequence, array<struct<start, end, first_scored>>: every token but the first is scored once."""
    n = as_col(n_tokens)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - max_len) / stride), F.lit(0)) * stride, F.lit(stride))
    span = lambda s: F.struct(s.alias("start"), F.least(s + max_len, n).alias("end"), F.when(s == 0, F.lit(1)).otherwise(s - stride + max_len).alias("first_scored"))
    return F.when(n >= 2, F.transform(starts, span)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,first_scored:bigint>>"))
