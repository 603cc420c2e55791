"""Preference pairs: a prompt, the better and the worse answer."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import as_col, strip
from .chat import byte_ids, encode, messages_of, remap, turn
from .dedup import first_of_value
from .split import fraction_split


def _prompt(prompt: str | Column, kind: str) -> Column:
    """A text is one user turn, a conversation stays as it is; null where there is none."""
    c = as_col(prompt)
    if kind.startswith("array"):
        return F.when(F.size(c) > 0, F.transform(c, lambda t: F.struct(t.role.alias("role"), t.content.alias("content"))))
    return F.when(F.coalesce(c, F.lit("")) != "", F.array(turn("user", c)))


def pair(prompt: str | Column, chosen: str | Column, rejected: str | Column, kind: str = "string") -> Column:
    """struct<messages, chosen, rejected>, as they are; null unless all are there and the answers differ."""
    m, c, r = _prompt(prompt, kind), as_col(chosen).cast("string"), as_col(rejected).cast("string")
    ok = m.isNotNull() & (F.coalesce(c, F.lit("")) != "") & (F.coalesce(r, F.lit("")) != "") & (c != r)
    return F.when(ok, F.struct(m.alias("messages"), c.alias("chosen"), r.alias("rejected")))


def pair_of_rating(winner: str | Column, prompt: str | Column, response_a: str | Column, response_b: str | Column) -> Column:
    """Decided comparisons only: the winner's response is chosen; responses are stripped, and differ then."""
    w, a, b = as_col(winner), as_col(response_a), as_col(response_b)
    there = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & (F.coalesce(as_col(prompt), F.lit("")) != "") & (strip(a) != strip(b))
    made = lambda c, r: F.struct(F.array(turn("user", as_col(prompt))).alias("messages"), strip(c).alias("chosen"), strip(r).alias("rejected"))
    return F.when(there & (w == "a"), made(a, b)).when(there & (w == "b"), made(b, a))


def generation_key(messages: str | Column) -> Column:
    return F.md5(F.to_json(as_col(messages)))


def missing_generations(prompts: DataFrame, cache: DataFrame, messages_col: str = "messages") -> DataFrame:
    """(key, messages): the distinct prompts that the cache (key, text) has no answer to, for a model to answer."""
    keyed = prompts.select(generation_key(messages_col).alias("key"), F.col(messages_col).alias("messages"))
    return keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.first("messages").alias("messages"))


def append_generations(made: DataFrame, path: str) -> None:
    """New answers (key, text) behind those in the cache, a JSON lines folder."""
    made.select("key", "text").write.mode("append").json(path)


def generated_pairs(df: DataFrame, cache: DataFrame, messages_col: str = "messages") -> DataFrame:
    """(messages, chosen, rejected): a dataset's last answer against a model's answer to what comes before it, from the
    cache (key, text); prompts without an answer, or with the same one, are left out."""
    m = F.col(messages_col)
    rows = df.where((F.size(m) > 1) & (F.get(m, F.size(m) - 1).role == "assistant")).select(F.slice(m, 1, F.size(m) - 1).alias("messages"), F.get(m, F.size(m) - 1).content.alias("chosen"))
    met = rows.withColumn("key", generation_key("messages")).join(cache.dropDuplicates(["key"]), "key")
    return met.where("text <> ''").where(strip("text") != strip("chosen")).select("messages", "chosen", F.col("text").alias("rejected"))


def pairs_of(df: DataFrame, src: Mapping, cache: DataFrame | None = None) -> DataFrame:
    """(messages, chosen, rejected) of one source, by its ``format``: pairs, ratings or self_generated."""
    kind, fields = src.get("format", "pairs"), src.get("fields") or {}
    if kind == "pairs":
        rows = remap(df, fields, ("prompt", "chosen", "rejected"))
        return rows.select(pair("prompt", "chosen", "rejected", dict(rows.dtypes)["prompt"]).alias("p")).where("p is not null").select("p.*")
    if kind == "ratings":
        rows = df.where("mode = 'compare'").select(pair_of_rating("winner", "prompt", "response_a", "response_b").alias("p"))
        return rows.where("p is not null").select("p.*")
    if kind == "self_generated":
        if cache is None:
            raise ValueError("self_generated pairs need a table of generations")
        return generated_pairs(messages_of(df, {**src, "format": src.get("sft_format", "alpaca")}).where("messages is not null"), cache)
    raise ValueError(f"unknown preference format {kind!r}")


def pairs_of_sources(sources: Sequence[Mapping], load, cache: DataFrame | None = None, log=print) -> DataFrame | None:
    """(messages, chosen, rejected, source) of all enabled sources; one that fails is reported and left out unless
    required.  None if no source gives rows."""
    from ..sources.readers import each_source

    out = None
    for _, src, rows in each_source(sources, lambda s: pairs_of(load(s), s, cache), log):
        made = rows.withColumn("source", F.lit(src["name"]))
        out = made if out is None else out.union(made)
    return out


def deduplicated(df: DataFrame, order_col: str, pair_col: str = "pair") -> DataFrame:
    return first_of_value(df, F.to_json(F.col(pair_col)), order_col)


def split_pairs(df: DataFrame, fraction: float, pair_col: str = "pair") -> DataFrame:
    return fraction_split(df, F.to_json(F.col(pair_col)), fraction, "pref:")


def encoded(df: DataFrame, max_len: int, pair_col: str = "pair", tokenize=byte_ids) -> DataFrame:
    """Both sides encoded; rows where one does not encode are dropped."""
    p = F.col(pair_col)
    side = lambda name: encode(F.concat(p.messages, F.array(turn("assistant", p[name]))), max_len, tokenize=tokenize)
    both = df.withColumn("_c", side("chosen")).withColumn("_r", side("rejected")).where("_c.input_ids is not null and _r.input_ids is not null")
    out = [F.col(f"_{k}.{v}").alias(f"{n}_{v}") for k, n in (("c", "chosen"), ("r", "rejected")) for v in ("input_ids", "labels")]
    return both.select(*[c for c in df.columns], *out)
