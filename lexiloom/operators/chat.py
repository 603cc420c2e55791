"""Instruction, question-answer and chat rows as one conversation model: array<struct<role, content>>."""

from __future__ import annotations

from typing import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import WS, as_col, literal, strip, sub

TURN = "struct<role:string,content:string>"
IGNORE = -100
# Role names and what they stand for, the default question template and answer.
ROLES = {"user": "user", "human": "user", "prompter": "user", "assistant": "assistant", "gpt": "assistant", "model": "assistant", "bot": "assistant", "system": "system"}
QA_TEMPLATE = "கீழே உள்ள பத்தியைப் படித்து கேள்விக்குப் பதில் அளிக்கவும்.\n\nபத்தி: {context}\n\nகேள்வி: {question}"
UNANSWERABLE = "இந்தப் பத்தியில் இந்தக் கேள்விக்கான பதில் இல்லை."
OPEN_USER, OPEN_MODEL, CLOSE = "<start_of_turn>user\n", "<start_of_turn>model\n", "<end_of_turn>"


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def remap(df: DataFrame, names: Mapping[str, str], wanted: Sequence[str]) -> DataFrame:
    """Columns under their canonical names; an absent one is an empty string."""
    have = set(df.columns)
    source = {w: names.get(w, w) for w in wanted}
    rest = [c for c in df.columns if c not in source.values() and c not in wanted]
    return df.select(*[f"`{c}`" for c in rest], *[(F.col(f"`{c}`") if c in have else F.lit("")).alias(w) for w, c in source.items()])


def text_of(c: str | Column) -> Column:
    return strip(F.coalesce(as_col(c), F.lit("")))


def alpaca(instruction: str | Column, input_: str | Column, output: str | Column) -> Column:
    """Messages, or null without instruction or output; an input follows after a blank line."""
    i, x, o = text_of(instruction), text_of(input_), text_of(output)
    ask = F.when(x == "", i).otherwise(F.concat(i, F.lit("\n\n"), x))
    return F.when((i != "") & (o != ""), F.array(turn("user", ask), turn("assistant", o)))


def prompt_response(prompt: str | Column, response: str | Column) -> Column:
    p, r = text_of(prompt), text_of(response)
    return F.when((p != "") & (r != ""), F.array(turn("user", p), turn("assistant", r)))


def strip_prefix(c: str | Column, prefixes: Sequence[str]) -> Column:
    """Left-stripped text without the first prefix of the list that it starts with, left-stripped again."""
    t = sub(c, f"^[{WS}]+")
    return sub(t, "^(?:" + "|".join(literal(p) for p in prefixes) + f")[{WS}]*") if prefixes else t


def question_answer(context: str | Column, question: str | Column, answer: str | Column, template: str = QA_TEMPLATE, unanswerable: str | None = UNANSWERABLE, prefixes: Sequence[str] = ()) -> Column:
    """Context and question are required; a missing answer becomes ``unanswerable``, or drops the row if that is None."""
    c, q, a = text_of(strip_prefix(F.coalesce(as_col(context), F.lit("")), prefixes)), text_of(question), text_of(answer)
    # One pass over the template, so a brace in the context is not taken for the question's place.
    before, rest = template.split("{context}", 1)
    middle, after = rest.split("{question}", 1)
    ask = F.concat(F.lit(before), c, F.lit(middle), q, F.lit(after))
    reply = F.when(a != "", a).otherwise(F.lit(unanswerable))
    return F.when((c != "") & (q != "") & reply.isNotNull(), F.array(turn("user", ask), turn("assistant", reply)))


def conversation(turns: str | Column, role_field: str = "role", content_field: str = "content") -> Column:
    """Known roles under their canonical names, blank and unknown turns dropped; null without an assistant turn."""
    table = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    mapped = F.transform(as_col(turns), lambda t: F.struct(F.try_element_at(table, F.lower(t[role_field])).alias("role"), text_of(t[content_field]).alias("content")))
    kept = F.filter(mapped, lambda t: t.role.isNotNull() & (t.content != ""))
    return F.when(F.exists(kept, lambda t: t.role == "assistant"), kept)


def conversations(df: DataFrame, messages: Column, source: str, normalizer=None, system_prompt: str | None = None) -> DataFrame:
    """df's rows that give messages: each turn normalised, a system prompt put in front where there is none."""
    rows = df.withColumn("messages", messages).where("messages is not null")
    if normalizer is not None:
        # Normalising may need Arrow functions, which take columns: turns are taken apart and put together again.
        key = F.monotonically_increasing_id()
        apart = rows.withColumn("_row", key).select("*", F.posexplode("messages").alias("_at", "_turn"))
        clean = apart.withColumn("_turn", F.struct(F.col("_turn.role").alias("role"), normalizer(F.col("_turn.content")).alias("content")))
        cols = [c for c in rows.columns if c != "messages"]
        grouped = clean.groupBy("_row").agg(*[F.first(c).alias(c) for c in cols], F.array_sort(F.collect_list(F.struct("_at", "_turn"))).alias("_t"))
        rows = grouped.select(*cols, F.filter(F.transform("_t", lambda x: x._turn), lambda t: t.content != "").alias("messages")).where(F.exists("messages", lambda t: t.role == "assistant"))
    if system_prompt:
        has = F.get("messages", F.lit(0)).role == "system"
        rows = rows.withColumn("messages", F.when(has, F.col("messages")).otherwise(F.concat(F.array(turn("system", F.lit(system_prompt))), "messages")))
    return rows.withColumn("source", F.lit(source))


# Formats of instruction data and their fields.
FORMATS = {"alpaca": ("instruction", "input", "output"), "prompt_response": ("prompt", "response"), "qa": ("context", "question", "answer"), "messages": ("messages",), "sharegpt": ("conversations",)}


def messages_of(df: DataFrame, src: Mapping) -> DataFrame:
    """df's rows as (messages), null where a row gives none, by the source's ``format`` and ``fields``."""
    kind = src.get("format", "alpaca")
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    rows = remap(df, src.get("fields") or {}, FORMATS[kind])
    if kind == "alpaca":
        made = alpaca("instruction", "input", "output")
    elif kind == "prompt_response":
        made = prompt_response("prompt", "response")
    elif kind == "qa":
        made = question_answer("context", "question", "answer", src.get("qa_template", QA_TEMPLATE), src.get("unanswerable_response", UNANSWERABLE) or None, src.get("strip_prefixes") or ())
    else:
        field = FORMATS[kind][0]
        if dict(rows.dtypes)[field] == "string":  # the field is absent
            made = F.lit(None).cast(f"array<{TURN}>")
        else:
            made = conversation(field, *(("role", "content") if kind == "messages" else ("from", "value")))
    return rows.select(made.alias("messages"))


def conversations_of(sources: Sequence[Mapping], load, normalizer=None, system_prompt: str | None = None, log=print) -> DataFrame | None:
    """(messages, source) of all enabled sources; one that fails is reported and left out unless required.

    A source may have its own ``system_prompt``.  None if no source gives rows.
    """
    from ..sources.readers import each_source

    out = None
    for _, src, rows in each_source(sources, lambda s: messages_of(load(s), s), log):
        made = conversations(rows, F.col("messages"), src["name"], normalizer, src.get("system_prompt", system_prompt)).select("messages", "source")
        out = made if out is None else out.union(made)
    return out


def segments(messages: str | Column) -> Column:
    """array<struct<text, trainable>>: the rendered conversation in pieces, trainable where the assistant speaks.

    A leading system turn is put before the first user turn's text; other system turns are not rendered.
    """
    m = as_col(messages)
    lead = F.get(m, F.lit(0))
    has = F.coalesce(lead.role == "system", F.lit(False))
    prefix = F.when(has, F.concat(strip(lead.content), F.lit("\n\n"))).otherwise(F.lit(""))
    rest = F.when(has, F.slice(m, 2, F.greatest(F.size(m), F.lit(1)))).otherwise(m)
    users = F.transform(rest, lambda t, i: F.when(t.role == "user", i))
    first = F.array_min(users)

    def piece(text: Column, on: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(on).alias("trainable"))

    def render(t: Column, i: Column) -> Column:
        content = strip(t.content)
        said = F.when(i == first, F.concat(prefix, content)).otherwise(content)
        user = F.array(piece(F.concat(F.lit(OPEN_USER), said, F.lit(CLOSE + "\n")), False))
        reply = F.array(piece(F.lit(OPEN_MODEL), False), piece(F.concat(content, F.lit(CLOSE)), True), piece(F.lit("\n"), False))
        return F.when(t.role == "user", user).when(t.role == "assistant", reply).otherwise(F.array().cast("array<struct<text:string,trainable:boolean>>"))

    return F.flatten(F.transform(rest, render))


def rendered(messages: str | Column) -> Column:
    return F.array_join(F.transform(segments(messages), lambda s: s.text), "")


def byte_ids(text: str) -> list[int]:
    """UTF-8 bytes as ids: the tokenizer that needs no vocabulary."""
    return list(text.encode("utf-8"))


def encode(messages: str | Column, max_len: int, truncation: str = "drop", bos: int | None = 256, tokenize=byte_ids) -> Column:
    """struct<input_ids, labels>; labels are -100 but for what the assistant says.

    ``tokenize`` gives the ids of a text: bytes, or a ``functions.tokenizer``.  Null where nothing trainable is left, or
    where a too long conversation is to be dropped.
    """
    if truncation not in ("drop", "truncate"):
        raise ValueError(truncation)

    @F.pandas_udf("input_ids array<int>, labels array<int>")
    def run(parts: pd.Series) -> pd.DataFrame:
        ids_all, labels_all = [], []
        for p in parts:
            ids, labels = ([bos], [IGNORE]) if bos is not None else ([], [])
            for s in p if p is not None else ():
                b = tokenize(s["text"])
                ids += b
                labels += b if s["trainable"] else [IGNORE] * len(b)
            fits = len(ids) <= max_len or truncation == "truncate"
            ids, labels = ids[:max_len], labels[:max_len]
            ok = fits and any(x != IGNORE for x in labels)
            ids_all.append(ids if ok else None)
            labels_all.append(labels if ok else None)
        return pd.DataFrame({"input_ids": pd.Series(ids_all, dtype=object), "labels": pd.Series(labels_all, dtype=object)})

    return run(segments(messages))


def label_share(df: DataFrame, labels_col: str = "labels") -> DataFrame:
    """Labelled tokens, all tokens and their ratio."""
    on = F.sum(F.size(F.filter(labels_col, lambda x: x != IGNORE)))
    return df.agg(on.alias("labelled"), F.sum(F.size(labels_col)).alias("tokens")).withColumn("share", F.when(F.col("tokens") > 0, F.col("labelled") / F.col("tokens")))


def pad_to(c: str | Column, length: str | Column | int, value: int) -> Column:
    """Array filled up to a length."""
    a = as_col(c)
    n = F.lit(length) if isinstance(length, int) else as_col(length)
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(n - F.size(a), F.lit(0))))


def batch_length(longest: Column, multiple: int = 8) -> Column:
    return (F.ceil(longest / multiple) * multiple).cast("int")


def rl_prompts(messages: str | Column) -> Column:
    """struct<prompt, reference>: the last assistant turn is the reference; null unless the rest ends with the user."""
    m = as_col(messages)
    last = F.get(m, F.size(m) - 1)
    head = F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0)))
    ok = (F.size(m) >= 2) & (last.role == "assistant") & (F.get(m, F.size(m) - 2).role == "user")
    return F.when(ok, F.struct(head.alias("prompt"), last.content.alias("reference")))


def valid_chat(messages: str | Column) -> Column:
    """Known roles only, contents as strings; null unless the last turn is the user's."""
    kept = F.filter(as_col(messages), lambda t: t.role.isin("user", "assistant", "system"))
    return F.when(F.get(kept, F.size(kept) - 1).role == "user", F.transform(kept, lambda t: F.struct(t.role.alias("role"), t.content.cast("string").alias("content"))))


def flattened(messages: str | Column) -> Column:
    said = F.filter(as_col(messages), lambda t: t.role != "system")
    return F.array_join(F.transform(said, lambda t: t.content), "\n\n")
