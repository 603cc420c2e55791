"""Quality metrics of a document and the first threshold it fails."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wordlists
from ..functions.chars import WS, as_col, bind, char_class, count, lines, ratio, sub, words

# Marks stripped from words, line bullets and ellipses, and digits beyond the decimal ones.
STRIP_MARKS = ".,;:!?\"'()[]{}«»“”‘’-–—…"
BULLET = rf"^(?:[-*•●▪➤►✓✔]|\p{{Nd}}+[.)])[{WS}]+"
ELLIPSIS = r"(?:\.\.\.|…)$"
DIGITS = r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}]"
TOP_SIZES, DUP_SIZES = (2, 3, 4), (5, 7, 10)


# Names and defaults of the thresholds, and the reasons below.
@dataclass(frozen=True)
class QualityThresholds:
    min_chars: int = 200
    max_chars: int = 500_000
    min_words: int = 30
    max_words: int = 100_000
    min_mean_word_len: float = 2.0
    max_mean_word_len: float = 20.0
    max_symbol_word_ratio: float = 0.1
    max_bullet_line_frac: float = 0.9
    max_ellipsis_line_frac: float = 0.3
    max_digit_frac: float = 0.25
    max_punct_frac: float = 0.25
    max_dup_line_frac: float = 0.3
    max_dup_line_char_frac: float = 0.2
    max_top_ngram_frac: Mapping[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    max_dup_ngram_frac: Mapping[int, float] = field(default_factory=lambda: {5: 0.15, 7: 0.13, 10: 0.10})
    min_stopwords: int = 0
    stopwords: str | None = None  # file, or 'english' / 'tamil' for the built-in lists

    @classmethod
    def from_dict(cls, d: Mapping[str, Any] | None, base: "QualityThresholds | None" = None) -> "QualityThresholds":
        """Unknown names raise; gram maps replace the base's."""
        changes = {}
        names = {f.name for f in dataclasses.fields(cls)}
        for key, value in dict(d or {}).items():
            if key not in names:
                raise KeyError(f"unknown quality threshold {key!r}")
            changes[key] = {int(n): float(x) for n, x in dict(value).items()} if key.endswith("ngram_frac") and value is not None else value
        return dataclasses.replace(base or cls(), **changes)


def resolve_profiles(config: Mapping[str, Mapping[str, Any]]) -> dict[str, QualityThresholds]:
    """Every profile inherits the resolved default."""
    default = QualityThresholds.from_dict(config.get("default"))
    return {"default": default} | {name: QualityThresholds.from_dict(d, default) for name, d in config.items() if name != "default"}


def clean_words(w: Column) -> Column:
    """Words without marks at their ends, empty ones dropped."""
    edge = char_class(STRIP_MARKS)
    return F.filter(F.transform(w, lambda x: sub(x, f"^{edge}+|{edge}+$")), lambda x: x != "")


def total_length(w: Column) -> Column:
    return F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))


BASIC = (
    "n_chars", "n_words", "n_lines", "mean_word_len", "symbol_word_ratio", "bullet_line_frac", "ellipsis_line_frac", "digit_frac",
    "punct_frac", "dup_line_frac", "dup_line_char_frac",
)


def basic_metrics(c: str | Column) -> Column:
    """struct of the metrics that need no n-grams.  Words and lines are split once and bound."""
    t = F.coalesce(as_col(c), F.lit(""))
    parts = F.struct(t.alias("t"), words(t).alias("w"), lines(t).alias("ls"))
    return bind(parts, lambda a: bind(clean_words(a.w), lambda cw: _basic(a.t, a.w, a.ls, cw)))


def _basic(t: Column, w: Column, ls: Column, cw: Column) -> Column:
    n_chars, n_lines = F.length(t), F.size(ls)
    made = {
        "n_chars": n_chars, "n_words": F.size(w), "n_lines": n_lines,
        "mean_word_len": ratio(total_length(cw), F.size(cw)),
        "symbol_word_ratio": count(t, r"#|\.\.\.|…").cast("double") / F.greatest(F.size(w), F.lit(1)),
        "bullet_line_frac": ratio(F.size(F.filter(ls, lambda x: x.rlike(BULLET))), n_lines),
        "ellipsis_line_frac": ratio(F.size(F.filter(ls, lambda x: x.rlike(ELLIPSIS))), n_lines),
        "digit_frac": ratio(count(t, DIGITS), n_chars),
        "punct_frac": ratio(n_chars - F.length(F.translate(t, STRIP_MARKS, "")), n_chars),
        **duplicate_lines(ls),
    }
    return F.struct(*[made[k].alias(k) for k in BASIC])


def duplicate_lines(ls: Column) -> dict[str, Column]:
    """Shares of lines, and of their characters, whose line value occurs more than once; all copies count.

    After sorting, a line is a copy if it equals a neighbour, so the cost is that of a sort.
    """
    twin = lambda s: lambda x, i: ((i > 0) & (F.get(s, i - 1) == x)) | F.coalesce(F.get(s, i + 1) == x, F.lit(False))
    copies = bind(F.array_sort(ls), lambda s: F.filter(s, twin(s)))
    return {"dup_line_frac": ratio(F.size(copies), F.size(ls)), "dup_line_char_frac": ratio(total_length(copies), total_length(ls))}


def grams(w: Column, n: int) -> Column:
    """All runs of n words, joined with a space.

    Words are taken by position: slice() would copy the array for every run.  The guard is inside, since
    sequence(0, -1) counts down.
    """
    empty = F.array().cast("array<string>")

    def runs(a: Column) -> Column:
        last = F.size(a) - n
        at = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        return F.when(last >= 0, F.transform(at, lambda i: F.concat_ws(" ", *[F.get(a, i + k) for k in range(n)]))).otherwise(empty)

    return bind(w, runs)


GRAM_NAMES = (*(f"top_{n}gram" for n in TOP_SIZES), *(f"dup_{n}gram" for n in DUP_SIZES))


def gram_shares(text: str | None) -> tuple[float, ...]:
    """Of one text: for 2, 3 and 4 words, characters of the most frequent gram times its count over the characters of
    all words (ties: first seen; 0 unless it occurs twice); for 5, 7 and 10, characters of the words covered by any gram
    that occurs more than once.

    Grams are numbered exactly by extending shorter ones, a word at a time, so no hash can collide and the cost is a
    sort per size.
    """
    w = text.split() if text else []
    total = sum(map(len, w))
    if len(w) < 3:
        return (0.0,) * len(GRAM_NAMES)
    lengths = np.fromiter(map(len, w), dtype=np.int64, count=len(w))
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(x, len(known)) for x in w), dtype=np.int64, count=len(w))
    out, g, values = {}, ids, len(known)
    ends = np.r_[0, np.cumsum(lengths)]
    for n in range(2, DUP_SIZES[-1] + 1):
        k = len(w) - n + 1
        if k < 2:
            break
        _, first, g, counts = np.unique(g[:k] * values + ids[n - 1 :], return_index=True, return_inverse=True, return_counts=True)
        most = counts.max()
        if most == 1:
            break  # longer grams are all different as well
        if n in TOP_SIZES:
            at = first[counts == most].min()
            out[f"top_{n}gram"] = float((ends[at + n] - ends[at]) * most / total)
        if n in DUP_SIZES:
            edge = np.zeros(len(w) + 1, dtype=np.int64)
            starts = np.nonzero(counts[g] > 1)[0]
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + n, -1)
            out[f"dup_{n}gram"] = float(lengths[np.cumsum(edge[:-1]) > 0].sum() / total)
    return tuple(out.get(name, 0.0) for name in GRAM_NAMES)


def ngram_metrics(c: str | Column) -> Column:
    """struct of ``gram_shares``; null texts cost nothing, so callers blank what they need not know.

    A document's grams never leave its row: no shuffle of six times the text.
    """

    @F.pandas_udf(", ".join(f"{name} double" for name in GRAM_NAMES))
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([gram_shares(t) for t in s], columns=list(GRAM_NAMES), dtype="float64")

    return run(as_col(c))


def stopword_count(c: str | Column, listed: str) -> Column:
    known = {"english": wordlists.ENGLISH, "tamil": wordlists.TAMIL}.get(listed) or sorted(wordlists.load_words(listed))
    return F.size(F.filter(clean_words(words(c)), lambda x: F.lower(x).isin(*known)))


def reject_reason(m: Mapping[str, Column], th: QualityThresholds, stopwords: Column | None = None) -> Column:
    """First failed threshold in a fixed order, null if none; a value at the threshold passes.

    ``m`` may hold only the basic metrics: then the gram thresholds are left out.
    """
    r = lambda bad, name: F.when(bad, F.lit(name))
    checks = [
        r(m["n_chars"] < th.min_chars, "too_short_chars"), r(m["n_chars"] > th.max_chars, "too_long_chars"),
        r(m["n_words"] < th.min_words, "too_few_words"), r(m["n_words"] > th.max_words, "too_many_words"),
        r((m["mean_word_len"] < th.min_mean_word_len) | (m["mean_word_len"] > th.max_mean_word_len), "mean_word_len"),
        r(m["symbol_word_ratio"] > th.max_symbol_word_ratio, "symbol_ratio"),
        r(m["bullet_line_frac"] > th.max_bullet_line_frac, "bullet_lines"), r(m["ellipsis_line_frac"] > th.max_ellipsis_line_frac, "ellipsis_lines"),
        r(m["digit_frac"] > th.max_digit_frac, "digit_frac"), r(m["punct_frac"] > th.max_punct_frac, "punct_frac"),
        r(m["dup_line_frac"] > th.max_dup_line_frac, "dup_lines"), r(m["dup_line_char_frac"] > th.max_dup_line_char_frac, "dup_line_chars"),
    ]
    for kind, limits in (("top", th.max_top_ngram_frac), ("dup", th.max_dup_ngram_frac)):
        checks += [r(m[f"{kind}_{n}gram"] > x, f"{kind}_{n}gram") for n, x in limits.items() if f"{kind}_{n}gram" in m]
    if th.stopwords and stopwords is not None:
        checks.append(r(stopwords < th.min_stopwords, "few_stopwords"))
    return F.coalesce(*checks)


def quality_filter(df: DataFrame, text_col: str, th: QualityThresholds) -> DataFrame:
    """df with ``reject_reason``: cheap metrics first, n-grams only of the texts that pass them.  No shuffle."""
    return profiled_filter(df, text_col, F.lit("default"), {"default": th})


def profiled_filter(df: DataFrame, text_col: str, profile: Column, profiles: Mapping[str, QualityThresholds], live: Column | None = None) -> DataFrame:
    """``quality_filter`` with the thresholds of each row's profile, the default's for unknown ones, in one pass.

    Rows that aren't ``live`` get no reason, and cost nothing.
    """
    on = F.lit(True) if live is None else live
    text = F.when(on, F.col(text_col))

    def chosen(reason) -> Column:
        out = reason(profiles["default"])
        for name, th in profiles.items():
            if name != "default" and th != profiles["default"]:
                out = F.when(profile == name, reason(th)).otherwise(out)
        return out

    base = df.withColumn("_m", basic_metrics(text))
    cheap = {k: F.col(f"_m.{k}") for k in BASIC}
    first = base.withColumn("_first", F.when(on, chosen(lambda th: reject_reason(cheap, th))))
    deep = first.withColumn("_g", ngram_metrics(F.when(F.col("_first").isNull(), text)))
    every = cheap | {n: F.col(f"_g.{n}") for n in GRAM_NAMES}
    rest = chosen(lambda th: reject_reason(every, th, stopword_count(text, th.stopwords) if th.stopwords else None))
    return deep.withColumn("reject_reason", F.when(on, F.coalesce("_first", rest))).drop("_m", "_first", "_g")
