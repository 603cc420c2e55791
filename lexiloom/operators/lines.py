"""Line filter: drop short, code-like, boilerplate and repeated lines, keep the rest in order."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import wordlists
from ..functions.chars import as_col, bind, literal, strip, sub, words


@dataclass(frozen=True)
class LineFilterConfig:
    enabled: bool = True
    min_chars: int = 0
    min_words: int = 0
    drop_curly: bool = True
    drop_boilerplate: bool = True
    boilerplate: str | None = None  # file; None: the built-in list
    max_repeats: int = 1

    @classmethod
    def from_dict(cls, d: Mapping[str, Any] | None) -> "LineFilterConfig":
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in dict(d or {}).items() if k in known})


def boilerplate_pattern(cfg: LineFilterConfig) -> str:
    """One alternation of quoted substrings, against the lower-cased line."""
    listed = wordlists.load_patterns(cfg.boilerplate) if cfg.boilerplate else wordlists.BOILERPLATE
    return "|".join(literal(p) for p in listed)


def keep_line(line: Column, cfg: LineFilterConfig) -> Column:
    """Whether a stripped line passes the predicates that need no other line.  Blank lines pass."""
    ok = F.lit(True)
    if cfg.min_chars:
        ok &= F.length(line) >= cfg.min_chars
    if cfg.min_words:
        ok &= F.size(words(line)) >= cfg.min_words
    if cfg.drop_curly:
        ok &= ~line.rlike("[{}]")
    if cfg.drop_boilerplate:
        ok &= ~F.lower(line).rlike(boilerplate_pattern(cfg))
    return (line == "") | ok


def filter_lines(c: str | Column, cfg: LineFilterConfig = LineFilterConfig()) -> Column:
    """Filtered text; a line dropped by an earlier predicate does not count as seen.  Null gives ''."""
    text = F.coalesce(as_col(c), F.lit(""))
    if not cfg.enabled:
        return text
    kept = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: keep_line(x, cfg))
    if cfg.max_repeats == 1:
        # Blank lines are made unequal, so that a hash-based distinct drops repeats only.
        marked = F.transform(kept, lambda x, i: F.when(x == "", F.concat(F.lit("\0"), i.cast("string"))).otherwise(x))
        kept = F.transform(F.array_distinct(marked), lambda x: F.when(F.startswith(x, F.lit("\0")), F.lit("")).otherwise(x))
    elif cfg.max_repeats > 1:
        # Sorted with their places, equal lines stand together: one is too many if its like stands ``max_repeats`` before it.
        n = cfg.max_repeats
        placed = bind(F.transform(kept, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda a: F.array_sort(a))
        few = bind(placed, lambda s: F.filter(s, lambda e, i: (e.x == "") | (i < n) | F.coalesce(F.get(s, i - n).x != e.x, F.lit(True))))
        kept = F.transform(F.array_sort(F.transform(few, lambda e: F.struct(e.i.alias("i"), e.x.alias("x")))), lambda e: e.x)
    return strip(sub(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))
