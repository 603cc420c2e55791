"""Script statistics from disjoint character classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import LATIN_WIDE, TAMIL, TAMIL_DIGITS, WS, as_col, char_class, count, ratio

_TD = char_class(TAMIL_DIGITS)[1:-1]
#: Class of each counter; a character belongs to the first that fits: Tamil, space, digit, Latin, other letter, mark.
CLASSES = {
    "tamil": r"[\x{0B80}-\x{0BE5}\x{0BF0}-\x{0BFF}]",
    "digits": rf"[{_TD}]|\p{{Nd}}",
    "spaces": f"[{WS}]",
    "latin": f"[{LATIN_WIDE}]",
    "other": rf"[^\P{{L}}{TAMIL}{LATIN_WIDE}]|[^\P{{M}}{TAMIL}]",
    "punct": rf"[^\P{{P}}{TAMIL}]|[^\P{{S}}{TAMIL}]",
}


def script_counts(c: str | Column) -> dict[str, Column]:
    t = F.coalesce(as_col(c), F.lit(""))
    return {name: count(t, pattern) for name, pattern in CLASSES.items()}


def script_stats(c: str | Column) -> Column:
    """struct of counters, letters, and the three letter shares (0 without letters)."""
    n = script_counts(c)
    letters = n["tamil"] + n["latin"] + n["other"]
    shares = [ratio(n[k], letters).alias(f"{k}_ratio") for k in ("tamil", "latin", "other")]
    return F.struct(*[v.alias(k) for k, v in n.items()], letters.alias("letters"), *shares)


def graphemes(c: str | Column) -> Column:
    """Code points that are no combining marks."""
    t = F.coalesce(as_col(c), F.lit(""))
    return F.length(t) - count(t, r"[\p{Mn}\p{Mc}]")


def has_tamil(c: str | Column) -> Column:
    return F.coalesce(as_col(c).rlike(f"[{TAMIL}]"), F.lit(False))


def is_tamil_piece(c: str | Column) -> Column:
    """A tokenizer piece with at least one character besides the word mark, all of them Tamil."""
    return F.coalesce(F.translate(as_col(c), "▁", "").rlike(f"^[{TAMIL}]+$"), F.lit(False))
