"""Text normalisation as one chain of column expressions, in a fixed order of switchable steps."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrow_text
from .chars import TAMIL_DIGITS, VIRAMA, VOWEL_SIGNS, WS, as_col, char_class, strip, sub

# Code points without meaning in running text, and the typographic marks with their ASCII forms.
INVISIBLE = "​‌‍⁠﻿­‎‏‪‫‬‭‮"
QUOTES = ("‘’‚‛“”„‟′″", "''''\"\"\"\"'\"")
DASHES = ("‐‑‒–—―", "------")
CONTROL = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"
SPACES = r"[ \t\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+"
URL = rf"(?i)(?:https?://|www\.)[^{WS}]+"
# A word character here is a letter, a number or '_' of any script, without combining marks.
_W = r"\p{L}\p{N}_"
EMAIL = rf"(?<![{_W}])(?=[{_W}])[{_W}.+-]+@[{_W}-]+\.(?:[{_W}.-]*[{_W}])(?![{_W}])"
PHONE = r"(?<!\p{Nd})(?:\+?91[\s-]?)?[6-9]\p{Nd}{4}[\s-]?\p{Nd}{5}(?!\p{Nd})"
MASKS = {"url": "<url>", "email": "<email>", "phone": "<phone>"}
NON_WORD = r"[^\p{L}\p{M}\p{N}]+"
SRI = ("ஶ்ரீ", "ஸ்ரீ")


@dataclass(frozen=True)
class NormalizerConfig:
    unicode_form: str = "NFC"  # NFC, NFKC or none
    html_unescape: bool = True
    remove_invisible: bool = True
    remove_control: bool = True
    fix_tamil_signs: bool = True
    unify_sri: bool = True
    tamil_digits_to_ascii: bool = False
    normalize_quotes: bool = True
    normalize_dashes: bool = True
    urls: str = "keep"  # keep, remove or mask
    emails: str = "keep"
    phones: str = "keep"
    collapse_spaces: bool = True
    strip_lines: bool = True
    max_consecutive_newlines: int = 2

    @classmethod
    def from_dict(cls, d: Mapping[str, Any] | None) -> "NormalizerConfig":
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in dict(d or {}).items() if k in known})


def personal(c: Column, pattern: str, mode: str, mask: str) -> Column:
    """Keep, remove or mask what a pattern finds."""
    if mode == "keep":
        return c
    if mode not in ("remove", "mask"):
        raise ValueError(f"unknown mode {mode!r}")
    return sub(c, pattern, mask if mode == "mask" else "")


def newlines(c: str | Column) -> Column:
    return sub(c, r"\r\n?", "\n")


def cap_newlines(c: Column, most: int) -> Column:
    return sub(c, rf"\n{{{most + 1},}}", "\n" * most) if most else c


def strip_each_line(c: Column) -> Column:
    inner = WS.replace(r"\n", "")
    return sub(c, rf"(?m)^[{inner}]+|[{inner}]+$")


def fix_signs(c: Column) -> Column:
    """A doubled vowel sign or virama becomes one; a virama before a vowel sign goes."""
    signs = char_class(VOWEL_SIGNS)
    return sub(sub(c, f"({char_class(VOWEL_SIGNS + VIRAMA)})\\1+", "$1"), f"{VIRAMA}({signs})", "$1")


def normalize(c: str | Column, cfg: NormalizerConfig = NormalizerConfig()) -> Column:
    """Normalised text; null and empty give ''."""
    t = F.coalesce(as_col(c), F.lit(""))
    if cfg.html_unescape:
        t = arrow_text.html_unescape(t)
    t = newlines(t)
    if cfg.remove_invisible:
        t = F.translate(t, INVISIBLE, "")
    if cfg.remove_control:
        t = sub(t, CONTROL)
    if cfg.unicode_form != "none":
        t = arrow_text.unicode_form(t, cfg.unicode_form)
    if cfg.fix_tamil_signs:
        t = fix_signs(t)
    if cfg.unify_sri:
        t = F.replace(t, F.lit(SRI[0]), F.lit(SRI[1]))
    if cfg.normalize_quotes:
        t = F.translate(t, *QUOTES)
    if cfg.normalize_dashes:
        t = F.translate(t, *DASHES)
    if cfg.tamil_digits_to_ascii:
        t = F.translate(t, TAMIL_DIGITS, "0123456789")
    t = personal(t, URL, cfg.urls, MASKS["url"])
    t = personal(t, EMAIL, cfg.emails, MASKS["email"])
    t = personal(t, PHONE, cfg.phones, MASKS["phone"])
    if cfg.collapse_spaces:
        t = sub(t, SPACES, " ")
    if cfg.strip_lines:
        t = strip_each_line(t)
    return strip(cap_newlines(t, cfg.max_consecutive_newlines))


def dedup_key(c: str | Column) -> Column:
    """Canonical key: NFC, lower case, only letters, marks and numbers; marks count."""
    return sub(F.lower(arrow_text.unicode_form(F.coalesce(as_col(c), F.lit("")))), NON_WORD)


def reward_tokens(c: str | Column) -> Column:
    """Tokens for rewards: NFC, lower case, punctuation but no Tamil sign to a space, split."""
    low = F.lower(arrow_text.unicode_form(F.coalesce(as_col(c), F.lit(""))))
    plain = sub(low, rf"[^\p{{L}}\p{{N}}_{WS}\x{{0B80}}-\x{{0BFF}}]", " ")
    return F.filter(F.split(plain, f"[{WS}]+"), lambda x: x != "")
