"""The few text functions that Spark has no builtin for, as Arrow-batched functions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import as_col


def unicode_form(c: str | Column, form: str = "NFC") -> Column:
    """Unicode normal form; null stays null."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return normal(as_col(c))


def html_unescape(c: str | Column) -> Column:
    """All HTML character references resolved once; null stays null."""

    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or "&" not in t else html.unescape(t))

    return plain(as_col(c))


def unescape_then_form(c: str | Column, form: str) -> Column:
    """Both in one trip to Python; callers put steps between them only where those steps cannot meet."""

    @F.pandas_udf("string")
    def both(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or (t.isascii() and "&" not in t) else unicodedata.normalize(form, html.unescape(t)))

    return both(as_col(c))
