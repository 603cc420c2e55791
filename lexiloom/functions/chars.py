"""Character classes shared by all operators, written so that Java and RE2 read them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode (and Python's str.split) has it; Java's and RE2's \s know only ASCII.
WS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TAMIL = r"\x{0B80}-\x{0BFF}"
TAMIL_DIGITS = "௦௧௨௩௪௫௬௭௮௯"
VIRAMA = "்"
VOWEL_SIGNS = "ாிீுூெேைொோௌ"
LATIN_WIDE = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sub(c: str | Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(as_col(c), F.lit(pattern), F.lit(to))


def strip(c: str | Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return sub(c, f"^[{WS}]+|[{WS}]+$")


def blank(c: str | Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(c), F.lit("")) == ""


def count(c: str | Column, pattern: str) -> Column:
    return F.regexp_count(as_col(c), F.lit(pattern))


def words(c: str | Column) -> Column:
    """Maximal runs of non-space characters, in order; none for null."""
    return F.filter(F.split(F.coalesce(as_col(c), F.lit("")), f"[{WS}]+"), lambda x: x != "")


def lines(c: str | Column) -> Column:
    """Stripped non-blank lines, in order."""
    parts = F.transform(F.split(F.coalesce(as_col(c), F.lit("")), "\n", -1), strip)
    return F.filter(parts, lambda x: x != "")


def bind(value: Column, f) -> Column:
    """f of a value that is computed once.

    An expression captured by a lambda is evaluated again for every element; as the element of a one-element array it
    becomes a variable.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def char_class(chars: str) -> str:
    """A regex class of literal characters."""
    return "[" + "".join(rf"\x{{{ord(c):X}}}" for c in chars) + "]"


def literal(text: str) -> str:
    """Text as a regex without special meaning, for Java and RE2."""
    return "".join(c if c.isalnum() and c.isascii() or c == " " else rf"\x{{{ord(c):X}}}" for c in text)


def last_newline(c: Column) -> Column:
    """1-based position of the last line feed, 0 if there is none."""
    at = F.instr(F.reverse(c), "\n")
    return F.when(at == 0, F.lit(0)).otherwise(F.length(c) - at + 1)
