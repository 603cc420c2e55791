"""Text decoded with the wrong character encoding: found by garbling every clean corpus word, restored by substitution.

Every distinct clean word of the corpus is encoded and wrongly decoded along all ``CHAINS``, and loses characters to the
replacement character; the garbled forms are hash-joined with the documents' words.  A match names the original, which is
substituted where only one fits.  Documents are found by this table alone.  With ``beyond_table`` words whose original
stands nowhere clean in the corpus are decoded back along the chains, if the result is plain text of one script, and
words with replacement characters that match nothing are listed as lost; restoring uses it, finding does not.

Numeric character references are resolved inside words only: escaped text is no case, escaped garble is, and what isn't
restored stays as it was, byte for byte.

All tables stay distributed and no join broadcasts a table that grows; a fixed-size Bloom filter of the documents'
suspicious words keeps garbled forms that no document holds out of the shuffle.  Defined results: null and blank texts are
no case; repeated rows count once, and of several texts under one id the latest is restored; words are taken from whole
texts.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: A word: letters and digits of any kind with at least one sign beyond ASCII; ASCII marks and spaces part words,
#: because wrong single-byte decoding leaves ASCII as it is.
_WORD = re.compile(r"[0-9A-Za-z]*(?:[^\x00-\x7f]+[0-9A-Za-z]*)+")
_RUN = re.compile(r"[^\x00-\x7f]+")
#: Indic letters come out of no single-byte decoding: words made of them alone are never garbled.
_SAFE = re.compile(r"^[0-9A-Za-zऀ-෿​-‍﻿]*[ऀ-෿​-‍﻿]+[ऀ-෿0-9A-Za-z​-‍﻿]*$")
_LATIN_SAFE = re.compile(r"^[ऀ-෿​-‍﻿]+$")
_REFERENCE = r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"
_ESCAPED = re.compile(rf"[0-9A-Za-z]*(?:(?:[^\x00-\x7f]|{_REFERENCE})+[0-9A-Za-z]*)+")
MOST_LOST = 3  # characters in a row that a form may have lost
LOST = "�"
MOST_SIGNS = 1 << 22
CODECS = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "cp1250", "cp1253", "iso8859_15", "iso8859_2")


@lru_cache(None)
def byte_table(codec: str) -> tuple[str, ...]:
    """Character of each byte.  A trailing '-' drops bytes that decode to nothing or to control characters, '?' puts the
    replacement character for them; else they pass as control characters."""
    name, lossy = codec.rstrip("-?"), codec[-1] if codec[-1] in "-?" else ""
    out = []
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        if lossy and 0x80 <= ord(c) < 0xA0:
            c = "" if lossy == "-" else LOST
        out.append(c)
    return tuple(out)


CHAINS: tuple[tuple[str, ...], ...] = (
    *((c,) for c in CODECS),
    ("cp1252-",), ("latin-1-",), ("cp1252?",), ("latin-1?",),
    *((c, c) for c in ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437")),
    ("cp1252", "latin-1"), ("latin-1", "cp1252"), ("cp1252-", "cp1252-"), ("cp1252", "cp1252", "cp1252"),
)
#: Legacy bytes read as UTF-8: every character beyond ASCII becomes one replacement character, or some do.
REPLACED, LOSSY = "utf-8?", "part?"


def garble(word: str, chain: tuple[str, ...]) -> str:
    for codec in chain:
        table = byte_table(codec)
        word = "".join([table[b] for b in word.encode("utf-8", "surrogatepass")])
    return word


@lru_cache(None)
def _inverse(codec: str) -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_table(codec))}


def ungarble(word: str) -> str | None:
    """The word decoded back along the first lossless chain that gives plain text; None if there is none."""
    for chain in CHAINS:
        if chain[0][-1] in "-?":
            continue
        got: str | None = word
        for codec in reversed(chain):
            inverse = _inverse(codec)
            try:
                got = bytes([inverse[c] for c in got]).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                got = None
                break
        if got and got != word and plain(got) and not got.isascii():
            return got
    return None


def plain(word: str) -> bool:
    """Letters, marks and decimal digits, the letters of one script; or punctuation beyond ASCII alone."""
    scripts, other = set(), 0
    for c in word:
        kind = unicodedata.category(c)
        if c in "ªºµ":
            return False
        if kind[0] == "L":
            scripts.add(unicodedata.name(c, "?").split(" ")[0])
        elif kind[0] == "P" and not c.isascii() and 0x2000 <= ord(c):
            other += 1
        elif kind[0] not in "M" and kind not in ("Nd", "Cf"):
            return False
    if other:
        return other == len(word)
    # An accented capital before a small accented letter inside a word is what wrong decoding leaves of one letter.
    return len(scripts) == 1 and not re.search(r"[ÃÂÐÑÅÄ][-ÿŒœŠšŸŽžƒ]", word)


def suspicious(word: str) -> bool:
    return not (_LATIN_SAFE.match(word) or _SAFE.match(word))


def text_words(text: str) -> list[str]:
    """Words with signs beyond ASCII; numeric references inside a word are resolved."""
    if "&#" not in text:
        return [] if text.isascii() else _WORD.findall(text)
    out: list[str] = []
    for m in _ESCAPED.finditer(text):
        w = m.group()
        out += _WORD.findall(html.unescape(w)) if "&#" in w else [w]
    return out


def lossy_forms(word: str) -> Iterator[str]:
    """The word with each run of up to MOST_LOST characters beyond ASCII replaced, a replacement character for each."""
    for n in range(1, MOST_LOST + 1):
        for i in range(len(word) - n + 1):
            gone = word[i : i + n]
            if n < len(word) and all(c > "\x7f" for c in gone):
                yield word[:i] + LOST * n + word[i + n :]


def put_back(text: str, known: dict[str, str]) -> str:
    """The text with every known garbled word, or known run inside a word, replaced by its original."""

    def one(m: re.Match) -> str:
        w = m.group()
        return known[w] if w in known else _RUN.sub(lambda r: known.get(r.group(), r.group()), w)

    if "&#" not in text:
        return _WORD.sub(one, text)

    def escaped(m: re.Match) -> str:
        w = m.group()
        if "&#" not in w:
            return one(m)
        plain_ = html.unescape(w)
        got = _WORD.sub(one, plain_)
        return w if got == plain_ else got

    return _ESCAPED.sub(escaped, text)


def corpus_words(docs: DataFrame, id_col: str, text_col: str, limit: int = 200_000) -> DataFrame:
    """(word, n, doc_id): counts summed per task for safe words (doc_id null), per document for suspicious ones."""
    kind = dict(docs.dtypes)[id_col]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"word string, n long, doc_id {kind}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        memo: dict[str, bool] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.nulls(len(counts), arrow.field("doc_id").type)], schema=arrow)
            counts.clear()
            memo.clear()
            return out

        for batch in batches:
            words, ns, docs_ = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                own: dict[str, int] = {}
                for w in text_words(text):
                    odd = memo.get(w)
                    if odd is None:
                        odd = memo[w] = suspicious(w)
                    held = own if odd else counts
                    held[w] = held.get(w, 0) + 1
                for w, n in list(own.items()):  # garbled marks stick to words: their runs are looked up as well
                    for run_ in _RUN.findall(w):
                        if run_ != w and not _LATIN_SAFE.match(run_):
                            own.setdefault(run_, n)
                words += own
                ns += own.values()
                docs_ += [doc] * len(own)
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int64()), pa.array(docs_, arrow.field("doc_id").type)], schema=arrow)
            if len(counts) >= limit:
                yield flush()
        yield flush()

    return docs.select(F.col(id_col), F.col(text_col)).where(F.col(id_col).isNotNull()).mapInArrow(run, schema)


def matches(words: DataFrame, beyond_table: bool = False) -> DataFrame:
    """(form, original, chain, originals): the documents' words that are garbled forms of clean corpus words."""
    spark = words.sparkSession
    odd = words.where("doc_id is not null").groupBy("word").agg(F.sum("n").alias("n")).withColumn("h", F.xxhash64("word"))
    odd = base.materialize(odd, "odd")
    passing = spark.sparkContext.broadcast(base.bloom(odd, "h"))
    held: list = []
    some_lost = odd.where(F.col("word").contains(LOST)).limit(1).count() > 0  # else these forms would match nothing

    def forms(cols: dict) -> dict:
        if not held:
            held.append(base.BloomTest(passing.value))
        out = {"form": [], "original": [], "chain": [], "n": []}
        new: list[tuple] = []
        signs = 0

        def sift() -> None:
            """Only forms that some document may hold are kept, tested by Spark's own hash."""
            h = np.array([xxhash.xxh64_intdigest(x[0].encode(), seed=42) for x in new], dtype=np.uint64)
            for at in np.nonzero(held[0](h))[0]:
                for c, v in zip(out, new[at]):
                    out[c].append(v)
            new.clear()

        for word, n in zip(cols["word"].to_pylist(), cols["n"].to_pylist()):
            if not plain(word):
                continue
            seen = {word}
            for chain in CHAINS:
                f = garble(word, chain)
                if f and f not in seen and (len(f) > 1 or f == LOST):
                    seen.add(f)
                    signs += len(f)
                    new.append((f, word, "+".join(chain), n))
            f = _RUN.sub(lambda m: LOST * len(m.group()), word)
            if f not in seen:
                seen.add(f)
                new.append((f, word, REPLACED, n))
            if some_lost:
                for f in lossy_forms(word):
                    if f not in seen:
                        signs += len(f)
                        new.append((f, word, LOSSY, n))
            if signs > MOST_SIGNS:  # long words: their forms don't pile up
                sift()
                signs = 0
        sift()
        return out

    kinds = "form string, original string, chain string, n long"
    clean = words.groupBy("word").agg(F.sum("n").alias("n"))
    few = base.arrow_map(clean, forms, kinds)
    met = few.hint("merge").join(odd.select(F.col("word").alias("form"), F.col("n").alias("n_form")), "form")
    # A form that is a plain word itself, and no rarer than the supposed original, is that word.
    best = met.groupBy("form").agg(
        F.max(F.struct("n", "original", "chain")).alias("b"), F.count_distinct("original").alias("originals"), F.first("n_form").alias("n_form")
    )
    joined = best.select("form", "b.original", "b.chain", "originals", "n_form", F.col("b.n").alias("n"))
    def verified(cols: dict) -> dict:
        keep = pa.array([not plain(f) or nf < n for f, nf, n in zip(cols["form"].to_pylist(), cols["n_form"].to_pylist(), cols["n"].to_pylist())], pa.bool_())
        return {c: cols[c].filter(keep) for c in ("form", "original", "chain", "originals")}

    sure = base.arrow_map(joined, verified, "form string, original string, chain string, originals long")
    if not beyond_table:
        return sure
    rest = odd.select(F.col("word").alias("form")).hint("merge").join(joined.select("form"), "form", "left_anti")

    def decoded(cols: dict) -> dict:
        got = [None if plain(w) else ungarble(w) for w in cols["form"].to_pylist()]
        keep = pa.array([g is not None for g in got], pa.bool_())
        return {"form": cols["form"].filter(keep), "original": pa.array(got, pa.string()).filter(keep)}

    back = base.arrow_map(rest, decoded, "form string, original string")
    return sure.union(back.select("form", "original", F.lit("decoded"), F.lit(1).cast("long")))


def garbled_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", beyond_table: bool = False) -> DataFrame:
    """(doc_id, form, original or null, chain, originals): every garbled word of every document."""
    words = base.materialize(corpus_words(docs, id_col, text_col), "words")
    found = base.materialize(matches(words, beyond_table), "matches")
    inside = words.where("doc_id is not null").select("doc_id", F.col("word").alias("form")).distinct()
    hit = inside.hint("merge").join(found, "form").select("doc_id", "form", "original", "chain", "originals")
    if not beyond_table:
        return hit
    lost = inside.where(F.col("form").contains(LOST)).hint("merge").join(found.select("form"), "form", "left_anti")
    return hit.union(lost.select("doc_id", "form", F.lit(None).cast("string"), F.lit("lost"), F.lit(0).cast("long")))


def garbled_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", beyond_table: bool = False) -> DataFrame:
    """One row per document with a wrongly decoded passage: garbled words, how many can be restored, and the chains."""
    w = garbled_words(docs, id_col, text_col, beyond_table)
    return w.groupBy("doc_id").agg(
        F.count("*").alias("garbled_words"), F.count_if(F.col("originals") == 1).alias("restorable"), F.array_sort(F.collect_set("chain")).alias("chains")
    )


def restored_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, beyond_table: bool = True) -> DataFrame:
    """(doc_id, restored): affected documents with every garbled word that has one original put back.

    Of several texts under one id the latest by ``order_col`` counts, ties by the text.
    """
    w = base.materialize(garbled_words(docs, id_col, text_col, beyond_table), "garbled")
    maps = w.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("originals") == 1, F.struct("form", "original")))).alias("back"))
    passing = docs.sparkSession.sparkContext.broadcast(base.bloom(maps.withColumn("h", F.xxhash64("doc_id")), "h"))
    held: list = []

    def affected(cols: dict) -> dict:
        if not held:
            held.append(base.BloomTest(passing.value))
        keep = pa.array(held[0](cols["h"].to_numpy().view(np.uint64)))
        return {c: cols[c].filter(keep) for c in ("doc_id", "at", "text")}

    kinds = dict(docs.dtypes)
    kind, time = kinds[id_col], kinds[order_col] if order_col else "int"
    at = F.col(order_col) if order_col else F.lit(0)
    source = docs.select(F.col(id_col).alias("doc_id"), at.alias("at"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h")).where("doc_id is not null")
    some = base.arrow_map(source, affected, f"doc_id {kind}, at {time}, text string")
    last = base.latest(some, "doc_id", "at", ["text"]).where("text is not null")

    def restore(cols: dict) -> dict:
        return {"doc_id": cols["doc_id"], "restored": [put_back(t, dict(back)) for t, back in zip(cols["text"].to_pylist(), cols["back"].to_pylist())]}

    return base.arrow_map(last.hint("merge").join(maps, "doc_id"), restore, f"doc_id {kind}, restored string")
