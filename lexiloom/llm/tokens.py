"""Token counts under an existing unigram tokenizer, exact per document and rolled up per slice.

The vocabulary is read as a table of pieces with log probabilities; the best segmentation is found by Viterbi, unknown
characters fall back to one token per byte.  No piece holds the word mark anywhere but at its start, and no piece holds
a line feed beside other characters; both are proven from the vocabulary when it is loaded.  Hence texts can be cut
before every word mark and around every line feed without changing the segmentation, which lets each word be counted
once per worker, and lets oversized documents be cut into chunks that are spread over the workers and summed.

Defined results: null and empty texts have 0 tokens; spaces are tokens (nothing is normalised); ids count once, the latest delivery.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

MARK = "▁"
BIG_CHARS = 200_000


class UnigramCounter:
    """Number of tokens of a text.  pieces: piece -> log probability; byte pieces are implied."""

    def __init__(self, pieces: dict[str, float], limit: int = 400_000):
        self.pieces, self.limit, self.memo = pieces, limit, {}
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        inner = {c for p in pieces for c in p[1:]}
        starts = {p[0] for p in pieces if len(p) > 1}
        #: Proven independent boundaries: before a character that no piece holds after its start.
        self.before = frozenset(c for c in (MARK, "\n") if c not in inner)
        #: After a character that, besides, starts no longer piece.
        self.after = frozenset(c for c in self.before if c not in starts)
        cut = regex.escape("".join(sorted(self.before - self.after)))
        alone = regex.escape("".join(sorted(self.after)))
        one = f"[{alone}]|" if alone else ""
        self.split = regex.compile(f"{one}[{cut}]?[^{cut}{alone}]+|[{cut}]" if cut else f"{one}[^{alone}]+" if alone else r"(?s).+")

    def __reduce__(self):
        return UnigramCounter, (self.pieces, self.limit)

    def count(self, text: str | None) -> int:
        memo, total = self.memo, 0
        for part in self.split.findall(text.replace(" ", MARK)) if text else ():
            n = memo.get(part)
            if n is None:
                if len(memo) >= self.limit:
                    memo.clear()
                n = memo[part] = len(self.segment(part))
            total += n
        return total

    def segment(self, part: str) -> list[str]:
        """Best segmentation of a part; unknown characters come as their bytes."""
        n = len(part)
        best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        pieces = self.pieces
        for i in range(n):
            at = best[i]
            single = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                s = pieces.get(part[i:j])
                if s is not None:
                    single |= j == i + 1
                    if at + s > best[j]:
                        best[j], back[j] = at + s, i
            if not single and at + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = at + self.unknown, i
        out, j = [], n
        while j:
            i = back[j]
            piece = part[i:j]
            out += [piece] if piece in pieces else [f"<0x{b:02X}>" for b in reversed(piece.encode("utf-8", "surrogatepass"))]
            j = i
        return out[::-1]

    def chunks(self, text: str, size: int) -> list[str]:
        """Cut a text before proven boundaries into chunks of about ``size`` characters (longer where none comes)."""
        cuts = self.before & {MARK, "\n"}
        marks = "".join(c for c in (" ", "\n", MARK) if (MARK if c == " " else c) in cuts)
        if not marks:
            return [text]
        find, out, at = regex.compile(f"[{regex.escape(marks)}]"), [], 0
        while len(text) - at > size:
            m = find.search(text, at + size)
            if not m:
                break
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]


def counter(pieces: DataFrame) -> UnigramCounter:
    """From the vocabulary table, whose size is the tokenizer's (checked)."""
    rows = pieces.where("piece_type = 1 and piece is not null").select("piece", "score").limit(2_000_001).collect()
    if len(rows) > 2_000_000:
        raise ValueError("more pieces than a tokenizer has")
    return UnigramCounter({r.piece: r.score for r in rows})


def document_tokens(df: DataFrame, pieces: DataFrame, id_col: str, text_col: str, keep: list[str], big_chars: int = BIG_CHARS) -> DataFrame:
    """Rows of df with n_tokens, without the text; texts beyond ``big_chars`` are cut, spread and summed."""
    counts = df.sparkSession.sparkContext.broadcast(counter(pieces))
    kinds = dict(df.dtypes)
    cols = list(dict.fromkeys([id_col, *keep]))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols)

    def whole(batch: dict) -> dict:
        return {c: batch[c] for c in cols} | {"n_tokens": [counts.value.count(t) for t in batch[text_col].to_pylist()]}

    def cut(batch: dict) -> dict:
        out: dict[str, list] = {c: [] for c in (*cols, "row", "chunk", "first")}
        kept = {c: batch[c].to_pylist() for c in (*cols, "row")}
        for i, t in enumerate(batch[text_col].to_pylist()):
            for k, part in enumerate(counts.value.chunks(t, big_chars // 4)):
                for c in kept:
                    out[c].append(kept[c][i])
                out["chunk"].append(part)
                out["first"].append(int(k == 0))
        return out

    def parts(batch: dict) -> dict:
        return {c: batch[c] for c in (*cols, "row", "first")} | {"n": [counts.value.count(t) for t in batch["chunk"].to_pylist()]}

    rows = df.select(*cols, text_col)
    small = base.arrow_map(rows.where(F.coalesce(F.length(text_col), F.lit(0)) <= big_chars), whole, f"{schema}, n_tokens long")
    # A row key keeps differing rows of one id apart until the caller chooses among them.  Equal rows share it and are cut
    # alike, so their sum is parted by the number of first chunks; a key per row would not survive a repeated task.
    big = rows.where(F.length(text_col) > big_chars).withColumn("row", F.xxhash64(*cols, text_col))
    pieces_ = base.arrow_map(big, cut, f"{schema}, row long, chunk string, first int").repartition(df.sparkSession.sparkContext.defaultParallelism * 3, F.rand(7))
    summed = base.arrow_map(pieces_, parts, f"{schema}, row long, first int, n long").groupBy(*[c for c in cols if not kinds[c].startswith("map")], "row").agg(F.sum("n").alias("n"), F.sum("first").alias("copies"))
    each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("n_tokens", F.expr("n div copies"))
    return small.union(each.select(*cols, "n_tokens"))


def clean_category(c: str | Column) -> Column:
    """Lower case, trimmed, separators as one underscore; null and blank give 'unknown'."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"^[\s\-_]+|[\s\-_]+$", ""), r"[\s\-_]+", "_")
    return F.when(s == "", None).otherwise(s)


def clean_lang(c: str | Column) -> Column:
    s = F.substring_index(F.lower(F.trim(c)), "-", 1)
    return F.when(s.isin("ta", "tanglish", "en", "code_mixed", "other"), s)


def record_tokens(shards: DataFrame, pieces: DataFrame, big_chars: int = BIG_CHARS) -> DataFrame:
    """(id, source, lang, category, n_tokens): each id once, by its latest delivery."""
    rows = document_tokens(shards.where("id is not null"), pieces, "id", "text", ["written_at", "source", "lang", "category"], big_chars)
    one = base.latest(rows, "id", "written_at", ["source", "lang", "category", "n_tokens"])
    unknown = F.lit("unknown")
    return one.select("id", F.coalesce("source", unknown).alias("source"), F.coalesce(clean_lang("lang"), unknown).alias("lang"), F.coalesce(clean_category("category"), unknown).alias("category"), "n_tokens")


def slice_totals(records: DataFrame) -> DataFrame:
    """Totals of every slice, and of every roll-up of source, language and category ('*': all)."""
    return (
        records.cube("source", "lang", "category")
        .agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("n_tokens"), F.grouping_id().alias("level"))
        .select(*[F.coalesce(c, F.lit("*")).alias(c) for c in ("source", "lang", "category")], "docs", "n_tokens", "level")
    )
