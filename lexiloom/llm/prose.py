"""Per-document text statistics, and prose told from lists, tables and junk by robust Mahalanobis distance.

Texts are cut into units (lines, cut again after sentence marks).  Each unit has the statistics in ``STATS``, its number
of words among them.  The
prose mean and covariance of all units of a language are estimated robustly: they start from units that look like
sentences and are re-estimated on the units within the 95 % distance (concentration steps, all units of all
documents, as sums), until what is kept has settled.  A unit is an outlier beyond CUTOFF; only deviations away from prose count (more common words
than usual is no fault).  A record is not prose when more than half of its words lie in outlying units.

Common words are learned from the corpus: words that hardly occur in structured lines (short lines, lines with separators,
bullets, many commas or trailing numbers) relative to the other words of their language.  How rarely a word is listed and
how frequent it is are weighed as odds, so that where a language has few listings its frequent words count.  A frequency
share within the language (in other languages, the script) bounds their number by ``1 / MIN_SHARE`` each.

Defined results: null and blank texts have no words, zero statistics and are not prose (is_prose false, distance 0);
texts without words are judged by their characters.  Repeated ids count once, the latest delivery stands.  A text that more
than a thousandth of the rows repeat counts once in the statistics, and each of its rows is judged.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, language

STATS = ("mean_word_len", "symbol_ratio", "digit_share", "single_share", "common_share", "line_end_share", "log_words")
#: +1: only higher values are suspect, -1: only lower ones, 0: both.
SIDES = np.array([0, 1, 1, 1, -1, -1, -1])
SAMPLES, REMEMBERED = 5000, 400_000
MIN_SHARE = 1 / 30_000
#: Listings of words of running text and of listed words, as parts of their language's; and how far above the mean the
#: frequency lies that speaks for running text where listings say nothing.
RUNNING, LISTED, FREQUENT = 0.1, 1.05, 2.0
#: To estimate 95 % of the chi-square of 7 statistics are kept; beyond CUTOFF lie 0.03 % of units, as six deviations of
#: seven count on one side only.
TRIM, CUTOFF = 14.07, 22.46
STEPS, SETTLED = 10, 1e-3  # concentration steps at most, and the change of the units kept below which they end
#: Least spread of each statistic: keeps the covariance regular where a language shows none.
FLOOR = np.array([0.7, 0.03, 0.08, 0.06, 0.12, 0.45, 1.0])
_PURE = regex.compile(r"^[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)*$")
_EDGE = regex.compile(r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$")
_LISTED = regex.compile(r"[\t|;#=]|\S {3,}\S|^\s*(?:[^\p{L}\p{M}\p{N}\s\"'“‘(¿¡]|\(?\w{1,3}[.)])\s|: *\d|\d\s*$")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_CUT = re.compile(r"(?<=[.!?।॥…\"'”’)\]])\s+")
_CLOSING = "\"'”’)]"


def sentence_end(piece: str) -> bool:
    """Whether the last sign before any other marks ends a sentence."""
    for c in reversed(piece):
        if c in language.END:
            return True
        if c.isalnum() or unicodedata.category(c)[0] == "M":
            return False
    return False


def cut_sentences(line: str) -> list[str]:
    """Cut at white space behind a sentence mark, closing quotes and brackets between them allowed."""
    out, at = [], 0
    for m in _CUT.finditer(line):
        end = m.start() - 1
        while end >= at and line[end] in _CLOSING:
            end -= 1
        if end >= at and line[end] in language.END:
            out.append(line[at : m.start()])
            at = m.end()
    out.append(line[at:])
    return out


def hot_texts(df: DataFrame, text_col: str) -> dict[int, float]:
    """Weights of the texts that more than 1 / HOT_SHARE of the rows repeat, by Spark's hash: together they count as one.

    Such texts are fewer than HOT_SHARE.  Without this the copies of one text would set the statistics of a language.
    """
    n = df.where(F.col(text_col).isNotNull()).groupBy(F.xxhash64(text_col).alias("h")).agg(F.count("*").alias("n"))
    whole = df.count()
    return {r.h: 1.0 / r.n for r in n.where((F.col("n") > 1) & (F.col("n") * base.HOT_SHARE > whole)).collect()}


def count_words(df: DataFrame, text_col: str, weights: dict[int, float] | None = None) -> DataFrame:
    """(word, n, listed): occurrences over all texts, and those in structured lines; texts in ``weights`` count by them."""
    weights = weights or {}
    memo: dict[str, str] = {}  # lives as long as the task

    def run(cols: dict) -> dict:
        every: dict[str, float] = {}
        listed: dict[str, float] = {}
        if len(memo) > REMEMBERED:
            memo.clear()
        for text, h in zip(cols["text"].to_pylist(), cols["h"].to_pylist()):
            one = weights.get(h, 1)
            for line in (text or "").split("\n"):
                if not line or line.isspace():
                    continue
                tokens = parts_of(language.unspaced(line).lower())
                found = []
                for t in tokens:
                    w = memo.get(t)
                    if w is None:
                        w = _EDGE.sub("", t)
                        w = memo[t] = w if _PURE.match(w) else ""
                    if w:
                        found.append(w)
                for w in found:
                    every[w] = every.get(w, 0) + one
                if len(found) <= 3 or 2 * line.count(",") >= len(found) or _LISTED.search(line):
                    for w in found:
                        listed[w] = listed.get(w, 0) + one
        return {"word": list(every), "n": list(every.values()), "listed": [listed.get(w, 0) for w in every]}

    source = df.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    parts = base.arrow_map(source, run, "word string, n double, listed double")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("listed").alias("listed"))


def common_words(counts: DataFrame, model: language.LanguageModel) -> frozenset[str]:
    """At most 1 / MIN_SHARE words of each language, or script of other languages, come to the driver, whatever the corpus."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def group(cols: dict) -> dict:
        out = []
        for word in cols["word"].to_pylist():
            costs = shared.value.costs(word)
            lang = language.LANGS[min(range(4), key=lambda i: (costs[i], i))]
            out.append(f"{lang}/{script(word)}" if lang == "other" else lang)
        return {"group": out, **{c: cols[c] for c in ("word", "n", "listed")}}

    counts = base.materialize(base.arrow_map(counts, group, "group string, word string, n double, listed double"), "words")
    least = {r["group"]: r.total * MIN_SHARE for r in counts.groupBy("group").agg(F.sum("n").alias("total")).collect()}
    if not least:
        return frozenset()
    floor = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    groups: dict[str, list] = {}
    for r in counts.where(F.col("n") >= floor[F.col("group")]).collect():
        groups.setdefault(r["group"], []).append(r)
    out = set()
    for members in groups.values():
        n, listed = (np.array([r[c] for r in members], dtype=float) for c in ("n", "listed"))
        rate, usual = listed.sum() / n.sum(), n.mean()
        # Log odds that a word's listings are those of a running-text word and not those of a listed one, and from the
        # start the better the more frequent it is.
        odds = np.log(n / (FREQUENT * usual)) + listed * np.log(RUNNING / LISTED) + n * rate * (LISTED - RUNNING)
        out |= {r.word for r, x in zip(members, odds) if x > 0}
    return frozenset(out)


@lru_cache(100_000)
def _script_of(c: str) -> str:
    """Script of a letter or of a script's own mark; '' for all else, and for accents, which belong to the letter before."""
    if unicodedata.category(c)[0] not in "LM":
        return ""
    name = unicodedata.name(c, "").split(" ")[0]
    return "" if name == "COMBINING" else name


def script(text: str | None) -> str:
    """Name of the script of most letters of the whole text (TAMIL, LATIN, ...); '' without letters."""
    counts: dict[str, int] = {}
    for c, n in Counter(text or "").items():
        name = _script_of(c)
        if name:
            counts[name] = counts.get(name, 0) + n
    return max(counts, key=counts.get) if counts else ""


_SCRIPTS = (regex.compile(r"[஀-௿]"), regex.compile(r"\p{Latin}"), regex.compile(r"[^\P{L}஀-௿\p{Latin}]"))


def model_key(lang: str, unit: str) -> int:
    """Which prose model a unit is held against: its language's, for "other" that of the script, and in mixed documents
    that of the unit's own scripts.  A small number, exact in 32-bit floats."""
    name = lang
    if lang == "other":
        name = f"other/{script(unit)}"
    elif lang == "code_mixed":
        tamil, latin, rest = (bool(x.search(unit)) for x in _SCRIPTS)
        if tamil and not latin and not rest:
            name = "ta"
        elif rest and not tamil and not latin:
            name = f"other/{script(unit)}"
        elif latin and not tamil and not rest:
            name = "code_mixed/LATIN"
    return zlib.crc32(name.encode()) % (1 << 23)


class UnitStats:
    """Statistics of the units of a text; tokens are looked at once per worker."""

    def __init__(self, common: frozenset[str], limit: int = 300_000):
        self.common, self.limit, self.memo, self.rows = common, limit, {}, []
        self.start()

    def _token(self, t: str) -> tuple[int, int, int, int, int]:
        core = _EDGE.sub("", t)
        letters = sum(map(len, _LETTERS.findall(t)))
        digits = sum(c.isdigit() for c in t)
        word = bool(core) and letters > 0
        if core and not letters:  # signs inside numbers and dates belong to the number
            return (len(core), 0, len(core), 0, 0, 0, 0, 1)
        return (len(t), letters, digits, 1 if letters == 1 and len(core) == 1 else 0, 1 if core.lower() in self.common else 0, 1 if word else 0, len(core) if word else 0, 0)

    def start(self) -> None:
        """Begin a batch; the remembered tokens are only ever dropped here."""
        if len(self.memo) >= self.limit:
            self.memo.clear()
            self.rows.clear()
        self.flat, self.sizes, self.ends, self.keys, self.marks = [], [], [], [], []

    def add(self, text: str | None, lang: str) -> int:
        """Take up the units of a text; returns their number."""
        memo, rows, flat = self.memo, self.rows, self.flat
        before = len(self.sizes)
        for line in (text or "").split("\n"):
            if not line or line.isspace():
                continue
            pieces: list[str] = []
            ended: list[bool] = []
            for piece in cut_sentences(language.unspaced(line)):
                if pieces and not _LETTERS.search(piece):  # a date or number after a sentence belongs to it
                    pieces[-1] += " " + piece
                else:
                    pieces.append(piece)
                    ended.append(sentence_end(piece))
            for piece, end in zip(pieces, ended):
                tokens = parts_of(piece)
                if not tokens and not piece.strip():
                    continue
                for t in tokens:
                    i = memo.get(t)
                    if i is None:
                        i = memo[t] = len(rows)
                        rows.append(self._token(t))
                    flat.append(i)
                self.sizes.append(len(tokens))
                self.ends.append(end)
                self.keys.append(model_key(lang, piece))
                self.marks.append(len(piece))
        return len(self.sizes) - before

    def finish(self) -> np.ndarray:
        """One row per unit of the batch: STATS, words, characters, key of the prose model."""
        sizes, ended = np.array(self.sizes, dtype=np.int64), np.array(self.ends, dtype=np.float64)
        out = np.zeros((len(sizes), WIDTH))
        out[:, -1] = self.keys
        out[:, -2] = self.marks
        full = np.nonzero(sizes)[0]
        out[sizes == 0, 1] = 1.0  # signs alone
        if len(full):
            starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
            chars, letters, digits, single, common, n, length, numbers = np.add.reduceat(np.array(self.rows, dtype=np.float64)[self.flat], starts).T
            end = ended[full]
            out[full, 0] = length / np.maximum(n, 1)
            out[full, 1] = np.maximum(0, chars - letters - digits - end) / np.maximum(chars, 1)
            out[full, 2] = numbers / sizes[full]
            out[full, 3] = single / np.maximum(1, n)
            out[full, 4] = common / np.maximum(1, n)
            out[full, 5] = end
            out[full, 6] = np.log1p(n + numbers)
            out[full, -3] = n + numbers
            out[full, -2] = chars
        return out.astype(np.float32)


def parts_of(line: str) -> list[str]:
    return line.replace(";", " ").replace("|", " ").replace(",", " ").replace("#", " ").split()


WIDTH = len(STATS) + 3


def language_model(samples: DataFrame, most: int = SAMPLES) -> language.LanguageModel:
    """From the labelled samples: at most ``most`` rows of each language, chosen by a hash of their ids."""
    label = F.substring_index(F.lower(F.regexp_replace("lang", r"^\s+|\s+$", "")), "-", 1)
    rows = samples.where("text <> ''").select("sample_id", "text", label.alias("lang"))
    parts = [rows.where(F.col("lang") == lang).orderBy(F.xxhash64("sample_id"), "sample_id").limit(most) for lang in language.LANGS]
    texts: dict[str, list[str]] = {}
    for r in sorted(reduce(DataFrame.union, parts).collect(), key=lambda r: (r.sample_id is None, r.sample_id)):
        texts.setdefault(r.lang, []).append(r.text)
    return language.LanguageModel({k: "\n".join(v) for k, v in texts.items()})


def profile(df: DataFrame, samples: DataFrame, id_col: str = "id", text_col: str = "text", order_col: str = "written_at", label_col: str | None = "lang", with_lines: bool = False) -> tuple[DataFrame, dict]:
    """One pass over the texts after the word counts: language, lines and unit statistics of every row, in a table;
    and the robust prose model of each language."""
    spark = df.sparkSession
    model = language_model(samples)
    weights = hot_texts(df, text_col)
    shared = spark.sparkContext.broadcast((model, common_words(count_words(df, text_col, weights), model)))
    held: list = []

    def run(cols: dict) -> dict:
        if not held:
            held.extend((shared.value[0], UnitStats(shared.value[1])))
        model, stats = held
        found = {k: [] for k in ("lang", "confidence", "lines", "units")}
        stats.start()
        sizes = []
        for text in cols["text"].to_pylist():
            got = language.document_language(model, text)
            found["lang"].append(got["lang"])
            found["confidence"].append(got["confidence"])
            found["lines"].append([{"line_no": a, "lang": b, "confidence": c, "words": w} for a, b, c, w in got["lines"]] if with_lines else [])
            sizes.append(stats.add(text, got["lang"]))
        units, at = stats.finish(), np.r_[0, np.cumsum(sizes)].astype(int)
        found["units"] = [units[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
        found["weight"] = [weights.get(h, 1.0) for h in cols["h"].to_pylist()]
        return {"id": cols["id"], "at": cols["at"], "label": cols["label"], **found}

    kinds = dict(df.dtypes)
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    source = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(order_col).alias("at"), label.alias("label"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    rows = base.materialize(base.arrow_map(source, run, f"id {kinds[id_col]}, at {kinds[order_col]}, label string, lang string, confidence double, lines array<struct<line_no int, lang string, confidence double, words int>>, units binary, weight double"), "profile")
    return rows, prose_model(rows)


def scaled(x: np.ndarray) -> np.ndarray:
    """Statistics as they enter the distance: the share of common words by arcsine of its root, which evens out the
    spread of shares, so that texts with few common words and texts with none stand apart."""
    out = x.copy()
    out[:, 4] = np.arcsin(np.sqrt(np.clip(x[:, 4], 0, 1)))
    return out


def _deviation(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.where((SIDES == 0) | (np.sign(d) == SIDES), d, 0.0)


def contributions(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Each statistic's share of the squared distance; rows sum to it."""
    d = _deviation(x, mean)
    return d * (d @ inverse)


def _moments(rows: DataFrame, models: dict | None) -> dict:
    """Per language (count, sums, products) of the units taken for prose; sums of fixed size, whatever the corpus."""
    k = len(STATS)
    shared = models

    def run(cols: dict) -> dict:
        raws = cols["units"].to_pylist()
        u = np.frombuffer(b"".join(raws), dtype=np.float32).reshape(-1, WIDTH).astype(float)
        weight = np.repeat(cols["weight"].to_numpy(), [len(r) // (4 * WIDTH) for r in raws])
        out = {"model": [], "m": []}
        for key in np.unique(u[:, -1]).astype(int).tolist():
            mine = u[:, -1] == key
            own, w = u[mine], weight[mine]
            x, n = own[:, :k], own[:, k]
            if shared is None:
                keep = (n >= 4) & (x[:, 4] >= 0.15) & (x[:, 2] < 0.5)
                x = scaled(x)
            elif key in shared:
                mean, inverse, _ = shared[key]
                x = scaled(x)
                keep = (n >= 4) & (contributions(x, mean, inverse).sum(axis=1) <= TRIM)
            else:  # nothing there ever looked like a sentence
                continue
            x, w = x[keep], w[keep]
            xw = x * w[:, None]
            out["model"].append(key)
            out["m"].append([float(w.sum()), *xw.sum(axis=0), *(x.T @ xw).ravel()])
        return out

    parts = base.arrow_map(rows.select("units", "weight"), run, "model int, m array<double>")
    size = 1 + k + k * k
    agg = parts.groupBy("model").agg(F.array(*[F.sum(F.col("m")[i]) for i in range(size)]).alias("m"))
    out = {}
    for r in agg.collect():
        m = np.array(r.m)
        if m[0] >= 10:
            mean = m[1 : 1 + k] / m[0]
            cov = m[1 + k :].reshape(k, k) / m[0] - np.outer(mean, mean)
            # Spread of at least FLOOR, and less trust in correlations the fewer units there are.
            short = np.maximum(0, FLOOR**2 - np.diag(cov)) + 0.05 * FLOOR**2
            weight = m[0] / (m[0] + 20 * k)
            cov = weight * cov + (1 - weight) * np.diag(np.diag(cov))
            out[r.model] = (mean, np.linalg.inv(cov + np.diag(short)), m[0])
    return out


def prose_model(rows: DataFrame) -> dict:
    """(mean, inverse covariance) per model: from units that look like sentences, then by concentration steps, each over
    all units, until the units kept hardly change."""
    models = _moments(rows, None)
    for _ in range(STEPS):
        after = {**models, **_moments(rows, models)}
        moved = sum(abs(after[k][2] - models[k][2]) for k in models)
        models = after
        if moved <= SETTLED * sum(m[2] for m in models.values()):
            break
    return {k: (mean, inverse) for k, (mean, inverse, _) in models.items()}


def judged(rows: DataFrame, models: dict, keep: list[str]) -> DataFrame:
    """Statistics, distance, contributions and verdict of every row; ``keep`` columns are carried along."""
    k = len(STATS)
    spread = list(models.values())
    fallback = (np.mean([m for m, _ in spread], axis=0), np.mean([i for _, i in spread], axis=0)) if spread else (np.zeros(k), np.eye(k))

    def run(cols: dict) -> dict:
        raws = cols["units"].to_pylist()
        sizes = np.array([len(r) // (4 * WIDTH) for r in raws], dtype=np.int64)
        owner = np.repeat(np.arange(len(raws)), sizes)
        u = np.frombuffer(b"".join(raws), dtype=np.float32).reshape(-1, WIDTH).astype(float)
        x, n, chars = u[:, :k], u[:, k], u[:, k + 1]
        c = np.zeros_like(x)
        for key in np.unique(u[:, -1]):
            own = u[:, -1] == key
            c[own] = contributions(scaled(x[own]), *models.get(int(key), fallback))
        add = lambda w: np.bincount(owner, weights=w, minlength=len(raws))
        words = add(n)
        weight = np.where(words[owner] > 0, n, chars)
        total = add(weight)
        whole = np.maximum(total, 1e-12)
        distance = c.sum(axis=1)
        share = np.where(total > 0, add(weight * (distance > CUTOFF)) / whole, 1.0)
        out = {"n_words": words.astype(np.int32), "outlier_share": share, "is_prose": (total > 0) & (share <= 0.5)}
        out["distance"] = np.sqrt(np.maximum(0.0, add(weight * distance) / whole))
        for i, s in enumerate(STATS):
            out[s] = add(weight * x[:, i]) / whole
            out[f"c_{s}"] = add(weight * c[:, i]) / whole
        return {c: cols[c] for c in keep} | out

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "n_words int", *(f"{s} double" for s in STATS), "distance double, outlier_share double, is_prose boolean", *(f"c_{s} double" for s in STATS)])
    return base.arrow_map(rows.select(*dict.fromkeys([*keep, "units"])), run, schema)


def text_statistics(df: DataFrame, samples: DataFrame, id_col: str = "id", text_col: str = "text", order_col: str = "written_at") -> DataFrame:
    """One row per id: language, statistics, distance, contributions and is_prose."""
    rows, models = profile(df, samples, id_col, text_col, order_col, None)
    numbers = ["lang", "n_words", *STATS, "distance", "outlier_share", "is_prose", *(f"c_{s}" for s in STATS)]
    return base.latest(judged(rows, models, ["id", "at", "lang"]), "id", "at", numbers).withColumnsRenamed({"id": id_col})


def languages(df: DataFrame, samples: DataFrame, id_col: str = "id", text_col: str = "text", order_col: str = "written_at", label_col: str = "lang") -> DataFrame:
    """One row per id: stored label, true language, confidence, prose or not, and the labelled lines."""
    rows, models = profile(df, samples, id_col, text_col, order_col, label_col, with_lines=True)
    keep = ["id", "at", "label", "lang", "confidence", "lines"]
    return base.latest(judged(rows, models, keep), "id", "at", ["label", "lang", "confidence", "is_prose", "lines"])
