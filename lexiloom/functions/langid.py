"""Rule-based language label from script shares and word lists."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wordlists
from .chars import as_col, bind, ratio
from .script import script_counts

LATIN_WORD = r"([A-Za-z]+(?:'[A-Za-z]+)?)"


@dataclass(frozen=True)
class LangIdConfig:
    min_letters: int = 20
    tamil_min_ratio: float = 0.60
    code_mixed_min_latin: float = 0.15
    code_mixed_min_tamil: float = 0.15
    latin_min_ratio: float = 0.80
    tanglish_min_score: float = 0.12
    english_min_score: float = 0.08
    suffix_weight: float = 0.5
    #: Words of romanised Tamil: a file with one a line, or the words (see ``wordlists.learned_lexicon``); None: endings only.
    lexicon: str | tuple[str, ...] | None = None
    english_stopwords: str | None = None

    @classmethod
    def from_dict(cls, d: Mapping[str, Any] | None) -> "LangIdConfig":
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in dict(d or {}).items() if k in known})


def member(x: Column, members: Sequence[str]) -> Column:
    """Set membership as IN, which Spark turns into a hash lookup."""
    return x.isin(*sorted(members)) if members else F.lit(False)


def latin_words(c: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(as_col(c), F.lit("")), F.lit(LATIN_WORD), 1), F.lower)


def latin_scores(c: str | Column, cfg: LangIdConfig = LangIdConfig()) -> tuple[Column, Column]:
    """(share of romanised Tamil words, share of English function words); 0 without words."""
    return word_scores(latin_words(c), cfg)


def word_scores(words: Column, cfg: LangIdConfig) -> tuple[Column, Column]:
    lexicon = wordlists.load_words(cfg.lexicon) if isinstance(cfg.lexicon, str) else frozenset(cfg.lexicon or ())
    english = wordlists.load_words(cfg.english_stopwords) if cfg.english_stopwords else frozenset(wordlists.ENGLISH)
    ending = "(?:" + "|".join(wordlists.ROMANISED_ENDINGS) + ")$"
    known = F.size(F.filter(words, lambda w: member(w, lexicon)))
    likely = F.size(F.filter(words, lambda w: ~member(w, lexicon) & (F.length(w) >= 5) & ~member(w, english) & w.rlike(ending)))
    common = F.size(F.filter(words, lambda w: member(w, english)))
    n = F.size(words)
    return ratio(known + likely * F.lit(cfg.suffix_weight), n), ratio(common, n)


def detect(c: str | Column, cfg: LangIdConfig = LangIdConfig(), english_ok: Column | None = None) -> Column:
    """struct(lang, tamil_ratio, latin_ratio, tanglish_score, english_score), shares to 4 places.

    Scores are 0 where an earlier rule already decided.  ``english_ok`` is an optional second opinion on English.
    """
    t = as_col(c)
    n = script_counts(t)
    counted = F.struct(*[n[k].alias(k) for k in ("tamil", "latin", "other")])
    ok = F.lit(True) if english_ok is None else english_ok

    def scored(x: Column) -> Column:
        letters = x.tamil + x.latin + x.other
        tamil, latin = ratio(x.tamil, letters), ratio(x.latin, letters)
        early = (letters < cfg.min_letters) | (tamil >= cfg.tamil_min_ratio)
        nothing = F.struct(F.lit(0.0).alias("tang"), F.lit(0.0).alias("eng"))
        late = bind(latin_words(t), lambda w: F.struct(*[v.alias(k) for k, v in zip(("tang", "eng"), word_scores(w, cfg))]))
        return F.struct(letters.alias("letters"), tamil.alias("tamil"), latin.alias("latin"), F.when(early, nothing).otherwise(late).alias("s"))

    return bind(bind(counted, scored), lambda x: _decided(x, cfg, ok))


def _decided(x: Column, cfg: LangIdConfig, english_ok: Column) -> Column:
    letters, tamil, latin, tang, eng = x.letters, x.tamil, x.latin, x.s.tang, x.s.eng
    few = letters < cfg.min_letters
    mostly = tamil >= cfg.tamil_min_ratio
    both = (tamil >= cfg.code_mixed_min_tamil) & (latin >= cfg.code_mixed_min_latin)
    lang = (
        F.when(few, "other")
        .when(mostly & (latin >= cfg.code_mixed_min_latin), "code_mixed").when(mostly, "ta").when(both, "code_mixed")
        .when((latin >= cfg.latin_min_ratio) & (tang >= cfg.tanglish_min_score) & (tang >= eng * 0.5), "tanglish")
        .when((latin >= cfg.latin_min_ratio) & (eng >= cfg.english_min_score) & english_ok, "en")
        .otherwise("other")
    )
    return F.struct(lang.alias("lang"), F.round(tamil, 4).alias("tamil_ratio"), F.round(latin, 4).alias("latin_ratio"), F.round(tang, 4).alias("tanglish_score"), F.round(eng, 4).alias("english_score"))


def allowed(lang: str | Column, langs: Sequence[str]) -> Column:
    """Null for an allowed label, else the reason ``lang_<label>``."""
    return F.when(~as_col(lang).isin(*langs), F.concat(F.lit("lang_"), as_col(lang)))


def route(lang: str | Column, hint: str | None, category: str, override: Mapping[str, str] = {}, default: Mapping[str, str] = {}) -> Column:
    """Category of a label: the source's own for its hinted language, else override, default map, the label itself."""
    c = as_col(lang)
    maps = [F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), c) for m in (override, default) if m]
    rest = F.coalesce(*maps, c)
    return F.when(c == hint, F.lit(category)).otherwise(rest) if hint else rest
