"""Spoken Tamil rewrites and transliteration into Latin letters."""

from __future__ import annotations

import random
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import TAMIL_DIGITS, VIRAMA, as_col, sub

# Written endings and their spoken forms, applied in this order where the word ends.
SPOKEN_RULES = [
    ("இருக்கிறது", "இருக்கு"), ("இருக்கின்றது", "இருக்கு"), ("இருக்கிறேன்", "இருக்கேன்"), ("இருக்கிறாய்", "இருக்கே"),
    ("இருக்கிறீர்கள்", "இருக்கீங்க"), ("இருக்கிறார்கள்", "இருக்காங்க"), ("இருக்கின்றனர்", "இருக்காங்க"), ("இருக்கிறார்", "இருக்காரு"),
    ("இருந்தது", "இருந்துச்சு"), ("வருகிறேன்", "வரேன்"), ("வருகிறது", "வருது"), ("வருகிறார்கள்", "வராங்க"),
    ("வருகிறார்", "வராரு"), ("வருகிறான்", "வரான்"), ("வருகிறாள்", "வரா"), ("க்கிறேன்", "க்குறேன்"),
    ("க்கிறோம்", "க்குறோம்"), ("க்கிறாய்", "க்குற"), ("க்கிறீர்கள்", "க்குறீங்க"), ("க்கிறார்கள்", "க்குறாங்க"),
    ("க்கின்றனர்", "க்குறாங்க"), ("க்கிறார்", "க்குறாரு"), ("க்கிறது", "க்குது"), ("க்கின்றது", "க்குது"),
    ("க்கிறான்", "க்குறான்"), ("க்கிறாள்", "க்குறா"), ("கிறேன்", "றேன்"), ("கின்றேன்", "றேன்"),
    ("கிறோம்", "றோம்"), ("கிறாய்", "றே"), ("கிறீர்கள்", "றீங்க"), ("கிறார்கள்", "றாங்க"),
    ("கின்றனர்", "றாங்க"), ("கிறார்", "றாரு"), ("கிறது", "குது"), ("கின்றது", "குது"),
    ("கிறான்", "றான்"), ("கிறாள்", "றா"), ("வில்லை", "ல"), ("அவர்கள்", "அவங்க"),
    ("இவர்கள்", "இவங்க"), ("நீங்கள்", "நீங்க"), ("நாங்கள்", "நாங்க"), ("உங்கள்", "உங்க"),
    ("எங்கள்", "எங்க"), ("ர்கள்", "ங்க"), ("இல்லை", "இல்ல"), ("வேண்டும்", "வேணும்"),
    ("எப்படி", "எப்டி"), ("இப்போது", "இப்போ"), ("அப்போது", "அப்போ"), ("எப்போது", "எப்போ"),
    ("இங்கே", "இங்க"), ("அங்கே", "அங்க"), ("எங்கே", "எங்க"), ("ஆமாம்", "ஆமா"),
]

# Latin letters of vowels, vowel signs and consonants.
VOWELS = {
    "அ": "a", "ஆ": "aa", "இ": "i", "ஈ": "ee", "உ": "u", "ஊ": "oo", "எ": "e", "ஏ": "e",
    "ஐ": "ai", "ஒ": "o", "ஓ": "o", "ஔ": "au", "ஃ": "h",
}
SIGNS = {
    "ா": "aa", "ி": "i", "ீ": "ee", "ு": "u", "ூ": "oo", "ெ": "e", "ே": "e", "ை": "ai",
    "ொ": "o", "ோ": "o", "ௌ": "au",
}
PLAIN = {
    "ங": "ng", "ஞ": "nj", "ண": "n", "ந": "n", "ம": "m", "ய": "y", "ர": "r", "ல": "l",
    "வ": "v", "ழ": "zh", "ள": "l", "ன": "n", "ஜ": "j", "ஷ": "sh", "ஸ": "s", "ஹ": "h",
    "ஶ": "sh",
}
# Stops sound by place: at the start, doubled, after a nasal, between vowels, after another consonant.
STOPS = {
    "க": ("k", "kk", "g", "g", "k"), "ச": ("s", "ch", "j", "s", "ch"),
    "ட": ("t", "tt", "d", "d", "t"), "த": ("th", "th", "dh", "dh", "th"),
    "ப": ("p", "pp", "b", "p", "p"), "ற": ("r", "tr", "dr", "r", "r"),
}
NASALS = frozenset("ஙஞணநமன")
# Spellings that people vary, tried in this order.
VARIANTS = (("aa", "a"), ("ee", "i"), ("oo", "u"), ("zh", "l"), ("dh", "th"), ("th", "t"))
SENTENCE = re.compile(r"(?<=[.!?।])\s+")
_RUN = re.compile("[஀-௿]+")
_SYLLABLE = re.compile(rf"(?P<stop>[{''.join(STOPS)}])(?P<s1>[{''.join(SIGNS)}{VIRAMA}]?)|(?P<plain>[{''.join(PLAIN)}])(?P<s2>[{''.join(SIGNS)}{VIRAMA}]?)|(?P<vowel>[{''.join(VOWELS)}])|(?P<rest>.)", re.S)


def colloquialize(c: str | Column) -> Column:
    """Spoken forms; a fold over the rules, each bound to the end of a word.  Null stays null."""
    out = as_col(c)
    for written, spoken in SPOKEN_RULES:
        out = sub(out, written + r"(?![\p{L}\p{M}])", spoken)
    return out


_SPOKEN_RE = None


def colloquialize_text(text: str) -> str:
    global _SPOKEN_RE
    if _SPOKEN_RE is None:
        import regex

        _SPOKEN_RE = [(regex.compile(a + r"(?![\p{L}\p{M}])"), b) for a, b in SPOKEN_RULES]
    for pattern, to in _SPOKEN_RE:
        text = pattern.sub(to, text)
    return text


def latin_word(word: str) -> str:
    """One run of Tamil script in Latin letters."""
    if word == "ஸ்ரீ":
        return "sri"
    cells = [(m.group("stop") or m.group("plain"), m.group("s1") or m.group("s2") or "", m.group("vowel"), m.group("rest")) for m in _SYLLABLE.finditer(word)]
    out = []
    # ``left``: the consonant just before, if it carries a virama ('' if a vowel follows it); None at a word's start.
    left: str | None = None
    closed = False
    for at, (cons, sign, vowel, rest) in enumerate(cells):
        if vowel:
            out.append(VOWELS[vowel])
            left, closed = "", False
            continue
        if rest:
            out.append(str(TAMIL_DIGITS.index(rest)) if rest in TAMIL_DIGITS else rest)
            left, closed = None, False
            continue
        following = cells[at + 1][0] if at + 1 < len(cells) else None
        mute = sign == VIRAMA
        if mute and following and following == cons and cons in STOPS:
            pass  # its twin speaks for both
        elif mute and following and cons in "ஙஞ":
            out.append("n")
        else:
            if cons in PLAIN:
                out.append(PLAIN[cons])
            elif left is None:
                out.append(STOPS[cons][0])
            elif closed:
                out.append(STOPS[cons][1 if left == cons else 2 if left in NASALS else 4])
            else:
                out.append(STOPS[cons][3])
            out.append("" if mute else SIGNS.get(sign, "a"))
        left, closed = cons, mute
    return "".join(out)


def latin_text(text: str, variant_prob: float = 0.0, rng: random.Random | None = None) -> str:
    """Tamil runs in Latin letters, the rest as it is; each spelling variant taken with a probability per word."""

    def one(m: re.Match) -> str:
        word = latin_word(m.group())
        if variant_prob and rng:
            for a, b in VARIANTS:
                if a in word and rng.random() < variant_prob:
                    word = word.replace(a, b)
        return word

    return _RUN.sub(one, text)


def transliterate(c: str | Column, key: str | Column | None = None, variant_prob: float = 0.0, sentence_prob: float = 0.0, seed: int = 7) -> Column:
    """Transliterated text.  With probabilities, draws are seeded by the row's key, so they don't depend on partitions."""
    keys = F.lit("") if key is None else as_col(key).cast("string")

    @F.pandas_udf("string")
    def run(text: pd.Series, key_: pd.Series) -> pd.Series:
        out = []
        for t, k in zip(text, key_):
            if t is None:
                out.append(None)
                continue
            rng = random.Random(f"{seed}:{k}")
            if sentence_prob:
                out.append(" ".join(latin_text(p, variant_prob, rng) if rng.random() < sentence_prob else p for p in SENTENCE.split(t)))
            else:
                out.append(latin_text(t, variant_prob, rng))
        return pd.Series(out, dtype=object)

    return run(as_col(c), keys)
