"""Defective prompt and response pairs, each with the kinds of its defect.

empty: nothing but spaces, marks, markup or a placeholder.  truncated: one stack of a pushdown parser holds the open
fences, tags, brackets, quotations, list entries and sentences; what is left on it at the end of the text decides, if a
whole sentence came before.  refusal: a grammar of openers, refusing cores and closers covers the answer, outside
quotations, but for at most one sentence of 12 words.  copy: greedy string tiling covers both the answer and the
instruction.  wrong_language: script and cross-parsing language against the language asked for, else the instruction's;
below 16 letters languages of one script aren't told apart.

Defined results: a null instruction asks for nothing, so only empty, truncated and refusal apply; repeated ids count
once, the latest delivery stands; an empty answer has no further defect.
"""

from __future__ import annotations

import heapq
import html
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, language, prose

KINDS = ("empty", "truncated", "refusal", "copy", "wrong_language")
# What stands for an answer that was never written.
PLACEHOLDERS = frozenset("none null nil nan n/a na tbd todo tba undefined empty blank placeholder answer output response text here".split())
_TAG = regex.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|```\w*|&\w+;")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_END = regex.compile(r"[.!?।॥…][^\p{L}\p{N}]*$")
_WHOLE = regex.compile(r"[.!?।॥…](?=[\"'”’)\]]*(?:\s|$))")
_ITEM = regex.compile(r"^\s*(?:[-*•▪◦‣·–—✓+]|\(?(?:\d{1,3}|[a-zA-Z])[.):]|#\d+|\d{1,3}\s*[-–])\s+")
OPEN, CLOSE = "([{“‘«", ")]}”’»"


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    return _TOKEN.findall(unicodedata.normalize("NFC", html.unescape(text) if "&" in text else text).lower())


@lru_cache(200_000)
def token_of(part: str) -> str | None:
    """The one token of a part between spaces; None if it has none or several."""
    got = tokens(part)
    return got[0] if len(got) == 1 else None


def without_markup(output: str) -> str:
    return _TAG.sub(" ", output) if "<" in output or "`" in output or "&" in output else output


def is_empty(output: str | None, bare: str | None = None, words: list[str] | None = None) -> bool:
    """bare, words: the output without markup and its tokens, where they are known already."""
    if output is None:
        return True
    bare = without_markup(output) if bare is None else bare
    words = tokens(bare) if words is None else words
    return not words or (len(words) <= 3 and bool(_words_of_placeholder(bare)))


def _words_of_placeholder(bare: str) -> bool:
    got = regex.sub(r"^[\s\p{P}\p{S}]+|[\s\p{P}\p{S}]+$", "", bare.lower())
    return got in PLACEHOLDERS or got.replace("_", " ") in ("no answer", "no output", "no response", "not available", "your answer here", "to be done", "insert answer here", "fill in", "coming soon")


# Elements whose end tag can't be left out, and short forms whose full stop ends no sentence.
PAIRED_TAGS = frozenset("a abbr article aside b blockquote body button code details div dl em figure footer form h1 h2 h3 h4 h5 h6 head header html i label main nav ol pre script section select span strong style sub summary sup table textarea title u ul".split())
SHORT_FORMS = frozenset("mr mrs ms dr prof st no vs e.g i.e etc fig eq vol pp cf approx jr sr".split())
_CLOSERS_AT = r"[^\p{L}\p{N}\s]*"
_PARTS = regex.compile(
    rf"""(?P<fence>^[ \t]*```[^\n]*)|(?P<item>^[ \t]*(?:[-*•▪◦‣·–—✓+]|\(?(?:\d{{1,3}}|[a-zA-Z])[.):]|\#\d+|\d{{1,3}}[ \t]*[-–])(?=[ \t]|$))|(?P<tag></?[A-Za-z][A-Za-z0-9]*(?:\s+[\w:-]+(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))?)*\s*/?>)
    |(?P<face>[:;]-?[()\[\]])(?=\s|$)|(?P<end>[.!?।॥…]+)(?={_CLOSERS_AT}(?:\s|$))|(?P<open>[(\[{{“‘«])|(?P<close>[)\]}}”’»])|(?P<quote>")|(?P<line>\n)|(?P<words>[^\n()\[\]{{}}“”‘’«»"<.!?।॥…:;]+|.)""",
    regex.X | regex.M,
)
_INK = regex.compile(r"[\p{L}\p{N}]")


class Pushdown:
    """One stack of open structures: fences, tags, brackets, quotations, list items, and the sentences inside them.

    A word opens a sentence in the innermost structure, an end mark closes it, a closing sign closes its structure with
    whatever is open inside.  Lines and entries that end without a mark close their sentence as well; how many did so
    says whether the last one may.
    """

    def __init__(self, text: str):
        self.stack: list[str] = []
        self.wholes = 0  # sentences closed by an end mark
        self.entries: list[tuple[bool, int]] = []  # list entries closed so far: by an end mark, and of how many words?
        self.words = 0  # of the line or entry
        self.lines: list[bool] = []  # likewise lines outside lists
        self.marked = False  # the last words of the line were closed by an end mark
        self.inked = False  # the line or entry holds words
        fence = False
        last = ""
        for m in _PARTS.finditer(text):
            kind, got = m.lastgroup, m.group()
            if kind == "fence":
                fence = not fence
                if fence:
                    self.stack.append("fence")
                else:
                    self._close("fence")
            elif fence:
                continue
            elif kind == "words":
                if _INK.search(got):
                    if not self.stack or self.stack[-1] != "sentence":
                        self.stack.append("sentence")
                    self.marked, self.inked, last = False, True, got
                    self.words += len(got.split())
            elif kind == "end":
                self._end(got, last, m.end() == len(text) or text[m.end()] == "\n")
            elif kind == "open":
                if not (self.stack and self.stack[-1] == CLOSE[OPEN.index(got)] and got in "“‘«"):  # reopened in a new paragraph
                    self.stack.append(CLOSE[OPEN.index(got)])
            elif kind == "close":
                self._close(got)
            elif kind == "quote":
                if '"' in self.stack:
                    self._close('"')
                elif not (last[-1:].isdigit() and m.start() and text[m.start() - 1].isdigit()):  # not an inch
                    self.stack.append('"')
            elif kind == "tag":
                self._tag(got)
            elif kind == "item":
                self._line_end()
                self._close("item")
                self.stack.append("item")
                self.inked, self.marked, self.words = False, False, 0
            elif kind == "line":
                self._line_end()
        self.unfinished = self.stack and self.stack[-1] == "sentence" and not fence

    def _close(self, what: str) -> None:
        """Close the innermost structure of this kind with all that is open inside; without one the sign means nothing."""
        if what not in self.stack:
            return
        at = len(self.stack) - 1 - self.stack[::-1].index(what)
        if what == "item" and self.inked:
            self.entries.append((self.marked, self.words))
        del self.stack[at:]
        # An end mark just inside a quotation or bracket ends the sentence around it as well.
        if what not in ("item", "fence") and self.marked and self.stack and self.stack[-1] == "sentence":
            self.stack.pop()

    def _end(self, mark: str, last: str, at_line_end: bool) -> None:
        word = last.split()[-1].lower() if last.split() else ""
        if mark == "." and not at_line_end and (word in SHORT_FORMS or (len(word) == 1 and word.isascii() and word.isalpha())):
            return
        if self.stack and self.stack[-1] == "sentence":
            self.stack.pop()
            self.wholes += 1
            self.marked = True

    def _tag(self, tag: str) -> None:
        name = regex.match(r"</?([A-Za-z0-9]+)", tag).group(1).lower()
        if name in PAIRED_TAGS and not tag.endswith("/>"):
            if tag[1] == "/":
                self._close(f"<{name}")
            else:
                self.stack.append(f"<{name}")

    def _line_end(self) -> None:
        """Outside brackets and quotations a line ends its sentence; an entry goes on until the next one begins."""
        if not self.inked or "item" in self.stack:
            return
        self.lines.append(self.marked)
        if self.stack and self.stack[-1] == "sentence":
            self.stack.pop()
        self.inked = self.marked = False

    def breaks_off(self) -> bool:
        if not self.wholes or not self.stack:
            return False
        open_ = [x for x in self.stack if x not in ("item", "sentence")]
        if open_:
            return True
        if not self.unfinished:  # an entry that was opened but holds nothing
            return self.stack[-1] == "item" and not self.inked and bool(self.entries)
        if "item" in self.stack:  # entries need no end mark where others have none, or where some have none and are no longer
            marks = [marked for marked, _ in self.entries]
            return all(marks) or (any(marks) and self.words < min(n for _, n in self.entries))
        # Nor do lines of verse or of an address.
        return not (len(self.lines) > 2 and sum(self.lines) < 0.3 * len(self.lines))


def breaks_off(text: str) -> bool:
    """Whether the stack of the pushdown parser is left with something that wants closing, after a whole sentence."""
    return Pushdown(unsigned(text.rstrip("\u200b\ufeff \t\r\n"))).breaks_off()


#: A source or signature behind the last sentence, sought from the end.
_SIGNED = regex.compile(r"(?<=[.!?।॥…][\"'”’)\]]*)\s*(?:[\[(][^\[\]()]{1,40}[\])]|[–—\-~]\s*[\p{L}\p{M}\p{N} .]{1,40})\s*$", regex.R)


def unsigned(text: str) -> str:
    signed = _SIGNED.search(text)
    return text[: signed.start()] if signed else text


# --- refusals: openers, cores and closers; a refusal has a core and little besides them -------------------------------
_OPENERS = r"""
(?:i(?:['’]m| am)\s+(?:very |so |really )?(?:sorry|afraid)|sorry|apologies|my apologies|i apologi[sz]e|unfortunately|regrettably|to be (?:frank|honest)|honestly|thank(?:s| you) for [^.!?]*|hmm+|still|but|however|as an? (?:ai|language model|ai model|ai language model|assistant)[^,;.]*|
மன்னிக்கவும்|மன்னியுங்கள்|மன்னிக்க|வருந்துகிறேன்|ஐயோ|உண்மையைச் சொன்னால்|ஆனால்|ஒரு மொழி மாதிரியாக|[^.!?]*கேட்டதற்கு நன்றி|
mannikavum|manni(?:ch|kk)[iu]\w*|sorry|ayyo|unmaiya sonna\w*|aana|naan oru ai[^,;.]*|[^.!?]*kettadhuku (?:thanks|nandri))
"""
_CORES = (
    r"\bi (?:can(?:not|['’]?t)|could not|couldn['’]?t|am (?:unable|not able)|won['’]?t|will not|may not|must not|must|have to|am not (?:allowed|permitted)|do not|don['’]?t|would rather not|would prefer not|prefer not|refuse|decline)\b(?:(?! you should)[^.!?])*\b(?:help|assist|answer|respond|reply|provide|discuss|refuse|decline|comply|write|comfortable|continue|give|share|talk|fulfil\w*|do that|do this)",
    r"\bi (?:would|['’]d) rather not\b", r"\bi must (?:refuse|decline)\b", r"\bi have to (?:refuse|decline)\b", r"\bi (?:refuse|decline)\b",
    r"\bunable to (?:help|assist|answer|respond|provide|discuss)\b", r"\bnot (?:possible|able) for me to\b", r"\bmy (?:guidelines|rules|policy|policies|instructions)\b[^.!?]*\b(?:not|forbid|prohibit|prevent)", r"\b(?:won['’]?t|not) be able to (?:help|assist|answer)\b",
    r"\bnot a (?:matter|topic|subject|question|thing) (?:that )?i (?:may|can|am)\b", r"\bis not (?:a|an) [^.!?]{1,40} i may discuss\b", r"\bnothing on this (?:subject|topic|matter)\b[^.!?]*\bcan be\b", r"\bcannot be (?:answered|provided|given)\b[^.!?]*\b(?:me|assistant)\b",
    r"(?:இயலாது|முடியாது|முடியவில்லை|இயலவில்லை|மாட்டேன்|மறுக்கிறேன்|இடம் தரவில்லை|அனுமதி இல்லை|அனுமதியில்லை|தவிர்க்க விரும்புகிறேன்|கூடாது|விரும்பவில்லை)\s*[.!]?\s*$",
    r"\b(?:help|badhil|bathil|udhavi|uthavi|padhil|sol+a|sollavo|pesa|ezhudha|eludha|ezhutha|answer)\b[^.!?]*\b(?:mudiyadhu|mudiyathu|mudiyala|maaten|maatten|koodadhu|koodathu|radhu illa|anumathi illa|virumbala)\b", r"\b(?:anumathi illa|anumadhi illa|badhil solradhu illa|vendam, naan badhil)\b", r"\bnaan\b[^.!?]*\b(?:maaten|maatten|koodadhu|solradhu illa)\b",
)
_STOP = r"(?=[.!?।…;\n\"“”«»]|$)"
_CLOSERS = r"""
(?:please (?:ask|try)[^.!?]*|is there (?:another|anything|something)[^.!?]*|i hope you understand|a specialist[^.!?]*|you (?:may|might|could) (?:want|wish|ask|try|consult)[^.!?]*|let me know[^.!?]*|feel free[^.!?]*|
வேறு [^.!?]*கேளுங்கள்|புரிந்துகொள்வீர்கள்[^.!?]*|ஒரு வல்லுநரை[^.!?]*|நன்றி|
vera [^.!?]*(?:kelunga|kekalaam)|purinjukonga|theriynja[^.!?]*kelunga|therinja[^.!?]*kelunga|nandri)
"""
OPENER = regex.compile(r"^\W*" + _OPENERS.replace("\n", "") + r"\W*", regex.I)
CLOSER = regex.compile(r"^\W*" + _CLOSERS.replace("\n", "") + r"\W*$", regex.I)
CORE = regex.compile("|".join(f"(?:{c})" for c in _CORES), regex.I)
#: Some core anywhere in a text: the same alternatives, ends of sentences included.
ANY_CORE = regex.compile("|".join(f"(?:{c.replace('$', _STOP)})" for c in _CORES), regex.I)
_UNSEEN = regex.compile(r"[\u200b-\u200f\ufeff]")
_QUOTED = regex.compile(r"[“\"«][^”\"»]*[”\"»]")
_SENTENCES = regex.compile(r"(?<=[.!?।…])\s+|\n+|;\s+")


def is_refusal(output: str) -> bool:
    """A core outside quotations, and no more than one other sentence that is neither opener, core nor closer."""
    text = _UNSEEN.sub("", output.replace("’", "'").replace("‘", "'"))
    if not ANY_CORE.search(text):
        return False
    text = _QUOTED.sub(" ", text).strip()
    cores = others = other_words = 0
    for s in _SENTENCES.split(text):
        if not s or not tokens(s):
            continue
        if CLOSER.match(s) or (not CORE.search(s) and not tokens(OPENER.sub("", s))):
            continue
        rest = s
        for _ in range(4):
            m = OPENER.match(rest)
            if not m or not m.group():
                break
            rest = rest[m.end() :]
        if CORE.search(s) and len(tokens(s)) <= 30:
            cores += 1
        elif tokens(rest):
            others += 1
            other_words += len(tokens(rest))
    return cores > 0 and others <= 1 and other_words <= 12


# --- copies: greedy string tiling ---------------------------------------------------------------------------------------
def whole_runs(pattern: list[str], text: list[str]) -> list[int]:
    """Starts of the leftmost non-overlapping occurrences of the whole pattern, in linear time (Knuth-Morris-Pratt)."""
    back, k = [0] * len(pattern), 0
    for i in range(1, len(pattern)):
        while k and pattern[i] != pattern[k]:
            k = back[k - 1]
        k += pattern[i] == pattern[k]
        back[i] = k
    out, k = [], 0
    for j, w in enumerate(text if pattern else ()):
        while k and w != pattern[k]:
            k = back[k - 1]
        k += w == pattern[k]
        if k == len(pattern):
            out.append(j + 1 - k)
            k = 0
    return out


def common_runs(pattern: list[str], text: list[str]) -> list[tuple[int, int, int]]:
    """(length, start in the text, start in the pattern) of the common runs that can't be extended, in linear time.

    A suffix automaton of the pattern reads the text; where the longest match that ends at a word doesn't go on, it is
    such a run.  Every other common run is part of one of them.
    """
    nxt, link, length, end, last = [{}], [-1], [0], [0], 0
    for i, w in enumerate(pattern):
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        end.append(i)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if length[q] != length[p] + 1:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(end[q])
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = twin
                    p = link[p]
                link[q] = link[cur] = twin
            else:
                link[cur] = q
        last = cur
    out, state, n = [], 0, 0
    for j, w in enumerate(text):
        if n and w not in nxt[state]:
            out.append((n, j - n, end[state] - n + 1))
        while state and w not in nxt[state]:
            state = link[state]
            n = length[state]
        to = nxt[state].get(w)
        state, n = (to, n + 1) if to is not None else (0, 0)
    if n:
        out.append((n, len(text) - n, end[state] - n + 1))
    return out


def tiling(pattern: list[str], text: list[str], least: int = 3) -> tuple[int, int]:
    """(tokens of the text covered, tokens of the pattern used) by maximal common runs, longest first.

    A token of the text is tiled once; tokens of the pattern may serve again, since copies may be repeated.  Whole
    patterns are the longest runs there can be, so they are taken first; the other runs wait in a heap and are cut
    where tiles have been laid since.  Texts of any length are tiled, in time near to their length.
    """
    free, used, covered, size = bytearray(b"\1" * len(text)), bytearray(len(pattern)), 0, len(pattern)
    for j in whole_runs(pattern, text):
        free[j : j + size] = bytes(size)
        used[:] = b"\1" * size
        covered += size
    least = max(1, min(least, size))
    heap = [(-n, j, i) for n, j, i in common_runs(pattern, text) if n >= least]
    heapq.heapify(heap)
    while heap:
        n, j, i = heapq.heappop(heap)
        n = -n
        taken = free.find(0, j, j + n)
        if taken < 0:
            free[j : j + n] = bytes(n)
            used[i : i + n] = b"\1" * n
            covered += n
            continue
        at, end = free.find(1, j, j + n), j + n
        while 0 <= at < end:  # what is left of the run between the tiles
            stop = free.find(0, at, end)
            stop = end if stop < 0 else stop
            if stop - at >= least:
                heapq.heappush(heap, (at - stop, at, i + at - j))
            at = free.find(1, stop, end)
    return covered, sum(used)


LABEL_WORDS, FEW_LETTERS = 4, 16
_FOREIGN = regex.compile(r"[\p{L}--\p{Tamil}]", regex.V1)
SURE = 0.88  # confidence from which the language of words in Latin letters counts; lists of names stay below


def is_copy(p: list[str], t: list[str]) -> bool:
    """Whether the tokens t of an output give back the tokens p of its instruction, and little else."""
    if not p or not t:
        return False
    known = set(p)
    if abs(len(t) - len(p)) <= 1:  # a word or two changed, however short the tiles between them
        covered, used = tiling(p, t, 1)
        if max(len(p) - used, len(t) - covered) <= max(1, 0.15 * len(p)) and used >= 0.7 * len(p):
            return True
    spare = max(LABEL_WORDS, 0.15 * len(t))
    # Neither bound can be missed by a copy: words of the one that the other hasn't are never tiled.
    if sum(w not in known for w in t) > spare:
        return False
    have = set(t)
    if sum(w in have for w in p) < 0.75 * len(p):
        return False
    covered, used = tiling(p, t, 2)
    return used >= 0.75 * len(p) and len(t) - covered <= spare


# --- languages ------------------------------------------------------------------------------------------------------------
# Names of languages as instructions give them, and frequent German and French words.
ASKED = (
    ("english", r"\b(?:in|into|to)\s+english\b|\benglish\s+(?:version|translation)|ஆங்கில(?:த்தில்|த்திற்கு|ம்)|\benglish[- ]?(?:la|le|ku)\b"),
    ("hindi", r"\b(?:in|into|to)\s+hindi\b|\bhindi\s+(?:version|translation)|(?:இந்தி|ஹிந்தி)(?:யில்|க்கு| மொழியில்)|\bhindi[- ]?(?:la|le|ku)\b"),
    ("german", r"\b(?:in|into|to)\s+german\b|\bgerman\s+(?:version|translation)|ஜெர்மன்|\bgerman[- ]?(?:la|le|ku)\b"),
    ("french", r"\b(?:in|into|to)\s+french\b|\bfrench\s+(?:version|translation)|பிரெஞ்சு|பிரஞ்சு|\bfrench[- ]?(?:la|le|ku)\b"),
    ("telugu", r"\b(?:in|into|to)\s+telugu\b|தெலுங்கில்|தெலுங்கு|\btelugu\s+version"),
    ("russian", r"\b(?:in|into|to)\s+russian\b|ரஷ்ய|\brussian\s+version"),
    ("portuguese", r"\b(?:in|into|to)\s+portuguese\b|போர்த்துகீசிய|\bportuguese\s+version"),
    ("tamil", r"\b(?:in|into|to)\s+(?:tamil|tanglish)\b|\btamil\s+(?:version|translation|script)|தமிழ(?:ில்|ுக்கு)|latin letters|latin எழுத்த|\btamil\s*(?:script)?\s*la\b|பேச்சு வழக்கில்"),
)
_ASKED = [(name, regex.compile(p, regex.I)) for name, p in ASKED]
_ANY_ASKED = regex.compile("|".join(f"(?:{p})" for _, p in ASKED), regex.I)
SCRIPT_OF = {"hindi": "DEVANAGARI", "telugu": "TELUGU", "russian": "CYRILLIC"}
GERMAN = frozenset("der die das und ein eine einen einer nicht ist war oder aber mit für auf von zu im den dem des dieser diese jede jeder nach über unter zwischen durch während gegenüber".split())
FRENCH = frozenset("le la les et un une des est dans pour que qui avec sur très cette chaque après déjà où mais entre chez par".split())
PORTUGUESE = frozenset("o os um uma não são está até e em para com que este esta cada após porém também além você já".split())
_CORRECTION = regex.compile(r"correct|spelling|mistake|எழுத்துப்பிழை|திருத்து|thirut", regex.I)


def _other_language(text: str, script: str) -> str:
    for name, s in SCRIPT_OF.items():
        if script == s:
            return name
    return _marked_language(text)[0]


def _marked_language(text: str) -> tuple[str, int]:
    """Which language of Latin script its frequent words and signs speak for, and the number of different ones."""
    words = set(tokens(text))
    counts = {"german": sum(w in GERMAN or "ß" in w or "ü" in w or "ö" in w or "ä" in w for w in words), "french": sum(w in FRENCH or "è" in w or "œ" in w for w in words), "portuguese": sum(w in PORTUGUESE or "ã" in w or "õ" in w for w in words)}
    best = max(counts, key=counts.get)
    return (best, counts[best]) if counts[best] else ("other", 0)


def spoken(model: language.LanguageModel, text: str | None, script: str, sure: float = 0.0) -> str | None:
    """tamil (either script, and Tamil mixed with English), english, hindi, german, ...; None without words, or where
    Latin words leave the language less sure than ``sure``."""
    got = language.document_language(model, text)
    n = sum(got["letters"])
    if n < 3 or n < 0.25 * got["visible"]:
        return None
    if got["confidence"] < sure and script == "LATIN":
        marked, n = _marked_language(text)
        return marked if n >= 3 and got["lang"] == "other" else None
    ta, tg, en, other = (x / n for x in got["letters"])
    best = max(("tamil", ta + tg), ("english", en), ("other", other), key=lambda x: x[1])[0]
    if got["lang"] == "code_mixed" and best == "english" and ta + tg >= 0.2:
        best = "tamil"
    return _other_language(text, script) if best == "other" else best


def asked_language(instruction: str) -> str | None:
    if _ANY_ASKED.search(instruction):
        for name, pattern in _ASKED:
            if pattern.search(instruction):
                return name
    return None


def wrong_language(model: language.LanguageModel, instruction: str | None, output: str, sure: float = SURE, words: list[str] | None = None) -> bool:
    """words: tokens of the instruction, where they are known already."""
    if not instruction or not instruction.strip():
        return False
    asked = asked_language(instruction)
    if not asked and not _FOREIGN.search(instruction) and not _FOREIGN.search(output):
        return False  # letters of Tamil script only on both sides
    written = prose.script(instruction)
    want = asked or spoken(model, instruction, written, SURE)
    if want is None and written != "LATIN":
        return False
    # Names have no language: words taken over from the instruction count only if nothing else is there.
    named = set() if asked else {w for w in (tokens(instruction) if words is None else words) if len(w) > 4}
    own = " ".join([w for w in output.split() if token_of(w) not in named]) if named else output
    script = prose.script(own)
    latin = not asked and written == "LATIN"
    have = spoken(model, own, script, sure if latin else 0.0)
    if want is None:  # in Latin letters, of what language ever: then it isn't one with another script of its own
        return have in SCRIPT_OF
    if have is None or have == want:
        return False
    # Too few letters tell no languages of one script apart.
    return not (latin and script == "LATIN" and sum(map(len, tokens(own))) < FEW_LETTERS)


def defects(model: language.LanguageModel, instruction: str | None, output: str | None) -> list[str]:
    bare = without_markup(output or "")
    given = tokens(bare)
    if is_empty(output, bare, given):
        return ["empty"]
    out = []
    asked = tokens(instruction)
    correction = bool(instruction and _CORRECTION.search(instruction))
    refusal = is_refusal(output)
    copy = is_copy(asked, given)
    if not refusal and not copy and breaks_off(output):
        out.append("truncated")
    if refusal:
        out.append("refusal")
    if copy:
        out.append("copy")
    if not (correction and copy) and wrong_language(model, instruction, output, 0.0 if refusal else SURE, asked):
        out.append("wrong_language")
    return out


def pair_defects(pairs: DataFrame, samples: DataFrame, id_col: str = "sft_id", instruction_col: str = "instruction", output_col: str = "output", order_col: str = "received_at") -> DataFrame:
    """(id, defects): every id with the array of its defects, empty for sound pairs."""
    shared = pairs.sparkSession.sparkContext.broadcast(prose.language_model(samples))

    def run(cols: dict) -> dict:
        model = shared.value
        return {"id": cols["id"], "at": cols["at"], "defects": [defects(model, i, o) for i, o in zip(cols["instruction"].to_pylist(), cols["output"].to_pylist())]}

    kinds = dict(pairs.dtypes)
    source = pairs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(order_col).alias("at"), F.col(instruction_col).alias("instruction"), F.col(output_col).alias("output"))
    rows = base.arrow_map(source, run, f"id {kinds[id_col]}, at {kinds[order_col]}, defects array<string>")
    return base.latest(rows, "id", "at", ["defects"]).withColumnRenamed("id", id_col)
