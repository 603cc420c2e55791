"""Language of documents and of their lines by cross-parsing entropy.

For each language a suffix automaton of its labelled text yields longest-match lengths.  A word is parsed greedily into
the longest phrases that occur in that text; the language that needs the fewest phrases, normalised by the information
its training length carries, wins.  Words are parsed once per worker and remembered, so the cost follows the number of
distinct words.  Letters are attributed sentence by sentence: within a sentence each script's words are parsed together.

A document or line is ``code_mixed`` when two or more languages each hold at least ``MIXED_SHARE`` of its letters,
else it has the language of most letters; with no words of any language it is ``other``.  Confidence is the share of
letters that speak for the label, times the relative margin of its phrase count over the runner-up's.

Defined results: null and blank texts get ``other`` with confidence 0; very long texts are read whole.
"""

from __future__ import annotations

import math

import regex

MIXED_SHARE = 0.2
LANGS = ("ta", "tanglish", "en", "other")
LABELS = frozenset((*LANGS, "code_mixed"))
TA, TANGLISH, EN, OTHER = range(4)
LATIN_LANGS = (TANGLISH, EN, OTHER)
END = ".!?।॥…"
_FORMAT = regex.compile(r"\p{Cf}+")
_CORE = regex.compile(r"^[^\p{L}\p{M}\p{N}]*(.*?)[^\p{L}\p{M}\p{N}]*$", regex.S)
_PURE = regex.compile(r"^[\p{L}\p{M}]+(?:['’.\-–…/,!?]+[\p{L}\p{M}]+)*$")
_RUNS = regex.compile(r"(?P<ta>[஀-௿]+)|(?P<la>[\p{Latin}]+)|(?P<ot>[\p{L}\p{M}]+)")
_WIDE = regex.compile(r"[ \t]{2,}")
NAME_WEIGHT, HINT_LETTERS, SHORT_ENTRY, NO_WORDS = 0.4, 25.0, 40, 0.47


class SuffixAutomaton:
    """Minimal automaton of all substrings of a text, built online; only its transitions are needed for parsing."""

    __slots__ = ("next", "link", "length", "size")

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[q] == self.length[p] + 1:
                    self.link[cur] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.length.append(self.length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur
        self.size = len(text)

    def phrases(self, word: str) -> int:
        """Number of longest-match phrases of a word; a character that the text lacks is a phrase and a half."""
        nxt, at, n, state = self.next, 0, 0.0, 0
        end = len(word)
        while at < end:
            state, start = 0, at
            while at < end and (to := nxt[state].get(word[at])) is not None:
                state, at = to, at + 1
            if at == start:
                at += 1
                n += 1.5
            else:
                n += 1
        return n


class LanguageModel:
    """Automata of the labelled samples, with the remembered parses of tokens."""

    def __init__(self, samples: dict[str, str], limit: int = 300_000):
        self.samples, self.limit = samples, limit
        self.automata = {name: SuffixAutomaton(" " + " ".join(_words_only(samples.get(name, ""))) + " ") for name in LANGS}
        # log2 of the training length: bits that one phrase's position costs.
        self.bits = {name: math.log2(max(a.size, 2)) for name, a in self.automata.items()}
        self.memo: dict[str, tuple] = {}

    def __reduce__(self):
        return LanguageModel, (self.samples, self.limit)

    def costs(self, word: str) -> tuple[float, ...]:
        padded = f" {word} "
        return tuple(self.automata[name].phrases(padded) * self.bits[name] for name in LANGS)

    def token(self, token: str) -> tuple:
        """(Tamil letters, Latin letters, other letters, Latin costs of three languages, visible characters, Latin phrases)."""
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) >= self.limit:
                self.memo.clear()
            got = self.memo[token] = self._token(token)
        return got

    def _token(self, token: str) -> tuple:
        clean = _FORMAT.sub("", token)
        core = _CORE.match(clean).group(1)
        if not _PURE.match(core):
            return (0, 0, 0, 0.0, 0.0, 0.0, len(clean), 0.0)
        ta = la = ot = 0
        cost, phrases = [0.0, 0.0, 0.0], 0.0
        # Capitalised words are often names, which travel between languages.
        weight = NAME_WEIGHT if core[:1].isupper() and core[1:2].islower() else 1.0
        for m in _RUNS.finditer(core.lower()):
            run = m.group()
            costs = self.costs(run)
            best = min(range(4), key=lambda i: (costs[i], i))
            if m.lastgroup == "la":
                la += len(run)
                phrases += min(costs[lang] / self.bits[LANGS[lang]] for lang in LATIN_LANGS)
                for k, lang in enumerate(LATIN_LANGS):
                    cost[k] += costs[lang] * weight
            elif best == TA:
                ta += len(run)
            else:
                ot += len(run)
        return (ta, la, ot, cost[0], cost[1], cost[2], len(clean), phrases)


def _words_only(text: str) -> list[str]:
    return [m.group() for m in _RUNS.finditer(_FORMAT.sub("", text).lower())]


def unspaced(line: str) -> str:
    """Join letters set apart ('c o a s t  r o a d'): words are then the parts between wider gaps."""
    if line.count(" ") * 3 < len(line):
        return line
    parts = line.split()
    if len(parts) >= 8 and sum(len(p) <= 2 for p in parts) > 0.85 * len(parts) and _WIDE.search(line.strip()):
        return " ".join(p.replace(" ", "") for p in _WIDE.split(line))
    return line


def parts_of(line: str) -> list[str]:
    """Split at white space and at separators of lists and tables."""
    return line.replace(";", " ").replace("|", " ").replace(",", " ").replace("\u200b", " ").split()


def analyse_line(model: LanguageModel, line: str) -> tuple[list[list[float]], int, int, int, float]:
    """(sentences as [Tamil, Latin, other letters, three Latin costs, letters of prior evidence], letters, visible characters, tokens, phrases)."""
    sentences, cur = [], [0, 0, 0, 0.0, 0.0, 0.0, HINT_LETTERS]
    visible = tokens = 0
    phrases = 0.0
    memo, make = model.memo, model.token
    for token in parts_of(unspaced(line)):
        t = memo.get(token) or make(token)
        visible += t[6]
        tokens += 1
        if t[1]:
            cur[1] += t[1]
            cur[3] += t[3]
            cur[4] += t[4]
            cur[5] += t[5]
            phrases += t[7]
        cur[0] += t[0]
        cur[2] += t[2]
        if token[-1] in END:
            sentences.append(cur)
            cur = [0, 0, 0, 0.0, 0.0, 0.0, HINT_LETTERS]
    if cur[0] or cur[1] or cur[2]:
        if cur[1] < SHORT_ENTRY:  # an entry of a list or table says little by itself
            cur[6] = 6 * HINT_LETTERS
        sentences.append(cur)
    return sentences, int(sum(s[0] + s[1] + s[2] for s in sentences)), visible, tokens, phrases


def latin_prior(sentences: list[list[float]]) -> list[float] | None:
    """Costs per Latin letter, over the sentences of one script if there are any, else over all."""
    for pool in ([s for s in sentences if s[1] and not s[0]], [s for s in sentences if s[1]]):
        if pool:
            n = sum(s[1] for s in pool)
            return [sum(s[3 + k] for s in pool) / n for k in range(3)]
    return None


def letters_by_language(sentences: list[list[float]], prior: list[float] | None) -> tuple[list[float], list[float]]:
    """(letters per language, summed Latin costs).

    Latin words inside sentences of Tamil script are parsed as one pool; other sentences one by one, each with the
    whole text's Latin costs as ``HINT_LETTERS`` letters of prior evidence, which settles what is too short to call.
    """
    out, total = [0.0] * 4, [0.0] * 3
    pool = [0.0, 0.0, 0.0, 0.0]
    for s in sentences:
        out[TA] += s[0]
        out[OTHER] += s[2]
        if s[1]:
            for k in range(3):
                total[k] += s[3 + k]
            if s[0]:
                pool = [pool[0] + s[1], *(pool[k + 1] + s[3 + k] for k in range(3))]
            else:
                c = [s[3 + k] + (s[6] * prior[k] if prior else 0) for k in range(3)]
                out[LATIN_LANGS[c.index(min(c))]] += s[1]
    if pool[0]:
        c = pool[1:3]  # words set into Tamil sentences are English or romanised Tamil
        out[LATIN_LANGS[c.index(min(c))]] += pool[0]
    return out, total


def label_of(letters: list[float], visible: int, costs: list[float], phrases: float, latin: float) -> tuple[str, float]:
    """(language, confidence) from letters per language; 'other' where there are no words of any language."""
    n = sum(letters)
    if not n or n < 0.25 * visible or (latin > 0.5 * n and phrases > NO_WORDS * latin):
        return "other", round(1.0 - n / visible, 4) if visible and n < visible else 0.0
    shares = [x / n for x in letters]
    held = sorted(s for s in shares if s >= MIXED_SHARE)
    if len(held) >= 2:
        return "code_mixed", round(min(1.0, 2 * held[-2]), 4)
    best = max(range(4), key=lambda i: shares[i])
    margin = 1.0
    if best in LATIN_LANGS and latin > 0.5 * n:
        order = sorted(costs)
        margin = min(1.0, 0.5 + 2 * (order[1] - order[0]) / order[1]) if order[1] else 1.0
    return LANGS[best], round(shares[best] * margin, 4)


def document_language(model: LanguageModel, text: str | None) -> dict:
    """Label and confidence of a document, and of each of its non-blank lines (number, label, confidence, words)."""
    lines, everything, visible, phrases = [], [], 0, 0.0
    for no, line in enumerate((text or "").split("\n"), 1):
        if line and not line.isspace():
            s, _, v, w, p = analyse_line(model, line)
            lines.append((no, s, v, w, p))
            everything += s
            visible += v
            phrases += p
    prior = latin_prior(everything)
    held, costs = letters_by_language(everything, prior)
    lang, confidence = label_of(held, visible, costs, phrases, sum(s[1] for s in everything))
    out = []
    for no, s, v, w, p in lines:
        own, c = letters_by_language(s, prior)
        out.append((no, *label_of(own, v, c, p, sum(x[1] for x in s)), w))
    return {"lang": lang, "confidence": confidence, "lines": out, "phrases_per_letter": phrases / max(1, sum(s[1] for s in everything)), "letters": held, "visible": visible}


def clean_label(label: str | None) -> str | None:
    """Stored label, trimmed, lower-cased, cut before the first '-'; None unless it is one of the five languages."""
    if label is None:
        return None
    got = label.strip().lower().split("-")[0]
    return got if got in LABELS else None
