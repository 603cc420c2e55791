import html
import random
import re
import unicodedata
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from lexiloom.functions import langid, normalize, script, tanglish
from lexiloom.operators import lines, quality
from lexiloom.operators.chat import strip_prefix


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column("text").alias("x")).first().x


@pytest.mark.parametrize("text,want", [
    ("க\u0bc6\u0bbe", "க\u0bca"), ("வ\u200dண", "வண"), ("காா", "கா"), ("க\u0bcd\u0bbe", "கா"), ("ஶ்ரீ ராம", "ஸ்ரீ ராம"),
    ("a  b\r\n\n\n\nc", "a b\n\nc"), ("“x” – y", '"x" - y'), (None, ""), ("", ""), (" \u3000 ", ""), ("a&amp;lt;b", "a&lt;b"),
])
def test_normalize(spark, text, want):
    assert one(spark, text, normalize.normalize) == want


def test_personal_data(spark):
    cfg = normalize.NormalizerConfig(urls="remove", emails="mask", phones="mask")
    got = one(spark, "mail me.x+y@ex-ample.co.in, ring +91 98765 43210 or 9876543210, see HTTPS://a.b/c?d now", lambda c: normalize.normalize(c, cfg))
    assert got == "mail <email>, ring <phone> or <phone>, see now"
    assert one(spark, "12345678901234", lambda c: normalize.normalize(c, cfg)) == "12345678901234"
    with pytest.raises(ValueError):
        normalize.normalize("text", normalize.NormalizerConfig(urls="drop"))


def reference_normal(t: str) -> str:
    t = html.unescape(t).replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", "".join(c for c in t if c not in normalize.INVISIBLE))
    t = unicodedata.normalize("NFC", t)
    t = re.sub(r"([ாிீுூெேைொோௌ்])\1+", r"\1", t)
    t = re.sub(r"்([ாிீுூெேைொோௌ])", r"\1", t).replace(*normalize.SRI)
    t = t.translate(str.maketrans(*normalize.QUOTES)).translate(str.maketrans(*normalize.DASHES))
    t = re.sub(r"[ \t\u00a0\u2000-\u200a\u202f\u205f\u3000]+", " ", t)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in t.split("\n"))).strip()


def test_normalize_as_python_and_idempotent(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    once = df.select("text", normalize.normalize("text").alias("x"))
    for r in once.select("text", "x", normalize.normalize("x", normalize.NormalizerConfig(html_unescape=False)).alias("y")).collect():
        assert r.x == reference_normal(r.text)
        assert r.y == r.x


def test_dedup_key_keeps_marks(spark):
    assert one(spark, "பல்", normalize.dedup_key) != one(spark, "பல", normalize.dedup_key)
    assert one(spark, " A-b, C! ", normalize.dedup_key) == "abc"


@pytest.mark.parametrize("text,want", [
    ("இன்று காலை நான் பள்ளிக்கு நடந்து சென்றேன்", "ta"), ("naan inniki veetla iruken romba nalla iruku machan vaanga", "tanglish"),
    ("the house that was on the hill is not for us and they have it", "en"), ("இன்று meeting நடந்தது அதில் project பற்றி discussion இருந்தது", "code_mixed"),
    ("Wir gehen morgen zusammen ins Museum und danach nach Hause", "other"), ("ok", "other"), (None, "other"),
])
def test_language(spark, text, want):
    cfg = langid.LangIdConfig(lexicon=("naan", "inniki", "iruken", "romba", "nalla", "iruku", "machan", "vaanga"))
    assert one(spark, text, lambda c: langid.detect(c, cfg)).lang == want


def test_lexicon_from_a_file_and_from_samples(spark, tmp_path):
    from lexiloom.functions import wordlists

    (tmp_path / "words.txt").write_text("# words\nNaan\n\nromba\n")
    score = lambda cfg: one(spark, "naan romba late", lambda c: langid.latin_scores(c, cfg)[0])
    assert score(langid.LangIdConfig(lexicon=str(tmp_path / "words.txt"))) == pytest.approx(2 / 3) and score(langid.LangIdConfig()) == 0
    rows = [("naan romba late", "Tanglish "), ("naan the a", "tanglish"), ("the late", "en-GB"), ("nalla", "ta"), (None, "tanglish")]
    samples = spark.createDataFrame(rows, "text string, lang string")
    assert wordlists.learned_lexicon(samples) == ("naan", "romba") and wordlists.learned_lexicon(samples, most=1) == ("naan",)
    assert wordlists.learned_lexicon(samples.limit(0)) == ()


def test_scores_are_zero_in_early_branches(spark):
    r = one(spark, "இன்று காலை நான் பள்ளிக்கு நடந்து the of and சென்றேன்", langid.detect)
    assert r.tanglish_score == r.english_score == 0


def test_routes(spark):
    df = spark.createDataFrame([("ta",), ("en",), ("other",), ("code_mixed",)], "lang string")
    got = [r.x for r in df.select(langid.route("lang", "ta", "news", {"en": "english"}, {"other": "rest", "en": "no"}).alias("x")).collect()]
    assert got == ["news", "english", "rest", "code_mixed"]


def test_script_counters_are_disjoint(spark):
    text = "தமிழ் ௧௨ 12 abc é × Привет . ।"
    s = one(spark, text, script.script_stats)
    assert (s.digits, s.latin, s.other) == (4, 4, 6)
    assert s.tamil + s.digits + s.spaces + s.latin + s.other + s.punct == len(text)


def test_transliteration():
    words = "தமிழ் வணக்கம் நன்றி வெற்றி பச்சை மஞ்சள் வந்து எங்க ஸ்ரீ ௧௨"
    assert tanglish.latin_text(words) == "thamizh vanakkam nandri vetri pachai manjal vandhu enga sri 12"


def test_variants_follow_the_seed(spark):
    df = spark.createDataFrame([(i, "நான் வாழ்ந்தேன் தூங்கினேன்") for i in range(20)], "id int, text string")
    a = [r.x for r in df.select(tanglish.transliterate("text", "id", 0.5).alias("x")).collect()]
    b = [r.x for r in df.repartition(7).select("id", tanglish.transliterate("text", "id", 0.5).alias("x")).orderBy("id").collect()]
    assert a == b and len(set(a)) > 1


@pytest.mark.parametrize("text,want", [("அவர் வருகிறார்", "அவர் வராரு"), ("நான் படிக்கிறேன்", "நான் படிக்குறேன்"), ("எனக்கு வேண்டும் இல்லை", "எனக்கு வேணும் இல்ல"), (None, None)])
def test_spoken(spark, text, want):
    assert one(spark, text, tanglish.colloquialize) == want
    if text:
        assert tanglish.colloquialize_text(text) == want


@pytest.mark.parametrize("most", [1, 2, 3])
def test_repeated_lines(spark, most):
    from lexiloom.operators import lines

    rng = random.Random(most)
    text = "\n".join(rng.choice(["a b", "", "c", " a b ", "d"]) for _ in range(60))
    seen, want = {}, []
    for x in map(str.strip, text.split("\n")):
        seen[x] = seen.get(x, 0) + 1
        if not x or seen[x] <= most:
            want.append(x)
    want = re.sub(r"\n{3,}", "\n\n", "\n".join(want)).strip()
    assert one(spark, text, lambda c: lines.filter_lines(c, lines.LineFilterConfig(min_chars=0, max_repeats=most))) == want


def test_line_filter(spark):
    text = "first line here\nAll rights reserved 2024\nfirst line here\n\nx = {1}\nsecond line"
    assert one(spark, text, lines.filter_lines) == "first line here\n\nsecond line"
    two = lines.LineFilterConfig(max_repeats=2, drop_curly=False, drop_boilerplate=False)
    assert one(spark, "a\nb\na\na\n\n\n\nb", lambda c: lines.filter_lines(c, two)) == "a\nb\na\n\nb"
    assert one(spark, None, lines.filter_lines) == ""
    assert one(spark, "a\na", lambda c: lines.filter_lines(c, lines.LineFilterConfig(enabled=False))) == "a\na"


def test_prefixes(spark):
    got = [one(spark, t, lambda c: strip_prefix(c, ["Q:", "Q"])) for t in (" Q: a", "Qa", "a Q:", "\u00a0Q:\u3000x")]
    assert got == ["a", "a", "a Q:", "x"]


def naive_shares(text):
    w = text.split()
    total = max(1, sum(map(len, w)))
    out = []
    for n in quality.TOP_SIZES:
        g = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        gram, c = g.most_common(1)[0] if g else ((), 0)
        out.append(sum(map(len, gram)) * c / total if c > 1 else 0.0)
    for n in quality.DUP_SIZES:
        g = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        c, covered = Counter(g), set()
        for i, x in enumerate(g):
            if c[x] > 1:
                covered |= set(range(i, i + n))
        out.append(sum(len(w[i]) for i in covered) / total)
    return tuple(out)


def test_gram_shares_as_counted():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 5, 9, 30, 200):
        for size in (1, 2, 4, 30):
            for _ in range(8):
                text = " ".join(rng.choice(["a", "bb", "ccc", "dd", "e", "ffff"][:size] if size < 6 else [f"w{i}" for i in range(size)]) for _ in range(n))
                assert quality.gram_shares(text) == pytest.approx(naive_shares(text))


def test_reasons_in_order(spark):
    th = quality.QualityThresholds.from_dict({"min_chars": 50, "min_words": 5})
    rows = [(1, "short"), (2, "spam eggs ham " * 60), (3, "Sunlight fell across the quiet market while vendors arranged ripe mangoes and called out to early customers."), (4, None)]
    got = {r.id: r.reject_reason for r in quality.quality_filter(spark.createDataFrame(rows, "id int, text string"), "text", th).collect()}
    assert got[1] == got[4] == "too_short_chars" and got[2] == "top_2gram" and got[3] is None
    with pytest.raises(KeyError):
        quality.QualityThresholds.from_dict({"min_letters": 1})
    profiles = quality.resolve_profiles({"default": {"min_words": 7}, "ta": {"max_top_ngram_frac": {2: 0.5}}})
    assert profiles["ta"].min_words == 7 and dict(profiles["ta"].max_top_ngram_frac) == {2: 0.5}


def test_reward_tokens_keep_tamil_signs(spark):
    assert one(spark, "வணக்கம், Hello-World!", normalize.reward_tokens) == ["வணக்கம்", "hello", "world"]
    assert regex.fullmatch(r"\w+", "a")
