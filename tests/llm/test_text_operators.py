"""Language, prose, defects, token counts and encoding repair against plain versions and held-out labels."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import base, defects, language, mojibake, prose, tokens


@pytest.fixture(scope="module")
def samples(spark, data):
    return spark.read.parquet(f"{data}/lang_samples.parquet")


@pytest.fixture(scope="module")
def model(samples):
    return prose.language_model(samples)


def longest_phrases(text, word):
    """Phrases by trying every substring of the training text."""
    n, at = 0.0, 0
    while at < len(word):
        k = 0
        while at + k < len(word) and word[at : at + k + 1] in text:
            k += 1
        n += 1 if k else 1.5
        at += max(k, 1)
    return n


def test_automaton_parses_as_substring_search():
    rng = random.Random(2)
    for _ in range(30):
        text = "".join(rng.choice("abcd ") for _ in range(120))
        a = language.SuffixAutomaton(text)
        for _ in range(30):
            word = "".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 14)))
            assert a.phrases(word) == longest_phrases(text, word)


def test_held_out_languages(samples):
    rows = samples.collect()
    right = total = 0
    for fold in range(3):
        texts = {}
        for r in rows:
            if r.sample_id % 3 != fold:
                texts.setdefault(r.lang, []).append(r.text)
        m = language.LanguageModel({k: "\n".join(v) for k, v in texts.items()})
        for r in rows:
            if r.sample_id % 3 == fold:
                total += 1
                right += language.document_language(m, r.text)["lang"] == r.lang
    assert right / total >= 0.95


@pytest.mark.parametrize("text,want", [
    (None, "other"), ("", "other"), ("   \n", "other"), ("12 34 %% ::", "other"), ("xkcd zqwv bdfg hjkl mnpq rstv wxzk", "other"),
    ("இந்த வீடு அழகான நகரம் மட்டும்", "ta"), ("The lamp of the town was warm because the sea was early.", "en"),
    ("இந்த வீடு offer network மட்டும் train station கண்டார்.", "code_mixed"), ("naalaiku enna panra machan idhu nalla iruku da", "tanglish"),
    ("один холодный песня и город", "other"),
])
def test_labels(model, text, want):
    assert language.document_language(model, text)["lang"] == want


def test_letters_set_apart(model):
    assert language.document_language(model, "t h e   l a m p   o f   t h e   t o w n   w a s   w a r m")["lang"] == "en"


def test_line_numbers_count_blank_lines(model):
    got = language.document_language(model, "The lamp was warm.\n\nஇந்த வீடு அழகான நகரம்\n")["lines"]
    assert [(x[0], x[1]) for x in got] == [(1, "en"), (3, "ta")]


def test_stored_labels():
    assert [language.clean_label(x) for x in (" TA-IN ", "En", "und", "", None, "code_mixed")] == ["ta", "en", None, None, None, "code_mixed"]


def shards(spark, rows):
    """With extra columns whose names are those the operators use inside."""
    df = spark.createDataFrame(rows, "id string, text string, lang string, written_at timestamp")
    return df.withColumn("units", F.lit(1)).withColumn("at", F.lit("x")).withColumn("label", F.lit(2)).withColumn("h", F.lit(3))


def corpus(spark, data):
    df = spark.read.parquet(f"{data}/processed_shards.parquet").select("id", "text", "lang", F.col("written_at").cast("timestamp").alias("written_at"))
    return df


def test_statistics_tell_prose(spark, data, samples):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    odd = [
        ("z1", "lamp; rice; coin; ship\n" * 9, "en", t), ("z2", None, None, t), ("z3", "  ", "", t), ("z4", "9142.57\n7158.06\n" * 9, "other", t),
        ("z5", "The lamp of the town was warm because the sea was early. She said that the door had been wet. " * 4, "en", t),
        ("z5", "lamp\n" * 30, "en", t.replace(month=3)), ("z6", "?!&% *** &&&", "other", t),
    ]
    larger = data.replace("sf0.001", "sf0.01")  # common words need some hundred occurrences
    df = corpus(spark, larger).unionByName(shards(spark, odd), allowMissingColumns=True)
    got = {r.id: r for r in prose.text_statistics(df, samples).collect()}
    assert len(got) == df.select("id").distinct().count()
    assert not any(got[k].is_prose for k in ("z1", "z2", "z3", "z4", "z5", "z6"))
    assert got["z2"].n_words == 0 and got["z2"].distance == 0 and got["z6"].n_words == 0
    share = sum(r.is_prose for r in got.values()) / len(got)
    assert 0.8 < share < 0.99
    for r in got.values():
        assert sum(r[f"c_{s}"] for s in prose.STATS) == pytest.approx(r.distance**2, rel=1e-6, abs=1e-3)


def test_rare_languages_have_common_words(spark, model):
    """The share counts within the language: Russian is 1 in 50,000 words here."""
    russian = [("и", 40, 1), ("город", 30, 30), ("песня", 30, 29)]
    english = [(f"the{chr(97 + k % 26)}{chr(97 + k // 26)}", 20000, 5000) for k in range(250)] + [("the", 30000, 50)]
    got = prose.common_words(spark.createDataFrame(russian + english, "word string, n long, listed long"), model)
    assert "и" in got and "the" in got and not got & {"город", "песня"}


def test_statistics_do_not_depend_on_partitions(spark, data, samples):
    df = corpus(spark, data)
    a = {(r.id, r.is_prose) for r in prose.text_statistics(df.repartition(1), samples).collect()}
    b = {(r.id, r.is_prose) for r in prose.text_statistics(df.repartition(9), samples).collect()}
    assert a == b


def test_languages_of_records(spark, data, samples):
    df = corpus(spark, data)
    got = prose.languages(df, samples).collect()
    assert len(got) == df.select("id").distinct().count() and all(r.lang in language.LABELS for r in got)
    assert prose.languages(df.limit(0), samples).count() == 0 and prose.text_statistics(df.limit(0), samples).count() == 0


SOUND, OPEN = "The lamp was warm. The sea was early.", "The lamp was warm. The sea was"


@pytest.mark.parametrize("instruction,output,want", [
    ("Describe the lamp.", None, ["empty"]), ("Describe the lamp.", " <br> ", ["empty"]), ("Describe the lamp.", "N/A", ["empty"]), ("Describe the lamp.", "[ ]", ["empty"]),
    ("Describe the lamp.", SOUND, []), ("Describe the lamp.", OPEN, ["truncated"]), ("Describe the lamp.", SOUND + " 🙂", []), ("Describe the lamp.", SOUND + " [12]", []),
    ("Describe the lamp.", "It was warm. 1) the lamp\n2) the", ["truncated"]), ("Name three lamps.", "1. red lamp\n2. blue lamp\n3. old lamp", []), ("Describe the lamp.", "The lamp was warm. ```\ncode", ["truncated"]),
    ("Describe the lamp.", "I'm sorry, but I can't help with that. Please ask something else.", ["refusal"]), ("Describe the lamp.", "The clerk said, “Sorry, I can't help you.” Then the lamp of the town was warm and the sea was early.", []),
    ("What is the lamp of the old town?", "What is the lamp of the old town", ["copy"]), ("What is the lamp of the old town?", "Answer: What is the lamp of the old town? What is the lamp of the old town?", ["copy"]),
    ("Describe the lamp.", "மக்கள் இன்று அழகான நகரம் கண்டார்.", ["wrong_language"]), ("Translate the sentence below into Tamil.", "மக்கள் இன்று அழகான நகரம் கண்டார்.", []),
    ("இந்த வீடு பற்றி சுருக்கமாக எழுதுக.", "idhu nalla veedu dhaan, machan naan innum paakala.", []), ("Give the Hindi version of this line.", "एक ठंडा बाज़ार और मौसम गया।", []),
    ("Give the Hindi version of this line.", "Die alte Straße war kühl und die Tür groß.", ["wrong_language"]), (None, SOUND, []), ("", OPEN, ["truncated"]), ("How many lamps?", "42", []),
])
def test_defects(model, instruction, output, want):
    assert defects.defects(model, instruction, output) == want


def test_script_of_the_whole_text(model):
    latin, hindi = "Die alte Straße. " * 70, "एक ठंडा बाज़ार और मौसम गया। " * 200
    assert len(latin) > 1000 and prose.script(latin + hindi) == "DEVANAGARI" and prose.script(hindi + latin) == "DEVANAGARI"
    assert prose.script("१२ 12 34 %%") == "" and prose.script(None) == "" and prose.script("e\u0301te\u0301 1 மழை") == "LATIN"
    assert prose.model_key("other", latin + hindi) == prose.model_key("other", hindi)
    order = "Give the Hindi version of this text."
    assert "wrong_language" not in defects.defects(model, order, latin + hindi)
    assert defects.defects(model, order, hindi[:1100] + latin * 20) == ["wrong_language"]


def test_prose_is_told_alike_at_any_size(spark):
    """Records of 1,500 judged among all, and among a fifth of them."""
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    df, samples = spark.read.parquet(f"{d}/processed_shards.parquet"), spark.read.parquet(f"{d}/lang_samples.parquet")
    whole = {r.id: r.is_prose for r in prose.text_statistics(df, samples).collect()}
    part = {r.id: r.is_prose for r in prose.text_statistics(df.where("pmod(xxhash64(id), 5) = 0"), samples).collect()}
    assert sum(whole[i] != p for i, p in part.items()) <= 0.03 * len(part) and 0.9 < sum(part.values()) / len(part) < 0.97


def test_copies_of_one_text_change_no_verdict(spark, data):
    """A third of the rows hold one text: the others are judged as without them, and so are the copies."""
    df, samples = spark.read.parquet(f"{data}/processed_shards.parquet"), spark.read.parquet(f"{data}/lang_samples.parquet")
    before = {r.id: r.is_prose for r in prose.text_statistics(df, samples).collect()}
    one = df.where("length(text) > 200").orderBy("id").limit(1)
    copies = one.select(F.explode(F.sequence(F.lit(0), F.lit(75))).alias("k"), *df.columns).withColumn("id", F.concat(F.lit("copy"), "k")).select(*df.columns)
    after = {r.id: r.is_prose for r in prose.text_statistics(df.union(copies), samples).collect()}
    first = one.first().id
    assert {i: after[i] for i in before} == before and {v for i, v in after.items() if i.startswith("copy")} == {before[first]}


def test_tiling():
    p = "a b c d e f".split()
    assert defects.tiling(p, "x a b c y d e f a b c".split(), 3) == (9, 6)
    assert defects.tiling(p, [], 3) == (0, 0) and defects.tiling([], p, 3) == (0, 0)


def plain_tiling(pattern, text, least):
    """The longest free common run again and again, by trying every pair of places."""
    free, used, covered = [True] * len(text), [False] * len(pattern), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(text)):
            for i in range(len(pattern)):
                n = 0
                while i + n < len(pattern) and j + n < len(text) and free[j + n] and pattern[i + n] == text[j + n]:
                    n += 1
                best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if not n or n < min(least, len(pattern)):
            return covered, sum(used)
        for k in range(n):
            free[j + k], used[i + k] = False, True
        covered += n


def test_tiling_as_by_trying():
    rng = random.Random(5)
    for _ in range(300):
        p = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
        t = [rng.choice("abcde") for _ in range(rng.randrange(30))] + p * rng.randrange(3) + p[1:] * rng.randrange(3)
        assert defects.tiling(p, t, 2) == plain_tiling(p, t, 2)


@pytest.mark.parametrize("times", [10, 2000])
def test_copies_repeated_many_times(model, times):
    order = "Tell me what the old lamp of the town by the sea was"
    assert len(defects.tokens(order)) == 13
    copied = lambda output: defects.is_copy(defects.tokens(order), defects.tokens(output))
    assert copied(f"{order}. " * times) and copied(f"{order.replace('old', 'new')}. " * times)
    assert not copied(f"{order}. " + "The lamp stood near a harbour and burned all night. " * times)
    assert defects.defects(model, order, f"{order}. " * times) == ["copy"]


@pytest.mark.parametrize(
    ("tail", "off"),
    [
        ("It follows from (see the list.", True), ('She said "we will leave now.', True), ("<table><tr><td>cell one.", True), ('{"k": [1, 2.', True), ("She went to the", True),
        ("The rest:\n```python\nx = (1", True), ("\n1. One is here.\n2. Two is here.\n3. ", True), ("\n1. One is here.\n2. Two is", True), ("\n- a lamp\n- a b\n- c", False), ("\n1. Two of them!\n2. three old lamps\n3. four", True), ("\n1. Two.\n2. three\n3. four of them", False),
        ("She left. [52]", False), ('She said "we will leave now."', False), ('He asked "why?" and then left.', False), ("It is 5\" wide.", False), ("Fine :)", True), ("All is well. :)", False),
        ("The rest:\n```python\nx = (1\n```", False), ("Done.\n```python\nx = (1\n```\n", False), ("Line <br> two <b>is</b> here.", False), ("a) one.", False), ("\n“One.\n\n“Two.”", False), ("It’s done.", False),
    ],
)
def test_what_is_left_on_the_stack(tail, off):
    assert defects.breaks_off("He came home. " + tail) is off


def test_breaks_without_a_whole_sentence_before():
    for tail in ("It follows from (see the list", "She said", "- a lamp\n- a", '{"k": [1, 2', "```python\nx = 1"):
        assert not defects.breaks_off(tail)


def test_small_changes_and_scripts(model):
    assert defects.defects(model, "How was Ropatti made?", "How was harbour made?") == ["copy"]
    assert defects.defects(model, "How was Ropatti made?", "The old people made it.") == []
    hindi = "एक ठंडा बाज़ार और मौसम गया। एक नाव गया।"
    assert defects.defects(model, "Xq zv wk prt mlg?", hindi) == ["wrong_language"]


def test_ends_that_are_none():
    for text in ("Dr. Smith", "4.", "", "12", "A. B. Smith", "verse one\nverse two\nverse three\nverse. four\nverse five"):
        assert not defects.breaks_off(text)


def test_pairs_take_the_latest_row(spark, samples):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    rows = [(1, "Describe the lamp.", None, t), (1, "Describe the lamp.", SOUND, t.replace(month=2)), (2, None, None, t), (3, "Describe the lamp.", OPEN, t), (3, "Describe the lamp.", OPEN, t)]
    df = spark.createDataFrame(rows, "sft_id long, instruction string, output string, received_at timestamp").withColumn("at", F.lit(0)).withColumn("defects", F.lit("x"))
    got = {r.sft_id: r.defects for r in defects.pair_defects(df, samples).collect()}
    assert got == {1: [], 2: ["empty"], 3: ["truncated"]}
    assert defects.pair_defects(df.limit(0), samples).count() == 0


@pytest.fixture(scope="module")
def pieces(spark, data):
    return spark.read.parquet(f"{data}/tokenizer_pieces.parquet")


def test_counts_as_the_library(spark, data, pieces):
    from tokenizers import Tokenizer, models

    rows = pieces.orderBy("id").collect()
    lib = Tokenizer(models.Unigram([(r.piece, r.score) for r in rows], unk_id=3, byte_fallback=True))
    c = tokens.counter(pieces)
    for r in spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 3000").select("text").collect():
        assert c.count(r.text) == len(lib.encode(r.text.replace(" ", "▁")).ids)
    assert c.count("") == c.count(None) == 0


def test_cuts_change_nothing(pieces):
    c = tokens.counter(pieces)
    assert tokens.MARK in c.before
    text = "இந்த lamp  of\n\nthe town 😀 " * 40
    for size in (1, 7, 50, 10_000):
        parts = c.chunks(text, size)
        assert "".join(parts) == text and sum(map(c.count, parts)) == c.count(text)
    glued = tokens.UnigramCounter({"a": -1.0, "a▁b": -1.0, "▁": -2.0, "b": -1.0})
    assert tokens.MARK not in glued.before and glued.chunks("a b a b", 2) == ["a b a b"] and glued.count("a b") == 1


def test_oversized_documents(spark, data, pieces):
    df = spark.read.parquet(f"{data}/processed_shards.parquet")
    whole, cut = tokens.record_tokens(df, pieces), tokens.record_tokens(df, pieces, big_chars=200)
    assert sorted(whole.collect()) == sorted(cut.collect())
    assert whole.count() == df.select("id").distinct().count()
    total = tokens.slice_totals(whole).where("level = 7").first()
    assert total.n_tokens == whole.agg(F.sum("n_tokens")).first()[0]
    assert tokens.record_tokens(df.limit(0), pieces).count() == 0


def test_oversized_rows_delivered_twice(spark, pieces):
    import datetime as dt

    t, text = dt.datetime(2025, 1, 1), "இந்த lamp of the\n town " * 60
    rows = [("a", t, "s", "ta", "c", text)] * 3 + [("b", t, "s", "ta", "c", text), ("b", t, "s", "ta", "c", text + "more"), ("c", t, "s", "ta", "c", "lamp")]
    df = spark.createDataFrame(rows, "id string, written_at timestamp, source string, lang string, category string, text string").repartition(3)
    n = tokens.counter(pieces).count
    got = {r.id: r.n_tokens for r in tokens.record_tokens(df, pieces, big_chars=100).collect()}
    assert got == {"a": n(text), "b": n(text + "more"), "c": n("lamp")}
    each = tokens.document_tokens(df, pieces, "id", "text", ["source"], big_chars=100).collect()
    assert sorted((r.id, r.n_tokens) for r in each) == sorted((r[0], n(r[5])) for r in rows)


def test_clean_categories(spark):
    df = spark.createDataFrame([(" Ta-Web ",), ("TA  WEB",), ("ta_web",), ("",), (None,)], "c string")
    assert [r.x for r in df.select(tokens.clean_category("c").alias("x")).collect()] == ["ta_web"] * 3 + [None] * 2


CLEAN = ["மக்கள் இன்று அழகான நகரம் கண்டார் மழை வந்தது", "très légère lumière déjà entière forêt", "“The lamp’s door” – was warm…", "каждый холодный город тихий"]


@pytest.mark.parametrize("chain", [c for c in mojibake.CHAINS if c[0][-1] != "?"], ids="+".join)
def test_round_trips(spark, chain):
    rows = [(i, t) for i, t in enumerate(CLEAN * 2)]
    bad = [(100 + i, " ".join(mojibake.garble(w, chain) for w in t.split())) for i, t in enumerate(CLEAN[:1] + CLEAN[1:2])]
    df = spark.createDataFrame(rows + bad, "doc_id long, text string")
    got = {r.doc_id: r.restored for r in mojibake.restored_documents(df).collect()}
    assert set(got) == {100, 101}
    if "-" not in "".join(chain).replace("latin-1", ""):
        assert got[100] == CLEAN[0]


def test_long_words_are_garbled_too(spark):
    word = "山川日月火水木金土天" * 30
    bad = mojibake.garble(word, ("cp1252-",))
    assert len(word) >= 200 and mojibake.ungarble(bad) is None
    df = spark.createDataFrame([(1, word), (2, word), (3, f"a {bad} b"), (4, "plain")], "doc_id long, text string")
    assert [(r.doc_id, r.restored) for r in mojibake.restored_documents(df).collect()] == [(3, f"a {word} b")]


def test_what_is_no_case(spark):
    rows = [
        (1, None), (2, ""), (3, "plain words"), (4, "SÃO NÃO MAÇÃ café naïve Âmbar £120 °C ® © »"), (5, "&#2970;&#3007; &amp; &quot;"),
        (6, "நொ été"), (7, CLEAN[0]), (8, CLEAN[3]), (9, "இன்�ு"), (10, "t�te"), (11, "".join(f"&#{ord(c)};" for c in mojibake.garble("மழை", ("latin-1",)))),
        (12, mojibake.garble("மழை", ("cp1252",))), (12, mojibake.garble("மழை", ("cp1252",))),
    ]
    df = spark.createDataFrame(rows + [(20 + i, t) for i, t in enumerate(CLEAN * 3)], "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("form", F.lit(2))
    assert sorted(r.doc_id for r in mojibake.garbled_documents(df).collect()) == [9, 10, 11, 12]
    assert mojibake.garbled_documents(df.limit(0)).count() == 0


def test_what_is_not_garbled_stays_byte_for_byte(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    bad = mojibake.garble("மழை", ("cp1252",))
    escaped = "".join(f"&#{ord(c)};" for c in mojibake.garble("நகரம்", ("latin-1",)))
    text = "AT&amp;T &#8217; x &lt;b&gt;\r\n  {} &#65;&#x42; {}"
    rows = [(i, c, t) for i, c in enumerate(CLEAN)] + [(50, text.format(bad, escaped), t), (50, text.format(bad, "old"), t.replace(year=2024)), (51, text.format("", ""), t)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ingested_at timestamp")
    got = {r.doc_id: r.restored for r in mojibake.restored_documents(df, order_col="ingested_at").collect()}
    assert got == {50: text.format("மழை", "நகரம்")}


def test_found_by_the_table_alone(spark):
    alone = mojibake.garble("вечер", ("cp1252",))  # its original stands nowhere
    part = "கண்டார்"[:3] + mojibake.LOST * 2 + "கண்டார்"[5:]
    rows = [(i, c) for i, c in enumerate(CLEAN)] + [(60, f"a {alone} b"), (61, part), (62, "x" + mojibake.LOST)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in mojibake.garbled_documents(df).collect()) == [61, 62]
    assert sorted(r.doc_id for r in mojibake.garbled_documents(df, beyond_table=True).collect()) == [60, 61, 62]
    assert {r.doc_id: r.restored for r in mojibake.restored_documents(df).collect()}[60] == "a вечер b"
    assert list(mojibake.lossy_forms("é1")) == [mojibake.LOST + "1"] and not list(mojibake.lossy_forms("é"))


def test_bloom_never_drops(spark):
    import numpy as np

    df = spark.range(2000).select(F.xxhash64("id").alias("h"))
    t = base.BloomTest(base.bloom(df, "h", 1 << 16))
    keys = np.array([r.h for r in df.collect()], dtype=np.int64).view(np.uint64)
    assert t(keys).all() and t(base.mix(np.arange(5000, dtype=np.uint64))).mean() < 0.2
    assert base.BloomTest(base.bloom(df.limit(0), "h", 1 << 10))(keys).sum() == 0
    assert pa is not None


def test_arrow_map_on_no_rows(spark):
    df = spark.createDataFrame([], "a long")
    assert base.arrow_map(df, lambda c: {"b": c["a"]}, "b long").count() == 0
