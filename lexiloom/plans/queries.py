"""Queries over the project's tables, one or more per operator, and the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrow_text, langid, normalize, script, tanglish, wordlists
from ..functions.chars import TAMIL, VIRAMA, VOWEL_SIGNS, WS, char_class, lines, words
from ..operators import augment, chat, dedup, lines as line_ops, metrics, mixture, packing, preference, quality, ratings, rewards, split, vocab
from ..operators import tables
from ..operators.tables import materialize
from ..sources import readers
from . import pipeline

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.spread(load(spark, d, "documents"), "doc_id")
    return rows.withColumn("text", F.coalesce("text", F.lit("")))


# --- pieces of SQL ------------------------------------------------------------------------------------------------------
DOCS = "d AS (SELECT doc_id, source, lang, category, coalesce(text, '') AS t FROM documents)"
CATEGORY = "coalesce(category, 'none')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def s_sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def s_strip(x: str) -> str:
    return s_sub(x, f"^[{WS}]+|[{WS}]+$")


def s_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def s_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q(f'[{WS}]+')}), lambda w: w <> '')"


def s_lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {s_strip('l')}), lambda l: l <> '')"


def s_ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"


def s_in(items) -> str:
    return "(" + ", ".join(q(x) for x in sorted(items)) + ")"


def s_fraction(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5({q(salt)} || {key}::VARCHAR), 1, 8))::BIGINT)::DOUBLE / 4294967296.0"


NORMAL = normalize.NormalizerConfig(html_unescape=False, urls="mask")


def s_normalize(x: str) -> str:
    x = s_sub(x, r"\r\n?", "\n")
    x = f"translate({x}, {q(normalize.INVISIBLE)}, '')"
    x = s_sub(x, normalize.CONTROL)
    x = f"nfc_normalize({x})"
    for c in VOWEL_SIGNS + VIRAMA:
        x = s_sub(x, f"{c}{{2,}}", c)
    x = s_sub(x, f"{VIRAMA}({char_class(VOWEL_SIGNS)})", r"\1")
    x = f"replace({x}, {q(normalize.SRI[0])}, {q(normalize.SRI[1])})"
    x = f"translate({x}, {q(normalize.QUOTES[0])}, {q(normalize.QUOTES[1])})"
    x = f"translate({x}, {q(normalize.DASHES[0])}, {q(normalize.DASHES[1])})"
    x = s_sub(x, normalize.URL, "<url>")
    x = s_sub(x, normalize.SPACES, " ")
    inner = WS.replace(r"\n", "")
    x = s_sub(x, rf"(?m)^[{inner}]+|[{inner}]+$")
    return s_strip(s_sub(x, r"\n{3,}", "\n\n"))


# --- text ---------------------------------------------------------------------------------------------------------------
@query(f"WITH {DOCS} SELECT doc_id, {s_normalize('t')} AS text FROM d")
def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", normalize.normalize("text", NORMAL).alias("text"))


def s_masked(x: str) -> str:
    """E-mails, then phones, without look-around: what stands before and behind is put back; phones twice, as they may share it."""
    w, n = r"[\p{L}\p{N}_]", r"\p{Nd}"
    x = s_sub(x, rf"(^|[^\p{{L}}\p{{N}}_])({w}[\p{{L}}\p{{N}}_.+-]*@[\p{{L}}\p{{N}}_-]+\.(?:[\p{{L}}\p{{N}}_.-]*{w}))", r"\1<email>")
    for _ in range(2):
        x = s_sub(x, rf"(^|[^{n}])(?:\+?91[\s-]?)?[6-9]{n}{{4}}[\s-]?{n}{{5}}($|[^{n}])", r"\1<phone>\2")
    return x


#: The documents hold neither: lines with contacts are put in front, which the row's number varies.
_CONTACTS = "'mail a.b+c' || doc_id || '@ex-ample.co.in, ring +91 98765 4' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || ' or 98765' || lpad((doc_id % 100000)::VARCHAR, 5, '0') || ' 9876543210, not 1' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || '98765432101 at ௧௨௩' || chr(10)"


@query(f"""WITH {DOCS}, x AS (SELECT doc_id, translate({s_sub(s_sub(f"{_CONTACTS} || regexp_replace(t, '@', ' at ', 'g')", chr(13) + chr(10) + '?', chr(10)), normalize.URL, '<url>')}, '௦௧௨௩௪௫௬௭௮௯', '0123456789') AS t FROM d) SELECT doc_id, {s_strip(s_masked('t'))} AS text FROM x""")
def normalize_masked(spark, d):
    """The masks and Tamil digits alone, the other steps off."""
    off = {k: False for k in ("html_unescape", "remove_invisible", "remove_control", "fix_tamil_signs", "unify_sri", "normalize_quotes", "normalize_dashes", "collapse_spaces", "strip_lines")}
    cfg = normalize.NormalizerConfig(**off, unicode_form="none", max_consecutive_newlines=0, tamil_digits_to_ascii=True, urls="mask", emails="mask", phones="mask")
    n = F.col("doc_id")
    digits = lambda m, k: F.lpad((n % m).cast("string"), k, "0")
    said = F.concat(F.lit("mail a.b+c"), n.cast("string"), F.lit("@ex-ample.co.in, ring +91 98765 4"), digits(10000, 4), F.lit(" or 98765"), digits(100000, 5), F.lit(" 9876543210, not 1"), digits(1000, 3), F.lit("98765432101 at ௧௨௩\n"))
    x = docs(spark, d).select("doc_id", F.concat(said, F.regexp_replace("text", "@", " at ")).alias("text"))
    return x.select("doc_id", normalize.normalize("text", cfg).alias("text"))


@query()
def normalize_full(spark, d):
    """Every step on, HTML and personal data included: not sayable in SQL, tested against Python."""
    cfg = normalize.NormalizerConfig(urls="remove", emails="mask", phones="mask", tamil_digits_to_ascii=True)
    return docs(spark, d).select("doc_id", normalize.normalize("text", cfg).alias("text"))


@query()
def html_unescape(spark, d):
    return docs(spark, d).select("doc_id", arrow_text.html_unescape("text").alias("text"))


@query(f"WITH {DOCS} SELECT doc_id, length(t) AS n_chars, len({s_words('t')}) AS n_words, len({s_lines('t')}) AS n_lines FROM d")
def doc_counts(spark, d):
    return docs(spark, d).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size(words("text")).cast("long").alias("n_words"), F.size(lines("text")).cast("long").alias("n_lines"))


@query(f"WITH {DOCS} SELECT doc_id, regexp_matches(t, '[{TAMIL}]') AS has_tamil, t = '' AS is_empty FROM d")
def text_presence(spark, d):
    return docs(spark, d).select("doc_id", script.has_tamil("text").alias("has_tamil"), (F.col("text") == "").alias("is_empty"))


@query(rf"WITH {DOCS} SELECT doc_id, md5({s_sub('lower(nfc_normalize(t))', normalize.NON_WORD)}) AS k FROM d")
def dedup_keys(spark, d):
    return docs(spark, d).select("doc_id", dedup.exact_key("text").alias("k"))


_CL = script.CLASSES


@query(f"""WITH {DOCS}, c AS (SELECT doc_id, {", ".join(f"{s_count('t', p)} AS {k}" for k, p in _CL.items())}, length(t) - {s_count('t', '[\\p{Mn}\\p{Mc}]')} AS graphemes FROM d)
SELECT *, tamil + latin + other AS letters, {s_ratio('tamil', '(tamil + latin + other)')} AS tamil_ratio, {s_ratio('latin', '(tamil + latin + other)')} AS latin_ratio FROM c""")
def script_statistics(spark, d):
    s = docs(spark, d).select("doc_id", script.script_stats("text").alias("s"), script.graphemes("text").cast("long").alias("graphemes"))
    return s.select("doc_id", *[F.col(f"s.{k}").cast("long").alias(k) for k in (*_CL, "letters")], "graphemes", "s.tamil_ratio", "s.latin_ratio")


_ENG = wordlists.ENGLISH
#: The lexicon is learned from the labelled samples, here as there.
_LEXICON = f"""lx AS (SELECT split_part(lower(trim(lang)), '-', 1) AS lang, unnest(list_transform(regexp_extract_all(text, {q(langid.LATIN_WORD)}, 1), lambda x: lower(x))) AS word FROM lang_samples),
lex AS (SELECT word FROM lx WHERE length(word) >= 2 GROUP BY word HAVING count(*) FILTER (WHERE lang = 'tanglish') > 0 AND count(*) FILTER (WHERE lang = 'en') = 0)"""


def lang_config(spark, d) -> langid.LangIdConfig:
    return langid.LangIdConfig(lexicon=wordlists.learned_lexicon(load(spark, d, "lang_samples")))


_ENDING = "(?:" + "|".join(wordlists.ROMANISED_ENDINGS) + ")$"
_SCORES = f"""{DOCS}, {_LEXICON}, w AS (SELECT doc_id, {", ".join(f"{s_count('t', _CL[k])} AS {k}" for k in ('tamil', 'latin', 'other'))}, list_transform(regexp_extract_all(t, {q(langid.LATIN_WORD)}, 1), lambda x: lower(x)) AS ws FROM d),
u AS (SELECT doc_id, unnest(ws) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n, count(word) AS known,
 count(*) FILTER (WHERE word IS NULL AND length(x) >= 5 AND x NOT IN {s_in(_ENG)} AND regexp_matches(x, {q(_ENDING)})) AS likely,
 count(*) FILTER (WHERE x IN {s_in(_ENG)}) AS common FROM u LEFT JOIN lex ON x = word GROUP BY doc_id),
s AS (SELECT w.doc_id, tamil, latin, other, tamil + latin + other AS letters, coalesce(n, 0) AS n_latin, coalesce(known, 0) AS known, coalesce(likely, 0) AS likely, coalesce(common, 0) AS common FROM w LEFT JOIN n USING (doc_id)),
r AS (SELECT *, {s_ratio('tamil', 'letters')} AS tr, {s_ratio('latin', 'letters')} AS lr, CASE WHEN n_latin = 0 THEN 0.0::DOUBLE ELSE (known + likely * 0.5::DOUBLE)::DOUBLE / n_latin END AS tg, {s_ratio('common', 'n_latin')} AS eng FROM s),
l AS (SELECT *, CASE WHEN letters < 20 THEN 'other' WHEN tr >= 0.6::DOUBLE AND lr >= 0.15::DOUBLE THEN 'code_mixed' WHEN tr >= 0.6::DOUBLE THEN 'ta' WHEN tr >= 0.15::DOUBLE AND lr >= 0.15::DOUBLE THEN 'code_mixed'
 WHEN lr >= 0.8::DOUBLE AND tg >= 0.12::DOUBLE AND tg >= eng * 0.5::DOUBLE THEN 'tanglish' WHEN lr >= 0.8::DOUBLE AND eng >= 0.08::DOUBLE THEN 'en' ELSE 'other' END AS lang FROM r)"""


@query(f"WITH {_SCORES} SELECT doc_id, n_latin, tg AS tanglish_score, eng AS english_score FROM l")
def latin_scores(spark, d):
    tg, eng = langid.latin_scores("text", lang_config(spark, d))
    return docs(spark, d).select("doc_id", F.size(langid.latin_words("text")).cast("long").alias("n_latin"), tg.alias("tanglish_score"), eng.alias("english_score"))


@query(f"WITH {_SCORES} SELECT doc_id, lang FROM l")
def language_labels(spark, d):
    return docs(spark, d).select("doc_id", langid.detect("text", lang_config(spark, d)).lang.alias("lang"))


_ROUTES = {"code_mixed": "mixed_pool", "tanglish": "romanised_pool"}


@query(f"""WITH {_SCORES} SELECT doc_id, lang, CASE WHEN lang NOT IN ('ta', 'en', 'code_mixed', 'tanglish') THEN 'lang_' || lang END AS reason,
CASE WHEN lang = 'ta' THEN 'ta_docs' WHEN lang = 'code_mixed' THEN 'mixed_pool' WHEN lang = 'tanglish' THEN 'romanised_pool' ELSE lang END AS route FROM l""")
def route_categories(spark, d):
    x = docs(spark, d).select("doc_id", langid.detect("text", lang_config(spark, d)).lang.alias("lang"))
    return x.select("doc_id", "lang", langid.allowed("lang", ["ta", "en", "code_mixed", "tanglish"]).alias("reason"), langid.route("lang", "ta", "ta_docs", {}, _ROUTES).alias("route"))


# --- lines --------------------------------------------------------------------------------------------------------------
_BOILER = line_ops.boilerplate_pattern(line_ops.LineFilterConfig())


@query(f"""WITH {DOCS}, x AS (SELECT doc_id, unnest(list_transform(string_split(t, chr(10)), lambda l: {s_strip('l')})) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM d)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE line <> '' AND regexp_matches(line, '[{{}}]')) AS curly, count(*) FILTER (WHERE line <> '' AND regexp_matches(lower(line), {q(_BOILER)})) AS boilerplate, count(*) FILTER (WHERE line = '') AS blank FROM x GROUP BY doc_id""")
def line_predicates(spark, d):
    x = docs(spark, d).select("doc_id", F.explode(F.transform(F.split("text", "\n", -1), lambda l: line_ops.strip(l))).alias("line"))
    full = F.col("line") != ""
    return x.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(full & F.col("line").rlike("[{}]")).alias("curly"), F.count_if(full & F.lower("line").rlike(_BOILER)).alias("boilerplate"), F.count_if(~full).alias("blank"))


_KEEP = f"(line = '' OR (length(line) >= 3 AND NOT regexp_matches(line, '[{{}}]') AND NOT regexp_matches(lower(line), {q(_BOILER)})))"


@query(f"""WITH {DOCS}, x AS (SELECT doc_id, unnest(list_transform(string_split(t, chr(10)), lambda l: {s_strip('l')})) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY n) AS rn FROM x WHERE {_KEEP}),
j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS t FROM k WHERE line = '' OR rn = 1 GROUP BY doc_id)
SELECT d.doc_id, coalesce({s_strip(s_sub('j.t', chr(10) + '{3,}', chr(10) * 2))}, '') AS text FROM d LEFT JOIN j USING (doc_id)""")
def filter_lines(spark, d):
    return docs(spark, d).select("doc_id", line_ops.filter_lines("text", line_ops.LineFilterConfig(min_chars=3)).alias("text"))


# --- quality ------------------------------------------------------------------------------------------------------------
_EDGE = char_class(quality.STRIP_MARKS)
_CLEAN = f"list_filter(list_transform(w, lambda x: {s_sub('x', f'^{_EDGE}+|{_EDGE}+$')}), lambda x: x <> '')"
_LEN = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
_COPIES = "list_filter(ls, lambda y: len(list_filter(ls, lambda z: z = y)) > 1)"
_BASIC = f"""{DOCS}, a AS (SELECT doc_id, source, t, {s_words('t')} AS w, {s_lines('t')} AS ls FROM d), b AS (SELECT *, {_CLEAN} AS cw FROM a),
m AS (SELECT doc_id, source, length(t) AS n_chars, len(w) AS n_words, len(ls) AS n_lines, {s_ratio(_LEN('cw'), 'len(cw)')} AS mean_word_len, {s_count('t', '#|\\.\\.\\.|…')}::DOUBLE / greatest(len(w), 1) AS symbol_word_ratio,
{s_ratio(f"len(list_filter(ls, lambda l: regexp_matches(l, {q(quality.BULLET)})))", 'len(ls)')} AS bullet_line_frac, {s_ratio(f"len(list_filter(ls, lambda l: regexp_matches(l, {q(quality.ELLIPSIS)})))", 'len(ls)')} AS ellipsis_line_frac,
{s_ratio(s_count('t', quality.DIGITS), 'length(t)')} AS digit_frac, {s_ratio(f"length(t) - length(translate(t, {q(quality.STRIP_MARKS)}, ''))", 'length(t)')} AS punct_frac,
{s_ratio(f'len({_COPIES})', 'len(ls)')} AS dup_line_frac, {s_ratio(_LEN(_COPIES), _LEN('ls'))} AS dup_line_char_frac,
len(list_filter(cw, lambda x: lower(x) IN {s_in(wordlists.ENGLISH)})) AS stopwords FROM b)"""
_BASIC_COLS = ("mean_word_len", "symbol_word_ratio", "bullet_line_frac", "ellipsis_line_frac", "digit_frac", "punct_frac", "dup_line_frac", "dup_line_char_frac")


@query(f"WITH {_BASIC} SELECT doc_id, n_chars, n_words, n_lines, {', '.join(_BASIC_COLS)}, stopwords FROM m")
def quality_metrics(spark, d):
    m = docs(spark, d).select("doc_id", quality.basic_metrics("text").alias("m"), quality.stopword_count("text", "english").cast("long").alias("stopwords"))
    whole = [F.col(f"m.{k}").cast("long").alias(k) for k in ("n_chars", "n_words", "n_lines")]
    return m.select("doc_id", *whole, *[f"m.{k}" for k in _BASIC_COLS], "stopwords")


def s_top(n: int) -> str:
    return f"""g{n} AS (SELECT doc_id, i, list_aggregate(w[i:i+{n - 1}], 'string_agg', ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM a)),
c{n} AS (SELECT doc_id, gram, count(*) AS c, min(i) AS f FROM g{n} GROUP BY doc_id, gram HAVING count(*) > 1),
t{n} AS (SELECT doc_id, length(replace(gram, ' ', '')) * c AS chars FROM c{n} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) = 1)"""


def s_dup(n: int) -> str:
    return f"""g{n} AS (SELECT doc_id, i, list_aggregate(w[i:i+{n - 1}], 'string_agg', ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM a)),
r{n} AS (SELECT doc_id, i FROM g{n} QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
p{n} AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS p FROM r{n}),
t{n} AS (SELECT doc_id, sum(length(a.w[p])) AS chars FROM p{n} JOIN a USING (doc_id) GROUP BY doc_id)"""


_NG = ", ".join([*(s_top(n) for n in quality.TOP_SIZES), *(s_dup(n) for n in quality.DUP_SIZES)])
_NG_COLS = ", ".join([*(f"coalesce(t{n}.chars::DOUBLE / total, 0.0::DOUBLE) AS top_{n}gram" for n in quality.TOP_SIZES), *(f"coalesce(t{n}.chars::DOUBLE / total, 0.0::DOUBLE) AS dup_{n}gram" for n in quality.DUP_SIZES)])
_NG_JOIN = " ".join(f"LEFT JOIN t{n} USING (doc_id)" for n in quality.TOP_SIZES + quality.DUP_SIZES)
_NGRAMS = f"{_NG}, ng AS (SELECT a.doc_id, {_NG_COLS} FROM (SELECT *, {_LEN('w')} AS total FROM a) a {_NG_JOIN})"


@query(f"WITH {_BASIC}, {_NGRAMS} SELECT * FROM ng")
def ngram_metrics(spark, d):
    return docs(spark, d).select("doc_id", quality.ngram_metrics("text").alias("g")).select("doc_id", "g.*")


_TH = quality.QualityThresholds(min_stopwords=2, stopwords="english", min_mean_word_len=2.5, max_mean_word_len=12.0)
_REASON = """CASE WHEN n_chars < 200 THEN 'too_short_chars' WHEN n_chars > 500000 THEN 'too_long_chars' WHEN n_words < 30 THEN 'too_few_words' WHEN n_words > 100000 THEN 'too_many_words'
WHEN mean_word_len < 2.5 OR mean_word_len > 12 THEN 'mean_word_len' WHEN symbol_word_ratio > 0.1::DOUBLE THEN 'symbol_ratio' WHEN bullet_line_frac > 0.9::DOUBLE THEN 'bullet_lines' WHEN ellipsis_line_frac > 0.3::DOUBLE THEN 'ellipsis_lines'
WHEN digit_frac > 0.25 THEN 'digit_frac' WHEN punct_frac > 0.25 THEN 'punct_frac' WHEN dup_line_frac > 0.3::DOUBLE THEN 'dup_lines' WHEN dup_line_char_frac > 0.2::DOUBLE THEN 'dup_line_chars'
WHEN top_2gram > 0.2::DOUBLE THEN 'top_2gram' WHEN top_3gram > 0.18::DOUBLE THEN 'top_3gram' WHEN top_4gram > 0.16::DOUBLE THEN 'top_4gram' WHEN dup_5gram > 0.15::DOUBLE THEN 'dup_5gram' WHEN dup_7gram > 0.13::DOUBLE THEN 'dup_7gram' WHEN dup_10gram > 0.1::DOUBLE THEN 'dup_10gram'
WHEN stopwords < 2 THEN 'few_stopwords' END"""
_JUDGED = f"{_BASIC}, {_NGRAMS}, j AS (SELECT doc_id, coalesce(source, 'unknown') AS source, {_REASON} AS reject_reason FROM m JOIN ng USING (doc_id))"


@query(f"WITH {_JUDGED} SELECT doc_id, reject_reason FROM j")
def reject_reasons(spark, d):
    return quality.quality_filter(docs(spark, d).select("doc_id", "text"), "text", _TH).select("doc_id", "reject_reason")


@query(f"WITH {_JUDGED} SELECT source, coalesce(reject_reason, 'kept') AS outcome, count(*) AS n FROM j GROUP BY ALL")
def stats_by_source(spark, d):
    x = quality.quality_filter(docs(spark, d).select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), "text"), "text", _TH)
    return x.groupBy("source", F.coalesce("reject_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


# --- duplicates ---------------------------------------------------------------------------------------------------------
_KEY = s_sub("lower(nfc_normalize(t))", normalize.NON_WORD)


@query(f"WITH {DOCS} SELECT doc_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) > 1 AS is_duplicate FROM d")
def exact_duplicates(spark, d):
    return dedup.exact_duplicates(docs(spark, d).select("doc_id", "text"), "text", "doc_id").select("doc_id", "is_duplicate")


_KW = f"list_filter(list_transform(string_split_regex(lower(nfc_normalize(t)), {q(f'[{WS}]+')}), lambda x: {s_sub('x', normalize.NON_WORD)}), lambda x: x <> '')"


@query(f"""WITH {DOCS}, k AS (SELECT doc_id, {_KW} AS w FROM d), c AS (SELECT *, list_aggregate(w, 'string_agg', '') AS s FROM k)
SELECT doc_id, CASE WHEN len(w) >= 5 THEN len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' '))))
 WHEN coalesce(length(s), 0) = 0 THEN 0 WHEN length(s) <= 12 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(s) - 10), lambda i: substr(s, i, 12)))) END AS shingles FROM c""")
def shingle_counts(spark, d):
    w = docs(spark, d).select("doc_id", dedup.key_words("text").alias("w"))
    return w.select("doc_id", F.size(dedup.shingles(F.col("w"))).cast("long").alias("shingles"))


@query()
def near_duplicates(spark, d):
    """Greedy first-wins near-duplicates; tested against a sequential replay."""
    return dedup.deduplicate(docs(spark, d).select("doc_id", "text"), "text", "doc_id").select("doc_id", "dup")


@query()
def dedup_counts(spark, d):
    return dedup.dedup_counts(near_duplicates(spark, d))


@query(f"WITH {DOCS}, r AS (SELECT row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS n FROM d) SELECT count(*) FILTER (WHERE n > 1) AS exact_dups, 0::BIGINT AS near_dups, count(*) FILTER (WHERE n = 1) AS \"unique\" FROM r")
def exact_dedup_counts(spark, d):
    return dedup.dedup_counts(dedup.deduplicate(docs(spark, d).select("doc_id", "text"), "text", "doc_id", dedup.DedupConfig(near=False)))


# --- split, sizes, augmentation -----------------------------------------------------------------------------------------
@query(f"""WITH x AS (SELECT doc_id, {CATEGORY} AS category, {s_fraction('doc_id', 'split:')} < 0.2 AS cand FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY category, cand ORDER BY doc_id) AS rn FROM x)
SELECT doc_id, category, CASE WHEN cand AND rn <= 7 THEN 'eval' ELSE 'train' END AS split_name FROM r""")
def eval_split(spark, d):
    x = docs(spark, d).select("doc_id", F.coalesce("category", F.lit("none")).alias("category"))
    return split.capped_split(x, "doc_id", "category", "doc_id", 0.2, 7).select("doc_id", "category", "split_name")


@query(f"SELECT {CATEGORY} AS category, CASE WHEN {s_fraction('doc_id', 'split:')} < 0.1 THEN 'eval' ELSE 'train' END AS split_name, count(*) AS docs, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY ALL")
def category_sizes(spark, d):
    x = docs(spark, d).select("doc_id", F.coalesce("category", F.lit("none")).alias("category"), "text")
    return pipeline.category_sizes(split.fraction_split(x, "doc_id", 0.1))


@query("WITH c AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), h AS (SELECT doc_id, t, substr(t, 1, 400) AS h FROM c), p AS (SELECT *, length(regexp_extract(h, '(?s)^(.*)\n', 1)) AS cut FROM h) SELECT doc_id, CASE WHEN length(t) <= 400 THEN t WHEN cut > 200 THEN substr(h, 1, cut) ELSE h END AS text FROM p")
def truncated(spark, d):
    return docs(spark, d).select("doc_id", augment.truncate("text", 400).alias("text"))


def s_spoken(x: str) -> str:
    for written, spoken in tanglish.SPOKEN_RULES:
        x = s_sub(x, rf"{written}([^\p{{L}}\p{{M}}]|$)", rf"{spoken}\1")
    return x


@query(f"WITH {DOCS} SELECT doc_id, {s_spoken('t')} AS text FROM d")
def spoken_forms(spark, d):
    return docs(spark, d).select("doc_id", tanglish.colloquialize("text").alias("text"))


@query()
def transliterated(spark, d):
    return docs(spark, d).select("doc_id", tanglish.transliterate("text").alias("text"))


@query()
def augmented(spark, d):
    x = docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), "text", F.coalesce("lang", F.lit("ta")).alias("lang"), F.lit("train").alias("split_name"))
    return augment.augment(x, augment.AugmentConfig(enabled=True, tanglish_fraction=0.2, spoken_fraction=0.2))


@query()
def curated_corpus(spark, d):
    """The whole pipeline over the raw documents: outcome of each."""
    rows = docs(spark, d).select("text", F.coalesce("source", F.lit("unknown")).alias("source"), "source_id", F.col("doc_id").alias("seq"))
    rules = pipeline.SourceRules(lang_hint="ta", category="ta_web", allowed_langs=("ta", "tanglish", "en", "code_mixed"))
    cfg = pipeline.PipelineConfig(langid=lang_config(spark, d), sources={"forum_dump_ta": rules}, quality={"default": {"min_words": 5, "min_chars": 50}, "ta": {"max_mean_word_len": 20.0}})
    return pipeline.curate(rows, cfg).select("seq", "source", "lang", "category", "outcome", "id")


# The pipeline in SQL: the documents normalised and line-filtered, then the pieces above over what is left.
_CLEANED = f"""d0 AS (SELECT doc_id, coalesce(source, 'unknown') AS source, {s_normalize("coalesce(text, '')")} AS t FROM documents),
fx AS (SELECT doc_id, unnest(list_transform(string_split(t, chr(10)), lambda l: {s_strip('l')})) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM d0),
fk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY n) AS rn FROM fx WHERE {_KEEP}),
fj AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS t FROM fk WHERE line = '' OR rn = 1 GROUP BY doc_id),
d AS (SELECT doc_id, source, coalesce({s_strip(s_sub('fj.t', chr(10) + '{3,}', chr(10) * 2))}, '') AS t FROM d0 LEFT JOIN fj USING (doc_id))"""
_OUTCOMES = f"""{_SCORES.replace(DOCS, _CLEANED)}, {_JUDGED.replace(DOCS + ", ", "")},
o AS (SELECT d.doc_id, d.source, l.lang, t, CASE WHEN t = '' THEN 'empty_after_cleaning' WHEN l.lang NOT IN ('ta', 'tanglish', 'en', 'code_mixed') OR (d.source <> 'forum_dump_ta' AND l.lang <> 'ta') THEN 'lang_' || l.lang ELSE j.reject_reason END AS reason FROM d JOIN l USING (doc_id) JOIN j USING (doc_id)),
e AS (SELECT doc_id AS seq, source, lang, length(t) AS chars, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason IS NULL, {_KEY} ORDER BY doc_id) > 1 THEN 'dup_exact' END, 'kept') AS outcome FROM o)"""


def _curated(spark, d) -> DataFrame:
    rows = docs(spark, d).select("text", F.coalesce("source", F.lit("unknown")).alias("source"), "source_id", F.col("doc_id").alias("seq"))
    rules = pipeline.SourceRules(lang_hint="ta", allowed_langs=("ta", "tanglish", "en", "code_mixed"))
    th = {"min_stopwords": 2, "stopwords": "english", "min_mean_word_len": 2.5, "max_mean_word_len": 12.0}
    cfg = pipeline.PipelineConfig(
        normalizer=NORMAL, line_filter=line_ops.LineFilterConfig(min_chars=3), langid=lang_config(spark, d), quality={"default": th},
        dedup=dedup.DedupConfig(near=False), sources={"forum_dump_ta": rules},
    )
    return pipeline.curate(rows, cfg)


@query(f"WITH {_OUTCOMES} SELECT seq, source, lang, outcome FROM e")
def curated_documents(spark, d):
    """The pipeline without its near-duplicate step and without entities, which SQL can't say: outcome of each document."""
    return _curated(spark, d).select("seq", "source", "lang", "outcome")


@query(f"""WITH {_OUTCOMES} SELECT source, outcome, count(*) AS n FROM (SELECT source, unnest(['seen', outcome, CASE WHEN outcome = 'kept' THEN 'lang_kept_' || lang END]) AS outcome FROM e) WHERE outcome IS NOT NULL GROUP BY ALL""")
def outcome_counts(spark, d):
    """Counts by source and outcome, as the run's stats hold them."""
    return pipeline.outcome_counts(_curated(spark, d))


# --- mixture and packing ------------------------------------------------------------------------------------------------
_WEIGHTS = {"ta_web": 0.4, "ta_news": 0.2, "en": 0.2, "tanglish": 0.1, "code_mixed": 0.1, "absent": 0.3}
_W_SQL = "w(category, w) AS (VALUES " + ", ".join(f"('{c}', {w}::DOUBLE)" for c, w in _WEIGHTS.items()) + ")"
_PLAN = f"""{_W_SQL}, b AS (SELECT doc_id, category, strlen(coalesce(text, '')) AS n FROM documents), t AS (SELECT category, sum(n)::BIGINT AS available_tokens FROM b GROUP BY category),
l AS (SELECT category, w, available_tokens FROM t JOIN w USING (category) WHERE available_tokens > 0), s AS (SELECT *, w / sum(w) OVER (ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS weight FROM l),
a AS (SELECT round_even(available_tokens * 1.0::DOUBLE / weight, 0) AS budget FROM s ORDER BY w DESC, category DESC LIMIT 1),
plan AS (SELECT category, available_tokens, least(round_even(weight * budget, 0), round_even(available_tokens * 4.0::DOUBLE, 0))::BIGINT AS target_tokens FROM s, a)"""


def _plan(spark, d) -> tuple[DataFrame, DataFrame]:
    x = docs(spark, d).select("doc_id", "category", packing.byte_count("text").alias("n"))
    return x, mixture.plan_table(mixture.token_totals(x, "category", "n"), _WEIGHTS)


@query(f"WITH {_PLAN} SELECT * FROM plan")
def mixture_plan(spark, d):
    return _plan(spark, d)[1].select("category", "available_tokens", "target_tokens")


@query(f"""WITH {_PLAN}, o AS (SELECT b.*, target_tokens, available_tokens, coalesce(sum(n) OVER (PARTITION BY b.category ORDER BY md5('1:' || doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b JOIN plan USING (category)),
c AS (SELECT doc_id, category, n, (target_tokens // available_tokens + CASE WHEN before < target_tokens - (target_tokens // available_tokens) * available_tokens THEN 1 ELSE 0 END)::INT AS copies FROM o) SELECT * FROM c WHERE copies > 0""")
def selected_documents(spark, d):
    x, plan = _plan(spark, d)
    return mixture.select_documents(x, plan, "doc_id", "category", "n").select("doc_id", "category", F.col("n").cast("long").alias("n"), "copies")


@query(f"""WITH {_PLAN}, o AS (SELECT b.*, target_tokens, available_tokens, coalesce(sum(n) OVER (PARTITION BY b.category ORDER BY md5('1:' || doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b JOIN plan USING (category)),
c AS (SELECT category, n * (target_tokens // available_tokens + CASE WHEN before < target_tokens - (target_tokens // available_tokens) * available_tokens THEN 1 ELSE 0 END) AS m FROM o)
SELECT category, sum(m)::BIGINT AS selected_tokens, (sum(sum(m)) OVER ())::BIGINT AS all_tokens FROM c GROUP BY category""")
def achieved_shares(spark, d):
    from pyspark.sql import Window

    s = selected_documents(spark, d).groupBy("category").agg(F.sum(F.col("n") * F.col("copies")).alias("selected_tokens"))
    return s.withColumn("all_tokens", F.sum("selected_tokens").over(Window.partitionBy(F.lit(0))))


@query(f"""WITH {_PLAN}, o AS (SELECT b.*, target_tokens, available_tokens, coalesce(sum(n) OVER (PARTITION BY b.category ORDER BY md5('1:' || doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b JOIN plan USING (category)),
c AS (SELECT doc_id, (target_tokens // available_tokens + CASE WHEN before < target_tokens - (target_tokens // available_tokens) * available_tokens THEN 1 ELSE 0 END)::INT AS copies FROM o) SELECT doc_id, unnest(range(0, copies))::INT AS copy_no FROM c WHERE copies > 0""")
def repeated_documents(spark, d):
    return mixture.repeat_rows(selected_documents(spark, d), "copies").select("doc_id", F.col("copy_no").cast("int").alias("copy_no"))


_SPANS = """b AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS n FROM documents), o AS (SELECT doc_id, n, (sum(n) OVER (ORDER BY md5('1:' || doc_id::VARCHAR), doc_id) - n)::BIGINT AS start FROM b),
e AS (SELECT *, unnest(range(start // 2048, (start + n - 1) // 2048 + 1)) AS block FROM o),
spans AS (SELECT block, doc_id, greatest(start, block * 2048) - start AS from_token, least(start + n, (block + 1) * 2048) - greatest(start, block * 2048) AS n, greatest(start, block * 2048) - block * 2048 AS at FROM e WHERE block < (SELECT sum(n) // 2048 FROM b))"""


@query(f"WITH {_SPANS} SELECT * FROM spans")
def block_spans(spark, d):
    x = docs(spark, d).select("doc_id", (packing.byte_count("text") + 1).alias("n"))
    return packing.block_spans(x, "doc_id", "n", 2048)


@query(f"WITH {_SPANS} SELECT block, sum(n)::BIGINT AS length, count(*) AS parts FROM spans GROUP BY block")
def packed_blocks(spark, d):
    tokens = materialize(packing.tokenized(docs(spark, d), "doc_id", "text"), "tokens")
    packed = packing.pack(tokens, "doc_id", 2048)
    parts = packing.block_spans(tokens, "doc_id", "n_tokens", 2048).groupBy("block").agg(F.count("*").alias("parts"))
    return packed.select("block", F.size("input_ids").cast("long").alias("length")).join(parts, "block")


@query(f"WITH {_SPANS}, x AS (SELECT DISTINCT block FROM spans) SELECT block, md5('1:' || block::VARCHAR) AS place FROM x ORDER BY md5('1:' || block::VARCHAR), block LIMIT 16")
def eval_blocks(spark, d):
    """A seeded sample of blocks; the limit is the operator."""
    x = docs(spark, d).select("doc_id", (packing.byte_count("text") + 1).alias("n"))
    blocks = packing.block_spans(x, "doc_id", "n", 2048).select("block").distinct()
    return packing.eval_blocks(blocks, 16).select("block", split.seeded_order("block", 1).alias("place"))


_BUDGET_W = {"ta_web": 0.5, "en": 0.3, "tanglish": 0.2, "absent": 1.0}
_CUT = f"substr({s_strip('l')}, 1, 200)"


@query(f"""WITH w(category, w) AS (VALUES {", ".join(f"('{c}', {v}::DOUBLE)" for c, v in _BUDGET_W.items())}), x AS (SELECT doc_id, category, coalesce(text, '') AS t, {_LEN(f"list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: {_CUT})")} AS n FROM documents),
p AS (SELECT DISTINCT category, w FROM x JOIN w USING (category)), g AS (SELECT category, floor(20000 * w / sum(w) OVER (ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS budget FROM p),
o AS (SELECT x.*, coalesce(sum(n) OVER (PARTITION BY category ORDER BY md5('1:' || doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
k AS (SELECT doc_id, category, t FROM o JOIN g USING (category) WHERE before < budget), e AS (SELECT doc_id, category, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line_no FROM k)
SELECT doc_id, category, line_no::INT AS line_no, {_CUT} AS line FROM e WHERE {_CUT} <> ''""")
def budget_lines(spark, d):
    return mixture.char_budget_lines(docs(spark, d), "category", "doc_id", "text", _BUDGET_W, 20_000, 200)


@query("SELECT doc_id, strlen(coalesce(text, '')) AS n, CASE WHEN strlen(coalesce(text, '')) < 2 THEN 0 ELSE greatest(ceil((strlen(coalesce(text, '')) - 512) / 256.0), 0) + 1 END::BIGINT AS windows FROM documents")
def sliding_windows(spark, d):
    x = docs(spark, d).select("doc_id", packing.byte_count("text").cast("long").alias("n"))
    return x.select("doc_id", "n", F.size(packing.sliding_spans("n", 512, 256)).cast("long").alias("windows"))


# --- metrics ------------------------------------------------------------------------------------------------------------
def _encodings(spark, d) -> DataFrame:
    x = docs(spark, d).select(F.coalesce("category", F.lit("none")).alias("text_set"), "text").where("text <> ''")
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    whole = F.filter(F.split("text", " ", -1), lambda c: c != "")
    kinds = F.array(F.struct(F.lit("chars").alias("tokenizer"), chars.alias("pieces"), F.col("text").alias("decoded")), F.struct(F.lit("words").alias("tokenizer"), whole.alias("pieces"), F.array_join(whole, " ").alias("decoded")))
    return x.select("text_set", "text", F.explode(kinds).alias("k")).select("text_set", "text", "k.*")


@query(f"""WITH x AS (SELECT {CATEGORY} AS text_set, text FROM documents WHERE text <> ''), e AS (SELECT 'chars' AS tokenizer, text_set, text, string_split(text, '') AS pieces, text AS decoded FROM x
 UNION ALL SELECT 'words', text_set, text, list_filter(string_split(text, ' '), lambda p: p <> ''), list_aggregate(list_filter(string_split(text, ' '), lambda p: p <> ''), 'string_agg', ' ') FROM x),
s AS (SELECT tokenizer, text_set, count(*) AS docs, sum(len(pieces))::BIGINT AS tokens, sum(len({s_words('text')}))::BIGINT AS words, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes, sum(length(text) - {s_count('text', '[\\p{Mn}\\p{Mc}]')})::BIGINT AS graphemes, count(*) FILTER (WHERE decoded = text) AS same FROM e GROUP BY ALL),
u AS (SELECT tokenizer, text_set, count(DISTINCT p) AS used FROM (SELECT tokenizer, text_set, unnest(pieces) AS p FROM e) GROUP BY ALL)
SELECT tokenizer, text_set, docs, tokens, words, chars, bytes, graphemes, same, used, tokens / greatest(words, 1) AS fertility, bytes / greatest(tokens, 1) AS bytes_per_token FROM s JOIN u USING (tokenizer, text_set)""")
def tokenizer_metrics(spark, d):
    m = metrics.tokenizer_metrics(_encodings(spark, d))
    return m.select("tokenizer", "text_set", "docs", "tokens", "words", "chars", "bytes", "graphemes", F.col("same").cast("long"), "used", "fertility", "bytes_per_token")


@query(f"""WITH x AS (SELECT text FROM documents WHERE text <> ''), e AS (SELECT string_split(text, '') AS b, {s_words('text')} AS n FROM x)
SELECT sum(len(b))::BIGINT AS base_tokens, sum(len(n))::BIGINT AS new_tokens, count(*) AS docs, count(*) FILTER (WHERE b = n) AS identical, 1 - sum(len(n)) / sum(len(b)) AS reduction FROM e""")
def encoding_comparison(spark, d):
    x = docs(spark, d).where("text <> ''").select(F.filter(F.split("text", ""), lambda c: c != "").alias("b"), words("text").alias("n"))
    return metrics.encoding_comparison(x, "b", "n").select("base_tokens", "new_tokens", "docs", "identical", "reduction")


@query(f"""WITH x AS (SELECT text FROM documents WHERE text <> ''), e AS (SELECT text, {s_words('text')} AS a, list_filter(string_split(text, ' '), lambda p: p <> '') AS b FROM x)
SELECT count(*) AS n_texts, (count(*) FILTER (WHERE a = b)) / count(*) AS agreement, (count(*) FILTER (WHERE list_aggregate(b, 'string_agg', ' ') = text)) / count(*) AS round_trip, 0.0::DOUBLE AS byte_fallback_rate FROM e""")
def tokenizer_validation(spark, d):
    """Two splits into words stand for the two tokenizers."""
    whole = F.filter(F.split("text", " ", -1), lambda c: c != "")
    x = docs(spark, d).where("text <> ''").select("text", words("text").alias("a"), whole.alias("b"), F.array_join(whole, " ").alias("back"))
    return metrics.agreement(x, "a", "b", "back", "text")


@query(f"""WITH x AS (SELECT {CATEGORY} AS text_set, unnest({s_words("coalesce(text, '')")}) AS word FROM documents), n AS (SELECT text_set, word, count(*) AS n FROM x GROUP BY ALL)
SELECT 'chars' AS tokenizer, text_set, sum(CASE WHEN length(word) >= 2 THEN n ELSE 0 END)::BIGINT AS continued, sum(n)::BIGINT AS words, sum(CASE WHEN length(word) >= 2 THEN n ELSE 0 END) / sum(n) AS continued_ratio FROM n GROUP BY text_set""")
def continued_words(spark, d):
    """Words are encoded once each, by characters, and weigh by their number."""
    x = docs(spark, d).select(F.coalesce("category", F.lit("none")).alias("text_set"), F.explode(words("text")).alias("word")).groupBy("text_set", "word").agg(F.count("*").alias("n"))
    return metrics.continued_words(x.select(F.lit("chars").alias("tokenizer"), "text_set", "word", "n", F.length("word").alias("tokens")))


_NLL = f"SELECT {CATEGORY} AS category, (length(text) * 3)::BIGINT AS nll, len({s_words('text')}) AS tokens, strlen(text) AS bytes, length(text) AS chars, len({s_words('text')}) AS words FROM documents WHERE text <> ''"


@query(f"""WITH x AS ({_NLL}), s AS (SELECT category, count(*) AS docs, sum(nll)::BIGINT AS nll, sum(tokens)::BIGINT AS tokens, sum(bytes)::BIGINT AS bytes, sum(chars)::BIGINT AS chars FROM x GROUP BY category)
SELECT category, docs, nll, tokens, bytes, chars, round(nll / greatest(bytes, 1) / ln(2.0::DOUBLE), 6) AS bits_per_byte, round(ln(exp(least(nll / greatest(tokens, 1), 50.0::DOUBLE))), 6) AS log_perplexity FROM s""")
def likelihood_metrics(spark, d):
    x = docs(spark, d).where("text <> ''").select(F.coalesce("category", F.lit("none")).alias("category"), (F.length("text") * 3).cast("long").alias("nll"), F.size(words("text")).alias("tokens"), F.octet_length("text").alias("bytes"), F.length("text").alias("chars"), F.size(words("text")).alias("words"))
    m = metrics.likelihood_metrics(x, "category")
    return m.select("category", "docs", "nll", "tokens", "bytes", "chars", F.round("bits_per_byte", 6).alias("bits_per_byte"), F.round(F.log("token_perplexity"), 6).alias("log_perplexity"))


_CHOICES = "SELECT item_id, category, label, c.i AS choice, -(('0x' || substr(md5(item_id || ':' || c.i::VARCHAR), 1, 4))::BIGINT)::DOUBLE AS logprob, strlen(choices[c.i + 1]) AS bytes FROM tamil_cloze, (SELECT unnest(range(0, 10))::INT AS i) c WHERE c.i < len(choices)"


@query(f"""WITH s AS ({_CHOICES}), b AS (SELECT item_id, any_value(category) AS category, any_value(label) AS label, arg_max(choice, logprob * 1000 - choice) AS pick, arg_max(choice, (logprob / greatest(bytes, 1), -choice)) AS pick_norm FROM s GROUP BY item_id),
r AS (SELECT category, count(*) AS n, sum((pick = label)::INT)::BIGINT AS hits, sum((pick_norm = label)::INT)::BIGINT AS hits_norm, grouping(category)::INT AS total FROM b GROUP BY ROLLUP (category))
SELECT category, n, hits, hits_norm, total, hits / n AS acc FROM r WHERE total = 1 OR category IS NOT NULL""")
def choice_accuracy(spark, d):
    x = load(spark, d, "tamil_cloze").select("item_id", "category", "label", F.posexplode("choices").alias("choice", "text"))
    lp = -F.conv(F.substring(F.md5(F.concat_ws(":", "item_id", F.col("choice").cast("string"))), 1, 4), 16, 10).cast("double")
    m = metrics.choice_accuracy(x.select("item_id", "category", "label", "choice", lp.alias("logprob"), F.octet_length("text").alias("bytes")))
    return m.select("category", "n", "hits", "hits_norm", F.col("total").cast("int").alias("total"), "acc")


@query("SELECT context, choices, label, category FROM tamil_cloze")
def cloze_items(spark, d):
    return metrics.cloze_items(load(spark, d, "tamil_cloze"))


@query(r"SELECT regexp_replace(context, '[\x{964}. ]+$', '') || CASE WHEN label % 2 = 0 THEN ' ஏனென்றால்' ELSE ' எனவே' END AS context, [' ' || choices[1], ' ' || choices[2]] AS choices, (label % 2)::INT AS label, CASE WHEN label % 2 = 0 THEN 'cause' ELSE 'effect' END AS category FROM tamil_cloze")
def copa_items(spark, d):
    x = load(spark, d, "tamil_cloze")
    return metrics.copa_items(x.select(F.col("context").alias("premise"), F.when(F.col("label") % 2 == 0, "cause").otherwise("effect").alias("question"), F.col("choices")[0].alias("choice1"), F.col("choices")[1].alias("choice2"), (F.col("label") % 2).alias("label")))


_LABELS = {"ta": " நேர்மறையானது", "en": " எதிர்மறையானது"}


@query("SELECT text || chr(10) || 'இந்த விமர்சனம்' AS context, [' நேர்மறையானது', ' எதிர்மறையானது'] AS choices, (CASE WHEN lang = 'ta' THEN 0 ELSE 1 END)::INT AS label FROM lang_samples WHERE lang IN ('ta', 'en')")
def sentiment_items(spark, d):
    return metrics.sentiment_items(load(spark, d, "lang_samples"), "text", "lang", _LABELS).select("context", "choices", "label")


@query(f"""WITH x AS (SELECT doc_id, {CATEGORY} AS c, substr(coalesce(text, ''), 1, 300) AS text FROM documents), s AS (SELECT CASE WHEN c IN ('ta_web', 'ta_news') THEN 'tamil' WHEN c = 'en' THEN 'english' END AS text_set, doc_id, text FROM x)
SELECT text_set, doc_id, text FROM s WHERE text_set IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text_set ORDER BY doc_id) <= 50""")
def evaluation_sets(spark, d):
    """The first documents of each set; the limit is the operator."""
    return metrics.text_sets(docs(spark, d), {"tamil": ["ta_web", "ta_news"], "english": ["en"]}, "category", "doc_id", "text", 300, 50)


@query(f"""WITH x AS (SELECT doc_id, {CATEGORY} AS category, coalesce(text, '') AS text, {s_fraction('doc_id', 'split:')} < 0.01 AS e FROM documents), h AS (SELECT DISTINCT category FROM x WHERE e),
y AS (SELECT * FROM x WHERE e OR category NOT IN (SELECT category FROM h)) SELECT category, doc_id, substr(text, 1, 3000) AS text FROM y QUALIFY row_number() OVER (PARTITION BY category ORDER BY doc_id) <= 3""")
def sample_texts(spark, d):
    x = split.fraction_split(docs(spark, d).select("doc_id", F.coalesce("category", F.lit("none")).alias("category"), "text"), "doc_id", 0.01)
    return metrics.sample_texts(x, "category", "split_name", "doc_id", "text", 3)


# --- ratings ------------------------------------------------------------------------------------------------------------
def _ratings(spark, d) -> DataFrame:
    """As delivered, one row per rating_id: the first received."""
    r = load(spark, d, "ratings")
    cols = [c for c in r.columns if c not in ("rating_id", "received_at", "scores", "chat_scores")]
    score = lambda m: F.array_sort(F.map_entries(m))
    flat = r.select("rating_id", "received_at", *cols, score("scores.a").alias("sa"), score("scores.b").alias("sb"), score("chat_scores").alias("sc"))
    first = flat.groupBy("rating_id").agg(F.min(F.struct("received_at", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"k_{c}") for c in cols], *cols, "sa", "sb", "sc")).alias("x"))
    back = lambda c: F.when(F.col(f"x.{c}").isNotNull(), F.map_from_entries(f"x.{c}"))
    return first.select("rating_id", *[F.col(f"x.{c}").alias(c) for c in cols], F.struct(back("sa").alias("a"), back("sb").alias("b")).alias("scores"), back("sc").alias("chat_scores"))


_R = "r AS (SELECT * FROM ratings QUALIFY row_number() OVER (PARTITION BY rating_id ORDER BY received_at, coalesce(mode, ''), coalesce(category, ''), coalesce(prompt_id, ''), coalesce(model_a, ''), coalesce(model_b, ''), coalesce(model, ''), coalesce(winner, '')) = 1)"
_OKMAP = lambda m: f"coalesce(len(list_filter(map_entries({m}), lambda e: NOT coalesce(e.key IN ('correctness', 'fluency', 'helpfulness') AND e.value BETWEEN 1 AND 5, false))) = 0, true)"
_VALID = f"""coalesce(CASE mode WHEN 'compare' THEN winner IN ('a', 'b', 'tie', 'both_bad') AND coalesce(model_a, '') <> '' AND coalesce(model_b, '') <> '' AND {_OKMAP('scores.a')} AND {_OKMAP('scores.b')} WHEN 'chat' THEN coalesce(model, '') <> '' AND {_OKMAP('chat_scores')} END, false)"""
_SIDES = f"""{_R}, v AS (SELECT * FROM r WHERE {_VALID}), s AS (SELECT model_a AS model, coalesce(category, 'custom') AS category, CASE winner WHEN 'a' THEN 'win' WHEN 'b' THEN 'loss' WHEN 'tie' THEN 'tie' ELSE 'both_bad' END AS outcome, scores.a AS sc FROM v WHERE mode = 'compare'
UNION ALL SELECT model_b, coalesce(category, 'custom'), CASE winner WHEN 'b' THEN 'win' WHEN 'a' THEN 'loss' WHEN 'tie' THEN 'tie' ELSE 'both_bad' END, scores.b FROM v WHERE mode = 'compare' UNION ALL SELECT model, coalesce(category, 'custom'), NULL, chat_scores FROM v WHERE mode = 'chat')"""
_SUMMARY = f"""{_SIDES}, g AS (SELECT model, category, count(outcome) AS n, count(*) FILTER (WHERE outcome = 'win') AS wins, count(*) FILTER (WHERE outcome = 'loss') AS losses, count(*) FILTER (WHERE outcome = 'tie') AS ties, count(*) FILTER (WHERE outcome = 'both_bad') AS both_bad FROM s GROUP BY GROUPING SETS ((model), (model, category)))"""


def _valid_ratings(spark, d) -> DataFrame:
    return _ratings(spark, d).where(ratings.valid())


@query(f"WITH {_R} SELECT rating_id, {_VALID} AS valid FROM r")
def rating_validation(spark, d):
    return _ratings(spark, d).select("rating_id", ratings.valid().alias("valid"))


@query(f"WITH {_SUMMARY} SELECT *, CASE WHEN n > 0 THEN (wins + 0.5::DOUBLE * (ties + both_bad)) / n END AS win_rate FROM g")
def rating_summary(spark, d):
    return ratings.summary(_valid_ratings(spark, d))


@query(f"""WITH {_SIDES}, e AS (SELECT model, unnest(map_entries(sc)) AS x FROM s) SELECT model, x.key AS criterion, count(*) AS n, sum(x.value)::BIGINT AS total FROM e WHERE x.value IS NOT NULL GROUP BY ALL""")
def criterion_means(spark, d):
    return ratings.criterion_means(_valid_ratings(spark, d)).drop("mean")


@query(f"""WITH {_SUMMARY}, o AS (SELECT model, n, wins, losses, ties, both_bad, CASE WHEN n > 0 THEN (wins + 0.5::DOUBLE * (ties + both_bad)) / n END AS win_rate FROM g WHERE category IS NULL),
f AS (SELECT model, min(rating_id) AS f FROM (SELECT rating_id, unnest([model_a, model_b, model]) AS model FROM v) WHERE model IS NOT NULL GROUP BY model)
SELECT row_number() OVER (ORDER BY win_rate DESC NULLS LAST, f NULLS LAST, o.model)::INT AS rank_no, o.* FROM o LEFT JOIN f USING (model)""")
def rating_ranking(spark, d):
    return ratings.ranking(_valid_ratings(spark, d), "rating_id")


@query(f"""WITH {_R}, v AS (SELECT * FROM r WHERE {_VALID} AND mode = 'compare'), p AS (SELECT least(model_a, model_b) AS x, greatest(model_a, model_b) AS y, CASE winner WHEN 'a' THEN model_a WHEN 'b' THEN model_b END AS w FROM v)
SELECT x, y, count(*) FILTER (WHERE w = x) AS x_wins, count(*) FILTER (WHERE w = y) AS y_wins, count(*) FILTER (WHERE w IS NULL) AS ties FROM p GROUP BY x, y""")
def head_to_head(spark, d):
    return ratings.head_to_head(_valid_ratings(spark, d))


@query(f"WITH {_R} SELECT count(*) AS total, count(*) FILTER (WHERE mode = 'compare') AS compare, count(*) FILTER (WHERE mode = 'chat') AS chat FROM r")
def rating_counts(spark, d):
    return ratings.counts(_ratings(spark, d))


_ADV = f"""{_R}, x AS (SELECT rating_id, prompt_id, list_sum(map_values(chat_scores))::BIGINT AS reward FROM r WHERE {_VALID} AND mode = 'chat' AND prompt_id IS NOT NULL AND len(map_values(chat_scores)) > 0), y AS (SELECT * FROM x WHERE reward IS NOT NULL),
m AS (SELECT *, sum(reward) OVER w / count(*) OVER w AS group_mean, sum(reward * reward) OVER w / count(*) OVER w AS sq FROM y WINDOW w AS (PARTITION BY prompt_id)), s AS (SELECT *, sqrt(greatest(sq - group_mean * group_mean, 0.0::DOUBLE)) AS group_std FROM m)"""


@query(f"WITH {_ADV} SELECT rating_id, prompt_id, reward, round(group_mean, 6) AS group_mean, round(group_std, 6) AS group_std, group_std < 0.000001 AS skipped, round((reward - group_mean) / (group_std + 0.0001), 6) AS advantage FROM s")
def group_advantages(spark, d):
    r = _valid_ratings(spark, d).where("mode = 'chat' and prompt_id is not null and size(chat_scores) > 0")
    x = r.select("rating_id", "prompt_id", F.aggregate(F.map_values("chat_scores"), F.lit(0).cast("long"), lambda a, v: a + v).alias("reward")).where("reward is not null")
    g = metrics.group_advantages(x, "prompt_id", "reward")
    return g.select("rating_id", "prompt_id", "reward", *[F.round(c, 6).alias(c) for c in ("group_mean", "group_std")], "skipped", F.round("advantage", 6).alias("advantage"))


@query(f"""WITH {_SIDES}, e AS (SELECT category, unnest(map_entries(sc)) AS x FROM s) SELECT category AS step, x.key AS metric, count(*) AS n, round(sum(x.value) / count(*), 6) AS mean FROM e WHERE x.value IS NOT NULL GROUP BY ALL""")
def step_means(spark, d):
    e = ratings.sides(_valid_ratings(spark, d)).select(F.col("category").alias("step"), F.explode("scores").alias("metric", "value")).where("value is not null")
    return metrics.step_means(e, "step", "metric", "value").withColumn("mean", F.round("mean", 6))


# --- conversations, pairs, rewards --------------------------------------------------------------------------------------
def _sft(spark, d) -> DataFrame:
    cols = ("instruction", "input", "output", "source")
    key = [F.coalesce(F.col(c), F.lit("")).alias(f"k_{c}") for c in cols]
    first = load(spark, d, "sft_sample").groupBy("sft_id").agg(F.min(F.struct("received_at", *key, *cols)).alias("x"))
    return first.select("sft_id", *[F.col(f"x.{c}").alias(c) for c in cols])


_I, _X, _O = (s_strip(f"coalesce({c}, '')") for c in ("instruction", "input", "output"))
_S = f"""f AS (SELECT * FROM sft_sample QUALIFY row_number() OVER (PARTITION BY sft_id ORDER BY received_at, coalesce(instruction, ''), coalesce(input, ''), coalesce(output, ''), coalesce(source, '')) = 1), c AS (SELECT sft_id, {_I} AS i, {_X} AS x, {_O} AS o FROM f),
m AS (SELECT sft_id, CASE WHEN x = '' THEN i ELSE i || chr(10) || chr(10) || x END AS u, o FROM c WHERE i <> '' AND o <> '')"""


def _messages(spark, d) -> DataFrame:
    return chat.conversations(_sft(spark, d), chat.alpaca("instruction", "input", "output"), "sft_sample")


@query(f"WITH {_S} SELECT sft_id, u AS user_text, o AS assistant_text, 2::INT AS turns FROM m")
def alpaca_messages(spark, d):
    m = _messages(spark, d)
    return m.select("sft_id", F.col("messages")[0].content.alias("user_text"), F.col("messages")[1].content.alias("assistant_text"), F.size("messages").alias("turns"))


@query(f"WITH {_S} SELECT sft_id, 'Be brief.' || chr(10) || chr(10) || u AS u0, '<start_of_turn>user' || chr(10) || 'Be brief.' || chr(10) || chr(10) || u || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) || o || '<end_of_turn>' || chr(10) AS rendered FROM m")
def rendered_chats(spark, d):
    m = chat.conversations(_sft(spark, d), chat.alpaca("instruction", "input", "output"), "sft_sample", system_prompt="Be brief.")
    return m.select("sft_id", F.concat(F.lit("Be brief.\n\n"), F.col("messages")[1].content).alias("u0"), chat.rendered("messages").alias("rendered"))


@query(f"WITH {_S} SELECT sft_id, (strlen(u) + strlen(o) + 70)::BIGINT AS n, (strlen(o) + 13)::BIGINT AS labelled FROM m WHERE strlen(u) + strlen(o) + 70 <= 1024")
def encoded_chats(spark, d):
    x = _messages(spark, d).withColumn("e", chat.encode("messages", 1024)).where("e.input_ids is not null")
    return x.select("sft_id", F.size("e.input_ids").cast("long").alias("n"), F.size(F.filter("e.labels", lambda v: v != -100)).cast("long").alias("labelled"))


@query(f"WITH {_S}, e AS (SELECT (strlen(o) + 13)::BIGINT AS labelled, (strlen(u) + strlen(o) + 70)::BIGINT AS n FROM m) SELECT sum(labelled)::BIGINT AS labelled, sum(n)::BIGINT AS tokens FROM e WHERE n <= 1024")
def label_share(spark, d):
    x = _messages(spark, d).select(chat.encode("messages", 1024).alias("e")).where("e.input_ids is not null").select("e.*")
    return chat.label_share(x).select("labelled", "tokens")


@query(f"WITH {_S} SELECT min(sft_id) AS sft_id, CASE WHEN {s_fraction('min(sft_id)', 'split:')} < 0.1 THEN 'eval' ELSE 'train' END AS split_name FROM m GROUP BY u, o")
def sft_dedup_split(spark, d):
    x = dedup.first_of_value(_messages(spark, d), F.to_json("messages"), "sft_id")
    return split.fraction_split(x, "sft_id", 0.1).select("sft_id", "split_name")


@query(f"WITH {_S} SELECT sft_id, u AS prompt, o AS reference FROM m")
def rl_prompts(spark, d):
    x = _messages(spark, d).withColumn("p", chat.rl_prompts("messages")).where("p is not null")
    return x.select("sft_id", F.col("p.prompt")[0].content.alias("prompt"), "p.reference")


@query(f"WITH {_S}, t AS (SELECT sft_id, i, x, o FROM c WHERE x <> '' AND i <> '') SELECT sft_id, 'Text: ' || x || chr(10) || 'Ask: ' || i AS prompt, CASE WHEN o = '' THEN '-' ELSE o END AS reply FROM t")
def question_answer(spark, d):
    m = chat.question_answer("input", "instruction", "output", "Text: {context}\nAsk: {question}", "-")
    x = _sft(spark, d).withColumn("m", m).where("m is not null")
    return x.select("sft_id", F.col("m")[0].content.alias("prompt"), F.col("m")[1].content.alias("reply"))


@query(f"WITH {_S} SELECT sft_id, u || chr(10) || chr(10) || o AS flat FROM m")
def flattened_chats(spark, d):
    return _messages(spark, d).select("sft_id", chat.flattened("messages").alias("flat"))


@query("WITH x AS (SELECT item_id, context AS p, choices[label + 1] AS chosen, unnest(choices) AS rejected FROM tamil_cloze) SELECT item_id, p AS prompt, chosen, rejected FROM x WHERE p <> '' AND chosen <> '' AND rejected <> '' AND chosen <> rejected")
def preference_pairs(spark, d):
    x = load(spark, d, "tamil_cloze").select("item_id", "context", F.get("choices", F.col("label")).alias("good"), F.explode("choices").alias("bad"))
    y = x.withColumn("pair", preference.pair("context", "good", "bad")).where("pair is not null")
    return y.select("item_id", F.col("pair.messages")[0].content.alias("prompt"), "pair.chosen", "pair.rejected")


_RP = f"{_R}, v AS (SELECT * FROM r WHERE {_VALID} AND mode = 'compare' AND winner IN ('a', 'b')), j AS (SELECT rating_id, prompt AS p, {s_strip('model_a')} AS a, {s_strip('model_b')} AS b, winner FROM v JOIN chat_eval_prompts ON prompt_id = id)"


@query(f"WITH {_RP} SELECT rating_id, p AS prompt, CASE winner WHEN 'a' THEN a ELSE b END AS chosen, CASE winner WHEN 'a' THEN b ELSE a END AS rejected FROM j WHERE p <> '' AND a <> b")
def rating_pairs(spark, d):
    """Decided ratings as pairs; the table has no responses, so the models' names stand for them."""
    r = _valid_ratings(spark, d).where("mode = 'compare'").join(load(spark, d, "chat_eval_prompts").select(F.col("id").alias("prompt_id"), "prompt"), "prompt_id")
    y = r.withColumn("pair", preference.pair_of_rating("winner", "prompt", "model_a", "model_b")).where("pair is not null")
    return y.select("rating_id", F.col("pair.messages")[0].content.alias("prompt"), "pair.chosen", "pair.rejected")


def s_tokens(x: str) -> str:
    plain = s_sub(f"lower(nfc_normalize({x}))", rf"[^\p{{L}}\p{{N}}_{WS}\x{{0B80}}-\x{{0BFF}}]", " ")
    return f"list_filter(string_split_regex({plain}, {q(f'[{WS}]+')}), lambda w: w <> '')"


@query(f"""WITH {_S}, t AS (SELECT sft_id, {s_tokens('o')} AS p, {s_tokens('u')} AS g, o, u FROM m), pc AS (SELECT sft_id, w, count(*) AS c FROM (SELECT sft_id, unnest(p) AS w FROM t) GROUP BY ALL), gc AS (SELECT sft_id, w, count(*) AS c FROM (SELECT sft_id, unnest(g) AS w FROM t) GROUP BY ALL),
k AS (SELECT sft_id, sum(least(pc.c, gc.c))::BIGINT AS common FROM pc JOIN gc USING (sft_id, w) GROUP BY sft_id)
SELECT sft_id, coalesce(common, 0) AS common, len(p) AS n_pred, len(g) AS n_gold, CASE WHEN coalesce(common, 0) = 0 THEN 0.0::DOUBLE ELSE round(2 * (common / len(p)) * (common / len(g)) / (common / len(p) + common / len(g)), 9) END AS f1,
 (CASE WHEN len(g) > 0 AND contains(array_to_string(p, ' '), array_to_string(g, ' ')) THEN 1.0 ELSE 0.0 END)::DOUBLE AS inside, CASE WHEN len({s_words('o')}) < 2 THEN len({s_words('o')}) / 2.0::DOUBLE WHEN len({s_words('o')}) > 120 THEN greatest(0.0::DOUBLE, 1 - (len({s_words('o')}) - 120) / 120.0::DOUBLE) ELSE 1.0::DOUBLE END AS length FROM t LEFT JOIN k USING (sft_id)""")
def reward_parts(spark, d):
    m = _messages(spark, d).select("sft_id", F.col("messages")[0].content.alias("u"), F.col("messages")[1].content.alias("o"))
    tokens = rewards.with_tokens(m, p="o", g="u")
    common = F.size(F.array_intersect(rewards.occurrences(F.col("p")), rewards.occurrences(F.col("g"))))
    return tokens.select("sft_id", common.cast("long").alias("common"), F.size("p").cast("long").alias("n_pred"), F.size("g").cast("long").alias("n_gold"), F.round(rewards.token_f1(F.col("p"), F.col("g")), 9).alias("f1"), rewards.contains_answer(F.col("p"), F.col("g"), "u").alias("inside"), rewards.length("o").alias("length"))


_REWARDED = f"""{_S}, t AS (SELECT sft_id, {s_tokens('o')} AS p, {s_tokens('u')} AS g, o, u FROM m), pc AS (SELECT sft_id, w, count(*) AS c FROM (SELECT sft_id, unnest(p) AS w FROM t) GROUP BY ALL), gc AS (SELECT sft_id, w, count(*) AS c FROM (SELECT sft_id, unnest(g) AS w FROM t) GROUP BY ALL),
k AS (SELECT sft_id, sum(least(pc.c, gc.c))::BIGINT AS common FROM pc JOIN gc USING (sft_id, w) GROUP BY sft_id),
r4 AS (SELECT sft_id, i, list_aggregate(p[i:i+3], 'string_agg', ' ') AS gram FROM (SELECT sft_id, p, unnest(range(1, len(p) - 2)) AS i FROM t)), again AS (SELECT sft_id, i FROM r4 QUALIFY count(*) OVER (PARTITION BY sft_id, gram) > 1),
cov AS (SELECT DISTINCT sft_id, unnest(range(i, i + 4)) AS place FROM again), rep AS (SELECT sft_id, sum(length(t.p[place])) AS chars FROM cov JOIN t USING (sft_id) GROUP BY sft_id),
b AS (SELECT sft_id, p, g, len({s_words('o')}) AS n, coalesce(common, 0) AS common, coalesce(chars, 0) AS chars, {_LEN('p')} AS whole, {", ".join(f"{s_count(x, _CL[k])} AS {k}_{x}" for x in 'ou' for k in ('tamil', 'latin', 'other'))} FROM t LEFT JOIN k USING (sft_id) LEFT JOIN rep USING (sft_id))"""


@query(f"""WITH {_REWARDED} SELECT sft_id, round(CASE WHEN common = 0 THEN 0.0::DOUBLE ELSE 2 * (common / len(p)) * (common / len(g)) / (common / len(p) + common / len(g)) END
 + CASE WHEN tamil_u + latin_u + other_u > 0 AND tamil_u / (tamil_u + latin_u + other_u) >= 0.5::DOUBLE THEN 0.5::DOUBLE * {s_ratio('tamil_o', '(tamil_o + latin_o + other_o)')} ELSE 0 END
 + 0.5::DOUBLE * CASE WHEN len(p) < 4 THEN 1.0::DOUBLE ELSE 1 - {s_ratio('chars', 'whole')} END
 + 0.25::DOUBLE * CASE WHEN n < 2 THEN n / 2.0::DOUBLE WHEN n > 120 THEN greatest(0.0::DOUBLE, 1 - (n - 120) / 120.0::DOUBLE) ELSE 1.0::DOUBLE END, 6) AS reward FROM b""")
def combined_rewards(spark, d):
    m = _messages(spark, d).select("sft_id", F.col("messages")[0].content.alias("u"), F.col("messages")[1].content.alias("o"))
    weights = {"reference_f1": 1.0, "tamil_script": 0.5, "no_repetition": 0.5, "length": 0.25, "contains_answer": 0.0}
    return rewards.combined(m, weights, "o", "u", "u").select("sft_id", F.round("reward", 6).alias("reward"))


# --- formats, sources of conversations and pairs ----------------------------------------------------------------------
@query(f"WITH {_S} SELECT sft_id, i AS prompt, o AS response FROM c WHERE i <> '' AND o <> ''")
def prompt_response(spark, d):
    rows = chat.remap(_sft(spark, d), {"prompt": "instruction", "response": "output"}, ("prompt", "response"))
    m = rows.select("sft_id", chat.prompt_response("prompt", "response").alias("m")).where("m is not null")
    return m.select("sft_id", F.col("m")[0].content.alias("prompt"), F.col("m")[1].content.alias("response"))


def _turns(role: str, content: str) -> F.Column:
    said = lambda who, c: F.struct(F.lit(who).alias(role), F.col(c).alias(content))
    return F.array(said("Human", "instruction"), said("tool", "source"), said("GPT", "output"), said("user", "input"))


@query(f"WITH {_S} SELECT sft_id, array_to_string(list_filter([CASE WHEN i <> '' THEN 'user:' || i END, 'assistant:' || o, CASE WHEN x <> '' THEN 'user:' || x END], lambda v: v IS NOT NULL), chr(10)) AS turns FROM c WHERE o <> ''")
def sharegpt_messages(spark, d):
    """Roles under their other names, unknown ones and blank turns dropped; null without an answer."""
    x = _sft(spark, d).select("sft_id", chat.conversation(_turns("from", "value"), "from", "value").alias("m")).where("m is not null")
    return x.select("sft_id", F.array_join(F.transform("m", lambda t: F.concat(t.role, F.lit(":"), t.content)), "\n").alias("turns"))


@query("WITH f AS (SELECT * FROM sft_sample QUALIFY row_number() OVER (PARTITION BY sft_id ORDER BY received_at, coalesce(instruction, ''), coalesce(input, ''), coalesce(output, ''), coalesce(source, '')) = 1) SELECT sft_id, 2::INT AS turns FROM f WHERE source IS NOT NULL")
def valid_chats(spark, d):
    """Known roles only, and only chats that end with the user: here those with a source, whose turn is the user's."""
    said = lambda who, c: F.struct(F.lit(who).alias("role"), F.col(c).alias("content"))
    last = F.struct(F.when(F.col("source").isNull(), "assistant").otherwise("user").alias("role"), F.col("instruction").alias("content"))
    x = _sft(spark, d).select("sft_id", chat.valid_chat(F.array(said("system", "input"), said("tool", "output"), last)).alias("m")).where("m is not null")
    return x.select("sft_id", F.size("m").alias("turns"))


@query(f"WITH {_S}, n AS (SELECT sft_id, (strlen(u) + strlen(o) + 70)::BIGINT AS n FROM m) SELECT sft_id, (ceil(n / 8.0) * 8)::INT AS padded, (ceil(n / 8.0) * 8 - n)::INT AS zeros FROM n WHERE n <= 1024")
def padded_chats(spark, d):
    """Each conversation as a batch of one: ids filled up to a multiple of 8."""
    x = _messages(spark, d).select("sft_id", chat.encode("messages", 1024).alias("e")).where("e.input_ids is not null")
    ids = chat.pad_to("e.input_ids", chat.batch_length(F.size("e.input_ids")), -1)
    return x.select("sft_id", ids.alias("ids")).select("sft_id", F.size("ids").alias("padded"), F.size(F.filter("ids", lambda v: v == -1)).alias("zeros"))


@query(f"WITH {_S}, e AS (SELECT sft_id, '<start_of_turn>user' || chr(10) || u || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS a, o || '<end_of_turn>' AS b FROM m) SELECT sft_id, md5('256,' || array_to_string([ord(x) FOR x IN string_split(a || b || chr(10), '')], ',')) AS ids, (strlen(a) + 1)::BIGINT AS first_label FROM e WHERE regexp_full_match(a || b, '[\\x00-\\x7f]*') AND strlen(a) + strlen(b) + 2 <= 1024")
def encoded_ids(spark, d):
    """Ids and the place of the first label, of conversations in ASCII, whose bytes SQL can list."""
    ascii_only = F.forall("messages", lambda t: t.content.rlike(r"^[\x00-\x7f]*$"))
    x = _messages(spark, d).where(ascii_only).select("sft_id", chat.encode("messages", 1024).alias("e")).where("e.input_ids is not null").select("sft_id", "e.*")
    first = F.array_min(F.transform("labels", lambda v, i: F.when(v != -100, i))).cast("long")
    return x.select("sft_id", F.md5(F.array_join(F.transform("input_ids", lambda v: v.cast("string")), ",")).alias("ids"), first.alias("first_label"))


_GENERATED = f"{_S}, n AS (SELECT DISTINCT u, 'I say: ' || substr(u, 1, 40) AS text FROM m WHERE length(u) % 2 = 0)"


def _cache(spark, d) -> DataFrame:
    """Stand-in for a model's answers, to half of the prompts."""
    x = _messages(spark, d).select(F.slice("messages", 1, 1).alias("messages")).where(F.length(F.col("messages")[0].content) % 2 == 0)
    return x.select(preference.generation_key("messages").alias("key"), F.concat(F.lit("I say: "), F.substring(F.col("messages")[0].content, 1, 40)).alias("text"))


@query(f"WITH {_GENERATED} SELECT u AS prompt, o AS chosen, text AS rejected FROM m JOIN n USING (u) WHERE {s_strip('text')} <> o")
def generated_pairs(spark, d):
    x = preference.generated_pairs(_messages(spark, d), _cache(spark, d))
    return x.select(F.col("messages")[0].content.alias("prompt"), "chosen", "rejected")


@query(f"WITH {_GENERATED} SELECT DISTINCT u AS prompt FROM m WHERE u NOT IN (SELECT u FROM n)")
def missing_generations(spark, d):
    x = _messages(spark, d).select(F.slice("messages", 1, 1).alias("messages"))
    return preference.missing_generations(x, _cache(spark, d)).select(F.col("messages")[0].content.alias("prompt"))


@query(f"""WITH {_GENERATED}, {_R}, x AS (SELECT context AS p, choices[label + 1] AS chosen, unnest(choices) AS rejected FROM tamil_cloze),
j AS (SELECT prompt, {s_strip('model_a')} AS a, {s_strip('model_b')} AS b, winner FROM r JOIN chat_eval_prompts ON prompt_id = id WHERE mode = 'compare' AND winner IN ('a', 'b') AND model_a <> '' AND model_b <> '' AND prompt <> '')
SELECT 'cloze' AS source, p AS prompt, chosen, rejected FROM x WHERE p <> '' AND chosen <> '' AND rejected <> '' AND chosen <> rejected
UNION ALL SELECT 'votes', prompt, CASE winner WHEN 'a' THEN a ELSE b END, CASE winner WHEN 'a' THEN b ELSE a END FROM j WHERE a <> b
UNION ALL SELECT 'own', u, o, text FROM m JOIN n USING (u) WHERE {s_strip('text')} <> o""")
def pairs_of_sources(spark, d):
    """Three formats in one table; a source of an unknown format and a missing one are left out, a switched-off one is not read."""
    cloze = lambda: load(spark, d, "tamil_cloze").select(F.col("context").alias("ask"), F.get("choices", F.col("label")).alias("chosen"), F.explode("choices").alias("rejected"))
    votes = lambda: _ratings(spark, d).join(load(spark, d, "chat_eval_prompts").select(F.col("id").alias("prompt_id"), "prompt"), "prompt_id").select("mode", "winner", "prompt", F.col("model_a").alias("response_a"), F.col("model_b").alias("response_b"))
    tables = {"cloze": cloze, "votes": votes, "own": lambda: _sft(spark, d), "odd": cloze}
    sources = [
        {"name": "cloze", "fields": {"prompt": "ask"}}, {"name": "votes", "format": "ratings"}, {"name": "own", "format": "self_generated"},
        {"name": "odd", "format": "riddles"}, {"name": "gone"}, {"name": "off", "enabled": False},
    ]
    x = preference.pairs_of_sources(sources, lambda s: tables[s["name"]](), _cache(spark, d), log=lambda m: None)
    return x.select("source", F.col("messages")[0].content.alias("prompt"), "chosen", "rejected")


@query(f"WITH {_S} SELECT 'a' AS source, u AS first_text, 3::INT AS turns FROM m UNION ALL SELECT 'b', i, 2::INT FROM c WHERE i <> '' AND o <> '' UNION ALL SELECT 'c', 'Text: ' || x || ' Ask: ' || i, 2::INT FROM c WHERE x <> '' AND i <> ''")
def conversations_of_sources(spark, d):
    sources = [
        {"name": "a", "system_prompt": "Be brief."}, {"name": "b", "format": "prompt_response", "fields": {"prompt": "instruction", "response": "output"}},
        {"name": "c", "format": "qa", "fields": {"context": "input", "question": "instruction", "answer": "output"}, "qa_template": "Text: {context} Ask: {question}"}, {"name": "d", "format": "none"},
    ]
    x = chat.conversations_of(sources, lambda s: _sft(spark, d), log=lambda m: None)
    said = F.filter("messages", lambda t: t.role == "user")
    return x.select("source", said[0].content.alias("first_text"), F.size("messages").alias("turns"))


_PAIRED = f"{_RP}, y AS (SELECT rating_id, p, CASE winner WHEN 'a' THEN a ELSE b END AS chosen, CASE winner WHEN 'a' THEN b ELSE a END AS rejected FROM j WHERE p <> '' AND a <> b), one AS (SELECT min(rating_id) AS rating_id, p, chosen, rejected FROM y GROUP BY p, chosen, rejected)"


def _paired(spark, d) -> DataFrame:
    r = _valid_ratings(spark, d).where("mode = 'compare'").join(load(spark, d, "chat_eval_prompts").select(F.col("id").alias("prompt_id"), "prompt"), "prompt_id")
    return r.withColumn("pair", preference.pair_of_rating("winner", "prompt", "model_a", "model_b")).where("pair is not null").select("rating_id", "pair")


@query(f"WITH {_PAIRED} SELECT rating_id FROM one")
def deduplicated_pairs(spark, d):
    return preference.deduplicated(_paired(spark, d), "rating_id").select("rating_id")


@query(f"WITH {_PAIRED} SELECT rating_id, (strlen(p) + strlen(chosen) + 70)::BIGINT AS chosen_n, (strlen(p) + strlen(rejected) + 70)::BIGINT AS rejected_n, (strlen(chosen) + 13)::BIGINT AS chosen_labels FROM y WHERE strlen(p) + greatest(strlen(chosen), strlen(rejected)) + 70 <= 200 AND p = {s_strip('p')}")
def encoded_pairs(spark, d):
    """Pairs of prompts without outer space, which rendering would strip."""
    x = preference.encoded(_paired(spark, d), 200)
    x = x.where(F.col("pair.messages")[0].content == chat.strip(F.col("pair.messages")[0].content))
    return x.select("rating_id", F.size("chosen_input_ids").cast("long").alias("chosen_n"), F.size("rejected_input_ids").cast("long").alias("rejected_n"), F.size(F.filter("chosen_labels", lambda v: v != -100)).cast("long").alias("chosen_labels"))


# --- vocabulary ---------------------------------------------------------------------------------------------------------
_TP = f"""t AS (SELECT id, piece, score FROM tokenizer_pieces WHERE piece_type = 1 AND regexp_matches(replace(piece, '▁', ''), '^[{TAMIL}]+$') AND length(replace(piece, '▁', '')) >= 2),
base AS (SELECT * FROM tokenizer_pieces WHERE id % 3 <> 0), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS overall FROM t),
n AS (SELECT piece, overall, row_number() OVER (ORDER BY overall) AS rank FROM k WHERE piece NOT IN (SELECT piece FROM base)),
f AS (SELECT piece, overall, true AS is_new FROM n WHERE rank <= 300), c AS (SELECT * FROM f UNION ALL SELECT piece, overall, false FROM k WHERE piece IN (SELECT piece FROM base) AND overall <= (SELECT max(overall) FROM f))"""


def _vocab(spark, d) -> tuple[DataFrame, DataFrame]:
    """A base vocabulary made of two thirds of the pieces, and Tamil candidates from all of them."""
    p = load(spark, d, "tokenizer_pieces")
    return p.where("id % 3 <> 0"), vocab.tamil_pieces(p, 2).select("id", "piece", "score")


@query(f"WITH {_TP} SELECT piece, overall::INT AS overall, is_new FROM c")
def vocab_extension(spark, d):
    base, candidates = _vocab(spark, d)
    return vocab.extension(candidates, base, 300)


@query(f"""WITH {_TP}, e AS (SELECT max(score) AS hi FROM base WHERE piece_type = 1), z AS (SELECT piece, is_new, hi + (SELECT count(*) FROM c) - row_number() OVER (ORDER BY overall) + 1 AS s FROM c, e)
SELECT base.piece, round(coalesce(s, score), 6) AS score FROM base LEFT JOIN z USING (piece) UNION ALL SELECT piece, round(s, 6) FROM z WHERE is_new""")
def vocab_rescored(spark, d):
    base, candidates = _vocab(spark, d)
    return vocab.rescored(base, vocab.extension(candidates, base, 300)).select("piece", F.round("score", 6).alias("score"))


@query(f"""WITH {_TP}, u AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM base WHERE piece_type = 6) SELECT n.piece, coalesce(u.id, (SELECT max(id) FROM base) + n.rank - (SELECT count(*) FROM u))::INT AS id FROM n LEFT JOIN u USING (rank) WHERE n.rank <= 300""")
def vocab_slots(spark, d):
    base, candidates = _vocab(spark, d)
    fresh = vocab.new_pieces(candidates, base).where("rank <= 300")
    return vocab.slots(base, fresh, F.col("piece_type") == 6)


@query("SELECT count(*) AS n, md5(list_aggregate(list_sort(list(piece)), 'string_agg', chr(10))) AS fingerprint FROM tokenizer_pieces")
def vocab_fingerprint(spark, d):
    return vocab.fingerprint(load(spark, d, "tokenizer_pieces"))


# --- sources ------------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, category FROM documents WHERE category IN ('ta_web', 'en') OR category IS NULL")
def row_filter(spark, d):
    x = load(spark, d, "documents")
    return x.where(readers.row_filter({"field": "category", "in": ["ta_web", "en", None]}, x.columns)).select("doc_id", "category")


@query("SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 40 OFFSET 10")
def offset_limit(spark, d):
    """Filter, then skip, then limit in order; the limit is the operator."""
    src = {"type": "parquet", "path": f"{d}/documents.parquet", "filter": {"field": "lang", "equals": "en"}, "skip_docs": 10, "max_docs": 40}
    return readers.iter_rows(spark, src, "doc_id").select("doc_id")


@query(f"""WITH x AS (SELECT sft_id, received_at, list_filter([instruction, input, output], lambda v: v IS NOT NULL AND {s_strip('v')} <> '') AS p FROM sft_sample) SELECT DISTINCT sft_id, array_to_string(p, chr(10) || chr(10)) AS text FROM x""")
def joined_fields(spark, d):
    x = load(spark, d, "sft_sample")
    return x.select("sft_id", readers.text_field(x, ["instruction", "input", "output"]).alias("text")).distinct()


@query(r"SELECT id, regexp_replace(regexp_replace(prompt, '^\s+', ''), '^(?:Explain this in brief\x{3A}|சுருக்கமாக எழுதுக\x{3A})\s*', '') AS text FROM chat_eval_prompts")
def prefixes_stripped(spark, d):
    return load(spark, d, "chat_eval_prompts").select("id", chat.strip_prefix("prompt", ["Explain this in brief:", "சுருக்கமாக எழுதுக:"]).alias("text"))


_LSTRIP = s_sub("coalesce(text, '')", f"^[{WS}]+")


@query(f"SELECT {_LSTRIP} AS text, 'documents' AS source, (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR AS source_id, doc_id AS seq FROM documents QUALIFY {_LSTRIP} <> ''")
def source_documents(spark, d):
    x = load(spark, d, "documents").drop("source_id")
    return readers.source_documents(x, {"name": "documents"}, "doc_id")


@query(f"SELECT {_LSTRIP} AS text, 0 AS source_ordinal FROM documents WHERE {_LSTRIP} <> '' UNION ALL SELECT {_LSTRIP}, 1 FROM lang_samples WHERE {_LSTRIP} <> ''")
def union_of_sources(spark, d):
    sources = [{"name": "documents", "order": "doc_id"}, {"name": "missing", "order": "x"}, {"name": "off", "enabled": False, "order": "x"}, {"name": "lang_samples", "order": "sample_id"}]

    def one(src):
        return readers.source_documents(load(spark, d, src["name"]), {"name": src["name"]}, src["order"])

    out = readers.union_sources(spark, sources, one, log=lambda m: None)
    return out.select("text", F.when(F.col("source_ordinal") == 0, 0).otherwise(1).alias("source_ordinal"))


def _text_folder(spark, d, sep: str) -> str:
    """The documents as text files, each followed by a separator; line feeds at their ends would merge with it."""
    path = f"{tables.shared_folder(spark)}/lexiloom-text-{uuid.uuid4().hex}"
    load(spark, d, "documents").select(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+$", "").alias("value")).write.option("lineSep", sep).text(path)
    return path


_WRITTEN = r"w AS (SELECT regexp_replace(coalesce(text, ''), '[\r\n]+$', '') AS t FROM documents)"


@query(rf"WITH {_WRITTEN}, x AS (SELECT unnest(string_split_regex(t, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')) AS text FROM w) SELECT text, count(*) AS n FROM x WHERE {s_strip('text')} <> '' GROUP BY text")
def text_lines(spark, d):
    """Text files read back by lines."""
    rows = readers.read_text(spark, [_text_folder(spark, d, "\n")], "line")
    return rows.groupBy("text").agg(F.count("*").alias("n"))


@query(rf"WITH {_WRITTEN}, x AS (SELECT unnest(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10) || chr(10))) AS text FROM w) SELECT text, count(*) AS n FROM x WHERE {s_strip('text')} <> '' GROUP BY text")
def text_paragraphs(spark, d):
    """Text files read back by paragraphs."""
    rows = readers.read_text(spark, [_text_folder(spark, d, "\n\n")], "blank_line")
    return rows.groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT source, doc_id, row_number() OVER (ORDER BY md5('3:' || source), source, doc_id) AS place FROM documents WHERE source IS NOT NULL")
def shuffled_files(spark, d):
    """Sources stand for files: documents file by file, files in seeded order."""
    x = readers.shuffled_files(load(spark, d, "documents").where("source is not null").select("source", "doc_id"), "source", "doc_id", 3)
    return x.select("source", "doc_id", (F.row_number().over(Window.orderBy(*readers.file_order("source", "doc_id", 3)))).cast("long").alias("place"))


@query("SELECT doc_id FROM documents ORDER BY md5('5:' || doc_id::VARCHAR), doc_id LIMIT 25")
def seeded_sample(spark, d):
    """A seeded sample; the limit is the operator."""
    return split.seeded_sample(load(spark, d, "documents").select("doc_id"), "doc_id", 5, 25)



def flagship(spark: SparkSession, d: str) -> DataFrame:
    return stats_by_source(spark, d)
