"""The training-data queries in SQL, where SQL can say them on whole tables."""

from __future__ import annotations

from ..functions.chars import WS
from ..plans.queries import q, s_sub


def s_words(x: str) -> str:
    """Words by the rule of ``base.words``."""
    bare = s_sub("t", r"[^\p{L}\p{M}\p{N}]+")
    return f"list_filter(list_transform(string_split_regex(lower(nfc_normalize({x})), {q(f'[{WS}]+')}), lambda t: {bare}), lambda t: t <> '')"


def s_runs(words: str, n: int) -> str:
    return f"list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i:i+{n - 1}], ' '))"


def s_trim(x: str) -> str:
    return s_sub(x, r"^[\s\x{A0}]+|[\s\x{A0}]+$")


# --- p2: votes, then minorisation-maximisation until nothing moves ------------------------------------------------------
_VOTES = f"""last AS (SELECT rating_id, lower({s_trim('mode')}) AS mode, lower({s_trim('model_a')}) AS a, lower({s_trim('model_b')}) AS b, lower({s_trim('winner')}) AS winner FROM ratings WHERE rating_id IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY rating_id ORDER BY received_at DESC NULLS LAST, mode DESC NULLS LAST, a DESC NULLS LAST, b DESC NULLS LAST, winner DESC NULLS LAST) = 1),
names AS (SELECT key, min(model) AS model, row_number() OVER (ORDER BY key) AS k FROM (SELECT lower({s_trim('model')}) AS key, model FROM model_registry WHERE model IS NOT NULL) GROUP BY key),
v AS (SELECT x.k AS i, y.k AS j, CASE winner WHEN 'a' THEN 1.0 WHEN 'b' THEN 0.0 ELSE 0.5 END::DOUBLE AS w FROM last JOIN names x ON a = x.key JOIN names y ON b = y.key WHERE mode = 'compare' AND winner IN ('a', 'b', 'tie', 'both_bad') AND a <> b),
cells AS (SELECT x.k AS i, y.k AS j, coalesce(sum(n), 0)::DOUBLE AS n FROM names x CROSS JOIN names y LEFT JOIN (SELECT i, j, 1 AS n FROM v UNION ALL SELECT j, i, 1 FROM v) g ON g.i = x.k AND g.j = y.k GROUP BY ALL),
grid AS (SELECT list(r ORDER BY i) AS g FROM (SELECT i, list(n ORDER BY j) AS r FROM cells GROUP BY i)),
won AS (SELECT list(w ORDER BY k) AS w, count(*) AS m FROM (SELECT k, coalesce(sum(w), 0) AS w FROM names LEFT JOIN (SELECT i, w FROM v UNION ALL SELECT j, 1 - w FROM v) z ON z.i = k GROUP BY k)),
fit AS (SELECT 0 AS step, [1.0::DOUBLE FOR x IN range(m)] AS p, 1.0::DOUBLE AS moved FROM won
 UNION ALL SELECT step + 1, q, list_sum([abs(q[i] - p[i]) FOR i IN range(1, m + 1)]) FROM (SELECT step, p, m, [x * m / list_sum(u) FOR x IN u] AS q FROM
 (SELECT step, p, m, [w[i] / list_sum([g[i][j] / (p[i] + p[j]) FOR j IN range(1, m + 1)]) FOR i IN range(1, m + 1)] AS u FROM fit, grid, won WHERE moved > 1e-11 AND step < 20000))),
strengths AS (SELECT k, model, key, p[k] AS strength FROM (SELECT p FROM fit ORDER BY step DESC LIMIT 1), names)"""

# --- p5: sets of runs ---------------------------------------------------------------------------------------------------
_LATEST = f"l AS (SELECT id, {s_words('coalesce(text, chr(32))')} AS w FROM processed_shards WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY written_at DESC) = 1)"


def _sets(n: int) -> str:
    return f"""{_LATEST}, s AS (SELECT id, list_sort(list_distinct({s_runs('w', n)})) AS g FROM l WHERE len(w) >= {n})"""


def _similar(source: str, least: str) -> str:
    """Pairs a < b of (id, g) whose shared part is at least ``least`` of the union."""
    return f"""e AS (SELECT id, unnest(g) AS x, len(g) AS n FROM {source}), k AS (SELECT a.id AS a, b.id AS b, count(*) AS met, any_value(a.n + b.n) AS n FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id),
sim AS (SELECT a, b, met::DOUBLE / (n - met) AS similarity FROM k WHERE met >= {least} * (n - met))"""


_CLASSES = f"""{_LATEST}, c AS (SELECT id, w, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct({s_runs('w', 5)})) END AS g FROM l),
m AS (SELECT id, g, min(id) OVER (PARTITION BY CASE WHEN len(w) >= 5 THEN 's' || array_to_string(g, '|') WHEN len(w) > 0 THEN 'w' || array_to_string(w, ' ') ELSE 'i' || id END) AS class_id FROM c),
s AS (SELECT id, g FROM m WHERE id = class_id AND g IS NOT NULL), {_similar('s', '0.8::DOUBLE')}"""

# --- p6: the best segmentation of every distinct part between proven boundaries -------------------------------------------
_PARTS = r"regexp_extract_all(replace(coalesce(text, ''), ' ', '▁'), '\n|▁?[^▁\n]+|▁')"
_COUNTED = rf"""v AS (SELECT piece, max(score) AS score FROM tokenizer_pieces WHERE piece_type = 1 AND piece IS NOT NULL GROUP BY piece), lim AS (SELECT max(length(piece)) AS longest, min(score) - 10 AS unknown FROM v),
r AS (SELECT id, written_at, source, lang, category, text, {_PARTS} AS parts FROM processed_shards WHERE id IS NOT NULL), d AS (SELECT DISTINCT unnest(parts) AS part FROM r),
seg AS (SELECT part, 0 AS i, [0.0::DOUBLE] AS best, [0::BIGINT] AS n FROM d
 UNION ALL SELECT part, i + 1, list_append(any_value(best), max(value)), list_append(any_value(n), arg_max(tokens, (value, size))) FROM
 (SELECT part, i, best, n, size, best[i + 2 - size] + coalesce(v.score, unknown) AS value, n[i + 2 - size] + CASE WHEN v.score IS NULL THEN strlen(substr(part, i + 1, 1)) ELSE 1 END AS tokens
  FROM (SELECT *, unnest(range(1, least(i + 1, longest) + 1)) AS size FROM seg, lim WHERE i < length(part)) LEFT JOIN v ON v.piece = substr(part, i + 2 - size, size) WHERE v.score IS NOT NULL OR size = 1) GROUP BY part, i),
cost AS (SELECT part, n[len(n)] AS n FROM seg WHERE i = length(part)),
each AS (SELECT id, written_at, source, lang, category, text, coalesce((SELECT sum(cost.n) FROM (SELECT unnest(parts) AS part) u JOIN cost USING (part)), 0)::BIGINT AS n_tokens FROM r),
one AS (SELECT id, source, lang, category, n_tokens FROM each QUALIFY row_number() OVER (PARTITION BY id ORDER BY written_at DESC NULLS LAST, source DESC NULLS LAST, lang DESC NULLS LAST, category DESC NULLS LAST, n_tokens DESC) = 1),
clean AS (SELECT id, coalesce(source, 'unknown') AS source, CASE WHEN split_part(lower(trim(lang)), '-', 1) IN ('ta', 'tanglish', 'en', 'code_mixed', 'other') THEN split_part(lower(trim(lang)), '-', 1) ELSE 'unknown' END AS lang,
 coalesce(nullif(regexp_replace(regexp_replace(lower(category), '^[\s\-_]+|[\s\-_]+$', '', 'g'), '[\s\-_]+', '_', 'g'), ''), 'unknown') AS category, n_tokens FROM one)"""

# --- p8: eight words in a row ---------------------------------------------------------------------------------------------
_ITEMS = "SELECT item_id, context || choices[label + 1] AS text FROM tamil_cloze UNION ALL SELECT id, prompt FROM chat_eval_prompts UNION ALL SELECT id, reference FROM chat_eval_prompts"
_LEAKS = f"""i AS (SELECT DISTINCT item_id, unnest({s_runs('w', 8)}) AS x FROM (SELECT item_id, {s_words('text')} AS w FROM ({_ITEMS}) WHERE item_id IS NOT NULL AND text IS NOT NULL)),
t AS (SELECT item_id, count(*) AS item_windows FROM i GROUP BY item_id), dd AS (SELECT DISTINCT doc_id, unnest({s_runs('w', 8)}) AS x FROM (SELECT doc_id, {s_words('text')} AS w FROM documents WHERE text IS NOT NULL)),
h AS (SELECT doc_id, item_id, count(*) AS windows FROM dd JOIN i USING (x) GROUP BY ALL)"""

SQL = {
    "p2_found": f"WITH RECURSIVE {_VOTES} SELECT model, row_number() OVER (ORDER BY strength DESC, key)::INT AS rank_no FROM strengths",
    "p2_strengths": f"WITH RECURSIVE {_VOTES}, n AS (SELECT k, count(*)::DOUBLE AS votes FROM (SELECT i AS k FROM v UNION ALL SELECT j FROM v) GROUP BY k) SELECT model, round(strength, 6) AS strength, coalesce(votes, 0.0) AS votes, row_number() OVER (ORDER BY strength DESC, key)::INT AS rank_no FROM strengths LEFT JOIN n USING (k)",
    "p5_found": f"WITH {_sets(3)}, {_similar('s', '0.5::DOUBLE')} SELECT a AS id_a, b AS id_b FROM sim",
    "p5_links": f"WITH {_CLASSES} SELECT a AS class_a, b AS class_b, round(similarity, 6) AS similarity FROM sim",
    "p5_groups": f"""WITH RECURSIVE {_CLASSES}, edge AS (SELECT a AS x, b AS y FROM sim UNION ALL SELECT b, a FROM sim), far AS (SELECT DISTINCT x AS c, x AS place FROM edge UNION SELECT far.c, edge.y FROM far JOIN edge ON far.place = edge.x),
deg AS (SELECT x AS class_id, count(*) AS links FROM edge GROUP BY x), root AS (SELECT c AS class_id, min(place) AS group_id FROM far GROUP BY c)
SELECT id, class_id, coalesce(links, 0) AS links, coalesce(group_id, class_id) AS group_id FROM m LEFT JOIN deg USING (class_id) LEFT JOIN root USING (class_id)""",
    "p6_record_tokens": f"WITH RECURSIVE {_COUNTED} SELECT * FROM clean",
    "p6_slice_totals": f"WITH RECURSIVE {_COUNTED} SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS lang, coalesce(category, '*') AS category, count(*) AS docs, sum(n_tokens)::BIGINT AS n_tokens, grouping(source, lang, category)::BIGINT AS level FROM clean GROUP BY CUBE (source, lang, category)",
    "p8_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM h",
    "p8_containment": f"WITH {_LEAKS} SELECT doc_id, item_id, windows, item_windows, round(windows / item_windows, 6) AS containment FROM h JOIN t USING (item_id)",
}
