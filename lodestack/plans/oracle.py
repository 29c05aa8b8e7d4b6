"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from ..functions.models import EMBEDS, SEES
from ..functions.paths import FORMATS, MACHINE_DIRS, glob_to_regex
from ..functions.text import py_terms, py_words

SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
JUNK = r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}\p{Co}\x{FFFD}]"


def trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


DOCS = "SELECT doc_id, '/' || source || '/' || doc_id || '.txt' AS path, '/' || source AS root, lang AS tag, text FROM documents"
TOK = r"""d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}\p{Co}]+') AS ts FROM documents),
l AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS dl FROM d),
p AS (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM d),
st AS (SELECT count(*) AS n, coalesce(sum(dl), 0) AS total, coalesce(sum(dl), 0) / greatest(count(*), 1) AS avgdl FROM l)"""


def scores(query: str, any_word: bool = False) -> str:
    """Common table expressions that end in b(doc_id, score)."""
    wanted: dict[tuple[str, ...], int] = {}
    for w in py_words(query):
        if t := tuple(py_terms(w)):
            wanted[t] = wanted.get(t, 0) + 1
    hits = []
    for n, (terms, weight) in enumerate(wanted.items()):
        joins = "".join(f" JOIN p p{i} ON p{i}.doc_id = p0.doc_id AND p{i}.pos = p0.pos + {i} AND p{i}.term = '{t}'" for i, t in enumerate(terms) if i)
        hits.append(f"SELECT {n} AS phrase, {weight} AS w, p0.doc_id, count(*) AS tf FROM p p0{joins} WHERE p0.term = '{terms[0]}' GROUP BY p0.doc_id")
    having = "" if any_word else f" HAVING count(*) = {len(wanted)}"
    return f"""{TOK},
h AS ({' UNION ALL '.join(hits)}),
idf AS (SELECT phrase, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) AS idf FROM (SELECT phrase, count(*) AS df FROM h GROUP BY phrase), st),
b AS (SELECT h.doc_id, sum(w * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM h JOIN idf USING (phrase) JOIN l ON l.doc_id = h.doc_id, st GROUP BY h.doc_id{having})"""


def top_hits(query: str, any_word: bool = False, tag: str = "", k: int = 10) -> str:
    where = f" WHERE f.tag = '{tag}'" if tag else ""
    return f"""WITH {scores(query, any_word)}, f AS ({DOCS}),
t AS (SELECT b.doc_id, f.path || ' (chunk 1)' AS cite, b.score FROM b JOIN f USING (doc_id){where} ORDER BY b.score DESC, b.doc_id LIMIT {k})
SELECT doc_id, cite, round(score, 6) AS score FROM t"""


NEAR = "q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), v AS (SELECT vec_id, label, CAST(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) AS DOUBLE) AS score FROM embeddings, q)"


def legs(query: str, k: int = 10, scale: str = "1.0") -> str:
    return f"""{scores(query)}, f AS ({DOCS}), {NEAR},
kw AS (SELECT f.path, b.doc_id, b.score FROM b JOIN f USING (doc_id) ORDER BY b.score DESC, f.path LIMIT {k}),
nv AS (SELECT f.path, f.doc_id, x.score * {scale} AS score FROM (SELECT * FROM v ORDER BY score DESC, vec_id LIMIT {k}) x JOIN f ON f.doc_id = x.vec_id)"""


def fused(vector: str, k: int = 10) -> str:
    return f"""fu AS (SELECT path, doc_id, sum(1.0 / (60 + r)) AS score FROM (
  SELECT path, doc_id, row_number() OVER (ORDER BY score DESC, path) AS r FROM kw
  UNION ALL SELECT path, doc_id, row_number() OVER (ORDER BY score DESC, path) FROM {vector}) GROUP BY path, doc_id ORDER BY score DESC, path LIMIT {k})
SELECT path, doc_id, round(score, 6) AS score FROM fu"""


REL = "rv AS (SELECT * FROM nv WHERE score >= 0.25 AND score >= 0.5 * (SELECT max(score) FROM nv))"
STORE = f"""f AS ({DOCS}),
lines AS (SELECT doc_id, path, root, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM f)"""
TURNS = "t AS (SELECT conv_id, '/mail/' || conv_id || '.mbox' AS path, CAST(turn AS INTEGER) AS seq, CAST(turn + 1 AS INTEGER) AS page, role, text FROM conversations)"
QUANT = """z AS (SELECT vec_id, embedding, CASE WHEN m = 0 THEN 1.0 ELSE m / 127 END AS scale FROM (
  SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS m FROM embeddings)),
u AS (SELECT vec_id, scale, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM z),
w AS (SELECT vec_id, scale, i, CAST(round_even(CAST(e AS DOUBLE) / scale, 0) AS INTEGER) AS q FROM u)"""


def path_exclude(patterns: list[str]) -> str:
    def fits(p: str) -> str:
        r = glob_to_regex(p).replace("'", "''")
        own = f"regexp_matches(rel, '{r}')"
        return own if "/" in p else f"({own} OR regexp_matches(string_split(rel, '/')[-1], '{r}'))"

    dirs = ", ".join(f"'{d}'" for d in MACHINE_DIRS)
    return f"""WITH r AS (SELECT source || '/' || doc_id || '.txt' AS rel FROM documents),
v AS (SELECT rel FROM r UNION ALL SELECT '.git/' || rel FROM r UNION ALL SELECT 'a/node_modules/' || rel FROM r UNION ALL SELECT 'a/' || rel || '/build' FROM r
  UNION ALL SELECT regexp_replace(rel, '\\.txt$', '.bak.txt') FROM r),
x AS (SELECT rel, string_split(rel, '/')[:-2] AS dirs FROM v),
y AS (SELECT rel, len(list_filter(dirs, lambda s: starts_with(s, '.'))) > 0 AS hidden, list_has_any(dirs, [{dirs}]) OR {' OR '.join(map(fits, patterns))} AS excluded FROM x)
SELECT rel, hidden, excluded, lower(regexp_extract(rel, '(\\.[^./]*)$', 1)) IN ({', '.join(f"'{x}'" for x in FORMATS)}) AND NOT hidden AND NOT excluded AS eligible FROM y"""


def build(q: dict[str, object]) -> dict[str, str]:
    """The SQL of every query that has any; q: the constants of the catalogue."""
    and_, or_, phrase, missing = q["AND"], q["OR"], q["PHRASE"], q["MISSING"]
    names = ", ".join(f"'{m}'" for m in q["MODELS"])
    embeds, sees = "|".join(EMBEDS), "|".join(SEES)
    hints = "CASE " + " ".join(f"WHEN contains(lower(id), '{h}') THEN {n}" for n, h in enumerate(SEES)) + " END"
    places = ", ".join(f"strpos(f, '{w}')" for w in py_words(or_))
    return {
        "bm25_and": top_hits(and_),
        "bm25_or": top_hits(or_, True),
        "bm25_phrase": top_hits(phrase),
        "bm25_blocks_and": top_hits(and_),
        "bm25_blocks_or": top_hits(or_, True),
        "batch_search": f"""WITH {TOK},
w AS (SELECT item_id, regexp_extract_all(strip_accents(lower(w)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS ts FROM (SELECT item_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM benchmark)),
a AS (SELECT item_id, ts, count(*) AS weight FROM w WHERE len(ts) > 0 GROUP BY item_id, ts),
g AS (SELECT doc_id, pos, p.term, k.ts FROM p JOIN (SELECT DISTINCT ts, ts[1] AS head FROM a) k ON p.term = k.head),
o AS (SELECT g.ts, g.doc_id, count(*) AS tf FROM g JOIN d USING (doc_id) WHERE d.ts[pos + 1 : pos + len(g.ts)] = g.ts GROUP BY g.ts, g.doc_id),
i AS (SELECT ts, greatest(ln((any_value(st.n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM o, st GROUP BY ts),
s AS (SELECT a.item_id, o.doc_id, sum(weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM a JOIN o ON o.ts = a.ts JOIN i ON i.ts = a.ts JOIN l ON l.doc_id = o.doc_id, st GROUP BY a.item_id, o.doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3""",
        "bm25_tag": top_hits(or_, True, "fr"),
        "clean_text": f"WITH c AS (SELECT doc_id, regexp_replace({trim('text')}, '{JUNK}', '', 'g') AS text FROM documents) SELECT doc_id, text FROM c WHERE text <> ''",
        "format_dispatch": f"""WITH e AS (SELECT doc_id AS id, source || '/' || doc_id || '.' || lang AS path FROM documents
  UNION ALL SELECT page_id, url FROM pages UNION ALL SELECT DISTINCT conv_id, '/MAIL/' || conv_id || '.MBOX' FROM conversations)
SELECT id, path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ({', '.join(f"'{x}'" for x in FORMATS)}) AS supported FROM e""",
        "path_exclude": path_exclude(q["EXCLUDE"]),
        "html_sections": r"""WITH plain AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->|<!doctype[^>]*>', '', 'gis'),
    '<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>', '', 'gis') AS h FROM pages),
marked AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '<h[1-6]\b[^>]*>', chr(2), 'gi'),
    '</h[1-6]\s*>|</?(p|div|br|hr|li|ul|ol|dl|dt|dd|blockquote|pre|section|article|header|footer|main|aside|nav|figure|figcaption|address|table|tr|td|th|caption)\b[^>]*>', chr(1), 'gi'), '</?[a-z][^>]*>', '', 'gi') AS h FROM plain),
decoded AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS h FROM marked),
parts AS (SELECT page_id, list_filter(list_transform(string_split(h, chr(2)), lambda s: array_to_string(
    list_filter(list_transform(string_split(s, chr(1)), lambda p: trim(regexp_replace(p, '[\s\x1C-\x1F\x0B]+', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10))), lambda s: s <> '') AS parts FROM decoded)
SELECT page_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS section, unnest(parts) AS text, 0 AS page FROM parts""",
        "excerpt": rf"""WITH f AS (SELECT doc_id, text AS t, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN strlen(lower(c)) = strlen(c) THEN lower(c) ELSE c END), '') AS f FROM documents),
p AS (SELECT doc_id, t, coalesce(list_min(list_filter([{places}], lambda x: x > 0)), 1) - 1 AS p FROM f),
m AS (SELECT doc_id, t, list_max(list_filter(range(greatest(0, p - 53), p + 1), lambda m: m = 0 OR strlen(left(t, m)) <= greatest(0, strlen(left(t, p)) - 53))) AS m FROM p),
r AS (SELECT doc_id, m, substr(t, m + 1) AS r, left(substr(t, m + 1), list_max(list_filter(range(0, 41), lambda n: strlen(left(substr(t, m + 1), n)) <= 40))) AS opening FROM m),
g AS (SELECT doc_id, m, CASE WHEN m > 0 AND regexp_matches(opening, '[ \n\t]') THEN substr(r, length(regexp_extract(opening, '^[^ \n\t]*')) + 2) ELSE r END AS r FROM r)
SELECT doc_id, CASE WHEN m > 0 THEN '…' ELSE '' END || CASE WHEN strlen(r) <= 160 THEN r ELSE left(r, list_max(list_filter(range(0, 161), lambda n: strlen(left(r, n)) <= 160))) || '…' END AS excerpt FROM g""",
        "markdown_sections": f"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^(\\S+(?: \\S+){{0,3}})$', '## \\1', 'g'), '(?m)^(\\S+\\*\\*\\* )', '```\\1', 'g') AS text FROM documents),
s AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM m),
n AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM s),
a AS (SELECT *, ltrim(line, ' ') AS bare, CASE WHEN starts_with(ltrim(line, ' '), '```') OR starts_with(ltrim(line, ' '), '~~~') THEN 1 ELSE 0 END AS fence FROM n),
b AS (SELECT *, sum(fence) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM a),
c AS (SELECT *, sum(CASE WHEN fence = 0 AND fences % 2 = 0 AND regexp_matches(bare, '^#{{1,6}} ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM b),
g AS (SELECT doc_id, part, string_agg(line, chr(10) ORDER BY n) AS t FROM c GROUP BY doc_id, part),
h AS (SELECT doc_id, part, {trim('t')} AS text FROM g)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS section, text FROM h WHERE text <> ''""",
        "corpus_stats": f"WITH {TOK} SELECT n, CAST(total AS BIGINT) AS total, round(avgdl, 6) AS avgdl FROM st",
        "term_df": f"WITH {TOK} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term",
        "vector_topk": f"WITH {NEAR}, t AS (SELECT vec_id, score FROM v ORDER BY score DESC, vec_id LIMIT 10) SELECT vec_id, round(score, 5) AS score FROM t",
        "vector_topk_codes": f"WITH {NEAR}, t AS (SELECT vec_id, score FROM v ORDER BY score DESC, vec_id LIMIT 10) SELECT vec_id, round(score, 5) AS score FROM t",
        "vector_topk_tag": f"WITH {NEAR}, t AS (SELECT vec_id, score FROM v WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10) SELECT vec_id, round(score, 5) AS score FROM t",
        "relevance_floor": f"WITH {NEAR}, t AS (SELECT vec_id, score FROM v ORDER BY score DESC, vec_id LIMIT 50) SELECT vec_id, round(score, 5) AS score FROM t WHERE score >= 0.25 AND score >= 0.5 * (SELECT max(score) FROM t)",
        "rrf_fuse": f"WITH {legs(and_)}, {fused('nv')}",
        "hybrid_strict": f"WITH {legs(and_)}, {REL}, {fused('rv')}",
        "hybrid_keyword_only": f"WITH {scores(missing, True)}, f AS ({DOCS}), t AS (SELECT f.path, b.doc_id, b.score FROM b JOIN f USING (doc_id) ORDER BY b.score DESC, f.path LIMIT 10) SELECT path, doc_id, round(score, 6) AS score FROM t",
        "hybrid_answer_fallback": f"WITH {legs('zzqqx', scale='0.1')} SELECT path, doc_id, round(score, 6) AS score FROM nv",
        "sources_rollup": f"WITH {STORE} SELECT root AS path, min(tag) AS tag, count(*) AS files, (SELECT count(*) FROM lines x WHERE x.root = f.root) AS chunks FROM f GROUP BY root",
        "status_totals": f"WITH {STORE} SELECT count(DISTINCT root) AS sources, count(*) AS files, (SELECT count(*) FROM lines) AS chunks FROM f",
        "changed_files": f"""WITH f AS ({DOCS}), c AS (SELECT path, text, regexp_replace(text, '[#*&%$!]+', '', 'g') AS t FROM f)
SELECT path, sha256(t) || ':2' AS sha256, CAST(strlen(t) AS BIGINT) AS size FROM c WHERE sha256(t) <> sha256(text)""",
        "prune_files": f"WITH f AS ({DOCS}) SELECT path, CAST(strlen(text) AS INTEGER) AS size FROM f WHERE root <> '/src0' OR doc_id IN (SELECT doc_id FROM labels)",
        "missing_embeddings": f"WITH {STORE} SELECT doc_id || ':' || seq AS chunk_id FROM lines WHERE NOT (seq = 0 AND doc_id IN (SELECT vec_id FROM embeddings))",
        "embed_cache_dedupe": "SELECT sha256(text) AS sha, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1",
        "remove_source_cascade": f"""WITH {STORE} SELECT 'sources' AS tab, count(DISTINCT root) AS n FROM f WHERE root <> '/src0' UNION ALL SELECT 'files', count(*) FROM f WHERE root <> '/src0'
UNION ALL SELECT 'chunks', count(*) FROM lines WHERE root <> '/src0'
UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM lines WHERE root = '/src0' AND seq = 0) UNION ALL SELECT 'meta', 1""",
        "chunk_context": f"WITH {TURNS} SELECT c.path, c.seq AS cited_seq, t.seq, t.page, t.seq = c.seq AS current, t.text FROM t c JOIN t ON t.path = c.path AND t.seq BETWEEN c.seq - 1 AND c.seq + 1 WHERE c.role = 'assistant'",
        "l2_normalize": """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings), m AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS d FROM n)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(CAST(CAST(v[i] / d AS FLOAT) AS DOUBLE), 5) AS x FROM (SELECT vec_id, v, d, unnest(generate_series(1, len(v))) AS i FROM m)""",
        "quantize_int8": f"WITH {QUANT} SELECT vec_id, round(scale, 9) AS scale, CAST(i AS INTEGER) AS i, q FROM w",
        "dequantize": f"WITH {QUANT} SELECT vec_id, CAST(i AS INTEGER) AS i, round(q * scale, 5) AS x FROM w",
        "softmax_rows": """WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS e FROM embeddings)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(e[i] / list_sum(e), 5) AS p FROM (SELECT vec_id, e, unnest(generate_series(1, len(e))) AS i FROM m)""",
        "mean_pool_label": "SELECT label, CAST(i - 1 AS INTEGER) AS i, round(avg(CAST(x AS DOUBLE)), 5) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i",
        "citations": f"""WITH {TURNS} SELECT path, seq, path || ' (page ' || page || ')' AS cite, path || ' (chunk ' || (seq + 1) || ')' AS cite_chunk,
  conv_id || '.mbox, page ' || page AS label, conv_id || '.mbox, section ' || (seq + 1) AS label_chunk, trim(regexp_replace(text, '[{SPACE}]+', ' ', 'g')) AS line FROM t""",
        "prompt_assembly": f"WITH {TURNS} SELECT path, string_agg('[' || (seq + 1) || '] ' || conv_id || '.mbox, page ' || page || chr(10) || text || chr(10) || chr(10), '' ORDER BY seq) || 'Question: why?' AS prompt FROM t GROUP BY path",
        "mcp_render": f"WITH {TURNS}, r AS (SELECT path, string_agg('[' || (seq + 1) || '] ' || path || ' (page ' || page || ')' || chr(10) || text || chr(10) || chr(10), '' ORDER BY seq) AS b FROM t GROUP BY path) SELECT path, {trim('b')} AS rendered FROM r",
        "owner_longest_prefix": f"""WITH f AS ({DOCS}), roots AS (SELECT DISTINCT root FROM f UNION SELECT root || '/' || (doc_id % 10) FROM f),
paths AS (SELECT root || '/' || (doc_id % 20) || '/' || doc_id || '.txt' AS path FROM f UNION ALL SELECT '/other' || path FROM f)
SELECT path, (SELECT max_by(r.root, length(r.root)) FROM roots r WHERE p.path = r.root OR starts_with(p.path, r.root || '/')) AS root FROM paths p""",
        "route_events": f"""WITH o AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'write' WHEN 'click' THEN 'write' WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'rename' WHEN 'error' THEN 'remove' END AS op,
  CASE WHEN user_id % 7 = 0 THEN 'dist/' || user_id || '.md' WHEN user_id % 5 = 0 THEN 'notes/' || user_id || '.jpg' ELSE 'notes/' || user_id || '.md' END AS rel FROM events)
SELECT event_id, CASE WHEN op IN ('remove', 'rename') OR ends_with(rel, '11.md') OR (op = 'create' AND ends_with(rel, '0.jpg')) THEN 'reconcile'
  WHEN op IN ('create', 'write') AND NOT ends_with(rel, '0.jpg') AND ends_with(rel, '.md') AND NOT starts_with(rel, 'dist/') AND NOT regexp_matches(rel, '{glob_to_regex("**/*9.md")}') THEN 'file' END AS job FROM o""",
        "debounce_sessions": """WITH a AS (SELECT *, lag(ts) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id, event_type)),
b AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 600 SECONDS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id, event_type ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM b GROUP BY user_id, s""",
        "eta_ema": """WITH RECURSIVE s AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, ts AS t, CAST(i AS DOUBLE) AS d, CAST(0 AS DOUBLE) AS rate FROM s WHERE i = 1
  UNION ALL SELECT s.user_id, s.i, CASE WHEN s.ts <= r.t THEN r.t ELSE s.ts END, CASE WHEN s.ts <= r.t THEN r.d ELSE CAST(s.i AS DOUBLE) END,
    CASE WHEN s.ts <= r.t THEN r.rate WHEN r.rate = 0 THEN (s.i - r.d) / ((epoch_us(s.ts) - epoch_us(r.t)) / 1000000.0)
      ELSE 0.25 * ((s.i - r.d) / ((epoch_us(s.ts) - epoch_us(r.t)) / 1000000.0)) + 0.75 * r.rate END
  FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
SELECT user_id, max(i) AS samples, round(arg_max(rate, i), 6) AS rate FROM r GROUP BY user_id""",
        "milestones": """WITH e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY user_id) AS total FROM events),
p AS (SELECT *, done * 100 // total AS pct, done * 100 // total // 10 AS tenth FROM e),
m AS (SELECT *, max(tenth) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
SELECT user_id, event_id, pct, tenth FROM m WHERE tenth > coalesce(before, -1)""",
        "recall_at_k": f"""WITH {scores(or_, True)}, t AS (SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 10),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM t),
hit AS (SELECT rank, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS hit FROM r)
SELECT k, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 6) AS recall FROM hit, (VALUES (1), (3), (10)) ks(k) WHERE rank <= k GROUP BY k""",
        "model_pick": f"""WITH g AS (SELECT lang, source, min(doc_id) AS d, count(*) AS n FROM documents GROUP BY lang, source),
m AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS pos, [{names}][d % {len(q["MODELS"])} + 1] || '-' || source AS id FROM g), x AS (SELECT lang, pos, id, regexp_matches(lower(id), '{embeds}') AS e, regexp_matches(lower(id), '{sees}') AS s, {hints} AS h FROM m)
SELECT lang, 'chat' AS use, first(id ORDER BY s, pos) AS id FROM x WHERE NOT e GROUP BY lang UNION ALL SELECT lang, 'vision', first(id ORDER BY h, pos) FROM x WHERE h IS NOT NULL GROUP BY lang""",
    }
