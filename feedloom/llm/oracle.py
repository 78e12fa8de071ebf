"""DuckDB SQL for the corpus queries that SQL can express."""

import math

from .decontaminate import NEAR
from .licenses import NAMES, PHRASES, TEMPLATES, THRESHOLD
from .quality_rules import (BOILERPLATE, MAX_LOST_PERCENT, MAX_REPEAT_PERCENT, MIN_WORDS, NAV_SEPARATORS, PLATE_CHARS,
                            WINDOW)

SQL: dict[str, str] = {}

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v) + "'" for v in values) + "]"

SQL["op9_warc_archive"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
         CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes
  FROM pages
), o AS (SELECT html, min(page_id) AS owner FROM p GROUP BY html)
SELECT p.page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR p.page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR p.page_id = owner THEN NULL ELSE owner END AS refers_to
FROM p JOIN o ON p.html = o.html
"""

_templates = [(label, sorted(set(t.split(" "))), len(t.split(" "))) for label, ts in TEMPLATES.items() for t in ts]
_template_rows = ", ".join(f"('{label}', {_sql_list(t)}, {math.ceil(THRESHOLD * len(t) - 1e-9)}, {_sql_list(x for x in t if x in NAMES)}::VARCHAR[], {n})"
                           for label, t, n in _templates)
_phrase_rows = ", ".join(f"({_sql_list(p.split(' '))}, '{label}')" for p, label in PHRASES.items())

SQL["op3_license_scan"] = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '{BREAK}'), lambda x: x <> '') AS words,
         string_split({LOWER}, chr(10)) AS lines
  FROM documents
), phrases(p, label) AS (VALUES {_phrase_rows}),
templates(label, t, need, named, width) AS (VALUES {_template_rows}),
places AS (
  SELECT doc_id, label, i - 1 AS pos
  FROM d, phrases, unnest(range(1, len(words) + 1)) AS u(i)
  WHERE words[i] = p[1] AND words[i:i + len(p) - 1] = p
),
base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels
  FROM places GROUP BY doc_id
),
runs AS (
  SELECT doc_id, label, t, need, named, list_distinct(words[i:i + width - 1]) AS b
  FROM (SELECT * FROM d, templates WHERE len(list_intersect(words, t)) >= need), unnest(range(1, len(words) + 1)) AS u(i)
  WHERE list_contains(t, words[i])
),
blocks AS (
  SELECT doc_id, label, t, need, named, list_distinct(regexp_split_to_array(line, '{BREAK}')) AS b FROM d, unnest(lines) AS u(line), templates
  UNION ALL SELECT * FROM runs
),
own AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(len(list_intersect(b, t)) / len(t)) AS best
  FROM blocks WHERE len(list_intersect(b, t)) >= need AND list_has_all(b, named) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels,
       greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(best, 0.0))::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""

SPACE = r"[\x20\x09-\x0D]"
WORDS = f"list_filter(regexp_split_to_array({{}}, '{SPACE}+'), lambda x: x <> '')"

# every 50-byte string (by its MD5) with the smallest document that holds it; runs are islands of removed strings
SQL["op2_substring_dedup"] = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 49)) AS i,
        unnest(list_transform(range(0, len(h) // 2 - 49), lambda i: md5_number(h[2 * i + 1:2 * i + 100]))) AS g FROM d),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM s) WHERE least < doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 50 THEN 0 ELSE 1 END AS head FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b
         FROM (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
cut AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans, max(b) AS upto,
          string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
        FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE concat(kept, substring(h, 2 * upto + 1)) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

SQL["op5_near_duplicates"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, words[i:i + 2] AS g FROM w, unnest(range(1, greatest(len(words) - 1, least(len(words), 1) + 1))) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
          JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)
"""

_plates = "[" + ", ".join(f"'{p}'" for p in BOILERPLATE) + "]"

SQL["op7_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {WORDS.format('t')} AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, words[i:i + {WINDOW - 1}] AS g FROM w, unnest(range(1, len(words) - {WINDOW - 2})) AS u(i)),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n
          FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win), unnest(range(0, {WINDOW})) AS r(k)
          WHERE c > 1 GROUP BY doc_id),
line AS (SELECT doc_id, line, {WORDS.format('line')} AS lw, len(regexp_replace(line, '{SPACE}', '', 'g')) AS chars
         FROM w, unnest(lines) AS u(line)),
judged AS (SELECT doc_id, chars,
    2 * len(regexp_extract_all(line, '[!?]{{2,}}')) > len(lw) OR 2 * len(regexp_extract_all(line, '[#*$%&|<>]{{2,}}')) > len(lw)
    OR (2 * len(list_filter(range(1, len(lw)), lambda i: lw[i] = lw[i + 1])) > len(lw)
        AND len(list_filter(range(1, len(lw) - 2), lambda i: lw[i] = lw[i + 1] AND lw[i] = lw[i + 2] AND lw[i] = lw[i + 3])) > 0)
    OR len(list_filter(lw, lambda x: x IN ('|', '>', '»', '·', '•'))) >= {NAV_SEPARATORS}
    OR (len(line) <= {PLATE_CHARS} AND len(list_filter({_plates}, lambda p: contains(lower(line), p))) > 0) AS fails FROM line),
lost AS (SELECT doc_id, sum(chars) FILTER (WHERE fails) AS n FROM judged GROUP BY doc_id),
counts AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(regexp_replace(t, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cover USING (doc_id))
SELECT counts.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND 100 * coalesce(lost.n, 0) <= {MAX_LOST_PERCENT} * word_chars AS kept
FROM counts LEFT JOIN lost USING (doc_id)
"""

SQL["op8_decontamination"] = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '{BREAK}'), lambda x: x <> '') AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array({LOWER}, '{BREAK}'), lambda x: x <> '') AS words FROM benchmark),
win AS (SELECT DISTINCT item, words[i:i + 9] AS g FROM b, unnest(range(1, greatest(len(words) - 8, least(len(words), 1) + 1))) AS u(i)),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
found AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, words[i:i + n - 1] AS g FROM d, sizes, unnest(range(1, len(words) - n + 2)) AS u(i)) x
          JOIN win USING (g)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM found, unnest(range(0, n)) AS r(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id),
dw AS MATERIALIZED (SELECT doc_id, i AS pos, words[i] AS word FROM d, unnest(range(1, len(words) + 1)) AS u(i)),
freq AS (SELECT word, count(*) AS n FROM dw GROUP BY word),
term AS MATERIALIZED (SELECT g, i AS off, g[i] AS word FROM (SELECT DISTINCT g FROM win), unnest(range(1, len(g) + 1)) AS u(i)),
anchor AS (SELECT g, min({{'n': n, 'off': off, 'word': word}}) AS a FROM term JOIN freq USING (word) GROUP BY g HAVING count(*) = len(g)),
cand AS (SELECT DISTINCT doc_id, g, pos - a.off + s.d AS p FROM anchor JOIN dw ON dw.word = a.word, unnest(range(-{NEAR}, {NEAR} + 1)) AS s(d)),
close AS (SELECT c.doc_id, c.g, c.p FROM cand c JOIN term t USING (g) JOIN dw ON dw.doc_id = c.doc_id AND dw.word = t.word
    AND dw.pos BETWEEN c.p + t.off - {NEAR} AND c.p + t.off + {NEAR} GROUP BY ALL HAVING count(DISTINCT t.off) = len(c.g)),
near AS (SELECT doc_id, count(DISTINCT item) AS n FROM close JOIN win USING (g) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(items.list, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated, coalesce(near.n, 0) AS n_near_items
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""


def _lloyd(dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> str:
    """Lloyd's rounds as a chain of common table expressions."""
    key = f"sha256('{seed}:' || vec_id)"
    ctes = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
         list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
)""", f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY {key}, v) - 1 AS c, v FROM (SELECT * FROM kept WHERE vec_id IS NOT NULL ORDER BY {key}, v LIMIT {k})
)"""]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS near
  FROM (SELECT row, vec_id, kept.v, c,
               list_sum(list_transform(list_zip(kept.v, m.v), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT))) AS d
        FROM kept, c{r} AS m) GROUP BY row
)""")
        if r < rounds:
            ctes.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT old.c, coalesce(new.v, old.v) AS v
  FROM c{r} AS old LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
    FROM (SELECT near.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) AS u(i) GROUP BY ALL) GROUP BY c
  ) AS new ON old.c = new.c
)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, CAST(near.c AS INTEGER) AS cluster, CAST(near.d AS BIGINT) AS distance,
       CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia, CAST(sum(near.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS m ON near.c = m.c
"""


SQL["op11_centroids"] = _lloyd()

# CRC-32 of the id in decimal, bit by bit; then the planted repeats, all maximal stretches of every lag, and of those that
# qualify the ones that no smaller lag covers.
SQL["op13_periodic_runs"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)) AS code
  FROM documents
), h AS (
  SELECT row, doc_id, w, len(w) AS n,
         xor(4294967295, list_reduce(flatten(list_transform(code, lambda o: list_transform(range(8), lambda b: (o >> b) & 1))),
             lambda c, b: xor((xor(c, b)) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295)) AS h
  FROM d
), a AS (SELECT *, h % 10 = 0 AND n > 0 AS planted, h // 10 AS g FROM h),
p AS (SELECT row, doc_id, w, n, planted, CASE WHEN planted THEN g % n END AS a,
             CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM a),
docs AS (
  SELECT row, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END])
                              ELSE w END AS w FROM p
), words AS (SELECT row, n, unnest(range(n)) AS i, unnest(w) AS word FROM docs WHERE n >= 24),
same AS (
  SELECT x.row, y.i - x.i AS q, x.i AS i, x.i - row_number() OVER (PARTITION BY x.row, y.i - x.i ORDER BY x.i) AS island
  FROM words AS x JOIN words AS y ON x.row = y.row AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT row, q, min(i) AS s, count(*) + q AS len FROM same GROUP BY row, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), runs AS (
  SELECT * FROM stretches AS r WHERE NOT EXISTS (
    SELECT 1 FROM stretches AS t WHERE t.row = r.row AND t.q < r.q AND t.s <= r.s AND t.s + t.len >= r.s + r.len)
), best AS (
  SELECT row, s, len, q FROM runs AS r WHERE NOT EXISTS (
    SELECT 1 FROM runs AS t WHERE t.row = r.row AND (t.len * r.q > r.len * t.q OR (t.len * r.q = r.len * t.q AND
      (t.s < r.s OR (t.s = r.s AND t.q < r.q)))))
), listed AS (
  SELECT row, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS txt FROM runs GROUP BY row
), dropped AS (SELECT row, list(DISTINCT i) AS gone FROM (SELECT row, unnest(range(s + q, s + len)) AS i FROM runs) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, CAST(len AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
       CAST(1000 * len // q AS BIGINT) AS exponent_milli, sha256(coalesce(txt, '')) AS runs_sha256,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w
                                   ELSE list_transform(list_filter(range(n), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]) END, ' '))
         AS collapsed_sha256
FROM docs LEFT JOIN listed USING (row) LEFT JOIN best USING (row) LEFT JOIN dropped USING (row)
"""
