"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

import math

from inkgrid.llm.license_scan import NOTICES, PHRASES, THRESHOLD, WINDOW, told_apart

LOWERED = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_scan_sql() -> str:
    sets = [sorted(set(text.split())) for _, text in NOTICES]
    needed = [math.ceil(THRESHOLD * len(x) - 1e-9) for x in sets]
    apart = told_apart([label for label, _ in NOTICES], sets, needed)
    notices = ", ".join(f"({k}, '{label}', {sets[k]!r}, {needed[k]}, {math.ceil(WINDOW * len(text.split()))}, {apart[k]!r}::VARCHAR[][])" for k, (label, text) in enumerate(NOTICES))
    phrases = ", ".join(f"({text.split()!r}, '{label}')" for text, label in PHRASES.items())
    return f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, {LOWERED.format("text")} AS t FROM documents),
worded AS (SELECT doc_id, r, t, regexp_extract_all(t, '{ALNUM}') AS w FROM docs),
phrases(p, label) AS (VALUES {phrases}),
places AS (
  SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(p)] = p)) AS place FROM worded, phrases
),
base AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS l FROM places GROUP BY r
),
notices(k, label, terms, needed, span, apart) AS (VALUES {notices}),
terms AS (SELECT k, needed, span, apart, label, len(terms) AS n, unnest(terms) AS x FROM notices),
placed AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS place FROM worded),
spots AS (SELECT r, k, place, x, needed, span, apart, label, n FROM placed JOIN terms USING (x)),
windows AS (
  SELECT a.r, a.k, a.place, any_value(a.label) AS label, any_value(a.n) AS n, any_value(a.needed) AS needed, any_value(a.apart) AS apart, list(DISTINCT b.x) AS held
  FROM spots a JOIN spots b ON a.r = b.r AND a.k = b.k AND b.place >= a.place AND b.place < a.place + a.span GROUP BY a.r, a.k, a.place
),
hits AS (SELECT r, label, len(held) / n AS score FROM windows WHERE len(held) >= needed AND len(list_filter(apart, lambda own: len(list_intersect(own, held)) = 0)) = 0),
found AS (SELECT r, list(DISTINCT label) AS l, max(score) AS score FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(base.l, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(found.l, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(found.score, 0.0)::DOUBLE END AS score
FROM worded LEFT JOIN base USING (r) LEFT JOIN found USING (r)
"""


#: Pairs that share a shingle, and a recursive walk over the links.
NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM w
),
e AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * b.n >= 80 * a.n AND 100 * a.n >= 80 * b.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM s LEFT JOIN low ON a = doc_id
"""
#: Every pair of a query and a candidate, exactly; the small table leaves the search nothing to miss.
NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""

#: Item windows met with document windows of the same length.
LEAKS_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({LOWERED.format("text")}, '{ALNUM}') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWERED.format("text")}, '{ALNUM}') AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, w[k:k + least(len(w), 10) - 1] AS x FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(k) WHERE len(w) > 0),
dw AS (SELECT r, k, n, w[k:k + n - 1] AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
found AS (SELECT DISTINCT r, k, n, item FROM dw JOIN iw USING (n, x)),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM found) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY r),
sets AS (SELECT k, list_distinct(x) AS s FROM (SELECT row_number() OVER () AS k, x FROM (SELECT DISTINCT x FROM iw))),
terms AS (SELECT k, len(s) AS needed, unnest(s) AS t FROM sets),
spots AS (SELECT r, k, needed, t, spot FROM (SELECT r, unnest(w) AS t, unnest(range(len(w))) AS spot FROM d) JOIN terms USING (t)),
full_docs AS (SELECT r, k FROM spots GROUP BY r, k, needed HAVING count(DISTINCT t) = needed),
close_by AS (
  SELECT r, k, needed, count(DISTINCT t) OVER (PARTITION BY r, k ORDER BY spot RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n FROM spots SEMI JOIN full_docs USING (r, k)
),
near_by AS (SELECT r, count(DISTINCT item) AS n_near FROM (SELECT DISTINCT r, k FROM close_by WHERE n = needed) JOIN sets USING (k) JOIN iw ON list_sort(list_distinct(x)) = list_sort(s) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN near_by USING (r)
"""

#: The checksum of an ASCII text, bit by bit.
CRC32 = (
    "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)),"
    " lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"
)
#: Every pair of equal words of a text by distance, and stretches of such pairs as islands.
RUNS_SQL = rf"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         {CRC32.format("doc_id::VARCHAR")} AS h FROM documents
),
ga AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
gp AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM ga),
d AS (
  SELECT doc_id, r, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM gp
),
x AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
pairs AS (SELECT a.r, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.r = b.r AND a.x = b.x AND a.i < b.i),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM pairs),
stretches AS (SELECT r, q, min(i) AS s, count(*) + q AS n FROM islands GROUP BY r, q, g HAVING count(*) >= greatest(q, 12 - q)),
runs AS (SELECT r, s, n, min(q) AS q FROM stretches GROUP BY r, s, n),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS l, arg_min((s, n, q), (-n, s, q)) AS b FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + n)) AS i FROM runs),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS c FROM x ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b[1]::BIGINT AS start, b[2]::BIGINT AS length, b[3]::BIGINT AS period,
       (1000 * b[2] // b[3])::BIGINT AS exponent_milli, sha256(coalesce(l, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""


def repair_sql() -> str:
    """Row by row: the cheapest edits that lead to each state, as texts of an eight-digit cost and the audit."""

    def add(state: str, cost: str, edit: str) -> str:
        return f"(printf('%08d', {state}[:8]::INTEGER + {cost}) || {state}[9:] || '{edit}')"

    def when(condition: str, state: str, cost: str, edit: str) -> str:
        return f"CASE WHEN {condition} THEN {add(state, cost, edit)} END"

    free, extra = "NOT blank AND NOT dup", "(CASE WHEN cut THEN 3 ELSE 0 END)"
    edited = {
        0: [add("x0", "4", "D")],
        1: [add("x1", "4", "D"), when(f"{free} AND ini = 's'", "x0", extra, "K")],
        2: [add("x2", "4", "D")] + [w for p in (0, 1, 3) for w in (when(f"{free} AND ini = 'u'", f"x{p}", extra, "K"), when(free, f"x{p}", f"3 + {extra}", "R"))],
        3: [add("x3", "4", "D"), when(f"{free} AND ini = 'a'", "x2", extra, "K"), when(free, "x2", f"3 + {extra}", "R")],
    }
    m = ", ".join(f"least({', '.join(w)}) AS m{q}" if len(w) > 1 else f"{w[0]} AS m{q}" for q, w in edited.items())
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32.format(key)} % 20 AS k FROM conversations),
left_over AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE k <> 0
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS ini FROM left_over),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS two FROM numbered),
faults AS (SELECT *, again AND NOT blank AS dup, NOT again AND NOT blank AND NOT regexp_matches(text, '[.!?]{space}*\z') AS cut FROM seen),
convs AS (SELECT DISTINCT conv_id FROM conversations),
dp(conv_id, i, x0, x1, x2, x3) AS (
  SELECT conv_id, 0::BIGINT, '00000000', NULL::VARCHAR, '00000003I', '00000006II' FROM convs
  UNION ALL
  SELECT conv_id, i, m0, m1, y2, least(m3, {add("y2", "3", "I")}) FROM (
    SELECT *, least(m2, {add("m0", "3", "I")}, {add("m1", "3", "I")}, {add("m3", "3", "I")}) AS y2 FROM (
      SELECT f.conv_id, f.i, {m} FROM dp JOIN faults f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1))
),
best AS (SELECT conv_id, arg_max(least(x0, x3), i) AS b, max(i) AS n FROM dp GROUP BY conv_id),
edits AS (SELECT conv_id, unnest(string_split(b[9:], '')) AS e, unnest(range(len(b) - 8)) AS j FROM best WHERE len(b) > 8 AND n > 0),
placed AS (SELECT *, count(*) FILTER (WHERE e <> 'I') OVER w AS i, count(*) FILTER (WHERE e <> 'D') OVER w AS k FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
rowed AS (SELECT p.conv_id, e, j, k, f.role, f.text, bool_or(k = 1 AND e = 'K' AND f.ini = 's') OVER (PARTITION BY p.conv_id) AS headed
          FROM placed p LEFT JOIN faults f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.i = f.i AND e <> 'I' WHERE e <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (k + CASE WHEN headed THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS l FROM rowed GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
         count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, CASE WHEN n > 0 THEN b[:8]::BIGINT ELSE 0 END AS cost, CASE WHEN n > 0 THEN b[9:] ELSE '' END AS audit, sha256(coalesce(l, '')) AS repaired_sha256
FROM convs c JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN counts ON c.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN lines ON c.conv_id IS NOT DISTINCT FROM lines.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_repair": repair_sql(), "op13_periodic_runs": RUNS_SQL, "op12_decontamination": LEAKS_SQL, "op5_near_duplicates": NEAR_SQL, "op7_nearest_neighbours": NEAREST_SQL, "op6_license_scan": license_scan_sql()}
