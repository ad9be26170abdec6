"""DuckDB SQL for the registered queries that SQL can express on whole tables."""

from __future__ import annotations

from clausework.llm.url_filter import _LINK, RULES

# A line's key: the line without ASCII white space at its ends, A-Z in lower case.
LINE_KEY = (
    "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

OP5 = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM split),
keyed AS (SELECT doc_id, pos, line, {LINE_KEY} AS k FROM lines),
often AS (
  SELECT k, max(doc_id) AS largest FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
),
judged AS (
  SELECT keyed.doc_id, pos, line, coalesce(often.largest <> keyed.doc_id, false) AS gone
  FROM keyed LEFT JOIN often ON keyed.k = often.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"list_filter(string_split_regex({LOWERED}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
GRAMS = "list_transform(range(1, greatest(len(ws) - 3, 1)), lambda i: array_to_string(ws[i:i + 4], ' '))"

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM pairs JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b WHERE 100 * common >= 85 * (m.n + k.n - common)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT a, min(b) AS lo FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(lo, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(lo, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""

# Every window that shares a shingle with an item, compared by counts. Items here have five words or more.
OP3 = f"""
WITH item_words AS (SELECT item_id, {WORDS.format("coalesce(text, '')")} AS ws FROM benchmark),
item_grams AS (SELECT item_id, len(ws) AS words, unnest({GRAMS}) AS g FROM item_words WHERE len(ws) >= 5),
item_counts AS (SELECT item_id, words, g, count(*) AS n FROM item_grams GROUP BY ALL),
doc_words AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
doc_grams AS (
  SELECT doc_id, len(ws) AS total, unnest(range(len(ws) - 4)) AS pos, unnest({GRAMS}) AS g
  FROM doc_words WHERE len(ws) >= 5
),
hits AS (SELECT doc_id, total, pos, item_id, words FROM doc_grams JOIN item_counts USING (g)),
laid AS (
  SELECT DISTINCT doc_id, item_id, words,
    unnest(range(greatest(0, pos - (words - 5)), least(pos, total - words) + 1)) AS start
  FROM hits WHERE total >= words
),
held AS (
  SELECT laid.doc_id, item_id, words, start, g, count(*) AS n
  FROM laid JOIN doc_grams d ON d.doc_id = laid.doc_id AND d.pos BETWEEN start AND start + words - 5
  GROUP BY ALL
),
shared AS (
  SELECT doc_id, held.item_id, held.words, start, sum(least(held.n, c.n)) AS common
  FROM held JOIN item_counts c ON c.item_id = held.item_id AND c.g = held.g GROUP BY ALL
),
rated AS (SELECT *, common / (2 * (words - 4) - common) AS similarity FROM shared WHERE common / (2 * (words - 4) - common) >= 0.8)
SELECT doc_id, item_id, arg_max(start, (similarity, -start))::INTEGER AS start, max(words)::INTEGER AS n_words,
  round(max(similarity), 6) AS similarity
FROM rated GROUP BY doc_id, item_id
"""

ROUNDS = 40


def _raked() -> tuple[str, str]:
    """Rounds of scaling the cells to each marginal in turn."""
    steps, last = [], "start"
    for r in range(ROUNDS):
        for d in ("source", "lang", "topic"):
            name = f"r{r}_{d}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, "
                f"c.f * CASE WHEN m.s > 0 THEN t.target / m.s ELSE 1 END AS f FROM {last} c "
                f"JOIN (SELECT {d}, sum(f) AS s FROM {last} GROUP BY {d}) m ON m.{d} = c.{d} "
                f"JOIN t_{d} t ON t.{d} = c.{d})"
            )
            last = name
    return ",\n".join(steps), last


def _target(d: str, temper: float) -> str:
    return (
        f"o_{d} AS (SELECT {d}, sum(tokens) AS own FROM cells GROUP BY {d}), "
        f"t_{d} AS MATERIALIZED (SELECT {d}, CASE WHEN own > 0 THEN pow(own, {temper}) ELSE 0 END "
        f"/ (SELECT sum(CASE WHEN own > 0 THEN pow(own, {temper}) ELSE 0 END) FROM o_{d}) "
        f"* (SELECT sum(own) FROM o_{d}) AS target FROM o_{d})"
    )


def _op9() -> str:
    steps, last = _raked()
    return f"""
WITH marked AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'listing'
      WHEN regexp_matches(coalesce(text, ''), '[Ll]icen[cs]e|[Cc]opyright') THEN 'legal'
      WHEN contains(coalesce(text, ''), '@') THEN 'contact' ELSE 'prose' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens
  FROM documents
),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM marked GROUP BY ALL),
start AS MATERIALIZED (SELECT *, tokens AS f FROM cells),
{_target("source", 0.5)}, {_target("lang", 0.7)}, {_target("topic", 0.7)},
{steps},
weighed AS (
  SELECT m.doc_id, m.topic, m.tokens, CASE WHEN c.tokens > 0 THEN round(c.f / c.tokens, 6) ELSE 1 END AS weight,
    m.source, m.lang
  FROM marked m JOIN {last} c ON c.source = m.source AND c.lang = m.lang AND c.topic = m.topic
),
drawn AS (
  SELECT *, floor(weight + ('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::BIGINT / pow(16, 13))::INTEGER AS copies
  FROM weighed
)
SELECT doc_id, d.lang, d.source, topic, drawn.tokens AS n_tokens, weight, copies
FROM drawn JOIN documents d USING (doc_id) WHERE copies > 0
"""


# The scan's patterns.
SCAN = {
    "assign": "(?i:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{12,}",
    "hex": "[0-9a-f]{32,}",
    "ident": "(?i:user(?:name)?|login|client_?id|account_?id|access_?key(?:_?id)?)[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9@._-]{3,}",
    "key": "[A-Za-z0-9+/_=-]{20,}",
    "endpoint": "(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|s3)://[^\\x20\\x09-\\x0D\"''<>]+",
}
_CUT = "\n  UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {i} AS o, "
    f"string_split(regexp_replace(t, '{p}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS ps FROM plain"
    for i, (kind, p) in enumerate(SCAN.items())
)


def _near(*roles: str) -> str:
    return (
        "EXISTS (SELECT 1 FROM free q WHERE q.doc_id = p.doc_id AND q.kind IN ("
        + ", ".join(f"'{r}'" for r in roles)
        + ") AND abs(q.s - p.s) <= 256)"
    )


_SECRET, _IDENT = _near("assign", "hex", "key"), _near("access", "ident")
OP10 = f"""
WITH plain AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
cut AS ({_CUT}),
pieces AS (SELECT doc_id, kind, o, unnest(range(len(ps))) AS i, unnest(ps) AS piece FROM cut WHERE len(ps) > 1),
sized AS (
  SELECT doc_id, kind, o, i, CASE WHEN i > 0 THEN split_part(piece, chr(2), 1) ELSE '' END AS m,
    length(piece) - CASE WHEN i > 0 THEN 1 ELSE 0 END AS whole FROM pieces
),
placed AS (
  SELECT *, coalesce(sum(whole) OVER (PARTITION BY doc_id, kind ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM sized
),
parts AS (
  SELECT doc_id, kind, o, s, s + length(m) AS e FROM placed WHERE i > 0 AND CASE
    WHEN kind = 'assign' THEN length(regexp_extract(m, '{SCAN["assign"]}', 1)) >= 8
    WHEN kind = 'key' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')
    ELSE true END
),
free AS MATERIALIZED (
  SELECT * FROM parts p WHERE o < 3 OR NOT EXISTS (
    SELECT 1 FROM parts b WHERE b.doc_id = p.doc_id AND b.o < 3 AND b.s < p.e AND b.e > p.s)
),
said AS (
  SELECT *, kind || ':' || s || ':' || e AS x FROM free p WHERE o < 3
    OR (kind = 'ident' AND {_SECRET}) OR (kind = 'key' AND {_IDENT}) OR (kind = 'endpoint' AND {_SECRET} AND {_IDENT})
),
grouped AS (
  SELECT doc_id, count(*) FILTER (WHERE o = 0) AS a, count(*) FILTER (WHERE o = 1) AS b, count(*) FILTER (WHERE o = 2) AS c,
    string_agg(x, ',' ORDER BY s, o) FILTER (WHERE o < 3) AS base, string_agg(x, ',' ORDER BY s, o) AS every
  FROM said GROUP BY doc_id
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM documents LEFT JOIN grouped USING (doc_id)
"""

OP11 = """
WITH counted AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
),
failed AS (
  SELECT doc_id, part,
    (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 16 ELSE 0 END) AS mask
  FROM counted
),
marks AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
sets AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, mask
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
),
steps AS (
  SELECT filter_order, step,
    (1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1)::INT) AS own,
    list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', substr(filter_order, i, 1)) - 1)::INT))::INT AS before
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
),
audit AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (own | coalesce(before, 0)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM sets, steps GROUP BY ALL
)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM audit
"""


def _op13() -> str:
    ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h + p}', 'verdict': '{v}'}}"
        for v, h, p in ranked
    ]
    return f"""
WITH RECURSIVE named AS (
  SELECT page_id, url, html, {LOWERED.format("coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
),
fitted AS (SELECT *, CASE {' '.join(fits)} ELSE NULL END AS fit FROM named),
tags AS (SELECT host, unnest(list_distinct(list_transform(string_split_regex(html, '(?i)<a\\s')[2:], lambda t:
  {LOWERED.format(f"regexp_extract(split_part(t, '>', 1), '{LINK}', 1)")}))) AS dst FROM named),
links AS (SELECT host AS src, dst, count(*) AS weight FROM tags WHERE host <> '' AND dst <> '' AND dst <> host GROUP BY host, dst),
edges AS (
  SELECT 'allow' AS kind, src AS host, dst AS next, weight FROM links UNION ALL SELECT 'block', dst, src, weight FROM links
),
shares AS (SELECT kind, host, next, weight / sum(weight) OVER (PARTITION BY kind, host) AS share FROM edges),
seeds AS (SELECT fit.verdict AS kind, host, count(*) AS weight FROM fitted WHERE fit IS NOT NULL GROUP BY ALL),
walk AS (
  SELECT 0 AS k, kind, host, 0.15 * (weight / sum(weight) OVER (PARTITION BY kind)) AS score FROM seeds
  UNION ALL
  SELECT k + 1, kind, host, sum(score) FROM (
    SELECT k, kind, shares.next AS host, 0.85 * score * share AS score FROM walk JOIN shares USING (kind, host) WHERE k < 150
  ) GROUP BY ALL
),
ranks AS (SELECT kind, host, sum(score) AS score FROM walk GROUP BY ALL),
scaled AS (SELECT kind, host, score / sum(score) OVER (PARTITION BY kind) AS score FROM ranks),
blocked AS (
  SELECT host FROM scaled GROUP BY host
  HAVING coalesce(sum(score) FILTER (WHERE kind = 'block'), 0) > coalesce(sum(score) FILTER (WHERE kind = 'allow'), 0) + 1e-9
)
SELECT page_id, host, path, fit.rule AS rule,
  coalesce(fit.verdict, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' END, 'allow') AS verdict
FROM fitted
"""


LINK = _LINK.replace("'", "''")

ORACLES: dict[str, str] = {
    "op2_near_dedup": OP2,
    "op3_decontamination": OP3,
    "op5_line_dedup": OP5,
    "op9_mixing": _op9(),
    "op10_secret_scan": OP10,
    "op11_filter_audit": OP11,
    "op13_url_filter": _op13(),
}
