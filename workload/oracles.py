"""The registered queries in DuckDB SQL, over the same parquet tables."""

from __future__ import annotations

from clausework.functions.language import STOP_WORDS
from clausework.functions.urls import NEGATIVE_PATTERNS, POSITIVE_PATTERNS
from clausework.functions import prompts, taxonomy
from workload import derived as D

ORACLES: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


POSITIVE = quoted("|".join(POSITIVE_PATTERNS))
NEGATIVE = quoted("|".join(NEGATIVE_PATTERNS))
HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
LANG = """regexp_extract(html, '<html lang="([^"]*)"', 1)"""
VALID = r"'^https?://[A-Za-z0-9_.-]+\.[A-Za-z0-9-]+(:[0-9]{1,5})?([/?#]\S*)?$'"


def words(column: str) -> str:
    return f"len(list_filter(string_split({column}, ' '), lambda x: x <> ''))"


# ---- shared tables --------------------------------------------------------------------------

LINES = """lines AS (
  SELECT source AS url, doc_id AS page_key,
         (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS pos,
         unnest(string_split(text, chr(10))) AS paragraph
  FROM documents)"""
LONG = f"""{LINES}, long AS (SELECT * FROM lines WHERE {words('paragraph')} > 10)"""
CLEAN = f"""{LONG}, clean AS (
  SELECT url, page_key, pos, replace(regexp_replace(paragraph, '\\s{{2,}}', ' ', 'g'), '"', '''') AS paragraph
  FROM (SELECT url, page_key, trim(paragraph) AS paragraph, min(pos) AS pos FROM long GROUP BY ALL))"""
SPLITS = """splits AS (
  SELECT url, ((row_number() OVER (ORDER BY url) - 1) // 7)::INT AS split FROM (SELECT DISTINCT source AS url FROM documents))"""
CHUNK_FILES = """files AS (
  SELECT DISTINCT 'sites_' || (doc_id // 100 * 100) || '_' || (doc_id // 100 * 100 + 100) || '.json' AS name,
         (doc_id // 100 * 100)::INT AS "start", (doc_id // 100 * 100 + 100)::INT AS "end" FROM documents)"""

GRAPH = f"""base AS (SELECT page_id, {HOST} AS h, {LANG} AS language FROM pages),
hosts AS (
  SELECT page_id, language, home, coalesce(nxt, home) AS nxt,
         CASE WHEN home % 3 = 0 THEN 'warranty.' || h ELSE h END AS host
  FROM (SELECT *, min(page_id) OVER (PARTITION BY h) AS home,
               lead(page_id) OVER (PARTITION BY h ORDER BY page_id) AS nxt FROM base)),
wanted AS (
  SELECT page_id, unnest([0, 1, 3, 4, 5]) AS k,
         unnest([page_id * 7 + 3, page_id * 13 + 5, page_id * 3 + 1, page_id * 17 + 2, page_id * 5 + 4])
           % (SELECT count(*) FROM pages) AS target
  FROM pages),
links AS (
  SELECT w.page_id, k,
         CASE k WHEN 0 THEN 'https://' || t.host || '/terms-of-use/' || target
                WHEN 1 THEN 'https://' || t.host || '/privacy-policy/terms/' || target
                WHEN 3 THEN 'mailto:terms@' || t.host
                WHEN 4 THEN 'javascript:void(0);'
                ELSE 'https://' || t.host || '/shop/' || target END AS href,
         CASE k WHEN 4 THEN 'window.location.href=''https://' || t.host || '/terms-of-use/' || target || '''' END AS onclick
  FROM wanted w JOIN hosts t ON t.page_id = w.target
  UNION ALL SELECT page_id, 2, '/refund-policy/' || nxt, NULL FROM hosts),
facts AS (
  SELECT 'https://' || host || '/' || path || '/' || page_id AS link, page_id, language
  FROM hosts, (VALUES ('terms-of-use'), ('refund-policy'), ('shop')) v(path) WHERE page_id % 11 <> 7)"""


def resolved(seed: str) -> str:
    return f"""CASE WHEN contains(href, 'javascript:void(0);') THEN regexp_extract(onclick, 'https?://[^\\s''"]+')
         WHEN starts_with(href, '/') THEN 'https://' || {seed} || href ELSE href END"""


def matched(link: str, seed: str) -> str:
    rest = f"replace({link}, {seed}, '')"
    return f"(NOT regexp_matches({rest}, {NEGATIVE}) AND regexp_matches({rest}, {POSITIVE}))"


OWN_LINKS = f"""{GRAPH}, own AS (
  SELECT page_id, k, href, onclick, seed, CASE WHEN regexp_matches(link, {VALID}) THEN link END AS link
  FROM (SELECT l.*, h.host AS seed, {resolved('h.host')} AS link FROM links l JOIN hosts h USING (page_id)))"""

FIRST = f"""first AS (
  SELECT DISTINCT seed, link FROM own JOIN hosts h USING (page_id)
  WHERE h.page_id = h.home AND link IS NOT NULL AND {matched('link', 'seed')})"""


def step(source: str, english: bool) -> str:
    """Links found on the pages of ``source (seed, link, …)``."""
    gate = "AND lower(f.language) LIKE 'en%'" if english else ""
    return f"""(SELECT w.*, {resolved('w.seed')} AS found
     FROM {source} w JOIN facts f ON f.link = w.link {gate} JOIN links l ON l.page_id = f.page_id)"""


SECOND = f"""second AS (
  SELECT DISTINCT seed, found AS link FROM {step('first', False)}
  WHERE regexp_matches(found, {VALID}) AND {matched('found', 'seed')})"""
WALK = f"""walk(seed, link, depth) AS (
  SELECT seed, link, 1 FROM first
  UNION
  SELECT seed, found, depth + 1 FROM {step('walk', True)}
  WHERE depth < 3 AND regexp_matches(found, {VALID}) AND {matched('found', 'seed')}),
walked AS (
  SELECT w.seed, w.link, w.depth, f.link IS NOT NULL AS fetched, coalesce(lower(f.language) LIKE 'en%', false) AS english
  FROM (SELECT seed, link, min(depth)::INT AS depth FROM walk GROUP BY ALL) w LEFT JOIN facts f USING (link))"""
CRAWL = f"WITH RECURSIVE {OWN_LINKS}, {FIRST}, {WALK}"

SITE_REPLY = f"""list_extract({listed(D.SITE_REPLIES)}, (page_id % 5 + 1)::INT)"""
CLEANED_REPLY = (
    f"replace(replace(replace(replace(replace(trim({SITE_REPLY}), chr(10), ''), '`', ''), '''', '\"'), ',', ''), 'json', '')"
)
SITE_CLASS = f"""classes AS (
  SELECT page_id, url, CASE WHEN NOT json_valid(reply) THEN -1 ELSE (reply::JSON->>'is_shopping')::INT END AS is_shopping,
         CASE WHEN json_valid(reply) THEN (reply::JSON->>'is_shopping' IS NULL)::INT ELSE 0 END AS class_error
  FROM (SELECT page_id, url, CASE WHEN {CLEANED_REPLY} <> '' THEN {CLEANED_REPLY} END AS reply FROM pages))"""
FUNNEL = f"""{SITE_CLASS}, inputs AS (
  SELECT url, page_id, {LANG} AS language, html, (page_id // 100)::INT AS chunk, page_id % 10 < 8 AS accessible,
         page_id % 10 < 8 AND lower({LANG}) LIKE 'en%' AS english, is_shopping, class_error
  FROM pages JOIN classes USING (page_id, url))"""
FUNNEL_COUNTS = f"""{FUNNEL}, counts AS (
  SELECT chunk, count(*) FILTER (accessible) AS accessible, count(*) FILTER (english) AS english,
         count(*) FILTER (english AND is_shopping = 1) AS is_shopping,
         count(*) FILTER (NOT accessible OR (english AND class_error = 1)) AS errors,
         coalesce(array_to_string(list_sort(list(url) FILTER (NOT accessible OR (english AND class_error = 1))), ' '), '') AS error_urls
  FROM inputs GROUP BY chunk)"""



def whole(vector: str, places: int) -> str:
    """All components as whole numbers of a unit."""
    return f"array_to_string(list_transform({vector}, lambda x: round(x * 1e{places})::BIGINT::VARCHAR), ',')"


POINTS = """points AS (SELECT 0 AS scope, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"""
DOC_POINTS = """tokens AS (
  SELECT doc_id AS id, ('0x' || md5(token)[:8])::BIGINT % 64 AS place, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS token FROM documents) WHERE token <> ''
  GROUP BY ALL),
norms AS (SELECT id, sqrt(sum(n * n)) AS norm FROM tokens GROUP BY id),
doc_vectors AS (
  SELECT d.doc_id AS id, list(coalesce((t.n / norms.norm)::FLOAT, 0::FLOAT)::DOUBLE ORDER BY p.place) AS v
  FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS place) p
  LEFT JOIN tokens t ON t.id = d.doc_id AND t.place = p.place LEFT JOIN norms ON norms.id = d.doc_id GROUP BY d.doc_id)"""


def unit(points: str = "points") -> str:
    """Unit vectors, and for identical ones the smallest id and their number."""
    return f"""unit AS (
  SELECT scope, id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u,
         min(id) OVER (PARTITION BY scope, v) AS rid, count(*) OVER (PARTITION BY scope, v) AS copies
  FROM {points})"""


def labels(eps_list: list[float], min_samples: int, points: str = "points") -> str:
    """Density clusters per eps in plain joins; needs a recursive WITH."""
    values = ", ".join(f"({e}::DOUBLE)" for e in eps_list)
    return f"""{unit(points)},
sym AS (
  SELECT e.eps, a.scope, a.id AS a, b.id AS b FROM (VALUES {values}) e(eps)
  JOIN unit a ON true JOIN unit b ON a.scope = b.scope AND (a.id = b.id OR 1 - list_dot_product(a.u, b.u) <= e.eps)),
core AS (SELECT eps, scope, a AS id FROM sym GROUP BY ALL HAVING count(*) >= {min_samples}),
core_edges AS (
  SELECT s.* FROM sym s JOIN core x ON x.eps = s.eps AND x.scope = s.scope AND x.id = s.a
  JOIN core y ON y.eps = s.eps AND y.scope = s.scope AND y.id = s.b),
reach(eps, scope, id, r) AS (
  SELECT eps, scope, id, id FROM core
  UNION
  SELECT c.eps, c.scope, c.b, reach.r FROM reach
  JOIN core_edges c ON c.eps = reach.eps AND c.scope = reach.scope AND c.a = reach.id AND reach.r < c.b),
root AS (SELECT eps, scope, id, min(r) AS root FROM reach GROUP BY ALL),
lab AS (
  SELECT * FROM root
  UNION ALL
  SELECT s.eps, s.scope, s.a, min(r.root) FROM sym s
  JOIN root r ON r.eps = s.eps AND r.scope = s.scope AND r.id = s.b
  LEFT JOIN core c ON c.eps = s.eps AND c.scope = s.scope AND c.id = s.a WHERE c.id IS NULL GROUP BY ALL),
ranked AS (
  SELECT eps, scope, root, (dense_rank() OVER (PARTITION BY eps, scope ORDER BY root) - 1)::INT AS cluster_id
  FROM (SELECT DISTINCT eps, scope, root FROM root)),
labels AS (
  SELECT e.eps, p.scope, p.id, coalesce(r.cluster_id, -1)::INT AS cluster_id
  FROM (VALUES {values}) e(eps) JOIN unit p ON true
  LEFT JOIN lab l ON l.eps = e.eps AND l.scope = p.scope AND l.id = p.id
  LEFT JOIN ranked r ON r.eps = l.eps AND r.scope = l.scope AND r.root = l.root)"""


EMBEDDED = f"WITH RECURSIVE {POINTS}, {labels([0.66], 5)}"
# sanitised lines by split and chunk; the scope of a chunk is split * 1000 + chunk
LINE_POINTS = f"""{CLEAN}, {SPLITS},
ordered AS (
  SELECT split, paragraph, row_number() OVER (PARTITION BY split ORDER BY url, page_key, pos) - 1 AS id,
         ceil(count(*) OVER (PARTITION BY split) / 10)::BIGINT AS size
  FROM clean JOIN splits USING (url)),
placed AS (SELECT split, (id // size)::INT AS chunk, split * 1000 + (id // size)::INT AS scope, id, paragraph FROM ordered),
tokens AS (
  SELECT scope, id, ('0x' || md5(token)[:8])::BIGINT % 64 AS place, count(*) AS n
  FROM (SELECT scope, id, unnest(regexp_split_to_array(lower(paragraph), '\\s+')) AS token FROM placed) WHERE token <> ''
  GROUP BY ALL),
norms AS (SELECT scope, id, sqrt(sum(n * n)) AS norm FROM tokens GROUP BY ALL),
points AS (
  SELECT d.scope, d.id, list(coalesce((t.n / norms.norm)::FLOAT, 0::FLOAT)::DOUBLE ORDER BY p.place) AS v
  FROM placed d CROSS JOIN (SELECT unnest(range(64)) AS place) p
  LEFT JOIN tokens t ON t.scope = d.scope AND t.id = d.id AND t.place = p.place
  LEFT JOIN norms ON norms.scope = d.scope AND norms.id = d.id GROUP BY d.scope, d.id)"""
CLUSTERS = f"""WITH RECURSIVE {LINE_POINTS}, {labels([0.25], 2)},
members AS (
  SELECT split, chunk, eps, l.cluster_id, l.id, paragraph, md5('7:' || l.id) AS h
  FROM labels l JOIN placed d ON d.scope = l.scope AND d.id = l.id),
clusters AS (
  SELECT split, chunk, eps, cluster_id, count(*) AS size, string_agg(paragraph, chr(10) ORDER BY id) AS paragraphs,
         array_to_string(list(paragraph ORDER BY h, id)[:5], chr(10)) AS sample
  FROM members WHERE cluster_id >= 0 GROUP BY ALL)"""
BOUNDED = f"{CLUSTERS}, bounded AS (SELECT * FROM clusters WHERE size > 2 AND size < 1000)"
KEYS = "split, chunk, eps, cluster_id"
CLUSTER_REPLY = f"list_extract({listed(D.CLUSTER_REPLIES)}, (cluster_id % 4 + 1)::INT)"
TOPIC_REPLY = f"list_extract({listed(D.TOPIC_REPLIES)}, (cluster_id % 3 + 1)::INT)"
TOPICS = f"""{BOUNDED}, topics AS (
  SELECT {KEYS}, size, {TOPIC_REPLY}::JSON->>'category' AS category FROM bounded
  WHERE cluster_id % 4 = 0 AND lower({TOPIC_REPLY}::JSON->>'category') <> 'benign')"""

TERMS = f"""{LINES}, terms AS (
  SELECT page_key AS doc_id, pos, url AS site, trim(paragraph) AS term FROM lines WHERE regexp_matches(paragraph, '\\S'))"""
HITS = "[" + ", ".join(f"CASE WHEN regexp_matches(lower(term), {quoted(p)}) THEN {quoted(c)} END" for c, p in D.RULES) + "]"
TAGGED = f"""{TERMS}, tagged AS (
  SELECT *, CASE WHEN len(found) = 0 THEN ['{taxonomy.OTHERS}'] ELSE list_sort(list_distinct(found)) END AS categories
  FROM (SELECT *, list_filter({HITS}, lambda x: x IS NOT NULL) AS found FROM terms))"""

# ---- text -----------------------------------------------------------------------------------

SCHEMELESS = "replace(replace(url, 'https://', ''), 'http://', '')"
ORACLES["strip_scheme"] = f"SELECT page_id, {SCHEMELESS} AS domain FROM pages"
ORACLES["with_scheme"] = f"""
SELECT page_id, CASE WHEN contains(url, 'https://') OR contains(url, 'http://') THEN url ELSE 'https://' || url END AS url
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {SCHEMELESS} ELSE url END AS url FROM pages)"""
ORACLES["page_slug"] = f"SELECT page_id, replace({SCHEMELESS}, '/', '_')[:255] AS slug FROM pages"
ORACLES["strip_text"] = r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents"
ORACLES["normalise_ws"] = r"""
SELECT doc_id, regexp_replace(replace(replace(text, '.', ' . ' || chr(10)), chr(10), ' '), '\s{2,}', ' ', 'g') AS text FROM documents"""
ORACLES["sanitise_quotes"] = """SELECT doc_id, replace(text, '"', '''') AS text FROM documents"""
SENTENCES = r"""string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.?!]) ', '\1' || chr(1), 'g'), chr(1))"""
ORACLES["split_sentences"] = f"""
SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS pos, unnest(s) AS sentence
FROM (SELECT doc_id, list_filter({SENTENCES}, lambda x: x <> '') AS s FROM documents)"""
ORACLES["explode_lines"] = f"WITH {LINES} SELECT * FROM lines"
ORACLES["explode_terms"] = rf"WITH {LINES} SELECT page_key AS doc_id, pos, paragraph AS term FROM lines WHERE regexp_matches(paragraph, '\S')"
ORACLES["non_blank"] = rf"WITH {LINES} SELECT page_key, pos FROM lines WHERE regexp_matches(paragraph, '\S')"
ORACLES["min_words"] = f"WITH {LONG} SELECT page_key, pos, paragraph FROM long"
ORACLES["text_match"] = f"""WITH {TERMS}
SELECT doc_id, pos, regexp_matches(lower(term || ['', ' Return POLICY', ' privacy policy'][pos % 3 + 1]), {POSITIVE})::INT AS matched
FROM terms"""
HIT_COUNTS = ", ".join(
    f"{{'hits': len(list_filter(tokens, lambda t: list_contains({listed(ws)}, t))), 'prior': {-i}, 'code': '{code}'}}"
    for i, (code, ws) in enumerate(STOP_WORDS.items())
)
ORACLES["detect_language"] = rf"""
SELECT doc_id, CASE WHEN best.hits > 0 THEN best.code END AS language
FROM (SELECT doc_id, list_max([{HIT_COUNTS}]) AS best
      FROM (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '\s+')) AS tokens FROM documents))"""

# Trigram places of a text's letters, counted per language over the first 400 texts by hash, and summed as scaled logs.
PLACES = "list_transform(range(1, len(l) - 1), lambda i: (l[i] * 961 + l[i + 1] * 31 + l[i + 2]) % 4096)"
LETTERS = r"list_transform(string_split(' ' || regexp_replace(lower({0}), '[^\pL]+', ' ', 'g') || ' ', ''), lambda c: unicode(c))"
ORACLES["language_model"] = f"""
WITH tagged AS (
  SELECT lang, {LETTERS.format('text')} AS l FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL
),
counts AS (SELECT lang, place, count(*) AS n FROM (SELECT lang, unnest({PLACES}) AS place FROM tagged) GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
model AS (
  SELECT t.lang, p.place, round(1000 * ln((coalesce(n, 0) + 1) / (total + 4096)))::BIGINT AS score
  FROM totals t CROSS JOIN (SELECT unnest(range(4096)) AS place) p LEFT JOIN counts c ON c.lang = t.lang AND c.place = p.place
),
texts AS (
  SELECT 'document' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'page', page_id, regexp_replace(html, '<[^>]*>', ' ', 'gs') FROM pages
),
placed AS (SELECT kind, id, {PLACES} AS ps FROM (SELECT kind, id, {LETTERS.format('text')} AS l FROM texts)),
held AS (SELECT kind, id, place, count(*) AS n FROM (SELECT kind, id, unnest(ps) AS place FROM placed) GROUP BY ALL),
scored AS (SELECT kind, id, lang, sum(n * score) AS total FROM held JOIN model USING (place) GROUP BY ALL),
best AS (SELECT kind, id, arg_max(lang, (total, -ascii(lang), -ascii(lang[2]))) AS language FROM scored GROUP BY kind, id)
SELECT kind, id, CASE WHEN len(list_filter(ps, lambda p: p <> {(32 * 961 + 32 * 31 + 32) % 4096})) > 0 THEN language END AS language
FROM placed JOIN best USING (kind, id)"""

# ---- paragraphs -----------------------------------------------------------------------------

for scope, keys in (("page", "url, page_key, paragraph"), ("site", "url, paragraph"), ("global", "paragraph")):
    ORACLES[f"dedupe_{scope}"] = f"""WITH {LONG}
SELECT url, page_key, pos, paragraph FROM long
QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY page_key, pos, url) = 1"""
ORACLES["sanitise_documents"] = f"WITH {CLEAN} SELECT * FROM clean"
ORACLES["stream_sanitise"] = f"WITH {CLEAN} SELECT url, page_key, paragraph FROM clean"
ORACLES["concat_splits"] = "SELECT doc_id, source, (doc_id % 4)::INT AS split FROM documents"

# An HTML parser for these pages in SQL: tags and texts in order; a paragraph ends where the count of open
# paragraphs falls below its own level, or at the end of the article.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
UNESCAPED = "t"
for entity, character in ENTITIES:
    UNESCAPED = f"regexp_replace({UNESCAPED}, '{entity}?', '{character}', 'g')"
TOKENS = rf"""marked AS (
  SELECT page_id, url, regexp_extract_all(regexp_replace(html, '<(script|style)>.*?</(script|style)>', '<cut>', 'gs'), '<[^>]+>|[^<]+') AS t
  FROM pages),
tokens AS (
  SELECT page_id, url, i, t, CASE WHEN t NOT LIKE '<%' THEN {UNESCAPED} END AS txt,
         sum(CASE t WHEN '<p>' THEN 1 WHEN '</p>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS open
  FROM (SELECT page_id, url, generate_subscripts(t, 1) AS i, unnest(t) AS t FROM marked))"""
PAGE_PARAGRAPHS = rf"""{TOKENS}, spans AS (
  SELECT s.page_id, s.url, s.i, min(e.i) AS till FROM tokens s
  LEFT JOIN tokens e ON e.page_id = s.page_id AND e.i > s.i AND (e.open < s.open OR e.t = '</article>')
  WHERE s.t = '<p>' GROUP BY ALL),
raw AS (
  SELECT s.page_id, s.url, s.i, regexp_replace(string_agg(x.txt, '' ORDER BY x.i), '^\s+|\s+$', '', 'g') AS paragraph
  FROM spans s JOIN tokens x ON x.page_id = s.page_id AND x.i > s.i AND x.i < coalesce(s.till, 1000000000) AND x.txt IS NOT NULL
  GROUP BY ALL),
page_paragraphs AS (
  SELECT page_id, url, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos, paragraph FROM raw WHERE paragraph <> '')"""
CLEAN_PAGES = rf"""{PAGE_PARAGRAPHS}, clean_pages AS (
  SELECT {HOST} AS url, page_id AS page_key, pos,
         replace(regexp_replace(replace(p, chr(10), ' '), '\s{{2,}}', ' ', 'g'), '"', '''') AS paragraph
  FROM (SELECT page_id, url, paragraph AS p, min(pos) AS pos FROM page_paragraphs GROUP BY ALL)
  WHERE len(list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> '')) > 10)"""
ORACLES["page_paragraphs"] = f"WITH {PAGE_PARAGRAPHS} SELECT page_id, pos, paragraph FROM page_paragraphs"
ORACLES["visible_text"] = f"WITH {TOKENS} SELECT page_id, string_agg(txt, ' ' ORDER BY i) AS text FROM tokens WHERE txt IS NOT NULL GROUP BY page_id"
ORACLES["sanitise_pages"] = f"WITH {CLEAN_PAGES} SELECT * FROM clean_pages"
ORACLES["stream_sanitise_pages"] = ORACLES["sanitise_pages"]

# ---- positions ------------------------------------------------------------------------------

ORACLES["row_position"] = "SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS pos FROM documents"
PART_COUNT = "(SELECT count(*) FROM part)"
ORACLES["rank_slice"] = f"""
SELECT p_partkey + 1 AS rank, p_name AS domain FROM part
WHERE p_partkey + 1 > {PART_COUNT} // 4 AND p_partkey + 1 <= {PART_COUNT} // 2"""
ORACLES["position_slice"] = f"""
SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS pos FROM part)
WHERE pos >= {PART_COUNT} // 4 AND pos < {PART_COUNT} // 2"""
ORACLES["assign_splits"] = f"WITH {SPLITS} SELECT doc_id, url, split FROM documents JOIN splits ON url = source"
ORACLES["chunk_of_100"] = """
SELECT doc_id, pos, (pos // 100)::INT AS chunk FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)"""
ORACLES["assign_chunks"] = """
SELECT doc_id, pos, (pos // ceil((SELECT count(*) FROM documents) / 7)::BIGINT)::INT AS chunk
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)"""
ORACLES["sample_members"] = """
SELECT source, doc_id FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) <= 5"""
ORACLES["latest_wins"] = f"""
SELECT page_id, {HOST} AS site, md5(html) AS html_md5 FROM pages
QUALIFY row_number() OVER (PARTITION BY {HOST} ORDER BY page_id DESC) = 1"""
ORACLES["cluster_rank"] = """
SELECT g, root, (dense_rank() OVER (PARTITION BY g ORDER BY root) - 1)::INT AS cluster_id
FROM (SELECT DISTINCT label % 3 AS g, label::BIGINT AS root FROM embeddings)"""
ORACLES["file_range_of"] = f"WITH {CHUNK_FILES} SELECT * FROM files"
ORACLES["file_range"] = f'WITH {CHUNK_FILES} SELECT * FROM files WHERE "start" >= 200 AND "end" <= 700'
ORACLES["range_bounds"] = f'WITH {CHUNK_FILES} SELECT min("start") AS "start", max("end") AS "end" FROM files'

# ---- pages and links ------------------------------------------------------------------------

ORACLES["html_lang"] = f"SELECT page_id, {LANG} AS language FROM pages"
ORACLES["english_only"] = f"SELECT page_id, {LANG} AS language FROM pages WHERE lower({LANG}) LIKE 'en%'"
ORACLES["language_histogram"] = f"SELECT {LANG} AS language, count(*) AS n FROM pages GROUP BY 1"
ORACLES["extract_links"] = """
SELECT page_id, (generate_subscripts(hrefs, 1) - 1)::INT AS pos, unnest(hrefs) AS href, NULL::VARCHAR AS onclick
FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages)"""
ORACLES["accessible"] = "SELECT url FROM pages WHERE page_id % 10 < 8 AND html <> ''"
ORACLES["resolve_link"] = f"WITH {OWN_LINKS} SELECT page_id, k, link FROM own"
ORACLES["valid_url"] = f"WITH {OWN_LINKS} SELECT page_id, k, regexp_matches(href, {VALID})::INT AS valid FROM own"
ORACLES["onclick_link"] = rf"""WITH {OWN_LINKS}
SELECT page_id, k, nullif(regexp_extract(onclick, 'https?://[^\s''"]+'), '') AS link FROM own"""
ORACLES["link_match"] = f"""WITH {OWN_LINKS}
SELECT page_id, k, {matched('link', 'seed')}::INT AS matched FROM own WHERE link IS NOT NULL"""
ORACLES["fetch_join"] = f"WITH {OWN_LINKS}, {FIRST} SELECT seed, link, language FROM first JOIN facts USING (link)"
ORACLES["fetch_errors"] = f"WITH {OWN_LINKS}, {FIRST} SELECT seed, link FROM first WHERE link NOT IN (SELECT link FROM facts)"
ORACLES["not_visited"] = f"WITH {OWN_LINKS}, {FIRST}, {SECOND} SELECT seed, link FROM second EXCEPT SELECT seed, link FROM first"
ORACLES["union_links"] = f"WITH {OWN_LINKS}, {FIRST}, {SECOND} SELECT seed, link FROM second UNION SELECT seed, link FROM first"
ORACLES["policy_crawl"] = f"{CRAWL} SELECT seed, link, depth FROM walked WHERE fetched AND english"
ORACLES["html_crawl"] = ORACLES["policy_crawl"]
ORACLES["crawl_levels"] = f"""{CRAWL}
SELECT depth, count(*) AS candidates, count(*) FILTER (fetched) AS fetched, count(*) FILTER (fetched AND english) AS kept
FROM walked GROUP BY depth"""
ORACLES["policy_page_counts"] = f"""{CRAWL}
SELECT count(DISTINCT seed) AS n_sites, count(*) AS n_pages FROM walked WHERE fetched AND english"""
ORACLES["not_collected"] = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
ORACLES["incremental_job"] = f"WITH {CLEAN} SELECT url, page_key, paragraph FROM clean"

# ---- site funnel ----------------------------------------------------------------------------

ORACLES["parse_site_class"] = f"WITH {SITE_CLASS} SELECT url, is_shopping, class_error FROM classes"
ORACLES["site_funnel"] = f"""WITH {FUNNEL}
SELECT url, language, is_shopping, md5(html) AS html_md5 FROM inputs WHERE english AND is_shopping IS NOT NULL"""
ORACLES["site_seeds"] = f"""WITH {FUNNEL}
SELECT {SCHEMELESS} AS seed, array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' ') AS hrefs
FROM inputs WHERE english AND is_shopping <> 0"""
ORACLES["shopping_gate_strict"] = f"WITH {FUNNEL} SELECT url, is_shopping FROM inputs WHERE english AND is_shopping = 1"
ORACLES["shopping_gate_truthy"] = f"WITH {FUNNEL} SELECT url, is_shopping FROM inputs WHERE english AND is_shopping <> 0"
ORACLES["funnel_counts"] = f"WITH {FUNNEL_COUNTS} SELECT * FROM counts"
ORACLES["funnel_totals"] = f"""WITH {FUNNEL_COUNTS}
SELECT sum(accessible)::BIGINT AS accessible, sum(english)::BIGINT AS english, sum(is_shopping)::BIGINT AS is_shopping FROM counts"""

# ---- dataset statistics ---------------------------------------------------------------------

ORACLES["dataset_stats"] = f"""WITH {CLEAN}, {SPLITS}
SELECT split, count(*) AS n_rows, count(DISTINCT url) AS n_sites FROM clean JOIN splits USING (url) GROUP BY split"""
TOTALS = """count(*) AS n_rows, count(DISTINCT (split, url)) AS n_sites_summed, count(DISTINCT url) AS n_sites_distinct"""
ORACLES["dataset_totals"] = f"WITH {CLEAN} SELECT {TOTALS} FROM (SELECT *, page_key % 4 AS split FROM clean)"
ORACLES["stage_report"] = f"""WITH RECURSIVE {OWN_LINKS}, {FIRST}, {WALK}, {CLEAN}, {SPLITS}, {FUNNEL_COUNTS}, {CHUNK_FILES},
dataset AS (SELECT {TOTALS} FROM clean JOIN splits USING (url)),
kept AS (SELECT seed FROM walked WHERE fetched AND english)
SELECT 'accessible' AS metric, sum(accessible)::BIGINT AS value FROM counts
UNION ALL SELECT 'english', sum(english)::BIGINT FROM counts
UNION ALL SELECT 'is_shopping', sum(is_shopping)::BIGINT FROM counts
UNION ALL SELECT 'list_start', min("start")::BIGINT FROM files
UNION ALL SELECT 'list_end', max("end")::BIGINT FROM files
UNION ALL SELECT 'policy_n_sites', count(DISTINCT seed) FROM kept
UNION ALL SELECT 'policy_n_pages', count(*) FROM kept
UNION ALL SELECT 'dataset_n_rows', n_rows FROM dataset
UNION ALL SELECT 'dataset_n_sites_summed', n_sites_summed FROM dataset
UNION ALL SELECT 'dataset_n_sites_distinct', n_sites_distinct FROM dataset"""

# ---- vectors and clusters -------------------------------------------------------------------

ORACLES["l2_normalise"] = f"""WITH {POINTS}, scaled AS (SELECT id, list_transform(v, lambda x: x * 3.0) AS v FROM points),
normal AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM scaled)
SELECT id, round(sqrt(list_dot_product(u, u)), 6) AS norm, {whole('u', 5)} AS unit FROM normal"""
ORACLES["cosine_distance"] = f"""WITH {POINTS}, d AS (
  SELECT a.id AS id_a, b.id AS id_b,
    1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) AS dist
  FROM points a JOIN points b ON b.id > a.id)
SELECT id_a, id_b, round(dist, 6) AS dist FROM d WHERE dist <= 0.66 OR id_b = id_a + 1"""


def pairs(eps: float, places: int) -> str:
    """Plain point pairs."""
    return f"""
SELECT a.id, count(*) AS n_near, round(greatest(min(1 - list_dot_product(a.u, b.u)), 0), {places}) AS nearest
FROM unit a JOIN unit b ON a.id <> b.id AND 1 - list_dot_product(a.u, b.u) <= {eps} GROUP BY a.id"""


ORACLES["eps_neighbours"] = f"WITH {POINTS}, {unit()} {pairs(0.66, 6)}"
ORACLES["core_flags"] = f"""WITH {POINTS}, {unit()}
SELECT a.id, count(*) AS n_neighbours, (count(*) >= 5)::INT AS is_core
FROM unit a JOIN unit b ON a.id = b.id OR 1 - list_dot_product(a.u, b.u) <= 0.66 GROUP BY a.id"""
ORACLES["dbscan"] = f"{EMBEDDED} SELECT id, cluster_id FROM labels"
ORACLES["dbscan_sweep"] = f"""WITH RECURSIVE {POINTS}, {labels([0.62, 0.66, 0.7], 5)}
SELECT eps, id, cluster_id FROM labels"""
ORACLES["embed_documents"] = f"""WITH {DOC_POINTS}
SELECT id AS doc_id, {whole('v', 4)} AS vec FROM doc_vectors"""
ORACLES["tf_neighbours"] = f"WITH {DOC_POINTS}, points AS (SELECT 0 AS scope, id, v FROM doc_vectors), {unit()} {pairs(0.01, 4)}"
ORACLES["term_neighbours"] = r"""
WITH counts AS (
  SELECT doc_id AS id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM documents)
  WHERE term <> '' GROUP BY ALL),
norms AS (SELECT id, sum(n * n) AS norm2 FROM counts GROUP BY id),
dots AS (SELECT a.id AS a, b.id AS b, sum(a.n * b.n) AS dot FROM counts a JOIN counts b ON a.term = b.term AND a.id <> b.id GROUP BY ALL),
near AS (
  SELECT a, 1 - dot / (sqrt(x.norm2) * sqrt(y.norm2)) AS dist FROM dots JOIN norms x ON x.id = a JOIN norms y ON y.id = b
  WHERE 1 - dot / (sqrt(x.norm2) * sqrt(y.norm2)) <= 0.1)
SELECT a AS id, count(*) AS n_near, round(greatest(min(dist), 0), 6) AS nearest FROM near GROUP BY a"""
ORACLES["cluster_chunks"] = f"""WITH RECURSIVE {DOC_POINTS},
points AS (
  SELECT (pos // ceil((SELECT count(*) FROM documents) / 4)::BIGINT)::INT AS scope, pos AS id, v
  FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM doc_vectors)),
{labels([0.01, 0.05], 3)}
SELECT scope AS chunk, eps, id, cluster_id FROM labels"""
ORACLES["missing_embedding"] = """
SELECT DISTINCT md5(text) AS text_key FROM documents
WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"""
ORACLES["cluster_splits"] = f"{CLUSTERS} SELECT {KEYS}, id, md5(paragraph) AS text_md5 FROM members"
ORACLES["cluster_size_between"] = f"{BOUNDED} SELECT {KEYS}, size FROM bounded"
ORACLES["collect_clusters"] = f"{BOUNDED} SELECT {KEYS}, size, paragraphs FROM bounded"
ORACLES["members_with_repeat"] = f"""{CLUSTERS},
firsts AS (SELECT {KEYS}, arg_min(paragraph, id) AS paragraph FROM members GROUP BY ALL)
SELECT {KEYS}, size + 1 AS size, paragraph || chr(10) || paragraphs AS paragraphs
FROM clusters JOIN firsts USING ({KEYS}) WHERE size + 1 > 2 AND size + 1 < 1000"""


def prompt_sql(template: str, **fields: str) -> str:
    import string

    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(quoted(literal))
        if field is not None:
            parts.append(fields["sample" if field == "0" else field])
    return " || ".join(parts)


PROMPT = prompt_sql(prompts.FINANCIAL, sample="sample")
ORACLES["build_prompt"] = f"{BOUNDED} SELECT {KEYS}, {PROMPT} AS prompt, md5({PROMPT}) AS prompt_hash FROM bounded"
ORACLES["response_join"] = "SELECT doc_id, quality::VARCHAR AS response FROM documents LEFT JOIN labels USING (doc_id)"
ORACLES["unanswered"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
ORACLES["parse_label"] = """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS plain,
       CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS unwrapped,
       CASE WHEN doc_id % 4 < 2 THEN 0.9::DOUBLE END AS confidence FROM documents"""
ORACLES["label_clusters"] = f"""{BOUNDED}
SELECT {KEYS}, size, json_extract_string({CLUSTER_REPLY}, '$.confidence')::DOUBLE AS confidence, paragraphs FROM bounded
WHERE CASE WHEN json_valid({CLUSTER_REPLY}) THEN json_extract_string({CLUSTER_REPLY}, '$.classification') = '1' ELSE false END"""
ORACLES["label_clusters_unwrap"] = f"{BOUNDED} SELECT {KEYS}, size FROM bounded WHERE cluster_id % 4 IN (0, 2)"
ORACLES["label_rejects"] = f"{BOUNDED} SELECT {KEYS}, {CLUSTER_REPLY} AS response FROM bounded WHERE cluster_id % 4 IN (2, 3)"
ORACLES["topic_clusters"] = f"{TOPICS} SELECT * FROM topics"
ORACLES["category_counts"] = f"""{TOPICS}
SELECT category, count(*) AS n_clusters, sum(size)::BIGINT AS n_paragraphs FROM topics GROUP BY category"""

# ---- tags -----------------------------------------------------------------------------------

ORACLES["taxonomy_tag"] = f"WITH {TAGGED} SELECT doc_id, pos, array_to_string(categories, '|') AS categories FROM tagged"
ORACLES["undisclosed_terms"] = f"""WITH {TERMS}
SELECT doc_id, pos, site, term FROM terms t
WHERE NOT EXISTS (SELECT 1 FROM terms s WHERE s.site = t.site AND s.doc_id % 2 = 0 AND lower(s.term) = lower(t.term))"""
PROFILE = ", ".join(f"count(*) FILTER (list_contains(categories, {quoted(c)})) AS \"{c}\"" for c in D.CATEGORIES)
SEEN = " + ".join(f"(\"{c}\" > 0)::INT" for c in D.CATEGORIES)
ORACLES["site_profile"] = f"""WITH {TAGGED}
SELECT *, ({SEEN})::INT AS n_categories
FROM (SELECT site AS url, count(*) AS n_paragraphs, count(*) FILTER (NOT list_contains(categories, 'Others')) AS n_tagged, {PROFILE}
      FROM tagged GROUP BY site)"""
ORACLES["parse_products"] = """
SELECT doc_id, (doc_id % 2)::VARCHAR AS is_payment_page, 'item ' || doc_id AS name, '$' || (doc_id % 50) || '.00' AS price,
       NULL::VARCHAR AS shipping_charge
FROM (SELECT doc_id, unnest(range(doc_id % 3)) FROM documents)
UNION ALL SELECT doc_id, (doc_id % 2)::VARCHAR, NULL, NULL, NULL FROM documents WHERE doc_id % 3 = 0"""
ORACLES["parse_annotation"] = """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Warranty' ELSE 'Warranty|Others' END AS topics,
       (doc_id % 3 % 2)::INT AS has_financial_term FROM documents"""

# ---- files and surfaces ---------------------------------------------------------------------

ORACLES["ranked_domains_csv"] = f"SELECT (page_id + 1)::INT AS rank, {HOST} AS domain FROM pages"
ORACLES["domain_jsonl"] = "SELECT url AS domain FROM pages"
ORACLES["shop_csv"] = f"SELECT {SCHEMELESS} AS domain FROM pages"
ORACLES["sites_json"] = f"""WITH {FUNNEL}
SELECT url, language, is_shopping, chunk, md5(html) AS html_md5 FROM inputs WHERE english AND is_shopping IS NOT NULL"""
ORACLES["parse_stats_file"] = f"WITH {FUNNEL_COUNTS} SELECT chunk, accessible, english, is_shopping, error_urls FROM counts"
ORACLES["sites_in_range"] = """
SELECT url, (page_id // 100 * 100)::INT AS start, (page_id // 100 * 100 + 100)::INT AS "end", md5(html) AS html_md5
FROM pages WHERE page_id >= 100 AND page_id < 300"""
ORACLES["stats_files"] = f"""WITH {FUNNEL_COUNTS}
SELECT chunk * 100 AS start, chunk * 100 + 100 AS "end", accessible, english, is_shopping, error_urls FROM counts"""
ORACLES["ranked_domains_zip"] = "SELECT p_partkey::INT AS rank, p_name AS domain FROM part"
ORACLES["first_n"] = "SELECT page_id, url FROM pages"
ORACLES["read_page_files"] = r"""
SELECT regexp_extract(url, '://([^/]+)', 1) AS url, 'p' || page_id AS page_key, md5(html) AS html_md5 FROM pages"""
ORACLES["stream_page_files"] = ORACLES["stream_sanitise_pages"]
ORACLES["cluster_maps"] = f"""{CLUSTERS}
SELECT {KEYS}, string_agg(paragraph, chr(10) ORDER BY id) AS paragraphs FROM members GROUP BY ALL"""
ORACLES["paragraph_csv"] = f"WITH {CLEAN} SELECT url, paragraph, 0 AS split FROM clean"
ORACLES["policy_page_files"] = rf"""{CRAWL}
SELECT seed, link, depth, replace(replace(link, 'https://', ''), '/', '_')[:255] AS slug, md5(html) AS html_md5
FROM walked JOIN pages ON page_id = regexp_extract(link, '/(\d+)$', 1)::BIGINT WHERE fetched AND english"""
ORACLES["cluster_files"] = f"{CLUSTERS} SELECT {KEYS}, id, paragraph FROM members"
ORACLES["labelled_files"] = f"{BOUNDED} SELECT {KEYS}, paragraphs FROM bounded WHERE cluster_id % 4 = 0"
ORACLES["embedding_cache"] = f"WITH {DOC_POINTS} SELECT id AS doc_id, {whole('v', 4)} AS vec FROM doc_vectors"
ORACLES["classify_with"] = f"""WITH {TERMS}
SELECT doc_id, pos, contains(term, 'thble')::INT AS classification, 0.5::DOUBLE AS confidence FROM terms"""
ORACLES["html_content_only"] = """
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'text/html; charset=utf-8' ELSE 'Text/HTML' END AS content_type
FROM pages WHERE page_id % 4 < 2"""
