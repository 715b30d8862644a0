"""DuckDB SQL for the operators that SQL expresses: the same results by plainer, quadratic ways."""

from __future__ import annotations

from kestrion.llm import url_filter

_CLOSURE = """reach AS (SELECT {id} AS a, {id} AS b FROM {nodes} UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
components AS (SELECT a AS {id}, min(b) AS component_id FROM reach GROUP BY a)"""

OP1 = rf"""WITH RECURSIVE words AS (SELECT doc_id, text, [x for x in regexp_split_to_array(lower(text), '\s+') if x <> ''] AS w FROM documents WHERE doc_id IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0) x),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE k >= 0.8 * (p.n + q.n - k)
  UNION SELECT x.doc_id, y.doc_id FROM words x JOIN words y ON x.text = y.text),
classes AS (SELECT x.doc_id, min(coalesce(y.doc_id, x.doc_id)) AS class_id FROM words x LEFT JOIN words y ON x.text = y.text GROUP BY x.doc_id),
{_CLOSURE.format(id="doc_id", nodes="words")}
SELECT doc_id, class_id, component_id, doc_id = component_id AS kept FROM classes JOIN components USING (doc_id)"""

OP7 = r"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM texts WHERE len(w) > 7),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, hash(w[i : i + 7])) AS times FROM placed),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM windows WHERE times > 1) x GROUP BY doc_id),
lines AS (SELECT doc_id, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM texts),
counts AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, length(text) - length(replace(text, chr(10), '')) + 1 AS all_lines, w
  FROM texts JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR NOT (2 * n_words <= word_chars AND word_chars <= 15 * n_words) OR 10 * n_symbols > 3 * n_words
            OR (n_dup_lines > 3 AND 100 * n_dup_lines > 30 * all_lines) OR 100 * n_repeat_words > 20 * n_words
            OR 10 * len([x for x in w if regexp_matches(x, '\p{L}')]) < 7 * n_words
            OR 2 * len([x for x in w if length(x) > 1 AND regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}')]) > n_words
            OR (10 * len(list_distinct(w)) < n_words AND len(list_distinct(w)) < 100)) AS kept
FROM based"""

OP8 = f"""WITH RECURSIVE rows_of AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
sound AS (SELECT vec_id, v FROM rows_of WHERE len(v) > 0 AND len([x for x in v if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND list_max([abs(x) for x in v]) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
{_CLOSURE.format(id="vec_id", nodes="rows_of")},
degrees AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM components LEFT JOIN degrees USING (vec_id)"""


def _host(url: str) -> str:
    rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    return f"translate(regexp_extract(coalesce({rest}, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(url: str) -> str:
    rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    return f"regexp_extract(coalesce({rest}, ''), '^[^/?#]*([^?#]*)', 1)"


def _spread(name: str, edges: str, seeds: str) -> str:
    """PageRank's rounds one after the other, as written-out tables."""
    out = [f"{name}_own AS MATERIALIZED (SELECT host, {1 - url_filter.DAMPING} * mass AS r FROM {seeds})", f"{name}_0 AS MATERIALIZED (SELECT * FROM {name}_own)"]
    for k in range(url_filter.ROUNDS):
        out.append(
            f"{name}_{k + 1} AS MATERIALIZED (SELECT host, sum(r) AS r FROM (SELECT e.dst AS host, {url_filter.DAMPING} * p.r * e.share AS r FROM {edges} e JOIN {name}_{k} p ON p.host = e.src UNION ALL SELECT host, r FROM {name}_own) x GROUP BY host)"
        )
    out.append(f"{name} AS (SELECT host, x.r - coalesce(o.r, 0) AS reached FROM {name}_{url_filter.ROUNDS} x LEFT JOIN {name}_own o USING (host))")
    return ",\n".join(out)


def _op9() -> str:
    fits = {r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')" for r, _ in url_filter.RULES}
    ordered = sorted(url_filter.RULES, key=lambda x: (-len(x[0]), x[0]))
    rule = " ".join(f"WHEN {fits[r]} THEN '{r}'" for r, _ in ordered)
    verdict = " ".join(f"WHEN {fits[r]} THEN '{v}'" for r, v in ordered)
    href = url_filter._HREF.replace("'", "''")
    seed = "(SELECT host, {0}::DOUBLE / n / sum({0}::DOUBLE / n) OVER () AS mass FROM ruled WHERE {0} > 0)"
    return f"""WITH judged AS (SELECT page_id, html, host, path, CASE {rule} END AS rule, CASE {verdict} END AS ruled_verdict
  FROM (SELECT page_id, html, {_host("url")} AS host, {_path("url")} AS path FROM pages) x),
found AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1)) AS link FROM judged),
linked AS (SELECT src, {_host("'http://' || regexp_extract(link, '//(.*)', 1)")} AS dst FROM found),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM linked WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
ahead AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM edges),
back AS MATERIALIZED (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS share FROM edges),
ruled AS MATERIALIZED (SELECT host, count(*) AS n, count(*) FILTER (WHERE ruled_verdict = 'allow') AS good, count(*) FILTER (WHERE ruled_verdict = 'block') AS bad FROM judged WHERE host <> '' GROUP BY host),
{_spread("distrust", "back", seed.format("bad"))},
{_spread("trust", "ahead", seed.format("good"))},
blocked AS (SELECT host FROM distrust d LEFT JOIN trust t USING (host) WHERE d.reached >= {url_filter.LEAST} / (SELECT count(*) FROM ruled WHERE bad > 0) AND d.reached > coalesce(t.reached, 0) AND EXISTS (SELECT 1 FROM edges))
SELECT page_id, host, path, rule, coalesce(ruled_verdict, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM judged"""


#: For pages whose article is one <article> of paragraphs and headings, with the entities named here.
OP10 = r"""WITH articles AS (SELECT page_id, url, unnest(regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(?:p|h1)>')) AS raw,
         generate_subscripts(regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(?:p|h1)>'), 1) AS i FROM pages),
plain AS (SELECT page_id, i, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(raw, '</?b>', '', 'g'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp', '&') AS t FROM articles),
blocks AS (SELECT page_id, i, trim(regexp_replace(replace(t, '&;', '&'), '\s+', ' ', 'g')) AS t FROM plain),
texts AS (SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM blocks WHERE t <> '' GROUP BY page_id)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM pages LEFT JOIN texts USING (page_id)"""


SQL = {"op1_minhash": OP1, "op7_quality_rules": OP7, "op8_embedding_dedup": OP8, "op9_url_filter": _op9(), "op10_html_extract": OP10}
