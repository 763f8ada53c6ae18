"""The same results as SQL over the test tables, where SQL can express them."""

from __future__ import annotations

from tradeledger.llm import secret_scan


def _revisits() -> str:
    """Brute force: every revisit looks at all responses of its URL."""
    canonical = r"""
        regexp_replace(regexp_replace(regexp_extract(lower(bare), '^[^/?]*'), ':(80|443)$', ''), '^www[.]', '')
        || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
        || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END"""
    day = 86400
    date = lambda t: f"strftime(make_timestamp(({t}) * 1000000), '%a, %d %b %Y %H:%M:%S GMT')"
    return rf"""
WITH bare AS (
  SELECT page_id, md5(html) AS digest, 1704067200 + page_id * 60 AS t,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages),
params AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=]*|fbclid|gclid|msclkid|ref|sessionid|phpsessid|jsessionid)(=|$)'))) AS params
  FROM bare),
page AS (SELECT page_id, digest, t, '"' || left(digest, 16) || '"' AS tag, {canonical} AS url FROM params),
asked AS (
  SELECT page_id, url, 1 AS n, t + {30 * day} AS asked_at, tag, NULL AS digest FROM page
  UNION ALL SELECT page_id, url, 2, t + {60 * day}, NULL, digest FROM page
  UNION ALL SELECT page_id, url, 3, t - {30 * day}, NULL, digest FROM page),
found AS (
  SELECT a.*, max(p.t) AS fetched_at FROM asked a LEFT JOIN page p ON p.url = a.url AND p.t < a.asked_at GROUP BY ALL),
source AS (
  SELECT f.*, p.page_id AS source_page, p.tag AS source_tag, p.digest AS source_digest,
         CASE WHEN p.page_id IS NULL THEN 'missing'
              WHEN f.tag <> p.tag OR f.digest <> p.digest THEN 'changed'
              WHEN f.tag = p.tag OR f.digest = p.digest THEN 'resolved' ELSE 'unchecked' END AS outcome
  FROM found f LEFT JOIN (SELECT url, t, arg_max(page_id, 'p' || page_id) AS page_id, arg_max(tag, 'p' || page_id) AS tag, arg_max(digest, 'p' || page_id) AS digest
                          FROM page GROUP BY url, t) p ON p.url = f.url AND p.t = f.fetched_at)
SELECT 'p' || page_id || '-' || n AS record_id, url, asked_at, 'p' || source_page || '-0' AS source_id, fetched_at, outcome,
  CASE WHEN outcome = 'resolved' AND n = 1 THEN 'content-type: text/html' || chr(10) || 'date: ' || {date('asked_at')} || chr(10) || 'etag: W/' || tag || chr(10) || 'cache-control: max-age=600'
       WHEN outcome = 'resolved' AND n = 2 THEN 'etag: ' || source_tag || chr(10) || 'content-type: text/html' || chr(10) || 'cache-control: max-age=60' || chr(10) || 'date: ' || {date('asked_at')}
       WHEN outcome = 'resolved' THEN 'etag: ' || source_tag || chr(10) || 'content-type: text/html' || chr(10) || 'cache-control: max-age=60' || chr(10) || 'date: ' || {date('asked_at')} || chr(10) || 'expires: 0'
       WHEN n = 1 THEN concat_ws(chr(10), 'date: ' || {date('asked_at')}, 'etag: W/' || tag, 'content-length: 0', 'cache-control: max-age=600')
       WHEN n = 2 THEN 'date: ' || {date('asked_at')}
       ELSE 'date: ' || {date('asked_at')} || chr(10) || 'expires: 0' END AS headers,
  coalesce(source_digest, digest) AS digest
FROM source"""


def _embeddings() -> str:
    """All pairs, and components by repeated steps along links."""
    return """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS e,
         coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS sound
  FROM embeddings),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.sound AND b.sound AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.x = vec_id LEFT JOIN counted ON counted.x = vec_id"""


def _divergence() -> str:
    """Every group's share of every kept term, term by term."""
    return r"""
WITH docs AS (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT n, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT n) >= 10),
v AS (SELECT lang, count(*) AS v, sum(c) AS total FROM kept GROUP BY lang),
uses AS (SELECT lang, source, term, count(*) AS c FROM words GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
grid AS (
  SELECT g.lang, g.source, k.term, k.c AS lang_c, coalesce(u.c, 0) AS c
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN uses u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
totals AS (SELECT lang, source, sum(c) AS total FROM grid GROUP BY lang, source),
shares AS (
  SELECT d.lang, d.source, d.term, d.c, CAST(1 + (1000000000 * (d.c + 2)) // (t.total + 2 * v.v) AS HUGEINT) AS p,
         CAST(1 + (1000000000 * (d.lang_c + 2)) // (v.total + 2 * v.v) AS HUGEINT) AS q
  FROM grid d JOIN totals t ON t.lang = d.lang AND t.source = d.source JOIN v ON v.lang = d.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
every_pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
ahead AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM every_pair
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM ahead)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


def _secrets() -> str:
    """Every rule over every text; what lies between the matches tells where they are."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    each = "\n  UNION ALL ".join(
        f"SELECT n, {k} AS k, {quoted(r.kind)} AS kind, {r.least} AS least, text, regexp_extract_all(text, {quoted(r.pattern)}, 0) AS hits, "
        f"regexp_extract_all(text, {quoted(r.pattern)}, {r.part}) AS parts, string_split_regex(text, {quoted(r.pattern)}) AS gaps FROM docs"
        for k, r in enumerate(secret_scan.RULES))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
matched AS (
  {each}),
one AS (SELECT n, k, kind, least, hits, parts, gaps, unnest(range(1, len(hits) + 1)) AS i FROM matched WHERE len(hits) > 0),
placed AS (
  SELECT n, k, kind, least, length(parts[i]) AS long, length(hits[i]) AS size,
         sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY n, k ORDER BY i) AS stop
  FROM one),
spans AS (SELECT n, k, kind, stop - size AS start, stop, kind || ':' || CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM placed WHERE long >= least),
found AS (
  SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, k) FILTER (k < {len(secret_scan.BASE)}) AS base, string_agg(span, ',' ORDER BY start, k) AS spans
  FROM spans GROUP BY n)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found ON found.n = docs.n"""


def sql() -> dict[str, str]:
    return {"op3_embeddings": _embeddings(), "op5_revisits": _revisits(), "op11_secrets": _secrets(), "op13_divergence": _divergence()}
