"""DuckDB SQL for the corpus queries that SQL can express over whole tables.

Trained models, pseudorandom permutations, tokenizers, automata and page layouts are
not among them; tests hold those queries against brute force.
"""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"


# Sets of shingles are compared by exact intersection counts; documents with one set are one node.
def _linked_sets(k: int, percent: int, more: str) -> str:
    shingle = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents
), runs AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: {shingle}) END) AS s FROM words
), shingles AS (SELECT DISTINCT doc_id, s FROM runs),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM shingles GROUP BY doc_id),
nodes AS (SELECT h, min(doc_id) AS id, min(n) AS n FROM sets GROUP BY h),
members AS (SELECT id, n, s FROM nodes JOIN shingles ON doc_id = id),
pairs AS (
  SELECT a.id AS a, b.id AS b FROM members a JOIN members b ON a.s = b.s AND a.id < b.id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(t.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id{more}
FROM documents d LEFT JOIN sets t USING (doc_id) LEFT JOIN nodes ON nodes.h = t.h LEFT JOIN component c ON c.id = nodes.id
"""


_NEAR_DEDUP = _linked_sets(4, 80, ", d.doc_id = coalesce(c.c, d.doc_id) AS kept")
_JACCARD = _linked_sets(3, 90, "")

#: The words of each window are aggregated over the word's row and the 49 after it.
_PASSAGES = rf"""
WITH words AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents)
), windows AS (
  SELECT doc_id, pos, w, count(*) OVER ahead = 50 AS whole, md5(string_agg(w, ' ') OVER ahead) AS h FROM words
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), least AS (SELECT h, min(doc_id) AS first FROM windows WHERE whole GROUP BY h HAVING min(doc_id) < max(doc_id)),
starts AS (SELECT doc_id, pos, w, coalesce(whole AND doc_id > first, false) AS again FROM windows LEFT JOIN least USING (h)),
covered AS (
  SELECT doc_id, pos, w, max(again::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM starts
), cut AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM covered GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN cut USING (doc_id)
"""

#: Five hex digits of the SHA-1 are four base32 digits.
_WARC = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT html, min(page_id) AS first FROM payloads GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM payloads JOIN first USING (html)
"""

#: All orders come from the masks of failed filters.
_AUDIT = rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
first AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY text),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM docs JOIN first USING (text) LEFT JOIN marks USING (doc_id)
), counters AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS bit,
    list_sum(list_transform(range(0, step), lambda i: CASE WHEN i = 0 THEN 0 ELSE 1 << (ascii(filter_order[i]) - 65) END)) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE mask & (bit | before::BIGINT) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before::BIGINT = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before::BIGINT <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before::BIGINT = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before::BIGINT = 0), 0)::BIGINT AS toxic_lost
  FROM counters, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": _NEAR_DEDUP,
    "op11_filter_audit": _AUDIT,
    "op12_jaccard_join": _JACCARD,
    "op4_substring_dedup": _PASSAGES,
    "op9_warc": _WARC,
}
