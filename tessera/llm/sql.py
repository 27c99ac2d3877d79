"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force, round trips or held-out labels."""

ORACLE: dict[str, str] = {
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    # words and sets as the contract has them; plain pairs of documents that share a shingle; components by spreading the smallest id
    "op8_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, greatest(2, len(w) - 2))])) END AS s FROM words),
named AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS exemplar, s FROM sets),
one AS (SELECT doc_id, n, unnest(s) AS shingle FROM named WHERE doc_id = exemplar),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM named WHERE doc_id = exemplar
  UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id)
SELECT named.doc_id, n AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = named.exemplar) AS component_id, exemplar FROM named""",
}
