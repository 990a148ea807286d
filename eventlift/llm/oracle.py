"""DuckDB twins of the operators that SQL can express."""

TOP_K = """
WITH parts AS (
  SELECT vec_id, len(embedding) AS dim, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place
  FROM embeddings WHERE vec_id IS NOT NULL
),
complete AS (
  SELECT vec_id FROM parts GROUP BY vec_id HAVING bool_and(coalesce(isfinite(x), false))
),
whole AS (
  SELECT vec_id, dim, place, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS w
  FROM parts WHERE vec_id IN (SELECT vec_id FROM complete)
),
scored AS (
  SELECT q.vec_id AS query_id, o.vec_id, CAST(sum(q.w * o.w) AS BIGINT) AS score
  FROM whole q JOIN whole o ON q.place = o.place AND q.dim = o.dim AND q.vec_id <> o.vec_id
  WHERE q.vec_id % 20 = 0
  GROUP BY q.vec_id, o.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score
FROM scored
QUALIFY rank <= 20
"""

ARCHIVE = """
WITH payloads AS (
  SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
),
placed AS (
  SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first_id
  FROM payloads
  WINDOW w AS (PARTITION BY payload ORDER BY page_id NULLS LAST, url NULLS LAST)
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '')
    AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first_id END AS refers_to
FROM placed
"""

#: A term is a run of characters that part no terms; only A-Z are folded.
RANKED = r"""
WITH occurrences AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term
  FROM documents
),
postings AS (
  SELECT doc_id, term, count(*) AS tf FROM occurrences GROUP BY ALL
),
lengths AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id
),
corpus AS (
  SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS words FROM lengths
),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(documents) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, corpus GROUP BY term
),
impacts AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * documents) // words)) AS impact
  FROM postings JOIN lengths USING (doc_id), corpus
),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term
    FROM benchmark)
  GROUP BY ALL
),
scored AS (
  SELECT item_id, doc_id, sum(times * w * impact)::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN impacts USING (term)
  GROUP BY ALL HAVING sum(times * w * impact) > 0
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored
QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {"op3_pivot_topk": TOP_K, "op11_lexical_search": RANKED, "op13_warc": ARCHIVE}
