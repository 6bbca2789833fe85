"""SQL for DuckDB that gives the same rows as the operators, by plain definitions: all windows, all pairs that share something."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"


def repeats(length: int = 100) -> str:
    """Operator 1: every window of bytes is numbered by (doc_id, start) among its equals; all but the first cover their bytes.

    A window is told by its MD5.
    """
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT rn, doc_id, i, b[i:i] AS byte, CASE WHEN i + {length - 1} <= n THEN md5(b[i:i + {length - 1}]) END AS w FROM (SELECT rn, doc_id, b, n, unnest(range(1, n + 1)) AS i FROM d)),
a AS (SELECT rn, i, byte, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM w),
c AS (SELECT rn, i, byte, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY rn ORDER BY i ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) = 1 AS gone FROM a),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rn ORDER BY i), false) AS opens FROM c),
r AS (SELECT rn, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, sha256(unhex(coalesce(string_agg(hex(byte), '' ORDER BY i) FILTER (NOT gone), ''))) AS kept FROM e GROUP BY rn)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_spans, 0) AS n_spans, coalesce(r.kept, sha256('')) AS kept_sha256 FROM d LEFT JOIN r USING (rn)"""


def links(words: int = 3, percent: int = 90) -> str:
    """Operator 3: pairs of different sets that share a shingle, counted, and the smallest id that their links reach."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lower}, {WORDS}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= {words} THEN list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
g AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS k, min(doc_id) AS least, any_value(s) AS s FROM s WHERE len(s) > 0 GROUP BY k),
x AS (SELECT least AS id, len(s) AS n, unnest(s) AS shingle FROM g),
p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.id < b.id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(id, to_id) AS (SELECT least, least FROM g UNION SELECT r.id, e.b FROM reach r JOIN e ON r.to_id = e.a),
c AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id FROM s LEFT JOIN g ON len(s.s) > 0 AND g.k = md5(array_to_string(list_sort(s.s), chr(10))) LEFT JOIN c ON g.least = c.id"""


def passages(length: int = 35) -> str:
    """Operator 8: every window of words is counted; those found twice cover their words."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
x AS (SELECT rn, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + {length - 1} <= len(w) THEN md5(array_to_string(w[i:i + {length - 1}], ' ')) END)) AS win FROM d),
n AS (SELECT rn, i, word, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM x),
c AS (SELECT rn, i, word, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY rn ORDER BY i ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) = 1 AS gone FROM n),
r AS (SELECT rn, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept FROM c GROUP BY rn)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.kept, sha256('')) AS kept_sha256 FROM d LEFT JOIN r USING (rn)"""


def neighbours(k: int = 10, every: int = 50, bits: int = 64) -> str:
    """Operator 9: each query against all rows, by the number of signs that differ, then by id."""
    return f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(range({bits}), lambda i: coalesce(list_sum(list_filter(embedding::DOUBLE[], lambda x, j: (j - 1) % {bits} = i)), 0) > 0) AS s FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, CAST(len(list_filter(list_zip(a.s, b.s), lambda z: z[1] <> z[2])) AS INT) AS distance FROM v a JOIN v b ON a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INT) AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= {k}"""


def all_of_them() -> dict[str, str]:
    return {"op1_suffix_array_dedup": repeats(), "op3_ngram_jaccard_join": links(), "op8_substring_dedup": passages(), "op9_exact_topk": neighbours()}
