"""DuckDB SQL of the queries that it can express over whole tables."""

from __future__ import annotations

from feldspar.llm.quality_rules import STOP_FORMS

_STOP = ", ".join(f"'{w}'" for w in STOP_FORMS)

ORACLES: dict[str, str] = {
    "op1_quality_rules": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 l AS (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols FROM d),
 p AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM l),
 g AS (SELECT doc_id, i, a, lead(a) OVER v AS b, lead(a, 2) OVER v AS c FROM p WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
 n AS (SELECT doc_id, i, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS again FROM g),
 k AS (SELECT doc_id, i, again OR coalesce(lag(again) OVER v, false) OR coalesce(lag(again, 2) OVER v, false) AS hit FROM n WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
 r AS (SELECT doc_id, count(*) FILTER (hit) AS n_repeat_words FROM k GROUP BY 1),
 f AS (SELECT l.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop FROM l LEFT JOIN r USING (doc_id)),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.1 AND n_stop / n_words >= 0.06 AND n_dup_lines / n_lines <= 0.5 AND n_repeat_words / n_words <= 0.5 AS kept FROM b""",
    "op2_nearest": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
 SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
}
