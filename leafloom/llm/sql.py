"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        split AS (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM docs),
        lines AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
        keyed AS (SELECT r, doc_id, line, pos, trim({LOWER.replace("coalesce(text, '')", "line")}, {SPACES}) AS key FROM lines),
        common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
        marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY r, doc_id""",
    "op6_exact_dedup": f"""
        WITH docs AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents),
        groups AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM docs GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM docs JOIN groups USING (text_sha256)""",
    "op12_divergence": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                             regexp_extract_all({LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
        words AS (SELECT r, lang, source, unnest(ts) AS term FROM docs),
        vocab AS (SELECT lang, term, count(*) AS n FROM words GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
        langs AS (SELECT lang, sum(n) AS n, count(*) AS v FROM vocab GROUP BY 1),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN vocab v ON w.lang = v.lang AND w.term = v.term GROUP BY 1, 2, 3),
        totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY 1, 2),
        dense AS (SELECT t.lang, t.source, v.term, coalesce(c.n, 0) AS c,
                         1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (t.n + l.v) AS p,
                         1 + (1000000000::hugeint * (v.n + 1)) // (l.n + l.v) AS q
                  FROM totals t JOIN langs l ON t.lang = l.lang JOIN vocab v ON v.lang = t.lang
                  LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = v.term),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
                 FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
                  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM dense WHERE c > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
                   FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value::bigint AS value, rank::int AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
