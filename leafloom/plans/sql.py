"""DuckDB SQL that several queries share: derived tables as common table expressions."""

from leafloom.functions.text import SPACE, TOKEN

PAGES = "pages_ AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS page_no FROM documents)"

REVISED = f"""{PAGES},
parts_ AS (
  SELECT doc_id, page_no, 0 AS ord, CASE WHEN page_no % 5 = 0 THEN regexp_replace(text, '^\\S+', 'alterada') ELSE text END AS text FROM pages_ WHERE page_no % 7 <> 3
  UNION ALL
  SELECT doc_id, page_no, 1, 'pagina inserida ' || doc_id || ' ' || page_no FROM pages_ WHERE page_no % 7 <> 3 AND page_no % 11 = 5),
revised_ AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, ord) AS page_no, text FROM parts_)"""


def norm(column: str) -> str:
    return f"trim(regexp_replace({column}, '{SPACE}+', ' ', 'g'))"


def tokens(column: str) -> str:
    return f"regexp_extract_all({column}, '{TOKEN}')"


#: Longest common subsequence of page signatures, row by row, and the walk back from the end.
ANCHORS = f"""{REVISED},
a_ AS (SELECT doc_id, page_no, {norm('text')} AS norm FROM pages_),
b_ AS (SELECT doc_id, page_no, {norm('text')} AS norm FROM revised_),
la_ AS (SELECT doc_id, list(CASE WHEN length(norm) >= 8 THEN norm END ORDER BY page_no) AS a FROM a_ GROUP BY doc_id),
lb_ AS (SELECT doc_id, list(CASE WHEN length(norm) >= 8 THEN norm END ORDER BY page_no) AS b FROM b_ GROUP BY doc_id),
ab_ AS (SELECT doc_id, a, b FROM la_ JOIN lb_ USING (doc_id)),
dp_ AS (
  SELECT doc_id, 0::BIGINT AS i, list_transform(range(len(b) + 1), lambda x: 0::BIGINT) AS line FROM ab_
  UNION ALL
  SELECT dp_.doc_id, i + 1,
         list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j]),
                     lambda acc, x: list_append(acc, CASE WHEN a[i + 1] = b[x[1]] THEN line[x[1]] + 1 ELSE greatest(line[x[1] + 1], acc[x[1]]) END), [0::BIGINT])
  FROM dp_ JOIN ab_ USING (doc_id) WHERE i < len(a)),
mat_ AS (SELECT doc_id, list(line ORDER BY i) AS t FROM dp_ GROUP BY doc_id),
walk_ AS (
  SELECT doc_id, len(a)::BIGINT AS i, len(b)::BIGINT AS j, false AS hit FROM ab_
  UNION ALL
  SELECT doc_id,
         CASE WHEN coalesce(a[i] = b[j], false) OR t[i][j + 1] >= t[i + 1][j] THEN i - 1 ELSE i END,
         CASE WHEN coalesce(a[i] = b[j], false) THEN j - 1 WHEN t[i][j + 1] >= t[i + 1][j] THEN j ELSE j - 1 END,
         coalesce(a[i] = b[j], false)
  FROM walk_ JOIN ab_ USING (doc_id) JOIN mat_ USING (doc_id) WHERE i > 0 AND j > 0),
anchors_ AS (SELECT doc_id, i + 1 AS page_a, j + 1 AS page_b FROM walk_ WHERE hit)"""

ALIGNED = f"""{ANCHORS},
ga_ AS (SELECT a_.doc_id, page_no AS page_a, norm, x.page_a IS NOT NULL AS hit, count(x.page_a) OVER (PARTITION BY a_.doc_id ORDER BY page_no) AS gap
        FROM a_ LEFT JOIN anchors_ x ON a_.doc_id = x.doc_id AND page_no = x.page_a),
gb_ AS (SELECT b_.doc_id, page_no AS page_b, norm, x.page_b IS NOT NULL AS hit, count(x.page_b) OVER (PARTITION BY b_.doc_id ORDER BY page_no) AS gap
        FROM b_ LEFT JOIN anchors_ x ON b_.doc_id = x.doc_id AND page_no = x.page_b),
ia_ AS (SELECT *, CASE WHEN hit THEN 0 ELSE row_number() OVER (PARTITION BY doc_id, gap, hit ORDER BY page_a) END AS idx FROM ga_),
ib_ AS (SELECT *, CASE WHEN hit THEN 0 ELSE row_number() OVER (PARTITION BY doc_id, gap, hit ORDER BY page_b) END AS idx FROM gb_),
aligned_ AS (SELECT coalesce(ia_.doc_id, ib_.doc_id) AS doc_id, coalesce(ia_.gap, ib_.gap) AS gap, coalesce(ia_.idx, ib_.idx) AS idx, page_a, page_b, ia_.norm AS norm_a, ib_.norm AS norm_b
             FROM ia_ FULL JOIN ib_ ON ia_.doc_id = ib_.doc_id AND ia_.gap = ib_.gap AND ia_.idx = ib_.idx)"""

COMPARED = f"""{ALIGNED},
stat_ AS (SELECT *, CASE WHEN page_a IS NULL THEN 'added' WHEN page_b IS NULL THEN 'removed' WHEN norm_a = norm_b THEN 'unchanged' ELSE 'modified' END AS status FROM aligned_),
ta_ AS (SELECT doc_id, gap, idx, unnest({tokens('norm_a')}) AS token, unnest(range(len({tokens('norm_a')}))) AS ord FROM stat_ WHERE status = 'modified'),
tb_ AS (SELECT doc_id, gap, idx, unnest({tokens('norm_b')}) AS token, unnest(range(len({tokens('norm_b')}))) AS ord FROM stat_ WHERE status = 'modified'),
ca_ AS (SELECT doc_id, gap, idx, lower(token) AS key, count(*) AS n, min(ord) AS ord, arg_min(token, ord) AS token FROM ta_ GROUP BY ALL),
cb_ AS (SELECT doc_id, gap, idx, lower(token) AS key, count(*) AS n, min(ord) AS ord, arg_min(token, ord) AS token FROM tb_ GROUP BY ALL),
diff_ AS (SELECT coalesce(ca_.doc_id, cb_.doc_id) AS doc_id, coalesce(ca_.gap, cb_.gap) AS gap, coalesce(ca_.idx, cb_.idx) AS idx,
                 ca_.ord AS at_a, ca_.token AS token_a, cb_.ord AS at_b, cb_.token AS token_b,
                 greatest(coalesce(ca_.n, 0) - coalesce(cb_.n, 0), 0) AS less, greatest(coalesce(cb_.n, 0) - coalesce(ca_.n, 0), 0) AS more
          FROM ca_ FULL JOIN cb_ ON ca_.doc_id = cb_.doc_id AND ca_.gap = cb_.gap AND ca_.idx = cb_.idx AND ca_.key = cb_.key),
delta_ AS (SELECT doc_id, gap, idx, sum(more)::BIGINT AS added_words, sum(less)::BIGINT AS removed_words,
                  coalesce(array_to_string(flatten(list(list_transform(range(more), lambda x: token_b) ORDER BY at_b) FILTER (more > 0))[1:28], ' '), '') AS added_snippet,
                  coalesce(array_to_string(flatten(list(list_transform(range(less), lambda x: token_a) ORDER BY at_a) FILTER (less > 0))[1:28], ' '), '') AS removed_snippet
           FROM diff_ GROUP BY ALL),
wc_ AS (SELECT *, coalesce(len({tokens('norm_a')}), 0) AS words_a, coalesce(len({tokens('norm_b')}), 0) AS words_b FROM stat_),
compared_ AS (SELECT wc_.doc_id, wc_.gap, wc_.idx, status, page_a, page_b, words_a, words_b,
       CASE status WHEN 'added' THEN words_b ELSE coalesce(added_words, 0) END AS added_words,
       CASE status WHEN 'removed' THEN words_a ELSE coalesce(removed_words, 0) END AS removed_words,
       CASE status WHEN 'added' THEN array_to_string({tokens('norm_b')}[1:28], ' ') ELSE coalesce(added_snippet, '') END AS added_snippet,
       CASE status WHEN 'removed' THEN array_to_string({tokens('norm_a')}[1:28], ' ') ELSE coalesce(removed_snippet, '') END AS removed_snippet
FROM wc_ LEFT JOIN delta_ USING (doc_id, gap, idx))"""

PAYMENTS = """pay_ AS (SELECT 'pay-' || event_id AS payment_id, user_id, CASE WHEN value < 20 THEN 'month' ELSE 'year' END AS period,
  CASE WHEN event_id % 9 = 0 THEN 'rejected' ELSE 'approved' END AS status,
  CASE WHEN value < 20 THEN 19.90 ELSE 199.00 END::DECIMAL(10, 2) AS amount, ts + to_seconds(late) AS ts
  FROM (SELECT *, unnest(CASE WHEN event_id % 4 = 0 THEN [0, 3600] ELSE [0] END) AS late FROM events WHERE event_type = 'purchase'))"""

EDGES = """edges_ AS (SELECT k AS src, unnest(list_filter([CASE WHEN k % 7 <> 3 THEN 2 * k + 1 END, CASE WHEN k % 5 <> 2 THEN 2 * k + 2 END, CASE WHEN k % 9 = 0 THEN k // 2 END], lambda x: x IS NOT NULL AND x <= last)) AS dst
  FROM (SELECT p_partkey AS k, max(p_partkey) OVER () AS last FROM part))"""


def grid(name: str, pages: str) -> str:
    """The tokens of a table of pages on a grid."""
    return f"""{name} AS (SELECT doc_id, page_no, idx, text, (idx % 12) / 12.0::DOUBLE AS x, (idx // 12) / 60.0::DOUBLE AS y, 0.06::DOUBLE AS w, 0.012::DOUBLE AS h
  FROM (SELECT doc_id, page_no, unnest({tokens('text')}) AS text, unnest(range(len({tokens('text')}))) AS idx FROM {pages}))"""


WORDS = f"{PAGES}, {grid('words_', 'pages_')}"

REGIONS = """regions_ AS (SELECT doc_id, 1 AS page_no, 0.05::DOUBLE AS x, 0.0::DOUBLE AS y, unnest(CASE WHEN doc_id % 50 = 0 THEN [0.4, 0.0] ELSE [0.4] END)::DOUBLE AS w, 0.05::DOUBLE AS h
  FROM documents WHERE doc_id % 10 = 0)"""
