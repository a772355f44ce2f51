"""DuckDB SQL for the queries of this subpackage that SQL can express, over whole tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Distinct 5-word shingles of lower-cased texts, per table and id.
SHINGLES = rf"""
  SELECT DISTINCT {{key}}, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS s FROM (
    SELECT {{key}}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM (
      SELECT {{key}}, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM {{table}}) WHERE len(w) > 0)
"""

OP2 = f"""
WITH RECURSIVE s AS ({SHINGLES.format(key="doc_id", table="documents")}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(node, seen) AS (SELECT a, a FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
comp AS (SELECT node, min(seen) AS c FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON node = d.doc_id
"""


def _runs(tokens: str, length: int) -> str:
    """Tokens of each document (w) and the positions (gone) of those in a window that also starts earlier."""
    return f"""
toks AS (SELECT doc_id, {tokens} AS w FROM documents),
wins AS (SELECT doc_id, i, w[i:i + {length - 1}] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {length - 2})) AS i FROM toks WHERE len(w) >= {length})),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM wins) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + {length})) AS p FROM late) GROUP BY doc_id)"""


OP6 = rf"""
WITH {_runs(r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))", 3)},
every_line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT *, regexp_matches(l, '[^\x20\x09-\x0D]') AS full_line,
  sum(CASE WHEN regexp_matches(l, '[^\x20\x09-\x0D]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) AS p FROM every_line),
kept AS (SELECT n.doc_id, string_agg(l, chr(10) ORDER BY ln) AS t FROM numbered n LEFT JOIN gone g USING (doc_id)
  WHERE NOT (full_line AND list_contains(coalesce(gone, []), p)) GROUP BY n.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(t, '')) END AS text_sha256
FROM documents d JOIN toks USING (doc_id) LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP7 = f"""
WITH {_runs(WORDS, 20)}
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(coalesce(gone, []), x[2])), lambda x: x[1]), ' ')) AS kept_sha256
FROM toks LEFT JOIN gone USING (doc_id)
"""

OP3 = f"""
WITH d AS ({SHINGLES.format(key="doc_id", table="documents")}), b AS ({SHINGLES.format(key="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 4 * count(*) >= 3 * any_value(n_item)
"""

ORACLES: dict[str, str] = {"op2_minhash_near_dedup": OP2, "op3_decontamination": OP3, "op6_line_dedup": OP6, "op7_substring_dedup": OP7}
