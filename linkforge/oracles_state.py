"""DuckDB SQL for the registered queries over files, state tables and plans."""

from __future__ import annotations

from linkforge.oracles import HREFS, TITLE, TOKENS, near, norm, slug

ORACLES: dict[str, str] = {}
O = ORACLES

O["q18_key_title_lookup"] = f"""
WITH f AS (SELECT {norm('p_name')} AS k, min(p_partkey) AS hit FROM part GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(c.p_partkey, f.hit) AS hit_key, CASE WHEN c.p_partkey IS NOT NULL THEN 'uid' ELSE 'title' END AS hit_mode
FROM lineitem JOIN part p ON p.p_partkey = l_partkey LEFT JOIN part c ON c.p_partkey = l_orderkey LEFT JOIN f ON f.k = {norm('p.p_name')}"""
O["q40_manifest_tables"] = """
WITH n AS (SELECT user_id, count(*) AS now FROM events GROUP BY 1)
SELECT coalesce(c_custkey, user_id)::VARCHAR AS url, CASE WHEN c_custkey IS NULL THEN 'new' WHEN user_id IS NULL THEN 'removed' WHEN c_nationkey <> now THEN 'reordered' ELSE 'unchanged' END AS label
FROM customer FULL JOIN n ON c_custkey = user_id"""
O["q42_upsert_tables"] = """
WITH o AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
e AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT coalesce(user_id, o_custkey) AS user_id, coalesce(event_type, o_orderstatus) AS status, least(strftime(o_orderdate, '%Y-%m-%d'), strftime(ts, '%Y-%m-%d')) AS first_seen, o_orderpriority AS note FROM o FULL JOIN e ON user_id = o_custkey"""
O["q43_anti_insert_tables"] = """
WITH n AS (SELECT doc_id, CASE WHEN n_chars > 1000 THEN 1 WHEN n_chars < 100 THEN NULL ELSE 0 END AS quality FROM documents)
SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = n.doc_id AND l.quality IS NOT DISTINCT FROM n.quality)"""
_STATUS = "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'failed' END AS s FROM documents d LEFT JOIN labels l USING (doc_id)"
O["q45_resume_actions"] = f"""
WITH s AS ({_STATUS})
SELECT action, doc_id AS project_id FROM s, (SELECT unnest(['enrich_unprocessed', 'retry_failed', 're_enrich_all', 'resume']) AS action)
WHERE CASE action WHEN 'enrich_unprocessed' THEN s IS NULL WHEN 'retry_failed' THEN s = 'failed' WHEN 're_enrich_all' THEN true ELSE s IS NULL OR s = 'failed' END
QUALIFY row_number() OVER (PARTITION BY action ORDER BY doc_id) <= 60"""
O["q45_resume_counts"] = f"""
WITH s AS ({_STATUS}), l AS (SELECT CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'failed' END AS s FROM labels)
SELECT 'finished' AS action, count(*) FILTER (s IN ('approved', 'rejected', 'skipped')) AS n FROM l UNION ALL SELECT 'retry_failed', count(*) FILTER (s = 'failed') FROM s
UNION ALL SELECT 're_export_approved', count(*) FILTER (s = 'approved') FROM s UNION ALL SELECT 'reprocess_changed_rules', count(*) FILTER (s IS DISTINCT FROM 'approved') FROM s UNION ALL SELECT 'enrich_unprocessed', count(*) FILTER (s IS NULL) FROM s"""
O["q45_cached_customers"] = """
SELECT c_custkey AS key, CASE WHEN c_custkey IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-02-09' - INTERVAL 10 DAYS) THEN 'hit' ELSE 'miss' END AS state FROM customer"""
O["q51_page_readiness"] = f"""
WITH p AS (SELECT page_id, url, {TITLE} AS title FROM pages), d AS (SELECT doc_id, source, n_chars, {norm("string_split(text, chr(10))[1]")} AS k FROM documents),
f AS (SELECT k, min(doc_id) AS doc_id FROM d WHERE k <> '' GROUP BY k),
m AS (SELECT p.*, coalesce(d.doc_id, f.doc_id) AS hit, CASE WHEN d.doc_id IS NOT NULL THEN 'uid' WHEN f.doc_id IS NOT NULL THEN 'title' ELSE '' END AS mode FROM p LEFT JOIN d ON d.doc_id = p.page_id LEFT JOIN f ON f.k = {norm('p.title')}),
j AS (SELECT m.*, h.source, h.n_chars, l.doc_id AS has_label, l.quality, l.toxic, 'https://' || lower(regexp_extract(url, '^https?://([^/]*)', 1)) || regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/]*(.*)$', 1), '#.*$', ''), '[?]utm_source=[^&#]*$', '') AS link
  FROM m LEFT JOIN documents h ON h.doc_id = m.hit LEFT JOIN labels l ON l.doc_id = m.hit)
SELECT page_id, regexp_replace(link, '^https', regexp_extract(url, '^(https?)', 1)) AS url, {norm('title')} AS key, mode AS found_by, source,
  concat_ws('|', CASE WHEN hit IS NULL THEN 'missing_archive_cache' END, CASE WHEN quality = 0 THEN 'hero_needs_review' END, CASE WHEN toxic = 1 THEN 'identity_needs_review' END, CASE WHEN has_label IS NULL THEN 'honorarium_unknown' END) AS flags,
  (CASE WHEN title = '' THEN 100 ELSE 0 END + CASE WHEN coalesce(n_chars > 100, false) THEN 0 ELSE 50 END + CASE WHEN quality = 0 THEN 30 ELSE 0 END + CASE WHEN hit IS NULL THEN 10 ELSE 0 END
   + CASE WHEN hit IS NOT NULL AND has_label IS NULL THEN 1 ELSE 0 END)::BIGINT AS priority,
  title <> '' AND hit IS NOT NULL AND NOT coalesce(quality = 0, false) AND NOT coalesce(toxic = 1, false) AS upload_ready FROM j"""
O["q52_latest_status"] = """
WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, l_returnflag, nullif(o_custkey, 7) AS b, lower(o_orderstatus) AS dir FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
c AS (SELECT *, 1 AS part FROM r WHERE b IS NULL AND dir = 'f' UNION ALL SELECT *, 2 FROM r WHERE b = 5 AND dir = 'o')
SELECT l_partkey AS project_id, l_returnflag AS status FROM c QUALIFY row_number() OVER (PARTITION BY part, l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_returnflag DESC) = 1"""
O["q52_keyed_state"] = """
SELECT 'sources' AS part, coalesce(d.doc_id, l.doc_id) AS key, CASE WHEN l.doc_id IS NULL THEN '2024-03-01' ELSE '2024-01-01' END || '|' || CASE WHEN d.doc_id IS NULL THEN '2024-02-01' ELSE '2024-03-01' END AS value
FROM (SELECT doc_id FROM documents WHERE n_chars > 200) d FULL JOIN labels l USING (doc_id)
UNION ALL SELECT 'approvals', l.doc_id, '' FROM labels l JOIN documents d USING (doc_id) WHERE quality = (n_chars > 1000)::INT AND toxic = 0
UNION ALL SELECT 'completed', c_custkey, '' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"""
O["q52_canonical_upsert"] = """
WITH w AS (SELECT s_nationkey + 1 AS pos, max(s_suppkey) AS holder FROM supplier GROUP BY 1)
SELECT 'p' || p_partkey AS canonical_url, CASE WHEN holder IS NULL THEN p_partkey + 1 ELSE -(p_partkey + 1) END::BIGINT AS position, 't0' AS first_discovered_at, 't0' AS row_json FROM part LEFT JOIN w ON pos = p_partkey + 1
UNION ALL SELECT 's' || s_suppkey, CASE WHEN holder = s_suppkey THEN s_nationkey + 1 ELSE -(1000000000 + s_suppkey) END::BIGINT, 't1', 't1' FROM supplier JOIN w ON pos = s_nationkey + 1"""
O["q53_listing_files"] = f"""
SELECT 2019 AS year, p_name AS title, {norm('p_name')} AS normalized_title, p_type || ',' || chr(10) || p_brand AS description, p_partkey::VARCHAR AS uid, NULL::VARCHAR AS camp, p_brand AS address, NULL::VARCHAR AS artist_url FROM part"""
O["q53_csv_history"] = """
SELECT 'history' AS part, n_nationkey || '|' || n_name || '|a||b' AS value FROM nation, range(2)
UNION ALL SELECT 'state', n_nationkey || '|' || n_name || '|null' FROM nation WHERE n_nationkey > 3 UNION ALL SELECT 'batch', unnest(['batch_001', 'batch_002', '3'])"""
O["q54_json_sources"] = """
SELECT part, s_suppkey::VARCHAR AS uid, s_name AS title, CASE part WHEN 'index' THEN 'http://i/' || s_suppkey WHEN 'records' THEN 'http://i/' || s_suppkey WHEN 'images' THEN 'http://m/' || s_suppkey ELSE '2019|' || s_suppkey END AS more
FROM supplier, (SELECT unnest(['index', 'images', 'records', 'export None', 'export records', 'export items']) AS part)"""
O["q55_batch_records"] = """
WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)
SELECT CASE WHEN o_orderpriority LIKE '1%' THEN o_orderkey::VARCHAR WHEN o_orderpriority LIKE '2%' THEN 'http://o/' || o_orderkey ELSE 'record-' || n END AS project_id, row_number() OVER (ORDER BY n) AS batch_index FROM n WHERE o_orderstatus <> 'O'"""
O["q55_scrape_batch"] = """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, l_linestatus = 'F' AS done, l_returnflag <> 'A' AS valid FROM lineitem),
f AS (SELECT *, NOT done AND valid AND row_number() OVER (PARTITION BY l_orderkey, l_suppkey, valid AND NOT done ORDER BY i) = 1 AS ok FROM c),
w AS (SELECT *, coalesce(sum((NOT done)::INT) OVER p, 0) AS tried, coalesce(sum(ok::INT) OVER p, 0) AS made FROM f WINDOW p AS (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT l_orderkey AS source_id, CASE WHEN done OR (valid AND NOT ok) THEN 'skipped' WHEN ok THEN 'completed' ELSE 'failed' END AS outcome, count(*) AS n FROM w WHERE made < 2 AND tried < 3 GROUP BY ALL"""
_TOK = lambda x: f"list_distinct({TOKENS.format(norm(x))})"
_JAC = lambda a, b: f"round(len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))), 6)"
O["q56_similarity"] = f"""SELECT p_partkey, {_JAC(_TOK('p_name'), _TOK("p_type || ' ' || p_name || ' ' || p_type"))} AS score, 1.0::DOUBLE AS artist FROM part"""
O["q56_archive_records"] = f"""
WITH b AS (SELECT p_partkey, p_name AS title, {norm('p_name')} AS k, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS uid, 2 * least(3, p_size // 20) + (p_type <> 'ECONOMY')::INT + (p_size > 10)::INT + (p_size > 25)::INT AS r FROM part),
u AS (SELECT * FROM b WHERE uid <> '' QUALIFY row_number() OVER (PARTITION BY uid ORDER BY r DESC, p_partkey) = 1), o AS (SELECT * FROM b WHERE uid = '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY r DESC, p_partkey) = 1)
SELECT uid, title, p_partkey FROM u UNION ALL SELECT uid, title, p_partkey FROM o WHERE k NOT IN (SELECT k FROM u)"""
O["q56_targets"] = f"""
WITH a AS (SELECT s_nationkey::VARCHAR AS uid, arg_max(s_name, s_suppkey) AS title FROM supplier GROUP BY 1),
l AS (SELECT CASE WHEN c_acctbal > 0 THEN c_nationkey::VARCHAR END AS uid, c_mktsegment || ' ' || c_nationkey AS title, c_custkey FROM customer),
k AS (SELECT *, coalesce(uid, {norm('title')}) AS k FROM l QUALIFY row_number() OVER (PARTITION BY coalesce(uid, {norm('title')}) ORDER BY c_custkey) = 1)
SELECT uid, title, 'archive' AS source FROM a UNION ALL SELECT uid, title, 'listing' FROM k WHERE k NOT IN (SELECT uid FROM a)"""
O["q57_ranked_sources"] = f"""
WITH r AS (SELECT source, doc_id, CASE WHEN n_chars > 4000 THEN 'institutional' WHEN n_chars > 2000 THEN 'press' ELSE 'other' END AS source_type, CASE WHEN n_chars > 4000 THEN 3 WHEN n_chars > 2000 THEN 5 ELSE 8 END AS p,
  1 + (contains(lower(text), '2'))::INT + (contains(lower(text), 'festival'))::INT AS n, row_number() OVER () AS x FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p, doc_id) AS accepted FROM r WHERE n >= 2), b AS (SELECT *, ((10 - p) * 10 + 5 * n)::BIGINT AS relevance FROM a WHERE accepted <= 5)
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY relevance DESC, p, accepted) AS rank, relevance, source_type FROM b"""
O["q57_choose_hero"] = """
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'https://archive.example.org/' || p_partkey WHEN p_size > 30 THEN 'https://m.example/' || p_partkey WHEN p_size > 20 THEN 'https://x.example/' || p_partkey WHEN p_size > 10 THEN 'https://c.example/' || p_partkey ELSE '' END AS url,
  CASE WHEN p_size > 40 THEN 'p' WHEN p_size > 30 THEN 'q' WHEN p_size > 20 THEN 'r' WHEN p_size > 10 THEN 's' ELSE '' END AS page, CASE WHEN p_size > 47 THEN 'Bo' WHEN p_size > 40 THEN '' WHEN p_size > 30 THEN 'Ann' WHEN p_size > 20 THEN '' WHEN p_size > 10 THEN 'Cy' ELSE '' END AS credit,
  CASE WHEN p_size > 45 THEN 'high' WHEN p_size > 40 THEN 'needs_review' WHEN p_size > 30 THEN 'medium' WHEN p_size > 20 THEN 'needs_review' WHEN p_size > 10 THEN 'medium' ELSE '' END AS confidence,
  CASE WHEN p_size > 47 THEN '' WHEN p_size > 40 THEN 'hero_needs_review' WHEN p_size > 30 THEN '' WHEN p_size > 20 THEN 'hero_needs_review' WHEN p_size > 10 THEN '' ELSE 'hero_missing' END AS flags,
  CASE WHEN p_size > 40 THEN 'verification' WHEN p_size > 30 THEN 'image_manifest' WHEN p_size > 20 THEN 'archive_index' WHEN p_size > 10 THEN 'collector_export' ELSE '' END AS provenance FROM part"""
O["q57_capped_links"] = f"""
WITH f AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS k FROM customer GROUP BY ALL),
r AS (SELECT p_partkey, 5 * len(list_filter(['the', 'red', 'widget', 'and', 'small', 'ring'], lambda w: contains('http://x/' || {slug('p_name')}, w))) AS s FROM part)
SELECT 'first' AS part, k AS key, c_nationkey::BIGINT AS value FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY k) <= 3) UNION ALL SELECT 'ranked', p_partkey, s::BIGINT FROM r WHERE s > 0"""
O["q57_parsed_links"] = f"SELECT page_id AS page, replace(href, '&amp;', '&') AS href, count(*) AS n FROM (SELECT page_id, unnest({HREFS}) AS href FROM pages) GROUP BY ALL"
O["q58_view_counts"] = """
SELECT unnest(['hero_missing', 'alias_uncertain', 'duplicate_candidate', 'project_count', 'upload_ready_count', 'needs_attention_count', 'missing_proof_count', 'missing_hero_count', 'with_hero_image', 'with_address', 'with_contributor_display_name']) AS flag,
  unnest([count(*) FILTER (p_size > 25), count(*) FILTER (p_size > 40), count(*) FILTER (p_type = 'SMALL'), count(*), count(*) FILTER (p_size <= 25 AND p_type <> 'SMALL'), count(*) FILTER (p_size > 25 OR p_type = 'SMALL'), count(*) FILTER (p_size < 5),
    count(*) FILTER (p_size > 25), count(*) FILTER (p_size <= 25), 0, count(*)]) AS n FROM part"""
O["q58_facets_and_labels"] = """
SELECT p_brand AS k, count(*) AS n FROM part WHERE p_size <= 25 GROUP BY 1 UNION ALL SELECT 'kept', count(*) FILTER (p_size <= 25) FROM part UNION ALL SELECT 'skipped', count(*) FILTER (p_size > 25) FROM part"""
O["q58_promotion"] = """
WITH c AS (SELECT c_custkey, c_mktsegment AS m, CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END AS a, CASE WHEN c_nationkey > 9 THEN c_mktsegment ELSE '' END AS o FROM customer)
SELECT c_custkey, CASE WHEN m = 'BUILDING' AND a <> '' THEN 'person' WHEN m IN ('MACHINERY', 'HOUSEHOLD') AND o <> '' THEN 'organization' ELSE 'staging' END AS route,
  CASE WHEN m = 'MACHINERY' THEN coalesce(nullif(o, ''), a) ELSE coalesce(nullif(a, ''), o) END AS name FROM c"""
O["q58_identity_candidates"] = "SELECT c_custkey AS archive_uid, 'alias_or_unknown' AS credit_type FROM customer WHERE c_acctbal > 0 AND c_nationkey <= 12"
O["q59_values"] = """
WITH e AS (SELECT event_id, json_extract_string(props, '$.k')::INT AS k, value > 20 AS a, user_id > 50 AS b FROM events)
SELECT event_id, k, (1 + a::INT + (k IS NOT NULL)::INT) / 4.0::DOUBLE AS full, sha256('{"event_id":' || event_id || CASE WHEN b THEN ',"b":"[]"}' ELSE '}' END) AS hash FROM e"""
O["q59_robots"] = "SELECT url, NOT regexp_matches(url, '^https?://[^/]*[.]org/en/') AS allowed, count(*) AS n FROM pages GROUP BY ALL"
O["q35_link_routing"] = f"""
SELECT CASE WHEN regexp_matches(href, '^https?://') THEN 'external_website' ELSE 'internal_non_installation_link' END AS reason, count(*) AS n FROM (SELECT unnest({HREFS}) AS href FROM pages) GROUP BY 1"""
O["q46_search_queries"] = """
WITH q AS (SELECT c_custkey, ['"' || c_name || '" "Ann Lee"', '"' || c_name || '" Festival', '"' || c_name || '" Festival 2019', '"' || c_name || '" materials', '"' || c_name || '" fabrication', '"Ann Lee" Festival 2019', '"Ann Lee" Bo - Studio Festival', '"Ann Lee" kinetic installation',
  '"Ann Lee" artist Oakland', '"' || c_name || '" wood', 'site:x.example "' || c_name || '"'] AS q FROM customer)
SELECT c_custkey, generate_subscripts(q, 1) - 1 AS pos, unnest(q) AS query FROM q"""
