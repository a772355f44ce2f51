"""DuckDB SQL for the registered queries over rules and plans."""

from __future__ import annotations

from linkforge.oracles import HREFS, clean, norm
from linkforge.oracles_state import _JAC, _TOK

ORACLES: dict[str, str] = {}
O = ORACLES

_SHOWN = "html"
for _tag in ("script", "style", "noscript"):
    _SHOWN = rf"regexp_replace({_SHOWN}, '(?is)<{_tag}\b.*?</{_tag}\s*>', ' ', 'g')"
O["q60_visible_text"] = f"SELECT page_id, {clean(f'''regexp_replace({_SHOWN}, '<[^>]+>', ' ', 'g')''')} AS plain FROM pages"
O["q60_names"] = """
WITH w AS (SELECT *, string_split(p_name || ' van ' || lower(p_brand), ' ') AS w FROM part)
SELECT p_partkey, p_name AS title, CASE WHEN p_size > 25 THEN array_to_string(list_transform(w, lambda x: CASE WHEN x = 'van' THEN x ELSE upper(x[1]) || x[2:] END), ' ') ELSE p_type END AS name,
  CASE WHEN p_size > 25 AND contains(p_name, ' ') THEN '"' || p_name || '"' WHEN p_size > 25 THEN p_name ELSE p_type END AS quoted FROM w"""
O["q60_aliases"] = "SELECT c_custkey, c_name AS name, lower(c_mktsegment) AS alias, true AS same, false AS other, true AS mentioned FROM customer"
_URL = "regexp_extract(url, '^(https?)', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path"
O["q61_url_forms"] = f"""
WITH p AS (SELECT page_id, url, {_URL} FROM pages), f AS (SELECT *, scheme || '://' || host AS root, regexp_replace(path, '[^/]*$', '') AS folder, unnest(['/root/x', 'a/b', '../up', '?q=2', '#f', '//h.example/x', 'mailto:a@b.c', '']) AS href FROM p)
SELECT page_id, href, CASE href WHEN '/root/x' THEN root || href WHEN 'a/b' THEN root || folder || href WHEN '../up' THEN root || regexp_replace(folder, '[^/]+/$', '') || 'up' WHEN '?q=2' THEN root || path || href
    WHEN '#f' THEN regexp_replace(url, '#.*$', '') || href WHEN '//h.example/x' THEN scheme || ':' || href WHEN '' THEN url ELSE href END AS target,
  nullif(regexp_extract(rtrim(path, '/'), '([^/]*)$', 1), '') AS last, regexp_matches(lower(host), '(^|[.])example[.](com|org)$') AS blocked FROM f"""
O["q61_link_predicates"] = f"""
WITH p AS (SELECT page_id, url, {_URL}, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages)
SELECT page_id, regexp_matches(lower(path), '/(installations?|artworks?)/') AS is_detail, true AS made_detail, rtrim(path, '/') = '' OR contains(rtrim(path, '/') || '/', '/archive/') AS is_discovery, true AS made_discovery,
  regexp_matches('&' || query, '&(page|paged)=[^&]') AS is_pagination, 'archive listing page' AS kind FROM p"""

O["q62_match_scores"] = f"""
WITH s AS (SELECT p_partkey, {_JAC(_TOK('p_name'), _TOK("p_name || ' ' || p_type"))} AS title, CASE WHEN p_size > 25 THEN 1.0::DOUBLE WHEN p_size > 10 THEN 0.0::DOUBLE END AS artist,
  {_JAC(_TOK('p_type'), _TOK("p_type || ' ' || p_name || ' ' || p_brand"))} AS description, p_partkey = p_size AS uid_match FROM part)
SELECT *, ((title < 0.75)::INT + coalesce(artist < 0.4, false)::INT + (description < 0.35)::INT + (NOT uid_match)::INT)::BIGINT AS n_warnings FROM s"""
O["q62_verify_rows"] = f"""
WITH f AS (SELECT {norm('p_name')} AS k, min(p_partkey) AS hit FROM part GROUP BY 1), m AS (SELECT p.*, CASE WHEN p_size > 20 THEN p_partkey ELSE hit END AS a FROM part p JOIN f ON k = {norm('p_name')}),
r AS (SELECT m.a, m.p_size > 20 AS uid_match, (h.p_size > 30)::INT AS images, (m.p_type <> h.p_type)::INT + (m.p_size <= 20)::INT AS w FROM m JOIN part h ON h.p_partkey = m.a)
SELECT a::VARCHAR AS archive_uid, CASE WHEN images > 0 THEN 'broken_link' WHEN NOT uid_match THEN 'likely_match' ELSE 'verified' END AS status, 1.0::DOUBLE AS title_score, uid_match, images::BIGINT AS images, w::BIGINT AS n_warnings,
  CASE WHEN images > 0 THEN 'http://i/' || a END AS hero_image_url, count(*) AS n FROM r GROUP BY ALL"""
O["q62_report_texts"] = """
SELECT c_custkey AS key, c_name || '+' || c_mktsegment AS value FROM customer
UNION ALL SELECT c_custkey, c_name || ' (credited) [' || printf('%.2f', c_nationkey / 100.0::DOUBLE) || '] | Bo (lead) [0.50]' FROM customer
UNION ALL SELECT c_nationkey, 'http://' || max(c_custkey) FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey"""
O["q62_lookup_counts"] = """
SELECT count(*) AS rows, count(*) AS hit_matches, count(*) FILTER (NOT (l_quantity > 25 AND s.p_partkey IS NOT NULL)) AS hit_title_matches
FROM lineitem JOIN part p ON p.p_partkey = l_partkey LEFT JOIN part s ON s.p_partkey = l_suppkey"""

O["q63_batch_manifest"] = """
WITH c AS (SELECT *, value > 90 AS done, event_type <> 'click' AS valid FROM events),
f AS (SELECT *, NOT done AND valid AND row_number() OVER (PARTITION BY user_id, event_type, valid AND NOT done ORDER BY event_id) = 1 AS ok FROM c),
w AS (SELECT *, coalesce(sum((NOT done)::INT) OVER p, 0) AS tried, coalesce(sum(ok::INT) OVER p, 0) AS made FROM f WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT * FROM w WHERE made < 2 AND tried < 3)
SELECT count(*) FILTER (NOT done) AS attempted, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT done AND NOT valid) AS failed, count(*) FILTER (done OR (valid AND NOT ok)) AS skipped,
  min(nullif(event_id, 0)) AS first_position, max(nullif(event_id, 0)) AS last_position, CASE WHEN count(*) FILTER (ok) >= 100 THEN 'completed' ELSE 'partial' END AS status FROM s"""
O["q63_first_preview"] = """
SELECT o_orderkey AS position FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderkey LIMIT 5) WHERE o_orderpriority > '2' ORDER BY o_orderkey LIMIT 1"""
O["q63_kind_and_status"] = "SELECT c_mktsegment AS contributor_kind, CASE WHEN c_acctbal > 0 THEN 'Approved' ELSE 'Needs review' END AS review_status, count(*) AS n FROM customer GROUP BY ALL"
O["q63_batch_catalog"] = """
SELECT 'batch' AS part, r_name || '|batch_' || r_regionkey AS key, (CASE r_regionkey WHEN 0 THEN 7 WHEN 1 THEN 5 WHEN 2 THEN 7 ELSE 0 END)::DOUBLE AS n FROM region
UNION ALL SELECT 'folder', r_name, round(0.02 * (r_regionkey + 1), 2)::DOUBLE FROM region"""

O["q64_filter_counts"] = """
SELECT name, query, count(*) FILTER ((query = '' OR contains(p_name, query)) AND CASE name WHEN 'all' THEN true WHEN 'ready' THEN p_size <= 25 WHEN 'attention' THEN p_size > 25 WHEN 'missing_hero' THEN p_size > 25 ELSE false END) AS n
FROM part, (SELECT unnest(['all', 'ready', 'attention', 'missing_hero', 'hero_review', 'missing_proof', 'duplicates', 'uncertain_names', 'unknown_kind']) AS name), (SELECT unnest(['', 'ring']) AS query) GROUP BY ALL"""
O["q64_sorted_top"] = """
WITH v AS (SELECT *, p_partkey::VARCHAR AS uid, CASE WHEN p_size > 25 THEN length(p_name) ELSE 0 END AS pr FROM part)
SELECT 'priority' AS sort, uid FROM (SELECT uid FROM v ORDER BY pr DESC, p_name, uid LIMIT 10) UNION ALL SELECT 'title', uid FROM (SELECT uid FROM v ORDER BY p_name, uid LIMIT 10)
UNION ALL SELECT 'contributor', uid FROM (SELECT uid FROM v ORDER BY p_brand, p_name, uid LIMIT 10)"""
O["q64_project_view"] = """
SELECT p_partkey::VARCHAR AS uid, p_name AS title, 'person' AS kind, CASE WHEN p_size > 25 THEN '' ELSE p_brand END AS hero, CASE WHEN p_size > 25 THEN 'hero_missing' ELSE '' END AS attention, p_size BETWEEN 5 AND 25 AS upload_ready,
  (CASE WHEN p_size < 5 THEN 100 ELSE 0 END + CASE WHEN p_size > 25 THEN 50 ELSE 0 END + CASE WHEN p_type = 'SMALL' AND p_size <= 25 THEN 1 ELSE 0 END)::BIGINT AS priority,
  concat_ws('|', CASE WHEN p_size > 25 THEN 'Hero Missing' END, CASE WHEN p_type = 'SMALL' THEN 'Honorarium Unknown' END) AS labels FROM part"""

O["q65_collected_results"] = """
WITH f AS (SELECT c_mktsegment, c_nationkey, min(c_custkey) AS k FROM customer GROUP BY ALL)
SELECT c_mktsegment, 'http://x/' || c_nationkey || '#' || k AS url FROM f QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY k) <= 10"""
O["q65_proposals"] = """
WITH e AS (SELECT *, CASE WHEN p_size > 10 THEN 'Made of ' || p_type || '. ' ELSE '' END || CASE WHEN p_size > 20 THEN 'Constructed ' || p_name || '. ' ELSE '' END || CASE WHEN p_size > 40 THEN 'A community of light.' ELSE 'Plain.' END AS e FROM part),
x AS (SELECT p_brand, p_partkey, 'contributor_website' AS field, 'http://p/' || p_partkey AS value, 0.9 AS confidence, 'directly_stated' AS classification, false AS review_required FROM e WHERE p_type = 'SMALL'
  UNION ALL SELECT p_brand, p_partkey, 'project_materials', p_type, 0.8, 'directly_stated', true FROM e WHERE p_size > 10
  UNION ALL SELECT p_brand, p_partkey, 'project_fabrication_methods', p_name, 0.75, 'directly_stated', true FROM e WHERE p_size > 20
  UNION ALL SELECT p_brand, p_partkey, 'project_tags', 'light||community', 0.62, 'strongly_inferred', true FROM e WHERE p_size > 40
  UNION ALL SELECT p_brand, p_partkey, 'why_it_mattered', e, 0.58, 'strongly_inferred', true FROM e WHERE p_size > 40)
SELECT p_brand, field, value, 'http://p/' || p_partkey AS url, confidence::DOUBLE AS confidence, classification, review_required FROM x QUALIFY row_number() OVER (PARTITION BY p_brand, field ORDER BY p_partkey) = 1"""
O["q65_proposal_overlay"] = """
WITH o AS (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END AS client_name, coalesce(m::VARCHAR, '') AS project_materials, (10 + (c_acctbal <= 0)::INT + (m IS NULL)::INT)::BIGINT AS n_open FROM customer LEFT JOIN o ON o_custkey = c_custkey"""
O["q65_identity_overlay"] = """
WITH o AS (SELECT CASE WHEN s_acctbal > 0 THEN s_suppkey::VARCHAR ELSE 's' || s_suppkey END AS k FROM supplier), n AS (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey::VARCHAR ELSE 's' || c_custkey END AS k, c_mktsegment FROM customer)
SELECT CASE WHEN n.k IS NULL THEN 'unresolved' ELSE 'resolved' END AS identity_status, coalesce(c_mktsegment, 'empty') AS credit_type, count(*) AS n FROM o FULL JOIN n ON o.k = n.k GROUP BY ALL"""
O["q65_resolved_credits"] = """
SELECT c_custkey AS key, CASE c_mktsegment WHEN 'BUILDING' THEN 'person' WHEN 'MACHINERY' THEN 'person_with_alias' WHEN 'HOUSEHOLD' THEN 'multi_person' WHEN 'FURNITURE' THEN 'empty' ELSE 'alias_or_unknown' END AS credit_type,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Ann Lee' WHEN 'MACHINERY' THEN 'Bo Diaz' WHEN 'HOUSEHOLD' THEN 'Ann Lee; Bo Diaz' END AS legal_name, CASE c_mktsegment WHEN 'MACHINERY' THEN 'Sparkle' WHEN 'AUTOMOBILE' THEN 'Sparkle' END AS alias_name,
  (CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 2 ELSE 0 END)::BIGINT AS n_people, CASE c_mktsegment WHEN 'FURNITURE' THEN 'unresolved' WHEN 'AUTOMOBILE' THEN 'needs_review' ELSE 'resolved' END AS identity_status FROM customer"""
O["q65_excerpts"] = """
SELECT p_partkey, CASE WHEN p_size > 25 THEN 'About ' || p_name || '! It is made of steel?' || CASE WHEN p_size > 40 THEN ' Built by many.' ELSE '' END
  ELSE 'Plain words here. It is made of steel? ' || CASE WHEN p_size > 40 THEN 'Built by many.' ELSE 'The end.' END END AS excerpt FROM part"""
O["q65_same_domain"] = f"""
WITH h AS (SELECT page_id, {_URL}, unnest({HREFS}) AS href, generate_subscripts({HREFS}, 1) AS pos FROM pages),
l AS (SELECT page_id, pos, CASE WHEN regexp_matches(href, '^https?://') THEN regexp_replace(href, '#.*$', '') ELSE scheme || '://' || host || regexp_replace(href, '#.*$', '') END AS url, host FROM h),
f AS (SELECT page_id, url, min(pos) AS pos FROM l WHERE lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) = lower(host) GROUP BY ALL)
SELECT page_id, url FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 3"""

_INGESTED = """
SELECT p_name || ' ' || p_partkey AS project_title, CASE WHEN p_size > 5 THEN p_partkey::VARCHAR ELSE '' END AS event_uid,
  CASE WHEN p_size > 45 THEN 'Di Ray' WHEN p_size > 20 THEN 'Ann Lee' WHEN p_size < 20 THEN 'Cy Fox' ELSE '' END AS contributor_name, CASE WHEN p_size = 20 THEN 'unknown' ELSE 'individual' END AS contributor_kind,
  CASE WHEN p_size > 30 THEN 'http://a/' || p_partkey WHEN p_size > 10 THEN 'http://v/' || p_partkey WHEN p_type = 'SMALL' THEN 'http://l/' || p_partkey ELSE '' END AS proof_external_url,
  CASE WHEN p_size > 35 THEN 'http://m/' || p_partkey WHEN p_size > 20 THEN 'http://i/' || p_partkey ELSE '' END AS hero_image_url, CASE WHEN p_size > 35 THEN 'medium' WHEN p_size > 20 THEN 'needs_review' ELSE '' END AS hero_image_confidence,
  CASE WHEN p_size > 10 THEN 'verified' ELSE 'documented' END AS verification_status, CASE WHEN p_size BETWEEN 16 AND 19 THEN 'full' ELSE '' END AS honorarium_status, p_type AS project_summary,
  concat_ws('|', CASE WHEN p_size <= 10 THEN 'missing_archive_cache' END, CASE WHEN p_size = 20 THEN 'contributor_kind_uncertain' END, CASE WHEN p_size NOT BETWEEN 16 AND 19 THEN 'honorarium_unknown' END, CASE WHEN p_size <= 20 THEN 'hero_missing' WHEN p_size <= 35 THEN 'hero_needs_review' END) AS review_flags,
  concat_ws('|', 'www', CASE WHEN p_size > 10 THEN 'verification' END, CASE WHEN p_size > 20 THEN 'archive_index' END, CASE WHEN p_size > 35 THEN 'image_manifest' END, CASE WHEN p_size < 20 THEN 'collector_export' END,
    CASE WHEN p_size > 45 THEN 'identity_report' ELSE 'identity_local_fallback' END, CASE WHEN p_size > 35 THEN 'hero:image_manifest' WHEN p_size > 20 THEN 'hero:archive_index' END) AS source_provenance FROM part"""
O["q66_ingest_rows"] = _INGESTED
O["q66_ingest_stats"] = f"""
SELECT count(*) AS source_rows, count(*) FILTER (event_uid <> '') AS uid_matches, count(*) FILTER (verification_status = 'verified') AS verification_matches, count(*) FILTER (contributor_name = 'Di Ray') AS identity_cache_matches,
  count(*) FILTER (contributor_kind = 'individual') AS resolved_people, count(*) FILTER (hero_image_url <> '') AS hero_images_found, count(*) FILTER (hero_image_url = '') AS rows_missing_hero,
  count(*) FILTER (proof_external_url <> '') AS proof_links_found, count(*) FILTER (contributor_name = '') AS rows_missing_primary_name FROM ({_INGESTED})"""
