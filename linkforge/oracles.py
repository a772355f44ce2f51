"""DuckDB SQL for the registered queries, on the same tables."""

from __future__ import annotations


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def slug(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


def clean(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def blank(x: str) -> str:
    return rf"nullif(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '')"


def cell(x: str) -> str:
    return f"CASE WHEN lower(trim(coalesce({x}, ''))) IN ('none', 'null', 'undefined', 'nan', '-') THEN '' ELSE trim(coalesce({x}, '')) END"


TITLE = rf"{clean(r'''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')}"
TOKENS = "list_filter(string_split({}, ' '), lambda w: w <> '')"
HREFS = r"""regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref="([^"]*)"', 1)"""

ORACLES: dict[str, str] = {}
O = ORACLES

O["q01_norm_title"] = f"SELECT page_id, {norm(TITLE)} AS key FROM pages"
O["q02_slug_part"] = f"""
SELECT p_partkey AS id, {slug('p_name')} AS slug, coalesce(nullif(left({slug('p_name')}, 12), ''), 'source') AS short FROM part
UNION ALL SELECT -s_suppkey, {slug('s_name')}, coalesce(nullif(left({slug('s_name')}, 12), ''), 'source') FROM supplier"""
O["q03_clean_whitespace"] = f"SELECT doc_id, {clean('text')} AS clean FROM documents"
O["q04_first_nonblank"] = f"""
SELECT doc_id, coalesce({blank("CASE WHEN quality = 1 THEN ' q' || toxic || ' ' END")}, {blank("CASE WHEN n_chars < 500 THEN '  ' END")}, {blank('source')}) AS picked
FROM documents LEFT JOIN labels USING (doc_id)"""
O["q05_clean_cell_literals"] = f"SELECT event_id, {cell('''CASE event_id % 5 WHEN 0 THEN ' NULL ' WHEN 1 THEN '-' ELSE ' ' || event_type END''')} AS cell FROM events"
O["q06_pipe_join"] = f"""
WITH p AS (SELECT p_partkey, unnest(list_concat(string_split_regex(p_brand || ';' || p_type, '[|;]+'), string_split_regex(p_brand, '[|;]+'), [p_size::VARCHAR, 'x|y', 'none', 'z'])) AS v,
  generate_subscripts(list_concat(string_split_regex(p_brand || ';' || p_type, '[|;]+'), string_split_regex(p_brand, '[|;]+'), [p_size::VARCHAR, 'x|y', 'none', 'z']), 1) AS i FROM part),
c AS (SELECT p_partkey, {cell('v')} AS v, min(i) AS i FROM p GROUP BY ALL HAVING v <> '')
SELECT p_partkey, string_agg(v, '|' ORDER BY i) AS joined FROM (SELECT p_partkey, v, min(i) AS i FROM c GROUP BY ALL) GROUP BY p_partkey"""
O["q07_jaccard_benchmark"] = f"""
WITH a AS (SELECT DISTINCT doc_id, unnest({TOKENS.format(norm("coalesce(text, '')"))}) AS w FROM documents), b AS (SELECT DISTINCT item_id, unnest({TOKENS.format(norm("coalesce(text, '')"))}) AS w FROM benchmark),
na AS (SELECT doc_id, count(*) n FROM a GROUP BY 1), nb AS (SELECT item_id, count(*) n FROM b GROUP BY 1),
k AS (SELECT doc_id, item_id, count(*) k FROM a JOIN b USING (w) GROUP BY ALL)
SELECT doc_id, item_id, round(k::DOUBLE / (na.n + nb.n - k), 6) AS score FROM k JOIN na USING (doc_id) JOIN nb USING (item_id) WHERE round(k::DOUBLE / (na.n + nb.n - k), 6) >= 0.3"""


def near(hay: str, needle: str) -> str:
    words = f"list_filter(string_split({norm(needle)}, ' '), lambda w: length(w) > 2)"
    h = f"regexp_replace(lower({hay}), '[^a-z0-9]+', ' ', 'g')"
    return f"(contains({h}, {norm(needle)}) OR (len({words}) > 1 AND len(list_filter({words}, lambda w: contains({h}, w))) >= greatest(2, len({words}) - 1)))"


O["q08_near_contains"] = f"""
SELECT doc_id, needle FROM documents, (SELECT unnest(['license version apache', 'general public license', 'all rights reserved', 'token']) AS needle) WHERE {near('text', 'needle')}"""
O["q09_identifiers"] = f"""
SELECT doc_id, concat_ws('|', CASE WHEN {near('text', "'general public license'")} THEN 'project title' END, CASE WHEN {near('text', 'source')} THEN 'contributor name' END,
  CASE WHEN {near('text', "'apache license'")} THEN 'collective name' END, CASE WHEN contains(lower(text), '2.0') THEN 'event year' END,
  CASE WHEN contains(lower(text), 'festival') THEN 'event reference' END, CASE WHEN {near('text', "'rights reserved'")} THEN 'materials' END) AS labels FROM documents"""
O["q10_tags_from_text"] = rf"""
SELECT doc_id, array_to_string(list_filter(['interactive', 'light', 'sound', 'temple', 'kinetic', 'community', 'solar'], lambda w: contains(lower(text), w))[1:5], '|') AS tags,
  nullif({clean(r"regexp_extract(text, '(?i)(?:materials?|made (?:from|of|with)|built (?:from|of|with))[:\s]+([^.;\n]{3,120})', 1)")}, '') AS materials FROM documents"""
O["q11_strip_html"] = f"SELECT page_id, {clean('''regexp_replace(html, '<[^>]+>', ' ', 'g')''')} AS plain FROM pages"
_URL = "'https://' || lower(regexp_extract(url, '^https?://([^/]*)', 1)) || regexp_extract(url, '^https?://[^/]*([^?#]*)', 1) || '?a=1&b=2&c=+y'"
O["q12_url_normalize"] = f"SELECT page_id, {_URL} AS url, {_URL} || '#part' AS candidate FROM pages"
_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1))"
O["q13_url_host_kind"] = f"""
SELECT page_id, {_HOST} AS host, CASE WHEN ends_with({_HOST}, 'example.org') THEN 'official' WHEN contains({_HOST}, 'publicartarchive.org') THEN 'public_art_archive'
  WHEN regexp_matches({_HOST}, 'museum|university|\\.edu|\\.org') THEN 'institutional' WHEN regexp_matches({_HOST}, 'kickstarter|indiegogo|gofundme') THEN 'crowdfunding'
  WHEN regexp_matches({_HOST}, 'instagram|facebook|twitter|x\\.com|youtube') THEN 'social' WHEN regexp_matches({_HOST}, 'news|magazine|journal|blog') THEN 'press' ELSE 'other' END AS kind,
  regexp_matches(url, '(?i)^https?://[^/?#]+') AS valid FROM pages"""
O["q13_url_host_kind"] = O["q13_url_host_kind"].replace("\\\\.", "\\.")
O["q14_sha_record_id"] = "SELECT page_id, left(sha256(url), 16) AS record_id FROM pages"
O["q14_url_parts"] = f"""
SELECT page_id, '2021' AS year, 'a2IZ9' AS uid, regexp_replace({_HOST}, '^www\\.', '') AS domain, regexp_matches(lower(url || '/2019/x?yyyy=2021#a2IZ9'), 'logo|favicon|avatar|profile|sprite|icon-|/icon') AS rejected,
  11::BIGINT AS n_site_urls FROM pages"""
O["q14_json_values"] = "SELECT event_id, json_extract_string(props, '$.k') AS k, strftime(ts, '%Y') AS year, try_cast(trim(json_extract_string(props, '$.k')) AS BIGINT) AS as_int FROM events"
O["q14_arrays"] = "SELECT vec_id, len(embedding)::BIGINT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, len(list_distinct(list_transform(embedding, lambda x: round(x::DOUBLE, 1)::FLOAT)))::BIGINT AS n_distinct FROM embeddings"

O["q15_first_wins_text"] = f"SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY {norm('''coalesce(text, '')''')}"
O["q16_last_wins_status"] = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
O["q17_best_by_rank"] = """
SELECT source, lang, doc_id, rank FROM (SELECT *, (coalesce(quality * 2, 0) + CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END)::BIGINT AS rank FROM documents LEFT JOIN labels USING (doc_id))
QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY rank DESC, doc_id) = 1"""
O["q17_people_merge"] = r"""
WITH n AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, ' ([A-Z][a-z]+)', 1)) AS name FROM conversations), m AS (SELECT conv_id, lower(name) AS k, max(turn) AS c FROM n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY c DESC, k) AS i FROM m)
SELECT conv_id, string_agg(k, '|' ORDER BY i) FILTER (i <= 3) AS top, count(*) AS n FROM r GROUP BY conv_id"""
O["q18_uid_title_fallback"] = f"""
WITH c AS (SELECT * FROM part WHERE p_partkey % 3 <> 0), f AS (SELECT {norm('p_name')} AS k, min(p_partkey) AS hit FROM c GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(c.p_partkey, f.hit) AS hit_key, CASE WHEN c.p_partkey IS NOT NULL THEN 'uid' WHEN f.hit IS NOT NULL THEN 'title' ELSE '' END AS hit_mode
FROM lineitem JOIN part p ON p.p_partkey = l_partkey LEFT JOIN c ON c.p_partkey = l_partkey LEFT JOIN f ON f.k = {norm('p.p_name')}"""
O["q19_conflict_veto"] = f"""
WITH g AS (SELECT {norm('p_name')} AS k, p_type, min(p_partkey) AS first, arg_min(p_brand, p_partkey) AS b, count(DISTINCT p_brand) > 1 AS veto FROM part GROUP BY ALL)
SELECT p.p_partkey, CASE WHEN NOT veto THEN first END AS hit_key, CASE WHEN NOT veto THEN 'title' ELSE '' END AS hit_mode FROM part p JOIN g ON g.k = {norm('p.p_name')} AND g.p_type = p.p_type"""
O["q20_five_way_merge"] = f"""
WITH o AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
l AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1), s AS (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS local FROM supplier GROUP BY 1)
SELECT c_custkey, coalesce({blank('u.s_name')}, {blank('s.local')}, {blank('n_name')}) AS picked,
  concat_ws('|', 'base', CASE WHEN o_orderkey IS NOT NULL THEN 'orders' END, CASE WHEN l_suppkey IS NOT NULL THEN 'lines' END, CASE WHEN n_name IS NOT NULL THEN 'nation' END, CASE WHEN local IS NOT NULL THEN 'local' END, CASE WHEN u.s_name IS NOT NULL THEN 'supplier' END) AS provenance
FROM customer c LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN s ON s.s_nationkey = c_nationkey LEFT JOIN supplier u ON u.s_suppkey = l_suppkey"""
O["q21_dup_flags"] = """
SELECT p_partkey, concat_ws('|', CASE WHEN row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) > 1 OR count(*) OVER (PARTITION BY p_name) > 1 THEN 'duplicate_candidate' END, CASE WHEN p_size > 40 THEN 'hero_missing' END) AS flags FROM part"""
O["q22_keyed_union"] = """
SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, 'supplier' AS src FROM supplier
UNION ALL SELECT c_custkey, c_name, c_nationkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)"""
_PROJ = f"SELECT p_partkey, trim(p_name) AS project_title, {slug('p_name')} AS project_slug, p_size::VARCHAR AS project_year, trim(p_brand) AS contributor_website, trim(p_type) AS status, 'n/a' AS note FROM part"
O["q23_schema_projection"] = _PROJ
_ERRORS = f"""
WITH r AS ({_PROJ})
SELECT p_partkey, 'project_title' AS field, unnest(['required value missing', 'must be non-empty']) AS message FROM r WHERE project_title = ''
UNION ALL SELECT p_partkey, 'project_slug', 'required value missing' FROM r WHERE project_slug = ''
UNION ALL SELECT p_partkey, 'project_slug', 'expected slug' FROM r WHERE NOT regexp_full_match(project_slug, '[a-z0-9]+(?:-[a-z0-9]+)*')
UNION ALL SELECT p_partkey, 'project_year', 'expected integer' FROM r WHERE project_year <> '' AND NOT regexp_full_match(project_year, '[0-9]+')
UNION ALL SELECT p_partkey, 'project_year', 'expected four-digit year or empty' FROM r WHERE project_year <> '' AND NOT regexp_full_match(project_year, '(19|20)[0-9][0-9]')
UNION ALL SELECT p_partkey, 'contributor_website', unnest(['expected absolute http(s) URL', 'expected absolute http(s) URL or empty']) FROM r WHERE contributor_website <> '' AND NOT regexp_matches(contributor_website, '^https?://[^/?#]+')
UNION ALL SELECT p_partkey, 'status', 'expected one of [''draft'', ''final'']' FROM r WHERE status <> '' AND status NOT IN ('draft', 'final')"""
O["q24_validation_errors"] = _ERRORS
O["q24_first_failures"] = f"SELECT p_partkey, count(*) AS n_errors FROM ({_ERRORS}) GROUP BY p_partkey ORDER BY p_partkey LIMIT 25"
_CONTRACT = rf"""
SELECT page_id, row_number() OVER (ORDER BY page_id) + 1 AS row_number, CASE page_id % 5 WHEN 0 THEN 'person' WHEN 1 THEN 'organization' WHEN 2 THEN 'collective' WHEN 3 THEN 'unknown' ELSE 'person' END AS contributor_kind,
  CASE WHEN page_id % 7 <> 0 THEN 'Name ' || page_id ELSE '' END AS name, page_id % 7 <> 0 AND regexp_matches(url, '(?i)^https?://[^/?#]+') AS linked, page_id % 3 = 0 AS flagged,
  page_id % 7 = 0 OR {TITLE} = '' AS untitled, url FROM pages"""
O["q25_contract_rows"] = f"""
SELECT row_number, contributor_kind, CASE WHEN contributor_kind = 'organization' THEN '' ELSE name END AS artist_name, CASE WHEN contributor_kind IN ('organization', 'collective') THEN name ELSE '' END AS organization_name,
  CASE WHEN linked THEN 'high' ELSE 'low' END AS proof_confidence, CASE WHEN flagged THEN 'Duplicate' WHEN NOT linked AND untitled THEN 'Needs better source' ELSE 'Needs review' END AS review_status,
  'Needs permission' AS permission_status, concat_ws(' | ', CASE WHEN flagged THEN 'collector_review_flags=duplicate_candidate' END, CASE WHEN contributor_kind = 'unknown' THEN 'Identity left unresolved for staging review.' END,
  CASE WHEN contributor_kind = 'collective' THEN 'Collective credit preserved; do not auto-create a person contributor.' END) AS import_notes, NOT (untitled AND name = '' AND NOT linked) AS accepted FROM ({_CONTRACT})"""
O["q25_accept_reject_split"] = f"""
SELECT count(*) AS rows, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected, count(*) FILTER ((contributor_kind IN ('organization', 'person')) AND name = '') AS with_warnings,
  count(*) FILTER (NOT flagged AND NOT (NOT linked AND untitled)) AS needs_review, count(*) FILTER (NOT linked) AS missing_proof, count(*) AS missing_image FROM (SELECT *, NOT (untitled AND name = '' AND NOT linked) AS ok FROM ({_CONTRACT}))"""
O["q26_enum_map"] = """
SELECT o_orderkey, 'unknown' AS kind, CASE WHEN lower(trim(string_split(o_orderpriority, '-')[2])) IN ('high', 'medium', 'low') THEN lower(trim(string_split(o_orderpriority, '-')[2])) ELSE '' END AS confidence FROM orders"""
O["q27_contract_detect"] = """
WITH v AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'csv_v1' WHEN 'O' THEN 'csv_v0' ELSE '' END AS v FROM orders)
SELECT coalesce((SELECT string_agg(DISTINCT v, '|' ORDER BY v) FROM v WHERE v <> ''), '') AS versions, count(*) FILTER (v = '') AS blanks, count(*) AS rows, count(DISTINCT nullif(v, '')) = 1 AND min(nullif(v, '')) = 'csv_v1' AND count(*) FILTER (v = '') = 0 AS is_contract FROM v"""
O["q28_flatten_row"] = "SELECT doc_id::VARCHAR AS doc_id, CASE WHEN quality = 1 THEN 'True' ELSE 'False' END AS good, printf('%.2f', doc_id / 7.0) AS score, 'a | b' AS warnings FROM labels"
O["q29_status_decision"] = """
WITH x AS (SELECT doc_id, (doc_id % 101) / 100.0::DOUBLE AS s, quality = 1 AS m, doc_id % 2 AS w, doc_id % 3 AS a, doc_id % 3 + doc_id % 2 AS i, coalesce(toxic = 1, false) AS r FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN s < 0.5 AND NOT coalesce(m, false) THEN 'conflict' WHEN a = 0 AND i > 0 THEN 'broken_link' WHEN w > 0 AND (coalesce(NOT m, false) OR s < 0.75) THEN 'likely_match'
  WHEN a > 0 AND s >= 0.75 THEN CASE WHEN r THEN 'verified' ELSE 'verified_online' END WHEN s >= 0.75 THEN 'verified' ELSE 'likely_match' END AS status FROM x"""
O["q30_status_summary"] = """
SELECT o_orderstatus AS verification_status, count(*) AS results, sum(o_orderkey % 7)::BIGINT AS images, sum(o_orderkey % 3)::BIGINT AS active, (sum(o_orderkey % 7) - sum(o_orderkey % 3))::BIGINT AS inactive FROM orders GROUP BY 1"""
O["q31_image_choice"] = rf"""
SELECT page_id, list_filter({HREFS}, lambda x: x <> '' AND NOT regexp_matches(lower(x), 'logo|favicon|avatar|profile|sprite|icon-|/icon'))[1] AS image, 'directly_stated' AS confidence FROM pages"""

_CREDIT = """CASE c_custkey % 6 WHEN 0 THEN 'Jane Doe aka Sparkle' WHEN 1 THEN 'The ' || upper(left(c_mktsegment, 1)) || lower(c_mktsegment[2:]) || ' Collective' WHEN 2 THEN 'Ann Lee and Bo Kim, Cy Roe'
  WHEN 3 THEN 'Max (Blaze) Power' WHEN 4 THEN 'Ada Lovelace' ELSE lower(c_mktsegment) END"""
O["q32_credit_class"] = f"""
WITH x AS (SELECT c_custkey, c_custkey % 6 AS n, {_CREDIT} AS credit FROM customer)
SELECT c_custkey, CASE n WHEN 0 THEN 'person_with_alias' WHEN 1 THEN 'collective' WHEN 2 THEN 'multi_person' WHEN 3 THEN 'person_with_alias' WHEN 4 THEN 'person' ELSE 'alias_or_unknown' END AS credit_type,
  CASE n WHEN 0 THEN 'Jane Doe' WHEN 2 THEN 'Ann Lee; Bo Kim; Cy Roe' WHEN 3 THEN 'Max Power' WHEN 4 THEN 'Ada Lovelace' END AS legal_name, CASE n WHEN 0 THEN 'Sparkle' WHEN 3 THEN 'Blaze' WHEN 5 THEN credit END AS alias_name,
  CASE n WHEN 0 THEN 'Jane Doe' WHEN 1 THEN '' WHEN 2 THEN 'Ann Lee|Bo Kim|Cy Roe' WHEN 3 THEN 'Max Power' ELSE credit END AS people, CASE n WHEN 0 THEN 'high' WHEN 3 THEN 'high' WHEN 5 THEN 'low' ELSE 'none' END AS confidence FROM x"""
O["q32_contributor_kind"] = """
SELECT c_custkey, CASE WHEN contains(' ' || lower(c_name || ' ' || c_mktsegment || ' works') || ' ', ' works') THEN 'studio' ELSE 'individual' END AS kind, 'org' AS side, upper(left(c_mktsegment, 1)) || lower(c_mktsegment[2:]) AS last FROM customer"""
O["q33_split_people"] = f"""
WITH x AS (SELECT c_custkey, c_custkey % 6 AS n, {_CREDIT} AS credit FROM customer)
SELECT c_custkey, CASE n WHEN 0 THEN credit WHEN 2 THEN 'Ann Lee|Bo Kim|Cy Roe' WHEN 1 THEN '' WHEN 5 THEN '' ELSE credit END AS people, CASE n WHEN 2 THEN 'Ann Lee|Bo Kim|Cy Roe' ELSE credit END AS names FROM x"""
O["q34_link_extract"] = f"SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest({HREFS}) AS href FROM pages) GROUP BY ALL"

O["q36_islands"] = """
WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, island, event_type, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM c) GROUP BY ALL"""
O["q37_lookahead_start"] = """
SELECT event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)
QUALIFY event_type NOT IN ('click', 'view') AND coalesce(max((event_type = 'click')::INT) OVER w, 0) = 1 AND coalesce(max((event_type = 'view')::INT) OVER w, 0) = 1"""
O["q38_inline_records"] = """
SELECT s_nationkey::BIGINT AS page_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS source_position, trim(s_name) AS title, 'Artist ' || s_suppkey AS artist_display_text, 'Town' AS artist_location, '2019' AS year,
  'Made of wood and light.' AS description, 'http://x.example/' || s_suppkey AS website_url, 'https://archive.example.org/archive/#a2I' || s_suppkey AS source_url, 'https://archive.example.org/i/' || s_suppkey || '.jpg' AS images, 'Photo' AS image_alt_text FROM supplier"""
O["q39_attempt_ceiling"] = """
SELECT o_custkey, o_orderkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
QUALIFY coalesce(count(*) FILTER (o_orderstatus = 'F') OVER w, 0) < 3 AND coalesce(count(*) FILTER (o_orderstatus <> 'P') OVER w, 0) < 4"""
O["q40_manifest_diff"] = """
WITH o AS (SELECT url, page_id AS was FROM pages WHERE page_id % 10 <> 3), n AS (SELECT url, CASE WHEN page_id % 9 = 0 THEN page_id + 1 ELSE page_id END AS now FROM pages WHERE page_id % 10 <> 7)
SELECT url, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'removed' WHEN was <> now THEN 'reordered' ELSE 'unchanged' END AS label FROM o FULL JOIN n USING (url)"""
O["q41_next_unprocessed"] = "SELECT min(o_orderkey) AS position FROM orders WHERE NOT (o_orderkey < 500 OR o_orderstatus = 'F')"
O["q42_upsert_keep_first_seen"] = """
WITH s AS (SELECT user_id, event_type, ts, event_id % 2 AS v FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, arg_max(event_type, v) AS status, min(ts) AS first_seen FROM s GROUP BY user_id"""
O["q43_anti_insert"] = """
WITH e AS (SELECT user_id, CASE WHEN event_type <> 'view' THEN event_type END AS event_type, event_id AS pos FROM events)
SELECT user_id, event_type, min(pos) AS pos FROM e n WHERE pos % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.pos % 3 = 0 AND o.user_id = n.user_id AND o.event_type IS NOT DISTINCT FROM n.event_type) GROUP BY ALL"""
O["q44_overlay_latest_change"] = """
WITH c AS (SELECT user_id, CASE WHEN event_type = 'click' THEN 'name' ELSE 'segment' END AS f, arg_max(CASE WHEN event_id % 4 <> 0 THEN 'v' || event_id ELSE '' END, event_id) AS v FROM events WHERE event_id % 3 <> 0 GROUP BY ALL)
SELECT c_custkey AS project_id, coalesce(a.v, c_name) AS name, coalesce(b.v, c_mktsegment) AS segment FROM customer LEFT JOIN c a ON a.user_id = c_custkey AND a.f = 'name' LEFT JOIN c b ON b.user_id = c_custkey AND b.f = 'segment'"""
O["q45_strict_majority"] = """
WITH c AS (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)
SELECT o_custkey, CASE WHEN 2 * max(n) > sum(n) THEN arg_max(s, n) END AS winner, max(n) AS votes, sum(n)::BIGINT AS total FROM c GROUP BY o_custkey"""
O["q45_resume_selection"] = "SELECT o_orderkey AS project_id FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 4 IN (1, 3) ORDER BY o_orderkey LIMIT 200"
O["q45_cached_search"] = """
WITH l AS (SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 0 AND ts >= TIMESTAMP '2024-02-01' - INTERVAL 10 DAYS)
SELECT user_id AS key, CASE WHEN user_id IN (SELECT user_id FROM l) THEN 'hit' ELSE 'miss' END AS state FROM (SELECT DISTINCT user_id FROM events)"""
O["q46_rank_top5"] = """
WITH r AS (SELECT source, doc_id, n_chars, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 5 END AS p FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p, n_chars DESC, doc_id) AS rank FROM r)
SELECT source, rank, doc_id, ((10 - p) * 10 + 10)::BIGINT AS relevance FROM k WHERE rank <= 5"""
O["q47_review_gate"] = """
SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_type <> 'click' AND event_id % 2 = 0 AND event_id % 3 = 0 AND 0.5 + (event_id % 50)::DOUBLE / 100 >= 0.85 THEN 'approved' ELSE 'unresolved' END AS status FROM events"""
O["q48_named_filter_search"] = "SELECT p_partkey::VARCHAR AS uid, p_name AS title FROM part WHERE p_size > 25 AND contains(lower(concat_ws(' ', p_name, p_partkey, '', p_brand, '', '')), 'brand#1')"
O["q49_export_by_keys"] = f"SELECT p_partkey::VARCHAR AS event_uid, {slug('p_name')} AS project_slug, p_name AS project_title FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)"
O["q50_facets"] = """
SELECT flag, count(*) AS n FROM (SELECT unnest([CASE WHEN quality IS NULL THEN 'missing_archive_cache' END, CASE WHEN toxic = 1 THEN 'identity_needs_review' END, CASE WHEN quality = 0 THEN 'hero_needs_review' END]) AS flag
FROM documents LEFT JOIN labels USING (doc_id)) WHERE flag IS NOT NULL GROUP BY flag"""
O["q50_priority"] = r"""
SELECT doc_id, (CASE WHEN trim(coalesce(text, '')) = '' THEN 100 ELSE 0 END + CASE WHEN n_chars > 100 THEN 0 ELSE 50 END + CASE WHEN toxic = 1 THEN 25 ELSE 0 END + CASE WHEN quality = 0 THEN 30 ELSE 0 END + CASE WHEN quality IS NULL THEN 1 ELSE 0 END)::BIGINT AS priority,
  trim(coalesce(text, '')) <> '' AND NOT coalesce(toxic = 1, false) AND NOT coalesce(quality = 0, false) AS ready FROM documents LEFT JOIN labels USING (doc_id)"""
O["q51_publish_readiness"] = f"""
WITH p AS (SELECT page_id, url, {TITLE} AS title FROM pages), d AS (SELECT doc_id, source, n_chars, {norm("string_split(text, chr(10))[1]")} AS k FROM documents WHERE doc_id % 4 <> 1),
f AS (SELECT k, min(doc_id) AS doc_id FROM d WHERE k <> '' GROUP BY k),
m AS (SELECT p.*, coalesce(d.doc_id, f.doc_id) AS hit, CASE WHEN d.doc_id IS NOT NULL THEN 'uid' WHEN f.doc_id IS NOT NULL THEN 'title' ELSE '' END AS mode FROM p LEFT JOIN d ON d.doc_id = p.page_id LEFT JOIN f ON f.k = {norm('p.title')}),
j AS (SELECT m.*, h.source, h.n_chars, l.doc_id AS has_label, l.quality, l.toxic, 'https://' || lower(regexp_extract(url, '^https?://([^/]*)', 1)) || regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/]*(.*)$', 1), '#.*$', ''), '[?]utm_source=[^&#]*$', '') AS link
  FROM m LEFT JOIN documents h ON h.doc_id = m.hit LEFT JOIN labels l ON l.doc_id = m.hit)
SELECT page_id, regexp_replace(link, '^https', regexp_extract(url, '^(https?)', 1)) AS url, {norm('title')} AS key, mode AS found_by, source,
  concat_ws('|', CASE WHEN hit IS NULL THEN 'missing_archive_cache' END, CASE WHEN quality = 0 THEN 'hero_needs_review' END, CASE WHEN toxic = 1 THEN 'identity_needs_review' END, CASE WHEN has_label IS NULL THEN 'honorarium_unknown' END) AS flags,
  (CASE WHEN title = '' THEN 100 ELSE 0 END + CASE WHEN coalesce(n_chars > 100, false) THEN 0 ELSE 50 END + CASE WHEN quality = 0 THEN 30 ELSE 0 END + CASE WHEN hit IS NULL THEN 10 ELSE 0 END
   + CASE WHEN hit IS NOT NULL AND has_label IS NULL THEN 1 ELSE 0 END)::BIGINT AS priority,
  title <> '' AND hit IS NOT NULL AND NOT coalesce(quality = 0, false) AND NOT coalesce(toxic = 1, false) AS upload_ready FROM j"""
