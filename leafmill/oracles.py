"""The registered queries as SQL, written apart from them, for comparison in another engine."""

from __future__ import annotations

LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"""
PAGES = LINES + """,
raw AS (SELECT doc_id, 1 + i // 5 AS page_number, string_agg(line, chr(10) ORDER BY i) AS t FROM lines GROUP BY ALL),
doc_pages AS (SELECT doc_id, page_number, CASE WHEN (doc_id * 7 + page_number * 3) % 11 < 3 THEN '' ELSE t END AS text,
  CASE WHEN (doc_id + page_number) % 13 = 0 THEN 792 ELSE 612 END AS width, CASE WHEN (doc_id + page_number) % 13 = 0 THEN 612 ELSE 792 END AS height,
  (doc_id * 31 + page_number * 17) % 67 AS rect_count,
  CASE WHEN (doc_id * 7 + page_number * 3) % 11 < 3 OR (doc_id * 13 + page_number * 5) % 6 = 0 THEN 1 ELSE 0 END AS image_count FROM raw)"""
PROFILES = PAGES + """,
dense AS (SELECT *, length(text) / (width * height) AS char_density, width > height AS is_landscape FROM doc_pages),
profiles AS (SELECT *, CASE WHEN char_density > 0.0005 THEN 'born_digital' ELSE 'scanned' END AS detected_origin,
  CASE WHEN width > height OR rect_count > 50 THEN 'STRATEGY_B' WHEN char_density > 0.0005 THEN 'STRATEGY_A' ELSE 'STRATEGY_C' END AS dominant_strategy,
  CASE WHEN width > height THEN 'Landscape orientation detected; likely wide tables/layout structures.' WHEN rect_count > 50 THEN 'High rect count indicates table/layout-heavy content.'
       WHEN char_density > 0.0005 THEN 'Sufficient text density for fast digital extraction.' WHEN char_density = 0 THEN 'No searchable text layer; use OCR/VLM pipeline.' ELSE 'No explicit rule matched; defaulting to OCR/Vision routing.' END AS reason FROM dense)"""
HINT = """CASE WHEN contains(lower({0}), 'bank') OR contains(lower({0}), 'licensed') OR contains(lower({0}), 'token') THEN 'Banking/Security'
  WHEN contains(lower({0}), 'rights') OR contains(lower({0}), 'und ') OR contains(lower({0}), 'les ') THEN 'Public_Sector' ELSE 'General' END"""
DOCS = PROFILES + """,
numbered AS (SELECT *, page_number - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM profiles),
picked AS (SELECT *, CASE WHEN n <= 6 THEN true
  WHEN list_contains(list_slice(range(0, n, n // 6), 1, 6), n - 1) THEN list_contains(list_slice(range(0, n, n // 6), 1, 6), i)
  ELSE i = n - 1 OR list_contains(list_slice(range(0, n, n // 6), 1, 5), i) END AS in_sample FROM numbered),
rolled AS (SELECT doc_id, count(*) AS total_pages, count_if(detected_origin = 'scanned') AS scanned_pages, avg(rect_count) AS avg_rects, count_if(is_landscape) AS wide,
  avg(CASE WHEN char_density > 0.0005 AND image_count > 0 THEN 1 ELSE 0 END) AS contradiction,
  bool_or(in_sample AND char_density > 0.0005) AND bool_or(in_sample AND char_density <= 0.0005 AND image_count > 0) AS mixed_mode,
  bool_or(contains(lower(text), '<form')) AS form, string_agg(text, chr(10) ORDER BY page_number) AS whole FROM picked GROUP BY doc_id),
judged AS (SELECT *, CASE WHEN scanned_pages > total_pages / 2 THEN 'scanned' ELSE 'born_digital' END AS overall_origin,
  CASE WHEN avg_rects >= 50 OR wide >= greatest(1, total_pages // 3) THEN 'High' WHEN avg_rects >= 10 THEN 'Medium' ELSE 'Low' END AS layout_complexity,
  """ + HINT.format("whole") + """ AS domain_hint FROM rolled),
sure AS (SELECT *, round(greatest(0.05, least(0.99, CASE WHEN overall_origin = 'scanned' AND scanned_pages / total_pages >= 0.8 THEN 0.94 ELSE 0.82 END
  - CASE WHEN mixed_mode THEN 0.18 ELSE 0 END - CASE WHEN contradiction >= 0.3 THEN 0.15 ELSE 0 END - CASE WHEN form THEN 0.05 ELSE 0 END))::DOUBLE, 6) AS triage_confidence,
  CASE WHEN mixed_mode THEN 'hybrid' WHEN overall_origin = 'scanned' THEN 'scanned_image' ELSE overall_origin END AS origin_type FROM judged),
docs AS (SELECT *, CASE WHEN overall_origin = 'scanned' OR layout_complexity = 'High' THEN 'HIGH'
  WHEN domain_hint <> 'General' OR layout_complexity = 'Medium' THEN CASE WHEN triage_confidence < 0.7 THEN 'HIGH' ELSE 'MEDIUM' END
  WHEN triage_confidence < 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS cost_tier FROM sure)"""
WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"
CLARITY = r"""CASE WHEN length(regexp_replace({0}, '\s+', '', 'g')) = 0 THEN 0.0 ELSE 0.7 * length(regexp_replace(regexp_replace({0}, '\s+', '', 'g'), '[^\p{{L}}\p{{N}}]', '', 'g')) / length(regexp_replace({0}, '\s+', '', 'g'))
  + 0.3 * least(1.0, length(regexp_replace({0}, '\s+', '', 'g')) / len(""" + WORDS + r""") / 5.0) END"""
HASH = r"sha256(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))) || '|p:' || {1} || '|bbox:0.00,0.00,1.00,1.00')"
UNITS = PAGES + """,
pl AS (SELECT doc_id, page_number, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM doc_pages),
units AS (SELECT doc_id, page_number, 'p' || page_number || '_' || n AS uid, content, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, 'p' || page_number || '_' || n) AS ord FROM pl WHERE trim(content) <> ''),
marked AS (SELECT *, contains(content, '#') OR contains(lower(content), 'table of contents') OR contains(lower(content), 'executive summary') OR contains(lower(content), 'appendix') AS is_boundary FROM units),
placed AS (SELECT *, coalesce(last_value(CASE WHEN is_boundary THEN left(trim(content), 200) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING), 'Document Root') AS section FROM marked)"""
PACKED = "WITH RECURSIVE " + UNITS + """,
split AS (SELECT doc_id, page_number, ord, section, is_boundary, trim(content) AS content, """ + WORDS.format("trim(content)") + """ AS w FROM placed),
pieces AS (SELECT doc_id, page_number, ord, section, is_boundary AND len(w) <= 60 AS boundary, unnest(range(0, (len(w) - 1) // 60 + 1)) AS piece, content, w FROM split),
cut AS (SELECT doc_id, page_number, ord, section, boundary, piece, CASE WHEN len(w) > 60 THEN array_to_string(list_slice(w, piece * 60 + 1, piece * 60 + 60), ' ') ELSE content END AS txt,
  CASE WHEN len(w) > 60 THEN len(list_slice(w, piece * 60 + 1, piece * 60 + 60)) ELSE len(w) END AS tokens FROM pieces),
seg AS (SELECT *, sum(boundary::INT) OVER (PARTITION BY doc_id ORDER BY ord, piece ROWS UNBOUNDED PRECEDING) AS segment FROM cut),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id, segment ORDER BY ord, piece) AS rn FROM seg),
walk AS (SELECT doc_id, segment, rn, tokens AS held, 0 AS pack FROM seq WHERE rn = 1
  UNION ALL SELECT s.doc_id, s.segment, s.rn, CASE WHEN w.held + s.tokens > 60 THEN s.tokens ELSE w.held + s.tokens END, CASE WHEN w.held + s.tokens > 60 THEN w.pack + 1 ELSE w.pack END
  FROM walk w JOIN seq s ON s.doc_id = w.doc_id AND s.segment = w.segment AND s.rn = w.rn + 1),
chunks AS (SELECT s.doc_id, s.segment, pack, string_agg(txt, chr(10) || chr(10) ORDER BY s.rn) AS content, list_sort(list_distinct(list(page_number))) AS pages, first(section ORDER BY s.rn) AS section, sum(tokens) AS tokens,
  FROM seq s JOIN walk w ON s.doc_id = w.doc_id AND s.segment = w.segment AND s.rn = w.rn GROUP BY s.doc_id, s.segment, pack),
chunk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY segment, pack) AS chunk_no, count(*) OVER (PARTITION BY doc_id) AS last_no FROM chunks)"""
MERGED = PACKED + """,
takes AS (SELECT doc_id, chunk_no, chunk_no AS merged_no, tokens < 12 AND chunk_no < last_no AS takes_next FROM chunk WHERE chunk_no = 1
  UNION ALL SELECT c.doc_id, c.chunk_no, CASE WHEN t.takes_next THEN t.merged_no ELSE c.chunk_no END, NOT t.takes_next AND c.tokens < 12 AND c.chunk_no < c.last_no
  FROM takes t JOIN chunk c ON c.doc_id = t.doc_id AND c.chunk_no = t.chunk_no + 1),
merged AS (SELECT c.doc_id, merged_no, count(*) AS parts, sum(tokens) AS tokens, first(section ORDER BY c.chunk_no) AS section, string_agg(content, chr(10) || chr(10) ORDER BY c.chunk_no) AS content, list_sort(list_distinct(flatten(list(pages)))) AS pages
  FROM chunk c JOIN takes t ON c.doc_id = t.doc_id AND c.chunk_no = t.chunk_no GROUP BY c.doc_id, merged_no)"""
HTML = r"""blocks AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?is)<(?:title|h1|p|li)\b[^>]*>.*?</(?:title|h1|p|li)>')) AS block,
  generate_subscripts(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?is)<(?:title|h1|p|li)\b[^>]*>.*?</(?:title|h1|p|li)>'), 1) - 1 AS n FROM pages),
html AS (SELECT page_id, n, lower(regexp_extract(block, '<([A-Za-z0-9]+)', 1)) AS tag, trim(regexp_replace(regexp_replace(block, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS content FROM blocks),
html_units AS (SELECT page_id, n, tag, CASE WHEN tag IN ('title', 'h1') THEN 'header' ELSE 'text' END AS unit_type, content FROM html WHERE content <> '')"""
SECTIONS = """base AS (SELECT r_name, n_name, c_mktsegment, r_name || ' > ' || n_name || ' > ' || c_mktsegment AS section_context, c_custkey % 40 + 1 AS page_number,
  'Customer ' || c_name || ' of ' || n_name || ' buys for ' || c_mktsegment || '.' AS content FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sc AS (SELECT *, """ + HASH.format("content", "page_number") + """ AS content_hash FROM base)"""
SLUG = "CASE WHEN regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN 'untitled' ELSE regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END"
NODES = SECTIONS + f""",
named AS (SELECT *, {SLUG.format('r_name')} AS s1, {SLUG.format('n_name')} AS s2, {SLUG.format('c_mktsegment')} AS s3 FROM sc),
levels AS (SELECT s1 AS node_id, 'root' AS parent_id, 0 AS depth, r_name AS title, page_number FROM named
  UNION ALL SELECT s1 || '/' || s2, s1, 1, n_name, page_number FROM named UNION ALL SELECT s1 || '/' || s2 || '/' || s3, s1 || '/' || s2, 2, c_mktsegment, page_number FROM named),
nodes AS (SELECT node_id, parent_id, depth, CASE WHEN depth = 0 THEN 'section' ELSE 'subsection' END AS node_type, min(title) AS title, min(page_number) AS min_page, max(page_number) AS max_page, count(*) AS chunk_count, count(DISTINCT page_number) AS pages_covered
  FROM levels GROUP BY node_id, parent_id, depth)"""
#: Nodes with their numbers among siblings from the top; `by` tells trees apart.
PLACES = NODES.split("nodes AS (SELECT")[0].replace("page_number FROM named", "page_number, c_mktsegment, (page_number, section_context, content_hash) AS first FROM named").replace("{", "{{").replace("}", "}}") + """
tn AS (SELECT {doc}node_id, parent_id, depth, arg_min(title, first) AS title, min(first) AS first, count(*) AS chunk_count, count(DISTINCT page_number) AS pages_covered FROM levels GROUP BY {doc}node_id, parent_id, depth),
numbered AS (SELECT *, row_number() OVER (PARTITION BY {by}, parent_id ORDER BY first, node_id) AS k, {by} AS tree FROM tn),
places AS (SELECT a.*, a.k::VARCHAR AS place FROM numbered a WHERE depth = 0 UNION ALL SELECT b.*, a.k || '.' || b.k FROM numbered b JOIN numbered a ON a.node_id = b.parent_id AND a.tree = b.tree WHERE b.depth = 1
  UNION ALL SELECT c.*, a.k || '.' || b.k || '.' || c.k FROM numbered c JOIN numbered b ON b.node_id = c.parent_id AND b.tree = c.tree JOIN numbered a ON a.node_id = b.parent_id AND a.tree = b.tree WHERE c.depth = 2)"""
FACTS = r"""fc AS (SELECT 'Flag ' || l_returnflag AS entity, l_linenumber AS page_number, 'Order ' || l_orderkey || ' shipped in ' || year(l_shipdate) || ' for $' || l_extendedprice::DECIMAL(14,2) || ' at ' || round(l_discount * 100)::INT || '% discount.' AS content FROM lineitem),
fh AS (SELECT *, """ + HASH.format("content", "page_number") + r""" AS content_hash FROM fc),
document_facts AS (SELECT 'currency_amount' AS fact_key, unnest(regexp_extract_all(content, '(?i)(?:\$|USD\s?)\d[\d,]*(?:\.\d+)?')) AS fact_value, entity, content_hash, page_number FROM fh
  UNION ALL SELECT 'percentage', unnest(regexp_extract_all(content, '\b\d+(?:\.\d+)?%')), entity, content_hash, page_number FROM fh
  UNION ALL SELECT 'year', unnest(regexp_extract_all(content, '\b(?:19|20)\d{2}\b')), entity, content_hash, page_number FROM fh)"""
ATTEMPTS = """ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
attempts AS (SELECT user_id AS file_id, k // 3 + 1 AS page_number, k % 3 + 1 AS attempt_no, CASE k % 3 WHEN 0 THEN 'STRATEGY_A' WHEN 1 THEN 'STRATEGY_B' ELSE 'STRATEGY_C' END AS strategy,
  CASE WHEN event_type = 'error' THEN 'fail' ELSE 'success' END AS status, abs(value) AS processing_time_ms, abs(value) % 1000 / 1000 AS confidence, abs(value) / 1000 AS cost FROM ev)"""
TRIED = ATTEMPTS + """,
tried AS (SELECT a.* FROM attempts a LEFT JOIN (SELECT file_id, page_number, min(attempt_no) AS ok FROM attempts WHERE status = 'success' GROUP BY ALL) f USING (file_id, page_number) WHERE ok IS NULL OR attempt_no <= ok)"""
RESULT_COLUMNS = """file_id, page_number, max(attempt_no) AS attempts, arg_max(strategy, attempt_no) AS final_strategy, arg_max(status, attempt_no) AS final_status, round(sum(cost::DECIMAL(20,9)), 6)::DOUBLE AS total_cost, round(sum(processing_time_ms::DECIMAL(20,9)), 3)::DOUBLE AS total_time_ms,
  round(coalesce(arg_max(cost::DECIMAL(20,9), attempt_no) FILTER (WHERE status = 'success'), 0), 6)::DOUBLE AS last_success_cost, round(coalesce(arg_max(cost::DECIMAL(20,9), attempt_no) FILTER (WHERE status = 'success' AND strategy = 'STRATEGY_C'), 0), 6)::DOUBLE AS last_vlm_cost,
  'born_digital -> ' || string_agg(replace(strategy, 'STRATEGY_', 'Strategy ') || CASE WHEN status = 'fail' THEN ' (Fail)' ELSE ' (Success)' END, ' -> ' ORDER BY attempt_no) AS escalation_path"""
RESULTS = TRIED + f""",
results AS (SELECT {RESULT_COLUMNS} FROM tried GROUP BY file_id, page_number)"""
TOTALS = RESULTS + """,
totals AS (SELECT file_id, count(*) AS pages, sum(attempts)::BIGINT AS attempts, count_if(attempts > 1) AS escalated_pages, count_if(final_status = 'fail') AS failed_pages, round(sum(total_cost::DECIMAL(20,6)), 4)::DOUBLE AS total_cost, round(sum(total_time_ms::DECIMAL(20,3)), 1)::DOUBLE AS total_time_ms FROM results GROUP BY file_id)"""
BUDGET = TRIED + """,
spent AS (SELECT *, coalesce(sum(CASE WHEN strategy = 'STRATEGY_C' THEN cost::DECIMAL(20,9) ELSE 0 END) OVER (PARTITION BY file_id ORDER BY page_number, attempt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM tried),
made AS (SELECT file_id, page_number, attempt_no, strategy, strategy = 'STRATEGY_C' AND b >= 0.05 AS skipped, b::DOUBLE AS spend_before, CASE WHEN strategy = 'STRATEGY_C' AND b >= 0.05 THEN 'fail' ELSE status END AS status,
  CASE WHEN strategy = 'STRATEGY_C' AND b >= 0.05 THEN 0 ELSE cost END AS cost, CASE WHEN strategy = 'STRATEGY_C' AND b >= 0.05 THEN 0 ELSE processing_time_ms END AS processing_time_ms FROM spent)"""
ORDER_UNITS = """ou AS (SELECT o_orderkey AS doc_id, 'a' AS uid, 'header' AS unit_type, 'Order ' || o_orderkey AS content, 0 AS n FROM orders
  UNION ALL SELECT o_orderkey, 'b', 'text', 'Status ' || o_orderstatus || ' priority ' || o_orderpriority, 0 FROM orders
  UNION ALL SELECT l_orderkey, 'c' || l_linenumber, 'table', '| ' || l_partkey || ' | ' || l_quantity::BIGINT || ' |', l_linenumber FROM lineitem),
oi AS (SELECT *, row_number() OVER w AS ord, CASE WHEN unit_type = 'table' AND lag(unit_type) OVER w = 'table' THEN 0 ELSE 1 END AS starts FROM ou WINDOW w AS (PARTITION BY doc_id ORDER BY uid, content)),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS island FROM oi)"""
PLAN = PAGES + """,
totals AS (SELECT doc_id, count(*)::INT AS total_pages FROM doc_pages GROUP BY doc_id),
claimed AS (SELECT doc_id, (page_number * (doc_id % 3 + 1) - 1)::INT AS page_number FROM doc_pages WHERE doc_id % 4 <> 0),
valid AS (SELECT c.doc_id, page_number, row_number() OVER (PARTITION BY c.doc_id ORDER BY page_number) - 1 AS place FROM claimed c JOIN totals t ON t.doc_id = c.doc_id WHERE page_number BETWEEN 1 AND total_pages),
planned AS (SELECT doc_id, place, page_number FROM valid WHERE place < 3
  UNION ALL SELECT doc_id, p - 1, p FROM (SELECT doc_id, unnest(range(1, least(total_pages, 3) + 1)) AS p FROM totals WHERE doc_id NOT IN (SELECT doc_id FROM valid)))"""
TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
DISTANCE = "list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: pow(e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2)))"

#: Judged pages, of `judging`: pages with a `strategy` each.
JUDGED = f"""pl AS (SELECT doc_id, page_number, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM doc_pages), un AS (SELECT *, 'p' || page_number || '_' || n AS uid, CASE length(content) % 7 WHEN 3 THEN 'table' WHEN 4 THEN 'figure' ELSE 'text' END AS unit_type FROM pl WHERE trim(content, ' ') <> ''), ag AS (SELECT doc_id, page_number, count(*) AS n_units, count_if(unit_type = 'table') AS tables, count_if(unit_type = 'text') AS texts, coalesce(string_agg(content, chr(10) ORDER BY uid) FILTER (WHERE unit_type <> 'figure'), '') AS txt FROM un GROUP BY ALL), j AS (SELECT p.doc_id, p.page_number, strategy, attempt_no, origin_type, char_density, rect_count, image_count, coalesce(n_units, 0) AS n_units, coalesce(tables, 0) AS tables, coalesce(texts, 0) AS texts, coalesce(({CLARITY.format('txt')})::DOUBLE, 0) AS clarity FROM judging p JOIN docs d ON p.doc_id = d.doc_id LEFT JOIN ag ON ag.doc_id = p.doc_id AND ag.page_number = p.page_number), k AS (SELECT *, CASE WHEN tables > 0 THEN 1.0 WHEN texts > 0 THEN 0.65 ELSE 0.2 END AS t, least(1.0, char_density / 0.00075) AS dn FROM j), c AS (SELECT *, CASE strategy WHEN 'STRATEGY_A' THEN (0.75 * least(1.0, char_density / 0.002) + CASE WHEN rect_count % 2 = 0 THEN 0.25 ELSE 0.0875 END) * CASE WHEN char_density < 0.0005 THEN 0.35 ELSE 1 END WHEN 'STRATEGY_B' THEN CASE WHEN image_count = 1 THEN 0.5 * (rect_count % 10) / 10 + 0.3 * clarity + 0.15 * t + 0.05 * dn ELSE 0.6 * clarity + 0.25 * t + 0.15 * dn END * CASE WHEN n_units > 0 THEN 1 ELSE 0.5 END * CASE WHEN clarity < 0.35 THEN 0.7 ELSE 1 END ELSE CASE WHEN n_units = 0 THEN 0.7 ELSE 0.95 END END AS confidence, (CASE WHEN strategy = 'STRATEGY_C' THEN 0 WHEN strategy = 'STRATEGY_B' AND origin_type = 'scanned_image' THEN 0.75 ELSE 0.7 END)::DOUBLE AS required FROM k)"""
OUTCOMES = DOCS + """,
judging AS (SELECT p.*, unnest(chain) AS strategy, generate_subscripts(chain, 1) AS attempt_no FROM (SELECT p.*, CASE WHEN origin_type = 'hybrid' THEN ['STRATEGY_A', 'STRATEGY_B', 'STRATEGY_C']
  WHEN origin_type = 'scanned_image' OR dominant_strategy = 'STRATEGY_B' THEN ['STRATEGY_B', 'STRATEGY_C'] WHEN dominant_strategy = 'STRATEGY_A' THEN ['STRATEGY_A', 'STRATEGY_B', 'STRATEGY_C'] ELSE ['STRATEGY_C'] END AS chain FROM profiles p JOIN docs USING (doc_id)) p),
""" + JUDGED + """,
oc AS (SELECT doc_id::VARCHAR AS file_id, page_number, attempt_no, strategy, CASE WHEN k < 3 THEN 0 ELSE confidence END::DOUBLE AS confidence, k >= 3 AND n_units > 0 AND confidence >= required AS good,
  rect_count / 1000 AS cost, (rect_count / 1000)::DECIMAL(20,9) AS money, rect_count * 10.0 AS ms, strategy = 'STRATEGY_C' AND k = 0 AS breaks FROM (SELECT *, (doc_id * 5 + page_number) % 19 AS k FROM c)),
q AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY page_number, attempt_no) AS rn FROM oc),
walk AS (SELECT file_id, 0::BIGINT AS rn, 0::BIGINT AS page, false AS done, 0::DECIMAL(20,9) AS spend, false AS off, 0::DECIMAL(20,9) AS spend_before, NULL::VARCHAR AS why, false AS is_made, false AS ok FROM (SELECT DISTINCT file_id FROM q)
  UNION ALL SELECT x.file_id, x.rn, x.page_number, CASE WHEN reached THEN won ELSE done END, CASE WHEN reached AND vision AND why IS NULL THEN (spend + money)::DECIMAL(20,9) ELSE spend END,
    off OR (reached AND vision AND why IS NULL AND breaks), spend, why, reached, won
  FROM (SELECT q.*, w.done, w.spend, w.off, q.strategy = 'STRATEGY_C' AS vision, NOT (w.page = q.page_number AND w.done) AS reached,
      CASE WHEN q.strategy = 'STRATEGY_C' AND w.off THEN 'disabled' WHEN q.strategy = 'STRATEGY_C' AND w.spend >= 0.1 THEN 'budget' END AS why,
      q.good AND NOT (q.strategy = 'STRATEGY_C' AND (w.off OR w.spend >= 0.1)) AS won FROM walk w JOIN q ON q.file_id = w.file_id AND q.rn = w.rn + 1) x),
made AS (SELECT q.file_id, q.page_number, attempt_no, strategy, CASE WHEN ok THEN 'success' ELSE 'fail' END AS status, CASE WHEN why IS NULL THEN confidence ELSE 0 END AS confidence,
  CASE WHEN why IS NULL THEN cost ELSE 0 END AS cost, CASE WHEN why IS NULL THEN ms ELSE 0 END AS processing_time_ms, spend_before::DOUBLE AS spend_before, why AS skipped FROM walk w JOIN q ON q.file_id = w.file_id AND q.rn = w.rn WHERE is_made)"""
MADE_COLUMNS = "file_id, page_number, attempt_no, strategy, status, round(confidence, 6) AS confidence, round(cost, 6) AS cost, round(spend_before, 6) AS spend_before, skipped"

ORACLE_SQL: dict[str, str] = {
    "page_profiles": f"WITH {PROFILES} SELECT doc_id, page_number, round(char_density, 9) AS char_density, is_landscape, detected_origin, dominant_strategy, reason FROM profiles",
    "ruled_pages": f"""WITH {PAGES}, x AS (SELECT *, length(text) / (width * height) AS density FROM doc_pages),
r AS (SELECT *, CASE WHEN rect_count > 45 AND width <= height THEN 1 WHEN rect_count <= 5 THEN 2 WHEN rect_count % 7 IN (1, 2) AND density > 0.0004 THEN 3
  WHEN rect_count > 30 THEN 5 WHEN density * 1000 - rect_count / 10 >= -1.5 THEN 6 WHEN density = 0 THEN 7 ELSE 8 END AS rule FROM x)
SELECT doc_id, page_number, CASE WHEN density > 0.0004 THEN 'born_digital' ELSE 'scanned' END AS detected_origin,
  ['STRATEGY_B', 'STRATEGY_A', 'STRATEGY_A', '', 'STRATEGY_B', 'STRATEGY_A', 'STRATEGY_C', 'STRATEGY_C'][rule] AS dominant_strategy,
  ['Tables upright.', 'Few rectangles.', 'Chained.', '', 'Decided before the error.', 'Matched routing rule.', 'No text.', 'No explicit rule matched; defaulting to OCR/Vision routing.'][rule] AS reason FROM r""",
    "doc_triage": f"WITH {DOCS} SELECT doc_id, total_pages, scanned_pages, overall_origin, origin_type, layout_complexity, mixed_mode, domain_hint, triage_confidence, cost_tier FROM docs",
    "triage_manifest_counts": f"WITH {DOCS} SELECT overall_origin, domain_hint, count(*) AS documents, sum(total_pages)::BIGINT AS pages FROM docs GROUP BY GROUPING SETS ((overall_origin), (domain_hint))",
    "legacy_triage": f"WITH {PROFILES}, l AS (SELECT doc_id, count(*) AS total_pages, count_if(detected_origin = 'scanned') AS s, avg(rect_count) AS r FROM profiles GROUP BY doc_id) SELECT doc_id, total_pages, CASE WHEN r > 50 THEN 'High' WHEN r > 10 THEN 'Medium' ELSE 'Low' END AS layout_complexity, round(greatest(0.5, least(0.99, 0.7 + 0.29 * abs(2 * s - total_pages) / total_pages))::DOUBLE, 6) AS triage_confidence FROM l",
    "domain_hints": "SELECT doc_id, " + HINT.format("text") + " AS domain_hint, CASE WHEN regexp_matches(lower(text), 'cbe|bank|disclosure|vulnerability|security') THEN 'Banking/Security' WHEN regexp_matches(lower(text), 'ministry|fta|woreda|survey|government') THEN 'Public_Sector' ELSE 'General' END AS default_hint FROM documents",
    "density_report": f"WITH {PROFILES} SELECT doc_id, count(*) AS pages, round(avg(char_density), 9) AS avg_density, sum(length(text))::BIGINT AS text_length, sum(image_count)::BIGINT AS images, sum(rect_count)::BIGINT AS rects, sum(greatest(1, len({WORDS.format('text')})))::BIGINT AS tokens FROM profiles GROUP BY doc_id",
    "fast_text_confidence": f"WITH {PROFILES} SELECT doc_id, page_number, round(((0.75 * least(1.0, char_density / 0.002) + CASE WHEN rect_count % 2 = 0 THEN 0.25 ELSE 0.0875 END) * CASE WHEN char_density < 0.0005 THEN 0.35 ELSE 1 END)::DOUBLE, 6) AS confidence FROM profiles",
    "ocr_confidence": f"WITH {PROFILES}, c AS (SELECT *, ({CLARITY.format('text')})::DOUBLE AS clarity, CASE WHEN rect_count > 50 THEN 1.0 WHEN text <> '' THEN 0.65 ELSE 0.2 END AS t, least(1.0, char_density / 0.00075) AS dn FROM profiles) SELECT doc_id, page_number, round((CASE WHEN image_count = 1 THEN 0.5 * (rect_count % 10) / 10 + 0.3 * clarity + 0.15 * t + 0.05 * dn ELSE 0.6 * clarity + 0.25 * t + 0.15 * dn END * CASE WHEN text <> '' THEN 1 ELSE 0.5 END * CASE WHEN clarity < 0.35 THEN 0.7 ELSE 1 END)::DOUBLE, 6) AS confidence FROM c",
    "text_clarity": f"SELECT doc_id, round(({CLARITY.format('text')})::DOUBLE, 6) AS clarity, greatest(1, len({WORDS.format('text')})) AS tokens FROM documents",
    "content_hash": f"WITH {PAGES} SELECT doc_id, page_number, {HASH.format('text', 'page_number')} AS content_hash FROM doc_pages",
    "provenance_hash": f"WITH {PROFILES} SELECT doc_id, page_number, sha256('doc_' || doc_id || '|' || page_number || '|' || dominant_strategy || '|2024-01-01T00:00:00Z|' || dominant_strategy) AS provenance_hash FROM profiles",
    "strategy_chain": f"WITH {DOCS}, c AS (SELECT p.doc_id, page_number, origin_type, CASE WHEN origin_type = 'hybrid' THEN 'STRATEGY_A,STRATEGY_B,STRATEGY_C' WHEN origin_type = 'scanned_image' OR dominant_strategy = 'STRATEGY_B' THEN 'STRATEGY_B,STRATEGY_C' WHEN dominant_strategy = 'STRATEGY_A' THEN 'STRATEGY_A,STRATEGY_B,STRATEGY_C' ELSE 'STRATEGY_C' END AS chain FROM profiles p JOIN docs USING (doc_id)) SELECT doc_id, page_number, chain, (CASE WHEN chain = 'STRATEGY_C' THEN 0 WHEN starts_with(chain, 'STRATEGY_B') AND origin_type = 'scanned_image' THEN 0.75 ELSE 0.7 END)::DOUBLE AS required_confidence FROM c",
    "table_islands": f"WITH {ORDER_UNITS} SELECT doc_id, island, count(*) AS units, min(unit_type) AS unit_type, min(n * 0.125)::DOUBLE AS y1, max((n + 1) * 0.125)::DOUBLE AS y2, md5(string_agg(content, chr(10) || chr(10) ORDER BY ord)) AS content_md5 FROM islands GROUP BY doc_id, island",
    "section_context": f"WITH {UNITS} SELECT doc_id, page_number, uid, section, is_boundary FROM placed",
    "chunk_pack": f"{PACKED} SELECT doc_id, chunk_no, tokens::INT AS tokens, section, len(pages) AS n_pages, md5(content) AS content_md5 FROM chunk",
    "orphan_merge": f"{MERGED} SELECT doc_id, merged_no, parts, tokens::INT AS tokens, section, {HASH.format('content', 'pages[1]')} AS content_hash FROM merged",
    "chunk_defaults": rf"WITH {ORDER_UNITS} SELECT doc_id, 1 AS merged_no, sum(len({WORDS.format('content')}))::INT AS tokens, first(content ORDER BY ord) AS section, max((n + 1) * 0.125)::DOUBLE AS y2 FROM islands GROUP BY doc_id",
    "chunk_page_index": f"{MERGED} SELECT doc_id, page_number, count(*) AS chunks FROM (SELECT doc_id, unnest(pages) AS page_number FROM merged) GROUP BY ALL",
    "html_units": f"WITH {HTML} SELECT page_id, n, tag, unit_type, content FROM html_units",
    "parsed_pages": r"""WITH p AS (SELECT 'page_' || page_id || '.html' AS path, html, contains(html, '</html>') AS whole FROM pages)
SELECT path, CASE WHEN whole THEN 'done' ELSE 'failed' END AS status, CASE WHEN whole AND contains(html, '<article>') THEN len(string_split(substr(html, strpos(html, '<article>')), '<p>')) - 1 ELSE 0 END AS n_rows,
  CASE WHEN NOT whole THEN 'ValueError: cut off' END AS error FROM p""",
    "refined_documents": """WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderkey % 9 AS k, CASE WHEN o_orderkey % 9 = 4 THEN 'o' || o_orderkey || '_refined' ELSE 'doc' || o_orderkey END AS file_id FROM orders)
SELECT file_id, 0 AS n, CASE WHEN k > 1 THEN k - 1 ELSE 1 END AS page_number, 'header' AS unit_type, 'Order ' || id AS content, CASE WHEN k = 2 THEN 0 ELSE 0.25 END::DOUBLE AS x1, CASE WHEN k = 2 THEN 1 ELSE 0.5 END::DOUBLE AS y2, file_id || ' > header' AS section_context FROM o WHERE k NOT IN (5, 6)
UNION ALL SELECT file_id, 1, 1, 'text', s, 0, 1, file_id || ' > text' FROM o WHERE k NOT IN (3, 5, 6)
UNION ALL SELECT '/in/o' || id || '_refined.json', NULL, NULL, NULL, CASE WHEN k = 5 THEN 'no JSON' ELSE 'no JSON object' END, NULL, NULL, NULL FROM o WHERE k IN (5, 6)""",
    "layout_counters": f"WITH {HTML} SELECT page_id, count_if(unit_type = 'header') AS headers, count_if(unit_type = 'text') AS texts, count_if(tag = 'li') AS items, sum(len({WORDS.format('content')}))::BIGINT AS tokens FROM html_units GROUP BY page_id",
    "page_lines": f"WITH s AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM s) SELECT doc_id, round_even(pos * 0.4, 0)::INT AS line_key, string_agg(word, ' ' ORDER BY pos) AS line FROM w GROUP BY ALL",
    "fast_text_units": f"""WITH {PLAN}, pp AS (SELECT p.doc_id, p.page_number, CASE WHEN (p.doc_id + p.page_number) % 3 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END AS text FROM doc_pages p SEMI JOIN planned USING (doc_id, page_number)),
w AS (SELECT doc_id, page_number, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT *, {WORDS.format('text')} AS ws FROM pp WHERE (doc_id + page_number) % 3 <> 0)),
wl AS (SELECT doc_id, page_number, round_even(pos * 0.4, 0)::BIGINT AS k, string_agg(word, ' ' ORDER BY pos) AS content FROM w GROUP BY ALL),
bl AS (SELECT doc_id, page_number, unnest(bs) AS content, generate_subscripts(bs, 1) AS k FROM (SELECT *, string_split(text, chr(10) || chr(10)) AS bs FROM pp ANTI JOIN wl USING (doc_id, page_number))),
al AS (SELECT doc_id, page_number, k, content FROM wl UNION ALL SELECT doc_id, page_number, k, regexp_replace(content, '^\\s+|\\s+$', '', 'g') FROM bl),
nn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY k) - 1 AS n FROM al WHERE content <> '') SELECT doc_id, page_number, 'p' || page_number || '_' || lpad(n::VARCHAR, 6, '0') AS uid, content FROM nn""",
    "document_texts": f"WITH {PAGES} SELECT doc_id, length(string_agg(text, chr(10) ORDER BY page_number)) AS n_chars, md5(string_agg(text, chr(10) ORDER BY page_number)) AS text_md5 FROM doc_pages GROUP BY doc_id",
    "ledger_validation": f"""WITH {RESULTS}, e AS (SELECT page_number - CASE WHEN file_id % 10 = 3 THEN 2 ELSE 1 END AS page_number FROM results)
SELECT 'page_number' AS check_name, count(*) AS row_count, count_if(page_number < 0) AS bad_rows FROM e UNION ALL SELECT 'cost', count(*), 0 FROM e UNION ALL SELECT 'processing_time_ms', count(*), 0 FROM e""",
    "ocr_word_confidence": "SELECT user_id, round(greatest(0.0, least(1.0, avg(value) FILTER (WHERE value >= 0) / 100))::DOUBLE, 6) AS confidence FROM events GROUP BY user_id",
    "metadata_codec": f"WITH {PAGES}, m AS (SELECT doc_id, list_sort(list(page_number)) AS pages, string_agg(page_number::VARCHAR, ',' ORDER BY page_number) AS t FROM doc_pages WHERE text <> '' GROUP BY doc_id), s AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'x, -2,' || t WHEN doc_id % 7 = 1 THEN '0,none' ELSE t END AS page_numbers FROM m), b AS (SELECT *, list_filter(list_transform(string_split(page_numbers, ','), lambda x: try_cast(trim(x) AS INT)), lambda x: x > 0) AS r FROM s), c AS (SELECT *, CASE WHEN len(r) > 0 THEN r ELSE [1] END AS k FROM b) SELECT doc_id, page_numbers, array_to_string(k, ';') AS read_back, k::BIGINT[] = pages::BIGINT[] AS same FROM c",
    "section_tree": f"WITH {NODES} SELECT node_id, parent_id, depth, node_type, title, min_page, max_page, chunk_count, pages_covered FROM nodes",
    "tree_root": f"WITH {SECTIONS} SELECT count(*) AS total_chunks, count(DISTINCT page_number) AS total_pages_covered, min(page_number) AS min_page, max(page_number) AS max_page FROM sc",
    "doc_outline": f"""WITH {PLACES.format(by='1', doc='')} SELECT node_id, depth, repeat('  ', depth) || '- ' || title AS line, place FROM places""",
    "tree_exported": f"""WITH {PLACES.format(by='c_mktsegment', doc='c_mktsegment, ')} SELECT c_mktsegment, node_id, parent_id, depth, title, chunk_count, pages_covered, place FROM places""",
    "questions_search": f"""WITH {SECTIONS}, f AS (SELECT r_name AS title, first(content ORDER BY page_number, section_context, content_hash) AS summary, min((page_number, section_context, content_hash)) AS ord FROM sc GROUP BY r_name),
w AS (SELECT title, ord, {TOKENS.format("title || ' ' || summary")} AS w FROM f), u AS (SELECT conv_id || '-' || turn AS question_id, {TOKENS.format("text")} AS q FROM conversations WHERE role = 'user'),
s AS (SELECT question_id, title, ord, 0.6 * len(list_intersect(q, w)) / len(list_distinct(list_concat(q, w))) + 0.4 * len(list_intersect(q, w)) / len(q) AS score FROM u, w WHERE len(list_intersect(q, w)) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ord) AS rank FROM s) SELECT question_id, rank, title, round(score::DOUBLE, 6) AS score FROM k WHERE rank <= 3""",
    "vectors_topk": """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM k WHERE rank <= 10""",
    "section_search": f"WITH {SECTIONS}, f AS (SELECT r_name AS title, first(content ORDER BY page_number, section_context, content_hash) AS summary, min((page_number, section_context, content_hash)) AS ord FROM sc GROUP BY r_name), t AS (SELECT *, {TOKENS.format("'asia and europe customer of'")} AS q, {TOKENS.format("title || ' ' || summary")} AS w FROM f), s AS (SELECT *, 0.6 * len(list_intersect(q, w)) / len(list_distinct(list_concat(q, w))) + 0.4 * len(list_intersect(q, w)) / len(q) AS score FROM t), b AS (SELECT title, score FROM s WHERE score > 0 ORDER BY score DESC, ord LIMIT 3), h AS (SELECT title, page_number, content_hash, round(score::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY content_hash ORDER BY page_number, section_context) AS k FROM sc JOIN b ON r_name = title) SELECT title, page_number, content_hash, score FROM h WHERE k = 1",
    "fact_extract": f"WITH {FACTS} SELECT * FROM document_facts",
    "fact_distinct_counts": f"WITH {FACTS} SELECT fact_key, entity, page_number, count(*) AS n, count(DISTINCT fact_value) AS distinct_values FROM (SELECT DISTINCT * FROM document_facts) GROUP BY ALL",
    "fact_sql_rows": f"WITH {FACTS} SELECT * FROM document_facts WHERE lower(fact_key) LIKE '%percent%' AND lower(entity) LIKE '%flag r%' AND page_number = 1 ORDER BY fact_key, fact_value, entity, content_hash, page_number LIMIT 50",
    "fact_sql_count": f"WITH {FACTS} SELECT count(*) AS total_rows FROM document_facts WHERE lower(fact_value) LIKE '%199%'",
    "fact_nl_query": f"WITH {FACTS} SELECT * FROM document_facts WHERE lower(entity) LIKE '%flag a%' OR lower(fact_key) LIKE '%flag a%'",
    "fact_guarded_sql": f"WITH {FACTS} SELECT fact_key, entity, count(*) AS n, max(fact_value) AS largest FROM document_facts WHERE page_number <= 4 GROUP BY fact_key, entity",
    "vector_topk": f"SELECT e.vec_id, e.label, round({DISTANCE}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {DISTANCE}, e.vec_id LIMIT 20",
    "hybrid_search": f"WITH p AS (SELECT e.vec_id, text AS content, {DISTANCE} AS distance FROM embeddings e JOIN documents ON vec_id = doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY distance, vec_id LIMIT 50), s AS (SELECT *, 0.8 / (1 + greatest(0, distance)) + 0.2 * len(list_intersect(['the', 'thin', 'and', 'of', 'stat'], {TOKENS.format('content')})) / 5 AS score FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY score DESC, distance, vec_id) AS k FROM s) SELECT vec_id, round(score, 6) AS score, round(distance, 6) AS distance FROM k WHERE k = 1 ORDER BY k.score DESC, k.distance, vec_id LIMIT 20",
    "dup_row_ids": "SELECT doc_id, md5(text) || CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1 THEN '' ELSE '-' || (row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) - 1) END AS row_id FROM documents",
    "citations": f"WITH {SECTIONS} SELECT content_hash, '- ' || content || ' (content_hash=' || content_hash || ', page=' || page_number || ')' AS line FROM sc",
    "evidence_union": f"WITH {SECTIONS} SELECT content_hash, page_number FROM sc WHERE page_number <= 20 UNION ALL SELECT content_hash, page_number FROM sc WHERE page_number >= 10 AND content_hash NOT IN (SELECT content_hash FROM sc WHERE page_number <= 20)",
    "hash_mentions": "SELECT doc_id, md5(text) AS content_hash FROM documents",
    "json_blocks": "SELECT event_id, props ->> '$.k' AS k FROM events",
    "escalation": f"WITH {TRIED} SELECT file_id, page_number, attempt_no, strategy, status FROM tried",
    "attempt_costs": f"WITH {RESULTS} SELECT * FROM results",
    "budget_stop_loss": f"WITH {BUDGET} SELECT file_id, page_number, attempt_no, status, round(cost, 6) AS cost, round(spend_before, 6) AS spend_before, skipped FROM made",
    "vlm_cost": f"WITH {PAGES}, t AS (SELECT doc_id, page_number, greatest(1, length(text) // 4) AS text_tokens, (ceil(width / 512) * ceil(height / 512) * 85)::BIGINT AS image_tokens FROM doc_pages) SELECT *, round(text_tokens::DECIMAL(18,0) * 0.0000003::DECIMAL(8,7) + image_tokens::DECIMAL(18,0) * 0.0000012::DECIMAL(8,7) + 1200 * 0.0000006::DECIMAL(8,7), 6)::DOUBLE AS cost FROM t",
    "ledger_rollup": f"WITH {TOTALS} SELECT * FROM totals",
    "ledger_entries": f"WITH {RESULTS} SELECT 'extraction_page_metrics' AS event_type, file_id::VARCHAR AS file_name, page_number, final_strategy AS strategy_selected, total_cost AS cost_estimate, total_time_ms AS processing_time_ms FROM results",
    "run_totals": f"WITH {TOTALS} SELECT count(*) AS documents, sum(pages)::BIGINT AS pages, round(sum(total_cost::DECIMAL(20,4)), 2)::DOUBLE AS total_cost, sum(failed_pages)::BIGINT AS failed_pages FROM totals",
    "ledger_hourly": "SELECT date_trunc('hour', ts) AS hour_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "router_classify": "SELECT conv_id, turn, regexp_matches(lower(text), 'total|sum|compare|list all|revenue|metric|amount|percentage') AS is_metric, CASE WHEN regexp_matches(lower(text), 'outline|structure|table of contents') THEN 'document_outline' WHEN regexp_matches(lower(text), 'section|chapter|summar|overview') THEN 'pageindex_navigate' ELSE 'semantic_search' END AS tool FROM conversations WHERE role = 'user'",
    "bbox_validation": "SELECT l_returnflag, l_linestatus, count(*) AS boxes, count_if(NOT (l_quantity / 50 >= l_discount AND l_tax * 2 - 0.02::DOUBLE >= l_tax AND least(l_discount, l_tax, l_quantity / 50, l_tax * 2 - 0.02::DOUBLE) >= 0)) AS bad_boxes FROM lineitem GROUP BY ALL",
    "attempt_validation": f"WITH {ATTEMPTS}, e AS (SELECT count(*) AS n, count_if(event_id % 20 = 0) AS b0, count_if(event_id % 20 IN (1, 2)) AS b1, count_if(event_id % 20 = 3) AS b3, count_if(event_id % 20 = 4) AS b4, count_if(event_id % 20 = 5) AS b5, count_if(event_id % 20 = 6) AS b6, count_if(event_id % 20 = 7) AS b7, count_if(event_id % 20 < 9) AS b9, count_if(event_id % 20 = 8) AS b8 FROM events) SELECT unnest(['page_number', 'confidence', 'cost', 'processing_time_ms', 'status', 'strategy', 'content', 'token_count', 'unit_type']) AS check_name, n AS row_count, unnest([b0, b1, b3, b4, b5, b6, b7, b9, b8]) AS bad_rows FROM e",
    "hash_validation": f"""WITH {SECTIONS}, n AS (SELECT *, regexp_extract(content, '(\\d+)', 1)::BIGINT AS no FROM sc), h AS (SELECT page_number, content_hash AS again, CASE WHEN no % 17 = 0 THEN reverse(content_hash) ELSE content_hash END AS stored,
  sha256(section_context || '|' || page_number || '|' || CASE WHEN no % 11 = 0 THEN 'STRATEGY_C' ELSE 'STRATEGY_B' END || '|2024-01-01T00:00:00Z|STRATEGY_A,STRATEGY_B') AS made, sha256(section_context || '|' || page_number || '|' || 'STRATEGY_B' || '|2024-01-01T00:00:00Z|STRATEGY_A,STRATEGY_B') AS sound FROM n) SELECT page_number, count(*) AS chunks, count_if(again <> stored) AS bad, count_if(made <> sound) AS bad_provenance FROM h GROUP BY page_number""",
    "safe_names": f"SELECT c_custkey, regexp_replace(regexp_replace(c_name || ' / ' || c_mktsegment || '.', '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS name, {SLUG.format('c_name')} AS slug FROM customer",
    "budget_page_results": f"WITH {BUDGET}, results AS (SELECT {RESULT_COLUMNS} FROM made GROUP BY file_id, page_number) SELECT file_id, page_number, attempts, final_strategy, final_status, total_cost, escalation_path FROM results",
    "circuit_breaker": f"WITH {TRIED.replace('abs(value) AS processing_time_ms', 'ts, event_id, abs(value) AS processing_time_ms')}, f AS (SELECT min((ts, event_id)) AS first FROM tried WHERE strategy = 'STRATEGY_C' AND status = 'fail' AND cost > 0.1) SELECT strategy, count(*) AS n, count_if(strategy = 'STRATEGY_C' AND coalesce((ts, event_id) > first, false)) AS disabled FROM tried, f GROUP BY strategy",
    "styled_sections": f"WITH {UNITS.replace('FROM units),', 'FROM styled),').replace('marked AS (SELECT *,', 'styled AS (SELECT *, (doc_id + page_number + length(content)) % 9 AS look FROM units), marked AS (SELECT *, look < 3 OR')} SELECT doc_id, page_number, uid, section, is_boundary FROM placed",
    "page_plan": f"WITH {PLAN} SELECT doc_id, place, page_number FROM planned",
    "planned_strategies": f"WITH {DOCS}, {PLAN.replace(PAGES + ',', '')} SELECT p.doc_id, p.page_number, CASE WHEN f.doc_id IS NOT NULL THEN f.dominant_strategy WHEN origin_type = 'scanned_image' THEN 'STRATEGY_B' ELSE 'STRATEGY_A' END AS dominant_strategy, f.doc_id IS NULL AS synthesized FROM planned p JOIN docs d ON p.doc_id = d.doc_id LEFT JOIN (SELECT * FROM profiles WHERE page_number % 2 = 1) f ON f.doc_id = p.doc_id AND f.page_number = p.page_number",
    "page_judgements": "WITH " + DOCS + ", judging AS (SELECT *, dominant_strategy AS strategy, 1 AS attempt_no FROM profiles), " + JUDGED + " SELECT doc_id, page_number, strategy, n_units, round(confidence::DOUBLE, 6) AS confidence, required, n_units > 0 AND confidence >= required AS success FROM c",
    "attempts_made": f"WITH RECURSIVE {OUTCOMES} SELECT {MADE_COLUMNS} FROM made",
    "attempts_streamed": f"WITH RECURSIVE {OUTCOMES} SELECT {MADE_COLUMNS} FROM made",
    "attempts_pages": f"WITH RECURSIVE {OUTCOMES} SELECT file_id, page_number, attempts, final_strategy, final_status, total_cost, escalation_path FROM (SELECT {RESULT_COLUMNS} FROM made GROUP BY file_id, page_number)",
    "piece_rows": f"WITH {HTML}, t AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n % 2, n) - 1 AS k, n, content FROM html_units WHERE page_id % 5 <> 0) SELECT page_id, k AS n, 1 AS page_number, CASE n % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'header' WHEN 4 THEN 'text' ELSE 'figure' END AS unit_type, content FROM t WHERE n % 3 <> 2",
    "search_rows": f"WITH {HTML}, u AS (SELECT 'page_' || page_id AS file_id, n, CASE n % 4 WHEN 0 THEN 'raw ' || content ELSE content END AS content, CASE WHEN n % 4 = 2 OR n <= 3 THEN 1 ELSE n - 3 END AS page_number, CASE WHEN n % 4 = 3 THEN 'text' ELSE unit_type END AS kind FROM html_units) SELECT file_id, content, page_number, file_id || ' > ' || kind AS section_context, len({WORDS.format('content')}) AS token_count, 1.0::DOUBLE AS x2 FROM u",
    "normalized_units": f"WITH {UNITS} SELECT doc_id, page_number, uid, CASE WHEN page_number % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS x2, 'STRATEGY_B' AS strategy_used, 'STRATEGY_A>STRATEGY_B' AS path FROM units",
    "payload_rows": "WITH c AS (SELECT *, c_custkey % 5 AS k, unnest(CASE WHEN c_custkey % 5 = 1 THEN [0, 1] ELSE [0] END) AS n FROM customer) SELECT c_custkey, n, CASE WHEN k = 0 THEN '' ELSE c_name END AS content, CASE WHEN k > 1 THEN (k + 1) || ',9' ELSE '1' END AS pages, CASE WHEN k = 3 THEN 'Unknown' ELSE c_mktsegment END AS section_context, CASE WHEN k IN (0, 4) THEN 1 ELSE k * 2 END AS token_count, c_mktsegment AS content_hash, CASE WHEN k = 2 THEN 0 ELSE k / 4 END::DOUBLE AS x1, 1.0::DOUBLE AS x2 FROM c",
    "origin_names": "WITH n AS (SELECT ['image_scan', 'scanned', 'digital', 'mixed', NULL, NULL, 'hybrid', 'paper'] AS v), e AS (SELECT event_id, coalesce(v[event_id % 8 + 1], v[(event_id + user_id) % 8 + 1], v[user_id % 8 + 1], 'unknown') AS s FROM events, n) SELECT event_id, CASE WHEN s IN ('image_scan', 'scanned') THEN 'scanned_image' WHEN s IN ('mixed', 'hybrid') THEN 'hybrid' WHEN s = 'digital' THEN 'born_digital' ELSE 'unknown' END AS origin FROM e",
    "attempt_labels": f"WITH {ATTEMPTS} SELECT replace(strategy, 'STRATEGY_', 'Strategy ') AS label, count(*) AS n FROM attempts GROUP BY ALL",
    "vision_models": f"WITH {DOCS} SELECT doc_id, cost_tier, CASE cost_tier WHEN 'MEDIUM' THEN 'vendor/medium-model' ELSE 'openai/gpt-4o-mini' END AS model FROM docs",
    "metadata_hints": "WITH b AS (SELECT doc_id, text, lower(coalesce(source, '') || ' ' || coalesce(lang, '') || ' ' || CASE WHEN doc_id % 5 = 0 THEN 'From the Ministry' WHEN doc_id % 7 = 0 THEN 'Bank paper' ELSE 'none' END) AS m FROM documents) SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'cbe|bank|disclosure|vulnerability|security') THEN 'Banking/Security' WHEN regexp_matches(lower(text), 'ministry|fta|woreda|survey|government') THEN 'Public_Sector' WHEN regexp_matches(m, 'cbe|bank|disclosure|vulnerability|security') THEN 'Banking/Security' WHEN regexp_matches(m, 'ministry|fta|woreda|survey|government') THEN 'Public_Sector' ELSE 'General' END AS hint, CASE WHEN regexp_matches(lower(text), 'bank|cbe|disclosure|vulnerability') THEN 'Banking/Security' WHEN regexp_matches(lower(text), 'ministry|fta|woreda|survey') THEN 'Public_Sector' ELSE 'General' END AS legacy_hint FROM b",
    "display_names": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN replace(c_name, '#', '_') || '.pdf' WHEN 1 THEN c_mktsegment ELSE 'Indexed Document' END AS name FROM customer",
    "ledger_progress": f"WITH {RESULTS} SELECT file_id::VARCHAR AS file_name, page_number, row_number() OVER (PARTITION BY file_id ORDER BY page_number) AS pages_processed FROM results",
    "page_lists": "WITH p AS (SELECT l_orderkey, (l_quantity % 5 - CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE -1 END)::INT AS n FROM lineitem) SELECT l_orderkey, CASE WHEN min(n) > 0 THEN string_agg(DISTINCT n::VARCHAR, ',' ORDER BY n::VARCHAR) END AS pages FROM p GROUP BY l_orderkey",
    "section_rollup": f"WITH {SECTIONS}, b AS (SELECT *, regexp_extract(content, '([0-9]+)', 1)::BIGINT AS k FROM sc) SELECT c_mktsegment, r_name AS title, min(k % 8 / 16)::DOUBLE AS x1, min(k % 4 / 8)::DOUBLE AS y1, max(0.5 + k % 8 / 16)::DOUBLE AS x2, max(0.5 + k % 4 / 8)::DOUBLE AS y2, count(*) AS chunk_count, count(DISTINCT page_number) AS total_pages_covered, md5(string_agg(content_hash, ',' ORDER BY page_number, section_context, content_hash)) AS hashes_md5, array_to_string(list_sort(list_distinct(list(page_number))), ',') AS pages FROM b GROUP BY c_mktsegment, r_name",
    "node_boxes": f"""WITH {NODES.replace("page_number FROM named", "page_number, regexp_extract(content, '([0-9]+)', 1)::BIGINT AS k FROM named")}
SELECT node_id, page_number, min(k % 8 / 16)::DOUBLE AS x1, min(k % 4 / 8)::DOUBLE AS y1, max(0.5 + k % 8 / 16)::DOUBLE AS x2, max(0.5 + k % 4 / 8)::DOUBLE AS y2 FROM levels GROUP BY node_id, page_number""",
    "chunk_boxes": f"""{MERGED}, b AS (SELECT s.doc_id, t.merged_no, s.page_number, u.n, length(u.content) % 5 AS k FROM seq s JOIN walk w ON s.doc_id = w.doc_id AND s.segment = w.segment AND s.rn = w.rn
  JOIN chunk c ON c.doc_id = s.doc_id AND c.segment = s.segment AND c.pack = w.pack JOIN takes t ON t.doc_id = c.doc_id AND t.chunk_no = c.chunk_no JOIN (SELECT *, split_part(uid, '_', 2)::INT AS n FROM units) u ON u.doc_id = s.doc_id AND u.ord = s.ord)
SELECT doc_id, merged_no, page_number, round(min(k / 10), 6) AS x1, round(min(n / 8), 6) AS y1, round(max(0.5 + k / 10), 6) AS x2, round(max((n + 1) / 8), 6) AS y2 FROM b GROUP BY ALL""",
    "chunk_nodes": f"WITH {NODES} SELECT 'chunk/' || left(content_hash, 16) AS node_id, s1 || '/' || s2 || '/' || s3 AS parent_id, 'chunk' AS node_type, 'Chunk ' || left(content_hash, 8) AS title, page_number FROM named",
    "section_summaries": f"WITH {SECTIONS}, f AS (SELECT r_name AS title, first(content ORDER BY page_number, section_context, content_hash) AS summary FROM sc GROUP BY r_name) SELECT title, title || ': ' || summary AS line FROM f WHERE title IN (SELECT r_name FROM sc WHERE page_number = 7 AND contains(content, 'BUILDING'))",
    "evidence_lines": f"WITH {SECTIONS} SELECT content_hash, '[hash=' || content_hash || ' page=' || page_number || '] ' || content AS line FROM sc",
    "cited_hashes": """WITH docs AS (SELECT doc_id, md5(text) AS h FROM documents), n AS (SELECT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN [h] WHEN doc_id % 3 = 0 THEN [h, md5(h)] ELSE [h, 'deadbeef'] END) AS content_hash FROM docs)
SELECT doc_id, content_hash FROM n WHERE content_hash IN (SELECT h FROM docs)""",
}
