"""Inputs of the queries: records, links and states of many shapes, made from whole tables by SQL that both engines run."""

from .registry import INPUTS

#: URLs of pages in nine spellings, of which some mean the same.
INPUTS["in_urls"] = """
SELECT page_id, CASE page_id % 9
  WHEN 0 THEN url
  WHEN 1 THEN concat('HTTPS://WWW.', substr(url, 8), '/#top')
  WHEN 2 THEN concat('  ', url, '?page=', CAST(page_id % 4 AS varchar(20)), '&q= ')
  WHEN 3 THEN concat('https://www.justice.gov/archives/opa/pr/item-', CAST(page_id AS varchar(20)), '.html')
  WHEN 4 THEN concat(url, '/search-results.php?Keyword=x')
  WHEN 5 THEN concat(url, '/page/', CAST(page_id % 7 AS varchar(20)), '/')
  WHEN 6 THEN concat('https://legiscan.com/', CASE page_id % 2 WHEN 0 THEN 'AK' ELSE 'wa' END, '/bill/HB00', CAST(page_id AS varchar(20)), '/', CAST(2019 + page_id % 7 AS varchar(20)), '/id/', CAST(page_id AS varchar(20)))
  WHEN 7 THEN CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'mailto:a@b.example' WHEN 2 THEN concat('https://agency.gov/index.html;v=', CAST(page_id AS varchar(20))) WHEN 3 THEN '/relative/Path' ELSE 'https://' END
  ELSE concat('https://docs.example.gov/eo_2021-', CAST(page_id AS varchar(20)), '-day_of_awareness.pdf?x=1')
END AS url
FROM {pages}
"""

#: Documents with a title and the URL of a page.
INPUTS["in_docs"] = """
SELECT doc_id, text, lang, source, n_chars, substr(text, 1, 60) AS title,
  concat('https://', source, '.example.gov/doc/', CAST(doc_id AS varchar(20))) AS url
FROM {documents}
"""

#: Records of a tracker: one for each document.
INPUTS["in_records"] = """
SELECT doc_id AS id, CASE doc_id % 7 WHEN 0 THEN 'AK' WHEN 1 THEN 'wa ' WHEN 2 THEN 'National' WHEN 3 THEN '' WHEN 4 THEN 'US' WHEN 5 THEN 'Montana' ELSE 'NM' END AS state,
  CASE doc_id % 6 WHEN 0 THEN concat('HB 00', CAST(doc_id % 97 AS varchar(20))) WHEN 1 THEN concat('H.B. ', CAST(doc_id % 97 AS varchar(20))) WHEN 2 THEN concat('sb', CAST(doc_id % 97 AS varchar(20))) WHEN 3 THEN '' WHEN 4 THEN concat('A0', CAST(doc_id % 97 AS varchar(20))) ELSE concat('AO', CAST(doc_id % 97 AS varchar(20))) END AS bill_number,
  concat('https://legiscan.com/', CASE doc_id % 2 WHEN 0 THEN 'AK' ELSE 'WA' END, '/bill/HB', CAST(doc_id % 97 AS varchar(20)), '/', CAST(2018 + doc_id % 8 AS varchar(20))) AS url,
  substr(text, 1, 60) AS name, text, source,
  CASE doc_id % 5 WHEN 0 THEN 'passed' WHEN 1 THEN 'Active' WHEN 2 THEN ' FAILED ' WHEN 3 THEN '' ELSE 'Pending' END AS status,
  CASE doc_id % 6 WHEN 0 THEN 'Senate Committee' WHEN 1 THEN 'the house' WHEN 2 THEN 'Assembly' WHEN 3 THEN '' WHEN 4 THEN 'EXECUTIVE' ELSE 'unknown' END AS chamber,
  CASE doc_id % 7 WHEN 0 THEN '2024-05-01' WHEN 1 THEN '05/03/2026' WHEN 2 THEN 'May 5, 2023' WHEN 3 THEN 'Jan 9, 2017' WHEN 4 THEN '' WHEN 5 THEN 'soon' ELSE '2019-11-30' END AS last_update,
  CASE doc_id % 5 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'somewhat' WHEN 2 THEN 'no' WHEN 3 THEN '' ELSE 'Partly' END AS answer,
  CASE doc_id % 6 WHEN 0 THEN 'taskforce, Data Collection' WHEN 1 THEN '["Taskforce", "data collection"]' WHEN 2 THEN '[''MMIP Relatives'', ''Other'']' WHEN 3 THEN '' WHEN 4 THEN 'Taskforce,taskforce , Day of recognition' ELSE 'None of these' END AS categories,
  CASE doc_id % 4 WHEN 0 THEN 'Pending Review' WHEN 1 THEN 'Approved' WHEN 2 THEN 'Rejected' ELSE 'Live' END AS review_status
FROM {documents}
"""

#: Sponsor lines.
INPUTS["in_sponsors"] = """
SELECT c_custkey AS id, concat(CASE c_custkey % 4 WHEN 0 THEN 'Rep. ' WHEN 1 THEN 'Senator ' ELSE '' END, 'Ann ', CASE c_custkey % 3 WHEN 0 THEN 'B. ' ELSE '' END, c_mktsegment, CAST(c_custkey % 50 AS varchar(20)),
  CASE c_custkey % 5 WHEN 0 THEN ' [D, 4]' WHEN 1 THEN ' (R-12)' ELSE '' END,
  CASE c_custkey % 3 WHEN 0 THEN ' - Chair (District 7)' WHEN 1 THEN ' - Sponsor' ELSE '' END, ', Bo [X, Y], Cy') AS sponsors,
  CASE c_custkey % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN 'MMIP Coordinator (2020-)' WHEN 2 THEN 'Tribal Judge' ELSE 'Speaker of the House, 2011' END AS offices
FROM {customer}
"""

#: What has been seen before: a state for some of the pages' URLs.
INPUTS["in_seen"] = """
SELECT lower(trim(url)) AS url, CASE page_id % 3 WHEN 0 THEN 'legiscan' WHEN 1 THEN 'State Site' ELSE 'federal_site' END AS source,
  CASE page_id % 6 WHEN 0 THEN 'rejected' WHEN 1 THEN 'approved' WHEN 2 THEN 'pending' WHEN 3 THEN 'analyzed' WHEN 4 THEN 'discovered' ELSE 'error' END AS status,
  concat('h', CAST(page_id % 5 AS varchar(20))) AS change_hash, CASE page_id % 4 WHEN 0 THEN '' ELSE concat('c', CAST(page_id % 4 AS varchar(20))) END AS content_hash,
  CASE page_id % 2 WHEN 0 THEN NULL ELSE 's1' END AS session_id, CASE page_id % 3 WHEN 0 THEN NULL ELSE 'ok' END AS verdict,
  CAST(page_id AS varchar(20)) AS external_id, CAST(page_id % 10 AS double) / 10 AS confidence, page_id AS first_seen, page_id AS last_seen
FROM {pages} WHERE page_id % 3 <> 0
"""

#: A batch of candidates: two rows for some URLs, later rows after earlier ones by ordinal.
INPUTS["in_batch"] = """
SELECT page_id AS ord, url, 'state_site' AS source, concat('h', CAST(page_id % 7 AS varchar(20))) AS change_hash, CASE page_id % 3 WHEN 0 THEN '' ELSE concat('c', CAST(page_id % 5 AS varchar(20))) END AS content_hash,
  CASE page_id % 5 WHEN 0 THEN '' ELSE 's2' END AS session_id, CASE page_id % 4 WHEN 0 THEN NULL ELSE 'new' END AS verdict, CAST(page_id % 7 AS double) / 7 AS confidence, 'pending' AS status,
  CASE page_id % 3 WHEN 0 THEN 'AK' WHEN 1 THEN '' ELSE 'wa' END AS state, concat('hb ', CAST(page_id % 60 AS varchar(20))) AS bill_number
FROM {pages}
UNION ALL
SELECT page_id + 1000000000, concat(url, '/'), 'federal_site', 'h0', 'c0', '', 'again', 0.5, 'error', 'AK', concat('HB', CAST(page_id % 60 AS varchar(20))) FROM {pages} WHERE page_id % 4 = 0
"""

#: Two snapshots of records, with rows on either side only, and changed and repeated ones.
INPUTS["in_old"] = "SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS progression, substr(CAST(o_orderdate AS varchar(30)), 1, 10) AS last_update, o_custkey AS bill FROM {orders} WHERE o_orderkey % 10 <> 0"
INPUTS["in_new"] = "SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'X' ELSE o_orderstatus END AS status, CASE o_orderkey % 11 WHEN 0 THEN '' ELSE o_orderpriority END AS progression, CASE o_orderkey % 5 WHEN 0 THEN '1990-01-01' WHEN 1 THEN '2030-01-01' ELSE substr(CAST(o_orderdate AS varchar(30)), 1, 10) END AS last_update, CASE o_orderkey % 13 WHEN 0 THEN -1 ELSE o_custkey END AS bill FROM {orders} WHERE o_orderkey % 9 <> 0"

#: Sources with roles, tags and coverage.
INPUTS["in_sources"] = """
SELECT s_suppkey AS id, concat('source-', CAST(s_suppkey % 40 AS varchar(20))) AS source_id, n_name AS state, CASE s_suppkey % 4 WHEN 0 THEN 'index' WHEN 1 THEN 'search' WHEN 2 THEN 'api' ELSE 'rss' END AS method,
  CASE s_suppkey % 5 WHEN 0 THEN 'executive_order' WHEN 1 THEN 'proclamation' WHEN 2 THEN 'press_release' WHEN 3 THEN 'legislation' ELSE 'other' END AS content_type,
  concat('https://', CASE s_suppkey % 3 WHEN 0 THEN 'www.' ELSE '' END, 'site', CAST(s_suppkey % 25 AS varchar(20)), '.example.gov/', CASE s_suppkey % 2 WHEN 0 THEN 'news/' ELSE 'News' END) AS url,
  CAST(s_suppkey % 30 AS int) AS max_pages, s_acctbal > 0 AS enabled, s_suppkey % 9 AS hits
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""
