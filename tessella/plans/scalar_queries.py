"""Queries of scalar expressions and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import bills, coerce, text, urls

from . import inputs  # noqa: F401
from .registry import Tables, query

C = F.col
#: The oracles' URL split, as the same regular expression in DuckDB.
RX = r"'^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?'"
PARTS = rf"""parts AS (SELECT *, trim(url) AS u, lower(regexp_extract(trim(url), {RX}, 1)) AS sch, lower(regexp_extract(trim(url), {RX}, 2)) AS hst,
  regexp_replace(regexp_extract(trim(url), {RX}, 3), ';[^/]*$', '') AS pth, regexp_extract(trim(url), {RX}, 4) AS qry FROM in_urls)"""
NORMAL = rf"""{PARTS}, bare AS (SELECT *, regexp_replace(hst, '^www\.', '') AS h, CASE WHEN rtrim(pth, '/') = '' THEN '/' ELSE rtrim(pth, '/') END AS p FROM parts),
normal AS (SELECT *, CASE WHEN u = '' THEN '' ELSE concat(CASE WHEN sch IN ('', 'http') THEN 'https' ELSE sch END, CASE WHEN h <> '' THEN '://' || h ELSE ':' END,
  CASE WHEN h LIKE '%justice.gov' AND p LIKE '/archives/%' THEN CASE WHEN rtrim(substr(p, 10), '/') = '' THEN '/' ELSE rtrim(substr(p, 10), '/') END ELSE p END, CASE WHEN qry <> '' THEN '?' || qry ELSE '' END) END AS norm FROM bare)"""


@query("n1_normalize_url", f"WITH {NORMAL} SELECT page_id, norm FROM normal")
def n1(t: Tables) -> DataFrame:
    return t("in_urls").select("page_id", urls.normalize_url(C("url")).alias("norm"))


@query("n2_cache_key", f"WITH {NORMAL} SELECT page_id, lower(CASE WHEN norm = '' THEN u ELSE norm END) AS key FROM normal")
def n2(t: Tables) -> DataFrame:
    return t("in_urls").select("page_id", urls.url_key(C("url")).alias("key"))


@query("n3_bill_identity_key", r"""WITH k AS (SELECT id, upper(trim(state)) AS s, regexp_replace(upper(bill_number), '\s+', '', 'g') AS n FROM in_records)
SELECT id, n AS bill_key_ws, CASE WHEN s <> '' AND n <> '' THEN s || '|' || n END AS identity FROM k""")
def n3(t: Tables) -> DataFrame:
    return t("in_records").select("id", bills.bill_key_ws(C("bill_number")).alias("bill_key_ws"), bills.identity_key(C("state"), C("bill_number")).alias("identity"))


NORM = "regexp_replace(regexp_replace(upper(bill_number), '[^A-Z0-9]', '', 'g'), '^([A-Z]+)0*([0-9]+)$', '\\1\\2')"


@query("n4_bill_key_norm", f"SELECT id, {NORM} AS bill_key_norm FROM in_records")
def n4(t: Tables) -> DataFrame:
    return t("in_records").select("id", bills.bill_key_norm(C("bill_number")).alias("bill_key_norm"))


BILL = r"'(?i)legiscan\.com/([A-Z]{2})/(?:bill|text)/([A-Z]+[0-9]+)/([0-9]{4})'"


@query("n5_parse_bill_url", f"SELECT page_id, nullif(upper(regexp_extract(url, {BILL}, 1)), '') AS state, nullif(upper(regexp_extract(url, {BILL}, 2)), '') AS number, CAST(nullif(regexp_extract(url, {BILL}, 3), '') AS INTEGER) AS year FROM in_urls")
def n5(t: Tables) -> DataFrame:
    return t("in_urls").select("page_id", *(bills.bill_url_part(C("url"), p).alias(p) for p in ("state", "number", "year")))


@query("n6_document_id", r"SELECT page_id, nullif(regexp_extract(url, '/id/(\d+)', 1), '') AS document_id FROM in_urls")
def n6(t: Tables) -> DataFrame:
    return t("in_urls").select("page_id", urls.document_id(C("url")).alias("document_id"))


@query("n7_source_type", """SELECT page_id, CASE WHEN lower(url) LIKE '%legiscan.com%' THEN 'legiscan' WHEN lower(url) LIKE '%federalregister.gov%' OR lower(url) LIKE '%justice.gov%' THEN 'federal'
  WHEN lower(url) LIKE '%.gov%' THEN 'gov' ELSE 'unknown' END AS source_type FROM in_urls""")
def n7(t: Tables) -> DataFrame:
    return t("in_urls").select("page_id", urls.source_type(C("url")).alias("source_type"))


@query("n8_record_source", """SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'State Site' WHEN lower(url) LIKE '%legiscan.com%' THEN 'LegiScan'
  WHEN regexp_matches(lower(url), 'justice\\.gov|federalregister\\.gov|whitehouse\\.gov') THEN 'Federal Site' ELSE 'State Site' END AS source FROM in_urls""")
def n8(t: Tables) -> DataFrame:
    stated = F.when(C("page_id") % 10 == 0, "State Site").otherwise("old")
    return t("in_urls").select("page_id", urls.record_source(C("url"), stated).alias("source"))


TITLE = r"""trim(regexp_replace(n, '(?i)^(?:Rep\.?\s|Representative\s|Sen\.?\s|Senator\s|Gov\.?\s|Governor\s|Secretary\s|Attorney General\s)|\s*\[[D|R].*?\]|\s*\([D|R].*?\).*$', '', 'g'))"""


@query("n9_roster_key", f"""WITH s AS (SELECT id, split_part(sponsors, ',', 1) AS n FROM in_sponsors)
SELECT id, {TITLE} AS bare, regexp_replace(lower(trim(split_part(trim(regexp_replace({TITLE}, '\\(.*?\\)', '', 'g')), '-', 1))), '\\s+', '', 'g') AS roster_key FROM s""")
def n9(t: Tables) -> DataFrame:
    name = F.substring_index(C("sponsors"), ",", 1)
    return t("in_sponsors").select("id", bills.strip_title(name).alias("bare"), bills.roster_key(name).alias("roster_key"))


@query("n10_middle_initial", f"""WITH s AS (SELECT id, split_part(sponsors, ',', 1) AS n FROM in_sponsors), w AS (SELECT id, regexp_split_to_array({TITLE}, '\\s+') AS w, {TITLE} AS bare FROM s)
SELECT id, CASE WHEN len(w) >= 3 AND regexp_full_match(w[2], '[A-Za-z]\\.?') THEN w[1] || ' ' || array_to_string(w[3:], ' ') ELSE bare END AS name FROM w""")
def n10(t: Tables) -> DataFrame:
    return t("in_sponsors").select("id", bills.without_middle_initial(bills.strip_title(F.substring_index(C("sponsors"), ",", 1))).alias("name"))


@query("n12_visible_length", r"SELECT doc_id, CAST(length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS INTEGER) AS visible FROM documents")
def n12(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", text.visible_length(C("text")).alias("visible"))


STOP = ", ".join(f"'{w}'" for w in text.TITLE_STOPWORDS)
WORDS = f"list_filter(regexp_extract_all(lower({{}}), '[a-z0-9'']+'), lambda w: length(w) > 3 AND w NOT IN ({STOP}))"


@query("n13_significant_words", f"SELECT doc_id, array_to_string(list_sort(list_distinct({WORDS.format('title')})), ' ') AS words FROM in_docs")
def n13(t: Tables) -> DataFrame:
    return t("in_docs").select("doc_id", F.array_join(F.array_sort(text.significant_words(C("title"))), " ").alias("words"))


@query("n14_strip_preamble", """WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Here is a ' WHEN 1 THEN ' HERE IS The following ' ELSE '' END || title AS s FROM in_docs)
SELECT doc_id, trim(regexp_replace(trim(regexp_replace(trim(s), '(?i)^here is (a |an )?', '')), '(?i)^the following ', '')) AS summary FROM x""")
def n14(t: Tables) -> DataFrame:
    s = F.concat(F.when(C("doc_id") % 3 == 0, "Here is a ").when(C("doc_id") % 3 == 1, " HERE IS The following ").otherwise(""), C("title"))
    return t("in_docs").select("doc_id", text.strip_preamble(s).alias("summary"))


@query("n15_eval_answer", "SELECT id, CASE lower(rtrim(trim(answer), '.')) WHEN 'yes' THEN 'Yes' WHEN 'somewhat' THEN 'Somewhat' ELSE 'No' END AS answer FROM in_records")
def n15(t: Tables) -> DataFrame:
    return t("in_records").select("id", coerce.eval_answer(C("answer")).alias("answer"))


LISTED = "CASE id % 4 WHEN 0 THEN '1. ' || name || chr(10) || ' 2) second' || chr(10) || '3. third' WHEN 1 THEN 'No' WHEN 2 THEN '' ELSE name END"


@query("n16_quote_list_parse", rf"""WITH x AS (SELECT id, trim({LISTED}) AS s FROM in_records), p AS (SELECT id, s, list_filter(list_transform(regexp_split_to_array(s, '\n\s*[0-9]+[.)]\s*'), lambda v: trim(v)), lambda v: v <> '') AS l FROM x)
SELECT id, CASE WHEN s = '' OR lower(s) = 'no' THEN '' WHEN len(l) > 1 THEN array_to_string(l, '|') ELSE s END AS items FROM p""")
def n16(t: Tables) -> DataFrame:
    return t("in_records").select("id", F.array_join(text.quotes(F.expr(LISTED.replace("chr(10)", r"'\n'"))), "|").alias("items"))


@query("n17_scalar_coercions", """SELECT id, coalesce(TRY_CAST(CASE id % 3 WHEN 0 THEN '0.5' WHEN 1 THEN 'high' ELSE '1e-2' END AS DOUBLE), 0.0) AS confidence, lower(trim(answer)) IN ('true', 'yes', '1') AS truth,
  CASE WHEN lower(trim(state)) = 'national' THEN 'National' WHEN length(trim(state)) <= 3 THEN upper(trim(state)) ELSE trim(state) END AS state FROM in_records""")
def n17(t: Tables) -> DataFrame:
    number = F.when(C("id") % 3 == 0, "0.5").when(C("id") % 3 == 1, "high").otherwise("1e-2")
    return t("in_records").select("id", coerce.confidence(number).alias("confidence"), coerce.truth(C("answer")).alias("truth"), coerce.state_code(C("state")).alias("state"))


ISO = """CASE WHEN regexp_full_match(trim(last_update), '\\d{4}-\\d{2}-\\d{2}') THEN trim(last_update)
  ELSE strftime(coalesce(try_strptime(trim(last_update), '%Y-%m-%d'), try_strptime(trim(last_update), '%m/%d/%Y'), try_strptime(trim(last_update), '%B %d, %Y'), try_strptime(trim(last_update), '%b %d, %Y')), '%Y-%m-%d') END"""
CHAMBER = "CASE WHEN lower(trim(chamber)) LIKE '%senate%' THEN 'Senate' WHEN lower(chamber) LIKE '%house%' OR lower(chamber) LIKE '%assembly%' THEN 'House' ELSE 'Executive' END"


@query("n18_field_coercion", f"""SELECT id, CASE lower(trim(status)) WHEN 'passed' THEN 'Passed' WHEN 'failed' THEN 'Failed' ELSE 'Pending' END AS status, {CHAMBER} AS chamber, {ISO} AS last_update,
  CASE WHEN trim(rtrim(trim(answer), '.')) = '' THEN 'No' WHEN lower(rtrim(trim(answer), '.')) IN ('yes', 'no') THEN upper(answer[1]) || lower(rtrim(answer, '.')[2:]) ELSE 'TBD or TCRP Specific' END AS mechanisms FROM in_records""")
def n18(t: Tables) -> DataFrame:
    return t("in_records").select("id", coerce.status(C("status")).alias("status"), coerce.chamber(C("chamber")).alias("chamber"), coerce.iso_date(C("last_update")).alias("last_update"), coerce.field_answer(F.lit("Mechanisms for Evaluation?"), C("answer")).alias("mechanisms"))


CATS = "list_filter(list_transform(string_split(categories, ','), lambda v: regexp_replace(trim(v), '^[\\[\\]''\"]+|[\\[\\]''\"]+$', '', 'g')), lambda v: v <> '')"
KNOWN = "[" + ", ".join(f"'{c}'" for c in coerce.CATEGORIES) + "]"


@query("n19_categories", f"""WITH c AS (SELECT id, list_filter(list_transform({CATS}, lambda v: list_filter({KNOWN}, lambda k: lower(k) = lower(trim(v)))[1]), lambda v: v IS NOT NULL) AS l FROM in_records)
SELECT id, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '|') AS categories FROM c""")
def n19(t: Tables) -> DataFrame:
    return t("in_records").select("id", F.array_join(coerce.categories(C("categories")), "|").alias("categories"))


NOTE = "CASE doc_id % 3 WHEN 0 THEN title WHEN 1 THEN 'https://x.gov/' ELSE substr(text, 1, 200) END"


@query("n21_snippet", rf"""WITH x AS (SELECT doc_id, title, {NOTE} AS c, CASE doc_id % 2 WHEN 0 THEN '' ELSE 'find this' END AS q FROM in_docs), b AS (SELECT doc_id, q, CASE WHEN c <> '' AND c <> title AND NOT regexp_matches(lower(trim(c)), '^https?://') THEN trim(title || chr(10) || c) ELSE title END AS base FROM x),
s AS (SELECT doc_id, CASE WHEN q <> '' AND NOT contains(lower(base), q) THEN trim(base || chr(10) || '(search: ' || q || ')') ELSE base END AS snippet FROM b)
SELECT doc_id, snippet, regexp_replace(snippet, '\n?\(search: [^)\n]*\)', '', 'g') AS clean FROM s""")
def n21(t: Tables) -> DataFrame:
    s = text.snippet(C("title"), F.expr(NOTE), F.when(C("doc_id") % 2 == 0, "").otherwise("find this"))
    return t("in_docs").select("doc_id", s.alias("snippet"), text.without_search_note(s).alias("clean"))


@query("n22_title_from_slug", r"""WITH x AS (SELECT page_id, url, regexp_replace(url, '/+$', '') AS b FROM in_urls), y AS (SELECT *, replace(replace(replace(string_split(b, '/')[-1], '.html', ''), '.htm', ''), '.pdf', '') AS l FROM x)
SELECT page_id, CASE WHEN trim(translate(l, '-_', '  ')) = '' THEN url ELSE trim(translate(l, '-_', '  ')) END AS title FROM y""")
def n22(t: Tables) -> DataFrame:
    return t("in_urls").select("page_id", urls.slug_title(C("url")).alias("title"))


@query("n23_numbered_list", r"""WITH x AS (SELECT doc_id, regexp_extract_all(title, '[a-zA-Z]+') AS w FROM in_docs)
SELECT doc_id, array_to_string(list_transform(w, lambda v, i: CAST(i AS VARCHAR) || '. ' || v), chr(10)) AS listed, CASE WHEN len(w) = 0 THEN 'No' ELSE array_to_string(list_transform(w, lambda v, i: CAST(i AS VARCHAR) || '. ' || v), chr(10)) END AS quoted FROM x""")
def n23(t: Tables) -> DataFrame:
    w = F.regexp_extract_all(C("title"), F.lit("[a-zA-Z]+"), 0)
    return t("in_docs").select("doc_id", text.numbered_list(w).alias("listed"), text.quote_list(w).alias("quoted"))


@query("n24_slug_id", "SELECT doc_id, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug FROM in_docs")
def n24(t: Tables) -> DataFrame:
    return t("in_docs").select("doc_id", text.slug(C("title")).alias("slug"))


@query("n25_search_url", "SELECT o_orderkey AS id, 'https://x.gov/find?q=' || replace(url_encode(o_orderpriority || ' ~/* é'), '%2F', '/') || '&p=1' AS url FROM orders")
def n25(t: Tables) -> DataFrame:
    return t("orders").select(C("o_orderkey").alias("id"), urls.search_url(F.lit("https://x.gov/find?q={query}&p=1"), F.concat(C("o_orderpriority"), F.lit(" ~/* é"))).alias("url"))


WARN = "concat_ws('; ', status, ' b ', CASE WHEN id % 2 = 0 THEN 'validation: c' END)"


@query("n26_merge_warnings", rf"""WITH x AS (SELECT id, list_filter(list_transform(string_split({WARN}, ';'), lambda v: trim(v)), lambda v: v <> '') AS p FROM in_records)
SELECT id, array_to_string(list_concat(p, list_filter(['b', 'new one'], lambda v: NOT list_contains(p, v))), '; ') AS merged, array_to_string(list_filter(p, lambda v: NOT starts_with(v, 'validation')), '; ') AS stripped FROM x""")
def n26(t: Tables) -> DataFrame:
    old = F.expr(WARN)
    return t("in_records").select("id", text.merge_warnings(old, F.array(F.lit("b"), F.lit("new one"))).alias("merged"), text.without_warnings(old, "^validation").alias("stripped"))


@query("n27_host_and_slug_keys", rf"""WITH {PARTS}, s AS (SELECT page_id, regexp_replace(hst, '^www\.', '') AS host, lower(regexp_replace(string_split(CASE WHEN rtrim(pth, '/') = '' THEN '/' ELSE rtrim(pth, '/') END, '/')[-1], '\.(?:html?|pdf|aspx?)$', '')) AS slug FROM parts)
SELECT page_id, host, slug, CAST(nullif(regexp_extract(slug, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:[^0-9]|$)', 1), '') AS INTEGER) AS year FROM s""")
def n27(t: Tables) -> DataFrame:
    return t("in_urls").select("page_id", urls.host_key(C("url")).alias("host"), urls.slug_key(C("url")).alias("slug"), urls.slug_year(C("url")).alias("year"))


@query("n28_administration", """SELECT o_orderkey AS id, CASE WHEN d >= DATE '2009-01-20' AND d < DATE '2017-01-20' THEN 'Obama Administration' WHEN d >= DATE '2017-01-20' AND d < DATE '2021-01-20' THEN 'Trump Administration'
  WHEN d >= DATE '2021-01-20' AND d < DATE '2025-01-20' THEN 'Biden Administration' WHEN d >= DATE '2025-01-20' AND d < DATE '2033-01-20' THEN 'Trump Administration' END AS administration FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 365 * 20 AS d FROM orders)""")
def n28(t: Tables) -> DataFrame:
    return t("orders").select(C("o_orderkey").alias("id"), coerce.administration(F.date_add(C("o_orderdate").cast("date"), 365 * 20)).alias("administration"))


@query("n29_split_sponsors", "SELECT id, array_to_string(list_transform(regexp_extract_all(sponsors, '(?:[^,\\[]|\\[[^\\]]*\\])+'), lambda v: trim(v)), '|') AS parts FROM in_sponsors")
def n29(t: Tables) -> DataFrame:
    return t("in_sponsors").select("id", F.array_join(bills.split_sponsors(C("sponsors")), "|").alias("parts"))


@query("n30_sponsor_line", r"""WITH f AS (SELECT id, offices, trim(regexp_extract_all(sponsors, '(?:[^,\[]|\[[^\]]*\])+')[1]) AS l FROM in_sponsors), p AS (SELECT id, offices, trim(CASE WHEN contains(l, ' - ') THEN split_part(l, ' - ', 1) ELSE l END) AS name, CASE WHEN contains(l, ' - ') THEN trim(substr(l, instr(l, ' - ') + 3)) ELSE '' END AS rest FROM f),
q AS (SELECT id, offices, name, CASE WHEN contains(rest, '(') AND contains(rest, ')') THEN trim(split_part(rest, '(', 1)) ELSE rest END AS role, CASE WHEN contains(rest, '(') AND contains(rest, ')') THEN trim(split_part(substr(rest, instr(rest, '(') + 1), ')', 1)) ELSE '' END AS details FROM p)
SELECT id, name || CASE WHEN role <> '' THEN ' - ' || role ELSE '' END || CASE WHEN details <> '' THEN ' (' || details || ')' ELSE '' END AS line,
  offices <> 'N/A' AND role = '' AND (contains(offices, 'MMIP Coordinator') OR NOT regexp_matches(lower(offices), 'present|–|-|19|20|speaker of|state representative|state senator')) AS office_is_role FROM q""")
def n30(t: Tables) -> DataFrame:
    part = bills.sponsor_parts(bills.split_sponsors(C("sponsors"))[0])
    s = t("in_sponsors").select("id", "offices", part.alias("p"))
    return s.select("id", bills.sponsor_line(C("p.name"), C("p.role"), C("p.details")).alias("line"), bills.office_is_role(C("offices"), C("p.role")).alias("office_is_role"))


@query("n31_quota_reset", "WITH x AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders), r AS (SELECT id, CASE WHEN day(d) = 1 THEN d ELSE CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) END AS r FROM x) SELECT id, r AS reset, monthname(r) || ' ' || CAST(day(r) AS VARCHAR) || ', ' || CAST(year(r) AS VARCHAR) AS shown FROM r")
def n31(t: Tables) -> DataFrame:
    r = coerce.quota_reset(C("o_orderdate").cast("date"))
    return t("orders").select(C("o_orderkey").alias("id"), r.alias("reset"), coerce.long_date(r).alias("shown"))


ACTION = "CASE o_orderkey % 6 WHEN 0 THEN 'Died in committee' WHEN 1 THEN 'withdrawn' WHEN 2 THEN 'Read twice' ELSE NULL END"


@query("n32_bill_status", f"""SELECT o_orderkey AS id, CASE WHEN regexp_matches(coalesce({ACTION}, ''), '(?i)failed to adopt|failed passage|died in|withdrawn') THEN 'Failed' WHEN o_orderkey % 3 = 1 AND o_orderkey % 13 = 6 THEN 'Failed' WHEN o_orderkey % 3 = 1 THEN 'Passed'
  WHEN DATE '1997-06-30' > make_date(year(o_orderdate), 12, 31) THEN 'Failed' ELSE 'Pending' END AS status FROM orders""")
def n32(t: Tables) -> DataFrame:
    return t("orders").select(C("o_orderkey").alias("id"), bills.status(F.expr(ACTION), (C("o_orderkey") % 3).cast("int"), (C("o_orderkey") % 13).cast("int"), F.year("o_orderdate"), F.lit("1997-06-30").cast("date")).alias("status"))


LAST = "max(struct_pack(n := l_linenumber, d := CAST(CAST(l_shipdate AS DATE) AS VARCHAR), c := l_linestatus, a := l_returnflag))"


@query("n33_latest_action", f"""SELECT l_orderkey AS id, x.d || ' - ' || x.c || ': ' || x.a AS latest, list_extract({list(bills.PROGRESSION)}, 1 + l_orderkey % 13) AS progression,
  CASE l_orderkey % 4 WHEN 0 THEN 'House' WHEN 1 THEN 'Senate' WHEN 2 THEN 'Legislative Body' ELSE 'Unknown' END AS chamber FROM (SELECT l_orderkey, {LAST} AS x FROM lineitem GROUP BY l_orderkey)""")
def n33(t: Tables) -> DataFrame:
    entry = F.struct("l_linenumber", F.to_date("l_shipdate").cast("string").alias("date"), C("l_linestatus").alias("chamber"), C("l_returnflag").alias("action"))
    history = t("lineitem").groupBy(C("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("h"))  # an order's lines, seven at most
    body = F.element_at(F.array(*map(F.lit, "ASLZ")), (C("id") % 4).cast("int") + 1)
    return history.select("id", bills.latest_action(C("h")).alias("latest"), bills.progression(C("id") % 13).alias("progression"), bills.chamber(body).alias("chamber"))


@query("n34_sponsor_names", "SELECT l_orderkey AS id, string_agg('Supplier ' || CAST(l_suppkey AS VARCHAR) || ' (' || l_returnflag || ')', ', ' ORDER BY l_linenumber, l_suppkey, l_returnflag) AS sponsors FROM lineitem GROUP BY 1")
def n34(t: Tables) -> DataFrame:
    people = t("lineitem").groupBy(C("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_returnflag"))).alias("s"))
    return people.select("id", F.array_join(F.transform("s", lambda x: F.format_string("Supplier %d (%s)", x["l_suppkey"], x["l_returnflag"])), ", ").alias("sponsors"))


@query("n35_record_projection", f"SELECT id, coalesce(nullif(trim(state), ''), 'Unknown') AS state, coalesce(nullif(bill_number, ''), 'N/A') AS bill_number, {CHAMBER} AS chamber, name AS title, 'Pending Review' AS review_status, coalesce({ISO}, '2026-01-01') AS last_update FROM in_records")
def n35(t: Tables) -> DataFrame:
    blank = lambda c, d: F.coalesce(F.nullif(F.trim(C(c)), F.lit("")), F.lit(d))
    return t("in_records").select("id", blank("state", "Unknown").alias("state"), blank("bill_number", "N/A").alias("bill_number"), coerce.chamber(C("chamber")).alias("chamber"), C("name").alias("title"), F.lit("Pending Review").alias("review_status"), F.coalesce(coerce.iso_date(C("last_update")), F.lit("2026-01-01")).alias("last_update"))


@query("n36_analysis_columns", """WITH a AS (SELECT id, CASE lower(rtrim(trim(answer), '.')) WHEN 'yes' THEN 'Yes' WHEN 'somewhat' THEN 'Somewhat' ELSE 'No' END AS e, CASE WHEN id % 2 = 0 THEN '' ELSE name END AS x FROM in_records)
SELECT id, e AS inclusive_eval, CASE WHEN e = 'No' THEN 'No' WHEN e = 'Somewhat' AND trim(x) = '' THEN 'Somewhat' ELSE trim(regexp_replace(trim(regexp_replace(trim(x), '(?i)^here is (a |an )?', '')), '(?i)^the following ', '')) END AS inclusive_expl FROM a""")
def n36(t: Tables) -> DataFrame:
    e = coerce.eval_answer(C("answer"))
    return t("in_records").select("id", e.alias("inclusive_eval"), coerce.explanation(e, F.when(C("id") % 2 == 0, "").otherwise(C("name"))).alias("inclusive_expl"))


@query("n37_plain_brackets", "SELECT id, array_to_string(list_transform(regexp_extract_all(sponsors, '(?:\\s*\\([^)]*\\))|(?:[^\\s(]+|\\s+)'), lambda v: CASE WHEN regexp_matches(v, '^\\s*\\(') AND NOT regexp_matches(v, '^\\s*\\([DRI](?:-[A-Z]{2})?\\)') THEN '' ELSE v END), '') AS bare FROM in_sponsors")
def n37(t: Tables) -> DataFrame:
    return t("in_sponsors").select("id", bills.without_plain_brackets(C("sponsors")).alias("bare"))


@query("n38_content_hashes", "SELECT doc_id, sha256(text) AS text_hash, substr(sha256(url || '|' || title || '|' || substr(text, 1, 4000)), 1, 16) AS cache_key FROM in_docs")
def n38(t: Tables) -> DataFrame:
    key = F.sha2(F.concat_ws("|", "url", "title", F.substring("text", 1, 4000)), 256)
    return t("in_docs").select("doc_id", F.sha2("text", 256).alias("text_hash"), F.substring(key, 1, 16).alias("cache_key"))


@query("n39_page_urls", rf"""WITH {PARTS}, n AS (SELECT page_id, url, qry, pth, greatest(1, coalesce(CAST(nullif(regexp_extract('&' || qry, '(?i)&(?:page|pageno|pagenum|pagenumber|pg|p)=([0-9]+)(?:&|$)', 1), '') AS INTEGER), CAST(nullif(regexp_extract(pth, '(?i)/page/([0-9]+)/?$', 1), '') AS INTEGER), 1)) AS page FROM parts)
SELECT page_id, page, CASE WHEN contains('&' || qry, '&page=') THEN regexp_replace(url, 'page=[0-9]+', 'page=' || CAST(page + 1 AS VARCHAR)) WHEN regexp_matches(pth, '(?i)/page/[0-9]+/?$') THEN regexp_replace(url, '(?i)(/page/)[0-9]+(/?)$', '\1' || CAST(page + 1 AS VARCHAR) || '\2') ELSE '' END AS next FROM n""")
def n39(t: Tables) -> DataFrame:
    page = urls.page_number(C("url"))
    return t("in_urls").select("page_id", page.alias("page"), urls.page_url(C("url"), page + 1).alias("next"))


@query("n40_progress_bar", """WITH x AS (SELECT o_orderkey AS id, o_orderkey % 41 AS c, o_orderkey % 37 AS n FROM orders), y AS (SELECT id, n, least(c, n) AS c, CASE WHEN n > 0 THEN (32 * least(c, n)) // n ELSE 0 END AS f FROM x)
SELECT id, CASE WHEN n <= 0 THEN '[' || repeat('?', 32) || ']' WHEN f >= 32 THEN '[' || repeat('=', 32) || ']' ELSE '[' || repeat('=', f) || '>' || repeat(' ', 31 - f) || ']' END AS bar FROM y""")
def n40(t: Tables) -> DataFrame:
    return t("orders").select(C("o_orderkey").alias("id"), coerce.bar(C("o_orderkey") % 41, C("o_orderkey") % 37).alias("bar"))


# -- classifiers -----------------------------------------------------------------------------------------

#: A lexicon of words that the documents have.
LEXICON = {"acronyms": ("loser", "vequ"), "groups": ("heed", "thor", "oux", "schaft", "ciones"), "harms": ("tint", "ander", "eaux", "ungen", "mente")}
SCREEN = "(regexp_matches(lower({0}), 'loser|vequ') OR (regexp_matches(lower({0}), 'heed|thor|oux|schaft|ciones') AND regexp_matches(lower({0}), 'tint|ander|eaux|ungen|mente')))"


@query("p1_keyword_prescreen", f"SELECT doc_id, {SCREEN.format('text')} AS hit FROM documents")
def p1(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", text.keyword_prescreen(C("text"), **LEXICON).alias("hit"))


SHAPE = rf"""{PARTS}, seg AS (SELECT *, lower(coalesce(list_filter(string_split(pth, '/'), lambda s: s <> '')[-1], '')) AS seg FROM parts), stem AS (SELECT *, regexp_replace(seg, '\.[^.]*$', '') AS stem FROM seg),
shape AS (SELECT page_id, CASE WHEN u = '' THEN 'url_empty' WHEN sch NOT IN ('http', 'https') THEN 'url_not_http' WHEN hst = '' THEN 'url_no_host'
  WHEN regexp_matches('&' || qry, '(?i)&(?:{'|'.join(urls.SEARCH_KEYS)})=[ +]*[^ +&]') OR regexp_matches(stem, '{'|'.join(urls.SEARCH_WORDS)}') OR list_contains(regexp_split_to_array(stem, '[-_.]'), 'search') THEN 'url_search_page'
  WHEN stem IN ('', 'index', 'home', 'default', 'sitemap', 'search', 'results') THEN 'url_nav_index' ELSE '' END AS code FROM stem)"""


@query("p2_url_shape", f"WITH {SHAPE} SELECT page_id, code FROM shape")
def p2(t: Tables) -> DataFrame:
    return t("in_urls").select("page_id", urls.shape_code(C("url")).alias("code"))


def document_code(body, url, title, least: int = 600, lexicon: dict = LEXICON):
    """Why a page's text can't be used: doc_empty, doc_search_results, doc_too_short, doc_no_evidence; '' if it can. Register and justice pages may be short, if title and text together pass the screening."""
    length, backed = text.visible_length(body), F.lower(url).contains("justice.gov") | F.lower(url).contains("federalregister.gov/documents/")
    whole = F.when(backed, F.concat_ws("\n", title, body)).otherwise(body)
    hit = text.keyword_prescreen(whole, **lexicon)
    return F.when(length == 0, "doc_empty").when(F.substring(text.one_spaced(body), 1, 600).rlike(text.SEARCH_MARKERS), "doc_search_results").when((length < least) & ~(backed & hit), "doc_too_short").when(~hit, "doc_no_evidence").otherwise("")


CASES = "SELECT doc_id, title, CASE doc_id % 5 WHEN 0 THEN 'https://www.justice.gov/opa/x' ELSE url END AS url, CASE doc_id % 11 WHEN 0 THEN '   ' WHEN 1 THEN concat('Search  results for: ', text) ELSE text END AS text FROM in_docs"
GUARD = f"""c AS ({CASES}), g AS (SELECT *, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n, contains(url, 'justice.gov') AS backed FROM c), h AS (SELECT *, {SCREEN.format("CASE WHEN backed THEN title || chr(10) || text ELSE text END")} AS hit FROM g),
guarded AS (SELECT doc_id, url, CASE WHEN n = 0 THEN 'doc_empty' WHEN regexp_matches(substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 600), '(?i)search results?\\s+for\\b') THEN 'doc_search_results' WHEN n < 600 AND NOT (backed AND hit) THEN 'doc_too_short' WHEN NOT hit THEN 'doc_no_evidence' ELSE '' END AS code FROM h)"""


def _cases(t: Tables) -> DataFrame:
    return t("in_docs").select("doc_id", "title", F.when(C("doc_id") % 5 == 0, "https://www.justice.gov/opa/x").otherwise(C("url")).alias("url"), F.when(C("doc_id") % 11 == 0, "   ").when(C("doc_id") % 11 == 1, F.concat(F.lit("Search  results for: "), C("text"))).otherwise(C("text")).alias("text"))


@query("p3_document_text", f"WITH {GUARD} SELECT doc_id, code FROM guarded")
def p3(t: Tables) -> DataFrame:
    return _cases(t).select("doc_id", document_code(C("text"), C("url"), C("title")).alias("code"))


@query("p4_screen_candidate", f"WITH {GUARD}, s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'url_search_page' ELSE code END AS code FROM guarded) SELECT code, count(*) AS n FROM s GROUP BY code")
def p4(t: Tables) -> DataFrame:
    url = F.when(C("doc_id") % 7 == 0, F.concat(C("url"), F.lit("?q=x"))).otherwise(C("url"))
    d = _cases(t).withColumn("url", url)
    shape = urls.shape_code(C("url"))
    return d.select(F.when(shape != "", shape).otherwise(document_code(C("text"), C("url"), C("title"))).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


JUNK = {"omnibus": "omnibus|thor", "appropriations": "appropriation|heed", "budget_act": "budget act|ander", "leading": "^the"}


@query("p5_junk_title_flags", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(title, '(?i){p}') THEN '{k}' END" for k, p in JUNK.items()) + "], lambda v: v IS NOT NULL), ',') AS flags FROM in_docs")
def p5(t: Tables) -> DataFrame:
    flags = F.array_compact(F.array(*(F.when(C("title").rlike(f"(?i){p}"), k) for k, p in JUNK.items())))
    return t("in_docs").select("doc_id", F.array_join(flags, ",").alias("flags"))


@query("p6_title_nexus", "SELECT doc_id, regexp_matches(lower(title), 'loser|the of') OR (contains(lower(title), 'the') AND regexp_matches(lower(title), 'thor|tint')) AS nexus FROM in_docs")
def p6(t: Tables) -> DataFrame:
    return t("in_docs").select("doc_id", (text.contains_any(C("title"), ("loser", "the of")) | (text.contains_any(C("title"), ("the",)) & text.contains_any(C("title"), ("thor", "tint")))).alias("nexus"))


LAW = "CASE doc_id % 4 WHEN 0 THEN concat('Section 1. Find. ', substr(text, 1, 300), ' Sec. 2 Act. ', substr(text, 301, 900), ' SECTION 1. again') WHEN 1 THEN concat(substr(text, 1, 100), ' article  7 ', substr(text, 101, 300)) WHEN 2 THEN concat(substr(text, 1, 50), ' chapter x ', substr(text, 51, 200)) ELSE text END"
START = r"coalesce(nullif(length(regexp_extract(s, '(?is)^(.*?)\bsec(?:tion)?\.?\s*2\b', 0)) - length(regexp_extract(s, '(?is)^.*?(\bsec(?:tion)?\.?\s*2\b)', 1)) + 1, 1), nullif(length(regexp_extract(s, '(?is)^(.*?)\bchapter\s+[0-9]+', 0)) - length(regexp_extract(s, '(?is)^.*?(\bchapter\s+[0-9]+)', 1)) + 1, 1), nullif(length(regexp_extract(s, '(?is)^(.*?)\barticle\s+[0-9]+', 0)) - length(regexp_extract(s, '(?is)^.*?(\barticle\s+[0-9]+)', 1)) + 1, 1), CASE WHEN instr(lower(s), 'chapter ') > 1 THEN instr(lower(s), 'chapter ') END, CASE WHEN instr(lower(s), 'article ') > 1 THEN instr(lower(s), 'article ') END, 0)"


@query("p7_findings_and_operative", rf"""WITH x AS (SELECT doc_id, {LAW} AS s FROM documents), y AS (SELECT doc_id, s, {START} AS b FROM x), z AS (SELECT *, substr(s, greatest(b, 1)) AS o FROM y), r AS (SELECT *, length(regexp_extract(substr(o, 13), '(?is)^(.*?)\bsection\s+1\.?\b', 1)) AS cut, regexp_matches(substr(o, 13), '(?i)\bsection\s+1\.?\b') AS again FROM z)
SELECT doc_id, md5(CASE WHEN b > 0 THEN substr(s, 1, b - 1) ELSE s END) AS findings, md5(CASE WHEN again THEN substr(o, 1, 12 + cut) ELSE o END) AS operative FROM r""")
def p7(t: Tables) -> DataFrame:
    s = t("documents").select("doc_id", F.expr(LAW).alias("s"))
    return s.select("doc_id", F.md5(text.findings_text(C("s"))).alias("findings"), F.md5(text.operative_text(C("s"))).alias("operative"))


def operative_code(body, title, phrases=("thor and", "heed the", "ander"), enforcement=("wasing", "tion of the"), junk=JUNK):
    """Why a law's text has no operative part on the subject: junk_title, findings_only, no_operative; '' if it has."""
    op, found = text.operative_text(body), text.findings_text(body)
    signal, early, force = text.contains_any(op, phrases), text.contains_any(found, phrases), text.contains_any(op, enforcement)
    flagged = F.lit(False)
    for p in junk.values():
        flagged = flagged | title.rlike(f"(?i){p}")
    return F.when(signal | (force & text.contains_any(body, phrases)), "").when(flagged, "junk_title").when(early & ~signal & ~force, "findings_only").when(text.keyword_prescreen(body, **LEXICON) & ~text.keyword_prescreen(op, **LEXICON) & ~force, "no_operative").otherwise("")


SPLIT = rf"""x AS (SELECT doc_id, title, {LAW} AS s FROM in_docs), y AS (SELECT *, {START} AS b FROM x), z AS (SELECT *, substr(s, greatest(b, 1)) AS o FROM y),
cut AS (SELECT *, CASE WHEN regexp_matches(substr(o, 13), '(?i)\bsection\s+1\.?\b') THEN substr(o, 1, 12 + length(regexp_extract(substr(o, 13), '(?is)^(.*?)\bsection\s+1\.?\b', 1))) ELSE o END AS op, CASE WHEN b > 0 THEN substr(s, 1, b - 1) ELSE s END AS early FROM z),
signals AS (SELECT *, regexp_matches(lower(op), 'thor and|heed the|ander') AS signal, regexp_matches(lower(early), 'thor and|heed the|ander') AS before, regexp_matches(lower(op), 'wasing|tion of the') AS force, regexp_matches(lower(s), 'thor and|heed the|ander') AS anywhere FROM cut)"""
GATE = f"""gate AS (SELECT *, CASE WHEN signal OR (force AND anywhere) THEN '' WHEN regexp_matches(title, '(?i){'|'.join(JUNK.values())}') THEN 'junk_title' WHEN before AND NOT signal AND NOT force THEN 'findings_only'
  WHEN {SCREEN.format("s")} AND NOT {SCREEN.format("op")} AND NOT force THEN 'no_operative' ELSE '' END AS code FROM signals)"""


@query("p8_operative_signals", f"WITH {SPLIT} SELECT doc_id, signal AS operative, before AND NOT signal AS findings_only, force AS enforcement FROM signals")
def p8(t: Tables) -> DataFrame:
    s = t("in_docs").select("doc_id", F.expr(LAW).alias("s"))
    op, found = text.operative_text(C("s")), text.findings_text(C("s"))
    phrases = ("thor and", "heed the", "ander")
    return s.select("doc_id", text.contains_any(op, phrases).alias("operative"), (text.contains_any(found, phrases) & ~text.contains_any(op, phrases)).alias("findings_only"), text.contains_any(op, ("wasing", "tion of the")).alias("enforcement"))


@query("p9_operative_gate", f"WITH {SPLIT}, {GATE} SELECT doc_id, code FROM gate")
def p9(t: Tables) -> DataFrame:
    return t("in_docs").select("doc_id", operative_code(F.expr(LAW), C("title")).alias("code"))


@query("p10_bill_text_guard", f"WITH {SPLIT}, {GATE}, n AS (SELECT *, length(trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS n FROM gate) SELECT doc_id, CASE WHEN n = 0 THEN 'doc_empty' WHEN n < 200 THEN 'doc_too_short' WHEN NOT {SCREEN.format('s')} THEN 'doc_no_evidence' ELSE code END AS code FROM n")
def p10(t: Tables) -> DataFrame:
    s = t("in_docs").select("doc_id", "title", F.expr(LAW).alias("s"))
    n = text.visible_length(C("s"))
    return s.select("doc_id", F.when(n == 0, "doc_empty").when(n < 200, "doc_too_short").when(~text.keyword_prescreen(C("s"), **LEXICON), "doc_no_evidence").otherwise(operative_code(C("s"), C("title"))).alias("code"))


@query("p12_relevance_gate", f"""WITH m AS (SELECT doc_id, {SCREEN.format('text')} AS hit, n_chars % 3 <> 0 AS yes, (n_chars % 100) / 100.0 AS conf FROM documents)
SELECT doc_id, hit AND yes AND conf >= 0.6 AS relevant, CASE WHEN NOT hit THEN 'prescreen_fail' WHEN NOT yes THEN 'llm' WHEN conf < 0.6 THEN 'confidence_fail' ELSE 'llm' END AS stage FROM m""")
def p12(t: Tables) -> DataFrame:
    from tessella.plans.screening import relevance

    model = lambda d: d.withColumn("is_relevant", C("n_chars") % 3 != 0).withColumn("confidence", (C("n_chars") % 100) / 100.0)
    return relevance(t("documents"), C("text"), model, lexicon=LEXICON).select("doc_id", "relevant", "stage")


@query("p13_bot_wall", "SELECT page_id, length(html) < 200 OR contains(lower(html), 'access denied') OR (length(html) < 8000 AND regexp_matches(lower(html), 'captcha|track\\(0\\)|just a moment')) AS walled FROM pages")
def p13(t: Tables) -> DataFrame:
    low = F.lower("html")
    return t("pages").select("page_id", ((F.length("html") < 200) | low.contains("access denied") | ((F.length("html") < 8000) & low.rlike(r"captcha|track\(0\)|just a moment"))).alias("walled"))


ANCHOR = "CASE doc_id % 6 WHEN 0 THEN 'Read More' WHEN 1 THEN '2026-27' WHEN 2 THEN url WHEN 3 THEN 'view PDF' ELSE title END"
WEAK = rf"(trim(a) = '' OR regexp_matches(lower(trim(a)), '^https?://') OR regexp_matches(trim(a), '{text.FILLER}') OR length(regexp_replace(trim(a), '[^\p{{L}}]', '', 'g')) < 40)"


@query("p14_weak_anchor", f"WITH x AS (SELECT doc_id, {ANCHOR} AS a FROM in_docs) SELECT doc_id, {WEAK} AS weak FROM x")
def p14(t: Tables) -> DataFrame:
    return t("in_docs").select("doc_id", text.weak_anchor(F.expr(ANCHOR)).alias("weak"))


@query("p16_fetch_document", f"""WITH x AS (SELECT doc_id, {ANCHOR} AS a, CASE doc_id % 3 WHEN 0 THEN 'proclamation' WHEN 1 THEN 'executive_order' ELSE 'other' END AS k, url || CASE doc_id % 2 WHEN 0 THEN '.pdf' ELSE '' END AS link FROM in_docs)
SELECT doc_id, k <> 'other' AND (regexp_matches(a, '(?i)\\b(?:executive\\s+order|proclamation|administrative\\s+order|declaration|emergency\\s+proclamation)\\b') OR ({WEAK} AND regexp_matches(link, '(?i)\\.pdf(?:$|[?#])|/assets/|view\\?doc=|executive[- ]order|/eo[-/]|/documents/'))) AS fetch FROM x""")
def p16(t: Tables) -> DataFrame:
    kind = F.when(C("doc_id") % 3 == 0, "proclamation").when(C("doc_id") % 3 == 1, "executive_order").otherwise("other")
    link = F.concat(C("url"), F.when(C("doc_id") % 2 == 0, ".pdf").otherwise(""))
    return t("in_docs").select("doc_id", text.fetch_document(kind, F.expr(ANCHOR), link).alias("fetch"))


@query("p17_domain_allowed", rf"WITH {PARTS}, h AS (SELECT page_id, regexp_replace(hst, '^www\.', '') AS h FROM parts) SELECT page_id, h IN ('example.gov', 'justice.gov') OR h LIKE '%.example.gov' OR h LIKE '%.justice.gov' AS allowed FROM h")
def p17(t: Tables) -> DataFrame:
    return t("in_urls").select("page_id", urls.domain_allowed(C("url"), ["example.gov", "justice.gov"]).alias("allowed"))


@query("p19_link_kind", "SELECT doc_id, CASE WHEN regexp_matches(lower(title || ' ' || url), 'order|proclam|thor') THEN 'order' WHEN regexp_matches(lower(title), '^(?:home|about|the)\\b') THEN 'nav' ELSE 'other' END AS kind FROM in_docs")
def p19(t: Tables) -> DataFrame:
    both = F.lower(F.concat_ws(" ", "title", "url"))
    return t("in_docs").select("doc_id", F.when(both.rlike("order|proclam|thor"), "order").when(F.lower("title").rlike(r"^(?:home|about|the)\b"), "nav").otherwise("other").alias("kind"))


@query("p20_record_doc_type", "WITH x AS (SELECT id, regexp_matches(lower(name), 'thor|order') AS a, contains(lower(url), '/2019') AS b, regexp_matches(lower(name), '^the|day') AS c FROM in_records) SELECT id, CASE WHEN c THEN 'proclamation' WHEN b THEN 'order' WHEN a THEN 'order' ELSE 'other' END AS kind, array_to_string(list_filter([CASE WHEN a THEN 'title' END, CASE WHEN b THEN 'url' END, CASE WHEN c THEN 'day' END], lambda v: v IS NOT NULL), '+') AS reasons FROM x")
def p20(t: Tables) -> DataFrame:
    a, b, c = F.lower("name").rlike("thor|order"), F.lower("url").contains("/2019"), F.lower("name").rlike("^the|day")
    return t("in_records").select("id", F.when(c, "proclamation").when(a | b, "order").otherwise("other").alias("kind"), F.array_join(F.array_compact(F.array(F.when(a, "title"), F.when(b, "url"), F.when(c, "day"))), "+").alias("reasons"))


@query("p21_document_type", r"""WITH x AS (SELECT doc_id, url, CASE doc_id % 6 WHEN 0 THEN 'WHEREAS ' WHEN 1 THEN 'A PROCLAMATION. ' WHEN 2 THEN 'Be it enacted. ' WHEN 3 THEN 'Resolved, ' WHEN 4 THEN 'Press release. ' ELSE '' END || text AS s FROM in_docs), f AS (SELECT doc_id, lower(substr(s, 1, 3000)) AS h, regexp_matches(substr(s, 1, 8000), '(?i)be it enacted|an act relating|section \d+|shall be codified|new section|amended to read|insert the following') AS b8,
  regexp_matches(substr(s, 1, 3000), '(?i)be it enacted|an act relating|section \d+|shall be codified|new section|amended to read|insert the following') AS b3, regexp_matches(substr(s, 1, 3000), '(?i)proclamation|awareness day|by the president|executive order|whereas|resolved|urges congress|memorializing|honoring the lives') AS p FROM x)
SELECT doc_id, CASE WHEN p AND NOT b3 THEN CASE WHEN contains(h, 'proclamation') THEN 'proclamation' WHEN contains(h, 'resolved') THEN 'resolution' ELSE 'proclamation/commemorative' END WHEN b8 THEN 'bill' WHEN contains(h, 'press release') THEN 'press_release' ELSE 'unknown' END AS kind FROM f""")
def p21(t: Tables) -> DataFrame:
    from tessella.operators.adjudicate import document_type

    k = C("doc_id") % 6
    body = F.concat(F.when(k == 0, "WHEREAS ").when(k == 1, "A PROCLAMATION. ").when(k == 2, "Be it enacted. ").when(k == 3, "Resolved, ").when(k == 4, "Press release. ").otherwise(""), C("text"))
    return t("in_docs").select("doc_id", document_type(F.lit(""), body, C("url")).alias("kind"))


@query("p22_national_document", "SELECT page_id, contains(lower(url), 'federalregister.gov') OR contains(lower(url), 'whitehouse.gov') OR (regexp_matches(lower(url), '^[ ]*https?://[^/]*justice\\.gov') AND NOT regexp_matches(lower(url), 'justice\\.gov/usao-[a-z0-9-]+') AND contains(lower(url), '/opa/')) AS national FROM in_urls")
def p22(t: Tables) -> DataFrame:
    from tessella.functions.places import is_national

    return t("in_urls").select("page_id", is_national(C("url"), F.lit("")).alias("national"))


@query("p23_category_domain", f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform({CATS}, lambda v: lower(trim(v))), lambda v: NOT list_contains(list_transform({KNOWN}, lambda k: lower(k)), v)))), '|') AS unknown FROM in_records")
def p23(t: Tables) -> DataFrame:
    given = F.transform(coerce.category_tokens(C("categories")), lambda x: F.lower(F.trim(x)))
    return t("in_records").select("id", F.array_join(F.array_sort(F.array_except(given, F.array(*(F.lit(c.lower()) for c in coerce.CATEGORIES)))), "|").alias("unknown"))


@query("p24_mangled_categories", "SELECT id FROM in_records WHERE len(list_filter(string_split(categories, ','), lambda v: regexp_matches(trim(v), '^[\\[''\"]|[\\]''\"]$'))) > 0")
def p24(t: Tables) -> DataFrame:
    return t("in_records").where(F.exists(F.split("categories", ","), lambda c: F.trim(c).rlike("""^[\\['"]|[\\]'"]$"""))).select("id")


@query("p25_junk_rows", "SELECT id FROM in_records WHERE (trim(status) = '' OR trim(state) = '') AND id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def p25(t: Tables) -> DataFrame:
    junk = t("in_records").where((F.trim("status") == "") | (F.trim("state") == "")).select("id")
    return junk.join(t("labels").where("quality = 1").select(C("doc_id").alias("id")), "id", "left_anti")


@query("p26_risk_cohort", "SELECT id, CASE WHEN NOT contains(url, 'legiscan.com/AK') AND bill_number = '' THEN 'high_risk' WHEN contains(url, 'legiscan.com/AK') AND bill_number <> '' THEN 'control' ELSE 'other' END AS cohort FROM in_records")
def p26(t: Tables) -> DataFrame:
    ours, numbered = C("url").contains("legiscan.com/AK"), C("bill_number") != ""
    return t("in_records").select("id", F.when(~ours & ~numbered, "high_risk").when(ours & numbered, "control").otherwise("other").alias("cohort"))


@query("p27_quota_error", "SELECT event_id, regexp_matches(lower(event_type || ' ' || props), 'overlimit|query limit|monthly limit|quota|click') AS limited FROM events")
def p27(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.lower(F.concat_ws(" ", "event_type", "props")).rlike("overlimit|query limit|monthly limit|quota|click").alias("limited"))


@query("p28_soft_404", rf"""WITH {PARTS} SELECT p.page_id, CASE WHEN rtrim(p.pth, '/') <> '' AND i.page_id % 5 = 0 THEN 'homepage_redirect' WHEN length(i.html) < 2000 THEN 'tiny_body' WHEN regexp_matches(lower(substr(i.html, 1, 3000)), 'page not found|404') THEN 'soft_404' ELSE 'ok' END AS class FROM parts p JOIN pages i USING (page_id)""")
def p28(t: Tables) -> DataFrame:
    both = t("in_urls").join(t("pages").select("page_id", "html"), "page_id")
    final = F.when(C("page_id") % 5 == 0, "/").otherwise("/x")
    moved = (F.regexp_replace(urls.path(C("url")), "/+$", "") != "") & (F.regexp_replace(final, "/+$", "") == "")
    return both.select("page_id", F.when(moved, "homepage_redirect").when(F.length("html") < 2000, "tiny_body").when(F.lower(F.substring("html", 1, 3000)).rlike("page not found|404"), "soft_404").otherwise("ok").alias("class"))


@query("p29_source_rules", "SELECT id, CASE WHEN method = 'search' AND hits = 0 THEN 'search needs queries' WHEN max_pages < 1 OR max_pages > 25 THEN 'max_pages out of range' WHEN NOT regexp_matches(url, '^https?://') THEN 'url required' ELSE '' END AS error FROM in_sources")
def p29(t: Tables) -> DataFrame:
    return t("in_sources").select("id", F.when((C("method") == "search") & (C("hits") == 0), "search needs queries").when(~C("max_pages").between(1, 25), "max_pages out of range").when(~C("url").rlike("^https?://"), "url required").otherwise("").alias("error"))


@query("p30_government_domain", rf"WITH {PARTS} SELECT page_id, hst LIKE '%.gov' OR hst LIKE '%.us' AS government, contains(hst, 'legiscan') AS blocked FROM parts")
def p30(t: Tables) -> DataFrame:
    h = urls.host(C("url"))
    return t("in_urls").select("page_id", (h.endswith(".gov") | h.endswith(".us")).alias("government"), h.contains("legiscan").alias("blocked"))


@query("p31_federal_pending", "SELECT id FROM in_records WHERE upper(trim(state)) IN ('NATIONAL', 'US', 'FEDERAL') AND review_status = 'Pending Review'")
def p31(t: Tables) -> DataFrame:
    return t("in_records").where(F.upper(F.trim("state")).isin("NATIONAL", "US", "FEDERAL") & (C("review_status") == "Pending Review")).select("id")


@query("p32_input_urls", r"SELECT page_id, trim(u) AS url, regexp_matches(trim(u), '^https?://[^/ ]+\.[^/ ]+') AS valid FROM (SELECT page_id, unnest(regexp_split_to_array(trim(url) || ', not-a-url', '[,\s]+')) AS u FROM pages) WHERE u <> ''")
def p32(t: Tables) -> DataFrame:
    each = t("pages").select("page_id", F.explode(F.split(F.concat(F.trim("url"), F.lit(", not-a-url")), r"[,\s]+")).alias("url")).where("url <> ''")
    return each.select("page_id", "url", C("url").rlike(r"^https?://[^/ ]+\.[^/ ]+").alias("valid"))


#: Boolean searches: alternatives of conjunctions of phrases.
SEARCHES = {"one": (("the of",),), "two": (("loser",), ("idiot",), ("vequ",)), "three": (("heed", "thor"), ("heed", "tint"))}


@query("p33_boolean_queries", "SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), 'the of') THEN 'one' END, CASE WHEN regexp_matches(lower(text), 'loser|idiot|vequ') THEN 'two' END, CASE WHEN contains(lower(text), 'heed') AND (contains(lower(text), 'thor') OR contains(lower(text), 'tint')) THEN 'three' END], lambda v: v IS NOT NULL), ',') AS matched FROM documents")
def p33(t: Tables) -> DataFrame:
    from functools import reduce

    each = [F.when(reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (text.contains_any(C("text"), (p,)) for p in both)) for both in any_of)), name) for name, any_of in SEARCHES.items()]
    return t("documents").select("doc_id", F.array_join(F.array_compact(F.array(*each)), ",").alias("matched"))
