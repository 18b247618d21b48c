"""Queries of joins, aggregates, windows, set operations and change capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import bills, coerce, text, urls
from tessella.operators import changes, identity, work
from tessella.sources import stores

from .registry import Tables, query
from .scalar_queries import NORM, STOP

C = F.col
RX = r"'^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?'"


def normal(url: str) -> str:
    """The oracle's normal form of an http(s) URL expression with a host."""
    path = rf"rtrim(regexp_replace(regexp_extract(trim({url}), {RX}, 3), ';[^/]*$', ''), '/')"
    return rf"('https://' || regexp_replace(lower(regexp_extract(trim({url}), {RX}, 2)), '^www\.', '') || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN regexp_extract(trim({url}), {RX}, 4) <> '' THEN '?' || regexp_extract(trim({url}), {RX}, 4) ELSE '' END)"


BATCH = rf"b AS (SELECT *, {normal('url')} AS norm, CASE WHEN trim(state) <> '' THEN upper(trim(state)) || '|' || regexp_replace(upper(bill_number), '\s+', '', 'g') END AS bill FROM in_batch)"


def _known(t: Tables) -> tuple[DataFrame, DataFrame]:
    pages = t("pages").where("page_id % 3 = 1").select("url", F.lit(None).cast("string").alias("link"))
    other = t("pages").where("page_id % 10 = 0").select(F.concat(F.lit(" "), "url", F.lit("/")).alias("url"), "url", F.lit("AK").alias("state"), F.concat(F.lit("Hb  "), (C("page_id") % 60).cast("string")).alias("bill_number")).toDF("url", "link", "state", "bill_number")
    return identity.known_urls([pages, other], ["url", "link"]), identity.known_bills([other], "state", "bill_number")


@query("j1_not_known", f"WITH {BATCH}, k AS (SELECT {normal('url')} AS norm FROM pages WHERE page_id % 3 = 1 OR page_id % 10 = 0), kb AS (SELECT 'AK|HB' || CAST(page_id % 60 AS VARCHAR) AS bill FROM pages WHERE page_id % 10 = 0) SELECT ord FROM b WHERE norm NOT IN (SELECT norm FROM k) AND (bill IS NULL OR bill NOT IN (SELECT bill FROM kb))")
def j1(t: Tables) -> DataFrame:
    return identity.not_known(t("in_batch"), *_known(t)).select("ord")


def folded(rows: str, order: str, x: str, y: str) -> str:
    """The sequential rule: f(own, suppressed), a row after another, with the keys of those that were let in."""
    hit = f"(coalesce(list_contains(f.xs, n.{x}), false) OR coalesce(list_contains(f.ys, n.{y}), false))"
    kept = lambda held, key: f"CASE WHEN {hit} THEN f.{held} ELSE list_append(f.{held}, n.{key}) END"
    return f"""n AS (SELECT *, row_number() OVER (ORDER BY {order}) AS i FROM {rows}), f AS (
      SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS own, CAST([] AS VARCHAR[]) AS xs, CAST([] AS VARCHAR[]) AS ys, false AS suppressed
      UNION ALL SELECT n.i, n.{order}, {kept('xs', x)}, {kept('ys', y)}, {hit} FROM f JOIN n ON n.i = f.i + 1)"""


@query("j2_within_run", f"WITH RECURSIVE {BATCH}, {folded('b', 'ord', 'norm', 'bill')} SELECT own AS ord, suppressed FROM f WHERE i > 0")
def j2(t: Tables) -> DataFrame:
    return identity.within_run(t("in_batch"), "ord").select("ord", "suppressed")


@query("j3_url_exists", "SELECT ord FROM in_batch WHERE url IN (SELECT url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url || '/' FROM pages WHERE page_id % 8 = 0)")
def j3(t: Tables) -> DataFrame:
    p = t("pages")
    known = p.where("page_id % 2 = 0").select("url").union(p.where("page_id % 8 = 0").select(F.concat("url", F.lit("/"))))
    return t("in_batch").join(known, "url", "left_semi").select("ord")


REASON = "CASE WHEN s.url IS NULL THEN 'new' WHEN s.status IN ('rejected', 'approved', 'pending', 'analyzed') THEN 'already_' || s.status WHEN b.change_hash <> '' AND s.change_hash <> '' AND b.change_hash <> s.change_hash THEN 'change_hash_updated' WHEN b.content_hash <> '' AND s.content_hash <> '' AND b.content_hash <> s.content_hash THEN 'content_hash_updated' ELSE 'already_seen' END"


@query("p11_should_process", f"WITH j AS (SELECT ord, {REASON} AS reason FROM in_batch b LEFT JOIN in_seen s ON lower(trim(b.url)) = s.url) SELECT ord, reason, reason NOT LIKE 'already%' AS process FROM j")
def p11(t: Tables) -> DataFrame:
    return identity.process_reason(t("in_batch"), t("in_seen")).select("ord", "reason", "process")


@query("j4_seen_lookup", "WITH j AS (SELECT b.ord, s.status, s.external_id FROM in_batch b LEFT JOIN in_seen s ON lower(trim(b.url)) = s.url) SELECT * FROM j")
def j4(t: Tables) -> DataFrame:
    s = t("in_seen").select(C("url").alias("u"), C("status").alias("seen_status"), C("external_id"))
    return t("in_batch").join(s, F.lower(F.trim("url")) == C("u"), "left").select("ord", C("seen_status").alias("status"), "external_id")


SESSIONS = "SELECT s_suppkey AS session_id, n_name AS state, 1990 + s_suppkey % 5 AS y0, 1993 + s_suppkey % 5 AS y1 FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@query("j5_session_lookup", f"WITH s AS ({SESSIONS}) SELECT o_orderkey AS id, min(session_id) AS session_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN s ON n_name = state AND year(o_orderdate) BETWEEN y0 AND y1 GROUP BY 1")
def j5(t: Tables) -> DataFrame:
    n = t("nation")
    s = t("supplier").join(F.broadcast(n), C("s_nationkey") == C("n_nationkey")).select(C("s_suppkey").alias("session_id"), C("n_nationkey").alias("state"), F.explode(F.sequence((C("s_suppkey") % 5 + 1990).cast("int"), (C("s_suppkey") % 5 + 1993).cast("int"))).alias("year"))
    first = s.groupBy("state", "year").agg(F.min("session_id").alias("session_id"))
    o = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), C("o_custkey") == C("c_custkey")).select(C("o_orderkey").alias("id"), C("c_nationkey").alias("state"), F.year("o_orderdate").alias("year"))
    return o.join(first, ["state", "year"], "left").select("id", "session_id")


@query("j6_administration_range", "WITH a AS (SELECT * FROM (VALUES (DATE '1992-01-01', DATE '1994-01-01', 'A'), (DATE '1994-01-01', DATE '1997-06-30', 'B'), (DATE '1997-06-30', DATE '2001-01-01', 'A')) v(lo, hi, name)) SELECT o_orderkey AS id, name FROM orders LEFT JOIN a ON CAST(o_orderdate AS DATE) >= lo AND CAST(o_orderdate AS DATE) < hi")
def j6(t: Tables) -> DataFrame:
    d = C("o_orderdate").cast("date")
    day = lambda s: F.lit(s).cast("date")
    name = F.when((d >= day("1992-01-01")) & (d < day("1994-01-01")), "A").when((d >= day("1994-01-01")) & (d < day("1997-06-30")), "B").when((d >= day("1997-06-30")) & (d < day("2001-01-01")), "A")
    return t("orders").select(C("o_orderkey").alias("id"), name.alias("name"))


@query("j7_master_list", "SELECT l_orderkey AS id, l_linenumber AS line, o_orderstatus AS status FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def j7(t: Tables) -> DataFrame:
    return t("lineitem").join(t("orders").select("o_orderkey", C("o_orderstatus").alias("status")), C("l_orderkey") == C("o_orderkey"), "left").select(C("l_orderkey").alias("id"), C("l_linenumber").alias("line"), "status")


RESOLVED = """WITH r AS (SELECT id, url, upper(trim(state)) AS st, regexp_replace(regexp_replace(upper(bill_number), '[^A-Z0-9]', '', 'g'), '^([A-Z]+)0*([0-9]+)$', '\\1\\2') AS no, regexp_extract(url, 'com/([A-Z]+)/', 1) AS us, regexp_extract(url, 'bill/HB([0-9]+)', 1) AS un, CAST(regexp_extract(url, '/([0-9]{4})$', 1) AS INTEGER) AS uy FROM in_records),
s AS (SELECT lower(url) AS url, min(CAST(id AS VARCHAR)) AS b FROM in_records WHERE id % 11 = 0 GROUP BY 1), sb AS (SELECT upper(regexp_extract(url, 'com/([a-z]+)/', 1)) AS s, 'HB' || regexp_extract(url, 'bill/hb([0-9]+)', 1) AS n, arg_min(b, url) AS b FROM s GROUP BY 1, 2),
m AS (SELECT CAST(o_orderkey % 97 AS VARCHAR) AS n, CAST(min(o_orderkey) AS VARCHAR) AS b FROM orders GROUP BY 1), h AS (SELECT CAST(o_orderkey % 97 AS VARCHAR) AS n, CAST(min(o_orderkey) AS VARCHAR) AS b FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)
SELECT id, coalesce(s.b, sb.b, m.b, h.b) AS bill_id, CASE WHEN s.b IS NOT NULL THEN 'seen_url' WHEN sb.b IS NOT NULL THEN 'seen_bill' WHEN m.b IS NOT NULL THEN 'master_list' WHEN h.b IS NOT NULL THEN 'search' END AS via
FROM r LEFT JOIN s ON lower(r.url) = s.url LEFT JOIN sb ON st = sb.s AND no = sb.n LEFT JOIN m ON us = 'AK' AND un = m.n AND uy BETWEEN 2018 AND 2020 LEFT JOIN h ON st = 'NM' AND no = 'SB' || h.n"""


@query("j8_bill_resolution", RESOLVED)
def j8(t: Tables) -> DataFrame:
    r = t("in_records").select("id", "url", "state", "bill_number")
    seen = r.where("id % 11 = 0").select(F.lower("url").alias("url"), "state", C("id").cast("string").alias("external_id"))
    seen = identity.first_rows(seen, ["url"], C("external_id"))
    master = t("orders").select(F.lit("AK").alias("state"), F.concat(F.lit("HB"), (C("o_orderkey") % 97).cast("string")).alias("number"), F.lit(2018).alias("year_start"), F.lit(2020).alias("year_end"), C("o_orderkey").alias("bill_id"), C("o_orderkey").alias("ord"))
    hits = t("orders").where("o_orderkey % 5 = 0").select(F.lit("NM").alias("state"), F.concat(F.lit("SB "), (C("o_orderkey") % 97).cast("string")).alias("number"), C("o_orderkey").alias("bill_id"), C("o_orderkey").alias("ord"))
    return identity.resolve_bill(r, seen, master, hits).select("id", "bill_id", "via")


ROSTER = "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Sen. ' ELSE '' END || 'Ann ' || c_mktsegment || CAST(c_custkey % 50 AS VARCHAR) AS name, CASE c_custkey % 4 WHEN 0 THEN 'N/A' ELSE c_mktsegment || CAST(c_custkey % 9 AS VARCHAR) END AS ethnicity FROM customer"


def _roster(t: Tables) -> DataFrame:
    name = F.concat(F.when(C("c_custkey") % 3 == 0, "Sen. ").otherwise(""), F.lit("Ann "), C("c_mktsegment"), (C("c_custkey") % 50).cast("string"))
    return t("customer").select(C("c_custkey").alias("id"), name.alias("name"), F.when(C("c_custkey") % 4 == 0, "N/A").otherwise(F.concat("c_mktsegment", (C("c_custkey") % 9).cast("string"))).alias("ethnicity"))


KEYED = f"r AS ({ROSTER}), k AS (SELECT *, regexp_replace(lower(regexp_replace(name, '^Sen\\. ', '')), '\\s+', '', 'g') AS key FROM r)"


@query("j10_roster_twins", f"WITH {KEYED} SELECT a.id, count(*) AS twins FROM k a JOIN k b ON a.key = b.key AND a.id <> b.id GROUP BY a.id")
def j10(t: Tables) -> DataFrame:
    k = _roster(t).select("id", bills.roster_key(C("name")).alias("key"))
    n = k.groupBy("key").agg(F.count("*").alias("n"))
    return k.join(n, "key").where("n > 1").select("id", (C("n") - 1).alias("twins"))


@query("j11_sidecar_overlay", f"WITH {KEYED}, o AS (SELECT key, min(id) AS i FROM k WHERE id % 17 = 0 GROUP BY key), e AS (SELECT key, min(id) AS i FROM k WHERE id % 5 = 0 GROUP BY key) SELECT id, CASE WHEN o.i IS NOT NULL THEN 'override' || CAST(o.i AS VARCHAR) WHEN ethnicity <> 'N/A' THEN ethnicity WHEN e.i IS NOT NULL THEN 'enriched' || CAST(e.i AS VARCHAR) END AS ethnicity FROM k LEFT JOIN o USING (key) LEFT JOIN e USING (key)")
def j11(t: Tables) -> DataFrame:
    k = _roster(t).withColumn("key", bills.roster_key(C("name")))
    o = k.where("id % 17 = 0").groupBy("key").agg(F.concat(F.lit("override"), F.min("id").cast("string")).alias("o"))
    e = k.where("id % 5 = 0").groupBy("key").agg(F.concat(F.lit("enriched"), F.min("id").cast("string")).alias("e"))
    return k.join(o, "key", "left").join(e, "key", "left").select("id", F.coalesce("o", F.nullif("ethnicity", F.lit("N/A")), "e").alias("ethnicity"))


@query("j12_office_state", "SELECT page_id, CASE WHEN page_id % 9 = 3 THEN 'usao-' || lower(n_name) END AS slug, CASE WHEN page_id % 9 = 3 THEN n_name END AS state FROM pages JOIN nation ON n_nationkey = page_id % 25")
def j12(t: Tables) -> DataFrame:
    from tessella.functions.places import office_slug

    n = t("nation").select(F.concat(F.lit("usao-"), F.lower("n_name")).alias("slug"), C("n_name").alias("state"), C("n_nationkey"))
    p = t("pages").join(F.broadcast(n.select(C("slug").alias("s"), "n_nationkey")), C("n_nationkey") == C("page_id") % 25)
    p = p.select("page_id", office_slug(F.lit(""), F.when(C("page_id") % 9 == 3, F.upper("s")).otherwise("web")).alias("slug"))
    return p.join(F.broadcast(n.select("slug", "state")), "slug", "left").select("page_id", "slug", "state")


HOST = rf"regexp_replace(lower(regexp_extract(trim(url), {RX}, 2)), '^www\.', '')"


@query("j13_host_suffix", f"WITH s AS (SELECT DISTINCT {HOST} AS h FROM in_urls WHERE page_id % 4 = 0 AND {HOST} <> ''), u AS (SELECT page_id, {HOST} AS h FROM in_urls) SELECT page_id, count(*) AS matches FROM u JOIN s ON u.h = s.h OR u.h LIKE '%.' || s.h GROUP BY page_id")
def j13(t: Tables) -> DataFrame:
    s = t("in_urls").where("page_id % 4 = 0").select(urls.host_key(C("url")).alias("h")).where("h <> ''").distinct()
    u = t("in_urls").select("page_id", F.explode(urls.host_suffixes(C("url"))).alias("h"))
    return u.join(s, "h").groupBy("page_id").agg(F.count("*").alias("matches"))


@query("j14_crawled_index", f"WITH {BATCH} SELECT b.ord, p.page_id % 7 AS page FROM b JOIN pages p ON {normal('p.url')} = b.norm")
def j14(t: Tables) -> DataFrame:
    p = t("pages").select(urls.normalize_url(C("url")).alias("norm"), (C("page_id") % 7).alias("page"))
    return t("in_batch").select("ord", urls.normalize_url(C("url")).alias("norm")).join(p, "norm").select("ord", "page")


@query("j15_snapshot_sides", "SELECT id, CASE WHEN a.id IS NULL THEN 'before' WHEN b.id IS NULL THEN 'after' ELSE 'both' END AS side FROM (SELECT DISTINCT id FROM in_old) b FULL JOIN (SELECT DISTINCT id FROM in_new) a USING (id)")
def j15(t: Tables) -> DataFrame:
    return changes.snapshot_sides(t("in_old"), t("in_new"), "id", "bill")


CLASS = r"CASE WHEN o = n THEN 'unchanged' WHEN n = '' THEN 'cleared' WHEN o = '' THEN 'restored' WHEN regexp_matches(o, {0}) AND NOT regexp_matches(n, {0}) THEN 'improved' WHEN regexp_matches(n, {0}) AND NOT regexp_matches(o, {0}) THEN 'regression_noise' ELSE 'changed' END".format(r"'(?i)\bpresent\b|\b(?:19|20)\d\d\b|speaker of|state (?:representative|senator)'")
PAIR = "SELECT id, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN offices ELSE split_part(sponsors, ',', 1) END AS o, CASE id % 3 WHEN 0 THEN offices WHEN 1 THEN split_part(sponsors, ',', 1) ELSE '' END AS n FROM in_sponsors"


@query("j16_sponsorship_changes", f"SELECT {CLASS} AS class, count(*) AS n FROM ({PAIR}) GROUP BY 1")
def j16(t: Tables) -> DataFrame:
    first = F.substring_index("sponsors", ",", 1)
    old = F.when(C("id") % 5 == 0, "").when(C("id") % 5 == 1, C("offices")).otherwise(first)
    new = F.when(C("id") % 3 == 0, C("offices")).when(C("id") % 3 == 1, first).otherwise("")
    return t("in_sponsors").select(changes.sponsorship_class(old, new).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("j17_two_backups", "SELECT n.id, coalesce(nullif(n.progression, ''), o.progression) AS progression, o.id IS NOT NULL AS in_backup, x.o_custkey AS pre FROM in_new n LEFT JOIN in_old o USING (id) LEFT JOIN orders x ON x.o_orderkey = n.id AND x.o_orderkey % 4 = 0")
def j17(t: Tables) -> DataFrame:
    o = t("in_old").select("id", C("progression").alias("p"), F.lit(True).alias("there"))
    x = t("orders").where("o_orderkey % 4 = 0").select(C("o_orderkey").alias("id"), C("o_custkey").alias("pre"))
    j = t("in_new").join(o, "id", "left").join(x, "id", "left")
    return j.select("id", F.coalesce(F.nullif("progression", F.lit("")), "p").alias("progression"), F.coalesce("there", F.lit(False)).alias("in_backup"), "pre")


@query("j18_state_names", "SELECT c_custkey AS id, n_name AS state FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j18(t: Tables) -> DataFrame:
    return t("customer").join(F.broadcast(t("nation")), C("c_nationkey") == C("n_nationkey")).select(C("c_custkey").alias("id"), C("n_name").alias("state"))


@query("j19_host_or_sample", f"WITH u AS (SELECT page_id, url, {HOST} AS h FROM in_urls), s AS (SELECT id, {HOST} AS h, url FROM in_sources), p AS (SELECT page_id, id FROM u JOIN s ON u.h = s.h UNION SELECT page_id, id FROM u JOIN s ON page_id % 50 = id % 50 AND page_id % 3 = 0) SELECT page_id, count(*) AS sources FROM p GROUP BY 1")
def j19(t: Tables) -> DataFrame:
    u, s = t("in_urls").select("page_id", urls.host_key(C("url")).alias("h"), (C("page_id") % 50).alias("k")), t("in_sources").select("id", urls.host_key(C("url")).alias("h"), (C("id") % 50).alias("k"))
    by_host = u.join(s.select("id", "h"), "h").select("page_id", "id")
    by_sample = u.where("page_id % 3 = 0").join(s.select("id", "k"), "k").select("page_id", "id")
    return by_host.union(by_sample).distinct().groupBy("page_id").agg(F.count("*").alias("sources"))


@query("j20_seeded_districts", "SELECT n_name AS district, coalesce(max(s_suppkey), -1) AS seed, CASE WHEN max(s_suppkey) IS NULL THEN 'template' ELSE 'seed' END AS origin FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def j20(t: Tables) -> DataFrame:
    s = t("supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.max("s_suppkey").alias("m"))
    return t("nation").join(s, C("n_nationkey") == C("s_nationkey"), "left").select(C("n_name").alias("district"), F.coalesce("m", F.lit(-1)).cast("long").alias("seed"), F.when(C("m").isNull(), "template").otherwise("seed").alias("origin"))


@query("j21_ground_truth", "SELECT n.id, o.id IS NULL AS missing, coalesce(o.status <> n.status, false) AS status_wrong, coalesce(o.last_update <> n.last_update, false) AS date_wrong FROM in_new n LEFT JOIN in_old o USING (id)")
def j21(t: Tables) -> DataFrame:
    o = t("in_old").select(C("id").alias("oid"), C("status").alias("s"), C("last_update").alias("d"))
    j = t("in_new").join(o, C("id") == C("oid"), "left")
    return j.select("id", C("oid").isNull().alias("missing"), F.coalesce(C("s") != C("status"), F.lit(False)).alias("status_wrong"), F.coalesce(C("d") != C("last_update"), F.lit(False)).alias("date_wrong"))


# -- aggregates ------------------------------------------------------------------------------------------


@query("ag1_source_status_counts", "SELECT source, status, count(*) AS n FROM in_seen GROUP BY 1, 2")
def ag1(t: Tables) -> DataFrame:
    return t("in_seen").groupBy("source", "status").agg(F.count("*").alias("n")).orderBy("source", "status")


@query("ag2_relabel_plan", "SELECT CASE source WHEN 'legiscan' THEN 'LegiScan' WHEN 'federal_site' THEN 'Federal Site' ELSE source END AS canonical, source, count(*) AS n FROM in_seen GROUP BY 1, 2")
def ag2(t: Tables) -> DataFrame:
    label = F.when(C("source") == "legiscan", "LegiScan").when(C("source") == "federal_site", "Federal Site").otherwise(C("source"))
    return t("in_seen").groupBy("source").agg(F.count("*").alias("n")).select(label.alias("canonical"), "source", "n").orderBy(F.desc("n"), "source")


@query("ag3_class_summary", "SELECT n_name AS state, c_mktsegment AS class, count(*) AS n, count(DISTINCT c_acctbal) AS distinct_urls FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)")
def ag3(t: Tables) -> DataFrame:
    j = t("customer").join(F.broadcast(t("nation")), C("c_nationkey") == C("n_nationkey")).select(C("n_name").alias("state"), C("c_mktsegment").alias("class"), "c_acctbal")
    return j.rollup("state", "class").agg(F.count("*").alias("n"), F.countDistinct("c_acctbal").alias("distinct_urls"))


@query("ag4_top_hosts", f"SELECT {HOST} AS host, count(*) AS n FROM in_urls GROUP BY 1 ORDER BY n DESC, host LIMIT 10")
def ag4(t: Tables) -> DataFrame:
    return t("in_urls").groupBy(urls.host_key(C("url")).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(10)


@query("ag5_gap_counters", "SELECT source, count(*) AS records, count(*) FILTER (trim(state) = '') AS no_state, count(*) FILTER (bill_number = '') AS no_number, count(*) FILTER (last_update = '') AS no_date, count(*) FILTER (trim(chamber) = '') AS no_chamber, count(*) FILTER (categories = '') AS no_categories FROM in_records GROUP BY 1")
def ag5(t: Tables) -> DataFrame:
    blank = lambda c, n: F.count_if(F.trim(c) == "").alias(n)
    return t("in_records").groupBy("source").agg(F.count("*").alias("records"), blank("state", "no_state"), blank("bill_number", "no_number"), blank("last_update", "no_date"), blank("chamber", "no_chamber"), blank("categories", "no_categories"))


@query("ag6_critic_summary", "SELECT event_type AS cohort, count(*) AS n, round_even(count(*) FILTER (value > 50) * 1.0 / count(*), 3) AS grounded_rate FROM events GROUP BY 1")
def ag6(t: Tables) -> DataFrame:
    rate = F.bround(F.count_if(C("value") > 50).cast("double") / F.count("*"), 3)
    return t("events").groupBy(C("event_type").alias("cohort")).agg(F.count("*").alias("n"), rate.alias("grounded_rate"))


@query("ag7_unpivot_counts", "SELECT field, value, count(*) AS n FROM (SELECT 'flag' AS field, l_returnflag AS value FROM lineitem UNION ALL SELECT 'status', l_linestatus FROM lineitem) GROUP BY 1, 2")
def ag7(t: Tables) -> DataFrame:
    return t("lineitem").select(F.expr("stack(2, 'flag', l_returnflag, 'status', l_linestatus) AS (field, value)")).groupBy("field", "value").agg(F.count("*").alias("n"))


@query("ag8_year_coverage", "WITH y AS (SELECT c_nationkey AS state, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT state, array_to_string(list_sort(list(y)), ',') AS covered, array_to_string(list_filter(range(1992, 1999), lambda v: NOT list_contains(list(y), v)), ',') AS missing FROM y GROUP BY state")
def ag8(t: Tables) -> DataFrame:
    o = t("orders").join(t("customer"), C("o_custkey") == C("c_custkey")).select(C("c_nationkey").alias("state"), F.year("o_orderdate").alias("y"))
    g = o.groupBy("state").agg(F.array_sort(F.collect_set("y")).alias("have"))
    every = F.sequence(F.lit(1992), F.lit(1998))
    return g.select("state", F.array_join(C("have").cast("array<string>"), ",").alias("covered"), F.array_join(F.array_except(every, "have").cast("array<string>"), ",").alias("missing"))


@query("ag9_domain_samples", f"WITH u AS (SELECT page_id, url, {HOST} AS host FROM in_urls), d AS (SELECT host, url, min(page_id) AS ord, count(*) AS c FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ord) AS place FROM d) SELECT host, CAST(sum(c) AS BIGINT) AS n, string_agg(url, ' ' ORDER BY ord) FILTER (place <= 5) AS samples FROM r GROUP BY host")
def ag9(t: Tables) -> DataFrame:
    d = t("in_urls").withColumn("host", urls.host_key(C("url"))).groupBy("host", "url").agg(F.min("page_id").alias("ord"), F.count("*").alias("c"))
    n = d.groupBy("host").agg(F.sum("c").alias("n"))
    few = d.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("ord"))).where("place <= 5")
    s = few.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "url"))), lambda x: x["url"]), " ").alias("samples"))
    return n.join(s, "host")


@query("ag10_seed_aggregation", "SELECT s_nationkey AS slug, count(*) AS n, count(DISTINCT url) AS distinct_urls, array_to_string(list_sort(list_distinct(list(content_type))), ',') AS kinds FROM in_sources JOIN supplier ON id = s_suppkey GROUP BY 1")
def ag10(t: Tables) -> DataFrame:
    j = t("in_sources").join(t("supplier"), C("id") == C("s_suppkey"))
    return j.groupBy(C("s_nationkey").alias("slug")).agg(F.count("*").alias("n"), F.countDistinct("url").alias("distinct_urls"), F.array_join(F.array_sort(F.collect_set("content_type")), ",").alias("kinds"))


@query("ag11_domains_per_state", f"SELECT state, array_to_string(list_sort(list_distinct(list({HOST}))), ',') AS domains FROM in_sources GROUP BY state")
def ag11(t: Tables) -> DataFrame:
    return t("in_sources").groupBy("state").agg(F.array_join(F.array_sort(F.collect_set(urls.host_key(C("url")))), ",").alias("domains"))


@query("ag12_merged_tags", "SELECT state, bool_or(method = 'index') AS has_index, bool_or(content_type = 'executive_order') AS has_orders, bool_or(content_type = 'proclamation' AND enabled) AS has_proclamations, bool_or(hits = 0) AS has_dead, coalesce(string_agg(source_id, ',' ORDER BY source_id, id) FILTER (content_type = 'executive_order'), '') AS order_sources FROM in_sources GROUP BY state")
def ag12(t: Tables) -> DataFrame:
    named = F.array_sort(F.collect_list(F.when(C("content_type") == "executive_order", F.struct("source_id", "id"))))
    return t("in_sources").groupBy("state").agg(F.bool_or(C("method") == "index").alias("has_index"), F.bool_or(C("content_type") == "executive_order").alias("has_orders"), F.bool_or((C("content_type") == "proclamation") & C("enabled")).alias("has_proclamations"), F.bool_or(C("hits") == 0).alias("has_dead"), F.array_join(F.transform(named, lambda x: x["source_id"]), ",").alias("order_sources"))


COVER = "WITH c AS (SELECT state, CASE WHEN count(DISTINCT content_type) >= 4 THEN 'FULL' WHEN count(DISTINCT content_type) >= 2 THEN 'PARTIAL' ELSE 'MISSING' END AS level FROM in_sources GROUP BY state) "


@query("ag13_coverage_table", COVER + "SELECT count(*) FILTER (level = 'FULL') AS full_, count(*) FILTER (level = 'PARTIAL') AS partial, count(*) FILTER (level = 'MISSING') AS missing, count(*) AS states FROM c")
def ag13(t: Tables) -> DataFrame:
    return _coverage(t).agg(F.count_if(C("level") == "FULL").alias("full_"), F.count_if(C("level") == "PARTIAL").alias("partial"), F.count_if(C("level") == "MISSING").alias("missing"), F.count("*").alias("states"))


def _coverage(t: Tables) -> DataFrame:
    kinds = t("in_sources").groupBy("state").agg(F.countDistinct("content_type").alias("k"))
    return kinds.select("state", F.when(C("k") >= 4, "FULL").when(C("k") >= 2, "PARTIAL").otherwise("MISSING").alias("level"))


@query("ag14_validate_pass", "SELECT state, count(*) FILTER (enabled) AS passed, count(*) AS total, CAST(sum(hits) AS BIGINT) AS candidates FROM in_sources GROUP BY state")
def ag14(t: Tables) -> DataFrame:
    return t("in_sources").groupBy("state").agg(F.count_if("enabled").alias("passed"), F.count("*").alias("total"), F.sum("hits").alias("candidates"))


@query("ag15_crawl_yield", "SELECT count(*) AS sources, CAST(sum(hits) AS BIGINT) AS hits, count(*) FILTER (hits = 0) AS dead, count(DISTINCT CASE WHEN hits > 0 THEN url END) AS distinct_hits FROM in_sources")
def ag15(t: Tables) -> DataFrame:
    return t("in_sources").agg(F.count("*").alias("sources"), F.sum("hits").alias("hits"), F.count_if(C("hits") == 0).alias("dead"), F.countDistinct(F.when(C("hits") > 0, C("url"))).alias("distinct_hits"))


@query("ag16_roster_merge", f"WITH {KEYED} SELECT key, arg_min(name, id) AS name, coalesce(arg_max(ethnicity, struct_pack(n := length(ethnicity), i := -id)) FILTER (ethnicity <> 'N/A'), 'N/A') AS ethnicity FROM k GROUP BY key")
def ag16(t: Tables) -> DataFrame:
    k = _roster(t).withColumn("key", bills.roster_key(C("name"))).where("key <> ''")
    rich = F.max_by("ethnicity", F.when(C("ethnicity") != "N/A", F.struct(F.length("ethnicity").alias("n"), (-C("id")).alias("i"))))
    return k.groupBy("key").agg(F.min_by("name", "id").alias("name"), F.coalesce(rich, F.lit("N/A")).alias("ethnicity")).orderBy(F.lower("name"))


@query("ag17_sponsor_targets", "WITH s AS (SELECT trim(unnest(regexp_extract_all(sponsors, '(?:[^,\\[]|\\[[^\\]]*\\])+'))) AS name FROM in_sponsors), c AS (SELECT name, count(*) AS n FROM s GROUP BY 1), a AS (SELECT 0 AS seed, name, n FROM c WHERE name = 'Cy' UNION ALL SELECT 1, name, n FROM c WHERE name <> 'Cy') SELECT name, n FROM a ORDER BY seed, n DESC, name LIMIT 30")
def ag17(t: Tables) -> DataFrame:
    c = t("in_sponsors").select(F.explode(bills.split_sponsors(C("sponsors"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return c.withColumn("seed", F.when(C("name") == "Cy", 0).otherwise(1)).orderBy("seed", F.desc("n"), "name").limit(30).select("name", "n")


@query("ag18_name_dictionary", "SELECT DISTINCT trim(p) AS entry FROM (SELECT unnest(string_split(ethnicity, 'U')) AS p FROM (SELECT c_mktsegment || ' ' || CAST(c_custkey % 9 AS VARCHAR) AS ethnicity FROM customer)) WHERE length(trim(p)) > 2")
def ag18(t: Tables) -> DataFrame:
    e = F.concat_ws(" ", "c_mktsegment", (C("c_custkey") % 9).cast("string"))
    return t("customer").select(F.explode(F.split(e, "U")).alias("part")).select(F.trim("part").alias("entry")).where(F.length("entry") > 2).distinct()


@query("ag19_snapshot_metrics", f"SELECT count(*) AS records, count(*) FILTER (n <> '') AS filled, CAST(sum(CASE WHEN n = '' THEN 0 ELSE len(string_split(n, ' ')) END) AS BIGINT) AS entries FROM ({PAIR})")
def ag19(t: Tables) -> DataFrame:
    n = F.when(C("id") % 3 == 0, C("offices")).when(C("id") % 3 == 1, F.substring_index("sponsors", ",", 1)).otherwise("")
    return t("in_sponsors").select(n.alias("n")).agg(F.count("*").alias("records"), F.count_if(C("n") != "").alias("filled"), F.sum(F.when(C("n") == "", 0).otherwise(F.size(F.split("n", " ")))).alias("entries"))


@query("ag20_run_counters", f"WITH j AS (SELECT {REASON} AS reason FROM in_batch b LEFT JOIN in_seen s ON lower(trim(b.url)) = s.url) SELECT reason, count(*) AS n FROM j GROUP BY reason")
def ag20(t: Tables) -> DataFrame:
    return identity.process_reason(t("in_batch"), t("in_seen")).groupBy("reason").agg(F.count("*").alias("n"))


@query("ag21_enrichment_counts", f"SELECT count(*) AS targets, count(*) FILTER (ethnicity = 'N/A') AS missing, count(*) FILTER (ethnicity <> 'N/A' AND length(ethnicity) > 9) AS accepted FROM ({ROSTER})")
def ag21(t: Tables) -> DataFrame:
    return _roster(t).agg(F.count("*").alias("targets"), F.count_if(C("ethnicity") == "N/A").alias("missing"), F.count_if((C("ethnicity") != "N/A") & (F.length("ethnicity") > 9)).alias("accepted"))


@query("ag22_link_kinds", f"WITH u AS (SELECT {HOST} AS host, url, min(page_id) AS ord FROM in_urls GROUP BY 1, 2) SELECT host, count(*) FILTER (url LIKE '%pdf%') AS documents, count(*) FILTER (url LIKE '%search%') AS searches, count(*) AS links FROM u GROUP BY host")
def ag22(t: Tables) -> DataFrame:
    d = t("in_urls").select(urls.host_key(C("url")).alias("host"), "url").distinct()
    return d.groupBy("host").agg(F.count_if(C("url").contains("pdf")).alias("documents"), F.count_if(C("url").contains("search")).alias("searches"), F.count("*").alias("links"))


@query("ag23_accuracy_summary", "SELECT count(*) AS checked, count(*) FILTER (o.status = n.status) AS status_right, count(*) FILTER (o.last_update = n.last_update) AS date_right FROM in_new n JOIN in_old o USING (id)")
def ag23(t: Tables) -> DataFrame:
    o = t("in_old").select("id", C("status").alias("s"), C("last_update").alias("d"))
    return t("in_new").join(o, "id").agg(F.count("*").alias("checked"), F.count_if(C("s") == C("status")).alias("status_right"), F.count_if(C("d") == C("last_update")).alias("date_right"))


@query("ag24_systemic_gaps", "SELECT content_type, count(*) FILTER (max_pages < 3) AS shallow, count(*) FILTER (NOT enabled) AS disabled, min(CASE WHEN max_pages < 3 THEN source_id END) AS example FROM in_sources GROUP BY 1")
def ag24(t: Tables) -> DataFrame:
    return t("in_sources").groupBy("content_type").agg(F.count_if(C("max_pages") < 3).alias("shallow"), F.count_if(~C("enabled")).alias("disabled"), F.min(F.when(C("max_pages") < 3, C("source_id"))).alias("example"))


@query("ag25_clear_counts", "SELECT count(*) FILTER (o.progression <> '' AND n.progression = '') AS cleared, count(*) FILTER (o.progression <> n.progression AND n.progression <> '') AS changed FROM in_new n JOIN in_old o USING (id)")
def ag25(t: Tables) -> DataFrame:
    o = t("in_old").select("id", C("progression").alias("p"))
    return t("in_new").join(o, "id").agg(F.count_if((C("p") != "") & (C("progression") == "")).alias("cleared"), F.count_if((C("p") != C("progression")) & (C("progression") != "")).alias("changed"))


# -- windows, order, limits ------------------------------------------------------------------------------


@query("w1_first_wins", f"WITH {BATCH} SELECT norm, min(ord) AS ord, arg_min(source, ord) AS source FROM b GROUP BY norm")
def w1(t: Tables) -> DataFrame:
    return identity.first_rows(t("in_batch").select(urls.normalize_url(C("url")).alias("norm"), "ord", "source"), ["norm"], C("ord"))


@query("w2_last_wins", f"WITH {BATCH} SELECT norm, max(ord) AS ord, arg_max(source, ord) AS source FROM b GROUP BY norm")
def w2(t: Tables) -> DataFrame:
    return identity.first_rows(t("in_batch").select(urls.normalize_url(C("url")).alias("norm"), "ord", "source"), ["norm"], F.desc("ord"))


@query("w3_latest_history", "SELECT l_orderkey AS id, CAST(max(l_shipdate) AS DATE) AS latest, count(*) AS actions FROM lineitem GROUP BY 1")
def w3(t: Tables) -> DataFrame:
    return t("lineitem").groupBy(C("l_orderkey").alias("id")).agg(F.to_date(F.max("l_shipdate")).alias("latest"), F.count("*").alias("actions"))


@query("w4_run_cap", "SELECT event_id, event_type = 'purchase' AND count(*) FILTER (event_type = 'purchase') OVER (ORDER BY event_id) > 100 AS over_cap FROM events")
def w4(t: Tables) -> DataFrame:
    return changes.capped(t("events"), C("event_type") == "purchase", "event_id", 100).select("event_id", "over_cap")


@query("w5_source_cap", "SELECT event_id, event_type <> 'view' AND count(*) FILTER (event_type <> 'view') OVER (PARTITION BY user_id ORDER BY event_id) > 2 AS over_cap FROM events")
def w5(t: Tables) -> DataFrame:
    return changes.capped(t("events"), C("event_type") != "view", "event_id", 2, by=["user_id"]).select("event_id", "over_cap")


@query("w6_page_repeat_stop", "WITH f AS (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id, role) AS first_turn FROM conversations), p AS (SELECT conv_id, turn, bool_or(first_turn = turn) AS fresh FROM f GROUP BY 1, 2) SELECT conv_id, min(turn) AS stop FROM p WHERE NOT fresh GROUP BY 1")
def w6(t: Tables) -> DataFrame:
    c = t("conversations").select("conv_id", "turn", "role")
    first = c.groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"))
    fresh = c.join(first, ["conv_id", "role"]).groupBy("conv_id", "turn").agg(F.bool_or(C("first_turn") == C("turn")).alias("fresh"))
    return fresh.where(~C("fresh")).groupBy("conv_id").agg(F.min("turn").alias("stop"))


@query("w7_circuit_breaker", "WITH r AS (SELECT event_id, count(*) FILTER (value <= 99) OVER (ORDER BY event_id) AS bad, count(*) FILTER (value > 99) OVER (ORDER BY event_id) AS good FROM events), s AS (SELECT min(event_id) AS stop FROM r WHERE bad >= 2 AND good = 0) SELECT event_id FROM r, s WHERE stop IS NULL OR event_id <= stop")
def w7(t: Tables) -> DataFrame:
    return changes.breaker(t("events"), "event_id", C("value") > 99).select("event_id")


@query("w8_keep_newest", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p <= 3")
def w8(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t("events").select("user_id", "event_id", F.row_number().over(w).alias("p")).where("p <= 3").drop("p")


@query("o1_ranked_report", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 ORDER BY n DESC, source, lang LIMIT 25")
def o1(t: Tables) -> DataFrame:
    return t("documents").groupBy("source", "lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "lang").limit(25)


@query("o2_longest_first_dictionary", "SELECT doc_id, nullif(regexp_extract(lower(text), '\\b(thereof|there|then|the|then)\\b', 1), '') AS entry FROM documents")
def o2(t: Tables) -> DataFrame:
    words = sorted({"then", "the", "thereof", "there"}, key=lambda w: (-len(w), w))
    return t("documents").select("doc_id", F.nullif(F.regexp_extract(F.lower("text"), rf"\b({'|'.join(words)})\b", 1), F.lit("")).alias("entry"))


@query("o3_best_by_score", "SELECT c_nationkey AS nation, arg_max(c_custkey, struct_pack(a := c_mktsegment = 'BUILDING', b := c_acctbal > 0, c := c_acctbal, d := -c_custkey)) AS best FROM customer GROUP BY 1")
def o3(t: Tables) -> DataFrame:
    rank = F.struct((C("c_mktsegment") == "BUILDING").alias("a"), (C("c_acctbal") > 0).alias("b"), C("c_acctbal").alias("c"), (-C("c_custkey")).alias("d"))
    return t("customer").groupBy(C("c_nationkey").alias("nation")).agg(F.max_by("c_custkey", rank).alias("best"))


@query("o4_best_title", "SELECT source, arg_max(title, struct_pack(s := s, d := -doc_id)) AS title, max(s) AS score FROM (SELECT *, len(regexp_extract_all(lower(title), 'the|and|of')) AS s FROM in_docs) WHERE s >= 3 GROUP BY 1")
def o4(t: Tables) -> DataFrame:
    s = F.size(F.regexp_extract_all(F.lower("title"), F.lit("the|and|of"), 0)).cast("long")
    return t("in_docs").select("source", "title", "doc_id", s.alias("s")).where("s >= 3").groupBy("source").agg(F.max_by("title", F.struct("s", (-C("doc_id")).alias("d"))).alias("title"), F.max("s").alias("score"))


@query("o5_seeded_sample")
def o5(t: Tables) -> DataFrame:
    return t("in_records").where("review_status = 'Approved'").orderBy(F.xxhash64("id", F.lit(42)), "id").limit(10).select("id")


# -- set operations --------------------------------------------------------------------------------------


@query("st1_candidate_union", "SELECT 0 AS part, page_id AS id, url FROM pages UNION ALL SELECT 1, ord, url FROM in_batch UNION ALL SELECT 2, id, url FROM in_records")
def st1(t: Tables) -> DataFrame:
    one = lambda i, df, key: df.select(F.lit(i).alias("part"), C(key).alias("id"), "url")
    return one(0, t("pages"), "page_id").unionByName(one(1, t("in_batch"), "ord")).unionByName(one(2, t("in_records"), "id"))


@query("st2_manifest_union", f"WITH RECURSIVE k AS (SELECT id, source_id, lower(rtrim(url, '/')) || ' ' || content_type AS place FROM in_sources), {folded('k', 'id', 'source_id', 'place')} SELECT own AS id FROM f WHERE i > 0 AND NOT suppressed")
def st2(t: Tables) -> DataFrame:
    place = F.concat_ws(" ", F.lower(F.regexp_replace("url", "/+$", "")), "content_type")
    return identity.first_of_both(t("in_sources"), "id", C("source_id"), place).where("NOT suppressed").select("id")


@query("st3_added_removed", "SELECT 'added' AS side, id FROM (SELECT id FROM in_new EXCEPT SELECT id FROM in_old) UNION ALL SELECT 'removed', id FROM (SELECT id FROM in_old EXCEPT SELECT id FROM in_new)")
def st3(t: Tables) -> DataFrame:
    a, b = t("in_old").select("id"), t("in_new").select("id")
    return b.subtract(a).select(F.lit("added").alias("side"), "id").union(a.subtract(b).select(F.lit("removed").alias("side"), "id"))


@query("st4_shared", "SELECT id, status FROM in_old INTERSECT SELECT id, status FROM in_new")
def st4(t: Tables) -> DataFrame:
    return t("in_old").select("id", "status").intersect(t("in_new").select("id", "status"))


SIGNIFICANT = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9'']+'), lambda w: length(w) > 3 AND w NOT IN ({STOP})))"


@query("st5_word_overlap", f"WITH w AS (SELECT doc_id, {SIGNIFICANT.format('title')} AS a, {SIGNIFICANT.format('text')} AS b FROM in_docs) SELECT doc_id, CASE WHEN len(a) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) * 1.0 / len(a), 6) END AS overlap FROM w")
def st5(t: Tables) -> DataFrame:
    return t("in_docs").select("doc_id", F.round(text.title_overlap(C("title"), C("text")), 6).alias("overlap"))


@query("st6_missing_states", "SELECT n_name AS state FROM nation WHERE n_name NOT IN (SELECT state FROM in_sources WHERE content_type = 'executive_order')")
def st6(t: Tables) -> DataFrame:
    have = t("in_sources").where("content_type = 'executive_order'").select(C("state").alias("n_name"))
    return t("nation").join(have, "n_name", "left_anti").select(C("n_name").alias("state"))


@query("st7_no_ground_truth", "SELECT string_agg(state, ',' ORDER BY state) AS states, count(*) AS n FROM (SELECT n_name AS state FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900))")
def st7(t: Tables) -> DataFrame:
    have = t("customer").where("c_acctbal > 9900").select(C("c_nationkey").alias("n_nationkey"))
    left = t("nation").join(have, "n_nationkey", "left_anti")
    return left.agg(F.nullif(F.array_join(F.array_sort(F.collect_list("n_name")), ","), F.lit("")).alias("states"), F.count("*").alias("n"))  # states, of which there are few


# -- change capture and workflow -------------------------------------------------------------------------

DIFF = "SELECT id, 'status' AS field, o.status AS old, n.status AS new FROM in_new n JOIN in_old o USING (id) WHERE o.status <> n.status UNION ALL SELECT id, 'progression', o.progression, n.progression FROM in_new n JOIN in_old o USING (id) WHERE o.progression <> n.progression UNION ALL SELECT id, 'last_update', o.last_update, n.last_update FROM in_new n JOIN in_old o USING (id) WHERE o.last_update <> n.last_update AND (o.status <> n.status OR o.progression <> n.progression OR n.last_update >= o.last_update)"


@query("c1_status_changes", DIFF)
def c1(t: Tables) -> DataFrame:
    return changes.field_changes(t("in_old"), t("in_new"), "id", ["status", "progression", "last_update"], "last_update", ("status", "progression"))


@query("c2_change_hash_skip", "SELECT n.id FROM in_new n JOIN in_old o USING (id) WHERE n.id % 3 <> 0 AND md5(n.status || n.progression) = md5(o.status || o.progression)")
def c2(t: Tables) -> DataFrame:
    h = F.md5(F.concat("status", "progression"))
    return t("in_new").where("id % 3 <> 0").select("id", h.alias("h")).join(t("in_old").select("id", h.alias("h")), ["id", "h"], "left_semi").select("id")


MISMATCH = f"CASE WHEN a <> '' AND b <> '' AND a <> b THEN CASE WHEN review_status = 'Live' THEN 'sent_to_pending' ELSE 'flagged' END ELSE 'same' END"


@query("c3_identity_mismatch", f"WITH x AS (SELECT id, review_status, {NORM} AS a, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN {NORM} ELSE 'HB' || CAST(id % 97 AS VARCHAR) END AS b FROM in_records) SELECT id, {MISMATCH} AS action FROM x")
def c3(t: Tables) -> DataFrame:
    a = bills.bill_key_norm(C("bill_number"))
    b = F.when(C("id") % 4 == 0, "").when(C("id") % 4 == 1, C("bill_number")).otherwise(F.concat(F.lit("H.B."), (C("id") % 97).cast("string")))
    b = bills.bill_key_norm(b)
    return t("in_records").select("id", F.when((a != "") & (b != "") & (a != b), F.when(C("review_status") == "Live", "sent_to_pending").otherwise("flagged")).otherwise("same").alias("action"))


@query("c4_refresh_outcomes", """WITH x AS (SELECT CASE WHEN page_id % 4 <> 0 THEN 'skipped_untracked' WHEN page_id % 10 = 0 THEN 'resolve_failed' WHEN page_id % 6 = 2 THEN 'skipped_unchanged_hash' WHEN page_id % 14 = 4 THEN CASE WHEN page_id % 8 = 0 THEN 'mismatch_to_pending' ELSE 'mismatch_flagged' END WHEN page_id % 18 = 8 THEN 'fetch_failed' WHEN page_id % 5 > 1 THEN 'updated' ELSE 'unchanged' END AS outcome FROM pages) SELECT outcome, count(*) AS n FROM x GROUP BY 1""")
def c4(t: Tables) -> DataFrame:
    i = C("page_id")
    r = t("pages").select(
        F.when(i % 4 == 0, "https://legiscan.com/x").otherwise("https://x.gov").alias("url"), F.when(i % 10 != 0, i).alias("bill_id"), F.lit("s").alias("session_id"), F.lit("h1").alias("stored_hash"), F.when(i % 6 == 2, "h1").otherwise("h2").alias("master_hash"),
        F.lit("HB 001").alias("number"), F.when(i % 14 == 4, "HB2").otherwise("hb1").alias("master_number"), (i % 18 != 8).alias("fetched"), F.when(i % 5 > 1, 1).otherwise(0).alias("n_changes"), F.when(i % 8 == 0, "live").otherwise("pending").alias("table"),
    )
    return changes.refresh_outcome(r).groupBy("outcome").agg(F.count("*").alias("n"))


@query("c5_url_repair", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '/canonical' ELSE url END AS url, page_id % 3 = 0 AS repaired FROM pages")
def c5(t: Tables) -> DataFrame:
    canonical = F.when(C("page_id") % 3 == 0, F.concat("url", F.lit("/canonical"))).when(C("page_id") % 3 == 1, C("url")).otherwise("N/A")
    repaired = (canonical != "N/A") & (canonical != C("url"))
    return t("pages").select("page_id", F.when(repaired, canonical).otherwise(C("url")).alias("url"), repaired.alias("repaired"))


ROUTE = "p AS (SELECT id, url || CAST(id % 300 AS VARCHAR) AS url, review_status FROM in_records WHERE id % 2 = 0), l AS (SELECT id, url || CAST(id % 300 AS VARCHAR) AS url, CASE WHEN id % 5 = 0 THEN 'Send Back to Pending' ELSE 'Live' END AS review_status FROM in_records WHERE id % 2 = 1 OR id % 6 = 0)"


@query("c6_approval_routes", f"WITH {ROUTE} SELECT id, url, CASE WHEN url IN (SELECT url FROM l) THEN 'already_live' ELSE 'to_live' END AS action FROM p WHERE review_status = 'Approved' UNION ALL SELECT id, url, CASE WHEN url IN (SELECT url FROM p) THEN 'already_pending' ELSE 'to_pending' END FROM l WHERE review_status = 'Send Back to Pending' UNION ALL SELECT id, url, 'rejected' FROM p WHERE review_status = 'Rejected'")
def c6(t: Tables) -> DataFrame:
    r = t("in_records").withColumn("url", F.concat("url", (C("id") % 300).cast("string")))
    live = r.where("id % 2 = 1 OR id % 6 = 0").withColumn("review_status", F.when(C("id") % 5 == 0, "Send Back to Pending").otherwise("Live"))
    return changes.approval_routes(r.where("id % 2 = 0"), live)


@query("c7_review_projection", "SELECT id, map_from_entries(list_filter([struct_pack(k := 'bill_number', v := bill_number), struct_pack(k := 'chamber', v := chamber), struct_pack(k := 'status', v := status)], lambda e: e.v <> '')) IS NOT NULL AS made, len(list_filter([bill_number, chamber, status], lambda v: v <> '')) AS fields, CASE WHEN contains(lower(url), 'legiscan.com') THEN 'LegiScan' ELSE 'State Site' END AS source FROM in_records")
def c7(t: Tables) -> DataFrame:
    filled = F.map_filter(F.create_map(*(x for c in ("bill_number", "chamber", "status") for x in (F.lit(c), C(c)))), lambda k, v: v != "")
    return t("in_records").select("id", filled.isNotNull().alias("made"), F.size(filled).cast("long").alias("fields"), urls.record_source(C("url"), F.lit("")).alias("source"))


@query("c8_snapshot_diff", "SELECT field, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN o.status <> n.status THEN 'status' END, CASE WHEN o.progression <> n.progression THEN 'progression' END, CASE WHEN o.bill <> n.bill THEN 'bill' END], lambda v: v IS NOT NULL)) AS field FROM in_new n JOIN in_old o USING (id)) GROUP BY 1")
def c8(t: Tables) -> DataFrame:
    return changes.field_changes(t("in_old"), t("in_new"), "id", ["status", "progression", "bill"]).groupBy("field").agg(F.count("*").alias("n"))


@query("c9_sponsorship_class", f"SELECT id, {CLASS} AS class FROM ({PAIR})")
def c9(t: Tables) -> DataFrame:
    first = F.substring_index("sponsors", ",", 1)
    old = F.when(C("id") % 5 == 0, "").when(C("id") % 5 == 1, C("offices")).otherwise(first)
    new = F.when(C("id") % 3 == 0, C("offices")).when(C("id") % 3 == 1, first).otherwise("")
    return t("in_sponsors").select("id", changes.sponsorship_class(old, new).alias("class"))


@query("c10_backfill", "SELECT n.id, coalesce(nullif(n.progression, ''), CASE WHEN n.id % 4 = 0 THEN 'api' END, o.progression, CASE WHEN n.last_update > '1995-01-01' THEN 'term' END) AS value, CASE WHEN n.progression <> '' THEN 'kept' WHEN n.id % 4 = 0 THEN 'api' WHEN o.progression IS NOT NULL THEN 'backup' WHEN n.last_update > '1995-01-01' THEN 'administration' ELSE 'unresolved' END AS via FROM in_new n LEFT JOIN in_old o USING (id)")
def c10(t: Tables) -> DataFrame:
    j = t("in_new").join(t("in_old").select("id", C("progression").alias("backup")), "id", "left")
    api, term = F.when(C("id") % 4 == 0, "api"), F.when(C("last_update") > "1995-01-01", "term")
    value = F.coalesce(F.nullif("progression", F.lit("")), api, C("backup"), term)
    via = F.when(C("progression") != "", "kept").when(api.isNotNull(), "api").when(C("backup").isNotNull(), "backup").when(term.isNotNull(), "administration").otherwise("unresolved")
    return j.select("id", value.alias("value"), via.alias("via"))


@query("c11_quota_inference", "WITH r AS (SELECT user_id, count(*) AS checked, count(*) FILTER (value < 50) AS failed, count(*) FILTER (value > 95) AS updated FROM events GROUP BY 1) SELECT user_id, checked >= 3 AND failed >= 3 AND updated = 0 AS limited FROM r")
def c11(t: Tables) -> DataFrame:
    r = t("events").groupBy("user_id").agg(F.count("*").alias("checked"), F.count_if(C("value") < 50).alias("failed"), F.count_if(C("value") > 95).alias("updated"))
    return r.select("user_id", ((C("checked") >= 3) & (C("failed") >= 3) & (C("updated") == 0)).alias("limited"))


@query("c12_deferred_report", "SELECT user_id, count(*) FILTER (event_type = 'purchase') > 0 OR count(*) > 3 AS send FROM events GROUP BY 1")
def c12(t: Tables) -> DataFrame:
    return t("events").groupBy("user_id").agg(((F.count_if(C("event_type") == "purchase") > 0) | (F.count("*") > 3)).alias("send"))


@query("c13_validation_outcome", "SELECT n.id, CASE WHEN o.progression = n.progression THEN 'unchanged' WHEN n.progression = '' THEN 'cleared' ELSE 'reduced' END AS outcome FROM in_new n JOIN in_old o USING (id)")
def c13(t: Tables) -> DataFrame:
    j = t("in_new").join(t("in_old").select("id", C("progression").alias("p")), "id")
    return j.select("id", F.when(C("p") == C("progression"), "unchanged").when(C("progression") == "", "cleared").otherwise("reduced").alias("outcome"))


@query("c14_roster_guard", "SELECT 'region' AS roster, 'kept_previous' AS outcome, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS ids FROM supplier UNION ALL SELECT 'nation', 'replaced', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation")
def c14(t: Tables) -> DataFrame:
    out = None
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey")):
        at = work.folder(t.spark, "roster")
        stores.write_version(t("supplier").select(C("s_suppkey").cast("long").alias("id")), at)
        done = stores.guarded_replace(t(name).select(C(key).cast("long").alias("id")), at, least_rows=10)
        now = stores.read_version(t.spark, at, "id long").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
        one = now.select(F.lit(name).alias("roster"), F.lit("replaced" if done else "kept_previous").alias("outcome"), "n", "ids")
        out = one if out is None else out.unionByName(one)
    return out


@query("c15_candidate_outcomes", f"WITH {BATCH}, j AS (SELECT b.ord, b.norm, {REASON} AS reason FROM b LEFT JOIN in_seen s ON lower(trim(b.url)) = s.url), k AS (SELECT {normal('url')} AS norm FROM pages WHERE page_id % 10 = 0) SELECT ord, CASE WHEN reason LIKE 'already%' THEN 'skipped_seen' WHEN norm IN (SELECT norm FROM k) THEN 'skipped_duplicate' WHEN ord % 7 = 0 THEN 'rejected' ELSE 'analyze' END AS outcome FROM j")
def c15(t: Tables) -> DataFrame:
    j = identity.process_reason(t("in_batch"), t("in_seen")).withColumn("norm", urls.normalize_url(C("url")))
    k = t("pages").where("page_id % 10 = 0").select(urls.normalize_url(C("url")).alias("norm"), F.lit(True).alias("dup")).distinct()
    return j.join(k, "norm", "left").select("ord", F.when(~C("process"), "skipped_seen").when(C("dup"), "skipped_duplicate").when(C("ord") % 7 == 0, "rejected").otherwise("analyze").alias("outcome"))


@query("c16_reject_and_suppress", "SELECT url, CASE WHEN url IN (SELECT lower(trim(url)) FROM pages WHERE page_id % 11 = 0) THEN 'rejected' ELSE status END AS status FROM in_seen WHERE NOT (status = 'discovered' AND source = 'legiscan')")
def c16(t: Tables) -> DataFrame:
    r = t("pages").where("page_id % 11 = 0").select(F.lower(F.trim("url")).alias("r")).distinct()
    left = t("in_seen").where(~((C("status") == "discovered") & (C("source") == "legiscan")))
    return left.join(r, C("url") == C("r"), "left").select("url", F.when(C("r").isNotNull(), "rejected").otherwise(C("status")).alias("status"))


# -- sinks as relations ----------------------------------------------------------------------------------

UPSERT = """WITH n AS (SELECT lower(trim(url)) AS k, arg_max(source, ord) AS source, arg_max(status, ord) AS status, arg_max(change_hash, ord) AS change_hash, arg_max(content_hash, ord) AS content_hash, arg_max(session_id, ord) FILTER (session_id <> '') AS session_id, arg_max(verdict, ord) FILTER (verdict IS NOT NULL) AS verdict, arg_max(confidence, ord) AS confidence FROM in_batch GROUP BY 1)
SELECT coalesce(n.k, s.url) AS url, coalesce(n.source, s.source) AS source, coalesce(n.status, s.status) AS status, CASE WHEN n.k IS NULL THEN s.change_hash ELSE n.change_hash END AS change_hash, CASE WHEN n.k IS NULL THEN s.content_hash ELSE n.content_hash END AS content_hash, coalesce(n.session_id, s.session_id) AS session_id, coalesce(n.verdict, s.verdict) AS verdict, round(coalesce(n.confidence, s.confidence), 6) AS confidence, coalesce(s.first_seen, 999) AS first_seen, CASE WHEN n.k IS NULL THEN s.last_seen ELSE 999 END AS last_seen FROM in_seen s FULL JOIN n ON s.url = n.k"""


@query("snk1_upsert_seen", UPSERT)
def snk1(t: Tables) -> DataFrame:
    return identity.upsert_seen(t("in_seen"), t("in_batch"), F.lit(999).cast("long")).withColumn("confidence", F.round("confidence", 6))


@query("snk2_update_metadata", "SELECT s.url, coalesce('e' || CAST(b.page_id AS VARCHAR), s.external_id) AS external_id, coalesce(CASE WHEN b.page_id % 2 = 0 THEN 's9' END, s.session_id) AS session_id, CASE WHEN b.page_id IS NULL THEN s.last_seen ELSE 999 END AS last_seen FROM in_seen s LEFT JOIN (SELECT * FROM pages WHERE page_id % 4 < 2) b ON lower(trim(b.url)) = s.url")
def snk2(t: Tables) -> DataFrame:
    p = t("pages").where("page_id % 4 < 2").select("url", F.concat(F.lit("e"), C("page_id").cast("string")).alias("external_id"), F.when(C("page_id") % 2 == 0, "s9").otherwise("").alias("session_id"), F.lit("").alias("change_hash"))
    return identity.update_metadata(t("in_seen"), p, F.lit(999).cast("long")).select("url", "external_id", "session_id", "last_seen")


@query("snk4_document_store", "WITH e AS (SELECT url AS k, html AS t, page_id AS f, CASE WHEN page_id % 2 = 0 THEN page_id END AS b FROM pages UNION ALL SELECT url, 'new', page_id + 1000000000, CASE WHEN page_id % 3 = 0 THEN -page_id END FROM pages WHERE page_id % 5 = 0) SELECT k AS key, md5(arg_max(t, f)) AS text, max(f) AS fetched_at, arg_max(b, f) FILTER (b IS NOT NULL) AS bill_id FROM e WHERE k NOT IN (SELECT url FROM pages WHERE page_id % 13 = 0) GROUP BY k")
def snk4(t: Tables) -> DataFrame:
    i = C("page_id")
    store = t("pages").select(C("url").alias("key"), C("html").alias("text"), i.alias("fetched_at"), F.when(i % 2 == 0, i).alias("bill_id"), F.lit(None).cast("string").alias("doc_id"))
    puts = t("pages").where("page_id % 5 = 0").select(C("url").alias("key"), F.lit("new").alias("text"), (i + 1_000_000_000).alias("fetched_at"), F.when(i % 3 == 0, -i).alias("bill_id"), F.lit(None).cast("string").alias("doc_id"))
    out = identity.latest_documents(store, puts, t("pages").where("page_id % 13 = 0").select(C("url").alias("key")))
    return out.select("key", F.md5("text").alias("text"), "fetched_at", "bill_id")


@query("snk5_report_rows", "SELECT id, CASE WHEN id % 9 = 0 THEN 'Error: timeout' ELSE coalesce(nullif(trim(state), ''), 'Unknown') END AS state, CASE WHEN id % 9 = 0 THEN url ELSE coalesce(name, 'Untitled') END AS title FROM in_records")
def snk5(t: Tables) -> DataFrame:
    error = F.when(C("id") % 9 == 0, "timeout")
    return t("in_records").select("id", F.when(error.isNotNull(), F.concat(F.lit("Error: "), error)).otherwise(F.coalesce(F.nullif(F.trim("state"), F.lit("")), F.lit("Unknown"))).alias("state"), F.when(error.isNotNull(), C("url")).otherwise(F.coalesce("name", F.lit("Untitled"))).alias("title"))


@query("snk9_merged_report", "SELECT user_id, count(*) AS items, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS updated, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (event_type = 'purchase') AS ids FROM events GROUP BY 1")
def snk9(t: Tables) -> DataFrame:
    ids = F.array_sort(F.collect_list(F.when(C("event_type") == "purchase", C("event_id"))))
    return t("events").groupBy("user_id").agg(F.count("*").alias("items"), F.count_if(C("event_type") == "purchase").alias("updated"), F.nullif(F.array_join(ids.cast("array<string>"), ","), F.lit("")).alias("ids"))


@query("snk10_batched_notice", "SELECT o_custkey AS customer, CASE WHEN count(*) > 5 THEN string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderkey) FILTER (p <= 10) || CASE WHEN count(*) > 10 THEN ' and ' || CAST(count(*) - 10 AS VARCHAR) || ' more' ELSE '' END ELSE string_agg(CAST(o_orderkey AS VARCHAR), '; ' ORDER BY o_orderkey) END AS notice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) GROUP BY 1")
def snk10(t: Tables) -> DataFrame:
    o = t("orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("p"))
    g = o.groupBy(C("o_custkey").alias("customer")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(C("p") <= 10, C("o_orderkey")))).cast("array<string>").alias("ids"))
    more = F.when(C("n") > 10, F.concat(F.lit(" and "), (C("n") - 10).cast("string"), F.lit(" more"))).otherwise("")
    return g.select("customer", F.when(C("n") > 5, F.concat(F.array_join("ids", ", "), more)).otherwise(F.array_join("ids", "; ")).alias("notice"))


@query("snk12_schema_diff", "SELECT column_name AS name FROM (VALUES ('doc_id'), ('text'), ('review_status'), ('warnings')) v(column_name) WHERE column_name NOT IN ('doc_id', 'text', 'lang', 'source', 'n_chars')")
def snk12(t: Tables) -> DataFrame:
    wanted = ["doc_id", "text", "review_status", "warnings"]
    return t("documents").sparkSession.createDataFrame([(c,) for c in wanted if c not in t("documents").columns], "name string")
