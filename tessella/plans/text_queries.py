"""Queries of grounding, adjudication, matching, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import bills, coerce, matching, places, text, urls
from tessella.operators import adjudicate, grounding, work
from tessella.sources import fetching, html, payloads, stores
from tessella.streaming import incremental

from .registry import Tables, query
from .scalar_queries import LEXICON, NORM, STOP, document_code

C = F.col
HOST = r"regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^$', '')"
QUOTE = "CASE doc_id % 5 WHEN 0 THEN upper(substr(text, 11, 90)) WHEN 1 THEN concat(substr(text, 1, 70), ' and then something else that is not there at all') WHEN 2 THEN 'nowhere' WHEN 3 THEN '' ELSE concat('“', substr(text, 30, 40), '”') END"


@query("g1_title_overlap", f"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(title || ' zebra'), '[a-z0-9'']+'), lambda w: length(w) > 3 AND w NOT IN ({STOP}))) AS a, regexp_extract_all(lower(text), '[a-z0-9'']+') AS b FROM in_docs)
SELECT doc_id, CASE WHEN len(a) = 0 THEN 0.0 ELSE round(len(list_filter(a, lambda x: list_contains(b, x))) * 1.0 / len(a), 9) END AS overlap FROM w""")
def g1(t: Tables) -> DataFrame:
    return t("in_docs").select("doc_id", F.round(text.title_overlap(F.concat("title", F.lit(" zebra")), C("text")), 9).alias("overlap"))


NUMBERED = "CASE id % 8 WHEN 0 THEN concat('see H. B. 0', CAST(id % 97 AS varchar(20)), ' here') WHEN 1 THEN concat('house hr', CAST(id % 97 AS varchar(20))) WHEN 2 THEN concat('S.', CAST(id % 97 AS varchar(20)), ' x') WHEN 4 THEN concat(CAST(id % 97 AS varchar(20)), ' was read IN ASSEMBLY') WHEN 5 THEN concat('Administrative Order No. ', CAST(id % 97 AS varchar(20))) ELSE 'no number' END"


NUMBER_SQL = rf"""WITH n AS (SELECT id, {NORM} AS n, {NUMBERED} AS body FROM in_records), p AS (SELECT *, regexp_extract(n, '^([A-Z]+)([0-9]+)$', 1) AS l, regexp_extract(n, '^([A-Z]+)([0-9]+)$', 2) AS d, regexp_replace(upper(body), '[^A-Z0-9]', '', 'g') AS hay FROM n),
o AS (SELECT *, CASE l WHEN 'HB' THEN 'HR' WHEN 'HR' THEN 'HB' WHEN 'SB' THEN 'S' WHEN 'S' THEN 'SB' END AS other FROM p), s AS (SELECT *, '(?i)\b' || array_to_string(string_split(l, ''), '\.?\s*') || '\.?\s*0*' || d || '\b' AS one, '(?i)\b' || array_to_string(string_split(other, ''), '\.?\s*') || '\.?\s*0*' || d || '\b' AS two FROM o)
SELECT id, n = '' OR contains(hay, n) OR coalesce(contains(hay, other || d), false) OR (l <> '' AND (regexp_matches(body, one) OR coalesce(regexp_matches(body, two), false)))
  OR (l = 'A' AND (regexp_matches(upper(body), '\b' || d || '\b[^\n]{{0,40}}\bIN ASSEMBLY\b') OR regexp_matches(upper(body), '\bASSEMBLY\b[^\n]{{0,40}}\b' || d || '\b') OR regexp_matches(upper(body), '\bA\.?\s*' || d || '\b')))
  OR (l = 'AO' AND regexp_matches(body, '(?i)\bADMINISTRATIVE\s+ORDER\s+(?:NO\.?\s*)?' || d || '\b')) AS found FROM s"""


@query("g2_number_in_text", NUMBER_SQL.replace("\\\\", "\\"))
def g2(t: Tables) -> DataFrame:
    return t("in_records").select("id", bills.number_in_text(C("bill_number"), F.expr(NUMBERED)).alias("found"))


DATED = "CASE o_orderkey % 6 WHEN 0 THEN concat('signed ', substr(CAST(o_orderdate AS varchar(30)), 1, 10)) WHEN 1 THEN concat('in ', substr(CAST(o_orderdate AS varchar(30)), 1, 4)) WHEN 2 THEN concat(substr(CAST(o_orderdate AS varchar(30)), 6, 2), '/', substr(CAST(o_orderdate AS varchar(30)), 9, 2), '/', substr(CAST(o_orderdate AS varchar(30)), 1, 4)) WHEN 3 THEN 'January 1, 1995' ELSE 'undated' END"


@query("g3_date_grounded", f"SELECT o_orderkey AS id, CASE WHEN NOT contains(s, d[1:4]) THEN false WHEN d[6:] = '01-01' THEN regexp_matches(s, '(?i)january\\s+1\\b|01-01|1/1/' || d[1:4]) ELSE contains(s, d) OR contains(s, d[6:7] || '/' || d[9:10] || '/' || d[1:4]) END AS grounded FROM (SELECT o_orderkey, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS d, {DATED} AS s FROM orders)")
def g3(t: Tables) -> DataFrame:
    return t("orders").select(C("o_orderkey").alias("id"), text.date_grounded(F.substring(C("o_orderdate").cast("string"), 1, 10), F.expr(DATED)).alias("grounded"))


WORDS_SQL = f"list_transform(list_filter(list_transform(regexp_split_to_array(p, '[\\s,;/]+'), lambda w: regexp_replace(w, '[^A-Za-z''-]', '', 'g')), lambda w: length(w) > 3 AND regexp_matches(w, '^[A-Z]') AND lower(w) NOT IN ({STOP})), lambda w: lower(w))"
GENERIC_SQL = ", ".join(f"'{w}'" for w in text.GENERIC_NAMES)


@query("g4_sponsors_grounded", f"""WITH d AS (SELECT doc_id, lower(text) AS t, 'Senator ' || substr(title, 1, 20) || '; Governor; Nobody Elsewhere' AS s FROM in_docs),
e AS (SELECT doc_id, t, i, trim(list_extract(regexp_split_to_array(s, '[,;]'), i)) AS p FROM (SELECT *, unnest(range(1, 1 + len(regexp_split_to_array(s, '[,;]')))) AS i FROM d)), w AS (SELECT *, {WORDS_SQL} AS w FROM e), x AS (SELECT *, list_filter(w, lambda v: v NOT IN ({GENERIC_SQL})) AS own FROM w),
k AS (SELECT *, len(list_filter(CASE WHEN len(own) > 0 THEN own ELSE w END, lambda v: NOT contains(t, v))) = 0 AS ok FROM x) SELECT doc_id, coalesce(string_agg(p, ', ' ORDER BY i) FILTER (ok), '') AS kept FROM k GROUP BY doc_id""")
def g4(t: Tables) -> DataFrame:
    d = t("in_docs").select("doc_id", "text", F.concat(F.lit("Senator "), F.substring("title", 1, 20), F.lit("; Governor; Nobody Elsewhere")).alias("sponsors"))
    people = F.transform(F.split("sponsors", "[,;]"), lambda x: F.trim(x))
    return d.select("doc_id", F.array_join(F.filter(people, lambda p: text.name_grounded(p, C("text"))), ", ").alias("kept"))


@query("g5_chamber_grounded", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN contains(lower(text), 'enacted') WHEN 1 THEN contains(lower(text), 'thor') ELSE true END AS grounded FROM documents")
def g5(t: Tables) -> DataFrame:
    details = F.when(C("doc_id") % 3 == 0, "enacted in 2021").when(C("doc_id") % 3 == 1, "by Thor").otherwise("by the of")
    return t("documents").select("doc_id", F.when(C("doc_id") % 3 == 1, F.contains(F.lower("text"), F.lit("thor"))).otherwise(text.chamber_grounded(details, C("text"))).alias("grounded"))


@query("g6_record_consistency")
def g6(t: Tables) -> DataFrame:
    r = t("in_records").select("id", "name", "bill_number", coerce.iso_date(C("last_update")).alias("last_update"), F.concat(F.initcap(F.substring("text", 1, 15)), F.lit(", Nobody Elsewhere")).alias("sponsors"), F.lit("enacted").alias("chamber_details"), F.lit("2024 Regular Session").alias("session"), F.when(C("id") % 3 == 0, "LegiScan").when(C("id") % 3 == 1, "Federal Site").otherwise("State Site").alias("record_source"), "text", "url")
    out = grounding.consistency(r, document_code(C("text"), C("url"), C("name")))
    return out.select("id", "blocking_code", F.size("warnings").cast("long").alias("warnings"), "bill_number", "last_update", "sponsors", "session")


@query("n11_normalized_text")
def n11(t: Tables) -> DataFrame:
    return t("in_docs").select("doc_id", F.md5(matching.normalized(C("text"))).alias("normal"))


@query("g7_quote_in_source")
def g7(t: Tables) -> DataFrame:
    d = t("in_docs").select("doc_id", F.expr(QUOTE).alias("quote"), C("text").alias("body"))
    return matching.quotes_in_source(d, "quote", "body").select("doc_id", "in_source")


@query("g8_best_span")
def g8(t: Tables) -> DataFrame:
    d = t("in_docs").select("doc_id", F.expr(QUOTE).alias("quote"), C("text").alias("body"))
    return d.select("doc_id", matching.source_span("quote", "body").alias("span"))


@query("g9_contained_span", "SELECT doc_id, trim(substr(text, 1, instr(substr(text, 21), ' ') + 19)) AS span FROM documents WHERE instr(substr(text, 21), ' ') > 1 AND regexp_matches(substr(text, 1, 60), '^[A-Za-z]+ [a-z ]+$')")
def g9(t: Tables) -> DataFrame:
    d = t("documents").where("instr(substr(text, 21), ' ') > 1").where(F.substring("text", 1, 60).rlike("^[A-Za-z]+ [a-z ]+$"))
    first = F.trim(F.expr("substr(text, 1, instr(substr(text, 21), ' ') + 19)"))
    return d.select("doc_id", matching.source_span(F.upper(first), C("text")).alias("span"))


@query("g10_repaired_quotes")
def g10(t: Tables) -> DataFrame:
    d = t("in_docs").select("doc_id", F.posexplode(F.array(F.upper(F.substring("text", 1, 40)), F.lit("made up quote without source"))).alias("i", "quote"), C("text").alias("body"))
    s = d.select("doc_id", "i", "quote", matching.source_span("quote", "body").alias("span"))
    g = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("span", "quote").alias("q"), C("span").isNull().alias("lost")))).alias("l"))
    return g.select("doc_id", F.array_join(F.transform("l", lambda x: x["q"]), " | ").alias("quotes"), F.size(F.filter("l", lambda x: x["lost"])).cast("long").alias("unanchored"))


@query("g12_quote_establishes", "WITH q AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'The office shall establish a program' WHEN 1 THEN 'currently investing in training' WHEN 2 THEN 'an Annual Report is due' ELSE title END AS q FROM in_docs) SELECT doc_id, regexp_matches(lower(q), 'shall (establish|create|implement|develop|submit|maintain|report|appoint)|is created|are created|must develop|directs the|annual report') AS establishes, regexp_matches(lower(q), 'has developed|has launched|currently|we are|created a new unit|investing in|expanding funding') AS mentions FROM q")
def g12(t: Tables) -> DataFrame:
    q = F.when(C("doc_id") % 4 == 0, "The office shall establish a program").when(C("doc_id") % 4 == 1, "currently investing in training").when(C("doc_id") % 4 == 2, "an Annual Report is due").otherwise(C("title"))
    return t("in_docs").select("doc_id", adjudicate.says(q, adjudicate.PHRASES.obliges).alias("establishes"), adjudicate.says(q, adjudicate.PHRASES.recounts).alias("mentions"))


def _cases(t: Tables) -> DataFrame:
    k = C("doc_id")
    quotes = F.when(k % 6 == 0, F.array(F.lit("The office shall establish a task force"))).when(k % 6 == 1, F.array(F.lit("currently we run a training"))).when(k % 6 == 2, F.array(F.lit("E:\\BILLS\\H1 page"), F.lit("x"))).when(k % 6 == 3, F.array(F.lit("oversight and audit"))).when(k % 6 == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("nothing of that kind")))
    kind = F.when(k % 5 == 0, "proclamation").when(k % 5 == 1, "bill").otherwise("unknown")
    answer = F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "Somewhat").otherwise("No")
    return t("documents").select("doc_id", quotes.alias("quotes"), kind.alias("kind"), answer.alias("answer"), (k % 7 != 0).alias("grounded"))


ADJUDICATED = """WITH c AS (SELECT doc_id, doc_id % 6 AS q, CASE WHEN doc_id % 5 = 0 THEN 'p' WHEN doc_id % 5 = 1 THEN 'b' ELSE 'u' END AS k, CASE WHEN doc_id % 4 = 0 THEN 'Yes' WHEN doc_id % 4 = 1 THEN 'Somewhat' ELSE 'No' END AS a, doc_id % 7 <> 0 AS g FROM documents)
SELECT doc_id, CASE WHEN a = 'Yes' AND q = 4 THEN 'review' WHEN a = 'Yes' OR q = 4 THEN NULL WHEN q = 2 THEN 'clear_expl' WHEN NOT g THEN 'clear_expl'
  WHEN k = 'p' THEN CASE WHEN q = 0 THEN 'flip_eval_yes' WHEN q = 1 THEN 'clear_expl' WHEN q = 3 AND a = 'No' THEN 'clear_expl' ELSE 'none' END
  WHEN q = 0 OR (q = 3 AND k = 'b') THEN 'flip_eval_yes' WHEN q = 3 AND a = 'No' THEN 'review' ELSE 'clear_expl' END AS action FROM c"""


@query("g13_field_adjudication", ADJUDICATED)
def g13(t: Tables) -> DataFrame:
    return _cases(t).select("doc_id", adjudicate.adjudicate(C("answer"), C("quotes"), C("kind"), C("grounded"), "mech")["action"].alias("action"))


@query("g14_safe_fixes", ADJUDICATED.replace("SELECT doc_id, CASE WHEN a = 'Yes' AND q = 4", ", v AS (SELECT doc_id, q, a, CASE WHEN a = 'Yes' AND q = 4", 1) + ") SELECT doc_id, CASE WHEN action = 'flip_eval_yes' THEN 'Yes' ELSE a END AS answer, CASE WHEN coalesce(action, '') = 'clear_expl' OR q = 4 THEN 0 WHEN q = 2 THEN 2 ELSE 1 END AS quotes FROM v")
def g14(t: Tables) -> DataFrame:
    c = _cases(t).select("*", adjudicate.adjudicate(C("answer"), C("quotes"), C("kind"), C("grounded"), "mech").alias("v"))
    f = c.select("doc_id", adjudicate.fixed(C("answer"), C("quotes"), C("v")).alias("f"))
    return f.select("doc_id", C("f.answer").alias("answer"), F.size("f.quotes").cast("long").alias("quotes"))


@query("g11_analysis_validation")
def g11(t: Tables) -> DataFrame:
    r = t("in_records").select("id", coerce.eval_answer(C("answer")).alias("answer"), text.quotes(C("name")).alias("quotes"), C("text").alias("body"), "name", "url", "categories")
    e = r.select("*", F.explode_outer("quotes").alias("quote"))
    e = matching.quotes_in_source(e, "quote", "body")
    g = e.groupBy("id", "answer", "quotes", "categories", "name", "url", "body").agg(F.bool_and(F.coalesce("in_source", F.lit(True))).alias("grounded"))
    kind = adjudicate.document_type(C("name"), C("body"), C("url"))
    v = adjudicate.adjudicate(C("answer"), C("quotes"), kind, C("grounded"), "mech")
    known = F.array(*(F.lit(c.lower()) for c in coerce.CATEGORIES))
    bad = F.array_except(F.transform(coerce.category_tokens(C("categories")), lambda c: F.lower(F.trim(c))), known)
    return g.select("id", kind.alias("kind"), v["action"].alias("action"), C("grounded"), F.size(bad).cast("long").alias("unknown_categories"))


@query("g15_critic_domains", "SELECT event_id, CASE event_type WHEN 'click' THEN 'suspect' WHEN 'view' THEN 'bad' ELSE 'ok' END AS verdict, CASE WHEN value > 50 THEN 'contradicted' ELSE 'ungrounded' END AS severity, CASE WHEN user_id % 2 = 0 THEN 'reanalyze' ELSE 'flag' END AS action FROM events")
def g15(t: Tables) -> DataFrame:
    v, s, a = grounding.critic(F.when(C("event_type") == "click", " Suspect").when(C("event_type") == "view", "BAD").otherwise(C("event_type")), F.when(C("value") > 50, "contradicted"), F.when(C("user_id") % 2 == 0, "Reanalyze ").otherwise("shrug"))
    return t("events").select("event_id", v.alias("verdict"), s.alias("severity"), a.alias("action"))


@query("j9_fuzzy_roster_match")
def j9(t: Tables) -> DataFrame:
    name = lambda c: F.lower(F.trim(bills.without_middle_initial(F.trim(F.substring_index(bills.strip_title(c), ",", 1)))))
    s = t("in_sponsors").select(name(F.substring_index("sponsors", ",", 1)).alias("name")).distinct()
    s = s.select(F.xxhash64("name").alias("id"), F.substring_index("name", " - ", 1).alias("name")).withColumn("key", bills.roster_key(C("name"))).dropDuplicates(["id"])
    roster = t("customer").select(F.lower(F.concat(F.lit("Anne "), "c_mktsegment", (C("c_custkey") % 50).cast("string"))).alias("roster_name"), "c_custkey")
    roster = roster.groupBy("roster_name").agg(F.min("c_custkey").alias("roster_id")).withColumn("roster_key", bills.roster_key(C("roster_name")))
    return matching.match_names(s, roster).join(s.select("id", "name"), "id").select("name", "roster_id", "score")


@query("g16_name_scores", "SELECT n_nationkey, 100 AS score FROM nation")
def g16(t: Tables) -> DataFrame:
    n = t("nation").select("n_nationkey", F.lower("n_name").alias("a"))
    pairs = n.select("n_nationkey", "a", F.concat(F.substring("a", 1, 1), F.lit(" "), F.substring("a", 2, 20)).alias("b"))
    return pairs.select("n_nationkey", matching.believed_score("a", "b", F.regexp_replace("a", " ", ""), F.regexp_replace("b", " ", "")).alias("score"))


INTRO = "CASE c_custkey % 4 WHEN 0 THEN concat('Ann is a citizen of the ', initcap(c_mktsegment), ' Nation and a lawyer.') WHEN 1 THEN 'She is a member of the Blue River Band, of Oneida descent, born in the north and raised by her aunts there.' WHEN 2 THEN 'A Native American politician.' ELSE 'Bo is a citizen of the Cree and Mohawk tribes, and farms the land by the river that the family has held since long ago.' END"


@query("g17_name_extraction", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) WHEN 1 THEN 'Blue River / Oneida' WHEN 3 THEN 'Cree / Mohawk' ELSE '' END AS names, CASE c_custkey % 4 WHEN 0 THEN 'intro_too_short' WHEN 2 THEN 'generic_only' ELSE '' END AS refused FROM customer")
def g17(t: Tables) -> DataFrame:
    found = grounding.extracted(F.expr(INTRO), ["Oneida", "Blue River", "Band"])
    return t("customer").select(C("c_custkey").alias("id"), F.array_join(found, " / ").alias("names"), grounding.proposal(F.array_join(found, " / "), F.expr(INTRO)).alias("refused"))


@query("g18_model_proposal", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'empty' WHEN (c_custkey % 10) / 10.0 + 0.1 < 0.85 THEN 'low_confidence' WHEN c_custkey % 3 = 0 THEN 'no_evidence' WHEN c_custkey % 3 = 1 THEN 'evidence_not_in_text' WHEN c_custkey % 7 = 0 THEN 'generic_only' ELSE '' END AS refused FROM customer")
def g18(t: Tables) -> DataFrame:
    k = C("c_custkey")
    name = F.when(k % 5 == 0, " ").when(k % 7 == 0, "Native American").otherwise("Oneida")
    quote = F.when(k % 3 == 0, "").when(k % 3 == 1, "not there").otherwise(C("c_mktsegment"))
    return t("customer").select(k.alias("id"), grounding.model_proposal(name, (k % 10) / 10 + 0.1, quote, F.concat(F.lit("of "), "c_mktsegment")).alias("refused"))


@query("g19_write_policy", "SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'skip_override' WHEN c_custkey % 3 = 0 THEN 'skip_known' WHEN c_custkey % 4 = 0 OR c_custkey % 5 = 0 THEN 'needs_model' ELSE 'write' END AS policy FROM customer")
def g19(t: Tables) -> DataFrame:
    k = C("c_custkey")
    return t("customer").select(k.alias("id"), grounding.write_policy(F.when(k % 3 == 0, "Oneida").otherwise("N/A"), F.when(k % 11 == 0, "x"), F.when(k % 4 != 0, "Cree"), F.when(k % 5 == 0, "too_short").otherwise("")).alias("policy"))


@query("g20_jurisdiction", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'National' WHEN 1 THEN 'AK' WHEN 2 THEN 'WA' WHEN 3 THEN 'WV' WHEN 4 THEN 'MT' ELSE 'National' END AS state FROM documents""")
def g20(t: Tables) -> DataFrame:
    k = C("doc_id") % 6
    url = F.when(k == 0, "https://www.justice.gov/opa/pr/1").otherwise("https://www.justice.gov/usao-xx/pr/1")
    body = F.when(k == 1, "U.S. Attorney for the District of Alaska, said").when(k == 2, "Eastern District of Washington and others").when(k == 3, "in West Virginia today").otherwise("none")
    inferred = places.jurisdiction(url, F.lit(""), F.lit(None).cast("string"), body)
    return t("documents").select("doc_id", places.resolved_state(inferred, F.when(k == 4, "mt"), F.lit("Unknown")).alias("state"))


@query("g21_annotated_sponsors")
def g21(t: Tables) -> DataFrame:
    roster = t("customer").select(bills.roster_key(F.concat(F.lit("Ann "), "c_mktsegment", (C("c_custkey") % 50).cast("string"))).alias("rkey")).distinct().withColumn("ethnicity", F.lit("Oneida"))
    each = t("in_sponsors").select("id", "offices", F.posexplode(bills.split_sponsors(C("sponsors"))).alias("i", "line")).select("id", "i", "offices", bills.sponsor_parts(C("line")).alias("p"))
    j = each.join(roster, bills.roster_key(bills.without_middle_initial(bills.strip_title(C("p.name")))) == C("rkey"), "left")
    name = F.when(C("ethnicity").isNotNull(), F.concat("p.name", F.lit(" ("), "ethnicity", F.lit(")"))).otherwise(C("p.name"))
    line = bills.sponsor_line(name, C("p.role"), C("p.details"))
    shown = bills.sponsor_line(name, F.when(bills.office_is_role(C("offices"), C("p.role")), C("offices")).otherwise(C("p.role")), C("p.details"))
    g = j.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("line"), F.when(C("ethnicity").isNotNull(), shown).alias("own")))).alias("l"))  # a line's few sponsors
    return g.select("id", F.array_join(F.transform("l", lambda x: x["line"]), ", ").alias("sponsors"), F.array_join(F.transform("l", lambda x: x["own"]), ", ").alias("matched"))


@query("g22_false_positive_score", "WITH f AS (SELECT id, categories IN ('', 'None of these') AS a, regexp_matches(name, '(?i)thor') AS b, trim(state) = '' AS c, contains(url, '/2019') AS d FROM in_records), s AS (SELECT id, CASE WHEN a THEN 2 ELSE 0 END + CASE WHEN b THEN 3 ELSE 0 END + CASE WHEN c THEN 4 ELSE 0 END + CASE WHEN d THEN 1 ELSE 0 END AS score FROM f) SELECT id, score, CASE WHEN score >= 5 THEN 'reject' WHEN score >= 3 THEN 'review' ELSE 'keep' END AS recommendation FROM s")
def g22(t: Tables) -> DataFrame:
    flags = {"empty_categories": (F.size(coerce.categories(C("categories"))) == 0, 2), "junk_title": (C("name").rlike("(?i)thor"), 3), "guard": (F.trim("state") == "", 4), "old": (C("url").contains("/2019"), 1)}
    score, _, advice = grounding.false_positive(flags)
    return t("in_records").select("id", score.alias("score"), advice.alias("recommendation"))


@query("g23_coverage_class", "SELECT state, CASE WHEN bool_or(content_type = 'executive_order' AND enabled) THEN 'FULL' WHEN bool_or(content_type = 'executive_order') THEN 'PARTIAL' ELSE 'MISSING' END AS governor, 10 * count(*) FILTER (NOT enabled) + CAST(sum(hits) AS BIGINT) AS priority FROM in_sources GROUP BY state")
def g23(t: Tables) -> DataFrame:
    order = C("content_type") == "executive_order"
    level = F.when(F.bool_or(order & C("enabled")), "FULL").when(F.bool_or(order), "PARTIAL").otherwise("MISSING")
    return t("in_sources").groupBy("state").agg(level.alias("governor"), (10 * F.count_if(~C("enabled")) + F.sum("hits")).alias("priority"))


@query("g24_reachability", "WITH x AS (SELECT page_id, row_number() OVER (PARTITION BY url ORDER BY page_id) > 1 AS dup FROM in_urls) SELECT page_id, CASE WHEN dup THEN 'duplicate' WHEN page_id % 5 = 0 THEN 'dead' WHEN page_id % 7 = 0 THEN 'quarantined' WHEN page_id % 3 = 0 THEN 'search_reachable' ELSE 'page_depth' END AS class FROM x")
def g24(t: Tables) -> DataFrame:
    first = t("in_urls").groupBy("url").agg(F.min("page_id").alias("first"))
    k = C("page_id")
    return t("in_urls").join(first, "url").select("page_id", F.when(k != C("first"), "duplicate").when(k % 5 == 0, "dead").when(k % 7 == 0, "quarantined").when(k % 3 == 0, "search_reachable").otherwise("page_depth").alias("class"))


@query("g25_endpoint_status", "SELECT id, CASE WHEN NOT enabled THEN 'disabled' WHEN hits = 0 THEN 'no_documents' WHEN hits < 3 THEN 'thin' ELSE 'ok' END AS status FROM in_sources")
def g25(t: Tables) -> DataFrame:
    return t("in_sources").select("id", F.when(~C("enabled"), "disabled").when(C("hits") == 0, "no_documents").when(C("hits") < 3, "thin").otherwise("ok").alias("status"))


@query("g26_ranked_gaps", "SELECT state, gap, n FROM (SELECT state, 'disabled' AS gap, count(*) AS n FROM in_sources WHERE NOT enabled GROUP BY 1 UNION ALL SELECT state, 'dead', count(*) FROM in_sources WHERE hits = 0 GROUP BY 1) ORDER BY n DESC, state, gap LIMIT 20")
def g26(t: Tables) -> DataFrame:
    gap = lambda c, name: t("in_sources").where(c).groupBy("state").agg(F.count("*").alias("n")).withColumn("gap", F.lit(name))
    return gap(~C("enabled"), "disabled").unionByName(gap(C("hits") == 0, "dead")).orderBy(F.desc("n"), "state", "gap").limit(20).select("state", "gap", "n")


@query("g27_gap_fill", "SELECT state, content_type AS role, arg_max(id, struct_pack(h := hits, i := -id)) AS winner FROM in_sources s WHERE NOT enabled AND url NOT IN (SELECT url FROM in_sources WHERE enabled) GROUP BY 1, 2")
def g27(t: Tables) -> DataFrame:
    s = t("in_sources")
    free = s.where(~C("enabled")).join(s.where("enabled").select("url").distinct(), "url", "left_anti")
    return free.groupBy("state", C("content_type").alias("role")).agg(F.max_by("id", F.struct("hits", (-C("id")).alias("i"))).alias("winner"))


@query("g28_ungrounded_repair", "WITH d AS (SELECT id, text, CASE id % 7 WHEN 0 THEN '2024-05-01' WHEN 1 THEN '2026-05-03' WHEN 2 THEN '2023-05-05' WHEN 3 THEN '2017-01-09' WHEN 6 THEN '2019-11-30' END AS d FROM in_records), g AS (SELECT id, d, contains(text, d[1:4]) AND (contains(text, d) OR regexp_matches(text, '(?i)(?:january|may|november)\\s+0?' || CAST(CAST(d[9:10] AS INTEGER) AS VARCHAR) || '\\b,?\\s*' || d[1:4])) AS ok FROM d) SELECT id, CASE WHEN d IS NOT NULL AND NOT ok THEN '' ELSE d END AS after, d IS NOT NULL AND NOT ok AS reanalyze FROM g")
def g28(t: Tables) -> DataFrame:
    d = coerce.iso_date(C("last_update"))
    r = t("in_records").select("id", d.alias("before"), F.when(d.isNotNull() & ~text.date_grounded(d, C("text")), "").otherwise(d).alias("after"))
    return r.select("id", "after", (C("before").isNotNull() & (C("after") == "")).alias("reanalyze"))


@query("g29_update_preparation", "SELECT id, CASE WHEN categories = '' THEN 'keep' ELSE 'write' END AS categories, coalesce(nullif(trim(status), ''), 'Pending') AS status FROM in_records")
def g29(t: Tables) -> DataFrame:
    return t("in_records").select("id", F.when(C("categories") == "", "keep").otherwise("write").alias("categories"), F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("Pending")).alias("status"))


# -- sources ---------------------------------------------------------------------------------------------

HIT = "'{\"bill_id\": ' || CAST(o_orderkey % 400 AS STRING) || ', \"state\": \"AK\", \"url\": \"https://x/' || CAST(o_orderkey % 400 AS STRING) || '\", \"title\": \"t\", \"last_action\": \"' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END || '\", \"description\": \"' || o_orderstatus || '\", \"relevance\": 7}'"


@query("src1_search_hits", "SELECT CAST(o_orderkey % 400 AS VARCHAR) AS external_id, arg_min(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END, o_orderkey) AS snippet FROM orders GROUP BY 1")
def src1(t: Tables) -> DataFrame:
    as_list = F.expr(f"concat('{{\"searchresult\": {{\"summary\": {{\"page_total\": 1}}, \"results\": [', {HIT}, ']}}}}')")
    as_map = F.expr(f"concat('{{\"searchresult\": {{\"summary\": {{\"page_total\": 1}}, \"results\": {{\"0\": ', {HIT}, '}}}}}}')")
    body = t("orders").select(C("o_orderkey").alias("query_ix"), F.lit(1).alias("page"), F.when(C("o_orderkey") % 2 == 0, as_list).otherwise(as_map).alias("body"))
    return payloads.search_hits(body).select("external_id", "snippet")


@query("src2_pages_to_fetch", "SELECT o_orderkey AS id, unnest(range(1, 1 + greatest(1, least(o_orderkey % 9, 5)))) AS page FROM orders")
def src2(t: Tables) -> DataFrame:
    return t("orders").select(C("o_orderkey").alias("id"), F.explode(payloads.pages_to_fetch((C("o_orderkey") % 9).cast("int"), 5)).alias("page")).withColumn("page", C("page").cast("long"))


@query("src3_read_through", "WITH f AS (SELECT event_type AS op, user_id AS param_key, min(event_id) AS first FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (ORDER BY first) <= 40 AS paid FROM f WHERE param_key % 3 <> 0) SELECT e.event_id AS ord, CASE WHEN f.param_key % 3 = 0 THEN CASE WHEN e.event_id > f.first THEN 'memory' ELSE 'cache' END WHEN NOT coalesce(n.paid, false) OR f.param_key % 7 = 0 THEN 'none' WHEN e.event_id > f.first THEN 'memory' ELSE 'network' END AS via FROM events e JOIN f ON e.event_type = f.op AND e.user_id = f.param_key LEFT JOIN n USING (op, param_key)")
def src3(t: Tables) -> DataFrame:
    asked = t("events").select(C("event_id").alias("ord"), C("event_type").alias("op"), C("user_id").alias("param_key"))
    keys = asked.select("op", "param_key").distinct()
    valid = keys.where("param_key % 3 = 0").withColumn("payload", F.lit("cached"))
    remote = keys.where("param_key % 7 <> 0").withColumn("payload", F.lit("fetched"))
    return fetching.read_through(asked, valid, remote, budget=40).select("ord", "via")


@query("src3a_answer_kinds", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'retry' WHEN 1 THEN 'http_error' WHEN 2 THEN 'ok' WHEN 3 THEN 'overlimit' WHEN 4 THEN 'api_error' ELSE 'empty' END AS kind FROM events")
def src3a(t: Tables) -> DataFrame:
    k = C("event_id") % 6
    kind = fetching.answer_kind(F.when(k == 0, 429).when(k == 1, 500).otherwise(200), F.when(k == 2, "ok").when(k.isin(3, 4), "Error"), F.when(k == 3, "Monthly limit reached").when(k == 4, "unknown bill"))
    return t("events").select("event_id", kind.alias("kind"))


@query("src9_fetch_schedule", f"SELECT page_id, CAST(2.0 * (row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1) AS DOUBLE) AS start FROM pages")
def src9(t: Tables) -> DataFrame:
    return fetching.schedule(t("pages").select("page_id", "url"), "page_id").select("page_id", "start")


@query("src10_robots", "SELECT page_id, NOT (regexp_matches(url, '^https?://[^/]*[.]example[.]com/en/') AND NOT regexp_matches(url, '^https?://[^/]*[.]example[.]com/en/1')) AS allowed FROM pages")
def src10(t: Tables) -> DataFrame:
    hosts = t("pages").select(urls.host(C("url")).alias("host")).distinct().where(C("host").endswith(".example.com"))
    rules = hosts.select("host", F.lit("User-agent: *\nDisallow: /\n\nUser-agent: tessella\nAllow: /en/1\nDisallow: /en/\nAllow: /en/2\n").alias("body"))
    return fetching.robots_allow(t("pages").select("page_id", "url"), fetching.robots_rules(rules, "tessella")).select("page_id", "allowed")


@query("src4_ttl_cache", "SELECT event_type AS op, user_id AS param_key, arg_max(value, struct_pack(t := ts, v := value)) AS payload FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2 HAVING max(ts) >= (SELECT max(ts) FROM events) - CASE event_type WHEN 'click' THEN INTERVAL 18 HOUR ELSE INTERVAL 7 DAY END")
def src4(t: Tables) -> DataFrame:
    from tessella.operators.identity import cached

    e = t("events").groupBy("event_type", "user_id", "ts").agg(F.max("value").alias("value"))
    cache = e.select(C("event_type").alias("op"), C("user_id").alias("param_key"), C("value").alias("payload"), C("ts").cast("timestamp").alias("fetched_at"))
    now = cache.agg(F.max("fetched_at")).first()[0]
    return cached(cache, F.lit(now), {"click": 18 * 3600, "purchase": 7 * 86400}).select("op", "param_key", "payload")


@query("src5_crawl_stop", "WITH p AS (SELECT conv_id AS source, turn AS page_no, min(role) AS norm, min(text) AS h FROM conversations GROUP BY 1, 2), u AS (SELECT *, min(page_no) OVER (PARTITION BY source, norm || CAST(page_no // 3 AS VARCHAR)) < page_no OR min(page_no) OVER (PARTITION BY source, h) < page_no AS bad FROM p), s AS (SELECT source, min(page_no) AS stop FROM u WHERE bad GROUP BY 1) SELECT p.source, count(*) AS pages FROM p LEFT JOIN s USING (source) WHERE stop IS NULL OR page_no < stop GROUP BY 1")
def src5(t: Tables) -> DataFrame:
    p = t("conversations").groupBy(C("conv_id").alias("source"), C("turn").alias("page_no")).agg(F.min("role").alias("norm"), F.min("text").alias("content_hash"))
    p = p.withColumn("norm", F.concat("norm", F.floor(C("page_no") / 3).cast("string"))).withColumn("texts", F.array(C("page_no").cast("string")))
    return html.crawl_stop(p).groupBy("source").agg(F.count("*").alias("pages"))


@query("src6_search_crawl", "WITH q AS (SELECT 0 AS query_ix, 'a' AS q UNION ALL SELECT 1, 'b'), l AS (SELECT query_ix, page_id AS position, 'https://x.gov/s?q=' || q AS via, CASE WHEN page_id % 5 = 0 THEN 'http://www.x.gov/s/?q=' || (CASE WHEN page_id % 10 = 0 THEN 'a' ELSE 'b' END) || '#top' ELSE url END AS link, page_id % 5 = 0 AND q = (CASE WHEN page_id % 10 = 0 THEN 'a' ELSE 'b' END) AS own FROM pages, q WHERE query_ix = 1 OR page_id % 3 <> 0) SELECT via, position, link FROM l WHERE NOT own QUALIFY row_number() OVER (PARTITION BY link ORDER BY query_ix, position) = 1")
def src6(t: Tables) -> DataFrame:
    asked = F.posexplode(F.when(C("page_id") % 3 == 0, F.array(F.lit(None), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b")))).alias("query_ix", "q")
    own = F.concat(F.lit("http://www.x.gov/s/?q="), F.when(C("page_id") % 10 == 0, "a").otherwise("b"), F.lit("#top"))
    links = t("pages").select(asked, C("page_id").alias("position"), F.when(C("page_id") % 5 == 0, own).otherwise(C("url")).alias("link")).where("q IS NOT NULL")
    links = links.withColumn("results_url", urls.search_url(F.lit("https://x.gov/s?q={query}"), C("q")))
    return html.search_links(links).select(C("results_url").alias("via"), "position", "link")


@query("src7_feed_items", "SELECT o_orderkey AS feed_id, CASE o_orderkey % 3 WHEN 0 THEN 'https://x/' || CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'https://y/' || CAST(o_orderkey AS VARCHAR) ELSE 'guid-' || CAST(o_orderkey AS VARCHAR) END AS url, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE o_orderpriority END AS snippet FROM orders")
def src7(t: Tables) -> DataFrame:
    o = t("orders")
    item = F.expr("""CASE o_orderkey % 3 WHEN 0 THEN concat('<rss><channel><item><title>', o_orderpriority, '</title><link>https://x/', o_orderkey, '</link></item></channel></rss>')
      WHEN 1 THEN concat('<feed><entry><title>', o_orderpriority, '</title><link href="https://y/', o_orderkey, '"/><summary>', o_orderstatus, '</summary></entry></feed>')
      ELSE concat('<rss><channel><item><title>', o_orderpriority, '</title><guid>guid-', o_orderkey, '</guid></item></channel></rss>') END""")
    return payloads.feed_items(o.select(C("o_orderkey").alias("feed_id"), item.alias("body"))).select("feed_id", "url", "title", "snippet")


@query("src8_api_dialects", "SELECT 'register' AS dialect, 'https://r/' || CAST(min(o_orderkey) AS VARCHAR) AS url, count(*) AS items FROM orders GROUP BY o_custkey UNION ALL SELECT 'press', 'https://p/' || CAST(min(o_orderkey) AS VARCHAR), count(*) FROM orders GROUP BY o_custkey")
def src8(t: Tables) -> DataFrame:
    o = t("orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("ord"), F.count("*").alias("items"))
    r = payloads.register_items(o.select("ord", F.expr("concat('{\"results\": [{\"html_url\": \"https://r/', ord, '\", \"title\": \"', items, '\", \"excerpts\": \"<b>x</b>\"}]}')").alias("body")))
    p = payloads.press_items(o.select("ord", F.expr("concat('{\"metadata\": {\"responseInfo\": {\"status\": 200}, \"resultset\": {\"count\": \"1\", \"page\": \"0\", \"pagesize\": \"20\"}}, \"results\": [{\"url\": \"https://p/', ord, '\", \"title\": \"', items, '\", \"teaser\": \"t\"}]}')").alias("body")))
    one = lambda df, name: df.select(F.lit(name).alias("dialect"), "url", C("title").cast("long").alias("items"))
    return one(r, "register").unionByName(one(p, "press"))


@query("src12_federal_union", "SELECT method, count(*) AS n FROM in_sources GROUP BY 1")
def src12(t: Tables) -> DataFrame:
    s, out = t("in_sources"), None
    for m in ("index", "search", "api", "rss"):
        one = s.where(C("method") == m).select("method")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("method").agg(F.count("*").alias("n"))


@query("src14_sample_urls", "SELECT s_suppkey AS id, 'item ' || CAST(s_suppkey AS VARCHAR) || ' of day' AS title FROM supplier")
def src14(t: Tables) -> DataFrame:
    u = t("supplier").select(C("s_suppkey").alias("id"), F.explode(F.array(F.concat(F.lit("https://x.gov/item-"), C("s_suppkey").cast("string"), F.lit("_of-day.html")), F.lit(" "))).alias("u")).where(F.trim("u").startswith("http"))
    return u.select("id", urls.slug_title(C("u")).alias("title"))


@query("src15_year_slugs", "SELECT id, y AS year, url || CAST(y AS VARCHAR) || '-day' AS probe FROM in_sources, (SELECT unnest(range(2019, 2027)) AS y) WHERE content_type = 'proclamation'")
def src15(t: Tables) -> DataFrame:
    s = t("in_sources").withColumn("templates", F.array(F.concat("url", F.lit("{year}-day")), F.lit("https://none/")))
    return payloads.year_urls(s, 2026).select("id", C("year").cast("long").alias("year"), "probe")


@query("src16_register_text", "SELECT doc_id, md5(substr(title || chr(10) || text, 1, 8000)) AS body FROM in_docs")
def src16(t: Tables) -> DataFrame:
    return t("in_docs").select("doc_id", F.md5(F.substring(F.concat_ws("\n", "title", "text"), 1, 8000)).alias("body"))


@query("src16a_government_text", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'pdf' ELSE 'html' END AS kind, md5(CASE WHEN doc_id % 2 = 0 THEN split_part(text || 'Related Content, Related Content', 'Related Content', 1) ELSE text || 'Related Content, Related Content' END) AS body FROM documents")
def src16a(t: Tables) -> DataFrame:
    k = C("doc_id") % 4
    mime = F.when(k == 0, "text/html; charset=utf-8").when(k == 1, "application/pdf").otherwise("application/octet-stream")
    url = F.when(k == 0, "https://www.justice.gov/opa").when(k == 2, "https://www.justice.gov/opa.pdf").otherwise("https://a.gov/x")
    body = F.concat("text", F.lit("Related Content, Related Content"))
    return t("documents").select("doc_id", payloads.document_kind(mime, url).alias("kind"), F.md5(payloads.without_tail(body, url, {"justice.gov": "Related Content"})).alias("body"))


@query("src20_snapshot_files", "SELECT s_suppkey AS id, s_name AS name, 'Pending' AS \"table\" FROM supplier")
def src20(t: Tables) -> DataFrame:
    at = _folder(t, "snapshot")
    stores.snapshot(t("supplier").select(C("s_suppkey").alias("id"), C("s_name").alias("name")), at, "Pending", "2026-08-05T00:00:00Z")
    return t.spark.read.schema("exported_at string, `table` string, id long, fields struct<name: string>").json(at).select("id", C("fields.name").alias("name"), "table")


@query("src17_encoded_documents", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' ELSE 'unsupported' END AS kind, CASE WHEN doc_id % 3 = 0 THEN CAST(strlen(text) AS BIGINT) END AS n_chars, CASE WHEN doc_id % 3 = 0 AND strlen(text) = length(text) THEN sha256(text) END AS plain FROM documents")
def src17(t: Tables) -> DataFrame:
    k = C("doc_id") % 3
    mime = F.when(k == 0, "text/html").when(k == 1, "application/pdf").otherwise("application/msword")
    coded = t("documents").select("doc_id", F.length("text").alias("n"), F.base64(C("text").cast("binary")).alias("doc"), payloads.document_kind(mime).alias("kind"))
    d = coded.withColumn("read", F.when(C("kind") == "html", payloads.latin_text(F.unbase64("doc"))))
    return d.select("doc_id", "kind", F.length("read").cast("long").alias("n_chars"), F.when(F.length("read") == C("n"), F.sha2(C("read").cast("binary"), 256)).alias("plain"))


@query("src19_category_tree", "WITH RECURSIVE tree AS (SELECT r_regionkey AS root, r_regionkey * 100 AS node, 0 AS depth FROM region UNION ALL SELECT root, node * 2 + 1, depth + 1 FROM tree WHERE depth < 4) SELECT root, count(*) AS members, max(node) AS deepest FROM tree GROUP BY root")
def src19(t: Tables) -> DataFrame:
    return t("region").sparkSession.sql("WITH RECURSIVE tree AS (SELECT r_regionkey AS root, r_regionkey * 100 AS node, 0 AS depth FROM {region} UNION ALL SELECT root, node * 2 + 1, depth + 1 FROM tree WHERE depth < 4) SELECT root, count(*) AS members, max(node) AS deepest FROM tree GROUP BY root", region=t("region"))


@query("src21_upgraded_sources", "SELECT id, CASE id % 4 WHEN 0 THEN 'index' WHEN 1 THEN 'search' WHEN 2 THEN 'rss' ELSE 'rss' END AS method, CASE WHEN id % 4 = 3 THEN 'rss needs a url' ELSE '' END AS error FROM in_sources")
def src21(t: Tables) -> DataFrame:
    k = C("id") % 4
    s = t("in_sources").select("id", F.when(k == 3, "rss").otherwise("").alias("method"), F.when(k == 0, C("url")).alias("url"), F.when(k == 2, C("url")).alias("rss_url"), F.when(k == 1, C("url")).alias("search_url"))
    return payloads.upgraded(s).select("id", "method", "error")


@query("src22_master_list", "SELECT o_orderkey AS session_id, o_custkey AS bill_id, 'HB' || CAST(o_custkey AS VARCHAR) AS number FROM orders")
def src22(t: Tables) -> DataFrame:
    body = F.expr("concat('{\"session\": {\"id\": 1}, \"0\": {\"bill_id\": ', o_custkey, ', \"number\": \"HB', o_custkey, '\", \"change_hash\": \"x\"}}')")
    return payloads.master_list(t("orders").select(C("o_orderkey").alias("session_id"), body.alias("body"))).select("session_id", "bill_id", "number")


@query("n20_page_text")
def n20(t: Tables) -> DataFrame:
    return html.texts(t("pages")).select("page_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("p15_row_context")
def p15(t: Tables) -> DataFrame:
    return html.links(t("pages")).select("page_id", "position", "in_frame", F.length("context").cast("long").alias("context_chars"))


@query("p18_table_links")
def p18(t: Tables) -> DataFrame:
    rows = t("pages").select("page_id", F.concat(F.lit("<table><tr><td>2021-"), F.lpad((C("page_id") % 100).cast("string"), 2, "0"), F.lit("*</td><td> </td><td>Title</td></tr></table>"), F.coalesce("html", F.lit(""))).alias("html"))
    return html.table_links(rows, "https://x.gov/{number}.pdf").select("page_id", "link", "context")


@query("src13_site_links")
def src13(t: Tables) -> DataFrame:
    l = html.links(t("pages")).join(t("pages").select("page_id", "url"), "page_id")
    return l.where(urls.host(C("link")) == urls.host(C("url"))).groupBy("page_id").agg(F.countDistinct("link").alias("links"))


# -- sinks and streams -----------------------------------------------------------------------------------


def _folder(t: Tables, name: str) -> str:
    return work.folder(t.spark, name)


@query("snk3_move_log", "SELECT 'to_live' AS direction, url, page_id FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 'to_pending', url, page_id FROM pages WHERE page_id % 3 = 0")
def snk3(t: Tables) -> DataFrame:
    at = _folder(t, "moves")
    for direction, k in (("to_live", 2), ("to_pending", 3)):
        stores.append_log(t("pages").where(C("page_id") % k == 0).select(F.lit(direction).alias("direction"), "url", "page_id"), at)
    return stores.read_log(t.spark, at, "direction string, url string, page_id long")


@query("snk6_record_projections", "SELECT id, 'live' AS target, to_json(map_from_entries(list_filter([struct_pack(k := 'bill_number', v := bill_number), struct_pack(k := 'state', v := trim(state))], lambda e: e.v <> ''))) AS fields FROM in_records WHERE review_status = 'Approved'")
def snk6(t: Tables) -> DataFrame:
    kept = F.map_filter(F.create_map(F.lit("bill_number"), C("bill_number"), F.lit("state"), F.trim("state")), lambda k, v: v != "")
    return t("in_records").where("review_status = 'Approved'").select("id", F.lit("live").alias("target"), F.to_json(kept).alias("fields"))


@query("snk7_versioned_snapshots", "SELECT s_suppkey AS id, 4 AS version FROM supplier")
def snk7(t: Tables) -> DataFrame:
    at = _folder(t, "versions")
    for v in range(1, 5):
        stores.write_version(t("supplier").select(C("s_suppkey").alias("id"), F.lit(v).alias("version")), at, keep=2)
    if stores.versions(t.spark, at) != [3, 4]:
        raise AssertionError("versions that are too old must go")
    return stores.read_version(t.spark, at, "id long, version int")


@query("snk8_run_log", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def snk8(t: Tables) -> DataFrame:
    at = _folder(t, "runs")
    stores.append_log(t("events").groupBy("event_type").agg(F.count("*").alias("n")), at)
    return stores.read_log(t.spark, at, "event_type string, n long")


@query("snk10a_line_chunks")  # greedy, so each piece depends on the one before: tested on small cases
def snk10a(t: Tables) -> DataFrame:
    lines = t("orders").select(C("o_custkey").alias("customer"), "o_orderkey", F.concat(F.lit("order "), C("o_orderkey").cast("string")).alias("line"))
    return stores.chunks(lines, "customer", "o_orderkey", "line", 60)


@query("snk11_markdown_report", "SELECT '# Status' AS first_line, count(DISTINCT o_orderstatus) + 4 AS lines FROM orders")
def snk11(t: Tables) -> DataFrame:
    report = stores.markdown(t("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).orderBy("o_orderstatus"), "Status")
    return t.spark.createDataFrame([(report.split("\n")[0], report.count("\n"))], "first_line string, lines long")


@query("stm1_nightly_steps", "SELECT * FROM (VALUES ('discover', 'ok'), ('refresh', 'failed: ValueError'), ('report', 'ok')) v(step, outcome)")
def stm1(t: Tables) -> DataFrame:
    def fails() -> None:
        raise ValueError

    done = incremental.nightly([("discover", lambda: None), ("refresh", fails), ("report", lambda: None)], "discover")
    return t.spark.createDataFrame(done, "step string, outcome string")


@query("stm5_expiring_state", "SELECT user_id, max(ts) AS last FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def stm5(t: Tables) -> DataFrame:
    e = t("events").groupBy("user_id").agg(F.max("ts").alias("last"))
    now = t("events").agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(now), C("last") >= C("now") - F.expr("INTERVAL 7 DAYS")).select("user_id", "last")


@query("stm6_progress", "SELECT count(*) AS discovered, count(*) FILTER (event_type = 'purchase') AS analyzed, (100 * count(*) FILTER (event_type = 'purchase')) // count(*) AS percent FROM events")
def stm6(t: Tables) -> DataFrame:
    from pyspark.sql import Observation

    seen = Observation("progress")
    t("events").observe(seen, F.count("*").alias("discovered"), F.count_if(C("event_type") == "purchase").alias("analyzed")).write.format("noop").mode("overwrite").save()
    m = seen.get
    return t.spark.createDataFrame([(m["discovered"], m["analyzed"], 100 * m["analyzed"] // m["discovered"])], "discovered long, analyzed long, percent long")


@query("stm3_seen_stream", "SELECT CASE WHEN ord >= 1000000000 THEN 'again' ELSE 'first' END AS part, count(*) AS n FROM in_batch GROUP BY 1")
def stm3(t: Tables) -> DataFrame:
    at = _folder(t, "seen")
    b = t("in_batch").withColumn("part", F.when(C("ord") >= 1_000_000_000, "again").otherwise("first"))
    for part in ("first", "again"):
        b.where(C("part") == part).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = incremental.arrivals(t.spark, f"{at}/in", b.schema, files=1)
    incremental.maintain_seen(stream, f"{at}/state", f"{at}/decided", f"{at}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{at}/decided").groupBy("part").agg(F.count("*").alias("n"))


@query("stm2_interval_runs", "SELECT count(*) AS n, 1 AS versions FROM in_batch")
def stm2(t: Tables) -> DataFrame:
    """Runs at an interval, one at a time, until nothing is left to do."""
    at = _folder(t, "interval")
    b = t("in_batch")
    b.coalesce(1).write.parquet(f"{at}/in")
    running = incremental.maintain_seen(incremental.arrivals(t.spark, f"{at}/in", b.schema), f"{at}/state", f"{at}/decided", f"{at}/checkpoint", interval="1 second")
    running.processAllAvailable()
    running.stop()
    versions = len(stores.versions(t.spark, f"{at}/state"))
    return t.spark.read.parquet(f"{at}/decided").agg(F.count("*").alias("n"), F.lit(versions).alias("versions"))


@query("stm4_first_arrivals", "SELECT user_id, event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2")
def stm4(t: Tables) -> DataFrame:
    at = _folder(t, "arrivals")
    e = t("events").select("user_id", "event_type", C("ts").cast("timestamp").alias("ts"))
    e.write.parquet(f"{at}/in")
    stream = incremental.first_arrivals(incremental.arrivals(t.spark, f"{at}/in", e.schema), ["user_id", "event_type"], "ts", "4000 days")
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("user_id long, event_type string").parquet(f"{at}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("stm_window_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stm_window(t: Tables) -> DataFrame:
    """An extension: the same expression on a batch, where the watermark has no effect."""
    e = t("events").select("event_type", C("ts").cast("timestamp").alias("ts"))
    return incremental.windowed_counts(e, "ts", "1 hour", "1 day", None, "event_type").select(C("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
