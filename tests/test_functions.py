"""Expressions on shapes that the tables lack."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessella.functions import bills, coerce, matching, places, text, urls
from tessella.operators import adjudicate, changes, grounding, identity
from tessella.plans.catalog import QUERIES


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_urls(spark):
    cases = {None: "", "  ": "", "HTTP://WWW.A.gov/x/#f": "https://a.gov/x", "a.gov/x": "https:a.gov/x", "https://a.gov": "https://a.gov/", "https://a.gov/x;p=1/": "https://a.gov/x;p=1", "https://www.justice.gov/archives/opa/1/": "https://justice.gov/opa/1", "https://a.gov/s p?q=1": "https://a.gov/s p?q=1"}
    assert one(spark, list(cases), urls.normalize_url) == list(cases.values())


def test_url_shapes(spark):
    cases = {
        "https://a.gov/s?q=mm": "url_search_page", "https://a.gov/s?q=": "", "https://a.gov/fr/billsearch.aspx": "url_search_page", "https://a.gov/site-search": "url_search_page", "https://a.gov/research": "", "https://a.gov/": "url_nav_index",
        "https://a.gov/index.html": "url_nav_index", "ftp://a.gov/x": "url_not_http", "https:///x": "url_no_host", "": "url_empty", "https://a.gov/bills/HB25": "",
    }
    assert one(spark, list(cases), urls.shape_code) == list(cases.values())


def test_host_suffixes(spark):
    assert one(spark, ["https://www.b.c.gov/x", "https://local/x"], urls.host_suffixes) == [["b.c.gov", "c.gov"], ["local"]]


@pytest.mark.parametrize(
    ("number", "body", "found"),
    [("HB 25", "as H.B. 25 says", True), ("HB 0025", "H. R. 25", True), ("HB 25", "HB 251", True), ("HB 25", "H.B. 26", False), ("HB 25", "an H. B. 025 is", True), ("HB 25", "an H.R. 025 is", True), ("SB 7", "S. 07", True), ("A08545", "8545 IN ASSEMBLY", True), ("AO329", "Administrative Order No. 329", True), ("", "x", True), (None, "x", True), ("SB 7", None, False)],
)
def test_number_in_text(spark, number, body, found):
    df = spark.createDataFrame([(number, body)], "n string, t string")
    assert df.select(bills.number_in_text(F.col("n"), F.col("t"))).first()[0] is found


@pytest.mark.parametrize(
    ("date", "body", "grounded"),
    [("2024-05-03", "on May 3, 2024", True), ("2024-05-03", "on 5/3/2024", True), ("2024-05-03", "in 2024", False), ("2024-01-01", "in 2024", False), ("2024-01-01", "January 1, 2024", True), ("2024-13-03", "2024", False), ("", "2024", False), (None, None, False)],
)
def test_date_grounded(spark, date, body, grounded):
    df = spark.createDataFrame([(date, body)], "d string, t string")
    assert df.select(text.date_grounded(F.col("d"), F.col("t"))).first()[0] is grounded


def test_sponsors(spark):
    assert one(spark, ["A, B [C, D], E", "", None, "A,"], bills.split_sponsors) == [["A", "B [C, D]", "E"], [], [], ["A"]]
    assert one(spark, ["Rep. Ann Fox (D-AK) x", "Sen Bo [R, 2]", "Running  Wolf"], bills.roster_key) == ["annfox", "bo", "runningwolf"]


def test_coercion(spark):
    assert one(spark, ["May 5, 2026", "05/05/2026", "2026-5-5", "2026-05-05", "nope", "", None, "02/30/2026"], coerce.iso_date) == ["2026-05-05"] * 4 + [None] * 4
    assert one(spark, ["['Taskforce', 'x']", "data collection,taskforce,Taskforce", None], coerce.categories) == [["Taskforce"], ["Data Collection", "Taskforce"], []]
    assert one(spark, ["2021-01-19", "2021-01-20", "2000-01-01"], lambda c: coerce.administration(c.cast("date"))) == ["Trump Administration", "Biden Administration", None]


def test_sections(spark):
    law = "Section 1. Findings. Sec. 2 It shall. SECTION 1. again"
    assert one(spark, [law, "none", ""], text.findings_text) == ["Section 1. Findings. ", "none", ""]
    assert one(spark, [law, "none"], text.operative_text) == ["Sec. 2 It shall. ", "none"]


def test_best_span():
    body = "The  “Task Force” shall re-\nport each year to the Governor and the people"
    assert matching.best_span('the "task force" shall report', body) == "The  “Task Force” shall re-\nport"
    assert matching.best_span("each year to the governor and peoples", body) is not None
    assert matching.best_span("something else entirely here", body) is None
    assert matching.best_span("", body) is None and matching.best_span("x", None) is None


def test_quotes_are_looked_for_in_whole_texts(spark, tmp_path):
    """What a quote stands for may lie anywhere in a text, however long."""
    head = "One council gathers every spring beside some river to hear reports from elders"[:70]
    filler = "plain words of no interest follow here and go on " * 80
    rows = [(1, head + " . " + filler + head + " and then something else that is not there at all " + filler), (2, filler + "nowhere made up quote without source " + filler), (7, filler)]
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda name, c: {r["doc_id"]: r[c] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("g7_quote_in_source", "in_source") == {1: True, 2: True, 7: False}
    assert got("g8_best_span", "span") == {1: head + " and then something else that is not there at all", 2: "nowhere", 7: None}
    assert got("g10_repaired_quotes", "unanchored") == {1: 1, 2: 0, 7: 1}


def test_best_span_is_that_of_all_windows():
    """Bounds by letters leave out no window that difflib would choose."""

    def brute(quote, source):
        wanted, words = matching.plain(quote), list(re.finditer(r"\S+", source))
        match, best, span, n = SequenceMatcher(None, wanted, "", autojunk=True), matching.LEAST_RATIO, None, len(wanted.split())
        for size in range(max(3, n - 3), min(n + 3, len(words)) + 1):
            for run in (words[k : k + size] for k in range(len(words) - size + 1)):
                match.set_seq2(" ".join(f for f in (matching.plain(w.group()) for w in run) if f))
                if (ratio := match.ratio()) > best or (span is None and ratio >= best):
                    best, span = ratio, source[run[0].start() : run[-1].end()].strip()
        return span

    rng = random.Random(2)
    some = ["the", "tribe’s", "\u200b", "ﬁnal", "a\u00a8b", "report", "is", "due", "each", "year", "½", "Council"]
    found = 0
    for _ in range(150):
        words = [rng.choice(some) for _ in range(rng.randint(1, 40))]
        quote = " ".join(words[3:11] + ["zebra"] * rng.randint(1, 3))
        found += (got := matching.best_span(quote, " ".join(words))) is not None
        assert got == brute(quote, " ".join(words))
    assert found > 30


def test_names():
    assert matching.confident("mary peltola", "mary peltola", "marypeltola", "marypeltola")
    assert matching.confident("running wolf", "runningwolf", "runningwolf", "runningwolf")
    assert not matching.confident("ann foxe", "bob foxe", "annfoxe", "bobfoxe")


def test_adjudication(spark):
    def act(answer, quotes, kind, field="mech"):
        df = spark.createDataFrame([(answer, quotes, kind)], "a string, q array<string>, k string")
        v = df.select(adjudicate.adjudicate(F.col("a"), F.col("q"), F.col("k"), F.lit(True), field).alias("v")).first()["v"]
        return v and v["action"]

    assert act("Yes", [], "bill") == "review"
    assert act("Yes", ["x"], "bill") is None and act("No", [], "bill") is None and act("No", None, "bill") is None
    assert act("No", ["shall establish an office"], "bill") == "flip_eval_yes"
    assert act("No", ["has launched training"], "proclamation", "prev") == "clear_expl"
    assert act("No", ["E:\\BILLS\\x"], "bill") == "clear_expl"
    assert act("No", ["training for all"], "unknown", "prev") == "flip_eval_yes"
    assert act("Somewhat", ["nothing"], "unknown") == "clear_expl"


def test_places(spark):
    assert one(spark, ["in West Virginia and Virginia", "nowhere", None], places.state_in_text) == ["WV", None, None]


def test_enrichment(spark):
    assert one(spark, ["Cherokee / Native American / Band", "was a member", None], grounding.segments) == [["Cherokee"], [], []]


def test_state_upsert(spark):
    seen = spark.createDataFrame([("u", "a", "pending", "h", "c", "s", "v", 0.5, 1, 1)], "url string, source string, status string, change_hash string, content_hash string, session_id string, verdict string, confidence double, first_seen long, last_seen long")
    batch = spark.createDataFrame([(1, " U ", "b", "error", "", "", "", None, None), (2, "n", "b", "pending", "h", "", "", None, 0.1)], "ord long, url string, source string, status string, change_hash string, content_hash string, session_id string, verdict string, confidence double")
    out = {r["url"]: r for r in identity.upsert_seen(seen, batch, F.lit(9).cast("long")).collect()}
    assert (out["u"]["source"], out["u"]["change_hash"], out["u"]["session_id"], out["u"]["verdict"], out["u"]["confidence"], out["u"]["first_seen"], out["u"]["last_seen"]) == ("b", "", "s", "v", 0.5, 1, 9)
    assert out["n"]["first_seen"] == 9 and len(out) == 2
    again = identity.upsert_seen(seen, batch.limit(0), F.lit(9).cast("long"))
    assert again.count() == 1


def test_running_sum_over_ranges(spark):
    df = spark.range(0, 1000, 3).withColumnRenamed("id", "o")
    got = changes.running_sum(df, F.lit(1), "o", "n").orderBy("o").collect()
    assert [r["n"] for r in got] == list(range(1, len(got) + 1))
    assert changes.running_sum(df.limit(0), F.lit(1), "o", "n").count() == 0


def test_urls_like_the_standard_library(spark):
    """The column form agrees with a form made from urllib's parts, over random URLs."""
    import random
    from urllib.parse import urlparse

    def plain(url):
        text = (url or "").strip()
        if not text:
            return ""
        p = urlparse(text)
        scheme = (p.scheme or "https").lower().replace("http", "https").replace("httpss", "https")
        name = p.netloc.lower().removeprefix("www.")
        where = p.path.rstrip("/") or "/"
        if name.endswith("justice.gov") and where.startswith("/archives/"):
            where = where[len("/archives") :].rstrip("/") or "/"
        return f"{scheme}:" + (f"//{name}" if name else "") + where + (f"?{p.query}" if p.query else "")

    rng = random.Random(3)
    parts = [["http://", "https://", "HTTPS://"], ["a.gov", "WWW.B.Gov", "www.www.c.org", "justice.gov", "x.justice.gov:8080"], ["", "/", "/a", "/a/b/", "/archives/opa/1/", "/archives/", "/A//"], ["", "?", "?q=1", "?a=b&c=/d"], ["", "#", "#top?x=/"]]
    cases = ["".join(rng.choice(p) for p in parts) for _ in range(200)]
    assert one(spark, cases, urls.normalize_url) == [plain(c) for c in cases]


def test_registration_in_order(spark):
    """A row that is held up holds up no other: as a pass over the rows says."""
    rng = random.Random(3)
    rows = [(i, rng.choice([None, *(f"u{k}" for k in range(40))]), rng.choice([None, *(f"b{k}" for k in range(40))])) for i in rng.sample(range(1000), 150)]
    rows += [(2000, "x1", "y1"), (2001, "x1", "y2"), (2002, "x3", "y2")]
    df = spark.createDataFrame(rows, "o long, u string, b string")
    seen, want = set(), {}
    for o, u, b in sorted(rows):
        keys = {("u", u), ("b", b)} - {("u", None), ("b", None)}
        want[o] = bool(keys & seen)
        if not want[o]:
            seen |= keys
    got = {r["o"]: r["suppressed"] for r in identity.first_of_both(df, "o", F.col("u"), F.col("b")).collect()}
    assert got == want and not got[2002]
    assert identity.first_of_both(df.limit(0), "o", F.col("u"), F.col("b")).count() == 0


def test_names_are_matched_as_by_all_pairs(spark):
    rng = random.Random(5)
    first, last = ["kristina", "christina", "ann", "anne", "jo", "al", "running", "maria"], ["mcdonaldson", "macdonaldson", "wolf", "wolfe", "peltola", "lee", "smith-jones"]
    spoil = lambda w: w[: (k := rng.randrange(len(w)))] + rng.choice(["", "x", w[k]]) + w[k + 1 :] if rng.random() < 0.4 else w
    make = lambda: " ".join([spoil(rng.choice(first)), *rng.choice([[], ["b"]]), spoil(rng.choice(last))]).strip()
    names, roster = [(i, make()) for i in range(120)] + [(500, "kristina mcdonaldson"), (501, ""), (502, "x")], [(i, make()) for i in range(100)] + [(900, "christina macdonaldson"), (901, "")]
    key = lambda n: n.replace(" ", "")
    got = {r["id"]: (r["roster_id"], r["score"]) for r in matching.match_names(spark.createDataFrame([(i, n, key(n)) for i, n in names], "id long, name string, key string"), spark.createDataFrame([(i, n, key(n)) for i, n in roster], "roster_id long, roster_name string, roster_key string")).collect()}
    want = {}
    for i, a in names:
        scored = [(-matching.name_score(a, b), j) for j, b in roster if matching.confident(a, b, key(a), key(b))]
        if scored:
            want[i] = (min(scored)[1], -min(scored)[0])
    assert got == want and 500 in got


def test_normal_form_is_that_of_single_texts(spark):
    texts = ["", "  A  b\n", "re-\n port", "“q” ‘x’ – —", "ﬁne ½", "ÀÉ x​y", "tab\tnew\r\nline", "İ", None, "plain ASCII -\nword", "日本　語"]
    got = one(spark, texts, matching.normalized)
    assert got == [matching.plain(t) for t in texts]


def test_running_sum_between_quantiles(spark, monkeypatch):
    """One value far away does not put the others into one range."""
    monkeypatch.setattr(changes, "RANGE_ROWS", 10)
    values = [*range(95), 10**15]
    df = spark.createDataFrame([(v,) for v in values], "o long")
    got = {r["o"]: r["n"] for r in changes.running_sum(df, F.col("o") % 3, "o", "n").collect()}
    total, want = 0, {}
    for v in values:
        total += v % 3
        want[v] = total
    assert got == want


def test_states_of_districts(spark):
    texts = ["Texas: the Western District of Washington", "District of Alaska and Ohio", "in Ohio, then Utah", "Southern District of West Virginia", "district of nowhere"]
    assert one(spark, texts, places.state_in_text) == ["WA", "AK", "OH", "WV", None]
