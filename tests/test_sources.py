"""Payloads, pages, stores and streams on small inputs."""

from pyspark.sql import functions as F

from tessella.sources import html, payloads, stores
from tessella.streaming import incremental

PAGE = """<html><body><nav><ul><li><a href="/home">Home</a></li></ul></nav>
<ul><li>Order 7 on missing persons <a href="doc7.pdf">PDF</a></li><li><a href="mailto:x@y">mail</a><a href="https://else.gov/z">A long and telling title of a document here</a></li></ul>
<script>var a = "<a href='x'>no</a>";</script><p>Text &amp; more</p></body></html>"""


def test_links():
    got = html.page_links("https://a.gov/list/", PAGE)
    assert [(u, t, f) for u, t, _, f in got] == [("https://a.gov/home", "Home", True), ("https://a.gov/list/doc7.pdf", "PDF", False), ("https://else.gov/z", "A long and telling title of a document here", False)]
    assert got[1][2] == "Order 7 on missing persons PDF" and got[0][2] == ""
    assert html.page_links("https://a.gov/", None) == [] and html.page_links("", "<a href='http://[x'>t</a>") == []


def test_text():
    assert html.visible_text(PAGE).endswith("Text & more") and "var a" not in html.visible_text(PAGE) and "Home" not in html.visible_text(PAGE)
    assert html.visible_text(None) == ""


def test_table_documents():
    page = "<table><tr><th>No</th><th>Title</th></tr><tr><td>2021-03*</td><td></td><td>On x</td></tr><tr><td>2022-01</td><td>On y</td></tr><tr><td>2021-03</td><td>again</td></tr></table>"
    assert [x[0] for x in html.table_documents(page, "https://p/{number}")] == ["https://p/2022-01", "https://p/2021-03"]


def test_search_hits_as_list_and_map(spark):
    hit = '{"bill_id": 5, "title": "t", "last_action": "", "description": "d", "relevance": "x"}'
    rows = [(0, 1, f'{{"searchresult": {{"summary": {{}}, "results": [{hit}]}}}}'), (1, 1, f'{{"searchresult": {{"results": {{"0": {hit}, "1": {{"bill_id": 6, "summary": "s"}}}}}}}}'), (2, 1, "not json"), (3, 1, None)]
    got = payloads.search_hits(spark.createDataFrame(rows, "query_ix int, page int, body string")).orderBy("external_id").collect()
    assert [(r["external_id"], r["snippet"], r["relevance"], r["query_ix"]) for r in got] == [("5", "d", 0, 0), ("6", "s", 0, 1)]


def test_feeds(spark):
    rss = "<rss><channel><item><title>T</title><link>https://x/1</link><description>D</description></item><item><title>no link</title></item></channel></rss>"
    atom = '<feed xmlns:a="u"><entry><title>A</title><link href="https://y/2"/></entry></feed>'
    got = payloads.feed_items(spark.createDataFrame([(1, rss), (2, atom), (3, None), (4, "")], "feed_id long, body string")).orderBy("feed_id").collect()
    assert [(r["feed_id"], r["url"], r["snippet"]) for r in got] == [(1, "https://x/1", "D"), (2, "https://y/2", "A")]


def test_versions_and_guard(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    for n in range(4):
        stores.write_version(spark.range(n), root, keep=2)
    assert stores.versions(spark, root) == [3, 4]
    assert stores.read_version(spark, root, "id long").count() == 3
    assert not stores.guarded_replace(spark.range(2), root, 5) and stores.guarded_replace(spark.range(9), root, 5)
    assert stores.read_version(spark, root, "id long").count() == 9
    assert stores.read_version(spark, f"{root}x", "id long").count() == 0


def test_chunks(spark):
    lines = spark.createDataFrame([("k", i, "x" * n) for i, n in enumerate((3, 3, 9, 2))], "k string, i int, t string")
    assert [r["text"] for r in stores.chunks(lines, "k", "i", "t", 7).orderBy("chunk").collect()] == ["xxx\nxxx", "x" * 9, "xx"]


def test_seen_stream_survives_a_restart(spark, tmp_path):
    at = f"file://{tmp_path}"
    schema = "ord long, url string, source string, change_hash string, content_hash string, session_id string, verdict string, confidence double, status string"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")

    def run():
        stream = incremental.arrivals(spark, f"{at}/in", spark.createDataFrame([], schema).schema, files=1)
        incremental.maintain_seen(stream, f"{at}/state", f"{at}/decided", f"{at}/checkpoint").awaitTermination()

    put([(1, "A", "s", "h1", "", "", None, None, "discovered")])
    run()
    put([(2, "a ", "s", "h2", "", "", None, None, "rejected")])
    run()
    put([(3, "a", "s", "h3", "", "", None, None, "pending")])
    run()
    got = {r["ord"]: r["reason"] for r in spark.read.parquet(f"{at}/decided").collect()}
    assert got == {1: "new", 2: "change_hash_updated", 3: "already_rejected"}


def test_nightly_steps():
    def bad():
        raise ValueError

    assert incremental.nightly([("a", lambda: None), ("b", bad), ("c", lambda: None)], "a") == [("a", "ok"), ("b", "failed: ValueError"), ("c", "ok")]
    assert incremental.nightly([("a", bad), ("b", lambda: None)], "a") == [("a", "failed: ValueError")]


def test_first_arrivals(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "k long, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{at}/in")
    stream = incremental.first_arrivals(incremental.arrivals(spark, f"{at}/in", spark.read.parquet(f"{at}/in").schema), ["k"], "ts", "1 hour")
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["k"] for r in spark.read.schema("k long").parquet(f"{at}/out").collect()) == [1, 2]


def test_read_through_and_robots(spark):
    from tessella.sources import fetching

    asked = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "z"), (5, "b", "w")], "ord long, op string, param_key string")
    valid = spark.createDataFrame([("a", "y", "old")], "op string, param_key string, payload string")
    remote = spark.createDataFrame([("a", "x", "new"), ("b", "z", "new"), ("b", "w", "new")], "op string, param_key string, payload string")
    got = {r["ord"]: r["via"] for r in fetching.read_through(asked, valid, remote, budget=2).collect()}
    assert got == {1: "network", 2: "memory", 3: "cache", 4: "network", 5: "none"}
    pages = spark.createDataFrame([("https://a.gov/x/y",), ("https://a.gov/x/open/1",), ("https://b.gov/x",), ("https://a.gov",)], "url string")
    files = spark.createDataFrame([("a.gov", "User-agent: *\nDisallow: /\n\nUser-agent: Some\nAllow: /x/open\nDisallow: /x\nAllow: /x/late\nDisallow: /q?a=\n"), ("b.gov", None), ("c.gov", "Disallow: nothing here"), ("d.gov", "User-agent: *\nDisallow:\n")], "host string, body string")
    rules = fetching.robots_rules(files, "some/1.0")
    more = {"https://a.gov/x/late": False, "https://a.gov/q?a=1": False, "https://a.gov/q?b=1": True, "https://c.gov/x": True, "https://d.gov/x": True}
    assert {r["url"]: r["allowed"] for r in fetching.robots_allow(spark.createDataFrame([(x,) for x in more], "url string"), rules).collect()} == more
    assert {r["url"]: r["allowed"] for r in fetching.robots_allow(pages, rules).collect()} == {"https://a.gov/x/y": False, "https://a.gov/x/open/1": True, "https://b.gov/x": True, "https://a.gov": True}


def test_records_around_links():
    """The widest record that is short and has few links, within some steps; none in the frame."""
    row = "<li>Order 1 <span><a href='/1'>one</a></span> signed</li>"
    assert [x[2:] for x in html.page_links("https://a.gov/", f"<body class='menu'><ul>{row}</ul></body>")] == [("Order 1 one signed", False)]
    assert [x[2:] for x in html.page_links("https://a.gov/", f"<div id='side-Menu'><ul>{row}</ul></div><footer>{row}</footer>")] == [("", True), ("", True)]
    assert html.page_links("https://a.gov/", f"<section>{'long text ' * 50}<div>{row}</div></section>")[0][2] == "Order 1 one signed"
    many = "".join(f"<a href='/{i}'>{i}</a>" for i in range(5))
    assert html.page_links("https://a.gov/", f"<li>{many}</li>")[0][2] == ""
    deep = "<p>top " + "<b>" * 7 + "<a href='/x'>x</a>" + "</b>" * 7 + "</p>"
    assert html.page_links("https://a.gov/", deep)[0][2] == ""
    assert html.page_links("https://a.gov/", deep, html.Layout(steps=9))[0][2] == "top x"


def test_search_links(spark):
    """Links to the results page itself go, also in another form; others stay once, in the first query that shows them."""
    rows = [(0, 0, "https://x.gov/s?q=a", "http://www.x.gov/s/?q=a#top"), (0, 1, "https://x.gov/s?q=a", "https://x.gov/d1"), (0, 2, "https://x.gov/s?q=a", "https://x.gov/s?q=b"), (1, 0, "https://x.gov/s?q=b", "https://x.gov/d1"), (1, 1, "https://x.gov/s?q=b", "https://x.gov/s?q=b"), (1, 2, "https://x.gov/s?q=b", "http://www.x.gov/s/?q=a#top")]
    got = html.search_links(spark.createDataFrame(rows, "query_ix int, position int, results_url string, link string")).collect()
    assert sorted((r["query_ix"], r["position"]) for r in got) == [(0, 1), (0, 2), (1, 2)]


def test_binary_documents(spark):
    rows = [("text/html", "https://a.gov/x.pdf", b"caf\xe9"), ("Application/PDF", "https://a.gov/x", b"%PDF"), (None, "https://a.gov/x.pdf", b""), ("image/png", "https://a.gov/x", None)]
    d = spark.createDataFrame(rows, "mime string, url string, content binary")
    got = d.select(payloads.document_kind(F.col("mime")).alias("a"), payloads.document_kind(F.col("mime"), F.col("url")).alias("b"), payloads.latin_text(F.col("content")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("html", "html", "café"), ("pdf", "pdf", "%PDF"), ("unsupported", "pdf", ""), ("unsupported", "html", None)]
    cut = payloads.without_tail(F.lit("a END b END c"), F.col("url"), {"a.gov": "END", "b.gov": "a"})
    assert {r[0] for r in d.select(cut).collect()} == {"a "}
