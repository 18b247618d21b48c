"""JSON and XML payloads of searches, registers, feeds and manifests as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.identity import first_rows

_HIT = "struct<bill_id: string, state: string, url: string, title: string, last_action: string, description: string, summary: string, change_hash: string, relevance: string>"


def search_hits(payloads: DataFrame) -> DataFrame:
    """Candidates of search payloads (query_ix, page, body): results are a list or a map of ordinals; of a bill's hits, the first by query, page and place stays."""
    root = "searchresult struct<results: string>"
    body = payloads.select("query_ix", "page", F.from_json("body", root)["searchresult"]["results"].alias("r"))
    as_list = F.from_json("r", f"array<{_HIT}>")
    as_map = F.map_values(F.from_json("r", f"map<string, {_HIT}>"))
    hits = body.select("query_ix", "page", F.posexplode(F.when(F.col("r").startswith("["), as_list).otherwise(as_map)).alias("place", "h"))
    text = F.coalesce(*(F.nullif(F.col(f"h.{c}"), F.lit("")) for c in ("last_action", "description", "summary")), F.lit(""))
    flat = hits.where("coalesce(h.bill_id, '') <> ''").select("query_ix", "page", "place", F.col("h.bill_id").alias("external_id"), F.col("h.state").alias("state"), F.col("h.url").alias("url"), F.col("h.title").alias("title"), text.alias("snippet"), F.col("h.change_hash").alias("change_hash"), F.coalesce(F.col("h.relevance").try_cast("int"), F.lit(0)).alias("relevance"))
    return first_rows(flat, ["external_id"], F.col("query_ix"), F.col("page"), F.col("place"))


def pages_to_fetch(total: Column, most: int) -> Column:
    """The page numbers of a search: all that it has, up to a limit."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(total, F.lit(most))))


def master_list(payloads: DataFrame) -> DataFrame:
    """(session_id, bill_id, number, change_hash) of master lists (session_id, body): a map of ordinals beside a `session` entry."""
    entries = F.map_filter(F.from_json("body", "map<string, struct<bill_id: long, number: string, change_hash: string>>"), lambda k, v: k != "session")
    return payloads.select("session_id", F.explode(entries).alias("ordinal", "e")).select("session_id", "e.*")


def register_items(payloads: DataFrame) -> DataFrame:
    """(url, title, snippet) of register payloads: the HTML link else the PDF's, the excerpt, abstract or description without tags."""
    item = "struct<html_url: string, pdf_url: string, title: string, excerpts: string, abstract: string, description: string>"
    i = payloads.select("ord", F.posexplode(F.from_json("body", f"results array<{item}>")["results"]).alias("place", "i"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.col("i.excerpts"), F.lit("")), "<[^>]*>", " "), r"\s+", " "))
    snippet = F.coalesce(F.nullif(bare, F.lit("")), F.nullif(F.trim("i.abstract"), F.lit("")), F.nullif(F.trim("i.description"), F.lit("")), F.lit(""))
    url = F.coalesce(F.nullif("i.html_url", F.lit("")), F.nullif("i.pdf_url", F.lit("")))
    return first_rows(i.select("ord", "place", url.alias("url"), F.coalesce(F.nullif("i.title", F.lit("")), url).alias("title"), F.substring(snippet, 1, 500).alias("snippet")).where("url IS NOT NULL"), ["url"], F.col("ord"), F.col("place"))


def press_items(payloads: DataFrame) -> DataFrame:
    """(url, title, snippet, last_page) of press payloads with an OK status; last_page tells that no page follows."""
    schema = "metadata struct<responseInfo: struct<status: string>, resultset: struct<count: string, page: string, pagesize: string>>, results array<struct<url: string, title: string, teaser: string, body: string>>"
    p = payloads.select("ord", F.from_json("body", schema).alias("p")).where("coalesce(p.metadata.responseInfo.status, '200') = '200'")
    number = lambda c, d: F.coalesce(F.col(f"p.metadata.resultset.{c}").try_cast("int"), F.lit(d))
    last = number("page", 0) * number("pagesize", 20) >= number("count", 0)
    i = p.select("ord", last.alias("last_page"), F.posexplode("p.results").alias("place", "i")).where("coalesce(i.url, '') <> ''")
    raw = F.coalesce(F.nullif("i.teaser", F.lit("")), "i.body", F.lit(""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, "<[^>]*>", " "), r"\s+", " "))
    return first_rows(i.select("ord", "place", F.col("i.url").alias("url"), F.coalesce(F.nullif("i.title", F.lit("")), "i.url").alias("title"), F.substring(bare, 1, 500).alias("snippet"), "last_page"), ["url"], F.col("ord"), F.col("place"))


def legislation_items(payloads: DataFrame, template: str) -> DataFrame:
    """(url, title, snippet) of legislation payloads that report success; the URL from {session} and {number}."""
    bill = "struct<session: string, year: string, basePrintNo: string, printNo: string, title: string, summary: string>"
    p = payloads.select("ord", F.from_json("body", f"success boolean, result struct<items: array<struct<result: {bill}>>>").alias("p")).where("p.success")
    i = p.select("ord", F.posexplode("p.result.items").alias("place", "i")).select("ord", "place", "i.result.*")
    session, number = F.coalesce("session", "year"), F.coalesce("basePrintNo", "printNo")
    url = F.replace(F.replace(F.lit(template), F.lit("{session}"), session), F.lit("{number}"), number)
    return first_rows(i.where(session.isNotNull() & number.isNotNull()).select("ord", "place", url.alias("url"), F.coalesce(F.nullif("title", F.lit("")), number).alias("title"), F.substring(F.coalesce("summary", F.lit("")), 1, 500).alias("snippet")), ["url"], F.col("ord"), F.col("place"))


def document_kind(mime: Column, url: Column | None = None) -> Column:
    """html, pdf or unsupported by MIME type; with a URL, its ending decides where the type does not, and all else is html."""
    said = F.lower(F.coalesce(mime, F.lit("")))
    other = F.lit("unsupported") if url is None else F.when(url.endswith(".pdf"), "pdf").otherwise("html")
    return F.when(F.contains(said, F.lit("text/html")), "html").when(F.contains(said, F.lit("application/pdf")), "pdf").otherwise(other)


def latin_text(content: Column) -> Column:
    """The characters of binary content in latin-1, in which every byte is one."""
    return F.decode(content, "ISO-8859-1")


def without_tail(text: Column, url: Column, marks: dict[str, str]) -> Column:
    """The text up to the first mark of its site, for sites whose domain the URL names."""
    out = text
    for domain, mark in marks.items():
        out = F.when(F.contains(url, F.lit(domain)), F.substring_index(out, mark, 1)).otherwise(out)
    return out


def feed_items(feeds: DataFrame) -> DataFrame:
    """(feed_id, place, title, url, snippet) of RSS 2.0 or Atom bodies (feed_id, body): link, href or guid; description, summary or title."""
    def part(path: str) -> Column:
        return F.nullif(F.trim(F.xpath_string("item", F.lit(path))), F.lit(""))

    item = F.regexp_extract_all("body", F.lit(r"(?s)<(?:item|entry)[ >].*?</(?:item|entry)>"), 0)
    i = feeds.select("feed_id", F.posexplode(item).alias("place", "item")).withColumn("item", F.regexp_replace("item", r"<(/?)[a-z]+:([A-Za-z]+)", "<$1$2"))
    title = F.coalesce(part("/*/title"), F.lit(""))
    out = i.select("feed_id", "place", title.alias("title"), F.coalesce(part("/*/link/@href"), part("/*/link"), part("/*/guid")).alias("url"), F.coalesce(part("/*/description"), part("/*/summary"), title).alias("snippet"))
    return out.where("url IS NOT NULL").withColumn("snippet", F.substring("snippet", 1, 500))


def manifests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Sources of manifest files {state, sources: [...]}: one row a source, the file's state where the source has none."""
    m = spark.read.schema(f"state string, sources array<struct<{schema}>>").option("multiLine", True).json(path)
    return m.select(F.col("state").alias("file_state"), F.explode("sources").alias("s")).select("file_state", "s.*")


def upgraded(sources: DataFrame) -> DataFrame:
    """(…, method, url, error): legacy fields fill new ones; rows without a URL for their method carry an error."""
    method = F.coalesce(F.nullif("method", F.lit("")), F.when(F.col("rss_url").isNotNull(), "rss").when(F.col("search_url").isNotNull(), "search").otherwise("index"))
    url = F.coalesce(F.nullif("url", F.lit("")), F.when(method == "rss", F.col("rss_url")).when(method == "search", F.col("search_url")))
    return sources.withColumn("_m", method).withColumn("_u", url).drop("method", "url").withColumnsRenamed({"_m": "method", "_u": "url"}).withColumn("error", F.when(F.col("url").isNull(), F.concat("method", F.lit(" needs a url"))).otherwise(""))


def year_urls(sources: DataFrame, this_year: int, back: int = 7) -> DataFrame:
    """(…, year, probe): a URL for each template with {year} of proclamation sources, newest first."""
    s = sources.where("content_type = 'proclamation'").select("*", F.explode("templates").alias("_t")).where(F.contains("_t", F.lit("{year}")))
    s = s.select("*", F.explode(F.sequence(F.lit(this_year), F.lit(this_year - back), F.lit(-1))).alias("year"))
    return s.withColumn("probe", F.replace("_t", F.lit("{year}"), F.col("year").cast("string"))).drop("_t", "templates")
