"""URL expressions: plain columns over the RFC 3986 split, so that a URL that a strict parser refuses still has parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"

# Query keys and path words of search pages, and last path segments of index pages.
SEARCH_KEYS = ("q", "query", "s", "search", "searchtext", "searchterm", "keyword", "keywords", "term", "criteria", "kw")
SEARCH_WORDS = ("billsearch", "searchclient", "searchresults", "advancedsearch", "quicksearch")
INDEX_SEGMENTS = ("", "index", "home", "default", "sitemap", "search", "results")
PAGE_KEYS = ("page", "pageno", "pagenum", "pagenumber", "pg", "p")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), _SPLIT, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """The authority in lower case."""
    return F.lower(_part(url, 2))


def path(url: Column) -> Column:
    """The path without the parameters of its last segment."""
    return F.regexp_replace(_part(url, 3), r";[^/]*$", "")


def query_string(url: Column) -> Column:
    return _part(url, 4)


def _slashless(p: Column) -> Column:
    bare = F.regexp_replace(p, "/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def normalize_url(url: Column, archive_host: str = "justice.gov", archive_prefix: str = "/archives") -> Column:
    """One form for URLs that mean the same page: https, lower-case host without one leading `www.`, no fragment, no parameters,
    no trailing slash (`/` for an empty path); a path under archive_prefix of archive_host loses the prefix. '' for null or blank."""
    secure = F.when(scheme(url).isin("", "http"), "https").otherwise(scheme(url))
    bare_host = F.regexp_replace(host(url), r"^www\.", "")
    p = _slashless(path(url))
    moved = bare_host.endswith(archive_host) & p.startswith(archive_prefix + "/")
    p = F.when(moved, _slashless(F.substring(p, len(archive_prefix) + 1, 1 << 20))).otherwise(p)
    rest = F.when(query_string(url) != "", F.concat(F.lit("?"), query_string(url))).otherwise("")
    authority = F.when(bare_host != "", F.concat(F.lit("://"), bare_host)).otherwise(F.lit(":"))
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "").otherwise(F.concat(secure, authority, p, rest))


def url_key(url: Column) -> Column:
    """The lower-case normal form, by which cached documents are found."""
    return F.lower(F.coalesce(F.nullif(normalize_url(url), F.lit("")), F.trim(url)))


def source_type(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.when(low.contains("legiscan.com"), "legiscan").when(low.contains("federalregister.gov") | low.contains("justice.gov"), "federal").when(low.contains(".gov"), "gov").otherwise("unknown")


def record_source(url: Column, stated: Column) -> Column:
    """The stated source if it is one of the three known ones, else the one that the URL shows."""
    low = F.lower(F.coalesce(url, F.lit("")))
    federal = low.contains("justice.gov") | low.contains("federalregister.gov") | low.contains("whitehouse.gov")
    return F.when(stated.isin("LegiScan", "State Site", "Federal Site"), stated).when(low.contains("legiscan.com"), "LegiScan").when(federal, "Federal Site").otherwise("State Site")


def document_id(url: Column) -> Column:
    """The digits after /id/, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"/id/(\d+)", 1), F.lit(""))


def host_key(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def slug_key(url: Column) -> Column:
    """The last path segment in lower case without its ending."""
    last = F.element_at(F.split(_slashless(path(url)), "/"), -1)
    return F.lower(F.regexp_replace(last, r"\.(?:html?|pdf|aspx?)$", ""))


def slug_title(url: Column) -> Column:
    """A title from the last path segment; the URL itself where that leaves nothing."""
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    for ending in (".html", ".htm", ".pdf"):
        last = F.replace(last, F.lit(ending), F.lit(""))
    return F.coalesce(F.nullif(F.trim(F.translate(last, "-_", "  ")), F.lit("")), url)


def slug_year(url: Column) -> Column:
    """The first year 1900 to 2099 of the slug that stands between non-digits, or null."""
    return F.nullif(F.regexp_extract(slug_key(url), r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1), F.lit("")).cast("int")


def _filled_keys(url: Column) -> Column:
    """Lower-case query keys that have a value other than blanks."""
    pairs = F.split(query_string(url), "&")
    filled = F.filter(pairs, lambda p: F.trim(F.translate(F.substring_index(F.concat(p, F.lit("=")), "=", 2), "+", " ")).rlike(r"=\s*\S") & (F.instr(p, "=") > 0))
    return F.transform(filled, lambda p: F.lower(F.trim(F.substring_index(p, "=", 1))))


def shape_code(url: Column) -> Column:
    """Why a URL can't be one certain document: url_empty, url_not_http, url_no_host, url_search_page or url_nav_index; '' if it can.

    A search page has a filled search key, or a last segment that names a search or has the word `search` between - _ and dots.
    """
    segment = F.lower(F.coalesce(F.try_element_at(F.filter(F.split(path(url), "/"), lambda s: s != ""), F.lit(-1)), F.lit("")))
    stem = F.when(segment.contains("."), F.regexp_replace(segment, r"\.[^.]*$", "")).otherwise(segment)
    searched = F.arrays_overlap(_filled_keys(url), F.array(*map(F.lit, SEARCH_KEYS))) | stem.rlike("|".join(SEARCH_WORDS)) | F.array_contains(F.split(stem, "[-_.]"), "search")
    return (
        F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "url_empty")
        .when(~scheme(url).isin("http", "https"), "url_not_http")
        .when(host(url) == "", "url_no_host")
        .when(searched, "url_search_page")
        .when(stem.isin(*INDEX_SEGMENTS), "url_nav_index")
        .otherwise("")
    )


def valid_url(url: Column) -> Column:
    """The trimmed URL if it is http(s) with a host, else null."""
    return F.when(scheme(url).isin("http", "https") & (host(url) != ""), F.trim(url))


def page_number(url: Column) -> Column:
    """The page a listing URL shows: its first numeric page key, else a /page/N ending, else 1; at least 1."""
    keys = "|".join(PAGE_KEYS)
    by_key = F.nullif(F.regexp_extract(F.concat(F.lit("&"), query_string(url)), rf"(?i)&(?:{keys})=([0-9]+)(?:&|$)", 1), F.lit(""))
    by_path = F.nullif(F.regexp_extract(_part(url, 3), r"(?i)/page/([0-9]+)/?$", 1), F.lit(""))
    return F.greatest(F.lit(1), F.coalesce(by_key.cast("int"), by_path.cast("int"), F.lit(1)))


def page_url(url: Column, page: Column) -> Column:
    """The URL with its page indicator set to `page`, or '' if it has none."""
    keys = "|".join(PAGE_KEYS)
    has_key = F.concat(F.lit("&"), query_string(url)).rlike(rf"(?i)&(?:{keys})=")
    number = page.cast("string")
    with_key = F.regexp_replace(url, F.lit(rf"(?i)^([^?#]*\?(?:[^#&]*&)*?(?:{keys})=)[^&#]*"), F.concat(F.lit("$1"), number))
    with_path = F.regexp_replace(url, F.lit(r"(?i)(/page/)[0-9]+(/?)$"), F.concat(F.lit("$1"), number, F.lit("$2")))
    return F.when(has_key, with_key).when(_part(url, 3).rlike(r"(?i)/page/[0-9]+/?$"), with_path).otherwise("")


def percent_encoded(text: Column) -> Column:
    """Percent-encoding that leaves letters, digits, _ . - ~ and / as they are."""
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def search_url(template: Column, query: Column) -> Column:
    """A search template with {query} filled in; without the placeholder, the template itself."""
    return F.replace(template, F.lit("{query}"), percent_encoded(query))


def host_suffixes(url: Column) -> Column:
    """The host and each of its parent domains of two labels at least, longest first."""
    labels = F.split(host_key(url), r"\.")
    n = F.size(labels)
    return F.when(n < 2, F.array(host_key(url))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def domain_allowed(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    allowed = F.lit(False)
    for d in domains:
        allowed = allowed | (host_key(url) == d) | host_key(url).endswith("." + d)
    return allowed
