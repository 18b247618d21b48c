"""Text expressions: normal forms, words, lexicon screening, quotes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing of a title's subject, and of a name's bearer.
TITLE_STOPWORDS = ("a", "an", "and", "the", "of", "for", "to", "in", "on", "by", "as", "at", "or", "act", "bill", "state", "department")
GENERIC_NAMES = ("governor", "senator", "representative", "president", "secretary", "attorney", "general", "office", "district")

# The default lexicon of the screening, and the search strings that it goes with.
ACRONYMS = ("mmiw", "mmip", "mmiwg")
GROUP_TERMS = ("indigenous", "native american", "american indian", "alaska native", "native hawaiian", "tribal", "tribe", "first nations", "mmiw", "mmip", "mmiwg", "indian country", "on-reservation", "on reservation")
HARM_TERMS = ("missing", "murdered", "homicide", "trafficking", "violence", "unsolved", "disappeared", "disappearance", "cold case", "murder", "kidnapping", "abducted")

# What the head of a page of search results says.
SEARCH_MARKERS = r"(?i)search results?\s+for\b|\b(?:no|0)\s+results?\s+(?:found|match)|your search .{0,40}returned|rezultati pretrage|r[ée]sultats de (?:la )?recherche|resultados de (?:la )?b[úu]squeda"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def one_spaced(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), r"(?U)\s+", " ")


def visible_length(text: Column) -> Column:
    return F.length(F.trim(one_spaced(text)))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether any term stands in the text, upper and lower case alike; terms may be parts of words."""
    low, out = F.lower(text_or_empty(text)), F.lit(False)
    for t in terms:
        out = out | F.contains(low, F.lit(t))
    return out


def keyword_prescreen(text: Column, acronyms: Sequence[str] = ACRONYMS, groups: Sequence[str] = GROUP_TERMS, harms: Sequence[str] = HARM_TERMS) -> Column:
    """Any acronym, or a term of each group."""
    return contains_any(text, acronyms) | (contains_any(text, groups) & contains_any(text, harms))


def significant_words(text: Column) -> Column:
    """Distinct lower-case words of four or more letters, digits and apostrophes that are no stopwords, in the order met."""
    words = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit("[a-z0-9']+"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*TITLE_STOPWORDS)))


def title_overlap(title: Column, text: Column) -> Column:
    """The share of the title's significant words that the text has; 0 without any."""
    words = significant_words(title)
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(words, significant_words(text))) / F.size(words))


def strip_preamble(text: Column) -> Column:
    """A text without `here is (a|an)` and then `the following` at its start."""
    out = F.trim(F.regexp_replace(F.trim(text_or_empty(text)), r"(?i)^here is (a |an )?", ""))
    return F.trim(F.regexp_replace(out, r"(?i)^the following ", ""))


def numbered_list(items: Column) -> Column:
    """1. item lines; '' for an empty array."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def quote_list(items: Column) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) == 0, "No").otherwise(numbered_list(items))


def quotes(text: Column) -> Column:
    """The items of a numbered list; a text without numbers is one item, `No` and blanks are none."""
    t = F.trim(text_or_empty(text))
    parts = F.filter(F.transform(F.split(t, r"\n\s*[0-9]+[.)]\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when((t == "") | (F.lower(t) == "no"), F.array().cast("array<string>")).when(F.size(parts) > 1, parts).otherwise(F.array(t))


def slug(text: Column, most: int = 80) -> Column:
    out = F.regexp_replace(F.lower(text_or_empty(text)), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(out, "^-+|-+$", ""), 1, most)


def merge_warnings(old: Column, added: Column) -> Column:
    """The parts of a `;` list, then those of the array that it lacks, joined by `; `."""
    parts = F.filter(F.transform(F.split(text_or_empty(old), ";"), lambda x: F.trim(x)), lambda x: x != "")
    new = F.array_distinct(F.array_except(F.filter(added, lambda x: x != ""), parts))
    return F.array_join(F.concat(parts, new), "; ")


def without_warnings(old: Column, pattern: str) -> Column:
    parts = F.filter(F.transform(F.split(text_or_empty(old), ";"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(pattern))
    return F.array_join(parts, "; ")


def without_search_note(text: Column) -> Column:
    """A snippet without the line that states the search it came from."""
    return F.regexp_replace(text_or_empty(text), r"\n?\(search: [^)\n]*\)", "")


def snippet(link_text: Column, context: Column, query: Column) -> Column:
    """Link text and its context, unless that is the same or a URL; the search that found it as a last line, if not said already."""
    real = (text_or_empty(context) != "") & (context != link_text) & ~F.lower(F.trim(context)).rlike("^https?://")
    base = F.when(real, F.trim(F.concat(link_text, F.lit("\n"), context))).otherwise(link_text)
    noted = (text_or_empty(query) != "") & ~F.contains(F.lower(base), F.lower(query))
    return F.when(noted, F.trim(F.concat(base, F.lit("\n(search: "), query, F.lit(")")))).otherwise(base)


# Link texts that say nothing.
FILLER = r"(?i)^(?:pdf|html?|docx?|rtf|txt|link|here|more|details?|full text|open|view|download|read|read more|read the \w+|click here|continue reading|learn more|see more|view (?:pdf|document|order|proclamation)|download (?:pdf|document)|read (?:pdf|document|order|proclamation))$"
DOCUMENT_URL = r"(?i)\.pdf(?:$|[?#])|/assets/|view\?doc=|executive[- ]order|/eo[-/]|/documents/"
ORDER_TITLE = r"(?i)\b(?:executive\s+order|proclamation|administrative\s+order|declaration|emergency\s+proclamation)\b"


def weak_anchor(text: Column, letters: int = 40) -> Column:
    """Whether a link's text can't be a title: blank, a URL, filler, or fewer letters than `letters`."""
    t = F.trim(text_or_empty(text))
    return (t == "") | F.lower(t).rlike("^https?://") | t.rlike(FILLER) | (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) < letters)


def fetch_document(content_type: Column, link_text: Column, url: Column) -> Column:
    """Whether a link's document must be read: an order or proclamation whose title or URL looks like one."""
    titled = text_or_empty(link_text).rlike(ORDER_TITLE)
    return content_type.isin("executive_order", "proclamation") & (titled | (weak_anchor(link_text) & url.rlike(DOCUMENT_URL)))


# -- names -----------------------------------------------------------------------------------------------


def proper_names(text: Column) -> Column:
    """Lower-case words of four or more letters that begin with a capital and are no stopwords."""
    words = F.transform(F.split(text_or_empty(text), r"[\s,;/]+"), lambda w: F.regexp_replace(w, "[^A-Za-z'-]", ""))
    words = F.filter(words, lambda w: (F.length(w) > 3) & w.rlike("^[A-Z]") & ~F.lower(w).isin(*TITLE_STOPWORDS))
    return F.transform(words, lambda w: F.lower(w))


def all_in(words: Column, text: Column) -> Column:
    low = F.lower(text_or_empty(text))
    return F.forall(words, lambda w: F.contains(low, w))


def name_grounded(name: Column, text: Column) -> Column:
    """Whether all words of a name that are more than an office stand in the text (all, if it has none such)."""
    words = proper_names(name)
    own = F.filter(words, lambda w: ~w.isin(*GENERIC_NAMES))
    return F.when(F.size(own) > 0, all_in(own, text)).otherwise(all_in(words, text))


# Month names, and what a chamber's details may claim.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
CLAIMS = ("proclamation", "governor", "signed into law", "enacted", "vetoed")


def date_grounded(date: Column, text: Column) -> Column:
    """Whether the text states the ISO date: its year, and its day in words or figures. The first of January, which stands for unknown dates, must be spelled out."""
    body, part = text_or_empty(text), lambda k: F.regexp_extract(text_or_empty(date), r"^\s*([0-9]{4})-([0-9]{2})-([0-9]{2})", k)
    year, month, day = part(1), part(2), part(3)
    m, d = F.nullif(month, F.lit("")).cast("int"), F.nullif(day, F.lit("")).cast("int")
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.when(m.between(1, 12), m).otherwise(1))
    ms, ds = m.cast("string"), d.cast("string")
    worded = F.concat(F.lit("(?i)"), name, F.lit(r"\s+0?"), ds, F.lit(r"\b,?\s*"), year)
    figures = F.concat(F.lit("(?:"), ms, F.lit("/"), ds, F.lit("/|"), month, F.lit("/"), day, F.lit("/|"), ms, F.lit("-"), ds, F.lit("-|"), month, F.lit("-"), day, F.lit("-)"), year)
    first = F.regexp_like(body, F.concat(F.lit(r"(?i)january\s+1\b|01-01|1/1/"), year))
    iso = F.contains(body, F.concat_ws("-", year, month, day))
    stated = iso | (m.between(1, 12) & (F.regexp_like(body, worded) | F.regexp_like(body, figures)))
    return F.when(year == "", False).when(~F.contains(body, year), False).when((month == "01") & (day == "01"), first).otherwise(stated)


def chamber_grounded(details: Column, text: Column) -> Column:
    low, body, out = F.lower(text_or_empty(details)), F.lower(text_or_empty(text)), F.lit(True)
    for term in CLAIMS:
        out = out & (~F.contains(low, F.lit(term)) | F.contains(body, F.lit(term)))
    return out & all_in(proper_names(details), text)


# -- sections of a law -------------------------------------------------------------------------------------

# Marks of an operative part, in order of preference, and plain texts that stand in for them.
_SECTIONS = (r"(?i)\bsec(?:tion)?\.?\s*2\b", r"(?i)\bchapter\s+[0-9]+", r"(?i)\barticle\s+[0-9]+")
_MARKERS = ("the people of the state of california do enact", "chapter ", "article ")


def _operative_start(text: Column) -> Column:
    """Where the operative text begins, from 1: the first kind of section mark that the text has, else of marker past the start; 0 if none."""
    found = [F.nullif(F.regexp_instr(text, F.lit(p)), F.lit(0)) for p in _SECTIONS]
    plain = [F.when(F.instr(F.lower(text), m) > 1, F.instr(F.lower(text), m)) for m in _MARKERS]
    return F.coalesce(*found, *plain, F.lit(0))


def findings_text(text: Column) -> Column:
    """What stands before the operative text; all of it where none begins."""
    start = _operative_start(text)
    return F.when(start > 0, F.substring(text, F.lit(1), start - 1)).otherwise(text)


def operative_text(text: Column) -> Column:
    """The text from its operative start, up to where a first section begins again."""
    body = F.substring(text, F.greatest(_operative_start(text), F.lit(1)), F.length(text))
    again = F.regexp_instr(F.substring(body, F.lit(13), F.length(body)), F.lit(r"(?im)\bsection\s+1\.?\b"))
    return F.when(again > 0, F.substring(body, F.lit(1), again + 11)).otherwise(body)
