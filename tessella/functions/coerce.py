"""Coercion of record fields to their domains, and date rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bills import literal_map
from .text import text_or_empty

# Domains of the select fields.
CATEGORIES = ("Taskforce", "Day of Recognition", "US Law Enforcement", "Tribal Law Enforcement", "Data Collection", "MMIP Relatives")
STATUSES = ("Pending", "Passed", "Failed")
CHAMBER_CHOICES = ("Executive", "Senate", "House")
TBD_FIELDS = ("Mechanisms for Evaluation?", "Gender Inclusive Language?", "Prevention Efforts?")
SOMEWHAT_FIELDS = ("Level of Survivor / Relative Input?", "Centering of Indigenous Voices?")

# The first and the day after the last of each administration's term.
TERMS = (("2009-01-20", "2017-01-20", "Obama Administration"), ("2017-01-20", "2021-01-20", "Trump Administration"), ("2021-01-20", "2025-01-20", "Biden Administration"), ("2025-01-20", "2033-01-20", "Trump Administration"))


def _low(value: Column) -> Column:
    return F.lower(F.trim(text_or_empty(value)))


def choice(value: Column, domain: tuple[str, ...], default: str) -> Column:
    return F.coalesce(F.element_at(literal_map({x.lower(): x for x in domain}), _low(value)), F.lit(default))


def eval_answer(value: Column) -> Column:
    """Yes, Somewhat or No (for anything else)."""
    bare = F.regexp_replace(_low(value), r"\.+$", "")
    return F.when(bare == "yes", "Yes").when(bare == "somewhat", "Somewhat").otherwise("No")


def field_answer(field: Column, value: Column) -> Column:
    """An answer in the domain of its field: fields without `Somewhat` take what is neither yes nor no as open; blanks are No."""
    text = F.regexp_replace(F.trim(text_or_empty(value)), r"\.+$", "")
    low = F.lower(text)
    open_ = F.when(low == "yes", "Yes").when(low == "no", "No").otherwise("TBD or TCRP Specific")
    return F.when(text == "", "No").when(field.isin(*TBD_FIELDS), open_).when(field.isin(*SOMEWHAT_FIELDS), eval_answer(value)).otherwise(text)


def status(value: Column) -> Column:
    return choice(value, STATUSES, "Pending")


def chamber(value: Column) -> Column:
    low = _low(value)
    known = F.element_at(literal_map({x.lower(): x for x in CHAMBER_CHOICES}), low)
    return F.coalesce(known, F.when(low.contains("senate"), "Senate").when(low.contains("house") | low.contains("assembly"), "House").otherwise("Executive"))


def iso_date(value: Column) -> Column:
    """YYYY-MM-DD of a text in one of four forms (2026-05-05, 05/05/2026, May 5, 2026 with the month in full or short), else null."""
    t = F.trim(text_or_empty(value))
    tries = [F.when(t.rlike(shape), F.try_to_date(t, form)) for shape, form in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"))]
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).otherwise(F.date_format(F.coalesce(*tries), "yyyy-MM-dd"))


def category_tokens(value: Column) -> Column:
    """The parts of a category text, whether it is a JSON or printed list or comma-separated, without brackets and quotes."""
    parts = F.transform(F.split(text_or_empty(value), ","), lambda x: F.regexp_replace(F.trim(x), r"""^[\[\]'"]+|[\[\]'"]+$""", ""))
    return F.filter(parts, lambda x: x != "")


def categories(value: Column, domain: tuple[str, ...] = CATEGORIES) -> Column:
    """The known categories, each once, in the order met."""
    named = literal_map({c.lower(): c for c in domain})
    return F.array_distinct(F.filter(F.transform(category_tokens(value), lambda x: F.element_at(named, F.lower(F.trim(x)))), lambda x: x.isNotNull()))


def confidence(value: Column) -> Column:
    return F.coalesce(text_or_empty(value).try_cast("double"), F.lit(0.0))


def truth(value: Column) -> Column:
    return _low(value).isin("true", "yes", "1")


def state_code(value: Column) -> Column:
    t = F.trim(text_or_empty(value))
    return F.when(F.lower(t) == "national", "National").when(F.length(t) <= 3, F.upper(t)).otherwise(t)


def administration(date: Column) -> Column:
    """The administration in office on a date; null before the first and after the last term."""
    out = None
    for start, end, name in TERMS:
        inside = (date >= F.lit(start).cast("date")) & (date < F.lit(end).cast("date"))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def quota_reset(today: Column) -> Column:
    """The first of the next month, or today if it is a first."""
    return F.when(F.dayofmonth(today) == 1, today).otherwise(F.add_months(F.trunc(today, "MM"), 1))


def long_date(date: Column) -> Column:
    return F.concat(F.date_format(date, "MMMM"), F.lit(" "), F.dayofmonth(date).cast("string"), F.lit(", "), F.year(date).cast("string"))


def explanation(answer: Column, text: Column) -> Column:
    """No for No; Somewhat for a blank Somewhat; else the text without its preamble."""
    from .text import strip_preamble

    return F.when(answer == "No", "No").when((answer == "Somewhat") & (F.trim(text_or_empty(text)) == ""), "Somewhat").otherwise(strip_preamble(text))


def bar(done: Column, total: Column, width: int = 32) -> Column:
    """[===>   ]: filled in proportion, with a point until it is full; question marks without a total."""
    now = F.greatest(F.lit(0), F.least(done, total))
    full = F.floor(F.lit(width) * now / total).cast("int")
    part = F.concat(F.repeat(F.lit("="), full), F.lit(">"), F.repeat(F.lit(" "), F.lit(width - 1) - full))
    return F.concat(F.lit("["), F.when(total <= 0, "?" * width).when(full >= width, "=" * width).otherwise(part), F.lit("]"))
