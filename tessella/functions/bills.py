"""Bill numbers, statuses and sponsors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The form of a bill's URL, and last actions that end a bill.
_BILL_URL = r"(?i)legiscan\.com/([A-Z]{2})/(?:bill|text)/([A-Z]+[0-9]+)/([0-9]{4})"
_FAILED = r"(?i)failed to adopt|failed passage|died in|withdrawn"

# Progression and chamber codes, and chamber letters that stand for each other.
PROGRESSION = ("Pre-filed or pre-introduction", "Introduced", "Engrossed", "Enrolled", "Passed", "Vetoed", "Failed Limited support based on state", "Override Progress", "Chaptered Progress", "Refer Progress", "Report Pass Progress", "Report DNP Progress", "Draft Progress")
CHAMBERS = {"A": "House", "S": "Senate", "H": "House", "L": "Legislative Body", "N/A": "Not Available"}
ALIASES = {"HB": "HR", "HR": "HB", "SB": "S", "S": "SB"}


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def bill_key_ws(number: Column) -> Column:
    """Upper case without white space."""
    return F.regexp_replace(F.upper(_text(number)), r"\s+", "")


def bill_key_norm(number: Column) -> Column:
    """Upper-case letters and digits; zeros that lead a number after its letters are dropped."""
    compact = F.regexp_replace(F.upper(_text(number)), "[^A-Z0-9]", "")
    return F.regexp_replace(compact, "^([A-Z]+)0*([0-9]+)$", "$1$2")


def identity_key(state: Column, number: Column) -> Column:
    """state|number in normal form, or null if either is blank."""
    s, n = F.upper(F.trim(_text(state))), bill_key_ws(number)
    return F.when((s != "") & (n != ""), F.concat_ws("|", s, n))


def bill_url_part(url: Column, part: str) -> Column:
    """state, number or year of a bill's URL, or null."""
    found = F.regexp_extract(_text(url), _BILL_URL, {"state": 1, "number": 2, "year": 3}[part])
    found = F.nullif(F.upper(found), F.lit(""))
    return found.cast("int") if part == "year" else found


def number_variants(number: Column) -> Column:
    """The normal form and the one with the other chamber's letters."""
    norm = bill_key_norm(number)
    other = F.element_at(literal_map(ALIASES), F.regexp_extract(norm, "^([A-Z]+)[0-9]+$", 1))
    return F.filter(F.array(norm, F.concat(other, F.regexp_extract(norm, "^[A-Z]+([0-9]+)$", 1))), lambda x: x.isNotNull() & (x != ""))


def _dotted(letters: Column, digits: Column) -> Column:
    """A pattern for letters with dots and spaces between, then the number with any leading zeros."""
    spaced = F.regexp_replace(letters, "(?<=.)(?=.)", r"\\.?\\s*")
    return F.concat(F.lit(r"(?i)\b"), spaced, F.lit(r"\.?\s*0*"), digits, F.lit(r"\b"))


def number_in_text(number: Column, text: Column) -> Column:
    """Whether the number stands in the text: without separators anywhere, dotted or spaced, as an assembly number, or as an administrative order. A blank number always does."""
    norm, body = bill_key_norm(number), _text(text)
    hay = F.regexp_replace(F.upper(body), "[^A-Z0-9]", "")
    letters = F.regexp_extract(norm, "^([A-Z]+)([0-9]+)$", 1)
    digits = F.regexp_extract(norm, "^([A-Z]+)([0-9]+)$", 2)
    other = F.element_at(literal_map(ALIASES), letters)
    plain = F.exists(number_variants(number), lambda v: F.contains(hay, v))
    dotted = (letters != "") & (F.regexp_like(body, _dotted(letters, digits)) | F.coalesce(F.regexp_like(body, _dotted(other, digits)), F.lit(False)))
    up = F.upper(body)
    assembly = (letters == "A") & (F.regexp_like(up, F.concat(F.lit(r"\b"), digits, F.lit(r"\b[^\n]{0,40}\bIN ASSEMBLY\b"))) | F.regexp_like(up, F.concat(F.lit(r"\bASSEMBLY\b[^\n]{0,40}\b"), digits, F.lit(r"\b"))) | F.regexp_like(up, F.concat(F.lit(r"\bA\.?\s*"), digits, F.lit(r"\b"))))
    order = (letters == "AO") & F.regexp_like(body, F.concat(F.lit(r"(?i)\bADMINISTRATIVE\s+ORDER\s+(?:NO\.?\s*)?"), digits, F.lit(r"\b")))
    return (F.trim(_text(number)) == "") | plain | dotted | assembly | order


def status(last_action: Column, completed: Column, code: Column, year_end: Column, today: Column) -> Column:
    """Failed, Passed or Pending, in the order: a failing last action, completion, the end of the session."""
    failed = F.coalesce(last_action, F.lit("")).rlike(_FAILED)
    over = year_end.isNotNull() & (today > F.make_date(year_end, F.lit(12), F.lit(31)))
    return F.when(failed, "Failed").when((completed == 1) & (code == 6), "Failed").when(completed == 1, "Passed").when(over, "Failed").otherwise("Pending")


def progression(code: Column) -> Column:
    return F.coalesce(F.element_at(literal_map({str(i): x for i, x in enumerate(PROGRESSION)}), code.cast("string")), F.lit("Unknown Status"))


def chamber(body: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(CHAMBERS), F.coalesce(body, F.lit("N/A"))), F.lit("Unknown"))


def latest_action(history: Column) -> Column:
    """date - chamber: action of the last entry of an array of structs, or N/A."""
    last = F.try_element_at(history, F.lit(-1))
    part = lambda f: F.coalesce(last[f], F.lit("N/A"))
    return F.when(F.coalesce(F.size(history), F.lit(0)) > 0, F.concat(part("date"), F.lit(" - "), part("chamber"), F.lit(": "), part("action"))).otherwise("N/A")


# -- sponsors --------------------------------------------------------------------------------------------

# Words that mark an office text as a career history.
CAREER = ("present", "–", "-", "19", "20", "speaker of", "state representative", "state senator")


def split_sponsors(sponsors: Column) -> Column:
    """The parts between commas that stand outside square brackets, trimmed; a last empty part is left out."""
    empty = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, ch: Column) -> Column:
        cut = (ch == ",") & (s["depth"] == 0)
        depth = F.when(ch == "[", s["depth"] + 1).when((ch == "]") & (s["depth"] > 0), s["depth"] - 1).otherwise(s["depth"])
        return F.struct(F.when(cut, s["depth"]).otherwise(depth).alias("depth"), F.when(cut, "").otherwise(F.concat(s["now"], ch)).alias("now"), F.when(cut, F.concat(s["done"], F.array(F.trim(s["now"])))).otherwise(s["done"]).alias("done"))

    end = lambda s: F.when(s["now"] != "", F.concat(s["done"], F.array(F.trim(s["now"])))).otherwise(s["done"])
    return F.aggregate(F.filter(F.split(_text(sponsors), ""), lambda x: x != ""), empty, step, end)


def sponsor_line(name: Column, role: Column, details: Column) -> Column:
    r, d = _text(role), _text(details)
    return F.concat(name, F.when(r != "", F.concat(F.lit(" - "), r)).otherwise(""), F.when(d != "", F.concat(F.lit(" ("), d, F.lit(")"))).otherwise(""))


def sponsor_parts(line: Column) -> Column:
    """(name, role, details) of `name - role (details)`."""
    has = line.contains(" - ")
    rest = F.when(has, F.trim(F.substring(line, F.instr(line, " - ") + 3, F.length(line)))).otherwise("")
    both = rest.contains("(") & rest.contains(")")
    role = F.when(both, F.trim(F.substring_index(rest, "(", 1))).otherwise(rest)
    inner = F.when(both, F.trim(F.substring_index(F.substring(rest, F.instr(rest, "(") + 1, F.length(rest)), ")", 1))).otherwise("")
    return F.struct(F.trim(F.when(has, F.substring_index(line, " - ", 1)).otherwise(line)).alias("name"), role.alias("role"), inner.alias("details"))


def office_is_role(offices: Column, role: Column) -> Column:
    """Whether the roster's office may stand as the role: none is given, and it is a title rather than a career history."""
    history = F.lit(False)
    for word in CAREER:
        history = history | F.lower(offices).contains(word)
    known = F.coalesce(F.nullif(offices, F.lit("N/A")), F.lit("")) != ""
    return known & (_text(role) == "") & (offices.contains("MMIP Coordinator") | ~history)


def strip_title(name: Column) -> Column:
    """A name without a leading title and a trailing party tag; in the tags' first letter, | counts beside D and R."""
    titles = r"(?i)^(?:Rep\.?\s|Representative\s|Sen\.?\s|Senator\s|Gov\.?\s|Governor\s|Secretary\s|Attorney General\s)"
    out = F.regexp_replace(_text(name), titles + r"|\s*\[[D|R].*?\]|\s*\([D|R].*?\).*$", "")
    return F.replace(F.trim(out), F.lit("–"), F.lit("-"))


def roster_key(name: Column) -> Column:
    """The name without titles, brackets and what follows a hyphen, in lower case without spaces."""
    bare = F.trim(F.regexp_replace(strip_title(name), r"\(.*?\)", ""))
    return F.regexp_replace(F.lower(F.trim(F.substring_index(bare, "-", 1))), r"\s+", "")


def without_middle_initial(name: Column) -> Column:
    """`A B. C` as `A C`: the second of three or more words is left out if it is one letter."""
    words = F.split(F.trim(name), r"\s+")
    middle = (F.size(words) >= 3) & F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")).rlike(r"^[A-Za-z]\.?$")
    return F.when(middle, F.concat_ws(" ", F.try_element_at(words, F.lit(1)), F.array_join(F.slice(words, 3, 1000), " "))).otherwise(name)


def without_plain_brackets(text: Column) -> Column:
    """Text without round brackets, unless they hold a party letter with or without a state."""
    return F.regexp_replace(text, r"\s*\((?![DRI](?:-[A-Z]{2})?\))[^)]*\)", "")
