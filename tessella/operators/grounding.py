"""Is each derived field of a record supported by the text it came from?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import bills, text

# Labels too wide to name a nation.
GENERIC = ("native american", "indigenous", "alaska native", "first nations", "american indian", "indigenous american", "native")
GENERIC_ALONE = (*GENERIC, "tribe", "nation", "people", "band")
#: Words of an office or party, and words that make a sentence, which a name does not hold; callers may give their own.
OFFICES = ("democratic", "republican", "independent", "representative", "senator", "governor", "politician")
VERBS = ("is", "was", "were", "are", "who", "served", "member", "employee", "attorney", "chief", "president", "representative", "delegate")


def _holds(c: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words stands in a text, by whole words."""
    return F.arrays_overlap(F.regexp_extract_all(F.lower(c), F.lit(r"(\w+)"), 1), F.array(*(F.lit(w) for w in words)))


def consistency(records: DataFrame, block: Column, least_overlap: float = 0.34) -> DataFrame:
    """records (name, bill_number, last_update, sponsors, chamber_details, session, record_source, text) checked against text.

    Adds blocking_code (`block`, else title_not_in_document) and warnings, and empties ungrounded fields of rows that are
    not blocked. Sponsors and chamber of tracked bills, and the session of these and of federal rows, are not checked.
    """
    t = F.col("text")
    code = F.when(block != "", block).when(text.title_overlap(F.col("name"), t) < least_overlap, "title_not_in_document").otherwise("")
    free = code == ""
    own, federal = F.col("record_source") == "LegiScan", F.col("record_source") == "Federal Site"
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    people = F.filter(F.transform(F.split(F.coalesce("sponsors", F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    bad = {
        "bill_number": free & filled(F.col("bill_number")) & ~bills.number_in_text(F.col("bill_number"), t),
        "last_update": free & filled(F.col("last_update")) & ~text.date_grounded(F.col("last_update"), t),
        "chamber_details": free & ~own & filled(F.col("chamber_details")) & ~text.chamber_grounded(F.col("chamber_details"), t),
        "session": free & ~own & ~federal & filled(F.col("session")) & ~text.all_in(text.proper_names(F.col("session")), t),
    }
    known = F.filter(people, lambda p: text.name_grounded(p, t))
    lost = F.when(free & ~own, F.filter(people, lambda p: ~text.name_grounded(p, t))).otherwise(F.array().cast("array<string>"))
    said = F.concat(F.array_compact(F.array(*(F.when(x, F.lit(f"{c} is not in the text; cleared")) for c, x in bad.items()))), F.transform(lost, lambda p: F.concat(F.lit("sponsor "), p, F.lit(" is not in the text; cleared"))))
    out = records.select("*", code.alias("blocking_code"), said.alias("warnings"), *(x.alias(f"_{c}") for c, x in bad.items()), F.when(free & ~own & (F.size(lost) > 0), F.array_join(known, ", ")).otherwise(F.col("sponsors")).alias("_kept"))
    return out.withColumns({c: F.when(F.col(f"_{c}"), "").otherwise(F.col(c)) for c in bad} | {"sponsors": F.col("_kept")}).drop("_kept", *(f"_{c}" for c in bad))


def false_positive(flags: dict[str, tuple[Column, int]]) -> tuple[Column, Column, Column]:
    """(score, reasons, recommendation) of weighted flags: reject from 5, review from 3, else keep."""
    score = sum((F.when(c, w).otherwise(0) for c, w in flags.values()), F.lit(0))
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, (c, _) in flags.items())))
    return score, reasons, F.when(score >= 5, "reject").when(score >= 3, "review").otherwise("keep")


def critic(verdict: Column, severity: Column, action: Column) -> tuple[Column, Column, Column]:
    """A critic's words in their domains: unknown verdicts are ok, severities ungrounded, actions flag."""
    low = lambda c, d: F.lower(F.trim(F.coalesce(c, F.lit(d))))
    within = lambda c, d, *domain: F.when(low(c, d).isin(d, *domain), low(c, d)).otherwise(d)
    return within(verdict, "ok", "suspect", "bad"), within(severity, "ungrounded", "contradicted", "exaggerated"), within(action, "flag", "clear_field", "downgrade_eval", "reanalyze")


# -- enrichment ------------------------------------------------------------------------------------------


def segments(names: Column, verbs: tuple[str, ...] = VERBS) -> Column:
    """Up to three names of a ` / ` list: 3 to 45 characters from a capital, digit or quote on, and no generic label, sentence or number."""
    parts = F.transform(F.split(text.text_or_empty(names), " / "), lambda s: F.trim(s))
    named = lambda s: s.rlike("^[A-Z0-9\"']") & ~s.rlike(r"\d") & ~F.lower(s).isin(*GENERIC_ALONE) & ~F.contains(F.lower(s), F.lit("native american"))
    fine = F.filter(parts, lambda s: F.length(s).between(3, 45) & named(s) & ~_holds(s, verbs))
    return F.slice(F.array_distinct(fine), 1, 3)


def extracted(intro: Column, dictionary: list[str], endings: tuple[str, ...] = ("tribe", "nation", "band", "people"), offices: tuple[str, ...] = OFFICES) -> Column:
    """Up to three names in the first 500 characters.

    Dictionary entries, longest first; what stands between `member of` or `citizen of` and an ending, both names where two
    are joined by `and`; up to three capitalised words before a capitalised ending; the word before descent, heritage or
    ancestry. Generic labels, and names that hold a word of an office, are none.
    """
    head = F.substring(text.text_or_empty(intro), 1, 500)
    known = [F.when(F.lower(head).rlike(rf"\b{w.lower()}\b"), F.lit(w)) for w in sorted(dictionary, key=lambda w: (-len(w), w)) if w.lower() not in GENERIC_ALONE]
    lower, upper = "|".join(f"{e}s?" for e in endings), "|".join(e.capitalize() for e in endings)
    belongs = F.regexp_extract_all(head, F.lit(rf"(?i)\b(?:member|citizen) of (?:the )?([^,.;]+?) (?:{lower})\b"), 1)
    joined = F.flatten(F.transform(belongs, lambda s: F.split(s, r"(?i) and (?:the )?")))
    capital = F.regexp_extract_all(head, F.lit(rf"\b((?:[A-Z][\w'-]* ){{1,3}})(?:{upper})\b"), 1)
    descent = F.regexp_extract_all(head, F.lit(r"(?i)([\w'.-]{3,40}) (?:descent|heritage|ancestry)\b"), 1)
    every = F.transform(F.concat(F.array_compact(F.array(*known)) if known else F.array().cast("array<string>"), joined, capital, descent), lambda s: F.trim(s))
    found = F.filter(every, lambda s: (F.length(s) >= 3) & ~F.lower(s).isin(*GENERIC_ALONE) & ~_holds(s, offices))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, 3)


def proposal(names: Column, intro: Column, offices: tuple[str, ...] = OFFICES) -> Column:
    """Why a proposed list is refused: generic_only, office_or_party, intro_too_short; '' if it is accepted."""
    kept = F.array_join(segments(names), " / ")
    return F.when(kept == "", "generic_only").when(_holds(kept, offices), "office_or_party").when(F.length(text.text_or_empty(intro)) < 80, "intro_too_short").otherwise("")


def model_proposal(name: Column, confidence: Column, evidence: Column, source: Column, least: float = 0.85) -> Column:
    """Why a model's proposal is refused: empty, low_confidence, no_evidence, evidence_not_in_text, generic_only; '' if accepted."""
    quote = F.trim(text.text_or_empty(evidence))
    return F.when(F.trim(text.text_or_empty(name)) == "", "empty").when(F.coalesce(confidence, F.lit(0.0)) < least, "low_confidence").when(quote == "", "no_evidence").when(~F.contains(text.text_or_empty(source), quote), "evidence_not_in_text").when(F.size(segments(name)) == 0, "generic_only").otherwise("")


def write_policy(known: Column, override: Column, proposed: Column, refused: Column) -> Column:
    """skip_known, skip_override, needs_model or write."""
    blank = lambda c: F.coalesce(F.nullif(F.nullif(F.trim(c), F.lit("N/A")), F.lit("")), F.lit("")) == ""
    return F.when(~blank(override), "skip_override").when(~blank(known), "skip_known").when(blank(proposed) | (refused != ""), "needs_model").otherwise("write")
