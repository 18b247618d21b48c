"""Fuzzy matching of quotes and names: vectorised Python where no built-in expression has the semantics."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least similarity of a window that may stand for a quote.
LEAST_RATIO = 0.72
# Characters that mean the same in a match, and characters without width.
SAME, WITH, NO_WIDTH = "‘’“”–— ", "''\"\"-- ", "​﻿"
_TABLE = str.maketrans(dict(zip(SAME, WITH)) | dict.fromkeys(NO_WIDTH, ""))
_BROKEN = re.compile(r"-\s*\n\s*")


def plain(text: str | None) -> str:
    """NFKC, plain quotes and dashes, words joined across line-end hyphens, single spaces, lower case."""
    return " ".join(_BROKEN.sub("", unicodedata.normalize("NFKC", text or "").translate(_TABLE)).split()).lower()


def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def normalized(text: Column) -> Column:
    """plain() as a column: Python only for NFKC, and only for texts with a character beyond ASCII."""
    odd = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    whole = F.translate(F.coalesce(F.pandas_udf(_nfkc, "string")(odd), text, F.lit("")), SAME + NO_WIDTH, WITH)
    space = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    joined = F.regexp_replace(whole, "-" + space[:-1] + r"*\n" + space[:-1] + "*", "")
    return F.lower(F.regexp_replace(F.regexp_replace(joined, space, " "), "^ | $", ""))


def _windows(words: list[re.Match], size: int):
    return (words[k : k + size] for k in range(len(words) - size + 1))


def _common(wanted: str, forms: list[str], sizes: range) -> Iterator[tuple[int, float]]:
    """(size, bound) of the first `size` forms: the ratio that their longest common subsequence with `wanted` would have.

    A bit for each character of `wanted`; those of the subsequence are cleared, character by character of the forms.
    """
    masks: dict[str, int] = {}
    for i, c in enumerate(wanted):
        masks[c] = masks.get(c, 0) | 1 << i
    full = open_bits = (1 << len(wanted)) - 1
    long = 0
    for size, form in enumerate(forms, 1):
        for c in (" " + form if long and form else form):
            hit = open_bits & masks.get(c, 0)
            open_bits = ((open_bits + hit) | (open_bits - hit)) & full
        long += len(form) + (1 if long and form else 0)
        if size in sizes:
            yield size, 2 * (len(wanted) - open_bits.bit_count()) / (len(wanted) + long)


def _holding(wanted: str, n: int, text: str, words: list[re.Match], forms: list[str]) -> Iterator[list[re.Match]]:
    """Runs of n to n + 5 words of a text in which `wanted` occurs in normal form, one for each occurrence."""
    starts, parts, at = [], [], 0
    for k, form in enumerate(forms):
        broken = k + 1 < len(words) and form.endswith("-") and "\n" in text[words[k].end() : words[k + 1].start()]
        part = form[:-1] if broken else form + " " if form else ""
        starts.append(at)
        parts.append(part)
        at += len(part)
    whole, k = "".join(parts), -1
    while (k := whole.find(wanted, k + 1)) >= 0:
        first, last = bisect_right(starts, k) - 1, bisect_right(starts, k + len(wanted) - 1) - 1
        last = max(last, first + n - 1)
        if last - first < n + 5 and last < len(words):
            yield words[first : last + 1]


def best_span(quote: str | None, source: str | None, least: float = LEAST_RATIO) -> str | None:
    """The stretch of the source that the quote stands for, as it is written there, or null.

    If the quote occurs in normal form, the shortest run of up to five words more than the quote that holds it; else the
    first run of nearly as many words with the largest similarity, if that is at least `least`. Runs whose words can't
    reach the best similarity so far are not compared.
    """
    wanted, text = plain(quote), source or ""
    words = list(re.finditer(r"\S+", text))
    if not wanted or not words:
        return None
    n, forms = len(wanted.split()), [plain(w.group()) for w in words]
    cut = lambda run: text[run[0].start() : run[-1].end()].strip()
    if wanted in plain(text):
        found = _holding(wanted, n, text, words, forms)
        return min((cut(run) for run in found), key=len, default=None)
    match, best, span = SequenceMatcher(None, "", wanted, autojunk=True), least, None
    match.set_seq1(wanted)
    letters = sorted(set(wanted) - {" "})
    want, gaps = np.array([wanted.count(c) for c in letters]), wanted.count(" ")
    # Sums up to each word: of the letters, of characters, of spaces inside words, and of words that are not empty.
    held, long, inner, full = (np.concatenate((np.zeros((1, x.shape[1]), np.int64), x.cumsum(0))) for x in (
        np.array([[f.count(c) for c in letters] for f in forms]), *(np.array([[g(f)] for f in forms]) for g in (len, lambda f: f.count(" "), bool))))
    sizes = range(max(3, n - 3), min(n + 3, len(words)) + 1)
    bounds = {}
    for size in sizes:
        common, chars, spaces, joints = (x[size:] - x[:-size] for x in (held, long, inner, full))
        joints = np.maximum(joints - 1, 0)
        alike = np.minimum(common, want).sum(1) + np.minimum(spaces + joints, gaps)[:, 0]
        bounds[size] = 2 * alike / (len(wanted) + (chars + joints)[:, 0])
    # Where the letters would do, the longest common subsequence, which no matching exceeds, bounds all sizes from one start.
    for k in sorted({k for x in bounds.values() for k in np.flatnonzero(x > least - 1e-12).tolist()}):
        for size, common in _common(wanted, forms[k : k + sizes[-1]], sizes):
            bounds[size][k] = min(bounds[size][k], common)
    for size, most in bounds.items():
        for k in np.flatnonzero(most > least - 1e-12).tolist():
            if most[k] <= best - 1e-12:
                continue
            match.set_seq2(" ".join(f for f in forms[k : k + size] if f))
            ratio = match.ratio()
            if ratio > best or (span is None and ratio >= best):
                best, span = ratio, cut(words[k : k + size])
    return span


def _span_series(quote: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([best_span(q, s) for q, s in zip(quote, source)], dtype=object)


def source_span(quote: Column, source: Column) -> Column:
    return F.pandas_udf(_span_series, "string")(quote, source)


def quote_found(quote: Column, source: Column, words: int = 12, chars: int = 120, short: int = 20) -> Column:
    """Whether a quote stands in the source in normal form: all of it, or, unless it is `short`, its first words or characters. Null where only a similar stretch could show it."""
    q, s = normalized(quote), normalized(source)
    beginnings = (F.array_join(F.slice(F.split(q, " "), 1, words), " "), F.substring(q, 1, chars))
    there = F.contains(s, q)
    for x in beginnings:
        there = there | ((F.length(q) >= short) & F.contains(s, x))
    return F.when(there, True).when(F.length(q) < short, False)


def quotes_in_source(rows: DataFrame, quote: str, source: str) -> DataFrame:
    """rows with `in_source`: cheap tests first; only rows that they leave open are compared stretch by stretch."""
    held = rows.withColumn("in_source", quote_found(F.col(quote), F.col(source)))
    return held.withColumn("in_source", F.coalesce("in_source", F.when(F.col("in_source").isNull(), source_span(F.when(F.col("in_source").isNull(), F.col(quote)), F.col(source)).isNotNull())))


# -- names -----------------------------------------------------------------------------------------------


def ratio(a: str, b: str) -> int:
    return round(100 * SequenceMatcher(None, a, b, autojunk=False).ratio())


def partial_ratio(a: str, b: str) -> int:
    """The best similarity of the shorter text with a stretch of its length in the longer one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100 if not long else 0
    blocks = SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks()
    return max(ratio(short, long[max(0, j - i) : max(0, j - i) + len(short)]) for i, j, _ in blocks)


def name_score(a: str, b: str) -> int:
    """partial_ratio of two names with or without their spaces, whichever is larger."""
    return max(partial_ratio(a, b), partial_ratio(a.replace(" ", ""), b.replace(" ", "")))


def _alike(a: str, b: str, least: float) -> bool:
    """ratio(a, b) >= least, after bounds by length and by letters."""
    m = SequenceMatcher(None, a, b, autojunk=False)
    return all(round(100 * x()) >= least for x in (m.real_quick_ratio, m.quick_ratio, m.ratio))


def confident(a: str, b: str, a_key: str, b_key: str) -> bool:
    """Whether a score above 90 may be believed: equal keys; or all words alike and the first ones too; or the last and the first words alike."""
    x, y = a.split(), b.split()
    if a_key != b_key:
        if not x or not y or not _alike(x[0], y[0], 80):
            return False
        if not _alike(" ".join(sorted(x)), " ".join(sorted(y)), 88) and not (len(x) > 1 and len(y) > 1 and _alike(x[-1], y[-1], 92) and _alike(x[0], y[0], 85)):
            return False
    return name_score(a, b) > 90


def _score_series(a: pd.Series, b: pd.Series, a_key: pd.Series, b_key: pd.Series) -> pd.Series:
    return pd.Series([name_score(p, q) if confident(p, q, u, v) else None for p, q, u, v in zip(a, b, a_key, b_key)], dtype="Int32")


def believed_score(a: Column, b: Column, a_key: Column, b_key: Column) -> Column:
    """The score of two names if it may be believed, else null."""
    return F.pandas_udf(_score_series, "int")(a, b, a_key, b_key)


def _bigrams(word: Column) -> Column:
    """The word's pairs of neighbouring characters, its ends marked, each with the number of the same pairs before it."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    return F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda x: x == p)).cast("string")))


def match_names(names: DataFrame, roster: DataFrame) -> DataFrame:
    """(id, roster_id, score): the best believed roster entry of each name, ties to the smaller roster id.

    names (id, name, key) and roster (roster_id, roster_name, roster_key, in lower case without titles). A believed pair
    has equal keys, or first words with a similarity of 0.795 at least. Of words of n and m letters, that leaves
    0.205 (n + m) letters unmatched; each takes two of its own word's bigrams and one of the other's, so that the longer
    word keeps 0.19 (n + m) + 1 of the n + 1 or m + 1. So pairs meet in common bigrams of their first words, are counted,
    and those with fewer are dropped before any is scored: no believed pair is lost.
    """

    def words(df: DataFrame, ident: str, name: str) -> DataFrame:
        first = F.element_at(F.split(F.trim(F.col(name)), r"\s+"), 1)
        return df.select(ident, F.length(first).alias(f"_{ident}"), F.explode(_bigrams(first)).alias("_gram")).where(F.col(f"_{ident}") > 0)

    common = words(names, "id", "name").join(words(roster, "roster_id", "roster_name"), "_gram").groupBy("id", "roster_id", "_id", "_roster_id").agg(F.count("*").alias("n"))
    near = common.where(F.col("n") >= F.floor(0.1925 * (F.col("_id") + F.col("_roster_id")) + 1 - 1e-9)).select("id", "roster_id")
    same = names.join(roster, F.col("key") == F.col("roster_key")).select("id", "roster_id")
    pairs = near.union(same).distinct().join(names.select("id", "name", "key"), "id").join(roster.select("roster_id", "roster_name", "roster_key"), "roster_id")
    scored = pairs.withColumn("score", believed_score("name", "roster_name", "key", "roster_key")).where("score IS NOT NULL")
    best = scored.groupBy("id").agg(F.max_by(F.struct("roster_id", "score"), F.struct("score", (-F.col("roster_id")).alias("r"))).alias("b"))
    return best.select("id", "b.roster_id", "b.score")
