"""Change capture between snapshots, workflow routing and its counters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.bills import bill_key_norm

TRACKED = ("status", "progression", "chamber", "chamber_details", "last_update")


def _s(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str], date_field: str | None = None, guards: tuple[str, ...] = ()) -> DataFrame:
    """(key, field, old, new) of each tracked field that differs in rows that both sides have.

    The date field may go back only if one of the guard fields changed as well.
    """
    o = old.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_o_{f}") for f in fields))
    j = new.select(key, *fields).join(o, F.col(key) == F.col("_k"))
    moved = F.lit(False)
    for g in guards:
        moved = moved | (_s(g) != _s(f"_o_{g}"))
    each = []
    for f in fields:
        differs = _s(f) != _s(f"_o_{f}")
        if f == date_field:
            differs = differs & (moved | (_s(f) == "") | (_s(f"_o_{f}") == "") | (_s(f) >= _s(f"_o_{f}")))
        each.append(F.when(differs, F.struct(F.lit(f).alias("field"), _s(f"_o_{f}").alias("old"), _s(f).alias("new"))))
    return j.select(key, F.explode(F.array_compact(F.array(*each))).alias("c")).select(key, "c.field", "c.old", "c.new")


def snapshot_sides(before: DataFrame, after: DataFrame, key: str, order: str) -> DataFrame:
    """(key, side): before, after or both; rows that repeat a key count once."""
    last = lambda df, name: df.groupBy(key).agg(F.max(order).alias(name))
    j = last(before, "_b").join(last(after, "_a"), key, "full_outer")
    return j.select(key, F.when(F.col("_a").isNull(), "before").when(F.col("_b").isNull(), "after").otherwise("both").alias("side"))


def refresh_outcome(records: DataFrame) -> DataFrame:
    """records (url, bill_id, session_id, stored_hash, master_hash, number, master_number, fetched, n_changes, table) with `outcome`.

    In order: not tracked, unresolved, unchanged hash (all of session, both hashes), identity mismatch (both numbers known and
    different in normal form; a live row goes back to review, a pending one is flagged), failed fetch, updated, unchanged.
    """
    a, b = bill_key_norm(F.col("number")), bill_key_norm(F.col("master_number"))
    same = (_s("session_id") != "") & (_s("master_hash") != "") & (_s("stored_hash") != "") & (F.col("master_hash") == F.col("stored_hash"))
    clash = (a != "") & (b != "") & (a != b)
    outcome = (
        F.when(~F.contains(_s("url"), F.lit("legiscan.com")), "skipped_untracked")
        .when(F.col("bill_id").isNull(), "resolve_failed")
        .when(same, "skipped_unchanged_hash")
        .when(clash, F.when(F.col("table") == "live", "mismatch_to_pending").otherwise("mismatch_flagged"))
        .when(~F.col("fetched"), "fetch_failed")
        .when(F.col("n_changes") > 0, "updated")
        .otherwise("unchanged")
    )
    return records.withColumn("outcome", outcome)


def approval_routes(pending: DataFrame, live: DataFrame, url: str = "url") -> DataFrame:
    """(id, url, action): to_live or already_live for approved rows, to_pending or already_pending for live ones sent back, rejected."""
    l_urls, p_urls = live.select(F.col(url).alias("_l")).distinct(), pending.select(F.col(url).alias("_p")).distinct()
    approved = pending.where("review_status = 'Approved'").join(l_urls, F.col(url) == F.col("_l"), "left").select("id", url, F.when(F.col("_l").isNull(), "to_live").otherwise("already_live").alias("action"))
    back = live.where("review_status = 'Send Back to Pending'").join(p_urls, F.col(url) == F.col("_p"), "left").select("id", url, F.when(F.col("_p").isNull(), "to_pending").otherwise("already_pending").alias("action"))
    rejected = pending.where("review_status = 'Rejected'").select("id", url, F.lit("rejected").alias("action"))
    return approved.unionByName(back).unionByName(rejected)


def sponsorship_class(old: Column, new: Column) -> Column:
    """unchanged, cleared, restored, improved, regression_noise or changed. Noise is a career history in the new value only."""
    noisy = lambda c: c.rlike(r"(?i)\bpresent\b|\b(?:19|20)\d\d\b|speaker of|state (?:representative|senator)")
    o, n = F.trim(F.coalesce(old, F.lit(""))), F.trim(F.coalesce(new, F.lit("")))
    return F.when(o == n, "unchanged").when(n == "", "cleared").when(o == "", "restored").when(noisy(o) & ~noisy(n), "improved").when(noisy(n) & ~noisy(o), "regression_noise").otherwise("changed")


def capped(df: DataFrame, accepted: Column, order: str, most: int, by: list[str] | None = None) -> DataFrame:
    """`over_cap`: whether so many accepted rows stand before an accepted row, in all or in its group.

    Without groups a running count needs a total order: ranges of the order are counted first and their sums go to each range, so no task holds all rows.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("over_cap", accepted & (F.sum(accepted.cast("long")).over(w) > most))
    return running_sum(df, accepted.cast("long"), order, "_n").withColumn("over_cap", accepted & (F.col("_n") > most)).drop("_n")


#: Rows of a range of running_sum.
RANGE_ROWS = 1_000_000


def running_sum(df: DataFrame, value: Column, order: str, name: str) -> DataFrame:
    """A running sum in the order of a numeric column with no equal values, over ranges of about RANGE_ROWS rows instead of one task.

    Ranges lie between quantiles, so that they hold as many rows wherever the values lie, and their number grows with the rows.
    """
    n = df.count()
    if not n:
        return df.withColumn(name, F.lit(0).cast("long"))
    parts = -(-n // RANGE_ROWS)
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    bounds = np.unique(np.array(cuts, float))

    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, x.to_numpy(), "left"))

    held = df.withColumn("_range", F.pandas_udf(place, "int")(F.col(order).cast("double"))).withColumn("_value", value)
    sums = held.groupBy("_range").agg(F.sum("_value").alias("_sum"))  # a row a range
    before = sums.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum("_value").over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("_own", own).join(F.broadcast(before), F.col("_range") == F.col("_r")).withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_value", "_own", "_r", "_before")


def breaker(df: DataFrame, order: str, ok: Column, failures: int = 2) -> DataFrame:
    """The rows up to the one at which `failures` failures have come and no success."""
    state = running_sum(running_sum(df, (~ok).cast("long"), order, "_bad"), ok.cast("long"), order, "_good")
    first = state.where((F.col("_bad") >= failures) & (F.col("_good") == 0)).agg(F.min(order).alias("_stop"))
    return state.crossJoin(F.broadcast(first)).where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_bad", "_good", "_stop")  # one row on the right
