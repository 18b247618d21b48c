"""What is known, seen or repeated: anti-joins, first and last rows, keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.bills import bill_key_norm, bill_url_part, identity_key
from tessella.functions.urls import normalize_url

from .work import written

STATUSES = ("discovered", "rejected", "analyzed", "pending", "approved", "error")


def first_rows(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; Spark keeps one row a key and task before it shuffles."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def known_urls(tables: list[DataFrame], url_fields: list[str]) -> DataFrame:
    """The normal forms of all URLs that the tables hold in any of the fields: (norm)."""
    out = None
    for t in tables:
        fields = [c for c in url_fields if c in t.columns]
        one = t.select(F.explode(F.array(*(normalize_url(F.col(c)) for c in fields))).alias("norm")).where("norm <> ''")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def known_bills(tables: list[DataFrame], state: str, number: str) -> DataFrame:
    out = None
    for t in tables:
        one = t.select(identity_key(F.col(state), F.col(number)).alias("bill")).where("bill IS NOT NULL")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def not_known(candidates: DataFrame, urls: DataFrame, bills: DataFrame, url: str = "url", state: str = "state", number: str = "bill_number") -> DataFrame:
    """Candidates that neither their URL nor their (state, number) shows as known: two equi anti-joins instead of one with OR."""
    keyed = candidates.withColumn("_norm", normalize_url(F.col(url))).withColumn("_bill", identity_key(F.col(state), F.col(number)))
    left = keyed.join(urls, F.col("_norm") == urls["norm"], "left_anti").join(bills, F.col("_bill") == bills["bill"], "left_anti")
    return left.drop("_norm", "_bill")


def first_of_both(rows: DataFrame, order: str, *keys: Column) -> DataFrame:
    """`suppressed` for each row, as a pass in order would say that registers the keys of the rows it lets in and holds up those with a registered key.

    A null key meets nothing; `order` has no equal values. Each round lets in the rows that are the first undecided ones of
    all their keys, and holds up those that share a key with one let in; so the first undecided row is always decided,
    and rows that share no keys are decided side by side. Rounds grow with the longest chain of rows that decide each other.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    left = written(rows.select(F.col(order).alias("_at"), *(k.alias(n) for k, n in zip(keys, names))), "undecided")
    found = None
    while left.limit(1).count():
        marked = left
        for n in names:
            least = left.where(F.col(n).isNotNull()).groupBy(F.col(n).alias("_key")).agg(F.min("_at").alias("_least"))
            marked = marked.join(least, F.col(n) == F.col("_key"), "left").withColumn(f"{n}_first", F.coalesce(F.col("_least") == F.col("_at"), F.lit(True))).drop("_key", "_least")
        let_in = F.lit(True)
        for n in names:
            let_in = let_in & F.col(f"{n}_first")
        marked = written(marked.select("_at", *names, let_in.alias("_in")), "marked")
        held = marked.where("NOT _in")
        touched = F.lit(False)
        for n in names:
            key = marked.where("_in").select(F.col(n).alias("_key")).where("_key IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
            held = held.join(key, F.col(n) == F.col("_key"), "left").withColumn(f"{n}_hit", F.coalesce("_hit", F.lit(False))).drop("_key", "_hit")
            touched = touched | F.col(f"{n}_hit")
        held = written(held.select("_at", *names, touched.alias("_out")), "held")
        decided = marked.where("_in").select("_at", F.lit(False).alias("suppressed")).union(held.where("_out").select("_at", F.lit(True).alias("suppressed")))
        found = decided if found is None else found.union(decided)
        left = held.where("NOT _out").select("_at", *names)
    if found is None:
        return rows.withColumn("suppressed", F.lit(False))
    return rows.join(found, F.col(order) == F.col("_at")).drop("_at")


def within_run(candidates: DataFrame, order: str, url: str = "url", state: str = "state", number: str = "bill_number") -> DataFrame:
    """`suppressed` for each candidate: whether its URL or its bill stands in an earlier row that is not suppressed itself."""
    return first_of_both(candidates, order, F.nullif(normalize_url(F.col(url)), F.lit("")), identity_key(F.col(state), F.col(number)))


def process_reason(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """(…, process, reason): new, already_*, change_hash_updated, content_hash_updated or already_seen. A row that was discovered or failed is opened again only by a changed hash."""
    s = seen.select(F.col("url").alias("_url"), F.col("status").alias("_status"), F.col("change_hash").alias("_change"), F.col("content_hash").alias("_content"))
    j = batch.join(s, F.lower(F.trim(batch["url"])) == s["_url"], "left")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    changed = filled("change_hash") & filled("_change") & (F.col("change_hash") != F.col("_change"))
    rewritten = filled("content_hash") & filled("_content") & (F.col("content_hash") != F.col("_content"))
    reason = F.when(F.col("_url").isNull(), "new").when(F.col("_status").isin("rejected", "approved", "pending", "analyzed"), F.concat(F.lit("already_"), F.col("_status"))).when(changed, "change_hash_updated").when(rewritten, "content_hash_updated").otherwise("already_seen")
    return j.withColumn("reason", reason).withColumn("process", F.col("reason").isin("new", "change_hash_updated", "content_hash_updated")).drop("_url", "_status", "_change", "_content")


def upsert_seen(seen: DataFrame, batch: DataFrame, now: Column, order: str = "ord") -> DataFrame:
    """The state after a batch: (url, source, status, change_hash, content_hash, session_id, verdict, confidence, first_seen, last_seen).

    Rows of a URL apply in order, so the last one's source, hashes and status stand; a blank session and a null verdict or
    confidence leave what was there before; first_seen of a known URL stays.
    """
    b = batch.withColumn("_key", F.lower(F.trim("url")))
    last = lambda c: F.max_by(c, order)
    kept = lambda c: F.max_by(F.col(c), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order)))
    new = b.groupBy("_key").agg(*(last(c).alias(f"n_{c}") for c in ("source", "status", "change_hash", "content_hash")), *(kept(c).alias(f"n_{c}") for c in ("session_id", "verdict", "confidence")))
    j = seen.join(new, seen["url"] == new["_key"], "full_outer")
    there = F.col("_key").isNotNull()
    replaced = [F.when(there, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("source", "status", "change_hash", "content_hash")]
    held = [F.coalesce(F.col(f"n_{c}"), F.col(c)).alias(c) for c in ("session_id", "verdict", "confidence")]
    return j.select(F.coalesce("_key", "url").alias("url"), *replaced, *held, F.coalesce("first_seen", now).alias("first_seen"), F.when(there, now).otherwise(F.col("last_seen")).alias("last_seen"))


def update_metadata(seen: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Ids and hash of the state replaced where the change has a value; the workflow's status stays."""
    c = changes.select(F.lower(F.trim("url")).alias("_key"), *(F.nullif(F.col(x), F.lit("")).alias(f"_{x}") for x in ("external_id", "session_id", "change_hash")))
    j = seen.join(c, seen["url"] == c["_key"], "left")
    for x in ("external_id", "session_id", "change_hash"):
        j = j.withColumn(x, F.coalesce(F.col(f"_{x}"), F.col(x)))
    return j.withColumn("last_seen", F.when(F.col("_key").isNotNull(), now).otherwise(F.col("last_seen"))).drop("_key", "_external_id", "_session_id", "_change_hash")


def latest_documents(store: DataFrame, puts: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """A document store (key, text, fetched_at, bill_id, doc_id) after puts: the latest text of each key, the last ids that are not null; without deleted keys."""
    every = store.unionByName(puts)
    out = every.groupBy("key").agg(F.max_by("text", "fetched_at").alias("text"), F.max("fetched_at").alias("fetched_at"), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("fetched_at"))).alias(c) for c in ("bill_id", "doc_id")))
    return out.join(deleted, "key", "left_anti") if deleted is not None else out


def cached(cache: DataFrame, now: Column, ttl: dict[str, int]) -> DataFrame:
    """The entries of (op, param_key, payload, fetched_at) that are still valid: the latest of each key, of an op with a lifetime, no older than it."""
    seconds = F.element_at(F.create_map(*(F.lit(x) for kv in ttl.items() for x in kv)), F.col("op"))
    last = cache.where(F.col("op").isin(*ttl)).groupBy("op", "param_key").agg(F.max_by("payload", "fetched_at").alias("payload"), F.max("fetched_at").alias("fetched_at"))
    return last.where(F.unix_seconds(now) - F.unix_seconds(F.col("fetched_at")) <= seconds)


def resolve_bill(records: DataFrame, seen: DataFrame, master: DataFrame, hits: DataFrame) -> DataFrame:
    """records with bill_id and `via`: by the seen URL, by a seen (state, number), by the master list of the URL's state, number and year, by search hits — the first that has one."""
    s = seen.where(F.coalesce(F.col("external_id"), F.lit("")) != "")
    by_url = s.select(F.col("url").alias("_u"), F.col("external_id").alias("_b1"))
    state, number = bill_url_part(F.col("url"), "state"), bill_key_norm(bill_url_part(F.col("url"), "number"))
    by_bill = first_rows(s.select(state.alias("_s"), number.alias("_n"), "external_id", "url").where("_s IS NOT NULL"), ["_s", "_n"], F.col("url")).select("_s", "_n", F.col("external_id").alias("_b2"))
    r = records.withColumn("_st", F.upper(F.trim("state"))).withColumn("_no", bill_key_norm(F.col("bill_number")))
    r = r.withColumn("_us", bill_url_part(F.col("url"), "state")).withColumn("_un", bill_key_norm(bill_url_part(F.col("url"), "number"))).withColumn("_uy", bill_url_part(F.col("url"), "year"))
    r = r.join(by_url, F.lower(F.trim("url")) == F.col("_u"), "left").join(by_bill, (F.col("_st") == F.col("_s")) & (F.col("_no") == F.col("_n")), "left")
    m = master.select(F.col("state").alias("_ms"), bill_key_norm(F.col("number")).alias("_mn"), F.col("year_start").alias("_y0"), F.col("year_end").alias("_y1"), F.col("bill_id").cast("string").alias("_b3"), F.col("ord").alias("_mo"))
    years = m.withColumn("_year", F.explode(F.sequence("_y0", "_y1")))  # a session has few years, so the range join is an equi join
    years = first_rows(years, ["_ms", "_mn", "_year"], F.col("_mo")).select("_ms", "_mn", "_year", "_b3")
    r = r.join(years, (F.col("_us") == F.col("_ms")) & (F.col("_un") == F.col("_mn")) & (F.col("_uy") == F.col("_year")), "left")
    h = first_rows(hits.select(F.col("state").alias("_hs"), bill_key_norm(F.col("number")).alias("_hn"), F.col("bill_id").cast("string").alias("_b4"), "ord"), ["_hs", "_hn"], F.col("ord")).drop("ord")
    r = r.join(h, (F.col("_st") == F.col("_hs")) & (F.col("_no") == F.col("_hn")), "left")
    via = F.when(F.col("_b1").isNotNull(), "seen_url").when(F.col("_b2").isNotNull(), "seen_bill").when(F.col("_b3").isNotNull(), "master_list").when(F.col("_b4").isNotNull(), "search")
    return r.select(*records.columns, F.coalesce("_b1", "_b2", "_b3", "_b4").alias("bill_id"), via.alias("via"))
