"""What to request, from where, and when: read-through caches, answers' kinds, robots rules, polite schedules."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from urllib.parse import unquote
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.urls import host, path, query_string

# What an answer says when the monthly allowance is used up.
QUOTA = r"(?i)overlimit|query limit|monthly limit|quota"


def answer_kind(http_status: Column, status: Column, alert: Column) -> Column:
    """ok, overlimit, api_error, retry, http_error or empty."""
    said = F.upper(F.coalesce(status, F.lit("")))
    return F.when(http_status == 429, "retry").when(http_status != 200, "http_error").when(said == "OK", "ok").when(F.coalesce(alert, F.lit("")).rlike(QUOTA), "overlimit").when(said == "ERROR", "api_error").when(said == "", "empty").otherwise("ok")


def read_through(requests: DataFrame, valid: DataFrame, remote: DataFrame, budget: int | None = None, order: str = "ord") -> DataFrame:
    """requests (ord, op, param_key) with payload and `via`: memory for a key asked before in the run, cache, network within the budget, or none.

    `valid` holds the cache's valid entries, `remote` what the network would answer. Only a key's first request can go to
    the network; beyond the budget, it is refused, and so are its repeats.
    """
    keys = ["op", "param_key"]
    first = requests.groupBy(*keys).agg(F.min(order).alias("_first"))
    known = first.join(valid.select(*keys, F.col("payload").alias("_cached")), keys, "left").join(remote.select(*keys, F.col("payload").alias("_remote")), keys, "left")
    if budget is not None:
        asked = known.where(F.col("_cached").isNull()).orderBy("_first").limit(budget).select(*keys, F.lit(True).alias("_paid"))
        known = known.join(asked, keys, "left").withColumn("_remote", F.when(F.col("_paid"), F.col("_remote")))
    j = requests.join(known, keys)
    payload = F.coalesce("_cached", "_remote")
    via = F.when(payload.isNull(), "none").when(F.col(order) > F.col("_first"), "memory").when(F.col("_cached").isNotNull(), "cache").otherwise("network")
    return j.select(*requests.columns, payload.alias("payload"), via.alias("via"))


def _rules(batches: Iterator[pa.RecordBatch], agent: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, body in zip(batch.column("host").to_pylist(), batch.column("body").to_pylist()):
            robots = RobotFileParser()
            robots.parse((body or "").splitlines())
            groups = [*robots.entries, *([robots.default_entry] if robots.default_entry else [])]
            entry = next((g for g in groups if g.applies_to(agent)), None)
            rows += [(name, ord, unquote(x.path), x.allowance) for ord, x in enumerate(entry.rulelines if entry else [])]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_())
        yield pa.record_batch([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [()] * 4, kinds)], ["host", "ord", "prefix", "allow"])


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """The rules (host, ord, prefix, allow) that robots files (host, body) have for an agent: those of the first group that names it, else of the group for all. A null body, one that could not be read, has none."""
    return files.select("host", "body").mapInArrow(partial(_rules, agent=agent), "host string, ord int, prefix string, allow boolean")


def robots_allow(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with `allowed`: the first rule in the file's order that is a prefix of the path and its query decides. Without such a rule, or without readable rules of the host, a URL is unrestricted.

    rules: (host, ord, prefix, allow). A path is cut to each length that a rule of its host has, so rules meet it by equal
    keys. Percent-encoding is compared as it stands.
    """
    asked = F.when(query_string(F.col(url)) != "", F.concat(F.lit("?"), query_string(F.col(url)))).otherwise("")
    whole = F.concat(F.coalesce(F.nullif(path(F.col(url)), F.lit("")), F.lit("/")), asked)
    u = urls.withColumn("_host", host(F.col(url))).withColumn("_path", whole)
    r = rules.select(F.col("host").alias("_h"), "ord", "prefix", "allow", F.length("prefix").alias("_n"))
    each = u.select("_host", "_path").distinct().join(r.select("_h", "_n").distinct(), (F.col("_host") == F.col("_h")) & (F.length("_path") >= F.col("_n"))).select("_host", "_path", F.expr("substring(_path, 1, _n)").alias("_prefix"))
    fit = each.join(r, (F.col("_host") == F.col("_h")) & (F.col("_prefix") == F.col("prefix")))
    said = fit.groupBy(F.col("_host").alias("_of"), F.col("_path").alias("_at")).agg(F.min_by("allow", "ord").alias("_said"))
    return u.join(said, (F.col("_host") == F.col("_of")) & (F.col("_path") == F.col("_at")), "left").withColumn("allowed", F.coalesce("_said", F.lit(True))).drop("_host", "_path", "_of", "_at", "_said")


def schedule(urls: DataFrame, order: str, delay: float = 2.0, url: str = "url") -> DataFrame:
    """urls with `start`: seconds after which each may be fetched, so that a host's requests keep their distance. Hosts run side by side; a host's own requests are a sequence by nature."""
    return urls.withColumn("start", (F.row_number().over(Window.partitionBy(host(F.col(url))).orderBy(order)) - 1) * F.lit(delay))
