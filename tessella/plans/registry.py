"""Named queries with SQL that must give the same rows.

An input is SQL that both engines run: {pages} stands for a table. A query is a function of Tables; its SQL may use
tables, inputs (as views of that name) and whatever DuckDB offers.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

INPUTS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """tables(name): a table of the directory, or an input computed from tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name not in INPUTS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = INPUTS[name]
        return self.spark.sql(text, **{x: self(x) for x in sorted(set(re.findall(r"{(\w+)}", text)))})


def _with(text: str, done: list[str] | None = None) -> list[str]:
    """The inputs that a SQL text names, each after those that it needs."""
    done = [] if done is None else done
    for name in INPUTS:
        if re.search(rf"\b{name}\b", text) and name not in done:
            _with(INPUTS[name], done)
            done.append(name)
    return done


def oracle(text: str) -> str:
    views = [f"{name} AS ({re.sub(r'{(\w+)}', r'\1', INPUTS[name])})" for name in _with(text)]
    text = text.strip()
    if not views:
        return text
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(views)}, {text[len('WITH RECURSIVE'):]}"
    return f"WITH {', '.join(views)}, {text[4:]}" if text.upper().startswith("WITH ") else f"WITH {', '.join(views)} {text}"


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = oracle(sql)
        return f

    return add
