"""State tables and reports on shared storage: versions with retention, logs, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The complete versions of a table, oldest first. A version is a folder v=N that Spark's writer has marked as done."""
    at, fs = _fs(spark, root)
    if not fs.exists(at):
        return []
    names = [s.getPath() for s in fs.listStatus(at)]
    done = [p for p in names if p.getName().startswith("v=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()[2:]) for p in done)


def read_version(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest version, or an empty table of the schema."""
    have = versions(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/v={have[-1]}") if have else spark.createDataFrame([], schema)


def write_version(df: DataFrame, root: str, keep: int = 3) -> int:
    """Writes the next version, then deletes all but the newest `keep`. Readers of older versions are safe as long as these stay."""
    spark = df.sparkSession
    have = versions(spark, root)
    now = (have[-1] if have else 0) + 1
    df.write.mode("overwrite").parquet(f"{root}/v={now}")
    for old in [*have, now][:-keep]:
        at, fs = _fs(spark, f"{root}/v={old}")
        fs.delete(at, True)
    return now


def guarded_replace(new: DataFrame, root: str, least_rows: int, keep: int = 3) -> bool:
    """Replaces a table only if the new one has enough rows."""
    if new.limit(least_rows).count() < least_rows:
        return False
    write_version(new, root, keep)
    return True


def append_log(df: DataFrame, path: str) -> None:
    """Rows appended as JSON lines."""
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def snapshot(df: DataFrame, path: str, table: str, exported_at: str) -> None:
    """One line {exported_at, table, id, fields} for each record."""
    fields = F.struct(*(c for c in df.columns if c != "id"))
    df.select(F.lit(exported_at).alias("exported_at"), F.lit(table).alias("table"), "id", fields.alias("fields")).write.mode("overwrite").json(path)


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A report table of at most `most` rows, as text."""
    held = rows.limit(most).collect()
    head = f"# {title}\n\n| {' | '.join(rows.columns)} |\n| {' | '.join('---' for _ in rows.columns)} |\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |\n" for r in held)


def chunks(lines: DataFrame, key: str, order: str, text: str, most: int = 2800) -> DataFrame:
    """(key, chunk, text): the lines of each key joined greedily into pieces of at most `most` characters; a longer line is a piece of its own. A key's lines are one digest, which is short."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s, line):
        joined = F.when(s["now"] == "", line).otherwise(F.concat(s["now"], F.lit("\n"), line))
        fits = F.length(joined) <= most
        done = F.when(fits | (s["now"] == ""), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"])))
        return F.struct(done.alias("done"), F.when(fits | (s["now"] == ""), joined).otherwise(line).alias("now"))

    packed = lines.groupBy(key).agg(F.aggregate(ordered, start, step, lambda s: F.concat(s["done"], F.array(s["now"]))).alias("p"))
    return packed.select(key, F.posexplode("p").alias("chunk", "text"))
