"""The same logic over streams: each run takes what has arrived and updates versioned state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.identity import process_reason, upsert_seen
from tessella.sources.stores import read_version, versions, write_version

SEEN = "url string, source string, status string, change_hash string, content_hash string, session_id string, verdict string, confidence double, first_seen long, last_seen long"


def arrivals(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, `files` in a batch at most."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def maintain_seen(batches: DataFrame, state: str, decided: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Decides each batch against the state, writes the decisions, then the state's next version.

    The state's version N + 1 is that after batch N, and the decisions lie in a folder of the batch, so a batch that runs
    again after a failure overwrites what it wrote and reads the version before it. Without an interval, the query ends
    when all that has arrived is done.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        done = [v for v in versions(spark, state) if v <= n]
        seen = spark.read.schema(SEEN).parquet(f"{state}/v={done[-1]}") if done else spark.createDataFrame([], SEEN)
        process_reason(batch, seen).write.mode("overwrite").parquet(f"{decided}/batch={n}")
        upsert_seen(seen, batch, F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{state}/v={n + 1}")

    writer = batches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def first_arrivals(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once within the watermark; keys come again after it, which bounds the state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, delay: str, width: str, slide: str | None, *keys: str) -> DataFrame:
    """Counts by event-time window and keys; late rows beyond the delay are left out. An extension."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width, slide), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def nightly(steps: list[tuple[str, Callable[[], None]]], essential: str) -> list[tuple[str, str]]:
    """Runs steps in order; a failure of the essential one ends the run, others are noted. Returns (step, outcome)."""
    out: list[tuple[str, str]] = []
    for name, step in steps:
        try:
            step()
            out.append((name, "ok"))
        except Exception as e:
            out.append((name, f"failed: {type(e).__name__}"))
            if name == essential:
                break
    return out


def refresh_state(spark: SparkSession, state: str, batch: DataFrame, now: int, keep: int = 3) -> int:
    """One run without a stream: the state's next version after a batch."""
    return write_version(upsert_seen(read_version(spark, state, SEEN), batch, F.lit(now).cast("long")), state, keep)
