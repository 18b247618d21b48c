"""The discovery plan: cheap tests first, the model last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import keyword_prescreen


def relevance(rows: DataFrame, text: Column, model: Callable[[DataFrame], DataFrame], lexicon: dict | None = None, least: float = 0.6) -> DataFrame:
    """rows with `relevant` and `stage` (prescreen_fail, llm, confidence_fail). `model` adds is_relevant and confidence and sees only rows that pass the screening."""
    hit = F.coalesce(keyword_prescreen(text, **(lexicon or {})), F.lit(False))
    passed, failed = rows.where(hit), rows.where(~hit)
    judged = model(passed)
    sure = judged.withColumn("relevant", F.col("is_relevant") & (F.col("confidence") >= least)).withColumn("stage", F.when(F.col("is_relevant") & (F.col("confidence") < least), "confidence_fail").otherwise("llm"))
    out = failed.withColumn("relevant", F.lit(False)).withColumn("stage", F.lit("prescreen_fail"))
    return sure.drop("is_relevant", "confidence").unionByName(out)
