"""From raw documents to packed sequences: each stage calls one operator of tessella.llm on all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import langid, minhash, mixing, packing, toxicity
from tessella.llm.common import table, written
from tessella.llm.tokens import vocabulary_path

#: Texts whose sets of five-word shingles have a Jaccard similarity of so many hundredths or more are near duplicates.
NEAR = 80
#: A text of this score or more is rejected as toxic.
TOXIC = 0.5
#: A text farther than this from every language's profile is in none of them (of 10,000 texts in four languages, none is
#: beyond 0.62); one whose prediction has this score or more is not in another language.
FARTHEST, SURE = 0.65, 0.9
#: Shares of the mix's tokens by predicted quality.
TARGETS = {"good": 0.98, "poor": 0.02}
VOCABULARY, END_ID, WINDOW = "byte_bpe_50k.json", 1, 2048
#: Words that a packing worker remembers: less than by default, as other stages left memory in use.
REMEMBERED = 150_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores TOXIC or more go.

    Null and empty texts, and ones without a word of any labelled example, stay; rows that repeat an id are judged each by
    its text; without labelled examples of both classes, all rows go or stay as the only class says. Other columns stay as
    they are; an empty table stays empty.
    """
    model = toxicity.fit(toxicity.sample(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, keep=tuple(docs.columns)).where(F.col("score") < TOXIC).select("kept.*")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go whose language can't be told, is none of those learnt, or is not the one they are said to be in.

    That is: texts without a letter (null and empty ones too), texts further than FARTHEST from every profile, and texts
    whose prediction differs from a non-null `lang` with a score of SURE or more. Profiles are learnt from all rows with a
    `lang`; if there are none, no text has a language. Rows that repeat an id are judged each by its text; other columns
    stay as they are; an empty table stays empty.
    """
    found = langid.identify(docs, langid.profiles(docs), keep=tuple(docs.columns))
    stated = F.col("kept.lang").cast("string")
    other = F.coalesce((stated != F.col("lang_pred")) & (F.col("score") >= SURE), F.lit(False))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("distance") <= FARTHEST) & ~other).select("kept.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that of the smallest id; of rows that repeat id and text, one.

    Rows without id or without a word all stay. Other columns stay as they are; an empty table stays empty.
    """
    return minhash.distinct_documents(docs, threshold=NEAR)


def mix_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row stands as often as its rate says: poor ones mostly go, a few good ones stand twice.

    A text without tokens has the rate that the labelled table's shares give. A null id draws like any other, rows that
    repeat an id draw alike. Without labels every row stands once. Other columns stay as they are; an empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels")
    labelled = labels.select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))
    mixed, _ = mixing.mix(docs, labelled, TARGETS, keep=tuple(docs.columns))
    return mixed.where("copies > 0").select("kept", F.explode(F.sequence(F.lit(1), "copies"))).select("kept.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows' token ids, packed into windows: a row a piece, as packing.pack says, for nulls and empties too."""
    return packing.pack(docs, vocabulary_path(VOCABULARY), END_ID, WINDOW, remembered=REMEMBERED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_by_quality),
    ("packing", pack),
]

#: Learnt models and a tokenizer decide; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
