"""A training corpus from ``documents``: five stages, each written and read again.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last return the columns of ``documents``.

Edge cases, for every stage: an empty table gives an empty table; other columns
pass through unchanged, whatever their names; rows that repeat id and text share
their fate, but for the third stage, which keeps one of them; null and empty
texts are neither toxic nor leaked nor near anything and pass the first four
stages, with size 0 in the mix; null ids are ids like others, sorted first among
lines, last among near copies; without labels or test items nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm import decontaminate, jaccard_join, line_dedup, source_mix, toxicity
from labelforge.llm.common import BLANKS, spare_name, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mark = spare_name(docs, "_toxicity")
    return toxicity.score(docs, chain, column=mark).where(~F.col(f"{mark}.rejected")).drop(mark)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fuzzy repeats of lines are taken out of the texts; documents that lose all their words that way go."""
    gone = spare_name(docs, "_removed")
    out = line_dedup.deduplicate(docs, column=gone)
    blank = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(BLANKS)) == ""
    out = out.where((F.size(gone) == 0) | ~blank)
    changed = F.when(F.size(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", changed).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays (five-word shingles, similarity 0.8)."""
    return jaccard_join.keep_one(docs, words=5, percent=80).select(docs.columns)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    mark = spare_name(docs, "_leaks")
    return decontaminate.find_leaks(docs, items, column=mark).where(F.size(mark) == 0).drop(mark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many tokens of each document the mix takes."""
    return source_mix.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each),
    ("decontamination", drop_leaked),
    ("source_mix", mix_sources),
]

#: SQL cannot express a trained classifier, SimHash or alignment: tests/llm checks the stages against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
