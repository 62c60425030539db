"""The corpus pipeline over `documents`: language ID, near-duplicate groups, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. A stage's
result is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alleloom import ship
from alleloom.llm import jaccard, langid, packing, pii, substrings
from alleloom.llm.common import table, written

#: A language is taken as known from this calibrated score on; below it, a text is of no language learned.
LEAST_SCORE = 0.3
#: Near duplicates: shingles of five words, similarity of at least 0.8.
SHINGLE, PERCENT = 5, 80
#: Passages of that many words that an earlier document has go; the first level has windows of FIRST_WORDS at least.
PASSAGE_WORDS, FIRST_WORDS = 50, 12
PII_KEY = b"surrogates of the test corpus"


def _aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but the needed ones under names that no operator uses, and the columns as they were."""
    names = {c: c if c in needed else f"_column_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    ship(spark)
    docs, back = _aside(docs, "doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies."""
    ship(spark)
    return jaccard.kept(docs, SHINGLE, PERCENT).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; documents that were nothing else go."""
    ship(spark)
    docs, back = _aside(docs, "doc_id", "text", "n_chars")
    cut = substrings.deduplicated(docs, PASSAGE_WORDS, least=FIRST_WORDS, new=("n_words", "n_removed", "kept_text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = cut.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(back)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data."""
    ship(spark)
    docs, back = _aside(docs, "doc_id", "text", "n_chars")
    done = pii.pseudonymised(docs, PII_KEY)
    return done.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(back)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: pieces of documents in bins."""
    ship(spark)
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL expresses the trained classifier or the keyed surrogates; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
