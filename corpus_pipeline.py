"""The corpus pipeline: language, quality, near duplicates, repeated passages, then packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of ``documents``; ``n_chars`` stays that of the original text.

Each stage gives an empty table for an empty one, takes texts of any length whole, works on rows as they are (a repeated
row is a row of its own, except where a stage says so), and keeps extra columns, whatever their names; packing
returns its own columns alone. What nulls and ties do is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitframe.llm import common, jaccard, language, packing, quality, suffixes


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough (operator 9), by a model fitted on their declared languages.

    Null, empty and letterless texts have no language and go. A null language or source is no evidence. A row without
    id is judged like any other; repeated rows have one result. Of languages with equal posteriors the first counts.
    Without any declared language nothing is accepted.
    """
    model = language.fit_text_model(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    return language.accepted_documents(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table (operator 7).

    Null and empty texts have no words and go. Values on a threshold pass. Ids and other columns play no part.
    """
    return quality.apply_rules(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (operator 2), one row: that of smallest id, rows without id last.

    Rows are told apart by a written row number, so repeated ids, repeated rows and rows without id are
    compared like all others; of rows with equal ids the first written stays. Null and empty texts are like no other, so all
    stay.
    """
    row = "_row" + "_" * max([0, *(len(c) for c in docs.columns)])
    numbered = common.saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = jaccard.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    named = found.join(numbered.select(row, F.col("doc_id").cast("long").alias("_id")), row)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("nameless"), "_id", row)).alias("first"))
    return numbered.join(first.select(F.col("first")[row].alias(row)), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that start earlier in the corpus (operator 5); those left empty go.

    Null and empty texts are empty before and go too. Rows without id come first; rows that repeat id and text are one
    document, so all of them keep what it keeps. Of different texts with one id, that of smaller digest is earlier.
    """
    return suffixes.without_repeats(docs).where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences (operator 1): the pieces of every row, a null text being the empty one, whose end id alone is packed.

    Repeated rows are packed as often as they occur. Of sequences of equal cost the first takes a piece.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

#: Trigram likelihoods, component search and packing aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
