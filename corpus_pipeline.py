"""Corpus pipeline over `documents`: quality rules, line dedup, SimHash near-dedup, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the
last return the columns of `documents`; the last adds how often the mixture takes each document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm import decontam, line_dedup, mixing, quality, runtime, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects.

    A null or empty text has no words and goes; a null in another column, a repeated row or a tie makes no
    difference, since a row is judged by its text alone. An empty table stays empty.
    """
    return quality.quality_filter(docs).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template recurs; n_chars follows the text. A document that loses its last word goes.

    The first line of a template (smallest doc_id, then earliest) stays, also where rows of one doc_id tie.
    Rows without doc_id or text stay as they are, repeated rows lose the same lines, an empty table stays empty.
    """
    out = line_dedup.drop_recurring_lines(docs.select(*COLUMNS)).where((F.col("n_dropped") == 0) | F.col("text").rlike(quality.INK))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are no near duplicate (five-word shingles, similarity 0.8) of the one with the smallest doc_id in their SimHash group.

    Null, empty and blank texts are one group. Repeated rows of the kept document stay; a row without doc_id
    goes if its group has one, else stays; of several texts of the smallest doc_id the one with the smallest
    hash is kept. An empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    A row is judged by its text alone: null texts stay, repeated rows share their fate, doc_id plays no part.
    Items without a word match nothing; either table may be empty.
    """
    return decontam.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with `copies`: sources as even as they can be with each gone through once to four times.

    A null source is a source; a text without words has no tokens. Equal rows tie and have equal `copies`. An empty
    table stays empty.
    """
    return mixing.mix_sources(docs.select(*COLUMNS), mixing.Mixture(entropy=None, repeats=4.0, cover=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("source_mixing", mix),
]
ORACLE_SQL = None  # SimHash and the exponent search have no SQL form; a test compares every stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order. What a stage keeps is written once to the checkpoint folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = runtime.cut(docs) if k + 1 < len(STAGES) else docs
    return docs
