"""Corpus pipeline: documents in, a weighted training mix out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``docs``. The last returns the mix's manifest: one
row for each document that it takes, with the words taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborspan.llm import decontaminate, line_align, minhash, mixture, quality
from arborspan.llm.queries import QUALITY_FOLDS, QUALITY_HELD, fold, table
from arborspan.llm.shared import drop_stage, stage


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; texts stay as they are."""
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), fold(QUALITY_FOLDS) != QUALITY_HELD)
    return quality.score_quality(docs, model, keep_columns=True).where("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without blocks and passages of over 50 words that an earlier one has; those of which nothing is left go."""
    return line_align.remove_duplicate_lines(docs, drop_emptied=True, inside_lines=True).select(*docs.columns)


#: Similarity in percent from which on the stage takes two documents for near-duplicates.
NEAR_PERCENT = 80


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id.

    Rows that are equal in id and text count once; a row that shares its id with
    another text is judged by its own text; rows without an id stay.
    """
    return minhash.drop_near_duplicates(docs, percent=NEAR_PERCENT).select(*docs.columns)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows."""
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"), min_coverage=0.05, drop_coverage=0.05)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's manifest: what it takes of each document that it takes."""
    mixed = mixture.mix_sources(docs, keep=("source", "lang"))
    return mixed.where("taken > 0").select("doc_id", "source", "lang", "size", "source_size", "target", "taken")


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", benchmark_filter),
    ("mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        new = stage(step(spark, docs, sf_dir), name)
        drop_stage(docs)
        docs = new
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop_stage(docs)  # the mix reads sizes that it wrote itself
    return out


#: The classifier, the alignment and the bands of minima are beyond SQL.
ORACLE_SQL = None
