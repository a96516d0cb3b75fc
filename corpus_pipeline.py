"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of
the documents table; where a stage changes texts, n_chars follows. A stage's working tables are deleted when the next
stage is called, so its result has to be written before; run() does so, and its own result is a written table too.

All stages read texts whole, pass null ids and nulls in other columns on, keep columns of any name, and give no rows for
no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeveil.llm.common import discard, recorded, written
from gradeveil.llm.decontamination import find_leaks
from gradeveil.llm.line_dedup import dedup_lines
from gradeveil.llm.near_dedup import drop_near_duplicates
from gradeveil.llm.packing import pack_documents
from gradeveil.llm.quality_rules import apply_rules


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_working: list[str] = []


def stage(f: Stage) -> Stage:
    """Keeps the working tables of one stage at a time."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _working)
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _working.extend(made)
        return out

    return run_stage


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts among them. Repeated rows stay."""
    return _columns(apply_rules(docs).where("kept"), docs)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from all but the one with the greatest id; rows that share that id all keep
    them. A text may become empty; null becomes empty."""
    return _columns(dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")), docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id (shingles of five words, similarity
    0.8); of rows with one id and one text one stays. Texts without words are linked with nothing and stay."""
    return drop_near_duplicates(docs, shingle=5, percent=80)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have an item of the benchmark go. Null and empty texts have none; repeated rows are judged alike."""
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _columns(leaks.where("not contaminated"), docs)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 4096 tokens: one row per piece. An empty text is its end id; repeated
    rows are packed each."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The last stage needs a tokenizer, which SQL can't express; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = written(f(spark, docs, sf_dir), name)
    return docs
