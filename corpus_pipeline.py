"""Corpus pipeline: quality, exact copies, near copies, mix, pack.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import quality
from strandloom.llm.common import discard, fresh, identified, rows_among, save
from strandloom.llm.exact_dedup import exact_dedup
from strandloom.llm.mixing import mix_sources, mixed_documents
from strandloom.llm.packing import pack_pow2
from strandloom.llm.simhash import near_duplicates


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is at least one half stay.

    A document without words scores 0 and is judged by the thresholds alone; without ratings all stay.
    """
    model = quality.train(docs, quality.label_grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    names = tuple(fresh(name, docs.columns) for name in ("expected_grade", "tail", "keep"))
    return quality.grade_documents(docs, model, names=names).where(F.col(names[2])).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) the row with the largest doc_id stays, of rows that repeat both the last."""
    docs, row = identified(docs)
    return rows_among(docs, row, exact_dedup(docs, row=row).where("kept")).drop(row)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the row with the smallest doc_id stays.

    Texts without words are one group.
    """
    docs, row = identified(docs)
    return rows_among(docs, row, near_duplicates(docs, words=5, similarity=0.8, row=row).where("first")).drop(row)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes; a row for each pass over a document.  Texts without words are not taken."""
    docs, row = identified(docs)
    return mixed_documents(docs, mix_sources(docs, row=row), row)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document (see :func:`strandloom.llm.packing.pack_pow2`); no other columns."""
    return pack_pow2(docs).drop("row_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("mix_sources", mix),
    ("pack_pow2", pack),
]

#: The classifier, the mix and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, save(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
