"""A corpus pipeline of five stages: quality, near duplicates, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import carried, materialise, restored, table
from siftwell.llm.mixing import mixing_rates, resample
from siftwell.llm.nbsvm import score_quality
from siftwell.llm.near_dedup import distinct_documents
from siftwell.llm.packing import pack
from siftwell.llm.queries import KEEP, TARGETS, tokenizer_files
from siftwell.llm.suffix_dedup import deduplicated_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    rows = carried(docs, "doc_id", "text")
    extra = tuple(c for c in rows.columns if c != "doc_id")
    scored = score_quality(rows, table(spark, sf_dir, "labels", "doc_id", "quality"), threshold=0.3, extra=extra, prefix="quality_")
    return restored(scored.where(F.col("quality_predicted") == 1), docs, "doc_id", "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity of 0.8 or more) stays."""
    return distinct_documents(docs, share=(80, 100), width=5)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occurred before are cut out of the texts; no character is split."""
    return deduplicated_documents(docs, length=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at the rates that meet the target weights."""
    return resample(docs, mixing_rates(docs, table(spark, sf_dir, "labels", "doc_id"), TARGETS, "lang", KEEP))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 1024 tokens."""
    return pack(docs, capacity=1024, end_id=2, **tokenizer_files())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
