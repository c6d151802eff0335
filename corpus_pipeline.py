"""A training corpus from raw documents: each stage is an operator over all that the stage before it kept.

Rows are judged one by one, whatever their doc_id: rows that share one, or have none, are told apart by their texts. Null
and empty texts, repeated rows, extra columns and empty tables go through all stages; what each makes of them stands with
its operator. Columns pass unchanged up to the last stage, but for text and n_chars, which the line dedup rewrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, contamination, lines, quality, simhash
from lodestone.llm.common import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't take for toxic or of low quality; all of them if there are no labels."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line at its earliest place only; all documents, some with less text, a null text with none still."""
    return lines.dedup_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: texts linked by a similarity of 0.8 or more of their five-word
    shingles; of empty texts one too. The one of least doc_id stays, one without id only if no other is in the group."""
    return simhash.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; all of them if it is empty."""
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of the ids and of what they decode to; none for an empty text."""
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]
#: SQL can express neither the classifier nor BPE: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
