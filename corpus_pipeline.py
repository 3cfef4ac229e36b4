"""Corpus pipeline: five stages turn ``documents`` into token files.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps, with
the columns of documents; the last one returns the table of contents of the
token files.  Between stages the rows are written as Parquet and read again, so
a lost executor never costs more than a part of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, mixing, near_dup, quality, queries, tokens
from quillon.llm.common import cut


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose quality score is under the bound of prediction."""
    model = quality.fit_quality(docs, queries.table(spark, sf_dir, "labels"))
    return docs.filter(quality.quality_of(spark, F.col("text"), model) >= quality.PREDICT_AT)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate groups the document of the least doc_id stays."""
    gone = near_dup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(cut(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a benchmark item."""
    return decontaminate.without_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document taken twice is there twice."""
    return mixing.mixed_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; their table of contents."""
    return tokens.token_output(docs, public_tokenizers.path(queries.TOKENIZER))


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("tokens", tokenized),
]

#: SQL can express neither the trained models nor the token files.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table documents."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
