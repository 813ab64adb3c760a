"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns
a DataFrame; all but the last return the columns of documents.  A stage begins with
executors that have given back the memory of the one before.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import _shared, near_dup, packing, secrets, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier marks as toxic go."""
    _shared.settle(spark)
    model = toxicity.train(docs, _shared.table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    _shared.settle(spark)
    return near_dup.deduplicate(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark and its length follows."""
    _shared.settle(spark)
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of training sequences."""
    _shared.settle(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("near_dup", near_dup_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: SQL can express neither the classifier nor the tokenizer; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is written and read again for the next."""
    docs = _shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _shared.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
