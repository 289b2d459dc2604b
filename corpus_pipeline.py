"""The training-data pipeline: quality rules, near duplicates, personal data, source mix, pieces.

Each stage reads what its predecessor wrote as Parquet in the shared folder, and all but the last return the columns of
``documents``. ``run`` chains them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from datasteward.llm import mixing, near_dup, pieces, pii, quality
from datasteward.llm.common import drop_table, write_table
from datasteward.llm.queries import tokenizer_file
from datasteward.plans.base import Registry, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.quality_filter(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return near_dup.drop_near_duplicates(docs, words=5, percent=80)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redact_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: one row for each time a document is drawn."""
    return mixing.mixed_rows(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, ids, lossless) per row of the mix."""
    return pieces.sampled_pieces(docs, tokenizer_file("piece_bpe_32k.model"), keep=("lang", "source"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_dup_stage), ("personal_data", personal_data_stage),
          ("mixing", mixing_stage), ("pieces", pieces_stage)]

#: Hashing, expectation-maximisation, seeded draws and segmentation have no counterpart in SQL: tests compare each stage
#: with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir))
        drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


R = Registry()
R.add("pipeline", ORACLE_SQL)(run)
