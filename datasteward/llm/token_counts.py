"""Token counts with a cache by digest: only texts that no stored count covers are encoded, once each."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE = "tokenizer string, digest binary, n_tokens long"
BATCH_CHARS = 500_000  # texts per call of the library


def tokenizer_version(path: str) -> str:
    """A digest of the vocabulary file and of the library's version: counts of another one are never taken."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def content(text):
    """The normalised content: null is empty. The tokenizer keeps case and white space, so nothing else may change."""
    return F.coalesce(text, F.lit(""))


def content_digest(text):
    return F.unhex(F.sha2(content(text), 256))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; empty before the first append. Repeated digests, left by a repeated append, count once."""
    try:
        stored = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or str(e)):
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.groupBy("tokenizer", "digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encode(path: str, version: str):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_padding()
        library.no_truncation()
        for batch in batches:
            counts, part, size = [], [], 0
            for k, text in enumerate(batch.column(1)):
                part.append(text.as_py())
                size += len(part[-1])
                if size >= BATCH_CHARS or k == batch.num_rows - 1:
                    counts += [len(e) for e in library.encode_batch_fast(part, add_special_tokens=False)]
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts), pa.string()), batch.column(0),
                                              pa.array(counts, pa.int64())], names=["tokenizer", "digest", "n_tokens"])
    return run


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_path: str, text_col: str = "text") -> None:
    """Encode the distinct texts whose count is missing and append the counts to the cache.

    Copies of a text meet before the shuffle already, so a hot text costs one row per task."""
    version = tokenizer_version(tokenizer_path)
    stored = read_cache(docs.sparkSession, cache_path).filter(F.col("tokenizer") == version).select("digest")
    texts = docs.select(content_digest(F.col(text_col)).alias("digest"), content(F.col(text_col)).alias("text"))
    missing = texts.groupBy("digest").agg(F.first("text").alias("text")).join(stored, "digest", "left_anti")
    missing.mapInArrow(_encode(tokenizer_path, version), CACHE).write.mode("append").parquet(cache_path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024, text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, repeated rows included; null counts as empty text.

    The cache is filled first; then every row takes its count by digest. Extra columns are ignored."""
    fill_cache(docs, tokenizer_path, cache_path, text_col)
    counts = (read_cache(docs.sparkSession, cache_path).filter(F.col("tokenizer") == tokenizer_version(tokenizer_path))
              .select("digest", "n_tokens"))
    rows = docs.select("doc_id", content_digest(F.col(text_col)).alias("digest"),
                       F.octet_length(content(F.col(text_col))).cast("long").alias("n_bytes"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
