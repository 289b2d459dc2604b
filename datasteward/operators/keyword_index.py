"""A stored keyword index in segments, and exact BM25 search that leaves frequent terms out where they cannot matter.

Postings stand in blocks by (term, bucket of documents), so a frequent term has many rows and none grows with the corpus.
A block knows its largest term frequency and its shortest document, which bound what a term can add to a score. A
re-ingested source gets a new segment; its documents in older ones no longer count, and nothing is rewritten."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasteward.functions import text as tx
from datasteward.operators.keyword_scores import MARGIN, numbered_terms, pair_scores
from datasteward.operators.retrieval import B, K1, query_terms, top_k
from datasteward.sources.shared import materialize, shared_dir

DOCS_PER_BLOCK = 4096
WORDS = 1 << 20  # words that are counted at a time
SEEDS = 20  # times k postings of the rarest terms set the first threshold
MOST_SEEDS = 2000  # times k postings of one term are read for it at most


@dataclass(frozen=True)
class KeywordIndex:
    """The tables docs (seq, id, source, dl) and blocks (seq, term, bucket, n, max_tf, min_dl, entries) under ``path``."""
    spark: SparkSession
    path: str

    def docs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/docs")

    def live(self) -> DataFrame:
        """The documents of the newest segment of each source."""
        d = self.docs()
        newest = d.groupBy(F.col("source").alias("s_")).agg(F.max("seq").alias("newest"))  # one row for each source
        return d.join(newest, F.col("source").eqNullSafe(F.col("s_")) & (F.col("seq") == F.col("newest"))).drop("s_", "newest")

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")


def build_index(corpus: DataFrame, path: str | None = None) -> KeywordIndex:
    """An index of (id, source, text) in a new folder, or a further segment of the index at ``path``: the sources in
    ``corpus`` replace all their earlier documents. The documents are written last, so an unfinished segment does not count.

    Texts are cut into words once. Null texts have no words and no postings, but count as documents; ids must be unique
    within a segment."""
    spark = corpus.sparkSession
    index = KeywordIndex(spark, path or f"{shared_dir(spark)}/keyword-index-{uuid.uuid4().hex}")
    seq = 0 if path is None else (index.docs().agg(F.max("seq")).first()[0] + 1)
    words = materialize(corpus.select("id", "source", F.coalesce(tx.tokenize(F.col("text")), F.array().cast("array<string>")).alias("tok")))
    buckets = max(1, -(-words.count() // DOCS_PER_BLOCK))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([words.schema["id"], T.StructField("dl", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    post = words.select("id", "tok").mapInArrow(_postings, schema).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    # dealt once, into the order in which the blocks are written
    blocks = (post.repartitionByRange(n, "term", "bucket").groupBy("term", "bucket")
              .agg(F.collect_list(F.struct("id", "tf", "dl")).alias("entries"))  # at most the documents of a bucket
              .withColumn("entries", _once(F.col("entries"))))
    (blocks.select("term", "bucket", F.size("entries").cast("long").alias("n"), F.array_max(F.transform("entries", lambda e: e["tf"])).alias("max_tf"),
                   F.array_min(F.transform("entries", lambda e: e["dl"])).alias("min_dl"), "entries")
     .sortWithinPartitions("term", "bucket").withColumn("seq", F.lit(seq)).write.mode("append").partitionBy("seq").parquet(f"{index.path}/blocks"))
    (words.select("id", "source", F.size("tok").alias("dl"), F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(seq).alias("seq"))
     .write.mode("append").partitionBy("seq").parquet(f"{index.path}/docs"))
    return index


def _postings(batches):
    """(id, dl, term, tf) of documents (id, tok): the words of a document are counted where it lies."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column("tok")).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(lengths) - lengths) // WORDS
        starts = np.flatnonzero(np.r_[True, np.diff(part) != 0])
        for a, b in zip(starts, [*starts[1:], len(lengths)], strict=True):
            tok, own = batch.column("tok").slice(a, b - a), pa.array(lengths[a:b], pa.int32())
            words = pc.list_flatten(tok).dictionary_encode()
            doc, n = pc.list_parent_indices(tok).to_numpy().astype(np.int64), len(words.dictionary)
            if n:
                pair, tf = np.unique(doc * n + words.indices.to_numpy(), return_counts=True)
                at = pa.array(pair // n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a).take(at), own.take(at), words.dictionary.take(pa.array(pair % n)), pa.array(tf, pa.int64())],
                    names=["id", "dl", "term", "tf"])


def _once(entries: Column) -> Column:
    """The entries (id, tf, dl) with the postings of a repeated id added up."""
    ids = F.array_distinct(F.transform(entries, lambda e: e["id"]))

    def added(i):
        own = F.filter(entries, lambda e: e["id"].eqNullSafe(i))
        return F.struct(i.alias("id"), F.aggregate(own, F.lit(0).cast("long"), lambda s, e: s + e["tf"]).alias("tf"), own[0]["dl"].alias("dl"))
    return F.when(F.size(ids) < F.size(entries), F.transform(ids, added)).otherwise(entries)


def _impact(tf, dl, avgdl: float):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def search(index: KeywordIndex, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, bm25, rank): the best k documents of every query (query_id, text), exactly.

    Postings of a query's rarest terms give k documents and the score that the k-th best reaches at least. Terms whose
    bounds together stay below it cannot lift a document on their own: only documents with one of the other terms are
    candidates, and the weak terms are added up only in blocks that hold a candidate. Queries stay a table throughout. A query
    without words, or without a known word, has no rows."""
    live = index.live()
    size = live.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    n_docs, avgdl = size["n"], size["avgdl"] or 1.0
    q = query_terms(queries)
    names = numbered_terms(q)
    blocks = index.blocks().join(names, "term")
    whole = index.docs().count() == n_docs
    if whole:
        known = blocks.groupBy("t").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))
    else:  # replaced documents neither count nor bound
        entries = blocks.select("seq", "t", F.explode("entries").alias("e")).select("seq", "t", "e.*")
        entries = materialize(entries.join(live.select("seq", "id"), ["seq", "id"], "left_semi"))
        known = entries.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = materialize(q.join(names, "term").join(known, "t").select(
        "query_id", "t", "term", "df", (F.col("qtf") * idf).alias("weight"), _impact(F.col("max_tf"), F.col("min_dl"), avgdl).alias("most"))
        .withColumn("bound", F.col("weight") * F.col("most")).drop("most"))

    def read(wanted: DataFrame | None = None) -> DataFrame:
        """(id, t, a) of the postings of the wanted terms."""
        own = blocks if whole else entries
        own = own if wanted is None else own.join(wanted.select("t").distinct(), "t", "left_semi")
        if whole:
            own = own.select("t", F.explode("entries").alias("e")).select("t", "e.*")
        return own.select("id", "t", _impact(F.col("tf"), F.col("dl"), avgdl).alias("a"))

    rare = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)  # the words of a query
    seeds = (terms.withColumn("read", F.coalesce(F.sum("df").over(rare), F.lit(0)))
             .filter((F.col("read") < SEEDS * k) & (F.col("df") <= MOST_SEEDS * k)))
    first = (read(seeds).join(seeds.select("query_id", "t", "weight"), "t").groupBy("query_id", "id")
             .agg(F.sum(F.col("weight") * F.col("a")).alias("score")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    least = (first.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).groupBy("query_id")
             .agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("query_id", "least"))
    weak = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    split = (terms.join(least, "query_id", "left").withColumn("upto", F.sum("bound").over(weak))
             .withColumn("least", F.coalesce("least", F.lit(float("-inf")))).withColumn("strong", F.col("upto") >= F.col("least") - MARGIN))
    rest = F.coalesce(F.sum(F.when(~F.col("strong"), F.col("bound"))).over(Window.partitionBy("query_id")), F.lit(0.0))
    asked = split.select("query_id", "t", F.col("weight").alias("w"), "strong", rest.alias("rest"), "least")
    return top_k(pair_scores(read(), asked, n_docs, k).withColumnRenamed("score", "bm25"), k, "bm25")
