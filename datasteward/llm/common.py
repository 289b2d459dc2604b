"""Helpers that the operators of this package share: tables in the shared folder, words, word windows, components."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasteward.sources.shared import shared_dir

MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def write_table(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Delete a table that ``write_table`` wrote, once nothing reads it any more."""
    path = getattr(df, "_llm_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every window of n words; of the whole sequence if it is shorter; none without words."""
    m = len(hashes)
    if m == 0:
        return np.empty(0, np.uint64)
    size = min(n, m)
    acc = np.full(m - size + 1, size, np.uint64)
    for k in range(size):
        acc = mix(acc + hashes[k:m - size + 1 + k])
    return acc


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b): comp is the smallest node that can be reached.

    Rounds of large-star and small-star until the edges no longer change. The minima combine before the shuffle, and the
    joins on a vertex are plain equi-joins, which adaptive execution splits at a hub."""
    cur = write_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .filter("u <> v").distinct())
    state = None
    while True:
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = write_table(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .unionAll(low.filter("m < u").select("u", F.col("m").alias("v")))
                            .filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = write_table(large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        drop_table(cur)
        drop_table(large)
        cur = small
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = cur.select(F.col("v").alias("node")).distinct()
    return write_table(cur.select(F.col("u").alias("node"), F.col("v").alias("comp"))
                       .unionAll(roots.select("node", F.col("node").alias("comp"))))
