"""Contiguous balanced shards from global prefix sums of byte sizes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datasteward.llm.common import drop_table, write_table


def byte_size(text):
    """UTF-8 bytes plus 1; null counts as empty."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_by_bytes(docs: DataFrame, size, group, shards: int = 8, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with size, shard (0 to shards - 1) and slot (0, 1, ... inside the shard).

    Rows are put in the order of (hash of ``group``, ``group``, id): equal groups stand together, and a large group spreads
    over ranges of its ids. Each range partition is summed; the running total of these few totals plus the running sum inside
    the partition is the row's global prefix. The prefix is cut at equal targets. A cut that falls inside a group moves to
    the group's start if the group is no larger than the largest row, so small groups stay whole and every shard differs from
    the target by less than two rows of the largest size. Ties in the order are rows equal in group and id; they share a
    partition. Null groups and ids come first. An empty table gives no rows."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumns({"size": size, "group_": group}).withColumn("hash_", F.xxhash64("group_"))
    order = ["hash_", "group_", id_col]
    ranged = write_table(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                         .withColumn("part_", F.spark_partition_id()))
    totals = ranged.groupBy("part_").agg(F.sum("size").alias("bytes_"), F.count(F.lit(1)).alias("rows_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("part_", F.coalesce(F.sum("bytes_").over(before), F.lit(0)).alias("bytes_before_"),
                            F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("rows_before_"))
    inside = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = write_table(
        ranged.join(F.broadcast(offsets), "part_")
        .withColumns({"start_": F.col("bytes_before_") + F.sum("size").over(inside) - F.col("size"),
                      "row_": F.col("rows_before_") + F.count(F.lit(1)).over(inside) - 1})
        .drop("part_", "bytes_before_", "rows_before_"))
    drop_table(ranged)

    whole = placed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t"), F.coalesce(F.max("size"), F.lit(0)).alias("m")).first()
    targets = [whole["t"] * k / shards for k in range(1, shards)]
    crossed = None
    for k, t in enumerate(targets):  # the row in which a cut falls, or which begins there: one per cut
        at = placed.filter((F.col("start_") <= t) & (F.col("start_") + F.col("size") > t)).select(
            F.lit(k).alias("k"), F.col("hash_").alias("h"), F.col("group_").alias("g"), "start_", "size")
        crossed = at if crossed is None else crossed.unionAll(at)
    cuts = list(targets)
    if crossed is not None:
        crossed = write_table(crossed)
        groups = (placed.join(F.broadcast(crossed.select("k", "h", "g")), (F.col("hash_") == F.col("h")) & F.col("group_").eqNullSafe(F.col("g")))
                  .groupBy("k").agg(F.min("start_").alias("start"), F.sum("size").alias("bytes")))
        rows = crossed.select("k", "start_", "size").join(groups, "k").collect()  # one row per cut at most
        for r in rows:
            near = r["start_"] if targets[r["k"]] - r["start_"] < r["size"] / 2 else r["start_"] + r["size"]
            cuts[r["k"]] = r["start"] if r["bytes"] <= whole["m"] else near
        drop_table(crossed)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("start_") >= F.lit(float(c))).cast("int")
    dealt = placed.withColumn("shard", shard.cast("int"))
    first = dealt.groupBy("shard").agg(F.min("row_").alias("first_"))  # one row per shard
    return (dealt.join(F.broadcast(first), "shard").withColumn("slot", (F.col("row_") - F.col("first_")).cast("long"))
            .select(*[F.col(f"`{c}`") for c in docs.columns], "size", "shard", "slot"))


def document_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document; equal texts are a group. The texts are
    read once, only sizes and hashes are shuffled."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("text_key"), byte_size(F.col("text")).alias("bytes"))
    out = shard_by_bytes(slim, F.col("bytes"), F.col("text_key"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
