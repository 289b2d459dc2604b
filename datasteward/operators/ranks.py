"""Exact ranks and quantiles over weighted values without one task seeing a whole column.

The values are dealt once by ranges of (group, value), so the partitions are in the global order, and a value finds its
partition by binary search however many there are. One row for each partition and group in it gives the rank at which
the group goes on in the next partition, and each partition counts on from there. Nothing reaches the driver but the
sampled bounds of the ranges. The bounds only balance the work: the results are exact whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datasteward.sources.shared import materialize


def _placed(values: DataFrame, keys: list[str], x: str, cnt: str, parts: int | None) -> tuple[DataFrame, DataFrame]:
    """(values with _part, (keys, _part, _offset, _size): how many rows of the group stand before and in each part)."""
    n = parts or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(values.repartitionByRange(n, *keys, x).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_part").agg(F.sum(cnt).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    return ranged, sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))


def _before(keys: list[str], x: str, cnt: str):
    w = (Window.partitionBy(*keys, "_part").orderBy(x)
         .rowsBetween(Window.unboundedPreceding, -1))
    return F.col("_offset") + F.coalesce(F.sum(cnt).over(w), F.lit(0))


def rank_values(values: DataFrame, keys: list[str], x: str = "x", cnt: str = "cnt",
                parts: int | None = None) -> DataFrame:
    """Add ``before`` (rows with a smaller x) and ``avg_rank`` (1-based, ties averaged)."""
    ranged, starts = _placed(values, keys, x, cnt, parts)
    out = ranged.join(starts.drop("_size"), [*keys, "_part"]).withColumn("before", _before(keys, x, cnt))
    return (out.withColumn("avg_rank", F.col("before") + (F.col(cnt) + 1) / 2)
            .drop("_part", "_offset"))


def quantiles(values: DataFrame, keys: list[str], probs: dict[str, float], x: str = "x",
              cnt: str = "cnt", parts: int | None = None) -> DataFrame:
    """One row per key with a column per name in ``probs``: linear interpolation at (n-1)p.

    Only the partitions in which a wanted position falls are counted through."""
    ranged, starts = _placed(values.filter(F.col(x).isNotNull()), keys, x, cnt, parts)
    starts = materialize(starts)
    total = starts.groupBy(*keys).agg(F.sum("_size").alias("_n"))
    at = {name: (F.col("_n") - 1) * F.lit(p) for name, p in probs.items()}
    spots = F.array(*[F.struct(F.lit(name).alias("_name"), F.lit(end).alias("_end"), (a - F.floor(a)).alias("_frac"),
                               F.least(F.floor(a) + k, F.col("_n") - 1).alias("_pos"))
                      for name, a in at.items() for k, end in enumerate(("lo", "hi"))])
    spot = (starts.join(total, keys).withColumn("_s", F.explode(spots)).select("*", "_s.*")
            .filter((F.col("_pos") >= F.col("_offset")) & (F.col("_pos") < F.col("_offset") + F.col("_size"))))
    needed = spot.select(*keys, "_part", "_offset").distinct()
    ranked = (ranged.join(needed, [*keys, "_part"])
              .withColumn("_before", _before(keys, x, cnt))
              .select(*keys, "_part", F.col(x).alias("_x"), F.col(cnt).alias("_c"), "_before"))
    found = (ranked.join(spot.select(*keys, "_part", "_name", "_end", "_frac", "_pos"), [*keys, "_part"])
             .filter((F.col("_pos") >= F.col("_before"))
                     & (F.col("_pos") < F.col("_before") + F.col("_c"))))

    def value(name: str):
        lo = F.max(F.when((F.col("_name") == name) & (F.col("_end") == "lo"), F.col("_x")))
        hi = F.max(F.when((F.col("_name") == name) & (F.col("_end") == "hi"), F.col("_x")))
        frac = F.max(F.when(F.col("_name") == name, F.col("_frac")))
        return (lo + frac * (hi - lo)).alias(name)

    return found.groupBy(*keys).agg(*[value(name) for name in probs])


def top_k(scores: DataFrame, k: int, score: str, id: str = "id") -> DataFrame:
    """Best k per query; scores that agree to nine decimals are ties and go by id.

    Sums of a distributed job may differ in the last digits from run to run, so the order
    must not hang on them. Plans a partial limit before the shuffle.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), id)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
