"""Column profiles from stored states: a new day of a table is read alone, and any range of days is profiled without data.

A state is one row per (source, part, column): counters, an exact decimal sum, squared deviations, extremes, and three of
Spark's mergeable sketches (distinct values, quantiles, frequent values). Rows are folded into the states of all their
columns before the shuffles, which carry states only. States are files by source and part; adding a part again replaces its own files and
no others, so a repeated job counts nothing twice. The exact profile stays the default elsewhere; here the counters, mean,
deviation and extremes are exact too, distinct values and quartiles are estimates, and so are the counts of frequent values.

Cells whose part is null form a part of their own. A column without a value has zero counters and null figures; a table
without rows leaves no state. Values above ``LONG_VALUE`` characters are counted among the frequent ones by their digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasteward.functions import text as tx
from datasteward.operators.cells import atomic_columns, text_of

KEYS = ["source", "column"]
LG_DISTINCT = 14  # 16 KB a state, a standard error of 0.8 %
QUANTILE_K = 800  # about 10 KB a state, ranks within half a per cent
MOST_FREQUENT = 2048  # values a state follows; exact while a column has no more than three quarters of it
LONG_VALUE = 200
COLUMNS_AT_ONCE = 8  # folded by one pass over the rows
STATE = ("column string, total long, n long, n_num long, fixed_sum decimal(38,8), sum_x double, all_fixed boolean, mean double, m2 double, "
         "min_x double, max_x double, distinct_values binary, quantiles binary, frequent struct<sketch: binary, maxItemsTracked: int, "
         "itemDataType: string, itemDataTypeDDL: string>, source string, part string")


def _plain(kind: T.DataType) -> bool:
    """Types whose text is never blank, a word for a missing value, or long."""
    return isinstance(kind, (T.IntegralType, T.DateType, T.TimestampType, T.DoubleType))


def _cell(df: DataFrame, i: int) -> dict[str, Column]:
    """What a state is folded from: the number of a cell, and its texts among the distinct and the frequent values."""
    kind, c, v = df.schema[f"_c{i}"].dataType, F.col(f"_c{i}"), F.col(f"_v{i}")
    if isinstance(kind, T.IntegralType):
        return {"x": c.cast("double"), "key": v, "value": v}
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return {"x": F.lit(None).cast("double"), "key": v, "value": v}
    if isinstance(kind, T.DoubleType):  # -0.0 has the text of 0.0
        return {"x": F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c + F.lit(0.0)), "key": F.upper(v), "value": v}
    s = F.col(f"_s{i}")
    ok = ~tx.is_missing(v, s=s)
    short = F.when(F.length(v) <= LONG_VALUE, v).otherwise(F.concat(F.lit("sha2:"), F.sha2(v, 256)))
    return {"x": F.when(ok, tx.parse_number(v, s)), "key": F.when(ok, F.upper(s)), "value": F.when(ok, short)}


def _folds(i: int) -> dict[str, Column]:
    x, fixed, value = f"_x{i}", f"_fixed{i}", f"_value{i}"
    return {
        "total": F.count(F.lit(1)), "n": F.count(value), "n_num": F.count(x), "fixed_sum": F.try_sum(fixed).cast("decimal(38,8)"),
        "sum_x": F.sum(x), "all_fixed": F.every(F.col(x).isNull() | F.coalesce(F.col(fixed).cast("double") == F.col(x), F.lit(False))),
        "mean": F.avg(x), "m2": F.var_pop(x) * F.count(x), "min_x": F.min(x), "max_x": F.max(x),
        "distinct_values": F.hll_sketch_agg(f"_key{i}", LG_DISTINCT), "quantiles": F.kll_sketch_agg_double(x, QUANTILE_K),
        "frequent": F.expr(f"approx_top_k_accumulate({value}, {MOST_FREQUENT})")}


def partition_states(df: DataFrame, part: Column, columns: list[str]) -> DataFrame:
    """(part, column, state) of ``df``: a row is folded into the states of its part as it is read, so no cell becomes a row of its
    own, and only parts are grouped. A pass folds ``COLUMNS_AT_ONCE`` columns, which bounds the states a task holds."""
    passes = [columns[at:at + COLUMNS_AT_ONCE] for at in range(0, len(columns), COLUMNS_AT_ONCE)]
    return reduce(DataFrame.unionByName, [_fold(df, part, own) for own in passes])


def _fold(df: DataFrame, part: Column, columns: list[str]) -> DataFrame:
    at = range(len(columns))
    d = df.select(part.cast("string").alias("part"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    d = d.withColumns({f"_v{i}": text_of(d, f"_c{i}") for i in at})
    d = d.withColumns({f"_s{i}": tx.strip(F.col(f"_v{i}")) for i in at if not _plain(d.schema[f"_c{i}"].dataType)})
    d = d.select("part", *[c.alias(f"_{name}{i}") for i in at for name, c in _cell(d, i).items()])
    d = d.withColumns({f"_fixed{i}": F.col(f"_x{i}").try_cast("decimal(24,8)") for i in at})
    folded = d.groupBy("part").agg(*[f.alias(f"{name}{i}") for i in at for name, f in _folds(i).items()])
    states = [F.struct(F.lit(c).alias("column"), *[F.col(f"{name}{i}").alias(name) for name in _folds(i)]) for i, c in enumerate(columns)]
    return folded.select("part", F.explode(F.array(*states)).alias("s")).select("part", "s.*")


def add_states(df: DataFrame, source: str, part: Column, path: str, columns: list[str] | None = None) -> None:
    """Store the states of the parts that occur in ``df``; stored states of these parts are replaced, others stay.

    Filter ``df`` to the parts wanted, whole, before the call: the filter reaches the scan."""
    states = partition_states(df, part, columns or atomic_columns(df)).withColumn("source", F.lit(source))
    (states.repartition("source", "part")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "part").parquet(path))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """All stored states; a filter on source and part reads only their files."""
    return spark.read.schema(STATE).parquet(path)


def _merged(states: DataFrame) -> DataFrame:
    m = states.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in ("total", "n", "n_num", "sum_x")], F.try_sum("fixed_sum").alias("fixed_sum"),
        F.every("all_fixed").alias("all_fixed"), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"),
        F.hll_union_agg("distinct_values").alias("distinct_values"), F.kll_merge_agg_double("quantiles").alias("quantiles"))
    total = F.coalesce(F.when(F.col("all_fixed"), F.col("fixed_sum").cast("double")), F.col("sum_x"))
    m = m.withColumn("mean", F.when(F.col("n_num") > 0, total / F.col("n_num")))
    apart = F.col("mean") - F.col("_all")
    spread = (states.join(m.select(*KEYS, F.col("mean").alias("_all")), KEYS).groupBy(*KEYS)
              .agg(F.sum(F.col("m2") + F.col("n_num") * apart * apart).alias("m2")))
    return m.join(spread, KEYS)


def merged_profile(states: DataFrame) -> DataFrame:
    """One row per column with the columns of ``distribution_summary``; unique and the quartiles are estimates."""
    is_num = (F.col("n") > 0) & (F.col("n_num") > F.col("n") * 0.8)
    some = is_num & (F.col("n_num") >= 2)

    def quartile(p: float) -> Column:
        return F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(p)))

    return _merged(states).select(
        *KEYS, F.col("total").alias("count"), F.hll_sketch_estimate("distinct_values").alias("unique"),
        (F.col("total") - F.col("n")).alias("missing"), F.when(is_num, "numeric").otherwise("categorical").alias("type"),
        F.when(some, F.col("mean")).alias("mean"), quartile(0.5).alias("median"),
        F.when(some, F.sqrt(F.col("m2") / (F.col("n_num") - 1))).alias("std"),
        F.when(some, F.col("min_x")).alias("min"), F.when(some, F.col("max_x")).alias("max"),
        quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))


def merged_top_values(states: DataFrame, k: int = 5) -> DataFrame:
    """(source, column, rank, value, cnt): values certain to be frequent, with estimated counts, ties in value order.

    While a column has no more than three quarters of ``MOST_FREQUENT`` values, counts and ranks are exact."""
    m = states.groupBy(*KEYS).agg(F.expr("approx_top_k_combine(frequent)").alias("f"))
    items = F.filter(F.expr(f"approx_top_k_estimate(f, {MOST_FREQUENT})"), lambda e: e["item"].isNotNull())
    order = F.transform(items, lambda e: F.struct((-e["count"]).alias("minus"), e["item"].alias("value")))
    return (m.select(*KEYS, F.posexplode(F.slice(F.array_sort(order), 1, k)))
            .select(*KEYS, (F.col("pos") + 1).alias("rank"), "col.value", (-F.col("col.minus")).alias("cnt")))


def merged_cardinality(states: DataFrame) -> DataFrame:
    """(source, column, n, cardinality, high_cardinality): more than 20 values, over 90 % of them distinct, by estimate."""
    m = states.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("distinct_values")).alias("cardinality"))
    return m.withColumn("high_cardinality", (F.col("n") > 20) & (F.col("cardinality") > F.col("n") * 0.9))
