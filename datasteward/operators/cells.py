"""The two shared intermediates: one row per cell, and one row per distinct value.

``value_counts`` is the only place where whole tables are shuffled by value. It holds a
value at most once per column, so later joins on a value fan out by the number of
columns, never by the number of rows, and a value that fills a third of a column is one
row after the map-side combine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasteward.functions import text as tx


def atomic_columns(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


def as_text(df: DataFrame, columns: list[str] | None = None, scale: int = 4) -> DataFrame:
    """Every column as text, without loss: two floating-point cells have equal text only if they are equal."""
    return df.select(*[text_of(df, name, scale) for name in columns or atomic_columns(df)])


def cells(df: DataFrame, source: str, columns: list[str] | None = None,
          ids: list[str] | None = None) -> DataFrame:
    """(source, [ids], column, value): one scan, the unpivot is an Expand over it."""
    columns = columns or [c for c in atomic_columns(df) if c not in (ids or [])]
    df = df.select(*(ids or []), *columns)
    text = as_text(df, columns)
    if ids:
        kept = [F.col(i).alias(f"_id_{i}") for i in ids]
        text = df.select(*kept, *[text_of(df, c) for c in columns])
        out = text.unpivot([f"_id_{i}" for i in ids], columns, "column", "value")
        out = out.withColumnsRenamed({f"_id_{i}": i for i in ids})
        return out.select(F.lit(source).alias("source"), *ids, "column", "value")
    out = text.unpivot([], columns, "column", "value")
    return out.select(F.lit(source).alias("source"), "column", "value")


def text_of(df: DataFrame, name: str, scale: int = 4):
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        fixed = c.try_cast(f"decimal(38,{scale})")
        # the fixed form where it holds the whole value, the shortest exact form elsewhere (1.0E-5, 1.0E36, NaN)
        return F.when(fixed.cast("double") == c.cast("double"), fixed.cast("string")).otherwise(c.cast("string")).alias(name)
    return c.cast("string").alias(name)


def cells_of(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    columns = columns or {}
    parts = [cells(df, name, columns.get(name)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def column_names(tables: dict[str, DataFrame]) -> DataFrame:
    """(source, column) of all profiled columns, also of tables without rows; from the schemas alone."""
    rows = [(name, c) for name, df in tables.items() for c in atomic_columns(df)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "source string, column string")


def value_counts(cell_rows: DataFrame, key: str = "raw") -> DataFrame:
    """(source, column, value, cnt). With key upper/lower blanks and nulls are dropped."""
    if key == "raw":
        return cell_rows.groupBy("source", "column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    kept = cell_rows.filter(~tx.is_blank(F.col("value")))
    # combine raw spellings first, so the regex and the case change run once per distinct text
    raw = kept.groupBy("source", "column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return (raw.withColumn("value", tx.value_key(F.col("value"), key))
            .groupBy("source", "column", "value").agg(F.sum("cnt").alias("cnt")))
