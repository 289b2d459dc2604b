"""Cleaning of text columns with a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasteward.functions import text as tx


def clean_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: tx.auto_clean(F.col(c))["cleaned"] for c in columns})


def change_log(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """One row per changed cell: ids, column, original, cleaned, fixes."""
    long = df.select(*ids, *columns).unpivot(ids, columns, "column", "original")
    c = tx.auto_clean(F.col("original"))
    return (long.withColumn("_c", c).filter(F.size("_c.fixes") > 0)
            .select(*ids, "column", F.coalesce("original", F.lit("")).alias("original"),
                    "_c.cleaned", "_c.fixes"))


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)
