"""Numeric outliers by quartile fences or by distance from the mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasteward.functions import text as tx
from datasteward.operators import ranks
from datasteward.operators.cells import cells
from datasteward.operators.profile import KEYS, numeric_values, spread
from datasteward.sources.shared import materialize

REASONS = {"iqr": "fuera de rango IQR", "zscore": "zscore > 3.0"}


def bounds(numbers: DataFrame, method: str = "iqr") -> DataFrame:
    """(source, column, n_num, lower, upper); columns with fewer than four numbers have none."""
    if method == "zscore":
        s = spread(numbers).filter(F.col("n_num") >= 4)
        return s.select(*KEYS, "n_num", (F.col("mean") - 3 * F.col("std")).alias("lower"),
                        (F.col("mean") + 3 * F.col("std")).alias("upper"))
    n = numbers.groupBy(*KEYS).agg(F.sum("cnt").alias("n_num"))
    q = ranks.quantiles(numbers, KEYS, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return (n.join(q, KEYS).filter(F.col("n_num") >= 4)
            .select(*KEYS, "n_num", (F.col("q1") - 1.5 * iqr).alias("lower"),
                    (F.col("q3") + 1.5 * iqr).alias("upper")))


def _outside(method: str):
    out = (F.col("x") < F.col("lower")) | (F.col("x") > F.col("upper"))
    return out & (F.col("lower") < F.col("upper")) if method == "zscore" else out


def numeric_anomalies(cell_rows: DataFrame, method: str = "iqr") -> DataFrame:
    """Bounds, count and share of outliers per column."""
    numbers = materialize(numeric_values(cell_rows, drop_missing=False))
    b = bounds(numbers, method)
    return (numbers.join(F.broadcast(b), KEYS)
            .groupBy(*KEYS, "n_num", "lower", "upper")
            .agg(F.sum(F.when(_outside(method), F.col("cnt")).otherwise(0)).alias("anomaly_count"))
            .withColumn("anomaly_ratio", F.col("anomaly_count") / F.col("n_num")))


def anomaly_rows(df: DataFrame, source: str, ids: list[str], columns: list[str],
                 method: str = "iqr") -> DataFrame:
    """The offending rows: ids, column, value and reason."""
    b = bounds(materialize(numeric_values(cells(df, source, columns), drop_missing=False)), method)
    rows = cells(df, source, columns, ids).withColumn("x", tx.parse_number(F.col("value")))
    return (rows.join(F.broadcast(b), KEYS).filter(_outside(method))
            .select(*ids, "column", "x", F.lit(REASONS[method]).alias("reason")))
