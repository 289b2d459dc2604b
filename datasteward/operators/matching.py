"""Matching of the columns of two datasets by values and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasteward.functions import text as tx
from datasteward.functions.pvalues import chi2_p_value, t_p_value
from datasteward.operators.cells import cells, value_counts
from datasteward.operators.profile import KEYS
from datasteward.operators.similarity import PAIR, column_pairs, value_similarity, verdict
from datasteward.operators.stats import welch_columns
from datasteward.sources.shared import materialize

# Names of row identifiers that are not matched.
ID_NAMES = {"id", "id_paciente", "index"}


def column_moments(raw_counts: DataFrame) -> DataFrame:
    """Rows, parsed numbers, mean and variance per column of raw value counts."""
    v = raw_counts.withColumn("x", tx.parse_number(F.col("value")))
    m = v.groupBy(*KEYS).agg(
        F.sum("cnt").alias("rows"), F.sum(F.when(F.col("x").isNotNull(), F.col("cnt")).otherwise(0)).alias("nums"),
        (F.sum(F.col("x") * F.col("cnt")) / F.sum(F.when(F.col("x").isNotNull(), F.col("cnt")))).alias("mean"))
    d = F.col("x") - F.col("mean")
    ss = (v.filter("x is not null").join(F.broadcast(m.select(*KEYS, "mean")), KEYS)
          .groupBy(*KEYS).agg(F.sum(d * d * F.col("cnt")).alias("ss")))
    return (m.join(F.broadcast(ss), KEYS, "left")
            .withColumn("var", F.when(F.col("nums") > 1, F.col("ss") / (F.col("nums") - 1)).otherwise(0.0)).drop("ss"))


def _pair_moments(pairs: DataFrame, moments: DataFrame) -> DataFrame:
    out = pairs
    for s in "ab":
        side = moments.select(F.col("source").alias(f"source_{s}"), F.col("column").alias(f"column_{s}"),
                              *[F.col(c).alias(f"{c}_{s}") for c in ("rows", "nums", "mean", "var")])
        out = out.join(F.broadcast(side), [f"source_{s}", f"column_{s}"], "left")
    return out


def compare_distributions(raw_counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Welch test when both columns are over 80 % numbers, else chi-square, for every pair."""
    key_counts = (raw_counts.filter(~tx.is_blank(F.col("value")))
                  .groupBy(*KEYS, tx.value_key(F.col("value")).alias("value")).agg(F.sum("cnt").alias("cnt")))
    sims = value_similarity(key_counts, pairs)
    t = _pair_moments(sims, column_moments(raw_counts))
    numeric = (F.col("nums_a") > F.col("rows_a") * 0.8) & (F.col("nums_b") > F.col("rows_b") * 0.8)
    cols = welch_columns(*(F.col(c) for c in ("nums_a", "mean_a", "var_a", "nums_b", "mean_b", "var_b")))
    t = t.withColumns(cols).withColumn("test", F.when(
        numeric & (F.col("nums_a") >= 3) & (F.col("nums_b") >= 3), "welch").otherwise("chi_square"))
    p = F.when(F.col("test") == "welch", t_p_value(F.col("t_stat").cast("double"), F.col("t_df").cast("double"))).otherwise(
        chi2_p_value(F.col("chi2").cast("double"), F.col("chi_df").cast("double")))
    return t.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 0.05)


def auto_match(df_a: DataFrame, source_a: str, df_b: DataFrame, source_b: str) -> DataFrame:
    """Score every pair of columns of two datasets and put it in a confidence bucket."""
    raw = materialize(value_counts(cells(df_a, source_a).unionByName(cells(df_b, source_b))))
    names = [[c for c in df.columns if c.lower() not in ID_NAMES] for df in (df_a, df_b)]
    pairs = column_pairs(df_a.sparkSession, [(source_a, c) for c in names[0]], [(source_b, c) for c in names[1]])
    t = compare_distributions(raw, pairs)
    agree = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.abs("t_stat") / 10.0))
    stat = F.when(F.col("significant"), 0.0).when(F.col("test") == "welch", agree).otherwise(0.7)
    conf = F.col("cosine") * 0.4 + F.col("jaccard") * 0.3 + stat * 0.3
    return t.select(*PAIR, "cosine", "jaccard", stat.alias("stat_score"), conf.alias("confidence"),
                    verdict(conf).alias("bucket"))
