"""Similarity of columns by their values and of texts by their terms.

All column pairs are scored by one self-join of the value counts on the value (an
inverted index). A value occurs once per column there, so the fan-out per value is the
number of columns, however many rows hold it.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datasteward.functions import text as tx

PAIR = ["source_a", "column_a", "source_b", "column_b"]


def column_pairs(spark: SparkSession, columns: list[tuple[str, str]],
                 others: list[tuple[str, str]] | None = None) -> DataFrame:
    """The list of (source, column) pairs to score: metadata, one row per pair."""
    pairs = combinations(columns, 2) if others is None else product(columns, others)
    rows = [(*a, *b) for a, b in pairs]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in PAIR))


def column_sizes(vf: DataFrame) -> DataFrame:
    """Rows, distinct values and vector length of each column of value counts."""
    c = F.col("cnt").cast("double")
    return vf.groupBy("source", "column").agg(
        F.sum("cnt").alias("rows"), F.count(F.lit(1)).alias("distinct"),
        F.sqrt(F.sum(c * c)).alias("norm"))


def _side(df: DataFrame, s: str, extra: list[str]) -> DataFrame:
    return df.select(F.col("source").alias(f"source_{s}"), F.col("column").alias(f"column_{s}"),
                     *[F.col(e).alias(f"{e}_{s}") for e in extra])


def shared_values(vf: DataFrame, pairs: DataFrame, vf_b: DataFrame | None = None) -> DataFrame:
    """Per pair: number of shared values, dot product and chi-square part of shared values."""
    sizes = F.broadcast(column_sizes(vf if vf_b is None else vf.unionByName(vf_b))
                        .select("source", "column", F.col("rows").alias("n")))
    a = vf.join(sizes, ["source", "column"])
    b = a if vf_b is None else vf_b.join(sizes, ["source", "column"])
    a = a.select(
        F.col("source").alias("source_a"), F.col("column").alias("column_a"), "value",
        F.col("cnt").cast("double").alias("ca"), F.col("n").cast("double").alias("na"))
    b = b.select(F.col("source").alias("source_b"), F.col("column").alias("column_b"), "value",
                 F.col("cnt").cast("double").alias("cb"), F.col("n").cast("double").alias("nb"))
    m = a.join(b, "value").join(F.broadcast(pairs), PAIR, "left_semi")
    ca, cb, na, nb = (F.col(c) for c in ("ca", "cb", "na", "nb"))
    ea, eb = (ca + cb) * na / (na + nb), (ca + cb) * nb / (na + nb)
    return m.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("shared"), F.sum(ca * cb).alias("dot"),
        F.sum("ca").alias("rows_in_a"), F.sum("cb").alias("rows_in_b"),
        F.sum((ca - ea) * (ca - ea) / ea + (cb - eb) * (cb - eb) / eb).alias("chi_shared"))


def value_similarity(vf: DataFrame, pairs: DataFrame, vf_b: DataFrame | None = None) -> DataFrame:
    """Cosine, Jaccard, overlap and containment per pair; pairs without a shared value score 0.

    ``vf`` holds upper-case keys without blanks (``value_counts(cells, 'upper')``).
    """
    sizes = column_sizes(vf if vf_b is None else vf.unionByName(vf_b))
    extra = ["rows", "distinct", "norm"]
    p = (pairs.join(F.broadcast(_side(sizes, "a", extra)), PAIR[:2], "left")
         .join(F.broadcast(_side(sizes, "b", extra)), PAIR[2:], "left")
         .join(F.broadcast(shared_values(vf, pairs, vf_b)), PAIR, "left"))
    zero = F.lit(0.0)
    shared = F.coalesce(F.col("shared"), F.lit(0))
    da, db = F.col("distinct_a"), F.col("distinct_b")
    both = da.isNotNull() & db.isNotNull()
    na, nb, n = F.col("rows_a"), F.col("rows_b"), F.col("rows_a") + F.col("rows_b")
    # a category found on one side only adds its count times (rows of the other / own rows)
    chi2 = (F.coalesce(F.col("chi_shared"), zero)
            + (na - F.coalesce(F.col("rows_in_a"), zero)) * nb / na
            + (nb - F.coalesce(F.col("rows_in_b"), zero)) * na / nb)
    cats = F.coalesce(da, F.lit(0)) + F.coalesce(db, F.lit(0)) - shared
    return p.select(
        *PAIR, shared.alias("shared"),
        F.when(both, F.coalesce(F.col("dot"), zero) / (F.col("norm_a") * F.col("norm_b")))
        .otherwise(zero).alias("cosine"),
        F.when(both, shared / (da + db - shared)).otherwise(zero).alias("jaccard"),
        F.when(both, shared / F.least(da, db)).otherwise(zero).alias("overlap"),
        F.when(both, shared / da).otherwise(zero).alias("containment"),
        F.when(both & (cats >= 2), chi2).otherwise(zero).alias("chi2"),
        F.when(both & (cats >= 2), cats - 1).otherwise(F.lit(0)).alias("chi_df"))


def text_tfidf(pairs: DataFrame, ids: list[str], text_a: str = "text_a", text_b: str = "text_b") -> DataFrame:
    """Cosine of the TF-IDF vectors of two texts per row; the two texts are the corpus."""
    def terms(c: str, ca: int, cb: int) -> DataFrame:
        return pairs.select(*ids, F.explode(tx.tokenize(F.col(c))).alias("term"),
                            F.lit(ca).alias("a"), F.lit(cb).alias("b"))

    tf = (terms(text_a, 1, 0).unionByName(terms(text_b, 0, 1))
          .groupBy(*ids, "term").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b")))
    # two documents: df is 2 for a shared term, else 1. The token totals cancel in the cosine.
    idf = F.when((F.col("a") > 0) & (F.col("b") > 0), F.lit(1.0)).otherwise(F.log(F.lit(1.5)) + 1)
    wa, wb = F.col("a") * idf, F.col("b") * idf
    s = tf.groupBy(*ids).agg(F.sum(wa * wb).alias("_d"), F.sqrt(F.sum(wa * wa)).alias("_na"),
                             F.sqrt(F.sum(wb * wb)).alias("_nb"))
    score = F.when((F.col("_na") > 0) & (F.col("_nb") > 0), F.col("_d") / (F.col("_na") * F.col("_nb"))).otherwise(0.0)
    return pairs.select(*ids).join(s.select(*ids, score.alias("tfidf")), ids, "left").fillna({"tfidf": 0.0})


def verdict(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def composite_similarity(scores: DataFrame, tfidf: DataFrame) -> DataFrame:
    """Blend of value scores (70 %) and text score (30 %) per pair."""
    t = scores.join(F.broadcast(tfidf), PAIR, "left").fillna({"tfidf": 0.0})
    comp = (F.col("cosine") + F.col("jaccard") + F.col("overlap")) / 3.0 * 0.7 + F.col("tfidf") * 0.3
    return t.select(*PAIR, "cosine", "jaccard", "overlap", "tfidf", comp.alias("composite"),
                    verdict(comp).alias("verdict"))


def value_equivalence(values_a: DataFrame, values_b: DataFrame, key: str = "value") -> DataFrame:
    """Full comparison of two sets of distinct values: matched, only_a, only_b."""
    def keyed(df: DataFrame, s: str) -> DataFrame:
        v = df.select(F.col(key).alias("v")).filter(~tx.is_missing(F.col("v")))
        return v.groupBy(F.upper(tx.strip(F.col("v"))).alias("key")).agg(F.min(tx.strip(F.col("v"))).alias(f"value_{s}"))

    j = keyed(values_a, "a").join(keyed(values_b, "b"), "key", "full_outer")
    status = (F.when(F.col("value_a").isNull(), "only_b").when(F.col("value_b").isNull(), "only_a")
              .otherwise("matched"))
    return j.withColumn("status", status)


def equivalence_edges(matched: DataFrame, field_a: str, field_b: str, confidence: float = 1.0) -> DataFrame:
    """One equivalence row per matched value, ready to be kept as a mapping of two fields."""
    return matched.filter(F.col("status") == "matched").select(
        F.lit(field_a).alias("src"), F.lit(field_b).alias("dst"), F.lit("equivalente_a").alias("type"),
        F.col("value_a").alias("value_src"), F.col("value_b").alias("value_dst"),
        F.lit(confidence).alias("confidence"))
