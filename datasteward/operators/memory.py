"""Memory of corrections: what users accepted or rejected decides what is applied next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasteward.functions import text as tx

PROMOTE_AT = 5  # acceptances after which a correction is applied without asking


def signatures(events: DataFrame) -> DataFrame:
    return events.withColumn("signature", tx.error_signature(F.col("error_type"), F.col("field_name"), F.col("context")))


def correction_memory(events: DataFrame) -> DataFrame:
    """State per signature from (error_type, field_name, context, corrected_value, accepted, ts).

    Every event counts; the last answer that is not null decides; the value of the first
    event is kept. All aggregates combine map-side.
    """
    e = events if "signature" in events.columns else signatures(events)
    m = e.groupBy("signature").agg(
        F.first("error_type", True).alias("error_type"), F.first("field_name", True).alias("field_name"),
        F.min_by("corrected_value", "ts").alias("corrected_value"), F.count(F.lit(1)).alias("count"),
        F.max_by("accepted", F.when(F.col("accepted").isNotNull(), F.col("ts"))).alias("accepted"))
    auto = F.coalesce(F.col("accepted"), F.lit(False)) & (F.col("count") >= PROMOTE_AT)
    return m.withColumns({"auto_rule": auto, "skip": F.coalesce(~F.col("accepted"), F.lit(False))})


def memory_stats(memory: DataFrame) -> DataFrame:
    def n(c):
        return F.sum(c.cast("long"))
    return memory.agg(F.count(F.lit(1)).alias("total_corrections"), n(F.coalesce("accepted", F.lit(False))).alias("accepted"),
                      n(F.col("skip")).alias("rejected"), n(F.col("accepted").isNull()).alias("pending"),
                      n(F.col("auto_rule")).alias("auto_rules"))


def decide(issues: DataFrame, memory: DataFrame) -> DataFrame:
    """Status of every issue: auto, skipped, ask (warnings) or open (errors)."""
    i = issues if "signature" in issues.columns else signatures(
        issues.withColumnRenamed("issue_type", "error_type")).withColumnRenamed("error_type", "issue_type")
    m = memory.select("signature", F.col("corrected_value").alias("memory_value"), "auto_rule", "skip")
    j = i.join(m, "signature", "left")
    status = (F.when(F.coalesce("auto_rule", F.lit(False)), "auto").when(F.coalesce("skip", F.lit(False)), "skipped")
              .when(F.col("severity") == "warning", "ask").otherwise("open"))
    return j.withColumn("status", status)


def apply_corrections(df: DataFrame, decided: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """Rewrite the values of the fields that have an automatic correction."""
    auto = decided.filter("status = 'auto'")
    fix = auto.groupBy(*ids).agg(*[
        F.max(F.when(F.col("field_name") == f, F.col("memory_value"))).alias(f"_fix_{f}") for f in fields])
    out = df.join(fix, ids, "left")
    types = dict(df.dtypes)
    return out.select(*[
        (F.coalesce(F.col(f"_fix_{c}").try_cast(types[c]), F.col(c)).alias(c) if c in fields else F.col(c)) for c in df.columns],
        F.coalesce(*[F.col(f"_fix_{f}") for f in fields]).isNotNull().alias("corrected"))


def questions(decided: DataFrame, ids: list[str]) -> DataFrame:
    return decided.filter("status = 'ask'").select(*ids, "field_name", "issue_type", "suggested_value")


def answers_to_events(answers: DataFrame) -> DataFrame:
    """Answers (field_name, answer, corrected_value, context, ts) as correction events."""
    yes = F.lower("answer").isin("yes", "si", "s", "y", "true", "1", "accept")
    return answers.filter(F.col("answer").isNotNull()).select(
        F.lit("warning").alias("error_type"), "field_name", "context", "corrected_value", yes.alias("accepted"), "ts")
