"""Streaming forms of correction memory, validation and heartbeat checks.

Every stream writes each micro-batch to its own folder, so a batch that runs again after
a failure replaces its own output and nothing else.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasteward.functions import text as tx
from datasteward.operators import validate as vd
from datasteward.operators.memory import PROMOTE_AT
from datasteward.sources.shared import shared_dir


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None, files_per_batch: int = 100) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(folder)


def _work(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _run(df: DataFrame, mode: str, work: str, each) -> None:
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{work}/checkpoint")
         .foreachBatch(each).trigger(availableNow=True).start())
    q.awaitTermination()


def correction_memory_stream(events: DataFrame, work: str | None = None) -> DataFrame:
    """State per signature after all available events; equals the batch form on the same input.

    The state is a streaming aggregate of a fixed size per signature. Each batch writes the
    signatures it changed; the newest row of a signature is its state.
    """
    spark = events.sparkSession
    work = work or _work(spark)
    s = events.withColumn("signature", tx.error_signature(F.col("error_type"), F.col("field_name"), F.col("context")))
    answered = F.when(F.col("accepted").isNotNull(), F.col("ts"))
    state = s.groupBy("signature").agg(
        F.first("error_type", True).alias("error_type"), F.first("field_name", True).alias("field_name"),
        F.min_by("corrected_value", "ts").alias("corrected_value"), F.count(F.lit(1)).alias("count"), F.max_by("accepted", answered).alias("accepted"))

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/state/batch={number}")

    _run(state, "update", work, each)
    out = spark.read.schema(T.StructType([*state.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{work}/state")
    cols = [c for c in state.columns if c != "signature"]
    last = out.groupBy("signature").agg(F.max_by(F.struct(*cols), "batch").alias("r")).select("signature", "r.*")
    auto = F.coalesce(F.col("accepted"), F.lit(False)) & (F.col("count") >= PROMOTE_AT)
    return last.withColumns({"auto_rule": auto, "skip": F.coalesce(~F.col("accepted"), F.lit(False))})


def validate_stream(rows: DataFrame, pack: vd.DomainPack, ids: list[str], work: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(issues, scorecard per micro-batch) of all available rows."""
    spark = rows.sparkSession
    work = work or _work(spark)

    def each(batch: DataFrame, number: int) -> None:
        issues = vd.validate(batch, pack, ids).withColumn("batch", F.lit(number))
        issues.write.mode("overwrite").parquet(f"{work}/issues/n={number}")

    _run(rows, "append", work, each)
    id_fields = [rows.schema[i] for i in ids]
    text = [T.StructField(c, T.StringType()) for c in ("layer", "severity", "field_name", "issue_type", "original_value", "suggested_value")]
    schema = T.StructType([*id_fields, *text, T.StructField("batch", T.IntegerType())])
    issues = spark.read.schema(schema).parquet(f"{work}/issues")
    return issues, vd.scorecard(issues, ["batch"])


def heartbeat_gaps(runs: DataFrame, key: str, gap_seconds: int, ts: str = "ts", now=None) -> DataFrame:
    """(key, gap_start, gap_end) of all silences longer than the limit.

    With ``now``, a timestamp, the silence of a key whose log has stopped is a gap that ends there.

    Two runs in the same slot of ``gap_seconds`` are never too far apart, so the log is first
    reduced to the first and last run per slot; only those rows are ordered per key.
    """

    sec = F.unix_micros(F.col(ts).cast("timestamp"))
    slots = runs.groupBy(key, F.floor(sec / (gap_seconds * 1_000_000)).alias("slot")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    w = Window.partitionBy(key).orderBy("slot")
    t = slots.withColumn("gap_start", F.lag("last").over(w))
    long = F.unix_micros(F.col("first").cast("timestamp")) - F.unix_micros(F.col("gap_start").cast("timestamp")) > gap_seconds * 1_000_000
    gaps = t.filter(long).select(key, "gap_start", F.col("first").alias("gap_end"))
    if now is None:
        return gaps
    end = F.lit(now).cast("timestamp")
    stopped = slots.groupBy(key).agg(F.max("last").alias("gap_start"))
    late = F.unix_micros(end) - F.unix_micros(F.col("gap_start").cast("timestamp")) > gap_seconds * 1_000_000
    return gaps.unionAll(stopped.filter(late).select(key, "gap_start", end.cast(gaps.schema["gap_end"].dataType).alias("gap_end")))


def heartbeat_sessions_stream(runs: DataFrame, key: str, gap_seconds: int, delay: str = "1 hour", ts: str = "ts", work: str | None = None) -> DataFrame:
    """Closed sessions (key, start, last_run, runs) of a run log; a session closes when the
    log of its key was silent for the limit and the watermark has passed its end."""
    spark = runs.sparkSession
    work = work or _work(spark)
    s = (runs.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", delay)
         .groupBy(F.session_window("event_time", f"{gap_seconds} seconds").alias("w"), key)
         .agg(F.count(F.lit(1)).alias("runs"), F.min("event_time").alias("start"), F.max("event_time").alias("last_run")))
    s = s.select(key, "start", "last_run", "runs")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/sessions/n={number}")

    _run(s, "append", work, each)
    return spark.read.schema(s.schema).parquet(f"{work}/sessions").select(*s.columns)
