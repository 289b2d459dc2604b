"""Logs written by runs that may be repeated."""

import pytest
from pyspark.sql import functions as F

from datasteward.sources.sinks import append_log


@pytest.mark.parametrize("day", [None, "ts"])
def test_a_repeated_run_counts_once(spark, tmp_path, day):
    path = str(tmp_path / "log")
    rows = spark.range(50).withColumn("ts", F.timestamp_seconds(F.col("id") * 7200))
    append_log(rows, path, day, run_id="r-1")
    append_log(rows.filter("id < 10"), path, day, run_id="r-2")
    before = sorted(tuple(r) for r in spark.read.parquet(path).select("id", "ts", "run").collect())
    append_log(rows, path, day, run_id="r-1")
    assert before == sorted(tuple(r) for r in spark.read.parquet(path).select("id", "ts", "run").collect())
    append_log(rows.filter("id >= 45"), path, day, run_id="r-1")  # fewer days than before: the others of this run go too
    assert spark.read.parquet(path).groupBy("run").count().collect() and spark.read.parquet(path).count() == 15
    append_log(rows.limit(0), path, day, run_id="r-3")
    assert spark.read.schema("id long, ts timestamp, run string").parquet(path).count() == 15


def test_ids_stay_inside_the_log(spark, tmp_path):
    for wrong in ("", "a/b", "../x", "a b"):
        with pytest.raises(ValueError):
            append_log(spark.range(1), str(tmp_path / "log"), run_id=wrong)


def test_without_an_id_rows_are_added(spark, tmp_path):
    for _ in range(2):
        append_log(spark.range(3), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
