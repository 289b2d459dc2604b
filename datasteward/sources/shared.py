"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}  # application: the folder made for a local master without the setting


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="datasteward-")
        _OWN[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write once, read many: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._datasteward_table = True
    return out


def is_materialized(df: DataFrame) -> bool:
    """True for a plain read of a table that ``materialize`` wrote."""
    return getattr(df, "_datasteward_table", False)
