"""Writers: the catalog graph, append-only logs, and exports."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datasteward.sources.shared import shared_dir


def write_graph(nodes: DataFrame, edges: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write nodes and edges split by type, so a query on one type reads only its files."""
    spark = nodes.sparkSession
    path = path or f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").partitionBy("type").parquet(f"{path}/{name}")
    return read_graph(spark, path, nodes.schema, edges.schema)


def read_graph(spark: SparkSession, path: str, nodes_schema=None, edges_schema=None) -> tuple[DataFrame, DataFrame]:
    def read(name, schema):
        r = spark.read.schema(schema) if schema else spark.read
        return r.parquet(f"{path}/{name}")
    return read("nodes", nodes_schema), read("edges", edges_schema)


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One compressed JSON line per node and edge; names and id prefixes come again on every line."""
    nodes.write.mode("overwrite").option("compression", "gzip").json(f"{path}/nodes")
    edges.write.mode("overwrite").option("compression", "gzip").json(f"{path}/edges")


def read_graph_json(spark: SparkSession, path: str, nodes_schema, edges_schema) -> tuple[DataFrame, DataFrame]:
    return (spark.read.schema(nodes_schema).json(f"{path}/nodes"),
            spark.read.schema(edges_schema).json(f"{path}/edges"))


def append_log(df: DataFrame, path: str, day_column: str | None = None, run_id: str | None = None) -> None:
    """Append to an event, run or version log; split by day when a timestamp is given.

    With ``run_id`` the rows are the files of that run alone (a column ``run`` when the log is read): a job that is
    repeated under its id replaces what it wrote and counts once. One log is written either with ids or without."""
    if run_id is not None and not re.fullmatch(r"[\w-]+", run_id):
        raise ValueError("run_id takes letters, digits, _ and - only")
    out = df.withColumn("day", F.to_date(day_column)) if day_column else df
    w = out.write.mode("append") if run_id is None else out.write.mode("overwrite")
    w = w.partitionBy("day") if day_column else w
    w.parquet(path if run_id is None else f"{path}/run={run_id}")
