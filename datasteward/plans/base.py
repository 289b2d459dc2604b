"""Shared inputs of the queries and small SQL fragments for their independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "pages", "benchmark", "labels", "conversations"]

# columns per table; 'd' marks floating point, which is compared with four decimals
COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal:d c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal:d",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice:d",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:d o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:d l_extendedprice:d "
                "l_discount:d l_tax:d l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value:d props",
    "documents": "doc_id text lang source n_chars",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


# --- the derived table with dirty values --------------------------------------------------

def dirty(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    blanks = F.array(*[F.lit(x) for x in ("", "  ", "NA", "n/a", "null", "None")])
    dirty_name = (
        F.when(k % 11 == 0, F.lit(None).cast("string"))
        .when(k % 13 == 0, F.get(blanks, (F.floor(k / 13) % 6).cast("int")))
        .when(k % 7 == 0, F.concat(F.lit("  "), name, F.lit("\t")))
        .when(k % 5 == 0, F.replace(name, F.lit(" "), F.lit("  ")))
        .when(k % 3 == 0, F.upper(name))
        .when(k % 17 == 0, F.concat(name, F.lit(" a~o")))
        .when(k % 19 == 0, F.concat(name, F.lit("Ã±")))
        .otherwise(name))
    size = F.col("p_size").cast("string")
    dirty_number = (F.when(k % 251 == 0, "100000").when(k % 103 == 1, "nan")
                    .when(k % 101 == 1, "1.5d").when(k % 10 == 0, "x").otherwise(size))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 366).cast("int"))
    dirty_date = F.when(k % 4 == 0, F.date_format(day, "dd/MM/yyyy")).otherwise(day.cast("string"))
    return table(spark, sf, "part").select(
        "p_partkey", dirty_name.alias("dirty_name"), dirty_number.alias("dirty_number"),
        dirty_date.alias("dirty_date"))


DIRTY_SQL = """dirty AS (
  SELECT p_partkey,
    CASE WHEN p_partkey % 11 = 0 THEN NULL
         WHEN p_partkey % 13 = 0 THEN ['', '  ', 'NA', 'n/a', 'null', 'None'][1 + (p_partkey // 13) % 6]
         WHEN p_partkey % 7 = 0 THEN '  ' || p_name || chr(9)
         WHEN p_partkey % 5 = 0 THEN replace(p_name, ' ', '  ')
         WHEN p_partkey % 3 = 0 THEN upper(p_name)
         WHEN p_partkey % 17 = 0 THEN p_name || ' a~o'
         WHEN p_partkey % 19 = 0 THEN p_name || chr(195) || chr(177)
         ELSE p_name END AS dirty_name,
    CASE WHEN p_partkey % 251 = 0 THEN '100000' WHEN p_partkey % 103 = 1 THEN 'nan'
         WHEN p_partkey % 101 = 1 THEN '1.5d' WHEN p_partkey % 10 = 0 THEN 'x'
         ELSE CAST(p_size AS VARCHAR) END AS dirty_number,
    CASE WHEN p_partkey % 4 = 0
         THEN strftime(DATE '2024-01-01' + CAST(p_partkey % 366 AS INTEGER), '%d/%m/%Y')
         ELSE strftime(DATE '2024-01-01' + CAST(p_partkey % 366 AS INTEGER), '%Y-%m-%d') END AS dirty_date
  FROM part)"""


# --- SQL fragments ------------------------------------------------------------------------

def q_strip(v: str) -> str:
    return rf"regexp_replace({v}, '^\s+|\s+$', '', 'g')"


def q_missing(v: str, extended: bool = False) -> str:
    words = "'', 'na', 'n/a', 'null', 'none'" + (", 'nan', '-'" if extended else "")
    return f"({v} IS NULL OR lower({q_strip(v)}) IN ({words}))"


def q_num(v: str) -> str:
    s = q_strip(v)
    return (rf"(CASE WHEN regexp_matches({s}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') "
            rf"THEN TRY_CAST({s} AS DOUBLE) END)")


def q_grade(s: str) -> str:
    return (f"CASE WHEN {s} >= 90 THEN 'A' WHEN {s} >= 80 THEN 'B' WHEN {s} >= 70 THEN 'C' "
            f"WHEN {s} >= 60 THEN 'D' ELSE 'F' END")


def q_cells(*tables: str, only: dict[str, list[str]] | None = None) -> str:
    """A CTE body with (source, column, value), one SELECT per column."""
    parts = []
    for t in tables:
        spec = ("p_partkey dirty_name dirty_number dirty_date" if t == "dirty" else COLUMNS[t])
        for item in spec.split():
            name, _, kind = item.partition(":")
            if only and t in only and name not in only[t]:
                continue
            v = f"CAST({name} AS DECIMAL(38,4))" if kind else name
            parts.append(f"SELECT '{t}' AS source, '{name}' AS \"column\", CAST({v} AS VARCHAR) AS value FROM {t}")
    return "cells AS (" + "\n UNION ALL ".join(parts) + ")"


class Registry:
    """Collects the queries of one module and their SQL."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def deco(fn):
            self.queries[name] = fn
            if sql:
                self.sql[name] = sql
            return fn
        return deco
