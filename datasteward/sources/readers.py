"""Readers: CSV sources, whole databases, standards, reference lists, documents, schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasteward.functions import text as tx


def read_source_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text, quoted line breaks allowed, a BOM removed."""
    df = (spark.read.option("header", True).option("inferSchema", False).option("multiLine", True)
          .option("mode", "PERMISSIVE").option("escape", '"').option("encoding", "UTF-8").csv(path))
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_database(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Every table of a catalog database, ready for one combined profile."""
    db = database or spark.catalog.currentDatabase()
    return {t.name: spark.table(f"`{db}`.`{t.name}`") for t in spark.catalog.listTables(db) if t.tableType != "TEMPORARY"}


def read_jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, lower: int = 0, upper: int = 0,
                    parts: int = 1, **options: str) -> DataFrame:
    """One table of an external database, read in ``parts`` ranges of a numeric key."""
    r = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        r = r.options(partitionColumn=key, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return r.load()


def load_catalog(spark: SparkSession, path: str, standard_id: str) -> DataFrame:
    """(standard_id, code, label) of a standard from CSV (code,label) or JSON (object or list)."""
    if path.endswith(".json"):
        text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
        items = F.from_json("v", T.ArrayType(T.MapType(T.StringType(), T.StringType())))
        pairs = F.from_json("v", T.MapType(T.StringType(), T.StringType()))
        listed = (text.filter("v like '[%'").select(F.explode(items).alias("i"))
                  .select(F.col("i")["code"].alias("code"), F.coalesce(F.col("i")["label"], F.col("i")["name"]).alias("label")))
        keyed = text.filter("v like '{%'").select(F.explode(pairs).alias("code", "label"))
        rows = listed.unionByName(keyed)
    else:
        csv = read_source_csv(spark, path)
        label = F.col("label") if "label" in csv.columns else F.col("name")
        rows = csv.select(F.col("code"), label.alias("label"))
    return rows.select(F.lit(standard_id).alias("standard_id"), tx.strip(F.col("code")).alias("code"),
                       F.coalesce(tx.strip(F.col("label")), F.lit("")).alias("label")).filter("code <> ''")


def load_reference_lists(spark: SparkSession, path: str) -> DataFrame:
    """(list_name, value_norm): one list per CSV file (or folder of parts) below a folder, one value per line."""
    t = spark.read.text(path, pathGlobFilter="{*.csv,part-*}", recursiveFileLookup=True)
    t = t.filter(F.col("_metadata.file_path").rlike(r"\.csv(/part-[^/]*)?$"))
    t = t.select(_name_of_file().alias("list_name"), F.split("value", ",")[0].alias("v"))
    return normalized_lists(t.select("list_name", F.regexp_replace("v", '^"|"$', "").alias("value")))


def _name_of_file() -> Column:
    """The name of a file without its extension; of its folder if it is a part of a table that a job wrote."""
    file = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+?)(\.[^/.]*)?/part-[^/]*$", 1)
    name = F.when(folder != "", folder).otherwise(file)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))  # Spark gives paths with blanks and accents encoded


def normalized_lists(values: DataFrame) -> DataFrame:
    """Normalise (list_name, value) and drop blanks and repeats."""
    return (values.select("list_name", tx.normalize_text(F.col("value")).alias("value_norm"))
            .filter("value_norm <> ''").distinct())


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of whole text files, source = file name without extension."""
    t = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return documents_of(t, _name_of_file(), F.col("value"))


def documents_of(df: DataFrame, source: Column, text: Column) -> DataFrame:
    return df.select(source.alias("source"), text.alias("text"))


_TABLE = r'(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w."`]+)\s*\((.*?)\)\s*;'
_NOT_COLUMN = r"(?i)^(PRIMARY|FOREIGN|UNIQUE|CHECK|CONSTRAINT|KEY|INDEX)"
_COLUMN = r'^([\w"`\[\]]+)\s+(\w+(?:\s+\w+)*)\s*[(,]'


def schema_inventory(texts: DataFrame) -> DataFrame:
    """(source, table, column, data_type) of CREATE TABLE statements, one row per column."""
    bodies = texts.select("source", F.explode(F.expr(f"regexp_extract_all(text, r'{_TABLE}', 0)")).alias("ddl"))
    b = bodies.select("source", F.regexp_replace(F.regexp_extract("ddl", _TABLE, 1), '["`]', "").alias("table"), F.regexp_extract("ddl", _TABLE, 2).alias("body"))
    lines = b.select("source", "table", F.posexplode(F.split("body", "\n")).alias("position", "line"))
    line = lines.withColumn("line", F.concat(F.regexp_replace(tx.strip(F.col("line")), r",+$", ""), F.lit(",")))
    line = line.filter(~F.col("line").rlike(_NOT_COLUMN) & F.col("line").rlike(_COLUMN))
    return line.select("source", "table", F.regexp_replace(F.regexp_extract("line", _COLUMN, 1), r'["`\[\]]', "").alias("column"),
                       F.upper(F.regexp_extract("line", _COLUMN, 2)).alias("data_type"), "position")


def json_schema_inventory(texts: DataFrame) -> DataFrame:
    """(source, column, data_type, description, sample_values) of JSON Schema documents."""
    prop = T.StructType([T.StructField("type", T.StringType()), T.StructField("description", T.StringType()),
                         T.StructField("enum", T.ArrayType(T.StringType()))])
    doc = T.StructType([T.StructField("properties", T.MapType(T.StringType(), prop))])
    t = texts.select("source", F.explode(F.from_json("text", doc)["properties"]).alias("column", "p"))
    return t.select("source", "column", F.coalesce("p.type", F.lit("unknown")).alias("data_type"),
                    F.coalesce("p.description", F.lit("")).alias("description"), F.slice("p.enum", 1, 10).alias("sample_values"))
