"""Queries: readers, logs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F



from datasteward.operators.validate import DomainPack, FieldSchema, Rule
from datasteward.plans.base import Registry, table
from datasteward.plans.q_validate import _MEM
from datasteward.sources import lists, readers, shared, sinks
from datasteward.streaming import streams

R = Registry()


def _folder(spark, name):
    return f"{shared.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@R.add("a1_read_source_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def a1(spark, sf):
    path = _folder(spark, "csv")
    table(spark, sf, "documents").select("doc_id", "text", "lang").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return readers.read_source_csv(spark, path)


@R.add("a3_load_catalog", """SELECT 'NATIONS' AS standard_id, CAST(n_nationkey AS VARCHAR) AS code, n_name AS label FROM nation UNION ALL SELECT 'REGIONS', CAST(r_regionkey AS VARCHAR), r_name FROM region""")
def a3(spark, sf):
    a, b = _folder(spark, "codes"), _folder(spark, "regions") + ".json"
    table(spark, sf, "nation").select(F.concat(F.lit(" "), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("label")).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).csv(a)
    r = table(spark, sf, "region").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("r_regionkey").cast("string"), "r_name")))).alias("value"))
    r.write.text(b)
    return readers.load_catalog(spark, a, "NATIONS").unionByName(readers.load_catalog(spark, b, "REGIONS"))


@R.add("a4_load_reference_lists", """SELECT DISTINCT 'segments' AS list_name, lower(c_mktsegment) AS value_norm FROM customer UNION ALL SELECT DISTINCT 'names', lower(p_name) FROM part""")
def a4(spark, sf):
    path = _folder(spark, "lists")
    for name, df in (("segments", table(spark, sf, "customer").select("c_mktsegment")), ("names", table(spark, sf, "part").select("p_name"))):
        df.distinct().write.text(f"{path}/{name}.csv")
    return readers.load_reference_lists(spark, path)


@R.add("a8_schema_inventory", """SELECT 'c_' || c_custkey AS source, 't_' || c_nationkey AS "table", u."column", u.data_type FROM customer, LATERAL (VALUES ('id', 'INTEGER'), ('amount', 'DECIMAL'), ('seen at', 'x')) u("column", data_type) WHERE u."column" <> 'seen at'
UNION ALL SELECT 'c_' || c_custkey, 't_' || c_nationkey, 'seen', CASE WHEN c_mktsegment = 'BUILDING' THEN 'TIMESTAMP WITHOUT TIME ZONE' ELSE 'VARCHAR' END FROM customer""")
def a8(spark, sf):
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "timestamp without time zone").otherwise("varchar(20)")
    ddl = F.concat(F.lit('-- export\ncreate table if not exists "t_'), n, F.lit('" (\n  id integer,\n  "amount" Decimal(10,2) NOT NULL,\n  [seen] '), kind,
                   F.lit(",\n  PRIMARY KEY (id)\n);"))
    t = table(spark, sf, "customer").select(F.concat(F.lit("c_"), k).alias("source"), ddl.alias("text"))
    return readers.schema_inventory(t).select("source", "table", "column", "data_type")


@R.add("a8_json_schema_inventory", """SELECT 'p_' || p_partkey AS source, u."column", u.data_type, u.description, u.sample FROM part, LATERAL (VALUES (p_type, 'string', p_name, p_brand), ('size', 'unknown', '', NULL)) u("column", data_type, description, sample)""")
def a8b(spark, sf):
    doc = F.concat(F.lit('{"title":"x","properties":{"'), "p_type", F.lit('":{"type":"string","description":"'), "p_name", F.lit('","enum":["'), "p_brand", F.lit('"]},"size":{}}}'))
    t = table(spark, sf, "part").select(F.concat(F.lit("p_"), F.col("p_partkey").cast("string")).alias("source"), doc.alias("text"))
    return readers.json_schema_inventory(t).select("source", "column", "data_type", "description", F.array_join("sample_values", ",").alias("sample"))


@R.add("a9_append_log", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def a9(spark, sf):
    path = _folder(spark, "log")
    e = table(spark, sf, "events")
    for part in (e.filter("value >= 50"), e.filter("value < 50")):
        sinks.append_log(part, path, "ts")
    return spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


# built-in lists against a column that holds two of their spellings
@R.add("e10_builtin_lists", "SELECT CASE WHEN c_acctbal > 0 THEN 'genero_binario' ELSE 'dias_semana_es' END AS list_name, count(*) AS n FROM customer GROUP BY 1")
def e10b(spark, sf):
    from datasteward.functions import text as tx
    c = table(spark, sf, "customer").select(F.when(F.col("c_acctbal") > 0, " Masculino ").otherwise("Lunes").alias("v"))
    m = c.withColumn("value_norm", tx.normalize_text(F.col("v"))).join(lists.builtin_lists(spark), "value_norm")
    return m.groupBy("list_name").agg(F.count(F.lit(1)).alias("n"))


# --- streams ------------------------------------------------------------------------------

def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return streams.file_stream(spark, sf, schema, "events.parquet")


@R.add("k1_streaming_memory", f"WITH {_MEM} SELECT * FROM m2")
def k1(spark, sf):
    e = _stream(spark, sf)
    v = F.col("value")
    rows = e.select(F.col("event_type").alias("error_type"), F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")).alias("field_name"), F.lit("").alias("context"),
                    F.col("props").alias("corrected_value"), F.when(v > 60, True).when(v > 25, False).alias("accepted"), "ts")
    return streams.correction_memory_stream(rows)


EVENT_PACK = DomainPack("events", [FieldSchema("value", "float", True, max=200), FieldSchema("event_type", enum=["click", "view", "signup", "purchase"]), FieldSchema("props", pattern=r"\{.k.: [1-9]")],
                        [Rule("cheap_purchase", "event_type <> 'purchase' OR value >= 1", "warning", "value")])
_EV = """SELECT event_id, 'structural' AS layer, 'warning' AS severity, 'value' AS field_name, 'out_of_range' AS issue_type FROM events WHERE value > 200 UNION ALL SELECT event_id, 'structural', 'error', 'event_type', 'enum_invalid' FROM events WHERE event_type = 'error'
 UNION ALL SELECT event_id, 'structural', 'warning', 'props', 'pattern_mismatch' FROM events WHERE NOT regexp_matches(props, '^.."?k.: [1-9]') UNION ALL SELECT event_id, 'semantic', 'warning', 'value', 'cheap_purchase' FROM events WHERE event_type = 'purchase' AND value < 1"""


@R.add("k2_streaming_validation", _EV)
def k2(spark, sf):
    return streams.validate_stream(_stream(spark, sf), EVENT_PACK, ["event_id"])[0].select("event_id", "layer", "severity", "field_name", "issue_type")


@R.add("k2_streaming_scorecard", f"""WITH i AS ({_EV}), s AS (SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM i)
SELECT 0 AS batch, errors, warnings, greatest(0, 100 - 15 * errors - 5 * warnings) AS score, CASE WHEN greatest(0, 100 - 15 * errors - 5 * warnings) >= 80 THEN 'pass' WHEN greatest(0, 100 - 15 * errors - 5 * warnings) >= 50 THEN 'review' ELSE 'fail' END AS status FROM s""")
def k2b(spark, sf):
    return streams.validate_stream(_stream(spark, sf), EVENT_PACK, ["event_id"])[1]


GAP = 6 * 3600


@R.add("k3_heartbeat_gaps", f"""WITH g AS (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap_start, ts AS gap_end FROM events)
SELECT user_id, CAST(gap_start AS VARCHAR) AS gap_start, CAST(gap_end AS VARCHAR) AS gap_end FROM g WHERE epoch_us(gap_end) - epoch_us(gap_start) > {GAP}000000""")
def k3(spark, sf):
    g = streams.heartbeat_gaps(table(spark, sf, "events"), "user_id", GAP)
    return g.withColumns({c: F.col(c).cast("string") for c in ("gap_start", "gap_end")})


@R.add("k3_streaming_sessions", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL {GAP} SECOND THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), z AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS runs FROM s GROUP BY user_id, k)
SELECT user_id, CAST(a AS VARCHAR) AS start, CAST(b AS VARCHAR) AS last_run, runs FROM z WHERE b + INTERVAL {GAP} SECOND <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def k3b(spark, sf):
    s = streams.heartbeat_sessions_stream(_stream(spark, sf), "user_id", GAP)
    return s.withColumns({c: F.col(c).cast("string") for c in ("start", "last_run")})
