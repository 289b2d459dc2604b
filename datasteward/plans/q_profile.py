"""Queries: profiling, quality, anomalies, cleaning and scalar functions."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import functions as F

from datasteward.functions import text as tx
from datasteward.operators import anomalies, clean, profile, profile_states
from datasteward.operators.cells import cells_of, column_names
from datasteward.plans.base import (COLUMNS, DIRTY_SQL, TABLES, Registry, dirty, q_cells, q_grade, q_missing,
                                    q_num, q_strip, r6, table)
from datasteward.sources import readers
from datasteward.sources.shared import shared_dir

R = Registry()


def _cells(spark, sf, *names):
    return cells_of({n: dirty(spark, sf) if n == "dirty" else table(spark, sf, n) for n in names})


# --- scalar functions ---------------------------------------------------------------------

@R.add("b1_is_missing", f"""WITH {DIRTY_SQL}
SELECT p_partkey, {q_missing('dirty_name')} AS missing, {q_missing('dirty_number', True)} AS missing_ext FROM dirty""")
def b1(spark, sf):
    return dirty(spark, sf).select("p_partkey", tx.is_missing(F.col("dirty_name")).alias("missing"),
                                   tx.is_missing(F.col("dirty_number"), True).alias("missing_ext"))


@R.add("b2_value_key", f"""WITH {DIRTY_SQL}
SELECT p_partkey, upper({q_strip('dirty_name')}) AS key_upper, lower({q_strip('dirty_name')}) AS key_lower FROM dirty""")
def b2(spark, sf):
    v = F.col("dirty_name")
    return dirty(spark, sf).select("p_partkey", tx.value_key(v).alias("key_upper"),
                                   tx.value_key(v, "lower").alias("key_lower"))


@R.add("b3_normalize_text", """
SELECT doc_id, regexp_replace(strip_accents(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))), '\\s+', ' ', 'g')
  AS normalized FROM documents""")
def b3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("normalized"))


# letters with marks of many languages in place of plain ones, one of them with a combining mark, and letters without any
@R.add("b3_fold_letters", """
SELECT p_partkey, strip_accents(lower(replace(translate(p_name, 'scoanzit', 'şčőăńžįť'), 'e', 'e' || chr(769)) || ' łøđ')) AS normalized FROM part""")
def b3_letters(spark, sf):
    marked = F.replace(F.translate("p_name", "scoanzit", "şčőăńžįť"), F.lit("e"), F.lit("e\u0301"))
    return table(spark, sf, "part").select("p_partkey", tx.normalize_text(F.concat(marked, F.lit(" łøđ"))).alias("normalized"))


@R.add("b4_parse_number", f"""WITH {DIRTY_SQL}
SELECT p_partkey, {q_num('dirty_number')} AS number, {q_num('dirty_name')} AS name_number FROM dirty""")
def b4(spark, sf):
    return dirty(spark, sf).select("p_partkey", tx.parse_number(F.col("dirty_number")).alias("number"),
                                   tx.parse_number(F.col("dirty_name")).alias("name_number"))


# names derived from the data: prefix, camel case and separators around the order priority and brand
@R.add("b5_clean_column_name", """
WITH names AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'col_' WHEN 'O' THEN 'CAMPO_' ELSE 'fechaA' END
    || o_orderpriority || ' ' || o_orderstatus || 'n' AS raw FROM orders),
a AS (SELECT o_orderkey, raw, regexp_replace(trim(raw), '(?i)^(col_|campo_|fld_|f_|c_|var_)', '') AS n FROM names),
b AS (SELECT o_orderkey, raw, lower(regexp_replace(n, '([A-Z])', '_\\1', 'g')) AS n FROM a),
c AS (SELECT o_orderkey, raw, regexp_replace(regexp_replace(n, '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g') AS n FROM b)
SELECT o_orderkey, raw, trim(n, '_') AS cleaned FROM c""")
def b5(spark, sf):
    s = F.col("o_orderstatus")
    raw = F.concat(F.when(s == "F", "col_").when(s == "O", "CAMPO_").otherwise("fechaA"),
                   F.col("o_orderpriority"), F.lit(" "), s, F.lit("n"))
    return table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"),
                                             tx.clean_column_name(raw).alias("cleaned"))


@R.add("b6_fix_encoding", f"""WITH {DIRTY_SQL}
SELECT p_partkey, replace(replace(dirty_name, 'a~o', 'ano'), chr(195) || chr(177), 'n') AS fixed FROM dirty""")
def b6(spark, sf):
    return dirty(spark, sf).select("p_partkey", tx.fix_encoding(F.col("dirty_name")).alias("fixed"))


@R.add("b7_auto_clean", f"""WITH {DIRTY_SQL},
a AS (SELECT p_partkey, dirty_name AS o, replace(replace(dirty_name, 'a~o', 'ano'), chr(195) || chr(177), 'n') AS e FROM dirty),
b AS (SELECT *, {q_strip('e')} AS s FROM a)
SELECT p_partkey, 'dirty_name' AS "column", coalesce(o, '') AS original,
  coalesce(regexp_replace(s, '\\s+', ' ', 'g'), '') AS cleaned,
  concat_ws(',', CASE WHEN o IS NULL THEN 'null_to_empty' END, CASE WHEN e <> o THEN 'encoding' END,
    CASE WHEN s <> e THEN 'whitespace' END, CASE WHEN regexp_matches(s, '\\s\\s') THEN 'multiple_spaces' END) AS fixes
FROM b WHERE o IS NULL OR e <> o OR s <> e OR regexp_matches(s, '\\s\\s')""")
def b7(spark, sf):
    log = clean.change_log(dirty(spark, sf), ["p_partkey"], ["dirty_name"])
    return log.withColumn("fixes", F.array_join("fixes", ","))


@R.add("b8_value_type_flags", f"""WITH {DIRTY_SQL}, v AS (
  SELECT p_partkey, u.* FROM dirty, LATERAL (SELECT 'name' AS c, dirty_name AS v UNION ALL SELECT 'number', dirty_number
    UNION ALL SELECT 'date', dirty_date) u)
SELECT p_partkey, c AS "column", regexp_matches({q_strip('v')}, '^[+-]?\\d+$') AS is_int,
 regexp_matches({q_strip('v')}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') AS is_float,
 regexp_matches({q_strip('v')}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') AS is_iso_date,
 regexp_matches({q_strip('v')}, '^\\d{{2}}/\\d{{2}}/\\d{{4}}') AS is_latino_date,
 lower({q_strip('v')}) IN ('true','false','si','no','yes','1','0') AS is_boolean FROM v""")
def b8(spark, sf):
    d = dirty(spark, sf).select("p_partkey", F.col("dirty_name").alias("name"), F.col("dirty_number").alias("number"),
                                F.col("dirty_date").alias("date")).unpivot(
        ["p_partkey"], ["name", "number", "date"], "column", "v")
    flags = tx.value_type_flags(F.col("v"))
    return d.select("p_partkey", "column", *[c.alias(n) for n, c in flags.items()])


@R.add("b9_match_patterns", """
WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS v FROM documents),
d AS (SELECT doc_id, v, regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}$') AS a, regexp_matches(v, '^\\d{1,2}/\\d{1,2}/\\d{4}$') AS b,
 regexp_matches(v, '^\\d{8}-\\d$') AS c, regexp_matches(v, '^\\d{4}-\\d{6}-\\d{3}-\\d{3}$') AS d,
 regexp_matches(v, '^(\\+?503)?\\s?\\d{4}-?\\d{4}$') AS e, regexp_matches(v, '^[\\p{L}\\p{N}_.-]+@[\\p{L}\\p{N}_.-]+\\.[\\p{L}\\p{N}_]+$') AS f,
 regexp_matches(v, '^(19|20)\\d{2}$') AS g FROM w)
SELECT doc_id, count(*) AS words, count(*) FILTER (a) AS date_iso, count(*) FILTER (b) AS date_latino, count(*) FILTER (c) AS dui_sv,
 count(*) FILTER (d) AS nit_sv, count(*) FILTER (e) AS phone_sv, count(*) FILTER (f) AS email, count(*) FILTER (g) AS "year"
FROM d GROUP BY doc_id""")
def b9(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("v"))
    m = tx.match_patterns(F.col("v"))
    return words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"),
                                       *[F.sum(c.cast("long")).alias(n) for n, c in m.items()])


@R.add("b10_tokenize", """
WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+')) AS w FROM documents)
SELECT w AS token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t WHERE length(w) > 1 GROUP BY w""")
def b10(spark, sf):
    tok = table(spark, sf, "documents").select("doc_id", "text").select("doc_id", F.explode(tx.tokenize(F.col("text"))).alias("token"))
    return (tok.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("token").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs")))


@R.add("b22_grade", f"""
SELECT c_custkey, {q_grade('floor((c_acctbal + 1000) / 110)')} AS grade FROM customer""")
def b22(spark, sf):
    score = F.floor((F.col("c_acctbal") + 1000) / 110)
    return table(spark, sf, "customer").select("c_custkey", tx.grade(score).alias("grade"))


@R.add("b23_composite_key", f"""WITH {DIRTY_SQL}
SELECT DISTINCT k AS key FROM (SELECT nullif(concat_ws('|', CASE WHEN NOT {q_missing('dirty_name')} THEN {q_strip('dirty_name')} END,
  CASE WHEN NOT {q_missing('dirty_number')} THEN {q_strip('dirty_number')} END), '') AS k FROM dirty) WHERE k IS NOT NULL""")
def b23(spark, sf):
    k = tx.composite_key(F.col("dirty_name"), F.col("dirty_number"))
    return dirty(spark, sf).select(k.alias("key")).filter("key is not null").distinct()


@R.add("b24_compose", """
SELECT l_orderkey, l_linenumber, l_returnflag || ' ' || l_linestatus AS label, round(l_tax + l_discount, 6) AS total,
  round(l_extendedprice * (1 - l_discount), 6) AS net, datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS days FROM lineitem""")
def b24(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", tx.compose("concat", c("l_returnflag"), c("l_linestatus")).alias("label"),
        r6(tx.compose("sum", c("l_tax"), c("l_discount"))).alias("total"),
        r6(tx.compose("calc", c("l_extendedprice"), c("l_discount"), formula=lambda price, cut: price * (1 - cut))).alias("net"),
        tx.compose("date_diff", c("l_shipdate"), F.lit("1995-01-01")).alias("days"))


# --- profiles -----------------------------------------------------------------------------

_STRICT = r"""CASE WHEN coalesce(bool_and(regexp_matches(value, '^-?\d+$')) FILTER (ok), true) THEN 'integer'
  WHEN coalesce(bool_and(regexp_matches(value, '^-?\d+\.\d+$')) FILTER (ok), true) THEN 'float'
  WHEN coalesce(bool_and(regexp_matches(value, '^\d{4}-\d{2}-\d{2}')) FILTER (ok), true) THEN 'date' ELSE 'text' END"""
_PROFILE_SQL = f"""c AS (SELECT *, NOT {q_missing('value')} AS ok FROM cells),
p AS (SELECT source, "column", {_STRICT} AS data_type, count(*) FILTER (ok) < count(*) AS nullable, count(*) AS total_count,
  count(*) FILTER (NOT ok) AS null_count, count(DISTINCT value) FILTER (ok) AS unique_count,
  min(value) FILTER (ok) AS min_value, max(value) FILTER (ok) AS max_value FROM c GROUP BY source, "column"),
sv AS (SELECT source, "column", string_agg(value, '|' ORDER BY value) AS sample_values FROM (
  SELECT source, "column", value, row_number() OVER (PARTITION BY source, "column" ORDER BY value) AS r
  FROM (SELECT DISTINCT source, "column", value FROM c WHERE ok)) WHERE r <= 20 GROUP BY source, "column")
SELECT p.*, sv.sample_values FROM p LEFT JOIN sv USING (source, "column")"""


def _profile(spark, sf, *names):
    return _profile_of(_cells(spark, sf, *names))


def _profile_of(cell_rows):
    return profile.profile_cells(cell_rows).withColumn("sample_values", F.array_join("sample_values", "|"))


def _database(spark, sf):
    """The name of a catalog database whose tables lie over the given files."""
    name = f"given_{zlib.crc32(sf.encode())}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{shared_dir(spark)}/{name}'")
    for t in TABLES:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name}.{t} USING parquet LOCATION '{sf}/{t}.parquet'")
    return name


@R.add("a2_profile_database", f"WITH {q_cells(*TABLES)}, {_PROFILE_SQL}")
def a2(spark, sf):
    tables = readers.read_database(spark, _database(spark, sf))
    return _profile_of(cells_of(tables, {t: [c.partition(":")[0] for c in COLUMNS[t].split()] for t in tables}))


@R.add("c1_profile_columns", f"WITH {DIRTY_SQL}, {q_cells('dirty', 'orders')}, {_PROFILE_SQL}")
def c1(spark, sf):
    return _profile(spark, sf, "dirty", "orders")


_SUMMARY_SQL = f"""c AS (SELECT *, NOT {q_missing('value')} AS ok, {q_num('value')} AS x FROM cells),
d AS (SELECT source, "column", count(*) AS "count", count(DISTINCT upper({q_strip('value')})) FILTER (ok) AS "unique",
  count(*) FILTER (NOT ok) AS missing, count(x) FILTER (ok) > 0.8 * count(*) FILTER (ok) AND count(*) FILTER (ok) > 0 AS is_num,
  count(x) FILTER (ok) AS n_x, CAST(sum(CAST(x AS DECIMAL(38,4))) FILTER (ok) AS DOUBLE) / count(x) FILTER (ok) AS mean, quantile_cont(x, 0.5) FILTER (ok) AS med, stddev_samp(x) FILTER (ok) AS sd,
  min(x) FILTER (ok) AS mn, max(x) FILTER (ok) AS mx, quantile_cont(x, 0.25) FILTER (ok) AS q1, quantile_cont(x, 0.75) FILTER (ok) AS q3
  FROM c GROUP BY source, "column")"""
# means often end in a 5 at the seventh decimal: rounded by their shortest decimal text, as Spark does
_SUMMARY_COLS = """source, "column", "count", "unique", missing, CASE WHEN is_num THEN 'numeric' ELSE 'categorical' END AS type,
  CASE WHEN is_num AND n_x >= 2 THEN CAST(CAST(CAST(mean AS VARCHAR) AS DECIMAL(38,6)) AS DOUBLE) END AS mean,
  """ + ", ".join(f"CASE WHEN is_num AND n_x >= 2 THEN round({a}, 6) END AS {b}" for a, b in (
    ("med", "median"), ("sd", "std"), ("mn", '"min"'), ("mx", '"max"'), ("q1", "q1"), ("q3", "q3")))
_NUMERIC = ["mean", "median", "std", "min", "max", "q1", "q3"]


def _rounded(df):
    return df.withColumns({c: r6(F.col(c)) for c in _NUMERIC})


@R.add("c2_distribution_summary", f"WITH {DIRTY_SQL}, {q_cells('dirty', 'lineitem')}, {_SUMMARY_SQL} SELECT {_SUMMARY_COLS} FROM d")
def c2(spark, sf):
    return _rounded(profile.distribution_summary(_cells(spark, sf, "dirty", "lineitem")))


@R.add("c3_top_values", f"""WITH {DIRTY_SQL}, {q_cells('dirty', 'part')},
v AS (SELECT source, "column", value, count(*) AS cnt FROM cells WHERE NOT {q_missing('value')} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source, "column" ORDER BY cnt DESC, value) AS rank FROM v)
SELECT source, "column", value, cnt, rank FROM r WHERE rank <= 5""")
def c3(spark, sf):
    return profile.top_values(_cells(spark, sf, "dirty", "part"))


_Q = f"""qq AS (SELECT source, "column", count(*) AS total, count(*) FILTER (ok) AS n, count(DISTINCT upper({q_strip('value')})) FILTER (ok) AS card,
  count(DISTINCT lower({q_strip('value')})) FILTER (ok) AS lows, count({q_num('value')}) FILTER (ok) AS nx,
  count(*) FILTER (ok AND regexp_matches(value, '[^\\x00-\\x7F]') AND NOT regexp_matches(value, '^[\\p{{L}}\\p{{N}}_\\s\\-.,()]')) AS weird
  FROM (SELECT *, NOT {q_missing('value')} AS ok FROM cells) GROUP BY source, "column"),
q1 AS (SELECT *, n > 0 AND nx > 0.8 * n AS num, n / total AS completeness FROM qq),
q2 AS (SELECT *, CASE WHEN num THEN nx / greatest(n, 1) ELSE 1 - weird / greatest(n, 1) END AS validity,
  CASE WHEN NOT num AND card < 20 THEN lows / greatest(card, 1) WHEN card > 0 THEN 1.0 ELSE 0.0 END AS consistency FROM q1),
q3 AS (SELECT *, CAST(floor(round(completeness * 40 + consistency * 30 + validity * 30, 9)) AS BIGINT) AS score FROM q2)"""


@R.add("c4_dataset_profile", f"""WITH {q_cells('customer')}, {_SUMMARY_SQL}, {_Q}
SELECT {_SUMMARY_COLS}, score, {q_grade('score')} AS grade FROM d JOIN q3 USING (source, "column")""")
def c4(spark, sf):
    return _rounded(profile.dataset_profile(_cells(spark, sf, "customer")))


@R.add("c4_dataset_rollup", f"""WITH {DIRTY_SQL}, {q_cells('customer', 'supplier', 'dirty')}, {_Q}, g AS (SELECT *, {q_grade('score')} AS g FROM q3)
SELECT source, count(*) AS columns, round(avg(score), 6) AS avg_score, count(*) FILTER (g='A') AS grade_a, count(*) FILTER (g='B') AS grade_b,
 count(*) FILTER (g='C') AS grade_c, count(*) FILTER (g='D') AS grade_d, count(*) FILTER (g='F') AS grade_f FROM g GROUP BY source""")
def c4b(spark, sf):
    q = profile.column_quality(_cells(spark, sf, "customer", "supplier", "dirty"))
    return profile.dataset_rollup(q).withColumn("avg_score", r6(F.col("avg_score")))


@R.add("c5_column_quality", f"""WITH {DIRTY_SQL}, {q_cells('dirty', 'part', 'documents')}, {_Q}
SELECT source, "column", round(completeness, 6) AS completeness, round(CAST(consistency AS DOUBLE), 6) AS consistency, round(validity, 6) AS validity,
 score, {q_grade('score')} AS grade, concat_ws(',', CASE WHEN completeness < 0.5 THEN 'alta nulidad' WHEN completeness < 0.9 THEN 'nulidad moderada' END,
 CASE WHEN NOT num AND card < 20 AND consistency < 0.8 THEN 'posibles duplicados' END) AS issues FROM q3""")
def c5(spark, sf):
    q = profile.column_quality(_cells(spark, sf, "dirty", "part", "documents"))
    return q.withColumns({c: r6(F.col(c)) for c in ("completeness", "consistency", "validity")}).withColumn(
        "issues", F.array_join("issues", ","))


def _beside_empty(spark, sf):
    """The cells of a table with rows and of one without, and the columns of both."""
    tables = {"supplier": table(spark, sf, "supplier"), "orders": table(spark, sf, "orders").filter("o_orderkey < 0")}
    return cells_of(tables), column_names(tables)


_NO_ROWS = ", ".join(f"('orders', '{c.partition(':')[0]}')" for c in COLUMNS["orders"].split())


@R.add("c5_empty_table", f"""WITH {q_cells('supplier')}, {_Q}
SELECT source, "column", round(completeness, 6) AS completeness, round(CAST(consistency AS DOUBLE), 6) AS consistency, round(validity, 6) AS validity,
 score, {q_grade('score')} AS grade, concat_ws(',', CASE WHEN completeness < 0.5 THEN 'alta nulidad' WHEN completeness < 0.9 THEN 'nulidad moderada' END,
 CASE WHEN NOT num AND card < 20 AND consistency < 0.8 THEN 'posibles duplicados' END) AS issues FROM q3
UNION ALL SELECT source, c, 0.0, 0.0, 0.0, 0, 'F', 'columna vacia' FROM (VALUES {_NO_ROWS}) v(source, c)""")
def c5c(spark, sf):
    q = profile.column_quality(*_beside_empty(spark, sf))
    return q.withColumns({c: r6(F.col(c)) for c in ("completeness", "consistency", "validity")}).withColumn(
        "issues", F.array_join("issues", ","))


@R.add("c5_spelling_variants", f"""WITH {DIRTY_SQL}, {q_cells('dirty')}, v AS (SELECT source, "column",
 count(DISTINCT value) AS spellings, count(DISTINCT lower({q_strip('value')})) AS keys FROM cells WHERE NOT {q_missing('value')} GROUP BY ALL)
SELECT source, "column", spellings, keys, round(keys / greatest(spellings, 1), 6) AS consistency FROM v""")
def c5b(spark, sf):
    return profile.spelling_variants(_cells(spark, sf, "dirty")).withColumn("consistency", r6(F.col("consistency")))


def _anom_sql(b, cells_sql):
    return f"""WITH {cells_sql}, x AS (SELECT source, "column", x FROM (SELECT source, "column", {q_num('value')} AS x FROM cells) WHERE x IS NOT NULL),
b AS (SELECT source, "column", count(*) AS n_num, {b} FROM x GROUP BY source, "column" HAVING count(*) >= 4)
SELECT source, "column", n_num, round(lo, 6) AS lower, round(hi, 6) AS upper, count(*) FILTER (lo < hi AND (x < lo OR x > hi)) AS anomaly_count,
 round(count(*) FILTER (lo < hi AND (x < lo OR x > hi)) / n_num, 6) AS anomaly_ratio FROM x JOIN b USING (source, "column") GROUP BY source, "column", n_num, lo, hi"""


_IQR = """quantile_cont(x, 0.25) - 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS lo,
 quantile_cont(x, 0.75) + 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS hi"""
_Z = "avg(x) - 3 * stddev_samp(x) AS lo, avg(x) + 3 * stddev_samp(x) AS hi"


def _anom(df):
    return df.withColumns({c: r6(F.col(c)) for c in ("lower", "upper", "anomaly_ratio")})


@R.add("c6_anomalies_iqr", _anom_sql(_IQR, f"{DIRTY_SQL}, {q_cells('orders', 'events', 'dirty')}").replace("lo < hi AND ", ""))
def c6(spark, sf):
    return _anom(anomalies.numeric_anomalies(_cells(spark, sf, "orders", "events", "dirty"), "iqr"))


@R.add("c6_anomaly_rows", """WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, 'value' AS "column", round(value, 6) AS x, 'fuera de rango IQR' AS reason FROM events, b
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def c6b(spark, sf):
    return anomalies.anomaly_rows(table(spark, sf, "events"), "events", ["event_id"], ["value"]).withColumn("x", r6(F.col("x")))


@R.add("c7_anomalies_zscore", _anom_sql(_Z, q_cells('events', 'orders')))
def c7(spark, sf):
    return _anom(anomalies.numeric_anomalies(_cells(spark, sf, "events", "orders"), "zscore"))


@R.add("c8_rare_values", f"""WITH {DIRTY_SQL}, {q_cells('dirty', 'part')},
v AS (SELECT source, "column", {q_strip('value')} AS value, count(*) AS cnt FROM cells WHERE NOT {q_missing('value')} GROUP BY ALL),
t AS (SELECT *, sum(cnt) OVER (PARTITION BY source, "column") AS n FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY source, "column" ORDER BY cnt, value) AS rank FROM t WHERE n > 10 AND cnt / n < 0.01)
SELECT source, "column", value, cnt, CAST(n AS BIGINT) AS n, rank FROM r WHERE rank <= 20""")
def c8(spark, sf):
    return profile.rare_values(_cells(spark, sf, "dirty", "part"))


@R.add("c9_high_cardinality", f"""WITH {DIRTY_SQL}, {q_cells('customer', 'dirty')}, v AS (SELECT source, "column", count(*) AS n,
 count(DISTINCT {q_strip('value')}) AS cardinality FROM cells WHERE NOT {q_missing('value')} GROUP BY ALL)
SELECT *, cardinality > n * 0.9 AND n > 20 AS high_cardinality FROM v""")
def c9(spark, sf):
    return profile.high_cardinality(_cells(spark, sf, "customer", "dirty"))


@R.add("c10_suspicious_values", f"""WITH {DIRTY_SQL}, {q_cells('dirty', 'documents')}, v AS (SELECT source, "column", value, count(*) AS cnt,
 concat_ws(',', CASE WHEN regexp_matches(value, '[^\\x00-\\x7F]') THEN 'mojibake' END, CASE WHEN {q_strip('value')} <> value THEN 'whitespace' END,
  CASE WHEN regexp_matches({q_strip('value')}, '\\s\\s') THEN 'espacios multiples' END) AS issues
 FROM cells WHERE NOT {q_missing('value')} GROUP BY ALL)
SELECT * FROM v WHERE issues <> ''""")
def c10(spark, sf):
    s = profile.suspicious_values(_cells(spark, sf, "dirty", "documents"))
    return s.withColumn("issues", F.array_join("issues", ","))


_FEATURES_SQL = f"""f AS (SELECT source, "column", count({q_num('value')}) FILTER (ok) / count(*) AS numeric_ratio,
 count(DISTINCT upper({q_strip('value')})) FILTER (ok) / count(*) AS cardinality_ratio, count(*) FILTER (NOT ok) / count(*) AS missing_ratio,
 count(*) FILTER (ok AND regexp_matches({q_strip('value')}, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}})')) / count(*) AS date_ratio,
 coalesce(least(avg(length(value)) FILTER (ok) / 50.0, 1.0), 0.0) AS avg_length, count(DISTINCT upper({q_strip('value')})) FILTER (ok) AS "unique"
 FROM (SELECT *, NOT {q_missing('value')} AS ok FROM cells) GROUP BY source, "column")"""


@R.add("c11_column_features", f"""WITH {DIRTY_SQL}, {q_cells('customer', 'orders', 'part', 'dirty')}, {_FEATURES_SQL}
SELECT source, "column", round(numeric_ratio, 6) AS numeric_ratio, round(cardinality_ratio, 6) AS cardinality_ratio, round(missing_ratio, 6) AS missing_ratio,
 round(date_ratio, 6) AS date_ratio, round(avg_length, 6) AS avg_length, "unique",
 CASE WHEN numeric_ratio > 0.7 THEN 'numeric' WHEN date_ratio > 0.5 THEN 'date' ELSE 'categorical' END AS type FROM f""")
def c11(spark, sf):
    f = profile.column_features(_cells(spark, sf, "customer", "orders", "part", "dirty"))
    return f.withColumns({c: r6(F.col(c)) for c in
                          ("numeric_ratio", "cardinality_ratio", "missing_ratio", "date_ratio", "avg_length")})


@R.add("c11_empty_table", f"""WITH {q_cells('supplier')}, {_FEATURES_SQL}
SELECT source, "column", round(numeric_ratio, 6) AS numeric_ratio, round(cardinality_ratio, 6) AS cardinality_ratio, round(missing_ratio, 6) AS missing_ratio,
 round(date_ratio, 6) AS date_ratio, round(avg_length, 6) AS avg_length, "unique",
 CASE WHEN numeric_ratio > 0.7 THEN 'numeric' WHEN date_ratio > 0.5 THEN 'date' ELSE 'categorical' END AS type FROM f
UNION ALL SELECT source, c, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 'empty' FROM (VALUES {_NO_ROWS}) v(source, c)""")
def c11b(spark, sf):
    f = profile.column_features(*_beside_empty(spark, sf))
    return f.withColumns({c: r6(F.col(c)) for c in
                          ("numeric_ratio", "cardinality_ratio", "missing_ratio", "date_ratio", "avg_length")})


_INGEST_SQL = f"""k AS (SELECT *, CASE WHEN NOT ok THEN NULL WHEN regexp_matches(s, '^[+-]?\\d+$') THEN 'int'
   WHEN regexp_matches(s, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN 'float'
   WHEN regexp_matches(s, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}})') THEN 'date'
   WHEN lower(s) IN ('true','false','si','no','yes','1','0') THEN 'bool' ELSE 'other' END AS kind
  FROM (SELECT *, {q_strip('value')} AS s, NOT {q_missing('value', True)} AS ok FROM cells)),
i AS (SELECT source, "column", count(*) AS total, count(*) FILTER (ok) AS n, count(DISTINCT lower(s)) FILTER (ok) AS uniq,
  count(*) FILTER (kind='int') AS ki, count(*) FILTER (kind='float') AS kf, count(*) FILTER (kind='date') AS kd, count(*) FILTER (kind='bool') AS kb
  FROM k GROUP BY source, "column"),
it AS (SELECT *, CASE WHEN n = 0 THEN 'unknown' WHEN ki / n > 0.8 THEN 'integer' WHEN (ki + kf) / n > 0.8 THEN 'float' WHEN kd / n > 0.7 THEN 'date'
  WHEN kb / n > 0.8 THEN 'boolean' ELSE 'text' END AS data_type FROM i)"""


def _standards(spark, sf):
    """Two standards taken from the tables: nation keys and region keys with their names."""
    n = table(spark, sf, "nation").select(F.lit("NATIONS").alias("standard_id"), F.col("n_nationkey").cast("string").alias("code"),
                                          F.col("n_name").alias("label"))
    r = table(spark, sf, "region").select(F.lit("REGIONS").alias("standard_id"), F.col("r_regionkey").cast("string").alias("code"),
                                          F.col("r_name").alias("label"))
    return n.unionByName(r)


@R.add("c12_field_quality", f"""WITH {DIRTY_SQL}, {q_cells('customer', 'supplier', 'dirty')}, {_INGEST_SQL},
m(source, "column", std) AS (VALUES ('customer','c_nationkey','NATIONS'), ('supplier','s_nationkey','REGIONS'), ('dirty','dirty_number','NATIONS')),
codes AS (SELECT 'NATIONS' AS std, CAST(n_nationkey AS VARCHAR) AS code FROM nation UNION ALL SELECT 'REGIONS', CAST(r_regionkey AS VARCHAR) FROM region),
hit AS (SELECT k.source, k."column", count(*) AS inside FROM k JOIN m USING (source, "column") JOIN codes c ON c.std = m.std AND upper(k.s) = c.code WHERE k.ok GROUP BY ALL),
q AS (SELECT it.source, it."column", data_type, n / total AS completeness, uniq / total AS uniqueness,
  CASE WHEN m.std IS NULL OR n = 0 THEN 1.0 ELSE coalesce(inside, 0) / n END AS consistency,
  CASE WHEN n = 0 THEN 1.0 WHEN data_type = 'date' THEN kd / n WHEN data_type = 'integer' THEN ki / n WHEN data_type = 'float' THEN (ki + kf) / n ELSE 1.0 END AS validity
  FROM it LEFT JOIN m USING (source, "column") LEFT JOIN hit USING (source, "column"))
SELECT source, "column", data_type, round(completeness, 6) AS completeness, round(uniqueness, 6) AS uniqueness, round(consistency, 6) AS consistency,
  round(validity, 6) AS validity, round(completeness * 0.4 + consistency * 0.3 + validity * 0.2 + uniqueness * 0.1, 6) AS quality_score FROM q""")
def c12(spark, sf):
    m = spark.createDataFrame([("customer", "c_nationkey", "NATIONS"), ("supplier", "s_nationkey", "REGIONS"),
                               ("dirty", "dirty_number", "NATIONS")], "source string, column string, standard_id string")
    q = profile.field_quality(_cells(spark, sf, "customer", "supplier", "dirty"), m, _standards(spark, sf))
    return q.withColumns({c: r6(F.col(c)) for c in ("completeness", "uniqueness", "consistency", "validity", "quality_score")})


@R.add("c13_detect_issues", f"""WITH {DIRTY_SQL}, {q_cells('dirty', *TABLES)}, {_INGEST_SQL},
a AS (SELECT source, "column", 'alta_nulidad' AS issue_type, CASE WHEN (total - n) / total > 0.7 THEN 'error' ELSE 'warning' END AS severity, round((total - n) / total, 6) AS metric_value
  FROM it WHERE (total - n) / total > 0.5
 UNION ALL SELECT source, "column", 'columna_constante', 'warning', 1.0 FROM it WHERE uniq = 1 AND total > 5
 UNION ALL SELECT source, "column", 'clave_primaria', 'info', 1.0 FROM it WHERE uniq = total AND total > 0
 UNION ALL SELECT source, "column", 'tipo_no_detectado', 'warning', 0.0 FROM it WHERE data_type = 'unknown')
SELECT source, "column", issue_type, severity, CAST(metric_value AS DOUBLE) AS metric_value FROM a""")
def c13(spark, sf):
    i = profile.detect_issues(_cells(spark, sf, "dirty", *TABLES))
    return i.withColumn("metric_value", r6(F.col("metric_value")))


# --- profiles merged from stored states -----------------------------------------------------

def _states(spark, sf):
    """Events stored by day in two runs, and line items by month of shipping; all parts are merged by the queries."""
    path = f"{shared_dir(spark)}/profile-states-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    for run in (~late, late | F.col("ts").isNull()):
        profile_states.add_states(events.filter(run), "events", F.to_date("ts"), path)
    profile_states.add_states(table(spark, sf, "lineitem"), "lineitem", F.date_format("l_shipdate", "yyyy-MM"), path)
    return profile_states.read_states(spark, path)


@R.add("c2_state_profile", f"""WITH {q_cells('events', 'lineitem')}, {_SUMMARY_SQL}, e AS (SELECT {_SUMMARY_COLS} FROM d)
SELECT source, "column", "count", missing, type, mean, std, "min", "max" FROM e""")
def c2_states(spark, sf):
    p = profile_states.merged_profile(_states(spark, sf))
    return p.select("source", "column", "count", "missing", "type", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")])


@R.add("c9_state_cardinality", f"""WITH {q_cells('events', 'lineitem')} SELECT source, "column", count(*) FILTER (ok) AS n,
  count(*) FILTER (ok) > 20 AND count(DISTINCT upper({q_strip('value')})) FILTER (ok) > 0.9 * count(*) FILTER (ok) AS high_cardinality
  FROM (SELECT *, NOT {q_missing('value')} AS ok FROM cells) GROUP BY ALL""")
def c9_states(spark, sf):
    return profile_states.merged_cardinality(_states(spark, sf)).select("source", "column", "n", "high_cardinality")


@R.add("c3_state_top_values")  # estimates: compared with exact counts in tests/test_profile_states.py
def c3_states(spark, sf):
    return profile_states.merged_top_values(_states(spark, sf))
