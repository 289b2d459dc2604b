"""Queries: privacy, validation, correction memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from datasteward.functions import privacy
from datasteward.functions import text as tx
from datasteward.operators import memory, validate
from datasteward.operators.validate import DomainPack, FieldSchema, Rule
from datasteward.plans.base import DIRTY_SQL, Registry, dirty, q_num, table

R = Registry()
SALT = "pepper"


# --- privacy ------------------------------------------------------------------------------

@R.add("b12_pseudonymize", f"SELECT c_custkey, substring(sha256(c_name || '{SALT}'), 1, 16) AS token FROM customer")
def b12(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", privacy.pseudonymize(F.col("c_name"), SALT).alias("token"))


@R.add("b13_generalize_date", 'SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS "year" FROM orders')
def b13(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", privacy.generalize_date(F.col("o_orderdate")).alias("year"))


@R.add("b14_generalize_sensitive", f"WITH {DIRTY_SQL} SELECT p_partkey, CASE WHEN dirty_name IS NOT NULL THEN 'registrado' END AS v FROM dirty")
def b14(spark, sf):
    return dirty(spark, sf).select("p_partkey", privacy.generalize_sensitive(F.col("dirty_name")).alias("v"))


@R.add("b15_mask", "SELECT c_custkey, repeat('*', length(c_name) - 4) || right(c_name, 4) AS masked FROM customer")
def b15(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", privacy.mask(F.col("c_name")).alias("masked"))


@R.add("b15_k_anonymity", """WITH c AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer)
SELECT c_custkey, CASE WHEN n >= 12 THEN c_nationkey END AS c_nationkey, CASE WHEN n >= 12 THEN c_mktsegment END AS c_mktsegment, n < 12 AS suppressed FROM c""")
def b15b(spark, sf):
    k = privacy.k_anonymity(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], 12)
    return k.select("c_custkey", "c_nationkey", "c_mktsegment", "suppressed")


@R.add("b16_anonymize", f"""SELECT o_orderkey, substring(sha256(CAST(o_custkey AS VARCHAR) || '{SALT}'), 1, 16) AS o_custkey, 'registrado' AS o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate FROM orders""")
def b16(spark, sf):
    cls = {"o_custkey": "pii", "o_orderstatus": "sensible", "o_orderdate": "pii", "o_totalprice": "suppress", "o_orderpriority": "suppress"}
    return privacy.anonymize(table(spark, sf, "orders"), cls, SALT)


# column names built from the data: the part name with words that the keyword lists know
_NAMES = """nm AS (SELECT DISTINCT CASE p_type WHEN 'ECONOMY' THEN 'Fecha_Nacimiento_' WHEN 'LARGE' THEN 'diag-nostico ' WHEN 'MEDIUM' THEN 'tele_fono_' WHEN 'PROMO' THEN 'Tratamiento del documento ' ELSE 'codigo_' END || p_name AS "column" FROM part)"""


def _names(spark, sf):
    t = F.col("p_type")
    pre = (F.when(t == "ECONOMY", "Fecha_Nacimiento_").when(t == "LARGE", "diag-nostico ").when(t == "MEDIUM", "tele_fono_")
           .when(t == "PROMO", "Tratamiento del documento ").otherwise("codigo_"))
    return table(spark, sf, "part").select(F.concat(pre, "p_name").alias("column")).distinct()


def _sens_sql(words):
    v = ", ".join(f"('{w}')" for w in words)
    return f"""(SELECT min(w) FROM (VALUES {v}) k(w) WHERE contains(lower("column"), w) OR contains(regexp_replace(lower("column"), '[_\\-\\s]', '', 'g'), w))"""


@R.add("b21_sensitivity", f"""WITH {_NAMES}, s AS (SELECT "column", {_sens_sql(privacy.PII_WORDS)} AS p, {_sens_sql(privacy.SENSITIVE_WORDS)} AS s FROM nm)
SELECT "column", p IS NOT NULL AS is_pii, p IS NULL AND s IS NOT NULL AS is_sensitive, coalesce(p, s) AS sensitivity_keyword FROM s""")
def b21(spark, sf):
    return privacy.sensitivity(_names(spark, sf))


@R.add("b21_sensitivity_sensitive_first", f"""WITH {_NAMES}, s AS (SELECT "column", {_sens_sql(privacy.PII_WORDS)} AS p, {_sens_sql(privacy.SENSITIVE_WORDS)} AS s FROM nm)
SELECT "column", s IS NULL AND p IS NOT NULL AS is_pii, s IS NOT NULL AS is_sensitive, coalesce(s, p) AS sensitivity_keyword FROM s""")
def b21b(spark, sf):
    return privacy.sensitivity(_names(spark, sf), priority="sensitive")


# --- validation ---------------------------------------------------------------------------

_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_ID = ", ".join(_IDS)


def _sql_issue(cond, sev, fld, kind, orig="NULL", sugg="NULL", src="lineitem", ids=_ID, layer="structural"):
    return (f"SELECT {ids}, '{layer}' AS layer, '{sev}' AS severity, '{fld}' AS field_name, '{kind}' AS issue_type, "
            f"CAST({orig} AS VARCHAR) AS original_value, CAST({sugg} AS VARCHAR) AS suggested_value FROM {src} WHERE {cond}")


@R.add("g1_validate_required", f"WITH {DIRTY_SQL} " + _sql_issue("dirty_name IS NULL", "error", "name", "missing_field", src="dirty", ids="p_partkey")
       + " UNION ALL " + _sql_issue("true", "error", "owner", "missing_field", src="dirty", ids="p_partkey"))
def g1(spark, sf):
    fields = [FieldSchema("name", "string", True, aliases=["DIRTY_NAME"]), FieldSchema("owner", "string", True)]
    return validate.validate_structural(dirty(spark, sf), fields, ["p_partkey"])


@R.add("g2_validate_type", f"""WITH {DIRTY_SQL} {_sql_issue("NOT regexp_matches(trim(dirty_number), '^[+-]?[0-9]+$')", 'error', 'dirty_number', 'type_mismatch', 'dirty_number', src='dirty', ids='p_partkey')}
 UNION ALL {_sql_issue(f"dirty_name IS NOT NULL AND {q_num('dirty_name')} IS NULL", 'error', 'dirty_name', 'type_mismatch', 'dirty_name', src='dirty', ids='p_partkey')}""")
def g2(spark, sf):
    return validate.validate_structural(dirty(spark, sf), [FieldSchema("dirty_number", "integer"), FieldSchema("dirty_name", "float")], ["p_partkey"])


@R.add("g2_coercion_actions", f"""WITH {DIRTY_SQL} SELECT p_partkey, 'dirty_number' AS field, dirty_number AS original, CAST(CAST(dirty_number AS BIGINT) AS VARCHAR) AS fixed, 'type_coercion' AS method
 FROM dirty WHERE regexp_matches(dirty_number, '^[+-]?[0-9]+$')""")
def g2b(spark, sf):
    return validate.coercion_actions(dirty(spark, sf), [FieldSchema("dirty_number", "integer")], ["p_partkey"])


_RANGE = (_sql_issue("l_quantity < 3", "warning", "l_quantity", "out_of_range", "CAST(l_quantity AS DOUBLE)", "'3'") + " UNION ALL "
          + _sql_issue("l_quantity > 45", "warning", "l_quantity", "out_of_range", "CAST(l_quantity AS DOUBLE)", "'45'"))


@R.add("g3_validate_range", _RANGE)
def g3(spark, sf):
    return validate.validate_structural(table(spark, sf, "lineitem"), [FieldSchema("l_quantity", "float", min=3, max=45)], _IDS)


@R.add("g4_validate_enum", _sql_issue("p_type NOT IN ('SMALL', 'LARGE', 'MEDIUM')", "error", "p_type", "enum_invalid", "p_type", src="part", ids="p_partkey"))
def g4(spark, sf):
    return validate.validate_structural(table(spark, sf, "part"), [FieldSchema("p_type", enum=["SMALL", "LARGE", "MEDIUM"])], ["p_partkey"])


@R.add("g5_validate_pattern", _sql_issue("NOT regexp_matches(c_name, '^Customer#0*[1-4]')", "warning", "c_name", "pattern_mismatch", "c_name", src="customer", ids="c_custkey"))
def g5(spark, sf):
    return validate.validate_structural(table(spark, sf, "customer"), [FieldSchema("c_name", pattern="Customer#0*[1-4]")], ["c_custkey"])


def _orders_lines(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))


PACK = DomainPack(
    "lines",
    [FieldSchema("l_quantity", "float", True, min=3, max=45), FieldSchema("returnflag", "string", True, enum=["A", "N"], aliases=["L_RETURNFLAG"]),
     FieldSchema("l_linestatus", "string", pattern="F")],
    [Rule("ships_before_order", "l_shipdate >= o_orderdate", "error", "l_shipdate"), Rule("tax_over_discount", "l_tax <= l_discount + 0.05", "warning", "l_tax")])
_OL = "(SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_VALID = (_RANGE.replace("FROM lineitem", f"FROM {_OL}") + " UNION ALL " + _sql_issue("l_returnflag NOT IN ('A', 'N')", "error", "returnflag", "enum_invalid", "l_returnflag", src=_OL)
          + " UNION ALL " + _sql_issue("l_linestatus <> 'F'", "warning", "l_linestatus", "pattern_mismatch", "l_linestatus", src=_OL)
          + " UNION ALL " + _sql_issue("l_returnflag IN ('A', 'N') AND l_shipdate < o_orderdate", "error", "l_shipdate", "ships_before_order", src=_OL, layer="semantic")
          + " UNION ALL " + _sql_issue("l_returnflag IN ('A', 'N') AND l_tax > l_discount + 0.05", "warning", "l_tax", "tax_over_discount", src=_OL, layer="semantic"))


@R.add("g6_validate", _VALID)
def g6(spark, sf):
    return validate.validate(_orders_lines(spark, sf), PACK, _IDS)


@R.add("g6_row_status", f"""WITH i AS ({_VALID}), n AS (SELECT {_ID}, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM i GROUP BY ALL)
SELECT {_ID}, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS is_valid FROM lineitem LEFT JOIN n USING ({_ID})""")
def g6b(spark, sf):
    d = _orders_lines(spark, sf)
    return validate.row_status(d, validate.validate(d, PACK, _IDS), _IDS)


@R.add("g7_semantic_rules", f"""{_sql_issue("l_shipdate < o_orderdate", 'error', 'l_shipdate', 'ships_before_order', src=_OL, layer='semantic')}
 UNION ALL {_sql_issue("l_extendedprice / l_quantity > 3000", 'warning', 'l_extendedprice', 'price_per_unit', src=_OL, layer='semantic')}""")
def g7(spark, sf):
    pack = DomainPack("r", rules=[Rule("ships_before_order", "l_shipdate >= o_orderdate", "error", "l_shipdate"),
                                  Rule("price_per_unit", "l_extendedprice / l_quantity <= 3000", "warning", "l_extendedprice")])
    return validate.validate(_orders_lines(spark, sf), pack, _IDS)


@R.add("g7_group_rule", """SELECT event_id, user_id, event_type, n, 'several_per_day' AS rule FROM (SELECT *, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type) AS n FROM events) WHERE n > 1""")
def g7b(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return validate.group_rule(e, ["user_id", "day", "event_type"], "n > 1", "several_per_day").select("event_id", "user_id", "event_type", "n", "rule")


def _routes(spark, sf):
    """Nested records of real volume: an order is a route, its lines are locations and pairs."""
    li = table(spark, sf, "lineitem").withColumn("at", F.unix_timestamp("l_shipdate"))
    loc = F.struct(
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.array(4.4 + F.col("l_quantity") / 100, -74.3 + F.col("l_discount") * 4).alias("coords"),
        (F.col("l_partkey") % 24 * 3600).cast("int").alias("time_window_start"), (F.col("l_suppkey") % 24 * 3600).cast("int").alias("time_window_end"),
        F.col("l_quantity").alias("weight_demand"), F.round(F.col("l_tax") * 100, 0).alias("volume_demand"))
    veh = F.struct(F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("id"), (F.col("l_linenumber") * 3600).cast("int").alias("start_time"),
                   (F.col("l_quantity") * 600).cast("int").alias("end_time"))
    r = li.groupBy(F.col("l_orderkey").alias("route")).agg(F.sort_array(F.collect_list(loc)).alias("locations"), F.collect_set(veh).alias("vehicles"))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.size("locations") - 1), lambda i: i % 2 == 1), lambda i: F.struct(
        F.get("locations", i - 1)["id"].alias("pickup"), F.get("locations", i)["id"].alias("delivery")))
    return r.withColumn("pickups_deliveries", pairs)


_BOX = {"lat_min": 4.47, "lat_max": 4.83, "lng_min": -74.25, "lng_max": -74.0}
_LOC = """lc AS (SELECT l_orderkey AS route, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, 4.4 + l_quantity / 100 AS lat, -74.3 + l_discount * 4 AS lng, l_partkey % 24 * 3600 AS ws, l_suppkey % 24 * 3600 AS we,
 l_quantity AS w, round(l_tax * 100, 0) AS u, l_linenumber AS ln FROM lineitem)"""


def _short(df):
    return df.select("route", "severity", "field_name", "issue_type")


# an order is a record, its lines are locations; a few coordinates and weights are missing
@R.add("g1_nested_required", """WITH x AS (SELECT l_orderkey AS route, bool_or(l_linenumber = 3) AS a, bool_or(l_quantity > 45) AS b FROM lineitem GROUP BY 1)
SELECT route, 'error' AS severity, 'locations.coords' AS field_name, 'missing_field' AS issue_type FROM x WHERE a
UNION ALL SELECT route, 'error', 'locations.weight_demand', 'missing_field' FROM x WHERE b UNION ALL SELECT route, 'error', 'locations.owner', 'missing_field' FROM x""")
def g1b(spark, sf):
    r = _routes(spark, sf)
    gone = F.transform("locations", lambda x: x.withField("coords", F.when(~x["id"].startswith("3-"), x["coords"]))
                       .withField("weight_demand", F.when(x["weight_demand"] <= 45, x["weight_demand"])))
    fields = [FieldSchema(f"locations.{c}", required=True) for c in ("id", "Coords", "weight_demand", "owner")]
    found = validate.validate_structural(r.withColumn("locations", gone), fields, ["route"])
    return _short(found.withColumn("field_name", F.lower("field_name")))


@R.add("g8_check_bounds", f"""WITH {_LOC} SELECT route, 'warning' AS severity, 'locations.' || id || '.coords' AS field_name, 'out_of_bounds' AS issue_type, 'lat' AS axis FROM lc WHERE lat < 4.47 OR lat > 4.83
 UNION ALL SELECT route, 'warning', 'locations.' || id || '.coords', 'out_of_bounds', 'lng' FROM lc WHERE lng < -74.25 OR lng > -74.0""")
def g8(spark, sf):
    c = validate.check_bounds(_routes(spark, sf), ["route"], _BOX)
    return c.select("route", "severity", "field_name", "issue_type", F.col("original_value").alias("axis"))


@R.add("g9_check_time_windows", f"""WITH {_LOC} SELECT route, 'error' AS severity, 'locations.' || id || '.time_window' AS field_name, 'time_window_invalid' AS issue_type FROM lc WHERE we < ws
 UNION ALL SELECT route, 'warning', 'locations.' || id || '.time_window', 'atypical_hours' FROM lc WHERE ws < 21600 OR we > 79200
 UNION ALL SELECT route, 'error', 'vehicles.v' || ln || '.schedule', 'vehicle_schedule_invalid' FROM (SELECT DISTINCT route, ln, w FROM lc) WHERE w * 600 <= ln * 3600""")
def g9(spark, sf):
    return _short(validate.check_time_windows(_routes(spark, sf), ["route"], (21600, 79200)))


# every other line of an order brings a vehicle that can do what the line needs
@R.add("g7_routing_rules", """WITH lc AS (SELECT l_orderkey AS route, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_partkey % 24 * 3600 AS ws, l_suppkey % 24 * 3600 AS we, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS w,
 round(l_tax * 100, 0) AS u, l_suppkey % 3 AS m, l_linestatus AS s, l_linenumber AS ln, l_quantity AS q FROM lineitem),
v AS (SELECT DISTINCT route, 'v' || ln AS id, m, s, q * 1.5 AS wc, 8.0 AS uc, ln * 3600 AS st, q * 1800 AS en FROM lc WHERE ln % 2 = 1),
need AS (SELECT route, greatest(sum(greatest(w, 0)), sum(greatest(-w, 0))) AS w, sum(u) AS u FROM lc GROUP BY 1), room AS (SELECT route, sum(wc) AS wc, sum(uc) AS uc FROM v GROUP BY 1),
t AS (SELECT v.route, v.id, st, en, min(ws) AS first, max(we) AS last FROM v JOIN lc ON lc.route = v.route AND lc.m = v.m AND lc.s = v.s GROUP BY v.route, v.id, v.m, v.s, v.wc, st, en)
SELECT route, 'error' AS severity, 'locations.' || id || '.required_skills' AS field_name, 'missing_skills' AS issue_type FROM lc WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.route = lc.route AND v.m = lc.m AND v.s = lc.s)
UNION ALL SELECT route, 'error', 'locations.weight_demand', 'capacity_exceeded' FROM need LEFT JOIN room USING (route) WHERE w > coalesce(wc, 0) AND route % 3 <> 0
UNION ALL SELECT route, 'error', 'locations.volume_demand', 'capacity_exceeded' FROM need LEFT JOIN room USING (route) WHERE u > coalesce(uc, 0) AND route % 3 <> 0
UNION ALL SELECT route, 'warning', 'vehicles.' || id || '.start_time', 'starts_after_visits' FROM t WHERE st > first
UNION ALL SELECT route, 'warning', 'vehicles.' || id || '.end_time', 'ends_before_visits' FROM t WHERE en < last""")
def g7c(spark, sf):
    li = table(spark, sf, "lineitem")
    skills = F.array((F.col("l_suppkey") % 3).cast("string"), "l_linestatus")
    loc = F.struct(F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), skills.alias("required_skills"),
                   (F.col("l_partkey") % 24 * 3600).cast("int").alias("time_window_start"), (F.col("l_suppkey") % 24 * 3600).cast("int").alias("time_window_end"),
                   F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("weight_demand"),
                   F.round(F.col("l_tax") * 100, 0).alias("volume_demand"))
    veh = F.when(F.col("l_linenumber") % 2 == 1, F.struct(
        F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("id"), skills.alias("skills"), (F.col("l_quantity") * 1.5).alias("weight_capacity"),
        F.lit(8.0).alias("volume_capacity"), (F.col("l_linenumber") * 3600).cast("int").alias("start_time"), (F.col("l_quantity") * 1800).cast("int").alias("end_time")))
    r = li.groupBy(F.col("l_orderkey").alias("route")).agg(F.collect_list(loc).alias("locations"), F.collect_set(veh).alias("vehicles"))
    return _short(validate.check_routing_rules(r.withColumn("allow_skipping_nodes", F.col("route") % 3 == 0), ["route"]))


@R.add("g10_check_balance", f"""WITH {_LOC}, o AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY id, lat, lng, ws, we, w, u) - 1 AS k FROM lc),
p AS (SELECT a.route, a.k // 2 AS i, a.id AS pa, b.id AS pb FROM o a JOIN o b ON a.route = b.route AND b.k = a.k + 1 WHERE a.k % 2 = 0),
t AS (SELECT p.route, p.i, a.w + b.w AS w, a.u + b.u AS u FROM p JOIN lc a ON a.route = p.route AND a.id = pa JOIN lc b ON b.route = p.route AND b.id = pb)
SELECT route, 'warning' AS severity, 'pickups_deliveries[' || i || ']' AS field_name, 'demand_imbalance' AS issue_type, 'weight_demand' AS what FROM t WHERE w <> 0
UNION ALL SELECT route, 'warning', 'pickups_deliveries[' || i || ']', 'demand_imbalance', 'volume_demand' FROM t WHERE u <> 0""")
def g10(spark, sf):
    c = validate.check_balance(_routes(spark, sf), ["route"])
    return c.select("route", "severity", "field_name", "issue_type", F.col("original_value").alias("what"))


@R.add("g11_duplicate_entities", """SELECT doc_id, copies, first_doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS copies, min(doc_id) OVER (PARTITION BY text) AS first_doc_id FROM documents) WHERE copies > 1""")
def g11(spark, sf):
    return validate.duplicate_entities(table(spark, sf, "documents"), ["text"], ["doc_id"])


@R.add("g12_scorecard", f"""WITH i AS ({_VALID}), s AS (SELECT l_orderkey, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM i GROUP BY 1),
c AS (SELECT *, greatest(0, 100 - 15 * errors - 5 * warnings) AS score FROM s) SELECT *, CASE WHEN score >= 80 THEN 'pass' WHEN score >= 50 THEN 'review' ELSE 'fail' END AS status FROM c""")
def g12(spark, sf):
    return validate.scorecard(validate.validate(_orders_lines(spark, sf), PACK, _IDS), ["l_orderkey"])


@R.add("l1_custom_validator", f"""{_sql_issue("l_quantity > 48", 'error', 'l_quantity', 'too_heavy', 'CAST(l_quantity AS DOUBLE)', layer='custom')}
 UNION ALL {_sql_issue("l_quantity <= 48 AND l_tax > 0.07", 'warning', 'l_tax', 'high_tax', layer='semantic')}
 UNION ALL BY NAME SELECT 'custom' AS layer, 'warning' AS severity, 'broken' AS field_name, 'validator_failed' AS issue_type,
  'RuntimeError: this validator fails' AS original_value""")
def l1(spark, sf):
    def heavy(df, pack):
        return df.filter(F.col("l_quantity") > pack.metadata["limit"]).select(
            *_IDS, F.lit("custom").alias("layer"), F.lit("error").alias("severity"), F.lit("l_quantity").alias("field_name"),
            F.lit("too_heavy").alias("issue_type"), F.col("l_quantity").alias("original_value"), F.lit(None).alias("suggested_value"))

    def broken(df, pack):
        raise RuntimeError("this validator fails")

    pack = DomainPack("c", rules=[Rule("high_tax", "l_tax <= 0.07", "warning", "l_tax")], validators={"broken": broken, "heavy": heavy}, metadata={"limit": 48})
    return validate.validate(table(spark, sf, "lineitem"), pack, _IDS)


# --- correction memory --------------------------------------------------------------------

def corrections(spark, sf):
    """Events read as answers: the type is the error, the user's digit the field, the value decides."""
    v = F.col("value")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("error_type"), F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")).alias("field_name"),
        F.lit("").alias("context"), F.col("props").alias("corrected_value"),
        F.when(v > 60, True).when(v > 25, False).alias("accepted"), "ts")


_MEM = """ce AS (SELECT event_type AS error_type, 'f' || (user_id % 40) AS field_name, props AS corrected_value, CASE WHEN value > 60 THEN true WHEN value > 25 THEN false END AS accepted, ts FROM events),
mem AS (SELECT substring(sha256(error_type || '|' || field_name || '|'), 1, 16) AS signature, error_type, field_name, arg_min(corrected_value, ts) AS corrected_value, count(*) AS count,
  arg_max(accepted, ts) FILTER (accepted IS NOT NULL) AS accepted FROM ce GROUP BY error_type, field_name),
m2 AS (SELECT *, coalesce(accepted, false) AND count >= 5 AS auto_rule, coalesce(NOT accepted, false) AS skip FROM mem)"""


@R.add("b19_error_signature", "SELECT event_id, substring(sha256(event_type || '|' || 'user_' || user_id || '|' || props), 1, 16) AS signature FROM events")
def b19(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.error_signature(
        F.col("event_type"), F.concat(F.lit("user_"), F.col("user_id").cast("string")), F.col("props")).alias("signature"))


@R.add("g13_correction_memory", f"WITH {_MEM} SELECT * FROM m2")
def g13(spark, sf):
    return memory.correction_memory(corrections(spark, sf))


@R.add("g13_memory_stats", f"""WITH {_MEM} SELECT count(*) AS total_corrections, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected, count(*) FILTER (accepted IS NULL) AS pending,
 count(*) FILTER (auto_rule) AS auto_rules FROM m2""")
def g13b(spark, sf):
    return memory.memory_stats(memory.correction_memory(corrections(spark, sf)))


def _issues(spark, sf):
    t = table(spark, sf, "events").filter("value > 20")
    return t.select("event_id", F.col("event_type").alias("issue_type"), F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")).alias("field_name"),
                    F.lit("").alias("context"), F.when(F.col("value") > 100, "error").otherwise("warning").alias("severity"), F.lit(None).cast("string").alias("suggested_value"))


@R.add("g14_decide", f"""WITH {_MEM} SELECT event_id, issue_type, i.field_name, CASE WHEN auto_rule THEN 'auto' WHEN skip THEN 'skipped' WHEN severity = 'warning' THEN 'ask' ELSE 'open' END AS status
 FROM (SELECT event_id, event_type AS issue_type, 'f' || (user_id % 40) AS field_name, CASE WHEN value > 100 THEN 'error' ELSE 'warning' END AS severity FROM events WHERE value > 20) i
 LEFT JOIN m2 ON m2.error_type = issue_type AND m2.field_name = i.field_name""")
def g14(spark, sf):
    d = memory.decide(_issues(spark, sf), memory.correction_memory(corrections(spark, sf)))
    return d.select("event_id", "issue_type", "field_name", "status")


@R.add("g14_apply_corrections", f"""WITH {_MEM} SELECT e.event_id, CASE WHEN value > 20 AND auto_rule THEN m2.corrected_value ELSE props END AS props, value > 20 AND coalesce(auto_rule, false) AS corrected FROM events e
 LEFT JOIN m2 ON m2.error_type = e.event_type AND m2.field_name = 'f' || (user_id % 40)""")
def g14b(spark, sf):
    d = memory.decide(_issues(spark, sf), memory.correction_memory(corrections(spark, sf)))
    d = d.withColumn("field_name", F.lit("props"))
    return memory.apply_corrections(table(spark, sf, "events"), d, ["event_id"], ["props"]).select("event_id", "props", "corrected")


# the memory knows nothing about one kind of error
_ASKED = f"""{_MEM}, asked AS (SELECT event_id, event_type AS issue_type, 'f' || (user_id % 40) AS field_name, i.ts FROM events i
 LEFT JOIN m2 ON m2.error_type = event_type AND event_type <> 'view' AND m2.field_name = 'f' || (user_id % 40)
 WHERE value > 20 AND value <= 100 AND NOT coalesce(auto_rule, false) AND NOT coalesce(skip, false))"""


def _asked(spark, sf):
    known = memory.correction_memory(corrections(spark, sf).filter("error_type <> 'view'"))
    return memory.questions(memory.decide(_issues(spark, sf), known), ["event_id"])


@R.add("g14_questions", f"WITH {_ASKED} SELECT event_id, field_name, issue_type, CAST(NULL AS VARCHAR) AS suggested_value FROM asked")
def g14c(spark, sf):
    return _asked(spark, sf)


# a third of the questions is answered with yes, a third with no, the rest stays open
@R.add("g14_answers_round_trip", f"""WITH {_ASKED}, a AS (SELECT field_name, 'fix ' || event_id AS corrected_value, event_id % 3 = 0 AS accepted, ts, event_id FROM asked WHERE event_id % 3 < 2),
n AS (SELECT field_name, arg_min(corrected_value, (ts, event_id)) AS corrected_value, count(*) AS count, arg_max(accepted, (ts, event_id)) AS accepted FROM a GROUP BY 1)
SELECT substring(sha256('warning|' || field_name || '|'), 1, 16) AS signature, 'warning' AS error_type, field_name, corrected_value, count, accepted, accepted AND count >= 5 AS auto_rule, NOT accepted AS skip FROM n""")
def g14d(spark, sf):
    k = F.col("event_id") % 3
    said = _asked(spark, sf).join(table(spark, sf, "events").select("event_id", "ts"), "event_id").select(
        "field_name", F.when(k == 0, "Si").when(k == 1, "no").alias("answer"), F.lit("").alias("context"),
        F.concat(F.lit("fix "), F.col("event_id").cast("string")).alias("corrected_value"), F.struct("ts", "event_id").alias("ts"))
    return memory.correction_memory(memory.answers_to_events(said))
