"""Queries: semantic typing, concept matching, assessment, registration, feasibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from datasteward.functions import privacy
from datasteward.operators import assess, feasibility, profile, semantic
from datasteward.operators.cells import cells_of, value_counts
from datasteward.operators.semantic import Standard
from datasteward.plans.base import (DIRTY_SQL, Registry, dirty, q_cells, q_grade, q_missing, q_num, q_strip,
                                    r6, table)
from datasteward.plans.catalog_data import CATALOG_SQL, catalog
from datasteward.plans.q_profile import _INGEST_SQL, _IQR, _Q, _STRICT
from datasteward.sources.readers import normalized_lists
from datasteward.sources.shared import materialize

R = Registry()


# --- a table of persons derived from customer, with names and formats that carry meaning ---

def person(spark, sf):
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    seg = F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        (k % 100).cast("string").alias("edad"), F.col("c_nationkey").cast("string").alias("tasa_pago"),
        F.when(F.col("c_acctbal") > 0, "Si").otherwise("No").alias("activo"),
        F.concat(F.lpad(s, 8, "0"), F.lit("-"), (k % 10).cast("string")).alias("col_dui"), F.concat(F.lit("a"), s, F.lit("@x.com")).alias("correo"),
        (k % 30 + 1990).cast("string").alias("anio_base"), F.concat(F.lit("Zona "), seg).alias("ciudad"),
        F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (k % 5000).cast("int")), "yyyy-MM-dd").alias("fecha_nacimiento"),
        F.lower(seg).alias("Segmento"), F.when(F.col("c_nationkey") < 20, F.col("c_nationkey").cast("string")).otherwise("NA").alias("nation"),
        F.concat(F.lpad(s, 4, "0"), F.lit("-"), F.lpad(s, 6, "0"), F.lit("-101-"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0")).alias("nit"))


_PERSON_COLS = "edad tasa_pago activo col_dui correo anio_base ciudad fecha_nacimiento Segmento nation nit"
PERSON_SQL = """person AS (SELECT CAST(c_custkey % 100 AS VARCHAR) AS edad, CAST(c_nationkey AS VARCHAR) AS tasa_pago, CASE WHEN c_acctbal > 0 THEN 'Si' ELSE 'No' END AS activo,
 lpad(right(CAST(c_custkey AS VARCHAR), 8), 8, '0') || '-' || (c_custkey % 10) AS col_dui, 'a' || c_custkey || '@x.com' AS correo, CAST(c_custkey % 30 + 1990 AS VARCHAR) AS anio_base, 'Zona ' || c_mktsegment AS ciudad,
 strftime(DATE '2000-01-01' + CAST(c_custkey % 5000 AS INTEGER), '%Y-%m-%d') AS fecha_nacimiento, lower(c_mktsegment) AS "Segmento", CASE WHEN c_nationkey < 20 THEN CAST(c_nationkey AS VARCHAR) ELSE 'NA' END AS nation,
 lpad(CAST(c_custkey AS VARCHAR), 4, '0') || '-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '-101-' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS nit FROM customer)"""
_T = ["customer", "part", "orders", "labels", "nation"]


def _cells(spark, sf):
    return cells_of({**{n: table(spark, sf, n) for n in _T}, "dirty": dirty(spark, sf), "person": person(spark, sf)})


_PC = " UNION ALL ".join(f"SELECT 'person', '{c}', \"{c}\" FROM person" for c in _PERSON_COLS.split())
_CELLS = f"{DIRTY_SQL}, {PERSON_SQL}, {q_cells(*_T, 'dirty')[:-1]} UNION ALL {_PC})"

STANDARDS = [Standard("NATIONS", "nations", hints=["s_nationkey", "tasa_pago"]), Standard("REGIONS", "regions", hints=["n_regionkey"]),
             Standard("SEGMENT", "segments", hints=["market segment"]), Standard("PRIORITY", "priorities", "format", regex=r"\d-[A-Z]+"),
             Standard("ISO_8601", "dates", "format", regex=r"\d{4}-\d{2}")]


def _codes(spark, sf):
    a = table(spark, sf, "nation").select(F.lit("NATIONS").alias("standard_id"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"))
    b = table(spark, sf, "region").select(F.lit("REGIONS").alias("standard_id"), F.col("r_regionkey").cast("string").alias("code"), F.col("r_name").alias("label"))
    c = table(spark, sf, "customer").select(F.lit("SEGMENT").alias("standard_id"), F.col("c_mktsegment").alias("code"), F.col("c_mktsegment").alias("label")).distinct()
    return a.unionByName(b).unionByName(c)


_CODES = """codes AS (SELECT 'NATIONS' AS standard_id, CAST(n_nationkey AS VARCHAR) AS code FROM nation UNION ALL SELECT 'REGIONS', CAST(r_regionkey AS VARCHAR) FROM region UNION ALL SELECT DISTINCT 'SEGMENT', c_mktsegment FROM customer),
ords(standard_id, o) AS (VALUES ('NATIONS', 0), ('REGIONS', 1), ('SEGMENT', 2), ('PRIORITY', 3), ('ISO_8601', 4)),
hints(standard_id, h) AS (VALUES ('NATIONS', 's_nationkey'), ('NATIONS', 'tasa_pago'), ('REGIONS', 'n_regionkey'), ('SEGMENT', 'market segment'))"""


def _std_sql(src="dv", name="col"):
    """Candidates per column of ``src`` (source, col, v): hints, patterns, codes."""
    return f"""cand AS (SELECT DISTINCT source, {name} AS col, standard_id, 1 AS branch, 'high' AS confidence FROM (SELECT DISTINCT source, {name} FROM {src}_all) c JOIN hints ON lower({name}) = h
 UNION ALL SELECT source, {name}, 'PRIORITY', 2, 'high' FROM {src} GROUP BY 1, 2 HAVING count(*) FILTER (regexp_matches(upper({q_strip('v')}), '^\\d-[A-Z]+')) > 0.5 * count(*)
 UNION ALL SELECT source, {name}, 'ISO_8601', 2, 'high' FROM {src} GROUP BY 1, 2 HAVING count(*) FILTER (regexp_matches(upper({q_strip('v')}), '^\\d{{4}}-\\d{{2}}')) > 0.5 * count(*)
 UNION ALL SELECT source, {name}, standard_id, 3, 'medium' FROM (SELECT source, {name}, standard_id, count(DISTINCT k) AS c FROM (SELECT source, {name}, upper({q_strip('v')}) AS k FROM {src}) JOIN codes ON k = upper(code) GROUP BY 1, 2, 3)
  JOIN (SELECT source, {name}, count(DISTINCT upper({q_strip('v')})) AS n FROM {src} GROUP BY 1, 2) USING (source, {name}) WHERE c >= 0.5 * n),
std AS (SELECT source, col, standard_id, min(branch) AS branch, min(confidence) AS confidence, row_number() OVER (PARTITION BY source, col ORDER BY min(branch), any_value(o)) AS rank FROM cand JOIN ords USING (standard_id) GROUP BY source, col, standard_id)"""


_DV = f"""dv AS (SELECT DISTINCT source, "column" AS col, value AS v FROM cells WHERE NOT {q_missing('value')}), dv_all AS (SELECT DISTINCT source, "column" AS col FROM cells)"""


@R.add("e9_detect_standard", f"""WITH {_CELLS}, {_CODES}, {_DV}, {_std_sql()} SELECT source, col AS "column", standard_id, branch, confidence, rank FROM std""")
def e9(spark, sf):
    return semantic.detect_standard(value_counts(_cells(spark, sf)), STANDARDS, _codes(spark, sf))


def _lists(spark, sf):
    v = (table(spark, sf, "region").select(F.lit("regions").alias("list_name"), F.col("r_name").alias("value"))
         .union(table(spark, sf, "customer").select(F.lit("segments"), "c_mktsegment"))
         .union(table(spark, sf, "part").select(F.lit("part_names"), "p_name"))
         .union(table(spark, sf, "part").select(F.lit("brands"), "p_brand").filter("p_brand < 'Brand#20'")))
    return normalized_lists(v)


_LISTS = """lists AS (SELECT DISTINCT 'regions' AS ln, lower(r_name) AS x FROM region UNION ALL SELECT DISTINCT 'segments', lower(c_mktsegment) FROM customer UNION ALL SELECT DISTINCT 'part_names', lower(p_name) FROM part
 UNION ALL SELECT DISTINCT 'brands', lower(p_brand) FROM part WHERE p_brand < 'Brand#20')"""


def _norm(v):
    return f"regexp_replace(strip_accents(lower({q_strip(v)})), '\\s+', ' ', 'g')"


_MATCHED = """{n} AS (SELECT source, col, {k} AS name, c / least(n, m) AS overlap FROM (SELECT source, col, {k}, count(*) AS c FROM nv JOIN {s} USING (x) GROUP BY ALL) JOIN (SELECT source, col, count(*) AS n FROM nv GROUP BY ALL) USING (source, col)
  JOIN (SELECT {k}, count(*) AS m FROM {s} GROUP BY ALL) USING ({k}) WHERE c / least(n, m) >= 0.6),
{n}b AS (SELECT source, col, arg_min(name, (-overlap, name)) AS name, max(overlap) AS overlap FROM {n} GROUP BY 1, 2)"""
_NV = f"nv AS (SELECT DISTINCT source, col, {_norm('v')} AS x FROM dv)"
_LM = _MATCHED.format(n="lm", k="ln", s="lists")


@R.add("e10_match_reference_list", f"""WITH {_CELLS}, {_DV}, {_NV}, {_LISTS}, {_LM}
SELECT source, col AS "column", name AS list_name, round(overlap, 6) AS overlap, CASE WHEN overlap >= 0.8 THEN 'high' ELSE 'medium' END AS confidence FROM lmb""")
def e10(spark, sf):
    return semantic.match_reference_list(value_counts(_cells(spark, sf)), _lists(spark, sf)).withColumn("overlap", r6(F.col("overlap")))


def _prints(spark, sf):
    """Concept = brand, values = the part sizes seen with it."""
    return table(spark, sf, "part").groupBy(F.concat(F.lit("concept:"), "p_brand").alias("concept_id")).agg(
        F.collect_set(F.col("p_size").cast("string")).alias("sample_values"))


_PRINTS = "prints AS (SELECT DISTINCT 'concept:' || p_brand AS cid, CAST(p_size AS VARCHAR) AS x FROM part)"
_FM = _MATCHED.format(n="fm", k="cid", s="prints")


@R.add("e11_fingerprint_match", f"""WITH {_CELLS}, {_DV}, {_NV}, {_PRINTS}, {_FM}
SELECT source, col AS "column", name AS concept_id, round(overlap, 6) AS overlap, CASE WHEN overlap >= 0.8 THEN 'high' ELSE 'medium' END AS confidence FROM fmb""")
def e11(spark, sf):
    m = semantic.fingerprint_match(value_counts(_cells(spark, sf)), semantic.concept_values(_prints(spark, sf)))
    return m.withColumn("overlap", r6(F.col("overlap")))


def _like(words):
    return "(" + " OR ".join(f"contains(nm, '{w}')" for w in words) + ")"


_TYPES = f"""ta AS (SELECT source, col, {_norm('col')} AS nm, count(*) AS u, count(*) FILTER (regexp_matches(s, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})$')) AS dates, count(*) FILTER (regexp_matches(s, '^(19|20)\\d{{2}}$')) AS years,
  count(*) FILTER (regexp_matches(s, '^\\d{{8}}-\\d$')) AS duis, count(*) FILTER (regexp_matches(s, '^\\d{{4}}-\\d{{6}}-\\d{{3}}-\\d{{3}}$')) AS nits, count(*) FILTER (regexp_matches(s, '^[\\w.-]+@[\\w.-]+\\.\\w+$')) AS mails,
  count(*) FILTER (lower(s) IN ('s','n','si','no','y','t','f','true','false','verdadero','falso','0','1')) AS bins, count(*) FILTER (regexp_matches(s, '^-?[\\d.]+$')) AS digs,
  count(*) FILTER (regexp_matches(s, '^-?[\\d.]+$') AND TRY_CAST(s AS DOUBLE) > -1 AND TRY_CAST(s AS DOUBLE) < 121) AS ages, count(*) FILTER (regexp_matches(s, '^-?[\\d.,]+$')) AS nums,
  count(*) FILTER (regexp_matches(s, '^-?[\\d.,]+$') AND TRY_CAST(s AS DOUBLE) BETWEEN 0 AND 100) AS pcts, count(*) FILTER (regexp_matches(s, '^\\p{{Lu}}')) AS caps FROM (SELECT *, {q_strip('v')} AS s FROM dv) GROUP BY source, col),
ty AS (SELECT source, col, CASE WHEN dates > 0 THEN 'date' WHEN {_like(semantic.YEAR_NAMES)} AND years / u > 0.8 THEN 'year' WHEN duis > 0 THEN 'identifier_dui' WHEN nits > 0 THEN 'identifier_nit' WHEN mails > 0 THEN 'email'
  WHEN u <= 2 AND bins = u THEN 'boolean' WHEN u <= 120 AND digs > 0 AND ages = digs AND {_like(semantic.AGE_NAMES)} THEN 'age' WHEN nums > 0 AND pcts = nums AND {_like(semantic.PERCENT_NAMES)} THEN 'percentage'
  WHEN u > 2 AND u <= 500 AND nums = 0 AND caps / u > 0.7 THEN 'geographic_candidate' END AS kind FROM ta)"""
_TMAP = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in semantic.TYPE_CONCEPTS.items()) + " END"


def _infer_sql(all_cols="dv_all", prints=True):
    f = "LEFT JOIN fmb f ON f.source = c.source AND f.col = c.col" if prints else "LEFT JOIN (SELECT NULL AS name, NULL::DOUBLE AS overlap) f ON false"
    return f"""ij AS (SELECT c.source, c.col, kind, l.name AS ln, l.overlap AS lo, f.name AS fn, f.overlap AS fo, kind IS NOT NULL AND kind <> 'geographic_candidate' AS def FROM {all_cols} c LEFT JOIN ty t ON t.source = c.source AND t.col = c.col
  LEFT JOIN lmb l ON l.source = c.source AND l.col = c.col {f}),
inf AS (SELECT source, col, CASE WHEN def OR (ln IS NULL AND fn IS NULL) THEN kind END AS semantic_type, CASE WHEN NOT def THEN ln END AS reference_match, CASE WHEN NOT def AND ln IS NULL THEN fn END AS matched_concept,
  CASE WHEN def THEN 'high' WHEN coalesce(lo, fo) >= 0.8 THEN 'high' WHEN coalesce(lo, fo) IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN def THEN {_TMAP} ELSE coalesce(ln, fn) END AS suggested_concept,
  CASE WHEN def AND kind = 'date' THEN 'ISO_8601' END AS suggested_standard, CASE WHEN def THEN 0.0 ELSE coalesce(lo, fo, 0.0) END AS overlap FROM ij)"""


@R.add("e12_infer_semantic_type", f"""WITH {_CELLS}, {_DV}, {_NV}, {_LISTS}, {_LM}, {_PRINTS}, {_FM}, {_TYPES}, {_infer_sql()}
SELECT source, col AS "column", semantic_type, reference_match, matched_concept, confidence, suggested_concept, suggested_standard, round(overlap, 6) AS overlap FROM inf""")
def e12(spark, sf):
    i = semantic.infer_semantic_type(value_counts(_cells(spark, sf)), _lists(spark, sf), semantic.concept_values(_prints(spark, sf)))
    return i.withColumn("overlap", r6(F.col("overlap")))


# --- concepts of the cascade --------------------------------------------------------------

CONCEPTS = [("concept:01", "p_name", None), ("concept:02", "c_custkey", "NATIONS"), ("concept:03", "key", "REGIONS"), ("concept:04", "orderstatus_flag", None),
            ("concept:05", "dirty", None), ("concept:06", "correo_personal", None), ("concept:07", "toxic", "SEGMENT"), ("concept:08", "o", None)]


def _concepts(spark):
    return spark.createDataFrame(CONCEPTS, "concept_id string, name string, standard string")


_CON = "con(cid, name, standard) AS (VALUES " + ", ".join(f"('{a}', '{b}', {'NULL' if c is None else repr(c)})" for a, b, c in CONCEPTS) + ")"
_CLEAN = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(trim({c}), '(?i)^(col_|campo_|fld_|f_|c_|var_)', ''), '([A-Z])', '_\1', 'g')), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')"


def _facts(vf):
    return profile.column_facts(vf).select("source", "column", F.col("d_lower_ext").alias("unique_count"))


# the names are cleaned first; dv and dv_all then carry (source, col = clean name, raw column)
_DVC = f"""dv AS (SELECT DISTINCT source, {_CLEAN.format(c='"column"')} AS col, value AS v FROM cells WHERE NOT {q_missing('value')}),
dv_all AS (SELECT DISTINCT source, {_CLEAN.format(c='"column"')} AS col, "column" AS raw FROM cells)"""
_UQ = f"""uq AS (SELECT source, {_CLEAN.format(c='"column"')} AS col, count(DISTINCT lower({q_strip('value')})) FILTER (NOT {q_missing('value', True)}) AS u FROM cells GROUP BY 1, 2)"""
_SH = f"""sh AS (SELECT source, col, standard_id AS standard, c / n AS share FROM (SELECT source, col, standard_id, count(DISTINCT k) AS c FROM (SELECT source, col, upper({q_strip('v')}) AS k FROM dv) JOIN codes ON k = upper(code) GROUP BY 1, 2, 3)
  JOIN (SELECT source, col, count(DISTINCT upper({q_strip('v')})) AS n FROM dv GROUP BY 1, 2) USING (source, col))"""
_CASC = f"""s1 AS (SELECT source, col, 1 AS no, CASE standard_id WHEN 'NATIONS' THEN 's_nationkey' WHEN 'REGIONS' THEN 'n_regionkey' WHEN 'SEGMENT' THEN 'market_segment' END AS concept, standard_id AS standard, confidence, 'rule_based' AS method FROM std WHERE rank = 1),
s2 AS (SELECT source, col, 2 AS no, name, standard, CASE WHEN standard IS NULL OR u <= 1000 THEN 'high' ELSE 'medium' END, CASE WHEN standard IS NULL OR u <= 1000 THEN 'exact_name_match' ELSE 'exact_name_match_cardinality_mismatch' END FROM uq JOIN con ON name = col),
s3 AS (SELECT source, col, 3, arg_min(name, (-share, cid)), arg_min(standard, (-share, cid)), CASE WHEN max(share) >= 0.8 THEN 'high' ELSE 'medium' END, 'value_distribution_match' FROM sh JOIN con USING (standard) WHERE share >= 0.5 GROUP BY 1, 2),
pn AS (SELECT col, arg_min(struct_pack(n := name, s := standard), (-CASE WHEN list_has_any(string_split(col, '_'), string_split(name, '_')) THEN 0.7 ELSE 0.5 END, cid)) AS b, max(CASE WHEN list_has_any(string_split(col, '_'), string_split(name, '_')) THEN 0.7 ELSE 0.5 END) AS ns
  FROM (SELECT DISTINCT col FROM uq) JOIN con ON contains(col, name) OR contains(name, col) GROUP BY 1),
s4 AS (SELECT uq.source, uq.col, 4, b.n, b.s, CASE WHEN round(ns * 0.6 + coalesce(share, 0) * 0.4, 9) >= 0.6 THEN 'medium' ELSE 'low' END, 'partial_name_value_match' FROM uq JOIN pn USING (col) LEFT JOIN sh ON sh.source = uq.source AND sh.col = uq.col AND sh.standard = b.s
  WHERE round(ns * 0.6 + coalesce(share, 0) * 0.4, 9) >= 0.5),
s5 AS (SELECT source, col, 5, coalesce(matched_concept, suggested_concept), suggested_standard, confidence, 'inference_' || coalesce(semantic_type, reference_match, 'fingerprint') FROM inf WHERE confidence IN ('high', 'medium')),
s6 AS (SELECT source, col, 6, NULL, NULL, 'low', 'no_match' FROM uq),
alls AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4 UNION ALL SELECT * FROM s5 UNION ALL SELECT * FROM s6),
pick AS (SELECT source, col, arg_min(struct_pack(c := concept, s := standard, f := confidence, m := method), no) AS r FROM alls GROUP BY 1, 2),
maps AS (SELECT p.source, a.raw AS "column", p.col AS clean_name, r.c AS proposed_concept, r.s AS standard, r.f AS confidence, r.m AS method FROM pick p JOIN dv_all a USING (source, col))"""
_MAPS = f"{_CELLS}, {_CODES}, {_DVC}, {_std_sql()}, {_NV}, {_LISTS}, {_LM}, {_TYPES}, {_infer_sql(prints=False)}, {_UQ}, {_SH}, {_CON}, {_CASC}"


def _maps(spark, sf):
    vf = profile.settled(_cells(spark, sf))
    return semantic.match_to_concepts(vf, _facts(vf), STANDARDS, _codes(spark, sf), _concepts(spark), _lists(spark, sf))


@R.add("e13_match_to_concepts", f"WITH {_MAPS} SELECT * FROM maps")
def e13(spark, sf):
    return _maps(spark, sf)


@R.add("e26_discovery_gaps", f"""WITH {_MAPS}, {_DV.replace('dv AS', 'rv AS').replace('dv_all AS', 'rv_all AS')}, std_raw AS (SELECT m.source, m."column", s.standard_id FROM maps m JOIN std s ON s.source = m.source AND s.col = m.clean_name AND rank = 1)
SELECT m.source, m."column", coalesce(i.suggested_concept, m.clean_name) AS suggested_concept, coalesce(s.standard_id, i.suggested_standard) AS detected_standard,
 CASE WHEN coalesce(i.confidence, 'low') <> 'low' THEN i.confidence ELSE m.confidence END AS confidence FROM maps m LEFT JOIN inf i ON i.source = m.source AND i.col = m.clean_name LEFT JOIN std_raw s ON s.source = m.source AND s."column" = m."column" WHERE proposed_concept IS NULL""")
def e26(spark, sf):
    m = materialize(_maps(spark, sf))
    vf = profile.settled(_cells(spark, sf))
    names = m.select("source", "column", "clean_name")
    clean = vf.join(F.broadcast(names), ["source", "column"]).select("source", F.col("clean_name").alias("column"), "value", "cnt")

    def raw(df):
        return df.withColumnRenamed("column", "clean_name").join(names, ["source", "clean_name"]).drop("clean_name")

    inferred = raw(semantic.infer_semantic_type(clean, _lists(spark, sf)))
    found = raw(semantic.detect_standard(clean, STANDARDS, _codes(spark, sf)))
    return semantic.discovery_gaps(m, inferred, found)


@R.add("c18_resolution_coverage", f"""WITH {_MAPS} SELECT source, method, count(*) AS columns, round(count(*) / any_value(t), 6) AS share FROM maps JOIN (SELECT source, count(*) AS t FROM maps GROUP BY 1) USING (source) GROUP BY 1, 2""")
def c18(spark, sf):
    return semantic.resolution_coverage(_maps(spark, sf)).withColumn("share", r6(F.col("share")))


@R.add("c18_plan_confidence", f"""WITH {_MAPS}, t AS (SELECT source, count(*) AS columns, count(proposed_concept) AS mapped, count(*) FILTER (confidence = 'high') AS h, count(*) FILTER (confidence = 'medium') AS m FROM maps GROUP BY 1)
SELECT source, columns, mapped, CASE WHEN h > 0.6 * columns THEN 'high' WHEN h + m > 0.5 * columns THEN 'medium' ELSE 'low' END AS confidence, h <= 0.6 * columns AS requires_review FROM t""")
def c18b(spark, sf):
    return semantic.plan_confidence(_maps(spark, sf))


# --- assessment and registration ----------------------------------------------------------

def _assessed(spark, sf):
    return assess.assess_table(_cells(spark, sf), STANDARDS, _codes(spark, sf), _lists(spark, sf), semantic.concept_values(_prints(spark, sf)))


def _kw(words, alias):
    v = ", ".join(f"('{w}')" for w in words)
    return f"""(SELECT min(w) FROM (VALUES {v}) k(w) WHERE contains(lower(p."column"), w) OR contains(regexp_replace(lower(p."column"), '[_\\-\\s]', '', 'g'), w)) AS {alias}"""


_ASSESS = f"""{_CELLS}, {_CODES}, {_DV}, {_std_sql()}, {_NV}, {_LISTS}, {_LM}, {_PRINTS}, {_FM}, {_TYPES}, {_infer_sql()}, {_Q},
p AS (SELECT source, "column", {_STRICT} AS data_type, count(*) AS total_count, count(*) FILTER (NOT ok) AS null_count, count(DISTINCT value) FILTER (ok) AS unique_count FROM (SELECT *, NOT {q_missing('value')} AS ok FROM cells) GROUP BY 1, 2),
xs AS (SELECT source, "column", x FROM (SELECT source, "column", {q_num('value')} AS x FROM cells) WHERE x IS NOT NULL), bb AS (SELECT source, "column", {_IQR} FROM xs GROUP BY 1, 2 HAVING count(*) >= 4),
an AS (SELECT source, "column", count(*) FILTER (x < lo OR x > hi) AS a FROM xs JOIN bb USING (source, "column") GROUP BY 1, 2),
ad AS (SELECT p.source, p."column", data_type, p.total_count, null_count, unique_count, score, {q_grade('score')} AS grade, concat_ws(',', CASE WHEN null_count / total_count > 0.5 THEN 'alta_nulidad' END, CASE WHEN unique_count = 1 AND total_count > 5 THEN 'columna_constante' END,
   CASE WHEN unique_count = total_count THEN 'clave_primaria' END, CASE WHEN completeness < 0.5 THEN 'alta nulidad' WHEN completeness < 0.9 THEN 'nulidad moderada' END) AS issues,
  CASE WHEN data_type IN ('integer', 'float') THEN coalesce(a, 0) ELSE 0 END AS anomaly_count, coalesce(semantic_type, reference_match) AS inferred_type, {_kw(privacy.PII_WORDS, 'pw')}, {_kw(privacy.SENSITIVE_WORDS, 'sw')},
  CASE WHEN matched_concept IS NOT NULL THEN 'matched' WHEN i.confidence IN ('high', 'medium') AND suggested_concept IS NOT NULL THEN 'inferred' WHEN s.standard_id IS NOT NULL THEN 'inferred' ELSE 'unmatched' END AS match_status
  FROM p JOIN q3 USING (source, "column") LEFT JOIN an USING (source, "column") LEFT JOIN inf i ON i.source = p.source AND i.col = p."column" LEFT JOIN std s ON s.source = p.source AND s.col = p."column" AND s.rank = 1)"""


@R.add("c17_assess_table", f"""WITH {_ASSESS} SELECT source, "column", data_type, total_count, null_count, unique_count, score, grade, issues, anomaly_count, inferred_type, pw IS NOT NULL AS is_pii, pw IS NULL AND sw IS NOT NULL AS is_sensitive, match_status FROM ad""")
def c17(spark, sf):
    a = _assessed(spark, sf)
    return a.select("source", "column", "data_type", "total_count", "null_count", "unique_count", "score", "grade", F.array_join("issues", ",").alias("issues"),
                    "anomaly_count", "inferred_type", "is_pii", "is_sensitive", "match_status")


@R.add("c17_assessment_rollup", f"""WITH {_ASSESS}, r AS (SELECT source, count(*) AS columns, max(total_count) AS total_rows, avg(score) AS s, count(*) FILTER (match_status = 'matched') AS matched, count(*) FILTER (match_status = 'inferred') AS inferred,
 count(*) FILTER (match_status = 'unmatched') AS unmatched, count(*) FILTER (pw IS NOT NULL) AS pii, count(*) FILTER (pw IS NULL AND sw IS NOT NULL) AS sensitive, count(*) FILTER (issues <> '') AS with_issues FROM ad GROUP BY 1)
SELECT * EXCLUDE (s), round(s, 6) AS avg_score, {q_grade('s')} AS grade FROM r""")
def c17b(spark, sf):
    return assess.assessment_rollup(_assessed(spark, sf)).withColumn("avg_score", r6(F.col("avg_score")))


_REG = f"""{_MAPS}, {_INGEST_SQL.replace('it AS', 'it0 AS')}, it AS (SELECT it0.*, m.clean_name, 'field:' || source || '.' || m.clean_name AS fid FROM it0 JOIN maps m USING (source, "column")),
iss AS (SELECT fid, 'alta_nulidad' AS t FROM it WHERE (total - n) / total > 0.5 UNION ALL SELECT fid, 'columna_constante' FROM it WHERE uniq = 1 AND total > 5 UNION ALL SELECT fid, 'clave_primaria' FROM it WHERE uniq = total
 UNION ALL SELECT fid, 'tipo_no_detectado' FROM it WHERE data_type = 'unknown'),
fresh AS (SELECT 'concept:' || proposed_concept AS id, min(standard) AS standard FROM maps WHERE proposed_concept IS NOT NULL AND proposed_concept NOT IN (SELECT name FROM con) GROUP BY 1)"""


@R.add("i1_register_nodes", f"""WITH {_REG} SELECT DISTINCT 'source:' || source AS id, 'source' AS type FROM maps UNION ALL SELECT fid, 'field' FROM it UNION ALL SELECT id, 'concept' FROM fresh
 UNION ALL SELECT DISTINCT 'classifier:' || lower(standard), 'classifier' FROM fresh WHERE standard IN (SELECT standard_id FROM codes) UNION ALL SELECT 'issue:' || fid || ':' || t, 'quality_issue' FROM iss""")
def i1(spark, sf):
    return assess.register_sources(_cells(spark, sf), STANDARDS, _codes(spark, sf), _concepts(spark), _lists(spark, sf))[0].select("id", "type")


@R.add("i1_register_edges", f"""WITH {_REG} SELECT fid AS src, 'source:' || source AS dst, 'proviene_de' AS type FROM it UNION ALL SELECT 'field:' || source || '.' || clean_name, 'concept:' || proposed_concept, 'implementa' FROM maps WHERE proposed_concept IS NOT NULL
 UNION ALL SELECT id, 'classifier:' || lower(standard), 'usa_clasificador' FROM fresh WHERE standard IN (SELECT standard_id FROM codes) UNION ALL SELECT fid, 'issue:' || fid || ':' || t, 'tiene_issue' FROM iss""")
def i1b(spark, sf):
    return assess.register_sources(_cells(spark, sf), STANDARDS, _codes(spark, sf), _concepts(spark), _lists(spark, sf))[1].select("src", "dst", "type")


@R.add("b20_infer_context", """WITH s AS (SELECT DISTINCT CASE p_type WHEN 'ECONOMY' THEN 'Censo Agricola ' WHEN 'LARGE' THEN 'MAG ' WHEN 'MEDIUM' THEN 'Hospital ' WHEN 'PROMO' THEN 'padron ' ELSE 'otro ' END || p_name AS source FROM part)
SELECT source, CASE WHEN source LIKE 'Censo%' THEN 'censo_agricola' WHEN source LIKE 'MAG%' THEN 'agricola' WHEN source LIKE 'Hosp%' THEN 'hospital' WHEN source LIKE 'padron%' THEN 'registro' ELSE source END AS context_label,
 CASE WHEN source LIKE 'Censo%' OR source LIKE 'MAG%' THEN 'productores agricolas' WHEN source LIKE 'Hosp%' THEN 'pacientes atendidos' WHEN source LIKE 'padron%' THEN 'poblacion registrada' ELSE 'no definida' END AS population,
 CASE WHEN source LIKE 'Censo%' OR source LIKE 'MAG%' THEN 'censo' WHEN source LIKE 'Hosp%' THEN 'registro clinico' WHEN source LIKE 'padron%' THEN 'registro administrativo' ELSE 'no definida' END AS capture_method FROM s""")
def b20(spark, sf):
    t = F.col("p_type")
    pre = F.when(t == "ECONOMY", "Censo Agricola ").when(t == "LARGE", "MAG ").when(t == "MEDIUM", "Hospital ").when(t == "PROMO", "padron ").otherwise("otro ")
    return semantic.infer_context(table(spark, sf, "part").select(F.concat(pre, "p_name").alias("source")).distinct())


# --- enrichment and candidates ------------------------------------------------------------

@R.add("e19_interop_candidates", f"""WITH {_MAPS}, s AS (SELECT DISTINCT source AS t FROM maps)
SELECT source, "column", proposed_concept AS concept, confidence, t AS target_source FROM maps JOIN s ON t <> source WHERE proposed_concept IS NOT NULL""")
def e19(spark, sf):
    m = _maps(spark, sf)
    src = m.select(F.col("source").alias("name")).distinct()
    return semantic.interop_candidates(m.select("source", "column", F.col("proposed_concept").alias("concept"), "confidence"), src)


_META = """meta(k, concept, standard, definition) AS (VALUES ('p_brand', 'marca', 'BRANDS', 'brand of the part'), ('o_totalprice', 'precio', NULL, 'price of the order'), ('activo', 'estado', NULL, 'state'))"""


@R.add("e20_enrich_columns", f"""WITH {_MAPS}, {_META} SELECT m.source, m."column", CASE WHEN proposed_concept IS NULL AND k IS NOT NULL THEN 'enriched' WHEN proposed_concept IS NULL THEN 'unmatched' ELSE 'matched' END AS match_status,
 coalesce(proposed_concept, concept) AS concept, CASE WHEN proposed_concept IS NULL THEN coalesce(m.standard, meta.standard) ELSE m.standard END AS standard, definition FROM maps m LEFT JOIN meta ON k = lower(m."column")""")
def e20(spark, sf):
    m = _maps(spark, sf)
    a = m.select("source", "column", F.when(F.col("proposed_concept").isNull(), "unmatched").otherwise("matched").alias("match_status"),
                 F.col("proposed_concept").alias("concept"), "standard")
    meta = spark.createDataFrame([("P_Brand", "marca", "BRANDS", "brand of the part"), ("o_totalprice", "precio", None, "price of the order"), ("activo", "estado", None, "state")],
                                 "column_name string, concept string, standard string, definition string")
    return semantic.enrich_columns(a, meta)


@R.add("e28_map_synonyms", f"""WITH {_CELLS} SELECT DISTINCT source, "column", CASE WHEN lower("column") IN ('id', 'c_custkey', 'p_partkey') THEN 'id' WHEN lower("column") IN ('name', 'c_name', 'p_name', 'n_name') THEN 'name' WHEN lower("column") = 'segmento' THEN 'segment' END AS canonical FROM cells""")
def e28(spark, sf):
    cols = _cells(spark, sf).select("source", "column").distinct()
    return semantic.map_synonyms(cols, {"id": ["C_CUSTKEY", "p_partkey"], "name": ["c_name", "p_name", "n_name"], "segment": ["segmento"]})


# --- feasibility --------------------------------------------------------------------------

# variables: part names, their last word, a field name, and texts that only share keywords
def _variables(spark, sf):
    p = table(spark, sf, "part")
    a = p.select(F.col("p_name").alias("name"), F.lit("").alias("description"))
    b = p.select(F.element_at(F.split("p_name", " "), -1).alias("name"), F.lit("").alias("description"))
    c = p.select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name"), F.lit("").alias("description"))
    d = p.select(F.concat(F.lit("zz_"), F.lower("p_type")).alias("name"), F.concat(F.lit("any "), F.element_at(F.split("p_name", " "), -1)).alias("description"))
    e = p.select(F.concat(F.lit("qq "), F.lower("p_brand")).alias("name"), F.lit("nothing").alias("description"))
    return a.union(b).union(c).union(d).union(e).groupBy("name").agg(F.min("description").alias("description"))


_FEAS = f"""{CATALOG_SQL}, vr AS (SELECT name, min(d) AS description FROM (SELECT p_name AS name, '' AS d FROM part UNION ALL SELECT split_part(p_name, ' ', -1), '' FROM part UNION ALL SELECT 'part_' || p_partkey, '' FROM part
 UNION ALL SELECT 'zz_' || lower(p_type), 'any ' || split_part(p_name, ' ', -1) FROM part UNION ALL SELECT 'qq ' || lower(p_brand), 'nothing' FROM part) GROUP BY 1),
cn AS (SELECT name AS cname, min(id) AS cid FROM concepts GROUP BY 1), fn AS (SELECT "column" AS fname, min(concept_id) AS cid FROM fields GROUP BY 1),
m1 AS (SELECT vr.name, cid, 1 AS step FROM vr JOIN cn ON cname = vr.name), m2 AS (SELECT vr.name, min(cid) AS cid, 2 AS step FROM vr JOIN cn ON contains(cname, vr.name) OR contains(vr.name, cname) GROUP BY 1),
m3 AS (SELECT vr.name, cid, 3 AS step FROM vr JOIN fn ON fname = vr.name),
vt AS (SELECT DISTINCT name, unnest(string_split(replace(name, '_', ' '), ' ')) AS w FROM vr), ft AS (SELECT DISTINCT cid, fname, unnest(string_split(fname, '_')) AS w FROM fn),
m4 AS (SELECT name, min(cid) AS cid, 4 AS step FROM (SELECT vt.name, fname, any_value(cid) AS cid, count(*) AS n FROM vt JOIN ft USING (w) GROUP BY 1, 2) x JOIN (SELECT name, count(*) AS nv FROM vt GROUP BY 1) USING (name) WHERE n >= least(nv, 2) GROUP BY 1),
m0 AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM m4),
vk AS (SELECT DISTINCT name, w FROM (SELECT name, unnest(string_split(replace(lower(name), '_', ' ') || ' ' || description, ' ')) AS w FROM vr WHERE name NOT IN (SELECT name FROM m0)) WHERE w <> ''),
ck AS (SELECT DISTINCT cid, w FROM (SELECT id AS cid, unnest(string_split(name || ' ' || definition, ' ')) AS w FROM concepts) WHERE w <> ''),
m5 AS (SELECT name, arg_min(cid, (-n, cid)) AS cid, 5 AS step FROM (SELECT name, cid, count(*) AS n FROM vk JOIN ck USING (w) GROUP BY 1, 2) JOIN (SELECT name, count(*) AS nv FROM vk GROUP BY 1) USING (name) WHERE n / nv >= 0.15 GROUP BY 1),
mm AS (SELECT name, arg_min(cid, step) AS concept_id, min(step) AS step FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m5) GROUP BY 1),
cq AS (SELECT concept_id, coalesce(avg(quality_score) FILTER (quality_score > 0), 0) AS q, count(*) AS n, count(DISTINCT source_db) AS s FROM fields GROUP BY 1),
fe AS (SELECT vr.name, CASE WHEN mm.concept_id IS NULL THEN 'gap' ELSE 'available' END AS status, mm.concept_id, step, coalesce(n, 0) AS field_count, coalesce(s, 0) AS sources, round(coalesce(q, 0) + 1e-9, 6) AS quality_score,
  coalesce(n > 0 AND q >= 0.4 AND c.review_status NOT IN ('proposed', 'rejected'), false) AS usable FROM vr LEFT JOIN mm USING (name) LEFT JOIN concepts c ON c.id = mm.concept_id LEFT JOIN cq ON cq.concept_id = mm.concept_id)"""


@R.add("e24_feasibility", f"WITH {_FEAS} SELECT * FROM fe")
def e24(spark, sf):
    n, e, _, _ = catalog(spark, sf, ("fields",))
    return feasibility.feasibility(_variables(spark, sf), n, e).withColumn("quality_score", F.round(F.col("quality_score") + 1e-9, 6))


@R.add("e24_coverage", f"WITH {_FEAS} SELECT count(*) AS total, count(*) FILTER (status = 'available') AS available, count(*) FILTER (status = 'gap') AS gaps, round(count(*) FILTER (status = 'available') / count(*) * 100, 6) AS percentage FROM fe")
def e24b(spark, sf):
    n, e, _, _ = catalog(spark, sf, ("fields",))
    return feasibility.coverage(feasibility.feasibility(_variables(spark, sf), n, e)).withColumn("percentage", r6(F.col("percentage")))


# a hypothesis is a user; its variables are the events, errors are gaps, the type is the source
@R.add("e25_rank_opportunities", """WITH t AS (SELECT user_id AS hypothesis, count(*) AS n, count(*) FILTER (event_type <> 'error') AS available, coalesce(avg(value / 500) FILTER (event_type <> 'error'), 0) AS q, count(DISTINCT event_type) FILTER (event_type <> 'error') AS s FROM events GROUP BY 1)
SELECT hypothesis, n, available, round(q, 6) AS avg_quality, s > 1 AS cross_domain, round(available / n * q * CASE WHEN s > 1 THEN 1.5 ELSE 1.0 END + least(n / 10.0, 0.3), 6) AS score FROM t""")
def e25(spark, sf):
    v = table(spark, sf, "events").select(
        F.col("user_id").alias("hypothesis"), F.when(F.col("event_type") == "error", "gap").otherwise("available").alias("status"),
        (F.col("value") / 500).alias("quality_score"), F.col("event_type").alias("source"))
    return feasibility.rank_opportunities(v).withColumns({c: r6(F.col(c)) for c in ("avg_quality", "score")})
