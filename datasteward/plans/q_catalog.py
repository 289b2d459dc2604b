"""Queries: the catalog graph, interoperability, harmonisation, health and lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from datasteward.operators import catalog as cat
from datasteward.operators import harmonize, health, interop, lifecycle
from datasteward.plans.base import Registry, r6, table
from datasteward.plans.catalog_data import CATALOG_SQL, catalog

R = Registry()
TODAY = "2024-06-30"
W = f"WITH {CATALOG_SQL}"


def _round(df, *cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


# --- scalar factors -----------------------------------------------------------------------

@R.add("b17_staleness_factor", f"""SELECT o_orderkey, round(greatest(0.0, 1 - datediff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') / 365.0), 6) AS factor FROM orders""")
def b17(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", r6(interop.staleness_factor(F.col("o_orderdate"), "2001-08-02")).alias("factor"))


@R.add("b18_review_factor", f"{W} SELECT id, CASE review_status WHEN 'approved' THEN 1.0 WHEN 'under_review' THEN 0.5 ELSE 0.0 END::DOUBLE AS factor FROM fields")
def b18(spark, sf):
    n, _, _, _ = catalog(spark, sf, ())
    return cat.listing(n, "field").filter("source_db <> 'legacy'").select("id", interop.review_factor(F.col("review_status")).alias("factor"))


# --- sources and sinks of the graph -------------------------------------------------------

@R.add("a5_graph_round_trip", f"{W} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def a5(spark, sf):
    from datasteward.sources import shared, sinks
    n, e, _, _ = catalog(spark, sf, ("fields",))
    path = f"{shared.shared_dir(spark)}/json-{spark.sparkContext.applicationId}-{sf.rsplit('/', 1)[-1]}"
    sinks.write_graph_json(n, e, path)
    return sinks.read_graph_json(spark, path, n.schema, e.schema)[0].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@R.add("a7_export_entities", f"""{W} SELECT id, CASE type WHEN 'quality_issue' THEN 'QualityIssue' ELSE upper(type[1]) || type[2:] END AS type, coalesce(name, id) AS name,
 standard, review_status, source_db FROM nodes""")
def a7(spark, sf):
    n, _, _, _ = catalog(spark, sf, ("fields",))
    return cat.export_entities(n).select("id", "type", "name", "standard", "review_status", "source_db")


@R.add("a7_export_relationships", f"{W} SELECT src AS source, dst AS target, type FROM edges")
def a7b(spark, sf):
    return cat.export_relationships(catalog(spark, sf, ("fields",))[1]).select("source", "target", "type")


@R.add("a10_upsert", """SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2""")
def a10(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    half = e.filter("value >= 50"), e.filter("value < 50")
    return cat.upsert(half[0], half[1], ["user_id", "event_type"], "event_id")


# --- lookups ------------------------------------------------------------------------------

@R.add("b27_visible_concepts", f"{W} SELECT id, name, review_status FROM concepts WHERE review_status NOT IN ('proposed', 'rejected')")
def b27(spark, sf):
    return cat.listing(catalog(spark, sf, ())[0], "concept", include_proposed=False).select("id", "name", "review_status")


@R.add("b27_sensitive", f"{W} SELECT id, type, data_classification FROM nodes WHERE data_classification IN ('pii', 'sensible')")
def b27b(spark, sf):
    return cat.sensitive(catalog(spark, sf, ())[0]).select("id", "type", "data_classification")


@R.add("b27_pending", f"{W} SELECT id, type, review_status FROM nodes WHERE review_status IN ('proposed', 'under_review')")
def b27c(spark, sf):
    return cat.pending(catalog(spark, sf, ())[0]).select("id", "type", "review_status")


@R.add("b27_fields_of_source", f"{W} SELECT id, source_db, \"column\" FROM fields WHERE source_db = 'supplier_1'")
def b27d(spark, sf):
    return cat.listing(catalog(spark, sf, ())[0], "field", source_db="supplier_1").select("id", "source_db", "column")


def _nb(kind, direction):
    def run(spark, sf):
        n, e, _, _ = catalog(spark, sf, ())
        return cat.neighbors(n, e, kind, direction).select("id", "neighbor_id", "name")
    return run


for _name, _kind, _dir in (("fields", "implementa", "in"), ("classifier", "usa_clasificador", "out"), ("norms", "respaldado_por", "out"),
                           ("issues", "tiene_issue", "out"), ("insights", "generates_insight", "out"), ("components", "compone", "out"),
                           ("composites", "compone", "in"), ("meanings", "tiene_contexto", "out"), ("anonymization", "aplica_anonimizacion", "out")):
    _own, _other = ("src", "dst") if _dir == "out" else ("dst", "src")
    R.add(f"e27_{_name}", f"{W} SELECT e.{_own} AS id, e.{_other} AS neighbor_id, n.name FROM edges e JOIN nodes n ON n.id = e.{_other} WHERE e.type = '{_kind}'")(_nb(_kind, _dir))


@R.add("c14_quality_summary", f"""{W}, f AS (SELECT id, source_db, quality_score AS s FROM fields UNION ALL SELECT id, 'legacy', 0.0 FROM orphans)
SELECT source_db, count(*) AS total_fields, round(avg(s) + 1e-9, 6) AS avg_quality, count(*) FILTER (s < 0.5) AS low_quality,
 (SELECT count(*) FROM issues i WHERE i.source_db = f.source_db AND severity = 'error') AS errors,
 (SELECT count(*) FROM issues i WHERE i.source_db = f.source_db AND severity = 'warning') AS warnings, 0 AS infos FROM f GROUP BY source_db""")
def c14(spark, sf):
    n, e, _, _ = catalog(spark, sf, ("fields",))
    return cat.quality_summary(n, e).withColumn("avg_quality", F.round(F.col("avg_quality") + 1e-9, 6))


@R.add("c15_graph_stats", f"""{W} SELECT 'node' AS kind, coalesce(type, 'total') AS type, count(*) AS n FROM nodes GROUP BY ROLLUP(type)
 UNION ALL SELECT 'edge', coalesce(type, 'total'), count(*) FROM edges GROUP BY ROLLUP(type)""")
def c15(spark, sf):
    n, e, _, _ = catalog(spark, sf, ("fields",))
    return cat.graph_stats(n, e)


_COV = """c AS (SELECT count(*) AS total, count(*) FILTER (coalesce(review_status, 'approved') = 'approved') AS approved, count(*) FILTER (review_status = 'proposed') AS proposed,
 count(*) FILTER (review_status = 'under_review') AS under_review, count(*) FILTER (review_status = 'rejected') AS rejected FROM nodes)"""


@R.add("c16_review_coverage", f"""{W}, {_COV} SELECT total, approved, proposed, under_review, rejected, total - approved - proposed - under_review - rejected AS other,
 round(approved / total * 100, 6) AS pct_approved, round(proposed / total * 100, 6) AS pct_proposed, round((proposed + under_review) / total * 100, 6) AS pct_pending FROM c""")
def c16(spark, sf):
    return _round(cat.review_coverage(catalog(spark, sf, ("fields",))[0]), "pct_approved", "pct_proposed", "pct_pending")


@R.add("i18_catalog_listing", f"""{W} SELECT c.id AS concept_id, c.name, c.standard, c.definition, c.custodian, c.review_status, coalesce(s.sources, 0) AS sources, coalesce(s.fields, 0) AS fields,
 CASE WHEN c.p_size >= 20 THEN 1 ELSE 0 END AS citations FROM concepts c LEFT JOIN (SELECT concept_id, count(DISTINCT source_db) AS sources, count(*) AS fields FROM fields GROUP BY 1) s ON s.concept_id = c.id
 WHERE c.review_status NOT IN ('proposed', 'rejected')""")
def i18(spark, sf):
    n, e, _, _ = catalog(spark, sf, ())
    return cat.catalog_listing(n, e)


@R.add("i17_governance_gaps", f"""{W} SELECT id AS concept_id, 'normative' AS gap FROM concepts WHERE p_size < 20 UNION ALL SELECT id, 'custodian' FROM concepts WHERE custodian = ''
 UNION ALL SELECT id, 'population' FROM concepts WHERE population = '' UNION ALL SELECT id, 'capture_method' FROM concepts WHERE capture_method = '' UNION ALL SELECT id, 'standard' FROM concepts WHERE standard IS NULL""")
def i17(spark, sf):
    n, e, _, _ = catalog(spark, sf, ())
    return cat.governance_gaps(n, e)


@R.add("i15_source_insights", f"{W} SELECT source_id, round(avg(quality_score) + 1e-9, 6) AS avg_quality, count(*) AS field_count, count(*) FILTER (quality_score < 0.4) AS low_quality_count FROM fields GROUP BY 1")
def i15(spark, sf):
    n, e, _, _ = catalog(spark, sf, ())
    return cat.source_insights(n, e).withColumn("avg_quality", F.round(F.col("avg_quality") + 1e-9, 6))


@R.add("i15_cross_source_concepts", f"{W} SELECT concept_id, count(DISTINCT source_db) AS sources FROM fields GROUP BY 1 HAVING count(DISTINCT source_db) > 1")
def i15b(spark, sf):
    n, e, _, _ = catalog(spark, sf, ())
    return cat.cross_source_concepts(n, e)


@R.add("i14_context_conflicts", f"{W} SELECT concept_id, any_value(c.name) AS name, count(*) AS meanings FROM contexts x JOIN concepts c ON c.id = x.concept_id GROUP BY 1 HAVING count(*) > 1")
def i14(spark, sf):
    n, e, _, _ = catalog(spark, sf, ())
    return cat.context_conflicts(n, e)


@R.add("i13_classifier_hierarchy", f"""{W} SELECT 'classifier:TYPE_' || p_type AS id, 'parent' AS relation, 'classifier:TYPES' AS neighbor_id, 'types' AS name FROM types
 UNION ALL SELECT 'classifier:TYPES', 'child', 'classifier:TYPE_' || p_type, p_type FROM types""")
def i13(spark, sf):
    n, e, _, _ = catalog(spark, sf, ())
    return cat.classifier_hierarchy(n, e)


@R.add("i13_classifier_equivalents", f"""{W} SELECT src AS id, dst AS neighbor_id, cardinality, cardinality <> '1:1' AS needs_review FROM cls_equiv
 UNION ALL SELECT dst, src, cardinality, cardinality <> '1:1' FROM cls_equiv""")
def i13b(spark, sf):
    n, e, _, _ = catalog(spark, sf, ("equivalents",))
    return cat.classifier_equivalents(n, e)


@R.add("e21_concept_context", f"""{W}, m AS (SELECT concept_id FROM contexts GROUP BY 1 HAVING count(*) > 1)
SELECT concept_id, 'field' AS section, id AS ref_id, source_db AS detail, round(quality_score + 1e-9, 6) AS score FROM fields
UNION ALL SELECT f.concept_id, 'quality_issue', i.id, i.severity, NULL FROM issues i JOIN fields f ON f.id = i.field_id
UNION ALL SELECT id, 'classifier', 'classifier:' || standard, standard[6:], NULL FROM concepts WHERE standard IS NOT NULL
UNION ALL SELECT id, 'normative', 'normative:' || p_brand, p_brand, NULL FROM concepts WHERE p_size >= 20
UNION ALL SELECT concept_id, 'context_conflict', id, r_name, NULL FROM contexts WHERE concept_id IN (SELECT concept_id FROM m)
UNION ALL SELECT dst, 'composite', src, operation, NULL FROM edges WHERE type = 'compone'
UNION ALL SELECT e.dst, 'derived_from', e.src, c.name, NULL FROM edges e JOIN concepts c ON c.id = e.src WHERE e.type = 'deriva_de'
UNION ALL SELECT concept_id, 'quality_summary', concept_id, CAST(count(*) AS VARCHAR), round(coalesce(avg(quality_score) FILTER (quality_score > 0), 0) + 1e-9, 6) FROM fields GROUP BY concept_id""")
def e21(spark, sf):
    n, e, _, _ = catalog(spark, sf, ("fields",))
    return cat.concept_context(n, e).withColumn("score", F.round(F.col("score") + 1e-9, 6))


@R.add("e22_impact", f"""{W}, s AS (SELECT concept_id, source_db, count(*) AS k FROM fields GROUP BY 1, 2), f AS (SELECT concept_id, sum(k) AS n, sum(k * k) AS q FROM s GROUP BY 1),
x AS (SELECT c.id AS concept_id, coalesce(n, 0) AS fields, CASE WHEN c.review_status IN ('proposed', 'rejected') THEN 0 ELSE coalesce(n * n - q, 0) END AS interop_paths,
 (SELECT count(*) FROM edges e WHERE e.type = 'compone' AND e.dst = c.id) AS composites, (SELECT count(*) FROM edges e WHERE e.type = 'deriva_de' AND e.dst = c.id) AS derived_from,
 (SELECT count(*) FROM edges e WHERE e.type = 'deriva_de' AND e.src = c.id) AS derives_to, CASE WHEN standard IS NULL THEN 0 ELSE 1 END AS classifiers, CASE WHEN p_size >= 20 THEN 1 ELSE 0 END AS normatives,
 (SELECT count(*) FROM fields g WHERE g.concept_id = c.id AND total_count >= 3) AS transform_operations FROM concepts c LEFT JOIN f ON f.concept_id = c.id)
SELECT concept_id, CAST(fields AS BIGINT) AS fields, CAST(interop_paths AS BIGINT) AS interop_paths, composites, derived_from, derives_to, CAST(classifiers AS BIGINT) AS classifiers,
 CAST(normatives AS BIGINT) AS normatives, transform_operations, CAST(fields + interop_paths + composites + derived_from + derives_to + classifiers + normatives + transform_operations AS BIGINT) AS total_impact FROM x""")
def e22(spark, sf):
    n, e, _, _ = catalog(spark, sf, ("fields",))
    return cat.impact(n, e)


# --- interoperability ---------------------------------------------------------------------

def _pairs(spark, sf):
    """Every source with the one that follows it."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    nxt = s.select((F.col("k") - 1).alias("k"), F.col("k").alias("k2"))
    return s.join(nxt, "k").select(F.concat(F.lit("supplier_"), F.col("k").cast("string")).alias("src_db"),
                                   F.concat(F.lit("supplier_"), F.col("k2").cast("string")).alias("dst_db"))


def _paths(spark, sf):
    n, e, codes, mapping = catalog(spark, sf, ("counts", "equivalents"))
    return interop.interop_paths(n, e, _pairs(spark, sf)), n, e, codes


_PATHS = f"""pr AS (SELECT 'supplier_' || a.s_suppkey AS src_db, 'supplier_' || b.s_suppkey AS dst_db FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1),
eb AS (SELECT src AS fa, dst AS fb, confidence, 0 AS back FROM equiv UNION ALL SELECT dst, src, confidence, 1 FROM equiv),
e1 AS (SELECT fa, fb, arg_min(confidence, back) AS confidence FROM eb GROUP BY 1, 2),
paths AS (SELECT a.source_db AS src_db, b.source_db AS dst_db, a.id AS field_a, b.id AS field_b, a.concept_id, c.review_status AS concept_status, c.standard AS cstd,
  CASE WHEN c.standard IS NOT NULL THEN 'classifier:' || c.standard END AS classifier_id, 'shared_concept' AS match_type, NULL::DOUBLE AS confidence
  FROM pr JOIN fields a ON a.source_db = src_db JOIN fields b ON b.source_db = dst_db AND b.concept_id = a.concept_id JOIN concepts c ON c.id = a.concept_id WHERE c.review_status NOT IN ('proposed', 'rejected')
 UNION ALL SELECT a.source_db, b.source_db, a.id, b.id, a.concept_id, c.review_status, c.standard, NULL, 'value_equivalence', confidence
  FROM e1 JOIN fields a ON a.id = fa JOIN fields b ON b.id = fb JOIN pr ON src_db = a.source_db AND dst_db = b.source_db JOIN concepts c ON c.id = a.concept_id)"""
_CHECK = f"""{_PATHS},
ck AS (SELECT p.*, a.population = b.population AS pop, a.capture_method = b.capture_method AS cap, a.standard AS sa, b.standard AS sb,
  least(a.unique_count, b.unique_count) / greatest(a.unique_count, b.unique_count) AS ratio, abs(a.null_count / a.total_count - b.null_count / b.total_count) AS gap,
  len(a.sample_values) > 2 AND len(b.sample_values) > 2 AND len(list_intersect(a.sample_values, b.sample_values)) / len(list_distinct(list_concat(a.sample_values, b.sample_values))) < 0.2 AS low,
  a.completeness AS ca, b.completeness AS cb, a.sample_values AS va, b.sample_values AS vb
  FROM paths p JOIN fields a ON a.id = field_a JOIN fields b ON b.id = field_b),
cs AS (SELECT *, CASE WHEN pop THEN 'match' ELSE 'mismatch' END AS population, CASE WHEN cap THEN 'match' ELSE 'mismatch' END AS capture,
  CASE WHEN sa IS NULL AND sb IS NULL THEN 'unknown' WHEN coalesce(sa, '') = coalesce(sb, '') THEN 'match' ELSE 'mismatch' END AS classifier,
  CASE WHEN ratio < 0.3 OR gap > 0.3 OR low THEN 'mismatch' WHEN ratio < 0.7 OR gap > 0.15 THEN 'unknown' ELSE 'match' END AS distribution,
  concat_ws(';', CASE WHEN ratio < 0.3 THEN 'cardinalidad muy diferente' WHEN ratio < 0.7 THEN 'cardinalidad discrepante' END,
   CASE WHEN gap > 0.3 THEN 'nulos muy diferentes' WHEN gap > 0.15 THEN 'nulos discrepantes' END, CASE WHEN low THEN 'pocos valores compartidos' END) AS dd FROM ck)"""


@R.add("e14_interop_paths", f"{W}, {_PATHS} SELECT src_db, dst_db, field_a, field_b, concept_id, concept_status, classifier_id, match_type, round(confidence, 6) AS confidence FROM paths")
def e14(spark, sf):
    return _round(_paths(spark, sf)[0], "confidence")


@R.add("f1_interop_checkpoints", f"""{W}, {_CHECK} SELECT field_a, field_b, match_type, 'population' AS checkpoint, population AS status, '' AS detail FROM cs
 UNION ALL SELECT field_a, field_b, match_type, 'capture', capture, '' FROM cs UNION ALL SELECT field_a, field_b, match_type, 'classifier', classifier, '' FROM cs
 UNION ALL SELECT field_a, field_b, match_type, 'distribution', distribution, dd FROM cs""")
def f1(spark, sf):
    p, n, _, _ = _paths(spark, sf)
    return interop.interop_checkpoints(interop.with_fields(p, n))


@R.add("f2_interop_verdict", f"""{W}, {_CHECK}, v AS (SELECT *, (population = 'mismatch')::INT + (capture = 'mismatch')::INT + (classifier = 'mismatch')::INT + (distribution = 'mismatch')::INT AS mismatches,
  (population = 'unknown')::INT + (capture = 'unknown')::INT + (classifier = 'unknown')::INT + (distribution = 'unknown')::INT AS unknowns, concept_status NOT IN ('proposed', 'rejected') AS open FROM cs)
SELECT field_a, field_b, match_type, mismatches, unknowns, open AND mismatches = 0 AS is_safe, CASE WHEN open AND mismatches = 0 AND unknowns = 0 THEN 'INTEROPERABILIDAD SEGURA'
 WHEN open AND mismatches = 0 THEN 'INTEROPERABILIDAD PROBABLE' WHEN mismatches = 1 THEN 'INTEROPERABILIDAD CONDICIONAL' ELSE 'INTEROPERABILIDAD NO RECOMENDADA' END AS recommendation FROM v""")
def f2(spark, sf):
    p, n, _, _ = _paths(spark, sf)
    return interop.interop_verdict(interop.with_fields(p, n))


@R.add("f4_transform_plan", f"""{W}, {_CHECK}, t AS (SELECT *, coalesce(cstd IN ('TYPE_ECONOMY', 'TYPE_PROMO') AND list_contains(va, 'R'), false) AS an,
  coalesce(cstd IN ('TYPE_ECONOMY', 'TYPE_PROMO') AND list_contains(vb, 'R'), false) AS bn, least(ca, cb) AS comp, round(1 - least(ca, cb), 9) AS loss FROM cs)
SELECT field_a, field_b, match_type, concept_id, cstd AS standard, an AS a_needs_transform, bn AS b_needs_transform, CASE WHEN an AND bn THEN 'ambas' WHEN an THEN 'a' WHEN bn THEN 'b' ELSE 'ninguna' END AS transform_side,
 round(comp, 6) AS expected_completeness, round(loss, 6) AS expected_loss, CASE WHEN loss < 0.1 THEN 'cruce viable' WHEN loss < 0.3 THEN 'cruce con perdida' ELSE 'cruce no recomendado' END AS recommendation,
 loss >= 0.1 AS loss_warning FROM t""")
def f4(spark, sf):
    p, n, _, codes = _paths(spark, sf)
    return _round(interop.transform_plan(interop.with_fields(p, n), codes), "expected_completeness", "expected_loss")


@R.add("e15_classifier_consistency", f"""{W}, s AS (SELECT f.id, f.concept_id, c.standard, unnest(sample_values) AS v FROM fields f JOIN concepts c ON c.id = f.concept_id WHERE c.standard IS NOT NULL),
g AS (SELECT s.id, s.concept_id, s.standard, count(*) AS n, count(*) FILTER (k.code IS NULL) AS bad, coalesce(string_agg(v, ',' ORDER BY v) FILTER (k.code IS NULL), '') AS inv
 FROM s LEFT JOIN codes k ON k.standard_id = s.standard AND lower(k.code) = lower(s.v) GROUP BY 1, 2, 3)
SELECT id AS field_id, concept_id, 'classifier:' || standard AS classifier_id, n - bad AS valid_count, bad AS invalid_count, inv AS invalid_values, round((n - bad) / n, 6) AS match_ratio, bad = 0 AS passed FROM g""")
def e15(spark, sf):
    n, e, codes, _ = catalog(spark, sf, ("fields",))
    c = interop.classifier_consistency(n, e, codes)
    return _round(c.withColumn("invalid_values", F.array_join("invalid_values", ",")), "match_ratio")


@R.add("f3_interop_confidence", f"""{W}, h AS (SELECT f.id, count(k.code) / count(*) AS m FROM (SELECT f.id, c.standard, unnest(sample_values) AS v FROM fields f JOIN concepts c ON c.id = f.concept_id WHERE c.standard IS NOT NULL) f
  LEFT JOIN codes k ON k.standard_id = f.standard AND k.code = f.v GROUP BY 1),
x AS (SELECT f.id, f.concept_id, quality_score AS q, CASE review_status WHEN 'approved' THEN 1.0 WHEN 'under_review' THEN 0.5 ELSE 0.0 END::DOUBLE AS r,
  greatest(0.0, 1 - datediff('day', CAST(last_verified AS DATE), DATE '{TODAY}') / 365.0)::DOUBLE AS s, coalesce(h.m, 0) AS m FROM fields f LEFT JOIN h ON h.id = f.id),
y AS (SELECT *, q * 0.35 + r * 0.25 + s * 0.15 + m * 0.25 AS conf FROM x)
SELECT id AS field_id, concept_id, round(q, 6) AS quality_score, r AS review_factor, round(s, 6) AS staleness_factor, round(m, 6) AS classifier_match, round(conf, 6) AS confidence,
 CASE WHEN r = 0 THEN 'blocked' WHEN conf >= 0.7 THEN 'high' WHEN conf >= 0.4 THEN 'medium' ELSE 'low' END AS level,
 concat_ws(',', CASE WHEN r = 0 THEN 'review_status' END, CASE WHEN s < 0.5 THEN 'last_verified' END, CASE WHEN m < 0.8 THEN 'classifier_match' END) AS reasons FROM y""")
def f3(spark, sf):
    n, e, codes, _ = catalog(spark, sf, ("fields",))
    c = interop.interop_confidence(n, e, codes, TODAY).withColumn("reasons", F.array_join("reasons", ","))
    return _round(c, "quality_score", "staleness_factor", "classifier_match", "confidence")


def _mapping(spark, sf):
    n, e, codes, mapping = catalog(spark, sf, ())
    cls = cat.of_type(n, "classifier").select(F.col("id").alias("src"))
    card = cat.links(e, "equivalente_a").filter("cardinality is not null").join(cls, "src", "left_semi").select("src", "dst", "cardinality")
    return mapping, card, codes


@R.add("e16_mapping_bijectivity", f"""{W}, o AS (SELECT m.* FROM mapping m JOIN cls_equiv c USING (src, dst) WHERE cardinality = '1:1')
SELECT src, dst, 'duplicate_target' AS conflict, code_dst AS code FROM o GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT DISTINCT o.src, o.dst, 'unmapped_target', k.code FROM o JOIN codes k ON 'classifier:' || k.standard_id = o.dst WHERE NOT EXISTS (SELECT 1 FROM o p WHERE p.src = o.src AND p.dst = o.dst AND p.code_dst = k.code)
UNION ALL SELECT src, dst, 'not_applicable', cardinality FROM cls_equiv WHERE cardinality <> '1:1'""")
def e16(spark, sf):
    return interop.mapping_bijectivity(*_mapping(spark, sf))


@R.add("e17_mapping_cardinality", f"{W} SELECT src, dst, cardinality FROM cls_equiv")
def e17(spark, sf):
    return interop.mapping_cardinality(_mapping(spark, sf)[0])


# --- harmonisation ------------------------------------------------------------------------

def _nation_codes(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("ord"))


# the raw spelling of a customer's nation: code, padded code, label, part of a label, or unknown text
_SPELL = """CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(c_nationkey AS VARCHAR) WHEN c_mktsegment = 'AUTOMOBILE' THEN ' ' || c_nationkey || ' '
 WHEN c_mktsegment = 'MACHINERY' THEN lower(n_name) WHEN c_mktsegment = 'HOUSEHOLD' THEN 'the ' || n_name ELSE 'unknown ' || c_nationkey END"""


def _spelled(spark, sf):
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k, seg = F.col("c_nationkey").cast("string"), F.col("c_mktsegment")
    raw = (F.when(seg == "BUILDING", k).when(seg == "AUTOMOBILE", F.concat(F.lit(" "), k, F.lit(" "))).when(seg == "MACHINERY", F.lower("n_name"))
           .when(seg == "HOUSEHOLD", F.concat(F.lit("the "), "n_name")).otherwise(F.concat(F.lit("unknown "), k)))
    return c.select("c_custkey", raw.alias("nation_text"))


_STD = f"""c AS (SELECT c_custkey, {_SPELL} AS nation_text FROM customer JOIN nation ON c_nationkey = n_nationkey),
v AS (SELECT DISTINCT trim(nation_text) AS v FROM c),
m AS (SELECT v, coalesce((SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE CAST(n_nationkey AS VARCHAR) = v), (SELECT CAST(max(n_nationkey) AS VARCHAR) FROM nation WHERE upper(n_name) = upper(v)),
  CASE WHEN length(v) >= 3 THEN (SELECT CAST(min(n_nationkey) AS VARCHAR) FROM nation WHERE contains(upper(n_name), upper(v)) OR contains(upper(v), upper(n_name))) END) AS code FROM v)"""


@R.add("e8_standardize", f"WITH {_STD} SELECT c_custkey, nation_text, code AS nation_text_canonico FROM c JOIN m ON v = trim(nation_text)")
def e8(spark, sf):
    return harmonize.standardize(_spelled(spark, sf), "nation_text", _nation_codes(spark, sf))


@R.add("e8_case_text_lines", f"""WITH {_STD}, n AS (SELECT count(*) AS lost FROM m WHERE code IS NULL), q AS (SELECT chr(39) AS q)
SELECT 0 AS part, '' AS value, '-- nation_text to NATIONS (nations), ' || (SELECT count(*) FROM nation) || ' codes' || chr(10) || 'CASE' AS line
UNION ALL SELECT 1, v, '    WHEN "nation_text" IN (' || (SELECT string_agg(q || s || q, ', ' ORDER BY s) FROM (SELECT DISTINCT unnest([v, upper(v), lower(v)]) AS s)) || ') THEN ' || q || code || q || '  -- ' || n_name
 FROM m JOIN nation ON CAST(n_nationkey AS VARCHAR) = code, q
UNION ALL SELECT 2, '', '    -- WARNING: ' || lost || ' values without a code: ' || (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT v FROM m WHERE code IS NULL ORDER BY v LIMIT 5)) FROM n WHERE lost > 0
UNION ALL SELECT 3, '', '    ELSE NULL  -- to be reviewed' || chr(10) || 'END AS "nation_text_canonico"'""")
def e8b(spark, sf):
    return harmonize.case_text_lines(_spelled(spark, sf), "nation_text", _nation_codes(spark, sf), "NATIONS", "nations")


@R.add("b25_value_mappings", f"WITH {_STD} SELECT v AS value, code FROM m")
def b25(spark, sf):
    v = _spelled(spark, sf).select(F.col("nation_text").alias("value"))
    return harmonize.value_mappings(v, _nation_codes(spark, sf)).select("value", "code")


@R.add("f5_apply_mapping", """SELECT c_custkey, c_nationkey, n_name AS nation_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 4""")
def f5(spark, sf):
    m = table(spark, sf, "nation").filter("n_regionkey < 4").select(F.col("n_nationkey").cast("string").alias("code_src"), F.col("n_name").alias("code_dst"))
    return harmonize.apply_mapping(table(spark, sf, "customer"), "c_nationkey", m, "nation_name").select("c_custkey", "c_nationkey", "nation_name")


@R.add("f5_mapping_source", f"""{W}, p AS (SELECT c.id AS concept_id, 'classifier:' || c.standard AS cls, c.standard FROM concepts c WHERE c.standard IS NOT NULL),
o AS (SELECT cls, src, dst, 0 AS k, dst AS t FROM (SELECT DISTINCT cls FROM p) JOIN cls_equiv ON src = cls UNION ALL SELECT cls, src, dst, 1, src FROM (SELECT DISTINCT cls FROM p) JOIN cls_equiv ON dst = cls),
pick AS (SELECT cls, arg_min(src, (k, t)) AS src, arg_min(dst, (k, t)) AS dst FROM o GROUP BY 1)
SELECT concept_id, code_src, code_dst, 'edge' AS source FROM p JOIN pick USING (cls) JOIN mapping m ON m.src = pick.src AND m.dst = pick.dst""")
def f5b(spark, sf):
    n, e, codes, mapping = catalog(spark, sf, ())
    c = (cat.of_type(n, "concept").select(F.col("id").alias("concept_id"), "standard")
         .join(cat.links(e, "usa_clasificador").select(F.col("src").alias("concept_id"), F.col("dst").alias("classifier_id")), "concept_id"))
    return harmonize.mapping_source(c, mapping, codes)


@R.add("f5_case_when_text", f"""{W} SELECT src, dst, 'CASE ' || string_agg('WHEN "flag" = ''' || code_src || ''' THEN ''' || code_dst || '''', ' ' ORDER BY code_src) || ' ELSE NULL END AS "canonical"' AS sql FROM mapping GROUP BY 1, 2""")
def f5c(spark, sf):
    return harmonize.case_when_text(catalog(spark, sf, ())[3], ["src", "dst"], "flag", "canonical")


@R.add("f6_validation_schema", f"""{W}, k AS (SELECT standard_id, list(code ORDER BY code) AS cs, string_agg('"' || code || '":"' || label || '"', ',' ORDER BY code) AS ls FROM codes GROUP BY 1)
SELECT id AS concept_id, '{{"$schema":"https://json-schema.org/draft/2020-12/schema","title":"' || name || '","description":"' || definition || '","type":"string"'
 || CASE WHEN cs IS NULL THEN '' ELSE ',"enum":["' || array_to_string(cs, '","') || '"],"enumDescriptions":{{' || ls || '}}' END
 || ',"x-catalog":{{' || CASE WHEN standard IS NULL THEN '' ELSE '"standard":"' || standard || '",' END || '"version":"1.0","population":"' || population
 || '","capture_method":"' || capture_method || '","why":"","what_for":"","data_classification":"' || data_classification || '"}}}}' AS json_schema
 FROM concepts LEFT JOIN k ON standard_id = standard""")
def f6(spark, sf):
    n, _, codes, _ = catalog(spark, sf, ())
    return harmonize.validation_schema(cat.of_type(n, "concept"), codes)


@R.add("f7_harmonize", """SELECT 'customer' AS source, CAST(c_nationkey AS VARCHAR) AS original, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'supplier', n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def f7(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    nr = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    by_key = nr.select(F.col("n_nationkey").cast("string").alias("code_src"), F.col("r_name").alias("code_dst"))
    by_name = nr.select(F.col("n_name").alias("code_src"), F.col("r_name").alias("code_dst"))
    sup = table(spark, sf, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return harmonize.harmonize([("customer", table(spark, sf, "customer"), "c_nationkey", by_key), ("supplier", sup, "n_name", by_name)], "region")


# --- health -------------------------------------------------------------------------------

_ORPH = """ends AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT dst FROM edges), orph AS MATERIALIZED (SELECT n.id, n.name, n.type FROM nodes n ANTI JOIN ends USING (id))"""
_INV = f"""{_ORPH}, inv AS (SELECT id AS item, 'concept_without_classifier' AS rule, 'warning' AS severity FROM concepts WHERE review_status = 'approved' AND standard IS NULL
 UNION ALL SELECT id, 'concept_without_fields', 'warning' FROM concepts c WHERE review_status = 'approved' AND NOT EXISTS (SELECT 1 FROM fields f WHERE f.concept_id = c.id)
 UNION ALL SELECT id, 'low_quality_without_issue', 'warning' FROM fields WHERE quality_score > 0 AND quality_score < 0.3 AND completeness >= 0.5
 UNION ALL SELECT id, 'field_without_concept', 'violation' FROM orphans UNION ALL SELECT id, 'orphan_node', 'warning' FROM orph)"""


@R.add("i4_graph_invariants", f"{W}, {_INV} SELECT * FROM inv")
def i4(spark, sf):
    n, e, _, _ = catalog(spark, sf)
    return health.graph_invariants(n, e)


@R.add("i5_orphans", f"{W}, {_ORPH} SELECT * FROM orph")
def i5(spark, sf):
    n, e, _, _ = catalog(spark, sf, ("counts", "equivalents"))
    return health.orphans(n, e)


@R.add("i6_stale_nodes", f"""{W}, s AS (SELECT id, name, type, coalesce(last_verified, '') AS last_verified,
 CASE WHEN last_verified IS NULL THEN -1 ELSE datediff('day', CAST(last_verified AS DATE), DATE '{TODAY}') END AS days_since FROM nodes WHERE type IN ('concept', 'source', 'field'))
SELECT * FROM s WHERE (days_since = -1 AND last_verified = '') OR days_since > 180""")
def i6(spark, sf):
    return health.stale_nodes(catalog(spark, sf, ())[0], TODAY)


@R.add("i7_stale_proposals", f"""{W}, s AS (SELECT id, type, review_status, CASE WHEN created_at IS NULL THEN -1 ELSE datediff('day', CAST(created_at AS DATE), DATE '{TODAY}') END AS days_stale, created_at
 FROM nodes WHERE review_status IN ('proposed', 'under_review')) SELECT id, type, review_status, days_stale FROM s WHERE created_at IS NULL OR days_stale > 7""")
def i7(spark, sf):
    return health.stale_proposals(catalog(spark, sf, ())[0], TODAY)


@R.add("i8_resolve_proposals", f"""{W}, s AS (SELECT id, type, review_status, coalesce(quality_score, 0) AS quality_score, coalesce(datediff('day', CAST(created_at AS DATE), DATE '{TODAY}'), 0) AS days_stale
 FROM nodes WHERE review_status IN ('proposed', 'under_review')),
a AS (SELECT *, CASE WHEN review_status = 'proposed' AND days_stale >= 7 AND quality_score >= 0.7 THEN 'auto_approve' WHEN review_status = 'proposed' AND days_stale >= 7 AND quality_score < 0.4 THEN 'manual'
 WHEN review_status = 'under_review' AND days_stale >= 30 THEN 'alert' END AS action FROM s) SELECT id, type, review_status, round(quality_score, 6) AS quality_score, days_stale, action FROM a WHERE action IS NOT NULL""")
def i8(spark, sf):
    return _round(health.resolve_proposals(catalog(spark, sf, ())[0], TODAY), "quality_score")


@R.add("i9_batch_approve", f"{W} SELECT id, standard, review_status AS old_status, 'approved' AS new_status FROM concepts WHERE review_status IN ('proposed', 'under_review') AND definition <> '' AND standard IS NOT NULL")
def i9(spark, sf):
    return health.batch_approve(catalog(spark, sf, ())[0])


@R.add("i9_batch_approve_by_confidence", f"""{W} SELECT id, standard, review_status AS old_status, 'approved' AS new_status FROM concepts
 WHERE review_status IN ('proposed', 'under_review') AND definition <> '' AND standard IS NOT NULL AND length(name) % 3 < 2""")
def i9b(spark, sf):
    n = catalog(spark, sf, ())[0]
    third = F.length("name") % 3
    n = n.withColumn("confidence", F.when(third == 0, "high").when(third == 1, "medium"))
    return health.batch_approve(n, confidence="medium")


_LINKS = """cw AS (SELECT DISTINCT id, unnest(string_split(lower(name), ' ')) AS w FROM concepts WHERE review_status NOT IN ('proposed', 'rejected')),
fw AS (SELECT DISTINCT id, unnest(string_split(lower("column"), '_')) AS w FROM orphans), fn AS (SELECT id, count(*) AS n FROM fw GROUP BY 1),
s AS (SELECT fw.id, cw.id AS cid, count(*) / any_value(n) AS score FROM fw JOIN fn USING (id) JOIN cw ON cw.w = fw.w GROUP BY 1, 2 HAVING count(*) / any_value(n) >= 0.5),
b AS (SELECT id, arg_min(cid, (-score, cid)) AS cid, max(score) AS score FROM s GROUP BY 1)"""


@R.add("e23_suggest_orphan_links", f"""{W}, {_LINKS}
SELECT o.id, b.cid AS suggested_concept, round(score, 6) AS match_score, CASE WHEN cid IS NULL THEN 'manual' ELSE 'link_implementa' END AS action FROM orphans o LEFT JOIN b ON b.id = o.id""")
def e23(spark, sf):
    n, e, _, _ = catalog(spark, sf)
    return _round(health.suggest_orphan_links(n, e), "match_score")


# only the edges from fields to sources are left, so that concepts and classifiers are orphans too
@R.add("e23_orphan_actions", f"""{W}, {_LINKS}
SELECT o.id, 'field' AS type, b.cid AS suggested_concept, round(score, 6) AS match_score, CASE WHEN cid IS NULL THEN 'manual' ELSE 'link_implementa' END AS action,
 CASE WHEN cid IS NULL THEN 'No se encontró concepto similar (score < 0.5)' END AS reason FROM orphans o LEFT JOIN b ON b.id = o.id
UNION ALL SELECT id, type, NULL, NULL, 'manual', CASE type WHEN 'concept' THEN 'Concepto huérfano — requiere definición humana de relaciones'
 ELSE 'Clasificador huérfano — requiere asociación manual a concepto' END FROM nodes WHERE type IN ('concept', 'classifier')""")
def e23b(spark, sf):
    n, e, _, _ = catalog(spark, sf, ("fields",))
    return _round(health.orphan_actions(n, e.filter("type = 'proviene_de'")), "match_score")


@R.add("i10_health_report", f"""{W}, {_INV}, {_COV}, h AS (SELECT f.id, count(*) FILTER (k.code IS NULL) AS bad FROM (SELECT f.id, c.standard, unnest(sample_values) AS v FROM fields f JOIN concepts c ON c.id = f.concept_id WHERE c.standard IS NOT NULL) f
  LEFT JOIN codes k ON k.standard_id = f.standard AND k.code = f.v GROUP BY 1),
r AS (SELECT 'nodes' AS section, coalesce(type, 'total') AS metric, count(*) AS value FROM nodes GROUP BY ROLLUP(type) UNION ALL SELECT 'edges', coalesce(type, 'total'), count(*) FROM edges GROUP BY ROLLUP(type)
 UNION ALL SELECT 'coverage', u.* FROM c, LATERAL (VALUES ('approved', approved), ('proposed', proposed), ('under_review', under_review), ('rejected', rejected), ('other', total - approved - proposed - under_review - rejected)) u(a, b)
 UNION ALL SELECT 'quality', 'average', avg(coalesce(quality_score, 0)) FROM nodes WHERE type = 'field' UNION ALL SELECT 'quality', 'low_fields', count(*) FROM nodes WHERE type = 'field' AND coalesce(quality_score, 0) < 0.4
 UNION ALL SELECT 'audit', severity, count(*) FROM inv GROUP BY severity
 UNION ALL SELECT 'stale', 'proposals', count(*) FROM nodes WHERE review_status IN ('proposed', 'under_review') AND (created_at IS NULL OR datediff('day', CAST(created_at AS DATE), DATE '{TODAY}') > 7)
 UNION ALL SELECT 'orphans', 'nodes', count(*) FROM orph UNION ALL SELECT 'orphans', 'fields_without_concept', count(*) FROM orphans
 UNION ALL SELECT 'classifiers', 'fields_with_issues', count(*) FROM h WHERE bad > 0 UNION ALL SELECT 'result', 'passed', CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM inv WHERE severity = 'violation')
SELECT section, metric, round(CAST(value AS DOUBLE), 6) AS value FROM r""")
def i10(spark, sf):
    n, e, codes, _ = catalog(spark, sf)
    return _round(health.health_report(n, e, interop.classifier_consistency(n, e, codes), TODAY), "value")


_ROUNDS = ["l0 AS (SELECT id, id AS c FROM mn)"] + [
    f"l{i} AS (SELECT x.id, least(x.c, min(y.c)) AS c FROM l{i - 1} x LEFT JOIN ue ON ue.a = x.id LEFT JOIN l{i - 1} y ON y.id = ue.b GROUP BY x.id, x.c)" for i in range(1, 13)]


_PARTS = f"""mn AS MATERIALIZED (SELECT id FROM nodes WHERE type IN ('concept', 'field', 'classifier')),
ue AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges SEMI JOIN mn m ON m.id = src SEMI JOIN mn k ON k.id = dst UNION SELECT dst, src FROM edges SEMI JOIN mn m ON m.id = src SEMI JOIN mn k ON k.id = dst),
{', '.join(r.replace(' AS (', ' AS MATERIALIZED (', 1) for r in _ROUNDS)}"""


@R.add("i11_components", f"""{W}, {_PARTS} SELECT id, coalesce(c, id) AS component FROM l12""")
def i11(spark, sf):
    n, e, _, _ = catalog(spark, sf, ("counts", "equivalents"))
    return health.connected_components(n, e)


@R.add("i11_communities")
def i11b(spark, sf):
    n, e, _, _ = catalog(spark, sf, ("counts", "equivalents"))
    return health.community_sizes(health.communities(n, e), n)


@R.add("i12_community_context")
def i12(spark, sf):
    n, e, _, _ = catalog(spark, sf, ("counts", "equivalents"))
    return health.community_context(health.communities(n, e), n, e)


@R.add("i12_component_context", f"""{W}, {_PARTS}, m AS MATERIALIZED (SELECT id, coalesce(c, id) AS community, type, coalesce(name, id) AS name FROM l12 JOIN nodes USING (id)),
x AS MATERIALIZED (SELECT e.src, e.dst, e.type, a.name AS sn, b.name AS dn FROM edges e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst WHERE a.community = b.community),
k AS (SELECT src AS id, type || '->' || dn AS c FROM x UNION SELECT dst, sn || '->' || type FROM x),
t AS (SELECT id, string_agg(c, ', ' ORDER BY c) AS conn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c) AS r FROM k) WHERE r <= 5 GROUP BY 1)
SELECT m.community, m.id, '- [' || m.type || '] ' || m.name || CASE WHEN coalesce(definition, '') <> '' THEN ': ' || substr(definition, 1, 120) ELSE '' END
 || CASE WHEN coalesce(n.standard, '') <> '' THEN ' (estandar: ' || n.standard || ')' ELSE '' END || CASE WHEN conn IS NOT NULL THEN ' | conexiones: ' || conn ELSE '' END AS line
FROM m JOIN nodes n ON n.id = m.id LEFT JOIN concepts d ON d.id = m.id LEFT JOIN t ON t.id = m.id""")
def i12b(spark, sf):
    n, e, _, _ = catalog(spark, sf, ("counts", "equivalents"))
    comp = health.connected_components(n, e).withColumnRenamed("component", "community")
    return health.community_context(comp, n, e)


# --- merge and delete ---------------------------------------------------------------------

@R.add("i2_merge_graph", f"{W} SELECT 'node' AS kind, count(*) AS n FROM nodes UNION ALL SELECT 'edge', count(*) FROM (SELECT DISTINCT src, dst FROM edges)")
def i2(spark, sf):
    n, e, _, _ = catalog(spark, sf, ("counts", "equivalents"))
    e = e.dropDuplicates(["src", "dst"])
    mem_n, mem_e = n.filter("type <> 'field'"), e.filter("type <> 'implementa'")
    mn, me = cat.merge_graph(mem_n, mem_e, n, e)
    return mn.agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "n").unionByName(
        me.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "n"))


@R.add("i3_delete_source", f"""{W}, s AS (SELECT 'source:supplier_' || s_suppkey AS id FROM supplier WHERE s_acctbal < 0),
g AS (SELECT id FROM s UNION SELECT f.id FROM fields f JOIN s ON f.source_id = s.id UNION SELECT i.id FROM insights i JOIN s ON i.source_id = s.id)
SELECT 'node' AS kind, type, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM g) GROUP BY type
UNION ALL SELECT 'edge', type, count(*) FROM edges WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g) GROUP BY type""")
def i3(spark, sf):
    n, e, _, _ = catalog(spark, sf)
    s = table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("source:supplier_"), F.col("s_suppkey").cast("string")).alias("id"))
    kn, ke, _ = cat.delete_sources(n, e, s)
    count = F.count(F.lit(1)).alias("n")
    return kn.groupBy("type").agg(count).select(F.lit("node").alias("kind"), "type", "n").unionByName(
        ke.groupBy("type").agg(count).select(F.lit("edge").alias("kind"), "type", "n"))


# --- lifecycle ----------------------------------------------------------------------------

def log(spark, sf):
    """The event table read as a decision log."""
    t = F.col("event_type")
    action = (F.when(t == "click", "proposed").when(t == "view", "review_started").when(t == "signup", "approved")
              .when(t == "purchase", "deprecated").otherwise("rejected"))
    action = F.when((t == "signup") & (F.col("value") > 100), "reactivated").otherwise(action)
    return table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("concept:user_"), F.col("user_id").cast("string")).alias("concept_id"), "ts", action.alias("action"),
        F.when(F.col("value") >= 50, "human").otherwise("agent").alias("actor"),
        F.when(F.col("value") > 100, F.concat(F.lit("high "), t, F.lit(" "), "props")).otherwise("").alias("reason"),
        F.col("props").alias("details"), "value")


_LOG = """lg AS (SELECT event_id, 'concept:user_' || user_id AS concept_id, ts, CASE WHEN event_type = 'signup' AND value > 100 THEN 'reactivated' WHEN event_type = 'click' THEN 'proposed' WHEN event_type = 'view' THEN 'review_started'
  WHEN event_type = 'signup' THEN 'approved' WHEN event_type = 'purchase' THEN 'deprecated' ELSE 'rejected' END AS action, CASE WHEN value >= 50 THEN 'human' ELSE 'agent' END AS actor,
  CASE WHEN value > 100 THEN 'high ' || event_type || ' ' || props ELSE '' END AS reason, props AS details, value FROM events)"""


@R.add("j1_history", f"WITH {_LOG} SELECT event_id, concept_id, action, actor, reason FROM lg")
def j1(spark, sf):
    return lifecycle.history(log(spark, sf)).select("event_id", "concept_id", "action", "actor", "reason")


@R.add("j1_last_events", f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY ts DESC, event_id DESC) AS recency FROM lg) SELECT event_id, concept_id, action, recency FROM r WHERE recency <= 5")
def j1b(spark, sf):
    return lifecycle.last_events(log(spark, sf)).select("event_id", "concept_id", "action", "recency")


@R.add("j2_explanatory_note", f"""WITH {_LOG} SELECT concept_id, event_id, '[' || strftime(ts, '%Y-%m-%d') || '] ' || CASE WHEN actor = 'human' THEN '(humano) ' ELSE '(auto) ' END || action || ': ' || reason AS line FROM lg WHERE reason <> ''""")
def j2(spark, sf):
    return lifecycle.explanatory_note(log(spark, sf)).drop("ts")


@R.add("j3_deprecated", f"WITH {_LOG}, a AS (SELECT concept_id, arg_max(action, (ts, event_id)) AS last_action FROM lg WHERE action IN ('deprecated', 'retired', 'reactivated', 'status_changed') GROUP BY 1) SELECT * FROM a WHERE last_action IN ('deprecated', 'retired')")
def j3(spark, sf):
    return lifecycle.deprecated(log(spark, sf))


@R.add("j4_pending_reviews", f"""WITH {_LOG}, a AS (SELECT concept_id, arg_max(action, (ts, event_id)) AS x FROM lg WHERE action IN ('proposed', 'review_started', 'approved', 'rejected') GROUP BY 1)
SELECT concept_id, CASE WHEN x = 'review_started' THEN 'under_review' ELSE x END AS review_status FROM a WHERE x IN ('proposed', 'review_started')""")
def j4(spark, sf):
    return lifecycle.pending_reviews(log(spark, sf))


@R.add("j5_recall_feedback", f"""WITH {_LOG} SELECT event_id, concept_id, action, reason FROM lg WHERE contains(lower(reason), 'purchase') OR contains(lower(reason), 'user') OR list_has_any(string_split(replace(replace(lower(concept_id), 'concept:', ''), '_', ' '), ' '), ['purchase', 'user', '149'])
 OR contains(lower(reason), '149') ORDER BY CASE action WHEN 'rejected' THEN 0 WHEN 'approved' THEN 1 WHEN 'deprecated' THEN 2 WHEN 'reactivated' THEN 3 ELSE 9 END, ts, event_id LIMIT 5""")
def j5(spark, sf):
    return lifecycle.recall_feedback(log(spark, sf), "purchase of user_149").select("event_id", "concept_id", "action", "reason")


@R.add("j6_change_status", """SELECT 'concept:user_' || user_id AS concept_id, ts, CASE event_type WHEN 'purchase' THEN 'deprecated' WHEN 'signup' THEN 'reactivated' WHEN 'error' THEN 'retired' END AS action,
 'human' AS actor, props AS reason, CASE WHEN value > 100 THEN 'reemplazado_por=concept:user_0' ELSE '' END AS details, event_type IN ('purchase', 'signup', 'error') AS accepted FROM events""")
def j6(spark, sf):
    t = F.col("event_type")
    req = table(spark, sf, "events").select(
        F.concat(F.lit("concept:user_"), F.col("user_id").cast("string")).alias("concept_id"), "ts",
        F.when(t == "purchase", "deprecado").when(t == "signup", "activo").when(t == "error", "retirado").otherwise("archivado").alias("new_status"),
        F.lit("human").alias("actor"), F.col("props").alias("reason"), F.when(F.col("value") > 100, "concept:user_0").otherwise("").alias("replacement"))
    return lifecycle.change_status(req)


@R.add("i16_status_update", f"""WITH {_LOG} SELECT concept_id, arg_max(action, ts) FILTER (action IN ('proposed', 'approved', 'rejected')) AS review_status, arg_max(details, ts) FILTER (value > 100) AS custodian,
 arg_max(CAST(CAST(ts AS DATE) AS VARCHAR), ts) AS last_verified FROM lg GROUP BY 1""")
def i16(spark, sf):
    c = log(spark, sf).select(
        "concept_id", "ts", F.when(F.col("action").isin("proposed", "approved", "rejected"), F.col("action")).alias("review_status"),
        F.when(F.col("value") > 100, F.col("details")).alias("custodian"), F.to_date("ts").cast("string").alias("last_verified"))
    return cat.current_status(c)


_VERSIONS = """WITH c AS (SELECT user_id % 10 AS catalog, ts, event_id AS seq, CASE WHEN event_type = 'purchase' AND value > 50 THEN 'major' WHEN event_type IN ('signup', 'view') THEN 'minor' ELSE 'patch' END AS kind FROM events),
w AS (SELECT *, count(*) FILTER (kind = 'major') OVER (PARTITION BY catalog ORDER BY ts, seq) AS mj FROM c),
x AS (SELECT *, count(*) FILTER (kind = 'minor') OVER (PARTITION BY catalog, mj ORDER BY ts, seq) AS mi FROM w),
y AS (SELECT *, count(*) FILTER (kind = 'patch') OVER (PARTITION BY catalog, mj, mi ORDER BY ts, seq) AS pa FROM x)"""


@R.add("b26_version_history", f"""{_VERSIONS}
SELECT catalog, seq, kind, mj + 1 AS major, mi AS minor, pa AS patch, (mj + 1) || '.' || mi || '.' || pa AS to_version FROM y""")
def b26(spark, sf):
    return lifecycle.version_history(_changes(spark, sf)).drop("ts", "from_version")


def _changes(spark, sf):
    t, v = F.col("event_type"), F.col("value")
    kind = F.when((t == "purchase") & (v > 50), "major").when(t.isin("signup", "view"), "minor").otherwise("patch")
    return table(spark, sf, "events").select((F.col("user_id") % 10).alias("catalog"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"))


@R.add("b26_version_entries", f"""{_VERSIONS}, z AS (SELECT *, (mj + 1) || '.' || mi || '.' || pa AS to_version FROM y)
SELECT catalog, seq, kind, coalesce(lag(to_version) OVER (PARTITION BY catalog ORDER BY z.ts, seq), '1.0.0') AS from_version, to_version,
 props AS reason, z.catalog + 100 AS nodes, e.user_id AS edges FROM z JOIN events e ON e.event_id = seq""")
def b26b(spark, sf):
    more = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("props").alias("reason"), F.col("user_id").alias("edges"))
    c = _changes(spark, sf).withColumn("nodes", F.col("catalog") + 100).join(more, "seq")
    return lifecycle.version_history(c).select("catalog", "seq", "kind", "from_version", "to_version", "reason", "nodes", "edges")
