"""Joins of the catalog graph: the same rows with repeated fields and edges, and no table of all fields moved without need."""

from datasteward.operators import catalog as cat
from datasteward.operators import interop


def _graph(spark):
    nodes = [("f1", "field", "s1", "f1", 0.5, None), ("f2", "field", "s2", "f2", 0.2, None), ("f2", "field", "s2", "f2", 0.2, None),
             ("f3", "field", "s3", "f3", 0.9, None), ("f4", "field", "s2", "f4", 0.1, None), ("c1", "concept", None, "one", None, "A"),
             ("c2", "concept", None, "two", None, None), ("k", "classifier", None, "kind", None, "A"), ("x1", "context", None, "here", None, None),
             ("x2", "context", None, "there", None, None), ("n", "normative", None, "norm", None, None)]
    edges = [("f1", "c1", "implementa", None, None), ("f2", "c1", "implementa", None, None), ("f3", "c2", "implementa", None, None), ("f3", "c9", "implementa", None, None),
             ("c1", "k", "usa_clasificador", None, None), ("c1", "x1", "tiene_contexto", None, None), ("c1", "x2", "tiene_contexto", None, None),
             ("c2", "x1", "tiene_contexto", None, None), ("c1", "n", "respaldado_por", None, None), ("c2", "c1", "compone", "sum", None),
             ("c2", "c1", "deriva_de", None, None), ("f1", "f2", "equivalente_a", None, 0.7), ("f2", "f1", "equivalente_a", None, 0.6),
             ("f3", "f2", "equivalente_a", None, None), ("f1", "f3", "equivalente_a", None, 0.1), ("f4", "f1", "equivalente_a", None, 0.4), ("f4", None, "equivalente_a", None, 1.0)]
    n = spark.createDataFrame([(i, t, s, name, q, std, "approved", ["A", "B"]) for i, t, s, name, q, std in nodes],
                              "id string, type string, source_db string, name string, quality_score double, standard string, review_status string, sample_values array<string>")
    e = spark.createDataFrame(edges, "src string, dst string, type string, operation string, confidence double")
    return cat.conform(n, cat.NODE_COLUMNS), cat.conform(e, cat.EDGE_COLUMNS)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_paths_of_asked_pairs(spark):
    nodes, edges = _graph(spark)
    pairs = spark.createDataFrame([("s1", "s2"), ("s2", "s3")], "src_db string, dst_db string")
    paths = interop.interop_paths(nodes, edges, pairs)
    got = sorted((r.field_a, r.field_b, r.concept_id or "", r.match_type, r.confidence or 0.0) for r in paths.collect())
    direct = [("f1", "f2", "c1", 0.7)] * 2 + [("f1", "f4", "c1", 0.4)] + [("f2", "f3", "c1", 0.0)] * 4
    assert got == sorted([("f1", "f2", "c1", "shared_concept", 0.0)] * 2 + [(a, b, c, "value_equivalence", x) for a, b, c, x in direct])
    plan = paths._jdf.queryExecution().optimizedPlan().toString()  # the two directions are listed after the pairs are known
    assert plan.index("explode(array(struct(field_a") < plan.rindex("Join LeftSemi")


def test_context_looks_up_all_neighbours_at_once(spark):
    nodes, edges = _graph(spark)
    context = cat.concept_context(nodes, edges)
    got = sorted((r.concept_id, r.section, r.ref_id, r.detail or "") for r in context.collect() if r.section not in ("field", "quality_summary"))
    assert got == [("c1", "classifier", "k", "kind"), ("c1", "composite", "c2", "sum"), ("c1", "context_conflict", "x1", "here"),
                   ("c1", "context_conflict", "x2", "there"), ("c1", "derived_from", "c2", "two"), ("c1", "normative", "n", "norm")]
    assert "SortMergeJoin [neighbor_id" not in _plan(context)


def test_confidence_keeps_fields_by_their_id(spark):
    nodes, edges = _graph(spark)
    codes = spark.createDataFrame([("A", "a")], "standard_id string, code string")
    conf = interop.interop_confidence(nodes, edges, codes, "2024-06-30")
    assert _plan(conf).count("Exchange hashpartitioning(concept_id") == 4  # of edges and concepts, not of fields
    got = sorted((r.field_id, r.concept_id, r.classifier_match) for r in conf.collect())
    assert got == [("f1", "c1", 0.5)] + [("f2", "c1", 0.5)] * 2 + [("f3", "c2", 0.0), ("f3", "c9", 0.0)]
