"""Assessment of whole tables, and their registration in the catalog graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datasteward.functions import privacy
from datasteward.functions import text as tx
from datasteward.operators import anomalies, profile, semantic
from datasteward.operators.catalog import EDGE_COLUMNS, NODE_COLUMNS, conform
from datasteward.operators.profile import KEYS
from datasteward.sources.shared import materialize


def assess_table(cell_rows: DataFrame, standards: list[semantic.Standard], standard_values: DataFrame, lists: DataFrame,
                 concepts: DataFrame | None = None) -> DataFrame:
    """One row per column: type, quality, outliers, issues, semantic type, sensitivity, match status.

    The cells are counted once and written; the facts are one row per column.
    """
    vf = profile.settled(cell_rows)
    f = materialize(profile.column_facts(vf))
    total = F.col("total")
    nulls = (total - F.col("n")) / F.greatest(total, F.lit(1))
    base = f.select(
        *KEYS, profile.strict_type().alias("data_type"), total.alias("total_count"), (total - F.col("n")).alias("null_count"),
        F.col("d_raw").alias("unique_count"),
        *[c for c in profile.quality_columns()],
        F.array_compact(F.array(
            F.when(nulls > 0.5, "alta_nulidad"), F.when((F.col("d_raw") == 1) & (total > 5), "columna_constante"),
            F.when((F.col("d_raw") == total) & (total > 0), "clave_primaria"),
            F.when(F.col("column").rlike(r"[^\x00-\x7F]"), "encoding_roto"))).alias("structure"))
    out = anomalies.numeric_anomalies(vf).select(*KEYS, F.col("anomaly_count").alias("_a"), F.col("anomaly_ratio").alias("_r"))
    inf = semantic.infer_semantic_type(vf, lists, concepts).select(
        *KEYS, F.coalesce("semantic_type", "reference_match").alias("inferred_type"), "matched_concept", "suggested_concept",
        F.col("confidence").alias("inferred_confidence"), "suggested_standard")
    std = semantic.detect_standard(vf, standards, standard_values).filter("rank = 1").select(*KEYS, "standard_id")
    ends = profile.value_range(vf)
    t = (privacy.sensitivity(base).join(F.broadcast(ends), KEYS, "left").join(F.broadcast(out), KEYS, "left").join(F.broadcast(inf), KEYS, "left")
         .join(F.broadcast(std), KEYS, "left"))
    numeric = F.col("data_type").isin("integer", "float")
    status = (F.when(F.col("matched_concept").isNotNull(), "matched")
              .when(F.col("inferred_confidence").isin("high", "medium") & F.col("suggested_concept").isNotNull(), "inferred")
              .when(F.col("standard_id").isNotNull(), "inferred").otherwise("unmatched"))
    return t.select(
        *KEYS, tx.clean_column_name(F.col("column")).alias("clean_name"), "data_type", "total_count", "null_count", "unique_count",
        "min_value", "max_value", "score", "grade", "completeness", "consistency", "validity",
        F.concat("structure", "issues").alias("issues"),
        F.when(numeric, F.coalesce("_a", F.lit(0))).otherwise(F.lit(0)).alias("anomaly_count"),
        F.when(numeric, F.coalesce("_r", F.lit(0.0))).otherwise(F.lit(0.0)).alias("anomaly_ratio"),
        "inferred_type", "inferred_confidence", "suggested_concept", F.coalesce("suggested_standard", "standard_id").alias("standard"),
        "is_pii", "is_sensitive", "sensitivity_keyword", status.alias("match_status"))


def assessment_rollup(assessed: DataFrame) -> DataFrame:
    """Report row per source: averages, grade and counts."""
    def n(c):
        return F.sum(c.cast("long"))
    t = assessed.groupBy("source").agg(
        F.count(F.lit(1)).alias("columns"), F.max("total_count").alias("total_rows"), F.avg("score").alias("avg_score"),
        *[n(F.col("match_status") == s).alias(s) for s in ("matched", "inferred", "unmatched")],
        n(F.col("is_pii")).alias("pii"), n(F.col("is_sensitive")).alias("sensitive"), n(F.size("issues") > 0).alias("with_issues"))
    return t.withColumn("grade", tx.grade(F.col("avg_score")))


def register_sources(cell_rows: DataFrame, standards: list[semantic.Standard], standard_values: DataFrame, concepts: DataFrame,
                     lists: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, mappings): source, field, concept, classifier and issue nodes with their edges.

    Columns of one source with equal clean names are fields of their own: all but the first by name carry the column's name in
    their id."""
    vf = profile.settled(cell_rows)
    f = materialize(profile.column_facts(vf))
    facts = f.select(*KEYS, F.col("d_lower_ext").alias("unique_count"))
    maps = materialize(semantic.match_to_concepts(vf, facts, standards, standard_values, concepts, lists))
    quality = profile.field_quality(vf, maps.filter("standard is not null").select(*KEYS, F.col("standard").alias("standard_id")), standard_values)
    src = semantic.infer_context(f.select("source").distinct())
    samples = profile.sample_values(vf, 5)
    same = Window.partitionBy("source", "clean_name").orderBy("column")
    ids = maps.select(*KEYS, F.concat(F.lit("field:"), "source", F.lit("."), "clean_name", F.when(
        F.row_number().over(same) > 1, F.concat(F.lit("#"), "column")).otherwise("")).alias("field_id"))
    fid = F.col("field_id")
    fields = (f.select(*KEYS, F.col("total").alias("total_count"), (F.col("total") - F.col("n_ext")).alias("null_count"),
                       F.col("d_lower_ext").alias("unique_count"))
              .join(maps, KEYS).join(ids, KEYS).join(quality, KEYS).join(samples, KEYS, "left").join(src.drop("context_label"), "source"))
    field_nodes = fields.select(
        fid.alias("id"), F.lit("field").alias("type"), F.col("clean_name").alias("name"), F.col("source").alias("source_db"),
        F.col("clean_name").alias("column"), "data_type", "standard", "population", "capture_method", "total_count", "null_count",
        "unique_count", "sample_values", "completeness", "uniqueness", "consistency", "validity", "quality_score")
    source_nodes = src.select(F.concat(F.lit("source:"), "source").alias("id"), F.lit("source").alias("type"), F.col("source").alias("name"),
                              "population", "capture_method")
    known = concepts.select(F.concat(F.lit("concept:"), "name").alias("id")).distinct()
    named = fields.filter("proposed_concept is not null")
    cid = F.concat(F.lit("concept:"), "proposed_concept")
    fresh = (named.select(cid.alias("id"), F.lit("concept").alias("type"), F.col("proposed_concept").alias("name"), "standard", "population", "capture_method")
             .join(known, "id", "left_anti").groupBy("id", "type", "name")
             .agg(F.min("standard").alias("standard"), F.min("population").alias("population"), F.min("capture_method").alias("capture_method")))
    coded = standard_values.select(F.col("standard_id").alias("standard")).distinct()
    with_codes = fresh.join(coded, "standard", "left_semi")
    classifier = F.concat(F.lit("classifier:"), F.lower("standard"))
    cls_nodes = with_codes.select(classifier.alias("id"), F.lit("classifier").alias("type"), F.col("standard").alias("name"), "standard").distinct()
    issues = profile.detect_issues(vf).join(ids, KEYS)
    iid = F.concat(F.lit("issue:"), fid, F.lit(":"), "issue_type")
    issue_nodes = issues.select(iid.alias("id"), F.lit("quality_issue").alias("type"), F.col("issue_type").alias("name"), "issue_type", "severity", "metric_value")
    nodes = reduce(DataFrame.unionByName, [conform(n, NODE_COLUMNS) for n in (source_nodes, field_nodes, fresh, cls_nodes, issue_nodes)])

    def edge(df: DataFrame, src, dst, kind: str) -> DataFrame:
        return conform(df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type")), EDGE_COLUMNS)

    edges = reduce(DataFrame.unionByName, [
        edge(fields, fid, F.concat(F.lit("source:"), "source"), "proviene_de"), edge(named, fid, cid, "implementa"),
        edge(with_codes, F.col("id"), classifier, "usa_clasificador"), edge(issues, fid, iid, "tiene_issue")])
    return nodes, edges, maps
