"""The catalog graph as two tables, nodes and edges, and the lookups over them.

No lookup collects the neighbours of a node: results are rows, so a concept that holds a
third of all fields is spread over tasks like any other rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasteward.sources.shared import materialize

# The node and edge types of the graph.
NODE_TYPES = ["concept", "field", "classifier", "operation", "context", "source", "normative",
              "anonymization", "quality_issue", "insight"]
EDGE_TYPES = ["implementa", "usa_clasificador", "transforma_a", "pertenece_a", "proviene_de", "compone",
              "deriva_de", "respaldado_por", "aplica_anonimizacion", "equivalente_a", "subconcepto_de",
              "tiene_issue", "tiene_contexto", "generates_insight"]
# Labels of node types in exports.
NODE_LABELS = {"concept": "Concept", "field": "Field", "classifier": "Classifier", "operation": "Operation",
               "context": "Context", "source": "Source", "normative": "Normative",
               "anonymization": "Anonymization", "quality_issue": "QualityIssue", "insight": "Insight"}

NODE_COLUMNS = {
    "id": "string", "type": "string", "name": "string", "source_db": "string", "column": "string",
    "data_type": "string", "standard": "string", "definition": "string", "custodian": "string",
    "population": "string", "capture_method": "string", "review_status": "string", "created_at": "string",
    "last_verified": "string", "data_classification": "string", "total_count": "bigint", "null_count": "bigint",
    "unique_count": "bigint", "sample_values": "array<string>", "completeness": "double", "uniqueness": "double",
    "consistency": "double", "validity": "double", "quality_score": "double", "issue_type": "string",
    "severity": "string", "metric_value": "double", "domain": "string"}
EDGE_COLUMNS = {"src": "string", "dst": "string", "type": "string", "operation": "string",
                "cardinality": "string", "confidence": "double"}


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def of_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("type") == kind)


def links(edges: DataFrame, kind: str) -> DataFrame:
    return edges.filter(F.col("type") == kind)


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: sorted, never broadcast. The size that the optimizer guesses for a few
    columns of a compressed file is far below that of their rows in the driver."""
    return df.hint("merge")


def visible(df: DataFrame, include_proposed: bool = False) -> DataFrame:
    """Hide proposed and rejected nodes unless asked for."""
    if include_proposed:
        return df
    return df.filter(~F.coalesce("review_status", F.lit("approved")).isin("proposed", "rejected"))


def listing(nodes: DataFrame, kind: str, source_db: str | None = None, domain: str | None = None,
            name: str | None = None, include_proposed: bool = True) -> DataFrame:
    out = visible(of_type(nodes, kind), include_proposed)
    for column, value in (("source_db", source_db), ("domain", domain), ("name", name)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out


def sensitive(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("data_classification").isin("pii", "sensible"))


def pending(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("review_status").isin("proposed", "under_review"))


def neighbors(nodes: DataFrame, edges: DataFrame, kind: str, direction: str = "out") -> DataFrame:
    """(id, neighbor_id, name, operation, cardinality) along one edge type."""
    own, other = ("src", "dst") if direction == "out" else ("dst", "src")
    e = links(edges, kind).select(F.col(own).alias("id"), F.col(other).alias("neighbor_id"), "operation", "cardinality")
    n = large(nodes.select(F.col("id").alias("neighbor_id"), "name", F.col("type").alias("neighbor_type")))
    return e.join(n, "neighbor_id").select("id", "neighbor_id", "neighbor_type", "name", "operation", "cardinality")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert or replace on key; the row with the highest version wins.

    ``max_by`` combines map-side, so a key with a very long history is no hot group.
    """
    both = current.unionByName(changes)
    rest = [c for c in both.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.col(version)).alias("_r")
    return both.groupBy(*keys).agg(row).select(*keys, "_r.*").select(*both.columns)


def merge_graph(nodes: DataFrame, edges: DataFrame, disk_nodes: DataFrame, disk_edges: DataFrame):
    """Add only what is unknown: nodes by id, edges by their two ends."""
    n = nodes.unionByName(disk_nodes.join(nodes, "id", "left_anti"))
    e = edges.unionByName(disk_edges.join(edges, ["src", "dst"], "left_anti"))
    return n, e


def delete_sources(nodes: DataFrame, edges: DataFrame, sources: DataFrame):
    """Remove the listed sources, their fields, their insights, and every edge at them."""
    s = sources.select(F.col("id").alias("src_id"))
    fields = links(edges, "proviene_de").join(s, F.col("dst") == F.col("src_id"), "left_semi").select(F.col("src").alias("id"))
    insights = links(edges, "generates_insight").join(s, F.col("src") == F.col("src_id"), "left_semi").select(F.col("dst").alias("id"))
    gone = s.withColumnRenamed("src_id", "id").unionByName(fields).unionByName(insights).distinct()
    kept = (edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
            .join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    return nodes.join(gone, "id", "left_anti"), kept.select(*edges.columns), gone


def export_entities(nodes: DataFrame) -> DataFrame:
    """Entity rows with labelled types; arrays joined, at most ten values."""
    label = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in NODE_LABELS.items()], F.col("type"))
    joined = [(F.array_join(F.slice(c, 1, 10), ", ") if t.startswith("array") else F.col(c)).alias(c)
              for c, t in nodes.dtypes if c not in ("id", "type", "name")]
    return nodes.select("id", label.alias("type"), F.coalesce("name", "id").alias("name"), *joined)


def export_relationships(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "source", "dst": "target"})


def concept_fields(nodes: DataFrame, edges: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """Fields with the concept they implement, and the columns of ``concepts`` (concept_id, ...), null for a concept that is
    not there. These join the edges, which are narrower than the fields, and the rows lie by the field's id."""
    imp = links(edges, "implementa").select(F.col("src").alias("id"), F.col("dst").alias("concept_id"))
    if concepts is not None:
        imp = large(imp).join(large(concepts), "concept_id", "left")
    return large(of_type(nodes, "field")).join(large(imp), "id")


def concept_quality(fields: DataFrame) -> DataFrame:
    """Average score, low fields and number of fields per concept; zero scores are unknown."""
    known = F.when(F.col("quality_score") > 0, F.col("quality_score"))
    return fields.groupBy("concept_id").agg(
        F.coalesce(F.avg(known), F.lit(0.0)).alias("avg_score"),
        F.sum((F.coalesce(known, F.lit(1.0)) < 0.4).cast("long")).alias("low_quality_count"),
        F.count(F.lit(1)).alias("total_fields"))


def concept_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Everything known about every concept, one row per item: (concept_id, section, ref_id, detail, score)."""
    concepts = large(of_type(nodes, "concept").select(F.col("id").alias("concept_id")))
    fields = concept_fields(nodes, edges)

    def rows(df: DataFrame, section: str, ref: str, detail, score=None) -> DataFrame:
        s = F.lit(None).cast("double") if score is None else score.cast("double")
        return df.select("concept_id", F.lit(section).alias("section"), F.col(ref).alias("ref_id"),
                         detail.cast("string").alias("detail"), s.alias("score"))

    # the neighbours of all kinds look up their names together, so the nodes move once
    kinds = [("classifier", "usa_clasificador", "src", "dst"), ("normative", "respaldado_por", "src", "dst"),
             ("context", "tiene_contexto", "src", "dst"), ("composite", "compone", "dst", "src"), ("derived_from", "deriva_de", "dst", "src")]
    ends = F.coalesce(*[F.when(F.col("type") == k, F.struct(F.lit(section).alias("section"), F.col(own).alias("concept_id"), F.col(other).alias("neighbor_id")))
                        for section, k, own, other in kinds])
    near = (edges.filter(F.col("type").isin([k for _, k, _, _ in kinds])).select(ends.alias("e"), "operation").select("e.*", "operation")
            .join(large(nodes.select(F.col("id").alias("neighbor_id"), "name")), "neighbor_id").join(concepts, "concept_id", "left_semi"))
    near = materialize(near.select("section", "concept_id", "neighbor_id", "name", "operation"))

    issues = (links(edges, "tiene_issue").select(F.col("src").alias("id"), F.col("dst").alias("issue_id"))
              .join(large(of_type(nodes, "quality_issue").select(F.col("id").alias("issue_id"), "issue_type", "severity")), "issue_id"))
    with_issue = large(fields.select("id", "concept_id")).join(issues, "id")
    meanings = near.filter("section = 'context'")
    several = meanings.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("concept_id")
    quality = concept_quality(fields)
    parts = [
        rows(fields, "field", "id", F.coalesce("source_db", F.lit("")), F.col("quality_score")),
        rows(with_issue, "quality_issue", "issue_id", F.col("severity")),
        near.filter("section <> 'context'").select(
            "concept_id", "section", F.col("neighbor_id").alias("ref_id"),
            F.when(F.col("section") == "composite", F.col("operation")).otherwise(F.col("name")).alias("detail"),
            F.lit(None).cast("double").alias("score")),
        rows(large(meanings).join(several, "concept_id", "left_semi"), "context_conflict", "neighbor_id", F.col("name")),
        rows(quality, "quality_summary", "concept_id", F.col("total_fields"), F.col("avg_score"))]
    return reduce(DataFrame.unionByName, parts)


def impact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How much depends on each concept. Interop paths are counted, never listed:
    n fields make n² - Σ n_source² ordered pairs of fields from different sources."""
    concepts = of_type(nodes, "concept").select(F.col("id").alias("concept_id"), "review_status")
    fields = concept_fields(nodes, edges).select("id", "concept_id", "source_db")
    per_source = fields.groupBy("concept_id", "source_db").agg(F.count(F.lit(1)).alias("k"))
    f = per_source.groupBy("concept_id").agg(F.sum("k").alias("fields"), F.sum(F.col("k") * F.col("k")).alias("_sq"))

    def count(kind: str, at: str, name: str) -> DataFrame:
        return links(edges, kind).groupBy(F.col(at).alias("concept_id")).agg(F.count(F.lit(1)).alias(name))

    ops = (links(edges, "transforma_a").select(F.col("src").alias("id")).join(large(fields), "id")
           .groupBy("concept_id").agg(F.count(F.lit(1)).alias("transform_operations")))
    out = concepts.join(f, "concept_id", "left")
    for part in (count("compone", "dst", "composites"), count("deriva_de", "dst", "derived_from"),
                 count("deriva_de", "src", "derives_to"), count("usa_clasificador", "src", "classifiers"),
                 count("respaldado_por", "src", "normatives"), ops):
        out = out.join(part, "concept_id", "left")
    hidden = F.col("review_status").isin("proposed", "rejected")
    n = F.coalesce("fields", F.lit(0))
    out = out.withColumn("interop_paths", F.when(hidden, F.lit(0)).otherwise(n * n - F.coalesce("_sq", F.lit(0))))
    kinds = ["fields", "interop_paths", "composites", "derived_from", "derives_to", "classifiers", "normatives",
             "transform_operations"]
    cols = [F.coalesce(F.col(k), F.lit(0)).cast("long").alias(k) for k in kinds]
    out = out.select("concept_id", *cols)
    return out.withColumn("total_impact", reduce(lambda a, b: a + b, [F.col(k) for k in kinds]))


def classifier_hierarchy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    up = neighbors(nodes, edges, "subconcepto_de", "out").select("id", F.lit("parent").alias("relation"), "neighbor_id", "name")
    down = neighbors(nodes, edges, "subconcepto_de", "in").select("id", F.lit("child").alias("relation"), "neighbor_id", "name")
    return up.unionByName(down)


def classifier_equivalents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Equivalences seen from both ends, flagged when the mapping is not one to one."""
    cls = of_type(nodes, "classifier").select("id")
    both = neighbors(nodes, edges, "equivalente_a", "out").unionByName(neighbors(nodes, edges, "equivalente_a", "in"))
    c = F.coalesce("cardinality", F.lit("1:1"))
    return (both.join(cls, "id", "left_semi")
            .select("id", F.col("neighbor_id"), c.alias("cardinality"), (c != "1:1").alias("needs_review")))


def context_conflicts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    per = links(edges, "tiene_contexto").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("meanings"))
    return (of_type(nodes, "concept").select("id", "name").join(per.filter("meanings > 1"), "id")
            .withColumnRenamed("id", "concept_id"))


def catalog_listing(nodes: DataFrame, edges: DataFrame, name: str | None = None, include_proposed: bool = False) -> DataFrame:
    """Concepts with standard, custodian, status, number of distinct sources and of norms."""
    c = visible(of_type(nodes, "concept"), include_proposed)
    if name is not None:
        c = c.filter(F.lower("name").contains(name.lower()))
    src = (concept_fields(nodes, edges).groupBy("concept_id", "source_db").agg(F.count(F.lit(1)).alias("k"))
           .groupBy("concept_id").agg(F.count(F.lit(1)).alias("sources"), F.sum("k").alias("fields")))
    norm = links(edges, "respaldado_por").groupBy(F.col("src").alias("concept_id")).agg(F.count(F.lit(1)).alias("citations"))
    out = c.select(F.col("id").alias("concept_id"), "name", "standard", "definition", "custodian", "review_status")
    return out.join(src, "concept_id", "left").join(norm, "concept_id", "left").fillna(0, ["sources", "fields", "citations"])


def governance_gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per concept and missing item: norm, custodian, population, capture method, standard."""
    backed = links(edges, "respaldado_por").select(F.col("src").alias("id")).distinct().withColumn("_backed", F.lit(True))
    c = of_type(nodes, "concept").join(backed, "id", "left")

    def empty(col: str):
        return F.coalesce(F.col(col), F.lit("")) == ""

    gaps = F.array_compact(F.array(
        F.when(F.col("_backed").isNull(), "normative"), F.when(empty("custodian"), "custodian"),
        F.when(empty("population"), "population"), F.when(empty("capture_method"), "capture_method"),
        F.when(empty("standard"), "standard")))
    return c.select(F.col("id").alias("concept_id"), F.explode(gaps).alias("gap"))


def source_insights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Quality snapshot per source."""
    f = (links(edges, "proviene_de").select(F.col("src").alias("id"), F.col("dst").alias("source_id"))
         .join(large(of_type(nodes, "field").select("id", "quality_score")), "id"))
    return f.groupBy("source_id").agg(
        F.avg("quality_score").alias("avg_quality"), F.count(F.lit(1)).alias("field_count"),
        F.sum((F.col("quality_score") < 0.4).cast("long")).alias("low_quality_count"))


def cross_source_concepts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Concepts implemented by more than one source."""
    per = (concept_fields(nodes, edges).select("concept_id", "source_db").distinct()
           .groupBy("concept_id").agg(F.count(F.lit(1)).alias("sources")))
    return per.filter("sources > 1")


def current_status(changes: DataFrame, key: str = "concept_id", ts: str = "ts") -> DataFrame:
    """Latest non-null value of every attribute of a change log."""
    attrs = [c for c in changes.columns if c not in (key, ts)]
    return changes.groupBy(key).agg(*[
        F.max_by(F.col(a), F.when(F.col(a).isNotNull(), F.col(ts))).alias(a) for a in attrs])


def quality_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Fields, average score, low fields and issues by severity per source."""
    f = of_type(nodes, "field")
    stored = F.col("quality_score")
    computed = (F.coalesce("completeness", F.lit(0.0)) * 0.4 + F.coalesce("consistency", F.lit(0.0)) * 0.3
                + F.coalesce("validity", F.lit(0.0)) * 0.2 + F.coalesce("uniqueness", F.lit(0.0)) * 0.1)
    score = F.when(F.coalesce(stored, F.lit(0.0)) == 0, computed).otherwise(stored)
    f = f.select("id", "source_db", score.alias("score"))
    base = f.groupBy("source_db").agg(F.count(F.lit(1)).alias("total_fields"), F.avg("score").alias("avg_quality"),
                                      F.sum((F.col("score") < 0.5).cast("long")).alias("low_quality"))
    issues = (links(edges, "tiene_issue").select(F.col("src").alias("id"), F.col("dst").alias("issue_id"))
              .join(of_type(nodes, "quality_issue").select(F.col("id").alias("issue_id"), "severity"), "issue_id")
              .join(large(f.select("id", "source_db")), "id").groupBy("source_db").agg(*[
                  F.sum((F.col("severity") == s).cast("long")).alias(f"{s}s") for s in ("error", "warning", "info")]))
    return base.join(issues, "source_db", "left").fillna(0, ["errors", "warnings", "infos"])


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by type with a total row, for nodes and edges."""
    def part(df: DataFrame, kind: str) -> DataFrame:
        return df.rollup("type").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(kind).alias("kind"), F.coalesce("type", F.lit("total")).alias("type"), "n")
    return part(nodes, "node").unionByName(part(edges, "edge"))


def review_coverage(nodes: DataFrame) -> DataFrame:
    s = F.coalesce("review_status", F.lit("approved"))
    known = ["approved", "proposed", "under_review", "rejected"]
    t = nodes.agg(F.count(F.lit(1)).alias("total"), *[F.sum((s == k).cast("long")).alias(k) for k in known])
    return t.select(
        "total", *known, (F.col("total") - sum(F.col(k) for k in known)).alias("other"),
        (F.col("approved") / F.col("total") * 100).alias("pct_approved"),
        (F.col("proposed") / F.col("total") * 100).alias("pct_proposed"),
        ((F.col("proposed") + F.col("under_review")) / F.col("total") * 100).alias("pct_pending"))
