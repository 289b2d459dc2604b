"""Which required variables the catalog can supply, and how promising a study is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasteward.operators.catalog import concept_fields, concept_quality, of_type
from datasteward.operators.semantic import containing_names
from datasteward.sources.shared import materialize

# Extra keywords of concepts whose name contains the key.
CONCEPT_WORDS = {
    "edad": ["nino", "anos", "age"], "sexo": ["genero", "gender", "masculino", "femenino"],
    "diagnostico": ["cie", "cie10", "enfermedad", "morbilidad", "diag"],
    "fecha_nacimiento": ["fecha_nac", "nacimiento", "birth"], "fecha_ingreso": ["f_ingreso", "ingreso", "admission"],
    "municipio": ["municipalidad", "distrito", "ciudad", "residencia"],
    "nivel_educativo": ["escolaridad", "educacion", "instruccion", "education"], "nombre_completo": ["nombre", "name"],
    "ocupacion": ["trabajo", "profesion", "occupation"], "pais": ["country", "nacionalidad"],
    "year": ["ano", "fecha", "periodo"], "valor": ["value", "magnitud", "magnitude"], "indicador": ["indicator", "metrica", "metric"],
}


def _words(c):
    return F.array_distinct(F.filter(F.split(F.replace(F.lower(c), F.lit("_"), F.lit(" ")), r"\s+"), lambda w: w != ""))


def _containing_sets(vw: DataFrame, fw: DataFrame) -> DataFrame:
    """(name, concept_id) where one of the word sets vw and fw holds the other.

    The smaller set is joined by its rarest word alone, so a word that most names share joins only the sets that have
    nothing rarer; the rest is a test on the joined rows."""
    often = (fw.select(F.explode("fw").alias("w")).unionAll(vw.select(F.explode("vw").alias("w")))
             .groupBy("w").agg(F.count(F.lit(1)).alias("n")))

    def rarest(df: DataFrame, words: str, key: list[str]) -> DataFrame:
        return (df.withColumn("w", F.explode(words)).join(often, "w").groupBy(*key, words)
                .agg(F.min(F.struct("n", "w")).alias("m")).select(*key, words, F.col("m.w").alias("w")))
    inside = rarest(vw, "vw", ["name"]).join(fw.withColumn("w", F.explode("fw")), "w").filter(F.size(F.array_except("vw", "fw")) == 0)
    around = rarest(fw, "fw", ["concept_id"]).join(vw.withColumn("w", F.explode("vw")), "w").filter(F.size(F.array_except("fw", "vw")) == 0)
    return inside.select("name", "concept_id").unionAll(around.select("name", "concept_id"))


def match_variables(variables: DataFrame, nodes: DataFrame, edges: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(name, concept_id, step): exact name, partial name, field name, field words, keywords.

    Concepts with equal names, and equal word sets, are reduced to the first one before any
    join, so the joins grow with the vocabulary and not with the catalog. Each step is written once, because later ones
    leave out what earlier ones found. ``fields`` are the rows of ``concept_fields``, if the caller has them.
    """
    v = variables.select("name", F.lower("name").alias("low"), F.coalesce("description", F.lit("")).alias("description"))
    c = of_type(nodes, "concept").select(F.col("id").alias("concept_id"), F.lower(F.coalesce("name", F.lit(""))).alias("cname"),
                                         F.coalesce("definition", F.lit("")).alias("definition"))
    by_name = c.groupBy("cname").agg(F.min("concept_id").alias("concept_id"))

    def step(df: DataFrame, no: int) -> DataFrame:
        return df.groupBy("name").agg(F.min("concept_id").alias("concept_id")).withColumn("step", F.lit(no))

    steps = [step(v.join(by_name, F.col("low") == F.col("cname")), 1)]
    inside = containing_names(v.select(F.col("low").alias("name")), by_name.select(F.col("cname").alias("name")))
    steps.append(step(v.join(inside, F.col("low") == F.col("na")).join(by_name, F.col("nb") == F.col("cname")), 2))
    fields = concept_fields(nodes, edges) if fields is None else fields
    names = materialize(fields.select(F.lower("column").alias("fname"), "concept_id").filter("fname <> ''")
                        .groupBy("fname").agg(F.min("concept_id").alias("concept_id")))
    steps.append(step(v.join(names, F.col("low") == F.col("fname")), 3))
    steps = [materialize(reduce(DataFrame.unionByName, steps))]
    vw = materialize(v.join(steps[0].select("name"), "name", "left_anti").select("name", _words(F.col("low")).alias("vw")))
    fw = materialize(names.select("concept_id", _words(F.col("fname")).alias("fw"))
                     .groupBy(F.array_sort("fw").alias("fw")).agg(F.min("concept_id").alias("concept_id")))
    steps.append(materialize(step(_containing_sets(vw, fw), 4)))
    extra = F.flatten(F.array(*[F.when(F.col("cname").contains(k), F.array(*[F.lit(w) for w in ws])).otherwise(F.array().cast("array<string>"))
                                for k, ws in CONCEPT_WORDS.items()]))
    kw = (c.select("concept_id", F.array_sort(F.array_distinct(F.concat(_words(F.col("cname")), _words(F.col("definition")), extra))).alias("cw"))
          .groupBy("cw").agg(F.min("concept_id").alias("concept_id")))
    done = reduce(DataFrame.unionByName, steps).select("name").distinct()
    rest = v.join(done, "name", "left_anti").select("name", F.array_distinct(F.concat(_words(F.col("low")), _words(F.col("description")))).alias("vw"))
    score = (rest.withColumn("w", F.explode("vw")).join(kw.withColumn("w", F.explode("cw")).drop("cw"), "w")
             .groupBy("name", "vw", "concept_id").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("score", F.col("n") / F.size("vw")).filter("score >= 0.15"))
    best = score.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("neg"), "concept_id")).alias("b")).select("name", "b.concept_id", F.lit(5).alias("step"))
    return (reduce(DataFrame.unionByName, [*steps, best]).groupBy("name")
            .agg(F.min_by("concept_id", "step").alias("concept_id"), F.min("step").alias("step")))


def feasibility(variables: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Status of each required variable: available or gap, sources, quality, usable."""
    fields = materialize(concept_fields(nodes, edges).select("concept_id", "source_db", "column", "quality_score"))
    q = concept_quality(fields)
    src = fields.select("concept_id", "source_db").distinct().groupBy("concept_id").agg(F.count("source_db").alias("sources"))
    c = of_type(nodes, "concept").select(F.col("id").alias("concept_id"), F.coalesce("review_status", F.lit("approved")).alias("review_status"))
    m = match_variables(variables, nodes, edges, fields).join(c, "concept_id").join(q, "concept_id", "left").join(src, "concept_id", "left")
    t = variables.select("name").join(m, "name", "left").fillna({"total_fields": 0, "avg_score": 0.0, "sources": 0})
    usable = (F.col("total_fields") > 0) & (F.col("avg_score") >= 0.4) & ~F.col("review_status").isin("proposed", "rejected")
    return t.select("name", F.when(F.col("concept_id").isNull(), "gap").otherwise("available").alias("status"), "concept_id", "step",
                    F.col("total_fields").alias("field_count"), "sources", F.col("avg_score").alias("quality_score"),
                    F.coalesce(usable, F.lit(False)).alias("usable"))


def coverage(status: DataFrame) -> DataFrame:
    t = status.agg(F.count(F.lit(1)).alias("total"), F.sum((F.col("status") == "available").cast("long")).alias("available"))
    return t.select("total", "available", (F.col("total") - F.col("available")).alias("gaps"), (F.col("available") / F.col("total") * 100).alias("percentage"))


def rank_opportunities(variables: DataFrame) -> DataFrame:
    """Score per hypothesis from rows (hypothesis, status, quality_score, source).

    coverage x average quality of the available variables x 1.5 when they come from more than
    one source, plus a bonus of at most 0.3 for many variables.
    """
    ok = F.col("status") == "available"
    t = variables.groupBy("hypothesis").agg(
        F.count(F.lit(1)).alias("n"), F.sum(ok.cast("long")).alias("available"), F.coalesce(F.avg(F.when(ok, F.col("quality_score"))), F.lit(0.0)).alias("quality"),
        F.min(F.when(ok, F.col("source"))).alias("s0"), F.max(F.when(ok, F.col("source"))).alias("s1"))
    cross = F.coalesce(F.col("s0") != F.col("s1"), F.lit(False))
    score = (F.col("available") / F.col("n")) * F.col("quality") * F.when(cross, 1.5).otherwise(1.0) + F.least(F.col("n") / 10.0, F.lit(0.3))
    return t.select("hypothesis", "n", "available", F.col("quality").alias("avg_quality"), cross.alias("cross_domain"), score.alias("score")).orderBy(F.desc("score"), "hypothesis")
