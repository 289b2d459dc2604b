"""Semantic typing of columns: standards, patterns, reference lists, fingerprints, concepts.

All inputs are value counts (source, column, value, cnt) of whole columns. Value joins run
on distinct values; the columns and the standards are metadata.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datasteward.functions import text as tx
from datasteward.operators.profile import KEYS, counted, settled
from datasteward.sources.shared import materialize

# Words of a binary column.
BINARY_WORDS = ["s", "n", "si", "no", "y", "t", "f", "true", "false", "verdadero", "falso", "0", "1"]
# Name parts that support a type.
YEAR_NAMES = ["anio", "ano", "year", "periodo", "ejercicio"]
AGE_NAMES = ["edad", "age", "anos"]
PERCENT_NAMES = ["porcentaje", "percent", "rate", "tasa", "%"]
# Concept and standard that a semantic type suggests.
TYPE_CONCEPTS = {"date": ("fecha", "ISO_8601"), "identifier_dui": ("dui", None), "identifier_nit": ("nit", None),
                 "email": ("email", None), "boolean": ("indicador_booleano", None), "age": ("edad", None),
                 "percentage": ("porcentaje", None), "year": ("anio", None)}
# Concept that a reference list suggests.
LIST_CONCEPTS = {"departamentos_sv": "departamento", "municipios_sv": "municipio", "meses_es": "mes",
                 "dias_semana_es": "dia_semana", "genero_binario": "sexo", "estado_civil": "estado_civil",
                 "nivel_educativo": "nivel_educativo", "tipo_sangre": "tipo_sangre"}


@dataclass
class Standard:
    standard_id: str
    name: str = ""
    kind: str = "classifier"
    regex: str | None = None
    hints: list[str] = field(default_factory=list)
    domain: str = "transversal"


@dataclass
class ContextRule:
    keywords: list[str]
    label: str
    population: str
    method: str


# Ordered rules from a source name to its capture context.
CONTEXT_RULES = [
    ContextRule(["censo", "agri"], "censo_agricola", "productores agricolas", "censo"),
    ContextRule(["monitoreo", "ambiental", "marn"], "monitoreo_ambiental", "ecosistemas nacionales", "monitoreo remoto"),
    ContextRule(["agri", "mag"], "agricola", "productores agricolas", "censo"),
    ContextRule(["censo"], "censo", "poblacion general", "auto-reporte"),
    ContextRule(["hospital", "clinica"], "hospital", "pacientes atendidos", "registro clinico"),
    ContextRule(["seguro", "aseguradora", "afiliacion"], "seguro", "afiliados", "formulario administrativo"),
    ContextRule(["encuesta", "survey", "muestra"], "encuesta", "muestra poblacional", "entrevista"),
    ContextRule(["registro", "padron"], "registro", "poblacion registrada", "registro administrativo"),
    ContextRule(["financiero", "contable", "presupuesto"], "financiero", "transacciones", "sistema transaccional"),
    ContextRule(["educacion", "escolar", "matricula"], "educacion", "estudiantes matriculados", "registro academico"),
]


def _any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def infer_context(sources: DataFrame, name: str = "source", rules: list[ContextRule] = CONTEXT_RULES) -> DataFrame:
    """Label, population and capture method of each source by the first rule that fits its name."""
    low = F.lower(F.col(name))

    def pick(attr: str, default) -> Column:
        return F.coalesce(*[F.when(_any(low, r.keywords), F.lit(getattr(r, attr))) for r in rules], default)

    return sources.withColumns({"context_label": pick("label", F.col(name)), "population": pick("population", F.lit("no definida")),
                                "capture_method": pick("method", F.lit("no definida"))})


def _local(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def _present(vf: DataFrame) -> DataFrame:
    """Non-missing distinct values with their stripped text."""
    s = counted(vf).withColumn("s", tx.strip(F.col("value")))
    return s.filter(~tx.is_missing(F.col("value"), s=F.col("s")))


def detect_standard(vf: DataFrame, standards: list[Standard], standard_values: DataFrame) -> DataFrame:
    """Candidate standards per column with confidence and rank.

    By name hint (high), by pattern on more than half of the distinct values (high), by
    codes that cover at least half of the distinct values (medium). Rank 1 is the candidate
    found first in that order.
    """
    vf = settled(vf)
    v = _present(vf)
    cols = counted(vf).select(*KEYS).distinct()
    hint_rows = [(s.standard_id, i, h.lower()) for i, s in enumerate(standards) for h in s.hints] or [("", 0, "\x00")]
    hints = F.broadcast(_local(vf, hint_rows, "standard_id string, ord int, hint string"))
    found = [cols.join(hints, F.lower(F.trim("column")) == F.col("hint"))
             .select(*KEYS, "standard_id", "ord", F.lit(1).alias("branch"), F.lit("high").alias("confidence")).distinct()]
    patterns = [(i, s) for i, s in enumerate(standards) if s.regex]
    if patterns:
        key = F.upper("s")
        hit = v.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), *[
            F.sum(key.rlike(f"^(?:{s.regex})").cast("long")).alias(f"m{i}") for i, s in patterns])
        each = F.explode(F.array_compact(F.array(*[
            F.when(F.col(f"m{i}") > F.col("n") * 0.5, F.struct(F.lit(s.standard_id).alias("standard_id"), F.lit(i).alias("ord")))
            for i, s in patterns])))
        found.append(hit.select(*KEYS, each.alias("s")).select(*KEYS, "s.*", F.lit(2).alias("branch"), F.lit("high").alias("confidence")))
    keys = v.select(*KEYS, F.upper("s").alias("k")).distinct()
    n = keys.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    codes = standard_values.select("standard_id", F.upper("code").alias("k")).distinct()
    order = F.broadcast(_local(vf, [(s.standard_id, i) for i, s in enumerate(standards)], "standard_id string, ord int"))
    cover = (keys.join(codes, "k").groupBy(*KEYS, "standard_id").agg(F.count(F.lit(1)).alias("c"))
             .join(F.broadcast(n), KEYS).filter(F.col("c") >= F.col("n") * 0.5).join(order, "standard_id"))
    found.append(cover.select(*KEYS, "standard_id", "ord", F.lit(3).alias("branch"), F.lit("medium").alias("confidence")))
    every = reduce(DataFrame.unionByName, found)
    best = every.groupBy(*KEYS, "standard_id", "ord").agg(
        F.min("branch").alias("branch"), F.min("confidence").alias("confidence"))  # 'high' sorts before 'medium'
    w = Window.partitionBy(*KEYS).orderBy("branch", "ord")
    return best.withColumn("rank", F.row_number().over(w)).drop("ord")


def overlap_with_sets(vf: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Best set per column by overlap of normalised values over the smaller side.

    ``sets`` is (name, value_norm). Only sets with an overlap of at least 0.6 are returned.
    """
    keys = _present(vf).select(*KEYS, tx.normalize_text(F.col("value")).alias("value_norm")).distinct()
    s = sets.select(name, "value_norm").distinct()
    n = keys.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    m = s.groupBy(name).agg(F.count(F.lit(1)).alias("m"))
    o = (keys.join(s, "value_norm").groupBy(*KEYS, name).agg(F.count(F.lit(1)).alias("c"))
         .join(F.broadcast(n), KEYS).join(m, name)
         .withColumn("overlap", F.col("c") / F.least("n", "m")).filter("overlap >= 0.6"))
    best = o.groupBy(*KEYS).agg(F.min(F.struct((-F.col("overlap")).alias("neg"), F.col(name).alias("name"))).alias("b"))
    return best.select(*KEYS, F.col("b.name").alias(name), (-F.col("b.neg")).alias("overlap"),
                       F.when(-F.col("b.neg") >= 0.8, "high").otherwise("medium").alias("confidence"))


def match_reference_list(vf: DataFrame, lists: DataFrame) -> DataFrame:
    return overlap_with_sets(vf, lists, "list_name")


def fingerprint_match(vf: DataFrame, concept_values: DataFrame) -> DataFrame:
    """``concept_values`` is (concept_id, value_norm), the values of the fields of each concept."""
    return overlap_with_sets(vf, concept_values, "concept_id")


def concept_values(fields: DataFrame) -> DataFrame:
    """(concept_id, value_norm) from fields with their concept and sample values."""
    v = fields.select("concept_id", F.explode("sample_values").alias("v"))
    return v.select("concept_id", tx.normalize_text(F.col("v")).alias("value_norm")).filter("value_norm <> ''").distinct()


def pattern_type(vf: DataFrame, min_ratio: float = 0.0) -> DataFrame:
    """Semantic type by format and name, one row per column that has one.

    Formats of identifiers, dates and addresses fire when any distinct value fits; with
    ``min_ratio`` that share of the distinct values must fit.
    """
    v = _present(vf)
    s, p = F.col("s"), {k: F.col("s").rlike(x) for k, x in tx.VALUE_PATTERNS.items()}
    digits, commas = s.rlike(r"^-?[\d.]+$"), s.rlike(r"^-?[\d.,]+$")
    x = tx.parse_number(s, s)

    def n(c: Column) -> Column:
        return F.sum(F.coalesce(c, F.lit(False)).cast("long"))

    a = v.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("u"), n(p["date_iso"] | p["date_latino"]).alias("dates"), n(p["year"]).alias("years"),
        n(p["dui_sv"]).alias("duis"), n(p["nit_sv"]).alias("nits"), n(p["email"]).alias("mails"),
        n(tx.normalize_text(s).isin(BINARY_WORDS)).alias("bins"),
        n(digits).alias("digs"), n(digits & (x > -1) & (x < 121)).alias("ages"),
        n(commas).alias("nums"), n(commas & (x >= 0) & (x <= 100)).alias("pcts"), n(s.rlike(r"^\p{Lu}")).alias("caps"))
    name, u = tx.normalize_text(F.col("column")), F.col("u")

    def fires(c: str) -> Column:
        return (F.col(c) > 0) & (F.col(c) >= u * min_ratio)

    kind = (F.when(fires("dates"), "date")
            .when(_any(name, YEAR_NAMES) & (F.col("years") / u > 0.8), "year")
            .when(fires("duis"), "identifier_dui").when(fires("nits"), "identifier_nit").when(fires("mails"), "email")
            .when((u <= 2) & (F.col("bins") == u), "boolean")
            .when((u <= 120) & (F.col("digs") > 0) & (F.col("ages") == F.col("digs")) & _any(name, AGE_NAMES), "age")
            .when((F.col("nums") > 0) & (F.col("pcts") == F.col("nums")) & _any(name, PERCENT_NAMES), "percentage")
            .when((u > 2) & (u <= 500) & (F.col("nums") == 0) & (F.col("caps") / u > 0.7), "geographic_candidate"))
    return a.select(*KEYS, kind.alias("semantic_type")).filter("semantic_type is not null")


def _lookup(c: Column, table: dict[str, str | None]) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in table.items()])


def infer_semantic_type(vf: DataFrame, lists: DataFrame, concepts: DataFrame | None = None,
                        concept_names: DataFrame | None = None, min_ratio: float = 0.0) -> DataFrame:
    """Type of each column: definite pattern, then reference list, then fingerprint, then candidate."""
    vf = settled(vf)
    cols = vf.select(*KEYS).distinct()
    t = pattern_type(vf, min_ratio)
    r = match_reference_list(vf, lists).select(*KEYS, F.col("list_name").alias("_list"), F.col("overlap").alias("_lo"), F.col("confidence").alias("_lc"))
    out = cols.join(t, KEYS, "left").join(r, KEYS, "left")
    if concepts is not None:
        f = fingerprint_match(vf, concepts).select(*KEYS, F.col("concept_id").alias("_concept"), F.col("overlap").alias("_fo"), F.col("confidence").alias("_fc"))
        if concept_names is not None:
            f = f.join(concept_names.select(F.col("concept_id").alias("_concept"), F.col("name").alias("_cname")), "_concept", "left")
        else:
            f = f.withColumn("_cname", F.col("_concept"))
        out = out.join(f, KEYS, "left")
    else:
        out = out.withColumns({"_concept": F.lit(None).cast("string"), "_fo": F.lit(None).cast("double"), "_fc": F.lit(None).cast("string"), "_cname": F.lit(None).cast("string")})
    kind = F.col("semantic_type")
    definite = F.coalesce(kind.isin(list(TYPE_CONCEPTS)), F.lit(False))
    by_list = ~definite & F.col("_list").isNotNull()
    by_print = ~definite & F.col("_list").isNull() & F.col("_concept").isNotNull()
    return out.select(
        *KEYS, F.when(definite | ~(by_list | by_print), kind).alias("semantic_type"),
        F.when(by_list, F.col("_list")).alias("reference_match"), F.when(by_print, F.col("_concept")).alias("matched_concept"),
        F.when(definite, "high").when(by_list, F.col("_lc")).when(by_print, F.col("_fc")).otherwise("low").alias("confidence"),
        F.when(definite, _lookup(kind, {k: v[0] for k, v in TYPE_CONCEPTS.items()}))
        .when(by_list, F.coalesce(_lookup(F.col("_list"), LIST_CONCEPTS), F.col("_list"))).when(by_print, F.col("_cname")).alias("suggested_concept"),
        F.when(definite, _lookup(kind, {k: v[1] for k, v in TYPE_CONCEPTS.items()})).alias("suggested_standard"),
        F.coalesce(F.when(by_list, F.col("_lo")).when(by_print, F.col("_fo")), F.lit(0.0)).alias("overlap"))


def _grams(c: Column) -> Column:
    """All substrings of one to three letters."""
    def of(n: int) -> Column:
        last = F.length(c) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def containing_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of distinct names (a.name, b.name) of which one contains the other.

    Found by an equi-join on the first three letters of the contained name.
    """
    x = a.select(F.col("name").alias("na")).filter("na <> ''").distinct()
    y = b.select(F.col("name").alias("nb")).filter("nb <> ''").distinct()
    ia = x.withColumn("g", F.substring("na", 1, 3)).join(y.withColumn("g", F.explode(_grams(F.col("nb")))), "g").filter(F.col("nb").contains(F.col("na")))
    ib = x.withColumn("g", F.explode(_grams(F.col("na")))).join(y.withColumn("g", F.substring("nb", 1, 3)), "g").filter(F.col("na").contains(F.col("nb")))
    return ia.select("na", "nb").union(ib.select("na", "nb")).distinct()


def match_to_concepts(vf: DataFrame, facts: DataFrame, standards: list[Standard], standard_values: DataFrame, concepts: DataFrame,
                      lists: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """Concept of each column by the first step that answers.

    standard rule, exact name, codes of the concept's standard, partial name with values,
    inferred type, none. ``facts`` is (source, column, unique_count); ``concepts`` is
    (concept_id, name, standard); ``fields`` adds fingerprints (concept_id, sample_values).
    """
    vf = settled(vf)
    cols = facts.select(*KEYS, "unique_count", tx.clean_column_name(F.col("column")).alias("clean_name"))
    cols = materialize(cols)  # one row per column
    none = F.lit(None).cast("string")

    def step(df: DataFrame, no: int, concept: Column, standard: Column, confidence: Column, method: Column) -> DataFrame:
        return df.select(*KEYS, F.lit(no).alias("step_no"), F.struct(
            concept.alias("proposed_concept"), standard.alias("standard"), confidence.alias("confidence"), method.alias("method")).alias("r"))

    named = {s.standard_id: s.hints[0].lower().replace(" ", "_") for s in standards if s.kind == "classifier" and s.hints}
    names = F.broadcast(cols.select(*KEYS, "clean_name"))
    clean_vf = settled(vf.join(names, KEYS).select("source", F.col("clean_name").alias("column"), "value", "cnt"))
    rule = detect_standard(clean_vf, standards, standard_values).filter("rank = 1").withColumnRenamed("column", "clean_name")
    rule = cols.join(rule, ["source", "clean_name"])
    concept = _lookup(F.col("standard_id"), named) if named else none
    steps = [step(rule, 1, concept, F.col("standard_id"), F.col("confidence"), F.lit("rule_based"))]

    first = concepts.groupBy("name").agg(F.min_by("standard", "concept_id").alias("standard"))
    exact = cols.join(first, cols["clean_name"] == first["name"])
    fits = F.col("standard").isNull() | (F.col("unique_count") <= 1000)
    steps.append(step(exact, 2, F.col("name"), F.col("standard"), F.when(fits, "high").otherwise("medium"),
                      F.when(fits, "exact_name_match").otherwise("exact_name_match_cardinality_mismatch")))

    # share of a column's values among the codes of each standard in use; one concept stands for a standard
    keys = _present(vf).select(*KEYS, F.upper("s").alias("k")).distinct()
    n = keys.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    codes = standard_values.select(F.col("standard_id").alias("standard"), F.upper("code").alias("k")).distinct()
    share = (keys.join(codes, "k").groupBy(*KEYS, "standard").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(n), KEYS)
             .select(*KEYS, "standard", (F.col("c") / F.col("n")).alias("share")))
    lead = concepts.filter("standard is not null").groupBy("standard").agg(F.min_by("name", "concept_id").alias("name"), F.min("concept_id").alias("cid"))
    byval = share.filter("share >= 0.5").join(lead, "standard").groupBy(*KEYS).agg(
        F.min(F.struct((-F.col("share")).alias("neg"), "cid", "name", "standard")).alias("b"))
    steps.append(step(byval, 3, F.col("b.name"), F.col("b.standard"), F.when(-F.col("b.neg") >= 0.8, "high").otherwise("medium"), F.lit("value_distribution_match")))

    pairs = containing_names(cols.select(F.col("clean_name").alias("name")), concepts)
    tokens = F.arrays_overlap(F.split("na", "_"), F.split("nb", "_"))
    named_pairs = pairs.withColumn("name_score", F.when(tokens, 0.7).otherwise(0.5))
    byid = concepts.groupBy("name").agg(F.min("concept_id").alias("cid"), F.min_by("standard", "concept_id").alias("standard"))
    lead_name = named_pairs.join(byid, F.col("nb") == F.col("name")).groupBy("na").agg(
        F.min(F.struct((-F.col("name_score")).alias("neg"), "cid", F.col("nb").alias("name"), "standard")).alias("b"))
    part = (cols.join(lead_name, F.col("clean_name") == F.col("na")).select(*KEYS, "b.*")
            .join(share, [*KEYS, "standard"], "left"))
    comb = F.round(-F.col("neg") * 0.6 + F.coalesce("share", F.lit(0.0)) * 0.4, 9)
    part = part.withColumn("comb", comb).filter("comb >= 0.5")
    steps.append(step(part, 4, F.col("name"), F.col("standard"), F.when(F.col("comb") >= 0.6, "medium").otherwise("low"), F.lit("partial_name_value_match")))

    prints = None if fields is None else concept_values(fields)
    inf = infer_semantic_type(clean_vf, lists, prints).withColumnRenamed("column", "clean_name")
    inf = cols.join(inf, ["source", "clean_name"]).filter(F.col("confidence").isin("high", "medium"))
    steps.append(step(inf, 5, F.coalesce("matched_concept", "suggested_concept"), F.col("suggested_standard"), F.col("confidence"),
                      F.concat(F.lit("inference_"), F.coalesce("semantic_type", "reference_match", F.lit("fingerprint")))))
    steps.append(step(cols, 6, none, none, F.lit("low"), F.lit("no_match")))
    best = reduce(DataFrame.unionByName, steps).groupBy(*KEYS).agg(F.min_by("r", "step_no").alias("r"))
    return cols.select(*KEYS, "clean_name").join(best, KEYS).select(*KEYS, "clean_name", "r.*")


def discovery_gaps(matches: DataFrame, inferred: DataFrame, standards: DataFrame) -> DataFrame:
    """Columns without a concept, with the concept and standard that could be created for them."""
    open_ = matches.filter("proposed_concept is null").select(*KEYS, "clean_name", F.col("confidence").alias("_mc"))
    i = inferred.select(*KEYS, "suggested_concept", "suggested_standard", F.col("confidence").alias("_ic"))
    s = standards.filter("rank = 1").select(*KEYS, "standard_id")
    t = open_.join(i, KEYS, "left").join(s, KEYS, "left")
    return t.select(*KEYS, F.coalesce("suggested_concept", "clean_name").alias("suggested_concept"),
                    F.coalesce("standard_id", "suggested_standard").alias("detected_standard"),
                    F.when(F.coalesce("_ic", F.lit("low")) != "low", F.col("_ic")).otherwise(F.col("_mc")).alias("confidence"))


def resolution_coverage(matches: DataFrame) -> DataFrame:
    """Columns and share per resolution method and source."""
    n = matches.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    return (matches.groupBy("source", "method").agg(F.count(F.lit(1)).alias("columns")).join(F.broadcast(n), "source")
            .select("source", "method", "columns", (F.col("columns") / F.col("total")).alias("share")))


def plan_confidence(matches: DataFrame) -> DataFrame:
    """Confidence of an ingestion plan per source and whether a person must review it."""
    c = F.col("confidence")
    t = matches.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum((c == "high").cast("long")).alias("high"), F.sum((c == "medium").cast("long")).alias("medium"),
                                      F.count("proposed_concept").alias("mapped"))
    level = F.when(F.col("high") > F.col("n") * 0.6, "high").when(F.col("high") + F.col("medium") > F.col("n") * 0.5, "medium").otherwise("low")
    return t.select("source", F.col("n").alias("columns"), "mapped", level.alias("confidence"), (level != "high").alias("requires_review"))


def interop_candidates(assessed: DataFrame, sources: DataFrame) -> DataFrame:
    """Columns with a concept against every other registered source (metadata on both sides)."""
    a = assessed.filter("concept is not null").select("source", "column", "concept", "confidence")
    s = sources.select(F.col("name").alias("target_source")).distinct()
    return a.join(F.broadcast(s), F.col("source") != F.col("target_source")).distinct()


def enrich_columns(assessed: DataFrame, metadata: DataFrame) -> DataFrame:
    """Fill unmatched columns from a metadata table (column_name, concept, standard, definition)."""
    m = metadata.groupBy(F.lower(F.trim("column_name")).alias("_k")).agg(
        F.min(F.struct("concept", "standard", "definition")).alias("m"))
    t = assessed.join(m, F.lower("column") == F.col("_k"), "left")
    open_ = F.col("match_status") == "unmatched"
    return t.select(
        "source", "column",
        F.when(open_ & F.col("m").isNotNull(), "enriched").otherwise(F.col("match_status")).alias("match_status"),
        F.when(open_, F.coalesce("concept", "m.concept")).otherwise(F.col("concept")).alias("concept"),
        F.when(open_, F.coalesce("standard", "m.standard")).otherwise(F.col("standard")).alias("standard"),
        F.col("m.definition").alias("definition"))


def map_synonyms(columns: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """(source, column, canonical) of the columns whose name is a canonical name or a synonym."""
    rows = sorted({(w.lower(), c) for c, ws in synonyms.items() for w in [c, *ws]})
    table = columns.sparkSession.createDataFrame(rows, "w string, canonical string")
    return (columns.join(F.broadcast(table), F.lower("column") == F.col("w"), "left")
            .groupBy("source", "column").agg(F.min("canonical").alias("canonical")))
