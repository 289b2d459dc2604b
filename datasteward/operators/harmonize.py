"""Mapping of source values to the codes of a standard, and harmonised unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasteward.functions import text as tx


def _trigrams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))),
                                        lambda i: F.substring(c, i, F.lit(3))))


def value_mappings(values: DataFrame, codes: DataFrame, regex: str | None = None) -> DataFrame:
    """Canonical code of each distinct value: (value, code, step); unmapped values keep a null code.

    Steps in order: exact code, upper-case code, label, partial label, pattern. ``codes`` has
    code, label and ord (catalog order). A partial match means that the value contains the
    label or the reverse, both at least three characters long; the two sides are found by an
    equi-join on the first three letters of the shorter text, not by comparing all with all.
    """
    v = (values.select(tx.strip(F.col("value")).alias("value")).filter("value <> ''").distinct()
         .withColumn("u", F.upper("value")))
    c = codes.select("code", "ord", F.upper("label").alias("ul"))
    first = F.min_by("code", "ord").alias("code")
    exact = v.join(c.select("code").distinct(), F.col("value") == F.col("code")).select("value", "code", F.lit(1).alias("step"))
    upper = v.join(c.select("code").distinct(), F.col("u") == F.col("code")).select("value", "code", F.lit(2).alias("step"))
    by_label = c.groupBy("ul").agg(F.max_by("code", "ord").alias("code"))
    label = v.join(by_label, F.col("u") == F.col("ul")).select("value", "code", F.lit(3).alias("step"))
    done = exact.unionByName(upper).unionByName(label)
    left = v.join(done.select("value").distinct(), "value", "left_anti").filter(F.length("u") >= 3)
    lab = c.filter(F.length("ul") >= 3)
    inside = (left.withColumn("g", F.substring("u", 1, 3))
              .join(lab.withColumn("g", F.explode(_trigrams(F.col("ul")))), "g").filter(F.col("ul").contains(F.col("u"))))
    around = (left.withColumn("g", F.explode(_trigrams(F.col("u"))))
              .join(lab.withColumn("g", F.substring("ul", 1, 3)), "g").filter(F.col("u").contains(F.col("ul"))))
    partial = (inside.select("value", "code", "ord").unionByName(around.select("value", "code", "ord"))
               .groupBy("value").agg(first).select("value", "code", F.lit(4).alias("step")))
    found = done.unionByName(partial)
    if regex:
        fits = v.filter(F.col("u").rlike("^(?:" + regex + ")")).select("value", F.col("u").alias("code"), F.lit(5).alias("step"))
        found = found.unionByName(fits)
    best = found.groupBy("value").agg(F.min_by("code", "step").alias("code"), F.min("step").alias("step"))
    return v.select("value").join(best, "value", "left")


def standardize(df: DataFrame, column: str, codes: DataFrame, regex: str | None = None, target: str | None = None) -> DataFrame:
    """Add the canonical code of ``column``; the mapping is made on distinct values."""
    target = target or f"{column}_canonico"
    m = value_mappings(df.select(F.col(column).cast("string").alias("value")).filter("value is not null"), codes, regex)
    m = m.filter("code is not null").select(F.col("value").alias("_v"), F.col("code").alias(target))
    return df.withColumn("_v", tx.strip(F.col(column).cast("string"))).join(m, "_v", "left").drop("_v")


def apply_mapping(df: DataFrame, column: str, mapping: DataFrame, target: str) -> DataFrame:
    """Translate a column through (code_src, code_dst); unmapped values become null."""
    m = mapping.select(F.col("code_src").alias("_v"), F.col("code_dst").alias(target)).distinct()
    return df.withColumn("_v", F.col(column).cast("string")).join(m, "_v", "left").drop("_v")


def case_when_text(mapping: DataFrame, keys: list[str], column: str, target: str) -> DataFrame:
    """The same mapping as SQL text for review, one statement per mapping."""
    def quoted(c: str) -> Column:
        return F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'"))

    when = F.concat(F.lit(f'WHEN "{column}" = '), quoted("code_src"), F.lit(" THEN "), quoted("code_dst"))
    return mapping.withColumn("_w", when).groupBy(*keys).agg(
        F.concat(F.lit("CASE "), F.array_join(F.sort_array(F.collect_list("_w")), " "),
                 F.lit(f' ELSE NULL END AS "{target}"')).alias("sql"))


def case_text_lines(df: DataFrame, column: str, codes: DataFrame, standard: str, name: str, regex: str | None = None,
                    target: str | None = None) -> DataFrame:
    """(part, value, line): the CASE text that brings ``column`` to ``standard``, one row per line, for review.

    In the order of part and value it reads: 0 a heading, 1 a WHEN per mapped value with its spellings and the label of its
    code, 2 a warning with the number of unmapped values and the first five of them, 3 the end. A column has as many lines as
    it has distinct values, so they stay rows. An empty code list gives only a note."""
    def quoted(c: Column, mark: str = "'") -> Column:
        return F.concat(F.lit(mark), F.replace(c, F.lit(mark), F.lit(mark * 2)), F.lit(mark))

    def line(rows: DataFrame, part: int, text: Column) -> DataFrame:
        return rows.select(F.lit(part).alias("part"), F.lit("").alias("value"), text.alias("line"))

    m = value_mappings(df.select(F.col(column).cast("string").alias("value")).filter("value is not null"), codes, regex)
    unmapped = m.filter("code is null")
    figures = reduce(DataFrame.union, [codes.select(F.lit("n"), "code"), unmapped.select(F.lit("lost"), "value"),
                                       unmapped.orderBy("value").limit(5).select(F.lit("first"), "value")]).toDF("k", "v")
    one = figures.agg(*[F.count(F.when(F.col("k") == k, 1)).alias(k) for k in ("n", "lost")], F.array_join(
        F.sort_array(F.collect_list(F.when(F.col("k") == "first", F.col("v")))), ", ").alias("first"))  # five values at most
    name_of, own = quoted(F.lit(target or f"{column}_canonico"), '"'), quoted(F.lit(column), '"')
    head = F.when(F.col("n") == 0, F.lit(f"-- {standard} has no codes")).otherwise(
        F.concat(F.lit(f"-- {column} to {standard} ({name}), "), F.col("n").cast("string"), F.lit(" codes\nCASE")))
    spellings = F.array_sort(F.array_distinct(F.array("value", F.upper("value"), F.lower("value"))))
    label = codes.groupBy("code").agg(F.min("label").alias("label"))
    whens = m.filter("code is not null").join(label, "code", "left").select(
        F.lit(1).alias("part"), "value",
        F.concat(F.lit("    WHEN "), own, F.lit(" IN ("), F.array_join(F.transform(spellings, lambda x: quoted(x)), ", "), F.lit(") THEN "),
                 quoted(F.col("code")), F.lit("  -- "), F.coalesce("label", F.lit(""))).alias("line"))
    warning = F.concat(F.lit("    -- WARNING: "), F.col("lost").cast("string"), F.lit(" values without a code: "), F.col("first"))
    end = F.concat(F.lit("    ELSE NULL  -- to be reviewed\nEND AS "), name_of)
    return reduce(DataFrame.unionByName, [line(one, 0, head), whens, line(one.filter("lost > 0 and n > 0"), 2, warning),
                                          line(one.filter("n > 0"), 3, end)])


def mapping_source(concepts: DataFrame, edge_mapping: DataFrame, codes: DataFrame) -> DataFrame:
    """The mapping each concept uses: an equivalence edge of its classifier, else code identity.

    ``concepts`` is (concept_id, classifier_id, standard); the lowest-numbered edge target wins.
    """
    out_edges = edge_mapping.select(F.col("src").alias("classifier_id"), F.struct(F.lit(0).alias("back"), F.col("dst").alias("other")).alias("e"), "code_src", "code_dst")
    in_edges = edge_mapping.select(F.col("dst").alias("classifier_id"), F.struct(F.lit(1).alias("back"), F.col("src").alias("other")).alias("e"), "code_src", "code_dst")
    both = out_edges.unionByName(in_edges)
    pick = both.groupBy("classifier_id").agg(F.min("e").alias("e"))
    chosen = both.join(pick, ["classifier_id", "e"]).drop("e")
    by_edge = concepts.join(chosen, "classifier_id").select("concept_id", "code_src", "code_dst", F.lit("edge").alias("source"))
    rest = concepts.join(pick, "classifier_id", "left_anti")
    same = (rest.join(codes, rest["standard"] == codes["standard_id"])
            .select("concept_id", F.col("code").alias("code_src"), F.col("code").alias("code_dst"), F.lit("standard").alias("source")))
    return by_edge.unionByName(same)


def validation_schema(concepts: DataFrame, codes: DataFrame) -> DataFrame:
    """JSON Schema text per concept; the code list of a standard is aggregated once per standard.

    Concepts may have version, why and what_for; without them the version is 1.0 and the others are empty."""
    def own(c: str, default: str) -> Column:
        return (F.coalesce(c, F.lit(default)) if c in concepts.columns else F.lit(default)).alias(c)

    enum = codes.groupBy(F.col("standard_id").alias("standard")).agg(
        F.sort_array(F.collect_list("code")).alias("enum"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "label")))).alias("enumDescriptions"))
    c = concepts.join(enum, "standard", "left")
    schema = F.struct(
        F.lit("https://json-schema.org/draft/2020-12/schema").alias("$schema"), F.col("name").alias("title"),
        F.col("definition").alias("description"), F.lit("string").alias("type"), "enum", "enumDescriptions",
        F.struct("standard", own("version", "1.0"), "population", "capture_method", own("why", ""), own("what_for", ""),
                 "data_classification").alias("x-catalog"))
    return c.select(F.col("id").alias("concept_id"), F.to_json(schema).alias("json_schema"))


def harmonize(sides: list[tuple[str, DataFrame, str, DataFrame]], target: str) -> DataFrame:
    """Union of several sources in one canonical column.

    Each side is (source name, rows, column, mapping with code_src and code_dst).
    """
    out = None
    for source, df, column, mapping in sides:
        one = apply_mapping(df, column, mapping, target).select(
            F.lit(source).alias("source"), F.col(column).cast("string").alias("original"), target)
        out = one if out is None else out.unionByName(one)
    return out
