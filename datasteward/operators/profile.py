"""Column profiles, quality scores and issues, all derived from one pass of counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datasteward.functions import text as tx
from datasteward.operators import ranks
from datasteward.operators.cells import cells, value_counts
from datasteward.sources.shared import is_materialized, materialize

KEYS = ["source", "column"]
EMPTY_COLUMN = "columna vacia"  # fixed value: the issue of a column without rows


def counted(rows: DataFrame) -> DataFrame:
    """Value counts of cells; value counts pass through, so that callers can share them."""
    return rows if "cnt" in rows.columns else value_counts(rows)


def settled(rows: DataFrame) -> DataFrame:
    """Value counts as a written table, for operators that read them several times."""
    vf = counted(rows)
    return vf if is_materialized(vf) else materialize(vf)


def column_facts(cell_rows: DataFrame) -> DataFrame:
    """One row per column with every counter the profiles need.

    Patterns run once per distinct value. The counters are one aggregate with a row per
    column and task before its shuffle; only the distinct keys are shuffled by value. All
    figures are numbers, so both are hash aggregates; extremes of text come from
    ``value_range``, which sorts.
    """
    v, s = F.col("value"), F.col("s")
    vf = settled(cell_rows).withColumn("s", tx.strip(v))
    flags = tx.value_type_flags(v, s)
    ok, ok_ext = ~tx.is_missing(v, s=s), ~tx.is_missing(v, extended=True, s=s)
    is_date = flags["is_iso_date"] | flags["is_latino_date"]
    kind = (F.when(~ok_ext, F.lit(None)).when(flags["is_int"], "int").when(flags["is_float"], "float")
            .when(is_date, "date").when(flags["is_boolean"], "bool"))
    d = vf.select(
        *KEYS, "cnt", ok.alias("ok"), ok_ext.alias("ok_ext"), kind.alias("kind"), tx.parse_number(v, s).alias("x"),
        v.rlike(r"^-?\d+$").alias("s_int"), v.rlike(r"^-?\d+\.\d+$").alias("s_float"),
        v.rlike(r"^\d{4}-\d{2}-\d{2}").alias("s_date"),
        (v.rlike(r"[^\x00-\x7F]") & ~v.rlike(r"(?U)^[\w\s\-.,()]")).alias("weird"),
        is_date.alias("dated"), F.length(v).alias("len"))

    def n(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("cnt")).otherwise(0))

    def every(c: str) -> Column:
        return F.coalesce(F.min(F.when(F.col("ok"), F.col(c))), F.lit(True)).alias(f"all_{c[2:]}")

    is_ok, x = F.col("ok"), F.col("x")
    sums = d.groupBy(*KEYS).agg(
        F.sum("cnt").alias("total"), n(is_ok).alias("n"), n(F.col("ok_ext")).alias("n_ext"),
        F.sum(is_ok.cast("long")).alias("d_raw"), n(is_ok & x.isNotNull()).alias("n_num"),
        F.min(F.when(is_ok, x)).alias("min_x"), F.max(F.when(is_ok, x)).alias("max_x"),
        *[n(F.col("kind") == k).alias(f"k_{k}") for k in ("int", "float", "date", "bool")],
        n(is_ok & F.col("weird")).alias("n_weird"), n(is_ok & F.col("dated")).alias("n_dated"),
        F.sum(F.when(is_ok, F.col("len") * F.col("cnt")).otherwise(0)).alias("sum_len"),
        every("s_int"), every("s_float"), every("s_date"))
    # the lower-case spellings under one upper-case key differ only for a few special letters
    low = F.xxhash64(F.lower(s))
    keys = (vf.select(*KEYS, F.upper(s).alias("ukey"), ok.alias("ok"), ok_ext.alias("ok_ext"), low.alias("l"))
            .groupBy(*KEYS, "ukey").agg(
                F.max(is_ok.cast("int")).alias("has"), F.max(F.col("ok_ext").cast("int")).alias("has_ext"),
                F.min(F.when(is_ok, F.col("l"))).alias("l0"), F.max(F.when(is_ok, F.col("l"))).alias("l1")))
    spellings = F.when(F.col("has") == 1, F.when(F.col("l0") == F.col("l1"), 1).otherwise(2)).otherwise(0)
    distinct = keys.groupBy(*KEYS).agg(F.sum("has").alias("d_upper"), F.sum("has_ext").alias("d_lower_ext"),
                                       F.sum(spellings).alias("d_lower"))
    return (sums.join(F.broadcast(distinct), KEYS)
            .withColumn("is_numeric", (F.col("n") > 0) & (F.col("n_num") > F.col("n") * 0.8)))


def strict_type() -> Column:
    """All values must agree; a column without values counts as integer."""
    return (F.when(F.col("all_int"), "integer").when(F.col("all_float"), "float")
            .when(F.col("all_date"), "date").otherwise("text"))


def majority_type() -> Column:
    n = F.col("n_ext")
    return (F.when(n == 0, "unknown")
            .when(F.col("k_int") / n > 0.8, "integer")
            .when((F.col("k_int") + F.col("k_float")) / n > 0.8, "float")
            .when(F.col("k_date") / n > 0.7, "date")
            .when(F.col("k_bool") / n > 0.8, "boolean").otherwise("text"))


def sample_values(cell_rows: DataFrame, n: int = 20) -> DataFrame:
    """First n distinct non-missing values in sort order (WindowGroupLimit before the shuffle)."""
    vf = counted(cell_rows).filter(~tx.is_missing(F.col("value")))
    w = Window.partitionBy(*KEYS).orderBy("value")
    top = vf.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return top.groupBy(*KEYS).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", "value"))), lambda s: s["value"])
        .alias("sample_values"))


def value_range(cell_rows: DataFrame) -> DataFrame:
    """Smallest and largest non-missing value of each column in text order."""
    vf = counted(cell_rows).filter(~tx.is_missing(F.col("value")))
    ends = []
    for name, order in (("min_value", F.col("value")), ("max_value", F.desc("value"))):
        w = Window.partitionBy(*KEYS).orderBy(order)
        ends.append(vf.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
                    .select(*KEYS, F.col("value").alias(name)))
    return ends[0].join(ends[1], KEYS)


def profile_cells(cell_rows: DataFrame, samples: int = 20) -> DataFrame:
    cell_rows = settled(cell_rows)
    f = column_facts(cell_rows)
    base = f.select(
        *KEYS, strict_type().alias("data_type"), (F.col("n") < F.col("total")).alias("nullable"),
        F.col("total").alias("total_count"), (F.col("total") - F.col("n")).alias("null_count"),
        F.col("d_raw").alias("unique_count"))
    return (base.join(F.broadcast(value_range(cell_rows)), KEYS, "left")
            .join(F.broadcast(sample_values(cell_rows, samples)), KEYS, "left"))


def profile_columns(df: DataFrame, source: str) -> DataFrame:
    return profile_cells(cells(df, source))


def quality_columns() -> list[Column]:
    """Completeness, consistency, validity, score, grade and issues from the facts."""
    total, n, card = F.col("total"), F.col("n"), F.col("d_upper")
    completeness = n / total
    numeric = F.col("is_numeric")
    validity = F.when(numeric, F.col("n_num") / F.greatest(n, F.lit(1))).otherwise(
        1 - F.col("n_weird") / F.greatest(n, F.lit(1)))
    low_card = ~numeric & (card < 20)
    consistency = F.when(low_card, F.col("d_lower") / F.greatest(card, F.lit(1))).otherwise(
        (card > 0).cast("double"))
    score = F.floor(F.round(completeness * 40 + consistency * 30 + validity * 30, 9))
    issues = F.array_compact(F.array(
        F.when(completeness < 0.5, "alta nulidad").when(completeness < 0.9, "nulidad moderada"),
        F.when(low_card & (consistency < 0.8), "posibles duplicados")))
    return [completeness.alias("completeness"), consistency.alias("consistency"),
            validity.alias("validity"), score.alias("score"), tx.grade(score).alias("grade"),
            issues.alias("issues")]


def _with_empty(found: DataFrame, columns: DataFrame | None, **values) -> DataFrame:
    """``found`` with a row of ``values`` for each of ``columns`` (source, column) that has no cell at all."""
    if columns is None:
        return found
    rest = columns.select(*KEYS).join(found.select(*KEYS), KEYS, "left_anti")
    types = dict(found.dtypes)
    return found.unionByName(rest.select(*KEYS, *[F.lit(v).cast(types[c]).alias(c) for c, v in values.items()]))


def column_quality(cell_rows: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Quality of each column. ``columns`` (source, column) lists the columns that must have a row: those of a table
    without rows score 0."""
    found = column_facts(cell_rows).select(*KEYS, *quality_columns())
    return _with_empty(found, columns, completeness=0.0, consistency=0.0, validity=0.0, score=0, grade="F",
                       issues=[EMPTY_COLUMN])


def spelling_variants(cell_rows: DataFrame) -> DataFrame:
    """Opt-in consistency: distinct lower-case keys over distinct raw spellings."""
    f = column_facts(cell_rows)
    return f.select(*KEYS, F.col("d_raw").alias("spellings"), F.col("d_lower").alias("keys"),
                    (F.col("d_lower") / F.greatest(F.col("d_raw"), F.lit(1))).alias("consistency"))


def numeric_values(cell_rows: DataFrame, drop_missing: bool = True) -> DataFrame:
    """(source, column, x, cnt) of the parsed numbers, one row per distinct text."""
    vf = counted(cell_rows)
    if drop_missing:
        vf = vf.filter(~tx.is_missing(F.col("value")))
    return vf.select(*KEYS, tx.parse_number(F.col("value")).alias("x"), "cnt").filter(F.col("x").isNotNull())


def _mean() -> Column:
    """The mean of x, weighted by cnt: from an exact decimal sum where every x has at most eight decimals, so that the
    order in which tasks add up cannot decide the last digit; from a floating-point sum elsewhere."""
    x, cnt = F.col("x"), F.col("cnt")
    fixed, times = x.try_cast("decimal(24,8)"), cnt.try_cast("decimal(12,0)")
    exact = F.every(F.coalesce((fixed.cast("double") == x) & times.isNotNull(), F.lit(False)))
    total = F.try_sum(fixed * times).cast("double")
    return F.coalesce(F.when(exact, total), F.sum(x * cnt)) / F.sum(cnt)


def spread(numbers: DataFrame) -> DataFrame:
    """Count, mean and sample deviation in two passes (no cancellation of large sums)."""
    m = numbers.groupBy(*KEYS).agg(F.sum("cnt").alias("n_num"), _mean().alias("mean"))
    dev = (F.col("x") - F.col("mean"))
    s = (numbers.join(F.broadcast(m), KEYS).groupBy(*KEYS, "n_num", "mean")
         .agg(F.sum(dev * dev * F.col("cnt")).alias("_ss")))
    return s.select(*KEYS, "n_num", "mean", F.when(
        F.col("n_num") > 1, F.sqrt(F.col("_ss") / (F.col("n_num") - 1))).alias("std"))


def top_values(cell_rows: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent non-missing raw values; ties in value order."""
    vf = counted(cell_rows).filter(~tx.is_missing(F.col("value")))
    w = Window.partitionBy(*KEYS).orderBy(F.desc("cnt"), "value")
    return vf.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def distribution_summary(cell_rows: DataFrame) -> DataFrame:
    """Counts for every column, moments and quartiles for the numeric ones."""
    cell_rows = settled(cell_rows)
    f = column_facts(cell_rows)
    base = f.select(*KEYS, F.col("total").alias("count"), F.col("d_upper").alias("unique"),
                    (F.col("total") - F.col("n")).alias("missing"),
                    F.when(F.col("is_numeric"), "numeric").otherwise("categorical").alias("type"),
                    (F.col("is_numeric") & (F.col("n_num") >= 2)).alias("_num"), "min_x", "max_x")
    numbers = materialize(numeric_values(cell_rows))
    q = ranks.quantiles(numbers, KEYS, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    out = (base.join(F.broadcast(spread(numbers)), KEYS, "left").join(F.broadcast(q), KEYS, "left"))
    stat = {"mean": "mean", "median": "median", "std": "std", "min": "min_x", "max": "max_x",
            "q1": "q1", "q3": "q3"}
    return out.select(*KEYS, "count", "unique", "missing", "type",
                      *[F.when(F.col("_num"), F.col(c)).alias(name) for name, c in stat.items()])


def dataset_profile(cell_rows: DataFrame) -> DataFrame:
    """Distribution and quality of each column."""
    cell_rows = settled(cell_rows)
    quality = column_quality(cell_rows).select(*KEYS, "score", "grade")
    return distribution_summary(cell_rows).join(F.broadcast(quality), KEYS)


def dataset_rollup(profile: DataFrame) -> DataFrame:
    return profile.groupBy("source").agg(
        F.count(F.lit(1)).alias("columns"), F.avg("score").alias("avg_score"),
        *[F.sum((F.col("grade") == g).cast("long")).alias(f"grade_{g.lower()}") for g in "ABCDF"])


def rare_values(cell_rows: DataFrame, share: float = 0.01, k: int = 20) -> DataFrame:
    """Values below ``share`` of a column with more than 10 values, rarest first, top k."""
    vf = (counted(cell_rows).filter(~tx.is_missing(F.col("value")))
          .withColumn("value", tx.strip(F.col("value")))
          .groupBy(*KEYS, "value").agg(F.sum("cnt").alias("cnt")))
    total = vf.groupBy(*KEYS).agg(F.sum("cnt").alias("n"))
    rare = (vf.join(F.broadcast(total), KEYS)
            .filter((F.col("n") > 10) & (F.col("cnt") / F.col("n") < share)))
    w = Window.partitionBy(*KEYS).orderBy("cnt", "value")
    return rare.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def high_cardinality(cell_rows: DataFrame, approximate: bool = False) -> DataFrame:
    """Flag columns whose distinct values exceed 90 % of more than 20 values."""
    v = F.col("value")
    if approximate:
        kept = cell_rows.filter(~tx.is_missing(v)).select(*KEYS, tx.strip(v).alias("value"))
        agg = kept.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"),
                                      F.approx_count_distinct("value").alias("cardinality"))
    else:
        kept = counted(cell_rows).filter(~tx.is_missing(v)).select(*KEYS, tx.strip(v).alias("value"), "cnt")
        agg = (kept.groupBy(*KEYS, "value").agg(F.sum("cnt").alias("c"))
               .groupBy(*KEYS).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("cardinality")))
    return agg.withColumn("high_cardinality",
                          (F.col("cardinality") > F.col("n") * 0.9) & (F.col("n") > 20))


def suspicious_values(cell_rows: DataFrame) -> DataFrame:
    """Distinct values with non-ASCII text, outer white space or repeated spaces."""
    v = F.col("value")
    vf = counted(cell_rows).filter(~tx.is_missing(v))
    reasons = F.array_compact(F.array(
        F.when(v.rlike(r"[^\x00-\x7F]"), "mojibake"),
        F.when(tx.strip(v) != v, "whitespace"),
        F.when(tx.strip(v).rlike(r"(?U)\s{2,}"), "espacios multiples")))
    return vf.withColumn("issues", reasons).filter(F.size("issues") > 0)


def column_features(cell_rows: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Five shape features per column and the column type they imply; all 0 and ``empty`` for those of ``columns``
    (source, column) that have no row."""
    f, total = column_facts(cell_rows), F.col("total")
    numeric, dates = F.col("n_num") / total, F.col("n_dated") / total
    length = F.when(F.col("n") > 0, F.least(F.col("sum_len") / F.col("n") / 50.0, F.lit(1.0))).otherwise(0.0)
    found = f.select(
        *KEYS, numeric.alias("numeric_ratio"), (F.col("d_upper") / total).alias("cardinality_ratio"),
        ((total - F.col("n")) / total).alias("missing_ratio"), dates.alias("date_ratio"),
        length.alias("avg_length"), F.col("d_upper").alias("unique"),
        F.when(numeric > 0.7, "numeric").when(dates > 0.5, "date").otherwise("categorical").alias("type"))
    return _with_empty(found, columns, numeric_ratio=0.0, cardinality_ratio=0.0, missing_ratio=0.0, date_ratio=0.0,
                       avg_length=0.0, unique=0, type="empty")


def field_quality(cell_rows: DataFrame, mapping: DataFrame, standard_values: DataFrame) -> DataFrame:
    """Weighted quality of each field; ``mapping`` is (source, column, standard_id).

    Uses every value of the column. A column without standard, or whose standard has no
    codes, gets consistency 1.
    """
    v = F.col("value")
    cell_rows = settled(cell_rows)
    f = column_facts(cell_rows)
    codes = (standard_values.select("standard_id", F.upper(tx.strip(F.col("code"))).alias("key"))
             .distinct().withColumn("_hit", F.lit(1)))
    filled = codes.select("standard_id").distinct().withColumn("_has_codes", F.lit(1))
    vf = counted(cell_rows).filter(~tx.is_missing(v, extended=True))
    hits = (vf.join(F.broadcast(mapping), KEYS)
            .withColumn("key", tx.value_key(v))
            .join(codes, ["standard_id", "key"], "left")
            .groupBy(*KEYS).agg(F.sum(F.when(F.col("_hit") == 1, F.col("cnt")).otherwise(0)).alias("_in")))
    t = (f.join(F.broadcast(mapping.join(filled, "standard_id", "left")), KEYS, "left")
         .join(F.broadcast(hits), KEYS, "left"))
    n = F.col("n_ext")
    dtype = majority_type()
    completeness = n / F.col("total")
    uniqueness = F.col("d_lower_ext") / F.col("total")
    consistency = F.when(F.col("_has_codes").isNull() | (n == 0), 1.0).otherwise(
        F.coalesce(F.col("_in"), F.lit(0)) / n)
    good = (F.when(dtype == "date", F.col("k_date")).when(dtype == "integer", F.col("k_int"))
            .when(dtype == "float", F.col("k_int") + F.col("k_float")))
    validity = F.when(good.isNull() | (n == 0), 1.0).otherwise(good / n)
    return t.select(
        *KEYS, dtype.alias("data_type"), completeness.alias("completeness"),
        uniqueness.alias("uniqueness"), consistency.alias("consistency"), validity.alias("validity"),
        (completeness * 0.4 + consistency * 0.3 + validity * 0.2 + uniqueness * 0.1).alias("quality_score"))


def detect_issues(cell_rows: DataFrame) -> DataFrame:
    """One row per column and structural issue, typed, with severity and metric."""
    f, total = column_facts(cell_rows), F.col("total")
    nulls = (total - F.col("n_ext")) / F.greatest(total, F.lit(1))
    uniq = F.col("d_lower_ext")

    def issue(cond: Column, kind: str, severity, metric) -> Column:
        sev = severity if isinstance(severity, Column) else F.lit(severity)
        met = metric if isinstance(metric, Column) else F.lit(metric)
        return F.when(cond, F.struct(F.lit(kind).alias("issue_type"), sev.alias("severity"),
                                     met.cast("double").alias("metric_value")))

    found = F.array_compact(F.array(
        issue(nulls > 0.5, "alta_nulidad", F.when(nulls > 0.7, "error").otherwise("warning"), nulls),
        issue((uniq == 1) & (total > 5), "columna_constante", "warning", 1.0),
        issue((uniq == total) & (total > 0), "clave_primaria", "info", 1.0),
        issue(majority_type() == "unknown", "tipo_no_detectado", "warning", 0.0),
        issue(F.trim("column") == "", "sin_nombre", "error", 0.0),
        issue(F.col("column").rlike(r"[^\x00-\x7F]"), "encoding_roto", "warning", 0.0)))
    return f.select(*KEYS, F.explode(found).alias("i")).select(*KEYS, "i.*")
