"""Statistical tests and correlations. Moments are aggregated by Spark; p-values are
computed on the few result rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasteward.functions.pvalues import chi2_p_value, t_p_value
from datasteward.operators import ranks
from datasteward.sources.shared import materialize

# Wording of the correlation verdicts.
TOO_FEW, NO_VARIANCE = "insuficientes datos", "sin varianza"
STRONG, MODERATE, WEAK = "correlacion fuerte", "correlacion moderada", "correlacion debil"


def welch_columns(na: Column, ma: Column, va: Column, nb: Column, mb: Column, vb: Column) -> dict[str, Column]:
    """t statistic and truncated degrees of freedom from two sets of moments."""
    ea, eb = va / na, vb / nb
    enough = (na >= 2) & (nb >= 2)
    se = F.sqrt(ea + eb)
    usable = enough & (se > 0)
    den = ea * ea / (na - 1) + eb * eb / (nb - 1)
    df = F.when(den > 0, (ea + eb) * (ea + eb) / den).otherwise(na + nb - 2)
    return {"t_stat": F.when(usable, (ma - mb) / se).otherwise(F.lit(0.0)),
            "t_df": F.when(usable, F.floor(df)).otherwise(F.lit(0))}


def with_t_test(df: DataFrame) -> DataFrame:
    return (df.withColumn("p_value", t_p_value(F.col("t_stat").cast("double"), F.col("t_df").cast("double")))
            .withColumn("significant", F.col("p_value") < 0.05))


def with_chi_test(df: DataFrame) -> DataFrame:
    return (df.withColumn("p_value", chi2_p_value(F.col("chi2").cast("double"), F.col("chi_df").cast("double")))
            .withColumn("significant", F.col("p_value") < 0.05))


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    v = F.col(value).cast("double")
    return (df.filter(v.isNotNull()).groupBy(F.col(group).alias("grp"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var")))


def welch_t(df: DataFrame, value: str, group: str, pairs: list[tuple]) -> DataFrame:
    """Welch test of ``value`` for each listed pair of group labels, in one aggregation."""
    m = group_moments(df, value, group)
    p = df.sparkSession.createDataFrame(pairs, "group_a string, group_b string")
    a = m.select(F.col("grp").alias("group_a"), F.col("n").alias("n_a"), F.col("mean").alias("mean_a"),
                 F.coalesce("var", F.lit(0.0)).alias("var_a"))
    b = m.select(F.col("grp").alias("group_b"), F.col("n").alias("n_b"), F.col("mean").alias("mean_b"),
                 F.coalesce("var", F.lit(0.0)).alias("var_b"))
    j = p.join(F.broadcast(a), "group_a").join(F.broadcast(b), "group_b")
    cols = welch_columns(*(F.col(c) for c in ("n_a", "mean_a", "var_a", "n_b", "mean_b", "var_b")))
    return with_t_test(j.withColumns(cols).withColumns(
        {"std_a": F.sqrt("var_a"), "std_b": F.sqrt("var_b")}).drop("var_a", "var_b"))


def _verdict(n: Column, r: Column) -> Column:
    a = F.abs(r)
    return (F.when(n < 3, TOO_FEW).when(r.isNull(), NO_VARIANCE).when(a >= 0.7, STRONG)
            .when(a >= 0.4, MODERATE).otherwise(WEAK))


BLOCK = 256  # columns in a block of the matrix of sums
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _task_sums(columns: int, shift: list[float]):
    """The sums of every pair of columns over the rows of a task, by pairs of column blocks. Rows are (at, x): the places of
    columns and their values, null where missing. A task holds four matrices of columns^2 numbers."""
    def run(batches):
        n, s, q, p = (np.zeros((columns, columns)) for _ in range(4))
        mean = np.array(shift)
        for batch in batches:
            at, x = batch.column(0), batch.column(1)
            row = np.repeat(np.arange(len(batch)), np.diff(at.offsets.to_numpy()))
            at, x = at.flatten().to_numpy(), x.flatten().to_numpy(zero_copy_only=False)
            there = ~np.isnan(x)
            mask, value = np.zeros((len(batch), columns)), np.zeros((len(batch), columns))
            mask[row[there], at[there]] = 1
            value[row[there], at[there]] = x[there] - mean[at[there]]
            n += mask.T @ mask
            s += value.T @ mask
            q += (value * value).T @ mask
            p += value.T @ value
        for i in range(0, columns, BLOCK):
            for j in range(i, columns, BLOCK):
                a, b = slice(i, i + BLOCK), slice(j, j + BLOCK)
                cut = np.stack([n[a, b], s[a, b], s.T[a, b], q[a, b], q.T[a, b], p[a, b]])
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([j]), pa.array([cut.tobytes()], pa.binary())], names=["i", "j", "sums"])
    return run


def _pair_sums(columns: int):
    """(a, b, and ``SUMS``) of every pair a < b, from the blocks of all tasks, which are added up one after the other."""
    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cut = np.frombuffer(sums).reshape(len(SUMS), min(BLOCK, columns - i), min(BLOCK, columns - j))
                held[i, j] = held[i, j] + cut if (i, j) in held else cut
        for (i, j), cut in held.items():
            a, b = (k.ravel() + d for k, d in zip(np.indices(cut.shape[1:]), (i, j)))
            own = a < b
            yield pa.RecordBatch.from_arrays([pa.array(a[own].astype(np.int32)), pa.array(b[own].astype(np.int32)),
                                              *[pa.array(m.ravel()[own]) for m in cut]], names=["a", "b", *SUMS])
    return run


def _gram(rows: DataFrame, columns: int, shift: list[float]) -> DataFrame:
    """(a, b, n, r) of all pairs of places in rows (at, x): r is null if a side has no variance. The rows are read once; a
    task sends one block of sums for each pair of column blocks."""
    sums = ", ".join(f"{c} double" for c in SUMS)
    cut = rows.mapInArrow(_task_sums(columns, shift), "i long, j long, sums binary").repartition("i", "j")
    t = cut.mapInArrow(_pair_sums(columns), f"a int, b int, {sums}")
    vx, vy = (F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / F.col("n") for c in "xy")
    # what rounding leaves of a constant column is no variance
    varies = (F.col("n") > 0) & (vx > F.col("sxx") * 1e-12) & (vy > F.col("syy") * 1e-12)
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.sqrt(vx) * F.sqrt(vy))
    return t.select("a", "b", F.col("n").cast("long").alias("n"), varies.alias("varies"),
                    F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


def numeric_columns(df: DataFrame) -> list[str]:
    """The numeric columns, in the order of the schema."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """(column_a, column_b, n, r, verdict) for every pair of ``columns`` (all numeric ones), in their order.

    Missing and non-finite values are left out pair by pair. ``method`` pearson, or spearman for ranks with averaged ties.
    Ranks of all columns come from one pass over their distinct values; only for pairs in which a value of one column has
    no partner, so that ranks within the pair differ, the pair's own values are ranked."""
    columns = columns or numeric_columns(df)
    number = [F.col(f"`{c}`").cast("double") for c in columns]
    finite = [F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x) for x in number]
    if method == "spearman":
        t = _rank_matrix(df.select(F.array(*finite).alias("x")), len(columns))
    else:
        mean = df.agg(*[F.avg(x).alias(f"m{k}") for k, x in enumerate(finite)]).first()  # one row: keeps the sums exact
        rows = df.select(F.array(*[F.lit(k) for k in range(len(columns))]).alias("at"), F.array(*finite).alias("x"))
        t = _gram(rows, len(columns), [m or 0.0 for m in mean])
    names = F.array(*map(F.lit, columns))
    r = F.when((F.col("n") >= 3) & F.col("varies"), F.col("r"))
    return t.select(F.get(names, F.col("a")).alias("column_a"), F.get(names, F.col("b")).alias("column_b"), "n",
                    F.coalesce(r, F.lit(0.0)).alias("r"), _verdict(F.col("n"), r).alias("verdict"))


def _rank_matrix(df: DataFrame, columns: int) -> DataFrame:
    """(a, b, n, r, varies) of the ranks of the array column x."""
    rows = materialize(df.withColumn("row", F.monotonically_increasing_id()))
    cells = rows.select("row", F.posexplode("x").alias("at", "v")).filter("v is not null")
    values = cells.groupBy("at", "v").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = ranks.rank_values(values, ["at"], x="v").select("at", "v", "avg_rank")
    sizes = {r["at"]: r["n"] for r in cells.groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per column
    lists = cells.join(ranked, ["at", "v"]).groupBy("row").agg(F.collect_list(F.struct("at", "avg_rank")).alias("c"))
    t = materialize(_gram(lists.select("c.at", F.col("c.avg_rank").alias("x")), columns, [(sizes.get(k, 0) + 1) / 2 for k in range(columns)]))
    n = F.array(*[F.lit(sizes.get(k, 0)).cast("long") for k in range(columns)])
    apart = (F.col("n") > 0) & ((F.col("n") < F.get(n, F.col("a"))) | (F.col("n") < F.get(n, F.col("b"))))
    others = [(r["a"], r["b"]) for r in t.filter(apart).select("a", "b").collect()]  # at most a row for each pair of columns
    if not others:
        return t
    asked = df.sparkSession.createDataFrame(others, "a int, b int")
    left, right = cells.toDF("row", "a", "x"), cells.toDF("row", "b", "y")
    pairs = materialize(left.join(asked, "a").join(right, ["row", "b"]).groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("w")))

    def own_ranks(c: str) -> DataFrame:
        v = pairs.groupBy("a", "b", c).agg(F.sum("w").alias("cnt"))
        return ranks.rank_values(v, ["a", "b"], x=c).select("a", "b", c, F.col("avg_rank").alias(f"r{c}"))
    both = pairs.join(own_ranks("x"), ["a", "b", "x"]).join(own_ranks("y"), ["a", "b", "y"])
    w, total = F.col("w"), pairs.groupBy("a", "b").agg(F.sum("w").alias("n"))
    both = both.join(total, ["a", "b"]).withColumn("mid", (F.col("n") + 1) / 2)
    dx, dy = F.col("rx") - F.col("mid"), F.col("ry") - F.col("mid")
    s = both.groupBy("a", "b").agg(F.max("n").alias("n"), F.sum(w * dx * dy).alias("sxy"), F.sum(w * dx * dx).alias("sxx"), F.sum(w * dy * dy).alias("syy"))
    varies = (F.col("sxx") > 0) & (F.col("syy") > 0)
    r = F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sxy") / (F.sqrt("sxx") * F.sqrt("syy")))))
    exact = s.select("a", "b", F.col("n").cast("long").alias("n"), r.alias("r"), varies.alias("varies"))
    return t.filter(~apart).unionByName(exact)


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return correlation_matrix(df, [x, y])


def spearman(df: DataFrame, x: str, y: str, parts: int | None = None) -> DataFrame:
    """Rank correlation with averaged ties.

    Ranks are computed once per distinct value and joined to the distinct (x, y) pairs,
    so a value that fills a third of the rows is one row of the rank table.
    """
    p = materialize(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
                    .filter("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")))

    def ranked(c: str) -> DataFrame:
        v = p.groupBy(c).agg(F.sum("w").alias("cnt")).select(F.lit(c).alias("k"), F.col(c).alias("v"), "cnt")
        return ranks.rank_values(v, ["k"], x="v", parts=parts).select(F.col("v").alias(c), F.col("avg_rank").alias(f"r{c}"))

    n = p.agg(F.sum("w")).first()[0] or 0
    t = p.join(ranked("x"), "x").join(ranked("y"), "y")
    m = (n + 1) / 2
    dx, dy, w = F.col("rx") - m, F.col("ry") - m, F.col("w")
    s = t.agg(F.lit(n).cast("long").alias("n"), F.sum(w * dx * dy).alias("sxy"), F.sum(w * dx * dx).alias("sxx"),
              F.sum(w * dy * dy).alias("syy"))
    r = F.when((F.col("n") >= 3) & (F.col("sxx") > 0) & (F.col("syy") > 0),
               F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sxy") / (F.sqrt("sxx") * F.sqrt("syy")))))
    return s.select(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), "n", F.coalesce(r, F.lit(0.0)).alias("r"),
                    _verdict(F.col("n"), r).alias("verdict"))
