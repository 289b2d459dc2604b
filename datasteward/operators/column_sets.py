"""Columns that share values, asked by a least score or by the k nearest: no list of column pairs is made.

Columns with equal values form one class, so a thousand flag columns are one set. The values of a set are put in one
order over all sets, those of the fewest sets first. Two sets whose score reaches the least score must meet in the head
of that order: if they did not, what is left of one of them could not hold enough common values. Only heads are joined,
a match is kept only if the rest of both sets may still hold enough, and the candidates are scored on whole sets. A value
that every column holds stands at the end and is met only by sets that have little else. Results are exact.

Null and blank cells are no values (``value_counts(cells, 'upper')`` leaves them out); a column without values has no
partner. Further columns of the value counts are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datasteward.operators.ranks import rank_values
from datasteward.operators.similarity import PAIR
from datasteward.sources.shared import is_materialized, materialize

KEYS = ["source", "column"]
MEASURES = ("cosine", "jaccard", "overlap", "containment")
HOLDERS_PER_SLOT = 4096  # sets that one task joins for one value
VALUES_PER_SLOT = 1 << 20  # values of one set that one task compares with its candidates
LESS = 1 - 1e-9  # bounds give way by more than the rounding of a sum of doubles


@dataclass(frozen=True)
class ColumnSets:
    """``classes`` (source, column, set_id): which set a column has; ``lists`` (set_id, value, cnt, holders, size, total,
    rest): the values that several sets hold, with the weight from this value to the end of the set's order."""

    measure: str
    classes: DataFrame
    lists: DataFrame


def column_classes(vf: DataFrame, counts: bool = False) -> DataFrame:
    """(source, column, size, total, set_id, is_first): columns with equal values (and equal counts, with ``counts``) share
    a set_id, told apart by their number of values and 128 bits of hash."""
    marked = [F.col("value"), F.col("cnt")] if counts else [F.col("value")]
    c = F.col("cnt").cast("double")
    marks = vf.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("size"), (F.sum(c * c) if counts else F.count(F.lit(1)).cast("double")).alias("total"),
        F.bit_xor(F.xxhash64(*marked)).alias("_h1"), F.bit_xor(F.xxhash64(F.lit(1), *marked)).alias("_h2"))
    marks = materialize(marks)
    same = ["size", "_h1", "_h2"]
    sets = marks.groupBy(*same).agg(F.min(F.struct(*KEYS)).alias("_first"))
    sets = materialize(sets.withColumn("set_id", F.monotonically_increasing_id()))
    return materialize(marks.join(sets, same).select(
        *KEYS, "size", "total", "set_id", (F.struct(*KEYS) == F.col("_first")).alias("is_first")))


def column_sets(vf: DataFrame, measure: str = "jaccard") -> ColumnSets:
    """Order the values of every column of (source, column, value, cnt), each value once per column."""
    if measure not in MEASURES:
        raise ValueError(f"measure must be one of {', '.join(MEASURES)}")
    vf = vf if is_materialized(vf) else materialize(vf.select(*KEYS, "value", "cnt"))
    classes = column_classes(vf, counts=measure == "cosine")
    first = classes.filter("is_first").select(*KEYS, "set_id", "size", "total")
    values = vf.select(*KEYS, "value", "cnt").join(first, KEYS).drop(*KEYS)
    holders = values.groupBy("value").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    c = F.col("cnt").cast("double")
    common = materialize(values.join(holders, "value").withColumns({
        "weight": c * c if measure == "cosine" else F.lit(1.0), "_order": F.struct("holders", "value")}))
    placed = rank_values(common, ["set_id"], "_order", "weight")
    weights = common.groupBy("set_id").agg(F.sum("weight").alias("_sum"))
    lists = placed.join(weights, "set_id").select(
        "set_id", "value", "cnt", "holders", "size", "total", F.greatest(F.col("_sum") - F.col("before"), "weight").alias("rest"))
    return ColumnSets(measure, classes, materialize(lists))


def _least_common(measure: str, t: float) -> Column:
    """The weight that two sets with a score of ``t`` have in common at least."""
    a, b = F.col("total_a"), F.col("total_b")
    return {"cosine": t * F.sqrt(a * b), "jaccard": t / (1 + t) * (a + b), "overlap": t * F.least(a, b),
            "containment": t * a}[measure]


def candidates(s: ColumnSets, at_least: float, live: DataFrame | None = None) -> DataFrame:
    """(a, b, size_a, size_b) of sets that may reach the score: a < b by set_id, by size for overlap (the smaller first),
    both orders for containment of a in b. With ``live`` (set_id) only pairs with one of these sets (as a, for containment)."""
    one_sided, m = s.measure in ("overlap", "containment"), s.measure
    lists = s.lists.withColumn("live", F.lit(True)) if live is None else (
        s.lists.join(live.select("set_id", F.lit(True).alias("live")), "set_id", "left").fillna({"live": False}))
    head = F.col("rest") >= F.col("total") * ((at_least ** 2 if m == "cosine" else at_least) * LESS)
    slots = F.ceil(F.col("holders") / HOLDERS_PER_SLOT)

    def side(df: DataFrame, x: str, slot: Column) -> DataFrame:
        return df.select("value", F.col("set_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in (
            "size", "total", "rest", "live")], slot.alias("slot"))

    left = lists.filter(head)
    left = left.filter("live") if m == "containment" else left
    a = side(left, "a", F.pmod(F.xxhash64("set_id"), slots))
    b = side(lists if one_sided else lists.filter(head), "b", F.explode(F.sequence(F.lit(0).cast("long"), slots - 1)))
    order = {"containment": F.col("a") != F.col("b"),
             "overlap": F.struct("size_a", "a") < F.struct("size_b", "b")}.get(m, F.col("a") < F.col("b"))
    # the first common value of a pair stands before all others, so the rests from there hold all of them
    left_over = F.sqrt(F.col("rest_a") * F.col("rest_b")) if m == "cosine" else F.least("rest_a", "rest_b")
    met = a.join(b, ["value", "slot"]).filter(order & (left_over >= _least_common(m, at_least) * LESS))
    met = met if m == "containment" else met.filter("live_a or live_b")
    return met.select("a", "b", "size_a", "size_b").distinct()


def scored_sets(s: ColumnSets, at_least: float, live: DataFrame | None = None) -> DataFrame:
    """(a, b, shared, score) of the pairs of sets with at least this score, in the order of ``candidates``."""
    pick = F.col("size_a") <= F.col("size_b")
    slots = F.ceil(F.least("size_a", "size_b") / VALUES_PER_SLOT)
    asked = candidates(s, at_least, live).select(
        "a", "b", F.when(pick, F.col("a")).otherwise(F.col("b")).alias("set_id"),
        F.when(pick, F.col("b")).otherwise(F.col("a")).alias("other"),
        F.explode(F.sequence(F.lit(0).cast("long"), slots - 1)).alias("slot"))
    own = s.lists.select("set_id", "value", F.col("cnt").cast("double").alias("c"),
                         F.pmod(F.xxhash64("value"), F.ceil(F.col("size") / VALUES_PER_SLOT)).alias("slot"))
    other = s.lists.select(F.col("set_id").alias("other"), "value", F.col("cnt").cast("double").alias("d"))
    both = (asked.join(own, ["set_id", "slot"]).select("a", "b", "other", "value", "c").join(other, ["other", "value"])
            .groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.sum(F.col("c") * F.col("d")).alias("dot")))
    for x in "ab":
        both = both.join(s.classes.filter("is_first").select(
            F.col("set_id").alias(x), F.col("size").alias(f"size_{x}"), F.col("total").alias(f"total_{x}")), x)
    n, na, nb = F.col("shared"), F.col("size_a"), F.col("size_b")
    score = {"cosine": F.col("dot") / (F.sqrt("total_a") * F.sqrt("total_b")), "jaccard": n / (na + nb - n),
             "overlap": n / F.least(na, nb), "containment": n / na}[s.measure]
    return both.select("a", "b", "shared", score.alias("score")).filter(F.col("score") >= at_least)


def similar_sets(vf: DataFrame, at_least: float, measure: str = "jaccard") -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b, shared, score) of different sets, members (source, column, set_id, size)); members of one set score 1."""
    if not 0 < at_least <= 1:
        raise ValueError("at_least must be above 0 and at most 1")
    s = column_sets(vf, measure)
    return scored_sets(s, at_least), s.classes.select(*KEYS, "set_id", "size")


def similar_columns(vf: DataFrame, at_least: float, measure: str = "jaccard") -> DataFrame:
    """(source_a, column_a, source_b, column_b, shared, score): the pairs of sets written out for all their columns.

    Containment lists both orders (a in b), the other measures each pair once, the smaller (source, column) first."""
    pairs, members = similar_sets(vf, at_least, measure)
    same = members.select("set_id", "size").distinct().select(
        F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.col("size").alias("shared"), F.lit(1.0).alias("score"))
    if measure != "containment":
        pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared", "score"))
    out = pairs.unionByName(same)
    for x in "ab":
        out = out.join(members.select(F.col("set_id").alias(x), F.col("source").alias(f"source_{x}"),
                                      F.col("column").alias(f"column_{x}")), x)
    a, b = F.struct(*PAIR[:2]), F.struct(*PAIR[2:])
    return out.filter(a != b if measure == "containment" else a < b).select(*PAIR, "shared", "score")


def nearest_columns(vf: DataFrame, k: int, measure: str = "cosine",
                    steps: Sequence[float] = (0.8, 0.4, 0.1)) -> DataFrame:
    """(source, column, rank, source_b, column_b, score): the k best partners of every column that share a value with it.

    Scores that agree to nine decimals go by name. Columns are asked with the first least score of ``steps``; those that
    do not find k partners above it are asked again with the next, at the end with any common value."""
    s = column_sets(vf, measure)
    by_name = Window.partitionBy("b").orderBy(*KEYS)
    names = materialize(s.classes.select(F.col("set_id").alias("b"), *KEYS).withColumn("_r", F.row_number().over(by_name))
                        .filter(F.col("_r") <= k + 1)  # more of one class cannot be among the k best
                        .select("b", F.col("source").alias("source_b"), F.col("column").alias("column_b")))
    live, found = s.classes.filter("is_first").select("set_id"), None
    best = Window.partitionBy("a").orderBy(F.desc(F.round("score", 9)), "source_b", "column_b")
    for t in (*steps, 0.0):
        p = scored_sets(s, t, live).select("a", "b", "score")
        if measure != "containment":
            p = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
        p = p.join(live.select(F.col("set_id").alias("a")), "a", "left_semi")
        p = p.unionByName(live.select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.lit(1.0).alias("score")))
        p = materialize(p.join(names, "b").withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1).drop("_r"))
        full = p.groupBy("a").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_least"))
        settled = full.filter((F.col("_n") > k) & (F.col("_least") > t + 1e-8) | F.lit(t == 0.0)).select("a")
        part = p.join(settled, "a", "left_semi")
        found = part if found is None else found.unionByName(part)
        live = materialize(live.join(settled, F.col("set_id") == F.col("a"), "left_anti"))
        if live.isEmpty():
            break
    mine = s.classes.select(*KEYS, F.col("set_id").alias("a")).join(found, "a").filter(
        F.struct(*KEYS) != F.struct("source_b", "column_b"))
    order = Window.partitionBy(*KEYS).orderBy(F.desc(F.round("score", 9)), "source_b", "column_b")
    return (mine.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select(*KEYS, "rank", "source_b", "column_b", "score"))
