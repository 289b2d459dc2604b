"""Profiles merged from stored states against the exact profile of the same rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from datasteward.operators import profile
from datasteward.operators import profile_states as ps
from datasteward.operators.cells import cells

ROWS = "day string, amount double, name string, code string, nothing string"


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    rows = [(f"2024-01-{1 + k % 7:02d}", rng.choice([1e6, 0.25, -3.5, rng.gauss(50, 9)]), f"n{rng.randint(0, 6000)}",
             rng.choice(["A", "A", "A", "b", " B ", "NA", "", None, "5"]), None) for k in range(9000)]
    return spark.createDataFrame(rows + [(None, 2.0, "n1", "A", None)], ROWS)


@pytest.fixture(scope="module")
def path(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("states") / "s")
    for half in (F.col("day") < "2024-01-04", (F.col("day") >= "2024-01-04") | F.col("day").isNull()):
        ps.add_states(data.filter(half), "t", F.col("day"), path)
    return path


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_merged_equals_whole(spark, data, path):
    got, want = by_column(ps.merged_profile(ps.read_states(spark, path))), by_column(profile.distribution_summary(cells(data, "t")))
    assert set(got) == set(want)
    amounts = sorted(r[0] for r in data.select("amount").collect())
    for c, w in want.items():
        g = got[c]
        for exact in ("count", "missing", "type"):
            assert g[exact] == w[exact]
        for exact in ("mean", "std", "min", "max"):
            assert g[exact] == (pytest.approx(w[exact], rel=1e-9) if w[exact] is not None else None)
        assert abs(g["unique"] - w["unique"]) <= 0.03 * w["unique"]
        for p, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            if w[p] is None:
                assert g[p] is None
            else:  # the rank of the estimate lies within one per cent
                low, high = sum(a < g[p] for a in amounts), sum(a <= g[p] for a in amounts)
                assert low / len(amounts) - 0.01 <= q <= high / len(amounts) + 0.01
    assert got["nothing"]["unique"] == 0 and got["amount"]["mean"] is not None


def test_top_values(spark, data, path):
    got = {(r["column"], r["rank"]): (r["value"], r["cnt"]) for r in ps.merged_top_values(ps.read_states(spark, path)).collect()}
    for r in profile.top_values(cells(data, "t")).collect():
        if r["column"] in ("code", "day"):  # few enough values to be followed exactly
            assert got[r["column"], r["rank"]] == (r["value"], r["cnt"])
    assert got["amount", 1][1] > 2000 and not any(c == "nothing" for c, _ in got)


def test_a_part_added_again_replaces_itself_only(spark, data, path):
    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs
                if f.endswith(".parquet") and "part=" in d}
    before, old = files(), by_column(ps.merged_profile(ps.read_states(spark, path)))
    ps.add_states(data.filter("day = '2024-01-02'"), "t", F.col("day"), path)
    same = {f for f in before if "2024-01-02" not in f}
    assert {f: files()[f] for f in same} == {f: before[f] for f in same}
    new = by_column(ps.merged_profile(ps.read_states(spark, path)))
    assert {c: (r["count"], r["missing"], r["mean"], r["unique"]) for c, r in new.items()} == {
        c: (r["count"], r["missing"], r["mean"], r["unique"]) for c, r in old.items()}
    days = by_column(ps.merged_profile(ps.read_states(spark, path).filter("part <= '2024-01-02'")))
    assert days["name"]["count"] == data.filter("day <= '2024-01-02'").count()  # a range of days, without the data
    assert by_column(ps.merged_profile(ps.read_states(spark, path).filter("part IS NULL")))["name"]["count"] == 1


def test_new_day_reads_that_day(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    day = events.filter("ts >= '2024-01-05' AND ts < '2024-01-06'")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan
    ps.add_states(day, "events", F.to_date("ts"), str(tmp_path / "s"))
    assert [r[0] for r in ps.read_states(spark, str(tmp_path / "s")).select("part").distinct().collect()] == ["2024-01-05"]


def test_odd_tables(spark, tmp_path):
    path = str(tmp_path / "s")
    odd = spark.createDataFrame([("x" * 100_000, "p", 1), ("x" * 100_000, None, 2), ("", "p", 3)],
                                "value string, part string, `source` long").withColumn("column", F.lit(0.1) + F.lit(0.2))
    ps.add_states(odd, "odd", F.col("part"), path)
    top = {(r["column"], r["rank"]): (r["value"], r["cnt"]) for r in ps.merged_top_values(ps.read_states(spark, path)).collect()}
    assert top["value", 1][0].startswith("sha2:") and top["value", 1][1] == 2 and top["part", 1] == ("p", 2)
    got = by_column(ps.merged_profile(ps.read_states(spark, path)))
    assert got["value"]["missing"] == 1 and got["source"]["mean"] == 2 and got["column"]["type"] == "numeric"
    ps.add_states(odd.limit(0), "odd", F.col("part"), path)  # no parts, nothing replaced
    assert by_column(ps.merged_cardinality(ps.read_states(spark, path)))["part"]["n"] == 2


def test_types_and_many_columns(spark, tmp_path):
    """Every type has the figures of its text, in several passes over the rows, and no cell becomes a row of its own."""
    rows = [(k, 2 ** 60 + k, [0.5, -0.0, 1e-5, float("nan"), float("inf"), 1e17, None][k % 7], ["A", "NA", " 1.5 ", None][k % 4]) for k in range(40)] + [(None,) * 4]
    t = spark.createDataFrame(rows, "i int, l long, d double, s string").selectExpr(
        "i", "l", "d", "s", "cast(d as float) as f", "cast(i as decimal(9,3)) as m", "i > 3 as b", "date_add(date'2024-01-01', i) as day",
        "timestamp_seconds(i) as ts", "s as `odd name`", "cast(i % 3 as string) as part")
    whole = ps.partition_states(t, F.col("part"), t.columns)
    assert "Expand" not in whole._jdf.queryExecution().executedPlan().toString() and len(t.columns) > ps.COLUMNS_AT_ONCE
    ps.add_states(t, "t", F.col("part"), str(tmp_path / "s"))
    got, want = by_column(ps.merged_profile(ps.read_states(spark, str(tmp_path / "s")))), by_column(profile.distribution_summary(cells(t, "t")))
    assert set(got) == set(want)
    for c, w in want.items():
        for name in ("count", "unique", "missing", "type", "mean", "std", "min", "max"):
            assert got[c][name] == (pytest.approx(w[name], rel=1e-9) if isinstance(w[name], float) else w[name]), (c, name)
