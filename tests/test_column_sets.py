"""Similar columns of a wide catalog against comparing every pair."""

import math
import random
from itertools import permutations

import pytest

from datasteward.operators import column_sets as cs

VF = "source string, column string, value string, cnt long"


@pytest.fixture(scope="module")
def catalog():
    """120 columns: all hold '0', thirty are equal flags, some are parts of others, some share only frequent values."""
    rng = random.Random(3)
    columns = {("flags", f"f{k:02d}"): {"0": 5, "1": 2} for k in range(30)}
    for k in range(60):
        base = {f"v{v}": rng.randint(1, 4) for v in rng.sample(range(150), rng.randint(1, 40))}
        columns[f"s{k % 3}", f"c{k:02d}"] = {**base, "0": rng.randint(1, 9)}
    for k in range(20):
        whole = columns[f"s{k % 3}", f"c{k:02d}"]
        kept = rng.sample(sorted(whole), max(1, int(len(whole) * 0.9)))
        columns["parts", f"p{k:02d}"] = {v: whole[v] for v in kept} | {"0": 1}
    for k in range(9):
        columns["own", f"o{k}"] = {f"own{k}-{v}": 1 for v in range(12)} | {"0": 3}
    columns["own", "alone"] = {"nothing like it": 4}
    return columns


def frame(spark, columns):
    return spark.createDataFrame([(*k, v, c) for k, vs in columns.items() for v, c in vs.items()], VF)


def score(measure, a, b):
    n = len(a.keys() & b.keys())
    if measure == "cosine":
        norm = math.sqrt(sum(c * c for c in a.values())) * math.sqrt(sum(c * c for c in b.values()))
        return sum(a[v] * b[v] for v in a.keys() & b.keys()) / norm
    return n / {"jaccard": len(a.keys() | b.keys()), "overlap": min(len(a), len(b)), "containment": len(a)}[measure]


@pytest.mark.parametrize("measure", cs.MEASURES)
def test_threshold_equals_every_pair(spark, catalog, measure, monkeypatch):
    monkeypatch.setattr(cs, "HOLDERS_PER_SLOT", 7)
    monkeypatch.setattr(cs, "VALUES_PER_SLOT", 5)
    got = {((r[0], r[1]), (r[2], r[3])): r["score"] for r in cs.similar_columns(frame(spark, catalog), 0.7, measure).collect()}
    want = {(a, b): score(measure, catalog[a], catalog[b]) for a, b in permutations(catalog, 2)
            if measure == "containment" or a < b}
    want = {p: x for p, x in want.items() if x >= 0.7}
    assert got == pytest.approx(want) and len(want) > 435  # the flags alone are 435 pairs


@pytest.mark.parametrize("measure", ["cosine", "containment", "overlap"])
def test_nearest_equals_every_pair(spark, catalog, measure):
    got = {}
    for r in cs.nearest_columns(frame(spark, catalog), 4, measure).collect():
        got.setdefault((r["source"], r["column"]), []).append((r["rank"], (r["source_b"], r["column_b"]), round(r["score"], 9)))
    for a in catalog:
        all_ = sorted((-round(score(measure, catalog[a], catalog[b]), 9), b) for b in catalog if b != a)
        want = [(k + 1, b, -x) for k, (x, b) in enumerate(y for y in all_ if y[0] < 0)][:4]
        assert sorted(got.get(a, [])) == [w for w in want if w[0] <= 4]


def test_frequent_values_make_few_candidates(spark, catalog):
    s = cs.column_sets(frame(spark, catalog), "jaccard")
    sets = s.classes.select("set_id").distinct().count()
    assert sets <= len(catalog) - 29
    assert cs.candidates(s, 0.7).count() < sets * sets / 2 / 10  # all of them share '0'


def test_odd_columns(spark):
    empty = frame(spark, {("a", "x"): {"1": 1}}).limit(0)
    for measure in cs.MEASURES:
        assert cs.similar_columns(empty, 0.5, measure).count() == 0
    assert cs.nearest_columns(empty, 3).count() == 0
    clash = frame(spark, {("a", "x"): {"1": 1, "2": 2}, ("b", "x"): {"1": 1, "2": 9}, ("b", "y" * 300): {"z" * 100_000: 1}}).selectExpr(
        "*", "1 AS size", "'t' AS set_id", "0 AS holders", "cnt AS rest", "value AS slot")
    assert [tuple(r) for r in cs.similar_columns(clash, 1.0).collect()] == [("a", "x", "b", "x", 2, 1.0)]
    assert {r["column"] for r in cs.nearest_columns(clash, 3).collect()} == {"x"}
    for wrong in ({"at_least": 0}, {"at_least": 0.5, "measure": "other"}):
        with pytest.raises(ValueError):
            cs.similar_columns(clash, **wrong)
