"""Search from a stored vector index against the cosine of every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from datasteward.operators import retrieval
from datasteward.operators import vector_index as vi

VECTORS = "id long, embedding array<double>, tags array<string>"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 6)) * 4
    x = middles[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6)) * 0.4
    x[600:] = x[7]  # a third of the rows are copies
    x[20:23] = 0.0
    x[30] *= 1e200
    tags = [[f"t{i % 5}"] + (["rare"] if i in (41, 603) else []) if i % 7 else None for i in range(900)]
    return x, tags


def found(df, *more):
    return sorted((r["query_id"], r["rank"], r["id"], *[round(r[c], 8) for c in more]) for r in df.collect())


def expected(x, tags, queries, k, weight=1.0, floor=-1.0):
    def unit(m):
        m = m / np.maximum(np.abs(m).max(axis=1, keepdims=True), 1e-300)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    score = np.round(weight * np.maximum(unit(np.array([q[1] for q in queries])) @ unit(x).T, floor), 9)
    out = []
    for row, (qid, _, tag) in zip(score, queries, strict=True):
        own = [i for i in range(len(x)) if tag is None or tag in (tags[i] or [])]
        own.sort(key=lambda i: (-row[i], i))
        out += [(qid, n + 1, i) for n, i in enumerate(own[:k])]
    return sorted(out)


@pytest.mark.parametrize("k, weight, floor", [(1, 1.0, -1.0), (4, 1.0, -1.0), (4, 0.6, 0.0), (1000, 1.0, -1.0)])
def test_search_equals_every_pair(spark, data, monkeypatch, k, weight, floor):
    x, tags = data
    for name, value in (("BLOCK", 16), ("PER_CENTRE", 40), ("OUTLINES", 9), ("QUERIES", 4)):
        monkeypatch.setattr(vi, name, value)
    rows = [(i, [float(c) for c in v], tags[i]) for i, v in enumerate(x)]
    broken = [(2000, None, []), (2001, [], []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0], []), (2003, [float("nan")] * 6, ["t1"]), (2004, [float("inf")] * 6, ["t1"])]
    df = spark.createDataFrame(rows + broken, VECTORS).repartition(5).withColumn("n", F.lit(1)).withColumn("block", F.lit("x"))
    queries = [(i, [float(c) for c in x[i]], None) for i in (0, 7, 20, 30, 99, 650)] + [(-1, [-float(c) for c in x[50]], None), (-2, [1.0] * 6, "t2"),
               (-3, [1.0] * 6, "rare"), (-4, [float(c) for c in x[7]], "t3"), (-5, [0.0] * 6, "t1"), (-6, [1.0] * 6, "nowhere")]
    q = spark.createDataFrame(queries + [(-7, None, None), (-8, [1.0], None), (-9, [float("nan")] * 6, None)], "query_id long, embedding array<double>, tag string")
    index = vi.build_index(df)
    assert index.blocks().agg(F.sum("n")).first()[0] == 900 and index.blocks().agg(F.max("n")).first()[0] <= 16
    assert found(vi.search(index, q, k, weight, floor)) == expected(x, tags, queries, k, weight, floor)


def test_empty_tables(spark, data):
    x, tags = data
    df = spark.createDataFrame([(i, [float(c) for c in v], tags[i]) for i, v in enumerate(x[:30])], VECTORS)
    q = df.select(F.col("id").alias("query_id"), "embedding")
    assert vi.search(vi.build_index(df.limit(0)), q).count() == 0
    assert vi.search(vi.build_index(df), q.limit(0)).count() == 0
    zeros = df.withColumn("embedding", F.transform("embedding", lambda c: c * 0))
    assert found(vi.search(vi.build_index(zeros), q.limit(1), 2), "cosine") == [(0, 1, 0, 0.0), (0, 2, 1, 0.0)]
    with pytest.raises(ValueError):
        vi.build_index(df.withColumn("embedding", F.when(F.col("id") == 3, F.array(F.lit(1.0))).otherwise(F.col("embedding"))))


def test_bounds_hold_and_leave_blocks_out(spark, data, monkeypatch):
    """No vector of a block has a higher cosine than its bound, and few blocks reach a high score."""
    x, tags = data
    monkeypatch.setattr(vi, "BLOCK", 16)
    monkeypatch.setattr(vi, "PER_CENTRE", 40)
    index = vi.build_index(spark.createDataFrame([(i, [float(c) for c in v], tags[i]) for i, v in enumerate(x)], VECTORS))
    asks = [(i, [float(c) for c in x[i]], None, least) for i in range(0, 90, 9) for least in (-5.0,)]
    pairs = vi.blocks_for(index, spark.createDataFrame(asks, "query_id long, embedding array<double>, tag string, least double"), None).collect()
    blocks = {r["block"]: np.frombuffer(r["vectors"]).reshape(-1, 6) for r in index.blocks().collect()}
    assert len(pairs) == len(asks) * len(blocks)
    top = vi._unit(x)
    for r in pairs:
        assert (blocks[r["block"]] @ top[r["query_id"]]).max() <= r["most"] + vi.MARGIN
    high = [(q, v, t, 0.98) for q, v, t, _ in asks if any(v)]
    few = vi.blocks_for(index, spark.createDataFrame(high, "query_id long, embedding array<double>, tag string, least double"), None).count()
    assert 0 < few < len(high) * len(blocks) / 2


def test_hybrid_equals_every_pair(spark, data):
    """Best of all documents by the weighted sum, with tags, without vectors, and for queries without a known word."""
    x, tags = data
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(30)]
    text = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(300)]
    vec = [None if i % 50 == 3 else [float(c) for c in x[i]] for i in range(300)]
    corpus = spark.createDataFrame([(i, f"s{i % 3}", text[i], vec[i], tags[i]) for i in range(300)], "id long, source string, text string, embedding array<double>, tags array<string>")
    asked = [(0, "w1 w2", 5, None), (1, "w3", 200, "t2"), (2, "unknown", 9, None), (3, "", 11, "t4"), (4, "w1 w1 w9 w20", None, None), (5, "w7 w8", 100, "nowhere")]
    q = spark.createDataFrame([(i, t, None if v is None else [float(c) for c in x[v]], g) for i, t, v, g in asked], "query_id long, text string, embedding array<double>, tag string")
    bm = {(r["query_id"], r["id"]): r["bm25"] for r in retrieval.bm25_scores(corpus, q).collect()}
    unit = vi._unit(x)
    want = []
    for i, _, v, tag in asked:
        own = [d for d in range(300) if tag is None or tag in (tags[d] or [])]
        most = max([bm.get((i, d), 0.0) for d in own], default=0.0) or 1.0
        score = {d: 0.4 * bm.get((i, d), 0.0) / most + 0.6 * (max(0.0, float(unit[v] @ unit[d])) if v is not None and vec[d] is not None else 0.0) for d in own}
        best = sorted((d for d in own if score[d] > 0), key=lambda d: (-round(score[d], 9), d))[:6]
        want += [(i, n + 1, d, round(score[d], 8)) for n, d in enumerate(best)]
    got = [r for r in found(retrieval.hybrid_search(corpus, q, 6), "score") if r[3] > 0]
    assert got == sorted(want)
