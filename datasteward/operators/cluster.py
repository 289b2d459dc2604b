"""K-means with farthest-first seeding over any number of points.

The points stay distributed. Each round is one pass: a task turns its Arrow batches into
one partial sum per cluster, Spark adds the partial sums, and k centroids reach the
driver. Nothing is kept between rounds, so a lost executor costs only its partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasteward.sources.shared import is_materialized, materialize


def _matrix(col: pd.Series) -> np.ndarray:
    return np.vstack(col.to_numpy()).astype("float64")


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centroids], axis=1)


def _farthest(points: DataFrame, centroids: np.ndarray) -> list[float]:
    """The point farthest from its nearest centroid; ties go to the smallest id."""
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            d = _distances(_matrix(pdf["features"]), centroids).min(axis=1)
            order = np.lexsort((pdf["id"].to_numpy(), -d))
            i = order[0]
            cand = (-float(d[i]), pdf["id"].iloc[i], list(map(float, pdf["features"].iloc[i])))
            if top is None or cand[:2] < top[:2]:
                top = cand
        if top is not None:
            yield pd.DataFrame([top], columns=["neg", "id", "features"])

    schema = f"neg double, id {dict(points.dtypes)['id']}, features array<double>"
    return points.mapInPandas(best, schema).orderBy("neg", "id").first()["features"]


def _round(points: DataFrame, centroids: np.ndarray, previous: np.ndarray | None):
    """(new centroids, changed assignments, inertia, sizes) of one pass."""
    k = len(centroids)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, inertia, changed = np.zeros(k, "int64"), np.zeros_like(centroids), np.zeros(k), np.zeros(k, "int64")
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = _matrix(pdf["features"])
            d = _distances(x, centroids)
            own = d.argmin(axis=1)
            old = np.zeros(len(own), "int64") if previous is None else _distances(x, previous).argmin(axis=1)
            np.add.at(n, own, 1)
            np.add.at(sums, own, x)
            np.add.at(inertia, own, d[np.arange(len(own)), own] ** 2)
            np.add.at(changed, own, (own != old).astype("int64"))
        head = np.stack([n, inertia, changed], axis=1).astype("float64")
        yield pd.DataFrame({"cluster": range(k), "s": list(np.hstack([head, sums]))})

    parts = points.mapInPandas(partial, "cluster int, s array<double>")
    rows = (parts.select("cluster", F.posexplode("s").alias("i", "v"))
            .groupBy("cluster", "i").agg(F.sum("v").alias("v")).collect())
    table = np.zeros((k, centroids.shape[1] + 3))
    for r in rows:
        table[r["cluster"], r["i"]] = r["v"]
    sizes, new = table[:, 0], centroids.copy()
    filled = sizes > 0
    new[filled] = table[filled, 3:] / sizes[filled, None]
    return new, int(table[:, 2].sum()), float(table[:, 1].sum()), sizes


def _prepared(points: DataFrame) -> DataFrame:
    """Id and features only, written once so that no round repeats the work before it."""
    if is_materialized(points):
        return points
    return materialize(points.select("id", F.col("features").cast("array<double>").alias("features")))


def fit(points: DataFrame, k: int, rounds: int = 50) -> dict:
    """Centroids after at most ``rounds`` passes. ``points`` has an orderable id and features."""
    points = _prepared(points)
    n = points.count()
    if n == 0 or k <= 0:
        return {"centroids": np.zeros((0, 0)), "iterations": 0, "inertia": 0.0}
    k = min(k, n)
    centroids = np.array([points.orderBy("id").first()["features"]], dtype="float64")
    for _ in range(1, k):
        centroids = np.vstack([centroids, _farthest(points, centroids)])
    previous, trace = None, []
    for i in range(rounds):
        new, changed, inertia, _ = _round(points, centroids, previous)
        trace.append(float(inertia))
        if changed == 0 and i > 0:
            break
        previous, centroids = centroids, new
    else:
        # the assignment belongs to the centroids before the last update
        inertia = _inertia(points, previous, centroids)
        return {"centroids": centroids, "assign_by": previous, "iterations": rounds, "inertia": inertia, "trace": trace}
    return {"centroids": centroids, "assign_by": centroids, "iterations": i + 1, "inertia": float(inertia), "trace": trace}


def _inertia(points: DataFrame, assign_by: np.ndarray, centroids: np.ndarray) -> float:
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["features"])
                own = _distances(x, assign_by).argmin(axis=1)
                total += float(((x - centroids[own]) ** 2).sum())
        yield pd.DataFrame({"v": [total]})

    return points.mapInPandas(partial, "v double").agg(F.sum("v")).first()[0]


def assign(points: DataFrame, model: dict) -> DataFrame:
    """Add the cluster of each point."""
    centers = model.get("assign_by", model["centroids"])

    @F.pandas_udf("int")
    def nearest(features: pd.Series) -> pd.Series:
        if len(features) == 0:
            return pd.Series([], dtype="int32")
        return pd.Series(_distances(_matrix(features), centers).argmin(axis=1).astype("int32"))

    return points.withColumn("cluster", nearest(F.col("features").cast("array<double>")))


def kmeans(points: DataFrame, k: int, rounds: int = 50) -> DataFrame:
    """(id, cluster) for every point."""
    return assign(points, fit(points, k, rounds)).select("id", "cluster")


def cluster_columns(features: DataFrame, k: int = 2) -> DataFrame:
    """Group columns by shape: members, size and summary of each cluster."""
    names = ["numeric_ratio", "cardinality_ratio", "missing_ratio", "date_ratio", "avg_length"]
    pts = features.select(F.concat_ws(".", "source", "column").alias("id"), F.array(*names).alias("features"),
                          "numeric_ratio", "missing_ratio", "type", "unique")
    out = assign(pts, fit(pts, k))
    return out.groupBy("cluster").agg(
        F.sort_array(F.collect_list("id")).alias("members"), F.count(F.lit(1)).alias("size"),
        F.avg("numeric_ratio").alias("numeric_ratio"), F.avg("missing_ratio").alias("missing_ratio"),
        (F.sum("unique") / (F.count(F.lit(1)) * F.greatest(F.max("unique"), F.lit(1)))).alias("cardinality_ratio"),
        F.avg((F.col("type") == "date").cast("double")).alias("has_dates"))


def optimal_k(points: DataFrame, k_max: int = 6) -> DataFrame:
    """Inertia per k and the elbow: the k reached by the largest drop."""
    points = _prepared(points)
    n = points.limit(k_max + 3).count()
    ks = [] if n <= 2 or k_max <= 2 else list(range(1, min(k_max, n) + 1))
    inertia = [float(fit(points, k)["inertia"]) for k in ks]
    drops = [a - b for a, b in zip(inertia, inertia[1:])]
    best = 1 if len(inertia) <= 2 else drops.index(max(drops)) + 2
    rows = [(k, v, k == best) for k, v in zip(ks, inertia)] or [(1, 0.0, True)]
    return points.sparkSession.createDataFrame(rows, "k int, inertia double, optimal boolean")
