"""Exact top-k search by inner product with a vector-approximation file.

Every vector has a row of coarse cells. A query scans the cells first, which bounds each score from above; exact vectors are
then read in the order of their bounds until the k-th best exact score reaches the next bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datasteward.llm.common import write_table

BLOCK = 4096  # vectors per block of the approximation file
QUERIES = 256  # queries per block
LIMIT = float(1 << 62)  # a whole number of this size is an error, and so is a score that does not fit a long


def whole_numbers(vector, scale: int = 64):
    """floor(scale * x) of every component, in double precision; null for vectors that take no part. Numbers of 2^62 or
    more raise an error."""
    def whole(v):
        x = v.cast("double") * scale
        return F.when(F.abs(x) < LIMIT, F.floor(x)).otherwise(F.raise_error(F.lit("a component is too large for a whole number")))
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, whole))


def cells_of(x: np.ndarray, bits: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, middle of each column's first cell, step): each component of a block falls in one of 2**bits equal cells of
    its column; middle + step * cell is within step / 2 of it."""
    low, high = x.min(axis=0), x.max(axis=0)
    step = np.maximum((high - low) / (1 << bits), 1e-9)
    cell = np.minimum(((x - low) / step).astype(np.int64), (1 << bits) - 1)
    return cell.astype(np.uint8), low + step / 2, step


def _narrow(x: np.ndarray) -> np.ndarray:
    """As 32-bit numbers where all fit, which halves a block."""
    return x.astype(np.int32) if np.abs(x).max(initial=0) < 1 << 31 else x


def _wide(data: bytes, n: int, dims: int) -> np.ndarray:
    """The (n, dims) numbers of a block, as it was narrowed or not."""
    return np.frombuffer(data, np.int32 if len(data) == 4 * n * dims else np.int64).reshape(n, dims).astype(np.int64)


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x with q; an error if one does not fit a long."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q)) < LIMIT:
        return x @ q
    return np.array([sum(a * b for a, b in zip(row, q.tolist(), strict=True)) for row in x.tolist()], np.int64)


def _pack(batches):
    """Blocks of the approximation file: ids, exact vectors and cells of up to BLOCK vectors of one length."""
    held: dict[int, list] = {}

    def block(n, rows):
        ids = np.concatenate([r[0] for r in rows])
        x = _narrow(np.concatenate([r[1] for r in rows]))
        cell, middle, step = cells_of(x.astype(np.float64)) if n else (x.astype(np.uint8), np.empty(0), np.empty(0))
        return pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
             pa.array([x.tobytes()], pa.binary()), pa.array([cell.tobytes()], pa.binary()),
             pa.array([np.concatenate([middle, step]).tobytes()], pa.binary())],
            names=["dims", "n", "ids", "exact", "cells", "grid"])
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        lengths = np.diff(lists.offsets.to_numpy())
        starts = lists.offsets.to_numpy()[:-1]
        values = lists.values.to_numpy(zero_copy_only=False)
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            x = values[starts[own][:, None] + np.arange(n)]
            held.setdefault(int(n), []).append((ids[own], x))
            while sum(len(r[0]) for r in held[int(n)]) >= BLOCK:
                ids_, x_ = (np.concatenate(c) for c in zip(*held[int(n)], strict=True))
                yield block(int(n), [(ids_[:BLOCK], x_[:BLOCK])])
                held[int(n)] = [(ids_[BLOCK:], x_[BLOCK:])]
    for n, rows in held.items():
        if sum(len(r[0]) for r in rows):
            yield block(n, rows)


def search_block(ids, exact, cells, grid, q_ids, q, k: int):
    """(query id, vector id, score) of the k best vectors of one block for each query, ties to smaller ids, none lost."""
    n = exact.shape[1]
    middle, step = grid[:n], grid[n:]
    own, whole, q = exact.astype(np.int64), q.astype(np.int64), q.astype(np.float64)
    out = []
    if n == 0:
        bound = np.zeros((len(q), len(ids)))
    else:
        approx = (q * step) @ cells.T.astype(np.float64) + (q @ middle)[:, None]
        # the exact score lies within half a cell in every component; the last term covers the rounding of the floats
        bound = approx + (np.abs(q) @ step / 2)[:, None]
        bound += np.abs(q).sum(axis=1)[:, None] * np.abs(exact).max(initial=0) * 1e-9 + 1e-6
    for r in range(len(q)):
        b = bound[r]
        best_s, best_i, unread = np.empty(0, np.int64), np.empty(0, np.int64), ids != q_ids[r]
        want = min(len(ids), 4 * k)
        while True:
            order = np.argpartition(-b, want - 1)[:want] if want < len(ids) else np.arange(len(ids))
            part = order[unread[order]]  # equal bounds may come in another order each time, so what was read is marked
            unread[order] = False
            best_s, best_i = np.concatenate([best_s, _products(own[part], whole[r])]), np.concatenate([best_i, ids[part]])
            top = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[top], best_i[top]
            rest = b[unread]
            if len(rest) == 0 or (len(best_s) == k and rest.max() < best_s[-1]):
                break
            want = min(len(ids), 4 * want)
        out.append((np.full(len(best_s), q_ids[r]), best_i, best_s))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _search(k: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n, dims = r["n"], r["dims"]
                data = (np.frombuffer(r["ids"], np.int64), _wide(r["exact"], n, dims),
                        np.frombuffer(r["cells"], np.uint8).reshape(n, dims), np.frombuffer(r["grid"], np.float64))
                q = _wide(r["q_exact"], r["q_n"], dims)
                found = search_block(*data, np.frombuffer(r["q_ids"], np.int64), q, k)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of every row that fulfils ``is_query``.

    The vectors are packed into blocks once, and so are the queries. Each block of queries meets each block of vectors of
    the same length: it is sent to every slot, while the vectors stay where their slot is; k rows per query and block come
    back. Scores are exact; a component of 2^62 or more after scaling, or a score beyond a long, raises an error. Null ids, null vectors and vectors with null or non-finite components take no part. An id that occurs more than
    once counts once, with its smallest vector. Vectors of another length than the query's are no candidates; a query
    without candidates has no rows. Extra columns are ignored."""
    rows = (vectors.select(F.col(id_col).alias("vec_id"), whole_numbers(F.col(vector_col), scale).alias("x"),
                           is_query.alias("asks"))
            .filter("vec_id is not null and x is not null").groupBy("vec_id").agg(F.min("x").alias("x"), F.max("asks").alias("asks")))
    rows = write_table(rows)
    packed = "dims int, n int, ids binary, exact binary, cells binary, grid binary"
    blocks = write_table(rows.select("vec_id", "x").mapInArrow(_pack, packed))
    asked = write_table(rows.filter("asks").select("vec_id", "x").mapInArrow(_pack_queries, packed))
    slots = max(1, min(blocks.count(), 8 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    data = blocks.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)))
    sent = (asked.select("dims", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("exact").alias("q_exact"))
            .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))))
    # sorted, never broadcast: the size guessed for the queries' file knows nothing of their copies for all slots, which would pass
    # through the driver; the queries stream past the blocks of their slot
    found = sent.hint("merge").join(data, ["slot", "dims"]).mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _pack_queries(batches):
    """Blocks of queries: as _pack, cut to QUERIES each."""
    for b in _pack(batches):
        r = b.to_pylist()[0]
        ids, x = np.frombuffer(r["ids"], np.int64), _wide(r["exact"], r["n"], r["dims"])
        for a in range(0, len(ids), QUERIES):
            part = ids[a:a + QUERIES]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["dims"]], pa.int32()), pa.array([len(part)], pa.int32()), pa.array([part.tobytes()], pa.binary()),
                 pa.array([_narrow(x[a:a + QUERIES]).tobytes()], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.binary())],
                names=["dims", "n", "ids", "exact", "cells", "grid"])
