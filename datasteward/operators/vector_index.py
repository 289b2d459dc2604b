"""A stored vector index in blocks with angular bounds, and exact search by cosine that leaves most blocks unread.

Vectors are dealt by their nearest centre and packed into blocks. A block knows its middle direction and the widest angle
to it, so the triangle inequality on the sphere bounds the cosine of a query with any of its vectors from above. A query
first reads the blocks with the highest bounds, which gives the score that its k-th best reaches at least, and then
every block whose bound is not below that. The centres only decide how much is read, never what is found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasteward.operators.ranks import top_k
from datasteward.sources.shared import is_materialized, materialize, shared_dir

BLOCK = 1024  # vectors per block
PER_CENTRE = 256  # vectors per centre, until there are MOST_CENTRES
MOST_CENTRES = 4096
SAMPLE_NUMBERS = 1 << 23  # numbers in the sample that the centres are fitted on, 64 MB on the driver at any size
STEPS = 5  # of fitting the centres
QUERIES = 1000  # queries held by a task
OUTLINES = 4096  # outlines of blocks held by a task
MARGIN = 1e-6  # far above the rounding of an angle and of the nine decimals that decide a tie


@dataclass(frozen=True)
class VectorIndex:
    """The table blocks (block, n, zero, middle, angle, ids, vectors[, tags]) under ``path``, vectors of ``dims`` numbers."""
    spark: SparkSession
    path: str
    dims: int
    ids: T.DataType

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def outlines(self) -> DataFrame:
        """What bounds a block; the vectors are not read."""
        return self.blocks().select("block", "n", "zero", "middle", "angle")


def usable(vector):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _unit(m: np.ndarray) -> np.ndarray:
    top = np.abs(m).max(axis=1, keepdims=True, initial=0)
    m = np.divide(m, top, out=np.zeros_like(m), where=top > 0)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _centres(rows: DataFrame, n: int, dims: int) -> np.ndarray:
    """Directions around which the vectors of a bounded sample, those with the smallest hashes of their ids, gather."""
    if n == 0:
        return np.empty((0, 0))
    most = max(1, SAMPLE_NUMBERS // dims)
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, 2 * most / n) * (1 << 30))
    x = _unit(np.array([r[0] for r in rows.filter(share).select("embedding").limit(most).collect()]))
    x = x[np.abs(x).sum(axis=1) > 0]
    k = max(1, min(len(x) // 8, n // PER_CENTRE, MOST_CENTRES))
    centres = x[np.random.default_rng(0).permutation(len(x))[:k]]
    for _ in range(STEPS if k > 1 else 0):
        near = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(x, len(x) // 8192 + 1)])
        order = near.argsort(kind="stable")
        own, start = np.unique(near[order], return_index=True)
        centres[own] = np.add.reduceat(x[order], start)
        centres = _unit(centres)
    return centres


def _deal(centres: np.ndarray):
    """Adds to every row its unit vector, its centre (-1 for zero vectors), and its cosine with it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            x = _unit(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1))
            zero = ~x.any(axis=1)
            near, far = np.zeros(len(x), int), np.zeros(len(x))
            for at in range(0, len(x) if len(centres) else 0, BLOCK):  # cosines of a block's rows with all centres at a time
                cos = x[at:at + BLOCK] @ centres.T
                near[at:at + BLOCK], far[at:at + BLOCK] = cos.argmax(axis=1), cos.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*[c for c, name in zip(b.columns, b.schema.names, strict=True) if name != "embedding"],
                 pa.array(np.where(zero, -1, near), pa.int32()), pa.array(far), pa.array([r.tobytes() for r in x], pa.binary())],
                names=[*[name for name in b.schema.names if name != "embedding"], "centre", "near", "unit"])
    return run


def _pack(dims: int, block: int):
    """Blocks of up to ``block`` rows of one centre; rows come sorted by centre and nearness."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, None

        def out(t: pa.Table) -> pa.RecordBatch:
            nonlocal made
            x = np.frombuffer(b"".join(t["unit"].to_pylist()), np.float64).reshape(len(t), dims)
            middle = _unit(x.sum(axis=0, keepdims=True))[0]
            zero = t["centre"][0].as_py() < 0
            wide = np.pi if zero or not middle.any() else float(np.arccos(np.clip(x @ middle, -1, 1)).max())
            cols = {"block": pa.array([(part << 32) + made], pa.int64()), "n": pa.array([len(t)], pa.int32()), "zero": pa.array([zero]),
                    "middle": pa.array([middle.tolist()], pa.list_(pa.float64())), "angle": pa.array([wide])}
            made += 1
            for name, to in (("id", "ids"), ("tags", "tags")):
                if name in t.schema.names:
                    values = t[name].combine_chunks()
                    cols[to] = pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), values)
            cols["vectors"] = pa.array([x.tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            centre = held["centre"].to_numpy()
            ends = [*(np.flatnonzero(np.diff(centre)) + 1), len(centre)]
            done = 0
            for end in ends:
                while end - done >= block or (end < len(centre) and end > done):
                    size = min(block, end - done)
                    yield out(held.slice(done, size))
                    done += size
            held = held.slice(done)
        if held is not None and len(held):
            yield out(held)
    return run


def build_index(vectors: DataFrame) -> VectorIndex:
    """An index of (id, embedding) and, if there, tags (array of strings); other columns are left out.

    Null and empty vectors and vectors with null or non-finite components are not part of it; a vector of zeros is, with
    cosine 0. Vectors of several lengths raise an error. A repeated id is found as often as it occurs."""
    spark = vectors.sparkSession
    keep = ["id", *[c for c in vectors.columns if c == "tags"]]
    rows = vectors.filter(usable(F.col("embedding"))).select(*keep, F.col("embedding").cast("array<double>").alias("embedding"))
    if not is_materialized(vectors):
        rows = materialize(rows)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if size["least"] != size["most"]:
        raise ValueError(f"vectors of {size['least']} and of {size['most']} numbers in one index")
    dims, path = size["most"] or 0, f"{shared_dir(spark)}/vector-index-{uuid.uuid4().hex}"
    schema = T.StructType([rows.schema[c] for c in keep]).add("centre", T.IntegerType()).add("near", T.DoubleType()).add("unit", T.BinaryType())
    dealt = materialize(rows.mapInArrow(_deal(_centres(rows, size["n"], dims)), schema))
    form = T.StructType().add("block", T.LongType()).add("n", T.IntegerType()).add("zero", T.BooleanType())
    form = form.add("middle", T.ArrayType(T.DoubleType())).add("angle", T.DoubleType())
    for c, to in (("id", "ids"), ("tags", "tags")):
        if c in keep:
            form = form.add(to, T.ArrayType(rows.schema[c].dataType))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (dealt.repartitionByRange(n, "centre", "near", "id").sortWithinPartitions("centre", "near", "id")
     .mapInArrow(_pack(dims, BLOCK), form.add("vectors", T.BinaryType())).write.parquet(path))
    return VectorIndex(spark, path, dims, rows.schema["id"].dataType)


def _bounds(k: int | None, weight: float, floor: float):
    """(query_id, block, n, most) of the blocks a query may need: those with the highest bounds until they hold k vectors, or,
    without k, those whose bound reaches ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                outlines = batch.column("outlines")[i].values
                asked = batch.column("asked")[i].values
                number, count = (outlines.field(c).to_numpy(zero_copy_only=False) for c in ("block", "n"))
                middle = outlines.field("middle").flatten().to_numpy(zero_copy_only=False).reshape(len(number), -1)
                wide, zero = (outlines.field(c).to_numpy(zero_copy_only=False) for c in ("angle", "zero"))
                q = _unit(asked.field("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(asked), -1))
                away = np.arccos(np.clip(q @ middle.T, -1, 1)) - wide
                most = np.where(zero | ~q.any(axis=1, keepdims=True), 0.0, np.cos(np.maximum(away, 0)))
                most = weight * np.maximum(most, floor)
                if k is None:
                    least = asked.field("least").to_numpy(zero_copy_only=False)
                    row, col = np.nonzero(most >= least[:, None] - MARGIN)
                else:
                    order = np.argsort(-most, axis=1, kind="stable")
                    before = np.cumsum(count[order], axis=1) - count[order]
                    row, at = np.nonzero(before < k)
                    col = order[row, at]
                yield pa.RecordBatch.from_arrays([asked.field("query_id").take(pa.array(row)), pa.array(number[col]), pa.array(count[col]),
                                                  pa.array(most[row, col])], names=["query_id", "block", "n", "most"])
    return run


def _read(k: int, weight: float, floor: float, dims: int, tagged: bool):
    """(query_id, id, score, cosine): the k best rows of one block for each query that asks for it, ties included."""
    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not (len(block) and len(asked)):
            return pa.table({"query_id": asked["query_id"].slice(0, 0), "id": pa.array([], block.schema.field("ids").type.value_type),
                             "score": pa.array([], pa.float64()), "cosine": pa.array([], pa.float64())})
        x = np.frombuffer(block["vectors"][0].as_py(), np.float64).reshape(-1, dims)
        ids = block["ids"][0].values
        q = _unit(asked["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(asked), -1))
        cosine = q @ x.T
        score = weight * np.maximum(cosine, floor)
        order = np.round(score, 9)
        wanted = asked["tag"].to_pylist()
        if any(t is not None for t in wanted):
            has = [set(t or ()) for t in block["tags"][0].as_py()] if tagged else [set()] * len(x)
            inside = {t: np.array([t in h for h in has]) for t in set(wanted) - {None}}
            for j, t in enumerate(wanted):
                if t is not None:
                    order[j, ~inside[t]] = -np.inf
        cut = np.partition(order, -k, axis=1)[:, -k] if len(x) > k else np.full(len(q), -np.inf)
        row, col = np.nonzero((order >= cut[:, None]) & (order > -np.inf))
        return pa.table({"query_id": asked["query_id"].take(pa.array(row)), "id": ids.take(pa.array(col)), "score": score[row, col], "cosine": cosine[row, col]})
    return run


def _spread(df: DataFrame, key: str, parts: int, name: str, group: str) -> DataFrame:
    """The rows of df as lists of structs, dealt to ``parts`` lists by the hash of the key."""
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias(group)).agg(F.collect_list(F.struct(*df.columns)).alias(name))


def blocks_for(index: VectorIndex, asks: DataFrame, k: int | None, weight: float = 1.0, floor: float = -1.0) -> DataFrame:
    """(query_id, block, n, most): blocks with the highest bounds that hold k vectors for each list of outlines, or without k all
    whose bound reaches the query's ``least``. Lists of queries meet lists of outlines, not blocks."""
    lists = max(1, -(-index.outlines().count() // OUTLINES))
    chunks = max(1, -(-asks.count() // QUERIES))
    outlines = _spread(index.outlines(), "block", lists, "outlines", "list")
    asked = _spread(asks, "query_id", chunks, "asked", "chunk").withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lists - 1).cast("long"))))
    schema = T.StructType([asks.schema["query_id"]]).add("block", T.LongType()).add("n", T.IntegerType()).add("most", T.DoubleType())
    return asked.join(outlines, "list").select("asked", "outlines").mapInArrow(_bounds(k, weight, floor), schema)


def _asked(queries: DataFrame, dims: int) -> DataFrame:
    tag = F.col("tag") if "tag" in queries.columns else F.lit(None).cast("string")
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), tag.alias("tag"))
    return materialize(q.filter(usable(F.col("embedding")) & (F.size("embedding") == dims)))


def search(index: VectorIndex, queries: DataFrame, k: int = 5, weight: float = 1.0, floor: float = -1.0) -> DataFrame:
    """(query_id, id, score, cosine, rank): the best k vectors of every query (query_id, embedding[, tag]), exactly.

    The score is weight * max(cosine, floor); scores that agree to nine decimals are ties and go by id. A tag keeps the
    rows that carry it. Queries, with unique ids, stay a table throughout. A query with a null or non-finite component, or of
    another length than the index, has no rows, and so has one whose id is null or whose tag no row carries."""
    asks = _asked(queries, index.dims)
    chunks = max(1, -(-asks.count() // QUERIES))
    blocks = index.blocks()
    tagged = "tags" in blocks.columns
    schema = T.StructType([asks.schema["query_id"], T.StructField("id", index.ids)]).add("score", T.DoubleType()).add("cosine", T.DoubleType())

    def read(pairs: DataFrame) -> DataFrame:
        asked = pairs.select("query_id", "block").join(asks, "query_id").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)))
        own = blocks.select("block", "ids", "vectors", *(["tags"] if tagged else [])).join(asked.select("block", "chunk").distinct(), "block")
        own = own.withColumnsRenamed({"block": "own_block", "chunk": "own_chunk"})
        found = own.groupBy("own_block", "own_chunk").cogroup(asked.groupBy("block", "chunk"))  # one block and about QUERIES queries in a group
        return top_k(found.applyInArrow(_read(k, weight, floor, index.dims, tagged), schema), k, "score").drop("rank")

    near = blocks_for(index, asks, k, weight, floor)
    higher = Window.partitionBy("query_id").orderBy(F.desc("most"), "block").rowsBetween(Window.unboundedPreceding, -1)  # k rows a list at most
    probes = near.withColumn("before", F.coalesce(F.sum("n").over(higher), F.lit(0))).filter(F.col("before") < k)
    probes = materialize(probes.select("query_id", "block"))
    first = materialize(read(probes))
    least = (first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found"))
             .filter(F.col("found") >= k).drop("found"))
    known = asks.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    more = blocks_for(index, materialize(known), None, weight, floor).select("query_id", "block").join(probes, ["query_id", "block"], "left_anti")
    return top_k(first.unionByName(read(more)), k, "score")
