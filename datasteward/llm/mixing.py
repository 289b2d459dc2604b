"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree deals block quotas to output shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datasteward.llm.common import write_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BLOCKS = 1024  # hashed blocks per source: the number of blocks is bounded, their size grows with the data
MOST_BLOCKS = 10 ** 9  # blocks dealt in all, copies counted: the hypergeometric draw takes no more, so about 240,000 sources
MOST_CELLS = 100_000  # rows of (source, block) that are sent to every task; more of them are joined by a shuffle


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of the total by weight; a target stops at ``most`` times its size, and the excess is shared anew by weight
    among the others until none is above."""
    total = float(sum(sizes))
    out = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), total
    while open_:
        per = left / sum(weights[k] for k in open_)
        above = {k for k in open_ if weights[k] * per > most * sizes[k]}
        for k in above or open_:
            out[k] = most * sizes[k] if above else weights[k] * per
        if not above:
            break
        left -= sum(out[k] for k in above)
        open_ -= above
    return out


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(sources, shards) counts of blocks. A node's blocks are dealt to its two halves of the shards: the left half gets
    its share of the total, drawn from all sources at once without replacement (multivariate hypergeometric), the right
    half the rest. So every quota is met exactly, and every shard holds a random mix of nearly equal size."""
    out = np.zeros((len(quotas), shards), np.int64)

    def deal(left: int, right: int, have: np.ndarray) -> None:
        if right - left == 1:
            out[:, left] = have
            return
        middle = (left + right) // 2
        rng = np.random.Generator(np.random.PCG64([seed, left, right]))
        draw = int(round(have.sum() * (middle - left) / (right - left)))
        # one margin after the other; each is a hypergeometric draw from what is left
        first, rest, n = np.zeros_like(have), int(have.sum()), draw
        for k, h in enumerate(have):
            rest -= int(h)
            first[k] = _hypergeometric(rng, int(h), rest, n)
            n -= int(first[k])
        deal(left, middle, first)
        deal(middle, right, have - first)

    if len(quotas):
        deal(0, shards, np.asarray(quotas, np.int64))
    return out


def _hypergeometric(rng, good: int, bad: int, n: int) -> int:
    return 0 if n == 0 or good == 0 else n if bad == 0 else int(rng.hypergeometric(good, bad, n))


def mixture(docs: DataFrame, size, shards: int = 8, weights=WEIGHTS, most: float = 3.0, seed: int = 5,
            identity: tuple = ("doc_id",)) -> DataFrame:
    """(row, size, source_size, target, draws) for every row of ``docs``: row is a struct of all its columns, whatever their
    names; draws has one struct (shard, place) per copy in the mix; place is a random key, and the rows of a shard in its
    order are its local shuffle.

    Sources in the order of their code points, null last, take the weights in turn. A source whose target is q times its
    size gives every block floor(q) times, and once more the first blocks of a random order until the rest of the target
    is met; the block in which that happens gives its first documents, and one more document closes the gap. Quotas of blocks
    are dealt to the shards by ``splitting_tree``, and each shard takes its disjoint range of the source's permuted blocks.
    Blocks come from a hash of the ``identity`` columns and seed, so reruns agree; rows that are equal in them, null or not,
    are drawn together and count together, and the gap is closed by such rows only if they fit. Null sizes count as 0, and
    rows of size 0 follow their block; an empty table gives an empty mix. The driver holds one row per source; more than
    ``MOST_BLOCKS`` blocks to deal raise an error."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("source"),
                       F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), *identity).alias("hash"))
    rows = rows.withColumn("block", F.pmod("hash", F.lit(BLOCKS)).cast("int"))
    slim = write_table(rows.select("source", "block", "size", "hash"))
    order = Window.partitionBy("source").orderBy("place", "block")  # at most BLOCKS rows
    blocks = write_table(
        slim.groupBy("source", "block").agg(F.sum("size").alias("words"))
        .withColumn("place", F.xxhash64(F.lit(seed + 1), "source", "block"))
        .select("source", "block", "words", F.row_number().over(order).alias("rank"),
                F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto")))
    found = blocks.groupBy("source").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))

    goal = targets([r["words"] for r in found], [weights[k % len(weights)] for k in range(len(found))], most)
    asked = [(r["source"], *(divmod(round(t), r["words"]) if r["words"] else (0, 0))) for r, t in zip(found, goal, strict=True)]
    rest = spark.createDataFrame(asked, "a_source string, a_full long, rest long").filter("rest > 0")
    reached = (blocks.join(rest, F.col("source").eqNullSafe(F.col("a_source"))).filter("upto <= rest")
               .groupBy("source").agg(F.count(F.lit(1)).alias("whole"), F.max("upto").alias("given")).collect())
    reached = {r["source"]: (r["whole"], r["given"]) for r in reached}  # blocks taken once more, and their words
    plan, quotas = [], []
    for r, t, (source, full, more) in zip(found, goal, asked, strict=True):
        whole, given = reached.get(source, (0, 0))
        part = 1 if more and whole < r["n"] else 0
        plan.append((source, r["words"], float(t), int(full), whole, more - given if part else 0, r["n"]))
        quotas.append(full * r["n"] + whole + part)
    if sum(quotas) >= MOST_BLOCKS:
        raise ValueError(f"{sum(quotas)} blocks of {len(quotas)} sources: more than {MOST_BLOCKS} cannot be dealt")
    dealt = np.cumsum(splitting_tree(np.array(quotas, np.int64), shards, seed), axis=1)
    plan = [(*p, [int(x) for x in d]) for p, d in zip(plan, dealt, strict=True)]
    plan = spark.createDataFrame(plan, "p_source string, source_size long, target double, full int, whole int, left long, "
                                       "n int, cuts array<long>")
    ranks = blocks.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "rank")

    # the partly taken block gives its first documents, and the documents nearest to what is then left close the gap
    ranked = (slim.join(ranks, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
              .join(plan.filter("left > 0"), F.col("source").eqNullSafe(F.col("p_source"))))
    before = Window.partitionBy("source").orderBy("hash").rangeBetween(Window.unboundedPreceding, 0)
    last = (ranked.filter("rank = whole + 1").withColumn("sum", F.sum("size").over(before)).filter("sum <= left")
            .groupBy(F.col("source").alias("l_source")).agg(F.max("hash").alias("upto_hash"), F.max("sum").alias("given")))
    plan = write_table(plan.join(last, F.col("p_source").eqNullSafe(F.col("l_source")), "left").drop("l_source")
                       .withColumn("gap", F.col("left") - F.coalesce("given", F.lit(0))))
    open_ = plan.filter("gap > 0").select(F.col("p_source").alias("g_source"), "gap", "upto_hash")
    near = (ranked.join(open_, F.col("source").eqNullSafe(F.col("g_source")))
            .filter((F.col("rank") > F.col("whole") + 1) | (F.col("rank") == F.col("whole") + 1)
                    & F.coalesce(F.col("hash") > F.col("upto_hash"), F.lit(True)))
            .groupBy(F.col("source").alias("n_source"), "hash").agg(F.sum("size").alias("s"), F.first("gap").alias("gap"))
            .filter("s > 0 and s < 2 * gap").groupBy("n_source")
            .agg(F.min(F.struct(F.abs(F.col("s") - F.col("gap")), F.col("hash").alias("pick"))).alias("m"))
            .select("n_source", F.col("m.pick").alias("pick")))
    plan = plan.join(near, F.col("p_source").eqNullSafe(F.col("n_source")), "left").drop("n_source")
    cells = write_table(ranks.join(plan, F.col("b_source").eqNullSafe(F.col("p_source"))).select(
        "b_source", "b_block", "rank", "source_size", "target", "full", "whole", "left", "n", "cuts", "upto_hash", "pick"))
    if cells.count() <= MOST_CELLS:
        cells = F.broadcast(cells)
    out = rows.join(cells, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")), "left")
    times = F.col("full") + F.when(F.col("rank") <= F.col("whole"), 1).when(
        (F.col("left") > 0) & (F.col("rank") == F.col("whole") + 1) & (F.col("hash") <= F.col("upto_hash")), 1).when(
        F.col("hash") == F.col("pick"), 1).otherwise(0)
    copies = F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))
    draws = F.transform(copies, lambda c: F.struct(
        F.size(F.filter("cuts", lambda x: x < c * F.col("n") + F.when(c < F.col("full"), F.col("rank")).otherwise(
            F.least("rank", F.col("whole") + 1)))).alias("shard"),
        F.xxhash64(F.lit(seed + 2), "hash", c).alias("place")))
    return out.select("row", "size", "source_size", "target", draws.alias("draws"))


def mixed_rows(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: one row per copy, all columns of ``docs``, dealt by shard and in the random order of each shard.

    The rows of a shard are spread over ranges of the random key, so a shard may be larger than a task. Null texts count no
    words; rows equal in doc_id and text are drawn together; columns may have any names; no rows give no rows."""
    mix = mixture(docs, word_count(F.col("text")), identity=("doc_id", "text"), **params)
    cuts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return (mix.select("row", F.explode("draws").alias("draw")).repartitionByRange(int(cuts), "draw.shard", "draw.place")
            .sortWithinPartitions("draw.shard", "draw.place").select("row.*"))
