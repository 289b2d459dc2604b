"""A prefix trie of conversations with subtree sums by the Euler-tour technique.

The trie is a table of nodes. Each node has an enter and an exit arc; the successor of an arc follows from first children,
next siblings and parents, so the tour is a linked list. Distributed list ranking gives every arc its position, and prefix
sums over the positions give each subtree its sums: those at the exit arc less those before the enter arc."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datasteward.llm.common import drop_table, write_table

CHUNK = 1 << 17  # elements of the list that one task holds at once
BEFORE = (Window.unboundedPreceding, 0)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, group: list[str], order: list[str], running: dict[str, str], numbered: str | None = None) -> DataFrame:
    """``df`` with running aggregates over the rows of each ``group`` in ``order`` up to the row itself: ``running`` maps a
    new column to a column to sum ("+name") or to combine by exclusive or ("^name"); ``numbered`` names a number of the
    rows of all groups, gapless from 0.

    Rows are dealt by ranges of (group, order), so a large group takes several tasks, each of which needs only the totals of
    the parts before it: one row for each part and group in it. ``order`` has to tell all rows of a group apart."""
    ranged = write_table(df.repartitionByRange(_parts(df), *[F.asc_nulls_first(c) for c in group + order])
                         .withColumn("part_", F.spark_partition_id()))
    kind = {"+": F.sum, "^": F.bit_xor}

    def joined(name: str, own, carried):
        zero = F.coalesce(carried, F.lit(0).cast("long"))
        return own + zero if running[name][0] == "+" else own.bitwiseXOR(zero)
    inside = Window.partitionBy("part_", *group).orderBy(*[F.asc_nulls_first(c) for c in order]).rowsBetween(*BEFORE)
    rows = ranged.withColumns({name: kind[what[0]](what[1:]).over(inside) for name, what in running.items()})
    for first in list(running)[:1]:
        several = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
        totals = ranged.groupBy("part_", *group).agg(*[kind[w[0]](w[1:]).alias(f"{name}_t") for name, w in running.items()])
        carried = (totals.select("part_", *group, *[kind[w[0]](f"{name}_t").over(several).alias(f"{name}_c") for name, w in running.items()])
                   .filter(F.col(f"{first}_c").isNotNull()).toDF("p_", *[f"{g}_g" for g in group], *[f"{name}_c" for name in running]))
        same = F.col("part_") == F.col("p_")
        for g in group:
            same = same & F.col(g).eqNullSafe(F.col(f"{g}_g"))
        rows = rows.join(carried, same, "left").withColumns({name: joined(name, F.col(name), F.col(f"{name}_c")) for name in running})
    out = [*df.columns, *running]
    if numbered:
        sizes = ranged.groupBy("part_").agg(F.count(F.lit(1)).alias("rows_"))
        before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
        offsets = sizes.select(F.col("part_").alias("o_"), F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("offset_"))
        every = Window.partitionBy("part_").orderBy(*[F.asc_nulls_first(c) for c in group + order])
        rows = (rows.withColumn("at_", F.row_number().over(every)).join(offsets, F.col("part_") == F.col("o_"))
                .withColumn(numbered, F.col("offset_") + F.col("at_") - 1))
        out.append(numbered)
    rows = write_table(rows.select(*out))
    drop_table(ranged)
    return rows


# --- conversations ------------------------------------------------------------------------------

def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, said, bytes): the turns of each conversation, numbered from 0 in the order of turn (null first), role
    and the SHA-256 of the text; said is a digest of role and text, bytes the size of the text. Null roles and texts count as
    empty, equal rows as several turns; rows with a null conv_id take no part. Extra columns are ignored."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.sha2(text, 256).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"))
    rows = write_table(rows.withColumn("row", F.monotonically_increasing_id()))  # tells equal rows apart
    done = in_order(rows, ["conv_id"], ["turn", "role", "digest", "row"], {"upto": "+one"})
    drop_table(rows)
    said = F.sha2(F.concat("digest", "role"), 256)
    return done.select("conv_id", (F.col("upto") - 1).alias("pos"), said.alias("said"), "bytes")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, pos, said, bytes) of the rebuilt conversations: conversation c has the first h turns of c - c % group (all
    if fewer, none if it is absent), then its own after its first h; h is the unsigned CRC-32 of c in decimal modulo
    ``most``. A conversation that has no turn left keeps one row with pos null. Each base lends at most ``most`` - 1 turns
    to each member of its group."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    c = F.col("conv_id")
    convs = convs.select("conv_id", (c - c % group).alias("base"), (F.crc32(c.cast("string")) % most).alias("h"))
    lent = turns.filter(F.col("pos") < most - 1).toDF("base", "pos", "said", "bytes")
    head = convs.join(lent, "base").filter("pos < h").select("conv_id", "pos", "said", "bytes")
    given = head.groupBy("conv_id").agg(F.count(F.lit(1)).alias("given"))
    rest = turns.join(convs.select("conv_id", "h"), "conv_id").filter("pos >= h").join(given, "conv_id", "left").select(
        "conv_id", (F.col("pos") - F.col("h") + F.coalesce("given", F.lit(0))).alias("pos"), "said", "bytes")
    rows = write_table(head.unionAll(rest))
    bare = convs.select("conv_id").join(rows.select("conv_id").distinct(), "conv_id", "left_anti")
    return rows.unionAll(bare.select("conv_id", F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("long")))


# --- list ranking -------------------------------------------------------------------------------

def _contract(chunk: int):
    """Within each chunk of the rows (arc, next, w), every arc behind another one of the chunk is put to the account of the
    first of its run: (arc, anchor, ahead, next, w). The first of a run keeps the next of the last and the whole length."""
    def solve(arc, nxt, w):
        order = np.argsort(arc, kind="stable")
        at = np.minimum(np.searchsorted(arc, nxt, sorter=order), len(arc) - 1)
        inside = arc[order[at]] == nxt
        before = np.full(len(arc), -1)
        before[order[at[inside]]] = np.flatnonzero(inside)
        anchor = np.where(before < 0, np.arange(len(arc)), before)
        ahead = np.where(before < 0, 0, w[np.maximum(before, 0)])
        while True:  # doubles the steps, so a chunk takes the logarithm of its size in rounds
            further = anchor[anchor]
            if (further == anchor).all():
                break
            ahead = ahead + ahead[anchor]
            anchor = further
        last = np.flatnonzero(~inside)
        to, length = np.full(len(arc), np.iinfo(np.int64).min), np.zeros(len(arc), np.int64)
        to[anchor[last]] = nxt[last]
        length[anchor[last]] = ahead[last] + w[last]
        first = before < 0
        return pa.RecordBatch.from_arrays(
            [pa.array(arc), pa.array(arc[anchor]), pa.array(ahead), pa.array(to, mask=~first), pa.array(length, mask=~first)],
            names=["arc", "anchor", "ahead", "next", "w"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, chunk - n)
                held.append([part.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
                n += len(part)
                batch = batch.slice(len(part))
                if n >= chunk:
                    yield solve(*(np.concatenate(c) for c in zip(*held)))
                    held, n = [], 0
        if n:
            yield solve(*(np.concatenate(c) for c in zip(*held)))
    return run


LEVEL = "arc long, anchor long, ahead long, next long, w long"


def _splice(rows: DataFrame, turn: int) -> DataFrame:
    """One round of random mates over the whole list: an arc that draws 0 behind one that draws 1 is put to its account."""
    def draw(c):
        return F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2))
    takes = (draw(F.col("arc")) == 1) & (draw(F.col("next")) == 0)
    taken = rows.toDF("t_arc", "t_next", "t_w").filter(draw(F.col("t_arc")) == 0)
    both = rows.filter(takes).join(taken, F.col("next") == F.col("t_arc"), "left")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    kept = both.select("arc", F.col("arc").alias("anchor"), zero.alias("ahead"), F.coalesce("t_next", "next").alias("next"),
                       (F.col("w") + F.coalesce("t_w", zero)).alias("w"))
    gone = both.filter("t_arc is not null").select(F.col("t_arc").alias("arc"), F.col("arc").alias("anchor"), F.col("w").alias("ahead"),
                                                   none.alias("next"), none.alias("w"))
    went = gone.select(F.col("arc").alias("g_arc"))
    rest = (rows.filter(~takes).join(went, F.col("arc") == F.col("g_arc"), "left_anti")
            .select("arc", F.col("arc").alias("anchor"), zero.alias("ahead"), "next", "w"))
    return kept.join(went, F.col("arc") == F.col("g_arc"), "left_anti").unionAll(gone).unionAll(rest)


def list_ranks(arcs: DataFrame, near: list[str], chunk: int = CHUNK) -> DataFrame:
    """(arc, rank) of a linked list given as rows (arc, next) and columns ``near``; the last next is no arc. Ranks count
    from 0.

    Rows are dealt by ranges of ``near``, where neighbours of the list should be close, and each chunk of rows contracts its
    runs to their first arcs. While more than one chunk is left, rounds of random mates take a quarter of the rest each;
    then one chunk contracts what is left to the head of the list. Going back, every arc adds its distance to the rank of
    its anchor. So work is in proportion to the list, and no task holds more than a chunk, however long the list is."""
    dealt = arcs.withColumn("w", F.lit(1).cast("long")).repartitionByRange(_parts(arcs), *near).sortWithinPartitions(*near)
    levels = [write_table(dealt.select("arc", "next", "w").mapInArrow(_contract(chunk), LEVEL))]
    while (n := levels[-1].filter("next is not null").count()) > 1:
        rows = levels[-1].filter("next is not null").select("arc", "next", "w")
        step = rows.coalesce(1).mapInArrow(_contract(chunk), LEVEL) if n <= chunk else _splice(rows, len(levels))
        levels.append(write_table(step))
    ranks = levels[-1].select("arc", F.col("ahead").alias("rank"))
    for level in reversed(levels[:-1]):
        held = level.select("arc", "anchor", "ahead").join(ranks.toDF("anchor", "rank"), "anchor")
        ranks = write_table(held.select("arc", (F.col("rank") + F.col("ahead")).alias("rank")))
    return ranks


# --- the trie -----------------------------------------------------------------------------------

def _chunks_of_ids(most: int = 1 << 20):
    """Runs of rows (k1, k2, conv_id) with one key, in ascending order, as comma-joined pieces of bounded size."""
    def run(batches):
        key, ids, first = None, [], None

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([first], pa.int64()),
                                               pa.array([",".join(ids)], pa.string())], names=["k1", "k2", "first", "ids"])
        for batch in batches:
            for a, b, i in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if ids and (key != (a, b) or len(ids) * 20 >= most):
                    yield piece()
                    ids = []
                if not ids:
                    key, first = (a, b), i
                ids.append(str(i))
        if ids:
            yield piece()
    return run


def _hash_pieces(batches):
    """One digest for each run of pieces (k1, k2, first, ids) with one key: the pieces are fed to it in turn."""
    key, digest = None, None
    for batch in batches:
        out = []
        for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if key != (a, b):
                if digest:
                    out.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_buffer())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["k1", "k2", "ends_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([digest.hexdigest()])],
                                         names=["k1", "k2", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of rows (k1, k2, conv_id): SHA-256 of the ascending ids in decimal, joined by commas. Ranges of
    ids are joined in many tasks; the digest of a node streams these pieces, so no list of a node's members is held."""
    order = ["k1", "k2", "conv_id"]
    pieces = (ends.select(*order).repartitionByRange(_parts(ends), *order).sortWithinPartitions(*order)
              .mapInArrow(_chunks_of_ids(), "k1 long, k2 long, first long, ids string"))
    pieces = write_table(pieces)
    return (pieces.repartition(_parts(ends), "k1", "k2").sortWithinPartitions("k1", "k2", "first")
            .mapInArrow(_hash_pieces, "k1 long, k2 long, ends_sha256 string"))


def tour(nodes: DataFrame) -> DataFrame:
    """(arc, next, conv_id, depth) of nodes (id, k1, k2, p1, p2, conv_id, depth) whose ids ascend with (p1, p2, conv_id): arc
    2 * id enters a node, 2 * id + 1 leaves it. Siblings have consecutive ids, so only first and last children are joined,
    one row for each parent."""
    inner = nodes.filter("p1 is not null").groupBy("p1", "p2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    own = nodes.select("id", "k1", "k2", "conv_id", "depth")
    inner = write_table(own.join(inner.toDF("k1", "k2", "first", "last"), ["k1", "k2"], "left")
                        .select("id", "conv_id", "depth", "first", "last"))
    ups = inner.filter("last is not null").select(F.col("last").alias("u_id"), F.col("id").alias("up"))
    exits = inner.join(ups, F.col("id") == F.col("u_id"), "left")
    root = nodes.filter("p1 is null").select(F.col("id").alias("r_id"))
    behind = F.when(F.col("r_id").isNotNull(), -1).when(F.col("up").isNotNull(), 2 * F.col("up") + 1).otherwise(2 * F.col("id") + 2)
    exits = exits.join(root, F.col("id") == F.col("r_id"), "left")
    return (inner.select((2 * F.col("id")).alias("arc"), F.coalesce(2 * F.col("first"), 2 * F.col("id") + 1).alias("next"), "conv_id", "depth")
            .unionAll(exits.select((2 * F.col("id") + 1).alias("arc"), behind.cast("long").alias("next"), "conv_id", "depth")))


def subtree_sums(nodes: DataFrame, values: list[str], chunk: int = CHUNK) -> DataFrame:
    """(id, and for each of ``values`` its sum over the node's subtree, top included) for ``tour``'s nodes."""
    arcs = write_table(tour(nodes))
    ranks = list_ranks(arcs, ["conv_id", "depth"], chunk)
    enter = F.col("arc") % 2 == 0
    node = ranks.withColumn("id", F.floor(F.col("arc") / 2)).join(nodes.select("id", *values), "id")
    given = node.select("rank", "id", enter.alias("enter"), *[F.when(enter, F.col(v)).otherwise(0).alias(v) for v in values])
    size = max(1, -(-2 * nodes.count() // _parts(nodes)))
    placed = write_table(given.withColumn("part_", F.floor(F.col("rank") / size)))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    totals = placed.groupBy("part_").agg(*[F.sum(v).alias(v) for v in values])
    totals = totals.select(F.col("part_").alias("t_part"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_t") for v in values])
    inside = Window.partitionBy("part_").orderBy("rank").rowsBetween(*BEFORE)
    sums = placed.withColumns({f"{v}_s": F.sum(v).over(inside) for v in values}).join(totals, F.col("part_") == F.col("t_part"))
    out = sums.groupBy("id").agg(*[F.sum(F.when(F.col("enter"), F.col(v) - F.col(f"{v}_s") - F.col(f"{v}_t"))
                                         .otherwise(F.col(f"{v}_s") + F.col(f"{v}_t"))).cast("long").alias(v) for v in values])
    out = write_table(out)
    for t in (arcs, ranks, placed):
        drop_table(t)
    return out


def prefix_trie(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each distinct sequence of first turns, from the textless root: (conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns``: (conv_id, pos, said, bytes), pos from 0 without gaps in each conversation; pos null stands for a conversation
    without turns. A node's key combines 128 bits for each of its turns and their places, by exclusive or, so that
    prefixes of a conversation of any length come from running totals of its ranges. conv_id is the smallest member,
    n_convs counts them; n_leaves and saved_tokens sum over the subtree, the latter (n_convs - 1) times the bytes of the last
    turn's text. An empty table has no conversation and no node; extra columns are ignored."""
    rows = turns.filter("pos is not null").select(
        "conv_id", "pos", "bytes", *[F.xxhash64(F.lit(seed), "pos", "said").alias(f"own{seed}") for seed in (1, 2)])
    keyed = in_order(rows, ["conv_id"], ["pos"], {"k1": "^own1", "k2": "^own2"})
    keyed = keyed.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("own1")), "p2": F.col("k2").bitwiseXOR(F.col("own2"))})
    lengths = write_table(turns.groupBy("conv_id").agg(F.count("pos").alias("length")))
    nodes = keyed.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), (F.first("pos") + 1).alias("depth"), F.first("p1").alias("p1"),
                                          F.first("p2").alias("p2"), F.count(F.lit(1)).alias("n_convs"), F.first("bytes").alias("bytes"))
    null, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    nodes = nodes.unionByName(root.select(zero.alias("k1"), zero.alias("k2"), "conv_id", zero.alias("depth"), null.alias("p1"),
                                          null.alias("p2"), "n_convs", zero.alias("bytes")))
    nodes = in_order(nodes, ["p1", "p2"], ["conv_id"], {}, numbered="id")
    children = nodes.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children")).toDF("k1", "k2", "n_children")
    nodes = write_table(nodes.join(children, ["k1", "k2"], "left").withColumns({
        "n_children": F.coalesce("n_children", zero), "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}))
    sums = subtree_sums(nodes, ["n_leaves", "saved_tokens"], chunk)

    last = keyed.join(lengths, "conv_id").filter("pos = length - 1").select("k1", "k2", "conv_id")
    ends = ends_digests(last.unionAll(lengths.filter("length = 0").select(zero, zero, "conv_id")))
    parents = nodes.filter("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.drop("n_leaves", "saved_tokens").join(sums, "id").join(ends, ["k1", "k2"], "left").join(parents, ["p1", "p2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))
