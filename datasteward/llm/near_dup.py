"""Near duplicates by circulant MinHash, banding and exact verification on the full shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datasteward.llm.common import (components, drop_table, is_empty, mix, window_hashes, word_hashes, write_table)

UNIVERSE_BITS = 20  # shingles are folded to this many bits for the signatures only; links use all 64 bits


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word windows; the words are cut at ASCII white space, A-Z in lower case."""
    return np.unique(window_hashes(word_hashes(text.encode().lower().split()) if text else np.empty(0, np.uint64), words))


def _first_permutation(x: np.ndarray) -> np.ndarray:
    """sigma: a fixed bijection of the folded universe, which breaks up any structure of the positions."""
    mask = np.uint64((1 << UNIVERSE_BITS) - 1)
    x = (x * np.uint64(0x9E375)) & mask
    x = x ^ (x >> np.uint64(9))
    return ((x * np.uint64(0xB5297)) & mask).astype(np.int64)


def circulant_table(size: int, seed: int) -> np.ndarray:
    """Row p holds pi(p), pi(p + 1), ... pi(p + size - 1): the second permutation under all its circular shifts."""
    pi = np.random.Generator(np.random.PCG64(seed)).permutation(1 << UNIVERSE_BITS).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:size - 1]]), size)


def signature(shingles: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Coordinate k is the least pi(sigma(x) + k) over the set: two permutations give all coordinates."""
    at = _first_permutation(mix(shingles) >> np.uint64(64 - UNIVERSE_BITS))
    out = table[at[:512]].min(axis=0)
    for k in range(512, len(at), 512):
        np.minimum(out, table[at[k:k + 512]].min(axis=0), out=out)
    return out


def set_key(shingles: np.ndarray) -> int:
    """64 bits of a digest of the whole set: documents with equal sets share it."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketches(words: int, bands: int, rows: int, seed: int):
    def run(batches):
        table = circulant_table(bands * rows, seed)
        weight = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        salt = mix(np.arange(101, 101 + bands, dtype=np.uint64))
        for batch in batches:
            keys, sizes, marks = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words)
                sizes.append(len(s))
                if len(s):
                    keys.append(set_key(s))
                    cells = signature(s, table).astype(np.uint64).reshape(bands, rows)
                    marks.append(mix((cells * weight).sum(axis=1, dtype=np.uint64) + salt).view(np.int64))
                else:
                    keys.append(None)
                    marks.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "digest", "node", "n_shingles", "bands"])
            del batch, keys, sizes, marks
            pa.default_memory_pool().release_unused()
    return run


def _full_sets(words: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([set_key(s) for s in sets], pa.int64()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "found", "shingles"])
            del batch, sets
            pa.default_memory_pool().release_unused()
    return run


def _sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the wanted classes; only the texts of their documents are read again."""
    wanted = classes.select("node", "doc_id").join(nodes, "node")
    return write_table(docs.join(wanted, "doc_id").select("node", "text")
                       .mapInArrow(_full_sets(words), "node long, found long, shingles array<long>")
                       .filter("node = found").select("node", "shingles").dropDuplicates(["node"]))


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with the set sizes nx, ny of nodes x and y, and the exact size of the intersection."""
    return (pairs.join(sets.toDF("x", "sx"), "x").join(sets.toDF("y", "sy"), "y")
            .withColumns({"nx": F.size("sx").cast("long"), "ny": F.size("sy").cast("long"),
                          "shared": F.size(F.array_intersect("sx", "sy")).cast("long")}).drop("sx", "sy"))


def _stars(marked: DataFrame) -> DataFrame:
    """Each bucket gets as its centre the class that meets most others; buckets with one centre become one star: (x, y)
    with x the centre and y a member."""
    size = marked.groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    score = marked.join(size, "mark").groupBy("node").agg(F.sum("n").alias("score"))
    centre = (marked.join(score, "node").groupBy("mark").agg(F.max(F.struct("score", "node")).alias("c"))
              .select("mark", F.col("c.node").alias("x")))
    return marked.join(centre, "mark").filter("node <> x").select("x", F.col("node").alias("y")).distinct()


def _pairs_beside(own: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of members of one star in different components that may still reach the threshold; no other can.

    ``own``: (x = centre, y = member, comp, ny, adds = |y - x|, lacks = |x - y|). Members p and q differ in
    adds_p + adds_q - 2 i + |lacks_p - lacks_q| elements at least, where i counts the added elements they share. Either the
    sizes alone permit a link with i = 0, or they share an added element; then the first one in the order from rare to
    frequent bounds i by what is left behind it, and lies in the part of either list that the threshold leaves open."""
    main = (own.groupBy("x").agg(F.min("comp").alias("low"), F.max("comp").alias("high"),
                                 F.max_by("comp", F.struct(-F.col("adds") - F.col("lacks"), "y")).alias("main"))
            .filter("low <> high").select("x", "main"))
    rest = own.join(main, "x")

    def reach(shared):
        differ = F.col("p.adds") + F.col("q.adds") + F.abs(F.col("p.lacks") - F.col("q.lacks")) - 2 * shared
        return differ * (100 + percent) <= (F.col("p.ny") + F.col("q.ny")) * (100 - percent)

    apart = F.col("p.comp") != F.col("q.comp")
    pair = [F.least("p.y", "q.y").alias("x"), F.greatest("p.y", "q.y").alias("y")]
    by_size = (rest.filter("comp <> main").alias("p")
               .join(rest.alias("q"), (F.col("p.x") == F.col("q.x")) & apart & reach(F.lit(0))).select(*pair))

    added = write_table(rest.drop("main").join(sets.toDF("x", "sx"), "x").join(sets.toDF("y", "sy"), "y")
                        .withColumn("s", F.explode(F.array_except("sy", "sx"))).drop("sx", "sy"))
    often = added.groupBy("x", "s").agg(F.count(F.lit(1)).alias("n"))
    needed = F.greatest(F.lit(1), F.col("adds") - F.floor(F.col("ny") * (100 - percent) / 100))
    listed = (added.join(often, ["x", "s"])
              .withColumn("at", F.row_number().over(Window.partitionBy("x", "y").orderBy("n", "s")))
              .filter((F.col("n") > 1) & (F.col("at") <= F.col("adds") - needed + 1)))
    listed = write_table(listed)
    left = F.least(F.col("p.adds") - F.col("p.at"), F.col("q.adds") - F.col("q.at")) + 1
    by_element = (listed.alias("p").join(listed.alias("q"), (F.col("p.x") == F.col("q.x")) & (F.col("p.s") == F.col("q.s"))
                                         & (F.col("p.y") < F.col("q.y")) & apart & reach(left)).select(*pair))
    out = write_table(by_size.unionAll(by_element).distinct())
    drop_table(added)
    drop_table(listed)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
                    bands: int = 48, rows: int = 6, seed: int = 11) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents with equal shingle sets form a class. Classes that agree in all rows of a band meet in a bucket; two sets
    with a similarity of 0.8 share a bucket with a probability of 1 - (1 - 0.8^6)^48, above 0.9999995. In a bucket, every
    class is measured against one centre on the full sets, so a large group of copies costs a few tests per member. Pairs
    that are in one component by then need no test; of the others, the differences to their centre tell exactly which ones
    may still reach the threshold (``_pairs_beside``), and those are measured too. No link between components is lost.

    Null or empty texts and texts without words have the empty set, link with nothing and are kept. Rows with a null
    id take no part (component_id null, kept). Repeated rows get the same result each. Rows with one id and different
    texts are separate documents with the same id. Extra columns of ``docs`` are ignored."""
    found = _labelled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words, percent, bands, rows, seed)
    return (found.select("doc_id", "n_shingles",
                         F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def _labelled(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 48, rows: int = 6, seed: int = 11) -> DataFrame:
    """(node, doc_id, digest, n_shingles, comp, component_id) of the rows (doc_id, text): digest is a hash of the text, comp
    the component of its set; both labels are null for empty sets and null ids."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    sketch = write_table(docs.mapInArrow(_sketches(words, bands, rows, seed),
                                         "doc_id long, digest long, node long, n_shingles long, bands array<long>"))
    classes = write_table(sketch.filter("node is not null and doc_id is not null").groupBy("node")
                          .agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    marks = classes.select("node", F.explode("bands").alias("mark"))
    several = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark")
    marked = write_table(marks.join(several, "mark"))
    stars = write_table(_stars(marked))
    drop_table(marked)

    fits = (F.col("shared") * 100 >= (F.col("nx") + F.col("ny") - F.col("shared")) * percent)
    links = [F.col("x").alias("a"), F.col("y").alias("b")]
    sets = _sets_of(stars.select(F.col("x").alias("node")).unionAll(stars.select("y")).distinct(), classes, docs, words)
    known = write_table(_measured(stars, sets))
    comps = components(known.filter(fits).select(*links))
    own = write_table(known.join(comps.toDF("y", "comp"), "y", "left").select(
        "x", "y", F.coalesce("comp", "y").alias("comp"), "ny", (F.col("ny") - F.col("shared")).alias("adds"),
        (F.col("nx") - F.col("shared")).alias("lacks")))
    beside = _pairs_beside(own, sets, percent)
    extra = write_table(_measured(beside, sets).filter(fits).select(*links))
    if not is_empty(extra):
        comps = components(known.filter(fits).select(*links).unionAll(extra))
    for t in (stars, sets, known, own, beside, extra):
        drop_table(t)

    named = classes.select("node", "doc_id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    label = named.join(first, "comp").select("node", "comp", "component_id")
    return sketch.select("doc_id", "digest", "n_shingles", "node").join(label, "node", "left")


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` with one document of every group, all columns unchanged: the one with the smallest id, and of
    texts that share this id the one with the smallest hash.

    Of rows equal in id and text one stays. Rows with a null id all stay, and so does every text without words. Texts of
    different groups stay even where they share an id."""
    found = _labelled(docs.select("doc_id", "text"), **params).filter("doc_id is not null")
    chosen = (found.filter("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "digest")).alias("m"))
              .select("m.doc_id", "m.digest").unionAll(found.filter("comp is null").select("doc_id", "digest")))
    kept = write_table(found.join(chosen.distinct(), ["doc_id", "digest"], "left_semi").groupBy("doc_id", "digest")
                       .agg(F.count(F.lit(1)).alias("n"))).toDF("id_", "digest_", "n_")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"))
    same = (F.col("id") == F.col("id_")) & (F.col("digest") == F.col("digest_"))
    out = keyed.join(kept.filter("n_ = 1"), same, "left_semi").unionAll(keyed.filter("id is null"))
    several = kept.filter("n_ > 1")
    if not is_empty(several):
        out = out.unionAll(keyed.join(several, same, "left_semi").groupBy("id", "digest").agg(F.first("row").alias("row"))
                           .select("row", "id", "digest"))
    return out.select("row.*")
