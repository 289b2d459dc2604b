"""Keyword scores of queries and documents, block by block: a block of documents meets a list of queries in one group.

A pair of a query and a document is a cell of a small matrix of the task, not a row of the job, and with ``k`` only the best
pairs of each block leave it. So what is shuffled are the postings, the words of the queries once for each block, and the best
pairs; a task holds one block of ``DOCS`` documents and one list of about ``QUERIES`` queries at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasteward.sources.shared import materialize

DOCS = 4096  # documents per block
QUERIES = 500  # queries met by a block at a time
NORM = -1  # the number of no term: rows with a document's squared length
MARGIN = 1e-6  # far above the rounding of a sum of scores
NEAR = 2e-9  # scores that can agree to nine decimals


def numbered_terms(terms: DataFrame) -> DataFrame:
    """(term, t): the distinct words of ``terms`` with numbers from 0."""
    return materialize(terms.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The places of the values among the distinct values, and these in order, null first."""
    coded = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    order = pc.array_sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order))


def _runs(t: np.ndarray) -> tuple[np.ndarray, dict[int, slice]]:
    """An order by term, and the run of each term in it."""
    order = t.argsort(kind="stable")
    own, start = np.unique(t[order], return_index=True)
    return order, {int(w): slice(a, b) for w, a, b in zip(own, start, [*start[1:], len(t)], strict=True)}


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of all scores that can be among the k best to nine decimals; of equal ones only the first k."""
    at = np.flatnonzero(scores)
    if len(at) <= k:
        return at
    own = scores[at]
    cut = np.partition(own, len(own) - k)[len(own) - k]
    near = own >= cut - max(NEAR, abs(cut) * 1e-12)
    at, own = at[near], own[near]
    order = np.lexsort((at, -own))
    start = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])
    count = np.diff(np.r_[start, len(order)])
    return at[order[np.arange(len(order)) - np.repeat(start, count) < k]]


def _score(k: int | None, lengths: bool, bounded: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (doc, ids), (query, names) = _numbered(left["id"]), _numbered(right["query_id"])
        by_doc, docs_of = _runs(left["t"].to_numpy())
        by_query, queries_of = _runs(right["t"].to_numpy())
        a, w = left["a"].to_numpy()[by_doc], right["w"].to_numpy()[by_query]
        doc, query = doc[by_doc], query[by_query]
        strong = right["strong"].to_numpy()[by_query] if bounded else np.ones(len(query), bool)
        score = np.zeros((len(names), len(ids)))
        fix = np.zeros_like(score) if lengths else None

        def add(wanted: np.ndarray) -> None:
            for t, asked in queries_of.items():
                own, some = docs_of.get(t), wanted[asked]
                if own is None or not some.any():
                    continue
                to = query[asked][some]
                x = np.bincount(doc[own], a[own], len(ids))
                score[to] += w[asked][some][:, None] * x
                if lengths:
                    fix[to] += v[asked][some][:, None] * (x * x)

        v = right["v"].to_numpy()[by_query] if lengths else None
        add(strong)
        if bounded:  # the other terms count for documents that can still reach the least score
            rest, least = np.zeros(len(names)), np.full(len(names), -np.inf)
            rest[query], least[query] = right["rest"].to_numpy()[by_query], right["least"].to_numpy()[by_query]
            score[score + rest[:, None] < least[:, None] - MARGIN] = 0
            kept = score > 0
            add(~strong & kept.any(axis=1)[query])
            score[~kept] = 0
        if lengths:
            norm = np.zeros(len(ids))
            norm[doc[docs_of[NORM]]] = a[docs_of[NORM]]
            score = np.divide(score, np.sqrt(norm + fix), out=np.zeros_like(score), where=score > 0)
        cells = [np.flatnonzero(s) if k is None else _best(s, k) for s in score]
        row, col = np.repeat(np.arange(len(cells)), [len(c) for c in cells]), np.concatenate([*cells, np.empty(0, np.int64)]).astype(np.int64)
        return pa.table({"query_id": names.take(pa.array(row)), "id": ids.take(pa.array(col)), "score": score[row, col]})
    return run


def pair_scores(postings: DataFrame, asked: DataFrame, n_docs: int, k: int | None = None) -> DataFrame:
    """(query_id, id, score) of postings (id, t, a) and asked terms (query_id, t, w): the sum of a * w over common terms, of
    pairs with a positive sum; with ``k`` of those pairs only that can be among the best k of their query.

    With a column v in ``asked`` the sum is divided by the root of a document's squared length, its row with the term ``NORM``,
    plus the sum of a * a * v. With columns strong, rest and least the terms that are not strong, which add at most rest, count
    only for documents that reach least with them. A document repeats no term, and neither does a query."""
    asked = materialize(asked)
    blocks = max(1, -(-n_docs // DOCS))
    lists = max(1, -(-asked.select("query_id").distinct().count() // QUERIES))

    def each(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = postings.select("id", "t", "a", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), each(lists).alias("list"))
    right = asked.select("*", F.pmod(F.xxhash64("query_id"), F.lit(lists)).alias("list"), each(blocks).alias("block"))
    schema = T.StructType([asked.schema["query_id"], postings.schema["id"], T.StructField("score", T.DoubleType())])
    run = _score(k, "v" in asked.columns, "strong" in asked.columns)
    return left.groupBy("block", "list").cogroup(right.groupBy("block", "list")).applyInArrow(run, schema)
