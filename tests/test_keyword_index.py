"""Search from a stored keyword index against scoring every document that shares a term."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from datasteward.operators import keyword_index as ki
from datasteward.operators import keyword_scores as ks
from datasteward.operators import retrieval as rt
from datasteward.sources.shared import shared_dir

DOCS = "id long, source string, text string"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    text = lambda: " ".join(["common"] * rng.randint(0, 3) + rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(1, 25)))
    rows = [(k, f"s{k % 4}", text()) for k in range(300)] + [(900, "s1", None), (901, "s1", ""), (902, None, "w3 w4 common"), (903, "s9", "w59 w58")]
    return rows + [(1000 + k, "copies", "w1 w2 common w7") for k in range(40)]


QUERIES = [(1, "common w59"), (2, "common common w1"), (3, "w0 w1 w2 w3 w4 w5"), (4, "unknown"), (5, ""), (6, "w59"), (7, "w1 w2 w7"), (8, None), (9, "w30 common unknown w2")]


def results(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["bm25"], 8)) for r in df.collect())


def test_search_equals_full_scores(spark, corpus, monkeypatch):
    assert shared_dir(spark)
    monkeypatch.setattr(ki, "DOCS_PER_BLOCK", 50)
    df, q = spark.createDataFrame(corpus, DOCS), spark.createDataFrame(QUERIES, "query_id long, text string")
    index = ki.build_index(df)
    assert index.blocks().filter("term = 'common'").count() > 3 and index.blocks().agg(F.max("n")).first()[0] < 150
    for k in (1, 5, 400):
        assert results(ki.search(index, q, k)) == results(rt.bm25_search(df, q, k))
    assert ki.search(index, q.limit(0)).count() == 0


def test_replaced_sources(spark, corpus):
    df, q = spark.createDataFrame(corpus, DOCS), spark.createDataFrame(QUERIES, "query_id long, text string")
    index = ki.build_index(df)
    before = {f for f in index.blocks().inputFiles()}
    again = spark.createDataFrame([(5, "s1", "w59 w0 common"), (5000, "s1", "w59 common"), (5001, "new", "w30")], DOCS)
    ki.build_index(again, index.path)
    assert before < {f for f in index.blocks().inputFiles()}  # the old segment stays as it is
    now = rt.replace_sources(df.filter("source is not null"), again).unionByName(df.filter("source is null"))
    assert results(ki.search(index, q, 5)) == results(rt.bm25_search(now, q, 5))


def test_only_the_best_pairs_leave_a_block(spark, corpus, monkeypatch):
    """Of a query that shares a term with every document a block hands on the best, copies included once k are there."""
    monkeypatch.setattr(ks, "DOCS", 50)
    monkeypatch.setattr(ks, "QUERIES", 3)
    df, q = spark.createDataFrame(corpus, DOCS), spark.createDataFrame(QUERIES, "query_id long, text string")
    pairs, some = rt.bm25_scores(df, q).collect(), rt.bm25_scores(df, q, 2).collect()
    blocks = -(-len(corpus) // 50)
    assert max(Counter(r["query_id"] for r in pairs).values()) > 200
    assert max(Counter(r["query_id"] for r in some).values()) <= 2 * blocks + 8  # other scores that agree to nine decimals
    order = lambda rows: sorted(rows, key=lambda r: (r["query_id"], -round(r["bm25"], 9), r["id"]))
    want = [(x, r["id"]) for x in {r["query_id"] for r in pairs} for r in [r for r in order(pairs) if r["query_id"] == x][:2]]
    assert {(r["query_id"], r["id"]) for r in rt.bm25_search(df, q, 2).collect()} == set(want)


def test_words_are_counted_where_their_document_lies(spark, monkeypatch):
    """Repeated ids add up, also null ones, empty and null texts have no postings, and slices of a batch change nothing."""
    monkeypatch.setattr(ki, "WORDS", 3)
    rows = [(1, "s", "red red blue"), (1, "s", "red green"), (2, "s", "blue"), (3, "t", None), (4, "t", ""), (None, "t", "red"), (None, "t", "red blue"), (5, "t", "green " * 9)]
    index = ki.build_index(spark.createDataFrame(rows, "id long, source string, text string").coalesce(1))
    got = sorted((r.term, r.n, r.max_tf, sorted((e.id or 0, e.tf) for e in r.entries)) for r in index.blocks().collect())
    assert got == [("blue", 3, 1, [(0, 1), (1, 1), (2, 1)]), ("green", 2, 9, [(1, 1), (5, 9)]), ("red", 2, 3, [(0, 2), (1, 3)])]
