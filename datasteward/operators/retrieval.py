"""Norm retrieval: chunks, BM25, vectors, hybrid ranking, backing, evaluation.

Keyword scores are sums over common terms, added up in blocks of documents and lists of queries. Vectors are
found by an index in blocks; queries are a table in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasteward.functions import text as tx
from datasteward.functions.vectors import cosine_vec
from datasteward.operators import vector_index
from datasteward.operators.keyword_scores import NORM, numbered_terms, pair_scores
from datasteward.operators.ranks import top_k
from datasteward.sources.shared import materialize

# Chunking and ranking parameters.
CHUNK_SIZE, CHUNK_OVERLAP, MIN_CHUNK, MIN_DOCUMENT = 800, 100, 30, 50
K1, B = 1.5, 0.75
BM25_WEIGHT, COSINE_WEIGHT, BACKING_THRESHOLD = 0.4, 0.6, 0.65
SPACE = r"(?U)^\s+|\s+$"


def chunk_text(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of chunks of one text, built by one fold over its paragraphs and sentences.

    Paragraphs are packed up to ``size`` characters, a new chunk starting with the tail of
    the one before. A longer paragraph closes the chunk and is packed by sentences, without
    overlap. Chunks of 30 characters or less are dropped.
    """
    def unit(kind: str, value) -> Column:
        return F.struct(F.lit(kind).alias("k"), (F.lit("") if value is None else value).alias("v"))

    def units(p: Column) -> Column:
        long = F.concat(F.array(unit("open", None)), F.transform(F.split(p, r"\. "), lambda s: unit("sentence", s)),
                        F.array(unit("close", None)))
        return F.when(F.length(p) > size, long).otherwise(F.array(unit("paragraph", p)))

    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, SPACE, "")), lambda p: p != "")
    stream = F.flatten(F.transform(paragraphs, units))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit("").alias("sent"))

    def emit(done: Column, cond: Column, piece: Column) -> Column:
        return F.when(cond, F.concat(done, F.array(F.regexp_replace(piece, SPACE, "")))).otherwise(done)

    def step(s: Column, u: Column) -> Column:
        k, v, cur, sent = u["k"], u["v"], s["cur"], s["sent"]
        full = F.length(cur) + F.length(v) > size
        spill = F.length(sent) + F.length(v) > size
        tail = F.concat(F.right(cur, F.lit(overlap)), F.lit("\n\n"), v) if overlap > 0 else F.concat(F.lit("\n\n"), v)
        joined = F.when(cur == "", v).when(full, tail).otherwise(F.concat(cur, F.lit("\n\n"), v))
        more = F.when(spill | (sent == ""), v).otherwise(F.concat(sent, F.lit(". "), v))
        close = (((k == "paragraph") & full) | (k == "open")) & (cur != "")
        close_s = (((k == "sentence") & spill) | (k == "close")) & (sent != "")
        return F.struct(
            emit(s["done"], close | close_s, F.when(close, cur).otherwise(sent)).alias("done"),
            F.when(k == "paragraph", joined).when(k == "open", "").otherwise(cur).alias("cur"),
            F.when(k == "sentence", more).when(k == "close", "").otherwise(sent).alias("sent"))

    def finish(s: Column) -> Column:
        return F.filter(emit(s["done"], s["cur"] != "", s["cur"]), lambda c: F.length(c) > MIN_CHUNK)

    return F.aggregate(stream, start, step, finish)


def ingest(documents: DataFrame, source: str = "source", text: str = "text", size: int = CHUNK_SIZE,
           overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(id, source, chunk_index, text) of every document of at least 50 characters."""
    d = documents.filter(F.length(text) >= MIN_DOCUMENT)
    c = d.select(F.col(source).cast("string").alias("source"), F.posexplode(chunk_text(F.col(text), size, overlap)).alias("chunk_index", "text"))
    return c.select(F.concat_ws(":", F.lit("norm"), "source", F.col("chunk_index").cast("string")).alias("id"), "source", "chunk_index", "text")


def replace_sources(corpus: DataFrame, new: DataFrame) -> DataFrame:
    """Re-ingested sources lose all their old chunks."""
    return corpus.join(new.select("source").distinct(), "source", "left_anti").select(*corpus.columns).unionByName(new.select(*corpus.columns))


def hashed_vector(df: DataFrame, id: str, text: str, dims: int = 64) -> DataFrame:
    """(id, embedding): term counts folded into ``dims`` buckets, a stand-in for a model's vectors."""
    t = df.select(id, text).select(id, F.explode(tx.tokenize(F.col(text))).alias("t"))
    bucket = (F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("bigint") % dims).cast("int")
    n = t.groupBy(id, bucket.alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    m = n.groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))  # at most dims entries
    zero = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return df.select(id).join(m, id, "left").select(id, F.coalesce(zero, F.array_repeat(F.lit(0.0), dims)).alias("embedding"))


# --- keyword index ------------------------------------------------------------------------

def postings(corpus: DataFrame, id: str = "id", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, dl). The document length travels with each posting. Of numbered ``terms`` (term, t) only: (id, t, tf, dl)."""
    t = corpus.select(id, text).select(F.col(id).alias("id"), tx.tokenize(F.col(text)).alias("tok"))
    t = t.select("id", F.size("tok").alias("dl"), F.explode("tok").alias("term"))
    if terms is not None:
        t = t.join(terms, "term")
    return t.groupBy("id", "term" if terms is None else "t").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def corpus_totals(corpus: DataFrame, text: str = "text") -> tuple[int, float]:
    """Number of documents and their average length in words; a null text has none."""
    size = corpus.select(text).select(F.size(F.coalesce(tx.tokenize(F.col(text)), F.array().cast("array<string>"))).alias("dl"))
    r = size.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    return r["n"], r["avgdl"] or 1.0


def bm25_idf(post: DataFrame, n_docs: int) -> DataFrame:
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", "df", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of (query_id, text)."""
    t = queries.select("query_id", F.explode(tx.tokenize(F.col("text"))).alias("term"))
    return t.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_scores(corpus: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, id, bm25) of all documents that share a term with a query; with ``k`` of those that can be among its best k.

    Words are reduced to those of the queries before their frequencies are counted,
    and a term that is repeated in a query counts as often as it occurs there.
    """
    q = query_terms(queries)
    terms = numbered_terms(q)
    post = materialize(postings(corpus, terms=terms))
    n_docs, avgdl = corpus_totals(corpus)
    idf = bm25_idf(post.withColumnRenamed("t", "term"), n_docs).select(F.col("term").alias("t"), "idf")
    f = F.col("tf").cast("double")
    part = (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("dl") / avgdl))
    asked = q.join(terms, "term").join(idf, "t").select("query_id", "t", (F.col("qtf") * F.col("idf")).alias("w"))
    return pair_scores(post.select("id", "t", part.alias("a")), asked, n_docs, k).withColumnRenamed("score", "bm25")


def bm25_search(corpus: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Scores every document that shares a term; ``keyword_index.search`` gives the same from a stored index."""
    return top_k(bm25_scores(corpus, queries, k), k, "bm25")


# --- vectors and hybrid -------------------------------------------------------------------

def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Best k vectors by cosine per query: (id, embedding) against (query_id, embedding), by an index made for them."""
    return vector_index.search(vector_index.build_index(vectors.select("id", "embedding")), queries, k).drop("score")


def hybrid_search(corpus: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Keyword and vector ranking combined, best k per query.

    corpus: (id, source, text, embedding, tags), ids unique; queries: (query_id, text, embedding, tag). The
    keyword score is divided by its maximum over the candidates of the query; a tag limits
    the candidates, while document frequencies stay those of the whole corpus.

    A document without a shared term is among the best k only if it is among the best k by vector. Those and the best k
    by keywords give the score that the k-th best reaches at least, and of the other documents with a shared term only
    those are compared whose keywords could reach it with a cosine of 1. A null or broken vector has cosine 0: its document
    is found by its keywords, and its query finds by keywords only.
    """
    corpus = materialize(corpus.select("id", "source", "text", "tags", F.when(vector_index.usable(F.col("embedding")), F.col("embedding")).alias("embedding")))
    queries = materialize(queries.select("query_id", "text", "tag", F.when(vector_index.usable(F.col("embedding")), F.col("embedding")).alias("embedding")))
    cand = materialize(bm25_scores(corpus, queries))
    if queries.filter("tag is not null").limit(1).count():
        cand = (cand.join(queries.select("query_id", "tag"), "query_id").join(corpus.select("id", "tags"), "id")
                .filter(F.col("tag").isNull() | F.array_contains("tags", F.col("tag"))))
    top = cand.groupBy("query_id").agg(F.max("bm25").alias("m")).filter("m > 0")
    share = materialize(cand.join(top, "query_id").select("query_id", "id", (F.col("bm25") / F.col("m")).alias("bm25")))

    def scored(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(corpus.select("id", F.col("embedding").alias("v")), "id")
                .join(queries.select("query_id", F.col("embedding").alias("w")), "query_id"))
        both = both.select("query_id", "id", "bm25", F.greatest(cosine_vec(F.col("v"), F.col("w")), F.lit(0.0)).alias("cosine"))
        return both.withColumn("score", F.col("bm25") * BM25_WEIGHT + F.col("cosine") * COSINE_WEIGHT)

    near = vector_index.search(vector_index.build_index(corpus), queries, k, COSINE_WEIGHT, 0.0)
    first = near.select("query_id", "id").unionByName(top_k(share, k, "bm25").select("query_id", "id")).distinct()
    first = first.join(share, ["query_id", "id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    first = materialize(top_k(scored(first), k, "score"))
    least = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    rest = (share.join(least, "query_id", "left")
            .filter(F.col("least").isNull() | (F.col("bm25") * BM25_WEIGHT + COSINE_WEIGHT >= F.col("least") - vector_index.MARGIN))
            .select("query_id", "id", "bm25").join(first.select("query_id", "id"), ["query_id", "id"], "left_anti"))
    best = top_k(first.drop("rank").unionByName(scored(rest)), k, "score")
    return (best.join(corpus.select("id", "source", "text"), "id")
            .select("query_id", "rank", "id", "source", "text", "score", "cosine", "bm25"))


def backing_queries(concepts: DataFrame, corpus: DataFrame) -> DataFrame:
    """Query text and tag filter per concept (name, standard); the tag is used if it exists."""
    tags = corpus.select(F.explode("tags").alias("name")).distinct().withColumn("tag", F.col("name"))
    text = F.concat_ws(" ", "name", F.coalesce("standard", F.lit("")), F.lit("norma legal definicion"))
    return concepts.join(tags, "name", "left").select(F.col("name").alias("query_id"), text.alias("text"), "tag", "standard")


def find_backing(corpus: DataFrame, concepts: DataFrame, vectorize, threshold: float = BACKING_THRESHOLD) -> DataFrame:
    """References per concept among the best three chunks, with a citation of 200 characters.

    ``vectorize`` turns (query_id, text) into (query_id, embedding).
    """
    q = backing_queries(concepts, corpus)
    q = q.join(vectorize(q.select("query_id", "text")), "query_id")
    hits = hybrid_search(corpus, q.select("query_id", "text", "embedding", "tag"), 3).filter(F.col("score") >= threshold)
    refs = hits.select(F.col("query_id").alias("name"), "rank", "id", "source", "score",
                       F.replace(F.substring("text", 1, 200), F.lit("\n"), F.lit(" ")).alias("cite"))
    return concepts.join(refs, "name", "left").withColumn("found", F.col("id").isNotNull())


def tfidf_rank(docs: DataFrame, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """Documents ranked by TF-IDF cosine; each query belongs to its own corpus.

    The query adds one to the document frequency of its terms. A document's length is
    computed once with the plain frequencies and corrected for the terms it shares with
    the query. Documents without a shared term score 0 and are not listed.
    """
    post = materialize(postings(docs)).withColumn("tf", F.col("tf") / F.col("dl"))
    n = docs.count()
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def idf(d: Column) -> Column:
        return F.log((n + 2) / (d + 1)) + 1

    terms = df.select("term", idf(F.col("df")).alias("idf0"), idf(F.col("df") + 1).alias("idf1"))
    base = post.join(terms, "term").groupBy("id").agg(F.sum(F.pow(F.col("tf") * F.col("idf0"), 2)).alias("norm2"))
    qt = query_terms(queries)
    size = qt.groupBy("query_id").agg(F.sum("qtf").alias("ql"))
    fresh = F.log(F.lit((n + 2) / 2.0)) + 1
    q = (qt.join(size, "query_id").join(terms, "term", "left")
         .select("query_id", "term", (F.col("qtf") / F.col("ql")).alias("qf"), F.coalesce("idf1", fresh).alias("idf1"), "idf0"))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.pow(F.col("qf") * F.col("idf1"), 2))).alias("qnorm"))
    known = numbered_terms(q.filter("idf0 is not null"))
    one, none = F.col("idf1") * F.col("idf1"), F.col("idf0") * F.col("idf0")
    asked = q.join(known, "term").join(qn, "query_id").select("query_id", "t", (F.col("qf") * one / F.col("qnorm")).alias("w"), (one - none).alias("v"))
    own = post.join(known, "term").select("id", "t", F.col("tf").alias("a"))
    lengths = base.select("id", F.lit(NORM).cast("long").alias("t"), F.col("norm2").alias("a"))
    out = pair_scores(own.unionByName(lengths).filter("id is not null"), asked, n, k)
    return out if k is None else top_k(out, k, "score")


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """Chunks and distinct sources."""
    per = corpus.groupBy("source").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.sum("c").alias("total_chunks"), F.count(F.lit(1)).alias("total_sources"))


def retrieval_eval(results: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """Hit rate and mean reciprocal rank of (query_id, rank, source) against (query_id, source)."""
    hit = (results.filter(F.col("rank") <= k).join(expected, ["query_id", "source"]).groupBy("query_id").agg(F.min("rank").alias("r")))
    q = expected.select("query_id").distinct().join(hit, "query_id", "left")
    return q.agg(F.count(F.lit(1)).alias("questions"), F.avg(F.col("r").isNotNull().cast("double")).alias("hit_rate"),
                 F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"))
