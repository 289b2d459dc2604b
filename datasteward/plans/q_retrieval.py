"""Queries: documents, chunks, keyword, vector and hybrid search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from datasteward.operators import keyword_index as ki
from datasteward.operators import retrieval as rt
from datasteward.plans.base import Registry, r6, table
from datasteward.sources.readers import documents_of, read_documents
from datasteward.sources.shared import shared_dir

R = Registry()
DIMS = 32


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text", F.array("lang", "source").alias("tags"))


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _threads(spark, sf):
    """A conversation as one text with its turns as paragraphs."""
    c = table(spark, sf, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    return c.groupBy(F.col("conv_id").alias("source")).agg(F.array_join(turns, "\n\n").alias("text"))


_TOK = r"[^\p{L}\p{N}_]+"
_POST = rf"""tk AS (SELECT doc_id AS id, unnest(string_split_regex(lower(text), '{_TOK}')) AS term FROM documents),
p AS (SELECT id, term, count(*) AS tf FROM tk WHERE length(term) > 1 GROUP BY ALL), dl AS (SELECT doc_id AS id, coalesce(n, 0) AS dl FROM documents LEFT JOIN (SELECT id, sum(tf) AS n FROM p GROUP BY 1) x ON x.id = doc_id),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, tot GROUP BY term)"""
_QT = rf"""qk AS (SELECT item_id AS query_id, unnest(string_split_regex(lower(text), '{_TOK}')) AS term FROM benchmark), q AS (SELECT query_id, term, count(*) AS qtf FROM qk WHERE length(term) > 1 GROUP BY ALL)"""
_BM = f"""{_POST}, {_QT}, bm AS (SELECT query_id, p.id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM q JOIN p USING (term) JOIN idf USING (term) JOIN dl ON dl.id = p.id, tot GROUP BY 1, 2)"""


def _hv(src, idc, textc):
    return rf"""SELECT id, list(coalesce(n, 0) ORDER BY b) AS v FROM (SELECT s.id, b.b, c.n FROM (SELECT {idc} AS id FROM {src}) s JOIN (SELECT unnest(range({DIMS})) AS b) b ON true LEFT JOIN
 (SELECT id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {DIMS} AS b, CAST(count(*) AS DOUBLE) AS n FROM (SELECT {idc} AS id, unnest(string_split_regex(lower({textc}), '{_TOK}')) AS t FROM {src}) WHERE length(t) > 1 GROUP BY 1, 2) c
 ON c.id = s.id AND c.b = b.b) GROUP BY id"""


_COS = "CASE WHEN list_sum(list_transform({a}, lambda x: x * x)) > 0 AND list_sum(list_transform({b}, lambda x: x * x)) > 0 THEN list_cosine_similarity({a}, {b}) ELSE 0 END"


@R.add("a6_read_documents", "SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS source, length(text) AS n_chars FROM documents")
def a6(spark, sf):
    d = documents_of(table(spark, sf, "documents"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.col("text"))
    return d.select("source", F.length("text").cast("long").alias("n_chars"))


@R.add("a6_document_files", "SELECT 'item-' || item_id AS source, text FROM benchmark")
def a6b(spark, sf):
    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    one = table(spark, sf, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("name"), "text")
    one.write.partitionBy("name").text(path)  # a folder with one file per text
    return read_documents(spark, path).withColumn("text", F.regexp_replace("text", "\n$", ""))  # the writer's line break


def _chunk_sql(source):
    """The chunks of (source, text) rows by one fold over paragraphs and sentences."""
    s, o = rt.CHUNK_SIZE, rt.CHUNK_OVERLAP
    trim = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
    return rf"""u AS (SELECT source, flatten(list_transform(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {trim.format('p')}), lambda p: p <> ''),
  lambda p: CASE WHEN length(p) > {s} THEN list_concat([{{'k': 'open', 'v': ''}}], list_transform(string_split(p, '. '), lambda x: {{'k': 'sentence', 'v': x}}), [{{'k': 'close', 'v': ''}}])
   ELSE [{{'k': 'paragraph', 'v': p}}] END)) AS us FROM ({source}) WHERE length(text) >= {rt.MIN_DOCUMENT}),
f AS (SELECT source, list_reduce(us, lambda a, b: {{
  'done': CASE WHEN a.cur <> '' AND (b.k = 'open' OR (b.k = 'paragraph' AND length(a.cur) + length(b.v) > {s})) THEN list_concat(a.done, [{trim.format('a.cur')}])
    WHEN a.sent <> '' AND (b.k = 'close' OR (b.k = 'sentence' AND length(a.sent) + length(b.v) > {s})) THEN list_concat(a.done, [{trim.format('a.sent')}]) ELSE a.done END,
  'cur': CASE b.k WHEN 'open' THEN '' WHEN 'paragraph' THEN CASE WHEN a.cur = '' THEN b.v
    WHEN length(a.cur) + length(b.v) > {s} THEN right(a.cur, {o}) || chr(10) || chr(10) || b.v ELSE a.cur || chr(10) || chr(10) || b.v END ELSE a.cur END,
  'sent': CASE b.k WHEN 'close' THEN '' WHEN 'sentence' THEN CASE WHEN a.sent = '' OR length(a.sent) + length(b.v) > {s} THEN b.v ELSE a.sent || '. ' || b.v END ELSE a.sent END}},
  {{'done': []::VARCHAR[], 'cur': '', 'sent': ''}}) AS s FROM u),
c AS (SELECT source, list_filter(CASE WHEN s.cur <> '' THEN list_concat(s.done, [{trim.format('s.cur')}]) ELSE s.done END, lambda x: length(x) > {rt.MIN_CHUNK}) AS cs FROM f),
x AS (SELECT source, unnest(cs) AS text, unnest(range(len(cs))) AS i FROM c)
SELECT 'norm:' || source || ':' || i AS id, source, CAST(i AS INTEGER) AS chunk_index, text FROM x"""


@R.add("h1_chunk_text", f"WITH {_chunk_sql('SELECT CAST(doc_id AS VARCHAR) AS source, text FROM documents')}")
def h1(spark, sf):
    return rt.ingest(table(spark, sf, "documents"), "doc_id")


_THREADS = "SELECT CAST(conv_id AS VARCHAR) AS source, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id"


@R.add("h1_chunk_paragraphs", f"WITH {_chunk_sql(_THREADS)}")
def h1b(spark, sf):
    return rt.ingest(_threads(spark, sf))


# every second half of the sources is ingested again from its upper-case text
@R.add("h2_replace_source", """WITH s AS (SELECT DISTINCT source FROM documents WHERE lang = 'de')
SELECT doc_id AS id, source, CASE WHEN source IN (SELECT source FROM s) THEN 'new' ELSE 'old' END AS version FROM documents""")
def h2(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    s = d.filter("lang = 'de'").select("source").distinct()
    new = d.join(s, "source", "left_semi").select("id", "source", F.lit("new").alias("version"))
    return rt.replace_sources(d.select("id", "source", F.lit("old").alias("version")), new)


@R.add("h3_bm25_index", f"WITH {_POST} SELECT term, df, round(idf, 6) AS idf FROM idf")
def h3(spark, sf):
    d = _docs(spark, sf)
    return rt.bm25_idf(rt.postings(d), rt.corpus_totals(d)[0]).withColumn("idf", r6(F.col("idf")))


@R.add("h4_bm25_search", f"""WITH {_BM}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id) AS rank FROM bm) SELECT query_id, id, round(bm25, 6) AS bm25, rank FROM r WHERE rank <= 5""")
def h4(spark, sf):
    return ki.search(ki.build_index(_docs(spark, sf)), _queries(spark, sf), 5).withColumn("bm25", r6(F.col("bm25")))


# the last source is ingested again, its German texts with one more word
_AGAIN = "SELECT doc_id, source, CASE WHEN lang = 'de' THEN text || ' ' || lang ELSE text END AS text FROM documents WHERE source IN (SELECT max(source) FROM documents)"


@R.add("h4_replaced_search", f"""WITH docs2 AS MATERIALIZED ({_AGAIN} UNION ALL SELECT doc_id, source, text FROM documents WHERE source NOT IN (SELECT max(source) FROM documents)),
{_BM.replace('FROM documents', 'FROM docs2')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id) AS rank FROM bm) SELECT query_id, id, round(bm25, 6) AS bm25, rank FROM r WHERE rank <= 5""")
def h4_again(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text", "lang")
    last = d.agg(F.max("source").alias("source"))
    index = ki.build_index(d)
    again = d.join(last, "source", "left_semi").withColumn("text", F.when(F.col("lang") == "de", F.concat_ws(" ", "text", "lang")).otherwise(F.col("text")))
    return ki.search(ki.build_index(again, index.path), _queries(spark, sf), 5).withColumn("bm25", r6(F.col("bm25")))


@R.add("h5_vector_search", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT min(vec_id) AS query_id FROM e GROUP BY label),
s AS (SELECT query_id, d.vec_id AS id, list_cosine_similarity(x.v, d.v) AS c FROM q JOIN e x ON x.vec_id = query_id JOIN e d ON true),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM s) SELECT query_id, id, round(c, 6) AS cosine, rank FROM r WHERE rank <= 5""")
def h5(spark, sf):
    e = table(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    q = e.join(first.select("vec_id"), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    return rt.vector_search(e.select(F.col("vec_id").alias("id"), "embedding"), q).withColumn("cosine", r6(F.col("cosine")))


def _corpus(spark, sf):
    d = _docs(spark, sf)
    return d.join(rt.hashed_vector(d, "id", "text", DIMS), "id")


def _vectorize(q):
    return rt.hashed_vector(q, "query_id", "text", DIMS)


_HYB = f"""{_BM}, dv AS ({_hv('documents', 'doc_id', 'text')}), qv AS ({_hv('benchmark', 'item_id', 'text')}),
mx AS (SELECT query_id, max(bm25) AS m FROM bm GROUP BY 1),
hy AS (SELECT qv.id AS query_id, dv.id, coalesce(bm.bm25 / mx.m, 0) AS kb, greatest(0, {_COS.format(a='qv.v', b='dv.v')}) AS c FROM qv JOIN dv ON true LEFT JOIN bm ON bm.query_id = qv.id AND bm.id = dv.id LEFT JOIN mx ON mx.query_id = qv.id),
hs AS (SELECT *, kb * 0.4 + c * 0.6 AS score FROM hy)"""


@R.add("h6_hybrid_search", f"""WITH {_HYB}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM hs)
SELECT query_id, rank, id, round(score, 6) AS score, round(c, 6) AS cosine, round(kb, 6) AS bm25 FROM r WHERE rank <= 5""")
def h6(spark, sf):
    q = _queries(spark, sf)
    q = q.join(_vectorize(q), "query_id").withColumn("tag", F.lit(None).cast("string"))
    h = rt.hybrid_search(_corpus(spark, sf), q, 5)
    return h.select("query_id", "rank", "id", *[r6(F.col(c)).alias(c) for c in ("score", "cosine", "bm25")])


# concepts: every source (a tag of its documents) and every part name (no tag)
def _concepts(spark, sf):
    a = table(spark, sf, "documents").select(F.col("source").alias("name"), F.lit(None).cast("string").alias("standard")).distinct()
    b = table(spark, sf, "part").select(F.col("p_type").alias("name"), F.lit("ISO").alias("standard")).distinct()
    return a.unionByName(b)


_CQ = """cq AS (SELECT DISTINCT source AS name, NULL AS standard, source AS tag, source || '  norma legal definicion' AS text FROM documents
 UNION ALL SELECT DISTINCT p_type, 'ISO', NULL, p_type || ' ISO norma legal definicion' FROM part)"""


@R.add("h7_find_backing", rf"""WITH {_POST}, {_CQ}, qk AS (SELECT name AS query_id, unnest(string_split_regex(lower(text), '{_TOK}')) AS term FROM cq), q AS (SELECT query_id, term, count(*) AS qtf FROM qk WHERE length(term) > 1 GROUP BY ALL),
bm AS (SELECT query_id, p.id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM q JOIN p USING (term) JOIN idf USING (term) JOIN dl ON dl.id = p.id, tot GROUP BY 1, 2),
dv AS ({_hv('documents', 'doc_id', 'text')}), qv AS ({_hv('cq', 'name', 'text')}),
hy AS (SELECT cq.name, d.doc_id AS id, d.source, d.text, coalesce(bm.bm25, 0) AS b, greatest(0, {_COS.format(a='qv.v', b='dv.v')}) AS c FROM cq JOIN qv ON qv.id = cq.name JOIN documents d ON cq.tag IS NULL OR d.source = cq.tag OR d.lang = cq.tag
  JOIN dv ON dv.id = d.doc_id LEFT JOIN bm ON bm.query_id = cq.name AND bm.id = d.doc_id),
hs AS (SELECT *, 0.4 * b / CASE WHEN max(b) OVER (PARTITION BY name) > 0 THEN max(b) OVER (PARTITION BY name) ELSE 1 END + 0.6 * c AS score FROM hy),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(score, 9) DESC, id) AS rank FROM hs), ok AS (SELECT * FROM r WHERE rank <= 3 AND score >= 0.65)
SELECT cq.name, cq.standard, CAST(rank AS INTEGER) AS rank, id, ok.source, round(score, 6) AS score, replace(substr(ok.text, 1, 200), chr(10), ' ') AS cite, id IS NOT NULL AS found FROM cq LEFT JOIN ok ON ok.name = cq.name""")
def h7(spark, sf):
    b = rt.find_backing(_corpus(spark, sf), _concepts(spark, sf), _vectorize)
    return b.select("name", "standard", "rank", "id", "source", r6(F.col("score")).alias("score"), "cite", "found")


_TFIDF = """pf AS (SELECT p.id, term, tf / dl AS tf FROM p JOIN dl ON dl.id = p.id), ql AS (SELECT query_id, sum(qtf) AS l FROM q GROUP BY 1),
qi AS (SELECT query_id, term, qtf / l AS qf, ln((n + 2) / (coalesce(df, 0) + 2.0)) + 1 AS w FROM q JOIN ql USING (query_id) LEFT JOIN idf USING (term), tot),
qn AS (SELECT query_id, sqrt(sum(qf * qf * w * w)) AS qn FROM qi GROUP BY 1),
b AS (SELECT id, term, tf, ln((n + 2) / (df + 1.0)) + 1 AS w0 FROM pf JOIN idf USING (term), tot), n0 AS (SELECT id, sum(tf * tf * w0 * w0) AS nn FROM b GROUP BY 1),
s AS (SELECT query_id, id, sum(qf * tf * w * w) AS dot, sum(tf * tf * (w * w - w0 * w0)) AS fix FROM qi JOIN b USING (term) GROUP BY 1, 2),
z AS (SELECT query_id, s.id, dot / (qn * sqrt(nn + fix)) AS score FROM s JOIN n0 ON n0.id = s.id JOIN qn USING (query_id))"""


@R.add("h8_tfidf_rank", f"""WITH {_POST}, {_QT}, {_TFIDF},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM z) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def h8(spark, sf):
    return rt.tfidf_rank(_docs(spark, sf), _queries(spark, sf), 10).withColumn("score", r6(F.col("score")))


@R.add("h9_corpus_stats", "SELECT count(*) AS total_chunks, count(DISTINCT source) AS total_sources FROM documents")
def h9(spark, sf):
    return rt.corpus_stats(_docs(spark, sf))


# the source of the best TF-IDF document is the expected one, BM25 is judged against it
@R.add("h10_retrieval_eval", f"""WITH {_BM}, {_TFIDF},
e AS (SELECT query_id, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM z) JOIN documents ON doc_id = id WHERE rank = 1),
t AS (SELECT query_id, rank, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id) AS rank FROM bm) JOIN documents ON doc_id = id WHERE rank <= 5),
h AS (SELECT e.query_id, min(t.rank) AS r FROM e LEFT JOIN t ON t.query_id = e.query_id AND t.source = e.source GROUP BY 1)
SELECT count(*) AS questions, round(avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / r, 0.0)), 6) AS mrr FROM h""")
def h10(spark, sf):
    d, q = _docs(spark, sf), _queries(spark, sf)
    src = d.select("id", "source")
    expected = rt.tfidf_rank(d, q, 1).join(src, "id").select("query_id", "source")
    found = rt.retrieval_eval(rt.bm25_search(d, q, 5).join(src, "id"), expected)
    return found.withColumns({c: r6(F.col(c)) for c in ("hit_rate", "mrr")})
