"""Queries: similarity of columns and texts, statistics, matching, clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from datasteward.functions import text as tx
from datasteward.functions.vectors import cosine_vec
from datasteward.operators import cluster, column_sets, matching, profile, similarity, stats
from datasteward.operators.cells import atomic_columns, cells_of, value_counts
from datasteward.plans.base import COLUMNS, DIRTY_SQL, Registry, dirty, q_cells, q_missing, q_num, q_strip, r6, table

R = Registry()
SIM = ["customer", "supplier", "part", "orders"]


def _tables(spark, sf, names):
    return {n: table(spark, sf, n) for n in names}


def _pairs(spark, tables):
    return similarity.column_pairs(spark, [(n, c) for n, df in tables.items() for c in atomic_columns(df)])


def _scores(spark, sf):
    t = _tables(spark, sf, SIM)
    return similarity.value_similarity(value_counts(cells_of(t), "upper"), _pairs(spark, t))


# value counts on upper-case keys, the list of column pairs in table order, and the scores
_COLS = ", ".join(f"({i}, '{t}', '{c.partition(':')[0]}')" for i, (t, c) in enumerate(
    (t, c) for t in SIM for c in COLUMNS[t].split()))
_VF = f"""{q_cells(*SIM)}, vf AS (SELECT source, "column", upper({q_strip('value')}) AS v, count(*) AS cnt FROM cells
  WHERE {q_strip('value')} <> '' GROUP BY ALL),
cols(i, s, c) AS (VALUES {_COLS}),
pr AS (SELECT a.s AS source_a, a.c AS column_a, b.s AS source_b, b.c AS column_b FROM cols a JOIN cols b ON a.i < b.i),
sz AS (SELECT source, "column", count(*) AS d, sum(cnt) AS n, sqrt(sum(CAST(cnt AS DOUBLE) * cnt)) AS nrm FROM vf GROUP BY ALL),
sh AS (SELECT a.source AS source_a, a."column" AS column_a, b.source AS source_b, b."column" AS column_b, count(*) AS shared,
  sum(CAST(a.cnt AS DOUBLE) * b.cnt) AS dot FROM vf a JOIN vf b ON a.v = b.v GROUP BY ALL),
sc AS (SELECT pr.*, coalesce(shared, 0) AS shared, coalesce(dot / (x.nrm * y.nrm), 0) AS cosine, coalesce(shared / (x.d + y.d - shared), 0) AS jaccard,
  coalesce(shared / least(x.d, y.d), 0) AS overlap, coalesce(shared / x.d, 0) AS containment
  FROM pr JOIN sz x ON x.source = source_a AND x."column" = column_a JOIN sz y ON y.source = source_b AND y."column" = column_b
  LEFT JOIN sh USING (source_a, column_a, source_b, column_b))"""
_P = "source_a, column_a, source_b, column_b"


def _sim_sql(col):
    return f"WITH {_VF} SELECT {_P}, round({col}, 6) AS {col} FROM sc"


def _sim(col):
    def run(spark, sf):
        return _scores(spark, sf).select(*similarity.PAIR, r6(F.col(col)).alias(col))
    return run


for _n, _c in (("e1_value_cosine", "cosine"), ("e2_value_jaccard", "jaccard"), ("e3_value_overlap", "overlap"),
               ("e7_containment", "containment")):
    R.add(_n, _sim_sql(_c))(_sim(_c))


@R.add("e4_text_tfidf", """
WITH p AS (SELECT a.conv_id, a.turn, a.text AS ta, b.text AS tb FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
t AS (SELECT conv_id, turn, unnest(string_split_regex(lower(ta), '[^\\p{L}\\p{N}_]+')) AS w, 1 AS a, 0 AS b FROM p
 UNION ALL SELECT conv_id, turn, unnest(string_split_regex(lower(tb), '[^\\p{L}\\p{N}_]+')), 0, 1 FROM p),
f AS (SELECT conv_id, turn, w, sum(a) AS a, sum(b) AS b FROM t WHERE length(w) > 1 GROUP BY ALL),
tot AS (SELECT conv_id, turn, sum(a) AS na, sum(b) AS nb FROM f GROUP BY ALL),
g AS (SELECT f.*, a / greatest(na, 1) * (ln(3.0 / ((a > 0)::INT + (b > 0)::INT + 1)) + 1) AS wa, b / greatest(nb, 1) * (ln(3.0 / ((a > 0)::INT + (b > 0)::INT + 1)) + 1) AS wb
  FROM f JOIN tot USING (conv_id, turn)),
s AS (SELECT conv_id, turn, sum(wa * wb) AS d, sqrt(sum(wa * wa)) AS na, sqrt(sum(wb * wb)) AS nb FROM g GROUP BY ALL)
SELECT p.conv_id, p.turn, round(coalesce(CASE WHEN na > 0 AND nb > 0 THEN d / (na * nb) END, 0), 6) AS tfidf FROM p LEFT JOIN s USING (conv_id, turn)""")
def e4(spark, sf):
    c = table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_b"))
    p = c.select("conv_id", "turn", F.col("text").alias("text_a")).join(nxt, ["conv_id", "turn"])
    return similarity.text_tfidf(p, ["conv_id", "turn"]).withColumn("tfidf", r6(F.col("tfidf")))


@R.add("e5_composite_similarity", f"""WITH {_VF},
t AS (SELECT i, unnest(string_split(replace(c, '_', ' '), ' ')) AS w FROM cols), tk AS (SELECT i, w, count(*) AS n FROM t WHERE length(w) > 1 GROUP BY ALL),
u AS (SELECT a.i AS i, b.i AS j, coalesce(x.w, y.w) AS w, coalesce(x.n, 0) AS na, coalesce(y.n, 0) AS nb FROM cols a JOIN cols b ON a.i < b.i
  JOIN (SELECT DISTINCT w FROM tk) ws ON true LEFT JOIN tk x ON x.i = a.i AND x.w = ws.w LEFT JOIN tk y ON y.i = b.i AND y.w = ws.w WHERE x.w IS NOT NULL OR y.w IS NOT NULL),
uw AS (SELECT i, j, na * CASE WHEN na > 0 AND nb > 0 THEN 1 ELSE ln(1.5) + 1 END AS wa, nb * CASE WHEN na > 0 AND nb > 0 THEN 1 ELSE ln(1.5) + 1 END AS wb FROM u),
tf AS (SELECT i, j, sum(wa * wb) / (sqrt(sum(wa * wa)) * sqrt(sum(wb * wb))) AS tfidf FROM uw GROUP BY ALL),
z AS (SELECT sc.*, coalesce(tfidf, 0) AS tfidf, (cosine + jaccard + overlap) / 3 * 0.7 + coalesce(tfidf, 0) * 0.3 AS composite
 FROM sc JOIN cols a ON a.s = source_a AND a.c = column_a JOIN cols b ON b.s = source_b AND b.c = column_b LEFT JOIN tf ON tf.i = a.i AND tf.j = b.i)
SELECT {_P}, round(cosine, 6) AS cosine, round(jaccard, 6) AS jaccard, round(overlap, 6) AS overlap, round(tfidf, 6) AS tfidf, round(composite, 6) AS composite,
 CASE WHEN composite >= 0.7 THEN 'high' WHEN composite >= 0.4 THEN 'medium' ELSE 'low' END AS verdict FROM z""")
def e5(spark, sf):
    t = _tables(spark, sf, SIM)
    names = _pairs(spark, t).select(*similarity.PAIR, F.replace("column_a", F.lit("_"), F.lit(" ")).alias("text_a"),
                                    F.replace("column_b", F.lit("_"), F.lit(" ")).alias("text_b"))
    tf = similarity.text_tfidf(names, similarity.PAIR)
    c = similarity.composite_similarity(_scores(spark, sf), tf)
    return c.withColumns({x: r6(F.col(x)) for x in ("cosine", "jaccard", "overlap", "tfidf", "composite")})


_MOM = f"""mm AS (SELECT source, "column", count(*) AS rws, count(x) AS k, avg(x) AS mu, var_samp(x) AS va FROM (SELECT *, {q_num('value')} AS x FROM cells) GROUP BY ALL)"""


def _dist_sql(tables):
    """Every pair of columns of two tables: Welch or chi-square statistic."""
    a, b = tables
    return f"""{q_cells(a, b)}, vf AS (SELECT source, "column", upper({q_strip('value')}) AS v, count(*) AS cnt FROM cells WHERE {q_strip('value')} <> '' GROUP BY ALL),
{_MOM}, sz AS (SELECT source, "column", count(*) AS d, sum(cnt) AS n, sqrt(sum(CAST(cnt AS DOUBLE) * cnt)) AS nrm FROM vf GROUP BY ALL),
pr AS (SELECT x.source AS source_a, x."column" AS column_a, y.source AS source_b, y."column" AS column_b, x.n AS na, y.n AS nb, x.d AS da, y.d AS db, x.nrm AS ra, y.nrm AS rb
  FROM sz x JOIN sz y ON x.source = '{a}' AND y.source = '{b}'),
un AS (SELECT source_a, column_a, source_b, column_b, na, nb, v.v, coalesce(f.cnt, 0) AS ca, coalesce(g.cnt, 0) AS cb FROM pr
  JOIN (SELECT DISTINCT source, "column", v FROM vf) v ON (v.source = source_a AND v."column" = column_a) OR (v.source = source_b AND v."column" = column_b)
  LEFT JOIN vf f ON f.source = source_a AND f."column" = column_a AND f.v = v.v LEFT JOIN vf g ON g.source = source_b AND g."column" = column_b AND g.v = v.v),
ud AS (SELECT DISTINCT * FROM un),
ch AS (SELECT source_a, column_a, source_b, column_b, count(*) AS cats, count(*) FILTER (ca > 0 AND cb > 0) AS shared, sum(CAST(ca AS DOUBLE) * cb) AS dot,
  sum((ca - (ca + cb) * na / (na + nb)) ** 2 / ((ca + cb) * na / (na + nb)) + (cb - (ca + cb) * nb / (na + nb)) ** 2 / ((ca + cb) * nb / (na + nb))) AS chi2 FROM ud GROUP BY ALL),
ts AS (SELECT pr.*, cats, shared, dot / (ra * rb) AS cosine, shared / cats AS jaccard, CASE WHEN cats >= 2 THEN chi2 ELSE 0 END AS chi2,
  CASE WHEN x.k > 0.8 * x.rws AND y.k > 0.8 * y.rws AND x.k >= 3 AND y.k >= 3 THEN 'welch' ELSE 'chi_square' END AS test,
  CASE WHEN x.va / x.k + y.va / y.k > 0 THEN (x.mu - y.mu) / sqrt(x.va / x.k + y.va / y.k) ELSE 0 END AS t,
  floor((x.va / x.k + y.va / y.k) ** 2 / ((x.va / x.k) ** 2 / (x.k - 1) + (y.va / y.k) ** 2 / (y.k - 1))) AS df
  FROM pr JOIN ch USING (source_a, column_a, source_b, column_b) JOIN mm x ON x.source = source_a AND x."column" = column_a JOIN mm y ON y.source = source_b AND y."column" = column_b)"""


@R.add("d5_compare_distributions", f"""WITH {_dist_sql(('customer', 'supplier'))}
SELECT {_P}, test, CASE WHEN test = 'welch' THEN round(t, 6) END AS t_stat, CASE WHEN test = 'welch' THEN CAST(df AS BIGINT) END AS t_df,
 CASE WHEN test = 'chi_square' THEN round(chi2, 4) END AS chi2, CASE WHEN test = 'chi_square' THEN CASE WHEN cats >= 2 THEN cats - 1 ELSE 0 END END AS chi_df FROM ts""")
def d5(spark, sf):
    t = _tables(spark, sf, ["customer", "supplier"])
    pairs = similarity.column_pairs(spark, [("customer", c) for c in t["customer"].columns],
                                    [("supplier", c) for c in t["supplier"].columns])
    d = matching.compare_distributions(value_counts(cells_of(t)), pairs)
    w = F.col("test") == "welch"
    return d.select(*similarity.PAIR, "test", F.when(w, r6(F.col("t_stat"))).alias("t_stat"),
                    F.when(w, F.col("t_df").cast("long")).alias("t_df"), F.when(~w, F.round("chi2", 4)).alias("chi2"),
                    F.when(~w, F.col("chi_df").cast("long")).alias("chi_df"))


# significance in SQL: |t| and the cube-root score of chi-square against their 5 % limits
@R.add("e6_auto_match", f"""WITH {_dist_sql(('customer', 'supplier'))},
g AS (SELECT *, CASE WHEN test = 'welch' THEN CASE WHEN abs(t) > 1.97 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - abs(t) / 10)) END
  WHEN cats < 2 OR ((chi2 / (cats - 1)) ** (1.0 / 3) - (1 - 2.0 / (9 * (cats - 1)))) / sqrt(2.0 / (9 * (cats - 1))) <= 1.6448536 THEN 0.7 ELSE 0.0 END AS stat FROM ts),
h AS (SELECT *, cosine * 0.4 + jaccard * 0.3 + stat * 0.3 AS conf FROM g)
SELECT {_P}, round(cosine, 6) AS cosine, round(jaccard, 6) AS jaccard, round(CAST(stat AS DOUBLE), 6) AS stat_score, round(conf, 6) AS confidence,
 CASE WHEN conf >= 0.7 THEN 'high' WHEN conf >= 0.4 THEN 'medium' ELSE 'low' END AS bucket FROM h""")
def e6(spark, sf):
    m = matching.auto_match(table(spark, sf, "customer"), "customer", table(spark, sf, "supplier"), "supplier")
    return m.withColumns({c: r6(F.col(c)) for c in ("cosine", "jaccard", "stat_score", "confidence")})


@R.add("e18_value_equivalence", f"""WITH {DIRTY_SQL},
a AS (SELECT upper({q_strip('dirty_name')}) AS key, min({q_strip('dirty_name')}) AS value_a FROM dirty WHERE NOT {q_missing('dirty_name')} GROUP BY 1),
b AS (SELECT upper(p_name) AS key, min(p_name) AS value_b FROM part GROUP BY 1)
SELECT key, value_a, value_b, CASE WHEN value_a IS NULL THEN 'only_b' WHEN value_b IS NULL THEN 'only_a' ELSE 'matched' END AS status FROM a FULL JOIN b USING (key)""")
def e18(spark, sf):
    return similarity.value_equivalence(dirty(spark, sf).select(F.col("dirty_name").alias("value")),
                                        table(spark, sf, "part").select(F.col("p_name").alias("value")))


@R.add("e18_composite_equivalence", """
WITH a AS (SELECT DISTINCT upper(o_orderstatus || '|' || o_orderpriority) AS key, o_orderstatus || '|' || o_orderpriority AS value_a FROM orders),
b AS (SELECT DISTINCT upper(l_linestatus || '|' || '1-URGENT') AS key, l_linestatus || '|' || '1-URGENT' AS value_b FROM lineitem)
SELECT key, value_a, value_b, CASE WHEN value_a IS NULL THEN 'only_b' WHEN value_b IS NULL THEN 'only_a' ELSE 'matched' END AS status FROM a FULL JOIN b USING (key)""")
def e18b(spark, sf):
    a = table(spark, sf, "orders").select(tx.composite_key(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("value"))
    b = table(spark, sf, "lineitem").select(tx.composite_key(F.col("l_linestatus"), F.lit("1-URGENT")).alias("value"))
    return similarity.value_equivalence(a, b)


@R.add("e18_equivalence_edges", f"""WITH {DIRTY_SQL},
a AS (SELECT upper({q_strip('dirty_name')}) AS key, min({q_strip('dirty_name')}) AS va FROM dirty WHERE NOT {q_missing('dirty_name')} GROUP BY 1),
b AS (SELECT upper(p_name) AS key, min(p_name) AS vb FROM part GROUP BY 1)
SELECT 'field:dirty.dirty_name' AS src, 'field:part.p_name' AS dst, 'equivalente_a' AS type, va AS value_src, vb AS value_dst, 1.0::DOUBLE AS confidence FROM a JOIN b USING (key)""")
def e18c(spark, sf):
    return similarity.equivalence_edges(e18(spark, sf), "field:dirty.dirty_name", "field:part.p_name")


# --- a catalog asked by a threshold or by the nearest columns -------------------------------

WIDE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "conversations"]
# scores of all ordered pairs that share a value, by a plain self-join
_NEAR = f"""{q_cells(*WIDE)}, vf AS (SELECT source, "column", upper({q_strip('value')}) AS v, count(*) AS cnt FROM cells WHERE {q_strip('value')} <> '' GROUP BY ALL),
sz AS (SELECT source, "column", count(*) AS d, sqrt(sum(CAST(cnt AS DOUBLE) * cnt)) AS nrm FROM vf GROUP BY ALL),
sh AS (SELECT a.source AS source_a, a."column" AS column_a, b.source AS source_b, b."column" AS column_b, count(*) AS shared,
  sum(CAST(a.cnt AS DOUBLE) * b.cnt) AS dot FROM vf a JOIN vf b ON a.v = b.v AND (a.source, a."column") <> (b.source, b."column") GROUP BY ALL),
sc AS (SELECT sh.*, dot / (x.nrm * y.nrm) AS cosine, shared / (x.d + y.d - shared) AS jaccard, shared / least(x.d, y.d) AS overlap, shared / x.d AS containment
  FROM sh JOIN sz x ON x.source = source_a AND x."column" = column_a JOIN sz y ON y.source = source_b AND y."column" = column_b)"""


def _wide(spark, sf):
    return value_counts(cells_of(_tables(spark, sf, WIDE)), "upper")


def _above(measure, least):
    def run(spark, sf):
        return column_sets.similar_columns(_wide(spark, sf), least, measure).select(
            *similarity.PAIR, "shared", r6(F.col("score")).alias("score"))
    return run


for _n, _c, _t in (("e1_cosine_columns", "cosine", 0.6), ("e2_similar_columns", "jaccard", 0.5),
                   ("e3_overlapping_columns", "overlap", 0.8), ("e7_contained_columns", "containment", 0.9)):
    _once = "" if _c == "containment" else " AND (source_a, column_a) < (source_b, column_b)"
    R.add(_n, f"WITH {_NEAR} SELECT {_P}, shared, round({_c}, 6) AS score FROM sc WHERE {_c} >= {_t}{_once}")(_above(_c, _t))


@R.add("e1_nearest_columns", f"""WITH {_NEAR}, rk AS (SELECT *, row_number() OVER (PARTITION BY source_a, column_a ORDER BY round(cosine, 9) DESC, source_b, column_b) AS "rank" FROM sc)
SELECT source_a AS source, column_a AS "column", CAST("rank" AS INTEGER) AS "rank", source_b, column_b, round(cosine, 6) AS score FROM rk WHERE "rank" <= 3""")
def e1_nearest(spark, sf):
    return column_sets.nearest_columns(_wide(spark, sf), 3).withColumn("score", r6(F.col("score")))


# --- statistics ---------------------------------------------------------------------------

_STATUS = [("F", "O"), ("F", "P"), ("O", "P")]


@R.add("d1_welch_t", """
WITH m AS (SELECT o_orderstatus AS g, count(*) AS n, avg(o_totalprice) AS mu, var_samp(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT a.g AS group_a, b.g AS group_b, a.n AS n_a, b.n AS n_b, round(a.mu, 4) AS mean_a, round(b.mu, 4) AS mean_b, round(sqrt(a.v), 4) AS std_a, round(sqrt(b.v), 4) AS std_b,
 round((a.mu - b.mu) / sqrt(a.v / a.n + b.v / b.n), 6) AS t_stat,
 CAST(floor((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1))) AS BIGINT) AS t_df FROM m a JOIN m b ON a.g < b.g""")
def d1(spark, sf):
    w = stats.welch_t(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus", _STATUS)
    return w.select("group_a", "group_b", "n_a", "n_b", *[F.round(c, 4).alias(c) for c in ("mean_a", "mean_b", "std_a", "std_b")],
                    r6(F.col("t_stat")).alias("t_stat"), F.col("t_df").cast("long").alias("t_df"))


@R.add("d2_chi_square", """
WITH a AS (SELECT upper(p_name) AS v, count(*) AS c FROM part GROUP BY 1), b AS (SELECT upper(p_type) AS v, count(*) AS c FROM part GROUP BY 1),
u AS (SELECT coalesce(a.c, 0) AS ca, coalesce(b.c, 0) AS cb FROM a FULL JOIN b USING (v)), t AS (SELECT sum(ca) AS na, sum(cb) AS nb FROM u)
SELECT 'p_name' AS column_a, 'p_type' AS column_b, round(sum((ca - (ca + cb) * na / (na + nb)) ** 2 / ((ca + cb) * na / (na + nb))
 + (cb - (ca + cb) * nb / (na + nb)) ** 2 / ((ca + cb) * nb / (na + nb))), 4) AS chi2, count(*) - 1 AS chi_df FROM u, t""")
def d2(spark, sf):
    vf = value_counts(cells_of({"part": table(spark, sf, "part")}, {"part": ["p_name", "p_type"]}), "upper")
    pairs = similarity.column_pairs(spark, [("part", "p_name"), ("part", "p_type")])
    s = stats.with_chi_test(similarity.value_similarity(vf, pairs))
    return s.select("column_a", "column_b", F.round("chi2", 4).alias("chi2"), F.col("chi_df").cast("long").alias("chi_df"))


_VERDICT = "CASE WHEN abs(r) >= 0.7 THEN 'correlacion fuerte' WHEN abs(r) >= 0.4 THEN 'correlacion moderada' ELSE 'correlacion debil' END AS verdict"


@R.add("d3_pearson", f"""WITH c AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT 'l_quantity' AS column_a, 'l_extendedprice' AS column_b, n, round(r, 6) AS r, {_VERDICT} FROM c""")
def d3(spark, sf):
    return stats.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").withColumn("r", r6(F.col("r")))


@R.add("d4_spearman", f"""WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x,
 rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem),
c AS (SELECT count(*) AS n, corr(x, y) AS r FROM k)
SELECT 'l_quantity' AS column_a, 'l_extendedprice' AS column_b, n, round(r, 6) AS r, {_VERDICT} FROM c""")
def d4(spark, sf):
    return stats.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").withColumn("r", r6(F.col("r")))


_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) AS n, corr({a}, {b}) AS r FROM k"
                           for i, a in enumerate(_NUM) for b in _NUM[i + 1:])
_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _NUM)


@R.add("d6_correlation_matrix", f"WITH k AS (SELECT * FROM lineitem) SELECT column_a, column_b, n, round(r, 6) AS r, {_VERDICT} FROM ({_CORR})")
def d6(spark, sf):
    return stats.correlation_matrix(table(spark, sf, "lineitem")).withColumn("r", r6(F.col("r")))


@R.add("d6_spearman_matrix", f"WITH k AS MATERIALIZED (SELECT {_RANKS} FROM lineitem) SELECT column_a, column_b, n, round(r, 6) AS r, {_VERDICT} FROM ({_CORR})")
def d6_ranks(spark, sf):
    return stats.correlation_matrix(table(spark, sf, "lineitem"), method="spearman").withColumn("r", r6(F.col("r")))


# --- clustering ---------------------------------------------------------------------------

def _points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


@R.add("b11_cosine_vec", """
SELECT a.vec_id, round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def b11(spark, sf):
    e = table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", r6(cosine_vec(F.col("embedding"), F.col("other"))).alias("cosine"))


@R.add("d7_kmeans")
def d7(spark, sf):
    return cluster.kmeans(_points(spark, sf), 4)


@R.add("d8_cluster_columns")
def d8(spark, sf):
    f = profile.column_features(cells_of(_tables(spark, sf, ["customer", "orders", "part", "supplier"])))
    return cluster.cluster_columns(f, 3).withColumn("members", F.array_join("members", ","))


@R.add("d9_optimal_k")
def d9(spark, sf):
    return cluster.optimal_k(_points(spark, sf), 5)
