"""Distributed algorithms against brute force and against properties they must keep."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from datasteward.functions.vectors import cosine_vec
from datasteward.operators import cluster, harmonize, health, lifecycle, memory, ranks, retrieval, semantic, stats, vector_index
from datasteward.operators import catalog as cat
from datasteward.operators import validate as vd


@pytest.mark.parametrize("parts", [1, 13])
def test_quantiles_and_ranks(spark, parts):
    rng = random.Random(1)
    data = {"a": [rng.choice([1.0, 2.0, 2.0, 5.0]) for _ in range(300)], "b": [rng.gauss(0, 1e6) for _ in range(501)], "c": [7.0]}
    rows = [(k, x) for k, xs in data.items() for x in xs]
    v = spark.createDataFrame(rows, "k string, x double").groupBy("k", "x").agg(F.count(F.lit(1)).alias("cnt"))
    q = {r["k"]: r for r in ranks.quantiles(v, ["k"], {"p10": 0.1, "p50": 0.5, "p99": 0.99}, parts=parts).collect()}
    for k, xs in data.items():
        for name, p in (("p10", 10), ("p50", 50), ("p99", 99)):
            assert q[k][name] == pytest.approx(np.percentile(xs, p))
    got = {(r["k"], r["x"]): r["avg_rank"] for r in ranks.rank_values(v, ["k"], parts=parts).collect()}
    for k, xs in data.items():
        s = sorted(xs)
        for x in set(xs):
            assert got[(k, x)] == pytest.approx(np.mean([i + 1 for i, y in enumerate(s) if y == x]))


def test_kmeans(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(c, 0.3, (40, 3)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id int, features array<double>").repartition(5)
    m = cluster.fit(df, 3)
    assert all(a >= b - 1e-9 for a, b in zip(m["trace"], m["trace"][1:]))
    got = {r["id"]: r["cluster"] for r in cluster.assign(df, m).collect()}
    d = ((pts[:, None, :] - m["centroids"][None]) ** 2).sum(axis=2)
    assert all(d[i].argmin() == c for i, c in got.items())
    for c in range(3):
        assert np.allclose(m["centroids"][c], pts[[i for i, g in got.items() if g == c]].mean(axis=0))


def _chunks(spark, docs, size, overlap):
    got = {}
    df = spark.createDataFrame(docs, "source string, text string")
    for r in retrieval.ingest(df, size=size, overlap=overlap).orderBy("source", "chunk_index").collect():
        got.setdefault(r["source"], []).append(r["text"])
    return got


def test_chunk_examples(spark):
    a, b, s, t = "a" * 40, "b" * 35, "s" * 32, "t" * 31
    tail = "a" * 10 + "\n\n" + b
    docs = [("packed", f"{a}\n\n\n\n {b} "),        # does not fit: the new chunk starts with the tail of the old one
            ("together", f"{'x' * 20}\n\n{b}"),       # fits into one chunk
            ("long", f"{a}\n\n{s}. {t}\n\n{b}"),     # a long paragraph is cut at sentences, without a tail
            ("sentences", f"{s}. {'u' * 10}. {t}"),
            ("short", "z" * 49)]
    got = _chunks(spark, docs, 60, 10)
    assert got == {"packed": [a, tail], "together": ["x" * 20 + "\n\n" + b], "long": [a, s, t, b],
                   "sentences": [s + ". " + "u" * 10, t]}


def test_chunk_properties(spark):
    rng = random.Random(5)
    docs = []
    for i in range(60):
        paras = [". ".join(" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 20))) + str(rng.random()) for _ in range(rng.randint(1, 12)))
                 for _ in range(rng.randint(1, 8))]
        docs.append((str(i), "\n\n".join(paras)))
    got = _chunks(spark, docs, 200, 30)
    for name, text in docs:
        chunks = got[name]
        assert all(len(c) > 30 and c == c.strip() for c in chunks)
        sentences = [p for para in text.split("\n\n") for p in ([para] if len(para) <= 200 else para.split(". "))]
        at = 0
        for s in (x.strip() for x in sentences):
            if len(s) > 30:  # every piece is in one chunk, and the chunks keep the order
                at = next(i for i in range(at, len(chunks)) if s in chunks[i])
        assert all(len(c) <= 2 * 200 + 30 + 2 or ". " not in c for c in chunks)


def _edges(spark, pairs):
    ids = sorted({x for p in pairs for x in p}) + ["z"]
    nodes = cat.conform(spark.createDataFrame([(i, "concept" if i < "m" else "field") for i in ids], "id string, type string"), cat.NODE_COLUMNS)
    edges = cat.conform(spark.createDataFrame([(a, b, "implementa") for a, b in pairs], "src string, dst string, type string"), cat.EDGE_COLUMNS)
    return nodes, edges


def test_components_of_long_chains(spark):
    pairs = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [("a", "b"), ("b", "d")] + [("hub", f"x{i}") for i in range(40)]
    nodes, edges = _edges(spark, pairs)
    got = {r["id"]: r["component"] for r in health.connected_components(nodes, edges).collect()}
    assert all(got[f"c{i:03d}"] == "c000" for i in range(71))
    assert got["a"] == got["b"] == got["d"] == "a" and got["z"] == "z"
    assert all(got[f"x{i}"] == "hub" for i in range(40))


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_components_in_one_task_and_in_rounds(spark, one_task):
    """Chains in any order of names, a hub, repeated and null ids; the rounds keep few tables, whatever the order."""
    rng = random.Random(5)
    names = [f"n{i:03d}" for i in rng.sample(range(300), 300)]
    pairs = list(zip(names[:200], names[1:200])) + [("hub", x) for x in names[210:260]] + [("hub", "hub"), ("a", "not a node")]
    nodes, edges = _edges(spark, pairs)
    nodes = nodes.filter("id <> 'not a node'").unionByName(nodes.filter("id in ('hub', 'z')"))
    nodes = nodes.unionByName(nodes.filter("id = 'z'").limit(1).withColumn("id", F.lit(None).cast("string")))
    edges = edges.unionByName(edges.limit(1).withColumn("dst", F.lit(None).cast("string")))
    got = [(r["id"], r["component"]) for r in health.connected_components(nodes, edges, one_task).collect()]
    want = {x: min(names[:200]) for x in names[:200]} | {x: "hub" for x in ["hub", *names[210:260]]} | {"a": "a", "z": "z", None: None}
    assert sorted(got, key=str) == sorted([*want.items(), ("hub", "hub"), ("z", "z")], key=str)


def test_communities_stay_inside_components(spark):
    pairs = [(a, b) for g in ("a", "b") for i in range(6) for j in range(i) for a, b in [(f"{g}{i}", f"{g}{j}")]] + [("a0", "b0")]
    nodes, edges = _edges(spark, pairs)
    c = {r["id"]: r["community"] for r in health.communities(nodes, edges).collect()}
    assert len({c[f"a{i}"] for i in range(6)}) == 1 and len({c[f"b{i}"] for i in range(6)}) == 1
    again = {r["id"]: r["community"] for r in health.communities(nodes.repartition(3), edges.repartition(7)).collect()}
    assert c == again
    sizes = health.community_sizes(health.communities(nodes, edges), nodes).collect()
    assert sum(r["size"] for r in sizes) == 12
    lines = health.community_context(health.communities(nodes, edges), nodes, edges).collect()
    assert len(lines) == 12 and all(r["line"].startswith("- [concept]") for r in lines)


def _modularity(pairs, community):
    links = {frozenset(p) for p in pairs if p[0] != p[1]}
    degree, m = {}, len(links)
    for a, b in (tuple(x) for x in links):
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    inside = sum(len({community[x] for x in p}) == 1 for p in links) / m
    return inside - sum((sum(d for x, d in degree.items() if community[x] == c) / (2 * m)) ** 2 for c in set(community.values()))


def test_communities_have_high_modularity(spark):
    rng = random.Random(8)
    block = {f"n{i:02d}": i // 12 for i in range(48)}
    pairs = [(a, b) for a in block for b in block if a < b and rng.random() < (0.6 if block[a] == block[b] else 0.03)]
    nodes, edges = _edges(spark, pairs)
    got = {r["id"]: r["community"] for r in health.communities(nodes, edges).collect()}
    assert _modularity(pairs, got) >= _modularity(pairs, {x: str(block[x]) for x in got}) - 0.02
    assert all(c == min(x for x in got if got[x] == c) for c in set(got.values()))
    fine = {r["community"] for r in health.communities(nodes, edges, resolution=6.0).collect()}
    assert len(fine) > len(set(got.values()))
    star = [("hub", f"x{i}") for i in range(30)]
    assert {r["community"] for r in health.communities(*_edges(spark, star)).collect()} == {"hub"}
    assert health.communities(*_edges(spark, [("a", "a")])).count() == 0


def test_communities_of_many_small_parts(spark):
    """A late chain is settled however large the rest of the graph is: no move of one node gains in the end."""
    rest = [(f"p{i:05d}", f"q{i:05d}") for i in range(12000)]
    chain = [(f"a{i:02d}", f"a{i + 1:02d}") for i in range(12)]
    pairs = rest + chain
    found = {r["id"]: r["community"] for r in health.communities(*_edges(spark, pairs)).collect()}
    assert all(found[a] == found[b] == a for a, b in rest)
    # a pair of this graph has so small a share of the edges that every link of the chain is worth joining
    assert {found[x] for p in chain for x in p} == {"a00"}


@pytest.mark.parametrize("one_task", [1 << 20, 60])
def test_no_move_gains(spark, one_task):
    """In one task, and in rounds of simultaneous moves until one task takes over."""
    rng = random.Random(3)
    pairs = [(f"n{a:03d}", f"n{b:03d}") for a in range(90) for b in range(a) if rng.random() < (0.5 if a // 9 == b // 9 else 0.01)]
    found = {r["id"]: r["community"] for r in health.communities(*_edges(spark, pairs), one_task=one_task).collect()}
    assert all(c == min(x for x in found if found[x] == c) for c in set(found.values()))
    assert _modularity(pairs, found) >= _modularity(pairs, {x: str(int(x[1:]) // 9) for x in found}) - 0.03
    if one_task > 60:  # the first level's nodes may gain again once communities have merged, single moves see to that
        now = _modularity(pairs, found)
        for x in found:
            for c in {found[y] for p in pairs if x in p for y in p}:
                assert _modularity(pairs, {**found, x: c}) <= now + 1e-12


def test_communities_do_not_depend_on_the_order_of_rows(spark):
    """Neither in one task nor in rounds, whatever the partitions and the order of the links."""
    rng = random.Random(11)
    pairs = [(f"n{a:03d}", f"n{b:03d}") for a in range(80) for b in range(a) if rng.random() < (0.3 if a // 8 == b // 8 else 0.02)]
    for one_task in (1 << 20, 40):
        found = set()
        for parts in (1, 3):
            nodes, edges = _edges(spark, pairs)
            edges = edges.repartition(parts, F.rand(parts))
            found.add(tuple(sorted(map(tuple, health.communities(nodes.repartition(parts, F.rand(parts)), edges, one_task=one_task).collect()))))
        assert len(found) == 1


def test_rounds_of_communities_are_few(spark, monkeypatch):
    """Simultaneous moves end when they add little, and reach the modularity of single moves all but for little."""
    looks, moves = [], health._moves
    monkeypatch.setattr(health, "_moves", lambda *a: (looks.append(1), moves(*a))[1])
    rng = random.Random(6)
    pairs = [(f"c{i:02d}", f"x{i:02d}_{j}") for i in range(40) for j in range(8)]
    pairs += [(f"x{rng.randrange(40):02d}_{rng.randrange(8)}", f"x{rng.randrange(40):02d}_{rng.randrange(8)}") for _ in range(160)]
    alone = {r["id"]: r["community"] for r in health.communities(*_edges(spark, pairs)).collect()}
    assert not looks
    found = {r["id"]: r["community"] for r in health.communities(*_edges(spark, pairs), one_task=100).collect()}
    assert 0 < len(looks) <= 40 and set(found) == set(alone)
    assert _modularity(pairs, found) >= _modularity(pairs, alone) - 0.02


def test_context_lists_ends_of_repeated_nodes_once(spark):
    """Both directions, repeated ids, names that are null, and links to another community or to no member."""
    nodes = cat.conform(spark.createDataFrame([("a", "concept", "A"), ("b", "field", "B"), ("b", "field", "B"), ("c", "field", None), ("d", "field", "D"), ("s", "source", "S")],
                                              "id string, type string, name string"), cat.NODE_COLUMNS)
    edges = cat.conform(spark.createDataFrame([("b", "a", "implementa"), ("c", "a", "implementa"), ("b", "c", "equivalente_a"), ("d", "a", "implementa"), ("b", "s", "proviene_de")],
                                              "src string, dst string, type string"), cat.EDGE_COLUMNS)
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")], "id string, community string")
    got = sorted(tuple(r) for r in health.community_context(members, nodes, edges).collect())
    b = ("a", "b", "- [field] B | conexiones: implementa->A")
    assert got == [("a", "a", "- [concept] A | conexiones: B->implementa"), b, b, ("a", "c", "- [field] c | conexiones: B->equivalente_a, implementa->A"), ("d", "d", "- [field] D")]


def test_orphans_are_looked_for_once_and_not_broadcast(spark, monkeypatch):
    calls, orphans = [], health.orphans
    monkeypatch.setattr(health, "orphans", lambda n, e: (calls.append(orphans(n, e)), calls[-1])[1])
    nodes = cat.conform(spark.createDataFrame([("concept:1", "concept", "red bolt"), ("f1", "field", "red_bolt_old"), ("f2", "field", "x"), ("f3", "field", "y"), ("k", "classifier", "K"),
                                               ("s", "source", "S")], "id string, type string, name string"), cat.NODE_COLUMNS)
    edges = cat.conform(spark.createDataFrame([("f3", "s", "proviene_de")], "src string, dst string, type string"), cat.EDGE_COLUMNS)
    got = {r["id"]: (r["type"], r["suggested_concept"], r["action"]) for r in health.orphan_actions(nodes, edges).collect()}
    assert got == {"f1": ("field", "concept:1", "link_implementa"), "f2": ("field", None, "manual"), "concept:1": ("concept", None, "manual"), "k": ("classifier", None, "manual")}
    assert len(calls) == 1 and "Broadcast" not in calls[0]._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_matrix(spark, method):
    """Against pandas, with values missing here and there, ties, a constant column, an empty one, and more than a block."""
    rng = np.random.default_rng(6)
    a = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 7)) + 1e6
    a[:, 2] = np.round(a[:, 2])
    a[:, 5], a[:, 6] = 7.1, np.nan
    a[rng.random(200) < 0.2, 1] = np.nan
    a[rng.random(200) < 0.1, 3] = np.inf
    names = [f"c{k}" for k in range(7)]
    df = spark.createDataFrame([[float(x) for x in row] for row in a], names)
    got = {(r["column_a"], r["column_b"]): r for r in stats.correlation_matrix(df, method=method).collect()}
    assert list(stats.numeric_columns(df)) == names and len(got) == 21
    clean = pd.DataFrame(np.where(np.isfinite(a), a, np.nan), columns=names)
    want = clean.corr(method=method)
    for (x, y), r in got.items():
        assert r["n"] == clean[[x, y]].dropna().shape[0]
        if "c5" in (x, y) or "c6" in (x, y):
            assert r["r"] == 0 and r["verdict"] == (stats.TOO_FEW if "c6" in (x, y) else stats.NO_VARIANCE)
        else:
            assert abs(r["r"] - want.loc[x, y]) < 1e-9


def test_correlations_of_many_columns(spark):
    wide = spark.createDataFrame([[float((k * k + i * 7) % 11) for k in range(300)] for i in range(20)], [f"c{k}" for k in range(300)])
    got = stats.correlation_matrix(wide)
    assert got.count() == 300 * 299 // 2
    x = np.array(wide.collect())
    r = got.filter("column_a = 'c3' and column_b = 'c290'").first()
    assert abs(r["r"] - np.corrcoef(x[:, 3], x[:, 290])[0, 1]) < 1e-9


def test_vector_search(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 8))
    v[50] = v[10]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id int, embedding array<double>").repartition(6)
    q = df.filter("id % 20 = 10").select(F.col("id").alias("query_id"), "embedding")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for block in (2000, 3):  # one block of queries, and several
        monkeypatch.setattr(vector_index, "QUERIES", block)
        got = {}
        for r in retrieval.vector_search(df, q, 4).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
        for k, hits in got.items():
            expect = sorted(range(200), key=lambda i: (-round(float(u[k] @ u[i]), 9), i))[:4]
            assert [i for _, i in sorted(hits)] == expect
        assert len(got) == 10


def test_hybrid_uses_tags(spark):
    rows = [("a", "s1", "ley general de salud", [1.0, 0.0], ["salud"]), ("b", "s2", "ley de aguas", [0.0, 1.0], ["agua"]), ("c", "s3", "otro texto", [1.0, 1.0], [])]
    corpus = spark.createDataFrame(rows, "id string, source string, text string, embedding array<double>, tags array<string>")
    q = spark.createDataFrame([("q1", "ley salud", [1.0, 0.0], None), ("q2", "ley salud", [1.0, 0.0], "agua")], "query_id string, text string, embedding array<double>, tag string")
    got = [(r["query_id"], r["id"]) for r in retrieval.hybrid_search(corpus, q, 2).orderBy("query_id", "rank").collect()]
    assert got == [("q1", "a"), ("q1", "c"), ("q2", "b")]


def test_tfidf_rank_against_definition(spark):
    docs = ["sexo del paciente", "edad en anos", "sexo y genero sexo", "precio"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "id int, text string")
    q = spark.createDataFrame([("q", "sexo paciente nuevo")], "query_id string, text string")
    got = {r["id"]: r["score"] for r in retrieval.tfidf_rank(d, q, None).collect()}
    tok = [[w for w in t.split() if len(w) > 1] for t in ["sexo paciente nuevo", *docs]]
    df = {w: sum(w in t for t in tok) for t in tok for w in t}
    vec = [{w: t.count(w) / len(t) * (np.log((len(tok) + 1) / (df[w] + 1)) + 1) for w in t} for t in tok]
    for i, t in enumerate(vec[1:]):
        dot = sum(vec[0].get(w, 0) * x for w, x in t.items())
        s = dot / np.sqrt(sum(x * x for x in vec[0].values())) / np.sqrt(sum(x * x for x in t.values()))
        assert got.get(i, 0.0) == pytest.approx(s)


def test_cosine_of_bad_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0]), ([0.0], [1.0]), ([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(F.round(cosine_vec(F.col("a"), F.col("b")), 9)).collect()] == [0.0, 0.0, 1.0]


def test_partial_labels(spark):
    codes = spark.createDataFrame([("1", "Masculino", 1), ("2", "Femenino", 2), ("9", "No aplica", 3)], "code string, label string, ord int")
    v = spark.createDataFrame([(x,) for x in ["1", "MASCULINO", "masc", "sexo femenino", "no", "zz", "M"]], "value string")
    got = {r["value"]: r["code"] for r in harmonize.value_mappings(v, codes).collect()}
    assert got == {"1": "1", "MASCULINO": "1", "masc": "1", "sexo femenino": "2", "no": None, "zz": None, "M": None}


def test_containing_names(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    a, b = (spark.createDataFrame([(w,) for w in ws], "name string") for ws in (words[:30], words[30:]))
    got = {(r["na"], r["nb"]) for r in semantic.containing_names(a, b).collect()}
    assert got == {(x, y) for x in words[:30] for y in words[30:] if x in y or y in x}


def test_version_numbers(spark):
    rng = random.Random(4)
    kinds = [rng.choice(["major", "minor", "patch", "patch"]) for _ in range(200)]
    rows = [("k", f"2024-01-{1 + i // 9:02d} 00:00:00", i, k) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "catalog string, ts string, seq int, kind string").withColumn("ts", F.to_timestamp("ts"))
    rows = lifecycle.version_history(df, (1, 2, 3)).collect()
    got, came = {r["seq"]: r["to_version"] for r in rows}, {r["seq"]: r["from_version"] for r in rows}
    v = [1, 2, 3]
    for i, k in enumerate(kinds):
        assert came[i] == ".".join(map(str, v))
        v = [v[0] + 1, 0, 0] if k == "major" else [v[0], v[1] + 1, 0] if k == "minor" else [v[0], v[1], v[2] + 1]
        assert got[i] == ".".join(map(str, v))


# --- validation of the documented examples ------------------------------------------------

FARM = vd.DomainPack("farm", [
    vd.FieldSchema("productor_id", "string", True), vd.FieldSchema("cultivo", enum=["arroz", "maiz", "papa", "cafe", "cacao", "frijol"]),
    vd.FieldSchema("hectareas", "float", min=0.1, max=10000), vd.FieldSchema("rendimiento", "float", min=0, max=100),
    vd.FieldSchema("latitud", "float", min=-90, max=90)])


def test_farm_scorecard(spark):
    rows = [("P-001", "maiz", 5.0, 2.0, 13.0), ("P-002", "papa", 0.05, 50.0, 13.0), ("P-003", "cafe", 1200.0, 1.0, 13.0), ("P-004", "cacao", 1.0, 1.0, 13.0), ("P-005", "trigo", 2.0, 1.0, 13.0)]
    df = spark.createDataFrame(rows, "productor_id string, cultivo string, hectareas double, rendimiento double, latitud double")
    issues = vd.validate(df, FARM, ["productor_id"])
    got = {(r["productor_id"], r["severity"], r["issue_type"], r["suggested_value"]) for r in issues.collect()}
    assert got == {("P-002", "warning", "out_of_range", "0.1"), ("P-005", "error", "enum_invalid", None)}
    card = vd.scorecard(issues.withColumn("d", F.lit(1)), ["d"]).first()
    assert (card["score"], card["status"]) == (80, "pass")
    assert vd.row_status(df, issues, ["productor_id"]).filter("not is_valid").count() == 1


def test_routing_record(spark):
    loc = "array<struct<id:string,coords:array<double>,time_window_start:int,time_window_end:int,weight_demand:double,volume_demand:double,time_windows:array<struct<start:int,end:int>>>>"
    schema = f"r int, locations {loc}, vehicles array<struct<id:string,start_time:int,end_time:int>>, pickups_deliveries array<struct<pickup:string,delivery:string>>"
    rows = [(1, [("c1", [4.6, -74.1], 68400, 36000, -10.0, -0.5, [(5, 3)]), ("c2", [4.9, -74.1], 30000, 82800, -5.0, -0.3, None)], [("v1", 10, 10)], [("c1", "c2"), ("c1", "nobody")])]
    df = spark.createDataFrame(rows, schema)
    box = {"lat_min": 4.47, "lat_max": 4.83, "lng_min": -74.25, "lng_max": -74.0}
    assert [r["field_name"] for r in vd.check_bounds(df, ["r"], box).collect()] == ["locations.c2.coords"]
    t = {(r["field_name"], r["issue_type"]) for r in vd.check_time_windows(df, ["r"], (21600, 79200)).collect()}
    assert t == {("locations.c1.time_window", "time_window_invalid"), ("locations.c2.time_window", "atypical_hours"),
                 ("locations.c1.time_windows[0]", "time_window_invalid"), ("vehicles.v1.schedule", "vehicle_schedule_invalid")}
    assert [r["original_value"] for r in vd.check_balance(df, ["r"]).collect()] == ["weight_demand", "volume_demand"]
    # fields that records do not have are not judged, but nothing carries a load without a vehicle
    assert {r["issue_type"] for r in vd.check_routing_rules(df, ["r"]).collect()} == {"ends_before_visits"}
    assert vd.check_routing_rules(df.limit(0), ["r"]).count() == 0


def test_routing_rules(spark):
    loc = "array<struct<id:string,required_skills:array<string>,time_window_start:int,time_window_end:int,weight_demand:double,volume_demand:double>>"
    veh = "array<struct<id:string,skills:array<string>,start_time:int,end_time:int,weight_capacity:double,volume_capacity:double>>"
    c1, c2 = ("c1", ["cold"], 100, 200, -6.0, 1.0), ("c2", None, 50, 300, 5.0, None)
    v1, v2 = ("v1", ["cold", "lift"], 80, 200, 5.0, None), ("v2", None, None, 250, 0.5, 9.0)
    rows = [(1, [c1, c2], [v1, v2], False), (2, [c1, c2], [v1, v2], True), (3, [c1], [v2], None), (4, [c2], None, False), (5, None, [v1], False),
            (6, [("c3", ["cold", "fork"], None, None, None, None), ("c3", [], 90, 90, -1.0, 0.0)], [v1], False)]
    df = spark.createDataFrame(rows, f"r int, locations {loc}, vehicles {veh}, allow_skipping_nodes boolean")
    got = {}
    for r in vd.check_routing_rules(df, ["r"]).collect():
        got.setdefault(r["r"], set()).add((r["severity"], r["field_name"], r["issue_type"]))
    weight, skill = ("error", "locations.weight_demand", "capacity_exceeded"), "missing_skills"
    times = {("warning", "vehicles.v1.start_time", "starts_after_visits"), ("warning", "vehicles.v1.end_time", "ends_before_visits"),
             ("warning", "vehicles.v2.end_time", "ends_before_visits")}
    assert got[1] == {weight} | times and got[2] == times
    assert got[3] == {("error", "locations.c1.required_skills", skill), weight}
    assert got[4] == {weight} and 5 not in got
    assert got[6] == {("error", "locations.c3.required_skills", skill)}


def test_layers_stop_at_errors(spark):
    df = spark.createDataFrame([(1, "x"), (2, "5"), (3, "7")], "id int, n string")

    def odd(d, pack):
        return d.filter("n = 7").select("id", F.lit("custom").alias("layer"), F.lit("error").alias("severity"), F.lit("n").alias("field_name"),
                                        F.lit("odd").alias("issue_type"), F.lit(None).alias("original_value"), F.lit(None).alias("suggested_value"))

    def fails_at_run_time(d, pack):
        boom = F.udf(lambda v: 1 // 0)
        return d.select("id", F.lit("custom").alias("layer"), F.lit("error").alias("severity"), F.lit("n").alias("field_name"), boom("n").alias("issue_type"),
                        F.lit(None).alias("original_value"), F.lit(None).alias("suggested_value"))

    pack = vd.DomainPack("p", [vd.FieldSchema("n", "integer")], [vd.Rule("big", "n > 100", "warning", "n")], {"boom": fails_at_run_time, "odd": odd})
    got = {(r["id"], r["layer"], r["issue_type"]) for r in vd.validate(df, pack, ["id"]).collect()}
    assert got == {(1, "structural", "type_mismatch"), (3, "custom", "odd"), (2, "semantic", "big"), (None, "custom", "validator_failed")}
    assert list(vd.run_validators(df.filter("n <> 'x'"), pack, ["id"])[1]) == ["boom"]


def test_new_corrections_are_recorded(spark):
    """S24: the first answer creates the record, five acceptances make a rule, a refusal stops it."""
    rows = [("type_mismatch", "a", "", "1", True, i) for i in range(5)] + [("type_mismatch", "b", "", "2", None, 0), ("warning", "c", "", "3", False, 1)]
    m = {r["field_name"]: r for r in memory.correction_memory(spark.createDataFrame(rows, "error_type string, field_name string, context string, corrected_value string, accepted boolean, ts int")).collect()}
    assert m["a"]["auto_rule"] and m["a"]["count"] == 5 and not m["b"]["auto_rule"] and m["b"]["accepted"] is None and m["c"]["skip"]


# --- graph of the documented example ------------------------------------------------------

def test_small_graph(spark):
    nodes = cat.conform(spark.createDataFrame([
        ("source:a", "source", "a", None, None, None, None), ("source:b", "source", "b", None, None, None, None),
        ("concept:sexo", "concept", "sexo", None, None, "approved", None), ("classifier:iso", "classifier", "iso", None, None, "approved", None),
        ("field:a.sexo", "field", "sexo", "a", 0.9, "approved", ["M", "F", "M"]), ("field:b.genero", "field", "genero", "b", 0.85, "approved", ["1", "2", "1"]),
        ("field:c.orphan", "field", "orphan", "c", 0.5, "approved", ["x"])],
        "id string, type string, name string, source_db string, quality_score double, review_status string, sample_values array<string>"), cat.NODE_COLUMNS)
    edges = cat.conform(spark.createDataFrame([
        ("field:a.sexo", "concept:sexo", "implementa"), ("field:b.genero", "concept:sexo", "implementa"), ("concept:sexo", "classifier:iso", "usa_clasificador"),
        ("field:a.sexo", "source:a", "proviene_de"), ("field:b.genero", "source:b", "proviene_de"), ("field:c.orphan", "source:a", "proviene_de"),
        ("classifier:iso", "concept:sexo", "usa_clasificador")], "src string, dst string, type string"), cat.EDGE_COLUMNS)
    inv = {(r["item"], r["rule"]) for r in health.graph_invariants(nodes, edges).collect() if r["severity"] == "violation"}
    assert inv == {("field:c.orphan", "field_without_concept"), ("classifier:iso -> concept:sexo", "invalid_classifier_direction")}
    i = cat.impact(nodes, edges).first()
    assert (i["fields"], i["interop_paths"], i["classifiers"]) == (2, 2, 1)
    n2, e2, gone = cat.delete_sources(nodes, edges, spark.createDataFrame([("source:a",)], "id string"))
    assert {r["id"] for r in gone.collect()} == {"source:a", "field:a.sexo", "field:c.orphan"} and e2.count() == 4


def test_one_direction_of_composites(spark):
    """S26: a composite points to its parts."""
    nodes = cat.conform(spark.createDataFrame([("concept:full", "concept"), ("concept:first", "concept")], "id string, type string"), cat.NODE_COLUMNS)
    edges = cat.conform(spark.createDataFrame([("concept:full", "concept:first", "compone", "concat")], "src string, dst string, type string, operation string"), cat.EDGE_COLUMNS)
    assert cat.neighbors(nodes, edges, "compone", "out").first()["id"] == "concept:full"
    assert {r["concept_id"]: r["composites"] for r in cat.impact(nodes, edges).collect()} == {"concept:full": 0, "concept:first": 1}


def test_streams_in_several_batches(spark, tmp_path):
    """Many micro-batches give the same memory as one batch job."""
    from datasteward.streaming import streams
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice("xyz"), "", str(i), rng.choice([True, False, None]), i) for i in range(300)]
    schema = "error_type string, field_name string, context string, corrected_value string, accepted boolean, ts int"
    df = spark.createDataFrame(rows, schema)
    for part in range(5):
        df.filter(f"ts % 5 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = streams.file_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    got = streams.correction_memory_stream(s, str(tmp_path / "work"))
    want = memory.correction_memory(df)
    cols = ["signature", "corrected_value", "count", "accepted", "auto_rule", "skip"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
