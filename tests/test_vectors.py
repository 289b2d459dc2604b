"""Expected values of single operators on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from datasteward.functions import privacy, pvalues
from datasteward.functions import text as tx
from datasteward.operators import anomalies, assess, cluster, interop, matching, profile, similarity, stats
from datasteward.operators.cells import cells, value_counts
from datasteward.plans import q_semantic as qs


def column(spark, values, name="c", source="t"):
    df = spark.createDataFrame([(v,) for v in values], f"{name} string")
    return cells(df, source)


def scores(spark, a, b):
    ca, cb = column(spark, a, "a"), column(spark, b, "b")
    vf = value_counts(ca.unionByName(cb), "upper")
    return similarity.value_similarity(vf, similarity.column_pairs(spark, [("t", "a"), ("t", "b")])).first()


@pytest.mark.parametrize("a, b, cosine", [(list("MFMFM"), list("MFMFM"), 1.0), (list("MMM"), list("FFF"), 0.0),
                                          (["M", "F", "M"], ["m", "f", "m"], 1.0), ([""], ["M"], 0.0)])
def test_cosine(spark, a, b, cosine):
    assert scores(spark, a, b)["cosine"] == pytest.approx(cosine)


def test_jaccard_and_overlap(spark):
    assert scores(spark, list("abc"), list("abd"))["jaccard"] == pytest.approx(0.5)
    assert scores(spark, list("ab"), list("cd"))["jaccard"] == 0.0
    assert scores(spark, list("ab"), list("abcd"))["overlap"] == 1.0


def tfidf(spark, a, b):
    df = spark.createDataFrame([(1, a, b)], "id int, text_a string, text_b string")
    return similarity.text_tfidf(df, ["id"]).first()["tfidf"]


def test_tfidf(spark):
    assert tfidf(spark, "sexo del paciente", "sexo del paciente") == pytest.approx(1.0)
    assert tfidf(spark, "sexo del paciente", "precio de venta agricola") < 0.3
    assert tfidf(spark, "", "algo") == 0.0


def test_numbers(spark):
    got = [r[0] for r in column(spark, ["1", "abc", "3", " 4.5 ", "nan", "1.5d", "1_000", "inf", None, "1e3"]).select(tx.parse_number(F.col("value"))).collect()]
    assert got == [1.0, None, 3.0, 4.5, None, None, None, None, None, 1000.0]


def welch(spark, a, b):
    rows = [("a", float(x)) for x in a] + [("b", float(x)) for x in b]
    return stats.welch_t(spark.createDataFrame(rows, "g string, v double"), "v", "g", [("a", "b")]).first()


def test_welch(spark):
    same = welch(spark, range(1, 6), range(1, 6))
    assert same["t_stat"] == 0 and not same["significant"]
    assert welch(spark, range(1, 6), [100, 200, 300, 400, 500])["significant"]
    assert not welch(spark, [1], [2])["significant"]


def test_p_values():
    # t = 2.228 is the two-sided 5 % point of 10 degrees of freedom, 1.96 that of the normal
    assert pvalues.student_two_sided(2.2281388520, 10) == pytest.approx(0.05, abs=1e-8)
    assert pvalues.student_two_sided(1.959963985, 500) == pytest.approx(0.05, abs=1e-8)
    assert pvalues.student_two_sided(12.7062047364, 1) == pytest.approx(0.05, abs=1e-8)
    assert pvalues.chi_square_upper(3.841, 1) == pytest.approx(0.05, abs=5e-3)
    assert pvalues.chi_square_upper(18.307, 10) == pytest.approx(0.05, abs=1e-3)


def chi(spark, a, b):
    vf = value_counts(column(spark, a, "a").unionByName(column(spark, b, "b")), "upper")
    return stats.with_chi_test(similarity.value_similarity(vf, similarity.column_pairs(spark, [("t", "a"), ("t", "b")]))).first()


def test_chi_square(spark):
    assert not chi(spark, list("MFMF"), list("MFMF"))["significant"]
    assert chi(spark, ["M"] * 100, ["F"] * 100)["significant"]
    assert chi(spark, ["M"] * 5, ["M"] * 5)["chi2"] == 0.0


def corr(spark, f, x, y):
    return f(spark.createDataFrame(list(zip(map(float, x), map(float, y))), "x double, y double"), "x", "y").first()


def test_correlation(spark):
    assert corr(spark, stats.pearson, range(1, 6), range(2, 12, 2))["r"] == pytest.approx(1.0)
    assert corr(spark, stats.pearson, range(1, 6), range(10, 0, -2))["r"] == pytest.approx(-1.0)
    assert abs(corr(spark, stats.pearson, range(1, 6), [3, 1, 5, 2, 4])["r"]) < 0.5
    assert corr(spark, stats.pearson, [1], [1])["verdict"] == "insuficientes datos"
    assert corr(spark, stats.pearson, [1, 1, 1], [1, 2, 3])["verdict"] == "sin varianza"
    assert corr(spark, stats.spearman, range(1, 6), [1, 4, 9, 16, 25])["r"] == pytest.approx(1.0)
    assert corr(spark, stats.spearman, [1, 1, 1], [1, 2, 3])["verdict"] == "sin varianza"


def test_pairs_are_taken_from_the_same_row(spark):
    """S16: a null removes its row, it does not shift the column against the other one."""
    df = spark.createDataFrame([(None, 9.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "x double, y double")
    assert stats.pearson(df, "x", "y").first()["r"] == pytest.approx(1.0)


def test_distribution(spark):
    d = profile.distribution_summary(column(spark, list("123455"))).first()
    assert (d["type"], d["count"], d["unique"]) == ("numeric", 6, 5)
    assert d["mean"] == pytest.approx(20 / 6) and d["median"] == 3.5
    d = profile.distribution_summary(column(spark, list("MFMFH"))).first()
    assert (d["type"], d["unique"]) == ("categorical", 3)
    assert profile.distribution_summary(column(spark, ["M", "", None, "F", "N/A"])).first()["missing"] == 3


def test_quality(spark):
    q = profile.column_quality(column(spark, ["M", "F"] * 5)).first()
    assert q["score"] >= 80 and q["grade"] in "AB"
    q = profile.column_quality(column(spark, ["M"] + [None] * 9)).first()
    assert q["completeness"] < 0.2 and "alta nulidad" in q["issues"]


def test_outliers(spark):
    def rows(values):
        return anomalies.numeric_anomalies(column(spark, values)).collect()
    assert rows([str(i) for i in range(1, 9)])[0]["anomaly_count"] == 0
    assert rows([str(i) for i in range(1, 8)] + ["100"])[0]["anomaly_count"] == 1
    assert rows(["1", "2"]) == []
    df = spark.createDataFrame([(i, str(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 100])], "id int, v string")
    assert [(r["id"], r["x"]) for r in anomalies.anomaly_rows(df, "t", ["id"], ["v"]).collect()] == [(7, 100.0)]


def test_high_cardinality(spark):
    r = profile.high_cardinality(column(spark, [str(i) for i in range(100)])).first()
    assert r["high_cardinality"] and r["cardinality"] == 100


def test_cleaning(spark):
    got = [(r["c"]["cleaned"], r["c"]["fixes"]) for r in column(spark, ["  M  ", "a~o", "x  y", "ok", None, "niÃ±o"]).select(
        tx.auto_clean(F.col("value")).alias("c")).collect()]
    assert got == [("M", ["whitespace"]), ("ano", ["encoding"]), ("x y", ["multiple_spaces"]), ("ok", []), ("", ["null_to_empty"]), ("nino", ["encoding"])]


def test_column_names(spark):
    df = spark.createDataFrame([(n,) for n in ["col_sexo", "Campo_Escolaridad", "fechaNacimiento", " Área-Urbana ", "c_campo_x"]], "n string")
    assert [r[0] for r in df.select(tx.clean_column_name(F.col("n"))).collect()] == [
        "sexo", "escolaridad", "fecha_nacimiento", "rea_urbana", "campo_x"]


def test_features_and_types(spark):
    f = profile.column_features(column(spark, [str(i) for i in range(1, 11)])).first()
    assert f["type"] == "numeric" and f["numeric_ratio"] == 1.0
    assert profile.column_features(column(spark, ["M", "F"])).first()["type"] == "categorical"
    # S5: a column without any value is an integer column
    assert profile.profile_columns(spark.createDataFrame([(None,)], "c string"), "t").first()["data_type"] == "integer"


def test_clusters(spark):
    df = spark.createDataFrame([(str(i), str(i * 2), "abc", "xyz") for i in range(10)], "a string, b string, c string, d string")
    rows = cluster.cluster_columns(profile.column_features(cells(df, "t")), 2).collect()
    assert sum(r["size"] for r in rows) == 4 and sorted(tuple(r["members"]) for r in rows) == [("t.a", "t.b"), ("t.c", "t.d")]
    pts = spark.createDataFrame([(i, [float(x), float(x)]) for i, x in enumerate([0, 0.1, 10, 10.1])], "id int, features array<double>")
    best = cluster.optimal_k(pts, 4).filter("optimal").first()
    assert best["k"] == 2


def test_match_counts(spark):
    a = spark.createDataFrame([("1", "M", "3")], "id string, sexo string, edad string")
    b = spark.createDataFrame([("1", "M", "3", "x")], "id string, genero string, edad string, z string")
    rows = matching.auto_match(a, "a", b, "b").collect()
    assert len(rows) == 6 and {r["bucket"] for r in rows} <= {"high", "medium", "low"}


def test_factors(spark):
    df = spark.createDataFrame([("2024-06-30",), ("2023-07-01",), (None,), ("x",), ("2020-01-01",)], "d string")
    got = [r[0] for r in df.select(interop.staleness_factor(F.col("d"), "2024-06-30")).collect()]
    assert got == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_sensitivity_order(spark):
    """S20: a name that holds both kinds of words follows the priority."""
    df = spark.createDataFrame([("documento_tratamiento",), ("Fecha_Ingreso",), ("total",)], "column string")
    assert [(r["is_pii"], r["is_sensitive"]) for r in privacy.sensitivity(df).collect()] == [(True, False), (False, True), (False, False)]
    assert privacy.sensitivity(df, priority="sensitive").first()["is_sensitive"]


def test_number_format_of_tied_quantiles(spark):
    assert math.isclose(profile.distribution_summary(column(spark, ["1", "2", "3", "100"])).first()["q1"], 1.75)


def test_equal_clean_names_are_fields_of_their_own(spark):
    sf = "/root/testdata/sf0.001"
    df = spark.createDataFrame([("M", "F", str(i)) for i in range(12)], "col_sexo string, sexo string, edad string")
    nodes, edges, maps = assess.register_sources(cells(df, "t"), qs.STANDARDS, qs._codes(spark, sf), qs._concepts(spark), qs._lists(spark, sf))
    fields = sorted(r["id"] for r in nodes.filter("type = 'field'").collect())
    assert fields == ["field:t.edad", "field:t.sexo", "field:t.sexo#sexo"] and maps.count() == 3
    assert sorted(r["src"] for r in edges.filter("type = 'proviene_de'").collect()) == fields
