"""Values that a fixed number of decimals would lose, silences at the end of a log, half-open windows, word sets."""

import datetime as dt

from pyspark.sql import functions as F

from datasteward.functions import text as tx
from datasteward.operators import catalog as cat
from datasteward.operators import cells, feasibility, harmonize, profile, validate
from datasteward.sources import readers
from datasteward.streaming import streams


def test_float_cells_keep_their_values(spark):
    values = [1e-5, 2e-5, 3e-5, 1e36, float("nan"), 2.5, 0.1, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["value"]: r["cnt"] for r in cells.value_counts(cells.cells(df, "t")).collect()}
    assert got == {"1.0E-5": 1, "2.0E-5": 1, "3.0E-5": 1, "1.0E36": 1, "NaN": 1, "2.5000": 1, "0.1000": 1, None: 1}


def test_small_floats_are_profiled(spark):
    df = spark.createDataFrame([(k * 1e-5,) for k in range(1, 5)], "x double")
    r = profile.distribution_summary(cells.cells(df, "t")).first()
    assert (r["unique"], r["missing"], r["min"], r["max"]) == (4, 0, 1e-5, 4e-5)


def test_silence_at_the_end(spark):
    at = [dt.datetime(2024, 1, 1, h) for h in (0, 1, 5)]
    df = spark.createDataFrame([("a", t) for t in at] + [("b", at[2])], "k string, ts timestamp")
    now = dt.datetime(2024, 1, 1, 8)
    plain = {(r[0], r[1], r[2]) for r in streams.heartbeat_gaps(df, "k", 7200).collect()}
    assert plain == {("a", at[1], at[2])}
    assert {tuple(r) for r in streams.heartbeat_gaps(df, "k", 7200, now=now).collect()} == plain | {("a", at[2], now), ("b", at[2], now)}
    assert {tuple(r) for r in streams.heartbeat_gaps(df, "k", 36000, now=now).collect()} == set()


def test_half_open_windows(spark):
    kind = "id int, locations array<struct<id:string,time_window_start:int,time_window_end:int>>"
    df = spark.createDataFrame([(1, [("p", None, 90000), ("q", 100, None), ("r", 100, 90000), ("s", None, None)])], kind)
    got = validate.check_time_windows(df, ["id"], (21600, 79200)).collect()
    assert [(r["field_name"], r["issue_type"]) for r in got] == [("locations.r.time_window", "atypical_hours")]


def test_word_sets_that_hold_each_other(spark):
    vw = [("v1", ["part", "size"]), ("v2", ["part"]), ("v3", ["tax", "x"]), ("v4", ["a", "b", "c"])]
    fw = [("f1", ["part", "size", "unit"]), ("f2", ["x"]), ("f3", ["part"]), ("f4", ["b", "c", "d"])]
    got = feasibility._containing_sets(spark.createDataFrame(vw, "name string, vw array<string>"),
                                       spark.createDataFrame(fw, "concept_id string, fw array<string>")).distinct()
    want = {(n, c) for n, a in vw for c, b in fw if set(a) <= set(b) or set(b) <= set(a)}
    assert {tuple(r) for r in got.collect()} == want
    assert got.agg(F.count("*")).first()[0] == len(want)


def test_means_do_not_hang_on_the_order(spark):
    values = [round(0.0499185 + k * 1e-8, 8) for k in range(-400, 401)] * 3
    df = spark.createDataFrame([(v,) for v in values], "x double")
    means = {profile.distribution_summary(cells.cells(df.repartition(n), "t")).first()["mean"] for n in (1, 3, 7)}
    assert means == {0.0499185}
    huge = spark.createDataFrame([(1e36,), (3e36,)], "x double")
    assert profile.distribution_summary(cells.cells(huge, "t")).first()["mean"] == 2e36


def test_files_and_folders_of_parts(spark, tmp_path):
    (tmp_path / "days.csv").write_text('"Monday",1\nTuesday\n')
    (tmp_path / "notes.txt").write_text("x")
    spark.createDataFrame([("Red",), ("Blue",)], "v string").write.text(str(tmp_path / "colours.csv"))
    got = {tuple(r) for r in readers.load_reference_lists(spark, str(tmp_path)).collect()}
    assert got == {("days", "monday"), ("days", "tuesday"), ("colours", "red"), ("colours", "blue")}
    docs = tmp_path / "v1.2"
    docs.mkdir()
    (docs / "norm a.md").write_text("one\ntwo")
    assert [tuple(r) for r in readers.read_documents(spark, str(docs)).collect()] == [("norm a", "one\ntwo")]


def test_dotted_names(spark):
    kind = "id int, locations array<struct<id:string,at:struct<lat:double>>>"
    rows = [(1, [("p", (1.0,)), ("q", (2.0,))]), (2, [("p", (1.0,)), (None, (2.0,))]), (3, [("p", None)]), (4, None), (5, [])]
    fields = [validate.FieldSchema(n, required=True) for n in ("locations.id", "locations.at.lat", "depot.id")]
    got = {(r["id"], r["field_name"]) for r in validate.validate_structural(spark.createDataFrame(rows, kind), fields, ["id"]).collect()}
    assert got == {(2, "locations.id"), (3, "locations.at.lat"), (4, "locations.id"), (4, "locations.at.lat")} | {(k, "depot.id") for k in range(1, 6)}


def test_case_text_without_codes(spark):
    df = spark.createDataFrame([("a",)], "v string")
    none = spark.createDataFrame([], "code string, label string, ord int")
    assert [r["line"] for r in harmonize.case_text_lines(df, "v", none, "X", "x").collect()] == ["-- X has no codes"]
    codes = spark.createDataFrame([("A", "it's", 1)], "code string, label string, ord int")
    lines = [r["line"] for r in harmonize.case_text_lines(df, "v", codes, "X", "x").orderBy("part").collect()]
    assert lines == ["-- v to X (x), 1 codes\nCASE", "    WHEN \"v\" IN ('A', 'a') THEN 'A'  -- it's",
                     "    ELSE NULL  -- to be reviewed\nEND AS \"v_canonico\""]


def test_marks_fold_in_every_language(spark):
    texts = ["Şeker ŐRÜLT čaj", "Żółć łódź", "e\u0301cole n\u0303", "İstanbul", "ǻ ṩ ậ ἄλφα Ёлка", "日本 한국어", "øđß", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tx.normalize_text(F.col("t"))).collect()]
    assert got == ["seker orult caj", "zołc łodz", "ecole n", "istanbul", "a s a αλφα елка", "日本 한국어", "øđß", "", None]


def test_variables_join_the_fields_once(spark, tmp_path):
    """Every step leaves out what earlier ones found, but none joins the fields with their concepts again."""
    nodes = cat.conform(spark.createDataFrame(
        [("c1", "concept", "birth date", None), ("c2", "concept", "town", None), ("f1", "field", None, "home_town"), ("f2", "field", None, "born")],
        "id string, type string, name string, column string"), cat.NODE_COLUMNS)
    edges = cat.conform(spark.createDataFrame([("f1", "c2", "implementa"), ("f2", "c1", "implementa")], "src string, dst string, type string"), cat.EDGE_COLUMNS)
    edges.write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    variables = spark.createDataFrame([("birth date", ""), ("born", ""), ("home_town", ""), ("town home", ""), ("x", "the date"), ("y", "")], "name string, description string")
    got = feasibility.match_variables(variables, nodes, edges)
    assert not [f for f in got.inputFiles() if "/edges/" in f]
    assert {r["name"]: (r["concept_id"], r["step"]) for r in got.collect()} == {
        "birth date": ("c1", 1), "born": ("c1", 3), "home_town": ("c2", 2), "town home": ("c2", 2), "x": ("c1", 5)}
