"""File sources and sinks on small files of every kind."""

import pytest
from pyspark.errors import PySparkException

from lexaline.sources import files as P


def test_csv_keeps_quotes_line_ends_nulls_and_empties(spark):
    rows = [(1, 'a "quoted", value\nand a line'), (2, ""), (3, None), (4, "é ñ \\ back"), (5, " spaces ")]
    for encoding in ("UTF-8", "ISO-8859-1"):
        path = P.scratch(spark, "csv")
        P.write_csv(spark.createDataFrame(rows, "id int, t string"), path, encoding)
        assert sorted(tuple(r) for r in P.read_csv(spark, path, "id int, t string", encoding).collect()) == rows


def test_columns_are_stored_apart(spark):
    path = P.scratch(spark, "columns")
    P.write_columns(spark.createDataFrame([(1, "a", None, 3.5), (2, None, "b", 1.0)], "id int, x string, y string, z double"), path, "id", skip=["z"])
    assert P.stored_columns(spark, path) == ["x", "y"]
    assert sorted(tuple(r) for r in P.read_columns(spark, path, "id", ["y", "x"]).collect()) == [(1, "", "a"), (2, "b", "")]


def test_matrix_lines(spark, tmp_path):
    (tmp_path / "m.txt").write_text("#7 0:1.5 3\n\n#8\n")
    assert sorted(tuple(r) for r in P.read_matrix(spark, f"file://{tmp_path}/m.txt", True).collect()) == [(7, 0, 1.5), (7, 3, 1.0)]
    (tmp_path / "twice.txt").write_text("#7 0:1 0:2\n")
    with pytest.raises(PySparkException):
        P.read_matrix(spark, f"file://{tmp_path}/twice.txt", True).collect()
    (tmp_path / "dense.txt").write_text("#1 0 2.5  -1\n")
    assert sorted(tuple(r) for r in P.read_matrix(spark, f"file://{tmp_path}/dense.txt", False).collect()) == [(1, 1, 2.5), (1, 2, -1.0)]


def test_runs_of_a_script():
    runs = P.expand_runs(["a=1", "@b=x", "@b=y", "@c=1", "@c=2", "a=2 # last"])
    assert [(r["a"], r["b"], r["c"]) for r in runs] == [("2", b, c) for b in "xy" for c in "12"]
    with pytest.raises(ValueError):
        P.expand_runs(["include=p"], {"p": ["include=p"]})


def test_config_and_fields(spark, tmp_path):
    (tmp_path / "config.json").write_text('{"model": "ridge",\n "features": ["a"]}')
    assert P.read_config(spark, f"file://{tmp_path}/config.json", {"folds": 3, "model": "x"}) == {"folds": 3, "model": "ridge", "features": ["a"]}
    (tmp_path / "lines.csv").write_text("1,a,b,c\n2,x\n")
    got = [tuple(r) for r in P.read_fields(spark, f"file://{tmp_path}/lines.csv", {"one": 1, "last": -1, "far": -4}, 2).collect()]
    assert got == [("a", "c", "1"), ("x", "x", None)]


def test_statements_skip_dirty_keys(spark):
    df = spark.createDataFrame([("1", 'a "b"\nc', None), ("x2", "y", 1)], "id string, name string, n int")
    got = P.update_statements(df, "t", "id").collect()
    assert [r["statement"] for r in got] == ['UPDATE t SET name = "a \\"b\\"\nc", n = 0 WHERE id = 1;']
    path = P.scratch(spark, "script")
    P.write_script(P.update_statements(df, "t", "id"), path)
    assert [r["value"] for r in spark.read.text(path).collect()] == ['UPDATE t SET name = "a \\"b\\"\\nc", n = 0 WHERE id = 1;']


def test_best_trials(spark):
    rows = [(0.5, "ok", "m", {"a": "1"}, ["x"]), (0.4, "fail", "m", {"a": "2"}, ["y"]), (float("nan"), "ok", "m", {}, ["z"]), (0.5, "ok", "m", {"a": "3"}, ["a"]), (1.0, "ok", "k", {}, [])]
    got = {r["model"]: (r["loss"], r["features"]) for r in P.best_trials(spark.createDataFrame(rows, P.TRIAL)).collect()}
    assert got == {"m": (0.5, ["a"]), "k": (1.0, [])}


def test_dictionary_keeps_pairs_of_equal_keys(spark, monkeypatch):
    rows = [("a", "1"), ("a", "2"), ("a", "2"), ("b {", 'x "y"\n{z'), ("c", None), *((f"k{i}", str(i)) for i in range(40))]
    for pairs in (10_000, 2):
        monkeypatch.setattr(P, "OBJECT_PAIRS", pairs)
        path = P.scratch(spark, "dictionary")
        P.write_dictionary(spark.createDataFrame(rows, "k string, v string"), path, "k", "v")
        assert sorted(tuple(r) for r in P.read_dictionary(spark, path).collect()) == sorted((k, v or "") for k, v in rows)
