"""Selection of models, families of several parts, and the configured run."""

import itertools
import math
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from lexaline.models import learners
from lexaline.models import selection as L
from lexaline.plans import registry
from lexaline.plans import run as R
from lexaline.sources import files as P
from lexaline.sources import tables as S


@pytest.fixture(scope="module")
def curve(spark):
    """Rows whose truth is a curve of x with y as noise."""
    r = random.Random(1)
    rows = [(i, x := r.random(), r.random(), 2 + math.sin(6 * x) * 0.9) for i in range(400)]
    return spark.createDataFrame(rows, "row_id int, x double, y double, truth double").cache()


def rmse(df, truth):
    return df.join(truth, "row_id").agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("truth"), 2)))).first()[0]


def test_greedy_by_brute_force(spark):
    r = random.Random(2)
    truth = [r.random() for _ in range(50)]
    columns = {n: [t + r.gauss(b, s) for t in truth] for n, b, s in (("a", 0.3, 0.1), ("b", -0.3, 0.1), ("c", 0.0, 0.4))}
    df = spark.createDataFrame([(*v, t) for *v, t in zip(*columns.values(), truth)], "a double, b double, c double, t double")

    def error(members):
        return math.sqrt(sum((sum(columns[m][i] for m in members) / len(members) - t) ** 2 for i, t in enumerate(truth)) / len(truth))

    chosen, best = [], []
    for _ in range(4):
        chosen.append(min((error([*chosen, x]), x) for x in columns)[1])
        best.append((error(chosen), len(chosen)))
    sums, n = L.gram(df, list(columns), "t")
    got, value = L.greedy(sums, n, list(columns), "t", 4)
    assert got == chosen[: min(best)[1]] and value == pytest.approx(min(best)[0])
    assert L.greedy(sums, n, list(columns), "t", 10, replace=False)[1] >= value - 1e-12
    weights = L.bagged_selection(df, {"m": ["a", "b"], "k": ["c"]}, "t", 5)
    assert sum(weights.values()) == pytest.approx(1) and weights == L.bagged_selection(df, {"m": ["a", "b"], "k": ["c"]}, "t", 5)
    report = [tuple(x) for x in L.distance_report(df, list(columns)).collect()]
    assert [x[2] for x in report] == sorted(x[2] for x in report) and {x[:2] for x in report} == set(itertools.combinations("abc", 2))


def test_kernel_machine_fits_a_curve(curve):
    plain = learners.predict(learners.fit("ridge", curve, ["x"], "truth", regParam=0.0), curve, ["x"])
    kernel = L.kernel_machine(curve, curve, ["x"], "truth", gamma=8.0)
    assert rmse(kernel, curve) < 0.1 < rmse(plain, curve)


def test_stacking_predicts_rows_it_has_not_seen(curve):
    train, test = curve.where("row_id % 4 > 0"), curve.where("row_id % 4 = 0")
    families = ("ridge", "forest")
    level_one = {f: learners.out_of_fold(f, train, ["x", "y"], "truth") for f in families}
    asked = {f: learners.predict(learners.fit(f, train, ["x", "y"], "truth"), test, ["x", "y"]) for f in families}
    preds = learners.stacked(level_one, train.select("row_id", "truth"), asked)[1]
    assert {r["row_id"] for r in preds.collect()} == {r["row_id"] for r in test.collect()}
    assert rmse(preds, test) <= rmse(asked["ridge"], test) + 0.01


def test_extra_trees_fit_a_curve(curve):
    preds = L.extra_trees(curve, curve, ["x", "y"], "truth", trees=6, depth=6)
    assert rmse(preds, curve) < 0.25 and preds.count() == 400
    again = L.extra_trees(curve, curve, ["x", "y"], "truth", trees=2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, L.extra_trees(curve, curve, ["x", "y"], "truth", trees=2).collect()))


def test_three_part_and_importance(curve):
    preds = L.three_part(curve, curve, ["x", "y"], "truth")
    assert rmse(preds, curve) < 0.35 and preds.agg(F.min("pred"), F.max("pred")).first()[0] >= 1
    order = L.importance(learners.fit("forest", curve, ["y", "x"], "truth", numTrees=5), ["y", "x"])
    assert order[0][0] == "x" and L.importance(learners.fit("ridge", curve, ["y", "x"], "truth", regParam=0.0), ["y", "x"])[0][0] == "x"


def test_grid_and_weighted_union(curve):
    trials = L.grid_search("ridge", curve, ["x", "y"], "truth", {"regParam": [0.01, 100.0]})
    assert len(trials) == 2 and trials[0]["params"] == {"regParam": 0.01} and trials[0]["loss"] <= trials[1]["loss"]
    parts = [(["x"], 1.0), (["y"], 0.25)]
    model, names = L.fit_weighted(curve, parts, "truth")
    assert names == ["x", "y"] and L.predict_weighted(model, curve, parts).count() == 400
    assert L.without_columns(curve, ("y", "none"), ("y", "row_id")).columns == ["row_id", "x", "truth"]


def test_configured_run(spark, tmp_path):
    cases = S.search_cases(spark, SF)
    given = {"model": "ridge", "features": ["len_of_title", "word_in_title", "chars_of_query"], "drop": ["chars_of_query"], "params": {"regParam": 0.1}}
    out, error = R.run(cases, f"file://{tmp_path}", given)
    assert out.count() == cases.count() and 0 < error < 1.2
    again, same = R.run(cases, f"file://{tmp_path}/2", given)
    assert same == pytest.approx(error)
    back = P.read_csv(spark, f"file://{tmp_path}/submission", "id bigint, relevance double")
    assert back.count() == cases.where("relevance is null").count() and back.where("relevance < 1 or relevance > 3 or relevance is null").count() == 0
    for bad in ({"colour": 1}, {"features": ["none"]}, {"model": "none"}):
        with pytest.raises(KeyError):
            R.settings(bad)
    assert R.sampled(cases, 5).count() == 10 and len(registry.REGISTRY) > 140


def test_greedy_forest_options(spark):
    from lexaline.models import greedy_forest as G

    r = random.Random(4)
    rows = [(x := r.randint(0, 9), y := r.randint(0, 9), float(2 * (x > 4) + (y > 6) + (x > 4) * (y < 3)), 1.0 + (x % 3)) for _ in range(600)]
    df = spark.createDataFrame(rows, "x int, y int, t double, w double")
    weighted = G.fit(df, ["x", "y"], "t", max_leaves=4, weight="w")
    repeated = G.fit(df.select("x", "y", "t", F.explode(F.array_repeat(F.lit(1), F.col("w").cast("int")))), ["x", "y"], "t", max_leaves=4)
    assert [(x.path, round(x.weight, 6)) for x in weighted.leaves] == [(x.path, round(x.weight, 6)) for x in repeated.leaves]
    plain = G.fit(df, ["x", "y"], "t", max_leaves=5)
    deep = G.fit(df, ["x", "y"], "t", max_leaves=5, depth_penalty=1000.0)
    assert sum(len(x.path) for x in deep.leaves) <= sum(len(x.path) for x in plain.leaves) and G.Penalty(2.0, 3.0).at(2) == 18.0
    more = G.fit(df, ["x", "y"], "t", max_leaves=6, start=G.fit(df, ["x", "y"], "t", max_leaves=3))
    assert len(more.leaves) == 6 and len(G.fit(df, ["x", "y"], "t", max_leaves=3).leaves) == 3
    one = G.fit(df, ["x", "y"], "t", max_leaves=3, feature_share=0.5, seed=1)
    assert [x.path for x in one.leaves] == [x.path for x in G.fit(df, ["x", "y"], "t", max_leaves=3, feature_share=0.5, seed=1).leaves]
    row = G.evaluation(df, plain, "t", 1.5).first()
    truth = {tuple(x): x["t"] for x in df.collect()}
    preds = df.select("t", plain.predict().alias("p"), *[c.alias(n) for n, c in G.leaf_indicators(plain).items()]).collect()
    assert row["rows"] == len(preds) and row["square_error"] == pytest.approx(sum((x["t"] - x["p"]) ** 2 for x in preds)) and row["accuracy"] == pytest.approx(sum((x["p"] >= 1.5) == (x["t"] >= 1.5) for x in preds) / len(preds))
    weights = [x.weight for x in plain.leaves]
    assert all(x["p"] == pytest.approx(plain.base + sum(w * x[f"leaf_{i}"] for i, w in enumerate(weights) if w)) for x in preds) and truth
    assert sum(n for _, n, _, _ in G.rules(plain)) == len(plain.leaves) and row["leaves"] == len(plain.leaves)
