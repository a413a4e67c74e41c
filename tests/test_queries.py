"""Registered relevance queries against their SQL; planner, store and models."""

import math
import random

import oracle
import pytest
from conftest import SF
from pyspark.sql import functions as F

from lexaline.catalog import ORACLES, QUERIES
from lexaline.models import evaluation as E
from lexaline.models import learners
from lexaline.operators import relational as R
from lexaline.plans import registry, store
from lexaline.queries import NUMERIC, _model_rows
from lexaline.sources import tables as S


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_against_sql(spark, name):
    assert oracle.difference(QUERIES[name](spark, SF), oracle.connect(SF), ORACLES[name]) is None


def test_registry_is_whole_and_ordered():
    done = set(registry.BASE_COLUMNS) | {"query_raw", "title_raw", "description_raw", "brand_raw"}
    for layer in registry.layers(registry.REGISTRY, done):
        assert all(set(registry.REGISTRY[n].inputs) <= done for n in layer)
        done |= set(layer)
    assert len(registry.REGISTRY) > 140
    with pytest.raises(KeyError):
        registry.layers(["no such feature"], [])


def test_store_computes_only_what_is_missing(spark, tmp_path):
    cases = registry.raw_cases(S.search_cases(spark, SF))
    root = f"file://{tmp_path}/features"
    first = store.build(cases, root, "a", ["len_of_title", "word_in_title"])
    second = store.build(cases, root, "b", ["len_of_title", "len_of_query"], not_save=["len_of_query"])
    assert {c for c in store._names(spark, root)} == {"len_of_title", "word_in_title"}
    assert first.count() == second.count() == cases.count() and second.columns[-2:] == ["len_of_title", "len_of_query"]


def test_models_beat_nothing(spark):
    rows = _model_rows(spark, SF)
    oof = learners.out_of_fold("ridge", rows, NUMERIC, "relevance")
    assert oof.count() == rows.where("relevance is not null").count()
    assert oof.agg(E.rmse(F.col("pred"), F.col("truth"))).first()[0] < 1.0


def test_greedy_selection(spark):
    df = spark.createDataFrame([(float(i), i + 1.0, i - 1.0, i * 2.0) for i in range(20)], "y double, a double, b double, c double")
    steps = E.greedy_selection(df, ["a", "b", "c"], "y", 2)
    assert [s[0] for s in steps] == ["a", "b"] and steps[0][1] == pytest.approx(1) and steps[1][1] == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("block", [2048, 3])
def test_group_spread(spark, monkeypatch, block):
    import random
    import statistics

    from lexaline.operators import corpus as C

    monkeypatch.setattr(C, "BLOCK_ROWS", block)
    r = random.Random(1)
    rows = [(i, i % 2 if i < 14 else i, [r.uniform(-1, 1) for _ in range(3)]) for i in range(15)]
    got = {x[0]: tuple(x)[1:] for x in C.group_spread(spark.createDataFrame(rows, "id int, g int, v array<float>"), "id", "g", "v").collect()}
    for i, g, v in rows:
        dist = [1 - sum(a * b for a, b in zip(v, w)) / math.hypot(*v) / math.hypot(*w) for j, h, w in rows if h == g and j != i]
        assert got[i] == pytest.approx((max(dist), min(dist), statistics.stdev(dist)) if dist else (0, 0, 0), abs=1e-6)


def test_all_query_words_are_compared(spark):
    from lexaline.functions import text as X

    cases = S.search_cases(spark, SF).select("row_id", F.size(X.tokens(F.col("search_term"))).alias("n"))
    longer = {r["row_id"] for r in cases.where("n > 3").collect()}
    part, whole = ({r["row_id"]: tuple(r) for r in QUERIES[name](spark, SF).collect()} for name in ("co_w2v_avg", "co_w2v_avg_all"))
    assert longer and part.keys() == whole.keys()
    assert {i for i in part if part[i] != whole[i]} <= longer and any(part[i] != whole[i] for i in longer)


def test_greedy_forest_splits_a_skewed_feature(spark):
    from lexaline.models import greedy_forest

    rows = [(0.0, 0.0)] * 960 + [(1.0, 0.0)] * 20 + [(2.0, 9.0)] * 20
    df = spark.createDataFrame(rows, "x double, y double")
    forest = greedy_forest.fit(df, ["x"], "y", max_leaves=4)
    assert 1.0 in {border for leaf in forest.leaves for _, border, _ in leaf.path}
    means = {r["x"]: r["p"] for r in df.groupBy("x").agg(F.avg(forest.predict()).alias("p")).collect()}
    assert means[2.0] > 7 and abs(means[0.0]) < 1 and abs(means[1.0]) < 1


def test_greedy_forest_with_a_feature_of_many_values(spark, monkeypatch):
    from lexaline.models import greedy_forest

    monkeypatch.setattr(greedy_forest, "MAX_DISTINCT", 20)
    df = spark.createDataFrame([(i, i % 5, float(i > 60)) for i in range(100)], "x int, z int, y double")
    forest = greedy_forest.fit(df, ["x", "z"], "y", max_leaves=3, n_bins=10)
    assert len(forest.leaves) == 3 and {f for leaf in forest.leaves for f, _, _ in leaf.path} == {"x"}


def test_measure_cases_normalise_a_text_once(spark):
    plan = QUERIES["tm_measure_cases"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("ArrowEvalPython") == 1
    rows = [("", ""), ("", "1in."), ("1in.", None), ("1in.", "2in."), ("1in. 2in.", "2in.")]
    got = spark.createDataFrame(rows, "a string, b string").select(registry.measure_cases(F.col("a"), F.col("b")).alias("c")).collect()
    assert [tuple(r["c"]) for r in got] == [tuple(k == i for k in range(5)) for i in range(5)]


@pytest.mark.parametrize("repeated", [False, True])
def test_cosines_move_known_terms_only(spark, monkeypatch, repeated):
    from lexaline.operators import corpus as C

    monkeypatch.setattr(C, "COUNTED_ROWS", 3)
    monkeypatch.setattr(C, "SUMMED", 8)
    r = random.Random(7)
    words = "red bolt Big saw steel\u00a0x 日本".split(" ")
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 5))), "\t".join(r.choices([*words, f"rare{i}"], k=r.randint(0, 9)))) for i in range(30)] + [(40, None, "red"), (41, "red  bolt", "red bolt")]
    df = spark.createDataFrame(rows + rows[:2] * repeated, "id bigint, a string, b string")
    weights = C.idf(df, "a")
    got = {x["id"]: x["dist"] for x in C.cosine_distance(df, "id", "a", "b", weights).collect()}
    merged = {x["id"]: x for x in C._merged_products(df, "id", "a", "b", weights, 2).collect()}
    assert len(got) == 32 and got[41] == pytest.approx(0)
    for i, dist in got.items():
        size = math.sqrt(merged[i]["xx"] * merged[i]["yy"]) if i in merged else 0
        assert dist == pytest.approx(1 - merged[i]["xy"] / size if size else 1)
    if not repeated:
        known = C._known_terms(weights)
        moved = {x["term"] for x in C._postings(df, "id", ("a", "b"), known, 2).collect()}
        assert {x["term"] for x in weights.collect()} >= {"red", "red bolt"} & moved and sum("rare" in t for t in moved) < 5


def test_noun_matches_move_no_texts(spark):
    from lexaline.operators import corpus as C

    df = spark.createDataFrame([(1, "big saw", "saw lamp bolt"), (1, "lamp", "saw lamp bolt"), (2, None, "saw"), (3, "x", "")], "id int, a string, b string")
    out = C.top_noun_matches(df, "id", "a", "b", C.idf(df, "b", 1, 1), 2)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0), (1, 1), (2, 0), (3, 0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "md5" in plan


def test_svd_by_brute_force(spark):
    import numpy as np

    from lexaline.operators import vectors as V

    r = random.Random(3)
    texts = [" ".join(r.choices("red bolt big saw steel wire lamp tool".split(), k=r.randint(1, 9))) for _ in range(40)] + ["once", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    weights = V.tfidf_weights(rows, "id", "t")
    terms = sorted({x["term"] for x in weights.collect()})
    matrix = np.zeros((len(texts), len(terms)))
    for x in weights.collect():
        matrix[x["id"], terms.index(x["term"])] = x["w"]
    right = np.linalg.svd(matrix)[2][:3]
    right *= np.where(right[np.arange(3), np.abs(right).argmax(axis=1)] < 0, -1, 1)[:, None]
    got = {x["id"]: x["svd"] for x in V.svd(weights, "id", rows, 3, rounds=8).collect()}
    assert sorted(got) == list(range(len(texts))) and all(got[i] == [0.0] * 3 for i in (40, 41, 42))
    assert np.abs(np.array([got[i] for i in range(len(texts))]) - matrix @ right.T).max() < 1e-3


def test_folds_of_any_size(spark):
    for n in (0, 1, 7, 23):
        got = sorted(r["fold"] for r in E.folds(spark.range(n), "id", 3).collect())
        assert got == sorted(min(2, next(f for f in range(3) if i < sum(n // 3 + (g < n % 3) for g in range(f + 1)))) for i in range(n))


def test_brand_fill_takes_the_longest_last_run(spark):
    cases = spark.createDataFrame([(1, "Acme Tools saw by Blue Line", None), (2, "x", None), (3, "acme", "kept")], "product_uid int, title string, brand string")
    brands = spark.createDataFrame([("acme",), ("Acme Tools",), ("BLUE LINE",), (None,)], "brand string")
    assert {r["product_uid"]: r["brand"] for r in R.fill_brand(cases, brands).collect()} == {1: "blue line", 2: None, 3: "kept"}


def test_losses(spark):
    row = spark.range(1).select(*[c.alias(f"{k}{i}") for k in ("square", "logistic", "expo") for i, c in enumerate(E.loss(k, F.lit(0.5), F.lit(1.0)))]).first()
    assert row["square0"] == 0.125 and row["logistic0"] == pytest.approx(math.log1p(math.exp(-0.5))) and row["expo1"] == pytest.approx(-math.exp(-0.5))
