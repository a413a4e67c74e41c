"""Queries of model selection and of the families built from several parts; SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaline.models import evaluation as E
from lexaline.models import learners
from lexaline.models import selection as L
from lexaline.operators import relational as B
from lexaline.oracles import PREDS
from lexaline.plans import corpus_features as K
from lexaline.plans import registry
from lexaline.plans import run as R
from lexaline.queries import NUMERIC, Query, _model_rows, _preds, r6
from lexaline.sources import files as P
from lexaline.sources import tables as S

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("ml_three_part")
def ml_three_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _model_rows(spark, sf_dir)
    return L.three_part(rows, rows, NUMERIC, "relevance")


@query("ml_extra")
def ml_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _model_rows(spark, sf_dir)
    return L.extra_trees(rows, rows, NUMERIC, "relevance")


@query("ml_kernel")
def ml_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _model_rows(spark, sf_dir)
    return L.kernel_machine(rows, rows, NUMERIC, "relevance")


@query("ml_grid")
def ml_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = L.grid_search("ridge", _model_rows(spark, sf_dir), NUMERIC, "relevance", {"regParam": [0.01, 0.1, 1.0]})
    return spark.createDataFrame([(float(t["loss"]), float(t["params"]["regParam"])) for t in trials], "loss double, penalty double")


@query("ml_importance")
def ml_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = learners.fit("forest", _model_rows(spark, sf_dir), NUMERIC, "relevance", numTrees=20)
    return spark.createDataFrame(L.importance(model, NUMERIC), "feature string, importance double")


@query("ml_weighted_union")
def ml_weighted_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts at full weight, ratios at half and lengths at a quarter."""
    rows = _model_rows(spark, sf_dir)
    parts = [(NUMERIC[:2], 1.0), (NUMERIC[4:7], 0.5), (NUMERIC[2:4] + NUMERIC[7:], 0.25)]
    return L.predict_weighted(L.fit_weighted(rows, parts, "relevance")[0], rows, parts)


@query("ens_bagged")
def ens_bagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = L.bagged_selection(_preds(spark, sf_dir), {"near": ["p1", "p3"], "far": ["p2"]}, "y")
    return spark.createDataFrame(sorted(weights.items()), "trial string, weight double")


@query("ev_distance_report", f"WITH {PREDS}, c AS (SELECT corr(p1, p2) AS a, corr(p1, p3) AS b, corr(p2, p3) AS c FROM preds) SELECT 'p1' AS a, 'p2' AS b, round(1 - c.a, 6) AS distance FROM c UNION ALL SELECT 'p1', 'p3', round(1 - c.b, 6) FROM c UNION ALL SELECT 'p2', 'p3', round(1 - c.c, 6) FROM c")
def ev_distance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.distance_report(_preds(spark, sf_dir), ["p1", "p2", "p3"]).select("a", "b", r6(F.col("distance")).alias("distance"))


@query("ens_blend", f"WITH {PREDS} SELECT l_orderkey, l_linenumber, round(p1 * 0.5 + p2 * 0.3 + p3 * 0.2, 6) AS pred FROM preds")
def ens_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preds(spark, sf_dir).select("l_orderkey", "l_linenumber", r6(L.blended({"p1": 0.5, "p2": 0.3, "p3": 0.2})).alias("pred"))


@query("rel_drop_lists", "SELECT p_partkey, p_size, p_retailprice FROM part")
def rel_drop_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.without_columns(S.table(spark, sf_dir, "part"), ("p_name", "p_brand", "none"), ("p_type", "p_name"))


@query("run_configured")
def run_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {"model": "ridge", "features": NUMERIC, "params": {"regParam": 0.1}}
    return R.run(S.search_cases(spark, sf_dir), P.scratch(spark, "run"), given)[0]


@query("features_corpus")
def features_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All corpus-level features but the singular vectors, of every search case."""
    names = [n for n in K.NAMES if not n.startswith(("raw_svd", "q_t_", "q_d_"))]
    return K.with_corpus_features(registry.raw_cases(S.search_cases(spark, sf_dir)), names).select("row_id", *names)


@query("features_svd")
def features_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["raw_svd_T", "q_t_11gram"]
    return K.with_corpus_features(registry.raw_cases(S.search_cases(spark, sf_dir)), names).select("row_id", *names)


@query("ml_forest_evaluation")
def ml_forest_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation line of a greedy forest, with weights by row and a penalty that grows with depth."""
    from lexaline.models import greedy_forest as G

    rows = _model_rows(spark, sf_dir).withColumn("w", 1.0 + F.col("row_id") % 2)
    return G.evaluation(rows, G.fit(rows, NUMERIC, "relevance", max_leaves=4, weight="w", depth_penalty=1.5), "relevance", 2.0)


@query("ml_forest_leaves")
def ml_forest_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexaline.models import greedy_forest as G

    rows = _model_rows(spark, sf_dir)
    forest = G.fit(rows, NUMERIC, "relevance", max_leaves=4)
    return rows.select("row_id", *[c.alias(n) for n, c in G.leaf_indicators(forest).items()])


@query("ev_break_even", f"WITH {PREDS}, r AS (SELECT y > 30 AS t, row_number() OVER (ORDER BY p1 DESC, l_orderkey * 10 + l_linenumber) AS k, count(*) FILTER (y > 30) OVER () AS n FROM preds) SELECT max(n) AS positives, round(count(*) FILTER (t AND k <= n) / max(n), 6) AS break_even FROM r")
def ev_break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _preds(spark, sf_dir).select("p1", (F.col("y") - 30).alias("y"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"))
    return E.break_even(rows, "p1", "y", "key").select("positives", r6(F.col("break_even")).alias("break_even"))


_LOSS = "SELECT l_quantity / 10 - 2.5 AS p, CASE WHEN l_tax > 0.04 THEN 1.0::DOUBLE ELSE -1.0 END AS y FROM lineitem"


@query("ev_mean_loss", f"SELECT round(avg((p - y) * (p - y) / 2), 6) AS square, round(avg(ln(1 + exp(-y * p))), 6) AS logistic, round(avg(exp(-y * p)), 6) AS expo FROM ({_LOSS})")
def ev_mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = F.col("l_quantity") / 10 - 2.5, F.when(F.col("l_tax") > 0.04, 1.0).otherwise(-1.0)
    return S.table(spark, sf_dir, "lineitem").agg(*[r6(F.avg(E.loss(k, p, y)[0])).alias(k) for k in ("square", "logistic", "expo")])


@query("rel_left_join_description", "SELECT doc_id AS product_uid, source AS brand, CASE WHEN doc_id % 2 = 0 THEN text END AS description FROM documents")
def rel_left_join_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("product_uid"), F.col("source").alias("brand"))
    return B.with_description(rows, docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("product_uid"), F.col("text").alias("description")), "product_uid")


@query("rel_positional_join", "WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS k FROM part), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) SELECT p_partkey, o_orderkey FROM a JOIN b USING (k)")
def rel_positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.side_by_side(S.table(spark, sf_dir, "part").select("p_partkey"), S.table(spark, sf_dir, "orders").select("o_orderkey"), "p_partkey", "o_orderkey")


@query("rel_concat_preds", f"WITH {PREDS} SELECT l_orderkey, l_linenumber, 'p1' AS trial, round(p1, 6) AS pred FROM preds UNION ALL SELECT l_orderkey, l_linenumber, 'p2', round(p2, 6) FROM preds")
def rel_concat_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two trials, one under the other."""
    parts = [_preds(spark, sf_dir).select("l_orderkey", "l_linenumber", F.lit(p).alias("trial"), r6(F.col(p)).alias("pred")) for p in ("p1", "p2")]
    return parts[0].unionByName(parts[1])
