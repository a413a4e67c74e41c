"""Model families over Spark ML: fitting, out-of-fold predictions, search, stacking."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import MinMaxScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaline.models import evaluation as E
from lexaline.operators.relational import clip
from lexaline.sources.files import stored

SEED = 2016
#: Spark's trees are 30 deep at most.
FAMILIES: dict[str, Callable[..., object]] = {
    "forest": lambda **p: RandomForestRegressor(labelCol="label", seed=SEED, **{"numTrees": 50, "maxDepth": 10, **p}),
    "extra": lambda **p: RandomForestRegressor(labelCol="label", seed=SEED, bootstrap=False, featureSubsetStrategy="onethird", **{"numTrees": 50, "maxDepth": 10, **p}),
    "boosted": lambda **p: GBTRegressor(labelCol="label", seed=SEED, **{"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.7, **p}),
    "ridge": lambda **p: LinearRegression(labelCol="label", elasticNetParam=0.0, **{"regParam": 0.5, **p}),
    "linear": lambda **p: LinearRegression(labelCol="label", **p),
    "lasso": lambda **p: LinearRegression(labelCol="label", elasticNetParam=1.0, **{"regParam": 0.01, **p}),
}


def fit(family: str, train: DataFrame, features: list[str], truth: str, **params) -> PipelineModel:
    """Model of ``truth`` from numeric or boolean ``features``; rows without a truth are left out."""
    rows = numeric(train, features).where(F.col(truth).isNotNull()).withColumn("label", F.col(truth).cast("double"))
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), FAMILIES[family](**params)]
    return Pipeline(stages=stages).fit(rows)


def numeric(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


def predict(model: PipelineModel, df: DataFrame, features: list[str], key: str = "row_id") -> DataFrame:
    """(key, pred), predictions clipped to 1..3."""
    return model.transform(numeric(df, features)).select(key, clip(F.col("prediction")).alias("pred"))


def out_of_fold(family: str, train: DataFrame, features: list[str], truth: str, key: str = "row_id", k: int = 3, **params) -> DataFrame:
    """(key, pred, truth) of every row, predicted by a model that hasn't seen its fold."""
    split = stored(E.hashed_folds(train.where(F.col(truth).isNotNull()), key, k).select(key, truth, "fold", *[c for c in features if c not in (key, truth)]), "folds")
    parts = [predict(fit(family, split.where(F.col("fold") != i), features, truth, **params), split.where(F.col("fold") == i), features, key) for i in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(split.select(key, F.col(truth).alias("truth")), key)


def search(family: str, train: DataFrame, features: list[str], truth: str, space: dict[str, list], evals: int = 5, key: str = "row_id", subset: float = 1.0) -> list[dict]:
    """Seeded random search: trials {loss, params, features} by loss, least first."""
    draw, trials = random.Random(SEED), []
    for _ in range(evals):
        params = {name: draw.choice(values) for name, values in sorted(space.items())}
        chosen = sorted(draw.sample(features, max(1, round(subset * len(features)))))
        row = out_of_fold(family, train, chosen, truth, key, 2, **params).agg(E.rmse(F.col("pred"), F.col("truth")).alias("e")).first()
        trials.append({"loss": row["e"], "params": params, "features": chosen})
    return sorted(trials, key=lambda t: t["loss"])


def _beside(preds: dict[str, DataFrame], rows: DataFrame, key: str) -> DataFrame:
    for name, df in preds.items():
        rows = rows.join(df.select(key, F.col("pred").alias(name)), key)
    return rows


def stacked(level_one: dict[str, DataFrame], truth: DataFrame, asked: dict[str, DataFrame], key: str = "row_id") -> tuple[PipelineModel, DataFrame]:
    """Ridge regression over the predictions of several models: fitted on out-of-fold ones, which no model made of rows it had
    seen, and applied to those of the same models for the rows asked for."""
    rows = _beside(level_one, truth, key)
    model = fit("ridge", rows, list(level_one), "truth", regParam=0.01)
    keys = next(iter(asked.values())).select(key)
    return model, predict(model, _beside(asked, keys, key), list(level_one), key)


def ordinal(train: DataFrame, test: DataFrame, features: list[str], truth: str, key: str = "row_id") -> DataFrame:
    """(key, label) by vote of classifiers that say whether the relevance lies below each margin."""
    rows = numeric(train, features).where(F.col(truth).isNotNull())
    scaler = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), MinMaxScaler(inputCol="raw", outputCol="features")]).fit(rows)
    rows, asked = scaler.transform(rows), scaler.transform(numeric(test, features))
    for i, margin in enumerate(E.MARGINS):
        below = rows.withColumn("label", (F.col(truth) < margin).cast("double"))
        if below.select("label").distinct().count() < 2:
            asked = asked.withColumn(f"p{i}", F.lit(float(below.first()["label"])))
            continue
        model = LogisticRegression(maxIter=30, regParam=0.01).fit(below)
        asked = model.transform(asked).withColumn(f"p{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    return asked.select(key, E.ordinal_vote([F.col(f"p{i}") for i in range(len(E.MARGINS))]).alias("label"))


def classes(train: DataFrame, test: DataFrame, features: list[str], truth: str, key: str = "row_id") -> DataFrame:
    """(key, label) by a random-forest classifier over the relevance values as classes."""
    rows = numeric(train, features).where(F.col(truth).isNotNull()).withColumn("name", F.col(truth).cast("string"))
    indexer = StringIndexer(inputCol="name", outputCol="label").fit(rows)
    steps = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), RandomForestClassifier(numTrees=20, seed=SEED)]).fit(indexer.transform(rows))
    names = F.array(*[F.lit(float(x)) for x in indexer.labels])
    return steps.transform(numeric(test, features)).select(key, F.get(names, F.col("prediction").cast("int")).alias("label"))
