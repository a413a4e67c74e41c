"""Choice among models: grids, bags of trials, importance of features; and model families built from several parts."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaline.models import evaluation as E
from lexaline.models import learners as M
from lexaline.operators.relational import clip

#: Columns of very many values, and those that linear models do without; names that a table lacks are passed over.
WIDE_COLUMNS = ("query_raw", "title_raw", "description_raw", "brand_raw", "search_term", "title", "description", "brand")


def without_columns(df: DataFrame, *lists: tuple[str, ...]) -> DataFrame:
    """``df`` without the columns of the lists; repeated and missing names don't matter, the key stays."""
    return df.drop(*{c for names in lists for c in names if c != "row_id"})


def grid_search(family: str, train: DataFrame, features: list[str], truth: str, grid: dict[str, list], key: str = "row_id", folds: int = 2) -> list[dict]:
    """Trials {loss, params} of all combinations of the grid by cross-validated RMSE, least first."""
    trials = []
    for values in itertools.product(*grid.values()):
        params = dict(zip(grid, values))
        row = M.out_of_fold(family, train, features, truth, key, folds, **params).agg(E.rmse(F.col("pred"), F.col("truth")).alias("e")).first()
        trials.append({"loss": row["e"], "params": params})
    return sorted(trials, key=lambda t: t["loss"])


def gram(preds: DataFrame, names: list[str], truth: str) -> tuple[dict, int]:
    """Sums of products of all pairs of prediction columns and the truth, from one aggregate, and the number of rows."""
    columns = [*names, truth]
    pairs = list(itertools.combinations_with_replacement(columns, 2))
    row = preds.agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]).first()
    sums = {}
    for i, (a, b) in enumerate(pairs):
        sums[a, b] = sums[b, a] = row[f"s{i}"] or 0.0
    return sums, row["n"]


def greedy(sums: dict, n: int, names: list[str], truth: str, most: int, replace: bool = True) -> tuple[list[str], float]:
    """Names whose mean predicts best, one added at a time while fewer than ``most``; the best prefix counts.

    All arithmetic is on the sums of products, so no step reads the rows again.
    """
    chosen: list[str] = []
    best: tuple[float, int] = (math.inf, 0)

    def error(members: list[str]) -> float:
        k = len(members)
        square = sum(sums[a, b] for a in members for b in members) / k**2 - 2 * sum(sums[a, truth] for a in members) / k + sums[truth, truth]
        return math.sqrt(max(0.0, square) / max(1, n))

    while len(chosen) < most:
        open_ = [x for x in names if replace or x not in chosen]
        if not open_:
            break
        value, name = min((error([*chosen, x]), x) for x in open_)
        chosen.append(name)
        best = min(best, (value, len(chosen)))
    return chosen[: best[1]], best[0]


def bagged_selection(preds: DataFrame, families: dict[str, list[str]], truth: str, bags: int = 20, share: float = 0.5, most: int = 10, seed: int = 2016) -> dict[str, float]:
    """Weight of each prediction column: its share among the members that greedy selection picks in all bags.

    A bag has ``share`` of the columns of each family of models, one at least. One pass over the rows serves all bags.
    """
    names = [x for members in families.values() for x in members]
    sums, n = gram(preds, names, truth)
    draw, counts = random.Random(seed), dict.fromkeys(names, 0)
    for _ in range(bags):
        bag = [x for members in families.values() for x in draw.sample(members, max(1, round(share * len(members))))]
        for x in greedy(sums, n, sorted(bag), truth, most)[0]:
            counts[x] += 1
    total = sum(counts.values()) or 1
    return {x: c / total for x, c in counts.items()}


def blended(weights: dict[str, float]) -> Column:
    """Weighted sum of prediction columns."""
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.col(name) * w
    return out


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by their share of a tree model's gains, or the absolute weights of a linear one; greatest first."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else [abs(w) for w in last.coefficients]
    values = [float(values[i]) for i in range(len(features))]
    return sorted(zip(features, values), key=lambda x: (-x[1], x[0]))


def distance_report(preds: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, distance) of all pairs of prediction columns: 1 - correlation, the most alike first; one pass."""
    pairs = list(itertools.combinations(names, 2))
    row = preds.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (1 - F.col(f"c{i}")).alias("distance")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(table).alias("r")).select("r.*").orderBy("distance", "a", "b")


# ---- families of several parts


def three_part(train: DataFrame, test: DataFrame, features: list[str], truth: str, key: str = "row_id", trees: int = 20) -> DataFrame:
    """(key, pred): the mean of three classifiers of the relevance in thirds, cut down, to the middle and up."""
    thirds = F.floor(3 * F.col(truth) + 0.5).cast("int")
    cuts = {"low": 0, "mid": 2, "high": 1}
    rows = M.numeric(train, features).where(F.col(truth).isNotNull())
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    asked = assembler.transform(M.numeric(test, features))
    for name, least in cuts.items():
        up = F.when(thirds % 3 >= least, 1).otherwise(0) if least else F.lit(0)
        labelled = assembler.transform(rows.withColumn("label", (F.floor(thirds / 3) + up).cast("double")))
        model = RandomForestClassifier(numTrees=trees, seed=M.SEED).fit(labelled)
        asked = model.transform(asked).withColumn(name, F.col("prediction")).drop("rawPrediction", "probability", "prediction")
    return asked.select(key, clip((F.col("low") + F.col("mid") + F.col("high")) / 3).alias("pred"))


def extra_trees(train: DataFrame, test: DataFrame, features: list[str], truth: str, key: str = "row_id", trees: int = 10, cuts: int = 8, depth: int = 10) -> DataFrame:
    """(key, pred): the mean of extremely randomised trees. Every tree sees each feature through ``cuts`` thresholds drawn
    between its least and greatest value, so it splits at random thresholds only, all rows and a third of the features at a
    time."""
    rows = M.numeric(train, features).where(F.col(truth).isNotNull()).withColumn("label", F.col(truth).cast("double"))
    ends = rows.agg(*[F.min(f).alias(f"low{i}") for i, f in enumerate(features)], *[F.max(f).alias(f"high{i}") for i, f in enumerate(features)]).first()
    draw = random.Random(M.SEED)
    asked = M.numeric(test, features)
    for t in range(trees):
        borders = [sorted(draw.uniform(ends[f"low{i}"] or 0.0, ends[f"high{i}"] or 0.0) for _ in range(cuts)) for i in range(len(features))]

        def seen(df: DataFrame, borders=borders) -> DataFrame:
            placed = [F.size(F.filter(F.array(*[F.lit(b) for b in borders[i]]), _above(f))).cast("double").alias(f"b{i}") for i, f in enumerate(features)]
            return VectorAssembler(inputCols=[f"b{i}" for i in range(len(features))], outputCol="features").transform(df.select("*", *placed)).drop(*[f"b{i}" for i in range(len(features))])

        tree = RandomForestRegressor(numTrees=1, bootstrap=False, featureSubsetStrategy="onethird", maxDepth=depth, seed=M.SEED + t).fit(seen(rows))
        asked = tree.transform(seen(asked)).withColumnRenamed("prediction", f"tree{t}").drop("features")
    total = sum((F.col(f"tree{t}") for t in range(1, trees)), F.col("tree0"))
    return asked.select(key, clip(total / trees).alias("pred"))


def _above(feature: str):
    return lambda border: border < F.col(feature)


def kernel_features(x: Column, n_inputs: int, n: int, gamma: float, seed: int = 2016) -> Column:
    """Random Fourier features of an array column: their inner products approximate the kernel exp(-gamma |x - y|^2)."""
    draw = random.Random(seed)
    spread = math.sqrt(2 * gamma)
    out = []
    for _ in range(n):
        w = F.array(*[F.lit(draw.gauss(0, spread)) for _ in range(n_inputs)])
        shift = draw.uniform(0, 2 * math.pi)
        angle = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        out.append(F.cos(angle + shift) * math.sqrt(2 / n))
    return F.array(*out)


def kernel_machine(train: DataFrame, test: DataFrame, features: list[str], truth: str, key: str = "row_id", n: int = 64, gamma: float = 1.0, margin: float = 1.35, penalty: float = 0.001) -> DataFrame:
    """(key, pred): a robust linear fit over random features of the radial kernel, inputs scaled to 0..1.

    The loss is linear beyond ``margin`` deviations, as that of a support vector machine is beyond its tube.
    """
    from pyspark.ml.functions import array_to_vector

    rows = M.numeric(train, features).where(F.col(truth).isNotNull()).withColumn("label", F.col(truth).cast("double"))
    scaler = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), MinMaxScaler(inputCol="raw", outputCol="scaled")]).fit(rows)

    def lifted(df: DataFrame) -> DataFrame:
        return scaler.transform(df).withColumn("features", array_to_vector(kernel_features(vector_to_array("scaled"), len(features), n, gamma)))

    model = LinearRegression(loss="huber", epsilon=margin, regParam=penalty, maxIter=50).fit(lifted(rows))
    return model.transform(lifted(M.numeric(test, features))).select(key, clip(F.col("prediction")).alias("pred"))


def weighted_union(parts: list[tuple[list[str], float]]) -> tuple[list[str], list[float]]:
    """Columns of several groups of features with the weight of their group, as one list."""
    return [c for names, _ in parts for c in names], [w for names, w in parts for _ in names]


def fit_weighted(train: DataFrame, parts: list[tuple[list[str], float]], truth: str, **params) -> tuple[PipelineModel, list[str]]:
    """Ridge regression over groups of columns, each times its group's weight, which says how little it is penalised."""
    names, weights = weighted_union(parts)
    scaled = M.numeric(train, names).withColumns({c: F.col(c) * w for c, w in zip(names, weights)})
    return M.fit("ridge", scaled, names, truth, **params), names


def predict_weighted(model: PipelineModel, df: DataFrame, parts: list[tuple[list[str], float]], key: str = "row_id") -> DataFrame:
    names, weights = weighted_union(parts)
    return M.predict(model, M.numeric(df, names).withColumns({c: F.col(c) * w for c, w in zip(names, weights)}), names, key)
