"""Labels, losses, votes, folds and ensembles as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaline.operators.relational import before_parts, in_order

#: Labels of the ordinal model, and the margins of its "less than" classifiers.
ORDINAL_LABELS = (1.0, 1.33, 1.67, 2.0, 2.33, 2.67, 3.0)
MARGINS = (1.2, 1.5, 1.8, 2.2, 2.5, 2.8)


#: Blocks of neighbouring keys in which folds() ranks rows.
FOLD_BLOCKS = 200


def folds(df: DataFrame, order: str, k: int) -> DataFrame:
    """Contiguous folds 0 .. k-1 by a numeric key without nulls; the first n mod k have one row more.

    A row's place is its rank in a block of neighbouring keys plus the sizes of the blocks before: blocks end at fixed
    quantiles, so every run, and every retried task, deals the rows alike.
    """
    ends = sorted(set(df.agg(F.percentile_approx(order, [i / FOLD_BLOCKS for i in range(1, FOLD_BLOCKS)]).alias("p")).first()["p"] or []))
    block = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col(order))) if ends else F.lit(0)
    parts = df.withColumn("_part", block)
    counts = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}
    total, starts = 0, []
    for p in sorted(counts):
        starts += [F.lit(p), F.lit(total)]
        total += counts[p]
    if not total:
        return df.withColumn("fold", F.lit(0))
    place = F.element_at(F.create_map(*starts), F.col("_part")) + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    small, more = divmod(total, k)
    fold = F.when(F.col("_place") < more * (small + 1), F.floor(F.col("_place") / (small + 1))).otherwise(more + F.floor((F.col("_place") - more * (small + 1)) / max(small, 1)))
    return parts.withColumn("_place", place).withColumn("fold", fold.cast("int")).drop("_part", "_place")


def hashed_folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """Folds by a hash of the key: no order, no shuffle, for cross-validation at any size."""
    return df.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(k)).cast("int"))


def rmse(pred: Column, truth: Column) -> Column:
    return F.sqrt(F.avg((pred - truth) * (pred - truth)))


def three_parts(y: Column) -> tuple[Column, Column, Column]:
    """Low, middle and high whole-number readings of a relevance counted in thirds."""
    x = F.floor(3 * y + 0.5)
    low = F.floor(x / 3)
    return low, low + F.when(x % 3 >= 2, 1).otherwise(0), low + F.when(x % 3 >= 1, 1).otherwise(0)


def ordinal_vote(probabilities: list[Column]) -> Column:
    """Label from the chances p_i that the relevance lies below margin i.

    p_i is spread over the labels up to i, 1 - p_i over the rest; the label with the greatest sum wins, the last of equals.
    """
    m = len(probabilities)
    sums = []
    for j in range(m + 1):
        terms = [p / (i + 1) if j <= i else (1 - p) / (m - i) for i, p in enumerate(probabilities)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        sums.append(total)
    best = F.greatest(*sums)
    out = F.lit(ORDINAL_LABELS[0])
    for label, s in zip(ORDINAL_LABELS, sums):
        out = F.when(s == best, F.lit(label)).otherwise(out)
    return out


def loss(kind: str, p: Column, y: Column) -> tuple[Column, Column, Column]:
    """(value, first, second derivative by p) of square, logistic or exponential loss; exponents clamped at 500."""
    if kind == "square":
        return (p - y) * (p - y) / 2, p - y, F.lit(1.0)
    margin = F.least(F.greatest(-y * p, F.lit(-500.0)), F.lit(500.0))
    e = F.exp(margin)
    if kind == "logistic":
        return F.log1p(e), -y * e / (1 + e), e / ((1 + e) * (1 + e))
    return e, -y * e, e


def classification_report(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of signs, and rmse, in one row."""
    p, y = F.col(pred) > 0, F.col(truth) > 0
    counts = df.agg(F.count("*").alias("n"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), rmse(F.col(pred), F.col(truth)).alias("rmse"))
    zero = F.lit(0.0)
    return counts.select("n", ((F.col("n") - F.col("fp") - F.col("fn")) / F.col("n")).alias("accuracy"), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero).alias("precision"), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), zero).alias("recall"), F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero).alias("f1"), "rmse")


def break_even(df: DataFrame, pred: str, truth: str, key: str) -> DataFrame:
    """(positives, break_even): the share of true ones among as many rows of greatest prediction as there are true ones, where
    precision and recall are equal; of equal predictions the least key comes first, null predictions come last."""
    true = F.coalesce(F.col(truth) > 0, F.lit(False))
    scored = df.select((-F.coalesce(F.col(pred).cast("double"), F.lit(float("-inf")))).alias("rank_by"), F.col(key).alias("key"), true.alias("y"))
    ordered = in_order(scored, ["rank_by", "key"], "break-even")
    before = before_parts(ordered, [], {"before": F.count("*")})
    total = ordered.agg(F.count_if("y").alias("positives"))
    ranked = ordered.join(F.broadcast(before), "part").crossJoin(F.broadcast(total)).where(F.col("before") + F.col("at") < F.col("positives"))
    hits = ranked.agg(F.count_if("y").alias("hits"))
    return total.crossJoin(hits).select("positives", F.try_divide("hits", "positives").alias("break_even"))


def best_split(df: DataFrame, features: list[str], residual: str, penalty: float, least: int = 10) -> DataFrame:
    """(feature, border, gain): the split of each feature that lowers the L2-penalised square loss most.

    One aggregate for each value of each feature, then running sums over range partitions of the values: no row is looked
    at twice, and no task has all values of a feature.
    """
    long = df.unpivot([residual], features, "feature", "value").groupBy("feature", "value").agg(F.sum(residual).alias("s"), F.count("*").alias("n"))
    ordered = in_order(long, ["feature", "value"], "split")
    before = before_parts(ordered, ["feature"], {"s0": F.sum("s"), "n0": F.sum("n")})
    totals = ordered.groupBy("feature").agg(F.sum("s").alias("st"), F.sum("n").alias("nt"))
    w = Window.partitionBy("part", "feature").orderBy("at")
    run = ordered.withColumn("s1", F.sum("s").over(w)).withColumn("n1", F.sum("n").over(w)).join(F.broadcast(before), ["part", "feature"]).join(F.broadcast(totals), "feature")
    run = run.select("feature", "value", (F.col("s0") + F.col("s1")).alias("sl"), (F.col("n0") + F.col("n1")).alias("nl"), "st", "nt")
    part = lambda s, n: s * s / (n + penalty) / 2
    sl, nl, st, nt = (F.col(c) for c in ("sl", "nl", "st", "nt"))
    scored = run.where((nl >= least) & (nt - nl >= least)).select("feature", F.col("value").alias("border"), (part(sl, nl) + part(st - sl, nt - nl) - part(st, nt)).alias("gain"))
    return scored.groupBy("feature").agg(F.max_by("border", F.struct(F.round("gain", 6), -F.col("border"))).alias("border"), F.max("gain").alias("gain"))


def gram(preds: DataFrame, names: list[str], truth: str) -> dict[tuple[str, str], float]:
    """Sums of products of all predictions and the truth: all that greedy selection needs, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate([*names, truth]) for b in [*names, truth][i:]]
    row = preds.agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs]).first()
    out = {("n", "n"): float(row["n"])}
    for a, b in pairs:
        out[a, b] = out[b, a] = row[f"{a}*{b}"]
    return out


def greedy_selection(preds: DataFrame, names: list[str], truth: str, most: int, replace: bool = True) -> list[tuple[str, float]]:
    """(name, rmse so far) of forward selection: each step adds the prediction that lowers the mean's error most."""
    g = gram(preds, names, truth)
    chosen: list[str] = []
    out = []

    def error(members: list[str]) -> float:
        k = len(members)
        squares = sum(g[a, b] for a in members for b in members) / k**2 - 2 * sum(g[a, truth] for a in members) / k + g[truth, truth]
        return (max(squares, 0.0) / g["n", "n"]) ** 0.5

    while len(chosen) < most:
        options = [(error([*chosen, n]), n) for n in names if replace or n not in chosen]
        if not options:
            break
        best, name = min(options)
        chosen.append(name)
        out.append((name, best))
    return out
