"""Regularised greedy forest for square loss, after Johnson and Zhang (TPAMI 2014).

The forest grows one split at a time: the best of the newest tree's leaves and of a new root, by penalised loss; after
every ``refit_every`` leaves all leaf weights are corrected together. Every distinct value of a feature is a border; only
features of more than ``MAX_DISTINCT`` values have ``n_bins`` - 1 quantiles instead. The histograms of a step are one aggregate over the rows, so the data stays distributed; the trees stay on the driver.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values up to which all of a feature's values are borders.
MAX_DISTINCT = 1000


@dataclass
class Node:
    tree: int
    path: tuple[tuple[str, float, bool], ...]
    weight: float = 0.0


@dataclass
class GreedyForest:
    base: float
    leaves: list[Node] = field(default_factory=list)

    def predict(self) -> Column:
        """Sum of the weights of the leaves that a row falls into."""
        out = F.lit(self.base)
        for leaf in self.leaves:
            out = out + F.when(_inside(leaf), leaf.weight).otherwise(0.0)
        return out


def _inside(node: Node) -> Column:
    held = F.lit(True)
    for name, border, left in node.path:
        held = held & ((F.col(name) <= border) if left else (F.col(name) > border))
    return held


def _place(df: DataFrame, feature: str, n_bins: int) -> Column:
    """The least border that is not below the row's value: the value itself where all are borders. Nulls are least."""
    value = F.col(feature).cast("double")
    least = F.lit(float("-inf"))
    if df.select(feature).distinct().limit(MAX_DISTINCT + 1).count() <= MAX_DISTINCT:
        return F.coalesce(value, least)
    cuts = df.select(F.percentile_approx(feature, [i / n_bins for i in range(1, n_bins)])).first()[0]
    borders = F.array(*[F.lit(float(b)) for b in sorted(set(cuts))])
    return F.when(value.isNull(), least).otherwise(F.coalesce(F.get(F.filter(borders, lambda b: b >= value), F.lit(0)), F.lit(float("inf"))))


@dataclass(frozen=True)
class Penalty:
    """L2 penalty of a leaf's weight, times ``by_depth`` for each split above it."""

    base: float
    by_depth: float = 1.0

    def at(self, depth: int) -> float:
        return self.base * self.by_depth**depth


def _step(s: float, n: float, w: float, penalty: float) -> float:
    """Best change of the weight w of rows with residual sum s and total weight n."""
    return (s - penalty * w) / (n + penalty)


def _best(df: DataFrame, features: list[str], places: dict[str, Column], nodes: list[Node], forest: GreedyForest, truth: str, penalty: Penalty, least: int):
    residual = (F.col(truth) - forest.predict()) * F.col("_w")
    rows = df.withColumn("_r", residual).withColumn("_nodes", F.array_compact(F.array(*[F.when(_inside(x), F.lit(i)) for i, x in enumerate(nodes)])))
    # a struct loses the names of its fields if one of them is made by a lambda, so places are columns first
    rows = rows.withColumns({f"_b{i}": places[f] for i, f in enumerate(features)})
    bins = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"_b{i}").alias("b")) for i, f in enumerate(features)])
    table = rows.select("_r", "_w", F.explode("_nodes").alias("node"), bins.alias("bins")).select("_r", "_w", "node", F.explode("bins").alias("x"))
    found = table.groupBy("node", "x.f", "x.b").agg(F.sum("_r").alias("s"), F.sum("_w").alias("w"), F.count("*").alias("n")).collect()  # nodes x features x borders, at most MAX_DISTINCT of them
    cells: dict[tuple[int, str], list] = {}
    for r in found:
        cells.setdefault((r["node"], r["f"]), []).append((r["b"], r["s"], r["w"], r["n"]))
    best = None
    for (i, f), values in sorted(cells.items()):
        node = nodes[i]
        own, below = penalty.at(len(node.path)), penalty.at(len(node.path) + 1)
        values.sort()
        total = [sum(c[k] for c in values) for k in (1, 2, 3)]
        left = [0.0, 0.0, 0]
        for b, *sums in values[:-1]:
            left = [x + y for x, y in zip(left, sums)]
            right = [x - y for x, y in zip(total, left)]
            if left[2] < least or right[2] < least:
                continue
            steps = [_step(s, n, node.weight, below) for s, n, _ in (left, right)]
            gain = sum(q * q * (n + below) / 2 for q, (_, n, _) in zip(steps, (left, right))) + (own - 2 * below) * node.weight**2 / 2
            if best is None or gain > best[0] + 1e-12:
                best = (gain, i, f, b, node.weight + steps[0], node.weight + steps[1])
    return best


def fit(
    df: DataFrame,
    features: list[str],
    truth: str,
    max_leaves: int = 8,
    penalty: float = 1.0,
    refit_every: int = 4,
    least: int = 10,
    n_bins: int = 64,
    weight: str | None = None,
    depth_penalty: float = 1.0,
    feature_share: float = 1.0,
    seed: int = 2016,
    start: GreedyForest | None = None,
) -> GreedyForest:
    """Forest of ``max_leaves`` leaves at most for square loss.

    Rows count by ``weight`` (null and missing: 1). A leaf's penalty grows by ``depth_penalty`` with each split above it. Every
    step looks at ``feature_share`` of the features, drawn by ``seed``. ``start`` is a forest to go on from.
    """
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    df = df.select(*features, truth, w.alias("_w")).where(F.col(truth).isNotNull()).persist()
    places = {f: _place(df, f, n_bins) for f in features}
    grows = Penalty(penalty, depth_penalty)
    if start is None:
        mean = df.agg(F.try_divide(F.sum(F.col(truth) * F.col("_w")), F.sum("_w"))).first()[0]
        forest = GreedyForest(float(mean or 0.0))
    else:
        forest = GreedyForest(start.base, [Node(x.tree, x.path, x.weight) for x in start.leaves])
    draw = random.Random(seed)
    tree = max((x.tree for x in forest.leaves), default=0)
    while len(forest.leaves) < max_leaves:
        newest = [x for x in forest.leaves if x.tree == tree]
        looked = sorted(draw.sample(features, max(1, round(feature_share * len(features)))))
        # a new tree brings two leaves, a split of a leaf one more
        nodes = [*newest, *([Node(tree + 1, ())] if len(forest.leaves) + 2 <= max_leaves else [])]
        best = _best(df, looked, places, nodes, forest, truth, grows, least) if nodes else None
        if best is None:
            break
        _, i, f, border, left, right = best
        old = nodes[i]
        tree = old.tree
        forest.leaves = [x for x in forest.leaves if x is not old] + [Node(old.tree, (*old.path, (f, border, True)), left), Node(old.tree, (*old.path, (f, border, False)), right)]
        if len(forest.leaves) % refit_every == 0:
            _correct(df, forest, truth, grows)
    df.unpersist()
    return forest


def _correct(df: DataFrame, forest: GreedyForest, truth: str, penalty: Penalty, rounds: int = 2, step: float = 0.5) -> None:
    """Damped Newton steps of all weights, from one aggregate a round."""
    for _ in range(rounds):
        rows = df.withColumn("_r", (F.col(truth) - forest.predict()) * F.col("_w"))
        sums = rows.agg(*[F.sum(F.when(_inside(x), F.col("_r"))).alias(f"s{i}") for i, x in enumerate(forest.leaves)], *[F.sum(F.when(_inside(x), F.col("_w"))).alias(f"n{i}") for i, x in enumerate(forest.leaves)]).first()
        for i, x in enumerate(forest.leaves):
            x.weight += step * _step(sums[f"s{i}"] or 0.0, sums[f"n{i}"] or 0.0, x.weight, penalty.at(len(x.path)))


def leaf_indicators(forest: GreedyForest) -> dict[str, Column]:
    """A 0/1 column for each leaf that has a weight."""
    return {f"leaf_{i}": _inside(x).cast("int") for i, x in enumerate(forest.leaves) if x.weight}


def rules(forest: GreedyForest) -> list[tuple[str, int, int, float]]:
    """(condition, number of leaves that have it, splits, total weight), the heaviest first: equal rules of several trees are one."""
    found: dict[str, list] = {}
    for x in forest.leaves:
        text = " and ".join(f"{f} {'<=' if left else '>'} {border:g}" for f, border, left in sorted(x.path))
        row = found.setdefault(text, [0, len(x.path), 0.0])
        row[0] += 1
        row[2] += x.weight
    return sorted(((t, n, d, w) for t, (n, d, w) in found.items()), key=lambda r: (-abs(r[3]), r[0]))


def evaluation(df: DataFrame, forest: GreedyForest, truth: str, threshold: float | None = None) -> DataFrame:
    """One row: trees, leaves, depths, and over the rows with a truth their number, square error, rmse and, with a
    threshold, the share of rows that the forest puts on the right side of it."""
    depths = [len(x.path) for x in forest.leaves] or [0]
    error = F.col(truth) - forest.predict()
    right = (forest.predict() >= threshold) == (F.col(truth) >= threshold) if threshold is not None else F.lit(None).cast("boolean")
    return df.where(F.col(truth).isNotNull()).agg(
        F.lit(len({x.tree for x in forest.leaves})).alias("trees"),
        F.lit(len(forest.leaves)).alias("leaves"),
        F.lit(max(depths)).alias("max_depth"),
        F.lit(sum(depths) / len(depths)).alias("mean_depth"),
        F.count("*").alias("rows"),
        F.sum(error * error).alias("square_error"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(right.cast("double")).alias("accuracy"),
    )
