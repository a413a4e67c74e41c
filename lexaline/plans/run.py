"""A configured run from end to end: settings, features from the store, a model, predictions and a submission file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaline.models import evaluation as E
from lexaline.models import learners
from lexaline.plans import corpus_features, registry, store
from lexaline.sources import files

DEFAULTS = {"model": "ridge", "features": [], "recompute_features": [], "not_save": [], "num_train": None, "folds": 3, "params": {}, "drop": []}


def settings(given: dict) -> dict:
    """The settings over the defaults; unknown names and features are errors."""
    unknown = set(given) - set(DEFAULTS)
    if unknown:
        raise KeyError(f"unknown settings: {sorted(unknown)}")
    made = DEFAULTS | given
    missing = [f for f in made["features"] if f not in registry.REGISTRY and f not in corpus_features.NAMES]
    if missing:
        raise KeyError(f"unknown features: {missing}")
    if made["model"] not in learners.FAMILIES:
        raise KeyError(f"unknown model: {made['model']}")
    return made


def sampled(cases: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` train rows and the last ``n`` test rows by row_id; all rows if None."""
    if n is None:
        return cases
    first = cases.where("split = 'train'").orderBy("row_id").limit(n)
    last = cases.where("split = 'test'").orderBy(F.desc("row_id")).limit(n)
    return first.unionByName(last)


def run(cases: DataFrame, root: str, given: dict) -> tuple[DataFrame, float]:
    """(predictions(row_id, pred), out-of-fold RMSE) of the search cases under the settings.

    Features come from the store at ``root/features``, missing ones are computed and kept there. Predictions of the test
    rows are written to ``root/submission``.
    """
    made = settings(given)
    used = [f for f in made["features"] if f not in set(made["drop"])]
    rows = store.build(registry.raw_cases(sampled(cases, made["num_train"])), f"{root}/features", "run", made["features"], made["recompute_features"], made["not_save"])
    train = rows.where(F.col("relevance").isNotNull())
    preds = learners.out_of_fold(made["model"], train, used, "relevance", k=made["folds"], **made["params"])
    error = preds.agg(E.rmse(F.col("pred"), F.col("truth"))).first()[0]
    out = learners.predict(learners.fit(made["model"], train, used, "relevance", **made["params"]), rows, used)
    files.write_submission(rows.where("split = 'test'").select("row_id").join(out, "row_id"), f"{root}/submission", "row_id", "pred")
    return out, error
