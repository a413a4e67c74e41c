"""Feature store: one Parquet dataset for each group of features, keyed by row_id; what exists isn't computed again."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from lexaline.plans.corpus_features import with_corpus_features


def _names(spark: SparkSession, root: str) -> dict[str, str]:
    """Stored feature -> folder of its group, read through Spark's file system so that any store works."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    folders = sorted(s.getPath().toString() for s in fs.listStatus(path) if s.isDirectory())
    return {c: folder for folder in folders for c in spark.read.parquet(folder).columns if c != "row_id"}


def load(spark: SparkSession, root: str, features: Iterable[str]) -> DataFrame | None:
    """(row_id, features) read from the store with one join for each group; None if nothing is wanted."""
    where = _names(spark, root)
    groups: dict[str, list[str]] = {}
    for f in features:
        groups.setdefault(where[f], []).append(f)
    out = None
    for folder, names in groups.items():
        part = spark.read.parquet(folder).select("row_id", *names)
        out = part if out is None else out.join(part, "row_id")
    return out


def build(cases: DataFrame, root: str, group: str, wanted: Iterable[str], recompute: Iterable[str] = (), not_save: Iterable[str] = ()) -> DataFrame:
    """Raw ``cases`` with the wanted features: stored ones read, others computed and stored as ``group``."""
    spark, wanted, recompute = cases.sparkSession, list(wanted), set(recompute)
    stored = [f for f in _names(spark, root) if f in wanted and f not in recompute]
    had = load(spark, root, stored)
    rows = cases.join(had, "row_id") if had is not None else cases
    missing = [f for f in wanted if f not in stored]
    if missing:
        made = with_corpus_features(rows, missing)
        kept = [f for f in missing if f not in set(not_save)]
        if kept:
            made.select("row_id", *kept).write.mode("overwrite").parquet(f"{root}/{group}")
            fresh = spark.read.parquet(f"{root}/{group}")
            left = [f for f in missing if f not in kept]
            rows = with_corpus_features(rows, left).select("row_id", *[c for c in rows.columns if c != "row_id"], *left).join(fresh, "row_id") if left else rows.join(fresh, "row_id")
        else:
            rows = made
    return rows.select(*cases.columns, *wanted)
