"""Matrix operations over tables of rows: long form (key, idx, val), or one row with a vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_form(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, idx, val) of a sparse vector column."""
    return df.select(F.col(key).alias("key"), F.explode(vector).alias("c")).select("key", "c.idx", "c.val")


def rows_of(entries: DataFrame) -> DataFrame:
    """(key, v): the entries of each key as one sparse vector."""
    cell = F.struct(F.col("idx").cast("int").alias("idx"), F.col("val").cast("double").alias("val"))
    return entries.groupBy("key").agg(F.array_sort(F.collect_list(cell)).alias("v"))


def transposed(entries: DataFrame) -> DataFrame:
    """Columns as rows: (key, idx, val) with key and idx exchanged; no shuffle."""
    return entries.select(F.col("idx").cast("bigint").alias("key"), F.col("key").alias("idx"), "val")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, idx, val) of the matrix product, joined on the inner index and summed."""
    right = b.select(F.col("key").alias("inner"), F.col("idx").alias("column"), F.col("val").alias("times"))
    joined = a.join(right, a["idx"] == right["inner"])
    return joined.groupBy("key", F.col("column").alias("idx")).agg(F.sum(F.col("val") * F.col("times")).alias("val")).where("val <> 0")


def column_sums(entries: DataFrame) -> DataFrame:
    return entries.groupBy("idx").agg(F.count("*").alias("n"), F.sum("val").alias("total"))


def row_sums(entries: DataFrame) -> DataFrame:
    return entries.groupBy("key").agg(F.count("*").alias("n"), F.sum("val").alias("total"))


def under_each_other(a: DataFrame, b: DataFrame, height: int) -> DataFrame:
    """Rows of both, those of ``b`` after ``height`` rows."""
    return a.select("key", "idx", "val").unionByName(b.select((F.col("key") + height).alias("key"), "idx", "val"))


def only(entries: DataFrame, wanted: DataFrame, column: str, inside: bool = True) -> DataFrame:
    """Entries whose ``column`` is in ``wanted(column)``, or those whose isn't."""
    return entries.join(wanted.select(column).distinct(), column, "left_semi" if inside else "left_anti")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with ``place``, a number that orders its rows at random but alike in every run: sort or filter by it."""
    return df.withColumn("place", F.xxhash64(F.lit(seed), F.col(key)))


def sampled(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """About that share of the rows, chosen by the hash of their key: the same in every run and at every partitioning."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000))


def merged(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Feature tables side by side by key; the columns of each have its name in front."""
    out = None
    for name, df in parts.items():
        part = df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key])
        out = part if out is None else out.join(part, key)
    return out


def one_against_rest(label: Column, labels: list) -> list[Column]:
    """A column for each label: 1 where it holds and -1 elsewhere."""
    return [F.when(label == x, 1).otherwise(-1).alias(f"is_{x}") for x in labels]


def distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share) of the rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("n") / F.col("total")).alias("share"))
