"""Vector functions on the JVM: sparse vectors as arrays of (idx, val) in the order of idx, dense ones as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPARSE = "array<struct<idx:int,val:double>>"


def _cells(v: Column, value) -> Column:
    return F.transform(v, lambda c: F.struct(c["idx"].alias("idx"), value(c["val"]).cast("double").alias("val")))


def _total(v: Column, value) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, c: acc + value(c))


def safe(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(x, y), F.lit(0.0))


def sparse(dense: Column) -> Column:
    """The entries that aren't 0."""
    cells = F.transform(dense, lambda x, i: F.struct(i.alias("idx"), x.cast("double").alias("val")))
    return F.filter(cells, lambda c: c["val"] != 0)


def scale(v: Column, by: float) -> Column:
    return _cells(v, lambda x: x * by)


def normalized(v: Column, power: int = 2) -> Column:
    """Divided by the L2 (or L1) norm; all zeros stay."""
    norm = l2(v) if power == 2 else l1(v)
    return F.transform(F.arrays_zip(v.alias("c"), F.array_repeat(norm, F.size(v)).alias("n")), lambda z: F.struct(z["c"]["idx"].alias("idx"), safe(z["c"]["val"], z["n"]).alias("val")))


def l1(v: Column) -> Column:
    return _total(v, lambda c: F.abs(c["val"]))


def l2(v: Column) -> Column:
    return F.sqrt(_total(v, lambda c: c["val"] * c["val"]))


def capped(v: Column, most: float) -> Column:
    return _cells(v, lambda x: F.least(x, F.lit(most)))


def cut_below(v: Column, least: float) -> Column:
    """Without the entries under ``least``."""
    return F.filter(v, lambda c: c["val"] >= least)


def top(v: Column, k: int) -> Column:
    """The k greatest entries, of equal ones those in front; again in the order of idx."""
    ranked = F.array_sort(F.transform(v, lambda c: F.struct((-c["val"]).alias("n"), c["idx"].alias("idx"), c["val"].alias("val"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, k), lambda c: F.struct(c["idx"].alias("idx"), c["val"].alias("val"))))


def binary(v: Column) -> Column:
    return _cells(v, lambda x: F.lit(1.0))


def signs(v: Column) -> Column:
    return _cells(v, lambda x: F.signum(x))


def log1p(v: Column) -> Column:
    """log(1 + x) of the positive entries; others stay."""
    return _cells(v, lambda x: F.when(x > 0, F.log1p(F.greatest(x, F.lit(0.0)))).otherwise(x))


def greatest(v: Column) -> Column:
    """Struct (idx, val) of the greatest entry, the first of equal ones; null for none."""
    first = F.get(F.array_sort(F.transform(v, lambda c: F.struct((-c["val"]).alias("n"), c["idx"].alias("idx")))), F.lit(0))
    return F.when(F.size(v) > 0, F.struct(first["idx"].alias("idx"), (-first["n"]).alias("val")))


def least(v: Column) -> Column:
    return F.get(F.array_sort(F.transform(v, lambda c: F.struct(c["val"].alias("val"), c["idx"].alias("idx")))), F.lit(0))


def subset(v: Column, keep: list[int]) -> Column:
    """The entries of the columns ``keep``, numbered by their place in it."""
    places = F.array(*[F.lit(i) for i in keep])
    kept = F.filter(v, lambda c: F.array_contains(places, c["idx"]))
    return F.array_sort(F.transform(kept, lambda c: F.struct((F.array_position(places, c["idx"]) - 1).cast("int").alias("idx"), c["val"].alias("val"))))


def beside(a: Column, b: Column, width: int) -> Column:
    """The entries of both, those of ``b`` after ``width`` columns."""
    return F.concat(a, F.transform(b, lambda c: F.struct((c["idx"] + width).cast("int").alias("idx"), c["val"].alias("val"))))


# ---- dense


def add(a: Column, b: Column, times: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * times)


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def times(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x * by)


def squares(a: Column) -> Column:
    return F.transform(a, lambda x: x * x)


def abs_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.abs(x))


def abs_max(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x)))


def mean_and_deviation(a: Column) -> tuple[Column, Column]:
    """Mean and population standard deviation of the entries."""
    n = F.size(a)
    mean = safe(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x), n)
    square = safe(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x), n)
    return mean, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
