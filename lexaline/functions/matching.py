"""Matching of two texts, as column expressions. Tokens are what stands between white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexaline.functions.text import bigrams, let, nouns, tokens


def phrase_count(phrase: Column, text: Column) -> Column:
    """Non-overlapping occurrences of the phrase; 0 for a blank one."""
    gone = F.length(text) - F.length(F.replace(text, phrase, F.lit("")))
    return F.when(F.trim(phrase) == "", F.lit(0)).otherwise((gone / F.length(phrase)).cast("int"))


def _hits(words: Column, text: Column, exact: bool) -> Column:
    if exact:
        return let(tokens(text), lambda found: F.filter(words, lambda w: F.array_contains(found, w)))
    return F.filter(words, lambda w: F.contains(text, w))


def common_count(a: Column, b: Column, exact: bool = False) -> Column:
    """Tokens of a, repeats included, that occur in b: anywhere, or as a token."""
    return F.size(_hits(tokens(a), b, exact))


def common_bigrams(a: Column, b: Column) -> Column:
    """Bigrams of a, repeats included, that occur in b anywhere."""
    return let(F.lower(b), lambda low: F.size(F.filter(bigrams(a), lambda w: F.contains(low, w))))


def common_weighted(a: Column, b: Column) -> Column:
    """Sum over the tokens of a in b of 1e6 to the power of their place, so that later words dominate."""
    parts = let(tokens(a), lambda words: F.transform(words, lambda w, i: F.when(F.contains(b, w), F.pow(F.lit(1e6), (i + 1) / F.size(words))).otherwise(0.0)))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def edit_bonus(a: Column, b: Column) -> Column:
    """0.5 if some token of a with over three characters is within one edit of at least two tokens of b."""

    def close(w: Column, others: Column) -> Column:
        return F.size(F.filter(others, lambda o: (F.abs(F.length(w) - F.length(o)) < 2) & (F.levenshtein(w, o) < 2))) >= 2

    some = let(tokens(b), lambda others: F.exists(tokens(a), lambda w: (F.length(w) > 3) & close(w, others)))
    return F.when(some, F.lit(0.5)).otherwise(F.lit(0.0))


def common_ordered(a: Column, b: Column) -> Column:
    """Tokens of a found from left to right in b, each search starting after the last hit."""
    start = F.struct(b.alias("rest"), F.lit(0).alias("n"))

    def step(acc: Column, w: Column) -> Column:
        at = F.instr(acc["rest"], w)
        rest = F.substring(acc["rest"], at + F.length(w), F.length(acc["rest"]))
        return F.when(at > 0, F.struct(rest.alias("rest"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    return F.aggregate(tokens(a), start, step, lambda acc: acc["n"])


def positions(a: Column, b: Column, exact: bool = False) -> Column:
    """1-based places of the tokens of b that contain (or equal) a token of a."""
    placed = let(tokens(a), lambda words: F.transform(tokens(b), lambda t, i: F.when(F.exists(words, lambda w: (t == w) if exact else F.contains(t, w)), i + 1)))
    return F.filter(placed, lambda x: x.isNotNull())


def jaccard(a: Column, b: Column, n: int = 1) -> Column:
    x, y = (F.array_distinct(tokens(c) if n == 1 else bigrams(c)) for c in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def dice(a: Column, b: Column, n: int = 1) -> Column:
    x, y = (F.array_distinct(tokens(c) if n == 1 else bigrams(c)) for c in (a, b))
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)), F.lit(0.0))


def er_count(text: Column) -> Column:
    return F.size(F.filter(tokens(text), lambda w: F.endswith(w, F.lit("er"))))


def er_position(query: Column, title: Column) -> Column:
    """0-based place in the title of the query's first token in -er; -1 if there is none."""
    first = F.get(F.filter(tokens(query), lambda w: F.endswith(w, F.lit("er"))), F.lit(0))
    return F.coalesce(F.array_position(tokens(title), first) - 1, F.lit(-1)).cast("int")


def measure_count(measured: Column, text: Column) -> Column:
    """Occurrences in the text of each token of ``measured``, added up."""
    return F.aggregate(F.transform(tokens(measured), lambda w: phrase_count(w, text)), F.lit(0), lambda acc, x: acc + x)


def pair_grams(a: Column, b: Column, n: int, m: int) -> Column:
    """All pairs of an n-gram of a and an m-gram of b, joined by an underscore."""
    x, y = (tokens(c) if k == 1 else F.transform(bigrams(c), lambda g: F.replace(g, F.lit(" "), F.lit("_"))) for c, k in ((a, n), (b, m)))
    return let(y, lambda ys: F.flatten(F.transform(x, lambda v: F.transform(ys, lambda w: F.concat_ws("_", v, w)))))


def noun_count(text: Column) -> Column:
    return F.size(nouns(text))


def noun_common(a: Column, b: Column) -> Column:
    """Tokens of a, repeats included, that are nouns of b."""
    return let(nouns(b), lambda found: F.size(F.filter(tokens(a), lambda w: F.array_contains(found, w))))


def noun_ordered(a: Column, b: Column) -> Column:
    """Tokens of a found from left to right among the nouns of b, each search starting after the last hit."""
    start = F.struct(nouns(b).alias("rest"), F.lit(0).alias("n"))

    def step(acc: Column, w: Column) -> Column:
        at = F.array_position(acc["rest"], w).cast("int")
        rest = F.slice(acc["rest"], at + 1, F.greatest(F.size(acc["rest"]), F.lit(1)))
        return F.when(at > 0, F.struct(rest.alias("rest"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    return F.aggregate(tokens(a), start, step, lambda acc: acc["n"])


def last_nouns(a: Column, b: Column, k: int) -> Column:
    """How many of the last k nouns of b occur in a."""
    return F.size(F.filter(F.slice(F.reverse(nouns(b)), 1, k), lambda w: F.contains(a, w)))


def list_stat(values: Column, method: str) -> Column:
    """max, min, mean, median or std (of a sample) of an array; 0 for an empty one, and std 0 for a single value."""

    def stat(doubles: Column) -> Column:
        n = F.size(doubles)
        mean = F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x) / F.nullif(n, F.lit(0))
        if method in ("max", "min"):
            return (F.array_max if method == "max" else F.array_min)(doubles)
        if method == "mean":
            return mean
        if method == "median":
            return let(F.array_sort(doubles), lambda d: (F.get(d, F.floor((n - 1) / 2).cast("int")) + F.get(d, F.floor(n / 2).cast("int"))) / 2)
        squares = let(mean, lambda m: F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)))
        return F.sqrt(F.try_divide(squares, n - 1))

    return F.coalesce(let(F.transform(values, lambda x: x.cast("double")), stat), F.lit(0.0))


def safe_ratio(x: Column, y: Column) -> Column:
    """x / y as a double, 0 where y is 0."""
    return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
