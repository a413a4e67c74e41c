"""Column helpers shared by the operators that use only DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; texts of ASCII alone take the faster way to the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


#: Matches whose places are added up together; an accumulator that grows longer would be copied for every match.
CHUNK = 64


def matches(text: Column, pattern: Column, group: int | None = None) -> Column:
    """Array of structs (start, stop, size) of all leftmost non-overlapping matches, in code points, stop exclusive.

    ``size`` is the length of ``group`` (of the match if None). The pieces between matches give the places: SQL has no
    function for them. Places are running sums inside chunks of ``CHUNK`` matches, and then over the chunks, so the
    cost of a text stays in proportion to its matches. The pattern must not match the empty string.
    """
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = whole if group is None else F.regexp_extract_all(text, pattern, F.lit(group))
    lengths = F.zip_with(whole, part, lambda w, p: F.struct(F.length(w).alias("m"), F.length(p).alias("size")))
    # the last piece, after the last match, has no length beside it and is left out
    both = F.filter(F.zip_with(F.split(text, pattern, -1), lengths, lambda s, x: F.struct(F.length(s).alias("gap"), x["m"].alias("m"), x["size"].alias("size"))), lambda x: x["m"].isNotNull())
    place = "struct<start:int,stop:int,size:int>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + x["m"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + x["m"]).alias("stop"), x["size"].alias("size")))).alias("out"))

    def placed(items: Column) -> Column:
        return F.aggregate(items, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{place}>").alias("out")), step)

    def shifted(acc: Column, chunk: Column) -> Column:
        moved = F.transform(chunk["out"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["stop"] + acc["at"]).alias("stop"), m["size"].alias("size")))
        return F.struct((acc["at"] + chunk["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def joined(items: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
        chunks = F.transform(cuts, lambda i: placed(F.slice(items, i * CHUNK + 1, CHUNK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{place}>>").alias("out"))
        return F.aggregate(chunks, start, shifted, lambda acc: F.flatten(acc["out"]))

    return let(both, lambda items: F.when(F.size(items) <= CHUNK, placed(items)["out"]).otherwise(joined(items)))
