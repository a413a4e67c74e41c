"""Document fingerprints as threshold-scaled sketches, in DataFrame functions only.

A sketch keeps the hash of every shingle of five words that lies below a fixed fraction of the hash range, and always the
least hash, so that no text with words has an empty sketch. Both parts merge by union, and the sketches of very unequal
documents still estimate how much of the smaller one the larger contains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaline.llm.expressions import let

#: Rows of one block of neighbouring ids on average; a block is sorted by one task.
BLOCK_ROWS = 400
#: Blocks at most; beyond that they hold more rows.
MAX_BLOCKS = 1 << 14
#: Block ends that are compared at a time when a row looks for its block.
STEP = 128


def sketch(text: Column, width: int = 5, fraction: float = 0.125) -> Column:
    """Sorted array of the kept hashes, signed; empty for texts without words and for null. Fewer words than ``width`` are
    one shingle; a shingle that occurs again counts once, so equal texts have equal sketches.

    Words are what stands between white space.
    """
    limit = -(1 << 63) + int(fraction * (1 << 64))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def hashes(w: Column) -> Column:
        n = F.greatest(F.size(w) - width, F.lit(0))
        at = F.sequence(F.lit(0), n)
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)])))

    # null words past the end of a short text leave the hash as it is
    return let(let(words, hashes), lambda h: let(F.array_min(h), lambda least: F.array_sort(F.array_distinct(F.filter(h, lambda x: (x < limit) | (x == least))))))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of common shingles in all shingles of both; equal sketches have 1, empty against others 0."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that occur in ``b``; 1 for an empty ``a``."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column) -> Column:
    """Sketch of two texts together, up to the least hashes of both."""
    return F.array_sort(F.array_union(a, b))


def fingerprint(of: Column) -> Column:
    """Fixed-length digest of a sketch, for equality."""
    return F.sha2(F.array_join(F.transform(of, lambda h: F.hex(h)), ","), 256)


def _block_ends(ids: DataFrame) -> list[int]:
    """Ids that end the blocks, ascending, the last one the greatest: real ids of the table, at most MAX_BLOCKS."""
    n, top = ids.agg(F.count("id"), F.max("id")).first()
    blocks = min(MAX_BLOCKS, n // BLOCK_ROWS + 1)
    if not n:
        return []
    shares = [i / blocks for i in range(1, blocks)]
    inner = ids.agg(F.percentile_approx("id", shares, max(10_000, 20 * blocks)).alias("p")).first()["p"] if shares else []
    return sorted({*inner, top})


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """Rows (id, text, next_text): the text of the next row by descending id, and of the first after the last.

    ``carry`` names columns, made from each row's ``text``, that come along for the row and as ``next_...``. Rows of one
    id are ordered by their text; null ids come last; null texts count as empty. Blocks end at real ids, so
    a row that ends a block is also placed, as a guest, where the block above it looks for its next row: the text
    moves once, and no task holds more than a few blocks.
    """
    carry = carry or {}
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ends = _block_ends(rows.select("id"))
    has_null = not rows.where("id is null").isEmpty()
    # null ids have a block of their own, below all others; the others are found in two steps
    table = [ends[i : i + STEP] for i in range(0, len(ends), STEP)]
    lowest, highest = (-1 if has_null else 0), len(ends) - 1
    if table:
        tops = F.array(*[F.lit(part[-1]) for part in table])
        parts = F.array(*[F.array(*[F.lit(e) for e in part]) for part in table])
        own = let(F.size(F.filter(tops, lambda e: e < F.col("id"))), lambda g: g * STEP + F.size(F.filter(F.get(parts, g), lambda e: e < F.col("id"))))
        own = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(own)
        at_end = F.col("id") == F.get(F.get(parts, F.floor(F.col("block") / STEP).cast("int")), F.col("block") % STEP)
        # the row that ends block b is the next of block b + 1; the greatest id is the next of the lowest block
        guest = F.when(F.col("id").isNull(), F.lit(0)).when(at_end, F.when(F.col("block") == highest, F.lit(lowest)).otherwise(F.col("block") + 1))
    else:
        own, guest = F.lit(-1), F.lit(-1)
    placed = rows.withColumn("block", own).withColumn("guest_of", guest)
    spots = F.array_compact(F.array(F.struct("block", F.lit(0).alias("guest")), F.when(F.col("guest_of").isNotNull(), F.struct(F.col("guest_of").alias("block"), F.lit(1).alias("guest")))))
    made = placed.select("id", "text", spots.alias("spots"), *[c.alias(name) for name, c in carry.items()])
    spread = made.select("id", "text", *carry, F.explode("spots").alias("spot")).select("id", "text", *carry, "spot.block", "spot.guest")
    window = Window.partitionBy("block").orderBy("guest", F.col("id").desc_nulls_last(), "text")
    looked = spread.select("id", "text", *carry, "guest", *[F.lead(c).over(window).alias(f"next_{c}") for c in ("text", *carry)])
    return looked.where("guest = 0").select(F.col("id").alias(id_col), F.col("text").alias(text_col), "next_text", *carry, *[f"next_{c}" for c in carry])


def edited(text: Column, following: Column) -> Column:
    """The text with its last third, rounded down, replaced by as many first characters of ``following``, or all of it."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, fraction: float = 0.125) -> DataFrame:
    """Rows (id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch) for every row of ``docs``.

    An empty table gives an empty result; a single row is its own next one. Null texts count as empty, and empty texts
    have empty sketches. Other columns are ignored.
    """
    pairs = with_next(docs, id_col, text_col, {"sketch": sketch(F.col("text"), width, fraction)})
    changed = pairs.withColumn("_e", edited(F.col(text_col), F.col("next_text")))
    return changed.select(
        id_col,
        F.length(text_col).cast("long").alias("n_chars"),
        F.sha2("_e", 256).alias("edited_sha256"),
        "sketch",
        sketch(F.col("_e"), width, fraction).alias("edited_sketch"),
        "next_sketch",
    )
