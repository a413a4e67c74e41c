"""Near-duplicate groups from SimHash fingerprints, searched with covering locality-sensitive hashing.

A fingerprint has 64 bits. Every bit position carries a non-zero label of ``radius + 1`` bits; the table of a non-zero
vector v compares the positions whose label has an odd product with v. ``radius`` differing positions leave at least one
v that is orthogonal to all of their labels, so two fingerprints within the radius agree on the whole mask of some table:
the search has no false negatives. A bucket that holds very many fingerprints is split by the same construction over
the positions that its mask leaves open, which keeps the guarantee; after three levels a bucket can hold
at most 2^8 different fingerprints, so no bucket is compared in pairs beyond ``max_bucket`` members.

Texts of Jaccard similarity 0.8 differ in some ten of 64 bits. For them there are wide fingerprints of ``WIDE`` times 64 bits,
the first 64 being those above; each of their 32-bit words is searched with the covering masks of radius ``WORD_RADIUS``, so a pair
is found if any of its words differs in that many bits or fewer, hence always up to 79 of 640 bits. Beyond that words are
independent trials: a pair at 0.8 differs in 97 bits on average, and is missed by all words with a chance of 2 in 100,000.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexaline.llm.components import connected_components
from lexaline.llm.memory import by_parts
from lexaline.llm.storage import materialize

BITS = 64
SEED = 42
#: Shingle hashes whose bits are counted at a time.
CHUNK = 1 << 15
#: 64-bit numbers of a wide fingerprint, each of two words.
WIDE = 10
WORD = 32
WORD_RADIUS = 3
#: Differing bits of the first two numbers up to which texts that share a bucket are candidates. Texts of similarity
#: 0.8 differ in 19 of these 128 on average (deviation 4; the worst sizes, 4 and 5 shingles: 24), unrelated ones in 64.
CANDIDATE_BITS = 42
#: Numbers on which these are counted again, up to the same share. 0.8 differs in 58 of 384 bits on average (deviation 7; the
#: worst sizes: 72, deviation 8), so none is lost up to 126; unrelated texts that passed by chance, one of 20,000, end here.
CHECKED = 6
#: Members of a bucket up to which all of them are compared at once, and beyond which one is compared with all that are left.
AT_ONCE = 64
CROWD = 4096
BLOCK = 512

_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (WIDE - 1, 1), np.uint64) << np.uint64(1) | np.uint64(1)
_ONES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a text's word shingles, unsigned; 0 for null and for texts without a word."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(width, len(words))
    starts, ends = starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        values = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], "<u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(texts: Column, width: int = 3) -> Column:
    """Fingerprint column, as the signed long of the same bits."""

    @F.pandas_udf(T.LongType())
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return by_parts(batches, lambda texts: np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64).tolist(), np.int64)

    return signed(texts)


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over ``positions``; any ``radius`` of the positions are missed together by at least one mask."""
    labels = (1 << (radius + 1)) - 1
    label = {p: i % labels + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (label[p] & v).bit_count() % 2) for v in range(1, labels + 1)]


def mask_levels(radius: int, levels: int = 3) -> list[list[int]]:
    """Masks of each level; entry ``t * (2^(radius+1) - 1) + j`` of a level refines entry t of the level before."""
    found = [covering_masks(list(range(BITS)), radius)]
    for _ in range(levels - 1):
        found.append([m | n for m in found[-1] for n in covering_masks([p for p in range(BITS) if not m >> p & 1], radius)])
    return found


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _bucket_links(radius: int):
    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def links(buckets: pd.Series) -> pd.Series:
        found = []
        for bucket in buckets:
            values = np.asarray(bucket, np.int64)
            bits = values.view(np.uint64)  # the count of a negative number would be that of its absolute value
            near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
            root = np.arange(len(values))
            while True:  # least member reachable inside the bucket
                least = np.where(near, root[None, :], len(values)).min(axis=1)
                if (least == root).all():
                    break
                root = least
            found.append([{"a": int(values[i]), "b": int(values[r])} for i, r in enumerate(root.tolist()) if r != i])
        return pd.Series(found)

    return links


def _tables(fps: DataFrame, masks: list[int], per: int, refined: bool) -> DataFrame:
    """A row (t, k, fp) for each table: for all first-level masks, or for those that refine the row's table t."""
    literal = F.array(*[F.array(*[F.lit(_signed(m)) for m in masks[i : i + per]]) for i in range(0, len(masks), per)])
    base = F.col("t") if refined else F.lit(0)
    mine = F.posexplode(F.element_at(literal, (base + 1).cast("int"))).alias("j", "mask")
    rows = fps.select("fp", base.alias("up"), mine)
    return rows.select((F.col("up") * per + F.col("j")).cast("int").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp")


def near_links(fps: DataFrame, radius: int = 3, max_bucket: int = 256, label: str = "simhash") -> DataFrame:
    """Edges (a, b) that connect all fingerprints of ``fps(fp)``, distinct values, within ``radius`` differing bits.

    Every bucket yields a spanning forest of its links, not all of its pairs.
    """
    per = (1 << (radius + 1)) - 1
    found, left = [], fps
    links = _bucket_links(radius)
    levels = mask_levels(radius)
    for level, masks in enumerate(levels):
        last = level == len(levels) - 1
        rows = _tables(left, masks, per, level > 0)
        shared = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
        members = materialize(rows.join(shared, ["t", "k"]), label)
        small = members if last else members.where(F.col("n") <= max_bucket)
        # one bucket's members often meet in several tables
        buckets = small.groupBy("t", "k").agg(F.sort_array(F.collect_list("fp")).alias("fps")).select("fps").distinct()
        found.append(buckets.select(F.explode(links("fps")).alias("e")).select("e.a", "e.b"))
        left = members.where(F.col("n") > max_bucket).select("fp", "t")
        if last or left.isEmpty():
            break
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """Rows (id, fp, component_id) for every row of ``docs``; other columns are ignored, whatever their names.

    Null and empty texts, and texts without words, have fingerprint 0 and are linked like any other. Repeated rows come
    back as often as they occur. A null id is never a component_id unless the whole component has null ids. An empty
    table gives an empty result.
    """
    rows = materialize(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), width).alias("fp")), "simhash-rows")
    first = materialize(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-distinct")
    roots = materialize(connected_components(near_links(first.select("fp"), radius)), "simhash-roots")
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """``WIDE`` unsigned numbers of a set of shingle hashes: bits set in over half of the hashes, then of mixed hashes."""
    counts = np.zeros((8, WIDE, 8), np.int64)
    for at in range(0, len(shingles), CHUNK):
        plain = shingles[at : at + CHUNK]
        mixed = plain * _MIX
        mixed = (mixed ^ mixed >> np.uint64(32)) * _MIX[::-1]
        bits = np.vstack([plain[None, :], mixed ^ mixed >> np.uint64(29)])
        groups = np.arange(0, len(plain), 255)  # a byte counts up to 255
        for b in range(8):
            sums = np.ascontiguousarray(np.add.reduceat(bits >> np.uint64(b) & _ONES, groups, axis=1))
            counts[b] += sums.view(np.uint8).reshape(WIDE, len(groups), 8).sum(axis=1, dtype=np.int64)
    # counts are by bit of a byte, number, byte
    return np.packbits((2 * counts > len(shingles)).transpose(1, 2, 0), axis=2, bitorder="little").reshape(WIDE, 8).view("<u8")[:, 0].astype(np.uint64)


def word_tables(words: range) -> list[tuple[int, int, int, int]]:
    """(table, number, shift, mask) of the covering masks of each word of a wide fingerprint."""
    masks = covering_masks(list(range(WORD)), WORD_RADIUS)
    return [(w * len(masks) + j, w // 2, WORD * (w % 2), m) for w in words for j, m in enumerate(masks)]


def wide_groups(fps: DataFrame, words: range) -> DataFrame:
    """Rows (g, fp), distinct: groups of the rows of ``fps(fp, root, wide)`` that may be similar, from buckets of these words.

    A group is a connected part of a bucket's pairs with different roots and at most ``CANDIDATE_BITS`` differing bits of
    128, and as small a share of ``CHECKED`` numbers; equal groups of several buckets are one.
    """
    tables = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(at).alias("at"), F.lit(shift).alias("shift"), F.lit(mask).cast("long").alias("mask")) for t, at, shift, mask in word_tables(words)])
    rows = fps.select("fp", "root", "wide", F.explode(tables).alias("m"))
    word = F.expr("shiftrightunsigned(wide[m.at], m.shift)").bitwiseAND(F.col("m.mask"))
    keyed = rows.select((F.col("m.t") * F.lit(1 << WORD) + word).alias("key"), "fp", "root", *[F.col("wide")[k].alias(f"w{k}") for k in range(CHECKED)])
    sorted_rows = keyed.repartition("key").sortWithinPartitions("key", "root")
    return sorted_rows.mapInArrow(_grouped, "g bigint, fp bigint").distinct()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of each bucket of rows (key, fp, root, w0, w1, ...), which come sorted by key and root."""
    held: list[list[np.ndarray]] = []

    def found() -> pa.RecordBatch:
        gs, fps = [], []
        for members in bucket_groups(*[np.concatenate(c) for c in zip(*held)]) if held else []:
            gs.append(np.full(len(members), xxhash.xxh64_intdigest(members.tobytes(), SEED), np.uint64).view(np.int64))
            fps.append(members)
        none = [np.zeros(0, np.int64)]
        return pa.record_batch({"g": np.concatenate(gs or none), "fp": np.concatenate(fps or none)})

    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        if not len(columns[0]):
            continue
        # the last bucket may go on in the next batch
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if last or held and held[-1][0][-1] != columns[0][0]:
            held.append([c[:last] for c in columns])
            yield found()
            held = []
        held.append([c[last:].copy() for c in columns])
    yield found()


def _near(numbers: list[np.ndarray], a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    """Places in ``b`` of the rows that differ from those of ``a``, or from one row, in few bits."""
    w0, w1 = numbers[:2]
    near = np.flatnonzero(np.bitwise_count(w0[a] ^ w0[b]) + np.bitwise_count(w1[a] ^ w1[b]) <= CANDIDATE_BITS)
    x, y = a if isinstance(a, int) else a[near], b[near]
    differ = np.zeros(len(near), np.int64)
    for w in numbers:
        differ += np.bitwise_count(w[x] ^ w[y])
    return near[2 * differ <= len(numbers) * CANDIDATE_BITS]


def _parts(numbers: list[np.ndarray], a: int, b: int) -> Iterator[np.ndarray]:
    """Rows of each connected part of the near pairs of rows a to b; a row that has been reached is not compared again."""
    left = np.arange(a, b)
    while len(left):
        todo, part, left = [int(left[0])], [left[:1]], left[1:]
        while todo and len(left):
            near = _near(numbers, todo.pop(), left)
            if len(near):
                part.append(left[near])
                todo += left[near].tolist()
                left = np.delete(left, near)
        yield np.concatenate(part)


def bucket_groups(key: np.ndarray, fp: np.ndarray, root: np.ndarray, *numbers: np.ndarray) -> list[np.ndarray]:
    """Sorted fps of each group of each bucket; rows are sorted by key and root."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.append(starts[1:], len(key))
    sizes = ends - starts
    groups, left, right = [], [], []
    bits = [w.view(np.uint64) for w in numbers]  # the count of a negative number would be that of its absolute value

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        near = _near(bits, a, b)
        near = near[root[a[near]] != root[b[near]]]
        left.append(a[near])
        right.append(b[near])

    at, room = np.arange(len(key)), np.repeat(ends, sizes)
    at = at[np.repeat(sizes <= AT_ONCE, sizes)]
    for step in range(1, AT_ONCE):
        at = at[at + step < room[at]]
        if not len(at):
            break
        keep(at, at + step)
    for a, b in zip(starts[sizes > AT_ONCE].tolist(), ends[sizes > AT_ONCE].tolist()):
        roots = 1 + int((root[a + 1 : b] != root[a : b - 1]).sum())
        if b - a > CROWD and 2 * roots > b - a:
            groups += [np.sort(fp[part]) for part in _parts(bits, a, b) if (root[part] != root[part[0]]).any()]
            continue
        blocks = [np.arange(k, min(k + BLOCK, b)) for k in range(a, b, BLOCK)] if roots > 1 else []
        for i, x in enumerate(blocks):
            for y in blocks[i:]:
                if root[x[0]] != root[y[-1]]:  # sorted: else all are one part already
                    p, q = np.repeat(x, len(y)), np.tile(y, len(x))
                    keep(p[p < q], q[p < q])
    if not left:
        return groups
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(key))
    while len(a):
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            break
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
    members = np.unique(np.concatenate((a, b)))
    members = members[np.lexsort((fp[members], label[members]))]
    cuts = np.flatnonzero(np.diff(label[members])) + 1
    return groups + [m for m in np.split(fp[members], cuts) if len(m)]


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[[DataFrame, str, str], DataFrame] = near_groups) -> DataFrame:
    """``docs`` with one document left of each near-duplicate group that ``find`` gives: the one with the least id.

    Of repeated rows with that id and one text, one stays. Rows with a null id stay only where their whole group has
    null ids, one for each different text. All columns come back, whatever their names. An empty table stays empty.
    """
    groups = find(docs, id_col, text_col)
    # the input's columns move inside one struct, so no helper name can meet one of theirs
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    keep = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("kept_id")).distinct()
    kept = rows.join(keep, F.col(f"row.`{id_col}`").eqNullSafe(F.col("kept_id")), "left_semi")
    one = kept.groupBy(F.col(f"row.`{id_col}`").alias("of_id"), F.sha2(F.col(f"row.`{text_col}`"), 256).alias("of_text")).agg(F.first("row").alias("row"))
    return one.select("row.*")
