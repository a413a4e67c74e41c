"""Near copies by the Jaccard similarity of word shingles: SimHash finds candidates, exact similarity decides.

Sets of shingle hashes have wide SimHash fingerprints, which :func:`lexaline.llm.simhash.wide_groups` searches with covering masks,
word by word; copies of one set are one text. Groups of texts that share a bucket and differ in few bits are joined to
classes, and later words bring together only texts of different classes. At the end each class is compared once on whole
sets of shingle hashes, so a set moves once and not with each group of each word. In a class of more than
``BUCKET_SHINGLES`` every text is first compared with one of them, its leader. Texts that are linked to the leader are one part
already, so only pairs with a text that isn't are left: blocks of such texts are compared with all blocks of the class, and
no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaline.llm.components import connected_components
from lexaline.llm.memory import PART, give_back
from lexaline.llm.simhash import SEED, WIDE, wide_fingerprint, wide_groups
from lexaline.llm.storage import forget, materialize

WIDTH = 5
SIMILARITY = 0.8
BUCKET_SHINGLES = 200_000
#: Words of the fingerprints that are searched in one job, in each round; a round's groups are made classes before the next.
ROUNDS = ((range(0, 1),), (range(1, 3),), tuple(range(w, min(w + 2, 2 * WIDE)) for w in range(3, 2 * WIDE, 2)))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; shorter texts are one shingle, those without a word none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(width, len(words))
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist())], np.uint64))


def set_hash(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).astype(np.int64))


def _signed(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = []
        for t in batch.pop("text"):
            s = shingle_set(t, width)
            made.append((set_hash(s), len(s), wide_fingerprint(s).view(np.int64)))
        yield batch.assign(fp=[m[0] for m in made], n=[m[1] for m in made], wide=[m[2] for m in made])
        del batch, made
        give_back()


def links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """(i, root) for every set but the root of each connected part of the graph of pairs at or above ``similarity``."""
    sizes = np.array([len(s) for s in sets])
    vocabulary, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    left = np.ones(len(sets), bool)
    found = []
    held = np.zeros(len(vocabulary), np.int64)
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo and left.any():
            i = todo.pop()
            mine = codes[starts[i] : ends[i]]
            held[mine] = 1
            shared = np.add.reduceat(held[codes], starts)
            held[mine] = 0
            near = np.flatnonzero(left & (shared >= similarity * (sizes + sizes[i] - shared) - 1e-9))
            left[near] = False
            found += [(j, root) for j in near.tolist()]
            todo += near.tolist()
    return found


def _linked(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of each group of rows (g, fp, shingles), which come sorted by g."""
    group, fps, sets = None, [], []

    def pairs() -> list[tuple[int, int]]:
        return [(fps[i], fps[r]) for i, r in links(sets, similarity)] if len(sets) > 1 else []

    for batch in batches:
        edges = []
        shingles = batch.column("shingles")
        values, offsets = shingles.values.to_numpy(zero_copy_only=False).view(np.uint64), shingles.offsets.to_numpy()
        for k, (g, fp) in enumerate(zip(batch.column("g").to_pylist(), batch.column("fp").to_pylist())):
            if g != group:
                edges += pairs()
                group, fps, sets = g, [], []
            fps.append(fp)
            sets.append(values[offsets[k] : offsets[k + 1]].copy())
        yield _edge_batch(edges)
    yield _edge_batch(pairs())


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (id, fp, component_id) for every row of ``docs``, fp being the hash of its shingle set; other columns are ignored.

    Components are those of the graph of texts at or above ``similarity``, with the search's chance of a miss, which grows
    as ``similarity`` falls below 0.8. Nulls, empty texts and repeated rows are treated as in :func:`lexaline.llm.simhash.near_groups`.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    signed = texts.mapInPandas(lambda b: _signed(b, width), f"id {id_type}, tie bigint, fp bigint, n int, wide array<bigint>")
    rows = materialize(signed, "copies-rows")
    first = materialize(rows.groupBy("fp").agg(F.min("id").alias("first_id"), F.min(F.struct("tie", "id")).alias("one"), F.min("n").alias("n"), F.min("wide").alias("wide")), "copies-distinct")

    # a set of n is similar to no other one if n / (n + 1) is too little
    searched = first.where(F.col("n") >= similarity * (F.col("n") + 1) - 1e-9).select("fp", "wide")
    classes = None
    for words in ROUNDS:
        rooted = searched.withColumn("root", F.col("fp")) if classes is None else _with_roots(searched, classes)
        jobs = [materialize(wide_groups(rooted, some), "copies-groups") for some in words]
        # a group is a node beside its texts; were its hash that of a text, that one would only be one more candidate
        joined = [df.select(F.col("fp").alias("a"), F.col("g").alias("b")) for df in jobs]
        if classes is not None:
            joined.append(classes.select(F.col("node").alias("a"), F.col("root").alias("b")))
        before, classes = classes, materialize(connected_components(reduce(DataFrame.unionByName, joined)), "copies-classes")
        for done in (*jobs, *([before] if before is not None else [])):
            forget(docs.sparkSession, done)

    members = materialize(first.join(classes.select(F.col("node").alias("fp"), F.col("root").alias("g")), "fp").select("g", "fp", "n", F.col("one.tie").alias("_tie"), F.col("one.id").alias("_id")), "copies-members")
    # one text of each set; repeated rows still come more than once
    of_set = texts.join(members.select("fp", "_tie", "_id"), (F.col("tie") == F.col("_tie")) & F.col("id").eqNullSafe(F.col("_id"))).select("fp", "text").mapInPandas(lambda b: _with_shingles(b, width), "fp bigint, shingles array<bigint>")
    sets = materialize(of_set.dropDuplicates(["fp"]), "copies-sets")
    edges = _edges(members.select("g", "fp", "n"), sets, similarity)
    roots = materialize(connected_components(edges), "copies-roots")
    for done in (classes, sets):
        forget(docs.sparkSession, done)

    rooted = first.select("fp", "first_id").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _with_roots(searched: DataFrame, roots: DataFrame) -> DataFrame:
    joined = searched.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return joined.withColumn("root", F.coalesce("root", "fp"))


def _edges(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect the similar texts of each group of ``members(g, fp, n)``."""
    total = members.groupBy("g").agg(F.sum("n").alias("total"))
    members = materialize(members.join(total, "g"), "copies-totals")
    small = members.where(F.col("total") <= BUCKET_SHINGLES).select("g", "fp")
    led = _led(members.where(F.col("total") > BUCKET_SHINGLES).withColumnRenamed("g", "key"), sets, similarity)
    compared = small.unionByName(_blocks(led)).join(sets, "fp").repartition("g").sortWithinPartitions("g")
    edges = compared.select("g", "fp", "shingles").mapInArrow(lambda b: _linked(b, similarity), "a bigint, b bigint")
    return edges.unionByName(led.where("linked and fp <> leader").select(F.col("fp").alias("a"), F.col("leader").alias("b")))


def _led(crowded: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, fp, n, total, leader, linked): the members of crowded buckets, and whether they are similar to their leader."""
    leaders = crowded.groupBy("key").agg(F.min("fp").alias("leader"))
    theirs = leaders.join(sets.select(F.col("fp").alias("leader"), F.col("shingles").alias("theirs")), "leader")
    both = crowded.join(sets, "fp").join(theirs, "key").withColumn("shared", F.size(F.array_intersect("shingles", "theirs")))
    linked = F.col("shared") >= similarity * (F.size("shingles") + F.size("theirs") - F.col("shared")) - 1e-9
    return materialize(both.select("key", "fp", "n", "total", "leader", linked.alias("linked")), "copies-led")


def _blocks(led: DataFrame) -> DataFrame:
    """(g, fp): each block of a bucket's members that aren't linked to the leader together with each block of all."""

    def block(count: str) -> Column:
        return F.pmod(F.xxhash64("fp"), F.col(count)).cast("int")

    alone = led.where(~F.col("linked")).groupBy("key").agg(F.ceil(F.sum("n") / BUCKET_SHINGLES).cast("int").alias("n_alone"))
    rows = led.join(alone, "key").withColumn("n_all", F.ceil(F.col("total") / BUCKET_SHINGLES).cast("int"))
    mine = rows.where(~F.col("linked")).select("key", "fp", block("n_alone").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"))
    every = rows.select("key", "fp", F.explode(F.sequence(F.lit(0), F.col("n_alone") - 1)).alias("i"), block("n_all").alias("j"))
    return mine.unionByName(every).select(F.xxhash64("key", "i", "j").alias("g"), "fp").distinct()


def _with_shingles(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), PART):
            part = batch.iloc[at : at + PART]
            yield pd.DataFrame({"fp": part["fp"], "shingles": [shingle_set(t, width).view(np.int64) for t in part["text"]]})
    give_back()
