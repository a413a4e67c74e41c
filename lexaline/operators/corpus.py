"""Corpus statistics: document frequencies, tf-idf, BM25, vector distances."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaline.functions.linguistics import give_back
from lexaline.functions.text import let, ngrams, nouns, tokens
from lexaline.sources.files import stored


def grams(text: Column, longest: int = 2) -> Column:
    """All runs of 1 to ``longest`` lower-case tokens."""
    return let(tokens(F.lower(text)), lambda words: F.concat(*[ngrams(words, n) for n in range(1, longest + 1)]))


def idf(docs: DataFrame, text: str, longest: int = 2, min_df: int = 2) -> DataFrame:
    """(term, df, idf) of terms in at least ``min_df`` rows; idf = ln((1 + n) / (1 + df)) + 1."""
    n = docs.agg(F.count("*").alias("n"))
    counted = docs.select(F.explode(F.array_distinct(grams(F.col(text), longest))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return counted.crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))


def tfidf(rows: DataFrame, key: str, text: str, weights: DataFrame, longest: int = 2) -> DataFrame:
    """(key, term, w): tf times idf, rows of unit length. The join stays a shuffle unless the planner sees a small table."""
    tf = rows.select(key, F.explode(grams(F.col(text), longest)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    w = tf.join(weights.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


#: Rows and characters whose terms are counted at a time, bits of the filter of known terms, and entries summed at a time.
COUNTED_ROWS, COUNTED_CHARS, FILTER_BITS, SUMMED = 1000, 2_000_000, 1 << 27, 1 << 20

_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))


def _joint(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a term from those of its beginning and of its last word."""
    return (first * np.uint64(1_000_003) + word + np.uint64(1)) & np.uint64(0xFFFFFFFF)


def _known_terms(weights: DataFrame) -> bytes:
    """Bits of the hashes of all terms, at most ``FILTER_BITS`` of them: terms without their bit have no weight. Empty, as no
    filter, where the bits don't suffice."""
    bits = 1 << 10
    n = weights.count()
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2
    if n > FILTER_BITS // 4:
        return b""

    def places(batches):
        for batch in batches:
            made = set()
            for term in batch.column(0).to_pylist():
                hashes = _word_hashes((term or "").split(" "))
                h = hashes[:1]
                for i in range(1, len(hashes)):
                    h = _joint(h, hashes[i : i + 1])
                made.add(int(h[0]) % bits)
            yield pa.RecordBatch.from_arrays([pa.array([np.fromiter(made, np.uint32, len(made)).tobytes()], pa.binary())], ["places"])

    held = np.zeros(bits, bool)
    for r in weights.select("term").mapInArrow(places, "places binary").toLocalIterator():
        held[np.frombuffer(r["places"], np.uint32)] = True
    return np.packbits(held).tobytes()


def _blocks(batch: pa.RecordBatch):
    """(keys, texts of both sides) of some rows at a time."""
    for start in range(0, batch.num_rows, COUNTED_ROWS):
        part = batch.slice(start, COUNTED_ROWS)
        keys, sides = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), [part.column(i).to_pylist() for i in (1, 2)]
        begin, chars = 0, 0
        for i in range(len(keys)):
            chars += sum(len(side[i] or "") for side in sides)
            if chars >= COUNTED_CHARS or i == len(keys) - 1:
                yield keys[begin : i + 1], [side[begin : i + 1] for side in sides]
                begin, chars = i + 1, 0


def _counted(keys: np.ndarray, sides: list[list], held: np.ndarray, longest: int) -> list[pa.RecordBatch]:
    """(term, entries) of the terms of a block that have their bit. Words are strings once, longer terms are numbers until
    they are known to have it."""
    ids: dict[str, int] = defaultdict(itertools.count().__next__)
    codes, at, side_of = [], [], []
    for s, side in enumerate(sides):
        for i, text in enumerate(side):
            made = np.fromiter((ids[w] for w in _BLANKS.split(text or "") if w), np.int64)
            codes.append(made)
            at.append(np.full(len(made), i))
            side_of.append(np.full(len(made), s))
    words, code, row, side = list(ids), np.concatenate(codes), np.concatenate(at), np.concatenate(side_of)
    hashes = _word_hashes(words)
    group = side * len(keys) + row
    out = []
    h, ends = hashes[code], np.arange(len(code))
    for n in range(1, longest + 1):
        if n > 1:
            fit = ends + 1 < len(code)
            h, ends = h[fit], ends[fit]
            same = group[ends + 1] == group[ends]
            h, ends = h[same], ends[same] + 1
            h = _joint(h, hashes[code[ends]])
        if not len(ends):
            break
        kept, where = ends, h.astype(np.int64) % (8 * len(held) or 1)
        if len(held):
            kept = ends[held[where >> 3] >> (7 - (where & 7)) & 1 > 0]
        if not len(kept):
            continue
        term = code[kept - n + 1]
        for j in range(n - 2, -1, -1):
            term = np.unique(term * len(words) + code[kept - j], return_inverse=True)[1]
        cells, first, back = np.unique(term * len(keys) + row[kept], return_index=True, return_inverse=True)
        x, y = (np.bincount(back, side[kept] == s, len(cells)).astype(np.uint32) for s in (0, 1))
        cell_term, cell_row = np.divmod(cells, len(keys))
        begins = np.flatnonzero(np.diff(cell_term, prepend=-1))
        k = keys[cell_row]
        entries = [k[i:j].tobytes() + x[i:j].tobytes() + y[i:j].tobytes() for i, j in zip(begins, np.append(begins[1:], len(cells)))]
        names = [" ".join([words[code[e - j]] for j in range(n - 1, -1, -1)]) for e in kept[first[begins]]]
        out.append(pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(entries, pa.binary())], ["term", "entries"]))
    return out


def _postings(rows: DataFrame, key: str, texts: tuple[str, str], known: bytes, longest: int) -> DataFrame:
    """(term, entries) for each block of rows: keys, and how often the term is in the first and in the second text."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        held = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for keys, sides in _blocks(batch):
                yield from _counted(keys, sides, held, longest)
            give_back()

    cases = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint"), *[F.lower(F.col(t)).alias(f"t{i}") for i, t in enumerate(texts)])
    return cases.mapInArrow(run, "term string, entries binary")


def _products(batches):
    """(key, xy, xx, yy) of weighted entries, as sums over many of them."""
    sums: list[np.ndarray] = []
    held = 0

    def reduced():
        every = np.concatenate([s[0] for s in sums])
        keys, back = np.unique(every, return_inverse=True)
        return [keys, *(np.bincount(back, np.concatenate([s[i] for s in sums]), len(keys)) for i in (1, 2, 3))]

    def out(of):
        return pa.RecordBatch.from_arrays([pa.array(of[0], pa.int64()), *(pa.array(v, pa.float64()) for v in of[1:])], ["key", "xy", "xx", "yy"])

    for batch in batches:
        for entries, idf in zip(batch.column(0), batch.column(1).to_pylist()):
            raw, n = memoryview(entries.as_buffer()), len(entries.as_buffer()) // 16
            x, y = (np.frombuffer(raw, np.uint32, n, 8 * n + at) * idf for at in (0, 4 * n))
            sums.append([np.frombuffer(raw, np.int64, n).copy(), x * y, x * x, y * y])
            held += n
            if held >= SUMMED:
                one = reduced()
                sums, held = [one], len(one[0])
                if held > SUMMED // 2:
                    yield out(one)
                    sums, held = [], 0
    if sums:
        yield out(reduced())


def cosine_distance(rows: DataFrame, key: str, a: str, b: str, weights: DataFrame, longest: int = 2) -> DataFrame:
    """(key, dist): 1 - cosine of the tf-idf vectors of two texts of each row, 1 where either is empty. Keys are whole numbers.

    Terms are counted where the rows are, and only those that can have a weight (a bit for each hash says so) move, once for
    a block of rows with all of its counts, to their weight; sums by key move on. Rows of equal keys count as one text.
    """
    weights = stored(weights.select("term", "idf"), "weights")
    if rows.groupBy(key).count().where("count > 1").isEmpty():
        found = _postings(rows, key, (a, b), _known_terms(weights), longest).join(weights, "term").select("entries", "idf")
        parts = found.mapInArrow(_products, "key bigint, xy double, xx double, yy double").withColumnRenamed("key", key)
        sums = parts.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy")])
    else:
        sums = _merged_products(rows, key, a, b, weights, longest)
    cosine = F.coalesce(F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))), F.lit(0.0))
    return rows.select(key).join(sums.select(key, cosine.alias("cosine")), key, "left").select(key, (1 - F.coalesce("cosine", F.lit(0.0))).alias("dist"))


def _merged_products(rows: DataFrame, key: str, a: str, b: str, weights: DataFrame, longest: int) -> DataFrame:
    """(key, xy, xx, yy) where keys repeat: a shuffle by key and term, the join of the weights, and a shuffle by key."""

    def side(text: str, name: str, other: str) -> DataFrame:
        return rows.select(key, F.explode(grams(F.col(text), longest)).alias("term"), F.lit(1).alias(name), F.lit(0).alias(other))

    counts = side(a, "x", "y").unionByName(side(b, "y", "x")).groupBy(key, "term").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    w = counts.join(weights, "term").select(key, (F.col("x") * F.col("idf")).alias("x"), (F.col("y") * F.col("idf")).alias("y"))
    return w.groupBy(key).agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))


def idf_sum(rows: DataFrame, key: str, a: str, b: str, weights: DataFrame, exact: bool = False) -> DataFrame:
    """(key, v): sum of idf of the tokens of a that occur in b, over the number of tokens of a plus one."""
    words = tokens(F.col(a))
    if exact:
        hits = let(tokens(F.col(b)), lambda found: F.filter(words, lambda w: F.array_contains(found, w)))
    else:
        hits = F.filter(words, lambda w: F.contains(F.col(b), w))
    sized = rows.select(key, F.size(words).alias("n"), F.explode_outer(hits).alias("term"))
    return sized.join(weights.select("term", "idf"), "term", "left").groupBy(key).agg((F.coalesce(F.sum("idf"), F.lit(0.0)) / (F.max("n") + 1.0)).alias("v"))


def noun_idf_sum(rows: DataFrame, key: str, a: str, b: str, weights: DataFrame) -> DataFrame:
    """(key, v): sum of idf of the tokens of a that are nouns of b, over the number of nouns of a plus one."""
    hits = let(nouns(F.col(b)), lambda of: F.filter(tokens(F.col(a)), lambda w: F.array_contains(of, w)))
    sized = rows.select(key, F.size(nouns(F.col(a))).alias("n"), F.explode_outer(hits).alias("term"))
    return sized.join(weights.select("term", "idf"), "term", "left").groupBy(key).agg((F.coalesce(F.sum("idf"), F.lit(0.0)) / (F.max("n") + 1.0)).alias("v"))


def top_noun_matches(rows: DataFrame, key: str, a: str, b: str, weights: DataFrame, k: int) -> DataFrame:
    """(key, v): how many of the k nouns of b with the greatest idf occur in a; ties by word. Nouns move with a mark of whether
    a has them, and a itself only as a digest."""
    marked = F.transform(F.array_distinct(nouns(F.col(b))), lambda w: F.struct(w.alias("term"), F.contains(F.col(a), w).alias("held")))
    ranked = rows.select(key, F.md5(a).alias("of"), F.explode_outer(marked).alias("n")).select(key, "of", "n.term", "n.held").join(weights.select("term", "idf"), "term", "left")
    one = F.struct((-F.coalesce("idf", F.lit(0.0))).alias("o"), "term", "held")
    best = ranked.groupBy(key, "of").agg(F.slice(F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), one))), 1, k).alias("top"))
    return best.select(key, F.size(F.filter("top", lambda x: x["held"])).alias("v"))


def bm25(rows: DataFrame, key: str, query: str, docs: DataFrame, doc_key: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of each row's query for its document; idf = ln(1 + (n - df + 0.5) / (df + 0.5)), lengths in tokens,
    repeated query words counted as often as they stand."""
    sized = docs.select(doc_key, tokens(F.lower(text)).alias("w"))
    facts = sized.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avg_len"))
    # only words that some query has are looked up
    asked = rows.select(key, doc_key, F.explode(tokens(F.lower(query))).alias("word"))
    wanted = asked.select("word").distinct()
    tf = sized.select(doc_key, F.size("w").alias("len"), F.explode("w").alias("word")).join(wanted, "word", "left_semi").groupBy(doc_key, "word").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    hit = asked.join(tf, [doc_key, "word"]).join(df, "word").crossJoin(F.broadcast(facts))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = hit.groupBy(key).agg(F.sum(weight).alias("score"))
    return rows.select(key).join(scored, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def group_similarity(vectors: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """(key, n, mean_dist): number of other rows of the same group and the mean cosine distance to them.

    The mean over all others needs no pairs: it is one minus the row's product with the group's sum of unit vectors.
    """
    unit = vectors.select(key, group, F.transform(vector, lambda x: x / F.sqrt(dot(F.col(vector), F.col(vector)))).alias("u"))
    sums = unit.select(group, F.posexplode("u").alias("i", "x")).groupBy(group, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    total = sums.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("t"), F.max("n").alias("n"))
    rows = unit.join(total, group)
    others = dot(F.col("u"), F.transform("t", lambda p: p["s"])) - 1.0
    return rows.select(key, (F.col("n") - 1).alias("n"), F.when(F.col("n") > 1, 1 - others / (F.col("n") - 1)).otherwise(0.0).alias("mean_dist"))


#: Rows of a block whose distances to another block are computed at a time.
BLOCK_ROWS = 2048


def group_spread(vectors: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """(key, max_dist, min_dist, std_dist): over the cosine distances to all other rows of the same group; 0 where there is
    none, and deviation 0 for one. The deviation is that of a sample. Keys are distinct.

    Every row meets every other of its group, block by block; a task holds two blocks. This is quadratic in a group.
    """
    import numpy as np

    sizes = vectors.groupBy(group).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    blocked = vectors.select(F.col(key).alias("k"), F.col(group).alias("g"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.xxhash64(key).alias("h")).join(sizes.withColumnRenamed(group, "g"), "g")
    blocked = blocked.withColumn("block", F.pmod("h", "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    mine = blocked.select("k", "g", "v", F.lit(True).alias("mine"), F.col("block").alias("i"), every.alias("j"))
    others = blocked.select("k", "g", "v", F.lit(False).alias("mine"), every.alias("i"), F.col("block").alias("j"))

    def distances(rows):
        import pandas as pd

        unit = np.stack(rows["v"].to_numpy())
        unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        at = rows["mine"].to_numpy(bool)
        keys = rows["k"].to_numpy()
        left, right = keys[at], keys[~at]
        if not len(left) or not len(right):
            return pd.DataFrame({"k": left[:0], "n": [], "mean": [], "m2": [], "high": [], "low": []})
        dist = 1 - unit[at] @ unit[~at].T
        other = left[:, None] != right[None, :]
        n = other.sum(axis=1)
        mean = np.where(other, dist, 0).sum(axis=1) / np.maximum(n, 1)
        m2 = np.where(other, (dist - mean[:, None]) ** 2, 0).sum(axis=1)
        return pd.DataFrame({"k": left, "n": n, "mean": mean, "m2": m2, "high": np.where(other, dist, -np.inf).max(axis=1), "low": np.where(other, dist, np.inf).min(axis=1)})

    kind = vectors.schema[key].dataType.simpleString()
    parts = mine.unionByName(others).groupBy("g", "i", "j").applyInPandas(distances, f"k {kind}, n long, mean double, m2 double, high double, low double").where("n > 0")
    whole = parts.groupBy("k").agg(F.sum("n").alias("n"), F.max("high").alias("high"), F.min("low").alias("low"), F.collect_list(F.struct("n", "mean", "m2")).alias("parts"))
    mean = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["n"] * p["mean"]) / F.col("n")
    spread = whole.withColumn("m", mean).withColumn("m2", F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["m2"] + p["n"] * (p["mean"] - F.col("m")) * (p["mean"] - F.col("m"))))
    found = spread.select(F.col("k").alias(key), "high", "low", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0).alias("std"))
    return vectors.select(key).join(found, key, "left").select(key, *[F.coalesce(c, F.lit(0.0)).alias(f"{name}_dist") for c, name in (("high", "max"), ("low", "min"), ("std", "std"))])


def nearest_of_words(left: DataFrame, right: DataFrame, key: str, vectors: DataFrame) -> DataFrame:
    """(key, avg_max_sim, avg_min_dist): over the words of the left text, mean greatest cosine and mean least Euclidean
    distance to the words of the right text. ``left`` and ``right`` are (key, word); ``vectors`` is (word, vec)."""
    a = left.join(vectors, "word").select(key, "pos", F.col("vec").alias("x"))
    b = right.join(vectors, "word").select(key, F.col("vec").alias("y"))
    cos = dot(F.col("x"), F.col("y")) / F.sqrt(dot(F.col("x"), F.col("x")) * dot(F.col("y"), F.col("y")))
    gap = F.zip_with("x", "y", lambda p, q: p.cast("double") - q.cast("double"))
    near = a.join(b, key).groupBy(key, "pos").agg(F.max(cos).alias("sim"), F.min(F.sqrt(dot(gap, gap))).alias("dist"))
    return near.groupBy(key).agg(F.avg("sim").alias("avg_max_sim"), F.avg("dist").alias("avg_min_dist"))
