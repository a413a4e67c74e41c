"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Presence of the hashed n-grams (3 to 5 characters, lower case) in the whole text is the evidence. Each n-gram is scaled
by its naive Bayes log-count ratio, drawn towards zero by ``sure`` standard errors of it, so that n-grams whose ratio may
well be chance count for nothing, however many there are; no number of n-grams is fixed. A logistic regression over the
scaled presences, with weight for the true share of each label, gives the score.

The model is fitted on a bounded sample: the ``per_class`` rows of each label with the least hash of their id. The
bound is a parameter, so the fit costs the same on any corpus; scoring covers all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaline.llm.memory import by_parts, give_back
from lexaline.llm.storage import materialize

#: log2 of the number of n-gram buckets.
HASH_BITS = 18
SIZES = (3, 4, 5)
BUCKETS = 1 << HASH_BITS
#: Tasks that share the sample.
SAMPLE_TASKS = 8
#: Characters that are hashed at a time; neighbours overlap by the longest n-gram.
CHUNK = 1 << 20


@dataclass(frozen=True)
class ToxicityModel:
    """``weights`` holds a float for every bucket, zero for those that tell nothing."""

    weights: np.ndarray
    bias: float


def ngram_buckets(text: str | None):
    """Arrays of the bucket of each character n-gram of a text, chunk by chunk; repeated n-grams come repeatedly."""
    low = " " + (text or "").lower() + " "
    step = CHUNK - max(SIZES) + 1
    for at in range(0, max(1, len(low) - max(SIZES) + 1), step):
        codes = np.frombuffer(low[at : at + CHUNK].encode("utf-32-le", "replace"), np.uint32)
        mixed = codes.copy()
        for n in range(2, max(SIZES) + 1):
            if len(codes) < n:
                break
            mixed = mixed[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
            if n in SIZES:
                yield ((mixed + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)


def present(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of the text, ascending; of those ``wanted`` (a boolean per bucket) if given."""
    held = np.zeros(BUCKETS, bool)
    for buckets in ngram_buckets(text):
        held[buckets] = True
    return np.flatnonzero(held if wanted is None else held & wanted)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the usable labels: 0 or 1 of an id; of repeated labels of one id the toxic one counts."""
    return labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))


def sample_labelled(docs: DataFrame, clean: DataFrame, per_class: int) -> DataFrame:
    """(label, text) of the rows of ``clean(doc_id, label)`` to learn from: ``per_class`` of each label at most, whole texts."""
    picked = [clean.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    # at most two times per_class ids
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    return docs.select("doc_id", "text").join(ids, "doc_id").select("label", "text")


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(label, grams): the distinct buckets of each text as a compressed bit map."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.iloc[at : at + 256]
            grams = []
            for text in part["text"]:
                bits = np.zeros(BUCKETS, bool)
                bits[present(text)] = True
                grams.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pd.DataFrame({"label": part["label"], "grams": grams})
    give_back()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, sure: float = 3.0, rounds: int = 150, l2: float = 1e-4) -> ToxicityModel:
    """Fit on ``labels(doc_id, toxic)`` joined to ``docs(doc_id, text)``.

    Labels other than 0 and 1 and null ids don't count; of repeated labels of one id the toxic one does. Null texts
    count as empty, repeated rows count as often as they occur. Without examples of both labels, as with empty tables,
    the model gives every text the share of toxic labels (0 without any). The driver gets the
    counts of each task and, of each row of the sample, the n-grams that count.
    """
    clean = materialize(labelled(labels), "toxicity-labels")
    counts = {r["label"]: r["count"] for r in clean.groupBy("label").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    # the rows are few and may come from any number of tasks, each of which would send its own counts
    sample = materialize(sample_labelled(docs, clean, per_class).repartition(SAMPLE_TASKS).mapInPandas(_packed, "label int, grams binary"), "toxicity-sample")
    n_rows = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_pos, n_neg = n_rows.get(1, 0), n_rows.get(0, 0)
    weights = np.zeros(BUCKETS, np.float32)
    if not n_pos or not n_neg:
        prior = min(max(share, 1e-6), 1 - 1e-6)
        return ToxicityModel(weights, float(np.log(prior / (1 - prior))))
    counts = np.zeros((2, BUCKETS), np.int64)
    for r in sample.mapInPandas(_counted, "label int, counts binary").toLocalIterator():  # two rows a task
        counts[r["label"]] += np.frombuffer(zlib.decompress(r["counts"]), np.int32)
    ratio = log_count_ratios(counts, n_neg, n_pos, sure)
    wanted = np.flatnonzero(ratio)

    def columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "at": [np.packbits(_bits(g)[wanted]).tobytes() for g in batch["grams"]]})

    rows = sample.mapInPandas(columns, "label int, at binary").orderBy("label", F.xxhash64("at")).toPandas()  # the bounded sample
    y = rows["label"].to_numpy(np.float64)
    x = [np.flatnonzero(np.unpackbits(np.frombuffer(at, np.uint8), count=len(wanted))) for at in rows["at"]]
    weight = np.where(y == 1, max(share, 1e-3) / n_pos, (1 - max(share, 1e-3)) / n_neg)
    w, bias = _logistic(x, ratio[wanted], y, weight / weight.sum(), rounds, l2)
    weights[wanted] = w * ratio[wanted]
    return ToxicityModel(weights, bias)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(label, counts): how many of a task's rows of each label have each bucket."""
    counts = np.zeros((2, BUCKETS), np.int32)
    for batch in batches:
        for label, g in zip(batch["label"], batch["grams"]):
            counts[label] += _bits(g)
    yield pd.DataFrame({"label": [0, 1], "counts": [zlib.compress(c.tobytes(), 1) for c in counts]})


def _bits(grams: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(grams), np.uint8))


def log_count_ratios(counts: np.ndarray, n_neg: int, n_pos: int, sure: float) -> np.ndarray:
    """Logarithm of the smoothed share of label-1 rows with a bucket (``counts[1]`` of ``n_pos``) over that of label-0
    rows, drawn towards zero by ``sure`` standard errors."""
    share = (counts + 1) / np.array([[n_neg + 2], [n_pos + 2]])
    ratio = np.log(share[1] / share[0])
    error = np.sqrt((1 / (counts + 1)).sum(axis=0))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - sure * error)


def _logistic(x: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int, l2: float) -> tuple[np.ndarray, float]:
    """Weighted logistic regression over scaled presences by Adam steps over the whole sample, some rows at a time."""
    blocks = []
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        blocks.append((slice(at, at + len(part)), np.concatenate(part), np.array([len(i) for i in part])))
    w = np.zeros(len(ratio) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        scaled = w[:-1] * ratio
        grad = np.append(l2 * w[:-1], 0.0)
        for rows, flat, sizes in blocks:
            z = np.bincount(np.repeat(np.arange(len(sizes)), sizes), scaled[flat], len(sizes)) + w[-1]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows]
            grad[:-1] += np.bincount(flat, np.repeat(error, sizes), len(ratio)) * ratio
            grad[-1] += error.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def score(model: ToxicityModel, text: str | None) -> float:
    """Probability of label 1, from the whole text; null counts as empty."""
    return _score(model, model.weights != 0, text)


def _score(model: ToxicityModel, wanted: np.ndarray, text: str | None) -> float:
    z = float(model.weights[present(text, wanted)].sum(dtype=np.float64)) + model.bias
    return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def scores(model: ToxicityModel, texts: Column) -> Column:
    """Score column, a double from 0 to 1 for every row."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        wanted = model.weights != 0
        return by_parts(batches, lambda texts: [_score(model, wanted, t) for t in texts], float)

    return scored(texts)


def learning_rows(labels: DataFrame, folds: int = 5) -> DataFrame:
    """Labels outside the held-out fold: those whose crc32 of the id as text isn't divisible by ``folds``."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns come back, whatever their names.

    Null and empty texts have the score of a text without evidence. Repeated rows go or stay together; an empty table
    stays empty.
    """
    return docs.where(scores(model, F.col("text")) < threshold)
