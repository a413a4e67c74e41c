"""Training-text pipeline over ``documents``: filter, deduplicate, decontaminate, redact, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaline.llm import bpe, decontaminate, near_copies, pii, simhash, toxicity
from lexaline.llm.queries import tokenizer_file
from lexaline.llm.storage import materialize

#: No SQL: the stages learn models and search near copies. tests/llm/test_queries.py holds each stage against a
#: brute-force version of its rule, on rows with nulls, empties, repeats and clashing columns, and on empty tables.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, under a model of this table and ``labels``; all columns stay.

    Null and empty texts have the score of no evidence; repeated rows go or stay together. Without labels of both kinds
    every document has the share of toxic labels as its score.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, toxicity.learning_rows(labels)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a Jaccard similarity of 0.8 of their five-word shingles, the one of least id; all
    columns stay. Texts without words are one group, null and empty ones included; of repeated rows one stays; rows with a
    null id stay only in groups without other ids, one for each text.
    """
    return simhash.keep_one_per_group(docs, find=near_copies.near_groups)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without half of a benchmark item's windows or six of them; all columns stay. Null and empty texts stay, a
    row with a null id goes by its own text, repeated rows go together; an empty benchmark removes nothing.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with ``[KIND]`` in place of each span of personal data and ``n_chars`` of the new text; other columns as they
    are. Null and empty texts stay as they are; an empty table stays empty.
    """
    # a filter on the spans would be evaluated below them, by a second Python worker of each task
    found = materialize(docs.select(pii.candidate_spans(F.col("text")).alias("spans")), "pipeline-candidates")
    clean = docs.withColumn("text", pii.redacted(pii.fit(found), F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, input_ids, decoded) of every row, repeated ones included; null and empty texts have no
    tokens. Other columns end here.
    """
    return bpe.encoded(docs, ["doc_id", "lang", "source"], tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next one starts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
