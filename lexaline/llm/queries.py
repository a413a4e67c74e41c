"""The registered query of each operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaline.llm import bpe, chat, decontaminate, licenses, pii, secrets, simhash, sketches, substrings, toxicity
from lexaline.llm.storage import checkpoint_root, materialize


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's vocabulary file is; a parameter of the operators, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def of_kind(spans: Column, kind: int) -> Column:
    """How many of the spans are of that kind. A second parameter of the inner function would be a place in the array."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(documents(spark, sf_dir).select("doc_id", "text"))
    return groups.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(documents(spark, sf_dir).select("doc_id", pii.candidate_spans(F.col("text")).alias("spans")), "pii-candidates")
    base = F.filter("spans", lambda s: s["kind"] < len(pii.BASE))
    counts = [of_kind(base, k).alias(f"n_{name}") for k, name in enumerate(pii.BASE)]
    spans = pii.accepted(pii.fit(found), F.col("spans"))
    return found.select("doc_id", *counts, F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(spans).alias("spans"))


def op4_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sketches.fingerprints(documents(spark, sf_dir))
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        sketches.fingerprint(F.col("sketch")).alias("fingerprint"),
        sketches.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketches.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        F.size("sketch").cast("long").alias("n_kept"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(documents(spark, sf_dir), benchmark)
    return found.select("doc_id", F.col("item").alias("item_id"), "n_items", "n_matched", "n_windows", "share")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, toxicity.learning_rows(labels))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.scores(model, F.col("text")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    # one stored ledger, grown by two increments: the second scans what the first left unseen
    ledger = f"{checkpoint_root(spark)}/lexaline/secrets-{uuid.uuid4().hex}"
    early = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(False))
    for increment in (docs.where(early), docs.where(~early)):
        secrets.extend_ledger(increment, ledger)
    found = secrets.findings(docs, secrets.open_ledger(spark, ledger))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    counts = [of_kind(base, k).alias(f"n_{rule.kind}") for k, rule in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(F.col("spans")).alias("spans"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    trap = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    trap = trap.select(F.lit(-7).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.lit(said).alias("text"))
    path = tokenizer_file("byte_bpe_50k.json")
    turns = materialize(chat.format_turns(rows.unionByName(trap), path), "chat-turns")
    return chat.read_back(turns, path)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(F.col("text"), tokenizer_file("word_bpe_49k.json"))
    return documents(spark, sf_dir).select("doc_id", coded.alias("coded")).select("doc_id", "coded.*")


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the license scan: words, base places and their labels."""
    return op2_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the fingerprints: the texts that are fingerprinted."""
    return op4_sketches(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the chat format: the turns and the text under the loss mask, read back from the tokens."""
    return op8_chat(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_licenses": op2_licenses,
    "op3_pii": op3_pii,
    "op4_sketches": op4_sketches,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_chat": op8_chat,
    "op9_substrings": op9_substrings,
    "op10_bpe": op10_bpe,
    "llm_license_places": license_places,
    "llm_edited_texts": edited_texts,
    "llm_chat_turns": chat_turns,
}
