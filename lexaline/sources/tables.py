"""Tables of a data folder, and the search cases that the relevance operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaline.functions.text import tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens(text), 1, n), " ")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_uid, title, description, brand): a document's first twelve words are its title."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("product_uid"), first_words(F.col("text"), 12).alias("title"), F.col("text").alias("description"), F.col("source").alias("brand"))


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, search_term): the first four words of each benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), first_words(F.col("text"), 4).alias("search_term"))


def search_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, product_uid, search_term, title, description, brand, relevance, split), all texts in lower case.

    Every product meets one query; relevance is 1 to 3 where labels exist (split 'train'), else null ('test').
    """
    terms = search_terms(spark, sf_dir)
    n = terms.agg(F.count("*").alias("n_terms"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("product_uid"), (1 + F.col("quality") + (1 - F.col("toxic"))).cast("double").alias("relevance"))
    asked = products(spark, sf_dir).crossJoin(F.broadcast(n)).withColumn("qid", F.pmod("product_uid", "n_terms"))
    cases = asked.join(terms, "qid").join(labels, "product_uid", "left")
    low = [F.lower(c).alias(c) for c in ("search_term", "title", "description", "brand")]
    return cases.select(F.col("product_uid").alias("row_id"), "product_uid", *low, "relevance", F.when(F.col("relevance").isNull(), "test").otherwise("train").alias("split"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_uid, name, value): the catalogue's properties, one row each."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_uid"), F.col("p_brand").alias("MFG Brand Name"), F.col("p_type").alias("Part Type"), F.col("p_size").cast("string").alias("Size"))
    return part.unpivot("product_uid", ["MFG Brand Name", "Part Type", "Size"], "name", "value")


def measured_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text): catalogue lines with sizes, units and dimensions."""
    p = table(spark, sf_dir, "part")
    text = F.concat_ws(" ", F.col("p_name"), F.concat(F.col("p_size").cast("string"), F.lit(" inches x ")), F.concat((F.col("p_size") % 7).cast("string"), F.lit("ft, two gallons by ")), F.concat((F.col("p_size") * 2).cast("string"), F.lit("-Volt &amp; 1,000 lbs. 5% AB-12C")), F.col("p_type"))
    return p.select(F.col("p_partkey").alias("row_id"), text.alias("text"))
