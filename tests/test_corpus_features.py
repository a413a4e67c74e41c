"""Corpus-level features through the planner and the store, against the operators that SQL verifies."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from lexaline.operators import corpus as C
from lexaline.operators import relational as R
from lexaline.plans import corpus_features as P
from lexaline.plans import registry, store
from lexaline.sources import tables as S


@pytest.fixture(scope="module")
def cases(spark):
    return registry.raw_cases(S.search_cases(spark, SF)).cache()


def close(a, b, name):
    a, b = ({r["row_id"]: r[name] for r in df.collect()} for df in (a, b))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_families_agree_with_their_operators(spark, cases):
    wanted = ["idf_of_title", "idf_of_title_exact", "local_idf_of_brand", "composite_idf_of_description", "idf_of_title_noun", "idf_max_2_noun_match_title", "idf_cos_sim_QT", "title_query_BM25", "query_id", "query_is_general", "len_of_title"]
    made = P.with_corpus_features(cases, wanted).cache()
    assert made.columns == [*cases.columns, *wanted] and made.count() == cases.count()
    rows = registry.with_features(cases, ["search_term", "ori_stem_search_term", "title", "description", "brand"]).cache()
    composite = rows.select(F.explode(F.array("search_term", "title", "description", "brand")).alias("text"))
    close(made, C.idf_sum(rows, "row_id", "search_term", "title", C.idf(rows, "title", 1, 1)).withColumnRenamed("v", "idf_of_title"), "idf_of_title")
    close(made, C.idf_sum(rows, "row_id", "ori_stem_search_term", "title", C.idf(rows, "title", 1, 1), True).withColumnRenamed("v", "idf_of_title_exact"), "idf_of_title_exact")
    close(made, C.idf_sum(rows, "row_id", "ori_stem_search_term", "brand", C.idf(rows, "search_term", 1, 1)).withColumnRenamed("v", "local_idf_of_brand"), "local_idf_of_brand")
    close(made, C.idf_sum(rows, "row_id", "search_term", "description", C.idf(composite, "text", 1, 1)).withColumnRenamed("v", "composite_idf_of_description"), "composite_idf_of_description")
    close(made, C.noun_idf_sum(rows, "row_id", "search_term", "title", C.idf(composite, "text", 1, 1)).withColumnRenamed("v", "idf_of_title_noun"), "idf_of_title_noun")
    close(made, C.cosine_distance(rows, "row_id", "search_term", "title", C.idf(composite, "text")).withColumnRenamed("dist", "idf_cos_sim_QT"), "idf_cos_sim_QT")
    ids = {r[0]: r[1] for r in R.query_ids(rows, "search_term", "split").collect()}
    assert all(r["query_id"] == ids[r["search_term"]] for r in made.join(rows.select("row_id", "search_term"), "row_id").collect())


def test_svd_blocks_and_store(spark, cases, tmp_path):
    wanted = ["raw_svd_T", "q_t_11gram", "idf_of_brand", "len_of_title"]
    root = f"file://{tmp_path}/store"
    first = store.build(cases, root, "a", wanted)
    assert {len(r["raw_svd_T"]) for r in first.collect()} == {10} and {len(r["q_t_11gram"]) for r in first.collect()} == {4}
    again = store.build(cases, root, "b", ["idf_of_brand", "raw_svd_T"])
    close(first, again, "idf_of_brand")
    assert set(store._names(spark, root)) == set(wanted) and len(P.NAMES) > 40
