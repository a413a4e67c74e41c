"""Registered queries of the relevance operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaline.functions import linguistics as L
from lexaline.functions import matching as M
from lexaline.functions import text as X
from lexaline.models import evaluation as E
from lexaline.operators import corpus as C
from lexaline.operators import relational as R
from lexaline.plans import registry
from lexaline.sources import tables as S
from lexaline.sources.files import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def over_cases(name: str, build: Callable[..., dict[str, Column]]) -> None:
    """A query of column expressions over the search cases."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = build(*(F.col(c) for c in ("search_term", "title", "description", "brand")))
        return S.search_cases(spark, sf_dir).select("row_id", *[c.alias(n) for n, c in made.items()])

    QUERIES[name] = run


def over_measured(name: str, build: Callable[[Column], dict[str, Column]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.measured_texts(spark, sf_dir).select("row_id", *[c.alias(n) for n, c in build(F.col("text")).items()])

    QUERIES[name] = run


def r6(c: Column) -> Column:
    return F.round(c, 6)


def last_word(a: Column) -> Column:
    return F.coalesce(F.try_element_at(X.tokens(a), F.lit(-1)), F.lit(""))


over_cases("tm_phrase_count", lambda q, t, d, b: {"query_in_title": M.phrase_count(q, t), "query_in_description": M.phrase_count(q, d), "brand_in_description": M.phrase_count(b, d), "of_in_description": M.phrase_count(F.lit("of"), d)})
over_cases("tm_last_word", lambda q, t, d, b: {"last_in_title": M.common_count(last_word(q), t), "last_in_description": M.common_count(last_word(q), d)})
over_cases("tm_common_substring", lambda q, t, d, b: {"word_in_title": M.common_count(q, t), "word_in_description": M.common_count(q, d), "word_in_brand": M.common_count(q, b), "title_in_description": M.common_count(t, d)})
over_cases("tm_common_exact", lambda q, t, d, b: {"word_in_title_exact": M.common_count(q, t, True), "word_in_description_exact": M.common_count(q, d, True), "title_in_description_exact": M.common_count(t, d, True)})
over_cases("tm_common_weighted", lambda q, t, d, b: {"title_weighted": r6(M.common_weighted(q, t)), "description_weighted": r6(M.common_weighted(q, d))})
over_cases("tm_common_bigram", lambda q, t, d, b: {"bigram_in_title": M.common_bigrams(q, t), "bigram_in_description": M.common_bigrams(q, d), "title_bigram_in_description": M.common_bigrams(t, d)})
over_cases("tm_common_ordered", lambda q, t, d, b: {"word_in_title_ordered": M.common_ordered(q, t), "title_in_description_ordered": M.common_ordered(t, d)})
over_cases("tm_jaccard_dice_uni", lambda q, t, d, b: {"qt_jaccard": r6(M.jaccard(q, t)), "qt_dice": r6(M.dice(q, t)), "qd_jaccard": r6(M.jaccard(q, d)), "qd_dice": r6(M.dice(q, d)), "td_jaccard": r6(M.jaccard(t, d)), "td_dice": r6(M.dice(t, d))})
over_cases("tm_jaccard_dice_bi", lambda q, t, d, b: {"qt_jaccard": r6(M.jaccard(q, t, 2)), "qt_dice": r6(M.dice(q, t, 2)), "td_jaccard": r6(M.jaccard(t, d, 2)), "td_dice": r6(M.dice(t, d, 2))})
over_cases("tm_er_words", lambda q, t, d, b: {"er_in_query": M.er_count(q), "er_in_title": M.er_count(t), "er_in_description": M.er_count(d), "er_position": M.er_position(d, t)})
over_cases("tm_lengths", lambda q, t, d, b: {"len_of_query": X.n_words(q), "len_of_title": X.n_words(t), "len_of_description": X.n_words(d), "len_of_brand": X.n_words(b), "chars_of_query": F.length(q), "chars_of_description": F.length(d)})
over_cases("tm_ratios", lambda q, t, d, b: {"ratio_title": r6(M.common_count(q, t) / (X.n_words(q) + 1.0)), "ratio_description": r6(M.common_count(q, d) / (X.n_words(q) + 1.0)), "ratio_safe": r6(M.safe_ratio(M.common_count(q, t), M.common_count(q, d)))})
for _n in (1, 2):
    for _m in (1, 2):
        over_cases(f"tm_cooccur_{_n}{_m}", lambda q, t, d, b, n=_n, m=_m: {"pairs": F.array_join(M.pair_grams(q, t, n, m), " ")})
over_cases("tm_editdist_bonus", lambda q, t, d, b: {"bonus_title": M.edit_bonus(q, t), "bonus_description": M.edit_bonus(q, d)})
over_cases("tx_stopwords", lambda q, t, d, b: {"title": X.without_stop_words(t), "description_len": X.n_words(X.without_stop_words(d))})
over_cases("tx_meaningful", lambda q, t, d, b: {"query_ok": X.is_meaningful(q), "title_ok": X.is_meaningful(t)})
over_cases("tx_ngrams_1_3", lambda q, t, d, b: {"bi": F.array_join(X.ngrams(X.word_tokens(t), 2), ","), "tri": F.array_join(X.ngrams(X.word_tokens(t), 3), ",")})
over_cases("tx_exclude", lambda q, t, d, b: {"left": X.exclude(t, F.replace(q, F.lit(" "), F.lit("\t")))})
over_cases("pos_noun_count", lambda q, t, d, b: {"noun_of_query": M.noun_count(q), "noun_of_title": M.noun_count(t), "noun_of_description": M.noun_count(d)})
over_cases("pos_noun_common", lambda q, t, d, b: {"noun_match_title": M.noun_common(q, t), "noun_match_description": M.noun_common(t, d)})
over_cases("pos_noun_ordered", lambda q, t, d, b: {"noun_title_ordered": M.noun_ordered(q, t), "noun_description_ordered": M.noun_ordered(t, d)})
over_cases("pos_last_k_noun", lambda q, t, d, b: {f"last_{k}": M.last_nouns(d, t, k) for k in (1, 2, 3, 5)})
over_measured("tx_unit_rules", lambda s: {"normal": X.normalize_rules(s)})
over_measured("tx_number_words", lambda s: {"digits": X.number_words(s)})
over_measured("tx_typeid", lambda s: {"typeid": X.model_numbers(s)})
over_measured("tx_typeid_norm", lambda s: {"typeid": X.normalize_model_numbers(X.model_numbers(s))})
over_measured("tm_measures_query", lambda s: {"measures": F.array_join(X.query_measures(s), " ")})
over_measured("tx_measures", lambda s: {"measures": F.array_join(X.measures(X.normalize_rules(s)), "|")})
over_measured("tm_measure_count", lambda s: {"n": M.measure_count(X.joined(X.query_measures(s)), s)})
over_measured("tx_title_prefix_rules", lambda s: {"head": X.title_prefix_rules(F.concat(s, F.lit(" with lid and cap (blue) for home")))})
over_measured("tx_head_phrase_full", lambda s: {"head": X.head_phrase(s)})
over_cases("tx_stem", lambda q, t, d, b: {"title": L.normalize(t), "description": L.normalize(d)})
over_cases("tx_segment", lambda q, t, d, b: {"parts": L.segment(q, t)})


@query("tm_positions_stats")
def tm_positions_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five statistics of each of three lists of positions; each list is made once."""
    pairs = {"QinT": ("search_term", "title"), "QinD": ("search_term", "description"), "QfromT": ("title", "search_term")}
    measures = ("min", "max", "median", "mean", "std")

    def stats(a: Column, b: Column) -> Column:
        return X.let(M.positions(a, b), lambda p: F.struct(*[r6(M.list_stat(p, m) / (X.n_words(b) + 1.0)).alias(m) for m in measures]))

    made = S.search_cases(spark, sf_dir).select("row_id", *[stats(F.col(a), F.col(b)).alias(label) for label, (a, b) in pairs.items()])
    return made.select("row_id", *[F.col(label)[m].alias(f"{m}_of_{label}") for label in pairs for m in measures])


@query("tm_measure_cases")
def tm_measure_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five cases of the measures of each text; the text is normalised once for all."""
    texts = S.measured_texts(spark, sf_dir).select("row_id", "text", L.normalize_rules(F.col("text")).alias("normal"))
    cases = registry.measure_cases(X.joined(X.query_measures(F.col("text"))), X.joined(X.measures(F.col("normal"))))
    made = texts.select("row_id", cases.alias("cases"))
    return made.select("row_id", *[F.col("cases")[f"case{k}"].alias(f"case{k}") for k in range(1, 6)])


@query("tx_punct_rules")
def tx_punct_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", X.apply_steps(F.lower("text"), X.PUNCTUATION).alias("plain"))


@query("tx_entity_unescape")
def tx_entity_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "pages").select("page_id", X.apply_steps(F.lower("html"), X.CLEANING).alias("plain"))


@query("tx_spell_dict")
def tx_spell_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole queries replaced through a table: of those that start with the same two letters the least stands for all."""
    words = S.search_terms(spark, sf_dir).select("qid", F.lower("search_term").alias("q"))
    fixes = words.groupBy(F.substring("q", 1, 2).alias("head")).agg(F.min("q").alias("fixed"))
    return words.withColumn("head", F.substring("q", 1, 2)).join(fixes, "head", "left").select("qid", F.coalesce("fixed", "q").alias("q"))


# ---- relational


@query("rel_union_all")
def rel_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = S.search_cases(spark, sf_dir)
    train = cases.where("split = 'train'").select("row_id", "relevance", "title")
    return train.unionByName(cases.where("split = 'test'").select("row_id", "title"), allowMissingColumns=True)


@query("rel_eav_filter")
def rel_eav_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = S.attributes(spark, sf_dir)
    return a.where(F.endswith("name", F.lit("Type"))).select("product_uid", "value")


@query("rel_left_join_brand")
def rel_left_join_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_uid"), "p_name")
    return part.join(R.attribute(S.attributes(spark, sf_dir), "MFG Brand Name", "brand"), "product_uid", "left")


@query("rel_brand_fill")
def rel_brand_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = S.search_cases(spark, sf_dir).select("product_uid", "title", F.when(F.length("title") % 2 == 0, F.col("brand")).alias("brand"))
    brands = S.search_terms(spark, sf_dir).select(F.explode(F.filter(X.ngrams(X.word_tokens(F.col("search_term")), 1), lambda w: F.length(w) <= 4)).alias("brand"))
    return R.fill_brand(cases, brands).select("product_uid", "brand")


@query("rel_semi_join_expand")
def rel_semi_join_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    good = orders.where("o_totalprice > 2").join(urgent, "o_custkey", "left_semi")
    return R.strings_of(good.select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey", "o_orderpriority")


@query("rel_distinct_first")
def rel_distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_of_each(S.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("rel_string_agg")
def rel_string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.strings_of(S.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text")


@query("rel_head_tail_sample")
def rel_head_tail_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = S.search_cases(spark, sf_dir)
    return R.head_and_tail(cases.where("split = 'train'").select("row_id", "relevance"), cases.where("split = 'test'").select("row_id"), 100, "row_id")


@query("rel_sql_export")
def rel_sql_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sql_statements(S.table(spark, sf_dir, "part"), "product", ["p_partkey", "p_name", "p_size"], "p_partkey")


@query("rel_unpivot_columns")
def rel_unpivot_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"], "feature", "value")


# ---- aggregates


@query("agg_history_loo")
def agg_history_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("value"), (F.col("l_linenumber") <= 4).alias("known"))
    out = R.leave_one_out(li, "l_partkey", "value", F.col("known"))
    return out.select("l_orderkey", "l_linenumber", r6(F.col("l_partkey_hist_rel")).alias("rel"), F.col("l_partkey_hist_count").cast("long").alias("n"), r6(F.col("l_partkey_hist_cmb")).alias("cmb"))


@query("agg_query_class")
def agg_query_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.query_classes(S.search_cases(spark, sf_dir), "search_term", "relevance")


@query("agg_list_stats")
def agg_list_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = S.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("v"))
    return lists.select("l_orderkey", *[r6(M.list_stat(F.col("v"), m)).alias(m) for m in ("max", "min", "mean", "median", "std")])


@query("agg_minmax_scale")
def agg_minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), "p_retailprice", F.lit(1.0).alias("same"))
    scaled = R.min_max_scaled(part, ["size", "p_retailprice", "same"])
    return scaled.select("p_partkey", r6(F.col("size")).alias("size"), r6(F.col("p_retailprice")).alias("price"), "same")


def _preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three predictions of a line's quantity, as trials would leave them."""
    li = S.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("y"), (F.col("l_quantity") * 0.9 + F.col("l_linenumber")).alias("p1"), (25 + (F.col("l_quantity") - 25) * F.col("l_discount") * 5).alias("p2"), (F.col("l_extendedprice") / 1500).alias("p3"))


@query("agg_rmse")
def agg_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preds(spark, sf_dir).agg(*[r6(E.rmse(F.col(p), F.col("y"))).alias(f"rmse_{p}") for p in ("p1", "p2", "p3")])


@query("agg_corr_distance")
def agg_corr_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preds(spark, sf_dir).agg(*[r6(1 - F.corr(a, b)).alias(f"{a}_{b}") for a, b in (("p1", "p2"), ("p1", "p3"), ("p2", "p3"))])


@query("agg_classification_metrics")
def agg_classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = E.classification_report(_preds(spark, sf_dir).select((F.col("p2") - 24.9).alias("p"), (F.col("y") - 30).alias("y")), "p", "y")
    return report.select("n", *[r6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1", "rmse")])


# ---- corpus


def _idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.idf(S.search_cases(spark, sf_dir), "title")


@query("co_df_idf")
def co_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.idf(S.table(spark, sf_dir, "documents"), "text").select("term", "df", r6(F.col("idf")).alias("idf"))


@query("co_tfidf_long")
def co_tfidf_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = S.search_cases(spark, sf_dir)
    return C.tfidf(cases, "row_id", "title", _idf(spark, sf_dir)).select("row_id", "term", r6(F.col("w")).alias("w"))


@query("co_idf_sum")
def co_idf_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, idf = S.search_cases(spark, sf_dir), C.idf(S.search_cases(spark, sf_dir), "title", 1, 1)
    a = C.idf_sum(cases, "row_id", "search_term", "title", idf).withColumnRenamed("v", "any")
    b = C.idf_sum(cases, "row_id", "search_term", "description", idf, True).withColumnRenamed("v", "exact")
    return a.join(b, "row_id").select("row_id", r6(F.col("any")).alias("any"), r6(F.col("exact")).alias("exact"))


def _cosine(a: str, b: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cases, idf = S.search_cases(spark, sf_dir), _idf(spark, sf_dir)
        out = C.cosine_distance(cases, "row_id", a, b, idf)
        return out.select("row_id", r6(F.col("dist")).alias("dist"))

    return run


QUERIES |= {"co_cosine_qt": _cosine("search_term", "title"), "co_cosine_qd": _cosine("search_term", "description"), "co_cosine_td": _cosine("title", "description")}


def _bm25(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cases = S.search_cases(spark, sf_dir)
        return C.bm25(cases, "row_id", "search_term", cases.select("product_uid", text), "product_uid", text).select("row_id", r6(F.col("score")).alias("score"))

    return run


QUERIES |= {"co_bm25_title": _bm25("title"), "co_bm25_description": _bm25("description")}


@query("co_group_similarity")
def co_group_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "embeddings")
    return C.group_similarity(e, "vec_id", "label", "embedding").select("vec_id", F.col("n").cast("long").alias("n"), r6(F.col("mean_dist")).alias("mean_dist"))


@query("co_group_spread")
def co_group_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = C.group_spread(S.table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return spread.select("vec_id", *[r6(F.col(c)).alias(c) for c in ("max_dist", "min_dist", "std_dist")])


@query("co_query_id")
def co_query_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.query_ids(S.search_cases(spark, sf_dir), "search_term", "split")


@query("co_type_match")
def co_type_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = S.attributes(spark, sf_dir).where(F.endswith("name", F.lit("Type"))).select("product_uid", "name", F.lower("value").alias("types"))
    joined = R.strings_of(types, "product_uid", "name", "types")
    part = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_uid"), F.lower("p_name").alias("name"))
    return part.join(joined, "product_uid", "left").select("product_uid", F.coalesce(M.common_count(F.col("name"), F.col("types")), F.lit(0)).alias("n"))


def _word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as groups of vectors: a row of three for the query side, the label's others for the title side."""
    return S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"))


@query("co_w2v_avg_all")
def co_w2v_avg_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As co_w2v_avg, whose SQL takes three words, over all words of the query."""
    return _nearest_words(spark, sf_dir, X.tokens(F.col("search_term")))


@query("co_w2v_avg")
def co_w2v_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_words(spark, sf_dir, F.slice(X.tokens(F.col("search_term")), 1, 3))


def _nearest_words(spark: SparkSession, sf_dir: str, words: Column) -> DataFrame:
    cases = S.search_cases(spark, sf_dir).select("row_id", words.alias("q"), X.tokens(F.col("title")).alias("t"))
    size = lambda w: (F.length(w) * 7 % 100).cast("string")  # noqa: E731  a word's vector is that of its length
    left = cases.select("row_id", F.posexplode("q").alias("pos", "w")).select("row_id", "pos", size(F.col("w")).alias("word"))
    right = cases.select("row_id", F.explode("t").alias("w")).select("row_id", size(F.col("w")).alias("word")).distinct()
    near = C.nearest_of_words(left, right, "row_id", _word_vectors(spark, sf_dir))
    return near.select("row_id", r6(F.col("avg_max_sim")).alias("avg_max_sim"), r6(F.col("avg_min_dist")).alias("avg_min_dist"))


@query("idf_noun_sum")
def idf_noun_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, idf = S.search_cases(spark, sf_dir), C.idf(S.search_cases(spark, sf_dir), "title", 1, 1)
    return C.noun_idf_sum(cases, "row_id", "title", "description", idf).select("row_id", r6(F.col("v")).alias("v"))


@query("idf_noun_topk")
def idf_noun_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, idf = S.search_cases(spark, sf_dir), C.idf(S.search_cases(spark, sf_dir), "title", 1, 1)
    return C.top_noun_matches(cases, "row_id", "description", "title", idf, 3).select("row_id", F.col("v").cast("long").alias("v"))


# ---- evaluation and models


@query("ev_badcase_topk")
def ev_badcase_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _preds(spark, sf_dir).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), r6(F.col("p1")).alias("pred"), "y")
    return R.bad_cases(p, "pred", "y", "id", 50).select("id", "side", r6(F.col("diff")).alias("diff"))


@query("ev_leaderboard")
def ev_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _preds(spark, sf_dir).unpivot(["y"], ["p1", "p2", "p3"], "trial", "pred")
    return p.groupBy("trial").agg(r6(E.rmse(F.col("pred"), F.col("y"))).alias("loss")).withColumn("place", F.rank().over(Window.orderBy("loss")))


@query("ev_bucket_relevance")
def ev_bucket_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(1 + F.col("l_discount") * 20, 2).alias("v"))
    return li.select("l_orderkey", "l_linenumber", R.relevance_bucket(F.col("v")).alias("bucket"))


@query("ev_discretise")
def ev_discretise(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(1 + F.col("l_quantity") / 25, 2).alias("v"))
    return li.select("l_orderkey", "l_linenumber", R.snap(F.col("v")).alias("v"))


@query("ev_clip")
def ev_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(R.clip(F.col("l_quantity") / 15)).alias("v"))


@query("ml_folds")
def ml_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.folds(S.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("ml_ordinal_vote")
def ml_ordinal_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    chances = [F.least(F.lit(1.0), F.col("l_quantity") / (50 - 6 * i)) for i in range(6)]
    return li.select("l_orderkey", "l_linenumber", E.ordinal_vote(chances).alias("label"))


@query("ml_three_part_labels")
def ml_three_part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, mid, high = E.three_parts(F.col("l_quantity") / 17)
    return S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", low.cast("long").alias("low"), mid.cast("long").alias("mid"), high.cast("long").alias("high"))


@query("ml_best_split")
def ml_best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("double").alias("line"), "l_discount", "l_tax", (F.col("l_quantity") - 25.5).alias("r"))
    return E.best_split(li, ["line", "l_discount", "l_tax"], "r", 1.0).select("feature", "border", F.round("gain", 4).alias("gain"))


@query("ml_losses")
def ml_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = F.col("l_quantity") / 10 - 2.5, F.when(F.col("l_tax") > 0.04, 1.0).otherwise(-1.0)
    made = {f"{k}_{n}": r6(c) for k in ("square", "logistic", "expo") for n, c in zip(("loss", "d1", "d2"), E.loss(k, p, y))}
    return S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in made.items()])


@query("ml_leaf_weight_newton")
def ml_leaf_weight_newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One damped Newton step of each leaf's weight under an L2 penalty, on the logistic loss."""
    y = F.when(F.col("l_tax") > 0.04, 1.0).otherwise(-1.0)
    _, d1, d2 = E.loss("logistic", F.lit(0.0), y)
    leaves = S.table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.sum(d1).alias("g"), F.sum(d2).alias("h"))
    return leaves.select("l_linenumber", r6(-F.col("g") * 0.5 / (F.col("h") + 1.0)).alias("delta"))


@query("ens_average")
def ens_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _preds(spark, sf_dir)
    return p.select("l_orderkey", "l_linenumber", r6((F.col("p1") + F.col("p2") + F.col("p3")) / 3).alias("pred"))


@query("ens_gram")
def ens_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("p1", "p1"), ("p1", "p2"), ("p2", "p2"), ("p2", "p3"), ("p3", "y"), ("p1", "y")]
    return _preds(spark, sf_dir).agg(*[F.round(F.sum(F.col(a) * F.col(b)), 2).alias(f"{a}_{b}") for a, b in pairs])


@query("ens_greedy_step")
def ens_greedy_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = E.greedy_selection(_preds(spark, sf_dir), ["p1", "p2", "p3"], "y", 1)
    return spark.createDataFrame([(n, round(e, 6)) for n, e in steps], "trial string, rmse double")


@query("features_row_local")
def features_row_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All registered row features of every search case."""
    cases = registry.raw_cases(S.search_cases(spark, sf_dir))
    return registry.with_features(cases, registry.REGISTRY).select("row_id", *sorted(registry.REGISTRY))


# ---- fitted models: no SQL


NUMERIC = ["word_in_title", "word_in_description", "len_of_title", "len_of_description", "ratio_title", "query_title_jaccard_1", "noun_of_title", "chars_of_query"]


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = registry.raw_cases(S.search_cases(spark, sf_dir))
    return stored(registry.with_features(cases, NUMERIC).select("row_id", "relevance", *NUMERIC), "model-rows")


def _model(family: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from lexaline.models import learners

        rows = _model_rows(spark, sf_dir)
        return learners.predict(learners.fit(family, rows, NUMERIC, "relevance"), rows, NUMERIC)

    return run


QUERIES |= {f"ml_{family}": _model(family) for family in ("forest", "boosted", "ridge", "linear", "lasso")}


@query("ml_oof")
def ml_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexaline.models import learners

    return learners.out_of_fold("ridge", _model_rows(spark, sf_dir), NUMERIC, "relevance")


@query("ml_tuning")
def ml_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexaline.models import learners

    trials = learners.search("ridge", _model_rows(spark, sf_dir), NUMERIC, "relevance", {"regParam": [0.01, 0.1, 1.0]}, 3, subset=0.8)
    return spark.createDataFrame([(t["loss"], str(t["params"]), t["features"]) for t in trials], "loss double, params string, features array<string>")


@query("ml_stacking")
def ml_stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexaline.models import learners

    rows = _model_rows(spark, sf_dir)
    level_one = {f: learners.out_of_fold(f, rows, NUMERIC, "relevance") for f in ("ridge", "linear")}
    truth = rows.where("relevance is not null").select("row_id", F.col("relevance").alias("truth"))
    test = rows.where("relevance is null")
    asked = {f: learners.predict(learners.fit(f, rows, NUMERIC, "relevance"), test, NUMERIC) for f in level_one}
    return learners.stacked(level_one, truth, asked)[1]


@query("ml_ordinal")
def ml_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexaline.models import learners

    rows = _model_rows(spark, sf_dir)
    return learners.ordinal(rows, rows, NUMERIC, "relevance")


@query("ml_classes")
def ml_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexaline.models import learners

    rows = _model_rows(spark, sf_dir)
    return learners.classes(rows, rows, NUMERIC, "relevance")


@query("ml_greedy_forest")
def ml_greedy_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexaline.models import greedy_forest

    rows = _model_rows(spark, sf_dir)
    return rows.select("row_id", greedy_forest.fit(rows, NUMERIC, "relevance").predict().alias("pred"))


@query("co_svd")
def co_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexaline.operators import vectors as V

    cases = S.search_cases(spark, sf_dir)
    return V.svd(V.tfidf_weights(cases, "row_id", "description"), "row_id", cases, 10)


@query("co_plane")
def co_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexaline.operators import vectors as V

    e = S.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return V.plane(e, "vec_id", "v")


@query("st_history")
def st_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexaline.streaming.history import running_history

    out = running_history(S.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "value", "ts")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", r6(F.col("mean")).alias("mean"))
