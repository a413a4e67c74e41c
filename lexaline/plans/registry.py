"""Named features with declared inputs, planned into few projections.

A row feature is a column expression over other columns. The planner walks the inputs of what is asked for, leaves out
what a feature store has already, and puts features whose inputs exist into one projection after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaline.functions import linguistics as L
from lexaline.functions import matching as M
from lexaline.functions import text as X

BASE_COLUMNS = ("row_id", "product_uid", "search_term", "title", "description", "brand", "relevance", "split")


@dataclass(frozen=True)
class Feature:
    name: str
    inputs: tuple[str, ...]
    build: Callable[..., Column]


#: The names of all features registered below, by which settings ask for them.
REGISTRY: dict[str, Feature] = {}


def feature(name: str, build: Callable[..., Column], *inputs: str) -> None:
    """Register a feature; ``build`` gets a column for each input."""
    if name in REGISTRY:
        raise ValueError(f"{name} is registered already")
    REGISTRY[name] = Feature(name, inputs, build)


def ratio(name: str, over: str, under: str) -> None:
    feature(name, lambda x, y: x / (y + 1.0), over, under)


def _register_texts() -> None:
    feature("ori_stem_search_term", L.normalize, "query_raw")
    feature("origin_search_term", lambda q: q, "query_raw")
    feature("typeid", lambda t: X.normalize_model_numbers(X.model_numbers(t)), "title_raw")
    feature("title", L.normalize, "title_raw")
    feature("main_title", lambda t: L.normalize(L.head_phrase(t)), "title_raw")
    feature("search_term", lambda q: F.when(X.is_meaningful(q), X.without_stop_words(q)).otherwise(""), "ori_stem_search_term")
    feature("description", L.normalize, "description_raw")
    feature("brand", L.normalize, "brand_raw")
    feature("numsize_of_query", lambda q: X.joined(X.query_measures(q)), "ori_stem_search_term")
    for name in ("title", "main_title", "description"):
        feature(f"numsize_of_{name}", lambda t: X.joined(X.measures(t)), name)
    for n in (1, 2):
        for m in (1, 2):
            for name in ("title", "description"):
                feature(f"query_{name}_co_occur_{n}{m}gram", lambda q, t, n=n, m=m: X.joined(M.pair_grams(q, t, n, m)), "ori_stem_search_term", name)


def _register_matches() -> None:
    q, ori = "search_term", "ori_stem_search_term"
    feature("ori_query_in_title", M.phrase_count, ori, "title")
    for name in ("main_title", "title", "description"):
        feature(f"query_in_{name}", M.phrase_count, q, name)
        feature(f"query_last_word_in_{name}", lambda a, b: M.common_count(F.coalesce(F.try_element_at(X.tokens(a), F.lit(-1)), F.lit("")), b), q, name)
        feature(f"word_in_{name}", M.common_count, q, name)
        feature(f"word_in_{name}_exact", lambda a, b: M.common_count(a, b, True), q, name)
        feature(f"bigram_in_{name}", M.common_bigrams, q, name)
    for name in ("main_title", "title"):
        feature(f"word_in_{name}_weighted", M.common_weighted, q, name)
        feature(f"word_in_{name}_ordered", M.common_ordered, q, name)
    feature("ori_word_in_title_ordered", M.common_ordered, ori, "title")
    feature("word_in_brand", M.common_count, q, "brand")
    feature("word_in_typeid", M.common_count, ori, "typeid")
    feature("bigram_in_brand", M.common_bigrams, q, "brand")
    feature("search_term_fuzzy_match", L.segment, q, "title")
    feature("len_of_search_term_fuzzy_match", X.n_words, "search_term_fuzzy_match")
    feature("word_with_er_count_in_query", M.er_count, q)
    feature("word_with_er_count_in_title", M.er_count, "title")
    feature("first_er_in_query_occur_position_in_title", M.er_position, q, "title")
    feature("len_of_query", X.n_words, q)
    for name in ("main_title", "title", "description", "brand"):
        feature(f"len_of_{name}", X.n_words, name)
    feature("chars_of_typeid", F.length, "typeid")
    feature("chars_of_query", F.length, q)
    for name, over in (
        ("main_title", "word_in_main_title"), ("main_title_exact", "word_in_main_title_exact"), ("main_title_ordered", "word_in_main_title_ordered"),
        ("title", "word_in_title"), ("title_exact", "word_in_title_exact"), ("title_ordered", "word_in_title_ordered"), ("ori_title_ordered", "ori_word_in_title_ordered"),
        ("description", "word_in_description"), ("description_exact", "word_in_description_exact"), ("brand", "word_in_brand"), ("typeid", "word_in_typeid"),
        ("bigram_title", "bigram_in_title"), ("bigram_main_title", "bigram_in_main_title"), ("bigram_description", "bigram_in_description"), ("bigram_brand", "bigram_in_brand"),
    ):
        ratio(f"ratio_{name}", over, "len_of_query")
    for n in (1, 2):
        for a, b, label in ((q, "title", "query_title"), (q, "description", "query_description"), ("title", "description", "title_description")):
            feature(f"{label}_jaccard_{n}", lambda x, y, n=n: M.jaccard(x, y, n), a, b)
            feature(f"{label}_dicedist_{n}", lambda x, y, n=n: M.dice(x, y, n), a, b)


def _register_places() -> None:
    """Statistics of where tokens match; min is the least place and max the greatest for every pair of texts."""
    for label, a, b, size in (("QinT", "search_term", "title", "len_of_title"), ("QinD", "search_term", "description", "len_of_description"), ("QfromT", "title", "search_term", "len_of_query")):
        for method in ("min", "max", "median", "mean", "std"):
            feature(f"{method}_of_{label}", lambda x, y, n, m=method: M.list_stat(M.positions(x, y), m) / (n + 1.0), a, b, size)


def _register_nouns() -> None:
    for name, of in (("query", "search_term"), ("title", "title"), ("main_title", "main_title"), ("description", "description")):
        feature(f"noun_of_{name}", M.noun_count, of)
    for name in ("main_title", "title", "description"):
        feature(f"noun_match_{name}", M.noun_common, "search_term", name)
        ratio(f"ratio_noun_match_{name}", f"noun_match_{name}", "noun_of_query")
    for name in ("main_title", "title"):
        feature(f"noun_match_{name}_ordered", M.noun_ordered, "search_term", name)
        ratio(f"ratio_noun_match_{name}_ordered", f"noun_match_{name}_ordered", "noun_of_query")
    for k in (1, 2, 3, 5):
        feature("match_last_noun_main" if k == 1 else f"match_last_{k}_noun_main", lambda a, b, k=k: M.last_nouns(a, b, k), "search_term", "main_title")


def _register_measures() -> None:
    for name in ("main_title", "title", "description"):
        feature(f"numsize_count_in_{name}", M.measure_count, "numsize_of_query", name)
        ratio(f"ratio_numsize_{name}", f"numsize_count_in_{name}", "len_of_numsize_query")
        feature(f"len_of_numsize_{name}", X.n_words, f"numsize_of_{name}")
    for name in ("title", "description"):
        feature(f"numsize_match_{name}", M.common_count, "search_term", f"numsize_of_{name}")
        feature(f"numsize_match_{name}_exact", lambda a, b: M.common_count(a, b, True), "search_term", f"numsize_of_{name}")
        ratio(f"ratio_numsize_match_{name}", f"numsize_match_{name}", "len_of_numsize_query")
        ratio(f"ratio_numsize_match_{name}_exact", f"numsize_match_{name}_exact", "len_of_numsize_query")
        for case in range(1, 6):
            feature(f"numsize_{name}_case{case}", lambda a, b, c=case: measure_case(a, b, c), "numsize_of_query", f"numsize_of_{name}")
    feature("chars_of_numsize_query", F.length, "numsize_of_query")
    feature("len_of_numsize_query", X.n_words, "numsize_of_query")


def measure_cases(a: Column, b: Column) -> Column:
    """Struct of case1 to case5: neither has measures (1), only b (2), only a (3), both but none in common (4), some in common
    (5). Each text is looked at once."""

    def cases(x: Column, y: Column) -> Column:
        some_x, some_y, both = F.size(x) > 0, F.size(y) > 0, F.coalesce(F.arrays_overlap(x, y), F.lit(False))
        every = (~some_x & ~some_y, ~some_x & some_y, some_x & ~some_y, some_x & some_y & ~both, some_x & some_y & both)
        return F.struct(*[c.alias(f"case{k}") for k, c in enumerate(every, 1)])

    return X.let(X.tokens(a), lambda x: X.let(X.tokens(b), lambda y: cases(x, y)))


def measure_case(a: Column, b: Column, case: int) -> Column:
    return measure_cases(a, b)[f"case{case}"]


for _register in (_register_texts, _register_matches, _register_places, _register_nouns, _register_measures):
    _register()


def layers(wanted: Iterable[str], present: Iterable[str]) -> list[list[str]]:
    """Features to compute, as lists whose inputs exist once the lists before are done. Unknown names and cycles raise."""
    have, need, todo = set(present), {}, list(wanted)
    while todo:
        name = todo.pop()
        if name in have or name in need:
            continue
        if name not in REGISTRY:
            raise KeyError(f"no column or feature {name!r}")
        need[name] = REGISTRY[name]
        todo += REGISTRY[name].inputs
    out = []
    while need:
        ready = sorted(n for n, f in need.items() if all(i in have for i in f.inputs))
        if not ready:
            raise ValueError(f"features need each other: {sorted(need)}")
        out.append(ready)
        have.update(ready)
        for n in ready:
            del need[n]
    return out


def raw_cases(cases: DataFrame) -> DataFrame:
    """Search cases with their texts under raw names, so that features can take the plain ones."""
    return cases.select("row_id", "product_uid", F.col("search_term").alias("query_raw"), F.col("title").alias("title_raw"), F.col("description").alias("description_raw"), F.col("brand").alias("brand_raw"), "relevance", "split")


def with_features(cases: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """``cases`` with the wanted row features, and those they are made of."""
    for layer in layers(wanted, cases.columns):
        cases = cases.withColumns({n: REGISTRY[n].build(*[F.col(i) for i in REGISTRY[n].inputs]) for n in layer})
    return cases
