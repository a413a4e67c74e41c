"""Independent DuckDB SQL of the relevance queries."""

from __future__ import annotations

from lexaline.functions import text as X

ORACLES: dict[str, str] = {}

BS = "\\"


def tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda z: z <> '')"


def wtok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')"


def ngram(words: str, n: int) -> str:
    parts = ", ".join(f"({words})[{i + 1}:{i - n if i < n - 1 else ''}]" for i in range(n))
    return f"list_transform(list_zip({parts}), lambda p: {chr(32).join(f'p[{i + 1}]' + (f' {chr(124) * 2} {chr(39)} {chr(39)} {chr(124) * 2}' if i < n - 1 else '') for i in range(n))})"


def bi(x: str) -> str:
    return ngram(wtok(x), 2)


CASES = f"""
product AS (SELECT doc_id AS product_uid, lower(array_to_string(({tok('text')})[1:12], ' ')) AS title, lower(text) AS description, lower(source) AS brand FROM documents),
term AS (SELECT item_id AS qid, lower(array_to_string(({tok('text')})[1:4], ' ')) AS search_term FROM benchmark),
cases AS (SELECT product_uid AS row_id, product_uid, search_term AS q, title AS t, description AS d, brand AS b, CAST(1 + quality + (1 - toxic) AS DOUBLE) AS relevance
  FROM product JOIN term ON qid = product_uid % (SELECT count(*) FROM benchmark) LEFT JOIN labels ON doc_id = product_uid)"""
MEASURED = """
measured AS (SELECT p_partkey AS row_id, p_name || ' ' || p_size || ' inches x ' || ' ' || (p_size % 7) || 'ft, two gallons by ' || ' ' || (p_size * 2) || '-Volt &amp; 1,000 lbs. 5% AB-12C' || ' ' || p_type AS s FROM part)"""
PREDS = """
preds AS (SELECT l_orderkey, l_linenumber, l_quantity AS y, l_quantity * 0.9 + l_linenumber AS p1, 25 + (l_quantity - 25) * l_discount * 5 AS p2, l_extendedprice / 1500 AS p3 FROM lineitem)"""


def cases(name: str, columns: dict[str, str]) -> None:
    ORACLES[name] = f"WITH {CASES} SELECT row_id, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM cases"


def measured(name: str, columns: dict[str, str]) -> None:
    ORACLES[name] = f"WITH {MEASURED} SELECT row_id, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM measured"


def r6(e: str) -> str:
    return f"round({e}, 6)"


def phrase(p: str, s: str) -> str:
    return f"CASE WHEN trim({p}) = '' THEN 0 ELSE CAST((len({s}) - len(replace({s}, {p}, ''))) // len({p}) AS INTEGER) END"


def common(a: str, b: str, exact: bool = False) -> str:
    return f"CAST(len(list_filter({tok(a)}, lambda w: {'list_contains(' + tok(b) + ', w)' if exact else f'contains({b}, w)'})) AS INTEGER)"


def weighted(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform({tok(a)}, lambda w, i: CASE WHEN contains({b}, w) THEN pow(1e6, i / len({tok(a)})) ELSE 0.0 END)), 0.0)"


def ordered(a: str, b: str) -> str:
    step = "CASE WHEN instr(acc.rest, x) > 0 THEN {'rest': substr(acc.rest, instr(acc.rest, x) + len(x)), 'n': acc.n + 1} ELSE acc END"
    return f"CAST(list_reduce({tok(a)}, lambda acc, x: {step}, {{'rest': {b}, 'n': 0}}).n AS INTEGER)"


def places(a: str, b: str) -> str:
    return f"list_filter(list_transform({tok(b)}, lambda w, i: CASE WHEN len(list_filter({tok(a)}, lambda o: contains(w, o))) > 0 THEN i END), lambda v: v IS NOT NULL)"


def stat(v: str, method: str) -> str:
    f = {"min": "min", "max": "max", "mean": "avg", "median": "median", "std": "stddev_samp"}[method]
    return f"coalesce(list_aggregate(list_transform({v}, lambda e: CAST(e AS DOUBLE)), '{f}'), 0.0)"


def stats(a: str, b: str, label: str) -> dict[str, str]:
    return {f"{m}_of_{label}": r6(f"{stat(places(a, b), m)} / (len({tok(b)}) + 1.0)") for m in ("min", "max", "median", "mean", "std")}


def jaccard(a: str, b: str) -> str:
    x, y = (f"list_distinct({tok(c)})" for c in (a, b))
    both = f"len(list_intersect({x}, {y}))"
    return r6(f"coalesce({both} / nullif(len({x}) + len({y}) - {both}, 0), 0.0)")


def dice(a: str, b: str) -> str:
    x, y = (f"list_distinct({tok(c)})" for c in (a, b))
    return r6(f"coalesce(2.0 * len(list_intersect({x}, {y})) / nullif(len({x}) + len({y}), 0), 0.0)")


def er(x: str) -> str:
    return f"list_filter({tok(x)}, lambda w: ends_with(w, 'er'))"


def last(a: str) -> str:
    return f"coalesce(({tok(a)})[-1], '')"


def pairs(a: str, b: str, n: int, m: int) -> str:
    x, y = (tok(c) if k == 1 else f"list_transform({bi(c)}, lambda g: replace(g, ' ', '_'))" for c, k in ((a, n), (b, m)))
    return f"array_to_string(flatten(list_transform({x}, lambda v: list_transform({y}, lambda w: v || '_' || w))), ' ')"


TAG = """CASE WHEN regexp_matches(w, '^[0-9]') THEN 'CD' WHEN w IN ('the','a','an','this','that','these','those') THEN 'DT'
 WHEN w IN ('of','in','on','at','by','for','with','from','xbi') THEN 'IN' WHEN w IN ('and','or','but') THEN 'CC' WHEN w = 'to' THEN 'TO' WHEN w IN ('is','are','was','be') THEN 'VB'
 WHEN ends_with(w, 'ing') THEN 'VBG' WHEN ends_with(w, 'ed') THEN 'VBD' WHEN ends_with(w, 'ly') THEN 'RB' WHEN ends_with(w, 'ble') OR ends_with(w, 'ous') OR ends_with(w, 'ful') THEN 'JJ'
 WHEN ends_with(w, 's') AND len(w) > 3 THEN 'NNS' ELSE 'NN' END"""


def nouns(x: str) -> str:
    return f"list_filter({tok(x)}, lambda w: {TAG} = 'NN')"


#: Tokens ta found from left to right among the nouns nb.
NOUN_ORDERED = "CAST(list_reduce(ta, lambda acc, x: CASE WHEN coalesce(list_position(nb[acc.p + 1:], x), 0) > 0 THEN {'p': acc.p + list_position(nb[acc.p + 1:], x), 'n': acc.n + 1} ELSE acc END, {'p': CAST(0 AS BIGINT), 'n': 0}).n AS INTEGER)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def steps(x: str, todo: list[X.Step]) -> str:
    for s in todo:
        if s.kind == "text":
            x = f"replace({x}, {quoted(s.find)}, {quoted(s.put)})"
        else:
            put = s.put.replace("$", BS)
            find = s.find
            if s.tail:
                find, put = f"{find}(\\s|$)", f"{put}{BS}2"
            x = f"regexp_replace({x}, {quoted(find)}, {quoted(put)}, 'g')"
    return x


def staged(source: str, key: str, first: str, *more: list[X.Step] | str) -> str:
    """CTEs that apply a few steps each, so that no expression grows too deep."""
    out, n = [f"s0 AS (SELECT {key}, {first} AS x FROM {source})"], 0
    for part in more:
        for at in range(0, len(part), 8) if isinstance(part, list) else [None]:
            e = part if at is None else steps("x", part[at : at + 8])
            n += 1
            out.append(f"s{n} AS (SELECT {key}, {e} AS x FROM s{n - 1})")
    return ", ".join(out) + f", last AS (SELECT {key}, x FROM s{n})"


DIGITS = f"array_to_string(list_transform(string_split(x, ' '), lambda w: CASE w {' '.join(f'WHEN {quoted(w)} THEN {quoted(str(i))}' for i, w in enumerate(X.NUMBER_WORDS))} ELSE w END), ' ')"
TIDY = f"array_to_string({tok('x')}, ' ')"
NORMAL = staged("measured", "row_id", "lower(s)", X.CLEANING, X.PUNCTUATION, X.SPLITTING, DIGITS, X.DIMENSIONS, X.MEASURING, TIDY)
STOP = "[" + ", ".join(map(quoted, X.STOP_WORDS)) + "]"
KEEP = f"lambda w: NOT list_contains({STOP}, w)"

cases("tm_phrase_count", {"query_in_title": phrase("q", "t"), "query_in_description": phrase("q", "d"), "brand_in_description": phrase("b", "d"), "of_in_description": phrase("'of'", "d")})
cases("tm_last_word", {"last_in_title": common(last("q"), "t"), "last_in_description": common(last("q"), "d")})
cases("tm_common_substring", {"word_in_title": common("q", "t"), "word_in_description": common("q", "d"), "word_in_brand": common("q", "b"), "title_in_description": common("t", "d")})
cases("tm_common_exact", {"word_in_title_exact": common("q", "t", True), "word_in_description_exact": common("q", "d", True), "title_in_description_exact": common("t", "d", True)})
cases("tm_common_weighted", {"title_weighted": r6(weighted("q", "t")), "description_weighted": r6(weighted("q", "d"))})
cases("tm_common_bigram", {c: f"CAST(len(list_filter({bi(a)}, lambda g: contains(lower({x}), g))) AS INTEGER)" for c, a, x in (("bigram_in_title", "q", "t"), ("bigram_in_description", "q", "d"), ("title_bigram_in_description", "t", "d"))})
cases("tm_common_ordered", {"word_in_title_ordered": ordered("q", "t"), "title_in_description_ordered": ordered("t", "d")})
cases("tm_positions_stats", stats("q", "t", "QinT") | stats("q", "d", "QinD") | stats("t", "q", "QfromT"))
cases("tm_jaccard_dice_uni", {f"{n}_{f.__name__}": f(a, b) for n, a, b in (("qt", "q", "t"), ("qd", "q", "d"), ("td", "t", "d")) for f in (jaccard, dice)})
_WORDS = "AS MATERIALIZED (SELECT row_id, " + ", ".join(f"{wtok(c)} AS {c}w" for c in "qtd") + " FROM cases)"
_SETS = "AS MATERIALIZED (SELECT row_id, " + ", ".join(f"list_distinct({ngram(c + 'w', 2)}) AS {c}" for c in "qtd") + " FROM words)"
ORACLES["tm_jaccard_dice_bi"] = f"WITH {CASES}, words {_WORDS}, sets {_SETS} SELECT row_id, " + ", ".join(f"round(coalesce(len(list_intersect({a}, {b})) / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0), 0.0), 6) AS {a}{b}_jaccard, round(coalesce(2.0 * len(list_intersect({a}, {b})) / nullif(len({a}) + len({b}), 0), 0.0), 6) AS {a}{b}_dice" for a, b in (("q", "t"), ("t", "d"))) + " FROM sets"
cases("tm_er_words", {"er_in_query": f"CAST(len({er('q')}) AS INTEGER)", "er_in_title": f"CAST(len({er('t')}) AS INTEGER)", "er_in_description": f"CAST(len({er('d')}) AS INTEGER)", "er_position": f"CAST(coalesce(nullif(list_position({tok('t')}, ({er('d')})[1]), 0) - 1, -1) AS INTEGER)"})
cases("tm_lengths", {"len_of_query": f"CAST(len({tok('q')}) AS INTEGER)", "len_of_title": f"CAST(len({tok('t')}) AS INTEGER)", "len_of_description": f"CAST(len({tok('d')}) AS INTEGER)", "len_of_brand": f"CAST(len({tok('b')}) AS INTEGER)", "chars_of_query": "CAST(len(q) AS INTEGER)", "chars_of_description": "CAST(len(d) AS INTEGER)"})
cases("tm_ratios", {"ratio_title": r6(f"{common('q', 't')} / (len({tok('q')}) + 1.0)"), "ratio_description": r6(f"{common('q', 'd')} / (len({tok('q')}) + 1.0)"), "ratio_safe": r6(f"coalesce(CAST({common('q', 't')} AS DOUBLE) / nullif({common('q', 'd')}, 0), 0.0)")})
for _n in (1, 2):
    for _m in (1, 2):
        cases(f"tm_cooccur_{_n}{_m}", {"pairs": pairs("q", "t", _n, _m)})
cases("tx_stopwords", {"title": f"array_to_string(list_filter({tok('t')}, {KEEP}), ' ')", "description_len": f"CAST(len(list_filter({tok('d')}, {KEEP})) AS INTEGER)"})
cases("tx_meaningful", {c: f"len(list_filter({tok(x)}, lambda w: len(w) > 2 AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains({STOP}, w))) > 0" for c, x in (("query_ok", "q"), ("title_ok", "t"))})
cases("tx_ngrams_1_3", {"bi": f"array_to_string({bi('t')}, ',')", "tri": f"array_to_string({ngram(wtok('t'), 3)}, ',')"})
cases("tx_exclude", {"left": f"trim(regexp_replace(list_reduce({tok('q')}, lambda acc, x: replace(acc, x, ''), t), ' +', ' ', 'g'))"})
cases("pos_noun_count", {f"noun_of_{n}": f"CAST(len({nouns(x)}) AS INTEGER)" for n, x in (("query", "q"), ("title", "t"), ("description", "d"))})
cases("pos_noun_common", {c: f"CAST(len(list_filter({tok(a)}, lambda o: list_contains({nouns(x)}, o))) AS INTEGER)" for c, a, x in (("noun_match_title", "q", "t"), ("noun_match_description", "t", "d"))})
ORACLES["pos_noun_ordered"] = f"""WITH {CASES}, a AS (SELECT row_id, {tok('q')} AS ta, {nouns('t')} AS nb FROM cases), b AS (SELECT row_id, {tok('t')} AS ta, {nouns('d')} AS nb FROM cases)
SELECT row_id, {NOUN_ORDERED} AS noun_title_ordered, x.n AS noun_description_ordered FROM a JOIN (SELECT row_id, {NOUN_ORDERED} AS n FROM b) x USING (row_id)"""
cases("pos_last_k_noun", {f"last_{k}": f"CAST(len(list_filter((list_reverse({nouns('t')}))[1:{k}], lambda w: contains(d, w))) AS INTEGER)" for k in (1, 2, 3, 5)})
ORACLES["tx_unit_rules"] = f"WITH {MEASURED}, {NORMAL} SELECT row_id, x AS normal FROM last"
ORACLES["tx_number_words"] = f"WITH {MEASURED}, m AS (SELECT row_id, s AS x FROM measured) SELECT row_id, {DIGITS} AS digits FROM m"
TYPEID = f"array_to_string(list_concat(list_filter({tok('s')}, lambda w: regexp_full_match(w, {quoted(X.MODEL_NUMBER)})), list_filter({tok('s')}, lambda w: regexp_full_match(w, {quoted(X.SIZE_NUMBER)}))), ' ')"
measured("tx_typeid", {"typeid": TYPEID})
measured("tx_typeid_norm", {"typeid": f"replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({TYPEID}), '([0-9])([a-z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g'), '([a-z]) *\\. *([a-z])', '\\1 \\2', 'g'), '([a-z]) */ *([a-z])', '\\1 \\2', 'g'), '#(\\S)', '# \\1', 'g'), '-', ' ')"})
measured("tm_measures_query", {"measures": "array_to_string(regexp_extract_all(s, '\\d+\\S*'), ' ')"})
measured("tm_measure_count", {"n": "CAST(coalesce(list_sum(list_transform(regexp_extract_all(s, '\\d+\\S*'), lambda w: (len(s) - len(replace(s, w, ''))) // len(w))), 0) AS INTEGER)"})
measured("tx_title_prefix_rules", {"head": "replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s || ' with lid and cap (blue) for home', '\\([^\\)]*\\)', '', 'g'), '-DISCONTINUED$', ''), ' [Ww]ith .* [Aa]nd .*$', ''), ' [Ff]or .*$', ''), ' [Ii]ncludes .*$', ''), ' [Ww]ithout .*$', ''), ' - .* [Nn]ot [Ii]ncluded\\s*$', ''), '  ', ' ')"})
ORACLES["tx_punct_rules"] = f"WITH {staged('documents', 'doc_id', 'lower(text)', X.PUNCTUATION)} SELECT doc_id, x AS plain FROM last"
ORACLES["tx_entity_unescape"] = f"WITH {staged('pages', 'page_id', 'lower(html)', X.CLEANING)} SELECT page_id, x AS plain FROM last"
ORACLES["tx_spell_dict"] = f"WITH {CASES}, f AS (SELECT substr(search_term, 1, 2) h, min(search_term) fixed FROM term GROUP BY 1) SELECT qid, coalesce(fixed, search_term) AS q FROM term LEFT JOIN f ON h = substr(search_term, 1, 2)"

ORACLES["rel_union_all"] = f"WITH {CASES} SELECT row_id, relevance, t AS title FROM cases"
ORACLES["rel_eav_filter"] = "SELECT p_partkey AS product_uid, p_type AS value FROM part WHERE p_type IS NOT NULL"
ORACLES["rel_left_join_brand"] = "SELECT p_partkey AS product_uid, p_name, p_brand AS brand FROM part"
ORACLES["rel_brand_fill"] = f"""WITH {CASES}, k AS (SELECT DISTINCT unnest({wtok('search_term')}) AS gram FROM term), known AS (SELECT gram FROM k WHERE len(gram) <= 4),
w AS (SELECT product_uid, {wtok('t')} AS w FROM cases WHERE len(t) % 2 <> 0), g AS (SELECT product_uid, unnest(range(1, len(w) + 1)) AS i, w FROM w),
f AS (SELECT product_uid, arg_max(w[i], i) AS found FROM g JOIN known ON gram = w[i] GROUP BY 1)
SELECT cases.product_uid, CASE WHEN len(t) % 2 = 0 THEN b ELSE found END AS brand FROM cases LEFT JOIN f USING (product_uid)"""
ORACLES["rel_semi_join_expand"] = "SELECT o_custkey, string_agg(o_orderpriority, ' ' ORDER BY o_orderkey) AS o_orderpriority FROM orders WHERE o_totalprice > 2 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1"
ORACLES["rel_distinct_first"] = "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1"
ORACLES["rel_string_agg"] = "SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY 1"
ORACLES["rel_head_tail_sample"] = f"WITH {CASES} SELECT * FROM (SELECT row_id, relevance FROM cases WHERE relevance IS NOT NULL ORDER BY row_id LIMIT 100) UNION ALL SELECT * FROM (SELECT row_id, NULL FROM cases WHERE relevance IS NULL ORDER BY row_id DESC LIMIT 100)"
ORACLES["rel_sql_export"] = """SELECT p_partkey, 'INSERT INTO product (p_partkey, p_name, p_size) VALUES (' || p_partkey || ', "' || replace(p_name, '"', '\\"') || '", ' || p_size || ');' AS statement FROM part"""
ORACLES["rel_unpivot_columns"] = "SELECT l_orderkey, l_linenumber, 'l_quantity' AS feature, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem"

ORACLES["agg_history_loo"] = """WITH g AS (SELECT l_partkey, sum(l_quantity) s, count(*) n FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1), o AS (SELECT sum(l_quantity) / count(*) avg_all FROM lineitem WHERE l_linenumber <= 4),
r AS (SELECT l_orderkey, l_linenumber, coalesce(s, 0) - CASE WHEN l_linenumber <= 4 THEN l_quantity ELSE 0 END s, coalesce(n, 0) - CASE WHEN l_linenumber <= 4 THEN 1 ELSE 0 END n FROM lineitem LEFT JOIN g USING (l_partkey)),
v AS (SELECT l_orderkey, l_linenumber, CASE WHEN n >= 3 THEN s / n ELSE avg_all END rel, CASE WHEN n >= 3 THEN n ELSE 0 END n FROM r, o)
SELECT l_orderkey, l_linenumber, round(rel, 6) AS rel, n, round(sqrt(n + 1) * rel, 6) AS cmb FROM v"""
ORACLES["agg_query_class"] = f"""WITH {CASES}, g AS (SELECT q AS search_term, count(*) FILTER (floor(relevance) = 1) AS n1, count(*) FILTER (floor(relevance) = 2) AS n2, count(*) FILTER (floor(relevance) = 3) AS n3 FROM cases WHERE relevance IS NOT NULL GROUP BY 1)
SELECT *, n1 = 0 AND n3 = 0 AND n2 > 4 AS is_general, n1 > 3 AND n2 = 0 AND n3 = 0 AS is_nonsense FROM g"""
ORACLES["agg_list_stats"] = "SELECT l_orderkey, round(max(l_quantity), 6) AS max, round(min(l_quantity), 6) AS min, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(coalesce(stddev_samp(l_quantity), 0.0), 6) AS std FROM lineitem GROUP BY 1"
ORACLES["agg_minmax_scale"] = "SELECT p_partkey, round((p_size - min(p_size) OVER ()) / CAST(max(p_size) OVER () - min(p_size) OVER () AS DOUBLE), 6) AS size, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS price, 0.0::DOUBLE AS same FROM part"
ORACLES["agg_rmse"] = f"WITH {PREDS} SELECT " + ", ".join(f"round(sqrt(avg(({p} - y) * ({p} - y))), 6) AS rmse_{p}" for p in ("p1", "p2", "p3")) + " FROM preds"
ORACLES["agg_corr_distance"] = f"WITH {PREDS} SELECT " + ", ".join(f"round(1 - corr({a}, {b}), 6) AS {a}_{b}" for a, b in (("p1", "p2"), ("p1", "p3"), ("p2", "p3"))) + " FROM preds"
ORACLES["agg_classification_metrics"] = f"""WITH {PREDS}, s AS (SELECT p2 - 24.9 AS p, y - 30 AS y FROM preds), c AS (SELECT count(*) n, count(*) FILTER (p > 0 AND y > 0) tp, count(*) FILTER (p > 0 AND NOT y > 0) fp, count(*) FILTER (NOT p > 0 AND y > 0) fn, sqrt(avg((p - y) * (p - y))) e FROM s)
SELECT n, round((n - fp - fn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1, round(e, 6) AS rmse FROM c"""


def grams(longest: int = 2) -> str:
    return "w" if longest == 1 else f"list_concat(w, {ngram('w', 2)})"


def idf(source: str, text: str, longest: int = 2, least: int = 2, name: str = "idf") -> str:
    return f"{name}_w AS MATERIALIZED (SELECT {tok(f'lower({text})')} AS w FROM {source}), {name}_t AS (SELECT unnest(list_distinct({grams(longest)})) AS term FROM {name}_w), {name} AS MATERIALIZED (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM {source})) / (1.0 + count(*))) + 1 AS idf FROM {name}_t GROUP BY 1 HAVING count(*) >= {least})"


def tfidf(x: str, name: str) -> str:
    return f"{name}_w AS MATERIALIZED (SELECT row_id, {tok(f'lower({x})')} AS w FROM cases), {name}_g AS (SELECT row_id, unnest({grams()}) AS term FROM {name}_w), {name}_f AS (SELECT row_id, term, count(*) * any_value(idf) AS w FROM {name}_g JOIN idf USING (term) GROUP BY 1, 2), {name} AS (SELECT row_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS w FROM {name}_f)"


ORACLES["co_df_idf"] = f"WITH {idf('documents', 'text')} SELECT term, df, round(idf, 6) AS idf FROM idf"
ORACLES["co_tfidf_long"] = f"WITH {CASES}, {idf('cases', 't')}, {tfidf('t', 'a')} SELECT row_id, term, round(w, 6) AS w FROM a"
ORACLES["co_idf_sum"] = f"""WITH {CASES}, {idf('cases', 't', 1, 1)}, a AS (SELECT row_id, unnest(list_filter({tok('q')}, lambda w: contains(t, w))) AS term FROM cases), b AS (SELECT row_id, unnest(list_filter({tok('q')}, lambda w: list_contains({tok('d')}, w))) AS term FROM cases),
sa AS (SELECT row_id, sum(idf) v FROM a JOIN idf USING (term) GROUP BY 1), sb AS (SELECT row_id, sum(idf) v FROM b JOIN idf USING (term) GROUP BY 1)
SELECT row_id, round(coalesce(sa.v, 0.0) / (len({tok('q')}) + 1.0), 6) AS any, round(coalesce(sb.v, 0.0) / (len({tok('q')}) + 1.0), 6) AS exact FROM cases LEFT JOIN sa USING (row_id) LEFT JOIN sb USING (row_id)"""
for _k, _a, _b in (("qt", "q", "t"), ("qd", "q", "d"), ("td", "t", "d")):
    ORACLES[f"co_cosine_{_k}"] = f"WITH {CASES}, {idf('cases', 't')}, {tfidf(_a, 'a')}, {tfidf(_b, 'b')}, p AS (SELECT a.row_id, sum(a.w * b.w) s FROM a JOIN b ON a.row_id = b.row_id AND a.term = b.term GROUP BY 1) SELECT row_id, round(1 - coalesce(s, 0.0), 6) AS dist FROM cases LEFT JOIN p USING (row_id)"
for _k, _x in (("title", "t"), ("description", "d")):
    ORACLES[f"co_bm25_{_k}"] = f"""WITH {CASES}, docs AS (SELECT row_id, {tok(_x)} AS w FROM cases), n AS (SELECT count(*) n, avg(len(w)) al FROM docs), e AS (SELECT row_id, len(w) l, unnest(w) AS word FROM docs), tf AS (SELECT row_id, word, count(*) tf, any_value(l) l FROM e GROUP BY 1, 2), df AS (SELECT word, count(*) df FROM tf GROUP BY 1),
    qw AS (SELECT row_id, unnest({tok('q')}) AS word FROM cases), s AS (SELECT row_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))) s FROM qw JOIN tf USING (row_id, word) JOIN df USING (word), n GROUP BY 1)
    SELECT row_id, round(coalesce(s, 0.0), 6) AS score FROM cases LEFT JOIN s USING (row_id)"""
ORACLES["co_group_similarity"] = """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings),
p AS (SELECT a.vec_id, count(*) n, avg(1 - list_dot_product(a.u, b.u)) d FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n, round(coalesce(d, 0.0), 6) AS mean_dist FROM u LEFT JOIN p USING (vec_id)"""
ORACLES["co_query_id"] = f"WITH {CASES}, s AS (SELECT q AS search_term, bool_or(relevance IS NOT NULL) a, bool_or(relevance IS NULL) b FROM cases GROUP BY 1) SELECT search_term, row_number() OVER (ORDER BY CASE WHEN a AND b THEN 0 WHEN a THEN 1 ELSE 2 END, search_term) AS query_id FROM s"
ORACLES["co_type_match"] = f"SELECT p_partkey AS product_uid, {common('lower(p_name)', 'lower(p_type)')} AS n FROM part"
ORACLES["co_w2v_avg"] = f"""WITH {CASES}, v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings), x AS (SELECT row_id, unnest(range(1, least(len({tok('q')}), 3) + 1)) AS pos, ({tok('q')}) AS w FROM cases), l AS (SELECT row_id, pos, len(w[pos]) * 7 % 100 AS vid FROM x),
r0 AS (SELECT row_id, unnest({tok('t')}) AS w FROM cases), r AS (SELECT DISTINCT row_id, len(w) * 7 % 100 AS vid FROM r0),
m AS (SELECT l.row_id, l.pos, max(list_cosine_similarity(a.vec, b.vec)) s, min(list_distance(a.vec, b.vec)) d FROM l JOIN v a ON a.vec_id = l.vid JOIN r ON r.row_id = l.row_id JOIN v b ON b.vec_id = r.vid GROUP BY 1, 2)
SELECT row_id, round(avg(s), 6) AS avg_max_sim, round(avg(d), 6) AS avg_min_dist FROM m GROUP BY 1"""
ORACLES["idf_noun_sum"] = f"""WITH {CASES}, {idf('cases', 't', 1, 1)}, a AS (SELECT row_id, unnest(list_filter({tok('t')}, lambda o: list_contains({nouns('d')}, o))) AS term FROM cases), s AS (SELECT row_id, sum(idf) v FROM a JOIN idf USING (term) GROUP BY 1)
SELECT row_id, round(coalesce(v, 0.0) / (len({nouns('t')}) + 1.0), 6) AS v FROM cases LEFT JOIN s USING (row_id)"""
ORACLES["idf_noun_topk"] = f"""WITH {CASES}, {idf('cases', 't', 1, 1)}, a AS (SELECT row_id, d, unnest(list_distinct({nouns('t')})) AS term FROM cases), r AS (SELECT row_id, d, term, row_number() OVER (PARTITION BY row_id ORDER BY coalesce(idf, 0.0) DESC, term) n FROM a LEFT JOIN idf USING (term))
SELECT row_id, count(*) FILTER (contains(r.d, term) AND n <= 3) AS v FROM cases LEFT JOIN r USING (row_id) GROUP BY 1"""

ORACLES["ev_badcase_topk"] = f"""WITH {PREDS}, x AS (SELECT l_orderkey * 10 + l_linenumber AS id, round(p1, 6) - y AS diff FROM preds), h AS (SELECT * FROM x ORDER BY diff DESC, id DESC LIMIT 50), l AS (SELECT * FROM x ORDER BY diff, id LIMIT 50)
SELECT id, 'high' AS side, round(diff, 6) AS diff FROM h UNION ALL SELECT id, 'low', round(diff, 6) FROM l"""
ORACLES["ev_leaderboard"] = f"WITH {PREDS}, t AS (SELECT 'p1' AS trial, p1 AS p, y FROM preds UNION ALL SELECT 'p2', p2, y FROM preds UNION ALL SELECT 'p3', p3, y FROM preds), g AS (SELECT trial, round(sqrt(avg((p - y) * (p - y))), 6) AS loss FROM t GROUP BY 1) SELECT trial, loss, CAST(rank() OVER (ORDER BY loss) AS INTEGER) AS place FROM g"
ORACLES["ev_bucket_relevance"] = "SELECT l_orderkey, l_linenumber, CASE WHEN v > 0.99 AND v < 1.01 THEN 1.0::DOUBLE WHEN v > 1.24 AND v < 1.34 THEN 1.33 WHEN v > 1.49 AND v < 1.76 THEN 1.67 WHEN v > 1.99 AND v < 2.01 THEN 2.0 WHEN v > 2.24 AND v < 2.34 THEN 2.33 WHEN v > 2.49 AND v < 2.76 THEN 2.67 WHEN v > 2.99 AND v < 3.01 THEN 3.0 END AS bucket FROM (SELECT *, round(1 + l_discount * 20, 2) AS v FROM lineitem)"
ORACLES["ev_discretise"] = "SELECT l_orderkey, l_linenumber, coalesce(list_filter([1.0::DOUBLE, 1.33, 1.67, 2.0, 2.33, 2.67, 3.0], lambda g: abs(v - g) < 0.165)[1], v) AS v FROM (SELECT *, round(1 + l_quantity / 25, 2) AS v FROM lineitem)"
ORACLES["ev_clip"] = "SELECT l_orderkey, l_linenumber, round(least(greatest(l_quantity / 15, 1.0), 3.0), 6) AS v FROM lineitem"
ORACLES["ml_folds"] = "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders"
ORACLES["ml_ordinal_vote"] = """WITH p AS (SELECT l_orderkey, l_linenumber, list_transform(range(0, 6), lambda i: least(1.0, l_quantity / (50 - 6 * i))) AS p FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, list_transform(range(0, 7), lambda j: list_sum(list_transform(p, lambda x, i: CASE WHEN j <= i - 1 THEN x / i ELSE (1 - x) / (7 - i) END))) AS s FROM p)
SELECT l_orderkey, l_linenumber, [1.0::DOUBLE, 1.33, 1.67, 2.0, 2.33, 2.67, 3.0][8 - list_position(list_reverse(s), list_max(s))] AS label FROM s"""
ORACLES["ml_three_part_labels"] = "SELECT l_orderkey, l_linenumber, CAST(floor(x / 3) AS BIGINT) AS low, CAST(floor(x / 3) + CASE WHEN x % 3 >= 2 THEN 1 ELSE 0 END AS BIGINT) AS mid, CAST(floor(x / 3) + CASE WHEN x % 3 >= 1 THEN 1 ELSE 0 END AS BIGINT) AS high FROM (SELECT *, floor(3 * (l_quantity / 17) + 0.5) AS x FROM lineitem)"
ORACLES["ml_best_split"] = """WITH l AS (SELECT 'line' AS f, l_linenumber::DOUBLE AS v, l_quantity - 25.5 AS r FROM lineitem UNION ALL SELECT 'l_discount', l_discount, l_quantity - 25.5 FROM lineitem UNION ALL SELECT 'l_tax', l_tax, l_quantity - 25.5 FROM lineitem),
b AS (SELECT DISTINCT f, v FROM l), s AS (SELECT b.f, b.v, sum(r) FILTER (l.v <= b.v) sl, count(*) FILTER (l.v <= b.v) nl, sum(r) st, count(*) nt FROM b JOIN l ON b.f = l.f GROUP BY 1, 2),
g AS (SELECT f, v, sl * sl / (nl + 1) / 2 + (st - sl) * (st - sl) / (nt - nl + 1) / 2 - st * st / (nt + 1) / 2 AS gain FROM s WHERE nl >= 10 AND nt - nl >= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY round(gain, 6) DESC, v) k FROM g) SELECT f AS feature, v AS border, round(gain, 4) AS gain FROM r WHERE k = 1"""
ORACLES["ml_losses"] = """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 - 2.5 AS p, CASE WHEN l_tax > 0.04 THEN 1.0::DOUBLE ELSE -1.0 END AS y FROM lineitem), e AS (SELECT *, exp(-y * p) AS e FROM x)
SELECT l_orderkey, l_linenumber, round((p - y) * (p - y) / 2, 6) AS square_loss, round(p - y, 6) AS square_d1, 1.0::DOUBLE AS square_d2, round(ln(1 + e), 6) AS logistic_loss, round(-y * e / (1 + e), 6) AS logistic_d1, round(e / ((1 + e) * (1 + e)), 6) AS logistic_d2, round(e, 6) AS expo_loss, round(-y * e, 6) AS expo_d1, round(e, 6) AS expo_d2 FROM e"""
ORACLES["ml_leaf_weight_newton"] = "SELECT l_linenumber, round(sum(CASE WHEN l_tax > 0.04 THEN 0.5 ELSE -0.5 END) * 0.5 / (count(*) * 0.25 + 1.0), 6) AS delta FROM lineitem GROUP BY 1"
ORACLES["ens_average"] = f"WITH {PREDS} SELECT l_orderkey, l_linenumber, round((p1 + p2 + p3) / 3, 6) AS pred FROM preds"
ORACLES["ens_gram"] = f"WITH {PREDS} SELECT " + ", ".join(f"round(sum({a} * {b}), 2) AS {a}_{b}" for a, b in (("p1", "p1"), ("p1", "p2"), ("p2", "p2"), ("p2", "p3"), ("p3", "y"), ("p1", "y"))) + " FROM preds"
ORACLES["ens_greedy_step"] = f"WITH {PREDS}, t AS (SELECT 'p1' AS trial, p1 AS p, y FROM preds UNION ALL SELECT 'p2', p2, y FROM preds UNION ALL SELECT 'p3', p3, y FROM preds) SELECT trial, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse FROM t GROUP BY 1 ORDER BY 2, 1 LIMIT 1"
ORACLES["st_history"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2"

# all query words, and the spread of a group's distances
ORACLES["co_w2v_avg_all"] = ORACLES["co_w2v_avg"].replace(f"least(len({tok('q')}), 3)", f"len({tok('q')})")
ORACLES["co_group_spread"] = """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings),
p AS (SELECT a.vec_id, max(1 - list_dot_product(a.u, b.u)) AS hi, min(1 - list_dot_product(a.u, b.u)) AS lo, stddev_samp(1 - list_dot_product(a.u, b.u)) AS sd FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1)
SELECT vec_id, round(coalesce(hi, 0.0), 6) AS max_dist, round(coalesce(lo, 0.0), 6) AS min_dist, round(coalesce(sd, 0.0), 6) AS std_dist FROM u LEFT JOIN p USING (vec_id)"""
