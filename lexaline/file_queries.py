"""Queries of the file sources and sinks: whole tables written, read back by the operator, and compared by SQL on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaline.operators import relational as R
from lexaline.queries import Query, r6
from lexaline.sources import files as P
from lexaline.sources import tables as S

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("src_csv_latin1", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def src_csv_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = P.scratch(spark, "latin1")
    part = S.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    P.write_csv(part, path, "ISO-8859-1")
    return P.read_csv(spark, path, "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double", "ISO-8859-1")


@query("src_csv_utf8", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def src_csv_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = P.scratch(spark, "utf8")
    P.write_csv(S.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path)
    return P.read_csv(spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@query("src_submission", "SELECT l_orderkey * 10 + l_linenumber AS id, least(greatest(round(l_quantity / 15, 6), 1.0), 3.0) AS relevance FROM lineitem")
def src_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = P.scratch(spark, "submission")
    pred = S.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.round(F.col("l_quantity") / 15, 6).alias("pred"))
    P.write_submission(pred, path, "key", "pred")
    return P.read_csv(spark, path, "id bigint, relevance double")


@query("src_fields", "SELECT p_name AS second, CAST(p_size AS VARCHAR) AS before_last, p_type AS last FROM part")
def src_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the catalogue cut at every comma; the names have none."""
    path = P.scratch(spark, "fields")
    part = S.table(spark, sf_dir, "part")
    part.select(F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", "p_brand", F.col("p_size").cast("string"), "p_type").alias("value")).write.text(path)
    return P.read_fields(spark, path, {"second": 1, "before_last": -2, "last": -1})


@query("src_column_files", "SELECT p_partkey, coalesce(p_name, '') AS p_name, coalesce(p_type, '') AS p_type FROM part")
def src_column_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = P.scratch(spark, "columns")
    P.write_columns(S.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), path, "p_partkey", skip=["p_size"])
    return P.read_columns(spark, path, "p_partkey", ["p_name", "p_type"])


@query("src_column_names", "SELECT unnest(['p_brand', 'p_name', 'p_type']) AS name")
def src_column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = P.scratch(spark, "names")
    P.write_columns(S.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), path, "p_partkey", skip=["p_size"])
    return spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in P.stored_columns(spark, path)])).alias("name"))


@query("src_weighted_matrix", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 0.5)), 6) AS total, round(embedding[1]::DOUBLE * 0.5, 6) AS first FROM embeddings")
def src_weighted_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = P.scratch(spark, "matrix")
    S.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").write.parquet(path)
    made = P.weighted_matrix(spark.read.parquet(path), "vec_id", "embedding", 0.5)
    return made.select("vec_id", r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("total"), r6(F.get("embedding", F.lit(0))).alias("first"))


@query("src_rewrites", "SELECT CAST(item_id AS VARCHAR) AS query_item, regexp_replace(lower(substr(text, 1, 9)), '\\s', ' ', 'g') AS title_item, regexp_replace(substr(text, 1, 20), '\\s', ' ', 'g') AS query, regexp_replace(substr(text, 5, 30), '\\s', ' ', 'g') AS title FROM benchmark WHERE item_id % 3 <> 0")
def src_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrite rules with a header and comments; every third line is commented out in the file."""
    path = P.scratch(spark, "rewrites")

    def quoted(c):
        return F.concat(F.lit('"'), F.replace(F.regexp_replace(c, r"\s", " "), F.lit('"'), F.lit('""')), F.lit('"'))

    line = F.concat_ws(",", F.col("item_id").cast("string"), quoted(F.lower(F.substring("text", 1, 9))), quoted(F.substring("text", 1, 20)), quoted(F.substring("text", 5, 30)))
    lines = S.table(spark, sf_dir, "benchmark").select(F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))
    head = spark.range(1).select(F.lit("query_item,title_item,query,title").alias("value"))
    head.unionByName(lines).unionByName(spark.range(2).select(F.lit(" ").alias("value"))).write.text(path)
    return P.read_rewrites(spark, path)


@query("src_dictionary", "SELECT url AS term, coalesce(substr(html, 1, 40), '') AS replacement FROM pages")
def src_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = P.scratch(spark, "dictionary")
    P.write_dictionary(S.table(spark, sf_dir, "pages").select("url", F.substring("html", 1, 40).alias("start")), path, "url", "start")
    return P.read_dictionary(spark, path)


_TRIALS = "SELECT l_returnflag AS model, l_linestatus || l_linenumber AS feature, round(avg(l_quantity), 6) AS loss FROM lineitem GROUP BY ALL"


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    feature = F.concat(F.col("l_linestatus"), F.col("l_linenumber").cast("string"))
    made = S.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model"), feature.alias("feature")).agg(r6(F.avg("l_quantity")).alias("loss"))
    return made.select("loss", F.lit("ok").alias("status"), "model", F.create_map(F.lit("depth"), F.length("feature").cast("string")).alias("params"), F.array("feature").alias("features"))


@query("src_trials", f"SELECT model, feature, loss, '2' AS depth FROM ({_TRIALS})")
def src_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = P.scratch(spark, "trials")
    P.write_trials(_trials(spark, sf_dir), path)
    return P.read_trials(spark, path).select("model", F.get("features", F.lit(0)).alias("feature"), "loss", F.col("params")["depth"].alias("depth"))


@query("ev_best_trial", f"WITH t AS ({_TRIALS}) SELECT model, loss, feature FROM t QUALIFY row_number() OVER (PARTITION BY model ORDER BY loss, feature) = 1")
def ev_best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.best_trials(_trials(spark, sf_dir)).select("model", "loss", F.get("features", F.lit(0)).alias("feature"))


_SQL_TEXT = """'"' || replace({}, '"', '\\"') || '"'"""


@query("src_sql_insert", f"SELECT p_partkey AS id, 'INSERT INTO product (id, name, size) VALUES (' || p_partkey || ', ' || {_SQL_TEXT.format('p_name')} || ', ' || p_size || ');' AS statement FROM part")
def src_sql_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return P.insert_statements(part, "product", "id")


@query("src_sql_update", f"SELECT 'UPDATE product SET name = ' || {_SQL_TEXT.format('p_name')} || ', size = ' || p_size || ' WHERE id = ' || p_partkey || ';' AS statement FROM part")
def src_sql_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPDATE statements written as a script and read again."""
    path = P.scratch(spark, "script")
    part = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    P.write_script(P.update_statements(part, "product", "id"), path)
    return spark.read.text(path).select(F.col("value").alias("statement"))


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_MATRIX = " UNION ALL ".join(f"SELECT l_orderkey * 10 + l_linenumber AS key, {i} AS idx, {c}::DOUBLE AS val FROM lineitem WHERE {c} <> 0" for i, c in enumerate(_MEASURES))


def _matrix(sparse: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = P.scratch(spark, "matrix")
        rows = S.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), *_MEASURES)
        P.write_matrix(rows, path, "key", list(_MEASURES), sparse)
        return P.read_matrix(spark, path, sparse)

    return run


for _name, _sparse in (("src_matrix_sparse", True), ("src_matrix_dense", False)):
    query(_name, _MATRIX)(_matrix(_sparse))


@query("src_config", "SELECT unnest(['eta', 'loss', 'reg', 'reg']) AS name, unnest(['0.5', 'LS', '0.1', '1']) AS value, unnest([0, 0, 1, 0]) AS run UNION ALL SELECT 'eta', '0.5', 1 UNION ALL SELECT 'loss', 'LS', 1")
def src_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a script with comments, an included part and a parameter that is swept."""
    runs = P.expand_runs(["# settings", "include=base", "@reg=1", "@reg=0.1 # both"], {"base": ["loss=Log", "eta=0.5", "", "loss=LS"]})
    rows = [(k, v, i) for i, run in enumerate(runs) for k, v in run.items()]
    return spark.createDataFrame(rows, "name string, value string, run int")


@query("src_set_exchange", "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_discount > 0.05 INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount <= 0.05")
def src_set_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of ids stored by one run and read by another: those that are in both."""
    line = S.table(spark, sf_dir, "lineitem")
    paths = [P.scratch(spark, f"set-{name}") for name in ("train", "test")]
    for path, part in zip(paths, (line.where("l_discount > 0.05"), line.where("l_discount <= 0.05"))):
        part.select(F.col("l_partkey").alias("id")).distinct().write.parquet(path)
    first, second = (spark.read.parquet(p) for p in paths)
    return first.join(second, "id", "left_semi")


_TERM = "lower(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> '')[1:4], ' '))"


@query("tx_dictionary", f"SELECT item_id AS qid, CASE WHEN q IN (SELECT {_TERM} FROM benchmark WHERE item_id % 2 = 0) THEN 'fixed ' || q ELSE q END AS q FROM (SELECT item_id, {_TERM} AS q FROM benchmark)")
def tx_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole queries corrected through a JSON dictionary, which has those of every second item."""
    path = P.scratch(spark, "dictionary")
    terms = S.search_terms(spark, sf_dir).select("qid", F.lower("search_term").alias("q"))
    P.write_dictionary(terms.where("qid % 2 = 0").select("q", F.concat(F.lit("fixed "), F.col("q")).alias("new")).distinct(), path, "q", "new")
    return R.corrected(terms, "q", P.read_dictionary(spark, path))


@query("tx_rewrites", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN w = string_split(p_name, ' ')[1] THEN 'new' ELSE w END), ' ') ELSE p_name END AS q FROM part")
def tx_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of every third name, where the title is that of the rule."""
    rows = S.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("q"), F.col("p_partkey").cast("string").alias("t"))
    rules = rows.where("p_partkey % 3 = 0").select(F.get(F.split("q", " "), F.lit(0)).alias("query_item"), F.lit("new").alias("title_item"), F.col("q").alias("query"), F.col("t").alias("title"))
    return R.rewritten(rows, "q", "t", rules).select("p_partkey", "q")
