"""Queries of the vector and matrix functions over the embeddings and the numbers of the line items, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaline.functions import vectors as V
from lexaline.operators import matrices as X
from lexaline.queries import Query, r6
from lexaline.sources import tables as S

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, d, v): the embeddings as dense vectors, and as sparse ones of the entries of 0.05 and more."""
    e = S.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("d"))
    return e.withColumn("v", V.sparse(F.transform("d", lambda x: F.when(x >= 0.05, x).otherwise(F.lit(0.0)))))


#: The same in SQL: e(vec_id, label, d) and c(vec_id, idx, val).
_E = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: round(x::DOUBLE, 4)) AS d FROM embeddings),
c AS (SELECT vec_id, idx, val FROM (SELECT vec_id, unnest(range(0, len(d))) AS idx, unnest(d) AS val FROM e) WHERE val >= 0.05)"""


def _summary(cells: Column) -> list[Column]:
    """Digest of a sparse vector: number of entries, their sum, and their sum weighted by place."""
    total = F.aggregate(cells, F.lit(0.0), lambda a, c: a + c["val"])
    placed = F.aggregate(cells, F.lit(0.0), lambda a, c: a + c["val"] * (c["idx"] + 1))
    return [F.size(cells).cast("long").alias("n"), F.round(total, 5).alias("total"), F.round(placed, 4).alias("placed")]


_SUM = "count(val) AS n, round(coalesce(sum(val), 0.0), 5) AS total, round(coalesce(sum(val * (idx + 1)), 0.0), 4) AS placed"


def sparse_query(name: str, build, cells: str) -> None:
    """A query of one sparse function; ``cells`` is SQL for (vec_id, idx, val) of its result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _vectors(spark, sf_dir).select("vec_id", build(F.col("v")).alias("r")).select("vec_id", *_summary(F.col("r")))

    query(name, f"WITH {_E}, x AS ({cells}) SELECT e.vec_id, {_SUM} FROM e LEFT JOIN x USING (vec_id) GROUP BY 1")(run)


sparse_query("mx_sparse", lambda v: v, "SELECT * FROM c")
sparse_query("mx_scale", lambda v: V.scale(v, 3.0), "SELECT vec_id, idx, val * 3 AS val FROM c")
sparse_query("mx_normal_l2", V.normalized, "SELECT vec_id, idx, val / sqrt(sum(val * val) OVER (PARTITION BY vec_id)) AS val FROM c")
sparse_query("mx_normal_l1", lambda v: V.normalized(v, 1), "SELECT vec_id, idx, val / sum(abs(val)) OVER (PARTITION BY vec_id) AS val FROM c")
sparse_query("mx_cap", lambda v: V.capped(v, 0.1), "SELECT vec_id, idx, least(val, 0.1) AS val FROM c")
sparse_query("mx_cut", lambda v: V.cut_below(v, 0.12), "SELECT * FROM c WHERE val >= 0.12")
sparse_query("mx_top", lambda v: V.top(v, 5), "SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY val DESC, idx) <= 5")
sparse_query("mx_binary", V.binary, "SELECT vec_id, idx, 1.0::DOUBLE AS val FROM c")
sparse_query("mx_log", V.log1p, "SELECT vec_id, idx, ln(1 + val) AS val FROM c")
sparse_query("mx_columns", lambda v: V.subset(v, [7, 3, 60]), "SELECT vec_id, list_position([7, 3, 60], idx) - 1 AS idx, val FROM c WHERE idx IN (7, 3, 60)")
sparse_query("mx_beside", lambda v: V.beside(v, V.scale(v, 2.0), 64), "SELECT * FROM c UNION ALL SELECT vec_id, idx + 64, val * 2 FROM c")


@query("mx_signs", f"WITH {_E}, x AS (SELECT vec_id, unnest(range(0, len(d))) AS idx, sign(unnest(d))::DOUBLE AS val FROM e) SELECT vec_id, {_SUM} FROM (SELECT * FROM x WHERE val <> 0) GROUP BY 1")
def mx_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", V.signs(V.sparse(F.col("d"))).alias("r")).select("vec_id", *_summary(F.col("r"))).where("n > 0")


@query("mx_extremes", f"WITH {_E} SELECT e.vec_id, arg_max(idx, (val, -idx)) AS most_at, max(val) AS most, arg_min(idx, (val, idx)) AS least_at, min(val) AS least, round(count(val) / 64, 6) AS filled FROM e LEFT JOIN c USING (vec_id) GROUP BY 1")
def mx_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    most, least = V.greatest(F.col("v")), V.least(F.col("v"))
    return _vectors(spark, sf_dir).select("vec_id", most["idx"].alias("most_at"), most["val"].alias("most"), least["idx"].alias("least_at"), least["val"].alias("least"), r6(F.size("v") / 64).alias("filled"))


@query("mx_transpose", f"WITH {_E} SELECT idx AS key, {_SUM.replace('(idx + 1)', '(vec_id + 1)')} FROM c GROUP BY 1")
def mx_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = X.transposed(X.long_form(_vectors(spark, sf_dir), "vec_id", "v"))
    return columns.groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum("val"), 5).alias("total"), F.round(F.sum(F.col("val") * (F.col("idx") + 1)), 4).alias("placed"))


@query("mx_product", f"WITH {_E} SELECT a.idx AS i, b.idx AS j, round(sum(a.val * b.val), 10) AS val FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2")
def mx_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Gram matrix of the columns: the transposed matrix times the matrix."""
    entries = X.long_form(_vectors(spark, sf_dir), "vec_id", "v")
    return X.product(X.transposed(entries), entries.select(F.col("key"), F.col("idx"), "val")).select(F.col("key").cast("int").alias("i"), F.col("idx").alias("j"), F.round("val", 10).alias("val"))


@query("mx_sums", f"WITH {_E} SELECT 'column' AS side, idx AS at, count(*) AS n, round(sum(val), 5) AS total FROM c GROUP BY 2 UNION ALL SELECT 'row', vec_id, count(*), round(sum(val), 5) FROM c GROUP BY 2")
def mx_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = X.long_form(_vectors(spark, sf_dir), "vec_id", "v")
    sides = [made.select(F.lit(side).alias("side"), F.col(at).cast("long").alias("at"), "n", F.round("total", 5).alias("total")) for side, at, made in (("column", "idx", X.column_sums(entries)), ("row", "key", X.row_sums(entries)))]
    return sides[0].unionByName(sides[1])


@query("mx_rows", f"WITH {_E}, x AS (SELECT vec_id, idx, val FROM c UNION ALL SELECT vec_id + 1000000, idx, val FROM c WHERE vec_id % 7 = 1) SELECT vec_id AS key, {_SUM} FROM x GROUP BY 1")
def mx_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every seventh vector under all rows, and back to one row for each vector."""
    entries = X.long_form(_vectors(spark, sf_dir), "vec_id", "v")
    wanted = S.table(spark, sf_dir, "embeddings").where("vec_id % 7 = 1").select(F.col("vec_id").alias("key"))
    both = X.under_each_other(entries, X.only(entries, wanted, "key"), 1_000_000)
    return X.rows_of(both).select("key", *_summary(F.col("v")))


@query("mx_excluded", f"WITH {_E} SELECT vec_id AS key, idx, val FROM c WHERE vec_id % 7 <> 1")
def mx_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = S.table(spark, sf_dir, "embeddings").where("vec_id % 7 = 1").select(F.col("vec_id").alias("key"))
    return X.only(X.long_form(_vectors(spark, sf_dir), "vec_id", "v"), wanted, "key", inside=False).select("key", "idx", "val")


@query("mx_equal", f"WITH {_E}, r AS (SELECT vec_id, list(val ORDER BY idx) AS v, list(idx ORDER BY idx) AS i FROM c GROUP BY 1) SELECT e.vec_id, coalesce(list_transform(v, lambda x: x * 2) = list_transform(v, lambda x: x + x), true) AS same, coalesce(len(v), 0) = 0 AS empty FROM e LEFT JOIN r USING (vec_id)")
def mx_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", (V.scale(F.col("v"), 2.0) == V.scale(V.scale(F.col("v"), 4.0), 0.5)).alias("same"), (F.size("v") == 0).alias("empty"))


@query(
    "mx_dense",
    f"""WITH {_E}, s AS (SELECT vec_id, d, list_reverse(d) AS b FROM e) SELECT vec_id, round(list_sum(list_transform(list_zip(d, b), lambda z: z[1] + z[2] * 0.5)), 5) AS added, round(list_dot_product(d, b), 10) AS inner_product, round(list_dot_product(d, d), 10) AS self_product,
round(sqrt(list_dot_product(d, d)), 6) AS length, round(list_sum(list_transform(d, lambda x: abs(x))), 5) AS abs_sum, list_max(list_transform(d, lambda x: abs(x))) AS abs_max, round(list_avg(d), 10) AS mean, round(list_stddev_pop(d), 6) AS deviation, round(list_sum(list_transform(d, lambda x: x * x * 3)), 10) AS squares FROM s""",
)
def mx_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = F.col("d"), F.reverse("d")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    mean, deviation = V.mean_and_deviation(d)
    return _vectors(spark, sf_dir).select(
        "vec_id",
        F.round(total(V.add(d, b, 0.5)), 5).alias("added"),
        F.round(V.inner(d, b), 10).alias("inner_product"),
        F.round(V.inner(d, d), 10).alias("self_product"),
        r6(F.sqrt(V.inner(d, d))).alias("length"),
        F.round(V.abs_sum(d), 5).alias("abs_sum"),
        V.abs_max(d).alias("abs_max"),
        F.round(mean, 10).alias("mean"),
        r6(deviation).alias("deviation"),
        F.round(total(V.times(V.squares(d), 3.0)), 10).alias("squares"),
    )


@query("mx_merge", "SELECT p_partkey, p_size AS a_p_size, p_retailprice AS b_p_retailprice FROM part")
def mx_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.table(spark, sf_dir, "part")
    return X.merged({"a": part.select("p_partkey", "p_size"), "b": part.select("p_partkey", "p_retailprice")}, "p_partkey")


@query("mx_one_against_rest", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END AS is_A, CASE WHEN l_returnflag = 'N' THEN 1 ELSE -1 END AS is_N FROM lineitem")
def mx_one_against_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *X.one_against_rest(F.col("l_returnflag"), ["A", "N"]))


@query("mx_distribution", "SELECT l_returnflag, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY 1")
def mx_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.distribution(S.table(spark, sf_dir, "lineitem"), "l_returnflag").select("l_returnflag", "n", r6(F.col("share")).alias("share"))


@query("mx_shuffle", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS places, sum(o_orderkey) AS total FROM orders")
def mx_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffle loses and repeats no row."""
    made = X.shuffled(S.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)
    return made.agg(F.count("*").alias("n"), F.count_distinct("place").alias("places"), F.sum("o_orderkey").alias("total"))


@query("mx_sample", "SELECT true AS close_to_a_tenth, true AS same_again FROM (SELECT 1)")
def mx_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders").select("o_orderkey")
    first, again = (X.sampled(df, "o_orderkey", 0.1, 3).agg(F.count("*").alias(n), F.sum("o_orderkey").alias(f"{n}_sum")) for n, df in (("a", orders), ("b", orders.repartition(7))))
    total = orders.agg(F.count("*").alias("n"))
    both = first.crossJoin(again).crossJoin(total)  # three rows of one
    return both.select((F.abs(F.col("a") / F.col("n") - 0.1) < 0.03).alias("close_to_a_tenth"), ((F.col("a") == F.col("b")) & (F.col("a_sum") == F.col("b_sum"))).alias("same_again"))
