"""Relational steps of building search cases and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaline.functions.text import ngrams, word_tokens
from lexaline.sources.files import scratch

#: Buckets of relevance with least and greatest value, both excluded, and the value that names the bucket.
BUCKETS = ((0.99, 1.01, 1.0), (1.24, 1.34, 1.33), (1.49, 1.76, 1.67), (1.99, 2.01, 2.0), (2.24, 2.34, 2.33), (2.49, 2.76, 2.67), (2.99, 3.01, 3.0))
GRID = (1.0, 1.33, 1.67, 2.0, 2.33, 2.67, 3.0)


def relevance_bucket(value: Column) -> Column:
    """Name of the bucket that a relevance lies in; null outside all of them."""
    out = F.lit(None).cast("double")
    for low, high, name in reversed(BUCKETS):
        out = F.when((value > low) & (value < high), name).otherwise(out)
    return out


def snap(value: Column, within: float = 0.165) -> Column:
    """The grid point within reach of the value, else the value."""
    out = value
    for point in reversed(GRID):
        out = F.when(F.abs(value - point) < within, point).otherwise(out)
    return out


def clip(value: Column, low: float = 1.0, high: float = 3.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def attribute(attributes: DataFrame, name: str, alias: str) -> DataFrame:
    """One value of a named attribute for each product: the least, where there are several."""
    return attributes.where(F.col("name") == name).groupBy("product_uid").agg(F.min("value").alias(alias))


def fill_brand(cases: DataFrame, brands: DataFrame, id_col: str = "product_uid", title_col: str = "title", brand_col: str = "brand") -> DataFrame:
    """``cases`` with missing brands taken from the title: its longest run of one to three words that is a brand, the last
    such run where several are as long. Compared without case, by a join on the runs, not in a loop over brands."""
    known = brands.select(F.lower("brand").alias("gram")).where("gram is not null").distinct()
    missing = cases.where(F.col(brand_col).isNull()).select(id_col, word_tokens(F.col(title_col)).alias("w"))

    def placed(n: int) -> Column:
        return F.transform(ngrams(F.col("w"), n), lambda g, i: F.struct(F.lit(n).alias("n"), i.alias("at"), g.alias("gram")))

    grams = missing.select(id_col, F.explode(F.concat(*[placed(n) for n in (1, 2, 3)])).alias("g")).select(id_col, "g.*")
    found = grams.join(known, "gram").groupBy(id_col).agg(F.max_by("gram", F.struct("n", "at")).alias("_found"))
    return cases.join(found, id_col, "left").withColumn(brand_col, F.coalesce(brand_col, "_found")).drop("_found")


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_nth = 1").drop("_nth")


def strings_of(df: DataFrame, key: str, order: str, value: str, sep: str = " ") -> DataFrame:
    """(key, value): the strings of each key in row order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[value]), sep).alias(value))


def head_and_tail(train: DataFrame, test: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows of ``train`` and the last n of ``test``, missing columns null."""
    return train.orderBy(order).limit(n).unionByName(test.orderBy(F.desc(order)).limit(n), allowMissingColumns=True)


def leave_one_out(df: DataFrame, key: str, value: str, known: Column, least: int = 3) -> DataFrame:
    """History of a key: mean of its known values, the row's own left out, if ``least`` others have one, else the mean
    of all; the number of values; and sqrt(count + 1) times the mean.

    Sums of a key are made before the shuffle and joined back, so a key of very many rows is no single task's work.
    """
    own = F.when(known, F.col(value))
    sums = df.groupBy(F.col(key).alias("_key")).agg(F.sum(own).alias("_all"), F.count(own).alias("_count"))
    overall = df.agg((F.sum(own) / F.count(own)).alias("_overall"))
    rows = df.join(sums, F.col(key).eqNullSafe(F.col("_key")), "left").crossJoin(F.broadcast(overall))
    n = F.col("_count") - F.when(own.isNotNull(), 1).otherwise(0)
    total = F.coalesce(F.col("_all"), F.lit(0.0)) - F.coalesce(own, F.lit(0.0))
    enough = n >= least
    made = rows.withColumn(f"{key}_hist_rel", F.when(enough, total / F.nullif(n, F.lit(0))).otherwise(F.col("_overall"))).withColumn(f"{key}_hist_count", F.when(enough, n).otherwise(0))
    return made.withColumn(f"{key}_hist_cmb", F.sqrt(F.col(f"{key}_hist_count") + 1) * F.col(f"{key}_hist_rel")).drop("_key", "_all", "_count", "_overall")


def in_order(df: DataFrame, order: list[str], name: str = "ordered") -> DataFrame:
    """``df`` with ``part`` and ``at``: rows of a lesser part come before those of a greater one, and by ``at`` within it.

    Range partitions are written once, so that every later look at them finds the same parts.
    """
    path = scratch(df.sparkSession, name)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    low = F.monotonically_increasing_id()
    ranged.select("*", F.shiftright(low, 33).alias("part"), low.bitwiseAND((1 << 33) - 1).alias("at")).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def before_parts(parts: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """(by, part, sums): of the rows of all lesser parts, for each part; as many rows as there are parts and groups."""
    each = parts.groupBy(*by, "part").agg(*[c.alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*by, "part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])


def with_description(rows: DataFrame, descriptions: DataFrame, key: str) -> DataFrame:
    """``rows`` with the other columns of ``descriptions``, null where it has no row for the key."""
    return rows.join(descriptions, key, "left")


def side_by_side(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """The rows of both tables by their place in the order of a column of each; places that one lacks are left out."""
    numbered = []
    for df, order in ((a, order_a), (b, order_b)):
        ordered = in_order(df, [order], "side")
        placed = ordered.join(F.broadcast(before_parts(ordered, [], {"_before": F.count("*")})), "part")
        numbered.append(placed.withColumn("_place", F.col("_before") + F.col("at")).drop("part", "at", "_before"))
    return numbered[0].join(numbered[1], "_place").drop("_place")


def corrected(rows: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """``rows`` with whole texts of ``column`` replaced as ``dictionary(term, replacement)`` says; of several replacements of a
    term the least counts. Texts without an entry, and nulls, stay."""
    known = dictionary.where("term is not null and replacement is not null").groupBy(F.col("term").alias("_term")).agg(F.min("replacement").alias("_new"))
    joined = rows.join(known, F.col(column) == F.col("_term"), "left")
    return joined.withColumn(column, F.coalesce("_new", column)).select(rows.columns)


def rewritten(rows: DataFrame, query: str, title: str, rewrites: DataFrame) -> DataFrame:
    """``rows`` with words of queries replaced for their title: ``rewrites(query_item, title_item, query, title)`` gives, for a
    pair of query and title, a word and what stands for it. Of several rules for a word the least counts."""
    rules = F.array_sort(F.collect_list(F.struct("query_item", "title_item")))
    known = rewrites.dropna().groupBy(F.col("query").alias("_q"), F.col("title").alias("_t")).agg(rules.alias("_rules"))
    joined = rows.join(known, (F.col(query) == F.col("_q")) & (F.col(title) == F.col("_t")), "left")
    words = F.transform(F.split(query, " ", -1), lambda w: F.coalesce(F.get(F.filter("_rules", lambda r: r["query_item"] == w), F.lit(0))["title_item"], w))
    return joined.withColumn(query, F.when(F.col("_rules").isNull(), F.col(query)).otherwise(F.array_join(words, " "))).select(rows.columns)


def query_classes(df: DataFrame, query: str, relevance: str) -> DataFrame:
    """(query, n1, n2, n3, is_general, is_nonsense) from the whole-number relevances of each query."""
    counts = [F.count_if(F.floor(relevance) == k).alias(f"n{k}") for k in (1, 2, 3)]
    rows = df.where(F.col(relevance).isNotNull()).groupBy(query).agg(*counts)
    return rows.withColumn("is_general", F.expr("n1 = 0 and n3 = 0 and n2 > 4")).withColumn("is_nonsense", F.expr("n1 > 3 and n2 = 0 and n3 = 0"))


def min_max_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 over all rows; 0 where a column is constant."""
    ends = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    out = df.crossJoin(F.broadcast(ends))
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_min_{c}"), F.col(f"_max_{c}") - F.col(f"_min_{c}")), F.lit(0.0)) for c in columns}
    return out.withColumns(scaled).select(df.columns)


def bad_cases(df: DataFrame, pred: str, truth: str, order: str, n: int) -> DataFrame:
    """The n rows predicted most too high and the n most too low, with their difference: a top-k report."""
    diff = df.withColumn("diff", F.col(pred) - F.col(truth))
    high = diff.orderBy(F.desc("diff"), F.desc(order)).limit(n).withColumn("side", F.lit("high"))
    low = diff.orderBy("diff", order).limit(n).withColumn("side", F.lit("low"))
    return high.unionByName(low)


def query_ids(df: DataFrame, query: str, split: str) -> DataFrame:
    """(query, query_id): queries of both splits first, then those of train only, then of test only; by text within each."""
    seen = df.groupBy(query).agg(F.max(F.col(split) == "train").alias("a"), F.max(F.col(split) == "test").alias("b"))
    kind = F.when(F.col("a") & F.col("b"), 0).when(F.col("a"), 1).otherwise(2)
    ordered = in_order(seen.select(query, kind.alias("kind")), ["kind", query])
    before = before_parts(ordered, [], {"before": F.count("*")})
    return ordered.join(F.broadcast(before), "part").select(query, (F.col("before") + F.col("at") + 1).cast("long").alias("query_id"))


def sql_statements(df: DataFrame, target: str, columns: list[str], key: str) -> DataFrame:
    """One INSERT statement for each row with a whole-number key; quotes escaped, null numbers 0."""
    parts = []
    for name, kind in df.select(*columns).dtypes:
        c = F.col(name)
        parts.append(F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"')) if kind == "string" else F.coalesce(c, F.lit(0)).cast("string"))
    body = F.concat(F.lit(f"INSERT INTO {target} ({', '.join(columns)}) VALUES ("), F.concat_ws(", ", *parts), F.lit(");"))
    return df.where(F.col(key).try_cast("bigint").isNotNull()).select(key, body.alias("statement"))
