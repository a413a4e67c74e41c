"""File sources and sinks: CSV in any encoding, line files, JSON settings, SQL scripts, text matrices.

All of them read and write through Spark, so paths may be in any store that Spark reaches, and files are split among tasks.
Settings (configs, trials) are small by nature: a file of them is one row.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only where they are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexaline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lexaline/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: what several jobs use, without holding executors' memory."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- CSV

#: Quotes are doubled inside quoted values; an empty value is quoted, a null is \\N or nothing.
_CSV = {"header": True, "quote": '"', "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """Typed rows of CSV files with a header line; values may hold separators, quotes and line ends.

    With a schema no pass over the data is needed for types; a value that doesn't fit its type is null.
    """
    return spark.read.options(**_CSV, emptyValue="").csv(path, schema=schema, encoding=encoding, multiLine=True)


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    df.write.options(**_CSV, emptyValue='""', encoding=encoding).csv(path)


def write_submission(df: DataFrame, path: str, key: str, value: str) -> None:
    """The (id, relevance) file: predictions clipped to the grades from 1 to 3."""
    write_csv(df.select(F.col(key).alias("id"), F.least(F.greatest(F.col(value), F.lit(1.0)), F.lit(3.0)).alias("relevance")), path)


def read_fields(spark: SparkSession, path: str, fields: dict[str, int], n: int | None = None) -> DataFrame:
    """Chosen fields of lines cut at every comma, without regard to quotes; negative places count from the end. ``n``, if
    given, is the number of lines read from the start of the files; lines that lack a field have a null there."""
    lines = spark.read.text(path)
    if n is not None:
        lines = lines.limit(n)
    cut = F.split("value", ",", -1)
    return lines.select(*[F.get(cut, F.lit(at) if at >= 0 else F.size(cut) + at).alias(name) for name, at in fields.items()])


# ---- columns in files of their own


def write_columns(df: DataFrame, root: str, key: str, skip: Iterable[str] = ()) -> None:
    """One Parquet folder ``column=<name>`` for each column but the key and those to skip; values as text, one pass."""
    names = [c for c in df.columns if c != key and c not in set(skip)]
    df.select(key, *[F.col(c).cast("string") for c in names]).unpivot(key, names, "column", "value").write.partitionBy("column").parquet(root)


def stored_columns(spark: SparkSession, root: str) -> list[str]:
    """Names of the columns that :func:`write_columns` left at ``root``, from the folders alone."""
    return sorted(r[0] for r in spark.read.parquet(root).select("column").distinct().collect())


def read_columns(spark: SparkSession, root: str, key: str, names: list[str]) -> DataFrame:
    """(key, names) side by side, rows in no order; missing values are empty texts. Only the named folders are read."""
    stored = spark.read.parquet(root).where(F.col("column").isin(names))
    wide = stored.groupBy(key).pivot("column", names).agg(F.first("value"))
    return wide.select(key, *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])


def weighted_matrix(df: DataFrame, key: str, vector: str, weight: float) -> DataFrame:
    """Rows of a stored matrix, every entry times the weight of its group of features."""
    return df.select(key, F.transform(vector, lambda x: x.cast("double") * weight).alias(vector))


# ---- lines and settings


def read_rewrites(spark: SparkSession, path: str) -> DataFrame:
    """(query_item, title_item, query, title) from lines of four comma-separated values, the last two in quotes; the
    header line, empty lines and those that start with ``#`` are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "") & ~F.col("value").startswith("query_item,"))
    row = F.from_csv("value", "query_item string, title_item string, query string, title string", {"quote": '"', "escape": '"'})
    return lines.select(row.alias("r")).select("r.*")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term, replacement) from JSON files of one object each, however broken into lines, or of one in each line."""
    objects = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n(?=\{)")).alias("value"))
    return objects.select(F.explode(F.from_json("value", "map<string,string>")).alias("term", "replacement"))


#: Pairs of an object of :func:`write_dictionary`, on average.
OBJECT_PAIRS = 10_000


def write_dictionary(df: DataFrame, path: str, key: str, value: str, files: int = 8) -> None:
    """JSON objects of the pairs, one a line, ``files`` of them at least. Equal keys are in different objects, so all pairs are
    read again."""
    pairs = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.coalesce(F.col(value), F.lit("")).alias("v"))
    objects = max(files, pairs.count() // OBJECT_PAIRS)
    again = F.row_number().over(Window.partitionBy("k").orderBy("v"))
    dealt = pairs.withColumn("again", again).groupBy(F.pmod(F.xxhash64("k"), F.lit(objects)).alias("object"), "again")
    dealt.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")).select("value").write.text(path)


TRIAL = "loss double, status string, model string, params map<string,string>, features array<string>"


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Tuning trials from JSON arrays of objects."""
    return spark.read.schema(TRIAL).json(path, multiLine=True)


def write_trials(df: DataFrame, path: str) -> None:
    """All trials as one JSON array, as the tuning log is kept."""
    rows = df.groupBy().agg(F.to_json(F.collect_list(F.struct("loss", "status", "model", "params", "features"))).alias("value"))
    rows.coalesce(1).write.text(path)


def best_trials(trials: DataFrame, models: list[str] | None = None) -> DataFrame:
    """The trial of least loss of each model, of equal ones the least by its features; failed trials don't count."""
    usable = trials.where("status = 'ok' and loss is not null and not isnan(loss)")
    if models is not None:
        usable = usable.where(F.col("model").isin(models))
    return usable.groupBy("model").agg(F.min(F.struct("loss", "features", F.map_entries("params").alias("params"))).alias("best")).select("model", "best.loss", "best.features", F.map_from_entries("best.params").alias("params"))


def read_config(spark: SparkSession, path: str, defaults: dict | None = None) -> dict:
    """Settings of a run: one JSON object over the defaults. Unknown names are kept."""
    text = spark.read.text(path, wholetext=True).first()
    return dict(defaults or {}) | (json.loads(text["value"]) if text else {})


def expand_runs(lines: Iterable[str], include: dict[str, list[str]] | None = None) -> list[dict[str, str]]:
    """Settings of each run of a key=value script.

    ``#`` starts a comment; ``include=<name>`` stands for the lines of that name; a key that starts with ``@`` has a line
    for each value to try, and all of them are combined; of other repeated keys the last counts.
    """
    plain: dict[str, str] = {}
    tried: dict[str, list[str]] = {}

    def read(part: Iterable[str], open_: tuple[str, ...]) -> None:
        for line in part:
            line = line.split("#", 1)[0].strip()
            if not line:
                continue
            key, _, value = (x.strip() for x in line.partition("="))
            if key == "include":
                if value in open_:
                    raise ValueError(f"{value} includes itself")
                read((include or {})[value], (*open_, value))
            elif key.startswith("@"):
                tried.setdefault(key[1:], []).append(value)
            else:
                plain[key] = value

    read(lines, ())
    runs = [plain]
    for key, values in tried.items():
        runs = [run | {key: value} for run in runs for value in values]
    return runs


# ---- SQL scripts


def sql_literal(c: Column, kind: str) -> Column:
    """The value as SQL writes it: texts in double quotes with quotes escaped, null texts empty, null numbers 0."""
    if kind != "string":
        return F.coalesce(c, F.lit(0)).cast("string")
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def insert_statements(df: DataFrame, target: str, key: str) -> DataFrame:
    """(key, statement): an INSERT for each row whose key is a whole number."""
    values = [sql_literal(F.col(f"`{c}`"), kind) for c, kind in df.dtypes]
    body = F.concat(F.lit(f"INSERT INTO {target} ({', '.join(df.columns)}) VALUES ("), F.concat_ws(", ", *values), F.lit(");"))
    return df.where(F.col(key).try_cast("bigint").isNotNull()).select(key, body.alias("statement"))


def update_statements(df: DataFrame, target: str, key: str) -> DataFrame:
    """(key, statement): an UPDATE of all other columns for each row whose key is a whole number."""
    sets = [F.concat(F.lit(f"{c} = "), sql_literal(F.col(f"`{c}`"), kind)) for c, kind in df.dtypes if c != key]
    body = F.concat(F.lit(f"UPDATE {target} SET "), F.concat_ws(", ", *sets), F.lit(f" WHERE {key} = "), F.col(key).try_cast("bigint").cast("string"), F.lit(";"))
    return df.where(F.col(key).try_cast("bigint").isNotNull()).select(key, body.alias("statement"))


def write_script(statements: DataFrame, path: str) -> None:
    """The statements as text files, a statement a line; line ends inside values become ``\\n``."""
    statements.select(F.regexp_replace("statement", "\r?\n", "\\\\n").alias("value")).write.text(path)


# ---- text matrices


def write_matrix(df: DataFrame, path: str, key: str, columns: list[str], sparse: bool) -> None:
    """Lines of numbers, the row's key in front: all of them, or ``index:value`` of those that aren't 0."""
    if sparse:
        cells = F.array_compact(F.array(*[F.when(F.col(c) != 0, F.concat(F.lit(f"{i}:"), F.col(c).cast("double").cast("string"))) for i, c in enumerate(columns)]))
    else:
        cells = F.array(*[F.coalesce(F.col(c), F.lit(0)).cast("double").cast("string") for c in columns])
    df.select(F.concat_ws(" ", F.concat(F.lit("#"), F.col(key).cast("string")), cells).alias("value")).write.text(path)


def read_matrix(spark: SparkSession, path: str, sparse: bool) -> DataFrame:
    """(key, idx, val), one row for each entry that isn't 0; places count from 0, an index without a value has 1.

    Lines start with ``#`` and the row's key: files that are split among tasks have no line numbers. An index that
    occurs twice in a line is an error, as is a value that isn't a number.
    """
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "")
    lines = spark.read.text(path).where(F.trim("value") != "").select(words.alias("w"))
    cells = F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0)))
    if sparse:
        parsed = F.transform(cells, lambda c: F.struct(F.substring_index(c, ":", 1).cast("int").alias("idx"), F.when(F.contains(c, F.lit(":")), F.substring_index(c, ":", -1)).otherwise(F.lit("1")).cast("double").alias("val")))
    else:
        parsed = F.transform(cells, lambda c, i: F.struct(i.alias("idx"), c.cast("double").alias("val")))
    rows = lines.select(F.substring(F.get("w", F.lit(0)), 2, 20).cast("bigint").alias("key"), parsed.alias("cells"))
    distinct = F.size(F.array_distinct(F.transform("cells", lambda c: c["idx"]))) == F.size("cells")
    sound = F.when(distinct, F.col("cells")).otherwise(F.raise_error(F.lit("an index occurs twice in a line")))
    return rows.select("key", F.explode(sound).alias("c")).where("c.val <> 0").select("key", "c.idx", "c.val")
