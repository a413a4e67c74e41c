"""Secret scan over an incremental blob ledger, in DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its content. The ledger holds one row for each pair of blob and
rule version that has been scanned, with the spans found. A run looks only at pairs that the ledger lacks: each unseen
blob once, however many paths hold it, and known blobs only for rules that are new. Findings are joined back to all
paths by content address.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaline.llm.expressions import matches
from lexaline.llm.storage import materialize

SPANS = "array<struct<start:int,stop:int,kind:int>>"


@dataclass(frozen=True)
class SecretRule:
    """A kind of secret. One of ``keywords`` (lower case) must occur before ``regex`` is tried; ``group``, if given, needs
    ``least`` characters, else the match does. A new ``version`` makes all blobs unseen for the rule."""

    kind: str
    regex: str
    keywords: tuple[str, ...] = ()
    group: int | None = None
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns of the base kinds; runs that are too short can't match later either, so lengths stand in the patterns.
BASE = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("passw", "secret", "token", "apikey", "api_key"), group=2, least=8),
    SecretRule("access", r"AKIA[A-Z0-9]{12,}", ("akia",)),
    SecretRule("hex", r"[0-9a-f]{32,}"),
)
WIDER = (
    SecretRule("private-key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", ("private key",)),
    SecretRule("github", r"(?<![A-Za-z0-9_])gh[opsur]_[A-Za-z0-9]{36,255}", ("ghp_", "gho_", "ghs_", "ghu_", "ghr_")),
    SecretRule("slack", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,255}", ("xox",)),
    SecretRule("google", r"AIza[0-9A-Za-z_-]{35}", ("aiza",)),
    SecretRule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,8192}\.[A-Za-z0-9_-]{8,8192}\.[A-Za-z0-9_-]{8,8192}", ("eyj",)),
    SecretRule("bearer", r"(?i:authorization:\x20*bearer\x20+)[A-Za-z0-9._~+/-]{16,4096}=*", ("bearer",)),
    SecretRule("url", r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@", ("://",)),
)
RULES = BASE + WIDER


def _spans(text: Column, low: Column, pending: Column, number: int, rule: SecretRule) -> Column:
    found = F.filter(matches(text, F.lit(rule.regex), rule.group), lambda m: m["size"] >= rule.least)
    found = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), F.lit(number).alias("kind")))
    wanted = F.array_contains(pending, rule.key)
    if rule.keywords:
        held = F.lit(False)
        for word in rule.keywords:
            held = held | F.contains(low, F.lit(word))
        wanted = wanted & held
    return F.when(wanted, found).otherwise(F.array().cast(SPANS))


def scan_blobs(blobs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, rule, spans) of ``blobs(blob, text, pending)``: for each blob the rules that are pending."""
    low = blobs.withColumn("low", F.lower("text"))
    every = F.array(*[F.struct(F.lit(r.key).alias("rule"), _spans(F.col("text"), F.col("low"), F.col("pending"), i, r).alias("spans")) for i, r in enumerate(rules)])
    rows = low.select("blob", F.filter(every, lambda x: F.array_contains(F.col("pending"), x["rule"])).alias("rows"))
    return rows.select("blob", F.explode("rows").alias("r")).select("blob", "r.rule", "r.spans")


LEDGER = f"blob string, rule string, spans {SPANS}"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(F.lit("").alias("blob"), F.lit("").alias("rule"), F.array().cast(SPANS).alias("spans"))


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger stored at ``path``; where there is none yet, an empty one is stored."""
    empty_ledger(spark).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def _addressed(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return versions.select(F.col(path_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def scan_unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[SecretRule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Ledger rows for the pairs of blob and rule version that ``ledger`` lacks: of all texts, each blob once.

    The text moves once, one copy of each blob from each task.
    """
    every = F.array(*[F.lit(r.key) for r in rules])
    blobs = _addressed(versions, text_col, text_col).groupBy("blob").agg(F.first("text").alias("text"))
    done = ledger.where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    pending = F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))
    unseen = blobs.join(done, "blob", "left").select("blob", "text", pending.alias("pending")).where(F.size("pending") > 0)
    return scan_blobs(unseen, rules)


def extend_ledger(versions: DataFrame, path: str, rules: tuple[SecretRule, ...] = RULES, text_col: str = "text") -> None:
    """Scan what the ledger stored at ``path`` lacks, and append it there; a run that fails appends nothing."""
    known = open_ledger(versions.sparkSession, path)
    scan_unseen(versions, known, rules, text_col).write.mode("append").parquet(path)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[SecretRule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (path, blob, spans) of every row of ``versions``, from a ledger that holds their blobs.

    Null texts count as empty. Repeated rows and null paths come back as they are; other columns are ignored. The spans
    of a row are sorted by start and then by the order of the rules. Only addresses and spans are joined; a blob of very
    many paths is a skewed side of an outer join, which Spark splits.
    """
    keys = [r.key for r in rules]
    order = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i))])
    hits = ledger.where(F.col("rule").isin(keys)).where(F.size("spans") > 0).select("blob", F.element_at(order, F.col("rule")).alias("kind"), F.explode("spans").alias("s"))
    by_blob = hits.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("s.start", "kind", "s.stop"))).alias("spans"))
    joined = _addressed(versions, path_col, text_col).select("path", "blob").join(by_blob, "blob", "left")
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    return joined.select(F.col("path").alias(path_col), "blob", F.coalesce("spans", none).alias("spans"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[SecretRule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings of every row of ``versions`` as in :func:`findings`, and the ledger after the run.

    ``ledger(blob, rule, spans)`` is what earlier runs returned; None stands for the first run.
    """
    ledger = empty_ledger(versions.sparkSession) if ledger is None else ledger
    grown = ledger.unionByName(materialize(scan_unseen(versions, ledger, rules, text_col), "secrets-ledger"))
    return findings(versions, grown, rules, path_col, text_col), grown


def span_list(spans: Column, rules: tuple[SecretRule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))
