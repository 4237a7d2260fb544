"""URL filters by host-suffix and path-prefix expressions.

A rule is a host (which stands for itself and all subdomains) and the start of
a path. Every URL is expanded into the expressions that a rule could be: its
host's suffixes of as many labels as some rule's host has, with its path's
prefixes as long as some rule's path. These are joined on a short prefix of
their digests; the full digest then confirms, and the longest rule decides.

Each distinct (host, path) is judged once. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (action, host, path)
DEFAULT_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Hexadecimal digits of the digest that the join compares.
SHORT = 8


def rule_table(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "action string, rule_host string, rule_path string")


def _lower(host: Column) -> Column:
    """A-Z in small letters; other letters stay, in urls and rules alike."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to
    ``?``, ``#`` or the end. Both empty where url is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lower = _lower(host)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower, path


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """All columns of pages but host, path, rule and verdict, then those four.

    rule is the longest fitting rule, host and path in one; null if none fits,
    and verdict is then ``default``. Of rules with the same host and path, block
    goes before allow. A null or malformed url has an empty host and path, which
    only a rule with both empty fits. Rows are kept as they are, repeated ones
    too; a long url is read whole; an empty table gives no rows, and without
    rules every url gets ``default``. rules: action, rule_host, rule_path (null: empty); it may be large,
    only the lengths of its paths and the depth of its hosts are gathered.
    """
    rules = rules.select(
        "action",
        _lower(F.coalesce("rule_host", F.lit(""))).alias("rule_host"),
        F.coalesce("rule_path", F.lit("")).alias("rule_path"),
    )
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))  # 'block' > 'allow'
    text = F.concat("rule_host", "rule_path")
    ruled = rules.select("action", text.alias("rule"), F.sha2(text, 256).alias("rule_digest")).withColumn(
        "short", F.substring("rule_digest", 1, SHORT)
    )
    shape = rules.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"),  # at most the longest path's length
    ).first()
    labels, lengths = shape["labels"] or 0, shape["lengths"] or []
    host, path = host_and_path(F.col("url"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    seen = pages.select(*kept, host.alias("host"), path.alias("path"))
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, labels + 1)]))
    fitting = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    prefixes = F.array_compact(F.array(*fitting)) if fitting else F.array().cast("array<string>")
    expressions = F.flatten(
        F.transform(suffixes, lambda h: F.transform(F.col("prefixes"), lambda p: F.concat(h, p)))
    )
    asked = (
        seen.select("host", "path")
        .distinct()
        .withColumn("prefixes", prefixes)
        .select("host", "path", F.explode(expressions if labels else F.col("prefixes")).alias("expression"))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "action"))
    judged = (
        asked.join(ruled, "short")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(best.alias("__best"))
    )
    return seen.join(judged, ["host", "path"], "left").select(
        *kept,
        "host",
        "path",
        F.col("__best.rule").alias("rule"),
        F.coalesce("__best.action", F.lit(default)).alias("verdict"),
    )
