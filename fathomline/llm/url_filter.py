"""URL filters: host-suffix and path-prefix expressions against hashed rules.

Every URL is expanded into (host suffix, path prefix) expressions. Rules are stored by the
first ``PREFIX_HEX`` hex digits of the SHA-256 of their expression; an equi-join on those short
prefixes proposes rules, the full digest confirms them, and the longest confirmed rule decides.

A host's suffixes are cut at the labels of the rules' longest host, so a host of many thousands of
labels costs no more than another. Work is done per distinct URL, so a URL that a third of the rows repeat is judged once; the
verdicts of URLs that fit some rule go back to the rows by an equi-join that adaptive execution
may split. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once

PREFIX_HEX = 8

#: Fixed values of the op9 contract: (verdict, host, path prefix).
CONTRACT_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table with their digests."""
    df = spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
    return hashed_rules(df)


def hashed_rules(rules: DataFrame) -> DataFrame:
    """Add the rule's text, full digest and hash prefix; of equal expressions block wins."""
    text = F.concat("rule_host", "rule_path")
    return (
        rules.where(F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull())
        .groupBy(F.lower("rule_host").alias("rule_host"), "rule_path")
        .agg(F.max("verdict").alias("verdict"))  # 'block' > 'allow'
        .withColumn("rule", text)
        .withColumn("digest", digest_of(F.col("rule_host"), F.col("rule_path")))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )


def digest_of(host: Column, path: Column) -> Column:
    """SHA-256 of host, a NUL, and path: the NUL keeps (ab, c) and (a, bc) apart."""
    return F.sha2(F.concat(host, F.lit("\u0000"), path), 256)


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    Null URLs and URLs without ``://`` have an empty host and path, fit no rule and get
    ``default``. Repeated rows are kept as they are. Columns named host, path, rule or verdict
    that ``pages`` already has are replaced. The set of path-prefix lengths in the rules and the most
    labels of a rule's host are read first (as many rows as the longest rule path has characters at
    most), so a rule path may end anywhere, not only at a slash.
    """
    shapes = rules.groupBy(F.length("rule_path").alias("n")).agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels")).collect()
    lengths, most = sorted(r.n for r in shapes), max((r.labels for r in shapes), default=1)
    pages = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url_col])
    pages = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    urls = pages.where(F.col("host") != "").groupBy("host", "path").agg(F.count(F.lit(1)).alias("_n"))
    labels = F.split("host", r"\.")
    ends = once(F.slice(labels, F.greatest(F.size(labels) - most + 1, F.lit(1)), most), lambda kept: F.transform(F.sequence(F.lit(1), F.size(kept)), lambda i: F.array_join(F.slice(kept, i, most), ".")))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    expressions = (
        urls.select("host", "path", F.explode(ends).alias("_suffix"), prefixes.alias("_prefixes"))
        .select("host", "path", "_suffix", F.explode(F.filter("_prefixes", lambda p: p.isNotNull())).alias("_head"))
        .withColumn("_digest", digest_of(F.col("_suffix"), F.col("_head")))
        .withColumn("prefix", F.substring("_digest", 1, PREFIX_HEX))
    )
    fitting = expressions.join(rules, "prefix").where(F.col("_digest") == F.col("digest"))
    rank = F.struct(F.length("rule"), F.length("rule_host"), F.col("verdict"), F.col("rule"))
    decided = fitting.groupBy("host", "path").agg(F.max(rank).alias("_best")).select("host", "path", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("verdict"))
    return pages.join(decided, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
