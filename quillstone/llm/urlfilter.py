"""URL filtering: host-suffix and path-prefix expressions, a join on short hash prefixes, full digests, precedence.

Each distinct URL is expanded into expressions host-suffix + path-prefix, as many labels and characters long as some
rule is; so no rule is missed, and a URL yields at most (label counts) x (path lengths) expressions of the rules. An
equi-join on the first bytes of the expressions' SHA-256 finds candidates, equal full digests confirm them, and the
longest rule wins (then the longer host; then block).

Defined cases: a null URL or one without :// has an empty host and path, and gets the default verdict; a rule without
a path (its path is empty) fits every path; repeated rows each get a row; an empty table gives none; with no rules all
get the default; further columns of pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import free_names, materialize, maybe_broadcast, ship

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DEFAULT = "allow"
PREFIX_HEX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """host, path, verdict of each rule."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule (like `net/`; null if none fits), verdict (allow or block)."""
    ship(pages.sparkSession)
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).where(F.col("r_host").isNotNull() & (F.col("r_host") != ""))
    rules = rules.select("*", _expression(F.col("r_host"), F.col("r_path")).alias("digest"))
    lengths = rules.agg(F.count("*").alias("n"), F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("chars")).first()
    labels, chars = sorted(lengths.labels), sorted(lengths.chars)

    # one row for each distinct URL; a hot URL is counted before the shuffle and never expanded twice
    urls = pages.select("url").groupBy("url").agg(F.count("*").alias("copies")).select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if lengths.n:
        suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in labels]))
        hosts = urls.select("*", F.explode(suffixes).alias("suffix"))
        prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in chars]))
        terms = hosts.select("url", F.explode(prefixes).alias("prefix"), "suffix").select("url", _expression(F.col("suffix"), F.col("prefix")).alias("term"))
        left = terms.select("url", "term", F.substring("term", 1, PREFIX_HEX).alias("short"))
        right = maybe_broadcast(rules.select("*", F.substring("digest", 1, PREFIX_HEX).alias("short")), lengths.n)
        rank = F.struct((F.length("r_host") + F.length("r_path")).alias("whole"), F.length("r_host").alias("hosts"), (F.col("r_verdict") == "block").cast("int").alias("strict"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
        best = left.join(right, "short").where(F.col("term") == F.col("digest")).groupBy("url").agg(F.max(rank).alias("best")).select("url", "best.rule", "best.verdict")
        best = materialize(best, "url-verdicts")
        fits = best.count()
    else:
        best, fits = urls.select("url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0), 0
    named = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return named.join(maybe_broadcast(best, fits), "url", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """The pages whose verdict is allow, with all their columns."""
    verdicts = judge(pages.select(F.lit(0).alias("page_id"), "url").distinct(), rules, default)
    host, path, of_host, of_path = free_names(pages, "host", "path", "of_host", "of_path")
    fine = materialize(verdicts.where(F.col("verdict") == "allow").select(F.col("host").alias(of_host), F.col("path").alias(of_path)).distinct(), "allowed")
    named = pages.withColumn(host, host_of(F.col("url"))).withColumn(path, path_of(F.col("url")))
    same = (F.col(host) == F.col(of_host)) & (F.col(path) == F.col(of_path))
    return named.join(maybe_broadcast(fine, fine.count()), same, "left_semi").drop(host, path)
