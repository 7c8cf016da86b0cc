"""Orders: hierarchies, clusters on a line, probes of orders, splits and comparisons of traces."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from ..operators import hierarchy, ordering
from ..runtime import ship, table
from .registry import query


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


@query()
def hierarchical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in an order in which blocks of 512, then 64, hold near ones."""
    out = hierarchy.hierarchical_order(_vectors(spark, sf_dir))
    return out.select(F.col("id").alias("vec_id"), "block", "rank")


_DISTANCE = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


_SPLIT = (
    "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), n AS (SELECT count(*) AS n, count(*) // 2 AS h FROM e), "
    "a AS (SELECT d FROM (SELECT generate_subscripts(x, 1) AS d, unnest(x) AS v FROM e) GROUP BY d ORDER BY round(var_pop(v), 9) DESC, d LIMIT 1), "
    "r AS (SELECT vec_id, x, row_number() OVER (ORDER BY x[(SELECT d FROM a)], vec_id) - 1 AS r FROM e), "
    "c AS (SELECT (SELECT x FROM r, n WHERE r = h // 2) AS l, (SELECT x FROM r, n WHERE r = least(n - 1, h + (n - h) // 2)) AS m), "
    f"g AS (SELECT vec_id, round({_DISTANCE.format(a='x', b='l')} - {_DISTANCE.format(a='x', b='m')}, 9) AS gap FROM e, c) "
    ", s AS (SELECT vec_id, row_number() OVER (ORDER BY gap, vec_id) <= (SELECT h FROM n) AS is_left FROM g) "
)


@query(_SPLIT + "SELECT vec_id, is_left FROM s")
def balanced_split_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One balanced split of all vectors into halves."""
    v = _vectors(spark, sf_dir)
    rows = v.select(F.lit("").alias("group"), "id", "features", F.lit(v.count() // 2).cast("long").alias("left"))
    return hierarchy.split(rows).select(F.col("id").alias("vec_id"), "is_left")


@query(
    _SPLIT.rstrip() + ", m AS MATERIALIZED (SELECT is_left, list(v ORDER BY d) AS x FROM (SELECT is_left, d, avg(v) AS v FROM (SELECT vec_id, generate_subscripts(x, 1) AS d, unnest(x) AS v FROM e) JOIN s USING (vec_id) GROUP BY ALL) GROUP BY is_left), "
    f"g2 AS (SELECT vec_id, round({_DISTANCE.format(a='e.x', b='l.x')} - {_DISTANCE.format(a='e.x', b='r.x')}, 9) AS gap FROM e, (SELECT x FROM m WHERE is_left) AS l, (SELECT x FROM m WHERE NOT is_left) AS r) "
    "SELECT vec_id, row_number() OVER (ORDER BY gap, vec_id) <= (SELECT h FROM n) AS is_left FROM g2"
)
def balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of equal size around two centres, which move to the halves' means once."""
    v = _vectors(spark, sf_dir)
    rows = v.select(F.lit("").alias("group"), "id", "features", F.lit(v.count() // 2).cast("long").alias("left"))
    return hierarchy.split(rows, 2).select(F.col("id").alias("vec_id"), "is_left")


_ITERATION = (
    ", m{i} AS (SELECT cluster, round(avg(value), 9) AS centre FROM c{j} GROUP BY 1), k{i} AS (SELECT (centre + lead(centre) OVER (ORDER BY centre, cluster)) / 2 AS middle FROM m{i}), "
    "c{i} AS (SELECT vec_id, value, (SELECT count(*) FROM k{i} WHERE middle < value) AS cluster FROM c{j})"
)


@query(
    "WITH p AS (SELECT vec_id, round(embedding[1]::DOUBLE, 9) AS value FROM embeddings), n AS (SELECT count(*) AS n, greatest(1, count(*) // 80) AS k FROM p), "
    "c0 AS (SELECT vec_id, value, ((row_number() OVER (ORDER BY value, vec_id) - 1) * (SELECT k FROM n)) // (SELECT n FROM n) AS cluster FROM p)"
    + "".join(_ITERATION.format(i=i, j=i - 1) for i in (1, 2, 3)) + " SELECT vec_id, cluster::BIGINT AS cluster FROM c3"
)
def kmeans_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means on one axis, a cluster for 80 points."""
    points = _vectors(spark, sf_dir).select("id", F.round(F.get("features", F.lit(0)), 9).alias("value"))
    return hierarchy.line_clusters(points).select(F.col("id").alias("vec_id"), "cluster")


@query()
def projection_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first principal component of vectors, and clusters along it."""
    clusters = hierarchy.line_clusters(hierarchy.project(_vectors(spark, sf_dir)))
    return clusters.select(F.col("id").alias("vec_id"), F.round("value", 6).alias("value"), "cluster")


@query("SELECT o_orderkey, rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank FROM orders) WHERE rank BETWEEN 10 AND 29 OR rank BETWEEN 100 AND 149")
def rank_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of ranks: 20 from 10 on, 50 from 100 on."""
    r = ordering.running(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", {"n": F.lit(1)}).withColumn("rank", F.col("n") - 1)
    return r.where(F.col("rank").between(10, 29) | F.col("rank").between(100, 149)).select("o_orderkey", "rank")


@query("SELECT count(*) FILTER (a <> b) AS moved, count(*) AS rows_compared FROM (SELECT row_number() OVER (ORDER BY doc_id) AS a, row_number() OVER (ORDER BY n_chars, doc_id) AS b FROM documents)")
def moved_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have another place in an order by length."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.struct("n_chars", "doc_id").alias("o"))
    both = ordering.running(ordering.running(d, "doc_id", {"a": F.lit(1)}), "o", {"b": F.lit(1)})
    return both.agg(F.count(F.when(F.col("a") != F.col("b"), 1)).alias("moved"), F.count("*").alias("rows_compared"))


@query("SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM (SELECT row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS a, row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber) AS b FROM lineitem)")
def probe_rank_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson's correlation of ranks; ties rank by position, so each rank comes once."""
    rows = table(spark, sf_dir, "lineitem").select(F.struct("l_extendedprice", "l_orderkey", "l_linenumber").alias("x"), F.struct("l_quantity", "l_orderkey", "l_linenumber").alias("y"))
    ranked = ordering.running(ordering.running(rows, "x", {"a": F.lit(1)}), "y", {"b": F.lit(1)})
    return ranked.agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 6).alias("spearman"))


@query(
    "WITH p AS (SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN 'baseline' WHEN 2 THEN 'optimized' ELSE 'random' END AS kind, l_extendedprice AS bits FROM lineitem WHERE l_linenumber <= 3), "
    "w AS (SELECT l_orderkey, max(bits) FILTER (kind = 'baseline') AS base, max(bits) FILTER (kind = 'optimized') AS opt, max(bits) FILTER (kind = 'random') AS rnd FROM p GROUP BY 1) "
    "SELECT count(*) FILTER (opt < base) AS optimized_wins, count(*) FILTER (opt > base) AS optimized_losses, count(*) FILTER (rnd < base) AS random_wins, count(*) FILTER (rnd > base) AS random_losses FROM w"
)
def predecessor_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins and losses against the baseline predecessor, by kind of predecessor."""
    line = F.col("l_linenumber")
    p = table(spark, sf_dir, "lineitem").where(line <= 3).groupBy("l_orderkey").agg(*[F.max(F.when(line == k, F.col("l_extendedprice"))).alias(n) for k, n in ((1, "base"), (2, "opt"), (3, "rnd"))])
    count = lambda c: F.count(F.when(c, 1))
    return p.agg(count(F.col("opt") < F.col("base")).alias("optimized_wins"), count(F.col("opt") > F.col("base")).alias("optimized_losses"),
                 count(F.col("rnd") < F.col("base")).alias("random_wins"), count(F.col("rnd") > F.col("base")).alias("random_losses"))


@F.pandas_udf(IntegerType())
def blake_split(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The split (0 to 7) of an id: four bytes of BLAKE2s over its decimal digits, little-endian; null for null."""
    for batch in ids:
        yield batch.map(lambda i: None if pd.isna(i) else int.from_bytes(hashlib.blake2s(str(int(i)).encode(), digest_size=4).digest(), "little") % 8).astype("Int32")


@F.pandas_udf(LongType())
def gzip_size(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bytes of a text by gzip at level 9; null for null."""
    for batch in texts:
        yield batch.map(lambda t: None if t is None else len(gzip.compress(t.encode(), 9, mtime=0))).astype("Int64")


@query()
def doc_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by split, with their sizes before and after gzip."""
    ship(spark)
    d = table(spark, sf_dir, "documents").select(blake_split("doc_id").alias("split"), F.octet_length("text").cast("long").alias("b"), gzip_size("text").alias("g"))
    return d.groupBy("split").agg(F.count("*").alias("docs"), F.sum("b").alias("text_bytes"), F.sum("g").alias("gzip_bytes"))


@query(
    "SELECT conv_id, turn, array_to_string(list_filter([lag(turn, 1) OVER w, lag(turn, 2) OVER w, lag(turn, 3) OVER w, lag(turn, 4) OVER w], lambda x: x IS NOT NULL), ',') AS candidates "
    "FROM conversations WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)"
)
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest four earlier positions of the same context."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(",", *[F.lag("turn", k).over(w).cast("string") for k in range(1, 5)]).alias("candidates"))


_TRACE = "SELECT {t} AS region, count(*) AS bytes, round(sum(l_extendedprice), 2) AS bits FROM lineitem WHERE l_linenumber {w} GROUP BY 1"


@query(
    f"WITH a AS ({_TRACE.format(t='l_suppkey % 40', w='<= 2')}), b AS ({_TRACE.format(t='l_suppkey % 41', w='> 2')}) "
    "SELECT coalesce(a.region, b.region) AS region, least(coalesce(a.bytes, 0), coalesce(b.bytes, 0)) AS bytes, round(coalesce(a.bits, 0) - coalesce(b.bits, 0), 2) AS gain FROM a FULL JOIN b ON a.region = b.region WHERE least(coalesce(a.bytes, 0), coalesce(b.bytes, 0)) > 0"
)
def trace_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two traces by key: bytes that both have, and bits gained."""
    rows = table(spark, sf_dir, "lineitem")
    side = lambda mod, w, s: rows.where(w).groupBy((F.col("l_suppkey") % mod).alias("region")).agg(F.count("*").alias(f"n{s}"), F.round(F.sum("l_extendedprice"), 2).alias(f"b{s}"))
    both = side(40, "l_linenumber <= 2", 0).join(side(41, "l_linenumber > 2", 1), "region", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("region", F.least(zero("n0"), zero("n1")).alias("bytes"), F.round(zero("b0") - zero("b1"), 2).alias("gain")).where("bytes > 0")


@query(
    "SELECT CASE WHEN grouping(host) = 0 THEN 'domain' WHEN grouping(scheme) = 0 THEN 'scheme' WHEN grouping(lang) = 0 THEN 'first_segment' ELSE 'total' END AS dimension, coalesce(host, scheme, lang, 'all') AS key, count(*) AS urls, sum(strlen(url))::BIGINT AS bytes, count(DISTINCT url) AS distinct_urls "
    "FROM (SELECT coalesce(url, '') AS url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]*)', 1) AS lang FROM pages) GROUP BY GROUPING SETS ((host), (scheme), (lang), ())"
)
def url_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs by host, scheme, first segment and in all; equal URLs meet first, so counts of distinct ones are sums."""
    p = table(spark, sf_dir, "pages").groupBy(F.coalesce("url", F.lit("")).alias("url")).agg(F.count("*").alias("n"))
    keys = F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("key")) for k, v in (
        ("domain", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)), ("scheme", F.regexp_extract("url", "^([a-z]+)://", 1)),
        ("first_segment", F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^/?#]*)", 1)), ("total", F.lit("all")))])
    rows = p.select("n", (F.octet_length("url") * F.col("n")).alias("b"), F.explode(keys).alias("k"))
    return rows.groupBy("k.dimension", "k.key").agg(F.sum("n").alias("urls"), F.sum("b").alias("bytes"), F.count("*").alias("distinct_urls"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS restored FROM events")
def timestamp_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times packed into year, day of a year of 31-day months and second, and restored."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "year(ts) - 2001 AS y", "month(ts) * 31 + dayofmonth(ts) - 32 AS d", "hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s")
    return e.select("event_id", F.format_string("%04d-%02d-%02dT%02d:%02d:%02dZ", F.col("y") + 2001, F.expr("int(d div 31) + 1"), F.expr("int(d % 31) + 1"), F.expr("int(s div 3600)"), F.expr("int(s div 60 % 60)"), F.expr("int(s % 60)")).alias("restored"))
