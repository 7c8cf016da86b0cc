"""The library's own queries by name, with the SQL that they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stemming
from ..functions import text as tx
from ..functions import urls as ur
from ..operators import causal, control, ordering, vectors
from ..runtime import maybe_broadcast, ship, spread, table
from .registry import query


def _round(c, n: int = 6):
    return F.round(c, n)


_COUNT = "((length({t}) - length(replace({t}, '{p}', ''))) // {n})"


_SHARE = "round(coalesce({a} / nullif({b}, 0), 0), 6)"


def _within(first: str, last: str) -> str:
    return f"sum(CASE WHEN x BETWEEN '{first}' AND '{last}' THEN n ELSE 0 END)"


def _features_sql() -> str:
    """The 151 structural features of whole texts, empty and null ones too."""
    share = lambda a, b: _SHARE.format(a=a, b=b)
    kib = "(t / 1024.0)"
    shape = [
        "round(log2(t + 1), 6)", "round(coalesce(byte_entropy, 0), 6)", share("a", "t"), share("(t - a)", "t"), share("d", "t"), share("u", "t"), share("l", "t"), share("w", "t"), share("words", kib),
        share("letters", "words"), share("numbers", "(words + numbers)"), share("nl", kib),
    ]
    rates = [share(_COUNT.format(t="text", p=p, n=len(p)), kib) for p in tx.PATTERNS.values()]
    chars = [share(f"a{k}", "a") for k in range(128)]
    columns = ", ".join(f"{c} AS {n}" for c, n in zip(shape + rates + chars, tx.FEATURES, strict=True))
    return (
        "WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents), h AS MATERIALIZED (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM d) GROUP BY ALL), "
        f"s AS MATERIALIZED (SELECT doc_id, sum(n) AS t, {_within('00', '7F')} AS a, {_within('30', '39')} AS d, {_within('41', '5A')} AS u, {_within('61', '7A')} AS l, {_within('09', '0A')} + {_within('0D', '0D')} + {_within('20', '20')} AS w, "
        f"{_within('0A', '0A')} AS nl, {', '.join(f'{_within(f"{k:02X}", f"{k:02X}")} AS a{k}' for k in range(128))} FROM h GROUP BY doc_id), e AS (SELECT doc_id, -sum(n / t * log2(n / t)) AS byte_entropy FROM h JOIN s USING (doc_id) GROUP BY doc_id), "
        "k AS (SELECT doc_id, text, len(regexp_extract_all(text, '[A-Za-z]+')) AS words, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, len(regexp_extract_all(text, '\\b[0-9]+\\b')) AS numbers FROM d) "
        f"SELECT doc_id, {columns} FROM (SELECT k.*, s.* EXCLUDE (doc_id, t), coalesce(s.t, 0) AS t, byte_entropy FROM k LEFT JOIN s USING (doc_id) LEFT JOIN e USING (doc_id))"
    )


@query(_features_sql())
def doc_structural_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of 151 structural features of each document: one pass over its bytes, no shuffle."""
    ship(spark)
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.mapInArrow(tx.features_of, "doc_id long, " + ", ".join(f"{c} double" for c in tx.FEATURES))


@query(
    "WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents), h AS (SELECT doc_id, x, count(*) AS n FROM b WHERE x < '80' GROUP BY ALL) "
    "SELECT doc_id, ('0x' || x)::INT AS byte, round(n / sum(n) OVER (PARTITION BY doc_id), 10) AS ratio FROM h"
)
def doc_ascii_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each ASCII byte among a document's ASCII bytes."""
    ship(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", F.slice(tx.byte_histogram("text"), 1, 128).alias("h")).select("doc_id", "h", tx.slots(F.col("h"), 0, 127).alias("t"))
    return d.select("doc_id", "t", F.posexplode("h").alias("byte", "n")).where("n > 0").select("doc_id", F.col("byte").cast("int").alias("byte"), _round(F.col("n") / F.col("t"), 10).alias("ratio"))


@query("SELECT page_id" + "".join(f", round(coalesce({_COUNT.format(t='html', p=p, n=len(p))} / nullif(strlen(html) / 1024.0, 0), 0), 6) AS {k}_per_kib" for k, p in tx.PATTERNS.items()) + " FROM pages")
def page_markup_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kib = F.octet_length("html") / 1024.0
    return table(spark, sf_dir, "pages").select("page_id", *[_round(tx.safe_ratio(tx.occurrences(F.col("html"), p), kib)).alias(f"{k}_per_kib") for k, p in tx.PATTERNS.items()])


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, starts_with(regexp_extract(html, '<title>([^<]*)</title>', 1), 'The') AS flagged FROM pages")
def page_title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), title.startswith("The").alias("flagged"))


@query("SELECT page_id, strlen(regexp_replace(html, '<script>[^<]*</script>', '', 'g')) AS stripped_bytes, left(regexp_replace(html, '<[^>]*>', '', 'g'), 400) AS lead FROM pages")
def page_template_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup stripped, and the leading characters of what is left (the limit is the feature)."""
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length(F.regexp_replace("html", "<script>[^<]*</script>", "")).cast("long").alias("stripped_bytes"), F.substring(F.regexp_replace("html", "<[^>]*>", ""), 1, 400).alias("lead"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS all_index, CASE WHEN lang <> 'de' THEN sum((lang <> 'de')::INT) OVER (ORDER BY doc_id) - 1 END::BIGINT AS kept_index FROM documents")
def dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents numbered, and the ones that a predicate keeps numbered by themselves."""
    return ordering.dense_index(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", F.col("lang") == "de").select("doc_id", "all_index", "kept_index")


@query("SELECT doc_id, regexp_matches(text, '^(#REDIRECT|#redirect|#Redirect|#REdirect|\\{\\{softredirect)') AS is_redirect, left(text, 2) IN ('#R', '#r') AS loose FROM documents")
def redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.rlike(r"^(#REDIRECT|#redirect|#Redirect|#REdirect|\{\{softredirect)").alias("is_redirect"), F.substring(t, 1, 2).isin("#R", "#r").alias("loose"))


@query("SELECT l.doc_id, d.source, l.quality FROM labels l JOIN documents d USING (doc_id)")
def order_remap_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order joined to attributes; unknown ids drop out."""
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("doc_id", "source", "quality")


_RANKS = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM (SELECT DISTINCT doc_id FROM labels)"


@query(f"WITH o AS ({_RANKS}) SELECT doc_id, rank FROM o UNION ALL SELECT doc_id, (SELECT max(rank) FROM o) + row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM o)")
def order_complete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order, completed by the ids that it leaves out."""
    ids = table(spark, sf_dir, "labels").select("doc_id").distinct()
    order = ordering.running(ids, "doc_id", {"n": F.lit(1)}).select((F.col("n") - 1).alias("rank"), "doc_id")
    return ordering.complete(order, table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "rank").select("doc_id", "rank")


@query("SELECT count(*) AS n_ids, count(DISTINCT l.doc_id) AS n_distinct, sum((d.doc_id IS NULL)::INT)::BIGINT AS n_unknown FROM labels l LEFT JOIN documents d USING (doc_id)")
def order_unknown_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("known"))
    return table(spark, sf_dir, "labels").join(known, "doc_id", "left").agg(F.count("*").alias("n_ids"), F.countDistinct("doc_id").alias("n_distinct"), F.sum(F.col("known").isNull().cast("long")).alias("n_unknown"))


_OFFSETS = "SELECT doc_id, strlen(text) AS size, sum(strlen(text)) OVER (ORDER BY doc_id)::BIGINT AS stream_end FROM documents"


@query(f"SELECT doc_id, stream_end - size AS stream_begin, stream_end FROM ({_OFFSETS})")
def corpus_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"))
    return ordering.offsets(d, "doc_id", F.col("size")).select("doc_id", "stream_begin", "stream_end")


@query(f"SELECT doc_id, stream_end FROM ({_OFFSETS}) WHERE stream_end <= 1000000 OR stream_end = size")
def corpus_prefix_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that fit into a byte target, the first one always (the cut is the feature)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"))
    return ordering.offsets(d, "doc_id", F.col("size")).where("stream_end <= 1000000 OR stream_begin = 0").select("doc_id", "stream_end")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents) SELECT doc_id, rank, (rank // 32)::BIGINT AS block, CASE WHEN rank BETWEEN 10 AND 59 THEN 0 WHEN rank BETWEEN 100 AND 179 THEN 1 END AS segment FROM r")
def rank_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a fixed size, and segments START:COUNT of ranks."""
    d = ordering.running(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", {"n": F.lit(1)}).select("doc_id", (F.col("n") - 1).alias("rank"))
    segment = F.when(F.col("rank").between(10, 59), 0).when(F.col("rank").between(100, 179), 1)
    return d.select("doc_id", "rank", F.floor(F.col("rank") / 32).alias("block"), segment.alias("segment"))


@query("SELECT doc_id, row_number() OVER (ORDER BY contains(text, '!!'), contains(text, '%%%'), lang = 'es', doc_id) AS position FROM documents")
def flag_priority_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sort by flags of descending priority (flagged last), then by id."""
    flags = F.col("text").contains("!!").cast("int") * 4 + F.col("text").contains("%%%").cast("int") * 2 + (F.col("lang") == "es").cast("int")
    d = table(spark, sf_dir, "documents").select("doc_id", F.struct(flags.alias("flags"), "doc_id").alias("o"))
    return ordering.running(d, "o", {"position": F.lit(1)}).select("doc_id", "position")


@query("SELECT doc_id, source, min(doc_id) OVER (PARTITION BY source) AS first_of_cluster, dense_rank() OVER (ORDER BY first) AS cluster_rank FROM (SELECT *, min(doc_id) OVER (PARTITION BY source) AS first FROM documents)")
def cluster_min_rank_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters ordered by their first member."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    firsts = d.groupBy("source").agg(F.min("doc_id").alias("first_of_cluster"))
    ranks = firsts.withColumn("cluster_rank", F.row_number().over(Window.orderBy("first_of_cluster")).cast("long"))  # a row for each cluster
    return d.join(maybe_broadcast(ranks, ranks.count()), "source").select("doc_id", "source", "first_of_cluster", "cluster_rank")


@query(
    "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents) "
    "SELECT doc_id, k::INT AS bin, round(exp(-0.5::DOUBLE * pow((rank / greatest(n - 1, 1) - k / 63::DOUBLE) / (1.5::DOUBLE / 63::DOUBLE), 2)), 6) AS value FROM r, range(64) AS t(k)"
)
def position_rbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    n = d.count()
    r = ordering.running(d, "doc_id", {"n": F.lit(1)})
    return r.select("doc_id", F.posexplode(ordering.position_features(F.col("n") - 1, F.lit(n))).alias("bin", "v")).select("doc_id", "bin", _round("v").alias("value"))


@query("SELECT o_orderkey, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS delta FROM orders")
def id_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") - F.coalesce(F.lag("o_orderkey").over(w), F.lit(0))).alias("delta"))


@query("SELECT o_orderkey, o_orderkey AS restored FROM orders")
def id_delta_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") - F.coalesce(F.lag("o_orderkey").over(w), F.lit(0))).alias("delta"))
    return d.select("o_orderkey", F.sum("delta").over(w).alias("restored"))


@query("SELECT event_id, (year(ts) - 2001)::INT AS yy, (month(ts) * 31 + day(ts) - 32)::INT AS md, (hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)))::INT AS s FROM events")
def timestamp_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.year("ts") - 2001).alias("yy"), (F.month("ts") * 31 + F.dayofmonth("ts") - 32).alias("md"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("s"))


@query(f"SELECT page_id, md5(translate(html, '{tx.WRT_FROM}', '{tx.WRT_TO}')) AS coded_md5, md5(html) AS restored_md5 FROM pages")
def wrt_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = tx.wrt_permute(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(coded).alias("coded_md5"), F.md5(tx.wrt_permute(coded)).alias("restored_md5"))


_ENTITIES = (("&amp;", "&&"), ("&quot;", '&"'), ("&lt;", "&<"), ("&gt;", "&>"))


def _shrunk(c: str) -> str:
    for a, b in _ENTITIES:
        c = f"replace({c}, '{a}', '{b}')"
    return c


@query(f"SELECT page_id, strlen(html) - strlen({_shrunk('html')}) AS saved_bytes, md5(regexp_replace({_shrunk('html')}, '&([\"<>])', '\\1', 'g')) AS stripped_md5 FROM pages")
def entity_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("html")
    for a, b in _ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "pages").select("page_id", (F.octet_length("html") - F.octet_length(c)).cast("long").alias("saved_bytes"), F.md5(F.regexp_replace(c, '&(["<>])', "$1")).alias("stripped_md5"))


_WORDS = "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word"


@query(f"WITH w AS ({_WORDS}) SELECT word, n, idx, (CASE WHEN idx < 80 THEN 1 WHEN idx < 3920 THEN 2 WHEN idx < 44880 THEN 3 ELSE 0 END)::INT AS code_bytes FROM (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS idx FROM w)")
def word_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by frequency, their ranks and the length of their codes."""
    pairs = spread(table(spark, sf_dir, "documents").select("text")).select(F.explode(stemming.word_counts(spark, F.lower("text").cast("binary"), marks=False)).alias("p"))
    w = pairs.groupBy("p.word").agg(F.sum("p.n").alias("n"))
    r = ordering.running(w.withColumn("o", F.struct((-F.col("n")).alias("m"), "word")), "o", {"k": F.lit(1)}).withColumn("idx", F.col("k") - 1)
    return r.select("word", "n", "idx", F.when(F.col("idx") < 80, 1).when(F.col("idx") < 3920, 2).when(F.col("idx") < 44880, 3).otherwise(0).alias("code_bytes"))


_RUNS = "SELECT page_id, unnest(regexp_extract_all(html, '[0-9]+')) AS run FROM pages"
_BUCKET = "CASE WHEN length({c}) <= 4 THEN length({c})::VARCHAR WHEN length({c}) <= 6 THEN '5-6' WHEN length({c}) <= 8 THEN '7-8' ELSE '9+' END"


def _bucket(c: str):
    n = F.length(c)
    return F.when(n <= 4, n.cast("string")).when(n <= 6, "5-6").when(n <= 8, "7-8").otherwise("9+")


def _found(df: DataFrame, c: str, pattern: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(0))).alias("x"))


@query(f"SELECT {_BUCKET.format(c='run')} AS bucket, count(*) AS runs, sum(length(run))::BIGINT AS digits FROM ({_RUNS}) GROUP BY 1")
def numeric_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(table(spark, sf_dir, "pages"), "html", "[0-9]+").groupBy(_bucket("x").alias("bucket")).agg(F.count("*").alias("runs"), F.sum(F.length("x").cast("long")).alias("digits"))


_SEQUENCE = "[0-9]+(?:(?:[-J:.,/+][0-9]+)|(?:T[0-9]+))*"


@query(f"SELECT regexp_replace(x, '[0-9]', 'D', 'g') AS shape, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '{_SEQUENCE}')) AS x FROM pages) GROUP BY 1")
def numeric_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(table(spark, sf_dir, "pages"), "html", _SEQUENCE).groupBy(tx.digit_shape(F.col("x")).alias("shape")).agg(F.count("*").alias("n"))


_TERMINATED = "SELECT regexp_extract(x, '^[0-9]+', 0) AS run, regexp_replace(x, '^[0-9]+', '') AS terminator FROM (SELECT unnest(regexp_extract_all(html, '[0-9]+[^0-9]?')) AS x FROM pages)"


def _terminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(table(spark, sf_dir, "pages"), "html", "[0-9]+[^0-9]?").select(F.regexp_extract("x", "^[0-9]+", 0).alias("run"), F.regexp_replace("x", "^[0-9]+", "").alias("terminator"))


@query(f"SELECT {_BUCKET.format(c='run')} AS bucket, terminator, count(*) AS n FROM ({_TERMINATED}) GROUP BY ALL")
def numeric_terminators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terminated(spark, sf_dir).groupBy(_bucket("run").alias("bucket"), "terminator").agg(F.count("*").alias("n"))


@query(
    f"WITH c AS (SELECT {_BUCKET.format(c='run')} AS bucket, terminator, count(*) AS n FROM ({_TERMINATED}) GROUP BY ALL), t AS (SELECT terminator, sum(n) AS n FROM c GROUP BY 1), b AS (SELECT bucket, sum(n) AS n FROM c GROUP BY 1), s AS (SELECT sum(n) AS n FROM c) "
    "SELECT round((SELECT -sum(t.n / s.n * log2(t.n / s.n)) FROM t, s), 6) AS entropy, round((SELECT -sum(c.n / s.n * log2(c.n / b.n)) FROM c JOIN b USING (bucket), s), 6) AS by_length"
)
def numeric_cond_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of terminators, and given the run's length."""
    c = numeric_terminators(spark, sf_dir)
    per = Window.partitionBy("bucket")
    rows = c.withColumn("b", F.sum("n").over(per))
    total = c.agg(F.sum("n").alias("s"))
    h = c.groupBy("terminator").agg(F.sum("n").alias("t")).crossJoin(F.broadcast(total)).agg(F.sum(-F.col("t") / F.col("s") * F.log2(F.col("t") / F.col("s"))).alias("entropy"))
    g = rows.crossJoin(F.broadcast(total)).agg(F.sum(-F.col("n") / F.col("s") * F.log2(F.col("n") / F.col("b"))).alias("by_length"))
    return h.crossJoin(g).select(_round("entropy").alias("entropy"), _round("by_length").alias("by_length"))  # one row each


_URL = "regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment"
_SEGMENTS = "list_filter(string_split(path, '/'), lambda s: s <> '')"


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", "url", ur.scheme(u).alias("scheme"), ur.host(u).alias("host"), ur.path(u).alias("path"), ur.query(u).alias("query"), ur.fragment(u).alias("fragment"))


@query(f"SELECT page_id, {_URL} FROM pages")
def url_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).drop("url")


@query(f"WITH u AS (SELECT page_id, {_URL} FROM pages), c AS (SELECT unnest({_SEGMENTS}) AS c FROM u) SELECT {ur.class_sql('c')} AS class, count(*) AS n, sum(strlen(c))::BIGINT AS bytes FROM c GROUP BY 1")
def url_component_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _urls(spark, sf_dir).select(F.explode(ur.segments(F.col("path"))).alias("c"))
    return c.groupBy(ur.component_class(F.col("c")).alias("class")).agg(F.count("*").alias("n"), F.sum(F.octet_length("c").cast("long")).alias("bytes"))


@query(f"WITH u AS (SELECT page_id, {_URL} FROM pages) SELECT page_id, array_to_string(list_transform({_SEGMENTS}, lambda s: {ur.class_sql('s')}), '/') AS template FROM u")
def url_path_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("page_id", ur.template(F.col("path")).alias("template"))


@query(f"WITH u AS (SELECT page_id, url, {_URL} FROM pages) SELECT CASE WHEN grouping(host) = 0 THEN 'domain' WHEN grouping(scheme) = 0 THEN 'scheme' ELSE 'total' END AS dimension, coalesce(host, scheme, 'total') AS key, count(*) AS urls, count(DISTINCT url) AS distinct_urls, sum(strlen(url))::BIGINT AS bytes FROM u GROUP BY GROUPING SETS ((host), (scheme), ())")
def url_domain_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs by domain, by scheme and in total."""
    u = _urls(spark, sf_dir)
    g = u.groupingSets([["host"], ["scheme"], []], "host", "scheme").agg(F.grouping("host").alias("gh"), F.grouping("scheme").alias("gs"), F.count("*").alias("urls"), F.countDistinct("url").alias("distinct_urls"), F.sum(F.octet_length("url").cast("long")).alias("bytes"))
    return g.select(F.when(F.col("gh") == 0, "domain").when(F.col("gs") == 0, "scheme").otherwise("total").alias("dimension"), F.coalesce("host", "scheme", F.lit("total")).alias("key"), "urls", "distinct_urls", "bytes")


@query(f"WITH u AS (SELECT page_id, {_URL} FROM pages), c AS (SELECT host, array_to_string(list_transform({_SEGMENTS}, lambda s: {ur.class_sql('s')}), '/') AS template FROM u) SELECT host, template, count(*) AS n FROM c GROUP BY ALL")
def url_endpoint_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).groupBy("host", ur.template(F.col("path")).alias("template")).agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages) SELECT page_id, count(*) AS lines, sum((NOT regexp_matches(lower(line), 'https?://|www[.]'))::INT)::BIGINT AS url_free FROM l GROUP BY 1")
def url_free_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("line"))
    return lines.groupBy("page_id").agg(F.count("*").alias("lines"), F.sum((~F.lower("line").rlike("https?://|www[.]")).cast("long")).alias("url_free"))


def _ranked_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in blocks of 32 consecutive ones of the order, as in rank_blocks."""
    d = ordering.running(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", {"n": F.lit(1)})
    return d.select("doc_id", "text", (F.col("n") - 1).alias("rank"), F.floor((F.col("n") - 1) / 32).alias("block"))


_GRAMS = (
    "b AS MATERIALIZED (SELECT doc_id, rank, rank // 32 AS block, regexp_extract_all(hex(encode(text)), '..') AS b FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents)), "
    "g AS MATERIALIZED (SELECT block, doc_id, kind, x0 || x1 AS ctx, x2 AS sym, count(*) AS n FROM (SELECT block, doc_id, kind, unnest(b[1:len(b) - 2]) AS x0, unnest(b[2:len(b) - 1]) AS x1, unnest(b[3:len(b)]) AS x2 FROM "
    "(SELECT block, doc_id, 'probe' AS kind, b[1:4096] AS b FROM b UNION ALL SELECT block, doc_id, 'tail', b[greatest(len(b) - 16383, 1):len(b)] FROM b)) GROUP BY ALL), "
)
# A key that comes m times after t times costs grown(t + m) - grown(t), whatever the order; pairs meet on the keys they share.
_EDGES = (
    f"WITH {_GRAMS} "
    "k AS MATERIALIZED (SELECT block, doc_id, kind, ctx || sym AS key, n, -1 AS sign FROM g UNION ALL SELECT block, doc_id, kind, ctx, sum(n)::BIGINT, 1 FROM g GROUP BY ALL), "
    "l AS MATERIALIZED (SELECT j, sum(CASE WHEN j = 0 THEN 0 ELSE log2(j - 1 + 128::DOUBLE) END) OVER (ORDER BY j) AS near, sum(CASE WHEN j = 0 THEN 0 ELSE log2(j - 0.5::DOUBLE) END) OVER (ORDER BY j) AS seen FROM range(32768) AS r(j)), "
    "v AS MATERIALIZED (SELECT k.*, CASE WHEN sign > 0 THEN near ELSE -seen END AS cost FROM k JOIN l ON j = n), "
    "base AS (SELECT block, doc_id AS target, sum(cost) AS bits FROM v WHERE kind = 'probe' GROUP BY ALL), "
    "change AS (SELECT s.doc_id AS source, p.doc_id AS target, sum(CASE WHEN p.sign > 0 THEN near ELSE -seen END - s.cost - p.cost) AS bits "
    "FROM v p JOIN v s ON s.block = p.block AND s.key = p.key AND s.doc_id <> p.doc_id JOIN l ON j = s.n + p.n WHERE p.kind = 'probe' AND s.kind = 'tail' GROUP BY ALL), "
    "edges AS (SELECT base.block, d.doc_id AS source, base.target, base.bits + coalesce(change.bits, 0) AS bits FROM base JOIN b d ON d.block = base.block AND d.doc_id <> base.target LEFT JOIN change ON change.source = d.doc_id AND change.target = base.target) "
)


@query(f"WITH {_GRAMS} o AS (SELECT 1) SELECT doc_id, ctx, sym, n FROM g WHERE kind = 'tail'")
def trigram_tail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return causal.grams(table(spark, sf_dir, "documents").select(F.lit(0).alias("block"), "doc_id", "text"), kept=("tail",)).select("doc_id", "ctx", "sym", "n")


@query(_EDGES + "SELECT source, target, round(bits, 5) AS bits FROM edges")
def trigram_edge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ordered pairs within blocks of 32 documents by rank."""
    return causal.edge_scores(_ranked_blocks(spark, sf_dir)).select("source", "target", _round("bits", 5).alias("bits"))


@query(_EDGES + ", o AS (SELECT block, doc_id AS source, lead(doc_id) OVER (PARTITION BY block ORDER BY rank) AS target FROM b) "
       "SELECT o.block, round(sum(coalesce(bits, 0)), 4) AS bits FROM o LEFT JOIN edges USING (source, target) GROUP BY o.block")
def block_path_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _ranked_blocks(spark, sf_dir)
    return causal.path_scores(d.select("block", "doc_id", "rank"), causal.edge_scores(d)).select("block", _round("bits", 4).alias("bits"))


@query()
def block_optimise(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    d = _ranked_blocks(spark, sf_dir)
    return causal.optimise(d.select("block", "doc_id", "rank"), causal.edge_scores(d))


@query("SELECT d::INT AS dim, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance FROM (SELECT generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def top_variance_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.dimensions(table(spark, sf_dir, "embeddings")).select(F.col("dim").cast("int").alias("dim"), _round("mean").alias("mean"), _round("variance").alias("variance"))


@query(
    "WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT d, avg(x) AS m, var_pop(x) AS v FROM e GROUP BY d ORDER BY v DESC, d LIMIT 16), "
    "z AS (SELECT vec_id, d, v, (x - m) / sqrt(v) AS z FROM e JOIN s USING (d)) SELECT vec_id, round(sum(z * z), 4) AS norm2, round(max(z), 6) AS largest FROM (SELECT vec_id, z / sqrt(sum(z * z) OVER (PARTITION BY vec_id)) AS z FROM z) GROUP BY 1"
)
def feature_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = vectors.standardised(table(spark, sf_dir, "embeddings"), 16)
    return z.select("vec_id", _round(F.aggregate("features", F.lit(0.0), lambda a, v: a + v * v), 4).alias("norm2"), _round(F.array_max("features")).alias("largest"))


def _losses(order: int, places: int = 4) -> str:
    """Closed form over counts: a key that comes n times costs a sum of n logarithms, in whatever order they fall."""
    parts = ", ".join(f"unnest(b[{j + 1}:len(b) - {order - j}]) AS x{j}" for j in range(order + 1))
    names = [f"x{j}" for j in range(order + 1)]
    cut = f"SELECT doc_id, {' || '.join(names[:-1]) or repr('')} AS ctx, {' || '.join(names)} AS gram FROM (SELECT doc_id, {parts} FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents))"
    return (
        f"WITH g AS MATERIALIZED (SELECT doc_id, ctx, gram, count(*) AS n FROM ({cut}) GROUP BY ALL), c AS MATERIALIZED (SELECT doc_id, ctx, sum(n)::BIGINT AS n FROM g GROUP BY ALL), "
        "l AS MATERIALIZED (SELECT j AS n, sum(log2(j - 1 + 128::DOUBLE)) OVER (ORDER BY j) AS near, sum(log2(j - 0.5::DOUBLE)) OVER (ORDER BY j) AS seen FROM (SELECT unnest(range(1, (SELECT max(n) FROM c) + 1)) AS j)), "
        "x AS (SELECT doc_id, sum(c.n)::BIGINT AS bytes, sum(near) AS bits FROM c JOIN l USING (n) GROUP BY doc_id), y AS (SELECT doc_id, sum(seen) AS bits FROM g JOIN l USING (n) GROUP BY doc_id) "
        f"SELECT doc_id, coalesce(bytes, 0) AS bytes, round(coalesce(x.bits - y.bits, 0), {places}) AS bits FROM documents LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)"
    )


@query(_losses(0))
def surprisal_order0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideal bits of each document under an adaptive byte model; a closed form over its histogram, no row for each byte."""
    ship(spark)
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), _round(tx.order0_bits("text"), 4).alias("bits"))


_CELLS = (
    "SELECT (l_orderkey % 8)::INT AS split, least(15, floor(l_quantity / 4))::INT AS confidence, least(15, floor(l_discount * 100))::INT AS disagreement, k::INT AS scale, count(*) AS n, "
    "sum(-log2(greatest(1 / 65536::DOUBLE, least(65535 / 65536::DOUBLE, 1 / (1 + exp(-(0.75::DOUBLE + 0.125::DOUBLE * k) * (l_quantity / 10 - 2))))))) AS bits FROM lineitem, range(5) AS t(k) GROUP BY ALL"
)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 8).cast("int").alias("split"), F.least(F.lit(15), F.floor(F.col("l_quantity") / 4)).cast("int").alias("confidence"), F.least(F.lit(15), F.floor(F.col("l_discount") * 100)).cast("int").alias("disagreement"), (F.col("l_quantity") / 10 - 2).alias("logit"))
    rows = li.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("scale"))
    p = 1 / (1 + F.exp(-(F.lit(0.75) + F.lit(0.125) * F.col("scale")) * F.col("logit")))
    loss = -F.log2(F.greatest(F.lit(1 / 65536), F.least(F.lit(65535 / 65536), p)))
    return rows.groupBy("split", "confidence", "disagreement", "scale").agg(F.count("*").alias("n"), F.sum(loss).alias("bits"))


@query(f"SELECT split, confidence, disagreement, scale, n, round(bits, 4) AS bits FROM ({_CELLS})")
def control_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counterfactual losses by split, confidence, disagreement and scale of the logit."""
    return _cells(spark, sf_dir).withColumn("bits", _round("bits", 4))


_GAINS = (
    f"WITH c AS ({_CELLS}), g AS (SELECT confidence, disagreement, c.scale, sum(CASE WHEN c.split < 5 THEN b.n ELSE 0 END)::BIGINT AS support, sum(CASE WHEN c.split < 5 THEN b.bits - c.bits ELSE 0 END) AS train, "
    "sum(CASE WHEN c.split = 5 THEN b.bits - c.bits ELSE 0 END) AS tune, sum(CASE WHEN c.split = 6 THEN b.bits - c.bits ELSE 0 END) AS valid FROM c JOIN (SELECT * FROM c WHERE scale = 2) b USING (split, confidence, disagreement) WHERE c.scale <> 2 GROUP BY confidence, disagreement, c.scale), "
    "best AS (SELECT *, row_number() OVER (PARTITION BY confidence, disagreement ORDER BY train DESC, scale DESC) AS k FROM g) "
)


@query(_GAINS + "SELECT confidence, disagreement, scale, support, round(train, 3) AS train, round(valid, 3) AS valid FROM best WHERE k = 1 AND support >= 30 AND train > 1 AND tune > 0 AND valid > 0 ORDER BY valid DESC LIMIT 32")
def rule_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules: cells whose best scale gains on training, tuning and validation splits; a support of 30 and a gain of 1 fit the table's size."""
    kept = control.compile_rules(_cells(spark, sf_dir), support=30, gain=1.0)
    return kept.select("confidence", "disagreement", "scale", "support", _round("train", 3).alias("train"), _round("valid", 3).alias("valid"))


@query(
    "WITH a AS (SELECT l_shipdate::DATE AS key, sum(l_quantity) AS bits, count(*) AS bytes FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1), b AS (SELECT l_shipdate::DATE AS key, sum(l_quantity) AS bits, count(*) AS bytes FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1) "
    "SELECT strftime(key, '%Y-%m-%d') AS key, least(a.bytes, b.bytes) AS bytes, round(a.bits - b.bits, 4) AS gain FROM a JOIN b USING (key)"
)
def trace_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two traces by key: what is in one alone has no common bytes and drops out."""
    li = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("key"), "l_quantity", (F.col("l_linenumber") % 2).alias("half"))
    g = li.groupBy("key").agg(*[f for h, s in ((0, "a"), (1, "b")) for f in (F.sum(F.when(F.col("half") == h, F.col("l_quantity"))).alias(f"bits_{s}"), F.count(F.when(F.col("half") == h, 1)).alias(f"bytes_{s}"))])
    return g.where("bytes_a > 0 AND bytes_b > 0").select(F.date_format("key", "yyyy-MM-dd").alias("key"), F.least("bytes_a", "bytes_b").alias("bytes"), _round(F.col("bits_a") - F.col("bits_b"), 4).alias("gain"))


@query("SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_match FROM conversations")
def match_last_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest earlier position of the same context."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("turn").over(Window.partitionBy("conv_id", "role").orderBy("turn")).alias("last_match"))


_RUN_LIST = f"list_transform(regexp_extract_all({{c}}, '{tx.runs_pattern()}'), lambda r: CASE WHEN length(r) > 2 OR NOT contains('{{m}}', r[1]) THEN r WHEN length(r) = 1 THEN r || r ELSE r[1] END)"
_TOGGLED = "array_to_string(" + _RUN_LIST.replace("{c}", "html").replace("{m}", "{}[]&") + ", '')"


@query(f"SELECT page_id, strlen({_TOGGLED}) AS toggled_bytes, md5({_TOGGLED}) AS toggled_md5, md5(html) AS restored_md5 FROM pages")
def bracket_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one or two brackets swapped, and swapped back."""
    pages = table(spark, sf_dir, "pages").select("page_id", tx.toggle_runs(F.col("html")).alias("t"))
    return pages.select("page_id", F.octet_length("t").cast("long").alias("toggled_bytes"), F.md5("t").alias("toggled_md5"), F.md5(tx.toggle_runs(F.col("t"))).alias("restored_md5"))


def _order_bits(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    """Whole texts in, ten sums out: no row for a byte and no shuffle."""
    ship(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tx.class_sums(order)("text").alias("s"))
    return docs.select("doc_id", F.slice("s", 1, 5).alias("n"), F.slice("s", 6, 5).alias("b"))


def _total(c: str):
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


@query(_losses(1))
def surprisal_order1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_bits(spark, sf_dir, 1).select("doc_id", _total("n").cast("long").alias("bytes"), _round(_total("b"), 4).alias("bits"))


@query(_losses(2))
def surprisal_order2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_bits(spark, sf_dir, 2).select("doc_id", _total("n").cast("long").alias("bytes"), _round(_total("b"), 4).alias("bits"))


@query(
    "WITH r AS (SELECT doc_id, unnest(range(1, len(b) - 1)) AS i, unnest(b[1:len(b) - 2]) AS x0, unnest(b[2:len(b) - 1]) AS x1, unnest(b[3:len(b)]) AS x2 FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents)), "
    "l AS (SELECT x2, log2(row_number() OVER (PARTITION BY doc_id, x0, x1 ORDER BY i) - 1 + 128::DOUBLE) - log2(row_number() OVER (PARTITION BY doc_id, x0, x1, x2 ORDER BY i) - 0.5::DOUBLE) AS bits FROM r), "
    "c AS (SELECT CASE WHEN x2 >= '80' THEN 'high' WHEN x2 BETWEEN '30' AND '39' THEN 'digit' WHEN x2 BETWEEN '41' AND '5A' OR x2 BETWEEN '61' AND '7A' THEN 'letter' WHEN x2 IN ('20', '09', '0A', '0D') THEN 'space' ELSE 'punctuation' END AS class, count(*) AS n, sum(bits) AS bits FROM l GROUP BY x2) "
    "SELECT class, sum(n)::BIGINT AS events, round(sum(bits), 2) AS bits, round(sum(bits) / sum(n), 6) AS bits_per_event FROM c GROUP BY class"
)
def surprisal_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses under an adaptive order-2 byte model by class of byte."""
    each = _order_bits(spark, sf_dir, 2).select(F.posexplode(F.arrays_zip("n", "b")).alias("c", "v")).groupBy("c").agg(F.sum("v.n").cast("long").alias("events"), F.sum("v.b").alias("bits"))
    name = F.element_at(F.array(*[F.lit(c) for c in tx.CLASSES]), F.col("c") + 1)
    return each.where("events > 0").select(name.alias("class"), "events", _round("bits", 2).alias("bits"), _round(F.col("bits") / F.col("events")).alias("bits_per_event"))


_ALPHAS = (-0.5, -0.25, 0.0, 0.125, 0.25, 0.5, 1.0)


@query(
    "WITH a AS (SELECT l_orderkey AS k, l_linenumber AS j, l_linenumber % 2 = 1 AS hit, l_returnflag AS r, l_linestatus AS t, l_quantity::DOUBLE / 10 - 2 AS base FROM lineitem), "
    "b AS (SELECT l_orderkey AS k, l_linenumber AS j, l_discount::DOUBLE * 20 - 1 AS more FROM lineitem), "
    "s AS (SELECT hit, base, more, unnest(CASE WHEN r = 'N' THEN ['active', 'continued'] ELSE ['active', 'ended', 'ended_' || t] END) AS category FROM a JOIN b USING (k, j)) "
    f"SELECT category, alpha, count(*) AS n, round(sum(log2(1 + exp(CASE WHEN hit THEN -1 ELSE 1 END * (base + alpha * more)))), 3) AS bits FROM s, (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in _ALPHAS)}]) AS alpha) GROUP BY ALL"
)
def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two traces by key, their logits blended by each weight: losses by overlapping categories."""
    li = table(spark, sf_dir, "lineitem")
    key = [F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j")]
    ended = F.array(F.lit("active"), F.lit("ended"), F.concat(F.lit("ended_"), F.col("l_linestatus")))
    a = li.select(*key, F.when(F.col("l_linenumber") % 2 == 1, -1.0).otherwise(1.0).alias("sign"), F.when(F.col("l_returnflag") == "N", F.array(F.lit("active"), F.lit("continued"))).otherwise(ended).alias("cs"), (F.col("l_quantity").cast("double") / 10 - 2).alias("base"))
    b = li.select(*key, (F.col("l_discount").cast("double") * 20 - 1).alias("more"))
    loss = lambda w: F.sum(F.log2(1 + F.exp(F.col("sign") * (F.col("base") + w * F.col("more")))))
    wide = a.join(b, ["k", "j"]).select("sign", "base", "more", F.explode("cs").alias("category")).groupBy("category").agg(F.count("*").alias("n"), F.array(*[loss(w) for w in _ALPHAS]).alias("sums"))
    return wide.select("category", "n", F.posexplode("sums").alias("i", "s")).select("category", F.element_at(F.array(*[F.lit(w) for w in _ALPHAS]), F.col("i") + 1).alias("alpha"), "n", _round("s", 3).alias("bits"))


@query(f"SELECT shape, n, row_number() OVER (ORDER BY n DESC, first, shape) AS place FROM (SELECT regexp_replace(x, '[0-9]', 'D', 'g') AS shape, count(*) AS n, min(page_id) AS first FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_SEQUENCE}')) AS x FROM pages) GROUP BY 1) QUALIFY place <= 50")
def numeric_shape_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most frequent shapes, ties by the first page that holds them (the limit is the feature)."""
    shapes = _found(table(spark, sf_dir, "pages"), "html", _SEQUENCE, "page_id").groupBy(tx.digit_shape(F.col("x")).alias("shape")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    top = shapes.orderBy(F.desc("n"), "first", "shape").limit(50)
    return top.select("shape", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first", "shape")).cast("long").alias("place"))


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS shared, (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)) AS either, "
       "(SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS unlabelled, (SELECT count(doc_id) = count(DISTINCT doc_id) FROM documents) AS ids_distinct")
def id_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that two tables share, that either has, that the second lacks; one shuffle of ids for all."""
    ids = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("d"), F.lit(0).alias("l")).unionByName(table(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("d"), F.lit(1).alias("l")))
    each = ids.groupBy("doc_id").agg(F.sum("d").alias("d"), F.sum("l").alias("l"))
    count = lambda c: F.count(F.when(c, 1))
    return each.agg(count((F.col("d") > 0) & (F.col("l") > 0)).alias("shared"), F.count("*").alias("either"), count((F.col("d") > 0) & (F.col("l") == 0)).alias("unlabelled"),
                    (F.coalesce(F.max(F.when(F.col("doc_id").isNotNull(), F.col("d"))), F.lit(0)) <= 1).alias("ids_distinct"))


_LETTERS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM "


@query(
    f"WITH d AS MATERIALIZED ({_LETTERS} benchmark), w AS MATERIALIZED ({_LETTERS} documents), x AS (SELECT word FROM w ANTI JOIN d USING (word)), "
    "cut AS MATERIALIZED (SELECT word, n, 1 AS tail, right(word, n) AS part FROM (SELECT word, unnest(range(7, length(word))) AS n FROM x) UNION ALL SELECT word, n, 0, left(word, n) FROM (SELECT word, unnest(range(7, length(word))) AS n FROM x)), "
    "b AS (SELECT word, max_by(part, tail * 1000000 + n) AS part, max(tail) AS tail FROM cut SEMI JOIN (SELECT word AS part FROM d) USING (part) GROUP BY word) "
    "SELECT w.word, CASE WHEN d.word IS NOT NULL THEN 'whole' WHEN b.tail = 1 THEN 'suffix' WHEN b.tail = 0 THEN 'prefix' ELSE 'none' END AS kind, coalesce(d.word, b.part) AS known FROM w LEFT JOIN d USING (word) LEFT JOIN b USING (word)"
)
def prefix_suffix_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in a dictionary, else their longest known suffix of 7 or more letters, else prefix."""
    words = lambda t: table(spark, sf_dir, t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    known, w = words("benchmark"), words("documents")
    lengths = F.explode(F.sequence(F.lit(7), F.length("word") - 1)).alias("n")
    cut = w.join(known, "word", "left_anti").where(F.length("word") > 7).select("word", lengths)
    parts = cut.select("word", "n", F.lit(1).alias("tail"), F.expr("right(word, n)").alias("part")).unionByName(cut.select("word", "n", F.lit(0).alias("tail"), F.expr("left(word, n)").alias("part")))
    best = parts.join(known.withColumnRenamed("word", "part"), "part", "left_semi").groupBy("word").agg(F.max(F.struct("tail", "n", "part")).alias("best"))
    rows = w.join(known.withColumn("whole", F.lit(True)), "word", "left").join(best, "word", "left")
    kind = F.when(F.col("whole"), "whole").when(F.col("best.tail") == 1, "suffix").when(F.col("best.tail") == 0, "prefix").otherwise("none")
    return rows.select("word", kind.alias("kind"), F.when(F.col("whole"), F.col("word")).otherwise(F.col("best.part")).alias("known"))
