"""Dumps, blocks, dictionaries, traces and archives written and read again; URL roles and keys; counters and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import roles
from ..functions import text as tx
from ..functions import urls as ur
from ..operators import ordering
from ..runtime import scratch_path, ship, table
from ..sources import dumps, tables
from .catalogue import _SEGMENTS, _URL, _losses, word_dictionary
from .registry import query

_PAGE = "'    <title>' || source || '</title>' || chr(10) || '    <id>' || doc_id || '</id>' || chr(10) || '      <text xml:space=\"preserve\">' || text || '</text>' || chr(10)"


def _raw():
    n = F.lit("\n")
    return F.concat(F.lit("    <title>"), "source", F.lit("</title>\n    <id>"), F.col("doc_id").cast("string"), F.lit(f"</id>\n      {dumps.TEXT_OPEN}"), "text", F.lit(dumps.TEXT_CLOSE), n)


@query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS page_index, source AS title, doc_id AS page_id, md5(text) AS text_md5, md5({_PAGE}) AS page_md5 FROM documents")
def dump_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of pages in an order, written as text files and read page by page, byte for byte."""
    path = scratch_path(spark, "dump")
    dumps.write_corpus(table(spark, sf_dir, "documents").select("doc_id", _raw().alias("raw")), "doc_id", path)
    p = dumps.read_pages(spark, path, strict=True)
    raw = F.col("raw")
    return p.select("page_index", dumps.title(raw).alias("title"), dumps.page_id(raw).alias("page_id"), F.md5(dumps.text(raw)).alias("text_md5"), F.md5(raw).alias("page_md5"))


@query(f"SELECT doc_id, e - n AS stream_begin, e AS stream_end FROM (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id)::BIGINT AS e FROM (SELECT doc_id, strlen({_PAGE}) + {len(dumps.PAGE_OPEN) + len(dumps.PAGE_CLOSE)} AS n FROM documents))")
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each page of a dump begins and ends, its bounding lines included."""
    return dumps.manifest(table(spark, sf_dir, "documents").select("doc_id", _raw().alias("raw")), "doc_id")


@query("SELECT vec_id AS id, len(embedding) + 2 AS features, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def block_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feature blocks written tab-separated with nine digits, read, checked, and aligned by id."""
    e = table(spark, sf_dir, "embeddings")
    paths = [scratch_path(spark, "block") for _ in range(2)]
    tables.write_block(e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features")), paths[0])
    tables.write_block(e.select((F.col("vec_id") + 1).alias("id"), F.array(F.lit(0.0), F.lit(0.0)).alias("features")), paths[1])
    both = tables.align([tables.read_block(spark, paths[0]), tables.read_block(spark, paths[1], offset=-1)])
    return both.select("id", F.size("features").cast("long").alias("features"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS idx FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word)")
def dictionary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of one word a line in order of rank, and the ranks read from the lines' places."""
    path = scratch_path(spark, "dictionary")
    word_dictionary(spark, sf_dir).select("idx", "word").repartitionByRange("idx").sortWithinPartitions("idx").select(F.col("word").alias("value")).write.text(path)
    lines = spark.read.text(path).where(F.col("value").rlike("^[a-z]+$")).select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"), "value")
    return ordering.running(lines, "at", {"n": F.lit(1)}).select(F.col("value").alias("word"), (F.col("n") - 1).alias("idx"))


@query("SELECT l_orderkey AS byte_pos, (l_quantity * 100)::INT AS final_p, (l_linenumber * 7)::INT AS boundary_p, (l_linenumber % 8)::INT AS bit_index, (l_linenumber % 2)::INT AS bit, 1::INT AS event, (l_suppkey % 9)::INT AS terminator FROM lineitem WHERE l_orderkey >= 500")
def probability_trace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary probability traces written by each task and read again, without a warm-up (the cut is the feature)."""
    ship(spark)
    magic, path = b"QSTRACE\0", scratch_path(spark, "bit-trace")
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS byte_pos", "int(l_quantity * 100) AS final_p", "int(l_linenumber * 7) AS boundary_p", "int(l_linenumber % 8) AS bit_index", "int(l_linenumber % 2) AS bit", "1 AS event", "int(l_suppkey % 9) AS terminator")
    tables.write_trace(rows, path, magic)
    return tables.read_trace(spark, path, magic, warmup=500)


@query("SELECT doc_id, strlen(text) AS size, (SELECT count(DISTINCT x) FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS x)) AS vocabulary, md5(text) AS restored_md5 FROM documents")
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives with a header (size, a flag for each byte value that occurs) before the stored text, and read again."""
    ship(spark)
    flags = F.array_join(F.transform(tx.byte_histogram("text"), lambda n: F.when(n > 0, "1").otherwise("0")), "")
    raw = F.encode("text", "UTF-8")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.encode(F.format_string("%016x", F.length(raw).cast("long")), "UTF-8"), F.encode(flags, "UTF-8"), raw).alias("a"))
    head = F.decode(F.substring("a", 1, 272), "UTF-8")
    size = F.conv(F.substring(head, 1, 16), 16, 10).cast("long")
    used = F.length(F.replace(F.substring(head, 17, 256), F.lit("0"), F.lit(""))).cast("long")
    return d.select("doc_id", size.alias("size"), used.alias("vocabulary"), F.md5(F.substring(F.col("a"), F.lit(273), size.cast("int"))).alias("restored_md5"))


_PIECES = "SELECT regexp_extract(url, '^([a-z]+://)', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract_all(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/[^/]*') AS segments, regexp_extract_all(regexp_extract(url, '(\\?[^#]*)', 1), '[?&][^&]*') AS pairs, regexp_extract(url, '(#.*)$', 1) AS fragment FROM pages"


@query(
    f"WITH p AS ({_PIECES}), r AS (SELECT 'scheme' AS role, strlen(scheme) AS n FROM p UNION ALL SELECT 'domain', strlen(host) FROM p UNION ALL SELECT 'fragment', strlen(fragment) FROM p "
    "UNION ALL SELECT 'path_segment', strlen(string_split(s, '.')[1]) FROM (SELECT unnest(segments) AS s FROM p) UNION ALL SELECT 'extension', strlen(s) - strlen(string_split(s, '.')[1]) FROM (SELECT unnest(segments) AS s FROM p) "
    "UNION ALL SELECT 'query_key', strlen(string_split(s, '=')[1]) FROM (SELECT unnest(pairs) AS s FROM p) UNION ALL SELECT 'query_value', strlen(s) - strlen(string_split(s, '=')[1]) FROM (SELECT unnest(pairs) AS s FROM p)) "
    f"SELECT role, sum(n)::BIGINT AS bytes, role IN {roles.CORRECTED} AS corrected FROM r GROUP BY role HAVING sum(n) > 0"
)
def url_byte_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of URLs by the part that they belong to."""
    ship(spark)
    sums = F.udf(roles.role_sums, "array<struct<role:string,n:long>>", useArrow=True)
    r = table(spark, sf_dir, "pages").select(F.explode(sums("url")).alias("r")).groupBy("r.role").agg(F.sum("r.n").alias("bytes"))
    return r.withColumn("corrected", F.col("role").isin(*roles.CORRECTED))


@query(
    f"WITH u AS (SELECT page_id, {_URL} FROM pages), t AS (SELECT *, array_to_string(list_transform({_SEGMENTS}, lambda s: {ur.class_sql('s')}), '/') AS template FROM u) "
    "SELECT page_id, left(md5(host), 16) AS domain_key, left(md5(path), 16) AS path_key, left(md5(template), 16) AS template_key, left(md5(host || '/' || template), 16) AS endpoint_key, left(md5(regexp_extract(query, '([^=&]*)=?[^&]*$', 1)), 16) AS query_key FROM t"
)
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of URLs: domain, path, path template, endpoint and last query key, as 64-bit hex keys."""
    u = F.col("url")
    host, path, template = ur.host(u), ur.path(u), ur.template(ur.path(u))
    key = lambda c: F.substring(F.md5(c), 1, 16)
    return table(spark, sf_dir, "pages").select("page_id", key(host).alias("domain_key"), key(path).alias("path_key"), key(template).alias("template_key"), key(F.concat(host, F.lit("/"), template)).alias("endpoint_key"),
                                                key(F.regexp_extract(ur.query(u), "([^=&]*)=?[^&]*$", 1)).alias("query_key"))


@query("WITH h AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents) GROUP BY ALL), s AS (SELECT doc_id, sum(n) AS t FROM h GROUP BY 1), b AS (SELECT doc_id, -sum(n * log2(n / t)) AS bits FROM h JOIN s USING (doc_id) GROUP BY doc_id) SELECT doc_id, round(coalesce(bits, 0), 4) + 0 AS bits FROM documents LEFT JOIN b USING (doc_id)")
def bitwise_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of each document's bytes as eight decisions a byte: as many as for whole bytes."""
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", (F.round(roles.bits_by_halves("text"), 4) + F.lit(0.0)).alias("bits"))


@query(
    "WITH e AS (SELECT user_id, event_id, (event_type = 'click')::INT AS bit, row_number() OVER w - 1 AS n, coalesce(sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, n, round((0.25::DOUBLE + seen) / (n + 0.5), 6) AS p, round(-log2(CASE WHEN bit = 1 THEN (0.25::DOUBLE + seen) / (n + 0.5) ELSE 1 - (0.25::DOUBLE + seen) / (n + 0.5) END), 6) AS bits FROM e"
)
def adaptive_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities that move by 1 / (n + 1.5) of their error with each event of a user; in closed form a running mean."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "click").cast("long").alias("bit"))
    e = e.withColumn("n", F.row_number().over(w).cast("long") - 1).withColumn("seen", F.sum("bit").over(w) - F.col("bit"))
    p = (F.lit(0.25) + F.col("seen")) / (F.col("n") + 0.5)
    return e.select("event_id", "n", F.round(p, 6).alias("p"), F.round(-F.log2(F.when(F.col("bit") == 1, p).otherwise(1 - p)), 6).alias("bits"))


@query(
    "WITH e AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events) "
    "SELECT event_id, least(99, row_number() OVER (PARTITION BY user_id, event_type, island ORDER BY ts, event_id)) AS run FROM e"
)
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the run of equal events of a user is by now, up to 99."""
    order = ("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    island = F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(*order))
    run = F.row_number().over(Window.partitionBy("user_id", "event_type", "island").orderBy(*order))
    return e.withColumn("island", island).select("event_id", F.least(F.lit(99), run).cast("long").alias("run"))


@query("SELECT CASE WHEN line = '' THEN 'empty' WHEN regexp_matches(line, '^[A-Za-z]') THEN 'letter' WHEN regexp_matches(line, '^[0-9]') THEN 'digit' WHEN starts_with(line, '<') THEN 'markup' WHEN regexp_matches(line, '^[ \\t]') THEN 'space' ELSE 'other' END AS first, count(*) AS n, sum(length(line))::BIGINT AS chars FROM (SELECT unnest(string_split(html, chr(10))) AS line FROM pages) GROUP BY 1")
def line_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by what they begin with."""
    line = F.col("line")
    kind = F.when(line == "", "empty").when(line.rlike("^[A-Za-z]"), "letter").when(line.rlike("^[0-9]"), "digit").when(line.startswith("<"), "markup").when(line.rlike("^[ \t]"), "space").otherwise("other")
    lines = table(spark, sf_dir, "pages").select(F.explode(F.split("html", "\n")).alias("line"))
    return lines.groupBy(kind.alias("first")).agg(F.count("*").alias("n"), F.sum(F.length("line").cast("long")).alias("chars"))


_VARIANTS = ("O0", "O1", "O2")


@query(
    "WITH " + ", ".join(f"v{k} AS (SELECT '{n}' AS variant, sum(bits) AS bits, sum(bytes)::BIGINT AS bytes FROM ({_losses(k, 12)}))" for k, n in enumerate(_VARIANTS))
    + ", a AS (" + " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(3)) + ") SELECT variant, bytes, round(bits, 1) AS bits, round(bits / bytes, 5) AS rate, round(bits / bytes - (SELECT bits / bytes FROM v0), 5) AS delta FROM a"
)
def ablation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of the corpus under each variant of a model, and against the first."""
    ship(spark)
    d = table(spark, sf_dir, "documents")
    sums = lambda c, a, b: F.aggregate(F.slice(c, a, b), F.lit(0.0), lambda s, x: s + x)
    each = d.select(F.octet_length("text").alias("n0"), tx.order0_bits("text").alias("b0"), *[tx.class_sums(k)("text").alias(f"s{k}") for k in (1, 2)])
    totals = each.agg(F.sum("n0").cast("double").alias("n0"), F.sum("b0").alias("b0"), *[f for k in (1, 2) for f in (F.sum(sums(f"s{k}", 1, 5)).alias(f"n{k}"), F.sum(sums(f"s{k}", 6, 5)).alias(f"b{k}"))])
    rows = totals.select(F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"n{k}").alias("n"), F.col(f"b{k}").alias("b")) for k, v in enumerate(_VARIANTS)])).alias("x"), (F.col("b0") / F.col("n0")).alias("base"))
    rate = F.col("x.b") / F.col("x.n")
    return rows.select("x.variant", F.col("x.n").cast("long").alias("bytes"), F.round("x.b", 1).alias("bits"), F.round(rate, 5).alias("rate"), F.round(rate - F.col("base"), 5).alias("delta"))


_RATES = "SELECT l_returnflag AS region, l_linestatus AS terminator, sum(l_extendedprice) FILTER (l_linenumber % 2 = {k}) / count(*) FILTER (l_linenumber % 2 = {k}) AS r FROM lineitem GROUP BY ALL"


@query(f"WITH a AS ({_RATES.format(k=0)}), b AS ({_RATES.format(k=1)}) SELECT region, terminator, round(a.r, 3) AS baseline_rate, round(b.r, 3) AS variant_rate, round(b.r - a.r, 3) AS delta FROM a JOIN b USING (region, terminator)")
def rate_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss rates of two variants by region and terminator; regions that only one has drop out."""
    half = F.col("l_linenumber") % 2
    rate = lambda k: F.sum(F.when(half == k, F.col("l_extendedprice"))) / F.count(F.when(half == k, 1))
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("region"), F.col("l_linestatus").alias("terminator")).agg(rate(0).alias("a"), rate(1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return r.select("region", "terminator", F.round("a", 3).alias("baseline_rate"), F.round("b", 3).alias("variant_rate"), F.round(F.col("b") - F.col("a"), 3).alias("delta"))


_TOKENS = "SELECT regexp_extract(x, '^[^0-9]', 0) AS before, regexp_extract(x, '[0-9]+', 0) AS run, regexp_extract(x, '[^0-9]$', 0) AS after FROM (SELECT unnest(regexp_extract_all(html, '[^0-9]?[0-9]+[^0-9]?')) AS x FROM pages)"
_KINDS = ("length(run)", "length(run) || before", "regexp_replace(run, '[0-9]', 'D', 'g') || before")


@query(
    f"WITH t AS MATERIALIZED ({_TOKENS}), " + ", ".join(
        f"c{k} AS (SELECT {g} AS g, after, count(*) AS n FROM t GROUP BY ALL), h{k} AS (SELECT -sum(n / (SELECT count(*) FROM t) * log2(n / s)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY g) AS s FROM c{k}))" for k, g in enumerate(_KINDS))
    + " SELECT round((SELECT h FROM h0), 6) AS by_length, round((SELECT h FROM h1), 6) AS by_length_and_before, round((SELECT h FROM h2), 6) AS by_shape_and_before"
)
def numeric_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of what follows runs of digits, given their length, their length and what precedes them, their shape and that."""
    x = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("[^0-9]?[0-9]+[^0-9]?"), F.lit(0))).alias("x"))
    run, before = F.regexp_extract("x", "[0-9]+", 0), F.regexp_extract("x", "^[^0-9]", 0)
    t = x.select(run.alias("run"), before.alias("before"), F.regexp_extract("x", "[^0-9]$", 0).alias("after")).groupBy("run", "before", "after").agg(F.count("*").alias("n"))
    n = F.length("run").cast("string")
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), g.alias("g")) for k, g in enumerate((n, F.concat(n, "before"), F.concat(tx.digit_shape(F.col("run")), "before")))])
    c = t.select("n", "after", F.explode(kinds).alias("x")).groupBy("x.k", "x.g", "after").agg(F.sum("n").alias("n"))
    s = c.withColumn("s", F.sum("n").over(Window.partitionBy("k", "g")))
    h = s.groupBy("k").agg((F.sum(-F.col("n") * F.log2(F.col("n") / F.col("s"))) / F.sum("n")).alias("h"))
    return h.agg(*[F.round(F.max(F.when(F.col("k") == k, F.col("h"))), 6).alias(name) for k, name in enumerate(("by_length", "by_length_and_before", "by_shape_and_before"))])
