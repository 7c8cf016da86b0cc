"""Words, stems, word streams, codings and page streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coding, spans, stemming
from ..runtime import ship, spread, table
from ..sources import dumps
from .catalogue import word_dictionary
from .registry import query

# Word types that a paragraph's stream and the content stream leave out.
NOT_PARAGRAPH = ("Conjunction", "Article", "Male", "Female", "Number", "ConjunctiveAdverb")
NOT_CONTENT = (*NOT_PARAGRAPH, "Adposition", "AdverbOfManner")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, after_the, n: how often each word comes, and whether right after `the`; a text's words are counted in place."""
    d = spread(table(spark, sf_dir, "documents").select("text"))
    pairs = d.select(F.explode(stemming.word_counts(spark, F.lower("text").cast("binary"), marks=True)).alias("p"))
    return pairs.groupBy("p.word", "p.after_the").agg(F.sum("p.n").alias("n"))


def typed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, after_the, n, stem, types, code: a word after `the` is also a noun."""
    ship(spark)
    rows = words(spark, sf_dir).select("*", stemming.stems("word").alias("s")).select("word", "after_the", "n", "s.stem", F.when(F.col("after_the"), F.array_union("s.types", F.array(F.lit("Noun")))).otherwise(F.col("s.types")).alias("types"))
    code = F.coalesce(*[F.when(F.array_contains("types", t), c) for t, c in stemming.TYPE_CODES.items()], F.when(F.size("types") > 0, 14).otherwise(15))
    return rows.withColumn("code", code)


@query()
def stem_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word with its frequency, stem and type."""
    ship(spark)
    counted = words(spark, sf_dir).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.select("word", "n", stemming.stems("word").alias("s")).select("word", "n", "s.stem", F.array_join("s.types", " ").alias("types"), "s.code")


@query()
def word_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_words(spark, sf_dir).groupBy("code").agg(F.sum("n").alias("n"), F.countDistinct("stem").alias("stems"))


def _stream(spark: SparkSession, sf_dir: str, without: tuple, typed: bool) -> DataFrame:
    rows = typed_words(spark, sf_dir).where(~F.arrays_overlap("types", F.array(*map(F.lit, without))))
    return (rows.where(F.size("types") > 0) if typed else rows).groupBy("stem").agg(F.sum("n").alias("n"))


@query()
def paragraph_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of words that aren't of closed classes."""
    return _stream(spark, sf_dir, NOT_PARAGRAPH, False)


@query()
def content_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of typed words that carry content."""
    return _stream(spark, sf_dir, NOT_CONTENT, True)


def _in(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} IN ({', '.join(repr(w) for w in ws.split())}) THEN '{k}'" for k, ws in stemming.CLASSES.items()) + " END"


@query(f"SELECT kind, count(*) AS n, count(DISTINCT word) AS words FROM (SELECT word, {_in('word')} AS kind FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)) WHERE kind IS NOT NULL GROUP BY kind")
def closed_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the fixed lists, by list."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    kind = F.coalesce(*[F.when(F.col("word").isin(ws.split()), k) for k, ws in stemming.CLASSES.items()])
    return w.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("kind", "word").agg(F.count("*").alias("m")).groupBy("kind").agg(F.sum("m").alias("n"), F.count("*").alias("words"))


def dictionary(spark: SparkSession, sf_dir: str) -> list[str]:
    """The words that codes have room for, by rank: 44,880 at most, which is the code's own limit."""
    top = word_dictionary(spark, sf_dir).where(F.col("idx") < coding.THREE_BYTES).select("idx", "word")
    return [r.word for r in sorted(top.collect(), key=lambda r: r.idx)]


@query("SELECT doc_id, strlen(text) AS text_bytes, md5(text) AS restored_md5 FROM documents")
def dict_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts coded by the dictionary and restored."""
    known = dictionary(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", coding.words_coded(spark, F.col("text"), known).alias("c"))
    return d.select("doc_id", coding.words_restored(spark, F.col("c"), known).alias("t")).select("doc_id", F.octet_length("t").cast("long").alias("text_bytes"), F.md5("t").alias("restored_md5"))


@query()
def word_coding_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes before and after word coding; the code is kept if it saves 50 bytes or more."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("text_bytes"), F.length(coding.words_coded(spark, F.col("text"), dictionary(spark, sf_dir))).cast("long").alias("coded_bytes"))
    return d.withColumn("kept", F.col("coded_bytes") <= F.col("text_bytes") - 50)


@query("SELECT page_id, md5(html) AS restored_md5 FROM pages")
def entity_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities shortened and restored, raw ampersands included."""
    ship(spark)
    p = table(spark, sf_dir, "pages").select("page_id", coding.entities_shrunk(F.col("html")).alias("s"))
    return p.select("page_id", F.md5(coding.entities_grown(F.col("s"))).alias("restored_md5"))


_HEAD = "'    <title>' || doc_id || '</title>' || chr(10) || '    <id>' || doc_id || '</id>' || chr(10) || '      <text xml:space=\"preserve\">'"
_LINES = "text || repeat(chr(10) || 'x', 4) || chr(10)"
_TAIL = "CASE WHEN doc_id % 3 = 0 THEN '[[de:' || source || ']]' || chr(10) || '[[fr:' || lang || ']]' ELSE '' END"
_RECORD = f"SELECT doc_id, {_HEAD} AS h, {_LINES} AS b, {_TAIL} AS t FROM (SELECT doc_id, source, lang, replace(replace(text, '<', '&lt;'), '[[', '[') AS text FROM documents)"


@query(f"SELECT doc_id, length(h) AS header_chars, length(b) AS body_chars, md5(t) AS tail_md5, md5(h || b || t || '</text>' || chr(10)) AS page_md5 FROM ({_RECORD})")
def record_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages split into header, body and language tail, and joined again."""
    n = F.lit("\n")
    d = table(spark, sf_dir, "documents").withColumn("text", F.replace(F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit("[["), F.lit("[")))
    i = F.col("doc_id").cast("string")
    tail = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("[[de:"), "source", F.lit("]]\n[[fr:"), "lang", F.lit("]]"))).otherwise("")
    raw = F.concat(F.lit("    <title>"), i, F.lit("</title>\n    <id>"), i, F.lit(f"</id>\n      {dumps.TEXT_OPEN}"), "text", F.repeat(F.lit("\nx"), 4), n, tail, F.lit(dumps.TEXT_CLOSE), n)
    s = dumps.streams(d.select("doc_id", raw.alias("raw")))
    return s.select("doc_id", F.length("header").cast("long").alias("header_chars"), F.length("body").cast("long").alias("body_chars"), F.md5("tail").alias("tail_md5"), F.md5(dumps.joined()).alias("page_md5"))


@query("SELECT page_id, regexp_replace(url, '[0-9]', 'D', 'g') AS shape FROM pages")
def digit_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[0-9]", "D").alias("shape"))


_NUMBER = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"


@query(
    f"SELECT page_id, count(*) AS numbers, count(*) FILTER (contains(x, '.')) AS decimals, count(*) FILTER (contains(x, ',')) AS grouped, max(length(replace(x, ',', ''))) AS longest "
    f"FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_NUMBER}')) AS x FROM pages) GROUP BY 1"
)
def number_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with decimals and grouped thousands; a page's numbers stay together, so nothing is shuffled."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit(_NUMBER), F.lit(0)).alias("x")).where(F.size("x") > 0)
    count = lambda mark: F.size(F.filter("x", lambda v: v.contains(mark))).cast("long")
    return p.select("page_id", F.size("x").cast("long").alias("numbers"), count(".").alias("decimals"), count(",").alias("grouped"), F.array_max(F.transform("x", lambda v: F.length(F.replace(v, F.lit(","), F.lit(""))))).cast("long").alias("longest"))


@query(
    "SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(regexp_extract_all(text, '[.?!;:]+(?:[ \\n]|$)')) AS sentence_ends, len(regexp_extract_all(text, '\\n\\n+')) AS paragraph_breaks FROM documents"
)
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, ends of sentences and clauses, and paragraph breaks of each document."""
    size = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), size("[.?!;:]+(?:[ \n]|\\z)").alias("sentence_ends"), size("\n\n+").alias("paragraph_breaks"))


@query(
    "SELECT page_id, CASE WHEN contains(url, '#') THEN 'fragment' WHEN regexp_matches(url, '\\?(.*&)?[^=&]*=[^&]*$') THEN 'query_value' WHEN contains(url, '?') THEN 'query_key' "
    "WHEN regexp_matches(url, '://[^/]*/(.*/)?[^/]*[.][^/]*$') THEN 'extension' WHEN regexp_matches(url, '://[^/]*/') THEN 'path_segment' ELSE 'domain' END AS role, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM pages"
)
def url_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of a URL that stands last in running text."""
    ship(spark)
    p = table(spark, sf_dir, "pages").select("page_id", spans.url_states(F.concat(F.lit("see "), "url")).alias("s"))
    return p.select("page_id", "s.role", "s.host")


@query(f"SELECT segments, joiners, count(*) AS n FROM (SELECT len(regexp_extract_all(x, '[0-9]+')) AS segments, regexp_replace(x, '[0-9]+', '', 'g') AS joiners FROM (SELECT unnest(regexp_extract_all(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || ' ' || value || ' ' || props, '{spans.NUMBERS}')) AS x FROM events)) GROUP BY ALL")
def number_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most five joined numbers, with a time after a date, by what joins them."""
    raw = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col("value").cast("string"), "props")
    x = table(spark, sf_dir, "events").select(F.explode(F.regexp_extract_all(raw, F.lit(spans.NUMBERS), F.lit(0))).alias("x"))
    return x.groupBy(F.size(F.regexp_extract_all("x", F.lit("[0-9]+"), F.lit(0))).cast("long").alias("segments"), F.regexp_replace("x", "[0-9]+", "").alias("joiners")).agg(F.count("*").alias("n"))
