"""Byte classes, events, numbering, joins by position, probes, scalars, and what is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classes
from ..functions import text as tx
from ..operators import ordering
from ..runtime import scratch_path, ship, table
from .registry import query

_HEX = "regexp_extract_all(hex(encode(text)), '..')"
_LABELS = [(f"{b:02X}", *classes.labels(b)) for b in range(256)]


@query(
    f"WITH l(x, structural, coarse, label, terminator, url_symbol) AS (VALUES {', '.join(str(row) for row in _LABELS)}), h AS (SELECT x, count(*) AS n FROM (SELECT unnest({_HEX}) AS x FROM documents) GROUP BY x) "
    "SELECT structural, coarse, label, terminator, url_symbol, sum(n)::BIGINT AS n FROM h JOIN l USING (x) GROUP BY ALL"
)
def byte_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the corpus by all of their classes; histograms are summed, so 256 numbers a task are shuffled."""
    ship(spark)
    h = table(spark, sf_dir, "documents").select(F.posexplode(tx.byte_histogram("text")).alias("b", "n")).groupBy("b").agg(F.sum("n").alias("n")).where("n > 0")
    names = ("structural", "coarse", "label", "terminator", "url_symbol")
    known = [F.get(F.lit([row[k + 1] for row in _LABELS]), F.col("b")).alias(name) for k, name in enumerate(names)]
    return h.select(*known, "n").groupBy(*names).agg(F.sum("n").alias("n"))


_KIND = "CASE " + " ".join(f"WHEN x = '{b}' THEN '{t}'" for b, _, _, _, t, _ in _LABELS if t != "other") + " ELSE 'other' END"


@query(
    "WITH t AS (SELECT page_id % 2 AS half, hex(encode(right(m, 1))) AS x FROM (SELECT page_id, unnest(regexp_extract_all(html, '[0-9]+[\\x00-\\x2F\\x3A-\\x7F]')) AS m FROM pages)), "
    f"c AS (SELECT {_KIND} AS terminator, half, count(*) AS n FROM t GROUP BY ALL) "
    "SELECT terminator, sum(n)::BIGINT AS n, round(sum(n) / (SELECT sum(n) FROM c), 6) AS share FROM c GROUP BY terminator HAVING count(DISTINCT half) = 2"
)
def shared_terminators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of what ends runs of digits, as far as pages of even and of odd ids both have them."""
    m = table(spark, sf_dir, "pages").select((F.col("page_id") % 2).alias("half"), F.explode(F.regexp_extract_all("html", F.lit("[0-9]+[\\x00-\\x2F\\x3A-\\x7F]"), F.lit(0))).alias("m"))
    kind = F.get(F.lit([row[4] for row in _LABELS]), F.ascii(F.substring("m", -1, 1)))
    c = m.groupBy(kind.alias("terminator"), "half").agg(F.count("*").alias("n")).groupBy("terminator").agg(F.sum("n").alias("n"), F.count("*").alias("halves"))
    total = c.agg(F.sum("n").alias("all"))
    return c.where("halves = 2").crossJoin(F.broadcast(total)).select("terminator", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))  # one row of totals


@query()
def numeric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and dimensions of runs of digits over every byte of pages; counted in each text before any shuffle."""
    ship(spark)
    counts = F.udf(lambda t: [(k, v, n) for (k, v), n in classes.numeric_events(t or "").items()], "array<struct<dimension:string,key:string,n:long>>", useArrow=True)
    return table(spark, sf_dir, "pages").select(F.explode(counts("html")).alias("e")).groupBy("e.dimension", "e.key").agg(F.sum("e.n").alias("n"))


@query()
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of text and of other blocks of each document, and whether it counts as text as a whole."""
    ship(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", classes.block_sizes("text").alias("b"))
    inside, outside = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    return d.select("doc_id", inside.alias("text_bytes"), outside.alias("other_bytes"), F.get("b", F.lit(2)).alias("blocks"), (inside > F.lit(classes.MOST_TEXT) * (inside + outside)).alias("is_text"))


_PRINTABLE = "x BETWEEN '20' AND '7E' OR x BETWEEN '09' AND '0D'"


@query(f"SELECT doc_id, strlen(text) AS bytes, len(list_filter({_HEX}, lambda x: {_PRINTABLE})) AS ascii_bytes FROM documents")
def ascii_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), tx.byte_histogram("text").alias("h"))
    return d.select("doc_id", "bytes", (tx.slots(F.col("h"), 9, 13) + tx.slots(F.col("h"), 32, 126)).alias("ascii_bytes"))


# Phrases that mark census articles.
CENSUS = (
    "According to the [[United States Census Bureau]],", "According to the [[U.S. Census Bureau]],", "As of the [[2000]] census,", "According to the [[2000]] census, ",
    "According to the [[United States Census Bureau|U.S. Census Bureau]],", "According to the [[US Census Bureau]], ", "According to the U.S. Census,", "As of the 2000 ", "As of the census of 2000,",
)
_FLAGS = {
    "info": "regexp_matches(text, '\\{\\{[^}]*\\n[^}]*\\}\\}')", "image": "starts_with(title, 'Image:')", "disam": "contains(title, '(disambiguation)') OR regexp_matches(text, '\\{\\{[Dd]isam.*\\}\\}')",
    "hndis": "contains(text, '{{hndis')", "geo": "contains(text, '{{geodis}}')", "census": " OR ".join(f"contains(text, '{p}')" for p in CENSUS),
}
# The driver's documents hold no such marks, so marks by id are put in front.
_MARKED = "SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'Image:' ELSE '' END || source || CASE doc_id % 7 WHEN 2 THEN ' (disambiguation)' ELSE '' END AS title, CASE doc_id % 7 WHEN 3 THEN '{{box' || chr(10) || '| a}}' WHEN 4 THEN '{{Disambig}}' WHEN 5 THEN '{{hndis|x}}{{geodis}}' WHEN 6 THEN 'As of the census of 2000,' ELSE '' END || text AS text FROM documents"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat(CASE doc_id % 7 WHEN 1 THEN 'Image:' ELSE '' END, source, CASE doc_id % 7 WHEN 2 THEN ' (disambiguation)' ELSE '' END) AS title",
        "concat(CASE doc_id % 7 WHEN 3 THEN concat('{{box', chr(10), '| a}}') WHEN 4 THEN '{{Disambig}}' WHEN 5 THEN '{{hndis|x}}{{geodis}}' WHEN 6 THEN 'As of the census of 2000,' ELSE '' END, text) AS text")


def article_flags(df: DataFrame) -> DataFrame:
    """df (title, text) with flags: info box, image, disambiguation, name and place disambiguation, census."""
    t = F.col("text")
    census = t.contains(CENSUS[0])
    for phrase in CENSUS[1:]:
        census = census | t.contains(phrase)
    return df.select("*", t.rlike(r"\{\{[^}]*\n[^}]*\}\}").alias("info"), F.col("title").startswith("Image:").alias("image"), (F.col("title").contains("(disambiguation)") | t.rlike(r"\{\{[Dd]isam.*\}\}")).alias("disam"),
                     t.contains("{{hndis").alias("hndis"), t.contains("{{geodis}}").alias("geo"), census.alias("census"))


@query(f"SELECT doc_id, {', '.join(f'({c}) AS {n}' for n, c in _FLAGS.items())} FROM ({_MARKED})")
def doc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_flags(_marked(spark, sf_dir)).drop("title", "text")


@query(f"SELECT {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in _FLAGS.items())} FROM ({_MARKED})")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_flags(_marked(spark, sf_dir)).agg(*[F.count(F.when(F.col(n), 1)).alias(n) for n in _FLAGS])


@query(f"SELECT doc_id, left(title || chr(10) || regexp_replace(text, '\\{{\\{{[^}}]*\\n[^}}]*\\}}\\}}', '', 'g'), 4000) AS lead FROM ({_MARKED})")
def template_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and text without templates of several lines, as far as an embedding reads (4,000 characters are the feature)."""
    return _marked(spark, sf_dir).select("doc_id", F.substring(F.concat("title", F.lit("\n"), F.regexp_replace("text", r"\{\{[^}]*\n[^}]*\}\}", "")), 1, 4000).alias("lead"))


_STREAM = "SELECT doc_id, text, sum(strlen(text)) OVER (ORDER BY doc_id)::BIGINT AS e, sum(strlen(text)) OVER (ORDER BY doc_id)::BIGINT - strlen(text) AS b FROM documents"


@query(f"SELECT doc_id, greatest(b, 50000) AS slice_begin, least(e, 150000) AS slice_end, md5(substr(hex(encode(text)), 2 * greatest(50000 - b, 0) + 1, 2 * (least(e, 150000) - greatest(b, 50000)))) AS piece_md5 FROM ({_STREAM}) WHERE e > 50000 AND b < 150000")
def corpus_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100,000 bytes of the corpus from byte 50,000 on, document by document (the range is the feature)."""
    d = ordering.offsets(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", F.octet_length("text")).where("stream_end > 50000 AND stream_begin < 150000")
    low, high = F.greatest("stream_begin", F.lit(50000)), F.least("stream_end", F.lit(150000))
    piece = F.substring(F.encode("text", "UTF-8"), (low - F.col("stream_begin") + 1).cast("int"), (high - low).cast("int"))
    return d.select("doc_id", low.cast("long").alias("slice_begin"), high.cast("long").alias("slice_end"), F.md5(F.encode(F.hex(piece), "UTF-8")).alias("piece_md5"))


_SKELETON = ("  <page>\\n    <title>", "</title>\\n    <id>", "</id>\\n    <revision>\\n      <text xml:space=\"preserve\">", "</text>\\n    </revision>\\n  </page>\\n")


def _sql(s: str) -> str:
    return "'" + s.replace("\\n", "' || chr(10) || '") + "'"


@query(f"SELECT doc_id, least(strlen(text), 512) AS kept_bytes, md5(hex(encode({_sql(_SKELETON[0])} || source || {_sql(_SKELETON[1])} || doc_id || {_sql(_SKELETON[2])})) || left(hex(encode(text)), 1024) || hex(encode({_sql(_SKELETON[3])}))) AS page_md5 FROM documents")
def page_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages built anew around texts cut to 512 bytes (the cut is the feature)."""
    a, b, c, e = (F.encode(F.lit(s.replace("\\n", "\n")), "UTF-8") for s in _SKELETON)
    page = F.concat(a, F.encode("source", "UTF-8"), b, F.encode(F.col("doc_id").cast("string"), "UTF-8"), c, F.substring(F.encode("text", "UTF-8"), 1, 512), e)
    return table(spark, sf_dir, "documents").select("doc_id", F.least(F.octet_length("text"), F.lit(512)).cast("long").alias("kept_bytes"), F.md5(F.encode(F.hex(page), "UTF-8")).alias("page_md5"))


@query(
    "WITH l AS (SELECT page_id, string_split(html, chr(10)) AS lines FROM pages) SELECT page_id, md5(array_to_string(lines[1:2], chr(10))) AS intro_md5, md5(array_to_string(lines[3:len(lines) - 2], chr(10))) AS main_md5, "
    "md5(array_to_string(lines[greatest(3, len(lines) - 1):len(lines)], chr(10))) AS coda_md5 FROM l"
)
def three_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages split by line counts: two lines of intro, two of coda, and what is between."""
    p = table(spark, sf_dir, "pages").select("page_id", F.split("html", "\n").alias("l")).withColumn("n", F.size("l"))
    part = lambda a, b: F.md5(F.array_join(F.filter("l", lambda x, i: (i >= a) & (i < b)), "\n"))
    return p.select("page_id", part(F.lit(0), F.lit(2)).alias("intro_md5"), part(F.lit(2), F.col("n") - 2).alias("main_md5"), part(F.greatest(F.lit(2), F.col("n") - 2), F.col("n")).alias("coda_md5"))


@query("SELECT c_custkey, coalesce(max(o_orderkey), 0) AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def last_wins_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys mapped to the last row that has them; keys without one map to 0."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", F.coalesce("last", F.lit(0).cast("long")).alias("last_order"))


_SHIFT = "(32 + ('0x' || left(md5(doc_id || '{s}'), 7))::BIGINT % (n - 63))"


@query(
    "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents), "
    f"c AS (SELECT doc_id AS source, rank, (rank + {_SHIFT.format(s='a')}) % n AS t FROM r UNION SELECT doc_id, rank, (rank + {_SHIFT.format(s='b')}) % n FROM r) SELECT source, r.doc_id AS target FROM c JOIN r ON r.rank = t WHERE c.rank // 32 <> t // 32"
)
def control_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two targets at most for each document outside its block of 32, drawn by a hash of its id."""
    d = ordering.running(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", {"k": F.lit(1)}).withColumn("rank", F.col("k") - 1)
    n = F.lit(d.count())
    draw = lambda s: (F.col("rank") + 32 + F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(s)).cast("binary")), 1, 7), 16, 10).cast("long") % (n - 63)) % n
    drawn = d.select(F.col("doc_id").alias("source"), "rank", F.explode(F.array_distinct(F.array(draw("a"), draw("b")))).alias("t")).where(F.floor(F.col("rank") / 32) != F.floor(F.col("t") / 32))
    return drawn.join(d.select(F.col("rank").alias("t"), F.col("doc_id").alias("target")), "t").select("source", "target")


@query(f"SELECT p AS position, doc_id FROM (SELECT unnest(range(0, (SELECT sum(strlen(text))::BIGINT FROM documents), 997)) AS p) JOIN ({_STREAM}) ON p >= b AND p < e")
def position_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document holds each 997th byte of the corpus: a document lists its own positions, so no ranges are joined."""
    d = ordering.offsets(table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n")), "doc_id", F.col("n"))
    first, last = F.ceil(F.col("stream_begin") / 997), F.ceil(F.col("stream_end") / 997) - 1
    return d.where(first <= last).select(F.explode(F.sequence(first, last)).alias("k"), "doc_id").select((F.col("k") * 997).alias("position"), "doc_id")


@query(
    "WITH e AS (SELECT user_id, event_id, ts, event_type = 'click' AS active FROM events) SELECT event_id, sum(CASE WHEN active AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS instance "
    "FROM (SELECT *, coalesce(lag(active) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS before FROM e)"
)
def active_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of active events numbered by their rising edges, for each user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "click").alias("active"))
    rise = (F.col("active") & ~F.coalesce(F.lag("active").over(w), F.lit(False))).cast("long")
    return e.withColumn("rise", rise).select("event_id", F.sum("rise").over(w).alias("instance"))


@query(
    "WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS i FROM conversations), "
    "h AS (SELECT *, lag(word, 1) OVER o AS w1, lag(word, 2) OVER o AS w2, last_value(CASE WHEN length(word) > 7 THEN word END IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS long_before FROM w WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i)) "
    "SELECT word, coalesce(w1, '') AS w1, coalesce(w2, '') AS w2, coalesce(long_before, '') AS long_before, count(*) AS n FROM h GROUP BY ALL"
)
def word_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word with the two before it and the last long one; found inside the turn, so only counts are shuffled."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    at = lambda w, i: F.when(i >= 0, F.get(w, i)).otherwise("")
    longs = F.transform("w", lambda x: F.when(F.length(x) > 7, x))
    # the running last long word: one step of a fold appends the word or repeats the one before
    known = F.aggregate(longs, F.array(F.lit("")), lambda a, x: F.concat(a, F.array(F.coalesce(x, F.element_at(a, -1)))))
    rows = table(spark, sf_dir, "conversations").select(words.alias("w")).select("w", known.alias("known"))
    each = rows.select(F.explode(F.transform("w", lambda x, i: F.struct(x.alias("word"), at("w", i - 1).alias("w1"), at("w", i - 2).alias("w2"), F.get("known", i).alias("long_before")))).alias("x"))
    return each.groupBy("x.word", "x.w1", "x.w2", "x.long_before").agg(F.count("*").alias("n"))


@query(
    "WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS i FROM pages), "
    "p AS (SELECT page_id, line, lag(line) OVER (PARTITION BY page_id ORDER BY i) AS above FROM l), c AS (SELECT page_id, unnest(range(1, length(line) + 1)) AS k, line, above FROM p) "
    "SELECT page_id, count(*) AS chars, count(*) FILTER (k >= 99) AS far, count(*) FILTER (length(above) >= k) AS below, count(*) FILTER (length(above) >= k AND line[k] = above[k]) AS repeats FROM c GROUP BY page_id"
)
def column_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of pages by their column: those from column 99 on, those under another one, and those that repeat it."""
    p = table(spark, sf_dir, "pages").select("page_id", F.split("html", "\n").alias("l"))
    pair = F.transform("l", lambda x, i: F.struct(x.alias("line"), F.when(i > 0, F.get("l", i - 1)).otherwise("").alias("above")))
    same = lambda x, y: F.size(F.filter(F.arrays_zip(F.split(x, "").alias("a"), F.split(y, "").alias("b")), lambda z: z["a"] == z["b"]))
    rows = p.select("page_id", F.explode(pair).alias("x")).select("page_id", "x.line", "x.above").where(F.length("line") > 0)
    n, m = F.length("line").cast("long"), F.length("above").cast("long")
    return rows.groupBy("page_id").agg(F.sum(n).alias("chars"), F.sum(F.greatest(n - 98, F.lit(0).cast("long"))).alias("far"), F.sum(F.least(n, m)).alias("below"),
                                       F.sum(F.when(F.length("above") > 0, same(F.col("line"), F.col("above"))).otherwise(0).cast("long")).alias("repeats"))


@query("WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':923')) - 1 AS shuffled FROM documents) SELECT doc_id, shuffled, (SELECT count(*) FROM documents) - 1 - shuffled AS reversed, row_number() OVER (ORDER BY doc_id) - 1 AS restored FROM s")
def shuffle_reverse_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffle that a seed decides, its reverse, and the original order again."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":923")).cast("binary")).alias("m"), "doc_id").alias("o"))
    s = ordering.running(ordering.running(d, "o", {"s": F.lit(1)}), "doc_id", {"r": F.lit(1)})
    n = s.count()
    return s.select("doc_id", (F.col("s") - 1).alias("shuffled"), (F.lit(n) - F.col("s")).alias("reversed"), (F.col("r") - 1).alias("restored"))


@query(
    "WITH t AS (SELECT l_suppkey AS key, round(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE -l_quantity END), 2) AS delta FROM lineitem GROUP BY 1) "
    "SELECT key, delta, row_number() OVER (ORDER BY abs(delta) DESC, key) AS place FROM t QUALIFY place <= 8"
)
def largest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight keys whose sums differ most between two traces (the limit is the feature)."""
    q = F.col("l_quantity")
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.round(F.sum(F.when(F.col("l_linenumber") % 2 == 0, q).otherwise(-q)), 2).alias("delta"))
    top = t.orderBy(F.abs("delta").desc(), "key").limit(8)
    return top.select("key", "delta", F.row_number().over(Window.orderBy(F.abs("delta").desc(), "key")).cast("long").alias("place"))


@query("SELECT doc_id, length(text) AS points, " + ", ".join(f"len(list_filter({_HEX}, lambda x: x BETWEEN '{a}' AND '{b}')) AS {n}" for n, a, b in (("one", "00", "7F"), ("two", "C0", "DF"), ("three", "E0", "EF"), ("four", "F0", "FF"), ("rest", "80", "BF"))) + " FROM documents")
def utf8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points by how many bytes they take, and the bytes that continue one."""
    ship(spark)
    h = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("points"), tx.byte_histogram("text").alias("h"))
    return h.select("doc_id", "points", *[tx.slots(F.col("h"), a, b).alias(n) for n, a, b in (("one", 0, 127), ("two", 192, 223), ("three", 224, 239), ("four", 240, 255), ("rest", 128, 191))])


_P = "(0.02::DOUBLE + l_discount * 9)"
_X = "ln({p} / (1 - {p}))"


@query(
    f"SELECT l_orderkey, l_linenumber, round({_X.format(p=_P)}, 6) AS logit, floor(4096 / (1 + exp(-l_quantity / 10)))::BIGINT AS squashed, floor({_P} * 4095)::BIGINT AS p12, floor(1 + 65534 * {_P})::BIGINT AS p16, round(16 * log2(l_quantity + 1))::BIGINT AS ilog, "
    f"round(least(15, 2 * abs({_X.format(p=_P)})), 6) AS confidence, round(least(15, 32 * abs({_P} - l_tax)), 6) AS disagreement, round(1 / (1 + exp(-({_X.format(p=_P)} + 0.25 * (l_quantity / 10 - 2)))), 6) AS blended FROM lineitem"
)
def probability_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits, squashed and stretched values, probabilities in 12 and 16 bits, confidence and disagreement of predictions."""
    p = F.lit(0.02) + F.col("l_discount") * 9
    x, q = F.ln(p / (1 - p)), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(x, 6).alias("logit"), F.floor(4096 / (1 + F.exp(-q / 10))).alias("squashed"), F.floor(p * 4095).alias("p12"), F.floor(1 + 65534 * p).alias("p16"),
        F.floor(16 * F.log2(q + 1) + 0.5).alias("ilog"), F.round(F.least(F.lit(15.0), 2 * F.abs(x)), 6).alias("confidence"), F.round(F.least(F.lit(15.0), 32 * F.abs(p - F.col("l_tax"))), 6).alias("disagreement"),
        F.round(1 / (1 + F.exp(-(x + 0.25 * (q / 10 - 2)))), 6).alias("blended"))


_POSITION = "CASE WHEN {n} <= 4 THEN {n} WHEN {n} <= 8 THEN 5 WHEN {n} <= 16 THEN 6 ELSE 7 END"


@query(
    "SELECT page_id, md5(array_to_string(list_transform(regexp_extract_all(hex(encode(html)), '..'), lambda h: CASE WHEN h BETWEEN '20' AND '7E' THEN chr(('0x' || h)::INT) ELSE '\\x' || lower(h) END), '')) AS escaped_md5, "
    f"sha256(html) AS html_sha256, lpad(lower(hex(page_id)), 16, '0') AS id_hex, coalesce(length(nullif(regexp_extract(page_id || ';', '^([0-9]+);', 1), '')), 0)::INT AS numlen, ({_POSITION.format(n='length(url)')})::INT AS bucket, "
    "to_json({'page_id': page_id, 'bytes': strlen(html)})::VARCHAR AS json FROM pages"
)
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes, digests, hex, digits before a semicolon, buckets of positions, JSON."""
    escaped = F.array_join(F.transform(tx.byte_array(F.col("html")), lambda h: F.when(h.between("20", "7E"), F.char(F.conv(h, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\x"), F.lower(h)))), "")
    n = F.length("url")
    i = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.md5(escaped).alias("escaped_md5"), F.sha2("html", 256).alias("html_sha256"), F.lpad(F.lower(F.hex("page_id")), 16, "0").alias("id_hex"), F.length(F.regexp_extract(F.concat(i, F.lit(";")), "^([0-9]+);", 1)).alias("numlen"),
        F.when(n <= 4, n).when(n <= 8, 5).when(n <= 16, 6).otherwise(7).alias("bucket"), F.to_json(F.struct("page_id", F.octet_length("html").cast("long").alias("bytes"))).alias("json"))


@query("SELECT word, list_reduce(list_prepend(2963738797::BIGINT, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: (a * 8416 + b) % 4294967296) AS hash FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)")
def word_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polynomial hash of words in 32 bits: times 263 x 32, plus the letter, from a fixed value."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    letters = F.transform(F.split("word", ""), lambda c: F.ascii(c).cast("long"))
    return w.select("word", F.aggregate(letters, F.lit(0xB0A710AD).cast("long"), lambda a, b: (a * 8416 + b) % F.lit(1 << 32)).alias("hash"))


@query("SELECT page_id, md5(html) AS stripped_md5, md5(regexp_replace(html, '([\"<>])', '&\\1', 'g')) AS coded_md5 FROM pages")
def ampersand_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ampersand put before quotes and angles, and taken away again."""
    coded = F.regexp_replace("html", '(["<>])', "&$1")
    p = table(spark, sf_dir, "pages").select("page_id", coded.alias("c"))
    return p.select("page_id", F.md5(F.regexp_replace("c", '&(["<>])', "$1")).alias("stripped_md5"), F.md5("c").alias("coded_md5"))


@query("SELECT doc_id, 21 + strlen(text) + strlen(source) + strlen(lang) + 2 * 21 AS container_bytes, md5(text) AS main_md5, md5(source) AS header_md5, md5(lang) AS tail_md5 FROM documents")
def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main part, header and tail in one binary with their sizes in front (21 digits each), and taken apart again."""
    raw = lambda c: F.encode(c, "UTF-8")
    field = lambda c: F.encode(F.format_string("%021d", F.octet_length(c).cast("long")), "UTF-8")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(field("lang"), field("text"), field("source"), raw("text"), raw("source"), raw("lang")).alias("c"))
    size = lambda k: F.decode(F.substring("c", 21 * k + 1, 21), "UTF-8").cast("int")
    d = d.select("doc_id", "c", *[size(k).alias(n) for k, n in enumerate(("t", "m", "h"))])
    part = lambda at, n: F.md5(F.substring(F.col("c"), at, n))
    return d.select("doc_id", F.length("c").cast("long").alias("container_bytes"), part(F.lit(64), F.col("m")).alias("main_md5"), part(F.col("m") + 64, F.col("h")).alias("header_md5"), part(F.col("m") + F.col("h") + 64, F.col("t")).alias("tail_md5"))


_DAY = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
_HEADER = f"'    <title>' || event_type || '</title>' || chr(10) || '    <id>' || event_id || '</id>' || chr(10) || '    <revision>' || chr(10) || '      <timestamp>' || {_DAY} || '</timestamp>' || chr(10) || '      <contributor>' || chr(10) || '        <id>' || user_id || '</id>' || chr(10)"


@query(f"SELECT event_id, md5('>' || (event_id - lag(event_id, 1, 0) OVER (ORDER BY event_id)) || chr(10) || event_type || chr(10) || {_DAY} || chr(10) || user_id || chr(10)) AS stream_md5, md5({_HEADER}) AS header_md5 FROM events")
def header_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page headers without indents, tags and all but the difference of ids, and built anew from that."""
    n = F.lit("\n")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("day"), F.col("user_id").cast("string").alias("user"))
    numbered = ordering.running(e, "event_id", {"k": F.lit(1)})
    # the id before: the one of the row before, found by its number instead of in one window
    before = numbered.select((F.col("k") + 1).alias("k"), F.col("event_id").alias("before"))
    s = numbered.join(before, "k", "left").select("event_id", "before", F.concat(F.lit(">"), (F.col("event_id") - F.coalesce("before", F.lit(0))).cast("string"), n, "event_type", n, "day", n, "user", n).alias("s"))
    parts = F.split("s", "\n")
    made = F.concat(F.lit("    <title>"), parts[1], F.lit("</title>\n    <id>"), (F.substring(parts[0], 2, 20).cast("long") + F.coalesce("before", F.lit(0))).cast("string"), F.lit("</id>\n    <revision>\n      <timestamp>"), parts[2],
                    F.lit("</timestamp>\n      <contributor>\n        <id>"), parts[3], F.lit("</id>\n"))
    return s.select("event_id", F.md5("s").alias("stream_md5"), F.md5(made).alias("header_md5"))


_INNER = "\\([^()\\n]*\\)|\\[[^\\[\\]|\\n]*\\||<[^<>\\n]*>|<[^<>:\\n]*:"


@query(f"SELECT page_id, len(regexp_extract_all(html, '[A-Za-z]+')) AS words, len(regexp_extract_all(regexp_replace(html, '{_INNER}', ' ', 'g'), '[A-Za-z]+')) AS outer_words, coalesce(list_sum(list_transform(regexp_extract_all(html, '<(?:p|pre|title|nowiki|math)>[^<]*</'), lambda x: length(x))), 0)::BIGINT AS region_chars FROM pages")
def outer_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of pages with and without those in brackets, and the size of tagged regions."""
    count = lambda c: F.regexp_count(c, F.lit("[A-Za-z]+")).cast("long")
    regions = F.aggregate(F.regexp_extract_all("html", F.lit("<(?:p|pre|title|nowiki|math)>[^<]*</"), F.lit(0)), F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return table(spark, sf_dir, "pages").select("page_id", count(F.col("html")).alias("words"), count(F.regexp_replace("html", _INNER, " ")).alias("outer_words"), regions.alias("region_chars"))


def _cut(order: int) -> str:
    parts = ", ".join(f"unnest(b[{j + 1}:len(b) - {order - j}]) AS x{j}" for j in range(order + 1))
    return f"SELECT doc_id, unnest(range(len(b) - {order})) AS i, {parts} FROM (SELECT doc_id, {_HEX} AS b FROM documents)"


def _followers(order: int, parts: tuple[int, ...], name: str) -> str:
    key = ", ".join(f"x{order - k}" for k in parts)
    return f"{name} AS (SELECT doc_id, count(p) AS known, count(*) FILTER (p = x{order}) AS hits FROM (SELECT doc_id, x{order}, lag(x{order}) OVER (PARTITION BY doc_id, {key} ORDER BY i) AS p FROM ({_cut(order)})) GROUP BY doc_id)"


_CONTEXTS = {"order1": (1,), "order2": (1, 2), "order6": (1, 2, 3, 4, 5, 6), "sparse": (2, 3, 4)}


@query(
    "WITH " + ", ".join(_followers(max(c), c, n) for n, c in _CONTEXTS.items()) + " SELECT documents.doc_id, " + ", ".join(f"coalesce({n}.known, 0) AS {n}_known, coalesce({n}.hits, 0) AS {n}_hits" for n in _CONTEXTS)
    + " FROM documents " + " ".join(f"LEFT JOIN {n} ON {n}.doc_id = documents.doc_id" for n in _CONTEXTS)
)
def context_followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes whose context (of one, two and six bytes, and one with a gap) came before, and those that follow it as last time."""
    ship(spark)
    c = classes.follower_counts(*_CONTEXTS.values())
    d = table(spark, sf_dir, "documents").select("doc_id", c("text").alias("c"))
    return d.select("doc_id", *[F.get("c", F.lit(2 * k + j)).alias(f"{n}_{s}") for k, n in enumerate(_CONTEXTS) for j, s in enumerate(("known", "hits"))])


_GRAM_ORDERS = (1, 2, 3, 4, 6)


@query("SELECT documents.doc_id, " + ", ".join(f"coalesce(g{n}.n, 0) AS grams{n}" for n in _GRAM_ORDERS) + " FROM documents " + " ".join(
    f"LEFT JOIN (SELECT doc_id, count(DISTINCT {' || '.join(f'x{j}' for j in range(n))}) AS n FROM ({_cut(n - 1)}) GROUP BY doc_id) AS g{n} ON g{n}.doc_id = documents.doc_id" for n in _GRAM_ORDERS))
def context_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different contexts of each order a document has."""
    ship(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", classes.gram_counts(_GRAM_ORDERS)("text").alias("g"))
    return d.select("doc_id", *[F.get("g", F.lit(k)).alias(f"grams{n}") for k, n in enumerate(_GRAM_ORDERS)])


@query("SELECT count(*) AS n, sum(strlen(html))::BIGINT AS bytes, count(*) FILTER (sha256(html) = sha256(html || '')) AS equal, (sum(strlen(html)) + CASE WHEN count(*) FILTER (html IS NULL) > 0 THEN NULL ELSE 0 END)::BIGINT AS total FROM pages")
def result_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, equal digests after a round trip through UTF-8, and a total that is null as soon as a part is."""
    h = F.col("html")
    same = F.sha2(h, 256) == F.sha2(F.decode(F.encode(h, "UTF-8"), "UTF-8"), 256)
    size = F.octet_length(h).cast("long")
    return table(spark, sf_dir, "pages").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.count(F.when(same, 1)).alias("equal"), F.when(F.count(F.when(h.isNull(), 1)) == 0, F.sum(size)).alias("total"))


@query("SELECT event_type AS variant, count(*) AS repeats, round(median(value), 6) AS median_value, max(value) AS peak FROM events GROUP BY 1")
def repeat_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and peak over the repeats of each variant."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("variant")).agg(F.count("*").alias("repeats"), F.round(F.median("value"), 6).alias("median_value"), F.max("value").alias("peak"))


_PROBES = (
    "WITH b AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS rank, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS other, count(*) OVER () AS n FROM documents), "
    "t AS (SELECT * FROM b WHERE rank > 0 AND other > 0 AND rank % greatest(1, (n - 1) // 12) = 0), "
    "p AS (SELECT t.doc_id AS target, 'baseline' AS kind, b.doc_id AS source, abs(t.n_chars - b.n_chars) AS bits FROM t JOIN b ON b.rank = t.rank - 1 UNION ALL SELECT t.doc_id, 'optimized', b.doc_id, abs(t.n_chars - b.n_chars) FROM t JOIN b ON b.other = t.other - 1 "
    "UNION ALL SELECT t.doc_id, 'random', b.doc_id, abs(t.n_chars - b.n_chars) FROM t JOIN b ON b.rank = (t.rank + 32 + ('0x' || left(md5(t.doc_id || 'a'), 7))::BIGINT % (t.n - 63)) % t.n) "
)


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target, kind, source, bits: of every stride-th document the one before it in the order, in another order, and a random one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.struct("n_chars", "doc_id").alias("o"))
    b = ordering.running(ordering.running(d, "doc_id", {"rank": F.lit(1)}), "o", {"other": F.lit(1)}).select("doc_id", "n_chars", (F.col("rank") - 1).alias("rank"), (F.col("other") - 1).alias("other"))
    n = b.count()
    t = b.where((F.col("rank") > 0) & (F.col("other") > 0) & (F.col("rank") % max(1, (n - 1) // 12) == 0))
    drawn = (F.col("rank") + 32 + F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("a")).cast("binary")), 1, 7), 16, 10).cast("long") % (n - 63)) % n
    kinds = t.select(F.col("doc_id").alias("target"), F.col("n_chars").alias("size"), F.explode(F.create_map(F.lit("baseline"), F.col("rank") - 1, F.lit("random"), drawn)).alias("kind", "at"))
    by_rank = kinds.join(b.select(F.col("rank").alias("at"), F.col("doc_id").alias("source"), "n_chars"), "at")
    by_other = t.select(F.col("doc_id").alias("target"), F.col("n_chars").alias("size"), F.lit("optimized").alias("kind"), (F.col("other") - 1).alias("at")).join(b.select(F.col("other").alias("at"), F.col("doc_id").alias("source"), "n_chars"), "at")
    return by_rank.unionByName(by_other).select("target", "kind", "source", F.abs(F.col("size") - F.col("n_chars")).alias("bits"))


@query(_PROBES + "SELECT * FROM p")
def probe_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probes(spark, sf_dir)


@query(_PROBES + "SELECT kind, count(*) AS n, sum(bits)::BIGINT AS bits, sum(place)::BIGINT AS places, count(*) FILTER (place = 1) AS firsts FROM (SELECT kind, bits, row_number() OVER (PARTITION BY target ORDER BY bits, kind) AS place FROM p) GROUP BY kind")
def probe_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the kinds of predecessors rank within their targets."""
    place = F.row_number().over(Window.partitionBy("target").orderBy("bits", "kind"))
    return _probes(spark, sf_dir).withColumn("place", place.cast("long")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("bits").alias("bits"), F.sum("place").alias("places"), F.count(F.when(F.col("place") == 1, 1)).alias("firsts"))


def parse_segments(spec: str, size: int) -> list[tuple[int, int]]:
    """(first rank, one past the last) of `START:COUNT` parts joined by commas; ValueError if they overlap or leave size."""
    spans = sorted((int(a), int(a) + int(n)) for a, _, n in (part.partition(":") for part in spec.split(",")))
    if any(a < 0 or a >= b or b > size for a, b in spans) or any(b > c for (_, b), (c, _) in zip(spans, spans[1:], strict=False)):
        raise ValueError(f"{spec}: segments overlap, are empty or leave 0 to {size}")
    return spans


def parse_block(spec: str) -> tuple[str, float, int]:
    """PATH[:WEIGHT[:OFFSET]] of a feature block."""
    path, _, rest = spec.partition(":")
    weight, _, offset = rest.partition(":")
    return path, float(weight or 1), int(offset or 0)


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents) SELECT doc_id, rank, CASE WHEN rank < 25 THEN 0 WHEN rank < 90 THEN 1 ELSE 2 END AS segment FROM r WHERE rank < 25 OR rank BETWEEN 40 AND 89 OR rank BETWEEN 120 AND 134")
def spec_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of ranks as a user states them (they are the feature)."""
    d = ordering.running(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", {"n": F.lit(1)}).select("doc_id", (F.col("n") - 1).alias("rank"))
    which = F.lit(None)
    for k, (a, b) in enumerate(parse_segments("120:15,0:25,40:50", d.count())):
        which = F.when((F.col("rank") >= a) & (F.col("rank") < b), k).otherwise(which)
    return d.select("doc_id", "rank", which.alias("segment")).where("segment IS NOT NULL")


_URL_TRACE = "WITH u AS (SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, strlen(url) AS b FROM pages) SELECT dimension, key, count(*) AS url_count, sum(b)::BIGINT AS bytes, round(sum(b) * 8 / count(*), 6) AS bits FROM (SELECT 'total' AS dimension, 'all' AS key, b FROM u UNION ALL SELECT 'domain', host, b FROM u) GROUP BY ALL"


@query(_URL_TRACE)
def url_trace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace by URL dimensions, written as CSV with a header in two appends, and read by its column names."""
    u = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.octet_length("url").alias("b"))
    path = scratch_path(spark, "url-trace")
    facts = [F.count("*").alias("url_count"), F.sum("b").alias("bytes"), F.round(F.sum("b") * 8 / F.count("*"), 6).alias("bits")]
    for rows in (u.agg(*facts).select(F.lit("total").alias("dimension"), F.lit("all").alias("key"), "*"), u.groupBy(F.col("host").alias("key")).agg(*facts).select(F.lit("domain").alias("dimension"), "*")):
        rows.write.option("header", True).option("emptyValue", "").mode("append").csv(path)
    return spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path, schema="dimension string, key string, url_count long, bytes long, bits double", enforceSchema=False)


_TRACE_KINDS = "SELECT 'article' AS kind, l_suppkey % 50 AS id, sum(l_linenumber)::BIGINT AS count, sum(l_quantity) AS bits FROM lineitem GROUP BY ALL UNION ALL SELECT 'control', l_linenumber, count(*), sum(l_extendedprice) FROM lineitem GROUP BY ALL"


@query(f"SELECT sum(CASE WHEN kind = 'article' THEN bits ELSE 0 END)::DOUBLE AS article_bits, count(*) FILTER (kind = 'control') AS cells, sum(CASE WHEN kind = 'control' THEN count ELSE 0 END)::BIGINT AS control_count FROM ({_TRACE_KINDS})")
def control_trace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace of articles and control cells, written tab-separated, and read with article rows summed apart."""
    li = table(spark, sf_dir, "lineitem")
    articles = li.groupBy((F.col("l_suppkey") % 50).alias("id")).agg(F.sum("l_linenumber").alias("count"), F.sum("l_quantity").alias("bits")).select(F.lit("article").alias("kind"), "*")
    cells = li.groupBy(F.col("l_linenumber").cast("long").alias("id")).agg(F.count("*").alias("count"), F.sum("l_extendedprice").alias("bits")).where("count > 0").select(F.lit("control").alias("kind"), "*")
    path = scratch_path(spark, "control-trace")
    articles.unionByName(cells).write.option("header", True).option("sep", "\t").csv(path)
    t = spark.read.option("header", True).option("sep", "\t").csv(path, schema="kind string, id long, count long, bits double")
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)).otherwise(0))
    return t.agg(of("article", "bits").cast("double").alias("article_bits"), F.count(F.when(F.col("kind") == "control", 1)).alias("cells"), of("control", "count").alias("control_count"))


@query("SELECT event_type AS name, count(*) AS events, round(sum(value), 4) AS bits FROM events GROUP BY 1")
def json_trace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace by event as one JSON object over several lines, and read again."""
    facts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("bits"))
    one = facts.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("events", "bits")))).alias("trace")), {"pretty": "true"}).alias("value"))  # a key for each kind of event
    path = scratch_path(spark, "json-trace")
    one.coalesce(1).write.text(path)
    kinds = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<trace:map<string,struct<events:long,bits:double>>>").alias("t"))
    return kinds.select(F.explode("t.trace").alias("name", "x")).select("name", "x.events", "x.bits")


@query("SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents)")
def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a text file of one id a line, and its ranks read from the lines' places."""
    d = ordering.running(table(spark, sf_dir, "documents").select("doc_id", F.struct((-F.col("n_chars")).alias("m"), "doc_id").alias("o")), "o", {"n": F.lit(1)})
    path = scratch_path(spark, "order")
    d.repartitionByRange("n").sortWithinPartitions("n").select(F.col("doc_id").cast("string").alias("value")).write.text(path)
    lines = spark.read.text(path).select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"), "value")
    return ordering.running(lines, "at", {"n": F.lit(1)}).select(F.col("value").cast("long").alias("doc_id"), (F.col("n") - 1).alias("rank"))


@query("SELECT doc_id, stream_begin, stream_end, split, md5(text) AS slice_md5 FROM (SELECT doc_id, text, doc_id % 8 AS split, e AS stream_end, b AS stream_begin FROM (" + _STREAM + "))")
def manifest_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest with byte ranges written and read as tab-separated rows, and each document cut out of its part of the corpus by them."""
    d = ordering.offsets(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", F.octet_length("text"))
    path = scratch_path(spark, "manifest")
    d.select("doc_id", "stream_begin", "stream_end", (F.col("doc_id") % 8).alias("split")).write.option("header", True).option("sep", "\t").csv(path)
    m = spark.read.option("header", True).option("sep", "\t").csv(path, schema="doc_id long, stream_begin long, stream_end long, split long").withColumn("split", F.col("split").bitwiseAND(F.lit(7)))
    # a part of the corpus: 32 neighbours laid out one after the other
    parts = d.withColumn("part", F.floor(F.col("doc_id") / 32)).groupBy("part").agg(F.min("stream_begin").alias("base"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stream_begin", "doc_id", "text"))), lambda x: x["text"]), "").alias("stream"))
    cut = m.withColumn("part", F.floor(F.col("doc_id") / 32)).join(parts, "part")
    piece = F.substring(F.encode("stream", "UTF-8"), (F.col("stream_begin") - F.col("base") + 1).cast("int"), (F.col("stream_end") - F.col("stream_begin")).cast("int"))
    return cut.select("doc_id", "stream_begin", "stream_end", "split", F.md5(piece).alias("slice_md5"))


@query("SELECT l_linenumber * 2 AS low, l_linenumber * 2 + 2 AS high, count(*) % 5 AS scale_class, row_number() OVER (ORDER BY l_linenumber) - 1 AS place FROM lineitem GROUP BY l_linenumber UNION ALL SELECT 255, 255, 2, count(DISTINCT l_linenumber) FROM lineitem")
def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules written as initialiser lines that a sentinel ends, and parsed again; the first row that fits decides."""
    r = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg((F.count("*") % 5).alias("c")).select((F.col("l_linenumber") * 2).alias("low"), (F.col("l_linenumber") * 2 + 2).alias("high"), "c")
    sentinel = spark.createDataFrame([(255, 255, 2)], "low int, high int, c long")
    path = scratch_path(spark, "rules")
    line = F.format_string("{%d, %d, %d},", "low", "high", "c").alias("value")
    r.unionByName(sentinel).coalesce(1).sortWithinPartitions("low").select(line).write.text(path)  # some rules and a sentinel
    rows = spark.read.text(path).select(F.regexp_extract_all("value", F.lit("[0-9]+"), F.lit(0)).cast("array<int>").alias("v"))
    ranked = rows.select(F.get("v", F.lit(0)).alias("low"), F.get("v", F.lit(1)).alias("high"), F.get("v", F.lit(2)).cast("long").alias("scale_class"))
    return ranked.withColumn("place", F.row_number().over(Window.orderBy("low")).cast("long") - 1)


# URLs of a made-up site; the parameters follow from the line's number.
FIXTURE = (
    "https://books.test/shelf/{n}", "https://books.test/day/{y}/{m}/{d}/log", "https://books.test/find?q=ink&page={p}", "//static.books.test/logo.svg", "www.books.test/shelf", "https://books.test/caf%C3%A9",
    "https://me@books.test:81/{n}", "ftp://mirror.test/{y}/dump.gz",
)


@query(
    "WITH l AS (SELECT k, 'Note ' || k || ': ' || replace(replace(replace(replace(replace(["
    + ", ".join(f"'{u}'" for u in FIXTURE)
    + "][k % 8 + 1], '{n}', (10000 + (k * 7919) % 90000)::VARCHAR), '{y}', (2020 + k % 5)::VARCHAR), '{m}', (1 + k % 12)::VARCHAR), '{d}', (1 + k % 28)::VARCHAR), '{p}', (1 + k % 20)::VARCHAR) || '.' AS line FROM range(4000) AS t(k)) "
    "SELECT k, line FROM (SELECT *, sum(strlen(line) + 1) OVER (ORDER BY k) AS e FROM l) WHERE e <= 100000"
)
def url_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with URLs made from their number, as many as 100,000 bytes hold (the cut is the feature)."""
    k = F.col("k")
    line = F.element_at(F.array(*map(F.lit, FIXTURE)), (k % 8 + 1).cast("int"))
    for mark, v in (("{n}", 10000 + (k * 7919) % 90000), ("{y}", 2020 + k % 5), ("{m}", 1 + k % 12), ("{d}", 1 + k % 28), ("{p}", 1 + k % 20)):
        line = F.replace(line, F.lit(mark), v.cast("string"))
    rows = spark.range(4000).withColumnRenamed("id", "k").select("k", F.concat(F.lit("Note "), k.cast("string"), F.lit(": "), line, F.lit(".")).alias("line"))
    return ordering.running(rows, "k", {"e": F.octet_length("line") + 1}).where("e <= 100000").select("k", "line")
