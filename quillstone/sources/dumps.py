"""Page dumps: text files of pages between exact lines, their parts, and corpora written in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordering

# The lines and tags that bound a page and its text.
PAGE_OPEN, PAGE_CLOSE = "  <page>\n", "  </page>\n"
TEXT_OPEN, TEXT_CLOSE = '<text xml:space="preserve">', "</text>"
# Beginnings of a page's text line that make it a redirect.
REDIRECTS = ("#REDIRECT", "#redirect", "#Redirect", "#REdirect", "{{softredirect")
# Links that look like a language link but begin no tail.
NOT_LANGUAGE = ("http:", "user:", "media:", "image:", "category:", "r:Wikipédia:Aide]]", "de:Boogie Down Produ", "da:Wikipedia:Hvordan", "sv:Indiska musikinstrument")
TAIL_AFTER_LINES = 4


def read_pages(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """page_index (from 0, in the order of the files), raw: what stands between the lines of a page.

    Files are split by bytes and read in parallel. The part before the first page and a last page that is cut off are
    no pages, nor is one without a closing line; a file without pages gives no rows. strict: ValueError if a page begins
    inside another one, that is, if anything but a file's beginning and its last page lacks a closing line.
    """
    rows = spark.read.option("lineSep", PAGE_OPEN).text(path).select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("_at"), F.col("value").alias("raw"))
    if strict:
        open_ = ~F.col("raw").contains(PAGE_CLOSE)
        ends = rows.groupBy("_at.file").agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count(F.when(open_, 1)).alias("unclosed"), F.max(F.when(open_, F.col("_at"))).alias("latest"), F.min(F.when(open_, F.col("_at"))).alias("earliest"))
        fine = F.when(F.col("earliest") == F.col("first"), 1).otherwise(0) + F.when((F.col("latest") == F.col("last")) & (F.col("first") != F.col("last")), 1).otherwise(0)
        if not ends.where(F.col("unclosed") > fine).isEmpty():
            raise ValueError(f"{path}: a page begins inside another one")
    pages = rows.where(F.col("raw").contains(PAGE_CLOSE)).withColumn("raw", F.substring_index("raw", PAGE_CLOSE, 1))
    return ordering.running(pages, "_at", {"n": F.lit(1)}).select((F.col("n") - 1).alias("page_index"), "raw")


def title(raw: Column) -> Column:
    return F.regexp_extract(raw, "<title>([^<]*)</title>", 1)


def page_id(raw: Column) -> Column:
    """The first id of the page; null if there is none."""
    return F.regexp_extract(raw, "<id>([0-9]+)</id>", 1).try_cast("long")


def text(raw: Column) -> Column:
    """The text, still escaped; a page without one has an empty text."""
    return F.substring_index(F.when(raw.contains(TEXT_OPEN), F.substring_index(raw, TEXT_OPEN, -1)).otherwise(""), TEXT_CLOSE, 1)


def is_redirect(raw: Column) -> Column:
    hits = [raw.contains(f"      {TEXT_OPEN}{r}") for r in REDIRECTS]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def streams(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with header, body, tail and footer of each page; their concatenation is the page.

    The tail runs from the first language link at the begin of a line, four lines or more into the text, to the
    text's end. A page without a text is all header.
    """
    at = F.instr(F.col(raw), TEXT_OPEN)
    split = F.when(at > 0, at + len(TEXT_OPEN) - 1).otherwise(F.length(raw))
    out = df.withColumn("header", F.substring(F.col(raw), F.lit(1), split)).withColumn("_rest", F.substring(F.col(raw), split + 1, F.length(raw)))
    end = F.instr(F.col("_rest"), TEXT_CLOSE)
    stop = F.when(end > 0, end - 1).otherwise(F.length("_rest"))
    out = out.withColumn("footer", F.substring(F.col("_rest"), stop + 1, F.length("_rest"))).withColumn("_lines", F.split(F.substring(F.col("_rest"), F.lit(1), stop), "\n"))
    language = r"^\[\[(?!" + "|".join(x.replace("]", r"\]") for x in NOT_LANGUAGE) + ")[a-z]{2,}:"
    first = F.array_position(F.transform("_lines", lambda x, i: (i >= TAIL_AFTER_LINES) & x.rlike(language)), True)
    body = F.when(first > 0, F.concat(F.array_join(F.slice("_lines", F.lit(1), (first - 1).cast("int")), "\n"), F.lit("\n"))).otherwise(F.array_join("_lines", "\n"))
    tail = F.when(first > 0, F.array_join(F.slice("_lines", first.cast("int"), F.size("_lines")), "\n")).otherwise("")
    return out.withColumn("body", body).withColumn("tail", tail).drop("_rest", "_lines")


def joined(header: str = "header", body: str = "body", tail: str = "tail", footer: str = "footer") -> Column:
    """The page again."""
    return F.concat(header, body, tail, footer)


def manifest(pages: DataFrame, rank: str, raw: str = "raw") -> DataFrame:
    """rank, stream_begin, stream_end of pages laid out in an order, with their opening and closing lines."""
    return ordering.offsets(pages, rank, F.octet_length(raw) + len(PAGE_OPEN) + len(PAGE_CLOSE)).select(*[c for c in pages.columns if c != raw], "stream_begin", "stream_end")


def write_corpus(pages: DataFrame, rank: str, path: str, raw: str = "raw") -> None:
    """Text files whose concatenation by name is the corpus in the order of rank."""
    lines = F.concat(F.lit(PAGE_OPEN), raw, F.lit(PAGE_CLOSE.rstrip("\n"))).alias("value")
    pages.repartitionByRange(rank).sortWithinPartitions(rank).select(lines).write.text(path)
