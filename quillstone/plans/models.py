"""Models: mixtures, calibration, codes, brackets, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coding, contexts
from ..functions import text as tx
from ..runtime import scratch_path, ship, spread, table
from ..streaming import adaptive
from .catalogue import _losses
from .registry import query


_ORDERS = ", ".join(f"o{k} AS MATERIALIZED ({_losses(k, 12)})" for k in range(3))
_BITS = [f"(o{k}.bits + 8 * least({k}, o0.bytes))" for k in range(3)]
_LEAST = f"least({', '.join(_BITS)})"


@query(
    f"WITH {_ORDERS} SELECT doc_id, {', '.join(f'round({b}, 4) AS order{k}' for k, b in enumerate(_BITS))}, round({_LEAST} - log2(({' + '.join(f'pow(2, {_LEAST} - {b})' for b in _BITS)}) / 3), 4) AS mixed "
    "FROM o0 JOIN o1 USING (doc_id) JOIN o2 USING (doc_id)"
)
def mixture_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of each document under orders 0 to 2 and their mixture."""
    ship(spark)
    m = table(spark, sf_dir, "documents").select("doc_id", contexts.mixture("text").alias("m"))
    return m.select("doc_id", *[F.round(F.get("m", F.lit(k)), 4).alias(n) for k, n in enumerate(("order0", "order1", "order2", "mixed"))])


@query("SELECT doc_id, strlen(text) AS text_bytes, md5(text) AS restored_md5 FROM documents")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the arithmetic coder and back."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", coding.packed(spark, F.col("text").cast("binary")).alias("p"))
    return d.select("doc_id", coding.unpacked(spark, "p").alias("t")).select("doc_id", F.octet_length("t").cast("long").alias("text_bytes"), F.md5("t").alias("restored_md5"))


@query()
def bracket_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far brackets of pages reach."""
    ship(spark)
    rows = table(spark, sf_dir, "pages").select(F.explode(contexts.bracket_distances("html")).alias("p"))
    return rows.groupBy("p.bracket", "p.distance").agg(F.sum("p.n").alias("n"))


@query(
    "SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(hit), 6) AS observed FROM (SELECT least(23, floor(24 * p))::INT AS bin, p, hit FROM "
    "(SELECT 1 / (1 + exp(-(l_discount * 40 - 2))) AS p, CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM lineitem)) GROUP BY bin"
)
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came of predictions, by 24 bins of their probability: the table that refines a model's output."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("l_discount") * 40 - 2)))
    rows = table(spark, sf_dir, "lineitem").select(p.alias("p"), F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0).alias("hit"))
    return rows.groupBy(F.least(F.lit(23), F.floor(F.col("p") * 24)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("hit"), 6).alias("observed"))


@query("SELECT count(DISTINCT x) AS vocabulary FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents)")
def byte_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many byte values the corpus has: sums of histograms, 256 numbers a task."""
    ship(spark)
    h = table(spark, sf_dir, "documents").select(F.posexplode(tx.byte_histogram("text")).alias("byte", "n")).where("n > 0")
    return h.agg(F.countDistinct("byte").alias("vocabulary"))


_SEEN = (
    "SELECT user_id::VARCHAR AS key, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS seen, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS total FROM events"
)


@query(
    f"SELECT key, event_id, event_type AS symbol, round(log2(total + 0.5::DOUBLE * (coalesce(sum(CASE WHEN seen = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)) - log2(seen + 0.5::DOUBLE), 6) AS bits FROM ({_SEEN})"
)
def stream_event_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events coded under a model of each user, whose state outlives a micro-batch."""
    ship(spark)
    # a pattern, since a stream's path may not be a single file
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    out, checkpoint = scratch_path(spark, "stream-bits"), scratch_path(spark, "stream-state")
    keyed = events.select(F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("key"), "event_id", "ts", F.coalesce("event_type", F.lit("")).alias("symbol"))
    adaptive.drain(adaptive.adaptive_bits(keyed), out, checkpoint)
    return spark.read.schema(adaptive.OUT).parquet(out).withColumn("bits", F.round("bits", 6))
