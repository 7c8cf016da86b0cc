"""Jump consistent hashing: a stable key and the shard count give the shard, with no ring table.

Appending a shard moves a row only into the new shard, 1/n of the rows on average. Slots are numbered without a
shuffle of rows: each task numbers its rows within each shard, and only the counts of (task, shard) are summed.

Defined cases: a null text has no bytes (size 1, crc32 0); a null doc_id is hashed as the key 0, ids that aren't
integers by the hash of their text; texts of any length are read by the JVM and never leave it; repeated rows get the
same shard and slots of their own; an empty table gives no rows; further columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..runtime import materialize, maybe_broadcast, ship
from .words import mix
from .workers import tidy

SHARDS = 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key (Lamping and Veach, 2014), for all keys at once."""
    key = keys.astype(np.uint64, copy=True)
    b = np.full(len(key), -1, np.int64)
    j = np.zeros(len(key), np.int64)
    active = np.arange(len(key))
    while len(active):
        b[active] = j[active]
        k = key[active] * np.uint64(2862933555777941757) + np.uint64(1)
        key[active] = k
        step = (b[active] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))
        j[active] = np.minimum(step, 2.0**62).astype(np.int64)
        active = active[j[active] < shards]
    return b


def shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    """The shard of integer ids, which are mixed first, so that runs of ids spread too."""
    return jump_hash(mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), shards)


def stable_key(docs: DataFrame, key: str) -> Column:
    """An integer key as it is; other ones by a hash of their text; null stays null."""
    kind = docs.schema[key].dataType
    return F.col(key).cast("long") if isinstance(kind, IntegralType) else F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string")))


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law ('key'), shard, slot (gapless from 0 in each shard), grown_shard (with one more)."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    thin = docs.select(F.col(key).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), stable_key(docs, key).alias("stable"))
    kind = thin.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(shards, np.int64)
        for batch in batches:
            ids = batch.column("stable").fill_null(0).to_numpy(zero_copy_only=False)
            shard = shard_of(ids, shards)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            first = np.cumsum(counts) - counts
            local = np.empty(len(ids), np.int64)
            local[order] = np.arange(len(ids)) - first[shard[order]] + seen[shard[order]]
            seen += counts
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "size": batch.column("size"), "text_crc32": batch.column("text_crc32"),
                "shard": pa.array(shard.astype(np.int32)), "grown_shard": pa.array(shard_of(ids, shards + 1).astype(np.int32)),
                "part": pa.array(np.full(len(ids), part, np.int32)), "local": pa.array(local),
            })

    placed = materialize(thin.mapInArrow(tidy(run), f"doc_id {kind}, size long, text_crc32 long, shard int, grown_shard int, part int, local long"), "shards")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    base = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("base"))
    base = materialize(base, "shard-bases")
    return placed.join(maybe_broadcast(base, base.count()), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("local")).alias("slot"), "grown_shard")
