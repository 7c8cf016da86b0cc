"""Tab-separated feature blocks, orders, and binary traces of coded bits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A record of a probability trace, little-endian.
TRACE_RECORD = np.dtype([("byte_pos", "<u8"), ("final_p", "<u2"), ("boundary_p", "<u2"), ("bit_index", "u1"), ("bit", "u1"), ("event", "u1"), ("terminator", "u1")])
TRACE_SCHEMA = "byte_pos long, final_p int, boundary_p int, bit_index int, bit int, event int, terminator int"


def read_block(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """id (plus offset), features: rows of an id and numbers; lines whose id is no number are headers.

    ValueError on ragged rows, repeated or negative ids.
    """
    cells = spark.read.text(path).where("value <> ''").select(F.split("value", "\t").alias("c"))
    rows = cells.where(F.get("c", F.lit(0)).rlike("^-?[0-9]+$")).select((F.get("c", F.lit(0)).cast("long") + offset).alias("id"), F.slice("c", F.lit(2), F.size("c") - 1).cast("array<double>").alias("features"))
    seen = rows.groupBy("id").agg(F.count("*").alias("n"), F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high"))
    s = seen.agg(F.max("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("id").alias("id")).first()
    if s.n is not None:
        if s.low != s.high:
            raise ValueError(f"{path}: rows have {s.low} to {s.high} features")
        if s.n > 1:
            raise ValueError(f"{path}: an id comes {s.n} times")
        if s.id < 0:
            raise ValueError(f"{path}: id {s.id} is negative")
    return rows


def write_block(block: DataFrame, path: str) -> None:
    """Tab-separated lines of id and features, with nine digits."""
    block.select(F.concat_ws("\t", F.col("id").cast("string"), F.array_join(F.transform("features", lambda x: F.format_string("%.9g", x)), "\t")).alias("value")).write.text(path)


def align(blocks: list[DataFrame]) -> DataFrame:
    """id and all features of the ids that every block has; ValueError if there is none."""
    out = blocks[0].select("id", F.col("features").alias("_0"))
    for k, b in enumerate(blocks[1:], 1):
        out = out.join(b.select("id", F.col("features").alias(f"_{k}")), "id")
    out = out.select("id", F.concat(*[f"_{k}" for k in range(len(blocks))]).alias("features"))
    if out.isEmpty():
        raise ValueError("the blocks share no id")
    return out


def write_trace(rows: DataFrame, path: str, magic: bytes) -> None:
    """Binary traces, one for each task that has records, under path: magic, then the records in their order."""
    names = list(TRACE_RECORD.names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(inner, recursive=True)
        out, n = None, 0
        name, attempt = f"part-{TaskContext.get().partitionId():05d}.bin", uuid.uuid4().hex
        for batch in batches:
            if batch.num_rows:
                if out is None:
                    out = store.open_output_stream(f"{inner}/_{name}.{attempt}", compression=None)  # hidden until it is whole
                    out.write(magic)
                records = np.zeros(batch.num_rows, TRACE_RECORD)
                for c in names:
                    records[c] = batch.column(c).to_numpy(zero_copy_only=False)
                out.write(records.tobytes())
                n += batch.num_rows
        if out is not None:
            out.close()
            if store.get_file_info(f"{inner}/{name}").type == fs.FileType.File:  # an earlier attempt's, with the same records
                store.delete_file(f"{inner}/{name}")
            store.move(f"{inner}/_{name}.{attempt}", f"{inner}/{name}")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows.select(*names).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_trace(spark: SparkSession, path: str, magic: bytes, warmup: int = 0) -> DataFrame:
    """Records of binary traces (each file under 2 GB) from byte_pos warmup on.

    Each file begins with magic and holds whole records, else ValueError.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                if raw[: len(magic)] != magic:
                    raise ValueError(f"{name}: not a trace")
                if (len(raw) - len(magic)) % TRACE_RECORD.itemsize:
                    raise ValueError(f"{name}: cut off within a record")
                records = np.frombuffer(raw, TRACE_RECORD, offset=len(magic))
                records = records[records["byte_pos"] >= warmup]
                for i in range(0, len(records), 100_000):
                    part = records[i : i + 100_000]
                    yield pd.DataFrame({c: part[c].astype("int64" if c == "byte_pos" else "int32") for c in TRACE_RECORD.names})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, TRACE_SCHEMA)
