"""Ideal bits of symbols under an adaptive model of each key, as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from math import log2
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, event_id long, symbol string, bits double"
STATE = "symbols array<string>, counts array<long>"


def _code(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    symbols, counts = state.get if state.exists else ([], [])
    seen: dict[str, int] = dict(zip(symbols, counts, strict=True))
    total = sum(seen.values())
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
    bits = []
    for s in rows["symbol"]:
        # half a count for each symbol that has come, and as much for a new one
        bits.append(log2(total + 0.5 * (len(seen) + 1)) - log2(seen.get(s, 0) + 0.5))
        seen[s] = seen.get(s, 0) + 1
        total += 1
    state.update((list(seen), list(seen.values())))
    yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"], "symbol": rows["symbol"], "bits": bits})


def adaptive_bits(events: DataFrame) -> DataFrame:
    """key, event_id, symbol, bits of a stream of key, event_id, ts, symbol.

    A key's rows of one micro-batch are coded in order of ts; the state is the counts of the symbols that the key has
    had, so it grows with the alphabet, not the stream. Null keys and symbols must be filled before.
    """
    return events.groupBy("key").applyInPandasWithState(_code, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str) -> Any:
    """Write what is there now to Parquet files, with exactly-once bookkeeping in checkpoint, and stop."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query
