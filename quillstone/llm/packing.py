"""Mixture-controlled packing: deficit round-robin over source queues, into sequences of a fixed length.

Each source is a queue of its documents' tokens. In every round (window) each queue's deficit grows by its quantum,
window x its share of the target proportions, and it sends as many tokens as its deficit holds; what is left over is
carried into the next round, and a queue that has run empty leaves its share to the others. Since documents may be
cut, what a queue has sent after k rounds has a closed form, floor(k x quantum); so every task finds the sequences
of its own tokens from the queues' totals alone: counts of (task, source) are summed, and no document is shuffled.
The rounds' tokens follow each other without gaps, so only the last sequence can be short.

Up to QUEUES sources, every task holds all totals. With more, totals stay in tables: each task finds the rounds of its
tokens from their own queue's total, and running sums over (round, queue) give the places; the result is the same.

Defined cases: a null text is empty, an empty document is its end token alone; a null source is the queue ''; repeated
rows are packed each; texts of any length are cut into as many pieces as they need; ids may have any type; an empty table
gives no rows; further columns, of any name, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import running
from ..runtime import materialize, maybe_broadcast, ship
from .tokens import encoder
from .workers import tidy

LENGTH = 1024
WINDOW = 32 * 1024
QUEUES = 1024
END = 0


class Mix(NamedTuple):
    """Target proportions: given ones, and the power of their own shares that other sources have."""

    weights: dict[str, float] = {}
    exponent: float = 1.0


def tokenized(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """A written table of doc_id, queue, part (task), at (tokens of this queue before it in the task), n, ids (bytes)."""
    ship(docs.sparkSession)
    queue = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select("doc_id", queue.alias("queue"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        sent: dict[str, int] = {}
        for batch in batches:
            queues = batch.column("queue").to_pylist()
            for first, last, ids, at in enc.encode(batch.column("text")):
                before, sizes, blobs = [], [], []
                for k in range(last - first):
                    n = int(at[k + 1] - at[k]) + 1
                    q = queues[first + k]
                    before.append(sent.get(q, 0))
                    sent[q] = before[-1] + n
                    sizes.append(n)
                    blobs.append(np.append(ids[at[k] : at[k + 1]], enc.dtype.type(end)).tobytes())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(first, last - first), "queue": batch.column("queue").slice(first, last - first),
                    "part": pa.array([part] * (last - first), pa.int32()), "at": pa.array(before, pa.int64()), "n": pa.array(sizes, pa.int64()), "ids": pa.array(blobs, pa.binary()),
                })

    return materialize(rows.mapInArrow(tidy(run, tokens=True), f"doc_id {kind}, queue string, part int, at long, n long, ids binary"), "tokens")


def _weight(mix: Mix, queue: str, total: int, rest: int) -> int:
    """A queue's weight: the given one, else a power of its own share."""
    if mix == Mix():
        return total
    return max(1, round(mix.weights.get(queue, (total / rest) ** mix.exponent) * 10**9))


class Rounds:
    """What each queue has sent after k rounds, and where its tokens stand in the packed stream."""

    def __init__(self, totals: dict[str, int], mix: Mix, window: int) -> None:
        self.names = sorted(totals)
        self.total = [totals[q] for q in self.names]
        rest = sum(self.total) or 1
        self.weight = [_weight(mix, q, t, rest) for q, t in zip(self.names, self.total, strict=True)]
        self.of = {q: k for k, q in enumerate(self.names)}
        self.window, self.sum = window, sum(self.weight) or 1
        self._known: dict[int, list[int]] = {}

    def sent(self, k: int) -> list[int]:
        if k not in self._known:
            if len(self._known) > 64:
                self._known.clear()
            self._known[k] = [min(t, k * self.window * w // self.sum) for t, w in zip(self.total, self.weight, strict=True)]
        return self._known[k]

    def runs(self, queue: str, at: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(first token in the packed stream, offset from at, length) of the tokens at..at+n-1 of a queue."""
        s = self.of[queue]
        quantum = self.window * self.weight[s]
        done = 0
        while done < n:
            x = at + done
            k = -((x + 1) * self.sum // -quantum) - 1  # the round that sends token x
            now, then = self.sent(k), self.sent(k + 1)
            take = min(n - done, then[s] - x)
            yield sum(now) + sum(then[:s]) - sum(now[:s]) + x - now[s], done, take
            done += take


def _placed(placed: DataFrame, totals: DataFrame, mix: Mix, window: int) -> DataFrame:
    """A row for each run of a document's tokens in a round: doc_id, queue, first, size, n, ids, at (place in the packed stream)."""
    rest = totals.agg(F.sum("total")).first()[0] or 1

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("queue").to_pylist(), batch.column("total").to_pylist(), strict=True)
            yield batch.append_column("weight", pa.array([_weight(mix, q, t, rest) for q, t in rows], pa.int64()))

    weighed = materialize(totals.mapInArrow(tidy(weigh), "queue string, total long, weight long"), "queue-weights")
    whole = weighed.agg(F.sum("weight")).first()[0] or 1

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, t, w in zip(*(batch.column(c).to_pylist() for c in ("queue", "total", "weight")), strict=True):
                ks, sizes, x = [], [], 0
                while x < t:
                    k = -((x + 1) * whole // -(window * w)) - 1  # the round that sends token x
                    then = min(t, (k + 1) * window * w // whole)
                    ks.append(k)
                    sizes.append(then - x)
                    x = then
                    if len(ks) == 10_000 or x == t:
                        yield pa.RecordBatch.from_pydict({"queue": pa.array([q] * len(ks), pa.string()), "round": pa.array(ks, pa.int64()), "sent": pa.array(sizes, pa.int64())})
                        ks, sizes = [], []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("row", "round", "inner", "first", "size", "ids")}
            for r, (at, n, t, w, blob) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "n", "total", "weight", "ids")), strict=True)):
                done, width = 0, len(blob) // n
                while done < n:
                    k = -((at + done + 1) * whole // -(window * w)) - 1
                    take = min(n - done, min(t, (k + 1) * window * w // whole) - at - done)
                    for c, v in (("row", r), ("round", k), ("inner", at + done - min(t, k * window * w // whole)), ("first", done), ("size", take), ("ids", blob[width * done : width * (done + take)])):
                        out[c].append(v)
                    done += take
            rows, ids = pa.array(out.pop("row"), pa.int32()), pa.array(out.pop("ids"), pa.binary())
            yield pa.RecordBatch.from_pydict({c: batch.column(c).take(rows) for c in ("doc_id", "queue", "n")} | {c: pa.array(v, pa.int64()) for c, v in out.items()} | {"ids": ids})

    sent = weighed.mapInArrow(tidy(segments), "queue string, round long, sent long").withColumn("o", F.struct("round", "queue"))
    begins = running(sent, "o", {"end": F.col("sent")}).select("queue", "round", (F.col("end") - F.col("sent")).alias("begin"))
    kind = placed.schema["doc_id"].dataType.simpleString()
    runs = placed.join(maybe_broadcast(weighed, weighed.count()), "queue").mapInArrow(tidy(cut), f"doc_id {kind}, queue string, n long, round long, inner long, first long, size long, ids binary")
    return runs.join(begins, ["queue", "round"]).select("doc_id", "queue", "first", "size", "n", "ids", (F.col("begin") + F.col("inner")).alias("at"))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, window: int = WINDOW, weights: dict[str, float] | None = None, end: int = END, keep_ids: bool = False, exponent: float = 1.0) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.

    weights: target proportions by source, over 0 (all documents are packed, so none can be left out); sources without
    one have their own share of the tokens to the power of exponent: by default just that, so that all run empty
    together; under 1 small sources come more often, until they are empty.
    keep_ids: also the piece's ids, as an array.
    """
    mix = Mix(weights or {}, exponent)
    if any(w <= 0 for w in mix.weights.values()):
        raise ValueError("target proportions must be over 0; take the documents of other sources out first")
    rows = tokenized(docs, tokenizer, end)
    sums = materialize(rows.groupBy("queue", "part").agg(F.sum("n").alias("n")), "token-sums")
    totals = materialize(sums.groupBy("queue").agg(F.sum("n").alias("total")), "queue-totals")
    many = totals.count() > QUEUES
    base = sums.select("queue", "part", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("base"))
    placed = rows.join(maybe_broadcast(base, sums.count()), ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("at")).alias("at"), "n", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    if many:
        placed, rounds = _placed(placed, totals, mix, window), None
    else:
        rounds = Rounds({r.queue: r.total for r in totals.toLocalIterator()}, mix, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            queues, starts, sizes = (batch.column(k).to_pylist() for k in ("queue", "at", "n"))
            blobs = batch.column("ids")
            given = [batch.column(k).to_pylist() for k in ("first", "size", "at")] if many else None
            for r in range(batch.num_rows):
                n, blob = sizes[r], blobs[r].as_py()
                begin, held = (given[0][r], given[1][r]) if many else (0, n)
                ids = np.frombuffer(blob, np.uint16 if len(blob) == 2 * held else np.uint32).astype("<u4")
                raw = memoryview(ids.tobytes())
                for place, first, size in [(given[2][r], 0, held)] if many else rounds.runs(queues[r], starts[r], n):
                    while size:
                        take = min(size, length - place % length)
                        for k, v in (("row", r), ("start", begin + first), ("length", take), ("ids_crc32", zlib.crc32(raw[4 * first : 4 * (first + take)])), ("doc_tokens", n), ("sequence_id", place // length), ("offset", place % length)):
                            out[k].append(v)
                        if keep_ids:
                            out["ids"].append(ids[first : first + take].astype(np.int32).tolist())
                        place, first, size = place + take, first + take, size - take
            at = pa.array(out.pop("row"), pa.int32())
            pieces = out.pop("ids")
            columns = {"doc_id": batch.column("doc_id").take(at)} | {k: pa.array(v, pa.int64()) for k, v in out.items()} | {"queue": batch.column("queue").take(at)}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(pieces, pa.list_(pa.int32()))} if keep_ids else {}))

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
    return placed.mapInArrow(tidy(run), schema + ", ids array<int>" * keep_ids)


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, window: int = WINDOW, weights: dict[str, float] | None = None, end: int = END, pad: int = END, exponent: float = 1.0) -> DataFrame:
    """sequence_id, ids (padded to length), n (ids before the padding)."""
    pieces = pack(docs, tokenizer, length, window, weights, end, keep_ids=True, exponent=exponent)
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad), length - F.size("ids"))).alias("ids"), F.size("ids").alias("n"))
