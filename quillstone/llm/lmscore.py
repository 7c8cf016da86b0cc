"""Cross-entropy difference of matched target and background bigram models over one vocabulary.

The vocabulary is every word of the documents and the edge of a text; both models know every pair of symbols that follow
each other. The background model has the pairs of all documents, the target one those of documents labelled as good. A
document is scored by both models without its own counts (leave-one-out), so it can't vouch for itself: what it shares
with other documents, a copy say, counts, its own repetitions don't. p(v|u) mixes n(u,v) / n(u), by a weight that grows
with n(u), with an add-SMOOTH unigram; the events of a text are its words and its end. The score is the mean loss per
event under the target model less that under the background model: the lower, the more like the target.

Counts meet by key, never on the driver: documents are gathered in written chunks of bounded bytes; a chunk sends its
different words and pairs, as sorted 64-bit keys with their counts, to parts of the key space; a part adds up and answers
each chunk in the order of its keys; so a hot word is one key for each chunk. A part holds about PART_KEYS keys. Written
chunks and answers are large rows, and a task holds a file's rows at once: files have about FILE_BYTES, however much of
the table a task reads. Only three totals are global. Different words or pairs with equal 64-bit hashes would share counts.

Defined cases: a document without words (null, empty) has 0 tokens and null losses and score; without other target
documents the target model is uniform; several labels of one document count as good if one does; repeated rows each get
a row (and see each other as others); a text longer than a chunk is a chunk of its own, whole; a doc_id of any type is
returned as it is; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, maybe_broadcast, ship
from .words import buffers, iter_words, mix
from .workers import release, tidy

SMOOTH = 0.5
PAIR_SHARE = 0.75
PRIOR = 1.0
CHUNK_BYTES = 4 << 20
PART_KEYS = 1_000_000
FILE_BYTES = 16 << 20
EDGE = np.uint64(0x5851F42D4C957F2D)
_WORD, _FIRST, _SECOND = (np.uint64(c) for c in (0xD1342543DE82EF95, 0xA24BAED4963EE407, 0x9FB21C651E98DF25))


class Events(NamedTuple):
    """What the documents of a chunk ask for, and how often each of them does."""

    lengths: np.ndarray  # words of each document
    keys: np.ndarray  # sorted keys of the chunk's words (last bit 1) and pairs (0)
    all: np.ndarray  # how often each key comes in the chunk's documents
    good: np.ndarray  # and in target ones
    doc: np.ndarray  # for each different pair of a document: the document,
    times: np.ndarray  # how often it holds the pair,
    pair: np.ndarray  # and the places in keys of the pair
    before: np.ndarray  # and its words
    word: np.ndarray


def events(texts: pa.Array, target: np.ndarray) -> Events:
    lengths, parts = np.zeros(len(texts), np.int64), []
    for w in iter_words(texts):
        lengths[w.first : w.last] = np.diff(w.doc)
        parts.append(w.hashes)
    words, ids = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_inverse=True)
    edge, some = len(words), np.flatnonzero(lengths)
    words = np.append(words, EDGE)
    sizes = lengths[some] + 1
    ends = np.cumsum(sizes) - 1
    v = np.full(int(sizes.sum()), edge, np.int64)
    inner = np.ones(len(v), bool)
    inner[ends] = False
    v[inner] = ids
    u = np.concatenate([[edge], v[:-1]])[: len(v)]  # the end of one text stands before the next
    of = np.repeat(some, sizes)
    code, pair = np.unique(u * (edge + 1) + v, return_inverse=True)
    own, times = np.unique(of * max(1, len(code)) + pair, return_counts=True)
    doc, pair_of = np.divmod(own, max(1, len(code)))
    first, second = np.divmod(code, edge + 1)
    good = target[doc] * times
    counts = [np.bincount(pair_of, x, len(code)) for x in (times, good)]
    of_words = [np.bincount(second, c, edge + 1) for c in counts]
    keys = np.concatenate([mix(words * _WORD) | np.uint64(1), mix(words[first] * _FIRST + words[second] * _SECOND) & ~np.uint64(1)])
    if not len(some):
        keys, of_words = keys[:0], [c[:0] for c in of_words]
    order = np.argsort(keys)
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    merged = [np.concatenate([a, b])[order] for a, b in zip(of_words, counts, strict=True)]
    return Events(lengths, keys[order], *(m.astype(np.uint32) for m in merged), doc, times, place[edge + 1 + pair_of], place[first[pair_of]], place[second[pair_of]])


def chunked(docs: DataFrame, size: int) -> DataFrame:
    """A written row for each chunk of about size bytes: chunk, bytes of its texts; doc_id, text and target arrays."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        waiting, held = [], 0

        def emit() -> pa.RecordBatch:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            columns = {c: pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole.column(c).combine_chunks()) for c in whole.column_names}
            held_bytes = pc.sum(pc.binary_length(whole.column("text"))).as_py() or 0
            return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "bytes": pa.array([held_bytes], pa.int64())} | columns)

        for batch in batches:
            offsets, _ = buffers(batch.column("text"))
            at = 0
            while at < batch.num_rows:
                fit = int(np.searchsorted(offsets, offsets[at] + size - held, "right")) - 1
                if fit > at or not held:
                    part = batch.slice(at, max(1, fit - at))
                    waiting.append(part)
                    held += int(offsets[at + part.num_rows] - offsets[at]) + part.num_rows
                    at += part.num_rows
                if at < batch.num_rows or held >= size:
                    yield emit()
                    chunk, waiting, held = chunk + 1, [], 0
        if waiting:
            yield emit()

    rows = docs.select("doc_id", "text", "target").mapInArrow(tidy(run), f"chunk long, bytes long, doc_id array<{kind}>, text array<string>, target array<boolean>")
    return materialize(rows, "chunks", file_rows=max(1, FILE_BYTES // size))


def asked(chunks: DataFrame, parts: int) -> DataFrame:
    """A row for each chunk and part of the key space that it asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                e = events(batch.column("text")[r].values, batch.column("target")[r].values.to_numpy(zero_copy_only=False).astype(bool))
                of = ((e.keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                cuts = np.searchsorted(of, np.arange(parts + 1, dtype=np.uint64))
                held = [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([p for p, _, _ in held], pa.int32()), "chunk": pa.array([batch.column("chunk")[r].as_py()] * len(held), pa.int64()),
                    **{c: pa.array([v[a:b].tobytes() for _, a, b in held], pa.binary()) for c, v in (("keys", e.keys), ("all", e.all), ("good", e.good))},
                })

    return chunks.select("chunk", "text", "target").mapInArrow(tidy(run), "part int, chunk long, keys binary, all binary, good binary")


def _sum(asks: pa.Table) -> pa.Table:
    """Answers to the chunks that ask one part, in the order of their keys; told once: different words, and events of both models."""
    blobs = [[x.as_py() for x in asks.column(c)] for c in ("keys", "all", "good")]
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in blobs[0]])
    order = np.argsort(keys)
    ranked = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    cuts = np.cumsum([0, *(len(x) // 8 for x in blobs[0])]).tolist()
    are_words = (ranked[starts] & np.uint64(1)).astype(bool)
    told = {"words": int(are_words.sum())}
    out = {"part": asks.column("part"), "chunk": asks.column("chunk")}
    for c, own in zip(("all", "good"), blobs[1:], strict=True):
        sums = np.add.reduceat(np.concatenate([np.frombuffer(x, np.uint32) for x in own]).astype(np.int64)[order], starts)
        told[f"n_{c}"] = int(sums[are_words].sum())
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(sums, sizes)
        out[c] = pa.array([total[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
    out |= {k: pa.array([v] + [0] * (len(cuts) - 2), pa.int64()) for k, v in told.items()}
    release()
    return pa.table({c: out[c] for c in ("part", "chunk", "words", "n_all", "n_good", "all", "good")})


def losses(e: Events, target: np.ndarray, answers: list[np.ndarray], totals: list[int], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean background and target losses of a chunk's documents, each without its own counts (NaN without words)."""
    n, pairs = len(e.lengths), len(e.doc)
    # a document's own counts of the word before and of the word, summed over its different pairs
    own = []
    for at in (e.before, e.word):
        ids, back = np.unique(e.doc * (len(e.keys) + 1) + at, return_inverse=True)
        own.append(np.bincount(back, e.times, len(ids))[back] if pairs else np.zeros(0))
    out = []
    for total, whole, mine in ((answers[0], totals[0], np.ones(n)), (answers[1], totals[1], target.astype(float))):
        keep = mine[e.doc]
        both = total[e.pair] - keep * e.times
        before, word = (total[at] - keep * o for at, o in zip((e.before, e.word), own, strict=True))
        rest = whole - mine * np.where(e.lengths > 0, e.lengths + 1, 0)
        single = (word + SMOOTH) / (rest[e.doc] + SMOOTH * words)
        p = PAIR_SHARE * both / (before + PRIOR) + (1 - PAIR_SHARE * before / (before + PRIOR)) * single
        out.append(np.bincount(e.doc, -np.log(p) * e.times, n) / np.where(e.lengths > 0, e.lengths + 1, np.nan))
    return out[0], out[1]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats per event), score (their difference)."""
    ship(docs.sparkSession)
    good = materialize(labels.where("quality > 0 and doc_id is not null").select("doc_id").distinct(), "target-ids")
    marks = maybe_broadcast(good.select("doc_id", F.lit(True).alias("target")), good.count())
    rows = docs.select("doc_id", "text").join(marks, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    chunks = chunked(rows, CHUNK_BYTES)
    held = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    parts = max(1, -(-held.bytes // (6 * PART_KEYS)))  # texts have about a key for each six bytes
    answers = asked(chunks, parts).groupBy("part").applyInArrow(_sum, "part int, chunk long, words long, n_all long, n_good long, all binary, good binary")
    answers = materialize(answers, "answers", file_rows=max(1, FILE_BYTES * held.n // (16 * PART_KEYS)))  # a row for each chunk and part, 16 bytes a key
    told = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "n_all", "n_good")]).first()
    words, totals = told.words, [told.n_all, told.n_good]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(chunk: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("part")
        got = [np.frombuffer(b"".join(x.as_py() for x in found.column(c)), np.int64) if found.num_rows else np.zeros(0, np.int64) for c in ("all", "good")]
        ids, texts, target = (chunk.column(c).combine_chunks()[0].values for c in ("doc_id", "text", "target"))
        good_ones = target.to_numpy(zero_copy_only=False).astype(bool)
        e = events(texts, good_ones)
        b, t = losses(e, good_ones, got, totals, words)
        release()
        return pa.table({"doc_id": ids, "n_tokens": pa.array(e.lengths), **{c: pa.array(x, from_pandas=True) for c, x in (("target_loss", t), ("background_loss", b), ("score", t - b))}})

    both = chunks.drop("bytes").groupBy("chunk").cogroup(answers.select("chunk", "part", "all", "good").groupBy("chunk"))
    return both.applyInArrow(finish, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")
