"""Toxicity by the nearest labelled examples: exact TF-IDF cosine from a block-max inverted index, weighted votes.

The examples are a bounded sample of labelled documents (POSITIVE + NEGATIVE at most, chosen by a hash of the id).
Terms are words and, since words are inflected, their first 4 to 6 bytes. The vector space holds the terms whose share
of toxic examples exceeds that of others by a clear margin (all of them; the sample's rows bound their number), since
votes of words common to all documents say nothing. A document's
K nearest examples vote, weighted by cosine and by how many labelled documents an example stands for; a monotone map
fitted to the examples' own leave-one-out votes turns votes into rates. The evidence is the nearest examples.

Defined cases: a null or empty text, and one without any such word, gets the rate of examples without such words;
without labels every score is 0; several labels of one document count as toxic if one does; of equal cosines the example
of the smaller id is nearer; texts of any length are read whole; ids may have any type; repeated rows each get a row; an
empty table gives no rows; further columns, of any name, are ignored (score) or kept (reject).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, ship
from .words import Words, iter_words
from .workers import tidy

POSITIVE = 4_000
NEGATIVE = 12_000
LEAST_Z = 5.0
LEAST_LIFT = 10.0
LEAST_DOCS = 3
K = 25
BLOCK = 64
PREFIXES = (4, 5, 6)
CUT = 0.3
HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def _terms(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in zip(w.doc[:-1].tolist(), w.doc[1:].tolist(), strict=True):
        h, n = np.unique(np.concatenate([w.hashes[a:b], *(p[a:b] for p in w.prefixes)]), return_counts=True)
        yield h[h != 0], n[h != 0]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all half-open ranges, one range after the other."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class BlockMaxIndex:
    """Postings by term, cut into blocks of BLOCK examples that each know their largest weight."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int) -> None:
        self.n = len(vectors)
        self.blocks = -(-self.n // BLOCK)
        entries = sorted((t, i, x) for i, v in enumerate(vectors) for t, x in v.items())
        terms = np.array([t for t, _, _ in entries], np.int64)
        self.rows = np.array([i for _, i, _ in entries], np.int64)
        self.weights = np.array([x for _, _, x in entries])
        key = terms * max(1, self.blocks) + self.rows // BLOCK
        # only blocks that hold a term are stored, so size follows the postings, whatever the number of terms
        self.ptr = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        held = key[self.ptr[:-1]]
        self.block = held % max(1, self.blocks)
        self.top = np.maximum.reduceat(self.weights, self.ptr[:-1]) if len(held) else np.zeros(0)
        self.of_term = np.searchsorted(held, np.arange(n_terms + 1) * max(1, self.blocks))

    def search(self, query: dict[int, float], k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of the largest dot products over 0 (ties: the smaller row) and those products; exact.

        Blocks are read by descending bound, ever more at a time, until no bound reaches the k-th best product.
        """
        terms = np.fromiter(query, np.int64, len(query))
        q = np.fromiter(query.values(), float, len(query))
        at = _ranges(self.of_term[terms], self.of_term[terms + 1])
        each = np.repeat(q, self.of_term[terms + 1] - self.of_term[terms])
        held = self.block[at]
        bound = np.bincount(held, each * self.top[at], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        done, step = 0, 2
        while done < len(order) and (len(rows) < k or bound[order[done]] >= scores[-1] - 1e-12):
            blocks = order[done : done + step]
            done, step = done + step, step * 2
            now = np.isin(held, blocks)
            starts, ends = self.ptr[at[now]], self.ptr[at[now] + 1]
            of = _ranges(starts, ends)
            acc = np.bincount(self.rows[of], np.repeat(each[now], ends - starts) * self.weights[of], self.n)
            if skip >= 0:
                acc[skip] = 0
            found = np.flatnonzero(acc)
            rows, scores = np.concatenate([rows, found]), np.concatenate([scores, acc[found].round(12)])
            best = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[best], scores[best]
        return rows, scores


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: ascending knots and values."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # lowest x, sum of w*y, sum of w
    for i in order.tolist():
        if pools and x[i] == pools[-1][3]:
            pools[-1][1] += w[i] * y[i]
            pools[-1][2] += w[i]
        else:
            pools.append([x[i], w[i] * y[i], w[i], x[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a = pools.pop()
            pools[-1][1] += a[1]
            pools[-1][2] += a[2]
            pools[-1][3] = a[3]
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Model:
    """Vocabulary, index, votes and calibration; small enough to broadcast (POSITIVE and NEGATIVE bound it)."""

    def __init__(self, keys: np.ndarray, idf: np.ndarray, examples: list[tuple[str, int, float, dict[int, int]]]) -> None:
        self.keys, self.idf = keys, idf
        whole = sum(w for _, _, w, _ in examples)
        self.prior = sum(w * y for _, y, w, _ in examples) / whole if whole else 0.0
        vectors = [(i, y, w, self.vector(tf)) for i, y, w, tf in examples]
        none = [(y, w) for _, y, w, v in vectors if not v]
        self.zero = sum(y * w for y, w in none) / sum(w for _, w in none) if none else self.prior
        some = sorted(((i, y, w, v) for i, y, w, v in vectors if v), key=lambda e: (max(e[3], key=lambda t: (e[3][t], -t)), len(e[0]), e[0]))
        self.ids = [e[0] for e in some]
        self.y = np.array([e[1] for e in some], np.int64)
        self.w = np.array([e[2] for e in some])
        self.index = BlockMaxIndex([e[3] for e in some], len(keys))
        self.knots = np.array([0.0])
        self.rates = np.array([self.prior])
        if some:
            raw = np.array([self._vote(*self.index.search(e[3], K, skip=k)) for k, e in enumerate(some)])
            self.knots, self.rates = _monotone(raw, self.y, self.w)
        self.seen: dict[tuple, tuple] = {}

    def vector(self, tf: dict[int, int]) -> dict[int, float]:
        v = {t: (1 + math.log(n)) * self.idf[t] for t, n in sorted(tf.items())}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    def _vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        w = cosines * self.w[rows]
        return float((w @ self.y[rows] + self.prior) / (w.sum() + 1))

    def score(self, tf: dict[int, int]) -> tuple[float, list[dict]]:
        if not tf or not len(self.ids):
            return float(self.zero), []
        key = tuple(sorted(tf.items()))
        if key not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            rows, cosines = self.index.search(self.vector(tf), K)
            vote = self._vote(rows, cosines)
            rate = float(self.rates[max(0, int(np.searchsorted(self.knots, vote, "right")) - 1)])
            near = [{"doc_id": self.ids[r], "cosine": float(c), "toxic": int(self.y[r])} for r, c in zip(rows[:3], cosines[:3], strict=True)]
            self.seen[key] = (min(1.0, max(0.0, 0.99 * rate + 0.01 * vote)), near)
        return self.seen[key]

    def counts(self, w: Words) -> list[dict[int, int]]:
        """For each document the counts of its terms of the vocabulary."""
        out: list[dict[int, int]] = [{} for _ in range(w.last - w.first)]
        for hashes in (w.hashes, *w.prefixes) if len(self.keys) else ():
            maybe = np.flatnonzero(self._table()[hashes >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == hashes[maybe]
            docs = np.searchsorted(w.doc, maybe[hit], "right") - 1
            for d, t in zip(docs.tolist(), at[hit].tolist(), strict=True):
                out[d][t] = out[d].get(t, 0) + 1
        return out

    def _table(self) -> np.ndarray:
        if "table" not in self.__dict__:
            self.table = np.zeros(1 << 20, bool)
            self.table[self.keys >> np.uint64(44)] = True
        return self.table

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"} | {"seen": {}}


def fit(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> Model:
    """Learn from the labels of documents that aren't held out."""
    ship(docs.sparkSession)
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).where(~held_out(F.col("doc_id")))
    totals = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    pick = lambda y, n: marks.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = materialize(pick(1, positive).union(pick(0, negative)), "label-sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in iter_words(batch.column("text"), PREFIXES):
                rows = list(_terms(w))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(w.first, w.last - w.first), "toxic": batch.column("toxic").slice(w.first, w.last - w.first),
                    "h": pa.array([h.view(np.int64) for h, _ in rows], pa.list_(pa.int64())), "tf": pa.array([c.astype(np.int32) for _, c in rows], pa.list_(pa.int32())),
                })

    rows = materialize(texts.select(F.col("doc_id").cast("string"), "toxic", "text").mapInArrow(tidy(run), "doc_id string, toxic int, h array<long>, tf array<int>"), "label-words")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    weight = {y: max(1.0, totals.get(y, 0) / max(1, n.get(y, 0))) for y in (0, 1)}
    found: list = []
    if n1 and n0:
        df = rows.select("toxic", F.explode("h").alias("h")).groupBy("h").agg(F.sum("toxic").alias("a"), F.count("*").alias("df")).where(F.col("a") >= LEAST_DOCS)
        p1, p0 = F.col("a") / n1, (F.col("df") - F.col("a")) / n0
        p = F.col("df") / (n1 + n0)
        z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
        found = df.select("h", "df", z.alias("z"), p1.alias("p1"), p0.alias("p0")).where((F.col("z") >= LEAST_Z) & (F.col("p1") >= LEAST_LIFT * F.col("p0"))).orderBy("h").collect()
    keys = np.array([r.h for r in found], np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    idf = np.log((1 + n1 + n0) / (1 + np.array([r.df for r in found], float)))[order] + 1e-9
    at = {int(k): i for i, k in enumerate(keys.view(np.int64))}
    examples = []
    if len(keys):
        vocabulary = rows.sparkSession.createDataFrame([(int(k),) for k in keys.view(np.int64)], "h long")
        hits = rows.select("doc_id", "toxic", F.explode(F.arrays_zip("h", "tf")).alias("x")).select("doc_id", "toxic", "x.h", "x.tf").join(F.broadcast(vocabulary), "h")
        found_tf: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)
        for r in hits.toLocalIterator():
            found_tf[r.doc_id, r.toxic][at[r.h]] = r.tf
        for r in rows.select("doc_id", "toxic").toLocalIterator():
            examples.append((r.doc_id, r.toxic, weight[r.toxic], dict(sorted(found_tf.get((r.doc_id, r.toxic), {}).items()))))
    else:
        examples = [(r.doc_id, r.toxic, weight[r.toxic], {}) for r in rows.select("doc_id", "toxic").toLocalIterator()]
    examples.sort(key=lambda e: (len(e[0]), e[0], e[1]))  # integers in their order
    return Model(keys, idf, examples)


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (nearest examples: doc_id, cosine, toxic)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for w in iter_words(batch.column("text"), PREFIXES):
                n = w.last - w.first
                got = [m.score(tf) for tf in m.counts(w)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(w.first, n), "held_out": batch.column("held_out").slice(w.first, n),
                    "score": pa.array([s for s, _ in got], pa.float64()), "predicted": pa.array([int(s >= cut) for s, _ in got], pa.int32()),
                    "evidence": pa.array([e for _, e in got], pa.list_(pa.struct([("doc_id", pa.string()), ("cosine", pa.float64()), ("toxic", pa.int32())]))),
                })

    scored = rows.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, score double, predicted int, evidence array<struct<doc_id:string,cosine:double,toxic:int>>")
    return scored.withColumn("evidence", F.col("evidence").cast(f"array<struct<doc_id:{kind},cosine:double,toxic:int>>"))


def reject(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """docs without those that score cut or more."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            keep: list[bool] = []
            for w in iter_words(batch.column("text"), PREFIXES):
                keep += [m.score(tf)[0] < cut for tf in m.counts(w)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
