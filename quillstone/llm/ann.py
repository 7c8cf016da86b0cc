"""Approximate nearest neighbours by balanced posting lists.

Centroids are the leaves of balanced two-way splits of a bounded sample (EACH vectors for each list, SAMPLE at least,
chosen by a hash of the id), about one for each LIST vectors of the table, up to MAX_LISTS (beyond that lists grow with
the table), and stay in memory with a graph of near centroids. Every vector of the
table goes to its nearest centroid's list, found through the graph; a boundary vector, to which other centroids are
almost as near, also to theirs. A query reads the lists whose centroids are within a ratio of its nearest one's
distance; the ratio is fitted on the sample, so that the lists hold TARGET of the sample's true neighbours.

Lists and their queries meet in units of bounded rows: near lists share a unit, a list of many vectors (copies of one,
say) is dealt out over several, and a unit's queries come in parts. A unit returns the nearest of all that a query reads
there, so that few rows are shuffled for a query. Distances are exact, in double precision, on the original vectors. A
query that finds too few candidates in its lists is compared with all rows, in blocks. The walk's entries are each
ENTRY-th centroid, compared at once; from the nearest of them it follows links.

Defined cases: vectors that are null, zero, or hold null or non-finite components, rows without an id, and vectors
whose length isn't the sample's most common one take no part; rows that repeat an id and vector count once; ties go to
the smaller id; with fewer candidates than asked all are returned; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, maybe_broadcast, ship
from .workers import tidy

SAMPLE = 20_000
EACH = 8
LIST = 128
MAX_LISTS = 16_384
DEGREE = 16
BEAM = 24
VISIT = 6
ENTRY = 4
REPLICAS = 4
BOUNDARY = 1.05
TARGET = 0.97
FIT_QUERIES = 256
FIT_ROWS = 512
BLOCK = 2_048
QUERY_BLOCK = 1_024
UNITS = 32
UNIT_ROWS = (1_024, 32_768)
UNIT_QUERIES = 16_384
PAIRS = 16_384
WALKS = 1_024
TOP = 10


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of the leaves of splits into halves of equal size, along the line between two means."""
    leaves = [np.arange(len(x))]
    while len(leaves) < lists:
        nxt = []
        for ids in leaves:
            if len(ids) < 2:
                nxt.append(ids)
                continue
            part = x[ids]
            axis = part[np.argmax(((part - part.mean(0)) ** 2).sum(1))] - part.mean(0)
            for _ in range(4):
                order = np.argsort(part @ axis, kind="stable")
                half = len(ids) // 2
                axis = part[order[half:]].mean(0) - part[order[:half]].mean(0)
            order = np.argsort(part @ axis, kind="stable")
            nxt += [ids[order[: len(ids) // 2]], ids[order[len(ids) // 2 :]]]
        if len(nxt) == len(leaves):
            break
        leaves = nxt
    means = np.array([x[i].mean(0) for i in leaves])
    return means[np.sort(np.unique(means, axis=0, return_index=True)[1])]


class Centroids:
    """Centroids and their graph: links to and from each one's nearest. Some of them are entries, compared at once."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        n = len(points)
        near = np.zeros((n, min(DEGREE, max(1, n - 1))), np.int64)
        for a in range(0, n, 1024):
            d = _distances(points[a : a + 1024], points)
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            near[a : a + 1024] = np.argsort(d, axis=1, kind="stable")[:, : near.shape[1]]
        # links back, as many again for each centroid; its own nearest fill what is left
        to, of = near.T.ravel(), np.tile(np.arange(n), near.shape[1])
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        back = near.copy()
        keep = place < near.shape[1]
        back[to[keep], place[keep]] = of[keep]
        self.links = np.concatenate([near, back], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, max(min(n, 16), n // ENTRY)).astype(np.int64))

    def walk(self, x: np.ndarray, beam: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Best first through the graph: the centroids that each row of x met, nearest first, and their distances.

        Rows are padded with distances of inf. A walk visits, a few at a time, centroids among its beam nearest or within
        ratio of the nearest, until there are no more; it keeps what it met and measures no centroid twice, so its cost
        follows the centroids met, not their number.
        """
        n, m = len(self.points), len(x)
        x, points = x.astype(np.float32), self.points.astype(np.float32)
        norms, sizes = (points * points).sum(1), (x * x).sum(1)
        far = sizes[:, None] + norms[self.entries] - 2 * (x @ points[self.entries].T)
        kept = min(beam, far.shape[1])
        first = np.argpartition(far, kept - 1, axis=1)[:, :kept]
        met, far = self.entries[first], np.maximum(np.take_along_axis(far, first, 1), 0)
        seen = np.zeros(m * n, bool)
        seen[(np.arange(m)[:, None] * n + met).ravel()] = True
        visited = np.zeros(met.shape, bool)
        rows = np.arange(m)
        out = []
        while True:
            order = np.argsort(far, axis=1)
            met, far, visited = (np.take_along_axis(v, order, 1) for v in (met, far, visited))
            limit = np.maximum(far[:, :1] * ratio**2, far[:, min(beam, far.shape[1]) - 1][:, None])
            open_ = ~visited & (far <= limit) & np.isfinite(far)
            go = open_.any(1)
            if not go.all():
                out.append((rows[~go], met[~go], far[~go]))
                rows, met, far, visited, open_ = rows[go], met[go], far[go], visited[go], open_[go]
            if not len(rows):
                break
            now = open_ & (np.cumsum(open_, axis=1) <= VISIT)
            visited |= now
            r, c = np.nonzero(now)
            new = (rows[r][:, None] * n + self.links[met[r, c]]).ravel()
            new = np.unique(new[~seen[new]])
            seen[new] = True
            r, c = np.divmod(new, n)
            d = np.empty(len(r), np.float32)
            for k in range(0, len(r), PAIRS):
                i, j = r[k : k + PAIRS], c[k : k + PAIRS]
                d[k : k + PAIRS] = sizes[i] + norms[j] - 2 * np.einsum("ij,ij->i", x[i], points[j])
            at = np.searchsorted(rows, r)
            counts = np.bincount(at, minlength=len(rows))
            width = int(counts.max())
            place = np.arange(len(r)) - (np.cumsum(counts) - counts)[at]
            more, dist = np.zeros((len(rows), width), np.int64), np.full((len(rows), width), np.inf, np.float32)
            more[at, place], dist[at, place] = c, np.maximum(d, 0)
            met, far = np.concatenate([met, more], axis=1), np.concatenate([far, dist], axis=1)
            visited = np.concatenate([visited, np.zeros(more.shape, bool)], axis=1)
        width = max(v.shape[1] for _, v, _ in out)
        all_met, all_far = np.zeros((m, width), np.int64), np.full((m, width), np.inf)
        for r, v, d in out:
            all_met[r, : v.shape[1]], all_far[r, : v.shape[1]] = v, np.sqrt(d)
        return all_met, all_far

    def assign(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists of each vector: its nearest centroid's, and those almost as near that aren't behind one taken already."""
        met, far = self.walk(x, BEAM, BOUNDARY)
        out = [v for v in met[:, :1]]  # most vectors lie near one centroid only
        for row in np.flatnonzero((far[:, 1:2] <= far[:, :1] * BOUNDARY).any(1)).tolist():
            ids, d = met[row], far[row]
            near = ids[: 4 * REPLICAS][d[: 4 * REPLICAS] <= d[0] * BOUNDARY]
            taken = [near[0]]
            for c, own in zip(near[1:], d[1:], strict=False):
                if len(taken) >= REPLICAS:
                    break
                if all(((self.points[c] - self.points[t]) ** 2).sum() > own**2 / 4 for t in taken):
                    taken.append(c)
            out[row] = np.array(taken)
        return out

    def probe(self, x: np.ndarray, ratio: float) -> list[np.ndarray]:
        """The lists that queries read: centroids within ratio of the nearest one's distance."""
        met, far = self.walk(x, BEAM, ratio)
        return [np.sort(ids[d <= d[0] * ratio + 1e-12]) for ids, d in zip(met, far, strict=True)]


def fit(x: np.ndarray, rows: int, top: int = TOP, target: float = TARGET) -> tuple[Centroids, float]:
    """Centroids for a table of so many rows, and the ratio at which the sample's lists hold target of its neighbours."""
    centroids = Centroids(balanced_centroids(x, min(lists_for(rows), max(1, len(x) // EACH))))
    picks = np.unique(np.linspace(0, len(x) - 1, min(len(x), FIT_QUERIES)).astype(np.int64))
    near = np.empty((len(picks), min(top, len(x) - 1)), np.int64)
    if not near.size:
        return centroids, 1.0
    for a in range(0, len(picks), 64):  # a few queries at a time: the sample may be large
        d = _distances(x[picks[a : a + 64]], x)
        d[np.arange(len(d)), picks[a : a + 64]] = np.inf
        near[a : a + 64] = np.argsort(d, axis=1, kind="stable")[:, : near.shape[1]]
    wanted, back = np.unique(near, return_inverse=True)
    lists_of = [v for a in range(0, len(wanted), FIT_ROWS) for v in centroids.assign(x[wanted[a : a + FIT_ROWS]])]
    width = max(map(len, lists_of))
    padded = np.array([np.pad(v, (0, width - len(v)), "edge") for v in lists_of])[back.reshape(near.shape)]
    to = _distances(x[picks], centroids.points)
    best = to[np.arange(len(picks))[:, None, None], padded].min(2)
    needed = best / np.maximum(to.min(1, keepdims=True), 1e-12)
    return centroids, float(max(1.0, np.quantile(needed, target, method="higher")) + 1e-9)


def lists_for(rows: int) -> int:
    """The number of lists of a table of so many rows."""
    return min(MAX_LISTS, 1 << max(0, math.ceil(math.log2(max(1, rows / LIST)))))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best(q: np.ndarray, ids: np.ndarray, exact: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The top different ids of each query row, ties to the smaller id."""
    order = np.lexsort((exact, ids, q))
    q, ids, exact = q[order], ids[order], exact[order]
    once = np.concatenate([[True], (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])])[: len(q)]
    q, ids, exact = q[once], ids[once], exact[once]
    order = np.lexsort((ids, exact, q))
    q, ids, exact = q[order], ids[order], exact[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < top
    return q[keep], ids[keep], exact[keep]


def _nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, top: int, reads=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, ids, exact distances) of the top rows for each query, its own id left out.

    reads(a, b), if given, tells which rows of x the queries a to b may take. Pieces bound what is held at a time.
    """
    norms, out = (x * x).sum(1), []
    for a in range(0, len(q), QUERY_BLOCK):
        part, mine = q[a : a + QUERY_BLOCK], q_ids[a : a + QUERY_BLOCK]
        may = reads(a, a + len(part)) if reads else None
        sizes = (part * part).sum(1)[:, None]
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for b in range(0, len(x), BLOCK):
            piece, ids = x[b : b + BLOCK], x_ids[b : b + BLOCK]
            d = sizes + norms[b : b + BLOCK] - 2 * (part @ piece.T)
            d[(mine[:, None] == ids) if may is None else (mine[:, None] == ids) | ~may(b, b + len(ids))] = np.inf
            kth = min(top, len(ids)) - 1
            slack = 1e-12 * (sizes + norms[b : b + BLOCK].max())  # more than rounding can move a squared distance
            r, c = np.nonzero((d <= np.partition(d, kth, axis=1)[:, kth, None] + slack) & np.isfinite(d))
            exact = np.empty(len(r))
            for k in range(0, len(r), PAIRS):
                exact[k : k + PAIRS] = np.sqrt(((part[r[k : k + PAIRS]] - piece[c[k : k + PAIRS]]) ** 2).sum(1))
            best = _best(*(np.concatenate(v) for v in zip(best, (r, ids[c], exact), strict=True)), top)
        out.append((best[0] + a, best[1], best[2]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def units_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first unit and the number of units of each list, by its rows: small lists in a row share one."""
    size = int(min(UNIT_ROWS[1], max(UNIT_ROWS[0], -(-counts.sum() // UNITS))))
    first, many = np.zeros(len(counts), np.int64), -(-counts // size)
    unit = filled = 0
    for i, n in enumerate(counts):
        if filled and filled + n > size:
            unit, filled = unit + 1, 0
        first[i], filled = unit, filled + n
        if n > size:
            unit, filled = unit + int(many[i]), 0
    return first, many


_FOUND = "query_id long, vec_id long, score double"


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id (long) and embedding (doubles) of the rows that take part, whatever their length."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda v: v != 0))


def search(vectors: DataFrame, every: int = 100, top: int = TOP, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) for the rows whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    ship(spark)
    rows = valid(vectors)
    n = rows.count()
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample, EACH * lists_for(n))).toArrow() if n else None
    if not n or picked is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = pc.list_value_length(picked.column("embedding")).to_numpy()
    dim = int(np.bincount(lengths).argmax())
    base = _matrix(picked.column("embedding").combine_chunks().filter(pa.array(lengths == dim)))
    centroids, ratio = fit(base, n, top, target)
    shared = spark.sparkContext.broadcast(centroids)
    rows = rows.where(F.size("embedding") == dim)
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        step = WALKS
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                yield part, _matrix(part.column("embedding"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in pieces(batches):
            lists = shared.value.assign(x)
            at = pa.array(np.repeat(np.arange(len(lists)), [len(v) for v in lists]))
            yield pa.RecordBatch.from_pydict({"list": pa.array(np.concatenate(lists).astype(np.int32)), "vec_id": part.column("vec_id").take(at), "embedding": part.column("embedding").take(at)})

    postings = materialize(rows.mapInArrow(tidy(place), "list int, vec_id long, embedding array<double>"), "postings")
    counts = np.zeros(len(centroids.points), np.int64)
    held = postings.groupBy("list").count().toArrow()  # a row for each list: MAX_LISTS at most
    counts[held.column("list").to_numpy()] = held.column("count").to_numpy()
    first, many = units_of(counts)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in pieces(batches):
            lists = shared.value.probe(x, ratio)
            flat = np.concatenate(lists)
            n = many[flat]
            row = np.repeat(np.repeat(np.arange(len(lists)), [len(v) for v in lists]), n)
            unit = np.repeat(first[flat] - np.cumsum(n) + n, n) + np.arange(n.sum())
            starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (unit[1:] != unit[:-1])])[: len(row)])
            at = pa.array(row[starts])
            read = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(np.repeat(flat, n).astype(np.int32)))
            yield pa.RecordBatch.from_pydict({"unit": pa.array(unit[starts]), "vec_id": part.column("vec_id").take(at), "embedding": part.column("embedding").take(at), "lists": read})

    probes = materialize(queries.mapInArrow(tidy(probe), "unit long, vec_id long, embedding array<double>, lists array<int>"), "probes")
    spread = F.broadcast(spark.createDataFrame(pd.DataFrame({"list": np.arange(len(first), dtype=np.int32), "first": first, "many": many}), "list int, first long, many long"))
    parts = materialize(probes.groupBy("unit").agg(F.ceil(F.count("*") / UNIT_QUERIES).cast("int").alias("parts")), "unit-parts")
    parts = maybe_broadcast(parts, parts.count())
    left = postings.join(spread, "list").withColumn("unit", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("many"))).join(parts, "unit")
    left = left.select("unit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "list", "vec_id", "embedding")
    right = probes.join(parts, "unit").select("unit", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "embedding", "lists")

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        here, of = np.unique(a["list"].to_numpy(), return_inverse=True)
        wanted, q_ids = b["lists"].to_numpy(), b["vec_id"].to_numpy()

        def reads(lo: int, hi: int):
            takes = np.array([np.isin(here, v) for v in wanted[lo:hi]])
            return lambda c, d: takes[:, of[c:d]]

        r, ids, score = _nearest(np.stack(b["embedding"]), q_ids, np.stack(a["embedding"]), a["vec_id"].to_numpy(), top, reads)
        return pd.DataFrame({"query_id": q_ids[r], "vec_id": ids, "score": score})

    on = ["unit", "part"]
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(meet, _FOUND)
    found = materialize(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "found")

    short = queries.select("vec_id", "embedding").dropDuplicates(["vec_id"]).join(
        found.groupBy("query_id").agg(F.count("*").alias("got")).where(F.col("got") >= top), F.col("vec_id") == F.col("query_id"), "left_anti")
    short = materialize(short, "short")
    left_over = short.count()
    turns = -(-left_over // QUERY_BLOCK)
    for turn in range(turns):  # queries whose lists hold too few candidates: all rows, a block of queries at a time
        few = short.where(F.pmod(F.xxhash64("vec_id"), F.lit(turns)) == turn).toArrow()
        if not few.num_rows:
            continue
        some = spark.sparkContext.broadcast((_matrix(few.column("embedding").combine_chunks()), few.column("vec_id").to_numpy()))

        def scan(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            q, q_ids = some.value
            for batch in batches:
                if batch.num_rows:
                    r, ids, score = _nearest(q, q_ids, _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy(), top)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(q_ids[r]), "vec_id": pa.array(ids), "score": pa.array(score)})

        more = rows.mapInArrow(tidy(scan), _FOUND)
        found = found.unionByName(more).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= top)
