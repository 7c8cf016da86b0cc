"""Causal order: byte-trigram successor scores within blocks, and the order that they suggest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, ship

TAIL, PROBE = 16 * 1024, 4 * 1024
BATCH_ROWS = 1 << 16


_PAIRS = pa.array([f"{k:04X}" for k in range(1 << 16)])
_ONES = pa.array([f"{k:02X}" for k in range(256)])


def grams(docs: DataFrame, probe: int = PROBE, tail: int = TAIL, kept: tuple[str, ...] = ("probe", "tail")) -> DataFrame:
    """block, doc_id, kind (of those kept: tail or probe), ctx, sym, n: trigram counts of the last and the first bytes.

    A text's are counted in place. A batch of 8 MB of short texts has some ten million of them, so they leave in batches
    of their own, of BATCH_ROWS and what one text adds to them.
    """
    ship(docs.sparkSession)
    some = docs.select("block", "doc_id", "text")
    kinds = {f.name: f.dataType.simpleString() for f in some.schema}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            sizes = [len(g) for _, _, g, _ in found]
            at, gram = pa.array(np.repeat([r for r, *_ in found], sizes)), np.concatenate([g for _, _, g, _ in found])
            return pa.RecordBatch.from_pydict({
                "block": batch.column("block").take(at), "doc_id": batch.column("doc_id").take(at), "kind": pa.array(np.repeat([k for _, k, _, _ in found], sizes)),
                "ctx": _PAIRS.take(pa.array(gram >> 8)), "sym": _ONES.take(pa.array(gram & 255)), "n": pa.array(np.concatenate([n for *_, n in found]))})

        for batch in batches:
            found, held = [], 0
            for r, text in enumerate(batch.column("text")):
                raw = (text.as_py() or "").encode()
                for kind, part in (("probe", raw[:probe]), ("tail", raw[-tail:])):
                    if kind in kept and len(part) > 2:
                        b = np.frombuffer(part, np.uint8).astype(np.int64)
                        found.append((r, kind, *np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:], return_counts=True)))
                        held += len(found[-1][2])
                if held >= BATCH_ROWS:
                    yield rows()
                    found, held = [], 0
            if found:
                yield rows()

    return some.mapInArrow(count, f"block {kinds['block']}, doc_id {kinds['doc_id']}, kind string, ctx string, sym string, n long")


def _keys(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams, then their contexts (from 2^24), and how often each comes."""
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    context = b[:-2] << 8 | b[1:-1]
    return np.unique(np.concatenate([context << 8 | b[2:], context + (1 << 24)]), return_counts=True)


def edge_scores(docs: DataFrame, probe: int = PROBE, tail: int = TAIL) -> DataFrame:
    """block, source, target, bits of coding target's first bytes adaptively after source's last, for all pairs of a block.

    Only probe + tail bytes of a document travel, so a block of bounded documents is a bounded task. A key that comes m
    times after t times costs grown(t + m) - grown(t), whatever the order, so a target is scored against all tails of its
    block at once.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    ends = docs.select("block", "doc_id", F.substring(raw, 1, probe).alias("head"), F.when(F.length(raw) > tail, F.substring(raw, -tail, tail)).otherwise(raw).alias("tail"))

    def score(block: pa.Table) -> pa.Table:
        grown = [np.concatenate([[0.0], np.cumsum(np.log2(np.arange(tail + probe) + plus))]) for plus in (0.5, 128.0)]
        ids = block.column("doc_id").to_numpy()
        tails = [_keys(x.as_py()) for x in block.column("tail")]
        known, at = np.unique(np.concatenate([k for k, _ in tails]), return_inverse=True)
        counts = np.zeros((len(ids), len(known) + 1), np.int32)
        counts[np.repeat(np.arange(len(ids)), [len(k) for k, _ in tails]), at] = np.concatenate([n for _, n in tails])
        bits = np.zeros((len(ids), len(ids)))
        for j, x in enumerate(block.column("head")):
            key, m = _keys(x.as_py())
            if len(key):
                place = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
                place = np.where(known[place] == key, place, len(known)) if len(known) else np.zeros(len(key), np.int64)
                t = counts[:, place]
                split = int(np.searchsorted(key, 1 << 24))  # trigrams come first, contexts after
                bits[:, j] = (grown[1][(t + m)[:, split:]] - grown[1][t[:, split:]]).sum(1) - (grown[0][(t + m)[:, :split]] - grown[0][t[:, :split]]).sum(1)
        i, j = np.nonzero(~np.eye(len(ids), dtype=bool))
        keep = np.array([len(x.as_py()) > 2 for x in block.column("head")])[j] if len(j) else np.zeros(0, bool)
        i, j = i[keep], j[keep]
        return pa.table({"block": pa.array([block.column("block")[0].as_py()] * len(i), block.schema.field("block").type), "source": ids[i], "target": ids[j], "bits": bits[i, j]})

    kinds = {f.name: f.dataType.simpleString() for f in ends.schema}
    return ends.groupBy("block").applyInArrow(score, f"block {kinds['block']}, source {kinds['doc_id']}, target {kinds['doc_id']}, bits double")


def path_scores(order: DataFrame, edges: DataFrame) -> DataFrame:
    """block, bits: edges between neighbours of the order (block, doc_id, rank); a missing edge counts 0."""
    near = order.select("block", F.col("doc_id").alias("source"), F.lead("doc_id").over(Window.partitionBy("block").orderBy("rank")).alias("target"))
    return near.join(edges, ["block", "source", "target"], "left").groupBy("block").agg(F.sum(F.coalesce("bits", F.lit(0.0))).alias("bits"))


def _greedy(bits: np.ndarray, start: int) -> np.ndarray:
    """From start always on to the cheapest place not yet visited, the first of equals."""
    left, path = np.zeros(len(bits)), [start]
    left[start] = np.inf
    while len(path) < len(bits):
        path.append(int((bits[path[-1]] + left).argmin()))
        left[path[-1]] = np.inf
    return np.array(path)


def _swapped(bits: np.ndarray, path: np.ndarray) -> np.ndarray:
    """path after passes of swaps of neighbours that save bits; a swap changes three edges, and only those are added up."""
    n, path = len(path), path.copy()

    def edge(a: int, b: int) -> float:
        return bits[path[a], path[b]] if 0 <= a < n and b < n else 0.0

    saving = True
    while saving:
        saving = False
        for i in range(n - 1):
            j = i + 1
            saved = edge(i - 1, i) + edge(i, j) + edge(j, j + 1) - edge(i - 1, j) - edge(j, i) - edge(i, j + 1)
            if saved > 1e-9:
                path[i], path[j] = path[j], path[i]
                saving = True
    return path


def optimise(order: DataFrame, edges: DataFrame) -> DataFrame:
    """block, doc_id, rank, block_bits: the cheapest of the given order, its swaps, and greedy paths from its ends and middle."""

    def best(key: tuple, members: pd.DataFrame, costs: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(members["doc_id"].to_numpy())
        given = np.searchsorted(ids, members.sort_values("rank")["doc_id"].to_numpy())
        bits = np.zeros((len(ids), len(ids)))
        bits[np.searchsorted(ids, costs["source"]), np.searchsorted(ids, costs["target"])] = costs["bits"]
        total = lambda p: float(bits[p[:-1], p[1:]].sum())
        paths = [given, _swapped(bits, given), *(_greedy(bits, int(given[k])) for k in (0, len(ids) // 2, len(ids) - 1))]
        cheapest = min(paths, key=lambda p: round(total(p), 9))
        return pd.DataFrame({"block": key[0], "doc_id": ids[cheapest], "rank": range(len(ids)), "block_bits": round(total(cheapest), 6)})

    edges = materialize(edges, "edge-scores")  # scored once; also keeps its columns apart from those of the order
    return order.groupBy("block").cogroup(edges.groupBy("block")).applyInPandas(best, "block long, doc_id long, rank long, block_bits double")
