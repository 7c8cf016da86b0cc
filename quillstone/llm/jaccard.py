"""N-gram Jaccard join: a MinHash LSH forest over sets of word shingles, then exact verification.

Each document's set of 5-word shingles gets TREES labels of DEPTH MinHash values: its paths in TREES prefix tries, kept
sorted. Documents under one trie node are candidates. The forest is read from the longest prefixes to ever shorter ones,
all trees at once; a pair is verified once, on whole shingle sets, at the first length and in the first tree where it
meets. Since the similarities of the links found are exact, each link's chance to meet by now is known, so the links
still missing can be estimated (each link found stands for 1 / chance links, and one more link just at the threshold is
assumed). Prefixes are shortened until the estimated recall reaches the target, and at most to the length with which
even a pair at the threshold meets with that probability. No pairs are emitted, only each document's links and a
spanning forest of them.

Documents with equal shingle sets form a class before anything is compared, so exact copies cost one aggregation.
Members of a full node within half of the allowed distance from one of them are a core: by the triangle inequality they
all link to each other, so they are counted, not compared. What is left of nodes of many documents is dealt out as pairs
of blocks of bounded rows and bytes. Sets are of 64-bit hashes, labels of 32-bit ones.

Defined cases: a document without words (null, empty) has no links and a class of its own; one of fewer than 5 words
has one shingle, all its words; repeated rows and equal texts are links of each other; a null doc_id sorts first; texts
of any length are read whole; further columns, of any name, are ignored (link) or kept (dedupe); an empty table gives no
rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import drop_scratch, free_names, materialize, maybe_broadcast, ship
from .words import iter_words, mix, shingles
from .workers import tidy

WIDTH = 5
THRESHOLD = 0.8
TREES = 12
DEPTH = 6
RECALL = 0.9995
BLOCK = 512
BLOCK_SHINGLES = 1_000_000
BINS = 64
_SEEDS = np.random.default_rng(0xF0E57).integers(1, 2**63, (TREES * 4, DEPTH), np.uint64) | np.uint64(1)


def chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """How likely a pair of this similarity shares a prefix of depth values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def stop_depth(threshold: float, trees: int = TREES, recall: float = RECALL, depth: int = DEPTH) -> int:
    """The longest prefixes with which pairs at the threshold share one in some tree with the target recall."""
    while depth > 1 and chance(threshold, depth, trees) < recall:
        depth -= 1
    if chance(threshold, depth, trees) < recall:
        raise ValueError(f"{trees} trees can't reach a recall of {recall} at a threshold of {threshold}")
    return depth


def estimated_recall(found: dict[int, int], threshold: float, depth: int, trees: int = TREES) -> float:
    """The share of links found so far: found has their number by bin of similarity (bins start at the threshold)."""
    low = lambda k: threshold + (1 - threshold) * k / BINS
    seen = 1 + sum(found.values())
    return seen / (1 / chance(threshold, depth, trees) + sum(n / chance(low(k), depth, trees) for k, n in found.items()))


def _sets(w, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, and where each begins."""
    sh, first = shingles(w, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        sh[a:b].sort()
    new = np.ones(len(sh), bool)
    new[1:] = sh[1:] != sh[:-1]
    new[first[:-1][first[:-1] < len(sh)]] = True
    return sh[new], np.concatenate([[0], np.cumsum(new)])[first]


def _prints(sh: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents with a set, and the 128-bit fingerprints of their sets."""
    some = np.flatnonzero(np.diff(first))
    at = first[:-1][some]
    if not len(some):
        return some, np.zeros((0, 2), np.uint64)
    one = np.add.reduceat(mix(sh ^ np.uint64(0xA5A5F00DCAFE1234)), at)
    two = np.add.reduceat(mix(sh * np.uint64(0xC2B2AE3D27D4EB4F)), at)
    return some, np.stack([one, two + np.diff(first)[some].astype(np.uint64)], axis=1)


def _labels(sh: np.ndarray, at: np.ndarray, trees: int) -> np.ndarray:
    """The labels of each document, tree after tree: DEPTH 32-bit values each."""
    out = np.empty((len(at), trees * DEPTH), np.uint32)
    for t in range(trees):
        for d in range(DEPTH):
            out[:, t * DEPTH + d] = mix(np.minimum.reduceat(sh * _SEEDS[t, d], at)) >> np.uint64(32)
    return out


def _path(tree: Column, depth: int, label: str = "label") -> Column:
    """The prefix of depth values of a label in a tree."""
    return F.substring(label, tree * (4 * DEPTH) + 1, F.lit(4 * depth))


def _binary(rows: np.ndarray) -> list[bytes]:
    raw, width = np.ascontiguousarray(rows).tobytes(), rows.shape[1] * rows.itemsize
    return [raw[k : k + width] for k in range(0, len(raw), width)]


def _thin(docs: DataFrame, width: int, trees: int) -> DataFrame:
    """A written row for each document: doc_id, th (hash of the text), fp, size (of its set), label (all trees')."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in iter_words(batch.column("text")):
                n = w.last - w.first
                sh, first = _sets(w, width)
                some, prints = _prints(sh, first)
                fp: list[bytes | None] = [None] * n
                label: list[bytes | None] = [None] * n
                if len(some):
                    for d, p, x in zip(some.tolist(), _binary(prints), _binary(_labels(sh, first[:-1][some], trees)), strict=True):
                        fp[d], label[d] = p, x
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(w.first, n), "th": batch.column("th").slice(w.first, n), "fp": pa.array(fp, pa.binary()),
                    "size": pa.array(np.diff(first).astype(np.int64)), "label": pa.array(label, pa.binary())})

    return materialize(rows.mapInArrow(tidy(run), f"doc_id {kind}, th long, fp binary, size long, label binary"), "signatures")


def _payload(docs: DataFrame, width: int) -> DataFrame:
    """fp and the set's bytes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in iter_words(batch.column("text")):
                sh, first = _sets(w, width)
                some, prints = _prints(sh, first)
                sets = [sh[first[d] : first[d + 1]].tobytes() for d in some.tolist()]
                yield pa.RecordBatch.from_pydict({"fp": pa.array(_binary(prints), pa.binary()), "set": pa.array(sets, pa.binary())})

    return docs.select("text").mapInArrow(tidy(run), "fp binary, set binary")


class _Group:
    """Rows of one task of one trie node."""

    def __init__(self) -> None:
        self.fp: list[bytes] = []
        self.sets: list[np.ndarray] = []
        self.copies: list[int] = []
        self.side: list[int] = []
        self.core: list[bytes | None] = []
        self.labels: list[np.ndarray] = []
        self.seen: set[bytes] = set()

    def add(self, fp: bytes, blob: bytes, copies: int, side: int, core: bytes | None, label: bytes) -> None:
        if fp not in self.seen:  # repeated rows bring their set more than once
            self.seen.add(fp)
            self.fp.append(fp)
            self.sets.append(np.frombuffer(blob, np.uint64))
            self.copies.append(copies)
            self.side.append(side)
            self.core.append(core)
            self.labels.append(np.frombuffer(label, np.uint32).reshape(-1, DEPTH))

    def apart(self, tree: int, depth: int, crossed: bool) -> np.ndarray:
        """Which pairs meet first at this depth and in this tree, and are to be compared."""
        side = np.array(self.side)
        labels = np.stack(self.labels)
        m, trees = labels.shape[:2]
        new = np.ones((m, m), bool)
        if crossed:
            new &= side[:, None] != side[None]
        ids = {None: -1}
        core = np.array([ids.setdefault(c, len(ids)) for c in self.core])
        new &= (core[:, None] != core[None]) | (core < 0)[:, None]
        for t in range(trees):
            deep = depth + (t >= tree)  # met here: longer prefixes anywhere, or as long ones in a tree before
            if deep <= DEPTH:
                prefix = np.unique(labels[:, t, :deep], axis=0, return_inverse=True)[1].ravel()
                new &= prefix[:, None] != prefix[None]
        return np.triu(new, 1)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _matches(g: _Group, new: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, overlap) of the new pairs that link."""
    m = len(g.fp)
    sizes = np.array([len(s) for s in g.sets], np.int64)
    new &= np.minimum(sizes[:, None], sizes[None]) * den >= np.maximum(sizes[:, None], sizes[None]) * num
    i, j = np.nonzero(new)
    if not len(i):
        return i, j, i
    if len(i) <= 4 * m or m <= 24:
        both = np.array([_overlap(g.sets[a], g.sets[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    else:
        values = np.concatenate(g.sets)
        owner = np.repeat(np.arange(m), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        column = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]))
        shared = np.bincount(column)[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        counts = np.zeros((m, m), np.float32)
        step = max(1, 4_000_000 // m)
        cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + step + 1, step))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                dense = np.zeros((m, step), np.float32)
                dense[owner[a:b], column[a:b] - column[a]] = 1
                counts += dense @ dense.T
        both = counts[i, j].astype(np.int64)
    ok = both * den >= num * (sizes[i] + sizes[j] - both)
    return i[ok], j[ok], both[ok]


def _verify(members: DataFrame, depth: int, num: int, den: int) -> DataFrame:
    """fp, other, links: links found for fp (other is null), an edge of their spanning forest (links is 0), or the number of links in a bin of similarity (fp is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group = None, _Group()

        def close() -> Iterator[pa.RecordBatch]:
            if current is None or len(group.fp) < 2:
                return
            i, j, both = _matches(group, group.apart(current[0], depth, current[2] != current[3]), num, den)
            if not len(i):
                return
            m = len(group.fp)
            copies = np.array(group.copies, np.int64)
            links = (np.bincount(i, copies[j], m) + np.bincount(j, copies[i], m)).astype(np.int64)
            edges = _forest(m, i, j)
            sizes = np.array([len(s) for s in group.sets])
            similar = both / (sizes[i] + sizes[j] - both)
            bins = np.bincount(np.clip(((similar - num / den) / (1 - num / den) * BINS).astype(np.int64), 0, BINS - 1) if num < den else np.zeros(len(i), np.int64), minlength=BINS)
            some, full = np.flatnonzero(links).tolist(), np.flatnonzero(bins).tolist()
            yield pa.RecordBatch.from_pydict({
                "fp": pa.array([group.fp[k] for k in some] + [group.fp[a] for a, _ in edges] + [None] * len(full), pa.binary()),
                "other": pa.array([None] * len(some) + [group.fp[b] for _, b in edges] + [None] * len(full), pa.binary()),
                "links": pa.array([int(links[k]) for k in some] + [0] * len(edges) + [int(bins[k]) for k in full], pa.int64()),
                "bin": pa.array([None] * (len(some) + len(edges)) + full, pa.int32()),
            })

        for batch in batches:
            c = {x: batch.column(x).to_pylist() for x in batch.schema.names if x != "set"}
            for r, head in enumerate(zip(c["tree"], c["node"], c["one"], c["two"], strict=True)):
                if head != current:
                    yield from close()
                    current, group = head, _Group()
                group.add(c["fp"][r], batch.column("set")[r].as_py(), c["copies"][r], c["block"][r], c["core"][r], c["label"][r])
        yield from close()

    dealt = members.repartition("tree", "node", "one", "two").sortWithinPartitions("tree", "node", "one", "two")
    return dealt.mapInArrow(tidy(run), "fp binary, other binary, links long, bin int")


def _forest(m: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that already connect all that the pairs connect."""
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[y] = x
            out.append((a, b))
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for edges a, b; labels go along edges and pointers are halved."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "roots")
    while True:
        near = both.join(now.select("node", "root"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        step = now.select("node", "root").join(near, F.col("node") == near.a).select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        step = materialize(step, "roots")
        jump = step.select(F.col("node").alias("via"), F.col("root").alias("far"))
        new = materialize(step.join(jump, step.root == jump.via).select("node", "was", F.least("root", "far").alias("root")), "roots")
        drop_scratch(step)
        drop_scratch(now)
        if new.where(F.col("root") != F.col("was")).limit(1).count() == 0:
            drop_scratch(both)
            return new.select("node", "root")
        now = new


def _sets_of(docs: DataFrame, reps: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Written: fp and the set of each document among rows."""
    wanted = rows.select("fp").distinct().join(reps.select("fp", "head"), "fp").select(F.col("head.doc_id").alias("w_id"), F.col("head.th").alias("w_th")).distinct()
    wanted = materialize(wanted, "wanted")
    source = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    source = source.join(maybe_broadcast(wanted, wanted.count()), source.doc_id.eqNullSafe(F.col("w_id")) & (source.th == F.col("w_th")), "left_semi")
    out = materialize(_payload(source, width), "sets")
    drop_scratch(wanted)
    return out


def _cores(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Written: fp and core, a document of a full node so near to both that all of a core link to each other.

    The core of a node is around its least fp; who could be in several takes the least.
    """
    full = rows.groupBy("tree", "path").agg(F.count("*").alias("n"), F.min(F.struct("fp")).alias("core")).where(F.col("n") > BLOCK).select("tree", "path", F.col("core.fp").alias("core"))
    full = materialize(full, "full-nodes")
    if full.limit(1).count() == 0:
        return full.select(F.col("core").alias("fp"), "core")
    near = rows.select("tree", "path", "fp").join(full, ["tree", "path"]).select("fp", "core").distinct()
    heart = sets.join(full.select(F.col("core").alias("h")).distinct(), F.col("fp") == F.col("h")).select("h", F.col("set").alias("heart")).dropDuplicates(["h"])
    pairs = near.join(sets.dropDuplicates(["fp"]), "fp").join(heart, F.col("core") == F.col("h")).select("fp", "core", "set", "heart")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set"), batch.column("heart"), strict=True):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = _overlap(a, b)
                either = len(a) + len(b) - both
                keep.append(2 * (either - both) * den <= (den - num) * either)
            yield batch.select(["fp", "core"]).filter(pa.array(keep, pa.bool_()))

    return materialize(pairs.mapInArrow(tidy(run), "fp binary, core binary").groupBy("fp").agg(F.min(F.struct("core")).alias("c")).select("fp", "c.core"), "cores")


def _tasks(rows: DataFrame, depth: int, trees: int) -> DataFrame:
    """Written: tree, node, one, two (blocks), block, fp, core, copies, label: what to compare at this depth."""
    node = F.substring("path", 1, 4 * depth).alias("node")
    at = rows.select("*", node)
    prefix = lambda t, d: F.xxhash64(_path(F.lit(t), d))
    seen = [prefix(t, depth + 1) for t in range(trees)] * (depth < DEPTH)
    before = [prefix(t, depth) for t in range(trees)]
    checks = [*seen, *before, F.when(F.col("core").isNotNull(), F.xxhash64("core"))]
    in_core = F.col("core").isNotNull()
    ends = at.groupBy("tree", "node").agg(
        F.count("*").alias("n"), F.sum("size").alias("all"), F.count("core").alias("n_core"), F.sum(F.when(in_core, F.col("size")).otherwise(0)).alias("all_core"),
        *[f(c).alias(f"{x}{k}") for k, c in enumerate(checks) for x, f in (("lo", F.min), ("hi", F.max))])
    same = lambda k: F.col(f"lo{k}") == F.col(f"hi{k}")
    one_core = F.coalesce(same(len(checks) - 1), F.lit(False))
    # a node all of whose pairs met before, at longer prefixes or in an earlier tree, or are of one core, needs no task
    done = one_core & (F.col("n_core") == F.col("n"))
    for k in range(len(seen)):
        done = done | same(k)
    for t in range(trees - 1):
        done = done | ((F.col("tree") > t) & same(len(seen) + t))
    many = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    ends = ends.where((F.col("n") > 1) & ~done).withColumn("inner", F.when(one_core, many(F.col("n_core"), F.col("all_core"))).otherwise(0))
    outer = F.when(F.col("inner") > 0, many(F.col("n") - F.col("n_core"), F.col("all") - F.col("all_core"))).otherwise(many(F.col("n"), F.col("all")))
    needed = materialize(ends.select("tree", "node", "inner", outer.alias("outer")), "needed")
    dealt = at.join(maybe_broadcast(needed, needed.count()), ["tree", "node"])
    # a core's members have the first blocks for themselves, and no pair there is compared
    mine, h, blocks = in_core & (F.col("inner") > 0), F.xxhash64("fp"), F.col("inner") + F.col("outer")
    dealt = dealt.withColumn("block", F.when(mine, F.pmod(h, F.col("inner"))).otherwise(F.col("inner") + F.pmod(h, F.col("outer"))).cast("int"))
    others = F.sequence(F.when(mine, F.col("inner")).otherwise(F.lit(0)), blocks - 1)
    pairs = F.transform(others, lambda x: F.struct(F.least(x, F.col("block")).alias("one"), F.greatest(x, F.col("block")).alias("two")))
    out = materialize(dealt.select("*", F.explode(pairs).alias("task")).select("tree", "node", "task.one", "task.two", "block", "fp", "core", "copies", "label"), "tasks")
    drop_scratch(needed)
    return out


def _classes(docs: DataFrame, width: int, threshold: float, trees: int, recall: float) -> tuple[DataFrame, DataFrame, int]:
    """The documents' thin rows; for each fingerprint with copies or links: fp, head (least doc_id, th), links; their number."""
    ship(docs.sparkSession)
    floor = stop_depth(threshold, trees, recall)
    den = 1000
    num = round(threshold * den)
    thin = _thin(docs, width, trees)
    reps = materialize(thin.where(F.col("fp").isNotNull()).groupBy("fp").agg(
        F.min(F.struct("doc_id", "th")).alias("head"), F.count("*").alias("copies"), F.max("size").alias("size"), F.max(F.struct("label")).alias("label")).withColumn("label", F.col("label.label")), "classes")

    # the tries' lowest nodes that can be reached, where two or more meet
    nodes = reps.select("fp", "label", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("fp", "tree", _path(F.col("tree"), floor).alias("low"))
    full = materialize(nodes.groupBy("tree", "low").agg(F.count("*").alias("n")).where("n > 1").select("tree", "low"), "nodes")
    met = materialize(nodes.join(maybe_broadcast(full, full.count()), ["tree", "low"]).select("fp", "tree"), "met")
    drop_scratch(full)
    rows = reps.select("fp", "copies", "size", "label").join(maybe_broadcast(met, met.count()), "fp").withColumn("path", _path(F.col("tree"), DEPTH))
    rows = materialize(rows.repartition("tree", F.substring("path", 1, 4 * floor)).sortWithinPartitions("tree", "path"), "tries")
    drop_scratch(met)
    sets = _sets_of(docs, reps, rows, width)
    cores = _cores(rows, sets, num, den)
    n_cores = cores.count()
    rows = materialize(rows.join(maybe_broadcast(cores, n_cores), "fp", "left"), "tries") if n_cores else rows.withColumn("core", F.lit(None).cast("binary"))

    found, bins = [], {}
    for depth in range(DEPTH, floor - 1, -1):
        tasks = _tasks(rows, depth, trees)
        n = tasks.count()
        if n:
            links = materialize(_verify(sets.join(maybe_broadcast(tasks, n), "fp"), depth, num, den), "links")
            found.append(links)
            drop_scratch(tasks)
            for r in links.where("bin is not null").groupBy("bin").agg(F.sum("links").alias("n")).collect():
                bins[r.bin] = bins.get(r.bin, 0) + r.n
        if estimated_recall(bins, threshold, depth, trees) >= recall:
            break

    drop_scratch(sets)
    sums = cores.join(reps.select("fp", "copies"), "fp")
    all_of = sums.groupBy("core").agg(F.sum("copies").alias("all"))
    parts = [sums.join(all_of, "core").select("fp", (F.col("all") - F.col("copies")).alias("links"))]
    edges = [cores.where(F.col("fp") != F.col("core")).select(F.col("fp").alias("a"), F.col("core").alias("b"))]
    for links in found:
        parts.append(links.where("fp is not null and other is null").select("fp", "links"))
        edges.append(links.where("other is not null").select(F.col("fp").alias("a"), F.col("other").alias("b")))
    union = lambda dfs: functools.reduce(DataFrame.unionByName, dfs)
    linked = union(parts).groupBy("fp").agg(F.sum("links").alias("links"))
    roots = components(union(edges))
    heads = reps.select("fp", "head", "copies").join(roots, F.col("fp") == F.col("node"))
    heads = heads.groupBy("root").agg(F.min("head").alias("head"))
    of_linked = roots.join(heads, "root").join(linked, F.col("node") == F.col("fp")).select("fp", "head", "links")
    special = reps.where("copies > 1").select("fp", F.col("head").alias("own"), "copies").join(of_linked, "fp", "full_outer")
    special = materialize(special.select("fp", F.coalesce("head", "own").alias("head"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("links")), "special")
    return thin, special, special.count()


def _joined(docs: DataFrame, width: int, threshold: float, trees: int, recall: float) -> DataFrame:
    thin, special, n = _classes(docs, width, threshold, trees, recall)
    return thin.select("doc_id", "th", "fp", "size").join(maybe_broadcast(special, n), "fp", "left")


def link(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (least doc_id of the linked documents), n_links (documents at or over the threshold), n_shingles."""
    rows = _joined(docs, width, threshold, trees, recall)
    return rows.select("doc_id", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("size").alias("n_shingles"))


def dedupe(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """docs with one document of each class: that of the least doc_id (repeated rows of it count once)."""
    th, of_id, of_th = free_names(docs, "th", "of_id", "of_th")
    rows = _joined(docs, width, threshold, trees, recall).where(F.col("head").isNotNull())
    gone = rows.where(~F.col("doc_id").eqNullSafe(F.col("head.doc_id")) | (F.col("th") != F.col("head.th"))).select(F.col("doc_id").alias(of_id), F.col("th").alias(of_th)).distinct()
    gone = materialize(gone, "gone")
    twice = rows.groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias(of_id), F.col("th").alias(of_th))
    twice = materialize(twice, "twice")
    n_twice = twice.count()
    marked = docs.withColumn(th, F.xxhash64("text"))
    on = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(th) == F.col(of_th))
    left = marked.join(maybe_broadcast(gone, gone.count()), on, "left_anti")
    if n_twice:
        once = left.join(maybe_broadcast(twice, n_twice), on, "left_semi").dropDuplicates(["doc_id", th])
        left = left.join(maybe_broadcast(twice, n_twice), on, "left_anti").unionByName(once)
    return left.drop(th)
