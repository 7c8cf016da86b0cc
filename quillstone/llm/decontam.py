"""Benchmark decontamination with a generalised suffix automaton of the normalised benchmark items.

The automaton is built over the items' words. Training words are streamed through it and the longest match that
ends at each word is tracked; a match of at least `window` words marks its last `window` words as hit (an item of
fewer words is one window of all its words). Words whose pair with the next word occurs in no item can't continue
a match, so only runs of item pairs reach the automaton: found in NumPy over whole Arrow columns, with no shuffle.

Defined cases: a null or empty text has no words, so nothing is hit; a null or empty item has no window; repeated
items and repeated documents count each; an empty benchmark hits nothing; texts of any length are read whole; an empty
table gives no rows; further columns, of any name, are ignored (evaluate) or kept (clean). Benchmarks of more than
SHARD_WORDS words become several automata, passed over one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import drop_scratch, free_names, materialize, ship
from .words import WORD_TABLE, iter_words, mix, words_of
from .workers import tidy, with_texts

WINDOW = 13
COVERAGE = 0.05
SHARD_WORDS = 500_000
_TABLE_BITS = 20
_MIX = np.uint64(0x9FB21C651E98DF25)


class SuffixAutomaton:
    """All substrings of several word sequences; states as parallel lists."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.window = window
        self.items = [(i, w) for i, w in items if w]
        for _, words in self.items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        n = len(self.link)
        self.of_window: list[set[str]] = [set() for _ in range(n)]
        self.short: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for item, words in self.items:
            state = 0
            for i, word in enumerate(words):
                state = self.next[state][word]
                if i + 1 >= window:
                    self.of_window[self._holder(state, window)].add(item)
            if len(words) < window:
                self.short[self._holder(state, len(words))].append((len(words), item))
        for v in sorted(range(1, n), key=self.length.__getitem__):
            if self.short[self.link[v]]:
                self.short[v] = self.short[self.link[v]] + self.short[v]

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, word, q)
        cur = self._state(length[last] + 1, {})
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return cur

    def _state(self, length: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, word: bytes, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[c] = self.link[q]
        self.link[q] = c
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def _holder(self, state: int, n: int) -> int:
        """The state of the last n words of a string that ends in state."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit word spans (merged), items with an occurring window, and the longest match."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        spans: list[list[int]] = []
        items: set[str] = set()
        state = matched = longest = 0
        for i, word in enumerate(words):
            while word not in nxt[state] and state:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            if matched > longest:
                longest = matched
            hit = 0
            if matched >= window:
                hit = window
                items |= self.of_window[self._holder(state, window)]
            for n, item in self.short[state]:
                if n <= matched:
                    hit = max(hit, n)
                    items.add(item)
            if hit:
                if spans and spans[-1][1] >= i + 1 - hit:
                    spans[-1][0] = min(spans[-1][0], i + 1 - hit)
                    spans[-1][1] = i + 1
                else:
                    spans.append([i + 1 - hit, i + 1])
        return [(a, b) for a, b in spans], items, longest


class Matcher:
    """A suffix automaton and what finds the runs worth streaming."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        split = [(i, words_of(t)) for i, t in items]
        split = [(i, w) for i, w in split if w]
        self.automaton = SuffixAutomaton(split, window)
        self.least = min([window, *(len(w) for _, w in split)]) if split else 0
        singles, pairs = set(), set()
        column = pa.array([b" ".join(w).decode("utf-8", "replace") for _, w in split], pa.string())
        for w in iter_words(column):
            singles.update(w.hashes.tolist())
            inside = np.ones(max(len(w.hashes) - 1, 0), bool)
            cuts = w.doc[1:-1] - 1
            inside[cuts[(cuts >= 0) & (cuts < len(inside))]] = False
            pairs.update(self.pair(w.hashes)[inside].tolist())
        self.keys = np.array(sorted(singles if self.least == 1 else pairs), np.uint64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.keys >> np.uint64(64 - _TABLE_BITS)] = True

    @staticmethod
    def pair(h: np.ndarray) -> np.ndarray:
        return mix(h[:-1] * _MIX + h[1:])

    def runs(self, hashes: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, first word, last word + 1) of the runs that can hold a window."""
        if not self.least or not len(hashes):
            return []
        if self.least == 1:
            keys, extra = hashes, 0
        else:
            keys, extra = self.pair(hashes), 1
        on = self.table[keys >> np.uint64(64 - _TABLE_BITS)]
        if extra and len(doc) > 2:
            cuts = doc[1:-1] - 1
            on[cuts[(cuts >= 0) & (cuts < len(on))]] = False
        at = np.flatnonzero(on)
        if len(at):
            place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
            on[at] = self.keys[place] == keys[at]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
        first, last = edge[::2], edge[1::2] + extra
        keep = last - first >= self.least
        out = []
        for a, b in zip(first[keep].tolist(), last[keep].tolist(), strict=True):
            d = int(np.searchsorted(doc, a, "right")) - 1
            while a < b:  # single words of neighbouring documents may form one run
                end = min(b, int(doc[d + 1]))
                if end - a >= self.least:
                    out.append((d, a, end))
                a, d = max(a, end), d + 1
        return out


def _load(spark, benchmark: DataFrame, window: int) -> list:
    """One broadcast matcher for each SHARD_WORDS words of items, read shard by shard."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // (SHARD_WORDS * 6)))
    out = []
    for k in range(shards):
        part = items if shards == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        rows = sorted((r.item_id or "", r.text or "") for r in part.toLocalIterator())
        out.append(spark.sparkContext.broadcast(Matcher(rows, window)))
    return out


_HIT = "array<struct<s:int,e:int,bs:int,be:int>>"
_STATE = ("n_words", "items", "longest", "hits")
Finish = Callable[[pa.RecordBatch, list[int], list[list[str]], list[int], list[list[dict]]], pa.RecordBatch]


def _through(docs: DataFrame, benchmark: DataFrame, window: int, finish: Finish, schema: str | StructType) -> DataFrame:
    """docs through every shard's automaton; the last pass ends with finish.

    finish gets a batch of docs and, for each row, its words, items, longest match and hits: word spans [s, e) and byte
    spans [bs, be). Between shards these are written beside the documents, as the last columns; there is no shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    df, names, written = docs, docs.columns, None
    shards = _load(spark, benchmark, window)
    for k, shared in enumerate(shards):
        if k == 0 and len(shards) > 1:
            state = zip(free_names(docs, *_STATE), (F.lit(0).cast("long"), F.array().cast("array<string>"), F.lit(0), F.array().cast(_HIT)), strict=True)
            df = df.select("*", *[v.alias(c) for c, v in state])
        last = k + 1 == len(shards)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last, between=len(shards) > 1) -> Iterator[pa.RecordBatch]:
            matcher = shared.value
            for batch in batches:
                n = batch.num_rows
                items, longest, hits = (batch.column(c).to_pylist() for c in (-3, -2, -1)) if between else ([[] for _ in range(n)], [0] * n, [[] for _ in range(n)])
                counts = np.zeros(n, np.int64)
                for w in iter_words(batch.column(batch.schema.names.index("text"))):
                    counts[w.first : w.last] = np.diff(w.doc)
                    for d, a, b in matcher.runs(w.hashes, w.doc):
                        words = [bytes(w.data[s:e]).translate(WORD_TABLE) for s, e in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)]
                        spans, found, most = matcher.automaton.stream(words)
                        row, zero = w.first + d, int(w.doc[d])
                        base = int(w.offsets[row])
                        hits[row] += [{"s": a + s - zero, "e": a + e - zero, "bs": int(w.starts[a + s]) - base, "be": int(w.ends[a + e - 1]) - base} for s, e in spans]
                        items[row] = sorted({*items[row], *found})
                        longest[row] = max(longest[row], most)
                own = batch.select(list(range(len(names))))
                if last:
                    yield finish(own, counts.tolist(), items, longest, hits)
                else:
                    types = [f.type for f in list(batch.schema)[len(names) :]]
                    yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(v, t) for v, t in zip((counts, items, longest, hits), types, strict=True))], schema=batch.schema)

        df = df.mapInArrow(tidy(run), schema if last else df.schema)
        if not last:  # one pass at a time, so that only its automaton is in memory
            df = materialize(df, "decontamination")
            shared.destroy()
            if written is not None:
                drop_scratch(written)
            written = df
    return df


def merge(hits: list[dict], s: str, e: str) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((h[s], h[e]) for h in hits or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def evaluate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items, longest_match, items_sha256, contaminated.

    contaminated: hit words are at least coverage of all words (and not none).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    per = round(coverage * 1_000_000)

    def finish(batch: pa.RecordBatch, n_words: list[int], items: list[list[str]], longest: list[int], hits: list[list[dict]]) -> pa.RecordBatch:
        n_hit = [sum(b - a for a, b in merge(h, "s", "e")) if h else 0 for h in hits]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"),
            "n_words": pa.array(n_words, pa.int64()),
            "n_hit": pa.array(n_hit, pa.int64()),
            "n_items": pa.array([len(x) for x in items], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
            "contaminated": pa.array([h > 0 and h * 1_000_000 >= per * n for h, n in zip(n_hit, n_words, strict=True)]),
            "items": pa.array(items, pa.list_(pa.string())),
            "longest_match": pa.array(longest, pa.int32()),
        })

    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, longest_match int"
    return _through(docs.select("doc_id", "text"), benchmark, window, finish, schema)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """docs without contaminated documents; from the others the hit spans are cut. n_chars, if there, follows the text."""
    per = round(coverage * 1_000_000)

    def finish(batch: pa.RecordBatch, n_words: list[int], items: list[list[str]], longest: list[int], hits: list[list[dict]]) -> pa.RecordBatch:
        if not any(hits):
            return batch
        keep = [True] * batch.num_rows
        column = batch.column("text")
        changed: dict[int, str] = {}
        for i, h in enumerate(hits):
            if not h:
                continue
            if sum(b - a for a, b in merge(h, "s", "e")) * 1_000_000 >= per * n_words[i]:
                keep[i] = False
                continue
            raw = column[i].as_py().encode()
            at, kept = 0, []
            for a, b in merge(h, "bs", "be"):
                kept.append(raw[at:a])
                at = b
            changed[i] = b"".join([*kept, raw[at:]]).decode()
        return with_texts(batch, changed).filter(pa.array(keep))

    return _through(docs, benchmark, window, finish, docs.schema)
