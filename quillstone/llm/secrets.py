"""Secret scans: fixed patterns, and guess costs of values in credential contexts by dynamic programming.

A value's guess cost (log10 of the guesses needed) is the least sum over its segmentations into dictionary words, dates,
repeats of any block of up to PERIODS characters, keyboard walks (of any length from any place) and brute-force
characters. The dictionary is the fixed common passwords and then, by rank, the words of a public tokenizer's vocabulary
(load_words; its order follows frequency). Values in credential contexts (also ones that the fixed patterns don't know)
whose cost reaches a threshold become spans of kind `guess`; values that are nothing but dictionary words and separators
are prose up to PROSE. Spans of the fixed patterns always stay.

Defined cases: a null text is empty and has no spans; empty tables give no rows; values and texts of any length are
scanned whole, in time linear in their length; of spans that begin together the kinds come as in KINDS; repeated rows
each get a row; further columns, of any name, are ignored (scan) or kept (redact).
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import ship
from .words import buffers
from .workers import tidy, with_texts

THRESHOLD = 8.0
PROSE = 24.0
PERIODS = 64
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# A key word may end any identifier; short ones, which also end other words, not after a letter. A bare "bearer" needs a digit in its value.
CONTEXT = re.compile(
    r"""(?:(?:(?:(?<![A-Za-z])(?:pwd|pass|auth|bearer)|passphrase|passcode|password|passwd|secret|token|credentials?|api_?key|(?:private|access|client)_(?:key|secret))(?:_?key)?|(?<![A-Za-z])authorization)"""
    r"""["']?\x20*[:=]\x20*["']?(?:bearer\x20+["']?)?|(?<![A-Za-z])bearer\x20+["']?(?=[^\s"'<>]*[0-9]))([^\s"'<>]{6,})""", re.IGNORECASE | re.ASCII)
BEARER = re.compile("bearer\x20", re.IGNORECASE | re.ASCII)
USERINFO = re.compile(r"://[^\s/:@]+:([^\s/@]{6,})@", re.ASCII)

# Common passwords and words, the most common first.
COMMON = """password 123456 12345678 qwerty abc123 monkey letmein dragon baseball iloveyou master sunshine ashley
michael shadow superman football welcome admin login princess solo starwars hello freedom whatever trustno1 jordan
hunter buster soccer harley batman andrew tigger charlie robert thomas hockey ranger daniel george computer michelle
jessica pepper zxcvbn pass secret test guest root user default changeme summer winter spring autumn love money
server system access token key example demo temp private public service account january february march april
may june july august september october november december monday friday company orange purple silver cookie
""".split()
# Letters that digits and signs stand for, and rows of keys.
LEET = str.maketrans("013457$@!", "oieastsai")
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
WALK = {pair for row in KEY_ROWS for a, b in zip(row, row[1:], strict=False) for pair in (a + b, b + a)} | {a + b for one, two in zip(KEY_ROWS, KEY_ROWS[1:4], strict=False) for k, a in enumerate(one) for b in two[max(0, k - 1) : k + 1]}
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
SEGMENT = math.log10(2)


class Words:
    """Ranks of lower-case words, from 1, and all their beginnings."""

    def __init__(self, ranked: list[str]) -> None:
        self.rank: dict[str, int] = {}
        for w in ranked:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.starts = {w[:n] for w in self.rank for n in range(1, len(w) + 1)}

    def prose(self, value: str) -> bool:
        """Whether value is words, two letters or more each, joined by separators or capitals."""
        parts = re.findall("[A-Z]?[a-z]+|[A-Z]+", value)
        return bool(parts) and re.fullmatch("[A-Za-z]+(?:[ _./-][A-Za-z]+)*", value) is not None and all(len(p) > 1 and p.lower() in self.rank for p in parts)


BASIC = Words(COMMON)


def load_words(vocabulary: str | None) -> Words:
    """The common passwords, then the whole words (a space and ASCII letters) of a byte-level BPE vocabulary file, by id."""
    if vocabulary is None:
        return BASIC
    with open(vocabulary, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    words = (t[1:].lower() for t in sorted(ids, key=ids.get) if t[:1] == "\u0120")
    return Words(COMMON + [w for w in words if len(w) > 1 and w.isascii() and w.isalpha()])


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33)


def guess_cost(value: str, words: Words = BASIC) -> float:
    """log10 of the guesses of the cheapest segmentation; linear in the value's length."""
    n = len(value)
    low = value.lower()
    if len(low) != n:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    # walks from i: how far one goes on
    onward = [1] * n
    for i in range(n - 2, -1, -1):
        onward[i] = onward[i + 1] + 1 if low[i : i + 2] in WALK else 1
    repeat = _repeats(low)
    walks = _Starts(1)
    repeats = {p: _Starts(p) for p in repeat}

    def closed(i: int) -> float:
        return min([walks.cheapest(i, 3) + math.log10(47), *(r.cheapest(i, 2 * p + (p == 1)) for p, r in repeats.items())])

    for i in range(n):
        # walks and repeats may begin and end anywhere in a run
        base = best[i] = min(best[i], closed(i))

        def offer(end: int, cost: float, base: float = base) -> None:
            if base + cost < best[end]:
                best[end] = base + cost

        offer(i + 1, _brute(value[i]))
        if onward[i] >= 3:
            walks.add(i, i + onward[i], base + SEGMENT)
        for p, run in repeat.items():
            if run[i] >= 2 * p + (p == 1):
                repeats[p].add(i, i + run[i], base + SEGMENT + sum(map(_brute, value[i : i + p])))
        if m := DATE.match(low, i):
            offer(m.end(), SEGMENT + (math.log10(119) if m.end() - i == 4 else math.log10(365 * 119)))
        for end in range(i + 1, n + 1):
            word, swapped = low[i:end], plain[i:end]
            if word not in words.starts and swapped not in words.starts:
                break
            swaps, rank = 0.0, words.rank.get(word)
            if rank is None:
                swaps, rank = math.log10(2), words.rank.get(swapped)
            if rank is not None:
                ups, size = sum(c.isupper() for c in value[i:end]), end - i
                offer(end, SEGMENT + math.log10(rank) + swaps + (0 if not ups else math.log10(2) if ups in (1, size) else math.log10(math.comb(size, min(ups, size - ups)) + 1)))
    return min(best[n], closed(n))


class _Starts:
    """Open starts of segments in runs, by their place modulo p; a segment costs its start and log10(length / p).

    A start that an earlier one of its run undercuts never wins again, since their costs only draw closer; few are left.
    """

    def __init__(self, p: int) -> None:
        self.p, self.runs = p, {}

    def add(self, i: int, end: int, cost: float) -> None:
        """A start at i in a run up to end."""
        if end not in self.runs:
            self.runs[end] = [[] for _ in range(self.p)]
        self.runs[end][i % self.p].append((i, cost))

    def cheapest(self, i: int, least: int) -> float:
        """The least cost of a segment of at least so many characters that ends before i."""
        found = math.inf
        for end, starts in list(self.runs.items()):
            if end < i:
                del self.runs[end]
                continue
            kept, low = [], math.inf
            for s, cost in starts[i % self.p]:
                now = cost + math.log10((i - s) // self.p)
                if now < low:
                    low = now
                    kept.append((s, cost))
                    if i - s >= least:
                        found = min(found, now)
            starts[i % self.p] = kept
        return found


def _repeats(s: str) -> dict[int, list[int]]:
    """By period, how many characters from each place on repeat; only periods that some block repeats with, none that a shorter one covers."""
    n = len(s)
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    out: dict[int, list[int]] = {}
    for p in range(1, min(PERIODS, n // 2) + 1):
        same = np.concatenate([codes[p:] == codes[:-p], np.zeros(p, bool)])
        ends = np.flatnonzero(~same)
        at = np.arange(n)
        run = ends[np.searchsorted(ends, at)] - at  # places that equal the one p on
        run = np.where(run >= p + (p == 1), np.minimum(run + p, n - at), 0)
        for q in out:
            if p % q == 0:
                run[np.array(out[q]) >= run] = 0
        if run.any():
            out[p] = run.tolist()
    return out


def find(text: str, threshold: float = THRESHOLD, has_hex: bool = True, words: Words = BASIC) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, guess cost or 0) by start, then kind as in KINDS."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign", guess_cost(m[2], words)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if has_hex:
        out += [(m.start(), m.end(), "hex", 0.0) for m in HEX.finditer(text)]
    values = {m.span(1) for m in CONTEXT.finditer(text)} if ":" in text or "=" in text or BEARER.search(text) else set()
    if "://" in text:
        values |= {m.span(1) for m in USERINFO.finditer(text)}
    for a, b in values:
        b -= len(text[a:b]) - len(text[a:b].rstrip(".,;:)]}"))
        if b > a and (cost := guess_cost(text[a:b], words)) >= (max(threshold, PROSE) if words.prose(text[a:b]) else threshold):
            out.append((a, b, "guess", cost))
    return sorted(set(out), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _flagged(column: pa.Array) -> list[tuple[int, bool]]:
    """Rows that may hold a span, and whether they hold 32 hex characters in a row; found over the column's bytes."""
    offsets, data = buffers(column)
    out: list[tuple[int, bool]] = []
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        raw = data[a:b].tobytes()
        hexes = _HEX_BYTES.search(raw) is not None
        if hexes or b":" in raw or b"=" in raw or b"AKIA" in raw or _BEARER_BYTES.search(raw):
            out.append((i, hexes))
    return out


_HEX_BYTES = re.compile(rb"[0-9a-f]{32}")
_BEARER_BYTES = re.compile(rb"bearer\x20", re.IGNORECASE)


def scan(docs: DataFrame, threshold: float = THRESHOLD, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text), found (array of kind, start, end, cost).

    vocabulary: a byte-level BPE vocabulary file, whose words join the dictionary; the driver reads and broadcasts them.
    """
    ship(docs.sparkSession)
    words = docs.sparkSession.sparkContext.broadcast(load_words(vocabulary))
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts = {k: np.zeros(n, np.int64) for k in KINDS}
            sha, spans, found = [nothing] * n, [""] * n, [[] for _ in range(n)]
            column = batch.column("text")
            for i, hexes in _flagged(column):
                got = find(column[i].as_py(), threshold, hexes, words.value)
                if not got:
                    continue
                for _, _, k, _ in got:
                    counts[k][i] += 1
                base = ",".join(f"{k}:{a}:{b}" for a, b, k, _ in got if k != "guess")
                sha[i] = hashlib.sha256(base.encode()).hexdigest()
                spans[i] = ",".join(f"{k}:{a}:{b}" for a, b, k, _ in got)
                found[i] = [{"kind": k, "start": a, "end": b, "cost": c} for a, b, k, c in got]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_assign": pa.array(counts["assign"]), "n_access": pa.array(counts["access"]), "n_hex": pa.array(counts["hex"]),
                "base_sha256": pa.array(sha), "spans": pa.array(spans),
                "found": pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))),
            })

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long,cost:double>>")


def redact(docs: DataFrame, threshold: float = THRESHOLD, mark: str = "[REDACTED]", vocabulary: str | None = None) -> DataFrame:
    """docs with every span replaced by mark; n_chars, if there, follows the text."""
    ship(docs.sparkSession)
    words = docs.sparkSession.sparkContext.broadcast(load_words(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            changed: dict[int, str] = {}
            for i, hexes in _flagged(column):
                text = column[i].as_py()
                got = find(text, threshold, hexes, words.value)
                if got:
                    parts, at = [], 0
                    for a, b, _, _ in got:
                        if b > at:
                            if a >= at:
                                parts += [text[at:a], mark]
                            at = b
                    changed[i] = "".join([*parts, text[at:]])
            yield with_texts(batch, changed)

    return docs.mapInArrow(tidy(run), docs.schema)
