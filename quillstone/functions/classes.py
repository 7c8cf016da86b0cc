"""Classes of bytes, blocks of text in binary data, and what follows contexts of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

# Structural classes of bytes by the characters in them; other letters, other bytes from 0x80 on, and the rest.
STRUCTURAL = {
    "newline": "\n\r", "whitespace": " \t", "colon": ":J", "semicolon": ";K", "open_markup": "<L{P", "close_markup": ">N}R", "equals": "=M", "pipe": "|Q", "dash": "-", "plus": "+",
    "slash": "/\\", "dot": ".", "comma": ",", "quote": "'\"",
}
# Coarse classes of the structural ones; 0 for those not named.
COARSE = {
    "whitespace": 1, "newline": 1, "letter": 2, "word_token": 2, "open_markup": 3, "close_markup": 3, "equals": 4, "pipe": 5, "colon": 5, "semicolon": 5, "dash": 6, "plus": 6, "slash": 7, "dot": 7,
    "comma": 7,
}
# The classes that a smaller set of labels keeps; the others are `other` there.
FEWER = ("newline", "whitespace", "open_markup", "close_markup", "equals", "pipe", "colon", "semicolon", "letter", "word_token")
# Classes of what ends a run of digits, by structural class.
TERMINATORS = {
    "whitespace": "whitespace", "newline": "whitespace", "open_markup": "markup", "close_markup": "markup", "dash": "dash", "colon": "colon", "dot": "dot", "comma": "comma", "slash": "slash",
}
# Symbols of URLs by the characters in them; letters and digits that are in none, bytes from 0x80 on, and the rest.
URL_SYMBOLS = {
    "colon": ":J", "slash": "/", "dot": ".", "question": "?O", "ampersand": "&", "equals": "=M", "hash": "#", "percent": "%", "at": "@", "hyphen": "-", "underscore": "_", "tilde": "~", "plus": "+",
    "quote": "'\"", "open_bracket": "[({", "close_bracket": "])}", "newline": "\n\r", "whitespace": " \t\f", "other": "LN",
}


def structural(byte: int) -> str:
    c = chr(byte)
    named = next((k for k, members in STRUCTURAL.items() if c in members), None)
    return named or ("word_token" if byte >= 0x80 else "letter" if c.isalpha() else "other")


def url_symbol(byte: int) -> str:
    c = chr(byte)
    named = next((k for k, members in URL_SYMBOLS.items() if byte < 0x80 and c in members), None)
    return named or ("high_byte" if byte >= 0x80 else "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "other")


def labels(byte: int) -> tuple[str, int, str, str, str]:
    """Structural class, coarse class, label of the smaller set, terminator class, and URL symbol of a byte."""
    s = structural(byte)
    return s, COARSE.get(s, 0), s if s in FEWER else "other", TERMINATORS.get(s, "other"), url_symbol(byte)


# How long a run of ASCII with how many spaces begins a text, and how a counter of other bytes ends it.
RUN, SPACES, UP, DOWN, FULL, BACK, MOST_TEXT = 500, 5, 3, 2, 300, 100, 0.95
_ASCII = np.zeros(256, bool)
_ASCII[9:14] = _ASCII[32:127] = True


def text_blocks(raw: bytes) -> list[tuple[bool, int]]:
    """(whether it is text, length) of the blocks of raw, in order.

    Text begins where more than RUN ASCII bytes with SPACES spaces or more follow each other (a run without them starts
    anew behind). It ends BACK bytes before a counter is over FULL, to which other bytes add and from which ASCII takes.
    """
    data = np.frombuffer(raw, np.uint8)
    ascii_, out, at, inside = _ASCII[data], [], 0, False
    while at < len(data):
        if inside:
            walk = np.cumsum(np.where(ascii_[at:], -DOWN, UP))
            full = np.flatnonzero(walk - np.minimum(np.minimum.accumulate(walk), 0) > FULL)
            end = len(data) if not len(full) else at + int(full[0]) + 1 - BACK
        else:
            end, breaks = at, np.append(np.flatnonzero(~ascii_[at:]) + at, len(data))
            k = 0
            while True:
                while k < len(breaks) and breaks[k] < end:
                    k += 1
                stop = int(breaks[k]) if k < len(breaks) else len(data)
                if stop - end > RUN:
                    if np.count_nonzero(data[end : end + RUN + 1] == 32) >= SPACES:
                        break
                    end += RUN + 1
                elif stop >= len(data):
                    end = len(data)
                    break
                else:
                    end = stop + 1
        end = max(end, at)
        if end > at:
            out.append((inside, end - at))
        inside, at = not inside, end
    return out


@F.pandas_udf(ArrayType(LongType()))
def block_sizes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bytes in text blocks, in others, and the number of blocks of each text."""
    for batch in texts:
        out = []
        for t in batch:
            blocks = text_blocks((t or "").encode())
            inside = sum(n for text, n in blocks if text)
            out.append([inside, sum(n for _, n in blocks) - inside, len(blocks)])
        yield pd.Series(out)


def followers(raw: np.ndarray, offsets: tuple[int, ...]) -> tuple[int, int]:
    """How many bytes have a context that came before, and how many of them follow it as the last time.

    offsets: how far before the byte the bytes of its context lie.
    """
    far = max(offsets)
    if len(raw) <= far:
        return 0, 0
    context = np.zeros(len(raw) - far, np.uint64)
    for k in offsets:
        context = context << np.uint64(8) | raw[far - k : len(raw) - k].astype(np.uint64)
    order = np.argsort(context, kind="stable")
    again = context[order][1:] == context[order][:-1]
    last = raw[far:][order]
    return int(again.sum()), int((again & (last[1:] == last[:-1])).sum())


def follower_counts(*contexts: tuple[int, ...]):
    """A column function: followers() of each context, one after the other."""

    @F.pandas_udf(ArrayType(LongType()))
    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            raws = (np.frombuffer((t or "").encode(), np.uint8) for t in batch)
            yield pd.Series([[n for c in contexts for n in followers(raw, c)] for raw in raws])

    return counts


def gram_counts(orders: tuple[int, ...]):
    """A column function: how many different runs of so many bytes (8 at most) a text has, for each order."""

    @F.pandas_udf(ArrayType(LongType()))
    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for t in batch:
                raw = np.frombuffer((t or "").encode(), np.uint8).astype(np.uint64)
                row = []
                for n in orders:
                    grams = np.zeros(max(0, len(raw) - n + 1), np.uint64)
                    for k in range(n):
                        grams = grams << np.uint64(8) | raw[k : k + len(grams)]
                    row.append(len(np.unique(grams)))
                out.append(row)
            yield pd.Series(out)

    return counts


# Separators that join runs of digits, by byte (T joins only after two), and buckets of run lengths (index: length up to 8).
SEPARATORS = {"-": "dash", ":": "colon", "J": "colon", ".": "dot", ",": "comma", "/": "slash", "+": "plus", "T": "bridge"}
RUN_BUCKETS = (0, 1, 2, 3, 4, 5, 5, 6, 6)


def run_bucket(n: int) -> int:
    return RUN_BUCKETS[n] if n < len(RUN_BUCKETS) else 7


def numeric_events(text: str) -> dict[tuple[str, str], int]:
    """How often each event and each value of a dimension comes over the bytes of a text; runs of digits are read whole."""
    raw, out = text.encode(), {}

    def add(kind: str, key: str, n: int = 1) -> None:
        if n:
            out[kind, key] = out.get((kind, key), 0) + n

    digit = np.zeros(len(raw) + 2, bool)
    digit[1:-1] = (np.frombuffer(raw, np.uint8) - 48) < 10
    starts, ends = np.flatnonzero(digit[1:] & ~digit[:-1]), np.flatnonzero(~digit[1:] & digit[:-1])
    digits = int(digit.sum())
    after = int((ends < len(raw)).sum())  # runs that a byte ends
    active = digits - len(starts) + after
    for name, n in (("all", len(raw)), ("digit", digits), ("continue_digit", digits - len(starts)), ("boundary_active", active), ("boundary_inactive", len(raw) - active), ("run_ended", after)):
        add("event", name, n)
    linked, segment, shape, quiet = None, 0, [], len(raw) - digits - after
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if linked and ends[k - 1] + 1 == a:
            add("event", "linked_run_start")
            add("separator", linked)
            segment += 1
        else:
            if linked:  # the byte behind the separator ended the sequence
                add("event", "sequence_end")
                quiet -= 1
            add("event", "start_digit")
            segment, shape = 0, []
        add("segment", str(min(segment, 5)), b - a)
        linked = None
        if b < len(raw):
            c = chr(raw[b])
            add("terminator", TERMINATORS.get(structural(raw[b]), "other"))
            add("run_length", str(run_bucket(min(b - a, 255))))
            if c in SEPARATORS and (c != "T" or segment >= 2):
                linked = SEPARATORS[c]
                add("event", "separator")
                shape.append(f"{run_bucket(min(b - a, 255))}-{linked}")
                add("shape", "/".join(shape))
            else:
                add("event", "sequence_end")
                segment = 0
    if linked and ends[-1] + 1 < len(raw):
        add("event", "sequence_end")
        quiet -= 1
    add("event", "non_numeric", quiet)
    return out
