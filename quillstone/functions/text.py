"""Column functions over text and its bytes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

# Substrings whose rate is a structural feature, by feature name.
PATTERNS = {
    "template_open": "{{", "template_close": "}}", "link_open": "[[", "link_close": "]]", "table_open": "{|", "table_row": "|-",
    "math_tag": "<math", "ref_tag": "<ref", "html_tag": "<", "equals": "=", "pipe": "|",
}
# The character permutation of word-coded text; applying it twice changes nothing.
WRT_FROM = "{|}~PQRS:;<=>?JKLMNOX`"
WRT_TO = "PQRS{|}~JKLMNO:;<=>?`X"


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def occurrences(text: Column, pattern: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(pattern), F.lit("")))) / len(pattern)).cast("long")


def wrt_permute(text: Column) -> Column:
    return F.translate(text, WRT_FROM, WRT_TO)


def digit_shape(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]", "D")


@F.pandas_udf(ArrayType(LongType()))
def byte_histogram(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Counts of the 256 byte values of each text; one pass, instead of a row for each byte."""
    for batch in texts:
        yield pd.Series([np.bincount(np.frombuffer((t or "").encode(), np.uint8), minlength=256) for t in batch])


# Names of the structural features of a text: shape, patterns per KiB, shares of ASCII bytes.
SHAPE = (
    "log2_bytes", "byte_entropy", "ascii_ratio", "non_ascii_ratio", "digit_ratio", "upper_ratio", "lower_ratio", "whitespace_ratio", "words_per_kib", "average_word_length",
    "number_token_ratio", "lines_per_kib",
)
FEATURES = (*SHAPE, *(f"{k}_per_kib" for k in PATTERNS), *(f"ascii_{k:03d}" for k in range(128)))
_NUMBER = re.compile(rb"(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_])")
_LETTER = np.zeros(256, bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_SLICE = 1 << 20


def structural_features(raw: bytes) -> np.ndarray:
    """FEATURES of a text's bytes; a ratio to nothing is 0. Long texts are read in slices."""
    counts, words, before = np.zeros(256, np.int64), 0, False
    for a in range(0, len(raw), _SLICE):
        part = np.frombuffer(raw, np.uint8, min(_SLICE, len(raw) - a), a)
        counts += np.bincount(part, minlength=256)
        letters = _LETTER[part]
        words += int(letters[0] and not before) + int(np.count_nonzero(letters[1:] & ~letters[:-1]))
        before = bool(letters[-1])
    numbers = sum(1 for _ in _NUMBER.finditer(raw)) if counts[48:58].any() else 0
    size, ascii_ = len(raw), int(counts[:128].sum())
    kib = size / 1024
    ratio = lambda a, b: a / b if b else 0.0
    share = counts[counts > 0] / max(size, 1)
    letters = int(counts[_LETTER].sum())
    shape = [
        np.log2(size + 1), -float((share * np.log2(share)).sum()) + 0.0, ratio(ascii_, size), ratio(size - ascii_, size), ratio(int(counts[48:58].sum()), size), ratio(int(counts[65:91].sum()), size),
        ratio(int(counts[97:123].sum()), size), ratio(int(counts[[9, 10, 13, 32]].sum()), size), ratio(words, kib), ratio(letters, words), ratio(numbers, words + numbers), ratio(int(counts[10]), kib),
    ]
    rates = [ratio(int(counts[ord(p)]) if len(p) == 1 else raw.count(p.encode()) if counts[ord(p[0])] else 0, kib) for p in PATTERNS.values()]
    return np.concatenate([shape, rates, counts[:128] / max(ascii_, 1)])


def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (id, text): the id and its text's FEATURES to six places (halves of the double go up); a null text is empty."""
    for batch in batches:
        block = np.array([structural_features((t.as_py() or "").encode()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
        block = np.floor(block * 1e6 + 0.5) / 1e6
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in block.T)], names=[batch.schema.names[0], *FEATURES])


@F.pandas_udf(DoubleType())
def order0_bits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Ideal bits of a text under an adaptive byte model: rising factorials of its histogram, in closed form."""
    grown = lambda n, start: math.lgamma(n + start) - math.lgamma(start)
    for batch in texts:
        out = []
        for t in batch:
            counts = np.bincount(np.frombuffer((t or "").encode(), np.uint8), minlength=256)
            out.append((grown(int(counts.sum()), 128.0) - sum(grown(n, 0.5) for n in counts[counts > 0].tolist())) / math.log(2))
        yield pd.Series(out, dtype=float)


def slots(counts: Column, first: int, last: int) -> Column:
    """Sum of a histogram's entries first..last."""
    return F.aggregate(F.slice(counts, first + 1, last - first + 1), F.lit(0).cast("long"), lambda a, x: a + x)


def byte_array(text: Column) -> Column:
    """The bytes of a text as two hex digits each."""
    return F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))


def toggle_runs(text: Column, marks: str = "{}[]&") -> Column:
    """Runs of exactly one mark become two and of exactly two one; longer ones stay, so twice changes nothing."""
    runs = F.regexp_extract_all(text, F.lit(runs_pattern(marks)), F.lit(0))
    swapped = lambda r: F.when((F.length(r) > 2) | ~F.substring(r, 1, 1).isin(list(marks)), r).when(F.length(r) == 1, F.concat(r, r)).otherwise(F.substring(r, 1, 1))
    return F.array_join(F.transform(runs, swapped), "")


def runs_pattern(marks: str = "{}[]&") -> str:
    """Runs of one mark, or of characters that are none."""
    return "|".join(f"[{m if m != ']' and m != '[' else chr(92) + m}]+" for m in marks) + "|[^" + "".join(chr(92) + m if m in "[]&" else m for m in marks) + "]+"


def causal_bits(text: str | None, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with `order` bytes before it, and its ideal bits by the counts of its context so far in the text."""
    raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.int64)
    size = max(0, len(raw) - order)
    context = np.zeros(size, np.int64)
    for j in range(order):
        context = context * 256 + raw[j : j + size]
    last = raw[order:]
    return last, np.log2(_earlier(context) + 128.0) - np.log2(_earlier(context * 256 + last) + 0.5)


def _earlier(keys: np.ndarray) -> np.ndarray:
    """How often each key came before."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    start = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(keys)]
    out = np.empty(len(keys), np.int64)
    at = np.arange(len(keys))
    out[order] = at - np.maximum.accumulate(np.where(start, at, 0))
    return out


# Classes of bytes, in the order of class_sums().
CLASSES = ("digit", "letter", "space", "punctuation", "high")


def byte_classes() -> np.ndarray:
    """The place in CLASSES of each byte value."""
    out = np.full(256, 3)
    out[128:] = 4
    for i in range(128):
        out[i] = 0 if chr(i).isdigit() else 1 if chr(i).isalpha() else 2 if i in b" \t\n\r" else 3
    return out


def class_sums(order: int):
    """A column function: bytes and bits of a text by class of byte, as ten doubles."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def sums(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places = byte_classes()
        for batch in texts:
            out = []
            for t in batch:
                last, bits = causal_bits(t, order)
                c = places[last]
                out.append(np.concatenate([np.bincount(c, minlength=5).astype(float), np.bincount(c, bits, 5)]))
            yield pd.Series(out)

    return sums
