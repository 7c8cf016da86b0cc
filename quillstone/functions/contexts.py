"""What a byte's past says about it: brackets that are open, and mixtures of models of several orders."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .text import causal_bits

# Brackets that pair, and the longest distance that counts.
BRACKETS = {"(": ")", "{": "}", "[": "]", "<": ">"}
FARTHEST = 255
_ANY = re.compile("[" + re.escape("".join(BRACKETS) + "".join(BRACKETS.values())) + "]")
_PAIRS = ArrayType(StructType([StructField("bracket", StringType()), StructField("distance", IntegerType()), StructField("n", LongType())]))


def bracket_pairs(text: str) -> Counter:
    """How often a bracket closes at each distance (in characters, FARTHEST and more in one).

    A closing bracket that doesn't fit the innermost open one is passed over; open ones farther than FARTHEST are
    kept, so that a pair of any length counts once.
    """
    found: Counter = Counter()
    open_: list[tuple[str, int]] = []
    for m in _ANY.finditer(text):
        c = m[0]
        if c in BRACKETS:
            open_.append((c, m.start()))
        elif open_ and BRACKETS[open_[-1][0]] == c:
            b, at = open_.pop()
            found[b, min(FARTHEST, m.start() - at)] += 1
    return found


@F.pandas_udf(_PAIRS)
def bracket_distances(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """bracket, distance, n of each text; counted before any shuffle."""
    for batch in texts:
        yield batch.map(lambda t: [{"bracket": b, "distance": d, "n": n} for (b, d), n in sorted(bracket_pairs(t or "").items())])


def mixed_bits(text: str | None, orders: tuple[int, ...] = (0, 1, 2)) -> list[float]:
    """Bits of a text's bytes under each order, then under their mixture.

    Weights begin equal and follow each order's probability of all bytes so far, so the mixture's probability of the
    text is the mean of the orders' own, and no more than log2 of their number is lost against the best. Bytes that
    lack the longest context count under the orders that have theirs.
    """
    size = len((text or "").encode())
    losses = np.zeros((len(orders), size))
    for row, order in zip(losses, orders, strict=True):
        _, bits = causal_bits(text, order)
        row[:] = 8.0
        if len(bits):
            row[order:] = bits
    sums = losses.sum(axis=1)
    best = sums.min()
    return [*sums.tolist(), float(best - np.log2(np.mean(np.exp2(best - sums))))]


@F.pandas_udf(ArrayType(DoubleType()))
def mixture(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """mixed_bits() of each text."""
    for batch in texts:
        yield batch.map(mixed_bits)
