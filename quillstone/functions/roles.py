"""Which part of a URL each of its bytes belongs to, online corrections of predictions, and bits of bytes by halves."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Roles whose predictions are corrected.
CORRECTED = ("path_segment", "extension", "query_key", "query_value")
_URL = re.compile(r"(?P<scheme>[a-z]+://)(?P<domain>[^/?#]*)(?P<path>[^?#]*)(?P<query>\?[^#]*)?(?P<fragment>#.*)?", re.S)


def byte_roles(url: str) -> list[tuple[str, int]]:
    """(role, bytes) of the parts of a URL in order; a separator belongs to what it opens; without a scheme there is none."""
    m = _URL.fullmatch(url)
    if m is None:
        return []
    parts = [("scheme", m["scheme"]), ("domain", m["domain"])]
    for segment in re.findall("/[^/]*", m["path"]):
        name, dot, rest = segment.partition(".")
        parts += [("path_segment", name), ("extension", dot + rest)]
    for pair in re.findall("[?&][^&]*", m["query"] or ""):
        key, equals, rest = pair.partition("=")
        parts += [("query_key", key), ("query_value", equals + rest)]
    parts.append(("fragment", m["fragment"] or ""))
    return [(role, len(p.encode())) for role, p in parts if p]


def role_sums(url: str | None) -> list[dict]:
    sums: Counter = Counter()
    for role, n in byte_roles(url or ""):
        sums[role] += n
    return [{"role": r, "n": n} for r, n in sums.items()]


class Correction:
    """Weights that shift a probability's logit, learnt online for each role and for each context in it."""

    def __init__(self, contexts: int = 1024, features: int = 6, rate: float = 0.001) -> None:
        self.of_role = {r: np.zeros(features) for r in CORRECTED}
        self.of_context = np.zeros((contexts, features))
        self.rate = rate

    def features(self, others: list[float]) -> np.ndarray:
        """1, then the logits of other models' probabilities within 4 of 0, as far as there is room."""
        x = np.zeros(self.of_context.shape[1])
        logits = np.log(others) - np.log1p(-np.asarray(others)) if len(others) else np.zeros(0)
        x[0] = 1.0
        x[1 : 1 + len(logits)] = np.clip(logits, -4, 4)[: len(x) - 1]
        return x

    def predict(self, base: float, others: list[float], role: str, context: int) -> float:
        if role not in self.of_role:
            return base
        shift = self.features(others) @ (self.of_role[role] + self.of_context[context % len(self.of_context)])
        return float(1 / (1 + np.exp(-(np.log(base) - np.log1p(-base) + shift))))

    def learn(self, base: float, others: list[float], role: str, context: int, bit: int) -> None:
        """One step against the error of the prediction that predict() makes now."""
        if role in self.of_role:
            step = self.rate * (self.predict(base, others, role, context) - bit) * self.features(others)
            self.of_role[role] -= step
            self.of_context[context % len(self.of_context)] -= step


def halved_bits(counts: np.ndarray) -> float:
    """Bits of bytes with such counts when each is coded as eight decisions between halves of the range that is left."""
    total, level = 0.0, counts.astype(float)
    for _ in range(8):
        pairs = level.reshape(-1, 2)
        whole = pairs.sum(1)
        for side in (0, 1):
            n = pairs[:, side]
            some = n > 0
            total -= float((n[some] * np.log2(n[some] / whole[some])).sum())
        level = whole
    return total


@F.pandas_udf(DoubleType())
def bits_by_halves(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """halved_bits() of each text's bytes under its own histogram."""
    for batch in texts:
        yield pd.Series([halved_bits(np.bincount(np.frombuffer((t or "").encode(), np.uint8), minlength=256)) for t in batch], dtype=float)
