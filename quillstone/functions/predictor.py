"""Context mixing, bit by bit: counters, runs and matches give probabilities, mixers weigh their logits, refiners correct the sum.

Every model has predict() and learn(bit); a text's bytes are coded from the highest bit to the lowest. All state is of one
text, so a text costs the same wherever it is coded, and decoding repeats what coding did. Columns of texts are measured
in Java (java/Mixing.java, java/PartialMatch.java), whose figures equal those of the classes here.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql.types import DoubleType

from ..runtime import java_function

LEAST = 1 / 65536
ORDERS = (1, 2, 3, 4, 6)


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


class Counters:
    """A probability for each context: it moves by 1 / (n + 1.5) of its error, n being how often it was met, up to a limit."""

    def __init__(self, limit: int = 255) -> None:
        self.limit, self.known = limit, {}

    def predict(self, context: object) -> float | None:
        """None for a context that was never met."""
        self.at = context
        state = self.known.get(context)
        return None if state is None else min(1 - LEAST, max(LEAST, state[0]))

    def learn(self, bit: int) -> None:
        p, n = self.known.get(self.at, (0.5, 0))
        self.known[self.at] = (p + (bit - p) / (n + 1.5), min(n + 1, self.limit))


class Runs:
    """The byte that followed a context the last time, and how often without a break; trust grows with the run, as learnt."""

    def __init__(self) -> None:
        self.known, self.trust = {}, Counters(1023)

    def begin(self, context: object) -> None:
        self.context = context
        self.byte, self.length = self.known.get(context, (None, 0))

    def predict(self, prefix: int) -> float | None:
        """prefix: the bits of this byte so far behind a leading 1."""
        size = prefix.bit_length() - 1
        if self.byte is None or (self.byte | 256) >> (8 - size) != prefix:
            self.bit = None
            return None
        self.bit = self.byte >> (7 - size) & 1
        right = self.trust.predict(min(self.length, 15)) or 0.6
        return right if self.bit else 1 - right

    def learn(self, bit: int) -> None:
        if self.bit is not None:
            self.trust.predict(min(self.length, 15))
            self.trust.learn(int(bit == self.bit))

    def end(self, byte: int) -> None:
        self.known[self.context] = (byte, self.length + 1) if byte == self.byte else (byte, 1)


class Match:
    """What followed the latest place with the same last LEAST_BYTES bytes; a match that failed is looked for anew."""

    LEAST_BYTES, LONGEST = 5, 255

    def __init__(self) -> None:
        self.places: dict[bytes, int] = {}
        self.trust = Counters(1023)
        self.at, self.length, self.byte, self.bit = -1, 0, None, None

    def begin(self, past: bytearray) -> None:
        if self.length and self.byte == past[-1]:
            self.at, self.length = self.at + 1, min(self.length + 1, self.LONGEST)
        else:
            self.length = 0
        key = bytes(past[-self.LEAST_BYTES :])
        if len(key) == self.LEAST_BYTES:
            if not self.length and key in self.places:
                self.at, self.length = self.places[key], self.LEAST_BYTES
                while self.length < self.LONGEST and self.at > self.length and past[self.at - self.length - 1] == past[len(past) - self.length - 1]:
                    self.length += 1
            self.places[key] = len(past)
        self.byte = past[self.at] if self.length else None

    def predict(self, prefix: int) -> float | None:
        size = prefix.bit_length() - 1
        if self.byte is None or (self.byte | 256) >> (8 - size) != prefix:
            self.bit = None
            return None
        self.bit = self.byte >> (7 - size) & 1
        right = self.trust.predict(min(self.length, 32)) or 0.75
        return right if self.bit else 1 - right

    def learn(self, bit: int) -> None:
        if self.bit is not None:
            self.trust.predict(min(self.length, 32))
            self.trust.learn(int(bit == self.bit))


class Mixer:
    """Weights for each selector; the sum of weighted logits is the logit. Gradient steps shrink to a floor."""

    def __init__(self, inputs: int, first: float = 0.3, rate: float = 0.08, floor: float = 0.01) -> None:
        self.inputs, self.first, self.rate, self.floor = inputs, first, rate, floor
        self.weights: dict[object, list] = {}

    def predict(self, x: list[float], selector: object) -> float:
        self.x = x
        self.state = self.weights.setdefault(selector, [[self.first] * self.inputs, 0])
        self.p = min(1 - LEAST, max(LEAST, logistic(sum(w * v for w, v in zip(self.state[0], x, strict=True)))))
        return self.p

    def learn(self, bit: int) -> None:
        weights, n = self.state
        step = max(self.floor, self.rate / (1 + n / 64)) * (bit - self.p)
        for k, v in enumerate(self.x):
            if v:
                weights[k] += step * v
        self.state[1] = n + 1


class Refiner:
    """What came of a prediction in its context before: bins of the logit, between two of which the answer lies."""

    BINS, SPAN = 24, 8.0

    def __init__(self, rate: float = 0.02) -> None:
        self.rate, self.known = rate, {}

    def predict(self, p: float, context: object) -> float:
        place = (min(self.SPAN, max(-self.SPAN, logit(p))) + self.SPAN) / (2 * self.SPAN) * self.BINS
        low = min(self.BINS - 1, int(place))
        if context not in self.known:
            self.known[context] = [logistic((2 * k / self.BINS - 1) * self.SPAN) for k in range(self.BINS + 1)]
        self.row, self.low, self.share = self.known[context], low, place - low
        return min(1 - LEAST, max(LEAST, (1 - self.share) * self.row[low] + self.share * self.row[low + 1]))

    def learn(self, bit: int) -> None:
        near = self.low + (self.share >= 0.5)
        self.row[near] += self.rate * (bit - self.row[near])


class Predictor:
    """All models together; models that know nothing of their context are left out of a mixture."""

    def __init__(self, pretraining: bytes = b"") -> None:
        self.past = bytearray()
        self.counters = [Counters(30 if k == 0 else 255) for k in range(len(ORDERS) + 2)]
        self.runs, self.match = [Runs() for _ in range(2)], Match()
        inputs = len(self.counters) + len(self.runs) + 2
        self.mixers, self.last = [Mixer(inputs) for _ in range(3)], Mixer(3, first=1 / 3, rate=0.02, floor=0.005)
        self.refiners = [Refiner(), Refiner()]
        self.word = 0
        self._begin()
        for byte in pretraining:
            for k in range(7, -1, -1):
                self.predict()
                self.learn(byte >> k & 1)

    def _begin(self) -> None:
        self.prefix = 1
        past = bytes(self.past[-8:])
        self.contexts = [past[-n:] for n in ORDERS if n <= len(past)]
        for r, n in zip(self.runs, (2, 4), strict=True):
            r.begin(past[-n:])
        if past:
            self.match.begin(self.past)

    def predict(self) -> float:
        """The probability that the next bit is 1."""
        found = [self.counters[0].predict(self.prefix)]
        for k, c in enumerate(self.contexts):
            found.append(self.counters[k + 1].predict((c, self.prefix)))
        found += [None] * (len(self.counters) - 1 - len(found))
        found.append(self.counters[-1].predict((self.word, self.prefix)))
        found += [r.predict(self.prefix) for r in self.runs]
        found.append(self.match.predict(self.prefix))
        x = [0.0 if p is None else logit(p) for p in found] + [0.3]
        last = self.past[-1] if self.past else 0
        known = sum(p is not None for p in found)
        mixed = [m.predict(x, s) for m, s in zip(self.mixers, (self.prefix, (last, known), min(self.match.length, 16)), strict=True)]
        p = self.last.predict([logit(q) for q in mixed], known)
        self.refined = [r.predict(p, c) for r, c in zip(self.refiners, (self.prefix, (last, self.prefix)), strict=True)]
        return min(1 - LEAST, max(LEAST, (2 * p + sum(self.refined)) / 4))

    def learn(self, bit: int) -> None:
        for k, c in enumerate(self.counters):
            if k == 0 or k == len(self.counters) - 1 or k <= len(self.contexts):
                c.learn(bit)
        for m in (*self.runs, self.match, *self.mixers, self.last, *self.refiners):
            m.learn(bit)
        self.prefix = self.prefix << 1 | bit
        if self.prefix > 255:
            byte = self.prefix & 255
            for r in self.runs:
                r.end(byte)
            self.past.append(byte)
            letter = chr(byte).lower()
            self.word = (self.word * 8416 + ord(letter)) % (1 << 32) if letter.isalpha() or byte > 127 else 0
            self._begin()


def coded_bits(raw: bytes, pretraining: bytes = b"") -> float:
    """Ideal bits of raw under the predictor."""
    model, total = Predictor(pretraining), 0.0
    for byte in raw:
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            p = model.predict()
            total -= math.log2(p if bit else 1 - p)
            model.learn(bit)
    return total


def encode(raw: bytes, pretraining: bytes = b"") -> bytes:
    """raw by an arithmetic coder of 32 bits under the predictor."""
    model, out, low, high = Predictor(pretraining), bytearray(), 0, 0xFFFFFFFF
    for byte in raw:
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            middle = low + (high - low) * int(model.predict() * 65536) // 65536
            low, high = (low, middle) if bit else (middle + 1, high)
            model.learn(bit)
            while low >> 24 == high >> 24:
                out.append(high >> 24)
                low, high = low << 8 & 0xFFFFFFFF, high << 8 & 0xFFFFFFFF | 255
    return bytes(out) + high.to_bytes(4, "big")


def decode(code: bytes, size: int, pretraining: bytes = b"") -> bytes:
    """The size bytes that encode() was given."""
    model, low, high, at = Predictor(pretraining), 0, 0xFFFFFFFF, 4
    here = int.from_bytes(code[:4].ljust(4, b"\0"), "big")
    out = bytearray()
    for _ in range(size):
        byte = 0
        for _ in range(8):
            middle = low + (high - low) * int(model.predict() * 65536) // 65536
            bit = int(here <= middle)
            low, high = (low, middle) if bit else (middle + 1, high)
            model.learn(bit)
            byte = byte << 1 | bit
            while low >> 24 == high >> 24:
                low, high = low << 8 & 0xFFFFFFFF, high << 8 & 0xFFFFFFFF | 255
                here = here << 8 & 0xFFFFFFFF | (code[at] if at < len(code) else 0)
                at += 1
        out.append(byte)
    return bytes(out)


class PartialMatch:
    """Prediction by partial matching: from the longest context that is known down, an escape costs as many as there are different bytes.

    Bytes that a longer context already offered are left out below (exclusion).
    """

    def __init__(self, order: int = 4, limit: int = 124) -> None:
        self.order, self.limit, self.counts, self.past = order, limit, {}, bytearray()

    def distribution(self) -> np.ndarray:
        """The probability of each next byte."""
        out, left, gone = np.zeros(256), 1.0, np.zeros(256, bool)
        for n in range(min(self.order, len(self.past)), -1, -1):
            seen = self.counts.get(bytes(self.past[len(self.past) - n :]))
            if seen:
                items = [(b, c) for b, c in seen.items() if not gone[b]]
                whole = sum(c for _, c in items) + len(items)
                if items:
                    for b, c in items:
                        out[b] += left * c / whole
                    gone[[b for b, _ in items]] = True
                    left *= len(items) / whole
        if not gone.all():
            out[~gone] += left / int((~gone).sum())
            left = 0.0
        return out / out.sum()

    def learn(self, byte: int) -> None:
        for n in range(min(self.order, len(self.past)) + 1):
            seen = self.counts.setdefault(bytes(self.past[len(self.past) - n :]), {})
            seen[byte] = seen.get(byte, 0) + 1
            if seen[byte] > self.limit:  # old counts fade
                for b in list(seen):
                    seen[b] = (seen[b] + 1) // 2
        self.past.append(byte)

    @classmethod
    def bits(cls, raw: bytes, order: int = 4) -> float:
        model, total = cls(order), 0.0
        for byte in raw:
            total -= math.log2(model.distribution()[byte])
            model.learn(byte)
        return total


def mixing_bits(spark: SparkSession, data) -> Column:
    """coded_bits() of binary values."""
    return java_function(spark, "Mixing", DoubleType())(data)


def matching_bits(spark: SparkSession, data) -> Column:
    """PartialMatch.bits() of binary values."""
    return java_function(spark, "PartialMatch", DoubleType())(data)
