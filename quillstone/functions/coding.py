"""Reversible codings of text: entities, words of a dictionary, bytes by an adaptive arithmetic coder.

Every coding has an inverse, and inverse(coding(x)) = x for all x, also for texts that hold the marks themselves.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..runtime import java_function

# Entities and the shorter forms that stand for them after &.
ENTITIES = {"&quot;": '&"', "&lt;": "&<", "&gt;": "&>"}
# Entities of escaped text (after &&), and the one character that stands for them.
NAMED = {"quot": '"', "nbsp": "!", "ndash": "*", "mdash": "^", "deg": "°", "times": "×", "lt": "<", "gt": ">"}
# Marks of word codes: a capital, capitals, their end, an escaped byte; and the bounds of code lengths.
CAPITAL, CAPITALS, CAPITALS_END, ESCAPE = 0x40, 0x07, 0x06, 0x0C
ONE_BYTE, TWO_BYTES, THREE_BYTES = 80, 3920, 44_880
LEAST_PART = 7

_KEEP, _WIDE = "\x03", "\x05"
_BY_SIGN = {v: k for k, v in NAMED.items()}
_SHRINK = re.compile(
    "(?P<name>&amp;(?:" + "|".join(NAMED) + "));|(?P<wide>&amp;#(?P<code>[1-9][0-9]{2,6});)|(?P<amp>&amp;)|(?P<other>" + "|".join(ENTITIES) + ")|(?P<mark>[&\x03\x05])"
)
_SIGNS = re.escape("".join(_BY_SIGN))
_GROW = re.compile(f"&&(?P<sign>[{_SIGNS}])|(?P<amp>&&(?:{_KEEP}(?=[{_SIGNS}]))?)|&(?P<other>[\"<>])|{_KEEP}(?P<mark>.)|{_WIDE}(?P<wide>.)", re.S)
_LONG = {v: k for k, v in ENTITIES.items()}


def shrink_entities(text: str) -> str:
    """Entities as short forms; what could be read as one, and the marks 3 and 5, follow a mark 3."""

    def short(m: re.Match) -> str:
        if m["name"]:
            return "&&" + NAMED[m["name"][5:]]
        if m["wide"]:
            code = int(m["code"])
            if 255 < code < 0x110000 and not 0xD800 <= code < 0xE000:
                return _WIDE + chr(code)
            return "&&" + m["wide"][5:]
        if m["amp"]:
            after = text[m.end() : m.end() + 1]
            return "&&" + (_KEEP if after in _BY_SIGN else "")
        return ENTITIES[m["other"]] if m["other"] else _KEEP + m["mark"]

    return _SHRINK.sub(short, text)


def grow_entities(text: str) -> str:
    """The inverse of shrink_entities()."""

    def full(m: re.Match) -> str:
        if m["sign"]:
            return f"&amp;{_BY_SIGN[m['sign']]};"
        if m["amp"]:
            return "&amp;"
        if m["other"]:
            return _LONG["&" + m["other"]]
        return m["mark"] or f"&amp;#{ord(m['wide'])};"

    return _GROW.sub(full, text)


class WordCode:
    """Words of a dictionary (in order of rank) as codes of one to three bytes from 0x80 up; the rest as bytes.

    A capital or capitals become marks before the lower-case word. An unknown word is coded by its longest known
    suffix, else prefix, of LEAST_PART or more letters; its other letters stay.
    """

    def __init__(self, words: list[str]) -> None:
        self.check(words)
        self.codes = {w: self._code(i) for i, w in enumerate(words)}
        self.words = {c: w.encode() for w, c in self.codes.items()}
        longest = max(map(len, words), default=1)
        self._token = re.compile(rb"[A-Z]?[a-z]{1,%d}|[A-Z]{1,%d}" % (longest + 1, longest + 1))
        self._mark = re.compile(b"[%c%c%c%c\x80-\xff]" % (CAPITAL, CAPITALS, CAPITALS_END, ESCAPE))
        self._read = re.compile(rb"\x0c(?P<byte>[\x00-\xff])|(?P<flag>[\x40\x07\x06])|(?P<code>[\x80-\xcf]|[\xd0-\xef][\x80-\xff]|[\xf0-\xff][\x80-\xff][\x80-\xff])|(?P<plain>[a-z]+)|(?P<rest>[^\x06\x07\x0c\x40a-z\x80-\xff]+)", re.S)

    @staticmethod
    def check(words: list[str]) -> None:
        if len(words) > THREE_BYTES:
            raise ValueError(f"a dictionary has at most {THREE_BYTES} words")

    @staticmethod
    def _code(i: int) -> bytes:
        """80 codes of one byte, 3,840 of two, 40,960 of three."""
        if i < ONE_BYTE:
            return bytes([0x80 + i])
        if i < TWO_BYTES:
            high, low = divmod(i - ONE_BYTE, 120)
            return bytes([0xD0 + high, 0x80 + low])
        high, low = divmod(i - TWO_BYTES, 128)
        return bytes([0xF0 + high // 128, 0x80 + high % 128, 0x80 + low])

    def _word(self, w: str) -> bytes:
        if w in self.codes:
            return self.codes[w]
        for n in range(len(w) - 1, LEAST_PART - 1, -1):
            if w[-n:] in self.codes:
                return w[:-n].encode() + self.codes[w[-n:]]
        for n in range(len(w) - 1, LEAST_PART - 1, -1):
            if w[:n] in self.codes:
                return self.codes[w[:n]] + w[n:].encode()
        return w.encode()

    def encode(self, raw: bytes) -> bytes:
        out, at = [], 0
        escape = lambda m: bytes([ESCAPE]) + m[0]
        for m in self._token.finditer(raw):
            out.append(self._mark.sub(escape, raw[at : m.start()]))
            w, at = m[0].decode(), m.end()
            if w.isupper():
                out.append(bytes([CAPITAL if len(w) == 1 else CAPITALS]))
                out.append(self._word(w.lower()))
                if raw[at : at + 1].islower() or raw[at : at + 1].isupper():
                    out.append(bytes([CAPITALS_END]))
            else:
                out.append((bytes([CAPITAL]) if w[0].isupper() else b"") + self._word(w.lower()))
        out.append(self._mark.sub(escape, raw[at:]))
        return b"".join(out)

    def decode(self, coded: bytes) -> bytes:
        out: list[bytes] = []
        state = 0
        for m in self._read.finditer(coded):
            if m["flag"]:
                state = 0 if m["flag"][0] == CAPITALS_END else m["flag"][0]
                continue
            if m["byte"] or m["rest"]:
                out.append(m["byte"] or m["rest"])
                state = 0
                continue
            letters = self.words[m["code"]] if m["code"] else m["plain"]
            if state == CAPITALS:
                letters = letters.upper()
            elif state == CAPITAL:
                letters, state = letters[:1].upper() + letters[1:], 0
            out.append(letters)
        return b"".join(out)


class Coder:
    """Bytes by binary arithmetic coding: each bit by the adaptive chance of its node among the byte's 255."""

    RATE, ONE = 4, 1 << 16

    @classmethod
    def encode(cls, raw: bytes) -> bytes:
        chances, low, high, out = [cls.ONE // 2] * 256, 0, 0xFFFFFFFF, bytearray()
        for byte in raw:
            node = 1
            for shift in range(7, -1, -1):
                bit, p = byte >> shift & 1, chances[node]
                middle = low + (high - low >> 16) * p
                if bit:
                    high = middle
                    chances[node] = p + (cls.ONE - p >> cls.RATE)
                else:
                    low = middle + 1
                    chances[node] = p - (p >> cls.RATE)
                node = node * 2 + bit
                while not (low ^ high) >> 24:
                    out.append(high >> 24)
                    low, high = low << 8 & 0xFFFFFFFF, (high << 8 & 0xFFFFFFFF) | 255
        return bytes(out) + high.to_bytes(4, "big")

    @classmethod
    def decode(cls, coded: bytes, size: int) -> bytes:
        chances, low, high, out = [cls.ONE // 2] * 256, 0, 0xFFFFFFFF, bytearray()
        at, value = 4, int.from_bytes(coded[:4], "big")
        for _ in range(size):
            node = 1
            while node < 256:
                p = chances[node]
                middle = low + (high - low >> 16) * p
                if bit := value <= middle:
                    high = middle
                    chances[node] = p + (cls.ONE - p >> cls.RATE)
                else:
                    low = middle + 1
                    chances[node] = p - (p >> cls.RATE)
                node = node * 2 + bit
                while not (low ^ high) >> 24:
                    low, high = low << 8 & 0xFFFFFFFF, (high << 8 & 0xFFFFFFFF) | 255
                    value = (value << 8 & 0xFFFFFFFF) | (coded[at] if at < len(coded) else 0)
                    at += 1
            out.append(node - 256)
        return bytes(out)


def _column(kind, f: Callable):
    @F.pandas_udf(kind)
    def column(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in values:
            yield batch.map(lambda x: None if x is None else f(x))

    return column


def entities_shrunk(text):
    """Column of texts whose entities have short forms; null stays null."""
    return _column(StringType(), shrink_entities)(text)


def entities_grown(text):
    """The inverse of entities_shrunk()."""
    return _column(StringType(), grow_entities)(text)


def words_coded(spark: SparkSession, text, words: list[str]) -> Column:
    """Column of word codes of texts, as binary; null stays null. The dictionary has a bounded size and is sent with the tasks."""
    WordCode.check(words)
    return java_function(spark, "WordCoded", BinaryType(), "\n".join(words), False)(text.cast("binary"))


def words_restored(spark: SparkSession, coded, words: list[str]) -> Column:
    """The inverse of words_coded()."""
    WordCode.check(words)
    return java_function(spark, "WordCoded", BinaryType(), "\n".join(words), True)(coded).cast("string")


def packed(spark: SparkSession, data) -> Column:
    """Column of binary values by the arithmetic coder, each by itself: size in four bytes, then the code; null stays null."""
    return java_function(spark, "Packed", BinaryType())(data)


def unpacked(spark: SparkSession, data) -> Column:
    """The inverse of packed()."""
    return java_function(spark, "Unpacked", BinaryType())(data)
