"""URLs and sequences of numbers inside running text, as far as its last character tells."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .text import WRT_FROM, WRT_TO

# Keys after which a bare domain counts as a URL, how far it may be from them, and the longest URLs.
KEYS = ("url=", "website=", "homepage=")
KEY_REACH, LONGEST, LONGEST_BARE = 64, 4096, 1024
# The most segments of a sequence of numbers, and what joins them (T only after two).
SEGMENTS, JOINERS = 5, "-:.,/+"

_START = re.compile(r"(?:https?|ftp)://|(?<![:/\w])//(?=[\w-]+\.)|(?<![\w.])www\.", re.I)
_BARE = re.compile(rf"(?:{'|'.join(KEYS)})[^\n]{{0,{KEY_REACH}}}?(?<![\w.-])(?=(?:[a-z0-9-]+\.)+[a-z]{{2,}}(?:[/:?#]|\Z))", re.I)
_STOP = re.compile(r"[\s\"'<>|\x00-\x1f]")
_ADDRESS = re.compile(r"^(?:[a-z]+:)?//(?:[^@/]*@)?\[[0-9a-f:.]*\]", re.I)
_PARTS = re.compile(r"(?:[a-z]+:)?(?://)?(?:[^@/?#]*@)?(?P<host>\[[0-9A-Fa-f:.]*\]?|[^:/?#]*)(?P<port>:[0-9]*)?(?P<path>/[^?#]*)?(?P<query>\?[^#]*)?(?P<fragment>#.*)?\Z", re.S | re.I)
NUMBERS = f"[0-9]+(?:[{JOINERS}][0-9]+){{1,{SEGMENTS - 1}}}(?:T[0-9]+(?:[{JOINERS}][0-9]+){{0,2}})?|[0-9]+"


class State(NamedTuple):
    confidence: str
    role: str
    url: str | None
    host: str | None


OUTSIDE = State("outside", "outside", None, None)


def _open(url: str, linked: bool) -> bool:
    """Whether nothing in the URL has ended it: marks, a bracket of the link around it, a parenthesis that never opened."""
    if _STOP.search(url):
        return False
    depth = 0
    for c in re.findall(r"[()]", url):
        depth += 1 if c == "(" else -1
        if depth < 0:
            return False
    return not (linked and "]" in _ADDRESS.sub("", url))


def url_state(text: str | None, aliased: bool = False) -> State:
    """Whether the end of text lies in a URL, in which part, and the URL so far.

    With aliased, punctuation that word-coded text permutes is read as what it stands for. Null is outside.
    """
    if not text:
        return OUTSIDE
    if aliased:
        text = text.translate({ord(b): a for a, b in zip(WRT_FROM, WRT_TO, strict=True) if b in "JKLMNO"})
    starts = [(m.start(), LONGEST) for m in _START.finditer(text)] or [(m.end(), LONGEST_BARE) for m in _BARE.finditer(text)]
    for at, longest in starts:
        url = text[at:]
        if len(url.encode()) > longest or not _open(url, text[at - 1 : at] == "["):
            continue
        parts = _PARTS.match(url)
        if parts is None or not parts["host"]:
            continue
        return State("confirmed", _role(parts), url, parts["host"].lower())
    return OUTSIDE


def _role(parts: re.Match) -> str:
    if parts["fragment"]:
        return "fragment"
    if parts["query"]:
        return "query_value" if "=" in parts["query"].rsplit("&", 1)[-1] else "query_key"
    if parts["path"]:
        return "extension" if "." in parts["path"].rsplit("/", 1)[-1] else "path_segment"
    return "port" if parts["port"] else "domain"


_STATE = StructType([StructField(name, StringType()) for name in State._fields])


@F.pandas_udf(_STATE)
def url_states(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """url_state() of each text."""
    for batch in texts:
        yield pd.DataFrame([url_state(t) for t in batch], columns=State._fields)
