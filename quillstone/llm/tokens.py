"""Byte-level BPE ids of whole Arrow columns, equal to those of the tokenizers library.

Texts are cut into pre-tokens in NumPy; each distinct pre-token is merged once and kept in a cache of at most
CACHE pre-tokens, since merging is what costs time. A text that the fast path can't treat (a character from U+0530,
or the string of a special token), or a tokenizer that isn't plain byte-level BPE, goes to the library itself.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import buffers, groups, mix

CACHE = 700_000
PIECE = 1 << 20
_LIMIT = 0x530
_P = 0xA0761D6478BD642F | 1
_P_INV = pow(_P, -1, 1 << 64)


def _byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies, reversed."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space of the code points under _LIMIT."""
    import regex

    out = np.zeros(_LIMIT, np.uint8)
    for kind, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\p{White_Space}")):
        found = regex.compile(pattern)
        for c in range(_LIMIT):
            if found.fullmatch(chr(c)):
                out[c] = kind
    return out


class Encoder:
    def __init__(self, path: str) -> None:
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"].get("vocab", {})
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.dtype = np.dtype(np.uint16 if max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))] if isinstance(vocab, dict) else [1 << 16]) < 1 << 16 else np.uint32)
        self.fast = None
        if self._plain(spec):
            import tiktoken

            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            self.ranks = ranks
            self.fast = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
            self.classes = _classes()
            self.values = mix(np.arange(1, _LIMIT + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            self.powers = np.zeros((2, 0), np.uint64)
            self._reset()

    @property
    def library(self):
        """The library's tokenizer; loaded when a text needs it."""
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    @staticmethod
    def _plain(spec: dict) -> bool:
        """Byte-level BPE with the usual pre-token pattern, whose merges are in the order of their ids."""
        m, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if m.get("type") != "BPE" or spec.get("normalizer") or m.get("dropout") or m.get("continuing_subword_prefix") or m.get("end_of_word_suffix") or m.get("ignore_merges"):
            return False
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return False
        vocab = m["vocab"]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in m["merges"]]
        ids = [vocab.get("".join(x), -1) for x in pairs]
        return all(a < b for a, b in zip(ids, ids[1:], strict=False)) and (not ids or ids[0] >= 256)

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int32)
        self.pool = np.zeros(0, self.dtype)

    def _tables(self, n: int) -> np.ndarray:
        if self.powers.shape[1] < n:
            out = np.empty((2, max(n, 1 << 20)), np.uint64)
            for row, base in zip(out, (_P, _P_INV), strict=True):
                row[:] = base
                row[0] = 1
                np.multiply.accumulate(row, out=row)
            self.powers = out
        return self.powers

    def _starts(self, cp: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin; bounds: first characters of the texts, ascending, then the end."""
        n = len(cp)
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        white = kind == 3
        start = np.ones(n, bool)
        start[1:] = np.where(white[1:], ~white[:-1], (kind[1:] != kind[:-1]) & (cp[:-1] != 0x20))
        inner = white[:-1] & ~white[1:] & ~first[1:n]
        start[:-1] |= inner  # the last of white space before a text's next character
        start[first[:n]] = True
        marks = np.flatnonzero((cp == 0x27) & start)
        if len(marks):
            at = np.concatenate([cp, [0, 0]])
            end = bounds[np.searchsorted(bounds, marks, "right")]
            a, b = at[marks + 1], at[marks + 2]
            one = np.isin(a, [ord(c) for c in "stmd"]) & (marks + 2 <= end)
            two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (marks + 3 <= end) & ~one
            inside = np.concatenate([marks[one] + 1, marks[two] + 1, marks[two] + 2])
            start[inside[~first[inside]]] = False
            after = np.concatenate([marks[one] + 2, marks[two] + 3])
            start[after[after < n]] = True
        return np.flatnonzero(start)

    def _fast(self, text: str, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in text, and the first id of each (one more than texts)."""
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(cp):
            return np.zeros(0, self.dtype), np.zeros(len(bounds), np.int64)
        small = np.minimum(cp, _LIMIT - 1)
        starts = self._starts(cp, self.classes[small], bounds)
        ends = np.append(starts[1:], len(cp))
        power, inverse = self._tables(len(cp))
        total = np.empty(len(cp) + 1, np.uint64)
        total[0] = 0
        np.cumsum(self.values[small] * power[: len(cp)], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        keys, sample, inverse_of = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            if len(self.keys) + len(keys) > CACHE:
                self._reset()
                known[:] = False
            self._learn(keys[~known], [text[a:b] for a, b in zip(starts[sample[~known]].tolist(), ends[sample[~known]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        where, sizes = self.place[at], self.sizes[at]
        each = sizes[inverse_of].astype(np.int64)
        firsts = np.cumsum(each) - each
        n = int(each.sum())
        ids = self.pool[np.repeat(where[inverse_of] - firsts, each) + np.arange(n)]
        return ids, np.append(firsts, n)[np.searchsorted(starts, bounds)]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ranks, merge = self.ranks, self.fast._core_bpe.encode_single_piece
        flat: list[int] = []
        sizes = np.empty(len(pieces), np.int32)
        for k, piece in enumerate(pieces):
            raw = piece.encode()
            one = ranks.get(raw)
            if one is not None:
                flat.append(one)
                sizes[k] = 1
            else:
                ids = merge(raw)
                flat += ids
                sizes[k] = len(ids)
        place = len(self.pool) + np.cumsum(sizes, dtype=np.int64) - sizes
        self.pool = np.concatenate([self.pool, np.array(flat, self.dtype)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place, self.sizes = (np.insert(a, at, b) for a, b in ((self.keys, keys), (self.place, place), (self.sizes, sizes)))

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids, first id of each row and the end), for about a megabyte of text at a time."""
        offsets, data = buffers(column)
        for first, last in groups(offsets, PIECE):
            raw = data[offsets[first] : offsets[last]].tobytes()
            lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # first bytes of characters
            bounds = np.searchsorted(lead, offsets[first : last + 1] - offsets[first])
            text = raw.decode()
            odd = np.ones(last - first, bool)
            if self.fast is not None:
                odd[:] = False
                high = np.flatnonzero(np.frombuffer(raw, np.uint8) >= 0xD4)  # lead bytes from U+0500
                if len(high):
                    chars = np.searchsorted(lead, high)
                    chars = chars[[ord(text[c]) >= _LIMIT for c in chars.tolist()]] if len(high) < 1000 else chars
                    odd[np.unique(np.searchsorted(bounds, chars, "right") - 1)] = True
                for word in self.special:
                    if word in text:
                        for d in range(last - first):
                            odd[d] |= word in text[bounds[d] : bounds[d + 1]]
            if not odd.any():
                yield first, last, *self._fast(text, bounds)
                continue
            parts = [self._slow(text[bounds[d] : bounds[d + 1]]) if odd[d] else None for d in range(last - first)]
            plain = [d for d in range(last - first) if not odd[d]]
            if plain:
                joined = [text[bounds[d] : bounds[d + 1]] for d in plain]
                ids, at = self._fast("".join(joined), np.concatenate([[0], np.cumsum([len(x) for x in joined])]))
                for k, d in enumerate(plain):
                    parts[d] = ids[at[k] : at[k + 1]]
            yield first, last, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and path."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
