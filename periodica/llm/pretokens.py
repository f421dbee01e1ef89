"""Pre-tokens of byte-level BPE found with array operations, and their ids from the tokenizer library.

The split is the public pattern of these vocabularies: contractions, letters, digits and other marks, each
with one blank before it, and runs of white space short of the last.
"""

from __future__ import annotations

import os
import unicodedata
from itertools import chain

import numpy as np

from .texts import Rolling

SPECIAL = "<|endoftext|>"
_SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_KINDS = {"L": _LETTER, "N": _NUMBER}
_CACHE: dict = {}


def _classes(points: np.ndarray) -> np.ndarray:
    """Kind of each code point; the table fills up as code points turn up."""
    table = _CACHE.setdefault("classes", np.zeros(0x110000, np.uint8))
    kinds = table[points]
    if not kinds.all():
        for c in np.unique(points[kinds == 0]).tolist():
            table[c] = _SPACE if c in _SPACES else _KINDS.get(unicodedata.category(chr(c))[0], _OTHER)
        kinds = table[points]
    return kinds


class Pretokens:
    """Pre-tokens of a run of texts: where each starts and ends (code points), its hash, its text's first."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.text = data.tobytes().decode("utf-8", "surrogatepass")
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.offsets = heads[offsets]
        kind = _classes(points)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        start = edge[:-1].copy()
        if n:
            start[1:] |= kind[1:] != kind[:-1]
        # a word, number or mark run takes one blank before it; other white space only splits off
        runs = np.flatnonzero(start & (kind != _SPACE))
        runs = runs[runs > 0]
        runs = runs[~edge[runs] & (kind[runs - 1] == _SPACE)]
        start[runs - 1] = True
        blank = runs[points[runs - 1] == 32]
        start[blank] = False
        self._contractions(points, kind, edge, start)
        self.starts = np.flatnonzero(start)
        self.ends = np.append(self.starts[1:], n) if n else self.starts
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = Rolling(points).of(self.starts, self.ends)

    @staticmethod
    def _contractions(points, kind, edge, start) -> None:
        n = len(points)
        marks = np.flatnonzero((points == 39) & start)
        one, two = (np.append(points, [0, 0, 0])[marks + k] for k in (1, 2))
        ends = np.append(edge, [True, True])
        within1, within2 = ~ends[marks + 1], ~ends[marks + 1] & ~ends[marks + 2]
        short = within1 & np.isin(one, [ord(c) for c in "stmd"])
        r, v, el, e = (ord(c) for c in "rvle")
        long = within2 & (((one == r) | (one == v)) & (two == e) | (one == el) & (two == el))
        for found, length in ((marks[short], 2), (marks[long & ~short], 3)):
            for k in range(1, length):
                start[found + k] = False
            after = found + length
            start[after[after < n]] = True

    def string(self, i: int) -> str:
        return self.text[self.starts[i]: self.ends[i]]


def tokenizer(path: str):
    """The library's tokenizer, loaded once per worker process."""
    if path not in _CACHE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _CACHE[path] = Tokenizer.from_file(path)
    return _CACHE[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class IdCache:
    """Ids of pre-tokens by hash: a large sorted table and a small fresh one that joins it now and then.

    Starts anew beyond ``limit`` entries, so a worker's memory stays bounded.
    """

    def __init__(self, path: str, limit: int = 1_500_000):
        self.path, self.limit = path, limit
        self._clear()

    def _clear(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.main, self.fresh, self.ids = none, none, np.zeros(1 << 16, np.uint32)
        self.used = 0

    @staticmethod
    def _find(table, hashes):
        keys = table[0]
        if not len(keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return at, keys[at] == hashes

    def _learn(self, hashes: np.ndarray, strings: list[str]) -> None:
        got = [e.ids for e in tokenizer(self.path).encode_batch(strings, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        total = int(lengths.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used: self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += total
        new = [np.concatenate(x) for x in zip(self.fresh, (hashes, starts, lengths), strict=True)]
        if len(new[0]) > max(20_000, len(self.main[0]) // 4):
            new = [np.concatenate(x) for x in zip(self.main, new, strict=True)]
            order = np.argsort(new[0], kind="stable")
            self.main = tuple(x[order] for x in new)
            self.fresh = tuple(x[:0] for x in new)
        else:
            order = np.argsort(new[0], kind="stable")
            self.fresh = tuple(x[order] for x in new)

    def encode(self, p: Pretokens) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the run end to end, and how many each pre-token has."""
        hashes, index, inverse = np.unique(p.hashes, return_index=True, return_inverse=True)
        if len(self.main[0]) + len(hashes) > self.limit:
            self._clear()
        known = self._find(self.main, hashes)[1] | self._find(self.fresh, hashes)[1]
        if not known.all():
            self._learn(hashes[~known], [p.string(i) for i in index[~known]])
        at, ok = self._find(self.main, hashes)
        at2, ok2 = self._find(self.fresh, hashes)
        starts, lengths = (np.zeros(len(hashes), np.int64) for _ in range(2))
        for table, where, hit in ((self.main, at, ok), (self.fresh, at2, ok2)):
            starts[hit], lengths[hit] = table[1][where[hit]], table[2][where[hit]]
        starts, lengths = starts[inverse], lengths[inverse]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)], lengths


def id_cache(path: str) -> IdCache:
    """One cache per worker process and vocabulary."""
    key = ("ids", path)
    if key not in _CACHE:
        _CACHE[key] = IdCache(path)
    return _CACHE[key]
