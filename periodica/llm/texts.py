"""Text columns as numpy arrays inside Arrow tasks: chunks, words, shingles and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shipping import ship

CHUNK = 1 << 20
#: Two primes below 2 ** 31, and a base for each drawn from a fixed seed.
_PRIMES = (2_147_483_647, 2_147_483_629)
_BASES = tuple(int(b) for b in np.random.default_rng(20_240_611).integers(1 << 29, 1 << 30, 2))
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** i modulo the prime for i below n, kept and doubled as needed."""
    known = _POWERS.get((base, prime), np.ones(1, np.uint64))
    while len(known) < n:
        step = np.uint64(pow(base, len(known), prime))
        known = np.concatenate([known, known * step % np.uint64(prime)])
    _POWERS[base, prime] = known
    return known[:n]


class Rolling:
    """Hashes of any slices of one sequence of numbers: two polynomials modulo primes, 62 bits mixed.

    Modulo a power of two a polynomial would give equal hashes to words as plain as a Thue-Morse word of two letters
    and its complement, whatever the base; modulo primes equal hashes are a matter of chance.
    """

    def __init__(self, values: np.ndarray):
        self._sums = []
        for prime, base in zip(_PRIMES, _BASES, strict=True):
            v = values.astype(np.uint64)
            if values.dtype.itemsize > 4:
                v %= np.uint64(prime)
            v += np.uint64(1)
            v *= _powers(base, prime, len(values))
            v %= np.uint64(prime)
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(v, out=sums[1:])
            self._sums.append((sums, np.uint64(prime), _powers(pow(base, -1, prime), prime, len(values) + 1)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = ((sums[end] - sums[start]) % prime * down[start] % prime for sums, prime, down in self._sums)
        return mix(one << np.uint64(32) | two)


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first row, end row, UTF-8 bytes, their offsets.

    Null counts as empty. A longer text is a run of its own.
    """
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = min(n, max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1))
        yield start, end, data[offsets[start]: offsets[end]], offsets[start: end + 1] - offsets[start]
        start = end


def map_texts(
    docs: DataFrame, fn: Callable[[np.ndarray, np.ndarray], dict], fields: list[tuple[str, T.DataType]],
    text: str = "text", carry: list[str] | None = None,
) -> DataFrame:
    """Add columns worked out from whole texts.

    ``fn(bytes, offsets)`` gets a run of texts and gives one array per field. ``carry`` names the columns
    to keep (default: all); a kept column with the name of a new one gives way to it.
    """
    ship(docs.sparkSession)
    names = [f[0] for f in fields]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in names]
    source = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("string").alias("_text"))
    kinds = {c: docs.schema[c] for c in carry}
    schema = T.StructType([*[kinds[c] for c in carry], *[T.StructField(n, t) for n, t in fields]])
    n = len(carry)

    def work(batches):
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(n)):
                got = fn(data, offsets)
                kept = [batch.column(i).slice(a, b - a) for i in range(n)]
                new = [x if isinstance(x, pa.Array) else pa.array(x) for x in (got[c] for c in names)]
                yield pa.RecordBatch.from_arrays([*kept, *new], [*carry, *names])

    return source.mapInArrow(work, schema)


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One list per length, cut from the values in order."""
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Words:
    """Words (runs outside ``\\x20\\x09-\\x0D``) of a run of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data, self.offsets = data, offsets
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(data):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.inside = inside
        #: Position of each text's first word; one more entry for the end.
        self.first = np.searchsorted(self.starts, offsets)
        self.rolling = Rolling(data)
        self.hashes = self.rolling.of(self.starts, self.ends)

    def windows(self, size: int) -> np.ndarray:
        """Hash of the words from each word on; those that leave the text mean nothing."""
        n = len(self.hashes)
        out = np.zeros(n, np.uint64)
        for k in range(size):
            part = self.hashes[k:] * np.uint64((2 * k + 3) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)
            m = max(0, n - k)
            out[:m] = (out[:m] ^ part) * np.uint64(0xD6E8FEB86659FD93)
        return mix(out)

    def shingles(self, size: int) -> Iterator[np.ndarray]:
        """Sorted distinct hashes of each text's windows; one of all its words where it has fewer."""
        windows = self.windows(size)
        for a, b in zip(self.first[:-1], self.first[1:], strict=True):
            if b - a >= size:
                yield np.unique(windows[a: b - size + 1])
            elif b > a:
                parts = [self.hashes[a:b], [np.uint64(b - a)]]
                yield Rolling(np.concatenate(parts)).of(np.array([0]), np.array([b - a + 1]))
            else:
                yield np.zeros(0, np.uint64)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, given where its values begin."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]
