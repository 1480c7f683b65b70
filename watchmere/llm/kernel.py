"""Vectorised text kernels over Arrow buffers.

The operators of this subpackage that leave the JVM do so once per Arrow batch
(``mapInArrow``) and work on the UTF-8 bytes of many documents at a time: the
string column's data buffer is viewed as a ``uint8`` array, so no Python string
is made per word or per document.  Batches are cut into blocks of about
``BLOCK_BYTES`` at document boundaries, which bounds a worker's memory; a single
longer document is one block.

Hashes are 64-bit polynomial hashes (prefix sums modulo 2**64 of random byte
codes) with an avalanche finaliser; two independent ones (``salt`` 0 and 1) give
128 bits where equality of words must be certain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser (splitmix64) of a uint64 array."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n reproducible uint64 values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed) * _U(1_000_003)) * _U(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, min(max(2 * len(self.up), 4096), BLOCK_BYTES + 4096))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTE_POWERS = (_Powers(0x5851F42D4C957F2D | 1), _Powers(0x2545F4914F6CDD1D | 1))
_WORD_POWERS = (_Powers(0xD1342543DE82EF95 | 1), _Powers(0xAEF17502108EF2D9 | 1))
_BYTE_CODES = (stream(11, 256), stream(12, 256))


@dataclass
class Block:
    """Consecutive documents of a batch: their bytes and where each begins."""

    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray


def blocks(column, limit: int | None = None) -> Iterator[Block]:
    """Blocks of a string column; a null counts as an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    limit = limit or BLOCK_BYTES
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offs = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Block(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


@dataclass
class Words:
    """Words of a block: byte range of each, and the first word of each document."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        """Index of each word's document."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray | None = None) -> Words:
    """Maximal runs of word bytes (default: all but blank, TAB..CR) within each document."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offs), np.int64))
    w = ~_SEPARATOR[buf] if is_word is None else is_word[buf]
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = False
    edge[1:] = w
    edge[offs] = False
    start = np.flatnonzero(w & ~edge[:-1])
    edge[:-1] = w
    edge[-1] = False
    edge[offs] = False
    end = np.flatnonzero(w & ~edge[1:]) + 1
    return Words(start, end, np.searchsorted(start, offs))


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_hashes(buf: np.ndarray, words: Words, salt: int = 0, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word's bytes; lower: as if A-Z were lower-cased."""
    with np.errstate(over="ignore"):
        up, down = _BYTE_POWERS[salt].get(len(buf) + 1)
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        codes = _BYTE_CODES[salt][_LOWER] if lower else _BYTE_CODES[salt]
        np.cumsum(codes[buf] * up[: len(buf)], out=total[1:])
        h = (total[words.end] - total[words.start]) * down[words.start]
        return mix(h + (words.end - words.start).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


class Grams:
    """Hashes of word sequences in a block, from one prefix sum over word hashes."""

    def __init__(self, hashes: np.ndarray, salt: int = 0):
        with np.errstate(over="ignore"):
            up, self._down = _WORD_POWERS[salt].get(len(hashes) + 1)
            self._total = np.zeros(len(hashes) + 1, dtype=np.uint64)
            np.cumsum(hashes * up[: len(hashes)], out=self._total[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words start..end-1, also of the count."""
        with np.errstate(over="ignore"):
            h = (self._total[end] - self._total[start]) * self._down[start]
            return mix(h + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def gram_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes at which a k-word sequence fits into its document; where each document's begin."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
    return at, begin


def code_points(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block and the documents' offsets in them."""
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    return points, lead[offs]


def char_offsets(buf: np.ndarray) -> np.ndarray:
    """Number of code points before each byte position, one more than there are bytes."""
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    return lead


def crc_bucket(doc_id, parts: int):
    """Column: crc32 of doc_id as text, modulo parts (null ids count as empty text)."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts
