"""Words, their hashes and their windows for whole Arrow batches of texts, by numpy; and compact columns of integers.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r, as in ``bytes.split()``. Hashes have
64 bits. Texts are taken in pieces of about ``PIECE`` bytes (a longer text is a piece of its own), so that the
arrays stay small whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z become a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SEED = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words of more bytes are hashed one at a time.
LONG_WORD = 128
#: The bytes that count of eight, by how many of a word are left.
LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer texts are read in parts of about this many bytes.
PART = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


@dataclass
class Piece:
    """Texts laid end to end: text i is buf[off[i]:off[i + 1]]; rows says which rows of the batch they are."""

    buf: np.ndarray
    off: np.ndarray
    rows: slice


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[Piece]:
    buf, off = flat(texts)
    begin, n = 0, len(off) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(off, off[begin] + size, "right")) - 1)
        end = min(end, n)
        yield Piece(buf[off[begin] : off[end]], off[begin : end + 1] - off[begin], slice(begin, end))
        begin = end


@dataclass
class Words:
    """Word j is buf[start[j]:end[j]]; text i has the words first[i]:first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(piece: Piece, inside: np.ndarray | None = None) -> Words:
    """inside: for each byte of the piece, whether it belongs to a word; by default all but white space."""
    if inside is None:
        inside = ~SPACE[piece.buf]
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(piece.off), np.int64))
    cut = np.zeros(n + 1, bool)
    cut[piece.off] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:n]
    ends[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, piece.off))


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def word_hashes(buf: np.ndarray, w: Words) -> np.ndarray:
    """Eight bytes after eight are mixed into the hash, which starts from the word's size; long words by xxh3."""
    size = w.end - w.start
    h = mix(size.astype(np.uint64) * STEP + SEED)
    eights = _eights(buf)
    short = size <= LONG_WORD
    which = np.flatnonzero(short & (size > 0))
    for done in range(0, LONG_WORD, 8):
        if not len(which):
            break
        here = eights[w.start[which] + done] & LEFT[np.minimum(size[which] - done, 8)]
        h[which] = mix((h[which] ^ here) * M1 + STEP)
        which = which[size[which] > done + 8]
    for k in np.flatnonzero(~short).tolist():
        h[k] = xxhash.xxh3_64_intdigest(buf[w.start[k] : w.end[k]].tobytes(), seed=int(SEED))
    return h


def same(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each word of ``buf`` has the bytes of the word of ``other``."""
    size = end - start
    equal = size == other_end - other_start
    one, two = _eights(buf), _eights(other)
    which = np.flatnonzero(equal & (size > 0) & (size <= LONG_WORD))
    for done in range(0, LONG_WORD, 8):
        if not len(which):
            break
        differ = ((one[start[which] + done] ^ two[other_start[which] + done]) & LEFT[np.minimum(size[which] - done, 8)]) != 0
        equal[which[differ]] = False
        which = which[~differ & (size[which] > done + 8)]
    for k in np.flatnonzero(equal & (size > LONG_WORD)).tolist():
        equal[k] = bool(np.array_equal(buf[start[k] : end[k]], other[other_start[k] : other_end[k]]))
    return equal


def parts(piece: Piece, overlap: int) -> Iterator[Piece]:
    """A text longer than ``PART`` in parts that begin ``overlap`` words before the last one's end; other pieces whole."""
    n = len(piece.buf)
    if len(piece.off) != 2 or n <= PART:
        yield piece
        return
    begin, size = 0, PART
    while begin < n:
        end = begin + size
        while end < n and not SPACE[piece.buf[end]]:
            ahead = np.flatnonzero(SPACE[piece.buf[end : end + PART]])
            end += int(ahead[0]) if len(ahead) else PART
        end = min(end, n)
        part = Piece(piece.buf[begin:end], np.array([0, end - begin]), piece.rows)
        starts = words(part).start
        if end < n and len(starts) <= overlap:  # a few huge words
            size *= 2
            continue
        yield part
        if end == n:
            return
        begin, size = begin + int(starts[-overlap]) if overlap else end, PART


def windows(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the first word, text, hash) of each run of ``size`` words in one text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = h[:n].copy()
    for k in range(1, size):
        g *= STEP
        g += h[k : n + k]
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    return at, text[at], mix(g[at])


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Integers as compressed byte planes; of their differences if they rise."""
    kind = values.dtype.itemsize
    if rising and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, kind).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, dtype: type, rising: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    kind = np.dtype(dtype).itemsize
    values = np.ascontiguousarray(raw.reshape(kind, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)
    return np.cumsum(values, dtype=dtype) if rising else values


def packed_ids(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Any 64-bit integers as their distinct values, rising, and the place of each among them."""
    known, at = np.unique(ids, return_inverse=True)
    return packed(known, rising=True), packed(at.astype(np.uint16 if len(known) < 1 << 16 else np.uint32))


def unpacked_ids(known: bytes, at: bytes, n: int) -> np.ndarray:
    values = unpacked(known, np.int64, rising=True)
    return values[unpacked(at, np.uint16 if len(values) < 1 << 16 else np.uint32)]
