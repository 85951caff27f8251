"""Byte-level BPE over whole batches: the places where a text is cut before merging, and a memory of pieces already encoded.

The cuts are those of the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, found by numpy from the class of
each character. A special token's string is a piece of its own, and the text before and after it are cut alone.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np

from citegrid.llm import vectors

LETTER, NUMBER, BLANK = 1, 2, 3
# The characters with the White_Space property.
BLANKS = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters and numbers (first, last, class) of Unicode 16, which unicodedata doesn't know yet.
NEWER = [
    (0x1C89, 0x1C8A, LETTER), (0xA7CB, 0xA7CD, LETTER), (0xA7DA, 0xA7DC, LETTER), (0x105C0, 0x105F3, LETTER),
    (0x10D40, 0x10D49, NUMBER), (0x10D4A, 0x10D65, LETTER), (0x10D6F, 0x10D85, LETTER), (0x10EC2, 0x10EC4, LETTER),
    (0x11380, 0x11389, LETTER), (0x1138B, 0x1138B, LETTER), (0x1138E, 0x1138E, LETTER), (0x11390, 0x113B5, LETTER),
    (0x113B7, 0x113B7, LETTER), (0x113D1, 0x113D1, LETTER), (0x113D3, 0x113D3, LETTER), (0x116D0, 0x116E3, NUMBER),
    (0x11BC0, 0x11BE0, LETTER), (0x11BF0, 0x11BF9, NUMBER), (0x13460, 0x143FA, LETTER), (0x16100, 0x1611D, LETTER),
    (0x16130, 0x16139, NUMBER), (0x16D40, 0x16D6C, LETTER), (0x16D70, 0x16D79, NUMBER), (0x18CFF, 0x18CFF, LETTER),
    (0x1CCF0, 0x1CCF9, NUMBER), (0x1E5D0, 0x1E5ED, LETTER), (0x1E5F0, 0x1E5F0, LETTER), (0x1E5F1, 0x1E5FA, NUMBER),
]
#: Pieces that a worker remembers; then it starts anew.
REMEMBERED = 1_500_000


@cache
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[BLANKS] = BLANK
    for first, last, kind in NEWER:
        table[first : last + 1] = kind
    return table


def cuts(piece: vectors.Piece, special: bytes = b"") -> vectors.Words:
    """The pieces to encode, as ``Words`` that tile the texts."""
    buf, off = piece.buf, piece.off
    n_bytes = len(buf)
    if not n_bytes:
        none = np.zeros(0, np.int64)
        return vectors.Words(none, none, np.zeros(len(off), np.int64))
    raw = buf.tobytes()
    at = np.flatnonzero((buf & 0xC0) != 0x80)  # the first byte of each character
    cp = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[cp]
    n = len(cp)
    edge = np.zeros(n + 1, bool)  # a text, or a part of it around a special token, begins
    edge[np.searchsorted(at, off)] = True
    held = []
    if special and (k := raw.find(special)) >= 0:
        while k >= 0:
            end = k + len(special)
            if np.searchsorted(off, k, "right") == np.searchsorted(off, end - 1, "right"):
                held.append(np.searchsorted(at, [k, end]))
                edge[held[-1]] = True
                k = raw.find(special, end)
            else:
                k = raw.find(special, k + 1)
    edge = edge[:n]
    start = edge.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last white space of a run goes on alone, or with what follows if it is a plain space.
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~edge[1:]
    start |= last
    joined = np.flatnonzero(last & (cp == 32)) + 1
    start[joined] = False
    # An apostrophe that begins a piece takes the letters of a contraction.
    quote = np.flatnonzero(start[:-1] & (cp[:-1] == 39) & (kind[1:] == LETTER) & ~edge[1:])
    if len(quote):
        padded = np.append(cp, [0, 0])
        one, two = padded[quote + 1], padded[quote + 2]
        same = np.append(~edge, [False, False])[quote + 2]
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        pair = same & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        size = np.where(pair, 2, size)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + 1 + size
        after = after[after < n]
        start[after[(kind[after] == LETTER)]] = True
    for a, b in held:
        start[a + 1 : b] = False
    begin = at[np.flatnonzero(start)]
    return vectors.Words(begin, np.append(begin[1:], n_bytes), np.searchsorted(begin, off))


class Memory:
    """Ids of pieces; ``encode`` turns new pieces into ids. Pieces are found by a hash and compared by their bytes; one whose hash is another's is encoded each time."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], limit: int = REMEMBERED) -> None:
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.off, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.begin, self.text = np.zeros(1, np.int64), np.zeros(0, np.uint8)

    def learn(self, hashes: np.ndarray, found: list[bytes]) -> None:
        where = np.searchsorted(self.known, hashes)
        slots = len(self.off) - 1 + np.arange(len(found))
        self.known, self.slot = np.insert(self.known, where, hashes), np.insert(self.slot, where, slots)
        self.off, self.ids = self._with(found)
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum([len(x) for x in found]))
        self.text = np.append(self.text, np.frombuffer(b"".join(found), np.uint8))

    def _with(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids known and, behind them, those of ``found``, with their offsets."""
        new = self.encode(found)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        ids = np.fromiter((x for ids in new for x in ids), np.uint32, int(sizes.sum()))
        return np.append(self.off, self.off[-1] + np.cumsum(sizes)), np.append(self.ids, ids)

    def _slots(self, buf: np.ndarray, w: vectors.Words) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each piece, whether the bytes there are the piece's)."""
        hashes, sample, place = np.unique(vectors.word_hashes(buf, w), return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > self.limit:
            self.clear()
        new = np.flatnonzero(~np.isin(hashes, self.known, assume_unique=True))
        if len(new):
            at = sample[new]
            self.learn(hashes[new], [buf[a:b].tobytes() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
        slot = self.slot[np.searchsorted(self.known, hashes)]
        right = vectors.same(buf, w.start[sample], w.end[sample], self.text, self.begin[slot], self.begin[slot + 1])
        right = right[place] & vectors.same(buf, w.start, w.end, buf, w.start[sample][place], w.end[sample][place])
        return slot[place], right

    def __call__(self, piece: vectors.Piece, special: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of the piece, end to end; the offset of each text among them)."""
        if len(piece.off) == 2 and len(piece.buf) > vectors.PART:
            found = [self._ids(part, special)[0] for part in quiet_parts(piece, special)]
            ids = np.concatenate(found)
            return ids, np.array([0, len(ids)])
        return self._ids(piece, special)

    def _ids(self, piece: vectors.Piece, special: bytes) -> tuple[np.ndarray, np.ndarray]:
        w = cuts(piece, special)
        if not len(w.start):
            return np.zeros(0, np.uint32), np.zeros(len(piece.off), np.int64)
        slot, right = self._slots(piece.buf, w)
        all_off, all_ids = self.off, self.ids
        wrong = np.flatnonzero(~right)
        if len(wrong):
            raw = piece.buf.tobytes()
            all_off, all_ids = self._with([raw[a:b] for a, b in zip(w.start[wrong].tolist(), w.end[wrong].tolist(), strict=True)])
            slot[wrong] = len(self.off) - 1 + np.arange(len(wrong))
        begin = all_off[slot]
        sizes = all_off[slot + 1] - begin
        total = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        ids = all_ids[np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])]
        return ids, total[w.first]


def quiet_parts(piece: vectors.Piece, special: bytes) -> Iterator[vectors.Piece]:
    """A long text in parts that no token crosses: each begins with a space between two ASCII letters, outside a special token."""
    buf, n, begin = piece.buf, len(piece.buf), 0
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    while begin < n:
        end = begin + vectors.PART
        while end < n:
            near = buf[end - 1 : end + vectors.PART + 1]
            at = np.flatnonzero((near[1:-1] == 32) & letter[near[:-2]] & letter[near[2:]])
            if len(at):
                end += int(at[0])
                break
            end += vectors.PART
        end = min(end, n)
        yield vectors.Piece(buf[begin:end], np.array([0, end - begin]), piece.rows)
        begin = end
