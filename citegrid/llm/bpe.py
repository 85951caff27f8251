"""BPE encoding by longest matches and backtracking, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary's byte strings gives the longest token that starts at each byte of a
piece. The encoder takes it if it is compatible with the token before, else the next shorter one; where none fits
it steps back and bars that end. Two tokens are compatible if no merge across their border would have been made
before both were complete; a sequence whose neighbours are all compatible is the one that the merges give. Each
end is barred once at most, so the time is linear in the piece.

The automaton's matches, the prefix chain and the table of compatible pairs are made once for each Python worker.
Decoding gathers bytes from one string of all tokens by an offset table.

Defined results: a null text is empty and has no ids; the strings of special tokens give their ids, as the
tokenizers library does by default; decoding inverts encoding for every valid text; repeated rows are encoded alike; very
long texts are cut where no token can cross; an empty table gives no rows; other columns stay, and one called ids or
decoded, which the result would hold twice, is refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.llm import pretokens, vectors

#: Ids that are decoded at once, unless a text has more.
DECODED = 1 << 18


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """The tokens of a tokenizers file. Inside, tokens have numbers in the order in which merging makes them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        of = byte_names()
        ids, merges = file["model"]["vocab"], file["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        names = [*of, *["".join(m) for m in merges]]
        number = {name: k for k, name in reversed(list(enumerate(names)))}
        self.ids = [ids[name] for name in names]
        self.text = [bytes(of[c] for c in name) for name in names]
        self.size = [len(t) for t in self.text]
        self.single = len(of)
        self.special = {x["content"].encode(): x["id"] for x in file.get("added_tokens", []) if x.get("special")}
        self.left = [*range(self.single), *[number[a] for a, _ in merges]]
        self.right = [*range(self.single), *[number[b] for _, b in merges]]
        self.made: dict[tuple[int, int], int] = {}
        for k in range(self.single, len(names)):
            self.made.setdefault((self.left[k], self.right[k]), k)
        self.tree = ahocorasick.Automaton()
        by_text: dict[bytes, int] = {}
        for k, t in enumerate(self.text):
            if by_text.setdefault(t, k) == k:
                self.tree.add_word(t.decode("latin-1"), k)
        self.tree.make_automaton()
        #: The longest token that is a shorter prefix of each token, or -1.
        self.shorter = [next((by_text[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_text), -1) for t in self.text]
        self.pairs: dict[tuple[int, int], bool] = {}
        flat: list[bytes] = [b""] * (max([*self.ids, *self.special.values()]) + 1)
        for i, t in zip(self.ids, self.text, strict=True):
            flat[i] = t
        for t, i in self.special.items():
            flat[i] = t
        self.bytes = np.frombuffer(b"".join(flat), np.uint8)
        self.offsets = np.zeros(len(flat) + 1, np.int64)
        np.cumsum([len(t) for t in flat], out=self.offsets[1:])

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both leaves the two tokens a and b."""
        if (a, b) in self.pairs:
            return self.pairs[a, b]
        left, right, until = a, b, len(self.text)
        fits = None
        while fits is None:
            made = self.made.get((left, right), until)
            if made < until:
                fits = False
            elif left < self.single and right < self.single:
                fits = True
            elif left > right:  # look at the time before the later of the two was made
                until, left = left, self.right[left]
            else:
                until, right = right + 1, self.left[right]
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        self.pairs[a, b] = fits
        return fits

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.special:
            return [self.special[piece]]
        n = len(piece)
        size = self.size
        longest = [-1] * n
        for last, token in self.tree.iter(piece.decode("latin-1")):
            begin = last + 1 - size[token]
            if longest[begin] < 0 or size[token] > size[longest[begin]]:
                longest[begin] = token
        barred = bytearray(n + 1)
        taken: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            while token >= 0:
                end = pos + size[token]
                if not barred[end] and (not taken or self.compatible(taken[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                taken.append(token)
                pos = end
                token = longest[pos] if pos < n else -1
            else:
                barred[pos] = 1
                token = taken.pop()
                pos -= size[token]
        return [self.ids[t] for t in taken]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts end to end, offset of each text), for ids with the texts' offsets among them."""
        begin = self.offsets[ids]
        sizes = self.offsets[ids.astype(np.int64) + 1] - begin
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        return self.bytes[np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])], total[off]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def memory(path: str) -> pretokens.Memory:
    encode = vocabulary(path).encode
    return pretokens.Memory(lambda found: [encode(x) for x in found])


def _encode(path: str, text: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memory(path)
        special = next(iter(vocabulary(path).special), b"")
        for batch in batches:
            where = batch.schema.get_field_index(text)
            for piece in vectors.pieces(batch.column(where)):
                ids, off = known(piece, special)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
                part = batch.slice(piece.rows.start, piece.rows.stop - piece.rows.start)
                rest = [part.column(k) for k in range(part.num_columns) if k != where]
                names = [x for k, x in enumerate(part.schema.names) if k != where]
                yield pa.RecordBatch.from_arrays([*rest, lists], names=[*names, "ids"])

    return encode


def _decode(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            where = batch.schema.get_field_index("ids")
            ends, begin = batch.column(where).offsets.to_numpy(), 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + DECODED, "right")) - 1)
                part, begin = batch.slice(begin, end - begin), end
                lists = part.column(where)
                off = lists.offsets.to_numpy().astype(np.int64)
                ids = lists.values.to_numpy()[off[0] : off[-1]]
                data, at = known.decode(ids, off - off[0])
                raw = data.tobytes()
                texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
                rest = [part.column(k) for k in range(part.num_columns) if k != where]
                names = [x for k, x in enumerate(part.schema.names) if k != where]
                yield pa.RecordBatch.from_arrays([*rest, texts], names=[*names, "decoded"])

    return decode


def _fields(df: DataFrame, without: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name != without)


def encode(df: DataFrame, text: str, path: str) -> DataFrame:
    """``df`` with ``ids`` in place of ``text``."""
    if "ids" in df.columns and text != "ids":
        raise ValueError("there is a column ids already")
    return df.mapInArrow(_encode(path, text), _fields(df, text) + "ids array<int>")


def decode(df: DataFrame, path: str) -> DataFrame:
    """``df`` with ``decoded`` in place of ``ids``."""
    if "decoded" in df.columns:
        raise ValueError("there is a column decoded already")
    return df.mapInArrow(_decode(path), _fields(df, "ids") + "decoded string")


def report(df: DataFrame, doc: str, text: str, path: str) -> DataFrame:
    """(doc, n_tokens, ids_sha256, decoded_sha256) for each row."""
    coded = encode(df.select(doc, text), text, path)
    coded = coded.select(doc, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "ids")
    return decode(coded, path).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")
