"""Documents with the awkward cases, and plain versions of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, ids string, key string, row string, spans string, block string"


def made(seed: int = 3, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Texts with shared passages, near and exact copies, repeated rows, a null id, null, empty and very long texts."""
    luck = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "ab cd éf gh ij".split() for b in "kl mn op qr st uv wx".split()] + ["X.", "y,", "<|endoftext|>", "中文", "it's"]

    def prose(k: int) -> str:
        return "".join(luck.choice(vocabulary) + luck.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(k))

    passage, line = prose(40), "the same line again and again for ever and ever and ever more"
    rows: list[tuple[int | None, str | None]] = []
    for k in range(n):
        text = prose(luck.choice([0, 1, 2, 3, 12, 13, 14, 60, 200]))
        if k % 4 == 0:
            text += passage
        if k % 7 == 0:
            text += f"\n{line}\n{line}\n{line}"
        if k % 5 == 4:
            words = (rows[luck.randrange(len(rows))][1] or "").split(" ")
            for _ in range(luck.randrange(4)):
                words[luck.randrange(len(words))] = luck.choice(vocabulary)
            text = " ".join(words)
        rows.append((k * 3, text))
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "word"), (504, "WORD"), (505, "word")]
    rows += [(506, passage * 300), (507, "a" * 20_000), (508, "z " * 5_000), (509, "😀 ́x 𝒳 ½ ² y")]
    rows += [rows[0], rows[0], (None, passage), (None, None), (-7, passage)]
    return rows


def frame(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "en", "src0", len(t or ""), "s", "i", "k", "r", "p", "b") for d, t in rows], SCHEMA).repartition(3)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


LAST = 2**63 - 1


def removed(rows, window: int = 13):
    """(id, words, marks) of each row by the rule of substring dedup."""
    owner: dict[tuple, int] = {}
    keyed = [(LAST if d is None else d, words(t)) for d, t in rows]
    for d, w in keyed:
        for i in range(len(w) - window + 1):
            owner[tuple(w[i : i + window])] = min(d, owner.get(tuple(w[i : i + window]), d))
    out = []
    for d, w in keyed:
        mark = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if owner[tuple(w[i : i + window])] < d:
                mark[i : i + window] = b"\1" * window
        out.append((d, w, mark))
    return out


def shingle_set(text: str | None, size: int = 3) -> frozenset:
    w = [lower(x) for x in words(text)]
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def linked(rows, percent: int = 90, size: int = 3):
    """{id: (set size, component)} by comparing all pairs that share a shingle."""
    sets = {LAST if d is None else d: shingle_set(t, size) for d, t in rows if d is not None or t}
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for e, n in Counter(e for g in s for e in holders[g] if e > d).items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def thue_morse(a: str, b: str, doublings: int = 11) -> tuple[str, str]:
    """Two different words with the same polynomial hash modulo 2 ** 64, whatever its odd base."""
    one, two = a, b
    for _ in range(doublings):
        one, two = one + two, two + one
    return one, two


def auc(labels, scores) -> float:
    ones = [s for y, s in zip(labels, scores, strict=True) if y]
    zeros = [s for y, s in zip(labels, scores, strict=True) if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
