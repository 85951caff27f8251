"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic of a bias and its words' weights; a document's
score is the noisy-or of its sentences', 1 - prod(1 - p). The weights are learned from labels of documents alone, on
a sample of at most ``SAMPLE`` labelled rows and ``SAMPLE_BYTES`` of text, which also bounds what the driver holds. The sentences with a score of
at least ``OFFENDING`` are located.

Words are runs of letters with A-Z lower-cased. A word has two features, itself and its first ``PREFIX`` bytes, by
hash into ``2 ** BITS`` weights. Only features whose presence in a document goes with its label, by a likelihood
ratio of ``MIN_RATIO``, get a weight. Sentences end at . ! ? or a line's end. All documents are scored whole, by numpy on Arrow batches, without a shuffle.

Defined results: a text without words, or null, has no sentence, so score 0; labels that are null, or of a null or
unknown id, are left out, and of several for an id the largest counts; without any label, or without both kinds,
every score is below 1e-12; repeated rows are scored alike; very long texts are
scored whole, a piece at a time in each batch; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.llm import vectors

SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
#: Longer texts are scored, but not learned from.
TEXT_BYTES = 4 << 20
PREFIX = 4
MIN_RATIO = 25.0
BITS = 20
OFFENDING = 0.5
THRESHOLD = 0.7
ROUNDS = 250

LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
ENDS = np.zeros(256, bool)
ENDS[[10, 33, 46, 63]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float


@dataclass
class Bags:
    """Word k has the features ``word[k]`` and ``prefix[k]``; sentence s has the words from begin[s] on and is of text ``text[s]``, bytes low[s] to high[s]."""

    word: np.ndarray
    prefix: np.ndarray
    begin: np.ndarray
    text: np.ndarray
    low: np.ndarray
    high: np.ndarray


def bags(piece: vectors.Piece) -> Bags:
    w = vectors.words(piece, LETTERS[piece.buf])
    low = vectors.LOWER[piece.buf]
    heads = vectors.Words(w.start, np.minimum(w.end, w.start + PREFIX), w.first)
    down = np.uint64(64 - BITS)
    word = (vectors.word_hashes(low, w) >> down).astype(np.int64)
    prefix = (vectors.mix(vectors.word_hashes(low, heads)) >> down).astype(np.int64)
    ends = np.zeros(len(piece.buf) + 1, np.int64)
    np.cumsum(ENDS[piece.buf], out=ends[1:])
    sentence, text = ends[w.start], w.text_of()
    new = np.ones(len(word), bool)
    new[1:] = (sentence[1:] != sentence[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(word)) - 1 if len(word) else begin
    return Bags(word, prefix, begin, text[begin], w.start[begin], w.end[last])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def telling(n: np.ndarray, k: np.ndarray, docs: int, ones: int) -> np.ndarray:
    """The features that label 1 goes with, by the likelihood ratio of presence in a document; n: documents that have each, k: those of label 1."""
    there = np.flatnonzero(n)
    n, k = n[there], k[there]

    def part(hits: np.ndarray | float, of: np.ndarray | float) -> np.ndarray:
        rate = np.clip(hits / np.maximum(of, 1), 1e-12, 1 - 1e-12)
        return hits * np.log(rate) + (of - hits) * np.log1p(-rate)

    ratio = 2 * (part(k, n) + part(ones - k, docs - n) - part(ones, docs))
    return there[(ratio >= MIN_RATIO) & (k * docs > n * ones)]


def _present(b: Bags, labels: np.ndarray, n: np.ndarray, k: np.ndarray) -> None:
    """Adds the piece's documents that have each feature to n, those of label 1 to k."""
    text = np.repeat(b.text, np.diff(np.append(b.begin, len(b.word))))
    pairs = np.unique(np.concatenate([text, text]) * (1 << BITS) + np.concatenate([b.word, b.prefix]))
    where, which = pairs >> BITS, pairs & ((1 << BITS) - 1)
    n += np.bincount(which, minlength=1 << BITS)
    k += np.bincount(which, labels[where], minlength=1 << BITS)


def learn(texts: pa.Array | list[str | None], labels: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Two passes over pieces of the texts: the first chooses the features, the second keeps those alone."""
    none = Model(np.zeros(1 << BITS, np.float32), -40.0)
    if not len(texts) or labels.min() == labels.max():
        return none
    whole = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    n_with, n_ones = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for piece in vectors.pieces(whole):
        _present(bags(piece), labels[piece.rows], n_with, n_ones)
    common = telling(n_with, n_ones, len(labels), int(labels.sum()))
    if not n_with.any():
        return none
    del n_with, n_ones
    number = np.full(1 << BITS, -1, np.int32)
    number[common] = np.arange(len(common))
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {"word": [], "prefix": []}
    texts_of, n_sentences, n = [], 0, len(labels)
    for piece in vectors.pieces(whole):
        b = bags(piece)
        sentence = np.repeat(np.arange(len(b.begin)), np.diff(np.append(b.begin, len(b.word)))) + n_sentences
        for kind, kept in found.items():
            features = number[getattr(b, kind)]
            keep = features >= 0
            kept.append((sentence[keep], features[keep]))
        texts_of.append(b.text + piece.rows.start)
        n_sentences += len(b.begin)
    of, word = (np.concatenate([x[k] for kept in found.values() for x in kept]) for k in (0, 1))
    text = np.concatenate(texts_of)
    y = labels.astype(bool)
    theta, bias = np.zeros(len(common)), np.log(0.1 / max(1.0, n_sentences / n))
    first, second, step = np.zeros(len(common) + 1), np.zeros(len(common) + 1), 0.1
    for k in range(1, rounds + 1):
        p = _logistic(bias + np.bincount(of, theta[word], minlength=n_sentences))
        bag = np.bincount(text, -np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n)
        pull = np.where(y, -np.exp(-bag) / np.maximum(1 - np.exp(-bag), 1e-6), 1.0) / n
        at = pull[text] * p
        grad = np.append(np.bincount(word, at[of], minlength=len(common)) + 2e-6 * theta, at.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = step * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        theta, bias = theta - move[:-1], bias - move[-1]
    weights = np.zeros(1 << BITS, np.float32)
    weights[common] = theta
    return Model(weights, float(bias))


def labelled_sample(docs: DataFrame, doc: str, text: str, labels: DataFrame, label: str, most: int = SAMPLE) -> tuple[pa.Array, np.ndarray]:
    """At most ``most`` labelled texts of at most ``SAMPLE_BYTES`` together, chosen by a hash of the id; of several texts for an id the smallest. A text
    of over ``TEXT_BYTES`` takes no part in the fit, so that no text leaves the others without room."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(F.col(doc).alias("id_")).agg(F.max(label).cast("int").alias("y_"))
    chosen = known.orderBy(F.xxhash64("id_"), "id_").limit(most)
    rows = docs.select(F.col(doc).alias("id_"), F.col(text).alias("text_")).join(F.broadcast(chosen), "id_")
    rows = rows.groupBy("id_").agg(F.min("text_").alias("text_"), F.min("y_").alias("y_"))
    rows = rows.where(F.coalesce(F.octet_length("text_"), F.lit(0)) <= TEXT_BYTES)
    so_far = F.sum(F.octet_length("text_")).over(Window.orderBy(F.xxhash64("id_"), "id_"))  # of at most ``most`` rows
    rows = rows.withColumn("so_far", so_far).where(F.coalesce("so_far", F.lit(0)) <= SAMPLE_BYTES)
    found = rows.select("id_", "text_", "y_").orderBy("id_").toArrow()
    return found["text_"].cast(pa.large_string()).combine_chunks(), found["y_"].to_numpy().astype(np.int64)


SCORED = "struct<score: double, offending: array<struct<begin: bigint, end: bigint, score: double>>>"


def _score(model: Model):
    def score(texts: pa.Array) -> pa.Array:
        scores, counts, spans = [], [], []
        for piece in vectors.pieces(texts):
            n = len(piece.off) - 1
            b = bags(piece)
            z = np.add.reduceat(model.weights[b.word].astype(np.float64) + model.weights[b.prefix], b.begin) if len(b.begin) else np.zeros(0)
            p = _logistic(model.bias + z)
            scores.append(0.0 - np.expm1(np.bincount(b.text, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n)))
            bad = np.flatnonzero(p >= OFFENDING)
            counts.append(np.bincount(b.text[bad], minlength=n))
            if len(bad):
                chars = np.zeros(len(piece.buf) + 1, np.int64)
                np.cumsum((piece.buf & 0xC0) != 0x80, out=chars[1:])
                base = chars[piece.off[:-1]][b.text[bad]]
                spans.append((chars[b.low[bad]] - base, chars[b.high[bad]] - base, p[bad]))
        off = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32) if counts else np.zeros(1, np.int32)
        kinds = (np.int64, np.int64, np.float64)
        columns = [pa.array(np.concatenate([np.zeros(0, kind), *(x[k] for x in spans)])) for k, kind in enumerate(kinds)]
        lists = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays(columns, names=["begin", "end", "score"]))
        return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0), *scores])), lists], names=["score", "offending"])

    return score


def scored(text: str, model: Model) -> Column:
    """(score, offending) of each text; offending has begin, end and score of each located sentence, in characters."""
    return F.arrow_udf(_score(model), SCORED)(F.col(text).cast("string"))


def held_out(doc: str) -> Column:
    return (F.crc32(F.col(doc).cast("string").cast("binary")) % 3 == 1) & F.col(doc).isNotNull()


def fit(docs: DataFrame, doc: str, text: str, labels: DataFrame, label: str) -> Model:
    return learn(*labelled_sample(docs, doc, text, labels.where(~held_out(doc)), label))


def report(docs: DataFrame, doc: str, text: str, labels: DataFrame, label: str) -> DataFrame:
    """(doc, held_out, score, predicted, offending) for each row."""
    found = docs.select(F.col(doc), scored(text, fit(docs, doc, text, labels, label)).alias("found"))
    predicted = (F.col("found.score") >= THRESHOLD).cast("int").alias("predicted")
    return found.select(doc, held_out(doc).alias("held_out"), "found.score", predicted, "found.offending")
