"""Quality classifier as a sparse ensemble of rules.

Statistics of a text are column expressions. On a sample of at most ``SAMPLE`` labelled rows, of which the driver
holds the statistics alone, short trees are boosted; every path from a root to a node is a conjunctive rule. A
logistic model with a lasso penalty weighs the rules and drops most. What is left compiles into one Spark column
expression, so that all documents are scored whole by DataFrame functions, without a shuffle.

Defined results: a null or empty text has all statistics 0 and the score of such a text; labels that are null, or of
a null or unknown id, are left out, and of several for an id the largest counts; without both kinds of labels every
score is the share of label 1, or 0.5; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 8000
TREES = 30
DEPTH = 3
LEAST_ROWS = 10
CUTS = 32
PENALTY = 1e-3
THRESHOLD = 0.5
SPACE = r"[\x20\x09-\x0D]+"

STATISTICS = ("words", "word_length", "symbols", "shouts", "capitals", "distinct", "lines", "repeated_lines", "short_words", "stops", "digits")


def statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and one double for each of ``STATISTICS``."""
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text_"))
    rows = rows.select(
        *keep,
        "text_",
        F.array_remove(F.split("text_", SPACE), "").alias("words_"),
        F.filter(F.split("text_", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines_"),
    )
    n, lines = F.size("words_"), F.size("lines_")

    def share(found: Column, of: Column) -> Column:
        return found / F.greatest(of, F.lit(1)).cast("double")

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace("text_", f"[^{pattern}]+", ""))

    chars = F.length(F.array_join("words_", ""))
    found = (
        F.log1p(n.cast("double")),
        share(chars, n),
        share(count(r"#*$%&|<>"), n),
        share(count("!"), n),
        share(count(r"\p{Lu}"), chars),
        share(F.size(F.array_distinct("words_")), n),
        share(lines, n),
        share(lines - F.size(F.array_distinct("lines_")), lines),
        share(F.size(F.filter("words_", lambda w: F.length(w) <= 3)), n),
        share(count(r".,;:"), n),
        share(count(r"0-9"), chars),
    )
    return rows.select(*keep, *[c.alias(name) for name, c in zip(STATISTICS, found, strict=True)])


#: (statistic, whether above the cut, cut): all must hold.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[Rule, float]]


def _split(x: np.ndarray, pull: np.ndarray, rows: np.ndarray, features: np.ndarray) -> tuple[float, int, float] | None:
    """(gain, statistic, cut) of the best cut of the rows."""
    best = None
    total, n = pull[rows].sum(), len(rows)
    for f in features:
        values = x[rows, f]
        cuts = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 1)[1:-1]))
        order = np.argsort(values)
        sums = np.concatenate([[0.0], np.cumsum(pull[rows][order])])
        left = np.searchsorted(values[order], cuts, "right")
        ok = (left >= LEAST_ROWS) & (n - left >= LEAST_ROWS)
        if not ok.any():
            continue
        left, cuts = left[ok], cuts[ok]
        gain = sums[left] ** 2 / left + (total - sums[left]) ** 2 / (n - left) - total**2 / n
        k = int(np.argmax(gain))
        if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), int(f), float(cuts[k]))
    return best


def grow(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """The paths of boosted trees, each once."""
    luck = np.random.default_rng(seed)
    z = np.zeros(len(y))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        pull = y - 1 / (1 + np.exp(-z))
        features = luck.permutation(x.shape[1])[: max(2, x.shape[1] * 2 // 3)]
        open_: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(y)))]
        while open_:
            path, rows = open_.pop()
            cut = _split(x, pull, rows, features) if len(path) < DEPTH else None
            if cut is None:
                z[rows] += 2.0 * pull[rows].mean()
                continue
            _, f, at = cut
            above = x[rows, f] > at
            for side, part in ((False, rows[~above]), (True, rows[above])):
                longer = (*path, (f, side, at))
                found[tuple(sorted(longer))] = None
                open_.append((longer, part))
    return list(found)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, at in rule:
        out &= (x[:, f] > at) == above
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 400) -> tuple[float, np.ndarray]:
    """(bias, weights) of a logistic model by accelerated proximal gradient steps."""
    n, k = r.shape
    step = 4.0 / max(1.0, np.linalg.norm(np.column_stack([r, np.ones(n)]), 2) ** 2 / n)
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    last_w, last_b, t = w, b, 1.0
    for _ in range(rounds):
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = (t - 1) / nxt
        vw, vb, t = w + ahead * (w - last_w), b + ahead * (b - last_b), nxt
        pull = (1 / (1 + np.exp(-np.clip(r @ vw + vb, -40, 40))) - y) / n
        last_w, last_b = w, b
        moved = vw - step * (r.T @ pull)
        w = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        b = vb - step * float(pull.sum())
    return b, w


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    if not len(y) or y.min() == y.max():
        return Ensemble(0.0 if not len(y) else (20.0 if y.min() else -20.0), [])
    rules = grow(x, y)
    if not rules:
        return Ensemble(float(np.log(y.mean() / (1 - y.mean()))), [])
    b, w = lasso(np.column_stack([holds(rule, x) for rule in rules]).astype(float), y)
    return Ensemble(b, [(rule, float(v)) for rule, v in zip(rules, w, strict=True) if abs(v) > 1e-4])


def compiled(model: Ensemble) -> Column:
    """The score as an expression over the statistics' columns."""
    z = F.lit(model.bias)
    for rule, weight in model.rules:
        condition = F.lit(True)
        for f, above, at in rule:
            column = F.col(STATISTICS[f])
            condition = condition & ((column > at) if above else (column <= at))
        z = z + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def held_out(doc: str) -> Column:
    return (F.crc32(F.col(doc).cast("string").cast("binary")) % 3 == 1) & F.col(doc).isNotNull()


def train(docs: DataFrame, doc: str, text: str, labels: DataFrame, label: str, most: int = SAMPLE) -> Ensemble:
    """Learns from at most ``most`` labelled rows, chosen by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull() & ~held_out(doc))
    known = known.groupBy(F.col(doc).alias("id_")).agg(F.max(label).cast("int").alias("y_"))
    chosen = known.orderBy(F.xxhash64("id_"), "id_").limit(most)
    rows = docs.select(F.col(doc).alias("id_"), F.col(text).alias("t_")).join(F.broadcast(chosen), "id_")
    rows = rows.groupBy("id_", "y_").agg(F.min("t_").alias("t_"))  # of several texts for an id the smallest
    found = statistics(rows, "t_", ["id_", "y_"]).orderBy("id_").toPandas()
    return fit(found[list(STATISTICS)].to_numpy(float), found["y_"].to_numpy(float))


def report(docs: DataFrame, doc: str, text: str, labels: DataFrame, label: str) -> DataFrame:
    """(doc, held_out, score, predicted) for each row."""
    model = train(docs, doc, text, labels, label)
    scored = statistics(docs.select(doc, text), text, [doc]).select(doc, compiled(model).alias("score"))
    return scored.select(doc, held_out(doc).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
