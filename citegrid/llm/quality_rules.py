"""Quality rules as a short-circuit cascade.

Counts of each text are plain column expressions. Every rule is a condition that rejects a text. On a bounded
sample, chosen by a hash of the rows, the cascade estimates each rule's cost (the characters it reads of a text,
and one for the comparison) and selectivity (share rejected), and orders the rules by rejection per cost: the best rule
comes first, the next is the best on the texts that it lets pass, and so on. One nested CASE then stops at the
first rule that rejects. The sample is read by one job, which returns one row for each combination of verdicts; the
same table gives the same order in every run. The order changes the time, never the verdict, since a text is kept
only if no rule rejects it.

Defined results: a null text has no words; a text without words has all counts 0, base_failed true and kept
false; repeated rows are judged alike; very long texts are judged whole; equal rejections per cost keep the order of
``rules``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Rows of the sample from which cost and selectivity are estimated, on average.
SAMPLE_ROWS = 500
#: Numbers of a hash, of which the sample takes a share.
HASHES = 1 << 30


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column
    #: The characters that the rule reads of a text.
    reads: Column


def _share(found: Column, of: Column, percent: int) -> Column:
    return found * 100 > of * percent


def rules() -> list[Rule]:
    """The rules over the columns text_, n_words, word_chars, n_symbols, n_lines and n_dup_lines."""
    n, text, lines, chars = F.col("n_words"), F.col("text_"), F.col("lines_"), F.col("word_chars")
    none, whole = F.lit(0), F.length("text_")
    return [
        Rule("symbols", _share(F.col("n_symbols"), n, 30), none),
        Rule("duplicate_lines", _share(F.col("n_dup_lines"), F.col("n_lines"), 30), none),
        Rule("word_length", (chars < n * 2) | (chars > n * 20), none),
        Rule("shouting", _share(F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")), chars, 50), whole),
        Rule("exclamations", _share(F.length(F.regexp_replace(text, "[^!]+", "")), n, 50), whole),
        Rule("letters", ~_share(F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), chars, 60), whole),
        # Of a line's start, about a character.
        Rule("bullets", _share(F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))), F.col("n_lines"), 90), F.col("n_lines")),
        Rule("ellipsis", _share(F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09]*$"))), F.col("n_lines"), 30), whole),
    ]


def measured(df: DataFrame, doc: str, text: str) -> DataFrame:
    """The counts of each text, with the text and its lines that hold a word."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(doc), whole.alias("text_"))
    rows = rows.select(
        doc,
        "text_",
        F.array_remove(F.split("text_", SPACE), "").alias("words_"),
        F.filter(F.split("text_", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines_"),
    )
    n = F.size("words_")
    grams = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("words_", i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        doc,
        "text_",
        "lines_",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words_", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text_", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines_").cast("long").alias("n_lines"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        grams.alias("grams_"),
    )
    # Only texts with a window that repeats go on to look for the places.
    repeats = F.size(F.array_distinct("grams_")) < F.size("grams_")
    rows = rows.withColumn("order_", F.when(repeats, F.array_sort(F.transform("grams_", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    twice = F.filter(
        F.transform(
            F.col("order_"),
            lambda e, k: F.when(
                (F.get(F.col("order_"), k - 1)["g"].eqNullSafe(e["g"]) & (k > 0)) | F.get(F.col("order_"), k + 1)["g"].eqNullSafe(e["g"]), e["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    rows = rows.withColumn("at_", F.when(F.col("order_").isNotNull(), F.sort_array(twice)))
    covered = F.aggregate(
        F.col("at_"),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(i - s["last"], F.lit(WINDOW))).alias("n")),
        lambda s: s["n"],
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("order_", "at_", "grams_")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def sampled(df: DataFrame, doc: str, text: str, rows: int) -> DataFrame:
    """About ``rows`` rows, by a hash of id and text."""
    total = max(1, df.count())
    return df if total <= rows else df.where(F.pmod(F.xxhash64(doc, text), F.lit(HASHES)) < F.lit(HASHES * rows // total))


#: (which rules reject, texts of that kind, characters that each rule reads of them)
Kind = tuple[tuple[bool, ...], int, tuple[int, ...]]


def estimate(sample: DataFrame, chain: list[Rule]) -> list[Kind]:
    """The texts of ``sample``, which the caller has persisted, by the verdicts of all rules, so at most 2 ** len(chain) rows; those that fail the base rules never meet a rule."""
    verdicts = F.array(*[F.coalesce(r.rejects, F.lit(False)) for r in chain])
    costs = [F.sum(r.reads + 1).alias(f"cost_{k}") for k, r in enumerate(chain)]
    kinds = sample.where(~base_failed()).groupBy(verdicts.alias("verdicts")).agg(F.count("*").alias("n"), *costs).collect()
    return [(tuple(r.verdicts), r.n, tuple(r[f"cost_{k}"] for k in range(len(chain)))) for r in kinds]


def ordered(kinds: list[Kind], chain: list[Rule]) -> list[Rule]:
    """Step by step the rule with the most rejections per cost on the texts that all rules before let pass."""
    left, found = list(range(len(chain))), []
    while left:
        rejected, cost = Counter(), Counter()
        for verdicts, n, costs in kinds:
            for k in left:
                rejected[k] += n * verdicts[k]
                cost[k] += costs[k]
        best = min(left, key=lambda k: (-rejected[k] / max(1, cost[k]), cost[k], k))
        left.remove(best)
        found.append(chain[best])
        kinds = [kind for kind in kinds if not kind[0][best]]
    return found


def cascade(chain: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null; a later rule is computed only if the earlier ones let the text pass."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(chain):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    return verdict


def judge(df: DataFrame, doc: str, text: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each text: its counts, base_failed and kept."""
    chain = rules()
    sample = measured(sampled(df.select(doc, text), doc, text, sample_rows), doc, text).persist()
    try:
        chain = ordered(estimate(sample, chain), chain)
    finally:
        sample.unpersist()
    rows = measured(df, doc, text).withColumn("base_failed", base_failed())
    rows = rows.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(chain)))
    return rows.select(
        doc, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept")
    )
