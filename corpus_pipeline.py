"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's ``docs``. All but the last return the columns of ``documents``.

- toxicity: a document whose score reaches the threshold goes.
- near_duplicates: of each component of documents linked by a Jaccard similarity of 80 % or more of their runs of five
  words, the one with the smallest id stays; texts without words are linked with nothing and stay. A row without an id
  goes if it is linked with one that has an id.
- repeated_passages: words covered by a passage of an earlier document go, the text's other words stay, joined by
  one space; texts without such words stay as they are.
- benchmark_leaks: a document that holds a benchmark item goes.
- tokens: (doc_id, lang, source, n_tokens, ids), with texts that decode to what went in.

Rows are judged one by one, by id and text: of rows with one id, one can go and another stay; repeated rows stay or go
together. An empty table gives no rows; columns that ``documents`` doesn't have are dropped.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.llm import bpe, decontamination, ngram_join, shared, substring_dedup, toxicity
from citegrid.llm.queries import TOKENIZER
from citegrid.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Of near_duplicates; the query op2_ngram_join has its own.
SHINGLE, PERCENT = 5, 80
#: SQL expresses neither the trained scores nor the tokenizer; tests/llm/test_pipeline.py has a plain version instead.
ORACLE_SQL = None


def _small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers a thousand at a time, unless the session says otherwise: ten thousand, Spark's default, hold too much of an executor."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    model = toxicity.fit(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "toxic")
    return docs.where(toxicity.scored("text", model)["score"] < toxicity.THRESHOLD).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    found = ngram_join.join(docs, "doc_id", "text", size=SHINGLE, percent=PERCENT)
    spare = found.where("component_id is not null and not component_id <=> doc_id")
    spare = spare.select(F.col("doc_id").alias("_doc"), "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(spare["_doc"]) & (F.xxhash64(docs["text"]) == spare["text_hash"])
    return docs.join(spare, same, "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    found = substring_dedup.locate(docs.select(*COLUMNS), "doc_id", "text", verbatim=True)
    n_chars = F.when(F.size("spans") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    rest = [F.col(f"row.{c}") for c in ("doc_id", "lang", "source")]
    return found.select(*rest, F.col("kept").alias("text"), n_chars.alias("n_chars")).select(*COLUMNS)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    bench = table(spark, sf_dir, "benchmark")
    rows = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    leaks = decontamination.matches(rows, "_row", "text", bench, "item_id", "text").select("_row").distinct()
    return rows.join(leaks, "_row", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), "text", public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", keep_clean),
    ("near_duplicates", keep_one_of_each),
    ("repeated_passages", cut_repeats),
    ("benchmark_leaks", keep_unleaked),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row; the session's size of Arrow batches is as before when it returns."""
    docs = table(spark, sf_dir, "documents")
    home = f"{shared.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_ROWS)
    try:
        for k, (name, stage) in enumerate(STAGES):
            path = f"{home}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return docs
