"""Aggregation and scoring queries over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegrid.operators import scoring
from citegrid.tables import table

STATUSES = ("F", "O", "P", "X")
TYPES = ("click", "error", "purchase", "signup", "view")


def status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.tally(table(spark, sf_dir, "orders"), "o_orderstatus", STATUSES)


STATUS_TALLY = """
SELECT d.s AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) d(s) LEFT JOIN orders ON o_orderstatus = d.s GROUP BY 1"""


def pass_rate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return scoring.pass_rates(orders.join(customer, "o_custkey"), ["c_mktsegment", "o_orderpriority"], F.col("o_orderstatus") == "F")


PASS_RATE_ROLLUP = """
WITH g AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority))
SELECT c_mktsegment, o_orderpriority, n, passed, CASE WHEN n = 0 THEN 'n/a' ELSE CAST(CASE WHEN (200 * passed) % (2 * n) = n AND ((100 * passed) // n) % 2 = 0 THEN (100 * passed) // n
ELSE (200 * passed + n) // (2 * n) END AS BIGINT) || '%' END AS rate FROM g"""


def outcome_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("bucket"), "event_type")
    return scoring.crosstab(events, "bucket", "event_type", TYPES)


OUTCOME_PIVOT = "SELECT user_id % 16 AS bucket, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in TYPES) + " FROM events GROUP BY 1"


def finding_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "event_type", F.floor("value").cast("long").alias("bucket"), "user_id", "event_id", F.concat(F.lit("p"), F.col("event_id") % 7).alias("path")
    )
    found = scoring.persistence(rows, ["event_type", "bucket"], "user_id", "path", ["event_id"])
    return found.withColumnsRenamed({"values": "paths", "first_value": "first_path"})


FINDING_PERSISTENCE = """
SELECT event_type, CAST(floor(value) AS BIGINT) AS bucket, count(*) AS occurrences, count(DISTINCT user_id) AS receipts,
string_agg(DISTINCT 'p' || event_id % 7, ',' ORDER BY 'p' || event_id % 7) AS paths, min_by('p' || event_id % 7, event_id) AS first_path FROM events GROUP BY 1, 2"""


def topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation the three open orders that come first by priority and key, and how many wait."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    ready = orders.join(customer, "o_custkey").select("c_nationkey", "o_orderpriority", "o_orderkey")
    rows = scoring.batch(ready, "c_nationkey", [F.col("o_orderpriority"), F.col("o_orderkey")], 3)
    return rows.select("c_nationkey", "o_orderkey", "o_orderpriority", F.col("place").cast("long").alias("place"), "more")


TOPK_BATCH = """
SELECT c_nationkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderpriority, o_orderkey) AS place,
greatest(count(*) OVER (PARTITION BY c_nationkey) - 3, 0) AS more FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' QUALIFY place <= 3"""


def fact_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct words of each conversation's questions its answers repeat, as a fraction."""
    words = F.array_remove(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z]+"), "")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.array_distinct(words)).alias("word"))
    by_word = turns.groupBy("conv_id", "word").agg(F.max((F.col("role") == "user").cast("int")).alias("asked"), F.max((F.col("role") == "assistant").cast("int")).alias("told"))
    return by_word.groupBy("conv_id").agg(F.count_if(F.expr("asked = 1 AND told = 1")).alias("found"), F.count_if(F.expr("asked = 1")).alias("wanted"))


FACT_RECALL = """
WITH w AS (SELECT conv_id, role, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+'), lambda x: x <> '')) AS word FROM conversations),
b AS (SELECT conv_id, word, bool_or(role = 'user') AS asked, bool_or(role = 'assistant') AS told FROM w GROUP BY 1, 2)
SELECT conv_id, count(*) FILTER (WHERE asked AND told) AS found, count(*) FILTER (WHERE asked) AS wanted FROM b GROUP BY 1"""


def reading_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last assistant turn of each conversation, and whether both roles spoke before it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n_chars"))
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "n_chars")).alias("last"))
    roles = turns.groupBy("conv_id").agg(F.count_if(F.expr("role = 'user'")).alias("asked"), F.count_if(F.expr("role = 'assistant'")).alias("told"), F.count_if(F.expr("turn IS NULL")).alias("unplaced"))
    rows = roles.join(last, "conv_id", "left")
    complete = (F.col("asked") > 0) & (F.col("told") > 0) & (F.col("unplaced") == 0)
    return rows.select("conv_id", F.col("last.turn").alias("last_turn"), F.col("last.n_chars").cast("long").alias("n_chars"), complete.alias("complete"))


READING_COVERAGE = """
SELECT conv_id, max(turn) FILTER (WHERE role = 'assistant') AS last_turn, CAST(max_by(length(text), turn) FILTER (WHERE role = 'assistant') AS BIGINT) AS n_chars,
bool_or(role = 'user') AND bool_or(role = 'assistant') AND count(*) = count(turn) AS complete FROM conversations GROUP BY 1"""


def stopping_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation: stop if nothing blocks it; blockers are named in a fixed order."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    by = orders.groupBy("o_custkey").agg(F.count_if(F.expr("o_orderstatus = 'P'")).alias("p"), F.count_if(F.expr("o_orderpriority LIKE '1-%'")).alias("u"))
    rows = customer.join(by, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(
        F.count("*").alias("claims"), F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("u"), F.lit(0)).alias("u"), F.count_if(F.expr("c_acctbal < 0")).alias("owing")
    )
    conditions = (("S1-scope", "claims < 50"), ("S2-pending", "p > claims / 4"), ("S3-urgent", "u > claims * 2"), ("S4-owing", "owing * 10 > claims"))
    blockers = F.concat_ws(",", *[F.when(F.expr(c), F.lit(name)) for name, c in conditions])
    return rows.select("c_nationkey", blockers.alias("blockers"), F.when(blockers == "", "stop").otherwise("continue").alias("state"))


STOPPING_STATE = """
WITH o AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) FILTER (WHERE o_orderpriority LIKE '1-%') AS u FROM orders GROUP BY 1),
n AS (SELECT c_nationkey, count(*) AS claims, coalesce(sum(p), 0) AS p, coalesce(sum(u), 0) AS u, count(*) FILTER (WHERE c_acctbal < 0) AS owing FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1),
b AS (SELECT c_nationkey, concat_ws(',', CASE WHEN claims < 50 THEN 'S1-scope' END, CASE WHEN p > claims / 4 THEN 'S2-pending' END, CASE WHEN u > claims * 2 THEN 'S3-urgent' END, CASE WHEN owing * 10 > claims THEN 'S4-owing' END) AS blockers FROM n)
SELECT c_nationkey, blockers, CASE WHEN blockers = '' THEN 'stop' ELSE 'continue' END AS state FROM b"""


def recall_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credit of each order from its lines' states, summed by status as an exact count of each fraction."""
    state = F.when(F.col("l_returnflag") == "A", "correct").when(F.col("l_returnflag") == "R", "absent").when(F.col("l_quantity") > 49, "contradicted").otherwise("correct")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", state.alias("state"))
    rows = lines.groupBy("l_orderkey").agg(scoring.credit(F.collect_list("state")).alias("c"))
    return rows.groupBy(F.col("c.status").alias("status"), F.col("c.num").cast("long").alias("num"), F.col("c.den").cast("long").alias("den")).agg(F.count("*").alias("n"))


RECALL_CREDIT = """
WITH s AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN 'correct' WHEN l_returnflag = 'R' THEN 'absent' WHEN l_quantity > 49 THEN 'contradicted' ELSE 'correct' END AS s FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE s = 'correct') AS k, count(*) FILTER (WHERE s = 'absent') AS a, bool_or(s = 'contradicted') AS bad FROM s GROUP BY 1),
c AS (SELECT CASE WHEN bad THEN 'misstated' WHEN k = n THEN 'covered' WHEN a = n THEN 'missing' ELSE 'partial' END AS status,
CASE WHEN bad THEN 0 WHEN k = n THEN 1 WHEN a = n THEN 0 WHEN n = 1 THEN 1 ELSE k END AS num, CASE WHEN bad OR k = n OR a = n THEN 1 WHEN n = 1 THEN 2 ELSE n END AS den FROM g)
SELECT status, CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den, count(*) AS n FROM c GROUP BY 1, 2, 3"""


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by role: an exact measurement of a conversation supersedes its reported one; unknown is null, not zero."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.length("text").cast("long").alias("n"))
    exact = turns.where("conv_id % 3 = 0").groupBy("conv_id", "role").agg(F.sum("n").alias("n"))
    reported = turns.groupBy("conv_id", "role").agg(F.sum(F.floor(F.col("n") / 10) * 10).alias("n")).join(exact.select("conv_id").distinct(), "conv_id", "left_anti")
    unknown = F.when(F.col("conv_id") % 7 == 5, None).otherwise(F.col("n"))
    both = exact.withColumn("kind", F.lit("exact")).unionByName(reported.withColumn("n", unknown).withColumn("kind", F.lit("reported")))
    return both.groupBy("role", "kind").agg(F.sum("n").cast("long").alias("tokens"), F.count("*").alias("runs"), F.count_if(F.expr("n IS NULL")).alias("unknown"))


USAGE_TOTALS = """
WITH e AS (SELECT conv_id, role, sum(length(text)) AS n FROM conversations WHERE conv_id % 3 = 0 GROUP BY 1, 2),
r AS (SELECT conv_id, role, sum(length(text) // 10 * 10) AS n FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM e) GROUP BY 1, 2),
b AS (SELECT role, 'exact' AS kind, n FROM e UNION ALL SELECT role, 'reported', CASE WHEN conv_id % 7 = 5 THEN NULL ELSE n END FROM r)
SELECT role, kind, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS runs, count(*) FILTER (WHERE n IS NULL) AS unknown FROM b GROUP BY 1, 2"""


def drift_first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first column, by name, in which the two latest orders of a customer differ."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    rows = table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(w)).where("place <= 2")
    fields = ("o_orderpriority", "o_orderstatus")
    pair = rows.groupBy("o_custkey").agg(*[F.max(F.when(F.col("place") == k, F.col(f))).alias(f"{f}{k}") for f in fields for k in (1, 2)], F.count("*").alias("n")).where("n = 2")
    first = F.coalesce(*[F.when(~F.col(f"{f}1").eqNullSafe(F.col(f"{f}2")), F.lit(f)) for f in fields], F.lit("none"))
    return pair.select("o_custkey", first.alias("first_difference"))


DRIFT_FIRST_DIFFERENCE = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders QUALIFY p <= 2)
SELECT a.o_custkey, CASE WHEN a.o_orderpriority <> b.o_orderpriority THEN 'o_orderpriority' WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' ELSE 'none' END AS first_difference
FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.p = 1 AND b.p = 2"""

QUERIES = {
    f.__name__: f
    for f in (
        status_tally, pass_rate_rollup, outcome_pivot, finding_persistence, topk_batch, fact_recall, reading_coverage, stopping_state, recall_credit, usage_totals, drift_first_difference,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES}
