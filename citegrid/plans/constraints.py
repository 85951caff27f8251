"""Constraint queries over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.operators import relations
from citegrid.tables import table


def ref_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's references to an order, a supplier and a part, with reasons, counted by kind."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    kinds = (
        ("order", "l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey"),
        ("supplier", "l_suppkey", table(spark, sf_dir, "supplier").where("s_acctbal >= 0"), "s_suppkey"),
        ("part", "l_partkey", table(spark, sf_dir, "part").select("p_partkey").union(table(spark, sf_dir, "part").where("p_size = 1").select("p_partkey")), "p_partkey"),
    )
    out = None
    for kind, column, targets, target in kinds:
        # Pre-aggregated: a reference that many lines share is resolved once.
        refs = lines.groupBy(F.col(column).alias("ref")).agg(F.count("*").alias("n"))
        rows = relations.resolve(refs, "ref", targets, target).groupBy("why").agg(F.sum("n").alias("refs"), F.count("*").alias("targets"))
        rows = rows.select(F.lit(kind).alias("kind"), "why", "refs", "targets")
        out = rows if out is None else out.unionByName(rows)
    return out


REF_RESOLUTION = """
WITH refs AS (
  SELECT 'order' AS kind, l_orderkey AS ref FROM lineitem UNION ALL SELECT 'supplier', l_suppkey FROM lineitem UNION ALL SELECT 'part', l_partkey FROM lineitem),
targets AS (
  SELECT 'order' AS kind, o_orderkey AS ref FROM orders UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_acctbal >= 0
  UNION ALL SELECT 'part', p_partkey FROM part UNION ALL SELECT 'part', p_partkey FROM part WHERE p_size = 1),
known AS (SELECT kind, ref, count(*) AS n FROM targets GROUP BY 1, 2)
SELECT refs.kind, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS why, count(*) AS refs, count(DISTINCT refs.ref) AS targets
FROM refs LEFT JOIN known ON known.kind = refs.kind AND known.ref = refs.ref GROUP BY 1, 2"""


def referential_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, lines, customer, orders = (table(spark, sf_dir, t) for t in ("part", "lineitem", "customer", "orders"))
    unused = part.join(lines.where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"))
    idle = customer.join(orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return unused.union(idle.select(F.lit("customer"), F.col("c_custkey")))


REFERENTIAL_ANTI = """
SELECT 'part' AS kind, p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)
UNION ALL SELECT 'customer', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"""


def verdict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    verdicts = table(spark, sf_dir, "labels").select("doc_id", "quality")
    state = F.when(F.col("source").isNull(), "orphan").when(F.col("quality").isNull(), "unverified").when(F.col("quality") == 1, "pass").otherwise("fail")
    both = docs.join(verdicts, "doc_id", "full").withColumn("state", state)
    return both.groupBy("source", "state").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


VERDICT_JOIN = """
WITH both_ AS (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, source, quality FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id)
SELECT source, CASE WHEN source IS NULL THEN 'orphan' WHEN quality IS NULL THEN 'unverified' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS state, count(*) AS n, min(doc_id) AS first_doc
FROM both_ GROUP BY 1, 2"""


def second_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that two sources or more hold, spaces and case of A-Z aside."""
    text = F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[ \\t\\n\\r]+", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(text, 256).alias("digest"))
    found = docs.groupBy("digest").agg(F.countDistinct("source").alias("readers"), F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
    return found.where("readers >= 2")


SECOND_READER = """
WITH d AS (SELECT doc_id, source, sha256(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\r]+', ' ', 'g'), ' ')) AS digest FROM documents)
SELECT digest, count(DISTINCT source) AS readers, count(*) AS docs, min(doc_id) AS first_doc FROM d GROUP BY 1 HAVING count(DISTINCT source) >= 2"""


def overlap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one order whose shipping intervals [shipdate, shipdate + quantity days) overlap, by return flag."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date"))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", day.alias("begin"), (day + F.col("l_quantity").cast("int")).alias("end"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("when_")
    )
    found = relations.overlaps(lines, "l_orderkey", "begin", "end", "l_linenumber", "when_", 64)
    return found.select("l_orderkey", F.col("a").alias("line_a"), F.col("b").alias("line_b"))


OVERLAP_INTERVALS = """
WITH l AS (SELECT l_orderkey, l_linenumber, datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS b, datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INT) AS e, nullif(l_returnflag, 'N') AS w FROM lineitem)
SELECT x.l_orderkey, x.l_linenumber AS line_a, y.l_linenumber AS line_b FROM l x JOIN l y ON y.l_orderkey = x.l_orderkey AND x.l_linenumber < y.l_linenumber
AND x.b < y.e AND y.b < x.e AND (x.w IS NULL OR y.w IS NULL OR x.w = y.w)"""


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a customer that name a part again; the first by order and line wins."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = relations.repeated(lines.join(orders, "l_orderkey"), ["o_custkey", "l_partkey"], ["l_orderkey", "l_linenumber"])
    return rows.select("o_custkey", "l_partkey", "l_orderkey", "l_linenumber", F.col("copies"), F.col("place").cast("long").alias("place"))


DUPLICATE_KEYS = """
SELECT o_custkey, l_partkey, l_orderkey, l_linenumber, count(*) OVER w AS copies, row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS place
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WINDOW w AS (PARTITION BY o_custkey, l_partkey) QUALIFY count(*) OVER w > 1"""


def asof_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the latest signup of its user at or before it."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    marks = events.where("event_type = 'signup'").select("user_id", "ts", "event_id", F.col("event_id").alias("signup_id"))
    return relations.as_of(events, marks, "user_id", "ts", "event_id", "signup_id").select("event_id", "user_id", "event_type", "signup_id")


ASOF_LABEL = """
SELECT e.event_id, e.user_id, e.event_type, (SELECT max_by(s.event_id, (s.ts, s.event_id)) FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id AND s.ts <= e.ts) AS signup_id
FROM events e"""


def priority_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour of a user is purchase, view or click by what it holds first in that order, else idle."""
    events = table(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", "ts").cast("string").alias("hour"), "event_type")
    held = events.groupBy("user_id", "hour").agg(*[F.max((F.col("event_type") == t).cast("int")).alias(t) for t in ("purchase", "view", "click")])
    return held.select("user_id", "hour", relations.first_label([(F.col(t) == 1, t) for t in ("purchase", "view", "click")], "idle").alias("phase"))


PRIORITY_PHASE = """
SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour,
CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' WHEN bool_or(event_type = 'view') THEN 'view' WHEN bool_or(event_type = 'click') THEN 'click' ELSE 'idle' END AS phase
FROM events GROUP BY 1, 2"""


def section_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that cover every size from 1 to 5: the division of (brand, size) by the sizes."""
    part = table(spark, sf_dir, "part")
    wanted = part.where("p_size <= 5").select("p_size")
    return relations.covers_all(part, "p_brand", "p_size", wanted).select("p_brand", F.col("n_items"))


SECTION_COVER = """
SELECT p_brand, count(DISTINCT p_size) AS n_items FROM part WHERE p_size <= 5 GROUP BY 1
HAVING count(DISTINCT p_size) = (SELECT count(DISTINCT p_size) FROM part WHERE p_size <= 5)"""

QUERIES = {
    f.__name__: f
    for f in (ref_resolution, referential_anti, verdict_join, second_reader, overlap_intervals, duplicate_keys, asof_label, priority_phase, section_cover)
}
SQL = {name: globals()[name.upper()] for name in QUERIES}
