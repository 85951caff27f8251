"""Queries over source files made of orders (seven files, an order a node, its lines the nodes within), and over what claims say of cited lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.operators import claims, spans
from citegrid.tables import table

FILES = 7
#: Line numbers for an order, and for each of its lines.
ORDER, LINE = 128, 8
# Every 97th order is left open; every fifth has a comment before its name; odd lines have a comment with braces over two lines.
_ORDER = "concat(if(o_orderkey % 5 = 0, '/* { */ ', ''), 'o', o_orderkey, ': order@', o_orderkey, ' { // {')"
_FIRST = "concat('l', l_linenumber, ': line@', l_partkey, ' { qty = <', cast(l_quantity as int), '>; ref = <&part', l_partkey, '>;')"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, text)"""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"concat('f', o_custkey % {FILES}, '.dts') file", f"o_orderkey * {ORDER} at")
    own = orders.select("file", F.explode(F.array(F.struct(F.col("at").alias("line"), F.expr(_ORDER).alias("text")), F.struct((F.col("at") + ORDER - 1).alias("line"), F.expr("if(o_orderkey % 97 = 0, '', '};')").alias("text")))).alias("x"))
    parts = _lines(spark, sf_dir, orders)
    odd = F.col("l_linenumber") % 2 == 1
    texts = [F.expr(_FIRST), F.when(odd, "/* opened {").otherwise("'{' \"{\" // {"), F.when(odd, 'still } here */ note = "}";').otherwise("note = \"\\\"}\";"), F.lit("};")]
    within = parts.select("file", F.explode(F.array(*[F.struct((F.col("begin") + k).alias("line"), t.alias("text")) for k, t in enumerate(texts)])).alias("x"))
    return own.union(within).select("file", "x.line", "x.text")


def _lines(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """One line for each number of an order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("l_quantity"))
    return orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("begin", F.col("at") + F.col("l_linenumber") * LINE)


_FILES = f"""o AS (SELECT o_orderkey, 'f' || (o_custkey % {FILES}) || '.dts' AS file, o_orderkey * {ORDER} AS base, o_orderkey % 97 = 0 AS lost FROM orders),
d AS (SELECT *, 1 + coalesce(sum(CASE WHEN lost THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level FROM o),
k AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2),
l AS (SELECT file, 'line@' || part AS name, part, level + 1 AS level, base + l_linenumber * {LINE} AS begin, base + l_linenumber * {LINE} + 3 AS "end" FROM d JOIN k ON l_orderkey = o_orderkey),
n AS (SELECT file, 'order@' || o_orderkey AS name, level, base AS begin, CASE WHEN NOT lost THEN base + {ORDER - 1} END AS "end" FROM d UNION ALL SELECT file, name, level, begin, "end" FROM l)"""


def node_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each node begins and ends; orders left open put all that follows a level deeper."""
    return spans.nodes(files(spark, sf_dir)).select("file", "name", F.col("level").cast("long").alias("level"), "begin", "end")


NODE_SPANS = f"WITH {_FILES} SELECT file, name, CAST(level AS BIGINT) AS level, begin, \"end\" FROM n"


def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and orders as nodes that are looked up in a file; most nodes of a part stand there several times or not at all."""
    parts = table(spark, sf_dir, "part").selectExpr(f"concat('f', p_partkey % {FILES}, '.dts') file", "concat('line@', p_partkey) node")
    orders = table(spark, sf_dir, "orders").selectExpr(f"concat('f', o_custkey % {FILES}, '.dts') file", "concat('order@', o_orderkey + if(o_orderkey % 11 = 0, 1, 0)) node")
    return spans.look_up(parts.union(orders), spans.nodes(files(spark, sf_dir)))


NODE_LOOKUP = f"""
WITH {_FILES},
w AS (SELECT 'f' || (p_partkey % {FILES}) || '.dts' AS file, 'line@' || p_partkey AS node FROM part UNION SELECT 'f' || (o_custkey % {FILES}) || '.dts', 'order@' || (o_orderkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) FROM orders),
g AS (SELECT w.file, w.node, count(n.name) AS held, count(n."end") AS closed, min(begin) AS b, min("end") AS e FROM w LEFT JOIN n ON n.file = w.file AND n.name = w.node GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN held = 0 THEN 'missing' WHEN closed < held THEN 'unclosed' WHEN held > 1 THEN 'several' ELSE 'ok' END AS status FROM g)
SELECT file, node, status, CASE WHEN status = 'ok' THEN b END AS begin, CASE WHEN status = 'ok' THEN e END AS "end" FROM s"""


def symbol_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that cite a part near the span of their node, by whether its symbol stands there."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"concat('f', o_custkey % {FILES}, '.dts') file", f"o_orderkey * {ORDER} at")
    cited = _lines(spark, sf_dir, orders).selectExpr("file", "concat('part', if(l_linenumber % 2 = 0, l_partkey, cast(l_partkey / 2 as bigint))) symbol", "begin", "begin + 3 end")
    return spans.with_symbol(cited, files(spark, sf_dir)).groupBy("file", "symbol").agg(F.count("*").alias("cited"), F.count_if("found").alias("found"))


SYMBOL_SPANS = f"""
WITH {_FILES}, c AS (SELECT d.file, base + l_linenumber * {LINE} AS begin, CASE WHEN l_linenumber % 2 = 0 THEN part ELSE part // 2 END AS part FROM d JOIN k ON l_orderkey = o_orderkey)
SELECT file, 'part' || part AS symbol, count(*) AS cited, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM l WHERE l.file = c.file AND l.part = c.part AND l.begin BETWEEN c.begin - {spans.BEFORE} AND c.begin + 3)) AS found FROM c GROUP BY 1, 2"""


def claim_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims over what their lines say, with a literal in each of two sentences, a range of pins and a cell."""
    facts = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey fact",
        "concat('The widget limit is, e.g. for pins `GPIO0`..`GPIO', o_custkey % 7 + 1, '`, 0x', hex(o_custkey % 50), '. A gadget mode is 0x', hex(o_orderkey % 50), 'u! There ngpios = <', o_custkey % 9, '>.') claim",
    )
    cited = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey fact",
        "concat('#define ', if(l_linenumber % 2 = 0, 'WIDGET_LIMIT', 'GadgetMode'), ' 0x', hex(l_partkey % 50), ' GPIO_', cast(l_quantity as int) % 9, ' at\nngpios=<', l_suppkey % 9, '>') text",
        "cast(null as string) context", "if(l_linenumber = 3, 'widget_probe', null) symbol",
    )
    return claims.findings(facts, cited).select("fact", "rank", "code", "subject", "name", "begin", "end")


CLAIM_FINDINGS = """
WITH o AS (SELECT o_orderkey AS fact, o_custkey % 7 + 1 AS pin, o_custkey % 50 AS lim, o_orderkey % 50 AS mode, o_custkey % 9 AS cell FROM orders),
l AS (SELECT l_orderkey AS fact, l_partkey % 50 AS v, l_linenumber % 2 = 0 OR l_linenumber = 3 AS widget, l_linenumber % 2 = 1 AS gadget, CAST(l_quantity AS INT) % 9 AS pin, l_suppkey % 9 AS cell FROM lineitem),
s AS (SELECT *, 'The widget limit is, e.g. for pins `GPIO0`..`GPIO' || pin || '`, 0x' || printf('%X', lim) || '.' AS one, ' A gadget mode is 0x' || printf('%X', mode) || 'u!' AS two FROM o),
v AS (SELECT fact, lim AS v, 0 AS b, length(one) AS e, true AS first FROM s UNION ALL SELECT fact, mode, length(one), length(one) + length(two), false FROM s),
u AS (SELECT v.fact, v.v, b, e FROM v JOIN l ON l.fact = v.fact AND l.v = v.v GROUP BY 1, 2, 3, 4 HAVING NOT bool_or(CASE WHEN first THEN widget ELSE gadget END))
SELECT fact, 0 AS rank, 'hex-unbound' AS code, CAST(v AS VARCHAR) AS subject, CAST(NULL AS VARCHAR) AS name, CAST(min(b) AS INT) AS begin, CAST(arg_min(e, b) AS INT) AS "end" FROM u GROUP BY fact, v
UNION ALL SELECT fact, 1, 'range-end', 'GPIO0..GPIO' || pin, 'GPIO' || pin, NULL, NULL FROM o WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.fact = o.fact AND l.pin = o.pin)
UNION ALL SELECT fact, 1, 'range-successor', 'GPIO0..GPIO' || pin, 'GPIO' || (pin + 1), NULL, NULL FROM o WHERE EXISTS (SELECT 1 FROM l WHERE l.fact = o.fact AND l.pin = o.pin + 1)
UNION ALL SELECT fact, 2, 'cell-absent', CAST(cell AS VARCHAR), 'ngpios', NULL, NULL FROM o WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.fact = o.fact AND l.cell = o.cell)"""

QUERIES = {f.__name__: f for f in (node_spans, node_lookup, symbol_spans, claim_findings)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
