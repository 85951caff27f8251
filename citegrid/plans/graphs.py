"""Graph queries over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegrid.operators import graph
from citegrid.tables import table


def _key(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def impact_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    levels = [
        (orders.select(_key("o", "o_orderkey").alias("a"), _key("c", "o_custkey").alias("b")), "a", "b"),
        (customer.select(_key("c", "c_custkey").alias("a"), _key("n", "c_nationkey").alias("b")), "a", "b"),
        (nation.select(_key("n", "n_nationkey").alias("a"), _key("r", "n_regionkey").alias("b")), "a", "b"),
    ]
    critical = orders.where(F.col("o_orderpriority").startswith("1-")).select(_key("o", "o_orderkey").alias("node"))
    return graph.impact_by_levels(levels, critical)


IMPACT_RANK = """
WITH RECURSIVE edge AS (
  SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
reach AS (SELECT src, dst FROM edge UNION SELECT r.src, e.dst FROM reach r JOIN edge e ON e.src = r.dst),
crit AS (SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderpriority LIKE '1-%')
SELECT r.dst AS node, any_value(d.direct) AS direct, count(*) AS dependents, count(c.node) AS critical_dependents
FROM reach r LEFT JOIN crit c ON c.node = r.src
JOIN (SELECT dst, count(DISTINCT src) AS direct FROM edge GROUP BY dst) d ON d.dst = r.dst
GROUP BY r.dst"""


def _bases(spark: SparkSession, sf_dir: str, edited: bool) -> dict[str, DataFrame]:
    """(key, own, basis) of orders, customers and nations; edited: some rows as they are later."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    status = F.when((F.col("o_orderkey") % 97 == 0) & F.lit(edited), "X").otherwise(F.col("o_orderstatus"))
    segment = F.when((F.col("c_custkey") % 53 == 0) & F.lit(edited), "X").otherwise(F.col("c_mktsegment"))
    own = graph.node_digest(F.col("o_orderkey").cast("string"), status)
    o = orders.select(_key("o", "o_orderkey").alias("key"), "o_custkey", own.alias("own")).withColumn("basis", F.col("own"))
    below = graph.merkle_parents(o, "o_custkey", "basis")
    own = graph.node_digest(F.col("c_custkey").cast("string"), segment)
    c = customer.select(_key("c", "c_custkey").alias("key"), "c_custkey", "c_nationkey", own.alias("own"))
    c = c.join(below, F.col("c_custkey") == F.col("parent"), "left").withColumn("basis", graph.node_digest("own", F.coalesce("digest", F.lit(""))))
    below = graph.merkle_parents(c, "c_nationkey", "basis")
    n = nation.select(_key("n", "n_nationkey").alias("key"), "n_nationkey", graph.node_digest("n_name").alias("own"))
    n = n.join(below, F.col("n_nationkey") == F.col("parent"), "left").withColumn("basis", graph.node_digest("own", F.coalesce("digest", F.lit(""))))
    return {k: d.select("key", "own", "basis") for k, d in (("orders", o), ("customer", c), ("nation", n))}


def merkle_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bases(spark, sf_dir, False)["nation"].select("key", "basis")


def freshness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    then, now = _bases(spark, sf_dir, False), _bases(spark, sf_dir, True)
    recorded = then["customer"].where("cast(substring(key, 2) AS bigint) % 11 <> 0").unionByName(then["nation"])
    return graph.freshness(now["customer"].unionByName(now["nation"]), recorded)


def _bases_sql(tag: str, edited: bool) -> str:
    status = "CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END" if edited else "o_orderstatus"
    segment = "CASE WHEN c_custkey % 53 = 0 THEN 'X' ELSE c_mktsegment END" if edited else "c_mktsegment"

    def parents(name: str, source: str, parent: str) -> str:
        return f"""{name}b{tag} AS (SELECT {parent} AS parent, basis[1:2] AS bucket, sha256(string_agg(basis, chr(10) ORDER BY basis)) AS d FROM {source}{tag} GROUP BY 1, 2),
{name}p{tag} AS (SELECT parent, sha256(string_agg(bucket || ':' || d, chr(10) ORDER BY bucket || ':' || d)) AS digest FROM {name}b{tag} GROUP BY 1)"""

    return f"""o{tag} AS (SELECT o_custkey, sha256(o_orderkey || chr(10) || {status}) AS basis FROM orders),
{parents('o', 'o', 'o_custkey')},
c0{tag} AS (SELECT c_custkey, c_nationkey, sha256(c_custkey || chr(10) || {segment}) AS own FROM customer),
c{tag} AS (SELECT 'c' || c_custkey AS key, c_nationkey, own, sha256(own || chr(10) || coalesce(digest, '')) AS basis FROM c0{tag} LEFT JOIN op{tag} ON parent = c_custkey),
{parents('c', 'c', 'c_nationkey')},
n0{tag} AS (SELECT n_nationkey, sha256(n_name) AS own FROM nation),
n{tag} AS (SELECT 'n' || n_nationkey AS key, own, sha256(own || chr(10) || coalesce(digest, '')) AS basis FROM n0{tag} LEFT JOIN cp{tag} ON parent = n_nationkey)"""


MERKLE_BASIS = f"WITH {_bases_sql('1', False)} SELECT key, basis FROM n1"
FRESHNESS_STATUS = f"""WITH {_bases_sql('1', False)}, {_bases_sql('2', True)},
old AS (SELECT key, own, basis FROM c1 WHERE CAST(key[2:] AS BIGINT) % 11 <> 0 UNION ALL SELECT key, own, basis FROM n1),
cur AS (SELECT key, own, basis FROM c2 UNION ALL SELECT key, own, basis FROM n2)
SELECT cur.key, CASE WHEN old.basis IS NULL THEN 'unverified' WHEN old.basis = cur.basis THEN 'current' WHEN old.own <> cur.own THEN 'stale' ELSE 'upstream-stale' END AS status
FROM cur LEFT JOIN old ON old.key = cur.key"""


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as roots: for each customer, the suppliers of other regions that a walk over its orders meets first."""
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("root")))
    customer, supplier, orders, lines = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders", "lineitem"))
    of_customer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "root")
    of_order = orders.join(of_customer, F.col("o_custkey") == F.col("c_custkey")).select(_key("o", "o_orderkey").alias("node"), "root")
    of_supplier = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(_key("s", "s_suppkey"), "root")
    starts = of_customer.select(_key("c", "c_custkey").alias("node"), "root")
    edges = orders.select(_key("c", "o_custkey").alias("src"), _key("o", "o_orderkey").alias("dst"))
    edges = edges.union(lines.select(_key("o", "l_orderkey"), _key("s", "l_suppkey")))
    met = graph.frontier(edges, starts.union(of_order).union(of_supplier), starts.select("node"))
    met = met.select(F.substring("start", 2, 20).cast("long").alias("customer"), F.substring("node", 2, 20).cast("long").alias("supplier"))
    return met.groupBy("customer").agg(F.count("*").alias("neighbours"), F.min("supplier").alias("first_neighbour"))


FRONTIER = """
SELECT o_custkey AS customer, count(DISTINCT l_suppkey) AS neighbours, min(l_suppkey) AS first_neighbour
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = c_nationkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation b ON b.n_nationkey = s_nationkey
WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1"""


def _trust_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    to_supplier = lines.select(_key("o", "l_orderkey").alias("src"), _key("s", "l_suppkey").alias("dst"))
    to_order = orders.select(_key("c", "o_custkey").alias("src"), _key("o", "o_orderkey").alias("dst"))
    to_customer = customer.select(_key("n", "c_nationkey").alias("src"), _key("c", "c_custkey").alias("dst"))
    return to_supplier.union(to_order).union(to_customer)


def trust_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(_key("s", "s_suppkey").alias("node"))
    return graph.taint(_trust_edges(spark, sf_dir), seeds).withColumn("round", F.col("round").cast("long"))


TRUST_FIXPOINT = """
WITH RECURSIVE edge AS (
  SELECT 'o' || l_orderkey AS src, 's' || l_suppkey AS dst FROM lineitem
  UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
bad AS (SELECT 's' || s_suppkey AS node, 0 AS round FROM supplier WHERE s_acctbal < 0
  UNION SELECT e.src, b.round + 1 FROM bad b JOIN edge e ON e.dst = b.node)
SELECT node, CAST(min(round) AS BIGINT) AS round FROM bad GROUP BY node"""


def composition_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, suppliers and customers that each region is composed of, searched from the regions alone."""
    nation, region, supplier, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier", "customer"))
    edges = nation.select(_key("r", "n_regionkey").alias("src"), _key("n", "n_nationkey").alias("dst"))
    edges = edges.union(supplier.select(_key("n", "s_nationkey"), _key("s", "s_suppkey"))).union(customer.select(_key("n", "c_nationkey"), _key("c", "c_custkey")))
    found = graph.closure(edges, region.select(_key("r", "r_regionkey").alias("src")))
    return found.select(F.col("src").alias("root"), F.col("dst").alias("part"))


COMPOSITION_CLOSURE = """
SELECT 'r' || n_regionkey AS root, 'n' || n_nationkey AS part FROM nation
UNION ALL SELECT 'r' || n_regionkey, 's' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user did and did next, as edges between (user, type)."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.concat_ws("-", "user_id", "event_type").alias("src"))
    after = F.lead("src").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.withColumn("dst", after).where("dst is not null").select("src", "dst").distinct()


def scc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_moves(spark, sf_dir))


SCC_MEMBERS = """
WITH RECURSIVE edge AS (SELECT DISTINCT src, dst FROM (
  SELECT user_id || '-' || event_type AS src, lead(user_id || '-' || event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL),
reach AS (SELECT src, dst FROM edge UNION SELECT r.src, e.dst FROM reach r JOIN edge e ON e.src = r.dst),
node AS (SELECT src AS node FROM edge UNION SELECT dst FROM edge)
SELECT n.node, least(n.node, coalesce(min(a.dst), n.node)) AS component
FROM node n LEFT JOIN (SELECT a.src, a.dst FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src) a ON a.src = n.node GROUP BY n.node"""


def cyclic_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases over the users' moves, cycles included, and over what each event type rests on; ``signup`` alone has no digest of its own."""
    moves = _moves(spark, sf_dir)
    kinds = table(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", "event_type").alias("key"), "event_type").distinct()
    edges = moves.union(kinds.select("key", "event_type"))
    types = kinds.select(F.col("event_type").alias("key")).distinct()
    own = F.when(F.col("key") != "signup", graph.node_digest("key"))
    nodes = kinds.select("key", graph.node_digest("key").alias("own")).union(types.select("key", own))
    return graph.bases(nodes, edges)


QUERIES = {f.__name__: f for f in (impact_rank, merkle_basis, freshness_status, frontier, trust_fixpoint, composition_closure, scc_members, cyclic_basis)}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
