"""Queries over a ledger of evidence made of orders, a topology of nations, suppliers and lines, trees of orders, and findings of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.operators import findings, history
from citegrid.operators import sweep as sweeps
from citegrid.operators import topology, trees
from citegrid.tables import table

KINDS = ["verification", "qualification", "observation", "result"]
SOURCE_KINDS = ["spec", "document", "kernel", "harness", "emulator", "candidate", "toolchain"]
_ARRAY = lambda names: "array('" + "', '".join(names) + "')"
_LIST = lambda names: "['" + "', '".join(names) + "']"


def ledger_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries of their customer's basis, suppliers as sources, lines as what a basis saw of them."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    entries = orders.selectExpr(
        "'e' || o_orderkey id", f"element_at({_ARRAY(KINDS)}, cast(o_orderkey % 4 as int) + 1) kind", "'c' || o_custkey claim", "'b' || o_custkey basis", "o_orderstatus = 'P' superseded",
        "array(o_custkey || '.' || (o_orderkey % 3)) sections", "case o_orderkey % 3 when 0 then array('emulated') when 1 then array('kernel') end evidence",
    )
    seen = lines.where("l_quantity >= 49").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    pins = seen.groupBy(F.expr("'b' || o_custkey").alias("basis"), F.expr("'s' || l_suppkey").alias("source")).agg(F.max("l_linenumber").cast("string").alias("seen"))
    sources = table(spark, sf_dir, "supplier").selectExpr("'s' || s_suppkey source", f"element_at({_ARRAY(SOURCE_KINDS)}, cast(s_suppkey % {len(SOURCE_KINDS)} as int) + 1) kind", "cast(s_suppkey % 7 + 1 as string) now", "s_acctbal > 0 ok")
    customers = table(spark, sf_dir, "customer")
    changes = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").selectExpr("'s' || s_suppkey source", "explode(sequence(1, 7)) seen", "cast(s_suppkey % 7 + 1 as string) now", "s_suppkey")
    changes = changes.selectExpr("source", "cast(seen as string) seen", "now", "case when s_suppkey % 4 = 0 then transform(sequence(1, 40), x -> x * seen || '') end sections", "array('k' || seen) checks", "'r' || seen since")
    claims = customers.selectExpr("'c' || c_custkey claim", "if(c_custkey % 2 = 0, array(c_custkey || ''), null) cites", "array('k' || (c_custkey % 5)) checks")
    bases = customers.selectExpr("'b' || c_custkey basis", "if(c_custkey % 5 = 0, null, array(c_custkey || '.0')) dependencies")
    citations = entries.where("kind = 'verification'").join(pins, "basis").where(F.length("source") % 2 == 0).select("id", "source", "sections")
    contradictions = orders.where("o_totalprice > 300000").selectExpr("'e' || o_orderkey observation", "'h' || o_custkey conflict", "if(o_orderkey % 2 = 0, 'd' || o_custkey, '') since")
    premises = orders.where("o_orderkey % 8 = 2").selectExpr("'c' || o_custkey claim", "'e' || o_orderkey observation")
    found = sweeps.sweep(entries, pins, bases, sources, changes, claims, citations, contradictions, premises)
    told = F.array_join(F.transform("reasons", lambda r: F.concat_ws("|", r["reason"], r["source"], F.coalesce(r["since"], F.lit("-")))), ";")
    return found.select("id", "kind", "state", F.size("reasons").cast("long").alias("n_reasons"), F.md5(told.cast("binary")).alias("told"))


_OVER = lambda a, b: f"({a} = {b} OR starts_with({a}, {b} || '.') OR starts_with({b}, {a} || '.'))"
_ANY = lambda a, b: f"len(list_filter({a}, lambda x: len(list_filter({b}, lambda y: {_OVER('x', 'y')})) > 0)) > 0"
LEDGER_SWEEP = f"""
WITH e AS (SELECT 'e' || o_orderkey AS id, {_LIST(KINDS)}[1 + o_orderkey % 4] AS kind, 'c' || o_custkey AS claim, 'b' || o_custkey AS basis, o_orderstatus = 'P' AS superseded, [o_custkey || '.' || (o_orderkey % 3)] AS sections,
  CASE o_orderkey % 3 WHEN 0 THEN 'emulated' WHEN 1 THEN 'kernel' END AS evidence, o_custkey AS k FROM orders),
p AS (SELECT 'b' || o_custkey AS basis, 's' || l_suppkey AS source, l_suppkey AS s, max(l_linenumber) AS seen FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 49 GROUP BY 1, 2, 3),
s AS (SELECT s_suppkey AS s, {_LIST(SOURCE_KINDS)}[1 + s_suppkey % {len(SOURCE_KINDS)}] AS source_kind, s_suppkey % 7 + 1 AS now FROM supplier WHERE s_acctbal > 0),
m AS (SELECT e.*, p.source, p.s, seen, source_kind, CASE WHEN p.s % 4 = 0 THEN list_transform(range(1, 41), lambda x: CAST(x * seen AS VARCHAR)) END AS c_sections, CASE WHEN p.s % 2 = 0 THEN 'k' || seen END AS c_check, CASE WHEN p.s % 2 = 0 THEN 'r' || seen END AS since
  FROM e JOIN p ON p.basis = e.basis JOIN s ON s.s = p.s WHERE NOT superseded AND seen <> now),
d AS (SELECT id, source, since, CASE
  WHEN source_kind = 'spec' AND kind = 'verification' THEN CASE WHEN c_sections IS NULL THEN 'spec changed; unreviewed' WHEN {_ANY('sections', 'c_sections')} THEN 'spec changed in reviewed sections' END
  WHEN source_kind = 'spec' AND kind = 'qualification' THEN CASE WHEN c_sections IS NULL OR k % 2 = 1 THEN 'spec changed; unreviewed' WHEN {_ANY("[CAST(k AS VARCHAR)]", 'c_sections')} THEN 'spec changed in the claim''s sections' END
  WHEN source_kind = 'document' AND kind = 'verification' THEN CASE WHEN c_sections IS NULL OR length(source) % 2 = 1 THEN 'document changed; whole document' WHEN {_ANY('sections', 'c_sections')} THEN 'document changed in cited sections' END
  WHEN source_kind = 'kernel' AND kind = 'verification' AND evidence = 'kernel' THEN 'reference source changed'
  WHEN source_kind = 'harness' AND kind = 'qualification' THEN CASE WHEN c_check IS NULL THEN 'harness changed; unmapped' WHEN c_check = 'k' || (k % 5) THEN 'harness changed a named check' END
  WHEN source_kind = 'emulator' AND (kind IN ('qualification', 'result', 'observation') OR kind = 'verification' AND evidence = 'emulated') THEN 'emulator or guest changed'
  WHEN source_kind = 'candidate' AND kind = 'result' THEN 'candidate build changed'
  WHEN source_kind = 'toolchain' AND kind IN ('qualification', 'result', 'observation') THEN 'recorded toolchain changed' END AS reason FROM m),
f AS (SELECT id, reason, source, since FROM d WHERE reason IS NOT NULL),
o AS (SELECT id AS b, k, sections[1] AS section FROM e WHERE kind = 'observation' AND NOT superseded),
st AS (SELECT o.*, min(since) AS since FROM o JOIN f ON f.id = o.b GROUP BY ALL),
c AS (SELECT 'e' || o_orderkey AS b, 'h' || o_custkey AS conflict, CASE WHEN o_orderkey % 2 = 0 THEN 'd' || o_custkey ELSE '' END AS since FROM orders WHERE o_totalprice > 300000),
ap AS (SELECT o.*, coalesce(least((SELECT min(f.since) FROM f WHERE f.id = o.b AND f.since <> ''), nullif(c.since, '')), 'index:' || o.b) AS since FROM o JOIN c ON c.b = o.b),
v AS (SELECT id, k, sections[1] AS section FROM e WHERE kind = 'verification' AND evidence = 'emulated' AND NOT superseded),
u AS (SELECT id, b, since, 'cited emulated observation is stale' AS reason FROM v JOIN st ON st.k = v.k AND v.k % 5 <> 0 AND (st.section = v.section OR st.section = v.k || '.0')
  UNION ALL SELECT id, b, since, 'cited emulated observation is stale' FROM v JOIN st ON v.k % 5 = 0 AND st.b = (SELECT min(b) FROM st)
  UNION ALL SELECT id, b, since, 'premise observation contested' FROM v JOIN ap ON ap.k = v.k AND v.k % 5 <> 0 AND (ap.section = v.section OR ap.section = v.k || '.0')
  UNION ALL SELECT id, b, since, 'premise observation contested' FROM v JOIN ap ON v.k % 5 = 0 AND ap.b = (SELECT min(b) FROM ap)),
pr AS (SELECT o_custkey AS k, 'e' || o_orderkey AS b FROM orders WHERE o_orderkey % 8 = 2),
q AS (SELECT id, ap.b, since FROM e JOIN pr ON pr.k = e.k JOIN ap ON ap.b = pr.b WHERE kind = 'qualification' AND NOT superseded
  UNION ALL SELECT id, ap.b, since FROM e JOIN ap ON ap.k = e.k WHERE kind = 'qualification' AND NOT superseded AND e.k % 2 = 0 AND e.k NOT IN (SELECT k FROM pr)),
a AS (SELECT DISTINCT * FROM (SELECT id, reason, source, since FROM f UNION ALL SELECT id, reason, b, since FROM u
  UNION ALL SELECT c.b, 'hardware contradicts emulated observation', conflict, c.since FROM c JOIN o ON o.b = c.b UNION ALL SELECT id, 'premise observation contested', b, since FROM q)),
r AS (SELECT id, count(*) AS n, string_agg(reason || '|' || source || '|' || coalesce(since, '-'), ';' ORDER BY reason, source, since NULLS FIRST) AS told FROM a GROUP BY 1)
SELECT e.id, kind, CASE WHEN superseded THEN 'superseded' WHEN ap.b IS NOT NULL THEN 'contested' WHEN n IS NOT NULL THEN 'stale' ELSE 'current' END AS state, coalesce(n, 0) AS n_reasons, md5(coalesce(told, '')) AS told
FROM e LEFT JOIN r ON r.id = e.id LEFT JOIN (SELECT DISTINCT b FROM ap) ap ON ap.b = e.id"""



def _topology(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations as boards, suppliers as socs and chips, customers as peripherals, first lines as connections: (admitted, connections, boundaries)."""
    nation, supplier, customer = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    socs = supplier.selectExpr("'s' || s_suppkey spec", "if(s_suppkey % 2 = 0, 'soc', 'chip') kind")
    specs = nation.selectExpr("'n' || n_nationkey spec", "'board' kind").union(socs)
    specs = specs.union(table(spark, sf_dir, "region").selectExpr("'r' || r_regionkey", "'ip'")).union(customer.selectExpr("'c' || c_custkey", "'peripheral'"))
    parts = supplier.where("s_suppkey % 3 = 0").selectExpr("'n' || s_nationkey spec", "'s' || s_suppkey part").union(nation.selectExpr("'n' || n_nationkey", "'n' || ((n_nationkey + 1) % 25)"))
    instances = nation.selectExpr("'n' || n_nationkey spec", "'r' || n_regionkey target")
    describes = customer.selectExpr("'c' || c_custkey spec", "'s' || c_custkey target")
    connections = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").selectExpr(
        "'o' || l_orderkey || ':' || l_partkey record", "'s' || l_suppkey spec", "case when l_quantity >= 45 then 's' || l_partkey when l_quantity = 44 then 'n' || (l_partkey % 25) end provider",
        "'s' || l_suppkey consumer", "'q' || (l_partkey % 97) port", "if(l_tax < 0.02, 'fixed', 'selectable') mode",
    )
    real = specs.select(F.col("spec").alias("provider")).distinct().withColumn("_there", F.lit(True))
    connections = connections.join(real, "provider", "left").withColumn("provider", F.when(F.col("_there"), F.col("provider"))).drop("_there")  # others name no node
    focus = specs.where(F.col("kind").isin(topology.OWNERS)).select(F.col("spec").alias("focus"))
    found = topology.admitted(specs, parts, instances, describes, connections, focus)
    return found, connections, topology.boundaries(found, connections)


def topology_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each board, soc and chip admits."""
    return _topology(spark, sf_dir)[0]


def topology_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections that leave a context, by focus and node."""
    return _topology(spark, sf_dir)[2].groupBy("focus", "side", "node").agg(F.countDistinct("record").alias("connections"))


def topology_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots with several fixed connections, or with fixed and selectable ones, in each context."""
    found, connections, outside = _topology(spark, sf_dir)
    return topology.crowded(found, connections, outside)


_TOPOLOGY = """sp AS (SELECT 'n' || n_nationkey AS spec, 'board' AS kind FROM nation UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'soc' ELSE 'chip' END FROM supplier
  UNION ALL SELECT 'r' || r_regionkey, 'ip' FROM region UNION ALL SELECT 'c' || c_custkey, 'peripheral' FROM customer),
cn AS (SELECT 'o' || l_orderkey || ':' || l_partkey AS record, 's' || l_suppkey AS spec, p.spec AS provider, 's' || l_suppkey AS consumer, 'q' || (l_partkey % 97) AS port, CASE WHEN l_tax < 0.02 THEN 'fixed' ELSE 'selectable' END AS mode
  FROM lineitem LEFT JOIN sp p ON p.spec = CASE WHEN l_quantity >= 45 THEN 's' || l_partkey WHEN l_quantity = 44 THEN 'n' || (l_partkey % 25) END WHERE l_linenumber = 1),
f AS (SELECT spec AS focus FROM sp WHERE kind IN ('board', 'soc', 'chip')),
co AS (SELECT focus, focus AS spec FROM f UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0),
st AS (SELECT * FROM co UNION SELECT focus, 'r' || n_regionkey FROM co JOIN nation ON spec = 'n' || n_nationkey UNION SELECT focus, 'c' || c_custkey FROM co JOIN customer ON spec = 's' || c_custkey),
li AS (SELECT DISTINCT cn.spec, provider AS node FROM cn JOIN sp ON sp.spec = provider AND sp.kind IN ('soc', 'chip')),
ad AS (SELECT * FROM st UNION SELECT ad.focus, li.node FROM ad JOIN li ON li.spec = ad.spec),
bo AS (SELECT ad.focus, record, provider AS node FROM ad JOIN cn ON cn.spec = ad.spec WHERE provider IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ad o WHERE o.focus = ad.focus AND o.spec = provider))"""
TOPOLOGY_OWNERS = f"WITH RECURSIVE {_TOPOLOGY} SELECT focus, spec FROM ad"
TOPOLOGY_BOUNDARIES = f"WITH RECURSIVE {_TOPOLOGY} SELECT focus, 'provider' AS side, node, count(DISTINCT record) AS connections FROM bo GROUP BY 1, 2, 3"
TOPOLOGY_SLOTS = f"""
WITH RECURSIVE {_TOPOLOGY}
SELECT ad.focus, consumer, port, count(*) FILTER (WHERE mode = 'fixed') AS n_fixed, count(*) AS n FROM ad JOIN cn ON cn.spec = ad.spec
WHERE NOT EXISTS (SELECT 1 FROM bo WHERE bo.focus = ad.focus AND bo.record = cn.record) GROUP BY 1, 2, 3 HAVING n_fixed > 1 OR n_fixed > 0 AND n > 1"""


def tree_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an order's document first differs from the one without its returned lines; orders without lines have none."""
    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("qty"))
    whole = F.array_sort(F.collect_list(F.struct(*keys, line.alias("of"), (F.col("l_returnflag") == "R").alias("back"))))
    orders = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(whole.alias("x"))
    tree = lambda rows: F.parse_json(F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.transform(rows, lambda r: r["of"]).alias("lines"))))
    kept = F.filter("x", lambda r: ~r["back"])
    return trees.first_difference(orders.select("o_orderkey", tree(F.col("x")).alias("expected"), tree(kept).alias("actual")), "o_orderkey", "expected", "actual")


TREE_DIFFERENCE = """
WITH o AS (SELECT l_orderkey AS o_orderkey, list({line: l_linenumber, part: l_partkey, qty: CAST(l_quantity AS INT)} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS e,
  coalesce(list({line: l_linenumber, part: l_partkey, qty: CAST(l_quantity AS INT)} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) FILTER (WHERE l_returnflag <> 'R'), []) AS a FROM lineitem GROUP BY 1),
d AS (SELECT *, list_filter(range(1, len(e) + 1), lambda i: e[i] IS DISTINCT FROM a[i])[1] AS i FROM o)
SELECT o_orderkey, CASE WHEN i IS NULL THEN NULL WHEN i > len(a) THEN '.lines[' || (i - 1) || ']'
  ELSE '.lines[' || (i - 1) || '].' || CASE WHEN e[i].line <> a[i].line THEN 'line' WHEN e[i].part <> a[i].part THEN 'part' ELSE 'qty' END END AS at FROM d"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of doubtful quantity, discount or tax as findings in their order's file; a root is a part's size."""
    kinds = "filter(array(if(l_quantity > 45, struct('error' as level, 'large' as code, 'quantity ' || cast(l_quantity as int) as message), null), if(l_discount = 0.1, struct('warning' as level, 'cheap' as code, 'discount' as message), null), if(l_tax = 0.08, struct('warning' as level, 'taxed' as code, 'discount' as message), null)), x -> x is not null)"
    return table(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey % 50 as int) root", "'o' || l_orderkey path", "if(l_linenumber = 7, null, l_linenumber) line", "cast(l_partkey % 3 as int) col", f"inline({kinds})")


def finding_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of each root, with those that have none."""
    roots = spark.range(0, 51).select(F.col("id").cast("int").alias("root"))
    return findings.tallies(_findings(spark, sf_dir), roots)


def finding_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five findings of each code in each root, and how many more there are."""
    return findings.details(_findings(spark, sf_dir)).select("root", "code", "n", F.array_join("details", "; ").alias("details"))


_FINDINGS = """a AS (SELECT CAST(l_suppkey % 50 AS INT) AS root, 'o' || l_orderkey AS path, CASE WHEN l_linenumber <> 7 THEN l_linenumber END AS line, CAST(l_partkey % 3 AS INT) AS col,
  unnest(list_filter([CASE WHEN l_quantity > 45 THEN {level: 'error', code: 'large', message: 'quantity ' || CAST(l_quantity AS INT)} END, CASE WHEN l_discount = 0.1 THEN {level: 'warning', code: 'cheap', message: 'discount'} END,
  CASE WHEN l_tax = 0.08 THEN {level: 'warning', code: 'taxed', message: 'discount'} END], lambda x: x IS NOT NULL)) AS f FROM lineitem),
f AS (SELECT root, path, line, col, f.level AS level, f.message AS message, min(f.code) AS code FROM a GROUP BY ALL)"""
FINDING_TALLIES = f"""
WITH {_FINDINGS}
SELECT CAST(r AS INT) AS root, count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warning') AS warnings, count(*) FILTER (WHERE level = 'error') = 0 AS passed FROM range(0, 51) x(r) LEFT JOIN f ON f.root = r GROUP BY 1"""
FINDING_DETAILS = f"""
WITH {_FINDINGS},
k AS (SELECT *, row_number() OVER (PARTITION BY root, code ORDER BY path, line NULLS FIRST, col, message, level) AS k, count(*) OVER (PARTITION BY root, code) AS n FROM f)
SELECT root, code, any_value(n) AS n, string_agg(path || ':' || coalesce(CAST(line AS VARCHAR), '-') || ':' || message, '; ' ORDER BY k) FILTER (WHERE k <= 5) || CASE WHEN any_value(n) > 5 THEN '; and ' || (any_value(n) - 5) || ' more' ELSE '' END AS details FROM k GROUP BY 1, 2"""


def corpus_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a ledger's rows, by whether the order they name is there; a summary for each root, which is a brand."""
    target = "'o' || (p_partkey * 7)"
    ledger = table(spark, sf_dir, "part").selectExpr("p_brand root", "if(p_size % 2 = 0, 'documents', 'blocks') grp", "'p' || p_partkey name", f"case p_partkey % 4 when 0 then 'planned: later' when 1 then 'excluded: no' else 'spec:' || {target} end disposition")
    orders = table(spark, sf_dir, "orders").selectExpr("'o' || o_orderkey target", "o_orderkey")
    parts = table(spark, sf_dir, "part").selectExpr("p_brand root", f"{target} target", "p_size")
    return findings.summaries(findings.coverage(ledger, parts.where("p_size % 5 <> 0").join(orders, "target")))


CORPUS_COVERAGE = """
WITH l AS (SELECT p_brand AS root, CASE WHEN p_size % 2 = 0 THEN 'documents' ELSE 'blocks' END AS grp, CASE p_partkey % 4 WHEN 0 THEN 'planned' WHEN 1 THEN 'excluded' ELSE CASE WHEN p_size % 5 <> 0 AND o_orderkey IS NOT NULL THEN 'spec' ELSE 'unresolved' END END AS state
  FROM part LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders) ON o_orderkey = p_partkey * 7),
c AS (SELECT r.root, g.grp, count(*) FILTER (WHERE state = 'spec') || ' spec, ' || count(*) FILTER (WHERE state = 'planned') || ' planned, ' || count(*) FILTER (WHERE state = 'excluded') || ' excluded'
  || CASE WHEN count(*) FILTER (WHERE state = 'unresolved') > 0 THEN ', ' || count(*) FILTER (WHERE state = 'unresolved') || ' unresolved' ELSE '' END AS told
  FROM (SELECT DISTINCT root FROM l) r CROSS JOIN (VALUES ('documents'), ('blocks')) g(grp) LEFT JOIN l ON l.root = r.root AND l.grp = g.grp GROUP BY 1, 2)
SELECT root, 'documents ' || max(told) FILTER (WHERE grp = 'documents') || '; blocks ' || max(told) FILTER (WHERE grp = 'blocks') AS summary FROM c GROUP BY 1"""


def revision_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as campaigns, their orders' keys as revisions."""
    return history.revisions(table(spark, sf_dir, "orders").selectExpr("o_custkey campaign", "if(o_orderstatus = 'P' and o_orderkey % 3 = 0, null, cast(o_orderkey % 17 as int)) revision"))


REVISION_GAPS = """
WITH r AS (SELECT o_custkey AS campaign, CASE WHEN NOT (o_orderstatus = 'P' AND o_orderkey % 3 = 0) THEN o_orderkey % 17 END AS revision, count(*) AS n FROM orders GROUP BY 1, 2),
g AS (SELECT campaign, x AS missing FROM (SELECT campaign, max(revision) AS top FROM r GROUP BY 1) m, range(1, 17) t(x) WHERE x < top AND NOT EXISTS (SELECT 1 FROM r WHERE r.campaign = m.campaign AND revision = x)),
i AS (SELECT campaign, missing, missing - row_number() OVER (PARTITION BY campaign ORDER BY missing) AS island FROM g)
SELECT campaign, 'repeated' AS problem, CAST(revision AS VARCHAR) AS item FROM r WHERE n > 1 AND revision IS NOT NULL UNION ALL SELECT campaign, 'unnumbered', CAST(n AS VARCHAR) FROM r WHERE revision IS NULL
UNION ALL SELECT campaign, 'early', CAST(revision AS VARCHAR) FROM r WHERE revision < 1 UNION ALL SELECT campaign, 'missing', min(missing) || '-' || max(missing) FROM i GROUP BY campaign, island"""


def reading_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as readings of their customer's campaign, lines as slices, and customers' first suppliers as sections."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    slices = lines.selectExpr("o_custkey campaign", "o_orderkey reading", "l_linenumber slice", "l_suppkey % 5 section")
    return history.covers(slices, lines.where("l_linenumber = 1").selectExpr("o_custkey campaign", "l_suppkey % 5 section"))


READING_SLICES = """
WITH l AS (SELECT o_custkey AS campaign, o_orderkey AS reading, l_linenumber AS slice, l_suppkey % 5 AS section FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT DISTINCT campaign, section FROM l WHERE slice = 1), o AS (SELECT campaign, reading, section, count(DISTINCT slice) AS n FROM l GROUP BY 1, 2, 3)
SELECT o.campaign, reading, CASE WHEN s.section IS NULL THEN 'unknown' ELSE 'repeated' END AS problem, o.section AS item FROM o LEFT JOIN s ON s.campaign = o.campaign AND s.section = o.section WHERE s.section IS NULL OR n > 1
UNION ALL SELECT r.campaign, r.reading, 'uncovered', s.section FROM (SELECT DISTINCT campaign, reading FROM l) r JOIN s ON s.campaign = r.campaign WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.reading = r.reading AND o.section = s.section)"""

QUERIES = {f.__name__: f for f in (ledger_sweep, topology_owners, topology_boundaries, topology_slots, tree_difference, finding_tallies, finding_details, corpus_coverage, revision_gaps, reading_slices)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
