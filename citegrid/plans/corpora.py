"""Queries over a corpus of fact files made of orders: a file for each order, a fact for each of its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.lineage import written
from citegrid.operators import citations, composition, references
from citegrid.sources import corpus
from citegrid.tables import table

#: Priorities as roots, in the order of their layers.
ROOTS = ["urgent", "high", "medium", "not-specified", "low"]
LICENCES = ["MIT", "Apache-2.0", "GPL-2.0-only", "BSD-2-Clause"]
# orders' priorities are told apart by their digit.
ROOT = f"element_at(array({', '.join(repr(r) for r in ROOTS)}), cast(substring(o_orderpriority, 1, 1) as int))"


def _ref(x: Column) -> Column:
    """What a line refers to, by its number: a line of its own order, the first line of another one, or that in a stated root."""
    other = F.concat(F.lit("o"), x["l_partkey"])
    root = F.element_at(F.array(*map(F.lit, ROOTS)), (x["l_suppkey"] % 5).cast("int") + 1)
    own = F.concat(F.lit("#l"), x["l_suppkey"] % 7 + 1)
    return F.when(x["l_linenumber"] % 3 == 1, own).when(x["l_linenumber"] % 3 == 2, F.concat(other, F.lit("#l1"))).otherwise(F.concat(other, F.lit("@"), root, F.lit("#l1")))



#: Lines of an order stand in this order, as some have one number.
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, path, spec, record): a file's lines are those of one order, seven at most. Lines are gathered as they are, as what is made of them is longer."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.expr(ROOT).alias("root"))
    columns = [*ORDER, "l_returnflag", "l_linestatus", "l_tax", "l_discount"]
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("lines"))

    def parts(x: Column) -> Column:
        text = lambda mark, column: F.concat(F.lit(mark), x[column])
        return F.struct(x.alias("line"), _ref(x).alias("ref"), F.struct(text("s", "l_suppkey").alias("repo"), text("p", "l_partkey").alias("path")).alias("anchor"))

    def fact(part: Column) -> Column:
        x, ref, anchor = part["line"], part["ref"], part["anchor"]
        has = lambda flag: x["l_returnflag"] == flag
        text = lambda mark, column: F.concat(F.lit(mark), x[column])
        support = F.struct(
            F.when(has("A"), "src").when(has("R"), "inference").otherwise("databook").alias("class"),
            F.when(has("A"), F.array(anchor)).alias("anchors"),
            F.when(has("R"), F.array(F.struct(ref.alias("fact")), F.struct(ref.alias("fact")))).alias("premises"),
            F.when(has("N"), text("d", "l_suppkey")).alias("doc"),
        )
        return F.struct(
            text("l", "l_linenumber").alias("id"),
            (x["l_quantity"] >= 40).alias("critical"),
            F.array(support).alias("support"),
            F.when(x["l_linestatus"] == "O", F.array(F.struct(F.lit("refines").alias("relation"), ref.alias("fact")))).alias("relates"),
            F.when(x["l_tax"] == 0, F.struct(F.array(F.struct(F.lit("emulated").alias("class"), F.concat(F.lit("o"), x["l_partkey"], F.lit("#l1")).alias("observation"))).alias("settled_by"))).alias("conflict"),
            F.when(x["l_discount"] == 0, F.struct(F.struct(F.array(anchor).alias("impl")).alias("pair"))).alias("data"),
        )

    def document(x: Column) -> Column:
        return F.struct(F.concat(F.lit("d"), x["l_suppkey"]).alias("name"), F.when(x["l_tax"] == 0.02, "standard").otherwise("databook").alias("class"), F.when(x["l_discount"] == 0.1, False).alias("cite"))

    def repo(x: Column) -> Column:
        licence = F.get(F.array(*map(F.lit, LICENCES)), (x["l_suppkey"] % len(LICENCES)).cast("int"))
        return F.struct(F.concat(F.lit("s"), x["l_suppkey"]).alias("name"), licence.alias("license"), F.when(x["l_linenumber"] % 2 == 1, F.array(F.concat(F.lit("p"), x["l_partkey"]))).alias("files"))

    listed = lambda flag: F.filter("lines", lambda x: (x["l_suppkey"] % 3 != 0) & (x["l_returnflag"] == flag))
    spec = F.concat(F.lit("o"), "key")
    resources = F.struct(F.transform(listed("N"), document).alias("documents"), F.transform(listed("A"), repo).alias("repos"))
    record = F.to_json(F.struct(spec.alias("id"), F.transform(F.transform("lines", parts), fact).alias("facts"), resources.alias("resources")))
    return orders.join(by, "key").select("root", F.concat(spec, F.lit(".spec.yaml")).alias("path"), spec.alias("spec"), record.alias("record"))


def _roots(spark: SparkSession) -> DataFrame:
    """One root for each layer; the last can't be read whole."""
    rows = [(name, layer, rank, rank != len(ROOTS) - 1) for rank, (name, layer) in enumerate(zip(ROOTS, corpus.LAYERS, strict=True))]
    return spark.createDataFrame(rows, "name string, layer string, rank int, trusted boolean")


_ROOT_LIST = "['" + "', '".join(ROOTS) + "']"
_LINES = f"""l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(ORDER)}) AS nth, row_number() OVER (ORDER BY {', '.join(ORDER)}) AS rank, {_ROOT_LIST}[CAST(left(o_orderpriority, 1) AS INT)] AS root, 'o' || l_orderkey AS spec, 'l' || l_linenumber AS name,
  CASE l_linenumber % 3 WHEN 1 THEN '#l' || (l_suppkey % 7 + 1) WHEN 2 THEN 'o' || l_partkey || '#l1' ELSE 'o' || l_partkey || '@' || {_ROOT_LIST}[1 + l_suppkey % 5] || '#l1' END AS ref
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey), k AS (SELECT * FROM l WHERE nth = 1)"""


def corpus_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files list, with how often a name is listed in its file."""
    return corpus.entries(specs(spark, sf_dir)).select("root", "spec", "family", F.col("ord").cast("long").alias("ord"), "name", "copies", F.coalesce(corpus.has_support(F.col("data")), F.lit(False)).alias("supported"))


CORPUS_ENTRIES = f"""
WITH {_LINES},
e AS (SELECT root, spec, 'fact' AS family, rank AS k, name, true AS supported FROM l
  UNION ALL SELECT root, spec, 'document', rank, 'd' || l_suppkey, false FROM l WHERE l_suppkey % 3 <> 0 AND l_returnflag = 'N'
  UNION ALL SELECT root, spec, 'repo', rank, 's' || l_suppkey, false FROM l WHERE l_suppkey % 3 <> 0 AND l_returnflag = 'A')
SELECT root, spec, family, row_number() OVER (PARTITION BY spec, family ORDER BY k) - 1 AS ord, name, count(*) OVER (PARTITION BY spec, family, name) AS copies, supported FROM e"""


def corpus_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support at any depth of the facts, and the sides of their pairs."""
    return corpus.supports(corpus.entries(specs(spark, sf_dir))).select("root", "spec", "name", "at", "class")


CORPUS_SUPPORTS = f"""
WITH {_LINES}
SELECT root, spec, name, '.support[0]' AS at, CASE l_returnflag WHEN 'A' THEN 'src' WHEN 'R' THEN 'inference' ELSE 'databook' END AS class FROM k
UNION ALL SELECT root, spec, name, '.conflict.settled_by[0]', 'emulated' FROM k WHERE l_tax = 0
UNION ALL SELECT root, spec, name, '.data.pair.impl', 'src' FROM k WHERE l_discount = 0"""


def anchor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors whose file isn't one of those that their file lists for the repository."""
    entries = corpus.entries(specs(spark, sf_dir))
    repos = entries.where("family = 'repo'").select(F.col("path").alias("file"), "name", F.try_variant_get("data", "$.files", "array<string>").alias("files"))
    found = corpus.anchors(corpus.supports(entries)).select(F.col("path").alias("file"), "spec", "name", "at", "repo", F.col("file").alias("path"))
    return citations.anchored(found, repos).where("problem is not null").select("spec", "name", "at", "repo", F.col("path").alias("cited"), "problem")


_REPOS = "r AS (SELECT spec, 's' || l_suppkey AS repo, count(*) AS n, max(CASE WHEN l_linenumber % 2 = 1 THEN 'p' || l_partkey END) AS file FROM l WHERE l_suppkey % 3 <> 0 AND l_returnflag = 'A' GROUP BY 1, 2)"
ANCHOR_FILES = f"""
WITH {_LINES}, {_REPOS},
a AS (SELECT spec, name, '.support[0].anchors[0]' AS at, 's' || l_suppkey AS repo, 'p' || l_partkey AS cited FROM k WHERE l_returnflag = 'A'
  UNION ALL SELECT spec, name, '.data.pair.impl[0]', 's' || l_suppkey, 'p' || l_partkey FROM k WHERE l_discount = 0),
p AS (SELECT a.*, CASE WHEN n IS NULL THEN 'unlisted-repo' WHEN n > 1 THEN 'twice-listed' WHEN file <> cited THEN 'unlisted-path' END AS problem FROM a LEFT JOIN r ON r.spec = a.spec AND r.repo = a.repo)
SELECT * FROM p WHERE problem IS NOT NULL"""


def doc_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of documents that their file doesn't declare once, with that class, and as citable."""
    entries = corpus.entries(specs(spark, sf_dir))
    documents = entries.where("family = 'document'").select(F.col("path").alias("file"), "name", F.try_variant_get("data", "$.class", "string").alias("class"), F.try_variant_get("data", "$.cite", "boolean").alias("cite"))
    cited = corpus.supports(entries).select(F.col("path").alias("file"), "spec", "name", "at", F.try_variant_get("entry", "$.doc", "string").alias("doc"), "class").where("doc is not null")
    return citations.declared(cited, documents).where("problem is not null").select("spec", "name", "at", "doc", "problem")


DOC_CITATIONS = f"""
WITH {_LINES},
d AS (SELECT spec, 'd' || l_suppkey AS doc, count(*) AS n, min(CASE WHEN l_tax = 0.02 THEN 'standard' ELSE 'databook' END) AS class, min(CASE WHEN l_discount = 0.1 THEN 0 ELSE 1 END) AS cite FROM l WHERE l_suppkey % 3 <> 0 AND l_returnflag = 'N' GROUP BY 1, 2),
c AS (SELECT l.spec, name, '.support[0]' AS at, 'd' || l_suppkey AS doc, CASE WHEN n IS NULL THEN 'undeclared' WHEN n > 1 THEN 'twice-declared' WHEN class <> 'databook' THEN 'other-class' WHEN cite = 0 THEN 'not-citable' END AS problem
  FROM k l LEFT JOIN d ON d.spec = l.spec AND d.doc = 'd' || l_suppkey WHERE l_returnflag = 'N')
SELECT * FROM c WHERE problem IS NOT NULL"""


def _gathered(spark: SparkSession, sf_dir: str, *, sources: bool = False) -> DataFrame:
    """The files' facts and references, written once, as names and references are both read of them."""
    return written(corpus.gathered(specs(spark, sf_dir), sources=sources), "gathered")


def _resolved(files: DataFrame, roots: DataFrame) -> DataFrame:
    return references.resolve(corpus.mentioned(files), corpus.named(files), roots)


def reference_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with what they resolve to in their file, their root or another root."""
    found = _resolved(_gathered(spark, sf_dir), _roots(spark))
    return found.select("root", "spec", "name", "kind", "at", "ref", "status", "to_root", "to_spec", "to_fact")


_REFS = f"""{_LINES},
f AS (SELECT root, spec, name, 'premise' AS kind, '.support[0].premises[' || i || '].fact' AS at, ref, i AS nth FROM k, (VALUES (0), (1)) v(i) WHERE l_returnflag = 'R'
  UNION ALL SELECT root, spec, name, 'relates', '.relates[0].fact', ref, 0 FROM k WHERE l_linestatus = 'O'
  UNION ALL SELECT root, spec, name, 'observation', '.conflict.settled_by[0].observation', 'o' || l_partkey || '#l1', 0 FROM k WHERE l_tax = 0),
q AS (SELECT f.*, coalesce(nullif(split_part(ref, '#', 2), ''), '') AS fact, CASE WHEN ref LIKE '#%' THEN spec ELSE split_part(split_part(ref, '#', 1), '@', 1) END AS q_spec, CASE WHEN ref LIKE '%@%' THEN split_part(split_part(ref, '#', 1), '@', 2) ELSE root END AS q_root FROM f),
h AS (SELECT root, spec, name, count(*) AS n FROM l GROUP BY 1, 2, 3),
s AS (SELECT q.root, q.spec, q.name, q.kind, q."at", q.ref, nth, CASE WHEN q.ref LIKE '%@low#%' AND q.root <> 'low' THEN 'untrusted' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status,
  h.root AS l_root, h.spec AS l_spec, h.name AS l_name FROM q LEFT JOIN h ON h.spec = q_spec AND h.root = q_root AND h.name = fact),
x AS (SELECT root, spec, name, kind, "at", ref, nth, status, CASE WHEN status = 'ok' THEN l_root END AS to_root, CASE WHEN status = 'ok' THEN l_spec END AS to_spec, CASE WHEN status = 'ok' THEN l_name END AS to_fact FROM s)"""
REFERENCE_SCOPES = f"WITH {_REFS} SELECT x.* EXCLUDE (nth) FROM x"


def reference_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that break a rule, by rule."""
    found = _resolved(_gathered(spark, sf_dir), _roots(spark))
    return references.rules(found, _roots(spark)).select("root", F.substring_index("path", ".", 1).alias("spec"), "name", "kind", "at", "ref", "rule")


REFERENCE_RULES = f"""
WITH {_REFS}
SELECT root, spec, name, kind, "at", ref, unnest(list_filter([CASE WHEN status <> 'ok' THEN status END, CASE WHEN status = 'ok' AND nth > 0 THEN 'repeated' END,
  CASE WHEN status = 'ok' AND kind <> 'premise' AND to_spec = spec AND to_fact = name THEN 'self' END,
  CASE WHEN status = 'ok' AND list_position({_ROOT_LIST}, to_root) > list_position({_ROOT_LIST}, root) THEN 'later-layer' END], lambda r: r IS NOT NULL)) AS rule FROM x"""


def _node(spec: str = "spec", name: str = "name") -> Column:
    return F.concat(spec, F.lit("#"), name)


def layer_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest layer, the licences and the unresolved references behind each fact with a reference, by way of premises and relations."""
    files = _gathered(spark, sf_dir, sources=True)
    # A file says the same once, however often it refers to it.
    said = F.array_distinct(F.transform(F.filter("refs", lambda r: r["kind"] != "observation"), lambda r: F.struct(r["name"].alias("name"), r["ref"].alias("ref"), r["here"].alias("here"))))
    said = files.select("root", "path", "spec", F.inline(said))
    found = references.resolve(said, corpus.named(files), _roots(spark)).select(_node().alias("node"), "status", F.when(F.col("status") == "ok", _node("to_spec", "to_fact")).alias("to_node"))
    found = written(found, "found")
    rank = F.array_position(F.array(*map(F.lit, ROOTS)), F.col("root")).cast("int") - 1
    licence = lambda repo: F.get(F.array(*map(F.lit, LICENCES)), (F.substring(repo, 2, 20).cast("long") % len(LICENCES)).cast("int"))
    own = files.select("spec", rank.alias("low"), F.inline("sources")).select(_node().alias("node"), "low", F.explode_outer("repos").alias("repo")).select("node", "low", licence(F.col("repo")).alias("element"))
    lost = found.where("status <> 'ok'").select("node")
    edges = found.where("status = 'ok'").select(F.col("node").alias("src"), F.col("to_node").alias("dst"))
    reached = references.reach(edges, own, LICENCES, lost)
    return reached.join(found.select("node"), "node", "left_semi").select("node", "low", F.array_join("elements", ",").alias("licences"), "open")


_LICENCES = "['" + "', '".join(LICENCES) + "']"
LAYER_REACH = f"""
WITH RECURSIVE {_REFS},
e AS (SELECT DISTINCT spec || '#' || name AS src, to_spec || '#' || to_fact AS dst FROM x WHERE status = 'ok' AND kind <> 'observation'),
a AS (SELECT DISTINCT spec || '#' || name AS src FROM x WHERE kind <> 'observation'),
r AS (SELECT src, src AS dst FROM a UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst),
n AS (SELECT spec || '#' || name AS node, list_position({_ROOT_LIST}, root) - 1 AS low, CASE WHEN l_returnflag = 'A' OR l_discount = 0 THEN {_LICENCES}[1 + l_suppkey % {len(LICENCES)}] END AS element FROM k),
o AS (SELECT DISTINCT spec || '#' || name AS node FROM x WHERE status <> 'ok' AND kind <> 'observation')
SELECT r.src AS node, CAST(min(low) AS INTEGER) AS low, coalesce(string_agg(DISTINCT element, ',' ORDER BY element), '') AS licences, bool_or(o.node IS NOT NULL) AS open
FROM r JOIN n ON n.node = r.dst LEFT JOIN o ON o.node = r.dst GROUP BY 1"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sections of their brand's document, in the order of their keys."""
    number = F.expr("(p_size % 9 + 1) || if(p_partkey % 4 = 0, '', '.' || (p_partkey % 5 + 1))")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("document"), F.col("p_partkey").cast("int").alias("ord"), (F.col("p_size") % 4 + 1).cast("int").alias("level"), number.alias("number"), F.col("p_name").alias("title"),
        (F.col("p_partkey") % 400).cast("int").alias("begin"), (F.col("p_partkey") % 400 + F.col("p_size") % 13).cast("int").alias("end"),
    )


def section_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as citations, of a number, a title or pages, and how many of them each section has, with its lowest."""
    sections = _sections(spark, sf_dir)
    parts = sections.select(F.col("ord").cast("long").alias("o_custkey"), "document", "title")
    orders = table(spark, sf_dir, "orders").join(parts, "o_custkey")
    kind = F.col("o_orderkey") % 3
    none = F.lit(None).cast("string")
    cited = orders.select(
        F.col("o_orderkey").alias("fact"), "document", F.when(kind == 1, F.upper("title")).otherwise(none).alias("section"),
        F.when(kind == 0, F.expr("(o_orderkey % 11 + 1) || '.' || (o_orderkey % 7 + 1) || '.1'")).alias("number"), F.when(kind == 2, F.when(F.col("o_orderkey") % 2 == 0, F.col("title"))).alias("heading"),
        F.array((F.col("o_orderkey") % 420).cast("int")).alias("pages"),
    )
    return citations.counted(cited, sections)


SECTION_LINKS = """
WITH s AS (SELECT p_brand AS document, CAST(p_partkey AS INT) AS ord, p_size % 4 + 1 AS level, (p_size % 9 + 1) || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '.' || (p_partkey % 5 + 1) END AS number, p_name AS title, p_partkey % 400 AS b, p_partkey % 400 + p_size % 13 AS e FROM part),
c AS (SELECT o_orderkey AS fact, document, o_orderkey % 3 AS k, CASE WHEN o_orderkey % 3 = 1 THEN upper(title) END AS section, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 11 + 1) || '.' || (o_orderkey % 7 + 1) || '.1' END AS number,
  CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 2 = 0 THEN title END AS heading, o_orderkey % 420 AS page FROM orders JOIN s ON s.ord = o_custkey),
a AS (SELECT x.document, x.ord, y.ord AS up FROM s x JOIN s y ON y.document = x.document AND y.ord < x.ord AND y.level < x.level
  WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.document = x.document AND z.ord > y.ord AND z.ord < x.ord AND z.level <= y.level)),
n AS (SELECT DISTINCT fact, c.document, s.ord FROM c JOIN s ON s.document = c.document AND (c.number = s.number OR starts_with(c.number, s.number || '.') OR lower(s.title) = lower(c.section) OR s.title = c.heading)),
p AS (SELECT fact, c.document, page, s.ord, level, b, max(CASE WHEN b = page THEN level END) OVER (PARTITION BY fact) AS deepest FROM c JOIN s ON s.document = c.document AND page BETWEEN b AND e WHERE fact NOT IN (SELECT fact FROM n)),
d AS (SELECT * FROM p WHERE b = page AND level = deepest),
h AS (SELECT fact, document, ord FROM n UNION SELECT n.fact, n.document, up FROM n JOIN a ON a.document = n.document AND a.ord = n.ord
  UNION SELECT fact, document, ord FROM p WHERE deepest IS NULL UNION SELECT fact, document, ord FROM d
  UNION SELECT d.fact, d.document, a.up FROM d JOIN a ON a.document = d.document AND a.ord = d.ord JOIN p ON p.fact = d.fact AND p.ord = a.up)
SELECT document, ord, count(*) AS facts, min(fact) AS first_fact FROM h GROUP BY 1, 2"""

KINDS = ["board", "soc", "chip", "ip", "peripheral"]
RELATIONS = ["parts", "variant_of", "instance", "describes", "overlays"]
_KINDS = "array('" + "', '".join(KINDS) + "')"
_RELATIONS = "array('" + "', '".join(RELATIONS) + "')"


def spec_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as specs, lines as their links to other parts; which links break the rules of their relation, and how often."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    again = part.where("p_partkey % 50 = 7")  # two base files
    specs = part.union(again).selectExpr("'p' || p_partkey spec", f"element_at({_KINDS}, cast(p_size % 5 as int) + 1) kind", "cast(p_partkey % 5 as int) rank", "cast(array() as array<string>) aliases")
    links = lines.selectExpr("'p' || l_partkey spec", f"element_at({_RELATIONS}, cast(l_linenumber % 5 as int) + 1) relation", "'p' || (l_partkey + l_suppkey % 9 * cast(l_quantity as int)) target")
    return composition.broken(links, specs).groupBy("relation", "problem").agg(F.count("*").alias("links"), F.min("spec").alias("first_spec"), F.max("target").alias("last_target"))


SPEC_LINKS = f"""
WITH s AS (SELECT 'p' || p_partkey AS spec, ['{"', '".join(KINDS)}'][1 + p_size % 5] AS kind, p_partkey % 5 AS rank, CASE WHEN p_partkey % 50 = 7 THEN 2 ELSE 1 END AS n FROM part),
l AS (SELECT DISTINCT 'p' || l_partkey AS spec, ['{"', '".join(RELATIONS)}'][1 + l_linenumber % 5] AS relation, 'p' || (l_partkey + l_suppkey % 9 * CAST(l_quantity AS INT)) AS target FROM lineitem),
j AS (SELECT l.*, o.kind, o.rank, t.n AS to_n, t.kind AS to_kind, t.rank AS to_rank FROM l LEFT JOIN s o ON o.spec = l.spec LEFT JOIN s t ON t.spec = l.target),
b AS (SELECT *, unnest(list_filter([CASE WHEN to_n IS NULL THEN 'dangling' END, CASE WHEN to_n > 1 THEN 'ambiguous' END, CASE WHEN spec = target THEN 'self' END,
  CASE WHEN relation IN ('parts', 'instance') AND coalesce(kind, '') NOT IN ('board', 'soc', 'chip') OR relation = 'describes' AND coalesce(kind, '') <> 'peripheral' THEN 'from-kind' END,
  CASE WHEN to_n = 1 AND (relation IN ('parts', 'variant_of', 'describes') AND to_kind NOT IN ('board', 'soc', 'chip') OR relation = 'instance' AND to_kind NOT IN ('ip', 'peripheral')) THEN 'to-kind' END,
  CASE WHEN to_n = 1 AND relation IN ('describes', 'overlays') AND to_rank > rank THEN 'later-layer' END], lambda x: x IS NOT NULL)) AS problem FROM j)
SELECT relation, problem, count(*) AS links, min(spec) AS first_spec, max(target) AS last_target FROM b GROUP BY 1, 2"""


def name_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as specs with the first words of their names and their brands as aliases: names that several own."""
    specs = table(spark, sf_dir, "part").selectExpr("'p' || p_partkey spec", "'ip' kind", "0 rank", "array(p_name, p_brand || '-' || p_size || '-' || (p_partkey % 40)) aliases")
    return composition.clashes(specs).select("name", F.array_join("owners", ",").alias("owners"))


NAME_CLASHES = """
WITH n AS (SELECT DISTINCT 'p' || p_partkey AS spec, unnest(['p' || p_partkey, p_name, p_brand || '-' || p_size || '-' || (p_partkey % 40)]) AS name FROM part)
SELECT name, string_agg(spec, ',' ORDER BY spec) AS owners FROM n WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) > 1"""

QUERIES = {f.__name__: f for f in (corpus_entries, corpus_supports, anchor_files, doc_citations, reference_scopes, reference_rules, layer_reach, section_links, spec_links, name_clashes)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
