"""Text queries over documents, pages and the benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.functions import spdx, texts
from citegrid.lineage import cut
from citegrid.operators import headings, robots
from citegrid.tables import table

LICENSES = (("apache-2.0", "Apache License"), ("mit", "MIT License"), ("gpl-3.0", "GNU General Public License"), ("cc-by-nc-4.0", "CC BY-NC"))
ACCEPTED = ("apache-2.0", "mit")


def _noted() -> Column:
    return F.array_compact(F.array(*[F.when(F.col("text").contains(mark), F.lit(name)) for name, mark in LICENSES]))


NOTED = "list_filter([" + ", ".join(f"CASE WHEN contains(text, '{mark}') THEN '{name}' END" for name, mark in LICENSES) + "], lambda x: x IS NOT NULL)"


def license_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and by whether all licences they note are accepted; none noted is refused."""
    docs = table(spark, sf_dir, "documents").select("source", _noted().alias("noted"))
    # Few distinct expressions, so they are counted before they are read.
    counted = docs.groupBy("source", F.array_join("noted", " AND ").alias("expression"), (F.size("noted") > 1).alias("several")).agg(F.count("*").alias("docs"))
    ok = spdx.accepts(F.col("expression"), ACCEPTED)
    judged = counted.select("source", ok.alias("accepted"), "docs", F.when(F.col("several"), F.col("docs")).otherwise(0).alias("several"))
    return judged.groupBy("source", "accepted").agg(F.sum("docs").alias("docs"), F.sum("several").alias("several"))


LICENSE_GATE = f"""
WITH d AS (SELECT source, coalesce({NOTED}, []) AS noted FROM documents)
SELECT source, len(noted) > 0 AND len(list_filter(noted, lambda x: x NOT IN ('apache-2.0', 'mit'))) = 0 AS accepted, count(*) AS docs, count(*) FILTER (WHERE len(noted) > 1) AS several
FROM d GROUP BY 1, 2"""


def notice_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("All rights reserved|[Ll]icensed under|Released under")).alias("n"))
    state = F.when(F.col("n") == 0, "none-found").when(F.col("n") == 1, "recorded").otherwise("ambiguous")
    return docs.select("doc_id", state.alias("state"), F.col("n").cast("long").alias("notices"))


NOTICE_SCAN = """
WITH d AS (SELECT doc_id, len(regexp_extract_all(text, 'All rights reserved|[Ll]icensed under|Released under')) AS n FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN 'none-found' WHEN n = 1 THEN 'recorded' ELSE 'ambiguous' END AS state, CAST(n AS BIGINT) AS notices FROM d"""


def prose_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with long hexadecimal runs or numbers of four digits and more, by line number."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    tokens = F.regexp_extract_all("words", F.lit("([0-9a-f]{16,}|[0-9]{4,})"), 1)
    rows = lines.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), tokens.alias("tokens")).where(F.size("tokens") > 0)
    return rows.select("doc_id", "line", F.size("tokens").cast("long").alias("n"), F.array_min("tokens").alias("first_token"))


PROSE_FACTS = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS words, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
t AS (SELECT doc_id, line, regexp_extract_all(words, '([0-9a-f]{16,}|[0-9]{4,})') AS tokens FROM l)
SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(len(tokens) AS BIGINT) AS n, list_min(tokens) AS first_token FROM t WHERE len(tokens) > 0"""


def claim_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items and the documents that hold at least nine tenths of their identifiers; rows of one id count as one.

    Identifiers are joined, rare ones first: a document must hold one of the item's rarest tenth and one more, so
    common identifiers never meet in the join that makes the pairs.
    """
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    wanted = items.select("item_id", F.explode(texts.identifiers(F.col("text"))).alias("id")).distinct()
    held = docs.select("doc_id", texts.identifiers(F.col("text")).alias("ids")).select("doc_id", F.explode_outer("ids").alias("id"))
    held = cut(held.join(wanted.select("id").distinct(), "id", "left_semi").distinct())
    df = held.groupBy("id").agg(F.count("*").alias("df"))
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "id")))
    ranked = wanted.join(df, "id", "left").groupBy("item_id").agg(order.alias("o"), F.count("*").alias("n"))
    probes = ranked.select("item_id", "n", F.col("o.id").alias("ids"), F.explode(F.slice("o.id", 1, (F.col("n") - F.ceil(F.col("n") * 9 / 10)).cast("int") + 1)).alias("id"))
    pairs = probes.join(held, "id").select("item_id", "n", "ids", "doc_id").distinct()
    kept = held.groupBy("doc_id").agg(F.collect_list("id").alias("held")).withColumnRenamed("doc_id", "_doc")
    both = pairs.join(kept, F.col("doc_id").eqNullSafe(F.col("_doc")))
    found = both.select("item_id", "doc_id", F.size(F.array_intersect("ids", "held")).cast("long").alias("found"), F.col("n").alias("wanted"))
    return found.where("found * 10 >= wanted * 9")


_STOP = ", ".join(f"'{w}'" for w in texts.STOP_WORDS)
_CAMEL = "regexp_replace(regexp_replace(text, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')"
_IDS = f"list_distinct(list_filter(regexp_split_to_array(translate({_CAMEL}, '{texts.UPPER}', '{texts.LOWER}'), '[^a-z0-9]+'), lambda x: regexp_matches(x, '^[a-z][a-z0-9]{{2,}}$') AND x NOT IN ({_STOP})))"
CLAIM_BINDING = f"""
WITH i AS (SELECT DISTINCT item_id, unnest({_IDS}) AS id FROM benchmark), w AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM i),
s AS (SELECT DISTINCT doc_id, unnest({_IDS}) AS id FROM documents)
SELECT item_id, doc_id, count(*) AS found, CAST(any_value(n) AS BIGINT) AS wanted FROM w JOIN s ON s.id = w.id GROUP BY 1, 2 HAVING count(*) * 10 >= any_value(n) * 9"""


def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(texts.url_key(F.col("url")).alias("url_key"), "page_id")
    return pages.groupBy("url_key").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


URL_NORMALISE = """
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h,
regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS r FROM pages)
SELECT s || '://' || CASE s WHEN 'http' THEN regexp_replace(h, ':80$', '') WHEN 'https' THEN regexp_replace(h, ':443$', '') ELSE h END || CASE r WHEN '' THEN '/' ELSE r END AS url_key,
count(*) AS pages, min(page_id) AS first_page FROM p GROUP BY 1"""


def dedup_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are equal when folded: which document stays, how many go, and the bytes that frees."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(texts.folded(F.col("text")), 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    by = docs.groupBy("digest").agg(F.min(F.struct("doc_id", "size")).alias("first"), F.count("*").alias("n"), F.sum("size").alias("all"))
    return by.select("digest", F.col("first.doc_id").alias("kept"), (F.col("n") - 1).alias("removed"), (F.col("all") - F.col("first.size")).alias("bytes_freed"))


DEDUP_CANONICAL = f"""
WITH d AS (SELECT doc_id, sha256(trim(regexp_replace(translate(text, '{texts.UPPER}', '{texts.LOWER}'), '[ \\t\\n\\r]+', ' ', 'g'), ' ')) AS digest, strlen(text) AS size FROM documents)
SELECT digest, min(doc_id) AS kept, count(*) - 1 AS removed, CAST(sum(size) - min_by(size, doc_id) AS BIGINT) AS bytes_freed FROM d GROUP BY 1"""


#: Words of an item that find its places, and up to how many items are sent to all tasks.
PROBE, MOST_PROBES = 8, 100_000


def _scan_words(text: Column) -> Column:
    return F.array_remove(F.split(texts.ascii_lower(text), "[ \\t\\n\\r]+"), "")


def _runs(n: int) -> Column:
    return F.transform("w", lambda _, i: F.xxhash64(F.array_join(F.slice("w", i + 1, n), " ")))


def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a whole benchmark item, as a run of words with A-Z folded; items without words are in none.

    The first words of an item, eight or all that it has, are joined with the runs of as many words of the documents; then texts are
    compared. Runs are hashed from words that a step before has split: no filter stands on what is derived, as it would go
    down to the scan and split each text again for each of its words.
    """
    items = table(spark, sf_dir, "benchmark").select("item_id", _scan_words(F.col("text")).alias("w"))
    items = items.select("item_id", F.array_join("w", " ").alias("item"), F.slice("w", 1, PROBE).alias("first"))
    items = items.select("item_id", "item", F.size("first").alias("n"), F.xxhash64(F.array_join("first", " ")).alias("probe")).where("n > 0")
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())  # eight at most
    docs = table(spark, sf_dir, "documents").select("doc_id", _scan_words(F.col("text")).alias("w"))
    runs = [_runs(n) for n in lengths]
    probes = docs.select("doc_id", F.explode_outer(F.array_distinct(F.concat(*runs)) if runs else F.array().cast("array<bigint>")).alias("probe"))
    hits = probes.join(F.broadcast(items) if items.count() <= MOST_PROBES else items, "probe").select("doc_id", "item_id", "item").distinct()
    whole = F.concat(F.lit(" "), F.array_join(_scan_words(F.col("text")), " "), F.lit(" "))  # of the texts with hits alone
    texts_ = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_doc"), "text")
    found = hits.join(texts_, F.col("doc_id").eqNullSafe(F.col("_doc"))).where(whole.contains(F.concat(F.lit(" "), "item", F.lit(" "))))
    return found.select("doc_id", "item_id").distinct()


_FOLDED = "' ' || trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\r]+', ' ', 'g'), ' ') || ' '"
LEAK_SCAN = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents), i AS (SELECT item_id, {_FOLDED} AS w FROM benchmark)
SELECT DISTINCT doc_id, item_id FROM d JOIN i ON contains(d.w, i.w) WHERE i.w <> '  '"""


def heading_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the pages with their levels, ends and parents."""
    return headings.sections(headings.of_html(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id")


HEADING_INDEX = """
WITH q AS (SELECT page_id, string_split(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '<h') AS ps FROM pages),
h AS (SELECT page_id, list_filter(ps, lambda x: x[1] IN ('1', '2', '3', '4', '5', '6') AND x[2] IN ('>', ' ') AND contains(array_to_string(ps, '<h'), '</h' || x[1] || '>')) AS ts FROM q),
e AS (SELECT page_id, unnest(ts)[1] AS l, unnest(list_transform(ts, lambda x: regexp_replace(string_split(x, '</h' || x[1] || '>')[1], '^[^>]*>', ''))) AS t, generate_subscripts(ts, 1) - 1 AS ord FROM h),
s AS (SELECT page_id, CAST(ord AS BIGINT) AS ord, CAST(l AS BIGINT) AS level, trim(regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ') AS title FROM e)
SELECT *, (SELECT coalesce(min(n.ord), (SELECT count(*) FROM s c WHERE c.page_id = s.page_id)) FROM s n WHERE n.page_id = s.page_id AND n.ord > s.ord AND n.level <= s.level) AS end_ord,
(SELECT max(n.ord) FROM s n WHERE n.page_id = s.page_id AND n.ord < s.ord AND n.level < s.level) AS parent_ord FROM s"""


def hex_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of parts written as literals of two notations, read back."""
    part = table(spark, sf_dir, "part")
    claim = F.concat("p_name", F.lit(" at 0x"), F.hex("p_partkey"), F.lit("uLL, mask 0X00_0"), F.hex("p_size"), F.lit(" or "), F.hex("p_size"), F.lit("h; not x0x1 0x or 12hz"))
    values = texts.hex_values(claim)
    return part.select("p_partkey", F.array_join(values.cast("array<string>"), ",").alias("found"), F.size(values).cast("long").alias("n"))


HEX_VALUES = """
WITH v AS (SELECT p_partkey, list_sort(list_distinct([p_partkey, CAST(p_size AS BIGINT)])) AS v FROM part)
SELECT p_partkey, array_to_string(v, ',') AS found, CAST(len(v) AS BIGINT) AS n FROM v"""


def message_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages about events by their template."""
    events = table(spark, sf_dir, "events")
    message = F.concat(F.lit("Value "), "event_id", F.lit(" of 'user "), "user_id", F.lit("' in specs/a_1.yaml or notes.md is 0x"), F.hex("user_id"), F.lit(" after https://ex.org/a?b for "), "event_type", F.lit(" `x` TWICE"))
    return events.groupBy(texts.message_slug(message).alias("slug")).agg(F.count("*").alias("messages"), F.min("event_id").alias("first_event"))


MESSAGE_SLUGS = "SELECT 'msg-value-of-in-or-is-after-for-' || event_type || '-twice' AS slug, count(*) AS messages, min(event_id) AS first_event FROM events GROUP BY 1"

TITLES = ("Chapter {}.2: Timing", "{} MHz clock", "A{}.3 Registers", "part {}. Overview", "{} V supply", "{}. Pins", "Notes on {}", "5 Volts {}", "§ {} x")


def section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles made of parts' sizes, with the numbers they begin with."""
    n = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % len(TITLES)
    title = F.lit(None).cast("string")
    for k, form in enumerate(TITLES):
        title = F.when(kind == k, F.replace(F.lit(form), F.lit("{}"), n)).otherwise(title)
    rows = table(spark, sf_dir, "part").select("p_partkey", title.alias("title"))
    return rows.select("p_partkey", texts.section_number(F.col("title")).alias("number"), texts.markdown_key(F.concat(F.lit("Section 4 `"), "title", F.lit("`: {#x}"))).alias("heading_key"))


_FORMS = ", ".join(f"'{t}'" for t in TITLES)
SECTION_NUMBERS = f"""
WITH t AS (SELECT p_partkey, p_partkey % {len(TITLES)} AS k, CAST(p_size AS VARCHAR) AS n, replace(([{_FORMS}])[p_partkey % {len(TITLES)} + 1], '{{}}', CAST(p_size AS VARCHAR)) AS title FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN n || '.2' WHEN 2 THEN 'A' || n || '.3' WHEN 3 THEN 'Part ' || n WHEN 5 THEN n WHEN 7 THEN '5' END AS number, '4 ' || lower(title) AS heading_key FROM t"""

LICENCE_NAMES = ("MIT", "apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "BSD-2-Clause", "LicenseRef-mine")


def spdx_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' ids written as licence expressions, a digit to a name; whether a public root accepts them."""
    name = lambda k: F.get(F.array(*map(F.lit, LICENCE_NAMES)), F.pmod(F.floor(F.col("doc_id") / k), F.lit(len(LICENCE_NAMES))).cast("int"))
    docs = table(spark, sf_dir, "documents").select(name(1).alias("a"), name(6).alias("b"), name(36).alias("c"))
    text = F.concat(F.lit("("), "a", F.lit(" OR "), "b", F.lit(") AND "), "c", F.lit(" WITH LLVM-exception"))
    counted = docs.groupBy(text.alias("expression")).agg(F.count("*").alias("docs"))
    return counted.select("expression", "docs", spdx.accepts(F.col("expression"), ("MIT", "Apache-2.0"), F.lit("public")).alias("accepted"))


_NAME = lambda k: f"(['" + "', '".join(LICENCE_NAMES) + f"'])[1 + (doc_id // {k}) % {len(LICENCE_NAMES)}]"
_OK = lambda c: f"lower({c}) IN ('mit', 'apache-2.0')"
SPDX_GATE = f"""
WITH d AS (SELECT {_NAME(1)} AS a, {_NAME(6)} AS b, {_NAME(36)} AS c FROM documents)
SELECT '(' || a || ' OR ' || b || ') AND ' || c || ' WITH LLVM-exception' AS expression, count(*) AS docs,
any_value(({_OK('a')} OR {_OK('b')}) AND {_OK('c')} AND NOT 'LicenseRef-mine' IN (a, b, c)) AS accepted FROM d GROUP BY 1"""


def robots_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and the rules of their hosts, which are made of other pages' addresses: folders, beginnings with a star, and endings."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    path = F.regexp_replace("url", "^[a-z]+://[^/]+", "")
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    folder = F.concat(F.substring_index("path", "/", 2), F.lit("/"))
    one = lambda rule, allow, every: F.struct(rule.alias("rule"), allow.alias("allow"), F.lit(every).alias("every"))
    made = F.array(
        one(folder, F.col("page_id") % 3 == 0, 2),
        one(F.concat(F.substring("path", 1, 5), F.lit("*page=")), F.col("page_id") % 4 == 0, 3),
        one(F.concat(F.lit("*"), F.substring("path", -3, 3), F.lit("$")), F.lit(False), 5),
    )
    rules = pages.select("host", "page_id", F.explode(made).alias("x")).where("page_id % x.every = 0").select("host", "x.rule", "x.allow")
    return robots.allowed(pages, rules).select("page_id", "allowed", "rule")


ROBOTS_GATE = """
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(url, '^[a-z]+://[^/]+', '') AS path FROM pages),
m AS (SELECT host, '/' || split_part(path, '/', 2) || '/' AS rule, page_id % 3 = 0 AS allow FROM p WHERE page_id % 2 = 0 UNION ALL SELECT host, left(path, 5) || '*page=', page_id % 4 = 0 FROM p WHERE page_id % 3 = 0
  UNION ALL SELECT host, '*' || right(path, 3) || '$', false FROM p WHERE page_id % 5 = 0),
r AS (SELECT host, rule, bool_or(allow) AS allow, replace(replace(replace(rule, '%', '\\%'), '_', '\\_'), '*', '%') AS form FROM m GROUP BY 1, 2),
b AS (SELECT page_id, max({n: length(rule), allow: allow, rule: rule}) AS best FROM p JOIN r ON r.host = p.host AND path LIKE CASE WHEN form LIKE '%$' THEN left(form, -1) ELSE form || '%' END ESCAPE '\\' GROUP BY 1)
SELECT p.page_id, coalesce(best.allow, true) AS allowed, best.rule AS rule FROM p LEFT JOIN b ON b.page_id = p.page_id"""

QUERIES = {
    f.__name__: f
    for f in (
        license_gate, notice_scan, prose_facts, claim_binding, url_normalise, dedup_canonical, leak_scan, heading_index, hex_values, message_slugs, section_numbers, spdx_gate, robots_gate,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
