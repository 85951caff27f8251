"""Citations of documents: their declaration, their anchors, and the sections of a document's index that they mean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.lineage import cut

SUFFIX = ".index.yaml"


def declared(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """``citations`` (file, doc, class, ..) with ``problem``: undeclared, twice-declared, other-class, not-citable, or null.

    documents: (file, name, class, cite); a document may be cited unless ``cite`` is false.
    """
    docs = documents.groupBy("file", F.col("name").alias("doc")).agg(F.count("*").alias("_n"), F.min("class").alias("_class"), F.min(F.coalesce("cite", F.lit(True))).alias("_cite"))
    rows = citations.join(docs, ["file", "doc"], "left")
    problem = F.when(F.col("_n").isNull(), "undeclared").when(F.col("_n") > 1, "twice-declared").when(~F.col("class").eqNullSafe(F.col("_class")), "other-class").when(~F.col("_cite"), "not-citable")
    return rows.withColumn("problem", problem).drop("_n", "_class", "_cite")


def anchored(anchors: DataFrame, repos: DataFrame) -> DataFrame:
    """``anchors`` (file, repo, path, ..) with ``problem``: unlisted-repo, twice-listed, unlisted-path, or null. repos: (file, name, files); null files are open."""
    listed = repos.groupBy("file", F.col("name").alias("repo")).agg(F.count("*").alias("_n"), F.first("files", ignorenulls=True).alias("_files"))
    rows = anchors.join(listed, ["file", "repo"], "left")
    problem = F.when(F.col("_n").isNull(), "unlisted-repo").when(F.col("_n") > 1, "twice-listed").when(~F.array_contains("_files", F.col("path")), "unlisted-path")
    return rows.withColumn("problem", problem).drop("_n", "_files")


def canonical(indexes: DataFrame) -> DataFrame:
    """(document, file): the index that stands for a document: the one named after it, else the first by file name."""
    named = F.col("file") == F.concat("document", F.lit(SUFFIX))
    return indexes.groupBy("document").agg(F.min(F.struct(~named, "file"))["file"].alias("file"))


def placed(sections: DataFrame) -> DataFrame:
    """``sections`` (document, ord, level, number, title, begin, end) with ``above``: the ords of the sections around each, the outermost first.

    The section around another on a level is the last one of that level before it, unless one of a lesser level came after that. So running last
    places, one for each level that there is, are enough, and a document takes time in proportion to its sections.
    """
    deepest = sections.agg(F.max("level")).first()[0] or 0
    before = Window.partitionBy("document").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("ord").cast("int")), ignorenulls=True).over(before).alias(f"_last{k}") for k in range(1, deepest)]
    rows = sections.select("*", *last)
    around, most = [], F.lit(-1)
    for k in range(1, deepest):
        at = F.col(f"_last{k}")
        around.append(F.when((F.col("level") > k) & (at > most), at))
        most = F.greatest(most, at)  # nulls are passed over
    above = F.array_compact(F.array(*around)) if around else F.array().cast("array<int>")
    return rows.withColumn("above", above).drop(*[f"_last{k}" for k in range(1, deepest)])


#: Pages of a cell, by which sections and cited pages meet.
CELL = 16


def _prefixes(number: Column) -> Column:
    parts = F.split(number, r"\.")
    return F.when(number.isNotNull(), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), ".")))


def linked(citations: DataFrame, sections: DataFrame) -> DataFrame:
    """(fact, document, ord): the sections that citations (fact, document, section, number, heading, pages) mean, and the sections around those.

    A cited number means the sections with that number or with one that it lies under; a cited title or heading the sections with that title (a section's without regard
    to case). Only a citation that means none of these goes by its pages: on a page where sections begin, the deepest of them and what is around them
    on that page; else all that have the page. No pair is found by comparing all sections of a document: a number meets others by its dotted
    prefixes, a page by cells.
    """
    return _meant(citations, placed(sections)).select("fact", "document", "ord")


def counted(citations: DataFrame, sections: DataFrame) -> DataFrame:
    """(document, ord, facts, first_fact): how many facts ``linked`` gives a section, and the lowest of them, without a row for each link.

    Facts whose citations of a document say the same mean the same sections. So these are looked up once for each thing said, and facts are only counted by it; a fact with
    several citations of a document is counted by all of them together.
    """
    say = ["section", "number", "heading", "pages"]
    said = F.xxhash64("document", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in say[:3]], F.coalesce(F.array_join(F.col("pages").cast("array<string>"), ",", "\x00"), F.lit("\x01")))
    # Pages say nothing where a number, a title or a heading is one of the document's, so they don't tell such citations apart.
    name = F.xxhash64("document", *[F.coalesce(F.col(c), F.lit("\x00")) for c in say[:3]])
    keys = [
        (sections.select("document", F.col("number").alias("_k")), F.explode_outer(_prefixes(F.col("number")))),
        (sections.select("document", F.lower("title").alias("_k")), F.when(F.col("section") != "", F.lower("section"))),
        (sections.select("document", F.col("title").alias("_k")), F.col("heading")),
    ]
    cites = citations.withColumn("_name", name)
    names = cites.select("_name", "document", *say[:3]).distinct()
    known = [names.select("_name", "document", of.alias("_k")).where("_k is not null").join(there.distinct().hint("merge"), ["document", "_k"], "left_semi").select("_name") for there, of in keys]
    known = reduce(DataFrame.union, known).distinct().withColumn("_known", F.lit(True))
    cites = cites.join(known.hint("merge"), "_name", "left").withColumn("pages", F.when(F.col("_known").isNull(), F.col("pages"))).withColumn("_said", F.struct(said.alias("hash"), *say))
    sets = cites.where("fact is not null").groupBy("document", "fact").agg(F.array_sort(F.collect_set("_said")).alias("_all"))
    groups = cut(sets.groupBy("document", "_all").agg(F.count("*").alias("facts"), F.min("fact").alias("first_fact")).withColumn("fact", F.monotonically_increasing_id()))
    each = groups.select("fact", "document", F.explode("_all").alias("_said")).select("fact", "document", *[F.col("_said")[c].alias(c) for c in say])
    met = _meant(each, placed(sections)).join(groups.select("fact", "facts", "first_fact").hint("shuffle_hash"), "fact")
    return met.groupBy("document", "ord").agg(F.sum("facts").alias("facts"), F.min("first_fact").alias("first_fact"))


def _meant(citations: DataFrame, placed_: DataFrame) -> DataFrame:
    # Sections go to their citations by shuffles: their strings are far longer in memory than in files, by which a broadcast would be chosen.
    placed_ = placed_.hint("merge")
    cites = citations.withColumn("_cite", F.xxhash64("fact", "document", "section", "number", "heading", F.array_join(F.col("pages").cast("array<string>"), ","))).distinct()
    own = ["_cite", "fact", "document"]
    by_number = cites.where("number is not null").select(*own, F.explode(_prefixes(F.col("number"))).alias("number")).join(placed_, ["document", "number"])
    title = cites.where("section <> ''").select(*own, F.lower("section").alias("_title")).join(placed_.withColumn("_title", F.lower("title")), ["document", "_title"])
    heading = cites.where("heading is not null").select(*own, F.col("heading").alias("title")).join(placed_, ["document", "title"])
    cols = [*own, "ord", "above"]
    named = by_number.select(*cols).union(title.select(*cols)).union(heading.select(*cols)).distinct()

    paged = cites.join(named.select("_cite").distinct(), "_cite", "left_anti").select(*own, F.explode(F.array_distinct("pages")).alias("page"))
    paged = paged.withColumn("cell", F.floor(F.col("page") / CELL))
    spans = placed_.where("begin <= end").withColumn("cell", F.explode(F.sequence(F.floor(F.col("begin") / CELL), F.floor(F.col("end") / CELL))))
    met = paged.join(spans, ["document", "cell"]).where("page between begin and end")
    starts = F.when(F.col("begin") == F.col("page"), F.col("level"))
    deepest = F.max(starts).over(Window.partitionBy("_cite", "page"))
    met = met.withColumn("_deepest", deepest)
    whole = met.where("_deepest is null").select(*own, "ord")
    first = met.where(starts == F.col("_deepest")).select(*own, "page", "ord", "above")
    around = first.select(*own, "page", F.explode("above").alias("ord")).join(met.select("_cite", "page", "ord").distinct(), ["_cite", "page", "ord"]).select(*own, "ord")
    found = named.select(*own, F.explode(F.concat(F.array(F.col("ord").cast("int")), "above")).alias("ord")).union(whole).union(first.select(*own, "ord")).union(around)
    return found.select("fact", "document", F.col("ord").cast("int").alias("ord")).distinct()
