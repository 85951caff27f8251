"""What claims say against the text that they cite: literals by sentence, ranges of identifiers, and cell values.

Claims are (fact, claim), cited spans (fact, nth, text, context, symbol); a fact may have any number of either. Null texts are empty. Offsets count characters.
Claims and spans meet by the fact and what both hold (a literal's value, the first letters and digits of a name), never a whole fact at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.functions import texts
from citegrid.lineage import cut

# Abbreviations whose point ends no sentence.
ABBREVIATIONS = ["e.g", "i.e", "vs", "cf", "approx", "fig"]
_SENTENCE = r"(?s).*?(?:[!?]|\.(?<!(?:^|[\s(])(?i:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.))(?=[ \t\n\r\f]|$)|.+"
#: Words that a name may be written as.
JOINED = 3
#: Leads of names that are compared in each task before names are shuffled; where more are asked for, none are.
LEADS = 1 << 16
#: A property whose cell must be cited as it stands.
CELL = "ngpios"


def sentences(claim: Column) -> Column:
    """array of (begin, end, text): sentences with what ends them; each runs up to the next one, blanks in front included. A point, ! or ? ends one before a blank or the end."""
    def placed(found: Column) -> Column:
        ends = F.aggregate(found, F.array(F.lit(0)), lambda s, text: F.array_append(s, F.element_at(s, -1) + F.length(text)), lambda s: F.slice(s, 1, F.size(s) - 1))
        return F.zip_with(found, ends, lambda text, at: F.struct(at.alias("begin"), (at + F.length(text)).alias("end"), text.alias("text")))

    # A list of one, so that the sentences are found once.
    return F.flatten(F.transform(F.array(F.regexp_extract_all(claim, F.lit(_SENTENCE), F.lit(0))), placed))


def unbound(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """(fact, value, begin, end): literals that are in cited text, but in no line that shares an identifier with their sentence, and the first such sentence.

    A line's identifiers are its own, its context's and its symbol's. Values that no cited line has are another finding and left out.
    """
    said = claims.select("fact", F.explode_outer(sentences(F.col("claim"))).alias("s")).select("fact", "s.begin", "s.end", "s.text", F.explode_outer(texts.hex_values(F.col("s.text"))).alias("value"))
    said = cut(said.where("value is not null").select("fact", "begin", "end", "value", texts.identifiers(F.col("text")).alias("ids")))
    lines = cited.select("fact", F.explode(F.split("text", "\n")).alias("line"), F.concat_ws(" ", "context", "symbol").alias("more"))
    held = lines.select("fact", F.concat_ws(" ", "line", "more").alias("line"), F.explode_outer(texts.hex_values(F.col("line"))).alias("value"))
    held = cut(held.where("value is not null").join(said.select("fact", "value").distinct(), ["fact", "value"], "left_semi").select("fact", "value", texts.identifiers(F.col("line")).alias("ids")))
    key = ["fact", "value"]
    spans = [*key, "begin", "end"]
    bound = said.select(*spans, F.explode("ids").alias("id")).join(held.select(*key, F.explode("ids").alias("id")), [*key, "id"], "left_semi").select(*spans).distinct()
    loose = said.select(*spans).distinct().join(held.select(*key), key, "left_semi").join(bound, spans, "left_anti")
    return loose.groupBy(*key).agg(F.min(F.struct("begin", "end")).alias("s")).select(*key, "s.begin", "s.end")


def _key(name: Column) -> Column:
    return texts.ascii_lower(F.regexp_replace(name, r"[_\s]", ""))


def _lead(key: Column) -> Column:
    """All up to and with the first digits: the same for a name and for what begins with it and doesn't go on with a digit."""
    return F.regexp_extract(key, "^[^0-9]*[0-9]*", 0)


#: Two names that differ in one decimal index, the last that can be: prefix, index, suffix, and the index of the last name.
_INDEXED = r"(?i)^(\w{2,}(?<![0-9]))([0-9]{1,19})((?:[^0-9.]\w*)?)\.\.\1([0-9]{1,19})\3$"


def ranges(claims: DataFrame) -> DataFrame:
    """(fact, first, last, prefix, suffix, n, m, width, next): ranges ``first..last`` in claims, in backticks or not, and the name after the last one.

    The names differ in one decimal index, which rises; case doesn't matter. Width is that of a last index with zeros before it, else 0.
    """
    tight = F.regexp_replace(F.replace("claim", F.lit("`"), F.lit(" ")), r"[ \t]*\.\.[ \t]*", "..")
    # Outer generators, as no filter that makes the array once more is put before those.
    words = F.regexp_extract_all(tight, F.lit(r"(?<![A-Za-z0-9_.])([A-Za-z_]\w*\.\.[A-Za-z_]\w*)"), F.lit(1))
    found = claims.select("fact", F.explode_outer(words).alias("word")).where(F.col("word").rlike(_INDEXED)).distinct()
    part = lambda k: F.regexp_extract("word", _INDEXED, k)
    name = lambda k: F.element_at(F.split("word", r"\.\."), k)
    found = found.select("fact", name(1).alias("first"), name(2).alias("last"), part(1).alias("prefix"), part(3).alias("suffix"), part(2).cast("decimal(20,0)").alias("n"), part(4).alias("index"))
    width = F.when(F.col("index").rlike("^0[0-9]"), F.length("index")).otherwise(0)
    found = found.withColumn("m", F.col("index").cast("decimal(20,0)")).withColumn("width", width).where("m > n").drop("index")
    after = (F.col("m") + 1).cast("string")
    padded = F.when(F.length(after) < F.col("width"), F.expr("lpad(cast(m + 1 as string), width, '0')")).otherwise(after)
    return found.withColumn("next", F.concat("prefix", padded, "suffix"))


def names(cited: DataFrame) -> DataFrame:
    """(fact, words, lead): each word of a cited span with up to ``JOINED`` in a row, underscores left out, by the leads of the names that they make; names without digits have none.

    Other characters than letters, digits and blanks part words. Where a word that ends with digits is followed by one that begins with some, names of more words have longer leads.
    """
    plain = reduce(lambda text, blank: F.replace(text, F.lit(blank), F.lit(" ")), "\t\n\x0b\f\r", F.replace("text", F.lit("_"), F.lit("")))
    row = rf"(?=[A-Za-z0-9])(?<![A-Za-z0-9])(?=[A-Za-z ]*[0-9])(?=([A-Za-z0-9]+(?: +[A-Za-z0-9]+){{0,{JOINED - 1}}}))"
    lead = lambda w, k: F.replace(F.regexp_extract(w, "^[^0-9]*[0-9]+" + "(?: +[0-9]+)?" * k, 0), F.lit(" "), F.lit(""))
    # Lambdas keep these patterns out of the code generated for what is around them, which is too long to be compiled otherwise.
    found = F.transform(F.filter(F.regexp_extract_all(plain, F.lit(row), F.lit(1)), lambda w: w.rlike("[0-9]")), F.lower)
    longer = lambda w: F.transform(F.array(*[lead(w, k) for k in range(JOINED)]), lambda x: F.struct(w.alias("words"), x.alias("lead")))
    only = lambda w: F.array(F.struct(w.alias("words"), lead(w, 0).alias("lead")))
    found = F.flatten(F.transform(found, lambda w: F.when(w.rlike("[0-9] +[0-9]"), F.array_distinct(longer(w))).otherwise(only(w))))
    return cited.select("fact", F.explode_outer(found).alias("w")).where("w is not null").select("fact", "w.words", "w.lead")


def range_findings(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """(fact, code, subject, name): ranges whose last name isn't cited (range-end), or whose next one is though no other range goes on with it (range-successor).

    A name is cited if a name of the cited spans is it or begins with it and goes on with no digit. A name that is written over two spans isn't seen.
    """
    found = cut(ranges(claims))
    own = ["fact", F.concat("first", F.lit(".."), "last").alias("subject")]
    ends = found.select(*own, F.lit("range-end").alias("code"), F.col("last").alias("name"))
    follow = found.select("fact", _key(F.col("prefix")).alias("_p"), _key(F.col("suffix")).alias("_s"), F.col("n").alias("_n"))
    last = found.withColumn("_p", _key(F.col("prefix"))).withColumn("_s", _key(F.col("suffix"))).withColumn("_n", F.col("m") + 1).withColumn("_n", F.col("_n").cast("decimal(20,0)"))
    steps = last.join(follow, ["fact", "_p", "_s", "_n"], "left_anti").select(*own, F.lit("range-successor").alias("code"), F.col("next").alias("name"))
    asked = ends.union(steps).withColumn("key", _key(F.col("name"))).withColumn("lead", _lead(F.col("key"))).alias("a")
    leads = asked.select("lead").distinct()
    # A range's names have a digit, and few leads are asked for, so most names go before anything is shuffled; where too many are, spans of facts without ranges go.
    if leads.limit(LEADS + 1).count() <= LEADS:
        held = names(cited).join(F.broadcast(leads), "lead", "left_semi")
    else:
        held = names(cited.join(found.select("fact").distinct(), "fact", "left_semi"))
    held = cut(held.join(asked.select("fact", "lead").distinct(), ["fact", "lead"], "left_semi")).alias("h")
    # The key is where some of the words end, or no digit follows it.
    whole = " or ".join(f"replace(substring_index(regexp_replace(h.words, ' +', ' '), ' ', {k}), ' ', '') = a.key" for k in range(1, JOINED))
    name = "replace(h.words, ' ', '')"
    begins = F.expr(f"a.fact = h.fact and a.lead = h.lead and startswith({name}, a.key) and (not rlike(substr({name}, length(a.key) + 1, 1), '[0-9]') or {whole})")
    missing = asked.where("code = 'range-end'").join(held, begins, "left_anti")
    there = asked.where("code = 'range-successor'").join(held, begins, "left_semi")
    return missing.union(there).select("fact", "code", "subject", "name")


def cells(text: Column) -> Column:
    """The distinct numbers that the property ``CELL`` is given alone, lower-cased as they stand."""
    inside = F.regexp_extract_all(text, F.lit(rf"(?i)\b{CELL}\s*=\s*<([^<>]*)>"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(inside, lambda x: F.lower(F.trim(x))), lambda x: x.rlike("^(0x[0-9a-f]+|[0-9]+)$")))


def cell_findings(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """(fact, cell): cell values of claims that no cited span gives in the same notation."""
    pick = lambda df, text: df.select("fact", F.explode(cells(F.col(text))).alias("cell")).distinct()
    return pick(claims, "claim").join(pick(cited, "text"), ["fact", "cell"], "left_anti")


def findings(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """(fact, rank, code, subject, name, begin, end): all findings; by rank they stand in their fixed order: binding, ranges, cells."""
    claims = claims.select("fact", F.coalesce("claim", F.lit("")).alias("claim"))
    cited = cited.select("fact", F.coalesce("text", F.lit("")).alias("text"), "context", "symbol")
    none = F.lit(None).cast("int")
    binding = unbound(claims, cited).select("fact", F.lit(0).alias("rank"), F.lit("hex-unbound").alias("code"), F.col("value").cast("string").alias("subject"), F.lit(None).cast("string").alias("name"), "begin", "end")
    spans = range_findings(claims, cited).select("fact", F.lit(1).alias("rank"), "code", "subject", "name", none.alias("begin"), none.alias("end"))
    given = cell_findings(claims, cited).select("fact", F.lit(2).alias("rank"), F.lit("cell-absent").alias("code"), F.col("cell").alias("subject"), F.lit(CELL).alias("name"), none.alias("begin"), none.alias("end"))
    return reduce(DataFrame.union, [binding, spans, given])
