"""Blocks of source files by their braces: where each node begins and ends, looking nodes up, and symbols near a span.

Files are rows (file, line, text), a line once; gaps in the numbers don't matter. Rows without a file or line take no part, a null text is an empty
line. A file isn't bound to one task: all running values are taken within ranges of ``BLOCK`` line numbers first, then over the ranges' totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.lineage import written

#: Line numbers of a range.
BLOCK = 4096
#: Lines before a span in which its symbol may also stand.
BEFORE = 200
WORD = "[A-Za-z0-9_]+"
#: Words of the filter of words that symbols begin with, of 64 bits each; it is broadcast and has no more than these rows.
SLOTS = 1 << 20
_CHARACTER = r"'(?:\\.|[^'\\])'"
_STRING = r'"(?:\\.|[^"\\])*(?:"|$)'
_NOT_CODE = rf"{_STRING}|{_CHARACTER}|//.*|/\*.*?\*/|(/\*).*$"


def _code(text: Column) -> Column:
    """What is code of a line that begins as code; ``/*`` at its end says that a comment goes on."""
    plain = ~(F.contains(text, F.lit("/")) | F.contains(text, F.lit('"')) | F.contains(text, F.lit("'")))
    return F.when(plain, text).otherwise(F.regexp_replace(text, _NOT_CODE, " $1"))


def _rest(text: Column) -> Column:
    """What follows the end of the comment that a line begins in; null if it doesn't end there."""
    at = F.locate("*/", text)
    return F.when(at > 0, F.substring(text, at + 2, F.length(text)))


def _read(lines: DataFrame) -> DataFrame:
    """(file, line, _block, _c0, _c1, _set, _turn): a line as it reads if it begins as code or in a comment, and what it does to the state.

    A line maps whether it begins in a comment to whether it ends in one. Where both ends are one, it sets the state; else it keeps it or turns it round (``/*/``
    does). So a line's state is what the last setting line gave, turned as often as lines have turned it since.
    """
    rows = lines.where("file is not null and line is not null").select("file", "line", F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("line") / BLOCK).alias("_block"))
    rows = rows.withColumn("_c0", _code(F.col("text"))).withColumn("_rest", _rest(F.col("text"))).withColumn("_c1", _code(F.col("_rest")))
    from_code = F.endswith("_c0", F.lit("/*")).cast("int")
    from_comment = F.coalesce(F.endswith("_c1", F.lit("/*")), F.lit(True)).cast("int")
    set_ = F.when(from_code == from_comment, from_code)
    return rows.select("file", "line", "_block", "_c0", "_c1", set_.alias("_set"), F.when(set_.isNull() & (from_code == 1), 1).otherwise(0).alias("_turn"))


def _before(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_base``, what the last setting line before it in its range of lines gave, and ``_turns`` before it: the state is their sum's parity, the range's begin for no base."""
    within = Window.partitionBy("file", "_block").orderBy("line")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_turns": F.coalesce(F.sum("_turn").over(earlier), F.lit(0)), "_last": F.lead("line").over(within).isNull()})
    return rows.withColumn("_base", F.last((F.col("_set") + F.col("_turns") + F.col("_turn")) % 2, ignorenulls=True).over(earlier))


def _after() -> tuple[Column, Column]:
    """(_base, _turns) as they are after a row of ``_before``."""
    turns = F.col("_turns") + F.col("_turn")
    return F.coalesce((F.col("_set") + turns) % 2, "_base"), turns


def _starts(blocks: DataFrame) -> DataFrame:
    """``blocks`` (file, _block, _base, _turn, ..), as they are after a range, with ``_start``: whether it begins in a comment. Each keeps, turns or sets the state."""
    ranges = Window.partitionBy("file").orderBy("_block")
    blocks = blocks.withColumn("_set", (F.col("_base") + F.col("_turn")) % 2).withColumn("_turns", F.sum("_turn").over(ranges))
    blocks = blocks.withColumn("_base", F.last((F.col("_set") + F.col("_turns")) % 2, ignorenulls=True).over(ranges))
    return blocks.withColumn("_start", F.lag((F.coalesce("_base", F.lit(0)) + F.col("_turns")) % 2, 1, 0).over(ranges))


def code(lines: DataFrame) -> DataFrame:
    """(file, line, code): lines without comments, strings and characters; comments may span lines, strings end with theirs."""
    rows = _before(_read(lines))
    base, turns = _after()
    blocks = _starts(rows.where("_last").select("file", "_block", base.alias("_base"), turns.alias("_turn"))).select("file", "_block", "_start")
    rows = rows.join(blocks, ["file", "_block"])
    began = (F.coalesce("_base", "_start") + F.col("_turns")) % 2
    shown = F.when(began == 0, F.col("_c0")).otherwise(F.coalesce("_c1", F.lit("")))
    return rows.select("file", "line", F.when(F.endswith(shown, F.lit("/*")), F.substring(shown, F.lit(1), F.length(shown) - 2)).otherwise(shown).alias("code"))


def _steps(text: Column) -> Column:
    """By how much the braces of ``text`` change the depth."""
    return F.coalesce(F.length(F.replace(text, F.lit("}"))) - F.length(F.replace(text, F.lit("{"))), F.lit(0))


def _paired(lines: DataFrame) -> DataFrame:
    """(file, _block, part, line, nth, step, name, level, end, base, turns): braces, paired within the parts of ranges, in one pass over the lines.

    How a range begins isn't known yet. Its lines up to the first that sets the state are read both ways, as part 0 if it begins as code and part 1 if in a comment; part 2 is
    the others. Levels count from the part's begin. A closing brace that closes one of its part is left out. A row of step 0 has the state after the range's last line.
    """
    marked = F.contains("text", F.lit("{")) | F.contains("text", F.lit("}")) | F.contains("text", F.lit("/*")) | F.contains("text", F.lit("*/"))
    rows = _read(lines.where(marked))
    braced = lambda c: F.contains(c, F.lit("{")) | F.contains(c, F.lit("}"))
    rows = _before(rows.withColumns({c: F.when(braced(F.col(c)), F.col(c)) for c in ("_c0", "_c1")}))
    open_, turned = F.col("_base").isNull(), F.col("_turns") % 2 == 1
    read = [F.when(open_ & ~turned, F.col("_c0")).when(open_, F.col("_c1")), F.when(open_ & turned, F.col("_c0")).when(open_, F.col("_c1"))]
    read.append(F.when((F.col("_base") + F.col("_turns")) % 2 == 0, F.col("_c0")).when(~open_, F.col("_c1")))
    base, turns = _after()
    rows = rows.select("file", "line", "_block", *[c.alias(f"_x{k}") for k, c in enumerate(read)], "_last", base.alias("base"), turns.alias("turns"))
    earlier = Window.partitionBy("file", "_block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_d{k}": F.coalesce(F.sum(_steps(F.col(f"_x{k}"))).over(earlier), F.lit(0)) for k in range(3)})
    of = [F.struct(F.lit(k).alias("part"), F.col(f"_x{k}").alias("x"), F.col(f"_d{k}").alias("depth")) for k in range(3)]
    of.append(F.struct(F.lit(3).alias("part"), F.when(F.col("_last"), "").alias("x"), F.lit(0).cast("long").alias("depth")))
    rows = rows.select("file", "line", "_block", "base", "turns", F.inline(F.array(*of)))
    rows = rows.where("x is not null")
    rows = rows.withColumn("pieces", F.when(F.col("part") == 3, F.array(F.lit(""))).otherwise(F.regexp_extract_all("x", F.lit("[^;{}]*[;{}]"), 0)))
    rows = rows.select("file", "line", "_block", "base", "turns", "part", "depth", "pieces", F.posexplode("pieces").alias("nth", "piece")).where("right(piece, 1) <> ';'")
    rows = rows.withColumn("step", _steps(F.col("piece")))
    to_here = F.when(F.col("nth") == 0, F.col("step")).otherwise(_steps(F.array_join(F.slice("pieces", F.lit(1), F.col("nth") + 1), "")))
    level = F.col("depth") + to_here + F.when(F.col("step") == -1, 1).otherwise(0)
    state = [F.when(F.col("step") == 0, F.col(c)).alias(c) for c in ("base", "turns")]
    rows = rows.select("file", "_block", "part", "line", "nth", "step", F.when(F.col("step") == 1, F.col("piece")).alias("piece"), F.when(F.col("step") != 0, level).alias("level"), *state)
    within = Window.partitionBy("file", "_block", "part", "level").orderBy("line", "nth")
    # Braces of one level open and close in turn.
    rows = rows.withColumns({"end": F.when(F.col("step") == 1, F.lead("line").over(within)), "_closes": (F.col("step") == -1) & F.lag("line").over(within).isNotNull()})
    name = F.trim(F.regexp_replace(F.expr("left(piece, length(piece) - 1)"), r"^\s*(?:[A-Za-z_]\w*\s*:\s*)*", ""))
    return rows.where("not _closes").select("file", "_block", "part", "line", "nth", "step", F.regexp_replace(name, r"\s+$", "").alias("name"), "level", "end", "base", "turns")


def nodes(lines: DataFrame) -> DataFrame:
    """(file, name, level, begin, end): every block; ``end`` is null where it isn't closed, ``name`` empty where none stands in its line.

    Braces of one level open and close in turn, so a block ends with the next brace of its level, if that closes one. A closing brace too many takes part in no block.
    Blocks within a part of a range are done when the lines are read; only braces that are left over there are paired over the ranges.
    """
    found = written(_paired(lines), "braces")
    sums = [F.coalesce(F.sum(F.when(F.col("part") == k, F.col("step"))), F.lit(0)).alias(f"_sum{k}") for k in range(3)]
    blocks = _starts(found.where("end is null").groupBy("file", "_block").agg(F.max("base").alias("_base"), F.max("turns").alias("_turn"), *sums))
    first = F.when(F.col("_start") == 0, F.col("_sum0")).otherwise(F.col("_sum1"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(first + F.col("_sum2")).over(earlier), F.lit(0))
    blocks = blocks.select("file", "_block", "_start", first.alias("_first"), depth.alias("_depth"))
    placed = found.where("step <> 0").join(blocks, ["file", "_block"]).where("part = 2 or part = _start")
    level = F.col("level") + F.col("_depth") + F.when(F.col("part") == 2, F.col("_first")).otherwise(0)
    placed = placed.select("file", "name", level.alias("level"), "_block", "line", "nth", "step", "end")
    later = F.lead("line").over(Window.partitionBy("file", "level").orderBy("_block", "line", "nth"))  # at most four of a range
    over = placed.where("end is null").withColumn("end", later).where("step = 1")
    return placed.where("end is not null").unionByName(over).select("file", "name", "level", F.col("line").alias("begin"), "end")


def look_up(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(file, node, status, begin, end) for each distinct (file, node) wanted: ok, unclosed (any of its blocks is), missing or several; a span only for ok."""
    asked = wanted.select("file", "node").distinct()
    held = found.where("name <> ''").groupBy("file", F.col("name").alias("node")).agg(F.count("*").alias("n"), F.count("end").alias("closed"), F.min("begin").alias("begin"), F.min("end").alias("end"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("closed") < F.col("n"), "unclosed").when(F.col("n") > 1, "several").otherwise("ok")
    rows = asked.join(held, ["file", "node"], "left").withColumn("status", status)
    span = lambda c: F.when(F.col("status") == "ok", F.col(c)).alias(c)
    return rows.select("file", "node", "status", span("begin"), span("end"))


def _asked_for(words: DataFrame, asked: DataFrame) -> DataFrame:
    """``words`` (word, ..) without most of those that aren't in ``asked`` (word): each word asked for sets two bits of a slot. None that is asked for goes."""
    bit = lambda at: f"shiftleft(1L, cast(pmod(shiftright(xxhash64(word), {at}), 64) as int))"
    slot, bits = F.expr(f"pmod(xxhash64(word), {SLOTS})").alias("_slot"), F.expr(f"{bit(32)} | {bit(48)}")
    known = asked.groupBy(slot).agg(F.bit_or(bits).alias("_bits"))
    return words.withColumns({"_slot": slot, "_own": bits}).join(F.broadcast(known), "_slot").where("_bits & _own = _own").drop("_slot", "_bits", "_own")


def with_symbol(cited: DataFrame, lines: DataFrame) -> DataFrame:
    """``cited`` (file, symbol, begin, end, ..) with ``found``: whether the symbol stands whole in the span's lines or the ``BEFORE`` lines ahead of it.

    Whole means that no letter, digit or underscore touches it. A symbol without any of these, a null and a span that is empty or begins before 1 are
    never found. Symbols meet lines by file, range of lines and first word, so neither long files nor common words make pairs. Words that no symbol begins with go
    before they are sent, but for a few that a filter of fixed size lets through.
    """
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK)))
    first = F.regexp_extract("symbol", WORD, 0)
    keys = ["file", "symbol", "begin", "end"]
    asked = cited.where("begin >= 1 and begin <= end and file is not null").select(*keys).distinct().withColumn("word", first).where("word <> ''")
    asked = asked.withColumn("low", F.greatest(F.col("begin") - BEFORE, F.lit(1))).withColumn("cell", cells(F.col("low"), F.col("end")))
    words = lines.where("line is not null").select("file", "line", "text", F.floor(F.col("line") / BLOCK).alias("cell"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), 0))).alias("word"))
    a, w = asked.alias("a"), _asked_for(words, asked).alias("w")
    near = F.expr("w.file = a.file and w.cell = a.cell and w.word = a.word and w.line between a.low and a.end")
    whole = F.expr(r"rlike(w.text, concat('(?<![A-Za-z0-9_])\\Q', a.symbol, '\\E(?![A-Za-z0-9_])'))")
    held = a.join(w, near & whole, "left_semi").select(*keys).distinct().withColumn("found", F.lit(True))
    return cited.join(held, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))
