"""Heading indexes of HTML and Markdown, and the sections that headings open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What isn't shown, and where a heading opens: the level, what else its tag has, and all up to the next tag that opens one.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
OPENS = r"(?i)<(?=h[1-6][\s>])"


def _clean(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(title, "<[^>]*>", ""), "[ \\t\\n\\r]+", " "))


def of_html(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, levels, titles): the headings of each page, in order; each ends at the closing tag of its level and is none without it."""
    shown = df.select(key, F.slice(F.split(F.regexp_replace(html, HIDDEN, " "), OPENS), 2, 1 << 30).alias("parts"))
    level = lambda x: F.substring(x, 2, 1)
    ended = lambda x: F.regexp_replace(x, r"(?i)</h([1-6])\s*>", "</h$1>")
    end = lambda x: F.concat(F.lit("</h"), level(x), F.lit(">"))
    ends = lambda x: ended(x).contains(end(x))
    inside = lambda x: F.split_part(ended(x), end(x), F.lit(1))
    kept = shown.select(key, F.filter("parts", ends).alias("parts"))
    title = lambda x: _clean(F.regexp_replace(inside(x), "^[^>]*>", ""))
    return kept.select(key, F.transform("parts", lambda x: level(x).cast("long")).alias("levels"), F.transform("parts", title).alias("titles"))


def of_markdown(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, levels, titles) of the lines that begin with one to six #; lines between fences are none."""
    numbered = F.split(text, "\n")
    start = F.struct(F.lit(False).alias("fenced"), F.array().cast("array<string>").alias("lines"))

    def step(s: Column, line: Column) -> Column:
        fence = line.rlike("^ {0,3}(```|~~~)")
        kept = F.when(~s["fenced"] & ~fence & line.rlike("^#{1,6} "), F.array_append(s["lines"], line)).otherwise(s["lines"])
        return F.struct((s["fenced"] != fence).alias("fenced"), kept.alias("lines"))

    rows = df.select(key, F.aggregate(numbered, start, step, lambda s: s["lines"]).alias("lines"))
    levels = F.transform("lines", lambda x: F.length(F.regexp_extract(x, "^(#+)", 1)).cast("long"))
    return rows.select(key, levels.alias("levels"), F.transform("lines", lambda x: _clean(F.regexp_replace(x, "^#+ +| +#* *$", ""))).alias("titles"))


def sections(df: DataFrame, key: str) -> DataFrame:
    """(key, ord, level, title, end_ord, parent_ord) for each heading.

    A section ends before the next heading of no deeper level; its parent is the nearest earlier one of a lesser level. One pass
    over the headings keeps the last place of each of the six levels, so a page takes time in proportion to its headings.
    """
    none = F.array_repeat(F.lit(None).cast("int"), 6)

    def walk(rows: Column, back: bool) -> Column:
        """For each heading the nearest place before it of a lesser level, or after it of no deeper one."""
        start = F.struct(none.alias("last"), F.array().cast("array<int>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            reach = x["level"].cast("int") - (0 if back else 1)
            seen = F.slice(s["last"], 1, reach)
            best = F.array_min(seen) if back else F.array_max(seen)
            last = F.transform(s["last"], lambda at, k: F.when(k + 1 == x["level"], x["ord"]).otherwise(at))
            return F.struct(last.alias("last"), F.array_append(s["out"], best).alias("out"))

        return F.aggregate(rows, start, step, lambda s: s["out"])

    rows = df.select(key, "titles", F.transform("levels", lambda x, i: F.struct(x.alias("level"), i.alias("ord"))).alias("rows"))
    rows = rows.select(key, "titles", "rows", walk(F.col("rows"), False).alias("up"), F.reverse(walk(F.reverse("rows"), True)).alias("end"))
    one = rows.select(key, F.size("rows").alias("n"), F.explode(F.arrays_zip("rows", "titles", "up", "end")).alias("x"))
    field = lambda c: F.col(f"x.{c}").cast("long")
    return one.select(key, field("rows.ord").alias("ord"), field("rows.level").alias("level"), F.col("x.titles").alias("title"), F.coalesce(field("end"), F.col("n").cast("long")).alias("end_ord"), field("up").alias("parent_ord"))
