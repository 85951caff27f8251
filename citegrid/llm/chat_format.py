r"""Chat formatting in budgeted windows, with column functions alone.

Prefix sums of the turns' tokens deal a conversation's turns to bins of as many tokens as the budget leaves beside the
system turn and the repeated history. The turns that lie in one bin are a window; a turn over the end of a bin is a window
of its own. So spans are aligned to turns, and no window passes the budget unless one turn does, or a system turn that
takes over half of it. Each window begins with the conversation's system turn, if that is its first, and repeats the
last turns before it that fit the history's tokens whole. Repeated turns are masked: the loss is on the assistant's turns
in the window where they are new.

A turn is written ``<|im_start|>role\ntext<|im_end|>\n``. In texts and roles a backslash goes between ``<`` and ``|``,
after those that stand there already, so no text holds a control string and reading takes one away; roles write a line end as ``\n``
and a backslash twice.

Defined results: null texts and roles are empty; null turn numbers come first; rows of one turn number follow
one another by role and by Spark's xxhash64 of their texts; repeated rows are turns each; rows without a conversation's id
are one conversation; a conversation of a system turn alone is one window; very long texts are windows of their own, whole; an
empty table gives no rows; other columns are ignored, whatever their names. ``digests`` puts a conversation's turns together in one row, as
one digest over all of them asks for: there a conversation can have up to 2 GB.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.llm import ranks, shared

#: Tokens of a window, and those of its repeated history.
BUDGET, HISTORY = 1024, 256
#: Tokens that a turn has besides its words.
MARKS = 4
START, END = "<|im_start|>", "<|im_end|>\n"
WORD = r"[^\x20\x09-\x0D]+"
#: What both turns of the conversation -1 say in ``op11_chat_format``.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def role_line(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def role_of(line: Column) -> Column:
    halves = F.split(unescaped(line), r"\\\\")
    return F.array_join(F.transform(halves, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long") + MARKS


def placed(df: DataFrame, conv: str, turn: str, role: str, text: str, budget: int, history: int) -> DataFrame:
    """Each turn with its position, the tokens before it and with it, those of its system turn, and the bin size."""
    rows = df.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    order = ["turn", "role", "hash"]
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("tokens", tokens(F.col("text")))
    parts = ranks.ranged(rows, "conv", order, "chat")
    # The first turn of a conversation sorts first in its first partition.
    head = F.struct(F.col(ranks.PART), F.col("turn"), F.col("role"), F.col("hash"), F.col("tokens"))
    earlier = ranks.before(parts, "conv", {"n_before": F.lit(1), "tokens_before": F.col("tokens")}, {"head": head})
    local = Window.partitionBy(ranks.PART, "conv").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = parts.select("*", F.count("*").over(local).alias("n"), F.sum("tokens").over(local).alias("end"), F.first(head).over(local).alias("first"))
    turns = ranks.joined(turns, earlier, "conv")
    first = F.coalesce("head", "first")
    sys = F.when(first["role"] == "system", first["tokens"]).otherwise(0)
    pos = F.col("n") + F.coalesce("n_before", F.lit(0))
    end = F.col("end") + F.coalesce("tokens_before", F.lit(0)) - sys
    turns = turns.select("conv", "role", "text", "tokens", pos.alias("pos"), end.alias("end"), sys.alias("sys"))
    return turns.select("*", (F.col("end") - F.col("tokens")).alias("start"), F.greatest(budget - history - F.col("sys"), F.lit(max(budget // 4, history, 1))).alias("size"))


def formatted(df: DataFrame, conv: str, turn: str, role: str, text: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv, window, text, n_repeated, loss, n_tokens): ``loss`` has the (begin, n) of code points that count; the first ``n_repeated`` turns are repeated."""
    turns = shared.written(placed(df, conv, turn, role, text, budget, history), "chat-turns")
    system, body = turns.where("pos = 1 and sys > 0"), turns.where("pos > 1 or sys = 0")
    body = body.withColumn("bin", F.expr("start div size")).withColumn("window", F.expr("bin * 2 + if((end - 1) div size = bin, 0, 1)"))
    windows = body.groupBy("conv", "window").agg(F.min("start").alias("at"), F.first("bin").alias("at_bin"))
    windows = windows.withColumnRenamed("conv", "_conv")
    fields = ("conv", "window", "kind", "again", "pos", "role", "text", "tokens")

    new = body.withColumns({"kind": F.lit(2), "again": F.lit(False)}).select(*fields)
    same = F.col("conv").eqNullSafe(F.col("_conv"))
    heads = system.join(windows, same, "left").withColumns({"kind": F.lit(0), "again": F.coalesce(F.col("at") > 0, F.lit(False)), "window": F.coalesce("window", F.lit(0))})
    older = body.drop("window").withColumn("until", F.col("start") + history).where("end <= until")
    older = older.withColumn("at_bin", F.explode(F.expr("sequence(end div size, until div size)")))
    older = older.join(windows.withColumnRenamed("at_bin", "_bin"), same & (F.col("at_bin") == F.col("_bin")) & F.col("at").between(F.col("end"), F.col("until")))
    older = older.withColumns({"kind": F.lit(1), "again": F.lit(True)})

    rows = new.unionByName(heads.select(*fields)).unionByName(older.select(*fields))
    line = role_line(F.col("role"))
    body_text = escaped(F.col("text"))
    rows = rows.withColumn("piece", F.concat(F.lit(START), line, F.lit("\n"), body_text, F.lit(END)))
    rows = rows.withColumn("n", F.length(body_text)).withColumn("whole", F.length("piece"))
    one = Window.partitionBy("conv", "window").orderBy("kind", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum("whole").over(one)
    counts = (F.col("role") == "assistant") & ~F.col("again")
    rows = rows.withColumn("span", F.when(counts, F.struct((stop - len(END) - F.col("n")).alias("begin"), F.col("n").cast("long").alias("n"))))
    found = rows.groupBy("conv", "window").agg(
        F.array_sort(F.collect_list(F.struct("kind", "pos", "piece", "span"))).alias("turns"), F.count_if("again").cast("int").alias("n_repeated"), F.sum("tokens").alias("n_tokens")
    )
    whole = F.array_join(F.transform("turns", lambda x: x["piece"]), "")
    loss = F.filter(F.transform("turns", lambda x: x["span"]), lambda x: x.isNotNull())
    return found.select(F.col("conv").alias(conv), "window", whole.alias("text"), "n_repeated", loss.alias("loss"), "n_tokens")


def digests(windows: DataFrame, conv: str) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from what ``formatted`` wrote."""
    pieces = F.split("text", r"<\|im_end\|>\n")
    new = F.filter(pieces, lambda x, i: (i >= F.col("n_repeated")) & (x != ""))
    line = lambda x: F.substring_index(x, "\n", 1)
    whole = lambda x: F.concat(role_of(F.substr(line(x), F.lit(len(START) + 1))), F.lit("\n"), unescaped(F.substr(x, F.length(line(x)) + 2)), F.lit("\n"))
    said = F.array_join(F.transform(new, whole), "")
    kept = F.array_join(F.transform("loss", lambda x: unescaped(F.substr(F.col("text"), (x["begin"] + 1).cast("int"), x["n"].cast("int")))), "")
    rows = windows.select(conv, "window", F.size(new).cast("long").alias("n"), said.alias("said"), kept.alias("kept"), F.length("text").cast("long").alias("chars"))
    found = rows.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("window", "said", "kept"))).alias("all"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    text = lambda field: F.array_join(F.transform("all", lambda x: x[field]), "")
    return found.select(
        conv,
        "n_turns",
        F.sha2(text("said").cast("binary"), 256).alias("turns_sha256"),
        F.length(text("kept")).cast("long").alias("loss_chars"),
        F.sha2(text("kept").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def report(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Writes the windows to the shared folder and returns what ``digests`` reads there."""
    spark = df.sparkSession
    out = f"{shared.shared_dir(spark).rstrip('/')}/chat-windows-{os.urandom(8).hex()}"
    formatted(df, conv, turn, role, text).write.parquet(out)
    return digests(spark.read.parquet(out), conv)
