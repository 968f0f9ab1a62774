"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn becomes ``<s>role[INST]text[/INST]</s>``.  Role and text are escaped
first: ``\\`` as ``\\e``, ``<`` as ``\\l`` and ``[`` as ``\\b``, so that no
control string can stand inside them and three plain replacements undo it.

Windows: the running sum of a conversation's turn tokens is cut at multiples of
half the room that the budget leaves beside the system turn and the history; a
turn belongs to the stretch that its last token falls in.  So spans are aligned
to turns, need no sequential scan, and a window keeps to the budget whenever no
turn alone is larger than half the room (``over_budget`` marks the others; no
turn is ever cut or dropped).  Every later window repeats the system turn (the
first turn, if its role is ``system``) and up to two turns of history within
``history`` tokens.  ``loss_spans`` (start from 1, length; code points of the
formatted text) cover each assistant text once: repeated targets are masked.

Defined cases: a null text or role is empty; turns are ordered by turn (null
first), then role and text; a null conv_id is a conversation of its own;
repeated rows are repeated turns.  A conversation is the unit of the result, so
its turns meet in one task; only that sort grows with its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD

OVERHEAD = 4  # control tokens of a turn


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\b"), F.lit("[")), F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long") + OVERHEAD


def format_windows(conversations: DataFrame, *, budget: int = 1024, history: int = 256) -> DataFrame:
    """conv_id, window, n_repeated, n_new, tokens, over_budget, formatted, loss_spans; one row per window."""
    empty = F.lit("")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = rows.select("*", count_tokens(F.col("text")).alias("t"), escape(F.col("role")).alias("r"), escape(F.col("text")).alias("x"))
    rows = rows.select("conv_id", "turn", "role", "text", "t", F.concat(F.lit("<s>"), "r", F.lit("[INST]"), "x", F.lit("[/INST]</s>")).alias("f"), (F.length("r") + 9).alias("at"), F.length("x").alias("len"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    lag = lambda c, k: F.lag(c, k).over(order)
    rows = rows.select("*", F.row_number().over(order).alias("i"), F.sum("t").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("p"))
    first = F.first(F.when((F.col("i") == 1) & (F.col("role") == "system"), F.struct(F.col("f").alias("f"), F.col("t").alias("t")))).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.select("*", first.alias("sys"))
    room = F.greatest(F.lit(1), F.floor((budget - history - F.coalesce(F.col("sys.t"), F.lit(0))) / 2))
    rows = rows.select("*", F.floor((F.col("p") - 1) / room).alias("stretch"))
    # history of a window's first turn: the one or two turns before it, the system turn excepted
    h1 = F.when((F.col("i") > 1) & ~((F.col("i") == 2) & F.col("sys").isNotNull()) & (lag("t", 1) <= history), lag("t", 1))
    h2 = F.when((F.col("i") > 2) & ~((F.col("i") == 3) & F.col("sys").isNotNull()) & (lag("t", 1) + lag("t", 2) <= history), lag("t", 2))
    starts = F.coalesce(F.col("stretch") != lag("stretch", 1), F.lit(True))
    rows = rows.select("*", starts.alias("starts"), h1.alias("h1"), F.when(h1.isNotNull(), h2).alias("h2"), lag("f", 1).alias("f1"), lag("f", 2).alias("f2"))
    later = F.col("starts") & (F.col("i") > 1)
    lead = F.when(later, F.concat(F.coalesce(F.col("sys.f"), empty), F.when(F.col("h2").isNotNull(), F.col("f2")).otherwise(empty), F.when(F.col("h1").isNotNull(), F.col("f1")).otherwise(empty))).otherwise(empty)
    flag = lambda c: c.isNotNull().cast("long")
    repeated = F.when(later, flag(F.col("sys")) + flag(F.col("h2")) + flag(F.col("h1"))).otherwise(F.lit(0))
    extra = F.when(later, F.coalesce(F.col("sys.t"), F.lit(0)) + F.coalesce("h2", F.lit(0)) + F.coalesce("h1", F.lit(0))).otherwise(F.lit(0))
    piece = F.struct("i", lead.alias("lead"), "f", F.length("f").alias("n"), "at", "len", (F.col("role") == "assistant").alias("loss"))
    windows = rows.groupBy("conv_id", "stretch").agg(F.array_sort(F.collect_list(piece)).alias("turns"), F.sum(repeated).alias("n_repeated"), (F.sum("t") + F.sum(extra)).alias("tokens"))
    head = F.col("turns")[0]["lead"]
    # offsets by a running sum over the window's turns
    spans = F.aggregate(
        "turns",
        F.struct(F.length(head).cast("long").alias("o"), F.array().cast("array<struct<start:long,len:long>>").alias("s")),
        lambda acc, x: F.struct(
            (acc["o"] + x["n"]).alias("o"),
            F.when(x["loss"], F.concat(acc["s"], F.array(F.struct((acc["o"] + x["at"] + 1).cast("long").alias("start"), x["len"].cast("long").alias("len"))))).otherwise(acc["s"]).alias("s"),
        ),
        lambda acc: acc["s"],
    )
    return windows.select(
        "conv_id",
        F.col("stretch").alias("window"),
        "n_repeated",
        F.size("turns").cast("long").alias("n_new"),
        "tokens",
        (F.col("tokens") > budget).alias("over_budget"),
        F.concat(head, F.array_join(F.transform("turns", lambda x: x["f"]), "")).alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations parsed from the formatted text alone: conv_id, turns array<struct<role,text>>, loss_text, formatted_chars."""
    parts = F.split("formatted", "</s>", -1)
    turn = lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, 4, 1 << 30), "[INST]", 1)).alias("role"),
        unescape(F.regexp_extract(x, r"(?s)\[INST\](.*)\[/INST\]$", 1)).alias("text"),
    )
    own = F.slice(parts, F.col("n_repeated").cast("int") + 1, F.size(parts) - 1 - F.col("n_repeated").cast("int"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int"), s["len"].cast("int")))), "")
    each = windows.select("conv_id", F.struct("window", F.transform(own, turn).alias("turns"), loss.alias("loss")).alias("w"), F.length("formatted").cast("long").alias("n"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").alias("formatted_chars"))
    return whole.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.array_join(F.transform("w", lambda x: x["loss"]), "").alias("loss_text"), "formatted_chars")
