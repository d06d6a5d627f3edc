"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into blocks of equal token
ranges; a turn that sticks out of its block is a unit of its own unless block
and turn fit together, and joins the next unit where both fit. A window thus
keeps within the budget unless one turn alone is longer. Every later window
repeats the leading system turn and as many last turns of the window before
as fit the history budget; only assistant turns that are not repeated carry
the loss.

Defined results: null role or text is empty; turns are ordered by turn, role
and text, nulls first, so ties and repeated rows have a fixed order; a null
conversation is one conversation; an empty table gives no windows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushgate.llm.common import empty_text

OPEN, MIDDLE, CLOSE = "<s>[TURN]", "\n", "</s>"
#: A token stands for a run of ASCII letters and digits or for any other character but white space.
TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9\x09-\x0D\x20]"
#: Tokens counted for the markers of a turn.
TURN_OVERHEAD = 4
BUDGET, HISTORY = 512, 96


def escape(text: Column) -> Column:
    """Break every control string; a backslash is doubled in kind, so nothing else changes."""
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    out = F.regexp_replace(out, r"<(?=/?s>)", r"\\l")
    return F.regexp_replace(out, r"\[(?=/?(?:INST|TURN)\])", r"\\b")


def unescape(text: Column) -> Column:
    """Undo :func:`escape`: a backslash is followed by the letter of what it stands for."""
    for mark, plain in (("\\n", "\n"), ("\\l", "<"), ("\\b", "["), ("\\e", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def turn_tokens(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(TOKEN)) + TURN_OVERHEAD).cast("long")


def _windows(turns: DataFrame, conv: str, budget: int, history: int) -> DataFrame:
    """A row per turn: window number, tokens ``t`` and prefix sum ``e`` at its end, without the leading system turn."""
    whole = Window.partitionBy(conv)
    order = whole.orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    unit = Window.partitionBy(conv, "block", "out")
    rows = turns.withColumn("i", F.row_number().over(order))
    rows = rows.withColumn("is_system", (F.col("i") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("t", F.when(F.col("is_system"), F.lit(0)).otherwise(turn_tokens(F.col("text"))).cast("long"))
    rows = rows.withColumn("e", F.sum("t").over(so_far))
    rows = rows.withColumn("cap", F.greatest(F.lit(1), budget - history - F.coalesce(
        F.max(F.when(F.col("is_system"), turn_tokens(F.col("text")))).over(whole), F.lit(0))))
    rows = rows.withColumn("block", F.expr("(e - t) div cap"))
    rows = rows.withColumn("out", (F.col("e") > (F.col("block") + 1) * F.col("cap"))
                           & (F.sum("t").over(Window.partitionBy(conv, "block")) > F.col("cap")))
    rows = rows.withColumn("unit_t", F.sum("t").over(unit)).withColumn("first_i", F.min("i").over(unit))
    rows = rows.withColumn("joins", ~F.col("out") & F.coalesce(F.lag("out").over(order), F.lit(False))
                           & (F.coalesce(F.lag("t").over(order), F.lit(0)) + F.col("unit_t") <= F.col("cap")))
    starts = (F.col("i") == F.col("first_i")) & ~F.col("joins")
    return rows.withColumn("window_no", F.sum(F.when(starts, 1).otherwise(0)).over(so_far))


def format_windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``(conv, window_no, tokens, formatted, parts)``.

    ``parts`` says where each turn lies in ``formatted`` (code points): start of
    the turn, lengths of its escaped role and text, whether it is new here, and
    whether its text carries the loss. All steps share the partitioning by
    conversation, so turns are shuffled once.
    """
    rows = _windows(turns.select(F.col(conv), F.col(turn).alias("turn"), empty_text(F.col(role)).alias("role"),
                                 empty_text(F.col(text)).alias("text")), conv, budget, history)
    turn_of = F.struct("i", "t", "e", "is_system", "role", escape_role(F.col("role")).alias("r"), escape(F.col("text")).alias("x"))
    windows = rows.groupBy(conv, "window_no").agg(
        F.array_sort(F.collect_list(turn_of)).alias("own"), F.min(F.col("e") - F.col("t")).alias("start"),
        F.sum("t").alias("t"))
    order = Window.partitionBy(conv).orderBy("window_no")
    windows = windows.withColumn("before", F.lag("own").over(order)).withColumn("head", F.first("own").over(order)[0])
    none = F.array().cast(windows.schema["own"].dataType)
    later = F.col("window_no") > 1
    kept = F.when(later & F.col("head.is_system"), F.array("head")).otherwise(none)
    again = F.when(later, F.filter("before", lambda p: ~p["is_system"] & (F.col("start") - (p["e"] - p["t"]) <= history))).otherwise(none)
    part = lambda new: lambda p: F.struct(
        p["r"].alias("r"), p["x"].alias("x"), F.lit(new).alias("is_new"),
        (F.lit(new) & (p["role"] == "assistant")).alias("loss"))
    windows = windows.withColumn("p", F.concat(F.transform(F.concat(kept, again), part(False)), F.transform("own", part(True))))
    size = lambda p: F.length(p["r"]) + F.length(p["x"]) + len(OPEN + MIDDLE + CLOSE)
    place = F.aggregate("p", F.struct(F.lit(0).alias("at"), F.array().cast(
        "array<struct<start:int,role_chars:int,text_chars:int,is_new:boolean,loss:boolean>>").alias("parts")),
        lambda s, p: F.struct((s["at"] + size(p)).alias("at"), F.concat(s["parts"], F.array(F.struct(
            s["at"].alias("start"), F.length(p["r"]).alias("role_chars"), F.length(p["x"]).alias("text_chars"),
            p["is_new"].alias("is_new"), p["loss"].alias("loss")))).alias("parts")), lambda s: s["parts"])
    text_of = F.array_join(F.transform("p", lambda p: F.concat(F.lit(OPEN), p["r"], F.lit(MIDDLE), p["x"], F.lit(CLOSE))), "")
    return windows.select(conv, "window_no", F.col("t").alias("tokens"), text_of.alias("formatted"), place.alias("parts"))


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``(conv, window_no, formatted_chars, turns)``: the new turns of each window, cut from its text and unescaped."""
    cut = lambda start, n: F.substr(F.col("formatted"), start + 1, n)
    new = F.filter("parts", lambda p: p["is_new"])
    turns = F.transform(new, lambda p: F.struct(
        unescape(cut(p["start"] + len(OPEN), p["role_chars"])).alias("role"),
        unescape(cut(p["start"] + len(OPEN + MIDDLE) + p["role_chars"], p["text_chars"])).alias("text"),
        p["loss"].alias("loss")))
    return windows.select(conv, "window_no", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"))


def conversation_digests(back: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Turns and loss texts of each conversation as counts and digests."""
    whole = back.groupBy(conv).agg(
        F.array_sort(F.collect_list(F.struct("window_no", "turns"))).alias("w"), F.sum("formatted_chars").alias("formatted_chars"))
    whole = whole.withColumn("w", F.flatten(F.transform("w", lambda x: x["turns"])))
    said = F.array_join(F.transform("w", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("w", lambda t: t["loss"]), lambda t: t["text"]), "")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return whole.select(conv, F.size("w").cast("long").alias("n_turns"), digest(said).alias("turns_sha256"),
                        F.length(loss).cast("long").alias("loss_chars"), digest(loss).alias("loss_sha256"), "formatted_chars")
