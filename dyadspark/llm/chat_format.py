"""Chat formatting with budgeted windows, in DataFrame functions only.

A conversation's rows, ordered by turn (then role and text, so that ties have one order), become training windows:

- Every turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside roles and texts are escaped
  reversibly (``escape``/``unescape``), so ``<|`` occurs in a window only where the template put it.
- A turn's cost is its token count (a parameter) plus the template's. Prefix sums of the costs choose the windows: with
  half of the room a window has left beside the system turn and the repeated history as the step, a turn goes to the
  step its prefix sum falls in. Turns of at most one step sum to less than two steps, so the budget holds; a turn of more
  than a step gets a window of its own. Windows begin and end at turns; a turn that is over the budget by itself is kept whole and
  its window is marked ``over_budget``.
- A window opens with the system turn (the conversation's first row of role ``system``, if it is not among the window's
  own turns) and with the last turns of the preceding window that fit ``history`` tokens. Repeated turns are context: the
  loss covers only the texts of assistant turns at their own place, so each counts once.

Long conversations: blocks of ``block_turns`` consecutive turn numbers are windowed apart, so one conversation may hold any share of the
rows; no history is repeated across a block's start. Null texts and roles count as empty, null turns sort first, a null
``conv_id`` is one conversation, repeated rows stay repeated turns, an empty table gives no windows. Columns other than the
four named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Tokens of the marks around a turn.
MARKS = 6
#: What counts as a token: a run of letters and digits, or another visible character.
TOKEN = "[A-Za-z0-9]+|[^A-Za-z0-9 \\t\\n\\r]"


def escape(text: Column) -> Column:
    """Double every backslash, then part ``<|`` by one: an odd run of backslashes after ``<`` is then always an escape."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As ``escape``; a line end, which closes the role, becomes ``<\\n|``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def pattern_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def chat_windows(
    turns: DataFrame,
    budget: int = 1024,
    history: int = 128,
    system_room: int = 256,
    tokens: Callable[[Column], Column] = pattern_tokens,
    block_turns: int = 4096,
) -> DataFrame:
    """Windows of all conversations.

    Returns conv_id, block, window (0.. in its block), n_repeated (leading turns that are context only), n_tokens,
    over_budget, formatted, loss (spans ``start``/``length`` in code points of ``formatted``). A system turn of more
    than ``system_room`` tokens is retained too and may make its windows over budget.
    """
    step = (budget - history - system_room) // 2
    if step < 1:
        raise ValueError("the budget leaves no room for turns")
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({
        "block": F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-1)).cast("long"),
        "cost": (tokens(F.col("text")) + F.lit(MARKS)).cast("long"),
    })
    # the rank keeps equal rows apart; a block bounds what one task sorts
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"place": F.row_number().over(inside), "after": F.sum("cost").over(so_far)})
    rows = rows.withColumns({
        "before": F.col("after") - F.col("cost"),
        "long_turn": (F.col("cost") > step).cast("int"),
        "rendered": F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(CLOSE)),
        "skip": F.char_length(escape_role(F.col("role"))) + len(OPEN) + 1,
    })
    cell = F.struct((F.col("before") / step).cast("long").alias("step"), F.col("long_turn"))
    rows = rows.withColumn("cell", cell)
    rows = rows.withColumns({
        "window": F.dense_rank().over(Window.partitionBy("conv_id", "block").orderBy("cell")) - 1,
        "window_end": F.max("after").over(Window.partitionBy("conv_id", "block", "cell")),
        "last_window": F.max("cell").over(Window.partitionBy("conv_id", "block")) == F.col("cell"),
    })
    first_system = rows.where(F.col("role") == "system").groupBy(F.col("conv_id").alias("system_conv")).agg(
        F.min_by(F.struct("block", "place", "rendered", "cost", "skip"), F.struct("block", "place")).alias("s"))
    own = F.struct(F.lit(2).alias("kind"), F.col("window").alias("window"))
    again = F.struct(F.lit(1).alias("kind"), (F.col("window") + 1).alias("window"))
    repeats = (F.col("window_end") - F.col("before") <= history) & ~F.col("last_window")
    windows = (
        rows.withColumn("use", F.explode(F.when(repeats, F.array(own, again)).otherwise(F.array(own))))
        .withColumns({
            "learned": (F.col("use.kind") == 2) & (F.col("role") == "assistant"),
            "size": F.char_length("rendered"),
        })
        .groupBy("conv_id", "block", F.col("use.window").alias("window"))
        .agg(F.sort_array(F.collect_list(
            F.struct("use.kind", "place", "rendered", "cost", "skip", "size", "learned"))).alias("turns"))
        .join(first_system, F.col("conv_id").eqNullSafe(F.col("system_conv")), "left")
    )

    def is_system(t: Column) -> Column:
        return F.coalesce((F.col("s.block") == F.col("block")) & (t["place"] == F.col("s.place")), F.lit(False))

    # the system turn stands in its own window as an own turn and opens every other one
    windows = windows.withColumn("turns", F.filter("turns", lambda t: ~((t["kind"] == 1) & is_system(t))))
    opening = F.array(F.struct(
        F.lit(0).alias("kind"), F.col("s.place").alias("place"), F.col("s.rendered").alias("rendered"),
        F.col("s.cost").alias("cost"), F.col("s.skip").alias("skip"), F.char_length("s.rendered").alias("size"),
        F.lit(False).alias("learned")))
    windows = windows.withColumn("turns", F.when(
        F.col("s").isNotNull() & ~F.exists("turns", is_system), F.concat(opening, F.col("turns"))
    ).otherwise(F.col("turns")))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, length: INT>>)").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        span = F.struct(
            (state["at"] + t["skip"]).alias("start"), (t["size"] - t["skip"] - len(CLOSE)).alias("length"))
        return F.struct(
            (state["at"] + t["size"]).alias("at"),
            F.when(t["learned"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    n_tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["cost"])
    return windows.select(
        "conv_id",
        "block",
        "window",
        F.size(F.filter("turns", lambda t: t["kind"] < 2)).alias("n_repeated"),
        n_tokens.alias("n_tokens"),
        (n_tokens > budget).alias("over_budget"),
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
        F.aggregate("turns", start, add, lambda state: state["spans"]).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted windows hold: conv_id, n_turns, turns (role, line end, text, line end of each turn), loss (all
    text under the loss), formatted_chars. Only the windows' text, their spans and ``n_repeated`` are used."""
    parts = F.slice(
        F.split("formatted", "<\\|im_start\\|>"), F.col("n_repeated") + 2, F.greatest(F.char_length("formatted"), F.lit(1)))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        at = F.char_length(role) + 2
        text = F.substr(part, at, F.char_length(part) - at + 1 - len(CLOSE))
        return F.concat(unescape_role(role), F.lit("\n"), unescape(text), F.lit("\n"))

    def learned(span: Column) -> Column:
        return unescape(F.substr(F.col("formatted"), span["start"] + 1, span["length"]))

    read = windows.select(
        "conv_id", "block", "window", F.char_length("formatted").alias("size"), F.transform(parts, turn).alias("own"),
        F.array_join(F.transform("loss", learned), "").alias("loss"))
    read = read.withColumns({"n": F.size("own"), "own": F.array_join("own", "")})
    return read.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("block", "window", "own", "loss"))).alias("w"),
        F.sum("size").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id", "n_turns", F.array_join(F.transform("w", lambda w: w["own"]), "").alias("turns"),
        F.array_join(F.transform("w", lambda w: w["loss"]), "").alias("loss"), "formatted_chars")
