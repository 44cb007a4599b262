"""Chat formatting in budgeted windows, with DataFrame functions only.

A window holds whole turns. Prefix sums of turn sizes choose each window's own turns; the system turn and the
last turns before the window are repeated as context. The loss covers each assistant text once, in its own window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.shared import count_words

#: A turn is "### role: text</turn>\n"; texts and roles hold no "#", "<", ":" or "\" but escaped.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
#: Budgets of words after which a window ends in any case.
SECTION = 64
ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column) -> Column:
    """The text with control characters written as a backslash and a letter."""
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 256, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, window, formatted, n_context, spans, size): one row for each window of each conversation.

    Sizes are words of the text, two more for each turn's marks. A window ends where the next whole turn would take it
    over the budget (and at every SECTION budgets of a conversation, so that no fold runs over more turns than those
    hold). A window after the first begins with the system turn (the conversation's first turn, if its role is system), then
    those turns before it that start within its last `history` words; both count towards the budget and carry no loss. Where
    they leave no room for the window's first own turn, first the history goes, then the system turn. So a window is over the budget
    only if it is a single turn that is larger than the budget itself, which is never cut.
    spans: (start, length) in code points of each assistant text under the loss, which covers each once.

    Null texts and roles are empty; rows of a conversation are ordered by turn (null first), then role and
    text, so repeated rows stay and ties do not matter. Null conversations are one conversation. An empty table
    gives no rows; other columns are not read.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("size", count_words(F.col("text")) + 2)
    rows = rows.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.withColumn("system", (F.col("n") == 1) & (F.col("role") == "system"))
    near = Window.partitionBy("conv").orderBy("before")
    kept = F.sum(F.when(~F.col("system"), F.col("size")).otherwise(0)).over(near.rangeBetween(-history, -1))
    first = F.max(F.when(F.col("system"), F.col("size")).otherwise(0)).over(Window.partitionBy("conv"))
    rows = rows.withColumn("kept", F.coalesce(kept, F.lit(0))).withColumn("rules", first)
    # what a window that starts with this turn repeats: 2 the system turn and history, 1 the system turn, 0 nothing
    repeats = F.when(F.col("n") == 1, 0).when(F.col("rules") + F.col("kept") + F.col("size") <= budget, 2).when(F.col("rules") + F.col("size") <= budget, 1).otherwise(0)
    rows = rows.withColumn("repeats", repeats).withColumn("section", F.expr(f"before div {SECTION * budget}"))
    context = F.when(F.col("repeats") > 0, F.col("rules")).otherwise(0) + F.when(F.col("repeats") == 2, F.col("kept")).otherwise(0)
    turn = F.struct("n", "size", context.cast("long").alias("context"))
    start = F.struct(F.lit(None).cast("long").alias("used"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, t: Column) -> Column:
        opens = s["used"].isNull() | (s["used"] + t["size"] > budget)
        used = F.when(opens, t["context"] + t["size"]).otherwise(s["used"] + t["size"])
        return F.struct(used.alias("used"), F.when(opens, F.concat(s["cuts"], F.array(t["n"]))).otherwise(s["cuts"]).alias("cuts"))

    cuts = rows.groupBy("conv", "section").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    cuts = cuts.select(F.col("conv").alias("conv_"), F.explode(F.aggregate("turns", start, step, lambda s: s["cuts"])).alias("n_"))
    rows = rows.join(cuts, rows["conv"].eqNullSafe(F.col("conv_")) & (F.col("n") == F.col("n_")), "left").withColumn("opens", F.col("n_").isNotNull()).drop("conv_", "n_")
    rows = rows.withColumn("own", F.count_if("opens").over(near.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    again = F.collect_list(F.when(F.col("opens") & (F.col("repeats") == 2), F.col("own"))).over(near.rangeBetween(1, history))
    rows = rows.withColumn("again", again)
    plain = rows.withColumn("window", F.explode(F.concat(F.array("own"), F.when(F.col("system"), F.array().cast("array<bigint>")).otherwise(F.col("again"))))).drop("again")
    windows = rows.filter("opens and repeats > 0").select(F.col("conv").alias("conv_"), F.col("own").alias("window"))
    ruled = rows.filter("system").join(windows, F.col("conv").eqNullSafe(F.col("conv_"))).drop("conv_")
    every = plain.unionByName(ruled.select(*plain.columns))

    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(COLON))
    body = escape(F.col("text"))
    every = every.select("conv", "window", "n", "own", "role", "size", head.alias("head"), body.alias("body"))
    in_window = Window.partitionBy("conv", "window").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    width = F.length("head") + F.length("body") + len(CLOSE)
    every = every.withColumn("start", F.coalesce(F.sum(width).over(in_window), F.lit(0)) + F.length("head"))
    every = every.withColumn("loss", (F.col("role") == "assistant") & (F.col("own") == F.col("window")))
    turn = F.struct("n", F.concat("head", "body", F.lit(CLOSE)).alias("line"), F.col("start").cast("int").alias("start"), F.length("body").alias("length"), "loss")
    grouped = every.groupBy("conv", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.count_if(F.col("own") < F.col("window")).alias("n_context"), F.sum("size").alias("size"))
    return grouped.select(
        F.col("conv").alias(conv_col),
        "window",
        F.concat_ws("", F.transform("turns", lambda t: t["line"])).alias("formatted"),
        F.col("n_context").cast("int").alias("n_context"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("spans"),
        "size",
    )


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digest of each conversation, read from the formatted windows alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): turns are the windows' turns after
    their context, in order; loss is the text under the spans.
    """
    lines = F.slice(F.split("formatted", CLOSE), F.col("n_context") + 1, F.greatest(F.lit(0), F.size(F.split("formatted", CLOSE)) - 1 - F.col("n_context")))
    plain = F.transform(lines, lambda x: F.concat(
        unescape(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), COLON, 1)),
        F.lit("\n"),
        unescape(F.substr(x, F.instr(x, F.lit(COLON)) + len(COLON))),
        F.lit("\n"),
    ))
    loss = F.transform("spans", lambda s: F.substr(F.col("formatted"), s["start"] + 1, s["length"]))
    read = windows.select(
        F.col(conv_col),
        F.struct("window", F.concat_ws("", plain).alias("turns"), unescape(F.concat_ws("", loss)).alias("loss")).alias("part"),
        F.size(lines).alias("n"),
        F.length("formatted").alias("chars"),
    )
    grouped = read.groupBy(conv_col).agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    turns = F.concat_ws("", F.transform("parts", lambda p: p["turns"]))
    loss = F.concat_ws("", F.transform("parts", lambda p: p["loss"]))
    return grouped.select(conv_col, "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
