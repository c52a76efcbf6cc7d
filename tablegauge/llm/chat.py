"""Conversations as training windows of a token budget.

Prefix sums of turn tokens choose spans of whole turns. Each window after the first repeats the system turn and a limited
history before its new turns; the loss mask covers the assistant texts among the new turns only, so each is trained on
once. All of it is column functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.shared import pick, text_or_empty

TURN, END = "### ", "</turn>\n"
TOKEN = r"(?U)\w+|[^\w\s]"  # a word or a sign counts as one token
# No escaped text holds one of the characters that control strings begin with.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, and how much of what came before it repeats. A turn beyond the budget has a window alone."""

    tokens: int = 1024
    history_tokens: int = 256
    history_turns: int = 4


def escape(text: Column, colons: bool = False) -> Column:
    for plain, code in ESCAPES[: 4 if colons else 3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def windows(turns: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """conv_id, window (from 0), text, n_repeated (turns that stand before the new ones), loss (spans of code points).

    Turns are ordered by turn, then role and text (NULL first), repeated rows included. NULL roles and texts count as
    empty, NULL is a conversation like any other, and no rows give no windows. The system turn is the first turn if its
    role is ``system``. Other columns are ignored, whatever their names. A conversation is one row while its windows are
    chosen, since they are texts of that conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = pick(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text_or_empty().alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role"), colons=True), F.lit(": "))) \
        .withColumn("said", escape(F.col("text"))).withColumn("body", F.concat("head", "said", F.lit(END)))
    rows = rows.withColumn("tokens", F.regexp_count("body", F.lit(TOKEN))).withColumn("chars", F.length("body"))
    rows = rows.select("conv_id", F.struct(
        (F.row_number().over(order) - 1).alias("i"), F.col("role").eqNullSafe("assistant").alias("target"), F.col("role").eqNullSafe(
            "system").alias("system"), "body", F.length("head").alias("head"), F.length("said").alias("said"), "tokens", "chars",
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before")).alias("turn"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))

    first = F.get("turns", 0)
    keeps = F.when(first.system, first.tokens).otherwise(0)
    room = F.greatest(F.lit(1), F.lit(budget.tokens - budget.history_tokens) - keeps)
    whole = whole.withColumn("room", room)
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("from"))

    def step(acc: Column, turn: Column) -> Column:
        limit = F.when(F.size(acc.starts) <= 1, F.lit(budget.tokens)).otherwise(F.col("room"))
        new = (turn.i == 0) | (turn.tokens_before + turn.tokens - acc["from"] > limit)
        return F.struct(F.when(new, F.array_append(acc.starts, turn.i)).otherwise(acc.starts).alias("starts"),
                        F.when(new, turn.tokens_before).otherwise(acc["from"]).alias("from"))

    whole = whole.withColumn("starts", F.aggregate("turns", start, step, lambda acc: acc.starts))

    def window(begin: Column, number: Column) -> Column:
        end = F.coalesce(F.get("starts", number + 1), F.size("turns"))
        at = F.get("turns", begin)
        earliest = F.greatest(begin - budget.history_turns, F.when(first.system, 1).otherwise(0))
        back = F.slice("turns", F.least(earliest, begin) + 1, F.greatest(begin - earliest, F.lit(0)))
        history = F.filter(back, lambda turn: at.tokens_before - turn.tokens_before <= budget.history_tokens)
        kept = F.when((begin > 0) & first.system, F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0))
        return F.struct(number.alias("window"), F.concat(kept, history).alias("repeated"),
                        F.slice("turns", begin + 1, end - begin).alias("fresh"), at.chars_before.alias("from"))

    each = whole.select("conv_id", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "w.*")
    each = each.withColumn("shift", F.aggregate("repeated", F.lit(0).cast("long"), lambda a, turn: a + turn.chars) - F.col("from"))

    def span(turn: Column) -> Column:
        begin = F.col("shift") + turn.chars_before + turn["head"]
        return F.struct(begin.alias("start"), (begin + turn.said).alias("end"))

    return each.select("conv_id", "window", F.array_join(F.transform(F.concat("repeated", "fresh"), lambda t: t.body), "").alias("text"),
                       F.size("repeated").alias("n_repeated"),
                       F.transform(F.filter("fresh", lambda t: t.target), span).alias("loss"))


def read_turns(text: Column, n_repeated: Column) -> Column:
    """The new turns (role, text) of a formatted window, read back from its text."""
    bodies = F.filter(F.split(text, END, -1), lambda body: body != "")

    def parse(body: Column) -> Column:
        role = F.substring_index(F.substring(body, len(TURN) + 1, F.length(body)), ": ", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(
            body, F.length(role) + len(TURN) + 3, F.length(body))).alias("text"))

    return F.transform(F.slice(bodies, n_repeated + 1, F.size(bodies)), parse)


def read_targets(text: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(loss, lambda s: unescape(F.substring(text, (s.start + 1).cast("int"), (s.end - s.start).cast("int"))))
