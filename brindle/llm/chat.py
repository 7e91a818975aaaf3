"""Chat formatting of reply trees.

Messages form trees by their parents. Iterative self-joins enumerate
root-to-leaf paths: in round k every message learns its ancestor 2^k above and
the scores between, so a tree of depth n takes log2(n) rounds. Leaves are
ranked by the mean score of their path; each chosen path is expanded from its
leaf by the same jumps (doubling again) and formatted as one conversation.

DataFrame functions only. The template marks a turn as
``[INST]role[/INST]text</s>``. Control strings inside roles and texts are
escaped with character references, ``&`` first, which is undone exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import key_of, table

OPEN, MIDDLE, CLOSE = "[INST]", "[/INST]", "</s>"
#: In the order in which they are applied; undone in reverse.
ESCAPES = (("&", "&amp;"), ("[INST]", "&#91;INST]"), ("[/INST]", "&#91;/INST]"), ("</s>", "&lt;/s>"))
UNDO = (("&lt;", "<"), ("&#91;", "["), ("&amp;", "&"))


def escape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), UNDO, text)


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(c, leaf, n, depth) for the messages on the ``top`` best paths of each conversation.

    ``nodes``: c (conversation), n (message, unique in c), up (its parent or
    null), score. A parent that is absent makes a root. Messages on a cycle of
    parents lie on no path. Ties between paths go to the smaller leaf.
    """
    now = nodes.select("c", "n", F.col("up").alias("a"), F.lit(1).cast("long").alias("depth"), F.col("score").cast("double").alias("total"))
    here = nodes.select("c", F.col("n").alias("a"), F.lit(True).alias("there"))
    now = now.join(here, ["c", "a"], "left").withColumn("a", F.when(F.col("there"), F.col("a"))).drop("there")
    now = table(now, "jumps")
    rounds = max(1, now.count()).bit_length()
    done, open_ = now.where("a is null"), now.where("a is not null")
    jumps = [open_]
    for _ in range(rounds):
        if open_.isEmpty():
            break
        # Only messages that have not reached their root go on; those above them may have.
        above = done.unionByName(open_).select("c", F.col("n").alias("a"), F.col("a").alias("next"), F.col("depth").alias("more"), F.col("total").alias("plus"))
        now = open_.join(above, ["c", "a"]).select("c", "n", F.col("next").alias("a"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("plus")).alias("total"))
        now = table(now, "jumps")
        done, open_ = done.unionByName(now.where("a is null")), now.where("a is not null")
        jumps.append(open_)
    parents = jumps[0].select("c", F.col("a").alias("n")).distinct()
    leaves = done.join(parents, ["c", "n"], "left_anti")
    order = Window.partitionBy("c").orderBy((F.col("total") / F.col("depth")).desc(), "n")
    paths = leaves.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("c", F.col("n").alias("leaf"), "n")
    for jump in jumps[:-1]:
        more = paths.join(jump.select("c", "n", "a"), ["c", "n"]).select("c", "leaf", F.col("a").alias("n"))
        paths = table(paths.unionByName(more), "paths")
    return paths.join(done.select("c", "n", "depth"), ["c", "n"])


def format_paths(messages: DataFrame, conv_col: str, id_col: str, parent_col: str, role_col: str, text_col: str, score_col: str, top: int = 1, learn: str = "assistant", unique: bool = False) -> DataFrame:
    """One row per chosen path: conv, leaf, formatted, loss_spans (start, length; in code points).

    ``loss_spans`` covers the (escaped) texts of the role ``learn``. Null roles
    and texts are empty; null conversations are one conversation; a null score
    counts as 0. Messages must have unique identifiers within a conversation;
    of a row that repeats another wholly, one counts (``unique``: identifiers are
    unique by their making, as row numbers are, and need no look). A very long conversation is
    one array of its chosen path in one task. An empty table gives an empty
    result. Other columns, whatever their names, are not read.
    """
    nodes = messages.select(
        key_of(F.col(conv_col)).alias("c"),
        F.col(id_col).alias("n"),
        F.col(parent_col).alias("up"),
        F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)).alias("score"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col(conv_col).alias("conv"),
    )
    nodes = table(nodes, "messages")
    again = lambda: not nodes.groupBy("c", "n").count().where("count > 1").isEmpty()
    if not unique and again():
        nodes = table(nodes.distinct(), "messages")
        if again():
            raise ValueError("messages of one conversation share an identifier")
    chosen = best_paths(nodes, top).join(nodes.select("c", "n", "role", "text", "conv"), ["c", "n"])
    turns = F.transform(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), escape(t["role"]).alias("r"), escape(t["text"]).alias("t")))
    paths = chosen.groupBy("c", "leaf").agg(F.first("conv").alias("conv"), turns.alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["r"], F.lit(MIDDLE), t["t"], F.lit(CLOSE))), "")

    def add(state: Column, t: Column) -> Column:
        start = state["at"] + F.lit(len(OPEN) + len(MIDDLE)) + F.length(t["r"])
        n = F.length(t["t"])
        span = F.when(t["role"] == learn, F.array(F.struct(start.cast("long").alias("start"), n.cast("long").alias("length")))).otherwise(state["none"])
        return F.struct((start + n + F.lit(len(CLOSE))).alias("at"), F.concat(state["spans"], span).alias("spans"), state["none"].alias("none"))

    empty = F.array().cast("array<struct<start:bigint,length:bigint>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"), empty.alias("none"))
    return paths.select(F.col("conv").alias(conv_col), "leaf", formatted.alias("formatted"), F.aggregate("turns", zero, add, lambda s: s["spans"]).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, CLOSE)
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def one(x: Column) -> Column:
        halves = F.split(F.substr(x, F.lit(len(OPEN) + 1)), r"\[/INST\]")
        return F.struct(unescape(F.get(halves, F.lit(0))).alias("role"), unescape(F.get(halves, F.lit(1))).alias("text"))

    return F.transform(turns, one)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
