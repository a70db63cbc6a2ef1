"""Reply trees into training conversations: DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quoteloom.operators.ordering import running_sum
from quoteloom.session import cut_lineage

TURN, TEXT, END, OPEN, CLOSE = "<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>"
#: Strings that mean something to this template or to templates in common use; inside a role or text they are escaped.
CONTROL = [TURN, TEXT, END, OPEN, CLOSE, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
           "<|user|>", "<|assistant|>", "<|system|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>"]
LEARNED = "assistant"
_BREAK = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)


def escaped(text: Column) -> Column:
    """Every backslash doubled, and one put behind the first character of every control string, so that none is left."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _BREAK, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of turns as reply trees of one branch: ``tree``, ``node`` (1, 2, …), ``parent``, ``role``, ``text``, ``score``.

    Turns are numbered by turn, then role, then text, so repeated turns follow each other; a null turn comes first. Numbers are
    running sums in two levels, so a conversation with a third of all rows spreads over its buckets.
    """
    named = rows.select(F.struct(F.col(conv_col).alias("id")).alias("tree"), F.coalesce(F.col(turn_col), F.lit(-(1 << 60))).cast("long").alias("_turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # equal rows of a turn are told apart by their number among themselves
    named = named.withColumn("_k", F.row_number().over(Window.partitionBy("tree", "_turn").orderBy("role", "text")))
    counts = running_sum(named.groupBy("tree", "_turn").agg(F.count("*").alias("_n")), ["tree"], "_turn", F.col("_n"), "_upto")
    node = (F.col("_upto") - F.col("_n") + F.col("_k")).cast("long")
    return named.join(counts, ["tree", "_turn"]).select(
        "tree", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of jumps of 1, 2, 4, … replies up, and per node its depth and the sum of scores from the root.

    Each table is the one before joined to itself, so a path of n replies takes log2(n) joins, keyed by message. A message
    that has reached its root is looked up by others but takes no further part.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_is"))
    first = cut_lineage(nodes.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("_is"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total")))
    done, open_ = first.filter("up is null"), first.filter("up is not null")
    tables, rows = [], first.count()
    # what is still open after that many doublings hangs on a cycle and has no root
    while (1 << len(tables)) <= rows and open_.limit(1).count():
        tables.append(open_.select("tree", "node", "up"))
        state = open_.union(done).select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("total").alias("_t"))
        level = cut_lineage(open_.join(state, ["tree", "up"]).select(
            "tree", "node", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("total") + F.col("_t")).alias("total")))
        done, open_ = done.union(level.filter("up is null")), level.filter("up is not null")
    return tables, done.select("tree", "node", "depth", "total")


def branches(messages: DataFrame, keep: int = 1) -> DataFrame:
    """Chosen root-to-leaf paths: ``tree``, ``leaf``, ``rank``, ``branch_score``, ``node``, ``depth``, ``role``, ``text``; one row per message.

    ``messages``: tree, node (unique in its tree), parent (null or unknown: a root), role, text, score. A branch scores the mean
    of its messages' scores; the best ``keep`` leaves of a tree stay, ties by greater depth, then smaller node. Only the
    chosen paths are spelled out.
    """
    nodes = cut_lineage(messages)
    tables, depths = _jumps(nodes.select("tree", "node", "parent", "score"))
    answered = nodes.filter("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = depths.join(answered, ["tree", "node"], "left_anti").withColumn("branch_score", F.col("total") / F.col("depth"))
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), F.desc("depth"), "node")
    best = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep).select("tree", F.col("node").alias("leaf"), "rank", "branch_score")
    path = cut_lineage(best.withColumn("node", F.col("leaf")))
    for up in tables:
        # each round doubles the known end of every path; only what it adds is written
        added = path.join(up, ["tree", "node"]).select("tree", "leaf", "rank", "branch_score", F.col("up").alias("node"))
        path = path.union(cut_lineage(added))
    return path.join(depths.select("tree", "node", "depth"), ["tree", "node"]).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])


def formatted(messages: DataFrame, keep: int = 1) -> DataFrame:
    """One row per chosen branch: ``tree``, ``leaf``, ``rank``, ``branch_score``, ``n_turns``, ``formatted``, ``loss``.

    ``formatted`` is ``<s>``, then per turn ``<|turn|>role<|text|>text<|end|>``, then ``</s>``; roles and texts are escaped. ``loss``
    lists the parts to learn from: number of the turn and code points from and to, counted inside the turn's segment (the
    string is cut before each ``<|turn|>``), in order. Null roles and texts are empty; ids may be null; an empty table gives none.
    """
    role, text = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    start = F.char_length(role) + len(TURN) + len(TEXT)
    turn = F.struct("depth", F.concat(F.lit(TURN), role, F.lit(TEXT), text, F.lit(END)).alias("segment"), (F.col("role") == LEARNED).alias("learned"),
                    start.alias("start"), (start + F.char_length(text)).alias("end"))
    # a conversation is one value of the result, so its turns meet in one row
    whole = branches(messages, keep).groupBy("tree", "leaf", "rank", "branch_score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    numbered = F.transform("turns", lambda t, i: F.struct((i + 1).alias("turn"), t["start"].alias("start"), t["end"].alias("end"), t["learned"].alias("learned")))
    loss = F.transform(F.filter(numbered, lambda t: t["learned"]), lambda t: F.struct(t["turn"], t["start"], t["end"]))
    return whole.select(
        "tree", "leaf", "rank", "branch_score", F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.lit(OPEN), F.array_join(F.col("turns.segment"), ""), F.lit(CLOSE)).alias("formatted"), loss.alias("loss"))


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``learned`` (all text under the mask) read from ``formatted`` and ``loss`` alone."""
    cut = conversations.withColumn("_segments", F.split("formatted", r"(?=<\|turn\|>)"))
    body = lambda s: F.substring_index(F.substring_index(s, END, 1), TURN, -1)
    turns = F.transform(F.slice("_segments", F.lit(2), F.size("_segments") - 1), lambda s: F.struct(
        unescaped(F.substring_index(body(s), TEXT, 1)).alias("role"), unescaped(F.substring_index(body(s), TEXT, -1)).alias("text")))
    learned = F.transform("loss", lambda m: unescaped(F.substr(F.get("_segments", m["turn"]), m["start"] + 1, m["end"] - m["start"])))
    return cut.withColumn("turns", turns).withColumn("learned", F.array_join(learned, "")).drop("_segments")
