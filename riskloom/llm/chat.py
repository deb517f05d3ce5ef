"""Reply trees as conversations: paths from root to leaf by self-joins of doubling reach, ranked and formatted.

A message with a null or unknown parent is a root. Null texts and roles count as empty. Nodes on a circle of
replies have no root and are left out. Equal scores rank by the smaller leaf. Only the named columns are
read; an empty table gives no conversations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import settle

OPEN, CLOSE, START, END = "[INST]", "[/INST]", "<s>", "</s>"
LEARNED = "assistant"
TURN = r"(?s)\[INST\][^\[]*\[/INST\]|<s>[^<]*</s>"


def escaped(text: Column) -> Column:
    r"""Without the characters that start a control string: \ < [ become \b \l \s."""
    text = F.coalesce(text, F.lit(""))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("\\", "\\b"), ("<", "\\l"), ("[", "\\s")), text)


def unescaped(text: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[1]), F.lit(p[0])), (("[", "\\s"), ("<", "\\l"), ("\\", "\\b")), text)


def turn_text(role: Column, text: Column) -> Column:
    """One formatted turn; answers stand between <s> and </s>, all others name their role."""
    role = F.coalesce(role, F.lit(""))
    other = F.concat(F.lit(OPEN), escaped(role), F.lit("\n"), escaped(text), F.lit(CLOSE))
    return F.when(role == LEARNED, F.concat(F.lit(START), escaped(text), F.lit(END))).otherwise(other)


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation as structs (role, text, learned)."""

    def one(turn):
        learned = F.startswith(turn, F.lit(START))
        body = F.when(learned, F.substr(turn, F.lit(4), F.char_length(turn) - 7)).otherwise(F.substr(turn, F.lit(7), F.char_length(turn) - 13))
        line = F.instr(body, "\n")
        role = F.when(learned, F.lit(LEARNED)).otherwise(unescaped(F.substr(body, F.lit(1), line - 1)))
        text = F.when(learned, unescaped(body)).otherwise(unescaped(F.substr(body, line + 1, F.char_length(body))))
        return F.struct(role.alias("role"), text.alias("text"), learned.alias("learned"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), one)


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, depth, value) of every root-to-leaf path, for nodes (tree, node, parent, score).

    Each round joins the reached ancestors with those they reach themselves, so reach doubles and a tree of
    depth d takes log2(d) rounds. ``depth`` counts from the root, ``value`` is the path's mean score.
    """
    known = nodes.select("tree", F.col("node").alias("parent"))
    parents = nodes.join(known.withColumn("has", F.lit(True)), ["tree", "parent"], "left")
    jumps = settle(parents.select("tree", "node", F.when(F.col("has"), F.col("parent")).alias("up")))
    leaves = jumps.join(jumps.select("tree", F.col("up").alias("node")).where("node IS NOT NULL").distinct(), ["tree", "node"], "left_anti")
    # (leaf, node): every ancestor at a distance below 2^round.
    reach = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up_by"))
    far, length, rounds = jumps, 1, 0
    while rounds < 63 and far.where("up IS NOT NULL").limit(1).count():
        step = reach.join(far.where("up IS NOT NULL"), ["tree", "node"])
        reach = settle(reach.unionByName(step.select("tree", "leaf", F.col("up").alias("node"), (F.col("up_by") + length).alias("up_by"))))
        twice = far.select("tree", F.col("node").alias("up"), F.col("up").alias("top"))
        far = settle(far.where("up IS NOT NULL").join(twice, ["tree", "up"]).select("tree", "node", F.col("top").alias("up")))
        length, rounds = length * 2, rounds + 1
    scored = reach.join(nodes.select("tree", "node", "score"), ["tree", "node"])
    per = scored.groupBy("tree", "leaf").agg(F.max("up_by").alias("far"), F.avg("score").alias("value"))
    return scored.join(per, ["tree", "leaf"]).select("tree", "leaf", "node", (F.col("far") - F.col("up_by")).alias("depth"), "value")


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, rank, formatted) for messages (tree, node, parent, role, text, score): the best ``branches`` paths (all: None)."""
    every = paths(messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    if branches is not None:
        tips = every.groupBy("tree", "leaf").agg(F.max("value").alias("value"))
        order = Window.partitionBy("tree").orderBy(F.desc("value"), "leaf")
        tips = tips.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
        every = every.join(tips.select("tree", "leaf", "rank"), ["tree", "leaf"])
    else:
        every = every.withColumn("rank", F.lit(None).cast("int"))
    turns = every.join(messages.select("tree", "node", turn_text(F.col("role"), F.col("text")).alias("turn")), ["tree", "node"])
    joined = turns.groupBy("tree", "leaf").agg(F.max("rank").alias("rank"), F.sort_array(F.collect_list(F.struct("depth", "turn"))).alias("t"))
    return joined.select("tree", "leaf", "rank", F.concat_ws("", F.transform("t", lambda t: t["turn"])).alias("formatted"))


def chain(rows: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of linear conversations as messages: each answers the one before; equal turns go by role, then text.

    Rows without a conversation id form one conversation of their own, with a null id in the result.
    """
    by = Window.partitionBy(tree).orderBy(F.col(order).asc_nulls_first(), F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    numbered = rows.select(F.to_json(F.struct(F.col(tree).cast("long").alias("i"))).alias("tree"), F.row_number().over(by).alias("node"), F.col(role).alias("role"), F.col(text).alias("text"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text says when read back: turns, their digest, and the text that is learned."""
    read = formatted.select("tree", "formatted", parsed(F.col("formatted")).alias("turns"))
    learned = F.concat_ws("", F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["text"]))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        F.from_json("tree", "i long")["i"].alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
