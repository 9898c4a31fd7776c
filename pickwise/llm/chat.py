"""Chat formatting: reply trees to one conversation a root-to-leaf path.

Paths come from iterative self-joins that double their reach: after k rounds each node knows its 2^k-th ancestor, and a
leaf's path has all nodes less than 2^k above it. So a thread of n turns takes log2(n) rounds. A branch's score is the
sum of its messages' scores; branches of a conversation are ranked by it (equal scores by the leaf), the chosen ones are
formatted.

The template:  <|im_start|>ROLE \\n TEXT <|im_end|> \\n  for each message. Inside roles and texts every "<", any number of
backslashes, "|" gets one more backslash, so "<|" occurs in the output as markup only; in roles a line break is written
as "<n|", and "<n|" itself with a backslash more. The loss mask is the list of [start, end) places, in code points, of assistant texts.

A formatted conversation is one row, or several `part`s in order where it is longer than `part_chars`, so that no task
holds a conversation of any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, save

START, END = "<|im_start|>", "<|im_end|>\n"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(role, r"<(\\*)(n?)\|", r"<\\$1$2|"), "\n", "<n|")


def unescape_role(role: str) -> str:
    return re.sub(r"<\\(\\*)(n?)\|", r"<\1\2|", role.replace("<n|", "\n"))


def thread(rows: DataFrame) -> DataFrame:
    """Linear conversations(conv_id, turn, role, text) as reply trees: each row answers the one before it.

    Order is by turn (null first), then role and text, so rows with equal turns have a fixed place; rows that repeat
    each stay. Null texts and roles are empty. Rows with null conv_id form one conversation.
    """
    r = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    r = r.withColumn("msg_id", nth)
    return r.select("conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, most: int | None = None) -> DataFrame:
    """conv_id, leaf_id, branch (1 is the best), msg_id, up (steps above the leaf) for each chosen root-to-leaf path.

    messages(conv_id, msg_id, parent_id, score). A parent that does not exist makes its child a root; null scores are 0.
    Messages in a ring have no root and no path, nor have those that hang on one. An empty table gives no paths.
    """
    key = ["conv_id", "msg_id"]
    m = save(messages.select(*key, "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    sizes = m.groupBy(F.col("conv_id").alias("n_conv")).agg(F.count(F.lit(1)).alias("n"))  # no path is longer
    eq = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["anc"] == b["msg_id"])
    p = m.select("conv_id", F.col("msg_id").alias("pid")).distinct().alias("p")
    jump = save(m.alias("m").join(p, F.col("m.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("m.parent_id") == F.col("p.pid"))).select("m.conv_id", "m.msg_id", F.col("m.parent_id").alias("anc")).distinct(), "jump")
    roots = m.join(jump, m["conv_id"].eqNullSafe(jump["conv_id"]) & (m["msg_id"] == jump["msg_id"]), "left_anti").select(F.col("conv_id").alias("c"), F.col("msg_id").alias("r")).distinct()
    roots = save(roots, "roots")
    parents = jump.select(F.col("conv_id").alias("c"), F.col("anc").alias("a")).distinct()
    leaves = m.join(parents, m["conv_id"].eqNullSafe(parents["c"]) & (m["msg_id"] == parents["a"]), "left_anti").select(*key).distinct()
    reach = save(leaves.select("conv_id", F.col("msg_id").alias("leaf_id"), F.col("msg_id").alias("anc"), F.lit(0).cast("long").alias("up")), "reach")
    step, limit = 1, m.count()
    while step <= limit and not jump.isEmpty():
        a, b = reach.alias("a"), jump.alias("b")
        on = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.anc") == F.col("b.msg_id"))
        longer = save(reach.union(a.join(b, on).select("a.conv_id", "a.leaf_id", F.col("b.anc"), F.col("a.up") + step)), "reach")
        x, y = jump.alias("x"), jump.alias("y")
        on = F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x.anc") == F.col("y.msg_id"))
        twice = x.join(y, on).select("x.conv_id", "x.msg_id", F.col("y.anc")).alias("t")
        # A step longer than its conversation goes round a ring.
        twice = save(twice.join(sizes.where(F.col("n") > 2 * step), F.col("t.conv_id").eqNullSafe(F.col("n_conv")), "left_semi"), "jump")
        discard(reach, jump)
        reach, jump, step = longer, twice, step * 2
    r = reach.alias("r")
    ended = r.join(roots, F.col("r.conv_id").eqNullSafe(roots["c"]) & (F.col("r.anc") == roots["r"]), "left_semi").select(F.col("conv_id").alias("e_conv"), F.col("leaf_id").alias("e_leaf"))
    r = r.join(ended.alias("e"), F.col("r.conv_id").eqNullSafe(F.col("e.e_conv")) & (F.col("r.leaf_id") == F.col("e.e_leaf")), "left_semi")
    reach = r.select("conv_id", "leaf_id", "anc", "up")
    on = reach["conv_id"].eqNullSafe(m["conv_id"]) & (reach["anc"] == m["msg_id"])
    scored = reach.join(m, on).groupBy(reach["conv_id"], "leaf_id").agg(F.sum("score").alias("path_score"))
    branch = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("path_score"), "leaf_id"))
    chosen = scored.withColumn("branch", branch)
    chosen = (chosen.where(F.col("branch") <= most) if most else chosen).alias("h")
    r = reach.alias("r")
    return r.join(chosen, F.col("r.conv_id").eqNullSafe(F.col("h.conv_id")) & (F.col("r.leaf_id") == F.col("h.leaf_id"))).select("r.conv_id", "r.leaf_id", "h.branch", F.col("r.anc").alias("msg_id"), "r.up")


def format_paths(messages: DataFrame, chosen: DataFrame, part_chars: int = 1_000_000) -> DataFrame:
    """conv_id, leaf_id, part, formatted, loss (array of [start, end) inside the part) of each chosen path."""
    m, c = messages.alias("m"), chosen.alias("c")
    role = escape_role(F.coalesce(F.col("m.role").cast("string"), F.lit("")))
    body = escape(F.coalesce(F.col("m.text").cast("string"), F.lit("")))
    turns = c.join(m, F.col("c.conv_id").eqNullSafe(F.col("m.conv_id")) & (F.col("c.msg_id") == F.col("m.msg_id")))
    turns = turns.select("c.conv_id", "c.leaf_id", "c.up", (F.col("m.role") == "assistant").alias("learn"), F.concat(F.lit(START), role, F.lit("\n")).alias("head"), body.alias("body"))
    ordered = turns.repartition("conv_id", "leaf_id").sortWithinPartitions("conv_id", "leaf_id", F.desc("up"))
    kind = dict(turns.dtypes)
    names = ["conv_id", "leaf_id", "part", "formatted", "loss"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, part, text, size, loss = None, 0, [], 0, []
        for df in it:
            rows = []
            for conv, leaf, learn, head, body in zip(df["conv_id"].astype(object).where(df["conv_id"].notna(), None), df["leaf_id"], df["learn"], df["head"], df["body"], strict=True):
                if at is not None and (at != (conv, leaf) or size >= part_chars):
                    rows.append((*at, part, "".join(text), loss))
                    part = part + 1 if at == (conv, leaf) else 0
                    text, size, loss = [], 0, []
                at = (conv, leaf)
                if learn:
                    loss.append([size + len(head), size + len(head) + len(body)])
                text += [head, body, END]
                size += len(head) + len(body) + len(END)
            yield pd.DataFrame(rows, columns=names)
        if at is not None:
            yield pd.DataFrame([(*at, part, "".join(text), loss)], columns=names)

    return ordered.mapInPandas(run, f"conv_id {kind['conv_id']}, leaf_id {kind['leaf_id']}, part int, formatted string, loss array<array<long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns, digests and masked text of each conversation, parsed from its formatted parts."""
    kind = dict(formatted.dtypes)
    names = ["conv_id", "leaf_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, turns, masked, n, learnt, size = None, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for df in it:
            rows = []
            for conv, leaf, text, loss in zip(df["conv_id"].astype(object).where(df["conv_id"].notna(), None), df["leaf_id"], df["formatted"], df["loss"], strict=True):
                if at is not None and at != (conv, leaf):
                    rows.append((*at, n, turns.hexdigest(), learnt, masked.hexdigest(), size))
                    turns, masked, n, learnt, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                at = (conv, leaf)
                for role, body in TURN.findall(text):
                    turns.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode(errors="replace"))
                    n += 1
                for a, b in loss:
                    piece = unescape(text[a:b])
                    masked.update(piece.encode(errors="replace"))
                    learnt += len(piece)
                size += len(text)
            yield pd.DataFrame(rows, columns=names)
        if at is not None:
            yield pd.DataFrame([(*at, n, turns.hexdigest(), learnt, masked.hexdigest(), size)], columns=names)

    ordered = formatted.repartition("conv_id", "leaf_id").sortWithinPartitions("conv_id", "leaf_id", "part")
    return ordered.mapInPandas(run, f"conv_id {kind['conv_id']}, leaf_id {kind['leaf_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_trees(messages: DataFrame, branches: int | None = None, part_chars: int = 1_000_000) -> DataFrame:
    """Reply trees messages(conv_id, msg_id, parent_id, role, text, score) to formatted conversations, the best `branches` of each."""
    messages = save(messages, "trees")
    return format_paths(messages, paths(messages, branches), part_chars)
