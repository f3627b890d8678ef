"""Reply trees to conversations: best root-to-leaf paths by iterative self-joins, then one formatted text per path.

Everything is DataFrame operations. Ancestors are found by pointer doubling, so a thread of depth d takes
log2(d) self-joins, each written to the shared folder. A formatted conversation is one string, so the turns
of one path meet in one row; that is the only gathering.

Defined cases: a null text or role is an empty string; a parent that is not in its tree makes its node a root; nodes
on a cycle, or below one, belong to no path; equal scores go to the longer path, then to the smaller leaf;
rows without a tree id form one tree; other columns of the input, whatever their names, are not read. An empty table gives an empty
table; a conversation is one string, so its turns together must fit in a row, and long texts are formatted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut

HEAD, MID, END = "### ", ": ", " </turn>\n"


def thread(turns: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages (tree, node, parent, role, text, score) of linear conversations: each turn replies to the one before.

    Turns with equal order follow by role and text, so repeated rows all stay.
    """
    w = W.partitionBy("tree").orderBy(F.col("at").asc_nulls_first(), "role", "text")
    return (turns.select(F.col(tree).alias("tree"), F.col(order).alias("at"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
            .withColumn("node", F.row_number().over(w).cast("long"))
            .select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score")))


def _same(a: str, b: str, left: str, right: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & (F.col(f"{a}.{left}") == F.col(f"{b}.{right}"))


def _doubled(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the 2^k-th ancestors, and each node's path score and length up to its root."""
    links = nodes.select("tree", "node", "parent", "score")
    known = nodes.select("tree", "node")
    state = cut(links.alias("a").join(known.alias("b"), _same("a", "b", "parent", "node"), "left")
                .select("a.tree", "a.node", F.col("b.node").alias("jump"), F.coalesce("a.score", F.lit(0.0)).cast("double").alias("total"), F.lit(1).cast("long").alias("steps")), "chat")
    levels, rounds = [], state.count().bit_length() + 1
    while rounds and not state.filter("jump IS NOT NULL").isEmpty():
        levels.append(state)
        active, finished = state.filter("jump IS NOT NULL"), state.filter("jump IS NULL")
        state = cut(active.alias("a").join(state.alias("b"), _same("a", "b", "jump", "node"))
                    .select("a.tree", "a.node", "b.jump", (F.col("a.total") + F.col("b.total")).alias("total"), (F.col("a.steps") + F.col("b.steps")).alias("steps"))
                    .unionByName(finished), "chat")
        rounds -= 1
    return levels, state.filter("jump IS NULL")


def best_paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """Nodes of the ``per_tree`` branches with the highest sum of scores: tree, branch (rank from 1), back (0 at the leaf), node, score."""
    levels, sums = _doubled(messages)
    parents = messages.filter("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = sums.alias("a").join(parents.alias("b"), _same("a", "b", "node", "node"), "left_anti")
    w = W.partitionBy("tree").orderBy(F.desc("total"), F.desc("steps"), "node")
    paths = (leaves.withColumn("branch", F.row_number().over(w)).filter(F.col("branch") <= per_tree)
             .select("tree", "branch", "node", F.lit(0).cast("long").alias("back"), F.col("total").alias("score")))
    for k, level in enumerate(levels):
        up = level.filter("jump IS NOT NULL")
        paths = cut(paths.unionByName(paths.alias("a").join(up.alias("b"), _same("a", "b", "node", "node"))
                                      .select("a.tree", "a.branch", F.col("b.jump").alias("node"), (F.col("a.back") + F.lit(1 << k)).alias("back"), "a.score")), "chat")
    return paths


def escape_role(role: Column) -> Column:
    for a, b in (("%", "%25"), (":", "%3A"), ("\n", "%0A"), ("<", "%3C"), ("#", "%23")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("#", "%23"), ("<", "%3C"), ("\n", "%0A"), (":", "%3A"), ("%", "%25")):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def escape_text(text: Column) -> Column:
    """Backslashes are doubled, then one backslash breaks every marker of the template."""
    for a, b in (("\\", "\\\\"), ("</turn>", "<\\/turn>"), ("### ", "#\\## ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(messages: DataFrame, per_tree: int = 1, learn: str = "assistant") -> DataFrame:
    """One row per chosen branch: tree, branch, score, n_turns, formatted, loss_mask, loss_spans.

    ``messages`` has tree, node, parent, role, text and score. A turn reads ``### role: text </turn>`` and a line end.
    ``loss_mask`` has a flag per turn, true where the role is ``learn``: the loss falls on that turn's text alone.
    ``loss_spans`` are the same texts as [start, end) in code points of ``formatted``.
    """
    messages = messages.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    paths = best_paths(messages, per_tree)
    head = F.concat(F.lit(HEAD), escape_role(F.col("b.role")), F.lit(MID))
    turns = (paths.alias("a").join(messages.alias("b"), _same("a", "b", "node", "node"))
             .select("a.tree", "a.branch", "a.score", (-F.col("a.back")).alias("at"), head.alias("head"), escape_text(F.col("b.text")).alias("body"), (F.col("b.role") == learn).alias("learn")))
    w = W.partitionBy("tree", "branch").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + F.lit(len(END))
    turns = turns.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)) + F.length("head"))
    row = F.struct("at", F.concat("head", "body", F.lit(END)).alias("seg"), "learn", "start", (F.col("start") + F.length("body")).alias("end"))
    got = turns.groupBy("tree", "branch").agg(F.first("score").alias("score"), F.array_sort(F.collect_list(row)).alias("turns"))
    return got.select(
        "tree", "branch", "score", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x["seg"]), "").alias("formatted"),
        F.transform("turns", lambda x: x["learn"]).alias("loss_mask"),
        F.transform(F.filter("turns", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    pieces = F.split(formatted, END, -1)
    cutpoint = lambda p: F.instr(p, MID)  # noqa: E731  escaped roles hold no colon
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(
        unescape_role(p.substr(F.lit(len(HEAD) + 1), cutpoint(p) - F.lit(len(HEAD) + 1))).alias("role"),
        unescape_text(p.substr(cutpoint(p) + F.lit(len(MID)), F.length(p))).alias("text")))


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted text and the loss mask hold, as digests."""
    got = chats.withColumn("read", read_turns(F.col("formatted")))
    under = F.zip_with("read", "loss_mask", lambda x, m: F.when(m, x["text"]).otherwise(F.lit("")))
    got = got.withColumn("loss", F.array_join(under, ""))
    whole = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return got.select(F.col("tree").alias("conv_id"), F.size("read").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
