"""Reply trees to training conversations, with DataFrame functions only.

Input: one row a message (conv, node, parent, role, text, score); ``parent`` is null at a root.
Iterative self-joins of the message table double how far each message sees up its tree (its
parent, grandparent, fourth ancestor, ...). The same tables then list every ancestor of the
chosen leaves, one join for each power of two, so a chain of n messages takes log2(n) joins
and no more rows than the paths have.

Template of a turn: ``### <role>: <text></turn>`` and a newline. Inside roles and texts a
backslash is doubled, ``#`` before ``#`` becomes ``#\\``, ``</turn>`` becomes ``<\\/turn>``, and in
roles ``:`` becomes ``\\:``; dropping each single backslash gives the text back.

Defined cases: null text or role counts as empty, a null score as 0. Null conversation ids are
one conversation. A parent that does not exist makes its message a root. Two messages of one
conversation with one node id are kept apart only by ``linear_tree``, which numbers rows itself;
``reply_paths`` keeps the first of them by role and text. Messages on a cycle have no root and
give no path. No messages: no paths. One path becomes one string, so a path may hold no more
than a string can (2 GB); trees may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

END = "</turn>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, "#(?=#)", r"#\\")
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_tree(turns: DataFrame) -> DataFrame:
    """The messages of ``turns`` (conv_id, turn, role, text) as a tree: each answers the row before it.

    Rows of one turn follow each other by role and text; identical rows are messages of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return turns.select(F.col("conv_id").alias("conv"), node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _ancestors(nodes: DataFrame) -> list[DataFrame]:
    """Tables (conv, node, up, gained): the 2^k-th ancestor and the score from node to below it, where there is one."""
    jump = cut_lineage(nodes.where("parent is not null").select("conv", "node", F.col("parent").alias("up"), F.col("score").alias("gained")))
    most, tables = nodes.count(), []
    while not jump.isEmpty() and 2 ** len(tables) <= most:
        tables.append(jump)
        above = jump.select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("gained").alias("g2"))
        jump = cut_lineage(jump.join(above, F.col("conv").eqNullSafe(F.col("c")) & (F.col("up") == F.col("n"))).select("conv", "node", F.col("up2").alias("up"), (F.col("gained") + F.col("g2")).alias("gained")))
    return tables


def reply_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(conv, leaf, rank, path_score, depth, role, text): the messages of each chosen root-to-leaf path.

    Branches of a conversation are ranked by the sum of their messages' scores, then by the
    smaller leaf; ``branches`` keeps so many (None: all). depth is 0 at the root.
    """
    nodes = messages.select("conv", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).where("node is not null")
    one = nodes.groupBy("conv", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m")).select("conv", "node", "m.*")
    known = one.select(F.col("conv").alias("c"), F.col("node").alias("n"))
    one = one.join(known, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("n")), "left").select("conv", "node", F.col("n").alias("parent"), "role", "text", "score")
    nodes = cut_lineage(one)
    tables = _ancestors(nodes.select("conv", "node", "parent", "score"))
    parents = nodes.where("parent is not null").select(F.col("conv").alias("c"), F.col("parent").alias("p")).distinct()
    at = nodes.join(parents, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("p")), "left_anti").select("conv", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(0).cast("long").alias("up_by"), F.lit(0.0).alias("gained"))
    leaves = at
    for k in reversed(range(len(tables))):  # to the root of each leaf
        step = tables[k].select(F.col("conv").alias("c"), F.col("node").alias("n"), "up", F.col("gained").alias("g"))
        leaves = leaves.join(step, F.col("conv").eqNullSafe(F.col("c")) & (F.col("at") == F.col("n")), "left").select("conv", "leaf", F.coalesce("up", "at").alias("at"), (F.col("up_by") + F.when(F.col("up").isNotNull(), 2**k).otherwise(0)).alias("up_by"), (F.col("gained") + F.coalesce("g", F.lit(0.0))).alias("gained"))
    roots = nodes.where("parent is null").select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("score").alias("g"))
    whole = leaves.join(roots, F.col("conv").eqNullSafe(F.col("c")) & (F.col("at") == F.col("n"))).select("conv", "leaf", F.col("up_by").alias("length"), (F.col("gained") + F.col("g")).alias("path_score"))
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("path_score"), "leaf"))
    chosen = whole.withColumn("rank", rank)
    chosen = cut_lineage(chosen if branches is None else chosen.where(F.col("rank") <= branches))
    path = chosen.select("conv", "leaf", "rank", "path_score", "length", F.col("leaf").alias("at"), F.lit(0).cast("long").alias("up_by"))
    for k in reversed(range(len(tables))):  # each power of two adds, to every ancestor found so far, the one so much higher
        step = tables[k].select(F.col("conv").alias("c"), F.col("node").alias("n"), "up")
        higher = path.join(step, F.col("conv").eqNullSafe(F.col("c")) & (F.col("at") == F.col("n"))).select("conv", "leaf", "rank", "path_score", "length", F.col("up").alias("at"), (F.col("up_by") + 2**k).alias("up_by"))
        path = cut_lineage(path.unionByName(higher))
    said = nodes.select(F.col("conv").alias("c"), F.col("node").alias("n"), "role", "text")
    return path.join(said, F.col("conv").eqNullSafe(F.col("c")) & (F.col("at") == F.col("n"))).select("conv", "leaf", "rank", "path_score", (F.col("length") - F.col("up_by")).alias("depth"), "role", "text")


def format_paths(paths: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row a path: its formatted text and the spans of it that the loss covers.

    ``loss``: array of (start, length, start_byte, n_bytes), in code points and in UTF-8 bytes,
    of the escaped texts of turns whose role is ``learn``, in order. Offsets are running sums
    over the turns of a path.
    """
    head = F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(": "))
    turns = paths.select("conv", "leaf", "rank", "path_score", "depth", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == learn).alias("learn"))
    turns = turns.withColumn("turn_text", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda size: F.coalesce(F.sum(size("turn_text")).over(before), F.lit(0)) + size("head")
    span = F.struct(start(F.length).alias("start"), F.length("body").cast("long").alias("length"), start(F.octet_length).alias("start_byte"), F.octet_length("body").cast("long").alias("n_bytes"))
    turns = turns.select("conv", "leaf", "rank", "path_score", "depth", "turn_text", F.when(F.col("learn"), span).alias("span"))
    whole = turns.groupBy("conv", "leaf").agg(F.min("rank").alias("rank"), F.min("path_score").alias("path_score"), F.array_sort(F.collect_list(F.struct("depth", "turn_text", "span"))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return whole.select("conv", "leaf", "rank", "path_score", F.array_join(F.transform("turns", lambda t: t["turn_text"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text says: ``turns`` (array of role and text) and ``loss_text``, unescaped.

    The text is read as UTF-8 bytes, where a span is found without walking to it.
    """
    pieces = F.filter(F.split("formatted", END, -1), lambda x: x != "")
    parsed = F.transform(pieces, lambda x: F.struct(
        unescape(F.regexp_extract(x, r"(?s)^### ((?:[^:\\]|\\.)*): (.*)$", 1)).alias("role"),
        unescape(F.regexp_extract(x, r"(?s)^### ((?:[^:\\]|\\.)*): (.*)$", 2)).alias("text")))
    raw = F.encode("formatted", "UTF-8")
    learnt = F.transform("loss", lambda s: unescape(F.decode(F.substring(F.col("raw"), (s["start_byte"] + 1).cast("int"), s["n_bytes"].cast("int")), "UTF-8")))
    return formatted.withColumn("raw", raw).select(*formatted.columns, parsed.alias("turns"), F.array_join(learnt, "").alias("loss_text"))
