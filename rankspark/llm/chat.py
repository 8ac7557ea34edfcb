"""Chat formatting of reply trees.

Messages form trees: (conversation, node, parent, role, text, score); a node
without parent, or whose parent is not there, is a root. Depth and the score
sum of every root-to-node path come from iterative self-joins that double the
reach of each node's pointer, so a tree of depth d takes about log2(d)
rounds. Leaves are ranked by the mean score of their path (ties: the smaller
leaf first) and the best ``branches`` of a conversation chosen; the same
pointers, followed from the longest reach to the shortest, then list the
nodes of the chosen paths, and each path becomes one formatted conversation.

Template: every turn is ``### role``, a line feed, the text and ``</turn>``
with a line feed. Inside roles and texts ``\\`` becomes ``\\\\``, ``#`` becomes
``\\h`` and ``<`` becomes ``\\l`` (in roles also a line feed ``\\n``), so no control
string can stand in them, and ``unescape`` gives every text back. The loss mask
has, for each turn, the span of an assistant's text in code points of that
turn, null for others.

Only DataFrame functions are used. Joins are on (conversation, node); the
turns of one conversation meet only in the row that is their output.

Defined results: null text and null role are empty; rows without a
conversation id form one conversation (id null); repeated node ids of a conversation must be
told apart by the caller (``chain`` numbers rows, so repeated turns follow
each other); nodes on a cycle have no root and are on no path; a very long text
is one turn like any other; an empty table gives no rows. Only the columns
named above are read, so other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import written

# The template's control strings.
MARK, END = "### ", "</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column) -> Column:
    """Doubled backslashes part the text; what is left of backslashes marks the other signs."""
    def plain(x: Column) -> Column:
        x = F.replace(F.replace(x, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
        return F.replace(x, F.lit("\\n"), F.lit("\n"))

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def chain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of plain conversations: each turn answers the one before (order: turn, role, text)."""
    m = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    return m.select("conv", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text",
                    F.lit(0.0).alias("score"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def reach(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv, node, depth, total) of every node with a root, and the pointer tables (conv, node, up), one per round.

    In table k ``up`` is the ancestor 2**k steps away, null past the root.
    """
    nodes = messages.select("conv", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select(F.col("conv").alias("c"), F.col("node").alias("p"))
    cur = (nodes.join(known, _same("conv", "c") & (F.col("parent") == F.col("p")), "left")
           .select("conv", "node", F.col("p").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"),
                   F.col("p").isNull().alias("rooted")))
    cur = written(cur, "chat")
    tables, open_before = [], -1
    while True:
        tables.append(cur.filter(F.col("up").isNotNull()).select("conv", "node", "up"))
        n_open = cur.filter(F.col("up").isNotNull()).count()
        if n_open in (0, open_before):  # none left, or only nodes that hang on a cycle
            return cur.filter("rooted").select("conv", "node", "depth", "total"), tables[:-1] if n_open == 0 else tables
        # Only a round that roots nobody leaves the number as it was.
        open_before = n_open
        far = cur.select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("up").alias("up2"),
                         F.col("depth").alias("d2"), F.col("total").alias("t2"), F.col("rooted").alias("r2"))
        going = cur.filter(F.col("up").isNotNull())
        step = going.join(far, _same("conv", "c") & (F.col("up") == F.col("n"))).select(
            "conv", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"),
            (F.col("total") + F.col("t2")).alias("total"), F.col("r2").alias("rooted"))
        cur = written(cur.filter(F.col("up").isNull()).unionByName(step), "chat")


def choose(messages: DataFrame, paths: DataFrame, branches: int) -> DataFrame:
    """(conv, leaf, rank, depth): the best leaves of every conversation."""
    inner = messages.filter(F.col("parent").isNotNull()).select(F.col("conv").alias("c"), F.col("parent").alias("p")).distinct()
    leaves = paths.join(inner, _same("conv", "c") & (F.col("node") == F.col("p")), "left_anti")
    best = Window.partitionBy("conv").orderBy((F.col("total") / F.col("depth")).desc(), "node")
    return (leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
            .select("conv", F.col("node").alias("leaf"), "rank", "depth"))


def members(chosen: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(conv, rank, node) of every node on the chosen paths."""
    on = chosen.select("conv", "rank", F.col("leaf").alias("node"))
    for t in reversed(tables):
        up = t.select(F.col("conv").alias("c"), F.col("node").alias("n"), "up")
        more = on.join(up, _same("conv", "c") & (F.col("node") == F.col("n"))).select("conv", "rank", F.col("up").alias("node"))
        on = written(on.unionByName(more), "chat")  # each round uses the one before twice
    return on


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv, rank, n_turns, formatted, loss_mask) of the best ``branches`` paths of every conversation."""
    messages = written(messages, "chat")
    paths, tables = reach(messages)
    on = members(choose(messages, paths, branches), tables)
    m = messages.select(F.col("conv").alias("c"), F.col("node").alias("n"), "role", "text")
    d = paths.select(F.col("conv").alias("c2"), F.col("node").alias("n2"), "depth")
    turns = (on.join(m, _same("conv", "c") & (F.col("node") == F.col("n")))
             .join(d, _same("conv", "c2") & (F.col("node") == F.col("n2"))))
    role = escape(F.coalesce("role", F.lit("")), role=True)
    head = F.concat(F.lit(MARK), role, F.lit("\n"))
    text = escape(F.coalesce("text", F.lit("")))
    turn = turns.select("conv", "rank", "depth", F.concat(head, text, F.lit(END)).alias("turn"),
                        F.when(F.col("role") == ASSISTANT, F.struct(
                            F.length(head).alias("start"), (F.length(head) + F.length(text)).alias("end"))).alias("mask"))
    rows = turn.groupBy("conv", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "turn", "mask"))).alias("all"))
    return rows.select("conv", "rank", F.size("all").cast("long").alias("n_turns"),
                       F.array_join(F.col("all.turn"), "").alias("formatted"), F.col("all.mask").alias("loss_mask"))


def _parsed(zipped: Column) -> Column:
    role, text, loss = zipped["turn"], zipped["turn"], zipped["mask"]
    head = F.substring_index(role, "\n", 1)
    return F.struct(
        unescape(F.substring(head, F.lit(len(MARK) + 1), F.length(head))).alias("role"),
        unescape(F.substring(text, F.length(head) + 2, F.length(text))).alias("text"),
        F.when(loss.isNotNull(), unescape(F.substring(text, loss["start"] + 1, loss["end"] - loss["start"]))).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv, rank, formatted_chars, turns array<struct<role, text, loss>>) from the formatted strings.

    ``loss`` is what the mask covers, unescaped; null for turns without loss.
    The generator keeps Spark from parsing once for every use of ``turns``.
    """
    # After the last mark stands an empty piece; the mask has one entry per turn.
    pieces = F.slice(F.split("formatted", END), F.lit(1), F.size("loss_mask"))
    zipped = F.arrays_zip(pieces.alias("turn"), F.col("loss_mask").alias("mask"))
    return formatted.select("conv", "rank", F.length("formatted").cast("long").alias("formatted_chars"),
                            F.inline(F.array(F.struct(F.transform(zipped, _parsed).alias("turns")))))


def digests(formatted: DataFrame) -> DataFrame:
    """(conv, rank, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: F.coalesce(t["loss"], F.lit(""))), "")
    back = read_back(formatted).select("conv", "rank", "formatted_chars", F.size("turns").cast("long").alias("n_turns"),
                                       F.inline(F.array(F.struct(said.alias("said"), loss.alias("loss")))))
    return back.select("conv", "rank", "n_turns", F.sha2("said", 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       "formatted_chars")
