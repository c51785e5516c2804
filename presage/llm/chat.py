"""Chat formatting of reply trees: paths by doubling self-joins, the best branches, one conversation each."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from presage.session import cut_lineage

OPEN, CLOSE = "### ", "</turn>"


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables (node to its ancestor 1, 2, 4, ... steps up) and, per node, its depth and summed score.

    ``nodes``: node, parent (null at a root), score. Each round joins the table
    of unfinished nodes with all and doubles the step, so rounds grow with the
    logarithm of the depth and late ones hold deep nodes only. Nodes on or below
    a cycle of parents never reach a root and get no row.
    """
    n = nodes.count()
    state = cut_lineage(nodes.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")))
    jumps, done, going = [], state.filter("up is null"), state.filter("up is not null")
    while not going.isEmpty() and 1 << len(jumps) <= 2 * n:
        jumps.append(going.select("node", "up"))
        far = done.unionByName(going).select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        state = cut_lineage(going.join(far, "up").select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total")))
        done, going = done.unionByName(state.filter("up is null")), state.filter("up is not null")
    return jumps, done.select("node", "depth", "total")


def best_paths(messages: DataFrame, branches: int = 1, tree: str = "tree_id", node: str = "node_id", parent: str = "parent_id", score: str = "score") -> DataFrame:
    """tree, leaf, branch_rank, node, depth of every message on the ``branches`` best root-to-leaf paths of each tree.

    A branch scores the mean of its messages' scores (null: 0); ties go to the
    longer, then to the smaller leaf. A parent that is not in the tree makes a
    root. Messages under a cycle of parents are on no path.
    """
    key = F.struct(F.col(tree).alias("tree"), F.col(node).alias("id"))
    named = messages.select(key.alias("node"), F.when(F.col(parent).isNotNull(), F.struct(F.col(tree).alias("tree"), F.col(parent).alias("id"))).alias("wish"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))
    named = named.groupBy("node").agg(F.min("wish").alias("wish"), F.max("score").alias("score"))
    known = named.select(F.col("node").alias("parent"))
    nodes = cut_lineage(named.join(known, F.col("wish") == F.col("parent"), "left").select("node", "parent", "score"))
    jumps, reach = ancestors(nodes)
    leaves = reach.join(nodes.filter("parent is not null").select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    rank = F.row_number().over(Window.partitionBy("node.tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node.id"))
    chosen = leaves.withColumn("branch_rank", rank).filter(F.col("branch_rank") <= branches).select(F.col("node").alias("leaf"), "branch_rank", "node")
    path = chosen
    for jump in jumps:  # steps 1, 2, 4, ... reach every distance
        path = cut_lineage(path.unionByName(path.join(jump, "node").select("leaf", "branch_rank", F.col("up").alias("node"))))
    return path.join(reach, "node").select(F.col("node.tree").alias("tree"), F.col("leaf.id").alias("leaf"), "branch_rank", F.col("node.id").alias("node"), "depth")


def escape(text: Column, extra: str = "") -> Column:
    """Backslashes doubled; a backslash before each control string, and before ``extra``."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    text = F.replace(F.regexp_replace(text, "#(?=##)", r"\\#"), F.lit(CLOSE), F.lit("\\" + CLOSE))
    return F.replace(text, F.lit(extra), F.lit("\\" + extra)) if extra else text


def format_paths(paths: DataFrame, messages: DataFrame, tree: str = "tree_id", node: str = "node_id", role: str = "role", text: str = "text", learned: str = "assistant") -> DataFrame:
    """tree, leaf, branch_rank, n_turns, formatted, loss_spans (code point ranges of the learned role's texts).

    A turn is ``### role: text</turn>`` and a line end; null role or text is
    empty. Control strings inside are escaped, so ``parse`` gives back every turn.
    """
    said = messages.select(F.col(tree).alias("tree2"), F.col(node).alias("node2"), F.concat(F.lit(OPEN), escape(F.col(role), ":"), F.lit(": ")).alias("head"), escape(F.col(text)).alias("body"), F.coalesce(F.col(role) == learned, F.lit(False)).alias("loss"))
    turns = paths.join(said, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("node") == F.col("node2")))
    size = F.char_length("head") + F.char_length("body") + len(CLOSE) + 1
    own = Window.partitionBy("tree", "leaf", "branch_rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("at", F.coalesce(F.sum(size.cast("long")).over(own), F.lit(0).cast("long")))
    piece = F.struct("depth", F.concat("head", "body", F.lit(CLOSE + "\n")).alias("piece"), "loss", (F.col("at") + F.char_length("head")).alias("start"), (F.col("at") + F.char_length("head") + F.char_length("body")).alias("stop"))
    return placed.groupBy("tree", "leaf", "branch_rank").agg(F.array_sort(F.collect_list(piece)).alias("all")).select(
        "tree", "leaf", "branch_rank", F.size("all").cast("long").alias("n_turns"), F.array_join(F.col("all.piece"), "").alias("formatted"),
        F.transform(F.filter("all", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))).alias("loss_spans"))


def format_trees(messages: DataFrame, branches: int = 1, tree: str = "tree_id", node: str = "node_id", parent: str = "parent_id", score: str = "score", role: str = "role", text: str = "text", learned: str = "assistant") -> DataFrame:
    """The best branches of reply trees as conversations; see ``best_paths`` and ``format_paths``. No messages: no rows."""
    return format_paths(best_paths(messages, branches, tree, node, parent, score), messages, tree, node, role, text, learned)


def chains(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees: each row answers the one before it by turn; equal turns go by role, then text."""
    place = F.row_number().over(Window.partitionBy(conversation).orderBy(turn, role, text)).cast("long")
    return rows.select(F.col(conversation).alias("tree_id"), place.alias("node_id"), F.col(role).alias("role"), F.col(text).alias("text")).withColumn(
        "parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1)).withColumn("score", F.lit(0.0))


TURN = re.compile(re.escape(OPEN) + r"((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)" + re.escape(CLOSE) + "\n", re.S)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn; the inverse of the template."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the formatted text and its loss mask."""
    import hashlib

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist()):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"]:s["stop"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("tree"), *[pa.array(c, t) for c, t in zip(cols, kinds)]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
