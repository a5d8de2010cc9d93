"""Reply trees to conversations: root-to-leaf paths, ranked branches, and a reversible chat template."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import SMALLEST, numbered, stored

#: Fixed values of the template: a turn is a header line, the text, and an end mark.
HEADER, END = "### ", " </turn>\n"


def escape(text: str) -> str:
    """`text` without any control string of the template.

    A backslash is doubled, and one is put inside each control string (`#\\## `, `<\\/turn>`), so
    `unescape` needs to look at backslashes only.
    """
    return text.replace("\\", "\\\\").replace("### ", "#\\## ").replace("</turn>", "<\\/turn>")


def _role(role: str) -> str:
    """A role as it stands in a header: it cannot hold the `: ` that ends the header."""
    return escape(role).replace(": ", ":\\ ")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, at = [], 0
    while (hit := text.find("\\", at)) >= 0:
        out.append(text[at:hit])
        at = hit + 1
        if at < len(text) and text[at] == "\\":
            out.append("\\")
            at += 1
    out.append(text[at:])
    return "".join(out)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the spans of code points under the loss mask (assistant texts)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{HEADER}{_role(role)}: "
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(head + body + END)
        at += len(parts[-1])
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that `format_turns` wrote; neither a text nor a role holds an end mark or the `: ` after a role."""
    turns = []
    for part in formatted.split(END)[:-1]:
        head, text = part[len(HEADER) :].split(": ", 1)
        turns.append((unescape(head), unescape(text)))
    return turns


def message_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, message, place): every root-to-leaf path of the reply trees, root at place 0.

    `messages` has (tree, message, parent), parent null (or not in the tree) at a root. Each round
    joins the links with themselves, so that a message's link spans twice as many steps; a tree of
    depth d takes log2(d) rounds. A message is met once per leaf below it. A message that
    names itself or a descendant as its parent is on no path from a root and is left out.
    """
    known = messages.select("tree", "message", "parent").distinct()
    parents = known.select("tree", F.col("message").alias("parent"), F.lit(True).alias("_known")).distinct()
    known = known.join(parents, ["tree", "parent"], "left")
    known = settle(known.select("tree", "message", F.when(F.col("_known"), F.col("parent")).alias("parent")))
    leaves = known.join(known.select("tree", F.col("parent").alias("message")).distinct(), ["tree", "message"], "left_anti")
    paths = leaves.select("tree", F.col("message").alias("leaf"), "message", F.lit(0).alias("up"))
    links, step = known.where("parent IS NOT NULL"), 1
    largest = known.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while step < largest and not links.isEmpty():  # what spans a whole tree and still goes on is a circle
        above = paths.join(links, ["tree", "message"])
        above = above.select("tree", "leaf", F.col("parent").alias("message"), (F.col("up") + step).alias("up"))
        paths = settle(paths.unionByName(above))
        onward = links.select("tree", F.col("message").alias("parent"), F.col("parent").alias("next"))
        links = settle(links.join(onward, ["tree", "parent"]).select("tree", "message", F.col("next").alias("parent")))
        step *= 2
    roots = known.where("parent IS NULL").select("tree", "message")
    depth = paths.join(roots, ["tree", "message"]).groupBy("tree", "leaf").agg(F.max("up").alias("_depth"))
    return paths.join(depth, ["tree", "leaf"]).select("tree", "leaf", "message", (F.col("_depth") - F.col("up")).alias("place"))


def ranked_branches(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree, leaf, score, rank): a branch's score is the mean of its messages' scores (null: 0).

    Rank 0 is the best; ties go to the smaller leaf. Ranks come from one global sort, so a tree
    with very many branches is no single task's work.
    """
    scores = messages.groupBy("tree", "message").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    branches = paths.join(scores, ["tree", "message"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    placed = numbered(branches.withColumn("_worse", -F.col("score")), "tree", ["_worse", "leaf"], "rank")
    return placed.select("tree", "leaf", "score", "rank")


def formatted_branches(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, rank, formatted, mask): each chosen path as one conversation.

    `messages`: tree, message (long), parent (long or null), role, text, score. `best` keeps
    that many branches a tree (None: all). Null roles and texts are empty. A repeated message
    (one tree and id) stands in a path as often as it has rows, in order of role and text. `mask` has
    the spans (start, end) of code points to learn from: the assistant's texts. A formatted
    conversation is one value, so its own turns meet in one row; nothing else does.
    """
    paths = stored(message_paths(messages), "reply-paths")
    chosen = ranked_branches(paths, messages)
    chosen = chosen if best is None else chosen.where(F.col("rank") < best)
    turns = paths.join(chosen, ["tree", "leaf"]).join(messages.select("tree", "message", "role", "text"), ["tree", "message"])
    turn = F.struct("place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    held = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("tree", pa.int64()), ("leaf", pa.int64()), ("rank", pa.int64()), ("formatted", pa.string()), ("mask", span)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                done = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in part.column("turns").to_pylist()]
                masks = [[{"start": a, "end": b} for a, b in spans] for _, spans in done]
                columns = [*(part.column(c) for c in ("tree", "leaf", "rank")), [f for f, _ in done], masks]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    kinds = "tree long, leaf long, rank long, formatted string, mask array<struct<start:long,end:long>>"
    return held.mapInArrow(write, kinds)


def read_back(formatted: DataFrame) -> DataFrame:
    """(tree, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted conversations alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, leaf, text, mask in zip(*(batch.column(c) for c in ("tree", "leaf", "formatted", "mask"))):
                text = text.as_py()
                turns = read_turns(text)
                every = "".join(f"{role}\n{said}\n" for role, said in turns)
                learnt = "".join(unescape(text[m["start"] : m["end"]]) for m in mask.as_py())
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in (every, learnt)]
                rows.append((tree.as_py(), leaf.as_py(), len(turns), digests[0], len(learnt), digests[1], len(text)))
            names = ["tree", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    kinds = "tree long, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(read, kinds)


def chains(rows: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as reply trees: a message's parent is the one before it.

    Rows of a conversation stand in order of turn, role and text, nulls first; null ids are one
    conversation (see `SMALLEST`).
    """
    kept = rows.select(
        F.coalesce(F.col(key).cast("long"), F.lit(SMALLEST).cast("long")).alias("tree"), F.col(turn).alias("turn"), "role", "text"
    )
    placed = numbered(kept, "tree", ["turn", "role", "text"], "message")
    parent = F.when(F.col("message") > 0, F.col("message") - 1)
    return placed.select("tree", "message", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def conversation_digests(rows: DataFrame) -> DataFrame:
    """Format whole conversations, write them, and digest what is read back; an empty table gives an empty one."""
    written = stored(formatted_branches(stored(chains(rows), "messages")), "conversations")
    return read_back(written).select(
        F.nullif("tree", F.lit(SMALLEST).cast("long")).alias("conv_id"),
        "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars",
    )
