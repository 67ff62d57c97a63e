"""Chat formatting of reply trees.

Messages name their parent. Iterative self-joins double the reach of every message's ancestor link, summing scores on
the way, until every message knows its root, its depth and its path's score: log2(depth) rounds, each a join on
(tree, message), so neither a long thread nor a large tree is one task. Branches (root-to-leaf paths) are ranked by mean
score; a second doubling with the same links lists the messages of the chosen ones. Each chosen path becomes one
conversation: its turns, in order, as parts whose concatenation is the formatted text, with the span under the loss mask.

A conversation is written and read by one task as a stream of turns, which sorting may spill; it is never held whole.

Template: ``### role`` and a line feed, the text, ``</turn>`` and a line feed. In texts, the control strings
``### ``, ``</turn>`` and the backslash get a backslash before them; in roles a line feed is written as backslash-n as
well, so reading back gives what was written. The loss mask covers the escaped texts of assistant turns.

Defined results: null texts and roles are empty. A parent that is not in its tree is no parent. Messages on a cycle of
parents have no root and belong to no path. If a message identifier occurs twice in a tree, the row that sorts first by
role and text counts. Equal branches are ranked by length, then by the smaller leaf. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, ship, written

START, END = "### ", "</turn>"
_control = re.compile(rf"\\|{START}|{END}")
_escaped = re.compile(rf"\\(\\|{START}|{END}|n)")
_end = re.compile(rf"\\(?:\\|{START}|{END}|n)|{END}\n")


def escape(text: str) -> str:
    return _control.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(part, where its loss span starts, how long that is); a span of length -1 is none."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(body) if role == "assistant" else -1


class TurnReader:
    """Turns of a formatted conversation that arrives in parts, cut anywhere."""

    def __init__(self) -> None:
        self.buffer = ""

    def feed(self, part: str) -> Iterator[tuple[str, str]]:
        self.buffer += part
        while True:
            end = next((m for m in _end.finditer(self.buffer) if m[0][0] != "\\"), None)
            if end is None:
                return
            head, _, body = self.buffer[: end.start()].partition("\n")
            if not head.startswith(START):
                raise ValueError("not a formatted conversation")
            self.buffer = self.buffer[end.end() :]
            yield unescape(head[len(START) :]), unescape(body)


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``tree``, ``branch`` (from 1), ``pos`` (from 0), ``role``, ``text`` of the best paths.

    ``messages``: tree, node, parent, role, text, score.
    """
    same = ["key", "node"]
    rows = messages.select(F.coalesce(F.col("tree").cast("string"), F.lit("null tree")).alias("key"), "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    first = F.min(F.struct("role", "text", "parent", "score", "tree")).alias("m")
    rows = written(rows.where("node is not null").groupBy(*same).agg(first).select(*same, "m.*"), "messages")

    known = rows.select("key", F.col("node").alias("parent"), F.lit(True).alias("there"))
    links = rows.select(*same, "parent", "score").join(known, ["key", "parent"], "left")
    links = links.select(*same, F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("n"), F.col("score").alias("total"))
    links = checkpointed(links)
    most = links.count()
    jumps, reach = [], 1
    while reach <= most:
        open_ = links.where("up is not null")
        if open_.isEmpty():
            break
        jumps.append(open_.select("key", "node", "up"))
        far = links.select("key", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("total").alias("total2"))
        moved = open_.join(far, ["key", "up"]).select(*same, F.col("up2").alias("up"), (F.col("n") + F.col("n2")).alias("n"), (F.col("total") + F.col("total2")).alias("total"))
        links = checkpointed(links.where("up is null").unionByName(moved))
        reach *= 2
    parents = rows.select("key", F.col("parent").alias("node")).distinct()
    leaves = links.where("up is null").join(parents, same, "left_anti")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.col("total") / F.col("n")), F.desc("n"), "node"))
    path = leaves.withColumn("branch", rank).where(F.col("branch") <= branches).select("key", "branch", "node", (F.col("n") - 1).alias("pos"))
    for k, jump in enumerate(jumps):
        path = checkpointed(path)
        further = path.join(jump, same).select("key", "branch", F.col("up").alias("node"), (F.col("pos") - (1 << k)).alias("pos"))
        path = path.unionByName(further)
    return path.join(rows, same).select("tree", "key", "branch", "pos", "role", "text")


PARTS = "tree {kind}, branch int, pos long, part string, start long, loss_start long, loss_length long"


def format_paths(paths: DataFrame) -> DataFrame:
    """Parts of the formatted conversations, in order within each partition; a span of length -1 is no loss span."""
    ship(paths.sparkSession)
    rows = paths.repartition("key", "branch").sortWithinPartitions("key", "branch", "pos")
    kind = paths.schema["tree"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, of = 0, None
        for batch in batches:
            keys, branches, roles, texts = (batch.column(c).to_pylist() for c in ("key", "branch", "role", "text"))
            parts, starts, loss_starts, lengths = [], [], [], []
            for key, branch, role, text in zip(keys, branches, roles, texts):
                if (key, branch) != of:
                    at, of = 0, (key, branch)
                part, loss, length = format_turn(role, text)
                parts.append(part)
                starts.append(at)
                loss_starts.append(at + loss)
                lengths.append(length)
                at += len(part)
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("branch"), batch.column("pos"), pa.array(parts, pa.string()), *(pa.array(x, pa.int64()) for x in (starts, loss_starts, lengths))], names=["tree", "branch", "pos", "part", "start", "loss_start", "loss_length"])

    return rows.mapInArrow(write, PARTS.format(kind=kind))


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations gives: one row each. Parts are in order within partitions."""
    kind = formatted.schema["tree"].dataType.simpleString()
    names = ["tree", "branch", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, None

        def closed() -> pa.RecordBatch:
            row = [*of, state["n"], state["turns"].hexdigest(), state["loss"], state["loss_sha"].hexdigest(), state["chars"]]
            if state["reader"].buffer:
                raise ValueError("a turn has no end")
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        types = None
        for batch in batches:
            types = [batch.schema.field("tree").type, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for tree, branch, pos, part, start, loss_start, length in zip(*(c.to_pylist() for c in batch.columns)):
                if pos == 0 or (tree, branch) != of:
                    if of is not None:
                        yield closed()
                    of, state = (tree, branch), {"n": 0, "turns": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0, "reader": TurnReader()}
                state["chars"] += len(part)
                for role, text in state["reader"].feed(part):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                if length >= 0:
                    masked = unescape(part[loss_start - start : loss_start - start + length])
                    state["loss"] += len(masked)
                    state["loss_sha"].update(masked.encode())
        if of is not None:
            yield closed()

    return formatted.mapInArrow(read, f"tree {kind}, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def thread_messages(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages of plain conversations: each turn answers the one before it; turns that tie follow by role and text."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).asc_nulls_first(), "role", "text")).cast("long")
    rows = rows.select(F.col(key).alias("tree"), place.alias("node"), "role", "text")
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
