"""Exact duplicates through Patricia tries.

Every partition of the input inserts its normalised texts, as full byte strings, into a compressed radix trie. A
terminal node keeps the owner (smallest or largest identifier, as asked) and the number of copies, so each partition
passes on one row per distinct text, however many copies it holds. Those rows are dealt out by length and content hash,
and a second trie per partition finds the owner of each text over all partitions. Documents find their group's owner
through the row that stood for them in their own partition; that key repeats within one partition only, so no join key
is hot.

A trie holds at most ``TRIE_BYTES`` of text. Beyond that its largest subtree goes to a scratch file of the task, later
texts of that subtree follow it, and the file is worked through on its own after the rest; a subtree that is still too
large is split again.

Defined results: a null text equals an empty one. Rows without identifier sort below all others. Equal rows with equal
identifiers are copies too: exactly one of them is kept. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, ship, written

TRIE_BYTES = 96 << 20
NODE_BYTES = 400
#: A payload is (owner, copies, stand-in row or rows), an owner (identifier is present, identifier, row).
Payload = tuple


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    """An edge label and what hangs below it."""

    __slots__ = ("label", "children", "payload", "file")

    def __init__(self, label: bytes, payload: Payload | None = None) -> None:
        self.label, self.payload = label, payload
        self.children: dict[int, Node] = {}
        self.file = None


class Trie:
    """Byte strings with payloads; ``items`` gives each distinct string with its merged payload.

    Over ``limit`` the largest subtree leaves: to ``evict``, if given, which gets its items, or else to a scratch file.
    """

    def __init__(self, merge: Callable, limit: int = TRIE_BYTES, evict: Callable | None = None) -> None:
        self.root, self.merge, self.limit, self.evict = Node(b""), merge, limit, evict
        self.held = self.spills = 0

    def insert(self, text: bytes, payload: Payload) -> Payload | None:
        """The merged payload of the text's terminal node; None if its subtree is in a file."""
        node, at = self.root, 0
        while True:
            if node.file is not None:
                pickle.dump((text[at:], payload), node.file)
                return None
            if at == len(text):
                node.payload = payload if node.payload is None else self.merge(node.payload, payload)
                return node.payload
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = Node(text[at:], payload)
                self.held += len(text) - at + NODE_BYTES
                break
            label = child.label
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = common_prefix(label, text[at : at + len(label)])
            fork = Node(label[:n])
            fork.children[label[n]] = child
            child.label = label[n:]
            node.children[text[at]] = fork
            self.held += NODE_BYTES
            node, at = fork, at + n
        while self.held > self.limit and self.spill():
            pass
        return payload

    def spill(self) -> bool:
        """Move the largest subtree below the first fork out; False if there is nothing to move."""
        node, path = self.root, b""
        while len(node.children) == 1 and node.file is None and node.payload is None:
            node = next(iter(node.children.values()))
            path += node.label
        held = [(weight(c), first, c) for first, c in node.children.items() if c.file is None]
        if node.file is not None or not held:
            return False
        freed, first, child = max(held, key=lambda x: x[0])
        self.spills += 1
        if self.evict is not None:
            self.evict(below(child, path + child.label))
            del node.children[first]
            self.held -= freed
            return True
        file = tempfile.TemporaryFile()
        for item in below(child, b""):
            pickle.dump(item, file)
        left = len(child.label) + NODE_BYTES
        child.children, child.payload, child.file = {}, None, file
        self.held -= freed - left
        return freed > left

    def items(self) -> Iterator[tuple[bytes, Payload]]:
        stack = [(self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            prefix += node.label
            if node.file is None:
                if node.payload is not None:
                    yield prefix, node.payload
                stack.extend((c, prefix) for c in node.children.values())
                continue
            node.file.seek(0)
            inner = Trie(self.merge, self.limit)
            for text, payload in unpickled(node.file):
                inner.insert(text, payload)
            node.file.close()
            for text, payload in inner.items():
                yield prefix + text, payload


def weight(node: Node) -> int:
    total, stack = 0, [node]
    while stack:
        x = stack.pop()
        total += len(x.label) + NODE_BYTES
        stack.extend(x.children.values())
    return total


def below(node: Node, prefix: bytes) -> Iterator[tuple[bytes, Payload]]:
    """Strings at and below a node, whose own label is in the prefix."""
    stack = [(node, prefix)]
    while stack:
        x, path = stack.pop()
        if x.file is not None:
            x.file.seek(0)
            yield from ((path + text, payload) for text, payload in unpickled(x.file))
            x.file.close()
        if x.payload is not None:
            yield path, x.payload
        stack.extend((c, path + c.label) for c in x.children.values())


def unpickled(file) -> Iterator[tuple[bytes, Payload]]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def merger(largest: bool) -> Callable[[Payload, Payload], Payload]:
    pick = max if largest else min

    def merge(a: Payload, b: Payload) -> Payload:
        a[2].extend(b[2])
        return pick(a[0], b[0]), a[1] + b[1], a[2]

    return merge


DOCS = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("stand_in", pa.int64()), ("sha", pa.string()), ("copies", pa.int64()), ("body", pa.binary())])
GROUPS = pa.schema([("stand_in", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])


def batches_of(rows: Iterable[tuple], schema: pa.Schema, most: int = 1024) -> Iterator[pa.RecordBatch]:
    run = []
    for row in rows:
        run.append(row)
        if len(run) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*run), schema)], schema=schema)
            run = []
    if run:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*run), schema)], schema=schema)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_largest: bool = True, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: key, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.spark_partition_id().cast("long").alias("part"), fold_ascii(F.col(text)).alias("body"))
    rows = rows.select("id", "part", F.sha2("body", 256).alias("sha"), F.col("body").cast("binary").alias("body"))
    pick = max if keep_largest else min

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row with the row that stands for its text in this partition, then the texts that these rows have."""
        left: list[tuple] = []

        def evict(items: Iterator[tuple[bytes, Payload]]) -> None:
            left.extend((owner[1] if owner[0] else None, owner[2], stand, None, n, body) for body, (owner, n, stand) in items)

        trie = Trie(lambda a, b: (pick(a[0], b[0]), a[1] + b[1], a[2]), trie_bytes, evict)
        count = 0
        for batch in batches:
            out = []
            for doc_id, part, sha, body in zip(*(c.to_pylist() for c in batch.columns)):
                row = (part << 36) + count
                count += 1
                stand = trie.insert(body, ((doc_id is not None, doc_id or 0, row), 1, row))[2]
                out.append((doc_id, row, stand, sha, None, None))
            yield from batches_of(out, DOCS)
            yield from batches_of(left, DOCS, 256)
            left.clear()
        for item in trie.items():
            evict(iter([item]))
            if len(left) == 256:
                yield from batches_of(left, DOCS)
                left.clear()
        yield from batches_of(left, DOCS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The owner of every text that partitions passed on, for each row that stood for it."""
        trie = Trie(merger(keep_largest), trie_bytes)
        for batch in batches:
            for doc_id, row, stand, n, body in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "stand_in", "copies", "body"))):
                trie.insert(body, ((doc_id is not None, doc_id or 0, row), n, [stand]))
        found = ((stand, owner[1] if owner[0] else None, owner[2], n) for _, (owner, n, stands) in trie.items() for stand in stands)
        yield from batches_of(found, GROUPS)

    ddl = "id long, row long, stand_in long, sha string, copies long, body binary"
    first = written(rows.mapInArrow(local, ddl), "exact")
    texts = first.where("copies is not null").select("id", "row", "stand_in", "copies", "body")
    dealt = texts.repartition(F.octet_length("body"), F.xxhash64("body"))
    groups = dealt.mapInArrow(meet, "stand_in long, keep_id long, keep_row long, group_size long")
    return (
        first.where("copies is null")
        .select("id", "row", "stand_in", "sha")
        .join(groups, "stand_in")
        .select(F.col("id").alias(key), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_largest: bool = True) -> DataFrame:
    """The rows that stay, all their columns as they were.

    Rows are told apart by key and text hash; rows equal in both are copies that only differ in other columns, and the
    one whose other columns sort first stays.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("no identifier"))
    stays = exact_groups(docs, key, text, keep_largest).where("kept").select(name(key).alias("__key"), F.col("text_sha256").alias("__sha"))
    place = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    named = docs.select(name(key).alias("__key"), F.sha2(fold_ascii(F.col(text)), 256).alias("__sha"), place)
    # Join and grouping have the same keys, so the rows are shuffled once.
    return named.join(stays, ["__key", "__sha"], "left_semi").groupBy("__key", "__sha").agg(F.min("__row").alias("__row")).select("__row.*")
