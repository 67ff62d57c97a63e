"""Sequence packing as vector bin packing with the dot-product heuristic.

Every example has a vector of sizes: tokens, segments (one per example) and loss-bearing tokens. A sequence has a limit
in each dimension. An open sequence takes, of the waiting examples that still fit, the one whose sizes have the largest
dot product with what is left, both measured in shares of the limits; so it favours examples that use up what is
plentiful. Where cutting is allowed, an example is cut when nothing that waits fits whole, so a sequence ends full; one
that ends at another limit, and the last one of a partition, is cut into powers of two, which need no padding.

Each partition of the input packs its own rows in one streaming pass: there is no shuffle, at most ``POOL`` examples
wait at a time, and a lost task packs the same rows the same way again. Sequence identifiers hold the partition's number.

Defined results: a null text is empty and has the end token alone. Rows are packed one by one, repeated ones too. An
empty table gives no rows. With cutting off, an example beyond a limit has a sequence to itself, marked ``oversized``.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .token_count import byte_symbols

#: How the tokenizer cuts a text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
POOL = 512
MOST_KEPT = 400_000
_two_spaces = re.compile(r"\s\s")
_unit = re.compile(r"\s*\S+|\s+")


class UnitEncoder:
    """Token ids of a text as bytes, unit by unit; the tokenizer file is a byte-level BPE in the format of ``tokenizers``.

    In this tokenizer's pattern no token reaches from a word into the white space after it, so a stretch of white space
    with the word that follows is encoded the same wherever it stands; units met before are looked up. New ones are
    merged by ``tiktoken`` with the file's own vocabulary, many times faster on single words; the tests hold the ids
    against those of ``tokenizers``.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)
        #: Ids of units as they are, and of words that one blank precedes.
        self.units: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def ids_of(self, unit: str) -> bytes:
        ids = self.encoding.encode(unit, allowed_special="all")
        return struct.pack(f"<{len(ids)}I", *ids)

    def looked_up(self, keys: list[str], known: dict[str, bytes], blank: str) -> list[bytes]:
        parts = list(map(known.get, keys))
        if None in parts:
            new = list({k for k, x in zip(keys, parts) if x is None})
            if len(known) > MOST_KEPT:
                known.clear()
            for k in new:  # a line feed before a word was set apart by a blank that is not in the text
                known[k] = self.ids_of(k if k[:1] == "\n" else blank + k)
            parts = [known[k] if x is None and k in known else x for k, x in zip(keys, parts)]
        return parts

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if _two_spaces.search(text):
            return np.frombuffer(b"".join(self.looked_up(_unit.findall(text), self.units, "")), "<u4")
        # White space is single: cut before each blank or line feed; other white space stays inside its unit.
        first, *words = text.replace("\n", " \n").split(" ")
        head = self.looked_up([first], self.units, "") if first else []
        return np.frombuffer(b"".join(head + self.looked_up(words, self.words, " ")), "<u4")


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


class Packer:
    """Places examples one stream after another; ``place`` gets (example, start, length, sequence, offset)."""

    def __init__(self, limits: tuple[int, int, int], cutting: bool, place: Callable[[object, int, int, int, int], None], pool: int = POOL) -> None:
        self.limits, self.cutting, self.place, self.size = np.array(limits, np.float64), cutting, place, pool
        self.sizes = np.zeros((pool, 3))
        self.free = list(range(pool))
        self.waiting: list = [None] * pool
        self.used = np.zeros(pool, bool)
        self.sequence = 0
        self.left = self.limits.copy()
        self.filled = 0

    def add(self, example: object, tokens: int, loss: Callable[[int, int], int], start: int = 0) -> None:
        """``loss`` counts the loss-bearing tokens between two positions of the example."""
        while not self.free:
            self.take()
        at = self.free.pop()
        self.waiting[at] = (example, start, tokens, loss)
        self.sizes[at] = (tokens, 1, loss(start, start + tokens))
        self.used[at] = True

    def close(self) -> None:
        if self.filled:
            self.sequence += 1
            self.left, self.filled = self.limits.copy(), 0

    def put(self, at: int, tokens: int) -> None:
        example, start, size, loss = self.waiting[at]
        self.place(example, start, tokens, self.sequence, self.filled)
        self.left -= (tokens, 1, loss(start, start + tokens))
        self.filled += tokens
        self.used[at] = False
        self.free.append(at)
        if tokens < size:
            self.add(example, size - tokens, loss, start + tokens)
        if self.left[0] < 1 or self.left[1] < 1:
            self.close()

    def take(self) -> None:
        """One placement: the best example that fits, or a cut of the one that waits, or a new sequence."""
        fits = self.used & (self.sizes <= self.left).all(axis=1)
        if fits.any():
            score = self.sizes @ (self.left / self.limits**2)
            at = int(np.where(fits, score, -1.0).argmax())
            self.put(at, self.waiting[at][2])
            return
        at = int(np.where(self.used, self.sizes @ (1 / self.limits**2), -1.0).argmax())
        example, start, size, loss = self.waiting[at]
        if self.cutting:
            low, high = 0, int(min(size, self.left[0]))
            while low < high:  # the longest beginning within the limit of loss-bearing tokens
                middle = (low + high + 1) // 2
                if loss(start, start + middle) <= self.left[2]:
                    low = middle
                else:
                    high = middle - 1
            if low:
                self.put(at, low)
                return
        if self.filled:
            self.close()
        else:
            self.put(at, size)
            self.close()

    def finish(self) -> None:
        while self.used.any():
            self.take()
        self.close()


def powers(length: int) -> list[int]:
    return [1 << k for k in reversed(range(length.bit_length())) if length >> k & 1]


def pack_texts(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 0, max_tokens: int = 1024, max_segments: int = 256, max_loss_tokens: int = 1024) -> DataFrame:
    """Pieces of all texts, each with its place in a sequence: key, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``. Every token bears loss but the end token."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.spark_partition_id().cast("long").alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer_path)
        placed: list[tuple] = []
        full: list[tuple] = []
        sequences = 0
        packer = Packer((max_tokens, max_segments, max_loss_tokens), True, lambda *x: placed.append(x))

        def settle(last: bool) -> None:
            """Number the sequences that are closed; those that are not full are cut into powers of two."""
            nonlocal sequences, placed
            done = [x for x in placed if last or x[3] < packer.sequence]
            placed = [] if last else [x for x in placed if x[3] >= packer.sequence]
            groups: dict[int, list] = {}
            for x in done:
                groups.setdefault(x[3], []).append(x)
            for group in groups.values():
                total = sum(x[2] for x in group)
                sizes = powers(total) if total < max_tokens else [max(total, max_tokens)]
                at, room = 0, sizes[0]
                for example, start, length, _, _ in group:
                    while length:
                        n = min(length, room)
                        doc, ids = example
                        crc = zlib.crc32(ids[start : start + n].tobytes())
                        full.append((doc, start, n, crc, len(ids), base + sequences, at))
                        start, length, at, room = start + n, length - n, at + n, room - n
                        if not room and len(sizes) > 1:
                            sizes.pop(0)
                            sequences, at, room = sequences + 1, 0, sizes[0]
                sequences += 1

        def drained() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(full), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*full[i : i + 4096])], names=names)
            full.clear()

        base = 0
        for batch in batches:
            keys, parts, texts = (c.to_pylist() for c in batch.columns)
            base = parts[0] << 36 if parts else base
            for doc, t in zip(keys, texts):
                ids = np.append(code.encode(t), np.uint32(end_id)).astype("<u4")
                size = len(ids)
                loss = lambda a, b, n=size: min(b, n - 1) - min(a, n - 1)
                whole = size - size % max_tokens
                for start in range(0, whole, max_tokens):
                    packer.add((doc, ids), max_tokens, loss, start)
                if size > whole:
                    packer.add((doc, ids), size - whole, loss, whole)
                if len(placed) > 2048:
                    settle(False)
                    yield from drained()
        packer.finish()
        settle(True)
        yield from drained()

    out = rows.mapInArrow(pack, ", ".join(f"{n} long" for n in names))
    return out.withColumnRenamed("key", key)
