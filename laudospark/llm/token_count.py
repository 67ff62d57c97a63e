"""Exact token counts by a compiled transducer.

Two deterministic machines stand in for the tokenizer. The scanner walks character classes and cuts a stretch of
text between white space into words. The byte-pair machine reads a word's byte symbols; its states are the histories
of last tokens, and each transition carries the number of tokens it adds (negative where a longer token swallows
earlier ones). Transitions are compiled from the merge table when first met and kept.

A text is cut into chunks of ``CHUNK`` characters. Words never span white space, so a chunk gives (open head, count of
what lies between, open tail), and what joins two chunks is counted when they are combined. A text is counted within its
row: its chunks' results are combined in neighbouring pairs, one after another and not in parallel, and only the total
is kept. A chunk without white space is handed on as it is and counted with what follows it. Rows are what is parallel.

Defined results: null and empty texts have 0 tokens. Special tokens written in a text count as one each, as the
library treats them by default. Rows, repeated or not, are counted one by one; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

CHUNK = 1 << 15
NEVER = 1 << 60
#: Kept states, and kept words and stretches, per worker; beyond, a table starts anew. This bounds memory only.
MOST_STATES, MOST_WORDS = 200_000, 700_000
#: Bytes from which a word is run without keeping its states.
LONG_WORD = 64
#: Characters with the property White_Space (fixed values).
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_space_run = re.compile(f"[{SPACES}]+")
#: str.split() also splits on these four, the tokenizer doesn't.
_odd = re.compile("[\x1c-\x1f]")
_letter = regex.compile(r"\p{L}")
_number = regex.compile(r"\p{N}")
#: Contractions that are a word of their own where a word begins (fixed values).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Transducer:
    """Counts tokens of stretches without white space."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.longest = max(len(t.removesuffix(self.suffix) if self.suffix else t) for t in model["vocab"])
        self.tokens = set(model["vocab"])
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.symbols = byte_symbols()
        self.classes: dict[str, str] = {}
        self.made = {"".join(pair): (rank, pair) for pair, rank in reversed(self.ranks.items())}
        self.spines: tuple[dict, dict] = ({}, {})
        self.wholes: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, int] = {}
        self.stretches: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        #: A state holds the last token and the count at each of the latest positions; state 0 is the start of a word.
        self.histories: list[tuple[tuple[str, int], ...]] = [(("", 0),)]
        self.bodies: list[str] = [""]
        self.steps: dict[int, tuple[int, int]] = {}

    # The byte-pair machine

    def merged(self, parts: list[str]) -> list[str]:
        """Lowest-ranked pair first, leftmost first, until no pair has a rank."""
        parts = list(parts)
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[at : at + 2] = ["".join(parts[at : at + 2])]
        return parts

    def split(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            body = token.removesuffix(self.suffix)
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def spine(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """Pieces that lie at one end (0 left, 1 right) of the token while it is being merged, each with the rank of
        the merge that makes it and of the one that takes it up."""
        if (known := self.spines[side].get(token)) is None:
            known, piece, taken = [], token, NEVER
            while piece in self.made:
                rank, pair = self.made[piece]
                known.append((piece, rank, taken))
                piece, taken = pair[side], rank
            known.append((piece, -1, taken))
            self.spines[side][token] = known
        return known

    def whole(self, token: str) -> bool:
        """Whether a word that is spelled like the token becomes that token."""
        if (known := self.wholes.get(token)) is None:
            known = self.wholes[token] = self.merged(self.split(token)) == [token]
        return known

    def fit(self, left: str, right: str) -> bool:
        """Whether the two tokens stay as they are side by side; the empty left one is the start of a word.

        Ranks are times: a pair across the border merges if both pieces are there at its rank. Of equal ranks the left
        one goes first.
        """
        if (known := self.fits.get((left, right))) is None:
            if len(self.fits) > MOST_STATES:
                self.fits.clear()
            known = self.fits[left, right] = self.whole(right) and not (left and self.meets(left, right))
        return known

    def meets(self, left: str, right: str) -> bool:
        ranks = self.ranks
        for a, from_a, to_a in self.spine(left, 1):
            for b, from_b, to_b in self.spine(right, 0):
                rank = ranks.get((a, b))
                if rank is not None and from_a < rank < to_a and from_b < rank <= to_b:
                    return True
        return False

    def advance(self, history: tuple, body: str, symbol: str) -> tuple[tuple, str]:
        """The history after one more symbol: the one token that can end there, and the count up to it."""
        body = (body + symbol[0])[-self.longest :]
        end, tokens = symbol[1:], self.tokens
        spelled = body + end
        for start in range(max(0, len(body) - len(history)), len(body)):
            token = spelled[start:]
            if token in tokens:
                previous, at = history[start - len(body)]
                if self.fit(previous, token):
                    return (*history, (token, at + 1))[-self.longest :], body
        raise ValueError("the vocabulary lacks a byte symbol")

    def compile_step(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, tokens added) of a transition; symbols from 256 on are bytes that end a word."""
        text = self.symbols[symbol & 255] + (self.suffix if symbol > 255 else "")
        history, body = self.advance(self.histories[state], self.bodies[state], text)
        self.histories.append(history)
        self.bodies.append(body)
        known = self.steps[state << 9 | symbol] = (len(self.histories) - 1, history[-1][1] - self.histories[state][-1][1])
        return known

    def word(self, word: str) -> int:
        """Tokens of one word: the sum over the transitions of its bytes, the last one marked as the word's end."""
        if (known := self.words.get(word)) is not None:
            return known
        data = word.encode("utf-8", "replace")
        state = total = 0
        if len(data) > LONG_WORD:  # seldom met again: its states are not kept
            history, body = self.histories[0], ""
            for b in data[:-1]:
                history, body = self.advance(history, body, self.symbols[b])
            return self.advance(history, body, self.symbols[data[-1]] + self.suffix)[0][-1][1]
        steps = self.steps
        for b in data[:-1]:
            state, added = steps.get(state << 9 | b) or self.compile_step(state, b)
            total += added
        b = data[-1] | 256
        total += (steps.get(state << 9 | b) or self.compile_step(state, b))[1]
        self.words[word] = total
        return total

    # The scanner

    def kind(self, c: str) -> str:
        if (known := self.classes.get(c)) is None:
            known = self.classes[c] = "L" if _letter.match(c) else "N" if _number.match(c) else "O"
        return known

    def scanned(self, text: str) -> Iterator[str]:
        """Words of normalised text without white space."""
        if text.isalpha():
            yield text
            return
        start, state = 0, ""
        i = 0
        while i < len(text):
            c = self.kind(text[i])
            if state and (c != state or state == "N"):
                yield text[start:i]
                start, state = i, ""
            if not state:
                for x in CONTRACTIONS if text[i] == "'" else ():
                    if text.startswith(x, i):
                        yield x
                        i += len(x)
                        start = i
                        break
                else:
                    state = c
                    i += 1
                continue
            i += 1
        if start < len(text):
            yield text[start:]

    def stretch(self, raw: str) -> int:
        """Tokens of a stretch of raw text without white space."""
        if (known := self.stretches.get(raw)) is not None:
            return known
        if len(self.steps) > MOST_STATES:
            self.reset()
        for kept in (self.words, self.stretches):
            if len(kept) > MOST_WORDS:
                kept.clear()
        n = 0
        parts = [raw]
        if self.special and (found := self.special.findall(raw)):
            n, parts = len(found), self.special.split(raw)
        for part in parts:
            text = unicodedata.normalize("NFC", part)
            # Each character is lower-cased by itself, so a sigma at the end of a word is none in particular.
            text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
            for piece in _space_run.split(text):
                n += sum(map(self.word, self.scanned(piece)))
        if len(raw) < 64:
            self.stretches[raw] = n
        return n

    # Chunks

    def stretches_of(self, text: str) -> list[str]:
        return _space_run.split(text) if _odd.search(text) else text.split()

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(open head, tokens between, open tail); tokens are None if the chunk has no white space: all is head."""
        parts = self.stretches_of(chunk)
        first, last = bool(_space_run.match(chunk[:1])), bool(_space_run.match(chunk[-1:]))
        parts = [p for p in parts if p]
        if not first and not last and len(parts) == 1:
            return chunk, None, ""
        head = "" if first or not parts else parts.pop(0)
        tail = "" if last or not parts else parts.pop()
        known = self.stretches
        return head, sum(known[p] if p in known else self.stretch(p) for p in parts), tail

    def compose(self, a: tuple, b: tuple) -> tuple:
        (head, n, tail), (head2, m, tail2) = a, b
        if n is None:
            return (head + head2, m, tail2)
        if m is None:
            return (head, n, tail + head2)
        return (head, n + m + (self.stretch(tail + head2) if tail or head2 else 0), tail2)

    def count(self, text: str, chunk: int = CHUNK) -> int:
        maps = [self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        if not maps:
            return 0
        head, n, tail = maps[0]
        return (self.stretch(head) if head else 0) + (n or 0) + (self.stretch(tail) if tail else 0)


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The machine for a tokenizer file, compiled once per worker."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """Key, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row. The path must hold on the executors too."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_path)
        for batch in batches:
            texts = batch.column("text")
            n = [machine.count(t) for t in texts.to_pylist()]
            size = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), size, pa.array(n, pa.int64())], names=["key", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
