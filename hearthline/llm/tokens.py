"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pre-tokens; within each, the adjacent pair of lowest rank is popped from a heap
and merged in a linked list until no pair has a rank. The count is symbols minus merges.

Nulls count as empty texts (0 bytes, 0 tokens). Extra input columns are ignored. Repeated rows give
repeated results. Long pre-tokens cost n log n and are not kept in the memo.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the public byte-level vocabulary: its pre-token pattern and its special token.
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
SPECIAL = "<|endoftext|>"

#: A space between white space on both sides may lie inside a pre-token; all other spaces start one.
INNER_SPACE = re.compile(r"\s \s")
OUTER_SPACE = re.compile(r" (?=\S)")

MEMO_ENTRIES = 300_000
MEMO_LONGEST = 48


class Memo(dict):
    """A dict that computes what it lacks and keeps the last two generations of limited size."""

    def __init__(self, compute: Callable[[str], Any], limit: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key: str) -> Any:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= MEMO_LONGEST:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it
    is printable Latin-1, else the next free one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def split_spaces(text: str) -> list[str]:
    """Pieces of text between spaces that start a pre-token: each after the first lacks its space."""
    return OUTER_SPACE.split(text) if INNER_SPACE.search(text) else text.split(" ")


class ByteMerger:
    """Merge ranks of a byte-level tokenizer file, and the merging loop."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.words = Memo(self.count_pretoken)
        self.pieces = Memo(lambda piece: self.count_pretokens(" " + piece))

    def count_pretoken(self, word: str) -> int:
        """Symbols that are left when no adjacent pair has a rank."""
        symbol = [self.symbols[b] for b in word.encode()]
        n = left = len(symbol)
        if n == 1:
            return 1
        ranks, after, before = self.ranks, [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := ranks.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = a + b, ""
            left -= 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((a + b, symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, symbol[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbol[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, symbol[h], a + b))
        return left

    def count_pretokens(self, text: str) -> int:
        words = self.words
        return sum(words[w] for w in PRETOKEN.findall(text))

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special string inside it is one token."""
        parts = text.split(SPECIAL)
        total = len(parts) - 1
        for part in parts:
            if part:
                first, *rest = split_spaces(part)
                total += self.count_pretokens(first) + sum(map(self.pieces.__getitem__, rest))
        return total


@lru_cache(maxsize=4)
def merger(path: str) -> ByteMerger:
    """One per Python worker."""
    return ByteMerger(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row's whole text; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(tokenizer_path).count
        for batch in batches:
            texts = batch.column("text")
            n_bytes, n_tokens = [], []
            for value in texts:
                text = value.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
