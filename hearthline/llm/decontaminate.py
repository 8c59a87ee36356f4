"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over all texts.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. A window is `n`
consecutive words of an item, or a shorter item as a whole. Items are broadcast in blocks of at most
`block_chars` bytes of words (one item that is longer is cut into blocks that overlap by n - 1 words): sorted
64-bit window hashes beside the place of each window in the block's words, some 20 bytes a window. Hash
hits are verified against these words. A larger benchmark is scanned block after block; between two blocks
the rows are written to the shared folder, so that one index lives at a time.

Null texts have no words; empty items have no window. Windows of an item whose id is null hit like any
other, but the id is not reported. Items that share an id are one item. Extra columns are ignored and
clashing names cannot occur, since only doc_id and text (item_id and text) are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import discard, stored

#: Bytes to bytes: A-Z to a-z, ASCII letters, digits and all non-ASCII bytes as they are, the rest to a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the hash by which most windows are told apart before the sorted hashes are searched.
SIEVE_BITS = 22
BLOCK_CHARS = 1 << 22

SCANNED = "doc_id long, text string, n_words long, spans array<int>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def word_codes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit polynomial hash of every n consecutive codes."""
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        out = out * BASE + codes[k : k + len(out)]
    return (out ^ (out >> np.uint64(29))) * BASE


class GramIndex:
    """By window length, the sorted hashes of a block's windows, with the item and the place of each."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], n: int):
        self.names = [name for name, _ in items]
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        parts, at = [], 0
        for k, (_, words) in enumerate(items):
            length = min(n, len(words))
            if not length:
                continue
            ends = at + np.cumsum([len(w) + 1 for w in words])
            starts = np.append(at, ends[:-1])
            hashes = rolling(word_codes(words), length)
            found.setdefault(length, []).append((hashes, np.full(len(hashes), k, np.int32), starts[: len(hashes)].astype(np.int32), (ends[length - 1 :] - 1).astype(np.int32)))
            parts.append(b" ".join(words))
            at = int(ends[-1])
        self.words = b" ".join(parts)
        self.windows: dict[int, tuple[np.ndarray, ...]] = {}
        for length, rows in sorted(found.items()):
            hashes, *rest = (np.concatenate(c) for c in zip(*rows, strict=True))
            order = np.argsort(hashes, kind="stable")
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[(hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
            self.windows[length] = (np.packbits(sieve, bitorder="little"), hashes[order], *(c[order] for c in rest))

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Hit spans as a flat list of starts and ends, merged and in order, and the items that occur."""
        cover, found = np.zeros(len(words) + 1, np.int64), set()
        codes = word_codes(words)
        for m, (sieve, hashes, item, start, end) in self.windows.items():
            if len(words) < m:
                continue
            h = rolling(codes, m)
            cell = (h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)
            at = np.flatnonzero(sieve[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
            first = np.searchsorted(hashes, h[at])
            equal = hashes[np.minimum(first, len(hashes) - 1)] == h[at]
            at, first = at[equal], first[equal]
            for k, lo, hi in zip(at.tolist(), first.tolist(), np.searchsorted(hashes, h[at], "right").tolist(), strict=True):
                window = b" ".join(words[k : k + m])
                same = {int(item[x]) for x in range(lo, hi) if self.words[start[x] : end[x]] == window}
                if same:
                    found |= {name for x in same if (name := self.names[x]) is not None}
                    cover[k] += 1
                    cover[k + m] -= 1
        inside = np.concatenate([[0], np.cumsum(cover) > 0])
        return np.flatnonzero(np.diff(inside.astype(np.int8))).tolist(), found


def merge_spans(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def blocks(benchmark: DataFrame, n: int, block_chars: int) -> Iterator[GramIndex]:
    """An index for each block of items. Items stream to the driver, a partition at a
    time; it holds the words of one block and the index of another."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    held, size = [], 0
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        while words:
            # A long item goes on n - 1 words before the cut, so that no window is lost or made.
            taken, used = 0, 0
            while taken < len(words) and (taken < n or used < block_chars):
                used += len(words[taken]) + 1
                taken += 1
            if held and size + used > block_chars:
                yield GramIndex(held, n)
                held, size = [], 0
            held.append((row["item_id"], words[:taken]))
            size += used
            words = words[taken - n + 1 :] if taken < len(words) else []
    if held:
        yield GramIndex(held, n)


def over_blocks(rows: DataFrame, benchmark: DataFrame, n: int, block_chars: int, step) -> DataFrame:
    """step(rows, broadcast index) for every block; rows are stored between two blocks."""
    spark, stored_at = rows.sparkSession, None
    found = blocks(benchmark, n, block_chars)
    index = next(found, None) or GramIndex([], n)
    while index is not None:
        following = next(found, None)
        rows = step(rows, spark.sparkContext.broadcast(index))
        if following is not None:
            before = stored_at
            rows, stored_at = stored(rows)
            if before is not None:
                discard(spark, before)
        index = following
    return rows


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, text, n_words, spans (word offsets, flat: start, end, ...), items of every document."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )

    def step(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                counts, spans, items = [], [], []
                for text, old, had in zip(batch.column("text"), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
                    words = words_of(text.as_py())
                    hit, found = index.scan(words)
                    counts.append(len(words))
                    spans.append(merge_spans(old, hit) if old else hit)
                    items.append(sorted(found.union(had)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text"), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                    ["doc_id", "text", "n_words", "spans", "items"],
                )

        return rows.mapInArrow(run, SCANNED)

    return over_blocks(rows, benchmark, n, block_chars, step)


def digest(scanned: DataFrame) -> DataFrame:
    """The counts and the digest of the hit items of each document."""
    pairs = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return scanned.select(
        "doc_id", "n_words", pairs.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without any hit, with all their columns; no shuffle, one pass per block of items."""

    def step(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                yield batch.filter(pa.array([not index.scan(words_of(text.as_py()))[0] for text in batch.column("text")], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    return over_blocks(docs, benchmark, n, block_chars, step)
