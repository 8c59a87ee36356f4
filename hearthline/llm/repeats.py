"""What the two repeated-passage operators share: content-defined units, a count-min prefilter, spans.

Every window of `window` symbols is assigned to its least-hashed gram (its anchor), a choice that only
the window's content decides; a run of windows with one anchor is a unit. Equal windows have equal
anchors at equal offsets, so repeats are sought among units whose anchor gram occurs again. A unit is
some 150 bytes (or 13 words) of windows, so that far fewer rows move than there are windows.

The prefilter is a count-min sketch of anchor grams, merged from all partitions by a tree of 64-way
steps. Its cells are sized by the corpus, eight for each expected anchor, up to 2 rows of 2^28 bits
once merged (64 MB). It only ever overestimates: units it lets through are grouped exactly, none that
repeats is lost; on a corpus so large that the sketch is full, more units pass, and results stay the
same. Contents and windows are told apart by 128-bit BLAKE2b digests of their bytes, which no two
different strings are known to share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import discard, stored

#: Cells of a row of the sketch are a power of two between these, so many for each expected anchor.
LEAST_CELL_BITS, MOST_CELL_BITS, CELLS_PER_ANCHOR = 20, 28, 8
SLICE_BITS = 18
#: So many sketches are merged in one step of the tree.
FAN = 64
ROWS = 2
SEGMENT = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)

Symbols = Callable[[str], np.ndarray]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Polynomial hashes modulo 2^64 of every n consecutive symbols of a segment."""

    def __init__(self, base: np.uint64, longest: int):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, base)]), dtype=np.uint64)
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, inverse)]), dtype=np.uint64)

    def __call__(self, symbols: np.ndarray, n: int) -> np.ndarray:
        sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.up[: len(symbols)], out=sums[1:])
        return mixed((sums[n:] - sums[:-n]) * self.down[: len(sums) - n])


class Windows:
    """Units of a sequence of 64-bit symbols."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram, self.reach = window, gram, window - gram + 1
        self.roll = Rolling(BASE, SEGMENT + 2 * window)

    def units(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor gram's hash, anchor, first and last window start of each unit, in order."""
        parts = [self._units(symbols[s : s + SEGMENT + self.window - 1], s) for s in range(0, max(0, len(symbols) - self.window + 1), SEGMENT)]
        if not parts:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _units(self, symbols: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
        h = self.roll(symbols, self.gram)
        m, n = self.reach, len(h) - self.reach + 1
        order = np.full(-(-len(h) // m) * m, ~np.uint64(0))  # a gram's hash above its place: ties go left
        order[: len(h)] = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        rows = order.reshape(-1, m)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(back[:n], ahead[m - 1 : m - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.append(first[1:], n) - 1
        a = anchor[first]
        return h[a], a + at, first + at, last + at


def digests(pieces: Iterable[bytes], salt: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit BLAKE2b digest of each piece, as signed 64-bit numbers."""
    whole = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16, salt=salt).digest() for x in pieces), "<i8").reshape(-1, 2)
    return whole[:, 0], whole[:, 1]


def _cells(keys: np.ndarray, row: int, cell_bits: int) -> np.ndarray:
    return ((mixed(keys ^ np.uint64(0x5851F42D4C957F2D * (row + 1) & (1 << 64) - 1))) >> np.uint64(64 - cell_bits)).astype(np.int64)


class Sketch:
    """For each row of the merged count-min sketch: which cells have counted two or more."""

    def __init__(self, slices: Iterable[tuple[int, int, bytes]], cell_bits: int = LEAST_CELL_BITS):
        self.cell_bits, self.bits = cell_bits, np.zeros((ROWS, (1 << cell_bits) // 8), np.uint8)
        size = (1 << SLICE_BITS) // 8
        for row, part, bits in slices:
            self.bits[row, part * size : (part + 1) * size] = np.frombuffer(bits, np.uint8)

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may occur twice; never false for one that does."""
        out = np.ones(len(keys), bool)
        for row in range(ROWS):
            cell = _cells(keys, row, self.cell_bits)
            out &= (self.bits[row, cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
        return out


def sketch_bits(docs: DataFrame, windows: Windows, symbol_bytes: int) -> int:
    """Bits of a cell number, from the corpus's size: a window's symbols beyond the gram hold some two anchors."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = 2 * size // (symbol_bytes * windows.reach)
    return min(MOST_CELL_BITS, max(LEAST_CELL_BITS, (CELLS_PER_ANCHOR * anchors).bit_length()))


SKETCHED = "task int, row int, slice int, cells binary, counts binary"


def count_anchors(docs: DataFrame, windows: Windows, symbols: Symbols, symbol_bytes: int = 1) -> Sketch:
    """One pass: each partition's sketch, in slices, summed by slice over a tree; the merged bits come to the driver."""
    window, gram, cell_bits = windows.window, windows.gram, sketch_bits(docs, windows, symbol_bytes)

    def rows_of(columns: list[list]) -> pa.RecordBatch:
        types = [pa.int32()] * 3 + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["task", "row", "slice", "cells", "counts"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, keys, task = Windows(window, gram), [], TaskContext.get().partitionId()
        for batch in batches:
            keys += [make.units(symbols(t.as_py()))[0] for t in batch.column("text")]
        every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        for row in range(ROWS):
            cell, n = np.unique(_cells(every, row, cell_bits), return_counts=True)
            part, starts = np.unique(cell >> SLICE_BITS, return_index=True)
            ends = np.append(starts[1:], len(cell))
            inside = (cell & ((1 << SLICE_BITS) - 1)).astype("<u4")
            capped = np.minimum(n, 2).astype(np.uint8)
            yield rows_of([[task] * len(part), [row] * len(part), part.tolist(), [inside[s:e].tobytes() for s, e in zip(starts, ends)], [capped[s:e].tobytes() for s, e in zip(starts, ends)]])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """The sum of a slice's sketches, two counting for all more."""
        total = np.zeros(1 << SLICE_BITS, np.uint8)
        for cells, counts in zip(pdf["cells"], pdf["counts"], strict=True):
            at = np.frombuffer(cells, "<u4")
            total[at] = np.minimum(2, total[at] + np.frombuffer(counts, np.uint8))
        some = np.flatnonzero(total)
        head = {c: pdf[c].iloc[:1] for c in ("task", "row", "slice")}
        return pd.DataFrame(head | {"cells": [some.astype("<u4").tobytes()], "counts": [total[some].tobytes()]})

    def bits_of(cells: bytes, counts: bytes) -> bytes:
        twice = np.zeros(1 << SLICE_BITS, bool)
        twice[np.frombuffer(cells, "<u4")] = np.frombuffer(counts, np.uint8) >= 2
        return np.packbits(twice, bitorder="little").tobytes()

    merged, at = stored(docs.select("text").mapInArrow(count, SKETCHED))
    tasks = 1 + (merged.agg(F.max("task")).first()[0] or 0)
    while True:
        merged = merged.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("task", "row", "slice").applyInPandas(merge, SKETCHED)
        tasks = -(-tasks // FAN)
        if tasks == 1:
            break
    found = Sketch(((r["row"], r["slice"], bits_of(r["cells"], r["counts"])) for r in merged.toLocalIterator()), cell_bits)
    discard(docs.sparkSession, at)
    return found


#: Members of an anchor's group up to which they are compared pair by pair; windows of larger groups are
#: grouped by digest, whatever the group's size. Both find the same.
PAIRWISE = 64


def shared_offsets(length: int, i: int, ahead: list[int], before: list[int], prefix: Callable[[int, int], int], behind: Callable[[int, int], int]) -> list[list[int]]:
    """Merged ranges of offsets o (window starts before the anchor) at which member i's window equals a
    window of another member: they share o symbols before the anchor and length - o from it on.

    ahead and before are the members' numbers of symbols from the anchor on and before it."""
    found = []
    for j in range(len(ahead)):
        if j == i:
            continue
        first = max(length - ahead[i], length - min(prefix(i, j), ahead[i], ahead[j]))
        if first <= before[i] and first <= (last := min(before[i], behind(i, j))):
            found.append([first, last])
    out: list[list[int]] = []
    for first, last in sorted(found):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(doc_id, th, start) of the windows whose content counts two or more over all rows. rows: doc_id, th,
    start, n (how many windows a row stands for; one with n > 1 is known to repeat) and the digest halves w1, w2."""
    counts = rows.groupBy("w1", "w2").agg(F.sum("n").alias("total")).filter("total >= 2").select("w1", "w2")
    return rows.filter("n = 1").join(counts, ["w1", "w2"]).select("doc_id", "th", "start")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (doc_id, th and one more column: text or row) with its own spans as arrays starts and ends, null
    where there are none. Repeated rows send the same spans, once each; a set keeps one of them."""
    own = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("own"))
    own = own.select(F.col("doc_id").alias("own_id"), F.col("th").alias("own_th"), F.col("own.start").alias("starts"), F.col("own.end").alias("ends"))
    return docs.join(own, (docs["th"] == own["own_th"]) & docs["doc_id"].eqNullSafe(own["own_id"]), "left").drop("own_id", "own_th")


def covered(n: int, starts: list[int] | None, ends: list[int] | None) -> tuple[np.ndarray, int]:
    """A flag for each of n symbols, and the number of maximal covered runs."""
    if not starts:
        return np.zeros(n, bool), 0
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.asarray(starts), 1)
    np.add.at(change, np.asarray(ends), -1)
    flags = np.cumsum(change[:n]) > 0
    return flags, int(np.count_nonzero(np.diff(flags.astype(np.int8), prepend=0) == 1))
