"""Packing by first-fit decreasing over a tournament tree of bin capacities.

Documents are dealt at random (by a seeded hash of the row, its task and, of repeated rows, its turn)
into groups of about `group_size`; each group is packed on its own. A document's ids are cut into full sequences and a tail. Tails are packed first
fit, longest first; the leftmost bin with room is found by walking down a tournament tree that holds
the largest free capacity below each node. Since documents may be cut anywhere, the emptiest bins
then fill the gaps of the fuller ones, and the one bin that stays underfull is cut into power-of-two
sequences, which need no padding.

A null or empty text has only its end id. Extra columns are ignored. Repeated rows are packed each on
its own. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from hearthline.llm.common import keyed
from hearthline.llm.tokens import PRETOKEN, SPECIAL, Memo, byte_symbols, split_spaces

#: Longer strings go to the library: the faster encoder's pattern fails on a million white spaces in a row.
LONGEST = 1 << 16

PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Encoder:
    """Ids of a byte-level tokenizer file, as strings of unsigned 16-bit numbers (of 32-bit ones if the
    vocabulary has more), memoised by piece.

    The file's vocabulary is handed to a byte-pair encoder that is faster on short strings than the
    library the file is for; tests hold both against each other. Long strings are left to the library.
    """

    def __init__(self, path: str):
        self.path = path
        file = json.load(open(path, encoding="utf-8"))
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in file["model"]["vocab"].items() if s not in special}
        self.bpe = tiktoken.Encoding("file", pat_str=PRETOKEN.pattern.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=ranks, special_tokens={})
        self.dtype = "<u2" if max([*special.values(), *ranks.values()]) < 1 << 16 else "<u4"
        self.special = np.array([special[SPECIAL]], self.dtype).tobytes()
        self.pieces = Memo(lambda piece: self.plain(" " + piece))

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def plain(self, text: str) -> bytes:
        ids = self.bpe.encode_ordinary(text) if len(text) <= LONGEST else self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        out = []
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                out.append(self.special)
            if part:
                first, *rest = split_spaces(part)
                out.append(self.plain(first))
                out.extend(map(self.pieces.__getitem__, rest))
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class FirstFit:
    """Tournament tree over bins: each node has the largest free capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.size)

    def place(self, need: int) -> tuple[int, int]:
        """The leftmost bin with room for need, and the free capacity it had."""
        free, node = self.free, 1
        while node < self.size:
            node *= 2
            if free[node] < need:
                node += 1
        had = free[node]
        free[node] = had - need
        bin_no = node - self.size
        node //= 2
        while node:
            free[node] = max(free[2 * node], free[2 * node + 1])
            node //= 2
        return bin_no, had


def pack_lengths(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length): first-fit decreasing, then gaps filled from the emptiest bins,
    and the last underfull bin cut into powers of two. Item lengths are from 1 to capacity."""
    tree, bins, used = FirstFit(len(lengths), capacity), {}, {}
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        at, _ = tree.place(lengths[item])
        bins.setdefault(at, []).append((item, 0, lengths[item]))
        used[at] = used.get(at, 0) + lengths[item]
    done = [bins[b] for b in bins if used[b] == capacity]
    rest = sorted((b for b in bins if used[b] < capacity), key=lambda b: -used[b])
    i, j = 0, len(rest) - 1
    while i < j:
        to, of = rest[i], rest[j]
        item, start, length = bins[of].pop()
        moved = min(length, capacity - used[to])
        bins[to].append((item, start + length - moved, moved))
        if moved < length:
            bins[of].append((item, start, length - moved))
        used[to] += moved
        used[of] -= moved
        if used[to] == capacity:
            done.append(bins[to])
            i += 1
        if not used[of]:
            j -= 1
    if i == j:
        size, queue = used[rest[i]], bins[rest[i]][::-1]
        for bit in reversed(range(size.bit_length())):
            want, part = size & (1 << bit), []
            while want:
                item, start, length = queue.pop()
                cut = min(want, length)
                part.append((item, start, cut))
                if cut < length:
                    queue.append((item, start + cut, length - cut))
                want -= cut
            if part:
                done.append(part)
    return done


def pack_documents(docs: DataFrame, tokenizer_path: str, sequence: int = 1024, end_id: int = 0, group_size: int = 1024, seed: int = 7) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    groups = max(1, -(-docs.count() // group_size))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, task, met = encoder(tokenizer_path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            dealt, n_tokens, crcs, tails = [], [], [], []
            for doc, th, value in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(np.frombuffer(made.encode(value.as_py()), made.dtype).astype("<u4"), np.uint32(end_id))
                whole = len(ids) // sequence * sequence
                # Repeated rows are told apart by task and turn, so that they don't meet in one group.
                dealt.append(xxhash.xxh3_64_intdigest(f"{seed} {doc} {th} {task} {met[doc, th]}") % groups)
                met[doc, th] += 1
                n_tokens.append(len(ids))
                crcs.append([crc(ids[k : k + sequence]) for k in range(0, whole, sequence)])
                tails.append(ids[whole:].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(dealt, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())],
                ["doc_id", "grp", "doc_tokens", "crcs", "tail"],
            )

    def pack(group: pa.Table) -> pa.Table:
        base = group.column("grp")[0].as_py() << 32
        order = sorted(zip(*(group.column(c).to_pylist() for c in ("doc_tokens", "doc_id", "tail", "crcs")), strict=True), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
        rows, at = [], 0
        for total, doc, _, full in order:
            for k, c in enumerate(full):
                rows.append((doc, k * sequence, sequence, c, total, base + at, 0))
                at += 1
        items = [r for r in order if r[2]]
        for bin_ in pack_lengths([len(r[2]) // 4 for r in items], sequence):
            offset = 0
            for item, start, length in bin_:
                total, doc, tail, _ = items[item]
                piece = np.frombuffer(tail, "<u4")[start : start + length]
                rows.append((doc, total // sequence * sequence + start, length, crc(piece), total, base + at, offset))
                offset += length
            at += 1
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=PIECES)

    encoded = keyed(docs).mapInArrow(encode, "doc_id long, grp long, doc_tokens long, crcs array<long>, tail binary")
    return encoded.groupBy("grp").applyInArrow(pack, ", ".join(f"{c} long" for c in PIECES))
