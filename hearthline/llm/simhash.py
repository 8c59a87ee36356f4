"""SimHash near-duplicates by anchor points of a covering code.

Anchors are the words of a covering code of radius 1 on 64 bits: the perfect Hamming code on 63 bits,
the last bit free. Two fingerprints at most 2 bits apart have a point within 1 bit of both, and that
point has an anchor within 1 bit, so both reach one anchor within radius + half the threshold = 2
bits. Each distinct fingerprint is replicated to its (at most 33) such anchors and compared within
each anchor only, where at most 2,081 distinct fingerprints can meet. An anchor returns a spanning
forest of its links, not all pairs; components follow from these.

A text of fewer words than a shingle is one shingle; a text without words, or null, has fingerprint
zero and is linked like any other. Equal fingerprints are one node, however many rows share it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import keyed, materialise, whole_rows
from hearthline.llm.components import connected_components

HASH_SEED = 42
BITS = 64
BLOCK = 1 << 16


def simhash(text: str, shingle: int = 3) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    ends = ends[shingle - 1 :] or ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, len(ends), BLOCK):
        hashes = np.array([digest(joined[s:e], HASH_SEED) for s, e in zip(starts[k : k + BLOCK], ends[k : k + BLOCK])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(ends), bitorder="little").view("<u8")[0])


def anchor_masks() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the masks that lead to the anchors within 2 bits, and how many there are."""
    bit = lambda position: 1 << (position - 1)  # noqa: E731  positions 1 to 63 are coded, bit 63 is free
    free = 1 << 63
    masks, sizes = np.zeros((64, 33), np.uint64), np.zeros(64, np.int64)
    for s in range(64):
        if s:
            found = [bit(s), bit(s) | free, *(bit(i) | bit(i ^ s) for i in range(1, 64) if i < i ^ s)]
        else:
            found = [0, free]
        masks[s, : len(found)], sizes[s] = found, len(found)
    return masks, sizes


def anchors_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints repeated, and an anchor for each."""
    checks = [sum(1 << (p - 1) for p in range(1, 64) if p >> b & 1) for b in range(6)]
    syndrome = sum((np.bitwise_count(prints & np.uint64(c)) & 1).astype(np.int64) << b for b, c in enumerate(checks))
    masks, sizes = anchor_masks()
    keep = np.arange(masks.shape[1]) < sizes[syndrome][:, None]
    return np.repeat(prints, sizes[syndrome]), (prints[:, None] ^ masks[syndrome])[keep]


def forest(bucket: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among one anchor's fingerprints."""
    near = np.bitwise_count(bucket[:, None] ^ bucket[None, :]) <= threshold
    root = np.arange(len(bucket))
    while True:
        least = np.where(near, root[None, :], len(bucket)).min(axis=1)
        if (least == root).all():
            return [(i, r) for i, r in enumerate(root.tolist()) if i != r]
        root = least


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, th and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    return keyed(docs).mapInArrow(run, "doc_id long, th long, fp long")


def links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """(u, v) edges that connect whatever fingerprints of column fp are linked by at most threshold bits."""
    if not 0 <= threshold <= 2:
        raise ValueError("anchors within 2 bits cover thresholds up to 2")

    def replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fps), 4096):
                fp, anchor = anchors_of(fps[k : k + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp.view(np.int64))], ["anchor", "fp"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; a group may run over the end of a batch."""
        anchor, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def edges(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(anchor)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(anchor)]])
            us, vs = [], []
            for s, e in zip(*(x[ends - starts > 1].tolist() for x in (starts, ends))):
                bucket = np.sort(fp[s:e])
                for i, r in forest(bucket.view(np.uint64), threshold):
                    us.append(bucket[i])
                    vs.append(bucket[r])
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

        for batch in batches:
            anchor = np.concatenate([anchor, batch.column("anchor").to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False)])
            if not len(anchor):
                continue
            whole = int(np.searchsorted(anchor, anchor[-1]))
            if whole:
                yield edges(anchor[:whole], fp[:whole])
                anchor, fp = anchor[whole:], fp[whole:]
        if len(anchor):
            yield edges(anchor, fp)

    near = prints.select("fp").mapInArrow(replicate, "anchor long, fp long").repartition(F.col("anchor")).sortWithinPartitions("anchor")
    return near.mapInArrow(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, threshold: int = 2) -> DataFrame:
    """doc_id, th, fp and component_id (the least doc_id that links reach) of every row."""
    prints = materialise(fingerprints(docs, shingle))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    root = connected_components(links(first, threshold)).withColumnRenamed("u", "fp")
    label = first.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = label.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(label.join(least, "root").select("fp", "component_id"), "fp")


def keep_one(docs: DataFrame, shingle: int = 3, threshold: int = 2) -> DataFrame:
    """One document of each group of linked fingerprints, with all its columns: the least doc_id, and of
    repeated rows of it the one whose columns' hash, then JSON text, is least. Rows without an id stay if no
    row of their group has one."""
    # Plain equalities on the same three columns: the join's partitioning serves the grouping too.
    key = [F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("without"), F.col("th")]
    firsts = near_duplicates(docs, shingle, threshold).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*key).distinct()
    kept = whole_rows(docs).select(*key, "row").join(firsts, ["k", "without", "th"], "left_semi")
    text = F.to_json("row")
    return kept.groupBy("k", "without", "th").agg(F.min_by("row", F.struct(F.xxhash64(text), text)).alias("row")).select("row.*")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
