"""Repeated word windows: a count-min prefilter, then exact grouping of what it estimates repeated.

A word is covered if a window of `window` consecutive words around it has the same word sequence as
another window of any document. A first pass merges the partitions' sketches of anchor grams; a second
emits only units estimated repeated, which are grouped by their content (a 128-bit hash). Units that
occur whole more than once are covered; where an anchor has several contents, these are compared with
each other, or, if there are many, their windows are grouped one by one.

Null and empty texts have no words. Repeated rows repeat each other's windows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import discard, keyed, materialise, stored
from hearthline.llm.repeats import PAIRWISE, Windows, count_anchors, covered, digests, repeated_windows, shared_offsets, with_spans

GRAM = 9
#: Bytes of a word and its space, for the sketch's size.
WORD_BYTES = 6


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def text_symbols(text: str) -> np.ndarray:
    return word_hashes(text.encode().split())


def candidates(docs: DataFrame, windows: Windows) -> DataFrame:
    """A row for each unit whose anchor may repeat: key, content hash, place, and the words themselves
    where the task meets this content for the first time."""
    shared = docs.sparkSession.sparkContext.broadcast(count_anchors(docs, windows, text_symbols, WORD_BYTES))
    window, gram = windows.window, windows.gram

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, sketch, seen = Windows(window, gram), shared.value, set()
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for doc, th, text in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("text"), strict=True):
                words = text.as_py().encode().split()
                keys, anchors, first, last = make.units(word_hashes(words))
                for k in np.flatnonzero(sketch.repeated(keys)).tolist():
                    p, q = int(first[k]), int(last[k])
                    payload = b" ".join(words[p : q + window])
                    (c1,), (c2,) = (x.tolist() for x in digests([payload], (int(anchors[k]) - p).to_bytes(8, "little")))
                    digest = c1, c2
                    for column, value in zip(out, (int(keys[k].view(np.int64)), c1, c2, doc, th, p, q + window, int(anchors[k]) - p, None if digest in seen else payload)):
                        column.append(value)
                    seen.add(digest)
            types = [pa.int64()] * 8 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["key", "c1", "c2", "doc_id", "th", "start", "end", "before", "payload"])

    return docs.mapInArrow(emit, "key long, c1 long, c2 long, doc_id long, th long, start long, end long, before long, payload binary")


def compare_contents(window: int):
    """Spans of windows that members of one anchor share; rows come sorted by key, groups are small."""

    def agree(a: list[bytes], b: list[bytes]) -> int:
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    def close(group: list[tuple], out: list[tuple]) -> None:
        split = [payload.split(b" ") for *_, payload in group]
        before = [b for *_, b, _ in group]
        ahead = [w[b:] for w, b in zip(split, before, strict=True)]
        behind = [w[:b][::-1] for w, b in zip(split, before, strict=True)]
        for i, (n, doc, th, start, b, _) in enumerate(group):
            if n == 1:
                ranges = shared_offsets(window, i, [len(x) for x in ahead], before, lambda i, j: agree(ahead[i], ahead[j]), lambda i, j: agree(behind[i], behind[j]))
                out += [(doc, th, start + b - last, start + b - first + window) for first, last in ranges]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            out: list[tuple] = []
            for own, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "doc_id", "th", "start", "before", "payload")), strict=True):
                if own != key:
                    close(group, out)
                    key, group = own, []
                group.append(tuple(row))
            yield spans_batch(out)
        out = []
        close(group, out)
        yield spans_batch(out)

    return run


def spans_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "th", "start", "end"])


def repeated_spans(docs: DataFrame, window: int = 35, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, start, end) word spans that repeated windows cover, materialised; docs: keyed()."""
    found, found_at = stored(candidates(docs, Windows(window, gram)))
    contents, contents_at = stored(found.groupBy("key", "c1", "c2").agg(F.count("*").alias("n")))
    whole = found.join(contents.filter("n > 1").select("c1", "c2"), ["c1", "c2"]).select("doc_id", "th", "start", "end")
    keys = contents.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    shared = contents.join(keys, "key").select("c1", "c2", F.least("n", F.lit(2)).alias("n"), "members")
    texts = found.filter("payload is not null").drop("end").join(shared, ["c1", "c2"])
    texts = texts.groupBy("c1", "c2").agg(*(F.first(c).alias(c) for c in ("key", "members", "n", "doc_id", "th", "start", "before", "payload")))
    texts, texts_at = stored(texts)
    small = texts.filter(F.col("members") <= PAIRWISE).repartition(F.col("key")).sortWithinPartitions("key")
    near = small.mapInArrow(compare_contents(window), "doc_id long, th long, start long, end long")

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, th, start, n, payload in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "start", "n", "payload")), strict=True):
                words = payload.split(b" ")
                w1, w2 = digests(b" ".join(words[k : k + window]) for k in range(len(words) - window + 1))
                size = len(w1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * size, pa.int64()), pa.array([th] * size, pa.int64()), pa.array(np.arange(start, start + size)), pa.array([n] * size, pa.int64()), pa.array(w1), pa.array(w2)],
                    ["doc_id", "th", "start", "n", "w1", "w2"],
                )

    large = texts.filter(F.col("members") > PAIRWISE).mapInArrow(merged_batches(spread), "doc_id long, th long, start long, n long, w1 long, w2 long")
    rows, rows_at = stored(large)
    parts = repeated_windows(rows).withColumn("end", F.col("start") + window)
    spans = materialise(whole.union(near).union(parts))
    for path in (found_at, contents_at, texts_at, rows_at):
        discard(docs.sparkSession, path)
    return spans


def merged_batches(run, rows: int = 1 << 15):
    """Join the many small batches that run yields into batches of about so many rows."""

    def out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.num_rows
            if size >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return out


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space) of every row."""
    rows = keyed(docs)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, starts, ends in zip(batch.column("text"), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                words = text.as_py().encode().split()
                flags, _ = covered(len(words), starts, ends)
                total.append(len(words))
                removed.append(int(flags.sum()))
                kept.append(b" ".join(w for w, f in zip(words, flags.tolist(), strict=True) if not f).decode() if starts else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return with_spans(rows, repeated_spans(rows, window)).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
