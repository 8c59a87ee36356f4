"""Repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

A byte is covered if a string of `length` bytes around it also starts anywhere else. Suffixes are taken
at content-defined anchors whose gram may repeat (see repeats.py); a suffix is what its unit's windows
hold from the anchor on, followed by what they hold before it. Each task sorts its suffixes, merges
equal ones, and sends front-coded runs (shared prefix length and the rest) to ranges between sampled
splitters. A suffix takes at most two of its places in a run along: more would repeat whatever the range
finds, and go past it in pieces, so that a range holds no more of one suffix than there are runs. Each range merges its runs with a loser tree: players keep the prefix they share with the
last winner, and characters within a known common prefix are never compared again. The merge's own
prefix lengths tell equal suffixes (all their windows repeat) and groups that share an anchor gram,
whose members are then compared with each other; only groups too large for one range have their windows
grouped by hash over all ranges. Spans never cross documents.

Null and empty texts have no bytes. Repeated rows repeat each other's strings. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import discard, keyed, materialise, shuffle_partitions, stored, whole_rows
from hearthline.llm.repeats import PAIRWISE, Sketch, Windows, count_anchors, covered, digests, mixed, repeated_windows, shared_offsets, with_spans

#: An anchor's gram is this part of a string: 100 bytes of 400.
GRAM_PART = 4
#: Splitters come from suffixes of about so many documents, at most SAMPLE_UNITS of each; of more, if ranges
#: of RANGE_BYTES (as suffixes, before merging and front coding) have fewer than SAMPLES_PER_RANGE each.
SAMPLE_DOCS = 8_000
SAMPLE_UNITS = 16
SAMPLES_PER_RANGE = 8
RANGE_BYTES = 1 << 26
#: A task's run is sorted and sent when its suffixes reach this size.
RUN_BYTES = 1 << 25
#: Of the places that a suffix has beside two, so many go in one row.
PLACES = 1024

#: A 64-bit symbol for each byte.
SYMBOLS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

MERGED = ["doc_id", "th", "start", "end", "n", "w1", "w2"]


def byte_symbols(text: str) -> np.ndarray:
    return SYMBOLS[np.frombuffer(text.encode(), np.uint8)]


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, given that the first known bytes are equal."""
    most, step = min(len(a), len(b)), 16
    while known < most:
        if a[known : known + step] == b[known : known + step]:
            known += step
            step *= 2
        elif step == 1:
            return known
        else:
            step = max(1, step // 4)
    return min(known, most)


class LoserTree:
    """Merges sorted front-coded runs of (shared prefix with the one before, string, value).

    Every player holds a string and the length of the prefix it shares with the last winner. Of two
    players the one that shares more is the smaller, without a comparison; if both share as much, they
    are compared from there on. The next string of the winner's run shares with it what the run says.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.string: list[bytes | None] = [None] * self.size
        self.value: list[object] = [None] * self.size
        self.shared = [0] * self.size
        self.losers = [-1] * self.size
        for k in range(len(runs)):
            self._next(k)
            self.shared[k] = 0
        self.winner = self._build(1)

    def _next(self, k: int) -> None:
        got = next(self.runs[k], None)
        self.shared[k], self.string[k], self.value[k] = got if got else (-1, None, None)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser comes to share with the winner what was found."""
        sa, sb = self.string[a], self.string[b]
        if sa is None or sb is None:
            return (b, a) if sa is None else (a, b)
        la, lb = self.shared[a], self.shared[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        known = common_prefix(sa, sb, la)
        first = sa[known:] <= sb[known:]
        win, lose = (a, b) if first else (b, a)
        self.shared[lose] = known
        return win, lose

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        win, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return win

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        """(prefix shared with the string before, string, value), in order."""
        while self.string[k := self.winner] is not None:
            yield self.shared[k], self.string[k], self.value[k]
            self._next(k)
            node = (k + self.size) // 2
            while node:
                k, self.losers[node] = self._play(k, self.losers[node])
                node //= 2
            self.winner = k


def suffixes(data: bytes, windows: Windows, sketch: Sketch | None) -> Iterator[tuple[bytes, int, int, int]]:
    """(suffix and what precedes it, bytes before the anchor, span start, span end) of candidate units."""
    keys, anchors, first, last = windows.units(SYMBOLS[np.frombuffer(data, np.uint8)])
    for k in np.flatnonzero(sketch.repeated(keys)).tolist():
        a, p, e = int(anchors[k]), int(first[k]), int(last[k]) + windows.window
        yield data[a:e] + data[p:a], a - p, p, e


def splitters(docs: DataFrame, windows: Windows, shared) -> list[bytes]:
    """Strings that part the suffixes into ranges of about RANGE_BYTES, as a sample of documents has them;
    they balance tasks and don't bear on results. A cut is an anchor gram, so that ranges hold whole groups,
    but for groups that are large enough to hold several cuts: these are split by their whole suffixes."""
    window, gram = windows.window, windows.gram

    def sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Windows(window, gram)
        for batch in batches:
            found, sizes = [], []
            for text in batch.column("text"):
                own = [s for s, *_ in suffixes(text.as_py().encode(), make, shared.value)]
                picked = own[:: max(1, -(-len(own) // SAMPLE_UNITS))]
                found += picked
                sizes += [sum(map(len, own)) // len(picked)] * len(picked) if own else []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(sizes, pa.int64())], ["suffix", "size"])

    step = max(1, docs.count() // SAMPLE_DOCS)
    while True:
        some = docs.filter(F.pmod(F.xxhash64("doc_id", "th", F.lit(3)), F.lit(step)) == 0)
        got = sorted((bytes(r["suffix"]), r["size"]) for r in some.select("text").mapInArrow(sample, "suffix binary, size long").collect())
        n = max(2, shuffle_partitions(docs.sparkSession), step * sum(z for _, z in got) // RANGE_BYTES)
        if step == 1 or len(got) >= SAMPLES_PER_RANGE * n:
            break
        step = max(1, min(step // 2, step * max(1, len(got)) // (SAMPLES_PER_RANGE * n)))
    share, held, picked = sum(z for _, z in got) / n, 0, set()
    for suffix, size in got:
        if (held + size) // share > held // share:
            picked.add(suffix)
        held += size
    shared_gram = Counter(s[:gram] for s in picked)
    return sorted({s if shared_gram[s[:gram]] > 1 else s[:gram] for s in picked} | {g for g, k in shared_gram.items() if k > 1})


def sorted_runs(docs: DataFrame, windows: Windows, shared, bounds) -> DataFrame:
    """Each task's suffixes in order, front-coded within a range: part, run, seq, lcp, rest, before, places.
    Rows of negative part have further places of suffixes that occur more than twice in their run."""
    window, gram, n = windows.window, windows.gram, shuffle_partitions(docs.sparkSession)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, found, size = Windows(window, gram), {}, 0
        for batch in batches:
            for doc, th, text in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("text"), strict=True):
                for suffix, before, p, e in suffixes(text.as_py().encode(), make, shared.value):
                    places = found.setdefault((suffix, before), [])
                    size += 0 if places else len(suffix)
                    places.append((doc, th, p, e))
                if size >= RUN_BYTES:
                    yield from front_coded(found, bounds.value, n)
                    found, size = {}, 0
        yield from front_coded(found, bounds.value, n)

    many = "docs array<long>, ths array<long>, starts array<long>, ends array<long>"
    return docs.mapInArrow(emit, f"part long, run long, seq long, lcp long, rest binary, before long, {many}")


def front_coded(found: dict[tuple[bytes, int], list], cuts: list[bytes], beside: int) -> Iterator[pa.RecordBatch]:
    """One sorted run, in batches; a range's first suffix is sent whole. Places beyond two of a suffix are dealt
    over so many negative parts."""
    names = ["part", "run", "seq", "lcp", "rest", "before", "docs", "ths", "starts", "ends"]
    out, part, last, order = [[] for _ in names], -1, b"", sorted(found)
    run, held = hash_run(order), 0
    for seq, (suffix, before) in enumerate(order):
        own = bisect.bisect_right(cuts, suffix)
        lcp = common_prefix(last, suffix, 0) if own == part else 0
        part, last = own, suffix
        places = found[suffix, before]
        rows = [(part, lcp, suffix[lcp:], places[:2])]
        rows += [(-1 - (run + seq + k) % beside, 0, b"", places[k : k + PLACES]) for k in range(2, len(places), PLACES)]
        for to, shared, rest, own_places in rows:
            for column, value in zip(out, (to, run, seq, shared, rest, before, *map(list, zip(*own_places, strict=True))), strict=True):
                column.append(value)
            held += len(own_places)
            if len(out[0]) >= 4096 or held >= 64 * PLACES:
                yield runs_batch(out, names)
                out, held = [[] for _ in names], 0
    yield runs_batch(out, names)


def hash_run(order: list[tuple[bytes, int]]) -> int:
    """A name for a run that depends on its content only, so that a repeated task gives the same."""
    h = hashlib.blake2b(digest_size=7)
    for suffix, before in order:
        h.update(len(suffix).to_bytes(4, "little") + before.to_bytes(4, "little") + suffix)
    return int.from_bytes(h.digest(), "little")


def runs_batch(out: list[list], names: list[str]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), longs, longs, longs, longs]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)


def read_run(entries: list[tuple]) -> Iterator[tuple[int, bytes, tuple]]:
    last = b""
    for lcp, rest, *value in entries:
        last = last[:lcp] + rest
        yield lcp, last, tuple(value)


def turned(suffix: bytes, before: int) -> bytes:
    """What stands before the anchor, from the anchor back."""
    return suffix[: len(suffix) - before - 1 : -1] if before else b""


def group_spans(group: list[tuple], lcps: list[int], length: int) -> Iterator[tuple]:
    """(doc_id, th, start, end) of what members that occur once share with others, pair by pair."""
    ahead, before = [len(s) - b for s, b, _ in group], [b for _, b, _ in group]
    back = [turned(s, b) for s, b, _ in group]
    prefix = lambda i, j: min(lcps[min(i, j) + 1 : max(i, j) + 1])
    behind = lambda i, j: common_prefix(back[i], back[j], 0)
    for i, (_, b, places) in enumerate(group):
        if len(places) == 1:
            doc, th, p, _ = places[0]
            for near, far in shared_offsets(length, i, ahead, before, prefix, behind):
                yield doc, th, p + b - far, p + b - near + length


def large_group_spans(group: list[tuple], lcps: list[int], length: int, hashed) -> Iterator[tuple]:
    """The same by counting the hashes of the members' windows. Neighbours in either order share most, so
    that only offsets which both orders allow are hashed."""
    shares = [max(lcps[i] if i else 0, lcps[i + 1] if i + 1 < len(group) else 0) for i in range(len(group))]
    order = sorted((turned(s, b), i) for i, (s, b, _) in enumerate(group))
    near = [0, *(common_prefix(x[0], y[0], 0) for x, y in zip(order, order[1:])), 0]
    back = {i: max(near[k], near[k + 1]) for k, (_, i) in enumerate(order)}
    found = []
    for i, (suffix, b, places) in enumerate(group):
        first, last = length - min(shares[i], len(suffix) - b, length), min(b, back[i])
        if first <= last:
            found.append((i, *hashed(suffix, b, places[0][2], first, last)))
    if not found:
        return
    pairs = np.concatenate([np.stack([w1, w2], axis=1) for _, _, w1, w2 in found])
    weight = np.concatenate([np.full(len(start), min(2, len(group[i][2]))) for i, start, _, _ in found])
    _, kind = np.unique(pairs, axis=0, return_inverse=True)
    repeated = (np.bincount(kind.ravel(), weights=weight) >= 2)[kind.ravel()]
    at = 0
    for i, start, _, _ in found:
        mine = start[repeated[at : at + len(start)]]
        at += len(start)
        if len(mine) and len(group[i][2]) == 1:
            doc, th, *_ = group[i][2][0]
            breaks = np.flatnonzero(np.diff(mine) > 1)
            for s, e in zip(mine[np.append(0, breaks + 1)].tolist(), mine[np.append(breaks, len(mine) - 1)].tolist()):
                yield doc, th, s, e + length


def merge_range(part: pa.Table, windows: Windows, cuts: list[bytes]) -> pa.Table:
    """Spans of repeated windows (n null), and, of groups that a cut splits, the hashed windows (n: 1, or 2
    for a suffix known to repeat), which are grouped over all ranges."""
    number = part.column("part")[0].as_py()
    if number < 0:
        places = [pc.list_flatten(part.column(c)) for c in ("docs", "ths", "starts", "ends")]
        return pa.Table.from_arrays([*places, *[pa.nulls(len(places[0]), pa.int64())] * 3], names=MERGED)
    split_low = number > 0 and len(cuts[number - 1]) > windows.gram
    split_high = number < len(cuts) and len(cuts[number]) > windows.gram
    part = part.sort_by([("run", "ascending"), ("seq", "ascending")])
    coded: dict[tuple[int, int], list[tuple]] = {}
    copies: dict[tuple[int, int], int] = {}
    for run, seq, *entry in zip(*(part.column(c).to_pylist() for c in ("run", "seq", "lcp", "rest", "before", "docs", "ths", "starts", "ends")), strict=True):
        # Two tasks may send runs of the same name (and so the same suffixes): each copy is a run.
        copy = copies[run, seq] = copies.get((run, seq), -1) + 1
        coded.setdefault((run, copy), []).append(tuple(entry))
    tree = LoserTree([read_run(entries) for entries in coded.values()])
    spans: list[tuple] = []
    rows: list[pa.Table] = []
    group: list[tuple] = []
    lcps: list[int] = []
    first = True

    def hashed(suffix: bytes, before: int, p: int, first: int, last: int) -> tuple[np.ndarray, ...]:
        """Starts and digests of a suffix's windows at offsets last down to first."""
        ahead = len(suffix) - before
        data = suffix[ahead + before - last :] + suffix[: windows.window - first]
        w1, w2 = digests(data[k : k + windows.window] for k in range(len(data) - windows.window + 1))
        return p + before - last + np.arange(len(w1)), w1, w2

    def close(split: bool) -> None:
        """group: the different suffixes with one anchor gram, in order, and lcps: what each shares with
        the one before. split: the group goes on in another range."""
        spans.extend(place for _, _, places in group if len(places) > 1 for place in places)
        length = windows.window
        if split:
            for suffix, b, places in group:
                doc, th, p, _ = places[0]
                start, w1, w2 = hashed(suffix, b, p, length - len(suffix) + b, b)
                same = [pa.array([x] * len(w1), pa.int64()) for x in (doc, th, min(2, len(places)))]
                rows.append(pa.Table.from_arrays([*same[:2], pa.array(start), pa.array(start + length), same[2], pa.array(w1), pa.array(w2)], names=MERGED))
        elif len(group) > 1:
            spans.extend(group_spans(group, lcps, length) if len(group) <= PAIRWISE else large_group_spans(group, lcps, length, hashed))

    for lcp, suffix, (before, *places) in tree:
        if lcp < windows.gram and group:
            close(split_low and first)
            group, lcps, first = [], [], False
        mine = list(zip(*places, strict=True))
        for k in range(len(group) - 1, -1, -1):
            if group[k][0] != suffix:
                k = -1
                break
            if group[k][1] == before:
                group[k][2].extend(mine)
                break
        else:
            k = -1
        if k < 0:
            group.append((suffix, before, mine))
            lcps.append(lcp)
    if group:
        close(split_high or split_low and first)
    known = [pa.array(c, pa.int64()) for c in (zip(*spans, strict=True) if spans else [[]] * 4)]
    out = [pa.Table.from_arrays([*known, *[pa.nulls(len(spans), pa.int64())] * 3], names=MERGED)]
    return pa.concat_tables([*out, *rows])


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, th, start, end) byte spans that repeated strings cover, materialised; docs: keyed()."""
    gram = max(1, length // GRAM_PART)
    windows = Windows(length, gram)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(count_anchors(docs, windows, byte_symbols))
    cuts = splitters(docs, windows, shared)
    bounds = spark.sparkContext.broadcast(cuts)
    runs = sorted_runs(docs, windows, shared, bounds).repartition(max(shuffle_partitions(spark), len(cuts) + 1), "part")

    def merge(part: pa.Table) -> pa.Table:
        return merge_range(part, Windows(length, gram), bounds.value)

    merged, merged_at = stored(runs.groupBy("part").applyInArrow(merge, ", ".join(f"{c} long" for c in MERGED)))
    whole = merged.filter("n is null").select("doc_id", "th", "start", "end")
    parts = repeated_windows(merged.filter("n is not null").select("doc_id", "th", "start", "n", "w1", "w2"))
    spans = materialise(whole.union(parts.withColumn("end", F.col("start") + length)))
    discard(spark, merged_at)
    return spans


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) of every row."""
    rows = keyed(docs)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, spans, kept = [], [], [], []
            for text, starts, ends in zip(batch.column("text"), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                data = text.as_py().encode()
                flags, n = covered(len(data), starts, ends)
                total.append(len(data))
                removed.append(int(flags.sum()))
                spans.append(n)
                kept.append(np.frombuffer(data, np.uint8)[~flags].tobytes() if n else data)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "th", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return with_spans(rows, repeated_spans(rows, length)).mapInArrow(cut, "doc_id long, th long, n_bytes long, n_removed long, n_spans long, kept binary")


def strip_documents(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs without the bytes that repeated strings cover, in the same columns: text (a character that
    is cut through goes) and, if it is there, n_chars are changed. Texts that nothing is left of go."""
    spans, names = repeated_spans(keyed(docs), length), docs.columns

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.column("row").flatten(), strict=True))
            texts, keep = [], []
            for text, starts, ends in zip(columns["text"], batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                value = text.as_py()
                if starts:
                    data = value.encode()
                    flags, _ = covered(len(data), starts, ends)
                    value = np.frombuffer(data, np.uint8)[~flags].tobytes().decode(errors="ignore")
                texts.append(value)
                keep.append(not starts or bool(value.strip()))
            changed = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([t if t is None else len(t) for t in texts], pa.int64())}
            own = [changed[n].cast(columns[n].type) if n in changed else columns[n] for n in names]
            yield pa.RecordBatch.from_arrays(own, names).filter(pa.array(keep, pa.bool_()))

    return with_spans(whole_rows(docs), spans).select("row", "starts", "ends").mapInArrow(cut, docs.schema)


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
