"""Approximate nearest neighbours by inner product: inverted lists with an adaptive scan of dimensions.

Rows of equal vectors are one unit, with its k + 1 least ids, which is all that any query can see of it. Inner
products become distances: x / M (M: the greatest norm) gets one more entry that makes it a unit vector, a query is
scaled to one with a zero there, so that the squared distance is 2 - 2 q.x / (|q| M). All are turned by one random
rotation, after which any first t of D entries are a fair sample of a vector.

Lists are the cells of k-means centres, fitted on a sample of at most SAMPLE_ROWS units (SAMPLE_BYTES of them);
every unit is in a list. How many lists a query probes is measured, not set: of up to TESTED queries the true
neighbours are found in a pass over all units, and the probes are the fewest at which their lists hold `target` of
them on average. So recall is kept where vectors have no clusters, at the price of more probes.

A query meets its nearest list first, which gives a bound for the others. In a list (cut into segments by size, so
that no task holds more of it) rotated vectors lie in column blocks: a candidate's partial distance over the first t
entries, scaled by D / t, is tested against the bound, widened by (1 + EPSILON / sqrt(t))^2 for the chance that the
first entries mislead; candidates that fail are left, the others go on to the next block. Who stays to the end is
scored on the original vectors in double precision.

Vectors that are null, zero, or hold null or non-finite entries take no part. Those of other lengths than the longest
count as zero beyond their ends. Repeated rows (id and vector) are one row; rows that share an id but no vector are
candidates of each other. Null ids are no queries, and come last in ties. An empty table has no results. Extra
columns are ignored. At most MOST_LISTS lists: beyond MOST_LISTS x LIST_ROWS units, lists grow with the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import discard, stored
from hearthline.llm.whitening import finite

LIST_ROWS, MOST_LISTS, SEGMENT_ROWS = 512, 4096, 4096
SAMPLE_ROWS, SAMPLE_BYTES, PER_LIST, ROUNDS = 65_536, 1 << 26, 32, 8
TESTED = 128
COLUMNS, EPSILON = 16, 2.1
#: Queries that meet a segment at once, and rows of it between two looks at the bound.
TOGETHER, ROWS_AT_ONCE = 256, 1024
SEED = 12


def described(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, key (of the vector), v (its bytes, without trailing zeros) and norm of every row that takes part."""
    kind = vectors.schema[embedding].dataType.simpleString()
    code = "<f4" if kind == "array<float>" else "<f8"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for ident, vector in zip(batch.column("vec_id").to_pylist(), batch.column("v"), strict=True):
                x = np.trim_zeros(vector.values.to_numpy(zero_copy_only=False).astype(code) + np.float32(0), "b")  # no -0.0
                if len(x):
                    data, most = x.tobytes(), float(np.abs(x).max())
                    norm = most * float(np.sqrt(((x.astype(np.float64) / most) ** 2).sum()))
                    for column, value in zip(out, (ident, hashlib.blake2b(data, digest_size=16).digest(), data, norm), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.float64()), strict=True)], ["vec_id", "key", "v", "norm"])

    wanted = "array<float>" if code == "<f4" else "array<double>"
    slim = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(wanted).alias("v"))
    return slim.filter(finite(F.col("v"))).mapInArrow(run, "vec_id long, key binary, v binary, norm double")


def units_of(rows: DataFrame, least: int) -> DataFrame:
    """key, v, norm and ids (the `least` least ones) of every distinct vector."""
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_last("vec_id")))
    first = rows.select("key", "vec_id").distinct().withColumn("turn", turn).filter(F.col("turn") <= least)
    ids = first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))
    return rows.groupBy("key").agg(F.first("v").alias("v"), F.first("norm").alias("norm")).join(ids, "key")


def share(key: Column, fraction: float) -> Column:
    """Whether a key is among the first `fraction` of all keys, which are spread evenly."""
    return F.lit(True) if fraction >= 1 else key < F.lit(int(fraction * (1 << 64)).to_bytes(8, "big"))


class Space:
    """Vectors scaled, lengthened and rotated, as 32-bit floats."""

    def __init__(self, d: int, greatest: float, code: str):
        self.d, self.greatest, self.code = d, greatest, code
        self.turn = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d + 1, d + 1)))[0].astype(np.float32)

    def plain(self, data: list[bytes]) -> np.ndarray:
        """The original vectors in double precision."""
        size = int(self.code[-1])
        if data and all(len(x) == size * self.d for x in data):
            return np.frombuffer(b"".join(data), self.code).reshape(-1, self.d).astype(np.float64)
        out = np.zeros((len(data), self.d))
        for row, x in zip(out, data, strict=True):
            row[: len(x) // size] = np.frombuffer(x, self.code)
        return out

    def rows(self, plain: np.ndarray) -> np.ndarray:
        x = plain / self.greatest
        last = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))
        return np.hstack([x, last]).astype(np.float32) @ self.turn

    def queries(self, plain: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return np.hstack([plain / norms[:, None], np.zeros((len(plain), 1))]).astype(np.float32) @ self.turn


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T))


def centres(sample: np.ndarray, lists: int) -> np.ndarray:
    """k-means: empty cells keep their centres."""
    at = sample[np.random.default_rng(SEED).permutation(len(sample))[:lists]].copy()
    for _ in range(ROUNDS if lists > 1 else 1):
        cell = np.concatenate([distances(sample[k : k + 4096], at).argmin(axis=1) for k in range(0, len(sample), 4096)])
        n = np.bincount(cell, minlength=lists)
        order = np.argsort(cell, kind="stable")
        some = np.flatnonzero(n)
        at[some] = np.add.reduceat(sample[order], np.concatenate([[0], np.cumsum(n)[:-1]])[some], axis=0) / n[some, None]
    return at


def best_of(owner: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's k greatest scores."""
    order = np.lexsort((-score, owner))
    first = np.flatnonzero(np.diff(owner[order], prepend=-1))
    turn = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[turn < k]


class Segment:
    """A part of a list: candidates in column blocks, scanned by many queries at once."""

    def __init__(self, space: Space, data: list[bytes]):
        self.space, self.plain = space, space.plain(data)
        turned = space.rows(self.plain)
        self.edges = [*range(0, space.d + 1, COLUMNS), space.d + 1]
        self.blocks = [np.ascontiguousarray(turned[:, s:e]) for s, e in zip(self.edges, self.edges[1:])]

    def search(self, plain: np.ndarray, norms: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of up to k rows a query, of those that score its bound or more."""
        turned, dims = self.space.queries(plain, norms), self.space.d + 1
        queries = [np.ascontiguousarray(turned[:, s:e]) for s, e in zip(self.edges, self.edges[1:])]
        reach = norms * self.space.greatest
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        bounds = bounds.copy()
        for at in range(0, len(self.plain), ROWS_AT_ONCE):
            parts = [b[at : at + ROWS_AT_ONCE] for b in self.blocks]
            with np.errstate(over="ignore", invalid="ignore"):
                limit = np.where(np.isfinite(bounds), np.maximum(0, 2 - 2 * bounds / reach), np.inf)
            partial, alive, q, x = distances(queries[0], parts[0]), None, None, None
            for j, t in enumerate(self.edges[1:], 1):
                wide = limit * (1 + EPSILON / np.sqrt(t)) ** 2 * (t / dims) + 1e-5
                if alive is None:  # still dense: all pairs' next block in one product
                    stay = partial <= wide[:, None]
                    if j == len(self.blocks) or stay.mean() < 0.3:
                        alive = np.nonzero(stay)
                        q, x = alive
                        partial = partial[stay]
                    else:
                        partial = partial + distances(queries[j], parts[j])
                        continue
                else:
                    stay = partial <= wide[q]
                    q, x, partial = q[stay], x[stay], partial[stay]
                if j < len(self.blocks):
                    gap = queries[j][q] - parts[j][x]
                    partial = partial + (gap * gap).sum(axis=1)
            score = np.concatenate([(plain[q[s : s + 65536]] * self.plain[at + x[s : s + 65536]]).sum(axis=1) for s in range(0, len(q), 65536)] or [np.zeros(0)])
            good = score >= bounds[q]
            merged = [np.concatenate(c) for c in zip(found, (q[good], at + x[good], score[good]), strict=True)]
            keep = best_of(merged[0], merged[2], k)
            found = tuple(c[keep] for c in merged)
            n = np.bincount(found[0], minlength=len(plain))
            least = np.full(len(plain), np.inf)
            np.minimum.at(least, found[0], found[2])
            bounds = np.where(n >= k, np.maximum(bounds, least), bounds)
        return found


SCANNED = "query binary, score double, key binary, ids array<long>"


def scan(filed: DataFrame, probes: DataFrame, segments: DataFrame, space: Space, k: int) -> DataFrame:
    """SCANNED rows of what each probe (list, query, v, norm, bound) finds in its list. filed: list, key, v, ids."""
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    data = filed.join(F.broadcast(segments), "list").select("list", F.pmod(F.xxhash64("key"), F.col("segments")).alias("segment"), F.lit(0).alias("kind"), "key", "v", "ids", none("double", "norm"), none("double", "bound"))
    asks = probes.join(F.broadcast(segments), "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("segments") - 1)).alias("segment"), F.lit(1).alias("kind"), F.col("query").alias("key"), "v", none("array<long>", "ids"), "norm", "bound")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by list, segment and kind: the candidates of a segment first."""
        at, segment, held, asked = None, None, [], []

        def answered() -> pa.RecordBatch:
            keys, data, norms, bounds = zip(*asked, strict=True)
            q, x, score = segment.search(space.plain(list(data)), np.array(norms), np.array(bounds, float), k)
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in q], pa.binary()), pa.array(score), pa.array([held[i][0] for i in x], pa.binary()), pa.array([held[i][2] for i in x], pa.list_(pa.int64()))], ["query", "score", "key", "ids"])

        for batch in batches:
            for place, part, kind, key, v, ids, norm, bound in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (place, part) != at:
                    if asked and segment is not None:
                        yield answered()
                    at, segment, held, asked = (place, part), None, [], []
                if kind == 0:
                    held.append((key, v, ids))
                    continue
                if segment is None and held:
                    segment = Segment(space, [v for _, v, _ in held])
                asked.append((key, v, norm, bound))
                if len(asked) == TOGETHER:
                    if segment is not None:
                        yield answered()
                    asked = []
        if asked and segment is not None:
            yield answered()

    dealt = data.union(asks).repartition("list", "segment").sortWithinPartitions("list", "segment", "kind")
    return dealt.mapInArrow(run, SCANNED)


def top_units(found: DataFrame, k: int, columns: list[str]) -> DataFrame:
    """Of each query the k best units: greatest score, then the least id."""
    turn = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last(F.col("ids")[0]), "key"))
    return found.withColumn("turn", turn).filter(F.col("turn") <= k).select("query", "turn", "score", *columns)


def true_neighbours(units: DataFrame, queries: list[tuple[bytes, bytes]], space: Space, k: int, extra: list[str]) -> DataFrame:
    """SCANNED rows (and further columns of units) of the k best units of a bounded list of queries (key, vector), by
    comparison with every unit in one pass; each task sends k a query at most."""
    asked, names = space.plain([v for _, v in queries]), [key for key, _ in queries]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            plain = space.plain(batch.column("v").to_pylist())
            q, x = (c.ravel() for c in np.indices((len(asked), len(plain))))
            score = (asked @ plain.T).ravel()
            keep = best_of(q, score, k)
            rows = pa.RecordBatch.from_arrays([pa.array([names[i] for i in q[keep]], pa.binary()), *(c.take(pa.array(x[keep])) for c in (batch.column(n) for n in ("key", "ids", *extra)))], ["query", "key", "ids", *extra])
            now = (q[keep], score[keep], pa.Table.from_batches([rows]))
            if best is not None:
                now = (np.concatenate([best[0], now[0]]), np.concatenate([best[1], now[1]]), pa.concat_tables([best[2], now[2]]))
                keep = best_of(now[0], now[1], k)
                now = (now[0][keep], now[1][keep], now[2].take(pa.array(keep)))
            best = now
        if best is not None:
            yield from best[2].append_column("score", pa.array(best[1])).select(["query", "score", "key", "ids", *extra]).combine_chunks().to_batches()

    fields = ", ".join([SCANNED, *(f"{n} {units.schema[n].dataType.simpleString()}" for n in extra)])
    return top_units(units.select("key", "v", "ids", *extra).mapInArrow(run, fields), k, ["key", "ids", *extra])


def measured_probes(filed: DataFrame, asked: DataFrame, n_asked: int, at: np.ndarray, space: Space, k: int, target: float) -> int:
    """The fewest lists, nearest first, that hold `target` of the true neighbours of a bounded sample of queries."""
    tested = [(bytes(r["key"]), bytes(r["v"]), r["norm"]) for r in asked.filter(share(F.col("key"), 1.5 * TESTED / n_asked)).limit(TESTED).collect()]
    tested = tested or [(bytes(r["key"]), bytes(r["v"]), r["norm"]) for r in asked.limit(TESTED).collect()]
    true = true_neighbours(filed, [t[:2] for t in tested], space, k + 1, ["list"]).filter("query <> key").select("query", "list").collect()
    turned = space.queries(space.plain([v for _, v, _ in tested]), np.array([n for *_, n in tested]))
    rank = np.argsort(np.argsort(distances(turned, at), axis=1), axis=1)
    place = {key: i for i, (key, *_) in enumerate(tested)}
    ranks = np.array([rank[place[bytes(r["query"])], r["list"]] for r in true], int)
    if not len(ranks):
        return 1
    return int(np.sort(ranks)[max(0, int(np.ceil(target * len(ranks))) - 1)]) + 1


def search(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", target: float = 0.97, list_rows: int = LIST_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row whose id is divisible by `every`, the k nearest rows found."""
    spark, c = vectors.sparkSession, F.col
    rows = described(vectors, vec_id, embedding)
    units, units_at = stored(units_of(rows, k + 1))
    code = "<f4" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "<f8"
    facts = units.agg(F.count("*").alias("n"), F.max(F.octet_length("v")).alias("d"), F.max("norm").alias("m")).first()
    asks = rows.filter(c("vec_id") % every == 0).select("vec_id", "key").distinct()
    if not facts["n"]:
        return asks.select(c("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    space = Space(facts["d"] // int(code[-1]), facts["m"], code)
    room = min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (4 * space.d + 4)))
    lists = max(1, min(MOST_LISTS, facts["n"] // list_rows, room // PER_LIST))
    sample = units.filter(share(c("key"), PER_LIST * lists / facts["n"])).select("v").limit(room).collect() or units.select("v").limit(1).collect()
    at = centres(space.rows(space.plain([bytes(r["v"]) for r in sample])), min(lists, len(sample)))
    sent = spark.sparkContext.broadcast(at)

    def file(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = distances(space.rows(space.plain(batch.column("v").to_pylist())), sent.value).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *batch.columns], ["list", *batch.schema.names])

    filed, filed_at = stored(units.select("key", "v", "ids").mapInArrow(file, "list long, key binary, v binary, ids array<long>"))
    segments = filed.groupBy("list").agg((1 + F.floor(F.count("*") / SEGMENT_ROWS)).alias("segments"))
    asked, asked_at = stored(units.select("key", "v", "norm").join(asks.select("key").distinct(), "key"))
    n_asked = asked.count()
    probed = measured_probes(filed, asked, n_asked, at, space, k, target) if n_asked else 1

    def probing(first: int, last: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                norms = batch.column("norm").to_numpy(zero_copy_only=False)
                near = distances(space.queries(space.plain(batch.column("v").to_pylist()), norms), sent.value)
                near = np.argsort(near, axis=1, kind="stable")[:, first:last]
                owner = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), *(x.take(owner) for x in batch.columns)], ["list", *batch.schema.names])

        return run

    probe = "list long, query binary, v binary, norm double, bound double"
    open_ = asked.select(c("key").alias("query"), "v", "norm", F.lit(float("-inf")).alias("bound"))
    found, found_at = stored(scan(filed, open_.mapInArrow(probing(0, 1), probe), segments, space, k + 1))
    bound = found.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("bound"))
    places = [units_at, filed_at, asked_at, found_at]
    if probed > 1:
        # The bound of a list in several segments is the least of all that came; a lower bound loses nothing.
        more = asked.withColumnRenamed("key", "query").join(bound, "query", "left").select("query", "v", "norm", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
        rest, rest_at = stored(scan(filed, more.mapInArrow(probing(1, probed), probe), segments, space, k + 1))
        found = found.union(rest)
        places.append(rest_at)
    each = top_units(found, k + 1, ["key", "ids"]).select("query", "key", "score", F.explode("ids").alias("vec_id"))
    hit = F.struct((-c("score")).alias("minus"), c("vec_id").isNull().alias("last"), "vec_id", "key", "score")
    told = each.groupBy("query").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    others = F.filter("hits", lambda x: ~((x["key"] == c("query")) & x["vec_id"].eqNullSafe(c("own"))))
    best = asks.select(c("vec_id").alias("own"), c("key").alias("query")).join(told, "query").select("own", F.posexplode(F.slice(others, 1, k)).alias("at", "hit"))
    out, _ = stored(best.select(c("own").alias("query_id"), (c("at") + 1).alias("rank"), c("hit.vec_id").alias("vec_id"), c("hit.score").alias("score")))
    for path in places:
        discard(spark, path)
    return out
