"""Conversation prefix trie by preorder intervals: who shares which first turns, and what sharing saves.

A node of depth d is a distinct sequence of first d turns (role and text); the root is the empty one. Nodes are
known by a 122-bit polynomial hash of their turns, whose running sums over a conversation are taken along a
distributed sort (a conversation of any length is cut over tasks, each conversation's carry is one row a partition).

The smallest member of a node stands for it, so that (conv_id, depth) names the node, and each conversation is a
chain: the nodes that it stands for, below the node where it leaves an earlier one's chain. Chains are ranked
lexicographically by their hops, (depth of leaving, deepest first; conv_id), collected by pointer doubling. On this
order, a preorder of the trie, the members of a node are consecutive: its subtree ends where the chain of its last
member ends. Leaves and savings of a subtree are differences of prefix sums at both ends. A chain's hops have
strictly growing depths, and as many other conversations are at least that long, so that a key has at most
sqrt(2 x turns) hops.

Conversations are ordered by turn, null first; turns that tie go by role, then by a digest of the text. Repeated
rows are repeated turns. Null roles and texts are empty; rows without conv_id belong to no conversation and are
left out. An empty table has no node, not even a root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import discard, shuffle_partitions, stored
from hearthline.llm.running import running_sums

P = (1 << 61) - 1
#: Bases of the two polynomial hashes, fixed values.
B1, B2 = 0x1A2B3C4D5E6F7081, 0x0F1E2D3C4B5A6978
FAMILY, SHARES = 20, 4
#: Ids of one string that is hashed as a piece.
PIECE = 4096

HASHED = "conv long, depth long, h1 long, h2 long, p1 long, p2 long, words long"


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def values(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def coded_turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, c1, c2 (codes of role and text) and words of every turn."""
    schema = "conv long, turn long, role string, c1 long, c2 long, words long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, role, text in values(batch):
                a, b = role.encode(), text.encode()
                code = hashlib.blake2b(len(a).to_bytes(8, "little") + a + b, digest_size=16).digest()
                rows.append((conv, turn, role, int.from_bytes(code[:8], "little") % P, int.from_bytes(code[8:], "little") % P, len(b.split())))
            yield batch_of(schema, rows)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    slim = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    return slim.filter("conv is not null").mapInArrow(run, schema)


def numbered(turns: DataFrame) -> tuple[DataFrame, str]:
    """conv, pos (from 1), c1, c2, s1, s2 (hashes of the first pos turns) and words of every turn, and where the
    rows are stored."""
    schema = "conv long, pos long, c1 long, c2 long, s1 long, s2 long, words long, pid int"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, at, pos, s1, s2, w1, w2 = TaskContext.get().partitionId(), None, 0, 0, 0, 1, 1
        for batch in batches:
            rows = []
            for conv, c1, c2, words in values(batch):
                if conv != at:
                    at, pos, s1, s2, w1, w2 = conv, 0, 0, 0, 1, 1
                pos, w1, w2 = pos + 1, w1 * B1 % P, w2 * B2 % P
                s1, s2 = (s1 + c1 * w1) % P, (s2 + c2 * w2) % P
                rows.append((conv, pos, c1, c2, s1, s2, words, pid))
            yield batch_of(schema, rows)

    order = ["conv", "turn", "role", "c1", "c2", "_row"]
    dealt = turns.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    local, at = stored(dealt.select("conv", "c1", "c2", "words").mapInArrow(run, schema))
    ends = local.groupBy("pid").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "pos", "s1", "s2")).alias("last")).orderBy("pid").collect()
    carry, held = {}, (None, 0, 0, 0)
    for r in ends:  # what the first conversation of a partition brings from those before it
        last = tuple(r["last"])
        if r["first"] == held[0]:
            carry[r["pid"]] = held
            if last[0] == held[0]:
                last = (held[0], held[1] + last[1], *((s + pow(b, held[1], P) * x) % P for s, b, x in zip(held[2:], (B1, B2), last[2:], strict=True)))
        held = last

    def carried(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, pos, c1, c2, s1, s2, words, pid in values(batch):
                to, n, a1, a2 = carry.get(pid, (None, 0, 0, 0))
                if conv == to:
                    pos, s1, s2 = pos + n, (a1 + pow(B1, n, P) * s1) % P, (a2 + pow(B2, n, P) * s2) % P
                rows.append((conv, pos, c1, c2, s1, s2, words))
            yield batch_of(schema.removesuffix(", pid int"), rows)

    return (local.mapInArrow(carried, schema.removesuffix(", pid int")) if carry else local.drop("pid")), at


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Turns of the rebuilt conversations (HASHED: a node's hash, its parent's, the words of its last turn), one row
    per conversation (conv, full: its turns, e1 and e2: the hash of all), and where both are stored.

    Conversation c takes the first h turns of conversation c - c % 20, h = crc32(c) % 4, then its own after its
    first h. Of that source only three turns are ever needed, so that no family meets in one task."""
    spark = conversations.sparkSession
    turns, turns_at = stored(coded_turns(conversations))
    own, own_at = numbered(turns)
    first = lambda i: F.max(F.when(F.col("pos") == i, F.struct("c1", "c2", "words"))).alias(f"t{i}")
    convs, convs_at = stored(own.groupBy("conv").agg(F.max(F.struct("pos", "s1", "s2")).alias("last"), first(1), first(2), first(3)))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARES
    source = convs.select(F.col("conv").alias("source"), *(F.col(f"t{i}").alias(f"u{i}") for i in (1, 2, 3)))
    both = convs.withColumns({"source": F.col("conv") - F.col("conv") % FAMILY, "h": h}).join(source, "source", "left")
    pair = both.select("conv", "h", "last", *(f"t{i}" for i in (1, 2, 3)), *(f"u{i}" for i in (1, 2, 3)))

    def prefix(codes: list[dict | None], n: int) -> tuple[int, int]:
        return tuple(sum(codes[i][c] * pow(b, i + 1, P) for i in range(n)) % P for c, b in (("c1", B1), ("c2", B2)))

    facts_schema = "conv long, h long, k long, full long, a1 long, a2 long, e1 long, e2 long"

    def facts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A turn's hash in the rebuilt conversation is a + B^(k - h) times its hash in its own."""
        for batch in batches:
            rows = []
            for conv, h, last, *turns in values(batch):
                mine, src = turns[:3], turns[3:]
                k, skipped = sum(u is not None for u in src[:h]), min(h, last["pos"])
                taken, left = prefix(src, k), prefix(mine, skipped)
                shift = [pow(b, k - h, P) for b in (B1, B2)]
                a = [(t - s * x) % P for t, s, x in zip(taken, shift, left, strict=True)]
                end = [(x + s * last[c]) % P for x, s, c in zip(a, shift, ("s1", "s2"), strict=True)] if last["pos"] > h else taken
                rows.append((conv, h, k, k + max(0, last["pos"] - h), *a, *end))
            yield batch_of(facts_schema, rows)

    def taken(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, h, _, *turns in values(batch):
                src, before = turns[3:], (0, 0)
                for d in range(1, 1 + sum(u is not None for u in src[:h])):
                    now = prefix(src, d)
                    rows.append((conv, d, *now, *before, src[d - 1]["words"]))
                    before = now
            yield batch_of(HASHED, rows)

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, pos, c1, c2, s1, s2, words, h, k, a1, a2 in values(batch):
                d = pos + k - h
                h1, h2 = (a1 + pow(B1, k - h, P) * s1) % P, (a2 + pow(B2, k - h, P) * s2) % P
                rows.append((conv, d, h1, h2, (h1 - c1 * pow(B1, d, P)) % P, (h2 - c2 * pow(B2, d, P)) % P, words))
            yield batch_of(HASHED, rows)

    info, info_at = stored(pair.mapInArrow(facts, facts_schema))
    rest = own.join(info.select("conv", "h", "k", "a1", "a2"), "conv").filter("pos > h")
    rows, rows_at = stored(pair.mapInArrow(taken, HASHED).union(rest.select("conv", "pos", "c1", "c2", "s1", "s2", "words", "h", "k", "a1", "a2").mapInArrow(kept, HASHED)))
    for path in (turns_at, own_at, convs_at):
        discard(spark, path)
    return rows, info.select("conv", "full", "e1", "e2"), [rows_at, info_at]


def _eight(number: Column) -> Column:
    """A long as eight bytes, high ones first."""
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def chains(nodes: DataFrame, convs: DataFrame, root: int) -> tuple[DataFrame, list[str]]:
    """conv, rank (in preorder, from 1), t (the depth that its chain hangs below; -1: the root is its own), parent (the
    conversation that the chain hangs at), full, size (nodes of the chain), upto (nodes up to its end), and where."""
    spark = nodes.sparkSession
    heads = nodes.groupBy("conv").agg(F.min(F.struct("depth", "p1", "p2")).alias("head"))
    hung = convs.join(heads, "conv", "left").select(
        "conv", "full", F.coalesce(F.col("head.depth") - 1, "full").alias("t"), F.coalesce("head.p1", "e1").alias("h1"), F.coalesce("head.p2", "e2").alias("h2"),
    )
    below = hung.filter((F.col("t") > 0) & (F.col("conv") != root)).join(nodes.select(F.col("depth").alias("t"), "h1", "h2", F.col("conv").alias("parent")), ["t", "h1", "h2"])
    top = hung.filter((F.col("t") == 0) & (F.col("conv") != root)).withColumn("parent", F.lit(root))
    trunk = hung.filter(F.col("conv") == root).withColumns({"parent": F.lit(None).cast("long"), "t": F.lit(-1).cast("long")})
    columns = ["conv", "full", "t", "parent"]
    every, every_at = stored(below.select(columns).union(top.select(columns)).union(trunk.select(columns)))

    hop = F.concat(_eight(F.lit((1 << 62)) - F.col("t")), _eight(F.col("conv").bitwiseXOR(F.lit(-(1 << 63)))))
    path = F.when(F.col("conv") == root, F.lit(b"")).otherwise(hop)
    paths, paths_at = stored(every.select("conv", F.when(F.col("parent") != root, F.col("parent")).alias("next"), path.alias("path")))
    while not paths.filter("next is not null").isEmpty():
        ahead = paths.select(F.col("conv").alias("next"), F.col("next").alias("after"), F.col("path").alias("before"))
        open_ = paths.filter("next is not null").join(ahead, "next").select("conv", F.col("after").alias("next"), F.concat("before", "path").alias("path"))
        doubled, at = stored(paths.filter("next is null").union(open_))
        discard(spark, paths_at)
        paths, paths_at = doubled, at
    sized = every.join(paths.select("conv", "path"), "conv").withColumns({"size": F.col("full") - F.col("t"), "one": F.lit(1).cast("long")})
    ranked, ranked_at = running_sums(sized, ["path"], {"rank": "one", "upto": "size"})
    discard(spark, every_at)
    discard(spark, paths_at)
    return ranked.drop("path", "one"), [ranked_at]


def ends_digests(members: DataFrame) -> DataFrame:
    """conv, depth and ends_sha256 of nodes where conversations end; members: (conv, depth, member).

    Sorted ids are joined into pieces where they lie; a node's hash then runs over its pieces."""
    spark = members.sparkSession

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            rows = []
            for conv, depth, member in values(batch):
                if (conv, depth) != key or len(held) == PIECE:
                    if held:
                        rows.append((*key, held[0], ",".join(map(str, held))))
                    key, held = (conv, depth), []
                held.append(member)
            yield batch_of("conv long, depth long, first long, ids string", rows)
        if held:
            yield batch_of("conv long, depth long, first long, ids string", [(*key, held[0], ",".join(map(str, held)))])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows = []
            for conv, depth, ids in values(batch):
                if (conv, depth) != key:
                    if key is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield batch_of("conv long, depth long, ends_sha256 string", rows)
        if key is not None:
            yield batch_of("conv long, depth long, ends_sha256 string", [(*key, state.hexdigest())])

    order = ["conv", "depth", "member"]
    joined = members.select(order).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(pieces, "conv long, depth long, first long, ids string")
    dealt = joined.repartition(shuffle_partitions(spark), "conv", "depth").sortWithinPartitions("conv", "depth", "first")
    return dealt.select("conv", "depth", "ids").mapInArrow(hashed, "conv long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, preorder (from 1) and subtree_end (the last place of its subtree)."""
    spark, c = conversations.sparkSession, F.col
    rows, convs, paths = rebuilt(conversations)
    merged = rows.groupBy("depth", "h1", "h2").agg(F.count("*").alias("n"), F.min("conv").alias("conv"), *(F.max(x).alias(x) for x in ("p1", "p2", "words")))
    nodes, nodes_at = stored(merged)
    total = convs.agg(F.count("*").alias("n"), F.min("conv").alias("root")).first()
    ranked, ranked_at = chains(nodes, convs, total["root"] or 0)

    top = convs.filter(c("conv") == total["root"]).select("conv", F.lit(0).cast("long").alias("depth"), F.lit(total["n"]).cast("long").alias("n"), F.lit(0).cast("long").alias("words"))
    placed = nodes.select("conv", "depth", "n", "words").union(top).join(ranked.select("conv", "full", "t", "parent", "rank", "upto"), "conv")
    hops = ranked.filter((c("size") > 0) & c("parent").isNotNull()).groupBy(c("parent").alias("conv"), c("t").alias("depth")).agg(F.count("*").alias("hops"))
    known = placed.join(hops, ["conv", "depth"], "left").select(
        "conv", "depth", "n", "rank", (c("depth") == c("full")).alias("last"), (c("upto") - c("full") + c("depth")).alias("pos"),
        F.when(c("depth") > c("t") + 1, c("conv")).otherwise(c("parent")).alias("parent_conv_id"),
        (F.coalesce("hops", F.lit(0)) + (c("depth") < c("full")).cast("long")).alias("n_children"), ((c("n") - 1) * c("words")).alias("saves"),
    ).withColumn("leaf", (c("n_children") == 0).cast("long"))
    along, along_at = running_sums(known, ["pos"], {"leaves": "leaf", "saved": "saves"})

    # A chain without nodes of its own ends where the one before it does.
    marks = along.filter("last").select(c("pos").alias("upto"), c("leaves").alias("leaves_end"), c("saved").alias("saved_end"))
    until = ranked.select("rank", "upto").join(marks, "upto").select(c("rank").alias("until"), c("upto").alias("subtree_end"), "leaves_end", "saved_end")
    told = along.withColumn("until", c("rank") + c("n") - 1).join(until, "until")
    members = ranked.select(F.when(c("size") > 0, c("conv")).otherwise(c("parent")).alias("conv"), F.when(c("size") > 0, c("full")).otherwise(c("t")).alias("depth"), c("conv").alias("member"))
    out = told.join(ends_digests(members), ["conv", "depth"], "left").select(
        c("conv").alias("conv_id"), "depth", "parent_conv_id", c("n").alias("n_convs"), "n_children", (c("leaves_end") - c("leaves") + c("leaf")).alias("n_leaves"),
        (c("saved_end") - c("saved") + c("saves")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"), c("pos").alias("preorder"), "subtree_end",
    )
    out, _ = stored(out)
    for path in (*paths, nodes_at, *ranked_at, along_at):
        discard(spark, path)
    return out


def digest(trie: DataFrame) -> DataFrame:
    return trie.drop("preorder", "subtree_end")
