"""Near-duplicate texts by likeness: word shingles of five words, Jaccard likeness of 0.8 or more.

At that likeness SimHash fingerprints of 64 bits differ in about ten bits (4 to 14 in practice), further than
anchors can cover at a bounded replication: points within 7 bits have some ten million anchors around. So pairs
to compare come from two sides: fingerprints that meet at an anchor (see simhash.py), and texts that share a band of
their min-hashes. BANDS bands of ROWS min-hashes each let a pair of likeness s meet with probability
1 - (1 - s^ROWS)^BANDS: 0.998 at 0.8, 0.9998 at 0.85 (recall()). Texts of stock paragraphs, forms or boilerplate meet in
few bands, since all of a band must agree.

Texts that share a band, or a fingerprint, are a bucket. All links within buckets count, whatever a bucket's size, and no
pair is sent anywhere but those of forests, in two passes. The first is quick and decides nothing by itself: min-hash
signatures are compared where they lie, in pieces of at most CROWD texts (buckets of more are parted by further
min-hashes), and the edges of a spanning forest of highest estimates are verified by exact Jaccard likeness of all
shingles, the texts of a pair's busier end gathered there. Verified pairs make classes. The second is exact: buckets that
hold more than one class are cut into blocks, each block sees all texts of the bucket's smaller classes, and a block
counts the shingles that each of these shares with every text of the block (one inverted index a block, no estimates,
no limit of partners). What it returns is a spanning forest of linked classes. Two texts of a bucket that are of
different classes have one in a smaller class, so that each such pair is compared in some block. Groups are the connected
components of both passes' links.

Words are lower-cased (A-Z) and parted at white space; a text of fewer words is one shingle, texts without words
(null, empty) are alike. Equal texts are one node, however many rows share one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import discard, keyed, stored, whole_rows
from hearthline.llm.components import connected_components
from hearthline.llm.decontaminate import rolling, word_codes
from hearthline.llm.repeats import mixed
from hearthline.llm.simhash import BITS, BLOCK, links

BANDS, ROWS = 16, 5
SALTS = np.random.default_rng(8).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
#: Texts whose share of equal min-hashes is this far below the sought likeness are left to the exact pass.
MARGIN = 0.15
#: So many texts of a bucket are compared at a time, in the exact pass also of so many shingles in all.
CROWD = 2048
HELD = 1 << 20
#: So many members of a busy text are verified in one group of rows, and so many texts' shingles go on at a time.
GATHERED = 256
#: So many rows of a piece's table of pairs are filled, and so many shingles met, at a time: a pair takes a few bytes.
ACROSS = 16
PLACES = 1 << 17
PAIRED = "u binary, v binary"


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    words = text.encode().lower().split()
    return rolling(word_codes(words), min(shingle, len(words))) if words else np.zeros(1, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of the salted orders."""
    least = np.full(len(SALTS), ~np.uint64(0))
    for k in range(0, len(hashes), 1 << 10):
        np.minimum(least, mixed(hashes[None, k : k + (1 << 10)] ^ SALTS[:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A hash of each band and its number."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def recall(likeness: float) -> float:
    """The probability that a pair of that likeness shares a band."""
    return 1 - (1 - likeness**ROWS) ** BANDS


def node_of(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def described(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th, node, fp, size (distinct shingles), bands and sig (a byte of each min-hash) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for value in batch.column("text"):
                text = value.as_py()
                hashes = shingle_hashes(text, shingle)
                distinct = np.unique(hashes)
                least = minima(distinct)
                for column, x in zip(out, (node_of(text), fingerprint(hashes), len(distinct), band_keys(least), least.astype(np.uint8).tobytes()), strict=True):
                    column.append(x)
            types = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["doc_id", "th", "node", "fp", "size", "bands", "sig"])

    return keyed(docs).mapInArrow(run, "doc_id long, th long, node binary, fp long, size long, bands array<long>, sig binary")


def likely_edges(sigs: np.ndarray, sizes: np.ndarray, least: float) -> set[tuple[int, int]]:
    """Edges (i < j) of a spanning forest of highest estimates among a bucket's texts."""
    n, enough = len(sigs), (least - MARGIN) * sigs.shape[1]
    equal = np.zeros((n, n), np.uint8)
    for k in range(0, n, ACROSS):
        rows, own = equal[k : k + ACROSS], sizes[k : k + ACROSS, None]
        rows[:] = (sigs[k : k + ACROSS, None, :] == sigs[None, :, :]).sum(axis=2, dtype=np.uint8)
        rows[(rows < enough) | (np.minimum(own, sizes) < least * np.maximum(own, sizes))] = 0
    np.fill_diagonal(equal, 0)
    edges: set[tuple[int, int]] = set()
    part = np.arange(n)
    while True:  # each part's best edge to another, until there are none
        outside = np.where(part[:, None] != part[None, :], equal, 0)
        to = outside.argmax(axis=1)
        value = outside[np.arange(n), to]
        if not value.any():
            return edges
        order = np.lexsort((-value.astype(np.int16), part))
        first = order[np.flatnonzero(np.diff(part[order], prepend=-1))]
        for i in first[value[first] > 0].tolist():
            j = int(to[i])
            if part[i] != part[j]:
                edges.add((min(i, j), max(i, j)))
                part[part == max(part[i], part[j])] = min(part[i], part[j])


def met_in_buckets(least: float):
    """Rows (key, sub, node, size, sig) come sorted by key and sub. Pieces after the first also try the first text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, held = None, None, []

        def pairs() -> list[tuple[bytes, bytes]]:
            nodes, sizes, sigs = zip(*held, strict=True)
            table = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(held), -1)
            out = [(nodes[i], nodes[j]) for i, j in likely_edges(table, np.array(sizes), least)] if len(held) > 1 else []
            if nodes[0] == first[0]:
                return out
            near = (table == np.frombuffer(first[2], np.uint8)).mean(axis=1) >= least - MARGIN
            return out + [(first[0], nodes[i]) for i in np.flatnonzero(near).tolist()]

        def told(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*found, strict=True) if found else ([], []))], ["u", "v"])

        for batch in batches:
            out = []
            for key, sub, *member in zip(*(batch.column(c).to_pylist() for c in ("key", "sub", "node", "size", "sig")), strict=True):
                if (key, sub) != at or len(held) == CROWD:
                    out += pairs() if held else []
                    if (key, sub) != at:
                        at, first = (key, sub), member
                    held = []
                held.append(member)
            yield told(out)
        if held:
            yield told(pairs())

    return run


def members(nodes: DataFrame) -> DataFrame:
    """key, band, node, size, sig, n and head (the bucket's texts and the least of them) of texts that share a bucket."""
    keys = F.concat("bands", F.array(F.xxhash64("fp", F.lit(BANDS))))
    each = nodes.select("node", F.posexplode(keys).alias("band", "key"))
    shared = each.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).filter("n > 1")
    return each.join(shared, "key").join(nodes.select("node", "size", "sig"), "node").select("key", "band", "node", "size", "sig", "n", "head")


def candidate_pairs(nodes: DataFrame, met: DataFrame, least: float) -> DataFrame:
    """Distinct (u, v) of nodes to verify first; nodes: node, fp; met: members()."""
    of_print = nodes.groupBy("fp").agg(F.min("node").alias("v"))
    ends = links(of_print.select("fp"))
    at = lambda end, node: of_print.select(F.col("fp").alias(end), F.col("v").alias(node))
    near = ends.join(at("u", "a"), "u").join(at("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))

    # A crowded bucket is parted by the min-hashes after its band, one more for every 64-fold; its first text meets all.
    further = F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / CROWD) / F.log(F.lit(64.0)))).cast("int")
    turned = F.concat(F.substring(F.col("sig"), 1, 1 << 30), F.col("sig"))
    sub = F.hex(turned.substr(F.col("band") * ROWS + ROWS + 1, further))
    dealt = met.withColumn("sub", F.when(F.col("n") > CROWD, sub).otherwise("")).select("key", "sub", "node", "size", "sig")
    bucketed = dealt.repartition("key", "sub").sortWithinPartitions("key", "sub", "size", "node").mapInArrow(met_in_buckets(least), PAIRED)
    heads = met.filter(F.col("n") > CROWD).select(F.col("node").alias("u"), F.col("head").alias("v"))
    every = near.union(bucketed).union(heads).filter("u <> v")
    return every.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def shingle_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node and shingles of the nodes of wanted (and of texts of equal th). Only their texts are read again."""

    def sets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, GATHERED):
                texts = batch.column("text").slice(k, GATHERED).to_pylist()
                sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(t) for t in texts], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    hashes = rows.select("node", "th").distinct().join(wanted.select("node"), "node", "left_semi").select("th").distinct()
    texts = keyed(docs).select("th", "text").join(hashes, "th", "left_semi").groupBy("th", F.xxhash64(F.lit(1), "text").alias("also")).agg(F.first("text").alias("text"))
    return texts.select("text").mapInArrow(sets_of, "node binary, shingles array<long>")


def verified(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs whose texts' shingle sets are that alike; sets: shingle_sets(). Each pair sends the shingles of its less busy end to the
    other, which sends its own once for so many of them."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by head, salt and kind: the head's own shingles first."""
        mine = np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for kind, head, node, shingles in zip(batch.column("kind").to_pylist(), batch.column("head").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles"), strict=True):
                theirs = np.sort(shingles.values.to_numpy(zero_copy_only=False))
                if kind == 0:
                    mine = theirs
                    continue
                at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                common = int((mine[at] == theirs).sum())
                if common >= least * (len(mine) + len(theirs) - common):
                    out.append((node, head))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*out, strict=True) if out else ([], []))], ["u", "v"])

    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("met"))
    busy = pairs.join(ends.select(F.col("node").alias("u"), F.col("met").alias("mu")), "u").join(ends.select(F.col("node").alias("v"), F.col("met").alias("mv")), "v")
    first = F.struct("mu", "u") > F.struct("mv", "v")
    asked = busy.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("head"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("node"), F.greatest("mu", "mv").alias("met"))
    salts = 1 + F.floor(F.col("met") / GATHERED)
    asked = asked.select("head", "node", F.pmod(F.xxhash64("node"), salts).alias("salt"), F.lit(1).alias("kind"))
    own = asked.select("head", F.col("head").alias("node"), "salt", F.lit(0).alias("kind")).distinct()
    sent = asked.union(own).join(sets, "node")
    return sent.repartition("head", "salt").sortWithinPartitions("head", "salt", "kind").select("kind", "head", "node", "shingles").mapInArrow(compare, PAIRED)


def in_blocks(met: DataFrame, root: DataFrame) -> DataFrame:
    """key, block, kind, node and root of texts in buckets of more than one class: each in its own block (kind 0), and
    those that are not of the bucket's largest class in every block (kind 1)."""
    each = met.join(root.withColumnRenamed("u", "node"), "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    by_class = each.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    total = by_class.groupBy("key").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "root"))["root"].alias("main"))
    split = total.filter("classes > 1").select("key", "main", F.greatest(F.ceil(F.col("n") / CROWD), F.ceil(F.col("shingles") / HELD)).alias("blocks"))
    several = each.join(split, "key")
    own = several.select("key", F.pmod(F.xxhash64("node"), "blocks").alias("block"), F.lit(0).alias("kind"), "node", "root")
    lesser = several.filter("root <> main").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "node", "root")
    return own.union(lesser)


class Block:
    """Which classes of a block's texts a text is linked to."""

    def __init__(self, held: list[tuple[bytes, np.ndarray]], least: float):
        self.least, self.root = least, {r: r for r, _ in held}
        self.roots = list(self.root)
        number = {r: k for k, r in enumerate(self.roots)}
        self.of = np.array([number[r] for r, _ in held], np.int64)
        self.sizes = np.array([len(s) for _, s in held])
        shingles, owner = np.concatenate([s for _, s in held]), np.repeat(np.arange(len(held), dtype=np.int32), self.sizes)
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.owner = shingles[order], owner[order]

    def find(self, r: bytes) -> bytes:
        while (up := self.root.setdefault(r, r)) != r:
            self.root[r] = r = self.root[up]
        return r

    def links(self, root: bytes, theirs: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """(root, root of a linked text), for classes that were not linked before."""
        start = np.searchsorted(self.shingles, theirs)
        n = np.searchsorted(self.shingles, theirs, side="right") - start
        common, parts = np.zeros(len(self.sizes), np.int64), 1 + int(n.sum()) // PLACES
        for s, m in zip(np.array_split(start, parts), np.array_split(n, parts), strict=True):
            places = np.repeat(s - np.cumsum(m) + m, m) + np.arange(m.sum())
            common += np.bincount(self.owner[places], minlength=len(self.sizes))
        for k in np.unique(self.of[common >= self.least * (self.sizes + len(theirs) - common)]).tolist():
            a, b = self.find(root), self.find(self.roots[k])
            if a != b:
                self.root[a] = b
                yield root, self.roots[k]


def linked_classes(sets: DataFrame, blocks: DataFrame, least: float) -> DataFrame:
    """(u, v) roots of classes that some pair of a bucket links; sets: shingle_sets(), blocks: in_blocks()."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, block and kind: a block's own texts first."""
        at, held, block = None, [], None
        for batch in batches:
            out = []
            for key, part, kind, root, shingles in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "kind", "root")), batch.column("shingles"), strict=True):
                if (key, part) != at:
                    at, held, block = (key, part), [], None
                theirs = np.array(shingles.values.to_numpy(zero_copy_only=False))
                if kind == 0:
                    held.append((root, theirs))
                elif held or block:
                    block, held = block or Block(held, least), []
                    out += block.links(root, theirs)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*out, strict=True) if out else ([], []))], ["u", "v"])

    sent = blocks.join(sets, "node").select("key", "block", "kind", "root", "shingles")
    return sent.repartition("key", "block").sortWithinPartitions("key", "block", "kind").mapInArrow(compare, PAIRED)


def near_texts(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, th and component_id (the least doc_id that pairs reach) of every row."""
    rows, rows_at = stored(described(docs, shingle))
    nodes = rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), *(F.first(c).alias(c) for c in ("bands", "sig")))
    met, met_at = stored(members(nodes))
    pairs, pairs_at = stored(candidate_pairs(nodes, met, least))
    wanted = met.select("node").union(pairs.select("u")).union(pairs.select("v"))
    sets, sets_at = stored(shingle_sets(docs, rows, wanted, shingle))
    root = connected_components(verified(sets, pairs, least))
    blocks, blocks_at = stored(in_blocks(met, root))
    top = connected_components(linked_classes(sets, blocks, least)).select(F.col("u").alias("root"), F.col("root").alias("top"))
    label = rows.groupBy("node").agg(F.min("doc_id").alias("first_id")).join(root.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    label = label.join(top, "root", "left").select("node", "first_id", F.coalesce("top", "root").alias("root"))
    found = label.groupBy("root").agg(F.min("first_id").alias("component_id"))
    out, _ = stored(rows.select("doc_id", "th", "node").join(label.join(found, "root").select("node", "component_id"), "node").drop("node"))
    for path in (rows_at, met_at, pairs_at, sets_at, blocks_at):
        discard(docs.sparkSession, path)
    return out


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each group of like texts, with all its columns: the least doc_id, and of repeated rows of
    it the one whose columns' hash, then JSON text, is least. Rows without an id stay if no row of their group
    has one."""
    key = [F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("without"), F.col("th")]
    firsts = near_texts(docs, shingle, least).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*key).distinct()
    kept = whole_rows(docs).select(*key, "row").join(firsts, ["k", "without", "th"], "left_semi")
    text = F.to_json("row")
    return kept.groupBy("k", "without", "th").agg(F.min_by("row", F.struct(F.xxhash64(text), text)).alias("row")).select("row.*")
