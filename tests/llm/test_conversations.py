"""The prefix trie against a plain one, and on nulls, ties, long and turnless conversations and empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from hearthline.llm import conversations
from hearthline.llm.running import running_sums

SCHEMA = "conv_id long, turn long, role string, text string, conv long, depth long, rank string"
rnd = random.Random(9)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "z") for r in rows], SCHEMA).repartition(3)


def plain(rows):
    """The trie as nested prefixes, one at a time."""
    original = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        original.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(original.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    words = lambda k: len(k[-1][1].encode().split()) if k else 0
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)

    out, done = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        below = [done[x] for x in children.get(k, ())]
        done[k] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + (len(nodes[k]) - 1) * words(k))
        ends = ",".join(str(c) for c in sorted(c for c in nodes[k] if built[c] == k))
        out[min(nodes[k]), len(k)] = (min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(children.get(k, ())), *done[k], hashlib.sha256(ends.encode()).hexdigest())
    return out


def check(spark, rows):
    got = conversations.prefix_trie(frame(spark, rows)).collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    want = plain(rows)
    assert len(got) == len(found) and found == want
    # Intervals: a node's subtree is the nodes from its own place to its end.
    assert sorted(r.preorder for r in got) == list(range(1, len(got) + 1))
    at = {(r.conv_id, r.depth): r for r in got}
    for r in got:
        if r.depth:
            up = at[r.parent_conv_id, r.depth - 1]
            assert up.preorder < r.preorder <= r.subtree_end <= up.subtree_end
    return found


def test_trie_of_random_conversations(spark):
    rows = []
    for c in rnd.sample(range(4000), 300):
        for t in range(rnd.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["hello there", "a b c", "", None, "x\ty \n z"])))
    rows += [(c, t, "user", f"turn {t}") for c in range(5000, 5200) for t in range(4)]
    rows += [(None, 0, "user", "none"), (-45, 0, "user", "below zero"), (-45, 1, "user", "b"), (-40, 0, "user", "src"), (1 << 62, 0, "user", "big"), (1 << 62, 1, "user", "bigger")]
    rows += [(7777, None, "user", "null first"), (7777, 0, "user", "then"), (7780, 3, "a", "same turn"), (7780, 3, "b", "other"), *[(7781, 2, "user", "again")] * 5]
    rnd.shuffle(rows)
    check(spark, rows)


def test_long_chains_that_part_at_every_depth(spark):
    """A trunk of 60 turns, a conversation leaving at each depth, one leaving each of those, and copies."""
    rows = [(0, t, "u", f"w{t}") for t in range(60)] + [(20 * 999, t, "u", f"w{t}") for t in range(60)]
    zero = [c for c in range(1, 4000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 0]
    for k in range(1, 60):
        rows += [(zero[k], t, "u", f"w{t}" if t < k else f"leaves {k} {t}") for t in range(k + 2)]
        rows += [(zero[100 + k], t, "u", f"w{t}" if t < k else f"leaves {k} {t}" if t == k else "leaves again") for t in range(k + 3)]
    check(spark, rows)


def test_a_conversation_over_many_tasks(spark):
    """Carries over partitions: one conversation holds most rows."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = [(41, t, "u", f"w{t % 7}") for t in range(3000)] + [(61, t, "u", f"w{t % 7}") for t in range(2500)] + [(c, 0, "u", "one") for c in range(100, 160)]
        found = check(spark, rows)
        assert max(d for _, d in found) >= 2996
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_turnless_and_nothing(spark):
    turnless = next(c for c in range(1, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    found = check(spark, [(turnless, 0, "u", "gone"), (turnless + 2000, 0, "u", "gone"), (500, 0, "u", "stays"), (500, 1, "u", "stays"), (500, 2, "u", "stays"), (500, 3, "u", "stays")])
    assert found[min(turnless, 500), 0][5] != hashlib.sha256(b"").hexdigest()
    assert conversations.prefix_trie(frame(spark, [(1, 0, "u", "x")]).limit(0)).count() == 0


def test_running_sums(spark):
    rows = [(rnd.randrange(50), k, rnd.randrange(-5, 9)) for k in range(500)]
    out, _ = running_sums(spark.createDataFrame(rows, "a long, b long, v long").repartition(4), ["a", "b"], {"s": "v"})
    total, want = 0, {}
    for a, b, v in sorted(rows):
        total += v
        want[a, b] = total
    assert {(r.a, r.b): r.s for r in out.collect()} == want
