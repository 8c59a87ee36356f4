"""The pipeline's stages against plain versions on the smallest tables."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from hearthline.llm import langid, similar

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def shingles(text):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def components(texts):
    """The least place that pairs of texts with a five-word Jaccard likeness of 0.8 or more reach, for each."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if (c := len(a & b)) and c >= 0.8 * (len(a) + len(b) - c)]
    while any(root[i] != root[j] for i, j in pairs):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return root


def stripped(texts, w=corpus_pipeline.PASSAGE_BYTES):
    data = [t.encode() for t in texts]
    seen = Counter(d[p : p + w] for d in data for p in range(len(d) - w + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for p in range(len(d) - w + 1):
            if seen[d[p : p + w]] > 1:
                gone[p] += 1
                gone[p + w] -= 1
        flags = np.cumsum(gone[:-1]) > 0
        out.append(bytes(b for b, f in zip(d, flags, strict=True) if not f).decode(errors="ignore") if flags.any() else None)
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(DATA)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got[name] = docs
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(got[n].columns == columns for n in list(got)[:-1])
    first = spark.read.parquet(f"{DATA}/documents.parquet")
    judge = langid.Classifier(langid.dictionaries(first), 6, 0.001)
    kept = {r.doc_id: r.text for r in first.orderBy("doc_id").collect() if not judge(r.text)[2]}
    rows = lambda n: {r.doc_id: r.text for r in got[n].collect()}
    assert rows("language_id") == kept
    ids = list(kept)
    kept = {ids[k]: kept[ids[k]] for k, r in enumerate(components([kept[i] for i in ids])) if k == r}
    assert rows("near_dedup") == kept
    left = {i: t if u is None else u for (i, t), u in zip(kept.items(), stripped(kept.values()), strict=True) if u is None or u.strip()}
    assert rows("passage_dedup") == left
    assert {r.doc_id: r.n_chars for r in got["passage_dedup"].collect()} == {i: len(t) for i, t in left.items()}
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = norm(r.text)
        grams |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(g) for g in grams}
    clean = {i: t for i, t in left.items() if not any(tuple(w[k : k + n]) in grams for w in [norm(t)] for n in sizes for k in range(len(w) - n + 1))}
    assert rows("decontamination") == clean
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter()
    for r in got["packing"].collect():
        tokens[r.doc_id] += r.length
    assert tokens == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}


def test_near_copies_go(spark):
    """Copies with some words exchanged, cut off or put in, at likenesses from 0.8 on, are found; unlike texts stay,
    also where many of them share a passage, and where a third of all rows are one text."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 9)))
    shared = [word() for _ in range(40)]
    texts = []
    for k in range(150):
        base = [word() for _ in range(rnd.randint(60, 700))]
        if k % 3 == 0:
            base[10:10] = shared
        texts.append(base)
        for _ in range(rnd.randint(1, 3)):
            copy = list(base)
            for _ in range(rnd.randint(1, max(1, len(base) // 45))):
                at = rnd.randrange(len(copy))
                copy[at : at + rnd.randint(0, 1)] = [word()] * rnd.randint(0, 1)
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["same text again and again"] * 200 + [None, "", " ", "one", "ONE"]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    got = {r.doc_id: r.component_id for r in similar.near_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if (c := len(a & b)) and c >= 0.8 * (len(a) + len(b) - c)]
    linked = sum(got[i] == got[j] for i, j in pairs if i < 500 and j < 500)
    assert linked >= 0.98 * sum(i < 500 and j < 500 for i, j in pairs)
    true = components(texts)
    assert all(true[i] == true[got[i]] for i in got)
    assert len({got[i] for i, t in enumerate(texts) if t == "same text again and again"}) == 1
    assert got[len(texts) - 1] == got[len(texts) - 2] and got[len(texts) - 3] == got[len(texts) - 5]
    kept = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == {c for i, c in got.items()}


def test_near_copies_of_stock_paragraphs(spark):
    """Forms and boilerplate: texts of ten of 24 paragraphs, half of them with an edited copy alike to 0.8 or more."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 9)))
    stock = [[word() for _ in range(40)] for _ in range(24)]
    texts, wanted = [], []
    for _ in range(300):
        base = [w for p in rnd.sample(stock, 10) for w in p]
        copy = list(base)
        for _ in range(rnd.randint(1, 6)):
            copy[rnd.randrange(len(copy))] = word()
        wanted.append((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(copy)]
    sets = [shingles(t) for t in texts]
    alike = lambda i, j: (c := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - c)
    wanted = [(i, j) for i, j in wanted if alike(i, j)]
    got = {r.doc_id: r.component_id for r in similar.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert len(wanted) > 200 and sum(got[i] == got[j] for i, j in wanted) >= 0.98 * len(wanted)
    true = components(texts)
    assert all(true[i] == true[got[i]] for i in got)


def test_crowded_buckets(spark, monkeypatch):
    """Buckets beyond the crowd are parted and stream through in pieces; copies of one text stay together."""
    monkeypatch.setattr(similar, "CROWD", 8)
    monkeypatch.setattr(similar, "GATHERED", 4)
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(9999)}" for _ in range(400)]
    texts = []
    for k in range(160):
        copy = list(base) if k % 2 else [f"v{k % 7}-{x}" for x in range(400)]
        copy[rnd.randrange(400)] = f"n{rnd.randrange(10**6)}"
        texts.append(" ".join(copy))
    got = {r.doc_id: r.component_id for r in similar.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert got == dict(enumerate(components(texts)))


def test_a_family_around_the_threshold(spark):
    """Eighty copies edited in three places each: most pairs are a little less alike than 0.8, the others are links."""
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(9999)}" for _ in range(200)]
    texts = []
    for _ in range(80):
        copy = list(base)
        for _ in range(3):
            copy[rnd.randrange(200)] = f"n{rnd.randrange(10**6)}"
        texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if (c := len(a & b)) >= 0.8 * (len(a) + len(b) - c)]
    got = {r.doc_id: r.component_id for r in similar.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert len(pairs) > 50 and sum(got[i] == got[j] for i, j in pairs) >= 0.97 * len(pairs)


def edited_family(n: int, words: int, edits: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(9999)}" for _ in range(words)]
    texts = []
    for _ in range(n):
        copy = list(base)
        for _ in range(edits):
            copy[rnd.randrange(words)] = f"n{rnd.randrange(10**6)}"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("crowd, held", [(2048, 1 << 20), (8, 1 << 20), (2048, 1000)])
def test_no_link_of_a_bucket_is_lost(spark, monkeypatch, crowd, held):
    """Copies of which most pairs are a little less alike than 0.8: groups are just those of all links between texts
    that share a band, also where buckets are cut into pieces and blocks."""
    monkeypatch.setattr(similar, "CROWD", crowd)
    monkeypatch.setattr(similar, "HELD", held, raising=False)
    texts = edited_family(240, 220, 4, 8) + edited_family(60, 170, 3, 9)
    sets = [shingles(t) for t in texts]
    bands = [set(similar.band_keys(similar.minima(np.unique(similar.shingle_hashes(t, 5)))).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if bands[i] & bands[j] and (c := len(a & b)) >= 0.8 * (len(a) + len(b) - c):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    got = {r.doc_id: r.component_id for r in similar.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert 20 < len(set(root)) <= len(texts) - 20
    assert got == dict(enumerate(root))


def test_a_bucket_sends_fewer_edges_than_it_has_texts():
    texts = edited_family(300, 200, 3, 6)
    sets = [np.unique(similar.shingle_hashes(t, 5)) for t in texts]
    columns = [[7] * len(texts), [""] * len(texts), [similar.node_of(t) for t in texts], [len(s) for s in sets], [similar.minima(s).astype(np.uint8).tobytes() for s in sets]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "sub", "node", "size", "sig"])
    assert 0 < sum(b.num_rows for b in similar.met_in_buckets(0.8)([batch])) < len(texts)


def peak_mb(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_crowd_of_near_copies_takes_little_memory():
    """A piece of CROWD texts that are all alike joins up, within a few bytes for each of its pairs (27 before)."""
    rng = np.random.default_rng(1)
    sigs = np.repeat(rng.integers(0, 256, (1, 80), dtype=np.uint8), similar.CROWD, axis=0)
    sigs[:, :6] = rng.integers(0, 256, (similar.CROWD, 6))
    edges, mb = peak_mb(lambda: similar.likely_edges(sigs, rng.integers(280, 320, similar.CROWD), 0.8))
    assert len(edges) == similar.CROWD - 1 and mb < 8 * similar.CROWD**2 / 1e6


def test_a_block_meets_its_shingles_in_pieces():
    """A text that shares its shingles with all of a block's: links are those of sets, in little memory."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 480)
    held = [(b"%d" % k, np.unique(np.append(base[rng.random(480) < 0.93], rng.integers(0, 1 << 62, 25)))) for k in range(2000)]
    block = similar.Block(held, 0.8)
    found, mb = peak_mb(lambda: list(block.links(*held[0])))
    mine = set(held[0][1].tolist())
    alike = {r for r, s in held[1:] if (c := len(mine.intersection(s.tolist()))) >= 0.8 * (len(mine) + len(s) - c)}
    assert 20 < len(alike) < 1980 and {v for _, v in found} == alike and mb < 6


def test_stages_get_few_rows_at_a_time(spark):
    """Whatever the session's limit was, unless it is lower; a limit of zero is none."""
    key, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.createDataFrame([(k, f"text {k}", "en", "s", 6) for k in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    was = spark.conf.get(key)
    try:
        for limit, held in (("10000", 1000), ("0", 1000), ("-1", 1000), ("70", 70)):
            for _, stage in corpus_pipeline.STAGES[3:]:
                spark.conf.set(key, limit)
                stage(spark, docs, str(DATA))
                assert int(spark.conf.get(key)) == held
    finally:
        spark.conf.set(key, was)


def test_bands_meet_as_computed():
    rnd = random.Random(7)
    met = 0
    for _ in range(300):
        common = [rnd.getrandbits(63) for _ in range(160)]
        a, b = (np.array(common + [rnd.getrandbits(63) for _ in range(20)], np.uint64) for _ in range(2))
        met += bool(set(similar.band_keys(similar.minima(a)).tolist()) & set(similar.band_keys(similar.minima(b)).tolist()))
    assert similar.recall(0.8) > 0.998 and met >= 297


def test_passages_of_over_fifty_words_go(spark):
    """Planted passages of 51 to 80 words are cut out of every document that holds one; clean texts stay as they are."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("etaoinshrdlu", k=rnd.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rnd.randint(51, 80))) for _ in range(20)]
    texts = [" ".join(word() for _ in range(rnd.randint(20, 200))) for _ in range(120)]
    planted = {k: passages[k // 3] for k in range(60)}
    full = [f"{t} {planted[k]} {t[::-1]}" if k in planted else t for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(full)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.passage_dedup(spark, docs, str(DATA)).collect()}
    for k, t in enumerate(full):
        assert (got[k] == t) == (k not in planted)
        assert k not in planted or planted[k][8:-8] not in got[k]


def test_stages_on_odd_tables(spark, tmp_path):
    """Null and empty texts, null ids, repeated rows and columns named like an operator's own."""
    odd = "doc_id long, text string, lang string, source string, n_chars int, th long, row string, starts int, k long"
    said = "the of and to in is that it was for on are with as his they be at one have this"
    rows = [(k, f"{said} {k} {said[::-1]} " * 3, "en", None, 1, 7, "r", k, 5) for k in range(12)] + [(3, None, None, "s", None, 8, None, 1, None), (None, "", "en", "s", 0, 9, "x", 2, 1)]
    docs = spark.createDataFrame([*rows, rows[0], rows[0][:-1] + (6,)], odd)
    for case, frame in (("odd", docs), ("empty", docs.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(DATA))
            assert name == "packing" or out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/{case}-{name}")
            frame = spark.read.parquet(f"{tmp_path}/{case}-{name}")
        assert case == "odd" or frame.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, str(DATA)).count() > 0
