"""Whitening and nearest neighbours against brute force, and on nulls, odd lengths, ties and empty tables."""

from __future__ import annotations

import numpy as np
import pytest

from hearthline.llm import neighbours, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x long, v string, n long"
rng = np.random.default_rng(3)


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v if v is None else [float(x) if x is not None else None for x in v], 1, 2, "z", 3) for i, v in rows], schema).repartition(3)


def white(rows, k=4):
    """Brute force: quantised rows, distinct ones' mean and covariance, full eigendecomposition."""
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max(len(v) for _, v in good)
    x = [(i, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) + (0,) * (d - len(v))) for i, v in good]
    fit = np.array(sorted({t for _, t in x}), float)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(d, d))
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, t in x:
        dev = sum((n * a - s) ** 2 for a, s in zip(t, sums))
        for c in range(min(k, d)):
            if e[c] > 1e-13 * e.sum():
                out.setdefault((i, c + 1), []).append((n, dev, float((np.array(t) - fit.mean(axis=0)) @ u[:, c] / np.sqrt(e[c])), e[c] / e.sum()))
    return out


def check_white(got, want, gap=True):
    found = {}
    for r in got:
        found.setdefault((r.vec_id, r.component), []).append(r)
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in want.items()}
    signs = {}
    for (i, c), rows in found.items():
        for r, (n, dev, w, share) in zip(sorted(rows, key=lambda r: r.deviation), sorted(want[i, c], key=lambda x: x[1])):
            assert (r.n, r.deviation) == (n, dev) and abs(r.explained - share) < 1e-9 and r.identity_error < 1e-9
            if gap:
                sign = signs.setdefault(c, 1 if abs(r.whitened - w) < abs(r.whitened + w) else -1) if abs(w) > 1e-3 else signs.get(c, 1)
                assert abs(sign * r.whitened - w) < 1e-7 or abs(w) <= 1e-3


def test_whitening_against_full_eigendecomposition(spark):
    base = rng.standard_normal((300, 12)) * np.linspace(3, 0.2, 12)
    rows = [*enumerate(base.tolist()), (5, base[5].tolist()), (None, base[7].tolist()), (900, base[9].tolist()), (901, None), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, [1.0, 2.0]), (906, [])]
    check_white(whitening.whiten(frame(spark, rows)).collect(), white(rows))


def test_whitening_needs_no_gap_between_eigenvalues(spark):
    rows = list(enumerate(rng.standard_normal((400, 40)).tolist()))
    got = whitening.whiten(frame(spark, rows)).collect()
    check_white(got, white(rows))
    assert whitening.fit(whitening.packed(frame(spark, rows), "vec_id", "embedding").select("x").distinct(), 4, most_blocks=3).passes > 5


def test_whitening_restarts_within_bounded_blocks(spark):
    """A space of three blocks of eight in 40 dimensions finds what the whole does."""
    rows = list(enumerate((rng.standard_normal((200, 40)) * np.linspace(2, 0.5, 40)).tolist()))
    packed = whitening.packed(frame(spark, rows), "vec_id", "embedding").select("x").distinct().cache()
    some, whole = (whitening.fit(packed, 4, most_blocks=m) for m in (3, 32))
    assert np.allclose(np.abs(some.components.T @ whole.components), np.eye(4), atol=1e-8) and np.allclose(some.eigenvalues, whole.eigenvalues, rtol=1e-12)


def test_whitening_of_few_dimensions_no_variance_and_nothing(spark):
    rows = list(enumerate(rng.standard_normal((30, 2)).tolist()))
    check_white(whitening.whiten(frame(spark, rows)).collect(), white(rows))
    line = [(i, [float(i % 7), 2.0, 3.0, 2.0 * (i % 7), 0.0]) for i in range(50)]
    got = whitening.whiten(frame(spark, line)).collect()
    check_white(got, white(line))
    assert {r.component for r in got} == {1}
    assert whitening.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    assert whitening.whiten(frame(spark, rows).limit(0)).count() == 0


def test_whitening_of_huge_entries(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((20, 3)) * [1e30, 1.0, 1e9])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) and all(r.deviation is None for r in got)


def nearest(rows, k, every):
    """Brute force over distinct rows; the query's own row is left out."""
    good = sorted({(i, tuple(np.float32(v).tolist())) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}, key=lambda r: (r[0] is None, r))
    d = max(len(v) for _, v in good)
    x = np.array([v + (0.0,) * (d - len(v)) for _, v in good])
    out = {}
    for q, (i, _) in enumerate(good):
        if i is not None and i % every == 0:
            score = (x * x[q]).sum(axis=1)
            order = sorted((j for j in range(len(good)) if j != q), key=lambda j: (-score[j], good[j][0] is None, good[j][0] or 0))[:k]
            out.setdefault(i, []).append([(good[j][0], score[j]) for j in order])
    return out


def check_nearest(spark, rows, k, every, least=1.0, **more):
    got = neighbours.search(frame(spark, rows), k, every, **more).collect()
    want = nearest(rows, k, every)
    assert {r.query_id for r in got} == {i for i, v in want.items() if v[0]}
    hit = total = 0
    for i, lists in want.items():
        if len(lists) > 1:
            continue
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(lists[0]) + 1))
        assert all(a.score > b.score or a.score == b.score and (b.vec_id is None or a.vec_id < b.vec_id) for a, b in zip(mine, mine[1:]))
        scores = dict(lists[0])
        hit += sum(r.vec_id in scores and abs(scores[r.vec_id] - r.score) <= 1e-9 * max(1, abs(r.score)) for r in mine)
        total += len(lists[0])
    assert hit >= least * total


def test_neighbours_of_few_rows_are_exact(spark):
    base = rng.standard_normal((200, 19)) * rng.exponential(1, (200, 1))
    rows = list(enumerate(base.tolist())) + [(5, base[5].tolist()), (5, base[5].tolist()), (None, base[3].tolist()), (700, [0.0] * 19), (701, None), (702, [None] * 19), (703, [float("inf")] * 19), (704, [1.0, -2.0]), (705, [])]
    rows += [(1000 + j, base[40].tolist()) for j in range(60)]  # ties of one vector, queries among them
    check_nearest(spark, rows, 20, 20)
    check_nearest(spark, rows[:9], 20, 4)
    assert neighbours.search(frame(spark, rows).limit(0)).count() == 0
    assert neighbours.search(frame(spark, [(20, [1.0, 2.0])])).count() == 0
    assert neighbours.search(frame(spark, rows[1:19])).count() == 0


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_of_probed_lists(spark, clustered):
    centre = rng.standard_normal((30, 32)) * (3 if clustered else 0)
    x = centre[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 32))
    check_nearest(spark, list(enumerate(x.tolist())), 20, 20, 0.93, list_rows=64)


def test_norms_of_all_sizes(spark):
    """Inner product is not cosine: a few long vectors are everyone's neighbours."""
    x = rng.standard_normal((1500, 16)) * np.where(rng.random((1500, 1)) < 0.01, 1e4, 1.0)
    check_nearest(spark, list(enumerate(x.tolist())), 20, 20, 0.93, list_rows=64)
    check_nearest(spark, [(i, (v * 1e30).tolist()) for i, v in enumerate(x[:300])], 20, 20, 0.93)


def test_dimension_test_leaves_candidates_early(spark):
    """The scan meets nearly all true neighbours, though most candidates are left before the last block."""
    x = rng.standard_normal((2000, 64)).astype("<f4")
    space = neighbours.Space(64, float(np.linalg.norm(x, axis=1).max()), "<f4")
    segment = neighbours.Segment(space, [v.tobytes() for v in x])
    q = x[:50].astype(float)
    found = segment.search(q, np.linalg.norm(q, axis=1), np.full(50, -np.inf), 21)
    best = np.sort(q @ x.T.astype(float), axis=1)[:, -21:]
    hit = sum((found[2][found[0] == i] >= best[i, 0] - 1e-9).sum() for i in range(50))
    assert hit >= 0.98 * 50 * 21
