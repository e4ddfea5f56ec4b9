"""Near-duplicate vectors and nearest neighbours against brute force."""

import numpy as np
import pytest

from plisse.llm import embed_dedup, nearest
from plisse.llm.vectors import unit

from .helpers import joined, table, vectors

SCHEMA = "vec_id long, embedding array<double>"
ODD = [(5001, None), (5002, []), (5003, [0.0] * 24), (5004, [float("nan")] + [1.0] * 23), (5005, [None] + [1.0] * 23), (5006, [float("inf")] + [1.0] * 23), (5007, [1.0, 2.0]), (5008, [2.0, 4.0]), (None, [1.0] * 24)]


def linked(x):
    u = unit(x)
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    return s


@pytest.mark.parametrize("cap", [1500, 25])
def test_near_duplicates(spark, monkeypatch, cap):
    """With a small bound leaves are cut into blocks; counts and components stay the same."""
    monkeypatch.setattr(embed_dedup, "CAP", cap)
    x = vectors()
    s = linked(x)
    low = joined([(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(s)), strict=True)], range(len(x)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + ODD
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(table(spark, rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(x))] == [(int(s[i].sum()), low[i], low[i] == i) for i in range(len(x))]
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(5001, 5007))
    assert got[5007].n_links == 1 and got[5008].component_id == 5007
    assert got[None].n_links == 0 and got[None].component_id is None


def test_near_duplicates_of_repeated_rows_and_none(spark):
    v = [1.0] + [0.0] * 23
    got = embed_dedup.near_duplicates(table(spark, [(7, v), (7, v), (9, v)], SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False)]
    assert embed_dedup.near_duplicates(table(spark, [], SCHEMA)).isEmpty()


def test_forest_finds_near_pairs_in_common_leaves():
    rng = np.random.default_rng(3)
    x = unit(rng.standard_normal((3000, 64)))
    y = unit(x[:500] + rng.standard_normal((500, 64)) * 0.035)
    near = (x[:500] * y).sum(1) >= 0.95
    forest = embed_dedup.Forest(5, 64).fit(x)
    leaves = [{} for _ in range(2)]
    for k, part in enumerate((x[:500], y)):
        for r, leaf in zip(*forest.route(part), strict=True):
            leaves[k].setdefault(int(r), set()).add(int(leaf))
    met = np.array([bool(leaves[0][i] & leaves[1][i]) for i in range(500)])
    assert near.sum() > 200 and met[near].mean() > 0.995


def test_forest_splits_below_its_sample():
    """Deeper than the sample has medians for, a cluster far from the origin is still halved, not sent to one side."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64) * 3
    x = unit(centre + rng.standard_normal((20_000, 64)))
    forest = embed_dedup.Forest(8, 64, trees=2, spill=0.0).fit(x[:300])
    _, leaves = forest.route(x)
    sizes = np.unique(leaves, return_counts=True)[1]
    assert sizes.max() < 20 * 20_000 / 256


def brute(x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    return np.lexsort((np.arange(len(x)), d))[:k], d


@pytest.mark.parametrize(("cap", "crowded"), [(4000, 1 << 40), (7, 1 << 40), (4000, 1)])
def test_nearest(spark, cap, crowded):
    """Also with buckets, of vectors and of queries, cut into blocks, and with hashes of two rotations."""
    x = vectors(n=900)
    got = {}
    for r in nearest.nearest(table(spark, [(i, v.tolist()) for i, v in enumerate(x)] + ODD, SCHEMA), cap=cap, crowded=crowded).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 100))
    hits = 0
    for q, rows in got.items():
        order, d = brute(x, q)
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [(r[2], r[1]) for r in rows] == sorted((r[2], r[1]) for r in rows)
        assert np.allclose([r[2] for r in rows], d[[r[1] for r in rows]], rtol=0, atol=1e-12)
        hits += len({r[1] for r in rows} & set(order.tolist()))
    assert hits >= 0.95 * 10 * len(got)


def test_nearest_of_few_ties_and_none(spark):
    x = np.tile([1.0, 2.0, 3.0], (30, 1))
    got = nearest.nearest(table(spark, [(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 0.0) for i in range(1, 11)]
    opposite = [(0, [1.0, 0.0]), (1, [-1.0, 0.1]), (2, [-1.0, -0.1]), (2, [-1.0, -0.1])]
    assert [r.vec_id for r in nearest.nearest(table(spark, opposite, SCHEMA)).orderBy("rank").collect()] == [1, 2]
    assert nearest.nearest(table(spark, [], SCHEMA)).isEmpty() and nearest.nearest(table(spark, [(0, [1.0])], SCHEMA)).isEmpty()


def test_rotation_keeps_lengths_and_signs():
    index = nearest.CrossPolytope(24)
    x = vectors(n=50)
    y = index.rotate(x, 0)
    assert np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1)) and y.shape[1] == 32
    both = np.concatenate([y, -y], axis=1)
    assert (index.place(x, 0) == both.argmax(1)).all()
    b = index.probe(x, 0, 3)
    assert (np.sort(both, axis=1)[:, -3:] == np.sort(np.take_along_axis(both, b, 1), axis=1)).all()
    pairs = nearest.CrossPolytope(24, 2)
    first, second = (np.concatenate([z, -z], axis=1).argmax(1) for z in (pairs.rotate(x, 1, 0), pairs.rotate(x, 1, 1)))
    assert (pairs.place(x, 1) == first * 64 + second).all() and (pairs.probe(x, 1, 1)[:, 0] == pairs.place(x, 1)).all()


@pytest.mark.parametrize("dim", [64, 256])
def test_chosen_probes_reach_the_recall_on_other_vectors(dim):
    """In many dimensions too, and with lengths that vary; the plan is made on one sample and measured on another."""
    rng = np.random.default_rng(dim)
    x, y = (rng.standard_normal((3000, dim)) * rng.lognormal(0, 0.5, (3000, 1)) for _ in range(2))
    index, tables, probes = nearest.choose(x, 1 << 20, 1 << 10)
    assert tables >= nearest.LEAST and probes <= index.buckets
    trials = np.arange(0, 3000, 30)
    d2 = (y[trials] ** 2).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * y[trials] @ y.T
    d2[np.arange(100), trials] = np.inf
    true = np.argpartition(d2, 10, axis=1)[:, :10]
    met = np.zeros(true.shape, bool)
    for t in range(tables):
        place, asked = index.place(unit(y), t), index.probe(unit(y[trials]), t, probes)
        met |= (place[true][:, :, None] == asked[:, None, :]).any(axis=2)
    assert met.mean() >= 0.9


def test_nearest_of_vectors_of_other_lengths(spark):
    """Those of a rarer length have neighbours too: all of their own length."""
    x = vectors(n=300)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + 20 * i, [float(i), 1.0, -1.0]) for i in range(12)]
    got = {}
    for r in nearest.nearest(table(spark, rows, SCHEMA)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 10_000, 10_100, 10_200}
    assert [(v, s) for _, v, s in sorted(got[10_000])] == [(10_000 + 20 * i, float(i)) for i in range(1, 11)]
    assert all(len(v) == 10 for v in got.values())
