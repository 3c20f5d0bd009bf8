"""Density clustering against a plain version over the whole distance matrix."""

import numpy as np
import pandas as pd
import pytest

from factloom.operators import density


def brute_tree(ids, v, min_samples):
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    core = np.sort(d + np.where(np.eye(len(v)), -1, 0), 1)[:, min(min_samples, len(v) - 1)]
    w = np.maximum(np.maximum(d, core[:, None]), core[None])
    order = sorted((w[i, j], *sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in range(i))
    top = {i: i for i in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    out = []
    for weight, a, b in order:
        if root(a) != root(b):
            top[root(a)] = root(b)
            out.append((a, b, weight))
    return sorted(out)


def blobs(seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 20, (4, 5))
    v = np.concatenate([*(c + rng.normal(0, 0.5, (40, 5)) for c in centres), rng.uniform(-60, 60, (15, 5)), np.repeat(centres[:1], 3, 0)])
    return v, np.repeat([0, 1, 2, 3, -1, 0], [40, 40, 40, 40, 15, 3])


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(density, "CHUNK", 16)
    monkeypatch.setattr(density, "BLOCK", 20)
    monkeypatch.setattr(density, "NEIGHBOURS", 3)


def frame(spark, ids, v):
    return spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, v, strict=True)], "id long, v array<double>")


@pytest.mark.parametrize("min_samples", [1, 5])
def test_tree_and_labels(spark, small_cells, min_samples):
    v, truth = blobs()
    ids = np.random.default_rng(2).permutation(len(v)) * 3
    tree, _ = density.reachability_tree(frame(spark, ids, v), min_samples)
    got = sorted((r["lo"], r["hi"], r["w"]) for r in tree.collect())
    want = brute_tree(ids.tolist(), v, min_samples)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want])
    found = {r["id"]: (r["label"], r["outlier"]) for r in density.density_clusters(frame(spark, ids, v), 5, min_samples).collect()}
    again = {r["id"]: (r["label"], r["outlier"]) for r in density.density_clusters(frame(spark, ids[::-1], v[::-1]).repartition(5), 5, min_samples).collect()}
    assert found == again
    plain = density.labelled(pd.DataFrame(want, columns=["lo", "hi", "w"]), 5)
    assert {i: x for i, x, _ in plain.itertuples(index=False)} == {i: x for i, (x, _) in found.items()}
    for k in range(4):  # the points of each blob share a label that no other blob has
        own = [found[i][0] for i, t in zip(ids, truth, strict=True) if t == k]
        assert max(set(own), key=own.count) >= 0 and own.count(max(set(own), key=own.count)) >= 36
    lone = [found[i] for i, t in zip(ids, truth, strict=True) if t == -1]
    assert sum(x == -1 for x, _ in lone) >= 12 and all(0 <= s <= 1 for _, s in found.values())
    assert np.mean([s for _, s in lone]) > 0.5


def test_condensed_tree_of_a_hand_made_case():
    # two tight pairs, one point between, far apart: 1-2 and 5-6 at 1, 3 joins at 4, both sides at 10
    edges = pd.DataFrame([(1, 2, 1.0), (2, 3, 4.0), (5, 6, 1.0), (3, 5, 10.0)], columns=["lo", "hi", "w"])
    tree = density.condensed(edges, 2)
    assert sorted(tree.itertuples(index=False, name=None)) == sorted([(0, 1, 0.1, 3), (0, 2, 0.1, 2), (1, -3, 0.25, 1), (1, -1, 1.0, 1), (1, -2, 1.0, 1), (2, -4, 1.0, 1), (2, -5, 1.0, 1)])
    out = density.labelled(edges, 2)
    assert out["label"].tolist() == [0, 0, 0, 1, 1]
    assert out["outlier"].tolist() == pytest.approx([0, 0, 0.75, 0, 0])


def test_few_points_and_retry(spark):
    empty = frame(spark, [], [])
    assert density.density_clusters(empty).count() == 0 and density.with_retry(empty).count() == 0
    assert [tuple(r) for r in density.density_clusters(frame(spark, [7], [[1.0, 2.0]])).collect()] == [(7, -1, 0.0)]
    two = density.with_retry(frame(spark, [1, 2], [[0.0], [1.0]]))
    assert {r["label"] for r in two.collect()} == {-1} and {r["min_samples"] for r in two.collect()} == {1}


def test_comparisons_send_few_pairs(spark, small_cells, monkeypatch):
    """Without structure in the vectors each point met each chunk by itself, and brought its neighbours in each."""
    v = np.random.default_rng(5).normal(size=(300, 12))
    made, compare = [], density.Cells.compare
    monkeypatch.setattr(density.Cells, "compare", lambda *a: made.append(compare(*a)) or made[-1])
    got = {r["id"]: [x["id"] for x in r["near"]] for r in density.nearest(density.Cells(frame(spark, range(300), v)), 3).collect()}
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) + np.where(np.eye(300), np.inf, 0)
    assert got == {i: np.argsort(d[i], kind="stable")[:3].tolist() for i in range(300)}
    assert made[0].count() <= 300 * 3 * 6
