import numpy as np
import pytest

from cairnspark.functions.hierarchy import condense, extract_eom, extract_leaf, glosh, single_linkage
from cairnspark.operators.hierarchy import effective_samples, hdbscan
from cairnspark.operators.knn import is_connected, knn_graph, knn_join
from cairnspark.operators.mst import boruvka_mst, cut, neighbour_graph_mst, pick_backend, prim_mst
from cairnspark.sources.points import from_numpy, to_numpy

TREE = [("parent", "i8"), ("child", "i8"), ("lambda", "f8"), ("child_size", "i8")]


def tree(parent, child, lam, size=None):
    out = np.zeros(len(parent), dtype=TREE)
    out["parent"], out["child"], out["lambda"], out["child_size"] = parent, child, lam, size or [1] * len(parent)
    return out


def test_glosh_trees():
    assert glosh(tree([6, 6, 7, 7, 7, 8, 8, 8], [7, 8, 0, 1, 2, 3, 4, 5], [1, 1, 3, 3, 3, 2, 2, 2]), 6).tolist() == [0] * 6
    assert np.allclose(glosh(tree([3, 4, 4, 4], [4, 0, 1, 2], [1, 10, 5, 2]), 3), [0, 0.5, 0.8])
    assert np.isclose(glosh(tree([3, 3, 4, 4], [4, 0, 1, 2], [0.5, 0.5, 10, 10]), 3)[0], 0.95)
    assert glosh(tree([2, 2], [0, 1], [np.inf, 1]), 2).tolist() == [0, 1]
    assert glosh(tree([2, 2], [0, 1], [0, 0]), 2).tolist() == [0, 0]


def test_leaf_tree():
    t = tree([6, 6, 7, 7, 8, 8, 9, 9, 10, 10], [7, 8, 9, 10, 4, 5, 0, 1, 2, 3], [1, 1, 2, 2, 3, 3, 3, 3, 3, 3], [4, 2, 2, 2, 1, 1, 1, 1, 1, 1])
    found = extract_leaf(t, 6)
    assert found.n_clusters == 3 and found.labels.tolist() == [1, 1, 2, 2, 0, 0]


def test_root_is_chosen_by_leaf_only():
    t = tree([3, 3, 3], [0, 1, 2], [1, 2, 2])
    assert extract_eom(t, 3).labels.tolist() == [-1] * 3
    assert extract_leaf(t, 3).labels.tolist() == [0] * 3


def test_duplicates_give_no_nan():
    n = 12
    u, v = np.arange(n - 1), np.arange(1, n)
    w = np.zeros(n - 1)
    w[5] = 9.0
    order = np.lexsort((v, u, w))
    rows = condense(single_linkage(u[order], v[order], w[order], n), n, 5)
    found = extract_eom(rows, n)
    assert not np.isnan(glosh(rows, n)).any()
    assert found.labels.tolist() in ([-1] * n, [0] * 6 + [1] * 6)


FIVE = np.array([(0, 0), (1, 0), (2, 0), (0, 1), (3, 0)], dtype=float)


@pytest.mark.parametrize("build", [prim_mst, boruvka_mst])
def test_five_points(spark, build):
    edges, core = build(from_numpy(spark, FIVE), 2)
    assert to_numpy(core, "core").tolist() == [1, 1, 1, 2, 4]
    assert edges.count() == 4 and edges.agg({"w": "sum"}).first()[0] == 8


@pytest.mark.parametrize("d", [2, 24])
def test_boruvka_matches_prim(spark, d):
    x = from_numpy(spark, np.random.default_rng(d).normal(size=(120, d)))
    a, b = (build(x, 4)[0].agg({"w": "sum"}).first()[0] for build in (prim_mst, boruvka_mst))
    assert np.isclose(a, b, rtol=1e-9)


def test_separate_groups_are_joined(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(100 * c, 1, (40, 8)) for c in range(3)])
    cloud = from_numpy(spark, x)
    edges, _ = neighbour_graph_mst(cloud, 5)
    assert edges.count() == 119 and cut(edges, cloud, float("inf")).select("component").distinct().count() == 1
    exact = prim_mst(cloud, 5)[0].agg({"w": "sum"}).first()[0]
    assert edges.agg({"w": "sum"}).first()[0] <= 1.02 * exact


def test_knn_matches_brute_force(spark):
    x = np.random.default_rng(5).integers(0, 4, (90, 3)).astype(float)  # many ties
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    want = {(i, r + 1): int(j) for i in range(90) for r, j in enumerate(np.lexsort((np.arange(90), d2[i]))[:6])}
    assert {(r.id, r.rank): r.nbr for r in knn_join(from_numpy(spark, x), 6).collect()} == want
    with pytest.raises(ValueError):
        knn_join(from_numpy(spark, x), 90)


def test_knn_graph_recall(spark):
    x = from_numpy(spark, np.random.default_rng(6).normal(size=(600, 32)))
    exact = {(r.id, r.nbr) for r in knn_join(x, 15).collect()}
    graph = knn_graph(x, 15)
    found = {(r.id, r.nbr) for r in graph.collect()}
    assert len(exact & found) / len(exact) >= 0.9
    assert is_connected(graph, 600)


@pytest.mark.parametrize("method", ["eom", "leaf"])
def test_hdbscan_groups(spark, method):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, 0.2, (40, 2)) for c in (0, 5, 10)] + [[(50, 50)]])
    found = hdbscan(from_numpy(spark, x), 10, method=method)
    own = to_numpy(found.labels)
    if method == "eom":
        assert found.n_clusters == 3
        assert all(len(set(own[k * 40 : k * 40 + 40].tolist()) - {-1}) == 1 for k in range(3))
    assert own[-1] == -1 and to_numpy(found.labels, "score")[-1] > 0.9
    assert found.dendrogram.count() == 120 and found.condensed.where("child < 121").count() == 121


def test_hdbscan_conventions(spark):
    assert [effective_samples(5, 0, c) for c in ("sklearn", "campello")] == [4, 5]
    assert [pick_backend(n, d) for n, d in ((100, 2), (100, 40), (20_000, 40), (100, 64))] == ["boruvka", "prim", "boruvka", "nn_descent"]
    for bad in ({"method": "x"}, {"convention": "x"}, {"backend": "x"}, {"min_cluster_size": 9}, {"min_samples": 6}):
        with pytest.raises(ValueError):
            hdbscan(from_numpy(spark, FIVE), **({"min_cluster_size": 2, "min_samples": 2} | bad))
