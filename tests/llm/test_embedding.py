import numpy as np

from lociframe.llm.embedding import SPILL, TREES, Forest, Tree, grow_tree, near_duplicate_vectors, new_links, op2_projection_forest_dedup


def brute(x):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = y @ y.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            return link.sum(axis=1), label
        label = new


def planted(rng, n, dim=16):
    x = [rng.normal(size=dim) for _ in range(n)]
    for g, size in ((0, 40), (1, 7), (2, 2), (3, 700)):
        for _ in range(size):
            x.append(x[g] + rng.normal(size=dim) * 0.12)
    x += [x[5]] * 30 + [x[-1]] * 5
    return np.array([x[i] for i in rng.permutation(len(x))]).astype(np.float32)


def compare(got, links, label):
    got = {r.vec_id: r for r in got}
    assert len(got) == len(label)
    assert all(got[i].n_links <= links[i] for i in got)
    found = sum(got[i].n_links for i in got)
    assert found >= 0.99 * links.sum()
    assert sum(got[i].component_id == label[i] for i in got) >= 0.99 * len(label)
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_against_brute_force(spark, monkeypatch):
    from lociframe.llm import embedding

    monkeypatch.setattr(embedding, "LEAF", 64)
    x = planted(np.random.default_rng(4), 2500)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<float>, node string").repartition(4)
    compare(near_duplicate_vectors(df).collect(), *brute(x.astype(float)))


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, -0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-30, 0.0]), (None, [5.0, 0.1]), (None, [0.0, 3.0]), (1, [1.0, 0.0]), (12, [-1.0, 0.0])]
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    seen = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got), key=str)
    want = [(1, 5, 1, True)] * 2 + [(i, 5, 1, False) for i in (2, 3, 11, 0)] + [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 12)] + [(0, 0, None, True)]
    assert seen == sorted(want, key=str)
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    got = op2_projection_forest_dedup(spark, sf).collect()
    links, label = brute(np.array([r.embedding for r in rows], float))
    ids = [r.vec_id for r in rows]
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {k: (n, ids[c]) for k, n, c in zip(ids, links, label)}


def test_leaves_are_split_until_small(spark):
    """Rounds of splits beyond the first sample; a dense group that no split parts is compared in blocks."""
    x = planted(np.random.default_rng(9), 2500)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    compare(near_duplicate_vectors(df, leaf=24, sample=300, leaf_sample=150).collect(), *brute(x.astype(float)))


def test_recall_of_deep_trees():
    """Pairs at the threshold, trees of twelve levels and more."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(24_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.normal(size=(2000, 64))
    other -= (other * x[:2000]).sum(axis=1, keepdims=True) * x[:2000]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cos = rng.uniform(0.95, 0.96, (2000, 1))
    near = cos * x[:2000] + np.sqrt(1 - cos**2) * other
    forest = Forest(x, len(x), leaf=6, least=3)
    depth = lambda t, k=0: 1 + max(depth(t, c) if c >= 0 else 0 for c in (t.left[k], t.right[k]))
    assert min(depth(t) for t in forest.trees) >= 12 and len(forest.trees) == TREES and SPILL > 0
    here, there = forest.route(x[:2000]), forest.route(near)
    assert np.mean([bool(set(a) & set(b)) for a, b in zip(here, there)]) >= 0.99


def test_pairs_of_earlier_leaves_are_left_out():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(150, 8)), np.ones((150, 8)) + rng.normal(size=(150, 8)) * 0.1])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    member = (rng.random((300, 12)) < 0.1).astype(np.float32)
    member[rng.random(300) < 0.8, 3] = 1
    want = (x @ x.T >= 0.95) & ~(member @ member.T > 0)
    np.fill_diagonal(want, False)
    got = np.zeros((300, 300), int)
    for i, j in new_links(x, member, np.arange(300), np.arange(300)):
        np.add.at(got, (i, j), 1)
    assert (got == want).all()
    assert grow_tree(np.ones((40, 8)), 5, rng, 0)[1] == 1 and isinstance(grow_tree(x, 2, rng, 0)[0], Tree)
