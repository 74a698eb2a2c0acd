"""Vectors whose shards are divided again, repeated and null ids, clashing columns."""

import numpy as np

from mediaspan.llm import vector_graph


def pairs_apart(n, size, cosine, seed):
    """``n`` pairs at ``cosine``, all else far apart."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.normal(size=(n, size)))
    t = rng.normal(size=(n, size))
    t = unit(t - (t * a).sum(1, keepdims=True) * a)
    return np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * t])


def test_links_in_divided_shards(spark, monkeypatch):
    """Few centres and small shards, so that all shards are divided, and no vector is close to a centre: recall by the ids that 20 divides and by all pairs."""
    monkeypatch.setattr(vector_graph, "SHARD", 60)
    monkeypatch.setattr(vector_graph, "CENTRES", 8)
    monkeypatch.setattr(vector_graph.centres, "__defaults__", (2_000, 8))
    x = pairs_apart(1_500, 64, 0.92, 5)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found = vector_graph.near_vectors(rows).cache()
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert len(got) == 3_000 and all(n <= near[k].sum() for k, (n, _) in got.items())
    assert sum(n for n, _ in got.values()) >= 0.99 * near.sum()
    assert vector_graph.recall(rows, found) >= 0.99
    assert sum(got[k + 1_500][1] == k for k in range(1_500)) >= 0.99 * 1_500


def test_one_row_for_each_row(spark):
    """Repeated ids are vectors of their own; rows without an id or a vector stay, linked with nothing; other columns with the names used inside don't matter."""
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    data = [(1, v), (1, w), (2, v), (None, v), (3, None), (None, None), (4, [0.0, 0.0, 0.0]), (5, [0.0, 0.99, 0.1])]
    rows = spark.createDataFrame([(i, x, 7, "x", [1]) for i, x in data], "vec_id long, embedding array<double>, first int, v string, shard array<int>")
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vector_graph.near_vectors(rows).collect()), key=repr)
    want = [(False, 1, 1, 1, True), (False, 1, 1, 1, True), (False, 2, 1, 1, False), (False, 3, 0, 3, True), (False, 4, 0, 4, True), (False, 5, 1, 1, False), (True, 0, 0, None, True), (True, 0, 0, None, True)]
    assert got == sorted(want, key=repr)
    none = vector_graph.near_vectors(rows.where("vec_id is null or vec_id in (3, 4)")).collect()
    assert len(none) == 4 and all(r.n_links == 0 and r.kept for r in none)
