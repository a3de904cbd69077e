"""Nearest neighbours against brute force."""

import numpy as np

from terrascore.llm import neighbours
from terrascore.llm.registry import QUERIES


def brute(ids, x, k, every=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = np.zeros(len(x))
        for d in range(x.shape[1]):
            score += x[i, d] * x[:, d]
        others = np.flatnonzero(ids != ids[i])
        best = others[np.lexsort((ids[others], -score[others]))][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in best]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def vectors(spark, ids, x, extra=()):
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as list")


def test_recall_on_clusters_with_a_hot_group(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((3000, 24))
    x[:1000] = x[0] + 0.05 * r.standard_normal((1000, 24))  # a third lies close together
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = r.permutation(3000)
    got, want = found(neighbours.nearest(vectors(spark, ids, x)).collect()), brute(ids, x, 20)
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    assert recall(got, want) >= 0.9
    for q, w in want.items():
        known = dict(w)
        assert all(abs(s - known[i]) < 1e-12 for i, s in got[q] if i in known)


def test_equal_vectors_and_rows_that_take_no_part(spark):
    x = np.array([[1.0, 0.3, 0.1]] * 45)
    x[40:] = [-1.0, 0.2, 0.3]
    odd = [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 0.0]), (160, [1.0, float("nan"), 0.0]), (180, [float("inf"), 0.0, 0.0]),
           (None, [9.0, 9.0, 9.0]), (200, [1.0]), (0, [1.0, 0.3, 0.1])]
    got = found(neighbours.nearest(vectors(spark, np.arange(45), x, odd)).collect())
    assert got.keys() == {0, 20, 40}
    assert [i for i, _ in got[0]] == list(range(1, 21)) and len({s for _, s in got[0]}) == 1
    assert [i for i, _ in got[20]] == list(range(20))


def test_few_rows(spark):
    x = np.eye(3)
    got = found(neighbours.nearest(vectors(spark, [0, 1, 2], x)).collect())
    assert {q: [i for i, _ in g] for q, g in got.items()} == {0: [1, 2]}
    assert neighbours.nearest(vectors(spark, [0], x[:1])).collect() == []
    assert neighbours.nearest(vectors(spark, [0], x[:1]).where("false")).collect() == []
    assert neighbours.nearest(vectors(spark, [1, 3], x[:2])).collect() == []


def test_walk_finds_the_nearest_centroid():
    r = np.random.default_rng(1)
    x = r.standard_normal((2000, 16)).astype(np.float32)
    index = neighbours.build_index(x, 40_000, 10)
    assert len(index.centroids) == 200
    opened, seen = index.walk(x[:200], 1.1, 4)
    near = neighbours.squared(x[:200], index.centroids).argmin(axis=1)
    assert np.mean(seen.argmin(axis=1) == near) >= 0.9 and opened[np.arange(200), near].mean() >= 0.9
    counts = np.bincount(neighbours.squared(x, index.centroids).argmin(axis=1), minlength=200)
    assert counts.max() <= 6 * counts.mean()


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float32).astype(float)
    got, want = found(QUERIES["op1_nearest_vectors"](spark, sf).collect()), brute(ids, x, 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
