"""Dimension-sharded Lloyd against plain whole-number Lloyd in numpy."""

import hashlib
import math
import random

import numpy as np
import pytest

from terrascore.llm import clusters
from terrascore.llm.registry import QUERIES


def by_brute_force(rows, k=8, rounds=10, scale=1024):
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return {}
    x = np.array([v for _, v in kept], np.int64)
    order = sorted(range(len(kept)), key=lambda n: (
        kept[n][0] is None, hashlib.sha256(f"3:{kept[n][0]}".encode()).hexdigest(), kept[n][1]))
    centres = x[order[:k]]

    def assign():
        away = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        return away.argmin(axis=1), away.min(axis=1)

    for _ in range(rounds):
        near, _d = assign()
        centres = np.array([x[near == j].sum(axis=0) // (near == j).sum() if (near == j).any() else c for j, c in enumerate(centres)])
    near, away = assign()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    out = [(i, int(n), int(d), int(away[near == n].sum()), int(away.sum()), digest[n]) for (i, _), n, d in zip(kept, near, away, strict=True)]
    return sorted(out, key=repr)


def vectors_of(spark, rows, extra=""):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return frame.selectExpr("*", *[f"'x' as `{n}`" for n in extra.split()])


def run(spark, frame, **tables):
    return sorted((tuple(r) for r in QUERIES["op11_cluster_vectors"](spark, frame(**tables)).collect()), key=repr)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = QUERIES["op11_cluster_vectors"](spark, sf)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_brute_force(rows)


def test_odd_rows_ties_and_a_common_vector(spark, frame):
    r = random.Random(3)
    rows = [(i, [r.choice([-1.0, 0.0, 0.25, 3.5]) + 40 * (i % 3) for _ in range(64)]) for i in range(90)]
    rows += [(200 + i, [0.5] * 64) for i in range(60)]  # one vector is many rows
    rows += [(7, [1e5] * 64), (7, [-1e5] * 64), (7, [0.1] * 64), (None, [9.0] * 64)]  # repeated and missing ids
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [float("nan")] * 64),
             (305, [float("inf")] + [0.0] * 63), (306, [None] + [0.0] * 63)]
    got = run(spark, frame, embeddings=vectors_of(spark, rows, "cluster distance id x chunk block keys"))
    assert got == by_brute_force(rows)


def test_few_and_no_vectors(spark, frame):
    few = [(1, [1.0] * 64), (2, [1.0] * 64), (3, [-2.0] * 64)]
    assert run(spark, frame, embeddings=vectors_of(spark, few)) == by_brute_force(few)
    assert run(spark, frame, embeddings=vectors_of(spark, [(1, [1.0]), (2, None)])) == []


def test_components_out_of_range_are_held(spark):
    rows, centres = clusters.cluster_vectors(vectors_of(spark, [(1, [1e300] * 64), (2, [-1e300] * 64)]), clusters=1)
    assert {r["distance"] for r in rows.collect()} == {64 * (1 << 54)}
    assert {r["value"] for r in centres.collect()} == {0}


@pytest.mark.parametrize("width", [7, 64])
def test_any_width_of_blocks(spark, width):
    r = random.Random(width)
    rows = [(i, [r.gauss(i % 4, 0.4) for _ in range(64)]) for i in range(120)]
    got, _ = clusters.cluster_vectors(vectors_of(spark, rows), width=width, rounds=3)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()) == sorted(x[:3] for x in by_brute_force(rows, rounds=3))
    assert "clusters_" not in " ".join(t.name for t in spark.catalog.listTables())
