"""Points equal within a tolerance against a brute-force union-find."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain.operators import merging, voronoi
from voxelgrain.operators import seeds as sd


def union_find(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(k) for k in range(n)]


@pytest.mark.parametrize("kind", ["path", "star", "random", "clique"])
def test_components_of_graphs(spark, kind):
    rng = random.Random(4)
    n = 400
    pairs = {
        "path": [(k, k + 1) for k in range(n - 1)],
        "star": [(0, k) for k in range(1, n)] + [(k, k) for k in range(3)],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(260)],
        "clique": [(a, b) for a in range(0, n, 20) for b in range(a)][:3000],
    }[kind]
    ids = rng.sample(range(10**6), n)
    ids.sort()
    got = {r["id"]: r["root"] for r in merging.connected_components(spark.createDataFrame([(ids[a], ids[b]) for a, b in pairs], "a long, b long")).collect()}
    want = union_find(n, pairs)
    inside = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {ids[k]: ids[want[k]] for k in inside}


def test_no_edges_have_no_components(spark):
    assert merging.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("dimensions", [3, 6])
def test_jittered_points_merge_as_by_brute_force(spark, dimensions):
    rng = np.random.default_rng(5)
    tolerance = 1e-4
    # places on the borders of rounding and of bins, copies with jitter, chains, and points just too far
    places = np.round(rng.random((60, dimensions)), 2) + rng.choice([0, 0.5e-4, 16e-4], (60, dimensions))
    points = np.concatenate([places + rng.uniform(-0.45, 0.45, places.shape) * tolerance for _ in range(5)])
    chain = np.tile(rng.random(dimensions), (30, 1)) + np.arange(30)[:, None] * 0.9 * tolerance
    apart = np.tile(rng.random(dimensions), (20, 1)) + np.arange(20)[:, None] * 1.1 * tolerance
    points = np.concatenate([points, chain, apart, points[:10]])
    names = [f"v{k}" for k in range(dimensions)]
    frame = spark.createDataFrame([tuple(map(float, p)) for p in points], ", ".join(f"{n} double" for n in names))
    got = {tuple(r[n] for n in names): r["_root"] for r in merging.merged(frame, names, tolerance).collect()}
    distinct = np.unique(points, axis=0)
    near = np.abs(distinct[:, None] - distinct[None]).max(axis=2) <= tolerance
    want = union_find(len(distinct), np.argwhere(near).tolist())
    assert got == {tuple(p): want[k] for k, p in enumerate(distinct.tolist())}
    assert len(set(want)) < 60 + 1 + 20 + 1


def test_jittered_corners_are_one_vertex(spark):
    faces = voronoi.tessellate(sd.voronoi_seeds(spark, 8, (1.0, 1.0, 1.0), "rubiks-cube"))
    shaken = faces.withColumn("verts", F.transform("verts", lambda p: F.struct(*[(p[c] + (F.rand(3) - 0.5) * 4e-10).alias(c) for c in "xyz"])))
    for frame in (faces, shaken):
        table = voronoi.vertex_table(frame).collect()
        assert sorted(r["vertex"] for r in table) == list(range(len(table))) and len(table) == 27
    edges = voronoi.distinct_edges(voronoi.face_edges(shaken))
    assert edges.count() == voronoi.distinct_edges(voronoi.face_edges(faces)).count()
