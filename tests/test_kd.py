"""k-d blocks: even counts on clustered seeds, with the labels and faces of the other ways."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain.operators import grids, kd, raster, voronoi


def clustered(n, lengths, share=0.9, seed=1):
    """Nine in ten seeds in a corner of a hundredth of the box."""
    rng = np.random.default_rng(seed)
    points = rng.random((n, len(lengths)))
    points[: int(n * share)] *= 0.01 ** (1 / len(lengths))
    return points * np.array(lengths)


def frame(spark, points):
    rows = [(k, *map(float, p), *[0.0] * (3 - len(p))) for k, p in enumerate(points)]
    return spark.createDataFrame(rows, "seed_id int, x double, y double, z double").repartition(4)


def test_blocks_are_even_on_clusters(spark):
    points = clustered(60_000, (1.0, 1.0, 1.0))
    tree = kd.kd_tree(frame(spark, points), (1.0, 1.0, 1.0), 512)
    counts = np.bincount(tree.leaf(points), minlength=1 << tree.depth)
    assert counts.sum() == len(points) and counts.max() < 3 * np.median(counts)
    assert len(tree.points) <= 2 * kd.GUARDS << tree.depth


def test_balls_reach_all_leaves_that_hold_points_in_them():
    rng = np.random.default_rng(5)
    points, box = clustered(3000, (1.0, 2.0, 0.5)), np.array([1.0, 2.0, 0.5])
    tree = kd.KdTree(points[::7], np.arange(len(points))[::7], box, 6)
    at, r2 = rng.random((40, 3)) * box, rng.random(40) * 0.1
    reached = set(zip(*[c.tolist() if c.ndim == 1 else map(tuple, c.tolist()) for c in tree.reached(at, r2)], strict=True))
    leaf = tree.leaf(points)
    for shift in tree.shifts:
        n, k = np.nonzero((((points + shift * box)[None] - at[:, None]) ** 2).sum(axis=2) <= r2[:, None])
        assert {(i, leaf[j], tuple(shift.tolist())) for i, j in zip(n.tolist(), k.tolist(), strict=True)} <= reached


@pytest.mark.parametrize("same", [False, True])
def test_nearest_of_a_tree(same):
    rng = np.random.default_rng(6)
    points = np.full((50, 3), 0.25) if same else np.round(rng.random((500, 3)), 1)
    tree = kd.KdTree(points, np.arange(len(points))[::-1].copy(), (1.0, 1.0, 1.0), 4)
    at = rng.random((300, 3))
    each = np.round(((at[:, None] - points) ** 2).sum(axis=2), 9)
    d2, ids = tree.nearest(at, 9, chunk=64)
    assert (d2 == each.min(axis=1)).all()
    # equally near ones: the smallest id
    assert all(ids[k] == min(len(points) - 1 - np.flatnonzero(each[k] == d2[k])) for k in range(len(at)))


@pytest.mark.parametrize(("n", "block", "lengths"), [(1, 4, (1.0, 1.0, 1.0)), (2000, 64, (1.0, 1.0, 1.0)), (1500, 100, (1.0, 2.0, 0.5))])
def test_labels_on_clusters(spark, n, block, lengths):
    points, shape, box = clustered(n, lengths), (16, 12, 10), np.array(lengths)
    at = np.stack(np.meshgrid(*[(np.arange(m) + 0.5) * length / m for m, length in zip(shape, lengths, strict=True)], indexing="ij"), axis=-1).reshape(-1, 3)
    d = at[:, None] - points
    d -= box * np.rint(d / box)
    want = np.round((d * d).sum(axis=2), 9).argmin(axis=1).reshape(shape)
    voxels = grids.voxel_grid(spark, shape).withColumn("extra", F.col("i") * 2)
    got = raster.nearest_by_blocks(voxels, frame(spark, points), shape, lengths, block).collect()
    assert len(got) == want.size and all(want[r["i"], r["j"], r["k"]] == r["label"] and r["extra"] == 2 * r["i"] for r in got)


def test_labels_of_no_voxels_and_no_seeds(spark):
    shape = (4, 4, 4)
    seeds = frame(spark, clustered(20, (1.0, 1.0, 1.0)))
    assert raster.nearest_by_blocks(grids.voxel_grid(spark, shape).limit(0), seeds, shape, block=4).count() == 0
    with pytest.raises(ValueError, match="no seeds"):
        raster.nearest_by_blocks(grids.voxel_grid(spark, shape), seeds.limit(0), shape)


@pytest.mark.parametrize(("n", "block", "lengths"), [(1, 4, (1.0, 1.0, 1.0)), (300, 32, (1.0, 1.0, 1.0)), (200, 16, (1.0, 2.0, 0.7)), (300, 20, (1.0, 0.5))])
def test_faces_on_clusters(spark, n, block, lengths):
    seeds = frame(spark, clustered(n, lengths)).cache()
    keys = ["seed_a", "seed_b", "ox", "oy", "oz"]
    rows = lambda faces: {tuple(r[k] for k in keys): (r["area"], r["distance"]) for r in faces.collect()}
    one, two = rows(voronoi.tessellate(seeds, lengths)), rows(voronoi.tessellate_blocks(seeds, lengths, block))
    big = lambda faces: {k for k, v in faces.items() if v[0] > 1e-9}
    assert big(one) == big(two) and all(np.allclose(one[k], two[k]) for k in big(one))


def test_tasks_are_even_and_cells_whole_on_clusters(spark):
    """Cells fill the box; no block is visited by several times as many cells as the median one."""
    points, box = clustered(800, (1.0, 1.0, 1.0)), (1.0, 1.0, 1.0)
    seeds = frame(spark, points)
    tree = kd.kd_tree(seeds, box, 100)
    started = voronoi._dealt(seeds.withColumn("seed_id", F.col("seed_id").cast("long")), tree).repartition(8, "leaf").groupBy("leaf").applyInArrow(voronoi._own_kernel(tree, 1.0), voronoi._OPEN)
    visits = [r["count"] for r in started.where("leaf is not null").groupBy("leaf").count().collect()]
    assert max(visits) < 3 * np.median(visits) and sum(visits) < 6 * len(points)
    volumes = voronoi.cell_volumes(voronoi.tessellate_blocks(seeds, box, 100)).agg(F.sum("volume"), F.count("*")).first()
    assert volumes[1] == len(points) and abs(volumes[0] - 1) < 1e-6


def test_no_seeds_have_no_faces(spark):
    assert voronoi.tessellate_blocks(frame(spark, clustered(5, (1.0, 1.0, 1.0))).limit(0)).count() == 0


def test_cells_clipped_side_by_side_take_little_time_and_fill_the_box():
    """Clusters and lattices (corners of more than three faces) too; one at a time, a cell took some 12 ms."""
    import time

    rng = np.random.default_rng(3)
    lattice = np.stack(np.meshgrid(*[np.arange(6) / 6] * 3), axis=-1).reshape(-1, 3)
    for points, faces in ((rng.random((3000, 3)), None), (np.concatenate([rng.random((300, 3)), 0.3 + rng.random((900, 3)) / 20]), None), (np.concatenate([lattice, lattice + 1 / 12]), 14)):
        binned, ids, left, reach = voronoi._Binned(points, np.arange(len(points)), np.ones(3)), np.arange(len(points)), np.arange(len(points)), 3
        volume, found, start = 0.0, 0, time.perf_counter()
        while len(left):
            far = []
            for i, j, cell, ghosts, others, offsets in binned.about(points[left], reach):
                own = left[i:j]
                batch, needed = voronoi._face_rows(ids[own], points[own], cell, ghosts, others, offsets, 1.0)
                again = np.zeros(j - i, bool) if binned.whole(reach) else needed > reach * binned.size.min()
                whole = ~np.isin(batch.column(0).to_numpy(), own[again])
                volume += float((batch.column(8).to_numpy() * batch.column(9).to_numpy())[whole].sum() / 6)
                found += int(whole.sum())
                far += (i + np.flatnonzero(again)).tolist()
            left, reach = left[far], reach + 2
        assert abs(volume - 1) < 1e-9 and (faces is None or found == faces * len(points))
        assert (time.perf_counter() - start) / len(points) < 8e-3
