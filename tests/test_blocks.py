"""Dense blocks with halos, and grain boundaries that meet them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain.operators import blocks, erosion, grids, raster, stencils, voronoi
from voxelgrain.operators import seeds as sd

SHAPES = [((20, 7, 33), (1, 1, 1)), ((5, 5, 5), (2, 7, 1)), ((40, 40, 40), (2, 2, 2)), ((17, 3, 64), (0, 4, 0))]


def image(spark, array):
    rows = [(int(i), int(j), int(k), int(v)) for (i, j, k), v in np.ndenumerate(array)]
    return spark.createDataFrame(rows, "i int, j int, k int, v long").repartition(3)


@pytest.mark.parametrize(("shape", "pad"), SHAPES)
def test_windows_hold_the_wrapped_image(spark, shape, pad):
    array = np.random.default_rng(1).integers(0, 1000, shape)

    def kernel(w):
        out = np.zeros(w.size, np.int64)
        for n, offset in enumerate([(-pad[0], pad[1], 0), (pad[0], -pad[1], -pad[2]), (0, 0, pad[2])]):
            values, there = w.at(offset)
            assert there.all()
            out += values * (n + 1)
        return {"out": out}

    got = blocks.over_blocks(image(spark, array), blocks.Blocks(shape, pad), "v", "<i8", kernel, "out long").collect()
    at = lambda o: np.roll(array, [-x for x in o], axis=(0, 1, 2))
    want = at((-pad[0], pad[1], 0)) + 2 * at((pad[0], -pad[1], -pad[2])) + 3 * at((0, 0, pad[2]))
    assert len(got) == array.size and all(want[r["i"], r["j"], r["k"]] == r["out"] for r in got)


@pytest.mark.parametrize("pad", [1, 2, 4])
def test_a_voxel_is_sent_a_bounded_number_of_times(spark, pad):
    shape = (64, 64, 64)
    own = blocks.Blocks(shape, (pad,) * 3)
    voxels = grids.voxel_grid(spark, shape).withColumn("v", F.col("i"))
    sent = blocks.dealt(voxels, own, "v", "<i8").agg(F.sum(F.octet_length("places") / 4)).first()[0]
    assert sent == 64**3 * np.prod([(b + 2 * pad) / b for b in own.edge])
    assert sent <= 64**3 * 2 and own.edge[0] >= 8 * pad


def test_images_with_holes(spark):
    array = np.random.default_rng(2).integers(0, 5, (9, 9, 9))
    frame = image(spark, array).where("(i + j + k) % 4 > 0")
    there = np.fromfunction(lambda i, j, k: (i + j + k) % 4 > 0, array.shape)
    offsets = stencils.octahedron_offsets(2)
    got = {(r["i"], r["j"], r["k"]): r["v"] for r in stencils.median_filter(frame, array.shape, offsets, "v").collect()}
    assert len(got) == there.sum()
    for (i, j, k), found in list(got.items())[::7]:
        near = sorted(array[p] for o in offsets if there[p := ((i + o[0]) % 9, (j + o[1]) % 9, (k + o[2]) % 9)])
        assert found == (near[len(offsets) // 2] if len(near) > len(offsets) // 2 else None)
    assert stencils.laplacian(frame, array.shape, "v").count() == there.sum()
    assert stencils.median_filter(frame.limit(0), array.shape, offsets, "v").count() == 0


def test_median_of_doubles(spark):
    array = np.random.default_rng(3).random((6, 6, 6))
    frame = spark.createDataFrame([(*map(int, at), float(v)) for at, v in np.ndenumerate(array) for at in [at]], "i int, j int, k int, v double")
    offsets = stencils.box_offsets(3)
    want = np.sort(np.stack([np.roll(array, o, axis=(0, 1, 2)) for o in offsets]), axis=0)[len(offsets) // 2]
    assert all(r["v"] == want[r["i"], r["j"], r["k"]] for r in stencils.median_filter(frame, array.shape, offsets, "v").collect())


def test_large_crystals_are_many_tasks_work(spark):
    """Eight crystals: what tasks get follows blocks of voxels, not crystals."""
    shape, lengths = (96, 96, 96), (1.0, 1.0, 1.0)
    seeds = sd.voronoi_seeds(spark, 8, lengths, "random", 3)
    faces = erosion.canonical_faces(voronoi.tessellate(seeds)).withColumnRenamed("seed_a", "seed_id").join(seeds, "seed_id")
    placed = voronoi.shifted(faces.select("gb", F.col("seed_id").alias("crystal"), "nx", "ny", "nz", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), "verts"), ["px", "py", "pz"])
    placed = placed.withColumn("verts", F.transform("verts", lambda p: F.struct(*[(p[c] + F.col(f"s{c}")).alias(c) for c in "xyz"])))
    own = blocks.Blocks(shape)
    voxels = blocks.dealt(raster.label_nearest_seed(grids.voxel_grid(spark, shape), seeds, shape), own, "label", "<i8").select("block", F.octet_length("values").alias("n"))
    near = erosion.faces_by_block(placed, own, lengths, 8 / 256).select("block", F.octet_length("data").alias("n"))
    tasks = sorted(r["n"] for r in voxels.unionByName(near).repartition(8, "block").groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect())
    assert len(tasks) == 8 and tasks[-1] < 2 * np.median(tasks)


def test_tiny_faces_hold_no_far_points():
    tiny = np.array([[0.3, 0, 0], [0.3, 1e-7, 0], [0.3, 1e-7, 1e-6], [0.3, 0, 1e-6]])
    face = erosion.Face(np.array([4, 2, 1, 0, 0, 0, 0, 0, *tiny.ravel()], ">f8").tobytes())
    points = [np.array([0.2, 0.2, 0.2, -0.2, 0.31]), np.array([0.5e-7, 0.1, 0.5e-7, -0.5e-7, 0.5e-7]), np.array([5e-7, 0.1, 3e-6, -5e-7, 5e-7])]
    assert face.holds(points).tolist() == [True, False, False, False, False]


@pytest.mark.parametrize("seed", [1, 7])
def test_array_faces_are_the_column_expressions(spark, seed):
    """``Face`` and the column functions say the same of random points."""
    seeds = sd.voronoi_seeds(spark, 5, (1.0, 1.0, 1.0), "random", seed)
    rows = voronoi.tessellate(seeds).join(seeds.withColumnRenamed("seed_id", "seed_a"), "seed_a").limit(12).collect()
    rng = np.random.default_rng(seed)
    for r in rows:
        q = rng.random((60, 3)) * 0.8 + np.array([r["x"], r["y"], r["z"]]) - 0.4
        verts = [[p["x"], p["y"], p["z"]] for p in r["verts"]]
        face = erosion.Face(np.array([0, 0, r["nx"], r["ny"], r["nz"], r["x"], r["y"], r["z"], *np.ravel(verts)], ">f8").tobytes())
        frame = spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(q)], "n int, a double, b double, c double")
        at, lit = [F.col(c) for c in "abc"], lambda values: [F.lit(float(v)) for v in values]
        loop = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(p, "xyz", strict=True)]) for p in verts])
        normal = lit([r["nx"], r["ny"], r["nz"]])
        band = erosion.plane_band(at, lit(verts[0]), normal, 0.3) & erosion.in_polygon(at, loop, normal)
        got = frame.select("n", band.alias("band"), erosion.in_pyramid(at, lit([r["x"], r["y"], r["z"]]), loop).alias("held")).orderBy("n").collect()
        assert [g["band"] for g in got] == face.covers(list(q.T), 0.3).tolist() and [g["held"] for g in got] == face.holds(list(q.T)).tolist()


def test_blocks_get_only_faces_of_crystals_that_they_hold(spark):
    """Many more seeds than voxels: a block's faces are bounded by its voxels, not by the seeds."""
    shape, lengths = (4, 4, 4), (1.0, 1.0, 1.0)
    seeds = sd.voronoi_seeds(spark, 400, lengths, "random", 4)
    own = blocks.Blocks(shape)
    held = erosion.crystals_by_block(raster.label_nearest_seed(grids.voxel_grid(spark, shape), seeds, shape), own)
    faces = erosion.canonical_faces(voronoi.tessellate(seeds)).withColumnRenamed("seed_a", "seed_id").join(seeds, "seed_id")
    placed = faces.select("gb", F.col("seed_id").alias("crystal"), "nx", "ny", "nz", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), "verts")
    near = {erosion.Face(r["data"]).crystal for r in erosion.faces_by_block(placed, own, lengths, 0.02, held).collect()}
    assert near and near <= {r["crystal"] for r in held.collect()} and len(near) <= 64
