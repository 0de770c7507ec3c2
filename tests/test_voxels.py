"""Tessellations, grain boundaries, coarse-graining, stencils and spectra: invariants and brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain.operators import combo, erosion, grids, order, raster, spectral, stencils, voronoi
from voxelgrain.operators import seeds as sd
from voxelgrain.operators.fractions import quantile, volume_fractions

BOX = (1.0, 1.0, 1.0)


def image(spark, array):
    rows = [(*map(int, p), int(v)) for p, v in np.ndenumerate(array) for p in [p]]
    return spark.createDataFrame(rows, "i int, j int, k int, label int")


def dense(df, shape, column="label", kind=float):
    out = np.zeros(shape, kind)
    for r in df.collect():
        out[r["i"], r["j"], r["k"]] = r[column]
    return out


@pytest.fixture(scope="module")
def random_image():
    return np.random.default_rng(2).integers(0, 3, (8, 6, 4))


def brute_labels(shape, points, lengths):
    centres = np.stack(np.meshgrid(*[(np.arange(n) + 0.5) * length / n for n, length in zip(shape, lengths, strict=True)], indexing="ij"), axis=-1).reshape(-1, 3)
    d = centres[:, None] - points[None]
    d -= np.array(lengths) * np.rint(d / np.array(lengths))
    return np.round((d * d).sum(axis=2), 9).argmin(axis=1).reshape(shape)


@pytest.mark.parametrize(("n", "lengths"), [(1, BOX), (2, BOX), (40, BOX), (300, (1.0, 2.0, 0.5))])
def test_nearest_seed_by_both_ways(spark, n, lengths):
    seeds = sd.voronoi_seeds(spark, n, lengths, "random", 3)
    points = np.array([tuple(r)[1:] for r in seeds.orderBy("seed_id").select("seed_id", "x", "y", "z").collect()])
    shape = (9, 10, 8)
    grid = grids.voxel_grid(spark, shape)
    want = brute_labels(shape, points, lengths)
    assert (dense(raster.label_nearest_seed(grid, seeds, shape, lengths), shape, kind=int) == want).all()
    assert (dense(raster.nearest_by_blocks(grid, seeds, shape, lengths), shape, kind=int) == want).all()


@pytest.mark.parametrize(("method", "n"), [("random", 1), ("diamond", 2), ("random", 40), ("rubiks-cube", 27), ("honeycomb", 12)])
def test_tessellations(spark, method, n):
    box = (1.0, 1.0, 1.0)
    faces = voronoi.tessellate(sd.voronoi_seeds(spark, n, box, method, 6), box).cache()
    volumes = [r["volume"] for r in voronoi.cell_volumes(faces).collect()]
    assert len(volumes) == n and abs(sum(volumes) - 1) < 1e-9
    if method == "rubiks-cube":
        assert np.allclose(volumes, 1 / 27) and faces.count() == 27 * 6
    closed = faces.groupBy("seed_a").agg(*[F.abs(F.sum(F.col("area") * F.col(c))).alias(c) for c in ("nx", "ny", "nz")])
    assert closed.where("nx > 1e-9 or ny > 1e-9 or nz > 1e-9").count() == 0
    pairs = {(r["seed_id"], b) for r in voronoi.neighbours(faces).collect() for b in r["neighbours"]}
    assert pairs == {(b, a) for a, b in pairs}
    assert voronoi.unique_faces(faces).count() * 2 == faces.count()
    one, all_places = (voronoi.interface_measures(faces, c).first()[0] for c in ("unique", "reference"))
    assert 0 < one <= all_places
    trace = voronoi.structure_tensor(voronoi.unique_faces(faces)).where("a = b").agg(F.sum("value")).first()[0]
    assert abs(trace - one) < 1e-9


def test_face_areas_by_columns(spark):
    faces = voronoi.tessellate(sd.voronoi_seeds(spark, 20, BOX, "random", 2))
    area = voronoi.polygon_area_column(F.col("verts"), [F.col("nx"), F.col("ny"), F.col("nz")])
    assert faces.select(F.max(F.abs(area - F.col("area")))).first()[0] < 1e-9


def test_erosion_of_two_slabs(spark):
    seeds = spark.createDataFrame([(0, 0.25, 0.5, 0.5), (1, 0.75, 0.5, 0.5)], "seed_id int, x double, y double, z double")
    shape, t = (20, 4, 4), 0.2
    voxels = raster.label_nearest_seed(grids.voxel_grid(spark, shape), seeds, shape)
    out, table = erosion.erode_boundaries(voxels, voronoi.tessellate(seeds), seeds, shape, thickness=t)
    got = dense(out, shape, kind=int)
    x = (np.arange(20) + 0.5) / 20
    near = np.minimum.reduce([np.abs(x - p) for p in (0.0, 0.5, 1.0)]) <= t / 2
    inside = np.broadcast_to(np.where(x < 0.5, 0, 1)[:, None, None], got.shape)
    band = np.broadcast_to(near[:, None, None], got.shape)
    assert ((got >= 2) == band).all() and (got[~band] == inside[~band]).all()
    # corners lie in the pyramids over the faces between a crystal and its own images; the rest belongs to the two crystals
    between = table.where("crystal_a <> crystal_b").collect()
    assert len(between) == 1 and abs(between[0]["nx"]) == 1 and (got == between[0]["gb_tag"]).sum() > band.sum() / 2
    normals = dense(erosion.boundary_normals(out, table), shape, "nx")
    assert (np.abs(normals) == (got == between[0]["gb_tag"])).all()
    assert '"2"' in erosion.boundary_json(table).first()[0]


def test_erosion_of_random_cells(spark):
    n, shape = 10, (16, 16, 16)
    seeds = sd.voronoi_seeds(spark, n, BOX, "random", 9)
    voxels = raster.label_nearest_seed(grids.voxel_grid(spark, shape), seeds, shape)
    out, table = erosion.erode_boundaries(voxels, voronoi.tessellate(seeds), seeds, shape, thickness=0.1)
    out = out.cache()
    assert out.count() == 16**3 and out.where("label < -1").count() == 0
    tags = sorted({r["label"] for r in out.where(f"label >= {n}").collect()})
    assert tags == sorted(r["gb_tag"] for r in table.collect()) and tags == list(range(n, n + len(tags)))
    assert out.where(f"label between 0 and {n - 1} and label <> crystal").count() == 0
    # every voxel nearly as close to a second seed as to its own is eroded, none that is much closer is
    points = np.array([tuple(r)[1:] for r in seeds.orderBy("seed_id").select("seed_id", "x", "y", "z").collect()])
    centres = np.stack(np.meshgrid(*[(np.arange(16) + 0.5) / 16] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    ghosts = np.concatenate([points + o for o in itertools.product((-1, 0, 1), repeat=3)])
    d = np.sort(np.sqrt(((centres[:, None] - ghosts[None]) ** 2).sum(axis=2)), axis=1)
    got = dense(out, shape, kind=int).ravel()
    assert not ((d[:, 1] - d[:, 0] > 0.101) & (got >= n) & (d[:, 1] - d[:, 0] > 0.25)).any()
    assert (got >= n).mean() > 0.1


def test_half_polyhedra(spark):
    """Pyramids over the faces of a cell fill it, and hold nothing beyond their base."""
    corners = [(x, y, z) for x, y, z in ((1, -1, -1), (1, 1, -1), (1, 1, 1), (1, -1, 1))]
    verts = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for c, v in zip("xyz", p)]) for p in corners])
    points = [(0.9, 0.1, 0.2), (1.1, 0.1, 0.2), (0.5, 0.6, 0.0), (0.2, 0.0, 0.1), (-0.5, 0.1, 0.1), (1.0, 1.0, 1.0)]
    frame = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in points], "x double, y double, z double")
    at, apex = [F.col(c) for c in "xyz"], [F.lit(0.0)] * 3
    got = [tuple(r) for r in frame.select(erosion.in_cone(at, apex, verts), erosion.in_pyramid(at, apex, verts)).collect()]
    assert got == [(True, True), (True, False), (False, False), (True, True), (False, False), (True, True)]


def test_tags_are_those_of_the_pyramids(spark):
    """Each eroded voxel's tag is the first boundary, by number, whose pyramid over a face of its cell holds it."""
    shape, t, n = (12, 12, 12), 0.12, 6
    seeds = sd.voronoi_seeds(spark, n, BOX, "random", 4)
    voxels = raster.label_nearest_seed(grids.voxel_grid(spark, shape), seeds, shape)
    faces = voronoi.tessellate(seeds).cache()
    out, table = erosion.erode_boundaries(voxels, faces, seeds, shape, thickness=t)
    between = {r["gb_tag"]: {r["crystal_a"], r["crystal_b"]} for r in table.collect()}
    points = {r["seed_id"]: np.array([r["x"], r["y"], r["z"]]) for r in seeds.collect()}
    cells = {}
    for f in faces.collect():
        cells.setdefault(f["seed_a"], []).append((f["seed_b"], np.array([[p["x"], p["y"], p["z"]] for p in f["verts"]])))
    right = wrong = 0
    for r in out.where(f"label >= {n}").collect():
        at = (np.array([r["i"], r["j"], r["k"]]) + 0.5) / 12
        seed = points[r["crystal"]]
        at = seed + (at - seed) - np.rint(at - seed)  # the voxel's place in its cell's frame
        holds = set()
        for other, verts in cells[r["crystal"]]:
            v, d = verts - seed, at - seed
            side = [np.dot(d, np.cross(v[k], v[(k + 1) % len(v)])) for k in range(len(v))]
            normal = np.cross(v[1] - v[0], v[2] - v[0])
            if (min(side) >= -1e-9 or max(side) <= 1e-9) and (d @ normal) * (v[0] @ normal) > 0:
                holds.add(other)
        if holds and holds & between[r["label"]]:
            right += 1
        else:
            wrong += 1
    assert right > 300 and wrong == 0


def test_foam_touches_cell_edges(spark):
    faces = voronoi.tessellate(sd.voronoi_seeds(spark, 8, BOX, "rubiks-cube"))
    stamped = voronoi.foam(spark, faces, (17, 17, 17), radius=0.07)
    exact = voronoi.foam(spark, faces, (17, 17, 17), radius=0.07, exact=True)
    a, b = dense(stamped, (17, 17, 17), kind=int), dense(exact, (17, 17, 17), kind=int)
    assert a.sum() > 0 and b.sum() > 0
    # the planes between the eight cubes lie at quarter and three quarters of each axis
    assert b[4, 4, :].all() and b[:, 12, 4].all() and not b[8, 8, 8]


@pytest.mark.parametrize("pure_only", [False, True])
def test_composites(spark, pure_only):
    array = np.zeros((8, 8, 8), int)
    array[:3] = 5
    blocks = combo.composite_voxels(image(spark, array), (8, 8, 8), (4, 4, 4)).cache()
    coarse = {(r["bi"], r["bj"], r["bk"]): r for r in blocks.collect()}
    assert coarse[0, 0, 0]["coarse"] == 5 and coarse[3, 3, 3]["coarse"] == 0 and coarse[1, 0, 0]["coarse"] == -2
    assert [tuple(p) for p in coarse[1, 2, 3]["phases"]] == [(0, 0.5), (5, 0.5)] and coarse[1, 2, 3]["elem"] == 1 * 16 + 2 * 4 + 3
    got = {r["label"]: r["fraction"] for r in combo.composite_fractions(blocks, pure_only).collect()}
    assert got == {0: 0.625, 5: 0.375}


def test_laminate_normals(spark):
    array = np.zeros((16, 8, 8), int)
    array[2:] = 1
    normals = combo.interface_normals(image(spark, array), (16, 8, 8), (4, 2, 2)).collect()
    # within the first blocks the larger label lies at greater x: the normal points to -x
    assert len(normals) == 4 and all(np.allclose(r["normal"], [-1, 0, 0]) for r in normals)


def block_normals(array, blocks, lengths, pad, min_fraction=0.0):
    """Normals block by block from the Laplacian of the whole image, in NumPy; wrapped windows."""
    shape = np.array(array.shape)
    h = np.array(lengths, float) / shape
    raw = np.array([h[1] * h[2] / h[0], h[0] * h[2] / h[1], h[0] * h[1] / h[2]])
    f = 3 / raw.sum()
    lap = 2 * f * raw.sum() * array.astype(float)
    for axis in range(3):
        lap -= f * raw[axis] * (np.roll(array, 1, axis) + np.roll(array, -1, axis))
    lap, size, found = np.abs(lap), shape // np.array(blocks), {}
    for b in itertools.product(*map(range, blocks)):
        own = np.ix_(*[np.arange(k * s, (k + 1) * s) for k, s in zip(b, size)])
        wide = np.ix_(*[np.arange(k * s - p, (k + 1) * s + p) % n for k, s, p, n in zip(b, size, pad, shape)])
        labels, counts = np.unique(array[own], return_counts=True)
        labels = labels[counts / counts.sum() >= min_fraction]
        if len(labels) != 2:
            continue
        window = wide if np.array_equal(np.unique(array[own]), np.unique(array[wide])) else own
        w, phase = lap[window], array[window] != labels[0]
        at = np.argwhere(w > 1e-5) * h
        weight = w[w > 1e-5] / w[w > 1e-5].sum()
        if not len(at):
            continue
        off = at - (at * weight[:, None]).sum(axis=0)
        values, vectors = np.linalg.eigh((off * weight[:, None]).T @ off)
        centre = ((np.argwhere(phase) + 0.5 - np.array(phase.shape) / 2) * h).mean(axis=0)
        normal = vectors[:, 0]
        found[b] = (-normal if normal @ centre > 0 else normal), values[1] - values[0], abs(normal @ centre)
    return found


@pytest.mark.parametrize(("pad", "min_fraction"), [((0, 0, 0), 0.0), ((2, 1, 0), 0.0), ((1, 1, 1), 0.1)])
def test_normals_against_numpy(spark, pad, min_fraction):
    shape, blocks, lengths = (16, 12, 8), (4, 3, 2), (1.0, 2.0, 0.5)
    x = np.stack(np.indices(shape), axis=-1) @ np.array([0.8, 0.5, 0.3])
    array = np.where(x < 9, 2, np.where(x < 14, 5, 9))
    want = block_normals(array, blocks, lengths, pad, min_fraction)
    out = combo.interface_normals(image(spark, array), shape, blocks, lengths, pad, min_fraction)
    got = {(r["bi"], r["bj"], r["bk"]): np.array(r["normal"]) for r in out.collect()}
    assert set(got) == set(want) and len(got) > 8
    for b, (normal, gap, side) in want.items():
        if gap > 1e-9:  # else any direction of a plane is one of least spread
            assert abs(abs(got[b] @ normal) - 1) < 1e-6
            if side > 1e-9:
                assert got[b] @ normal > 0


def test_normals_of_a_tilted_plane(spark):
    shape, direction = (32, 32, 32), np.array([0.6, 0.64, 0.48])
    array = ((np.stack(np.indices(shape), axis=-1) @ direction) > 27).astype(int)
    inner = [b for b in itertools.product(range(1, 3), repeat=3)]  # away from the image's own wrap
    out = combo.interface_normals(image(spark, array), shape, (4, 4, 4), pad=(2, 2, 2)).collect()
    angles = [np.degrees(np.arccos(min(abs(np.array(r["normal"]) @ direction), 1))) for r in out if (r["bi"], r["bj"], r["bk"]) in inner]
    assert len(angles) >= 4 and max(angles) < 7
    assert all(np.array(r["normal"]) @ direction < 0 for r in out if (r["bi"], r["bj"], r["bk"]) in inner)


def test_coarse_graining_is_one_operator(spark):
    array = np.zeros((8, 8, 8), int)
    array[2:] = 3
    array[2, 0, 0] = 7
    rows = {(r["bi"], r["bj"], r["bk"]): r for r in combo.coarse_grained(image(spark, array), (8, 8, 8), (2, 2, 2), pad=(1, 1, 1)).collect()}
    assert rows[1, 0, 0]["coarse"] == 3 and rows[1, 0, 0]["fine"] is None and rows[1, 0, 0]["normal"] is None
    assert rows[0, 0, 0]["coarse"] == -3 and rows[0, 0, 0]["normal"] is None
    assert rows[0, 0, 0]["fine"] == array[:4, :4, :4].ravel().tolist() and rows[0, 1, 1]["fine"] == array[:4, 4:, 4:].ravel().tolist()
    assert np.allclose(rows[0, 1, 1]["normal"], [-1, 0, 0])
    with pytest.raises(ValueError):
        combo.interface_normals(image(spark, array), (8, 8, 8), (2, 2, 2), pad=(3, 0, 0))


def test_laplacian_is_the_fft_one(spark, random_image):
    shape, lengths = random_image.shape, (1.0, 2.0, 0.5)
    got = dense(stencils.laplacian(image(spark, random_image), shape, "label", lengths), shape, "lap")
    kernel = np.zeros(shape)
    offsets, weights = stencils.laplacian_weights(shape, lengths)
    for o, w in zip(offsets, weights, strict=True):
        kernel[o] += w
    want = np.abs(np.fft.ifftn(np.fft.fftn(random_image) * np.fft.fftn(kernel)))
    assert np.allclose(got, want) and abs(sum(weights)) < 1e-12 and abs(weights[0] - 6) < 1e-12


@pytest.mark.parametrize("size", [1, 2, 3])
def test_erosion_against_rolls(spark, random_image, size):
    mask = random_image > 0
    frame = image(spark, mask.astype(int)).select("i", "j", "k", (F.col("label") == 1).alias("mask"))
    got = dense(stencils.periodic_erosion(frame, mask.shape, size), mask.shape, "mask", bool)
    want = np.ones_like(mask)
    for o in stencils.box_offsets(size):
        want &= np.roll(mask, [-x for x in o], (0, 1, 2))
    assert (got == want).all()


def test_median_against_sorting(spark, random_image):
    offsets = stencils.octahedron_offsets(1)
    got = dense(stencils.median_filter(image(spark, random_image), random_image.shape, offsets), random_image.shape, kind=int)
    stack = np.stack([np.roll(random_image, [-x for x in o], (0, 1, 2)) for o in offsets])
    assert (got == np.sort(stack, axis=0)[len(offsets) // 2]).all()


def test_resize_image_smooths_only_enlarged(spark, random_image):
    voxels = image(spark, random_image)
    assert stencils.resize_image(voxels, random_image.shape, scale=[2, 1, 1]).count() == 2 * random_image.size
    assert stencils.smoothing_offsets((2, 1, 1)) is None and len(stencils.smoothing_offsets((2, 2, 2))) == 129
    assert stencils.resize_image(image(spark, np.ones((3, 3, 3), int)), (3, 3, 3)).agg(F.min("label"), F.count("*")).first()[:] == (1, 216)


def test_same_materials(spark):
    array = np.zeros((8, 8, 8), int)
    array[0] = 1
    got = {(r["bi"], r["bj"], r["bk"]): r["same"] for r in combo.same_materials(image(spark, array), (8, 8, 8), (4, 4, 4), 1).collect()}
    assert got[2, 0, 0] and not got[3, 0, 0]


def test_fft_round_trip_and_numpy(spark, random_image):
    field = spectral.real_field(image(spark, random_image), "label")
    there = spectral.fft3(field, random_image.shape).cache()
    assert np.allclose(dense(there, random_image.shape, "re") + 1j * dense(there, random_image.shape, "im"), np.fft.fftn(random_image))
    back = spectral.fft3(there, random_image.shape, inverse=True)
    assert np.allclose(dense(back, random_image.shape, "re"), random_image)


def test_autocorrelations_agree(spark, random_image):
    voxels = image(spark, random_image).cache()
    full = dense(spectral.autocorrelation3(voxels, random_image.shape), random_image.shape, "r")
    assert abs(full[0, 0, 0] - 1) < 1e-12
    for r in spectral.axis_autocorrelation(voxels, random_image.shape).collect():
        at = [0, 0, 0]
        at["xyz".index(r["axis"])] = r["lag"]
        assert abs(full[tuple(at)] - r["r"]) < 1e-12
    flat = spectral.axis_autocorrelation(image(spark, np.ones((4, 4, 4), int)), (4, 4, 4))
    assert flat.where("r is not null").count() == 0


def test_decay_fit_recovers_the_length():
    x = np.arange(30.0)
    for length in (0.7, 3.0, 12.0):
        assert abs(spectral.fit_decay(x, np.exp(-x / length)) - length) < 1e-6


def test_spinodal_meets_its_fraction(spark):
    got = volume_fractions(spectral.spinodal_image(spark, (12, 12, 12), 0.35, wavenumber=(3, 3, 3))).collect()
    assert abs({r["label"]: r["fraction"] for r in got}[1] - 0.35) < 2 / 12**3
    field = spectral.spinodal_field(spark, (8, 8, 8), (2, 2, 2))
    mean, std = field.agg(F.avg("f"), F.stddev_pop("f")).first()
    assert abs(mean) < 1e-9 and abs(std - 1) < 1e-9


def test_hashed_noise_is_normal(spark):
    mean, std = spectral.noise(spark, (20, 20, 20)).agg(F.avg("re"), F.stddev_pop("re")).first()
    assert abs(mean) < 0.05 and abs(std - 1) < 0.05


def test_first_match_and_renumbering(spark):
    df = spark.createDataFrame([(1, 5, 9), (1, 4, 7), (2, 1, 9), (3, 2, None)], "v int, ord int, tag int")
    assert {r["v"]: r["tag"] for r in erosion.first_match(df, ["v"], ["ord"]).collect()} == {1: 7, 2: 9, 3: None}
    got = {(r["v"], r["tag"]): r["new"] for r in erosion.renumbered(df, "tag", 10, "new").collect()}
    assert got == {(1, 9): 11, (1, 7): 10, (2, 9): 11, (3, None): None}


def test_numbers_follow_the_order_without_a_window_over_all(spark):
    rng = np.random.default_rng(3)
    values = [(int(a), float(b)) for a, b in zip(rng.integers(0, 50, 3000), rng.random(3000))] + [(None, 0.5)]
    frame = spark.createDataFrame(values, "a int, b double").repartition(5)
    got = order.numbered(frame, ["a", "b"], "n", 7)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted(values, key=lambda v: (v[0] is not None, v[0] or 0, v[1]))
    assert [(r["a"], r["b"]) for r in got.orderBy("n").collect()] == want and got.agg(F.min("n"), F.max("n")).first()[:] == (7, 3007)
    total = order.running_total(frame.where("a is not null"), ["a", "b"], F.col("a"), "s").orderBy("a", "b").collect()
    assert [r["s"] for r in total] == np.cumsum([v[0] for v in want[1:]]).tolist()


def test_distinct_keys_are_numbered_by_ranges(spark):
    """No plan over rows that grow sends them all to one task."""
    rows = spark.range(500).select(F.col("id").alias("seed_a"), (F.col("id") + 1).alias("seed_b"), *[F.rand(k).alias(f"n{c}") for k, c in enumerate("xyz")])
    verts = F.array(F.struct(*[F.col(f"n{c}").alias(c) for c in "xyz"]))
    plans = [erosion.canonical_faces(rows), erosion.renumbered(rows, "seed_b", 3, "tag"), sd.running_index(rows, ["seed_a"]), voronoi.vertex_table(rows.select(verts.alias("verts"))), voronoi.running_offsets(rows, ["seed_a"], "seed_b")]
    for plan in plans:
        assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()


def test_order_statistics_against_sorting(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 1, 2000), rng.normal(1e6, 1e-3, 500), np.full(400, 2.5)])
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    places = [0, 1, 1000, 1999, 2200, 2899]
    assert order.order_statistics(frame, "v", places) == np.sort(values)[places].tolist()
    assert quantile(frame, "v", 0.37).first()[0] == pytest.approx(float(np.quantile(values, 0.37)), abs=1e-12)
    assert quantile(frame.limit(0), "v", 0.5).first()[0] is None


@pytest.mark.parametrize("lengths", [(1.0, 1.0, 1.0), (1.0, 2.0, 0.7), (1.0, 0.5)])
def test_tessellation_by_blocks_is_the_same(spark, lengths):
    seeds = sd.voronoi_seeds(spark, 60, lengths, "random", 8).cache()
    keys = ["seed_a", "seed_b", "ox", "oy", "oz"]
    rows = lambda faces: {tuple(r[k] for k in keys): (r["area"], r["distance"]) for r in faces.collect()}
    one, two = rows(voronoi.tessellate(seeds, lengths)), rows(voronoi.tessellate_blocks(seeds, lengths, 8))
    assert set(one) == set(two) and all(np.allclose(one[k], two[k]) for k in one)


def test_plane_tessellation(spark, tmp_path):
    from voxelgrain.sources import vtk

    lengths = (2.0, 1.0)
    faces = voronoi.tessellate(sd.voronoi_seeds(spark, 30, lengths, "random", 5), lengths).cache()
    areas = voronoi.cell_volumes(faces, 2)
    assert abs(areas.agg(F.sum("volume")).first()[0] - 2.0) < 1e-9 and areas.count() == 30
    for r in voronoi.cell_polygons(faces).join(areas, "seed_id").collect():
        x, y = np.array([(p["x"], p["y"]) for p in r["verts"]]).T
        assert abs(0.5 * np.sum(x * np.roll(y, -1) - y * np.roll(x, -1)) - r["volume"]) < 1e-7
    tensor = {(r["a"], r["b"]): r["value"] for r in voronoi.structure_tensor(voronoi.unique_faces(faces)).collect()}
    total = voronoi.interface_measures(faces).first()[0]
    assert abs(tensor[0, 0] + tensor[1, 1] - total) < 1e-9 and abs(tensor[2, 2]) < 1e-12
    path = str(tmp_path / "plane.vtu")
    vtk.write_tessellation(faces, path)
    text = open(path).read()
    assert "faceoffsets" not in text and text.count("\n7\n") >= 15
    lattice = voronoi.tessellate(sd.lattice_seeds(spark, 12, (1.0, 1.0, 1.0), False).where("z = 0"), (1.0, 1.0))
    assert abs(voronoi.cell_volumes(lattice, 2).agg(F.sum("volume")).first()[0] - 1) < 1e-9
