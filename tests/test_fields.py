"""Grids, surfaces, seeds, lattices, load paths: analytic cases and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain.operators import grids, lattices, loadpaths, raster, tpms
from voxelgrain.operators import seeds as sd
from voxelgrain.operators.fractions import histogram, volume_fractions

BOX = (1.0, 1.0, 1.0)


def test_grid_has_every_voxel_once(spark):
    g = grids.voxel_grid(spark, (3, 4, 5))
    assert g.distinct().count() == 60 and tuple(g.agg(F.max("i"), F.max("j"), F.max("k")).first()) == (2, 3, 4)


def test_axes_swap_twice_is_identity(spark):
    g = grids.voxel_grid(spark, (2, 3, 4)).withColumn("v", F.col("i") * 100 + F.col("k"))
    back = grids.permute_axes(grids.permute_axes(g, "zyx"), "zyx")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, g.collect()))
    with pytest.raises(ValueError):
        grids.permute_axes(g, "yxz")


def test_resize_keeps_fractions_of_whole_multiples(spark):
    g = grids.voxel_grid(spark, (4, 4, 4)).withColumn("label", F.col("i") % 3)
    big = grids.resize_nearest(g, (4, 4, 4), grids.target_shape((4, 4, 4)))
    a, b = ({r["label"]: r["fraction"] for r in volume_fractions(x).collect()} for x in (g, big))
    assert a == b and big.count() == 512
    assert grids.target_shape((4, 4, 4), scale=[2, 1, 1]) == (8, 4, 4) and grids.target_shape((4, 4, 4), resolution=(5, 6, 7)) == (5, 6, 7)


def test_divisibility_is_checked():
    with pytest.raises(ValueError):
        grids.check_divisible((10, 10, 10), (4, 5, 5))


@pytest.mark.parametrize("target", [0.2, 0.5, 0.75])
def test_threshold_hits_the_fraction(spark, target):
    n = 16**3
    field = tpms.tpms_field(spark, "lidinoid", (16, 16, 16)).cache()
    t = tpms.threshold_for_fraction(field, n, target).first()["threshold"]
    values = np.sort([r["f"] for r in field.collect()])
    assert t == values[min(max(math.floor((1 - target) * n + 0.5), 0), n - 1)]


def test_order_statistic_of_the_ends(spark):
    df = spark.createDataFrame([(float(v),) for v in (3, 1, 1, 2)], "x double")
    assert [tpms.kth_value(df, "x", k).first()["value"] for k in range(4)] == [1.0, 1.0, 2.0, 3.0]


def test_shell_thickness_by_bisection(spark):
    field = tpms.tpms_field(spark, "gyroid", (16, 16, 16)).cache()
    t = tpms.shell_thickness_for_fraction(field, 0.5, 0.3)
    got = field.agg(F.avg((F.abs(F.col("f") - 0.5) < t).cast("double"))).first()[0]
    assert abs(got - 0.3) < 0.03  # values of the small grid repeat


def test_phase_modes(spark):
    field = tpms.tpms_field(spark, lambda x, y, z: F.cos(x), (8, 2, 2))
    solid, inverse = (field.agg(F.sum(tpms.phase(F.col("f"), invert=i))).first()[0] for i in (False, True))
    assert solid + inverse == 32
    with pytest.raises(ValueError):
        tpms.phase(F.col("f"), mode="hollow")


def test_factors():
    for n in range(1, 200):
        f = sd.factorise(n, 3)
        assert math.prod(f) == n and f == sorted(f, reverse=True)
    assert sd.factorise(64, 3) == [4, 4, 4] and sd.factorise(7, 1) == [7]
    with pytest.raises(ValueError):
        sd.factorise(8, 0)


@pytest.mark.parametrize("method", sd.METHODS)
def test_seeds_lie_in_the_box_and_repeat(spark, method):
    n = 2 if method == "diamond" else 60
    box = (1.0, 2.0, 0.5)
    one, two = ([tuple(r) for r in sd.voronoi_seeds(spark, n, box, method, 4).orderBy("seed_id").select("seed_id", "x", "y", "z").collect()] for _ in range(2))
    assert one == two and len(one) == n and [r[0] for r in one] == list(range(n))
    assert all(0 <= r[c + 1] < box[c] for r in one for c in range(3))


def test_sobol_fills_dyadic_boxes(spark):
    rows = np.array([tuple(r)[1:] for r in sd.sobol_seeds(spark, 256, BOX).collect()])
    for axis in range(3):
        assert np.bincount((rows[:, axis] * 256).astype(int), minlength=256).tolist() == [1] * 256
    for a, b in ((0, 1), (0, 2)):
        assert np.bincount((rows[:, a] * 16).astype(int) * 16 + (rows[:, b] * 16).astype(int), minlength=256).max() <= 2


def test_seed_arguments(spark):
    for bad in ({"n": 0}, {"method": "grid"}, {"lengths": (1.0,)}):
        with pytest.raises(ValueError):
            sd.voronoi_seeds(spark, **({"n": 3, "lengths": BOX} | bad))
    assert sd.voronoi_seeds(spark, 5, (1.0, 1.0), "random").agg(F.max("z")).first()[0] == 0.0


def test_orientations_are_rotations(spark):
    frames = np.array([r["frame"] for r in sd.with_orientations(sd.voronoi_seeds(spark, 50, BOX, "halton")).collect()])
    assert np.allclose(frames @ frames.transpose(0, 2, 1), np.eye(3)) and np.allclose(np.linalg.det(frames), 1)


def test_ghosts(spark):
    g = sd.ghost_seeds(sd.voronoi_seeds(spark, 3, BOX, "random"))
    assert g.count() == 81 and g.where("ox = 0 and oy = 0 and oz = 0").count() == 3


COUNTS = {"bcc": (9, 8), "bccz": (9, 12), "cubic": (8, 12), "fcc": (14, 24), "fbcc": (15, 32), "isotruss": (15, 26), "octet": (14, 36), "auxetic": (18, 20)}


@pytest.mark.parametrize("name", COUNTS)
def test_unit_cells(spark, name):
    vertices, edges = lattices.unit_cell(spark, name)
    assert (vertices.count(), edges.count()) == COUNTS[name]


def test_rigidity(spark):
    got = {r["lattice"]: (r["maxwell"], r["rigidity"]) for r in lattices.lattice_rigidity(spark).collect()}
    assert got["octet"] == (0, "statically determinate") and got["cubic"] == (-6, "under-constrained")


def brute_stamp(struts, n, radius):
    h, out = 1.0 / (n - 1), set()
    step = math.sqrt(3 * h * h)
    for a, b in struts:
        a, b = np.array(a, float), np.array(b, float)
        length = np.linalg.norm(b - a)
        for t in np.linspace(0, 1, max(1, math.ceil(round(length / step, 9)))):
            p = np.round(a + t * (b - a), 9)
            if (p < -1e-12).any() or (p >= 1 + 1e-12).any():
                continue
            v = np.clip(np.floor(p * (n - 1) + 0.5), 0, n - 1)
            for o in np.ndindex(7, 7, 7):
                w = v + np.array(o) - 3
                if ((w - v) ** 2).sum() * h * h <= radius * radius and (w >= 0).all() and (w < n).all():
                    out.add(tuple(int(x) for x in w))
    return out


def test_stamped_struts_match_brute_force(spark):
    struts = [((0.1, 0.2, 0.3), (0.9, 0.8, 0.7)), ((0, 0, 0), (0, 0, 1)), ((0.5, 0.5, 0.5), (0.5, 0.5, 0.52)), ((0.5, 0.5, 0.9), (0.5, 0.5, 1.4))]
    frame = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in struts], ", ".join(f"{e}{c} double" for e in "ab" for c in "xyz"))
    got = {tuple(r) for r in raster.stamp_struts(frame, (12, 12, 12), BOX, 0.15).collect()}
    assert got == brute_stamp(struts, 12, 0.15)
    with pytest.raises(ValueError):
        raster.stamp_struts(frame, (12, 12, 12), strut_type="square")


def test_exact_struts_are_a_cylinder(spark):
    frame = spark.createDataFrame([(0.0, 0.5, 0.5, 1.0, 0.5, 0.5)], "ax double, ay double, az double, bx double, by double, bz double")
    n = 21
    got = raster.exact_struts(frame, (n, n, n), BOX, 0.21).count()
    inside = sum((j / 20 - 0.5) ** 2 + (k / 20 - 0.5) ** 2 <= 0.21**2 for j in range(n) for k in range(n))
    assert got == inside * n


def test_load_paths_meet_a_limit(spark):
    paths = loadpaths.linear_paths(loadpaths.equal_area_directions(spark, 20)).cache()
    assert paths.where(~loadpaths.within_limits(F.col("e"), 0.03, 0.005)).count() == 0
    for r in paths.where("step = 10").collect():
        e = np.array(r["e"])
        dev = e - np.array([1, 1, 1, 0, 0, 0]) * e[:3].sum() / 3
        assert min(abs(np.linalg.norm(dev) - 0.03), abs(abs(e[:3].sum()) - 0.005)) < 1e-12
    zero = spark.createDataFrame([(0, [0.0] * 6)], "path_id int, v array<double>")
    assert all(r["e"] == [0.0] * 6 for r in loadpaths.linear_paths(zero).collect())


@pytest.mark.parametrize("n", [1, 2, 7, 32, 100])
def test_equal_area_directions(n):
    p = np.array(loadpaths.equal_area_points(5, n))
    assert p.shape == (n, 6) and np.allclose((p * p).sum(axis=1), 1)
    if n > 30:
        assert np.linalg.norm(p.mean(axis=0)) < 0.05


def test_path_json(spark, tmp_path):
    import json

    paths = loadpaths.linear_paths(loadpaths.equal_area_directions(spark, 3), steps=2)
    file = loadpaths.write_path_json(paths, str(tmp_path / "p.json"), zero_step=True)
    held = json.load(open(file))["macroscale_loading"]
    assert len(held) == 3 and all(len(p) == 3 and p[0] == [0] * 6 for p in held)
    want = {(r["path_id"], r["step"]): r["e"] for r in paths.collect()}
    assert all(np.allclose(held[i][s], want[i, s], rtol=1e-12, atol=1e-15) for i in range(3) for s in (1, 2))


def test_histogram_counts_everything(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "x double")
    assert {r["bin"]: r["n"] for r in histogram(df, "x", 5).collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}


def test_numpy_surfaces_agree_with_their_columns(spark):
    """A NumPy callable and its twin of columns give one field; only the former leaves the JVM."""
    import numpy as np

    shape, lengths, frequency = (7, 6, 5), (1.0, 2.0, 0.5), (1, 2, 3)
    own = lambda x, y, z: np.sin(x) * np.cos(y) + np.sin(y) * np.cos(z) + np.sin(z) * np.cos(x)
    twin = lambda x, y, z: F.sin(x) * F.cos(y) + F.sin(y) * F.cos(z) + F.sin(z) * F.cos(x)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    fields = [tpms.raw_field(spark, s, shape, lengths, frequency) for s in (own, twin, "gyroid")]
    assert ["ArrowEvalPython" in plan(f) for f in fields] == [True, False, False]
    rows = [{tuple(r)[:3]: r["f"] for r in f.collect()} for f in fields]
    assert all(len(r) == 210 for r in rows) and all(abs(rows[0][k] - rows[1][k]) < 1e-12 for k in rows[1])
    assert {round(abs(rows[0][k]), 9) for k in rows[0]} == {round(abs(v), 9) for v in rows[2].values()}
    # helpers that only NumPy has, constants, and results of a wrong shape
    assert tpms.raw_field(spark, lambda x, y, z: np.where(x > 1, np.hypot(y, z), 2.0), (4, 4, 4)).where("f is null").count() == 0
    assert [r[0] for r in tpms.raw_field(spark, lambda x, y, z: 3.0, (2, 2, 2)).select("f").distinct().collect()] == [3.0]
    with pytest.raises(Exception, match="one value for each point"):
        tpms.raw_field(spark, lambda x, y, z: np.stack([x, y]), (3, 3, 3)).collect()
    image = tpms.tpms_field(spark, own, (8, 8, 8)).agg(F.min("f"), F.max("f")).first()
    assert tuple(image) == (0.0, 1.0)


def test_distances_of_all_pairs_are_dealt_to_even_tasks(spark, monkeypatch):
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(sd, "PAIR_ROWS", 100)
    folder = "/root/testdata/sf0.01"
    df = entry.queries()["periodic_distance"](spark, folder).cache()
    tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 25 and max(tasks) <= 120 * 120
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
        want = db.execute(entry.oracle_sql()["periodic_distance"]).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
    df.unpersist()


def test_positive_numbers_round_as_the_other_way_does(spark):
    from voxelgrain.plans import fixtures as fx

    rows = [(x,) for x in (0.0, 0.5e-6, 1.5e-6, 2.5e-6, 0.4999999999999999e-6, 0.123456499999, 0.1234565, 1e15, 1e300, float("inf"), float("nan"), None)]
    rows += [(k / 7_000_000,) for k in range(3000)]
    df = spark.createDataFrame(rows, "x double")
    both = df.select(fx.sql_round_positive("x", 6).alias("a"), fx.sql_round("x", 6).alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
    assert both.collect() == []


def test_flipped_vectors_have_the_minus_zeros_of_sql(spark, tmp_path):
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    rows = [(0, [-1e-7, -4e-7, 1e-7]), (1, [-0.0, 0.0, -6e-7]), (2, [0.5, -0.1234565, None]), (3, None), (4, [float("nan"), float("-inf"), float("inf")])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["vector_flip"](spark, str(tmp_path)).collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = db.execute(entry.oracle_sql()["vector_flip"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert "-0.0" in repr(want)
