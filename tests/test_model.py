"""Images, views for plots, SQL names, and the registry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain import model
from voxelgrain.functions import sql as names
from voxelgrain.operators import grids, lattices, raster, spectral, tpms, views, voronoi
from voxelgrain.operators import seeds as sd
from voxelgrain.plans import catalog

BOX = (1.0, 1.0, 1.0)


def test_image_of_an_array(spark, tmp_path):
    array = np.random.default_rng(1).integers(0, 4, (3, 4, 5))
    image = model.Image.of(spark, array, (1.0, 2.0, 3.0), {"who": "me"})
    assert (image.array() == array).all() and sum(r["fraction"] for r in image.fractions().collect()) == pytest.approx(1)
    assert (image.reversed_axes().array() == array.T).all() and image.reversed_axes().lengths == (3.0, 2.0, 1.0)
    assert (image.resized().array() == array.repeat(2, 0).repeat(2, 1).repeat(2, 2)).all()
    image.write(str(tmp_path), "a")
    back = model.Image.read(spark, str(tmp_path), "a")
    assert (back.array() == array).all() and back.lengths == image.lengths and back.metadata["who"] == "me"
    with pytest.raises(ValueError):
        model.from_array(spark, np.zeros((2, 2)))


def test_views(spark):
    array = np.random.default_rng(2).integers(0, 2, (6, 8, 4))
    voxels = model.from_array(spark, array)
    planes = views.middle_planes(voxels, array.shape)
    assert planes.count() == 8 * 4 + 6 * 4 + 6 * 8
    assert {(r["u"], r["v"]): r["value"] for r in planes.where("axis = 'y'").collect()} == {(i, k): array[i, 4, k] for i in range(6) for k in range(4)}
    series = views.decay_series(spectral.axis_autocorrelation(voxels, array.shape), spectral.correlation_lengths(voxels, array.shape))
    assert series.where("lag = 0 and abs(fitted - 1) < 1e-12 and abs(r - 1) < 1e-9").count() == 3
    placed = views.panels({"one": series.where("axis = 'x'"), "two": series.where("axis = 'y'"), "three": series.where("axis = 'z'")}, "lag", "r")
    assert {(r["title"], r["row"], r["column"]) for r in placed.collect()} == {("one", 0, 0), ("two", 0, 1), ("three", 1, 0)}
    assert views.lattice_lines(*lattices.unit_cell(spark, "fcc")).count() == 24
    with pytest.raises(ValueError):
        views.panels({}, "x", "y")


def test_faces_within_and_boxes(spark):
    faces = voronoi.tessellate(sd.voronoi_seeds(spark, 8, (1.0, 1.0, 1.0), "rubiks-cube")).cache()
    every = voronoi.vertex_table(faces)
    assert views.faces_within(faces, every).count() == faces.count()
    assert views.faces_within(faces, every.where("x < 0.5")).count() < faces.count()
    boxes = views.bounding_boxes(faces)
    assert boxes.where("low_x > high_x or low_y > high_y or low_z > high_z").count() == 0


def test_sql_names(spark):
    assert set(names.register(spark)) >= {"gyroid", "von_mises", "voxel_grid"}
    assert spark.sql("SELECT count(*), count(DISTINCT i, j, k), max(i), max(j), max(k) FROM voxel_grid(2, 3, 4)").first()[:] == (24, 24, 1, 2, 3)
    raw = tpms.raw_field(spark, "lidinoid", (3, 4, 5)).select("i", "j", "k", F.round("f", 9).alias("f"))
    assert spark.sql("SELECT i, j, k, round(f, 9) AS f FROM tpms_grid('lidinoid', 3, 4, 5)").exceptAll(raw).count() == 0
    for method in ("rubiks-cube", "honeycomb", "halton", "sobol", "diamond"):
        own = sd.sobol_seeds(spark, 12, BOX) if method == "sobol" else sd.voronoi_seeds(spark, 12, BOX, method)
        a, b = (sorted((r["seed_id"], *(round(r[c], 9) % 1.0 for c in "xyz")) for r in rows.collect()) for rows in (own, spark.sql(f"SELECT * FROM voronoi_seeds(12, '{method}')")))
        assert a == b
    assert spark.sql("SELECT max(x) FROM lattice_seeds(8)").first()[0] == 0.5
    assert spark.sql("SELECT von_mises(array(1D, 1D, 1D, 0D, 0D, 0D))").first()[0] == 0.0


def test_grids_need_no_shuffle(spark):
    plan = raster.label_nearest_seed(grids.voxel_grid(spark, (8, 8, 8)), sd.voronoi_seeds(spark, 5, (1.0, 1.0, 1.0), "halton"), (8, 8, 8))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_filters_and_columns_reach_the_scan(spark):
    from voxelgrain.plans import fixtures

    plan = catalog.queries()["volume_fractions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_returnflag:string>" in plan
    table = fixtures.table(spark, "/root/testdata/sf0.001", "lineitem").where(F.col("l_returnflag") == "R").select("l_orderkey")
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in table._jdf.queryExecution().toString()


def test_registry_is_complete():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 100
