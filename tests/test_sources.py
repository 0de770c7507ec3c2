"""Files in and out, result tables, streaming, and the entry module."""

import base64
import importlib.util
import os
import struct
import sys
import zlib
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain.operators import combo, elastic, grids, results as rs, voronoi
from voxelgrain.operators import seeds as sd
from voxelgrain.sources import hdf5, parquet, vtk, xdmf
from voxelgrain.streaming import RESULTS, read_steps, running_maximum, streamed_measures

ROWS = [
    ("a", "load1", s, q, p, [float(s + p + c) for c in range(6)])
    for s in (1, 2, 10)
    for q in ("stress", "strain")
    for p in (0, 1)
] + [("b", "load0", 1, "stress", 0, [1.0] * 6)]
SCHEMA = "microstructure string, load_case string, time_step int, quantity string, point_id long, value array<double>"


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def test_image_round_trip(spark, tmp_path):
    voxels = grids.voxel_grid(spark, (3, 4, 5)).withColumn("label", F.col("i") * 100 + F.col("k"))
    for order in ("zyx", "xyz"):
        parquet.write_image(voxels, str(tmp_path), f"one_{order}", (3, 4, 5), (1.0, 2.0, 3.0), {"who": "me", "L": "stale"}, order)
        back, header = parquet.read_image(spark, str(tmp_path), f"one_{order}")
        assert sorted(map(tuple, back.select("i", "j", "k", "label").collect())) == sorted(map(tuple, voxels.collect()))
        assert header["shape"] == (3, 4, 5) and header["lengths"] == (1.0, 2.0, 3.0) and header["metadata"]["who"] == "me" and header["metadata"]["L"] == "[1.0, 2.0, 3.0]"
    with pytest.raises(ValueError):
        parquet.read_image(spark, str(tmp_path), "none")


def test_seeds_and_combo_round_trip(spark, tmp_path):
    seeds = sd.with_orientations(sd.voronoi_seeds(spark, 4, (1.0, 1.0, 1.0), "halton"))
    parquet.write_seeds(seeds, str(tmp_path), "seeds", (1.0, 1.0, 1.0))
    assert parquet.read_seeds(spark, str(tmp_path), "seeds").count() == 4
    with pytest.raises(ValueError):
        parquet.read_seeds(spark, str(tmp_path), "nothing")
    padded = spark.createDataFrame([(0, [(1, 0.5), (-1, -1.0)])], "elem int, phases array<struct<material: int, fraction: double>>")
    parquet.write_combo(padded, str(tmp_path), "combo")
    assert [tuple(p) for p in parquet.read_combo(spark, str(tmp_path), "combo").first()["phases"]] == [(1, 0.5)]


def test_results_write_back(spark, tmp_path, results):
    path = str(tmp_path / "results")
    parquet.write_results(results, path)
    made = rs.postprocess(results, ["stress"], ["von_mises", "deviatoric"])
    parquet.write_results(made, path)
    assert parquet.read_results(spark, path).count() == len(ROWS) + 2 * 7
    one = parquet.read_results(spark, path, ["stress_von_mises"], ["a"], [], [1])
    assert one.count() == 2 and "PartitionFilters: [isnotnull(microstructure" in one._jdf.queryExecution().toString()
    parquet.write_results(made.withColumn("value", F.array(F.lit(-1.0))), path, overwrite=False)
    assert parquet.read_results(spark, path, ["stress_von_mises"]).where("value[0] = -1").count() == 0
    parquet.write_results(made.withColumn("value", F.array(F.lit(-1.0))), path)
    assert parquet.read_results(spark, path, ["stress_von_mises"]).where("value[0] = -1").count() == 7
    assert parquet.read_results(spark, path).count() == len(ROWS) + 2 * 7


def test_hierarchy(results, spark):
    got = {r["microstructure"]: tuple(r)[1:] for r in rs.hierarchy_summary(results).collect()}
    assert got == {"a": (1, 3, ["strain", "stress"]), "b": (1, 1, ["stress"])}
    stacked = rs.stacked(results).where("microstructure = 'a' and quantity = 'stress' and point_id = 0").first()
    assert stacked["time_steps"] == [1, 2, 10] and [v[0] for v in stacked["values"]] == [1.0, 2.0, 10.0]
    paths = spark.createDataFrame([("/m/x/load_a/time_step12/stress",), ("/m/x/other/stress",)], "path string")
    assert rs.parsed_paths(paths).select("microstructure", "load_case", "time_step", "quantity").first()[:] == ("m/x", "load_a", 12, "stress")
    assert rs.parsed_paths(paths).count() == 1


def test_merges(spark):
    rows = spark.createDataFrame([("/x", 0, "old"), ("/x", 1, "new"), ("/y/z", 0, "only")], "path string, file_ord int, v string")
    assert {r["path"]: r["v"] for r in rs.merge(rows).collect()} == {"/x": "new", "/y/z": "only"}
    assert {r["path"]: r["v"] for r in rs.merge(rows, overwrite=False).collect()} == {"/x": "old", "/y/z": "only"}
    more = spark.createDataFrame([("/x", 5, "late"), ("/w", 5, "w")], "path string, file_ord int, v string")
    assert rs.append_missing(rows, more).count() == 4
    assert rs.clashes(rows).count() == 0
    assert [r["path"] for r in rs.clashes(rows.union(spark.createDataFrame([("/x/inner", 2, "bad")], rows.schema))).collect()] == ["x"]
    assert {tuple(r) for r in rs.tree(rows.withColumn("shape", F.array(F.lit(2)))).select("parent", "name").collect()} == {("/", "x"), ("/", "y"), ("/y", "z")}


def test_subplots():
    assert [rs.subplot_layout(n) for n in (1, 2, 3, 5, 9, 10)] == [(1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (4, 3)]


def vti(values, form="ascii", compressed=False, vectors=None):
    nz, ny, nx = values.shape
    header = ' compressor="vtkZLibDataCompressor"' if compressed else ""
    body = values.astype("<f4").tobytes()
    if form == "ascii":
        text = " ".join(map(str, values.ravel()))
    elif compressed:
        packed = zlib.compress(body)
        text = base64.b64encode(struct.pack("<4I", 1, len(body), 0, len(packed))).decode() + base64.b64encode(packed).decode()
    else:
        text = vtk.pack_inline(values.astype("<f4"))
    more = "" if vectors is None else f'<DataArray type="Float64" Name="u" NumberOfComponents="3" format="ascii">{" ".join(map(str, vectors.ravel()))}</DataArray>'
    return (
        f'<VTKFile type="ImageData" byte_order="LittleEndian"{header}><ImageData WholeExtent="0 {nx} 0 {ny} 0 {nz}" Origin="0 0 0" Spacing="0.5 0.5 0.5"><Piece Extent="0 {nx} 0 {ny} 0 {nz}">'
        f'<CellData><DataArray type="Float32" Name="f" format="{form}">{text}</DataArray>{more}</CellData></Piece></ImageData></VTKFile>'
    ).encode()


@pytest.mark.parametrize(("form", "compressed"), [("ascii", False), ("binary", False), ("binary", True)])
def test_vtk_images(spark, tmp_path, form, compressed):
    values = np.arange(24.0).reshape(2, 3, 4)
    vectors = np.arange(72.0).reshape(24, 3)
    (tmp_path / "a.vti").write_bytes(vti(values, form, compressed, vectors))
    (tmp_path / "b.vti").write_bytes(b"<broken")
    cells = vtk.read_vtk(spark, [str(tmp_path)]).cache()
    assert cells.count() == 48 and vtk.is_regular(cells).first()["regular"]
    out = {(r["i"], r["j"], r["k"]): r["value"] for r in vtk.gridded(cells.where("field = 'f'")).collect()}
    assert all(out[x, y, z] == [values[z, y, x]] for x in range(4) for y in range(3) for z in range(2))
    flipped = {(r["i"], r["j"], r["k"]): r["value"] for r in vtk.gridded(cells.where("field = 'u'")).collect()}
    assert flipped[1, 0, 0] == [5.0, 4.0, 3.0]
    assert vtk.grid_headers(cells).first()[1:] == (24, 4, 3, 2, 2.0, 1.5, 1.0)
    assert vtk.read_vtk(spark, [str(tmp_path / "a.vti")], ["none"]).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        vtk.read_vtk(spark, [str(tmp_path / "b.vti")], mode="FAILFAST").count()


def test_written_tessellation_is_read_back(spark, tmp_path):
    faces = voronoi.tessellate(sd.voronoi_seeds(spark, 8, (1.0, 1.0, 1.0), "rubiks-cube"))
    path = str(tmp_path / "t.vtu")
    vtk.write_tessellation(faces, path)
    cells = vtk.read_vtk(spark, [path]).collect()
    assert len(cells) == 8 and sorted(c["value"][0] for c in cells) == list(range(8))
    root = ElementTree.parse(path).getroot()
    arrays = {n.get("Name"): list(map(int, n.text.split())) for n in root.findall(".//Cells/DataArray")}
    assert arrays["offsets"] == [8 * (k + 1) for k in range(8)] and arrays["faceoffsets"][-1] == len(arrays["faces"]) == 8 * (1 + 6 * 5)


def test_surface_file(spark, tmp_path):
    c = spark.createDataFrame([([float(k % 7 == 0) for k in range(36)],)], "c array<double>")
    out = elastic.youngs_modulus(c, elastic.direction_grid(spark, 5, 7).select("t", "p", "x", "y", "z"))
    path = str(tmp_path / "s.vtk")
    vtk.write_surface(out, path, 5, 7)
    text = open(path).read()
    assert "POINTS 35 double" in text and "POLYGONS 24 120" in text


def test_boundaries_with_header(spark, tmp_path):
    image = spark.createDataFrame([(0, 0, 0, 2, 1), (0, 0, 1, 1, 1)], "i int, j int, k int, label long, crystal int")
    table = spark.createDataFrame([(2, 1.0, 0.0, 0.0, 0, 1)], "gb_tag long, nx double, ny double, nz double, crystal_a long, crystal_b long")
    parquet.write_boundaries(image, table, str(tmp_path), "gb", normals=True, header={"thickness": 0.1})
    held = spark.read.parquet(str(tmp_path / "gb" / "header")).first()
    assert held["header"] == '{"thickness": 0.1}' and '"crystal_a":0' in held["boundaries"]
    assert {r["k"]: r["nx"] for r in spark.read.parquet(str(tmp_path / "gb" / "normals")).collect()} == {0: 1.0, 1: 0.0}


@pytest.mark.parametrize("name", ["polycrystal", "surfaces", "coarse", "load_paths", "correlation"])
def test_demos(spark, tmp_path, name):
    from examples import demos

    demos.DEMOS[name](spark, 16, str(tmp_path))


def test_xdmf(spark, tmp_path):
    rows = [("/g/time_step2/displacement", [4, 4, 4, 3]), ("/g/time_step10/stress", [4, 4, 4, 6]), ("/g/static", [4, 4, 4]), ("/odd", [4, 4, 4, 2]), ("/flat", [4, 4])]
    catalog = spark.createDataFrame(rows, "path string, shape array<int>")
    root = ElementTree.parse(xdmf.write_xdmf(catalog, "data.h5", str(tmp_path / "a.xdmf"), lengths=(1.0, 2.0, 4.0))).getroot()
    kinds = {a.get("Name"): (a.get("AttributeType"), a.get("Center")) for a in root.iter("Attribute")}
    assert kinds == {"/g/time_step2/displacement": ("Vector", "Node"), "/g/time_step10/stress": ("Tensor6", "Cell"), "/g/static": ("Scalar", "Cell")}
    assert [d.text for d in root.iter("DataItem")][1] == "0.25 0.5 1.0"
    series = ElementTree.parse(xdmf.write_xdmf(catalog, "data.h5", str(tmp_path / "b.xdmf"), time_series=True)).getroot()
    assert [t.get("Value") for t in series.iter("Time")] == ["2.0", "10.0"]
    assert {a.get("Name") for a in series.iter("Attribute")} == {"/g/displacement", "/g/stress"}


@pytest.mark.skipif(hdf5.h5py is not None, reason="h5py is installed")
def test_hdf5_says_what_is_missing(spark):
    with pytest.raises(ImportError, match="h5py"):
        hdf5.catalog(spark, ["x.h5"])


STUB = os.path.join(os.path.dirname(__file__), "stubs", "h5py.py")


@pytest.fixture
def h5py_stub(spark, monkeypatch):
    """The HDF5 sources against a stand-in library, on the driver and in the workers."""
    found = importlib.util.spec_from_file_location("h5py", STUB)
    module = importlib.util.module_from_spec(found)
    monkeypatch.setitem(sys.modules, "h5py", module)
    found.loader.exec_module(module)
    monkeypatch.setattr(hdf5, "h5py", module)
    spark.sparkContext.addPyFile(STUB)
    return module


@pytest.mark.skipif(hdf5.h5py is not None, reason="h5py is installed")
@pytest.mark.parametrize(("kind", "stored"), [("int", "i4"), ("double", "f8"), ("float", "f4")])
def test_hdf5_images(spark, tmp_path, h5py_stub, kind, stored):
    voxels = grids.voxel_grid(spark, (3, 4, 5)).withColumn("label", (F.col("i") * 100 + F.col("k") + (0.25 if kind != "int" else 0)).cast(kind))
    file = str(tmp_path / "one.h5")
    hdf5.write_image(voxels, file, "/img", (3, 4, 5), (1.0, 2.0, 3.0), metadata={"who": "me"})
    hdf5.write_image(voxels, file, "/img", (3, 4, 5), (1.0, 2.0, 3.0), metadata={"who": "me"})
    with h5py_stub.File(file) as held:
        assert held["/img"].dtype == stored and held["/img"].shape == (5, 4, 3) and held["/img"].options["compression"] == "gzip"
    back, header = hdf5.read_image(spark, file, "/img")
    assert sorted(map(tuple, back.select("i", "j", "k", "label").collect())) == sorted(map(tuple, voxels.collect()))
    assert header["shape"] == (3, 4, 5) and header["lengths"] == [1.0, 2.0, 3.0] and header["attrs"]["who"] == "me"
    with pytest.raises(ValueError):
        hdf5.read_image(spark, file, "/none")
    with pytest.raises(ValueError):
        hdf5.write_image(voxels, file, "/img", (3, 4, 5), compression=11)


@pytest.mark.skipif(hdf5.h5py is not None, reason="h5py is installed")
def test_hdf5_catalog_merge_and_description(spark, tmp_path, h5py_stub, monkeypatch):
    files = [str(tmp_path / f"{n}.h5") for n in "abc"]
    for n, file in enumerate(files[:2]):
        with h5py_stub.File(file, "w") as held:
            held.create_dataset("/same", data=np.full((2, 2, 2), n)).attrs["n"] = np.int64(n)
            held.create_dataset(f"/g/time_step{n + 1}/own{n}", data=np.full((2, 2, 2, 3), n))
    rows = {(r["file"], r["path"]): r for r in hdf5.catalog(spark, files[:2]).collect()}
    assert len(rows) == 4 and rows[files[1], "/same"]["attrs"] == {"n": "1"} and rows[files[0], "/g/time_step1/own0"]["shape"] == [2, 2, 2, 3]
    assert hdf5.merge_files(spark, files[2], files[:2]) == 3
    with h5py_stub.File(files[2]) as held:
        assert held["/same"][0, 0, 0] == 1 and "/g/time_step1/own0" in held
    assert hdf5.merge_files(spark, files[2], files[:1], overwrite=False) == 0
    monkeypatch.setattr("voxelgrain.session.local_session", lambda *a, **k: spark)
    hdf5.main(["-o", files[2], "-i", files[0]])
    with h5py_stub.File(files[2]) as held:
        assert held["/same"][0, 0, 0] == 0
    xdmf.main([files[2], "-x", str(tmp_path / "c.xdmf"), "-t", "-c", "1", "2", "4"])
    series = ElementTree.parse(tmp_path / "c.xdmf").getroot()
    assert [t.get("Value") for t in series.iter("Time")] == ["1.0", "2.0"]
    with h5py_stub.File(files[0], "a") as held:
        held.create_dataset("/same/inner", data=np.zeros(2))
    with pytest.raises(ValueError, match="one name"):
        hdf5.merge_files(spark, files[2], files[:2])


def test_padded_records_round_trip(spark):
    array = np.zeros((4, 4, 4), int)
    array[1:] = 2
    array[1, 0, 0] = 3
    rows = [(*map(int, p), int(v)) for p, v in np.ndenumerate(array) for p in [p]]
    whole = combo.coarse_grained(spark.createDataFrame(rows, "i int, j int, k int, label int"), (4, 4, 4), (2, 2, 2)).cache()
    records = parquet.padded_records(whole).cache()
    one = records.where("coords = array(0, 0, 0)").first()
    two = records.where("coords = array(0, 1, 1)").first()
    assert one["materials"] == [0, 2, 3] and two["materials"] == [0, 2, -1] and two["fractions"] == [0.5, 0.5, -1.0]
    assert one["normal"] == [0.0, 0.0, 0.0] and two["num_materials"] == 2 and len(one["fine_scale_block"]) == 8
    back = {tuple(r)[:3]: r for r in parquet.from_padded_records(records).collect()}
    for r in whole.where("size(phases) > 1").collect():
        assert back[r["bi"], r["bj"], r["bk"]]["phases"] == r["phases"] and back[r["bi"], r["bj"], r["bk"]]["fine"] == r["fine"]
    assert parquet.padded_records(whole.limit(0)).count() == 0


def test_combo_writes_its_fine_image(spark, tmp_path):
    fine = grids.voxel_grid(spark, (2, 2, 2)).withColumn("label", F.col("i"))
    parquet.write_combo(combo.coarse_grained(fine, (2, 2, 2), (1, 1, 1)), str(tmp_path), "g", fine)
    assert parquet.read_combo(spark, str(tmp_path), "g").first()["coarse"] == -2
    assert spark.read.parquet(str(tmp_path / "g_fine")).count() == 8


def test_streamed_steps(spark, tmp_path, results):
    folder = str(tmp_path / "steps")
    stamped = results.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("time_step")))
    stamped.where("time_step < 10").write.parquet(folder)
    measured = streamed_measures(read_steps(spark, folder), ["stress"], ["von_mises"])
    assert measured.isStreaming and measured.schema["at"].dataType.typeName() == "timestamp"
    query = running_maximum(measured).writeStream.format("memory").queryName("greatest").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.sql("select * from greatest").collect()
    assert sum(r["rows"] for r in got) == 5 and RESULTS.endswith("timestamp")


def test_entry_runs_without_the_training_data_part(spark, monkeypatch):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 32**3
    real = entry.importlib.util.find_spec
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: None if name.startswith("voxelgrain.llm") else real(name))
    names = entry.queries()
    assert names and not any(n.startswith("op") and n[2:3].isdigit() for n in names) and set(entry.oracle_sql()) <= set(names)
