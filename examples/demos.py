"""Small end-to-end runs: ``python -m examples.demos NAME [-n VOXELS] [-o FOLDER]``."""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from voxelgrain.model import Image
from voxelgrain.operators import combo, erosion, grids, lattices, loadpaths, raster, spectral, stencils, tpms, voronoi
from voxelgrain.operators import seeds as sd
from voxelgrain.operators.fractions import boundary_fraction, histogram, resize_error, volume_fractions
from voxelgrain.session import local_session
from voxelgrain.sources import parquet, vtk

BOX = (1.0, 1.0, 1.0)


def _labels(spark: SparkSession, n: int, crystals: int):
    shape = (n, n, n)
    points = sd.voronoi_seeds(spark, crystals, BOX, "sobol", 1)
    return shape, points, raster.label_nearest_seed(grids.voxel_grid(spark, shape), points, shape)


def polycrystal(spark: SparkSession, n: int, out: str) -> None:
    """Eight crystals, their grain boundaries of eight voxels' thickness, and the share of boundary."""
    shape, points, voxels = _labels(spark, n, 8)
    faces = voronoi.tessellate(points)
    image, table = erosion.erode_boundaries(voxels, faces, points, shape, thickness=8 / n)
    parquet.write_boundaries(image, table, out, "polycrystal", header={"thickness": 8 / n, "crystals": 8, "shape": list(shape)})
    vtk.write_tessellation(faces, os.path.join(out, "polycrystal.vtu"))
    boundary_fraction(image, 8).show()


def foam(spark: SparkSession, n: int, out: str) -> None:
    points = sd.voronoi_seeds(spark, 32, BOX, "lhs-lloyd", 1)
    Image(voronoi.foam(spark, voronoi.tessellate(points), (n, n, n), radius=0.03), (n, n, n)).write(out, "foam")


def surfaces(spark: SparkSession, n: int, out: str) -> None:
    """Six minimal surfaces, and thresholds that give each a fraction of 0.3."""
    for name in tpms.SURFACES:
        field = tpms.tpms_field(spark, name, (n, n, n), BOX, (2, 1, 1)).cache()
        t = tpms.threshold_for_fraction(field, n**3, 0.3).first()["threshold"]
        image = Image(field.select("i", "j", "k", tpms.phase(F.col("f"), t).alias("label")), (n, n, n), BOX, {"surface": name})
        image.write(out, name)
        print(name, t, {r["label"]: r["fraction"] for r in image.fractions().collect()})


def unit_cells(spark: SparkSession, n: int, out: str) -> None:
    for name in lattices.UNIT_CELLS:
        image = Image(lattices.lattice_image(spark, name, (n, n, n)), (n, n, n), BOX, {"lattice": name})
        image.write(out, name)
    lattices.lattice_rigidity(spark).show(truncate=False)


def spinodal(spark: SparkSession, n: int, out: str) -> None:
    Image(spectral.spinodal_image(spark, (n, n, n), 0.5, wavenumber=(6.0, 6.0, 6.0), sigma=0.1), (n, n, n)).write(out, "spinodal")


def coarse(spark: SparkSession, n: int, out: str) -> None:
    """Blocks of four voxels, materials and normals."""
    shape, _, voxels = _labels(spark, n, 8)
    blocks = (n // 4,) * 3
    whole = combo.coarse_grained(voxels, shape, blocks, pad=(2, 2, 2))
    parquet.write_combo(whole, out, "coarse")
    combo.composite_fractions(whole).show()


def resize(spark: SparkSession, n: int, out: str) -> None:
    shape, _, voxels = _labels(spark, n, 8)
    resize_error(voxels, stencils.resize_image(voxels, shape, scale=1.25)).show()


def correlation(spark: SparkSession, n: int, out: str) -> None:
    shape, _, voxels = _labels(spark, n, 64)
    spectral.correlation_lengths(voxels.withColumn("label", F.col("label") % 2), shape).show()


def samplers(spark: SparkSession, n: int, out: str) -> None:
    """Cell volumes of six samplers, in 128 bins."""
    for method in ("random", "lhs-lloyd", "halton", "sobol", "honeycomb", "rubiks-cube"):
        volumes = voronoi.cell_volumes(voronoi.tessellate(sd.voronoi_seeds(spark, 100, BOX, method, 1)))
        histogram(volumes, "volume", 128, 0.0, 0.04).withColumn("method", F.lit(method)).write.mode("overwrite").parquet(os.path.join(out, "samplers", method))


def load_paths(spark: SparkSession, n: int, out: str) -> None:
    print(loadpaths.write_path_json(loadpaths.linear_paths(loadpaths.equal_area_directions(spark, 32)), os.path.join(out, "paths.json")))


def fractions(spark: SparkSession, n: int, out: str) -> None:
    volume_fractions(_labels(spark, n, 8)[2]).show()


DEMOS = {f.__name__: f for f in (polycrystal, foam, surfaces, unit_cells, spinodal, coarse, resize, correlation, samplers, load_paths, fractions)}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("name", choices=sorted(DEMOS))
    parser.add_argument("-n", type=int, default=32)
    parser.add_argument("-o", "--out", default="demo_output")
    args = parser.parse_args(argv)
    os.makedirs(args.out, exist_ok=True)
    DEMOS[args.name](local_session(), args.n, args.out)


if __name__ == "__main__":
    main()
