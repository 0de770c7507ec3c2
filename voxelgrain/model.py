"""Schemas of the engine's tables, and an image as voxels with a header."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .operators.fractions import volume_fractions
from .operators.grids import permute_axes, resize_nearest, target_shape

VOXELS = "i int, j int, k int, label int"
IMAGES = "image_id string, nx int, ny int, nz int, lx double, ly double, lz double, metadata map<string, string>"
FIELD = "i int, j int, k int, f double"
SEEDS = "seed_id int, x double, y double, z double, frame array<array<double>>"
FACES = "seed_a long, seed_b long, ox int, oy int, oz int, nx double, ny double, nz double, distance double, area double, verts array<struct<x: double, y: double, z: double>>"
NEIGHBOURS = "seed_id long, neighbours array<long>"
BOUNDARIES = "gb_tag long, nx double, ny double, nz double, crystal_a long, crystal_b long"
COMPOSITES = "bi int, bj int, bk int, elem long, coarse int, phases array<struct<material: int, fraction: double>>"
LATTICE_VERTICES = "v int, x double, y double, z double"
LATTICE_EDGES = "e int, a int, b int"
RESULTS = "microstructure string, load_case string, time_step int, quantity string, point_id long, value array<double>"
STIFFNESS = "id long, c array<double>"
LOAD_PATHS = "path_id int, step int, e array<double>"
DATASETS = "file string, file_ord int, path string, shape array<int>, dtype string, attrs map<string, string>"


def from_array(spark: SparkSession, array: np.ndarray, column: str = "label") -> DataFrame:
    """(i, j, k, column) of an array in memory, a slab per batch."""
    if array.ndim != 3:
        raise ValueError("an image has three axes")
    kind = pa.int32() if array.dtype.kind in "iub" else pa.float64()
    i, j, k = np.indices(array.shape, np.int32)
    return spark.createDataFrame(pa.table({"i": i.ravel(), "j": j.ravel(), "k": k.ravel(), column: pa.array(array.ravel()).cast(kind)}))


def to_array(voxels: DataFrame, shape: Sequence[int], column: str = "label") -> np.ndarray:
    """The dense array of an image that fits in the driver; voxels that are missing are 0."""
    rows = voxels.select("i", "j", "k", column).toArrow()
    values = rows[column].to_numpy()
    out = np.zeros(tuple(shape), values.dtype)
    out[tuple(rows[c].to_numpy() for c in "ijk")] = values
    return out


@dataclass(frozen=True)
class Image:
    """Voxels and their header; every change gives a new image."""

    voxels: DataFrame
    shape: tuple[int, int, int]
    lengths: tuple[float, float, float] = (1.0, 1.0, 1.0)
    metadata: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, array: np.ndarray, lengths: Sequence[float] = (1.0, 1.0, 1.0), metadata: dict[str, str] | None = None) -> Image:
        return cls(from_array(spark, array), tuple(array.shape), tuple(map(float, lengths)), dict(metadata or {}))

    @classmethod
    def read(cls, spark: SparkSession, path: str, image_id: str) -> Image:
        from .sources.parquet import read_image

        voxels, header = read_image(spark, path, image_id)
        return cls(voxels, tuple(header["shape"]), tuple(header["lengths"]), dict(header["metadata"]))

    def write(self, path: str, image_id: str, order: str = "zyx") -> None:
        from .sources.parquet import write_image

        write_image(self.voxels, path, image_id, self.shape, self.lengths, self.metadata, order)

    def fractions(self) -> DataFrame:
        return volume_fractions(self.voxels)

    def reversed_axes(self) -> Image:
        return Image(permute_axes(self.voxels, "zyx"), self.shape[::-1], self.lengths[::-1], self.metadata)

    def resized(self, scale=None, resolution=None) -> Image:
        target = target_shape(self.shape, scale, resolution)
        return Image(resize_nearest(self.voxels, self.shape, target), target, self.lengths, self.metadata)

    def array(self) -> np.ndarray:
        return to_array(self.voxels, self.shape)
