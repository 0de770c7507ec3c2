"""Dense voxel grids: indices, coordinates, axis order, resizing.

A grid is a DataFrame (i, j, k, ...) made from a range of ids by arithmetic, so it needs no shuffle and its ids are
the same on every run. Three conventions turn an index into a coordinate; they are kept apart on purpose.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Shape = tuple[int, int, int]
Lengths = Sequence[float]
UNIT = (1.0, 1.0, 1.0)


def voxel_grid(spark: SparkSession, shape: Shape, partitions: int | None = None) -> DataFrame:
    """(i, j, k) of every voxel, last axis fastest."""
    nx, ny, nz = shape
    ids = spark.range(0, nx * ny * nz, 1, partitions) if partitions else spark.range(nx * ny * nz)
    plane = ny * nz
    return ids.select(F.floor(F.col("id") / plane).cast("int").alias("i"), (F.floor(F.col("id") / nz) % ny).cast("int").alias("j"), (F.col("id") % nz).cast("int").alias("k"))


def cell_centre(index: Column, n: int, length: float = 1.0) -> Column:
    return (index + F.lit(0.5)) * length / n


def periodic_node(index: Column, n: int, length: float = 1.0) -> Column:
    return index * F.lit(float(length)) / n


def closed_node(index: Column, n: int, length: float = 1.0) -> Column:
    return index * F.lit(float(length)) / (n - 1)


def permute_axes(voxels: DataFrame, order: str) -> DataFrame:
    """Between xyz and zyx order: the outer axes change names, nothing moves."""
    if order not in ("xyz", "zyx"):
        raise ValueError(f"order must be 'xyz' or 'zyx', not {order!r}")
    if order == "xyz":
        return voxels
    rest = [c for c in voxels.columns if c not in ("i", "j", "k")]
    return voxels.select(F.col("k").alias("i"), "j", F.col("i").alias("k"), *rest)


def flip_vectors(value: Column) -> Column:
    """Components of vectors reversed; arrays of any other length stay."""
    return F.when(F.size(value) == 3, F.reverse(value)).otherwise(value)


def target_shape(shape: Shape, scale: float | Sequence[float] | None = None, resolution: Shape | None = None) -> Shape:
    """``scale`` wins over ``resolution``; neither doubles the image."""
    if scale is None and resolution is None:
        scale = 2
    if scale is not None:
        each = [scale] * 3 if isinstance(scale, int | float) else list(scale)
        return tuple(max(1, round(n * s)) for n, s in zip(shape, each, strict=True))
    return tuple(resolution)


def resize_nearest(voxels: DataFrame, shape: Shape, target: Shape) -> DataFrame:
    """Each target voxel takes the source voxel under its centre: an equi-join on the source index."""
    out = voxel_grid(voxels.sparkSession, target)
    source = [F.least(F.floor((F.col(c) + F.lit(0.5)) * n / m), F.lit(n - 1)).cast("int").alias(f"_{c}") for c, n, m in zip("ijk", shape, target, strict=True)]
    wanted = out.select("i", "j", "k", *source)
    held = voxels.select(*[F.col(c).alias(f"_{c}") for c in "ijk"], *[c for c in voxels.columns if c not in ("i", "j", "k")])
    return wanted.join(held, ["_i", "_j", "_k"]).drop("_i", "_j", "_k")


def check_divisible(shape: Shape, blocks: Shape) -> None:
    if any(n % m for n, m in zip(shape, blocks, strict=True)):
        raise ValueError(f"{shape} is no multiple of {blocks}")


def fill_grid(spark: SparkSession, shape: Shape, values: DataFrame, column: str, fill: float | int) -> DataFrame:
    """``values`` (i, j, k, column) on the complete grid, missing voxels filled (-1 for integers, 0 for floats)."""
    return voxel_grid(spark, shape).join(values, ["i", "j", "k"], "left").select("i", "j", "k", F.coalesce(F.col(column), F.lit(fill)).alias(column))


def infer_grid(cells: DataFrame, x: str = "x", y: str = "y", z: str = "z", digits: int = 9) -> DataFrame:
    """Grid indices of scattered cell centres: the rank of each rounded coordinate among the distinct ones of its axis.

    Ranks are computed on the distinct coordinates only (one row per plane) and joined back.
    """
    from pyspark.sql import Window

    for name, index in ((x, "i"), (y, "j"), (z, "k")):
        rounded = cells.withColumn("_at", F.round(name, digits))
        axis = rounded.select("_at").distinct().withColumn(index, (F.row_number().over(Window.orderBy("_at")) - 1).cast("int"))
        cells = rounded.join(axis, "_at").drop("_at")
    return cells
