"""What plots need, as DataFrames: planes, fitted series, lines, panels. Rendering is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grids import Shape
from .raster import struts_of
from .results import subplot_layout


def middle_planes(voxels: DataFrame, shape: Shape, value: str = "label") -> DataFrame:
    """axis, u, v, value on the three planes through the middle; the filters reach the scan."""
    out = None
    for axis, index, n in zip("xyz", "ijk", shape, strict=True):
        u, v = [c for c in "ijk" if c != index]
        plane = voxels.where(F.col(index) == n // 2).select(F.lit(axis).alias("axis"), F.col(u).alias("u"), F.col(v).alias("v"), F.col(value).alias("value"))
        out = plane if out is None else out.unionByName(plane)
    return out


def decay_series(series: DataFrame, fits: DataFrame) -> DataFrame:
    """axis, lag, r and the fitted exp(-lag / length)."""
    joined = series.join(F.broadcast(fits.select("axis", "length")), "axis")
    return joined.select("axis", "lag", "r", F.exp(-F.col("lag") / F.col("length")).alias("fitted"))


def lattice_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """e and the two ends of each strut."""
    return struts_of(vertices, edges).select("e", *[f"{end}{c}" for end in "ab" for c in "xyz"])


def panels(series: dict[str, DataFrame], x: str, y: str) -> DataFrame:
    """title, row, column, x, y: named series placed on a grid of plots, in the order given."""
    if not series:
        raise ValueError("there must be at least one series")
    _, columns = subplot_layout(len(series))
    out = None
    for n, (title, df) in enumerate(series.items()):
        own = df.select(F.lit(title).alias("title"), F.lit(n // columns).alias("row"), F.lit(n % columns).alias("column"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        out = own if out is None else out.unionByName(own)
    return out


def faces_within(faces: DataFrame, vertices: DataFrame, key: Sequence[str] = ("seed_a", "seed_b", "ox", "oy", "oz"), digits: int = 9) -> DataFrame:
    """Keys of the faces all of whose vertices are among ``vertices`` (x, y, z, to nine digits)."""
    at = [F.round(F.col(f"p.{c}"), digits).alias(c) for c in "xyz"]
    points = faces.select(*key, F.explode("verts").alias("p")).select(*key, *at)
    held = vertices.select(*[F.round(c, digits).alias(c) for c in "xyz"]).distinct().withColumn("_in", F.lit(True))
    whole = points.join(held, ["x", "y", "z"], "left").groupBy(*key).agg(F.every(F.coalesce("_in", F.lit(False))).alias("_all"))
    return whole.where("_all").drop("_all")


def bounding_boxes(faces: DataFrame) -> DataFrame:
    """Faces with the least and greatest coordinate of their vertices."""
    return faces.select("*", *[f(F.col(f"verts.{c}")).alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.array_min), ("high", F.array_max))])
