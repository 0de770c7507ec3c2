"""Triply periodic minimal surfaces on a grid: field, image, and thresholds for a target volume fraction."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tpms import SURFACES, Angle3
from ..stages import cut, drop_stage
from .grids import UNIT, Lengths, Shape, periodic_node, voxel_grid
from .order import order_statistics


def as_columns(surface: Callable) -> Angle3:
    """A function of three columns, out of one of columns or of NumPy arrays.

    A callable that makes a column of columns is taken as it is and stays in the JVM. One that can't (NumPy refuses columns)
    becomes an Arrow function: it gets the angles of a batch as arrays and returns an array of their length, or one number.
    """

    def evaluate(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        angles = [np.asarray(v, float) for v in (x, y, z)]
        found = np.asarray(surface(*angles), float)
        if found.shape not in ((), angles[0].shape):
            raise ValueError(f"a surface must return one value for each point, not an array of shape {found.shape}")
        return pa.array(np.broadcast_to(found, angles[0].shape).copy())

    def make(x: Column, y: Column, z: Column) -> Column:
        try:
            found = surface(x, y, z)
        except (TypeError, AttributeError):
            found = None
        return found if isinstance(found, Column) else F.arrow_udf(evaluate, "double")(x, y, z)

    return make


def raw_field(spark: SparkSession, surface: str | Callable, shape: Shape, lengths: Lengths = UNIT, frequency: int | tuple[int, int, int] = 1) -> DataFrame:
    """(i, j, k, f): the level-set function at periodic nodes, angles 2 pi x frequency / L; ``surface`` is a name, or a callable
    of three columns or of three NumPy arrays (``as_columns``)."""
    make = SURFACES[surface] if isinstance(surface, str) else as_columns(surface)
    each = (frequency,) * 3 if isinstance(frequency, int) else frequency
    angles = [periodic_node(F.col(c), n, length) * (2.0 * math.pi * q) / length for c, n, length, q in zip("ijk", shape, lengths, each, strict=True)]
    return voxel_grid(spark, shape).withColumn("f", make(*angles))


def normalised(field: DataFrame, column: str = "f", digits: int | None = 9) -> DataFrame:
    """``column`` mapped to [0, 1] by its least and greatest value (one row, joined back).

    0 wherever the column is constant; the ends are those of the finite values, infinite ones map to 0 and 1; null and NaN stay.
    """
    finite = F.when(F.abs(column) < float("inf"), F.col(column))
    ends = field.agg(F.min(finite).alias("_low"), F.max(finite).alias("_high"))
    share = F.try_divide(F.col(column) / 2.0 - F.col("_low") / 2.0, F.col("_high") / 2.0 - F.col("_low") / 2.0)
    kept = F.col(column).isNull() | F.isnan(F.col(column).cast("double"))
    value = F.when(kept, F.col(column).cast("double")).when(F.col(column) == float("inf"), F.lit(1.0)).when(F.col(column) == float("-inf"), F.lit(0.0)).otherwise(F.coalesce(share, F.lit(0.0)))
    return field.crossJoin(F.broadcast(ends)).withColumn(column, F.round(value, digits) if digits is not None else value).drop("_low", "_high")


def tpms_field(spark: SparkSession, surface: str | Callable, shape: Shape, lengths: Lengths = UNIT, frequency: int | tuple[int, int, int] = 1) -> DataFrame:
    """The field in [0, 1], rounded to nine digits so that later comparisons don't hang on the last bit."""
    return normalised(raw_field(spark, surface, shape, lengths, frequency))


def phase(f: Column, threshold: float = 0.5, mode: str = "solid", shell_thickness: float = 0.1, invert: bool = False) -> Column:
    """0/1 image of a field: ``solid`` above the threshold, ``shell`` within the thickness of it."""
    if mode == "solid":
        inside = f > threshold
    elif mode == "shell":
        inside = F.abs(f - threshold) < abs(shell_thickness)
    else:
        raise ValueError(f"mode must be 'solid' or 'shell', not {mode!r}")
    return F.when(~inside if invert else inside, F.lit(1)).otherwise(F.lit(0))


def kth_value(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k-th smallest value (from 0) as one row ``value``, without sorting the rows."""
    return df.sparkSession.createDataFrame([(order_statistics(df, column, [k])[0],)], "value double")


def threshold_for_fraction(field: DataFrame, n: int, target: float) -> DataFrame:
    """One row ``threshold`` (``field`` is read once): the k-th smallest field value with k = round((1 - target) n), kept within range."""
    k = min(max(math.floor((1 - target) * n + 0.5), 0), n - 1)
    return kth_value(field, "f", k).withColumnRenamed("value", "threshold")


def shell_thickness_for_fraction(field: DataFrame, threshold: float, target: float, tol: float = 1e-3, max_iter: int = 30) -> float:
    """Half-thickness whose shell holds ``target`` of the voxels, by bisection over one aggregate a step."""
    distance = field.select(F.abs(F.col("f") - threshold).alias("d"))
    distance = cut(distance, "distance")
    try:
        low, high, middle = 0.0, distance.agg(F.max("d")).first()[0], 0.0
        for _ in range(max_iter):
            middle = (low + high) / 2
            got = distance.agg(F.avg((F.col("d") < middle).cast("double"))).first()[0]
            if abs(got - target) < tol:
                break
            low, high = (middle, high) if got < target else (low, middle)
        return middle
    finally:
        drop_stage(distance)


def exact_shell_thickness(field: DataFrame, n: int, threshold: float, target: float) -> DataFrame:
    """One row ``thickness``: the order statistic of the distance to the threshold that bisection approaches."""
    distance = field.select(F.round(F.abs(F.col("f") - threshold), 9).alias("d"))
    k = min(max(math.floor(target * n + 0.5), 0), n - 1)
    return kth_value(distance, "d", k).withColumnRenamed("value", "thickness")
