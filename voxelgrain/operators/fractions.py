"""Fractions, histograms and other aggregates of labels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import between, order_statistics


def volume_fractions(voxels: DataFrame, label: str = "label") -> DataFrame:
    """label, voxels, fraction; one partial and one final hash aggregate, the total from the few labels."""
    counts = voxels.groupBy(label).agg(F.count("*").alias("voxels"))
    total = F.sum("voxels").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("fraction", F.round(F.col("voxels") / total, 9))


def binary_fractions(voxels: DataFrame, label: str = "label") -> DataFrame:
    """One row vf0, vf1 of a 0/1 image."""
    share = F.avg(F.col(label).cast("double"))
    return voxels.agg(F.round(1.0 - share, 9).alias("vf0"), F.round(share, 9).alias("vf1"))


def boundary_fraction(voxels: DataFrame, crystals: int, label: str = "label") -> DataFrame:
    """Share of voxels labelled as grain boundary (labels of ``crystals`` or more)."""
    return voxels.agg(F.round(F.avg((F.col(label) >= crystals).cast("double")), 9).alias("fraction"))


def standardised(df: DataFrame, column: str) -> DataFrame:
    """``column`` less its mean, over its population standard deviation.

    0 wherever the column is constant; nulls stay null and are left out of both; with a NaN or an infinite value all are NaN.
    """
    moments = df.agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_std"), (F.min(column) == F.max(column)).alias("_flat"))
    away = F.col(column) - F.col("_mean")
    value = F.when(F.col(column).isNotNull(), F.when(F.col("_flat") & (F.abs(column) < float("inf")), F.lit(0.0)).otherwise(F.try_divide(away, F.col("_std"))))
    return df.crossJoin(F.broadcast(moments)).withColumn(column, value).drop("_mean", "_std", "_flat")


def quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row ``threshold``: the exact quantile, linear between neighbours (null without values).

    Nulls are left out; NaN counts as greater than all numbers (``order_statistics``); ``order.between`` says what lies between
    infinite neighbours.
    """
    n = df.where(F.col(column).isNotNull()).count()
    at = q * max(n - 1, 0)
    low, high = order_statistics(df, column, [math.floor(at), math.ceil(at)]) if n else (None, None)
    value = None if low is None else between(low, high, at - math.floor(at))
    return df.sparkSession.createDataFrame([(value,)], "threshold double")


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin (from 0), n of equal-width bins over the range of the column; the greatest value falls in the last bin.

    Values beyond given bounds go to the end bins. The range is that of the finite values: infinite values go to the end bins as
    well, NaN and null to none. Where the range is one value, that value is in bin 0.
    """
    finite = F.when(F.abs(column) < float("inf"), F.col(column))
    ends = df.agg((F.lit(low) if low is not None else F.min(finite)).cast("double").alias("_low"), (F.lit(high) if high is not None else F.max(finite)).cast("double").alias("_high"))
    # halves, so that no difference of two doubles passes their range
    half = lambda x: x / 2.0
    share = F.try_divide(half(F.col(column)) - half(F.col("_low")), half(F.col("_high")) - half(F.col("_low")))
    inside = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * bins)
    place = F.when(F.col(column) == float("inf"), F.lit(bins - 1)).when(F.col(column) == float("-inf"), F.lit(0)).otherwise(F.coalesce(inside, F.lit(0)))
    placed = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).crossJoin(F.broadcast(ends))
    return placed.select(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def resize_error(before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    """label, error: change of each phase's fraction in per cent of what it was."""
    one = volume_fractions(before, label).select(label, F.col("fraction").alias("_one"))
    two = volume_fractions(after, label).select(label, F.col("fraction").alias("_two"))
    return one.join(two, label, "left").select(label, F.round((F.col("_one") - F.coalesce("_two", F.lit(0.0))) * 100.0 / F.col("_one"), 6).alias("error"))
