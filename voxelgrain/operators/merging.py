"""Points that are equal within a tolerance: pairs from shared bins, and their connected components.

Rounding parts points that straddle a rounding border; here any two points nearer than the tolerance are one, and so are chains
of such. A bin is many tolerances wide, and a point enters further bins only where it lies within the tolerance of a border, so
a point is sent little more than once. The points of one bin meet pairwise: bins are meant to hold the copies of a few
places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import cut, drop_stage
from .order import numbered

#: Width of a bin in tolerances.
BIN = 16


def near_pairs(points: DataFrame, ident: str, columns: Sequence[str], tolerance: float, binned: int = 3) -> DataFrame:
    """(a, b), a < b: pairs of rows whose ``columns`` each differ by ``tolerance`` at most; bins are made of the first ``binned``."""
    width = BIN * tolerance
    rows = points.select(F.col(ident).alias("id"), *[F.col(c).alias(f"c{n}") for n, c in enumerate(columns)])
    keys = []
    for n in range(min(binned, len(columns))):
        low, high = (F.floor((F.col(f"c{n}") + s * tolerance) / width) for s in (-1, 1))
        rows = rows.withColumn(f"k{n}", F.explode(F.sequence(low, high)))
        keys.append(f"k{n}")
    names = [c for c in rows.columns if c not in keys]
    other = rows.select(*keys, *[F.col(c).alias(f"o{c}") for c in names])
    near = F.col("id") < F.col("oid")
    for n in range(len(columns)):
        near = near & (F.abs(F.col(f"c{n}") - F.col(f"oc{n}")) <= tolerance)
    return rows.join(other, keys).where(near).select(F.col("id").alias("a"), F.col("oid").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (a, b): the least node of its component.

    Large-star and small-star steps by turns: every node's larger neighbours, then its smaller ones, move to its least one.
    Rounds grow with the logarithm of a component's size; each is written, and none holds more rows than there are edges.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        # large star: v > u joins the least of u's neighbourhood, u itself included
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # small star: u and its smaller neighbours join the least of these
        large = large.distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(floor.select("a", F.col("m").alias("b")))
        after = cut(small.where("a <> b").distinct(), "edges", slim=True)
        new = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop_stage(now)
        now = after
        if new == mark:
            break
        mark = new
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def merged(points: DataFrame, columns: Sequence[str], tolerance: float, binned: int = 3) -> DataFrame:
    """Distinct rows of ``columns`` with ``_root``: one number for all rows that are equal within the tolerance, or by a chain of
    such; the number is that of the least row in the order of ``columns``."""
    known = cut(numbered(points.select(*columns).distinct(), list(columns), "_id"), "points")
    roots = connected_components(near_pairs(known, "_id", columns, tolerance, binned)).withColumnRenamed("id", "_id")
    return known.join(roots, "_id", "left").select(*columns, F.coalesce("root", "_id").alias("_root"), "_id")
