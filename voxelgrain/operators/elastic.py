"""Elastic tensors: bounds, definiteness, and directional stiffness."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _matrices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The whole tensors of a column as matrices, and which rows hold one (36 finite entries, none of them null)."""
    rows = column.to_pylist()
    held = np.array([r is not None and len(r) == 36 and all(x is not None and math.isfinite(x) for x in r) for r in rows], bool)
    return np.array([r for r, h in zip(rows, held, strict=True) if h], float).reshape(-1, 6, 6), held


def _placed(values: list, held: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values at the rows that hold a tensor, null elsewhere."""
    rest = iter(values)
    return pa.array([next(rest) if h else None for h in held], kind)


def _inverses(c: np.ndarray) -> list:
    """Inverses, None where a matrix has none to working precision."""
    size = np.abs(c).max(axis=(1, 2), initial=0)
    scaled = c / np.where(size > 0, size, 1)[:, None, None]
    fine = (size > 0) & (np.linalg.svd(scaled, compute_uv=False)[:, -1] > 1e-14) if len(c) else np.zeros(0, bool)
    out = np.linalg.inv(scaled[fine]) / size[fine][:, None, None]
    rest = iter(out.reshape(-1, 36))
    return [next(rest) if f else None for f in fine]


def inverse(stiffness: DataFrame, column: str = "c", out: str = "s") -> DataFrame:
    """``stiffness`` with the inverse of each 6 x 6 tensor; null where it is singular, null, or not 36 finite entries."""
    names = stiffness.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, held = _matrices(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, _placed(_inverses(c), held, pa.list_(pa.float64()))], [*names, out])

    fields = ", ".join(f"`{n}` {t}" for n, t in stiffness.dtypes)
    return stiffness.mapInArrow(run, f"{fields}, {out} array<double>")


def _weighted_mean(df: DataFrame, column: str, weight: str, keys: list[str]) -> DataFrame:
    """Entry by entry mean of arrays: exploded, summed with map-side combination, gathered again."""
    parts = df.select(*keys, F.col(weight).alias("_w"), F.posexplode(column).alias("_p", "_v"))
    sums = parts.groupBy(*keys, "_p").agg(F.sum(F.col("_w") * F.col("_v")).alias("_v"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda x: x["_v"]).alias("c"))


def voigt_bound(stiffness: DataFrame, fraction: str = "fraction", column: str = "c", keys: list[str] | None = None) -> DataFrame:
    """Upper bound: the mean of the stiffnesses, weighted by volume fraction."""
    return _weighted_mean(stiffness, column, fraction, keys or [])


def reuss_bound(stiffness: DataFrame, fraction: str = "fraction", column: str = "c", keys: list[str] | None = None) -> DataFrame:
    """Lower bound: the inverse of the mean of the compliances.

    Null where a phase of a positive fraction has no inverse (what is infinitely soft in some way bounds nothing) or the mean has
    none; phases of no fraction don't count.
    """
    keys = keys or []
    stiffness = stiffness.where(F.col(fraction) != 0)
    whole = inverse(stiffness, column, "_s").groupBy(*keys).agg(F.min(F.col("_s").isNotNull()).alias("_whole"))
    mean = _weighted_mean(inverse(stiffness, column, "_s"), "_s", fraction, keys)
    bound = inverse(mean, "c", "_c").drop("c")
    marked = bound.join(whole, keys) if keys else bound.crossJoin(F.broadcast(whole))
    return marked.withColumn("c", F.when(F.col("_whole"), F.col("_c"))).drop("_c", "_whole")


def definiteness(stiffness: DataFrame, column: str = "c") -> DataFrame:
    """``stiffness`` with ``spd`` (symmetric and all eigenvalues positive) and ``eigenvalues`` (ascending); both null where there
    aren't 36 finite entries."""
    names = stiffness.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, held = _matrices(batch.column(at))
            t = c.transpose(0, 2, 1)
            symmetric = (np.abs(c - t) <= 1e-8 + 1e-5 * np.abs(t)).all(axis=(1, 2))
            values = np.linalg.eigvalsh(c)
            spd = (symmetric & (values > 0).all(axis=1)).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, _placed(spd, held, pa.bool_()), _placed(list(values), held, pa.list_(pa.float64()))], [*names, "spd", "eigenvalues"])

    fields = ", ".join(f"`{n}` {t}" for n, t in stiffness.dtypes)
    return stiffness.mapInArrow(run, f"{fields}, spd boolean, eigenvalues array<double>")


def direction_grid(spark: SparkSession, thetas: int = 180, phis: int = 360) -> DataFrame:
    """t, p, theta, phi, x, y, z: directions at inclusive polar and azimuth angles."""
    at = spark.range(thetas * phis).select(F.floor(F.col("id") / phis).cast("int").alias("t"), (F.col("id") % phis).cast("int").alias("p"))
    at = at.withColumns({"theta": F.col("t") * (math.pi / (thetas - 1)), "phi": F.col("p") * (2.0 * math.pi / (phis - 1))})
    return at.withColumns({"x": F.sin("theta") * F.cos("phi"), "y": F.sin("theta") * F.sin("phi"), "z": F.cos("theta")})


def youngs_modulus(stiffness: DataFrame, directions: DataFrame, column: str = "c") -> DataFrame:
    """Rows of ``stiffness`` (without the tensor) for each direction with ``E`` and the surface point sx, sy, sz.

    One inverse per tensor; the quadratic form of the direction is a column expression. E is null where a tensor has no inverse.
    """
    names = [n for n in stiffness.columns if n != column]
    s = inverse(stiffness, column, "_s").select(*names, "_s")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    r = math.sqrt(2.0)
    n = [x * x, y * y, z * z, r * x * y, r * x * z, r * y * z]
    form = None
    for i in range(6):
        for j in range(6):
            term = n[i] * F.get("_s", 6 * i + j) * n[j]
            form = term if form is None else form + term
    pairs = s.crossJoin(directions).withColumn("E", F.try_divide(F.lit(1.0), form))
    return pairs.select(*names, *[c for c in directions.columns if c not in names], "E", *[(F.col(c) * F.col("E")).alias(f"s{c}") for c in "xyz"])
