"""Distributed FFTs, autocorrelation, correlation lengths and spinodal structures.

A 3-D transform is two steps: 2-D transforms of whole planes i, then 1-D transforms along i of whole pencils j. Each is
one shuffle, and a task holds one plane. The axes of an autocorrelation need 1-D transforms of their lines alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stages import cut
from .blocks import Blocks, Window, each_block
from .fractions import quantile, standardised
from .grids import UNIT, Lengths, Shape, voxel_grid

_COMPLEX = "i int, j int, k int, re double, im double"


def _table(i, j, k, values: np.ndarray) -> pa.Table:
    return pa.table({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "k": pa.array(k.ravel(), pa.int32()), "re": values.real.ravel(), "im": values.imag.ravel()})


def _dense(rows: pa.Table, first: str, second: str, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, complex)
    out[rows[first].to_numpy(), rows[second].to_numpy()] = rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
    return out


def fft3(field: DataFrame, shape: Shape, inverse: bool = False) -> DataFrame:
    """(i, j, k, re, im): transform of a complex field with these columns (missing voxels are 0)."""
    nx, ny, nz = shape

    def planes(rows: pa.Table) -> pa.Table:
        plane = _dense(rows, "j", "k", (ny, nz))
        out = np.fft.ifft2(plane) if inverse else np.fft.fft2(plane)
        j, k = np.meshgrid(np.arange(ny), np.arange(nz), indexing="ij")
        return _table(np.full(j.shape, rows["i"][0].as_py()), j, k, out)

    def pencils(rows: pa.Table) -> pa.Table:
        sheet = _dense(rows, "i", "k", (nx, nz))
        out = np.fft.ifft(sheet, axis=0) if inverse else np.fft.fft(sheet, axis=0)
        i, k = np.meshgrid(np.arange(nx), np.arange(nz), indexing="ij")
        return _table(i, np.full(i.shape, rows["j"][0].as_py()), k, out)

    flat = field.select(*[F.col(c).cast("int").alias(c) for c in "ijk"], F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    return flat.groupBy("i").applyInArrow(planes, _COMPLEX).groupBy("j").applyInArrow(pencils, _COMPLEX)


def real_field(voxels: DataFrame, value: str) -> DataFrame:
    return voxels.select("i", "j", "k", F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im"))


def autocorrelation3(voxels: DataFrame, shape: Shape, value: str = "label") -> DataFrame:
    """(i, j, k, r): normalised autocorrelation at every shift; null for a constant image."""
    n = math.prod(shape)
    moments = voxels.agg(F.avg(F.col(value).cast("double")).alias("c1"), F.avg(F.col(value).cast("double") * F.col(value).cast("double")).alias("c2"))
    power = fft3(real_field(voxels, value), shape).select("i", "j", "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("re"), F.lit(0.0).alias("im"))
    back = fft3(power, shape, inverse=True).crossJoin(F.broadcast(moments))
    spread = F.col("c2") - F.col("c1") * F.col("c1")
    return back.select("i", "j", "k", F.when(spread > 0, (F.col("re") / n - F.col("c1") * F.col("c1")) / spread).alias("r"))


#: Lines along each of the other axes that are transformed together.
PENCIL = 16


def axis_autocorrelation(voxels: DataFrame, shape: Shape, value: str = "label") -> DataFrame:
    """(axis, lag, r) for lags 0 to N/2 - 1 along x, y and z: averages of products on the same line.

    Lines are dealt out in pencils, blocks as long as the axis; a pencil's products at all lags are the back transform of its
    lines' summed power spectra, N log N a line. Sums of whole-numbered images are rounded to the whole numbers that they are.
    Null for a constant image; missing voxels are 0. The image is written once.
    """
    v = F.col(value).cast("double")
    rows = cut(voxels.select("i", "j", "k", v.alias("_v")), "image")
    moments = F.broadcast(rows.agg(F.avg("_v").alias("c1"), F.avg(F.col("_v") * F.col("_v")).alias("c2")))
    spread = F.col("c2") - F.col("c1") * F.col("c1")
    out = None
    for a, (axis, n) in enumerate(zip("xyz", shape, strict=True)):
        lags = max(n // 2, 1)

        def pencil(w: Window, a: int = a, n: int = n, lags: int = lags) -> pa.RecordBatch:
            lines = np.moveaxis(w.at((0, 0, 0))[0], a, 0).reshape(n, -1)
            power = (np.abs(np.fft.rfft(lines, axis=0)) ** 2).sum(axis=1)
            sums = np.fft.irfft(power, n)[:lags]
            if (lines == np.rint(lines)).all():
                sums = np.rint(sums)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(lags), pa.int32()), pa.array(sums)], ["lag", "s"])

        sides = tuple(n if axis == b else PENCIL for b in "xyz")
        sums = each_block(rows, Blocks(shape, sides=sides), "_v", "<f8", pencil, "lag int, s double").groupBy("lag").agg((F.sum("s") / math.prod(shape)).alias("p"))
        own = sums.crossJoin(moments).select(F.lit(axis).alias("axis"), "lag", F.when(spread > 0, (F.col("p") - F.col("c1") * F.col("c1")) / spread).alias("r"))
        out = own if out is None else out.unionByName(own)
    return out


def fit_decay(lags: np.ndarray, r: np.ndarray, start: float = 10.0) -> float:
    """Length l >= 0 that fits exp(-x / l) to r in the least-squares sense: damped Gauss-Newton in l."""
    length, damping = start, 1e-3
    cost = lambda x: float(((r - np.exp(-lags / x)) ** 2).sum())
    now = cost(length)
    for _ in range(200):
        e = np.exp(-lags / length)
        slope = e * lags / length**2
        step = float((slope * (r - e)).sum()) / (float((slope * slope).sum()) * (1 + damping) + 1e-300)
        new = max(length + step, length / 4, 1e-6)
        after = cost(new)
        if after <= now:
            done = abs(new - length) < 1e-12 * length
            length, now, damping = new, after, damping / 3
            if done:
                break
        else:
            damping = max(damping, 1e-6) * 10
            if damping > 1e12:
                break
    return length


def correlation_lengths(voxels: DataFrame, shape: Shape, value: str = "label") -> DataFrame:
    """(axis, length, aspect): decay length of each axis and its whole multiple of the least one."""
    series = axis_autocorrelation(voxels, shape, value).where("r is not null")

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("lag")
        return pa.table({"axis": rows["axis"].slice(0, 1), "length": pa.array([fit_decay(rows["lag"].to_numpy().astype(float), rows["r"].to_numpy())])})

    fits = series.groupBy("axis").applyInArrow(fit, "axis string, length double")
    least = fits.agg(F.min("length").alias("_least"))
    return fits.crossJoin(F.broadcast(least)).select("axis", "length", F.floor(F.col("length") / F.col("_least")).alias("aspect"))


def wave_number(index: Column, n: int, length: float) -> Column:
    """Angular frequency of an FFT index, in the order of the transform."""
    signed = F.when(index < (n + 1) // 2, index).otherwise(index - n)
    return signed * (2.0 * math.pi / length)


def band_pass(shape: Shape, wavenumber: Sequence[float], sigma: float, lengths: Lengths = UNIT, rotation: Sequence[Sequence[float]] | None = None) -> Column:
    """Gaussian weight about 1 of the wave vector's length in ellipsoidal units, after an optional rotation."""
    k = [wave_number(F.col(c), n, length) for c, n, length in zip("ijk", shape, lengths, strict=True)]
    if rotation is not None:
        k = [sum((k[b] * float(rotation[a][b]) for b in (1, 2)), k[0] * float(rotation[a][0])) for a in range(3)]
    scaled = [q / (2.0 * math.pi * w / length) for q, w, length in zip(k, wavenumber, lengths, strict=True)]
    off = F.sqrt(scaled[0] * scaled[0] + scaled[1] * scaled[1] + scaled[2] * scaled[2]) - 1.0
    return F.exp(-0.5 * (off / sigma) * (off / sigma))


def noise(spark: SparkSession, shape: Shape, seed: int = 42, stream: str = "hash") -> DataFrame:
    """(i, j, k, re, im): standard normal noise.

    ``hash`` is a Box-Muller transform of hashes of the voxel, the same for any size and partitioning; ``numpy`` is NumPy's
    legacy stream for the seed, made on the driver.
    """
    if stream not in ("hash", "numpy"):
        raise ValueError(f"unknown stream {stream!r}")
    if stream == "numpy":
        values = np.random.RandomState(seed).randn(*shape).astype(np.float32).astype(float)
        i, j, k = np.indices(shape)
        return spark.createDataFrame(_table(i, j, k, values.astype(complex)))
    unit = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "i", "j", "k"), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    value = F.sqrt(-2.0 * F.log(unit("r"))) * F.cos(2.0 * math.pi * unit("a"))
    return voxel_grid(spark, shape).select("i", "j", "k", value.alias("re"), F.lit(0.0).alias("im"))


def spinodal_field(spark: SparkSession, shape: Shape, wavenumber: Sequence[float] = (6.0, 6.0, 6.0), sigma: float = 0.5, seed: int = 42, lengths: Lengths = UNIT, rotation=None, stream: str = "hash") -> DataFrame:
    """(i, j, k, f): band-passed noise, standardised."""
    weight = band_pass(shape, wavenumber, sigma, lengths, rotation)
    filtered = fft3(noise(spark, shape, seed, stream), shape).select("i", "j", "k", (F.col("re") * weight).alias("re"), (F.col("im") * weight).alias("im"))
    return standardised(fft3(filtered, shape, inverse=True).select("i", "j", "k", F.col("re").alias("f")), "f")


def at_least_quantile(field: DataFrame, column: str, volume_fraction: float) -> DataFrame:
    """(i, j, k, label): 1 where the field reaches its (1 - volume fraction) quantile."""
    bound = quantile(field, column, 1.0 - volume_fraction).first()["threshold"]
    return field.select("i", "j", "k", (F.col(column) >= F.lit(bound)).cast("int").alias("label"))


def spinodal_image(spark: SparkSession, shape: Shape, volume_fraction: float = 0.5, **options) -> DataFrame:
    """(i, j, k, label): two-phase spinodal structure with the given share of phase 1."""
    # the quantile and the image read the field: it is written rather than transformed again
    return at_least_quantile(cut(spinodal_field(spark, shape, **options), "field"), "f", volume_fraction)
