"""Seed points of tessellations: random, low-discrepancy and lattice arrangements, and random orientations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .order import numbered

METHODS = ("random", "lhs-lloyd", "halton", "halton-scrambled", "sobol", "honeycomb", "rubiks-cube", "diamond")


def factorise(n: int, dim: int) -> list[int]:
    """``n`` as a product of ``dim`` factors that are about equal, largest first."""
    if dim < 1:
        raise ValueError("dim must be at least 1")
    primes, rest, p = [], n, 2
    while rest > 1:
        while rest % p == 0:
            primes.append(p)
            rest //= p
        p += 1
        if p * p > rest > 1:
            primes.append(rest)
            break
    factors = [1] * dim
    for prime in sorted(primes, reverse=True):
        least = factors.index(min(factors))
        factors[least] *= prime
    return sorted(factors, reverse=True)


def _numbered(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("seed_id"))


def random_seeds(spark: SparkSession, n: int, lengths: Sequence[float], seed: int = 0) -> DataFrame:
    """Uniform points from a hash of (seed, id, axis): the same for any partitioning."""
    unit = lambda axis: F.pmod(F.xxhash64(F.lit(seed), "seed_id", F.lit(axis)), F.lit(1 << 53)) / float(1 << 53)
    return _numbered(spark, n).select("seed_id", *[(unit(a) * length).alias(c) for a, (c, length) in enumerate(zip("xyz", lengths, strict=True))])


def radical_inverse(index: Column, base: int, digits: int) -> Column:
    """Digits of ``index`` in ``base``, mirrored at the point."""
    value, rest, weight = F.lit(0.0), index, 1.0 / base
    for _ in range(digits):
        value = value + F.pmod(rest, F.lit(base)) * weight
        rest = F.floor(rest / base)
        weight /= base
    return value


def halton_permutations(seed: int) -> list[list[list[int]]]:
    """For each axis, what each digit of an index becomes, lowest digit first; as many digits as a double holds."""
    rng = np.random.default_rng(seed)
    return [[rng.permutation(base).tolist() for _ in range(math.ceil(54 / math.log2(base)) - 1)] for base in (2, 3, 5)]


def halton_seeds(spark: SparkSession, n: int, lengths: Sequence[float], seed: int | None = None) -> DataFrame:
    """Halton points in bases 2, 3 and 5, from index 0; a seed permutes the digits, leading zeros as well."""
    columns = []
    if seed is not None:
        for c, base, length, axis in zip("xyz", (2, 3, 5), lengths, halton_permutations(seed), strict=True):
            value = F.lit(0.0)
            for d, turned in enumerate(axis):
                digit = F.pmod(F.floor(F.col("seed_id") / base**d), F.lit(base)) if base**d < max(n, 2) else F.lit(0)
                value = value + F.get(F.array(*[F.lit(t) for t in turned]), digit.cast("int")) * base ** -(d + 1.0)
            columns.append((value * length).alias(c))
        return _numbered(spark, n).select("seed_id", *columns)
    for c, base, length in zip("xyz", (2, 3, 5), lengths, strict=True):
        digits = max(1, math.ceil(math.log(max(n, 2)) / math.log(base)) + 1)
        columns.append((radical_inverse(F.col("seed_id"), base, digits) * length).alias(c))
    return _numbered(spark, n).select("seed_id", *columns)


#: Primitive polynomials and first direction numbers of the second and third Sobol dimension.
_SOBOL = {"y": (1, 0, (1,)), "z": (2, 1, (1, 3))}
SOBOL_BITS = 30


def sobol_directions(axis: str, bits: int = SOBOL_BITS) -> list[int]:
    """Direction numbers of an axis, for the lowest bit of the index first."""
    if axis == "x":
        return [1 << (bits - 1 - i) for i in range(bits)]
    degree, middle, first = _SOBOL[axis]
    m = list(first)
    for i in range(degree, bits):
        new = m[i - degree] ^ (m[i - degree] << degree)
        for k in range(1, degree):
            if middle >> (degree - 1 - k) & 1:
                new ^= m[i - k] << k
        m.append(new)
    return [m[i] << (bits - 1 - i) for i in range(bits)]


def sobol_shift(seed: int | None, bits: int = SOBOL_BITS) -> list[int]:
    """Digital shift of each axis; none without a seed."""
    return np.random.default_rng(seed).integers(0, 1 << bits, 3).tolist() if seed is not None else [0, 0, 0]


def sobol_seeds(spark: SparkSession, n: int, lengths: Sequence[float], seed: int | None = None) -> DataFrame:
    """The first ``n`` Sobol points in Gray-code order; a seed adds a digital shift."""
    bits = SOBOL_BITS
    used = max(1, (max(n, 2) - 1).bit_length())
    shift = sobol_shift(seed)
    gray = F.col("seed_id").bitwiseXOR(F.shiftright("seed_id", 1))
    columns = []
    for c, length, moved in zip("xyz", lengths, shift, strict=True):
        value = F.lit(moved)
        for b, v in enumerate(sobol_directions(c)[:used]):
            value = value.bitwiseXOR(F.when(F.shiftright(gray, b).bitwiseAND(F.lit(1)) == 1, F.lit(v)).otherwise(F.lit(0)))
        columns.append((value / float(1 << bits) * length).alias(c))
    return _numbered(spark, n).select("seed_id", *columns)


def lhs_seeds(spark: SparkSession, n: int, lengths: Sequence[float], seed: int = 0, sweeps: int = 8) -> DataFrame:
    """Latin hypercube (each axis a permutation of strata, jittered), relaxed by periodic Lloyd sweeps on samples.

    The relaxation runs in NumPy on the driver, which holds the seeds (``n`` times 24 bytes); samples, 64 a seed, meet them by
    cells.
    """
    from .raster import nearest_seed_kernel

    rng = np.random.default_rng(seed)
    points = (np.stack([rng.permutation(n) for _ in range(3)], axis=1) + rng.random((n, 3))) / n
    for _ in range(sweeps):
        counts, moved = np.zeros(n), np.zeros((n, 3))
        for i in range(0, 64 * n, 65_536):
            samples = rng.random((min(64 * n - i, 65_536), 3))
            owner = nearest_seed_kernel(samples, points, np.arange(n), np.ones(3))
            d = samples - points[owner]
            d -= np.rint(d)
            counts += np.bincount(owner, minlength=n)
            moved += np.stack([np.bincount(owner, d[:, a], n) for a in range(3)], axis=1)
        points = (points + moved / np.maximum(counts, 1)[:, None]) % 1.0
    rows = [(i, *(float(p * length) for p, length in zip(points[i], lengths, strict=True))) for i in range(n)]
    return spark.createDataFrame(rows, "seed_id int, x double, y double, z double")


def lattice_seeds(spark: SparkSession, n: int, lengths: Sequence[float], stagger: bool) -> DataFrame:
    """``n`` points on the most balanced grid; staggered rows shift by half a step in x, staggered layers in x and y."""
    nx, ny, nz = factorise(n, 3)
    a, b, c = lengths[0] / nx, lengths[1] / ny, lengths[2] / nz
    at = spark.range(nx * ny * nz).select(
        F.col("id").cast("int").alias("seed_id"), F.floor(F.col("id") / (ny * nz)).alias("i"), F.pmod(F.floor(F.col("id") / nz), F.lit(ny)).alias("j"), F.pmod("id", F.lit(nz)).alias("k")
    )
    x, y, z = F.col("i") * a, F.col("j") * b, F.col("k") * c
    if stagger:
        odd_row, odd_layer = (F.col("j") % 2).cast("double"), (F.col("k") % 2).cast("double")
        x, y = x + (odd_row + odd_layer) * (a / 2), y + odd_layer * (b / 2)
    return at.select("seed_id", *[F.pmod(v, F.lit(float(length))).alias(name) for name, v, length in zip("xyz", (x, y, z), lengths, strict=True)])


def diamond_seeds(spark: SparkSession, lengths: Sequence[float]) -> DataFrame:
    """Two points: the corner and the centre of the box."""
    return _numbered(spark, 2).select("seed_id", *[(F.col("seed_id") * 0.5 * length).alias(c) for c, length in zip("xyz", lengths, strict=True)])


def voronoi_seeds(spark: SparkSession, n: int, lengths: Sequence[float], method: str = "sobol", seed: int = 0) -> DataFrame:
    """(seed_id, x, y, z) by the named method; two lengths make a plane (z 0)."""
    if not n or n < 1:
        raise ValueError("the number of crystals must be positive")
    if len(lengths) not in (2, 3):
        raise ValueError("a box has two or three lengths")
    box = [*lengths, 1.0][:3]
    make = {
        "random": lambda: random_seeds(spark, n, box, seed),
        "lhs-lloyd": lambda: lhs_seeds(spark, n, box, seed),
        "halton": lambda: halton_seeds(spark, n, box),
        "halton-scrambled": lambda: halton_seeds(spark, n, box, seed),
        "sobol": lambda: sobol_seeds(spark, n, box, seed),
        "honeycomb": lambda: lattice_seeds(spark, n, box, True),
        "rubiks-cube": lambda: lattice_seeds(spark, n, box, False),
        "diamond": lambda: diamond_seeds(spark, box),
    }
    if method not in make:
        raise ValueError(f"unknown sampling method: {method}")
    out = make[method]()
    return out.withColumn("z", F.lit(0.0)) if len(lengths) == 2 else out


def rotation(phi1: Column, big_phi: Column, phi2: Column) -> Column:
    """Rotation matrix of z-x-z Euler angles, as an array of rows."""
    z1 = [[F.cos(phi1), -F.sin(phi1), None], [F.sin(phi1), F.cos(phi1), None]]
    c, s = F.cos(big_phi), F.sin(big_phi)
    c2, s2 = F.cos(phi2), F.sin(phi2)
    # the inner two rotations turn the axes to columns (c2, c s2, s s2), (-s2, c c2, s c2), (0, -s, c)
    inner = [[c2, -s2, F.lit(0.0)], [c * s2, c * c2, -s], [s * s2, s * c2, c]]
    rows = [[z1[r][0] * inner[0][q] + z1[r][1] * inner[1][q] for q in range(3)] for r in range(2)]
    return F.array(*[F.array(*row) for row in [*rows, inner[2]]])


def orientations(df: DataFrame, u: Column, v: Column, w: Column, out: str = "frame") -> DataFrame:
    """Random orientations from three uniforms of [0, 1]: angles 2 pi u, acos(2 v - 1), 2 pi w."""
    return df.withColumn(out, rotation(u * (2 * math.pi), F.acos(v * 2 - 1), w * (2 * math.pi)))


def with_orientations(seeds: DataFrame, seed: int = 0) -> DataFrame:
    unit = lambda axis: F.pmod(F.xxhash64(F.lit(seed), "seed_id", F.lit(axis)), F.lit(1 << 53)) / float(1 << 53)
    return orientations(seeds, unit("u"), unit("v"), unit("w"))


def ghost_seeds(seeds: DataFrame, lengths: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Every seed at its 27 periodic places: seed_id, ox, oy, oz (whole box offsets), x, y, z."""
    steps = F.array(*[F.lit(o) for o in (-1, 0, 1)])
    out = seeds.select("*", F.explode(steps).alias("ox")).select("*", F.explode(steps).alias("oy")).select("*", F.explode(steps).alias("oz"))
    return out.select("seed_id", "ox", "oy", "oz", *[(F.col(c) + F.col(f"o{c}") * float(length)).alias(c) for c, length in zip("xyz", lengths, strict=True)])


#: Rows of each side that meet in one task of ``all_pairs``.
PAIR_ROWS = 4000


def all_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of ``a`` with every row of ``b``, in tasks of at most about ``PAIR_ROWS`` squared pairs each, whatever files the
    rows come from. A task holds ``PAIR_ROWS`` rows; only the two sides are shuffled, no pair is."""
    dealt = [x.repartition(max(1, math.ceil(x.count() / PAIR_ROWS))) for x in (a, b)]
    return dealt[0].hint("shuffle_replicate_nl").crossJoin(dealt[1])


def running_index(df: DataFrame, keys: list[str], start: int = 0, out: str = "index") -> DataFrame:
    """Contiguous numbers from ``start`` for the distinct values of ``keys``, in their order (on the distinct values)."""
    distinct = numbered(df.select(*keys).distinct(), keys, out, start).withColumn(out, F.col(out).cast("int"))
    return df.join(distinct, keys)
