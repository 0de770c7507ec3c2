"""Coarse-graining: blocks of voxels become composite voxels with materials, fractions and an interface normal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import cut
from .grids import UNIT, Lengths, Shape, check_divisible
from .stencils import laplacian

Pad = tuple[int, int, int]
_KEYS = ("bi", "bj", "bk")


def _blocked(voxels: DataFrame, shape: Shape, blocks: Shape) -> DataFrame:
    check_divisible(shape, blocks)
    return voxels.withColumns({f"b{c}": F.floor(F.col(c) / (n // m)).cast("int") for c, n, m in zip("ijk", shape, blocks, strict=True)})


def block_phases(voxels: DataFrame, shape: Shape, blocks: Shape, min_fraction: float = 0.0) -> DataFrame:
    """bi, bj, bk, label, fraction of the materials in each block; those under ``min_fraction`` are left out."""
    per_block = int(np.prod([n // m for n, m in zip(shape, blocks, strict=True)]))
    counts = _blocked(voxels, shape, blocks).groupBy("bi", "bj", "bk", "label").agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / float(per_block)).drop("n").where(F.col("fraction") >= min_fraction)


def composite_voxels(voxels: DataFrame, shape: Shape, blocks: Shape, min_fraction: float = 0.0, fine: bool = False) -> DataFrame:
    """bi, bj, bk, elem, coarse, phases: one material gives its label, n materials give -n; ``elem`` counts blocks in order.

    ``fine`` adds the labels of the voxels of every block with several materials, last index fastest; null elsewhere.
    """
    _, ny, nz = blocks
    phases = block_phases(voxels, shape, blocks, min_fraction)
    out = phases.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("material"), "fraction"))).alias("phases"))
    elem = (F.col("bi") * ny + F.col("bj")) * nz + F.col("bk")
    coarse = F.when(F.size("phases") == 1, F.get("phases", 0)["material"]).otherwise(-F.size("phases"))
    out = out.select(*_KEYS, elem.cast("long").alias("elem"), coarse.cast("int").alias("coarse"), "phases")
    if not fine:
        return out
    several = out.where("coarse < 0 and size(phases) > 1").select(*_KEYS)
    held = _blocked(voxels, shape, blocks).join(several, list(_KEYS)).groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("i", "j", "k", "label"))).alias("_v"))
    return out.join(held.select(*_KEYS, F.transform("_v", lambda v: v["label"].cast("int")).alias("fine")), list(_KEYS), "left")


def coarse_grained(voxels: DataFrame, shape: Shape, blocks: Shape, min_fraction: float = 0.0, lengths: Lengths = UNIT, pad: Pad = (0, 0, 0)) -> DataFrame:
    """The whole composite image: bi, bj, bk, elem, coarse, phases, normal and fine.

    ``normal`` is that of ``interface_normals`` in blocks of two materials, ``fine`` the voxels of blocks with several; both
    are null elsewhere. The image and the composite blocks are written once, whatever they come from.
    """
    image = cut(voxels.select("i", "j", "k", "label"), "image")
    whole = cut(composite_voxels(image, shape, blocks, min_fraction, fine=True), "composite")
    moments = _moments(_interfaces(image, shape, blocks, lengths, pad, whole))
    return whole.join(_normals(moments), list(_KEYS), "left").select(*_KEYS, "elem", "coarse", "phases", "normal", "fine")


def composite_fractions(combo: DataFrame, pure_only: bool = False) -> DataFrame:
    """label, fraction over the composite image; ``pure_only`` keeps the labels that also fill a whole block."""
    parts = combo.select("coarse", F.size("phases").alias("n"), F.explode("phases").alias("p"))
    sums = parts.groupBy(F.col("p.material").alias("label")).agg(F.sum("p.fraction").alias("_sum"), F.max((F.col("n") == 1).cast("int")).alias("_pure"))
    total = combo.agg(F.count("*").alias("_total"))
    out = sums.crossJoin(F.broadcast(total)).withColumn("fraction", F.round(F.col("_sum") / F.col("_total"), 9))
    return (out.where("_pure = 1") if pure_only else out).select("label", "fraction")


def _windows(voxels: DataFrame, shape: Shape, blocks: Shape, pad: Pad) -> DataFrame:
    """Every voxel in the window of each block that sees it: the block and ``pad`` voxels on each side, wrapped.

    Adds the block, the place in its window (li, lj, lk) and whether the voxel lies in the block itself (``_in``).
    """
    check_divisible(shape, blocks)
    out = voxels.withColumn("_in", F.lit(True))
    for c, n, m, p in zip("ijk", shape, blocks, pad, strict=True):
        size = n // m
        if size + 2 * p > n:
            raise ValueError(f"a window of {size + 2 * p} voxels is wider than the image along {c}")
        own = F.floor(F.col(c) / size).cast("int")
        if p == 0:
            out = out.withColumns({f"b{c}": own, f"l{c}": F.col(c) - own * size})
            continue
        first, last = F.floor((F.col(c) - p) / size).cast("int"), F.floor((F.col(c) + p) / size).cast("int")
        out = out.withColumn("_b", F.explode(F.sequence(first, last)))
        out = out.withColumns({f"b{c}": F.pmod("_b", F.lit(m)), f"l{c}": F.col(c) - F.col("_b") * size + p, "_in": F.col("_in") & (F.col("_b") == own)}).drop("_b")
    return out


def _interfaces(voxels: DataFrame, shape: Shape, blocks: Shape, lengths: Lengths, pad: Pad, composite: DataFrame) -> DataFrame:
    """Sums over the window of every block of two materials: weight, coordinates, products, and the second phase's centre.

    The label's Laplacian is that of the whole image; a block counts its padded window if that holds the same labels as the
    block itself, else the block alone. One pass over the voxels gives both.
    """
    two = composite.where("size(phases) = 2").select(*_KEYS, F.get("phases", 0)["material"].alias("_low"))
    seen = _windows(laplacian(voxels, shape, "label", lengths, keep=True), shape, blocks, pad).join(two, list(_KEYS))
    step = {c: length / n for c, length, n in zip("xyz", lengths, shape, strict=True)}
    size = [n // m for n, m in zip(shape, blocks, strict=True)]
    x = {c: F.col(f"l{i}") * F.lit(step[c]) for c, i in zip("xyz", "ijk", strict=True)}
    # from the window's middle, which is the block's
    q = {c: (F.col(f"l{i}") + 0.5 - (s + 2 * p) / 2) * F.lit(step[c]) for c, i, s, p in zip("xyz", "ijk", size, pad, strict=True)}
    w = F.when(F.col("lap") > 1e-5, F.col("lap")).otherwise(F.lit(0.0))
    other = (F.col("label") != F.col("_low")).cast("double")
    terms = {"w": w, "n": other} | {f"s{c}": w * x[c] for c in "xyz"} | {f"s{a}{b}": w * x[a] * x[b] for a, b in _PAIRS} | {f"p{c}": other * q[c] for c in "xyz"}
    if not any(pad):
        return seen.groupBy(*_KEYS).agg(*[F.sum(t).alias(name) for name, t in terms.items()])
    inner = {f"{name}_in": F.when(F.col("_in"), t).otherwise(F.lit(0.0)) for name, t in terms.items()}
    labels = [F.array_sort(F.collect_set("label")).alias("_all"), F.array_sort(F.collect_set(F.when(F.col("_in"), F.col("label")))).alias("_own")]
    both = seen.groupBy(*_KEYS).agg(*[F.sum(t).alias(name) for name, t in (terms | inner).items()], *labels)
    return both.select(*_KEYS, *[F.when(F.col("_all") == F.col("_own"), F.col(name)).otherwise(F.col(f"{name}_in")).alias(name) for name in terms])


_PAIRS = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


def _moments(sums: DataFrame) -> DataFrame:
    w = F.col("w")
    mean = {c: F.col(f"s{c}") / w for c in "xyz"}
    centre = [(F.col(f"p{c}") / F.col("n")).alias(f"p{c}") for c in "xyz"]
    return sums.where("w > 0").select(*_KEYS, "w", *[mean[c].alias(f"c{c}") for c in "xyz"], *[(F.col(f"s{a}{b}") / w - mean[a] * mean[b]).alias(f"m{a}{b}") for a, b in _PAIRS], *centre)


def block_moments(voxels: DataFrame, shape: Shape, blocks: Shape, lengths: Lengths = UNIT, pad: Pad = (0, 0, 0), min_fraction: float = 0.0) -> DataFrame:
    """Weighted centroid and second moments of the interface in every two-material block.

    Weights are the magnitudes of the whole image's periodic label Laplacian, where above 1e-5; coordinates count from the
    first voxel of the window. Columns bi, bj, bk, w, cx, cy, cz, mxx .. mzz.
    """
    image = cut(voxels.select("i", "j", "k", "label"), "image")
    found = _moments(_interfaces(image, shape, blocks, lengths, pad, composite_voxels(image, shape, blocks, min_fraction)))
    return found.drop("px", "py", "pz")


def interface_normals(voxels: DataFrame, shape: Shape, blocks: Shape, lengths: Lengths = UNIT, pad: Pad = (0, 0, 0), min_fraction: float = 0.0, reverse: bool = False) -> DataFrame:
    """bi, bj, bk, normal (unit, array): direction of least spread of the interface, pointing away from the larger label.

    Components follow the image's axes; ``reverse`` lists the last axis first, the order of files that call it x. Moments are
    aggregates; only the 3 x 3 eigenproblem of each block runs in an Arrow batch.
    """
    image = cut(voxels.select("i", "j", "k", "label"), "image")
    return _normals(_moments(_interfaces(image, shape, blocks, lengths, pad, composite_voxels(image, shape, blocks, min_fraction))), reverse)


def _normals(moments: DataFrame, reverse: bool = False) -> DataFrame:
    names = ["mxx", "mxy", "mxz", "myy", "myz", "mzz", "px", "py", "pz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.stack([batch.column(3 + k).to_numpy() for k in range(9)], axis=1)
            full = m[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
            normal = np.linalg.eigh(full)[1][:, :, 0]
            normal *= np.where((normal * m[:, 6:]).sum(axis=1) > 0, -1.0, 1.0)[:, None]
            normal = normal[:, ::-1] if reverse else normal
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(normal), pa.list_(pa.float64()))], [*_KEYS, "normal"])

    return moments.select(*_KEYS, *names).mapInArrow(run, "bi int, bj int, bk int, normal array<double>")


def same_materials(voxels: DataFrame, shape: Shape, blocks: Shape, pad: int) -> DataFrame:
    """bi, bj, bk, same: whether the block and the block with ``pad`` voxels around it (wrapped) hold the same materials."""
    check_divisible(shape, blocks)
    size = [n // m for n, m in zip(shape, blocks, strict=True)]
    own = _blocked(voxels, shape, blocks).groupBy("bi", "bj", "bk").agg(F.array_sort(F.collect_set("label")).alias("own"))
    reach = voxels
    for c, n, s in zip("ijk", shape, size, strict=True):
        # a voxel is seen by its own block and by those whose padding holds it
        steps = F.array(*[F.lit(o) for o in range(-pad, pad + 1)])
        seen = F.array_distinct(F.transform(steps, _block_of(c, n, s)))
        reach = reach.withColumn(f"b{c}", F.explode(seen))
    padded = reach.groupBy("bi", "bj", "bk").agg(F.array_sort(F.collect_set("label")).alias("padded"))
    return own.join(padded, ["bi", "bj", "bk"]).select("bi", "bj", "bk", (F.col("own") == F.col("padded")).alias("same"))


def _block_of(axis: str, n: int, size: int):
    return lambda o: F.floor(F.pmod(F.col(axis) + o, F.lit(n)) / size).cast("int")


def image_laplacian(voxels: DataFrame, shape: Shape, lengths: Lengths = UNIT) -> DataFrame:
    """Interface indicator of a whole image: see ``stencils.laplacian``."""
    return laplacian(voxels, shape, "label", lengths)
