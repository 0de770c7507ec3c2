"""Periodic neighbourhood operators: Laplacian, erosion, median, gradients of labels.

Voxels meet their neighbours in dense blocks with halos (``blocks``): one shuffle, in which a voxel goes to its block and to
those whose halo holds it, whatever the size of the stencil. Images are whole; of an image with holes the voxels that are
there have results, and neighbours that are missing don't count.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks, Window, over_blocks
from .grids import UNIT, Lengths, Shape

Offset = tuple[int, int, int]
#: The largest number of values that a median sorts at once.
_SORTED = 1 << 22


def reach(offsets: list[Offset]) -> Offset:
    """How far a stencil looks along each axis."""
    return tuple(max(abs(o[a]) for o in offsets) for a in range(3))


def laplacian_weights(shape: Shape, lengths: Lengths = UNIT) -> tuple[list[Offset], list[float]]:
    """Seven-point stencil scaled so that its centre is 6 for any spacing; axes that wrap onto themselves add up."""
    h = [length / n for n, length in zip(shape, lengths, strict=True)]
    raw = [h[1] * h[2] / h[0], h[0] * h[2] / h[1], h[0] * h[1] / h[2]]
    f = 3.0 / sum(raw)
    offsets, weights = [(0, 0, 0)], [2.0 * f * sum(raw)]
    for axis in range(3):
        for step in (1, -1):
            offsets.append(tuple(step if a == axis else 0 for a in range(3)))
            weights.append(-f * raw[axis])
    return offsets, weights


def laplacian(voxels: DataFrame, shape: Shape, value: str = "label", lengths: Lengths = UNIT, keep: bool = False) -> DataFrame:
    """(i, j, k, lap): magnitude of the periodic Laplacian; ``keep`` carries the voxel's own value along."""
    offsets, weights = laplacian_weights(shape, lengths)

    def kernel(w: Window) -> dict[str, np.ndarray]:
        total = np.zeros(w.size)
        for offset, weight in zip(offsets, weights, strict=True):
            values, there = w.at(offset)
            total += np.where(there, values * weight, 0.0)
        return {"lap": np.abs(total), "_own": w.at((0, 0, 0))[0]}

    rows = voxels.select("i", "j", "k", F.col(value).cast("double").alias("_v"))
    found = over_blocks(rows, Blocks(shape, (1, 1, 1)), "_v", "<f8", kernel, "lap double, _own double")
    own = [F.col("_own").cast(voxels.schema[value].dataType).alias(value)] if keep else []
    return found.select("i", "j", "k", "lap", *own)


def box_offsets(size: int) -> list[Offset]:
    """Cube of ``size`` voxels; an even cube reaches one further to the negative side."""
    low, high = -(size // 2), (size - 1) // 2
    return list(product(range(low, high + 1), repeat=3))


def octahedron_offsets(radius: int) -> list[Offset]:
    return [o for o in product(range(-radius, radius + 1), repeat=3) if sum(map(abs, o)) <= radius]


def periodic_erosion(voxels: DataFrame, shape: Shape, size: int, mask: str = "mask") -> DataFrame:
    """(i, j, k, mask): true where the whole cube around a voxel is true."""
    low, high = -(size // 2), (size - 1) // 2

    def kernel(w: Window) -> dict[str, np.ndarray]:
        # a minimum over a cube is one over each axis after another
        held = np.where(w.there, w.values, 1).astype(bool)
        for axis in range(3):
            parts = [np.take(held, range(w.pad[axis] + o, w.pad[axis] + o + w.size[axis]), axis=axis) for o in range(low, high + 1)]
            held = np.logical_and.reduce(parts)
        return {"mask": held}

    rows = voxels.select("i", "j", "k", F.col(mask).cast("boolean").cast("int").alias("_m"))
    return over_blocks(rows, Blocks(shape, (max(-low, high),) * 3), "_m", "|u1", kernel, "mask boolean")


def median_filter(voxels: DataFrame, shape: Shape, offsets: list[Offset], value: str = "label") -> DataFrame:
    """(i, j, k, value): the upper median of the neighbourhood; null where so many neighbours are missing that there is none."""
    rank, field = len(offsets) // 2, voxels.schema[value]
    exact = field.dataType.typeName() in ("double", "float")
    kind, top = ("<f8", np.inf) if exact else ("<i8", np.iinfo(np.int64).max)

    def kernel(w: Window) -> dict[str, np.ndarray]:
        out, missing = np.empty(w.size, kind), np.zeros(w.size, bool)
        planes = max(1, _SORTED // (len(offsets) * w.size[1] * w.size[2]))
        for first in range(0, w.size[0], planes):
            own = slice(first, min(first + planes, w.size[0]))
            around = [w.at(o) for o in offsets]
            values = np.stack([np.where(t[own], v[own], top) for v, t in around])
            out[own] = np.partition(values, rank, axis=0)[rank]
            missing[own] = np.sum([t[own] for _, t in around], axis=0) <= rank
        return {"_median": np.ma.array(out, mask=missing)}

    found = over_blocks(voxels, Blocks(shape, reach(offsets)), value, kind, kernel, f"_median {'double' if exact else 'long'}")
    return found.select("i", "j", "k", F.col("_median").cast(field.dataType).alias(value))


def smoothing_offsets(scale: tuple[float, float, float]) -> list[Offset] | None:
    """Neighbourhood that smooths an enlarged image: an octahedron of radius 2 s when all scales are equal, else a box of
    2 s per axis; none unless every axis grows."""
    if not all(s > 1 for s in scale):
        return None
    if len(set(scale)) == 1:
        return octahedron_offsets(int(2 * scale[0]))
    sides = [int(2 * s) for s in scale]
    return list(product(*[range(-(n // 2), (n - 1) // 2 + 1) for n in sides]))


def resize_image(voxels: DataFrame, shape: Shape, scale=None, resolution: Shape | None = None) -> DataFrame:
    """Nearest-neighbour resize, then a wrapped median where the image grew along all axes."""
    from .grids import resize_nearest, target_shape

    target = target_shape(shape, scale, resolution)
    out = resize_nearest(voxels, shape, target)
    offsets = smoothing_offsets(tuple(m / n for n, m in zip(shape, target, strict=True)))
    return median_filter(out, target, offsets) if offsets else out


