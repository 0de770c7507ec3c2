"""Dense blocks of an image with halos: the voxels of a block, and those around it that its kernel looks at, in one task.

Arrow batches of voxels are dealt out in NumPy: what a batch holds of a block's padded window becomes one row (places and
values as bytes), so a voxel is sent once for its own block and once for each neighbour whose halo holds it, (1 + 2p/b)^3
times at most on average. Rows are shuffled and sorted by block; a task fills one dense array after another and runs the
kernel on it. Rows about a block that aren't voxels (faces, say) may join it and come first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grids import Shape

Pad = tuple[int, int, int]
_ROWS = "block long, turn long, places binary, values binary"
_NAMES = ["block", "turn", "places", "values"]


@dataclass(frozen=True)
class Blocks:
    """Blocks of ``edge`` voxels a side over an image, the last ones of an axis smaller; windows reach ``pad`` further, wrapped.

    Wide halos get larger blocks, so that what is sent twice stays bounded. ``sides`` sets the edges instead.
    """

    shape: Shape
    pad: Pad = (0, 0, 0)
    least: int = 16
    sides: tuple[int, int, int] | None = None

    @property
    def edge(self) -> tuple[int, int, int]:
        if self.sides is not None:
            return tuple(min(b, n) for b, n in zip(self.sides, self.shape, strict=True))
        side = max(self.least, 8 * max(self.pad))
        return tuple(min(side, n) for n in self.shape)

    @property
    def counts(self) -> tuple[int, int, int]:
        return tuple(-(-n // b) for n, b in zip(self.shape, self.edge, strict=True))

    def number(self, at) -> np.ndarray:
        _, ny, nz = self.counts
        return (at[0] * ny + at[1]) * nz + at[2]

    def window(self, block: int) -> tuple[list[int], list[int]]:
        """First voxel of a block, and how many it has along each axis (without the halo)."""
        _, ny, nz = self.counts
        at = [block // (ny * nz), block // nz % ny, block % nz]
        first = [a * b for a, b in zip(at, self.edge, strict=True)]
        return first, [min(b, n - f) for b, n, f in zip(self.edge, self.shape, first, strict=True)]

    def seen(self, axis: int, index: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, block along the axis, place in its window) for every window that holds an index, wrapped."""
        n, b, p, count = self.shape[axis], self.edge[axis], self.pad[axis], self.counts[axis]
        out = []
        turns = -(-p // n)
        for turn in range(-turns, turns + 1):
            g = index + turn * n
            low, high = np.maximum((g - p) // b, 0), np.minimum((g + p) // b, count - 1)
            inside = (g >= -p) & (g < n + p)
            for step in range(int((high - low)[inside].max(initial=-1)) + 1):
                rows = np.flatnonzero(inside & (low + step <= high))
                if len(rows):
                    at = low[rows] + step
                    out.append((rows, at, g[rows] - at * b + p))
        return out


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each begins (with the end behind)."""
    order = np.argsort(keys, kind="stable")
    return order, np.append(np.flatnonzero(np.diff(keys[order], prepend=-1)), len(keys))


def dealt(voxels: DataFrame, blocks: Blocks, value: str, kind: str) -> DataFrame:
    """(block, turn, places, values): what each batch of (i, j, k, value) holds of each block's window; nulls are no voxels."""
    rest = [range(b + 2 * p) for b, p in zip(blocks.edge, blocks.pad, strict=True)]
    _, wy, wz = (len(r) for r in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = [batch.column(a).to_numpy().astype(np.int64) for a in range(3)]
            values = batch.column(3).to_numpy(zero_copy_only=False).astype(kind)
            axes = [blocks.seen(a, index[a]) for a in range(3)]
            keys, places, rows = [], [], []
            for one, two, three in product(*axes):
                own = np.intersect1d(np.intersect1d(one[0], two[0], assume_unique=True), three[0], assume_unique=True) if any(len(x[0]) < len(values) for x in (one, two, three)) else one[0]
                if not len(own):
                    continue
                pick = [np.searchsorted(x[0], own) for x in (one, two, three)]
                keys.append(blocks.number([x[1][q] for x, q in zip((one, two, three), pick, strict=True)]))
                a, b, c = (x[2][q] for x, q in zip((one, two, three), pick, strict=True))
                places.append((a * wy + b) * wz + c)
                rows.append(own)
            if not keys:
                continue
            keys, places, rows = np.concatenate(keys), np.concatenate(places).astype("<i4"), np.concatenate(rows)
            order, edges = _grouped(keys)
            places, values = places[order], values[rows[order]]
            parts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            numbers = keys[order][edges[:-1]]
            columns = [pa.array(numbers), pa.array(numbers * 2 + 1), pa.array([places[i:j].tobytes() for i, j in parts], pa.binary()), pa.array([values[i:j].tobytes() for i, j in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, _NAMES)

    return voxels.select("i", "j", "k", value).where(F.col(value).isNotNull()).mapInArrow(run, _ROWS)


@dataclass
class Window:
    """A block's dense values with its halo, which of them are there, and what else was sent to the block."""

    values: np.ndarray
    there: np.ndarray
    first: list[int]
    size: list[int]
    pad: Pad
    extra: list[bytes]

    def inner(self, dense: np.ndarray) -> np.ndarray:
        return dense[tuple(slice(p, p + s) for p, s in zip(self.pad, self.size, strict=True))]

    def at(self, offset: Pad) -> tuple[np.ndarray, np.ndarray]:
        """Values and presence at an offset from each of the block's own voxels."""
        cuts = tuple(slice(p + o, p + o + s) for p, o, s in zip(self.pad, offset, self.size, strict=True))
        return self.values[cuts], self.there[cuts]


def each_block(voxels: DataFrame, blocks: Blocks, value: str, kind: str, make: Callable[[Window], pa.RecordBatch | None], schema: str, extra: DataFrame | None = None) -> DataFrame:
    """What ``make`` returns for every block that holds a voxel. ``extra`` rows (block, data) reach it as a list, in the order of
    their bytes."""
    rows = dealt(voxels, blocks, value, kind)
    if extra is not None:
        rows = rows.unionByName(extra.select("block", (F.col("block") * 2).alias("turn"), F.lit(None).cast("binary").alias("places"), F.col("data").alias("values")))
    sizes = [b + 2 * p for b, p in zip(blocks.edge, blocks.pad, strict=True)]

    def done(block: int | None, dense: np.ndarray, there: np.ndarray, more: list[bytes]) -> Iterator[pa.RecordBatch]:
        if block is None:
            return
        window = Window(dense, there, *blocks.window(block), blocks.pad, sorted(more))
        if window.inner(there).any() and (out := make(window)) is not None:
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, dense, there, more = None, None, None, []
        for batch in batches:
            for block, places, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if block != now:
                    yield from done(now, dense, there, more)
                    now, dense, there, more = block, np.zeros(sizes, kind), np.zeros(sizes, bool), []
                if places is None:
                    more.append(values)
                    continue
                at = np.frombuffer(places, "<i4")
                dense.ravel()[at] = np.frombuffer(values, kind)
                there.ravel()[at] = True
        yield from done(now, dense, there, more)

    return rows.repartition("block").sortWithinPartitions("turn").select("block", "places", "values").mapInArrow(run, schema)


def over_blocks(voxels: DataFrame, blocks: Blocks, value: str, kind: str, kernel: Callable[[Window], dict[str, np.ndarray]], schema: str, extra: DataFrame | None = None) -> DataFrame:
    """(i, j, k, *schema) of every voxel that is there: what ``kernel`` makes of each block (arrays of the block's size; masked
    arrays have nulls)."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def make(window: Window) -> pa.RecordBatch:
        own, found = window.inner(window.there), kernel(window)
        index = [pa.array((x + f).astype(np.int32)) for x, f in zip(np.nonzero(own), window.first, strict=True)]
        columns = [pa.array(np.ma.getdata(found[n])[own], mask=np.ma.getmaskarray(found[n])[own]) for n in names]
        return pa.RecordBatch.from_arrays([*index, *columns], ["i", "j", "k", *names])

    return each_block(voxels, blocks, value, kind, make, f"i int, j int, k int, {schema}", extra)
