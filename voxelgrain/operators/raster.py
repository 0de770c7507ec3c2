"""Rasters: nearest seeds of voxels, and struts stamped into an image."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periodic import inside_cell, nearest_node
from ..stages import cut
from .grids import UNIT, Lengths, Shape, voxel_grid
from .kd import KdTree, kd_tree

#: Seeds that are sent to every executor (24 bytes each); more are met by blocks.
BROADCAST_SEEDS = 200_000
#: Seeds of a block, about, and voxels of a block that one task answers, about.
BLOCK_SEEDS, BLOCK_VOXELS = 512, 32_768
_ASKED = ["_leaf", "_salt", "_px", "_py", "_pz"]


def nearest_seed_kernel(points: np.ndarray, seeds: np.ndarray, ids: np.ndarray, lengths: np.ndarray, digits: int = 9) -> np.ndarray:
    """Id of the nearest seed on the torus for each point; ties of rounded squared distances go to the smallest id.

    Seeds are binned into cells; a point looks at shells of cells around its own until nothing nearer can follow.
    """
    order = np.argsort(ids, kind="stable")
    seeds, ids = seeds[order] % lengths, ids[order]
    per_axis = np.maximum(1, np.floor((len(seeds) / 2) ** (1 / 3) * lengths / lengths.max()).astype(int))
    size = lengths / per_axis
    flat = lambda c: (c[..., 0] * per_axis[1] + c[..., 1]) * per_axis[2] + c[..., 2]
    seed_cell = flat(np.minimum((seeds / size).astype(int), per_axis - 1))
    by_cell = np.argsort(seed_cell, kind="stable")
    bounds = np.searchsorted(seed_cell[by_cell], np.arange(per_axis.prod() + 1))
    point_cells = np.minimum(((points % lengths) / size).astype(int), per_axis - 1)
    keys = flat(point_cells)
    out = np.empty(len(points), ids.dtype)
    for key in np.unique(keys):
        mine = np.flatnonzero(keys == key)
        base = point_cells[mine[0]]
        reach = 0
        while True:
            reach += 1
            whole = (2 * reach + 1 >= per_axis).all()
            ranges = [np.arange(n) if 2 * reach + 1 >= n else (np.arange(-reach, reach + 1) + b) % n for n, b in zip(per_axis, base, strict=True)]
            cells = flat(np.stack(np.meshgrid(*ranges, indexing="ij"), axis=-1).reshape(-1, 3))
            near = np.concatenate([by_cell[bounds[c] : bounds[c + 1]] for c in cells])
            if len(near):
                near = np.sort(near)
                best = np.full(len(mine), np.inf)
                pick = np.zeros(len(mine), np.int64)
                for i in range(0, len(near), 512):
                    d = points[mine, None] - seeds[near[None, i : i + 512]]
                    d -= lengths * np.rint(d / lengths)
                    d2 = np.round((d * d).sum(axis=2), digits)
                    at = d2.argmin(axis=1)
                    value = d2[np.arange(len(mine)), at]
                    better = value < best
                    best[better], pick[better] = value[better], near[i + at[better]]
                if whole or (best <= ((reach * size.min()) ** 2)).all():
                    out[mine] = ids[pick]
                    break
            elif whole:
                raise ValueError("there are no seeds")
    return out


def label_nearest_seed(voxels: DataFrame, seeds: DataFrame, shape: Shape, lengths: Lengths = UNIT) -> DataFrame:
    """``voxels`` with ``label``, the nearest seed of each cell centre.

    Up to ``BROADCAST_SEEDS`` seeds (checked) go to the executors and voxels are labelled in Arrow batches without a
    shuffle; more seeds are met block by block (``nearest_by_blocks``).
    """
    if seeds.limit(BROADCAST_SEEDS + 1).count() > BROADCAST_SEEDS:
        return nearest_by_blocks(voxels, seeds, shape, lengths)
    held = seeds.select("seed_id", "x", "y", "z").toPandas()
    points, ids, box = held[["x", "y", "z"]].to_numpy(float), held["seed_id"].to_numpy(np.int64), np.array(lengths, float)
    names = voxels.columns
    place = [names.index(c) for c in "ijk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.stack([(batch.column(p).to_numpy() + 0.5) * length / n for p, n, length in zip(place, shape, box, strict=True)], axis=1)
            labels = nearest_seed_kernel(at, points, ids, box)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels.astype(np.int32))], [*names, "label"])

    fields = ", ".join(f"`{n}` {t}" for n, t in voxels.dtypes)
    return voxels.mapInArrow(run, f"{fields}, label int")


def nearest_by_blocks(voxels: DataFrame, seeds: DataFrame, shape: Shape, lengths: Lengths = UNIT, block: int = BLOCK_SEEDS) -> DataFrame:
    """The same labels without a machine that holds all seeds, whether seeds lie evenly or in clusters.

    Seeds are dealt to k-d blocks of about ``block`` seeds each. A sampled seed of its own block bounds a voxel's distance; the
    voxel is sent to the blocks within that bound (two or three, on average) and its answers' least is kept. Blocks of sparse
    seeds hold more voxels: they are dealt to several tasks by their volume.
    """
    box = np.array(lengths, float)
    wrapped = cut(seeds.select(F.col("seed_id").cast("long").alias("seed_id"), *[F.pmod(F.col(c), F.lit(float(length))).alias(c) for c, length in zip("xyz", lengths, strict=True)]), "seeds")
    tree = kd_tree(wrapped, lengths, block)
    leaves = 1 << tree.depth
    volume = np.prod(np.maximum(tree.high[leaves:] - tree.low[leaves:], 0.0), axis=1) / box.prod()
    salts = np.maximum(1, np.ceil(volume * math.prod(shape) / BLOCK_VOXELS)).astype(np.int64)
    names = voxels.columns
    place = [names.index(c) for c in "ijk"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = np.stack([batch.column(p).to_numpy() for p in place], axis=1)
            at = (index + 0.5) * box / np.array(shape)
            row, leaf, shift = tree.reached(at, tree.bound(at) + 2e-9)
            salt = (index @ np.array([shape[1] * shape[2], shape[2], 1]))[row] % salts[leaf]
            moved = at[row] - shift * box
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, *map(pa.array, (leaf, salt, *moved.T))], [*names, *_ASKED])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf(np.stack([batch.column(c).to_numpy() for c in (1, 2, 3)], axis=1))
            row = np.repeat(np.arange(len(leaf)), salts[leaf])
            salt = np.arange(len(row)) - np.repeat(np.cumsum(salts[leaf]) - salts[leaf], salts[leaf])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(leaf[row]), pa.array(salt)], ["seed_id", "x", "y", "z", *_ASKED[:2]])

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        if not asked.num_rows or not own.num_rows:
            return asked.select(names).slice(0, 0).append_column("_d2", pa.array([], pa.float64())).append_column("_id", pa.array([], pa.int64()))
        points = np.stack([own[c].to_numpy() for c in "xyz"], axis=1)
        inner = KdTree(points, own["seed_id"].to_numpy(), box, max(0, math.ceil(math.log2(len(points) / 8))))
        d2, ids = inner.nearest(np.stack([asked[c].to_numpy() for c in _ASKED[2:]], axis=1), 9)
        return asked.select(names).append_column("_d2", pa.array(d2)).append_column("_id", pa.array(ids))

    fields = ", ".join(f"`{n}` {t}" for n, t in voxels.dtypes)
    asked = voxels.mapInArrow(ask, f"{fields}, _leaf long, _salt long, _px double, _py double, _pz double")
    dealt = wrapped.mapInArrow(deal, "seed_id long, x double, y double, z double, _leaf long, _salt long")
    answers = asked.groupBy("_leaf", "_salt").cogroup(dealt.groupBy("_leaf", "_salt")).applyInArrow(answer, f"{fields}, _d2 double, _id long")
    best = answers.groupBy(*names).agg(F.min(F.struct("_d2", "_id")).alias("_best"))
    return best.select(*names, F.col("_best._id").cast("int").alias("label"))


def strut_samples(struts: DataFrame, shape: Shape, lengths: Lengths = UNIT) -> DataFrame:
    """Voxel (vi, vj, vk) under every sample of the struts' centre lines, samples a voxel diagonal apart.

    ``struts`` has ax, ay, az, bx, by, bz. A strut shorter than a step is sampled at its start; samples outside go.
    """
    step = math.sqrt(sum((length / (n - 1)) ** 2 for n, length in zip(shape, lengths, strict=True)))
    d = [F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"]
    long = struts.withColumn("_length", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).where("_length > 0")
    long = long.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.round(F.col("_length") / step, 9)).cast("int")))
    each = long.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    share = F.when(F.col("_n") > 1, F.col("_s") / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    points = [F.round(F.col(f"a{c}") + share * (F.col(f"b{c}") - F.col(f"a{c}")), 9) for c in "xyz"]
    inside = each.select(*[p.alias(c) for p, c in zip(points, "xyz", strict=True)]).where(inside_cell([F.col(c) for c in "xyz"], lengths))
    return inside.select(*[nearest_node(F.col(c), length, n).alias(f"v{i}") for c, i, length, n in zip("xyz", "ijk", lengths, shape, strict=True)]).distinct()


def stamp_struts(struts: DataFrame, shape: Shape, lengths: Lengths = UNIT, radius: float = 0.05, strut_type: str = "circle") -> DataFrame:
    """Distinct voxels (i, j, k) within ``radius`` of a sampled voxel: samples times a fixed stencil of offsets."""
    if strut_type != "circle":
        raise ValueError("only 'circle' struts are known")
    h = [length / (n - 1) for n, length in zip(shape, lengths, strict=True)]
    reach = [math.ceil(radius / x) + 1 for x in h]
    offsets = [
        (a, b, c)
        for a in range(-reach[0], reach[0] + 1)
        for b in range(-reach[1], reach[1] + 1)
        for c in range(-reach[2], reach[2] + 1)
        if (a * h[0]) ** 2 + (b * h[1]) ** 2 + (c * h[2]) ** 2 <= radius * radius
    ]
    spark = struts.sparkSession
    stencil = F.broadcast(spark.createDataFrame(offsets, "a int, b int, c int"))
    hit = strut_samples(struts, shape, lengths).crossJoin(stencil).select((F.col("vi") + F.col("a")).alias("i"), (F.col("vj") + F.col("b")).alias("j"), (F.col("vk") + F.col("c")).alias("k"))
    return hit.where(" and ".join(f"{c} >= 0 and {c} < {n}" for c, n in zip("ijk", shape, strict=True))).distinct()


def exact_struts(struts: DataFrame, shape: Shape, lengths: Lengths = UNIT, radius: float = 0.05) -> DataFrame:
    """Distinct voxels whose node lies within ``radius`` of a strut, struts repeated periodically.

    Each strut is repeated at 27 places and meets the voxels of its bounding box only.
    """
    shifts = F.array(*[F.lit(o) for o in (-1, 0, 1)])
    copies = struts.select(*[f"{e}{c}" for e in "ab" for c in "xyz"])
    for c, length in zip("xyz", lengths, strict=True):
        copies = copies.withColumn("_o", F.explode(shifts)).withColumns({f"a{c}": F.col(f"a{c}") + F.col("_o") * length, f"b{c}": F.col(f"b{c}") + F.col("_o") * length}).drop("_o")
    cells = copies
    for c, i, n, length in zip("xyz", "ijk", shape, lengths, strict=True):
        h = length / (n - 1)
        low = F.greatest(F.ceil((F.least(f"a{c}", f"b{c}") - radius) / h), F.lit(0)).cast("int")
        high = F.least(F.floor((F.greatest(f"a{c}", f"b{c}") + radius) / h), F.lit(n - 1)).cast("int")
        cells = cells.where(low <= high).withColumn(i, F.explode(F.sequence(low, high)))
    p = {c: F.col(i) * (length / (n - 1)) for c, i, n, length in zip("xyz", "ijk", shape, lengths, strict=True)}
    d = {c: F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"}
    dd = d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]
    t = sum(((p[c] - F.col(f"a{c}")) * d[c] for c in "yz"), (p["x"] - F.col("ax")) * d["x"]) / dd
    t = F.when(dd > 0, F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    off = {c: p[c] - F.col(f"a{c}") - t * d[c] for c in "xyz"}
    return cells.where(off["x"] * off["x"] + off["y"] * off["y"] + off["z"] * off["z"] <= radius * radius).select("i", "j", "k").distinct()


def binary_image(spark: SparkSession, shape: Shape, marked: DataFrame) -> DataFrame:
    """The whole grid with ``label`` 1 where a voxel is marked and 0 elsewhere."""
    return voxel_grid(spark, shape).join(marked.withColumn("_one", F.lit(1)), ["i", "j", "k"], "left").select("i", "j", "k", F.coalesce("_one", F.lit(0)).alias("label"))


def struts_of(vertices: DataFrame, edges: DataFrame, lengths: Sequence[float] = UNIT) -> DataFrame:
    """Edges (a, b over v) with the coordinates of both ends, scaled to the box."""
    out = edges
    for end in "ab":
        named = vertices.select(F.col("v").alias(end), *[(F.col(c) * float(length)).alias(f"{end}{c}") for c, length in zip("xyz", lengths, strict=True)])
        out = out.join(named, end)
    return out
