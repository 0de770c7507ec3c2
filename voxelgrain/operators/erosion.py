"""Grain boundaries: voxels near cell faces are tagged by face, tags renumbered, metadata joined."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Ordered
from pyspark.sql import functions as F

from ..functions.periodic import canonical_sign
from ..stages import cut
from .blocks import Blocks, Window, over_blocks
from .grids import UNIT, Lengths, Shape
from .order import numbered
from .voronoi import shifted


def canonical_faces(faces: DataFrame, digits: int = 6) -> DataFrame:
    """``faces`` with ``gb`` (from 0): one number for all faces of the same two crystals with the same normal up to sign.

    Normals count to ``digits`` places, their sign by the first component that isn't near zero; numbers follow (smaller
    crystal, larger crystal, normal). Distinct keys are numbered by ranges and joined back.
    """
    n = [F.col(c) for c in ("nx", "ny", "nz")]
    signed = F.transform(F.array(canonical_sign(n)), lambda s: F.struct(*[(F.round(c * s, digits) + 0.0).alias(f"_{x}") for c, x in zip(n, ("nx", "ny", "nz"), strict=True)]))
    keyed = faces.withColumns({"_lo": F.least("seed_a", "seed_b"), "_hi": F.greatest("seed_a", "seed_b"), "_signed": F.get(signed, 0)}).select("*", "_signed.*").drop("_signed")
    keys = ["_lo", "_hi", "_nx", "_ny", "_nz"]
    named = numbered(keyed.select(*keys).distinct(), keys, "gb").withColumn("gb", F.col("gb").cast("int"))
    return keyed.join(named, keys).drop(*keys)


def plane_band(point: list[Column], on_plane: list[Column], normal: list[Column], thickness: float) -> Column:
    """Whether a point is within half the thickness of a plane."""
    d = sum(((p - o) * n for p, o, n in zip(point[1:], on_plane[1:], normal[1:], strict=True)), (point[0] - on_plane[0]) * normal[0])
    return F.abs(d) <= thickness / 2


def in_polygon(point: list[Column], verts: Column, normal: list[Column]) -> Column:
    """Whether a point lies in a convex polygon when both are seen along its normal: all edges turn the same way."""
    px, py, pz = point
    nx, ny, nz = normal
    after = F.concat(F.slice(verts, 2, F.size(verts) - 1), F.slice(verts, 1, 1))

    def side(p: Column, q: Column) -> Column:
        ex, ey, ez = q["x"] - p["x"], q["y"] - p["y"], q["z"] - p["z"]
        vx, vy, vz = px - p["x"], py - p["y"], pz - p["z"]
        return nx * (ey * vz - ez * vy) + ny * (ez * vx - ex * vz) + nz * (ex * vy - ey * vx)

    sides = F.zip_with(verts, after, side)
    return F.forall(sides, lambda s: s >= 0) | F.forall(sides, lambda s: s <= 0)


#: Slack of cones and planes, as the sine of an angle and as a share of the apex's height: it means the same for tiny faces.
SLACK = 1e-9


def in_cone(point: list[Column], apex: list[Column], verts: Column) -> Column:
    """Whether a point lies in the infinite cone from ``apex`` over a convex polygon (the pyramid's side planes)."""
    after = F.concat(F.slice(verts, 2, F.size(verts) - 1), F.slice(verts, 1, 1))
    v = [p - a for p, a in zip(point, apex, strict=True)]
    far = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])

    def side(p: Column, q: Column) -> Column:
        a = [p[c] - o for c, o in zip("xyz", apex, strict=True)]
        b = [q[c] - o for c, o in zip("xyz", apex, strict=True)]
        n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
        size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
        return F.struct((v[0] * n[0] + v[1] * n[1] + v[2] * n[2]).alias("s"), (size * far * SLACK).alias("slack"))

    sides = F.zip_with(verts, after, side)
    # the cone goes on behind its apex, where the signs turn as well: only the polygon's side counts
    height = _height(verts)
    ahead = height(point) * F.signum(height(apex)) <= F.abs(height(apex)) * (1 + SLACK)
    return (F.forall(sides, lambda s: s["s"] >= -s["slack"]) | F.forall(sides, lambda s: s["s"] <= s["slack"])) & ahead


def _height(verts: Column):
    """A function of points: their distance from a polygon's plane, in units of its area vector (of all its vertices, so that
    short edges don't matter)."""
    o = F.get(verts, 0)
    after = F.concat(F.slice(verts, 2, F.size(verts) - 1), F.slice(verts, 1, 1))

    def cross(p: Column, q: Column) -> Column:
        a, b = ([r[c] - o[c] for c in "xyz"] for r in (p, q))
        return F.struct((a[1] * b[2] - a[2] * b[1]).alias("x"), (a[2] * b[0] - a[0] * b[2]).alias("y"), (a[0] * b[1] - a[1] * b[0]).alias("z"))

    zero = F.struct(*[F.lit(0.0).alias(c) for c in "xyz"])
    normal = F.aggregate(F.zip_with(verts, after, cross), zero, lambda t, x: F.struct(*[(t[c] + x[c]).alias(c) for c in "xyz"]))
    return lambda q: sum(((q[k] - o[c]) * normal[c] for k, c in ((1, "y"), (2, "z"))), (q[0] - o["x"]) * normal["x"])


def in_pyramid(point: list[Column], apex: list[Column], verts: Column) -> Column:
    """Whether a point lies in the half polyhedron between ``apex`` and a convex polygon: in the cone, and no further from the
    apex than the polygon's plane."""
    height = _height(verts)
    return in_cone(point, apex, verts) & (height(point) * F.signum(height(apex)) >= -F.abs(height(apex)) * SLACK)


def first_match(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an order."""
    return df.withColumn("_nth", F.row_number().over(Ordered.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def renumbered(df: DataFrame, column: str, start: int, out: str) -> DataFrame:
    """``out``: contiguous numbers from ``start`` for the sorted distinct values of ``column`` (numbered by ranges)."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    return df.join(numbered(distinct, [column], out, start), column, "left")


#: Boundaries up to this many are broadcast as a table of tags; more meet their voxels by a shuffle.
BROADCAST_TAGS = 200_000


def _one_sided(sides: np.ndarray, slack: np.ndarray | float) -> np.ndarray:
    return (sides >= -slack).all(axis=1) | (sides <= slack).all(axis=1)


class Face:
    """A face at one of its periodic places, with the half polyhedron between it and its seed: what ``plane_band``,
    ``in_polygon`` and ``in_pyramid`` say, for arrays of points."""

    def __init__(self, data: bytes) -> None:
        values = np.frombuffer(data, ">f8")
        self.gb, self.crystal = int(values[0]), int(values[1])
        self.normal, self.apex, self.verts = values[2:5].tolist(), values[5:8].tolist(), values[8:].reshape(-1, 3)
        self.after = np.roll(self.verts, -1, axis=0)
        self.up = np.cross(self.verts - self.verts[0], self.after - self.verts[0]).sum(axis=0)

    def _height(self, q: list) -> np.ndarray:
        o, n = self.verts[0], self.up
        return (q[0] - o[0]) * n[0] + (q[1] - o[1]) * n[1] + (q[2] - o[2]) * n[2]

    def covers(self, q: list[np.ndarray], thickness: float) -> np.ndarray:
        """Within half the thickness of the face's plane, and over the face."""
        o, n = self.verts[0], self.normal
        near = np.abs((q[0] - o[0]) * n[0] + (q[1] - o[1]) * n[1] + (q[2] - o[2]) * n[2]) <= thickness / 2
        at = np.flatnonzero(near)

        def side(v: list[np.ndarray], p: np.ndarray, r: np.ndarray) -> np.ndarray:
            ex, ey, ez = r - p
            vx, vy, vz = v[0] - p[0], v[1] - p[1], v[2] - p[2]
            return n[0] * (ey * vz - ez * vy) + n[1] * (ez * vx - ex * vz) + n[2] * (ex * vy - ey * vx)

        if len(at):
            own = [x[at] for x in q]
            near[at] = _one_sided(np.stack([side(own, p, r) for p, r in zip(self.verts, self.after, strict=True)], axis=1), 0.0)
        return near

    def holds(self, q: list[np.ndarray]) -> np.ndarray:
        """In the half polyhedron."""
        v = np.stack([x - a for x, a in zip(q, self.apex, strict=True)], axis=1)
        planes = np.cross(self.verts - self.apex, self.after - self.apex)
        slack = np.sqrt((planes**2).sum(axis=1))[None] * np.sqrt((v**2).sum(axis=1))[:, None] * SLACK
        top = self._height(self.apex)
        share = self._height(q) * np.sign(top)
        return _one_sided(v @ planes.T, slack) & (share <= abs(top) * (1 + SLACK)) & (share >= -abs(top) * SLACK)


def crystals_by_block(voxels: DataFrame, blocks: Blocks) -> DataFrame:
    """(block, crystal): the labels that each block of voxels holds. Written."""
    at = [F.floor(F.col(c) / b).cast("long") for c, b in zip("ijk", blocks.edge, strict=True)]
    return cut(voxels.where("label is not null").select(blocks.number(at).alias("block"), F.col("label").cast("long").alias("crystal")).distinct(), "crystals", slim=True)


def on_box(placed: DataFrame, shape: Shape, lengths: Lengths, thickness: float) -> DataFrame:
    """Faces whose half polyhedron's box, or the band about it, comes within two voxels of the box's own voxels."""
    for c, length, n in zip("xyz", lengths, shape, strict=True):
        ends = F.col(f"verts.{c}")
        beyond = thickness / 2 + 2 * length / n
        placed = placed.where((F.least(F.array_min(ends), F.col(f"p{c}")) < length + beyond) & (F.greatest(F.array_max(ends), F.col(f"p{c}")) > -beyond))
    return placed


def faces_by_block(placed: DataFrame, blocks: Blocks, lengths: Lengths, thickness: float, crystals: DataFrame | None = None) -> DataFrame:
    """(block, data): every face at every block of voxels that its half polyhedron's box, or the band about it, meets and that
    holds voxels of its crystal (``crystals``, if given): a block gets no more faces than those of as many crystals as it has voxels.

    ``placed``: gb, crystal, normal, apex (px, py, pz) and verts of faces at their places. Blocks that lie wholly beyond one of the
    box's sides are left out; a face's data are its numbers as bytes.
    """
    step = [length / n for length, n in zip(lengths, blocks.shape, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, data, labels = [], [], []
            columns = [c.to_pylist() for c in batch.columns]
            for *head, verts in zip(*columns, strict=True):
                points = [[p["x"], p["y"], p["z"]] for p in verts]
                corners = np.array([*points, head[5:8]])
                low, high = corners.min(axis=0) - thickness / 2, corners.max(axis=0) + thickness / 2
                spans = []
                for c in range(3):
                    # centres of voxels lie half a step behind their first side; one more voxel on each side for rounding
                    first, last = int(np.floor(low[c] / step[c] - 0.5)) - 1, int(np.ceil(high[c] / step[c] - 0.5)) + 1
                    if last < 0 or first >= blocks.shape[c]:
                        break
                    spans.append(range(max(first, 0) // blocks.edge[c], min(last, blocks.shape[c] - 1) // blocks.edge[c] + 1))
                if len(spans) < 3:
                    continue
                own = np.array([*head, *[x for p in points for x in p]], ">f8").tobytes()
                for at in product(*spans):
                    numbers.append(int(blocks.number(at)))
                    data.append(own)
                    labels.append(int(head[1]))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(labels, pa.int64()), pa.array(data, pa.binary())], ["block", "crystal", "data"])

    rows = placed.select(*[F.col(c).cast("double") for c in ("gb", "crystal", "nx", "ny", "nz", "px", "py", "pz")], "verts")
    near = rows.mapInArrow(run, "block long, crystal long, data binary")
    if crystals is not None:
        near = near.join(crystals, ["block", "crystal"], "left_semi")
    return near.select("block", "data")


def eroded_blocks(voxels: DataFrame, placed: DataFrame, shape: Shape, lengths: Lengths, thickness: float, crystals: DataFrame) -> DataFrame:
    """(i, j, k, crystal, killed, gb) of all voxels: faces meet the blocks of voxels that they can reach, and in a block the
    voxels of their crystal. Half polyhedra are looked at for killed voxels alone; ``gb`` is the first that holds the voxel."""
    blocks = Blocks(shape)

    def kernel(w: Window) -> dict[str, np.ndarray]:
        killed, tag = np.zeros(w.size, bool), np.full(w.size, -1, np.int64)
        (labels, there), faces = w.at((0, 0, 0)), sorted((Face(x) for x in w.extra), key=lambda f: f.gb)
        of: dict[int, list[Face]] = {}
        for face in faces:
            of.setdefault(face.crystal, []).append(face)
        members = {}
        for crystal in of:
            at = np.nonzero((labels == crystal) & there)
            members[crystal] = at, [(x + f + 0.5) * length / n for x, f, length, n in zip(at, w.first, lengths, shape, strict=True)]
        found = {c: np.zeros(len(at[0]), bool) for c, (at, _) in members.items()}
        for face in faces:
            points = members[face.crystal][1]
            if len(points[0]):
                found[face.crystal] |= face.covers(points, thickness)
        for crystal, (at, points) in members.items():
            dead = np.flatnonzero(found[crystal])
            if not len(dead):
                continue
            own, tags = [x[dead] for x in points], np.full(len(dead), -1, np.int64)
            for face in of[crystal]:
                left = np.flatnonzero(tags < 0)
                if not len(left):
                    break
                tags[left[face.holds([x[left] for x in own])]] = face.gb
            where = tuple(x[dead] for x in at)
            killed[where], tag[where] = True, tags
        return {"crystal": labels, "killed": killed, "gb": np.ma.array(tag, mask=tag < 0)}

    return over_blocks(voxels, blocks, "label", "<i8", kernel, "crystal long, killed boolean, gb long", faces_by_block(placed, blocks, lengths, thickness, crystals))


def erode_boundaries(voxels: DataFrame, faces: DataFrame, seeds: DataFrame, shape: Shape, lengths: Lengths = UNIT, thickness: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Eroded image (i, j, k, label, crystal) and grain-boundary table (gb_tag, nx, ny, nz, crystal_a, crystal_b).

    A voxel leaves its crystal when it lies within half the thickness of one of the cell's faces and over the face;
    it takes the tag of the first face (by grain boundary) whose pyramid to the seed holds it, else -1. Tags follow the
    crystals' labels without gaps. Of cells without a voxel only faces that a cell with voxels shares are looked at. Each face
    is repeated at its 27 places, those off the box are dropped, and those left meet the blocks of voxels that they reach and
    that hold their crystal (``eroded_blocks``): neither a large crystal nor a large image is one task's work, nor are many
    crystals on a small image. The image is written and read twice.
    """
    crystals = seeds.count()
    voxels = cut(voxels, "image")
    held = crystals_by_block(voxels, Blocks(shape))
    labels = held.select("crystal").distinct()
    for side in ("a", "b"):
        faces = faces.join(labels.select(F.col("crystal").alias(f"seed_{side}"), F.lit(True).alias(f"_{side}")), f"seed_{side}", "left")
    faces = cut(canonical_faces(cut(faces.where("_a or _b").drop("_b"), "faces")), "faces")
    own = faces.where("_a").join(seeds.select(F.col("seed_id").cast("long").alias("seed_a"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz")), "seed_a")
    placed = shifted(own, ["px", "py", "pz"], lengths)
    moved = F.transform("verts", lambda p: F.struct(*[(p[c] + F.col(f"s{c}")).alias(c) for c in "xyz"]))
    placed = placed.withColumn("verts", moved).withColumnRenamed("seed_a", "crystal")
    placed = on_box(placed, shape, lengths, thickness)
    tagged = cut(eroded_blocks(voxels, placed, shape, lengths, thickness, held), "eroded")
    tags = cut(renumbered(tagged.select("gb").where("gb is not null").distinct(), "gb", crystals, "gb_tag"), "tags", slim=True)
    few = tags.count() <= BROADCAST_TAGS
    image = tagged.join(F.broadcast(tags) if few else tags, "gb", "left")
    label = F.when(~F.col("killed"), F.col("crystal")).otherwise(F.coalesce("gb_tag", F.lit(-1)))
    image = image.select("i", "j", "k", label.cast("long").alias("label"), "crystal")
    lower = faces.where("seed_a <= seed_b").groupBy("gb").agg(F.min_by(F.struct("nx", "ny", "nz", F.col("seed_a").alias("crystal_a"), F.col("seed_b").alias("crystal_b")), F.struct("ox", "oy", "oz")).alias("m"))
    table = tags.join(lower, "gb").select("gb_tag", "m.nx", "m.ny", "m.nz", "m.crystal_a", "m.crystal_b")
    return image, table


def boundary_normals(image: DataFrame, table: DataFrame) -> DataFrame:
    """Dense field of normals: that of the voxel's grain boundary, zero inside crystals.

    Up to 200,000 boundaries (checked) are broadcast; more meet their voxels by a shuffle on the label.
    """
    zero = F.lit(0.0)
    small = table.limit(200_001).count() <= 200_000
    found = image.join(F.broadcast(table) if small else table, F.col("label") == F.col("gb_tag"), "left")
    return found.select("i", "j", "k", "label", *[F.coalesce(c, zero).alias(c) for c in ("nx", "ny", "nz")])


def boundary_json(table: DataFrame) -> DataFrame:
    """One row: all boundaries as JSON by tag, crystals included."""
    entry = F.struct("nx", "ny", "nz", "crystal_a", "crystal_b")
    return table.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("gb_tag").cast("string"), entry))))).alias("boundaries"))
