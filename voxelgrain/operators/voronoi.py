"""Periodic Voronoi tessellations: cells clipped seed by seed, and what their faces measure."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stages import cut
from .grids import UNIT, Lengths
from .kd import KdTree, kd_tree
from .merging import merged
from .order import numbered, running_total

_EPS, _AREA = 1e-10, 1e-12
_FACES = "seed_a long, seed_b long, ox int, oy int, oz int, nx double, ny double, nz double, distance double, area double, verts array<struct<x: double, y: double, z: double>>"


#: Ghosts that cells are clipped by between two looks at their radii, and ghosts of cells that are clipped side by side.
_LOOK, _TOGETHER = 8, 400_000
#: Corners of a cell within this are one corner of its faces.
_SAME = 1e-9


def clipped_cells(cell: np.ndarray, ghosts: np.ndarray, n: int, half: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners of ``n`` cells about the origin: each one's cell, place and three ghosts (numbers of rows, negative: a side of the
    box). ``ghosts`` are relative to the seed of their ``cell``; those at its own place don't count.

    Boxes are cut by one bisecting plane after another, the nearest first, all cells side by side, until no ghost is near
    enough to reach a corner. A corner holds its planes in a turn, so that two corners on an edge name its planes in opposite
    order: of those cut off, edges without their opposite are cut themselves, and each gets a corner on the new plane.
    """
    d2 = (ghosts**2).sum(axis=1)
    order = np.lexsort((d2, cell))
    order = order[d2[order] > _EPS**2]
    first = np.searchsorted(cell[order], np.arange(n + 1))
    sizes = np.diff(first)
    most = int(sizes.max(initial=0))
    d = np.sqrt(d2[order])
    sides = np.repeat(np.eye(3), 2, axis=0) * np.tile([-1.0, 1.0], 3)[:, None]
    # the planes of a cell: six sides of the box, then its ghosts
    normals = np.concatenate([np.tile(sides, (n, 1)), ghosts[order] / d[:, None]])
    signs = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)])
    turned = np.where((signs.sum(axis=1) % 2 == 1)[:, None], [0, 1, 2], [0, 2, 1])
    box = np.take_along_axis(signs + np.array([0, 2, 4]), turned, axis=1)
    own = np.repeat(np.arange(n), 8)
    at = np.tile((signs * 2.0 - 1.0) * half, (n, 1))
    planes = np.tile(box, (n, 1)) + 6 * own[:, None]
    total, done, stop = len(normals), [], sizes.copy()
    for step in range(most + 1):
        if step % _LOOK == 0 or step == most:
            r2 = np.zeros(n)
            np.maximum.at(r2, own, (at**2).sum(axis=1))
            rank = np.minimum(first[:-1] + step, max(len(order) - 1, 0))
            over = step >= stop
            if len(order):
                over |= d[rank] > 2 * np.sqrt(r2) + _EPS
            ended = over[own]
            done.append((own[ended], at[ended], planes[ended]))
            own, at, planes = own[~ended], at[~ended], planes[~ended]
            if not len(own):
                break
        live = step < stop[own]
        rank = np.where(live, first[own] + step, 0)
        normal = normals[6 * n + rank]
        height = np.where(live, at[:, 0] * normal[:, 0] + at[:, 1] * normal[:, 1] + at[:, 2] * normal[:, 2] - d[rank] / 2, -1.0)
        out = height > _EPS
        gone = np.flatnonzero(out)
        if not len(gone):
            continue
        one, two = planes[gone].ravel(), planes[gone][:, [1, 2, 0]].ravel()
        source = np.repeat(gone, 3)
        # planes are numbered over all cells: pairs of them name edges of one cell
        edge = np.flatnonzero(~np.isin(one * total + two, two * total + one))
        one, two, source = one[edge], two[edge], source[edge]
        along = np.cross(normals[one], normals[two])
        moved = at[source] - along * (height[source] / (along * normal[source]).sum(axis=1))[:, None]
        fresh = np.stack([one, two, 6 * n + rank[source]], axis=1)
        own, at, planes = (np.concatenate([x[~out], y]) for x, y in ((own, own[source]), (at, moved), (planes, fresh)))
    own, at, planes = (np.concatenate(c) for c in zip(*done, strict=True))
    row = np.where(planes < 6 * n, -1, order[np.maximum(planes - 6 * n, 0)] if len(order) else -1)
    return own, at, row


def loops_of(own: np.ndarray, at: np.ndarray, row: np.ndarray, ghosts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Faces of clipped cells: each one's cell, ghost and area, how many corners it has, and all corners in turn."""
    cell, face, p = np.repeat(own, 3), row.ravel(), np.repeat(at, 3, axis=0)
    real = face >= 0
    cell, face, p = cell[real], face[real], p[real]

    def groups(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.diff(f, prepend=-1))
        sizes = np.diff(np.append(first, len(f)))
        return first, sizes, np.repeat(np.arange(len(first)), sizes)

    # a row is a ghost of one cell
    order = np.argsort(face, kind="stable")
    cell, face, p = cell[order], face[order], p[order]
    first, sizes, of = groups(face)
    if not len(first):
        return cell, face, np.zeros(0), sizes, p
    normal = ghosts[face[first]]
    normal = normal / np.sqrt((normal**2).sum(axis=1))[:, None]
    middle = np.add.reduceat(p, first, axis=0) / sizes[:, None]
    u = np.cross(normal, np.where((np.abs(normal[:, 0]) < 0.9)[:, None], [1.0, 0, 0], [0, 1.0, 0]))
    u /= np.sqrt((u**2).sum(axis=1))[:, None]
    v = np.cross(normal, u)
    away = p - middle[of]
    order = np.lexsort((np.arctan2((away * v[of]).sum(axis=1), (away * u[of]).sum(axis=1)), of))
    cell, face, p = cell[order], face[order], p[order]

    def before(first: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
        back = np.arange(n) - 1
        back[first] = first + sizes - 1
        return back

    far = (np.abs(p - p[before(first, sizes, len(p))]) > _SAME).any(axis=1)
    cell, face, p = cell[far], face[far], p[far]
    first, sizes, of = groups(face)
    if not len(first):
        return cell, face, np.zeros(0), sizes, p
    o = p[first][of]
    cross = np.cross(p[before(first, sizes, len(p))] - o, p - o)
    area = 0.5 * np.sqrt((np.add.reduceat(cross, first, axis=0) ** 2).sum(axis=1))
    area[sizes < 3] = 0
    keep = area >= _AREA
    return cell[first][keep], face[first][keep], area[keep], sizes[keep], p[keep[of]]


def clipped_polygon(ghosts: np.ndarray, half: float) -> list[tuple[int, np.ndarray]]:
    """Edges of one plane cell about the origin: (ghost number, two ends). ``ghosts`` are relative, nearest first."""
    loop = np.array([[-half, -half], [half, -half], [half, half], [-half, half]])
    owners = [-1] * 4
    radius = np.sqrt((loop**2).sum(axis=1)).max()
    for number, ghost in enumerate(ghosts):
        d = np.sqrt(ghost @ ghost)
        if d > 2 * radius + _EPS:
            break
        height = loop @ (ghost / d) - d / 2
        height[np.abs(height) < _EPS] = 0
        if height.max() <= 0:
            continue
        points, own = [], []
        for i in range(len(loop)):
            j = (i + 1) % len(loop)
            cross = loop[i] + (loop[j] - loop[i]) * (height[i] / (height[i] - height[j])) if height[i] * height[j] < 0 else None
            if height[i] <= 0:
                points.append(loop[i])
                # an edge that leaves the half plane here gives way to the new one
                own.append(number if height[i] == 0 and height[j] > 0 else owners[i])
                if cross is not None:
                    points.append(cross)
                    own.append(number)
            elif cross is not None:
                points.append(cross)
                own.append(owners[i])
        loop, owners = np.array(points), own
        radius = np.sqrt((loop**2).sum(axis=1)).max()
    return [(owner, np.array([loop[i], loop[(i + 1) % len(loop)]])) for i, owner in enumerate(owners)]


_NAMES = ["seed_a", "seed_b", "ox", "oy", "oz", "nx", "ny", "nz", "distance", "area", "verts"]
_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 5, pa.list_(pa.struct([(c, pa.float64()) for c in "xyz"])))
#: Seeds that are sent to every executor (32 bytes each); more are met by blocks.
BROADCAST_SEEDS = 200_000
#: Seeds of a block, about.
BLOCK_SEEDS = 2048


def _edge_rows(seed: int, at: np.ndarray, ghosts: np.ndarray, ids: np.ndarray, offsets: np.ndarray, half: float, height: float) -> tuple[list[tuple], float]:
    """Rows of one plane cell's edges, and twice its radius: further ghosts don't matter. ``ghosts`` are relative to ``at``."""
    d2 = (ghosts**2).sum(axis=1)
    order = np.argsort(d2, kind="stable")
    order = order[d2[order] > _EPS**2]
    found = clipped_polygon(ghosts[order], half)
    rows = []
    for number, loop in found:
        area = float(np.sqrt(((loop[1] - loop[0]) ** 2).sum()))
        if number < 0 or area < _AREA:
            continue
        ghost = order[number]
        d = np.sqrt(d2[ghost])
        normal, where, corners = [*(ghosts[ghost] / d), 0.0], [*offsets[ghost].tolist(), 0], [[*p, height] for p in (loop + at).tolist()]
        rows.append((seed, int(ids[ghost]), *where, *map(float, normal), float(d), area, [dict(zip("xyz", p, strict=True)) for p in corners]))
    return rows, 2 * max(np.sqrt((loop**2).sum(axis=1)).max() for _, loop in found)


def _face_rows(seeds: np.ndarray, at: np.ndarray, cell: np.ndarray, ghosts: np.ndarray, ids: np.ndarray, offsets: np.ndarray, half: float) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows of the cells' faces, and twice the radius of each: further ghosts don't matter. ``ghosts`` are relative to the
    places ``at`` of the seeds that ``cell`` numbers."""
    own, corners, row = clipped_cells(cell, ghosts, len(seeds), half)
    r2 = np.zeros(len(seeds))
    np.maximum.at(r2, own, (corners**2).sum(axis=1))
    of, ghost, area, sizes, verts = loops_of(own, corners, row, ghosts)
    d = np.sqrt((ghosts[ghost] ** 2).sum(axis=1))
    verts = verts + np.repeat(at[of], sizes, axis=0)
    listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.StructArray.from_arrays([pa.array(verts[:, k].copy()) for k in range(3)], list("xyz")))
    columns = [pa.array(seeds[of], pa.int64()), pa.array(ids[ghost], pa.int64()), *[pa.array(offsets[ghost, k], pa.int32()) for k in range(3)], *[pa.array(ghosts[ghost, k] / d) for k in range(3)], pa.array(d), pa.array(area), listed]
    return pa.RecordBatch.from_arrays(columns, _NAMES), 2 * np.sqrt(r2)


def _parts(sizes: np.ndarray, most: int = _TOGETHER) -> list[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to about ``most``, of one at least."""
    turn = (np.cumsum(sizes) - sizes) // most
    edges = np.append(np.flatnonzero(np.diff(turn, prepend=-1)), len(sizes)).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


class _Binned:
    """Seeds in cells of about one; ghosts of a place come from the cells around it, over the box's faces."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, box: np.ndarray) -> None:
        self.box = box
        self.per_axis = np.maximum(1, np.floor(len(points) ** (1 / len(box)) * box / box.max()).astype(int))
        self.size = box / self.per_axis
        cell = np.minimum((points % box / self.size).astype(int), self.per_axis - 1)
        flat = np.ravel_multi_index(tuple(cell.T), self.per_axis)
        by_cell = np.argsort(flat, kind="stable")
        self.points, self.ids = points[by_cell], ids[by_cell]
        self.bounds = np.searchsorted(flat[by_cell], np.arange(self.per_axis.prod() + 1))

    def around(self, at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """Ghosts relative to ``at``, their ids and box offsets, and whether these are all of the 27 (9) places."""
        own = np.minimum((at % self.box / self.size).astype(int), self.per_axis - 1)
        axes = [np.arange(max(c - reach, -n), min(c + reach, 2 * n - 1) + 1) for c, n in zip(own, self.per_axis, strict=True)]
        cells = np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, len(axes))
        wrapped, shift = cells % self.per_axis, cells // self.per_axis
        flat = np.ravel_multi_index(tuple(wrapped.T), self.per_axis)
        counts = self.bounds[flat + 1] - self.bounds[flat]
        pick = np.repeat(self.bounds[flat] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        offsets = np.repeat(shift, counts, axis=0)
        whole = all(len(a) == 3 * n for a, n in zip(axes, self.per_axis, strict=True))
        return self.points[pick] + offsets * self.box - at, self.ids[pick], offsets, whole

    def about(self, at: np.ndarray, reach: int):
        """Of many places, some at a time: (first, last, cell, ghosts relative to the cell's place, ids, box offsets). Ghosts come
        from bins within ``reach``, and are those within that many bins' sides unless these are all."""
        own = np.minimum((at % self.box / self.size).astype(int), self.per_axis - 1)
        whole = self.whole(reach)
        step = np.stack(np.meshgrid(*[np.arange(-min(reach, 2 * n), min(reach, 2 * n) + 1) for n in self.per_axis], indexing="ij"), axis=-1).reshape(-1, len(self.box))
        for i, j in _parts(np.full(len(at), len(step)), 4 * _TOGETHER):
            bins = own[i:j, None] + step
            inside = ((bins >= -self.per_axis) & (bins < 2 * self.per_axis)).all(axis=2).ravel()
            cell, bins = np.repeat(np.arange(i, j), len(step))[inside], bins.reshape(-1, len(self.box))[inside]
            flat, shift = np.ravel_multi_index(tuple((bins % self.per_axis).T), self.per_axis), bins // self.per_axis
            counts = self.bounds[flat + 1] - self.bounds[flat]
            each = np.bincount(cell - i, weights=counts, minlength=j - i).astype(np.int64)
            bounds = np.searchsorted(cell, np.arange(i, j + 1))
            for k, m in _parts(each):
                part = slice(bounds[k], bounds[m])
                c = counts[part]
                pick = np.repeat(self.bounds[flat[part]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                of, offsets = np.repeat(cell[part], c), np.repeat(shift[part], c, axis=0)
                ghosts = self.points[pick] + offsets * self.box - at[of]
                if not whole:
                    near = (ghosts**2).sum(axis=1) <= (reach * self.size.min()) ** 2
                    of, offsets, ghosts, pick = of[near], offsets[near], ghosts[near], pick[near]
                yield i + k, i + m, of - (i + k), ghosts, self.ids[pick], offsets

    def whole(self, reach: int) -> bool:
        """Whether bins within ``reach`` of any are all of the 27 places."""
        return bool((reach >= 2 * self.per_axis - 1).all())


def tessellate(seeds: DataFrame, lengths: Sequence[float] = UNIT) -> DataFrame:
    """Faces of every cell, each from both its sides: seed_a, seed_b, box offset of b, outward normal, distance of the two
    seeds, area and vertices (in the frame of the box, where seed_a lies in it).

    Two lengths make a plane tessellation: cells are polygons, ``area`` is an edge's length, ``verts`` are its ends. Cells
    are independent. Up to ``BROADCAST_SEEDS`` seeds (checked) go to the executors in bins, and each cell looks at bins
    around it until no further seed can reach it; more are met block by block (``tessellate_blocks``).
    """
    if seeds.limit(BROADCAST_SEEDS + 1).count() > BROADCAST_SEEDS:
        return tessellate_blocks(seeds, lengths)
    held = seeds.select("seed_id", "x", "y", "z").orderBy("seed_id").toPandas()
    dim, box = len(lengths), np.array(lengths, float)
    ids, points = held["seed_id"].to_numpy(np.int64), held[["x", "y", "z"]].to_numpy(float)[:, :dim]

    def clipped(binned: _Binned, batch: pa.RecordBatch):
        """Faces of the cells whose bins hold all that can reach them; the others look further."""
        names, at, reach = batch.column(0).to_numpy(), np.stack([batch.column(k).to_numpy() for k in (1, 2, 3)], axis=1), 3
        # cells that lie together are clipped together
        order = np.lexsort((at // (8 * binned.size)).T)
        names, at = names[order], at[order]
        while len(names):
            far = []
            for i, j, cell, ghosts, others, offsets in binned.about(at, reach):
                faces, needed = _face_rows(names[i:j], at[i:j], cell, ghosts, others, offsets, float(box.max()))
                open_ = np.zeros(j - i, bool) if binned.whole(reach) else needed > reach * binned.size.min()
                far += (i + np.flatnonzero(open_)).tolist()
                yield faces.filter(pa.array(~np.isin(faces.column(0).to_numpy(), names[i:j][open_]))) if open_.any() else faces
            names, at, reach = names[far], at[far], reach + 2

    def run(batches):
        binned = _Binned(points, ids, box)
        for batch in batches:
            if dim == 3:
                yield from clipped(binned, batch)
                continue
            rows = []
            for seed, *xyz in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                at, reach = np.array(xyz[:dim]), 3
                while True:
                    ghosts, names, offsets, whole = binned.around(at, reach)
                    own, needed = _edge_rows(seed, at, ghosts, names, offsets, float(box.max()), xyz[2])
                    if whole or needed <= reach * binned.size.min():
                        break
                    reach += 2
                rows += own
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    # a few seeds are much work: a number of tasks that adaptive execution doesn't merge again
    tasks = min(max(seeds.sparkSession.sparkContext.defaultParallelism, len(ids) // 64), max(len(ids), 1))
    dealt = seeds.select(F.col("seed_id").cast("long").alias("seed_id"), "x", "y", "z").repartition(tasks, "seed_id")
    return dealt.mapInArrow(run, _FACES)


#: A cell on its way: its seed, the block to visit next (null: none), and ghosts that hold all of its faces so far.
_GHOST = "id long, ox int, oy int, oz int, x double, y double, z double"
_OPEN = f"seed_id long, x double, y double, z double, leaf long, sx int, sy int, sz int, ghosts array<struct<{_GHOST}>>"
_GHOST_TYPE = pa.list_(pa.struct([("id", pa.int64()), *[(f"o{c}", pa.int32()) for c in "xyz"], *[(c, pa.float64()) for c in "xyz"]]))
_OPEN_TYPES = (pa.int64(), *[pa.float64()] * 3, pa.int64(), *[pa.int32()] * 3, _GHOST_TYPE)
_OPEN_NAMES = ["seed_id", "x", "y", "z", "leaf", "sx", "sy", "sz", "ghosts"]
#: Sampled seeds about a block that its cells are clipped by at first, of each thinning; and ghosts that are clipped at a time.
NEAR_GUARDS, _STEP = 512, 24
#: Cells of a block that are clipped side by side.
_SIDE_BY_SIDE = 256


def _open_table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(_OPEN_TYPES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _OPEN_TYPES, strict=True)], names=_OPEN_NAMES)


def _held(at: np.ndarray, points: np.ndarray, ids: np.ndarray, offsets: np.ndarray, half: float, first: int = 0) -> tuple[list[tuple], np.ndarray]:
    """``_held_cells`` of one plane cell."""
    relative = points - at
    d2 = (relative**2).sum(axis=1)
    order = np.argsort(d2, kind="stable")
    order = order[d2[order] > _EPS**2]
    chosen, rest = (order[order < first], order[order >= first]) if first else (order[:_STEP], order[_STEP:])
    while True:
        found = clipped_polygon(relative[chosen], half)
        vertices = np.concatenate([loop for _, loop in found])
        bounding = chosen[sorted({n for n, _ in found if n >= 0})]
        rest = rest[_cutting(relative[rest], d2[rest], vertices)]
        if not len(rest):
            break
        chosen, rest = np.concatenate([bounding, rest[:_STEP]]), rest[_STEP:]
        chosen = chosen[np.argsort(d2[chosen], kind="stable")]
    return _ghosts(bounding, points, ids, offsets), vertices


def _cutting(relative: np.ndarray, d2: np.ndarray, vertices: np.ndarray) -> np.ndarray:
    """Which ghosts cut a cell: those nearer to one of its vertices than its seed is."""
    near = np.flatnonzero(d2 <= 4 * (vertices**2).sum(axis=1).max() * (1 + 1e-9))
    level = d2[near] + 2 * _EPS * np.sqrt(d2[near])
    return near[(2 * relative[near] @ vertices.T > level[:, None]).any(axis=1)]


def _ghosts(bounding: np.ndarray, points: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    return [(i, *[*o, 0][:3], *[*p, 0.0][:3]) for i, o, p in zip(ids[bounding].tolist(), offsets[bounding].tolist(), points[bounding].tolist(), strict=True)]


def _held_cells(cells: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]], half: float) -> Iterator[tuple[list[tuple], np.ndarray]]:
    """Of each cell (at, points, ids, offsets, first): those of the ghosts (absolute places) that bound it, and its vertices
    about ``at``.

    A cell is clipped by the ``first`` ghosts or the nearest ones; of the rest only those are looked at again that cut what is
    left, which is those nearer to one of its vertices than ``at`` is. Cells are clipped some at a time.
    """
    for group in iter(lambda turn=iter(cells): list(islice(turn, _SIDE_BY_SIDE)), []):
        if len(group[0][0]) == 2:
            yield from (_held(at, points, ids, offsets, half, first) for at, points, ids, offsets, first in group)
            continue
        state, done = {}, {}
        for k, (at, points, _, _, first) in enumerate(group):
            relative = points - at
            d2 = (relative**2).sum(axis=1)
            seen = np.flatnonzero(d2 > _EPS**2)
            if first:
                chosen, rest = seen[seen < first], seen[seen >= first]
            else:
                nearest = np.argpartition(d2[seen], _STEP)[:_STEP] if len(seen) > _STEP else np.arange(len(seen))
                chosen, rest = seen[nearest], np.delete(seen, nearest)
            state[k] = relative, d2, chosen, rest
        while state:
            of = list(state)
            sizes = [len(state[k][2]) for k in of]
            own, at, row = clipped_cells(np.repeat(np.arange(len(of)), sizes), np.concatenate([state[k][0][state[k][2]] for k in of]), len(of), half)
            order = np.argsort(own, kind="stable")
            at, row, edges, starts = at[order], row[order], np.searchsorted(own[order], np.arange(len(of) + 1)), np.cumsum(sizes) - sizes
            for n, k in enumerate(of):
                relative, d2, chosen, rest = state[k]
                vertices, used = at[edges[n] : edges[n + 1]], np.unique(row[edges[n] : edges[n + 1]])
                bounding = chosen[used[used >= 0] - starts[n]]
                rest = rest[_cutting(relative[rest], d2[rest], vertices)]
                if len(rest):
                    rest = rest[np.argsort(d2[rest], kind="stable")]
                    state[k] = relative, d2, np.concatenate([bounding, rest[:_STEP]]), rest[_STEP:]
                else:
                    _, points, ids, offsets, _ = group[k]
                    done[k] = _ghosts(bounding[np.argsort(d2[bounding], kind="stable")], points, ids, offsets), vertices
                    del state[k]
        yield from (done[k] for k in range(len(group)))


def _as_dicts(ghosts: list[tuple]) -> list[dict]:
    return [dict(zip(("id", "ox", "oy", "oz", "x", "y", "z"), g, strict=True)) for g in ghosts]


def _ghost_arrays(ghosts: list[dict], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points = np.array([[g[c] for c in "xyz"[:dim]] for g in ghosts], float).reshape(-1, dim)
    offsets = np.array([[g[f"o{c}"] for c in "xyz"[:dim]] for g in ghosts], np.int32).reshape(-1, dim)
    return points, np.array([g["id"] for g in ghosts], np.int64), offsets


def _own_kernel(tree: KdTree, half: float):
    """Cells clipped by the seeds of their block and by sampled seeds about it: a row for each block that may hold more of a
    cell's neighbours, or one row without a block if none may."""
    dim = len(tree.box)

    def run(rows: pa.Table) -> pa.Table:
        xyz = np.stack([rows[c].to_numpy() for c in "xyz"], axis=1)
        own, leaf = xyz[:, :dim], rows["leaf"][0].as_py()
        near, number, shifts = tree.guards_about(leaf, NEAR_GUARDS)
        points, ids = np.concatenate([own, near]), np.concatenate([rows["seed_id"].to_numpy(), tree.ids[number]])
        offsets = np.concatenate([np.zeros(own.shape, np.int32), shifts.astype(np.int32)])
        cells, out = list(_held_cells(((own[k], points, ids, offsets, 0) for k in range(len(own))), half)), []
        # a seed cuts a cell only if it is nearer to a vertex than the cell's own seed is
        vertices = [np.unique(np.round(v, 12), axis=0) for _, v in cells]
        of = np.repeat(np.arange(len(own)), list(map(len, vertices)))
        vertices = np.concatenate(vertices)
        n, leaves, moved = tree.reached(own[of] + vertices, (vertices**2).sum(axis=1) * (1 + 1e-9) + _EPS)
        visits: dict[int, set] = {k: set() for k in range(len(own))}
        for k, b, *s in np.unique(np.column_stack([of[n], leaves, moved]), axis=0).tolist():
            if b != leaf or any(s):
                visits[k].add((b, *[*s, 0][:3]))
        for k, (ghosts, _) in enumerate(cells):
            head, packed = (int(ids[k]), *xyz[k].tolist()), _as_dicts(ghosts)
            out += [(*head, *v, packed) for v in sorted(visits[k])] or [(*head, *[None] * 4, packed)]
        return _open_table(out)

    return run


def _visit_kernel(box: np.ndarray, half: float):
    dim = len(box)

    def run(cells: pa.Table, seeds: pa.Table) -> pa.Table:
        """Visiting cells, clipped by a block's seeds as well."""
        own = np.stack([seeds[c].to_numpy() for c in "xyz"[:dim]], axis=1) if seeds.num_rows else np.empty((0, dim))
        ids, rows = seeds["seed_id"].to_numpy(), cells.to_pylist()

        def visits():
            for r in rows:
                at = np.array([r[c] for c in "xyz"[:dim]])
                shift = np.array([r[f"s{c}"] for c in "xyz"[:dim]], np.int32)
                points, names, offsets = _ghost_arrays(r["ghosts"], dim)
                yield at, np.concatenate([points, own + shift * box]), np.concatenate([names, ids]), np.concatenate([offsets, np.tile(shift, (len(own), 1))]), len(points)

        return _open_table([(r["seed_id"], r["x"], r["y"], r["z"], *[None] * 4, _as_dicts(ghosts)) for r, (ghosts, _) in zip(rows, _held_cells(visits(), half), strict=True)])

    return run


def _dealt(seeds: DataFrame, tree: KdTree) -> DataFrame:
    """seed_id, x, y, z and ``leaf``, the block of each seed."""

    def run(batches):
        for batch in batches:
            leaf = tree.leaf(np.stack([batch.column(1 + a).to_numpy() for a in range(len(tree.box))], axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["seed_id", "x", "y", "z", "leaf"])

    return seeds.mapInArrow(run, "seed_id long, x double, y double, z double, leaf long")


def tessellate_blocks(seeds: DataFrame, lengths: Sequence[float] = UNIT, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """The same faces without a machine that holds all seeds, whether seeds lie evenly or in clusters.

    Seeds are dealt to k-d blocks of about ``block_seeds``. A cell is clipped by the seeds of its block and by sampled seeds of
    blocks around it, which are dense where seeds are. What a further seed could still cut is known then: the cell visits
    the blocks that come nearer to one of its vertices than its own seed, each clips it apart, and the ghosts that bound it
    anywhere bound the whole cell. Cells inside a block visit none. Cells and visits are written, each is worked on once.
    """
    dim, box = len(lengths), np.array(lengths, float)
    half = float(box.max())
    every = cut(seeds.select(F.col("seed_id").cast("long").alias("seed_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"]), "seeds")
    if not every.limit(1).count():
        return every.sparkSession.createDataFrame([], _FACES)
    tree = kd_tree(every, lengths, block_seeds)
    # little data is much work: as many tasks as blocks, which adaptive execution doesn't merge
    tasks = 1 << tree.depth
    placed = _dealt(every, tree).repartition(tasks, "leaf")
    started = cut(placed.groupBy("leaf").applyInArrow(_own_kernel(tree, half), _OPEN), "cells")
    visited = started.where("leaf is not null").repartition(tasks, "leaf").groupBy("leaf").cogroup(placed.groupBy("leaf")).applyInArrow(_visit_kernel(box, half), _OPEN)
    whole = visited.repartition(tasks, "seed_id").groupBy("seed_id", "x", "y", "z").agg(F.array_distinct(F.flatten(F.collect_list("ghosts"))).alias("ghosts"))

    def faces(batches):
        for batch in batches:
            cells, rows = batch.to_pylist(), []
            if dim == 3:
                for i, j in _parts(np.array([len(r["ghosts"]) for r in cells])):
                    own = cells[i:j]
                    at = np.array([[r[c] for c in "xyz"] for r in own])
                    sizes = [len(r["ghosts"]) for r in own]
                    points, names, offsets = _ghost_arrays([g for r in own for g in r["ghosts"]], dim)
                    cell = np.repeat(np.arange(len(own)), sizes)
                    yield _face_rows(np.array([r["seed_id"] for r in own]), at, cell, points - at[cell], names, offsets, half)[0]
                continue
            for r in cells:
                at = np.array([r[c] for c in "xyz"[:dim]])
                points, names, offsets = _ghost_arrays(r["ghosts"], dim)
                rows += _edge_rows(r["seed_id"], at, points - at, names, offsets, half, r["z"])[0]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    columns = ["seed_id", "x", "y", "z", "ghosts"]
    return cut(started.where("leaf is null").select(*columns).unionByName(whole.select(*columns)).mapInArrow(faces, _FACES), "faces")


def cell_volumes(faces: DataFrame, dimensions: int = 3) -> DataFrame:
    """seed_id, volume: cones from the seed over all faces of its cell (triangles over its edges, in the plane)."""
    return faces.groupBy(F.col("seed_a").alias("seed_id")).agg(F.sum(F.col("area") * F.col("distance") / (2.0 * dimensions)).alias("volume"))


def cell_polygons(faces: DataFrame) -> DataFrame:
    """seed_id and the corners of each cell of a plane tessellation, anticlockwise."""
    ends = faces.select(F.col("seed_a").alias("seed_id"), F.explode("verts").alias("p"), "nx", "ny")
    corner = ends.select("seed_id", *[F.round(F.col(f"p.{c}"), 9).alias(c) for c in "xyz"]).distinct()
    middle = corner.groupBy("seed_id").agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"), F.collect_list(F.struct("x", "y", "z")).alias("_p"))
    turned = F.array_sort(F.transform("_p", lambda p: F.struct(F.atan2(p["y"] - F.col("_y"), p["x"] - F.col("_x")).alias("angle"), p.alias("p"))))
    return middle.select("seed_id", F.transform(turned, lambda t: t["p"]).alias("verts"))


def unique_faces(faces: DataFrame) -> DataFrame:
    """Each face once, seen from its smaller seed (of a seed's faces with its own images, from the positive offset)."""
    own = (F.col("seed_a") == F.col("seed_b")) & ((F.col("ox") > 0) | ((F.col("ox") == 0) & ((F.col("oy") > 0) | ((F.col("oy") == 0) & (F.col("oz") > 0)))))
    return faces.where((F.col("seed_a") < F.col("seed_b")) | own)


def neighbours(faces: DataFrame) -> DataFrame:
    """seed_id and its sorted distinct neighbours."""
    pairs = faces.where("seed_a <> seed_b").select(F.col("seed_a").alias("seed_id"), "seed_b").distinct()
    return pairs.groupBy("seed_id").agg(F.array_sort(F.collect_list("seed_b")).alias("neighbours"))


def interface_measures(faces: DataFrame, count: str = "unique") -> DataFrame:
    """One row: interface_area. ``unique`` counts each face once, ``reference`` a face across the boundary at each place."""
    if count not in ("unique", "reference"):
        raise ValueError(f"unknown count {count!r}")
    once = unique_faces(faces)
    places = F.lit(1) if count == "unique" else F.when((F.col("ox") == 0) & (F.col("oy") == 0) & (F.col("oz") == 0), 1).otherwise(2)
    return once.agg(F.sum(F.col("area") * places).alias("interface_area"))


def structure_tensor(faces: DataFrame, normal: Sequence[str] = ("nx", "ny", "nz"), weight: str = "area", order: int = 2) -> DataFrame:
    """Components (a, b[, c, d], value) of the sum of weight times the normal's outer power, ``order`` 2 or 4."""
    names = "abcd"[:order]
    axis = F.array(*[F.lit(i) for i in range(3)])
    out = faces.select(weight, F.array(*normal).alias("_n"))
    for name in names:
        out = out.withColumn(name, F.explode(axis))
    product = F.col(weight)
    for name in names:
        product = product * F.get(F.col("_n"), F.col(name))
    return out.groupBy(*names).agg(F.sum(product).alias("value"))


def polygon_area_column(verts, normal: Sequence) -> F.Column:
    """Area of a planar polygon (array of structs x, y, z) with the given normal: half the normal part of the edges' cross sum."""
    nx, ny, nz = normal
    length = F.sqrt(nx * nx + ny * ny + nz * nz)
    turned = F.concat(F.slice(verts, 2, F.size(verts) - 1), F.slice(verts, 1, 1))
    term = lambda p, q: nx * (p["y"] * q["z"] - p["z"] * q["y"]) + ny * (p["z"] * q["x"] - p["x"] * q["z"]) + nz * (p["x"] * q["y"] - p["y"] * q["x"])
    return F.abs(F.aggregate(F.zip_with(verts, turned, term), F.lit(0.0), lambda s, x: s + x)) * 0.5 / length


def circular_edges(polygons: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """Every vertex row with the next vertex of its polygon (x2, y2), the last with the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return polygons.select("*", *[F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(f"{c}2") for c in (x, y)])


def face_edges(faces: DataFrame) -> DataFrame:
    """Edges of all faces as struts ax..bz, in cyclic order."""
    pieces = faces.select(F.posexplode("verts").alias("_p", "_v"), "verts")
    after = F.get("verts", F.pmod(F.col("_p") + 1, F.size("verts")))
    return pieces.select(*[F.col(f"_v.{c}").alias(f"a{c}") for c in "xyz"], *[after[c].alias(f"b{c}") for c in "xyz"])


def shifted(df: DataFrame, columns: Sequence[str], lengths: Lengths = UNIT) -> DataFrame:
    """Rows at all 27 periodic places; ``columns`` are coordinates named by their last letter, ``sx``, ``sy``, ``sz`` the shift."""
    steps = F.array(*[F.lit(o) for o in (-1, 0, 1)])
    for c, length in zip("xyz", lengths, strict=True):
        df = df.withColumn("_step", F.explode(steps)).withColumn(f"s{c}", F.col("_step") * F.lit(float(length))).drop("_step")
        df = df.withColumns({name: F.col(name) + F.col(f"s{c}") for name in columns if name.endswith(c)})
    return df


def distinct_edges(struts: DataFrame, lengths: Lengths = UNIT, tolerance: float = 1e-6) -> DataFrame:
    """Edges once: same middle and direction up to the signs of its components, within ``tolerance``; of several the least stays.

    Most copies are equal to six digits and go first; what rounding parts is merged by bins and components (``merging``).
    """
    d = {c: F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"}
    length = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]) + 1e-15
    middle, turn, rounded = {}, {}, {}
    for c, box in zip("xyz", lengths, strict=True):
        middle[f"_m{c}"] = (F.col(f"a{c}") + F.col(f"b{c}")) * 0.5 / max(box, 1.0)
        turn[f"_d{c}"] = -F.abs(d[c] / length)
    keys = {**middle, **turn}
    rounded = {f"_r{n}": F.round(k, 6) + 0.0 for n, k in keys.items()}
    whole = struts.withColumns(keys).withColumns(rounded)
    once = whole.groupBy(*rounded).agg(F.min(F.struct(*struts.columns, *keys)).alias("_one")).select("_one.*")
    once = cut(once, "edges")
    names = list(keys)
    placed = once.join(merged(once, names, tolerance).drop("_id"), names)
    return placed.groupBy("_root").agg(F.min(F.struct(*struts.columns)).alias("_one")).select("_one.*")


def foam(spark, faces: DataFrame, shape, lengths: Lengths = UNIT, radius: float = 0.05, exact: bool = False) -> DataFrame:
    """(i, j, k, label) of the struts along all cell edges; ``exact`` measures the distance to the edge itself, periodically."""
    from ..functions.periodic import inside_cell
    from .raster import binary_image, exact_struts, stamp_struts

    edges = distinct_edges(face_edges(unique_faces(faces)), lengths)
    if exact:
        return binary_image(spark, shape, exact_struts(edges, shape, lengths, radius))
    places = shifted(edges, [f"{e}{c}" for e in "ab" for c in "xyz"], lengths)
    ends = [inside_cell([F.col(f"{e}{c}") for c in "xyz"], lengths) for e in "ab"]
    near = distinct_edges(places.where(ends[0] | ends[1]), lengths)
    return binary_image(spark, shape, stamp_struts(near, shape, lengths, radius))


def vertex_places(faces: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """x, y, z of every distinct corner of the faces with ``vertex``, the number (from 0) of the vertex that it is: corners
    within ``tolerance`` of each other, or joined by a chain of such, are one. Written."""
    points = faces.select(F.explode("verts").alias("p")).select(*[F.col(f"p.{c}").alias(c) for c in "xyz"])
    found = cut(merged(points, ["x", "y", "z"], tolerance), "corners")
    # numbers follow the least corner of each vertex, to nine digits
    heads = found.where("_id = _root").select(*[(F.round(c, 9) + 0.0).alias(f"_{c}") for c in "xyz"], "_root")
    heads = numbered(heads, ["_x", "_y", "_z", "_root"], "vertex").select("_root", F.col("vertex").cast("int").alias("vertex"))
    return cut(found.join(heads, "_root").select("x", "y", "z", "vertex", (F.col("_id") == F.col("_root")).alias("least")), "vertices")


def vertex_table(faces: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Distinct vertices, within a tolerance, with contiguous ids: vertex, x, y, z (of the least of its corners, to nine digits)."""
    return vertex_places(faces, tolerance).where("least").select("vertex", *[F.round(F.col(c), 9).alias(c) for c in "xyz"])


def running_offsets(df: DataFrame, order: Sequence[str], size: str, out: str = "offset", group: Sequence[str] = ()) -> DataFrame:
    """Running sum of ``size`` in order: within groups, if given, else over ranges of the first column in order."""
    if not group:
        return running_total(df, order, F.col(size), out)
    return df.withColumn(out, F.sum(size).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
