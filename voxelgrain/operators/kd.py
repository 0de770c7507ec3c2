"""Blocks of about equal counts: k-d splits of a periodic box, learnt from a bounded sample of its points.

A block is a leaf of the tree. The sample's points (guards) are points of the set, so distances to them bound distances to the
nearest point from above wherever points lie dense or thin: whoever looks for neighbours visits only the blocks within that bound.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sampled points a block, and the most blocks: the sample that goes to the driver and to every task has at most twice
#: their product of points (32 bytes each, 33 MB); beyond, blocks grow.
GUARDS, MOST_BLOCKS = 64, 8192


class KdTree:
    """Splits of ``box`` (from the origin) at medians of ``points``, ``depth`` levels deep; leaves are numbered from 0.

    A node is split along the axis in which its points spread most. Points that are all equal can't be split: one side stays
    empty, and takes the guards of its parent.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, box: Sequence[float], depth: int) -> None:
        self.box, self.depth, self.points, self.ids = np.array(box, float), depth, points, ids
        leaves, dim = 1 << depth, len(self.box)
        self.axis, self.at = np.zeros(leaves, np.int64), np.full(leaves, np.inf)
        # tight about points that lie outside the box, too
        self.low = np.tile(np.minimum(0.0, points.min(axis=0)), (2 * leaves, 1))
        self.high = np.tile(np.maximum(self.box, points.max(axis=0)), (2 * leaves, 1))
        held = {1: np.arange(len(points))}
        for node in range(1, leaves):
            own = points[held[node]]
            axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
            values = np.sort(own[:, axis])
            at = values[len(values) // 2]
            if at == values[0]:
                above = values[values > at]
                at = above[0] if len(above) else np.inf
            right = own[:, axis] >= at
            self.axis[node], self.at[node] = axis, at
            for child, side in ((2 * node, ~right), (2 * node + 1, right)):
                held[child] = held[node][side] if side.any() else held[node]
                self.low[child], self.high[child] = self.low[node], self.high[node]
            edge = min(at, self.high[node][axis])
            self.high[2 * node][axis] = self.low[2 * node + 1][axis] = edge
        own = [held[leaves + k] for k in range(leaves)]
        width = max(map(len, own))
        #: Numbers of each leaf's points; shorter lists repeat their first.
        self.of_leaf = np.array([np.concatenate([o, np.full(width - len(o), o[0], o.dtype)]) for o in own])
        self.shifts = np.array(list(itertools.product((0, -1, 1), repeat=dim)))

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.at[node])
        return node - (1 << self.depth)

    def bound(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to the nearest guard of its own leaf: no nearest point is further."""
        guards = self.points[self.of_leaf[self.leaf(points)]]
        return ((guards - points[:, None]) ** 2).sum(axis=2).min(axis=1)

    def reached(self, points: np.ndarray, radii2: np.ndarray, periodic: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the point, leaf, shift) of each leaf, moved by ``shift`` boxes, that meets the ball about a point."""
        found = []
        for shift in self.shifts if periodic else self.shifts[:1]:
            moved = points - shift * self.box
            at, node = np.arange(len(points)), np.ones(len(points), np.int64)
            for level in range(self.depth + 1):
                if level:
                    at, node = np.repeat(at, 2), (2 * node[:, None] + np.arange(2)).ravel()
                p = moved[at]
                away = np.maximum(np.maximum(self.low[node] - p, p - self.high[node]), 0.0)
                near = (away**2).sum(axis=1) <= radii2[at]
                at, node = at[near], node[near]
            found.append((at, node - (1 << self.depth), np.tile(shift, (len(at), 1))))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def nearest(self, points: np.ndarray, digits: int, chunk: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """Rounded squared distance to the nearest of the tree's own points, and its id: the smallest of equally near ones."""
        d2, best = np.empty(len(points)), np.empty(len(points), np.int64)
        for i in range(0, len(points), chunk):
            own = points[i : i + chunk]
            at, leaf, _ = self.reached(own, self.bound(own) + 2 * 10.0**-digits, periodic=False)
            order = np.argsort(at, kind="stable")
            at, guards = at[order], self.of_leaf[leaf[order]]
            each = np.round(((self.points[guards] - own[at][:, None]) ** 2).sum(axis=2), digits)
            starts = np.searchsorted(at, np.arange(len(own)))
            least = np.minimum.reduceat(each.min(axis=1), starts)
            ids = np.where(each == least[at][:, None], self.ids[guards], np.iinfo(np.int64).max).min(axis=1)
            d2[i : i + chunk], best[i : i + chunk] = least, np.minimum.reduceat(ids, starts)
        return d2, best

    def guards_about(self, leaf: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Points, numbers and shifts of guards about a leaf's box, over the faces of the whole box too: the ``most`` nearest of
        all, and of ever thinner samples of them, so that a dense neighbour doesn't hide what lies on other sides."""
        low, high = self.low[(1 << self.depth) + leaf], self.high[(1 << self.depth) + leaf]
        mixed, found, step = np.random.default_rng(0).permutation(len(self.points)), [], 1
        while True:
            each = []
            for n, shift in enumerate(self.shifts):
                number = mixed[::step]
                p = self.points[number] + shift * self.box
                away = (np.maximum(np.maximum(low - p, p - high), 0.0) ** 2).sum(axis=1)
                pick = np.argpartition(away, most)[:most] if len(away) > most else np.arange(len(away))
                each.append((away[pick], number[pick], np.full(len(pick), n)))
            away, number, shift = (np.concatenate(c) for c in zip(*each, strict=True))
            keep = np.argsort(away, kind="stable")[:most]
            found.append(np.stack([number[keep], shift[keep]], axis=1))
            if len(mixed[::step]) * len(self.shifts) <= most:
                break
            step *= 8
        number, shift = np.unique(np.concatenate(found), axis=0).T
        return self.points[number] + self.shifts[shift] * self.box, number, self.shifts[shift]


def kd_tree(seeds: DataFrame, lengths: Sequence[float], block: int) -> KdTree:
    """A tree whose leaves hold about ``block`` seeds each, from a sample by the hash of seed_id. ValueError without seeds.

    Two passes over the seeds: a count, and the sample.
    """
    n = seeds.count()
    if not n:
        raise ValueError("there are no seeds")
    depth = min(max(0, math.ceil(math.log2(n / block))), int(math.log2(MOST_BLOCKS)))
    want = GUARDS << depth
    axes = list("xyz"[: len(lengths)])
    picked = seeds.select("seed_id", *axes)
    if n > 2 * want:
        share = F.pmod(F.xxhash64("seed_id", F.lit("guard")), F.lit(1 << 30)) < int((1 << 30) * want / n)
        picked = picked.where(share).limit(2 * want)
    held = picked.toPandas().sort_values("seed_id", kind="stable")
    if not len(held):
        held = seeds.select("seed_id", *axes).limit(2 * want).toPandas()
    return KdTree(held[axes].to_numpy(float), held["seed_id"].to_numpy(np.int64), lengths, depth)
