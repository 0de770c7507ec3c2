"""Vector code compression: product codebooks by Yinyang Lloyd rounds on integers.

Components become integers, vectors are cut into equal parts, and each part position has a codebook of its own. A round
assigns every part to its nearest entry and moves each entry to the floor of its parts' mean. Between rounds a row keeps,
for each part, its entry, an upper bound of the distance to it, and for each group of entries (entries that began near
each other) one lower bound of the distance to the group's other entries. After a move bounds drift by how far entries
went; only groups whose bound fails are scanned, and scans compare integer squared distances, so ties are exact. Bounds are
kept a little wider than computed: a group that could hold an equally near entry is always scanned.

A round is one pass over written rows without a shuffle; what reaches the driver is one number for each codebook component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import cut, drop_stage


@dataclass(frozen=True)
class CodeConfig:
    """``entries`` is at most 256 (two hexadecimal digits); ``groups`` bounds are kept for each part."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    groups: int = 4


#: Label sums up to this many are broadcast; more meet their rows by a shuffle.
BROADCAST_LABELS = 100_000
_WIDER, _NARROWER = 1 + 2.0**-20, 1 - 2.0**-20
_STATE = "vec_id long, label int, x binary, code binary, bounds binary, sums array<long>"
_CODES = "vec_id long, label int, code string, error long"


def entry_groups(entries: np.ndarray, groups: int) -> np.ndarray:
    """Group of each entry of each codebook (parts, k, width): nearest of some far-apart entries of its codebook."""
    found = np.zeros(entries.shape[:2], np.int64)
    for p, own in enumerate(entries.astype(float)):
        heads = [0]
        while len(heads) < min(groups, len(own)):
            away = np.min([((own - own[h]) ** 2).sum(axis=1) for h in heads], axis=0)
            heads.append(int(away.argmax()))
        found[p] = np.argmin([((own - own[h]) ** 2).sum(axis=1) for h in heads], axis=0)
    return found


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (n, k) of integer vectors: in floating point where every sum stays under 2^53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * 4 * most * most < 1 << 53:
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


class YinyangKernel:
    """One round's work on a block of rows; ``before`` are the entries that the rows' bounds hold for."""

    def __init__(self, entries: np.ndarray, group: np.ndarray, before: np.ndarray | None = None) -> None:
        self.entries, self.group, self.n_groups = entries, group, int(group.max(initial=0)) + 1
        self.members = [[np.flatnonzero(g == k) for k in range(self.n_groups)] for g in group]
        self.scanned = 0
        if before is not None:
            went = entries - before
            self.drift = np.sqrt((went.astype(float) ** 2).sum(axis=2)) * _WIDER
            self.group_drift = np.stack([[d[m].max(initial=0) for m in members] for d, members in zip(self.drift, self.members, strict=True)])

    def _bounds_of(self, p: int, distance: np.ndarray, code: np.ndarray, group: int) -> np.ndarray:
        """Least distance to a group's entries but the assigned one."""
        own = self.members[p][group]
        others = np.where(own[None] == code[:, None], np.inf, distance)
        return np.sqrt(others.min(axis=1, initial=np.inf)) * _NARROWER

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, parts) and bounds (n, parts, 1 + groups) of rows (n, parts, width) that have none yet."""
        n, parts = x.shape[:2]
        code, bounds = np.zeros((n, parts), np.uint8), np.zeros((n, parts, 1 + self.n_groups))
        for p in range(parts):
            d = squared_distances(x[:, p], self.entries[p])
            best = d.argmin(axis=1)
            code[:, p], bounds[:, p, 0] = best, np.sqrt(d[np.arange(n), best].astype(float)) * _WIDER
            for g, own in enumerate(self.members[p]):
                bounds[:, p, 1 + g] = self._bounds_of(p, d[:, own].astype(float), best, g)
        return code, bounds

    def again(self, x: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New codes and bounds: only parts whose bounds leave room are looked at, and of those only such groups."""
        code, bounds = code.copy(), bounds.astype(float)
        for p in range(x.shape[1]):
            own_code, b = code[:, p], bounds[:, p]
            b[:, 0] = (b[:, 0] + self.drift[p][own_code]) * _WIDER
            b[:, 1:] = np.maximum((b[:, 1:] - self.group_drift[p][None]) * _NARROWER, 0)
            open_rows = np.flatnonzero((b[:, 1:] <= b[:, :1]).any(axis=1))
            if not len(open_rows):
                continue
            away = ((x[open_rows, p] - self.entries[p][own_code[open_rows]]) ** 2).sum(axis=1)
            b[open_rows, 0] = np.sqrt(away.astype(float)) * _WIDER
            still = (b[open_rows, 1:] <= b[open_rows, :1]).any(axis=1)
            rows, away = open_rows[still], away[still]
            if not len(rows):
                continue
            was = own_code[rows].astype(np.int64)
            best, best_d = was.copy(), away.copy()
            due = b[rows, 1:] <= b[rows, :1]
            seen = {}
            for g, own in enumerate(self.members[p]):
                at = np.flatnonzero(due[:, g])
                if not len(at) or not len(own):
                    continue
                d = squared_distances(x[rows[at], p], self.entries[p][own])
                self.scanned += d.size
                near = d.argmin(axis=1)
                near_d, near_e = d[np.arange(len(at)), near], own[near]
                closer = (near_d < best_d[at]) | ((near_d == best_d[at]) & (near_e < best[at]))
                best[at[closer]], best_d[at[closer]] = near_e[closer], near_d[closer]
                seen[g] = at, d
            for g, (at, d) in seen.items():
                b[rows[at], 1 + g] = self._bounds_of(p, d.astype(float), best[at], g)
            # an entry left behind is now one of its group's others
            left = np.flatnonzero((best != was) & ~due[np.arange(len(rows)), self.group[p][was]])
            where = rows[left], 1 + self.group[p][was[left]]
            b[where] = np.minimum(b[where], np.sqrt(away[left].astype(float)) * _NARROWER)
            code[rows, p], b[rows, 0] = best, np.sqrt(best_d.astype(float)) * _WIDER
        return code, bounds

    def errors(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        return sum(((x[:, p] - self.entries[p][code[:, p]]) ** 2).sum(axis=1) for p in range(x.shape[1]))

    def add_sums(self, sums: np.ndarray, x: np.ndarray, code: np.ndarray) -> None:
        """Into ``sums`` (parts, k, width + 1): component sums, and counts last."""
        for p in range(x.shape[1]):
            np.add.at(sums[p, :, :-1], code[:, p], x[:, p])
            sums[p, :, -1] += np.bincount(code[:, p], minlength=sums.shape[1])


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _integers(column: pa.Array, scale: int, limit: int) -> np.ndarray:
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
    if np.abs(values).max(initial=0) > limit:
        raise ValueError(f"components must stay within {limit / scale:.6g}: errors would pass the range of a long")
    return values.astype(np.int64).reshape(len(column), -1)


def _round_pass(kernel: YinyangKernel, first: bool, parts: int, scale: int, limit: int, last: bool):
    """A pass over batches: (vec_id, label, embedding) at first, later (vec_id, label, x, code, bounds)."""
    k, width = kernel.entries.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, k, width + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            if first:
                x = _integers(batch.column(2), scale, limit).reshape(-1, parts, width)
                code, bounds = kernel.first(x)
            else:
                x = _unpacked(batch.column(2), "<i4").astype(np.int64).reshape(-1, parts, width)
                code, bounds = kernel.again(x, _unpacked(batch.column(3), np.uint8), _unpacked(batch.column(4), "<f4").reshape(len(x), parts, -1))
            if last:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([r.tobytes().hex() for r in code]), pa.array(kernel.errors(x, code))], ["vec_id", "label", "code", "error"])
                continue
            kernel.add_sums(sums, x, code)
            columns = [*batch.columns[:2], _packed(x.reshape(len(x), -1).astype("<i4")), _packed(code), _packed(bounds.reshape(len(x), -1).astype("<f4")), pa.nulls(len(x), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "x", "code", "bounds", "sums"])
        if not last and sums[:, :, -1].any():  # the task's own sums, on a row without a vector
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([sums.ravel()], pa.list_(pa.int64()))], ["vec_id", "label", "x", "code", "bounds", "sums"])

    return run


def _moved(state: DataFrame, entries: np.ndarray) -> np.ndarray:
    """Entries at the floor of their parts' means; unused ones stay. Sums are added by Spark, exactly at any size."""
    each = state.where("sums is not null").select(F.posexplode("sums").alias("at", "n"))
    totals = {r["at"]: int(r["total"]) for r in each.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("total")).collect()}
    parts, k, width = entries.shape
    flat = np.array([totals.get(i, 0) for i in range(parts * k * (width + 1))], object).reshape(parts, k, width + 1)
    out = entries.copy()
    for p in range(parts):
        for e in range(k):
            if n := flat[p, e, -1]:
                out[p, e] = [s // n for s in flat[p, e, :-1]]
    return out


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows whose vector is there and wholly finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding").where(F.col("embedding").isNotNull() & finite)


def fit_codes(vectors: DataFrame, config: CodeConfig = CodeConfig()) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of all kept vectors, written, and the final codebooks (parts, entries, width)."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors)
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    lead = kept.orderBy(*order).limit(1).collect()
    if not lead:
        return spark.createDataFrame([], _CODES), np.zeros((config.parts, 0, 0), np.int64)
    size = len(lead[0]["embedding"])
    if not size or size % config.parts:
        raise ValueError(f"vectors of {size} components can't be cut into {config.parts} equal parts")
    limit = min(isqrt(((1 << 63) - 1) // size) // 2, (1 << 31) - 1)
    fitting = kept.where(F.size("embedding") == size)
    seeds = pa.array([r["embedding"] for r in fitting.orderBy(*order).limit(config.entries).collect()])
    entries = _integers(seeds, config.scale, limit).reshape(len(seeds), config.parts, -1).transpose(1, 0, 2)
    group, before, state = entry_groups(entries, config.groups), None, fitting
    for turn in range(config.rounds):
        kernel = YinyangKernel(entries, group, before)
        rows = state if turn == 0 else state.where("x is not null").drop("sums")
        written = cut(rows.mapInArrow(_round_pass(kernel, turn == 0, config.parts, config.scale, limit, False), _STATE), f"codes-{turn}")
        if turn:
            drop_stage(state)
        before, entries, state = entries, _moved(written, entries), written
    rows = state if not config.rounds else state.where("x is not null").drop("sums")
    last = _round_pass(YinyangKernel(entries, group, before), not config.rounds, config.parts, config.scale, limit, True)
    coded = rows.mapInArrow(last, _CODES)
    other = kept.where(F.size("embedding") != size).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = cut(coded.unionByName(other), "codes")
    if config.rounds:
        drop_stage(state)
    return coded, entries


def codebooks_digest(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in entries.ravel().tolist()).encode()).hexdigest()


def compressed_vectors(vectors: DataFrame, config: CodeConfig = CodeConfig()) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector.

    Defined cases: rows whose vector is null or has a null or non-finite component are dropped; codebooks begin with the
    smallest ids (null ids last, rows of one id by their vectors), fewer than ``entries`` of them where there are fewer rows;
    repeated rows are coded each; null labels are one group; a vector not as long as that of the smallest id has null code
    and error; lengths that can't be cut and components whose errors pass a long raise ValueError; an empty table gives no
    rows; other columns are not read.
    """
    coded, entries = fit_codes(vectors, config)
    sums = cut(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors", slim=True)
    sums = sums.withColumnRenamed("label", "_label")
    side = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    joined = coded.join(side, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(entries)).alias("codebooks_sha256"))
