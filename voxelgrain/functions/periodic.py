"""Geometry in a periodic box, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrapped(difference: Column, length: float) -> Column:
    """A coordinate difference moved by one box length when it exceeds half of it."""
    half = length / 2
    return F.when(difference > half, difference - length).when(difference < -half, difference + length).otherwise(difference)


def wrapped_distance2(a: Sequence[Column], b: Sequence[Column], lengths: Sequence[float]) -> Column:
    """Squared distance of two points to the nearest periodic image."""
    total = None
    for one, two, length in zip(a, b, lengths, strict=True):
        d = wrapped(one - two, length)
        total = d * d if total is None else total + d * d
    return total


def inside_cell(point: Sequence[Column], lengths: Sequence[float], eps: float = 1e-12) -> Column:
    """Whether a point lies in the half-open box, up to ``eps``."""
    found = F.lit(True)
    for p, length in zip(point, lengths, strict=True):
        found = found & (p >= -eps) & (p < length + eps)
    return found


def nearest_node(position: Column, length: float, n: int) -> Column:
    """Index of the closest of ``n`` closed nodes (spacing length / (n - 1)), kept within range."""
    return F.least(F.greatest(F.floor(position / length * (n - 1) + 0.5), F.lit(0)), F.lit(n - 1)).cast("int")


def canonical_sign(normal: Sequence[Column], tol: float = 1e-8) -> Column:
    """+1 or -1 so that the first component that isn't near zero becomes positive."""
    sign = F.lit(1.0)
    for c in reversed(normal):
        sign = F.when(F.abs(c) > tol, F.signum(c)).otherwise(sign)
    return sign
