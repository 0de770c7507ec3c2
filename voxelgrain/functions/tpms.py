"""Level-set functions of triply periodic minimal surfaces, as column expressions of three angles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Angle3 = Callable[[Column, Column, Column], Column]


def _cyclic(term: Angle3) -> Angle3:
    """Sum of a term over the three cyclic orders of its arguments."""
    return lambda x, y, z: term(x, y, z) + term(y, z, x) + term(z, x, y)


gyroid = _cyclic(lambda x, y, z: F.sin(x) * F.cos(y))
schwarz_p = _cyclic(lambda x, y, z: F.cos(x))


def diamond(x: Column, y: Column, z: Column) -> Column:
    return F.sin(x) * F.sin(y) * F.sin(z) + F.sin(x) * F.cos(y) * F.cos(z) + F.cos(x) * F.sin(y) * F.cos(z) + F.cos(x) * F.cos(y) * F.sin(z)


def neovius(x: Column, y: Column, z: Column) -> Column:
    return 3 * schwarz_p(x, y, z) + 4 * F.cos(x) * F.cos(y) * F.cos(z)


def iwp(x: Column, y: Column, z: Column) -> Column:
    return 2 * _cyclic(lambda a, b, c: F.cos(a) * F.cos(b))(x, y, z) - _cyclic(lambda a, b, c: F.cos(2 * a))(x, y, z)


def lidinoid(x: Column, y: Column, z: Column) -> Column:
    first = _cyclic(lambda a, b, c: F.sin(2 * a) * F.cos(b) * F.sin(c))(x, y, z)
    second = _cyclic(lambda a, b, c: F.cos(2 * a) * F.cos(2 * b))(x, y, z)
    return 0.5 * first - 0.5 * second + 0.15


SURFACES: dict[str, Angle3] = {"gyroid": gyroid, "schwarz_p": schwarz_p, "diamond": diamond, "neovius": neovius, "iwp": iwp, "lidinoid": lidinoid}
