"""Strut lattices: eight unit cells, built from rules, and their rigidity count."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .grids import UNIT, Lengths, Shape
from .raster import binary_image, stamp_struts, struts_of

Point = tuple[float, float, float]

_CORNERS: list[Point] = [tuple(map(float, p)) for p in product((0, 1), repeat=3)]
_FACES: list[Point] = [tuple(v if a == axis else 0.5 for a in range(3)) for axis in range(3) for v in (0.0, 1.0)]
_CENTRE: Point = (0.5, 0.5, 0.5)
#: How far the re-entrant nodes of the auxetic cell lie inward of the side faces.
_INWARD = 0.35


def _distance2(a: Point, b: Point) -> float:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def _pairs(ones: list[Point], others: list[Point], d2: float) -> list[tuple[Point, Point]]:
    """All pairs between the two sets at a squared distance (within one set: each pair once)."""
    found = combinations(ones, 2) if ones is others else product(ones, others)
    return [(a, b) for a, b in found if abs(_distance2(a, b) - d2) < 1e-9]


def _cube() -> list[tuple[Point, Point]]:
    return _pairs(_CORNERS, _CORNERS, 1.0)


def _body() -> list[tuple[Point, Point]]:
    return _pairs(_CORNERS, [_CENTRE], 0.75)


def _face() -> list[tuple[Point, Point]]:
    return _pairs(_FACES, _CORNERS, 0.5)


def _upright() -> list[tuple[Point, Point]]:
    return [(a, b) for a, b in _cube() if a[:2] == b[:2]]


def _auxetic() -> list[tuple[Point, Point]]:
    found = []
    for axis, side in product((0, 1), (0.0, 1.0)):
        at = lambda v, z, axis=axis: (v, 0.5, z) if axis == 0 else (0.5, v, z)
        inner = at(side + _INWARD if side == 0 else side - _INWARD, 0.5)
        found += [(at(side, 0.0), (0.5, 0.5, 0.0)), (at(side, 0.0), inner), (at(side, 0.5), inner), (inner, at(side, 1.0)), (at(side, 1.0), (0.5, 0.5, 1.0))]
    return found


UNIT_CELLS = {
    "bcc": _body,
    "bccz": lambda: _body() + _upright(),
    "cubic": _cube,
    "fcc": _face,
    "fbcc": lambda: _face() + _body(),
    "isotruss": lambda: _cube() + _body() + _pairs([_CENTRE], _FACES, 0.25),
    "octet": lambda: _face() + _pairs(_FACES, _FACES, 0.5),
    "auxetic": _auxetic,
}


def unit_cell(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (v, x, y, z) and edges (e, a, b) of a unit cell; ``name`` may also be a callable returning point pairs."""
    pairs = (UNIT_CELLS[name] if isinstance(name, str) else name)()
    points = sorted({p for pair in pairs for p in pair})
    index = {p: v for v, p in enumerate(points)}
    vertices = spark.createDataFrame([(v, *p) for p, v in index.items()], "v int, x double, y double, z double")
    edges = spark.createDataFrame([(e, index[a], index[b]) for e, (a, b) in enumerate(pairs)], "e int, a int, b int")
    return vertices, edges


def lattice_image(spark: SparkSession, name: str, shape: Shape, lengths: Lengths = UNIT, radius: float = 0.05, strut_type: str = "circle") -> DataFrame:
    """(i, j, k, label) of a lattice whose struts have the given radius."""
    vertices, edges = unit_cell(spark, name)
    return binary_image(spark, shape, stamp_struts(struts_of(vertices, edges, lengths), shape, lengths, radius, strut_type))


def rigidity(struts: Column, joints: Column) -> Column:
    """Maxwell's count of a pin-jointed frame in space."""
    count = struts - 3 * joints + 6
    return F.when(count == 0, "statically determinate").when(count > 0, "over-constrained").otherwise("under-constrained")


def lattice_rigidity(spark: SparkSession) -> DataFrame:
    """lattice, joints, struts, maxwell, rigidity of all unit cells."""
    rows = []
    for name, make in sorted(UNIT_CELLS.items()):
        pairs = make()
        rows.append((name, len({p for pair in pairs for p in pair}), len(pairs)))
    counts = spark.createDataFrame(rows, "lattice string, joints int, struts int")
    return counts.select("*", (F.col("struts") - 3 * F.col("joints") + 6).alias("maxwell"), rigidity(F.col("struts"), F.col("joints")).alias("rigidity"))
