"""Load paths: equal-area directions, linear ramps to the limits, and their JSON."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tensors import parts


def linear_paths(directions: DataFrame, steps: int = 10, dev_max: float = 0.03, vol_max: float = 0.005, v: str = "v") -> DataFrame:
    """Rows of ``directions`` for step 1 .. ``steps`` with ``e``, the strain: the direction scaled so that the norm of its
    deviator or its trace meets the limit, times step / steps. A zero direction stays zero."""
    c = parts(F.col(v))
    trace = c[0] + c[1] + c[2]
    dev = [x - trace / 3.0 if i < 3 else x for i, x in enumerate(c)]
    norm = F.sqrt(sum((x * x for x in dev[1:]), dev[0] * dev[0]))
    # a part that is near zero sets no limit
    by_dev = F.when(norm > 1e-8, dev_max / norm)
    by_vol = F.when(F.abs(trace) > 1e-8, vol_max / F.abs(trace))
    scale = F.coalesce(F.least(by_dev, by_vol), F.lit(0.0))
    rest = [name for name in directions.columns if name != v]
    ramp = directions.select(*rest, v, scale.alias("_s"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return ramp.select(*rest, "step", F.transform(F.col(v), lambda x: x * F.col("_s") * F.col("step") / float(steps)).alias("e"))


def within_limits(e: Column, dev_max: float, vol_max: float, tol: float = 1e-12) -> Column:
    c = parts(e)
    trace = c[0] + c[1] + c[2]
    dev = [x - trace / 3.0 if i < 3 else x for i, x in enumerate(c)]
    return (F.abs(trace) <= vol_max + tol) & (F.sqrt(sum((x * x for x in dev[1:]), dev[0] * dev[0])) <= dev_max + tol)


def _sphere_area(dim: int) -> float:
    return 2.0 * math.pi ** ((dim + 1) / 2) / math.gamma((dim + 1) / 2)


def _cap_area(dim: int, colatitude: float) -> float:
    """Area of a cap of the sphere S^dim by Simpson's rule on sin^(dim - 1)."""
    n = 400
    h = colatitude / n
    f = lambda t: math.sin(t) ** (dim - 1)
    total = f(0.0) + f(colatitude) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, n))
    return _sphere_area(dim - 1) * total * h / 3 if dim > 1 else 2.0 * colatitude


def _cap_colatitude(dim: int, area: float) -> float:
    low, high = 0.0, math.pi
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _cap_area(dim, middle) < area else (low, middle)
    return (low + high) / 2


def equal_area_points(dim: int, n: int) -> list[list[float]]:
    """Centres of the recursive zonal partition of S^dim into ``n`` regions of equal area, as unit vectors.

    Two polar caps, and collars between them whose numbers of regions are the ideal ones rounded with carried remainders;
    each collar is divided like a sphere of one dimension less.
    """
    if dim == 1:
        return [[math.cos(2 * math.pi * (i + 0.5) / n), math.sin(2 * math.pi * (i + 0.5) / n)] for i in range(n)]
    pole = [0.0] * dim
    if n == 1:
        return [[*pole, 1.0]]
    if n == 2:
        return [[*pole, 1.0], [*pole, -1.0]]
    area = _sphere_area(dim) / n
    polar = _cap_colatitude(dim, area)
    collars = max(1, round((math.pi - 2 * polar) / area ** (1 / dim)))
    width = (math.pi - 2 * polar) / collars
    counts, carry = [], 0.0
    for c in range(collars):
        ideal = (_cap_area(dim, polar + (c + 1) * width) - _cap_area(dim, polar + c * width)) / area
        counts.append(round(ideal + carry))
        carry += ideal - counts[-1]
    points, taken, edge = [[*pole, 1.0]], 1, polar
    for count in counts:
        taken += count
        after = _cap_colatitude(dim, taken * area)
        middle = (edge + after) / 2
        points += [[*[math.sin(middle) * x for x in p], math.cos(middle)] for p in equal_area_points(dim - 1, count)]
        edge = after
    return [*points, [*pole, -1.0]]


def equal_area_directions(spark: SparkSession, n: int, dim: int = 6) -> DataFrame:
    """path_id, v: ``n`` equal-area unit directions in ``dim`` dimensions."""
    return spark.createDataFrame(list(enumerate(equal_area_points(dim - 1, n))), "path_id int, v array<double>")


def path_json(paths: DataFrame, zero_step: bool = False, digits: int = 16, general: bool = False, key: str = "path_id") -> DataFrame:
    """One JSON text per path, steps in order: full precision, or six significant digits (``general``)."""
    number = (lambda x: F.format_string("%.6g", x)) if general else (lambda x: F.round(x, digits).cast("string"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("step", "e"))), lambda s: F.concat(F.lit("["), F.array_join(F.transform(s["e"], number), ", "), F.lit("]")))
    lines = F.concat(F.array(F.lit("[" + ", ".join(["0"] * 6) + "]")), rows) if zero_step else rows
    return paths.groupBy(key).agg(F.concat(F.lit("["), F.array_join(lines, ", "), F.lit("]")).alias("json"))


def write_path_json(paths: DataFrame, filename: str, **options) -> str:
    """All paths in one JSON file, under ``macroscale_loading``; paths stream to the driver one after another."""
    texts = path_json(paths, **options).orderBy("path_id")
    with open(filename, "w", encoding="utf-8") as out:
        out.write('{\n  "macroscale_loading": [')
        for n, row in enumerate(texts.toLocalIterator()):
            out.write(("," if n else "") + "\n    " + row["json"])
        out.write("\n  ]\n}\n")
    return filename
