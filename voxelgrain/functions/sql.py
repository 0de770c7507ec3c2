"""SQL names for this engine's functions: scalars and grids are SQL functions that the optimiser inlines, seeds are UDTFs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_SURFACES = {
    "gyroid": "sin(x) * cos(y) + sin(y) * cos(z) + sin(z) * cos(x)",
    "schwarz_p": "cos(x) + cos(y) + cos(z)",
    "diamond": "sin(x) * sin(y) * sin(z) + sin(x) * cos(y) * cos(z) + cos(x) * sin(y) * cos(z) + cos(x) * cos(y) * sin(z)",
    "neovius": "3 * (cos(x) + cos(y) + cos(z)) + 4 * cos(x) * cos(y) * cos(z)",
    "lidinoid": "0.5D * (sin(2 * x) * cos(y) * sin(z) + sin(2 * y) * cos(z) * sin(x) + sin(2 * z) * cos(x) * sin(y)) - 0.5D * (cos(2 * x) * cos(2 * y) + cos(2 * y) * cos(2 * z) + cos(2 * z) * cos(2 * x)) + 0.15D",
    "iwp": "2 * (cos(x) * cos(y) + cos(y) * cos(z) + cos(z) * cos(x)) - (cos(2 * x) + cos(2 * y) + cos(2 * z))",
}
_TENSORS = {
    "hydrostatic": "(t[0] + t[1] + t[2]) / 3",
    "von_mises": "sqrt(0.5D * ((t[0] - t[1]) * (t[0] - t[1]) + (t[1] - t[2]) * (t[1] - t[2]) + (t[2] - t[0]) * (t[2] - t[0]) + 6 * (t[3] * t[3] + t[4] * t[4] + t[5] * t[5])))",
}


#: Grids as SQL functions: slabs of the first index are dealt out to this many tasks.
_SLABS = 64
_GRID = (
    f"FROM (SELECT /*+ REPARTITION({_SLABS}, i) */ i FROM (SELECT explode(sequence(0, nx - 1)) AS i)) "
    "LATERAL VIEW explode(sequence(0, ny - 1)) AS j LATERAL VIEW explode(sequence(0, nz - 1)) AS k"
)


@udtf(returnType="seed_id int, x double, y double, z double")
class VoronoiSeeds:
    """``voronoi_seeds(n, method)``: points of the unit box by a method without random numbers; Sobol points unshifted."""

    def eval(self, n: int, method: str) -> Iterator[tuple[int, float, float, float]]:
        from voxelgrain.operators.seeds import SOBOL_BITS, factorise, sobol_directions

        nx, ny, nz = factorise(n, 3)

        def lattice(at: int) -> tuple[float, ...]:
            i, j, k = at // (ny * nz), at // nz % ny, at % nz
            odd = (j % 2, k % 2) if method == "honeycomb" else (0, 0)
            return (i + sum(odd) / 2) / nx % 1.0, (j + odd[1] / 2) / ny % 1.0, k / nz

        def halton(at: int) -> tuple[float, ...]:
            found = []
            for base in (2, 3, 5):
                value, weight, rest = 0.0, 1.0 / base, at
                while rest:
                    value, weight, rest = value + rest % base * weight, weight / base, rest // base
                found.append(value)
            return tuple(found)

        def sobol(at: int) -> tuple[float, ...]:
            gray, found = at ^ at >> 1, []
            for axis in "xyz":
                value = 0
                for bit, v in enumerate(sobol_directions(axis)):
                    value ^= v if gray >> bit & 1 else 0
                found.append(value / (1 << SOBOL_BITS))
            return tuple(found)

        make = {"rubiks-cube": lattice, "honeycomb": lattice, "halton": halton, "sobol": sobol, "diamond": lambda at: (at * 0.5,) * 3}
        if method not in make:
            raise ValueError(f"no SQL seeds by {method!r}; one of {sorted(make)}")
        for at in range(2 if method == "diamond" else n):
            yield at, *make[method](at)


@udtf(returnType="seed_id int, x double, y double, z double")
class LatticeSeeds:
    """``lattice_seeds(n)``: the balanced grid of ``n`` points in the unit box."""

    def eval(self, n: int) -> Iterator[tuple[int, float, float, float]]:
        from voxelgrain.operators.seeds import factorise

        nx, ny, nz = factorise(n, 3)
        for at in range(n):
            yield at, at // (ny * nz) / nx, at // nz % ny / ny, at % nz / nz


def register(spark: SparkSession) -> list[str]:
    """Register all names for the session and return them."""
    for name, body in _SURFACES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x DOUBLE, y DOUBLE, z DOUBLE) RETURNS DOUBLE RETURN {body}")
    for name, body in _TENSORS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION min_image(d DOUBLE, l DOUBLE) RETURNS DOUBLE RETURN CASE WHEN d > l / 2 THEN d - l WHEN d < -l / 2 THEN d + l ELSE d END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION voxel_grid(nx INT, ny INT, nz INT) RETURNS TABLE (i INT, j INT, k INT) RETURN SELECT i, j, k {_GRID}")
    angles = ", ".join(f"2 * pi() * {i} / {n}" for i, n in zip("ijk", ("nx", "ny", "nz"), strict=True))
    cases = " ".join(f"WHEN '{name}' THEN {name}({angles})" for name in _SURFACES)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tpms_grid(surface STRING, nx INT, ny INT, nz INT) RETURNS TABLE (i INT, j INT, k INT, f DOUBLE) RETURN SELECT i, j, k, CASE surface {cases} END AS f {_GRID}")
    spark.udtf.register("lattice_seeds", LatticeSeeds)
    spark.udtf.register("voronoi_seeds", VoronoiSeeds)
    return [*_SURFACES, *_TENSORS, "min_image", "voxel_grid", "tpms_grid", "lattice_seeds", "voronoi_seeds"]
