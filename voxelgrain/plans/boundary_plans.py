"""Queries over grain boundaries and tessellations of the table's own seeds, against nearest-seed geometry in SQL.

The SQL knows no faces: a point lies over a face when its foot on the bisecting plane is nearest to the two seeds of that
plane, and in the half polyhedron of the face that the ray from its seed meets first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import erosion, grids, raster, voronoi
from . import fixtures as fx
from .fixtures import query

_N, _T = fx.LABELS, 0.02
_SHAPE = (_N, _N, _N)


def _square(p: str, q: str) -> str:
    return "(" + " + ".join(f"({p}{c} - {q}{c}) * ({p}{c} - {q}{c})" for c in "xyz") + ")"


#: Seeds at their 27 places (gx, gy, gz), the place of a seed itself marked.
GHOSTS = (
    "gh AS MATERIALIZED (SELECT seed_id AS gid, x + sx AS gx, y + sy AS gy, z + sz AS gz, sx = 0 AND sy = 0 AND sz = 0 AS home "
    "FROM seeds, (SELECT unnest([-1, 0, 1]) AS sx), (SELECT unnest([-1, 0, 1]) AS sy), (SELECT unnest([-1, 0, 1]) AS sz))"
)


def _erosion_sql() -> str:
    frame = ", ".join(f"x{c} + {fx.wrap_sql(f'(({i} + 0.5::DOUBLE) / {_N} - x{c})')} AS v{c}" for i, c in zip("ijk", "xyz", strict=True))
    foot = ", ".join(f"v{c} + (g{c} - x{c}) * (({_square('v', 'g')} - {_square('v', 'x')}) / (2 * {_square('x', 'g')})) AS q{c}" for c in "xyz")
    along = " + ".join(f"(v{c} - x{c}) * (g{c} - x{c})" for c in "xyz")
    return f"""WITH {fx.labels_sql()}, {GHOSTS},
v AS MATERIALIZED (SELECT *, {frame} FROM (SELECT i, j, k, label, s.x AS xx, s.y AS xy, s.z AS xz FROM lab JOIN seeds s ON s.seed_id = label)),
c AS MATERIALIZED (SELECT v.*, {foot} FROM v JOIN gh ON NOT (home AND gid = label) AND {_square('v', 'g')} - {_square('v', 'x')} <= {_T}::DOUBLE * sqrt({_square('x', 'g')})),
f AS MATERIALIZED (SELECT row_number() OVER () AS n, * FROM c),
b AS (SELECT DISTINCT n FROM f JOIN gh ON {_square('q', 'g')} < {_square('q', 'x')} - 1e-10::DOUBLE),
d AS MATERIALIZED (SELECT DISTINCT i, j, k FROM f WHERE n NOT IN (SELECT n FROM b)),
r AS (SELECT i, j, k, min({{'s': {_square('x', 'g')} / ({along}), 'g': gid}}).g AS other FROM v JOIN d USING (i, j, k) JOIN gh ON NOT (home AND gid = label) AND {along} > 0 GROUP BY i, j, k)
SELECT v.i, v.j, v.k, v.label AS crystal, r.other IS NOT NULL AS eroded, r.other AS other FROM v LEFT JOIN r USING (i, j, k)"""


@query("gb_seed_erosion", _erosion_sql())
def _eroded(spark, sf_dir):
    """Every voxel with its crystal, whether it is eroded, and the crystal across the boundary that it is tagged with."""
    seeds = fx.seeds(spark, sf_dir)
    voxels = raster.label_nearest_seed(grids.voxel_grid(spark, _SHAPE), seeds, _SHAPE)
    image, table = erosion.erode_boundaries(voxels, voronoi.tessellate(seeds), seeds, _SHAPE, thickness=_T)
    found = image.join(table.select(F.col("gb_tag").alias("label"), "crystal_a", "crystal_b"), "label", "left")
    other = F.col("crystal_a") + F.col("crystal_b") - F.col("crystal")
    return found.select("i", "j", "k", F.col("crystal").cast("int").alias("crystal"), (F.col("label") != F.col("crystal")).alias("eroded"), other.cast("int").alias("other"))
