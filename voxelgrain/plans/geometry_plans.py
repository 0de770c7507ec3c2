"""Queries over single predicates and joins of geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql as names
from ..functions.periodic import canonical_sign, inside_cell, nearest_node, wrapped
from ..operators import erosion, lattices, raster, tpms, views
from . import fixtures as fx
from .fixtures import query


@query("inside_cell", "WITH p AS (SELECT vec_id, 4 * embedding[1]::DOUBLE AS x, 4 * embedding[2]::DOUBLE AS y, 4 * embedding[3]::DOUBLE AS z FROM embeddings) "
       "SELECT vec_id, x >= -1e-12 AND y >= -1e-12 AND z >= -1e-12 AND x < 1 + 1e-12 AND y < 1 + 1e-12 AND z < 1 + 1e-12 AS inside FROM p")  # fmt: skip
def _inside(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", inside_cell([4 * fx.component(c) for c in range(3)], (1.0, 1.0, 1.0)).alias("inside"))


@query("physical_to_voxel", f"WITH {fx.SEEDS} SELECT seed_id, " + ", ".join(f"CAST(least(greatest(floor({c} * 31 + 0.5::DOUBLE), 0), 31) AS INTEGER) AS {i}" for c, i in zip("xyz", "ijk", strict=True)) + " FROM seeds")
def _to_voxel(spark, sf_dir):
    return fx.seeds(spark, sf_dir).select("seed_id", *[nearest_node(F.col(c), 1.0, 32).alias(i) for c, i in zip("xyz", "ijk", strict=True)])


@query("plane_band", f"WITH {fx.SEEDS} SELECT seed_id, abs((x - 0.5::DOUBLE) * 0.6::DOUBLE + (y - 0.5::DOUBLE) * 0.8::DOUBLE + (z - 0.5::DOUBLE) * 0.0::DOUBLE) <= 0.1::DOUBLE AS near FROM seeds")
def _band(spark, sf_dir):
    point, plane, normal = [F.col(c) for c in "xyz"], [F.lit(0.5)] * 3, [F.lit(0.6), F.lit(0.8), F.lit(0.0)]
    return fx.seeds(spark, sf_dir).select("seed_id", erosion.plane_band(point, plane, normal, 0.2).alias("near"))


_SIDES = [((0.1, 0.1), (0.9, 0.2)), ((0.9, 0.2), (0.6, 0.9)), ((0.6, 0.9), (0.1, 0.1))]
_CROSS = [f"(({b[0]!r}::DOUBLE - {a[0]!r}::DOUBLE) * (y - {a[1]!r}::DOUBLE) - ({b[1]!r}::DOUBLE - {a[1]!r}::DOUBLE) * (x - {a[0]!r}::DOUBLE))" for a, b in _SIDES]


@query("point_in_polygon", f"WITH {fx.SEEDS} SELECT seed_id, ({' AND '.join(f'{c} >= 0' for c in _CROSS)}) OR ({' AND '.join(f'{c} <= 0' for c in _CROSS)}) AS inside FROM seeds")
def _polygon(spark, sf_dir):
    """Seeds over a triangle in the plane z = 0, seen along z."""
    verts = F.array(*[F.struct(F.lit(a[0]).alias("x"), F.lit(a[1]).alias("y"), F.lit(0.0).alias("z")) for a, _ in _SIDES])
    return fx.seeds(spark, sf_dir).select("seed_id", erosion.in_polygon([F.col(c) for c in "xyz"], verts, [F.lit(0.0), F.lit(0.0), F.lit(1.0)]).alias("inside"))


@query("periodic_difference", f"WITH {fx.SEEDS} SELECT seed_id, " + ", ".join(f"round({fx.wrap_sql(f'({c} - 0.9::DOUBLE)')}, 6) + 0.0::DOUBLE AS d{c}" for c in "xyz") + " FROM seeds")
def _difference(spark, sf_dir):
    return fx.rounded(fx.seeds(spark, sf_dir).select("seed_id", *[wrapped(F.col(c) - 0.9, 1.0).alias(f"d{c}") for c in "xyz"]))


@query("canonical_normals", "WITH n AS (SELECT vec_id, " + ", ".join(f"round(embedding[{c + 1}]::DOUBLE, 6) AS n{c}" for c in range(3)) + " FROM embeddings), s AS (SELECT *, CASE WHEN abs(n0) > 1e-8 THEN sign(n0) WHEN abs(n1) > 1e-8 THEN sign(n1) WHEN abs(n2) > 1e-8 THEN sign(n2) ELSE 1 END AS s FROM n) "
       "SELECT vec_id, " + ", ".join(f"n{c} * s + 0.0::DOUBLE AS n{c}" for c in range(3)) + " FROM s")  # fmt: skip
def _canonical(spark, sf_dir):
    n = [fx.sql_round(fx.component(c), 6) for c in range(3)]
    sign = canonical_sign(n)
    return fx.rounded(fx.table(spark, sf_dir, "embeddings").select("vec_id", *[(x * sign).alias(f"n{c}") for c, x in enumerate(n)]))


def _edges_sql(name: str) -> str:
    pairs = lattices.UNIT_CELLS[name]()
    rows = ", ".join(f"({e}, {', '.join(f'{v!r}::DOUBLE' for p in pair for v in p)})" for e, pair in enumerate(pairs))
    return f'SELECT e, c1 AS ax, c2 AS ay, c3 AS az, c4 AS bx, c5 AS "by", c6 AS bz FROM (VALUES {rows}) t(e, c1, c2, c3, c4, c5, c6)'


@query("edge_vertices", _edges_sql("auxetic"))
def _edges(spark, sf_dir):
    return views.lattice_lines(*lattices.unit_cell(spark, "auxetic"))


@query("distinct_labels", f"WITH {fx.labels_sql()} SELECT DISTINCT label FROM lab")
def _distinct(spark, sf_dir):
    return fx.labels(spark, sf_dir).select("label").distinct()


@query("middle_planes", f"WITH {fx.labels_sql()} SELECT 'x' AS axis, j AS u, k AS v, label AS value FROM lab WHERE i = 8 UNION ALL SELECT 'y', i, k, label FROM lab WHERE j = 8 UNION ALL SELECT 'z', i, j, label FROM lab WHERE k = 8")
def _planes(spark, sf_dir):
    n = fx.LABELS
    return views.middle_planes(fx.labels(spark, sf_dir), (n, n, n))


@query("sql_functions", f"WITH {fx.SEEDS} SELECT seed_id, round(sin(x) * cos(y) + sin(y) * cos(z) + sin(z) * cos(x), 6) + 0.0::DOUBLE AS g, round({fx.wrap_sql('(x - 0.9::DOUBLE)')}, 6) + 0.0::DOUBLE AS d FROM seeds")
def _sql(spark, sf_dir):
    """The registered SQL names, from a SQL text."""
    names.register(spark)
    fx.seeds(spark, sf_dir).createOrReplaceTempView("voxelgrain_seeds")
    return fx.rounded(spark.sql("SELECT seed_id, gyroid(x, y, z) AS g, min_image(x - 0.9D, 1.0D) AS d FROM voxelgrain_seeds"))


def _bisection_sql(steps: int = 30) -> str:
    from .field_plans import _field_sql

    share = "len(list_filter(d, lambda x: x < (low + high) / 2)) / len(d)::DOUBLE"
    return (
        f"WITH RECURSIVE {_field_sql('iwp')}, d AS (SELECT list(abs(f - 0.5::DOUBLE)) AS d FROM f), "
        "b AS (SELECT 0 AS n, 0.0::DOUBLE AS low, list_max(d) AS high, NULL::DOUBLE AS thickness, false AS done, d FROM d UNION ALL "
        "SELECT n + 1, CASE WHEN got < 0.3::DOUBLE THEN middle ELSE low END, CASE WHEN got < 0.3::DOUBLE THEN high ELSE middle END, middle, abs(got - 0.3::DOUBLE) < 1e-3::DOUBLE, d "
        f"FROM (SELECT *, (low + high) / 2 AS middle, {share} AS got FROM b WHERE NOT done AND n < {steps})) SELECT round(thickness, 9) AS thickness FROM b ORDER BY n DESC LIMIT 1"
    )


@query("tpms_shell_bisection", _bisection_sql())
def _bisection(spark, sf_dir):
    n = fx.FIELD
    t = tpms.shell_thickness_for_fraction(tpms.tpms_field(spark, "iwp", (n, n, n)), 0.5, 0.3)
    return spark.createDataFrame([(round(float(t), 9),)], "thickness double")


def _dedup_sql() -> str:
    ends = ["ax", "ay", "az", "bx", '"by"', "bz"]
    rows = [[v for p in pair for v in p] for one in lattices.UNIT_CELLS["octet"]() for pair in (one, one[::-1])]
    values = ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" for v in row) + ")" for row in rows)
    length = "(sqrt((bx - ax) * (bx - ax) + (\"by\" - ay) * (\"by\" - ay) + (bz - az) * (bz - az)) + 1e-15)"
    keys = [f"round((a{c} + {b}) * 0.5::DOUBLE, 6)" for c, b in zip("xyz", ends[3:], strict=True)] + [f"abs(round(({b} - a{c}) / {length}, 6))" for c, b in zip("xyz", ends[3:], strict=True)]
    one = ", ".join(f"'v{k}': {e}" for k, e in enumerate(ends))
    return f"WITH s AS (SELECT * FROM (VALUES {values}) t({', '.join(ends)})), m AS (SELECT min({{{one}}}) AS m FROM s GROUP BY {', '.join(keys)}) SELECT " + ", ".join(f"m.v{k} AS {e}" for k, e in enumerate(ends)) + " FROM m"


@query("edge_dedup", _dedup_sql())
def _dedup(spark, sf_dir):
    """Edges of a cube's cells given in both directions count once."""
    from ..operators.voronoi import distinct_edges

    struts = raster.struts_of(*lattices.unit_cell(spark, "octet")).select(*[f"{e}{c}" for e in "ab" for c in "xyz"])
    turned = struts.select(*[F.col(f"{o}{c}").alias(f"{e}{c}") for e, o in (("a", "b"), ("b", "a")) for c in "xyz"])
    return distinct_edges(struts.unionByName(turned))
