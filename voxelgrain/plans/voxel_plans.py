"""Queries over label images and tessellations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.periodic import wrapped_distance2
from ..operators import combo, erosion, grids, raster, seeds as sd, spectral, stencils, voronoi
from ..operators.fractions import boundary_fraction, histogram, resize_error
from . import fixtures as fx
from .fixtures import LABELS, query

_SHAPE = (LABELS, LABELS, LABELS)
_BLOCKS = (4, 4, 4)
_B = LABELS // 4


@query("nearest_seed_label", f"WITH {fx.labels_sql()} SELECT i, j, k, label FROM lab")
def _labels(spark, sf_dir):
    return fx.labels(spark, sf_dir)


@query("nearest_seed_cells", f"WITH {fx.labels_sql()} SELECT i, j, k, label FROM lab")
def _cells(spark, sf_dir):
    """The same labels by joins on cells, the way beyond what is broadcast."""
    return raster.nearest_by_blocks(grids.voxel_grid(spark, _SHAPE), fx.seeds(spark, sf_dir), _SHAPE)


_D = [fx.wrap_sql(f"(a.{c} - b.{c})") for c in "xyz"]


@query("periodic_distance", f"WITH {fx.SEEDS} SELECT a.seed_id AS a, b.seed_id AS b, round({' + '.join(f'{d} * {d}' for d in _D)}, 6) AS d2 FROM seeds a, seeds b")
def _distance(spark, sf_dir):
    """All pairs: the operator is the distance matrix."""
    s = fx.seeds(spark, sf_dir)
    a, b = (s.select(F.col("seed_id").alias(n), *[F.col(c).alias(f"{n}{c}") for c in "xyz"]) for n in "ab")
    d2 = wrapped_distance2([F.col(f"a{c}") for c in "xyz"], [F.col(f"b{c}") for c in "xyz"], (1.0, 1.0, 1.0))
    return sd.all_pairs(a, b).select("a", "b", d2.alias("d2")).select("a", "b", fx.sql_round_positive("d2", 6).alias("d2"))


@query(
    "ghost_seeds",
    f"WITH {fx.SEEDS}, o AS (SELECT CAST(v - 1 AS INTEGER) AS v FROM range(3) t(v)) SELECT seed_id, a.v AS ox, b.v AS oy, c.v AS oz, round(x + a.v, 6) + 0.0::DOUBLE AS x, round(y + b.v, 6) + 0.0::DOUBLE AS y, round(z + c.v, 6) + 0.0::DOUBLE AS z FROM seeds, o a, o b, o c",
)
def _ghosts(spark, sf_dir):
    return fx.rounded(sd.ghost_seeds(fx.seeds(spark, sf_dir)))


_PHASES = f"{fx.labels_sql()}, ph AS (SELECT i // {_B} AS bi, j // {_B} AS bj, k // {_B} AS bk, label, count(*) / {_B**3}::DOUBLE AS fraction FROM lab GROUP BY ALL)"


@query(
    "combo_blocks",
    f"WITH {_PHASES}, c AS (SELECT bi, bj, bk, count(*) AS n, min(label) AS one FROM ph GROUP BY bi, bj, bk) SELECT CAST(ph.bi AS INTEGER) AS bi, CAST(ph.bj AS INTEGER) AS bj, CAST(ph.bk AS INTEGER) AS bk, "
    "CAST((ph.bi * 4 + ph.bj) * 4 + ph.bk AS BIGINT) AS elem, CAST(CASE WHEN n = 1 THEN one ELSE -n END AS INTEGER) AS coarse, label AS material, fraction FROM ph JOIN c ON ph.bi = c.bi AND ph.bj = c.bj AND ph.bk = c.bk",
)
def _blocks(spark, sf_dir):
    out = combo.composite_voxels(fx.labels(spark, sf_dir), _SHAPE, _BLOCKS)
    return out.select("bi", "bj", "bk", "elem", "coarse", F.explode("phases").alias("p")).select("bi", "bj", "bk", "elem", "coarse", "p.material", "p.fraction")


@query("combo_min_fraction", f"WITH {_PHASES} SELECT CAST(bi AS INTEGER) AS bi, CAST(bj AS INTEGER) AS bj, CAST(bk AS INTEGER) AS bk, label, fraction FROM ph WHERE fraction >= 0.1::DOUBLE")
def _min_fraction(spark, sf_dir):
    return combo.block_phases(fx.labels(spark, sf_dir), _SHAPE, _BLOCKS, 0.1).select("bi", "bj", "bk", "label", "fraction")


@query("combo_fractions", f"WITH {_PHASES} SELECT label, round(sum(fraction) / 64, 9) AS fraction FROM ph GROUP BY label")
def _combo_fractions(spark, sf_dir):
    return combo.composite_fractions(combo.composite_voxels(fx.labels(spark, sf_dir), _SHAPE, _BLOCKS))


_TWO = (8, 8, 8)


def _binary(spark, sf_dir):
    """Two phases: the parity of the nearest seed's id."""
    return fx.labels(spark, sf_dir).withColumn("label", F.col("label") % 2)


_PURE = f"{fx.labels_sql()}, par AS (SELECT i // 2 AS bi, j // 2 AS bj, k // 2 AS bk, label % 2 AS label FROM lab), ph AS (SELECT bi, bj, bk, label, count(*) / 8.0::DOUBLE AS fraction FROM par GROUP BY ALL)"


@query(
    "combo_pure_fractions",
    f"WITH {_PURE}, n AS (SELECT bi, bj, bk, count(*) AS n FROM ph GROUP BY ALL) SELECT label, round(sum(fraction) / 512, 9) AS fraction FROM ph JOIN n USING (bi, bj, bk) GROUP BY label HAVING min(n.n) = 1",
)
def _pure(spark, sf_dir):
    return combo.composite_fractions(combo.composite_voxels(_binary(spark, sf_dir), _SHAPE, _TWO), pure_only=True)


_NEAR = " UNION ALL ".join(
    f"SELECT (i + {a} + {LABELS}) % {LABELS} AS i, (j + {b} + {LABELS}) % {LABELS} AS j, (k + {c} + {LABELS}) % {LABELS} AS k, label * {w}::DOUBLE AS v FROM lab"
    for a, b, c, w in [(0, 0, 0, 6.0), (1, 0, 0, -1.0), (-1, 0, 0, -1.0), (0, 1, 0, -1.0), (0, -1, 0, -1.0), (0, 0, 1, -1.0), (0, 0, -1, -1.0)]
)


@query("combo_laplacian", f"WITH {fx.labels_sql()}, n AS ({_NEAR}) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, round(abs(sum(v)), 6) + 0.0::DOUBLE AS lap FROM n GROUP BY i, j, k")
def _laplacian(spark, sf_dir):
    return fx.rounded(stencils.laplacian(fx.labels(spark, sf_dir), _SHAPE))


def _moments_sql() -> str:
    """The Laplacian of the whole image, cut into blocks."""
    size, h = _B, 1.0 / LABELS
    sums = ", ".join(f"sum(w * {a} * {b}) AS s{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
    out = ", ".join(f"round(s{a}{b} / w - (s{a} / w) * (s{b} / w), 6) + 0.0::DOUBLE AS m{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
    means = ", ".join(f"round(s{c} / w, 6) + 0.0::DOUBLE AS c{c}" for c in "xyz")
    return f"""WITH {fx.labels_sql()}, par AS (SELECT i, j, k, label % 2 AS label FROM lab), near AS ({_NEAR.replace('FROM lab', 'FROM par')}),
lap AS (SELECT i, j, k, abs(sum(v)) AS w FROM near GROUP BY i, j, k),
two AS (SELECT i // {size} AS bi, j // {size} AS bj, k // {size} AS bk FROM par GROUP BY ALL HAVING count(DISTINCT label) = 2),
wt AS (SELECT i // {size} AS bi, j // {size} AS bj, k // {size} AS bk, (i % {size}) * {h}::DOUBLE AS x, (j % {size}) * {h}::DOUBLE AS y, (k % {size}) * {h}::DOUBLE AS z, w FROM lap WHERE w > 1e-5),
su AS (SELECT bi, bj, bk, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * z) AS sz, {sums}, sum(w) AS w FROM wt JOIN two USING (bi, bj, bk) GROUP BY bi, bj, bk)
SELECT CAST(bi AS INTEGER) AS bi, CAST(bj AS INTEGER) AS bj, CAST(bk AS INTEGER) AS bk, round(w, 6) AS w, {means}, {out} FROM su"""


@query("combo_moments", _moments_sql())
def _moments(spark, sf_dir):
    return fx.rounded(combo.block_moments(_binary(spark, sf_dir), _SHAPE, _BLOCKS))


@query("combo_normals")
def _normals(spark, sf_dir):
    return fx.rounded(combo.interface_normals(_binary(spark, sf_dir), _SHAPE, _BLOCKS))


def _same_sql(pad: int) -> str:
    n, size = LABELS, _B
    block = lambda c: f"(({c} + o{c}.o + {n}) % {n}) // {size}"
    return f"""WITH {fx.labels_sql()}, o AS (SELECT v - {pad} AS o FROM range({2 * pad + 1}) t(v)),
own AS (SELECT i // {size} AS bi, j // {size} AS bj, k // {size} AS bk, list_sort(list(DISTINCT label)) AS a FROM lab GROUP BY ALL),
pd AS (SELECT {block('i')} AS bi, {block('j')} AS bj, {block('k')} AS bk, list_sort(list(DISTINCT label)) AS b FROM lab, o oi, o oj, o ok GROUP BY ALL)
SELECT CAST(bi AS INTEGER) AS bi, CAST(bj AS INTEGER) AS bj, CAST(bk AS INTEGER) AS bk, a = b AS same FROM own JOIN pd USING (bi, bj, bk)"""


@query("combo_same_materials", _same_sql(1))
def _same(spark, sf_dir):
    return combo.same_materials(fx.labels(spark, sf_dir), _SHAPE, _BLOCKS, 1)


_UP = 24


@query(
    "resize_nearest",
    f"WITH {fx.labels_sql()}, t AS (SELECT CAST(id // {_UP * _UP} AS INTEGER) AS i, CAST((id // {_UP}) % {_UP} AS INTEGER) AS j, CAST(id % {_UP} AS INTEGER) AS k FROM range({_UP**3}) r(id)) SELECT t.i, t.j, t.k, lab.label FROM t JOIN lab ON "
    + " AND ".join(f"lab.{c} = CAST(floor((t.{c} + 0.5::DOUBLE) * {LABELS} / {_UP}) AS INTEGER)" for c in "ijk"),
)
def _resize(spark, sf_dir):
    return grids.resize_nearest(fx.labels(spark, sf_dir), _SHAPE, (_UP, _UP, _UP))


@query("resize_error", f"WITH {fx.labels_sql()}, t AS (SELECT CAST(id // {_UP * _UP} AS INTEGER) AS i, CAST((id // {_UP}) % {_UP} AS INTEGER) AS j, CAST(id % {_UP} AS INTEGER) AS k FROM range({_UP**3}) r(id)), "
       f"a AS (SELECT label % 2 AS label, round(count(*) / {LABELS**3}::DOUBLE, 9) AS f FROM lab GROUP BY 1), b AS (SELECT label % 2 AS label, round(count(*) / {_UP**3}::DOUBLE, 9) AS f FROM t JOIN lab ON "
       + " AND ".join(f"lab.{c} = CAST(floor((t.{c} + 0.5::DOUBLE) * {LABELS} / {_UP}) AS INTEGER)" for c in "ijk")
       + " GROUP BY 1) SELECT a.label, round((a.f - coalesce(b.f, 0)) * 100.0::DOUBLE / a.f, 6) AS error FROM a LEFT JOIN b ON a.label = b.label")
def _resize_error(spark, sf_dir):
    before = _binary(spark, sf_dir)
    return resize_error(before, grids.resize_nearest(before, _SHAPE, (_UP, _UP, _UP)))


_RADIUS = 2
_OFFS = stencils.octahedron_offsets(_RADIUS)
_OFFSQL = "o AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, {c})" for a, b, c in _OFFS) + ") v(a, b, c))"


@query(
    "median_filter",
    f"WITH {fx.labels_sql()}, {_OFFSQL}, n AS (SELECT (i - a + {LABELS}) % {LABELS} AS i, (j - b + {LABELS}) % {LABELS} AS j, (k - c + {LABELS}) % {LABELS} AS k, label FROM lab, o) "
    f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, list_sort(list(label))[{len(_OFFS) // 2 + 1}] AS label FROM n GROUP BY i, j, k",
)
def _median(spark, sf_dir):
    return stencils.median_filter(fx.labels(spark, sf_dir), _SHAPE, _OFFS)


_CUBE = stencils.box_offsets(3)
_CUBESQL = "o AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, {c})" for a, b, c in _CUBE) + ") v(a, b, c))"


@query(
    "periodic_erosion",
    f"WITH {fx.labels_sql()}, {_CUBESQL}, n AS (SELECT (i - a + {LABELS}) % {LABELS} AS i, (j - b + {LABELS}) % {LABELS} AS j, (k - c + {LABELS}) % {LABELS} AS k, label % 8 <> 0 AS m FROM lab, o) "
    "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, bool_and(m) AS mask FROM n GROUP BY i, j, k",
)
def _erosion(spark, sf_dir):
    masked = fx.labels(spark, sf_dir).select("i", "j", "k", (F.col("label") % 8 != 0).alias("mask"))
    return stencils.periodic_erosion(masked, _SHAPE, 3)


def _auto_sql() -> str:
    axes = []
    for axis, index in zip("xyz", "ijk", strict=True):
        others = [c for c in "ijk" if c != index]
        axes.append(
            f"SELECT '{axis}' AS axis, CAST(r AS INTEGER) AS lag, avg(a.v * b.v) AS p FROM par a, range({LABELS // 2}) t(r), par b WHERE "
            + " AND ".join(f"a.{c} = b.{c}" for c in others)
            + f" AND b.{index} = (a.{index} + r) % {LABELS} GROUP BY r"
        )
    return f"WITH {fx.labels_sql()}, par AS (SELECT i, j, k, (label % 2)::DOUBLE AS v FROM lab), m AS (SELECT avg(v) AS c1, avg(v * v) AS c2 FROM par), p AS ({' UNION ALL '.join(axes)}) SELECT axis, lag, round((p - c1 * c1) / (c2 - c1 * c1), 6) + 0.0::DOUBLE AS r FROM p, m"


@query("axis_autocorrelation", _auto_sql())
def _auto(spark, sf_dir):
    return fx.rounded(spectral.axis_autocorrelation(_binary(spark, sf_dir), _SHAPE))


_AUTO3 = (
    f"WITH {fx.labels_sql()}, par AS (SELECT i, j, k FROM lab WHERE label % 2 = 1), m AS (SELECT count(*) / {LABELS**3}::DOUBLE AS c FROM par), {fx.grid_sql(LABELS).replace('g AS', 'h AS')}, "
    f"p AS (SELECT (b.i - a.i + {LABELS}) % {LABELS} AS i, (b.j - a.j + {LABELS}) % {LABELS} AS j, (b.k - a.k + {LABELS}) % {LABELS} AS k, count(*) / {LABELS**3}::DOUBLE AS p FROM par a, par b GROUP BY ALL) "
    "SELECT h.i, h.j, h.k, round((coalesce(p, 0) - c * c) / (c - c * c), 6) + 0.0::DOUBLE AS r FROM h CROSS JOIN m LEFT JOIN p ON p.i = h.i AND p.j = h.j AND p.k = h.k"
)


@query("autocorrelation_3d", _AUTO3)
def _auto3(spark, sf_dir):
    return fx.rounded(spectral.autocorrelation3(_binary(spark, sf_dir), _SHAPE))


@query("correlation_length")
def _lengths(spark, sf_dir):
    return fx.rounded(spectral.correlation_lengths(_binary(spark, sf_dir), _SHAPE))


def _triangles(spark, sf_dir):
    """Triangles of three component triples of each embedding, with their normals."""
    e = fx.table(spark, sf_dir, "embeddings")
    p = [[fx.sql_round(fx.component(3 * v + c), 6) for c in range(3)] for v in range(3)]
    u = [p[1][c] - p[0][c] for c in range(3)]
    w = [p[2][c] - p[0][c] for c in range(3)]
    n = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    verts = F.array(*[F.struct(*[p[v][c].alias(x) for c, x in enumerate("xyz")]) for v in range(3)])
    return e.select("vec_id", verts.alias("verts"), *[n[c].alias(f"n{x}") for c, x in enumerate("xyz")])


_TRI = (
    "p AS (SELECT vec_id, " + ", ".join(f"round(embedding[{3 * v + c + 1}]::DOUBLE, 6) AS {x}{v}" for v in range(3) for c, x in enumerate("xyz")) + " FROM embeddings), "
    "t AS (SELECT vec_id, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz FROM p)"
)


@query("polygon_area", f"WITH {_TRI} SELECT vec_id, round(0.5::DOUBLE * sqrt(nx * nx + ny * ny + nz * nz), 6) AS area FROM t")
def _area(spark, sf_dir):
    t = _triangles(spark, sf_dir)
    return fx.rounded(t.select("vec_id", voronoi.polygon_area_column(F.col("verts"), [F.col("nx"), F.col("ny"), F.col("nz")]).alias("area")))


_UNIT = f"{_TRI}, u AS (SELECT vec_id, nx / l AS n0, ny / l AS n1, nz / l AS n2, 0.5::DOUBLE * l AS area FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM t))"


def _tensor_sql(order: int) -> str:
    names = "abcd"[:order]
    axes = ", ".join(f"(SELECT CAST(v AS INTEGER) AS {n} FROM range(3) r(v)) _{n}" for n in names)
    pick = " * ".join(f"(CASE {n} WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END)" for n in names)
    return f"WITH {_UNIT} SELECT {', '.join(names)}, round(sum(area * {pick}), 6) + 0.0::DOUBLE AS value FROM u, {axes} GROUP BY {', '.join(names)}"


def _structure(order: int):
    def run(spark, sf_dir):
        t = _triangles(spark, sf_dir)
        length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
        unit = t.select(*[(F.col(f"n{c}") / length).alias(f"n{c}") for c in "xyz"], (0.5 * length).alias("area"))
        return fx.rounded(voronoi.structure_tensor(unit, order=order))

    return run


query("structure_tensor", _tensor_sql(2))(_structure(2))
query("structure_tensor4", _tensor_sql(4))(_structure(4))

_SIGN = "(CASE WHEN abs(n0) > 1e-8 THEN sign(n0) WHEN abs(n1) > 1e-8 THEN sign(n1) WHEN abs(n2) > 1e-8 THEN sign(n2) ELSE 1 END)"


@query(
    "ridge_dedup",
    f"WITH {_UNIT}, k AS (SELECT vec_id, vec_id % 7 AS lo, vec_id % 7 + 1 AS hi, " + ", ".join(f"round(n{c} * {_SIGN}, 0) + 0.0::DOUBLE AS m{c}" for c in range(3)) + " FROM u) "
    "SELECT vec_id, CAST(dense_rank() OVER (ORDER BY lo, hi, m0, m1, m2) - 1 AS INTEGER) AS gb FROM k",
)
def _ridges(spark, sf_dir):
    """Triangles as faces of a few crystals, normals rounded to whole numbers, so that many are one boundary."""
    t = _triangles(spark, sf_dir)
    length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    unit = t.select("vec_id", (F.col("vec_id") % 7).alias("seed_a"), (F.col("vec_id") % 7 + 1).alias("seed_b"), *[(F.col(f"n{c}") / length).alias(f"n{c}") for c in "xyz"])
    return erosion.canonical_faces(unit, 0).select("vec_id", "gb")


@query("voronoi_volumes")
def _volumes(spark, sf_dir):
    return fx.rounded(voronoi.cell_volumes(voronoi.tessellate(fx.seeds(spark, sf_dir))), 9)


@query("voronoi_neighbors")
def _neighbours(spark, sf_dir):
    return voronoi.neighbours(voronoi.tessellate(fx.seeds(spark, sf_dir)))


@query("voronoi_interface")
def _interface(spark, sf_dir):
    return fx.rounded(voronoi.interface_measures(voronoi.tessellate(fx.seeds(spark, sf_dir))))


_BRICKS = (5, 4, 3)
_CELLS = "c AS (SELECT id, id // 12 AS a, (id // 3) % 4 AS b, id % 3 AS c FROM range(60) t(id))"


def _bricks(spark):
    return voronoi.tessellate(sd.voronoi_seeds(spark, 60, (1.0, 1.0, 1.0), "rubiks-cube"))


@query("voronoi_lattice_volumes", f"WITH {_CELLS} SELECT id AS seed_id, round(1.0::DOUBLE / 60, 9) AS volume FROM c")
def _lattice_volumes(spark, sf_dir):
    """Cells of a 5 x 4 x 3 lattice are bricks."""
    return fx.rounded(voronoi.cell_volumes(_bricks(spark)), 9)


@query(
    "voronoi_lattice_neighbors",
    f"WITH {_CELLS}, s AS (SELECT * FROM (VALUES (1, 0, 0), (4, 0, 0), (0, 1, 0), (0, 3, 0), (0, 0, 1), (0, 0, 2)) v(x, y, z)) "
    "SELECT c.id AS seed_id, ((c.a + x) % 5) * 12 + ((c.b + y) % 4) * 3 + (c.c + z) % 3 AS neighbour FROM c, s",
)
def _lattice_neighbours(spark, sf_dir):
    return voronoi.neighbours(_bricks(spark)).select("seed_id", F.explode("neighbours").alias("neighbour"))


@query("voronoi_lattice_interface", "SELECT 'unique' AS count, 12.0::DOUBLE AS interface_area UNION ALL SELECT 'reference', 15.0::DOUBLE")
def _lattice_interface(spark, sf_dir):
    """Five, four and three planes of area 1; one of each lies on the boundary and counts at both its places there."""
    faces = _bricks(spark)
    one, two = (voronoi.interface_measures(faces, c).select(F.lit(c).alias("count"), "interface_area") for c in ("unique", "reference"))
    return fx.rounded(one.unionByName(two))


@query("voronoi_lattice_tensor", "SELECT CAST(v AS INTEGER) AS a, CAST(w AS INTEGER) AS b, CASE WHEN v <> w THEN 0.0::DOUBLE ELSE 5.0::DOUBLE - v END AS value FROM range(3) x(v), range(3) y(w)")
def _lattice_tensor(spark, sf_dir):
    return fx.rounded(voronoi.structure_tensor(voronoi.unique_faces(_bricks(spark))))


@query("voronoi_vertices", "SELECT CAST(id AS INTEGER) AS vertex, round((id // 12 + 0.5::DOUBLE) / 5, 6) AS x, round(((id // 3) % 4 + 0.5::DOUBLE) / 4, 6) AS y, round((id % 3 + 0.5::DOUBLE) / 3, 6) AS z FROM range(60) t(id)")
def _vertices(spark, sf_dir):
    """Vertices of the bricks that lie in the box, numbered in order."""
    faces = _bricks(spark)
    inside = F.filter("verts", lambda p: (p["x"] > 0) & (p["x"] < 1) & (p["y"] > 0) & (p["y"] < 1) & (p["z"] > 0) & (p["z"] < 1))
    return fx.rounded(voronoi.vertex_table(faces.withColumn("verts", inside)))


@query("voronoi_volume_histogram")
def _volume_histogram(spark, sf_dir):
    """Volumes of 1,000 cells of each of six samplers, in 128 bins each."""
    out = None
    for method in ("random", "lhs-lloyd", "halton", "sobol", "honeycomb", "rubiks-cube"):
        v = voronoi.cell_volumes(voronoi.tessellate(sd.voronoi_seeds(spark, 1000, (1.0, 1.0, 1.0), method, 42)))
        own = histogram(v, "volume", 128, 0.0, 0.005).withColumn("method", F.lit(method))
        out = own if out is None else out.unionByName(own)
    return out


_FEW = 24


@query("gb_erosion")
def _gb(spark, sf_dir):
    """Grain boundaries of 24 crystals on a 24-cubed image."""
    seeds = sd.voronoi_seeds(spark, _FEW, (1.0, 1.0, 1.0), "sobol", 5)
    shape = (24, 24, 24)
    image, _ = erosion.erode_boundaries(raster.label_nearest_seed(grids.voxel_grid(spark, shape), seeds, shape), voronoi.tessellate(seeds), seeds, shape, thickness=0.1)
    return image


def _cube_boundaries(spark):
    """Eight cubes: faces at a quarter and three quarters of each axis."""
    seeds, shape = sd.voronoi_seeds(spark, 8, (1.0, 1.0, 1.0), "rubiks-cube"), (16, 16, 16)
    voxels = raster.label_nearest_seed(grids.voxel_grid(spark, shape), seeds, shape)
    return erosion.erode_boundaries(voxels, voronoi.tessellate(seeds), seeds, shape, thickness=0.1)


_NEARBY = " OR ".join(f"abs(abs(({i} + 0.5::DOUBLE) / 16 - 0.5::DOUBLE) - 0.25::DOUBLE) <= 0.05::DOUBLE" for i in "ijk")


@query("gb_lattice_mask", f"WITH {fx.grid_sql(16)} SELECT i, j, k, {_NEARBY} AS eroded FROM g")
def _lattice_mask(spark, sf_dir):
    image, _ = _cube_boundaries(spark)
    return image.select("i", "j", "k", ((F.col("label") >= 8) | (F.col("label") < 0)).alias("eroded"))


@query(
    "gb_lattice_table",
    "WITH p AS (SELECT a.id AS lo, b.id AS hi, xor(a.id, b.id) AS d FROM range(8) a(id), range(8) b(id) WHERE a.id < b.id) "
    "SELECT 7 + row_number() OVER (ORDER BY lo, hi) AS gb_tag, lo AS crystal_a, hi AS crystal_b, CAST(d = 4 AS INTEGER)::DOUBLE AS ax, CAST(d = 2 AS INTEGER)::DOUBLE AS ay, CAST(d = 1 AS INTEGER)::DOUBLE AS az FROM p WHERE d IN (1, 2, 4)",
)
def _lattice_table(spark, sf_dir):
    """Both faces of two cubes are one boundary; normals without their sign."""
    _, table = _cube_boundaries(spark)
    return fx.rounded(table.select("gb_tag", "crystal_a", "crystal_b", *[F.abs(f"n{c}").alias(f"a{c}") for c in "xyz"]))


def _foam_sql(n: int, radius: float) -> str:
    d = {c: f"least(abs({i} / {n - 1}.0::DOUBLE - 0.25::DOUBLE), abs({i} / {n - 1}.0::DOUBLE - 0.75::DOUBLE))" for c, i in zip("xyz", "ijk", strict=True)}
    near = ", ".join(f"{a} * {a} + {b} * {b}" for a, b in (("x", "y"), ("y", "z"), ("x", "z")))
    return f"WITH {fx.grid_sql(n)}, d AS (SELECT i, j, k, {d['x']} AS x, {d['y']} AS y, {d['z']} AS z FROM g) SELECT i, j, k, CAST(least({near}) <= {radius * radius!r}::DOUBLE AS INTEGER) AS label FROM d"


@query("voronoi_lattice_foam", _foam_sql(24, 0.07))
def _lattice_foam(spark, sf_dir):
    """Edges of eight cubes: lines along the axes."""
    faces = voronoi.tessellate(sd.voronoi_seeds(spark, 8, (1.0, 1.0, 1.0), "rubiks-cube"))
    return voronoi.foam(spark, faces, (24, 24, 24), radius=0.07, exact=True)


@query("gb_fraction", f"WITH {fx.labels_sql()} SELECT round(avg(CASE WHEN label >= 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS fraction FROM lab")
def _gb_fraction(spark, sf_dir):
    """Labels from 100 on stand for grain boundaries."""
    return boundary_fraction(fx.labels(spark, sf_dir), 100)


@query("voronoi_foam")
def _foam(spark, sf_dir):
    seeds = sd.voronoi_seeds(spark, _FEW, (1.0, 1.0, 1.0), "sobol", 5)
    return voronoi.foam(spark, voronoi.tessellate(seeds), (32, 32, 32), radius=0.04)


@query("gb_renumber", "WITH d AS (SELECT o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 + 100 AS tag FROM orders) SELECT o.o_orderkey AS id, CAST(d.tag AS BIGINT) AS tag FROM orders o JOIN (SELECT DISTINCT * FROM d) d ON o.o_custkey = d.o_custkey")
def _renumber(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return erosion.renumbered(orders, "o_custkey", 100, "tag").select("id", "tag")


@query("first_match_tag", "SELECT l_orderkey AS id, l_partkey AS tag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1")
def _first(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("tag"), "l_linenumber")
    return erosion.first_match(rows, ["id"], ["l_linenumber", "tag"]).select("id", "tag")


@query("running_offsets", "SELECT l_orderkey AS id, l_linenumber AS part, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS at FROM lineitem")
def _offsets(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("part"), "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("n"))
    return voronoi.running_offsets(rows, ["part", "l_partkey", "l_suppkey", "l_extendedprice"], "n", "at", ["id"]).select("id", "part", "at")


@query("label_lookup", f"WITH {fx.labels_sql()} SELECT i, j, k, CASE WHEN label >= 100 THEN round(s.x, 6) ELSE 0.0::DOUBLE END AS nx, label FROM lab LEFT JOIN seeds s ON s.seed_id = label")
def _lookup(spark, sf_dir):
    """A table of attributes joined to the labels it covers, zero elsewhere."""
    s = fx.seeds(spark, sf_dir).where("seed_id >= 100").select(F.col("seed_id").cast("long").alias("gb_tag"), fx.sql_round("x", 6).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.0).alias("nz"))
    return erosion.boundary_normals(fx.labels(spark, sf_dir), s).select("i", "j", "k", "nx", "label")


@query("circular_lead", f"WITH {fx.SEEDS}, p AS (SELECT seed_id // 5 AS polygon, seed_id, x, y FROM seeds) SELECT polygon, seed_id, "
       "round(coalesce(lead(x) OVER w, first_value(x) OVER w), 6) AS x2, round(coalesce(lead(y) OVER w, first_value(y) OVER w), 6) AS y2 FROM p WINDOW w AS (PARTITION BY polygon ORDER BY seed_id)")  # fmt: skip
def _circular(spark, sf_dir):
    p = fx.seeds(spark, sf_dir).select(F.floor(F.col("seed_id") / 5).cast("int").alias("polygon"), "seed_id", "x", "y")
    return fx.rounded(voronoi.circular_edges(p, ["polygon"], "seed_id", "x", "y").select("polygon", "seed_id", "x2", "y2"))
