"""Queries over generated fields, seeds, lattices and load paths."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.tpms import SURFACES
from ..operators import elastic, grids, lattices, loadpaths, raster, seeds as sd, spectral, tpms
from ..operators.fractions import binary_fractions, histogram, quantile, standardised, volume_fractions
from . import fixtures as fx
from .fixtures import FIELD, query

_SHAPE = (FIELD, FIELD, FIELD)
_N = FIELD**3
_TAU = 2.0 * math.pi

_FORMULA = {
    "gyroid": "sin(x) * cos(y) + sin(y) * cos(z) + sin(z) * cos(x)",
    "schwarz_p": "cos(x) + cos(y) + cos(z)",
    "diamond": "sin(x) * sin(y) * sin(z) + sin(x) * cos(y) * cos(z) + cos(x) * sin(y) * cos(z) + cos(x) * cos(y) * sin(z)",
    "neovius": "3 * (cos(x) + cos(y) + cos(z)) + 4 * cos(x) * cos(y) * cos(z)",
    "iwp": "2 * (cos(x) * cos(y) + cos(y) * cos(z) + cos(z) * cos(x)) - (cos(2 * x) + cos(2 * y) + cos(2 * z))",
    "lidinoid": "0.5::DOUBLE * (sin(2 * x) * cos(y) * sin(z) + sin(2 * y) * cos(z) * sin(x) + sin(2 * z) * cos(x) * sin(y)) "
    "- 0.5::DOUBLE * (cos(2 * x) * cos(2 * y) + cos(2 * y) * cos(2 * z) + cos(2 * z) * cos(2 * x)) + 0.15::DOUBLE",
}


def _field_sql(name: str) -> str:
    angles = ", ".join(f"{i} * 1.0::DOUBLE / {FIELD} * {_TAU!r}::DOUBLE AS {x}" for i, x in zip("ijk", "xyz", strict=True))
    return (
        f"{fx.grid_sql(FIELD)}, raw AS (SELECT i, j, k, {_FORMULA[name]} AS v FROM (SELECT i, j, k, {angles} FROM g)), "
        "f AS (SELECT i, j, k, round((v - (SELECT min(v) FROM raw)) / ((SELECT max(v) FROM raw) - (SELECT min(v) FROM raw)), 9) AS f FROM raw)"
    )


def _add_surface(name: str) -> None:
    sql = f"WITH {_field_sql(name)} SELECT i, j, k, round(f, 6) + 0.0::DOUBLE AS f, CAST(f > 0.5::DOUBLE AS INTEGER) AS solid, CAST(abs(f - 0.5::DOUBLE) < 0.1::DOUBLE AS INTEGER) AS shell FROM f"

    @query(f"tpms_{name}", sql)
    def _(spark, sf_dir):
        field = tpms.tpms_field(spark, name, _SHAPE)
        return fx.rounded(field.select("i", "j", "k", "f", tpms.phase(F.col("f")).alias("solid"), tpms.phase(F.col("f"), mode="shell").alias("shell")))


for _name in SURFACES:
    _add_surface(_name)


@query("tpms_fractions", f"WITH {_field_sql('gyroid')} SELECT CAST(f > 0.5::DOUBLE AS INTEGER) AS label, count(*) AS voxels, round(count(*) / {_N}::DOUBLE, 9) AS fraction FROM f GROUP BY 1")
def _tpms_fractions(spark, sf_dir):
    """Fractions of the phases of a gyroid."""
    field = tpms.tpms_field(spark, "gyroid", _SHAPE)
    return volume_fractions(field.select(tpms.phase(F.col("f")).alias("label")))


_VF = 0.3
_K = math.floor((1 - _VF) * _N + 0.5)


@query("tpms_threshold_for_vf", f"WITH {_field_sql('gyroid')}, r AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS pos FROM f) SELECT f AS threshold FROM r WHERE pos = {_K}")
def _threshold(spark, sf_dir):
    return tpms.threshold_for_fraction(tpms.tpms_field(spark, "gyroid", _SHAPE), _N, _VF)


@query(
    "tpms_shell_thickness",
    f"WITH {_field_sql('iwp')}, r AS (SELECT round(abs(f - 0.5::DOUBLE), 9) AS d, row_number() OVER (ORDER BY abs(f - 0.5::DOUBLE)) - 1 AS pos FROM f) SELECT d AS thickness FROM r WHERE pos = {math.floor(_VF * _N + 0.5)}",
)
def _thickness(spark, sf_dir):
    return tpms.exact_shell_thickness(tpms.tpms_field(spark, "iwp", _SHAPE), _N, 0.5, _VF)


@query("binary_fraction", f"WITH {_field_sql('schwarz_p')} SELECT round(1.0::DOUBLE - avg(b), 9) AS vf0, round(avg(b), 9) AS vf1 FROM (SELECT CAST(f > 0.5::DOUBLE AS DOUBLE) AS b FROM f)")
def _binary(spark, sf_dir):
    field = tpms.tpms_field(spark, "schwarz_p", _SHAPE)
    return binary_fractions(field.select(tpms.phase(F.col("f")).alias("label")))


@query("volume_fractions", "SELECT l_returnflag AS label, count(*) AS voxels, round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 9) AS fraction FROM lineitem GROUP BY l_returnflag")
def _fractions(spark, sf_dir):
    return volume_fractions(fx.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label")))


@query("min_max_normalise", "SELECT event_id, round((value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)), 6) + 0.0::DOUBLE AS f FROM events")
def _min_max(spark, sf_dir):
    return fx.rounded(tpms.normalised(fx.table(spark, sf_dir, "events").select("event_id", F.col("value").alias("f")), "f", None))


@query("standardise", "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) + 0.0::DOUBLE AS value FROM events")
def _standardise(spark, sf_dir):
    return fx.rounded(standardised(fx.table(spark, sf_dir, "events").select("event_id", "value"), "value"))


@query("quantile_threshold", "SELECT quantile_cont(value, 0.7::DOUBLE) AS threshold FROM events")
def _quantile(spark, sf_dir):
    return quantile(fx.table(spark, sf_dir, "events"), "value", 0.7)


@query(
    "volume_histogram",
    "WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(least(greatest(floor((l_extendedprice - lo) / (hi - lo) * 128), 0), 127) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1",
)
def _histogram(spark, sf_dir):
    return histogram(fx.table(spark, sf_dir, "lineitem"), "l_extendedprice", 128)


def _lattice_sql(n: int, stagger: bool) -> str:
    nx, ny, nz = sd.factorise(n, 3)
    x = f"i * {1.0 / nx!r}::DOUBLE" + (f" + ((j % 2) + (k % 2))::DOUBLE * {1.0 / nx / 2!r}::DOUBLE" if stagger else "")
    y = f"j * {1.0 / ny!r}::DOUBLE" + (f" + (k % 2)::DOUBLE * {1.0 / ny / 2!r}::DOUBLE" if stagger else "")
    return (
        f"WITH r AS (SELECT CAST(id AS INTEGER) AS seed_id, id // {ny * nz} AS i, (id // {nz}) % {ny} AS j, id % {nz} AS k FROM range({n}) t(id)) "
        f"SELECT seed_id, round(({x}) % 1.0::DOUBLE, 6) AS x, round(({y}) % 1.0::DOUBLE, 6) AS y, round((k * {1.0 / nz!r}::DOUBLE) % 1.0::DOUBLE, 6) AS z FROM r"
    )


@query("seeds_honeycomb", _lattice_sql(360, True))
def _honeycomb(spark, sf_dir):
    return fx.rounded(sd.voronoi_seeds(spark, 360, (1.0, 1.0, 1.0), "honeycomb"))


@query("seeds_rubiks", _lattice_sql(360, False))
def _rubiks(spark, sf_dir):
    return fx.rounded(sd.voronoi_seeds(spark, 360, (1.0, 1.0, 1.0), "rubiks-cube"))


@query("seeds_diamond", "SELECT CAST(id AS INTEGER) AS seed_id, id * 0.5::DOUBLE AS x, id * 0.5::DOUBLE AS y, id * 0.5::DOUBLE AS z FROM range(2) t(id)")
def _diamond(spark, sf_dir):
    return fx.rounded(sd.voronoi_seeds(spark, 2, (1.0, 1.0, 1.0), "diamond"))


def _halton_sql(n: int) -> str:
    columns = []
    for name, base in zip("xyz", (2, 3, 5), strict=True):
        digits = math.ceil(math.log(n) / math.log(base)) + 1
        terms = " + ".join(f"((id // {base**d}) % {base}) * {base ** -(d + 1.0)!r}::DOUBLE" for d in range(digits))
        columns.append(f"round({terms}, 6) AS {name}")
    return f"SELECT CAST(id AS INTEGER) AS seed_id, {', '.join(columns)} FROM range({n}) t(id)"


@query("seeds_halton", _halton_sql(1000))
def _halton(spark, sf_dir):
    return fx.rounded(sd.voronoi_seeds(spark, 1000, (1.0, 1.0, 1.0), "halton"))


def _scrambled_sql(n: int, seed: int) -> str:
    columns = []
    for name, base, axis in zip("xyz", (2, 3, 5), sd.halton_permutations(seed), strict=True):
        terms = " + ".join(f"{turned}[1 + (id // {base**d}) % {base}] * {base ** -(d + 1.0)!r}::DOUBLE" for d, turned in enumerate(axis))
        columns.append(f"round({terms}, 6) AS {name}")
    return f"SELECT CAST(id AS INTEGER) AS seed_id, {', '.join(columns)} FROM range({n}) t(id)"


@query("seeds_halton_scrambled", _scrambled_sql(1000, 42))
def _scrambled(spark, sf_dir):
    return fx.rounded(sd.voronoi_seeds(spark, 1000, (1.0, 1.0, 1.0), "halton-scrambled", 42))


def _sobol_sql(n: int, seed: int) -> str:
    """Bits of the Gray code pick direction numbers; all are added without carry, to the digital shift of the seed."""
    columns = []
    for axis, shift in zip("xyz", sd.sobol_shift(seed), strict=True):
        value = f"{shift}::BIGINT"
        for bit, v in enumerate(sd.sobol_directions(axis)[: (n - 1).bit_length()]):
            value = f"xor({value}, CASE WHEN (gray >> {bit}) & 1 = 1 THEN {v}::BIGINT ELSE 0 END)"
        columns.append(f"round({value} / {1 << sd.SOBOL_BITS}::DOUBLE, 9) AS {axis}")
    return f"WITH g AS (SELECT id, xor(id, id >> 1) AS gray FROM range({n}) t(id)) SELECT CAST(id AS INTEGER) AS seed_id, {', '.join(columns)} FROM g"


@query("sobol_seeds", _sobol_sql(1024, 1))
def _sobol(spark, sf_dir):
    return fx.rounded(sd.voronoi_seeds(spark, 1024, (1.0, 1.0, 1.0), "sobol", 1), 9)


@query("lhs_seeds")
def _lhs(spark, sf_dir):
    return sd.voronoi_seeds(spark, 125, (1.0, 1.0, 1.0), "lhs-lloyd", 1)


@query("random_seeds")
def _random(spark, sf_dir):
    return sd.with_orientations(sd.voronoi_seeds(spark, 1000, (1.0, 1.0, 1.0), "random", 1))


_ANGLES = f"a AS (SELECT seed_id, x * {2 * math.pi!r}::DOUBLE AS p, acos(y * 2 - 1) AS q, z * {2 * math.pi!r}::DOUBLE AS r FROM seeds)"
_ROTATION = (
    ("cos(p) * cos(r) - sin(p) * cos(q) * sin(r)", "-cos(p) * sin(r) - sin(p) * cos(q) * cos(r)", "sin(p) * sin(q)"),
    ("sin(p) * cos(r) + cos(p) * cos(q) * sin(r)", "-sin(p) * sin(r) + cos(p) * cos(q) * cos(r)", "-cos(p) * sin(q)"),
    ("sin(q) * sin(r)", "sin(q) * cos(r)", "cos(q)"),
)


@query("orientations", f"WITH {fx.SEEDS}, {_ANGLES} SELECT seed_id, " + ", ".join(f"round({e}, 6) + 0.0::DOUBLE AS r{i}{j}" for i, row in enumerate(_ROTATION) for j, e in enumerate(row)) + " FROM a")
def _orientations(spark, sf_dir):
    frames = sd.orientations(fx.seeds(spark, sf_dir), F.col("x"), F.col("y"), F.col("z"))
    return fx.rounded(frames.select("seed_id", *[F.get(F.get("frame", i), j).alias(f"r{i}{j}") for i in range(3) for j in range(3)]))


def _cell_sql(name: str) -> str:
    pairs = lattices.UNIT_CELLS[name]()
    rows = ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" for p in pair for v in p) + ")" for pair in pairs)
    n, radius = FIELD, 0.05
    h = 1.0 / (n - 1)
    step = math.sqrt(3 * h * h)
    reach = math.ceil(radius / h) + 1
    point = ", ".join(f"round(a_{c} + (CASE WHEN n > 1 THEN s / (n - 1)::DOUBLE ELSE 0 END) * (b_{c} - a_{c}), 9) AS {c}" for c in "xyz")
    inside = " AND ".join(f"{c} >= -1e-12 AND {c} < 1.0::DOUBLE + 1e-12" for c in "xyz")
    voxel = ", ".join(f"CAST(least(greatest(floor({c} * {n - 1} + 0.5::DOUBLE), 0), {n - 1}) AS INTEGER) AS v{i}" for c, i in zip("xyz", "ijk", strict=True))
    return f"""WITH s AS (SELECT * FROM (VALUES {rows}) t(a_x, a_y, a_z, b_x, b_y, b_z)),
m AS (SELECT *, greatest(1, CAST(ceil(round(sqrt((b_x - a_x) * (b_x - a_x) + (b_y - a_y) * (b_y - a_y) + (b_z - a_z) * (b_z - a_z)) / {step!r}::DOUBLE, 9)) AS INTEGER)) AS n FROM s),
p AS (SELECT {point} FROM (SELECT *, unnest(range(n)) AS s FROM m)),
v AS (SELECT DISTINCT {voxel} FROM p WHERE {inside}),
o AS (SELECT CAST(a - {reach} AS INTEGER) AS a, CAST(b - {reach} AS INTEGER) AS b, CAST(c - {reach} AS INTEGER) AS c FROM range({2 * reach + 1}) x(a), range({2 * reach + 1}) y(b), range({2 * reach + 1}) z(c)),
e AS (SELECT * FROM o WHERE a * {h!r}::DOUBLE * (a * {h!r}::DOUBLE) + b * {h!r}::DOUBLE * (b * {h!r}::DOUBLE) + c * {h!r}::DOUBLE * (c * {h!r}::DOUBLE) <= {radius * radius!r}::DOUBLE),
w AS (SELECT DISTINCT vi + a AS i, vj + b AS j, vk + c AS k FROM v, e),
{fx.grid_sql(n)}
SELECT g.i, g.j, g.k, CAST(w.i IS NOT NULL AS INTEGER) AS label FROM g LEFT JOIN w ON g.i = w.i AND g.j = w.j AND g.k = w.k"""


def _add_lattice(name: str) -> None:
    @query(f"lattice_{name}", _cell_sql(name))
    def _(spark, sf_dir):
        return lattices.lattice_image(spark, name, _SHAPE)


for _name in lattices.UNIT_CELLS:
    _add_lattice(_name)


def _rigidity_sql() -> str:
    rows = []
    for name, make in lattices.UNIT_CELLS.items():
        pairs = make()
        rows.append(f"('{name}', {len({p for pair in pairs for p in pair})}, {len(pairs)})")
    text = "CASE WHEN m = 0 THEN 'statically determinate' WHEN m > 0 THEN 'over-constrained' ELSE 'under-constrained' END"
    return f"SELECT lattice, joints, struts, m AS maxwell, {text} AS rigidity FROM (SELECT *, struts - 3 * joints + 6 AS m FROM (VALUES {', '.join(rows)}) t(lattice, joints, struts))"


@query("lattice_rigidity", _rigidity_sql())
def _rigidity(spark, sf_dir):
    return lattices.lattice_rigidity(spark)


def _exact_sql(name: str, radius: float) -> str:
    """All nodes near a strut at any of its 27 places, by the distance to the segment."""
    rows = ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" for p in pair for v in p) + ")" for pair in lattices.UNIT_CELLS[name]())
    n, h = FIELD, 1.0 / (FIELD - 1)
    d = {c: f"(b_{c} - a_{c})" for c in "xyz"}
    dd = " + ".join(f"{d[c]} * {d[c]}" for c in "xyz")
    near = " AND ".join(f"g.{i} * {h!r}::DOUBLE BETWEEN least(a_{c}, b_{c}) - {radius} AND greatest(a_{c}, b_{c}) + {radius}" for c, i in zip("xyz", "ijk", strict=True))
    t = "least(greatest((" + " + ".join(f"(g.{i} * {h!r}::DOUBLE - a_{c}) * {d[c]}" for c, i in zip("xyz", "ijk", strict=True)) + f") / ({dd}), 0), 1)"
    off = " + ".join(f"power(g.{i} * {h!r}::DOUBLE - a_{c} - t * {d[c]}, 2)" for c, i in zip("xyz", "ijk", strict=True))
    return f"""WITH {fx.grid_sql(n)}, s AS (SELECT * FROM (VALUES {rows}) t(a_x, a_y, a_z, b_x, b_y, b_z)),
o AS (SELECT CAST(v - 1 AS DOUBLE) AS v FROM range(3) t(v)),
c AS (SELECT a_x + ox.v AS a_x, a_y + oy.v AS a_y, a_z + oz.v AS a_z, b_x + ox.v AS b_x, b_y + oy.v AS b_y, b_z + oz.v AS b_z FROM s, o ox, o oy, o oz),
p AS (SELECT g.*, c.*, {t} AS t FROM g JOIN c ON {near})
SELECT DISTINCT i, j, k FROM p g WHERE {off} <= {radius * radius!r}::DOUBLE"""


@query("lattice_exact_struts", _exact_sql("octet", 0.05))
def _exact(spark, sf_dir):
    vertices, edges = lattices.unit_cell(spark, "octet")
    return raster.exact_struts(raster.struts_of(vertices, edges), _SHAPE, radius=0.05)


_DEV = "sqrt((t1 - tr / 3) * (t1 - tr / 3) + (t2 - tr / 3) * (t2 - tr / 3) + (t3 - tr / 3) * (t3 - tr / 3) + t4 * t4 + t5 * t5 + t6 * t6)"
_PATHS = (
    f"WITH {fx.TENSORS}, p AS (SELECT *, t1 + t2 + t3 AS tr FROM tensors), q AS (SELECT *, {_DEV} AS dev FROM p), "
    "s AS (SELECT *, coalesce(least(CASE WHEN dev > 1e-8 THEN 0.03::DOUBLE / dev END, CASE WHEN abs(tr) > 1e-8 THEN 0.005::DOUBLE / abs(tr) END), 0) AS s FROM q) "
    "SELECT id AS path_id, CAST(step AS INTEGER) AS step, " + ", ".join(f"round(t{c} * s * step / 10.0::DOUBLE, 9) + 0.0::DOUBLE AS e{c}" for c in range(1, 7)) + " FROM s, range(1, 11) r(step)"
)


@query("load_paths", _PATHS)
def _paths(spark, sf_dir):
    paths = loadpaths.linear_paths(fx.tensors(spark, sf_dir).select(F.col("id").alias("path_id"), F.col("t").alias("v")))
    return fx.rounded(paths.select("path_id", "step", *[F.get("e", c).alias(f"e{c + 1}") for c in range(6)]), 9)


@query("load_path_json", _PATHS)
def _path_json(spark, sf_dir):
    """Paths as JSON texts, parsed again: what a reader of the file gets."""
    texts = loadpaths.path_json(loadpaths.linear_paths(fx.tensors(spark, sf_dir).select(F.col("id").alias("path_id"), F.col("t").alias("v"))))
    steps = texts.select("path_id", F.posexplode(F.from_json("json", "array<array<double>>")).alias("p", "e"))
    return fx.rounded(steps.select("path_id", (F.col("p") + 1).alias("step"), *[F.get("e", c).alias(f"e{c + 1}") for c in range(6)]), 9)


@query("equal_area_directions")
def _directions(spark, sf_dir):
    return loadpaths.equal_area_directions(spark, 32)


@query(
    "direction_grid",
    f"SELECT CAST(id // 360 AS INTEGER) AS t, CAST(id % 360 AS INTEGER) AS p, round(sin((id // 360) * {math.pi / 179!r}::DOUBLE) * cos((id % 360) * {2 * math.pi / 359!r}::DOUBLE), 6) + 0.0::DOUBLE AS x, "
    f"round(sin((id // 360) * {math.pi / 179!r}::DOUBLE) * sin((id % 360) * {2 * math.pi / 359!r}::DOUBLE), 6) + 0.0::DOUBLE AS y, round(cos((id // 360) * {math.pi / 179!r}::DOUBLE), 6) + 0.0::DOUBLE AS z FROM range(64800) r(id)",
)
def _direction_grid(spark, sf_dir):
    return fx.rounded(elastic.direction_grid(spark).select("t", "p", "x", "y", "z"))


@query("spinodal")
def _spinodal(spark, sf_dir):
    return spectral.spinodal_image(spark, _SHAPE, 0.4, wavenumber=(5.0, 5.0, 5.0), sigma=0.3)


def _band_sql() -> str:
    n = FIELD
    k = [f"(CASE WHEN {i} < {(n + 1) // 2} THEN {i} ELSE {i} - {n} END) * {2 * math.pi!r}::DOUBLE / {2 * math.pi * 5!r}::DOUBLE" for i in "ijk"]
    return f"WITH {fx.grid_sql(n)}, q AS (SELECT i, j, k, {k[0]} AS a, {k[1]} AS b, {k[2]} AS c FROM g) SELECT i, j, k, round(exp(-0.5::DOUBLE * ((sqrt(a * a + b * b + c * c) - 1) / 0.3::DOUBLE) * ((sqrt(a * a + b * b + c * c) - 1) / 0.3::DOUBLE)), 6) + 0.0::DOUBLE AS w FROM q"


@query("band_pass", _band_sql())
def _band(spark, sf_dir):
    return fx.rounded(grids.voxel_grid(spark, _SHAPE).withColumn("w", spectral.band_pass(_SHAPE, (5.0, 5.0, 5.0), 0.3)))


@query("permute_axes", f"WITH {fx.grid_sql(FIELD)} SELECT k AS i, j, i AS k, i * 10000 + j * 100 + k AS v FROM g")
def _permute(spark, sf_dir):
    voxels = grids.voxel_grid(spark, _SHAPE).withColumn("v", F.col("i") * 10000 + F.col("j") * 100 + F.col("k"))
    return grids.permute_axes(voxels, "zyx")


@query(
    "grid_inference",
    f"WITH {fx.grid_sql(FIELD)}, c AS (SELECT i * 10000 + j * 100 + k AS cell, round((k + 0.5::DOUBLE) / {FIELD}, 9) AS x, round((j + 0.5::DOUBLE) / {FIELD}, 9) AS y, round((i + 0.5::DOUBLE) / {FIELD}, 9) AS z FROM g) "
    "SELECT cell, CAST(dense_rank() OVER (ORDER BY x) - 1 AS INTEGER) AS i, CAST(dense_rank() OVER (ORDER BY y) - 1 AS INTEGER) AS j, CAST(dense_rank() OVER (ORDER BY z) - 1 AS INTEGER) AS k FROM c",
)
def _inference(spark, sf_dir):
    g = grids.voxel_grid(spark, _SHAPE)
    at = lambda c: grids.cell_centre(F.col(c), FIELD)
    cells = g.select((F.col("i") * 10000 + F.col("j") * 100 + F.col("k")).alias("cell"), at("k").alias("x"), at("j").alias("y"), at("i").alias("z"))
    return grids.infer_grid(cells).select("cell", "i", "j", "k")
