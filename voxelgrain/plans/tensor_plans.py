"""Queries over tensors: notations, invariants, elastic constants, bounds, directional stiffness."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import tensors as tn
from ..operators import elastic
from . import fixtures as fx
from .fixtures import query

_R2, _RH = f"{math.sqrt(2.0)!r}::DOUBLE", f"{math.sqrt(0.5)!r}::DOUBLE"


def _sql6(exprs: list[str], digits: int = 6) -> str:
    return f"WITH {fx.TENSORS} SELECT id, " + ", ".join(f"round({e}, {digits}) + 0.0::DOUBLE AS m{c}" for c, e in enumerate(exprs)) + " FROM tensors"


def _six(make):
    def run(spark, sf_dir):
        out = fx.tensors(spark, sf_dir).select("id", make(F.col("t")).alias("m"))
        return fx.rounded(out.select("id", *[F.get("m", c).alias(f"m{c}") for c in range(6)]))

    return run


def _ordered(factor: str) -> list[str]:
    scaled = [f"t{c + 1}" + (f" * {factor}" if c > 2 else "") for c in range(6)]
    return [scaled[c] for c in tn.VOIGT_TO_MANDEL]


query("voigt_mandel_strain", _sql6(_ordered(_RH)))(_six(tn.voigt_strain_to_mandel))
query("voigt_mandel_stress", _sql6(_ordered(_R2)))(_six(tn.voigt_stress_to_mandel))
query("mandel_voigt_strain", _sql6(_ordered(_R2)))(_six(tn.mandel_to_voigt_strain))
query("mandel_voigt_stress", _sql6(_ordered(_RH)))(_six(tn.mandel_to_voigt_stress))

_FULL = [["t1", f"t4 * {_RH}", f"t5 * {_RH}"], [f"t4 * {_RH}", "t2", f"t6 * {_RH}"], [f"t5 * {_RH}", f"t6 * {_RH}", "t3"]]


@query("mandel_full", f"WITH {fx.TENSORS} SELECT id, " + ", ".join(f"round({_FULL[i][j]}, 6) + 0.0::DOUBLE AS a{i}{j}" for i in range(3) for j in range(3)) + " FROM tensors")
def _full(spark, sf_dir):
    out = fx.tensors(spark, sf_dir).select("id", tn.mandel_to_full(F.col("t")).alias("a"))
    return fx.rounded(out.select("id", *[F.get(F.get("a", i), j).alias(f"a{i}{j}") for i in range(3) for j in range(3)]))


query("full_mandel", _sql6([f"t{c}" for c in range(1, 7)]))(_six(lambda t: tn.full_to_mandel(tn.mandel_to_full(t))))


def _rank4_sql(factor: str) -> str:
    entries = []
    for i in tn.VOIGT_TO_MANDEL:
        for j in tn.VOIGT_TO_MANDEL:
            e = f"c[{6 * i + j + 1}]" + (f" * {factor}" if j < 3 else "") + (f" * {factor}" if i < 3 else "")
            entries.append(f"round({e}, 9) + 0.0::DOUBLE")
    return f"WITH {fx.STIFFNESS} SELECT id, [{', '.join(entries)}] AS c FROM stiffness"


@query("stiffness_mandel", _rank4_sql(_R2))
def _stiffness(spark, sf_dir):
    return fx.rounded(fx.stiffness(spark, sf_dir).select("id", tn.stiffness_voigt_to_mandel(F.col("c")).alias("c")), 9)


@query("compliance_mandel", _rank4_sql(_RH))
def _compliance(spark, sf_dir):
    return fx.rounded(fx.stiffness(spark, sf_dir).select("id", tn.compliance_voigt_to_mandel(F.col("c")).alias("c")), 9)


_K = "(" + " + ".join(f"c[{6 * i + j + 1}]" for i in range(3) for j in range(3)) + ") / 9"
_TR = "(" + " + ".join(f"c[{7 * i + 1}]" for i in range(6)) + ")"


@query("iso_projection", f"WITH {fx.STIFFNESS} SELECT id, round({_K}, 6) AS bulk, round(({_TR} - 3 * ({_K})) / 10, 6) + 0.0::DOUBLE AS shear FROM stiffness")
def _iso(spark, sf_dir):
    return fx.rounded(fx.stiffness(spark, sf_dir).select("id", tn.iso_projection_bulk(F.col("c")).alias("bulk"), tn.iso_projection_shear(F.col("c")).alias("shear")))


@query("iso_kappa", f"WITH {fx.TENSORS} SELECT id, round((t1 + t2 + t3) / 3, 6) + 0.0::DOUBLE AS kappa FROM tensors")
def _kappa(spark, sf_dir):
    return fx.rounded(fx.tensors(spark, sf_dir).select("id", tn.iso_projection_kappa(F.col("t")).alias("kappa")))


_ISO = ", ".join(
    "round(" + ("(3 * k - 2 * g) / 3" if i < 3 and j < 3 else "0.0::DOUBLE") + (" + 2 * g" if i == j else "") + ", 6) + 0.0::DOUBLE" for i in range(6) for j in range(6)
)


@query("isotropic_stiffness", f"SELECT p_partkey AS id, [{_ISO}] AS c FROM (SELECT p_partkey, p_retailprice AS k, p_size::DOUBLE AS g FROM part)")
def _isotropic(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    return fx.rounded(part.select(F.col("p_partkey").alias("id"), tn.isotropic_stiffness(F.col("p_retailprice"), F.col("p_size").cast("double")).alias("c")))


_EL = (
    "SELECT p_partkey AS id, CASE WHEN m = 0 THEN e ELSE 9 * k * g / (3 * k + g) END AS young, CASE WHEN m = 0 THEN e / (2 * g) - 1 ELSE 9 * k * g / (3 * k + g) / (2 * g) - 1 END AS ratio, g, "
    "CASE WHEN m = 0 THEN e / (3 * (1 - 2 * (e / (2 * g) - 1))) ELSE k END AS bulk FROM (SELECT p_partkey, p_partkey % 2 AS m, p_retailprice AS k, p_retailprice / 2 AS g, p_retailprice * 1.25::DOUBLE AS e FROM part)"
)


@query("elastic_constants", f"SELECT id, round(young, 6) AS young, round(ratio, 6) AS ratio, round(g, 6) AS shear, round(bulk, 6) AS bulk FROM ({_EL})")
def _elastic(spark, sf_dir):
    """Pairs chosen row by row: Young's and shear modulus for even keys, bulk and shear modulus for odd ones."""
    price, odd = F.col("p_retailprice"), F.col("p_partkey") % 2 == 1
    constants = tn.elastic_constants(e=F.when(~odd, price * 1.25), g=price / 2, k=F.when(odd, price))
    out = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), constants.alias("m"))
    return fx.rounded(out.select("id", F.col("m.E").alias("young"), F.col("m.nu").alias("ratio"), F.col("m.G").alias("shear"), F.col("m.K").alias("bulk")))


_P = "(t1 + t2 + t3) / 3"
_DIAG = [f"(t{c} - {_P})" for c in (1, 2, 3)]
_SH = "(t4 * t4 + t5 * t5 + t6 * t6)"
_VM = f"sqrt(0.5::DOUBLE * ((t1 - t2) * (t1 - t2) + (t2 - t3) * (t2 - t3) + (t3 - t1) * (t3 - t1) + 6 * {_SH}))"


def _det(m: list[list[str]]) -> str:
    a, b, c = m
    return f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"


_P3 = [[f"({x})" for x in row] for row in _FULL]
_DEVM = [[_DIAG[i] if i == j else _P3[i][j] for j in range(3)] for i in range(3)]
_J2 = f"(0.5::DOUBLE * ({_DIAG[0]} * {_DIAG[0]} + {_DIAG[1]} * {_DIAG[1]} + {_DIAG[2]} * {_DIAG[2]}) + {_SH})"
_J3 = _det(_DEVM)


def _r(e: str, name: str) -> str:
    return f"round({e}, 6) + 0.0::DOUBLE AS {name}"


@query("rank2_measures", f"WITH {fx.TENSORS} SELECT id, {_r(_VM, 'von_mises')}, {_r(_P, 'hydrostatic')}, " + ", ".join(_r(d, f"d{c}") for c, d in enumerate([*_DIAG, "t4", "t5", "t6"])) + " FROM tensors")
def _measures(spark, sf_dir):
    m = tn.rank2_measures(F.col("t"))
    out = fx.tensors(spark, sf_dir).select("id", m["von_mises"].alias("von_mises"), m["hydrostatic"].alias("hydrostatic"), m["deviatoric"].alias("d"))
    return fx.rounded(out.select("id", "von_mises", "hydrostatic", *[F.get("d", c).alias(f"d{c}") for c in range(6)]))


@query(
    "invariants",
    f"WITH {fx.TENSORS} SELECT id, {_r('t1 + t2 + t3', 'i1')}, {_r(f't1 * t2 + t2 * t3 + t3 * t1 - {_SH}', 'i2')}, {_r(_det(_P3), 'i3')}, {_r(_J2, 'j2')}, {_r(_J3, 'j3')} FROM tensors",
)
def _invariants(spark, sf_dir):
    m = tn.rank2_measures(F.col("t"), ("I_invariants", "J_invariants"))
    out = fx.tensors(spark, sf_dir).select("id", m["I_invariants"].alias("i"), m["J_invariants"].alias("j"))
    return fx.rounded(out.select("id", *[F.get("i", c).alias(f"i{c + 1}") for c in range(3)], *[F.get("j", c).alias(f"j{c + 1}") for c in (1, 2)]))


_R_SQ = f"(({_DIAG[0]} * {_DIAG[0]} + {_DIAG[1]} * {_DIAG[1]} + {_DIAG[2]} * {_DIAG[2]} + 2 * ({_P3[0][1]} * {_P3[0][1]} + {_P3[0][2]} * {_P3[0][2]} + {_P3[1][2]} * {_P3[1][2]})) / 6)"
_EIG = (
    f"WITH {fx.TENSORS}, e AS (SELECT id, {_P} AS p, sqrt({_R_SQ}) AS r, {_J3} AS d FROM tensors), "
    "h AS (SELECT id, p, r, acos(least(greatest(CASE WHEN r > 0 THEN d / (2 * r * r * r) ELSE 1 END, -1), 1)) / 3 AS f FROM e), "
    f"v AS (SELECT id, p + 2 * r * cos(f + {2 * math.pi / 3!r}::DOUBLE) AS l1, p + 2 * r * cos(f - {2 * math.pi / 3!r}::DOUBLE) AS l2, p + 2 * r * cos(f) AS l3 FROM h) "
)


@query("principal", _EIG + f"SELECT id, {_r('l1', 'l1')}, {_r('l2', 'l2')}, {_r('l3', 'l3')}, {_r('(l3 - l1) / 2', 'max_shear')} FROM v")
def _principal(spark, sf_dir):
    out = fx.tensors(spark, sf_dir).select("id", tn.principal(F.col("t")).alias("l"), tn.max_shear(F.col("t")).alias("max_shear"))
    return fx.rounded(out.select("id", *[F.get("l", c).alias(f"l{c + 1}") for c in range(3)], "max_shear"))


@query("eigenvectors", _EIG + f"SELECT id, {_r('l1', 'l1')}, {_r('l2', 'l2')}, {_r('l3', 'l3')}, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS skew FROM v")
def _eigenvectors(spark, sf_dir):
    """Each tensor's quadratic form along its eigenvectors, and how far these are from solving it and from a basis."""
    full = tn.full_components(F.col("t"))
    out = fx.tensors(spark, sf_dir).select("id", F.array(*[F.array(*r) for r in full]).alias("a"), tn.principal(F.col("t")).alias("l"), tn.eigenvectors(F.col("t")).alias("v"))
    at = lambda m, i, j: F.get(F.get(m, i), j)
    image = [[sum(at("a", i, k) * at("v", k, j) for k in range(3)) for j in range(3)] for i in range(3)]
    form = [sum(at("v", i, j) * image[i][j] for i in range(3)) for j in range(3)]
    residual = F.greatest(*[F.abs(image[i][j] - F.get("l", j) * at("v", i, j)) for i in range(3) for j in range(3)])
    skew = F.greatest(*[F.abs(sum(at("v", k, i) * at("v", k, j) for k in range(3)) - float(i == j)) for i in range(3) for j in range(i, 3)])
    return fx.rounded(out.select("id", *[f.alias(f"l{j + 1}") for j, f in enumerate(form)], residual.alias("residual"), skew.alias("skew")))


@query(
    "lode_angle",
    f"WITH {fx.TENSORS}, j AS (SELECT id, greatest({_J2}, 1e-12) AS j2, {_J3} AS j3 FROM tensors) SELECT id, "
    f"{_r(f'acos(least(greatest({1.5 * math.sqrt(3.0)!r}::DOUBLE * j3 / (j2 * sqrt(j2)), -1), 1)) / 3', 'lode_angle')} FROM j",
)
def _lode(spark, sf_dir):
    return fx.rounded(fx.tensors(spark, sf_dir).select("id", tn.lode_angle(F.col("t")).alias("lode_angle")))


def _weighted(spark, sf_dir):
    """All stiffnesses with equal volume fractions."""
    every = fx.stiffness(spark, sf_dir)
    return every.withColumn("fraction", F.lit(1.0 / max(every.count(), 1)))


@query(
    "voigt_bound",
    f"WITH {fx.STIFFNESS}, u AS (SELECT unnest(range(36)) AS p, unnest(c) AS v FROM stiffness) SELECT CAST(p AS INTEGER) AS p, round(sum(v) / (SELECT count(*) FROM stiffness), 6) + 0.0::DOUBLE AS v FROM u GROUP BY p",
)
def _voigt(spark, sf_dir):
    return fx.rounded(elastic.voigt_bound(_weighted(spark, sf_dir)).select(F.posexplode("c").alias("p", "v")))


def _inverted(source: str, name: str = "x") -> str:
    """CTEs that invert the 6 x 6 matrices (id, c) of ``source`` in place, one pivot after another; the last is ``name``6.

    Without exchange of rows, which positive definite matrices don't need; ``p0`` to ``p5`` are the pivots.
    """
    at = lambda i, j: f"m{6 * i + j}"
    ctes = [f"{name}0 AS MATERIALIZED (SELECT id, " + ", ".join(f"c[{n + 1}] AS m{n}" for n in range(36)) + f" FROM {source})"]
    for p in range(6):
        entries = []
        for i in range(6):
            for j in range(6):
                if i == p and j == p:
                    e = f"1.0::DOUBLE / {at(p, p)}"
                elif i == p:
                    e = f"{at(p, j)} / {at(p, p)}"
                elif j == p:
                    e = f"-{at(i, p)} / {at(p, p)}"
                else:
                    e = f"{at(i, j)} - {at(i, p)} * {at(p, j)} / {at(p, p)}"
                entries.append(f"{e} AS {at(i, j)}")
        pivots = [f"p{q}" for q in range(p)] + [f"{at(p, p)} AS p{p}"]
        ctes.append(f"{name}{p + 1} AS MATERIALIZED (SELECT id, {', '.join(entries)}, {', '.join(pivots)} FROM {name}{p})")
    return ", ".join(ctes)


_MEAN = "mean AS (SELECT 0 AS id, [" + ", ".join(f"avg(m{n})" for n in range(36)) + "] AS c FROM x6)"


@query("reuss_bound", f"WITH {fx.STIFFNESS}, {_inverted('stiffness')}, {_MEAN}, {_inverted('mean', 'y')} SELECT CAST(p AS INTEGER) AS p, round(v, 6) + 0.0::DOUBLE AS v FROM (SELECT unnest(range(36)) AS p, unnest([" + ", ".join(f"m{n}" for n in range(36)) + "]) AS v FROM y6)")
def _reuss(spark, sf_dir):
    return fx.rounded(elastic.reuss_bound(_weighted(spark, sf_dir)).select(F.posexplode("c").alias("p", "v")))


_SHIFTED = "shifted AS (SELECT id, [" + ", ".join(f"c[{n + 1}]" + (" - 1.5::DOUBLE" if n % 7 == 0 else "") for n in range(36)) + "] AS c FROM stiffness)"


@query(
    "is_spd",
    f"WITH {fx.STIFFNESS}, {_SHIFTED}, {_inverted('shifted')} SELECT x6.id, " + " AND ".join(f"p{q} > 0" for q in range(6)) + " AS spd, round(" + " + ".join(f"shifted.c[{7 * q + 1}]" for q in range(6)) + ", 6) + 0.0::DOUBLE AS eigenvalue_sum, "
    "round(" + " * ".join(f"p{q}" for q in range(6)) + ", 4) + 0.0::DOUBLE AS eigenvalue_product FROM x6 JOIN shifted ON shifted.id = x6.id",
)
def _spd(spark, sf_dir):
    """Stiffnesses less 1.5 on the diagonal, so that some are indefinite, with sum and product of their eigenvalues."""
    lowered = F.transform("c", lambda v, n: F.when(n % 7 == 0, v - 1.5).otherwise(v))
    out = elastic.definiteness(fx.stiffness(spark, sf_dir).select("id", lowered.alias("c")))
    fold = lambda start, f: F.aggregate("eigenvalues", F.lit(start), f)
    total, product = fold(0.0, lambda a, x: a + x), fold(1.0, lambda a, x: a * x)
    return out.select("id", "spd", (fx.sql_round(total, 6) + 0.0).alias("eigenvalue_sum"), (fx.sql_round(product, 4) + 0.0).alias("eigenvalue_product"))


def _young_sql() -> str:
    r = math.sqrt(2.0)
    n = ["x * x", "y * y", "z * z", *(f"{r!r}::DOUBLE * {a} * {b}" for a, b in ("xy", "xz", "yz"))]
    form = " + ".join(f"({n[i]}) * m{6 * i + j} * ({n[j]})" for i in range(6) for j in range(6))
    grid = (
        f"d AS (SELECT t, p, sin(theta) * cos(phi) AS x, sin(theta) * sin(phi) AS y, cos(theta) AS z FROM (SELECT CAST(id // 25 AS INTEGER) AS t, CAST(id % 25 AS INTEGER) AS p, (id // 25) * {math.pi / 12!r}::DOUBLE AS theta, (id % 25) * {2 * math.pi / 24!r}::DOUBLE AS phi FROM range(325) r(id)))"
    )
    show = ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in "xyz") + ", round(e, 6) AS \"E\", " + ", ".join(f"round({c} * e, 6) + 0.0::DOUBLE AS s{c}" for c in "xyz")
    return f"WITH {fx.STIFFNESS}, {_inverted('stiffness')}, {grid}, f AS (SELECT id, t, p, x, y, z, 1.0::DOUBLE / ({form}) AS e FROM x6, d) SELECT id, t, p, {show} FROM f"


@query("youngs_modulus", _young_sql())
def _young(spark, sf_dir):
    return fx.rounded(elastic.youngs_modulus(fx.stiffness(spark, sf_dir), elastic.direction_grid(spark, 13, 25).select("t", "p", "x", "y", "z")))
