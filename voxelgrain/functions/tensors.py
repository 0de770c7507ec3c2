"""Symmetric rank-2 and rank-4 tensors as array columns: notations, invariants, elastic constants.

A rank-2 tensor is ``array<double>`` of six: Mandel order xx, yy, zz, xy, xz, yz with shear times sqrt(2), or Voigt order
xx, yy, zz, yz, xz, xy. A rank-4 tensor is a row-major 6 x 6 ``array<double>`` of 36.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where Mandel order takes its components from in Voigt order.
VOIGT_TO_MANDEL = (0, 1, 2, 5, 4, 3)
ROOT2, ROOT_HALF = math.sqrt(2.0), math.sqrt(0.5)
MEASURES = ("von_mises", "hydrostatic", "deviatoric", "I_invariants", "J_invariants", "principal", "eigenvalues", "eigenvectors", "max_shear", "lode_angle")


def parts(t: Column, n: int = 6) -> list[Column]:
    return [F.get(t, i) for i in range(n)]


def _scaled(t: Column, shear: float, order: str) -> Column:
    c = parts(t)
    if order not in ("voigt", "mandel"):
        raise ValueError(f"order must be 'voigt' or 'mandel', not {order!r}")
    scaled = [c[i] * shear if i > 2 else c[i] for i in range(6)]
    return F.array(*[scaled[i] for i in (VOIGT_TO_MANDEL if order == "voigt" else range(6))])


def voigt_strain_to_mandel(t: Column, order: str = "voigt") -> Column:
    return _scaled(t, ROOT_HALF, order)


def voigt_stress_to_mandel(t: Column, order: str = "voigt") -> Column:
    return _scaled(t, ROOT2, order)


def mandel_to_voigt_strain(t: Column, order: str = "voigt") -> Column:
    return _scaled(t, ROOT2, order)


def mandel_to_voigt_stress(t: Column, order: str = "voigt") -> Column:
    return _scaled(t, ROOT_HALF, order)


def _rank4(c: Column, factor: float, order: str, convention: str) -> Column:
    """``reference`` scales the first three rows and columns; ``mandel`` the last three, as the notation defines."""
    if convention not in ("reference", "mandel"):
        raise ValueError(f"unknown convention {convention!r}")
    pick = VOIGT_TO_MANDEL if order == "voigt" else tuple(range(6))
    scaled = (lambda i: i < 3) if convention == "reference" else (lambda i: i >= 3)
    entries = []
    for i in pick:
        for j in pick:
            entry = F.get(c, 6 * i + j)
            for index in (j, i):
                if scaled(index):
                    entry = entry * factor
            entries.append(entry)
    return F.array(*entries)


def stiffness_voigt_to_mandel(c: Column, order: str = "voigt", convention: str = "reference") -> Column:
    return _rank4(c, ROOT2, order, convention)


def compliance_voigt_to_mandel(s: Column, order: str = "voigt", convention: str = "reference") -> Column:
    return _rank4(s, ROOT_HALF, order, convention)


def full_to_mandel(a: Column) -> Column:
    """From an array of three rows; the upper triangle counts."""
    at = lambda i, j: F.get(F.get(a, i), j)
    return F.array(at(0, 0), at(1, 1), at(2, 2), at(0, 1) * ROOT2, at(0, 2) * ROOT2, at(1, 2) * ROOT2)


def mandel_to_full(t: Column) -> Column:
    m = full_components(t)
    return F.array(*[F.array(*row) for row in m])


def full_components(t: Column) -> list[list[Column]]:
    xx, yy, zz, xy, xz, yz = parts(t)
    xy, xz, yz = xy * ROOT_HALF, xz * ROOT_HALF, yz * ROOT_HALF
    return [[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]


def iso_projection_kappa(t: Column) -> Column:
    a = parts(t)
    return (a[0] + a[1] + a[2]) / 3.0


def iso_projection_bulk(c: Column) -> Column:
    return sum((F.get(c, 6 * i + j) for i in range(3) for j in range(3)), F.lit(0.0)) / 9.0


def iso_projection_shear(c: Column) -> Column:
    trace = sum((F.get(c, 7 * i) for i in range(6)), F.lit(0.0))
    return (trace - 3.0 * iso_projection_bulk(c)) / 10.0


def isotropic_stiffness(bulk: Column, shear: Column) -> Column:
    """3 K P1 + 2 G P2 with P1 the projector on the identity."""
    entries = []
    for i in range(6):
        for j in range(6):
            entry = (3.0 * bulk - 2.0 * shear) * (1.0 / 3.0) if i < 3 and j < 3 else F.lit(0.0)
            entries.append(entry + 2.0 * shear if i == j else entry)
    return F.array(*entries)


def projector(which: int) -> list[float]:
    """Isotropic projectors P1 (``which`` 1) and P2, row-major 6 x 6."""
    one = [1.0 / 3.0 if i < 3 and j < 3 else 0.0 for i in range(6) for j in range(6)]
    return one if which == 1 else [float(k % 7 == 0) - v for k, v in enumerate(one)]


def elastic_constants(e: Column | None = None, nu: Column | None = None, g: Column | None = None, k: Column | None = None) -> Column:
    """Struct (E, nu, G, K) from any two; columns may be null by row, then the pair is chosen row by row.

    Order of preference: E with nu, E with K, E with G, K with G, K with nu, G with nu. Fewer than two, a modulus that
    isn't positive or a Poisson ratio outside (-1, 0.5) raises an error when the row is computed.
    """
    null = F.lit(None).cast("double")
    e, nu, g, k = (null if c is None else c.cast("double") for c in (e, nu, g, k))
    has = lambda *cs: F.lit(True) if not cs else cs[0].isNotNull() & has(*cs[1:])
    cases = [
        (has(e, nu), lambda: (e, nu)),
        (has(e, k), lambda: (e, (3.0 * k - e) / (6.0 * k))),
        (has(e, g), lambda: (e, e / (2.0 * g) - 1.0)),
        (has(k, g), lambda: (9.0 * k * g / (3.0 * k + g), 9.0 * k * g / (3.0 * k + g) / (2.0 * g) - 1.0)),
        (has(k, nu), lambda: (k * 3.0 * (1.0 - 2.0 * nu), nu)),
        (has(g, nu), lambda: (g * 2.0 * (1.0 + nu), nu)),
    ]
    young = ratio = None
    for test, make in cases:
        one, two = make()
        young = F.when(test, one) if young is None else young.when(test, one)
        ratio = F.when(test, two) if ratio is None else ratio.when(test, two)
    short = F.raise_error(F.lit("at least two elastic constants are needed")).cast("double")
    bad = F.when((F.coalesce(e, F.lit(1.0)) <= 0) | (F.coalesce(g, F.lit(1.0)) <= 0) | (F.coalesce(k, F.lit(1.0)) <= 0) | (F.coalesce(nu, F.lit(0.0)) <= -1) | (F.coalesce(nu, F.lit(0.0)) >= 0.5), F.raise_error(F.lit("elastic constants out of range")).cast("double"))
    young, ratio = F.coalesce(bad, young, short), F.coalesce(ratio, short)
    shear = F.coalesce(g, young / (2.0 * (1.0 + ratio)))
    bulk = F.coalesce(k, young / (3.0 * (1.0 - 2.0 * ratio)))
    return F.struct(young.alias("E"), ratio.alias("nu"), shear.alias("G"), bulk.alias("K"))


def _det3(m: list[list[Column]]) -> Column:
    return (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
        - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
        + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )


def hydrostatic(t: Column) -> Column:
    return iso_projection_kappa(t)


def deviatoric(t: Column) -> Column:
    c, p = parts(t), hydrostatic(t)
    return F.array(c[0] - p, c[1] - p, c[2] - p, *c[3:])


def von_mises(t: Column, convention: str = "reference") -> Column:
    """``reference`` takes the shear entries as they are; ``mandel`` as Mandel shear (half the squared weight)."""
    a, b, c, xy, xz, yz = parts(t)
    weight = {"reference": 6.0, "mandel": 3.0}[convention]
    return F.sqrt(0.5 * ((a - b) * (a - b) + (b - c) * (b - c) + (c - a) * (c - a) + weight * (xy * xy + xz * xz + yz * yz)))


def _shear_sum(t: Column, convention: str) -> Column:
    _, _, _, xy, xz, yz = parts(t)
    return (xy * xy + xz * xz + yz * yz) * {"reference": 1.0, "mandel": 0.5}[convention]


def i_invariants(t: Column, convention: str = "reference") -> Column:
    a, b, c, *_ = parts(t)
    return F.array(a + b + c, a * b + b * c + c * a - _shear_sum(t, convention), _det3(full_components(t)))


def j_invariants(t: Column, convention: str = "reference") -> Column:
    """J1 (zero), J2 and J3 of the deviator."""
    p = hydrostatic(t)
    a, b, c, *_ = parts(t)
    a, b, c = a - p, b - p, c - p
    m = full_components(t)
    m = [[a, m[0][1], m[0][2]], [m[1][0], b, m[1][2]], [m[2][0], m[2][1], c]]
    return F.array(a + b + c, 0.5 * (a * a + b * b + c * c) + _shear_sum(t, convention), _det3(m))


def principal(t: Column) -> Column:
    """Eigenvalues in ascending order, by the trigonometric solution of the cubic."""
    p = hydrostatic(t)
    m = full_components(t)
    for i in range(3):
        m[i] = [x - p if i == j else x for j, x in enumerate(m[i])]
    r2 = (m[0][0] * m[0][0] + m[1][1] * m[1][1] + m[2][2] * m[2][2] + 2.0 * (m[0][1] * m[0][1] + m[0][2] * m[0][2] + m[1][2] * m[1][2])) / 6.0
    r = F.sqrt(r2)
    ratio = F.when(r > 0, _det3(m) / (2.0 * r * r * r)).otherwise(F.lit(1.0))
    phi = F.acos(F.least(F.greatest(ratio, F.lit(-1.0)), F.lit(1.0))) / 3.0
    third = 2.0 * math.pi / 3.0
    return F.array(p + 2.0 * r * F.cos(phi + third), p + 2.0 * r * F.cos(phi - third), p + 2.0 * r * F.cos(phi))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _dot(a: Column, b: Column) -> Column:
    return sum((F.get(a, k) * F.get(b, k) for k in (1, 2)), F.get(a, 0) * F.get(b, 0))


def _cross(a: Column, b: Column) -> Column:
    at = lambda x, k: F.get(x, k % 3)
    return F.array(*[at(a, k + 1) * at(b, k + 2) - at(a, k + 2) * at(b, k + 1) for k in range(3)])


def _signed_unit(v: Column) -> Column:
    """The vector at unit length, its first component that isn't near zero positive."""
    size = F.sqrt(_dot(v, v))
    lead = F.coalesce(*[F.when(F.abs(F.get(v, k)) > 1e-9 * size, F.signum(F.get(v, k))) for k in range(3)], F.lit(1.0))
    return F.transform(v, lambda x: x * lead / size)


def eigenvectors(t: Column) -> Column:
    """Array of three rows whose columns are the unit eigenvectors, in the order of ``principal``.

    The vector of the eigenvalue that stands most apart is orthogonal to the rows of the shifted matrix; the other two turn
    the remaining plane. The first component of each that isn't near zero is positive; a multiple eigenvalue has any basis.
    """
    m = full_components(t)
    rows = F.array(*[F.array(*r) for r in m])

    def apart(own: Column) -> Column:
        a, l = own["a"], own["l"]
        alone = F.when(F.get(l, 2) - F.get(l, 1) >= F.get(l, 1) - F.get(l, 0), F.get(l, 2)).otherwise(F.get(l, 0))
        shifted = F.transform(a, lambda r, i: F.transform(r, lambda x, j: F.when(i == j, x - alone).otherwise(x)))
        return _let(shifted, lambda s: F.array_max(F.transform(F.array(*[F.array(F.lit(p), F.lit(q)) for p, q in ((0, 1), (0, 2), (1, 2))]), lambda pq: _let(_cross(F.get(s, F.get(pq, 0)), F.get(s, F.get(pq, 1))), lambda c: F.struct(_dot(c, c).alias("n"), c.alias("c"))))))

    def plane(own: Column, first: Column) -> Column:
        """The two others, the smaller eigenvalue's first, from a basis u, w of the plane across ``first``."""
        least = F.abs(F.get(first, 0)) < 0.6
        u = _signed_unit(_cross(first, F.array(F.when(least, 1.0).otherwise(0.0), F.when(least, 0.0).otherwise(1.0), F.lit(0.0))))

        def turn(uw: Column) -> Column:
            u, w = uw["u"], uw["w"]
            form = lambda p, q: _dot(p, F.transform(own["a"], lambda r: _dot(r, q)))
            angle = 0.5 * F.atan2(2.0 * form(u, w), form(u, u) - form(w, w))
            mixed = lambda a, b: F.zip_with(u, w, lambda x, y: x * a + y * b)
            return _let(angle, lambda f: F.array(mixed(-F.sin(f), F.cos(f)), mixed(F.cos(f), F.sin(f))))

        return _let(u, lambda v: _let(F.struct(v.alias("u"), _cross(first, v).alias("w")), turn))

    def vectors(own: Column) -> Column:
        top = F.get(own["l"], 2) - F.get(own["l"], 1) >= F.get(own["l"], 1) - F.get(own["l"], 0)
        isotropic = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
        scale = _dot(own["l"], own["l"])
        first = _let(apart(own), lambda best: F.when(best["n"] > 1e-24 * scale * scale, _signed_unit(best["c"])).otherwise(isotropic))
        return _let(first, lambda e: _let(plane(own, e), lambda o: F.when(top, F.array(F.get(o, 0), F.get(o, 1), e)).otherwise(F.array(e, F.get(o, 0), F.get(o, 1)))))

    own = F.struct(rows.alias("a"), principal(t).alias("l"))
    found = _let(own, lambda o: _let(vectors(o), lambda v: F.transform(v, _signed_unit)))
    return _let(found, lambda v: F.array(*[F.array(*[F.get(F.get(v, j), i) for j in range(3)]) for i in range(3)]))


def max_shear(t: Column) -> Column:
    values = principal(t)
    return (F.get(values, 2) - F.get(values, 0)) / 2.0


def lode_angle(t: Column, convention: str = "reference") -> Column:
    j = j_invariants(t, convention)
    floor = F.greatest(F.get(j, 1), F.lit(1e-12))
    argument = 1.5 * math.sqrt(3.0) * F.get(j, 2) / (floor * F.sqrt(floor))
    return F.acos(F.least(F.greatest(argument, F.lit(-1.0)), F.lit(1.0))) / 3.0


def rank2_measures(t: Column, measures: tuple[str, ...] | None = None, convention: str = "reference") -> dict[str, Column]:
    """Measures by name; by default von Mises, hydrostatic and deviatoric. Only what is asked for is returned."""
    make = {
        "von_mises": lambda: von_mises(t, convention), "hydrostatic": lambda: hydrostatic(t), "deviatoric": lambda: deviatoric(t),
        "I_invariants": lambda: i_invariants(t, convention), "J_invariants": lambda: j_invariants(t, convention), "principal": lambda: principal(t),
        "eigenvalues": lambda: principal(t), "eigenvectors": lambda: eigenvectors(t), "max_shear": lambda: max_shear(t), "lode_angle": lambda: lode_angle(t, convention),
    }
    wanted = measures or ("von_mises", "hydrostatic", "deviatoric")
    if unknown := [m for m in wanted if m not in make]:
        raise ValueError(f"unknown measures: {unknown}")
    return {m: make[m]() for m in wanted}
