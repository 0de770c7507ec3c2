"""Tensor notations, invariants and elastic measures against NumPy."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxelgrain.functions import tensors as tn
from voxelgrain.operators import elastic

RNG = np.random.default_rng(7)
T = RNG.normal(size=(20, 6))


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, list(map(float, t))) for i, t in enumerate(T)], "id int, t array<double>").cache()


@pytest.fixture(scope="module")
def stiff(spark):
    a = RNG.normal(size=(6, 6, 6))
    c = a @ a.transpose(0, 2, 1) + np.eye(6)
    return spark.createDataFrame([(i, 1 / 6, list(map(float, x.ravel()))) for i, x in enumerate(c)], "id int, fraction double, c array<double>").cache(), c


def column(frame, c):
    return np.array([r[0] for r in frame.orderBy("id").select(c).collect()])


def full():
    s = math.sqrt(0.5)
    return np.array([[[a, d * s, e * s], [d * s, b, f * s], [e * s, f * s, c]] for a, b, c, d, e, f in T])


def test_round_trips(frame):
    t = F.col("t")
    for there, back in ((tn.voigt_strain_to_mandel, tn.mandel_to_voigt_strain), (tn.voigt_stress_to_mandel, tn.mandel_to_voigt_stress)):
        assert np.allclose(column(frame, back(there(t))), T)
        assert np.allclose(column(frame, back(there(t, "mandel"), "mandel")), T)
    assert np.allclose(column(frame, tn.full_to_mandel(tn.mandel_to_full(t))), T)
    with pytest.raises(ValueError):
        tn.voigt_strain_to_mandel(t, "other")


def test_invariants_and_eigenvalues(frame):
    m = full()
    t = F.col("t")
    values = np.linalg.eigvalsh(m)
    assert np.allclose(column(frame, tn.principal(t)), values, atol=1e-9)
    assert np.allclose(column(frame, tn.max_shear(t)), (values[:, 2] - values[:, 0]) / 2)
    dev = m - np.eye(3) * (np.trace(m, axis1=1, axis2=2) / 3)[:, None, None]
    assert np.allclose(column(frame, tn.i_invariants(t))[:, 2], np.linalg.det(m))
    j = column(frame, tn.j_invariants(t, "mandel"))
    assert np.allclose(j[:, 1], 0.5 * (dev * dev).sum(axis=(1, 2))) and np.allclose(j[:, 2], np.linalg.det(dev)) and np.allclose(j[:, 0], 0)
    assert np.allclose(column(frame, tn.von_mises(t, "mandel")), np.sqrt(1.5 * (dev * dev).sum(axis=(1, 2))))
    s = values - values.mean(axis=1, keepdims=True)
    cos3 = 1.5 * math.sqrt(3) * s.prod(axis=1) / (0.5 * (s * s).sum(axis=1)) ** 1.5
    assert np.allclose(column(frame, tn.lode_angle(t, "mandel")), np.arccos(np.clip(cos3, -1, 1)) / 3, atol=1e-6)


def test_reference_convention_takes_shear_as_it_is(spark):
    shear = spark.createDataFrame([(0, [0.0, 0.0, 0.0, math.sqrt(2.0), 0.0, 0.0])], "id int, t array<double>")
    assert abs(column(shear, tn.von_mises(F.col("t")))[0] - math.sqrt(6)) < 1e-12
    assert abs(column(shear, tn.von_mises(F.col("t"), "mandel"))[0] - math.sqrt(3)) < 1e-12


def test_measures_are_only_what_is_asked(frame):
    assert list(tn.rank2_measures(F.col("t"), ("lode_angle",))) == ["lode_angle"]
    assert set(tn.rank2_measures(F.col("t"))) == {"von_mises", "hydrostatic", "deviatoric"}
    assert set(tn.rank2_measures(F.col("t"), tn.MEASURES)) == set(tn.MEASURES)
    with pytest.raises(ValueError):
        tn.rank2_measures(F.col("t"), ("size",))


def test_hydrostatic_tensor_has_equal_eigenvalues(spark):
    df = spark.createDataFrame([(0, [2.0, 2.0, 2.0, 0.0, 0.0, 0.0])], "id int, t array<double>")
    assert column(df, tn.principal(F.col("t")))[0].tolist() == [2.0, 2.0, 2.0]


def test_stiffness_conventions(spark):
    c = spark.createDataFrame([(0, [float(3 * (i < 3 and j < 3) * (i == j) + (i < 3 and j < 3 and i != j) + (i == j and i > 2)) for i in range(6) for j in range(6)])], "id int, c array<double>")
    textbook = column(c, tn.stiffness_voigt_to_mandel(F.col("c"), convention="mandel"))[0].reshape(6, 6)
    assert np.allclose(np.diag(textbook), [3, 3, 3, 2, 2, 2])
    assert np.allclose(np.diag(column(c, tn.stiffness_voigt_to_mandel(F.col("c")))[0].reshape(6, 6)), [6, 6, 6, 1, 1, 1])
    with pytest.raises(ValueError):
        tn.stiffness_voigt_to_mandel(F.col("c"), convention="none")


def test_isotropic_projections(spark):
    df = spark.createDataFrame([(0, 5.0, 2.0)], "id int, k double, g double")
    c = df.select("id", tn.isotropic_stiffness(F.col("k"), F.col("g")).alias("c"))
    assert c.select(tn.iso_projection_bulk(F.col("c")), tn.iso_projection_shear(F.col("c"))).first()[:] == pytest.approx((5.0, 2.0))
    p1, p2 = (np.array(tn.projector(w)).reshape(6, 6) for w in (1, 2))
    assert np.allclose(p1 @ p1, p1) and np.allclose(p1 @ p2, 0) and np.allclose(p1 + p2, np.eye(6))
    assert np.allclose(column(c, F.col("c"))[0].reshape(6, 6), 15 * p1 + 4 * p2)


@pytest.mark.parametrize("pair", [("e", "nu"), ("e", "k"), ("e", "g"), ("k", "g"), ("k", "nu"), ("g", "nu")])
def test_elastic_constants_from_any_two(spark, pair):
    e, nu = 210.0, 0.3
    known = {"e": e, "nu": nu, "g": e / (2 * (1 + nu)), "k": e / (3 * (1 - 2 * nu))}
    got = spark.range(1).select(tn.elastic_constants(**{p: F.lit(known[p]) for p in pair}).alias("m")).first()["m"]
    assert [got[x] for x in ("E", "nu", "G", "K")] == pytest.approx([known[x] for x in ("e", "nu", "g", "k")])


@pytest.mark.parametrize("bad", [{"e": 1.0}, {"e": -1.0, "nu": 0.2}, {"e": 1.0, "nu": 0.5}, {"k": 0.0, "g": 1.0}])
def test_elastic_constants_reject(spark, bad):
    with pytest.raises(PySparkException):
        spark.range(1).select(tn.elastic_constants(**{k: F.lit(v) for k, v in bad.items()}).alias("m")).collect()


def test_bounds(stiff):
    frame, c = stiff
    upper = np.array(elastic.voigt_bound(frame).first()["c"]).reshape(6, 6)
    lower = np.array(elastic.reuss_bound(frame).first()["c"]).reshape(6, 6)
    assert np.allclose(upper, c.mean(axis=0)) and np.allclose(lower, np.linalg.inv(np.linalg.inv(c).mean(axis=0)))
    assert (np.linalg.eigvalsh(upper - lower) > -1e-9).all()


def test_definiteness(spark, stiff):
    frame, c = stiff
    got = elastic.definiteness(frame).orderBy("id").collect()
    assert all(r["spd"] for r in got) and np.allclose([r["eigenvalues"] for r in got], np.linalg.eigvalsh(c))
    skew = np.eye(6)
    skew[0, 1] = 0.1
    bad = spark.createDataFrame([(0, list(map(float, skew.ravel()))), (1, list(map(float, (-np.eye(6)).ravel())))], "id int, c array<double>")
    assert [r["spd"] for r in elastic.definiteness(bad).collect()] == [False, False]


def test_isotropic_modulus_is_constant(spark):
    e, nu = 10.0, 0.25
    k, g = e / (3 * (1 - 2 * nu)), e / (2 * (1 + nu))
    c = spark.range(1).select(F.lit(0).alias("id"), tn.isotropic_stiffness(F.lit(k), F.lit(g)).alias("c"))
    out = elastic.youngs_modulus(c, elastic.direction_grid(spark, 9, 17).select("t", "p", "x", "y", "z"))
    low, high, n = out.agg(F.min("E"), F.max("E"), F.count("*")).first()
    assert n == 153 and abs(low - e) < 1e-9 and abs(high - e) < 1e-9


def test_rounding_next_to_halves_is_that_of_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from voxelgrain.plans import fixtures as fx

    # halves of the sixth digit, as differences of nine-digit numbers make them: just above, below or on them
    values = spark.range(40_000).select(((F.col("id") - 20_000) * 2 + 1).cast("double").alias("n")).select((F.col("n") / 2e6).alias("x"), (F.col("n") / 2e6 + F.col("n") / 1e9 - F.col("n") / 1e9).alias("y"))
    held = values.toPandas()  # noqa: F841
    own = values.select("x", "y", *[fx.sql_round(c, 6).alias(f"r{c}") for c in "xy"])
    want = duckdb.sql("SELECT x, y, round(x, 6) AS rx, round(y, 6) AS ry FROM held").fetchall()
    assert sorted(map(tuple, own.collect())) == sorted(want)
    assert sum(a != b for a, b in zip(*[[r[0] for r in values.orderBy("x").select(c).collect()] for c in (F.round("y", 6), fx.sql_round("y", 6))], strict=True)) > 0
