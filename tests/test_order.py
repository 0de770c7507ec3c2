"""Order statistics and numbers over any values, and defined results for constant, singular and missing inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain.operators import elastic, fractions, order, tpms

INF, NAN = math.inf, math.nan


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(3)


def same(got, want):
    return [("nan" if math.isnan(x) else x) for x in got] == [("nan" if math.isnan(x) else x) for x in want]


@pytest.mark.parametrize(
    "values",
    [
        [1.0, 2.0, INF],
        [-1.5e308, 2.0, 3.0, 1.5e308],
        [-INF, -INF, 0.0, 5e-324, -5e-324, INF],
        [3.0, NAN, 1.0, 2.0, NAN],
        [7.0] * 50,
        [0.1 + k * 1e-17 for k in range(40)] + [-0.1, 1e300],
    ],
)
def test_order_statistics_end_for_any_values(spark, values):
    places = list(range(len(values)))
    want = sorted(values, key=lambda v: (math.isnan(v), v))
    assert same(order.order_statistics(column(spark, [*values, None]), "v", places), want)


def test_order_statistics_take_four_passes(spark):
    frame = column(spark, [math.tan(k) for k in range(500)])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("statistics", "")
    order.order_statistics(frame, "v", [3, 250, 499])
    jobs = len(tracker.getJobIdsForGroup("statistics"))
    spark.sparkContext.setJobGroup("other", "")
    assert jobs <= 1 + 2 * 4 + 2


def test_places_beyond_the_values(spark):
    for place in (3, -1):
        with pytest.raises(IndexError):
            order.order_statistics(column(spark, [1.0, 2.0, None]), "v", [place])
    assert math.copysign(1, order.order_statistics(column(spark, [-0.0]), "v", [0])[0]) == 1


def test_quantiles_between_odd_neighbours(spark):
    at = lambda values, q: fractions.quantile(column(spark, values), "v", q).first()[0]
    assert at([1.0, 2.0, 3.0, NAN], 0.5) == 2.5 and math.isnan(at([1.0, NAN], 1.0))
    assert at([-1.5e308, 1.5e308], 0.5) == 0.0 and at([1.0, INF], 0.5) == INF and at([-INF, 1.0], 0.5) == -INF
    assert math.isnan(at([-INF, INF], 0.5)) and at([4.0, 4.0], 0.3) == 4.0 and at([1.0, INF], 0.0) == 1.0


def range_sizes(frame, keys):
    dealt = order.dealt_by_range(order._written(frame)[0], keys)
    return sorted(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect())


def test_ranges_stay_even_on_few_valued_keys(spark):
    few = spark.range(1_000_000).select((F.col("id") % 100).alias("a"), F.lit(1).alias("b"))
    sizes = range_sizes(few, ["a"])
    assert len(sizes) >= 64 and sizes[-1] < 3 * np.median(sizes) and sum(sizes) == 1_000_000
    hot = spark.range(300_000).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("a"))
    sizes = range_sizes(hot, ["a"])
    assert len(sizes) >= 30 and sizes[-1] < 3 * np.median(sizes)


def test_numbers_of_one_key_and_of_few(spark):
    frame = spark.range(60_000).select(F.when(F.col("id") % 4 > 0, 5).otherwise(F.col("id") % 7).alias("a"), F.lit("x").alias("_tie2"))
    got = order.numbered(frame, ["a"], "n", 3).groupBy("a").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count_distinct("n").alias("n")).orderBy("a").collect()
    start = 3
    for r in got:
        assert (r["low"], r["high"]) == (start, start + r["n"] - 1)
        start += r["n"]
    assert start == 60_003


def test_running_sums_with_negative_and_null_sizes(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), int(s)) for k, s in zip(rng.permutation(30_000), rng.integers(-9, 9, 30_000))] + [(30_000, None)]
    got = order.running_total(spark.createDataFrame(rows, "k int, s int"), ["k"], F.col("s"), "t").orderBy("k").collect()
    sizes = [s or 0 for _, s in sorted(rows)]
    assert [r["t"] for r in got] == np.cumsum(sizes).tolist()
    empty = spark.createDataFrame([], "k int, s int")
    assert order.running_total(empty, ["k"], F.col("s"), "t").count() == 0 and order.numbered(empty, ["k"], "n").count() == 0


def test_constant_and_odd_columns_have_results(spark):
    values = lambda df: sorted((r[0] for r in df.collect()), key=str)
    flat = column(spark, [3.0, 3.0, None])
    assert values(tpms.normalised(flat, "v")) == [0.0, 0.0, None] and values(fractions.standardised(flat, "v")) == [0.0, 0.0, None]
    assert [tuple(r) for r in fractions.histogram(flat, "v", 8).collect()] == [(0, 2)]
    wide = column(spark, [-1.5e308, 0.0, 1.5e308, INF, -INF])
    assert values(tpms.normalised(wide, "v")) == [0.0, 0.0, 0.5, 1.0, 1.0]
    odd = column(spark, [1.0, 2.0, 3.0, 4.0, INF, -INF, NAN, None])
    assert sorted(tuple(r) for r in fractions.histogram(odd, "v", 3).collect()) == [(0, 2), (1, 1), (2, 3)]
    assert all(math.isnan(v) for v in values(fractions.standardised(column(spark, [1.0, NAN]), "v")))
    for frame in (flat.where("v is null"), flat.limit(0)):
        assert fractions.histogram(frame, "v", 3).count() == 0 and fractions.quantile(frame, "v", 0.5).first()[0] is None


def test_singular_and_missing_tensors_have_results(spark):
    eye, zero = np.eye(6).ravel().tolist(), [0.0] * 36
    odd = [None, [None] * 36, [1.0] * 5, [INF] * 36, zero]
    df = spark.createDataFrame([(0, eye, 0.5), *[(k + 1, c, 0.5) for k, c in enumerate(odd)]], "id int, c array<double>, fraction double")
    assert {r["id"]: r["s"] for r in elastic.inverse(df).collect()} == {0: eye, **{k: None for k in range(1, 6)}}
    spd = {r["id"]: (r["spd"], r["eigenvalues"]) for r in elastic.definiteness(df).collect()}
    assert spd[0] == (True, [1.0] * 6) and spd[5] == (False, [0.0] * 6) and all(spd[k] == (None, None) for k in range(1, 5))
    tiny = spark.createDataFrame([(0, [x * 1e-200 for x in eye], 1.0)], df.schema)
    assert elastic.inverse(tiny).first()["s"][0] == pytest.approx(1e200)
    both = df.where("id in (0, 5)")
    assert elastic.reuss_bound(both).first()["c"] is None and elastic.reuss_bound(df.where("id = 0").withColumn("fraction", F.lit(1.0))).first()["c"] == eye
    assert elastic.reuss_bound(both.withColumn("fraction", F.col("fraction") * (F.col("id") == 0).cast("int") * 2)).first()["c"] == eye
    young = elastic.youngs_modulus(both, elastic.direction_grid(spark, 3, 3)).groupBy("id").agg(F.count("E").alias("n")).collect()
    assert {r["id"]: r["n"] for r in young} == {0: 9, 5: 0}
