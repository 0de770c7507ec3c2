"""Views that turn the driver's tables into inputs of this engine, as DataFrames and as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.grids import voxel_grid
from ..operators.raster import label_nearest_seed
from ..session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}
#: Voxels per axis of registered grid queries.
FIELD, LABELS = 32, 16


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL."""

    def add(make: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return make(spark, sf_dir)

        REGISTRY[name] = (run, sql)
        return make

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def component(c: int) -> Column:
    return F.get(F.col("embedding"), c).cast("double")


def sql_round(c: Column | str, digits: int) -> Column:
    """``round`` of SQL's doubles: the nearest whole number of the scaled value, halves away from zero. Spark's own rounds the
    decimal digits that a double is printed with, which parts the two where the scaled value lies next to a half."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def sql_round_signed(c: Column | str, digits: int) -> Column:
    """``sql_round`` with SQL's minus zero, which negative numbers round to. Only for results to which no zero is added."""
    c = F.col(c) if isinstance(c, str) else c
    return F.signum(c) * sql_round(F.abs(c), digits)


def sql_round_positive(c: Column | str, digits: int) -> Column:
    """``sql_round`` of numbers that are not negative, by remainders: for many rows, as Spark's own goes through decimals."""
    x = (F.col(c) if isinstance(c, str) else c) * F.lit(10.0**digits)
    rest = x % F.lit(1.0)
    whole = x - rest + F.when(rest >= 0.5, 1.0).otherwise(0.0)
    return F.when(x < F.lit(2.0**52), whole).otherwise(x) / F.lit(10.0**digits)


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as seeds in the unit box: fractional parts of four times the first three components."""
    fraction = lambda c: sql_round(4 * component(c) - F.floor(4 * component(c)), 9)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("seed_id"), *[fraction(c).alias(n) for c, n in enumerate("xyz")])


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, microstructure, t: the first six components as a rank-2 tensor."""
    t = F.array(*[sql_round(component(c), 9) for c in range(6)])
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("microstructure"), t.alias("t"))


def stiffness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, c: A A^T + I of the first 36 components as a 6 x 6 matrix A."""
    a = [sql_round(component(c), 6) for c in range(36)]
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(*a).alias("a"))
    at = lambda r, c: F.get("a", 6 * r + c)
    entries = []
    for r in range(6):
        for s in range(6):
            total = at(r, 0) * at(s, 0)
            for c in range(1, 6):
                total = total + at(r, c) * at(s, c)
            entries.append(sql_round(total + (1.0 if r == s else 0.0), 6))
    return rows.select("id", F.array(*entries).alias("c"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as solver results: steps numbered by time for each event type and user."""
    order = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("microstructure"), F.concat(F.lit("load"), F.col("user_id").cast("string")).alias("load_case"), F.row_number().over(order).alias("time_step"),
        F.when(F.pmod("event_id", F.lit(3)) == 0, "strain").otherwise("stress").alias("quantity"), F.col("event_id").alias("point_id"), "value",
    )


def labels(spark: SparkSession, sf_dir: str, n: int = LABELS) -> DataFrame:
    """The label image of all seeds on an n x n x n grid."""
    shape = (n, n, n)
    return label_nearest_seed(voxel_grid(spark, shape), seeds(spark, sf_dir), shape)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded (and minus zero made zero), arrays of doubles entry by entry."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "double":
            c = sql_round(c, digits) + F.lit(0.0)
        elif kind == "array<double>":
            c = F.transform(c, lambda x: sql_round(x, digits) + F.lit(0.0))
        columns.append(c.alias(name))
    return df.select(*columns)


SEEDS = "seeds AS (SELECT CAST(vec_id AS INTEGER) AS seed_id, " + ", ".join(f"round(4 * embedding[{c}]::DOUBLE - floor(4 * embedding[{c}]::DOUBLE), 9) AS {n}" for c, n in zip((1, 2, 3), "xyz", strict=True)) + " FROM embeddings)"
TENSORS = "tensors AS (SELECT vec_id AS id, label AS microstructure, " + ", ".join(f"round(embedding[{c}]::DOUBLE, 9) AS t{c}" for c in range(1, 7)) + " FROM embeddings)"
RESULTS = (
    "results AS (SELECT event_type AS microstructure, 'load' || user_id AS load_case, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS INTEGER) AS time_step, "
    "CASE WHEN event_id % 3 = 0 THEN 'strain' ELSE 'stress' END AS quantity, event_id AS point_id, value FROM events)"
)


def _stiffness_sql() -> str:
    a = ", ".join(f"round(embedding[{c + 1}]::DOUBLE, 6) AS a{c}" for c in range(36))
    entries = ", ".join("round(" + " + ".join(f"a{6 * r + c} * a{6 * s + c}" for c in range(6)) + f" + {1.0 if r == s else 0.0}::DOUBLE, 6)" for r in range(6) for s in range(6))
    return f"stiffness AS (SELECT id, [{entries}] AS c FROM (SELECT vec_id AS id, {a} FROM embeddings))"


STIFFNESS = _stiffness_sql()


def grid_sql(n: int) -> str:
    return f"g AS (SELECT CAST(id // {n * n} AS INTEGER) AS i, CAST((id // {n}) % {n} AS INTEGER) AS j, CAST(id % {n} AS INTEGER) AS k FROM range({n**3}) t(id))"


def wrap_sql(d: str, half: str = "0.5::DOUBLE", whole: str = "1") -> str:
    return f"(CASE WHEN {d} > {half} THEN {d} - {whole} WHEN {d} < -{half} THEN {d} + {whole} ELSE {d} END)"


def labels_sql(n: int = LABELS) -> str:
    """CTEs seeds, g and lab (i, j, k, label)."""
    d = [wrap_sql(f"(({i} + 0.5::DOUBLE) / {n} - {x})") for i, x in zip("ijk", "xyz", strict=True)]
    pairs = f"SELECT i, j, k, seed_id, {d[0]} AS dx, {d[1]} AS dy, {d[2]} AS dz FROM g CROSS JOIN seeds"
    best = f"SELECT i, j, k, min({{'d': round(dx * dx + dy * dy + dz * dz, 9), 's': seed_id}}).s AS label FROM ({pairs}) GROUP BY i, j, k"
    return f"{SEEDS}, {grid_sql(n)}, lab AS ({best})"
