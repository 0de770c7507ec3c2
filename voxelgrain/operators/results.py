"""Solver results as a long table keyed by microstructure, load case and time step, and dataset catalogs.

``results``: microstructure, load_case, time_step, quantity, point_id, value (array of doubles).
``catalog``: file_ord, path, shape (array of ints), and whatever payload columns the caller keeps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tensors import rank2_measures

_PATH = r"^/?(.*?)/(load[^/]*)/time_step(\d+)/(.+)$"


def parsed_paths(catalog: DataFrame, path: str = "path") -> DataFrame:
    """Catalog rows that are results, with microstructure, load_case, time_step and quantity taken from their path."""
    part = lambda k: F.regexp_extract(path, _PATH, k)
    return catalog.where(F.col(path).rlike(_PATH)).select("*", part(1).alias("microstructure"), part(2).alias("load_case"), part(3).cast("int").alias("time_step"), part(4).alias("quantity"))


def tree(catalog: DataFrame) -> DataFrame:
    """parent, name, shape of every dataset and group that leads to one (groups have no shape); empty groups don't appear."""
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    ups = catalog.select(segments.alias("s"), "shape").select("s", "shape", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("n"))
    parent = F.concat(F.lit("/"), F.array_join(F.slice("s", F.lit(1), F.col("n") - 1), "/"))
    return ups.select(parent.alias("parent"), F.get("s", F.col("n") - 1).alias("name"), F.when(F.col("n") == F.size("s"), F.col("shape")).alias("shape")).distinct()


def hierarchy_summary(results: DataFrame) -> DataFrame:
    """microstructure, load_cases, time_steps, quantities (those of the first step, sorted)."""
    cases = results.groupBy("microstructure").agg(F.countDistinct("load_case").alias("load_cases"))
    steps = results.groupBy("microstructure", "time_step").agg(F.collect_set("quantity").alias("q"))
    steps = steps.groupBy("microstructure").agg(F.count("*").alias("time_steps"), F.array_sort(F.min_by("q", "time_step")).alias("quantities"))
    return cases.join(steps, "microstructure")


def extract(results: DataFrame, quantities: Sequence[str] | None = None, microstructures: Sequence[str] | None = None, load_cases: Sequence[str] | None = None, time_steps: Sequence[int] | None = None) -> DataFrame:
    """Rows of the named items; an empty or missing list is no filter. Filters reach the scan and its partitions."""
    for column, wanted in (("quantity", quantities), ("microstructure", microstructures), ("load_case", load_cases), ("time_step", time_steps)):
        if wanted:
            results = results.where(F.col(column).isin(*wanted))
    return results


def stacked(results: DataFrame, value: str = "value") -> DataFrame:
    """microstructure, load_case, quantity, point_id, time_steps, values: each point's steps in numeric order."""
    pairs = F.array_sort(F.collect_list(F.struct("time_step", F.col(value).alias("v"))))
    return results.groupBy("microstructure", "load_case", "quantity", "point_id").agg(pairs.alias("p")).select(
        "microstructure", "load_case", "quantity", "point_id", F.transform("p", lambda x: x["time_step"]).alias("time_steps"), F.transform("p", lambda x: x["v"]).alias("values")
    )


def _as_array(c: Column, measure: str) -> Column:
    if measure == "eigenvectors":
        return F.flatten(c)  # by rows
    many = measure in ("deviatoric", "I_invariants", "J_invariants", "principal", "eigenvalues")
    return c if many else F.array(c)


def postprocess(results: DataFrame, quantities: Sequence[str], measures: Sequence[str] | None = None, convention: str = "reference") -> DataFrame:
    """Measures of the named rank-2 quantities as further results, named ``{quantity}_{measure}``."""
    wanted = rank2_measures(F.col("value"), tuple(measures) if measures else None, convention)
    made = F.array(*[F.struct(F.concat("quantity", F.lit(f"_{m}")).alias("quantity"), _as_array(c, m).alias("value")) for m, c in wanted.items()])
    rows = extract(results, quantities).where(F.size("value") == 6)
    keys = [c for c in results.columns if c not in ("quantity", "value")]
    return rows.select(*keys, F.explode(made).alias("_m")).select(*keys, "_m.quantity", "_m.value").select(*results.columns)


def merge(datasets: DataFrame, overwrite: bool = True, path: str = "path", order: str = "file_ord") -> DataFrame:
    """One row per path: of the last file that has it, or the first (``overwrite`` off)."""
    by = F.col(order).desc() if overwrite else F.col(order).asc()
    return datasets.withColumn("_nth", F.row_number().over(Window.partitionBy(path).orderBy(by))).where("_nth = 1").drop("_nth")


def append_missing(target: DataFrame, source: DataFrame, path: str = "path") -> DataFrame:
    """``target`` and the rows of ``source`` whose path it lacks."""
    return target.unionByName(source.join(target.select(path), path, "left_anti"))


def clashes(datasets: DataFrame, path: str = "path") -> DataFrame:
    """Paths that are a dataset in one place and a group in another."""
    trimmed = datasets.select(F.regexp_replace(path, "^/", "").alias("p")).distinct()
    segments = F.split("p", "/")
    groups = trimmed.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(segments) - 1, F.lit(1))), lambda n: F.when(n < F.size(segments), F.array_join(F.slice(segments, F.lit(1), n), "/")))).alias("p"))
    return trimmed.join(groups.where("p is not null").distinct(), "p", "left_semi").withColumnRenamed("p", path)


def time_of(path: Column | str, keyword: str = "time_step") -> Column:
    """Number after the keyword in a path, null without one."""
    found = F.regexp_extract(path, rf"{keyword}(\d*\.?\d+)", 1)
    return F.when(found != "", found.cast("double"))


def without_time(path: Column | str, keyword: str = "time_step") -> Column:
    """A path without its part that begins with the keyword."""
    return F.regexp_replace(path, rf"/{keyword}[^/]*", "")


def component_kind(shape: Column) -> Column:
    """Scalar, Vector, Tensor6 or Tensor by the last of four dimensions; null for what cannot be shown."""
    last = F.when(F.size(shape) == 3, F.lit(1)).when(F.size(shape) == 4, F.get(shape, 3))
    return F.when(last == 1, "Scalar").when(last == 3, "Vector").when(last == 6, "Tensor6").when(last == 9, "Tensor")


def subplot_layout(n: int) -> tuple[int, int]:
    """Rows and columns of a grid of ``n`` plots."""
    if n < 1:
        raise ValueError("there must be at least one plot")
    rows = 1
    while rows * rows < n:
        rows += 1
    return rows, -(-n // rows)
