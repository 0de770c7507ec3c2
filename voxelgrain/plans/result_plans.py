"""Queries over solver results and dataset catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results as rs
from ..operators.grids import fill_grid, flip_vectors
from . import fixtures as fx
from .fixtures import query


@query(
    "hierarchy_summary",
    f"WITH {fx.RESULTS}, f AS (SELECT microstructure, min(time_step) AS first FROM results GROUP BY 1) SELECT microstructure, count(DISTINCT load_case) AS load_cases, count(DISTINCT time_step) AS time_steps, "
    "list_sort(list(DISTINCT quantity) FILTER (WHERE time_step = first)) AS quantities FROM results JOIN f USING (microstructure) GROUP BY microstructure",
)
def _summary(spark, sf_dir):
    return rs.hierarchy_summary(fx.results(spark, sf_dir))


@query("extract_results", f"WITH {fx.RESULTS} SELECT * FROM results WHERE quantity = 'stress' AND microstructure IN ('click', 'view', 'purchase') AND time_step IN (1, 2, 3)")
def _extract(spark, sf_dir):
    return rs.extract(fx.results(spark, sf_dir), ["stress"], ["click", "view", "purchase"], [], [1, 2, 3])


@query(
    "stacked_results",
    "WITH " + fx.RESULTS + " SELECT microstructure, load_case, quantity, list(time_step ORDER BY time_step) AS time_steps, list(value ORDER BY time_step) AS values FROM results GROUP BY ALL",
)
def _stacked(spark, sf_dir):
    return rs.stacked(fx.results(spark, sf_dir).withColumn("point_id", F.lit(0))).drop("point_id")


_PH = "(t1 + t2 + t3) / 3"


@query(
    "postprocess_results",
    f"WITH {fx.TENSORS} SELECT id AS point_id, 'stress_hydrostatic' AS quantity, [round({_PH}, 6) + 0.0::DOUBLE] AS value FROM tensors UNION ALL "
    f"SELECT id, 'stress_von_mises', [round(sqrt(0.5::DOUBLE * ((t1 - t2) * (t1 - t2) + (t2 - t3) * (t2 - t3) + (t3 - t1) * (t3 - t1) + 6 * (t4 * t4 + t5 * t5 + t6 * t6))), 6) + 0.0::DOUBLE] FROM tensors UNION ALL "
    f"SELECT id, 'stress_deviatoric', [" + ", ".join(f"round(t{c} - {_PH}, 6) + 0.0::DOUBLE" for c in (1, 2, 3)) + ", " + ", ".join(f"round(t{c}, 6) + 0.0::DOUBLE" for c in (4, 5, 6)) + "] FROM tensors",
)
def _postprocess(spark, sf_dir):
    rows = fx.tensors(spark, sf_dir).select(F.col("id").alias("point_id"), F.lit("stress").alias("quantity"), F.col("t").alias("value"))
    return fx.rounded(rs.postprocess(rows, ["stress"]))


def _datasets(spark, sf_dir):
    """Line items as datasets: the order is the path, the line number the file."""
    return fx.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("/o/"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_linenumber").alias("file_ord"), F.col("l_partkey").alias("part"))


for _name, _over, _by in (("merge_last_wins", True, "DESC"), ("merge_first_wins", False, "ASC")):

    def _merge(spark, sf_dir, over=_over):
        unique = rs.merge(_datasets(spark, sf_dir).withColumn("_key", F.concat_ws("#", "path", F.col("file_ord").cast("string"))), True, "_key", "part").drop("_key")
        return rs.merge(unique, over)

    query(
        _name,
        "SELECT '/o/' || l_orderkey AS path, l_linenumber AS file_ord, max(l_partkey) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber "
        f"QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber {_by}) = 1",
    )(_merge)


@query("append_missing", "SELECT l_orderkey AS path, CAST(1 AS INTEGER) AS file FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _append(spark, sf_dir):
    there = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path")).distinct().withColumn("file", F.lit(1))
    more = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.lit(2).alias("file"))
    return rs.append_missing(there, more)


_PATHS = f"{fx.RESULTS}, p AS (SELECT '/' || microstructure || '/' || load_case || '/time_step' || time_step || '/' || quantity AS path, point_id FROM results)"


def _paths(spark, sf_dir):
    r = fx.results(spark, sf_dir)
    return r.select(F.concat(F.lit("/"), "microstructure", F.lit("/"), "load_case", F.lit("/time_step"), F.col("time_step").cast("string"), F.lit("/"), "quantity").alias("path"), "point_id")


@query("time_regex", f"WITH {_PATHS} SELECT point_id, CAST(regexp_extract(path, 'time_step(\\d*\\.?\\d+)', 1) AS DOUBLE) AS time, regexp_replace(path, '/time_step[^/]*', '') AS name FROM p")
def _time(spark, sf_dir):
    return _paths(spark, sf_dir).select("point_id", rs.time_of("path").alias("time"), rs.without_time("path").alias("name"))


@query("parse_hierarchy", f"WITH {fx.RESULTS} SELECT point_id, microstructure, load_case, time_step, quantity FROM results")
def _parse(spark, sf_dir):
    return rs.parsed_paths(_paths(spark, sf_dir)).select("point_id", "microstructure", "load_case", "time_step", "quantity")


@query(
    "dataset_tree",
    f"WITH {_PATHS}, s AS (SELECT string_split(path[2:], '/') AS s FROM p), u AS (SELECT s, unnest(range(1, 5)) AS n FROM s) SELECT DISTINCT '/' || array_to_string(s[1:n - 1], '/') AS parent, s[n] AS name, n = 4 AS leaf FROM u",
)
def _tree(spark, sf_dir):
    return rs.tree(_paths(spark, sf_dir).withColumn("shape", F.array(F.lit(1)))).select("parent", "name", F.col("shape").isNotNull().alias("leaf"))


@query("numeric_step_sort", f"WITH {fx.RESULTS} SELECT DISTINCT 'time_step' || time_step AS name, CAST(rank AS INTEGER) AS rank FROM (SELECT time_step, dense_rank() OVER (ORDER BY time_step) - 1 AS rank FROM results)")
def _steps(spark, sf_dir):
    from pyspark.sql import Window

    steps = fx.results(spark, sf_dir).select("time_step").distinct()
    return steps.select(F.concat(F.lit("time_step"), F.col("time_step").cast("string")).alias("name"), (F.row_number().over(Window.orderBy("time_step")) - 1).alias("rank"))


@query(
    "component_filter",
    "SELECT l_orderkey AS id, l_linenumber AS n, CASE (l_partkey % 12) WHEN 1 THEN 'Scalar' WHEN 3 THEN 'Vector' WHEN 6 THEN 'Tensor6' WHEN 9 THEN 'Tensor' END AS kind FROM lineitem WHERE l_partkey % 12 IN (1, 3, 6, 9)",
)
def _components(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.array(F.lit(8), F.lit(8), F.lit(8), (F.col("l_partkey") % 12).cast("int")).alias("shape"))
    return rows.select("id", "n", rs.component_kind(F.col("shape")).alias("kind")).where("kind is not null")


@query("vector_flip", "SELECT vec_id, [round(embedding[3]::DOUBLE, 6), round(embedding[2]::DOUBLE, 6), round(embedding[1]::DOUBLE, 6)] AS v FROM embeddings")
def _flip(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", flip_vectors(F.array(*[fx.sql_round_signed(fx.component(c), 6) for c in range(3)])).alias("v"))


@query("fill_grid", f"WITH {fx.grid_sql(20)}, s AS (SELECT CAST(s_suppkey // 400 AS INTEGER) AS i, CAST((s_suppkey // 20) % 20 AS INTEGER) AS j, CAST(s_suppkey % 20 AS INTEGER) AS k, s_nationkey AS v FROM supplier) SELECT g.i, g.j, g.k, coalesce(v, -1) AS v FROM g LEFT JOIN s ON g.i = s.i AND g.j = s.j AND g.k = s.k")
def _fill(spark, sf_dir):
    key = F.col("s_suppkey")
    at = [F.floor(key / 400).cast("int").alias("i"), F.pmod(F.floor(key / 20), F.lit(20)).cast("int").alias("j"), F.pmod(key, F.lit(20)).cast("int").alias("k")]
    return fill_grid(spark, (20, 20, 20), fx.table(spark, sf_dir, "supplier").select(*at, F.col("s_nationkey").alias("v")), "v", -1)
