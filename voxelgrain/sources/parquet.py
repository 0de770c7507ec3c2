"""The native format: Parquet tables of images, seeds, composite voxels, grain boundaries and results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grids import permute_axes
from ..operators.results import extract

SEEDS = "seed_id int, x double, y double, z double, frame array<array<double>>"
COMBO = "bi int, bj int, bk int, elem long, coarse int, phases array<struct<material: int, fraction: double>>, normal array<double>, fine array<int>"
HEADER = "image_id string, nx int, ny int, nz int, lx double, ly double, lz double, metadata map<string, string>"


def write_image(voxels: DataFrame, path: str, image_id: str, shape, lengths=(1.0, 1.0, 1.0), metadata: dict[str, str] | None = None, order: str = "zyx") -> None:
    """An image of this id replaces what is there; slabs of constant first index keep row groups together.

    The header is its own table; it wins over equal keys of the metadata.
    """
    spark = voxels.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    out = permute_axes(voxels, order).withColumn("image_id", F.lit(image_id))
    out.repartitionByRange(F.col("i")).sortWithinPartitions("i", "j", "k").write.mode("overwrite").partitionBy("image_id").option("compression", "zstd").parquet(f"{path}/voxels")
    meta = {k: v for k, v in (metadata or {}).items() if k not in ("permute_order", "L")} | {"permute_order": order, "L": json.dumps(list(map(float, lengths)))}
    header = spark.createDataFrame([(image_id, *map(int, shape), *map(float, lengths), {k: str(v) for k, v in meta.items()})], HEADER)
    header.write.mode("overwrite").partitionBy("image_id").parquet(f"{path}/images")


def read_image(spark: SparkSession, path: str, image_id: str) -> tuple[DataFrame, dict]:
    """Voxels in xyz order and the header; ValueError for an unknown image or order."""
    header = spark.read.parquet(f"{path}/images").where(F.col("image_id") == image_id).first()
    if header is None:
        raise ValueError(f"no image {image_id!r} in {path}")
    order = header["metadata"].get("permute_order", "zyx")
    voxels = spark.read.parquet(f"{path}/voxels").where(F.col("image_id") == image_id).drop("image_id")
    return permute_axes(voxels, order), {"shape": (header["nx"], header["ny"], header["nz"]), "lengths": (header["lx"], header["ly"], header["lz"]), "metadata": header["metadata"]}


def write_seeds(seeds: DataFrame, path: str, group: str, lengths) -> None:
    out = seeds if "frame" in seeds.columns else seeds.withColumn("frame", F.lit(None).cast("array<array<double>>"))
    out = out.select("seed_id", "x", "y", "z", "frame", F.array(*[F.lit(float(v)) for v in lengths]).alias("lengths"))
    out.write.mode("overwrite").parquet(f"{path}/{group}")


def read_seeds(spark: SparkSession, path: str, group: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/{group}")
    except AnalysisException as error:
        raise ValueError(f"no seeds {group!r} in {path}") from error


def write_combo(combo: DataFrame, path: str, group: str, fine: DataFrame | None = None) -> None:
    """Composite voxels with arrays and nulls as they are, and the fine image (i, j, k, label), if given; the group is
    replaced."""
    combo.write.mode("overwrite").parquet(f"{path}/{group}")
    if fine is not None:
        fine.select("i", "j", "k", "label").repartitionByRange("i").sortWithinPartitions("i", "j", "k").write.mode("overwrite").parquet(f"{path}/{group}_fine")


def padded_records(combo: DataFrame) -> DataFrame:
    """One record of fixed width for each block of several materials, as files of fixed-size records hold them: coords,
    elem_xyz, num_materials, materials and fractions padded with -1 to the largest number of materials, the normal (zero if
    there is none) and the fine block."""
    several = combo.where(F.size("phases") > 1)
    most = several.agg(F.max(F.size("phases"))).first()[0] or 0
    pad = lambda values, with_: F.slice(F.concat(values, F.array_repeat(with_, most)), 1, max(most, 1))
    normal = F.coalesce("normal", F.array(*[F.lit(0.0)] * 3)) if "normal" in combo.columns else F.array(*[F.lit(0.0)] * 3)
    fine = [F.col("fine").alias("fine_scale_block")] if "fine" in combo.columns else []
    return several.select(
        F.array("bi", "bj", "bk").alias("coords"), F.col("elem").alias("elem_xyz"), F.size("phases").alias("num_materials"),
        pad(F.transform("phases", lambda p: p["material"].cast("int")), F.lit(-1)).alias("materials"), pad(F.transform("phases", lambda p: p["fraction"]), F.lit(-1.0)).alias("fractions"), normal.alias("normal"), *fine,
    )


def from_padded_records(records: DataFrame) -> DataFrame:
    """The composite blocks of ``padded_records`` again."""
    phases = F.zip_with(F.slice("materials", F.lit(1), F.col("num_materials")), F.slice("fractions", F.lit(1), F.col("num_materials")), lambda m, f: F.struct(m.alias("material"), f.alias("fraction")))
    at = [F.get("coords", k).alias(c) for k, c in enumerate(("bi", "bj", "bk"))]
    fine = [F.col("fine_scale_block").alias("fine")] if "fine_scale_block" in records.columns else []
    return records.select(*at, F.col("elem_xyz").alias("elem"), (-F.col("num_materials")).alias("coarse"), phases.alias("phases"), "normal", *fine)


def read_combo(spark: SparkSession, path: str, group: str) -> DataFrame:
    """Composite voxels; padding by -1 of imported data is stripped."""
    out = spark.read.parquet(f"{path}/{group}")
    if "phases" in out.columns:
        out = out.withColumn("phases", F.filter("phases", lambda p: p["material"] != -1))
    return out


def write_boundaries(image: DataFrame, table: DataFrame, path: str, group: str, normals: bool = False, header: dict | None = None) -> None:
    """Eroded image, boundary table sorted by tag, a header with the boundaries as JSON, and optionally the field of normals."""
    from ..operators.erosion import boundary_json, boundary_normals

    boundary_json(table).withColumn("header", F.lit(json.dumps(header or {}))).write.mode("overwrite").parquet(f"{path}/{group}/header")

    image.write.mode("overwrite").parquet(f"{path}/{group}/eroded_image")
    table.orderBy("gb_tag").write.mode("overwrite").parquet(f"{path}/{group}/boundaries")
    if normals:
        boundary_normals(image, table).write.mode("overwrite").parquet(f"{path}/{group}/normals")


RESULT_KEYS = ("microstructure", "load_case", "time_step")


def write_results(results: DataFrame, path: str, overwrite: bool = True) -> None:
    """Results by partition of microstructure, load case and step.

    New quantities join those that are there; quantities that are there too are replaced, or left (``overwrite`` off).
    """
    from pyspark.errors import AnalysisException

    spark = results.sparkSession
    keys = [*RESULT_KEYS, "quantity"]
    try:
        there = spark.read.parquet(path).where("1 = 1")
        touched = there.join(results.select(*RESULT_KEYS).distinct(), list(RESULT_KEYS), "left_semi")
        kept = touched.join(results.select(*keys).distinct(), keys, "left_anti") if overwrite else touched
        new = results if overwrite else results.join(there.select(*keys).distinct(), keys, "left_anti")
        whole = kept.select(*results.columns).unionByName(new)
    except AnalysisException:
        whole = results
    # partitions are read and overwritten: the rows are written aside first
    aside = f"{path.rstrip('/')}_staged"
    whole.write.mode("overwrite").parquet(aside)
    staged = spark.read.schema(whole.schema).parquet(aside)
    staged.repartition(*RESULT_KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RESULT_KEYS).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(aside)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_results(spark: SparkSession, path: str, quantities=None, microstructures=None, load_cases=None, time_steps=None) -> DataFrame:
    """Results of the named items: partitions are pruned before anything is read."""
    return extract(spark.read.parquet(path), quantities, microstructures, load_cases, time_steps)
