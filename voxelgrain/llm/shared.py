"""Session helpers shared by the operators: the folder for written stages, and reading tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..stages import clean_stages, cut, drop_stage, shared_dir  # noqa: F401  the operators take them from here

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


#: Stands for a null id, which sorts last.
LAST_ID = (1 << 63) - 1

#: Rows of an Arrow batch where the session has Spark's default of 10,000: whole texts are long, and an executor holds
#: a batch several times for each of its Python workers.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Ship the package and keep Arrow batches of texts small; a batch size that the user has set stays."""
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def bounded_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of what runs inside end at ``most`` bytes: rows of large arrays would fill a batch of many times that."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """True for the fifth of all ids that is never learnt from; null ids are neither held out nor learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def refuse_own_names(df: DataFrame) -> None:
    """Columns whose names begin like those that operators add to whole rows would be overwritten: ValueError."""
    if found := [c for c in df.columns if c.lower().startswith("__vg_")]:
        raise ValueError(f"columns {found} have names that are kept for this library; rename them")


def keyed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__vg_doc`` and ``__vg_part``, which name a document.

    Rows with one id and one text are one document; where an id stands on several texts, or is null (then it sorts last),
    the part is a hash of the text that keeps them apart; elsewhere it is 0.
    """
    refuse_own_names(docs)
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.withColumn("__vg_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)))
    several = rows.groupBy("__vg_doc").agg(F.min(text_hash).alias("low"), F.max(text_hash).alias("high")).where("low <> high").select(F.col("__vg_doc").alias("__vg_several"))
    several = cut(several, "several", slim=True)
    if not several.limit(1).count():
        return rows.withColumn("__vg_part", F.lit(0).cast("long"))
    rows = rows.join(several, F.col("__vg_doc") == F.col("__vg_several"), "left")
    return rows.withColumn("__vg_part", F.when(F.col("__vg_several").isNull(), 0).otherwise(text_hash)).drop("__vg_several")


def documents_by_row(docs: DataFrame) -> DataFrame:
    """doc_id, part and text of every row, documents told apart by the first two."""
    return keyed_documents(docs.select("doc_id", "text")).select(F.col("__vg_doc").alias("doc_id"), F.col("__vg_part").alias("part"), "text")
