"""The corpus pipeline: five operators of ``voxelgrain.llm``, each reading what its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``; the last returns the packed pieces with their token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from voxelgrain.llm import exact_dedup, langid, mixing, near_dedup, packing
from voxelgrain.llm.shared import prepare, shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language the classifier recognises stay; texts without a letter and doubtful ones go.

    Null and empty texts go; null ids, languages and sources are no reason to go; repeated rows are judged alike; an empty table
    stays empty, and where no row has a language all go. Columns named ``__vg_...`` raise ValueError, others stay as they are.
    """
    prepare(spark)
    return langid.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays.

    White space counts as one space, null as the empty text; a row without an id stays only if no copy has one; of repeated rows
    one stays; an empty table stays empty. Columns named ``__vg_...`` raise ValueError, others stay as they are.
    """
    prepare(spark)
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8 or more) the row with the smallest id stays.

    Rows are known by id and text, so unlike texts of one id, or without an id, are documents of their own; wordless texts are
    like nothing and stay; an empty table stays empty. Columns named ``__vg_...`` raise ValueError, others stay as they are.
    """
    prepare(spark)
    return near_dedup.keep_representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources draw them.

    A null source is one of its own, the last; rows alike in id, source and text share out what they drew together; wordless
    documents are drawn at their source's rate; an empty table stays empty. Columns named ``__vg_...`` raise ValueError, others
    stay as they are.
    """
    prepare(spark)
    return mixing.take_mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 1024.

    Null and empty texts are one piece with the end id; null ids and repeated rows are packed like others; ties go by where rows
    are read; an empty table gives no rows; other columns are not read.
    """
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: The learnt, randomised and tokenising stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
