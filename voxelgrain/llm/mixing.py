"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same fractional number of copies, target words over the source's words. Its
whole part is taken at once; the fractional parts are rounded dependently: two documents exchange mass, in words, until
one of them is whole, so a source's words stay what they were. Groups of about ``LEAF`` documents of one source do this in
parallel, longest first, so that the one document each leaves fractional is a short one; these residuals meet in a
reduction tree of fan-in ``FAN``.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD_CLASS, cut, refuse_own_names

LEAF = 2048
FAN = 512
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source, and so a document, is repeated at most so often.
LIMIT = 3
_EPS = 1e-9
_FIELDS = "doc_id long, source string, size long, th long, whole long, part double, bucket long, ticket long"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row per source: source, source_size, rows, target.

    Sources in code-point order, null last, carry ``weights`` in turn and share the sum of all sizes; a target stops
    at ``limit`` times the source's size and the excess goes to the others by weight until none is above. That fixed
    point is a water level: with sources ordered by cap over weight, the level is read at the first one it doesn't reach.
    The windows run over one row per source.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1)
    each = each.withColumn("weight", weight).withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy(F.lit(1))
    below = F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1))
    onward = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    each = each.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(below, F.lit(0.0))) / onward).withColumn("turn", F.row_number().over(rising))
    first = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("turn", "level"))).over(everything)["level"]
    target = F.when(first.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), first * F.col("weight")))
    return each.select("source", "source_size", "rows", target.alias("target"))


def _settle(rows: list[list], seed: str) -> None:
    """Pivotal rounding in place of rows [size, part]; at most one part stays strictly between 0 and 1."""
    draw = random.Random(seed).random
    open_at = None
    for at, row in enumerate(rows):
        if not _EPS < row[1] < 1 - _EPS:
            row[1] = float(round(row[1]))
            continue
        if open_at is None:
            open_at = at
            continue
        one = rows[open_at]
        up = min(one[0] * (1 - one[1]), row[0] * row[1])
        down = min(one[0] * one[1], row[0] * (1 - row[1]))
        if draw() * (up + down) < down:
            one[1], row[1] = one[1] + up / one[0], row[1] - up / row[0]
        else:
            one[1], row[1] = one[1] - down / one[0], row[1] + down / row[0]
        left = None
        for place, held in ((open_at, one), (at, row)):
            if _EPS < held[1] < 1 - _EPS:
                left = place
            else:
                held[1] = float(round(held[1]))
        open_at = left


def _group(seed: int, level: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["group"]).sort_by([("size", "descending"), ("ticket", "ascending"), ("doc_id", "ascending")])
        units = [list(x) for x in zip(rows["size"].to_pylist(), rows["part"].to_pylist(), strict=True)]
        _settle(units, f"{seed}|{level}|{rows['source'][0].as_py()!r}|{rows['bucket'][0].as_py()}")
        return rows.set_column(rows.column_names.index("part"), "part", pa.array([u[1] for u in units], pa.float64()))

    return run


def _group_key(source) -> F.Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def rounded_copies(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = 11) -> DataFrame:
    """``sizes`` (doc_id, source, size, th) with source_size, target and whole ``copies`` of each row.

    Rows go to leaves by a hash of what they are; where more than a leaf's rows are alike, their places deal them out.
    """
    targets = cut(source_targets(sizes, weights, limit), "targets", slim=True)
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(limit)))).otherwise(F.lit(0.0))
    joined = sizes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ticket = F.xxhash64("doc_id", "size", "th", F.lit(seed))
    alike = sizes.groupBy(F.xxhash64("doc_id", "source", "size", "th").alias("_alike")).count().where(F.col("count") > LEAF).select("_alike")
    alike = cut(alike, "alike", slim=True)
    if alike.limit(1).count():
        joined = joined.withColumn("_row", F.monotonically_increasing_id()).withColumn("_this", F.xxhash64("doc_id", "source", "size", "th"))
        joined = joined.join(alike, F.col("_this") == F.col("_alike"), "left")
        ticket = F.when(F.col("_alike").isNotNull(), F.xxhash64(ticket, "_row")).otherwise(ticket)
    joined = joined.withColumns({"share": share, "ticket": ticket})
    part = F.col("share") - F.floor("share")
    part = F.when(F.col("size") > 0, part).otherwise((F.pmod(F.xxhash64("ticket"), F.lit(1 << 20)) / (1 << 20) < part).cast("double"))
    leaf = F.pmod(F.col("ticket"), F.ceil(F.col("rows") / LEAF))
    units = joined.select("doc_id", "source", "size", "th", F.floor("share").alias("whole"), part.alias("part"), leaf.alias("bucket"), "ticket")
    widest = targets.agg(F.max(F.ceil(F.col("rows") / LEAF)).alias("n")).first()["n"] or 1

    fraction = (F.col("part") > _EPS) & (F.col("part") < 1 - _EPS)
    level, done, open_rows = 0, [], units
    while True:
        grouped = open_rows.withColumn("group", _group_key(F.col("source"))).groupBy("group", "bucket")
        settled = cut(grouped.applyInArrow(_group(seed, level), _FIELDS), f"mix{level}", slim=level > 0)
        done.append(settled.where(~fraction))
        open_rows = settled.where(fraction).withColumn("bucket", F.floor(F.col("bucket") / FAN))
        if widest <= 1:
            break
        widest, level = -(-widest // FAN), level + 1
    last = F.pmod(F.xxhash64("ticket", F.lit("last")), F.lit(1 << 30)) / (1 << 30) < F.col("part")
    done.append(open_rows.withColumn("part", last.cast("double")))
    decided = done[0]
    for more in done[1:]:
        decided = decided.unionByName(more)
    decided = decided.select("doc_id", "source", "size", "th", (F.col("whole") + F.col("part").cast("long")).alias("copies"))
    return decided.join(targets.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, the number of words (runs without white space; null text: 0) and th, a hash of the text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_CLASS)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("th"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = 11) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words taken, repeats counted).

    Defined cases: null sources form one source, last in order; a null or empty text has size 0 and takes nothing; a
    source without words has target 0; repeated rows are rounded separately; draws depend on ids, sizes, texts and the
    seed only, so reruns agree (beyond ``LEAF`` rows that are alike in all of these, also on their places, which no one can
    tell apart); an empty table gives no rows.
    """
    sizes = cut(document_sizes(docs), "sizes")
    rounded = rounded_copies(sizes, weights, limit, seed)
    return rounded.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def take_mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = 11) -> DataFrame:
    """The documents of the mix, each as often as it was drawn, all columns.

    A row is known by id, source and text. Rows alike in these share out what they drew together, the first ones one more
    where it doesn't divide. Wordless rows are drawn at their source's rate. An empty table gives no rows; columns named ``__vg_...`` raise ValueError.
    """
    refuse_own_names(docs)
    sizes = cut(document_sizes(docs), "sizes")
    drawn = rounded_copies(sizes, weights, limit, seed).groupBy("doc_id", "source", "th").agg(F.sum("copies").alias("__vg_copies"), F.count("*").alias("__vg_rows")).where("__vg_copies > 0")
    drawn = cut(drawn.select(F.col("doc_id").alias("__vg_id"), F.col("source").alias("__vg_source"), F.col("th").alias("__vg_th"), "__vg_copies", "__vg_rows"), "drawn")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__vg_id")) & docs["source"].cast("string").eqNullSafe(F.col("__vg_source")) & (F.xxhash64(docs["text"]) == F.col("__vg_th"))
    found = docs.join(drawn, same)
    each = F.floor(F.col("__vg_copies") / F.col("__vg_rows"))
    if drawn.where("__vg_rows > 1 and __vg_copies % __vg_rows <> 0").limit(1).count():
        nth = F.row_number().over(Window.partitionBy("__vg_id", "__vg_source", "__vg_th").orderBy("__vg_rows"))
        found = found.withColumn("__vg_nth", F.when(F.col("__vg_rows") > 1, nth).otherwise(1))
        each = each + (F.col("__vg_nth") <= F.col("__vg_copies") % F.col("__vg_rows")).cast("long")
    times = F.when(each > 0, F.sequence(F.lit(1), each.cast("int"))).otherwise(F.array().cast("array<int>"))
    return found.withColumn("__vg_time", F.explode(times)).select(*[docs[c] for c in docs.columns])
