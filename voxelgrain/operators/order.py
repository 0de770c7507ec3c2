"""Numbers and values by order, without a task that sees all rows.

Rows are dealt into ranges whose bounds are rows of a sample, seen by all sort columns and by a random number behind them, so
ranges stay even also where keys have few values or one key holds most rows. Numbers within a range and sums over the
ranges, one a range, give numbers of all. Order statistics look at digits of values: each of a fixed number of passes counts
one digit of those that share the digits before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stages import cut, drop_stage

#: Rows aimed at in a range, and the most ranges that are made (the driver gets one sum for each).
RANGE_ROWS, MOST_RANGES = 8192, 16_384
#: Bits of the digits that order statistics count; a pass sends the driver at most 2^DIGIT counts for each prefix.
DIGIT = 16


def _written(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` itself if it is a stage, else a written copy; and whether that was made here."""
    return (df, False) if hasattr(df, "_stage_path") else (cut(df, "ordered"), True)


def dealt_by_range(df: DataFrame, order: Sequence[str], rows: int = RANGE_ROWS) -> DataFrame:
    """Written ``df`` in even ranges by all of ``order`` (nulls first), sorted within them; rows of one key may be split.

    Adds ``_tie``: a random number of the row, which stands behind the keys. It hangs on a row's place in the written files
    alone, so tasks that run again deal out alike.
    """
    n = max(1, min(math.ceil(df.count() / rows), MOST_RANGES))
    tied = df.withColumn("_tie", F.rand(5))
    return tied.repartitionByRange(n, *order, "_tie").sortWithinPartitions(*order, "_tie")


def _before(sums: DataFrame) -> DataFrame:
    """(range, before): the sum of all ranges before each, from one row a range."""
    total, rows = 0, []
    for r in sorted(sums.collect()):
        rows.append((r[0], total))
        total += r[1] or 0
    return F.broadcast(sums.sparkSession.createDataFrame(rows, "_range int, _before long"))


def running_total(df: DataFrame, order: Sequence[str], size: Column, out: str) -> DataFrame:
    """``df`` with the running sum of ``size`` in the order of ``order`` (nulls first), up to and with each row.

    Rows equal in that order take their turns in a fixed but arbitrary way; null sizes count 0.
    """
    names = df.columns
    source, own = _written(df)
    size = F.coalesce(size.cast("long"), F.lit(0))
    dealt = dealt_by_range(source, order).select(*names, size.alias("_size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, here = 0, TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                upto = np.cumsum(batch.column(len(names)).to_numpy()) + total
                total = int(upto[-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto), pa.array([here] * len(upto), pa.int32())], [*names, "_size", "_upto", "_range"])

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    summed = cut(dealt.mapInArrow(run, f"{fields}, _size long, _upto long, _range int"), "running")
    if own:
        drop_stage(source)
    before = _before(summed.groupBy("_range").agg(F.sum("_size").alias("n")))
    return summed.join(before, "_range").select(*names, (F.col("_upto") + F.col("_before")).alias(out))


def numbered(df: DataFrame, order: Sequence[str], out: str, start: int = 0) -> DataFrame:
    """``df`` with contiguous numbers from ``start`` in the order of ``order`` (nulls first).

    Numbers within a range are Spark's own ids of sorted partitions. Rows equal in that order are numbered in a fixed but
    arbitrary way.
    """
    source, own = _written(df)
    dealt = cut(dealt_by_range(source, order).select(*df.columns, F.monotonically_increasing_id().alias("_place")), "numbered")
    if own:
        drop_stage(source)
    # a place is the number of the partition, and behind it that of the row in 33 bits
    found = dealt.withColumns({"_range": F.shiftright("_place", 33).cast("int"), "_nth": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    before = _before(found.groupBy("_range").agg((F.max("_nth") + 1).alias("n")))
    return found.join(before, "_range").select(*df.columns, (F.col("_before") + F.col("_nth") + start).alias(out))


_SIGN = 1 << 63


def _keys(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers that sort like doubles: -inf first, both zeros alike, inf, then NaN."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = values.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(_SIGN))


def _value(key: int) -> float:
    bits = np.uint64(key ^ _SIGN if key & _SIGN else key ^ ((1 << 64) - 1))
    return float(np.array([bits]).view(np.float64)[0])


def order_statistics(df: DataFrame, column: str, places: Sequence[int]) -> list[float]:
    """The values at the given places (from 0) of the sorted column.

    Nulls are left out; NaN is a value that is greater than infinity, as in Spark's own order; both zeros are 0.0. ``df`` is
    read once: its values are written as keys, and four passes over these, for any values and all places at once, count 16
    bits of those keys that share the bits before. IndexError if there are fewer values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(np.asarray(pc.drop_null(batch.column(0)), np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    keys = cut(df.select(F.col(column).cast("double").alias("v")).where("v is not null").mapInArrow(run, "key long"), "keys")
    try:
        # (bits so far, place among the keys that share them) for each place asked for
        state = [(0, place) for place in places]
        for shift in range(64 - DIGIT, -1, -DIGIT):
            digit = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int").alias("digit")
            before = F.shiftrightunsigned("key", shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("long")
            prefixes = sorted({p for p, _ in state})
            counts: dict[int, list] = {p: [] for p in prefixes}
            for r in keys.select(before.alias("prefix"), digit).where(F.col("prefix").isin(prefixes)).groupBy("prefix", "digit").count().collect():
                counts[r["prefix"]].append((r["digit"], r["count"]))
            state = [_step(prefix, place, sorted(counts[prefix])) for prefix, place in state]
        return [_value(key) for key, _ in state]
    finally:
        drop_stage(keys)


def _step(prefix: int, place: int, counts: list[tuple[int, int]]) -> tuple[int, int]:
    if place < 0:
        raise IndexError("places count from 0")
    for digit, n in counts:
        if place < n:
            return prefix << DIGIT | digit, place
        place -= n
    raise IndexError("there are fewer values than that")


def between(low: float, high: float, t: float) -> float:
    """The value ``t`` of the way from ``low`` to ``high`` (0 to 1): exact at both ends, never past them, also where their
    difference passes the range of doubles. An infinite end holds all the way up to the other end; two opposite ones give NaN."""
    if t <= 0 or low == high:
        return low
    if t >= 1:
        return high
    if math.isinf(low) and math.isinf(high):
        return math.nan
    if math.isinf(low) or math.isinf(high) or math.isnan(high):
        return low if math.isinf(low) else high
    wide = high - low
    return low + wide * t if math.isfinite(wide) else low * (1 - t) + high * t
