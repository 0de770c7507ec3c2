"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

The shingles of a text are hashed once; the high bits of a hash name its bin and the least hash of each bin stays.
Empty bins are filled by optimal densification: an empty bin probes others through fixed independent choices until it
meets a full one. A few probes run for all bins at once; a bin they leave empty takes the full bin that comes first in
an order of its own, so every bin is filled whatever the text. The low bits of all bins, packed, are the fingerprint;
likeness is the share of equal bins, less what equal low bits of unequal bins contribute.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE_CLASS


@dataclass(frozen=True)
class FingerprintConfig:
    """``bins`` must be a power of two; four bins of 8 bits are packed into one word of 32."""

    width: int = 5
    bins: int = 256
    probes: int = 3
    seed: int = 3

    @property
    def shift(self) -> int:
        return 63 - (self.bins.bit_length() - 1)

    @property
    def low(self) -> int:
        return (1 << self.shift) - 1


BITS = 8


def _longs(values) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _probed(bins: Column, least: Column, target: Column, empty) -> Column:
    """Empty bins take what the bin that ``target`` names for them had from the start."""
    return F.transform(bins, lambda x, i: F.when(empty(x), F.get(least, F.get(target, i))).otherwise(x))


def with_fingerprint(df: DataFrame, text: str, out: str, config: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """``df`` with ``out``: the packed words of the text's fingerprint, or null for a text without words.

    Each step is a column of its own, named more than once by the next, so that the optimiser keeps it computed once.
    """
    words, hashes, ordered, least, full = (f"_{out}_{x}" for x in ("words", "hashes", "ordered", "least", "full"))
    k, low, shift = config.width, config.low, config.shift
    split = F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{SPACE_CLASS}+", " ")), " ")
    df = df.withColumn(words, F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w)))
    mask = F.lit((1 << 63) - 1)
    rolled = F.transform(
        F.sequence(F.lit(0), F.size(words) - k),
        lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(k)]).bitwiseAND(mask),
    )
    whole = F.array(F.xxhash64(F.col(words), F.lit("whole")).bitwiseAND(mask))
    df = df.withColumn(hashes, F.when(F.size(words) >= k, rolled).when(F.size(words) > 0, whole))
    ends = _longs((b << shift) | low for b in range(config.bins))
    # the largest value of each bin is added, so that every bin has a first element: that value if the bin is empty
    df = df.withColumn(ordered, F.sort_array(F.concat(F.coalesce(F.col(hashes), F.array().cast("array<long>")), ends)))
    bin_of = lambda x: F.shiftright(x, shift)
    df = df.withColumn(least, F.filter(F.col(ordered), lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(ordered), i - 1)))))
    empty = lambda x: x.bitwiseAND(F.lit(low)) == low
    rng = np.random.default_rng(config.seed)
    filled = F.col(least)
    for _ in range(config.probes):
        filled = _probed(filled, F.col(least), F.array(*[F.lit(int(v)) for v in rng.integers(0, config.bins, config.bins)]), empty)
    df = df.withColumn(full, filled)
    found = F.filter(F.col(least), lambda y: ~empty(y))
    first = lambda i: F.array_min(F.transform(found, lambda y: F.struct(F.xxhash64(bin_of(y), i).alias("turn"), y.alias("value"))))["value"]
    rest = F.transform(F.col(full), lambda x, i: F.when(empty(x), first(i)).otherwise(x))
    done = F.when(F.exists(F.col(full), empty), rest).otherwise(F.col(full))
    bins = f"_{out}_bins"
    df = df.withColumn(bins, done)
    byte = F.lit((1 << BITS) - 1)
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(config.bins // 4 - 1)),
        lambda i: F.get(F.col(bins), 4 * i).bitwiseAND(byte)
        + F.get(F.col(bins), 4 * i + 1).bitwiseAND(byte) * 256
        + F.get(F.col(bins), 4 * i + 2).bitwiseAND(byte) * 65536
        + F.get(F.col(bins), 4 * i + 3).bitwiseAND(byte) * 16777216,
    )
    return df.withColumn(out, F.when(F.col(hashes).isNotNull(), packed)).drop(words, hashes, ordered, least, full, bins)


def as_text(packed: Column) -> Column:
    """A fingerprint as lowercase hexadecimal; the empty string for a text without words."""
    return F.coalesce(F.array_join(F.transform(packed, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column, config: FingerprintConfig = FingerprintConfig()) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1; two wordless texts are alike, one is unlike all else."""
    ones = 0x7F7F7F7F
    # a byte of x that is zero leaves its high bit clear in the sum and in x; the complement marks just those bytes
    equal = lambda x: F.bit_count(F.bitwise_not((x.bitwiseAND(F.lit(ones)) + F.lit(ones)).bitwiseOR(x)).bitwiseAND(F.lit(0x80808080)))
    matches = F.aggregate(F.zip_with(a, b, lambda x, y: equal(x.bitwiseXOR(y))), F.lit(0), lambda n, m: n + m)
    chance = 2.0**-BITS
    share = F.greatest(F.lit(0.0), (matches / float(config.bins) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(share)


def document_fingerprints(docs: DataFrame, config: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """doc_id and ``fingerprint`` (hexadecimal) of every row."""
    rows = with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "packed", config)
    return rows.select("doc_id", as_text(F.col("packed")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, config: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the beginning of the next document.

    Documents are dealt out in ranges of ids whose bounds are ids of the table; a bound's document also joins the
    range before its own (the first document the last range), so each row finds its successor without a global order.
    Defined cases: null texts are empty; a null id comes first; rows with one id are ordered by their text's digest;
    a single row is its own successor; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cuts = docs.select(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], 20 * ranges).alias("cuts")).first()
    bounds = sorted({x for x in [cuts["least"], *(cuts["cuts"] or [])] if x is not None}) or [0]
    last = len(bounds) - 1
    place = F.coalesce(F.greatest(F.size(F.filter(_longs(bounds), lambda b: b <= F.col("doc_id"))) - 1, F.lit(0)), F.lit(0))
    place = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place)
    rows = with_fingerprint(docs, "text", "packed", config).withColumn("_range", place)
    first = F.col("doc_id").isNull() | (F.col("doc_id") == bounds[0])
    guest = F.when(first, F.lit(last)).when(F.col("doc_id").isin(bounds[1:]) if last else F.lit(False), F.col("_range") - 1)
    places = F.array_compact(F.array(F.struct(F.col("_range").alias("_range"), F.lit(False).alias("_guest")), F.when(guest.isNotNull(), F.struct(guest.alias("_range"), F.lit(True).alias("_guest")))))
    dealt = rows.select("doc_id", "text", "packed", F.explode(places).alias("_at")).select("doc_id", "text", "packed", F.col("_at._range").alias("_range"), F.col("_at._guest").alias("_guest"))
    order = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    follow = dealt.select("doc_id", "text", "packed", "_guest", F.lead("text").over(order).alias("_next"), F.lead("packed").over(order).alias("_next_packed"))
    follow = follow.where(~F.col("_guest"))
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("_next", F.lit(1), half))
    both = with_fingerprint(follow.withColumn("edited", edited), "edited", "edited_packed", config)
    return both.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("packed")).alias("fingerprint"),
        as_text(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed"), config).alias("near_edited"),
        likeness(F.col("packed"), F.col("_next_packed"), config).alias("near_next"),
    )
