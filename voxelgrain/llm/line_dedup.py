"""Near-equal lines by a deletion-neighbourhood join, with DataFrame functions only.

A line goes when an equal line, or one within the edit bound, occurs earlier (by document id, then line number), whether
or not that one stays. Equal lines meet by digest. For the others each line emits all its variants as hashed keys: a
variant has a gap for each edit of the bound, where a character was left out or none stood. Lines with a variant in
common are within the bound of each other, since each gap costs one edit at most, and lines within the bound have one in
common. So a variant points at its earliest line and no pairs are formed inside a group. Every link is verified by edit
distance.

For a bound of 1 the key of a gap is the hash of what is before it, from the line's start, and of what is behind it, from
the line's end; running sums over the characters give all of a line's keys in work linear to its length. Most lines have
no partner, so variants are emitted only for lines that pass an exact pigeonhole test first: one edit leaves the first or
the last half of the shorter line intact. Larger bounds write variants out and skip that test.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LAST_ID, cut, documents_by_row, drop_stage, keyed_documents


@dataclass(frozen=True)
class LineConfig:
    """``distance`` is the edit bound (0: equal lines only); work grows with the power ``distance`` of a line's length. Up to
    ``broadcast_rows`` lines are broadcast to fetch their texts by (some 60 bytes each), more are joined by shuffle."""

    distance: int = 1
    broadcast_rows: int = 250_000


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, part, line_no (from 0) and line of every line of ``documents_by_row``; null text is empty."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return documents_by_row(docs).select("doc_id", "part", F.posexplode(lines).alias("line_no", "line"))


def _sized(df: DataFrame, config: LineConfig) -> DataFrame:
    """A few ids broadcast, behind a check of their number; otherwise the frame as it is."""
    return F.broadcast(df) if df.count() <= config.broadcast_rows else df


def _halves() -> list[Column]:
    """Keys of the first and last half of the shorter line of a pair, for lines of its length and for those one longer."""
    found = []
    for less in (0, 1):
        m = F.col("n") - less
        head = F.floor(m / 2).cast("int")
        tail = (m - head).cast("int")
        found.append(F.xxhash64(F.lit("head"), m, F.substring("line", F.lit(1), head)))
        found.append(F.xxhash64(F.lit("tail"), m, F.substring("line", F.col("n") - tail + 1, tail)))
    return found


def _possible(distinct: DataFrame) -> DataFrame:
    """Lines that may have a partner at distance 1: d, e, at and which half stays intact when a character of the line gives
    way (out_head, out_tail) or when one comes in (in_head, in_tail)."""
    keys = ("head0", "tail0", "head1", "tail1")
    halves = F.array(*[F.struct(F.lit(k[0] == "h").alias("head"), F.lit(k[-1] == "1").alias("longer"), F.col(k).alias("key")) for k in keys])
    keyed = distinct.select("d", "e", "at", F.explode(halves).alias("half")).select("d", "e", "at", "half.*")
    own = F.when(~F.col("longer"), F.col("d"))
    met = keyed.groupBy("key").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.max("longer").alias("has_longer"))
    met = met.where("low is not null and (has_longer or low <> high)").select("key", (F.col("low") != F.col("high")).alias("several"), "has_longer")
    rows = keyed.join(met, "key")
    out, into = F.col("longer") | F.col("several"), ~F.col("longer") & F.col("has_longer")
    flags = {"out_head": out & F.col("head"), "out_tail": out & ~F.col("head"), "in_head": into & F.col("head"), "in_tail": into & ~F.col("head")}
    return rows.groupBy("d", "e").agg(F.min("at").alias("at"), *[F.max(f).alias(name) for name, f in flags.items()])


def _single_gaps(texts: DataFrame) -> DataFrame:
    """All variants with one gap that a partner may share: before, place, behind (the key), d, e, at.

    Hashes are exclusive ors over the characters, each with its place from the start, or from the end.
    """
    chars = texts.select("d", "e", "at", "n", "out_head", "out_tail", "in_head", "in_tail", F.posexplode(F.filter(F.split("line", ""), lambda c: c != "")).alias("t", "c"))
    chars = chars.withColumns({"_p": F.xxhash64("t", "c"), "_s": F.xxhash64(F.col("t") - F.col("n"), "c")})
    line = Window.partitionBy("d", "e")
    upto = line.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    sums = chars.withColumns({"_upto": F.bit_xor("_p").over(upto), "_gone": F.bit_xor("_s").over(upto), "_all": F.bit_xor("_s").over(line)})
    before, behind = F.col("_upto").bitwiseXOR(F.col("_p")), F.col("_all").bitwiseXOR(F.col("_gone"))
    half = F.floor(F.col("n") / 2)
    # an intact first half leaves the gap behind it, an intact last half before it
    out = (F.col("out_head") & (F.col("t") >= half - 1)) | (F.col("out_tail") & (F.col("t") <= half + 1))
    into = lambda t: (F.col("in_head") & (t >= half)) | (F.col("in_tail") & (t <= half))
    gap = lambda when, p, t, s: F.when(when, F.struct(p.alias("before"), t.cast("int").alias("place"), s.alias("behind")))
    last = F.col("t") == F.col("n") - 1
    gaps = F.array_compact(F.array(
        gap(out, before, F.col("t"), behind),
        gap(into(F.col("t")), before, F.col("t"), behind.bitwiseXOR(F.col("_s"))),
        gap(last & into(F.col("n")), F.col("_upto"), F.col("n"), F.lit(0).cast("long")),
    ))
    return sums.select("d", "e", "at", F.explode(gaps).alias("g")).select("g.*", "d", "e", "at")


def _many_gaps(texts: DataFrame, distance: int) -> DataFrame:
    """All variants with ``distance`` gaps, written out: an empty string stands for a gap."""
    rows = texts.select("d", "e", "at", F.filter(F.split("line", ""), lambda c: c != "").alias("v"))
    for _ in range(distance):
        n = F.size("v")
        put = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.slice("v", F.lit(1), i), F.array(F.lit("")), F.slice("v", i + 1, n)))
        swap = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.get("v", i) != "", F.concat(F.slice("v", F.lit(1), i), F.array(F.lit("")), F.slice("v", i + 2, n))))
        made = F.array_distinct(F.array_compact(F.concat(put, F.when(n > 0, swap).otherwise(F.array().cast("array<array<string>>")))))
        rows = rows.select("d", "e", "at", F.explode(made).alias("v"))
    return rows.select(F.xxhash64("v").alias("before"), F.size("v").alias("place"), F.xxhash64(F.lit(1), "v").alias("behind"), "d", "e", "at").dropDuplicates(["before", "place", "behind", "d", "e"])


def line_decisions(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """doc_id, part, line_no, equal (an equal line is earlier), near (a line within the bound is earlier) of every line.

    Lines of spaces only are neither. Rows that repeat an id and its text are one document; rows that share an id, or have
    none, are told apart by their texts (``part``). A null id is the largest number.
    """
    blank = F.trim(F.col("line")) == ""
    lines = split_lines(docs).withColumn("n", F.length("line"))
    keys = ("head0", "tail0", "head1", "tail1") if config.distance == 1 else ()
    slim = lines.select(
        "doc_id", "part", "line_no",
        F.when(~blank, F.xxhash64("line")).alias("d"), F.when(~blank, F.xxhash64(F.lit(1), "line")).alias("e"),
        *[F.when(~blank, k).alias(name) for name, k in zip(keys, _halves(), strict=False)],
    )
    slim = cut(slim, "lines")
    at = F.struct("doc_id", "part", "line_no")
    distinct = cut(slim.where("d is not null").groupBy("d", "e").agg(F.min(at).alias("at"), *[F.min(k).alias(k) for k in keys]), "distinct")
    if config.distance:
        wanted = cut((_possible(distinct) if config.distance == 1 else distinct).withColumns({c: F.col(f"at.{c}") for c in ("doc_id", "part", "line_no")}), "candidates")
        texts = cut(lines.join(_sized(wanted, config), ["doc_id", "part", "line_no"]).dropDuplicates(["d", "e"]), "texts")
        variants = cut(_single_gaps(texts) if config.distance == 1 else _many_gaps(texts, config.distance), "variants")
        key = ["before", "place", "behind"]
        shared = variants.groupBy(*key).agg(F.min("d").alias("low"), F.max("d").alias("high"), F.min(F.struct("at", "d", "e")).alias("first")).where("low <> high")
        links = variants.join(shared, key).where(F.struct("d", "e") != F.struct("first.d", "first.e")).select("d", "e", F.col("first.d").alias("other_d"), F.col("first.e").alias("other_e")).distinct()
        one = texts.select("d", "e", F.col("line").alias("a"))
        two = texts.select(F.col("d").alias("other_d"), F.col("e").alias("other_e"), F.col("line").alias("b"))
        checked = links.join(one, ["d", "e"]).join(two, ["other_d", "other_e"]).where(F.levenshtein("a", "b", config.distance) >= 0)
        near = cut(checked.select("d", "e").distinct(), "near", slim=True).withColumn("near", F.lit(True))
        for stage in (wanted, texts, variants):
            drop_stage(stage)
        distinct = distinct.join(near, ["d", "e"], "left")
    flagged = distinct.select("d", "e", "at", (F.coalesce("near", F.lit(False)) if config.distance else F.lit(False)).alias("near"))
    out = slim.select("doc_id", "part", "line_no", "d", "e").join(flagged, ["d", "e"], "left")
    equal = F.coalesce(at != F.col("at"), F.lit(False))
    return out.select("doc_id", "part", "line_no", equal.alias("equal"), F.coalesce("near", F.lit(False)).alias("near"))


def line_report(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """One row per document id: doc_id, n_lines, equal_dropped, near_dropped (of the others), kept_lines.

    Defined cases: a null or empty text is one blank line, which stays; rows that repeat an id and its text count each line
    as often; rows that share an id, or have none, are compared with each other like others and reported together; ties
    cannot occur between different lines of one document; an empty table gives no rows; other columns are not read.
    """
    found = line_decisions(docs, config)
    equal, near = F.col("equal").cast("long"), (F.col("near") & ~F.col("equal")).cast("long")
    sums = found.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(equal).alias("equal_dropped"), F.sum(near).alias("near_dropped"), (F.count("*") - F.sum(equal) - F.sum(near)).alias("kept_lines"))
    return sums.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST_ID)))


def drop_repeated_lines(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """``docs`` with the dropped lines cut out of ``text``; documents keep their order of lines and other columns.

    Each text loses its own lines only: rows that share an id, or have none, are told apart by their texts.
    """
    gone = line_decisions(docs, config).where("equal or near").groupBy("doc_id", "part").agg(F.collect_set("line_no").alias("__vg_gone"))
    joined = keyed_documents(docs).join(gone.withColumnsRenamed({"doc_id": "__vg_doc", "part": "__vg_part"}), ["__vg_doc", "__vg_part"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__vg_gone", i)), "\n")
    return joined.withColumn("text", F.when(F.col("__vg_gone").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
