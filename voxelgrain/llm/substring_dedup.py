"""Repeated passages by content-defined chunks.

A gear rolling hash runs over the words of a text. A word is a cut where its hash is the least of some window of ``reach``
words, so cuts depend on content and insertions shift none behind them. A chunk runs from a cut to the first cut at least
``least`` words on: it is variable, and whatever surrounds a passage of ``least_words`` words, all its copies hold one and the
same chunk. Chunks are met by digest; all but the earliest copy (by document id, then place) are repeated. Repeated chunks
that touch, at one distance from their first copies, form chains and prove what they cover, byte for byte. At the ends of
chains, and where first copies differ, the windows of ``least_words`` words about a chunk are met by digest themselves, so
passages are found to their true ends and it doesn't matter which copy of a chunk comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LAST_ID as _LAST
from .shared import cut, documents_by_row, drop_stage, keyed_documents
from .textkernel import _SPACE, _power, chunks, mix, text_buffers

_U = np.uint64
#: The gear: a random 32-bit value for each byte.
_GEAR = np.random.default_rng(4711).integers(0, 1 << 32, 256, dtype=np.uint32)
_VALUES = np.random.default_rng(4712).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)
_RADIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words that the rolling hash covers, and by how many bits it moves on for each.
_SPAN, _SHIFT = 3, 22


@dataclass(frozen=True)
class PassageConfig:
    """Passages of ``least_words`` words (20 at least) or more."""

    least_words: int = 50

    @property
    def least(self) -> int:
        """Words of a chunk, at least."""
        return self.least_words // 4 + 1

    @property
    def reach(self) -> int:
        """Words of a window whose least hash is a cut.

        The first such cut of a passage lies in its first ``reach`` words, the end of its chunk at most ``least + reach - 1``
        words on; both lie within the passage, with the words their hashes cover.
        """
        return (self.least_words - _SPAN + 2 - self.least) // 2


def gear_hash(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte: the sum of the gear values of the last 32 bytes, each shifted by its distance.

    Doubling the summed stretch five times gives all sums at once. ``begin`` is how far each byte is from its text's start;
    nothing before the start counts.
    """
    h = _GEAR[data]
    for k in range(5):
        step = 1 << k
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint32(step)
        older[begin < step] = 0
        h = h + older
    return h


def passage_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of the texts in ``data`` (``offs`` from 0), and the number of words of each text.

    Words are runs without white space. In runs over 32 bytes, as in scripts without spaces, a word also begins after every
    code point that is not ASCII and, by content, about every four ASCII characters.
    """
    n = len(data)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs[:-1]] = True
    edge[offs[-1]] = True
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.concatenate([word[1:], [False]])
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    long = np.flatnonzero(ends - starts > 32)
    if len(long):
        more = []
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            own = data[a:b]
            cut_here = gear_hash(own, np.arange(b - a)) >> np.uint32(30) == 0
            cut_here |= own >= 128
            more.append(a + 32 + np.flatnonzero(cut_here[31:-1] & ((own[32:] & 0xC0) != 0x80)))
        at = np.sort(np.concatenate([starts, *more]))
        stops = ends[np.searchsorted(starts, at, "right") - 1]
        ends = np.minimum(np.append(at[1:], n), stops)
        starts = at
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def _least_at(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least of each ``width`` successive values, by doubling."""
    have, at, low = 1, np.arange(len(values)), values
    while have < width:
        step = min(have, width - have)
        later = low[step:] < low[:-step]
        at, low = np.where(later, at[step:], at[:-step]), np.where(later, low[step:], low[:-step])
        have += step
    return at


def _range_hashes(data: np.ndarray):
    """A function of starts and ends that gives two 64-bit hashes of each stretch of bytes."""
    sums, n = [], len(data)
    for k, (radix, values) in enumerate(zip(_RADIX, _VALUES, strict=True)):
        one = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * _power(f"passage{k}", radix, n), out=one[1:])
        sums.append((one, _power(f"passage back{k}", pow(radix, -1, 1 << 64), n), _U(radix)))

    def of(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        return [mix((one[b] - one[a]) * back[a] + (b - a).astype(np.uint64) * radix) for one, back, radix in sums]

    return of


def chunk_places(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, config: PassageConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all chunks and the words they stop before, and for each word the cut that is the first least of the
    window begun there (-1 where a text ends within the window)."""
    n = len(starts)
    inside = np.zeros(len(data), np.int64)
    inside[starts] = starts
    inside = np.arange(len(data)) - np.maximum.accumulate(inside)
    word = gear_hash(data, inside)[ends - 1].astype(np.uint64)
    doc = np.repeat(np.arange(len(counts)), counts)
    rolled = word[: n - _SPAN + 1]
    for k in range(1, _SPAN):
        rolled = (rolled << _U(_SHIFT)) + word[k : n - _SPAN + 1 + k]
    value = mix(rolled)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(n, -1)
    if len(value) < config.reach:
        return none
    first = _least_at(value, config.reach)
    whole = doc[: len(first)] == doc[config.reach + _SPAN - 2 :]
    designated = np.full(n, -1)
    designated[: len(first)] = np.where(whole, first, -1)
    # all places that equal the least of a window in their text are cuts
    chosen = np.zeros(n, bool)
    chosen[first[whole]] = True
    low = value[first]
    for lag in range(1, config.reach):  # further places of the same value in the window, which words that repeat give
        again = np.flatnonzero(whole & (first + lag < np.arange(len(first)) + config.reach))
        again = again[value[first[again] + lag] == low[again]]
        chosen[first[again] + lag] = True
    cuts = np.flatnonzero(chosen)
    after = np.searchsorted(cuts, cuts + config.least)
    has = after < len(cuts)
    stop = cuts[np.minimum(after, len(cuts) - 1)] if len(cuts) else cuts
    has &= doc[stop] == doc[cuts]
    return cuts[has], stop[has], designated


_ROWS = "doc_id long, part long, word int, words int, start long, bytes int, d long"


def _passage_batches(config: PassageConfig, windows: bool):
    """Chunks of all texts or, with the chunks' digests wanted of each text in a fourth column, windows about these, whose
    second digest ``e`` stands in the place of ``words``."""
    width = config.least_words
    names = ["doc_id", "part", "word", "e" if windows else "words", "start", "bytes", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offs = text_buffers(batch.column(2))
            for i, j in chunks(offs):
                own, part = offs[i : j + 1] - offs[i], data[offs[i] : offs[j]]
                starts, ends, counts = passage_words(part, own) if len(part) else (np.zeros(0, np.int64),) * 3
                if len(starts) < width:
                    continue
                at, stop, designated = chunk_places(part, starts, ends, counts, config)
                doc = np.repeat(np.arange(len(counts)), counts)
                before = np.cumsum(counts) - counts
                hashes = _range_hashes(part)
                # a chunk's digest covers the white space behind it, too, so that chunks that touch leave no gap
                d, _ = hashes(starts[at], starts[stop])
                if windows:
                    marked = np.zeros(len(starts), bool)
                    edges = np.searchsorted(at, np.concatenate([before, [len(starts)]]))
                    for m in np.flatnonzero(counts >= width).tolist():
                        wanted = batch.column(3)[i + m].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                        mine = slice(edges[m], edges[m + 1])
                        marked[at[mine][np.isin(d[mine], wanted)]] = True
                    at = np.arange(len(starts) - width + 1)
                    at = at[(designated[at] >= 0) & marked[designated[at]] & (doc[at] == doc[at + width - 1])]
                    last = at + width - 1
                    d, extra = hashes(starts[at], ends[last])
                    extra = extra.view(np.int64)
                else:
                    last, extra = stop - 1, (stop - at).astype(np.int32)
                owner = doc[at]
                columns = [ids[i + owner], parts[i + owner], (at - before[owner]).astype(np.int32), extra, starts[at] - own[owner], (ends[last] - starts[at]).astype(np.int32), d.view(np.int64)]
                for x in range(0, len(at), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[x : x + (1 << 16)]) for c in columns], names)

    return run


def _later_copies(found: DataFrame, *key: str) -> DataFrame:
    """Rows of ``found`` whose key occurred before, with the first row's document and word."""
    first = found.groupBy(*key).agg(F.min(F.struct("doc_id", "part", "word")).alias("first"), F.count("*").alias("copies")).where("copies > 1").select(*key, "first")
    again = found.join(first, list(key)).where(F.struct("doc_id", "part", "word") != F.col("first"))
    return again.select(*found.columns, F.struct("first.doc_id", "first.part").alias("first_doc"), F.col("first.word").alias("first_word"))


def _passages(docs: DataFrame, config: PassageConfig) -> DataFrame:
    """doc_id, part, start, bytes, words and first_doc_id of every passage, by documents of ``documents_by_row``."""
    width = config.least_words
    rows = documents_by_row(docs)
    found = cut(rows.mapInArrow(_passage_batches(config, False), _ROWS), "chunks")
    # dealt out by document once: for the removal of rows that repeat and for the windows over each document's chunks
    again = _later_copies(found, "d").repartition("doc_id", "part").distinct()
    order = Window.partitionBy("doc_id", "part").orderBy("word", "start")
    held = (F.lag("first_doc").over(order) == F.col("first_doc")) & (F.lag(F.col("word") - F.col("first_word")).over(order) == F.col("word") - F.col("first_word")) & (F.col("word") <= F.lag(F.col("word") + F.col("words")).over(order))
    chains = again.withColumn("_fresh", (~F.coalesce(held, F.lit(False))).cast("int"))
    chains = chains.withColumn("run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = Window.partitionBy("doc_id", "part", "run")
    chains = cut(chains.withColumns({"low": F.min("word").over(one), "high": F.max(F.col("word") + F.col("words")).over(one)}), "chains")
    proven = chains.groupBy("doc_id", "part", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("bytes")).alias("stop"), F.min("low").alias("word"), F.max("high").alias("last"), F.min_by("first_doc", "start").alias("first_doc")
    )
    proven = proven.where(F.col("last") - F.col("word") >= width).drop("run")
    # windows that reach beyond a chain hold one of its outer chunks; other copies of these chunks give theirs as well
    outer = chains.where((F.col("word") - F.col("low") < config.reach) | (F.col("high") - F.col("word") < width)).select("d").distinct()
    wanted = found.join(outer, "d", "left_semi").groupBy("doc_id", "part").agg(F.collect_set("d").alias("wanted"))
    about = rows.join(wanted, ["doc_id", "part"]).select("doc_id", "part", "text", "wanted")
    windows = cut(about.mapInArrow(_passage_batches(config, True), _ROWS.replace("words int", "e long")), "windows")
    drop_stage(found)
    stretches = _later_copies(windows, "d", "e").select("doc_id", "part", "start", (F.col("start") + F.col("bytes")).alias("stop"), "word", (F.col("word") + width).alias("last"), "first_doc")
    order = Window.partitionBy("doc_id", "part").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = proven.select(stretches.columns).union(stretches).withColumn("_fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    joined = joined.withColumn("run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return joined.groupBy("doc_id", "part", "run").agg(
        F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("bytes"), (F.max("last") - F.min("word")).alias("words"), F.min_by("first_doc", F.struct("start", "stop"))["doc_id"].alias("first_doc_id")
    )


def repeated_passages(docs: DataFrame, config: PassageConfig = PassageConfig()) -> DataFrame:
    """Passages of ``least_words`` words or more that occurred before, to their true ends: doc_id, start, bytes, words,
    first_doc_id (where the first proven stretch of it is first seen).

    A passage joins all overlapping stretches of at least that many words that an earlier place (by document id, then
    text and place) holds byte for byte, white space included; places count UTF-8 bytes. Defined cases: null and empty texts
    have none; rows that repeat an id and its text are one document, seen once; rows that share an id, or have none, are
    kept apart by their texts; a null id sorts last and is shown as null; a text that repeats a passage of its own has it,
    with itself as first document; an empty table gives no rows; other columns are not read.
    """
    shown = lambda c: F.nullif(c, F.lit(_LAST)).alias(c)
    return _passages(docs, config).select(shown("doc_id"), "start", "bytes", "words", shown("first_doc_id"))


def cut_repeats(docs: DataFrame, config: PassageConfig = PassageConfig()) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``; other columns and rows stay.

    Each text loses its own passages only: rows that share an id, or have none, are told apart by their texts, and rows that
    repeat an id and its text are treated alike.
    """
    spans = _passages(docs, config).groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct("start", "bytes"))).alias("__vg_spans"))
    joined = keyed_documents(docs).join(spans.withColumnsRenamed({"doc_id": "__vg_doc", "part": "__vg_part"}), ["__vg_doc", "__vg_part"], "left")
    whole = F.col("text").cast("binary")
    end = F.struct(F.octet_length("text").cast("long").alias("start"), F.lit(0).cast("long").alias("bytes"))
    piece = F.aggregate(
        F.concat(F.col("__vg_spans"), F.array(end)),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").cast("binary").alias("kept")),
        lambda a, s: F.struct((s["start"] + s["bytes"]).alias("at"), F.concat(a["kept"], F.substring(whole, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))).alias("kept")),
        lambda a: F.decode(a["kept"], "UTF-8"),
    )
    text = F.when(F.col("__vg_spans").isNull(), F.col("text")).otherwise(piece)
    return joined.withColumn("text", text).select(*docs.columns)
