"""Exact duplicates by Patricia-trie owners.

Texts are equal when identical after each run of white space (``[\\x20\\x09-\\x0D]``) became one space; null is the
empty text. Rows go to partitions by length and content hash; there, whole byte strings enter one compressed radix
trie, in which texts share their prefixes; terminal nodes hold the smallest id and the number of rows. A trie runs twice:
in each input partition (so that copies meet before the shuffle and a hot text arrives once per task), then over the
partial owners, in order of their bytes. A full trie spills by subtree: at the map side those below its first branching, as
partial owners; after the shuffle all that lie before the text just inserted, which are final. What a trie holds is counted in bytes of
memory, nodes and terminals included, so short texts fill it as well as long ones: a task holds about ``SPILL_BYTES`` plus
one text and what an Arrow batch takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import cut
from .shared import SPACE_CLASS, refuse_own_names

#: Bytes of memory that a trie holds before subtrees leave it.
SPILL_BYTES = 64 << 20
#: Bytes that CPython takes for a node (its list, its label without the bytes, its entry in the parent's dictionary), for a
#: dictionary of children, and for a terminal with its two numbers.
NODE, CHILDREN, TERMINAL = 80 + 33 + 104, 184, 72 + 2 * 32


class PatriciaTrie:
    """Compressed radix trie over byte strings; a terminal holds [smallest id or None, count].

    A node is [label, children by first byte or None, terminal or None]; ``size`` counts label bytes, ``memory`` these and
    what nodes but the root, their dictionaries and terminals take.
    """

    def __init__(self) -> None:
        self.root = [b"", {}, None]
        self.size = self._parts = 0

    @property
    def memory(self) -> int:
        return self.size + self._parts

    def insert(self, key: bytes, ident: int | None, count: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            kids = node[1]
            child = kids.get(key[at]) if kids else None
            if child is None:
                if kids is None:
                    node[1] = kids = {}
                    self._parts += CHILDREN
                kids[key[at]] = [key[at:], None, [ident, count]]
                self.size += len(key) - at
                self._parts += NODE + TERMINAL
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, key, at)
            upper = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            kids[key[at]] = upper
            self._parts += NODE + CHILDREN
            node, at = upper, at + same
        held = node[2]
        if held is None:
            node[2] = [ident, count]
            self._parts += TERMINAL
        else:
            held[1] += count
            if ident is not None and (held[0] is None or ident < held[0]):
                held[0] = ident

    def spill(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Yield all terminals and leave the trie empty."""
        root, self.root = self.root, [b"", {}, None]
        yield from self._drain(b"", root)
        self.size = self._parts = 0

    def spill_subtrees(self, most: int, memory: bool = False) -> Iterator[tuple[bytes, int | None, int]]:
        """Remove subtrees below the first branching, one after another, until at most ``most`` label bytes (or bytes of memory) are left, and
        yield their terminals."""
        prefix, node = b"", self.root
        while node[2] is None and node[1] and len(node[1]) == 1:
            node = next(iter(node[1].values()))
            prefix += node[0]
        for byte in sorted(node[1] or ()):
            if (self.memory if memory else self.size) <= most:
                return
            yield from self._drain(prefix, node[1].pop(byte))

    def spill_before(self, key: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        """Remove all subtrees and terminals that sort before ``key``, which the trie holds, and yield the terminals."""
        node, at = self.root, 0
        while at < len(key):
            if node[2] is not None:
                yield key[:at], *node[2]
                node[2] = None
                self._parts -= TERMINAL
            for byte in sorted(b for b in node[1] if b < key[at]):
                yield from self._drain(key[:at], node[1].pop(byte))
            node = node[1][key[at]]
            at += len(node[0])

    def _drain(self, prefix: bytes, top: list) -> Iterator[tuple[bytes, int | None, int]]:
        waiting = [(prefix, top)]
        while waiting:
            before, (label, kids, held) = waiting.pop()
            key = before + label
            self.size -= len(label)
            self._parts -= NODE + CHILDREN * (kids is not None) + TERMINAL * (held is not None)
            if held is not None:
                yield key, held[0], held[1]
            waiting += [(key, child) for child in (kids or {}).values()]


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


_COLUMNS = ("body", "ident", "copies")
_SCHEMA = "body binary, ident long, copies long"


def _batches(items: Iterator[tuple[bytes, int | None, int]]) -> Iterator[pa.RecordBatch]:
    """Terminals as rows, in batches of some megabytes."""
    rows, held = [], 0
    for row in items:
        rows.append(row)
        held += len(row[0])
        if held > 4 << 20:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], _COLUMNS)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: one row for each distinct text that the trie holds together; a full trie spills subtrees and goes on."""

    def owners() -> Iterator[tuple[bytes, int | None, int]]:
        trie = PatriciaTrie()
        for batch in batches:
            for body, ident in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                trie.insert(body.as_py(), ident, 1)
                if trie.memory > SPILL_BYTES:
                    yield from trie.spill_subtrees(SPILL_BYTES // 2, memory=True)
        yield from trie.spill()

    yield from _batches(owners())


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: texts come in order of their bytes, so what a full trie holds before the last one is final and leaves."""

    def owners() -> Iterator[tuple[bytes, int | None, int]]:
        trie = PatriciaTrie()
        for batch in batches:
            for body, ident, count in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                body = body.as_py()
                trie.insert(body, ident, count)
                if trie.memory > SPILL_BYTES:
                    yield from trie.spill_before(body)
        yield from trie.spill()

    yield from _batches(owners())


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), f"{SPACE_CLASS}+", " ")
    return docs.select(F.col("doc_id").cast("long").alias("ident"), text.alias("norm"))


def text_owners(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text: ``text_sha256``, ``keep_id`` (smallest id), ``group_size``."""
    partial = _prepared(docs).select(F.col("norm").cast("binary").alias("body"), "ident").mapInArrow(_collapse, _SCHEMA)
    dealt = partial.repartition(F.octet_length("body"), F.xxhash64("body")).sortWithinPartitions("body")
    owned = dealt.mapInArrow(_own, _SCHEMA)
    return owned.select(F.sha2("body", 256).alias("text_sha256"), F.col("ident").alias("keep_id"), F.col("copies").alias("group_size"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Defined cases: a null text equals the empty one; a null id owns a group only if all its ids are null; of repeated
    rows with the owner's id exactly one is kept; an empty table gives no rows; other columns are not read.
    """
    rows = _prepared(docs).select(F.col("ident").alias("doc_id"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    # a row's own number is good once it is written; of rows with one id and text the least number stays
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "digests")
    least = rows.groupBy(F.col("text_sha256").alias("_sha"), F.col("doc_id").alias("_id")).agg(F.min("_row").alias("_least"))
    owners = text_owners(docs)
    owners = owners.join(least, (F.col("text_sha256") == F.col("_sha")) & F.col("keep_id").eqNullSafe(F.col("_id"))).select("text_sha256", "keep_id", "group_size", "_least")
    joined = rows.join(owners, "text_sha256")
    return joined.select("doc_id", "keep_id", "group_size", (F.col("_row") == F.col("_least")).alias("kept"), "text_sha256")


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The documents without later copies, all columns as they were; of equal rows with one id, one stays.

    A null text equals the empty one; of rows without an id that share a text, and no id is there for it, one stays; an empty
    table gives no rows; columns named ``__vg_...`` raise ValueError.
    """
    refuse_own_names(docs)
    names = docs.columns
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), f"{SPACE_CLASS}+", " ")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    owners = text_owners(docs).select(F.col("text_sha256").alias("__vg_sha"), F.coalesce(F.col("keep_id").cast("string"), F.lit("null")).alias("__vg_id"))
    found = docs.withColumns({"__vg_sha": F.sha2(text.cast("binary"), 256), "__vg_id": ident})
    # the join's partitioning by (_sha, _id) also serves the removal of repeated rows
    return found.join(owners, ["__vg_sha", "__vg_id"], "left_semi").dropDuplicates(["__vg_sha", "__vg_id"]).select(*names)
