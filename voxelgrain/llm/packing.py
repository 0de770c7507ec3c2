"""Best-fit packing of token pieces into fixed-length sequences by exact-complement hashing.

What must be planned is only how many pieces there are of each length, a table of at most ``capacity`` counts. The plan
opens sequences with the longest pieces, and fills a gap exactly by one, two or three lengths found through their sums;
each combination is consumed as often as its counts allow. Gaps without an exact complement take the longest piece that
fits and are looked up again. The plan maps ranks within a length to places. Ranks need no shuffle: the task that cuts
pieces numbers them by length as it goes, and a running sum over the tasks' counts gives what comes before.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

CAPACITY = 1024
END_ID = 2
#: Blocks (tasks that cut pieces) whose first ranks are broadcast, ``capacity`` numbers each; more are joined by shuffle.
BLOCKS = 4096
#: White space, wherever one of Unicode's versions or a library sees it.
_WHITE = "\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: White space that is not one space or line feed between two visible characters.
_UNEVEN = f"^[{_WHITE}]|[{_WHITE}]{{2}}|[{_WHITE}]$|[{_WHITE.replace('x09-', 'x09').replace('x0d', 'x0b-' + chr(92) + 'x0d').replace('x20', 'x1f')}]"
#: A single space between two visible characters: the byte-level pre-tokeniser always begins anew there.
_JOINT = re.compile(r"(?<=[^\s\u180e])(?= [^\s\u180e])")
#: Ids of so many stretches of text are remembered, of at most so many bytes each.
_KNOWN, _LONGEST = 600_000, 48
#: Bytes of texts that are encoded together.
_TOGETHER = 1 << 22


class Encoder:
    """Token ids of whole texts, as unsigned 32-bit numbers, by an encoder with the byte-level pre-tokeniser.

    Texts are encoded in stretches that the pre-tokeniser never looks across: each but the first begins at a single space, or a
    single line feed, between two visible characters. Ids of short stretches are remembered, so that a word is merged once
    and not at each place; what isn't known of a block of texts is encoded at once and told apart by ``lengths``, the bytes
    of each token. Splitting, looking up and joining are Arrow's and NumPy's work.
    """

    def __init__(self, encode: Callable[[str], list[int]], lengths: np.ndarray) -> None:
        self._encode, self._lengths = encode, lengths
        # names of known stretches, their ids one after another, and where each one's begin and how many they are
        self._names = pa.array([], pa.large_string())
        self._ids, self._starts, self._sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _one(self, text: str) -> np.ndarray:
        return np.array(self._encode(text), "<u4")

    def _found(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct stretches, one after another, with the start and the number of each one's. A name lacks the space
        before its stretch; a line feed belongs to the name."""
        at = pc.index_in(names, value_set=self._names)
        new = names.filter(pc.is_null(at))
        known = len(self._names)
        if len(new):
            feeds = np.asarray(pc.starts_with(new, "\n"))
            ids = self._one("".join([x if x[0] == "\n" else " " + x for x in new.to_pylist()]))
            stops = np.cumsum(np.asarray(pc.binary_length(new), np.int64) + ~feeds)
            edges = np.concatenate([[0], np.searchsorted(np.cumsum(self._lengths[ids]), stops) + 1])
            self._starts = np.concatenate([self._starts, edges[:-1] + len(self._ids)])
            self._sizes = np.concatenate([self._sizes, np.diff(edges)])
            self._ids = np.concatenate([self._ids, ids])
            self._names = pa.concat_arrays([self._names, new])
        place = np.asarray(at.fill_null(0), np.int64)
        place[np.asarray(pc.is_null(at))] = known + np.arange(len(new))
        found = self._ids, self._starts[place], self._sizes[place]
        if len(self._names) > _KNOWN:  # go on with what this block has
            short = np.asarray(pc.less_equal(pc.binary_length(names), _LONGEST))
            self._names, self._starts, self._sizes = names.filter(pa.array(short)), found[1][short], found[2][short]
            total = np.cumsum(self._sizes)
            self._ids = found[0][_ranges(self._starts, self._sizes, total)]
            self._starts = total - self._sizes
        return found

    def _uneven(self, text: str) -> np.ndarray:
        """Ids of one text with other white space."""
        first, *rest = _JOINT.split(text)
        coded = pa.array([x[1:] for x in rest], pa.large_string()).dictionary_encode()
        return np.concatenate([self._one(first), self._joined(coded.indices.to_numpy().astype(np.int64), *self._found(coded.dictionary))[0]])

    @staticmethod
    def _joined(place: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches by their places among the distinct ones, and how many there are up to each."""
        total = np.cumsum(sizes[place])
        return ids[_ranges(starts[place], sizes[place], total)], total

    def block(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each of some texts (none of them null)."""
        out: list[np.ndarray | None] = [None] * len(texts)
        uneven = np.asarray(pc.match_substring_regex(texts, _UNEVEN))
        for k in np.flatnonzero(uneven).tolist():
            out[k] = self._uneven(texts[k].as_py())
        rest = np.flatnonzero(~uneven)
        if not len(rest):
            return out
        parts = pc.split_pattern(pc.replace_substring(texts.take(pa.array(rest)), "\n", " \n"), " ")
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        words = parts.flatten()
        # the first stretch of a text has no space before it
        firsts = [self._one(x) for x in words.take(pa.array(offsets[:-1])).to_pylist()]
        others = np.ones(len(words), bool)
        others[offsets[:-1]] = False
        coded = words.filter(pa.array(others)).dictionary_encode()
        ids, total = self._joined(coded.indices.to_numpy().astype(np.int64), *self._found(coded.dictionary))
        edges = np.concatenate([[0], total])[offsets - np.arange(len(offsets))]
        for n, k in enumerate(rest.tolist()):
            out[k] = np.concatenate([firsts[n], ids[edges[n] : edges[n + 1]]])
        return out

    def __call__(self, text: str) -> np.ndarray:
        return self.block(pa.array([text], pa.large_string()))[0]

    def column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column, null texts as empty ones, some texts at a time."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + _TOGETHER, "right")))
            yield from self.block(texts.slice(at, stop - at))
            at = stop


def _ranges(starts: np.ndarray, sizes: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another; ``total`` are the running sums of ``sizes``."""
    return np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)


@cache
def encoder(path: str) -> Encoder:
    """By the file of the ``tokenizers`` library at ``path``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    file = Tokenizer.from_file(path)
    vocabulary = file.get_vocab(with_added_tokens=True)
    lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, ident in vocabulary.items():
        lengths[ident] = len(token)  # a character stands for a byte
    return Encoder(lambda text: file.encode_batch_fast([text], add_special_tokens=False)[0].ids, lengths)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_PIECES = "doc_id long, piece int, start long, length long, ids binary, block int, nth long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit, binary), block and nth of every piece.

    A document is its ids and ``end_id``; one longer than ``capacity`` is cut so that only its first piece may be
    shorter. Null text is empty: one piece that holds ``end_id``. ``block`` is the task, ``nth`` numbers its pieces of one
    length: both hold only once the frame has been written.
    """
    path = vocabulary or default_vocabulary()
    names = [x.split()[0] for x in _PIECES.split(", ")]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
    end = np.uint32(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, block = encoder(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        rows, held = [], 0
        for batch in batches:
            for ident, ids in zip(batch.column(0).to_pylist(), found.column(batch.column(1)), strict=True):
                ids = np.append(ids, end).astype("<u4")
                size = len(ids)
                edges = [0, *range((size - 1) % capacity + 1, size + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    rows.append((ident, k, a, b - a, ids[a:b].tobytes(), block, seen[b - a]))
                    seen[b - a] += 1
                held += size
                if held > 250_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


class ComplementIndex:
    """Counts by length, and lookups of one, two or three lengths with a given sum."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def pair(self, total: int) -> tuple[int, int] | None:
        if total < 2:
            return None
        have = self.left[1:total] > 0
        both = have & have[::-1]
        if total % 2 == 0 and self.left[total // 2] < 2:
            both[total // 2 - 1] = False
        hits = np.flatnonzero(both)
        return None if not len(hits) else (total - 1 - int(hits[0]), int(hits[0]) + 1)

    def exact(self, total: int) -> tuple[int, ...] | None:
        if self.left[total]:
            return (total,)
        if found := self.pair(total):
            return found
        for longest in np.flatnonzero(self.left[1 : max(total - 1, 1)])[::-1] + 1:
            if 3 * longest < total:
                break
            self.left[longest] -= 1
            found = self.pair(total - int(longest))
            self.left[longest] += 1
            if found:
                return (int(longest), *found)
        return None

    def longest(self, most: int) -> int:
        hits = np.flatnonzero(self.left[1 : most + 1])
        return int(hits[-1]) + 1 if len(hits) else 0

    def take(self, lengths: list[int]) -> int:
        """Consume the combination as often as all its counts allow."""
        distinct, times = np.unique(lengths, return_counts=True)
        n = int((self.left[distinct] // times).min())
        self.left[distinct] -= n * times
        return n


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Combinations of lengths, each with how many sequences hold it; every piece is in exactly one."""
    index, plan = ComplementIndex(counts, capacity), []
    while start := index.longest(capacity):
        lengths, gap = [start], capacity - start
        index.left[start] -= 1  # so that lookups see what remains
        while gap:
            found = index.exact(gap) or ((best,) if (best := index.longest(gap)) else None)
            if not found:
                break
            lengths += found
            gap -= sum(found)
            for x in found:
                index.left[x] -= 1
        for x in lengths:
            index.left[x] += 1
        plan.append((lengths, index.take(lengths)))
    return plan


def _places(plan: list[tuple[list[int], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank of each run of ranks, the sequence of that rank, and the offset."""
    used, runs, sequence = [0] * (capacity + 1), {}, 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            runs.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Written ``pieces`` with sequence_id and offset instead of block and nth.

    The driver gets one count per length. What earlier blocks hold of each length comes from windows over one row per block
    and length; each piece finds its rank by its block alone, so pieces are neither sorted nor moved.
    """
    sizes = cut(pieces.groupBy("block", "length").agg((F.max("nth") + 1).alias("n")), "sizes", slim=True)
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan_sequences(counts, capacity), capacity)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("block", "length", before.alias("base")).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("first"))
    bases = F.transform(F.sequence(F.lit(0), F.lit(capacity)), lambda i: F.coalesce(F.try_element_at("first", i.cast("long")), F.lit(0).cast("long")))
    bases = cut(first.select("block", bases.alias("bases")), "bases", slim=True)
    names = [c for c in pieces.columns if c not in ("block", "nth")]
    if bases.count() <= BLOCKS:
        bases = F.broadcast(bases)
    ranked = pieces.join(bases, "block").select(*names, (F.col("nth") + F.get("bases", F.col("length").cast("int"))).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for own in np.unique(length):
                here = np.flatnonzero(length == own)
                first, start, at = places[int(own)]
                k = np.searchsorted(first, rank[here], "right") - 1
                sequence[here], offset[here] = start[k] + rank[here] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    fields = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids (unless ``keep_ids`` is off), ids_crc32, sequence_id, offset of every piece.

    Ids are those of the tokenizer file; the string of a special token in a text is that token. Defined cases: null and empty
    texts give the piece that holds ``end_id``; null ids and repeated rows are packed like any others; ties between pieces
    of one length go by where they are read; an empty table gives no rows; other columns are not read.
    """
    pieces = token_pieces(docs, capacity, end_id, vocabulary).withColumn("ids_crc32", F.crc32("ids"))
    return assign_sequences(cut(pieces if keep_ids else pieces.drop("ids"), "pieces"), capacity)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the token ids of each sequence, pieces in order of their offsets (from ``keep_ids`` output)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.expr("reduce(array_sort(collect_list(struct(offset, ids))), CAST('' AS BINARY), (a, x) -> concat(a, x.ids))").alias("ids"), F.size(parts).alias("pieces"))
